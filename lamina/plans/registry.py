"""All queries on the library's own operators, and their SQL."""

from lamina.plans import relational, repositories, versioned

QUERIES = {**versioned.QUERIES, **relational.QUERIES, **repositories.QUERIES}
ORACLES = {**versioned.ORACLES, **relational.ORACLES, **repositories.ORACLES}
