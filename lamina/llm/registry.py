"""Queries and SQL of this subpackage, gathered for the driver's contract."""

from lamina.llm import lines, lm, media, mixing, packing, pii, quality, sharding, simhash, tokencount

MODULES = (sharding, tokencount, lm, pii, media, simhash, lines, mixing, packing, quality)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
