"""Remote databases: JDBC options by kind, and queries translated to the dialect of an open-data HTTP API."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lamina.quals import Quals

DRIVERS = {
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306),
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}/?db={database}", 443),
    "athena": ("com.simba.athena.jdbc.Driver", "jdbc:awsathena://{host};Schema={database}", 443),
    "sqlite": ("org.sqlite.JDBC", "jdbc:sqlite:{database}", 0),
}


def jdbc_options(kind: str, host: str = "", database: str = "", table: str | None = None, query: str | None = None, port: int | None = None, user: str | None = None, password: str | None = None, private_key: str | None = None, batch_size: int = 10_000, partition: tuple[str, int, int, int] | None = None) -> dict[str, str]:
    """Options of Spark's JDBC reader, which pushes filters, columns, limits and aggregates down by itself.

    ``partition``: column, least and greatest value and number of parts for parallel reads.
    """
    if kind not in DRIVERS:
        raise ValueError(f"unknown kind {kind}")
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    driver, url, default = DRIVERS[kind]
    out = {"driver": driver, "url": url.format(host=host, port=port or default, database=database), "fetchsize": str(batch_size), "pushDownAggregate": "true", "pushDownLimit": "true"}
    out |= {"dbtable": table} if table else {"query": query}
    if partition:
        if query:
            raise ValueError("a query is read in one part; name a table for parallel reads")
        out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition)))
    if private_key:
        if kind != "snowflake":
            raise ValueError("only snowflake takes a private key")
        out |= {"private_key_base64": private_key, "authenticator": "SNOWFLAKE_JWT"}
    return out | {k: v for k, v in (("user", user), ("password", password)) if v}


def read_jdbc(spark: SparkSession, **args) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**args)).load()


# SoQL

_AGGREGATES = {"count", "sum", "avg", "min", "max"}


def soql_value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def soql_where(quals: Quals | None, names: dict[str, str] | None = None) -> str:
    """Condition in SoQL; a clause with a part that it can't express is left to the caller as a whole."""

    def one(name: str, op: str, value) -> str | None:
        c, op = f"`{(names or {}).get(name, name)}`", op.lower()
        if op in ("is null", "is not null"):
            return f"{c} {op.upper()}"
        if value is None:
            return f"{c} IS {'NOT ' if op in ('<>', '!=') else ''}NULL" if op in ("=", "<>", "!=") else None
        if op in ("=", "<>", "!=", ">", ">=", "<", "<="):
            return f"{c} {'!=' if op == '<>' else op} {soql_value(value)}"
        if op in ("like", "~~", "not like", "!~~"):
            return f"{c} {'NOT ' if op in ('not like', '!~~') else ''}LIKE {soql_value(value)}"
        if op in ("in", "= any", "not in", "<> all"):
            return f"{c} {'NOT ' if op in ('not in', '<> all') else ''}IN ({', '.join(map(soql_value, value))})"
        return None

    clauses = []
    for clause in quals or []:
        parts = [one(*q) for q in clause]
        if parts and all(parts):
            clauses.append("(" + " OR ".join(parts) + ")")
    return " AND ".join(clauses)


def soql_order(keys: Sequence[tuple[str, bool, bool]], names: dict[str, str] | None = None) -> str | None:
    """Sort keys (column, descending, nulls first); None where nulls would go elsewhere. ``:id`` makes paging stable."""
    if any(nulls_first != descending for _, descending, nulls_first in keys):
        return None
    return ", ".join([*[f"`{(names or {}).get(n, n)}` {'DESC' if d else 'ASC'}" for n, d, _ in keys], ":id"])


def soql_query(columns: Sequence[str] | None = None, quals: Quals | None = None, order: Sequence[tuple[str, bool, bool]] = (), group: Sequence[str] = (), aggregates: dict[str, tuple[str, str]] | None = None, limit: int | None = None, names: dict[str, str] | None = None) -> dict[str, str]:
    """$select, $where, $group, $order and $limit of a request. aggregates: output name to (function, column or *)."""
    col = lambda n: f"`{(names or {}).get(n, n)}`"
    select = [col(c) for c in (group if aggregates is not None else columns or [])]
    for alias, (function, column) in (aggregates or {}).items():
        if function not in _AGGREGATES:
            raise ValueError(f"{function} isn't pushed down")
        select.append(f"{function}({'*' if column == '*' else col(column)}) AS {alias}")
    out = {"$select": ", ".join(select) or "*"}
    if where := soql_where(quals, names):
        out["$where"] = where
    if group:
        out["$group"] = ", ".join(map(col, group))
    if aggregates is None and (by := soql_order(order, names)):
        out["$order"] = by
    if limit is not None:
        out["$limit"] = str(limit)
    return out
