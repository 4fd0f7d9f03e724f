"""Column types from text: the first type, in a fixed order, that accepts every non-empty value."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.types import Column, Schema, spark_type

_DATE = r"\d{4}-\d{2}-\d{2}"
_TIME = r"([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?"


def _tests(v: SparkColumn) -> list[tuple[str, SparkColumn]]:
    whole = v.rlike(r"^[+-]?\d+$")
    number = F.expr("null").cast("decimal(38,0)")
    number = F.when(whole & (F.length(v) < 38), v.try_cast("decimal(38,0)")) if hasattr(v, "try_cast") else number
    return [
        ("timestamp", v.rlike(rf"^{_DATE}[ T]{_TIME}$") & F.try_to_timestamp(v).isNotNull()),
        ("date", v.rlike(rf"^{_DATE}$") & v.try_cast("date").isNotNull()),
        ("time", v.rlike(rf"^{_TIME}$")),
        ("integer", whole & number.between(-(2**31), 2**31 - 1)),
        ("bigint", whole & number.between(-(2**63), 2**63 - 1)),
        ("numeric", v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")),
        ("boolean", F.lower(v).isin("t", "f", "true", "false")),
        ("json", v.rlike(r"^\s*[\[{]") & F.try_parse_json(v).isNotNull()),
    ]


def infer_schema(df: DataFrame, pk: tuple[str, ...] = ()) -> Schema:
    """Schema of a table of strings, in one aggregation over it; a column without values is text."""
    aggs = []
    for i, name in enumerate(df.columns):
        v = F.col(f"`{name}`")
        some = v.isNotNull() & (v != "")
        aggs.append(F.count(F.when(some, 1)).alias(f"n{i}"))
        aggs += [F.bool_and(F.when(some, F.coalesce(ok, F.lit(False)))).alias(f"{t}{i}") for t, ok in _tests(v)]
    row = df.agg(*aggs).first() if aggs else None
    names = [t for t, _ in _tests(F.lit(""))]
    kinds = [next((t for t in names if row[f"n{i}"] and row[f"{t}{i}"]), "character varying") for i in range(len(df.columns))]
    return [Column(i, n, k, n in pk) for i, (n, k) in enumerate(zip(df.columns, kinds), 1)]


def apply_schema(df: DataFrame, schema: Schema) -> DataFrame:
    """A table of strings in the types of a schema; empty strings are null but in text."""
    out = []
    for c in schema:
        v = F.col(f"`{c.name}`")
        kind = spark_type(c.type)
        v = v if kind.typeName() == "string" else F.when(v != "", v)
        out.append(v.cast(kind).alias(c.name))
    return df.select(*out)


def unique_names(names: list[str | None], limit: int = 63) -> list[str]:
    """Names that are there, short enough and distinct: empty ones by place, clashing ones with a number."""
    out: list[str] = []
    for i, n in enumerate(names, 1):
        base = (n or "").strip() or f"col_{i}"
        name, k = base[:limit], 0
        while name in out:
            tail = f"_{k:03d}"
            name, k = base[: limit - len(tail)] + tail, k + 1
        out.append(name)
    return out
