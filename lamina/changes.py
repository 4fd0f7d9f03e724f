"""Change sets: raw logs of edits, their net effect, and differences of tables.

A log has ``seq`` (order), ``op`` (0 insert, 1 delete, 2 update), ``old`` and ``new`` (structs of the whole row). Its net
effect has the key columns, ``upserted``, ``old`` and ``new``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.types import Schema, key_columns, struct_of

INSERT, DELETE, UPDATE = 0, 1, 2


def as_struct(schema: Schema, prefix: str = "") -> SparkColumn:
    return F.struct(*[F.col(f"`{prefix}{c.name}`").alias(c.name) for c in schema])


def empty_log(spark, schema: Schema) -> DataFrame:
    kind = struct_of(schema).simpleString()
    return spark.createDataFrame([], f"seq long, op int, old {kind}, new {kind}")


def log_of(df: DataFrame, schema: Schema, op: int, seq: int, new: dict[str, SparkColumn] | None = None) -> DataFrame:
    """Log of one statement over the rows that it touches; new: the columns that an update sets."""
    before, kind = as_struct(schema), struct_of(schema)
    if op == INSERT:
        old, after = F.lit(None), before
    elif op == DELETE:
        old, after = before, F.lit(None)
    else:
        fields = {f.name: f.dataType for f in kind.fields}
        after = F.struct(*[(new[c.name].cast(fields[c.name]) if c.name in (new or {}) else F.col(f"`{c.name}`")).alias(c.name) for c in schema])
        old = before
    return df.select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), old.cast(kind).alias("old"), after.cast(kind).alias("new"))


def spread(log: DataFrame, schema: Schema) -> DataFrame:
    """An update that changes the key becomes a deletion and an insertion; one that changes nothing goes.

    ``part`` orders the two within a statement: deletions first, so keys may be passed on from row to row.
    """
    keys = [c.name for c in key_columns(schema)]
    moved = ~reduce(lambda a, b: a & b, [F.col("old")[k].eqNullSafe(F.col("new")[k]) for k in keys])
    none = F.lit(None).cast(log.schema["old"].dataType)
    step = lambda part, op, old, new: F.struct(F.lit(part).alias("part"), F.lit(op).alias("op"), old.alias("old"), new.alias("new"))
    both = F.array(step(0, DELETE, F.col("old"), none), step(1, INSERT, none, F.col("new")))
    same = F.array(F.struct(F.lit(1).alias("part"), F.col("op").alias("op"), F.col("old").alias("old"), F.col("new").alias("new")))
    kept = log.where((F.col("op") != UPDATE) | ~F.col("old").eqNullSafe(F.col("new")))
    return kept.select("seq", F.explode(F.when((F.col("op") == UPDATE) & moved, both).otherwise(same)).alias("s")).select("seq", "s.*")


def conflate(log: DataFrame, schema: Schema) -> DataFrame:
    """Net effect by key: the first old row and the last new one; keys that end as they began go.

    This is the closed form of a fold over the log: after changes that cancel out, a key is back at its first old row.
    One aggregation with partial combine.
    """
    rows = spread(log, schema)
    keys = [F.coalesce(F.col("new"), F.col("old"))[c.name].alias(c.name) for c in key_columns(schema)]
    order = F.struct("seq", "part")
    net = rows.groupBy(*keys).agg(F.min_by(F.struct("old"), order).alias("f"), F.max_by(F.struct("new"), order).alias("l"))
    names = [f"`{c.name}`" for c in key_columns(schema)]
    out = net.select(*names, F.col("l.new").isNotNull().alias("upserted"), F.col("f.old").alias("old"), F.col("l.new").alias("new"))
    return out.where(~F.col("old").eqNullSafe(F.col("new")))


def counts(log: DataFrame) -> tuple[int, int, int]:
    """(inserted, deleted, updated) as logged, not conflated."""
    r = log.agg(*[F.count(F.when(F.col("op") == k, 1)).alias(f"n{k}") for k in (INSERT, DELETE, UPDATE)]).first()
    return r["n0"], r["n1"], r["n2"]


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that right lacks (added false) and the reverse (true), as sets; nulls are equal.

    One pass: both sides are reduced to distinct rows with partial aggregation, which also compares nulls as equal.
    """
    names = left.columns
    marked = left.select(*[F.col(f"`{n}`") for n in names], F.lit(1).alias("_side")).unionByName(right.select(*[F.col(f"`{n}`") for n in names], F.lit(2).alias("_side")))
    sides = marked.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.bit_or("_side").alias("_side"))
    return sides.where("_side < 3").select((F.col("_side") == 2).alias("added"), *[F.col(f"`{n}`") for n in names])


def diff_counts(left: DataFrame, right: DataFrame) -> tuple[int, int, int]:
    """(added, removed, 0): an update counts as one of each."""
    r = diff(left, right).agg(F.count(F.when(F.col("added"), 1)).alias("a"), F.count(F.when(~F.col("added"), 1)).alias("r")).first()
    return r["a"], r["r"], 0


def overlay(lower: DataFrame, upper: DataFrame, schema: Schema) -> DataFrame:
    """View of lower rows under newer ones. upper: the table's columns, ``flag`` (present or deleted) and ``seq``."""
    keys = [c.name for c in key_columns(schema)]
    names = [c.name for c in schema]
    last = upper.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct("flag", *[F.col(f"`{n}`") for n in names]), "seq").alias("u"))
    a, b = lower.alias("a"), last.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
    cond = reduce(lambda x, y: x & y, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    under = a.join(b, cond, "left_anti").select(*[F.col(f"`{n}`") for n in names])
    return under.unionByName(last.where("u.flag").select(*[F.col("u")[n].alias(n) for n in names]))


def overlay_changes(lower: DataFrame, upper: DataFrame, schema: Schema) -> DataFrame:
    """Net change set of an overlay over its lower table, with true old rows, so that counts and hashes balance."""
    keys = [c.name for c in key_columns(schema)]
    last = upper.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct("flag", as_struct(schema).alias("row")), "seq").alias("u"))
    old = lower.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], as_struct(schema).alias("old"))
    cond = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    joined = last.join(old, cond, "left")
    out = joined.select(*[F.col(f"`{k}`") for k in keys], F.col("u.flag").alias("upserted"), "old", F.when(F.col("u.flag"), F.col("u.row")).alias("new"))
    return out.where(~F.col("old").eqNullSafe(F.col("new")))
