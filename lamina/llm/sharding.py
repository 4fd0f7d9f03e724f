"""Sharding by a K-d tree over metadata.

A node that holds more than the target bytes is split along its widest dimension (its extent as a share of the corpus's
extent, first of equals) at the weighted median, weights being bytes: of the two cuts at that value, below it or above,
the more even one. Leaves hold at most the target, or rows that no dimension tells apart. All nodes of a level are split
by the same few aggregations over a narrow metadata table: medians are found by refining 1024-bin histograms, so
neither sort nor driver memory grows with the rows; the driver holds one row per open node.

Dimensions are integers: whole numbers as they are in all 64 bits, values of all other types (strings, fractions, times)
by their place among the column's distinct values, found by a distributed sort of these; strings sort by bytes. Null is one less than the least value (the least 64-bit integer,
where the column holds that itself). Documents count
at least one byte, so empty and null texts spread like others. Rows with equal metadata (ties, repeated rows) share a
leaf. An empty table gives no rows. Leaves are numbered from left to right. Other columns play no part. Dimensions of
any type with an order will do; ids are numbers. Only rows of open nodes are read and written again at each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.runtime import cut, small, table

TARGET = 64 << 20
#: Shards that a table gets at least, by a lower target, so that there is work for a cluster at any size.
LEAST_SHARDS = 32
WHOLE = ("tinyint", "smallint", "int", "bigint", "boolean")
BINS = 1024
LEAST = -(2**63)


def ranked(docs: DataFrame, name: str, rank: str) -> tuple[DataFrame, int]:
    """(name, rank) of a column's distinct values, dense and in order; and how many there are.

    Rows are numbered within the partitions of a sort; the driver adds up one count per partition.
    """
    row = F.monotonically_increasing_id()  # partition << 33 | row
    values = docs.select(F.col(f"`{name}`").alias(rank + "v")).where(F.col(rank + "v").isNotNull()).distinct()
    values = cut(values.orderBy(rank + "v").select(rank + "v", F.shiftright(row, 33).alias("p"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    counts, firsts, total = values.groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect(), [], 0
    for r in counts:
        firsts.append((r["p"], total))
        total += r["n"]
    first = docs.sparkSession.createDataFrame(firsts, "p long, first long")
    return values.join(F.broadcast(first), "p").select(rank + "v", (F.col("first") + F.col("i")).alias(rank)), total


def measured(docs: DataFrame, key: str, size: Column, dims: list[str], names: list[str]) -> DataFrame:
    """(id, bytes, d0, ...) of each document; null dimensions are still null."""
    kinds, others = dict(docs.dtypes), {}
    columns = []
    for d, n in zip(dims, names):
        if kinds[d] not in WHOLE:
            others[n] = d
        columns.append((F.col(f"`{d}`").cast("long") if kinds[d] in WHOLE else F.col(f"`{d}`")).alias(n))
    rows = docs.select(F.col(key).cast("long").alias("id"), size.alias("bytes"), *columns)
    for n, d in others.items():
        values, count = ranked(docs, d, "rank")
        rows = rows.join(small(values, count), F.col(n) == F.col("rankv"), "left").withColumn(n, F.col("rank")).drop("rank", "rankv")
    return rows.select("id", "bytes", *names)


def bounds(df: DataFrame, by: list[str], dims: list[str]) -> list:
    out = df.groupBy(*by) if by else df
    return out.agg(F.sum("bytes").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()


def medians(rows: DataFrame, nodes: dict[int, tuple[str, int, int]], spark: SparkSession) -> dict[int, int]:
    """Cut by node: values up to it go left. nodes: dimension, least and greatest value.

    Each round narrows every open node to the bin that its median is in, until that bin holds one value.
    """
    open_ = {k: (d, lo, hi, 0, -1) for k, (d, lo, hi) in nodes.items()}  # dimension, range, bytes below it, bytes in all
    value = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in sorted({d for d, *_ in nodes.values()})])
    run = Window.partitionBy("node")
    found: dict[int, int] = {}
    while open_:
        asked = spark.createDataFrame([(k, d, lo, hi, -(-(hi - lo + 1) // BINS), under, total) for k, (d, lo, hi, under, total) in open_.items()], "node long, dim string, lo long, hi long, step long, under long, total long")
        hit = rows.join(small(asked, len(open_)), "node").withColumn("v", value).where("v BETWEEN lo AND hi")
        # v - lo could exceed 64 bits; the bin around zero is twice as wide, which the next round makes good
        bins = hit.groupBy("node", "under", "total", F.expr("v div step").alias("bin")).agg(F.sum("bytes").alias("w"), F.min("v").alias("least"), F.max("v").alias("most"))
        cum = bins.withColumn("upto", F.col("under") + F.sum("w").over(run.orderBy("bin"))).withColumn("all", F.when(F.col("total") < 0, F.sum("w").over(run)).otherwise(F.col("total")))
        for r in cum.where("upto * 2 >= all").groupBy("node").agg(F.min_by(F.struct("w", "upto", "all", "least", "most"), "bin").alias("m")).select("node", "m.*").collect():
            k, at, upto, under = r["node"], r["least"], r["upto"], r["upto"] - r["w"]
            if at < r["most"]:
                open_[k] = (open_[k][0], at, r["most"], under, r["all"])
                continue
            del open_[k]
            _, first, last = nodes[k]
            with_it = at < last and (at == first or abs(2 * upto - r["all"]) <= abs(2 * under - r["all"]))
            found[k] = at if with_it else at - 1
    return found


def shards(docs: DataFrame, dims: list[str], target: int = TARGET, key: str = "doc_id", text: str = "text", least_shards: int = 1) -> DataFrame:
    """(doc_id, bytes, shard) of each document. With ``least_shards`` the target is that share of all bytes at most."""
    spark = docs.sparkSession
    names = [f"d{i}" for i in range(len(dims))]
    size = F.greatest(F.coalesce(F.octet_length(F.col(text)), F.lit(0)), F.lit(1)).cast("long")
    rows = cut(measured(docs, key, size, dims, names))
    least = rows.agg(*[F.min(n).alias(n) for n in names]).first()
    null = {n: 0 if least[n] is None else max(LEAST, least[n] - 1) for n in names}
    rows = rows.select("id", "bytes", *[F.coalesce(F.col(n), F.lit(null[n]).cast("long")).alias(n) for n in names])
    whole = bounds(rows, [], names)[0]
    if whole["bytes"] is None:
        return rows.select(F.col("id").alias(key), "bytes", F.lit(0).alias("shard"))
    target = max(1, min(target, whole["bytes"] // least_shards))
    extent = {n: max(1, whole[f"hi_{n}"] - whole[f"lo_{n}"]) for n in names}
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    level, done = {1: whole}, []
    while level:
        nodes: dict = {}
        for k, b in level.items():
            width, neg, dim = max(((b[f"hi_{n}"] - b[f"lo_{n}"]) / extent[n], -i, n) for i, n in enumerate(names))
            if b["bytes"] > target and width > 0:
                nodes[k] = (dim, b[f"lo_{dim}"], b[f"hi_{dim}"])
        leaves = [k for k in level if k not in nodes]
        if leaves:
            done.append((rows, leaves))  # they stay in this level's table
        if not nodes:
            break
        dim_of = {k: v[0] for k, v in nodes.items()}
        open_ = spark.createDataFrame([(k,) for k in nodes], "node long")
        cuts = medians(rows.join(small(open_, len(nodes)), "node", "left_semi") if leaves else rows, nodes, spark)
        tree = spark.createDataFrame([(k, dim_of[k], c) for k, c in cuts.items()], "node long, dim string, at long")
        value = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in sorted(set(dim_of.values()))])
        # one row per split node: 24 bytes for each two shards of a whole target
        side = F.when(value <= F.col("at"), 0).otherwise(1)
        rows = cut(rows.join(small(tree, len(cuts)), "node").select("id", "bytes", *names, (F.col("node") * 2 + side).alias("node")))
        level = {r["node"]: r for r in bounds(rows, ["node"], names)}
    found = [k for _, leaves in done for k in leaves]
    bits = max(k.bit_length() for k in found)
    number = {k: i for i, k in enumerate(sorted(found, key=lambda k: k << (bits - k.bit_length())))}
    out = None
    for part, leaves in done:
        mine = spark.createDataFrame([(k, number[k]) for k in leaves], "node long, shard int")
        part = part.join(small(mine, len(leaves)), "node").select(F.col("id").alias(key), "bytes", "shard")
        out = part if out is None else out.unionByName(part)
    return out


DIMS = ["lang", "source", "n_chars", "doc_id"]


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), DIMS, least_shards=LEAST_SHARDS)


QUERIES = {"op1_kd_sharding": op1_kd_sharding}
ORACLES: dict[str, str] = {}
