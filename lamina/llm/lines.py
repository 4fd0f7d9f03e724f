"""Line dedup over levelled sorted runs.

The corpus comes in batches (here: ranges of ``doc_id``). Each batch reduces its lines to one row per distinct hash,
anti-joins the live runs by sort-merge, and what is left becomes a new run: one sorted file per bucket of hashes, so
later batches join it without moving or sorting it. When a level holds ``fanout`` runs they are merged into one of the
next level; a line is therefore rewritten once per level, and a batch meets few runs. Buckets follow the size of the
input. Only hashes and places move until the end, when the documents take up the positions that they keep.

A line is compared without blanks at its ends. The first bearer by (doc_id, text hash, position) keeps it; null ids
come first; ids are numbers. Blank lines are never dropped. A document that loses every line with content is dropped,
one that never had any stays. Null texts stay null. Of rows with equal id and text that has content one stays.
``n_chars``, if there, is counted anew; other columns of any type pass through. The runs' tables leave the catalog
with the call; their files stay in the shared folder until the driver ends, as the result reads them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.rows import one_of_each, own_key
from lamina.runtime import delete_path, input_bytes, scratch_path, table

#: Batches that a query cuts its table into, runs of a level that are merged into one.
BATCHES, FANOUT = 4, 2
#: Buckets of a run: one for so many bytes that the input's files hold, and at least and (Spark's own limit) at most.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 << 20, 24, 100_000
#: Lets a scan of one file per bucket report that it is sorted.
SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
KEY = ("h1", "h2")
PLACE = ("doc_id", "th", "pos")


class Runs:
    """Levelled runs of line hashes: tables bucketed and sorted by hash, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int = LEAST_BUCKETS):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[tuple[str, str]]] = []

    def live(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        for run in self.live():
            batch = batch.join(run.select(*KEY), list(KEY), "left_anti")
        return batch

    def _write(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name, path = f"lamina_run_{uuid.uuid4().hex}", scratch_path(self.spark, "run")
        was = self.spark.conf.get(SORTED)
        self.spark.conf.set(SORTED, "true")
        try:
            df.write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        finally:
            self.spark.conf.set(SORTED, was)
        self.schema = df.schema
        self.levels[level].append((name, path))

    def close(self) -> list[str]:
        """Takes the runs out of the catalog; the folders of their files."""
        runs, self.levels = [run for level in self.levels for run in level], []
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return [path for _, path in runs]

    def add(self, batch: DataFrame) -> None:
        """One more run: the rows of the batch whose hash no run holds."""
        self._write(self.unseen(batch), 0)

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                merged = self.spark.table(old[0][0])
                for name, _ in old[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self._write(merged.repartition(self.buckets, *KEY), level + 1)
                for name, path in old:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                    delete_path(self.spark, path)
            level += 1


def places(docs: DataFrame, text: str = "text") -> DataFrame:
    """Hash and place of each line with content."""
    line = F.trim(F.col("line"))
    return (
        docs.where(F.col(text).isNotNull())
        .select("doc_id", F.xxhash64(F.col(text)).alias("th"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
        .where(line != "")
        .select(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), *PLACE)
    )


def batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """Ranges of ``doc_id`` of about equal counts; null ids belong to the first."""
    bounds = sorted(set(docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    cuts = [int(b) for b in bounds]
    key, parts = F.col("doc_id"), []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        cond = F.lit(True) if lo is None else key > lo
        if hi is not None:
            cond = cond & (key <= hi)
        parts.append(docs.where(cond | key.isNull() if lo is None else cond))
    return parts


def buckets_for(docs: DataFrame) -> int:
    """Buckets of a run by the bytes of the input."""
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-input_bytes(docs) // BUCKET_BYTES)))


def dedup_lines(docs: DataFrame, n_batches: int = BATCHES, fanout: int = FANOUT, buckets: int | None = None, text: str = "text") -> DataFrame:
    columns, spark = docs.columns, docs.sparkSession
    buckets = buckets or buckets_for(docs)
    docs = one_of_each(docs, F.exists(F.split(F.col(text), "\n", -1), lambda x: F.trim(x) != ""), text)
    runs = Runs(spark, fanout, buckets)
    try:
        parts = batches(docs, n_batches)
        for i, part in enumerate(parts):
            first = places(part, text).repartition(buckets, *KEY).groupBy(*KEY).agg(F.min(F.struct(*PLACE)).alias("f")).select(*KEY, "f.*")
            runs.add(first)
            if i + 1 < len(parts):
                runs.compact()
    finally:
        folders = runs.close()
    survivors = spark.read.schema(runs.schema).parquet(*folders)
    mark = uuid.uuid4().hex[:8]
    d, t, kept, split = f"_d{mark}", f"_t{mark}", f"_k{mark}", f"_l{mark}"
    keep = survivors.groupBy(own_key("doc_id", "th").alias(d), F.col("th").alias(t)).agg(F.collect_list("pos").alias(kept))
    mine = docs.withColumn(t, F.xxhash64(F.col(text))).withColumn(d, own_key("doc_id", t))
    joined = mine.join(keep, [d, t], "left").withColumn(split, F.split(F.col(text), "\n", -1))
    blank = F.filter(F.transform(split, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    places_ = F.array_sort(F.concat(F.coalesce(kept, F.array().cast("array<int>")), blank))
    out = joined.where(F.col(text).isNull() | F.col(kept).isNotNull() | (F.size(blank) == F.size(split)))
    new = F.array_join(F.transform(places_, lambda i: F.get(F.col(split), i)), "\n")
    return out.select(*[F.when(F.col(text).isNotNull(), new).alias(text) if c == text else F.col(f"`{c}`") for c in columns]).select(
        *[F.when(F.col(text).isNotNull(), F.char_length(text).cast("long")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns]
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {
    "op7_line_dedup": """
WITH parts AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts),
ranked AS (SELECT *, trim(line) = '' AS blank, row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, pos) AS rn FROM lines),
made AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE blank OR rn = 1) AS text,
         count(*) FILTER (WHERE NOT blank) AS had, count(*) FILTER (WHERE NOT blank AND rn = 1) AS kept
  FROM ranked GROUP BY doc_id)
SELECT d.doc_id, m.text, d.lang, d.source, CAST(length(m.text) AS BIGINT) AS n_chars
FROM documents d JOIN made m ON m.doc_id = d.doc_id WHERE m.kept > 0 OR m.had = 0"""
}
