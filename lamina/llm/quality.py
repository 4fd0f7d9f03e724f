"""Quality rules: compression bands.

Each document is compressed with zstandard as a whole and again in fixed chunks. Text that shrinks far more than prose
of its length does is repetitive; text that hardly shrinks is noise, keys or encoded bytes. Limits depend on length,
since short inputs pay for the frame header and give the compressor little history.

Where the corpus has labels, limits are drawn closer: of the clean documents (all their labels say quality 1) of each
band, the ``QUANTILE`` least ratio less ``MARGIN`` is the least for whole texts over ``DERIVE_FROM`` bytes; likewise for
chunks, from the least and greatest of each clean document, over all bands. A band with fewer than ``LEAST_CLEAN`` clean
documents keeps the limit of ``BANDS``, and no limit gets looser than that. Ratios are counted in steps of 0.0001, so
the driver gets one row per band and an aggregation holds few values however many documents there are.

Texts are compressed once for the figures, from which both limits and verdicts follow; a filter that keeps the
documents' own columns compresses a second time where there are labels, since moving the documents to their figures
would cost more. Ids and ratios are all that is shuffled.

Defined results: null and empty texts have no ratio and are kept (there is nothing to judge); rows with equal ids or
equal texts are judged alike, each on its own; other columns, whatever their names and types, pass through
``filter_documents`` untouched; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.runtime import cut, table

#: Longest length in bytes of a band, least and greatest ratio of whole texts in it.
#: Below 64 bytes the frame outweighs the text, so nothing is told from a high ratio.
BANDS = (
    (64, 0.40, 20.00),
    (128, 0.40, 2.00),
    (256, 0.36, 1.05),
    (512, 0.34, 0.90),
    (1024, 0.32, 0.85),
    (4096, 0.28, 0.80),
    (16384, 0.26, 0.78),
    (2**62, 0.22, 0.76),
)
CHUNK = 2048
CHUNK_BAND = (0.28, 0.80)
#: Up to ten chunks, none may be bad.
MAX_BAD_SHARE = 0.10
#: Share of clean documents beyond a limit before the margin, which allows for wrong labels; margin as a share of the ratio.
QUANTILE, MARGIN = 0.001, 0.06
#: Clean documents that a band needs, and bytes up to which texts are too short to tell a repeated word from junk.
LEAST_CLEAN, DERIVE_FROM = 16, 128
LEVEL = 3
#: What compression tells of a text: its bytes, its ratio, and those of its chunks.
FIGURES = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("whole_ratio", T.DoubleType()), T.StructField("chunks", T.ArrayType(T.DoubleType()))])


def figures(raw: bytes, compress, chunk: int = CHUNK) -> tuple:
    """Bytes, whole ratio and chunk ratios of one text.

    A tail of under half a chunk belongs to the chunk before it; a text of under one and a half chunks is its only one.
    """
    n = len(raw)
    if n == 0:
        return 0, None, None
    whole = len(compress(raw)) / n
    if n < chunk * 3 // 2:
        return n, whole, [whole]
    cuts = list(range(0, n - chunk // 2, chunk)) + [n]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < chunk // 2:
        del cuts[-2]
    return n, whole, [len(compress(raw[a:b])) / (b - a) for a, b in zip(cuts, cuts[1:])]


def compressed(text: str = "text"):
    """Column of ``FIGURES`` for a text column."""
    names, types = FIGURES.fieldNames(), [pa.int64(), pa.float64(), pa.list_(pa.float64())]

    def band(column: pa.Array) -> pa.Array:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        rows = [figures(s.as_buffer(), compress) if s.is_valid else (0, None, None) for s in column.cast(pa.large_string())]
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    band.__annotations__ = {"column": pa.Array, "return": pa.Array}
    # as if it weren't deterministic, so that filters above it don't compress a second time
    return F.arrow_udf(band, FIGURES).asNondeterministic()(F.col(text).cast("string"))


def chunked(v: Column) -> Column:
    """Whether a text has chunks apart from the whole."""
    return v["n_bytes"] >= CHUNK * 3 // 2


def bad_share(v: Column, chunk_band: tuple[float, float]) -> Column:
    """Share of a text's chunks outside the band; a text of one chunk is judged as a whole only."""
    bad = F.size(F.filter(v["chunks"], lambda r: (r < chunk_band[0]) | (r > chunk_band[1]))) / F.size(v["chunks"])
    return F.when(v["n_bytes"] > 0, F.when(chunked(v), bad).otherwise(0.0))


def reason(v: Column, bands=BANDS, chunk_band=CHUNK_BAND, max_bad: float = MAX_BAD_SHARE) -> Column:
    """Why a text is rejected by its figures; null where it isn't."""
    low = F.coalesce(*[F.when(v["n_bytes"] <= most, F.lit(float(lo))) for most, lo, _ in bands])
    high = F.coalesce(*[F.when(v["n_bytes"] <= most, F.lit(float(hi))) for most, _, hi in bands])
    return F.when(v["whole_ratio"] < low, "repetitive").when(v["whole_ratio"] > high, "incompressible").when(bad_share(v, chunk_band) > max_bad, "chunks")


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, v) of every document, written once: limits and verdicts read it."""
    return cut(docs.select(F.col(f"`{key}`").alias("id"), compressed(text).alias("v")))


def limits(found: DataFrame, labels: DataFrame | None) -> tuple[tuple, tuple]:
    """``BANDS`` and ``CHUNK_BAND``, drawn closer by the clean documents among those judged."""
    if labels is None:
        return BANDS, CHUNK_BAND
    clean = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1")
    v = F.col("v")
    band = F.coalesce(*[F.when(v["n_bytes"] <= most, i) for i, (most, *_) in enumerate(BANDS)])
    step = lambda c: F.floor(c * 10_000) / 10_000
    ratios = found.where(v["n_bytes"] > 0).join(clean, "id", "left_semi").select(
        band.alias("band"), step(v["whole_ratio"]).alias("w"), F.when(chunked(v), step(F.array_min(v["chunks"]))).alias("lo"), F.when(chunked(v), step(F.array_max(v["chunks"]))).alias("hi")
    )
    bands = list(BANDS)
    for r in ratios.groupBy("band").agg(F.count("w").alias("n"), F.percentile("w", F.lit(QUANTILE)).alias("w")).collect():
        most, low, high = BANDS[r["band"]]
        if r["n"] >= LEAST_CLEAN and most > DERIVE_FROM:
            bands[r["band"]] = (most, max(low, r["w"] * (1 - MARGIN)), high)
    chunks = ratios.agg(F.count("lo").alias("n"), F.percentile("lo", F.lit(QUANTILE)).alias("lo"), F.percentile("hi", F.lit(1 - QUANTILE)).alias("hi")).first()
    if chunks["n"] < LEAST_CLEAN:
        return tuple(bands), CHUNK_BAND
    return tuple(bands), (max(CHUNK_BAND[0], chunks["lo"] * (1 - MARGIN)), min(CHUNK_BAND[1], chunks["hi"] * (1 + MARGIN)))


def filter_documents(docs: DataFrame, text: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """The documents that no band rejects, with their own columns."""
    bands, chunk_band = limits(judged(docs, text), labels) if labels is not None else (BANDS, CHUNK_BAND)
    name = "_v" + uuid.uuid4().hex[:8]
    return docs.withColumn(name, compressed(text)).where(reason(F.col(name), bands, chunk_band).isNull()).drop(name)


def kept(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Kept documents with the figures that they were judged by."""
    found, v = judged(docs), F.col("v")
    bands, chunk_band = limits(found, labels)
    return found.where(reason(v, bands, chunk_band).isNull()).select(
        F.col("id").alias("doc_id"), "v.n_bytes", "v.whole_ratio", F.array_min("v.chunks").alias("chunk_min"), F.array_max("v.chunks").alias("chunk_max"), bad_share(v, chunk_band).alias("bad_share")
    )


def op10_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_bands": op10_quality_bands}
ORACLES: dict[str, str] = {}
