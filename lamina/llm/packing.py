"""Packing: concatenate and cut.

Two passes. The first counts tokens (runs without ASCII white space) by document; their totals by partition, summed up
in order of ``doc_id``, give each partition its global offset. The second streams each sorted partition through and cuts
fixed windows at multiples of ``window`` tokens of the whole concatenation. Windows that lie within one partition are
finished there; of a window that crosses partitions each leaves a boundary record, and only those are shuffled again.

Order is (doc_id, hash of text, text), null ids as the least 64-bit integer; rows equal in all are interchangeable.
Partitions are ranges of (doc_id, hash), so an id, or null, that many rows share is cut into several as well; only rows
that are equal in both stay together. Null and empty texts have no tokens and appear in no window. The last window may be
short. Ids are numbers; columns besides doc_id and text play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.mixing import slices
from lamina.llm.textnp import utf8
from lamina.runtime import cut, table

WINDOW = 2048
#: Tokens that a partition of the second pass is meant to hold.
PER_PARTITION = 4_000_000
#: Partitions at most (beyond it each sorts more, by spilling), and ranges by which each is balanced.
MOST_PARTITIONS, FINE = 16_384, 4
SCHEMA = "window_id long, n_tokens int, doc_ids array<long>, starts array<int>, text string"
ARROW = pa.schema([("window_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("text", pa.string())])
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Stands for null among ids.
NONE = -(2**63)
BATCH_ROWS = 64
#: Bytes of text that numpy works on at a time.
SLICE = 1 << 20


def count_tokens(column) -> np.ndarray:
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    begins = ~SPACE[data]
    after = begins[:-1].copy()
    begins[1:] &= ~after
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = ~SPACE[data[heads]]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[offsets[1:]] - total[offsets[:-1]]


def counted(docs: DataFrame) -> DataFrame:
    """(id, th, n) of each document."""

    def run(batches):
        for b in batches:
            n = [count_tokens(b.column(2).slice(start, length)) for start, length in slices(b.column(2), SLICE)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["id", "th", "n"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, n long")


def placed(ids: np.ndarray, ths: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of bounds (id, hash), which are sorted, that lie before each row."""
    own, first, several = np.unique(at[0], return_index=True, return_counts=True)
    pos = np.searchsorted(own, ids)
    out = np.append(first, len(at[0]))[pos]
    for i in np.unique(pos[(pos < len(own)) & np.isin(ids, own[several > 1])]):
        here = (pos == i) & (ids == own[i])
        out[here] += np.searchsorted(at[1][first[i] : first[i] + several[i]], ths[here])
    return out


def place(at: tuple[np.ndarray, np.ndarray]):
    """Column of the bucket of (id, th)."""

    def run(ids: pa.Array, ths: pa.Array) -> pa.Array:
        return pa.array(placed(ids.to_numpy(), ths.to_numpy(), at).astype(np.int32))

    run.__annotations__ = {"ids": pa.Array, "ths": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")("id", "th")


def ranges(counts: DataFrame, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (id, hash) of fine ranges: quantiles of ids, and cuts within every id that has much of the tokens."""
    if n == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = np.int64(2**63 - 1)
    found = {(int(x), int(most)) for x in counts.stat.approxQuantile("id", [i / (FINE * n) for i in range(1, FINE * n)], 1 / (2 * FINE * n))}
    share = total / n
    for r in counts.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") > share / 2).collect():  # at most 2n
        m = math.ceil(r["n"] / share * FINE)
        found |= {(r["id"], -(2**63) + (k << 64) // m) for k in range(1, m)} | {(r["id"], int(most))}
        if r["id"] > NONE:
            found.add((r["id"] - 1, int(most)))
    bounds = sorted(found)
    return np.array([b for b, _ in bounds], np.int64), np.array([t for _, t in bounds], np.int64)


def cutter(prefix: np.ndarray, window: int, edges: bool):
    """Function for mapInArrow over sorted (bucket, doc_id, text): whole windows, or else the boundary records."""

    def run(batches):
        bucket, at, end = None, 0, 0
        ids: list = []
        starts: list = []
        words: list = []
        out: list = []

        def close(last: bool):
            """The window that is being filled: whole if it began and ended here."""
            nonlocal ids, starts, words
            if words:
                begin = at - len(words)
                whole = begin % window == 0 and (len(words) == window or (last and bucket == len(prefix) - 2))
                if whole != edges:
                    out.append((begin // window, len(words), ids, [s + begin % window for s in starts], b" ".join(words).decode()))
                ids, starts, words = [], [], []

        def flush():
            rows = list(zip(*out)) if out else [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, ARROW)], schema=ARROW)

        for b in batches:
            for k, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if k != bucket:
                    close(True)
                    bucket, at = k, int(prefix[k])
                    end = int(prefix[k + 1])
                if not text.is_valid:
                    continue
                parts = text.as_buffer().to_pybytes().split() if isinstance(text, (pa.StringScalar, pa.LargeStringScalar)) else []
                done = 0
                while done < len(parts):
                    room = window - at % window
                    take = min(room, len(parts) - done)
                    ids.append(doc)
                    starts.append(len(words))
                    words += parts[done : done + take]
                    done += take
                    at += take
                    if at % window == 0:
                        close(False)
                if len(out) >= BATCH_ROWS:
                    yield flush()
        close(True)
        yield flush()

    return run


def pack(docs: DataFrame, window: int = WINDOW, per_partition: int = PER_PARTITION) -> DataFrame:
    """Windows of ``window`` tokens: id, tokens, documents in order, where each begins, and the tokens joined by blanks."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    counts = cut(counted(docs))
    total = counts.agg(F.sum("n")).first()[0] or 0
    n = min(MOST_PARTITIONS, max(1, math.ceil(total / per_partition)))
    fine = ranges(counts, n, total)
    sums = {r["b"]: r["n"] for r in counts.groupBy(place(fine).alias("b")).agg(F.sum("n").alias("n")).collect()}
    # neighbours are joined to ranges with about equal tokens
    chosen, prefix, held = [], [0], 0
    for i in range(len(fine[0]) + 1):
        held += sums.get(i, 0)
        if i < len(fine[0]) and held >= total / n:
            chosen.append(i)
            prefix.append(prefix[-1] + held)
            held = 0
    prefix = np.array([*prefix, prefix[-1] + held], np.int64)
    bucket = place((fine[0][chosen], fine[1][chosen])).alias("bucket")
    ordered = docs.select(bucket, "doc_id", "id", "th", "text").repartitionById(len(chosen) + 1, F.col("bucket")).sortWithinPartitions("bucket", "id", "th", "text").select("bucket", "doc_id", "text")
    whole = ordered.mapInArrow(cutter(prefix, window, False), SCHEMA)
    pieces = ordered.mapInArrow(cutter(prefix, window, True), SCHEMA)
    joined = pieces.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct(F.element_at("starts", 1).alias("s"), "n_tokens", "doc_ids", "starts", "text"))).alias("p"))
    field = lambda name: F.transform("p", lambda x: x[name])
    edges = joined.select(
        "window_id",
        F.aggregate(field("n_tokens"), F.lit(0), lambda a, x: a + x).alias("n_tokens"),
        F.flatten(field("doc_ids")).alias("doc_ids"),
        F.flatten(field("starts")).alias("starts"),
        F.array_join(field("text"), " ").alias("text"),
    )
    return whole.unionByName(edges)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLES = {
    "op9_packing": f"""
WITH parts AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '') AS ws FROM documents),
sized AS (SELECT doc_id, ws, CAST(coalesce(sum(len(ws)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM parts),
toks AS (SELECT doc_id, off, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM sized),
placed AS (SELECT doc_id, w, off + i AS g, (off + i) // {WINDOW} AS window_id FROM toks),
piece AS (SELECT window_id, doc_id, min(g) AS g, count(*) AS n, string_agg(w, ' ' ORDER BY g) AS t FROM placed GROUP BY ALL)
SELECT CAST(window_id AS BIGINT) AS window_id, CAST(sum(n) AS INTEGER) AS n_tokens, list(doc_id ORDER BY g) AS doc_ids,
       list(CAST(g % {WINDOW} AS INTEGER) ORDER BY g) AS starts, string_agg(t, ' ' ORDER BY g) AS text
FROM piece GROUP BY window_id"""
}
