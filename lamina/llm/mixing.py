"""Mixing sources to target weights by soft membership.

A softmax classifier over hashed token presence, fitted on labelled documents (``labels``: quality, toxic), gives each
document a posterior over the domains good, poor and toxic. Each document then gets a nonnegative rate such that the
expected tokens by domain, sum of rate x tokens x posterior, match target weights. Rates come from distributed
projected-gradient least squares: each iteration is one aggregation of K sums over (tokens, posterior) rows; a
document's rate is replayed from the K-vectors of all iterations, so no state is stored. Steps are taken in the metric
of the K x K token-weighted second moment of the posteriors, in which the unclipped problem has condition number 1.

The budget is the supply of the domain with the largest target: its documents keep a rate of about 1, domains with too
much text shrink, and scarce ones are repeated, ``REPEATS`` times their tokens at most; a target beyond that stays unmet
and takes nothing from the other domains. A document is emitted floor(rate) times and once more with the
remaining probability, drawn from a hash of its id and text: the same rows give the same result anywhere.

Only the classifier sees a sample: at most ``MAX_LABELLED`` labelled documents, chosen by hash of their id (parameter).
Defined results: null and empty texts have no tokens, get the prior as posterior and rate 1 (they don't touch the sums);
null ids and repeated rows are documents like others; labels with nulls or without a document are ignored, repeated
labels count as often as they occur; a domain without labels has no target, and the others' are scaled up; where no
feature tells labelled domains apart, all posteriors are the prior, and rates are 1. Ids are numbers; other columns of any name
and type pass through. Targets that the iterations don't reach are logged with the shares reached.
"""

from __future__ import annotations

import logging
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.textnp import tokens
from lamina.runtime import cut, small, table

DOMAINS = ("good", "poor", "toxic")
#: Weights of the domains in the mixed corpus.
TARGETS = (0.96, 0.03, 0.01)
#: A domain's tokens are repeated so often at most. More would tilt the rates of clean documents by slight posteriors.
REPEATS = 16.0
MAX_LABELLED = 8000
BITS = 17
ITERATIONS = 16
#: Likelihood-ratio statistic (G) against the domains that a feature needs: with it words that mark a domain aren't
#: outvoted by hundreds of ordinary ones in a long document.
LEAST_G = 16.0
#: Bytes of text that numpy works on at a time.
SLICE = 2 << 20


def slices(column: pa.Array, most: int = SLICE):
    """Consecutive (start, length) of a text column with about ``most`` bytes each."""
    sizes = np.array([0 if n is None else n for n in pc.binary_length(column).to_pylist()], np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes) - start


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed tokens: bucket ids, n + 1 offsets by row; and the number of tokens by row."""
    h, _, offsets = tokens(column)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    key = np.unique((row << bits) | (h >> np.uint64(64 - bits)).astype(np.int64))
    return (key & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(key >> bits, np.arange(len(n) + 1)), n


def posterior(weights: np.ndarray, bias: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = np.diff(offsets)
    total = np.zeros((len(n), weights.shape[1]))
    some = n > 0
    if some.any():
        total[some] = np.add.reduceat(weights[ids], offsets[:-1][some], axis=0)
    z = total + bias
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def marks(rows: list[tuple[np.ndarray, int]], k: int, bits: int = BITS) -> np.ndarray:
    """G statistic of each feature's presence against the domains."""
    seen, size = np.zeros((k, 1 << bits)), np.zeros(k)
    for x, y in rows:
        seen[y][x] += 1
        size[y] += 1
    every, n = seen.sum(0), max(1.0, size.sum())
    g = np.zeros(1 << bits)
    for y in range(k):
        for o, e in ((seen[y], every * size[y] / n), (size[y] - seen[y], (n - every) * size[y] / n)):
            g += 2 * np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)
    return g


def fit(rows: list[tuple[np.ndarray, int]], k: int, bits: int = BITS, epochs: int = 12, rate: float = 0.15, decay: float = 1e-4, seed: int = 7, least_g: float = LEAST_G) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the softmax classifier by AdaGrad over minibatches; features below ``least_g`` have no weight."""
    weights, bias = np.zeros((1 << bits, k)), np.zeros(k)
    if not rows:
        return weights.astype(np.float32), bias
    good = marks(rows, k, bits) >= least_g
    rows = [(x[good[x]], y) for x, y in rows]
    counts = np.bincount([y for _, y in rows], minlength=k) + 0.5
    bias = np.log(counts / counts.sum())
    squares, rng = np.full_like(weights, 1e-2), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 32):
            part = [rows[i] for i in order[at : at + 32]]
            ids = np.concatenate([x for x, _ in part])
            sizes = np.array([len(x) for x, _ in part])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            g = posterior(weights, bias, ids, offsets)
            g[np.arange(len(part)), [y for _, y in part]] -= 1
            if not len(ids):
                continue
            each = np.repeat(g, sizes, axis=0)
            uniq, where = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(where, each[:, j], len(uniq)) for j in range(k)], 1) + decay * weights[uniq]
            squares[uniq] += grad**2
            weights[uniq] -= rate * grad / np.sqrt(squares[uniq])
    return np.where(good[:, None], weights, 0).astype(np.float32), bias


def classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, bias, and which domains any labelled document has."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    mark = uuid.uuid4().hex[:8]  # columns of the documents may have any name
    id_, y = f"_id{mark}", f"_y{mark}"
    chosen = labels.select(F.col("doc_id").alias(id_), domain.alias(y)).where(F.col(id_).isNotNull() & F.col(y).isNotNull())
    chosen = small(chosen.orderBy(F.xxhash64(id_), id_, y).limit(max_labelled), max_labelled)
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, F.col("doc_id") == F.col(id_)).select(y, "text")

    def run(batches):
        for b in batches:
            for start, length in slices(b.column(1)):
                part = b.slice(start, length)
                ids, offsets, _ = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array([ids[a:z].tobytes() for a, z in zip(offsets, offsets[1:])], pa.binary())], ["y", "f"])

    # an id may repeat in the documents: the bound holds for what the driver gets
    taken = found.mapInArrow(run, "y int, f binary").orderBy(F.xxhash64("f", "y"), "f", "y").limit(max_labelled)
    rows = sorted((bytes(r["f"]), r["y"]) for r in taken.collect())
    known = np.isin(np.arange(len(DOMAINS)), [y for _, y in rows])
    return *fit([(np.frombuffer(f, np.int32), y) for f, y in rows], len(DOMAINS)), known


def member(spark: SparkSession, weights: np.ndarray, bias: np.ndarray, text: str = "text"):
    """Column (n, p0, ...) of a text column: tokens and posteriors."""
    shared, k = spark.sparkContext.broadcast((weights, bias)), len(bias)
    kind = "struct<n:bigint," + ",".join(f"p{i}:double" for i in range(k)) + ">"

    def of(column: pa.Array) -> pa.Array:
        w, c = shared.value
        parts = [pa.StructArray.from_arrays([pa.array([], pa.int64()), *[pa.array([], pa.float64())] * k], ["n", *[f"p{i}" for i in range(k)]])]
        for start, length in slices(column):
            ids, offsets, n = features(column.slice(start, length))
            p = posterior(w, c, ids, offsets)
            parts.append(pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), *[pa.array(p[:, i]) for i in range(k)]], ["n", *[f"p{i}" for i in range(k)]]))
        return pa.concat_arrays(parts)

    of.__annotations__ = {"column": pa.Array, "return": pa.Array}
    # as if it weren't deterministic, so that filters above it don't run it a second time
    return F.arrow_udf(of, kind).asNondeterministic()(F.col(text).cast("string"))


def memberships(docs: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(doc_id, key, n, p0, ...) of every document; key is a hash of id and text."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_draw().alias("key"), member(docs.sparkSession, weights, bias).alias("m"))
    return found.select("doc_id", "key", "m.*")


def own_draw():
    """Hash of id and text."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def solve(members: DataFrame, targets=TARGETS, iterations: int = ITERATIONS):
    """Rates by columns of (n, posteriors), and the domains' token shares (target, reached)."""
    k = len(targets)
    p, n = [F.col(f"p{i}") for i in range(k)], F.col("n").cast("double")
    first = members.agg(F.sum(n).alias("n"), *[F.sum(n * p[i] * p[j]).alias(f"m{i}{j}") for i in range(k) for j in range(i, k)], *[F.sum(n * p[i]).alias(f"x{i}") for i in range(k)]).first()
    total = first["n"] or 0.0
    if not total:
        return lambda n, p: F.lit(1.0), None, None
    have = np.array([first[f"x{i}"] for i in range(k)]) / total
    moment = np.array([[first[f"m{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    want = np.array(targets, float)
    main = int(want.argmax())
    budget = have[main] / want[main]
    goal = np.minimum(want * budget, REPEATS * have)
    inverse = np.linalg.pinv(moment, rcond=1e-9)
    pulls: list[list[float]] = []

    def rate(p):
        if not pulls:
            return F.lit(1.0)
        steps = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in pulls])
        return F.aggregate(steps, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - sum((p[i] * g[i] for i in range(1, k)), p[0] * g[0])))

    now = have
    for _ in range(iterations):
        if np.abs(now - goal).max() < 1e-6 * budget:
            break
        pulls.append(list(inverse @ (now - goal)))
        r = rate(p)
        sums = members.agg(*[F.sum(r * n * p[i]).alias(f"x{i}") for i in range(k)]).first()
        now = np.array(list(sums)) / total
    if np.abs(now - goal).max() > 1e-3 * budget:
        logging.getLogger(__name__).warning("after %d iterations the domains have shares %s of the tokens, not %s", len(pulls), now.round(4).tolist(), goal.round(4).tolist())
    return lambda n, p: F.when(n > 0, rate(p)).otherwise(F.lit(1.0)), goal, now


def planned(docs: DataFrame, labels: DataFrame, targets=TARGETS, max_labelled: int = MAX_LABELLED):
    """The narrow table of memberships, the classifier, and rates by columns of (n, posteriors)."""
    weights, bias, known = classifier(docs, labels, max_labelled)
    members = cut(memberships(docs, weights, bias))
    targets = np.where(known, targets, 0) / max(1e-12, np.where(known, targets, 0).sum())
    if not weights.any():  # equal posteriors tell nothing apart
        return members, weights, bias, lambda n, p: F.lit(1.0)
    return members, weights, bias, solve(members, targets)[0]


def copies(rate, key):
    """How often a document is emitted, by its rate and a hash."""
    draw = (F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets=TARGETS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, key, n, p0, ..., rate, copies) of every document."""
    members, _, bias, rate = planned(docs, labels, targets, max_labelled)
    out = members.withColumn("rate", rate(F.col("n"), [F.col(f"p{i}") for i in range(len(bias))]))
    return out.withColumn("copies", copies(F.col("rate"), F.col("key")))


def mix_documents(docs: DataFrame, labels: DataFrame, targets=TARGETS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Documents as often as their rates ask for, with their own columns. Documents aren't moved: each is judged where it is."""
    _, weights, bias, rate = planned(docs, labels, targets, max_labelled)
    mark = uuid.uuid4().hex[:8]  # columns of the documents may have any name
    m, r, i = (f"_{x}{mark}" for x in ("m", "r", "i"))
    judged = docs.withColumn(m, member(docs.sparkSession, weights, bias))
    judged = judged.withColumn(r, rate(F.col(f"{m}.n"), [F.col(f"{m}.p{j}") for j in range(len(bias))])).withColumn(r, copies(F.col(r), own_draw()))
    often = F.when(F.col(r) > 0, F.sequence(F.lit(1), F.col(r))).otherwise(F.array().cast("array<int>"))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(often).alias(i)).drop(i)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("n").alias("n_tokens"), *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies")


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
