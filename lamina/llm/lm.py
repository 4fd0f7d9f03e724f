"""Scores of documents under a hashed maximum-entropy language model trained on the corpus itself.

A token's probability is factored: its class given the history, then the word within the class. Both are log-linear in
hashed features of the history: the token before, the two before as an n-gram, and the token two back as a skip (the
class); the token before with the class, and the class alone (the word). Words are classed by frequency rank, counted
over the whole corpus; words past the classed ones share a last class of hashed slots. Within such a slot every word has
its own probability, n / (N + 1), from its count n and the slot's N over the whole corpus; what is left, 1 / (N + 1), is
for words that the corpus doesn't have. Counts of the ``KNOWN`` most frequent words travel to the workers, those of all
others stay in a distributed table that documents' remaining words are joined to, so no word is without its count.

The tables of weights have a power of two of rows, ``ROWS`` times the root of the corpus's number of tokens at least.

Slices are dealt to the rounds by partition and place, so the weights depend a little on how the input is split; scores
of one model don't.

Training is one epoch in ``ROUNDS`` synchronised parts: in each, every partition takes gradient steps on its slices
of text, starting from the shared weights, and sends the rows of weights that it touched; rows are averaged by how often
each was used, streamed by block of rows, so what moves grows with the corpus and memory doesn't. Every document's
gradient is used once. Scoring gathers weight rows for batches of tokens in numpy.

Defined results: null and empty texts have no tokens and null scores; repeated rows and null ids are rows like others;
an empty table gives no rows; other columns play no part. Long texts are scored whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.mixing import slices
from lamina.llm.textnp import mix, tokens
from lamina.runtime import cut, table

CLASSES, SLOTS = 32, 32
#: Rows of the tables of class and word weights, as powers of two, at least; and per root of the number of tokens.
CLASS_BITS, WORD_BITS = 14, 14
ROWS = 2
#: Words whose counts travel to the workers; the others' are joined.
KNOWN = 1 << 18
ROUNDS, BATCH, RATE, CLIP = 2, 4096, 0.25, 12.0
#: Weight of slots and classes without a word, and the least of any weight: no probability leaks to them.
NEVER = -30.0
#: Rows of weights that travel together, and bytes of a slice of text.
BLOCK, SLICE = 1024, 1 << 20
#: Parts at least in which a block is averaged first.
FAN = 4
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Model:
    """Vocabulary and weights. ``types`` counts the distinct words that are not in the vocabulary.

    known, known_n: sorted hashes and counts of frequent words; slot_n: occurrences in each slot of the last class;
    rest: (h, n) of words that occur more than once and are not known, or None.
    """

    def __init__(self, vocabulary: list[int], types: int, known: dict[int, int] | None = None, slot_n: np.ndarray | None = None, total: int = 0, rest: DataFrame | None = None):
        order = np.argsort(np.array(vocabulary, np.uint64))
        self.words = np.array(vocabulary, np.uint64)[order]
        self.rank = order.astype(np.int32)
        self.spread = float(np.log(max(1.0, types / SLOTS)))
        known = known or {}
        self.known = np.array(sorted(known), np.uint64)
        self.known_n = np.array([known[h] for h in sorted(known)], np.float64)
        self.slot_n = np.zeros(SLOTS) if slot_n is None else slot_n
        self.rest = rest
        grown = int(np.ceil(np.log2(max(1.0, ROWS * total**0.5))))
        self.class_bits, self.word_bits = max(CLASS_BITS, grown), max(WORD_BITS, grown)
        self.cw = np.zeros((1 << self.class_bits, CLASSES), np.float32)
        self.ww = np.zeros((1 << self.word_bits, SLOTS), np.float32)
        self.wb = np.zeros((CLASSES, SLOTS), np.float32)
        self.wb[:-1][np.arange((CLASSES - 1) * SLOTS).reshape(-1, SLOTS) >= len(vocabulary)] = NEVER
        self.dead = np.where(np.arange(CLASSES) * SLOTS >= len(vocabulary), NEVER, 0).astype(np.float32)  # classes without a word
        self.dead[-1] = 0
        self.squares = [np.full(len(x), 1.0, np.float32) for x in (self.cw, self.ww, self.wb)]

    def tables(self) -> list[np.ndarray]:
        return [self.cw, self.ww, self.wb]

    def state(self) -> dict:
        """Plain arrays, which travel to workers that don't have this package."""
        return {k: v for k, v in self.__dict__.items() if k != "rest"}

    @classmethod
    def of(cls, state: dict) -> Model:
        """Model of a state, with weights of its own."""
        model = cls.__new__(cls)
        model.__dict__ |= {k: [x.copy() for x in v] if k == "squares" else v.copy() if k in ("cw", "ww", "wb") else v for k, v in state.items()}
        return model

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Class x SLOTS + slot of each word."""
        other = (CLASSES - 1) * SLOTS + (h >> np.uint64(40)).astype(np.int32) % SLOTS
        if not len(self.words):
            return other
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.rank[at], other)

    def examples(self, h: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Rows of the class table, rows of the word table, and ids, by token."""
        back = []
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for i in (1, 2):
            p = np.zeros(len(h), np.uint64)
            p[i:] = np.where(doc[i:] == doc[:-i], h[:-i], np.uint64(0))
            back.append(p)
        a, b = back[0] * ODD[0], back[1] * ODD[1]
        top = np.uint64(64 - self.class_bits)
        rows = [(mix(x) >> top).astype(np.int64) for x in (a + ODD[3], a ^ b, b + ODD[3])]
        ids = self.ids(h)
        k = (ids // SLOTS).astype(np.uint64) * ODD[3]
        top = np.uint64(64 - self.word_bits)
        inner = [(mix(x) >> top).astype(np.int64) for x in (a + k,)]
        return rows, inner, ids

    def counted(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each token's own count adds to ``step``, which spreads slots of the last class evenly; and which tokens
        need a count from ``rest``, whose logarithm is still to be added."""
        last = np.flatnonzero(ids // SLOTS == CLASSES - 1)
        own, asked, n = np.zeros(len(h)), np.zeros(len(h), bool), np.ones(len(last))
        asked[last] = True
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h[last]), len(self.known) - 1)
            found = self.known[at] == h[last]
            n = np.where(found, self.known_n[at], 1.0)
            asked[last[found]] = False
        own[last] = self.spread + np.log(n) - np.log(self.slot_n[ids[last] % SLOTS] + 1)
        return own, asked

    def chunks(self, rows: list[np.ndarray], inner: list[np.ndarray], ids: np.ndarray, size: int):
        for at in range(0, len(ids), size):
            yield [r[at : at + size] for r in rows], [r[at : at + size] for r in inner], ids[at : at + size]

    def step(self, rows: list[np.ndarray], inner: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities by token, and the class and word distributions. Weights are clipped, so exp can't overflow."""
        k = ids // SLOTS
        z = self.cw.take(rows[0], 0)
        for r in rows[1:]:
            z += self.cw.take(r, 0)
        z += self.dead
        y = self.wb.take(k, 0)
        for r in inner:
            y += self.ww.take(r, 0)
        out = np.where(k == CLASSES - 1, np.float32(-self.spread), np.float32(0))
        for m, at in ((z, k), (y, ids % SLOTS)):
            out += m.ravel().take(np.arange(len(ids)) * m.shape[1] + at)
            np.exp(m, out=m)
            total = m @ np.ones(m.shape[1], np.float32)
            out -= np.log(total)
            m *= (1 / total)[:, None]
        return out, z, y

    def learn(self, rows: list[np.ndarray], inner: list[np.ndarray], ids: np.ndarray, used: list[np.ndarray]) -> None:
        """One gradient step over a batch, scaled by row as in AdaGrad; used counts the tokens behind each row."""
        _, z, y = self.step(rows, inner, ids)
        n, k = np.arange(len(ids)), ids // SLOTS
        z[n, k] -= 1
        y[n, ids % SLOTS] -= 1
        for t, (w, ats, g) in enumerate(((self.cw, rows, z), (self.ww, inner, y), (self.wb, [k], y))):
            for at in ats:
                if len(w) <= 1 << 16:
                    key = at.astype(np.uint16)  # sorts by radix
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                else:  # row and place in one integer sort faster than places by row
                    key = np.sort(at << 32 | n)
                    order, key = key & 0xFFFFFFFF, key >> 32
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                row, count = key[starts], np.diff(starts, append=len(key))
                grad = np.add.reduceat(g.take(order, 0), starts, axis=0)
                self.squares[t][row] += (grad**2).mean(1)
                w[row] = np.clip(w[row] - (RATE / np.sqrt(self.squares[t][row]))[:, None] * grad, NEVER, CLIP)
                used[t][row] += count


def packed(used: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Counts of a block and its rows that were used, compressed."""
    return pa.array([zlib.compress(used.tobytes() + rows[used > 0].tobytes(), 1)], pa.binary())


def vocabulary(docs: DataFrame) -> Model:
    """Model without weights: words counted over all documents."""

    def count(batches):
        for b in batches:
            for start, length in slices(b.column(0), 4 * SLICE):
                h, n = np.unique(tokens(b.column(0).slice(start, length))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    words = cut(docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    most = (CLASSES - 1) * SLOTS
    slot = F.shiftrightunsigned("h", 40) % SLOTS
    slots = words.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    top = words.orderBy(F.desc("n"), "h").limit(max(most, KNOWN)).toArrow()
    known = list(zip(top["h"].to_numpy().view(np.uint64).tolist(), top["n"].to_pylist()))
    types, total, slot_n = sum(r["types"] for r in slots), sum(r["n"] for r in slots), np.zeros(SLOTS)
    for r in slots:
        slot_n[r["slot"]] = r["n"]
    for h, n in known[:most]:
        slot_n[(h >> 40) % SLOTS] -= n
    # words as frequent as the last known one may be among the known or not; a join of known words finds nothing to add
    rest = words.where((F.col("n") > 1) & (F.col("n") <= known[-1][1])) if types > len(known) else None
    return Model([h for h, _ in known[:most]], types - min(most, len(known)), dict(known), slot_n, total, rest)


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    docs = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    spark, model = docs.sparkSession, vocabulary(docs)
    sizes = [len(t) for t in model.tables()]
    firsts = np.cumsum([0] + [-(-n // BLOCK) for n in sizes])
    blocks, wide = int(firsts[-1]), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fan = max(FAN, wide // blocks)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model.state())

        def learn(batches, r=r, shared=shared):
            m = Model.of(shared.value)
            used = [np.zeros(n, np.float32) for n in sizes]
            turn = TaskContext.get().partitionId()
            for b in batches:
                for start, length in slices(b.column(0), SLICE):
                    turn += 1
                    if turn % rounds != r:
                        continue  # this slice's gradient belongs to another part of the epoch
                    rows, inner, ids = m.examples(*[x for i, x in enumerate(tokens(b.column(0).slice(start, length))) if i != 1])
                    for part in m.chunks(rows, inner, ids, BATCH):
                        m.learn(*part, used)
            for t, w in enumerate(m.tables()):
                for i, at in enumerate(range(0, len(w), BLOCK)):
                    u = used[t][at : at + BLOCK]
                    if u.any():
                        body = np.hstack([w[at : at + BLOCK], m.squares[t][at : at + BLOCK, None]]).astype(np.float32)
                        yield pa.RecordBatch.from_arrays([pa.array([int(firsts[t]) + i]), pa.array([TaskContext.get().partitionId() % fan]), packed(u, body)], ["block", "salt", "body"])

        def merge(batches):
            sums: dict[int, list] = {}
            for b in batches:
                for key, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                    t = int(np.searchsorted(firsts, key, side="right") - 1)
                    n = min(BLOCK, sizes[t] - (key - int(firsts[t])) * BLOCK)
                    raw = zlib.decompress(body)
                    u = np.frombuffer(raw, np.float32, n)
                    w = np.frombuffer(raw, np.float32, -1, 4 * n).reshape((u > 0).sum(), -1)
                    if key not in sums:
                        sums[key] = [np.zeros(n), np.zeros((n, w.shape[1]))]
                    sums[key][0] += u
                    sums[key][1][u > 0] += u[u > 0, None] * w
            for key, (u, w) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([0]), packed(u.astype(np.float32), (w / np.maximum(u, 1)[:, None]).astype(np.float32))], ["block", "salt", "body"])

        # two levels: what all partitions send for a block is averaged in ``fan`` parts first
        kind, sent = "block long, salt long, body binary", docs.mapInArrow(learn, "block long, salt long, body binary")
        for keys, n in ((["block", "salt"], min(wide, blocks * fan)), (["block"], blocks)):
            sent = sent.repartition(max(1, min(n, wide)), *keys).mapInArrow(merge, kind)
        for key, _, body in sent.collect():
            t = int(np.searchsorted(firsts, key, side="right") - 1)
            at = (key - int(firsts[t])) * BLOCK
            n = min(BLOCK, sizes[t] - at)
            raw = zlib.decompress(body)
            u = np.frombuffer(raw, np.float32, n) > 0
            mean = np.frombuffer(raw, np.float32, -1, 4 * n).reshape(u.sum(), -1)
            model.tables()[t][at : at + n][u] = mean[:, :-1]
            model.squares[t][at : at + n][u] = mean[:, -1]
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, logprob, bits_per_token) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    joined = model.rest is not None

    def run(batches):
        m = Model.of(shared.value)
        for b in batches:
            for start, length in slices(b.column(1), SLICE):
                part = b.slice(start, length)
                h, _, offsets = tokens(part.column(1))
                rows, inner, ids = m.examples(h, offsets)
                own, asked = m.counted(h, ids)
                each = [m.step(*x)[0] for x in m.chunks(rows, inner, ids, 4096)]
                total = np.concatenate([[0.0], np.cumsum(np.concatenate(each) + own, dtype=np.float64)]) if each else np.zeros(1)
                n = np.diff(offsets)
                sums = total[offsets[1:]] - total[offsets[:-1]]
                before = np.concatenate([[0], np.cumsum(asked & joined)])[offsets]
                rest = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(h[asked & joined].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(sums, mask=n == 0), rest], ["doc_id", "n_tokens", "logprob", "rest"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, logprob double, rest array<long>")
    if joined:
        out = cut(out.withColumn("row", F.monotonically_increasing_id()))
        asked = out.select("row", F.explode("rest").alias("h")).join(model.rest, "h")
        out = out.drop("rest").join(asked.groupBy("row").agg(F.sum(F.log(F.col("n").cast("double"))).alias("more")), "row", "left")
        out = out.withColumn("logprob", F.col("logprob") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "logprob", (-F.col("logprob") / F.greatest(F.col("n_tokens"), F.lit(1)) / F.lit(float(np.log(2)))).alias("bits_per_token"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs))


QUERIES = {"op3_lm_scores": op3_lm_scores}
ORACLES: dict[str, str] = {}
