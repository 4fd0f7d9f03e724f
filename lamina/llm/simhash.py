"""SimHash near-dedup over a segment-popcount embedding.

A document's features are its distinct words; each votes with the bits of its hash, and the majority gives a 256-bit
fingerprint. Near copies are documents whose fingerprints differ in at most ``RADIUS`` bits.

The join is exact: points are cut into slices by a hash, each two slices and each slice with itself are a task, and the
task compares all its pairs in tiles. The first half of the bits can't differ in more bits than the whole, so it rejects
all but about 1 % of the pairs without loss; the others are compared in full. This costs the square of the distinct
fingerprints; the README has the figures.

``exact=False`` is an approximate search for corpora too large for that. A fingerprint is embedded as its bit counts in
128 segments of two bits. Manhattan distance between embeddings never exceeds Hamming distance, so it rejects candidates
without loss. A grid over all 128 dimensions would have to probe more neighbours than there are documents at this
radius, so the range-join runs over sub-grids, the unit cells of a few dimensions, in two steps:

* coarse sub-grids, whose dimensions are as many as bring a cell to about ``CELL`` points: a point is sent once per
  coarse sub-grid, and this is all that is shuffled;
* within a coarse cell, in one task's memory, fine sub-grids of as many further dimensions as leave ``SHARED`` unrelated
  points beside each.

Both numbers of sub-grids follow from the chance that two fingerprints at exactly RADIUS bits share a cell, so that such
a pair is found with probability ``RECALL``; nearer pairs are found more surely. Dimensions grow with the logarithm of
the number of points, so unrelated points that meet grow with points times sub-grids, not with their square. Candidates
pass the Manhattan bound and then the exact distance. Cells have no cap: all pairs of a fine cell are compared, in
blocks; a coarse cell of more than ``LIMIT`` points is cut into slices, and each two slices are a task.

Equal fingerprints are merged before the join, so thousands of copies are one point. Points that are linked already
aren't linked again. Only a spanning set of links leaves a task; links are closed to groups by alternating star
contraction.

Defined results: null texts and texts without words have no fingerprint and belong to no group; rows with equal ids or
texts are points of one group like other copies; a null id is a row as any other and sorts first; extra columns, maps
and structs among them, pass through. The representative is the row that comes first by (doc_id, text hash).
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.mixing import slices
from lamina.llm.rows import one_of_each, own_key
from lamina.llm.textnp import mix, tokens
from lamina.runtime import cut, table

BITS, RADIUS = 256, 46
DIMS = BITS // 2
#: Chance that a pair at exactly RADIUS bits is found; and that one is within a coarse cell that it shares.
RECALL, INNER = 0.95, 0.9
#: Points of a coarse cell, about and at most; unrelated points in a fine cell; points that are simply compared.
CELL, LIMIT, SHARED, DIRECT = 1 << 15, 1 << 17, 4.0, 256
#: Dimensions of a coarse cell at least, so that there are cells enough for all tasks.
LEAST_DIMS = 3
#: Chance that unrelated fingerprints have equal counts in a segment, 3/8 for random bits and a little more for prose.
ALIKE = 0.4
#: Pairs that numpy compares at a time.
BLOCK = 1 << 18
#: Rows and columns of the tiles of all pairs, which fit a core's cache; points of a slice at least, where there are so many.
ROWS, COLUMNS, SLICE = 16, 4096, 2048
#: The bits of a byte, most significant first, as eight bytes.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def same_cell(radius: int) -> float:
    """Chance that two fingerprints at that distance have equal counts in a segment: no bit differs, or both, opposed."""
    d = radius / BITS
    return (1 - d) ** 2 + d * d / 2


def sub_grids(share: float, dims: int, radius: int, within: float = 1.0) -> int:
    """How many sub-grids of so many dimensions find a pair at the radius with chance ``share``, if each that the pair
    shares a cell of finds it with chance ``within``."""
    return max(1, math.ceil(math.log(1 - share) / math.log(1 - min(1 - 1e-12, within * same_cell(radius) ** dims))))


def coarse(n: int, radius: int = RADIUS, cell: int = CELL, recall: float = RECALL) -> np.ndarray:
    """(sub-grids, dimensions) of the segments that n points are cut by."""
    k = max(LEAST_DIMS, math.ceil(math.log(max(1.0, n / cell)) / -math.log(ALIKE)))
    return chosen(sub_grids(recall, k, radius, INNER), k, np.arange(DIMS), 5)


def fine(n: int, taken: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """(sub-grids, dimensions) for a coarse cell of n points, without the segments in which they are equal anyway."""
    k = max(1, round(math.log(max(1.0, n / SHARED)) / -math.log(ALIKE)))
    return chosen(sub_grids(INNER, k, radius), k, np.setdiff1d(np.arange(DIMS), taken), 6)


def chosen(tables: int, k: int, dims: np.ndarray, seed: int) -> np.ndarray:
    """Random segments for each sub-grid, spread evenly: each pass over all segments is cut into consecutive sub-grids."""
    rng, out, left = np.random.default_rng(seed), [], np.zeros(0, np.int64)
    while len(out) < tables:
        if len(left) < k:
            left = rng.permutation(dims)
        out.append(np.sort(left[:k]))
        left = left[k:]
    return np.stack(out)


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 32) bytes, and whether the row has any."""
    h, _, offsets = tokens(column, words_only=True)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    # 44 bits of the hash beside the row: distinct words of a slice
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    row, h = (key >> np.uint64(44)).astype(np.int64), mix(key & np.uint64((1 << 44) - 1))
    bounds = np.searchsorted(row, np.arange(n + 1))
    out, some = np.zeros((n, BITS // 8), np.uint8), np.diff(bounds) > 0
    if some.any():
        words = np.stack([h, *[mix(h + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) for i in range(1, BITS // 64)]], 1)
        # lanes: each byte of a hash becomes eight byte counters in one integer, good for runs of 255 words
        sizes = np.diff(bounds)[some]
        cuts = -(-sizes // 255)
        first = np.concatenate([[0], np.cumsum(cuts)[:-1]])
        runs = np.repeat(bounds[:-1][some], cuts) + 255 * (np.arange(cuts.sum()) - np.repeat(first, cuts))
        lanes = np.add.reduceat(LANES[np.ascontiguousarray(words).view(np.uint8)], runs, axis=0)
        votes = np.add.reduceat(lanes.view(np.uint8), first, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * votes > sizes[:, None], axis=1)
    return out, some


def pointed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) of every document that has words."""

    def run(batches):
        for b in batches:
            for start, length in slices(b.column(2), 1 << 20):
                part = b.slice(start, length)
                fp, some = fingerprints(part.column(2))
                part = part.filter(pa.array(some))
                fp = np.ascontiguousarray(fp[some])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(fp), [None, pa.py_buffer(fp)]).cast(pa.binary())], ["doc_id", "th", "fp"])

    source = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return source.mapInArrow(run, "doc_id long, th long, fp binary")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """(n, 128) counts of bits in segments of two."""
    b = np.unpackbits(fp, axis=1)
    return b[:, 0::2] + b[:, 1::2]


def unary(fp: np.ndarray) -> np.ndarray:
    """Counts of segments in unary, (n, 4) integers: the Manhattan distance of counts is the number of bits that differ."""
    odd = np.uint64(0x5555555555555555)
    high = (fp >> np.uint64(1)) & odd
    return ((fp | high) & odd) | ((fp & high & odd) << np.uint64(1))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ in (..., 4) integers."""
    c = np.bitwise_count(a ^ b).view(np.uint32)[..., 0]
    c = (c & np.uint32(0xFF00FF)) + ((c >> np.uint32(8)) & np.uint32(0xFF00FF))
    return (c + (c >> np.uint32(16))) & np.uint32(0xFFFF)


class Family:
    """Points of one coarse cell and the components that links have made of them so far."""

    def __init__(self, fp: np.ndarray, radius: int):
        self.fp, self.counts, self.radius = fp, unary(fp), radius
        self.root = np.arange(len(fp))
        self.compared = 0

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are within the radius: Manhattan bound first, then exactly."""
        self.compared += len(a)
        ok = np.flatnonzero(distance(self.counts.take(a, 0), self.counts.take(b, 0)) <= self.radius)
        return ok[distance(self.fp.take(a[ok], 0), self.fp.take(b[ok], 0)) <= self.radius]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of each pair; roots are the least of their components."""
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            up = np.arange(len(self.root))
            np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while True:
                top = up[up]
                if (top == up).all():
                    break
                up = top
            self.root = up[self.root]

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), BLOCK):
            x, y = a[at : at + BLOCK], b[at : at + BLOCK]
            apart = self.root[x] != self.root[y]
            x, y = x[apart], y[apart]
            if len(x):
                ok = self.near(x, y)
                if len(ok):
                    self.link(x[ok], y[ok])

    def all_pairs(self, points: np.ndarray) -> None:
        """Every pair of points that aren't linked: a few leaders take in dense families first, then blocks of rows."""
        for _ in range(8):
            roots = self.root[points]
            heads, first, size = np.unique(roots, return_index=True, return_counts=True)
            if len(heads) == 1:
                return
            lead = points[first[size.argmax()]]
            was = len(heads)
            self.compare(np.full(len(points), lead), points)
            if len(np.unique(self.root[points])) > was * 3 // 4:
                break
        step = max(1, BLOCK // len(points))
        for at in range(0, len(points), step):
            i, j = np.triu_indices(min(step, len(points) - at), 1, len(points) - at)
            self.compare(points[at + i], points[at + j])

    def every(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every pair of a point of ``a`` and one of ``b``, exactly; if both are the same points, each pair once."""
        same, half, most = a is b, BITS // 64 // 2, np.uint8(min(self.radius, 254))
        rows, columns = self.fp[a], np.ascontiguousarray(self.fp[b].T)
        xor, more = np.empty((ROWS, COLUMNS), np.uint64), np.empty((ROWS, COLUMNS), np.uint8)
        near = np.full((ROWS, -(-len(b) // 8) * 8), 255, np.uint8)  # so that flags can be looked through by eights
        for i in range(0, len(a), ROWS):
            r = rows[i : i + ROWS]
            at = i if same else 0
            for j in range(at, len(b), COLUMNS):
                w = min(COLUMNS, len(b) - j)
                bits, part, sums = xor[: len(r), :w], more[: len(r), :w], near[: len(r), j : j + w]
                for word in range(half):
                    np.bitwise_xor(r[:, word, None], columns[word, j : j + w], out=bits)
                    np.bitwise_count(bits, out=part if word else sums)
                    if word:
                        np.add(sums, part, out=sums)
            self.compared += len(r) * (len(b) - at)
            flags = near[: len(r), at:] <= most
            some = np.flatnonzero(flags.reshape(-1).view(np.uint64))
            which, lane = np.nonzero(flags.reshape(-1, 8)[some])
            p, q = np.divmod(some[which] * 8 + lane, near.shape[1] - at)
            p, q = p + i, q + at
            if same:
                once = p < q
                p, q = p[once], q[once]
            p, q = a[p], b[q]
            apart = self.root[p] != self.root[q]
            p, q = p[apart], q[apart]
            if len(p):
                ok = distance(self.fp.take(p, 0), self.fp.take(q, 0)) <= self.radius
                if ok.any():
                    self.link(p[ok], q[ok])

    def search(self, taken: np.ndarray) -> None:
        n = len(self.fp)
        if n <= DIRECT:
            i, j = np.triu_indices(n, 1)
            self.compare(i, j)
            return
        counts = np.ascontiguousarray(popcounts(np.ascontiguousarray(self.fp).view(np.uint8).reshape(n, -1)).T)
        bits = np.int64(n.bit_length())
        for dims in fine(n, taken, self.radius):
            key = counts[dims[0]].astype(np.int64)
            for d in dims[1:]:
                key *= 3
                key += counts[d]
            key = np.sort((key << bits) | np.arange(n))
            point, key = key & ((1 << bits) - 1), key >> bits
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(starts, append=n)
            several = sizes > 1
            starts, sizes = starts[several], sizes[several]
            roots = self.root[point]
            # cells whose points are one component have nothing to find
            change = np.cumsum(np.append(False, roots[1:] != roots[:-1]))
            mixed = change[starts + sizes - 1] != change[starts]
            starts, sizes = starts[mixed], sizes[mixed]
            for s, size in zip(starts[sizes > DIRECT], sizes[sizes > DIRECT]):
                self.all_pairs(point[s : s + size])
            starts, sizes = starts[sizes <= DIRECT], sizes[sizes <= DIRECT]
            if not len(sizes):
                continue
            at = np.repeat(starts, sizes)
            at += np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # every place of these cells
            left = np.repeat(starts + sizes, sizes) - at - 1  # places after it in its cell
            off, held, a, b = 1, 0, [], []
            while len(at):
                at, left = at[left >= off], left[left >= off]
                a.append(point[at])
                b.append(point[at + off])
                off, held = off + 1, held + len(at)
                if held >= BLOCK or not len(at):
                    self.compare(np.concatenate(a), np.concatenate(b))
                    held, a, b = 0, [], []


def packed(column: pa.Array) -> np.ndarray:
    """Fingerprints of a binary column, (n, 4) integers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def cells_of(fp: np.ndarray, dims: np.ndarray):
    """For each coarse sub-grid the cell of each point."""
    counts = popcounts(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1))
    power = np.array([3**i for i in range(dims.shape[1])], np.int64)
    for t, d in enumerate(dims):
        yield counts[:, d].astype(np.int64) @ power + t * 3 ** dims.shape[1]


def slice_of(ids: np.ndarray, g: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(g)).astype(np.int64)


def tasks_of(batches):
    """(key, ids, fingerprints) of each run of rows (*key, id, fp) that agree in their key, ordered by id."""

    def whole(key, pieces):
        ids, fp = np.concatenate([x for x, _ in pieces]), np.concatenate([x for _, x in pieces])
        order = np.argsort(ids)  # the least id leads
        return key, ids[order], fp[order]

    now, pieces = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([c.to_numpy() for c in b.columns[:-2]], 1)
        ids, fp = b.column(b.num_columns - 2).to_numpy(), packed(b.column(b.num_columns - 1))
        at = 0
        for end in np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(ids)):
            key = tuple(keys[at].tolist())
            if key != now:
                if pieces:
                    yield whole(now, pieces)
                now, pieces = key, []
            pieces.append((ids[at:end], fp[at:end]))
            at = end
    if pieces:
        yield whole(now, pieces)


def spanning(ids: np.ndarray, family: Family) -> pa.RecordBatch:
    led = np.flatnonzero(family.root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[family.root[led]]), pa.array(ids[led])], ["a", "b"])


def links(points: DataFrame, n: int, parts: int, radius: int = RADIUS, cell: int = CELL, limit: int = LIMIT, exact: bool = True) -> DataFrame:
    """(a, b), a < b: links that span the components of ``n`` points (id, fp) within each task; all tasks together see
    every pair, unless ``exact`` is off."""
    if not exact:
        return grid_links(points, n, parts, radius, cell, limit)
    # tasks enough for all partitions, slices of at most about ``limit`` points
    g = max(1, min(math.ceil(2 * math.sqrt(parts)), n // SLICE), -(-n // limit))

    def scatter(batches):
        for b in batches:
            mine = slice_of(b.column(0).to_numpy(), g)
            for other in range(g):
                lo, hi = np.minimum(mine, other), np.maximum(mine, other)
                yield pa.RecordBatch.from_arrays([pa.array(hi * (hi + 1) // 2 + lo), b.column(0), b.column(1)], ["task", "id", "fp"])

    def gather(batches):
        for (task,), ids, fp in tasks_of(batches):
            hi = (math.isqrt(8 * task + 1) - 1) // 2
            lo, mine, family = task - hi * (hi + 1) // 2, slice_of(ids, g), Family(fp, radius)
            a = np.flatnonzero(mine == lo)
            family.every(a, a if lo == hi else np.flatnonzero(mine == hi))
            yield spanning(ids, family)

    spread = points.select("id", "fp").mapInArrow(scatter, "task long, id long, fp binary")
    return spread.repartition(max(parts, g * (g + 1) // 2), "task").sortWithinPartitions("task").mapInArrow(gather, "a long, b long").distinct()


def grid_links(points: DataFrame, n: int, parts: int, radius: int = RADIUS, cell: int = CELL, limit: int = LIMIT) -> DataFrame:
    """Links of the approximate search, within each coarse cell."""
    dims = coarse(n, radius, cell)
    each = 3 ** dims.shape[1]
    points = points.select("id", "fp")
    hot: dict[int, int] = {}
    if n > limit:  # else no cell can hold more

        def tally(batches):
            for b in batches:
                for key in cells_of(packed(b.column(1)), dims):
                    k, m = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m)], ["cell", "n"])

        full = points.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
        hot = {r["cell"]: -(-r["n"] // (limit // 2)) for r in full.collect()}  # at most points x sub-grids / limit of them

    def scatter(batches):
        keys = np.array(sorted(hot), np.int64)
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                ids = part.column(0).to_numpy()
                for key in cells_of(packed(part.column(1)), dims):
                    cold = ~np.isin(key, keys)
                    if cold.any():
                        mask = pa.array(cold)
                        yield pa.RecordBatch.from_arrays([pa.array(key[cold]), pa.array(np.zeros(int(cold.sum()), np.int64)), part.column(0).filter(mask), part.column(1).filter(mask)], ["cell", "task", "id", "fp"])
                    for c in np.unique(key[~cold]):
                        g, here = hot[int(c)], np.flatnonzero(key == c)
                        mine = slice_of(ids[here], g)
                        for other in range(g):
                            ok = mine != other
                            lo, hi = np.minimum(mine[ok], other), np.maximum(mine[ok], other)
                            at = pa.array(here[ok])
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c)), pa.array(lo * g + hi), part.column(0).take(at), part.column(1).take(at)], ["cell", "task", "id", "fp"])

    def gather(batches):
        for (key, _), ids, fp in tasks_of(batches):
            if len(ids) > 1:
                family = Family(fp, radius)
                family.search(dims[key // each])
                yield spanning(ids, family)

    spread = points.mapInArrow(scatter, "cell long, task long, id long, fp binary")
    return spread.repartition(parts, "cell", "task").sortWithinPartitions("cell", "task").mapInArrow(gather, "a long, b long").distinct()


def least(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) with the least b of its a; hubs are aggregated before they move, and joins of hubs are split."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(links: DataFrame) -> DataFrame:
    """(id, root): least id of each id's component, by alternating large and small stars."""
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        # small star: neighbours that are smaller, and the node itself, go to the least of them
        small = least(large)
        new = cut(small.select("b", "m").union(small.select(F.col("a").alias("b"), "m")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # stable: no node has two parents and no parent has a parent
        worst = new.groupBy("a").count().where("count > 1").limit(1).count() or new.join(new.select(F.col("a").alias("p")).distinct(), F.col("b") == F.col("p"), "left_semi").limit(1).count()
        edges = new
        if not worst:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def groups(docs: DataFrame, radius: int = RADIUS, parts: int | None = None, cell: int = CELL, limit: int = LIMIT, exact: bool = True) -> DataFrame:
    """(doc_id, th, group_id, n_links, first) of each document that has a near or exact copy.

    group_id is the id of the group's representative, ``first`` whether the row has its id and text; n_links counts the
    documents that the row is linked with, directly or by others: all of its group but itself.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(pointed(docs))
    points = cut(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("g"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    joined = components(links(points, points.count(), parts, radius, cell, limit, exact))
    point = points.join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    whole = point.groupBy("root").agg(F.min("g").alias("g"), F.sum("n").alias("size")).where("size > 1")
    out = rows.join(point.select("fp", "root").join(whole, "root"), "fp")
    first = F.col("doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("th") == F.col("g.th"))
    return out.select("doc_id", "th", F.col("g.doc_id").alias("group_id"), (F.col("size") - 1).alias("n_links"), first.alias("first"))


def own_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n, blanks, line) of each distinct line with content of a document: how many there are, how many lines
    are blank, and a hash of the id and the line."""
    split = F.split("text", "\n", -1)
    full = F.filter(split, lambda x: F.trim(x) != "")
    out = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), (F.size(split) - F.size(full)).alias("blanks"), F.array_distinct(full).alias("full"))
    return out.select("doc_id", "th", F.size("full").alias("n"), "blanks", F.explode("full").alias("line")).withColumn("line", F.xxhash64("doc_id", "line")).distinct()


def earlier(docs: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """(doc_id, th, fp): documents with the fingerprint of the row of ``before`` that line dedup cut them from; ``now``
    has those of their own texts.

    A row of equal id and text is a document's own; else it is one that has the id, all lines with content and as many
    blank ones, of several the first by text hash, to which line dedup left the lines. A line of a document that was cut
    is no other document's, so each line of ``before`` is met once, however often an id repeats.
    """
    keys = [own_key("doc_id", "th").alias("key"), "th"]
    known = before.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th")).select(*keys).distinct()
    same = now.withColumn("key", keys[0]).join(known, ["key", "th"], "left_semi").select("doc_id", "th", "fp")
    lines = own_lines(docs).withColumn("key", keys[0]).join(known, ["key", "th"], "left_anti")
    had = own_lines(before).select("line", F.col("blanks").alias("had"), F.col("th").alias("was"))
    met = lines.join(had, "line").where("blanks = had").groupBy("doc_id", "th", "n", "was").count().where("count = n")
    fp = pointed(before).select(keys[0], F.col("th").alias("was"), "fp")
    found = met.withColumn("key", own_key("doc_id", "was")).join(fp, ["key", "was"]).groupBy("doc_id", "th").agg(F.min_by("fp", "was").alias("fp"))
    return same.unionByName(found)


def groups_of_both(docs: DataFrame, before: DataFrame, radius: int = RADIUS, parts: int | None = None, cell: int = CELL, limit: int = LIMIT) -> DataFrame:
    """(doc_id, th, first) of each document that has a copy by its text or by its text before lines were taken from it.

    Texts of one time are compared with each other only: two documents are linked if their fingerprints are within the
    radius either now or in ``before``.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = cut(pointed(docs).distinct())
    rows = cut(now.withColumn("old", F.lit(False)).unionByName(earlier(docs, now, before).withColumn("old", F.lit(True))))
    points = cut(rows.select("old", "fp").distinct().withColumn("id", F.monotonically_increasing_id()))
    # a document has one or two points, which are linked as they are one document
    own = cut(rows.join(points, ["old", "fp"]).groupBy("doc_id", "th").agg(F.min("id").alias("a"), F.max("id").alias("b")))
    edges = own.select("a", "b")
    for old in (False, True):
        these = points.where(F.col("old") == old)
        edges = edges.unionByName(links(these, these.count(), parts, radius, cell, limit))
    root = own.join(components(edges).withColumnRenamed("id", "a"), "a", "left").select("doc_id", "th", F.coalesce("root", "a").alias("root"))
    whole = root.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("g"), F.count("*").alias("size")).where("size > 1")
    first = F.col("doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("th") == F.col("g.th"))
    return root.join(whole, "root").select("doc_id", "th", first.alias("first"))


def drop_copies(docs: DataFrame, before: DataFrame | None = None, **options) -> DataFrame:
    """One document of each group, and all others; their own columns. ``before``: (doc_id, text) of the documents before
    lines were taken from them, so that copies whose shared lines were taken are found too."""
    mark = uuid.uuid4().hex[:8]  # columns of the documents may have any name
    th, key = f"_th{mark}", f"_key{mark}"
    found = groups(docs, **options) if before is None else groups_of_both(docs, before, **options)
    gone = found.where("NOT first").select(F.col("th").alias(th), own_key("doc_id", "th").alias(key)).distinct()
    single = one_of_each(docs, F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    keyed = single.withColumn(th, F.xxhash64("text")).withColumn(key, own_key("doc_id", th))
    return keyed.join(gone, [th, key], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "n_links")


QUERIES = {"op6_simhash_neardup": op6_simhash_neardup}
ORACLES: dict[str, str] = {}
