import random
import time

import numpy as np
import pyarrow as pa

from lamina.llm import simhash

from .conftest import hard_rows, prose


def family(r, n, edits):
    base = prose(r, n).split()
    w = list(base)
    for _ in range(edits):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(9999))
    return " ".join(base), " ".join(w)


def brute(fp, radius):
    x = np.ascontiguousarray(fp).view(np.uint64)
    return {(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x).sum(1) <= radius) if i < j}


def at_distance(r, base, bits):
    """Copies of fingerprints with exactly so many bits changed."""
    out = base.copy()
    for row in out:
        for q in r.choice(simhash.BITS, bits, replace=False):
            row[q // 64] ^= np.uint64(1) << np.uint64(q % 64)
    return out


def roots(spark, fp, **options):
    """Root of each fingerprint by the distributed search."""
    points = spark.createDataFrame([(i, bytes(x)) for i, x in enumerate(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1))], "id long, fp binary")
    found = {x.id: x.root for x in simhash.components(simhash.links(points, len(fp), 4, **options)).collect()}
    return [found.get(i, i) for i in range(len(fp))]


def test_recall_by_distance_without_equal_fingerprints(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**64, (3000, 4), dtype=np.uint64)
    copies = np.concatenate([at_distance(r, base[i * 600 : (i + 1) * 600], d) for i, d in enumerate((8, 24, 36, 42, simhash.RADIUS))])
    got = roots(spark, np.concatenate([base, copies]), cell=200, limit=1 << 17)
    hit = np.array([got[i] == got[3000 + i] for i in range(3000)]).reshape(5, 600).mean(1)
    assert (hit[:3] > 0.97).all() and (hit >= 0.93).all(), hit
    assert len(set(got)) == 6000 - int((hit * 600).round().sum())  # nothing else is linked


def test_texts_against_brute_force(spark):
    r = random.Random(8)
    texts = []
    for _ in range(400):
        texts += family(r, r.choice([40, 80, 200, 600]), r.choice([1, 3, 6, 10]))
    fp, some = simhash.fingerprints(pa.array(texts))
    assert some.all()
    pairs = brute(fp, simhash.RADIUS)
    got, want = roots(spark, fp, cell=100), components(len(fp), pairs)
    assert len(pairs) > 300
    found = sum(got[i] == got[j] for i, j in pairs)
    assert found >= 0.97 * len(pairs)
    assert all(want[i] == want[x] for i, x in enumerate(got))


def test_short_words_are_features():
    a, b, c = simhash.fingerprints(pa.array(["to be or not to be it is so we go on", "to be or not to be it is so we go by", "an ox at my hut if he is up do us no"]))[0].view(np.uint64)
    assert np.bitwise_count(a ^ b).sum() < np.bitwise_count(a ^ c).sum()


def test_slices_of_a_hot_cell_lose_nothing(spark):
    r = np.random.default_rng(3)
    seed = r.integers(0, 2**64, (1, 4), dtype=np.uint64)
    close = np.concatenate([seed] + [at_distance(r, seed, d) for d in range(1, 24) for _ in range(12)])
    fp = np.unique(np.concatenate([close, r.integers(0, 2**64, (300, 4), dtype=np.uint64)]), axis=0)
    want = components(len(fp), brute(fp.view(np.uint8).reshape(len(fp), -1), simhash.RADIUS))
    assert roots(spark, fp, cell=100, limit=60) == want


def test_comparisons_follow_the_points():
    """Unrelated points: pairs compared grow by less than points to the power 1.45, and far below all pairs."""
    r, compared = np.random.default_rng(4), []
    for n in (20_000, 100_000):
        fp = r.integers(0, 2**64, (n, 4), dtype=np.uint64)
        dims = simhash.coarse(n)
        key = next(iter(simhash.cells_of(fp, dims)))
        total = 0
        for c in np.unique(key):
            f = simhash.Family(fp[key == c], simhash.RADIUS)
            f.search(dims[0])
            total += f.compared
        compared.append(total * len(dims))
    assert np.log(compared[1] / compared[0]) / np.log(5) < 1.45
    assert compared[1] < 100_000**2 / 2 / 50


def test_large_cells_equal_pairwise():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, (6, 4), dtype=np.uint64)
    rows = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, (200, 4), dtype=np.uint64)) for b in base])
    f = simhash.Family(rows, 10)
    f.all_pairs(np.arange(len(rows)))
    assert list(f.root) == components(len(rows), brute(rows.view(np.uint8).reshape(len(rows), -1), 10))
    alone = simhash.Family(rng.integers(0, 2**64, (5000, 4), dtype=np.uint64), simhash.RADIUS)
    began = time.time()
    alone.all_pairs(np.arange(5000))
    assert alone.compared >= 5000 * 4999 // 2 and time.time() - began < 10


def test_manhattan_never_exceeds_hamming():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, (500, 4), dtype=np.uint64)
    b = a ^ np.where(rng.random((500, 4)) < 0.5, np.uint64(1) << rng.integers(0, 64, (500, 4), dtype=np.uint64), np.uint64(0))
    for x, y in ((a, b), (a, a[::-1].copy()), (a, ~a)):
        ham = np.bitwise_count(x ^ y).sum(1)
        one, two = (simhash.popcounts(np.ascontiguousarray(z).view(np.uint8).reshape(len(z), -1)).astype(int) for z in (x, y))
        low = np.abs(one - two).sum(1)
        assert (low <= ham).all() and (simhash.distance(simhash.unary(x), simhash.unary(y)) == low).all() and (simhash.distance(x, y) == ham).all()
        for radius in (3, 46, 130):
            assert set(simhash.Family(np.concatenate([x, y]), radius).near(np.arange(500), np.arange(500, 1000))) == set(np.flatnonzero(ham <= radius))


def components(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    r = random.Random(0)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    got = {x.id: x.root for x in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(400, pairs)
    assert all(got.get(i, i) == want[i] for i in range(400))


def test_copies_leave_one_and_clean_documents_stay(spark):
    r = random.Random(3)
    texts = [prose(r, 120) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[0]) for i in range(30)]
    w = texts[1].split()
    w[5] = "changed"
    rows.append((200, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.drop_copies(df).collect()) == list(range(60))


def test_hard_rows(hard, empty):
    out = simhash.drop_copies(hard)
    assert out.columns == hard.columns
    ids = sorted((x.doc_id for x in out.collect()), key=repr)
    want = [r[0] for r in hard_rows()]
    want.remove(5)
    want.remove(6)
    assert ids == sorted(want, key=repr)
    got = sorted((x.doc_id, x.group_id, x.n_links) for x in simhash.groups(hard).collect())
    assert got == [(5, 5, 2), (5, 5, 2), (6, 5, 2)]
    assert simhash.drop_copies(empty).count() == 0 and simhash.groups(empty).count() == 0


def test_no_pair_at_the_radius_is_missed(spark):
    """Fingerprints at exactly RADIUS bits: the search in cells loses some of them, the exact one none, in slices or not."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2**64, (1500, 4), dtype=np.uint64)
    fp = np.concatenate([base, at_distance(r, base[:1000], simhash.RADIUS), at_distance(r, base[1000:], simhash.RADIUS + 1)])
    want = components(len(fp), brute(fp, simhash.RADIUS))
    assert sum(want[i] == want[1500 + i] for i in range(1500)) == 1000
    for limit in (1 << 17, 350):
        assert roots(spark, fp, cell=200, limit=limit) == want
    few = roots(spark, fp, cell=200, exact=False)
    assert 930 <= sum(few[i] == few[1500 + i] for i in range(1000)) < 1000 and few[2500:] == want[2500:]


def test_every_pair_of_any_number_of_points():
    r = np.random.default_rng(6)
    for n in (0, 1, 2, 7, 16, 17, 130, 4100):
        for radius in (0, 20, 46, 130, 256):
            if n == 4100 and radius != 46:
                continue
            base = r.integers(0, 2**64, (max(1, n // 3), 4), dtype=np.uint64)
            fp = np.concatenate([base, at_distance(r, base, min(radius, 46)), r.integers(0, 2**64, (n, 4), dtype=np.uint64)])[:n]
            want, f = components(n, brute(fp, radius)), simhash.Family(fp, radius)
            f.every(np.arange(n), np.arange(n))
            g, a, b = simhash.Family(fp, radius), np.arange(0, n, 2), np.arange(1, n, 2)
            g.every(a, a), g.every(b, b), g.every(a, b)
            assert list(f.root) == want == list(g.root), (n, radius)
            h = simhash.Family(fp, radius)
            whole = np.arange(n)
            h.every(whole, whole)
            assert list(h.root) == want, (n, radius)


def test_groups_of_texts_equal_brute_force(spark):
    """Every document's class, as all pairs give it, however many slices the points are cut into."""
    r, texts = random.Random(12), []
    for _ in range(250):
        texts += family(r, r.choice([30, 40, 80, 200]), r.choice([1, 3, 5, 6, 8, 10]))
    fp, _ = simhash.fingerprints(pa.array(texts))
    want = components(len(fp), brute(fp, simhash.RADIUS))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"limit": 60}):
        got = {x.doc_id: (x.group_id, x.n_links) for x in simhash.groups(docs, **options).collect()}
        assert got == {i: (w, want.count(w) - 1) for i, w in enumerate(want) if want.count(w) > 1}
