import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lamina.llm import lines, packing, quality

from .conftest import SCHEMA, hard_rows, prose


def rejected(text, bands=quality.BANDS, chunk_band=quality.CHUNK_BAND):
    """The rules once more, written straight from their description."""
    data = (text or "").encode()
    if not data:
        return None
    ratio = lambda piece: len(zstandard.compress(piece, 3)) / len(piece)
    whole = ratio(data)
    for longest, least, most in bands:
        if len(data) <= longest:
            break
    if whole < least:
        return "repetitive"
    if whole > most:
        return "incompressible"
    if len(data) < 3072:
        return None
    pieces = []
    while data:
        size = 2048 if len(data) >= 3072 else len(data)
        pieces.append(ratio(data[:size]))
        data = data[size:]
    return "chunks" if sum(not chunk_band[0] <= x <= chunk_band[1] for x in pieces) > 0.1 * len(pieces) else None


def test_quality_matches_direct_compression(spark, hard):
    want = sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in hard_rows() if rejected(r[1]) is None)
    out = quality.filter_documents(hard)
    assert out.columns == hard.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in out.collect()) == want
    kept = {r.doc_id: r for r in quality.kept(hard).collect()}
    assert 9 not in kept and kept[2].whole_ratio is None and kept[4].n_bytes > 100_000


@pytest.mark.parametrize("labelled", [False, True])
def test_quality_of_a_corpus_matches_direct_compression(spark, labelled):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    bands, chunk_band = quality.limits(quality.judged(docs), labels if labelled else None)
    why = {r.doc_id: rejected(r.text, bands, chunk_band) for r in docs.collect()}
    got = {r.doc_id: r for r in quality.kept(docs, labels if labelled else None).collect()}
    assert set(got) == {i for i, w in why.items() if w is None} and 0 < len(got) < len(why)
    assert {r.doc_id for r in quality.filter_documents(docs, labels=labels if labelled else None).select("doc_id").collect()} == set(got)


def test_quality_compresses_once(spark, hard):
    plan = quality.filter_documents(hard)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_quality_limits_by_hand(spark):
    """Least ratio of a band's clean documents: the quantile of ratios, by numpy, less the margin."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    marks = {}
    for r in labels.collect():
        marks[r.doc_id] = min(marks.get(r.doc_id, 1), r.quality)
    ratios = {}
    for r in docs.collect():
        n = len((r.text or "").encode())
        if n and marks.get(r.doc_id) == 1:
            band = next(i for i, b in enumerate(quality.BANDS) if n <= b[0])
            ratios.setdefault(band, []).append(int(len(zstandard.compress(r.text.encode(), 3)) / n * 10_000) / 10_000)
    bands, _ = quality.limits(quality.judged(docs), labels)
    for i, (most, low, high) in enumerate(bands):
        enough = len(ratios.get(i, [])) >= quality.LEAST_CLEAN and most > quality.DERIVE_FROM
        want = max(quality.BANDS[i][1], np.quantile(ratios[i], quality.QUANTILE) * (1 - quality.MARGIN)) if enough else quality.BANDS[i][1]
        assert abs(low - want) < 1e-9 and (most, high) == (quality.BANDS[i][0], quality.BANDS[i][2])


def test_quality_rejects_noise_and_repetition(spark):
    r = random.Random(1)
    noise = lambda n: "".join(chr(r.randrange(33, 127)) for _ in range(n))
    texts = ["the same words again " * 300, noise(3000), "A short note about the garden, with nothing odd in it at all.", prose(r, 300) + noise(9000)]
    found = quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    why = {x.id: x.why for x in found.select("id", quality.reason(F.col("v")).alias("why")).collect()}
    assert why[0] == "repetitive" and why[1] == "incompressible" and why[2] is None and why[3] is not None


def test_quality_of_nothing(empty):
    assert quality.filter_documents(empty).count() == 0 and quality.kept(empty).count() == 0


def test_quality_limits_follow_clean_documents(spark):
    r = random.Random(3)
    # ratios of about 0.45: words of many letters that occur once or twice
    clean = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(n))
    part = lambda n, share: clean(int(n * (1 - share))) + " " + "buy now and save today " * int(n * share)
    rows = [(i, clean(r.choice([150, 300, 1200, 2500, 5000]))) for i in range(200)]
    rows += [(200 + i, part(n, share)) for i, (n, share) in enumerate((n, share) for n in (300, 1200, 2500, 5000) for share in (0.3, 0.5))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)] + [(i, 0, 0) for i in range(200, 208)] + [(207, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id for x in quality.filter_documents(docs, labels=labels).collect()}
    assert got == set(range(200)) == {x.doc_id for x in quality.kept(docs, labels).collect()}
    bands, chunk_band = quality.limits(quality.judged(docs), labels)
    assert all(b[0] == a[0] and b[1] >= a[1] and b[2] == a[2] for a, b in zip(quality.BANDS, bands)) and chunk_band[0] > quality.CHUNK_BAND[0]
    assert quality.limits(quality.judged(docs), labels.limit(0)) == (quality.BANDS, quality.CHUNK_BAND)


def brute_lines(rows):
    """First bearer by (id, text hash, place) keeps a line; here texts of one id are equal, so row order does."""
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), []
    for r in order:
        kept, had, left = [], False, False
        for x in r[1].split("\n"):
            t = x.strip(" ")
            if t == "":
                kept.append(x)
                continue
            had = True
            if t not in seen:
                seen.add(t)
                left = True
                kept.append(x)
        if left or not had:
            out.append((r[0], "\n".join(kept)))
    return sorted([(r[0], None) for r in rows if r[1] is None] + out, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (5, 3)])
def test_line_dedup_matches_brute_force(spark, hard, batches, fanout):
    out = lines.dedup_lines(hard, n_batches=batches, fanout=fanout, buckets=3)
    assert out.columns == hard.columns
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute_lines(hard_rows())
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)


def test_line_dedup_of_shared_passages(spark):
    r = random.Random(9)
    shared = [prose(r, 55) for _ in range(4)]
    rows = [(i, "\n".join([prose(r, 15), r.choice(shared), prose(r, 15)]), "en", "web", 0) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((x.doc_id, x.text) for x in lines.dedup_lines(df, 4, 2, 3).collect()), key=repr)
    assert got == brute_lines(rows)


def test_line_dedup_leaves_no_tables_and_handles_many_lines(spark):
    rows = [(i % 50, "\n".join(f"line {j} of {i % 3}" for j in range(20_000 if i % 50 == 0 else 40))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    unique = sorted({(i, t) for i, t in rows})
    got = sorted((x.doc_id, x.text) for x in lines.dedup_lines(df).collect())
    seen: set = set()
    for i, t in got:
        assert not seen & set(t.split("\n"))
        seen |= set(t.split("\n"))
    assert seen == {x for _, t in unique for x in t.split("\n")}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lamina_run")]


def test_line_dedup_of_nothing(empty):
    assert lines.dedup_lines(empty).count() == 0


def brute_pack(rows, window):
    order = sorted(((r[0], r[1]) for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))  # texts of one id are equal here
    flat = [(d, i, w) for i, (d, t) in enumerate(order) for w in t.encode().split()]
    out = []
    for at in range(0, len(flat), window):
        part = flat[at : at + window]
        firsts = [j for j in range(len(part)) if j == 0 or part[j][1] != part[j - 1][1]]
        out.append((at // window, len(part), [part[j][0] for j in firsts], firsts, b" ".join(w for *_, w in part).decode()))
    return out


@pytest.mark.parametrize("window,per", [(7, 1000), (64, 50), (100_000, 500), (1, 10_000)])
def test_packing_matches_brute_force(spark, hard, window, per):
    got = sorted((r.window_id, r.n_tokens, r.doc_ids, r.starts, r.text) for r in packing.pack(hard, window, per).collect())
    assert got == brute_pack(hard_rows(), window)


def test_packing_cuts_hot_ids(spark):
    r = random.Random(2)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, prose(r, 30) + f" {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    windows = packing.pack(docs, 50, 1000)
    by = {r.window_id: r for r in windows.collect()}
    assert sorted(by) == list(range(len(by))) and all(w.n_tokens == 50 for i, w in by.items() if i < len(by) - 1)
    # windows in order give back every text, ids in order and null first
    order = [(d, w.text.split()[a:z]) for i in sorted(by) for w in [by[i]] for d, a, z in zip(w.doc_ids, w.starts, [*w.starts[1:], w.n_tokens])]
    ids = [d for d, _ in order]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert sorted(w for _, part in order for w in part) == sorted(w for _, t in rows for w in t.split())
    shared = docs.select(F.coalesce("doc_id", F.lit(packing.NONE)).alias("id"), F.xxhash64("text").alias("th"), "text")
    counts = packing.counted(shared)
    total = counts.agg(F.sum("n")).first()[0]
    at = packing.ranges(counts, 20, total)
    parts = [x["n"] for x in counts.groupBy(packing.place(at).alias("b")).agg(F.sum("n").alias("n")).collect()]
    assert max(parts) < total / 20  # although two ids have a third each


def test_packing_places_like_tuples():
    r = random.Random(5)
    bounds = sorted({(r.randrange(5), r.choice([2**63 - 1, r.randrange(-9, 9)])) for _ in range(12)})
    rows = [(r.randrange(-1, 7), r.randrange(-12, 12)) for _ in range(500)]
    got = packing.placed(*(np.array(x, np.int64) for x in zip(*rows)), tuple(np.array(x, np.int64) for x in zip(*bounds)))
    assert got.tolist() == [sum(b < x for b in bounds) for x in rows]


def test_packing_of_nothing(spark, empty):
    assert packing.pack(empty).count() == 0
    assert packing.pack(spark.createDataFrame([(None, None), (1, ""), (2, "  ")], "doc_id long, text string")).count() == 0


def test_schema_has_clashing_names():
    assert "_sim_id" in SCHEMA
