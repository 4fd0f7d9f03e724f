"""The pipeline's stages on awkward documents, and its windows against brute force over the stages before."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import mixing, packing, simhash

from .conftest import hard_rows, prose
from .test_quality_lines_packing import brute_lines, brute_pack
from .test_simhash import brute, components

TABLES = "/root/testdata/sf0.001"


def staged(spark, docs, tmp_path):
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{i}"
        stage(spark, out[-1], TABLES).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "mixing to target weights", "packing"]


def test_every_stage_on_hard_rows(spark, hard, tmp_path):
    _, kept, lines, single, mixed, windows = staged(spark, hard, tmp_path)
    assert all(x.columns == hard.columns for x in (kept, lines, single, mixed))
    assert 9 not in {r.doc_id for r in kept.collect()}
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=repr) == brute_lines([r for r in hard_rows() if r[0] != 9])
    assert sorted(x.doc_id for x in single.collect() if x.doc_id in (5, 6)) == [5]
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    assert {r[0] for r in rows} <= {r.doc_id for r in single.collect()}
    got = sorted((r.window_id, r.n_tokens, r.doc_ids, r.starts, r.text) for r in windows.collect())
    assert got == brute_pack(rows, packing.WINDOW)


@pytest.mark.parametrize("upto", range(5))
def test_stages_of_nothing(spark, empty, upto):
    name, stage = corpus_pipeline.STAGES[upto]
    out = stage(spark, empty, TABLES)
    assert out.count() == 0 and (upto == 4 or out.columns == empty.columns)


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    *_, mixed, windows = staged(spark, docs, tmp_path)
    want = sorted((r.window_id, r.n_tokens, r.doc_ids, r.starts, r.text) for r in windows.collect())
    assert want == sorted((r.window_id, r.n_tokens, r.doc_ids, r.starts, r.text) for r in corpus_pipeline.run(spark, TABLES).collect())
    assert want == brute_pack([(r.doc_id, r.text) for r in mixed.collect()], packing.WINDOW)


def test_near_dedup_stage_against_brute_force(spark):
    """Every group of brute force leaves one document at least, and almost none leaves more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fp, some = simhash.fingerprints(pa.array([t for _, t in rows]))
    at = np.flatnonzero(some)
    pairs = brute(np.ascontiguousarray(fp[at]), simhash.RADIUS)
    root = components(len(at), pairs)
    least: dict = {}
    for i, r in zip(at, root):
        least[r] = min(least.get(r, 1 << 62), rows[i][0])
    want = set(least.values()) | {rows[i][0] for i in np.flatnonzero(~some)}
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, TABLES).select("doc_id").collect()}
    assert want <= got and len(want) < len(rows) and len(got - want) <= 0.02 * (len(rows) - len(want))


def test_mixing_stage_against_brute_force(spark):
    """Copies by rates that plain numpy solves, and the draw by hash."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias, known = mixing.classifier(docs, labels)
    members = mixing.memberships(docs, weights, bias).collect()
    p, n = np.array([[r.p0, r.p1, r.p2] for r in members]), np.array([r.n for r in members], float)
    want = np.where(known, mixing.TARGETS, 0) / np.where(known, mixing.TARGETS, 0).sum()
    have = n @ p / n.sum()
    goal = np.minimum(want * have[want.argmax()] / want.max(), mixing.REPEATS * have)
    inverse, rate = np.linalg.pinv((p * n[:, None]).T @ p / n.sum(), rcond=1e-9), np.ones(len(n))
    for _ in range(mixing.ITERATIONS):
        off = (rate * n) @ p / n.sum() - goal
        if np.abs(off).max() < 1e-6 * have[want.argmax()] / want.max():
            break
        rate = np.maximum(0, rate - p @ (inverse @ off))
    rate = np.where(n > 0, rate, 1)
    draws = {r.doc_id: r.d for r in docs.select("doc_id", ((F.pmod(F.xxhash64(F.lit(11), F.xxhash64("doc_id", "text")), F.lit(1 << 30)) + 0.5) / float(1 << 30)).alias("d")).collect()}
    sure = {r.doc_id: int(x) + (draws[r.doc_id] < x - int(x)) for r, x in zip(members, rate) if abs(draws[r.doc_id] - (x - int(x))) > 1e-6}
    got = Counter(r.doc_id for r in corpus_pipeline.mix(spark, docs, TABLES).select("doc_id").collect())
    assert len(sure) > 0.95 * len(members) and all(got.get(i, 0) == c for i, c in sure.items())


def test_near_dedup_stage_misses_no_pair_at_the_edge(spark, tmp_path):
    """Copies edited up to and beyond the radius, after line dedup: of each group of brute force exactly the first stays."""
    r, rows = random.Random(21), []
    for i in range(2500):
        words = prose(r, 60).split()
        rows.append((2 * i, " ".join(words)))
        for at in r.sample(range(len(words)), r.randrange(5, 9)):
            words[at] = f"edit{r.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(words)))
    docs = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), TABLES)
    docs.write.parquet(f"file://{tmp_path}/lines")
    docs = spark.read.parquet(f"file://{tmp_path}/lines")
    left = sorted((x.doc_id, x.text) for x in docs.collect())
    fp, some = simhash.fingerprints(pa.array([t for _, t in left]))
    pairs = brute(np.ascontiguousarray(fp), simhash.RADIUS)
    x = fp.view(np.uint64)
    assert some.all() and sum(int(np.bitwise_count(x[i] ^ x[j]).sum()) > simhash.RADIUS - 6 for i, j in pairs) > 200
    want = [left[i][0] for i in sorted(set(components(len(left), pairs)))]
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, TABLES).collect()) == want


def test_near_dedup_stage_knows_copies_whose_shared_lines_are_gone(spark, tmp_path):
    """Line dedup takes the lines that copies share; still exactly the first of each group stays, by pairs within the
    radius of what is left or of the texts in the table: null and repeated ids, blank lines, rests without words."""
    r, rows = random.Random(22), []
    for i in range(300):
        lines = [prose(r, 8) for _ in range(9)]
        rows.append((2 * i, "\n".join([*lines[:4], "", *lines[4:]])))
        for at in r.sample(range(9), r.randrange(1, 7)):
            words = lines[at].split()
            words[r.randrange(8)] = f"edit{r.randrange(10**6)}"
            lines[at] = " ".join(words)
        rows.append((2 * i + 1, "\n".join(lines)))
    other = [prose(r, 8) for _ in range(9)]
    rows += [(3, "\n".join(other)), (3, "\n".join(other)), (700, "\n".join([*other, "-- ! --"])), (701, "\n".join([*other[:8], other[8] + " more"]))]
    rows += [(None, rows[0][1] + "\nthe last"), (None, "\n".join(prose(r, 8) for _ in range(9)))]
    home = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{home}/documents.parquet")
    corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{home}/documents.parquet"), home).write.parquet(f"{home}/lines")
    docs = spark.read.parquet(f"{home}/lines")
    left = [(x.doc_id, x.text) for x in docs.withColumn("th", F.xxhash64("text")).orderBy("doc_id", "th").collect()]
    was = [next(t for j, t in rows if j == i and set(text.split("\n")) <= set(t.split("\n"))) for i, text in left]
    pairs = []
    for texts in ([t for _, t in left], was):
        fp, some = simhash.fingerprints(pa.array(texts))
        at = np.flatnonzero(some)
        pairs.append({(at[i], at[j]) for i, j in brute(np.ascontiguousarray(fp[at]), simhash.RADIUS)})
    assert len(pairs[1] - pairs[0]) > 100 and (700, "-- ! --") in left and len({i for i, _ in left}) < len(left)
    want = [left[i] for i in sorted(set(components(len(left), pairs[0] | pairs[1])))]
    got = corpus_pipeline.near_dedup(spark, docs, home)
    assert got.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == sorted(want, key=repr)


def test_near_dedup_stage_takes_no_other_row_for_the_earlier_text(spark, tmp_path):
    """Rows of the table with a document's id but not its lines, or with other blank lines, say nothing of it."""
    r = random.Random(23)
    texts, copy = ["\n".join(prose(r, 8) for _ in range(6)) for _ in range(4)], "\n".join(prose(r, 8) for _ in range(40))
    spark.createDataFrame([(0, copy), (1, copy), (2, copy + "\n\n" + texts[2]), (3, copy + "\n" + texts[3])], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, f"file://{tmp_path}").collect()) == [0, 1, 2, 3]
