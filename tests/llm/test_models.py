import random

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import lm, mixing, pii
from lamina.llm.textnp import tokens

from .conftest import hard_rows, prose


def labelled(spark, n=240):
    r = random.Random(6)
    kinds = {0: "calm clear precise careful measured", 1: "click buy cheap offer winner", 2: "vile rotten hateful nasty cruel"}
    docs, labels = [], []
    for i in range(n):
        y = 0 if i % 10 < 6 else 1 if i % 10 < 9 else 2
        words = [r.choice(kinds[y].split()) if r.random() < 0.3 else w for w in prose(r, 60).split()]
        docs.append((i, " ".join(words)))
        labels.append((i, int(y == 0), int(y == 2)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_mixing_meets_targets_and_brute_force(spark):
    docs, labels, truth = labelled(spark)
    rows = mixing.mixed(docs, labels.where("doc_id div 10 % 2 = 0"), (0.8, 0.15, 0.05)).collect()
    p, n, rate = np.array([[x.p0, x.p1, x.p2] for x in rows]), np.array([x.n for x in rows], float), np.array([x.rate for x in rows])
    share = (rate * n) @ p
    assert np.abs(share / share.sum() - [0.8, 0.15, 0.05]).max() < 0.01 and rate.min() >= 0
    held = [x for x in rows if x.doc_id // 10 % 2]
    right = sum(int(np.argmax([x.p0, x.p1, x.p2])) == (2 if truth[x.doc_id][2] else 0 if truth[x.doc_id][1] else 1) for x in held)
    assert right >= 0.9 * len(held)
    have = n @ p / n.sum()
    goal = np.array([0.8, 0.15, 0.05]) * min(have / [0.8, 0.15, 0.05])
    inverse, want = np.linalg.pinv((p * n[:, None]).T @ p / n.sum(), rcond=1e-9), np.ones(len(n))
    for _ in range(mixing.ITERATIONS):
        off = (want * n) @ p / n.sum() - goal
        if np.abs(off).max() < 1e-6 * min(have / [0.8, 0.15, 0.05]):
            break
        want = np.maximum(0, want - p @ (inverse @ off))
    assert np.allclose(want, rate, atol=1e-4)


def test_mixing_repeats_scarce_domains_and_keeps_clean_documents(spark):
    r = random.Random(8)
    marks = {0: "calm clear precise careful measured", 1: "click buy cheap offer winner", 2: "vile rotten hateful nasty cruel"}
    kind = [2] * 4 + [1] * 20 + [0] * 3976
    docs = spark.createDataFrame([(i, " ".join(r.choice(marks[y].split()) if r.random() < 0.4 else w for w in prose(r, 40).split())) for i, y in enumerate(kind)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y == 0), int(y == 2)) for i, y in enumerate(kind)], "doc_id long, quality int, toxic int")
    rows = mixing.mixed(docs, labels).collect()
    p, n, rate = np.array([[x.p0, x.p1, x.p2] for x in rows]), np.array([x.n for x in rows], float), np.array([x.rate for x in rows])
    share = (rate * n) @ p
    assert np.abs(share / share.sum() - mixing.TARGETS).max() < 0.005
    clean = [x for x in rows if kind[x.doc_id] == 0]
    assert sum(x.copies > 0 for x in clean) > 0.97 * len(clean)
    assert np.mean([x.copies for x in rows if kind[x.doc_id] == 2]) > 5 and np.mean([x.copies for x in rows if kind[x.doc_id] == 1]) > 3


def test_mixing_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(4, 1, 0), (10, 0, None), (8, 0, 0), (9, 1, 1), (None, 1, 0), (777, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix_documents(hard, labels)
    assert out.columns == hard.columns
    rows = mixing.mixed(hard, labels).collect()
    assert len(rows) == len(hard_rows()) and all(x.rate >= 0 and x.copies >= 0 for x in rows)
    assert all(x.rate == 1 and x.copies == 1 for x in rows if x.n == 0)
    assert out.count() == sum(x.copies for x in rows)
    assert mixing.mix_documents(hard, labels.limit(0)).count() == len(hard_rows())
    assert mixing.mix_documents(empty, labels).count() == 0


def test_mixing_is_repeatable(spark):
    docs, labels, _ = labelled(spark, 100)
    a = sorted(x.doc_id for x in mixing.mix_documents(docs, labels).collect())
    assert a == sorted(x.doc_id for x in mixing.mix_documents(docs.repartition(7), labels.repartition(5)).collect())


@pytest.fixture(scope="session")
def language(spark):
    r = random.Random(1)
    follow = {w: r.sample(["sea", "sky", "sand", "salt", "sun", "song"], 2) for w in ["sea", "sky", "sand", "salt", "sun", "song"]}

    def text(n):
        out = ["sea"]
        while len(out) < n:
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text(300)) for i in range(400)], "doc_id long, text string").repartition(3)
    return lm.train(docs), text


def test_language_model_learns_the_order(spark, language):
    model, text = language
    held = spark.createDataFrame([(i, text(400)) for i in range(20)] + [(100 + i, " ".join(random.Random(i).choices(["sea", "sky", "sand", "salt", "sun", "song"], k=400))) for i in range(20)], "doc_id long, text string")
    bits = {x.doc_id: x.bits_per_token for x in lm.scored(held, model).collect()}
    good, bad = [bits[i] for i in range(20)], [bits[100 + i] for i in range(20)]
    assert max(good) < min(bad) and np.mean(good) < 1.3 < np.log2(6) < np.mean(bad)


def test_language_model_matches_a_slow_loop(language):
    model, text = language
    column = pa.array([text(30), "sea unseen sky", ""])
    h, _, offsets = tokens(column)
    rows, inner, ids = model.examples(h, offsets)
    fast = model.step([x.copy() for x in rows], [x.copy() for x in inner], ids)[0]
    for i in range(len(ids)):
        z = sum(model.cw[x[i]].astype(float) for x in rows) + model.dead
        k = ids[i] // lm.SLOTS
        y = model.wb[k].astype(float) + sum(model.ww[x[i]] for x in inner)
        slow = z[k] - np.log(np.exp(z).sum()) + y[ids[i] % lm.SLOTS] - np.log(np.exp(y).sum()) - (model.spread if k == lm.CLASSES - 1 else 0)
        assert abs(slow - fast[i]) < 1e-3


def test_language_model_counts_every_word(spark, monkeypatch):
    r = random.Random(9)
    words = [f"w{i}x" for i in range(6000)]
    texts = [" ".join(r.choices(words, [1 / (i + 3) for i in range(6000)], k=300)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    n = {}
    for t in texts:
        for w in t.split():
            n[w] = n.get(w, 0) + 1
    hashes = dict(zip(n, tokens(pa.array([" ".join(n)]))[0].tolist()))
    probe = ["zzunheardof", *sorted(n, key=lambda w: (n[w], w))[:: len(n) // 40], *texts[:20]]
    asked = spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string")
    got = []
    for known in (1, 1 << 18):  # most counts are joined; all are at hand
        monkeypatch.setattr(lm, "KNOWN", known)
        model = lm.vocabulary(docs)
        assert (model.rest is None) == (known > 1) and len(n) > 3 * len(model.words)
        got.append({x.doc_id: x.logprob for x in lm.scored(asked, model).collect()})
    assert len(got[0]) == len(probe) and all(abs(got[0][i] - got[1][i]) < 1e-6 * max(1, abs(got[0][i])) for i in got[0])
    classed, slots = set(model.words.tolist()), np.zeros(lm.SLOTS)
    for w in n:
        if hashes[w] not in classed:
            slots[(hashes[w] >> 40) % lm.SLOTS] += n[w]
    assert (slots == model.slot_n).all()
    for i, w in enumerate(probe[:40]):  # without weights all classes and all slots of a class are alike
        h = tokens(pa.array([w]))[0]
        if int(h[0]) not in classed:
            want = -np.log(lm.CLASSES * lm.SLOTS) + np.log(n.get(w, 1)) - np.log(slots[(int(h[0]) >> 40) % lm.SLOTS] + 1)
            assert abs(got[0][i] - want) < 1e-4


def test_language_model_tables_grow_with_the_corpus():
    small, large = lm.Model([], 0, total=10**6), lm.Model([], 0, total=10**10)
    assert len(small.cw) == len(small.ww) == 1 << 14 and len(large.cw) == len(large.ww) == 1 << 18
    r = np.random.default_rng(1)  # both ways of sorting rows learn the same
    h = r.integers(0, 50, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    part = large.examples(h, np.array([0, 3000]))
    used = [np.zeros(len(t), np.float32) for t in large.tables()]
    before = large.step(*part)[0].mean()
    for _ in range(20):
        large.learn(*part, used)
    assert large.step(*part)[0].mean() > before and all(u.sum() % 3000 == 0 and u.sum() > 0 for u in used)


def test_language_model_sums_to_one_over_all_words(spark):
    """After training with fewer words than slots and with more: over every word of the corpus and those it lacks."""
    for n, total in ((40, 200), (3000, 60)):
        r = random.Random(n)
        words = [f"w{i}q" for i in range(n)]
        texts = [" ".join(r.choices(words, [1 / (i + 2) for i in range(n)], k=300)) for _ in range(total)]
        model = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))
        seen = sorted({w for t in texts for w in t.split()})
        for before in ("w0q w1q", "w5q unheard", ""):
            column = pa.array([f"{before} {w}" for w in seen])
            h, _, offsets = tokens(column)
            rows, inner, ids = model.examples(h, offsets)
            own, asked = model.counted(h, ids)
            last = offsets[1:] - 1
            assert not asked[last].any()
            p, z, y = model.step(rows, inner, ids)
            mass = np.exp((p + own)[last].astype(np.float64)).sum()
            # what is left: 1 / (N + 1) of each slot of the last class, N being the slot's occurrences
            one = model.examples(*(lambda t: (t[0], t[2]))(tokens(pa.array([f"{before} zzunheard"]))))
            zz = np.sum([model.cw[x[-1]] for x in one[0]], axis=0, dtype=np.float64) + model.dead
            k = lm.CLASSES - 1
            yy = model.wb[k].astype(np.float64) + model.ww[one[1][0][-1]]
            slots = np.exp(yy) / np.exp(yy).sum() * np.exp(zz[k]) / np.exp(zz).sum()
            left = (slots / (model.slot_n + 1)).sum()
            assert abs(mass + left - 1) < 1e-4, (n, before, mass, left)


def test_language_model_training_matches_a_plain_loop(spark, monkeypatch):
    """One round over one partition, against a loop over tokens with the gradient written out by class and slot."""
    monkeypatch.setattr(lm, "BATCH", 64)
    r = random.Random(3)
    texts = [" ".join(r.choice(["red", "green", "blue", "grey", "pink"]) for _ in range(50)) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got, start = lm.train(docs, rounds=1), lm.vocabulary(docs)
    hashes = {w: int(h) for w, h in zip(sorted({w for t in texts for w in t.split()}), tokens(pa.array([" ".join(sorted({w for t in texts for w in t.split()}))]))[0])}
    order = {int(h): int(k) for h, k in zip(start.words, start.rank)}
    m64 = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m64
        return x ^ (x >> 31)

    odd = [int(x) for x in lm.ODD]
    cw, ww, wb = (t.astype(float) for t in start.tables())
    squares = [np.ones(len(t)) for t in (cw, ww, wb)]
    flat = []
    for t in texts:
        back = [0, 0]
        for w in t.split():
            h, (a, b) = hashes[w], back
            a, b = a * odd[0] & m64, b * odd[1] & m64
            rows = [mixed(x) >> (64 - start.class_bits) for x in ((a + odd[3]) & m64, a ^ b, (b + odd[3]) & m64)]
            k, slot = divmod(order[h], lm.SLOTS)
            flat.append((rows, mixed((a + k * odd[3]) & m64) >> (64 - start.word_bits), k, slot))
            back = [h, back[0]]
    # docs come in one batch, so chunks of BATCH tokens run over their ends
    for at in range(0, len(flat), 64):
        grads = [{}, {}, {}]
        for rows, inner, k, slot in flat[at : at + 64]:
            z = np.exp(sum(cw[x] for x in rows) + start.dead)
            y = np.exp(wb[k] + ww[inner])
            gz, gy = z / z.sum(), y / y.sum()
            gz[k] -= 1
            gy[slot] -= 1
            for i, x in enumerate(rows):
                grads[0].setdefault(i, {}).setdefault(x, []).append(gz)
            grads[1].setdefault(0, {}).setdefault(inner, []).append(gy)
            grads[2].setdefault(0, {}).setdefault(k, []).append(gy)
        for t, w in enumerate((cw, ww, wb)):
            for i in sorted(grads[t]):
                for x, gs in grads[t][i].items():
                    g = sum(gs)
                    squares[t][x] += (g**2).mean()
                    w[x] = np.clip(w[x] - lm.RATE / np.sqrt(squares[t][x]) * g, lm.NEVER, lm.CLIP)
    for want, have in zip((cw, ww, wb), got.tables()):
        assert np.abs(want - have).max() < 2e-3 and np.abs(want).max() > 0.1


def test_language_model_hard_rows(spark, hard, empty):
    model = lm.train(hard)
    got = lm.scored(hard, model).collect()
    assert len(got) == len(hard_rows())
    assert all((x.logprob is None) == (x.n_tokens == 0) for x in got)
    assert len({x.logprob for x in got if x.doc_id in (5, 6)}) == 1
    assert lm.scored(empty, lm.train(empty)).count() == 0
    assert lm.scored(hard, lm.train(empty)).count() == len(hard_rows())


@pytest.fixture(scope="session")
def network():
    return pii.train()


def test_pii_held_out(network):
    r, hit, made, gold = random.Random(4242), 0, 0, 0
    for _ in range(300):
        text, spans = pii.example(r, 150)
        got = {(s, e, k) for _, s, e, k in pii.find(network, [text])}
        want = {(s, e, k) for s, e, k in spans}
        hit, made, gold = hit + len(got & want), made + len(got), gold + len(want)
    assert hit >= 0.9 * gold and hit >= 0.9 * made


def test_pii_gradient_is_the_numeric_one():
    p = {k: v.astype(np.float64) for k, v in pii.init(5).items()}
    r = np.random.default_rng(1)
    p["trans"] = r.normal(0, 0.3, p["trans"].shape)
    symbols, gold = pii.labelled(6, 9, 20)
    _, g = pii._gradients(p, symbols, gold)
    for name, v in p.items():
        for at in [tuple(r.integers(0, n) for n in v.shape) for _ in range(6)] + ([(int(symbols[0, 0]) if i else 0,) * 0 or (0, int(symbols[3, i])) for i in range(3)] if name == "embed" else []):
            was, around = v[at], []
            for step in (1e-5, -1e-5):
                v[at] = was + step
                around.append(pii._gradients(p, symbols, gold)[0])
            v[at] = was
            assert abs((around[0] - around[1]) / 2e-5 - g[name][at]) < 1e-6, name


def test_pii_in_documents_that_another_hand_wrote(network):
    """Mail addresses, phone numbers and card numbers in the given tables, told by expressions of their own."""
    import re

    import pyarrow.parquet as pq

    every = [t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist() if t]
    texts = [t for t in every if "@" in t] + [t for t in every if not re.search(r"[0-9@]", t)][:400]
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[a-z]{2,}")
    want = {(i, m.start(), m.end()) for i, t in enumerate(texts) for m in mail.finditer(t)}
    found = pii.find(network, texts)
    got = {(i, s, e) for i, s, e, k in found if k == 1}
    assert len(want) > 20 and len(want & got) >= 0.95 * len(want)
    assert len(got - want) <= 0.05 * len(got)
    plain = [i for i, t in enumerate(texts) if not re.search(r"[0-9@]", t)]
    touched = {i for i, *_ in found}
    assert sum(i in touched for i in plain) <= 0.02 * len(plain)


def test_pii_spans_are_reconciled_like_brute_force():
    r = random.Random(8)
    for _ in range(200):
        spans = [(-r.randrange(5), s := r.randrange(60), s + r.randrange(1, 9), r.randrange(1, 7)) for _ in range(r.randrange(40))]
        taken: list = []
        for _, s, e, k in sorted(spans):
            if all(e <= a or s >= b for a, b, _ in taken):
                taken.append((s, e, k))
        assert pii.reconciled(spans) == sorted(taken)
    many = [(0, 3 * i, 3 * i + 2, 1) for i in range(100_000)]
    assert len(pii.reconciled(many)) == 100_000


def test_pii_windows_agree_wherever_the_cut_falls(network):
    r = random.Random(5)
    mail = "jane.porter@example.org"
    for at in range(800, 1100, 13):
        text = (prose(r, 300))[: at] + " write to " + mail + " today " + prose(r, 200)
        assert mail in {text[s:e] for _, s, e, k in pii.find(network, [text])}


def brute_viterbi(p, em, size):
    score, back = p["first"] + em[0], []
    for t in range(1, size):
        step = score[:, None] + p["trans"]
        back.append(step.argmax(0))
        score = step.max(0) + em[t]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_pii_decoding_is_exact(network):
    r = random.Random(11)
    texts = [pii.example(r, 120)[0] for _ in range(40)]
    for text in texts:
        codes = pii.folded(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        sizes = np.array([len(text)])
        em, over = pii.emissions(network, codes[:, None], sizes)
        path = brute_viterbi(network, em[:, :, 0], len(text))
        got = np.zeros(len(text), int)
        for _, s, e, k in pii.decode(network, em, over, sizes):
            got[s:e] = k
        assert got.tolist() == path


def test_pii_hard_rows(spark, hard, empty, network):
    got = pii.spans(hard, network).collect()
    texts = {r[0]: r[1] for r in hard_rows()}
    assert all(texts[x.doc_id][x.start : x.end] == x.value for x in got if x.doc_id is not None)
    assert pii.spans(empty, network).count() == 0
    two = spark.createDataFrame([(None, "mail bob.fine@example.com now"), (3, "mail bob.fine@example.com now"), (3, "mail bob.fine@example.com now")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.value) for x in pii.spans(two, network).collect()) == [(0, "bob.fine@example.com"), (3, "bob.fine@example.com"), (3, "bob.fine@example.com")]
