import base64
import io
import random
import zipfile

import pytest
import tiktoken
from pyspark.sql import functions as F

from lamina.llm import media, sharding, tokencount

from .conftest import hard_rows, prose


@pytest.fixture(scope="session")
def encoding():
    with open(tokencount.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_match_the_tokenizer(hard, encoding):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in tokencount.counts(hard, block_bytes=20_000).collect()))
    assert got == sorted((r[0] is not None, r[0] or 0, len(encoding.encode_ordinary(r[1] or ""))) for r in hard_rows())


def test_token_counts_of_odd_text(spark, encoding):
    r = random.Random(2)
    alphabet = " \n\t'stdrevm0123456789abcXYZéß漢字́​ !?<|>-_…😀½²"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)] + ["<|endoftext|>", "don't  I'LL we've   ", "a" * 5000, "\r\n\r\n  x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in tokencount.counts(df, block_bytes=3000).collect()}
    assert got == {i: len(encoding.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_token_counts_of_nothing(empty):
    assert tokencount.counts(empty).count() == 0


def brute_shards(rows, target):
    """rows: (size, values). Leaves as lists of row numbers, left to right."""
    span = [max(1, max(r[1][d] for r in rows) - min(r[1][d] for r in rows)) for d in range(len(rows[0][1]))]

    def split(ids):
        total = sum(rows[i][0] for i in ids)
        width = [(max(rows[i][1][d] for i in ids) - min(rows[i][1][d] for i in ids)) / span[d] for d in range(len(span))]
        d = max(range(len(span)), key=lambda d: (width[d], -d))
        if total <= target or width[d] == 0:
            return [ids]
        values = sorted({rows[i][1][d] for i in ids})
        upto = lambda v: sum(rows[i][0] for i in ids if rows[i][1][d] <= v)
        at = next(v for v in values if 2 * upto(v) >= total)
        k = values.index(at)
        under = upto(values[k - 1]) if k else 0
        cut = at if at < values[-1] and (k == 0 or abs(2 * upto(at) - total) <= abs(2 * under - total)) else values[k - 1]
        return split([i for i in ids if rows[i][1][d] <= cut]) + split([i for i in ids if rows[i][1][d] > cut])

    return split(list(range(len(rows))))


def test_shards_match_brute_force(spark):
    r = random.Random(5)
    data = [(i, "y" * r.choice([0, 3, 50, 400]), r.randrange(30), r.choice([1, 2, 2, 2, 9])) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, a long, b long")
    got = {x.doc_id: x.shard for x in sharding.shards(df, ["a", "b", "doc_id"], 2000).collect()}
    want = brute_shards([(max(1, len(t)), (a, b, i)) for i, t, a, b in data], 2000)
    assert [sorted(i for i in got if got[i] == s) for s in range(len(want))] == [sorted(x) for x in want]


def test_shards_tell_long_prefixes_and_wide_integers_apart(spark):
    r = random.Random(12)
    sources = [f"https://common_crawl_{x}" for x in "abcdefghijk"] + [None, "ü" * 5, "https:/"]
    hashes = [r.randrange(-(2**63), 2**63) for _ in range(200)] + [2**63 - 1, 2**63 - 2, -(2**63), 1 - 2**63]
    data = [(h, "y" * r.choice([0, 3, 50, 400]), r.choice(sources[:2] + sources), r.choice([None, 2, 2, 3])) for h in hashes]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, b long").repartition(3)
    place = {s: i for i, s in enumerate(sorted({d[2] for d in data if d[2] is not None}, key=str.encode))} | {None: -1}
    for dims, values in ((["source", "b", "doc_id"], lambda d: (place[d[2]], 1 if d[3] is None else d[3], d[0])), (["source"], lambda d: (place[d[2]],)), (["doc_id"], lambda d: (d[0],))):
        got = {x.doc_id: x.shard for x in sharding.shards(df, dims, 1500).collect()}
        want = brute_shards([(max(1, len(d[1])), values(d)) for d in data], 1500)
        assert len(want) > 5
        assert [sorted(i for i in got if got[i] == s) for s in range(len(want))] == [sorted(data[i][0] for i in x) for x in want]


def test_shards_of_hard_rows(hard, empty):
    out = sharding.shards(hard, ["lang", "source", "n_chars", "doc_id"], 10_000).collect()
    assert len(out) == len(hard_rows())
    assert len({x.shard for x in out if x.doc_id == 5}) == 1  # repeated rows
    assert sorted({x.shard for x in out}) == list(range(len({x.shard for x in out})))
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append(x.bytes)
    assert all(sum(v) <= 10_000 or len(v) == 1 for v in by.values())
    assert sharding.shards(empty, ["lang", "doc_id"], 10).count() == 0


def test_registered_shards_split_at_every_size(spark):
    out = sharding.QUERIES["op1_kd_sharding"](spark, "/root/testdata/sf0.01")
    sizes = {x.shard: x.b for x in out.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert len(sizes) >= 32 and sorted(sizes) == list(range(len(sizes)))
    total = sum(sizes.values())
    assert out.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert sum(v for v in sizes.values() if v <= total // sharding.LEAST_SHARDS) > 0.9 * total  # others are single documents


def test_shards_of_fractions_and_times(spark):
    r = random.Random(4)
    rows = [(i, "x" * 10, i / 1000 + 0.0001, f"2024-01-01 00:00:00.{i:06d}") for i in range(64)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, f double, t string").withColumn("t", F.col("t").cast("timestamp"))
    for d in ("f", "t"):
        got = {x.doc_id: x.shard for x in sharding.shards(docs, [d], 80).collect()}
        assert [got[i] for i in range(64)] == [i // 8 for i in range(64)]


@pytest.mark.parametrize("zip64", [False, True])
def test_media_shares_of_a_directory(tmp_path, zip64):
    """Every member belongs to exactly one share, however many there are; marks inside names and comments don't mislead."""
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(300):
            info = zipfile.ZipInfo(f"{i} " + ("PK\x01\x02" * (i % 5)) + "é" * (i % 3))
            info.comment = b"PK\x01\x02" + b"x" * (i % 60)
            with z.open(info, "w", force_zip64=zip64) as f:
                f.write(f"payload {i}".encode())
    data = path.read_bytes()
    with zipfile.ZipFile(path) as z:
        want = [(i.filename, i.header_offset, i.CRC) for i in z.infolist()]
    for shares in (1, 2, 7, 64, 1000):
        got = [(m.filename, m.header_offset, m.CRC) for k in range(shares) for m in media.members_of(io.BytesIO(data), len(data), k, shares)]
        assert got == want, shares
    moved = io.BytesIO(b"something before" + data)
    assert [m.header_offset - 16 for m in media.members_of(moved, len(data) + 16, 0, 1)] == [o for _, o, _ in want]


def test_media_archives_of_equal_names(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        with zipfile.ZipFile(tmp_path / folder / "same.zip", "w") as z:
            z.writestr("m", folder)
    got = {(x.archive, bytes(x.payload).decode()) for x in media.read_members(spark, f"file://{tmp_path}").collect()}
    assert got == {("x/same.zip", "x"), ("y/same.zip", "y")}


def test_media_round_trip(spark, hard, tmp_path):
    path = f"file://{tmp_path}/zips"
    n = media.write_archives(hard, path, "text", ["doc_id", "lang"])
    assert n == len(hard_rows())
    for size in (1000, 1 << 25):
        got = media.media_table(spark, path, "doc_id bigint, lang string", rangeBytes=size, batchBytes=5000).collect()
        rows = sorted(((x.doc_id, x.lang, None if x.payload is None else bytes(x.payload).decode()) for x in got), key=repr)
        assert rows == sorted(((r[0], r[2], r[1]) for r in hard_rows()), key=repr) and all(x.error is None for x in got)


def test_media_faults_stay_with_their_member(spark, tmp_path):
    r = random.Random(1)
    path = f"file://{tmp_path}/zips"
    df = spark.createDataFrame([(i, prose(r, 40)) for i in range(6)], "k long, v string").coalesce(1)
    media.write_archives(df, path, "v", ["k"])
    archive = next((tmp_path / "zips").glob("*.zip"))
    raw = bytearray(archive.read_bytes())
    second = raw.find(b"PK\x03\x04", 10)
    raw[second + 60] ^= 0xFF
    archive.write_bytes(bytes(raw))
    (tmp_path / "zips" / "broken.zip").write_bytes(b"not an archive")
    got = media.read_members(spark, path, attempts=2).collect()
    assert len(got) == 7 and sum(x.error is None for x in got) == 5
    assert [x.member for x in got if x.archive == "broken.zip"] == [None]


def test_media_of_nothing(spark, empty, tmp_path):
    assert media.write_archives(empty, f"file://{tmp_path}/none", "text", ["doc_id"]) == 0
    assert media.read_members(spark, f"file://{tmp_path}/none").count() == 0


def stored(path, n=300):
    """An archive of members whose records have comments, so that its directory spans many ranges."""
    with zipfile.ZipFile(path, "w") as z:
        for i in range(n):
            info = zipfile.ZipInfo(f"member {i}")
            info.comment = b"c" * 80
            z.writestr(info, f"payload {i}")
    return path.read_bytes()


def rows_of(path, **options):
    reader = media.MemberReader({"path": f"file://{path}", **options})
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("size", [1500, 7000, 1 << 25])
def test_media_damaged_directory_tells_what_it_lost(tmp_path, size):
    """Whichever record is damaged, in whichever range: every other member comes once, and a row has the error."""
    data = stored(tmp_path / "a.zip")
    marks = [i for i in range(len(data)) if data[i : i + 4] == media.RECORD]
    assert len(marks) == 300
    for hurt in ({0}, {5}, {299}, {150, 151}, {17, 19, 21, 23, 25}, set(range(40, 110))):
        bad = bytearray(data)
        for k in hurt:
            bad[marks[k] : marks[k] + 4] = b"XXXX"
        (tmp_path / "a.zip").write_bytes(bytes(bad))
        got = rows_of(tmp_path, rangeBytes=size, attempts=1)
        assert sorted(r["member"] for r in got if not r["error"]) == sorted(f"member {i}" for i in range(300) if i not in hurt), hurt
        assert any(r["error"] and r["member"] is None for r in got), hurt


def test_media_range_that_cannot_be_read_is_an_error(tmp_path, monkeypatch):
    stored(tmp_path / "a.zip")
    whole = media.members_of

    def failing(f, size, share, shares):
        if share == 3:
            raise OSError("gone")
        return whole(f, size, share, shares)

    monkeypatch.setattr(media, "members_of", failing)
    got = rows_of(tmp_path, rangeBytes=7000, attempts=2)
    assert [(r["member"], r["error"]) for r in got if r["error"]] == [(None, "OSError: gone")] and 200 < len(got) < 300


def test_media_ends_and_names_that_are_not_the_archives(tmp_path):
    inner = stored(tmp_path / "a.zip", 5)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("first", "x")
        z.writestr("nested", inner)
    data = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(data[:-120])  # cut: the last directory's end is the nested archive's
    assert any(r["error"] for r in rows_of(tmp_path, attempts=1))
    (tmp_path / "a.zip").write_bytes(data + b"more")
    got = rows_of(tmp_path, attempts=1)
    assert [r["member"] for r in got if not r["error"]] == ["first", "nested"] and sum(bool(r["error"]) for r in got) == 1
    (tmp_path / "a.zip").write_bytes(b"noise" * 5000)
    assert [(r["member"], r["error"]) for r in rows_of(tmp_path, rangeBytes=1000, attempts=1)] == [(None, "ValueError: no end of directory")]
    at = data.rfind(b"first")
    (tmp_path / "a.zip").write_bytes(data[:at] + b"fIrst" + data[at + 5 :])
    assert {r["member"]: r["error"] for r in rows_of(tmp_path, attempts=1)} == {"fIrst": "ValueError: another name in the member's header", "nested": None}


def test_media_missing_folder_and_foreign_names_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        media.read_members(spark, f"file://{tmp_path}/nowhere").count()
    names = ["readme.txt", '000000001 [false, "x"]', '000000002 [false]', '000000003 [false, "7"]', "000000004 [true, null]"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in names:
            z.writestr(name, "p")
    got = media.media_table(spark, f"file://{tmp_path}", "k bigint").collect()
    assert sorted(((x.k, x.payload and bytes(x.payload)) for x in got if not x.error), key=repr) == [(7, b"p"), (None, None)]
    assert sum(x.error is not None and x.error.startswith("the name is no row: ") for x in got) == 3
