"""Golden hashes, scenarios of versions, pruning and merging."""

import pytest
from pyspark.sql import functions as F

from lamina import changes as ch
from lamina.catalog import AmbiguousHash, Catalog
from lamina.digest import Digest, content_hash, object_id
from lamina.fragments import split_boundaries, write_base
from lamina.indexing import bloom_has, build_blooms, chunk_groups, describe_bloom
from lamina.repo import PendingChanges, Repository
from lamina.scan import TableScan
from lamina.store import NotFound
from lamina.types import Column, schema_hash, schema_of

FRUITS = [Column(1, "fruit_id", "integer"), Column(2, "name", "character varying")]


def made(spark, root, pk=("fruit_id",)):
    repo = Repository(Catalog(spark, root), "test/fruits")
    repo.init()
    base = spark.createDataFrame([(1, "apple", 1), (2, "orange", 1)], "fruit_id int, name string, number int")
    repo.work.create("fruits", base, pk)
    repo.commit()
    repo.work.insert("fruits", spark.createDataFrame([(3, "mayonnaise", 1)], base.schema))
    repo.commit()
    repo.work.delete("fruits", "name = 'apple'")
    repo.commit()
    repo.work.update("fruits", {"name": "'guitar'"}, "fruit_id = 2")
    repo.commit()
    return repo


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_golden_hashes(spark):
    df = spark.createDataFrame([(1, "apple"), (2, "orange")], "fruit_id int, name string")
    content = content_hash(df, FRUITS)
    assert content.hex() == "c01cce6c17bde5b999147b43c6133b11872298842a7388a0b82aee834e9454b0"
    assert schema_hash(FRUITS) == "3e022317e6dd31edb92c18a464dab55750ca16d5f4f111d383b1bdbc53ded5b5"
    assert object_id(content, schema_hash(FRUITS)) == "o0e742bd2ea4927f5193a2c68f8d4c51ea018b1ef3e3005a50727147d2cf57b"
    stamped = spark.sql("SELECT timestamp_ntz'2019-01-03 03:03:03.333' AS t, 3 AS a, 'three' AS b, cast(3.3 AS decimal(2,1)) AS c")
    assert content_hash(stamped, schema_of(stamped.schema)).hex() == "b12a93d54ba7ff1c2e26c92f01ac9c9d7716242eb47344d57c89b481227f5298"
    nulls = spark.createDataFrame([(4, None, None, None), (2, None, None, None), (6, None, None, None)], "a int, b string, c int, d string")
    assert content_hash(nulls, schema_of(nulls.schema)).hex() == "5c1c76c1732ba2d10a1aa8d02cbb0421a2bc3ddbc48d19a56f07752d86c74088"


def test_row_text_quotes(spark):
    from lamina.rowtext import row_text

    df = spark.sql("""SELECT 'a "b" \\\\ c' AS a, '' AS b, true AS c, array(1, 2) AS d, cast(NULL AS string) AS e, 'x,y' AS f""")
    assert df.select(row_text(schema_of(df.schema))).first()[0] == '("a ""b"" \\\\ c","",t,"{1,2}",,"x,y")'


def test_digest_group():
    a, b = Digest.of_text("(1,a)"), Digest.of_text("(2,b)")
    assert a + b - b == a and not (a - a) and -a + a == Digest.zero() and Digest.from_hex(a.hex()) == a


def split_table(spark, root):
    repo = Repository(Catalog(spark, root), "test/split")
    repo.init()
    df = spark.createDataFrame([(i + 1, chr(97 + i), 2 * i) for i in range(11)], "key int, value_1 string, value_2 int")
    repo.work.create("test", df, ("key",))
    repo.commit(chunk_size=5)
    return repo


def test_chunks_and_split_changes(spark, root):
    repo = split_table(spark, root)
    base = repo.images["latest"].tables["test"].objects
    assert base == [
        "oab9901c63e816f8e3d47366740a76323f168fbe5d5b25eed6b8f4755c37e10",
        "o899fa68202a31c0e10c98c446d9ffef8812d7bdce76ef9da92545172fbb47b",
        "oe1841cba2d9d9598f2cd3226bb60bb77dc77b98a05808e7976ed112bade86f",
    ]
    w = repo.work
    w.sql("INSERT INTO test VALUES (0, 'zero', -1); DELETE FROM test WHERE key = 4; UPDATE test SET value_1 = 'five' WHERE key = 5; UPDATE test SET value_1 = 'six' WHERE key = 6; DELETE FROM test WHERE key = 6; INSERT INTO test VALUES (12, 'l', 22)")
    repo.commit(split_changeset=True)
    new = repo.images["latest"].tables["test"].objects[3:]
    metas = repo.catalog.objects(new)
    assert [(m.rows_inserted, m.rows_deleted) for m in metas] == [(1, 0), (1, 2), (0, 1), (1, 0)]
    now = repo.table("latest", "test")
    assert [r[0] for r in rows(now.read())] == [0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12] and now.count() == 11
    total = Digest.zero()
    for m in repo.catalog.objects([*base, *new]):
        total = total + Digest.from_hex(m.insertion_hash) - Digest.from_hex(m.deletion_hash)
    assert total == content_hash(now.read(), now.schema)
    assert rows(repo.table(repo.images["latest"].parent, "test").read()) == [(i + 1, chr(97 + i), 2 * i) for i in range(11)]


def test_split_places_gaps_with_next_group(spark):
    schema = [Column(1, "k", "integer", True)]
    df = spark.createDataFrame([(k,) for k in (0, 1, 5, 6, 10, 12, 13)], "k int")
    got = {r["k"]: r["_lamina_chunk"] for r in split_boundaries(df, schema, [((1,), (5,)), ((10,), (12,))]).collect()}
    assert got == {0: 0, 1: 1, 5: 1, 6: 2, 10: 2, 12: 2, 13: 3}


def test_pruning_masks(spark, root):
    repo = made(spark, root)
    repo.work.insert("fruits", spark.createDataFrame([(4, "kumquat", 1)], "fruit_id int, name string, number int"))
    repo.commit()
    t = repo.table("latest", "fruits")
    ids = t.version.objects

    def mask(quals):
        return [ids.index(m.id) + 1 for m in t.plan(quals).required], rows(t.read(["name"], quals))

    assert mask([[("fruit_id", "=", "4")]]) == ([5], [("kumquat",)])
    assert mask([[("fruit_id", ">=", 3)]]) == ([2, 5], [("kumquat",), ("mayonnaise",)])
    assert mask([[("fruit_id", "=", 2)]]) == ([1, 3, 4], [("guitar",)])
    assert mask([[("name", "is null", None)]]) == ([1, 2, 3, 4, 5], [])
    assert mask([[("fruit_id", "=", 2)], [("name", ">", "guitar")]]) == ([1, 3, 4], [])
    assert mask([[("name", "=", "apple")]]) == ([1, 3, 4], [])
    assert mask([[("fruit_id", "= any", [1, 4])]])[1] == [("kumquat",)]
    assert mask([[("fruit_id", "<> all", [2, 3])]])[1] == [("kumquat",)]
    assert mask([[("name", "like", "g%")]])[1] == [("guitar",)]
    assert t.planned == 9
    t.plan([[("name", "like", "g%")]], ["name"])
    assert t.planned == 9
    assert t.plan([[("fruit_id", "=", 4)]]).explain()[0].startswith("Objects: 1 of 5")
    assert rows(t.read(["number", "fruit_id", "fruit_id"], [[("fruit_id", "=", 4)]])) == [(1, 4, 4)]


def test_time_travel_diff_and_tags(spark, root):
    repo = made(spark, root)
    log = repo.images.log(repo.head.hash)
    assert len(log) == 5 and log[-1].hash == "0" * 64
    assert rows(repo.table(log[3], "fruits").read()) == [(1, "apple", 1), (2, "orange", 1)]
    assert repo.diff_counts("fruits", log[3], log[0]) == (2, 2, 0)
    assert rows(repo.diff("fruits", log[1], log[0]).select("added", "fruit_id", "name")) == [(False, 2, "orange"), (True, 2, "guitar")]
    assert repo.diff("fruits", log[4], log[0]) is True and repo.diff("fruits", log[0], log[4]) is False
    repo.images.tag(log[2].hash, "v1")
    assert repo.images["v1"].hash == log[2].hash == repo.images[log[2].hash[:20]].hash
    with pytest.raises(NotFound):
        repo.images["nothing"]
    with pytest.raises(AmbiguousHash):
        repo.images.by_hash("")
    assert repo.images.descendants(log[1].hash) == {log[1].hash, log[0].hash}
    assert repo.images.tree().count("\n") == 4
    repo.work.delete("fruits")
    assert repo.diff_counts("fruits", repo.head) == (0, 2, 0)
    with pytest.raises(PendingChanges):
        repo.checkout(log[2].hash)
    repo.checkout(log[2].hash, force=True)
    assert not repo.has_pending_changes() and rows(repo.work.table("fruits"))[0] == (1, "apple", 1)


def net(spark, steps):
    schema = [Column(1, "k", "integer", True), Column(2, "v", "character varying")]
    kind = "struct<k:int,v:string>"
    log = spark.createDataFrame(steps, f"seq long, op int, old {kind}, new {kind}")
    return [(r["k"], r["upserted"], r["old"] and tuple(r["old"]), r["new"] and tuple(r["new"])) for r in ch.conflate(log, schema).orderBy("k").collect()]


def test_conflation(spark):
    a, b, c = (1, "a"), (1, "b"), (2, "a")
    assert net(spark, [(0, 0, None, a), (1, 2, a, b)]) == [(1, True, None, b)]
    assert net(spark, [(0, 0, None, a), (1, 2, a, b), (2, 1, b, None)]) == []
    assert net(spark, [(0, 1, a, None), (1, 0, None, a)]) == []
    assert net(spark, [(0, 2, a, b), (1, 2, b, a)]) == []
    assert net(spark, [(0, 2, a, b), (1, 1, b, None)]) == [(1, False, a, None)]
    assert net(spark, [(0, 2, a, c)]) == [(1, False, a, None), (2, True, None, c)]
    assert net(spark, [(0, 2, a, a)]) == []


def test_no_key_patch_takes_all_copies(spark, root):
    repo = Repository(Catalog(spark, root), "nokey")
    repo.init()
    repo.work.create("t", spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k int, v string"))
    repo.commit(chunk_size=2)
    assert repo.work.table("t").count() == 4
    repo.work.delete("t", "k = 1 OR v IS NULL")
    repo.commit()
    assert rows(repo.work.table("t")) == [(3, "c")]


def test_schema_change_makes_a_base(spark, root):
    repo = made(spark, root)
    repo.work.sql("ALTER TABLE fruits ADD COLUMN origin text; ALTER TABLE fruits DROP COLUMN number; INSERT INTO fruits VALUES (9, 'fig', 'x')")
    image = repo.commit()
    assert len(image.tables["fruits"].objects) == 1
    assert rows(repo.work.table("fruits")) == [(2, "guitar", None), (3, "mayonnaise", None), (9, "fig", "x")]
    repo.work.sql("CREATE TABLE n (a int PRIMARY KEY, b numeric(5,2)); INSERT INTO n (a) VALUES (1); CREATE TABLE big AS SELECT * FROM fruits WHERE fruit_id > 2; DROP TABLE fruits")
    image = repo.commit()
    assert sorted(image.tables) == ["big", "n"] and rows(repo.work.table("n")) == [(1, None)]


def test_empty_table_has_no_objects(spark, root):
    catalog = Catalog(spark, root)
    df = spark.createDataFrame([], "a int, b string")
    assert write_base(catalog, df, schema_of(df.schema)) == []
    from lamina.catalog import TableVersion

    assert TableScan(catalog, TableVersion(schema_of(df.schema), [])).read(quals=[[("a", "=", 1)]]).columns == ["a", "b"]


def test_bloom_golden(spark):
    letters = spark.createDataFrame([(0, chr(97 + i)) for i in range(26)], "g long, v string")
    k, bits = build_blooms(letters, "g", "v", size=16)[0]
    assert (k, bits) == (4, "T79jcHurra5T6d8Hk+djZA==")
    even = spark.createDataFrame([(0, 2 * i) for i in range(25)], "g long, v int")
    entry = build_blooms(even, "g", "v", probability=0.01)[0]
    assert entry == [7, "uSP6qzHHDqVq/qHMlqrAoHhpxEuZ08McrB0J6c9M"]
    assert all(bloom_has(entry, str(2 * i)) for i in range(25))
    with pytest.raises(ValueError):
        build_blooms(even, "g", "v")


def test_bloom_describe():
    text = describe_bloom([7, "uSP6qzHHDqVq/qHMlqrAoHhpxEuZ08McrB0J6c9M"])
    assert "k=7" in text and "approx. 23 item(s), false positive probability 0.7%" in text


def test_bloom_prunes_and_reindex(spark, root):
    repo = split_table(spark, root)
    repo.reindex("latest", "test", {"bloom": {"value_1": {"probability": 0.01}}})
    t = repo.table("latest", "test")
    assert len(t.plan([[("value_1", "=", "b")]]).required) == 1
    assert len(t.plan([[("value_1", "=", "zz")]]).required) == 0
    assert t.read(quals=[[("value_1", "=", "b")]]).count() == 1


def test_chunk_groups():
    assert chunk_groups([("a", 1, 3), ("b", 5, 6), ("c", 3, 4), ("d", 2, 5)]) == [[("a", 1, 3), ("b", 5, 6), ("c", 3, 4), ("d", 2, 5)]]
    assert chunk_groups([("b", 5, 6), ("a", 1, 3)]) == [[("a", 1, 3)], [("b", 5, 6)]]


def test_exchange_between_roots(spark, root, tmp_path):
    repo = made(spark, root)
    repo.images.tag(repo.head.hash, "v1")
    far = Catalog(spark, f"file://{tmp_path}/far")
    copy = repo.clone("test/copy", far)
    assert rows(copy.table("v1", "fruits").read()) == rows(repo.table("v1", "fruits").read())
    copy.checkout("v1")
    copy.work.delete("fruits", "fruit_id = 2")
    copy.commit()
    assert copy.push(repo) == [copy.head.hash]
    assert rows(repo.table(copy.head.hash, "fruits").read(["fruit_id"])) == [(3,)]
    assert repo.size() > repo.image_size("v1") > 0
    repo.images.delete([copy.head.hash])
    gone = repo.catalog.cleanup()
    assert len(gone) == 1 and repo.table("v1", "fruits").read().count() == 2
    assert repo.images.prune() == []
    repo.dump(str(tmp_path / "dump.json"))


def test_import_tables_and_queries(spark, root):
    repo = made(spark, root)
    other = Repository(repo.catalog, "test/other")
    other.init()
    other.import_tables(["f", "q"], repo, ["fruits", "SELECT fruit_id * 2 AS d FROM fruits"], queries=[False, True])
    assert other.images["latest"].tables["f"].objects == repo.images["latest"].tables["fruits"].objects
    assert rows(other.work.table("q")) == [(4,), (6,)]
    with pytest.raises(ValueError):
        other.import_tables(["f"], repo, ["fruits"])
    assert rows(other.sql("SELECT f.name FROM f JOIN q ON q.d = f.fruit_id * 2 WHERE EXISTS (SELECT 1 FROM q)")) == [("guitar",), ("mayonnaise",)]


def test_overlay(spark):
    lower = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    upper = spark.createDataFrame([(1, "a", False, 1), (2, "b", False, 2), (2, "B", True, 3), (5, "e", True, 4), (5, "e", False, 5)], "k int, v string, flag boolean, seq int")
    schema = schema_of(lower.schema, ("k",))
    assert rows(ch.overlay(lower, upper, schema)) == [(2, "B"), (3, "c")]
    got = rows(ch.overlay_changes(lower, upper, schema).select("k", "upserted"))
    assert got == [(1, False), (2, True)]


def test_overlap_of_blind_upserts(spark, root):
    from lamina.sources.loading import blind_upsert

    repo = made(spark, root)
    blind_upsert(repo, "fruits", spark.createDataFrame([(2, "kiwi", 7)], "fruit_id int, name string, number int"))
    t = repo.table("latest", "fruits")
    assert rows(t.read(quals=[[("name", "=", "guitar")]])) == []
    assert rows(t.read(quals=[[("name", "=", "kiwi")]])) == [(2, "kiwi", 7)]


def test_random_histories_match_a_dict(spark, root):
    import random

    r = random.Random(3)
    repo = Repository(Catalog(spark, root), "rand")
    repo.init()
    truth = {i: i for i in range(0, 40, 2)}
    repo.work.create("t", spark.createDataFrame(list(truth.items()), "k int, v int"), ("k",))
    repo.commit(chunk_size=6)
    for n in range(3):
        gone = {k for k in truth if r.random() < 0.2}
        changed = {k: r.randrange(99) for k in truth if k not in gone and r.random() < 0.3}
        new = {k: r.randrange(99) for k in range(60) if k not in truth and r.random() < 0.2}
        repo.work.delete("t", F.col("k").isin(*gone) if gone else F.lit(False))
        for k, v in list(changed.items())[:2]:
            repo.work.update("t", {"v": F.lit(v)}, F.col("k") == k)
            truth[k] = v
        repo.work.insert("t", spark.createDataFrame(list(new.items()), "k int, v int"))
        truth = {k: v for k, v in truth.items() if k not in gone} | new
        repo.commit(split_changeset=n % 2 == 0)
    t = repo.table("latest", "t")
    assert rows(t.read()) == sorted(truth.items()) and t.count() == len(truth)
    assert rows(t.read(quals=[[("v", ">", 50)]])) == sorted((k, v) for k, v in truth.items() if v > 50)


def test_row_text_of_times_needs_no_regular_expression(spark):
    from lamina.rowtext import row_text
    from lamina.types import schema_of

    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-02 03:04:05.6' AS t, DATE '2024-01-02' AS d, CAST(NULL AS TIMESTAMP_NTZ) AS n, CAST(NULL AS DATE) AS m FROM range(1)")
    text = df.select(row_text(schema_of(df.schema)).alias("x"))
    assert text.first()["x"] == '("2024-01-02 03:04:05.6",2024-01-02,,)'
    times = spark.createDataFrame([], df.schema).select(row_text(schema_of(df.schema)))
    assert "RLIKE" not in times._jdf.queryExecution().analyzed().toString().upper()
