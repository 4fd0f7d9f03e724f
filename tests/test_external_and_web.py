"""External objects and their cache, dumps, owners, web sources, CSV splitting, ordered operators, merges."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lamina.catalog import Catalog
from lamina.external import HANDLERS, Folder, ObjectCache, make_external
from lamina.operators import ordered
from lamina.repo import Repository
from lamina.sources import csvfiles, webapi
from lamina.sources.base import SOURCES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def repo(spark, root):
    r = Repository(Catalog(spark, root), "t/x")
    r.init()
    r.work.create("t", spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 3 % 7).cast("int").alias("v")), ("k",))
    r.commit(chunk_size=10)
    return r


def test_one_manifest_and_one_folder_for_a_commit(repo):
    store = repo.catalog.store
    assert len(store.names("meta")) == 1 and len(store.names("objects")) == 1
    repo.work.delete("t", "k % 10 = 0")
    repo.commit(split_changeset=True)
    assert len(store.names("meta")) == 2 and len(repo.images["latest"].tables["t"].objects) == 8
    again = Catalog(repo.spark, store.root)
    assert sorted(again.object_ids()) == sorted(repo.catalog.object_ids()) and again.objects_df().count() == 8
    assert rows(Repository(again, "t/x").table("latest", "t").read(["k"])) == sorted(((k,) for k in range(40) if k % 10), key=repr)


def test_patches_over_ground_and_over_each_other(repo):
    """Merges agree with a plain replay, whatever overlaps what."""
    want = {k: k * 3 % 7 for k in range(40)}
    for i in range(5):
        repo.work.update("t", {"v": f"v + {i + 1}"}, f"k % {i + 2} = 0")
        repo.work.delete("t", f"k = {i * 7}")
        repo.work.sql(f"INSERT INTO t VALUES ({100 + i}, {i})")
        for k in list(want):
            if k % (i + 2) == 0:
                want[k] += i + 1
        want.pop(i * 7, None)
        want[100 + i] = i
        repo.commit(split_changeset=i % 2 == 0)
    assert dict(repo.table("latest", "t").read().collect()) == want
    plan = repo.table("latest", "t").read()._jdf.queryExecution().toString()
    assert "LeftAnti" in plan


def test_external_objects_that_fail_half_way(repo, tmp_path):
    class Flaky(Folder, name="flaky"):
        def upload(self, metas):
            return super().upload(metas[:2])

    ids = repo.images["latest"].tables["t"].objects
    done = make_external(repo.catalog, ids, "flaky", root=f"file://{tmp_path}/there")
    assert done == ids[:2] and HANDLERS["flaky"] is Flaky
    assert repo.table("latest", "t").read().count() == 40
    assert sorted(make_external(repo.catalog, ids, root=f"file://{tmp_path}/there")) == sorted(ids[2:])
    assert repo.table("latest", "t").read().count() == 40
    cache = ObjectCache(repo.catalog, f"file://{tmp_path}/cache", 10**9)
    with cache.ensure(ids) as fetched:
        assert sorted(fetched) == sorted(ids) and repo.table("latest", "t").read().count() == 40
        with cache.ensure(ids) as again:
            assert again == []
    small = ObjectCache(repo.catalog, f"file://{tmp_path}/small", 10)
    with pytest.raises(ValueError):
        with small.ensure(ids):
            pass


def test_rows_laid_over_need_a_committed_table(repo):
    repo.work.delete("t", "k = 1")
    with pytest.raises(ValueError):
        repo.work.upper("t", repo.spark.range(1).selectExpr("cast(id as int) AS k", "1 AS v"))
    repo.commit()
    repo.work.upper("t", repo.spark.range(3).selectExpr("cast(id as int) AS k", "-1 AS v"))
    repo.work.upper("t", repo.spark.range(2, 4).selectExpr("cast(id as int) AS k"), flag=False)
    assert repo.has_pending_changes()
    repo.work.sql("UPDATE t SET v = v - 1 WHERE k < 2")
    repo.commit()
    got = dict(repo.table("latest", "t").read().where("k < 6").collect())
    assert got == {0: -2, 1: -2, 4: 12 % 7, 5: 15 % 7}


def test_owners(repo):
    repo.catalog.grant("t", "ann")
    for name in ("tag", "delete", "update"):
        with pytest.raises(PermissionError):
            getattr(repo.images, name)(*{"tag": (repo.head.hash, "x"), "delete": ([],), "update": (repo.head,)}[name])
    with pytest.raises(PermissionError):
        repo.catalog.grant("t", "bob")
    ann = Repository(Catalog(repo.spark, repo.catalog.store.root, user="ann"), "t/x")
    ann.images.tag(ann.head.hash, "x")
    ann.catalog.grant("t", None)
    repo.images.untag("x")


def test_csv_splits_where_no_record_spans_lines(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n1,"x, y"\n2,z\n')
    (tmp_path / "long.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    (tmp_path / "zip.csv.gz").write_bytes(gzip.compress(b"a,b\n1,q\n"))
    got = {n: rows(csvfiles.read_csv(spark, f"file://{tmp_path}/{n}")) for n in ("plain.csv", "long.csv", "zip.csv.gz")}
    assert got == {"plain.csv": [(1, "x, y"), (2, "z")], "long.csv": [(1, "x\ny"), (2, "z")], "zip.csv.gz": [(1, "q")]}
    assert not csvfiles.has_quoted_newlines(spark, f"file://{tmp_path}/plain.csv", '"', "utf-8")
    assert csvfiles.has_quoted_newlines(spark, f"file://{tmp_path}/long.csv", '"', "utf-8")


def test_filters_of_services():
    quals = [[("a", "=", 1), ("b", "is null", None)], [("c", "<>", "x")], [("d", "~~", "p%_")], [("e", ">", 3)]]
    found = webapi.search_filter(quals)["bool"]["filter"]
    assert found[0]["bool"]["should"] == [{"term": {"a": 1}}, {"bool": {"must_not": {"exists": {"field": "b"}}}}]
    assert found[2] == {"wildcard": {"d": "p*?"}} and found[3] == {"range": {"e": {"gt": 3}}}
    assert webapi.search_filter([[("q", "=", "a AND b")]], "q") == {"bool": {"filter": [{"query_string": {"query": "a AND b"}}]}}
    assert webapi.search_filter(None) == {"match_all": {}}
    assert webapi.document_filter([[("a", ">=", 2)], [("b", "is not null", None), ("c", "=", 1)]]) == {"$and": [{"a": {"$gte": 2}}, {"$or": [{"b": {"$ne": None}}, {"c": {"$eq": 1}}]}]}
    body = webapi.search_aggregates(["g"], {"n": ("count", "*"), "m": ("max", "v")})
    assert body["aggs"]["groups"]["aggs"] == {"m": {"max": {"field": "v"}}}


def test_source_options(spark):
    assert {"socrata", "elasticsearch", "mongodb", "bigquery", "streams"} <= set(SOURCES)
    source = SOURCES["bigquery"](spark, project="p", dataset="d", tables=["t"], queries={"q": "SELECT 1"})
    assert source.options_of(table="t")["table"] == "p.d.t" and source.options_of(query="SELECT 1")["materializationDataset"] == "d" and list(source.tables()) == ["t", "q"]
    tables = SOURCES["mongodb"](spark, url="mongodb://h", database="d", schemas={"c": "x int"}).tables()
    assert tables["c"]().columns == ["_id", "x"]


def test_answers_to_requests(repo):
    t = repo.table("latest", "t")
    ask = lambda q: webapi.answer(t.read(), t.schema, q)
    assert ask("k=in.(1,2)&select=v&order=k") == [{"v": 3}, {"v": 6}]
    assert ask("v=is.null") == [] and ask("k=lt.3&order=k.desc&limit=1&offset=1") == [{"k": 1, "v": 3}]
    for bad in ("nope=eq.1", "k=between.1", "select=nope"):
        with pytest.raises(ValueError):
            ask(bad)


def test_running_totals_and_intervals(spark):
    df = spark.createDataFrame([(i, i * 7 % 11) for i in range(100)], "k int, v long").repartition(6)
    got = {r.k: r.t for r in ordered.running_total(df, [F.desc("k")], "v", "t", 5).collect()}
    at, want = 0, {}
    for i in reversed(range(100)):
        at += i * 7 % 11
        want[i] = at
    assert got == want
    assert ordered.running_total(df.limit(0), [F.asc("k")], "v", "t").count() == 0
    spans = spark.createDataFrame([("a", 1, 3), ("a", 3, 4), ("a", 6, 9), ("b", 2, 2), ("a", 7, 8)], "g string, lo int, hi int")
    assert rows(ordered.interval_groups(spans, "lo", "hi", ["g"])) == [("a", 1, 4, 2), ("a", 6, 9, 2), ("b", 2, 2, 1)]


def test_dumps_without_contents(repo, tmp_path):
    path = repo.dump(f"file://{tmp_path}/d.json")
    body = json.loads((tmp_path / "d.json").read_text())
    assert body["contents"] is None and len(body["objects"]) == 4
    other = Repository(repo.catalog, "t/y")
    assert len(other.load_dump(path)) == 2 and other.table("latest", "t").read().count() == 40


def test_portal_of_a_query_filters_its_rows_once():
    from lamina.plans.repositories import portal_of

    class Counted(list):
        passes = 0

        def __iter__(self):
            Counted.passes += 1
            return super().__iter__()

    rows = Counted({"s_suppkey": i, "s_name": f"s{i}", "s_acctbal": i - 5.5} for i in range(40))
    portal, asked = portal_of(rows)
    given = {"$select": "`key`", "$where": "(`s_acctbal` > 0)", "$limit": "7"}
    assert json.loads(portal("/", given | {"$select": "count(*) AS n"}, None)) == [{"n": "34"}]
    pages = [json.loads(portal("/", given | {"$offset": str(at)}, None)) for at in range(0, 34, 7)]
    assert [int(r["key"]) for p in pages for r in p] == list(range(6, 40)) and asked == {"(`s_acctbal` > 0)"}
    assert Counted.passes == 1
