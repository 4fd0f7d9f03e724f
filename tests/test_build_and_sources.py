"""Builds, provenance, permitted SQL, sources, adapters and streams."""

import json
import sqlite3

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina import build, sqlguard
from lamina.build import BuildError, Builder, parse, preprocess
from lamina.catalog import Catalog
from lamina.functions import adapters as pg
from lamina.indexing import chunk_groups
from lamina.operators.eviction import evict, eviction_order
from lamina.quals import to_cnf
from lamina.repo import Repository, run_sql
from lamina.sources import csvfiles, loading, messages, remote
from lamina.sources.inference import apply_schema, infer_schema, unique_names
from lamina.store import NotFound
from lamina.streaming.sink import changes_since, commit_batches
from lamina.types import Column, SchemaError, schema_of


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def sales(spark, root):
    repo = Repository(Catalog(spark, root), "shop/sales")
    repo.init()
    repo.work.create("fruits", spark.createDataFrame([(1, "apple"), (2, "orange")], "fruit_id int, name string"), ("fruit_id",))
    repo.work.create("stock", spark.createDataFrame([(1, 10), (2, 20)], "fruit_id int, n int"), ("fruit_id",))
    repo.images.tag(repo.commit().hash, "v1")
    repo.work.sql("INSERT INTO fruits VALUES (3, 'mayonnaise')")
    repo.images.tag(repo.commit().hash, "v2")
    return repo


TEXT = """
# a build
FROM EMPTY AS shop/out
FROM shop/sales:${TAG} IMPORT fruits AS f, {SELECT fruit_id, n * 2 AS m FROM stock WHERE n > 5} AS s
SQL {CREATE TABLE both AS
     SELECT f.fruit_id, f.name, s.m FROM f JOIN s ON f.fruit_id = s.fruit_id}
SQL INSERT INTO both SELECT fruit_id + 100, name, NULL \\
    FROM "shop/sales:v2".fruits WHERE fruit_id = 3
"""


def test_build_caches_layers_and_records_provenance(spark, sales):
    b = Builder(sales.catalog)
    first = b.run(TEXT, {"TAG": "v1"})
    out = Repository(sales.catalog, "shop/out")
    assert rows(out.table("latest", "both").read()) == [(1, "apple", 20), (103, "mayonnaise", None), (2, "orange", 40)]
    assert (b.ran, b.cached) == (3, 0)
    deps = build.dependencies(first)
    assert deps == [("shop/sales", sales.images["v1"].hash), ("shop/sales", sales.images["v2"].hash)]
    assert rows(build.dependents(sales.catalog, "shop/sales", sales.images["v2"].hash)) == [("shop/out", first.hash)]
    text = build.to_build_file(first)
    assert text.count("\n") == 2 and "IMPORT fruits AS f" in text
    again = Builder(sales.catalog)
    again.repo = out
    out.checkout("0" * 64, force=True)
    assert again.run(text).hash == first.hash and again.cached == 3
    moved = build.rebuild(out, first.hash, {"shop/sales": "v2"})
    assert moved.hash != first.hash and build.dependencies(moved) == [("shop/sales", sales.images["v2"].hash)]
    assert rows(out.table(moved, "f").read())[-1] == (3, "mayonnaise")


def test_layer_hashes_ignore_formatting(sales):
    a = Builder(sales.catalog).run("FROM EMPTY AS shop/a\nFROM shop/sales:v1 IMPORT fruits\nSQL create table x as select   1 AS one -- c")
    b = Builder(sales.catalog).run("FROM EMPTY AS shop/b\nFROM shop/sales:v1 IMPORT fruits\nSQL CREATE TABLE x AS\\\n SELECT 1 as one")
    assert a.hash == b.hash


def test_failed_layer_leaves_no_image(sales):
    b = Builder(sales.catalog)
    with pytest.raises(Exception, match="nothing"):
        b.run("FROM shop/sales:v1 AS shop/broken\nSQL CREATE TABLE y AS SELECT nothing FROM fruits")
    assert b.repo.head.hash == sales.images["v1"].hash and len(b.repo.images.hashes()) == 2


def test_custom_commands_and_mounts(spark, sales):
    class Double(build.Command):
        def calc_hash(self, repo, args):
            return "double" + args[0]

        def execute(self, repo, work, args):
            work.update(args[0], {"n": "n * 2"})

    build.COMMANDS["DOUBLE"] = Double()
    build.MOUNTS["memory"] = lambda spark, size: {"m": spark.range(size).toDF("k")}
    b = Builder(sales.catalog)
    image = b.run("FROM shop/sales:v1 AS shop/custom\nDOUBLE stock\nFROM MOUNT memory '{\"size\": 4}' IMPORT m AS mm, {SELECT k FROM m WHERE k > 2} AS q")
    repo = b.repo
    assert rows(repo.table(image, "stock").read(["n"])) == [(20,), (40,)] and repo.table(image, "q").read().count() == 1
    with pytest.raises(BuildError):
        build.to_build_file(image)
    assert build.to_build_file(image, ignore_irreproducible=True).startswith("FROM shop/sales")
    with pytest.raises(BuildError):
        b.run("NOSUCH x")


def test_parsing():
    assert preprocess("a ${X} \\${Y}", {"X": "1"}) == "a 1 ${Y}"
    with pytest.raises(BuildError, match="A, B"):
        preprocess("${B} ${A}")
    steps = parse("FROM a/b:c IMPORT ALL\nSQL { SELECT '\\{x\\}' }")
    assert steps[0].everything and steps[1].sql == "SELECT '{x}'"
    for bad in ("FROM a b c", "FROM x IMPORT {SELECT 1}", "SQL {SELECT 1", "lower case"):
        with pytest.raises(BuildError):
            parse(bad)


@pytest.mark.parametrize("sql", ["SELECT * FROM t WHERE a = ANY(ARRAY[1])", "WITH x AS (SELECT 1 AS a) SELECT a FROM x", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.k = t.k)", "SELECT a::int, coalesce(b, 'pg_x') FROM t ORDER BY a LIMIT 3"])
def test_permitted_imports(spark, sql):
    assert sqlguard.check_import(spark, sql) == sql


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT 1; SELECT 2", "SELECT * FROM other.t", "SELECT * FROM pg_catalog.pg_class", "SELECT pg_sleep(1)", "SELECT * FROM information_schema.tables", "INSERT INTO t VALUES (1)"])
def test_forbidden_imports(spark, sql):
    with pytest.raises(sqlguard.ForbiddenSQL):
        sqlguard.check_import(spark, sql)


@pytest.mark.parametrize("sql", ["CREATE SCHEMA x", "SET a = 1", "LOCK TABLE t", "TRUNCATE TABLE t", "CREATE VIEW v AS SELECT 1", "MERGE INTO t USING u ON true", "COPY t FROM 'x'", "UPDATE t SET a = pg_backend_pid()", "GRANT ALL ON t TO u", ""])
def test_forbidden_statements(spark, sql):
    with pytest.raises(sqlguard.ForbiddenSQL):
        sqlguard.check_script(spark, sql)


def test_scripts_split_and_names(spark):
    s = "INSERT INTO t VALUES (1, 'a;b'); -- c;\nUPDATE t SET a = 2; DROP TABLE t;"
    assert len(sqlguard.check_script(spark, s)) == 3
    assert sqlguard.relations(spark, "WITH c AS (SELECT * FROM a) SELECT * FROM c JOIN b ON c.x IN (SELECT x FROM d)") == [("a",), ("b",), ("d",)] or set(sqlguard.relations(spark, "WITH c AS (SELECT * FROM a) SELECT * FROM c JOIN b ON c.x IN (SELECT x FROM d)")) == {("a",), ("b",), ("d",)}
    assert sqlguard.canonical("SELECT  \"a\", 'X' /* c */ From T") == "select a , 'X' from t"


def test_run_sql_ports_the_dialect(spark):
    t = {"t": lambda: spark.createDataFrame([(1, "ab-12"), (2, None)], "a int, b string")}
    assert rows(run_sql(spark, "SELECT \"a\" FROM t WHERE a <> ALL(ARRAY[2, 3]) AND b ~~ 'ab%'", t)) == [(1,)]
    assert rows(run_sql(spark, "SELECT substring(b from '[0-9]+') AS s FROM t ORDER BY a", t)) == rows(spark.createDataFrame([("12",), (None,)], "s string"))
    assert spark.catalog.listTables() == [] or all(not x.name.startswith("v_") for x in spark.catalog.listTables())


def test_cnf():
    assert to_cnf([[("a", "= any", [1, 2])], [("b", "<> all", [3, 4])], [("c", "=", None)], [("d", "in", [1, None])]]) == [[("a", "=", 1), ("a", "=", 2)], [("b", "<>", 3)], [("b", "<>", 4)]]


def test_inference(spark):
    df = spark.createDataFrame(
        [("1", "1", "1.5", "2020-01-01", "2020-01-01 10:00:00", "true", '{"a": 1}', "x", "", "10:30", "99999999999999999999"), ("2", "3000000000", "2e3", "2021-02-03", "2020-01-01T10:00:00.5", "f", "[1]", "1", None, "1:02:03", "1")],
        ", ".join(f"c{i} string" for i in range(11)),
    )
    kinds = [c.type for c in infer_schema(df)]
    assert kinds == ["integer", "bigint", "numeric", "date", "timestamp", "boolean", "json", "character varying", "character varying", "time", "numeric"]
    assert apply_schema(df, infer_schema(df)).dtypes[0][1] == "int"
    assert [c.type for c in infer_schema(df.limit(0))] == ["character varying"] * 11
    assert unique_names(["a", "", "a", None, "x" * 70, "x" * 70]) == ["a", "col_2", "a_000", "col_4", "x" * 63, "x" * 59 + "_000"]


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id;name;when\n1;"a;b";2020-01-01\n\n2;"";2020-01-02\n3;c\n4;d;2020-01-04;more\n')
    df = csvfiles.read_csv(spark, f"file://{p}")
    assert df.dtypes == [("id", "int"), ("name", "string"), ("when", "date")]
    assert [(r.id, r.name, str(r.when)) for r in df.orderBy("id").collect()] == [(1, "a;b", "2020-01-01"), (2, None, "2020-01-02"), (3, "c", "None"), (4, "d", "2020-01-04")]
    q = tmp_path / "latin.csv"
    q.write_bytes("k,v\n1,é\n2,ü\n".encode("latin-1"))
    assert csvfiles.sniff(str(q))["encoding"] == "iso-8859-1"
    assert rows(csvfiles.read_csv(spark, f"file://{q}")) == [(1, "é"), (2, "ü")]
    n = tmp_path / "numbers.csv"
    n.write_text("5.1,3.5,setosa\n4.9,3.0,virginica\n")
    assert csvfiles.read_csv(spark, f"file://{n}").columns == ["col_1", "col_2", "col_3"]
    csvfiles.write_csv(df, f"file://{tmp_path}/out")
    assert csvfiles.read_csv(spark, f"file://{tmp_path}/out", delimiter=",", header=True, names=["id", "name", "when"]).count() == 4


def test_upserts(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert rows(loading.merge_rows(a, b, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(loading.merge_rows(a.select("k"), b.select("k"), ["k"])) == [(1,), (2,), (3,)]
    with pytest.raises(SchemaError):
        loading.merge_rows(a, b.withColumn("x", F.lit(1)), ["k"])


def test_sync_by_cursor(spark, root):
    repo = Repository(Catalog(spark, root), "ingest")
    day1 = spark.createDataFrame([(1, 5, "a"), (1, 7, "b")], "d int, n int, v string")
    day2 = spark.createDataFrame([(1, 7, "b"), (1, 8, "c"), (2, 1, "d")], "d int, n int, v string")
    loading.sync(repo, {"t": day1}, {"t": ["d", "n"]})
    assert loading.load_state(repo) == {"cursors": {"t": [1, 7]}}
    loading.sync(repo, {"t": day2}, {"t": ["d", "n"]})
    assert rows(repo.table("latest", "t").read()) == [(1, 5, "a"), (1, 7, "b"), (1, 8, "c"), (2, 1, "d")]
    loading.sync(repo, {"t": day2.limit(0)}, {"t": ["d", "n"]})
    assert loading.load_state(repo)["cursors"]["t"] == [2, 1]
    with pytest.raises(SchemaError):
        loading.sync(repo, {"t": day2.drop("v")}, {"t": ["d", "n"]})


def test_to_table_and_pandas(spark, root):
    repo = Repository(Catalog(spark, root), "frames")
    df, schema = loading.from_pandas(spark, pd.DataFrame({"k": [1, 2], "v": ["a", "b"]}).set_index("k"))
    assert [c.name for c in schema if c.is_pk] == ["k"]
    loading.to_table(repo, "t", df, pk=("k",))
    loading.to_table(repo, "t", spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string"), "patch")
    assert loading.to_pandas(repo, "SELECT k, v FROM t ORDER BY k").values.tolist() == [[1, "a"], [2, "B"], [3, "C"]]
    assert len(repo.images["latest"].tables["t"].objects) == 2
    with pytest.raises(SchemaError):
        loading.to_table(repo, "t", spark.range(1), "patch")
    assert loading.introspect({"a": lambda: df, "b": lambda: 1 / 0})["b"].startswith("ZeroDivisionError")
    assert loading.preview({"a": lambda: df}, 1) == {"a": [{"k": 1, "v": "a"}]}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, price REAL, raw BLOB)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, f"n{i}", i / 2, b"x") for i in range(1, 1001)])
        db.execute("CREATE TABLE loose (a, b)")
    assert list(loading.sqlite_schema(path)) == ["t"]
    df = loading.read_sqlite(spark, path, "t", page=70, partitions=3)
    assert df.count() == 1000 and df.agg(F.sum("id"), F.sum("price")).first()[:] == (500500, 250250.0)


def test_messages(spark, root, tmp_path):
    schema = {"type": "SCHEMA", "stream": "users", "key_properties": ["id"], "schema": {"properties": {"id": {"type": "integer"}, "user": {"properties": {"name": {"type": ["null", "string"]}, "age": {"type": "integer"}}}}}}
    record = lambda i, n, a, **x: {"type": "RECORD", "stream": "users", "record": {"id": i, "user": {"name": n, "age": a}, **x}}
    first = [schema, record(1, "ann", 3), record(2, "bob", 4), record(2, "rob", 5), {"type": "STATE", "value": {"at": 1}}]
    second = [schema, record(2, "rob", 6), record(1, None, None, _sdc_removed_at="2020-01-01"), record(3, "eve", 1)]
    wider = json.loads(json.dumps(schema))
    wider["schema"]["properties"]["mail"] = {"type": "string"}
    third = [wider, {"type": "RECORD", "stream": "users", "record": {"id": 4, "user": {"name": "dan", "age": 9}, "mail": "d@x"}}]
    repo = Repository(Catalog(spark, root), "stream")
    for i, part in enumerate((first, second, third)):
        p = tmp_path / f"{i}.json"
        p.write_text("\n".join(json.dumps(m) for m in part))
        messages.load_messages(repo, f"file://{p}")
        if i == 0:
            assert loading.load_state(repo) == {"at": 1}
    got = rows(repo.table("latest", "users").read(["id", "user__name", "user__age", "mail"]))
    assert got == [(2, "rob", 6, None), (3, "eve", 1, None), (4, "dan", 9, "d@x")]
    with pytest.raises(ValueError):
        messages.flatten({"properties": {"a": {"properties": {"b": {}}}, "a__b": {}}}, most=2)


def test_raw_and_dedup(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert rows(messages.append_dedup(df, ["k"], ["t"])) == [(1, 2, "b"), (2, 1, "c")]
    raw = messages.raw_table(spark.createDataFrame([('{"a":1}', 5)], "data string, emitted_at long"))
    assert raw.columns == ["_raw_id", "_emitted_at", "_raw_data"]
    stream = {"supported_sync_modes": ["full_refresh", "incremental"], "default_cursor_field": ["t"]}
    assert messages.stream_settings(stream)["mode"] == "full_refresh"
    assert messages.stream_settings(stream, {"primary_key": ["x"]}, {"primary_key": ["k"]}) == {"primary_key": ["k"], "cursor_field": ["t"], "mode": "incremental"}


def test_remote_translation():
    q = remote.soql_query(["a"], [[("a", "=", "it's")], [("b", ">", 1), ("c", "like", "x%")], [("d", "weird", 1)]], [("a", True, True)], limit=5, names={"a": "A"})
    assert q == {"$select": "`A`", "$where": "(`A` = 'it''s') AND (`b` > 1 OR `c` LIKE 'x%')", "$order": "`A` DESC, :id", "$limit": "5"}
    assert remote.soql_order([("a", False, True)]) is None
    o = remote.jdbc_options("postgresql", "h", "d", table="t", partition=("k", 0, 9, 3))
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["numPartitions"] == "3"
    with pytest.raises(ValueError):
        remote.jdbc_options("mysql", "h", "d")


def test_adapters(spark):
    df = spark.createDataFrame([("a#12", None), ("b#1#2", 3)], "s string, n int")
    s = F.col("s")
    assert [r[0] for r in df.select(pg.substring_from(s, 0, 3)).collect()] == ["a#", "b#"]
    assert [r[0] for r in df.select(pg.substring_regex(s, "([a-z])#1#")).collect()] == [None, "b"]
    assert [r[0] for r in df.select(pg.regexp_replace_first(s, "([a-z])#([0-9])", r"\2\1")).collect()] == ["1a2", "1b#2"]
    assert [r[0] for r in df.select(pg.regexp_replace_first(s, "#", "-", every=True)).collect()] == ["a-12", "b-1-2"]
    assert [r[0] for r in df.orderBy(pg.order("n")).select("n").collect()] == [3, None]
    assert df.select(pg.to_char(F.lit("2020-03-04").cast("date"), "DD.MM.YYYY")).first()[0] == "04.03.2020"
    assert df.select(pg.div(F.lit(-7), F.lit(2))).first()[0] == -3


def test_eviction(spark):
    objects = [("a", 100, 10.0, False), ("b", 10**8, 0.0, False), ("c", 50, 5.0, True), ("d", 200, 9e5, False)]
    assert evict(objects, 120, 1000) == ["c", "d"]
    with pytest.raises(ValueError):
        evict(objects, 10**9, 10)
    df = spark.createDataFrame(objects, "id string, size long, idle double, orphan boolean")
    assert [r.id for r in eviction_order(df).orderBy("freed").collect()] == ["c", "d", "a", "b"]


def test_stream_commits_each_batch_once(spark, root, tmp_path):
    repo = Repository(Catalog(spark, root), "feed")
    write = commit_batches(repo, "t", ["k"], ["n"])
    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, n int, v string")
    one.write.parquet(f"{tmp_path}/in")
    q = spark.readStream.schema(one.schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    before = repo.images["latest"].hash
    write(one, 0)
    assert repo.images["latest"].hash == before
    write(spark.createDataFrame([(2, 5, "C")], one.schema), 1)
    assert rows(repo.table("latest", "t").read()) == [(1, 2, "b"), (2, 5, "C")]
    assert rows(changes_since(repo, "t", before)) == [(False, 2, 1, "c"), (True, 2, 5, "C")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), max_size=12))
def test_chunk_groups_are_disjoint_and_whole(pairs):
    chunks = [(i, a, a + n) for i, (a, n) in enumerate(pairs)]
    groups = chunk_groups(chunks)
    assert sorted(c[0] for g in groups for c in g) == list(range(len(chunks)))
    ends = [(min(c[1] for c in g), max(c[2] for c in g)) for g in groups]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_missing_things(spark, root):
    repo = Repository(Catalog(spark, root), "none")
    repo.init()
    with pytest.raises(NotFound):
        repo.table("latest", "t")
    with pytest.raises(ValueError):
        Repository(repo.catalog, "bad name!")
    with pytest.raises(ValueError):
        repo.init()
    assert schema_of(spark.range(1).schema) == [Column(1, "id", "bigint")]


def test_json_and_arrays(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [5, 6]}, "d": null, "t": true}', [1, 2]), (2, None, [3])], "k int, j string, a array<int>")
    j = F.col("j")
    one = df.select(pg.json_text(j, "b", "c", 1), pg.json_has_key(j, "d"), pg.json_has_key(j, "x"), pg.json_contains(j, {"a": 1, "t": True, "d": None}), pg.json_contains(j, {"a": 2}), pg.contained(F.array(F.lit(2)), F.col("a"))).collect()
    assert tuple(one[0]) == ("6", True, False, True, False, True) and one[1][3] is None and one[1][5] is False
    assert [tuple(r) for r in pg.json_each(df, "j", ["k"]).where("key = 'a'").collect()] == [(1, "a", "1")]
    assert pg.json_elements(spark.createDataFrame([("[1,[2]]",)], "j string"), "j", []).count() == 2
    assert df.agg(pg.json_object_agg(F.col("k"), F.size("a"))).first()[0] == '{"1":2,"2":1}'
    b = F.lit("A~").cast("binary")
    assert tuple(df.select(pg.byte_at(b, 1), pg.encode_hex(b)).first()) == (126, "417e")


def test_source_plugins(spark, root, tmp_path):
    from lamina.sources.base import SOURCES, SourceError

    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    spark.range(4).write.parquet(f"{tmp_path}/p")
    csv = SOURCES["csv"](spark, paths={"a": f"file://{tmp_path}/a.csv", "b": f"file://{tmp_path}/missing.csv"})
    found = csv.introspect()
    assert [c.name for c in found["a"]] == ["k", "v"] and "FileNotFound" in found["b"]
    assert csv.preview(1)["a"] == [{"k": 1, "v": "x"}]
    repo = Repository(Catalog(spark, root), "plug")
    csv.load(repo, ["a"], {"a": ["k"]})
    assert rows(repo.table("latest", "a").read()) == [(1, "x"), (2, "y")]
    files = SOURCES["files"](spark, paths={"p": f"file://{tmp_path}/p"}, format="parquet")
    files.sync(repo, {"p": ["id"]})
    files.sync(repo, {"p": ["id"]})
    assert repo.table("latest", "p").count() == 4
    assert files.mount() == {"p": "p"} and spark.table("p").count() == 4
    spark.catalog.dropTempView("p")
    image = Builder(repo.catalog).run(f"FROM EMPTY AS mounted\nFROM MOUNT csv '{{\"paths\": {{\"a\": \"file://{tmp_path}/a.csv\"}}}}' IMPORT a")
    assert Repository(repo.catalog, "mounted").table(image, "a").count() == 2
    with pytest.raises(SourceError):
        SOURCES["csv"](spark, path="x")
    assert SOURCES["frames"](spark, frames={"f": [(1,)]}).introspect()["f"][0].name == "_1"
    assert set(SOURCES["jdbc"](spark, kind="mysql", host="h", database="d", tables=["t"], queries={"q": "SELECT 1"}).tables()) == {"t", "q"}


@pytest.mark.parametrize(
    "sql",
    [
        "CREATE TABLE x AS SELECT * FROM pg_catalog.pg_class",
        "INSERT INTO t SELECT * FROM other.secret",
        "INSERT INTO t (a) WITH q AS (SELECT * FROM other.secret) SELECT a FROM q",
        "UPDATE t SET a = (SELECT max(b) FROM information_schema.tables)",
        "DELETE FROM t WHERE a IN (SELECT a FROM other.t)",
        "INSERT INTO other.t VALUES (1)",
        "DROP TABLE other.t",
        "CREATE TABLE other.x (a int)",
    ],
)
def test_every_relation_of_every_statement_is_checked(spark, sql):
    with pytest.raises(sqlguard.ForbiddenSQL):
        sqlguard.check_script(spark, sql)


def test_unknown_names_never_reach_the_session(spark):
    spark.range(3).createOrReplaceTempView("outside")
    try:
        for sql in ("SELECT * FROM outside", "SELECT * FROM t WHERE a IN (SELECT id FROM outside)", "WITH q AS (SELECT * FROM outside) SELECT * FROM q", "SELECT * FROM parquet.`/tmp/x`"):
            with pytest.raises(sqlguard.ForbiddenSQL):
                run_sql(spark, sql, {"t": lambda: spark.range(2).toDF("a")})
        assert run_sql(spark, "WITH outside AS (SELECT * FROM T) SELECT * FROM outside", {"t": lambda: spark.range(2).toDF("a")}).count() == 2
    finally:
        spark.catalog.dropTempView("outside")


def test_dialect_forms(spark):
    t = {"t": lambda: spark.createDataFrame([(7, 2, "AA12", None), (-7, 2, "xx", 3), (8, 3, "AA12AA34", 1)], "a int, b bigint, f string, n int")}
    one = lambda sql: [tuple(r) for r in run_sql(spark, sql, t).collect()]
    assert one("SELECT a / b, a / 2.0::numeric(4,2) = 3.5, a::float8 / b FROM t WHERE a = 7") == [(3, True, 3.5)]
    assert one("SELECT (SELECT max(a) / 3 FROM t), CASE WHEN a / 2 = -3 THEN 'cut' END FROM t WHERE a < 0") == [(2, "cut")]
    assert one("SELECT substring('abcdef' from 0 for 6), substring(f from 'AA([0-9]+)'), regexp_replace(f, '(AA)([0-9]+)', '\\2\\1') FROM t WHERE a = 7") == [("abcde", "12", "12AA")]
    assert one("SELECT regexp_replace(f, '(AA)([0-9]+)', '\\2\\1'), regexp_replace(f, '(AA)([0-9]+)', '\\2\\1', 'g') FROM t WHERE a = 8") == [("12AAAA34", "12AA34AA")]
    assert one("SELECT n FROM t ORDER BY n") == [(1,), (3,), (None,)] and one("SELECT n FROM t ORDER BY n DESC LIMIT 1") == [(None,)]
    assert one("SELECT DISTINCT ON (b) b, a FROM t ORDER BY b DESC, a LIMIT 1") == [(3, 8)]
    assert one("SELECT to_char(timestamp '2020-03-01 04:05:06', 'FMDD Mon YYYY \"at\" HH12 AM')") == [("1 Mar 2020 at 04 AM",)]
    assert one("SELECT 2.5::numeric(3,1)::int, 2.5::float8::int, (-2.5)::numeric(3,1)::int, '4'::int") == [(3, 2, -3, 4)]
    assert one("SELECT transform(array(1, 2), x -> x + 1), '{\"k\": [5]}'::json->'k'->>0") == [([2, 3], "5")]
    assert one("SELECT sum(g) FROM generate_series(1, 4) AS s(g)") == [(10,)]
    assert not spark.sql("SHOW USER FUNCTIONS").where("function LIKE '%lamina%'").count()


def test_messages_keep_the_order_of_files(sales, tmp_path):
    spark, folder = sales.catalog.spark, tmp_path / "messages"
    folder.mkdir()
    head = json.dumps({"type": "SCHEMA", "stream": "s", "key_properties": ["k"], "schema": {"properties": {"k": {"type": "integer"}, "v": {"type": "string"}}}})
    record = lambda k, v: json.dumps({"type": "RECORD", "stream": "s", "record": {"k": k, "v": v}})
    (folder / "001.json").write_text("\n".join([head, record(1, "old"), record(2, "a"), record(2, "b")]))
    (folder / "002.json").write_text("\n".join([head, record(1, "new"), *[record(100 + i, "x" * 50) for i in range(500)]]))
    repo = Repository(sales.catalog, "shop/messages")
    messages.load_messages(repo, f"file://{folder}")
    got = {r.k: r.v for r in repo.table("latest", "s").read().collect()}
    assert got[1] == "new" and got[2] == "b" and len(got) == 502
