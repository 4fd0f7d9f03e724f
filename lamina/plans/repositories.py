"""Queries on what repositories, builds and sources do to tables; each makes repositories of its own."""

from __future__ import annotations

import json
import threading
import urllib.parse
import uuid
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import build, external
from lamina.catalog import Catalog, TableVersion
from lamina.fragments import write_base
from lamina.operators.tracing import Tracer
from lamina.plans.models import run_models
from lamina.repo import Repository, lookup, run_sql
from lamina.runtime import scratch_path, table
from lamina.scan import TableScan
from lamina.sources import loading, messages, webapi
from lamina.sources.base import FilesSource, FramesSource, StreamsSource
from lamina.sources.csvfiles import read_csv, write_csv
from lamina.sources.inference import unique_names
from lamina.types import Column, schema_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def fresh(spark: SparkSession, name: str = "demo/own", **catalog) -> Repository:
    repo = Repository(Catalog(spark, scratch_path(spark, "repo"), **catalog), name)
    repo.init()
    return repo


def with_nations(spark: SparkSession, sf_dir: str) -> Repository:
    """A repository to which each region's nations were committed one after the other, tagged by region."""
    repo = fresh(spark)
    nation = table(spark, sf_dir, "nation")
    repo.work.create("nation", nation.where("false"), ("n_nationkey",))
    repo.images.tag(repo.commit(comment="empty").hash, "start")
    for r in range(5):
        repo.work.insert("nation", nation.where(F.col("n_regionkey") == r))
        repo.images.tag(repo.commit(comment=f"region {r}").hash, f"r{r}")
    return repo


@query("SELECT r_regionkey AS region, (SELECT count(*) FROM region b WHERE b.r_regionkey > a.r_regionkey) AS below, (SELECT count(*) FROM region b WHERE b.r_regionkey < a.r_regionkey) + 3 AS log, (SELECT count(*) FROM nation WHERE n_regionkey <= r_regionkey) AS n FROM region a")
def image_history(spark, sf_dir):
    """Descendants, log, and rows of each image of a chain; the log ends with the image of the empty table and the root."""
    repo = with_nations(spark, sf_dir)
    out = []
    for r in range(5):
        h = repo.images[f"r{r}"].hash
        parent, children = repo.images.parent_children(h)
        assert parent == repo.images[f"r{r - 1}" if r else "start"].hash and len(children) == (r < 4)
        out.append((r, len(repo.images.descendants(h) - {h}), len(repo.images.log(h)), repo.table(h, "nation").count()))
    assert len(repo.images.tree().splitlines()) == 7
    return spark.createDataFrame(out, "region int, below long, log long, n long")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <= 2")
def pruned_images(spark, sf_dir):
    """Images beyond a tag deleted, their objects cleaned up; what the tag reaches stays readable."""
    repo = with_nations(spark, sf_dir)
    repo.checkout("r2", force=True)
    for r in (3, 4):
        repo.images.untag(f"r{r}")
    gone = repo.images.prune()
    removed = repo.catalog.cleanup()
    assert len(gone) == 2 and len(removed) == 2 and repo.catalog.unused_objects().isEmpty()
    again = Repository(Catalog(spark, repo.catalog.store.root), repo.name)
    return again.table("latest", "nation").read()


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def deleted_image(spark, sf_dir):
    """Rows that each region's image adds to the one before; the last image is deleted with all that depends on it first."""
    repo = with_nations(spark, sf_dir)
    counts = [(r, repo.table(f"r{r}", "nation").count() - repo.table(f"r{r - 1}" if r else "start", "nation").count()) for r in range(5)]
    repo.images.delete(repo.images.descendants(repo.images["r4"].hash) | {repo.images["r4"].hash})
    assert repo.images.by_tag("r4") is None and repo.images["latest"].hash == repo.images["r3"].hash
    return spark.createDataFrame(counts, "n_regionkey int, n long")


@query("SELECT * FROM customer")
def cloned_repository(spark, sf_dir):
    repo = fresh(spark)
    repo.import_frame("customer", table(spark, sf_dir, "customer"), ("c_custkey",), chunk_size=200)
    repo.images.tag(repo.images["latest"].hash, "v1")
    copy = repo.clone("demo/copy", Catalog(spark, scratch_path(spark, "copy")))
    return copy.table("v1", "customer").read()


@query("SELECT n_nationkey, n_name, CAST(n_regionkey + CASE WHEN n_regionkey = 1 THEN 10 ELSE 0 END AS INTEGER) AS n_regionkey FROM nation")
def pushed_and_pulled(spark, sf_dir):
    """A change pushed to another root, and pulled into a third that was cloned before it."""
    repo = fresh(spark)
    repo.import_frame("nation", table(spark, sf_dir, "nation"), ("n_nationkey",))
    hub = Repository(Catalog(spark, scratch_path(spark, "hub")), "demo/hub")
    repo.push(hub)
    third = hub.clone("demo/third", Catalog(spark, scratch_path(spark, "third")))
    repo.work.update("nation", {"n_regionkey": "n_regionkey + 10"}, "n_regionkey = 1")
    repo.commit()
    assert len(repo.push(hub)) == 1 and repo.images.upstream().endswith("#demo/hub") and len(third.pull()) == 1
    return third.table("latest", "nation").read()


@query("SELECT * FROM part WHERE p_size <> 10")
def dumped_and_loaded(spark, sf_dir):
    repo = fresh(spark)
    repo.import_frame("part", table(spark, sf_dir, "part"), ("p_partkey",), chunk_size=300)
    repo.work.delete("part", "p_size = 10")
    repo.images.tag(repo.commit().hash, "small")
    path = repo.dump(scratch_path(spark, "dump") + ".json", contents=True)
    other = Repository(Catalog(spark, scratch_path(spark, "loaded")), "demo/loaded")
    other.load_dump(path)
    return other.table("small", "part").read()


@query("SELECT * FROM supplier")
def imported_from_another_root(spark, sf_dir):
    repo = fresh(spark)
    repo.import_frame("supplier", table(spark, sf_dir, "supplier"), ("s_suppkey",))
    other = fresh(spark, "demo/importer")
    other.import_from_remote(repo, "latest", ["supplier"], ["suppliers"])
    return other.table("latest", "suppliers").read()


@query("SELECT CAST(c_custkey + 1 AS BIGINT) AS c_custkey, c_name FROM customer WHERE c_custkey <> 3")
def moved_keys(spark, sf_dir):
    """Every key passed on to the next row, and one row deleted, in one change set."""
    repo = fresh(spark)
    repo.import_frame("c", table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS c_custkey", "c_name"), ("c_custkey",), chunk_size=400)
    repo.work.delete("c", "c_custkey = 3")
    repo.work.update("c", {"c_custkey": "c_custkey + 1"})
    repo.commit()
    return repo.table("latest", "c").read()


@query("""SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2
UNION ALL SELECT CAST(n_nationkey + 100 AS INTEGER), n_name, n_regionkey FROM nation WHERE n_regionkey = 1""")
def rows_laid_over(spark, sf_dir):
    """Rows written over a table without reading it, some twice, then committed as a patch."""
    repo, nation = fresh(spark), table(spark, sf_dir, "nation")
    repo.import_frame("nation", nation, ("n_nationkey",))
    work = repo.work
    work.upper("nation", nation.where("n_regionkey = 0").withColumn("n_name", F.lit("x")))
    work.upper("nation", nation.where("n_regionkey = 0").withColumn("n_name", F.lower("n_name")))
    work.upper("nation", nation.where("n_regionkey = 1").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    work.upper("nation", nation.where("n_regionkey = 2"), flag=False)
    before = {tuple(r) for r in work.table("nation").collect()}
    repo.commit()
    out = repo.table("latest", "nation").read()
    assert {tuple(r) for r in out.collect()} == before
    return out


@query("SELECT n_nationkey, upper(substr(n_name, 1, 3)) AS code FROM nation")
def altered_table(spark, sf_dir):
    """Columns added and dropped by statements; the schema decides that the table is stored anew."""
    repo = fresh(spark)
    repo.import_frame("nation", table(spark, sf_dir, "nation"), ("n_nationkey",))
    assert not repo.has_pending_changes()
    repo.work.sql("ALTER TABLE nation ADD COLUMN code text; UPDATE nation SET code = upper(substring(n_name from 1 for 3)); ALTER TABLE nation DROP COLUMN n_name; ALTER TABLE nation DROP COLUMN n_regionkey")
    assert repo.work.has_pending()
    repo.commit()
    repo.uncheckout()
    return repo.table("latest", "nation").read()


@query("SELECT chunk, CAST(min(o_custkey) AS BIGINT) AS lo_cust, CAST(max(o_custkey) AS BIGINT) AS hi_cust, min(o_orderpriority) AS lo_prio, max(o_orderpriority) AS hi_prio, min(o_totalprice) AS lo_price, max(o_totalprice) AS hi_price, CAST(min(o_orderkey) AS BIGINT) AS lo_key, CAST(max(o_orderkey) AS BIGINT) AS hi_key, count(*) AS n FROM (SELECT *, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS BIGINT) AS chunk FROM orders) t GROUP BY chunk")
def range_index(spark, sf_dir):
    """Ranges that the index of each object holds."""
    catalog, orders = Catalog(spark, scratch_path(spark, "ranges")), table(spark, sf_dir, "orders")
    schema = schema_of(orders.schema, ("o_orderkey",))
    out = []
    for i, m in enumerate(catalog.objects(write_base(catalog, orders, schema, 500))):
        r = m.index["range"]
        out.append((i, *r["o_custkey"], *r["o_orderpriority"], *map(float, r["o_totalprice"]), *r["o_orderkey"], m.rows_inserted))
    return spark.createDataFrame(out, "chunk long, lo_cust long, hi_cust long, lo_prio string, hi_prio string, lo_price double, hi_price double, lo_key long, hi_key long, n long")


@query("SELECT chunk, CAST(arg_min(o_custkey, rn) AS BIGINT) AS lo_cust, CAST(arg_min(o_orderkey, rn) AS BIGINT) AS lo_order, CAST(arg_max(o_custkey, rn) AS BIGINT) AS hi_cust, CAST(arg_max(o_orderkey, rn) AS BIGINT) AS hi_order FROM (SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rn, CAST((row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 500 AS BIGINT) AS chunk FROM orders) t GROUP BY chunk")
def composite_key_range(spark, sf_dir):
    """Least and greatest key of objects whose key has two columns, as planning reads them."""
    from lamina.indexing import key_range

    catalog, orders = Catalog(spark, scratch_path(spark, "pairs")), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    schema = schema_of(orders.schema, ("o_custkey", "o_orderkey"))
    found = [key_range(m, schema) for m in catalog.objects(write_base(catalog, orders, schema, 500))]
    return spark.createDataFrame([(i, lo[0], lo[1], hi[0], hi[1]) for i, (lo, hi) in enumerate(found)], "chunk long, lo_cust long, lo_order long, hi_cust long, hi_order long")


@query("SELECT c_custkey, c_name, true AS pruned FROM customer WHERE c_name IN (SELECT max(c_name) FROM customer WHERE c_custkey < 700)")
def bloom_scan(spark, sf_dir):
    """A name that no range tells apart, found by bloom filters."""
    repo, customer = fresh(spark), table(spark, sf_dir, "customer").selectExpr("hash(c_custkey) AS h", "c_custkey", "c_name")
    repo.work.create("c", customer, ("h", "c_custkey"))
    repo.commit(chunk_size=100, indexes={"c": {"range": [], "bloom": {"c_name": {"probability": 0.001}}}})
    name = customer.where("c_custkey < 700").agg(F.max("c_name")).first()[0]
    t = repo.table("latest", "c")
    plan = t.plan([[("c_name", "=", name)]])
    return t.read(["c_custkey", "c_name"], [[("c_name", "=", name)]]).withColumn("pruned", F.lit(len(plan.required) < plan.total))


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 3 AND 5")
def reindexed_scan(spark, sf_dir):
    """Indexes added to objects that had none, used by the next plan."""
    repo, part = fresh(spark), table(spark, sf_dir, "part")
    repo.work.create("part", part, ("p_partkey",))
    repo.commit(chunk_size=100, indexes={"part": {"range": []}})
    quals = [[("p_size", ">=", 3)], [("p_size", "<=", 5)]]
    before = repo.table("latest", "part").plan(quals)
    repo.reindex("latest", "part", {"range": ["p_size"], "bloom": {"p_brand": {"size": 64}}})
    t = TableScan(Catalog(spark, repo.catalog.store.root), repo.images["latest"].tables["part"])
    assert "Range" in " ".join(t.plan(quals).explain()) and len(t.plan(quals).required) <= len(before.required) and t.plan(quals) is t.plan(quals) and t.planned == 1
    return t.read(["p_partkey", "p_size"], quals)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 9")
def external_scan(spark, sf_dir):
    """Objects moved to other storage, claimed in a cache that holds half of them, and read in place."""
    repo = fresh(spark)
    repo.import_frame("nation", table(spark, sf_dir, "nation"), ("n_nationkey",), chunk_size=5)
    ids = repo.images["latest"].tables["nation"].objects
    assert external.make_external(repo.catalog, ids, root=scratch_path(spark, "bucket")) == ids
    catalog = Catalog(spark, repo.catalog.store.root)
    sizes = sum(m.size for m in catalog.objects(ids))
    cache, trace = external.ObjectCache(catalog, scratch_path(spark, "cache"), sizes // 2), Tracer()
    t = TableScan(catalog, repo.images["latest"].tables["nation"])
    plan = t.plan([[("n_nationkey", "<", 9)]])
    with cache.ensure([m.id for m in plan.required]) as fetched:
        trace.log("fetched")
        assert len(fetched) == len(plan.required) == 2 and cache.used() <= sizes // 2
        rows = t.read(["n_nationkey", "n_name"], [[("n_nationkey", "<", 9)]]).collect()
    for i in ids:  # one by one through a small cache: the least worth keeping go
        with cache.ensure([i]):
            assert cache.used() <= sizes // 2
    return spark.createDataFrame(rows, "n_nationkey int, n_name string")


@query("SELECT n_name, count(*) AS n FROM (SELECT r.n_regionkey AS r, n.n_name FROM nation r JOIN nation n ON n.n_nationkey = r.n_nationkey WHERE r.n_regionkey <= 1) t GROUP BY n_name")
def two_images_join(spark, sf_dir):
    """One statement of a build over two images of one repository."""
    repo = with_nations(spark, sf_dir)
    build.Builder(repo.catalog).run('FROM EMPTY AS demo/joined\nSQL {CREATE TABLE j AS SELECT b.n_name, count(*) AS n FROM "demo/own:r1".nation a JOIN "demo/own:r4".nation b ON a.n_nationkey = b.n_nationkey GROUP BY b.n_name}')
    return Repository(repo.catalog, "demo/joined").table("latest", "j").read()


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 250000")
def two_sources_join(spark, sf_dir):
    """One statement over tables of two source plugins."""
    files = FilesSource(spark, paths={"orders": f"{sf_dir}/orders.parquet"}, format="parquet").tables()
    frames = FramesSource(spark, frames={"customer": table(spark, sf_dir, "customer")}).tables()
    return run_sql(spark, "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 250000", files | frames)


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey <= 3 GROUP BY n_regionkey")
def rebuilt_image(spark, sf_dir):
    """Layers of a build that exist aren't run again; a rebuild on another version of the source is."""
    repo = with_nations(spark, sf_dir)
    text = "FROM EMPTY AS demo/built\nFROM demo/own:${TAG} IMPORT nation\nSQL {CREATE TABLE g AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey}"
    first = build.Builder(repo.catalog)
    image = first.run(text, {"TAG": "r1"})
    built = Repository(repo.catalog, "demo/built")
    again = build.Builder(repo.catalog)
    again.repo = built
    built.checkout("0" * 64, force=True)
    assert again.run(text.split("\n", 1)[1], {"TAG": "r1"}).hash == image.hash and (first.ran, again.ran, again.cached) == (2, 0, 2)
    made = build.rebuild(built, image.hash, {"demo/own": "r3"})
    return built.table(made.hash, "g").read()


@query("SELECT r_regionkey AS k, r_name AS v FROM region")
def custom_command(spark, sf_dir):
    """A build with a command of one's own and a mounted source."""

    class Loud(build.Command):
        def calc_hash(self, repo, args):
            return args[0]

        def execute(self, repo, work, args):
            work.sql(f"UPDATE {args[0]} SET v = upper(v)")

    catalog = Catalog(spark, scratch_path(spark, "commands"))
    build.COMMANDS["LOUD"] = Loud()
    build.MOUNTS["regions"] = lambda spark, lower: {"m": table(spark, sf_dir, "region").selectExpr("r_regionkey AS k", "lower(r_name) AS v" if lower else "r_name AS v")}
    build.Builder(catalog).run("FROM EMPTY AS demo/loud\nFROM MOUNT regions '{\"lower\": true}' IMPORT {SELECT k, v FROM m} AS t\nLOUD t")
    return Repository(catalog, "demo/loud").table("latest", "t").read()


@query("SELECT event_id, user_id, ts FROM events")
def incremental_sync(spark, sf_dir):
    """Half of the events, then all of them again: the cursor in the image's state lets only the new ones in."""
    repo, events = fresh(spark), table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    half = events.where(F.col("event_id") % 1 == 0).where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    loading.sync(repo, {"events": half}, {"events": ["ts", "event_id"]}, chunk_size=300)
    loading.sync(repo, {"events": events}, {"events": ["ts", "event_id"]}, chunk_size=300)
    return repo.table("latest", "events").read()


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' ELSE p_name END AS p_name FROM part WHERE p_size <> 7")
def blind_upserts(spark, sf_dir):
    """Rows replaced and deleted by key alone, without reading the table."""
    repo, part = fresh(spark), table(spark, sf_dir, "part")
    repo.import_frame("p", part.select("p_partkey", "p_name"), ("p_partkey",), chunk_size=400)
    loading.blind_upsert(repo, "p", part.where("p_size > 40").select("p_partkey", F.lit("big").alias("p_name")), part.where("p_size = 7").select("p_partkey"))
    return repo.table("latest", "p").read()


@query("SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS place FROM information_schema.columns WHERE table_name IN ('customer', 'events', 'part')")
def introspected_tables(spark, sf_dir):
    source = FilesSource(spark, paths={t: f"{sf_dir}/{t}.parquet" for t in ("customer", "events", "part")}, format="parquet")
    assert all(len(rows) == 3 for rows in source.preview(3).values())
    return spark.createDataFrame([(t, c.name, c.ordinal) for t, schema in source.introspect().items() for c in schema], "table_name string, column_name string, place int")


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS extra, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def migrated_schema(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    target = [Column(1, "n_nationkey", "integer", True), Column(2, "n_name", "character varying"), Column(3, "extra", "character varying"), Column(4, "n_regionkey", "character varying")]
    return loading.migrate(nation, target)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST(n_nationkey + 50 AS INTEGER), n_name, n_regionkey FROM nation WHERE n_regionkey = 4")
def pandas_patch(spark, sf_dir):
    """A table to pandas and back, patched by key."""
    repo, nation = fresh(spark), table(spark, sf_dir, "nation")
    loading.to_table(repo, "nation", nation, pk=("n_nationkey",))
    pdf = loading.to_pandas(repo, "SELECT * FROM nation WHERE n_regionkey = 4", "latest").reset_index()
    pdf["n_nationkey"] += 50
    loading.to_table(repo, "nation", spark.createDataFrame(pdf[["n_nationkey", "n_name", "n_regionkey"]]), if_exists="patch", pk=("n_nationkey",))
    return repo.table("latest", "nation").read()


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_nationkey < 12 THEN upper(c_name) ELSE c_name END AS c_name, CAST(c_nationkey AS BIGINT) AS home__nation FROM customer WHERE c_nationkey <> 20")
def message_stream(spark, sf_dir):
    """Messages in files of unlike sizes: later ones hold over earlier ones, some take a row away."""
    customer = table(spark, sf_dir, "customer")
    head = json.dumps({"type": "SCHEMA", "stream": "c", "key_properties": ["c_custkey"], "schema": {"properties": {"c_custkey": {"type": "integer"}, "c_name": {"type": "string"}, "home": {"properties": {"nation": {"type": "integer"}}}}}})

    def record(name, extra=""):
        body = F.struct("c_custkey", name.alias("c_name"), F.struct(F.col("c_nationkey").alias("nation")).alias("home"), *([F.lit("2024-01-01").alias(extra)] if extra else []))
        return F.to_json(F.struct(F.lit("RECORD").alias("type"), F.lit("c").alias("stream"), body.alias("record"))).alias("value")

    folder = scratch_path(spark, "messages")
    files = [customer.where("c_nationkey < 12").select(record(F.lower("c_name"))), customer.where("c_nationkey >= 12").select(record(F.col("c_name"))), customer.where("c_nationkey < 12").select(record(F.upper("c_name"))), customer.where("c_nationkey = 20").select(record(F.col("c_name"), "_sdc_removed_at"))]
    for i, part in enumerate(files):
        # one message a line, in one file each, whose names give the order
        spark.createDataFrame([(head,)], "value string").unionByName(part).coalesce(1).write.text(f"{folder}/{i:03d}")
    repo = Repository(Catalog(spark, scratch_path(spark, "stream")), "demo/stream")
    messages.load_messages(repo, f"{folder}/*")
    return repo.table("latest", "c").read()


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(CAST(value AS DOUBLE), (ts, event_id)) AS value FROM events GROUP BY user_id")
def raw_stream(spark, sf_dir):
    """Raw JSON of events in two deliveries that overlap, kept as they came and deduplicated by key and cursor."""
    events = table(spark, sf_dir, "events")
    data = F.to_json(F.struct("user_id", "event_id", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts")))
    raw = messages.raw_table(events.select(data.alias("data"), F.col("event_id").alias("emitted_at")))
    kinds = {"user_id": {"type": "integer"}, "event_id": {"type": "integer"}, "value": {"type": "number"}, "ts": {"type": "string"}}
    stream = {"json_schema": {"properties": kinds}, "mode": "append_dedup", "primary_key": ["user_id"], "cursor_field": ["ts", "event_id"]}
    repo = Repository(Catalog(spark, scratch_path(spark, "raw")), "demo/raw")
    messages.sync_raw(repo, {"events": raw.where("_emitted_at % 3 < 2")}, {"events": stream})
    messages.sync_raw(repo, {"events": raw.where("_emitted_at % 3 > 0")}, {"events": stream})
    out = StreamsSource(spark, raw={"events": repo.table("latest", "_raw_events").read()}, streams={"events": stream}).tables()["events"]()
    assert out.count() == repo.table("latest", "events").count()
    return out.select("user_id", "event_id", F.col("value").cast("double").alias("value"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY c_mktsegment")
def sql_models(spark, sf_dir):
    """Models that refer to each other and to sources, run in order."""
    models = {
        "by_segment": "SELECT c.c_mktsegment, count(*) AS n, round(sum(b.o_totalprice), 2) AS total FROM {{ ref('big') }} b JOIN {{ source('shop', 'customer') }} c ON c.c_custkey = b.o_custkey GROUP BY c.c_mktsegment",
        "big": "SELECT o_custkey, o_totalprice FROM {{ source('shop', 'orders') }} WHERE o_totalprice > 100000",
    }
    repo = fresh(spark)
    run_models(repo, models, {("shop", t): (lambda t=t: table(spark, sf_dir, t)) for t in ("customer", "orders")}, materialize=["by_segment"])
    return repo.table("latest", "by_segment").read()


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def exported_query(spark, sf_dir):
    """A query's result exported as Parquet and as CSV, and read again."""
    repo = fresh(spark)
    repo.import_frame("orders", table(spark, sf_dir, "orders"), ("o_orderkey",))
    found, path = repo.sql("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority"), scratch_path(spark, "export")
    found.write.parquet(f"{path}/parquet")
    write_csv(spark.read.parquet(f"{path}/parquet"), f"{path}/csv")
    return read_csv(spark, f"{path}/csv").select("o_orderpriority", F.col("n").cast("long").alias("n"))


@query("SELECT n_nationkey, n_name AS \"name\", n_regionkey AS col_3 FROM nation")
def named_columns(spark, sf_dir):
    """Columns without names get them by their place, repeated names a number."""
    nation = table(spark, sf_dir, "nation")
    return nation.toDF(*unique_names(["n_nationkey", "name", None]))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
def found_elsewhere(spark, sf_dir):
    """A repository looked up over several roots, in a namespace that only its owner writes."""
    repo = fresh(spark, "team/facts", user="ann")
    repo.import_frame("nation", table(spark, sf_dir, "nation").where("n_regionkey = 3"), ("n_nationkey",))
    repo.catalog.grant("team", "ann")
    stranger = Catalog(spark, repo.catalog.store.root, user="bob")
    try:
        Repository(stranger, "team/facts").images.tag(repo.head.hash, "mine")
    except PermissionError:
        pass
    else:
        raise AssertionError("anyone may write")
    return lookup("team/facts", Catalog(spark, scratch_path(spark, "empty")), [stranger]).table("latest", "nation").read()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def rest_request(spark, sf_dir):
    """A table of an image asked by a query string."""
    repo = fresh(spark)
    repo.import_frame("orders", table(spark, sf_dir, "orders"), ("o_orderkey",))
    t = repo.table("latest", "orders")
    rows = webapi.answer(t.read(), t.schema, "select=o_orderkey,o_totalprice&o_orderstatus=eq.F&o_totalprice=gte.200000&order=o_totalprice.desc,o_orderkey&limit=10")
    return spark.createDataFrame([(r["o_orderkey"], float(r["o_totalprice"])) for r in rows], "o_orderkey long, o_totalprice double")


@contextmanager
def served(spark: SparkSession, handler):
    """A web server on the driver that answers by ``handler``(path, parameters, body) -> text."""

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            size = int(self.headers.get("Content-Length") or 0)
            url = urllib.parse.urlparse(self.path)
            text = handler(url.path, dict(urllib.parse.parse_qsl(url.query)), json.loads(self.rfile.read(size)) if size else None).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        do_POST = do_GET  # noqa: N815

        def log_message(self, *_):
            return

    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    server = ThreadingHTTPServer(("0.0.0.0", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://{host}:{server.server_port}"
    finally:
        server.shutdown()
        server.server_close()


def kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows, read while their server stands."""
    path = scratch_path(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def portal_of(rows: list[dict]):
    """A portal's handler over suppliers, and the set of the conditions that it was asked. Rows are filtered once, not for
    each page: a page costs its own rows, however long the table is."""
    positive = [r for r in rows if r["s_acctbal"] > 0]
    asked: set[str | None] = set()

    def portal(path, given, body):
        found = positive if given.get("$where") else rows
        asked.add(given.get("$where"))
        if given["$select"].startswith("count"):
            return json.dumps([{"n": str(len(found))}])
        at = int(given["$offset"])
        return json.dumps([{"key": str(r["s_suppkey"]), "s_name": r["s_name"], "s_acctbal": str(r["s_acctbal"])} for r in found[at : at + int(given["$limit"])]])

    return portal, asked


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def portal_scan(spark, sf_dir):
    """A table of an open-data portal, page by page in parallel, with the condition in the request."""
    rows = sorted((json.loads(x) for x in table(spark, sf_dir, "supplier").toJSON().collect()), key=lambda r: r["s_suppkey"])
    portal, asked = portal_of(rows)
    with served(spark, portal) as url:
        out = kept(spark, webapi.read_web(spark, "portal", f"{url}/resource/x.json", "s_suppkey int, s_name string, s_acctbal double", [[("s_acctbal", ">", 0)]], names={"s_suppkey": "key"}, page=7, parts=3))
    assert asked == {"(`s_acctbal` > 0)"}
    return out


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size >= 45 OR p_brand = 'Brand#11'")
def search_scan(spark, sf_dir):
    """An index read by sliced scrolls, with the condition in the request."""
    rows = [json.loads(x) for x in table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").toJSON().collect()]
    scrolls: dict[str, list] = {}
    bodies = []

    def search(path, given, body):
        if "slice" in body:
            bodies.append(body["query"])
            found = [r for r in rows if (r["p_size"] >= 45 or r["p_brand"] == "Brand#11") and r["p_partkey"] % body["slice"]["max"] == body["slice"]["id"]]
            key = uuid.uuid4().hex
            scrolls[key] = [found[i : i + body["size"]] for i in range(0, len(found), body["size"])]
        else:
            key = body["scroll_id"]
        hits = scrolls[key].pop(0) if scrolls[key] else []
        return json.dumps({"_scroll_id": key, "hits": {"hits": [{"_id": str(r["p_partkey"]), "_score": 1.0, "_source": r} for r in hits]}})

    quals = [[("p_size", ">=", 45), ("p_brand", "=", "Brand#11")]]
    with served(spark, search) as url:
        out = kept(spark, webapi.read_web(spark, "search", f"{url}/parts", "p_partkey int, p_brand string, p_size int", quals, page=10, parts=2))
    want = {"bool": {"filter": [{"bool": {"should": [{"range": {"p_size": {"gte": 45}}}, {"term": {"p_brand": "Brand#11"}}], "minimum_should_match": 1}}]}}
    assert all(b == want for b in bodies) and len(bodies) == 2
    return out


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def csv_from_the_web(spark, sf_dir):
    """Two CSV files behind HTTP, fetched in parallel, with their dialect found."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").collect()
    halves = {"/a.csv": rows[: len(rows) // 2], "/b.csv": rows[len(rows) // 2 :]}
    with served(spark, lambda path, given, body: "c_custkey;c_name;c_nationkey\n" + "".join(f'{r[0]};"{r[1]}";{r[2]}\n' for r in halves[path])) as url:
        found = kept(spark, read_csv(spark, [f"{url}/a.csv", f"{url}/b.csv"]))
    return found.select(F.col("c_custkey").cast("int"), "c_name", F.col("c_nationkey").cast("int"))


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def appended_objects(spark, sf_dir):
    """Objects registered by hand and appended to a table; a table overwritten by others."""
    repo, supplier = fresh(spark), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    schema = schema_of(supplier.schema, ("s_suppkey",))
    parts = [write_base(repo.catalog, supplier.where(f"s_suppkey % 2 = {i}"), schema, None) for i in (0, 1)]
    assert repo.catalog.new_objects([*parts[0], "o" + "0" * 62]) == ["o" + "0" * 62]
    first = repo.images.add(repo.head.hash, None, {"s": TableVersion(schema, parts[0])})
    second = repo.images.add(first.hash, None, {"s": TableVersion(schema, parts[0] + parts[1])})
    repo.images.tag(second.hash, "both")
    return repo.sql("SELECT s_nationkey, count(*) AS n FROM s GROUP BY s_nationkey", "both")
