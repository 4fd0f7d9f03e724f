"""Queries on versioned tables. A small catalog with two versions of orders is made once per session and data folder.

Version 2 deletes orders of the lowest priority, raises the price of finished ones by 1 and copies urgent ones to key + 10^9.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina import build
from lamina import changes as ch
from lamina.catalog import Catalog, TableVersion
from lamina.digest import LANES, content_hash, hex_column, lane_sums
from lamina.fragments import _CHUNK, number_chunks, split_boundaries, write_base
from lamina.functions import adapters as pg
from lamina.operators import ordered
from lamina.operators.eviction import eviction_order
from lamina.repo import Repository
from lamina.rowtext import row_text
from lamina.runtime import scratch_path, table
from lamina.scan import TableScan
from lamina.sources.inference import infer_schema
from lamina.sources.loading import cursor_filter, cursor_value, merge_rows
from lamina.sources.messages import append_dedup, columns_of, flatten
from lamina.sources.remote import soql_query
from lamina.types import Column, schema_of

CHUNK = 500
_made: dict[tuple[str, str], Repository] = {}


def repository(spark: SparkSession, sf_dir: str) -> Repository:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        repo = Repository(Catalog(spark, scratch_path(spark, "root")), "demo/sales")
        repo.init()
        orders = table(spark, sf_dir, "orders")
        repo.work.create("orders", orders, ("o_orderkey",))
        repo.work.create("customer", table(spark, sf_dir, "customer"), ("c_custkey",))
        first = repo.commit("1" * 64, "first load", chunk_size=max(CHUNK, orders.count() // 16))
        repo.images.tag(first.hash, "v1")
        edit(repo.work)
        second = repo.commit("2" * 64, "edits", split_changeset=True, indexes={"orders": {"range": None}})
        repo.images.tag(second.hash, "v2")
        _made[key] = repo
    return _made[key]


def edit(work) -> None:
    work.sql("DELETE FROM orders WHERE o_orderpriority = '5-LOW'; UPDATE orders SET o_totalprice = o_totalprice + 1 WHERE o_orderstatus = 'F'")
    work.insert("orders", work.table("orders").where("o_orderpriority = '1-URGENT'").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))


COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_PRICE = "o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_totalprice"
V2 = f"""(SELECT o_orderkey, o_custkey, o_orderstatus, {_PRICE}, o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, {_PRICE}, o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT')"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scan(name: str, quals, where: str, columns: str = COLUMNS) -> None:
    QUERIES[name] = lambda spark, sf_dir: repository(spark, sf_dir).table("v2", "orders").read(columns.split(", "), quals)
    ORACLES[name] = f"SELECT {columns} FROM {V2} t WHERE {where}"


@query("SELECT * FROM lineitem")
def snapshot_roundtrip(spark, sf_dir):
    repo = repository(spark, sf_dir)
    lineitem = table(spark, sf_dir, "lineitem")
    schema = schema_of(lineitem.schema)
    ids = write_base(repo.catalog, lineitem.withColumn("_n", F.lit(0)).drop("_n"), schema, None)
    return TableScan(repo.catalog, TableVersion(schema, ids)).read()


@query("SELECT chunk, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS BIGINT) AS chunk FROM orders) t GROUP BY chunk")
def chunk_layout(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = number_chunks(orders, schema_of(orders.schema, ("o_orderkey",)), CHUNK, scratch_path(spark, "chunks"))
    return rows.groupBy(F.col(_CHUNK).alias("chunk")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT * FROM lineitem WHERE l_linenumber <> 2")
def no_key_patch(spark, sf_dir):
    """A table without key: a patch takes all copies of the rows that it touches."""
    repo = Repository(Catalog(spark, scratch_path(spark, "nokey")), "demo/nokey")
    repo.init()
    repo.work.create("t", table(spark, sf_dir, "lineitem"))
    repo.commit(chunk_size=None)
    repo.work.delete("t", "l_linenumber = 2")
    repo.commit()
    return repo.work.table("t")


@query(f"SELECT {COLUMNS} FROM {V2} t")
def patch_materialize(spark, sf_dir):
    return repository(spark, sf_dir).table("v2", "orders").read()


@query("SELECT * FROM orders")
def time_travel(spark, sf_dir):
    return repository(spark, sf_dir).table("1111", "orders").read()


@query(f"SELECT false AS added, * FROM (SELECT * FROM orders EXCEPT SELECT {COLUMNS} FROM {V2} a) x UNION ALL SELECT true, * FROM (SELECT {COLUMNS} FROM {V2} b EXCEPT SELECT * FROM orders) y")
def diff_rows(spark, sf_dir):
    return repository(spark, sf_dir).diff("orders", "v1", "v2")


@query(f"SELECT (SELECT count(*) FROM (SELECT {COLUMNS} FROM {V2} b EXCEPT SELECT * FROM orders) y) AS added, (SELECT count(*) FROM (SELECT * FROM orders EXCEPT SELECT {COLUMNS} FROM {V2} a) x) AS removed, CAST(0 AS BIGINT) AS changed")
def diff_counts(spark, sf_dir):
    return spark.createDataFrame([repository(spark, sf_dir).diff_counts("orders", "v1", "v2")], "added long, removed long, changed long")


@query("SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS inserted, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS deleted, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') AS updated FROM orders")
def pending_counts(spark, sf_dir):
    repo = Repository(repository(spark, sf_dir).catalog, "demo/sales").clone(f"demo/pending-{uuid.uuid4().hex[:8]}")
    edit(repo.checkout("v1", force=True))
    out = repo.diff_counts("orders", "v1")
    return spark.createDataFrame([out], "inserted long, deleted long, updated long")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(value, event_id) < 80")
def conflate(spark, sf_dir):
    """Net effect of a log of upserts and deletions (values of 80 and more) by user, from nothing."""
    events = table(spark, sf_dir, "events")
    row = F.struct("user_id", "event_type", "value")
    live = F.col("value") < 80
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    log = events.withColumn("n", nth).select(F.col("event_id").alias("seq"), F.when(live, 0).otherwise(1).alias("op"), F.when(F.col("n") > 1, row).alias("old"), F.when(live, row).alias("new"))
    # a deletion needs a row to name its key; the first old row of each user is nothing
    log = log.withColumn("old", F.when((F.col("op") == 1) & F.col("old").isNull(), F.lit(None)).otherwise(F.col("old"))).where("new IS NOT NULL OR old IS NOT NULL")
    schema = [Column(1, "user_id", "bigint", True), Column(2, "event_type", "character varying"), Column(3, "value", "double precision")]
    return ch.conflate(log, schema).where("upserted").select("new.*")


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN o_orderkey < 100 THEN 0 WHEN o_orderkey <= 300 THEN 1 WHEN o_orderkey <= 900 THEN 2 ELSE 3 END AS part FROM orders) t GROUP BY part")
def split_changes(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    got = split_boundaries(keys, [Column(1, "o_orderkey", "bigint", True)], [((100,), (300,)), ((500,), (900,))], "part")
    return got.groupBy(F.col("part").cast("int").alias("part")).agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT p_brand, p_partkey AS id, p_partkey * 3 AS a, p_partkey * 3 + p_size * 2 AS b FROM part),
m AS (SELECT *, max(b) OVER (PARTITION BY p_brand ORDER BY a, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM i),
g AS (SELECT *, sum(CASE WHEN e IS NULL OR a > e THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY a, id) AS gid FROM m)
SELECT p_brand, min(a) AS lo, max(b) AS hi, count(*) AS n FROM g GROUP BY p_brand, gid""")
def interval_groups(spark, sf_dir):
    """Groups of overlapping intervals, for each brand as for the objects of a table."""
    rows = table(spark, sf_dir, "part").selectExpr("p_brand", "p_partkey", "p_partkey * 3 AS a", "p_partkey * 3 + p_size * 2 AS b")
    return ordered.interval_groups(rows, "a", "b", ["p_brand"], ["p_partkey"])


scan("scan_point", [[("o_orderkey", "=", 115)]], "o_orderkey = 115")
scan("scan_range", [[("o_orderkey", ">=", 100)], [("o_orderkey", "<", 700)]], "o_orderkey >= 100 AND o_orderkey < 700")
scan("scan_or", [[("o_orderkey", "<=", 400)], [("o_orderstatus", "=", "F"), ("o_orderstatus", "=", "O")]], "o_orderkey <= 400 AND o_orderstatus IN ('F', 'O')")
scan("scan_in", [[("o_custkey", "in", [1, 2, 3, 50])]], "o_custkey IN (1, 2, 3, 50)")
scan("scan_not_in", [[("o_orderpriority", "<> all", ["1-URGENT", "2-HIGH"])]], "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
scan("scan_like", [[("o_orderpriority", "~~", "%-%H%")]], "o_orderpriority LIKE '%-%H%'")
scan("scan_null", [[("o_custkey", "is null", None), ("o_orderkey", ">", 1_000_000_000)]], "o_custkey IS NULL OR o_orderkey > 1000000000")
scan("scan_columns", [[("o_totalprice", ">", 250000.0)]], "o_totalprice > 250000", "o_orderpriority, o_orderkey")


@query(f"SELECT t.o_orderkey, c.c_name FROM {V2} t JOIN customer c ON c.c_custkey = t.o_custkey WHERE t.o_totalprice < c.c_acctbal * 20")
def scan_join(spark, sf_dir):
    return repository(spark, sf_dir).sql("SELECT t.o_orderkey, c.c_name FROM orders t JOIN customer c ON c.c_custkey = t.o_custkey WHERE t.o_totalprice < c.c_acctbal * 20", "v2")


@query("SELECT CAST(count(*) FILTER (WHERE o_orderpriority <> '5-LOW') + count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS rows_by_metadata FROM orders")
def length_by_metadata(spark, sf_dir):
    return spark.createDataFrame([(repository(spark, sf_dir).table("v2", "orders").count(),)], "rows_by_metadata long")


@query("SELECT 'point' AS qualifier, CAST(1 AS BIGINT) AS needed, true AS within FROM orders WHERE o_orderkey = 115 UNION ALL SELECT 'beyond', count(*), true FROM orders WHERE o_orderkey > 2000000000 UNION ALL SELECT 'none', CAST(-1 AS BIGINT), true")
def pruned_objects(spark, sf_dir):
    """Objects of the first version that each qualifier needs: the one that holds a key, none beyond all keys, or all."""
    t = repository(spark, sf_dir).table("v1", "orders")
    cases = {"point": [[("o_orderkey", "=", 115)]], "beyond": [[("o_orderkey", ">", 2_000_000_000)]], "none": None}
    plans = {k: t.plan(q) for k, q in cases.items()}
    return spark.createDataFrame([(k, -1 if len(p.required) == p.total else len(p.required), p.total > 10) for k, p in plans.items()], "qualifier string, needed long, within boolean")


@query("""WITH u AS (SELECT o_orderkey AS k, o_orderstatus <> 'P' AS flag, o_totalprice + 1 AS p FROM orders WHERE o_orderstatus IN ('P', 'F'))
SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey NOT IN (SELECT k FROM u) UNION ALL SELECT k, p FROM u WHERE flag""")
def overlay_view(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lower = orders.selectExpr("o_orderkey AS k", "o_totalprice AS p")
    upper = orders.where("o_orderstatus IN ('P', 'F')").selectExpr("o_orderkey AS k", "o_totalprice + 1 AS p", "o_orderstatus <> 'P' AS flag", "1 AS seq")
    older = orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey AS k", "o_totalprice - 9 AS p", "false AS flag", "0 AS seq")
    return ch.overlay(lower, upper.unionByName(older), schema_of(lower.schema, ("k",)))


def _quoted(c: str) -> str:
    return f"""CASE WHEN {c} = '' OR regexp_matches({c}, '[\\s,"\\\\()]') THEN '"' || {c} || '"' ELSE {c} END"""


_TEXT = f"""'(' || p_partkey || ',' || {_quoted("p_name")} || ',' || {_quoted("p_brand")} || ',' || {_quoted("p_type")} || ',' || p_size || ',' || CAST(p_retailprice AS VARCHAR) || ')'"""
_LANES = " || ".join(f"printf('%04x', CAST(sum(CAST('0x' || substr(h, {4 * i + 1}, 4) AS BIGINT)) % 65536 AS BIGINT))" for i in range(LANES))


@query(f"SELECT {_LANES} AS hash, count(*) AS n FROM (SELECT sha256({_TEXT}) AS h FROM part) t")
def content_hashes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = part.select(F.sha2(row_text(schema_of(part.schema)), 256).alias("s")).agg(*lane_sums(F.col("s")), F.count("*").alias("n"))
    return found.select(hex_column().alias("hash"), "n")


_ORDER_TEXT = f"""'(' || o_orderkey || ',' || coalesce(CAST(o_custkey AS VARCHAR), '') || ',' || coalesce({_quoted("o_orderstatus")}, '') || ',' || coalesce(CAST(o_totalprice AS VARCHAR), '') || ',' || coalesce('"' || CAST(CAST(o_orderdate AS TIMESTAMP) AS VARCHAR) || '"', '') || ',' || coalesce({_quoted("o_orderpriority")}, '') || ')'"""
_ORDER_HASH = f"SELECT '{{}}' AS tag, {_LANES} AS hash, count(*) AS n FROM (SELECT sha256({_ORDER_TEXT}) AS h FROM {{}} o) t"


@query(_ORDER_HASH.format("v1", "orders") + " UNION ALL " + _ORDER_HASH.format("v2", V2))
def hash_additivity(spark, sf_dir):
    """Hashes of the objects sum up to the table's, before and after the patch: they are added up from the manifests alone."""
    from lamina.digest import Digest

    repo, out = repository(spark, sf_dir), []
    for tag in ("v1", "v2"):
        t, total = repo.table(tag, "orders"), Digest.zero()
        for m in repo.catalog.objects(t.version.objects):
            total = total + Digest.from_hex(m.insertion_hash) - Digest.from_hex(m.deletion_hash)
        out.append((tag, total.hex(), t.count()))
    return spark.createDataFrame(out, "tag string, hash string, n long")


@query("SELECT count(*) AS kept FROM (SELECT DISTINCT c_mktsegment FROM customer) t")
def bloom_keeps_members(spark, sf_dir):
    from lamina.indexing import bloom_has, build_blooms

    customer = table(spark, sf_dir, "customer").select(F.lit(0).cast("long").alias("g"), "c_mktsegment")
    entry = build_blooms(customer, "g", "c_mktsegment", probability=0.01)[0]
    # distinct segments: a handful
    kept = sum(bloom_has(entry, r[0]) for r in customer.select("c_mktsegment").distinct().collect())
    return spark.createDataFrame([(kept,)], "kept long")


@query(f"SELECT o_orderstatus, count(*) AS n FROM {V2} t GROUP BY o_orderstatus")
def import_query(spark, sf_dir):
    source = repository(spark, sf_dir)
    other = Repository(Catalog(spark, source.catalog.store.root), "demo/imports")
    if other.images.exists():
        other.delete()
    other.init()
    other.import_tables(["by_status"], source, ["SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"], "v2", [True])
    return other.table("latest", "by_status").read()


@query("SELECT c.c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 0 GROUP BY c.c_mktsegment")
def build_two_stage(spark, sf_dir):
    source = repository(spark, sf_dir)
    text = """
FROM EMPTY AS demo/stage
FROM demo/sales:v1 IMPORT orders, {SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0} AS rich
SQL {CREATE TABLE result AS SELECT r.c_mktsegment, count(*) AS n
     FROM orders o JOIN rich r ON r.c_custkey = o.o_custkey GROUP BY r.c_mktsegment}
"""
    build.Builder(source.catalog).run(text)
    return Repository(source.catalog, "demo/stage").table("latest", "result").read()


@query(f"SELECT 'demo/sales' AS source, '{'1' * 64}' AS source_hash UNION ALL SELECT 'demo/sales', '{'2' * 64}'")
def provenance_sources(spark, sf_dir):
    source = repository(spark, sf_dir)
    text = """
FROM EMPTY AS demo/derived
FROM demo/sales:v1 IMPORT customer
SQL CREATE TABLE k AS SELECT count(*) AS n FROM "demo/sales:v2".orders
"""
    image = build.Builder(source.catalog).run(text)
    return spark.createDataFrame(build.dependencies(image), "source string, source_hash string")


@query("SELECT n_regionkey, count(*) AS dependents FROM nation GROUP BY n_regionkey")
def provenance_dependents(spark, sf_dir):
    """Images built from each of five: one for each nation of a region."""
    catalog, nation = Catalog(spark, scratch_path(spark, "dependents")), table(spark, sf_dir, "nation")
    hashes = {}
    for r in range(5):
        source = Repository(catalog, f"region/r{r}")
        hashes[r] = source.import_frame("nation", nation.where(F.col("n_regionkey") == r)).hash
        for k in [x[0] for x in nation.where(F.col("n_regionkey") == r).select("n_nationkey").collect()]:
            build.Builder(catalog).run(f"FROM EMPTY AS nation/n{k}\nFROM region/r{r}:{hashes[r]} IMPORT nation")
    return spark.createDataFrame([(r, build.dependents(catalog, f"region/r{r}", h).count()) for r, h in hashes.items()], "n_regionkey int, dependents long")


@query(f"SELECT 'v1' AS tag, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders UNION ALL SELECT 'v2', count(*), round(sum(o_totalprice), 2) FROM {V2} t")
def image_closure(spark, sf_dir):
    """Rows of every image of the log of the latest one, by tag."""
    repo = repository(spark, sf_dir)
    tags = {h: t for t, h in repo.images.tags().items() if t != "HEAD"}
    out = None
    for i in repo.images.log(repo.images["v2"].hash):
        if "orders" in i.tables:
            part = repo.table(i, "orders").read().agg(F.lit(tags[i.hash]).alias("tag"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
            out = part if out is None else out.unionByName(part)
    return out


@query("SELECT count(*) FILTER (WHERE n_nationkey < 10) AS unused_rows, count(*) FILTER (WHERE n_nationkey >= 10) AS used_rows, true AS counted FROM nation")
def sizes_and_unused(spark, sf_dir):
    """Rows of objects that no image refers to, after the image that had them was deleted, and of those in use."""
    repo, nation = Repository(Catalog(spark, scratch_path(spark, "sizes")), "demo/sizes"), table(spark, sf_dir, "nation")
    repo.import_frame("nation", nation.where("n_nationkey >= 10"), ("n_nationkey",))
    first = repo.head
    repo.import_frame("rest", nation.where("n_nationkey < 10"), ("n_nationkey",))
    whole, gone = repo.size(), repo.head.hash
    repo.checkout(first.hash)
    repo.images.delete([gone])
    facts = repo.catalog.objects_df()
    unused = facts.join(repo.catalog.unused_objects().select("id"), "id", "left_semi")
    left = repo.catalog.unused_objects().join(facts.select("id", "size"), "id").agg(F.sum("size")).first()[0]
    counted = repo.size() == repo.image_size("latest") == whole - left
    return spark.createDataFrame([(unused.agg(F.sum("rows_inserted")).first()[0], facts.join(unused.select("id"), "id", "left_anti").agg(F.sum("rows_inserted")).first()[0], counted)], "unused_rows long, used_rows long, counted boolean")


def _both(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return c, c.withColumn("c_custkey", F.col("c_custkey") * 2).withColumn("c_nationkey", F.col("c_nationkey") + 100)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey * 2 FROM customer) UNION ALL SELECT c_custkey * 2, c_name, CAST(c_nationkey + 100 AS INTEGER) FROM customer")
def upsert_patch(spark, sf_dir):
    return merge_rows(*_both(spark, sf_dir), ["c_custkey"])


@query("SELECT c_custkey FROM customer UNION SELECT c_custkey * 2 FROM customer")
def upsert_keys_only(spark, sf_dir):
    a, b = _both(spark, sf_dir)
    return merge_rows(a.select("c_custkey"), b.select("c_custkey"), ["c_custkey"])


@query("SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-15 00:00:00', 100)")
def cursor_sync(spark, sf_dir):
    return cursor_filter(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], ["2024-01-15 00:00:00", 100])


@query("SELECT ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def cursor_position(spark, sf_dir):
    value = cursor_value(table(spark, sf_dir, "events"), ["ts", "event_id"])
    return spark.createDataFrame([(str(value[0]), value[1])], "ts string, event_id long").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query("SELECT column_name AS name, CASE data_type WHEN 'VARCHAR' THEN 'character varying' WHEN 'DOUBLE' THEN 'numeric' WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'BIGINT' THEN 'integer' ELSE lower(data_type) END AS kind FROM information_schema.columns WHERE table_name = 'orders'")
def infer_types(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns])
    return spark.createDataFrame([(c.name, c.type) for c in infer_schema(text)], "name string, kind string")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_json(spark, sf_dir):
    fields = flatten({"properties": {"k": {"type": ["null", "integer"]}}})
    return table(spark, sf_dir, "events").select("event_id", *columns_of("props", fields))


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return append_dedup(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


@query("SELECT n_name, substring(n_name, 0, 4) AS a, substring(n_name, -1, 4) AS b, substring(n_name, 2, 3) AS c FROM (SELECT n_name FROM nation) t".replace("substring(n_name, 0, 4)", "substr(n_name, 1, 3)").replace("substring(n_name, -1, 4)", "substr(n_name, 1, 2)"))
def substring_zero(spark, sf_dir):
    s = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_name", pg.substring_from(s, 0, 4).alias("a"), pg.substring_from(s, -1, 4).alias("b"), pg.substring_from(s, 2, 3).alias("c"))


@query("SELECT c_custkey, nullif(regexp_extract(c_name, '[0-9]*[1-9]$', 0), '') AS tail FROM customer")
def regex_extract(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", pg.substring_regex(F.col("c_name"), "[0-9]*[1-9]$").alias("tail"))


@query("SELECT c_custkey, regexp_replace(c_name, '([A-Za-z]+)#([0-9])', '\\2\\1') AS swapped, regexp_replace(c_name, '0', 'x') AS one FROM customer")
def regex_backrefs(spark, sf_dir):
    s = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", pg.regexp_replace_first(s, "([A-Za-z]+)#([0-9])", r"\2\1").alias("swapped"), pg.regexp_replace_first(s, "0", "x").alias("one"))


@query("SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders GROUP BY strftime(o_orderdate, '%Y%m')")
def month_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(pg.to_char(F.col("o_orderdate"), "YYYYMM").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey DESC")
def distinct_on(spark, sf_dir):
    return pg.distinct_on(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [pg.order("o_orderkey", descending=True)])


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n, CAST(min(c_custkey) AS BIGINT) AS lo FROM (SELECT c_custkey, CASE WHEN c_nationkey > 20 THEN CAST(c_nationkey + 50 AS INTEGER) ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_nationkey <> 4 UNION ALL SELECT -1, 7) t GROUP BY c_nationkey")
def dml_script(spark, sf_dir):
    repo = Repository(Catalog(spark, scratch_path(spark, "dml")), "demo/dml")
    repo.import_frame("c", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ("c_custkey",))
    repo.work.sql("DELETE FROM c WHERE c_nationkey = 4; UPDATE c SET c_nationkey = c_nationkey + 50 WHERE c_nationkey > 20; INSERT INTO c VALUES (-1, 7); CREATE TABLE g AS SELECT c_nationkey, count(*) AS n, min(c_custkey) AS lo FROM c GROUP BY c_nationkey; DROP TABLE c")
    repo.commit()
    return repo.table("latest", "g").read()


@query("""SELECT id, round(score, 1) AS score, CAST(sum(size) OVER (ORDER BY orphan DESC, score, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS freed FROM (
SELECT id, size, orphan, exp(-0.00000802 * idle) * greatest(size, 10485760) AS score FROM (
SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey * 100003 AS size, CAST(p_size * 3600.0 AS DOUBLE) AS idle, p_size < 3 AS orphan FROM part) a) b""")
def eviction(spark, sf_dir):
    objects = table(spark, sf_dir, "part").selectExpr("cast(p_partkey AS string) AS id", "p_partkey * 100003 AS size", "cast(p_size * 3600 AS double) AS idle", "p_size < 3 AS orphan")
    return eviction_order(objects).select("id", F.round("score", 1).alias("score"), "freed")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') IS NOT NULL AS has, coalesce(json_extract_string(props, '$.k') = '7', false) AS seven FROM events")
def json_access(spark, sf_dir):
    j = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", pg.json_text(j, "k").alias("k"), pg.json_has_key(j, "k").alias("has"), pg.json_contains(j, {"k": 7}).alias("seven"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_fields(spark, sf_dir):
    return pg.json_each(table(spark, sf_dir, "events"), "props", ["event_id"])


@query("SELECT r_regionkey, list_sort(list(n_nationkey)) AS nations, list_contains(list(n_nationkey), 1) AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def array_functions(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("nations"))
    return nations.withColumn("one", pg.contained(F.array(F.lit(1)), F.col("nations")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sqlite_roundtrip(spark, sf_dir):
    """A table through a SQLite file and its source plugin."""
    import os
    import sqlite3

    from lamina.runtime import local_path
    from lamina.sources.base import SqliteSource

    # a SQLite file is a file of the machines that read it: it lies in the folder that they share
    path = local_path(scratch_path(spark, "sqlite") + ".db")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in table(spark, sf_dir, "nation").collect()])
    read = SqliteSource(spark, path=path).tables()["nation"]()
    return read.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_roundtrip(spark, sf_dir):
    """A table through CSV files, with dialect and types found again."""
    from lamina.sources.csvfiles import read_csv, write_csv

    path = scratch_path(spark, "csv")
    write_csv(table(spark, sf_dir, "orders"), path, delimiter=";")
    found = read_csv(spark, path)
    return found.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", F.col("o_totalprice").cast("double"), F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority")


@query("""SELECT CAST(n AS BIGINT) AS n, part, text FROM (VALUES (0, '$select', '`a`, `b`'), (0, '$where', '(`a` = 1 OR `b` LIKE ''x%'') AND (`b` IS NOT NULL)'), (0, '$order', '`a` ASC, :id'), (0, '$limit', '10'),
(1, '$select', '`a`, count(*) AS n, sum(`b`) AS s'), (1, '$where', '(`a` IN (''x'', ''it''''s''))'), (1, '$group', '`a`')) t(n, part, text)""")
def remote_translation(spark, sf_dir):
    """Requests that qualifiers, sorts and aggregates become in the dialect of an open-data API."""
    cases = [
        soql_query(["a", "b"], [[("a", "=", 1), ("b", "like", "x%")], [("b", "<>", None)]], [("a", False, False)], limit=10),
        soql_query(group=["a"], aggregates={"n": ("count", "*"), "s": ("sum", "b")}, quals=[[("a", "in", ["x", "it's"])]]),
    ]
    return spark.createDataFrame([(i, k, v) for i, c in enumerate(cases) for k, v in c.items()], "n long, part string, text string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned, merged scan of a patched table: write, hash, index, prune, overlap, merge, filter."""
    repo = Repository(Catalog(spark, scratch_path(spark, "flagship")), "demo/flagship")
    repo.init()
    repo.work.create("orders", table(spark, sf_dir, "orders"), ("o_orderkey",))
    repo.commit(chunk_size=CHUNK)
    edit(repo.work)
    repo.commit()
    quals = [[("o_orderkey", "<=", 400)], [("o_orderstatus", "=", "F"), ("o_orderstatus", "=", "O")]]
    return repo.table("latest", "orders").read(COLUMNS.split(", "), quals)


