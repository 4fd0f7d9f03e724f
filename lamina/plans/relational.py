"""Queries on plain tables: SQL that runs as it is on both engines, with PostgreSQL's spelling ported for Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.repo import run_sql
from lamina.runtime import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SHARED: dict[str, str] = {
    # projection and filters
    "project_columns": "SELECT c_name, c_custkey, c_name AS again, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, c_nationkey::bigint AS nation FROM customer",
    "filter_compare": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus <> 'P' AND (o_orderpriority = '1-URGENT' OR o_custkey <= 100)",
    "filter_null": "SELECT k, v FROM (SELECT c_custkey AS k, nullif(c_nationkey, 3) AS v FROM customer) t WHERE v IS NULL OR v IN (1, 2)",
    "filter_like": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_' AND c_name NOT LIKE '%11'",
    "filter_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 10",
    "filter_expr": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey > l_suppkey * 20 AND l_quantity * 2 > 60",
    "filter_date": "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01 00:00:00' - INTERVAL '1' YEAR",
    "filter_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)",
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000",
    "join_self_dimension": "SELECT a.n_name AS buyer, b.n_name AS seller, count(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation a ON a.n_nationkey = c.c_nationkey JOIN nation b ON b.n_nationkey = s.s_nationkey GROUP BY a.n_name, b.n_name",
    "join_left_chain": "SELECT r.r_name, n.n_name, s.s_name FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000",
    "join_full_outer": "SELECT c.k AS ck, s.k AS sk FROM (SELECT c_custkey AS k FROM customer) c FULL OUTER JOIN (SELECT s_suppkey * 2 AS k FROM supplier) s ON c.k = s.k",
    "join_semi": "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "join_subaggregates": "SELECT a.k, a.n, b.top FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) a JOIN (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) b ON a.k = b.k",
    "join_other_columns": "SELECT a.s, a.lo FROM (SELECT p_size AS s, min(p_partkey) AS lo FROM part GROUP BY p_size) a JOIN (SELECT p_size AS s, max(p_partkey) AS hi FROM part GROUP BY p_size) b ON a.lo < b.hi AND a.s = b.s + 1",
    "join_using": "SELECT k, a.n_name, b.s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)",
    "join_theta": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE n.n_regionkey < r.r_regionkey",
    # aggregates
    "agg_simple": "SELECT count(*) AS n, count(nullif(c_nationkey, 3)) AS some, CAST(sum(c_nationkey) AS BIGINT) AS total, round(avg(c_acctbal), 4) AS mean, min(c_name) AS first, max(c_name) AS last FROM customer",
    "agg_filtered": "SELECT count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0",
    "agg_group_keys": "SELECT c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment",
    "agg_group_filter": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey IN (1, 2, 3) GROUP BY c_mktsegment ORDER BY c_mktsegment",
    "agg_group": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "agg_having_key": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING o_orderpriority LIKE '%-%' AND o_orderpriority > '2'",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct_over_subagg": "SELECT DISTINCT n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t",
    "agg_cte": "WITH per AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), sizes AS (SELECT n, count(*) AS m FROM per GROUP BY n) SELECT n, m FROM sizes WHERE m > 1",
    "agg_count_distinct": "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(1) AS n FROM customer GROUP BY c_mktsegment",
    "agg_sum_distinct": "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 6) AS a FROM part",
    "agg_conditional_ratio": "SELECT lpad(CAST(c_nationkey AS VARCHAR(10)), 3, '0') AS nation, round(CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS fraction FROM customer GROUP BY lpad(CAST(c_nationkey AS VARCHAR(10)), 3, '0')",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS INTEGER) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) FILTER (WHERE c_acctbal > 0) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    # windows
    "window_rank": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS d FROM orders",
    "window_frame": "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS run, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM events",
    # order and sets
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 25",
    "topk_nulls": "SELECT k, v FROM (SELECT c_custkey AS k, nullif(c_nationkey, 3) AS v FROM customer) t ORDER BY v DESC NULLS FIRST, k ASC NULLS LAST LIMIT 20",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM region",
    "set_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    # analytics over the star schema
    "pricing_by_nation": "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' GROUP BY n.n_name",
    "shipping_priority": "SELECT l.l_orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, l.l_orderkey LIMIT 10",
    "array_any": "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY(ARRAY[1, 2, 3])",
}


_J = """'{"a": {"b": ' || c_custkey || ', "c": [1, ' || c_nationkey || ']}, "d": "x' || c_nationkey || '", "e": null}'"""
_K = "(SELECT c_custkey AS k, nullif(c_nationkey, 3) AS v FROM customer)"
#: PostgreSQL's own forms, and what the other engine calls the same.
FORMS: dict[str, tuple[str, str]] = {
    "pg_int_division": (
        "SELECT l_orderkey, l_linenumber, l_partkey / 7 AS q, -l_partkey / 7 AS negative, l_partkey / 2 / 3 AS chain, (l_partkey + 1) / l_linenumber * 2 AS mixed, l_quantity / 4 AS part, l_partkey / 4.0 AS decimal_part FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(l_partkey // 7 AS BIGINT) AS q, CAST(-(l_partkey // 7) AS BIGINT) AS negative, CAST(l_partkey // 2 // 3 AS BIGINT) AS chain, CAST((l_partkey + 1) // l_linenumber * 2 AS BIGINT) AS mixed, l_quantity / 4 AS part, CAST(l_partkey / 4.0 AS DOUBLE) AS decimal_part FROM lineitem",
    ),
    "pg_int_division_of_aggregates": (
        "SELECT o_custkey, sum(o_orderkey) / count(*) AS mean, max(o_orderkey) / 2 AS half FROM orders GROUP BY o_custkey HAVING count(*) / 2 > 3",
        "SELECT o_custkey, CAST(sum(o_orderkey) // count(*) AS BIGINT) AS mean, CAST(max(o_orderkey) // 2 AS BIGINT) AS half FROM orders GROUP BY o_custkey HAVING count(*) // 2 > 3",
    ),
    "pg_substring": (
        "SELECT c_custkey, substring(c_name from 0 for 6) AS a, substring(c_name from 3) AS b, substring(c_name, -1, 5) AS c, substring(c_name for 4) AS d, substring(c_name from c_nationkey for 3) AS e FROM customer",
        "SELECT c_custkey, substr(c_name, 1, 5) AS a, substr(c_name, 3) AS b, substr(c_name, 1, 3) AS c, substr(c_name, 1, 4) AS d, substr(c_name, greatest(1, c_nationkey), CASE WHEN c_nationkey = 0 THEN 2 ELSE 3 END) AS e FROM customer",
    ),
    "pg_substring_regex": (
        "SELECT c_custkey, substring(c_name from '#0*([1-9][0-9]*)') AS number, substring(c_name from '[A-Z][a-z]+') AS word, substring(c_name from 'nothing') AS nothing FROM customer",
        "SELECT c_custkey, nullif(regexp_extract(c_name, '#0*([1-9][0-9]*)', 1), '') AS number, nullif(regexp_extract(c_name, '[A-Z][a-z]+', 0), '') AS word, CAST(NULL AS VARCHAR) AS nothing FROM customer",
    ),
    "pg_regexp_replace": (
        "SELECT o_orderkey, regexp_replace(o_orderpriority, '([0-9])-([A-Z]+)', '\\2\\1') AS swapped, regexp_replace(o_orderpriority, '[A-Z]', 'x') AS one, regexp_replace(o_orderpriority, '[a-z]', '$', 'gi') AS every FROM orders",
        "SELECT o_orderkey, regexp_replace(o_orderpriority, '([0-9])-([A-Z]+)', '\\2\\1') AS swapped, regexp_replace(o_orderpriority, '[A-Z]', 'x') AS one, regexp_replace(o_orderpriority, '[A-Za-z]', '$', 'g') AS every FROM orders",
    ),
    "pg_regex_match": (
        "SELECT o_orderkey FROM orders WHERE o_orderpriority ~ '^[12]-' AND o_orderpriority !~ 'HIGH$' AND o_orderpriority ~* 'urgent|high' AND o_orderstatus !~~ 'P%'",
        "SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-') AND NOT regexp_matches(o_orderpriority, 'HIGH$') AND regexp_matches(lower(o_orderpriority), 'urgent|high') AND o_orderstatus NOT LIKE 'P%'",
    ),
    "pg_to_char": (
        "SELECT o_orderkey, to_char(o_orderdate, 'YYYY-MM-DD HH24:MI') AS stamp, to_char(o_orderdate, 'YYYYMM') AS month, to_char(o_orderdate, 'FMMonth DD, YYYY') AS long, to_char(o_orderdate, 'DY') AS day FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS stamp, strftime(o_orderdate, '%Y%m') AS month, strftime(o_orderdate, '%B %d, %Y') AS long, upper(strftime(o_orderdate, '%a')) AS day FROM orders",
    ),
    "pg_distinct_on": (
        f"SELECT DISTINCT ON (v) v, k, k % 7 AS m FROM {_K} t WHERE k > 3 ORDER BY v, k % 7 DESC, k",
        f"SELECT DISTINCT ON (v) v, k, k % 7 AS m FROM {_K} t WHERE k > 3 ORDER BY v NULLS LAST, k % 7 DESC, k",
    ),
    "pg_nulls_last": (f"SELECT k, v FROM {_K} t WHERE v IS NULL OR v > 23 ORDER BY v, k DESC LIMIT 90", f"SELECT k, v FROM {_K} t WHERE v IS NULL OR v > 23 ORDER BY v NULLS LAST, k DESC LIMIT 90"),
    "pg_nulls_first": (f"SELECT k, v FROM {_K} t ORDER BY v DESC, k LIMIT 20", f"SELECT k, v FROM {_K} t ORDER BY v DESC NULLS FIRST, k LIMIT 20"),
    "pg_nulls_in_windows": (
        f"SELECT k, CAST(row_number() OVER (ORDER BY v, k) AS BIGINT) AS up, CAST(row_number() OVER (ORDER BY v DESC, k) AS BIGINT) AS down FROM {_K} t",
        f"SELECT k, CAST(row_number() OVER (ORDER BY v NULLS LAST, k) AS BIGINT) AS up, CAST(row_number() OVER (ORDER BY v DESC NULLS FIRST, k) AS BIGINT) AS down FROM {_K} t",
    ),
    "pg_casts": (
        "SELECT c_custkey, c_acctbal::int AS whole, (c_custkey / 2.0)::numeric(10,1)::bigint AS half, c_custkey::text || '!' AS t, '12'::int4 + 1 AS i, c_nationkey::float8 AS f FROM customer",
        "SELECT c_custkey, CAST(round_even(c_acctbal, 0) AS INTEGER) AS whole, CAST((c_custkey + 1) // 2 AS BIGINT) AS half, CAST(c_custkey AS VARCHAR) || '!' AS t, 13 AS i, CAST(c_nationkey AS DOUBLE) AS f FROM customer",
    ),
    "pg_json": (
        f"SELECT k, j->'a'->>'b' AS b, j->'a'->'c'->>1 AS c, j #>> '{{a,c,0}}' AS z, j->>'d' AS d, j->>'e' IS NULL AS e, j @> '{{\"d\": \"x3\"}}' AS three FROM (SELECT c_custkey AS k, {_J} AS j FROM customer) t WHERE (j->>'d') <> 'x1'",
        f"SELECT k, CAST(k AS VARCHAR) AS b, CAST(v AS VARCHAR) AS c, '1' AS z, 'x' || v AS d, true AS e, v = 3 AS three FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer) t WHERE v <> 1",
    ),
    "pg_json_aggregate": (
        "SELECT n_regionkey, json_object_agg(n_name, n_nationkey) AS nations, json_agg(n_nationkey ORDER BY n_nationkey DESC) AS keys FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS nations, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey DESC) || ']' AS keys FROM nation GROUP BY n_regionkey",
    ),
    "pg_ordered_aggregates": (
        "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names, array_agg(n_nationkey ORDER BY n_name) AS keys, percentile_cont(0.5) WITHIN GROUP (ORDER BY n_nationkey) AS middle FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names, list(n_nationkey ORDER BY n_name) AS keys, CAST(quantile_cont(n_nationkey, 0.5) AS DOUBLE) AS middle FROM nation GROUP BY n_regionkey",
    ),
    "pg_arrays": (
        "SELECT n_nationkey, (ARRAY[n_nationkey, n_regionkey])[2] AS second, array_length(ARRAY[1, 2, 3], 1) AS three, array_to_string(string_to_array(n_name, 'A'), '-') AS dashed, n_regionkey <> ALL(ARRAY[1, 2]) AS outside, ARRAY[n_regionkey] <@ ARRAY[0, 1, 4] AS inside FROM nation WHERE n_name = ANY('{CHINA,INDIA,JAPAN,BRAZIL}') OR n_nationkey > 20",
        "SELECT n_nationkey, n_regionkey AS second, 3 AS three, replace(n_name, 'A', '-') AS dashed, n_regionkey NOT IN (1, 2) AS outside, n_regionkey IN (0, 1, 4) AS inside FROM nation WHERE n_name IN ('CHINA', 'INDIA', 'JAPAN', 'BRAZIL') OR n_nationkey > 20",
    ),
    "pg_bytes": (
        "SELECT n_nationkey, encode(digest(n_name, 'sha256'), 'hex') AS sha, get_byte(digest(n_name, 'sha256'), 0) AS first, md5(n_name) AS md5, position('A' in n_name) AS at, strpos(n_name, 'IN') AS there FROM nation",
        "SELECT n_nationkey, sha256(n_name) AS sha, CAST('0x' || substr(sha256(n_name), 1, 2) AS INTEGER) AS first, md5(n_name) AS md5, CAST(instr(n_name, 'A') AS INTEGER) AS at, CAST(instr(n_name, 'IN') AS INTEGER) AS there FROM nation",
    ),
    "pg_dates": (
        "SELECT o_orderkey, extract(epoch from o_orderdate) AS epoch, extract(dow from o_orderdate) AS dow, date_part('year', o_orderdate) AS y, date_trunc('month', o_orderdate) AS month, o_orderdate + INTERVAL '2 days' AS later FROM orders",
        "SELECT o_orderkey, CAST(epoch(o_orderdate) AS DOUBLE) AS epoch, CAST(dayofweek(o_orderdate) AS INTEGER) AS dow, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, o_orderdate + INTERVAL '2 days' AS later FROM orders",
    ),
    "pg_all_of_subquery": (
        "SELECT c_custkey FROM customer WHERE c_nationkey = ANY(SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_custkey <> ALL(SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
        "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "group_by_alias": (
        "SELECT c_nationkey % 5 AS bucket, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY bucket, segment",
        "SELECT c_nationkey % 5 AS bucket, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 2",
    ),
    "lateral_join": (
        "SELECT n.n_name, t.c_custkey, t.c_acctbal FROM nation n CROSS JOIN LATERAL (SELECT c_custkey, c_acctbal FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3) t",
        "SELECT n_name, c_custkey, c_acctbal FROM (SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM nation JOIN customer ON c_nationkey = n_nationkey) t WHERE r <= 3",
    ),
    "math_functions": (
        "SELECT p_partkey, abs(p_size - 20) AS a, power(p_size, 2) AS b, floor(p_retailprice) AS c, ceil(p_retailprice) AS d, round(sqrt(p_size), 6) AS e, mod(p_partkey, 7) AS f, sign(p_size - 20) AS g, greatest(p_size, 10) AS h, round(ln(p_size), 6) AS i FROM part",
        "SELECT p_partkey, abs(p_size - 20) AS a, power(p_size, 2) AS b, CAST(floor(p_retailprice) AS BIGINT) AS c, CAST(ceil(p_retailprice) AS BIGINT) AS d, round(sqrt(p_size), 6) AS e, mod(p_partkey, 7) AS f, CAST(sign(p_size - 20) AS DOUBLE) AS g, greatest(p_size, 10) AS h, round(ln(p_size), 6) AS i FROM part",
    ),
    "concat_functions": (
        "SELECT c_custkey, c_name || '/' || c_mktsegment AS a, concat(c_name, '-', c_custkey) AS b, concat_ws('|', c_mktsegment, c_name) AS c, upper(left(c_name, 3)) AS d, right(c_name, 2) AS e, split_part(c_name, '#', 2) AS f, initcap(lower(c_mktsegment)) AS g, length(trim(c_name)) AS h FROM customer",
        "SELECT c_custkey, c_name || '/' || c_mktsegment AS a, c_name || '-' || c_custkey AS b, c_mktsegment || '|' || c_name AS c, upper(left(c_name, 3)) AS d, right(c_name, 2) AS e, split_part(c_name, '#', 2) AS f, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS g, CAST(length(trim(c_name)) AS INTEGER) AS h FROM customer",
    ),
}


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run_sql(spark, sql, {t: (lambda t=t: table(spark, sf_dir, t)) for t in TABLES})


QUERIES = {name: (lambda spark, sf_dir, sql=sql: run(spark, sf_dir, sql)) for name, sql in SHARED.items()}
ORACLES = {name: sql for name, sql in SHARED.items()}
for _name, (_sql, _other) in FORMS.items():
    QUERIES[_name] = lambda spark, sf_dir, sql=_sql: run(spark, sf_dir, sql)
    ORACLES[_name] = _other
ORACLES["array_any"] = "SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, 2, 3)"
