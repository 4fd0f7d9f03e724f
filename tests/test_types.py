"""Types through commits, composite keys, and properties of pruned scans."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.catalog import Catalog
from lamina.repo import Repository
from lamina.types import Column, SchemaError, compatible, schema_of, spark_type, struct_of, type_name, typed

KINDS = ["smallint", "integer", "bigint", "real", "double precision", "numeric(8,3)", "character varying(5)", "text", "character(3)", "bit varying(4)", "date", "timestamp without time zone", "timestamp with time zone", "time without time zone", "boolean", "jsonb", "bytea", "integer[]", "text[][]"]


def test_types_round_trip(spark, root):
    schema = [Column(i, f"c{i}", k, i in (2, 3)) for i, k in enumerate(KINDS, 1)]
    stamp = dt.datetime(2020, 1, 2, 3, 4, 5, 600000)
    one = (1, 2, 3, 1.5, 2.25, Decimal("12.345"), "ab", 'q"uo,te', "c", "101", dt.date(2020, 1, 1), stamp, stamp, "10:00:00", True, '{"a": [1]}', bytearray(b"\x00\xff"), [1, None, 3], [["x"], ["y z", 'q"']])
    two = (None, 5, 1, *[None] * 16)
    df = spark.createDataFrame([one, two], struct_of(schema))
    repo = Repository(Catalog(spark, root), "types")
    repo.init()
    repo.work.create("t", df, schema=schema)
    repo.commit()
    repo.work.update("t", {"c7": "'zz'", "c19": "NULL"}, "c2 = 2")
    repo.work.insert("t", spark.createDataFrame([(9, 9, 9, *[None] * 16)], struct_of(schema)))
    repo.commit()
    t = repo.table("latest", "t")
    got = {r.c2: tuple(r) for r in t.read().collect()}
    assert got[2] == (*one[:6], "zz", *one[7:18], None) and got[5] == two and got[9][0] == 9
    meta = repo.catalog.object(t.version.objects[0])
    assert meta.index["range"]["$pk"] == [[2, 3], [5, 1]] and "c15" not in meta.index["range"] and "c17" not in meta.index["range"]
    assert meta.index["range"]["c6"] == ["12.345", "12.345"]
    for quals, n in (([[("c6", ">", "12.3")]], 1), ([[("c11", "=", "2020-01-01")]], 1), ([[("c12", "<", "2019-01-01")]], 0), ([[("c2", "=", 5), ("c2", "=", 9)]], 2), ([[("c15", "=", True)]], 1)):
        assert t.read(quals=quals).count() == n
    assert len(t.plan([[("c2", ">", 100)]]).required) == 0


def test_type_names():
    for k in KINDS:
        kind = spark_type(k)
        assert spark_type(type_name(kind)) == kind
    with pytest.raises(SchemaError):
        spark_type("geometry")
    a = [Column(1, "a", "integer")]
    assert compatible(a, [Column(1, "a", "integer", False, "comment")]) and not compatible(a, [Column(2, "a", "integer")])
    assert typed("2020-01-01", "timestamp") == dt.datetime(2020, 1, 1) and typed("é", "text") == "é".encode()


def test_composite_keys_move_and_prune(spark, root):
    repo = Repository(Catalog(spark, root), "pairs")
    repo.init()
    base = [(a, f"k{b}", a * b) for a in range(4) for b in range(5)]
    repo.work.create("t", spark.createDataFrame(base, "a int, b string, v int"), ("a", "b"))
    repo.commit(chunk_size=5)
    repo.work.update("t", {"a": "a + 10"}, "a = 1 AND b = 'k2'")
    repo.commit(split_changeset=True)
    t = repo.table("latest", "t")
    want = sorted((a + 10 if (a, b) == (1, "k2") else a, b, v) for a, b, v in base)
    assert sorted(tuple(r) for r in t.read().collect()) == want and t.count() == 20
    plan = t.plan([[("a", "=", 3)]])
    assert len(plan.required) == 1 and len(plan.singletons) == 1
    assert len(t.plan([[("a", "=", 11)]]).required) == 1
    with pytest.raises(SchemaError):
        schema_of(t.read().schema, ("nothing",))


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    repo = Repository(Catalog(spark, f"file://{tmp_path_factory.mktemp('h')}"), "prop")
    repo.init()
    repo.work.create("t", spark.createDataFrame([(i, i * 7 % 20, None if i % 6 == 0 else f"s{i % 9}") for i in range(60)], "k int, v int, s string"), ("k",))
    repo.commit(chunk_size=12)
    repo.work.sql("DELETE FROM t WHERE k % 11 = 4; UPDATE t SET v = v + 30 WHERE k % 7 = 2; INSERT INTO t VALUES (100, 1, 's1'), (-3, 50, NULL)")
    repo.commit(split_changeset=True, indexes={"t": {"bloom": {"s": {"probability": 0.05}}}})
    repo.work.sql("UPDATE t SET s = 'new' WHERE v > 30; DELETE FROM t WHERE k > 55")
    repo.commit()
    table = repo.table("latest", "t")
    return table, [tuple(r) for r in table.read().collect()]


QUAL = st.one_of(
    st.tuples(st.just("k"), st.sampled_from(["=", ">", ">=", "<", "<=", "<>"]), st.integers(-5, 105)),
    st.tuples(st.just("v"), st.sampled_from(["=", ">", "<"]), st.integers(0, 55)),
    st.tuples(st.just("s"), st.sampled_from(["=", ">", "is null"]), st.sampled_from(["s1", "s4", "new", "zz"])),
)
OPS = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "<>": lambda a, b: a != b}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(quals=st.lists(st.lists(QUAL, min_size=1, max_size=2), min_size=1, max_size=2))
def test_pruned_scan_equals_full_scan(history, quals):
    table, everything = history

    def holds(row, q):
        v = row["kvs".index(q[0])]
        return v is None if q[1] == "is null" else v is not None and OPS[q[1]](v, q[2])

    want = sorted((r for r in everything if all(any(holds(r, q) for q in c) for c in quals)), key=repr)
    assert sorted((tuple(r) for r in table.read(quals=quals).collect()), key=repr) == want


def test_count_by_metadata_equals_rows(history):
    table, everything = history
    assert table.count() == len(everything) == table.read().select(F.count("*")).first()[0]
