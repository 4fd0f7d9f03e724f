"""Command line, models, lookups, tracing and bulk metadata."""

import pytest

from lamina import catalog as cat
from lamina.__main__ import parser, run
from lamina.catalog import Catalog
from lamina.operators.tracing import Tracer
from lamina.plans.models import ModelError, load_models, ordered, run_models, wanted
from lamina.repo import Repository, lookup
from lamina.store import NotFound


def test_command_line(spark, root, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\n1,a\n2,b\n")
    (tmp_path / "build.txt").write_text("FROM EMPTY AS out\nFROM demo/r:${T} IMPORT {SELECT k FROM t WHERE k > 1} AS big\n")
    do = lambda *a: run(spark, parser().parse_args([root, *a]))
    first = do("csv-import", "demo/r", "t", f"file://{tmp_path}/x.csv", "--key", "k")
    do("tag", "demo/r", "latest", "v1")
    assert do("list") == "demo/r" and first in do("log", "demo/r") and "v1" in do("log", "demo/r", "--tree")
    assert "1 objects" in do("show", "demo/r", "v1") and "k (integer, key)" in do("table", "demo/r", "v1", "t")
    assert do("sql", "demo/r", "SELECT v FROM t WHERE k = 2") == '{"v":"b"}'
    assert do("sql", "demo/r", "SELECT k FROM t ORDER BY k", "--limit", "1") == '{"k":1}\n(more than 1 rows, see --limit)'
    assert do("sql", "demo/r", "SELECT k FROM t ORDER BY k", "--limit", "2") == '{"k":1}\n{"k":2}'
    repo = Repository(Catalog(spark, root), "demo/r")
    repo.checkout("v1")
    repo.work.delete("t", "k = 1")
    second = repo.commit().hash
    assert do("diff", "demo/r", "t", "v1", second) == "added 0, removed 1, updated 0"
    assert do("diff", "demo/r", "t", "v1", second, "--rows") == '- {"k": 1, "v": "a"}'
    assert do("build", str(tmp_path / "build.txt"), "--param", "T=v1") and do("sql", "out", "SELECT count(*) AS n FROM big") == '{"n":1}'
    assert "IMPORT {SELECT" in do("provenance", "out", "latest")
    do("csv-export", "demo/r", "t", f"file://{tmp_path}/out", "--image", "v1")
    assert do("clone", "demo/r", "demo/copy") == "demo/copy"
    assert do("rm", "demo/r", second) == second
    do("dump", "demo/r", str(tmp_path / "d.json"))
    do("rm-repo", "demo/copy")
    assert sorted(do("list").split()) == ["demo/r", "out"] and do("cleanup") != "" and do("prune", "out") == ""


def test_models(spark, root, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "stage.sql").write_text("{{ config(materialized='view') }} SELECT k, v * 2 AS w FROM {{ source('raw', 't') }}")
    (tmp_path / "m" / "final.sql").write_text("SELECT sum(w) AS s FROM {{ ref('stage') }}")
    models = load_models(str(tmp_path / "m"))
    assert ordered(models) == ["stage", "final"] and wanted(models, ["stage"]) == ["stage"]
    repo = Repository(Catalog(spark, root), "models")
    run_models(repo, models, {("raw", "t"): lambda: spark.createDataFrame([(1, 2), (2, 5)], "k int, v int")}, materialize=["final"])
    assert sorted(repo.images["latest"].tables) == ["final"] and repo.sql_as("SELECT s FROM final", many_rows=False, many_columns=False) == 14
    with pytest.raises(ModelError):
        ordered({"a": "{{ ref('b') }}", "b": "{{ ref('a') }}"})
    with pytest.raises(ModelError):
        ordered({"a": "{{ ref('zz') }}"})


def test_lookup_prepare_and_latest(spark, root, tmp_path):
    here, far = Catalog(spark, root), Catalog(spark, f"file://{tmp_path}/far")
    repo = Repository(far, "r")
    repo.import_frame("t", spark.range(3))
    assert lookup("r", here, [far]).catalog is far and lookup("r", here, overrides={"r": far}).catalog is far
    with pytest.raises(NotFound):
        lookup("r", here)
    first = repo.images["latest"].hash
    made = repo.prepare_image("latest", "copy")
    assert repo.images["latest"].hash == made.hash and made.tables.keys() == {"t"}
    assert repo.make_latest(first).hash == repo.images["latest"].hash == first
    mine = Repository(here, "mine")
    mine.init()
    mine.import_from_remote(repo, first, ["t"], ["u"])
    assert mine.sql_as("SELECT id FROM u ORDER BY id") == [(0,), (1,), (2,)] and mine.sql_as("SELECT id FROM u WHERE id > 9", many_rows=False) is None


def test_many_objects_are_read_at_once(spark, root, monkeypatch):
    repo = Repository(Catalog(spark, root), "many")
    repo.init()
    repo.work.create("t", spark.range(12), ("id",))
    repo.commit(chunk_size=2)
    monkeypatch.setattr(cat, "FETCH_AT_ONCE", 2)
    fresh = Repository(Catalog(spark, root), "many").table("latest", "t")
    assert fresh.count() == 12 and fresh.read(quals=[[("id", ">", 9)]]).count() == 2 and len(fresh.plan([[("id", ">", 9)]]).required) == 1


def test_tracer():
    t = Tracer()
    with t.stage("plan"):
        pass
    t.log("run")
    assert [n for n, _ in t.spans()] == ["plan", "run"] and "Total" in str(t)
