import random

import pytest

#: Names that operators might use inside.
EXTRA = ["_sim_id", "_sim_th", "_mix_key", "_mix_k", "_verdict", "n", "key", "fp", "th", "id", "bucket", "copies", "rate", "node", "bytes", "shard", "pos", "line", "rows", "h1", "_payload", "p0"]
EXTRA += ["_id", "_y", "y", "f", "a", "b", "m", "g", "root", "size", "first", "cell", "task", "row", "i", "key1", "h", "v", "d0", "dim", "at", "bin", "a.b", "Text2"]
NESTED = "`map` map<string,int>, `nest` struct<x:int,doc_id:long,m:map<string,string>>, `blob` binary"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA) + ", " + NESTED
WORDS = "river stone letter garden winter market silver window paper mountain signal copper harbour meadow lantern bridge orchard thunder velvet compass pepper anchor marble candle feather".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def hard_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, other scripts."""
    r = random.Random(4)
    long = "\n".join(prose(r, 12) for _ in range(2500))
    again = prose(r, 60)
    body = [
        (None, "a row without an id " + prose(r, 30), "en", "web", 5),
        (None, None, None, None, None),
        (1, None, "en", "web", 0),
        (2, "", "en", "web", 0),
        (3, " \n\n\t ", "en", None, 4),
        (4, long, "en", "books", len(long)),
        (5, again, "en", "web", len(again)),
        (5, again, "en", "web", len(again)),
        (6, again, None, "web", None),
        (7, "ünïcödé 漢字かな 😀 naïve façade   line", "xx", "web", 10),
        (8, "one", "en", "web", 3),
        (9, "x" * 50_000, "en", "web", 50_000),
        (10, prose(r, 200), "en", "web", 9),
        (2**40, prose(r, 200), "en", "web", -1),
        (-5, prose(r, 20) + "\nshared line of text here\n" + prose(r, 20), "en", "web", 1),
        (11, "shared line of text here\n" + prose(r, 25), "en", "web", 1),
    ]
    nested = [None, ({"a": 1}, (1, 2, {"x": "y"}), b"\xff"), ({}, None, b""), ({"a": None}, (None, None, None), None)]
    return [row + tuple(None if i % 5 == k % 5 else "e" for k in range(len(EXTRA))) + (nested[i % 4] or (None,) * 3) for i, row in enumerate(body)]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
