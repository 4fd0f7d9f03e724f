"""Loading into repositories: upserts, cursors, state, previews, schema migration, pandas and SQLite."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.catalog import TableVersion, now
from lamina.fragments import CHUNK, write_base, write_patch
from lamina.repo import Repository
from lamina.scan import TableScan
from lamina.types import Schema, SchemaError, key_columns, plain, schema_of, spark_type, struct_of

STATE = "_sync_state"


def merge_rows(target: DataFrame, source: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Target under source: rows of the source replace those of equal key, or are ignored where all columns are key."""
    if not pk:
        raise ValueError("an upsert needs a key")
    kinds = {f.name: f.dataType for f in target.schema.fields}
    if set(kinds) != set(source.columns):
        raise SchemaError(f"columns differ: {sorted(set(kinds) ^ set(source.columns))}")
    typed = source.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in kinds.items()])
    if set(pk) == set(kinds):
        return target.unionByName(typed.dropDuplicates(list(pk)).join(target, list(pk), "left_anti"))
    return target.join(typed.select(*pk), list(pk), "left_anti").unionByName(typed)


def cursor_filter(df: DataFrame, cursor: Sequence[str], after: Sequence | None) -> DataFrame:
    """Rows whose cursor tuple is greater than ``after``, spelt out so that each part reaches the scan."""
    if after is None:
        return df
    kinds = dict((f.name, f.dataType) for f in df.schema.fields)
    tests = []
    for i, c in enumerate(cursor):
        same = [F.col(f"`{p}`") == F.lit(v).cast(kinds[p]) for p, v in zip(cursor[:i], after)]
        tests.append(reduce(lambda a, b: a & b, [*same, F.col(f"`{c}`") > F.lit(after[i]).cast(kinds[c])]))
    bound = F.col(f"`{cursor[0]}`") >= F.lit(after[0]).cast(kinds[cursor[0]])  # implied; a plain range for the scan
    return df.where(bound & reduce(lambda a, b: a | b, tests))


def cursor_value(df: DataFrame, cursor: Sequence[str], old: Sequence | None = None) -> list | None:
    """Greatest cursor tuple, or the old one where there are no rows."""
    best = df.agg(F.max(F.struct(*[F.col(f"`{c}`") for c in cursor])).alias("m")).first()["m"]
    return plain(list(best)) if best is not None else list(old) if old is not None else None


def load_state(repo: Repository) -> dict:
    image = repo.images.by_tag("latest") if repo.images.exists() else None
    if image is None or STATE not in image.tables:
        return {}
    row = TableScan(repo.catalog, image.tables[STATE]).read().agg(F.max_by("state", "timestamp").alias("s")).first()
    return json.loads(row["s"]) if row["s"] else {}


def sync(repo: Repository, tables: dict[str, DataFrame], cursors: dict[str, Sequence[str]], keys: dict[str, Sequence[str]] | None = None, use_state: bool = True, chunk_size: int | None = CHUNK) -> str:
    """Append what is new by cursor to each table, and keep the cursors in the image; returns the new image's hash."""
    if not repo.images.exists():
        repo.init()
    state = load_state(repo) if use_state else {}
    base = repo.images.by_tag("latest")
    versions = dict(base.tables)
    for name, df in tables.items():
        schema = schema_of(df.schema, tuple((keys or {}).get(name, ())))
        old = versions.get(name)
        if old and [(c.name, c.type) for c in old.schema] != [(c.name, c.type) for c in schema]:
            raise SchemaError(f"the schema of {name} has changed")
        cursor = cursors.get(name)
        after = state.get("cursors", {}).get(name) if cursor else None
        fresh = cursor_filter(df, cursor, after) if cursor else df
        new = write_base(repo.catalog, fresh, old.schema if old else schema, chunk_size)
        known = old.objects if old and cursor else []
        versions[name] = TableVersion(old.schema if old else schema, list(dict.fromkeys([*known, *new])))
        if cursor:
            state.setdefault("cursors", {})[name] = cursor_value(fresh, cursor, after)
    versions[STATE] = state_table(repo, versions.get(STATE), state)
    made = repo.images.add(base.hash, None, versions, "Incremental sync")
    repo.images.tag(made.hash, "HEAD")
    return made.hash


def state_table(repo: Repository, old: TableVersion | None, state: dict) -> TableVersion:
    row = repo.spark.createDataFrame([(now(), json.dumps(state, sort_keys=True))], "timestamp string, state string")
    schema = old.schema if old else schema_of(row.schema)
    return TableVersion(schema, [*(old.objects if old else []), *write_base(repo.catalog, row, schema, None)])


def blind_upsert(repo: Repository, table: str, rows: DataFrame, deleted: DataFrame | None = None, comment: str | None = None, image_hash: str | None = None) -> str:
    """A patch that only knows keys: no old values, so readers rely on the overlap of key ranges. Returns the image's hash."""
    base = repo.images.by_tag("latest")
    version = base.tables[table]
    schema, keys = version.schema, [c.name for c in key_columns(version.schema)]
    kind = struct_of(schema)
    typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind.fields])
    none = F.lit(None).cast(kind)
    net = typed.select(*keys, F.lit(True).alias("upserted"), none.alias("old"), F.struct(*[F.col(f"`{n}`") for n in kind.fieldNames()]).alias("new"))
    if deleted is not None:
        net = net.unionByName(deleted.select(*[F.col(f"`{k}`").cast(kind[k].dataType).alias(k) for k in keys], F.lit(False).alias("upserted"), none.alias("old"), none.alias("new")))
    new = write_patch(repo.catalog, net, schema)
    made = repo.images.add(base.hash, image_hash, {**base.tables, table: TableVersion(schema, [*version.objects, *new])}, comment or f"Upsert into {table}")
    repo.images.tag(made.hash, "HEAD")
    return made.hash


def to_table(repo: Repository, name: str, df: DataFrame, if_exists: str = "replace", pk: Sequence[str] = (), schema_check: bool = True) -> str:
    """A DataFrame as a committed table: replaced, or patched by key. Returns the image's hash."""
    if if_exists not in ("patch", "replace"):
        raise ValueError("if_exists is patch or replace")
    if not repo.images.exists():
        repo.init()
    work = repo.work or repo.checkout(repo.head.hash if repo.head else "latest")
    if name not in work.tables or if_exists == "replace":
        if name in work.tables:
            work.drop(name)
        work.create(name, df, pk)
        return repo.commit(comment=f"Load {name}").hash
    schema = work.tables[name].schema
    if schema_check and {c.name for c in schema} != set(df.columns):
        raise SchemaError(f"columns differ from those of {name}")
    keys = [c.name for c in schema if c.is_pk]
    if not keys:
        work.insert(name, df)
    else:
        current, cond = work.table(name), [c.name for c in schema]
        typed = df.select(*[F.col(f"`{c.name}`").cast(spark_type(c.type)).alias(c.name) for c in schema])
        from lamina import changes as ch

        new = typed.select(*[F.col(f"`{k}`") for k in keys], F.struct(*cond).alias("new"))
        old = current.select(*[F.col(f"`{k}`") for k in keys], F.struct(*cond).alias("old"))
        both = new.join(old, keys, "left")
        s = work.tables[name]
        work._append(name, both.select(F.lit(s.seq).cast("long").alias("seq"), F.when(F.col("old").isNull(), ch.INSERT).otherwise(ch.UPDATE).alias("op"), "old", "new"))
    return repo.commit(comment=f"Patch {name}").hash


def migrate(df: DataFrame, target: Schema) -> DataFrame:
    """A table in another schema: columns dropped, added as null, or cast; a value that can't be cast is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c.name}`").try_cast(spark_type(c.type)) if c.name in have else F.lit(None).cast(spark_type(c.type))).alias(c.name) for c in target])


def introspect(tables: dict[str, Callable[[], DataFrame]]) -> dict[str, Schema | str]:
    """Schema of each table, or the error that kept it from being read."""
    out: dict[str, Schema | str] = {}
    for name, make in tables.items():
        try:
            out[name] = schema_of(make().schema)
        except Exception as e:  # one table's fault is a value, not an end
            out[name] = f"{type(e).__name__}: {e}"
    return out


def preview(tables: dict[str, Callable[[], DataFrame]], limit: int = 10) -> dict[str, list[dict] | str]:
    out: dict[str, list[dict] | str] = {}
    for name, make in tables.items():
        try:
            out[name] = [json.loads(r) for r in make().limit(limit).toJSON().collect()]
        except Exception as e:
            out[name] = f"{type(e).__name__}: {e}"
    return out


# pandas


def from_pandas(spark: SparkSession, pdf, pk: Sequence[str] = ()) -> tuple[DataFrame, Schema]:
    named = pdf.reset_index() if any(pdf.index.names) else pdf
    df = spark.createDataFrame(named)
    keys = tuple(pk) or tuple(n for n in pdf.index.names if n)
    return df, schema_of(df.schema, keys)


def to_pandas(repo: Repository, query: str, image: str | None = None):
    return repo.sql(query, image).toPandas()


# SQLite

_AFFINITY = (("INT", "bigint"), ("CHAR", "character varying"), ("CLOB", "character varying"), ("TEXT", "character varying"), ("BLOB", "bytea"), ("REAL", "double precision"), ("FLOA", "double precision"), ("DOUB", "double precision"), ("BOOL", "boolean"), ("DATE", "character varying"))


def sqlite_schema(path: str) -> dict[str, Schema]:
    """Schemas of a database's tables by declared affinity; tables with a column of no type are left out."""
    from lamina.types import Column

    out = {}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            info = db.execute(f'PRAGMA table_info("{name}")').fetchall()
            if all(t for _, _, t, *_ in info):
                out[name] = [Column(i + 1, n, next((pg for part, pg in _AFFINITY if part in t.upper()), "numeric"), bool(k)) for i, n, t, _, _, k in info]
    return out


def read_sqlite(spark: SparkSession, path: str, table: str, page: int = 50_000, partitions: int | None = None) -> DataFrame:
    """A table of a SQLite file, in partitions of rowid ranges that each page through by keyset."""
    schema = sqlite_schema(path)[table]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    kind = struct_of(schema)
    if lo is None:
        return spark.createDataFrame([], kind)
    n = partitions or min(spark.sparkContext.defaultParallelism, -(-(hi - lo + 1) // page))
    step = -(-(hi - lo + 1) // n)
    names = ", ".join('"' + c.name.replace('"', '""') + '"' for c in schema)
    kinds = [c.type for c in schema]

    def run(batches):
        import pyarrow as pa

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for b in batches:
                for start in b.column(0).to_pylist():
                    at, end = start - 1, min(start + step - 1, hi)
                    while True:
                        rows = db.execute(f'SELECT rowid, {names} FROM "{table}" WHERE rowid > ? AND rowid <= ? ORDER BY rowid LIMIT {page}', (at, end)).fetchall()
                        if not rows:
                            break
                        at = rows[-1][0]
                        columns = list(zip(*rows))[1:]
                        yield pa.RecordBatch.from_arrays([pa.array([None if v is None else v if isinstance(v, (bytes, str)) else str(v) for v in c], pa.binary() if k == "bytea" else pa.string()) for c, k in zip(columns, kinds)], [f"c{i}" for i in range(len(kinds))])

    raw = ", ".join(f"c{i} {'binary' if k == 'bytea' else 'string'}" for i, k in enumerate(kinds))
    starts = spark.createDataFrame([(s,) for s in range(lo, hi + 1, step)], "s long").repartition(n)
    text = starts.mapInArrow(run, raw)
    return text.select(*[F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(kind.fields)])


def parse_time(text: str) -> datetime:
    return datetime.fromisoformat(text)
