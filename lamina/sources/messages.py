"""Record streams in files: typed messages with schemas, and raw JSON tables; flattening, upserts and deduplication."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.repo import Repository
from lamina.sources.loading import blind_upsert, migrate, state_table
from lamina.types import Column, Schema, struct_of

_TYPES = {"integer": "bigint", "number": "numeric", "boolean": "boolean", "string": "character varying", "array": "json", "object": "json"}


def json_type(prop: dict) -> str:
    kinds = prop.get("type", "string")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    kind = next((k for k in kinds if k != "null"), "string")
    if kind == "string" and prop.get("format") in ("date-time", "date", "time"):
        return {"date-time": "timestamp without time zone", "date": "date", "time": "time"}[prop["format"]]
    return _TYPES.get(kind, "character varying")


def flatten(schema: dict, separator: str = "__", most: int = 0, _path: tuple[str, ...] = ()) -> dict[str, tuple[tuple[str, ...], str]]:
    """Column name to (JSON path, type), by name; nested properties are joined down to ``most`` levels."""
    found: list[tuple[str, tuple[tuple[str, ...], str]]] = []
    for name, prop in schema.get("properties", {}).items():
        path = (*_path, name)
        if prop.get("properties") and len(_path) < most:
            found += flatten(prop, separator, most, path).items()
        else:
            found.append((separator.join(path), (path, json_type(prop))))
    names = [n for n, _ in found]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"properties that flatten to one name: {clash}")
    return dict(sorted(found))


def columns_of(body: str, fields: dict[str, tuple[tuple[str, ...], str]]) -> list:
    """Typed columns of a JSON text column."""
    out = []
    for name, (path, kind) in fields.items():
        where = "$" + "".join(f"['{p}']" for p in path)
        value = F.get_json_object(F.col(body), where)
        out.append(value.try_cast(struct_of([Column(1, name, kind)])[0].dataType).alias(name))
    return out


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(seq, type, stream, message): lines in order of file name and place in the file.

    A row's number within its partition tells rows of one split apart; splits are told apart by file and first byte,
    since Spark packs files into partitions by size.
    """
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    seq = F.struct(F.col("file_path").alias("file"), F.col("file_block_start").alias("start"), "row")
    raw = raw.where(F.trim("value") != "")
    return raw.select(seq.alias("seq"), F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.stream").alias("stream"), F.col("value").alias("message"))


def load_messages(repo: Repository, path: str, delete_column: str | None = "_sdc_removed_at", levels: int = 10) -> str:
    """Apply SCHEMA, RECORD and STATE messages to the repository; returns the new image's hash.

    Of records with one key the last wins. A schema that changed migrates the table first; with a deletion column,
    records that have it set delete their key.
    """
    spark = repo.spark
    messages = read_messages(spark, path)
    # one message per stream and per state: metadata in size
    heads = messages.where("type = 'SCHEMA'").groupBy("stream").agg(F.max_by("message", "seq").alias("m")).collect()
    state = messages.where("type = 'STATE'").agg(F.max_by("message", "seq").alias("m")).first()["m"]
    if not repo.images.exists():
        repo.init()
    for h in sorted(heads, key=lambda r: r["stream"]):
        head = json.loads(h["m"])
        keys = head.get("key_properties") or []
        fields = flatten(head["schema"], most=levels)
        schema: Schema = [Column(i, n, k, n in keys) for i, (n, (_, k)) in enumerate(fields.items(), 1)]
        records = messages.where((F.col("type") == "RECORD") & (F.col("stream") == h["stream"])).select("seq", F.get_json_object("message", "$.record").alias("body"))
        gone = F.get_json_object("body", f"$.{delete_column}").isNotNull() if delete_column else F.lit(False)
        rows = records.select("seq", gone.alias("_gone"), *columns_of("body", fields))
        if keys:
            # a key with many records is aggregated before it moves
            rest = [c for c in rows.columns if c not in keys]
            rows = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "seq").alias("_last"))
            rows = rows.select(*[F.col(f"`{k}`") for k in keys], *[F.col("_last")[c].alias(c) for c in rest]).select("seq", "_gone", *fields)
        live = rows.where("NOT _gone").drop("_gone", "seq")
        work = repo.checkout("latest", force=True)
        name = h["stream"]
        if name in work.tables and [(c.name, c.type, c.is_pk) for c in work.tables[name].schema] != [(c.name, c.type, c.is_pk) for c in schema]:
            old = migrate(work.table(name), schema)
            work.drop(name)
            work.create(name, old, schema=schema)
            repo.commit(comment=f"Migrate {name}")
            work = repo.checkout("latest", force=True)
        if name not in work.tables:
            work.create(name, live, schema=schema)
            repo.commit(comment=f"Load {name}")
        elif keys:
            blind_upsert(repo, name, live, rows.where("_gone").select(*keys))
        else:
            work.insert(name, live)
            repo.commit(comment=f"Append to {name}")
    if state:
        image = repo.images.by_tag("latest")
        from lamina.sources.loading import STATE

        image = repo.images.add(image.hash, None, {**image.tables, STATE: state_table(repo, image.tables.get(STATE), json.loads(state).get("value", {}))}, "State")
        repo.images.tag(image.hash, "HEAD")
    return repo.images.by_tag("latest").hash


def raw_table(records: DataFrame, body: str = "data", emitted: str = "emitted_at") -> DataFrame:
    """Raw form of a stream: a hash of the record, its JSON and when it was emitted."""
    return records.select(F.sha2(F.concat_ws("|", F.col(emitted).cast("string"), F.col(body)), 256).alias("_raw_id"), F.col(emitted).alias("_emitted_at"), F.col(body).alias("_raw_data"))


def append_dedup(df: DataFrame, pk: Sequence[str], cursor: Sequence[str]) -> DataFrame:
    """The last row of each key by cursor: one partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in pk]
    last = df.groupBy(*[F.col(f"`{k}`") for k in pk]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in cursor])).alias("_r"))
    return last.select(*[F.col(f"`{k}`") for k in pk], *[F.col("_r")[c].alias(c) for c in rest]).select(*[F.col(f"`{c}`") for c in df.columns])


def normalised(raw: DataFrame, stream: dict, levels: int = 0) -> DataFrame:
    """Typed rows of a raw table. stream: json_schema, mode (overwrite, append, append_dedup), primary_key, cursor_field.

    Overwriting and appending keep every record with its ``_raw_id`` and ``_emitted_at``; deduplication keeps the last
    record of each key by cursor, then by time of emission. Records that are no JSON objects have null fields.
    """
    fields = flatten(stream["json_schema"], most=levels)
    out = raw.select("_raw_id", "_emitted_at", *columns_of("_raw_data", fields))
    mode = stream.get("mode", "append")
    if mode in ("overwrite", "append"):
        return out
    if mode != "append_dedup":
        raise ValueError(f"unknown mode {mode}")
    keys = ["__".join(k) if isinstance(k, list) else k for k in stream["primary_key"]]
    cursor = ["__".join(c) if isinstance(c, list) else c for c in stream.get("cursor_field") or []]
    return append_dedup(out, keys, [*cursor, "_emitted_at", "_raw_id"])


def sync_raw(repo: Repository, raw: dict[str, DataFrame], streams: dict[str, dict]) -> str:
    """New records of each stream into the repository: a raw table that grows (or, overwriting, starts anew), and the
    table normalised from it."""
    if not repo.images.exists():
        repo.init()
    work = repo.checkout("latest", force=True)
    for name, fresh in raw.items():
        kept, mode = f"_raw_{name}", streams[name].get("mode", "append")
        if kept in work.tables and mode != "overwrite":
            work.insert(kept, fresh)
        else:
            if kept in work.tables:
                work.drop(kept)
            work.create(kept, fresh)
        if name in work.tables:
            work.drop(name)
        keys = ["__".join(k) if isinstance(k, list) else k for k in streams[name].get("primary_key") or []] if mode == "append_dedup" else []
        work.create(name, normalised(work.table(kept), streams[name]), keys)
    return repo.commit(comment="Sync of raw streams").hash


def stream_settings(stream: dict, plugin: dict | None = None, table: dict | None = None) -> dict:
    """Key, cursor and mode of a stream: the table's parameters over the plugin's over the source's own.

    Incremental syncs need both a key and a cursor; otherwise the stream is loaded whole.
    """
    merged = {"primary_key": stream.get("source_defined_primary_key") or [], "cursor_field": stream.get("default_cursor_field") or []}
    for over in (plugin or {}, table or {}):
        merged |= {k: v for k, v in over.items() if k in merged and v}
    modes = stream.get("supported_sync_modes", ["full_refresh"])
    merged["mode"] = "incremental" if "incremental" in modes and merged["primary_key"] and merged["cursor_field"] else "full_refresh"
    return merged
