"""Objects: writing tables as base fragments and change sets as patches, content-addressed and indexed."""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.catalog import Catalog, ObjectMeta, now
from lamina.digest import Digest, lane_sums, object_id, words
from lamina.indexing import build_blooms, chunk_groups, key_range, range_aggs, range_index
from lamina.rowtext import row_text
from lamina.runtime import input_bytes, small
from lamina.types import Schema, SchemaError, key_columns, schema_hash, spark_type, struct_of

#: Rows of a base fragment, and the column that tells upserts (true) from deletions.
CHUNK = 250_000
LIVE = "_live"
#: Bytes of a source from which a base of one chunk is spread over all cores before it is hashed.
SPREAD = 8 << 20
_CHUNK, _POS = "_lamina_chunk", "_lamina_pos"


def order_columns(schema: Schema) -> list[SparkColumn]:
    """Total order of rows: by primary key, or by row text where there is none."""
    pk = [F.col(f"`{c.name}`") for c in schema if c.is_pk]
    return pk or [row_text(key_columns(schema))]


def number_chunks(df: DataFrame, schema: Schema, chunk_size: int, staging: str) -> DataFrame:
    """Rows with the number of their chunk in the total order, without a single-partition window.

    Rows are range-sorted and written once, each with its partition and place; counts by partition give the offsets.
    """
    spark = df.sparkSession
    by = order_columns(schema)
    # never coalesced: the sort's partitions are the offsets' unit, and small ones cost nothing
    ranged = df.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by).sortWithinPartitions(*by)
    ranged.withColumn(_POS, F.monotonically_increasing_id()).write.parquet(staging)
    done = spark.read.parquet(staging)
    part = F.shiftright(F.col(_POS), 33)
    counts = sorted((r["p"], r["n"]) for r in done.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    if not starts:
        return done.withColumn(_CHUNK, F.lit(0).cast("long")).drop(_POS)
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    chunk = F.expr(f"(_start + ({_POS} & {(1 << 33) - 1})) div {int(chunk_size)}")
    return done.withColumn("_part", part).join(small(offsets, len(starts)), "_part").withColumn(_CHUNK, chunk).drop("_part", "_start", _POS)


def _facts(rows: DataFrame, schema: Schema, wanted, old: str | None) -> list:
    """One aggregation by chunk: counts, lanes of inserted and deleted rows, ranges."""
    keyless = len(key_columns(schema)) == len(schema) and not any(c.is_pk for c in schema)
    staged = rows.withColumn("_text", row_text(schema)).withColumn("_sha", F.sha2(F.when(F.col(LIVE), F.col("_text")), 256))
    if old:
        staged = staged.withColumn("_osha", F.sha2(F.when(F.col(old).isNotNull(), row_text(schema, old)), 256))
    for name in ["_sha", "_osha"] if old else ["_sha"]:
        staged = staged.select("*", *[w.alias(f"{name}{i}") for i, w in enumerate(words(F.col(name)))])
    four = lambda name: [F.col(f"{name}{i}") for i in range(4)]
    # where all columns are the key, the text that is hashed is the one that ranges are taken of
    aggs = [F.sum(F.col(LIVE).cast("long")).alias("rows_inserted"), *lane_sums(four("_sha"), "h"), *range_aggs(schema, wanted, old, F.col("_text") if keyless else None)]
    if old:
        aggs += [F.sum((~F.col(LIVE) | F.col(old).isNotNull()).cast("long")).alias("rows_deleted"), *lane_sums(four("_osha"), "d")]
    # least and greatest strings don't fit the buffers of a hash aggregation; beside an aggregate that keeps objects they do,
    # and rows aren't sorted for them
    aggs.append(F.collect_set(F.lit(None).cast("int")).alias("_objects"))
    return staged.groupBy(_CHUNK).agg(*aggs).orderBy(_CHUNK).collect()


def _store(catalog: Catalog, rows: DataFrame, schema: Schema, indexes: dict | None, old: str | None, sort: Sequence[str] | None) -> list[str]:
    """Write each chunk of rows as an object and register it; an id that exists is reused."""
    store, indexes = catalog.store, indexes or {}
    unknown = set(indexes) - {"range", "bloom"}
    if unknown:
        raise ValueError(f"unknown index types: {sorted(unknown)}")
    wanted = indexes.get("range")
    facts = _facts(rows, schema, wanted, old)
    if not facts:
        return []
    names = [c.name for c in schema]
    for c in sort or []:
        if c not in names:
            raise ValueError(f"no column {c} to sort by")
    out = rows.select(F.col(LIVE), *[F.col(f"`{n}`") for n in names], _CHUNK)
    if sort:
        out = out.sortWithinPartitions(_CHUNK, *[F.col(f"`{c}`") for c in sort])
    staging = store.staging()
    out.write.partitionBy(_CHUNK).option("compression", "zstd").parquet(staging)
    blooms = {}
    for column, how in indexes.get("bloom", {}).items():
        if column not in names:
            raise ValueError(f"no column {column}")
        live = rows.where(F.col(LIVE)).select(_CHUNK, F.col(f"`{column}`"))
        if old:
            live = live.union(rows.where(F.col(old).isNotNull()).select(_CHUNK, F.col(old)[column]))
        blooms[column] = build_blooms(live, _CHUNK, column, **how)
    ids, shape, batch, made = [], schema_hash(schema), uuid.uuid4().hex, {}
    sizes = store.sizes(staging)
    for r in facts:
        inserted = Digest.of_row(r, "h")
        deleted = Digest.of_row(r, "d") if old else Digest.zero()
        id = object_id(inserted - deleted, shape)
        index = {"range": range_index(r, schema, wanted)}
        bloom = {c: found[r[_CHUNK]] for c, found in blooms.items() if r[_CHUNK] in found}
        if bloom:
            index["bloom"] = bloom
        ids.append(id)
        folder = f"{_CHUNK}={r[_CHUNK]}"
        meta = ObjectMeta(id, sizes.get(folder, 0), now(), inserted.hex(), deleted.hex(), r["rows_inserted"], r["rows_deleted"] if old else 0, index, f"objects/{batch}/{folder}")
        made.setdefault(id, meta)
    new = set(catalog.new_objects(made))
    if new:
        # one rename and one manifest, however many objects there are; those that exist leave their folder
        store.move(staging, "objects", batch)
        for m in made.values():
            if m.id not in new:
                store.delete(m.path)
        catalog.register_objects([m for m in made.values() if m.id in new])
    else:
        store.delete_path(store._path(staging))
    return ids


def write_base(catalog: Catalog, df: DataFrame, schema: Schema, chunk_size: int | None = CHUNK, indexes: dict | None = None, sort: Sequence[str] | None = None) -> list[str]:
    """Base fragments of a whole table in total order. An empty table has none; without chunk size all rows form one."""
    missing = {c.name for c in schema} - set(df.columns)
    if missing:
        raise SchemaError(f"columns that the data lacks: {sorted(missing)}")
    data = df.select(*[F.col(f"`{c.name}`").cast(spark_type(c.type)).alias(c.name) for c in schema])
    staging = catalog.store.staging()
    if chunk_size:
        rows = number_chunks(data, schema, chunk_size, staging)
    else:
        wide = data.sparkSession.sparkContext.defaultParallelism
        if input_bytes(data) > SPREAD and data.rdd.getNumPartitions() < wide:
            data = data.repartition(wide)  # what few tasks read is hashed by all
        data.write.parquet(staging)
        rows = data.sparkSession.read.parquet(staging).withColumn(_CHUNK, F.lit(0).cast("long"))
    ids = _store(catalog, rows.withColumn(LIVE, F.lit(True)), schema, indexes, None, sort)
    catalog.store.delete_path(catalog.store._path(staging))
    return ids


def group_ranges(catalog: Catalog, objects: list[str], schema: Schema) -> list[tuple]:
    """(least, greatest) key of each group of overlapping objects, in order; empty where ranges aren't known."""
    chunks = [(m.id, *r) for m in catalog.objects(objects) if (r := key_range(m, schema))]
    if len(chunks) < len(objects):
        return []
    return [(min(c[1] for c in g), max(c[2] for c in g)) for g in chunk_groups(chunks)]


def split_boundaries(keys: DataFrame, schema: Schema, groups: list[tuple], name: str = _CHUNK) -> DataFrame:
    """Number of the part that each change belongs to: 0 before all groups, i + 1 for group i, and one after all.

    A key in a gap goes to the next group.
    """
    pk = [c for c in schema if c.is_pk]
    maxes, first = [g[1] for g in groups], groups[0][0] if groups else None
    text = {i for i, c in enumerate(pk) if isinstance(spark_type(c.type), T.StringType)}

    @F.pandas_udf("long")
    def place(rows: pd.DataFrame) -> pd.Series:
        columns = [rows.iloc[:, i] for i in range(rows.shape[1])]
        if len(columns) == 1 and 0 not in text and not isinstance(maxes[0][0], (str, bytes)):
            keys, ends = columns[0].to_numpy(), np.array([m[0] for m in maxes])
            if keys.dtype.kind == "M":
                ends = ends.astype("datetime64[us]")
            return pd.Series(np.where(keys < np.array(first[0], ends.dtype), 0, np.searchsorted(ends, keys, side="left") + 1).astype("int64"))
        out = []
        for key in zip(*columns):  # keys of several columns or of text: a binary search for each
            key = tuple(k.encode() if i in text else k.to_pydatetime() if hasattr(k, "to_pydatetime") else k for i, k in enumerate(key))
            out.append(0 if key < first else bisect.bisect_left(maxes, key) + 1)
        return pd.Series(out, dtype="int64")

    if not groups or not pk:
        return keys.withColumn(name, F.lit(0).cast("long"))
    return keys.withColumn(name, place(F.struct(*[F.col(f"`{c.name}`") for c in pk])))


def write_patch(catalog: Catalog, changes: DataFrame, schema: Schema, objects: list[str] | None = None, split: bool = False, indexes: dict | None = None, sort: Sequence[str] | None = None) -> list[str]:
    """Patches of a conflated change set (key columns, upserted, old, new): the new objects, in order of their parts.

    Deletions keep their key only. With split, changes are cut at the key ranges of the groups of overlapping objects.
    """
    keys = {c.name for c in key_columns(schema)}
    fields = [F.when(F.col("upserted"), F.col("new")[c.name]).otherwise(F.col(f"`{c.name}`") if c.name in keys else F.lit(None)).cast(spark_type(c.type)).alias(c.name) for c in schema]
    rows = changes.select(F.col("upserted").alias(LIVE), *fields, "old")
    staging = catalog.store.staging()
    split_boundaries(rows, schema, group_ranges(catalog, objects or [], schema) if split else []).write.parquet(staging)
    ids = _store(catalog, catalog.spark.read.parquet(staging), schema, indexes, "old", sort)
    catalog.store.delete_path(catalog.store._path(staging))
    return ids


def reindex(catalog: Catalog, objects: list[str], schema: Schema, indexes: dict, skip_patches: bool = True) -> list[str]:
    """Add indexes to objects that only insert; others are skipped, or refused."""
    done = []
    for meta in catalog.objects(objects):
        if Digest.from_hex(meta.deletion_hash) or meta.rows_deleted:
            if not skip_patches:
                raise ValueError(f"{meta.id} holds deletions: its old values are gone")
            continue
        done.append(meta)
    if not done:
        return []
    number = catalog.spark.createDataFrame([(m.id, i) for i, m in enumerate(done)], f"_id string, {_CHUNK} long")
    rows = read_objects(catalog, [m.id for m in done], schema).join(small(number, len(done)), "_id")
    wanted = indexes.get("range")
    facts = {r[_CHUNK]: r for r in rows.groupBy(_CHUNK).agg(*range_aggs(schema, wanted)).collect()} if "range" in indexes else {}
    blooms = {c: build_blooms(rows.select(_CHUNK, F.col(f"`{c}`")), _CHUNK, c, **how) for c, how in indexes.get("bloom", {}).items()}
    for i, meta in enumerate(done):
        if i in facts:
            meta.index.setdefault("range", {}).update(range_index(facts[i], schema, wanted))
        for c, found in blooms.items():
            if i in found:
                meta.index.setdefault("bloom", {})[c] = found[i]
    catalog.register_objects(done)
    return [m.id for m in done]


def read_objects(catalog: Catalog, ids: list[str], schema: Schema, with_id: bool = True) -> DataFrame:
    """All rows of objects, deletions too, with ``_id`` of their object if asked for: one scan whatever their number."""
    struct = T.StructType([T.StructField(LIVE, T.BooleanType()), *struct_of(schema).fields])
    if not ids:
        return catalog.spark.createDataFrame([], struct).withColumn("_id", F.lit(""))
    metas = catalog.objects(dict.fromkeys(ids))
    folders = [catalog.location(m) for m in metas]
    scan = catalog.spark.read.schema(struct).parquet(*folders)
    if not with_id:
        return scan
    if len(metas) == 1:
        return scan.withColumn("_id", F.lit(metas[0].id))
    last = [f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in folders]  # tells folders apart, whatever stands before
    number = catalog.spark.createDataFrame(list(zip(last, [m.id for m in metas])), "_path string, _id string")
    place = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"/([^/]+/[^/]+)/[^/]+$", 1)
    return scan.withColumn("_path", place).join(small(number, len(metas)), "_path").drop("_path")
