"""Data skipping: min/max ranges and bloom filters of objects, and which objects a query may need."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.quals import Quals, to_cnf
from lamina.rowtext import row_text
from lamina.runtime import small
from lamina.types import Schema, is_indexable, key_columns, plain, spark_type, typed

PK, ROW = "$pk", "$row"


def range_columns(schema: Schema, wanted: Sequence[str] | None = None) -> Schema:
    """Columns to index: the key always, others all, or those that are wanted."""
    unknown = set(wanted or []) - {c.name for c in schema}
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return [c for c in schema if is_indexable(c) and (c.is_pk or wanted is None or c.name in wanted)]


def range_aggs(schema: Schema, wanted: Sequence[str] | None = None, old: str | None = None, text: SparkColumn | None = None) -> list[SparkColumn]:
    """Aggregates of least and greatest values, by position; old values of changed rows widen the range.

    text: of the row, where it is at hand, for tables without key.
    """
    out = []
    for i, c in enumerate(range_columns(schema, wanted)):
        now = F.col(f"`{c.name}`")
        both = [now] + ([F.col(f"`{old}`")[c.name]] if old else [])
        out += [(F.min(F.least(*both)) if old else F.min(now)).alias(f"lo{i}"), (F.max(F.greatest(*both)) if old else F.max(now)).alias(f"hi{i}")]
    pk = [F.col(f"`{c.name}`") for c in schema if c.is_pk]
    if len(pk) > 1:
        out += [F.min(F.struct(*pk)).alias("pk_lo"), F.max(F.struct(*pk)).alias("pk_hi")]
    if not pk:
        text = row_text(key_columns(schema)) if text is None else text
        out += [F.min(text).alias("row_lo"), F.max(text).alias("row_hi")]
    return out


def range_index(row, schema: Schema, wanted: Sequence[str] | None = None) -> dict:
    out = {c.name: [plain(row[f"lo{i}"]), plain(row[f"hi{i}"])] for i, c in enumerate(range_columns(schema, wanted))}
    if not any(c.is_pk for c in schema):
        out[ROW] = [row["row_lo"], row["row_hi"]]
    if sum(c.is_pk for c in schema) > 1:
        out[PK] = [plain(list(row["pk_lo"])) if row["pk_lo"] else None, plain(list(row["pk_hi"])) if row["pk_hi"] else None]
    return out


def key_range(meta, schema: Schema) -> tuple | None:
    """Least and greatest key of an object as comparable tuples, row text where there is no key; None where unknown."""
    pk = [c for c in schema if c.is_pk]
    if not pk:
        found = meta.index.get("range", {}).get(ROW)
        return tuple((x.encode("utf-8", "surrogatepass"),) for x in found) if found and found[0] is not None else None
    found = meta.index.get("range", {}).get(PK if len(pk) > 1 else pk[0].name)
    if not found or found[0] is None:
        return None
    lo, hi = found if len(pk) > 1 else ([found[0]], [found[1]])
    return tuple(tuple(typed(v, c.type) for v, c in zip(x, pk)) for x in (lo, hi))


def may_match_range(index: dict, clause, schema: Schema) -> bool:
    """Whether an object with this range index can hold a row for one OR clause."""
    kinds = {c.name: c for c in schema}
    for name, op, value in clause:
        column, found = kinds.get(name), index.get("range", {}).get(name)
        if column is None or found is None or op not in ("=", ">", ">=", "<", "<=") or not is_indexable(column):
            return True
        lo, hi = (typed(v, column.type) for v in found)
        if lo is None:
            continue  # nothing but nulls
        v = typed(value, column.type)
        if {"=": lambda: lo <= v <= hi, ">": lambda: hi > v, ">=": lambda: hi >= v, "<": lambda: lo < v, "<=": lambda: lo <= v}[op]():
            return True
    return False


def filter_range(metas, quals: Quals | None, schema: Schema) -> list:
    cnf = to_cnf(quals)
    return [m for m in metas if all(may_match_range(m.index, clause, schema) for clause in cnf)]


# bloom filters


def bloom_hashes(value: str | None) -> tuple[int, int]:
    text = "NULL" if value is None else value
    return tuple(int(hashlib.sha256(t.encode()).hexdigest(), 16) for t in (text, text + "salt"))


def bloom_shape(n: int, probability: float | None = None, size: int | None = None) -> tuple[int, int]:
    """(bytes, hash functions) for n distinct values."""
    if (probability is None) == (size is None):
        raise ValueError("give either a probability or a size")
    if size is None:
        size = math.ceil(-n * math.log(probability) / math.log(2) ** 2 / 8)
    size = max(1, size)
    return size, max(1, math.ceil(math.log(2) * size * 8 / max(1, n)))


def bloom_bits(values: DataFrame, group: str, column: str, shape: DataFrame, groups: int) -> DataFrame:
    """(group, k, bits) with filters built by partial OR on each map task. shape: (group, size, k)."""

    def remainder(digests, m: np.ndarray) -> np.ndarray:
        """256-bit numbers modulo each row's m, word by word."""
        words = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8)
        out = np.zeros(len(words), np.uint64)
        for i in range(8):
            out = ((out << np.uint64(32)) | words[:, i].astype(np.uint64)) % m
        return out

    def fill(batches):
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            group, first, step, size, k = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_numpy(), b.column(4).to_numpy()
            m = size.astype(np.uint64) * np.uint64(8)
            a, z = remainder(first, m), remainder(step, m)
            for g in np.unique(group):
                here = group == g
                if g not in held:
                    held[int(g)] = (int(k[here][0]), np.zeros(int(size[here][0]), np.uint8))
                bits, most = held[int(g)][1], m[here][0]
                for i in range(held[int(g)][0]):
                    at = (a[here] + np.uint64(i) * z[here]) % most
                    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for g, (k, bits) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["g", "k", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table([table.column("g").slice(0, 1), table.column("k").slice(0, 1), pa.array([bits.tobytes()], pa.binary())], ["g", "k", "bits"])

    value = F.coalesce(F.col(column), F.lit("NULL"))
    hashed = [F.unhex(F.sha2(v, 256)) for v in (value, F.concat(value, F.lit("salt")))]
    sized = values.join(small(shape, groups), group).select(F.col(group).cast("long").alias("g"), *hashed, "size", "k")
    return sized.mapInArrow(fill, "g long, k int, bits binary").groupBy("g").applyInArrow(merge, "g long, k int, bits binary")


def build_blooms(rows: DataFrame, group: str, column: str, probability: float | None = None, size: int | None = None) -> dict[int, list]:
    """[k, base64] by group over the column's values as text."""
    if (probability is None) == (size is None):
        raise ValueError("give either a probability or a size")
    distinct = rows.select(group, F.col(f"`{column}`").cast("string").alias("v")).distinct()
    counts = {r[group]: r["n"] for r in distinct.groupBy(group).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    shapes = [(int(g), *bloom_shape(n, probability, size)) for g, n in counts.items()]
    shape = rows.sparkSession.createDataFrame(shapes, f"{group} long, size int, k int")
    return {r["g"]: [r["k"], base64.b64encode(r["bits"]).decode()] for r in bloom_bits(distinct, group, "v", shape, len(counts)).collect()}


def bloom_has(entry: list, value: str | None) -> bool:
    k, bits = entry[0], base64.b64decode(entry[1])
    a, z = bloom_hashes(value)
    return all(bits[(at := (a + i * z) % (len(bits) * 8)) >> 3] >> (at & 7) & 1 for i in range(k))


def describe_bloom(entry: list) -> str:
    k, bits = entry[0], base64.b64decode(entry[1])
    m, ones = len(bits) * 8, sum(x.bit_count() for x in bits)
    if ones == m:
        return f"k={k}, size {len(bits):.2f} B, saturated"
    n = -m / k * math.log(1 - ones / m)
    return f"k={k}, size {len(bits):.2f} B, approx. {n:.0f} item(s), false positive probability {100 * (1 - math.exp(-k * n / m)) ** k:.1f}%"


def filter_bloom(metas, quals: Quals | None, schema: Schema) -> list:
    kinds = {c.name: c for c in schema}

    def may(meta, clause) -> bool:
        if any(op != "=" for _, op, _ in clause):
            return True
        for name, _, value in clause:
            entry = meta.index.get("bloom", {}).get(name)
            if entry is None or name not in kinds or bloom_has(entry, bloom_text(value, kinds[name].type)):
                return True
        return False

    cnf = to_cnf(quals)
    return [m for m in metas if all(may(m, clause) for clause in cnf)]


def bloom_text(value, name: str) -> str:
    """A literal as Spark would print the column's value."""
    kind = spark_type(name).typeName()
    if kind in ("byte", "short", "integer", "long"):
        return str(int(value)) if float(value).is_integer() else str(value)
    if kind in ("float", "double"):
        return repr(float(value))
    return value if isinstance(value, str) else str(value)


# overlap


def overlap(a: tuple | None, b: tuple | None) -> bool:
    """Closed key ranges that touch overlap; an unknown range overlaps everything."""
    return a is None or b is None or (a[0] <= b[1] and b[0] <= a[1])


def chunk_groups(chunks: list[tuple]) -> list[list[tuple]]:
    """Disjoint groups of (id, least, greatest) whose ranges meet; within a group the given order stays. None sorts last."""
    order = sorted(range(len(chunks)), key=lambda i: (chunks[i][1] is None, chunks[i][1] if chunks[i][1] is not None else 0))
    groups: list[list[int]] = []
    end = None
    for i in order:
        lo, hi = chunks[i][1], chunks[i][2]
        if groups and (end is None or lo is None or lo <= end):
            groups[-1].append(i)
            end = None if hi is None or end is None else max(end, hi)
        else:
            groups.append([i])
            end = hi
    return [[chunks[i] for i in sorted(g)] for g in groups]


def add_overlapping(kept: list, everything: list, ranges: dict) -> list:
    """Kept objects and every later one whose keys meet those of a kept earlier one, in order of everything.

    A sweep over sorted ranges: objects beyond the kept ones are compared only with those that begin before they end.
    """
    ids = {m.id for m in kept}
    order = {m.id: i for i, m in enumerate(everything)}
    unknown = any(ranges[m.id] is None for m in everything)
    if unknown:
        first = min((order[m.id] for m in kept), default=len(everything))
        return [m for m in everything if m.id in ids or (order[m.id] > first and any(order[k.id] < order[m.id] and overlap(ranges[k.id], ranges[m.id]) for k in kept))]
    events = sorted([(ranges[m.id][0], 0, m) for m in everything] + [(ranges[m.id][1], 1, m) for m in everything], key=lambda e: (e[0], e[1]))
    open_kept: dict[str, int] = {}
    open_rest: dict[str, object] = {}
    out = set(ids)
    for _, closing, m in events:
        side = open_kept if m.id in ids else open_rest
        if closing:
            side.pop(m.id, None)
            continue
        if m.id in ids:
            out |= {x for x in open_rest if order[x] > order[m.id]}
            open_kept[m.id] = order[m.id]
        else:
            if any(o < order[m.id] for o in open_kept.values()):
                out.add(m.id)
            open_rest[m.id] = m
    return [m for m in everything if m.id in out]
