"""Scans of versioned tables: prune objects, read what nothing overlaps as it is, merge the rest latest-wins."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.catalog import Catalog, ObjectMeta, TableVersion
from lamina.fragments import LIVE, read_objects
from lamina.indexing import add_overlapping, chunk_groups, filter_bloom, filter_range, key_range
from lamina.quals import Quals, predicate
from lamina.runtime import small
from lamina.types import key_columns, struct_of

#: Bytes in memory for one of a compressed object.
WIDTH_FACTOR = 2.5


@dataclass
class Plan:
    """Objects that a query needs: those read as they are, and those merged by key."""

    required: list[ObjectMeta]
    singletons: list[ObjectMeta]
    merged: list[ObjectMeta]
    total: int
    total_bytes: int
    filters: list[str] = field(default_factory=list)

    @property
    def estimated_rows(self) -> int:
        return max(0, sum(m.rows_inserted - m.rows_deleted for m in self.required))

    @property
    def row_width(self) -> int:
        rows = sum(m.rows_inserted + m.rows_deleted for m in self.required)
        return math.ceil(sum(m.size for m in self.required) / rows * WIDTH_FACTOR) if rows else 0

    def explain(self) -> list[str]:
        return [
            f"Objects: {len(self.required)} of {self.total} ({sum(m.size for m in self.required)} of {self.total_bytes} B)",
            f"Read directly: {len(self.singletons)}; merged by key: {len(self.merged)}",
            f"Estimated rows: {self.estimated_rows}, width {self.row_width} B",
            *self.filters,
        ]


class TableScan:
    """A table at an image. Plans are kept by qualifiers and columns."""

    def __init__(self, catalog: Catalog, version: TableVersion):
        self.catalog, self.version = catalog, version
        self.schema = version.schema
        self._plans: dict[str, Plan] = {}
        self.planned = 0

    def plan(self, quals: Quals | None = None, columns: Sequence[str] | None = None) -> Plan:
        key = repr(quals)  # columns change what is read, not which objects
        if key not in self._plans:
            self.planned += 1
            self._plans[key] = self._make(quals)
        return self._plans[key]

    def _make(self, quals: Quals | None) -> Plan:
        everything = self.catalog.objects(dict.fromkeys(self.version.objects))
        ranges = {m.id: key_range(m, self.schema) for m in everything}
        by_range = filter_range(everything, quals, self.schema)
        kept = filter_bloom(by_range, quals, self.schema)
        notes = [f"Range index: {len(everything)} -> {len(by_range)}", f"Bloom index: {len(by_range)} -> {len(kept)}"] if quals else []
        required = add_overlapping(kept, everything, ranges) if len(kept) < len(everything) else kept
        if any(ranges[m.id] is None for m in required):
            # without known keys only a sequence of plain inserts can be read as it is
            plain = all(not m.rows_deleted for m in everything) and len(everything) == 1
            single = required if plain else []
        else:
            groups = chunk_groups([(m, *ranges[m.id]) for m in required])
            single = [g[0][0] for g in groups if len(g) == 1]
        ids = {m.id for m in single}
        return Plan(required, single, [m for m in required if m.id not in ids], len(everything), sum(m.size for m in everything), notes)

    def read(self, columns: Sequence[str] | None = None, quals: Quals | None = None) -> DataFrame:
        """The table's rows that meet the qualifiers; columns may repeat or change order."""
        names = [c.name for c in self.schema]
        for c in columns or []:
            if c not in names:
                raise ValueError(f"no column {c}")
        plan = self.plan(quals, columns)
        where = predicate(quals, self.schema)
        parts = []
        if plan.singletons:
            # conditions reach the Parquet scan here: nothing can hide a row of these objects
            rows = read_objects(self.catalog, [m.id for m in plan.singletons], self.schema, with_id=False).where(LIVE)
            parts.append(rows.where(where) if where is not None else rows)
        if plan.merged:
            rows = self._merge(plan.merged)
            parts.append(rows.where(where) if where is not None else rows)
        if not parts:
            empty = self.catalog.spark.createDataFrame([], struct_of(self.schema))
            return empty.select(*[F.col(f"`{c}`") for c in columns or names])
        out = parts[0].select(*[F.col(f"`{n}`") for n in names])
        for p in parts[1:]:
            out = out.unionByName(p.select(*[F.col(f"`{n}`") for n in names]))
        return out.select(*[F.col(f"`{c}`") for c in columns]) if columns else out

    def _merge(self, metas: list[ObjectMeta]) -> DataFrame:
        """Rows of the last object that has their key. Within one object equal keys stay, as tables without key have them.

        Objects that meet no earlier one are the ground; only keys of the others, which are patches as a rule, can
        replace their rows, so these are anti-joined and the ground isn't shuffled where the patches are few.
        """
        order = {i: n for n, i in enumerate(dict.fromkeys(self.version.objects))}
        metas = sorted(metas, key=lambda m: order[m.id])
        ranges = {m.id: key_range(m, self.schema) for m in metas}
        ground, over = [], []
        if any(r is None for r in ranges.values()):
            ground, over = metas[:1], metas[1:]
        else:
            reached: list[tuple] = []  # disjoint (least, greatest) of the objects so far, in order
            for m in metas:
                lo, hi = ranges[m.id]
                at = bisect.bisect_left(reached, (lo,))
                at -= at > 0 and reached[at - 1][1] >= lo
                end = at
                while end < len(reached) and reached[end][0] <= hi:
                    end += 1
                (over if end > at else ground).append(m)
                joined = reached[at:end]
                reached[at:end] = [(min([lo, *[x[0] for x in joined]]), max([hi, *[x[1] for x in joined]]))]
        keys = [F.col(f"`{c.name}`") for c in key_columns(self.schema)]
        base = read_objects(self.catalog, [m.id for m in ground], self.schema, with_id=False).where(LIVE)
        if not over:
            return base
        number = self.catalog.spark.createDataFrame([(m.id, order[m.id]) for m in over], "_id string, _ord int")
        rows = read_objects(self.catalog, [m.id for m in over], self.schema).join(small(number, len(over)), "_id").drop("_id")
        changed = small(rows.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]), sum(m.rows_inserted + m.rows_deleted for m in over))
        cond = None
        for i, k in enumerate(keys):
            same = k.eqNullSafe(F.col(f"_k{i}"))
            cond = same if cond is None else cond & same
        last = rows.withColumn("_last", F.max("_ord").over(Window.partitionBy(*keys))).where(F.col(LIVE) & (F.col("_ord") == F.col("_last")))
        names = [F.col(f"`{c.name}`") for c in self.schema]
        return base.join(changed, cond, "left_anti").select(*names).unionByName(last.select(*names))

    def count(self) -> int:
        """Rows by metadata alone."""
        return sum(m.rows_inserted - m.rows_deleted for m in self.catalog.objects(self.version.objects))

    def size(self) -> int:
        """Bytes of the objects; one that is listed twice counts twice."""
        return sum(m.size for m in self.catalog.objects(self.version.objects))
