"""Repositories: commit, checkout, working copies, time travel, diffs, imports and exchange between roots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import changes as ch
from lamina.catalog import HEAD, ROOT, Catalog, Image, Images, ObjectMeta, TableVersion, now, parse_name
from lamina.dialect import settled
from lamina.fragments import _CHUNK as CHUNK_COLUMN
from lamina.fragments import CHUNK, read_objects, reindex, write_base, write_patch
from lamina.quals import Quals
from lamina.runtime import small
from lamina.scan import TableScan
from lamina.sqlguard import ForbiddenSQL, relations
from lamina.store import NotFound, Store
from lamina.types import Schema, compatible, dumps, schema_of, struct_of


class PendingChanges(RuntimeError):
    """The working copy holds changes that would be lost."""


class Conflict(RuntimeError):
    """Another writer has moved the repository's head."""


@dataclass
class Staged:
    """A table of a working copy: its base version, logs of edits, or a whole new content."""

    schema: Schema
    base: TableVersion | None = None
    logs: list[str] = field(default_factory=list)
    replaced: str | None = None
    seq: int = 0
    uppers: list[str] = field(default_factory=list)


class Repository:
    """One repository below a root. ``images`` has its images and tags."""

    def __init__(self, catalog: Catalog, name: str):
        self.catalog = catalog
        self.namespace, self.repository = parse_name(name)
        self.images = Images(catalog, self.namespace, self.repository)
        self.work: WorkingCopy | None = None

    @property
    def name(self) -> str:
        return self.images.name

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark

    def init(self) -> Image:
        """Root image without tables, checked out."""
        if self.images.exists():
            raise ValueError(f"repository {self.name} exists")
        root = self.images.add(None, ROOT)
        self.images.tag(ROOT, HEAD)
        self.work = WorkingCopy(self, root)
        return root

    def delete(self) -> None:
        """Remove images and tags; objects stay until the catalog's cleanup."""
        self.catalog.check_privilege(self.namespace)
        self.catalog.store.delete(*self.images.at)
        self.work = None

    @property
    def head(self) -> Image | None:
        return self.images.by_tag(HEAD)

    def table(self, image: str | Image, name: str) -> TableScan:
        image = image if isinstance(image, Image) else self.images[image]
        if name not in image.tables:
            raise NotFound(f"no table {name} in image {image.hash[:12]}")
        return TableScan(self.catalog, image.tables[name])

    # working copy

    def checkout(self, image: str = "latest", force: bool = False) -> WorkingCopy:
        if self.work and self.work.has_pending() and not force:
            raise PendingChanges(f"{self.name} has pending changes")
        found = self.images[image]
        self.images.tag(found.hash, HEAD)
        self.work = WorkingCopy(self, found)
        return self.work

    def uncheckout(self, force: bool = False) -> None:
        if self.work and self.work.has_pending() and not force:
            raise PendingChanges(f"{self.name} has pending changes")
        self.work = None
        if HEAD in self.images.tags():
            self.images.untag(HEAD)

    def commit(self, image_hash: str | None = None, comment: str | None = None, snap_only: bool = False, chunk_size: int | None = CHUNK, split_changeset: bool = False, indexes: dict[str, dict] | None = None, sort: dict[str, Sequence[str]] | None = None, provenance: list[dict] | None = None) -> Image:
        """New image from the working copy; moves HEAD.

        A table that is new, replaced or of another schema becomes a base; changes of a known one become patches; one
        without changes keeps its objects. ``indexes`` and ``sort`` are by table.
        """
        work = self.work
        if work is None:
            raise NotFound(f"{self.name} isn't checked out")
        head = self.head
        if head is None or head.hash != work.image.hash:
            raise Conflict(f"head of {self.name} has moved")
        tables: dict[str, TableVersion] = {}
        for name, s in work.tables.items():
            index, order = (indexes or {}).get(name), (sort or {}).get(name)
            work.settle(name)
            pending = bool(s.logs)
            if s.base is None or s.replaced or not compatible(s.schema, s.base.schema) or (snap_only and pending):
                tables[name] = TableVersion(s.schema, write_base(self.catalog, work.table(name), s.schema, chunk_size, index, order))
            elif pending:
                net = ch.conflate(work.log(name), s.schema)
                new = write_patch(self.catalog, net, s.schema, s.base.objects, split_changeset, index, order)
                tables[name] = TableVersion(s.schema, [*s.base.objects, *new])
            else:
                tables[name] = TableVersion(s.schema, s.base.objects)
        image = self.images.add(work.image.hash, image_hash, tables, comment, provenance)
        self.images.tag(image.hash, HEAD)
        work.discard()
        self.work = WorkingCopy(self, image)
        return image

    def has_pending_changes(self) -> bool:
        return bool(self.work and self.work.has_pending())

    # differences

    def diff(self, table: str, left: str | Image, right: str | Image | None = None):
        """Rows added and removed, as a DataFrame; True or False where the table is only right or only left.

        Without right, the working copy.
        """
        a = left if isinstance(left, Image) else self.images[left]
        b = None if right is None else right if isinstance(right, Image) else self.images[right]
        there = table in (self.work.tables if b is None else b.tables)
        if table not in a.tables:
            return True
        if not there:
            return False
        old, new = self.table(a, table).read(), self.work.table(table) if b is None else self.table(b, table).read()
        if b is not None and a.tables[table].objects == b.tables[table].objects:
            return ch.diff(old, new).limit(0)
        return ch.diff(old, new)

    def diff_counts(self, table: str, left: str | Image, right: str | Image | None = None):
        """(inserted, deleted, updated): raw logged counts against the working copy of HEAD, set counts between images."""
        a = left if isinstance(left, Image) else self.images[left]
        if right is None and self.work and self.work.image.hash == a.hash and table in self.work.tables and not self.work.tables[table].replaced:
            return ch.counts(self.work.log(table))
        found = self.diff(table, left, right)
        if isinstance(found, bool):
            return found
        r = found.agg(F.count(F.when(F.col("added"), 1)).alias("a"), F.count(F.when(~F.col("added"), 1)).alias("d")).first()
        return r["a"], r["d"], 0

    # sizes

    def size(self) -> int:
        ids = {o for i in self.images for t in i.tables.values() for o in t.objects}
        return sum(m.size for m in self.catalog.objects(ids))

    def image_size(self, image: str) -> int:
        return sum(m.size for m in self.catalog.objects({o for t in self.images[image].tables.values() for o in t.objects}))

    # imports and exchange

    def import_tables(self, names: Sequence[str], source: Repository, source_names: Sequence[str], image: str = "latest", queries: Sequence[bool] | None = None, keep_existing: bool = True, chunk_size: int | None = CHUNK, image_hash: str | None = None, comment: str | None = None, provenance: list[dict] | None = None) -> Image:
        """Tables of another repository by reference, or results of queries over it, as a new image here."""
        queries = list(queries or [False] * len(names))
        if not len(names) == len(source_names) == len(queries):
            raise ValueError("names, sources and query flags differ in number")
        if len(set(names)) < len(names):
            raise ValueError("a table is named twice")
        head = self.head
        tables = dict(head.tables) if head and keep_existing else {}
        clash = set(names) & set(tables)
        if clash:
            raise ValueError(f"tables that exist already: {sorted(clash)}")
        found = source.images[image]
        for name, origin, is_query in zip(names, source_names, queries):
            if is_query:
                df = run_sql(self.spark, origin, {t: TableScan(source.catalog, v).read for t, v in found.tables.items()})
                schema = schema_of(df.schema)
                tables[name] = TableVersion(schema, write_base(self.catalog, df, schema, chunk_size))
            else:
                if origin not in found.tables:
                    raise NotFound(f"no table {origin} in {source.name}")
                version = found.tables[origin]
                copy_objects(source.catalog, self.catalog, version.objects, schemas=dict.fromkeys(version.objects, version.schema))
                tables[name] = TableVersion(version.schema, list(version.objects))
        made = self.images.add(head.hash if head else None, image_hash, tables, comment or f"Importing {', '.join(names)} from {source.name}", provenance)
        self.images.tag(made.hash, HEAD)
        self.work = WorkingCopy(self, made)
        return made

    def import_frame(self, name: str, df: DataFrame, pk: Sequence[str] = (), chunk_size: int | None = CHUNK, comment: str | None = None) -> Image:
        """A DataFrame as a new table of a new image."""
        if not self.images.exists():
            self.init()
        work = self.work or self.checkout(self.head.hash if self.head else "latest")
        work.create(name, df, pk)
        return self.commit(chunk_size=chunk_size, comment=comment)

    def sync_to(self, other: Repository, image: str | None = None, overwrite_tags: bool = False, overwrite_objects: bool = False) -> list[str]:
        """Copy images, objects and tags that the other lacks; returns the copied images."""
        wanted = self.images.log(self.images[image].hash) if image else list(self.images)
        here = [i for i in wanted if not other.images.has(i.hash)]
        schemas = {o: t.schema for i in here for t in i.tables.values() for o in t.objects}
        copy_objects(self.catalog, other.catalog, schemas, overwrite_objects, schemas)
        for i in sorted(here, key=lambda i: i.created):
            other.images.add(i.parent, i.hash, i.tables, i.comment, i.provenance, i.created)
        theirs = other.images.tags()
        for tag, h in self.images.tags().items():
            if tag != HEAD and other.images.has(h) and (overwrite_tags or tag not in theirs):
                other.images.tag(h, tag)
        return [i.hash for i in here]

    def push(self, remote: Repository, **options) -> list[str]:
        done = self.sync_to(remote, **options)
        self.images.set_upstream(f"{remote.catalog.store.root}#{remote.name}")
        return done

    def pull(self, remote: Repository | None = None, **options) -> list[str]:
        if remote is None:
            upstream = self.images.upstream()
            if upstream is None:
                raise NotFound(f"{self.name} has no upstream")
            root, name = upstream.rsplit("#", 1)
            remote = Repository(Catalog(self.spark, root), name)
        return remote.sync_to(self, **options)

    def clone(self, name: str, catalog: Catalog | None = None) -> Repository:
        other = Repository(catalog or self.catalog, name)
        self.sync_to(other)
        other.images.set_upstream(f"{self.catalog.store.root}#{self.name}")
        return other

    def dump(self, path: str, contents: bool = False) -> str:
        """Manifests of the repository as one JSON file; the HEAD tag is left out. With contents, objects go to a root beside it."""
        ids = sorted({o for i in self.images for t in i.tables.values() for o in t.objects})
        body = {
            "repository": self.name,
            "images": [i.to_json() for i in self.images],
            "tags": {t: h for t, h in self.images.tags().items() if t != HEAD},
            "objects": [self.catalog.object(o).to_json() for o in ids],
            "contents": f"{path}.objects" if contents else None,
        }
        if contents:
            schemas = {o: t.schema for i in self.images for t in i.tables.values() for o in t.objects}
            copy_objects(self.catalog, Catalog(self.spark, f"{path}.objects"), ids, True, schemas)
        store = Store(self.spark, path.rsplit("/", 1)[0] or "/")
        store.write(body, path.rsplit("/", 1)[1])
        return path

    def load_dump(self, path: str) -> list[str]:
        """Images, tags and, where the dump has them, objects of a dump into this repository; the images that are new."""
        body = Store(self.spark, path.rsplit("/", 1)[0] or "/").read(path.rsplit("/", 1)[1])
        images = [Image.of(x) for x in body["images"]]
        if body["contents"]:
            schemas = {o: t.schema for i in images for t in i.tables.values() for o in t.objects}
            copy_objects(Catalog(self.spark, body["contents"]), self.catalog, [x["id"] for x in body["objects"]], False, schemas)
        new = [i for i in sorted(images, key=lambda i: i.created) if not self.images.has(i.hash)]
        for i in new:
            self.images.add(i.parent, i.hash, i.tables, i.comment, i.provenance, i.created)
        for t, h in body["tags"].items():
            self.images.tag(h, t)
        return [i.hash for i in new]

    def reindex(self, image: str, table: str, indexes: dict, skip_patches: bool = True) -> list[str]:
        version = self.images[image].tables[table]
        return reindex(self.catalog, version.objects, version.schema, indexes, skip_patches)

    def import_from_remote(self, remote: Repository, image: str, tables: Sequence[str], names: Sequence[str] | None = None) -> Image:
        """Tables of a repository in another root: their objects come along, its history doesn't."""
        return self.import_tables(list(names or tables), remote, list(tables), image)

    def prepare_image(self, base: str | None = None, comment: str | None = None) -> Image:
        """A new image with the tables of another, to be filled by a loader."""
        if not self.images.exists():
            self.init()
        found = self.images[base] if base else None
        return self.images.add(found.hash if found else None, None, dict(found.tables) if found else {}, comment)

    def make_latest(self, image: str) -> Image:
        """Move an image's time of creation, so that it is the latest."""
        found = self.images[image]
        found.created = now()
        self.images.update(found)
        return found

    # queries

    def sql_as(self, query: str, image: str | None = None, many_rows: bool = True, many_columns: bool = True):
        """Rows of a query as plain Python: all or the first, whole or their first value."""
        df = self.sql(query, image)
        rows = df.collect() if many_rows else df.limit(1).collect()
        shaped = [tuple(r) if many_columns else r[0] for r in rows]
        return shaped if many_rows else (shaped[0] if shaped else None)

    def sql(self, query: str, image: str | None = None) -> DataFrame:
        """SELECT over the tables of an image, or of the working copy, read lazily."""
        if image is None and self.work is not None:
            return run_sql(self.spark, query, {t: (lambda t=t: self.work.table(t)) for t in self.work.tables})
        found = self.images[image or "latest"]
        return run_sql(self.spark, query, {t: TableScan(self.catalog, v).read for t, v in found.tables.items()})


class WorkingCopy:
    """Editable tables over an image. Each statement's effect is written to a log in the root, so it runs once."""

    def __init__(self, repo: Repository, image: Image):
        self.repo, self.image = repo, image
        self.tables = {n: Staged(v.schema, v) for n, v in image.tables.items()}
        self.dropped: set[str] = set()
        self._paths: list[str] = []

    @property
    def spark(self) -> SparkSession:
        return self.repo.spark

    def _staged(self, name: str) -> Staged:
        if name not in self.tables:
            raise NotFound(f"no table {name}")
        return self.tables[name]

    def _write(self, df: DataFrame) -> str:
        path = self.repo.catalog.store.staging()
        df.write.parquet(path)
        self._paths.append(path)
        return path

    def log(self, name: str) -> DataFrame:
        s = self._staged(name)
        self.settle(name)
        return self.spark.read.schema(ch.empty_log(self.spark, s.schema).schema).parquet(*s.logs) if s.logs else ch.empty_log(self.spark, s.schema)

    def table(self, name: str) -> DataFrame:
        """Current content."""
        s = self._staged(name)
        kind = struct_of(s.schema)
        if s.replaced:
            base = self.spark.read.schema(kind).parquet(s.replaced)
        elif s.base:
            base = TableScan(self.repo.catalog, s.base).read()
        else:
            base = self.spark.createDataFrame([], kind)
        if s.uppers:
            return ch.overlay(base, self.spark.read.parquet(*s.uppers), s.schema)
        if not s.logs:
            return base
        net = ch.conflate(self.log(name), s.schema)
        keys = [c.name for c in ch.key_columns(s.schema)]
        gone = net.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
        cond = None
        for i, k in enumerate(keys):
            part = F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
            cond = part if cond is None else cond & part
        return base.join(gone, cond, "left_anti").unionByName(net.where("upserted").select("new.*"))

    def scan(self, name: str, quals: Quals | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        from lamina.quals import predicate

        df, where = self.table(name), predicate(quals, self._staged(name).schema)
        df = df.where(where) if where is not None else df
        return df.select(*columns) if columns else df

    def _append(self, name: str, log: DataFrame) -> None:
        s = self._staged(name)
        if s.uppers:
            self.settle(name)
        s.logs.append(self._write(log))
        s.seq += 1

    def insert(self, name: str, df: DataFrame) -> None:
        s = self._staged(name)
        if s.base is None or s.replaced:
            self._replace(name, self.table(name).unionByName(df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in struct_of(s.schema).fields])))
        else:
            typed = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in struct_of(s.schema).fields])
            self._append(name, ch.log_of(typed, s.schema, ch.INSERT, s.seq))

    def upper(self, name: str, rows: DataFrame, flag: bool | SparkColumn = True) -> None:
        """Write rows over a table without reading it: present with these values, or, without the flag, gone.

        The rows lie over the base, and a row written later over one written earlier (``changes.overlay``), until a
        commit finds what they replace and stores it as a patch.
        """
        s = self._staged(name)
        if s.base is None or s.replaced or s.logs:
            raise ValueError(f"{name} has edits of its own: rows can only be laid over a committed table")
        kinds = struct_of(s.schema).fields
        columns = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]
        flagged = flag if isinstance(flag, SparkColumn) else F.lit(flag)
        s.uppers.append(self._write(rows.select(*columns, flagged.alias("flag"), F.lit(len(s.uppers)).cast("long").alias("seq"))))

    def settle(self, name: str) -> None:
        """Turn rows laid over a table into edits, with the old values that they replace."""
        s = self._staged(name)
        if s.uppers:
            lower = TableScan(self.repo.catalog, s.base).read()
            net = ch.overlay_changes(lower, self.spark.read.parquet(*s.uppers), s.schema)
            op = F.when(F.col("old").isNull(), ch.INSERT).when(~F.col("upserted"), ch.DELETE).otherwise(ch.UPDATE)
            log = net.where(F.col("upserted") | F.col("old").isNotNull()).select(F.lit(s.seq).cast("long").alias("seq"), op.cast("int").alias("op"), "old", "new")
            s.uppers = []
            self._append(name, log)

    def delete(self, name: str, where: str | SparkColumn = "true") -> None:
        s = self._staged(name)
        cond = F.expr(where) if isinstance(where, str) else where
        if s.base is None or s.replaced:
            self._replace(name, self.table(name).where(~F.coalesce(cond, F.lit(False))))
        else:
            self._append(name, ch.log_of(self.table(name).where(cond), s.schema, ch.DELETE, s.seq))

    def update(self, name: str, new: dict[str, str | SparkColumn], where: str | SparkColumn = "true") -> None:
        s = self._staged(name)
        unknown = set(new) - {c.name for c in s.schema}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        cols = {k: F.expr(v) if isinstance(v, str) else v for k, v in new.items()}
        cond = F.expr(where) if isinstance(where, str) else where
        if s.base is None or s.replaced:
            df = self.table(name)
            kind = {f.name: f.dataType for f in struct_of(s.schema).fields}
            hit = F.coalesce(cond, F.lit(False))
            self._replace(name, df.select(*[(F.when(hit, cols[c].cast(kind[c])).otherwise(F.col(f"`{c}`")) if c in cols else F.col(f"`{c}`")).alias(c) for c in df.columns]))
        else:
            self._append(name, ch.log_of(self.table(name).where(cond), s.schema, ch.UPDATE, s.seq, cols))

    def _replace(self, name: str, df: DataFrame) -> None:
        s = self.tables[name]
        s.replaced, s.logs = self._write(df), []

    def create(self, name: str, df: DataFrame, pk: Sequence[str] = (), schema: Schema | None = None) -> None:
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        schema = schema or schema_of(df.schema, tuple(pk))
        self.tables[name] = Staged(schema)
        self._replace(name, df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in struct_of(schema).fields]))

    def drop(self, name: str) -> None:
        self._staged(name)
        del self.tables[name]
        self.dropped.add(name)

    def alter(self, name: str, add: dict[str, str] | None = None, drop: Sequence[str] = (), pk: Sequence[str] | None = None) -> None:
        """Change the schema; the next commit stores the table anew. New columns get ordinals of their own."""
        from lamina.types import Column, spark_type

        s = self._staged(name)
        content = self.table(name)
        schema = [c for c in s.schema if c.name not in drop]
        last = max((c.ordinal for c in s.schema), default=0)
        schema += [Column(last + i, n, t) for i, (n, t) in enumerate((add or {}).items(), 1)]
        if pk is not None:
            schema = [replace(c, is_pk=c.name in pk) for c in schema]
        have = set(content.columns)
        df = content.select(*[(F.col(f"`{c.name}`") if c.name in have and c.name not in (add or {}) else F.lit(None).cast(spark_type(c.type))).alias(c.name) for c in schema])
        s.schema = schema
        self._replace(name, df)

    def pending(self) -> dict[str, tuple[int, int, int] | bool]:
        """Raw counts by changed table; True for new and replaced ones, False for dropped ones."""
        out: dict = {}
        for n, s in self.tables.items():
            if s.base is None or s.replaced:
                out[n] = True
            elif (s.logs or s.uppers) and any(c := ch.counts(self.log(n))):
                out[n] = c
        return out | {n: False for n in self.dropped if n not in self.tables}

    def has_pending(self) -> bool:
        return bool(self.pending())

    def discard(self) -> None:
        store = self.repo.catalog.store
        for p in self._paths:
            store.delete_path(store._path(p))
        self._paths.clear()
        self.tables = {n: Staged(v.schema, v) for n, v in self.image.tables.items()}
        self.dropped.clear()

    def sql(self, script: str) -> None:
        """Run a script of permitted statements on the staged tables."""
        from lamina.build import run_script

        run_script(self, script)


#: Objects that are copied one by one; more are copied by the cluster.
COPY_ONE_BY_ONE = 4


def copy_objects(source: Catalog, target: Catalog, ids, overwrite: bool = False, schemas: dict[str, Schema] | None = None) -> list[str]:
    """Objects that the target lacks. Many are read and written by the cluster, as one job for each schema, and registered at once.

    schemas: of each object, for that.
    """
    if source.store.root == target.store.root:
        return []
    todo = list(dict.fromkeys(ids)) if overwrite else target.new_objects(ids)
    by: dict[str, list[str]] = {}
    for i in todo:
        by.setdefault(dumps([c.__dict__ for c in schemas[i]]) if schemas and i in schemas else "", []).append(i)
    done: list[ObjectMeta] = []
    if overwrite:
        target.drop_objects(todo)
    try:
        for kind, part in by.items():
            batch, metas = uuid.uuid4().hex, source.objects(part)
            if not kind or len(part) <= COPY_ONE_BY_ONE:
                for n, m in enumerate(metas):
                    source.store.copy_to(target.store, m.path, to=f"objects/{batch}/{CHUNK_COLUMN}={n}")
                    done.append(replace(m, path=f"objects/{batch}/{CHUNK_COLUMN}={n}"))
                continue
            number = source.spark.createDataFrame([(m.id, n) for n, m in enumerate(metas)], f"_id string, {CHUNK_COLUMN} long")
            rows = read_objects(source, part, schemas[part[0]]).join(small(number, len(metas)), "_id").drop("_id")
            rows.repartition(min(len(metas), 10_000), CHUNK_COLUMN).write.partitionBy(CHUNK_COLUMN).option("compression", "zstd").parquet(staging := target.store.staging())
            sizes = target.store.sizes(staging)
            target.store.move(staging, "objects", batch)
            done += [replace(m, path=f"objects/{batch}/{CHUNK_COLUMN}={n}", size=sizes.get(f"{CHUNK_COLUMN}={n}", m.size)) for n, m in enumerate(metas)]
    finally:
        target.register_objects(done)  # also of a copy that failed half-way: the next one goes on from there
    return todo


def run_sql(spark: SparkSession, query: str, tables: dict) -> DataFrame:
    """SELECT in PostgreSQL's dialect over named tables without names in the session's catalog.

    tables: name to a function that gives its DataFrame; only those that the query names are made. Each becomes a
    leading common table expression. Nothing else can be read: a name that isn't among them is refused, whatever the
    session's own catalog has.
    """
    used: dict[str, str] = {}
    for r in relations(spark, query):
        name = r[0] if len(r) == 1 else ".".join(r)
        known = name if name in tables else name.lower() if name.lower() in tables else None
        if len(r) > 1 or known is None:
            raise ForbiddenSQL(f"no table {name}; there are {', '.join(sorted(tables)) or 'none'}")
        used[name] = known
    views = {name: f"v_{uuid.uuid4().hex}" for name in sorted(used)}
    try:
        for name, view in views.items():
            tables[used[name]]().createOrReplaceTempView(view)
        text = query.strip().rstrip(";")
        if views:
            text = "WITH " + ", ".join(f"`{n}` AS (SELECT * FROM {v})" for n, v in views.items()) + f" ({text}\n)"
        out = spark.sql(settled(spark, text))
        out.schema  # analysed now, while the views stand; the plan keeps what they meant
        return out
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def describe(image: Image) -> str:
    return dumps(image.to_json())


def lookup(name: str, local: Catalog, others: Sequence[Catalog] = (), overrides: dict[str, Catalog] | None = None) -> Repository:
    """The repository of that name: where an override says, here, or in the first other root that has it."""
    if name in (overrides or {}):
        return Repository(overrides[name], name)
    for catalog in (local, *others):
        found = Repository(catalog, name)
        if found.images.exists():
            return found
    raise NotFound(f"no repository {name}")
