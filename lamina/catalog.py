"""Repositories, images, tags and objects: immutable manifests in a store, and DataFrames over them."""

from __future__ import annotations

import hashlib
import json
import re
import secrets
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.store import NotFound, Store
from lamina.types import Schema, from_json, to_json

ROOT = "0" * 64
HEAD, LATEST = "HEAD", "latest"
COMMENT_MAX = 4096
#: Manifests that the driver reads one by one, before a job is worth it.
FETCH_AT_ONCE = 64
FACTS = "id string, size long, created string, insertion_hash string, deletion_hash string, rows_inserted long, rows_deleted long, path string, at string"


class AmbiguousHash(ValueError):
    """A hash prefix that several images share."""


@dataclass
class TableVersion:
    """A table at an image: its schema and its objects, later ones over earlier ones."""

    schema: Schema
    objects: list[str]

    def to_json(self) -> dict:
        return {"schema": to_json(self.schema), "objects": self.objects}

    @classmethod
    def of(cls, x: dict) -> TableVersion:
        return cls(from_json(x["schema"]), list(x["objects"]))


@dataclass
class Image:
    hash: str
    parent: str | None
    created: str
    comment: str | None = None
    provenance: list[dict] = field(default_factory=list)
    tables: dict[str, TableVersion] = field(default_factory=dict)

    def to_json(self) -> dict:
        return {**self.__dict__, "tables": {k: v.to_json() for k, v in self.tables.items()}}

    @classmethod
    def of(cls, x: dict) -> Image:
        return cls(**{**x, "tables": {k: TableVersion.of(v) for k, v in x["tables"].items()}})


@dataclass
class ObjectMeta:
    """Facts about an object that planning needs; index: ranges and blooms by column; path: its folder below the root."""

    id: str
    size: int
    created: str
    insertion_hash: str
    deletion_hash: str
    rows_inserted: int
    rows_deleted: int
    index: dict
    path: str = ""

    def to_json(self) -> dict:
        return dict(self.__dict__)


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def parse_name(name: str) -> tuple[str, str]:
    """(namespace, repository) of ``namespace/repository`` or a bare name."""
    parts = name.split("/")
    if not 1 <= len(parts) <= 2 or any(not re.fullmatch(r"[-A-Za-z0-9_]{1,64}", p) for p in parts):
        raise ValueError(f"bad repository name {name!r}")
    return (parts[0], parts[1]) if len(parts) == 2 else ("-", parts[0])


class Catalog:
    """All repositories below one root.

    Facts of objects are kept in manifests, one file for all objects of a commit, one object a line. Manifests are
    immutable but for the removal of objects, and later ones (by ``at``) hold over earlier ones.
    """

    def __init__(self, spark: SparkSession, root: str, user: str | None = None):
        self.spark, self.store, self.user = spark, Store(spark, root), user
        self.cache = None  # of external objects, see lamina.external
        self._objects: dict[str, ObjectMeta] = {}
        self._at: dict[str, str] = {}
        self._read: set[str] = set()

    # objects

    def register_object(self, meta: ObjectMeta) -> None:
        self.register_objects([meta])

    def register_objects(self, metas: list[ObjectMeta]) -> None:
        """Facts of many objects in one file."""
        if not metas:
            return
        name, at = f"{secrets.token_hex(16)}.jsonl", now()
        self.store.write_lines([{**m.to_json(), "at": at} for m in metas], "meta", name)
        self._read.add(name)
        for m in metas:
            self._objects[m.id], self._at[m.id] = m, at

    def refresh(self) -> None:
        """Read manifests that others have written since."""
        new = [n for n in self.store.names("meta") if n not in self._read]
        if len(new) > FETCH_AT_ONCE:
            lines = [json.loads(r["value"]) for r in self.spark.read.text([self.store.at("meta", n) for n in new]).collect()]
        else:
            lines = [x for n in new for x in self.store.read_lines("meta", n)]
        for x in lines:
            at = x.pop("at")
            if at >= self._at.get(x["id"], ""):
                self._objects[x["id"]], self._at[x["id"]] = ObjectMeta(**x), at
        self._read.update(new)

    def object(self, id: str) -> ObjectMeta:
        return self.objects([id])[0]

    def objects(self, ids: Iterable[str]) -> list[ObjectMeta]:
        """Facts of objects in the order asked for."""
        ids = list(ids)
        if any(i not in self._objects for i in ids):
            self.refresh()
        missing = [i for i in ids if i not in self._objects]
        if missing:
            raise NotFound(f"no objects {missing[:3]}")
        return [self._objects[i] for i in ids]

    def has_object(self, id: str) -> bool:
        return not self.new_objects([id])

    def object_ids(self) -> list[str]:
        self.refresh()
        return sorted(self._objects)

    def object_path(self, id: str) -> str:
        return self.location(self.object(id))

    def location(self, meta: ObjectMeta) -> str:
        """Where an object's files are: in the cache, elsewhere, or below the root."""
        held = self.cache.location(meta) if self.cache else None
        return held or self.store.whole(meta.path)

    def new_objects(self, ids: Iterable[str]) -> list[str]:
        ids = list(dict.fromkeys(ids))
        if any(i not in self._objects for i in ids):
            self.refresh()
        return [i for i in ids if i not in self._objects]

    def drop_objects(self, ids: Iterable[str]) -> None:
        """Remove objects' files, and them from the manifests that name them."""
        gone = set(ids)
        for m in [self._objects[i] for i in gone if i in self._objects]:
            self.store.delete_path(self.store._path(self.location(m)))
        for n in self.store.names("meta"):
            lines = self.store.read_lines("meta", n)
            left = [x for x in lines if x["id"] not in gone]
            if not left:
                self.store.delete("meta", n)
            elif len(left) < len(lines):
                self.store.write_lines(left, "meta", n)
        for i in gone:
            self._objects.pop(i, None)
            self._at.pop(i, None)

    def objects_df(self) -> DataFrame:
        """Facts of every registered object, read by the cluster rather than the driver."""
        if not self.store.names("meta"):
            return self.spark.createDataFrame([], FACTS).drop("at")
        found = self.spark.read.schema(FACTS).json(self.store.at("meta", "*.jsonl"))
        rest = [c for c in found.columns if c != "id"]
        last = found.groupBy("id").agg(F.max_by(F.struct(*rest), "at").alias("m"))
        return last.select("id", "m.*").drop("at")

    # privileges

    def grant(self, namespace: str, user: str | None) -> None:
        """Make a user the owner of a namespace; None opens it."""
        self.check_privilege(namespace)
        if user is None:
            self.store.delete("owners", f"{namespace}.json")
        else:
            self.store.write({"owner": user}, "owners", f"{namespace}.json")

    def check_privilege(self, namespace: str) -> None:
        """Anyone may read; a namespace with an owner is written by that owner alone."""
        if self.store.exists("owners", f"{namespace}.json"):
            owner = self.store.read("owners", f"{namespace}.json")["owner"]
            if owner != self.user:
                raise PermissionError(f"namespace {namespace} belongs to {owner}")

    # repositories

    def repositories(self) -> list[str]:
        return [f"{ns}/{r}" if ns != "-" else r for ns in self.store.names("repos") for r in self.store.names("repos", ns)]

    def images(self, name: str) -> Images:
        return Images(self, *parse_name(name))

    def tables_df(self) -> DataFrame:
        """(repository, image, table, object_ids) of every table version; one row per table, so it is metadata in size."""
        rows = [(r, i.hash, t, v.objects) for r in self.repositories() for i in self.images(r) for t, v in i.tables.items()]
        return self.spark.createDataFrame(rows, "repository string, image string, tbl string, object_ids array<string>")

    def images_df(self) -> DataFrame:
        rows = [(r, i.hash, i.parent, i.created, i.comment) for r in self.repositories() for i in self.images(r)]
        return self.spark.createDataFrame(rows, "repository string, image string, parent string, created string, comment string")

    def unused_objects(self) -> DataFrame:
        used = self.tables_df().select(F.explode("object_ids").alias("id")).distinct()
        return self.objects_df().select("id", "created").join(used, "id", "left_anti")

    def cleanup(self, older_than: str | None = None) -> list[str]:
        """Delete objects that no table refers to; their number is bounded by metadata."""
        gone = self.unused_objects()
        if older_than:
            gone = gone.where(F.col("created") < older_than)
        ids = sorted(r["id"] for r in gone.collect())
        self.drop_objects(ids)
        return ids


class Images:
    """Images and tags of one repository."""

    def __init__(self, catalog: Catalog, namespace: str, repository: str):
        self.catalog, self.namespace, self.repository = catalog, namespace, repository
        self.at = ("repos", namespace, repository)

    @property
    def name(self) -> str:
        return self.repository if self.namespace == "-" else f"{self.namespace}/{self.repository}"

    @property
    def store(self) -> Store:
        return self.catalog.store

    def exists(self) -> bool:
        return self.store.exists(*self.at)

    def hashes(self) -> list[str]:
        return [n[:-5] for n in self.store.names(*self.at, "images")]

    def __iter__(self):
        found = [self.get(h) for h in self.hashes()]
        return iter(sorted(found, key=lambda i: (i.created, i.hash)))

    def get(self, hash: str) -> Image:
        return Image.of(self.store.read(*self.at, "images", f"{hash}.json"))

    def has(self, hash: str) -> bool:
        return self.store.exists(*self.at, "images", f"{hash}.json")

    def by_hash(self, prefix: str) -> Image:
        hits = [h for h in self.hashes() if h.startswith(prefix.lower())]
        if not hits:
            raise NotFound(f"no image starts with {prefix}")
        if len(hits) > 1:
            raise AmbiguousHash(f"several images start with {prefix}: {', '.join(h[:12] for h in hits)}")
        return self.get(hits[0])

    def tags(self) -> dict[str, str]:
        return {n: self.store.read(*self.at, "tags", n)["image"] for n in self.store.names(*self.at, "tags")}

    def by_tag(self, tag: str) -> Image | None:
        if tag == LATEST:
            found = [i for i in self if i.hash != ROOT] or list(self)
            return max(found, key=lambda i: (i.created, i.hash), default=None)
        if not self.store.exists(*self.at, "tags", tag):
            return None
        return self.get(self.store.read(*self.at, "tags", tag)["image"])

    def __getitem__(self, key: str) -> Image:
        found = self.by_tag(key)
        if found:
            return found
        if key == HEAD:
            raise NotFound(f"{self.name} has no checked-out image")
        return self.by_hash(key)

    def tag(self, hash: str, tag: str) -> None:
        self.catalog.check_privilege(self.namespace)
        if tag == LATEST:
            raise ValueError(f"{LATEST} is computed and can't be set")
        self.store.write({"image": self.get(hash).hash}, *self.at, "tags", tag)

    def untag(self, tag: str) -> None:
        self.catalog.check_privilege(self.namespace)
        if not self.store.delete(*self.at, "tags", tag):
            raise NotFound(f"no tag {tag}")

    def add(self, parent: str | None, hash: str | None = None, tables: dict | None = None, comment: str | None = None, provenance: list[dict] | None = None, created: str | None = None) -> Image:
        self.catalog.check_privilege(self.namespace)
        hash = hash or secrets.token_hex(32)
        if hash == parent:
            raise ValueError("an image can't be its own parent")
        missing = self.catalog.new_objects(o for t in (tables or {}).values() for o in t.objects)
        if missing:
            raise NotFound(f"objects that aren't registered: {missing[:3]}")
        image = Image(hash, parent, created or now(), comment[:COMMENT_MAX] if comment else comment, provenance or [], tables or {})
        if not self.store.write(image.to_json(), *self.at, "images", f"{hash}.json", overwrite=False):
            raise ValueError(f"image {hash[:12]} exists")
        return image

    def update(self, image: Image) -> None:
        self.catalog.check_privilege(self.namespace)
        self.store.write(image.to_json(), *self.at, "images", f"{image.hash}.json")

    def delete(self, hashes: Iterable[str]) -> None:
        self.catalog.check_privilege(self.namespace)
        gone = set(hashes)
        for t, h in self.tags().items():
            if h in gone:
                self.untag(t)
        for h in gone:
            self.store.delete(*self.at, "images", f"{h}.json")

    def parent_children(self, hash: str) -> tuple[str | None, list[str]]:
        return self.get(hash).parent, [i.hash for i in self if i.parent == hash]

    def log(self, hash: str) -> list[Image]:
        """The image and its ancestors; ends quietly where a parent is unknown."""
        out, at = [], hash
        while at and self.has(at):
            out.append(self.get(at))
            at = out[-1].parent
        return out

    def descendants(self, hash: str) -> set[str]:
        below: dict[str | None, list[str]] = {}
        for i in self:
            below.setdefault(i.parent, []).append(i.hash)
        out, open_ = set(), [hash]
        while open_:
            h = open_.pop()
            out.add(h)
            open_ += [c for c in below.get(h, []) if c not in out]
        return out

    def ancestors(self, hashes: Iterable[str]) -> set[str]:
        return {i.hash for h in hashes for i in self.log(h)}

    def prune(self) -> list[str]:
        """Delete images that no tag reaches."""
        keep = self.ancestors(h for t, h in self.tags().items())
        gone = sorted(set(self.hashes()) - keep)
        self.delete(gone)
        return gone

    def upstream(self) -> str | None:
        return self.store.read(*self.at, "upstream.json")["remote"] if self.store.exists(*self.at, "upstream.json") else None

    def set_upstream(self, remote: str | None) -> None:
        if remote is None:
            self.store.delete(*self.at, "upstream.json")
        else:
            self.store.write({"remote": remote}, *self.at, "upstream.json")

    def tree(self) -> str:
        """Images as an indented tree, with tags."""
        named: dict[str, list[str]] = {}
        for t, h in self.tags().items():
            named.setdefault(h, []).append(t)
        images = list(self)
        known = {i.hash for i in images}
        below: dict[str | None, list[Image]] = {}
        for i in images:
            below.setdefault(i.parent if i.parent in known else None, []).append(i)
        lines: list[str] = []

        def walk(parent: str | None, indent: str) -> None:
            rows = below.get(parent, [])
            for n, i in enumerate(rows):
                last = n == len(rows) - 1
                mark = "" if parent is None else "└─" if last else "├─"
                label = f" [{', '.join(sorted(named[i.hash]))}]" if i.hash in named else ""
                lines.append(f"{indent}{mark}{i.hash[:10]}{label} {i.comment or ''}".rstrip())
                walk(i.hash, indent + ("" if parent is None else "  " if last else "│ "))

        walk(None, "")
        return "\n".join(lines)


def layer_hash(*parts: str) -> str:
    """Hash of a layer from those of what it was made from."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()
