"""Data source plugins: one interface to introspect, preview, mount, load and sync whatever holds tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lamina import build
from lamina.repo import Repository
from lamina.sources import csvfiles, loading, messages, remote, webapi
from lamina.types import Schema

SOURCES: dict[str, type[Source]] = {}


class SourceError(ValueError):
    """Parameters that a source doesn't take or lacks."""


class Source:
    """Subclasses name themselves, list the parameters that they need and may have, and give their tables lazily."""

    name = ""
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, **params: Any):
        lacking = [p for p in self.required if p not in params]
        unknown = sorted(set(params) - {*self.required, *self.optional})
        if lacking or unknown:
            raise SourceError(f"{self.name}: lacks {lacking}, doesn't take {unknown}")
        self.spark, self.params = spark, params

    def __init_subclass__(cls):
        if cls.name:
            SOURCES[cls.name] = cls
            build.MOUNTS[cls.name] = lambda spark, **params: {t: make() for t, make in cls(spark, **params).tables().items()}

    def tables(self) -> dict[str, Callable[[], DataFrame]]:
        raise NotImplementedError

    def introspect(self) -> dict[str, Schema | str]:
        return loading.introspect(self.tables())

    def preview(self, limit: int = 10) -> dict[str, list[dict] | str]:
        return loading.preview(self.tables(), limit)

    def mount(self) -> dict[str, str]:
        """Temporary views of the tables, read when they are queried."""
        return {t: (make().createOrReplaceTempView(t), t)[1] for t, make in self.tables().items()}

    def load(self, repo: Repository, tables: Sequence[str] | None = None, keys: dict[str, Sequence[str]] | None = None) -> str:
        """Tables as a new image, replacing those of the same name."""
        found = self.tables()
        if not repo.images.exists():
            repo.init()
        work = repo.work or repo.checkout("latest", force=True)
        for t in tables or found:
            if t in work.tables:
                work.drop(t)
            work.create(t, found[t](), (keys or {}).get(t, ()))
        return repo.commit(comment=f"Load from {self.name}").hash

    def sync(self, repo: Repository, cursors: dict[str, Sequence[str]], keys: dict[str, Sequence[str]] | None = None) -> str:
        """What is new by cursor, appended."""
        return loading.sync(repo, {t: make() for t, make in self.tables().items()}, cursors, keys)


class CsvSource(Source):
    name, required, optional = "csv", ("paths",), ("header", "delimiter", "encoding")

    def tables(self):
        dialect = {k: v for k, v in self.params.items() if k != "paths"}
        return {t: (lambda p=p: csvfiles.read_csv(self.spark, p, **dialect)) for t, p in self.params["paths"].items()}


class FilesSource(Source):
    """Files of any format that Spark reads: parquet, orc, json, text, avro where its package is there."""

    name, required, optional = "files", ("paths", "format"), ("options",)

    def tables(self):
        read = lambda p: self.spark.read.format(self.params["format"]).options(**self.params.get("options", {})).load(p)
        return {t: (lambda p=p: read(p)) for t, p in self.params["paths"].items()}


class SqliteSource(Source):
    name, required, optional = "sqlite", ("path",), ("page",)

    def tables(self):
        return {t: (lambda t=t: loading.read_sqlite(self.spark, self.params["path"], t, self.params.get("page", 50_000))) for t in loading.sqlite_schema(self.params["path"])}


class JdbcSource(Source):
    """PostgreSQL, MySQL, Snowflake, Athena and others: tables by name, or queries by a name of one's own."""

    name, required, optional = "jdbc", ("kind", "host", "database"), ("tables", "queries", "port", "user", "password", "private_key", "batch_size", "partition")

    def tables(self):
        common = {k: v for k, v in self.params.items() if k not in ("tables", "queries")}
        named = {t: {"table": t} for t in self.params.get("tables", [])} | {n: {"query": q} for n, q in self.params.get("queries", {}).items()}
        return {n: (lambda x=x: remote.read_jdbc(self.spark, **common, **x)) for n, x in named.items()}


class FramesSource(Source):
    name, required = "frames", ("frames",)

    def tables(self):
        return {t: (lambda d=d: d if isinstance(d, DataFrame) else self.spark.createDataFrame(d)) for t, d in self.params["frames"].items()}


class PortalSource(Source):
    """Tables of an open-data portal: endpoints and schemas by name."""

    name, required, optional = "socrata", ("endpoints", "schemas"), ("names", "headers", "page", "parts", "limit")

    def tables(self):
        rest = {k: v for k, v in self.params.items() if k not in ("endpoints", "schemas")}
        return {t: (lambda t=t, u=u: webapi.read_web(self.spark, "portal", u, self.params["schemas"][t], **rest)) for t, u in self.params["endpoints"].items()}


class SearchSource(Source):
    """Indexes of a search cluster, read by sliced scrolls: one table for each."""

    name, required, optional = "elasticsearch", ("url", "schemas"), ("headers", "page", "parts", "scroll", "query_column", "score_column")

    def tables(self):
        rest = {k: v for k, v in self.params.items() if k not in ("url", "schemas")}
        root = self.params["url"].rstrip("/")
        return {t: (lambda t=t, s=s: webapi.read_web(self.spark, "search", f"{root}/{t}", s, **rest)) for t, s in self.params["schemas"].items()}


class DocumentSource(Source):
    """Collections of a document store; each table has the column ``_id``. Needs the store's driver on the executors."""

    name, required, optional = "mongodb", ("url", "database", "schemas"), ("page", "parts")

    def tables(self):
        rest = {k: v for k, v in self.params.items() if k not in ("url", "schemas")}
        whole = {t: s if "_id " in s else "_id string, " + s for t, s in self.params["schemas"].items()}
        return {t: (lambda t=t: webapi.read_web(self.spark, "documents", self.params["url"], whole[t], collection=t, **rest)) for t in whole}


class WarehouseSource(Source):
    """Tables and queries of a warehouse by Spark's connector for it, which has to be on the class path."""

    name, required, optional = "bigquery", ("project", "dataset"), ("tables", "queries", "credentials")

    def tables(self):
        named = {t: {"table": t} for t in self.params.get("tables", [])} | {n: {"query": q} for n, q in self.params.get("queries", {}).items()}
        return {n: (lambda x=x: self.spark.read.format("bigquery").options(**self.options_of(**x)).load()) for n, x in named.items()}

    def options_of(self, table: str | None = None, query: str | None = None) -> dict[str, str]:
        out = {"parentProject": self.params["project"], "viewsEnabled": "true"}
        out |= {"table": f"{self.params['project']}.{self.params['dataset']}.{table}"} if table else {"query": query, "materializationDataset": self.params["dataset"]}
        return out | ({"credentials": self.params["credentials"]} if "credentials" in self.params else {})


class StreamsSource(Source):
    """Raw JSON tables of a sync tool (hash, JSON, time of emission): normalised by schema and mode."""

    name, required, optional = "streams", ("raw", "streams"), ()

    def tables(self):
        return {t: (lambda t=t: messages.normalised(self.params["raw"][t], self.params["streams"][t])) for t in self.params["streams"]}
