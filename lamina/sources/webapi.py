"""Tables behind HTTP: open-data portals, search indexes, document stores and plain files, read in parallel by Spark.

``web_table`` is a Spark data source. Planning asks the service how much there is and cuts it into parts: pages for a
portal, slices for an index. Each part is read by its own task, page by page, in Arrow batches; a page that fails is asked
for again. Qualifiers and columns travel in the request; what a service can't express is left to Spark.
"""

from __future__ import annotations

import gzip
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from lamina.quals import Quals, predicate, to_cnf
from lamina.runtime import scratch_path
from lamina.sources.remote import soql_query, soql_where
from lamina.types import Schema, schema_of

PAGE, PARTS, ATTEMPTS = 10_000, 16, 3


def ask(url: str, body: dict | None = None, headers: dict | None = None, attempts: int = ATTEMPTS):
    """JSON of a request, which is tried again with a pause."""
    data = None if body is None else json.dumps(body).encode()
    for i in range(attempts):
        try:
            request = urllib.request.Request(url, data, {"Accept-Encoding": "gzip", "Content-Type": "application/json", **(headers or {})})
            with urllib.request.urlopen(request, timeout=60) as answer:
                raw = answer.read()
                return json.loads(gzip.decompress(raw) if answer.headers.get("Content-Encoding") == "gzip" else raw)
        except OSError:
            if i + 1 == attempts:
                raise
            time.sleep(0.2 * 2**i)


def search_filter(quals: Quals | None, query_column: str | None = None) -> dict:
    """Condition of a search index: clauses that it can express, all of which must hold."""
    must: list[dict] = []
    for clause in to_cnf(quals):
        found = [search_term(*q, query_column) for q in clause]
        if found and all(f is not None for f in found):
            must.append(found[0] if len(found) == 1 else {"bool": {"should": found, "minimum_should_match": 1}})
    return {"bool": {"filter": must}} if must else {"match_all": {}}


def search_term(name: str, op: str, value, query_column: str | None = None) -> dict | None:
    if name == query_column:
        return {"query_string": {"query": value}} if op == "=" else None
    if op in ("is null", "is not null") or (value is None and op in ("=", "<>")):
        exists = {"exists": {"field": name}}
        return exists if op in ("is not null", "<>") else {"bool": {"must_not": exists}}
    if op == "=":
        return {"term": {name: value}}
    if op == "<>":
        return {"bool": {"must": {"exists": {"field": name}}, "must_not": {"term": {name: value}}}}
    if op in (">", ">=", "<", "<="):
        return {"range": {name: {{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op]: value}}}
    if op in ("~~", "like"):
        return {"wildcard": {name: str(value).replace("*", "\\*").replace("?", "\\?").replace("%", "*").replace("_", "?")}}
    return None


def search_aggregates(group: Sequence[str], aggregates: dict[str, tuple[str, str]], page: int = 1000) -> dict:
    """Body of a grouped request: composite buckets by page, with a metric for each aggregate. count(*) is the bucket's own."""
    metrics = {alias: {{"min": "min", "max": "max", "sum": "sum", "avg": "avg", "count": "value_count"}[f]: {"field": c}} for alias, (f, c) in aggregates.items() if c != "*"}
    sources = [{c: {"terms": {"field": c, "missing_bucket": True}}} for c in group]
    return {"size": 0, "aggs": {"groups": {"composite": {"size": page, "sources": sources}, "aggs": metrics}}}


def document_filter(quals: Quals | None) -> dict:
    """Filter of a document store."""
    ops = {"=": "$eq", "<>": "$ne", ">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte"}
    clauses = []
    for clause in to_cnf(quals):
        found = []
        for name, op, value in clause:
            if op == "is null":
                found.append({name: {"$eq": None}})
            elif op == "is not null":
                found.append({name: {"$ne": None}})
            elif op in ops:
                # values that are missing don't differ from a value in SQL
                found.append({name: {ops[op]: value} | ({"$ne": value, "$exists": True, "$not": {"$eq": None}} if op == "<>" else {})})
        if len(found) == len(clause):
            clauses.append(found[0] if len(found) == 1 else {"$or": found})
    return {"$and": clauses} if clauses else {}


class Part(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


class WebReader(DataSourceReader):
    """Options: kind (portal, search, documents), url, columns' schema, page, parts, quals as JSON, and the kind's own."""

    def __init__(self, schema: T.StructType, options):
        self.schema, self.options = schema, dict(options)
        self.arrow = to_arrow_schema(schema)
        self.kind, self.url = self.options["kind"], self.options["url"].rstrip("/")
        self.page, self.parts = int(self.options.get("page", PAGE)), int(self.options.get("parts", PARTS))
        self.quals = json.loads(self.options.get("quals", "null"))
        self.headers = json.loads(self.options.get("headers", "{}"))
        self.names = json.loads(self.options.get("names", "{}"))

    def partitions(self):
        if self.kind != "portal":
            return [Part(i, self.parts) for i in range(self.parts)]
        where = soql_where(self.quals, self.names)
        found = ask(self.url + "?" + urllib.parse.urlencode({"$select": "count(*) AS n"} | ({"$where": where} if where else {})), headers=self.headers)
        total = int(found[0]["n"])
        most = self.options.get("limit")
        total = min(total, int(most)) if most else total
        each = max(self.page, -(-total // self.parts))
        return [Part(at, min(each, total - at)) for at in range(0, total, each)] or [Part(0, 0)]

    def read(self, part):
        for rows in getattr(self, "_" + self.kind)(part):
            if rows:
                yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        columns = []
        for f, kind in zip(self.schema.fields, self.arrow):
            source = self.names.get(f.name, f.name)
            values = [r.get(source) for r in rows]
            if pa.types.is_string(kind.type):
                values = [v if v is None or isinstance(v, str) else json.dumps(v) for v in values]
                columns.append(pa.array(values, pa.string()))
            else:  # services give numbers as text too
                texts = pa.array([None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in values], pa.string())
                columns.append(texts.cast(kind.type))
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow)

    def _portal(self, part):
        base = soql_query([f.name for f in self.schema.fields], self.quals, [], names=self.names)
        done = 0
        while done < part.count:
            n = min(self.page, part.count - done)
            rows = ask(self.url + "?" + urllib.parse.urlencode(base | {"$order": ":id", "$limit": n, "$offset": part.start + done}), headers=self.headers)
            yield rows
            if len(rows) < n:
                return
            done += n

    def _search(self, part):
        score = self.options.get("score_column")
        body = {"query": search_filter(self.quals, self.options.get("query_column")), "size": self.page, "_source": [f.name for f in self.schema.fields], "track_scores": bool(score)}
        if part.count > 1:
            body["slice"] = {"id": part.start, "max": part.count}
        keep = self.options.get("scroll", "5m")
        found = ask(f"{self.url}/_search?scroll={keep}", body, self.headers)
        root = self.url[: self.url.rindex("/")]
        while found["hits"]["hits"]:
            yield [h["_source"] | {"_id": h["_id"]} | ({score: h.get("_score")} if score else {}) for h in found["hits"]["hits"]]
            found = ask(f"{root}/_search/scroll", {"scroll": keep, "scroll_id": found["_scroll_id"]}, self.headers)

    def _documents(self, part):
        import pymongo  # the driver of the store, where it is installed

        collection = pymongo.MongoClient(self.url)[self.options["database"]][self.options["collection"]]
        # each part takes the documents whose place by id falls to it; bounds come from the store's own sampling of ids
        bounds = [b["_id"]["min"] for b in collection.aggregate([{"$match": document_filter(self.quals)}, {"$bucketAuto": {"groupBy": "$_id", "buckets": part.count}}])] if part.count > 1 else []
        if part.start and part.start >= len(bounds):
            return
        where = [document_filter(self.quals)] + ([{"_id": {"$gte": bounds[part.start]}}] if part.start else []) + ([{"_id": {"$lt": bounds[part.start + 1]}}] if part.start + 1 < len(bounds) else [])
        rows = []
        for d in collection.find({"$and": where}, {f.name: 1 for f in self.schema.fields}):
            rows.append(d | {"_id": str(d["_id"])})
            if len(rows) >= self.page:
                yield rows
                rows = []
        yield rows


class WebTable(DataSource):
    @classmethod
    def name(cls):
        return "web_table"

    def reader(self, schema):
        return WebReader(schema, self.options)


def read_web(spark: SparkSession, kind: str, url: str, schema: T.StructType | str, quals: Quals | None = None, columns: Sequence[str] | None = None, names: dict[str, str] | None = None, headers: dict | None = None, **options) -> DataFrame:
    """Rows of a table behind HTTP that meet the qualifiers. names: the service's names of columns."""
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wanted = T.StructType([struct[c] for c in columns]) if columns else struct
    needed = T.StructType([f for f in struct.fields if f in wanted.fields or any(f.name == q[0] for clause in to_cnf(quals) for q in clause)])
    spark.dataSource.register(WebTable)
    given = {"kind": kind, "url": url, "quals": json.dumps(to_cnf(quals), default=str), "names": json.dumps(names or {}), "headers": json.dumps(headers or {})}
    df = spark.read.format("web_table").schema(needed).options(**given, **{k: str(v) for k, v in options.items() if v is not None}).load()
    virtual = options.get("query_column")
    rest = [clause for clause in to_cnf(quals) if not any(q[0] == virtual for q in clause)]
    where = predicate(rest, schema_of(needed))  # again here: a service may know less than Spark
    df = df.where(where) if where is not None else df
    return df.select(*[F.col(f"`{f.name}`") for f in wanted.fields])


def search_groups(url: str, group: Sequence[str], aggregates: dict[str, tuple[str, str]], quals: Quals | None = None, headers: dict | None = None) -> list[dict]:
    """Groups and aggregates that the index computes itself, bucket page by bucket page."""
    body = search_aggregates(group, aggregates) | {"query": search_filter(quals)}
    out: list[dict] = []
    while True:
        found = ask(f"{url.rstrip('/')}/_search", body, headers)["aggregations"]["groups"]
        out += [b["key"] | {a: b["doc_count"] if c == "*" else b[a]["value"] for a, (_, c) in aggregates.items()} for b in found["buckets"]]
        if "after_key" not in found:
            return out
        body["aggs"]["groups"]["composite"]["after"] = found["after_key"]


def land(spark: SparkSession, urls: Sequence[str], attempts: int = ATTEMPTS) -> str:
    """Files behind HTTP, each fetched by its own task into the shared folder; the folder. One that stays away is an error."""
    folder = scratch_path(spark, "landed")

    def fetch(batches):
        from pyarrow import fs

        for b in batches:
            for n, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                files, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
                files.create_dir(root, recursive=True)
                for i in range(attempts):
                    try:
                        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept-Encoding": "gzip"}), timeout=60) as answer:
                            packed = answer.headers.get("Content-Encoding") == "gzip" or url.split("?")[0].endswith(".gz")
                            final = f"{root}/{n:06d}.csv" + (".gz" if packed else "")
                            with files.open_output_stream(final + ".tmp", compression=None) as sink:
                                while piece := answer.read(1 << 20):
                                    sink.write(piece)
                        files.move(final + ".tmp", final)
                        break
                    except OSError:
                        if i + 1 == attempts:
                            raise
                        time.sleep(0.2 * 2**i)
                yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    listed = spark.createDataFrame(list(enumerate(urls)), "n long, url string").repartition(max(1, len(urls)))
    listed.mapInArrow(fetch, "n long").count()
    return folder


def answer(table: DataFrame, schema: Schema, request: str) -> list[dict]:
    """Rows for a query string over a table: ``select``, ``order``, ``limit``, ``offset``, and ``column=op.value``."""
    ops = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "like": "~~"}
    given = urllib.parse.parse_qsl(request, keep_blank_values=True)
    quals: Quals = []
    known = {c.name for c in schema}
    select, order, limit, offset = None, [], None, 0
    for key, value in given:
        if key == "select":
            select = value.split(",")
        elif key == "order":
            order = [x.split(".") for x in value.split(",")]
        elif key == "limit":
            limit = int(value)
        elif key == "offset":
            offset = int(value)
        else:
            op, _, text = value.partition(".")
            if key not in known:
                raise ValueError(f"no column {key}")
            if op == "is":
                quals.append([(key, "is null" if text == "null" else "is not null", None)])
            elif op == "in":
                quals.append([(key, "in", text.strip("()").split(","))])
            elif op in ops:
                quals.append([(key, ops[op], text.replace("*", "%") if op == "like" else text)])
            else:
                raise ValueError(f"unknown operator {op}")
    unknown = [c for c in [*(select or []), *[x[0] for x in order]] if c not in known]
    if unknown:
        raise ValueError(f"no column {unknown[0]}")
    where = predicate(quals, schema)
    df = table.where(where) if where is not None else table
    if order:
        df = df.orderBy(*[F.col(f"`{x[0]}`").desc_nulls_first() if x[1:] == ["desc"] else F.col(f"`{x[0]}`").asc_nulls_last() for x in order])
    df = df.offset(offset) if offset else df
    df = df.limit(limit) if limit is not None else df
    return [json.loads(x) for x in (df.select(*[F.col(f"`{c}`") for c in select]) if select else df).toJSON().collect()]
