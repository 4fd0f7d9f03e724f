"""Builds: a small declarative language that derives images from SQL over other images.

Commands, one a line (a backslash joins lines, ``${X}`` is a parameter, ``#`` begins a comment)::

    FROM ns/repo[:tag] [AS output]          base image of the build
    FROM EMPTY AS output
    FROM ns/repo[:tag] IMPORT t [AS a], {SELECT ...} AS b | ALL
    FROM MOUNT handler 'json' IMPORT t [AS a], ...
    SQL statement | SQL {statements} | SQL FILE path
    NAME arguments                          a registered command

Each command is a layer; its hash is that of the layer below and of what the command reads, so equal inputs give equal
images and a layer that exists is checked out instead of run.
"""

from __future__ import annotations

import hashlib
import json
import re
import secrets
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina import changes as ch
from lamina import sqlguard
from lamina.catalog import HEAD, ROOT, Catalog, Image, layer_hash
from lamina.repo import Repository, WorkingCopy, run_sql
from lamina.scan import TableScan
from lamina.types import Column, Schema, struct_of

#: Handlers of FROM MOUNT: parameters to a dict of DataFrames by table. Commands: see ``Command``.
MOUNTS: dict[str, Callable[..., dict[str, DataFrame]]] = {}
COMMANDS: dict[str, Command] = {}


class BuildError(ValueError):
    """A build file that can't be read or run."""


class Command:
    """A command of one's own. Without a hash its layer is never reused."""

    def calc_hash(self, repo: Repository, args: list[str]) -> str | None:
        return None

    def execute(self, repo: Repository, work: WorkingCopy, args: list[str]) -> None:
        raise NotImplementedError


@dataclass
class Step:
    kind: str
    source: str | None = None
    tag: str = "latest"
    output: str | None = None
    tables: list[tuple[str, str, bool]] = field(default_factory=list)  # source or query, alias, is it a query
    everything: bool = False
    sql: str | None = None
    args: list[str] = field(default_factory=list)
    params: dict | None = None


def preprocess(text: str, params: dict[str, str] | None = None) -> str:
    missing = sorted({m[1] for m in re.finditer(r"(?<!\\)\$\{(\w+)\}", text)} - set(params or {}))
    if missing:
        raise BuildError(f"no value for parameters: {', '.join(missing)}")
    text = re.sub(r"(?<!\\)\$\{(\w+)\}", lambda m: str(params[m[1]]), text)
    return re.sub(r"\\[ \t]*\n", " ", text.replace("\\$", "$"))


def _lines(text: str) -> list[str]:
    """Commands, whose braces may span lines."""
    out, held, depth = [], "", 0
    for line in text.split("\n"):
        if not depth and (not line.strip() or line.lstrip().startswith("#")):
            continue
        held += ("\n" if held else "") + line
        depth = len(re.findall(r"(?<!\\)\{", held)) - len(re.findall(r"(?<!\\)\}", held))
        if depth <= 0:
            out.append(held.strip())
            held, depth = "", 0
    if held.strip():
        raise BuildError(f"unclosed brace in {held.strip()[:60]!r}")
    return out


def _repo_tag(text: str) -> tuple[str, str]:
    m = re.fullmatch(r"([-A-Za-z0-9_]+(?:/[-A-Za-z0-9_]+)?)(?::([-A-Za-z0-9_.]+))?", text)
    if not m:
        raise BuildError(f"bad image name {text!r}")
    return m[1], m[2] or "latest"


def _unescape(text: str) -> str:
    return re.sub(r"\\([{}\\])", r"\1", text)


def _import_list(text: str) -> tuple[list[tuple[str, str, bool]], bool]:
    if text.strip().upper() == "ALL":
        return [], True
    out, at = [], 0
    item = re.compile(r"\s*(?:\{((?:\\.|[^{}\\])*)\}|([^\s,{}]+))(?:\s+AS\s+([^\s,]+))?\s*(,|$)", re.I | re.S)
    while at < len(text.rstrip()):
        m = item.match(text, at)
        if not m:
            raise BuildError(f"can't read the import list at {text[at : at + 40]!r}")
        query, name, alias = (_unescape(m[1]).strip() if m[1] is not None else None), m[2], m[3]
        if query is not None and not alias:
            raise BuildError("an imported query needs a name: {...} AS name")
        strip = lambda x: x.strip('"`') if x else x
        out.append((query, strip(alias), True) if query is not None else (strip(name), strip(alias) or strip(name), False))
        at = m.end()
    return out, False


def parse(text: str, params: dict[str, str] | None = None) -> list[Step]:
    steps = []
    for line in _lines(preprocess(text, params)):
        if m := re.fullmatch(r"FROM\s+MOUNT\s+(\S+)\s+'((?:[^']|'')*)'\s+IMPORT\s+(.*)", line, re.S | re.I):
            tables, everything = _import_list(m[3])
            steps.append(Step("MOUNT", m[1], tables=tables, everything=everything, params=json.loads(m[2].replace("''", "'"))))
        elif m := re.fullmatch(r"FROM\s+(\S+)\s+IMPORT\s+(.*)", line, re.S | re.I):
            tables, everything = _import_list(m[2])
            steps.append(Step("IMPORT", *_repo_tag(m[1]), tables=tables, everything=everything))
        elif m := re.fullmatch(r"FROM\s+EMPTY\s+AS\s+(\S+)", line, re.I):
            steps.append(Step("EMPTY", output=m[1]))
        elif m := re.fullmatch(r"FROM\s+(\S+?)(?:\s+AS\s+(\S+))?", line, re.I):
            steps.append(Step("FROM", *_repo_tag(m[1]), output=m[2]))
        elif m := re.fullmatch(r"SQL\s+FILE\s+(\S+)", line, re.I):
            with open(m[1]) as f:
                steps.append(Step("SQL", sql=f.read()))
        elif m := re.fullmatch(r"SQL\s*\{(.*)\}", line, re.S | re.I):
            steps.append(Step("SQL", sql=_unescape(m[1]).strip()))
        elif m := re.fullmatch(r"SQL\s+(.+)", line, re.S | re.I):
            steps.append(Step("SQL", sql=m[1].strip()))
        elif m := re.fullmatch(r"(?!(?:FROM|SQL)\b)([A-Z][A-Z0-9_]*)(?:\s+(.*))?", line, re.S):
            steps.append(Step("CUSTOM", m[1], args=(m[2] or "").split()))
        else:
            raise BuildError(f"can't read {line[:80]!r}")
    return steps


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Builder:
    """Runs build files against one catalog."""

    def __init__(self, catalog: Catalog, output: str | None = None):
        self.catalog, self.cached, self.ran = catalog, 0, 0
        self.repo: Repository | None = Repository(catalog, output) if output else None

    def run(self, text: str, params: dict[str, str] | None = None) -> Image:
        for step in parse(text, params):
            if step.kind in ("FROM", "EMPTY"):
                self._base(step)
                continue
            if self.repo is None:
                raise BuildError("the build has no output repository")
            if not self.repo.images.exists():
                self.repo.init()
            if self.repo.work is None:
                self.repo.checkout(self.repo.head.hash if self.repo.head else "latest", force=True)
            getattr(self, f"_{step.kind.lower()}")(step)
        return self.repo.head

    def _base(self, step: Step) -> None:
        if step.output:
            self.repo = Repository(self.catalog, step.output)
        if self.repo is None:
            raise BuildError("FROM needs AS output, or the builder an output")
        source = Repository(self.catalog, step.source) if step.source else None
        found = source.images[step.tag] if source else None
        if self.repo.images.exists() and not (source and source.name == self.repo.name):
            self.repo.delete()
        if not self.repo.images.exists():
            self.repo.init()
        if found is not None:
            line = {"type": "FROM", "source": source.name, "source_hash": found.hash}
            if not self.repo.images.has(found.hash):
                self.repo.images.add(ROOT, found.hash, found.tables, found.comment, [line])
            self.repo.checkout(found.hash, force=True)

    def _layer(self, hash: str | None, provenance: dict, comment: str, work: Callable[[], None]) -> None:
        """Check out the layer if it exists, or else make it; a layer that fails leaves no image."""
        head = self.repo.head
        if hash and self.repo.images.has(hash):
            self.repo.checkout(hash, force=True)
            self.cached += 1
            return
        self.repo.checkout(head.hash, force=True)
        try:
            work()
            self.repo.commit(hash, comment, provenance=[*head.provenance, provenance])
            self.ran += 1
        except Exception:
            if self.repo.work:
                self.repo.work.discard()
            raise

    def _import(self, step: Step) -> None:
        spark, source = self.catalog.spark, Repository(self.catalog, step.source)
        found, head = source.images[step.tag], self.repo.head
        tables = [(t, t, False) for t in sorted(found.tables)] if step.everything else step.tables
        named = [(sqlguard.check_import(spark, q) if is_query else q, a, is_query) for q, a, is_query in tables]
        hash = layer_hash(head.hash, found.hash, *[_sha(sqlguard.canonical(q) if is_query else q) + _sha(a) for q, a, is_query in named])
        line = {"type": "IMPORT", "source": source.name, "source_hash": found.hash, "tables": [q for q, _, _ in named], "table_aliases": [a for _, a, _ in named], "table_queries": [x for *_, x in named]}
        if self.repo.images.has(hash):
            self.repo.checkout(hash, force=True)
            self.cached += 1
            return
        self.repo.import_tables([a for _, a, _ in named], source, [q for q, _, _ in named], found.hash, [x for *_, x in named], image_hash=hash, provenance=[*head.provenance, line])
        self.ran += 1

    def _mount(self, step: Step) -> None:
        if step.source not in MOUNTS:
            raise BuildError(f"no mount handler {step.source}")
        tables = MOUNTS[step.source](self.catalog.spark, **(step.params or {}))
        wanted = [(t, t, False) for t in tables] if step.everything else step.tables

        def work():
            for q, alias, is_query in wanted:
                df = run_sql(self.catalog.spark, sqlguard.check_import(self.catalog.spark, q), {n: (lambda d=d: d) for n, d in tables.items()}) if is_query else tables[q]
                self.repo.work.create(alias, df)

        line = {"type": "MOUNT", "handler": step.source, "params": step.params, "tables": [q for q, _, _ in wanted]}
        self._layer(secrets.token_hex(32), line, f"Importing from {step.source}", work)  # what is mounted may change

    def _sql(self, step: Step) -> None:
        spark = self.catalog.spark
        plain, found = sqlguard.image_references(step.sql)
        statements = sqlguard.check_script(spark, plain)
        images = {key: Repository(self.catalog, key[0]).images[key[1]] for key in found}
        canonical = sqlguard.pinned(step.sql, {k: i.hash for k, i in images.items()})
        extra = {name: TableScan(self.catalog, images[key].tables[key[2]]).read for key, name in found.items()}
        sources = sorted({(k[0], i.hash) for k, i in images.items()})
        line = {"type": "SQL", "sql": canonical, "sources": [{"source": s, "source_hash": h} for s, h in sources]}
        self._layer(layer_hash(self.repo.head.hash, _sha(canonical)), line, canonical, lambda: [run_statement(self.repo.work, s, extra) for s in statements])

    def _custom(self, step: Step) -> None:
        if step.source not in COMMANDS:
            raise BuildError(f"unknown command {step.source}")
        command = COMMANDS[step.source]
        own = command.calc_hash(self.repo, step.args)
        hash = layer_hash(self.repo.head.hash, own) if own else secrets.token_hex(32)
        line = {"type": "CUSTOM", "command": step.source, "args": step.args}
        self._layer(hash, line, " ".join([step.source, *step.args]), lambda: command.execute(self.repo, self.repo.work, step.args))


# statements on a working copy


def run_script(work: WorkingCopy, script: str) -> None:
    for s in sqlguard.check_script(work.spark, script):
        run_statement(work, s)


def run_statement(work: WorkingCopy, sql: str, extra: dict | None = None) -> None:
    """One permitted statement on the staged tables; ``extra`` are more tables to read."""
    spark = work.spark
    read = lambda q: run_sql(spark, q, {n: (lambda n=n: work.table(n)) for n in work.tables} | (extra or {}))
    kind = sqlguard.statement_kind(sql)
    name = r"([\"`]?[\w]+[\"`]?)"
    clean = lambda x: x.strip('"`')
    if kind == "select":
        read(sql)
    elif m := re.fullmatch(rf"\s*INSERT\s+INTO\s+{name}\s*(\(([^()]*)\)\s*)?((?:SELECT|WITH|VALUES|\().*)", sql, re.S | re.I):
        table = clean(m[1])
        schema = work.tables[table].schema if table in work.tables else work._staged(table).schema
        columns = [clean(c.strip()) for c in m[3].split(",")] if m[3] else [c.name for c in schema]
        df = read(m[4])
        if len(df.columns) > len(columns):
            raise BuildError(f"INSERT has {len(df.columns)} values for {len(columns)} columns")
        given = df.toDF(*columns[: len(df.columns)])
        kinds = struct_of(schema)
        work.insert(table, given.select(*[(F.col(f"`{f.name}`") if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields]))
    elif m := re.fullmatch(rf"\s*UPDATE\s+{name}\s+SET\s+(.*)", sql, re.S | re.I):
        table = clean(m[1])
        sets, where = sqlguard.set_list(m[2])
        schema = work._staged(table).schema
        unknown = set(sets) - {c.name for c in schema}
        if unknown:
            raise BuildError(f"no such columns: {sorted(unknown)}")
        s = work.tables[table]
        if s.base is None or s.replaced:
            cols = [f"CASE WHEN ({where}) THEN ({sets[c.name]}) ELSE `{c.name}` END AS `{c.name}`" if c.name in sets else f"`{c.name}`" for c in schema]
            df = read(f"SELECT {', '.join(cols)} FROM {table}")
            work._replace(table, df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in struct_of(schema).fields]))
        else:
            df = read(f"SELECT {', '.join(f'`{c.name}`' for c in schema)}, {', '.join(f'({v}) AS `_new_{k}`' for k, v in sets.items())} FROM {table} WHERE {where}")
            work._append(table, ch.log_of(df, schema, ch.UPDATE, s.seq, {k: F.col(f"`_new_{k}`") for k in sets}))
    elif m := re.fullmatch(rf"\s*DELETE\s+FROM\s+{name}\s*(?:WHERE\s+(.*))?", sql, re.S | re.I):
        table, where = clean(m[1]), m[2] or "true"
        s = work._staged(table)
        if s.base is None or s.replaced:
            work._replace(table, read(f"SELECT * FROM {table} WHERE NOT coalesce(({where}), false)"))
        else:
            work._append(table, ch.log_of(read(f"SELECT * FROM {table} WHERE {where}"), s.schema, ch.DELETE, s.seq))
    elif m := re.fullmatch(rf"\s*CREATE\s+TABLE\s+{name}\s+AS\s+(.*)", sql, re.S | re.I):
        work.create(clean(m[1]), read(m[2]))
    elif m := re.fullmatch(rf"\s*CREATE\s+TABLE\s+{name}\s*\((.*)\)\s*", sql, re.S | re.I):
        schema = column_list(m[2])
        work.create(clean(m[1]), spark.createDataFrame([], struct_of(schema)), schema=schema)
    elif m := re.fullmatch(rf"\s*ALTER\s+TABLE\s+{name}\s+ADD\s+PRIMARY\s+KEY\s*\(([^()]*)\)\s*", sql, re.S | re.I):
        work.alter(clean(m[1]), pk=[clean(c.strip()) for c in m[2].split(",")])
    elif m := re.fullmatch(rf"\s*ALTER\s+TABLE\s+{name}\s+ADD\s+(?:COLUMN\s+)?{name}\s+(.*?)\s*", sql, re.S | re.I):
        work.alter(clean(m[1]), add={clean(m[2]): m[3].lower()})
    elif m := re.fullmatch(rf"\s*ALTER\s+TABLE\s+{name}\s+DROP\s+(?:COLUMN\s+)?{name}\s*", sql, re.S | re.I):
        work.alter(clean(m[1]), drop=[clean(m[2])])
    elif m := re.fullmatch(rf"\s*DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?{name}\s*", sql, re.S | re.I):
        work.drop(clean(m[1]))
    else:
        raise BuildError(f"can't run {sql[:80]!r}")


def column_list(text: str) -> Schema:
    """Columns of a CREATE TABLE: name, type, PRIMARY KEY by column or as a clause."""
    items, depth, held = [], 0, ""
    for c in text + ",":
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            items.append(held.strip())
            held = ""
        else:
            held += c
    keys: list[str] = []
    columns = []
    for item in items:
        if m := re.fullmatch(r"PRIMARY\s+KEY\s*\(([^()]*)\)", item, re.I):
            keys += [k.strip().strip('"`') for k in m[1].split(",")]
            continue
        m = re.fullmatch(r"([\"`]?\w+[\"`]?)\s+(.*?)((?:\s+(?:PRIMARY\s+KEY|NOT\s+NULL|UNIQUE))*)", item, re.S | re.I)
        if not m:
            raise BuildError(f"can't read column {item!r}")
        columns.append((m[1].strip('"`'), re.sub(r"\s+", " ", m[2].strip().lower()), bool(re.search(r"PRIMARY\s+KEY", m[3], re.I))))
    return [Column(i, n, t, is_pk or n in keys) for i, (n, t, is_pk) in enumerate(columns, 1)]


# provenance


def dependencies(image: Image) -> list[tuple[str, str]]:
    """(repository, hash) of every image that this one was built from, each once."""
    out = []
    for line in image.provenance:
        if line["type"] in ("FROM", "IMPORT"):
            out.append((line["source"], line["source_hash"]))
        elif line["type"] == "SQL":
            out += [(s["source"], s["source_hash"]) for s in line["sources"]]
    return list(dict.fromkeys(out))


def provenance_df(catalog: Catalog) -> DataFrame:
    """(repository, image, source, source_hash) of all images: who was built from what."""
    rows = [(r, i.hash, s, h) for r in catalog.repositories() for i in catalog.images(r) for s, h in dependencies(i)]
    return catalog.spark.createDataFrame(rows, "repository string, image string, source string, source_hash string").distinct()


def dependents(catalog: Catalog, name: str, hash: str) -> DataFrame:
    return provenance_df(catalog).where((F.col("source") == name) & (F.col("source_hash") == hash)).select("repository", "image").distinct()


def to_build_file(image: Image, replace: dict[str, str] | None = None, ignore_irreproducible: bool = False) -> str:
    """Commands that make the image again; ``replace`` gives other tags for source repositories."""
    tag = lambda name, h: f"{name}:{(replace or {}).get(name, h)}"
    brace = lambda q: "{" + re.sub(r"([{}\\])", r"\\\1", q) + "}"
    lines = []
    for p in image.provenance:
        if p["type"] == "FROM":
            lines.append(f"FROM {tag(p['source'], p['source_hash'])}")
        elif p["type"] == "IMPORT":
            items = [f"{brace(q) if is_query else q} AS {a}" for q, a, is_query in zip(p["tables"], p["table_aliases"], p["table_queries"])]
            lines.append(f"FROM {tag(p['source'], p['source_hash'])} IMPORT {', '.join(items)}")
        elif p["type"] == "SQL":
            sql = p["sql"]
            for s in p["sources"]:
                sql = sql.replace(f'"{s["source"]}:{s["source_hash"]}"', f'"{tag(s["source"], s["source_hash"])}"')
            lines.append(f"SQL {brace(sql)}")
        elif not ignore_irreproducible:
            raise BuildError(f"a {p['type']} command can't be repeated")
    return "\n".join(lines)


def rebuild(repo: Repository, image: str, replace: dict[str, str] | None = None, ignore_irreproducible: bool = False) -> Image:
    """Run the image's commands again, with other versions of its sources where asked."""
    text = to_build_file(repo.images[image], replace, ignore_irreproducible)
    builder = Builder(repo.catalog)
    builder.repo = repo
    if not text.startswith("FROM ") or " IMPORT " in text.split("\n", 1)[0]:
        repo.checkout(ROOT, force=True)
    made = builder.run(text)
    repo.images.tag(made.hash, HEAD)
    return made
