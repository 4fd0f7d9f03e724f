"""Command line over a root: python -m lamina ROOT COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lamina.build import Builder, dependencies, dependents, rebuild, to_build_file
from lamina.catalog import Catalog
from lamina.external import make_external
from lamina.repo import Repository
from lamina.sources.base import SOURCES
from lamina.sources.csvfiles import read_csv, write_csv
from lamina.sources.webapi import answer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamina")
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **flags):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for k, v in flags.items():
            s.add_argument("--" + k.replace("_", "-"), **v)
        return s

    add("list")
    for name in ("init", "rm-repo", "prune"):
        add(name, "repo")
    add("log", "repo", tree={"action": "store_true"})
    add("show", "repo", "image")
    add("table", "repo", "image", "table")
    add("tag", "repo", "image", "tag", delete={"action": "store_true"})
    add("diff", "repo", "table", "left", "right", rows={"action": "store_true"}, limit={"type": int, "default": 0})
    add("sql", "repo", "query", image={"default": "latest"}, limit={"type": int, "default": 20})
    add("rm", "repo", "image")
    add("cleanup")
    add("build", "file", param={"action": "append", "default": []})
    add("provenance", "repo", "image")
    add("clone", "repo", "name")
    add("dump", "repo", "path")
    add("load", "repo", "path")
    add("checkout", "repo", "image")
    add("status", "repo")
    add("commit-sql", "repo", "script", comment={"default": None})
    add("import", "repo", "source", "image", "tables", names={"default": None})
    add("reindex", "repo", "image", "table", "indexes")
    for name in ("push", "pull"):
        add(name, "repo", "remote", remote_name={"default": None}, overwrite_tags={"action": "store_true"}, overwrite_objects={"action": "store_true"})
    add("upstream", "repo", set={"default": None}, reset={"action": "store_true"})
    add("rebuild", "repo", "image", source={"action": "append", "default": []})
    add("dependents", "repo", "image")
    add("objects")
    add("externalize", "repo", "image", "root")
    add("mount", "repo", "handler", "params", tables={"default": None})
    add("rest", "repo", "image", "table", "request")
    add("grant", "namespace", "user")
    add("csv-import", "repo", "table", "path", key={"action": "append", "default": []})
    add("csv-export", "repo", "table", "path", image={"default": "latest"})
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    catalog = Catalog(spark, args.root)
    repo = Repository(catalog, args.repo) if hasattr(args, "repo") else None
    c = args.command
    if c == "list":
        return "\n".join(catalog.repositories())
    if c == "init":
        return repo.init().hash
    if c == "rm-repo":
        repo.delete()
        return ""
    if c == "prune":
        return "\n".join(repo.images.prune())
    if c == "log":
        return repo.images.tree() if args.tree else "\n".join(f"{i.hash} {i.created} {i.comment or ''}".rstrip() for i in repo.images.log(repo.images["latest"].hash))
    if c == "show":
        i = repo.images[args.image]
        parent, children = repo.images.parent_children(i.hash)
        return "\n".join([f"Image {i.hash}", f"Parent: {parent}", f"Children: {', '.join(children)}", f"Size: {repo.image_size(i.hash)}", *[f"  {t}: {len(v.objects)} objects" for t, v in sorted(i.tables.items())]])
    if c == "table":
        t = repo.table(args.image, args.table)
        return "\n".join([f"Size: {t.size()}", f"Rows: {t.count()}", *[f"  {x.name} ({x.type}{', key' if x.is_pk else ''})" for x in t.schema], *[f"  {o}" for o in t.version.objects]])
    if c == "tag":
        repo.images.untag(args.tag) if args.delete else repo.images.tag(repo.images[args.image].hash, args.tag)
        return ""
    if c == "diff":
        found = repo.diff(args.table, args.left, args.right) if args.rows else repo.diff_counts(args.table, args.left, args.right)
        if isinstance(found, bool):
            return "added" if found else "removed"
        if args.rows:
            return "\n".join(("+ " if r["added"] else "- ") + json.dumps({k: v for k, v in r.asDict().items() if k != "added"}, default=str) for r in (found.limit(args.limit) if args.limit else found).toLocalIterator())
        return "added {}, removed {}, updated {}".format(*found)
    if c == "sql":
        rows = repo.sql(args.query, args.image).limit(args.limit + 1).toJSON().collect()
        return "\n".join(rows[: args.limit] + ([f"(more than {args.limit} rows, see --limit)"] if len(rows) > args.limit else []))
    if c == "rm":
        gone = repo.images.descendants(repo.images[args.image].hash)
        repo.images.delete(gone)
        return "\n".join(sorted(gone))
    if c == "cleanup":
        return "\n".join(catalog.cleanup())
    if c == "build":
        with open(args.file) as f:
            return Builder(catalog).run(f.read(), dict(p.split("=", 1) for p in args.param)).hash
    if c == "provenance":
        i = repo.images[args.image]
        return to_build_file(i, ignore_irreproducible=True) or "\n".join(":".join(d) for d in dependencies(i))
    if c == "clone":
        return repo.clone(args.name).name
    if c == "dump":
        return repo.dump(args.path)
    if c == "load":
        return "\n".join(repo.load_dump(args.path))
    if c == "checkout":
        return repo.checkout(args.image).image.hash
    if c == "status":
        head = repo.head
        return f"{head.hash} {head.comment or ''}".rstrip() if head else "nothing is checked out"
    if c == "commit-sql":
        repo.checkout(repo.head.hash if repo.head else "latest", force=True).sql(args.script)
        return repo.commit(comment=args.comment).hash
    if c == "import":
        tables = args.tables.split(",")
        return repo.import_tables(args.names.split(",") if args.names else tables, Repository(catalog, args.source), tables, args.image).hash
    if c == "reindex":
        return "\n".join(repo.reindex(args.image, args.table, json.loads(args.indexes)))
    if c in ("push", "pull"):
        other = Repository(Catalog(spark, args.remote), args.remote_name or args.repo)
        return "\n".join(getattr(repo, c)(other, overwrite_tags=args.overwrite_tags, overwrite_objects=args.overwrite_objects))
    if c == "upstream":
        if args.set or args.reset:
            repo.images.set_upstream(args.set)
        return repo.images.upstream() or ""
    if c == "rebuild":
        return rebuild(repo, args.image, dict(s.split("=", 1) for s in args.source)).hash
    if c == "dependents":
        return "\n".join(sorted(f"{r['repository']}:{r['image']}" for r in dependents(catalog, args.repo, repo.images[args.image].hash).collect()))
    if c == "objects":
        return "\n".join(catalog.object_ids())
    if c == "externalize":
        return "\n".join(make_external(catalog, {o for t in repo.images[args.image].tables.values() for o in t.objects}, root=args.root))
    if c == "mount":
        source = SOURCES[args.handler](spark, **json.loads(args.params))
        return source.load(repo, args.tables.split(",") if args.tables else None)
    if c == "rest":
        t = repo.table(args.image, args.table)
        return json.dumps(answer(t.read(), t.schema, args.request))
    if c == "grant":
        catalog.grant(args.namespace, args.user)
        return args.user
    if c == "csv-import":
        return repo.import_frame(args.table, read_csv(spark, args.path), args.key).hash
    write_csv(repo.table(args.image, args.table).read(), args.path)
    return args.path


if __name__ == "__main__":
    print(run(SparkSession.builder.appName("lamina").getOrCreate(), parser().parse_args()))

