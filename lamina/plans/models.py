"""Projects of SQL models: files that refer to each other and to sources, run in order into a repository."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from lamina.repo import Repository, run_sql

_REF = re.compile(r"\{\{\s*ref\(\s*['\"](\w+)['\"]\s*\)\s*\}\}")
_SOURCE = re.compile(r"\{\{\s*source\(\s*['\"](\w+)['\"]\s*,\s*['\"](\w+)['\"]\s*\)\s*\}\}")
_CONFIG = re.compile(r"\{\{\s*config\(.*?\)\s*\}\}", re.S)


class ModelError(ValueError):
    """Models that can't be ordered or read."""


def load_models(folder: str) -> dict[str, str]:
    """Model name to SQL of every .sql file below a folder."""
    out: dict[str, str] = {}
    for root, _, files in sorted(os.walk(folder)):
        for f in sorted(files):
            if f.endswith(".sql"):
                if f[:-4] in out:
                    raise ModelError(f"two models are named {f[:-4]}")
                with open(os.path.join(root, f)) as file:
                    out[f[:-4]] = file.read()
    return out


def ordered(models: dict[str, str]) -> list[str]:
    """Models after those that they refer to; names decide among equals."""
    needs = {n: set(_REF.findall(s)) for n, s in models.items()}
    for n, refs in needs.items():
        if refs - set(models):
            raise ModelError(f"{n} refers to unknown models {sorted(refs - set(models))}")
    out: list[str] = []
    while len(out) < len(models):
        ready = sorted(n for n in models if n not in out and needs[n] <= set(out))
        if not ready:
            raise ModelError(f"models refer to each other in a circle: {sorted(set(models) - set(out))}")
        out += ready
    return out


def wanted(models: dict[str, str], names: list[str]) -> list[str]:
    """The named models and all that they need, in order."""
    keep, open_ = set(), list(names)
    while open_:
        n = open_.pop()
        if n not in models:
            raise ModelError(f"no model {n}")
        if n not in keep:
            keep.add(n)
            open_ += _REF.findall(models[n])
    return [n for n in ordered(models) if n in keep]


def run_models(repo: Repository, models: dict[str, str], sources: dict[tuple[str, str], Callable[[], DataFrame]], only: list[str] | None = None, materialize: list[str] | None = None) -> str:
    """Run models as one new image: those in ``materialize`` (all by default) become tables, the others stay views."""
    if not repo.images.exists():
        repo.init()
    work = repo.work or repo.checkout("latest", force=True)
    made: dict[str, Callable[[], DataFrame]] = {}
    names = wanted(models, only) if only else ordered(models)
    for name in names:
        tables = dict(made)
        sql = _CONFIG.sub("", models[name])
        for s, t in set(_SOURCE.findall(sql)):
            if (s, t) not in sources:
                raise ModelError(f"{name} reads unknown source {s}.{t}")
            tables[f"src_{s}_{t}"] = sources[s, t]
        sql = _SOURCE.sub(r"src_\1_\2", _REF.sub(r"\1", sql))
        df = run_sql(repo.spark, sql, tables)
        if materialize is None or name in materialize:
            if name in work.tables:
                work.drop(name)
            work.create(name, df)
            made[name] = lambda name=name: work.table(name)
        else:
            made[name] = lambda df=df: df
    return repo.commit(comment=f"Models {', '.join(names)}"[:200]).hash
