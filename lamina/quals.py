"""Qualifiers in conjunctive normal form: a list (AND) of lists (OR) of (column, operator, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from lamina.types import Schema, spark_type

Qual = tuple[str, str, object]
Quals = list[list[Qual]]

_COMPARE = {
    "=": lambda c, v: c == v, "<>": lambda c, v: c != v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
}


def literal(value, kind) -> SparkColumn:
    return F.lit(value).cast(kind)


def condition(qual: Qual, schema: Schema) -> SparkColumn:
    name, op, value = qual
    column = next((c for c in schema if c.name == name), None)
    if column is None:
        raise ValueError(f"no column {name}")
    c, kind, op = F.col(f"`{name}`"), spark_type(column.type), " ".join(op.lower().split())
    if op in ("is null", "is not null"):
        return c.isNull() if op == "is null" else c.isNotNull()
    if op in ("like", "~~"):
        return c.like(value)
    if op in ("not like", "!~~"):
        return ~c.like(value)
    if op in ("in", "not in") or op.endswith((" any", " all")):
        base = {"in": "=", "not in": "<>"}.get(op, op.split()[0])
        parts = [_COMPARE[base](c, literal(v, kind)) for v in value]
        if op in ("in",) or op.endswith(" any"):
            return reduce(lambda a, b: a | b, parts, F.lit(False))
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if op not in _COMPARE:
        raise ValueError(f"unknown operator {op}")
    # a float against an integer column must not be truncated first
    return _COMPARE[op](c, F.lit(value) if isinstance(value, float) else literal(value, kind))


def predicate(quals: Quals | None, schema: Schema) -> SparkColumn | None:
    clauses = [reduce(lambda a, b: a | b, [condition(q, schema) for q in clause]) for clause in quals or [] if clause]
    return reduce(lambda a, b: a & b, clauses) if clauses else None


def to_cnf(quals: Quals | None) -> Quals:
    """Membership spelt out for pruning: ``= ANY`` is one OR clause, ``op ALL`` many clauses.

    A clause that compares with null, or with a list that holds one, is dropped: it prunes nothing, and the exact
    predicate is applied to the rows anyway.
    """
    out: Quals = []
    for clause in quals or []:
        grown: list[Qual] = []
        extra: Quals = []
        usable = True
        for name, op, value in clause:
            op = " ".join(op.lower().split())
            member = {"in": "= any", "not in": "<> all"}.get(op, op)
            if member.endswith((" any", " all")):
                if value is None or any(v is None for v in value):
                    usable = False
                elif member.endswith(" any"):
                    grown += [(name, member[:-4], v) for v in value]
                elif len(clause) == 1:
                    extra += [[(name, member[:-4], v)] for v in value]
                else:
                    usable = False
            elif value is None and op not in ("is null", "is not null"):
                usable = False
            else:
                grown.append((name, op, value))
        if usable:
            out += ([grown] if grown else []) + extra
    return out
