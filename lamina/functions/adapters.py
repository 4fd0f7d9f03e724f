"""PostgreSQL functions and habits where Spark's own differ."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring_from(s: Column, start: int, length: int | None = None) -> Column:
    """``substring(s from start for length)``: places before the string count, so a start below 1 shortens the result."""
    if length is None:
        return F.substring(s, max(1, start), 2**31 - 1)
    if length < 0:
        raise ValueError("negative substring length")
    return F.substring(s, max(1, start), max(0, length - max(0, 1 - start)))


def substring_regex(s: Column, pattern: str) -> Column:
    """``substring(s from 'regex')``: the first group if there is one, else the match; null without one."""
    group = 1 if re.compile(pattern).groups else 0
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def regexp_replace_first(s: Column, pattern: str, replacement: str, every: bool = False) -> Column:
    r"""``regexp_replace(s, p, r[, 'g'])``: backreferences as \1; the first match only, but with ``every``."""
    java = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
    if every:
        return F.regexp_replace(s, pattern, java)
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 1}", java)
    return F.regexp_replace(s, rf"\A((?s:.*?))(?:{pattern})((?s:.*))\z", f"$1{shifted}${re.compile(pattern).groups + 2}")


_CHAR = [("YYYY", "yyyy"), ("YY", "yy"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("Month", "MMMM"), ("Mon", "MMM"), ("Day", "EEEE"), ("Dy", "E"), ("AM", "a"), ("Q", "Q")]


def to_char(date: Column, pattern: str) -> Column:
    """``to_char(date, 'YYYY-MM')`` for the usual fields."""
    out, i = "", 0
    while i < len(pattern):
        hit = next(((a, b) for a, b in _CHAR if pattern.startswith(a, i)), None)
        if hit:
            out += hit[1]
            i += len(hit[0])
        else:
            out += f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]
            i += 1
    return F.date_format(date, out)


def div(a: Column, b: Column) -> Column:
    """Integer division, truncated."""
    return F.call_function("div", a, b)


def order(name: str, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """Sort key with nulls where PostgreSQL has them: last ascending, first descending."""
    first = descending if nulls_first is None else nulls_first
    c = F.col(f"`{name}`")
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last())


def distinct_on(df, keys: list[str], by: list[Column]):
    """``DISTINCT ON (keys) ... ORDER BY keys, by``: the first row of each group."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


# JSON and arrays


def json_text(j: Column, *path: str | int) -> Column:
    """``j #>> path``: text at a path, null where there is none."""
    return F.get_json_object(j, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def json_has_key(j: Column, key: str) -> Column:
    """``j ? 'key'`` for objects."""
    return F.coalesce(F.array_contains(F.json_object_keys(j), key), F.when(j.isNotNull(), F.lit(False)))


def json_contains(j: Column, part: dict[str, object]) -> Column:
    """``j @> part`` for flat objects of plain values."""
    tests = [json_text(j, k).isNull() & json_has_key(j, k) if v is None else json_text(j, k) == F.lit(str(v).lower() if isinstance(v, bool) else str(v)) for k, v in part.items()]
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return F.when(j.isNotNull(), out)


def json_each(df, column: str, keep: list[str]):
    """``jsonb_each_text``: a row (key, value) for each field of an object."""
    return df.select(*keep, F.explode(F.from_json(F.col(column), "map<string,string>")).alias("key", "value"))


def json_elements(df, column: str, keep: list[str]):
    """``jsonb_array_elements``: a row for each element, as JSON text."""
    return df.select(*keep, F.posexplode(F.from_json(F.col(column), "array<string>")).alias("place", "element"))


def json_object_agg(key: Column, value: Column) -> Column:
    """``json_object_agg``: an object in order of keys."""
    return F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v"))))))


def contained(a: Column, b: Column) -> Column:
    """``a <@ b`` of arrays."""
    return F.size(F.array_except(a, b)) == 0


def byte_at(b: Column, place: int) -> Column:
    """``get_byte(b, place)``, counted from 0."""
    return F.conv(F.hex(F.substring(b, place + 1, 1)), 16, 10).cast("int")


def encode_hex(b: Column) -> Column:
    """``encode(b, 'hex')``."""
    return F.lower(F.hex(b))
