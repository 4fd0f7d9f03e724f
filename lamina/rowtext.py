"""Text of a row as a composite literal: ``(1,apple,,"a b")``. Rows are hashed, and keyless rows ordered, by it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.types import Schema, spark_type


def value_text(value: Column, kind: T.DataType) -> Column:
    """Text of one value before quoting; null stays null."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "t").when(~value, "f")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return value.cast("string")  # seconds, and what there is of fractions
    if isinstance(kind, T.DecimalType) and kind == T.DecimalType(38, 18):  # a bare numeric keeps no trailing zeros
        text = value.cast("string")
        return F.regexp_replace(text, r"\.?0+$", "") if kind.scale else text
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: F.coalesce(quoted(value_text(x, kind.elementType), array=True), F.lit("NULL")))
        return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))
    return value.cast("string")


def quoted(text: Column, array: bool = False) -> Column:
    special = r'[\s,"\\{}]' if array else r'[\s,"\\()]'
    inner = F.regexp_replace(text, r"([\\\"])", r"\\$1" if array else r"$1$1")
    return F.when((text == "") | text.rlike(special), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(text)


def row_text(schema: Schema, within: str | None = None) -> Column:
    """Composite text of the schema's columns; ``within`` names a struct that holds them."""
    parts = []
    for c in schema:
        col = F.col(f"`{within}`")[c.name] if within else F.col(f"`{c.name}`")
        kind = spark_type(c.type)
        text = value_text(col, kind)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            text = F.concat(F.lit('"'), text, F.lit('"'))  # the space in it asks for quotes, and nothing in it for more
        elif not isinstance(kind, (T.NumericType, T.BooleanType, T.DateType)):  # these hold nothing that is quoted
            text = quoted(text)
        parts.append(F.coalesce(text, F.lit("")))
    return F.concat(F.lit("("), F.concat_ws(",", *parts), F.lit(")"))
