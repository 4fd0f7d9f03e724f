"""Table schemas: ordered typed columns, their identity, and their Spark types."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, replace
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import types as T


class SchemaError(ValueError):
    """A schema that can't be used for what was asked."""


@dataclass(frozen=True)
class Column:
    ordinal: int
    name: str
    type: str
    is_pk: bool = False
    comment: str | None = None


Schema = list[Column]

_SPARK = {
    "smallint": T.ShortType(), "smallserial": T.ShortType(), "integer": T.IntegerType(), "int": T.IntegerType(), "serial": T.IntegerType(),
    "bigint": T.LongType(), "bigserial": T.LongType(), "real": T.FloatType(), "double precision": T.DoubleType(), "money": T.DecimalType(19, 2),
    "text": T.StringType(), "character varying": T.StringType(), "varchar": T.StringType(), "character": T.StringType(), "char": T.StringType(),
    "bit": T.StringType(), "bit varying": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    "timestamp without time zone": T.TimestampNTZType(), "timestamp with time zone": T.TimestampType(), "time": T.StringType(),
    "time without time zone": T.StringType(), "time with time zone": T.StringType(), "boolean": T.BooleanType(), "json": T.StringType(),
    "jsonb": T.StringType(), "tsvector": T.StringType(), "bytea": T.BinaryType(), "inet": T.StringType(), "cidr": T.StringType(),
}
#: Types whose values order the same in Spark as in the engine whose names we use; others get no index and no key.
INDEXABLE = {
    "smallint", "smallserial", "integer", "int", "serial", "bigint", "bigserial", "real", "double precision", "numeric", "money", "text",
    "character varying", "varchar", "character", "char", "bit", "date", "timestamp", "timestamp without time zone", "timestamp with time zone",
    "time", "time without time zone", "time with time zone",
}


def base_type(name: str) -> str:
    return re.sub(r"\s*\(.*?\)", "", name).strip().lower()


def is_indexable(column: Column) -> bool:
    return base_type(column.type) in INDEXABLE and not column.type.endswith("[]")


def spark_type(name: str) -> T.DataType:
    if name.endswith("[]"):
        return T.ArrayType(spark_type(name[:-2]))
    base = base_type(name)
    if base in ("numeric", "decimal"):
        args = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", name)
        return T.DecimalType(int(args[1]), int(args[2] or 0)) if args else T.DecimalType(38, 18)
    if base not in _SPARK:
        raise SchemaError(f"unknown type {name}")
    return _SPARK[base]


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return type_name(kind.elementType) + "[]"
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    simple = {
        "smallint": "smallint", "tinyint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision",
        "date": "date", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp with time zone", "boolean": "boolean", "binary": "bytea",
    }
    return simple.get(kind.simpleString(), "json" if isinstance(kind, (T.StructType, T.MapType)) else "character varying")


def schema_of(struct: T.StructType, pk: list[str] | tuple[str, ...] = ()) -> Schema:
    unknown = set(pk) - set(struct.fieldNames())
    if unknown:
        raise SchemaError(f"no such key columns: {sorted(unknown)}")
    return [Column(i, f.name, type_name(f.dataType), f.name in pk) for i, f in enumerate(struct.fields, 1)]


def struct_of(schema: Schema) -> T.StructType:
    return T.StructType([T.StructField(c.name, spark_type(c.type)) for c in schema])


def schema_hash(schema: Schema) -> str:
    """Identity of a schema; comments are no part of it."""
    return hashlib.sha256(str([(c.ordinal, c.name, c.type, c.is_pk) for c in schema]).encode("ascii", "backslashreplace")).hexdigest()


def compatible(a: Schema, b: Schema) -> bool:
    return [replace(c, comment=None) for c in a] == [replace(c, comment=None) for c in b]


def key_columns(schema: Schema) -> Schema:
    """Change key: the primary key, or else every column whose type is indexable."""
    return [c for c in schema if c.is_pk] or [c for c in schema if is_indexable(c)]


def to_json(schema: Schema) -> list[dict]:
    return [asdict(c) for c in schema]


def from_json(rows: list[dict]) -> Schema:
    return [Column(**r) for r in rows]


def plain(value):
    """A value as JSON can hold it."""
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, (date, datetime)):
        return value.isoformat(" ") if isinstance(value, datetime) else value.isoformat()
    if isinstance(value, (tuple, list)):
        return [plain(v) for v in value]
    return value


def typed(value, name: str):
    """What ``plain`` made, or a literal of a qualifier, as a comparable value of the type."""
    if value is None:
        return None
    kind = spark_type(name)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    if isinstance(kind, T.IntegralType):
        return value if isinstance(value, (int, float, Decimal)) else Decimal(str(value))
    if isinstance(kind, T.FractionalType):
        return float(value)
    if isinstance(kind, T.DateType):
        return value.date() if isinstance(value, datetime) else value if isinstance(value, date) else date.fromisoformat(str(value)[:10])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, str):
            value = datetime.fromisoformat(value)
        elif isinstance(value, date) and not isinstance(value, datetime):
            value = datetime(value.year, value.month, value.day)
        return value.replace(tzinfo=None) if value.tzinfo else value
    if isinstance(kind, T.StringType):
        return str(value).encode("utf-8", "surrogatepass")  # bytewise order
    return value


def dumps(value) -> str:
    return json.dumps(value, sort_keys=True, default=plain)
