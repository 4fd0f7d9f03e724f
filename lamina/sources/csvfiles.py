"""CSV in and out: dialect and encoding found from a bounded head of a file, rows read by Spark's own reader."""

from __future__ import annotations

import csv
import os
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.runtime import local_path
from lamina.sources.inference import apply_schema, infer_schema, unique_names
from lamina.types import Schema

#: Bytes of a file from which its dialect is told.
HEAD = 1 << 16


def head(path: str, spark: SparkSession | None = None) -> tuple[bytes, str]:
    """First bytes of a file, or of the first file of a folder, and its path. Only these bytes are read."""
    if spark is None:
        file = local_path(path)
        if os.path.isdir(file):
            file = min(os.path.join(file, n) for n in os.listdir(file) if n[0] not in "._")
        with open(file, "rb") as f:
            return f.read(HEAD), file
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        names = [s.getPath() for s in fs.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "._"]
        if not names:
            return b"", path
        where = min(names, key=lambda p: p.getName())
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(HEAD)), where.toString()
    finally:
        stream.close()


def has_quoted_newlines(spark: SparkSession, path: str, quote: str, encoding: str) -> bool:
    """Whether any line of the files ends inside quotes: then records span lines, and files can't be split between tasks."""
    lines = spark.read.option("encoding", encoding).text(path)
    odd = (F.char_length("value") - F.char_length(F.replace("value", F.lit(quote), F.lit("")))) % 2 == 1
    return not lines.where(odd).isEmpty()


def sniff(path: str, spark: SparkSession | None = None) -> dict:
    """Encoding, delimiter, quote, header flag and line end of a file."""
    raw, file = head(path, spark)
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompressobj(31).decompress(raw, HEAD)
    encoding = "utf-8"
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        encoding = "utf-16"
    else:
        try:
            raw[: max(0, len(raw) - 4)].decode("utf-8")
        except UnicodeDecodeError:
            encoding = "iso-8859-1"
    text = raw.decode(encoding, "replace").lstrip("\ufeff")
    newline = "\r\n" if "\r\n" in text else "\r" if "\r" in text and "\n" not in text else "\n"
    body = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = [x for x in body.split("\n") if x.strip()]
    if len(raw) == HEAD and len(lines) > 1:
        lines = lines[:-1]
    best, delimiter = -1.0, ","
    for d in ",;\t|":
        widths = [len(r) for r in csv.reader(lines[:200], delimiter=d)]
        if widths and max(widths) > 1:
            common = max(set(widths), key=widths.count)
            score = widths.count(common) / len(widths) * (common > 1) + common * 1e-4
            if score > best:
                best, delimiter = score, d
    rows = list(csv.reader(lines[:200], delimiter=delimiter, skipinitialspace=True))
    number = lambda x: x.replace(".", "", 1).lstrip("+-").isdigit()
    header = bool(rows) and all(x.strip() and not number(x.strip()) for x in rows[0]) and (len(rows) == 1 or any(number(x.strip()) for r in rows[1:] for x in r) or not any(set(rows[0]) & set(r) for r in rows[1:]))
    return {"encoding": encoding, "delimiter": delimiter, "quotechar": '"', "header": header, "newline": newline, "width": max((len(r) for r in rows), default=0), "names": rows[0] if header and rows else []}


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: Schema | None = None, infer: bool = True, **dialect) -> DataFrame:
    """A CSV file or folder, or one or several URLs, which are fetched into the shared folder first.

    Records may span lines; where none does, which a scan of the lines tells, files are split between tasks. The dialect,
    the header and the number of columns come from the first ``HEAD`` bytes: columns that only later rows have are cut
    unless a schema names them. Short rows are padded, long ones cut, blank lines skipped; quoted empties are null."""
    urls = [path] if isinstance(path, str) else list(path)
    if urls[0].startswith(("http://", "https://")):
        from lamina.sources.webapi import land

        path = land(spark, urls)
    found = sniff(path, spark) | {k: v for k, v in dialect.items() if v is not None}
    names = [c.name for c in schema] if schema else unique_names(found["names"] or [None] * found["width"])
    struct = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(struct).options(
        header=str(found["header"]).lower(), sep=found["delimiter"], quote=found["quotechar"], escape=found.get("escape", '"'), encoding=found["encoding"],
        mode="PERMISSIVE", ignoreLeadingWhiteSpace="true", enforceSchema="true", emptyValue="", nullValue="",
        multiLine=str(found["encoding"].startswith("utf-16") or has_quoted_newlines(spark, path, found["quotechar"], found["encoding"])).lower(),
    )
    df = reader.csv(path)
    df = df.select(*[F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")).alias(n) for n in names])
    if schema:
        return apply_schema(df, schema)
    return apply_schema(df, infer_schema(df)) if infer else df


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", encoding: str = "utf-8") -> None:
    df.write.mode("overwrite").options(header=str(header).lower(), sep=delimiter, encoding=encoding, quote='"', escape='"').csv(path)
