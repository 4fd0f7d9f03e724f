"""Media columns: payloads in archives as a column of a table.

``archive_members`` is a Spark data source over folders of zip archives. Planning lists the files only and cuts each
archive into as many ranges as its size asks for. A task reads the end of its archive, which says where the directory
of members is, and then its share of the directory's bytes: the records that begin in it are its members, so each member
belongs to exactly one task, the directory is read once however many tasks share an archive, and archives of any size
spread over tasks. A task that begins inside a record goes to the next one, told by its mark, the records after it and the header of its member;
it ends where the next task begins by the same rule, so every byte of the directory is some task's, and what is no record is a row with ``error``.

Members are fetched by offset, and each is retried on its own: a short read, a bad header or a wrong checksum costs that
member a new attempt with a fresh handle, and after the last attempt a row with ``error`` and no payload, never the task.
Payloads leave in Arrow batches of bounded bytes; one payload is held whole, as a cell of a table has to be.

Defined results: an archive without a directory is one row with ``error`` and null member, and so is each range whose part
of the directory can't be read, each stretch of it that holds no record, and what follows its end, beside the members that
are found; a member whose own header bears another name has an ``error``; folder entries are skipped; empty members have
an empty payload; equal names are separate members; an empty folder gives no rows, a missing one fails; archives go by
their path below the folder. Members whose name isn't a row's keys are rows with ``error`` in ``media_table``. ``write_archives`` packs a table's payloads, one archive per partition: null payloads
become members flagged in their name, so null, empty and repeated rows and ids come back as they were; other columns play
no part.
"""

from __future__ import annotations

import json
import os
import struct
import time
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamina.runtime import scratch_path, table

RANGE, BATCH, ATTEMPTS = 32 << 20, 4 << 20, 3
#: Bytes of an archive for each task of the registered query, whose archives are small.
QUERY_RANGE = 1 << 20
SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


#: Marks of a member's record in the directory, and of the directory's end; records that prove a place in it.
RECORD, END, END64, LOCATOR, PROOF = b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", 4


class Member:
    """What the directory says of a member."""

    def __init__(self, filename: str, header_offset: int, compress_size: int, compress_type: int, crc: int, raw: bytes):
        self.filename, self.header_offset, self.compress_size, self.compress_type, self.CRC, self.raw = filename, header_offset, compress_size, compress_type, crc, raw

    def is_dir(self) -> bool:
        return self.filename.endswith("/")


class Lost:
    """A part of an archive that gives no members, and why."""

    def __init__(self, why: str):
        self.why = why


class NoArchive(ValueError):
    """The bytes of a file aren't those of an archive, whichever range is read."""


def read_at(f, start: int, n: int) -> bytes:
    f.seek(start)
    data = f.read(n)
    if len(data) < n:
        raise OSError(f"{len(data)} of {n} bytes at {start}")
    return data


def directory_of(f, size: int) -> tuple[int, int, int, int]:
    """(first byte, bytes, shift, rest) of an archive's directory; shift is what stands before the archive in its file,
    rest what stands after it."""
    tail = min(size, 22 + 65535 + 76)
    data = read_at(f, size - tail, tail)
    # the mark may stand in a comment, or in an archive that is the last member of one cut off: the right one ends the file
    marks, at = [], data.rfind(END)
    while at >= 0:
        if len(data) - at >= 22:
            marks.append((at, len(data) - at - 22 - int.from_bytes(data[at + 20 : at + 22], "little")))
        at = data.rfind(END, 0, at)
    if not marks:
        raise NoArchive("no end of directory")
    at, rest = next((m for m in marks if not m[1]), marks[0])
    (count,) = struct.unpack("<H", data[at + 10 : at + 12])
    length, start = struct.unpack("<II", data[at + 12 : at + 20])
    end = size - tail + at
    if (length == 0xFFFFFFFF or start == 0xFFFFFFFF) and at >= 20 and data[at - 20 : at - 16] == LOCATOR:
        (where,) = struct.unpack("<Q", data[at - 12 : at - 4])
        if where + 56 > size:
            raise NoArchive("no end of the large directory")
        big = read_at(f, where, 56)
        if big[:4] != END64:
            raise NoArchive("no end of the large directory")
        count, length, start = struct.unpack("<QQQ", big[32:56])
        end = where
    if length > end:
        raise NoArchive("the directory is larger than its archive")
    if length < 46 * count:
        raise NoArchive(f"no room for {count} members in a directory of {length} bytes")
    return end - length, length, end - length - start, rest


def record_size(data: bytes, at: int) -> int:
    """Bytes of the record there, 0 where there is none."""
    if data[at : at + 4] != RECORD or at + 46 > len(data):
        return 0
    return 46 + sum(struct.unpack("<HHH", data[at + 28 : at + 34]))


def member_at(data: bytes, at: int, shift: int) -> Member:
    flags, kind = struct.unpack("<HH", data[at + 8 : at + 12])
    crc, packed, plain = struct.unpack("<III", data[at + 16 : at + 28])
    name_n, extra_n = struct.unpack("<HH", data[at + 28 : at + 32])
    (offset,) = struct.unpack("<I", data[at + 42 : at + 46])
    raw = data[at + 46 : at + 46 + name_n]
    extra = data[at + 46 + name_n : at + 46 + name_n + extra_n]
    while len(extra) >= 4:
        id, n = struct.unpack("<HH", extra[:4])
        if id == 1:  # large values, those that don't fit above, in this order
            held = extra[4 : 4 + n]
            for value in ("plain", "packed", "offset"):
                now = {"plain": plain, "packed": packed, "offset": offset}[value]
                if now == 0xFFFFFFFF and len(held) >= 8:
                    (big,) = struct.unpack("<Q", held[:8])
                    held = held[8:]
                    plain, packed, offset = (big, packed, offset) if value == "plain" else (plain, big, offset) if value == "packed" else (plain, packed, big)
        extra = extra[4 + n :]
    return Member(raw.decode("utf-8" if flags & 0x800 else "cp437", "replace"), offset + shift, packed, -1 if flags & 1 else kind, crc, raw)


def first_record(f, data: bytes, end: int, shift: int, proof: int = PROOF) -> int:
    """Place of the first record that begins in the data, whose directory ends at ``end``: a mark that records, or the
    end, follow, and whose member's own header bears the same name. -1 without one."""
    at = data.find(RECORD)
    while at >= 0:
        place = at
        for _ in range(proof):
            n = record_size(data, place)
            place += n
            if not n or place >= end:
                break
        if n and place <= end:
            name = data[at + 46 : at + 46 + struct.unpack("<H", data[at + 28 : at + 30])[0]]
            f.seek(max(0, member_at(data, at, shift).header_offset))
            head = f.read(30 + len(name))
            if head[:4] == b"PK\x03\x04" and head[30:] == name:
                return at
        at = data.find(RECORD, at + 1)
    return -1


def begin(f, first: int, length: int, shift: int, lo: int, window: int = 1 << 20) -> int:
    """Where in the directory the task begins that begins at or after ``lo``, which the task before it finds as well."""
    while 0 < lo < length:
        data = read_at(f, first + lo, min(2 * window, length - lo))  # a record has at most 196,651 bytes
        at = first_record(f, data, length - lo, shift)
        if 0 <= at and (at < window or lo + len(data) == length):
            return lo + at
        lo += window  # beyond, records weren't seen whole
    return min(lo, length)


def members_of(f, size: int, share: int, shares: int):
    """Members whose records begin in a share of the directory's bytes, and what of it holds none."""
    first, length, shift, rest = directory_of(f, size)
    if rest and share == 0:
        yield Lost(f"{rest} bytes after the end of the directory" if rest > 0 else f"{-rest} bytes less than the end of the directory tells")
    lo, hi = length * share // shares, length * (share + 1) // shares
    if lo >= hi:
        return
    start = begin(f, first, length, shift, lo)
    end = length if share + 1 == shares else begin(f, first, length, shift, hi)
    data, at = read_at(f, first + start, end - start), 0
    while at < len(data):
        n = record_size(data, at)
        if n and at + n <= len(data):
            yield member_at(data, at, shift)
            at += n
            continue
        found = first_record(f, data[at + 1 :], len(data) - at - 1, shift, 1)
        after = at + 1 + found if found >= 0 else len(data)
        yield Lost(f"no record in bytes {start + at} to {start + after} of the directory")
        at = after


class Range(InputPartition):
    def __init__(self, path: str, size: int, share: int, shares: int):
        self.path, self.size, self.share, self.shares = path, size, share, shares


def fetch(open_file, info: Member, attempts: int, pause: float = 0.05) -> tuple[bytes | None, str | None]:
    """Payload of a member by its offset, or what went wrong at the last attempt."""
    why = None
    for i in range(attempts):
        try:
            with open_file() as f:
                f.seek(info.header_offset)
                head = f.read(30 + len(info.raw))
                if len(head) < 30 or head[:4] != b"PK\x03\x04":
                    raise ValueError("bad member header")
                name, extra = struct.unpack("<HH", head[26:30])
                if name != len(info.raw) or head[30:] != info.raw:
                    raise ValueError("another name in the member's header")
                f.seek(info.header_offset + 30 + name + extra)
                body = f.read(info.compress_size)
            if len(body) < info.compress_size:
                raise ValueError("short read")
            if info.compress_type == zipfile.ZIP_DEFLATED:
                body = zlib.decompress(body, -15)
            elif info.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"compression {info.compress_type}")
            if zlib.crc32(body) != info.CRC:
                raise ValueError("wrong checksum")
            return body, None
        except Exception as e:  # whatever it is, it concerns this member alone
            why = f"{type(e).__name__}: {e}"
            time.sleep(pause * i)
    return None, why


class MemberReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.range = int(options.get("rangeBytes", RANGE))
        self.batch = int(options.get("batchBytes", BATCH))
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.suffix = options.get("suffix", ".zip")

    def partitions(self):
        files, root = pafs.FileSystem.from_uri(self.root)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True))
        out = []
        for x in sorted((x for x in found if x.is_file and x.path.endswith(self.suffix)), key=lambda x: x.path):
            shares = max(1, -(-x.size // self.range))
            out += [Range(x.path, x.size, i, shares) for i in range(shares)]
        return out or [Range("", 0, 0, 1)]

    def read(self, partition):
        if not partition.path:
            return
        files, root = pafs.FileSystem.from_uri(self.root)
        open_file = lambda: files.open_input_file(partition.path)
        name = partition.path.removeprefix(root.rstrip("/") + "/")
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

        members, why = [], None
        for i in range(self.attempts):
            try:
                with open_file() as f:
                    members, why = list(members_of(f, partition.size, partition.share, partition.shares)), None
                break
            except NoArchive as e:  # all ranges see it, one tells
                why = f"ValueError: {e}" if partition.share == 0 else None
            except Exception as e:
                why = f"{type(e).__name__}: {e}"
            time.sleep(0.05 * i)
        if why:
            rows.append((name, None, None, None, None, why))
        for info in members:
            if isinstance(info, Lost):
                rows.append((name, None, None, None, None, info.why))
                continue
            if info.is_dir():
                continue
            body, error = fetch(open_file, info, self.attempts)
            rows.append((name, info.filename, info.header_offset, None if body is None else len(body), body, error))
            held += len(body or b"")
            if held >= self.batch or len(rows) >= 4096:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls):
        return "archive_members"

    def schema(self):
        return "archive string, member string, offset long, n_bytes long, payload binary, error string"

    def reader(self, schema):
        return MemberReader(self.options)


def read_members(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_archives(df: DataFrame, path: str, payload: str, names: list[str]) -> int:
    """One zip archive per partition below ``path``; members are named by a number and the JSON of ``names``' values."""
    top, folder = pafs.FileSystem.from_uri(path)
    top.create_dir(folder, recursive=True)  # there even when no task runs

    def run(batches):
        files, root = pafs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        context = TaskContext.get()
        final = f"{root}/part-{context.partitionId():06d}.zip"
        trial = f"{final}.{context.taskAttemptId()}.tmp"
        n = 0
        with files.open_output_stream(trial) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for b in batches:
                *keys, body = [c.to_pylist() for c in b.columns]
                for row in zip(*keys, body):
                    info = zipfile.ZipInfo(f"{n:09d} {json.dumps([row[-1] is None, *row[:-1]], ensure_ascii=False)}", (1980, 1, 1, 0, 0, 0))
                    info.compress_type = zipfile.ZIP_DEFLATED
                    z.writestr(info, row[-1] or b"")
                    n += 1
        files.move(trial, final)  # a second attempt replaces the same file with the same bytes
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return df.select(*names, F.col(payload).cast("binary").alias("_payload")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def media_table(spark: SparkSession, path: str, key_schema: str, **options) -> DataFrame:
    """Rows that ``write_archives`` packed: keys, payload and error."""
    members = read_members(spark, path, **options)
    held = F.from_json(F.substring(F.col("member"), 11, 2**31 - 1), "array<string>")
    keys = [x.strip().split(" ") for x in key_schema.split(",")]
    texts = [F.get(held, i + 1) for i in range(len(keys))]
    values = [x.try_cast(t) for x, (_, t) in zip(texts, keys)]
    good = F.coalesce((F.size(held) == len(keys) + 1) & F.get(held, 0).isin("true", "false"), F.lit(False))
    for x, v in zip(texts, values):
        good = good & (x.isNull() | v.isNotNull())
    why = F.when(F.col("member").isNotNull() & ~good, F.concat(F.lit("the name is no row: "), "member"))
    body = F.when(F.get(held, 0) == "true", None).otherwise(F.col("payload"))
    return members.select(*[v.alias(k) for v, (k, _) in zip(values, keys)], body.alias("payload"), F.coalesce("error", why).alias("error"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    path = path if "://" in path else "file://" + os.path.abspath(path)
    write_archives(table(spark, sf_dir, "pages"), path, "html", ["page_id", "url"])
    return media_table(spark, path, "page_id bigint, url string", rangeBytes=QUERY_RANGE).select("page_id", "url", F.col("payload").cast("string").alias("html"), F.octet_length("payload").cast("long").alias("n_bytes"), "error")


QUERIES = {"op5_media_columns": op5_media_columns}
ORACLES = {"op5_media_columns": "SELECT page_id, url, html, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, CAST(NULL AS VARCHAR) AS error FROM pages"}
