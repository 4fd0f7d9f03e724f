"""Token counts of documents under a public byte-level BPE, without ids.

Texts are cut into pre-tokens by the vocabulary's own pattern, done here on arrays of code points. A map task (block)
keeps one dictionary of the distinct pre-tokens of its documents and, per document, the frequencies by dictionary
index. Dictionary entries meet by pre-token: there each distinct pre-token is encoded once and its number of pieces
goes back to the blocks that hold it, where it is joined to the frequencies and summed. What moves is dictionaries and
packed frequencies, not tokens, and nothing is broadcast.

Pre-tokens are told apart within a block by a 64-bit hash of their code points. Defined results: null and empty texts
count 0; one row per input row, whatever the ids (null and repeated ids too); the strings of special tokens are
ordinary text; other columns play no part. Very long pre-tokens are encoded whole.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.textnp import mix
from lamina.runtime import input_bytes, scratch_path, table

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose documents share a dictionary, and characters that numpy works on at a time.
BLOCK, SLICE = 48 << 20, 1 << 20
#: Bytes of blocks' files for each task that encodes pre-tokens.
PART_BYTES = 64 << 20
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def kinds() -> np.ndarray:
    """Class of each code point: 0 white space, 1 letter, 2 number, 3 other. Made once per process."""
    held = getattr(sys, "_lamina_kinds", None)
    if held is None:
        held = np.full(0x110000, 3, np.uint8)
        held[:] = [1 if c[0] == "L" else 2 if c[0] == "N" else 3 for c in map(unicodedata.category, map(chr, range(0x110000)))]
        held[WHITE] = 0
        sys._lamina_kinds = held
    return held


def encoder(path: str):
    """The tokenizer at ``path``; made once per process."""
    held = getattr(sys, "_lamina_encoders", None)
    if held is None:
        held = sys._lamina_encoders = {}
    if path not in held:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[path]


def pretokens(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of concatenated texts; docs: offsets of the texts that aren't empty, in order."""
    kind = kinds()[codes]
    n = len(codes)
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin[docs] = True
    first = np.zeros(n + 1, bool)
    first[docs] = True
    first[n] = True
    white = kind == 0
    # last of a run of white space before something else of the same text
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:-1])
    blank = codes[last] == 32
    run = ~begin[last]  # the run is longer than one
    begin[last[run]] = True
    begin[last[blank] + 1] = False
    # contractions: an apostrophe that opens a run of marks, not after a blank, before certain letters
    at = np.flatnonzero((codes[:-1] == 39) & (kind[1:] == 1) & ~first[1:-1])
    if len(at):
        opens = begin[at] & ~((codes[at - 1] == 32) & ~first[at])
        at = at[opens]
        one = np.isin(codes[at + 1], [115, 116, 109, 100])
        room = at + 2 < n
        ok = room.copy()
        ok[room] = ~first[at[room] + 2]
        two = np.zeros(len(at), bool)
        a, b = codes[at[ok] + 1], codes[at[ok] + 2]
        two[ok] = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        begin[at[one | two] + 1] = False
        for which, width in ((one, 2), (two & ~one, 3)):
            ends = at[which] + width
            ends = ends[ends < n]
            begin[ends[kind[ends] == 1]] = True
    return np.flatnonzero(begin)


def frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct (document, pre-token): document, hash, count, and start and end in the code points."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not len(codes):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, z, codes
    starts = pretokens(codes, bounds[:-1][sizes > 0])
    lengths = np.diff(starts, append=len(codes))
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    h = mix(np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * power[place], starts))
    doc = np.searchsorted(bounds, starts, side="right") - 1
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    new = np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))
    at = np.flatnonzero(new)
    counts = np.diff(at, append=len(d))
    pick = order[at]
    return d[at], k[at], counts, starts[pick], starts[pick] + lengths[pick], codes


class Block:
    """Dictionary and packed frequencies of the documents of a block."""

    def __init__(self):
        import zstandard

        self.hashes, self.words, self.rows = np.zeros(0, np.uint64), [], []
        self.pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        self.ids = np.zeros(0, np.int64)

    def add(self, doc_ids: list, texts: list[str]) -> None:
        doc, h, count, start, end, codes = frequencies(texts)
        fresh, first = np.unique(h, return_index=True)
        where = np.searchsorted(self.hashes, fresh)
        known = np.zeros(len(fresh), bool)
        inside = where < len(self.hashes)
        known[inside] = self.hashes[where[inside]] == fresh[inside]
        for s, e in zip(start[first[~known]], end[first[~known]]):
            self.words.append(codes[s:e].tobytes().decode("utf-32-le", "surrogatepass"))
        ids = np.arange(len(self.ids), len(self.ids) + (~known).sum())
        self.hashes = np.insert(self.hashes, where[~known], fresh[~known])
        self.ids = np.insert(self.ids, where[~known], ids)
        local = self.ids[np.searchsorted(self.hashes, h)]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i, d in enumerate(doc_ids):
            a, b = bounds[i], bounds[i + 1]
            order = np.argsort(local[a:b], kind="stable")
            index, times = local[a:b][order], count[a:b][order]
            most = times > 255
            pairs = np.stack([index[most], times[most]]).astype(np.int64).tobytes() if most.any() else b""
            gaps = np.diff(index, prepend=0)
            wide = gaps > 65534  # rare: such gaps go in full
            low = np.where(wide, 65535, gaps).astype(np.uint16)
            planes = (low & 255).astype(np.uint8).tobytes() + (low >> 8).astype(np.uint8).tobytes() + np.where(most, 0, times).astype(np.uint8).tobytes()
            head = np.array([b - a, wide.sum()], np.int64).tobytes()
            self.rows.append((d, self.pack(head + gaps[wide].astype(np.int64).tobytes() + pairs + planes)))


def unpack(raw: bytes, pieces: np.ndarray) -> int:
    """Sum of pieces x frequency of a packed document, already decompressed."""
    n, wide = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    if not n:
        return 0
    at = len(raw) - 3 * n
    planes = np.frombuffer(raw, np.uint8, 3 * n, at).astype(np.int64).reshape(3, n)
    gaps = planes[0] | (planes[1] << 8)
    gaps[gaps == 65535] = np.frombuffer(raw, np.int64, wide, 16)
    most = np.frombuffer(raw[16 + 8 * wide : at], np.int64)
    half = len(most) // 2
    return int(planes[2] @ pieces[np.cumsum(gaps)]) + int(pieces[most[:half]] @ most[half:])


BLOCKS = pa.schema([("block", pa.int64()), ("local", pa.int32()), ("word", pa.string()), ("doc_id", pa.int64()), ("row", pa.binary())])


def blocks(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """Dictionary entries (block, local, word) and packed documents (block, doc_id, row)."""

    def run(batches):
        part, seq, held, block = TaskContext.get().partitionId(), 0, 0, Block()

        def done():
            nonlocal block, seq, held
            key = (part << 24) | seq
            for at in range(0, len(block.words), 20_000):
                words = block.words[at : at + 20_000]
                n = len(words)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(range(at, at + n), pa.int32()), pa.array(words, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=BLOCKS)
            for at in range(0, len(block.rows), 1000):
                ids, rows = zip(*block.rows[at : at + 1000])
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], schema=BLOCKS)
            block, seq, held = Block(), seq + 1, 0

        for b in batches:
            ids, texts, size = [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                ids.append(d)
                texts.append(t)
                size += len(t)
                if size >= SLICE:
                    block.add(ids, texts)
                    held += size
                    ids, texts, size = [], [], 0
                    if held >= block_bytes:
                        yield from done()
            if ids:
                block.add(ids, texts)
                held += size
        yield from done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "block long, local int, word string, doc_id long, row binary")


def counts(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of each document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "blocks")
    blocks(docs, block_bytes).write.option("compression", "zstd").parquet(path)
    made = spark.read.parquet(path)

    def encode(batches):
        enc, last, n_last = encoder(vocabulary), None, 0
        for b in batches:
            found = []
            for w in b.column(2).to_pylist():
                if w != last:  # equal words come together, so nothing is kept of the others
                    last, n_last = w, len(enc.encode_ordinary(w))
                found.append(n_last)
            if not found:
                continue
            key, local, n = b.column(0).to_numpy(), b.column(1).to_numpy(), np.array(found, np.int32)
            order = np.lexsort((local, key))
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            parts = [(int(key[o[0]]), local[o].tobytes(), n[o].tobytes()) for o in np.split(order, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int64(), pa.binary(), pa.binary()))], ["block", "local", "pieces"])

    words = made.where("word IS NOT NULL").select("block", "local", "word")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, -(-input_bytes(made) // PART_BYTES))
    pieces = words.repartition(n, "word").sortWithinPartitions("word").mapInArrow(encode, "block long, local binary, pieces binary")
    rows = made.where("row IS NOT NULL").select("block", "doc_id", "row")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        join = lambda name: np.frombuffer(b"".join(right.column(name).to_pylist()), np.int32)
        local = join("local")
        by = np.zeros(len(local) + 1, np.int64)
        by[local] = join("pieces")
        sums = [unpack(plain(r.as_buffer()), by) for c in left.column("row").chunks for r in c]
        return pa.table([left.column("doc_id"), pa.array(sums, pa.int64())], ["doc_id", "n_tokens"])

    rows, pieces = rows.repartition(n, "block"), pieces.repartition(n, "block")
    return rows.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(total, "doc_id long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
