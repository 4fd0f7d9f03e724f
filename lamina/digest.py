"""Order-independent, additive content hashes: sixteen 16-bit sums over SHA-256 digests of rows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lamina.rowtext import row_text
from lamina.types import Schema

LANES, MOD = 16, 1 << 16


@dataclass(frozen=True)
class Digest:
    lanes: tuple[int, ...]

    @classmethod
    def zero(cls) -> Digest:
        return cls((0,) * LANES)

    @classmethod
    def of_text(cls, text: str) -> Digest:
        return cls.from_hex(hashlib.sha256(text.encode()).hexdigest())

    @classmethod
    def from_hex(cls, text: str) -> Digest:
        return cls(tuple(int(text[i : i + 4], 16) for i in range(0, 4 * LANES, 4)))

    @classmethod
    def of_row(cls, row: Row, prefix: str = "h") -> Digest:
        return cls(tuple(int(row[f"{prefix}{i}"] or 0) % MOD for i in range(LANES)))

    def __add__(self, other: Digest) -> Digest:
        return Digest(tuple((a + b) % MOD for a, b in zip(self.lanes, other.lanes)))

    def __sub__(self, other: Digest) -> Digest:
        return Digest(tuple((a - b) % MOD for a, b in zip(self.lanes, other.lanes)))

    def __neg__(self) -> Digest:
        return Digest.zero() - self

    def __bool__(self) -> bool:
        return any(self.lanes)

    def hex(self) -> str:
        return "".join(f"{x:04x}" for x in self.lanes)


def words(sha: Column) -> list[Column]:
    """A hex digest as four integers of 64 bits."""
    return [F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long") for i in range(LANES // 4)]


def lane_sums(sha: Column | list[Column], prefix: str = "h") -> list[Column]:
    """Aggregates of a column of hex digests, or of its words, one per lane; null digests add nothing."""
    four = sha if isinstance(sha, list) else words(sha)
    return [F.sum(F.shiftrightunsigned(four[i // 4], 48 - 16 * (i % 4)).bitwiseAND(MOD - 1)).alias(f"{prefix}{i}") for i in range(LANES)]


def hex_column(prefix: str = "h") -> Column:
    """Hex digest of summed lanes, on the cluster."""
    lanes = [F.lpad(F.lower(F.hex(F.coalesce(F.col(f"{prefix}{i}"), F.lit(0)).bitwiseAND(MOD - 1))), 4, "0") for i in range(LANES)]
    return F.concat(*lanes)


def content_hash(df: DataFrame, schema: Schema) -> Digest:
    return Digest.of_row(df.select(F.sha2(row_text(schema), 256).alias("s")).agg(*lane_sums(F.col("s"))).first())


def object_id(content: Digest, schema_hash: str) -> str:
    return "o" + hashlib.sha256((content.hex() + schema_hash).encode()).hexdigest()[:-2]
