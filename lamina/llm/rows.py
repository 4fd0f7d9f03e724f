"""Rows of documents that agree in id and text, without windows: no task holds all copies of a row."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.runtime import cut, small


def own_key(doc_id: str | Column, text_hash: str | Column) -> Column:
    """A hash that, with the text's hash, tells documents apart; null ids too."""
    return F.xxhash64(doc_id, text_hash)


def one_of_each(docs: DataFrame, which: Column, text: str = "text") -> DataFrame:
    """Of rows with equal id and text, where ``which`` holds, the one that comes first by a hash of all its columns.

    Repeated rows are found by a count of hashes and aggregated before they move; all others aren't moved. Columns may
    have any type and name.
    """
    mark = uuid.uuid4().hex[:8]
    th, key = f"_t{mark}", f"_k{mark}"
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(th, F.xxhash64(F.col(text))).withColumn(key, own_key("doc_id", th))
    repeated = cut(keyed.where(which).groupBy(th, key).agg(F.count("*").alias("n")).where("n > 1").select(th, key))
    n = repeated.count()
    if not n:
        return docs
    row = F.struct(*columns)
    one = keyed.join(small(repeated, n), [th, key], "left_semi").groupBy(th, key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    rest = keyed.join(small(repeated, n), [th, key], "left_anti")
    return rest.select(*columns).unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
