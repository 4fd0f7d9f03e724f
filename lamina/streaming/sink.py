"""Streams into repositories: each micro-batch is one commit, applied once however often it is delivered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.catalog import layer_hash
from lamina.repo import Repository
from lamina.sources.loading import blind_upsert
from lamina.sources.messages import append_dedup


def commit_batches(repo: Repository, table: str, pk: Sequence[str], cursor: Sequence[str] | None = None, stream: str = ""):
    """Function for ``writeStream.foreachBatch``: upserts the batch by key.

    The image's hash is that of the stream's name, the table and the batch, so a batch that is delivered again finds its
    image. Of rows with one key in a batch the last by cursor holds, or, without one, the greatest by its text.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = layer_hash("batch", repo.name, stream, table, str(batch_id))
        if repo.images.exists() and repo.images.has(mark):
            return
        if cursor:
            rows = append_dedup(batch, pk, cursor)
        else:
            text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in batch.columns]))
            rows = append_dedup(batch.withColumn("_text", text), pk, ["_text"]).drop("_text")
        if not repo.images.exists():
            repo.init()
        latest = repo.images.by_tag("latest")
        if table not in latest.tables:
            work = repo.checkout(latest.hash, force=True)
            work.create(table, rows, pk)
            repo.commit(mark, comment=f"batch {batch_id}")
        else:
            blind_upsert(repo, table, rows, comment=f"batch {batch_id}", image_hash=mark)

    return write


def changes_since(repo: Repository, table: str, old: str, new: str = "latest") -> DataFrame:
    """What changed between two images, as rows with ``added``: a feed for downstream jobs."""
    return repo.diff(table, old, new).select("added", *[F.col(f"`{c.name}`") for c in repo.images[new].tables[table].schema])
