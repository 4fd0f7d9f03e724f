"""Session helpers: tables, shared scratch folders, lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a short table up to which it is sent to every executor; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many short rows, with a broadcast hint only where they are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, a laptop) is a temporary folder made and removed at exit.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lamina-")
        atexit.register(shutil.rmtree, found[len("file://"):], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, deleted when the driver process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lamina-{tag}-{uuid.uuid4().hex}"
    atexit.register(delete_path, spark, path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    if path.startswith("file:") or "://" not in path:
        local = path.split(":", 1)[-1] if path.startswith("file:") else path
        shutil.rmtree("/" + local.lstrip("/"), ignore_errors=True)
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is already gone at exit; the cluster's own sweep takes the folder
        return


def cut(df: DataFrame) -> DataFrame:
    """Write a narrow table to the shared folder and forget how it was made."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, as the optimizer knows them: of files their sizes; rows in memory count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def local_path(path: str) -> str:
    """Plain path of a ``file:`` URI; other URIs stay as they are."""
    return "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else os.path.abspath(path) if "://" not in path else path
