"""Files of a repository root on any Hadoop file system: immutable JSON manifests, tag pointers, Parquet objects."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class NotFound(KeyError):
    """No such repository, image, tag, table or object."""


#: Folder of objects below a root; the path of an object elsewhere begins otherwise.
INSIDE = "objects/"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._jvm = jvm

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def whole(self, path: str) -> str:
        """A path below the root, or one elsewhere as it is."""
        return self.at(path) if path.startswith(INSIDE) else path

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.at(*parts)))

    def names(self, *parts: str) -> list[str]:
        path = self._path(self.at(*parts))
        if not self._fs.exists(path):
            return []
        return sorted(n for s in self._fs.listStatus(path) if not (n := s.getPath().getName()).startswith(".") and not n.endswith(".tmp"))

    def read(self, *parts: str):
        path = self._path(self.at(*parts))
        if not self._fs.exists(path):
            raise NotFound(self.at(*parts))
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read_lines(self, *parts: str) -> list:
        """Values of a file that has one a line."""
        stream = self._fs.open(self._path(self.at(*parts)))
        try:
            return [json.loads(x) for x in bytes(stream.readAllBytes()).decode().splitlines() if x]
        finally:
            stream.close()

    def write_lines(self, values: list, *parts: str) -> bool:
        return self._put("\n".join(json.dumps(v, sort_keys=True) for v in values), True, parts)

    def write(self, value, *parts: str, overwrite: bool = True) -> bool:
        """Written aside, then moved into place; without overwrite, False where the file is there already."""
        return self._put(json.dumps(value, sort_keys=True), overwrite, parts)

    def _put(self, text: str, overwrite: bool, parts: tuple[str, ...]) -> bool:
        target = self._path(self.at(*parts))
        if not overwrite and self._fs.exists(target):
            return False
        aside = self._path(self.at(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}.tmp"))
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not overwrite:
            return bool(self._fs.rename(aside, target)) or not self.delete_path(aside)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(aside, target, options)
        return True

    def delete_path(self, path) -> bool:
        return bool(self._fs.delete(path, True))

    def delete(self, *parts: str) -> bool:
        return self.delete_path(self._path(self.at(*parts)))

    def move(self, source: str, *parts: str) -> bool:
        """Directory into place; False, and the source dropped, where one is there already."""
        target = self._path(self.at(*parts))
        if self._fs.exists(target):
            self.delete_path(self._path(source))
            return False
        self._fs.mkdirs(target.getParent())
        return bool(self._fs.rename(self._path(source), target))

    def size(self, *parts: str) -> int:
        return int(self._fs.getContentSummary(self._path(self.at(*parts))).getLength())

    def sizes(self, path: str, most: int = 64) -> dict[str, int]:
        """Bytes by folder directly below a path. Many are counted by the cluster."""
        found = [s.getPath() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        if len(found) <= most:
            return {p.getName(): int(self._fs.getContentSummary(p).getLength()) for p in found}
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        folder = F.element_at(F.split("path", "/"), -2)
        return {r["f"]: r["n"] for r in files.groupBy(folder.alias("f")).agg(F.sum("length").alias("n")).collect()}

    def children(self, path: str) -> list[str]:
        where = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def copy_to(self, other: Store, source: str, to: str) -> None:
        target = self._path(other.at(to))
        other._fs.mkdirs(target.getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(self.whole(source)), other._fs, target, False, True, self.spark.sparkContext._jsc.hadoopConfiguration())

    def staging(self) -> str:
        return self.at(".staging", uuid.uuid4().hex)
