"""Small files and folders by Spark's own file systems, so a database may live wherever Spark reads and writes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write under another name, then rename over the old file in one step."""
        new = self._path(self.at(f".{name}-{uuid.uuid4().hex}"))
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._context.rename(new, self._path(self.at(name)), options)

    def folders(self, name: str) -> list[str]:
        path = self._path(self.at(name))
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def usage(self, name: str) -> tuple[int, int]:
        """(files, bytes) below a folder."""
        path = self._path(self.at(name))
        if not self._fs.exists(path):
            return 0, 0
        s = self._fs.getContentSummary(path)
        return s.getFileCount(), s.getLength()
