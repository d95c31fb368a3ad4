"""Small texts and folders that appear in one step, in whatever file system Spark's paths name."""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


class Folder:
    """Files below one root, through the cluster's Hadoop client."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._files: JavaObject = self._path("").getFileSystem(self._conf)

    def _path(self, name: str) -> JavaObject:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Entries of a folder, sorted; none where there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(self._path(name)))

    def read(self, name: str) -> dict | None:
        """A text written by ``write``."""
        if not self.exists(name):
            return None
        stream = self._files.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Replace a text as a whole: readers see the old one or the new one."""
        draft = f"{name}.{uuid.uuid4().hex}"
        stream = self._files.create(self._path(draft), True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        self.move(draft, name, True)

    def move(self, source: str, target: str, overwrite: bool = False) -> None:
        """Rename in one step; without ``overwrite`` an existing target makes it fail."""
        hadoop = self._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self._files.getUri(), self._conf)
        option = hadoop.Options.Rename.OVERWRITE if overwrite else hadoop.Options.Rename.NONE
        options = self._jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        options[0] = option
        context.rename(self._path(source), self._path(target), options)

    def delete(self, name: str) -> None:
        self._files.delete(self._path(name), True)
