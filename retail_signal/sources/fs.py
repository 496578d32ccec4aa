"""Small marker files and renames on the file system of a path.

Everything goes through the Hadoop file system that Spark itself writes the
path with, so it works on any shared store Spark knows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What a folder holds; nothing if it is not there."""
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))] if self.exists(name) else []

    def rename(self, old: str, new: str) -> None:
        """Move a file or folder to a name that is there at once or not at all."""
        parent = new.rpartition("/")[0]
        if parent:
            self._fs.mkdirs(self._at(parent))
        if not self._fs.rename(self._at(old), self._at(new)) and not self.exists(new):
            raise OSError(f"cannot rename {self.path}/{old} to {new}")

    def mark(self, name: str) -> None:
        """An empty file that is there at once or not at all."""
        temporary = f"tmp/{uuid.uuid4().hex}"
        self._fs.create(self._at(temporary), True).close()
        self.rename(temporary, name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
