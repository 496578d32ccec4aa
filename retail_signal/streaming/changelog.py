"""A keyed change log that can be compacted while it is read and written.

    <path>/changes/epoch=<n>/        rows changed by micro-batch n (Parquet)
    <path>/done/<n>                  batch n is complete
    <path>/snapshots/<n>-<id>/       the newest row of every key up to batch n
    <path>/pointers/<n>-<id>         that snapshot is complete

A marker or a pointer is an empty file that comes by renaming a temporary one,
so it is there or not.  A reader takes the snapshot that the newest pointer
names and the complete batches after it; a job that dies before its marker or
pointer leaves folders that nobody reads, and one that dies after it has done
its work.  Files go through the Hadoop file system of the path, the one that
Spark itself writes to.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.fs import Folder


class ChangeLog:
    """The newest row per ``keys``; ``schema`` is that of the rows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType | str):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._files = Folder(spark, self.path)

    # -- batches -----------------------------------------------------------

    def snapshot(self) -> tuple[int, str | None]:
        """(last batch in the newest complete snapshot, its name)."""
        found = [(int(n.split("-")[0]), n) for n in self._files.names("pointers")]
        return max(found, default=(-1, None))

    def epochs(self) -> list[int]:
        """The complete batches that the snapshot does not hold."""
        last = self.snapshot()[0]
        return sorted(n for n in map(int, self._files.names("done")) if n > last)

    def last(self) -> int:
        """The newest complete batch, -1 before the first."""
        return max([self.snapshot()[0], *self.epochs()])

    def holds(self, epoch: int) -> bool:
        return epoch <= self.snapshot()[0] or epoch in self.epochs()

    def put(self, rows: DataFrame, epoch: int) -> None:
        """Write batch ``epoch`` (again, if an attempt died before ``commit``)."""
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/changes/epoch={epoch}")

    def commit(self, epoch: int) -> None:
        self._files.mark(f"done/{epoch}")

    # -- reading -----------------------------------------------------------

    def _part(self, path: str, epoch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path).withColumn("_epoch", F.lit(epoch))

    def _parts(self) -> list[DataFrame]:
        """The snapshot and the complete batches after it, with ``_epoch``."""
        last, name = self.snapshot()
        parts = [self._part(f"{self.path}/snapshots/{name}", last)] if name else []
        return parts + [self._part(f"{self.path}/changes/epoch={n}", n) for n in self.epochs()]

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The row before which no newer one of its key stands: one exchange of
        the rows, and none if they are dealt by key already."""
        newer = F.lag(F.lit(1)).over(Window.partitionBy(*self.keys).orderBy(F.desc("_epoch")))
        return rows.withColumn("_newer", newer).where("_newer IS NULL").drop("_newer")

    def read(self, columns: list[str] | None = None, only: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
        """The newest row of every key, with its keys and ``columns`` (all by
        default).  ``only``: a table of some of the key columns; other keys
        are left out before rows are compared.  ``extra``: rows newer than all.

        The newest part stays where it is: only its keys meet the rows of the
        older ones."""
        rest = [c for c in (self.schema.fieldNames() if columns is None else columns) if c not in self.keys]
        parts = self._parts()
        if extra is not None:
            parts.append(extra.select(*self.schema.fieldNames()).withColumn("_epoch", F.lit(1 << 30)))
        if not parts:
            return self.spark.createDataFrame([], self.schema).select(*self.keys, *rest)
        if only is not None:
            parts = [p.join(only, only.columns, "left_semi") for p in parts]
        if not rest:
            return reduce(DataFrame.unionByName, parts).select(*self.keys).distinct()
        newest = parts[-1].select(*self.keys, *rest)
        if len(parts) == 1:
            return newest
        older = reduce(DataFrame.unionByName, parts[:-1]).select(*self.keys, "_epoch", F.struct(*rest).alias("_row"))
        hidden = parts[-1].select(*self.keys, "_epoch", F.lit(None).cast(older.schema["_row"].dataType).alias("_row"))
        left = self._newest(older.unionByName(hidden)).where("_row IS NOT NULL")
        return newest.unionByName(left.select(*self.keys, "_row.*"))

    # -- compaction --------------------------------------------------------

    def compact(self) -> bool:
        """One new snapshot of all complete batches; False if there is none."""
        epochs = self.epochs()
        if not epochs:
            return False
        name = self.write_snapshot(epochs[-1])
        self.publish(name)
        return True

    def write_snapshot(self, last: int) -> str:
        name = f"{last}-{uuid.uuid4().hex[:8]}"
        # Sorted by key, so that readers of some keys skip row groups.  Ranges
        # of keys hold all rows of a key, so the newest are found in place.
        rows = reduce(DataFrame.unionByName, self._parts())
        (self._newest(rows.repartitionByRange(*self.keys)).sortWithinPartitions(*self.keys)
         .select(*self.schema.fieldNames()).write.option("compression", "zstd").parquet(f"{self.path}/snapshots/{name}"))
        return name

    def publish(self, name: str) -> None:
        self._files.mark(f"pointers/{name}")

    def vacuum(self, keep: int = 1) -> None:
        """Delete batches that a snapshot holds and all but the newest
        ``keep`` + 1 snapshots; readers of older ones must have finished."""
        pointers = sorted(self._files.names("pointers"), key=lambda n: int(n.split("-")[0]))
        if not pointers:
            return
        last, kept = int(pointers[-1].split("-")[0]), set(pointers[-(keep + 1):])
        for n in self._files.names("snapshots"):
            if n not in kept and int(n.split("-")[0]) <= last:
                self._files.delete(f"snapshots/{n}")
        for n in pointers:
            if n not in kept:
                self._files.delete(f"pointers/{n}")
        for n in self._files.names("changes"):
            if int(n.split("=")[1]) <= last:
                self._files.delete(f"changes/{n}")
        for n in self._files.names("done"):
            if int(n) <= last:
                self._files.delete(f"done/{n}")
