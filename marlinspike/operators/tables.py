"""Parquet tables with insert-if-new, upsert and append; every rewrite is complete before it is seen."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The incoming rows to append: one per key (the first by `order`), and only keys that don't exist. Null keys never conflict."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(*(order or keys))
    once = incoming.withColumn("_n", F.when(known, F.row_number().over(w)).otherwise(1)).where("_n = 1").drop("_n")
    return once.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The merged table: incoming replaces existing by key, except that `keep` columns survive where they exist.

    Both sides must have one row per key. One full join; unchanged rows pass through.
    """
    old, new = existing.withColumn("_old", F.lit(True)).alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    columns = []
    for c in existing.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            columns.append(F.coalesce(n, o).alias(c))
        elif c in keep:
            columns.append(F.when(F.col("_old"), o).otherwise(n).alias(c))
        else:
            columns.append(F.when(F.col("_new"), n).otherwise(o).alias(c))
    return old.join(new, cond, "full").select(*columns)


class ParquetTable:
    """A folder of versions; a pointer file names the current one, so readers never see half a rewrite."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)

    def version(self) -> str | None:
        pointers = f"{self.path}/current"
        if not self._fs.exists(self._path(pointers)):
            return None
        numbers = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(pointers)))
        if not numbers:
            return None
        pointer = self._fs.open(self._path(f"{pointers}/{numbers[-1]}"))
        try:
            return bytes(pointer.readAllBytes()).decode()
        finally:
            pointer.close()

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/data/{v}")

    def replace(self, rows: DataFrame) -> None:
        """Writes a new version and then points to it; old versions stay for readers until vacuum().

        The pointer's name is the number of the version, so of two writers that started from the same version
        the second fails with FileExistsError, and none overwrites the other unseen.
        """
        name, pointers = uuid.uuid4().hex, self._path(f"{self.path}/current")
        count = len(self._fs.listStatus(pointers)) if self._fs.exists(pointers) else 0
        rows.write.parquet(f"{self.path}/data/{name}")
        self._point(count, name)

    def _point(self, number: int, name: str) -> None:
        at = self._path(f"{self.path}/current/{number:012d}")
        try:
            out = self._fs.create(at, False)
        except Exception as e:  # noqa: BLE001  the JVM's error; only a pointer that is there is a conflict
            if self._fs.exists(at):
                raise FileExistsError(f"{self.path}: version {number} was written by another writer") from e
            raise
        out.write(name.encode())
        out.close()

    def append(self, rows: DataFrame) -> None:
        v = self.version()
        if v is None:
            self.replace(rows)
        else:
            rows.write.mode("append").parquet(f"{self.path}/data/{v}")

    def ensure(self, schema: str) -> None:
        """Creates the table empty if it doesn't exist."""
        if self.version() is None:
            self.replace(self.spark.createDataFrame([], schema))

    def vacuum(self) -> None:
        """Deletes versions that aren't the current one."""
        keep = self.version()
        for s in self._fs.listStatus(self._path(f"{self.path}/data")):
            if s.getPath().getName() != keep:
                self._fs.delete(s.getPath(), True)
