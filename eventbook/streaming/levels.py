"""Result tables of streams, kept in runs that are merged in levels.

Every batch writes one run with the keys it has changed and nothing else.  As soon as ``FAN`` runs of a
level follow each other they are merged into one run of the next, so that after n batches a reader opens
at most ``FAN - 1`` runs of each of log(n) levels, and a row is rewritten once per level.

A run's name is its level and its last batch; which batches it covers follows from both.  No list of runs has to
be kept in step with the files: a reader walks back from the last batch by the largest finished run that ends there.
A batch that is repeated after a failure replaces its own run and its own merges.  The inputs of a merge stay
until the next merge of that level, so that readers that have already chosen them can finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 8


class Store:
    """The few file operations that runs need, on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path_of(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path_of(path))] if self.exists(path) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self.path_of(path), True)


class LeveledTable:
    """Rows of ``schema`` that batches add and ``merge`` puts together (it must not care for the order of runs)."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], fan: int = FAN):
        self.spark, self.folder, self.schema, self.merge, self.fan = spark, folder, schema, merge, fan
        self.store = Store(spark, folder)

    def _run(self, level: int, last: int) -> str:
        return f"{self.folder}/level={level}/last={last}"

    def _finished(self, level: int, last: int) -> bool:
        return self.store.exists(f"{self._run(level, last)}/_SUCCESS")

    def _merged(self, runs: list[str]) -> DataFrame:
        return self.merge(self.spark.read.schema(self.schema).parquet(*runs))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write the run of a batch and the merges that it completes."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._run(0, batch_id))
        level, covered = 1, self.fan
        while (batch_id + 1) % covered == 0:
            part = covered // self.fan
            inputs = [batch_id - k * part for k in range(self.fan)]
            self._merged([self._run(level - 1, last) for last in inputs]).write.mode("overwrite").parquet(self._run(level, batch_id))
            for last in inputs:
                if last >= covered:
                    self.store.delete(self._run(level - 1, last - covered))
            level, covered = level + 1, covered * self.fan

    def last_batch(self) -> int:
        """The last batch whose run is finished, -1 if there is none."""
        found = [int(name.partition("=")[2]) for name in self.store.names(f"{self.folder}/level=0")]
        return max((last for last in found if self._finished(0, last)), default=-1)

    def runs(self, last: int | None = None) -> list[str]:
        """The folders that hold all batches up to ``last`` (the last one, if not given)."""
        at, found = self.last_batch() if last is None else last, []
        while at >= 0:
            level, covered = 0, 1
            while (at + 1) % (covered * self.fan) == 0 and self._finished(level + 1, at):
                level, covered = level + 1, covered * self.fan
            if not self._finished(level, at):
                raise FileNotFoundError(f"no finished run ends at batch {at} in {self.folder}")
            found.append(self._run(level, at))
            at -= covered
        return found

    def read(self, last: int | None = None) -> DataFrame:
        """The merged rows of all batches up to ``last``."""
        runs = self.runs(last)
        return self._merged(runs) if runs else self.spark.createDataFrame([], self.schema)


def sums_of(spark: SparkSession, folder: str, key: str, value: str) -> LeveledTable:
    """One number per key that batches add to."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(value, T.LongType())])
    return LeveledTable(spark, folder, schema, lambda rows: rows.groupBy(key).agg(F.sum(value).alias(value)))


def newest_of(spark: SparkSession, folder: str, key: str, value: str) -> LeveledTable:
    """One number per key that batches replace; the one of the last batch counts."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(value, T.LongType()), T.StructField("batch", T.LongType())])
    return LeveledTable(
        spark, folder, schema, lambda rows: rows.groupBy(key).agg(F.max_by(value, "batch").alias(value), F.max("batch").alias("batch"))
    )
