"""Result tables of streams: one folder per micro-batch, replaced as a whole when a batch is repeated.

A batch that is run again after a failure overwrites its own folder, so every batch counts once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def batch_folder(folder: str, batch_id: int) -> str:
    return f"{folder}/batch_id={batch_id}"


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_folder(folder, batch_id))


def read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All finished batches with their ``batch_id``; ``schema`` is that of one batch."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.schema(full).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)  # no batch has arrived yet


def run_to_end(writer, checkpoint: str) -> None:
    """Process what is available, then stop; the checkpoint lets a later run go on from there."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
