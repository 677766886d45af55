"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for.  On a cluster put them in spark-defaults; nothing
# here is needed for correct results.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key must be split even where the split costs one more exchange further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eventbook")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("EVENTBOOK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.lru_cache(maxsize=None)
def _local_scratch(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="eventbook-")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_scratch(spark.sparkContext.applicationId)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where a plan is read more than once and must not be evaluated differently (ids by
    position), in loops whose plan would grow with every round, and for small tables whose size
    should be known to the planner before they are joined: it then broadcasts them by the size of
    their files, or does not.
    """
    folder = run_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def side_by_side(spark: SparkSession, *steps: Callable[[], Any]) -> list[Any]:
    """What the steps return, in their order; their jobs share the cores.

    Used for steps that do not read what another one writes.  An error is raised once all steps have ended.
    """
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(steps)) as pool:
        started = [pool.submit(inherit(step)) for step in steps]
    return [step.result() for step in started]


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: Any) -> Iterator[None]:
    """Within, the session has this setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def unsorted_writes(spark: SparkSession, most_open: int) -> contextlib.AbstractContextManager[None]:
    """Within, tasks write rows into partitions as they come, and sort only those that meet more than ``most_open``.

    For rows of which a task holds few partitions.  The files hold the same rows.
    """
    return setting(spark, "spark.sql.maxConcurrentOutputFileWriters", most_open)


def drop_written(df: DataFrame) -> None:
    """Remove the folder of a table that ``cut_lineage`` has written, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles():
        folder = file.rpartition("/")[0]
        if "/cut-" not in folder:
            return
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return
