"""Cutting lineage where executors can be lost: reliable checkpoints in the folder all of them share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from millrace.session import shared_folder


def release(spark: SparkSession, rounds: int = 2, pause: float = 0.1) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more.

    It learns of them from the driver's garbage collection, which a small driver may put off for long. What Python
    lets go, and events that listeners have yet to see, reach it a little later: so both collect several times.
    """
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


#: What keeps the memory of a task flat, where the session has no own settings. The planner knows no sizes of
#: checkpoints, so each of their partitions would make a runtime filter of the largest size (8 MB), and one
#: task would gather the filters of all partitions.
SETTINGS = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "false"}


def settled(spark: SparkSession) -> SparkSession:
    """``spark`` with ``SETTINGS`` where it has none of its own."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there from now on."""
    shared_folder(settled(df.sparkSession))
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out
