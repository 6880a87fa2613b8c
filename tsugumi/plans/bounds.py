"""Choices that depend on a measured size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    The check reads at most ``max_rows + 1`` rows. Beyond the bound the join falls to
    Spark's shuffle joins, which adaptive execution splits where keys are hot.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows: by its plan (limits and sums over them), else by reading at most ``most + 1`` of them."""
    known = df._jdf.queryExecution().optimizedPlan().maxRows()
    return int(known.get()) <= most if known.isDefined() else df.limit(most + 1).count() <= most


def limited(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` itself if it has few rows, as what follows puts them all in one task; ValueError otherwise."""
    if not few(df, most):
        raise ValueError(f"more than {most} rows where a limited result is needed")
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which every executor must reach.

    Where it is unset a temporary folder is made, but only if all tasks run in this process (master ``local``); on a cluster that
    is an error, as a folder of one machine is no place for data that others read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set: name a folder that the driver and all executors of {master} share")
    return tempfile.mkdtemp(prefix="tsugumi-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so later uses read it instead of computing it again. Runs a job.

    Files go with their table if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on when the session starts.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def repeatable(df: DataFrame) -> DataFrame:
    """``df`` itself if its rows come in the same order whenever a task is run again (no shuffle in its plan), else written down first."""
    return checkpointed(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df
