"""Views over an append-only log of job events: (job_id, project_id, ts, kind, stage, status, message, progress)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions import classify
from tallygrid.operators.parsers import carried


def newest(rows: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """The newest ``n`` rows; later columns of ``order`` break ties, all falling."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def tail(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 500) -> DataFrame:
    """The last ``n`` rows of each key. Spark bounds each group before it is shuffled, as the rank is limited."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def stage_status(events: DataFrame) -> DataFrame:
    """``job_id``, stage, status, started, ended: the latest status of each stage, and when it ran; one aggregate."""
    done = F.col("status").isin("completed", "failed")
    latest = F.max(F.struct("ts", F.when(done, 1).otherwise(0).alias("done"), "status"))
    return events.where("kind = 'stage'").groupBy("job_id", "stage").agg(
        latest["status"].alias("status"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started"), F.max(F.when(done, F.col("ts"))).alias("ended")
    )


def stages_from_log(events: DataFrame, keys: Sequence[str] = ("job_id",), order: Sequence[str] = ("ts",), message: str = "message") -> DataFrame:
    """Log lines with the stage that they are in: the last that a line has told."""
    return carried(events.withColumn("_told", classify.log_stage(F.col(message))), keys, "_told", order, "stage_now").drop("_told")


def pending(pages: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pages that are not done yet."""
    return pages.join(done.select(*keys).distinct(), list(keys), "left_anti")


def without(rows: DataFrame, hidden: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the hidden or registered ones."""
    return rows.join(hidden.select(*keys).distinct(), list(keys), "left_anti")
