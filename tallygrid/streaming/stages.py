"""Structured Streaming over the job log: stages by job as lines arrive, windowed counts, and resumable work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallygrid.functions import classify

EVENT = "job_id string, project_id string, ts timestamp, kind string, stage string, status string, message string, progress double"


def read_events(spark: SparkSession, path: str, schema: str = EVENT, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """A stream of the job events that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def track_stages(events: DataFrame) -> DataFrame:
    """``job_id``, stage, lines, changed: after each batch the stage a job is in, by its lines so far; state is two values a job.

    Lines of a batch are taken in order of time; a job that is silent for an hour of event time is forgotten.
    """
    told = events.withWatermark("ts", "10 minutes").select("job_id", "ts", classify.log_stage(F.col("message")).alias("told"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stage, lines = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        new = rows["told"].dropna()
        now = new.iloc[-1] if len(new) else stage
        state.update((now, lines + len(rows)))
        state.setTimeoutTimestamp(max(int(rows["ts"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame({"job_id": [key[0]], "stage": [now], "lines": [lines + len(rows)], "changed": [now != stage]})

    return told.groupBy("job_id").applyInPandasWithState(step, "job_id string, stage string, lines long, changed boolean", "stage string, lines long", "update", GroupStateTimeout.EventTimeTimeout)


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by window of event time and kind; those later than ``late`` are dropped, so the state is bounded."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "kind", "n")


def resume(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str]):
    """Process a stream batch by batch into a table; rows whose key the table has are not done again, and of those of one key in a batch one is.

    The query's checkpoint remembers what was read; the anti join makes a batch that was cut short and comes again harmless.
    """

    def batch(rows: DataFrame, number: int) -> None:
        try:
            done = rows.sparkSession.read.parquet(path).select(*keys)
            rows = rows.join(done, keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows = rows.dropDuplicates(keys)
        work(rows).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
