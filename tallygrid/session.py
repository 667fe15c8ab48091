"""SparkSession with the engine's defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "tallygrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables; ``sf_dir`` may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task, at most, where rows are sorted or gathered, if keys allow.
TASK_ROWS = 250_000


def tasks(spark: SparkSession, rows: int = 0) -> int:
    """Into how many tasks to deal ``rows`` rows: some for each core, and more if they are many.

    A number that is given holds. Without one, adaptive execution makes a task of some tens of MB as they are compressed: texts that take
    minutes to read, or millions of rows that are alike.
    """
    cores = spark.sparkContext.defaultParallelism
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores, -(-rows // TASK_ROWS))


def spread(df, *keys, rows: int = 0):
    """``df`` dealt by ``keys`` into ``tasks``, whatever its size in bytes."""
    return df.repartition(tasks(df.sparkSession, rows), *keys)


def shuffled(df):
    """``df`` as a side of a join that must not be broadcast, as it grows with the projects.

    Spark estimates a side by the compressed bytes of the columns that it reads, whatever is made of them: texts of all projects would be sent to the driver.
    """
    return df.hint("merge")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, by ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallygrid-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df):
    """``df`` computed once and written to the folder that driver and executors share, its lineage cut, as a checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()
