"""What the corpus operators share: checkpoints in the cluster's folder, let-bindings in SQL, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII letters that lower-casing touches.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, each with as many underscores in front as keep it apart from the columns of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return tuple(out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by ``spark.checkpoint.dir``; only a local session without one (a test) gets a folder of its own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tallygrid-")


#: Bytes that Spark hands to a Python worker at once; a single longer row still goes whole.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on, and in all of the session, Spark hands texts to Python in batches of about ``BATCH_BYTES``, unless the session has a lower limit.

    With batches of ten thousand texts, both ends of the pipe hold a partition's texts in buffers of tens of MB, outside of the heap; what the
    allocators of either process keep of these counts against the executor's memory until it ends. A stage's plan is run by who gets it, so the limit stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return sc._jsc.sc().getCheckpointDir().get()


#: Tables that ``saved`` has written since the innermost ``scratch`` was entered.
_written: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``saved`` wrote within it; what is needed of them must have been written elsewhere by then."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            delete(spark, path)


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, for what grows with the corpus."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that the cluster names and cut its lineage.

    The folder is that of ``spark.checkpoint.dir``; only a session without one (a test) gets a folder of its own.
    The partitions of the result are fixed, so ``spark_partition_id`` and ``monotonically_increasing_id`` give the
    same values each time that they are computed, on whichever executor.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_name(id_col: str, text_col: str) -> Column:
    """What names a row up to repetition: its id, which may be null, and its text."""
    return F.md5(F.concat_ws("|", F.col(id_col).isNull().cast("string"), F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit("")))))


def pick_rows(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs``, whole, for each ``name`` of ``stay``; of several, which differ in other columns only, the one that has the least digest of these."""
    (name,) = fresh(docs, "name_")
    kept = docs.withColumn(name, row_name(id_col, text_col)).join(stay.select(F.col("name").alias(name)), name, "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = F.md5(F.to_json(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`") for c in docs.columns if c != text_col))))
    return kept.groupBy(name).agg(F.min_by(F.struct(*columns), rest).alias("row")).select("row.*")


def lower_ascii(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, label)``; the label is the smallest node.

    Each round gives a node the smallest label among its neighbours and then the label of its label, so that paths
    shorten by half and a chain of n nodes takes about log2(n) rounds. Rows with null ends are left out. Only counts reach the driver.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = checkpoint(e.union(e.select("b", "a")).distinct().toDF("node", "other"))
    labels = checkpoint(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.toDF("other", "l"), "other").groupBy("node").agg(F.min("l").alias("m"))
        one = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label"))
        up = labels.toDF("label", "up")
        two = checkpoint(one.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        labels = two.select("node", "label")
        if two.where("was <> label").limit(1).count() == 0:
            return labels
