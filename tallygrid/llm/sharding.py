"""Balanced label propagation into shards of equal row counts.

Documents are linked if they share a group key. Links are kept as (document, group) rows, never as pairs: a document's
neighbours are counted by the labels of its group. A group is held in units, its rows by hash cell, so that a group with a
third of all rows is some hundred rows and can be spread over shards.

A round gives each group the label that most of its rows have, and its other units ask to move there. Moves from shard a to
shard b are admitted as far as moves from b to a make room, and then as far as b is below its quota; where more units ask
than may move, a hash of the group (of the unit, for groups that would fill a large part of a shard) decides which.
Rounds end when no unit moves. Then rows are numbered within their shards, linked ones first, and those numbered
beyond the quota fill the free places of the other shards: rows without links, unless a shard has too many linked ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import checkpoint

#: Cells of a group for each shard, and the most rounds of moves.
CELLS, ROUNDS = 8, 12
#: Most shards: the driver holds and broadcasts a count for each two of them.
MOST_SHARDS = 1000
_COIN = 1_000_003


def admitted(demand: dict[tuple[int, int], int], load: dict[int, int], quota: int) -> dict[tuple[int, int], float]:
    """The share of each (from, to) demand that may move, so that no shard is expected to pass ``quota`` by it."""
    swap = {k: min(n, demand.get((k[1], k[0]), 0)) for k, n in demand.items()}
    over: dict[int, int] = {}
    for (a, b), n in demand.items():
        over[b] = over.get(b, 0) + n - swap[a, b]
    out = {}
    for (a, b), n in demand.items():
        free = max(0, quota - load.get(b, 0))
        part = min(1.0, free / over[b]) if over[b] else 0.0
        out[a, b] = (swap[a, b] + (n - swap[a, b]) * part) / n
    return out


def propagate(units: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """Labels for ``units(key, cell, n, total, label)``; ``total`` is the rows of the group. Returns the same columns."""
    spark = units.sparkSession
    for turn in range(rounds):
        by_label = units.groupBy("key", "label").agg(F.sum("n").alias("m"))
        best = by_label.groupBy("key").agg(F.max(F.struct("m", F.xxhash64("key", "label").alias("tie"), "label")).alias("b")).select("key", F.col("b.label").alias("best"))
        wish = checkpoint(units.join(best, "key"))
        demand = {(r["label"], r["best"]): r["n"] for r in wish.where("label <> best").groupBy("label", "best").agg(F.sum("n").alias("n")).collect()}
        if not demand:
            return units
        load = {r["label"]: r["n"] for r in units.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        shares = [(a, b, p) for (a, b), p in admitted(demand, load, quota).items() if p > 0]
        if not shares:
            return units
        # at most shards * shards rows
        table = F.broadcast(spark.createDataFrame(shares, "label int, best int, p double"))
        coin = F.when(F.col("total") * 20 <= quota, F.xxhash64(F.lit(turn), "key")).otherwise(F.xxhash64(F.lit(turn), "key", "cell"))
        moved = wish.join(table, ["label", "best"], "left")
        go = (F.col("label") != F.col("best")) & (F.pmod(coin, F.lit(_COIN)) < F.coalesce("p", F.lit(0.0)) * _COIN)
        moved = checkpoint(moved.select("key", "cell", "n", "total", F.when(go, F.col("best")).otherwise(F.col("label")).alias("label"), go.alias("go")))
        units = moved.drop("go")
        if moved.where("go").limit(1).count() == 0:
            return units
    return units


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a running number by (label, linked) within the partition."""
    seen: dict[tuple, int] = {}
    for batch in batches:
        kinds = list(zip(batch.column("label").to_pylist(), batch.column("linked").to_pylist(), strict=True))
        number = np.empty(len(kinds), np.int64)
        for i, k in enumerate(kinds):
            number[i] = n = seen.get(k, 0)
            seen[k] = n + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], [*batch.schema.names, "number"])


def shard_rows(docs: DataFrame, group: Column, shards: int = 40, rounds: int = ROUNDS, cells: int = CELLS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: row counts differ by one at most, slots are gapless from 0.

    ``group`` links the rows that have the same value; null links nothing. All rows get a place, repeated ones too; null and empty
    texts are rows like any other, and an empty table gives none. ``docs`` should be narrow, without long texts: its columns are written to the
    checkpoint folder. Columns named like the two new ones are replaced; others, whatever their names, stay.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"from 1 to {MOST_SHARDS} shards")
    # the caller's columns travel as one, by number, so that no name of theirs meets one of ours
    columns = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    own = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).alias("doc")
    cell = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells * shards)).cast("int").alias("cell")
    rows = checkpoint(docs.select(own, group.alias("key"))).select("doc", "key", cell)
    total = rows.count()
    units = rows.where("key is not null").groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"))
    groups = units.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1")
    linked = checkpoint(units.join(groups, "key").select("key", "cell", "n", "total", F.pmod("cell", F.lit(shards)).alias("label")))
    linked = propagate(linked, shards, -(-total // shards), rounds)
    placed = rows.join(linked.select("key", "cell", "label"), ["key", "cell"], "left")
    placed = placed.select("doc", F.coalesce("label", F.pmod("cell", F.lit(shards))).alias("label"), F.col("label").isNotNull().alias("linked"))
    placed = checkpoint(placed).withColumn("part", F.spark_partition_id())

    counts = placed.groupBy("part", "label", "linked").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy(F.desc("linked"), "part")) - F.col("n")
    counts = checkpoint(counts.select("part", "label", "linked", "n", before.alias("before")))
    sizes = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    first_over, free, over, at = [], [], 0, 0
    for s in range(shards):
        n = sizes.get(s, 0)
        first_over.append(over)
        over += max(0, n - quota[s])
        if n < quota[s]:
            free.append((at, at + quota[s] - n, s, n))
            at += quota[s] - n
    numbered = placed.mapInArrow(_numbered, T.StructType([*placed.schema.fields, T.StructField("number", T.LongType())]))
    out = numbered.join(counts.drop("n"), ["part", "label", "linked"]).withColumn("place", F.col("before") + F.col("number"))
    # arrays of one entry a shard
    longs = lambda xs: F.array(*(F.lit(int(x)).cast("long") for x in xs))
    out = out.withColumn("beyond", F.col("place") - F.get(longs(quota), F.col("label")))
    rank = F.get(longs(first_over), F.col("label")) + F.col("beyond")
    places = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(s).alias("s"), F.lit(n).cast("long").alias("n")) for a, b, s, n in free or [(0, 0, 0, 0)]))
    spot = F.get(F.filter(places, lambda x: (x["a"] <= F.col("rank")) & (F.col("rank") < x["b"])), F.lit(0))
    out = out.withColumn("rank", rank).withColumn("spot", F.when(F.col("beyond") >= 0, spot))
    out = out.select(
        "doc",
        F.coalesce(F.col("spot.s"), F.col("label")).cast("int").alias("shard"),
        F.when(F.col("beyond") >= 0, F.col("spot.n") + F.col("rank") - F.col("spot.a")).otherwise(F.col("place")).alias("slot"),
    )
    return out.select(*(F.col(f"doc.c{i}").alias(c) for i, c in enumerate(columns)), "shard", "slot")
