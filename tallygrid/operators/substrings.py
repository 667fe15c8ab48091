"""Substring joins: which texts contain which needles, by an index of short pieces instead of comparing each needle with each text.

A text that contains a needle contains all of the needle's pieces of ``PIECE`` characters. Each needle is looked up by the one of its pieces that fewest texts have
(a shorter needle by itself), and what is found is verified on the whole text. A needle with a piece that no text has is in none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece, and distinct pieces of needles that are broadcast, as longs; beyond, texts' pieces are shuffled to them.
PIECE, MOST_BROADCAST = 4, 2_000_000


def pieces(text: Column, length: int) -> Column:
    """The distinct pieces of a text, of ``length`` characters each, as an array."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def containing(needles: DataFrame, texts: DataFrame, scope: Sequence[str], needle: str, text: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``scope``, needle, text: the distinct pairs of a scope in which the text contains the needle.

    An empty needle is in every text. Null needles and texts are in no pair; null scopes are a scope like others. An empty table gives none.
    """
    if not scope:
        raise ValueError("a scope has one column at least")
    at = [f"s{i}" for i in range(len(scope))]
    named = lambda d, c, to: d.select(*(F.col(f"`{s}`").alias(a) for s, a in zip(scope, at, strict=True)), F.col(f"`{c}`").alias(to)).where(F.col(to).isNotNull()).distinct()
    n, t = named(needles, needle, "needle"), named(texts, text, "text").withColumn("name", F.md5("text"))
    piece = lambda p: F.xxhash64(*(F.coalesce(F.to_json(F.struct(a)), F.lit("")) for a in at), p).alias("piece")
    # at most PIECE lengths: those of shorter needles, and the whole piece
    lengths = sorted(r[0] for r in n.where("needle <> ''").select(F.least(F.length("needle"), F.lit(PIECE)).alias("k")).distinct().collect())
    if not lengths:
        asked = n.where("needle = ''")
    else:
        cut = F.coalesce(*(F.when(F.least(F.length("needle"), F.lit(PIECE)) == k, pieces(F.col("needle"), k)) for k in lengths))
        of_needle = n.where("needle <> ''").select(*at, "needle", F.explode(cut).alias("p")).select(*at, "needle", piece(F.col("p")))
        wanted = of_needle.select("piece").distinct()
        small = wanted.limit(most_broadcast + 1).count() <= most_broadcast
        of_text = t.select(*at, "name", F.explode(F.concat(*(pieces(F.col("text"), k) for k in lengths))).alias("p")).select(*at, "name", piece(F.col("p")))
        of_text = of_text.join(F.broadcast(wanted) if small else wanted, "piece", "left_semi")
        often = of_text.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
        rare = of_needle.join(often, "piece", "left").groupBy(*at, "needle").agg(F.min(F.struct("n", "piece")).alias("r"), F.count_if(F.col("n").isNull()).alias("none")).where("none = 0")
        met = rare.select(*at, "needle", F.col("r.piece").alias("piece")).join(of_text.select("piece", "name").distinct(), "piece")
        asked = None
    out = []
    if asked is None:
        both = met.alias("m").join(t.alias("t"), [F.col("m.name") == F.col("t.name"), *(F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in at)]).where(F.contains("text", F.col("needle")))
        out.append(both.select(*(F.col(f"m.{c}").alias(c) for c in at), "needle", "text"))
        asked = n.where("needle = ''")
    empty = asked.alias("n").join(t.alias("t"), [F.col(f"n.{c}").eqNullSafe(F.col(f"t.{c}")) for c in at])
    out.append(empty.select(*(F.col(f"n.{c}").alias(c) for c in at), "needle", "text"))
    got = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return got.select(*(F.col(a).alias(s) for a, s in zip(at, scope, strict=True)), F.col("needle"), F.col("text"))
