"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark item has windows of 13 words in a row. A document that contains a window contains all of the window's word
shingles, so any one of them is a sufficient prefix to join on; with the shingles ordered by how rare they are in all
documents, the join meets only the fewest candidates. A candidate puts the window at one place; it is kept if that place
lies within the document (length and position), and if the words there equal the window's (exact containment).

The words are compared twice: the join uses full lower case, which equal words share whatever the alphabet, and the check
lower-cases A-Z alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import LOWER, UPPER, checkpoint, fresh, lower_ascii

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 13, 5
#: Distinct shingles of the benchmark that are sent along with the plan, and windows that are broadcast; beyond, they are joined by shuffling.
MOST_LITERALS, MOST_BROADCAST = 100_000, 500_000
#: Fixed value: what separates words, before lower-casing.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: str):
    """The words of a text column, upper case left as it is; a null text has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATOR), "")


def _hash(size: int) -> str:
    return f"xxhash64({size}, " + ", ".join(f"w[i + {k}]" for k in range(size)) + ")"


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: ``win`` (words, space-joined), ``len``, ``items`` (ids as strings), ``words`` for hashing."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_col).alias("w")).where("size(w) > 0")
    cut = rows.selectExpr("item", f"explode(transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))) AS words")
    text = lower_ascii(F.array_join("words", " "))
    return (
        cut.select("item", text.alias("win"))
        .groupBy("win")
        .agg(F.collect_set("item").alias("items"))
        .select("win", "items", F.split("win", " ").alias("words"))
        .withColumn("len", F.size("words"))
    )


def shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """``(win, len, size, off, h)``: the shingles of each window; a window shorter than a shingle is one itself."""
    parts = [
        windows.where(F.col("len") == k).selectExpr("win", "len", f"{k} AS size", "0 AS off", f"transform(array(transform(words, x -> lower(x))), w -> transform(array(0), i -> {_hash(k)})[0])[0] AS h")
        for k in range(1, shingle)
    ]
    long = windows.where(F.col("len") >= shingle).selectExpr("win", "len", f"{shingle} AS size", f"posexplode(transform(array(transform(words, x -> lower(x))), w -> transform(sequence(0, size(w) - {shingle}), i -> {_hash(shingle)}))[0]) AS (off, h)")
    out = long
    for p in parts:
        out = out.unionByName(p)
    return out


def _matches(docs: DataFrame, sizes: list[int], hashes: list[int], window: int) -> DataFrame:
    """Each row's ``n_words`` and its shingles that the benchmark has, with the words around them."""
    among = ", ".join(f"{h}L" for h in hashes) or "NULL"
    found = [f"transform(filter(CASE WHEN size(w) >= {k} THEN sequence(0, size(w) - {k}) ELSE cast(array() AS array<int>) END, i -> {_hash(k)} IN ({among})), i -> named_struct('p', i, 'h', {_hash(k)}))" for k in sizes]
    every = f"concat({', '.join(found)})" if found else "cast(array() AS array<struct<p:int,h:bigint>>)"
    around = f"slice(words, greatest(m.p - {window - 1}, 0) + 1, {2 * window})"
    return (
        docs.withColumn("n_words", F.size("words"))
        .withColumn("found", F.expr(f"transform(array(transform(words, x -> lower(x))), w -> {every})[0]"))
        .withColumn("matches", F.expr(f"transform(found, m -> named_struct('p', m.p, 'h', m.h, 'first', greatest(m.p - {window - 1}, 0), 'around', {around}))"))
        .drop("words", "found")
    )


def _matches_by_join(docs: DataFrame, sizes: list[int], shingles: DataFrame, window: int) -> DataFrame:
    """The same for a benchmark too large to send along: every shingle of the documents meets the benchmark's in a join."""
    rows = checkpoint(docs.withColumn("n_words", F.size("words"))).withColumn("_r", F.monotonically_increasing_id())
    found = [f"transform(CASE WHEN size(w) >= {k} THEN sequence(0, size(w) - {k}) ELSE cast(array() AS array<int>) END, i -> named_struct('p', i, 'h', {_hash(k)}))" for k in sizes]
    every = rows.selectExpr("_r", f"inline(transform(array(transform(words, x -> lower(x))), w -> concat({', '.join(found)}))[0])")
    met = every.join(shingles.select("h").distinct(), "h", "left_semi").groupBy("_r").agg(F.collect_list(F.struct("p", "h")).alias("found"))
    around = f"slice(words, greatest(m.p - {window - 1}, 0) + 1, {2 * window})"
    whole = rows.join(met, "_r", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() AS array<struct<p:int,h:bigint>>)")))
    return whole.withColumn("matches", F.expr(f"transform(found, m -> named_struct('p', m.p, 'h', m.h, 'first', greatest(m.p - {window - 1}, 0), 'around', {around}))")).drop("words", "found", "_r")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    share: int = 20,
    most_literals: int = MOST_LITERALS,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """For every row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window; a row is contaminated if ``share * n_hit >= n_words`` and
    n_hit > 0. Null and empty texts have no words and no hits; items without words have no windows; ids that are null count as
    an item with an empty name. Repeated rows each get a result. Items that share a window all count. Very long texts are judged whole, in their row; an
    empty table gives none, and against an empty benchmark nothing is hit; other columns are not read.
    """
    wins = checkpoint(windows_of(benchmark, item_col, item_text_col, window))
    shingles = checkpoint(shingles_of(wins, shingle))
    source = docs.select(F.col(id_col).alias("_id"), words_of(text_col).alias("words"))
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())
    some = shingles.select("h").distinct().limit(most_literals + 1).collect()
    found = _matches(source, sizes, [r["h"] for r in some], window) if len(some) <= most_literals else _matches_by_join(source, sizes, shingles, window)
    rows = checkpoint(found).withColumn("_r", F.monotonically_increasing_id())

    each = rows.select("_r", "n_words", F.explode("matches").alias("m")).select("_r", "n_words", "m.*")
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rare = (
        shingles.join(counts, "h", "left")
        .groupBy("win", "len")
        .agg(F.min(F.struct("n", "off", "h", "size")).alias("rarest"), F.count_if(F.col("n").isNull()).alias("absent"))
        .where("absent = 0")
        .select("win", "len", "rarest.off", "rarest.h")
        .join(wins.select("win", "items"), "win")
    )
    rare = checkpoint(rare)
    small = rare.limit(most_broadcast + 1).count() <= most_broadcast
    at = each.join(F.broadcast(rare) if small else rare, "h").withColumn("start", F.col("p") - F.col("off"))
    held = at.where("start >= 0 and start + len <= n_words")
    held = held.where(F.translate(F.expr("array_join(slice(around, start - first + 1, len), ' ')"), UPPER, LOWER) == F.col("win"))
    hits = held.groupBy("_r").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr("aggregate(array_sort(spans), named_struct('n', 0L, 'e', 0), (a, s) -> named_struct('n', a.n + greatest(s.end - greatest(s.start, a.e), 0), 'e', greatest(a.e, s.end)), a -> a.n)")
    of_row = hits.select("_r", covered.alias("hit"), "items")
    out = rows.drop("matches").join(of_row, "_r", "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast(T.LongType())
    items = F.coalesce("items", F.expr("cast(array() AS array<string>)"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, whole, whose text is not contaminated; equal texts share their verdict.

    Null and empty texts stay, repeated rows stay or go together, very long texts are judged whole, an empty table or an empty
    benchmark changes nothing, and other columns, whatever their names, are as they were.
    """
    (name,) = fresh(docs, "digest")
    digest = F.md5(F.coalesce(text_col, F.lit("")))
    texts = docs.select(digest.alias("digest"), F.col(text_col).alias("text"))
    bad = contamination(texts, benchmark, "digest", "text", **options).where("contaminated").select(F.col("digest").alias(name)).distinct()
    return docs.withColumn(name, digest).join(bad, name, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
