"""Boilerplate lines by site-relative frequency, in DataFrame operations only.

Pages are grouped by host. A line's frequency is the share of the host's pages that have it; lines above a ratio are
boilerplate and go from every page of that host. Copies of a page count as one page, so that a page that is there often is no
boilerplate of itself. A line of over fifty words is no phrase that pages happen to share, so its ratio is much lower.

Lines are counted by a hash of 128 bits. Copies are told by a hash of the page's text: (line, page) rows are made distinct, which spreads
a common line over its pages, and then summed before they are shuffled, so neither a common line nor a large host gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import checkpoint, fresh

#: A line is boilerplate on more than this share of its host's pages, and on this many pages at least.
RATIO, LEAST_PAGES = 0.01, 3
#: The same for lines of more words than this.
LONG_WORDS, LONG_RATIO, LONG_LEAST_PAGES = 50, 0.0002, 2
#: Boilerplate lines that are broadcast; beyond, they are joined by shuffling.
MOST_BROADCAST = 200_000

_KEY = "named_struct('a', xxhash64(x), 'b', xxhash64(10, x))"


def _keys(text: str, long_words: int) -> str:
    """SQL: the keys of the distinct lines of a text that are not blank, and whether a line is long."""
    long = f"length(x) > {2 * long_words} AND regexp_count(x, '[^\\\\x20\\\\x09-\\\\x0D]+') > {long_words}"
    return f"transform(array_distinct(filter(split({text}, '\\n', -1), x -> trim(x) <> '')), x -> named_struct('a', xxhash64(x), 'b', xxhash64(10, x), 'long', {long}))"


def boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    long_words: int = LONG_WORDS,
    long_ratio: float = LONG_RATIO,
    long_least_pages: int = LONG_LEAST_PAGES,
) -> DataFrame:
    """``(host, k, pages, total)``: the boilerplate lines of each host, by key. A null host is one host, the empty name; null texts are no pages."""
    base = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("page")).where("t IS NOT NULL")
    lines = base.selectExpr("host", "page", f"inline({_keys('t', long_words)})")
    pages = lines.groupBy("host", "a", "b", "long").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= F.when(F.col("long"), long_least_pages).otherwise(least_pages))
    totals = base.groupBy("host").agg(F.count_distinct("page").alias("total"))
    over = F.col("pages") > F.when(F.col("long"), F.lit(float(long_ratio))).otherwise(F.lit(float(ratio))) * F.col("total")
    return pages.join(totals, "host").where(over).select("host", F.struct("a", "b").alias("k"), "pages", "total")


def _by_host(found: DataFrame) -> DataFrame:
    """``(host, cut)``: each host's keys dealt over an array of buckets of eight or so, so that a line is looked up in one bucket."""
    size = found.groupBy("host").agg((F.floor(F.count(F.lit(1)) / 8) + 1).cast("int").alias("size"))
    keyed = found.join(size, "host").select("host", F.expr("pmod(k.a, size)").cast("int").alias("bucket"), "k")
    every = size.select("host", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("bucket"), F.lit(None).cast(found.schema["k"].dataType).alias("k"))
    buckets = keyed.unionByName(every).groupBy("host", "bucket").agg(F.collect_set("k").alias("keys"))
    return buckets.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "keys"))), lambda x: x["keys"]).alias("cut"))


def drop_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    long_words: int = LONG_WORDS,
    long_ratio: float = LONG_RATIO,
    long_least_pages: int = LONG_LEAST_PAGES,
    most_broadcast: int = MOST_BROADCAST,
    counts: bool = True,
) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and, if ``counts``, ``n_lines`` and ``n_dropped``.

    Every row stays, a page that was boilerplate only with an empty text. Blank lines are never counted or cut. A null
    text stays null, with no lines; an empty one has one line. Repeated rows and other pages of one text count as one page. Very long texts are
    cut in their row. An empty table gives none. If ``docs`` has columns named like the two new ones, the new replace them; others stay.
    """
    found = checkpoint(boilerplate(docs, host_col, text_col, ratio, least_pages, long_words, long_ratio, long_least_pages))
    host_, cut_, lines_, kept_, row_ = fresh(docs, "host_", "cut_", "lines_", "kept_", "row_")
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    none = "cast(array() AS array<array<struct<a:bigint,b:bigint>>>)"
    if found.limit(most_broadcast + 1).count() <= most_broadcast:
        of_host = _by_host(found).toDF(host_, cut_)
        marked = docs.join(F.broadcast(of_host), host == F.col(host_), "left").drop(host_)
    else:
        rows = checkpoint(docs).withColumn(row_, F.monotonically_increasing_id())
        keyed = rows.select(F.col(row_).alias("row"), host.alias("host"), F.explode(F.expr(_keys(f"`{text_col}`", long_words))).alias("k")).select("row", "host", F.expr("named_struct('a', k.a, 'b', k.b)").alias("k"))
        met = keyed.join(found.select("host", "k"), ["host", "k"], "left_semi").groupBy("row").agg(F.array(F.collect_set("k")).alias(cut_)).withColumnRenamed("row", row_)
        marked = rows.join(met, row_, "left").drop(row_)
    marked = marked.withColumn(cut_, F.coalesce(cut_, F.expr(none))).withColumn(lines_, F.split(F.col(text_col), "\n", -1))
    cut = f"filter({lines_}, x -> trim(x) = '' OR NOT array_contains({cut_}[pmod(xxhash64(x), size({cut_}))], {_KEY}))"
    marked = marked.withColumn(kept_, F.expr(f"CASE WHEN size({cut_}) = 0 THEN {lines_} ELSE {cut} END"))
    out = marked.withColumn(text_col, F.when(F.size(cut_) == 0, F.col(text_col)).otherwise(F.array_join(kept_, "\n")))
    if counts:
        out = out.withColumn("n_lines", F.coalesce(F.size(lines_), F.lit(0)).cast("long"))
        out = out.withColumn("n_dropped", F.coalesce(F.size(lines_) - F.size(kept_), F.lit(0)).cast("long"))
    return out.drop(cut_, lines_, kept_)
