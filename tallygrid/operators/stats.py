"""Statistics of pages, files, items and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions import classify, text


def ocr_stats(pages: DataFrame, keys: Sequence[str] = (), file_col: str = "file_id") -> DataFrame:
    """Files, pages, scanned and recognised pages, ratios to 4 places, confidences to 2; ratios 0 and confidences null without pages."""
    over = lambda n, d: F.round(F.coalesce(n / F.nullif(d, F.lit(0)), F.lit(0.0)), 4)
    used, n = F.count_if("ocr_used"), F.count(F.lit(1))
    conf = F.when(F.col("ocr_used"), F.col("ocr_confidence"))
    return pages.groupBy(*keys).agg(
        F.count_distinct(file_col).alias("files"), F.count_distinct(F.when(F.col("ocr_used"), F.col(file_col))).alias("files_with_ocr"), n.alias("pages"), F.count_if("is_scanned").alias("scanned_pages"), used.alias("ocr_pages"),
        over(F.count_if("is_scanned"), n).alias("scanned_ratio"), over(used, n).alias("ocr_ratio"), F.round(F.avg(conf), 2).alias("avg_confidence"), F.round(F.min(conf), 2).alias("min_confidence"), F.round(F.max(conf), 2).alias("max_confidence"),
    )


def page_counts(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total, scanned and text pages of each file."""
    scanned = F.count_if(classify.is_scanned(F.coalesce("text", F.lit(""))))
    return pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_pages"), scanned.alias("scanned_pages"), (F.count(F.lit(1)) - scanned).alias("text_pages"))


def region_stats(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    c = F.col("ocr_confidence")
    return regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(c >= 60).alias("good"), F.count_if((c > 0) & (c < 60)).alias("weak"), F.count_if("second_source").alias("second_source"))


def trade_scope(items: DataFrame, keys: Sequence[str], trade: str = "trade") -> DataFrame:
    """The sorted distinct trades of each key, joined with bars."""
    return items.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col(trade) != "", F.col(trade)))), " | ").alias("trade_scope"))


def confidence_histogram(items: DataFrame, keys: Sequence[str], confidence: str = "confidence") -> DataFrame:
    """``keys``, bins: how many items have each confidence."""
    return items.groupBy(*keys, F.col(confidence).cast("string").alias("_c")).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_c", "n")))).alias("bins"))


def file_costs(files: DataFrame, load_ratio: float = 1.0, free_mb: float = 8192.0) -> DataFrame:
    """Files (size_mb, scanned_pages, duplicate) with seconds, score, pressure and the reason to leave them out, if any."""
    cost = text.cost_score(F.col("size_mb"), F.col("scanned_pages"), F.lit(load_ratio))
    out = files.withColumn("_c", cost).withColumn("seconds", F.col("_c.seconds")).withColumn("cost_score", F.col("_c.score")).drop("_c")
    out = out.withColumn("pressure", classify.pressure(F.lit(load_ratio), F.lit(free_mb)))
    return out.withColumn("skip_reason", text.skip_reason(F.col("duplicate"), F.col("pressure"), F.col("scanned_pages"), F.col("size_mb"), F.col("seconds"), F.col("cost_score")))


def skip_summary(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return files.groupBy(*keys).agg(F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"), F.count_if(F.col("skip_reason").isNull()).alias("processed"))


def rates(matched: str, missing: str, extra: str):
    """(accuracy, match rate, precision) columns, to 4 places; 0 where there is nothing."""
    share = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0)), 4)
    return share(matched, missing).alias("accuracy"), F.round(share(matched, missing) * 100, 1).alias("match_rate"), share(matched, extra).alias("precision")


def items_per_file(files: DataFrame, items: DataFrame) -> DataFrame:
    """Every file with the number of items that name it as their source."""
    n = items.groupBy(F.col("source_reference").alias("file_name")).agg(F.count(F.lit(1)).alias("_n"))
    return files.join(n, "file_name", "left").withColumn("n_items", F.coalesce("_n", F.lit(0))).drop("_n")


def dashboard(projects: DataFrame) -> DataFrame:
    """Projects in all, with output, with an evaluation, by type."""
    return projects.agg(F.count(F.lit(1)).alias("projects"), F.count_if("has_output").alias("with_output"), F.count_if("has_evaluation").alias("with_evaluation"), F.count_if(F.col("type") == "sample").alias("samples"), F.count_if(F.col("type") == "challenge").alias("challenges"))


def keyword_pages(pages: DataFrame, page: str, keywords: Sequence[str], most: int = 10, text_col: str = "text") -> DataFrame:
    """``keyword``, pages, n: how many pages contain each keyword, in any case, and the first ``most`` of them.

    A page is counted once a keyword. Ranks are bounded before rows are shuffled, so a common keyword does not gather all of its pages.
    """
    hits = F.array_compact(F.array(*(F.when(F.contains(F.lower(text_col), F.lit(w.lower())), w) for w in keywords)))
    each = pages.select(F.col(page).alias("page"), F.explode(hits).alias("keyword"))
    first = each.withColumn("at", F.row_number().over(Window.partitionBy("keyword").orderBy("page"))).where(F.col("at") <= most)
    listed = first.groupBy("keyword").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    return each.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).join(listed, "keyword").select("keyword", "pages", "n")


def category_report(items: DataFrame, keys: Sequence[str], groups: Sequence[tuple[str, Sequence[str]]], order: Sequence[str], most: int = 5, text_col: str = "description") -> DataFrame:
    """``keys``, category, n, first: for each named group of keywords, how many items contain one of them, and the first ``most`` of these in ``order``."""
    hits = F.array_compact(F.array(*(F.when(classify.any_of(F.lower(text_col), [w.lower() for w in words]), name) for name, words in groups)))
    each = items.select(*keys, *order, F.col(text_col).alias("said"), F.explode(hits).alias("category"))
    first = each.withColumn("at", F.row_number().over(Window.partitionBy(*keys, "category").orderBy(*order))).where(F.col("at") <= most)
    listed = first.groupBy(*keys, "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]).alias("first"))
    return each.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n")).join(listed, [*keys, "category"])


def of_trade(items: DataFrame, trade: str | None = None) -> DataFrame:
    """The items of one trade; all of them without one."""
    return items.where(F.col("trade") == trade) if trade and trade != "all" else items


def stamped(rows: DataFrame, name: str = "created_at") -> DataFrame:
    """Rows with the time of the query."""
    return rows.withColumn(name, F.current_timestamp())
