"""Prompt texts for a plugged-in extractor, built as columns and with bounded parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of content, and rows of legend, rooms and equipment in a prompt.
CONTENT, ROWS = 30_000, {"legend": 40, "rooms": 25, "equipment": 10}


def page_prompt(project: Column, file_name: Column, kind: Column, content: Column, most: int = CONTENT) -> Column:
    """A prompt for one page or chunk, its content cut."""
    return F.concat(
        F.lit("List every construction item as JSON {\"items\": [{description, trade, quantity, unit, confidence, source_reference}]}.\n\nPROJECT: "), project,
        F.lit("\nFILE: "), file_name, F.lit("\nFILE TYPE: "), kind, F.lit("\n\nCONTENT:\n"), F.substring(content, 1, most),
    )


def context_lines(rows: DataFrame, line: Column, order: list[str], most: int, key: str = "project_id") -> DataFrame:
    """``key`` and ``lines``: the first ``most`` rows of each project as indented lines."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    top = rows.select(key, n.alias("_n"), line.alias("_line")).where(F.col("_n") <= most)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: F.concat(F.lit("  "), x["_line"])), "\n").alias("lines"))


def context_prompt(legend: Column, rooms: Column, equipment: Column, chunk: Column) -> Column:
    """The context's lines under their headings, those that there are, and then the content."""
    part = lambda title, c: F.when(F.length(c) > 0, F.concat(F.lit(title + "\n"), c))
    return F.concat_ws(
        "\n", part("INTERIOR FINISH LEGEND (use these exact codes and products):", legend), part("\nROOM FINISH SCHEDULE:", rooms), part("\nEQUIPMENT SCHEDULE:", equipment),
        F.concat(F.lit("\n--- EXTRACTION CONTENT ---\n"), chunk),
    )


def legend_line() -> Column:
    return F.format_string("%s: %s %s, Color: %s, Type: %s", "code", "manufacturer", "product", "color", "type_size")
