"""Text and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.functions import fixed


def combined_text(text: Column, ocr_text: Column, scanned: Column) -> Column:
    """A page's text: its own, with recognised text on a new line where it was scanned."""
    return F.when(scanned, F.concat_ws("\n", F.nullif(text, F.lit("")), F.nullif(ocr_text, F.lit("")))).otherwise(text)


def needs_ocr(scanned: Column, kind: Column, enabled: bool = True, drawings_only: bool = False) -> Column:
    return scanned & F.lit(enabled) & (F.lit(not drawings_only) | (kind == "drawing"))


def clean_height(height: Column) -> Column:
    """A ceiling height without its tolerance, with the mark of inches after feet."""
    bare = F.trim(F.regexp_replace(F.trim(F.replace(F.trim(height), F.lit("+/-"), F.lit(""))), r"[+-]+$", ""))
    return F.when(F.contains(bare, F.lit("'")) & ~F.endswith(bare, F.lit('"')), F.concat(bare, F.lit('"'))).otherwise(bare)


def spelled(text: Column) -> Column:
    """Lower case with the usual spellings."""
    out = F.lower(text)
    for a, b in fixed.SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def significant_words(text: Column) -> Column:
    """The distinct words of four letters or more, in order, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{4,}\b"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*(F.lit(w) for w in fixed.STOP_WORDS)))


def quantities(text: Column, patterns=fixed.UNIT_PATTERNS) -> Column:
    """``array<struct<quantity, unit>>`` of the positive quantities with units in a text, unit by unit."""

    def found(pattern: str, unit: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1)), lambda x: F.struct(x.alias("raw"), F.lit(unit).alias("unit")))

    every = F.concat(*(found(p, u) for p, u in patterns))
    parsed = F.transform(every, lambda x: F.struct(F.replace(F.replace(x["raw"], F.lit(","), F.lit("")), F.lit(" "), F.lit("")).try_cast("double").alias("quantity"), x["unit"].alias("unit")))
    return F.filter(parsed, lambda x: x["quantity"] > 0)


def window_of(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The characters around a match at [start, end)."""
    first = F.greatest(F.lit(0), start - before)
    return F.substring(text, first + 1, F.least(end + after, F.length(text)) - first)


def section(text: Column, header: str, next_headers: tuple[str, ...] = (), most: int | None = None) -> Column:
    """From a header to the first of the next ones, or ``most`` characters, or the end; null without the header."""
    at = F.instr(text, header)
    rest = F.substring(text, at + 1, F.length(text))
    ends = [F.nullif(F.instr(rest, h), F.lit(0)) for h in next_headers] + ([F.lit(most)] if most else [])
    length = F.coalesce(F.least(*ends, F.length(text)) if ends else F.length(text), F.length(text))
    return F.when(at > 0, F.substring(text, at, length))


def cost_score(size_mb: Column, scanned: Column, load_ratio: Column) -> Column:
    """Struct of the recognition seconds and the cost score (0 to 100) of a file."""
    seconds = scanned * 3.0 * F.greatest(F.lit(1.0), load_ratio)
    score = F.least(F.lit(20.0), size_mb / 5 * 20) + F.least(F.lit(40.0), scanned / 20 * 40) + F.least(F.lit(40.0), seconds / 120 * 40)
    return F.struct(F.round(seconds, 1).alias("seconds"), F.round(score, 1).alias("score"))


def skip_reason(duplicate: Column, pressure: Column, scanned: Column, size_mb: Column, seconds: Column, score: Column) -> Column:
    """Why a file is left out, or null; the first rule that holds."""
    return (
        F.when(duplicate, "duplicate")
        .when((pressure == "critical") & (scanned > 0), "critical pressure")
        .when((pressure == "high") & (score > 50), "high pressure")
        .when((pressure == "moderate") & (score > 70), "moderate pressure")
        .when(seconds > 300, "too heavy")
        .when((size_mb > 5) & (scanned > 20), "very large scan")
    )


def percent_difference(predicted: Column, expected: Column) -> Column:
    """Percent by which a prediction is off, to two places; null without both, or if nothing was expected."""
    return F.when(predicted.isNotNull() & (expected > 0), F.round((predicted - expected) / expected * 100, 2))


def project_id(path: Column, generic: tuple[str, ...] = ("project files", "files", "documents", "drawings", "specs")) -> Column:
    """The first word of a folder's name, of its parent's where the folder has a generic name."""
    parts = F.filter(F.split(path, "[/\\\\]"), lambda x: x != "")
    last, parent = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    name = F.when(F.lower(last).isin(*generic), F.coalesce(parent, last)).otherwise(last)
    return F.substring_index(F.trim(name), " ", 1)
