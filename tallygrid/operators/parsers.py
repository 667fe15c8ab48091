"""Row parsers that read lines by position, as windows and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions import classify, fixed
from tallygrid.operators.segment import compact

CODE = r"^[A-Z]{1,4}-[0-9]+[A-Z]?$"
CODE_V2 = "^(?:" + "|".join(fixed.FINISH_CODES_V2) + ")-[0-9]+$"
ROOM = r"(?i)^(?:[0-9]{2,}|[0-9]+[A-Z]|[A-Z]-[0-9]+|SUITE\s+[0-9]+)$"
ROOM_V2 = r"^[0-9]{3}$"
ROOM_FIELDS = (
    "room_number", "room_name", "floor", "floor_grout", "base", "chair_rail", "walls_primary", "walls_accent", "ceiling_material", "ceiling_finish", "ceiling_height",
    "millwork_wall_cabinets", "millwork_base_cabinets", "millwork_countertop",
)


def from_header(text: Column, headers: Sequence[str], until: str | None = None) -> Column:
    """A text from the first header (in their order) that it has, up to ``until`` if that comes later; null without a header."""
    at = F.lit(0)
    for h in reversed(headers):
        at = F.when(F.instr(text, h) > 0, F.instr(text, h)).otherwise(at)
    rest = F.substring(text, at, F.length(text))
    if until:
        rest = F.when(F.instr(rest, until) > 0, F.substring(rest, F.lit(1), F.instr(rest, until) - 1)).otherwise(rest)
    return F.when(at > 0, rest)


def look_back(lines: DataFrame, keys: Sequence[str], pattern: str, depth: int, pos: str = "pos", line: str = "line") -> DataFrame:
    """Lines that match, with the ``depth`` lines before each as back1, back2, ..."""
    w = Window.partitionBy(*keys).orderBy(pos)
    return lines.withColumns({f"back{k}": F.lag(line, k).over(w) for k in range(1, depth + 1)}).where(F.col(line).rlike(pattern))


def finish_legend(pages: DataFrame, keys: Sequence[str], text_col: str = "text", v2: bool = False) -> DataFrame:
    """``keys``, pos, code, material, manufacturer, product, color, type_size: legend rows, the first of each code on a page.

    The lines before a code are, going back: material, maker, product, pattern, type, color. Paint has a product of its own.
    """
    headers = dict(fixed.PAGE_TYPES)["finish_legend"] if v2 else ("INTERIOR FINISH LEGEND",)
    part = pages.select(*keys, F.posexplode(compact(from_header(F.col(text_col), headers, "ROOM FINISH SCHEDULE"))).alias("pos", "line"))
    rows = look_back(part, keys, CODE_V2 if v2 else CODE, 6)
    kind, blank = F.upper(F.coalesce("back1", F.lit(""))), F.lit("")
    paint, ceiling = F.contains(kind, F.lit("PAINT")), classify.any_of(kind, ("CEILING", "GYPSUM"))
    rows = rows.select(
        *keys,
        "pos",
        F.col("line").alias("code"),
        F.when(paint, "Paint").otherwise(F.coalesce("back1", blank)).alias("material"),
        F.coalesce("back2", blank).alias("manufacturer"),
        F.when(paint, "Interior Paint").otherwise(F.coalesce("back3", blank)).alias("product"),
        F.coalesce("back6", F.when(ceiling & ~paint, "White").otherwise("")).alias("color"),
        F.coalesce("back5", blank).alias("type_size"),
    )
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "code").orderBy("pos"))).where("_n = 1").drop("_n")


def room_records(lines: Column, start: str, note_stops: Sequence[str]) -> Column:
    """``array<struct<at, notes>>``: where records of 14 lines start, each with the line after as notes unless it matches ``note_stops``.

    A fold that carries the next free line: lines inside a record are never starts. A record that is cut off by the end is left out.
    """
    n = F.size(lines)
    begin = F.struct(F.lit(0).alias("free"), F.expr("cast(array() AS array<struct<at:int,notes:string>>)").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        fits = (i >= acc["free"]) & F.get(lines, i).rlike(start) & (i + 14 <= n)
        after = F.get(lines, i + 14)
        stop = after.isNull()
        for p in note_stops:
            stop = stop | after.rlike(p)
        rec = F.struct(i.cast("int").alias("at"), F.when(stop, "").otherwise(after).alias("notes"))
        return F.when(fits, F.struct(F.when(stop, i + 14).otherwise(i + 15).cast("int").alias("free"), F.concat(acc["out"], F.array(rec)).alias("out"))).otherwise(acc)

    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() AS array<int>)"))
    return F.aggregate(every, begin, step, lambda acc: acc["out"])


def room_schedule(pages: DataFrame, keys: Sequence[str], text_col: str = "text", v2: bool = False) -> DataFrame:
    """``keys``, pos, the 14 fields of a room, notes."""
    headers = dict(fixed.PAGE_TYPES)["room_schedule"] if v2 else ("ROOM FINISH SCHEDULE",)
    cut = pages.select(*keys, compact(from_header(F.col(text_col), headers)).alias("_l")).where("_l is not null")
    stops = (ROOM_V2,) if v2 else (r"^[0-9]{3}$", r"^[0-9]+\.\s")
    rows = cut.select(*keys, "_l", F.explode(room_records(F.col("_l"), ROOM_V2 if v2 else ROOM, stops)).alias("r"))
    return rows.select(*keys, F.col("r.at").alias("pos"), *(F.get("_l", F.col("r.at") + k).alias(f) for k, f in enumerate(ROOM_FIELDS)), F.col("r.notes").alias("notes"))


def frames(lines: DataFrame, keys: Sequence[str], before: int, after: int, pos: str = "pos", line: str = "line", name: str = "context") -> DataFrame:
    """Each line with the lines around it, joined."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-before, after)
    return lines.withColumn(name, F.array_join(F.collect_list(line).over(w), "\n"))


def islands(lines: DataFrame, keys: Sequence[str], head: Column, pos: str = "pos", name: str = "island") -> DataFrame:
    """Each line with the number of its island: heads so far, 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.sum(head.cast("int")).over(w).cast("long"))


def carried(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """Each row with the last value that was not null, its own included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def equipment(pages: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """``keys``, pos, tag, equipment_type, manufacturer, model: two passes over schedule sections.

    The first learns prefixes that stand among two or more strong words; if a page has none, the usual ones hold. The second takes each tag
    with such a prefix and one equipment word near it, once.
    """
    from collections.abc import Iterator

    import pandas as pd

    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*key, i, *row) for *key, text in pdf.itertuples(index=False) for i, row in enumerate(equipment_rows(text or ""))]
            yield pd.DataFrame(out, columns=[*keys, "pos", "tag", "equipment_type", "manufacturer", "model"])

    # only pages with a heading reach Python
    gated = pages.where(classify.any_of(F.upper(text_col), fixed.EQUIPMENT_HEADERS))
    return gated.select(*keys, text_col).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", pos int, tag string, equipment_type string, manufacturer string, model string")


def equipment_rows(text: str) -> list[tuple[str, str, str, str]]:
    import re

    sections = []
    for h in fixed.EQUIPMENT_HEADERS:
        if (found := re.search(re.escape(h), text, re.IGNORECASE)) is not None:
            at = found.start()
            stop = re.search(fixed.NEXT_HEADING, text[at + 100 : at + 5000], re.IGNORECASE)
            sections.append(text[at : at + 100 + stop.start() if stop else at + 5000])
    found = [(m[1], m[1].split("-")[0], m.start(), m.end(), s) for s in sections for m in re.finditer(r"\b([A-Z]{1,4}-\d+[A-Z]?)\b", s)]
    near = lambda x, a, b: x[4][max(0, x[2] - a) : x[3] + b]
    learned = {x[1] for x in found if x[1] not in fixed.DRAWING_PREFIXES and sum(w in near(x, 200, 400).upper() for w in fixed.STRONG_EQUIPMENT_WORDS) >= 2}
    prefixes, out = learned or set(fixed.DEFAULT_EQUIPMENT_PREFIXES), {}
    for x in found:
        context = near(x, 150, 300)
        if x[0] not in out and x[1] in prefixes and any(w in context.upper() for w in fixed.EQUIPMENT_WORDS):
            model = re.search(r"(?:MODEL|Model)\s+([A-Z0-9\-/]+)", context)
            brand = next((b.title() for b in fixed.CONTEXT_BRANDS if b in context.upper()), "Local Source")
            out[x[0]] = (x[0], fixed.EQUIPMENT_TYPES.get(x[1], f"{x[1]} Equipment"), brand, model[1] if model else "")
    return list(out.values())


def equipment_rows_v2(text: str) -> list[tuple[str, str, str, str, str]]:
    """(tag, type, maker, model, size): every known tag once; supply and return tags need diffuser words near them."""
    import re

    out = {}
    for m in re.finditer(fixed.EQUIPMENT_TAGS_V2, text):
        tag, context = m[1], text[max(0, m.start() - 100) : m.end() + 300]
        upper = context.upper()
        if tag in out or (tag[:2] in ("S-", "R-") and not any(w in upper for w in fixed.DIFFUSER_WORDS)):
            continue
        model = re.search(r"(?:MODEL|Model)\s+([A-Z0-9\-/]+)", context)
        named = "" if not model or model[1].upper() in fixed.NO_MODELS else model[1]
        flow = re.search(r"(\d{2,4})\s*CFM", context) if "VAV" in tag else None
        plain = {"S-": "Supply Diffuser", "R-": "Return Diffuser"}.get(tag[:2], "UV Air Purifier")
        kind = next((n for p, n in fixed.EQUIPMENT_TYPES_V2 if p in tag), plain)
        out[tag] = (tag, kind, next((b.title() for b in fixed.CONTEXT_BRANDS if b in upper), "Local Source"), named, f"{flow[1]} CFM" if flow else "")
    return list(out.values())
