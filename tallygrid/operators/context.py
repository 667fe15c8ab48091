"""Joins and grouped counts over legends, rooms and equipment. All are keyed by project, so all projects run in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import classify, text
from tallygrid.operators import substrings
from tallygrid.session import shuffled

CODE_COLUMNS = ("floor", "base", "walls_primary", "walls_accent", "ceiling_finish")


def codes(col: str) -> Column:
    """The codes of a room field, split at slashes."""
    return F.transform(F.split(col, "/"), lambda x: F.trim(x))


def used_codes(rooms: DataFrame, keys: Sequence[str], columns: Sequence[str] = CODE_COLUMNS) -> DataFrame:
    """``keys``, code: the distinct codes that rooms use; a dash is none."""
    every = F.flatten(F.array(*(F.when(F.col(c) != "-", codes(c)).otherwise(F.expr("cast(array() AS array<string>)")) for c in columns)))
    return rooms.select(*keys, F.explode(F.array_distinct(every)).alias("code")).where("code <> ''").distinct()


def used_only(legend: DataFrame, rooms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Legend rows whose code a room of the same project uses."""
    return legend.join(shuffled(used_codes(rooms, keys)), [*keys, "code"], "left_semi")


def last_of_code(legend: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a code, the last: what a lookup by code sees."""
    row = F.struct(F.struct(*order).alias("o"), F.struct(*legend.columns).alias("row"))
    return legend.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col("code").alias("_code")).agg(F.max(row).alias("m")).select("m.row.*")


def legend_items(legend: DataFrame, rooms: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Items of used codes whose trade is known."""
    said = F.concat(
        F.col("code"), F.lit(": "), F.col("manufacturer"), F.lit(" "), F.col("product"),
        F.when(F.col("color") != "", F.concat(F.lit(", Color: "), "color")).otherwise(""), F.when(F.col("type_size") != "", F.concat(F.lit(", Type: "), "type_size")).otherwise(""),
    )
    got = used_only(legend, rooms, keys).select(*keys, *order, said.alias("description"), classify.trade_of_code(F.col("code"), F.col("material")).alias("trade"))
    return got.where("trade <> 'Other'").select("*", F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("string").alias("unit"), F.lit(0.85).alias("confidence"), F.lit("Finish Legend").alias("source_reference"))


def walls_by_height(rooms: DataFrame, keys: Sequence[str], prefix: str = "PNT") -> DataFrame:
    """``keys``, code, height, n: wall codes of a prefix over both wall fields, for rooms with a height."""
    field = lambda c: F.when(F.col(c) != "-", codes(c)).otherwise(F.expr("cast(array() AS array<string>)"))
    each = rooms.where("ceiling_height <> ''").select(*keys, F.col("ceiling_height").alias("height"), F.explode(F.concat(field("walls_primary"), field("walls_accent"))).alias("code"))
    return each.where(F.startswith("code", F.lit(prefix))).groupBy(*keys, "code", "height").agg(F.count(F.lit(1)).alias("n"))


def ceilings(rooms: DataFrame, keys: Sequence[str], prefix: str = "CL") -> DataFrame:
    """``keys``, code, n: ceiling codes of a prefix."""
    each = rooms.where("ceiling_finish not in ('', '-')").select(*keys, F.explode(codes("ceiling_finish")).alias("code"))
    return each.where(F.startswith("code", F.lit(prefix))).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))


def room_items(rooms: DataFrame, legend: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Wall and ceiling items of rooms, with the details of the legend where it has the code."""
    details = last_of_code(legend, keys, order).select(*keys, "code", "material", "manufacturer", "color", "type_size")
    lines = F.concat(F.lit("\n-Mfg: "), "manufacturer", F.when(F.col("color") != "", F.concat(F.lit("\n-Color: "), "color")).otherwise(""), F.when(F.col("type_size") != "", F.concat(F.lit("\n-Type: "), "type_size")).otherwise(""))
    known = F.coalesce(F.col("manufacturer"), F.lit("")) != ""
    walls = walls_by_height(rooms, keys).join(shuffled(details), [*keys, "code"], "left")
    high = F.concat(F.lit(" ("), "height", F.lit(" High)"))
    walls = walls.select(*keys, F.when(known, F.concat("code", high, F.lit(":"), lines)).otherwise(F.concat(F.lit("Wall Finish: "), "code", high)).alias("description"), F.lit("Painting").alias("trade"), "n")
    tops = ceilings(rooms, keys).join(shuffled(details), [*keys, "code"], "left")
    tops = tops.select(*keys, F.when(known, F.concat("code", F.lit(" ("), "material", F.lit("):"), lines)).otherwise(F.concat(F.lit("Ceiling Finish: "), "code")).alias("description"), F.lit("Ceilings").alias("trade"), "n")
    return walls.unionByName(tops).select(*keys, "description", "trade", F.col("n").cast("double").alias("quantity"), F.lit("RM").alias("unit"), F.lit(0.75).alias("confidence"), F.lit("Room Schedule").alias("source_reference"))


def heights(col: str) -> Column:
    """The cleaned heights of a field, split at slashes."""
    return F.filter(F.transform(F.split(col, "/"), text.clean_height), lambda x: x != "")


def fusion_groups(rooms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, part, code, height, n, rooms: floors and bases by code, walls and ceilings by code and height; existing finishes aside."""
    plain = lambda c: F.filter(codes(c), lambda x: (x != "") & ~F.startswith(x, F.lit("EXIST")))
    part = lambda name, col, by_height: rooms.select(*keys, "room_name", F.lit(name).alias("part"), F.explode(plain(col)).alias("code"), (heights("ceiling_height") if by_height else F.array(F.lit(""))).alias("_h"))
    parts = part("floor", "floor", False).unionByName(part("base", "base", False)).unionByName(part("wall", "walls_primary", True))
    parts = parts.unionByName(part("wall", "walls_accent", True).where("code <> '-'")).unionByName(part("ceiling", "ceiling_finish", True))
    each = parts.select(*keys, "room_name", "part", "code", F.explode("_h").alias("height"))
    return each.groupBy(*keys, "part", "code", "height").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("room_name")).alias("rooms"))


def fusion_items(rooms: DataFrame, legend: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Items of the groups whose code the legend has."""
    details = last_of_code(legend, keys, order).select(*keys, "code", "material", "manufacturer", "product", "color", "type_size")
    got = fusion_groups(rooms, keys).join(shuffled(details), [*keys, "code"])
    maker, color = F.trim(F.replace("manufacturer", F.lit("-"), F.lit(" "))), F.trim("color")
    color = F.when(F.contains(color, F.lit("SW")) & ~F.contains(color, F.lit("#SW")), F.replace(color, F.lit("SW"), F.lit("#SW"))).otherwise(color)
    gypsum = classify.any_of(F.upper("material"), ("GYPSUM", "GWB"))
    about = F.when((F.col("part") == "ceiling") & gypsum, "GWB").otherwise(F.concat("height", F.lit(" High")))
    tall = F.concat("code", F.lit(" ("), about, F.lit("):\n-Mfg: "), maker, F.lit("\n-Color: "), color, F.lit("\n-Type: "), F.trim("type_size"))
    named = lambda c: F.when((F.col(c) != "") & (F.col(c) != "-"), F.col(c))
    flat = F.concat_ws(" ", "code", named("manufacturer"), named("product"), F.when(named("color").isNotNull(), F.concat(F.lit("- "), "color")))
    wall_trade = F.when(F.contains("code", F.lit("PNT")), "Painting").when(F.contains("code", F.lit("WC")), "Wall Coverings").otherwise("Tile")
    trade = F.when(F.col("part").isin("floor", "base"), "Flooring").when(F.col("part") == "wall", wall_trade).otherwise(F.when(F.contains("code", F.lit("CL")), "Ceilings").otherwise("Drywall"))
    return got.select(
        *keys, "part", "code", "height", F.when(F.col("part").isin("floor", "base"), flat).otherwise(tall).alias("description"), trade.alias("trade"), F.lit(None).cast("double").alias("quantity"),
        F.when(F.col("part") == "base", "LF").otherwise("SF").alias("unit"), F.lit(0.95).alias("confidence"), F.concat(F.lit("Finish Legend: "), "code").alias("source_reference"),
    )


def equipment_items(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    said = F.concat("tag", F.lit(": "), "manufacturer", F.lit(" "), "model", F.lit(" ("), "equipment_type", F.lit(")"))
    return rows.select(*keys, *order, said.alias("description"), F.lit("HVAC").alias("trade"), F.lit(None).cast("double").alias("quantity"), F.lit("EA").alias("unit"), F.lit(0.9).alias("confidence"), F.lit("Equipment Schedule").alias("source_reference"))


def terms_on_pages(terms: DataFrame, pages: DataFrame, keys: Sequence[str], term: str = "term", page_text: str = "text") -> DataFrame:
    """Terms with the pages of the same project that contain them, by an index of pieces; rows without a key or a term meet nothing."""
    found = substrings.containing(terms, pages, keys, term, page_text).toDF(*keys, term, page_text)
    return terms.select(*keys, term).join(found, [*keys, term]).join(pages, [*keys, page_text]).select(*keys, term, *(c for c in pages.columns if c not in (*keys, page_text)))


def better_source(pages: DataFrame, other: DataFrame, keys: Sequence[str], chars: str = "char_count", confidence: str = "confidence") -> DataFrame:
    """Pages of low quality with the text of the second source where it has one."""
    low = classify.low_quality(F.col(chars), F.col(confidence))
    got = pages.join(other.select(*keys, F.col("text").alias("_other")), list(keys), "left")
    return got.withColumn("text", F.when(low, F.coalesce("_other", "text")).otherwise(F.col("text"))).drop("_other")
