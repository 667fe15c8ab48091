"""Queries of the takeoff's own operators, with DuckDB oracles.

The driver's tables hold no plans, so pages, legends, rooms and files are made from ``part``, ``lineitem`` and ``orders``: a row is a page, a legend
entry, a room, a word. The operators read the pages; the oracles compute the same rows from the columns that the pages were made of, and
never see a page. Where both sides need the same made-up columns, these are written once, in SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import classify, enhance, fixed, prompts, salvage, similarity, spelling, text
from tallygrid.operators import context, dedup, generators, jobs, match, parsers, projects, rules, segment, stats
from tallygrid.plans import phrasebook, takeoff
from tallygrid.plans.registry import query
from tallygrid.session import scratch, spread, table
from tallygrid.sources import readers, sinks
from tallygrid.streaming import stages


def _lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _first(t: str, rules_, default: str) -> str:
    """SQL: the first class of which a word is contained."""
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({t}, {_lit(w)})' for w in ws)} THEN {_lit(n)}" for n, ws in rules_) + f" ELSE {default} END"


def _any(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {_lit(w)})" for w in words) + ")"


def _made(s: SparkSession, d: str, columns: dict[str, str], source: str = "part", where: str | None = None) -> DataFrame:
    got = table(s, d, source)
    return (got.where(where) if where else got).selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))


def _cte(columns: dict[str, str], source: str = "part", where: str | None = None) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}" + (f" WHERE {where}" if where else "")


# generators and row parsers, by the phrase book

_NUMBERS = {"a": "p_size", "b": "(10 + p_partkey % 90)", "c": "(10 + p_partkey % 25)"}


def _filled(t: str) -> str:
    """SQL: a text with its numbers put in."""
    for k, v in _NUMBERS.items():
        t = f"replace({t}, '{{{k}}}', CAST({v} AS STRING))"
    return t


def _phrases(s: SparkSession, d: str, phrases: list[str]) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(p) for p in phrases)), (F.col("p_partkey") % len(phrases) + 1).cast("int"))
    for k, v in _NUMBERS.items():
        said = F.replace(said, F.lit(f"{{{k}}}"), F.expr(v).cast("string"))
    return table(s, d, "part").select("p_partkey", said.alias("text"))


def _book_query(name: str, parse, book: phrasebook.Book) -> None:
    rows = [(k, i, *item) for k, (_, items) in enumerate(book) for i, item in enumerate(items)]
    values = ", ".join(f"({k}, {i}, {_lit(desc)}, {_lit(trade)}, {_lit(None if q is None else str(q))}, {_lit(unit)}, {conf})" for k, i, desc, trade, q, unit, conf in rows)
    oracle = f"""SELECT p_partkey, seq::BIGINT AS seq, {_filled('d')} AS description, trade, CASE WHEN q = 'a' THEN p_size::DOUBLE ELSE TRY_CAST(q AS DOUBLE) END AS quantity, unit::VARCHAR AS unit, confidence::DOUBLE AS confidence
    FROM part JOIN (VALUES {values}) v(k, seq, d, trade, q, unit, confidence) ON p_partkey % {len(book)} = k"""

    @query(name, oracle)
    def run(s, d):
        run = rules.generate if getattr(parse, "plain", False) else rules.itemize
        return run(_phrases(s, d, [p for p, _ in book]), ["p_partkey"], parse)


for _name, (_parse, _book) in phrasebook.BOOKS.items():
    _book_query(_name, _parse, _book)


_Q = [(k, i, q, u) for k, (_, found) in enumerate(phrasebook.QUANTITIES) for i, (q, u) in enumerate(found)]


@query(
    "extract_quantities",
    f"""SELECT p_partkey, i::INT AS pos, CASE WHEN q = 'a' THEN p_size::DOUBLE ELSE TRY_CAST(q AS DOUBLE) END AS quantity, unit
    FROM part JOIN (VALUES {", ".join(f"({k}, {i}, '{q}', '{u}')" for k, i, q, u in _Q)}) v(k, i, q, unit) ON p_partkey % {len(phrasebook.QUANTITIES)} = k""",
)
def extract_quantities(s, d):
    pages = _phrases(s, d, [p for p, _ in phrasebook.QUANTITIES])
    return pages.select("p_partkey", F.posexplode(text.quantities(F.col("text"))).alias("pos", "q")).select("p_partkey", "pos", "q.quantity", "q.unit")


# legends, rooms, equipment: parsed from pages

_LEGEND_PAGE = {
    "color": "concat('Shade ', p_size)",
    "type_size": "concat('Gloss ', p_size % 4)",
    "pattern": "concat('Pattern ', p_size % 3)",
    "product": "p_name",
    "manufacturer": "concat('Maker ', p_size % 6)",
    "material": "CASE p_partkey % 3 WHEN 0 THEN 'Wall paint' WHEN 1 THEN 'Gypsum ceiling' ELSE 'Quarry tile' END",
    "code": "concat(CASE p_partkey % 4 WHEN 0 THEN 'PNT' WHEN 1 THEN 'CL' WHEN 2 THEN 'WC' ELSE 'QQ' END, '-', p_partkey)",
}


def _legend_pages(s, d):
    made = _made(s, d, {"project_id": "p_brand", "file_id": "'f'", "page_number": "CAST(p_partkey AS INT)", **_LEGEND_PAGE})
    lines = F.concat_ws("\n", F.when(F.col("page_number") % 5 > 0, F.lit("INTERIOR FINISH LEGEND")).otherwise("NOTES"), *_LEGEND_PAGE)
    return made.select("project_id", "file_id", "page_number", lines.alias("text"))


def _legend_oracle(known: str) -> str:
    return f"""SELECT project_id, file_id, page_number, 7 AS pos, code, CASE WHEN contains(material, 'paint') THEN 'Paint' ELSE material END AS material, manufacturer,
    CASE WHEN contains(material, 'paint') THEN 'Interior Paint' ELSE product END AS product, color, type_size
    FROM ({_cte({"project_id": "p_brand", "file_id": "'f'", "page_number": "CAST(p_partkey AS INT)", **_LEGEND_PAGE}, where="p_partkey % 5 > 0")}) WHERE {known}"""


@query("legend_lookback", _legend_oracle("true"))
def legend_lookback(s, d):
    return parsers.finish_legend(_legend_pages(s, d), takeoff.PAGE_KEYS)


@query("legend_lookback_v2", _legend_oracle("NOT starts_with(code, 'QQ')"))
def legend_lookback_v2(s, d):
    return parsers.finish_legend(_legend_pages(s, d), takeoff.PAGE_KEYS, v2=True)


_ROOM = {
    "room_number": "CAST(100 + p_partkey % 900 AS STRING)",
    "room_name": "p_name",
    "floor": "concat('LVT-', p_size % 5)",
    "floor_grout": "'none'",
    "base": "concat('WB-', p_size % 3)",
    "chair_rail": "'no rail'",
    "walls_primary": "concat('PNT-', p_size % 7, '/WC-', p_size % 2)",
    "walls_accent": "CASE WHEN p_size % 4 = 0 THEN concat('PNT-', p_size % 6) ELSE '-' END",
    "ceiling_material": "'ACT'",
    "ceiling_finish": "CASE p_size % 5 WHEN 0 THEN '-' WHEN 1 THEN 'EXIST' ELSE concat('CL-', p_size % 4) END",
    "ceiling_height": "CASE WHEN p_size % 6 = 0 THEN 'open' ELSE concat(8 + p_size % 3, '''-0') END",
    "millwork_wall_cabinets": "'no cabinets'",
    "millwork_base_cabinets": "concat('base ', p_size)",
    "millwork_countertop": "'stone'",
}
_AT = {"project_id": "p_brand", "file_id": "concat('f', p_partkey % 3)", "page_number": "CAST(p_partkey AS INT)"}


def _rooms(s, d):
    """Rooms as a table, as the parser gives them."""
    return _made(s, d, {**_AT, "pos": "p_size", **_ROOM, "ceiling_height": "CASE WHEN p_size % 6 = 0 THEN '' ELSE concat(8 + p_size % 3, '''-0') END", "notes": "''"})


_R = _cte({**_AT, "pos": "p_size", **_ROOM, "ceiling_height": "CASE WHEN p_size % 6 = 0 THEN '' ELSE concat(8 + p_size % 3, '''-0') END"})


def _room_pages(s, d):
    made = _made(s, d, {**_AT, **_ROOM, "note": "concat('see plan ', p_size)", "second": "p_partkey % 2 = 0"})
    two = F.when(F.col("second"), F.concat_ws("\n", F.lit("999"), *list(_ROOM)[1:])).otherwise("cut off")
    return made.select(*takeoff.PAGE_KEYS, F.concat_ws("\n", F.lit("ROOM FINISH SCHEDULE\nNO"), *_ROOM, "note", two).alias("text"))


_ROOM_ROWS = f"""WITH r AS ({_cte({**_AT, **_ROOM, "note": "concat('see plan ', p_size)", "second": "p_partkey % 2 = 0"})})
    SELECT * EXCLUDE (note, second), 2 AS pos, note AS notes FROM r UNION ALL BY NAME SELECT * EXCLUDE (note, second) REPLACE ('999' AS room_number), 17 AS pos, '' AS notes FROM r WHERE second"""


@query("room_records", _ROOM_ROWS)
def room_records(s, d):
    return parsers.room_schedule(_room_pages(s, d), takeoff.PAGE_KEYS)


@query("room_records_v2", _ROOM_ROWS)
def room_records_v2(s, d):
    return parsers.room_schedule(_room_pages(s, d), takeoff.PAGE_KEYS, v2=True)


_LEGEND = {
    **_AT,
    "pos": "CAST(p_size AS INT)",
    "code": "CASE p_partkey % 6 WHEN 0 THEN concat('PNT-', p_size % 7) WHEN 1 THEN concat('LVT-', p_size % 5) WHEN 2 THEN concat('CL-', p_size % 4) WHEN 3 THEN concat('WC-', p_size % 2) WHEN 4 THEN concat('WB-', p_size % 3) ELSE concat('ZZ-', p_size) END",
    "material": "CASE p_size % 4 WHEN 0 THEN 'Paint' WHEN 1 THEN 'Gypsum ceiling' WHEN 2 THEN 'Vinyl tile' ELSE 'Stone' END",
    "manufacturer": "CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('Maker-', p_size % 3) END",
    "product": "p_name",
    "color": "CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN concat('SW ', p_size) ELSE ' White' END",
    "type_size": "CASE p_size % 2 WHEN 0 THEN 'Flat' ELSE '' END",
}
_ORDER = ["file_id", "page_number", "pos"]


def _legend(s, d):
    return _made(s, d, _LEGEND)


_CODES = "list_filter(list_transform(string_split({c}, '/'), lambda x: trim(x)), lambda x: x <> '')"
_USED = " UNION ".join(f"SELECT project_id, unnest({_CODES.format(c=c)}) AS code FROM r WHERE {c} <> '-'" for c in context.CODE_COLUMNS)
_LAST = "SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY project_id, code ORDER BY file_id DESC, page_number DESC, pos DESC) = 1"
_CTX = f"WITH r AS ({_R}), l AS ({_cte(_LEGEND)}), used AS ({_USED}), last AS ({_LAST})"


def _prefix(code: str, rules_, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'starts_with({code}, {_lit(p)})' for p in ps)} THEN {_lit(n)}" for n, ps in rules_) + f" ELSE {default} END"


_CODE_TRADE = _prefix("upper(code)", fixed.TRADES_BY_CODE, _first("lower(material)", fixed.TRADES_BY_MATERIAL, "'Other'"))


@query("used_codes", _CTX + " SELECT project_id, page_number, code FROM l SEMI JOIN used USING (project_id, code)")
def used_codes(s, d):
    return context.used_only(_legend(s, d), _rooms(s, d), ["project_id"]).select("project_id", "page_number", "code")


@query(
    "legend_items",
    _CTX
    + f""" SELECT project_id, file_id, page_number, pos, concat(code, ': ', manufacturer, ' ', product, CASE WHEN color <> '' THEN ', Color: ' || color ELSE '' END, CASE WHEN type_size <> '' THEN ', Type: ' || type_size ELSE '' END) AS description,
    {_CODE_TRADE} AS trade, NULL::DOUBLE AS quantity, NULL::VARCHAR AS unit, 0.85::DOUBLE AS confidence, 'Finish Legend' AS source_reference FROM l SEMI JOIN used USING (project_id, code) WHERE {_CODE_TRADE} <> 'Other'""",
)
def legend_items(s, d):
    return context.legend_items(_legend(s, d), _rooms(s, d), ["project_id"], _ORDER)


@query("trade_from_code", f"SELECT page_number, {_CODE_TRADE} AS trade FROM ({_cte(_LEGEND)})")
def trade_from_code(s, d):
    return _legend(s, d).select("page_number", classify.trade_of_code(F.col("code"), F.col("material")).alias("trade"))


_WALLS = f"""SELECT project_id, code, height, count(*) AS n FROM (SELECT project_id, ceiling_height AS height, unnest(list_transform(string_split(walls_primary, '/'), lambda x: trim(x)) || CASE WHEN walls_accent <> '-' THEN string_split(walls_accent, '/') ELSE [] END) AS code
    FROM r WHERE ceiling_height <> '') WHERE starts_with(code, 'PNT') GROUP BY ALL"""
_TOPS = "SELECT project_id, ceiling_finish AS code, count(*) AS n FROM r WHERE starts_with(ceiling_finish, 'CL') GROUP BY ALL"


@query("walls_by_height", f"{_CTX} {_WALLS}")
def walls_by_height(s, d):
    return context.walls_by_height(_rooms(s, d), ["project_id"])


@query("ceiling_counts", f"{_CTX} {_TOPS}")
def ceiling_counts(s, d):
    return context.ceilings(_rooms(s, d), ["project_id"])


_DETAIL = "concat(chr(10) || '-Mfg: ', manufacturer, CASE WHEN color <> '' THEN chr(10) || '-Color: ' || color ELSE '' END, CASE WHEN type_size <> '' THEN chr(10) || '-Type: ' || type_size ELSE '' END)"


@query(
    "room_items",
    f"""{_CTX}, w AS ({_WALLS}), t AS ({_TOPS})
    SELECT project_id, CASE WHEN coalesce(manufacturer, '') <> '' THEN concat(code, ' (', height, ' High):', {_DETAIL}) ELSE concat('Wall Finish: ', code, ' (', height, ' High)') END AS description,
      'Painting' AS trade, n::DOUBLE AS quantity, 'RM' AS unit, 0.75::DOUBLE AS confidence, 'Room Schedule' AS source_reference FROM w LEFT JOIN last USING (project_id, code)
    UNION ALL SELECT project_id, CASE WHEN coalesce(manufacturer, '') <> '' THEN concat(code, ' (', material, '):', {_DETAIL}) ELSE concat('Ceiling Finish: ', code) END, 'Ceilings', n::DOUBLE, 'RM', 0.75, 'Room Schedule' FROM t LEFT JOIN last USING (project_id, code)""",
)
def room_items(s, d):
    return context.room_items(_rooms(s, d), _legend(s, d), ["project_id"], _ORDER)


_PLAIN = "list_filter(string_split({c}, '/'), lambda x: x <> '' AND NOT starts_with(x, 'EXIST'))"
_HIGH = "CASE WHEN ceiling_height <> '' THEN ceiling_height || '\"' END"
_PARTS = " UNION ALL ".join(
    f"SELECT project_id, room_name, '{part}' AS part, unnest({_PLAIN.format(c=c)}) AS code, {height} AS height FROM r{where}"
    for part, c, height, where in (
        ("floor", "floor", "''", ""),
        ("base", "base", "''", ""),
        ("wall", "walls_primary", _HIGH, ""),
        ("wall", "walls_accent", _HIGH, " WHERE walls_accent <> '-'"),
        ("ceiling", "ceiling_finish", _HIGH, ""),
    )
)
_FUSED = f"parts AS ({_PARTS}), fused AS (SELECT project_id, part, code, height, count(*) AS n, md5(string_agg(room_name, '|' ORDER BY room_name)) AS rooms FROM parts WHERE height IS NOT NULL GROUP BY ALL)"


@query("fusion_groups", f"{_CTX}, {_FUSED} SELECT * FROM fused")
def fusion_groups(s, d):
    return context.fusion_groups(_rooms(s, d), ["project_id"]).withColumn("rooms", F.md5(F.array_join("rooms", "|")))


_SAID = {c: f"CASE WHEN {c} <> '' AND {c} <> '-' THEN {c} END" for c in ("manufacturer", "product", "color")}


@query(
    "fusion_items",
    f"""{_CTX}, {_FUSED} SELECT project_id, part, code, height, CASE WHEN part IN ('floor', 'base') THEN concat_ws(' ', code, {_SAID["manufacturer"]}, {_SAID["product"]}, '- ' || {_SAID["color"]})
      ELSE concat(code, ' (', CASE WHEN part = 'ceiling' AND (contains(upper(material), 'GYPSUM') OR contains(upper(material), 'GWB')) THEN 'GWB' ELSE height || ' High' END, '):', chr(10), '-Mfg: ', trim(replace(manufacturer, '-', ' ')), chr(10), '-Color: ',
        replace(trim(color), 'SW', '#SW'), chr(10), '-Type: ', trim(type_size)) END AS description,
      CASE WHEN part IN ('floor', 'base') THEN 'Flooring' WHEN part = 'wall' THEN CASE WHEN contains(code, 'PNT') THEN 'Painting' WHEN contains(code, 'WC') THEN 'Wall Coverings' ELSE 'Tile' END WHEN contains(code, 'CL') THEN 'Ceilings' ELSE 'Drywall' END AS trade,
      NULL::DOUBLE AS quantity, CASE WHEN part = 'base' THEN 'LF' ELSE 'SF' END AS unit, 0.95::DOUBLE AS confidence, 'Finish Legend: ' || code AS source_reference FROM fused JOIN last USING (project_id, code)""",
)
def fusion_items(s, d):
    return context.fusion_items(_rooms(s, d), _legend(s, d), ["project_id"], _ORDER)


_EQUIPMENT = {**_AT, "pos": "CAST(p_size AS INT)", "tag": "concat('RTU-', p_size)", "equipment_type": "p_type", "manufacturer": "concat('Maker ', p_size % 3)", "model": "concat('M', p_partkey)"}


@query("equipment_items", f"SELECT project_id, file_id, page_number, pos, tag || ': ' || manufacturer || ' ' || model || ' (' || equipment_type || ')' AS description, 'HVAC' AS trade, NULL::DOUBLE AS quantity, 'EA' AS unit, 0.9::DOUBLE AS confidence, 'Equipment Schedule' AS source_reference FROM ({_cte(_EQUIPMENT)})")
def equipment_items(s, d):
    return context.equipment_items(_made(s, d, _EQUIPMENT), ["project_id"], _ORDER)


@query("equipment_pages", f"SELECT project_id, file_id, page_number, 0 AS pos, tag, 'Rooftop Unit' AS equipment_type, 'Local Source' AS manufacturer, model FROM ({_cte(_EQUIPMENT)}) WHERE page_number % 4 <> 0")
def equipment_pages(s, d):
    said = F.concat(F.when(F.col("page_number") % 4 != 0, "EQUIPMENT SCHEDULE\n").otherwise("NOTES\n"), "tag", F.lit(" MODEL "), "model", F.lit(" CFM 900"))
    return parsers.equipment(_made(s, d, _EQUIPMENT).select(*takeoff.PAGE_KEYS, said.alias("text")), takeoff.PAGE_KEYS)


_TERM = {"project_id": "p_brand", "term": "concat('size ', p_size)"}
_PAGE = {"project_id": "p_brand", "page_id": "p_partkey", "text": "concat(p_name, ' of size ', p_size, ' and kind')"}


@query("terms_of_project", f"WITH t AS (SELECT DISTINCT * FROM ({_cte(_TERM)})), p AS ({_cte(_PAGE)}) SELECT t.project_id, term, page_id FROM t JOIN p ON t.project_id = p.project_id AND contains(p.text, t.term)")
def terms_of_project(s, d):
    return context.terms_on_pages(_made(s, d, _TERM).distinct(), _made(s, d, _PAGE), ["project_id"])


_QUALITY = {"page_id": "p_partkey", "text": "p_name", "char_count": "p_size * 2", "confidence": "CAST(p_size * 3 % 100 AS DOUBLE)"}
_OTHER = {"page_id": "p_partkey", "text": "concat('other ', p_type)"}


@query("better_source", f"SELECT page_id, CASE WHEN char_count < 50 OR confidence < 40 THEN coalesce(o.text, q.text) ELSE q.text END AS text FROM ({_cte(_QUALITY)}) q LEFT JOIN ({_cte(_OTHER, where='p_partkey % 3 = 0')}) o USING (page_id)")
def better_source(s, d):
    return context.better_source(_made(s, d, _QUALITY), _made(s, d, _OTHER, where="p_partkey % 3 = 0"), ["page_id"]).select("page_id", "text")


# classes


_NAMES = ("Ceiling", "floor", " GYPSUM ", "hvac", "fire_protection", "roof works", "")


@query("trade_normalise", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Ceilings' WHEN 1 THEN 'Flooring' WHEN 2 THEN 'Drywall' WHEN 3 THEN 'HVAC' WHEN 4 THEN 'Fire Protection' WHEN 5 THEN 'Roof Works' ELSE 'Other' END AS trade FROM part")
def trade_normalise(s, d):
    said = F.get(F.array(*(F.lit(x) for x in _NAMES)), (F.col("p_partkey") % 8).cast("int"))
    return table(s, d, "part").select("p_partkey", classify.trade_name(said).alias("trade"))


_KIND = "concat(CASE p_partkey % 5 WHEN 0 THEN 'VAV box ' WHEN 1 THEN 'Panel ' WHEN 2 THEN 'Exhaust Fan ' WHEN 3 THEN 'pump ' ELSE 'LED troffer ' END, p_type)"


@query("equip_trade", f"SELECT p_partkey, {_first(f'lower({_KIND})', fixed.EQUIPMENT_TRADES, _lit('Mechanical'))} AS trade FROM part")
def equip_trade(s, d):
    return _made(s, d, {"p_partkey": "p_partkey", "kind": _KIND}).select("p_partkey", classify.equipment_trade(F.col("kind")).alias("trade"))


_BOX = {"k": "l_orderkey", "n": "l_linenumber", "x1": "CAST(l_partkey % 900 AS DOUBLE)", "y1": "CAST(l_suppkey * 37 % 700 AS DOUBLE)", "x2": "CAST(l_partkey % 900 + l_quantity AS DOUBLE)", "y2": "CAST(l_suppkey * 37 % 700 + l_quantity * 6 AS DOUBLE)"}


@query(
    "region_classify",
    f"""WITH b AS ({_cte(_BOX, 'lineitem')}), m AS (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, y2 - y1 AS h FROM b)
    SELECT k, n, CASE WHEN y > 680 AND x > 600 THEN 'title_block' WHEN (x > 600 AND h > 80) OR h > 240 THEN 'schedule' WHEN y < 240 AND x < 500 THEN 'notes' ELSE 'callout' END AS kind FROM m""",
)
def region_classify(s, d):
    return _made(s, d, _BOX, "lineitem").select("k", "n", classify.region(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(1000), F.lit(800)).alias("kind"))


@query("region_filter", f"WITH b AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM ({_cte(_BOX, 'lineitem')})) SELECT k, n FROM b WHERE w BETWEEN 40 AND 4000 AND h BETWEEN 15 AND 4000 AND w / nullif(h, 0) BETWEEN 0.15 AND 0.9")
def region_filter(s, d):
    b = _made(s, d, _BOX, "lineitem").withColumns({"w": F.expr("x2 - x1"), "h": F.expr("y2 - y1")})
    # a fill that is half of the aspect, so that all four bounds matter; aspects here are below 0.3 and so doubled
    return b.where(classify.real_region(F.col("w"), F.col("h"), F.col("w") / F.nullif("h", F.lit(0))) | classify.real_region(F.col("w"), F.col("h") / 2, F.col("w") / F.nullif("h", F.lit(0)))).select("k", "n")


@query("region_stats", "SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_quantity * 2 >= 60) AS good, count(*) FILTER (l_quantity * 2 > 0 AND l_quantity * 2 < 60) AS weak, count(*) FILTER (l_linenumber = 1) AS second_source FROM lineitem GROUP BY 1")
def region_stats(s, d):
    r = table(s, d, "lineitem").select("l_orderkey", (F.col("l_quantity") * 2).alias("ocr_confidence"), (F.col("l_linenumber") == 1).alias("second_source"))
    return stats.region_stats(r, ["l_orderkey"])


@query("pressure_level", "SELECT p_partkey, CASE WHEN p_size / 12.0 > 3 OR p_partkey % 3000 < 512 THEN 'critical' WHEN p_size / 12.0 > 2 OR p_partkey % 3000 < 1024 THEN 'high' WHEN p_size / 12.0 > 1.5 OR p_partkey % 3000 < 2048 THEN 'moderate' ELSE 'low' END AS pressure FROM part")
def pressure_level(s, d):
    return table(s, d, "part").select("p_partkey", classify.pressure(F.col("p_size") / 12.0, F.col("p_partkey") % 3000).alias("pressure"))


@query("page_ocr_quality", "SELECT p_partkey, p_size < 50 / 2.0 OR p_size * 3 % 100 < 40 AS low FROM part")
def page_ocr_quality(s, d):
    return table(s, d, "part").select("p_partkey", classify.low_quality(F.col("p_size") * 2, F.col("p_size") * 3 % 100).alias("low"))


_LOG = "concat(CASE event_type WHEN 'view' THEN 'Ingesting file ' WHEN 'click' THEN 'Extracting items ' WHEN 'purchase' THEN 'Saved to ' WHEN 'error' THEN 'Fuzzy match ' ELSE 'Hello ' END, user_id)"
_STAGE = _first(f"lower({_LOG})", fixed.STAGES, "NULL")


@query("stage_from_log", f"SELECT event_id, {_STAGE} AS stage FROM events")
def stage_from_log(s, d):
    return _made(s, d, {"event_id": "event_id", "line": _LOG}, "events").select("event_id", classify.log_stage(F.col("line")).alias("stage"))


@query("stages_of_log", f"SELECT event_id, last_value({_STAGE} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stage_now FROM events")
def stages_of_log(s, d):
    e = _made(s, d, {"event_id": "event_id", "job_id": "user_id", "ts": "ts", "message": _LOG}, "events")
    return jobs.stages_from_log(e, order=("ts", "event_id")).select("event_id", "stage_now")


_HEAD = "concat('Notes ', p_size, ' ', CASE p_partkey % 6 WHEN 0 THEN 'Room Finish Schedule' WHEN 1 THEN 'FINISH LEGEND' WHEN 2 THEN 'RTU Schedule and Door Schedule' WHEN 3 THEN 'FIXTURE SCHEDULE' WHEN 4 THEN 'EQUIPMENT SCHEDULE of RTU-1' ELSE 'nothing' END)"
_HEADED = {"p_partkey": "p_partkey", "text": _HEAD}


def _all_hits(t: str, rules_) -> str:
    """SQL: every class of which a word is contained, in order, joined."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_any(t, ws)} THEN {_lit(n)} END" for n, ws in rules_) + ")"


@query("page_type_multi", f"SELECT p_partkey, {_all_hits('upper(text)', fixed.PAGE_TYPES)} AS types FROM ({_cte(_HEADED)})")
def page_type_multi(s, d):
    return _made(s, d, _HEADED).select("p_partkey", F.array_join(classify.page_types(F.col("text")), ",").alias("types"))


@query("page_gate_v1", f"SELECT p_partkey, {_all_hits('text', fixed.PAGE_GATES)} AS gates FROM ({_cte(_HEADED)})")
def page_gate_v1(s, d):
    return _made(s, d, _HEADED).select("p_partkey", F.array_join(classify.page_gates(F.col("text")), ",").alias("gates"))


@query("gates", f"SELECT p_partkey, {_any('upper(text)', fixed.MECHANICAL_GATES)} AS mechanical, {_any('upper(text)', fixed.ELECTRICAL_GATES)} AS electrical FROM ({_cte(_HEADED)})")
def gates(s, d):
    return _made(s, d, _HEADED).select("p_partkey", takeoff.has_any("text", fixed.MECHANICAL_GATES).alias("mechanical"), takeoff.has_any("text", fixed.ELECTRICAL_GATES).alias("electrical"))


_CRIT = {"p_partkey": "p_partkey", "text": "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' Vav Terminal Unit Schedule' WHEN 1 THEN ' LIGHTING FIXTURE SCHEDULE, AC/HP SCHEDULE' WHEN 2 THEN ' electrical panel schedule' ELSE ' schedule' END)"}


@query("critical_pages", f"SELECT * FROM (SELECT p_partkey, {_first('upper(text)', [(h, (h,)) for h in takeoff.CRITICAL], 'NULL')} AS kind FROM ({_cte(_CRIT)})) WHERE kind IS NOT NULL")
def critical_pages(s, d):
    return takeoff.critical_pages(_made(s, d, _CRIT)).select("p_partkey", "kind")


_BRANDED = {"p_partkey": "p_partkey", "text": "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' by Carrier and Titus' WHEN 1 THEN ' by sherwin williams' WHEN 2 THEN ' of LITHONIA' ELSE '' END)"}


@query("manufacturer_lookup", f"SELECT p_partkey, {_first('upper(text)', [(b, (b.upper(),)) for b in fixed.ROW_BRANDS], 'NULL')} AS brand FROM ({_cte(_BRANDED)})")
def manufacturer_lookup(s, d):
    return _made(s, d, _BRANDED).select("p_partkey", classify.first_brand(F.col("text"), fixed.ROW_BRANDS).alias("brand"))


@query("equipment_tags", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('RTU-', p_size, ',PNT-', p_size % 9) ELSE concat('S-', p_size) END AS tags FROM part")
def equipment_tags(s, d):
    said = F.expr("CASE WHEN p_size % 3 = 0 THEN concat('rtu-', p_size, ' with PNT-', p_size % 9, ', RTU-', p_size, ' XX-1') ELSE concat('grille S-', p_size) END")
    return table(s, d, "part").select("p_partkey", F.array_join(classify.tags(said), ",").alias("tags"))


# text and numbers


@query("combine_text", "SELECT p_partkey, CASE WHEN p_size < 25 THEN concat_ws(chr(10), nullif(CASE WHEN p_size < 5 THEN '' ELSE p_name END, ''), nullif(p_type, '')) ELSE p_name END AS text FROM part")
def combine_text(s, d):
    own = F.expr("CASE WHEN p_size < 5 THEN '' ELSE p_name END")
    return table(s, d, "part").select("p_partkey", text.combined_text(own, F.col("p_type"), F.col("p_size") < 25).alias("text"))


@query("ocr_gate", "SELECT p_partkey, p_size < 25 AS any_kind, p_size < 25 AND p_brand = 'Brand#11' AS drawings, false AS off FROM part")
def ocr_gate(s, d):
    scanned, kind = F.col("p_size") < 25, F.when(F.col("p_brand") == "Brand#11", "drawing").otherwise("spec")
    return table(s, d, "part").select("p_partkey", text.needs_ocr(scanned, kind).alias("any_kind"), text.needs_ocr(scanned, kind, drawings_only=True).alias("drawings"), text.needs_ocr(scanned, kind, enabled=False).alias("off"))


@query("clean_height", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(p_size, '''-0"') WHEN 1 THEN concat(p_size, '''-6"') WHEN 2 THEN concat(p_size, '''"') ELSE 'varies' END AS height FROM part""")
def clean_height(s, d):
    said = F.expr("""CASE p_partkey % 4 WHEN 0 THEN concat('+/- ', p_size, "'-0") WHEN 1 THEN concat(' ', p_size, "'-6\\"") WHEN 2 THEN concat(p_size, "' +/-") ELSE 'varies ' END""")
    return table(s, d, "part").select("p_partkey", text.clean_height(said).alias("height"))


@query("context_window", "SELECT doc_id, CASE WHEN instr(text, ' the ') > 0 THEN substr(text, greatest(instr(text, ' the ') - 1 - 20, 0) + 1, least(instr(text, ' the ') + 4 + 30, length(text)) - greatest(instr(text, ' the ') - 1 - 20, 0)) END AS near FROM documents")
def context_window(s, d):
    at = F.instr("text", F.lit(" the "))
    return table(s, d, "documents").select("doc_id", F.when(at > 0, text.window_of(F.col("text"), at - 1, at + 4, 20, 30)).alias("near"))


_MISSPELT = "concat(p_name, ' difuser of aluminium, VACCANCY ', p_type)"


def _spelled(t: str) -> str:
    t = f"lower({t})"
    for a, b in fixed.SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return t


@query("score_normalise", f"SELECT p_partkey, {_spelled(_MISSPELT)} AS text FROM part")
def score_normalise(s, d):
    return table(s, d, "part").select("p_partkey", text.spelled(F.expr(_MISSPELT)).alias("text"))


@query("project_path", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('P', p_partkey) ELSE concat('Q', p_size) END AS project_id FROM part")
def project_path(s, d):
    path = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('/data/P', p_partkey, ' - tower/Project Files') ELSE concat('C:\\\\\\\\jobs\\\\\\\\Q', p_size, ' shop') END")
    return table(s, d, "part").select("p_partkey", text.project_id(path).alias("project_id"))


def _worded() -> str:
    """SQL: the standard wordings, as a CASE of the table that the operator reads."""
    low, size, whens = "lower(description)", "regexp_extract(description, '([0-9]+)\"', 1)", []
    for trade, every, some, wording in enhance.WORDINGS:
        has = [f"trade = {_lit(trade)}", *(f"contains({low}, {_lit(w)})" for w in every)]
        has += [f"{size} <> ''"] if some == ('"',) else [_any(low, some)] if some else []
        whens.append(f"WHEN {' AND '.join(has)} THEN replace({_lit(wording)}, '{{0}}', {size})")
    return f"CASE WHEN length(description) > {enhance.DETAILED} OR {_any('description', enhance.CODES)} THEN description {' '.join(whens)} ELSE description END"


_TERSE = {
    "p_partkey": "p_partkey",
    "description": "concat(CASE p_partkey % 7 WHEN 0 THEN 'paint wall ' WHEN 1 THEN '8\" duct ' WHEN 2 THEN 'panel ' WHEN 3 THEN 'carpet ' WHEN 4 THEN 'PNT-1 ' WHEN 5 THEN 'grille ' ELSE 'gwb ' END, p_name)",
    "trade": "CASE p_partkey % 5 WHEN 0 THEN 'Painting' WHEN 1 THEN 'HVAC' WHEN 2 THEN 'Electrical' WHEN 3 THEN 'Flooring' ELSE 'Ceilings' END",
}


@query("enhance_wording", f"SELECT p_partkey, {_worded()} AS said FROM ({_cte(_TERSE)})")
def enhance_wording(s, d):
    return _made(s, d, _TERSE).select("p_partkey", enhance.enhanced(F.col("description"), F.col("trade")).alias("said"))


@query("spell_correction", "SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN 'Diffuser' WHEN 1 THEN 'vacancy' ELSE 'xy' END, ' ', p_size, ' tile,') AS said FROM part")
def spell_correction(s, d):
    said = F.expr("concat(CASE p_partkey % 3 WHEN 0 THEN 'Difuser' WHEN 1 THEN 'vaccancy' ELSE 'xy' END, ' ', p_size, ' tle,')")
    return table(s, d, "part").select("p_partkey", spelling.corrected(said, ["diffuser", "vacancy", "tile"]).alias("said"))


_ANSWERS = ('```json\n[{"description": "a #", "quantity": "1,200"}]\n```', 'so {"items": [{"description": "a #"}, {"description": "b", "quantity": 3}]} end', '[{"description": "a #"}, {"description": "b"}, {"descr', "no #")


@query(
    "json_salvage",
    "SELECT p_partkey, pos, replace(d, '#', p_size::VARCHAR) AS description, q::DOUBLE AS quantity FROM part JOIN (VALUES (0, 0, 'a #', 1200), (1, 0, 'a #', NULL), (1, 1, 'b', 3), (2, 0, 'a #', NULL), (2, 1, 'b', NULL)) v(k, pos, d, q) ON p_partkey % 4 = k",
)
def json_salvage(s, d):
    said = F.replace(F.element_at(F.array(*(F.lit(a) for a in _ANSWERS)), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("#"), F.col("p_size").cast("string"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(key, i, x["description"], x["quantity"]) for key, answer in pdf.itertuples(index=False) for i, x in enumerate(salvage.items(answer))]
            yield pd.DataFrame(out, columns=["p_partkey", "pos", "description", "quantity"]).astype({"quantity": "float64"})

    return table(s, d, "part").select("p_partkey", said.alias("answer")).mapInPandas(run, "p_partkey long, pos int, description string, quantity double")


@query(
    "prompt_build",
    """WITH t AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_name FROM part)
    SELECT p_brand AS project_id, concat('INTERIOR FINISH LEGEND (use these exact codes and products):', chr(10), string_agg('  ' || p_name, chr(10) ORDER BY n), chr(10), chr(10), '--- EXTRACTION CONTENT ---', chr(10), 'chunk') AS prompt FROM t WHERE n <= 40 GROUP BY 1""",
)
def prompt_build(s, d):
    rows = table(s, d, "part").select(F.col("p_brand").alias("project_id"), "p_partkey", "p_name")
    lines = prompts.context_lines(rows, F.col("p_name"), ["p_partkey"], prompts.ROWS["legend"])
    return lines.select("project_id", prompts.context_prompt(F.col("lines"), F.lit(""), F.lit(None).cast("string"), F.lit("chunk")).alias("prompt"))


# matches and reports

_ITEM = {"project_id": "p_brand", "seq": "p_partkey", "description": "concat(repeat(p_name, 8), ' ', p_type)"}
_PAIR = {"project_id": "p_brand", "e": "p_partkey", "p": "p_partkey + 1", "score": "CAST(p_size AS DOUBLE)"}


@query("missing_items", f"SELECT i.project_id, i.seq, substr(i.description, 1, 100) AS description FROM ({_cte(_ITEM)}) i ANTI JOIN ({_cte(_PAIR, where='p_size > 20')}) m ON i.project_id = m.project_id AND i.seq = m.e")
def missing_items(s, d):
    return match.unmatched(_made(s, d, _ITEM), _made(s, d, _PAIR, where="p_size > 20"), "e")


@query("extra_items", f"SELECT i.project_id, i.seq, substr(i.description, 1, 100) AS description FROM ({_cte(_ITEM)}) i ANTI JOIN ({_cte(_PAIR, where='p_size > 20')}) m ON i.project_id = m.project_id AND i.seq = m.p")
def extra_items(s, d):
    return match.unmatched(_made(s, d, _ITEM), _made(s, d, _PAIR, where="p_size > 20"), "p")


_SCORE = {"project_id": "o_custkey", "e": "o_orderkey % 50", "p": "o_orderkey % 7", "score": "CAST(60 + o_totalprice % 40 AS DOUBLE)"}


@query("best_of_scores", f"SELECT project_id, e, p, score FROM ({_cte(_SCORE, 'orders')}) WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY project_id, p ORDER BY score DESC, e) = 1")
def best_of_scores(s, d):
    return match.best(_made(s, d, _SCORE, "orders"))


_RUN = {"k": "p_partkey", "matched": "p_size % 10", "missing": "p_size % 6", "extra": "p_size % 3"}


@query(
    "accuracy_rates",
    f"SELECT k, round(coalesce(matched / nullif(matched + missing, 0), 0.0), 4)::DOUBLE AS accuracy, round(round(coalesce(matched / nullif(matched + missing, 0), 0.0), 4) * 100, 1)::DOUBLE AS match_rate, round(coalesce(matched / nullif(matched + extra, 0), 0.0), 4)::DOUBLE AS precision FROM ({_cte(_RUN)})",
)
def accuracy_rates(s, d):
    return _made(s, d, _RUN).select("k", *stats.rates("matched", "missing", "extra"))


@query("items_per_file", "SELECT file_name, count(i.ref) AS n_items FROM (SELECT DISTINCT concat('f', p_size) AS file_name FROM part) f LEFT JOIN (SELECT concat('f', p_size) AS ref FROM part WHERE p_size > 5) i ON f.file_name = i.ref GROUP BY 1")
def items_per_file(s, d):
    files = table(s, d, "part").select(F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("file_name")).distinct()
    items = table(s, d, "part").where("p_size > 5").select(F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("source_reference"))
    return stats.items_per_file(files, items)


@query("skip_summary", "SELECT p_brand, count(*) FILTER (p_size > 30) AS skipped, count(*) FILTER (p_size <= 30) AS processed FROM part GROUP BY 1")
def skip_summary(s, d):
    f = table(s, d, "part").select("p_brand", F.when(F.col("p_size") > 30, "too heavy").alias("skip_reason"))
    return stats.skip_summary(f, ["p_brand"])


@query("dashboard", "SELECT count(*) AS projects, count(*) FILTER (p_size > 10) AS with_output, count(*) FILTER (p_size > 20) AS with_evaluation, count(*) FILTER (p_size % 2 = 0) AS samples, count(*) FILTER (p_size % 2 = 1) AS challenges FROM part")
def dashboard(s, d):
    p = table(s, d, "part").select((F.col("p_size") > 10).alias("has_output"), (F.col("p_size") > 20).alias("has_evaluation"), F.when(F.col("p_size") % 2 == 0, "sample").otherwise("challenge").alias("type"))
    return stats.dashboard(p)


_WORD = {"page": "l_orderkey", "block": "l_linenumber % 2", "par": "0", "line": "l_linenumber % 3", "word": "l_linenumber", "text": "concat('w', l_partkey)", "conf": "CAST(l_quantity - 10 AS DOUBLE)"}


@query(
    "layout_text",
    f"""WITH w AS ({_cte(_WORD, 'lineitem')}), r AS (SELECT page, block, par, line, string_agg(text, ' ' ORDER BY word, text) AS row, sum(conf) FILTER (conf > 0) AS s, count(*) FILTER (conf > 0) AS n FROM w GROUP BY ALL)
    SELECT page, string_agg(row, chr(10) ORDER BY block, par, line) AS text, round(coalesce(sum(s) / nullif(sum(n), 0), 0.0), 6) AS confidence FROM r GROUP BY page""",
)
def layout_text(s, d):
    return segment.layout_text(_made(s, d, _WORD, "lineitem"), ["page"]).withColumn("confidence", F.round("confidence", 6))


@query("merged_spans", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '0-20' ELSE '0-10,15-30' END AS kept FROM orders")
def merged_spans(s, d):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    spans = F.when(F.col("o_orderkey") % 2 == 0, F.array(span(5, 12), span(0, 20))).otherwise(F.array(span(15, 30), span(0, 10), span(5, 14)))
    kept = F.transform(segment.keep_longer(spans), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return table(s, d, "orders").select("o_orderkey", F.array_join(kept, ",").alias("kept"))


@query("merged_regions", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '0,0,10,10' ELSE '0,0,10,12;50,50,60,60' END AS boxes FROM orders")
def merged_regions(s, d):
    box = lambda *v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("y1", "x1", "y2", "x2"), strict=True)))
    boxes = F.when(F.col("o_orderkey") % 2 == 0, F.array(box(2, 2, 9, 9), box(0, 0, 10, 10))).otherwise(F.array(box(0, 0, 10, 10), box(50, 50, 60, 60), box(1, 1, 8, 12)))
    said = F.transform(segment.merge_boxes(boxes), lambda b: F.concat_ws(",", *(b[n].cast("string") for n in ("y1", "x1", "y2", "x2"))))
    return table(s, d, "orders").select("o_orderkey", F.array_join(said, ";").alias("boxes"))


_SECTIONED = {"p_partkey": "p_partkey", "text": "concat('Intro ', p_name, chr(10), 'Equipment Schedule', chr(10), repeat('row ', 40 + p_size), chr(10), 'NOTES', chr(10), 'end')"}


@query("detect_schedules", f"SELECT p_partkey, 'equipment' AS kind, (instr(text, 'Equipment') - 1)::INT AS start, (instr(text, chr(10) || 'NOTES') - 1)::INT AS \"end\" FROM ({_cte(_SECTIONED)})")
def detect_schedules(s, d):
    return segment.schedules(_made(s, d, _SECTIONED), ["p_partkey"], fixed.SCHEDULE_PATTERNS, fixed.NEXT_SECTION).drop("section")


@query("hybrid_schedules", f"SELECT p_partkey, 'equipment' AS kind, (instr(text, 'Equipment') - 1)::INT AS start, (instr(text, chr(10) || 'NOTES') - 1)::INT AS \"end\" FROM ({_cte(_SECTIONED)})")
def hybrid_schedules(s, d):
    return segment.schedules(_made(s, d, _SECTIONED), ["p_partkey"], fixed.HYBRID_SCHEDULES, fixed.NEXT_SECTION_HYBRID, merge=False).drop("section")


# files, projects, sinks

_CELLS = {
    "project_id": "p_brand",
    "row": "CAST(p_partkey % 40 AS INT)",
    **{f"c{i}": "'x'" for i in range(16)},
    "c0": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey AS STRING) END",
    "c3": "CASE WHEN p_partkey % 11 = 0 THEN 'DIVISION 1- GENERAL' ELSE concat(' ', p_name, ' ') END",
    "c4": "CASE WHEN p_partkey % 7 = 0 THEN 'many' ELSE CAST(p_size - 3 AS STRING) END",
    "c7": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE ' SF ' END",
}


@query(
    "expected_items",
    f"""SELECT project_id, "row"::BIGINT AS seq, trim(c3) AS description, TRY_CAST(c4 AS DOUBLE) AS quantity, trim(coalesce(c7, '')) AS unit FROM ({_cte({('"row"' if k == "row" else k): v for k, v in _CELLS.items()})})
    WHERE "row" >= 7 AND c0 IS NOT NULL AND c3 <> 'DIVISION 1- GENERAL' AND TRY_CAST(c4 AS DOUBLE) > 0""",
)
def expected_items(s, d):
    return readers.expected_items(_made(s, d, _CELLS))


_SCAN = {"path": "concat('f', p_partkey)", "is_scanned": "p_size < 20", "text": "p_name"}
_READ = {"path": "concat('f', p_partkey)", "ocr_text": "concat('seen ', p_type)", "ocr_confidence": "CAST(p_size AS DOUBLE)"}


@query(
    "recognised_pages",
    f"""SELECT path, CASE WHEN is_scanned THEN concat_ws(chr(10), text, ocr_text) ELSE text END AS text, ocr_text IS NOT NULL AND is_scanned AS ocr_used FROM ({_cte(_SCAN)}) LEFT JOIN ({_cte(_READ, where="p_partkey % 2 = 0")}) USING (path)""",
)
def recognised_pages(s, d):
    return readers.with_recognised(_made(s, d, _SCAN), _made(s, d, _READ, where="p_partkey % 2 = 0"), ["path"]).select("path", "text", "ocr_used")


@query("recognise_images", "SELECT page_id, upper(substr(url, 1, 20)) AS ocr_text, length(url)::DOUBLE AS ocr_confidence FROM pages")
def recognise_images(s, d):
    images = table(s, d, "pages").select("page_id", F.encode("url", "UTF-8").alias("image"))
    return readers.recognise(images, lambda b: (b.decode()[:20].upper(), float(len(b.decode()))), ["page_id"])


@query("decoded_pages", "SELECT page_id, unnest(range(1, len(string_split(url, '/')) + 1))::INT AS page_number, trim(unnest(string_split(url, '/'))) AS text FROM pages WHERE page_id % 10 <> 0")
def decoded_pages(s, d):
    def decode(b: bytes) -> list[str]:
        if b.startswith(b"!"):
            raise ValueError("damaged")
        return b.decode().split("/")

    found = table(s, d, "pages").select("page_id", F.encode(F.when(F.col("page_id") % 10 == 0, F.lit("!")).otherwise(F.col("url")), "UTF-8").alias("content"))
    return readers.pages(found, decode, ["page_id"])[0].select("page_id", "page_number", "text")


@query("decode_rejects", "SELECT page_id, 'ValueError: damaged' AS error FROM pages WHERE page_id % 10 = 0")
def decode_rejects(s, d):
    def decode(b: bytes) -> list[str]:
        if b.startswith(b"!"):
            raise ValueError("damaged")
        return [b.decode()]

    found = table(s, d, "pages").select("page_id", F.encode(F.when(F.col("page_id") % 10 == 0, F.lit("!")).otherwise(F.col("url")), "UTF-8").alias("content"))
    return readers.pages(found, decode, ["page_id"])[1]


def _listing(s, d):
    """Three entries a part: a folder, its "Project Files" and a file; every third has an expected sheet."""
    p = table(s, d, "part").select("p_partkey", F.concat(F.lit("/r/c/P"), F.col("p_partkey").cast("string"), F.lit(" - site")).alias("at"))
    entry = lambda path, is_dir, size: p.select(path.alias("path"), F.lit(is_dir).alias("is_dir"), F.lit(size).cast("long").alias("size"))
    rows = entry(F.col("at"), True, 0).union(entry(F.concat("at", F.lit("/Project Files")), True, 0)).union(entry(F.concat("at", F.lit("/Project Files/a.PDF")), False, 9))
    some = p.where("p_partkey % 3 = 0")
    for tail, is_dir in (("/Expected Manual Output", True), ("/Expected Manual Output/b.xlsx", False), ("/Expected Manual Output/c.pdf", False)):
        rows = rows.union(some.select(F.concat("at", F.lit(tail)).alias("path"), F.lit(is_dir).alias("is_dir"), F.lit(1).cast("long").alias("size")))
    return rows


def _registry(s, d):
    return table(s, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("project_id"), F.concat(F.lit("/r/c/P"), F.col("p_partkey").cast("string"), F.lit(" - site")).alias("path"))


@query("project_discover", "SELECT concat('/r/c/P', p_partkey, ' - site') AS path, concat('P', p_partkey, ' - site') AS name, 3 AS depth FROM part WHERE p_partkey % 2 = 1 AND p_size <> 7")
def project_discover(s, d):
    hidden = table(s, d, "part").where("p_size = 7").select(F.concat(F.lit("/r/c/P"), F.col("p_partkey").cast("string"), F.lit(" - site")).alias("path"))
    return readers.discover(_listing(s, d), _registry(s, d), hidden, search=" - SITE", depths=(3, 3))


@query("project_type", "SELECT concat('P', p_partkey) AS project_id, CASE WHEN p_partkey % 3 = 0 THEN 'sample' ELSE 'challenge' END AS type FROM part WHERE p_partkey % 2 = 0")
def project_type(s, d):
    return readers.project_type(_listing(s, d), _registry(s, d)).select("project_id", "type")


@query("project_visible", "SELECT concat('P', p_partkey) AS project_id FROM part WHERE p_partkey % 2 = 0 AND p_size <> 7")
def project_visible(s, d):
    hidden = table(s, d, "part").where("p_size = 7").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("project_id"))
    return projects.visible(_registry(s, d), hidden, _listing(s, d)).select("project_id")


@query("project_info", "SELECT concat('P', p_partkey) AS project_id, 1::BIGINT AS files_count, p_size > 40 AS has_output, false AS has_evaluation FROM part WHERE p_partkey % 2 = 0")
def project_info(s, d):
    stored = table(s, d, "part").where("p_size > 40").select(F.concat(F.lit("/out/P"), F.col("p_partkey").cast("string"), F.lit("/prediction.json")).alias("path"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size"))
    return projects.info(_registry(s, d), _listing(s, d).union(stored)).select("project_id", "files_count", "has_output", "has_evaluation")


@query("project_batch", "SELECT concat('/r/c/P', p_partkey, ' - site/Project Files') AS path, p_partkey % 3 = 0 AS has_expected FROM part")
def project_batch(s, d):
    return projects.batch(_listing(s, d)).select("path", "has_expected")


@query("expected_sheets", "SELECT concat('/r/c/P', p_partkey, ' - site') AS folder, concat('/r/c/P', p_partkey, ' - site/Expected Manual Output/b.xlsx') AS sheet FROM part WHERE p_partkey % 3 = 0")
def expected_sheets(s, d):
    return projects.expected_sheets(_listing(s, d))


@query("project_paths", "SELECT concat('P', p_partkey) AS project_id, CASE WHEN p_size = 1 THEN '/given' WHEN p_partkey % 2 = 0 THEN concat('/r/c/P', p_partkey, ' - site') ELSE concat('client_files/P', p_partkey, '/Project Files') END AS resolved FROM part")
def project_paths(s, d):
    want = table(s, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("project_id"), F.expr("CASE WHEN p_size = 1 THEN '/given' END").alias("path"))
    return projects.resolve_path(want, _registry(s, d), _listing(s, d).limit(0)).select("project_id", "resolved")


@query("stored_versions", "SELECT concat('/o/', p_partkey, '.json') AS path, concat(p_partkey, '.json') AS file, p_size::BIGINT AS size, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 3 END::INT AS line_items_count FROM part")
def stored_versions(s, d):
    said = F.expr("""CASE p_partkey % 3 WHEN 0 THEN '{' WHEN 1 THEN '{"line_items": [{"description": "a"}]}' ELSE '{"line_items": [{"description": "a"}, {"description": "b"}]}' END""")
    return projects.stored_versions(table(s, d, "part").select(F.expr("concat('/o/', p_partkey, '.json')").alias("path"), F.col("p_size").cast("long").alias("size"), said.alias("text")))


@query("job_deleted", "SELECT user_id::VARCHAR AS job_id, count(*) AS n FROM events WHERE user_id <> (SELECT min(user_id) FROM events) GROUP BY 1")
def job_deleted(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("job_id"))
    gone = str(table(s, d, "events").agg(F.min("user_id")).first()[0])
    return projects.without_job(e, gone)[0].groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


_LINES = {"project_id": "p_brand", "seq": "p_partkey", "description": "p_name", "trade": "p_type", "quantity": "CAST(p_size AS DOUBLE)", "unit": "'EA'", "confidence": "CAST(0.5 AS DOUBLE)", "source_reference": "concat('f', p_size % 4)"}


@query(
    "prediction_sink",
    f"""SELECT project_id, string_agg(DISTINCT trade, ' | ' ORDER BY trade) AS trade_scope, string_agg(DISTINCT source_reference, ',' ORDER BY source_reference) AS files, md5(string_agg(description, '|' ORDER BY seq)) AS items FROM ({_cte(_LINES)}) GROUP BY 1""",
)
def prediction_sink(s, d):
    got = sinks.nested(_made(s, d, _LINES))
    return got.select("project_id", "trade_scope", F.array_join("input_files_used", ",").alias("files"), F.md5(F.array_join(F.transform("line_items", lambda x: x["description"]), "|")).alias("items"))


@query("export_lines", f"SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY seq)::INT AS number, description, quantity FROM ({_cte(_LINES)})")
def export_lines(s, d):
    items = _made(s, d, _LINES)
    return sinks.sheets(items, items.limit(0), items.limit(0))["Line Items"].select("project_id", F.col("#").alias("number"), "description", "quantity")


@query("cover_lines", f"SELECT project_id, n::INT AS n, substr(description, 1, 80) AS description FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS n FROM ({_cte(_LINES)})) WHERE n <= 50")
def cover_lines(s, d):
    return sinks.cover(_made(s, d, _LINES))


@query("largest_file", "SELECT p_brand AS project_id, p_size::DOUBLE AS size_mb, min(p_name) AS path FROM (SELECT * FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) = 1) GROUP BY 1, 2")
def largest_file(s, d):
    return sinks.largest_file(_made(s, d, {"project_id": "p_brand", "size_mb": "CAST(p_size AS DOUBLE)", "path": "p_name"}))


@query("plugged_filter", f"SELECT project_id, seq FROM ({_cte(_LINES)}) WHERE NOT contains(description, 'b')")
def plugged_filter(s, d):
    return takeoff.plugged_filter(_made(s, d, _LINES), lambda said: ["b" not in x for x in said]).select("project_id", "seq")


@query("plugged_extractor", "SELECT p_brand AS project_id, p_name AS description, 'Other' AS trade, 0.5::DOUBLE AS confidence, concat('f', p_partkey) AS source_reference FROM part WHERE p_size % 5 <> 0")
def plugged_extractor(s, d):
    texts = _made(s, d, {"project_id": "p_brand", "file_name": "concat('f', p_partkey)", "text": "CASE WHEN p_size % 5 = 0 THEN 'PLACEHOLDER' ELSE p_name END"})
    return takeoff.plugged_extractor(texts, lambda t: [{"description": t}]).select("project_id", "description", "trade", "confidence", "source_reference")


_FALSE = ("SECTION 09", "1. PROVIDE all", "i. $ 5", "Wall Base: EXIST", "Paint wall", "Color: STAIRS", "PROVIDE and COORDINATE WITH others", "Vinyl")


@query("default_filters", "SELECT p_partkey FROM part WHERE p_partkey % 8 IN (4, 7)")
def default_filters(s, d):
    said = F.element_at(F.array(*(F.lit(x) for x in _FALSE)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return rules.filter_by_rules(table(s, d, "part").select("p_partkey", said.alias("description")), [], fixed.DEFAULT_FILTERS).select("p_partkey")


@query("contained_items", "SELECT p_partkey FROM part n WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_brand = n.p_brand AND o.p_size < 10 AND contains(lower(concat('Round ', o.p_name, ' duct')), lower(n.p_name))) AND n.p_size >= 10")
def contained_items(s, d):
    new = _made(s, d, {"p_partkey": "p_partkey", "p_brand": "p_brand", "text": "p_name"}, where="p_size >= 10")
    old = _made(s, d, {"p_brand": "p_brand", "text": "concat('Round ', p_name, ' duct')"}, where="p_size < 10")
    return dedup.not_contained(new, old, ["p_brand"], "text").select("p_partkey")


# reports, filters, plugged-in models

_GROUPS = (("blue", ("blue", "navy")), ("any red", ("RED",)), ("none", ("zzzz",)))


@query(
    "category_report",
    "WITH h AS (SELECT p_brand, p_partkey, p_name, unnest(list_filter([CASE WHEN contains(lower(p_name), 'blue') OR contains(lower(p_name), 'navy') THEN 'blue' END, CASE WHEN contains(lower(p_name), 'red') THEN 'any red' END], lambda x: x IS NOT NULL)) AS category FROM part) "
    "SELECT p_brand, category, count(*) AS n, array_to_string(list_slice(list(p_name ORDER BY p_partkey), 1, 5), '|') AS first FROM h GROUP BY 1, 2",
)
def category_report(s, d):
    got = stats.category_report(table(s, d, "part"), ["p_brand"], _GROUPS, ["p_partkey"], text_col="p_name")
    return got.withColumn("first", F.array_join("first", "|"))


@query(
    "line_filter_keywords",
    """WITH l AS (SELECT source, doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT source, n::INT AS n, concat('Page ', doc_id, ': ', trim(line)) AS line FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos, line) AS n FROM l WHERE contains(lower(line), 'license') OR contains(lower(line), 'token')) WHERE n <= 30""",
)
def line_filter_keywords(s, d):
    return segment.keyword_lines(table(s, d, "documents"), ["source"], "doc_id", ("License", "token"))


@query("learned_rules", "SELECT p_partkey FROM part WHERE p_partkey % 8 NOT IN (0, 7)")
def learned_rules(s, d):
    said = F.element_at(F.array(*(F.lit(x) for x in _FALSE)), (F.col("p_partkey") % 8 + 1).cast("int"))
    learned = rules.learn_rules(lambda wrong, right: [{"pattern": f"^{w}$", "action": "remove"} for w in wrong] + [{"action": "remove"}], ["SECTION 09", "Vinyl"], ["Paint wall"], fixed.DEFAULT_FILTERS)
    return rules.filter_by_rules(table(s, d, "part").select("p_partkey", said.alias("description")), learned, fixed.DEFAULT_FILTERS).select("p_partkey")


@query("trade_filter", "SELECT p_partkey FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def trade_filter(s, d):
    part = table(s, d, "part").select("p_partkey", F.col("p_type").alias("trade"))
    return stats.of_trade(part, part.agg(F.min("trade")).first()[0]).select("p_partkey")


@query("project_search", "SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND (contains(lower(concat('P', p_partkey)), 'p1') OR contains(lower(p_name), 'p1'))")
def project_search(s, d):
    p = table(s, d, "part").select("p_partkey", F.expr("concat('P', p_partkey)").alias("project_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "sample").otherwise("challenge").alias("type"))
    return projects.search(p, "P1", "sample").select("p_partkey")


@query("load_ratio", "SELECT p_partkey, p_size / greatest(p_partkey % 9, 1) AS ratio, p_size / greatest(p_partkey % 9, 1) > 2.0 AS heavy, p_size / greatest(p_partkey % 9, 1) > 1.5 AS moderate, p_partkey % 4000 < 2048 AS low_memory FROM part")
def load_ratio(s, d):
    return table(s, d, "part").select("p_partkey", classify.load_flags(F.col("p_size").cast("double"), F.col("p_partkey") % 9, F.col("p_partkey") % 4000).alias("x")).select("p_partkey", "x.*")


@query(
    "llm_chunks",
    "SELECT p_partkey, seq, CASE seq WHEN 0 THEN concat('RTU-', p_size) ELSE p_name END AS description, CASE seq WHEN 0 THEN 'HVAC' ELSE 'Other' END AS trade, CASE seq WHEN 0 THEN 2.0::DOUBLE END AS quantity FROM part, (VALUES (0::BIGINT), (1::BIGINT)) v(seq) WHERE p_size % 5 <> 0",
)
def llm_chunks(s, d):
    def ask(prompt: str) -> str:
        """A stand-in for a model; it fails on some chunks, always."""
        import json

        said, size = prompt.rsplit("\n", 1)[1].split("|")
        if int(size) % 5 == 0:
            raise ConnectionError
        return f"Here: ```json\n{json.dumps({'items': [{'description': f'RTU-{size}', 'trade': 'HVAC', 'quantity': '2'}, {'description': said}]})}\n```"

    chunks = _made(s, d, {"p_partkey": "p_partkey", "kind": "'rtu'", "section": "concat(p_name, '|', p_size)"})
    return takeoff.chunk_items(chunks, ask, ["p_partkey"], attempts=2, wait=0.0).select("p_partkey", "seq", "description", "trade", "quantity")


# Headings and the kinds that they name and no parser reads.
_UNPARSED = (
    ("Door Schedule", "door_schedule"), ("LUMINAIRE SCHEDULE", "lighting_schedule"), ("Panel schedule", "electrical_schedule"), ("Plumbing fixture schedule", "plumbing_schedule"),
    ("SPRINKLER SCHEDULE", "fire_protection_schedule"), ("Equipment schedule", ""), ("Door hardware schedule, receptacle schedule", "door_schedule,electrical_schedule"), ("Schedule of finishes", ""),
)


@query("unparsed_schedules", f"SELECT p_partkey, kinds FROM part JOIN (VALUES {', '.join(f"({k}, '{kinds}')" for k, (_, kinds) in enumerate(_UNPARSED))}) v(k, kinds) ON p_size % {len(_UNPARSED)} = k")
def unparsed_schedules(s, d):
    heading = F.element_at(F.array(*(F.lit(h) for h, _ in _UNPARSED)), (F.col("p_size") % len(_UNPARSED) + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", F.array_join(classify.unparsed_schedules(F.concat_ws("\n", heading, "p_name", "p_type")), ",").alias("kinds"))


def _numbers(content: bytes) -> list[int]:
    return [int(x) for x in content.decode().split(",")]


@query("page_images", "SELECT p_partkey, n::INT AS page_number, (p_size + n)::VARCHAR AS said FROM part, (VALUES (1), (3)) v(n) WHERE p_size % 7 <> 0")
def page_images(s, d):
    def render(content: bytes, wanted) -> list[tuple[int, bytes]]:
        (size,) = _numbers(content)
        if size % 7 == 0:
            raise ValueError("damaged")
        return [(n, str(size + n).encode()) for n in range(1, 5) if wanted is None or n in wanted]

    found = table(s, d, "part").select("p_partkey", F.encode(F.col("p_size").cast("string"), "UTF-8").alias("content"))
    got = readers.images(found, render, ["p_partkey"], page_numbers=(1, 3))
    return got.select("p_partkey", "page_number", F.decode("image", "UTF-8").alias("said"))


@query(
    "page_regions",
    """WITH b AS (SELECT p_partkey, unnest([10, 700, p_size * 10])::DOUBLE AS x1, unnest([10, 690, 300])::DOUBLE AS y1, unnest([10 + p_size * 3, 900, p_size * 10 + 100])::DOUBLE AS x2, unnest([40, 780, 320])::DOUBLE AS y2, unnest([0.5, 0.5, 0.01])::DOUBLE AS fill FROM part)
    SELECT p_partkey, x1, y1, x2, y2, CASE WHEN (y1 + y2) / 2 > 680 AND (x1 + x2) / 2 > 600 THEN 'title_block' WHEN ((x1 + x2) / 2 > 600 AND y2 - y1 > 80) OR y2 - y1 > 240 THEN 'schedule' WHEN (y1 + y2) / 2 < 240 AND (x1 + x2) / 2 < 500 THEN 'notes' ELSE 'callout' END AS kind
    FROM b WHERE fill BETWEEN 0.05 AND 0.9 AND x2 - x1 BETWEEN 40 AND 4000 AND y2 - y1 BETWEEN 15 AND 4000 AND (x2 - x1) / (y2 - y1) BETWEEN 0.3 AND 15""",
)
def page_regions(s, d):
    def detect(image: bytes):
        (size,) = _numbers(image)
        return 1000, 800, [(10, 10, 10 + size * 3, 40, 0.5), (700, 690, 900, 780, 0.5), (size * 10, 300, size * 10 + 100, 320, 0.01)]

    return readers.regions(table(s, d, "part").select("p_partkey", F.encode(F.col("p_size").cast("string"), "UTF-8").alias("image")), detect, ["p_partkey"])


@query("vision_items", "SELECT p_brand, page_number, 0::BIGINT AS seq, concat('item ', p_size) AS description, 'Other' AS trade FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS page_number FROM part) WHERE page_number <= 3 AND p_size % 4 <> 0")
def vision_items(s, d):
    from pyspark.sql import Window

    def look(image: bytes) -> list[dict]:
        (size,) = _numbers(image)
        if size % 4 == 0:
            raise ValueError
        return [{"description": f"item {size}"}, {"description": ""}]

    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long")
    return readers.seen_items(table(s, d, "part").select("p_brand", n.alias("page_number"), F.encode(F.col("p_size").cast("string"), "UTF-8").alias("image")), look, ["p_brand"], most_pages=3)


@query("image_skew", "SELECT p_partkey, (p_partkey % 5 - 2)::DOUBLE AS turned, p_size > 0 AS level FROM part WHERE p_partkey <= 20")
def image_skew(s, d):
    """Pages of level lines, turned by a known angle, are found to be turned by it and level afterwards."""

    def run(batches):
        import numpy as np
        import pandas as pd

        from tallygrid.functions import image

        page = np.full((120, 120), 255.0)
        page[20:100:20, 10:110] = page[21:101:20, 10:110] = 0.0
        for pdf in batches:
            angles = [float(k % 5 - 2) for k in pdf["p_partkey"]]
            found = [-image.skew(image.rotated(page, a)) for a in angles]
            level = [image.row_variance(image.prepared(image.rotated(page, a))) > image.row_variance(image.rotated(page, 4)) for a in angles]
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "turned": [round(x, 6) + 0.0 for x in found], "level": level})

    return table(s, d, "part").where("p_partkey <= 20").select("p_partkey").mapInPandas(run, "p_partkey long, turned double, level boolean")



@query("workbook_sink", "SELECT p_brand AS project_id, count(*) AS items, md5(string_agg(p_name, '|' ORDER BY p_partkey)) AS said FROM part GROUP BY 1")
def workbook_sink(s, d):
    """The workbooks, read back: the number of lines and the descriptions of the sheet of line items."""
    items = _made(s, d, _LINES)
    other = items.where("seq % 5 = 0").select("project_id", "seq", "description")

    def run(batches):
        import hashlib
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        tag = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for pdf in batches:
            out = []
            for project, book in pdf.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(bytes(book))) as z:
                    names = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{tag}sheet")]
                    at = names.index("Line Items") + 1
                    column, n, digest = None, 0, hashlib.md5()
                    with z.open(f"xl/worksheets/sheet{at}.xml") as sheet:
                        # a row at a time; what was read is let go
                        for _, r in ElementTree.iterparse(sheet):
                            if r.tag != f"{tag}row":
                                continue
                            cells = ["".join(c.itertext()) for c in r]
                            r.clear()
                            if column is None:
                                column = cells.index("description")
                                continue
                            digest.update(f"{'|' if n else ''}{cells[column]}".encode())
                            n += 1
                out.append((project, n, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["project_id", "items", "said"])

    return sinks.workbooks(items, other, other).mapInPandas(run, "project_id string, items long, said string")


@query("inferred_items")
def inferred_items(s, d):
    """What projects imply; compared with the parser of whole projects in tests."""
    from tallygrid.plans.catalog import _pages

    return takeoff.inferred_items(_pages(s, d))


@query("takeoff_combined")
def takeoff_combined(s, d):
    from tallygrid.plans.catalog import _pages

    return takeoff.combined_items(_pages(s, d), lambda t: [{"description": f"{len(t)} characters"}])


# matching and pipelines, on made cases whose outcome is known


@query(
    "greedy_pairs",
    """WITH o AS (SELECT o_orderkey AS k, 60 + o_orderkey % 40 AS s00, 60 + o_orderkey * 7 % 40 AS s01, 60 + o_orderkey * 3 % 40 AS s10, 60 + o_orderkey * 11 % 40 AS s11 FROM orders)
    SELECT k AS project_id, 0::BIGINT AS e, CASE WHEN s00 >= s01 THEN 0 ELSE 1 END::BIGINT AS p, greatest(s00, s01)::DOUBLE AS score FROM o
    UNION ALL SELECT k, 1, CASE WHEN s00 >= s01 THEN 1 ELSE 0 END, CASE WHEN s00 >= s01 THEN s11 ELSE s10 END FROM o""",
)
def greedy_pairs(s, d):
    score = {(0, 0): 1, (0, 1): 7, (1, 0): 3, (1, 1): 11}
    pairs = F.array(*(F.struct(F.lit(e).cast("long").alias("e"), F.lit(p).cast("long").alias("p"), (60 + F.col("o_orderkey") * f % 40).cast("double").alias("score")) for (e, p), f in score.items()))
    return match.greedy(table(s, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.explode(pairs).alias("x")).select("project_id", "x.*"))


# Pairs of descriptions whose score is known without a ratio: one lies in the other, or a layer's bound decides.
_SCORED = (
    ("Junction Box", "Junction Box", 30.0),  # fewer than two shared words, even if equal
    ("tank", "big tank", 30.0),
    ("S-1 metal module face plate", "S-2 metal module face plate", 30.0),  # other tags
    ("S-1 ceiling diffuser module aluminum", "S-1 ceiling module aluminum sink", 35.0),  # the tag of another type
    ("S-1 ceiling diffuser module aluminum", "S-1 ceiling module aluminum", 40.0),  # the tag without the type's words
    ("S-1 ceiling diffuser module aluminum", "S-1 ceiling diffuser module", 100.0),
    ("ceiling mounted plate occupancy sensor", "ceiling mounted plate", 40.0),  # a critical word is missing
    ("metal round ducting", "big round ducting of metal", 100.0),  # short: sets of words
    ("porcelain tile flooring lobby", "lobby flooring porcelain tile grey", 100.0),
    ("porcelain tile flooring in lobby and in corridors", "new porcelain tile flooring in lobby and in corridors", 100.0),  # long: parts
    ("porcelain tile flooring in lobby and in corridors", "porcelain tile flooring in lobby and in corridors" + " with much else that was said" * 5, 70.0),
)


@query("score_layers", f"SELECT p_partkey, k, score FROM part, (VALUES {', '.join(f'({k}, {v}::DOUBLE)' for k, (_, _, v) in enumerate(_SCORED))}) v(k, score)")
def score_layers(s, d):
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(e).alias("e"), F.lit(p).alias("p")) for k, (e, p, _) in enumerate(_SCORED)))
    parts = table(s, d, "part").select("p_partkey")
    each = spread(parts, "p_partkey", rows=len(_SCORED) * parts.count()).select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", "x.*")
    return match.score_each(each, "e", "p").select("p_partkey", "k", "score")


_SAME, _ELSE = "porcelain tile flooring in lobby rooms", "something else entirely here"


@query(
    "match_reports",
    f"""SELECT p_partkey AS project_id, (p_partkey % 2 = 0)::INT AS matched_items, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '{_SAME}' END AS missing, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '{_ELSE}' END AS extra,
    CASE WHEN p_partkey % 2 = 0 THEN round(3 / p_size * 100, 2) END AS average_difference, CASE WHEN p_partkey % 2 = 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS coverage FROM part""",
)
def match_reports(s, d):
    expected = _made(s, d, {"project_id": "p_partkey", "seq": "CAST(0 AS BIGINT)", "description": f"'{_SAME}'", "quantity": "CAST(p_size AS DOUBLE)", "unit": "'SF'"})
    predicted = _made(s, d, {"project_id": "p_partkey", "seq": "CAST(0 AS BIGINT)", "description": f"CASE WHEN p_partkey % 2 = 0 THEN '{_SAME}' ELSE '{_ELSE}' END", "quantity": "CAST(p_size + 3 AS DOUBLE)", "unit": "'SF'"})
    got = match.report(expected, predicted)
    return got.select("project_id", "matched_items", F.array_join("missing_items", "|").alias("missing"), F.array_join("extra_items", "|").alias("extra"), "average_difference", "coverage")


_SMART = (("RTU-1", "hvac"), ("RTU-1 drive", "hvac"), ("pump", "hvac"), ("PUMP ", "hvac"), ("panel a left", "hvac"), ("Panel B", "hvac"), ("pump house", "plumbing"), ("vfd 1", "hvac"), ("VFD1", "plumbing"))


@query(
    "smart_survivors",
    "SELECT p_partkey AS project_id, seq, description, trade FROM part, (VALUES (0::BIGINT, 'RTU-1 drive', 'HVAC'), (2, 'pump', 'HVAC'), (4, 'panel a left', 'HVAC'), (5, 'Panel B', 'HVAC'), (6, 'pump house', 'Plumbing'), (7, 'vfd 1', 'HVAC')) v(seq, description, trade)",
)
def smart_survivors(s, d):
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("seq"), F.lit(said).alias("description"), F.lit(trade).alias("trade")) for i, (said, trade) in enumerate(_SMART)))
    items = table(s, d, "part").select(F.col("p_partkey").alias("project_id"), F.explode(rows).alias("x")).select("project_id", "x.*", F.lit(0.5).alias("confidence"))
    return dedup.smart(items, "project_id").select("project_id", "seq", "description", "trade")


@query("packed_blocks", "SELECT p_partkey, n::INT AS n, CASE n WHEN 0 THEN concat(chr(10), chr(10), 'aa') WHEN 1 THEN 'bb' ELSE concat('size ', p_size) END AS part FROM part, (VALUES (0), (1), (2)) v(n)")
def packed_blocks(s, d):
    said = F.concat(F.lit("aa\n\nbb\n\nsize "), F.col("p_size").cast("string"))
    return table(s, d, "part").select("p_partkey", F.posexplode(segment.split_blocks(said, 5)).alias("n", "part"))


@query(
    "all_spans",
    """SELECT p_partkey, 0 AS ord, 'number' AS name, s::INT AS start, (s + w)::INT AS "end", p_size::VARCHAR AS match FROM (SELECT p_partkey, p_size, length(p_size::VARCHAR) AS w, unnest([1, 6 + length(p_size::VARCHAR)]) AS s FROM part)
    UNION ALL SELECT p_partkey, 1, 'word', (1 + length(p_size::VARCHAR) + 1)::INT, (1 + length(p_size::VARCHAR) + 4)::INT, 'AND' FROM part""",
)
def all_spans(s, d):
    texts = _made(s, d, {"p_partkey": "p_partkey", "text": "concat('x', p_size, ' AND ', p_size)"})
    return segment.spans(texts, ["p_partkey"], [(r"\d+", "number"), (r"and", "word")]).drop("groups")


def _project_pages(s, d, *pages: tuple[str, str, str]) -> DataFrame:
    """A project a part, with the given (file, type, text) pages; ``{a}`` is the part's size."""
    rows = F.array(*(F.struct(F.lit(f).alias("file_id"), F.lit(f"{f}.pdf").alias("file_name"), F.lit(t).alias("file_type"), F.lit(i).alias("page_number"), F.replace(F.lit(x), F.lit("{a}"), F.col("p_size").cast("string")).alias("text")) for i, (f, t, x) in enumerate(pages, 1)))
    return table(s, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("project_id"), F.explode(rows).alias("x")).select("project_id", "x.*")


_FINISHES = "INTERIOR FINISH LEGEND\nGrey\nFlat\nP1\nLine X\nAcme\nPaint\nPNT-09"
_SHEET = "ROOM FINISH SCHEDULE\nNO\n101\nLobby\nstone\n-\nnone\n-\nPNT-09/WC-1\n-\nopen\nopen\n9'-0\n-\n-\n-"
_FINE = "chr(10) || '-Mfg: Acme' || chr(10) || '-Color: Grey' || chr(10) || '-Type: Flat'"


@query(
    "pipeline_context",
    f"""SELECT concat('P', p_partkey) AS project_id, seq, CASE seq WHEN 1 THEN 'PNT-09 (9''-0" High):' || {_FINE} ELSE concat('VAV-', p_size, ': Local Source  (VAV Unit)') END AS description, CASE seq WHEN 1 THEN 'Painting' ELSE 'Mechanical' END AS trade,
    CASE seq WHEN 1 THEN 'SF' ELSE 'EA' END AS unit, CASE seq WHEN 1 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence, CASE seq WHEN 1 THEN 'Finish Legend: PNT-09' ELSE 'm.pdf' END AS source_reference FROM part, (VALUES (1::BIGINT), (2::BIGINT)) v(seq)""",
)
def pipeline_context(s, d):
    pages = _project_pages(s, d, ("plan", "drawing", _FINISHES), ("plan", "drawing", _SHEET), ("m", "drawing", "EQUIPMENT SCHEDULE\nVAV-{a} 450 CFM MODEL TBD"), ("spec", "spec", "EQUIPMENT SCHEDULE\nVAV-9 450 CFM"))
    return takeoff.extract_project(pages, "context").drop("quantity")


@query(
    "pipeline_default",
    """SELECT concat('P', p_partkey) AS project_id, description, trade, quantity, unit FROM part, (VALUES ('PNT-09: Acme Interior Paint, Color: Grey, Type: Flat', 'Painting', NULL::DOUBLE, NULL), ('Ductwork', 'HVAC', NULL, 'EA'),
    ('Management & Supervision', 'General', 1.0, 'EA'), ('Documentation & Shop Drawings', 'General', 1.0, 'LS'),
    (concat('PNT-09 (9''-0 High):', chr(10), '-Mfg: Acme', chr(10), '-Color: Grey', chr(10), '-Type: Flat'), 'Painting', 1.0, 'RM')) v(description, trade, quantity, unit)""",
)
def pipeline_default(s, d):
    pages = _project_pages(s, d, ("plan", "drawing", _FINISHES), ("plan", "drawing", _SHEET), ("spec", "spec", "233113 - Metal Ducts"))
    return takeoff.extract_project(pages).select("project_id", "description", "trade", "quantity", "unit")


@query(
    "pipeline_rules",
    """SELECT concat('P', p_partkey) AS project_id, description, trade, quantity, unit FROM (SELECT p_partkey, unnest([concat('Furnish ', p_size, ' EA doors of oak'), concat('Install new carpet tile, ', p_size, ' SF of it')]) AS description, unnest(['Doors', 'Flooring']) AS trade, p_size::DOUBLE AS quantity, unnest(['EA', 'SF']) AS unit FROM part)""",
)
def pipeline_rules(s, d):
    pages = _project_pages(s, d, ("scope", "sow", "Furnish {a} EA doors of oak\nInstall new carpet tile, {a} SF of it\nWords about nothing to be done"))
    return takeoff.extract_project(pages, "rules").select("project_id", "description", "trade", "quantity", "unit")


@query(
    "pipeline_combined",
    """SELECT concat('P', p_partkey) AS project_id, description, trade FROM (SELECT p_partkey, unnest([concat('Furnish ', p_size, ' EA doors of oak'), 'seen: lighting fixture schedule']) AS description, unnest(['Doors', 'Other']) AS trade FROM part)""",
)
def pipeline_combined(s, d):
    pages = _project_pages(s, d, ("scope", "sow", "Furnish {a} EA doors of oak"), ("e", "other", "lighting fixture schedule"))
    return takeoff.combined_items(pages, lambda t: [{"description": f"seen: {t}"}, {"description": "PLACEHOLDER"}]).select("project_id", "description", "trade")


# files that are written and read again, and streams


@query("prediction_files", f"SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY seq) - 1 AS seq, description, trade, quantity, unit FROM ({_cte(_LINES)})")
def prediction_files(s, d):
    path = scratch(s, "predictions")
    sinks.write_predictions(_made(s, d, _LINES), path)
    return readers.predictions(s, path).select("project_id", "seq", "description", "trade", "quantity", "unit")


@query("report_files", "SELECT p_partkey AS project_id, p_size % 10 AS matched_items, p_name AS overall_notes FROM part")
def report_files(s, d):
    path = scratch(s, "reports")
    sinks.write_reports(_made(s, d, {"project_id": "p_partkey", "matched_items": "p_size % 10", "overall_notes": "p_name"}), path)
    return s.read.schema("project_id long, matched_items int, overall_notes string").json(path)


@query("registry_file", "SELECT concat('P', p_partkey) AS project_id, concat('/r/c/P', p_partkey, ' - site') AS path FROM part WHERE p_partkey % 2 = 0")
def registry_file(s, d):
    """Registries, a JSON array a file, of a bounded number of projects each."""
    path, bucket = scratch(s, "registry"), F.pmod(F.xxhash64("project_id"), F.lit(16))
    _registry(s, d).groupBy(bucket.alias("b")).agg(F.to_json(F.collect_list(F.struct("project_id", "path"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.registry(s, path, "project_id string, path string")


@query("listed_entries", "SELECT concat('/r/c/P', p_partkey, ' - site', tail) AS path FROM part, (VALUES ('', 1), ('/Project Files', 1), ('/Project Files/a.PDF', 1), ('/Expected Manual Output', 3), ('/Expected Manual Output/b.xlsx', 3), ('/Expected Manual Output/c.pdf', 3)) v(tail, k) WHERE p_partkey % k = 0")
def listed_entries(s, d):
    return readers.listed(_listing(s, d)).select("path")


@query("scanned_folder", "SELECT concat(p_size, '.pdf') AS name, count(*) AS n FROM (SELECT p_size FROM part WHERE p_size < 4) GROUP BY 1")
def scanned_folder(s, d):
    """Files found below a folder, by the number of rows that each was made of."""
    path = scratch(s, "folder")
    table(s, d, "part").where("p_size < 4").select(F.concat(F.col("p_size").cast("string"), F.lit(".pdf")).alias("name"), F.lit("x").alias("value")).repartition("name").write.partitionBy("name").text(path)
    found = readers.files(s, path, "*.txt").select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "length")
    return found.groupBy("name").agg((F.sum("length") / 2).cast("long").alias("n"))


def _streamed(s: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives until its source is read, all batches together."""
    path = scratch(s, "stream")
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, _: rows.write.mode("append").parquet(f"{path}/rows")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{path}/rows")


def _event_files(s, d) -> str:
    """The events as the files of a job log, of which one batch takes all."""
    path = scratch(s, "events")
    _made(s, d, {"job_id": "CAST(user_id AS STRING)", "project_id": "CAST(event_id AS STRING)", "ts": "ts", "kind": "event_type", "message": _LOG}, "events").write.json(path)
    return path


@query("stream_log_tail", f"SELECT user_id::VARCHAR AS job_id, coalesce(arg_max({_STAGE}, (ts, event_id)) FILTER ({_STAGE} IS NOT NULL), '') AS stage, count(*) AS lines FROM events GROUP BY 1")
def stream_log_tail(s, d):
    got = _streamed(s, stages.track_stages(stages.read_events(s, _event_files(s, d), files_per_trigger=10_000)), "update")
    return got.groupBy("job_id").agg(F.max_by("stage", "lines").alias("stage"), F.max("lines").alias("lines"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(s, d):
    got = _streamed(s, stages.event_counts(stages.read_events(s, _event_files(s, d), files_per_trigger=10_000)), "update")
    return got.groupBy("start", "kind").agg(F.max("n").alias("n"))


@query("resumed_work", f"SELECT event_id::VARCHAR AS event_id, upper({_LOG}) AS said FROM events")
def resumed_work(s, d):
    """Work that is begun anew, without its checkpoint, does nothing twice."""
    source, path = _event_files(s, d), scratch(s, "work")
    for k in range(2):
        stream = stages.read_events(s, source).select(F.col("project_id").alias("event_id"), "message")
        stages.resume(stream, lambda rows: rows.select("event_id", F.upper("message").alias("said")), f"{path}/rows", f"{path}/state-{k}", ["event_id"]).awaitTermination()
    return s.read.parquet(f"{path}/rows")
