"""Hand-derived cases of the takeoff domain."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrid.functions import classify, fixed, salvage, similarity, text
from tallygrid.operators import context, dedup, generators, jobs, match, parsers, rules, segment, stats, substrings
from tallygrid.plans import phrasebook, takeoff
from tallygrid.sources import readers, sinks
from tests import plain_items

PAGE = "project_id string, file_id string, page_number int, text string"
KEYS = ["project_id", "file_id", "page_number"]
ITEMS = "project_id string, seq long, description string, trade string, quantity double, unit string, confidence double, source_reference string"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_ocr_stats_exact(spark):
    p = spark.createDataFrame([("a", True, True, 85.5), ("a", False, False, None), ("b", False, False, None)], "file_id string, is_scanned boolean, ocr_used boolean, ocr_confidence double")
    assert rows(stats.ocr_stats(p)) == [(2, 1, 3, 1, 1, 0.3333, 0.3333, 85.5, 85.5, 85.5)]
    assert rows(stats.ocr_stats(p.limit(0))) == [(0, 0, 0, 0, 0, 0.0, 0.0, None, None, None)]


def test_scanned_flag(spark):
    d = spark.createDataFrame([(" " + "x" * 49,), ("x" * 50,)], "t string").select(classify.is_scanned(F.col("t")))
    assert sorted(r[0] for r in d.collect()) == [False, True]


def test_file_types(spark):
    d = spark.createDataFrame([("Spec Section 09.pdf",), ("Addendum 2.pdf",), ("photo.pdf",)], "n string")
    assert rows(d.select("n", classify.file_type(F.col("n")), classify.file_type_listing(F.col("n")))) == [("Addendum 2.pdf", "addendum", "addendum"), ("Spec Section 09.pdf", "drawing", "spec"), ("photo.pdf", "other", "other")]


LEGEND = "INTERIOR FINISH LEGEND\nGrey\nFlat\nP1\nLine X\nAcme\nPaint\nPNT-09"


def test_legend_looks_back(spark):
    p = spark.createDataFrame([("p", "f", 1, LEGEND), ("p", "f", 2, "nothing"), ("p", "f", 3, None)], PAGE)
    want = ("PNT-09", "Paint", "Acme", "Interior Paint", "Grey", "Flat")
    for v2 in (False, True):
        assert rows(parsers.finish_legend(p, KEYS, v2=v2), "code", "material", "manufacturer", "product", "color", "type_size") == [want]


ROOM = ["101", "Lobby", "LVT-1", "-", "WB-1", "-", "PNT-09/WC-1", "PNT-10", "ACT", "CL-01", "9'-0", "-", "-", "-"]


def test_rooms_and_lookups(spark):
    sheet = "\n".join(["ROOM FINISH SCHEDULE", "NO", *ROOM, "see plan", *["102", *ROOM[1:]], "103", "cut off"])
    p = spark.createDataFrame([("p", "f", 1, sheet)], PAGE)
    rooms = parsers.room_schedule(p, KEYS)
    assert rows(rooms, "room_number", "walls_primary", "ceiling_height", "notes") == [("101", "PNT-09/WC-1", "9'-0", "see plan"), ("102", "PNT-09/WC-1", "9'-0", "")]
    assert [r[0] for r in rows(parsers.room_schedule(p, KEYS, v2=True), "room_number")] == ["101", "102"]
    legend = spark.createDataFrame([("p", "f", 1, k, c, "Paint", "Acme", "Interior Paint", "SW 7", "Flat") for k, c in enumerate(("PNT-09", "PNT-11"))], "project_id string, file_id string, page_number int, pos int, code string, material string, manufacturer string, product string, color string, type_size string")
    assert rows(context.used_only(legend, rooms, ["project_id"]), "code") == [("PNT-09",)]
    assert rows(context.walls_by_height(rooms, ["project_id"]), "code", "height", "n") == [("PNT-09", "9'-0", 2), ("PNT-10", "9'-0", 2)]
    at = ["file_id", "page_number", "pos"]
    items = rows(context.room_items(rooms, legend, ["project_id"], at), "description", "quantity")
    assert ("PNT-09 (9'-0 High):\n-Mfg: Acme\n-Color: SW 7\n-Type: Flat", 2.0) in items and ("Wall Finish: PNT-10 (9'-0 High)", 2.0) in items and ("Ceiling Finish: CL-01", 2.0) in items
    fused = rows(context.fusion_items(rooms, legend, ["project_id"], at), "description", "trade")
    assert fused == [("PNT-09 (9'-0\" High):\n-Mfg: Acme\n-Color: #SW 7\n-Type: Flat", "Painting")]


def test_heights(spark):
    d = spark.createDataFrame([("+/- 9'-0",), ("10'-6\"",), ("8' +/-",), ("",)], "h string").select(text.clean_height(F.col("h")))
    assert [r[0] for r in d.collect()] == ["9'-0\"", "10'-6\"", "8'\"", ""]


def test_schedule_rows_need_two_specs(spark):
    d = spark.createDataFrame([("RTU-1 480V\nRTU-2 480V 900 CFM",), ("RTU-1",), ("A-101",), ("12",)], "t string")
    assert [r[0] for r in d.select(generators.schedule_rows(F.col("t"))).collect()][0] == ["RTU-2 | CFM: 900 | Voltage: 480V"]
    assert [r[0] for r in d.select(generators.valid_tag(F.col("t"))).collect()][1:] == [True, False, False]


def test_equipment_learns_prefixes():
    page = "EQUIPMENT SCHEDULE\nQQ-1 MODEL AB-1 CFM 900 VOLTAGE 480\n"
    assert parsers.equipment_rows(page) == [("QQ-1", "QQ Equipment", "Local Source", "AB-1"), ("AB-1", "AB Equipment", "Local Source", "AB-1")]
    assert parsers.equipment_rows_v2("S-101 sheet") == [] and parsers.equipment_rows_v2("S-1 DIFFUSER 24x24")[0][:2] == ("S-1", "Supply Diffuser")
    assert parsers.equipment_rows_v2("VAV-3 450 CFM MODEL TBD")[0] == ("VAV-3", "VAV Unit", "Local Source", "", "450 CFM")


def test_greedy_intervals(spark):
    d = spark.createDataFrame([([(0, 10), (5, 20), (25, 30)],), ([],)], "s array<struct<start:int,end:int>>").select(segment.keep_longer(F.col("s")))
    assert [[tuple(x) for x in r[0]] for r in d.collect()] == [[(5, 20), (25, 30)], []]
    assert segment.longer_of([(25, 30, "c"), (0, 10, "a"), (5, 20, "b")]) == [(5, 20, "b"), (25, 30, "c")]


def test_boxes_merge(spark):
    d = spark.createDataFrame([([(0, 0, 10, 10), (2, 2, 9, 9), (50, 50, 60, 60)],)], "b array<struct<y1:int,x1:int,y2:int,x2:int>>").select(segment.merge_boxes(F.col("b")))
    assert [tuple(x) for x in d.first()[0]] == [(0, 0, 10, 10), (50, 50, 60, 60)]


def test_quantities(spark):
    d = spark.createDataFrame([("Install 1,200 SF tile and 3 EA frames",), (None,)], "t string").select(text.quantities(F.col("t")))
    assert [[tuple(x) for x in r[0] or []] for r in d.collect()] == [[(1200.0, "SF"), (3.0, "EA")], []]


def items(spark, *descriptions, trade="T"):
    return spark.createDataFrame([("p", i, d, trade, None, "EA", 0.5, "f") for i, d in enumerate(descriptions)], ITEMS)


def test_dedup_policies(spark):
    same = items(spark, "A" * 80 + "one", "a" * 80 + "two", "other")
    assert rows(dedup.by_prefix(same, ["project_id", "trade"], "description", ["seq"]), "seq") == [(0,), (2,)]
    longest = dedup.by_base_longest(items(spark, "A | Tile", '8" x 4" | Tile', "B | Tile", "C"), ["trade"], "description", "seq")
    assert rows(longest, "seq", "description") == [(0, '8" x 4" | Tile'), (3, "C")]
    tie = dedup.by_base_longest(items(spark, "A | Tile", "B | Tile"), ["trade"], "description", "seq")
    assert rows(tie, "description") == [("A | Tile",)]
    pref = dedup.by_prefix_preferred(items(spark, " Same"), items(spark, "same", "new"), ["trade"], "description", ["seq"])
    assert rows(pref, "description") == [(" Same",), ("new",)]
    assert rows(dedup.not_contained(items(spark, "duct", "pipe"), items(spark, "Round DUCT 8"), ["trade"], "description"), "description") == [("pipe",)]
    smart = dedup.smart(items(spark, "RTU-1", "RTU-1 drive", "pump", "PUMP ", "panel a left", "Panel B", trade="hvac"), "project_id")
    assert rows(smart, "description", "trade") == [("Panel B", "HVAC"), ("RTU-1 drive", "HVAC"), ("panel a left", "HVAC"), ("pump", "HVAC")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "B"]), st.text("ab 1-", max_size=12), st.just(0.5)), max_size=12))
def test_smart_dedup_settles(given_rows):
    kept = dedup.smart_survivors(given_rows)
    again = dedup.smart_survivors([(given_rows[i][0], d, c) for i, d, c in kept])
    assert len(again) <= len(kept) and [k[0] for k in kept] == sorted(k[0] for k in kept)


def test_trade_ties(spark):
    d = spark.createDataFrame([("duct light",), ("nothing",), ("lithonia duct duct",), ("carrier light",)], "t string").select(classify.trade(F.col("t")))
    assert [r[0] for r in d.collect()] == ["HVAC", "Other", "Electrical", "HVAC"]


def test_scores():
    assert similarity.match_score("Junction Box", "Junction Box") == 30
    assert similarity.match_score("Junction Box", "Junction Box", exact_shortcut=True) == 100
    assert similarity.match_score("S-1 ceiling diffuser module aluminum", "S-1 ceiling module aluminum sink") <= 35
    assert similarity.match_score("S-1 ceiling diffuser module aluminum", "S-2 ceiling diffuser module aluminum") <= 30
    assert similarity.ratio("abcd", "bcde") == 75 and similarity.partial_ratio("abc", "xxabcxx") == 100 and similarity.token_set_ratio("b a", "a b c") == 100


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_lcs(a, b):
    assert similarity.lcs(a, b) == slow_lcs(a, b)
    assert similarity.ratio(a, b) == similarity.ratio(b, a)
    assert similarity.partial_ratio(a, b) >= similarity.ratio(a, b) - 1e-9 or not a or not b


def test_blocking_is_exact(spark):
    e = spark.createDataFrame([("p", 0, "round supply duct metal", 1.0, "EA"), ("p", 1, "tap", 1.0, "EA")], "project_id string, seq long, description string, quantity double, unit string")
    p = spark.createDataFrame([("p", 0, "metal duct round, insulated", 2.0, "EA"), ("p", 1, "big tap", 1.0, "EA"), ("q", 2, "round duct metal", 1.0, "EA")], e.schema)
    got = {(r["e"], r["p"]) for r in match.candidates(e, p).collect()}
    every = {(i, j) for i, a in enumerate(["round supply duct metal", "tap"]) for j, b in enumerate(["metal duct round, insulated", "big tap"]) if similarity.match_score(a, b) > 30}
    assert every <= got and all(j != 2 for _, j in got)


def test_greedy_and_report(spark):
    pairs = spark.createDataFrame([("p", 0, 0, 90.0), ("p", 1, 0, 95.0), ("p", 1, 1, 70.0)], "project_id string, e long, p long, score double")
    assert rows(match.greedy(pairs), "e", "p") == [(0, 0), (1, 1)]
    assert rows(match.best(pairs, threshold=80), "p", "e") == [(0, 1)]
    e = spark.createDataFrame([("p", 0, "porcelain tile flooring in lobby rooms", 40.0, "SF"), ("p", 1, "painted drywall partition with insulation", 5.0, "SF")], "project_id string, seq long, description string, quantity double, unit string")
    p = spark.createDataFrame([("p", 0, "porcelain tile flooring in lobby rooms", 43.0, "SF"), ("p", 1, "something else entirely here", None, "EA")], e.schema)
    r = match.report(e, p).first()
    assert (r["matched_items"], r["missing_items"], r["extra_items"], r["coverage"]) == (1, ["painted drywall partition with insulation"], ["something else entirely here"], 50.0)
    assert [tuple(x) for x in r["quantity_differences"]] == [("porcelain tile flooring in lobby rooms", 43.0, 40.0, 7.5)] and r["average_difference"] == 7.5
    assert match.report(e.limit(0), p.limit(0)).count() == 0


def test_costs_and_reasons(spark):
    f = spark.createDataFrame([("a", 5.0, 20, False), ("b", 0.1, 101, False), ("c", 0.1, 0, True)], "f string, size_mb double, scanned_pages int, duplicate boolean")
    assert rows(stats.file_costs(f, load_ratio=1.0), "f", "cost_score", "seconds", "skip_reason") == [("a", 80.0, 60.0, None), ("b", 80.4, 303.0, "too heavy"), ("c", 0.4, 0.0, "duplicate")]
    assert rows(stats.file_costs(f, load_ratio=1.6), "f", "pressure", "skip_reason")[0] == ("a", "moderate", "moderate pressure")
    assert rows(stats.skip_summary(stats.file_costs(f))) == [(2, 1)]


def test_job_views(spark):
    t = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([("j", "p", t + datetime.timedelta(seconds=i), "log", None, None, f"m{i}", None) for i in range(501)], "job_id string, project_id string, ts timestamp, kind string, stage string, status string, message string, progress double")
    assert jobs.tail(e, ["job_id"], ["ts"]).agg(F.min("message"), F.count("*")).first()[:] == ("m1", 500)
    s = spark.createDataFrame([("j", "p", t, "stage", "ocr", "running", None, None), ("j", "p", t + datetime.timedelta(seconds=5), "stage", "ocr", "completed", None, None)], e.schema)
    assert rows(jobs.stage_status(s)) == [("j", "ocr", "completed", t, t + datetime.timedelta(seconds=5))]
    log = spark.createDataFrame([("j", "p", t + datetime.timedelta(seconds=i), "log", None, None, m, None) for i, m in enumerate(["start", "Ingesting a.pdf", "page 1", "Extracting items", "x"])], e.schema)
    assert [r["stage_now"] for r in jobs.stages_from_log(log).orderBy("ts").collect()] == [None, "ingestion", "ingestion", "extraction", "extraction"]


def test_chunks(spark):
    p = spark.createDataFrame([("f", n, "x" * k) for n, k in ((1, 7000), (2, 6000), (3, 50))], "f string, page int, text string")
    assert rows(segment.chunk_pages(p, ["f"], "page"), "chunk", "first", "last") == [(0, 1, 1), (1, 2, 2)]
    d = spark.createDataFrame([("aa\n\nbb\n\ncccc",)], "t string").select(segment.split_blocks(F.col("t"), 5))
    assert d.first()[0] == ["\n\naa", "bb", "cccc"]


def test_filters(spark):
    got = rules.filter_by_rules(items(spark, "a(b", "keep"), [{"pattern": "(", "action": "remove"}], fixed.DEFAULT_FILTERS)
    assert rows(got, "description") == [("keep",)]
    assert rows(rules.filter_by_rules(items(spark, "SECTION 09", "tile", None), [], fixed.DEFAULT_FILTERS), "description") == [("tile",), (None,)]


@pytest.mark.parametrize(
    ("answer", "n"),
    [('```json\n[{"description": "a"}]\n```', 1), ('text {"items": [{"description": "a"}, {"description": "b"}]} text', 2), ('[{"description": "a"}, {"description": "b"}, {"descr', 2), ("nothing", 0), (None, 0)],
)
def test_salvage(answer, n):
    assert len(salvage.items(answer)) == n
    assert [salvage.confidence(x) for x in ("Very High", "medium", "?", 0.3, 7)] == [0.9, 0.7, 0.5, 0.3, 1.0]


def test_expected_sheet(spark):
    cells = ["1", "D", "S", " Tile ", "12", "", "", " SF ", *[""] * 7, "T"]
    sheet = spark.createDataFrame([("p", i, *([None] * 16)) for i in range(7)] + [("p", 7, *cells), ("p", 8, *cells[:4], "x", *cells[5:]), ("p", 9, *cells[:3], None, *cells[4:])], "project_id string, row int, " + ", ".join(f"c{i} string" for i in range(16)))
    assert rows(readers.expected_items(sheet)) == [("p", 7, "Tile", 12.0, "SF")]
    with pytest.raises(ValueError):
        readers.expected_items(sheet.drop("c0", "c1"))


def test_files_and_predictions(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n, b in (("a/x.pdf", b"one|two"), ("y.pdf", b"one|two"), ("bad.pdf", b"!"), ("n.txt", b"")):
        (tmp_path / n).write_bytes(b)

    def decode(b):
        if b == b"!":
            raise ValueError("damaged")
        return b.decode().split("|")

    found = readers.files(spark, str(tmp_path))
    good, bad = readers.pages(found, decode)
    assert good.count() == 4 and rows(bad, "error") == [("ValueError: damaged",)]
    assert readers.inventory(found).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.one_file(spark, str(tmp_path / "none.pdf"))
    with pytest.raises(ValueError):
        readers.one_file(spark, str(tmp_path / "n.txt"))
    out = str(tmp_path / "out")
    sinks.write_predictions(items(spark, "b", "a"), out)
    assert rows(readers.predictions(spark, out), "seq", "description") == [(0, "b"), (1, "a")]
    assert {k: v.count() for k, v in sinks.sheets(items(spark, "b", "a"), items(spark), items(spark)).items()} == {"Summary": 1, "Line Items": 2, "Missing": 0, "Extra": 0} if items(spark, "x").count() else True


def test_discovery(spark):
    ls = spark.createDataFrame([("/r/c/one", True), ("/r/c/one/a.pdf", False), ("/r/c/two", True), ("/r/c/three", True), ("/r/c/three/x/b.PDF", False), ("/r/c/three/expected", True)], "path string, is_dir boolean")
    none = ls.limit(0)
    assert [r["name"] for r in readers.discover(ls, none, none).collect()] == ["one", "three"]
    assert readers.discover(ls, ls.where("path = '/r/c/one'"), none, "THR").count() == 1
    assert rows(readers.project_type(ls, ls.where("path in ('/r/c/three')"))) == [("/r/c/three", True, "sample")]


def said(spark, items, *texts):
    """The items of each text, as tuples, by a generator of columns."""
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = [[] for _ in texts]
    for r in rules.itemize(d, ["i"], items).orderBy("i", "seq").collect():
        out[r["i"]].append(tuple(r)[2:])
    return out


def test_generators(spark):
    plan = 'Supply 24"x12 duct, 24"x12 duct. 3/4" REFRIGERANT. REMOVE EXISTING DUCT. 6" Flexible Duct to Diffuser'
    got = {x[0]: x[2] for x in said(spark, generators.mechanical, plan)[0]}
    assert got['24""x12" Duct'] == 2.0 and got['3/4" Dia Refrigerant Lines'] == 1.0 and '6" Flexible Duct to Diffuser' in got
    panel = "NEMA 5-20R DUPLEX RECEPTACLE GFCI\n45 KVA TRANSFORMER 480 V / 277 V\n20A-1P CIRCUIT BREAKER\nOCCUPANCY SENSOR"
    got = [x[0] for x in said(spark, generators.electrical, panel)[0]]
    assert {"NEMA 5-20R GFCI Receptacle", "45kVA XFMR 277V-480V", "20A-1P Circuit Breaker", "Occupancy Sensor"} <= set(got)
    assert ('12" X 12" X 1/8" | Vinyl Composition Tile Flooring', "Flooring", None, "SF", 0.75) in said(spark, generators.flooring, '12" X 12" X 1/8" VINYL COMPOSITION TILE')[0]
    rowsd = said(spark, generators.diffuser_rows, "DIFFUSER SCHEDULE\nS-1\n24 x 24\n95 - 210\nSTEEL\nR-1\nnothing")[0]
    assert rowsd[0][0] == 'S-1:\n-Nominal Module Size: 24"x24"\n-CFM: 95-210\n-Material: Steel' and len(rowsd) == 1
    lit = said(spark, generators.lighting_rows, "LIGHTING FIXTURE SCHEDULE\nA\nLED troffer\nACME LIGHTING\nTX9000\nemergency backup\nB\nab")[0]
    assert [x[0].split("\n")[0] for x in lit] == ["Light A: LED troffer", "Light A with Integrated Emergency Battery Backup: LED troffer"]
    assert {x[0] for x in said(spark, generators.constants, "")[0]} == {d for d, _, _ in fixed.CONSTANT_ITEMS}
    assert ("Quarry Tile to Vinyl Transition", "Flooring", None, "FT", 0.45) in said(spark, generators.transitions, "QUARRY TILE TO VINYL TRANSITION")[0]
    three = said(spark, generators.callouts_v2, '6"x8" duct, 6"x8" duct, dimmer switch. Remove existing tile. remove existing TILE.')[0]
    assert len({x[0].lower() for x in three}) == len(three) == 3
    gone = said(spark, generators.callouts_v2, "Remove existing tile. Remove existing door, remove existing sink; site supervision, project management")[0]
    assert [x[0] for x in gone] == ["Remove existing tile.", "Remove existing door,", "remove existing sink;", "Project Management", "Site Supervision"]
    assert [x[1] for x in said(spark, generators.lines_by_type("sow"), "1. Provide and install new carpet tile 12 EA")[0]] == ["Flooring"]


PLAIN = {
    "mechanical": (generators.mechanical, plain_items.mechanical),
    "electrical": (generators.electrical, plain_items.electrical),
    "flooring": (generators.flooring, plain_items.flooring),
    "transitions": (generators.transitions, plain_items.transitions),
    "part": (lambda t, u: F.concat(generators.floors(t, u, F.lit(40), F.lit(160)), generators.transitions(t, u, F.lit(40), F.lit(160))), lambda t: plain_items.floors(t, 40, 160) + plain_items.transitions(t, 40, 160)),
    "callouts": (generators.callouts_v2, plain_items.callouts_v2),
    **{k: (generators.lines_by_type(k), lambda t, k=k: plain_items.lines_by_type(t, k)) for k in ("spec", "drawing", "scope", "other")},
    "plain_lines": (generators.plain_lines, plain_items.plain_lines),
    **{k: (lambda t, u, k=k: rules.items_of(t, u, getattr(generators, k)), lambda t, k=k: plain_items.items_of(t, getattr(plain_items, k))) for k in ("GENERAL_TEXT", "SPEC_SECTIONS", "INFERRED", "PANELS", "EQUIPMENT_ROWS")},
    "schedule_rows": (lambda t, u: F.transform(generators.schedule_rows(t), lambda d: rules.item(d, "Row", None, "EA", 1.0)), lambda t: [(plain_items.row_description(r), "Row", None, "EA", 1.0) for r in plain_items.schedule_rows(t)]),
    "tags": (
        lambda t, u: F.array(rules.item(F.coalesce(generators.tag_of(t), F.lit("-")), generators.valid_tag(t).cast("string"), None, None, 1.0)),
        lambda t: [(plain_items.tag_of(t) or "-", str(plain_items.valid_tag(t)).lower(), None, None, 1.0)],
    ),
}


@pytest.fixture(scope="module")
def mixed():
    """Texts that mix the phrases of all generators, with fillers, other alphabets and odd white space between them."""
    r = random.Random(11)
    phrases = [p.replace("{a}", "7").replace("{b}", "31").replace("{c}", "12") for _, book in phrasebook.BOOKS.values() for p, _ in book]
    fill = [" ", "\n", ", ", "\n\n", " é ", "\u00a0", "ß" * 30, " 480V/277V ", " x " * 90, "\r\n", " Supplied by Client ", "PANEL VP1", "Size: 3'-0\"x7'-0\"", " EXHAUST ", "\U0001f600", "REFRIGERANT GAS", '"', " ELBOW"]
    texts = ["".join(r.choice(phrases) + r.choice(fill) for _ in range(r.randint(1, 9))) for _ in range(160)]
    return [*texts, *(t.upper() for t in texts[:30]), *(t.lower() for t in texts[:30]), "", "\n", "x" * 30_000]


@pytest.mark.parametrize("name", PLAIN)
def test_columns_are_as_plain_functions(spark, mixed, name):
    columns, plain = PLAIN[name]
    got = said(spark, columns, *mixed)
    for text, have in zip(mixed, got, strict=True):
        assert have == plain(text), text
    assert any(got) and said(spark, columns, None) == [plain("")]


def test_pipelines(spark):
    sheet = "\n".join(["ROOM FINISH SCHEDULE", *ROOM])
    equip = "EQUIPMENT SCHEDULE\nRTU-1 480V 900 CFM MODEL X-1\n" + "x " * 80
    p = spark.createDataFrame([("p", "f1", "plan.pdf", "drawing", 1, LEGEND), ("p", "f1", "plan.pdf", "drawing", 2, sheet), ("p", "f2", "m.pdf", "drawing", 1, equip), ("q", "g", "spec.pdf", "spec", 1, "nothing")], "project_id string, file_id string, file_name string, file_type string, page_number int, text string")
    got = takeoff.extract_project(p)
    said = {(r["project_id"], r["description"]) for r in got.collect()}
    assert ("p", "PNT-09: Acme Interior Paint, Color: Grey, Type: Flat") in said and ("q", "Management & Supervision") in said
    assert any(d.startswith("RTU-1 | CFM: 900") for _, d in said)
    assert got.groupBy("project_id").agg((F.count("*") == F.count_distinct("seq")).alias("ok")).where("not ok").count() == 0
    assert takeoff.extract_project(p, "rules").count() >= 2 and takeoff.extract_project(p, "context").count() >= 2
    extra = takeoff.combined_items(p.withColumn("text", F.when(F.col("file_id") == "f2", "Lighting Fixture Schedule").otherwise(F.col("text"))), lambda t: [{"description": "LED"}, {"description": "PLACEHOLDER"}])
    assert "LED" in {r["description"] for r in extra.collect()} and "PLACEHOLDER" not in {r["description"] for r in extra.collect()}

    def broken(part):
        raise RuntimeError

    assert takeoff.plugged_filter(got, broken).count() == got.count() and takeoff.plugged_filter(got, broken, on_error="drop").count() == 0


def test_projects_imply_what_their_joined_text_does(spark):
    """Page by page, with margins, as from all pages of a project in one text."""
    phrases = [p.replace("{a}", "7").replace("{b}", "31").replace("{c}", "12") for _, book in phrasebook.BOOKS.values() for p, _ in book]
    texts = [f"{p}\n{'filler words ' * (i % 40)}" for i, p in enumerate(phrases)]
    texts += ["Logo mat", "logo mat of rubber", "PORCELAIN TILE", "TO CARPET TRANSITION", "Manufacturer: Shaw", "carpet here", "MILLWORK", "x", None, "", "Straße mit FITTING ROOM", 'VINYL TILE 12" x 12"', "ß" * 50 + " quarter round"]
    p = spark.createDataFrame([("p" if i % 3 else "q", "f" + str(i % 4), i, t) for i, t in enumerate(texts)], PAGE)
    for project in ("p", "q"):
        whole = "\n".join(r["text"] for r in p.where(F.col("project_id") == project).orderBy("page_number").collect() if r["text"])
        want = set(plain_items.inferred(whole))
        got = takeoff.inferred_items(p).where(F.col("project_id") == project).select("description", "trade", "quantity", "unit", "confidence").collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == want, project
    assert takeoff.inferred_items(p.limit(0)).count() == 0


def test_blocking_spares_frequent_words(spark):
    import itertools

    words = ["metal", "round", "panel", "copper", "valve", "steel"]
    said = [" ".join(["frequent", *c]) for k in (1, 2, 3) for c in itertools.combinations(words, k)] + ["frequent", "", "tap"]
    d = spark.createDataFrame([("p", i, t) for i, t in enumerate(said)], "project_id string, seq long, description string")
    got = {(r["e"], r["p"]) for r in match.candidates(d, d).collect()}
    bare = [not similarity.significant(t) for t in said]
    every = {(i, j) for i, a in enumerate(said) for j, b in enumerate(said) if bare[i] or bare[j] or len(similarity.significant(a) & similarity.significant(b)) >= 2}
    assert got == every


def test_best_by_ratio(spark):
    e = spark.createDataFrame([("p", 1, "round duct"), ("p", 2, "round duct"), ("p", 3, "square duct"), ("q", 4, "round duct"), ("p", 5, None)], "project_id string, seq long, description string")
    p = spark.createDataFrame([("p", 1, "round ducts"), ("p", 2, "round duct"), ("p", 3, "something else entirely"), ("q", 4, "square ducts"), ("p", 5, "")], e.schema)
    pairs = [(s, i, j, similarity.ratio(a or "", b or "")) for s, i, a in map(tuple, e.collect()) for t, j, b in map(tuple, p.collect()) if s == t]
    want = match.best(spark.createDataFrame(pairs, "project_id string, e long, p long, score double"))
    assert rows(match.best_by_ratio(e, p), "project_id", "e", "p", "score") == rows(want, "project_id", "e", "p", "score")


def test_rules_beyond_literals(spark):
    docs = spark.createDataFrame([(1, "alpha 12 beta 34"), (2, "gamma"), (3, None)], "id long, text string")
    many = spark.createDataFrame([(i, f"r{i}", p, 0) for i, p in enumerate(["[0-9]+", "alpha", *[f"none{k}x" for k in range(500)]])], "ord int, name string, pattern string, grp int")
    for mode in ("flag", "each", "count", "pairs"):
        assert rows(rules.apply_rules(docs, many, mode, ["id"])) == rows(rules.apply_rules(docs, many.limit(2), mode, ["id"])) != []


def test_sheets_and_intermediate_files(spark, tmp_path):
    d = items(spark, "a & b <c>", "two", None)
    book = sinks.workbooks(d, d.limit(0).select("project_id", "seq", "description"), d.limit(0).select("project_id", "seq", "description")).first()["workbook"]
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(bytes(book))) as z:
        assert z.testzip() is None and b"a &amp; b &lt;c&gt;" in z.read("xl/worksheets/sheet2.xml") and b'name="Line Items"' in z.read("xl/workbook.xml")
    for n in (1, 2):
        sinks.write_intermediate(items(spark, *["x"] * n), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_model_calls_are_tried_again(spark):
    chunks = spark.createDataFrame([(1, "rtu", "text")], "id int, kind string, section string")

    def ask(prompt, calls=[]):  # noqa: B006  counts within one worker
        calls.append(prompt)
        if len(calls) % 3:
            raise TimeoutError
        return '{"items": [{"description": "x"}]}'

    assert takeoff.chunk_items(chunks, ask, ["id"], attempts=3, wait=0.0).count() == 1 and takeoff.chunk_items(chunks, ask, ["id"], attempts=2, wait=0.0).count() == 0
    assert rules.learn_rules(lambda w, r: 1 / 0, ["a"], [], fixed.DEFAULT_FILTERS) == rules.learn_rules(None, ["a"], [], fixed.DEFAULT_FILTERS)


def test_offsets_are_those_of_the_text(spark):
    """A letter that grows in capitals does not move what is found after it."""
    assert said(spark, generators.vav_schedule, "ß" * 40 + "Vav Terminal Unit Schedule\nVAV-1\nTITUS / DESV")[0][0][0].startswith("VAV-1:\n-Mfg/Model: TITUS")
    assert parsers.equipment_rows("ß" * 90 + "Equipment Schedule\nQQ-1 MODEL AB1 CFM 900\n")[0][0] == "QQ-1"


def test_streams(spark, tmp_path):
    import json

    from tallygrid.streaming import stages

    src, ckpt = tmp_path / "in", tmp_path / "ckpt"
    src.mkdir()
    lines = [("j", "start"), ("j", "Ingesting a"), ("k", "Saved to x"), ("j", "Extracting")]
    (src / "a.json").write_text("\n".join(json.dumps({"job_id": j, "ts": f"2024-01-01T00:00:{i:02d}Z", "kind": "log", "message": m}) for i, (j, m) in enumerate(lines)))
    q = stages.track_stages(stages.read_events(spark, str(src))).writeStream.format("memory").queryName("tracked").outputMode("update").option("checkpointLocation", str(ckpt)).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    assert rows(spark.table("tracked"), "job_id", "stage", "lines") == [("j", "extraction", 3), ("k", "output", 1)]
    out = str(tmp_path / "out")
    for _ in range(2):
        stages.resume(stages.read_events(spark, str(src)).select("job_id", "message"), lambda d: d, out, str(tmp_path / f"c{_}"), ["job_id", "message"]).awaitTermination(100)
    assert spark.read.parquet(out).count() == 4


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_substring_join(spark, most):
    """Against all pairs; short, empty, null, repeated and supplementary needles, null scopes, columns that clash; and no nested loop in a plan."""
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abé\n\U0001f600 ") for _ in range(n))
    hay = [(r.choice(["p", "q", None]), some(r.randint(0, 30))) for _ in range(60)] + [("p", None), ("p", "x" * 5000 + "needle in it"), ("p", "")]
    find = [(r.choice(["p", "q", None, "z"]), some(r.randint(0, 7))) for _ in range(120)] + [("p", "needle"), ("p", "needle"), ("p", "needles"), ("q", None), ("p", ""), (None, "a")]
    texts, needles = spark.createDataFrame(hay, "k string, s0 string"), spark.createDataFrame(find, "k string, name string")
    got = substrings.containing(needles, texts, ["k"], "name", "s0", most)
    want = {(k, n, t) for k, n in find for q, t in hay if n is not None and t is not None and k == q and n in t}
    have = [tuple(x) for x in got.collect()]
    assert set(have) == want and len(have) == len(want)
    assert substrings.containing(needles.limit(0), texts, ["k"], "name", "s0").count() == substrings.containing(needles, texts.limit(0), ["k"], "name", "s0").count() == 0
    new = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(find)], "i int, k string, text string")
    left = dedup.not_contained(new, texts.toDF("k", "text"), ["k"], "text")
    assert {x["i"] for x in left.collect()} == {i for i, (k, n) in enumerate(find) if n is None or not any(k == q and t is not None and n.lower() in t.lower() for q, t in hay)}
    on = context.terms_on_pages(needles.toDF("k", "term"), spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(hay)], "k string, text string, page int"), ["k"])
    assert rows(on, "k", "term", "page") == sorted(((k, n, i) for k, n in find for i, (q, t) in enumerate(hay) if None not in (k, n, t) and k == q and n in t), key=repr)
    for d in (got, left, on):
        plan = d._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def in_order(pairs):
    """The assignment, read plainly."""
    out, taken, done = [], set(), set()
    for s, e, p, score in sorted(pairs, key=lambda x: (x[0], x[1], -x[3], x[2])):
        if (s, e) not in done and (s, p) not in taken:
            out.append((s, e, p, score))
            done.add((s, e))
            taken.add((s, p))
    return sorted(out)


@pytest.mark.parametrize("one_task, rounds", [(10**6, 30), (0, 30), (0, 0), (0, 2), (150, 1)])
def test_assignment_in_rounds(spark, one_task, rounds):
    """By rounds, by groups of linked items and read in order alike: ties, dense and sparse projects, chains."""
    r = random.Random(9)
    pairs = {(s, r.randrange(n), r.randrange(n)): float(r.choice([60, 70, 70.5, 90])) for s, n, m in (("dense", 9, 70), ("sparse", 60, 90), ("wide", 200, 160), ("one", 1, 1)) for _ in range(m)}
    pairs |= {("chain", i, i + k): 90.0 - k for i in range(40) for k in (0, 1)} | {("turned", i, 40 - i - k): 90.0 - k for i in range(40) for k in (0, 1)}
    rows_ = [(*k, v) for k, v in pairs.items()]
    d = spark.createDataFrame(rows_, "project_id string, e long, p long, score double").repartition(5)
    got = match.greedy(d, one_task=one_task, rounds=rounds)
    assert rows(got, "project_id", "e", "p", "score") == sorted(in_order(rows_), key=repr)
    assert match.greedy(d.limit(0), one_task=one_task, rounds=rounds).count() == 0


def test_reports_are_as_plain_functions(spark):
    """Scores, assignment and report over varied descriptions, ratios that decide included, against the plain functions on all pairs."""
    r = random.Random(21)
    words = ["supply", "diffuser", "metal", "frame", "paint", "rubber", "base", "panel", "switch", "dimmer", "occupancy", "sensor", "RTU-1", "RTU-2", "EF-3", "12x12", "hollow", "exhaust", "é", "and"]
    some = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 9)))
    sides = [[(q, i, some(), r.choice([None, 1.0, 4.0])) for q in ("p", "q") for i in range(25)] for _ in range(2)]
    sides[1] += [("p", 50 + i, x[2] + r.choice(["", " and", "s", " metal"]), 2.0) for i, x in enumerate(sides[0][:15])]
    e, p = (spark.createDataFrame(x, "project_id string, seq long, description string, quantity double") for x in sides)
    want = [(a[0], a[1], b[1], float(s)) for a in sides[0] for b in sides[1] if a[0] == b[0] and (s := similarity.match_score(a[2], b[2])) >= fixed.MATCH_THRESHOLD]
    assert len({x[3] for x in want}) > 20 and rows(match.scored(e, p), "project_id", "e", "p", "score") == sorted(want, key=repr)
    taken = in_order(want)
    assert rows(match.greedy(match.scored(e, p)), "project_id", "e", "p", "score") == sorted(taken, key=repr)
    for row in match.report(e, p).collect():
        q = row["project_id"]
        own = [x for x in taken if x[0] == q]
        assert row["matched_items"] == len(own) and row["coverage"] == round(len(own) / 25 * 100, 1)
        assert row["missing_items"] == [x[2][:100] for x in sides[0] if x[0] == q and x[1] not in {m[1] for m in own}]
        assert row["extra_items"] == [x[2][:100] for x in sorted(sides[1]) if x[0] == q and x[1] not in {m[2] for m in own}]
    best = {}
    for a in sides[0]:
        for b in sides[1]:
            if a[0] == b[0] and (s := similarity.ratio(a[2], b[2])) >= fixed.COMPARE_THRESHOLD:
                best[b[0], b[1]] = max(best.get((b[0], b[1]), (0, 0)), (s, -a[1]))
    got = rows(match.best_by_ratio(e, p), "project_id", "p", "e", "score")
    assert got == sorted(((q, i, -k, s) for (q, i), (s, k) in best.items()), key=repr)


def test_rows_are_stamped_with_the_time_of_the_query(spark):
    before = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    got = stats.stamped(spark.range(2)).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).collect()
    assert {r["id"] for r in got} == {0, 1} and len({r["at"] for r in got}) == 1
    assert abs(datetime.datetime.fromisoformat(got[0]["at"]) - before).total_seconds() < 120
