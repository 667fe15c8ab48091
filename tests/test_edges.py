"""Configuration, spelling, prompts, standard wordings, projects."""

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrid import config
from tallygrid.functions import enhance, prompts, spelling
from tallygrid.operators import projects


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load(path) == config.DEFAULTS and config.get(config.DEFAULTS, "ocr.none", 7) == 7
    changed = config.put(config.load(path), "evaluation.fuzzy_threshold", 70)
    config.save(path, config.put(changed, "new.deep.key", [1]))
    assert config.get(config.load(path), "evaluation.fuzzy_threshold") == 70 and config.get(config.load(path), "new.deep.key") == [1]
    assert config.DEFAULTS["evaluation"]["fuzzy_threshold"] == 60 and config.reset(path) == config.DEFAULTS == config.load(path)
    (tmp_path / "c.json").write_text("{")
    assert config.load(path) == config.DEFAULTS


def test_spelling(spark):
    s = spelling.Speller(["diffuser", "vacancy", "tile"])
    assert s.text("(Difuser), TILES.\nvaccancy ab x-y") == "(Diffuser, TILE.\nvacancy ab xy"  # one mark at either end comes back
    assert s.unknown("Difuser tile") == [("Difuser", "Diffuser")]
    d = spark.createDataFrame([("difuser",), (None,)], "t string").select(spelling.corrected(F.col("t"), ["diffuser"]))
    assert [r[0] for r in d.collect()] == ["diffuser", None]


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_distance(a, b):
    assert spelling.distance(a, b) == spelling.distance(b, a) <= max(len(a), len(b)) and (spelling.distance(a, b) == 0) == (a == b)


def test_wordings(spark):
    d = spark.createDataFrame([("paint wall", "Painting"), ('8" duct', "HVAC"), ("duct", "HVAC"), ("PNT-01 paint", "Painting"), ("odd", "None")], "d string, t string")
    got = [r[0] for r in d.select(enhance.enhanced(F.col("d"), F.col("t"))).collect()]
    assert got[0].startswith("Wall Paint") and got[1].startswith('8" Dia Duct') and got[2].startswith("Ductwork") and got[3:] == ["PNT-01 paint", "odd"]


def test_prompts(spark):
    legend = spark.createDataFrame([("p", i, f"PNT-{i}", "Acme", "x", "c", "t") for i in range(50)], "project_id string, pos int, code string, manufacturer string, product string, color string, type_size string")
    lines = prompts.context_lines(legend, prompts.legend_line(), ["pos"], prompts.ROWS["legend"])
    text = lines.select(prompts.context_prompt(F.col("lines"), F.lit(""), F.lit(None).cast("string"), F.lit("chunk"))).first()[0]
    assert text.count("\n  PNT-") == 40 and "ROOM" not in text and text.endswith("\n--- EXTRACTION CONTENT ---\nchunk")
    page = spark.range(1).select(prompts.page_prompt(F.lit("p"), F.lit("f"), F.lit("spec"), F.lit("y" * 40_000))).first()[0]
    assert page.count("y") >= 30_000 > page.count("y") - 20


def test_projects(spark):
    ls = spark.createDataFrame(
        [("/r/P1 - a", True, 0), ("/r/P1 - a/Project Files", True, 0), ("/r/P1 - a/Project Files/x.pdf", False, 9), ("/r/P1 - a/Expected Manual Output", True, 0), ("/r/P1 - a/Expected Manual Output/e.xlsx", False, 1),
         ("/r/P1 - a/Expected Manual Output/e.pdf", False, 1), ("/out/P1/prediction.json", False, 1)],
        "path string, is_dir boolean, size long",
    )
    reg = spark.createDataFrame([("P1", "/r/P1 - a"), ("P2", "/gone"), ("P3", "/r/P1 - a")], "project_id string, path string")
    hidden = spark.createDataFrame([("P3",)], "project_id string")
    assert [r["project_id"] for r in projects.visible(reg, hidden, ls).collect()] == ["P1"]
    got = {r["project_id"]: (r["files_count"], r["has_output"], r["has_evaluation"]) for r in projects.info(reg, ls).collect()}
    assert got == {"P1": (1, True, False), "P2": (0, False, False), "P3": (1, False, False)}
    want = spark.createDataFrame([("P1", None), ("Q", "/given"), ("P9", None)], "project_id string, path string")
    assert {r["project_id"]: r["resolved"] for r in projects.resolve_path(want, reg.limit(0), ls).collect()} == {"P1": "/r/P1 - a/Project Files", "Q": "/given", "P9": "client_files/P9/Project Files"}
    assert [tuple(r) for r in projects.expected_sheets(ls).collect()] == [("/r/P1 - a", "/r/P1 - a/Expected Manual Output/e.xlsx")]
    assert [r["has_expected"] for r in projects.batch(ls).collect()] == [True]
    stored = spark.createDataFrame([("/o/b.json", 3, '{"line_items": [{"description": "a"}]}'), ("/o/a.json", 1, "{")], "path string, size long, text string")
    assert [(r["file"], r["line_items_count"]) for r in projects.stored_versions(stored).collect()] == [("a.json", 0), ("b.json", 1)]
    left, was = projects.without_job(spark.createDataFrame([("j",)], "job_id string"), "j")
    assert was and left.count() == 0
