"""Every query runs on the smallest tables and, where it has an oracle, agrees with it."""

import pytest

from tallygrid.plans import registry
from tests.conftest import SF, same_rows


#: Without rows in the smallest tables, which have no such descriptions and headings: these are run on the next larger ones.
LARGER = {"best_match", "schedule_sections"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF.replace("sf0.001", "sf0.01") if name in LARGER else SF)
    if sql := registry.oracle_sql().get(name):
        same_rows(df, duck.sql(sql))
    else:
        assert df.columns and df.count() > 0


def test_oracles_say_something(duck):
    """No oracle is met by an empty result alone."""
    empty = [n for n, sql in registry.oracle_sql().items() if not duck.sql(f"SELECT * FROM ({sql}) LIMIT 1").fetchall()]
    assert not empty


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    """The entry module imports and its other queries stay when the llm folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    shutil.copytree(f"{ROOT}/tallygrid", tmp_path / "tallygrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
