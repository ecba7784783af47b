"""The driver's contract, with and without the optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def test_imports_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "glossa", tmp_path / "glossa", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    got = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    names, oracles = (line.split() for line in got.stdout.strip().splitlines())
    assert names == oracles and "suggest" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", ["suggest", "protected_spans_merged", "session_replay", "lexicon_violations", "prompts", "protected_pairs", "sales_in_changes", "asof_changes", "asof_sentences", "top_words", "suggest_levels", "stream_decisions", "lexicon_file"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, folder)
    assert sorted(rel.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*rel.columns).collect()), key=str) == sorted(rel.fetchall(), key=str)
