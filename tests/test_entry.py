"""The driver's entry points, with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    rows = entry.entry(spark).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:], strict=False))


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_llm_folders():
    code = "import sys\nsys.modules['corpus_pipeline'] = None\nsys.modules['weftline.llm'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 90 and not any(k.startswith('op') for k in e.queries())\nprint(len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True)


def test_nothing_else_imports_llm():
    for path in (ROOT / "weftline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
