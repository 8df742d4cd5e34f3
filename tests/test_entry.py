from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from oracle import SMALL

import __spark_entry__ as entry

FOUND = {
    "p1_found": ["batch", "field"],
    "p3_found": ["line_id", "code", "column_name"],
    "p4_found": ["batch", "medium", "run_no", "time_min"],
    "p5_found": ["batch", "field", "medium", "run_no", "time_min"],
}


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_found_columns(spark):
    for name, columns in FOUND.items():
        assert entry.queries()[name](spark, SMALL).columns == columns


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_general_part_stands_alone():
    """With the corpus package out of reach the rest still imports and registers its queries."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('batchloom.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'p1_found' in e.queries() and 'p2_found' not in e.queries() and 'p2_found' not in e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
