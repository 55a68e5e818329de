import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["tau", "n_auto", "n_false"] and df.count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


def test_nothing_outside_imports_the_text_operators():
    for p in (ROOT / "quernstone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "quernstone").parts:
            assert "quernstone.llm" not in p.read_text(), p


def test_it_works_without_the_text_operators():
    code = "import sys; sys.modules['quernstone.llm'] = None; import __spark_entry__ as e; names = [*e.queries()]; assert 'p3_found' in names and 'p4_found' not in names"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    importlib.reload(entry)
