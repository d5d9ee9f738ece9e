"""The entry module with and without the folder of training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def listed(before: str = "") -> set[str]:
    code = f"import sys; {before}\nimport __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split())


def test_queries_without_the_folder():
    without = listed("sys.modules['corpus_pipeline'] = sys.modules['topiclens.llm'] = None")
    assert "vocabulary" in without and "pipeline" not in without and not any(n.startswith("op") and n[2].isdigit() for n in without)
    assert without <= listed()


def test_other_missing_modules_are_not_hidden():
    done = subprocess.run([sys.executable, "-c", "import sys; sys.modules['pyspark'] = None; import __spark_entry__"], cwd=ROOT, capture_output=True)
    assert done.returncode != 0
