"""The entry points without the optional folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_training_data_folders(tmp_path):
    """A copy without the optional package, with and without the pipeline's file, still has all other queries."""
    from landtally.plans import catalog

    shutil.copytree(os.path.join(ROOT, "landtally"), tmp_path / "landtally", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    for gone in (None, "corpus_pipeline.py"):
        if gone and (tmp_path / gone).exists():
            (tmp_path / gone).unlink()
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
        assert out == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False"]
