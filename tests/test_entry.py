"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_subpackage(tmp_path):
    """A copy without the llm folders and the pipeline still imports and has its own queries."""
    code = f"import sys, shutil; shutil.copytree({str(ROOT / 'skeinlake')!r}, {str(tmp_path / 'skeinlake')!r}, ignore=shutil.ignore_patterns('llm', '__pycache__')); shutil.copy({str(ROOT / '__spark_entry__.py')!r}, {str(tmp_path)!r}); sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; q = e.queries(); assert 'bm25_top5' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q), q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
