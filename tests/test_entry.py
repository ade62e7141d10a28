"""The driver's entry points, with and without the subpackage that they can do without."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() <= 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


CODE = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_optional_part(tmp_path, pipeline):
    """A copy without the optional folders imports, and has the engine's queries still."""
    shutil.copytree(ROOT / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        shutil.copy(ROOT / name, tmp_path)
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, timeout=120)


def test_imports_without_a_library(tmp_path):
    """Where a library is missing that only the optional part needs, the engine's queries are there."""
    hide = "import sys; sys.modules['ahocorasick'] = None; "
    subprocess.run([sys.executable, "-c", hide + CODE], cwd=ROOT, check=True, timeout=120)
