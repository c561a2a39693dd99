import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["bucket", "metric", "metric_norm"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """As when that subpackage, its tests and the pipeline are removed."""
    shutil.copytree(REPO / "brindle", tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", "")})


def test_nothing_else_imports_that_subpackage():
    others = [p for p in (REPO / "brindle").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in others if "brindle.llm" in p.read_text()]
