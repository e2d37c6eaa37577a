import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_optional_subpackage(tmp_path):
    """The rest must import when the corpus operators are gone."""
    for name in ("__spark_entry__.py", "loomfactor"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    (tmp_path / "loomfactor" / "llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60; assert not any(k[2:3].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
