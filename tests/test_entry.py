import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_works_without_the_pipeline(tmp_path):
    (tmp_path / "lexigrid").mkdir()
    for part in (ROOT / "lexigrid").iterdir():
        if part.name != "llm":
            (tmp_path / "lexigrid" / part.name).symlink_to(part)
    (tmp_path / "jobs").symlink_to(ROOT / "jobs")
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') for k in q) and sum(k.startswith('job') for k in q) == 2; assert set(e.oracle_sql()) <= set(q)"
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert "lexigrid.llm" in said.stderr


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
