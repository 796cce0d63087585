"""The driver contract: queries run, names agree, the optional subpackage may be absent."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "pc_median_price_12m" in out.columns


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_optional_subpackage(tmp_path):
    for name in ("tidemark", "__spark_entry__.py"):
        source = os.path.join(HERE, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert got.stdout.split()[-1:] == ["False"] and int(got.stdout.split()[0]) > 50, got.stderr


def test_a_broken_subpackage_is_left_out_and_told(tmp_path):
    shutil.copytree(os.path.join(HERE, "tidemark"), tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    (tmp_path / "tidemark" / "llm").mkdir()
    (tmp_path / "tidemark" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tidemark" / "llm" / "catalogue.py").write_text("import not_there_at_all\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.oracle_sql(); print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "not_there_at_all" in got.stderr and int(got.stdout.split()[-1]) > 50
