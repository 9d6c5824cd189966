"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_folders(tmp_path):
    for name in ("__spark_entry__.py", "tidemill"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tidemill/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    code += """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).limit(3).count() == 3
d = "/root/testdata/sf0.001"
assert q["alert_log_upsert"](spark, d).count() > 0 and q["iforest_scores"](spark, d).where("score is not null").count() > 0
spark.stop()
"""
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_optional_folder():
    for top, _, files in os.walk(os.path.join(ROOT, "tidemill")):
        if os.path.basename(top) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(top, f)) as text:
                    assert "llm" not in text.read(), f
