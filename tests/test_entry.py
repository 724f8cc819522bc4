"""The entry module without the pipeline's parts, and the shared folder."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from hornfels import storage

ROOT = Path(__file__).resolve().parents[1]

ALONE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
found = e.queries()
assert not any(k.startswith("op") or k == "pipeline" for k in found) and found.keys() >= {"rule_join", "tc_linear"}
assert e.oracle_sql().keys() <= found.keys()
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert found["rule_project"](spark, "/root/testdata/sf0.001").count() > 1000
spark.stop()
"""


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_pipeline(tmp_path, also):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *also)
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    assert not (tmp_path / "copy/hornfels/llm").exists()
    out = subprocess.run([sys.executable, "-c", ALONE], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path / "copy")})
    assert out.returncode == 0, out.stderr[-2000:]


def test_scratch_goes_and_results_stay(spark):
    with storage.scratch(spark):
        part = storage.materialise(spark.range(5), "part")
        kept = storage.keep(part, "kept")
    folder = lambda df: Path(df.inputFiles()[0].removeprefix("file:")).parent if df.inputFiles() else None
    assert kept.count() == 5 and folder(kept).exists()
    with pytest.raises(Exception, match=r"(?i)not.*exist|no such|unable"):
        part.collect()


def test_a_local_folder_is_for_local_masters_only(spark, monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(dict)  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}  # noqa: RUF012

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session())
