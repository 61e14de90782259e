"""The rest of the repository without the training-data operators, and without a shared folder."""

import os
import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from banditframe.plans import catalog, tables

ROOT = Path(__file__).resolve().parent.parent
LEFT = ["banditframe/llm", "tests/llm", "corpus_pipeline.py"]


@pytest.mark.parametrize("gone", [LEFT, LEFT[:2], LEFT[2:]])
@pytest.mark.parametrize("stray", [False, True])
def test_entry_without_the_rest(tmp_path, gone, stray):
    """The rest's queries are there and the pipeline is not, even if another module of its name is on the path."""
    skip = {str(ROOT / g) for g in gone}
    shutil.copytree(ROOT, tmp_path / "r", ignore=lambda d, names: [n for n in names if f"{d}/{n}" in skip or n in (".git", "__pycache__")])
    (tmp_path / "other").mkdir()
    (tmp_path / "other/corpus_pipeline.py").write_text("raise ImportError")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": str(tmp_path / "other")} if stray else {})
    code = "import __spark_entry__ as e; print(*sorted(set(e.queries()) | set(e.oracle_sql())))"
    names = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, capture_output=True, text=True, check=True).stdout.split()
    assert set(catalog.queries()) <= set(names) and "pipeline" not in names


def test_a_cluster_without_shared_folder_is_an_error():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_written_tables_are_released(spark):
    df = tables.cut(spark.range(10))
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    assert Path(folder).is_dir() and df.count() == 10
    assert tables.release(spark) >= 1 and not Path(folder).exists()
    assert tables.release(spark) == 0
