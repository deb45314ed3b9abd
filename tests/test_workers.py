"""Queries whose functions run in tasks, with executors that have no copy of the package."""

import subprocess
import sys
from pathlib import Path

NAMES = ["chk_03_split", "dom_21_bundles", "dom_16_sections", "mdl_07_editions", "rnd_04_document", "str_01_frames", "str_02_reassembly"]
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
def missing(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("lectern") is None] * len(b))], ["missing"])
assert all(r.missing for r in spark.range(2).mapInArrow(missing, "missing boolean").collect())
for name in {names!r}:
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
if "dom_21_bundles" in {names!r}:
    assert __spark_entry__.queries()["dom_21_bundles"](spark, "/root/testdata/sf0.001").where("error is not null").count() == 0
"""


def run_apart(names, folder):
    """The names that ran with a driver in another folder, whose workers cannot import the package."""
    code = RUN.format(root=str(Path(__file__).parent.parent), names=names)
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return [x.split()[1] for x in done.stdout.splitlines() if x.startswith("ran ")]


def test_core_queries(tmp_path):
    assert run_apart(NAMES, tmp_path) == NAMES
