"""Shared-folder helpers: scratch folders live under spark.checkpoint.dir."""
import subprocess
import sys

import pytest

from petrel.session import checkpoint_path, ensure_checkpoint_dir, publish_bytes, scratch_dir


def test_scratch_under_checkpoint_dir(spark):
    base = ensure_checkpoint_dir(spark)
    assert base == spark.sparkContext.getCheckpointDir()
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a.startswith(base.rstrip("/") + "/") and a != b


def test_publish_bytes_round_trip(spark):
    path = publish_bytes(spark, b"\x00\x01model\xff", scratch_dir(spark, "blob") + "/m.bin")
    assert spark.read.format("binaryFile").load(path).select("content").head()[0] == b"\x00\x01model\xff"


def test_no_machine_local_checkpoints_on_a_cluster():
    assert checkpoint_path("hdfs:///c", "yarn") == "hdfs:///c"
    assert checkpoint_path(None, "local[4]").startswith("/")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError):
            checkpoint_path(None, master)


def test_workers_import_the_package_from_any_folder(tmp_path):
    """A plain session, started elsewhere and without PYTHONPATH, runs a query with Python workers."""
    code = (
        "import importlib.util as u, os\n"
        "os.environ.pop('PYTHONPATH', None)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"spec = u.spec_from_file_location('entry_module', {str(ROOT_ENTRY)!r})\n"
        "m = u.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "print('ROWS', m.queries()['src_csv_roundtrip'](s, '/root/testdata/sf0.001').count())\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in out.stdout, out.stderr[-2000:]


ROOT_ENTRY = __file__.replace("tests/test_session.py", "__spark_entry__.py")
