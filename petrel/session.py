"""Session construction and the shared scratch folder.

On a cluster the scratch folder is always a child of ``spark.checkpoint.dir``
(a shared, reliable folder named by the cluster).  Only when that setting is
absent -- local runs and tests -- is a folder created here.
"""
from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "petrel", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    A folder is created here only for a ``local`` master.  On a cluster a
    machine-local folder would be seen by one machine alone, so a missing
    ``spark.checkpoint.dir`` is an error there.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    sc.setCheckpointDir(checkpoint_path(sc.getConf().get("spark.checkpoint.dir", None), sc.master))
    return sc.getCheckpointDir()


def checkpoint_path(setting: str | None, master: str) -> str:
    """The folder to use for this setting and master (see above)."""
    if setting:
        return setting
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share (master {master})")
    return tempfile.mkdtemp(prefix="petrel-ckpt-")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``petrel`` importable in Python workers, once per application.

    The package's modules are zipped into the shared folder and added to the
    application's Python files, so workers need neither the repository nor a
    ``PYTHONPATH``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, dirs, names in os.walk(root):
            dirs.sort()
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(publish_bytes(spark, buf.getvalue(), scratch_dir(spark, "package") + "/petrel_package.zip"))
    _SHIPPED.add(sc.applicationId)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + f"/petrel-scratch/{name}-{uuid.uuid4().hex[:12]}"


def publish_bytes(spark: SparkSession, data: bytes, dest_file: str) -> str:
    """Write bytes to a file in the shared folder (any Hadoop file system) from
    the driver, without a local temporary file; returns the file's URI."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dest = jvm.org.apache.hadoop.fs.Path(dest_file)
    out = dest.getFileSystem(conf).create(dest, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return dest.toString()
