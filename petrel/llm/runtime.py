"""What the operators share: session set-up, tables, scratch tables, packed integers."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from petrel.session import ensure_checkpoint_dir, scratch_dir, ship_package

#: Arrow batches sent to Python workers end at this size, so that a few very
#: long texts cannot fill a worker's memory.
BATCH_BYTES = 2 << 20


def setup(spark: SparkSession) -> None:
    """Shared folder, package on the workers, bounded Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder (with the writer's ``options``) and read back.

    Later steps read files that every machine sees, so a lost executor costs
    only its running tasks, and nothing before this point is computed again.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    spark = tables[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for table in tables for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def wide(spark: SparkSession) -> int:
    """Number of partitions that shuffles of this session use."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ints(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: the smallest, the width, then the differences to it."""
    values = np.asarray(values, np.int64)
    if not len(values):
        return b""
    low = int(values.min())
    span = int(values.max()) - low
    width = next((w for w in (1, 2, 4) if span < 1 << 8 * w), 8)
    rest = (values - low) if width < 8 else values
    return np.int64(low).tobytes() + bytes([width]) + rest.astype(f"<i{width}" if width == 8 else f"<u{width}").tobytes()


def unints(data: bytes) -> np.ndarray:
    """The inverse of ``ints``."""
    if not data:
        return np.zeros(0, np.int64)
    low, width = np.frombuffer(data, np.int64, 1)[0], data[8]
    rest = np.frombuffer(data, f"<i{width}" if width == 8 else f"<u{width}", offset=9).astype(np.int64)
    return rest if width == 8 else rest + low


def squeeze(data: bytes) -> bytes:
    """Length and zstd-compressed bytes."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte array and the end of each row; null is empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at[1:] - at[0]
