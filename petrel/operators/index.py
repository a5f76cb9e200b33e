"""Dense row numbers without a one-partition window (C13, K5 gaps), and the hold-out split.

A global ``row_number()`` moves every row into one task.  Here the rows are
range-sorted across all partitions, each row gets its position inside its
partition, and a table with one row per *partition* (not per row) holds the
running offsets.  That table is bounded by the partition count, so it is the
only thing broadcast.  The sorted frame is checkpointed to the shared folder so
that both uses see the same partition assignment, and the lineage is cut.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrel.session import ensure_checkpoint_dir


def dense_index(df: DataFrame, order: Sequence[Column | str], name: str = "idx",
                start: int = 0) -> DataFrame:
    """Append ``name`` = 0-based position (plus ``start``) in ``order``.

    ``order`` must be a total order (unique keys), as every caller passes an
    explicit tie-break; equal keys would still get distinct but arbitrary numbers.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cols = df.columns
    tagged = (df.sort(*order)
              .select(*cols,
                      F.spark_partition_id().alias("_pid"),
                      F.monotonically_increasing_id().alias("_mid"))
              .checkpoint(eager=True))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count
    offsets = (tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off")))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .select(*cols, (local + F.col("_off") + F.lit(start)).alias(name)))


#: Keys that divide the open range in a round of the selection; open keys that the driver may take.
PIVOTS, FEW = 512, 4096


def select_key(df: DataFrame, key: str, position: int):
    """The key at a 0-based ``position`` in key order, by rounds of range counts (no sort, nothing stored).

    Each round draws ``PIVOTS`` of the keys that are still open (the smallest by
    hash, a top-k), counts the keys in each range between them, and goes on
    with the range that holds the position, some 500 times smaller; the last
    ``FEW`` keys are read.  Any orderable type; null keys do not count."""
    keys = df.select(F.col(key).alias("k")).where("k is not null")
    before, open_ = 0, keys
    while True:
        drawn = open_.orderBy(F.xxhash64("k")).limit(FEW + 1).collect()
        values = sorted({r["k"] for r in drawn})
        if len(drawn) <= FEW:
            return sorted(r["k"] for r in drawn)[position - before]
        if len(values) == 1 and not open_.where(F.col("k") != F.lit(values[0])).head(1):
            return values[0]
        pivots = values[:: max(1, len(values) // PIVOTS)]
        cut = F.array(*[F.lit(p) for p in pivots])
        # range i holds the keys from pivot i - 1 on, below pivot i
        place = F.size(F.filter(cut, lambda p: p <= F.col("k")))
        counts = sorted(open_.groupBy(place.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect())
        for place, n in counts:
            if position < before + n:
                break
            before += n
        low = [] if place == 0 else [F.col("k") >= F.lit(pivots[place - 1])]
        high = [] if place == len(pivots) else [F.col("k") < F.lit(pivots[place])]
        for test in low + high:
            open_ = open_.where(test)


def tail_split(df: DataFrame, key: str, frac: float = 0.2, name: str = "split") -> DataFrame:
    """Hold out the last ``frac`` of rows in ``key`` order.

    The cut is ``floor(n * (1 - frac))``, taken before any shuffling.  The key
    at the cut is selected by counts over the key column (``select_key``), and
    every row is labelled by comparing its key with it; no row moves.  Keys
    must be unique.
    """
    n = df.select(F.count(key)).first()[0]
    cut = math.floor(n * (1.0 - frac))
    if cut >= n:
        return df.withColumn(name, F.lit("train"))
    first_valid = F.lit(select_key(df, key, cut))
    return df.withColumn(name, F.when(F.col(key) >= first_valid, F.lit("valid")).otherwise(F.lit("train")))


def id_gaps(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Flag rows whose id is not the previous id + 1 in id order (K5 check).

    The previous row is found by an equi-join on the dense position, not by a
    global ``lag`` window.
    """
    pos = dense_index(df, [id_col], name="_pos")
    prev = pos.select((F.col("_pos") + F.lit(1)).alias("_pos"), F.col(id_col).alias("_prev"))
    expected = F.coalesce(F.col("_prev") + F.lit(1), F.lit(0))
    return (pos.join(prev, "_pos", "left")
            .select(*df.columns, "_pos",
                    (F.col(id_col) != expected).alias("gap"))
            .withColumnRenamed("_pos", "line"))
