"""Connected components of an edge table, by alternating star contraction."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrel.llm.runtime import stored


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some edges as stars: (vertex, smallest vertex), centres left out."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    low = np.arange(len(names))
    while True:                         # each round hooks roots to smaller roots, then halves the paths
        x, y = low[a], low[b]
        small, large = np.minimum(x, y), np.maximum(x, y)
        open_ = small != large
        if not open_.any():
            break
        np.minimum.at(low, large[open_], small[open_])
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up
    rest = np.flatnonzero(low != np.arange(len(names)))
    return names[rest], names[low[rest]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (two long columns): the smallest id that links reach.

    Edges are first contracted within each batch, so a group of copies leaves
    one edge per member.  Each round then points every vertex at the smallest
    neighbour it knows; partial minima and split joins keep a vertex with very
    many neighbours from loading one task.
    """
    a, b = edges.columns
    src = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = stored(src.mapInArrow(_local, "u long, v long").distinct(), name)
    print_ = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = stored(small, name)
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)),
                       F.coalesce(F.sum(F.xxhash64("u", "v") % 1000003), F.lit(0))).head()
        if tuple(seen) == print_:
            break
        print_ = tuple(seen)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
