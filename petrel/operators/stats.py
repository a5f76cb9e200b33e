"""Corpus statistics over array lengths (A1-A3)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_stats(df: DataFrame, col: str) -> DataFrame:
    """One row: max and mean array length (A1)."""
    n = F.size(col)
    return df.agg(F.max(n).alias("max_len"), F.round(F.avg(n), 6).alias("mean_len"),
                  F.count(F.lit(1)).alias("n_rows"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Length histogram with ``bins`` equal bins over [min, max], the last bin
    closed on the right; every bin is returned, empty ones with 0 (A2).

    One pass over the corpus: lengths are first counted per distinct length (a
    table bounded by the longest document) and checkpointed; the range and the
    bins are derived from that small table, the range projected once as a
    column so that it is computed once.  Bin = floor((x - min) * bins /
    (max - min)), capped at bins - 1; when max = min the range is widened by
    0.5 on each side, as ``numpy.histogram`` does.
    """
    spark = df.sparkSession
    per_len = (df.groupBy(F.size(col).cast("long").alias("x"))
               .agg(F.count(F.lit(1)).alias("n")).checkpoint())
    rng = per_len.agg(F.struct(F.min("x").alias("mn"), F.max("x").alias("mx"))).scalar()
    mn, mx = F.col("_r.mn"), F.col("_r.mx")
    same = mx == mn
    b = F.lit(bins).cast("long")
    idx = F.when(same, F.lit(bins // 2).cast("long")).otherwise(
        F.least(F.floor((F.col("x") - mn) * b / (mx - mn)).cast("long"), b - F.lit(1)))
    counts = (per_len.withColumn("_r", rng).groupBy(idx.alias("bin"))
              .agg(F.sum("n").alias("count")))
    lo = F.when(same, mn - F.lit(0.5)).otherwise(mn.cast("double"))
    width = F.when(same, F.lit(1.0)).otherwise((mx - mn).cast("double")) / F.lit(float(bins))
    allbins = spark.range(bins).select(F.col("id").alias("bin")).withColumn("_r", rng)
    return (allbins.join(counts, "bin", "left")
            .select(F.col("bin").cast("int").alias("bin"),
                    F.round(lo + F.col("bin") * width, 6).alias("lo"),
                    F.round(lo + (F.col("bin") + F.lit(1)) * width, 6).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def coverage(df: DataFrame, col: str, max_len: int) -> DataFrame:
    """Share (%) of rows whose array length is at most ``max_len`` (A3)."""
    ok = (F.size(col) <= F.lit(max_len)).cast("double")
    return df.agg(F.round(F.avg(ok) * F.lit(100.0), 6).alias("coverage_pct"))
