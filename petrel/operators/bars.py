"""Securities and daily bars.

The broker requests of the reference (one request per code) become one scan,
one semi join and one top-k-per-group over a long bar table keyed by code.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODE_WIDTH = 6  # codes are zero-padded strings, never numbers


def as_code(col: Column | str, width: int = CODE_WIDTH) -> Column:
    """Render a numeric key as a code string of at least ``width`` digits.

    Leading zeros fill shorter keys; longer keys stay whole, so two keys never
    share a code.
    """
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def tick_order(ts: str, tiebreak: str | None) -> Column:
    """(ts, tiebreak) as one decimal, which a hash aggregation can hold (a
    struct would make Spark sort every tick): microseconds, then the id."""
    at = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(38,0)")
    if not tiebreak:
        return at
    return at * F.expr("18446744073709551616BD") + F.coalesce(F.col(tiebreak), F.lit(0)).cast("decimal(20,0)")


def build_daily_bars(ticks: DataFrame, code: str = "code", ts: str = "ts",
                     price: str = "price", tiebreak: str | None = None) -> DataFrame:
    """Daily OHLC bars and tick counts from a tick table (B1).

    Open/close are the first/last price by (ts, tiebreak); ``min_by``/``max_by``
    aggregate partially on the map side, so a hot code with a third of all ticks
    is reduced per task before the shuffle.
    """
    order = tick_order(ts, tiebreak)
    return (ticks.groupBy(F.col(code).alias("code"), F.to_date(ts).alias("dt"))
            .agg(F.min_by(price, order).alias("open"),
                 F.max(price).alias("high"),
                 F.min(price).alias("low"),
                 F.max_by(price, order).alias("close"),
                 F.count(F.lit(1)).alias("volume")))


# --- stored bar states: late ticks without building all bars again -----------------------

STATE = ["open_at", "open", "high", "low", "close_at", "close", "volume"]


def bar_states(ticks: DataFrame, batch: Column | str, code: str = "code", ts: str = "ts", price: str = "price",
               tiebreak: str | None = None) -> DataFrame:
    """(batch, code, dt, ...): what one batch of ticks says of its bars, with the order of its first and last tick."""
    order = tick_order(ts, tiebreak)
    return (ticks.groupBy((F.col(batch) if isinstance(batch, str) else batch).alias("batch"),
                          F.col(code).alias("code"), F.to_date(ts).alias("dt"))
            .agg(F.min(order).alias("open_at"), F.min_by(price, order).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max(order).alias("close_at"), F.max_by(price, order).alias("close"),
                 F.count(F.lit(1)).alias("volume")))


def add_states(store: DataFrame, more: DataFrame) -> DataFrame:
    """The store with more states.  A batch that comes again says the same again and counts once, so adding is
    idempotent, and the order of adding does not matter."""
    return store.unionByName(more).dropDuplicates(["batch", "code", "dt"])


def merged_bars(store: DataFrame) -> DataFrame:
    """Daily bars of all ticks whose states are stored, as ``build_daily_bars`` makes them of the ticks."""
    return (store.groupBy("code", "dt")
            .agg(F.min_by("open", "open_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", "close_at").alias("close"), F.sum("volume").alias("volume")))


def securities(master: DataFrame, names: DataFrame, market: str, code: str = "code",
               market_col: str = "market", name: str = "name") -> DataFrame:
    """(code, name) of one market: filter, then one join for the names."""
    codes = master.filter(F.col(market_col) == F.lit(market)).select(code)
    return codes.join(names.select(code, name), code, "left")


def security_info(info: DataFrame, code: str, code_col: str = "code",
                  key_col: str | None = None) -> DataFrame:
    """All columns of one security.

    When the table stores the numeric key the code is rendered from, the
    filter is also put on that key, so it reaches the parquet scan as a pushed
    equality (row-group skipping) instead of running on a derived column.
    """
    out = info
    if key_col is not None and code.isdigit():
        out = out.filter(F.col(key_col) == F.lit(int(code)))
    return out.filter(F.col(code_col) == F.lit(code))


def daily_bars(bars: DataFrame, codes: DataFrame, base_date: str, page_size: int,
               code: str = "code", dt: str = "dt", adjusted: bool = True,
               adjusted_col: str | None = None, raw_col: str | None = None) -> DataFrame:
    """Latest ``page_size`` bars per listed code up to ``base_date``.

    One long frame keyed by code.  ``row_number() <= k`` is planned with a
    partial ``WindowGroupLimit`` before the shuffle, so every task forwards at
    most k rows per code.  ``adjusted`` picks the adjusted price column when the
    bar table carries both; the broker does the adjusting.
    """
    b = bars.filter(F.col(dt) <= F.to_date(F.lit(base_date)))
    if adjusted_col and raw_col:
        b = b.withColumn("price", F.col(adjusted_col if adjusted else raw_col))
    b = b.join(codes.select(code).distinct(), code, "left_semi")
    w = Window.partitionBy(code).orderBy(F.col(dt).desc())
    return (b.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= F.lit(page_size)).drop("_rn"))


def head_per_code(bars: DataFrame, n: int = 10, code: str = "code", dt: str = "dt") -> DataFrame:
    """First ``n`` rows of each code's page (most recent first) (B2)."""
    w = Window.partitionBy(code).orderBy(F.col(dt).desc())
    return (bars.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= F.lit(n)))
