"""Bars against a pandas brute force; the streaming forms."""
import os

from pyspark.sql import functions as F

from petrel.operators import bars as B
from petrel.plans import fixtures as X

SF = "/root/testdata/sf0.01"


def test_daily_bars_brute_force(spark):
    bars = X.daily_bar_table(spark, SF).toPandas().set_index(["code", "dt"]).sort_index()
    ev = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    ev["code"] = ev["user_id"].astype(str).str.zfill(6)
    ev["dt"] = ev["ts"].dt.date
    ev = ev.sort_values(["ts", "event_id"])
    g = ev.groupby(["code", "dt"])["value"]
    ref = g.agg(["first", "max", "min", "last", "count"])
    assert len(ref) == len(bars)
    assert (ref["first"].values == bars["open"].values).all()
    assert (ref["last"].values == bars["close"].values).all()
    assert (ref["count"].values == bars["volume"].values).all()


def test_latest_page_brute_force(spark):
    bars = X.daily_bar_table(spark, SF)
    codes = bars.select("code").distinct().orderBy("code").limit(7)
    got = B.daily_bars(bars, codes, "2024-01-15", 3).toPandas()
    pdf = bars.join(codes, "code", "left_semi").toPandas()
    import datetime
    pdf = pdf[pdf["dt"] <= datetime.date(2024, 1, 15)]
    ref = pdf.sort_values("dt", ascending=False).groupby("code").head(3)
    assert sorted(map(tuple, got[["code", "dt"]].values.tolist())) == sorted(map(tuple, ref[["code", "dt"]].values.tolist()))


def test_stream_daily_bars(spark, tmpdir_path):
    from petrel.streaming.bars import stream_daily_bars
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
           .option("maxFilesPerTrigger", 1).parquet(SF))
    ticks = src.select(B.as_code("user_id").alias("code"), "ts", F.col("value").alias("price"), "event_id")
    q = (stream_daily_bars(ticks, tiebreak="event_id").writeStream.outputMode("append")
         .format("memory").queryName("bars_stream")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM bars_stream")
    batch = X.daily_bar_table(spark, SF)
    # append mode emits the days closed by the watermark: all but the last day
    assert got.count() > 0
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_score_stream(spark, tmpdir_path):
    from petrel.operators import models as M
    from petrel.operators import vocab as V
    from petrel.streaming.scoring import score_stream
    toks = X.with_category(spark, X.doc_tokens(spark, SF), SF)
    train = X.labelled(spark, toks, SF)
    feats = V.cap_vocab(V.build_vocab(V.word_counts(train)), 500).select("word")
    model = M.nb_fit(train, feats)
    stop = [r[0] for r in X.stop_words(spark, SF).collect()]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(SF)
    out = os.path.join(tmpdir_path, "scored")
    q = score_stream(docs, model, stop, out, os.path.join(tmpdir_path, "ck2"))
    q.awaitTermination()
    scored = spark.read.parquet(out)
    batch = M.nb_score(model, toks)
    assert scored.count() == batch.count()
    assert scored.select("doc_id", "prediction").exceptAll(batch).count() == 0


def test_long_keys_stay_whole(spark):
    from petrel.operators import bars as B
    keys = [7, 999999, 1234560, 1234561, 123456789012]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert sorted(r[0] for r in df.select(B.as_code("k")).collect()) == sorted(
        ["000007", "999999", "1234560", "1234561", "123456789012"])


def test_bars_are_hash_aggregated(spark):
    plan = X.daily_bar_table(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_merged_bars_hold_one_aggregation_at_a_time(spark):
    from petrel.plans.catalog import QUERIES
    merged, daily = (QUERIES[q](spark, "/root/testdata/sf0.001") for q in ("bars_merged", "bars_daily"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, daily.collect()))
    # partial and final, of the merged bars only: the states and the store were aggregated before
    assert str(merged._jdf.queryExecution().sparkPlan()).count("HashAggregate(") == 2
