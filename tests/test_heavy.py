"""Hot words, bounded vocabularies, key selection, nested models, certificates, stored bars, accents, stop filters."""
import random
import statistics
import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from petrel.functions import accents as AC
from petrel.operators import bars as B
from petrel.operators import encode as E
from petrel.operators import heavy as H
from petrel.operators import index as I
from petrel.operators import models as M
from petrel.operators import tokens as T
from petrel.operators import vocab as V
from petrel.plans import fixtures as X

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


# --- E1: head and tail -----------------------------------------------------------------

def hot_corpus(spark, hot, n=600):
    """A third of all tokens is one word."""
    rng = random.Random(1)
    rows = [(i, [hot if rng.random() < 1 / 3 else f"w{rng.randrange(4000)}" for _ in range(40)]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>"), rows


@pytest.mark.parametrize("hot", ["w7", "not in the table"])
def test_hot_word_loads_no_task(spark, no_broadcast, hot):
    df, rows = hot_corpus(spark, hot)
    vocab = spark.createDataFrame([(f"w{i}", i + 2) for i in range(3500)], "word string, idx int")
    ids = {f"w{i}": i + 2 for i in range(3500)}
    got = {r.doc_id: r.ids for r in E.encode(df, vocab).collect()}
    assert got == {i: [ids.get(t, 1) for t in toks] for i, toks in rows}
    words = H.hot_words(df, "tokens")
    assert [r.word for r in words.collect()] == [hot]
    ex = df.select("doc_id", F.posexplode("tokens").alias("_pos", "_tok"))
    table = vocab.select(F.col("word").alias("_tok"), F.col("idx").alias("_val"))
    parted = lambda d: [r["n"] for r in d.where(F.col("_tok") != hot).groupBy(F.spark_partition_id()).agg(
        F.count("*").alias("n")).collect()]
    joined = E.head_tail_join(ex, table, words)
    assert "BroadcastHashJoin" in plan(joined) and joined.count() == ex.count()
    plain = [r["n"] for r in ex.join(table, "_tok", "left").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    tail = ex.where(F.col("_tok") != hot).join(table, "_tok", "left")
    sizes = parted(tail)
    assert max(sizes) < 3 * statistics.median(sizes) and max(plain) > 3 * statistics.median(plain)


def test_encode_without_cap_keeps_empty_and_null_rows(spark, no_broadcast):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, [None, "b"])], "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 2)], "word string, idx int")
    got = {r.doc_id: r.ids for r in E.encode(df, vocab).collect()}
    assert got[1] == [2, 1, 2] and got[2] == [] and got[3] == []
    assert got == {r.doc_id: r.ids for r in E.encode(df, vocab, num_words=100).collect()}


# --- V5: bounded vocabularies ------------------------------------------------------------

@pytest.mark.parametrize("counters", [8, 30, 200, 5000])
def test_bounded_vocabulary_equals_the_whole_one(spark, counters):
    rng = random.Random(counters)
    weights = [1 / (i + 1) for i in range(1000)]
    rows = [(i, rng.choices([f"w{k}" for k in range(1000)], weights, k=rng.randint(0, 80))) for i in range(300)]
    df = spark.createDataFrame(rows + [(999, None)], "doc_id long, tokens array<string>").repartition(6)
    want = sorted(V.top_vocab(V.word_counts(df), 22).collect())
    assert sorted(H.top_vocab_bounded(df, 22, counters=counters).collect()) == want
    proved = H.frequent(df, 20, "tokens", counters)
    if counters < 100:
        assert proved is None
    else:
        assert {r.word for r in proved.collect()} >= {w for w, _, _ in want} and proved.count() <= counters
    assert H.summaries(df, "tokens", counters).count() <= (counters + 1) * 6


def test_bounded_vocabulary_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, tokens array<string>")
    assert H.top_vocab_bounded(df, 10).count() == 0 and H.top_vocab_bounded(df, 2).count() == 0
    few = spark.createDataFrame([(1, ["a", "b", "a"])], "doc_id long, tokens array<string>")
    assert sorted(tuple(r) for r in H.top_vocab_bounded(few, 100).collect()) == [("a", 2, 2), ("b", 1, 3)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=30), max_size=6), st.integers(1, 6))
def test_counters_bound_the_counts(parts, counters):
    import pyarrow as pa
    held, missed = {}, 0
    for words in parts:
        batch = pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.string()))], ["tokens"])
        for b in H._summary(counters)([batch]):
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w is None:
                    missed += n
                else:
                    held[w] = held.get(w, 0) + n
    for w in "abcdefgh":
        n = sum(p.count(w) for p in parts)
        assert held.get(w, 0) <= n <= held.get(w, 0) + missed


# --- P1: selection -------------------------------------------------------------------------

@pytest.mark.parametrize("few,pivots", [(4096, 512), (10, 4)])
def test_selected_key(spark, monkeypatch, few, pivots):
    monkeypatch.setattr(I, "FEW", few)
    monkeypatch.setattr(I, "PIVOTS", pivots)
    rng = random.Random(few)
    keys = rng.sample(range(-10**15, 10**15), 400) + [0, 2**62, -2**63]
    ints = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    texts = spark.createDataFrame([(str(k),) for k in keys], "k string")
    for at in (0, 1, 200, len(keys) - 1):
        assert I.select_key(ints, "k", at) == sorted(keys)[at]
        assert I.select_key(texts, "k", at) == sorted(map(str, keys))[at]
    same = spark.createDataFrame([(5,)] * 60 + [(1,), (9,)], "k long")
    assert [I.select_key(same, "k", i) for i in (0, 1, 60, 61)] == [1, 5, 5, 9]


def test_split_moves_and_stores_nothing(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = I.tail_split(df, "doc_id", 0.2)
    assert got.where("split = 'valid'").count() == 200 and got.where("split = 'train'").agg(F.max("doc_id")).first()[0] == 799
    p = plan(got)
    assert "Exchange" not in p and "Sort" not in p and "Scan ExistingRDD" not in p
    assert I.tail_split(df.limit(0), "doc_id").count() == 0
    assert I.tail_split(df, "doc_id", 0.0).where("split = 'valid'").count() == 0


# --- M1, M6: nested models --------------------------------------------------------------------

def test_nested_models_equal_single_ones(spark):
    toks = X.with_category(spark, X.doc_tokens(spark, SF), SF)
    train, test = X.labelled(spark, toks, SF).checkpoint(), X.unlabelled(spark, toks, SF)
    vocab = V.top_vocab(V.word_counts(train), 800).checkpoint()
    caps = (20, 150, 800)
    nested = {r.doc_id: list(r.predictions) for r in M.nb_score_nested(M.nb_fit_nested(train, vocab, caps), test).collect()}
    for i, cap in enumerate(caps):
        single = M.nb_score(M.nb_fit(train, vocab.where(F.col("idx") < cap).select("word")), test).collect()
        assert len(single) == len(nested) and all(nested[r.doc_id][i] == r.prediction for r in single)


# --- M2-M4: certificates ------------------------------------------------------------------------

def test_gradient_of_a_fit_that_stopped_early_is_not_small(spark):
    toks = X.with_category(spark, X.doc_tokens(spark, SF), SF)
    train = X.labelled(spark, toks, SF).checkpoint()
    words = M.train_words(train, cap=300)
    worst = [max(r.gradient for r in M.lr_gradient(M.lr_fit(train, words, max_iter=n, tol=1e-10), train).collect()) for n in (2, 300)]
    assert worst[0] > 1e-2 > 1e-4 > worst[1]


# --- B1: stored states -----------------------------------------------------------------------------

def test_states_of_any_split_in_any_order(spark):
    ticks = X.ticks(spark, SF).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(5)))
    want = sorted(B.build_daily_bars(ticks, tiebreak="event_id").collect())
    rng = random.Random(0)
    order = [0, 1, 2, 3, 4, 2, 2]
    rng.shuffle(order)
    store = None
    for b in order:
        more = B.bar_states(ticks.where(F.col("part") == b), "part", tiebreak="event_id")
        store = more if store is None else B.add_states(store, more)
    got = B.merged_bars(store).select("code", "dt", "open", "high", "low", "close", "volume")
    assert sorted(got.collect()) == want


def test_stream_of_late_ticks_keeps_bars_up(spark, tmp_path):
    from petrel.streaming.bars import store_states, stored_bars
    source = X.ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    folder, out = str(tmp_path / "ticks"), str(tmp_path / "states")
    for i in (2, 0, 1):                 # days come in any order
        source.where(F.dayofmonth("ts") % 3 == i).coalesce(1).write.mode("append").parquet(folder)
    q = (spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)
         .writeStream.foreachBatch(store_states(out, tiebreak="event_id"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    store_states(out, tiebreak="event_id")(source.where(F.dayofmonth("ts") % 3 == 2), 0)       # the first batch again
    got = stored_bars(spark, out).select("code", "dt", "open", "high", "low", "close", "volume")
    assert sorted(got.collect()) == sorted(B.build_daily_bars(source, tiebreak="event_id").collect())


# --- C9: accents ---------------------------------------------------------------------------------

def test_accents_of_every_character(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(chars[i:i + 500]) for i in range(0, len(chars), 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string").repartition(8)
    got = {r.i: r.t for r in df.select("i", AC.strip_accents("s").alias("t")).collect()}
    assert [got[i] for i in range(len(texts))] == [AC.stripped(t) for t in texts]
    assert "Python" not in plan(df.select(AC.strip_accents("s"))) and AC.stripped("é") == "e" == unicodedata.normalize("NFKD", "é")[0]


def test_accents_of_mixed_texts(spark):
    rng = random.Random(5)
    pool = "aé̈ñ ½ﬁ가각힣ㄱㅏﾡ①ﷺ𝔸x́한글Åß\n"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(300)] + ["", "plain", "é" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i long, s string")
    got = {r.i: r.t for r in df.select("i", AC.strip_accents("s").alias("t")).collect()}
    assert got.pop(-1) is None and [got[i] for i in range(len(texts))] == [AC.stripped(t) for t in texts]


# --- T2: stop filters --------------------------------------------------------------------------------

@pytest.mark.parametrize("bits,most", [(16, 2_000), (1, 2_000), (1, 0)])
def test_stop_filter_is_exact(spark, monkeypatch, bits, most):
    monkeypatch.setattr(T, "BLOOM_BITS", bits)
    monkeypatch.setattr(T, "FALSE_HITS", most)
    rng = random.Random(bits)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(i, rng.choices(vocab, k=rng.randint(0, 40))) for i in range(200)] + [(900, None), (901, []), (902, ["w1", None, "w2"])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    stop = set(rng.sample(vocab, 1500))
    got = {r.doc_id: r.tokens for r in T.remove_stop(df, "tokens", spark.createDataFrame([(w,) for w in stop], "form string")).collect()}
    want = {i: None if t is None else [w for w in t if w is not None and w not in stop] for i, t in rows}
    assert {k: v for k, v in got.items()} == want


def test_rows_stay_in_their_tasks(spark):
    df = X.doc_tokens(spark, SF, stop=False).select("doc_id", "tokens")
    out = T.remove_stop(df, "tokens", X.stop_words(spark, SF))
    assert plan(out).count("Exchange") == plan(df).count("Exchange") and "Join" not in plan(out)


# --- E1-E3: look-ups by a bounded table; no shuffle by language ---------------------------------------

@pytest.mark.parametrize("missing,default,last", [("default", 1, None), ("drop", None, None), ("default", 1, 2)])
def test_bounded_table_moves_no_token(spark, monkeypatch, missing, default, last):
    rows = [(1, "x", ["a", "b", "a", None, "c"]), (2, None, []), (3, "x", None), (None, "y", ["c", "d"]), (5, "x", ["zz"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>").repartition(3)
    table = spark.createDataFrame([("a", -5), ("b", 2**31 - 1), ("c", None), (None, 9)], "word string, idx int")
    look = lambda: E.lookup_array(df, "tokens", table, "word", "idx", "ids", on_missing=missing, default=default,     # noqa: E731
                                  keep_last=last, carry=("lang",))
    got = look()
    assert got.dtypes == [("doc_id", "bigint"), ("lang", "string"), ("ids", "array<int>")]
    assert "Generate" not in plan(got) and "MapInArrow" in plan(got)
    monkeypatch.setattr(E, "ENTRIES", 0)
    assert sorted(map(str, got.collect())) == sorted(map(str, look().collect()))


def test_bounded_table_keeps_its_checks(spark):
    df = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "doc_id long, tokens array<string>")
    table = spark.createDataFrame([("a", 2), ("b", 3)], "word string, idx int")
    with pytest.raises(Exception, match="repeated key 1"):
        E.encode(df, table, num_words=9).collect()
    two = spark.createDataFrame([("a", 2), ("a", 3)], "word string, idx int")
    with pytest.raises(Exception, match="repeated key 1"):
        E.encode(df.limit(1), two, num_words=9).collect()
    ids = spark.createDataFrame([(1, [3, 7])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="no table entry for 7"):
        E.lookup_array(ids, "ids", table, "idx", "word", "tokens", on_missing="error").collect()


def test_small_stop_table_counts_no_words(spark, monkeypatch):
    monkeypatch.setattr(T, "FALSE_HITS", -1)            # a filter would go over to the join at once
    df = spark.createDataFrame([(1, ["a", "b", None]), (1, ["b"]), (2, None)], "doc_id long, tokens array<string>")
    out = T.remove_stop(df, "tokens", spark.createDataFrame([("a",), (None,)], "form string"))
    assert sorted(map(str, [r.tokens for r in out.collect()])) == ["None", "['b']", "['b']"]
    assert "Exchange" not in plan(out)


def test_languages_are_not_shuffled(spark, no_broadcast):
    toks = X.table(spark, SF, "documents").select("doc_id", "lang")
    out = X.with_category(spark, toks, SF)
    assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    assert out.count() == 1000


@pytest.mark.parametrize("copies", [1, 2])
def test_gradient_groups_no_word_of_a_document(spark, copies):
    rng = random.Random(copies)
    rows = [(i, i % 3, rng.choices("abcdef", k=rng.randint(0, 9))) for i in range(60)]
    train = spark.createDataFrame(rows + rows[:9] * (copies - 1), "doc_id long, category int, tokens array<string>").repartition(4)
    words = list("abcde")
    model = M.lr_fit(train, words, max_iter=3)
    got = {r["class"]: r.gradient for r in M.lr_gradient(model, train).collect()}
    # the same sums with rows joined by key
    lr, n, copied = model.stages[-1], train.count(), {i: copies if i < 9 else 1 for i, _, _ in rows}
    probs = {r.doc_id: r.probs for r in M.score(model, train).collect()}
    for c in range(3):
        res = {i: probs[i][c] - (y == c) for i, y, _ in rows}
        d = [sum(copied[i] ** 2 * res[i] for i in res) / n]
        for f, w in enumerate(words):
            x = {i: copied[i] * t.count(w) for i, _, t in rows}
            s1, s2 = (sum(copied[i] ** 2 * x[i] ** e for i in x) for e in (1, 2))
            std, b = ((s2 - s1 * s1 / n) / (n - 1)) ** 0.5, lr.coefficientMatrix.toArray()[c][f]
            d.append(sum(copied[i] ** 2 * x[i] * res[i] for i in x) / n / std + lr.getRegParam() * b * std)
        assert got[c] == pytest.approx(sum(v * v for v in d) ** 0.5, rel=1e-6)
