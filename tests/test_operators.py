"""Operator properties and brute-force checks."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from petrel.operators import clean as C
from petrel.operators import encode as E
from petrel.operators import ensemble as N
from petrel.operators import index as I
from petrel.operators import stats as S
from petrel.operators import tokens as T
from petrel.operators import vocab as V
from petrel.plans import fixtures as X

SF = "/root/testdata/sf0.01"


def test_dense_index_equals_global_row_number(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts")
    got = I.dense_index(df, [F.col("user_id").desc(), "ts", "event_id"], name="i")
    w = Window.orderBy(F.col("user_id").desc(), "ts", "event_id")
    ref = df.withColumn("i", F.row_number().over(w) - 1)
    assert got.exceptAll(ref.select(*got.columns)).count() == 0
    assert got.count() == df.count()


def test_id_gaps(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3), ("d", 4), ("e", 7)], "token string, id long")
    got = {r["token"]: r["gap"] for r in I.id_gaps(df).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": False, "e": True}


def test_tail_split_disjoint_complete(spark):
    df = spark.range(101).withColumnRenamed("id", "doc_id")
    s = I.tail_split(df, "doc_id", 0.2)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 80, "valid": 21}
    assert s.filter("split = 'valid'").agg(F.min("doc_id")).first()[0] == 80


def test_word_counts_sum_to_tokens(spark):
    toks = X.doc_tokens(spark, SF)
    total = toks.select(F.sum(F.size("tokens"))).first()[0]
    wc = V.word_counts(toks)
    assert wc.select(F.sum("cnt")).first()[0] == total


def test_vocab_rank_rule(spark):
    df = spark.createDataFrame([(0, ["b", "a", "c"]), (1, ["a", "c", "d", "c"])], "doc_id long, tokens array<string>")
    v = {r["word"]: r["idx"] for r in V.build_vocab(V.word_counts(df)).collect()}
    assert v == {"c": 2, "a": 3, "b": 4, "d": 5}
    v0 = {r["word"]: r["idx"] for r in V.build_vocab(V.word_counts(df), oov=False).collect()}
    assert v0 == {"c": 1, "a": 2, "b": 3, "d": 4}


def test_encode_oov_boundary(spark):
    df = spark.createDataFrame([(0, ["b", "a", "c", "zz"]), (1, [])], "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([("c", 2), ("a", 3), ("b", 4)], "word string, idx int")
    with_oov = {r["doc_id"]: r["ids"] for r in E.encode(df, vocab, num_words=4).collect()}
    assert with_oov == {0: [1, 3, 2, 1], 1: []}
    vocab0 = spark.createDataFrame([("c", 1), ("a", 2), ("b", 3)], "word string, idx int")
    no_oov = {r["doc_id"]: r["ids"] for r in E.encode(df, vocab0, num_words=3, oov=False).collect()}
    assert no_oov == {0: [2, 1], 1: []}


def test_encode_keep_last_equals_full(spark):
    vocab = X.train_vocab(spark, SF)
    toks = X.doc_tokens(spark, SF)
    from petrel.functions import arrays as A
    full = E.encode(toks, vocab, num_words=500).select("doc_id", A.pad_pre("ids", 30).alias("p"))
    cut = E.encode(toks, vocab, num_words=500, keep_last=30).select("doc_id", A.pad_pre("ids", 30).alias("p"))
    assert full.exceptAll(cut).count() == 0 and cut.count() == full.count()


def test_ids_to_tokens_inverse(spark):
    df = spark.createDataFrame([(0, ["x", "y", "x"])], "doc_id long, pieces array<string>")
    vocab = spark.createDataFrame([("[UNK]", 0), ("x", 1), ("y", 2)], "token string, id int")
    ids = E.pieces_to_ids(df, vocab, unk_id=0)
    assert ids.first()["ids"] == [1, 2, 1]
    assert E.ids_to_tokens(ids, vocab).first()["tokens"] == ["x", "y", "x"]


def test_ids_to_tokens_fails_out_of_range(spark):
    import pytest
    df = spark.createDataFrame([(0, [1, 9])], "doc_id long, ids array<int>")
    vocab = spark.createDataFrame([("x", 1)], "token string, id int")
    with pytest.raises(Exception):
        E.ids_to_tokens(df, vocab).collect()


def test_remove_stop_join_equals_list(spark):
    toks = X.doc_tokens(spark, SF, stop=False).select("doc_id", "tokens")
    stop = X.stop_words(spark, SF)
    inline = T.remove_stop(toks, "tokens", [r[0] for r in stop.collect()])
    joined = T.remove_stop(toks, "tokens", stop)
    assert inline.exceptAll(joined.select(*inline.columns)).count() == 0
    assert joined.count() == inline.count()


def test_remove_stop_nulls_and_repeated_keys(spark):
    import pytest
    df = spark.createDataFrame([(1, ["a", "b", None]), (2, None), (3, [])], "doc_id long, tokens array<string>")
    stop = spark.createDataFrame([("a",), (None,)], "form string")
    joined = {r[0]: r[1] for r in T.remove_stop(df, "tokens", stop).collect()}
    assert joined[2] is None and joined[3] == [] and joined[1] == ["b"]
    twice = spark.createDataFrame([(1, ["x"]), (1, ["y"])], "doc_id long, tokens array<string>")
    assert sorted(r[1] for r in T.remove_stop(twice, "tokens", stop).collect()) == [["x"], ["y"]]   # no key is needed
    with pytest.raises(Exception, match="repeated key 1"):
        T.remove_stop_join(twice, "tokens", stop.select(F.col("form").alias("_w"))).collect()
    vocab = spark.createDataFrame([("x", 2, 2)], "word string, cnt long, idx int")
    with pytest.raises(Exception, match="repeated key 1"):
        E.encode(twice, vocab).collect()


def test_null_languages_have_no_category(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "doc_id long, lang string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["category"] for r in X.with_category(spark, rows, str(tmp_path)).collect()}
    assert got == {1: None, 2: 0, 3: 1}


def test_model_without_weight_fails(spark):
    import pytest
    p = spark.createDataFrame([(0, 0, [0.9, 0.1]), (0, 9, [0.2, 0.8])], "doc_id long, model int, probs array<double>")
    with pytest.raises(Exception, match="no weight for model 9"):
        N.weighted_vote(p, {0: 1.0}).collect()


def test_top_vocab_is_the_head_of_the_vocab(spark):
    from petrel.operators import vocab as V
    counts = V.word_counts(X.doc_tokens(spark, SF))
    whole = V.build_vocab(counts).where("idx < 500")
    top = V.top_vocab(counts, 500)
    assert top.count() == 498 and top.exceptAll(whole).count() == 0
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_compatibility_capitals_are_lowered(spark):
    from petrel.functions.accents import piece_text
    df = spark.createDataFrame([("  \u2121  ``\u00c9t\u00e9''",)], "text string")
    assert df.select(piece_text("text", lower=True)).first()[0] == 'tel "ete"'


def test_histogram_matches_numpy(spark):
    toks = X.doc_tokens(spark, SF)
    lens = np.array([r[0] for r in toks.select(F.size("tokens")).collect()])
    counts, _ = np.histogram(lens, bins=50)
    got = [r["count"] for r in S.histogram(toks, "tokens", 50).orderBy("bin").collect()]
    assert got == counts.tolist()


def test_histogram_constant(spark):
    df = spark.createDataFrame([([1, 2],), ([3, 4],)], "a array<int>")
    got = [r["count"] for r in S.histogram(df, "a", 4).orderBy("bin").collect()]
    assert got == np.histogram([2, 2], bins=4)[0].tolist()


def test_mean_label_half_even(spark):
    p = spark.createDataFrame([(0, 0, [0.0, 0.0, 1.0, 0.0]), (0, 1, [0.0, 0.0, 0.0, 1.0]),
                               (1, 0, [0.0, 1.0, 0.0, 0.0]), (1, 1, [0.0, 0.0, 1.0, 0.0])],
                              "doc_id long, model int, probs array<double>")
    got = {r["doc_id"]: r["category"] for r in N.mean_label(p).collect()}
    assert got == {0: 2, 1: 2}


def test_weighted_vote(spark):
    p = spark.createDataFrame([(0, 0, [0.9, 0.1]), (0, 1, [0.2, 0.8])], "doc_id long, model int, probs array<double>")
    r = N.weighted_vote(p, {0: 0.4, 1: 0.6}).first()
    assert r["category"] == 1 and abs(r["score"] - 0.52) < 1e-9


def test_exclude_and_drop_empty(spark):
    df = spark.createDataFrame([(0, [1]), (1, []), (2, [3])], "doc_id long, ids array<int>")
    ids = spark.createDataFrame([(2,)], "doc_id long")
    assert sorted(r[0] for r in C.drop_empty(C.exclude_ids(df, ids), "ids").select("doc_id").collect()) == [0]


def test_partition_count_invariance(spark):
    from petrel.plans import catalog as Q
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = Q.vocab_index(spark, SF).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = Q.vocab_index(spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(a) == sorted(b)


def test_ids_below_cap_and_pad_length(spark):
    from petrel.functions import arrays as A
    from petrel.plans import catalog as Q
    seqs = Q.doc_seqs(spark, SF)
    bad = seqs.where(F.exists("ids", lambda x: (x >= F.lit(Q.NUM_WORDS)) | (x < F.lit(1)))).count()
    assert bad == 0
    lens = seqs.select(F.size(A.pad_pre("ids", 37)).alias("n")).distinct().collect()
    assert [r["n"] for r in lens] == [37]


def test_spread_only_when_narrow(spark):
    from petrel.sources.readers import spread
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id") is wide
    narrow = spark.range(0, 100, 1, 1)
    assert spread(narrow, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_first_appearance_negative_and_large_ids(spark):
    df = spark.createDataFrame([(-5, ["x", "y"]), (2 ** 40, ["y", "x", "z"]), (-5, [])],
                               "doc_id long, tokens array<string>")
    got = {r["word"]: (r["cnt"], r["first_doc"], r["first_pos"]) for r in V.word_counts(df).collect()}
    assert got == {"x": (2, -5, 0), "y": (2, -5, 1), "z": (1, 2 ** 40, 2)}


def test_lookup_int_values_any_sign(spark):
    df = spark.createDataFrame([(0, ["a", "b", "c", "a"]), (1, [])], "doc_id long, t array<string>")
    tbl = spark.createDataFrame([("a", -7), ("b", 2147483647), ("c", -2147483648)], "k string, v int")
    got = {r["doc_id"]: r["o"] for r in E.lookup_array(df, "t", tbl, "k", "v", "o").collect()}
    assert got == {0: [-7, 2147483647, -2147483648, -7], 1: []}


def _blocks(spark, monkeypatch, rows, table, block=5, **kw):
    monkeypatch.setattr(E, "BLOCK", block)
    df = spark.createDataFrame(rows, "doc_id long, category int, tokens array<string>").repartition(3)
    out = E.lookup_array(df, "tokens", spark.createDataFrame(table, "word string, idx int"), "word", "idx", "ids", hot=True,
                         carry=("category",), **kw)
    return sorted(((r["doc_id"], r["category"], r["ids"]) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0)), out


def test_large_tables_meet_the_distinct_elements_of_blocks(spark, monkeypatch):
    rows = [(i, None if i % 3 else i, ["hot", f"w{i % 7}", None, "new", "hot"]) for i in range(40)]
    rows += [(None, 1, ["hot"]), (100, 2, []), (101, 3, None), (102, 4, [None])]
    table = [("hot", 2), *((f"w{i}", 10 + i) for i in range(6)), (None, 99)]
    ids = dict(table) | {None: None}
    for kw in ({"on_missing": "default", "default": 1}, {"on_missing": "drop"},
               {"on_missing": "default", "default": 1, "keep_last": 2}):
        got, out = _blocks(spark, monkeypatch, rows, table, **kw)
        cut = kw.get("keep_last", 99)
        want = [(k, c, [x for x in (ids.get(w, kw.get("default")) for w in (t or [])[-cut:] if w is not None) if x is not None])
                for k, c, t in rows]
        assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate" not in plan       # no row per token


def test_blocks_fail_on_repeated_keys_and_elements(spark, monkeypatch):
    table = [("a", 2), ("b", 3)]
    with pytest.raises(Exception, match="repeated key 7"):
        _blocks(spark, monkeypatch, [(7, 1, ["a"]), (7, 1, ["b", "a"])], table)
    got, _ = _blocks(spark, monkeypatch, [(7, 1, ["a"]), (7, 1, []), (8, 1, None), (8, 1, [])], table)
    assert got == [(7, 1, [2]), (8, 1, [])]
    with pytest.raises(Exception, match="repeated key 7"):
        _blocks(spark, monkeypatch, [(7, 1, ["a"])], [*table, ("a", 4)])
    with pytest.raises(Exception, match="no table entry for c"):
        _blocks(spark, monkeypatch, [(7, 1, ["a", "c"])], table, on_missing="error")
