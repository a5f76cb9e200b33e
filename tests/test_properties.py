"""Property tests: array functions against plain-Python definitions, and
invariance to input partitioning.  Each hypothesis example is a whole batch of
rows evaluated in one Spark job."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from petrel.functions import arrays as A
from petrel.operators import tokens as T
from petrel.operators import vocab as V

ints = st.lists(st.integers(min_value=0, max_value=50), max_size=12)


def py_pad_pre(xs, n):
    xs = xs[-n:] if n else []
    return [0] * (n - len(xs)) + xs


def py_pad_post(xs, n, v):
    xs = xs[:n]
    return xs + [v] * (n - len(xs))


def py_argmax(xs):
    return xs.index(max(xs))


@settings(max_examples=15, deadline=None)
@given(batch=st.lists(ints, min_size=1, max_size=30), n=st.integers(min_value=1, max_value=10))
def test_padding_and_masks(spark, batch, n):
    df = spark.createDataFrame([(i, xs) for i, xs in enumerate(batch)], "i int, a array<int>")
    rows = df.select("i", A.pad_pre("a", n).alias("pre"), A.pad_post("a", n, 9).alias("post"),
                     A.special_mask("a").alias("sm"), A.token_types("a", "a").alias("tt"),
                     A.add_special("a", 98, 99, "a").alias("sp"),
                     A.attention_mask(A.pad_post("a", n, 0), 0).alias("am")).collect()
    for r in rows:
        xs = batch[r["i"]]
        assert r["pre"] == py_pad_pre(xs, n)
        assert r["post"] == py_pad_post(xs, n, 9)
        assert r["sm"] == [1] + [0] * len(xs) + [1]
        assert r["tt"] == [0] * (len(xs) + 2) + [1] * (len(xs) + 1)
        assert r["sp"] == [98] + xs + [99] + xs + [99]
        assert r["am"] == [int(x != 0) for x in py_pad_post(xs, n, 0)]


@settings(max_examples=15, deadline=None)
@given(batch=st.lists(st.lists(st.floats(min_value=-5, max_value=5, allow_nan=False), min_size=1, max_size=6),
                      min_size=1, max_size=30))
def test_argmax_first(spark, batch):
    df = spark.createDataFrame([(i, xs) for i, xs in enumerate(batch)], "i int, p array<double>")
    for r in df.select("i", A.argmax("p").alias("k")).collect():
        assert r["k"] == py_argmax(batch[r["i"]])


@settings(max_examples=10, deadline=None)
@given(batch=st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd", "ee", "f"]), max_size=8), min_size=1, max_size=25))
def test_vocab_rank_matches_python(spark, batch):
    df = spark.createDataFrame([(i, xs) for i, xs in enumerate(batch)], "doc_id long, tokens array<string>")
    got = {r["word"]: r["idx"] for r in V.build_vocab(V.word_counts(df)).collect()}
    counts, first = {}, {}
    for d, xs in enumerate(batch):
        for p, w in enumerate(xs):
            counts[w] = counts.get(w, 0) + 1
            first.setdefault(w, (d, p))
    order = sorted(counts, key=lambda w: (-counts[w], first[w]))
    assert got == {w: i + 2 for i, w in enumerate(order)}


def test_input_partitioning_invariance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    results = []
    for k in (1, 5, 13):
        toks = T.corpus_tokens(docs.repartition(k), stop=["the", "and"])
        results.append(sorted(V.build_vocab(V.word_counts(toks)).collect()))
    assert results[0] == results[1] == results[2]
