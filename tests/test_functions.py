"""Literal unit cases (FIXTURES.md) for the column functions."""
import pytest
from pyspark.sql import functions as F

from petrel.functions import arrays as A
from petrel.functions import text as T
from petrel.functions.accents import strip_accents
from petrel.operators import clean as C


def one(spark, expr, data, schema):
    return spark.createDataFrame(data, schema).select(expr.alias("r")).first()["r"]


def test_hangul_whitelist(spark):
    assert one(spark, T.keep_chars("s"), [("가나 ㄱㅏ abc1한글!",)], "s string") == "가나 ㄱㅏ 한글"


@pytest.mark.parametrize("seq,expected", [([1, 2, 3], [0, 0, 1, 2, 3]), ([1, 2, 3, 4, 5, 6, 7], [3, 4, 5, 6, 7]),
                                          ([], [0, 0, 0, 0, 0])])
def test_pad_pre(spark, seq, expected):
    assert one(spark, A.pad_pre("a", 5), [(seq,)], "a array<int>") == expected


def test_pad_post(spark):
    assert one(spark, A.pad_post("a", 5, 1), [([7, 8],)], "a array<int>") == [7, 8, 1, 1, 1]
    assert one(spark, A.pad_post("a", 2, 1), [([7, 8, 9],)], "a array<int>") == [7, 8]


@pytest.mark.parametrize("v,k", [([0.0, 1.0, 0.0], 1), ([1.0, 0.0, 0.0], 0), ([0.0, 0.0, 1.0], 2),
                                 ([0.5, 0.2, 0.5], 0)])
def test_argmax_first_max(spark, v, k):
    assert one(spark, A.argmax("p"), [(v,)], "p array<double>") == k


def test_special_ids_masks_types(spark):
    df = spark.createDataFrame([([7, 8], [9])], "a array<int>, b array<int>")
    r = df.select(A.add_special("a", 2, 3).alias("s"), A.add_special("a", 2, 3, "b").alias("p"),
                  A.special_mask("a").alias("ms"), A.special_mask("a", "b").alias("mp"),
                  A.token_types("a").alias("ts"), A.token_types("a", "b").alias("tp"),
                  A.special_mask_done(A.add_special("a", 2, 3, "b"), 2, 3).alias("md")).first()
    assert r["s"] == [2, 7, 8, 3] and r["p"] == [2, 7, 8, 3, 9, 3]
    assert r["ms"] == [1, 0, 0, 1] and r["mp"] == [1, 0, 0, 1, 0, 1]
    assert r["ts"] == [0, 0, 0, 0] and r["tp"] == [0, 0, 0, 0, 1, 1]
    assert r["md"] == [1, 0, 0, 1, 0, 1]


def test_detokenize(spark):
    assert one(spark, A.detokenize("t"), [(["▁ab", "c", "▁d"],)], "t array<string>") == "abc d"


def test_attention_mask_left_padding(spark):
    # per position, so left padding is masked where it is (not moved to the end)
    assert one(spark, A.attention_mask(A.pad_pre("a", 5), 0), [([4, 5],)], "a array<int>") == [0, 0, 0, 1, 1]


def test_connection_codes(spark):
    df = spark.createDataFrame([(0,), (1,), (5,)], "c int")
    got = [r[0] for r in df.select(C.label_codes("c")).collect()]
    assert got == ["미연결", "연결완료", None]


def test_literal_newline(spark):
    df = spark.createDataFrame([("a\\nb",)], "s string")
    r = df.select(T.strip_literal_newline("s").alias("x"), T.strip_literal_newline("s", "").alias("y")).first()
    assert r["x"] == "a b" and r["y"] == "ab"


def test_clean_chain(spark):
    s = "  Hello <b>World</b> 123\t　Foo  "
    assert one(spark, T.clean_text("s"), [(s,)], "s string") == "hello world foo"


def test_symbols_and_quotes(spark):
    assert one(spark, T.symbols_to_space("s"), [("a★b…c",)], "s string") == "a b c"
    assert one(spark, T.norm_quotes("s"), [("``x''",)], "s string") == '"x"'


def test_squeeze_unicode_space(spark):
    assert one(spark, T.squeeze_space("s"), [("\x1c a   b\x85",)], "s string") == "a b"


def test_strip_accents(spark):
    assert one(spark, strip_accents("s"), [("Éçàñ",)], "s string") == "Ecan"
    # NFKD leaves Hangul syllables decomposed into conjoining jamo (not combining marks)
    assert one(spark, strip_accents("s"), [("\uac00",)], "s string") == "\u1100\u1161"


def test_fused_tokens_equal_chain(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = A.tokenize(T.corpus_text("text"))
    b = A.tokenize(T.corpus_words_text("text"), T.CORPUS_SEPARATORS)
    assert df.where(~F.equal_null(a, b)).count() == 0


def test_one_hot_and_softmax(spark):
    r = spark.createDataFrame([(2, [1.0, 1.0])], "y int, v array<double>").select(
        A.one_hot("y", 3).alias("o"), A.softmax("v").alias("s")).first()
    assert r["o"] == [0.0, 0.0, 1.0] and r["s"] == [0.5, 0.5]


def test_korean_symbols_and_tokens(spark):
    assert one(spark, T.symbols_to_space("s"), [("안녕★하세요…!",)], "s string") == "안녕 하세요  "
    from petrel.operators import tokens as TK
    df = spark.createDataFrame([(0, "청원합니다. 2020년 <b>교육</b>! 가 좀")], "doc_id long, text string")
    toks = TK.corpus_tokens(df, stop=TK.SHORT_STOP_WORDS, min_chars=0).first()["tokens"]
    assert toks == ["청원합니다", "년", "교육"]
    toks1 = TK.corpus_tokens(df, stop=TK.SHORT_STOP_WORDS, min_chars=1).first()["tokens"]
    assert toks1 == ["청원합니다", "교육"]
