"""The registered queries: one per operator of the inventory.

Every query takes (spark, sf_dir) and reads the whole given tables.  Array
outputs are rendered as text (``join_ints``) so that their value hash does not
depend on how an engine prints lists; integers are ``long``, fractions are
rounded to 6 places.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.functions import accents as AC
from petrel.functions import arrays as A
from petrel.functions import text as TX
from petrel.operators import bars as B
from petrel.operators import clean as C
from petrel.operators import encode as E
from petrel.operators import ensemble as N
from petrel.operators import heavy as HV
from petrel.operators import index as I
from petrel.operators import models as M
from petrel.operators import stats as S
from petrel.operators import tokens as T
from petrel.operators import vocab as V
from petrel.plans import fixtures as X
from petrel.plans.classify import classify
from petrel.plans.corpus import prepare_corpus
from petrel.session import scratch_dir
from petrel.sources import readers as R
from petrel.sources import writers as W

Query = Callable[[SparkSession, str], DataFrame]

# --- parameters of the registered queries ---------------------------------------------
NUM_WORDS = X.NUM_WORDS   # vocabulary cap
PAD_PRE_LEN = 300         # left padding length of the sequence models
MODEL_LEN = 512           # model input length
PAIR_LEN = 64             # model input length of pairs
CLS_ID, SEP_ID = NUM_WORDS, NUM_WORDS + 1   # special ids appended after the capped words
RARE_THRESHOLD = 2        # words seen fewer times are rare
HIST_BINS = 50
BASE_DATE = "2024-01-20"  # bar requests are "as of" this date, never the clock
PAGE_SIZE = 20            # bars per code and request
MARKET = "BUILDING"
POINT_CODE = "000042"
KEEP_CLASS = "[^A-Za-zÀ-ÿ ]"   # whitelist stand-in (the test text has no Hangul)
LR_SLACK = 1e-3           # length of a gradient that counts as none
NB_CANDIDATES = (50, 500, 5000)  # vocabulary caps of the select-best candidates
# ---------------------------------------------------------------------------------------


def _t(spark, sf, name):
    return X.table(spark, sf, name)


def _docs(spark, sf):
    return _t(spark, sf, "documents")


def _cleaned(fn: Callable, table: str = "documents", key: str = "doc_id", col: str = "text") -> Query:
    def q(spark, sf):
        return _t(spark, sf, table).select(key, fn(F.col(col)).alias("clean"))
    return q


def _tok_out(df: DataFrame, col: str = "tokens", key: str = "doc_id") -> DataFrame:
    return df.select(key, F.size(col).cast("long").alias("n_tokens"),
                     F.array_join(col, " ").alias("tokens"))


def _ids_out(df: DataFrame, col: str = "ids", key: str = "doc_id", name: str = "ids") -> DataFrame:
    return df.select(key, F.size(col).cast("long").alias("n_ids"), A.join_ints(col).alias(name))


# --- shared intermediate frames ------------------------------------------------------------

def doc_seqs(spark, sf, oov=True, keep_last=None, carry=()):
    """(doc_id, ids): all documents encoded with the capped training vocabulary."""
    vocab = X.capped_vocab(spark, sf, oov=oov)
    toks = X.doc_tokens(spark, sf)
    if carry:
        toks = X.with_category(spark, toks, sf)
    return E.encode(toks, vocab, num_words=NUM_WORDS, oov=oov, keep_last=keep_last, carry=carry)


def conv_pairs(spark, sf):
    """(conv_id, turn, a, b): turn t and t+1 of a conversation, both encoded."""
    conv = _t(spark, sf, "conversations").select("conv_id", "turn", "text")
    toks = T.corpus_tokens(conv, stop=X.stop_list(spark, sf), key="conv_id")
    # everything is keyed by (conv_id, turn), so one huge conversation is spread;
    # the encoded turns are materialised once and read by both join sides
    enc = E.encode(toks, X.capped_vocab(spark, sf), num_words=NUM_WORDS, key="conv_id",
                   carry=("turn",)).checkpoint()
    nxt = enc.select("conv_id", (F.col("turn") - F.lit(1)).alias("turn"), F.col("ids").alias("b"))
    return enc.withColumnRenamed("ids", "a").join(nxt, ["conv_id", "turn"])


# --- sources -----------------------------------------------------------------------------

def src_csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "corpus-csv")
    W.write_corpus_csv(_docs(spark, sf).select("doc_id", F.col("text").alias("data"), "lang"), path)
    df = R.read_corpus(spark, path, "doc_id long, data string, lang string")
    return df.select("doc_id", F.col("data").alias("text"), "lang")


def src_stopwords_tsv(spark, sf):
    path = scratch_dir(spark, "stop-tsv")
    W.write_tsv(X.stop_table(spark, sf), path)
    return R.read_tsv(spark, path)


def src_vocab_lines(spark, sf):
    path = scratch_dir(spark, "vocab-lines")
    vocab = X.train_vocab(spark, sf).select(F.col("word").alias("token"), F.col("idx").alias("id"))
    W.write_vocab_lines(vocab, path)
    return R.read_vocab(spark, path).select("token", F.col("id").cast("long").alias("id"))


# --- cleaning ------------------------------------------------------------------------------

def clean_drop_nulls(spark, sf):
    j = _docs(spark, sf).select("doc_id").join(_t(spark, sf, "labels"), "doc_id", "left")
    return C.drop_nulls(j).select("doc_id", F.col("quality").cast("long").alias("quality"),
                                  F.col("toxic").cast("long").alias("toxic"))


def clean_cast_labels(spark, sf):
    j = (_docs(spark, sf).select("doc_id", F.col("text").alias("data"))
         .join(_t(spark, sf, "labels").select("doc_id", F.col("quality").alias("category")), "doc_id"))
    return C.cast_corpus(j).select("doc_id", F.col("category").cast("long").alias("category"), "data")


def filter_exclude_ids(spark, sf):
    ids = _t(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return C.exclude_ids(_docs(spark, sf).select("doc_id"), ids)


def dense_index(spark, sf):
    kept = filter_exclude_ids(spark, sf)
    return I.dense_index(kept, ["doc_id"], name="idx")


def filter_empty(spark, sf):
    return _ids_out(C.drop_empty(doc_seqs(spark, sf, oov=False), "ids")).select("doc_id", "n_ids")


def head_n(spark, sf):
    return C.head(_docs(spark, sf).select("doc_id", "lang", "n_chars"), "doc_id", 5)


def tail_n(spark, sf):
    return C.tail(_docs(spark, sf).select("doc_id", "lang", "n_chars"), "doc_id", 5)


def shape(spark, sf):
    return C.shape(_docs(spark, sf)).select("n_rows", F.col("n_cols").cast("long"))


def label_codes(spark, sf):
    d = X.with_category(spark, _docs(spark, sf).select("doc_id", "lang"), sf)
    return d.select("doc_id", F.col("category").cast("long").alias("category"),
                    C.label_codes("category", C.CLASS_NAMES).alias("name"))


def attach_predictions(spark, sf):
    sub = _docs(spark, sf).select("doc_id", F.lit(None).cast("int").alias("category"))
    preds = _t(spark, sf, "labels").select("doc_id", F.col("quality").alias("category"))
    # rendered as text: documents without a prediction keep a null, which
    # pandas shows the same way for both engines (a nullable long would not)
    return C.attach(sub, preds, "doc_id", ["category"]).select(
        "doc_id", F.col("category").cast("string").alias("category"))


# --- tokens --------------------------------------------------------------------------------

def tok_words(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    return _tok_out(T.corpus_tokens(d, stop=None, min_chars=0))


def tok_stop(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    return _tok_out(T.corpus_tokens(d, stop=X.stop_words(spark, sf), min_chars=0))


def tok_minlen(spark, sf):
    return _tok_out(X.doc_tokens(spark, sf))


def stop_union(spark, sf):
    return X.stop_words(spark, sf)


def tok_detok(spark, sf):
    pieces = X.doc_tokens(spark, sf).select(
        "doc_id", F.transform("tokens", lambda w: F.concat(F.lit(A.PIECE_PREFIX), w)).alias("p"))
    return pieces.select("doc_id", A.detokenize("p").alias("text"))


# --- vocabulary ----------------------------------------------------------------------------

def _train_tokens(spark, sf):
    return X.doc_tokens(spark, sf, part=X.labelled)


def vocab_counts(spark, sf):
    return V.word_counts(_train_tokens(spark, sf)).select(
        "word", "cnt", "first_doc", F.col("first_pos").cast("long").alias("first_pos"))


def vocab_index(spark, sf):
    return X.train_vocab(spark, sf).select("word", "cnt", F.col("idx").cast("long").alias("idx"))


def vocab_docfreq(spark, sf):
    return V.doc_freq(_train_tokens(spark, sf))


def vocab_rare_stats(spark, sf):
    return V.rare_stats(V.word_counts(_train_tokens(spark, sf)), RARE_THRESHOLD)


def vocab_topk(spark, sf):
    return X.capped_vocab(spark, sf).select(
        "word", F.col("idx").cast("long").alias("idx"))


def vocab_topk_bounded(spark, sf):
    """The capped vocabulary by bounded summaries per task; tokenised once for both passes."""
    train = _train_tokens(spark, sf).checkpoint()
    return HV.top_vocab_bounded(train, NUM_WORDS).select("word", F.col("idx").cast("long").alias("idx"))


def vocab_size(spark, sf):
    return V.vocab_size(X.piece_vocab(spark, X.capped_vocab(spark, sf))).select(
        F.col("vocab_size").cast("long"))


def vocab_id_gaps(spark, sf):
    vocab = X.train_vocab(spark, sf)
    df = V.doc_freq(_train_tokens(spark, sf)).filter(F.col("doc_count") >= 2)
    kept = vocab.join(df, "word", "left_semi").select(F.col("word").alias("token"),
                                                      F.col("idx").cast("long").alias("id"))
    return I.id_gaps(kept, "id").select("token", "id", F.col("line").cast("long"), "gap")


# --- encoding ------------------------------------------------------------------------------

def enc_sequences(spark, sf):
    return _ids_out(doc_seqs(spark, sf))


def enc_sequences_no_oov(spark, sf):
    return _ids_out(doc_seqs(spark, sf, oov=False))


def enc_sequences_full(spark, sf):
    """All words of the training vocabulary, without a cap: the distinct words of blocks of documents are joined."""
    # tokenised once for the vocabulary, too
    toks = X.doc_tokens(spark, sf).checkpoint()
    return _ids_out(E.encode(toks, V.build_vocab(V.word_counts(X.labelled(spark, toks, sf)))))


def _pieces(spark, sf):
    # one table for encoding and decoding
    table = X.piece_vocab(spark, X.capped_vocab(spark, sf)).checkpoint()
    toks = X.doc_tokens(spark, sf).select("doc_id", F.col("tokens").alias("pieces"))
    return E.pieces_to_ids(toks, table, unk_id=0), table


def enc_pieces(spark, sf):
    ids, _ = _pieces(spark, sf)
    return _ids_out(ids)


def enc_inverse(spark, sf):
    ids, table = _pieces(spark, sf)
    back = E.ids_to_tokens(ids, table)
    return _tok_out(back)


def enc_pad_pre(spark, sf):
    seqs = doc_seqs(spark, sf, keep_last=PAD_PRE_LEN)
    return seqs.select("doc_id", A.join_ints(A.pad_pre("ids", PAD_PRE_LEN)).alias("ids"))


def enc_pad_post(spark, sf):
    seqs = doc_seqs(spark, sf)
    return seqs.select("doc_id", A.join_ints(A.pad_post("ids", MODEL_LEN, 0)).alias("ids"))


def enc_special_single(spark, sf):
    seqs = doc_seqs(spark, sf)
    return seqs.select("doc_id", A.join_ints(A.add_special("ids", CLS_ID, SEP_ID)).alias("ids"))


def enc_special_pair(spark, sf):
    p = conv_pairs(spark, sf)
    return p.select("conv_id", "turn", A.join_ints(A.add_special("a", CLS_ID, SEP_ID, "b")).alias("ids"))


def enc_mask_special(spark, sf):
    p = conv_pairs(spark, sf)
    return p.select("conv_id", "turn", A.join_ints(A.special_mask("a", "b")).alias("mask"))


def enc_mask_special_done(spark, sf):
    seqs = doc_seqs(spark, sf)
    done = A.add_special("ids", CLS_ID, SEP_ID)
    return seqs.select("doc_id", A.join_ints(A.special_mask_done(done, CLS_ID, SEP_ID)).alias("mask"))


def enc_token_types(spark, sf):
    p = conv_pairs(spark, sf)
    return p.select("conv_id", "turn", A.join_ints(A.token_types("a", "b")).alias("types"))


def enc_attention(spark, sf):
    seqs = doc_seqs(spark, sf)
    return seqs.select("doc_id", A.join_ints(A.attention_mask(A.pad_post("ids", MODEL_LEN, 0), 0)).alias("mask"))


def enc_model_input(spark, sf):
    seqs = doc_seqs(spark, sf, carry=("category",))
    mi = E.model_input("ids", MODEL_LEN, CLS_ID, SEP_ID, 0).alias("mi")
    return seqs.select("doc_id", mi, F.col("category").cast("long").alias("target")).select(
        "doc_id", A.join_ints("mi.ids").alias("ids"), A.join_ints("mi.mask").alias("mask"),
        A.join_ints("mi.segment").alias("segment"), "target")


def enc_model_input_padded(spark, sf):
    seqs = doc_seqs(spark, sf, keep_last=PAD_PRE_LEN, carry=("category",))
    n_cls = seqs.select(F.max("category") + F.lit(1)).scalar()
    mi = E.model_input_padded(A.pad_pre("ids", PAD_PRE_LEN), A.one_hot("category", F.col("_k"))).alias("mi")
    return seqs.withColumn("_k", n_cls).select("doc_id", mi).select(
        "doc_id", A.join_ints("mi.ids").alias("ids"), A.join_ints("mi.mask").alias("mask"),
        A.join_ints("mi.segment").alias("segment"), F.col("mi.target").cast("long").alias("target"))


# --- labels, statistics, split ---------------------------------------------------------------

def lbl_one_hot(spark, sf):
    d = X.with_category(spark, _docs(spark, sf).select("doc_id", "lang"), sf)
    d = d.withColumn("_k", d.select(F.max("category") + F.lit(1)).scalar())
    oh = A.one_hot("category", F.col("_k"))
    return d.select("doc_id", A.join_ints(F.transform(oh, lambda x: x.cast("int"))).alias("one_hot"))


def lbl_argmax(spark, sf):
    p = X.pseudo_predictions(spark, sf)
    return p.select("doc_id", F.col("model").cast("long").alias("model"),
                    A.argmax("probs").cast("long").alias("category"))


def stat_length(spark, sf):
    return S.length_stats(X.doc_tokens(spark, sf), "tokens").select(
        F.col("max_len").cast("long"), "mean_len", "n_rows")


def stat_histogram(spark, sf):
    return S.histogram(X.doc_tokens(spark, sf), "tokens", HIST_BINS).select(
        F.col("bin").cast("long"), "lo", "hi", "count")


def stat_coverage(spark, sf):
    return S.coverage(X.doc_tokens(spark, sf), "tokens", PAD_PRE_LEN)


def split_tail(spark, sf):
    lab = X.labelled(spark, _docs(spark, sf).select("doc_id"), sf)
    return I.tail_split(lab, "doc_id", 0.2)


# --- models --------------------------------------------------------------------------------

def _nb_predict(train_tok, counts, num_words):
    # a few words, read by three steps of the fit: counted once
    model = M.nb_fit(train_tok, V.top_vocab(counts, num_words).select("word").checkpoint())
    return lambda df: M.nb_score(model, df)


def model_nb_counts(spark, sf):
    # the labelled tokens feed the vocabulary and the fit: tokenise once
    train = X.with_category(spark, X.doc_tokens(spark, sf, part=X.labelled), sf).checkpoint()
    predict = _nb_predict(train, V.word_counts(train), NUM_WORDS)
    test = X.doc_tokens(spark, sf, part=X.unlabelled)
    return predict(test).select("doc_id", F.col("prediction").cast("long").alias("category"))


def _train_valid(spark, sf):
    toks = X.with_category(spark, X.doc_tokens(spark, sf, part=X.labelled), sf)
    lab = I.tail_split(toks, "doc_id", 0.2).checkpoint()
    return lab.filter(F.col("split") == "train"), lab.filter(F.col("split") == "valid")


def model_select_best(spark, sf):
    train, valid = _train_valid(spark, sf)
    vocab = V.top_vocab(V.word_counts(train), max(NB_CANDIDATES)).select("word", "idx").checkpoint()
    model = M.nb_fit_nested(train, vocab, NB_CANDIDATES)
    return M.select_best(M.validate_nested(model, valid, [f"nb_{n}" for n in NB_CANDIDATES]))


def _train_and_unlabelled(spark, sf):
    toks = X.with_category(spark, X.doc_tokens(spark, sf), sf).checkpoint()
    return X.labelled(spark, toks, sf).where(F.col("category").isNotNull()), X.unlabelled(spark, toks, sf)


def model_lr(spark, sf):
    train, rest = _train_and_unlabelled(spark, sf)
    return M.score(M.lr_fit(train), rest).select("doc_id", F.col("prediction").cast("long"))


def model_rf(spark, sf):
    train, rest = _train_and_unlabelled(spark, sf)
    return M.score(M.rf_fit(train), rest).select("doc_id", F.col("prediction").cast("long"))


def cert_lr(spark, sf):
    """The gradient of the penalised loss vanishes at the fitted weights, up to ``LR_SLACK`` (M2)."""
    train, _ = _train_and_unlabelled(spark, sf)
    model = M.lr_fit(train, max_iter=500, tol=1e-10)
    grad = M.lr_gradient(model, train)
    return grad.select(F.col("class").cast("long").alias("category"), (F.col("gradient") < LR_SLACK).alias("stationary"))


def cert_rf(spark, sf):
    """The saved trees, walked by joins, give every document the fitted forest's probabilities (M4)."""
    train, rest = _train_and_unlabelled(spark, sf)
    words = M.train_words(train)
    model = M.rf_fit(train, words)
    nodes = M.forest_nodes(spark, W.save_model(model, scratch_dir(spark, "forest"))).checkpoint()
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, feature int")
    forest = model.stages[-1]
    votes = M.forest_replay(nodes, rest, table, forest.getMaxDepth())
    return _agree(M.score(model, rest), votes.select("doc_id", F.transform("votes", lambda v: v / forest.getNumTrees).alias("probs")))


def cert_mlp(spark, sf):
    """The layers' weights, applied by array expressions, give every vector the perceptron's probabilities (M3)."""
    emb = _t(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id").where(
        F.col("embedding").isNotNull() & F.col("label").isNotNull())
    model = M.mlp_fit(emb, label="label", vec="embedding", hidden=16, max_iter=20)
    return _agree(M.score(model, emb, vec="embedding"), M.mlp_forward(model, emb))


def _agree(fitted, recomputed):
    """(doc_id, same): whether all probabilities agree to 9 places."""
    other = recomputed.select("doc_id", F.col("probs").alias("q"))
    close = F.forall(F.zip_with("probs", "q", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x)
    return fitted.join(other, "doc_id").select("doc_id", close.alias("same"))


def sink_model(spark, sf):
    """A fitted model saved and restored predicts the same for every document (K4)."""
    train, rest = _train_and_unlabelled(spark, sf)
    model = M.lr_fit(train)
    again = W.load_model(W.save_model(model, scratch_dir(spark, "model")))
    a = M.score(model, rest).select("doc_id", "prediction", "probs")
    b = M.score(again, rest).select("doc_id", F.col("prediction").alias("p2"), F.col("probs").alias("q2"))
    return a.join(b, "doc_id").select("doc_id", ((F.col("prediction") == F.col("p2")) & (F.col("probs") == F.col("q2")))
                                      .alias("same"))


def model_embedding_mlp(spark, sf):
    emb = _t(spark, sf, "embeddings")
    lab = I.tail_split(emb.withColumnRenamed("vec_id", "doc_id"), "doc_id", 0.2)
    train = lab.filter(F.col("split") == "train")
    model = M.mlp_fit(train, label="label", vec="embedding", max_iter=50)
    valid = lab.filter(F.col("split") == "valid")
    return M.score(model, valid, vec="embedding").select("doc_id", F.col("prediction").cast("long"))


def metric_accuracy(spark, sf):
    p = X.pseudo_predictions(spark, sf).withColumn("prediction", A.argmax("probs"))
    return N.accuracy(p, "prediction", "target", by="model").select(
        F.col("model").cast("long"), "accuracy", "n")


def metric_cross_entropy(spark, sf):
    p = X.pseudo_predictions(spark, sf)
    return N.cross_entropy(p, "probs", "target", by="model").select(
        F.col("model").cast("long"), "cross_entropy", "n")


# --- ensemble --------------------------------------------------------------------------------

def ens_weighted(spark, sf):
    out = N.weighted_vote(X.pseudo_predictions(spark, sf))
    # probabilities have 6 decimals and weights 1, so the exact score lies on a
    # 1e-7 grid: rounding to 6 places would hit exact ties that engines break
    # differently; 9 places keeps the exact value
    return out.select("doc_id", F.col("category").cast("long"), F.round("score", 9).alias("score"))


def ens_mean_label(spark, sf):
    return N.mean_label(X.pseudo_predictions(spark, sf)).select(
        "doc_id", F.col("category").cast("long"))


# --- securities and bars ---------------------------------------------------------------------

def _bar_out(df):
    return df.select("code", F.col("dt").cast("string").alias("dt"), "open", "high", "low", "close", "volume")


def bars_daily(spark, sf):
    return _bar_out(X.daily_bar_table(spark, sf))


def bars_merged(spark, sf):
    """Bars of ticks that came in three batches out of order, one of them twice, from the stored states."""
    late = X.ticks(spark, sf).withColumn("batch", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    # each table is stored: its aggregation is then the only one that a task holds in memory
    states = {b: _stored(spark, B.bar_states(late.where(F.col("batch") == b), "batch", tiebreak="event_id"), "bar-states")
              for b in (0, 1, 2)}
    store = states[2]
    for b in (0, 2, 1):
        store = _stored(spark, B.add_states(store, states[b]), "bar-store")
    return _bar_out(B.merged_bars(store))


def _stored(spark, df, name):
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sec_by_market(spark, sf):
    m = X.security_master(spark, sf)
    return B.securities(m.select("code", "market"), m.select("code", "name"), MARKET)


def sec_point_lookup(spark, sf):
    c = _t(spark, sf, "customer").withColumn("code", B.as_code("c_custkey"))
    return B.security_info(c, POINT_CODE, key_col="c_custkey").select("code", "c_name", F.col("c_nationkey").cast("long"),
                                                 "c_acctbal", "c_mktsegment")


def bars_latest_per_code(spark, sf):
    return _bar_out(_latest_page(spark, sf))


def _latest_page(spark, sf):
    codes = sec_by_market(spark, sf).select("code")
    return B.daily_bars(X.daily_bar_table(spark, sf), codes, BASE_DATE, PAGE_SIZE)


def bars_head_per_code(spark, sf):
    page = _latest_page(spark, sf)
    return B.head_per_code(page, 10).select("code", F.col("dt").cast("string").alias("dt"), "close",
                                            F.col("rank").cast("long"))


# --- the Python stages ------------------------------------------------------------------------

def clean_accents(spark, sf):
    return _docs(spark, sf).select("doc_id", AC.strip_accents("text").alias("clean"))


def clean_piece_text(spark, sf):
    return _docs(spark, sf).select("doc_id", AC.piece_text("text", lower=True).alias("clean"))


# --- round trips and the whole flow -------------------------------------------------------------

def src_whole_text(spark, sf):
    """One text file per benchmark item, read back whole."""
    path = scratch_dir(spark, "texts")
    (_t(spark, sf, "benchmark").select("item_id", F.col("text").alias("value"))
     .write.partitionBy("item_id").option("lineSep", "\n").text(path))
    df = R.read_text(spark, path)
    return df.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"),
                     F.regexp_replace("text", "\n$", "").alias("text"))


def sink_arrays(spark, sf):
    """Token lists and sequences as array columns, read back."""
    path = W.write_arrays(doc_seqs(spark, sf), scratch_dir(spark, "arrays"))
    return _ids_out(R.read_arrays(spark, path))


def sink_vocab_json(spark, sf):
    """The vocabulary as JSON lines, read back."""
    path = W.write_vocab_json(X.train_vocab(spark, sf), scratch_dir(spark, "vocab-json"))
    return R.read_json(spark, path, "word string, cnt long, idx long")


def flow_submission(spark, sf):
    """Prepare, fit, score, vote, write the submission and read it back (K1).

    Trained on the labelled documents that are not toxic, with the vocabulary
    cut by the rare-word rule; every unlabelled document gets an answer."""
    docs = X.with_category(spark, _docs(spark, sf).select("doc_id", F.col("text").alias("data"), "lang"), sf).drop("lang")
    toxic = _t(spark, sf, "labels").where("toxic = 1").select("doc_id")
    prep = prepare_corpus(X.labelled(spark, docs, sf), X.unlabelled(spark, docs, sf).drop("category"),
                          stop=X.stop_list(spark, sf), exclude=toxic, rare_threshold=RARE_THRESHOLD,
                          max_len=PAD_PRE_LEN)
    path = W.write_submission(classify(prep, models=("nb",)), scratch_dir(spark, "submission"), run_id="check")
    out = spark.read.options(**R.CSV_OPTIONS).option("header", "true").schema("doc_id long, category long").csv(path)
    return out


def bars_price_flag(spark, sf):
    """Both settings of the adjusted flag; the adjusted price is half the close here."""
    codes = sec_by_market(spark, sf).select("code")
    bars = X.daily_bar_table(spark, sf).withColumn("adj", F.col("close") / F.lit(2.0)).select("code", "dt", "close", "adj")
    parts = [B.daily_bars(bars, codes, BASE_DATE, PAGE_SIZE, adjusted=a, adjusted_col="adj", raw_col="close")
             .select("code", F.col("dt").cast("string").alias("dt"), F.lit(a).alias("adjusted"), "price") for a in (True, False)]
    return parts[0].unionByName(parts[1])


def enc_model_input_pair(spark, sf):
    p = conv_pairs(spark, sf)
    mi = E.model_input("a", PAIR_LEN, CLS_ID, SEP_ID, 0, pair="b").alias("mi")
    return p.select("conv_id", "turn", mi).select(
        "conv_id", "turn", A.join_ints("mi.ids").alias("ids"), A.join_ints("mi.mask").alias("mask"),
        A.join_ints("mi.segment").alias("segment"))


QUERIES: dict[str, Query] = {
    "src_csv_roundtrip": src_csv_roundtrip,
    "src_stopwords_tsv": src_stopwords_tsv,
    "src_vocab_lines": src_vocab_lines,
    "clean_text": _cleaned(TX.clean_text),
    "clean_html": _cleaned(TX.clean_text, "pages", "page_id", "html"),
    "clean_strip_punct": _cleaned(TX.strip_punct),
    "clean_literal_newline": _cleaned(TX.strip_literal_newline),
    "clean_symbols": _cleaned(TX.symbols_to_space),
    "clean_squeeze": _cleaned(TX.squeeze_space),
    "clean_quotes": _cleaned(TX.norm_quotes),
    "clean_accents": clean_accents,
    "clean_lower": _cleaned(TX.lower),
    "clean_keep_chars": _cleaned(lambda c: TX.keep_chars(c, KEEP_CLASS)),
    "clean_cast_labels": clean_cast_labels,
    "clean_drop_nulls": clean_drop_nulls,
    "filter_exclude_ids": filter_exclude_ids,
    "filter_empty": filter_empty,
    "dense_index": dense_index,
    "head_n": head_n,
    "tail_n": tail_n,
    "shape": shape,
    "label_codes": label_codes,
    "attach_predictions": attach_predictions,
    "tok_words": tok_words,
    "tok_stop": tok_stop,
    "tok_minlen": tok_minlen,
    "stop_union": stop_union,
    "tok_detok": tok_detok,
    "vocab_counts": vocab_counts,
    "vocab_index": vocab_index,
    "vocab_docfreq": vocab_docfreq,
    "vocab_rare_stats": vocab_rare_stats,
    "vocab_topk": vocab_topk,
    "vocab_size": vocab_size,
    "vocab_id_gaps": vocab_id_gaps,
    "enc_sequences": enc_sequences,
    "enc_sequences_no_oov": enc_sequences_no_oov,
    "enc_pieces": enc_pieces,
    "enc_inverse": enc_inverse,
    "enc_pad_pre": enc_pad_pre,
    "enc_pad_post": enc_pad_post,
    "enc_special_single": enc_special_single,
    "enc_special_pair": enc_special_pair,
    "enc_mask_special": enc_mask_special,
    "enc_mask_special_done": enc_mask_special_done,
    "enc_token_types": enc_token_types,
    "enc_attention": enc_attention,
    "enc_model_input": enc_model_input,
    "enc_model_input_padded": enc_model_input_padded,
    "lbl_one_hot": lbl_one_hot,
    "lbl_argmax": lbl_argmax,
    "stat_length": stat_length,
    "stat_histogram": stat_histogram,
    "stat_coverage": stat_coverage,
    "split_tail": split_tail,
    "model_nb_counts": model_nb_counts,
    "model_select_best": model_select_best,
    "model_lr": model_lr,
    "model_rf": model_rf,
    "model_embedding_mlp": model_embedding_mlp,
    "metric_accuracy": metric_accuracy,
    "metric_cross_entropy": metric_cross_entropy,
    "ens_weighted": ens_weighted,
    "ens_mean_label": ens_mean_label,
    "bars_daily": bars_daily,
    "sec_by_market": sec_by_market,
    "sec_point_lookup": sec_point_lookup,
    "bars_latest_per_code": bars_latest_per_code,
    "bars_head_per_code": bars_head_per_code,
    "clean_piece_text": clean_piece_text,
    "clean_literal_newline_removed": _cleaned(lambda c: TX.strip_literal_newline(c, "")),
    "src_whole_text": src_whole_text,
    "sink_arrays": sink_arrays,
    "sink_vocab_json": sink_vocab_json,
    "sink_model": sink_model,
    "flow_submission": flow_submission,
    "bars_price_flag": bars_price_flag,
    "vocab_topk_bounded": vocab_topk_bounded,
    "enc_sequences_full": enc_sequences_full,
    "cert_lr": cert_lr,
    "cert_rf": cert_rf,
    "cert_mlp": cert_mlp,
    "bars_merged": bars_merged,
    "enc_model_input_pair": enc_model_input_pair,
}
