"""DuckDB SQL for the registered queries (the correctness oracle).

Written independently of the Spark code path: plain SQL over the parquet views
(window functions, ``unnest``, list lambdas).  Shared pieces are composed as
CTE text.  Queries that SQL cannot express (Spark ML fits) have no entry here.
"""
from __future__ import annotations

from petrel.functions.text import PUNCT_CLASS, SYMBOL_CLASS, WS
from petrel.operators.clean import CLASS_NAMES
from petrel.operators.ensemble import VOTE_WEIGHTS
from petrel.operators.tokens import EXTRA_STOP_WORDS
from petrel.plans import catalog as Q
from petrel.plans.fixtures import N_CLASSES, N_MODELS, SPECIALS, STOP_TOP


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS_L = lit(WS)
DIG_L = lit(r"\p{Nd}+")
TAG_L = lit(r"<[^>]+>")
SYM_L = lit(SYMBOL_CLASS)
PUNCT_L = lit(PUNCT_CLASS)
NW = Q.NUM_WORDS
CLS, SEP = Q.CLS_ID, Q.SEP_ID


def clean_sql(x: str) -> str:
    s = f"regexp_replace({x}, {DIG_L}, '', 'g')"
    s = f"lower({s})"
    s = f"regexp_replace({s}, {WS_L}, ' ', 'g')"
    s = f"regexp_replace({s}, {TAG_L}, '', 'g')"
    s = f"regexp_replace({s}, {WS_L}, ' ', 'g')"
    return f"trim({s}, ' ')"


def corpus_sql(x: str) -> str:
    return f"regexp_replace(replace({clean_sql(x)}, '\\n', ' '), {SYM_L}, ' ', 'g')"


def split_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {WS_L}), lambda t: t <> '')"


def ints(x: str) -> str:
    return f"array_to_string({x}, ',')"


def zeros(n: str, v: int = 0) -> str:
    return f"list_transform(range({n}), lambda i: {v})"


def pad_post(x: str, n: int, v: int = 0) -> str:
    return f"list_concat(list_slice({x}, 1, {n}), {zeros(f'greatest({n} - len({x}), 0)', v)})"


def pad_pre(x: str, n: int, v: int = 0) -> str:
    return (f"list_concat({zeros(f'greatest({n} - len({x}), 0)', v)}, "
            f"list_slice({x}, greatest(len({x}) - {n}, 0) + 1, len({x})))")


EXTRA = ", ".join(lit(w) for w in EXTRA_STOP_WORDS)

STOP = f"""
bench_tok AS (SELECT item_id, list_filter({split_sql(corpus_sql('text'))}, lambda t: length(t) > 1) AS toks
              FROM benchmark),
bench_cnt AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(toks) AS word FROM bench_tok) GROUP BY word),
stop_top AS (SELECT word AS form, 'NNG' AS pos,
                    round(cnt / (SELECT sum(cnt) FROM bench_cnt)::DOUBLE, 6) AS ratio
             FROM bench_cnt ORDER BY cnt DESC, word LIMIT {STOP_TOP}),
stop AS (SELECT DISTINCT form FROM (SELECT form FROM stop_top UNION ALL SELECT unnest([{EXTRA}]) AS form)),
stoplist AS (SELECT list(form) AS sl FROM stop)"""

DOCS = STOP + f""",
doc_tok AS (SELECT d.doc_id, d.lang,
                   list_filter({split_sql(corpus_sql('d.text'))},
                               lambda t: NOT list_contains(s.sl, t) AND length(t) > 1) AS toks
            FROM documents d, stoplist s),
cats AS (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS category FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
train_tok AS (SELECT * FROM doc_tok WHERE doc_id IN (SELECT doc_id FROM labels)),
train_pos AS (SELECT doc_id, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM train_tok),
wc AS (SELECT word, count(*) AS cnt, min(doc_id * 100000000 + pos) AS first_key FROM train_pos GROUP BY word),
vocab AS (SELECT word, cnt, first_key // 100000000 AS first_doc, first_key % 100000000 AS first_pos,
                 row_number() OVER (ORDER BY cnt DESC, first_key) + 1 AS idx FROM wc),
all_pos AS (SELECT doc_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM doc_tok)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def enc_cte(name: str, oov: bool = True, src: str = "all_pos", keys: str = "doc_id",
            base: str = "doc_tok", vocab: str = "vocab", cap: int = NW) -> str:
    """Encoded sequences per key, empty lists for documents without ids."""
    if oov:
        agg = f"list(coalesce(v.idx, 1) ORDER BY a.pos)"
        idx = "v.idx"
    else:
        agg = f"list(v.idx ORDER BY a.pos) FILTER (WHERE v.idx IS NOT NULL)"
        idx = "v.idx"
    key_a = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{name} AS (
  SELECT {', '.join('b.' + k.strip() for k in keys.split(','))}, coalesce(e.ids, []::BIGINT[]) AS ids
  FROM {base} b LEFT JOIN (
    SELECT {key_a}, {agg} AS ids
    FROM {src} a LEFT JOIN {vocab} v ON v.word = a.word AND {idx} < {cap}
    GROUP BY {key_a}) e USING ({keys}))"""


VOCAB_NO_OOV = """vocab0 AS (SELECT word, cnt, idx - 1 AS idx FROM vocab)"""

SEQ = DOCS + ",\n" + enc_cte("seq")
SEQ0 = DOCS + ",\n" + VOCAB_NO_OOV + ",\n" + enc_cte("seq0", oov=False, vocab="vocab0")

PIECES = DOCS + ",\n" + "pv AS (" + " UNION ALL ".join(
    f"SELECT {lit(t)} AS token, {i}::BIGINT AS id" for i, t in enumerate(SPECIALS)) + \
    f" UNION ALL SELECT word AS token, idx - 2 + {len(SPECIALS)} AS id FROM vocab WHERE idx < {NW})"

CONV = DOCS + f""",
conv_tok AS (SELECT c.conv_id, c.turn,
                    list_filter({split_sql(corpus_sql('c.text'))},
                                lambda t: NOT list_contains(s.sl, t) AND length(t) > 1) AS toks
             FROM conversations c, stoplist s),
conv_pos AS (SELECT conv_id, turn, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM conv_tok),
""" + enc_cte("conv_enc", src="conv_pos", keys="conv_id, turn", base="conv_tok") + """,
pairs AS (SELECT x.conv_id, x.turn, x.ids AS a, y.ids AS b
          FROM conv_enc x JOIN conv_enc y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)"""

PSEUDO = f"""
p1 AS (SELECT vec_id, model, label,
              list_transform(list_slice(embedding, model * {N_CLASSES} + 1, model * {N_CLASSES} + {N_CLASSES}),
                             lambda x: x::DOUBLE) AS s
       FROM embeddings, (SELECT range AS model FROM range({N_MODELS}))),
p2 AS (SELECT *, list_max(s) AS mx FROM p1),
p3 AS (SELECT *, list_transform(s, lambda x: exp(x - mx)) AS ex FROM p2),
p4 AS (SELECT *, list_reduce(ex, lambda a, b: a + b) AS tot FROM p3),
pp AS (SELECT vec_id AS doc_id, model, label % {N_CLASSES} AS target,
              list_transform(ex, lambda x: round(x / tot, 6)) AS probs FROM p4)"""

ARGMAX = "(list_position(probs, list_max(probs)) - 1)"


def nb_ctes(p: str, train: str, test: str, vocab: str, cap: int | str, alpha: float = 1.0) -> str:
    """Naive Bayes by counts; ``train`` has (doc_id, category, toks), ``test``
    (doc_id, toks); output CTE ``{p}pred`` (doc_id, pred)."""
    a = repr(float(alpha))
    return f"""
{p}feat AS (SELECT word FROM {vocab} WHERE idx < {cap}),
{p}trp AS (SELECT category AS label, unnest(toks) AS word FROM {train}),
{p}wc AS (SELECT label, word, count(*) AS cnt FROM {p}trp JOIN {p}feat USING (word) GROUP BY label, word),
{p}cls AS (SELECT c.label, c.n_c, coalesce(t.tot, 0) AS tot
           FROM (SELECT category AS label, count(*) AS n_c FROM {train} GROUP BY category) c
           LEFT JOIN (SELECT label, sum(cnt) AS tot FROM {p}wc GROUP BY label) t USING (label)),
{p}par AS (SELECT label,
                  ln((n_c + {a}) / ((SELECT sum(n_c) FROM {p}cls) + (SELECT count(*) FROM {p}cls) * {a})) AS prior,
                  ln(tot + {a} * (SELECT count(*) FROM {p}feat)) - ln({a}) AS dn
           FROM {p}cls),
{p}tep AS (SELECT doc_id, unnest(toks) AS word FROM {test}),
{p}nd AS (SELECT doc_id, count(*) AS n FROM {p}tep JOIN {p}feat USING (word) GROUP BY doc_id),
{p}sp AS (SELECT e.doc_id, w.label, sum(ln(w.cnt + {a}) - ln({a})) AS s
          FROM {p}tep e JOIN {p}wc w USING (word) GROUP BY e.doc_id, w.label),
{p}score AS (SELECT t.doc_id, c.label,
                    c.prior - coalesce(n.n, 0) * c.dn + coalesce(sp.s, 0) AS score
             FROM {test} t CROSS JOIN {p}par c
             LEFT JOIN {p}nd n ON n.doc_id = t.doc_id
             LEFT JOIN {p}sp sp ON sp.doc_id = t.doc_id AND sp.label = c.label),
{p}pred AS (SELECT doc_id, label AS pred FROM (
              SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r
              FROM {p}score) WHERE r = 1)"""


LABELLED_CAT = """
lab_tok AS (SELECT t.doc_id, c.category, t.toks FROM doc_tok t JOIN cats c USING (lang)
            WHERE t.doc_id IN (SELECT doc_id FROM labels)),
unl_tok AS (SELECT t.doc_id, t.toks FROM doc_tok t WHERE t.doc_id NOT IN (SELECT doc_id FROM labels))"""

SPLIT = """
lab_split AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1
                                  < floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'valid' END AS split
              FROM lab_tok),
tr_tok AS (SELECT * FROM lab_split WHERE split = 'train'),
va_tok AS (SELECT * FROM lab_split WHERE split = 'valid'),
tr_pos AS (SELECT doc_id, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM tr_tok),
tr_wc AS (SELECT word, count(*) AS cnt, min(doc_id * 100000000 + pos) AS first_key FROM tr_pos GROUP BY word),
tr_vocab AS (SELECT word, row_number() OVER (ORDER BY cnt DESC, first_key) + 1 AS idx FROM tr_wc)"""


def _select_best() -> str:
    parts, ctes = [], []
    for i, cap in enumerate(Q.NB_CANDIDATES):
        p = f"c{i}_"
        ctes.append(nb_ctes(p, "tr_tok", "va_tok", "tr_vocab", cap))
        parts.append(f"""SELECT 'nb_{cap}' AS candidate, {i} AS ord,
            round(avg(CASE WHEN p.pred = v.category THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy
            FROM {p}pred p JOIN va_tok v USING (doc_id)""")
    body = ("SELECT candidate, accuracy FROM (" + " UNION ALL ".join(parts) +
            ") ORDER BY accuracy DESC, ord LIMIT 1")
    return with_(DOCS + "," + LABELLED_CAT + "," + SPLIT + "," + ",".join(ctes), body)


WEIGHTS = " UNION ALL ".join(f"SELECT {m} AS model, {w!r}::DOUBLE AS w" for m, w in VOTE_WEIGHTS.items())

CASE_NAMES = "CASE c.category " + " ".join(
    f"WHEN {k} THEN {lit(v)}" for k, v in CLASS_NAMES.items()) + " END"

BARS = """
ticks AS (SELECT CASE WHEN length(CAST(user_id AS VARCHAR)) < 6 THEN lpad(CAST(user_id AS VARCHAR), 6, '0') ELSE CAST(user_id AS VARCHAR) END AS code, ts, value AS price, event_id FROM events),
bars AS (SELECT code, CAST(ts AS DATE) AS dt,
                first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
                first(price ORDER BY ts DESC, event_id DESC) AS close, count(*) AS volume
         FROM ticks GROUP BY code, CAST(ts AS DATE)),
codes AS (SELECT CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 6 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END AS code, c_name AS name FROM customer
          WHERE c_mktsegment = """ + lit(Q.MARKET) + """),
page AS (SELECT * FROM (
           SELECT b.*, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn
           FROM bars b WHERE dt <= DATE '""" + Q.BASE_DATE + """' AND code IN (SELECT code FROM codes))
         WHERE rn <= """ + str(Q.PAGE_SIZE) + ")"

BAR_COLS = "code, CAST(dt AS VARCHAR) AS dt, open, high, low, close, volume"


def _cleaned(expr: str, table: str = "documents", key: str = "doc_id", col: str = "text") -> str:
    return f"SELECT {key}, {expr.replace("{x}", col)} AS clean FROM {table}"


def _tok_out(src: str, col: str = "toks") -> str:
    return f"SELECT doc_id, len({col})::BIGINT AS n_tokens, array_to_string({col}, ' ') AS tokens FROM {src}"


def _ids_out(src: str, col: str = "ids") -> str:
    return f"SELECT doc_id, len({col})::BIGINT AS n_ids, {ints(col)} AS ids FROM {src}"


ORACLE_SQL: dict[str, str] = {
    # sources
    "src_csv_roundtrip": "SELECT doc_id, text, lang FROM documents",
    "src_stopwords_tsv": with_(STOP, "SELECT form, pos, ratio FROM stop_top"),
    "src_vocab_lines": with_(DOCS, "SELECT word AS token, idx - 2 AS id FROM vocab"),
    # cleaning
    "clean_text": _cleaned(clean_sql("{x}")),
    "clean_html": _cleaned(clean_sql("{x}"), "pages", "page_id", "html"),
    "clean_strip_punct": _cleaned(f"regexp_replace({{x}}, {PUNCT_L}, '', 'g')"),
    "clean_literal_newline": _cleaned("replace({x}, '\\n', ' ')"),
    "clean_symbols": _cleaned(f"regexp_replace({{x}}, {SYM_L}, ' ', 'g')"),
    "clean_squeeze": _cleaned(f"trim(regexp_replace({{x}}, {WS_L}, ' ', 'g'), ' ')"),
    "clean_quotes": _cleaned("replace(replace({x}, '``', '\"'), '''''', '\"')"),
    "clean_accents": _cleaned("strip_accents({x})"),
    "clean_lower": _cleaned("lower({x})"),
    "clean_keep_chars": _cleaned(f"regexp_replace({{x}}, {lit(Q.KEEP_CLASS)}, '', 'g')"),
    "clean_cast_labels": """SELECT d.doc_id, l.quality::BIGINT AS category, d.text AS data
                            FROM documents d JOIN labels l USING (doc_id)""",
    "clean_drop_nulls": """SELECT d.doc_id, l.quality::BIGINT AS quality, l.toxic::BIGINT AS toxic
                           FROM documents d LEFT JOIN labels l USING (doc_id)
                           WHERE d.doc_id IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL""",
    "filter_exclude_ids": """SELECT doc_id FROM documents
                             WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "filter_empty": with_(SEQ0, "SELECT doc_id, len(ids)::BIGINT AS n_ids FROM seq0 WHERE len(ids) >= 1"),
    "dense_index": """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents
                      WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "head_n": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5",
    "tail_n": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id DESC LIMIT 5",
    "shape": "SELECT count(*) AS n_rows, 5::BIGINT AS n_cols FROM documents",
    "label_codes": with_("""cats AS (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS category
                                     FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))""",
                         f"""SELECT d.doc_id, c.category::BIGINT AS category, {CASE_NAMES} AS name
                             FROM documents d JOIN cats c USING (lang)"""),
    "attach_predictions": """SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS category
                             FROM documents d LEFT JOIN labels l USING (doc_id)""",
    # tokens
    "tok_words": with_(f"t AS (SELECT doc_id, {split_sql(corpus_sql('text'))} AS toks FROM documents)",
                       _tok_out("t")),
    "tok_stop": with_(STOP + f""",
        t AS (SELECT d.doc_id, list_filter({split_sql(corpus_sql('d.text'))},
                                           lambda t: NOT list_contains(s.sl, t)) AS toks
              FROM documents d, stoplist s)""", _tok_out("t")),
    "tok_minlen": with_(DOCS, _tok_out("doc_tok")),
    "stop_union": with_(STOP, "SELECT form FROM stop"),
    "tok_detok": with_(DOCS, """SELECT doc_id,
        trim(replace(array_to_string(list_transform(toks, lambda w: '▁' || w), ''), '▁', ' '), ' ') AS text
        FROM doc_tok"""),
    # vocabulary
    "vocab_counts": with_(DOCS, "SELECT word, cnt, first_doc, first_pos FROM vocab"),
    "vocab_index": with_(DOCS, "SELECT word, cnt, idx FROM vocab"),
    "vocab_docfreq": with_(DOCS, "SELECT word, count(DISTINCT doc_id) AS doc_count FROM train_pos GROUP BY word"),
    "vocab_rare_stats": with_(DOCS, f"""SELECT total_cnt, rare_cnt, total_freq, rare_freq,
            round(rare_cnt * 100.0::DOUBLE / total_cnt, 6) AS rare_cnt_pct,
            round(rare_freq * 100.0::DOUBLE / total_freq, 6) AS rare_freq_pct,
            total_cnt - rare_cnt + 1 AS vocab_size
        FROM (SELECT count(*) AS total_cnt,
                     sum(CASE WHEN cnt < {Q.RARE_THRESHOLD} THEN 1 ELSE 0 END)::BIGINT AS rare_cnt,
                     sum(cnt)::BIGINT AS total_freq,
                     sum(CASE WHEN cnt < {Q.RARE_THRESHOLD} THEN cnt ELSE 0 END)::BIGINT AS rare_freq FROM wc)"""),
    "vocab_topk": with_(DOCS, f"SELECT word, idx FROM vocab WHERE idx < {NW}"),
    "vocab_topk_bounded": with_(DOCS, f"SELECT word, idx FROM vocab WHERE idx < {NW}"),
    "vocab_size": with_(PIECES, "SELECT count(*) AS vocab_size FROM pv"),
    "vocab_id_gaps": with_(DOCS + """,
        df AS (SELECT word, count(DISTINCT doc_id) AS doc_count FROM train_pos GROUP BY word),
        kept AS (SELECT word AS token, idx AS id FROM vocab WHERE word IN (SELECT word FROM df WHERE doc_count >= 2))""",
        """SELECT token, id, row_number() OVER (ORDER BY id) - 1 AS line,
                  id <> coalesce(lag(id) OVER (ORDER BY id) + 1, 0) AS gap FROM kept"""),
    # encoding
    "enc_sequences": with_(SEQ, _ids_out("seq")),
    "enc_sequences_full": with_(DOCS + ",\n" + enc_cte("seqf", cap=1 << 40), _ids_out("seqf")),
    "enc_sequences_no_oov": with_(SEQ0, _ids_out("seq0")),
    "enc_pieces": with_(PIECES, f"""SELECT doc_id, len(ids)::BIGINT AS n_ids, {ints('ids')} AS ids FROM (
        SELECT b.doc_id, coalesce(e.ids, []::BIGINT[]) AS ids FROM doc_tok b LEFT JOIN (
          SELECT a.doc_id, list(coalesce(p.id, 0) ORDER BY a.pos) AS ids
          FROM all_pos a LEFT JOIN pv p ON p.token = a.word GROUP BY a.doc_id) e USING (doc_id))"""),
    "enc_inverse": with_(PIECES, """SELECT doc_id, len(toks)::BIGINT AS n_tokens, array_to_string(toks, ' ') AS tokens FROM (
        SELECT b.doc_id, coalesce(e.toks, []::VARCHAR[]) AS toks FROM doc_tok b LEFT JOIN (
          SELECT a.doc_id, list(coalesce(p.token, '[UNK]') ORDER BY a.pos) AS toks
          FROM all_pos a LEFT JOIN pv p ON p.token = a.word GROUP BY a.doc_id) e USING (doc_id))"""),
    "enc_pad_pre": with_(SEQ, f"SELECT doc_id, {ints(pad_pre('ids', Q.PAD_PRE_LEN))} AS ids FROM seq"),
    "enc_pad_post": with_(SEQ, f"SELECT doc_id, {ints(pad_post('ids', Q.MODEL_LEN))} AS ids FROM seq"),
    "enc_special_single": with_(SEQ, f"SELECT doc_id, {ints(f'list_concat([{CLS}], ids, [{SEP}])')} AS ids FROM seq"),
    "enc_special_pair": with_(CONV, f"""SELECT conv_id, turn,
        {ints(f'list_concat([{CLS}], a, [{SEP}], b, [{SEP}])')} AS ids FROM pairs"""),
    "enc_mask_special": with_(CONV, f"""SELECT conv_id, turn,
        {ints("list_concat([1], list_transform(a, lambda x: 0), [1], list_transform(b, lambda x: 0), [1])")} AS mask
        FROM pairs"""),
    "enc_mask_special_done": with_(SEQ, f"""SELECT doc_id,
        {ints(f"list_transform(list_concat([{CLS}], ids, [{SEP}]), lambda x: CASE WHEN x IN ({CLS}, {SEP}) THEN 1 ELSE 0 END)")} AS mask
        FROM seq"""),
    "enc_token_types": with_(CONV, f"""SELECT conv_id, turn,
        {ints(f"list_concat({zeros('len(a) + 2')}, {zeros('len(b) + 1', 1)})")} AS types FROM pairs"""),
    "enc_attention": with_(SEQ, f"""SELECT doc_id,
        {ints(f"list_transform({pad_post('ids', Q.MODEL_LEN)}, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)")} AS mask
        FROM seq"""),
    "enc_model_input": with_(SEQ + f""",
        mi AS (SELECT s.doc_id, c.category,
                      {pad_post(f"list_concat([{CLS}], list_slice(s.ids, 1, {Q.MODEL_LEN - 2}), [{SEP}])", Q.MODEL_LEN)} AS ids
               FROM seq s JOIN doc_tok t USING (doc_id) JOIN cats c USING (lang))""",
        f"""SELECT doc_id, {ints('ids')} AS ids,
                   {ints("list_transform(ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)")} AS mask,
                   {ints(zeros(str(Q.MODEL_LEN)))} AS segment, category::BIGINT AS target FROM mi"""),
    "enc_model_input_padded": with_(SEQ + f""",
        mi AS (SELECT s.doc_id, c.category, {pad_pre('s.ids', Q.PAD_PRE_LEN)} AS ids
               FROM seq s JOIN doc_tok t USING (doc_id) JOIN cats c USING (lang))""",
        f"""SELECT doc_id, {ints('ids')} AS ids,
                   {ints("list_transform(ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)")} AS mask,
                   {ints(zeros(str(Q.PAD_PRE_LEN)))} AS segment, category::BIGINT AS target FROM mi"""),
    # labels
    "lbl_one_hot": with_("""cats AS (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS category
                                     FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
                            k AS (SELECT max(category) + 1 AS k FROM cats)""",
                         f"""SELECT d.doc_id,
            {ints("list_transform(range(k.k), lambda i: CASE WHEN i = c.category THEN 1 ELSE 0 END)")} AS one_hot
            FROM documents d JOIN cats c USING (lang), k"""),
    "lbl_argmax": with_(PSEUDO, f"SELECT doc_id, model::BIGINT AS model, {ARGMAX}::BIGINT AS category FROM pp"),
    # statistics
    "stat_length": with_(DOCS, """SELECT max(len(toks))::BIGINT AS max_len, round(avg(len(toks)), 6) AS mean_len,
                                         count(*) AS n_rows FROM doc_tok"""),
    "stat_histogram": with_(DOCS + f""",
        lens AS (SELECT len(toks)::BIGINT AS x FROM doc_tok),
        mm AS (SELECT min(x) AS mn, max(x) AS mx FROM lens),
        binned AS (SELECT CASE WHEN mx = mn THEN {Q.HIST_BINS // 2}
                          ELSE least(floor((x - mn) * {Q.HIST_BINS} / (mx - mn)::DOUBLE)::BIGINT, {Q.HIST_BINS - 1}) END AS bin
                   FROM lens, mm),
        cnt AS (SELECT bin, count(*) AS c FROM binned GROUP BY bin),
        geo AS (SELECT CASE WHEN mx = mn THEN mn - 0.5::DOUBLE ELSE mn::DOUBLE END AS lo,
                       CASE WHEN mx = mn THEN 1.0::DOUBLE ELSE (mx - mn)::DOUBLE END / {float(Q.HIST_BINS)!r}::DOUBLE AS w
                FROM mm)""",
        f"""SELECT r.range AS bin, round(g.lo + r.range * g.w, 6) AS lo, round(g.lo + (r.range + 1) * g.w, 6) AS hi,
                   coalesce(c.c, 0) AS count
            FROM range({Q.HIST_BINS}) r CROSS JOIN geo g LEFT JOIN cnt c ON c.bin = r.range"""),
    "stat_coverage": with_(DOCS, f"""SELECT round(avg(CASE WHEN len(toks) <= {Q.PAD_PRE_LEN} THEN 1.0::DOUBLE
                                                   ELSE 0.0::DOUBLE END) * 100.0::DOUBLE, 6) AS coverage_pct FROM doc_tok"""),
    "split_tail": """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1
                                       < floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'valid' END AS split
                     FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    # models
    "model_nb_counts": with_(DOCS + "," + LABELLED_CAT + """,
        lab_pos AS (SELECT doc_id, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM lab_tok),
        lab_wc AS (SELECT word, count(*) AS cnt, min(doc_id * 100000000 + pos) AS first_key FROM lab_pos GROUP BY word),
        lab_vocab AS (SELECT word, row_number() OVER (ORDER BY cnt DESC, first_key) + 1 AS idx FROM lab_wc),"""
        + nb_ctes("m_", "lab_tok", "unl_tok", "lab_vocab", NW),
        "SELECT doc_id, pred::BIGINT AS category FROM m_pred"),
    "model_select_best": _select_best(),
    "metric_accuracy": with_(PSEUDO, f"""SELECT model::BIGINT AS model,
            round(avg(CASE WHEN {ARGMAX} = target THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
            count(*) AS n FROM pp GROUP BY model"""),
    "metric_cross_entropy": with_(PSEUDO, """SELECT model::BIGINT AS model,
            round(avg(-ln(least(greatest(probs[target + 1], 1e-7::DOUBLE), 1.0::DOUBLE - 1e-7::DOUBLE))), 6) AS cross_entropy,
            count(*) AS n FROM pp GROUP BY model"""),
    # ensemble
    "ens_weighted": with_(PSEUDO + f""",
        wt AS ({WEIGHTS}),
        cp AS (SELECT doc_id, model, unnest(probs) AS p, generate_subscripts(probs, 1) - 1 AS cls FROM pp),
        sc AS (SELECT cp.doc_id, cp.cls, sum(cp.p * wt.w ORDER BY cp.model) AS s
               FROM cp JOIN wt USING (model) GROUP BY cp.doc_id, cp.cls)""",
        """SELECT doc_id, cls::BIGINT AS category, round(s, 9) AS score FROM (
             SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, cls) AS r FROM sc) WHERE r = 1"""),
    "ens_mean_label": with_(PSEUDO, f"""SELECT doc_id, round_even(avg({ARGMAX}), 0)::BIGINT AS category
                                        FROM pp GROUP BY doc_id"""),
    # securities and bars
    "bars_daily": with_(BARS, f"SELECT {BAR_COLS} FROM bars"),
    "sec_by_market": with_(BARS, "SELECT code, name FROM codes"),
    "sec_point_lookup": f"""SELECT CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 6 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END AS code, c_name, c_nationkey::BIGINT AS c_nationkey,
                                   c_acctbal, c_mktsegment FROM customer
                            WHERE CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 6 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END = {lit(Q.POINT_CODE)}""",
    "bars_latest_per_code": with_(BARS, f"SELECT {BAR_COLS} FROM page"),
    "bars_price_flag": with_(BARS, """SELECT code, CAST(dt AS VARCHAR) AS dt, a AS adjusted,
        CASE WHEN a THEN close / 2.0::DOUBLE ELSE close END AS price FROM page, (SELECT unnest([true, false]) AS a)"""),
    "clean_piece_text": _cleaned(f"lower(strip_accents(replace(replace(trim(regexp_replace({{x}}, {WS_L}, ' ', 'g'), ' '), '``', '\"'), '\'\'\'\'', '\"')))"),
    "clean_literal_newline_removed": _cleaned("replace({x}, '\\n', '')"),
    "src_whole_text": "SELECT item_id, text FROM benchmark",
    "sink_arrays": with_(SEQ, _ids_out("seq")),
    "sink_vocab_json": with_(DOCS, "SELECT word, cnt, idx FROM vocab"),
    "cert_lr": """SELECT category, true AS stationary FROM (SELECT dense_rank() OVER (ORDER BY lang) - 1 AS category
                  FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))""",
    "cert_rf": "SELECT doc_id, true AS same FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "cert_mlp": "SELECT vec_id AS doc_id, true AS same FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL",
    "bars_merged": with_(BARS, f"SELECT {BAR_COLS} FROM bars"),
    "sink_model": "SELECT doc_id, true AS same FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "flow_submission": with_(DOCS + "," + LABELLED_CAT + f""",
        fl_tok AS (SELECT * FROM lab_tok WHERE len(toks) >= 1
                   AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
        fl_pos AS (SELECT doc_id, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM fl_tok),
        fl_wc AS (SELECT word, count(*) AS cnt, min(doc_id * 100000000 + pos) AS first_key FROM fl_pos GROUP BY word),
        fl_cap AS (SELECT count(*) - count(*) FILTER (WHERE cnt < {Q.RARE_THRESHOLD}) + 1 AS cap FROM fl_wc),
        fl_vocab AS (SELECT word, row_number() OVER (ORDER BY cnt DESC, first_key) + 1 AS idx FROM fl_wc),"""
        + nb_ctes("f_", "fl_tok", "unl_tok", "fl_vocab", "(SELECT cap FROM fl_cap)"),
        "SELECT doc_id, pred::BIGINT AS category FROM f_pred"),
    "enc_model_input_pair": with_(CONV + f""",
        cut AS (SELECT conv_id, turn, list_slice(a, 1, {Q.PAIR_LEN - 3}) AS a, b FROM pairs),
        cut2 AS (SELECT conv_id, turn, a, list_slice(b, 1, {Q.PAIR_LEN - 3} - len(a)) AS b FROM cut),
        mp AS (SELECT conv_id, turn, {pad_post(f"list_concat([{CLS}], a, [{SEP}], b, [{SEP}])", Q.PAIR_LEN)} AS ids,
                      {pad_post(f"list_concat({zeros('len(a) + 2')}, {zeros('len(b) + 1', 1)})", Q.PAIR_LEN)} AS seg FROM cut2)""",
        f"""SELECT conv_id, turn, {ints('ids')} AS ids,
                   {ints("list_transform(ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)")} AS mask,
                   {ints('seg')} AS segment FROM mp"""),
    "bars_head_per_code": with_(BARS, """SELECT code, CAST(dt AS VARCHAR) AS dt, close, rn AS rank FROM page
                                         WHERE rn <= 10"""),
}
