"""The query catalog: every operator as (Spark callable, DuckDB oracle SQL).

Each callable takes (spark, sf_dir) and returns a DataFrame over the whole
test tables.  ``oracle_sql`` has an independent SQL formulation wherever
one exists; keys without SQL get a rows-only check plus unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import text as T
from wordloom.operators import cooc as CO
from wordloom.operators import tokens as TK
from wordloom.operators import vocab as VC
from wordloom.plans import sqlparts as S
from wordloom.plans.pipeline import build_vocabulary
from wordloom.sources import corpus as SC
from wordloom.sources.tables import table

CFG = Config()
STOPS = SC.default_stopwords()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _zero_safe_round(sql: str) -> str:
    """Wrap every round(...) as (round(...) + 0.0) so a rounded −0.0 becomes 0.0, as in Spark."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            c = sql[k]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _zero_safe_round(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0::DOUBLE)")
        i = k + 1


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _zero_safe_round(sql)
        return fn
    return deco


def docs(spark, d):
    return table(spark, d, "documents")


def sents(spark, d, keep_empty=False):
    return TK.sentences(docs(spark, d), CFG, STOPS, keep_empty=keep_empty)


def bigint(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def query_lines(spark, d):
    """Stand-in for the one-word-per-line test file: every whitespace word of ``benchmark``."""
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.posexplode(T.whitespace_tokens(F.col("text"))).alias("line_no", "line")) \
        .select("item_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


QUERY_LINES_SQL = r"""
qlines AS (
  SELECT item_id, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS line_no, unnest(ws) AS line
  FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM benchmark)),
qwords AS (
  SELECT item_id, line_no, line, """ + S.clean(S.lower("line")) + r""" AS word FROM qlines WHERE line <> '')"""


def query_words(spark, d):
    return SC.read_query_words(query_lines(spark, d), "line", CFG.strip_all).drop("line")


# ---------------------------------------------------------------- sources

@query("read_corpus", r"""
SELECT doc_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS line_no, unnest(arr) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents)""")
def q_read_corpus(spark, d):
    return SC.read_corpus(docs(spark, d)).select("doc_id", *bigint("line_no"), "line")


@query("read_stopwords", r"""
SELECT DISTINCT line AS word
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE line <> ''""")
def q_read_stopwords(spark, d):
    """Stop-file semantics (one word per line, deduplicated) over the lines of ``benchmark``."""
    lines = SC.read_corpus(table(spark, d, "benchmark"), id_col="item_id")
    return SC.read_stopwords(lines, "line")


@query("prepare_stopwords", r"""
SELECT regexp_replace(w, '[^a-z]', '', 'g') AS word
FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w
      FROM benchmark)""")
def q_prepare_stopwords(spark, d):
    w = query_lines(spark, d).select(F.col("line").alias("word")).distinct()
    return SC.prepare_stopwords(w)


@query("read_query_words", "WITH " + QUERY_LINES_SQL + "\nSELECT item_id, line_no, word FROM qwords")
def q_read_query_words(spark, d):
    return query_words(spark, d)


# ---------------------------------------------------------------- tokens

_TOK_SQL = r"""
toks AS (
  SELECT doc_id, sid, unnest(toks) AS token, generate_subscripts(toks, 1) AS k FROM raw),
tokpos AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sid, k) - 1 AS BIGINT) AS pos,
         sid, token FROM toks)"""


@query("tokenize", S.with_corpus("SELECT doc_id, pos, token FROM tokpos", _TOK_SQL))
def q_tokenize(spark, d):
    return TK.raw_tokens(docs(spark, d)).select("doc_id", *bigint("pos"), "token")


@query("word_lower", S.with_corpus(f"SELECT doc_id, pos, {S.lower('token')} AS word FROM tokpos", _TOK_SQL))
def q_word_lower(spark, d):
    t = TK.raw_tokens(docs(spark, d))
    return t.select("doc_id", *bigint("pos"), T.word_lower(F.col("token")).alias("word"))


_CLEAN_SQL = _TOK_SQL + rf""",
cl AS (
  SELECT doc_id, pos, sid, {S.clean(S.lower('token'))} AS word,
         right(token, 1) IN ('.', '?', '!', chr(10), chr(13)) AS sent_end FROM tokpos)"""


@query("word_clean", S.with_corpus("SELECT doc_id, pos, sid, word, sent_end FROM cl", _CLEAN_SQL))
def q_word_clean(spark, d):
    c = TK.cleaned_tokens(docs(spark, d), CFG)
    return c.select("doc_id", *bigint("pos", "sid"), "word", "sent_end")


@query("word_shape_filter", S.with_corpus(
    "SELECT doc_id, pos, word FROM cl WHERE regexp_full_match(word, '[a-z-]{3,}')", _CLEAN_SQL))
def q_word_shape_filter(spark, d):
    c = TK.cleaned_tokens(docs(spark, d), CFG)
    return c.where("shape_ok").select("doc_id", *bigint("pos"), "word")


@query("stopword_filter", S.with_corpus(
    "SELECT doc_id, pos, word, list_contains(" + S.stops_sql() + ", word) AS is_stop FROM cl "
    "WHERE regexp_full_match(word, '[a-z-]{3,}')", _CLEAN_SQL))
def q_stopword_filter(spark, d):
    c = TK.cleaned_tokens(docs(spark, d), CFG).where("shape_ok")
    return c.select("doc_id", *bigint("pos"), "word", (~T.not_stop(F.col("word"), STOPS)).alias("is_stop"))


@query("segment_sentences", S.with_corpus(
    "SELECT doc_id, sid, n_raw, CAST(len(words) AS BIGINT) AS n_kept FROM sents WHERE n_raw > 0"))
def q_segment_sentences(spark, d):
    s = TK.sentence_counts(sents(spark, d, keep_empty=True)).where(F.col("n_raw") > 0)
    return s.select("doc_id", *bigint("sid", "n_raw", "n_kept"))


@query("kept_tokens", S.with_corpus("SELECT doc_id, sid, pos, word FROM kept"))
def q_kept_tokens(spark, d):
    return TK.kept_tokens(sents(spark, d)).select("doc_id", *bigint("sid", "pos"), "word")


# ---------------------------------------------------------------- vocabulary

@query("word_freq", S.with_corpus("SELECT word, freq FROM wf"))
def q_word_freq(spark, d):
    return VC.word_freq(sents(spark, d))


@query("filter_low", S.with_corpus("SELECT word, freq FROM wf WHERE freq < 5"))
def q_filter_low(spark, d):
    return VC.filter_low(VC.word_freq(sents(spark, d)), CFG)


@query("filter_high", S.with_corpus("SELECT word, freq FROM high"))
def q_filter_high(spark, d):
    return VC.filter_high(VC.word_freq(sents(spark, d)), CFG)


@query("vocab_filter", S.with_corpus("SELECT word, freq, reason FROM removed"))
def q_vocab_filter(spark, d):
    return build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).removed


@query("vocab_index", S.with_corpus("SELECT idx, word, freq FROM vocab"))
def q_vocab_index(spark, d):
    return build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).vocab


@query("build_vocabulary", S.with_corpus("SELECT idx, word, freq FROM vocab"))
def q_build_vocabulary(spark, d):
    return build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).vocab


@query("vocab_freq_sum_max", S.with_corpus(
    "SELECT CAST(coalesce(sum(freq), 0) AS BIGINT) AS freq_sum, CAST(coalesce(max(freq), 0) AS BIGINT) AS freq_max FROM vocab"))
def q_vocab_freq_sum_max(spark, d):
    return VC.vocab_freq_sum_max(build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).vocab)


@query("corpus_stats", S.with_corpus(
    "SELECT (SELECT CAST(sum(freq) AS BIGINT) FROM und) AS pair_count, (SELECT count(*) FROM wf) AS vocab_size, "
    "round((SELECT sum(freq) FROM und) / (SELECT count(*) FROM wf), 6) AS pairs_per_word"))
def q_corpus_stats(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS)
    return VC.corpus_stats(spark, vb.pair_count, vb.v_raw).withColumn("pairs_per_word", F.round("pairs_per_word", 6))


@query("freq_distribution", S.with_corpus(r"""
SELECT CAST(p.sample AS BIGINT) AS sample, CAST(p.r + 1 AS BIGINT) AS position, x.freq
FROM (SELECT s AS sample, CASE WHEN s = 10 THEN n - 1 ELSE (s - 1) * (n // 10) END AS r
      FROM range(1, 11) t(s), (SELECT count(*) AS n FROM vocab)) p
JOIN (SELECT freq, row_number() OVER (ORDER BY freq DESC, word) - 1 AS r FROM vocab) x ON x.r = p.r"""))
def q_freq_distribution(spark, d):
    v = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).vocab
    return VC.freq_distribution(v, CFG).select(*bigint("sample", "position", "freq"))


@query("rank_frequency", S.with_corpus(r"""
SELECT CAST(rank AS BIGINT) AS rank, word, freq,
       CAST(sum(freq) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_freq
FROM (SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) AS rank FROM vocab)"""))
def q_rank_frequency(spark, d):
    v = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).vocab
    return VC.rank_frequency(v)


@query("context_degree", S.with_corpus("SELECT center AS word, count(*) AS context_max FROM counts GROUP BY center"))
def q_context_degree(spark, d):
    return CO.context_degree(CO.cooccurrence_counts(sents(spark, d), CFG))


# ---------------------------------------------------------------- lookups

@query("word_to_index", S.with_corpus(
    "SELECT q.item_id, q.line_no, q.word, coalesce(v.idx, -1) AS idx FROM qwords q LEFT JOIN vocab v ON v.word = q.word",
    QUERY_LINES_SQL))
def q_word_to_index(spark, d):
    v = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).vocab
    return VC.word_to_index(query_words(spark, d), v)


@query("index_to_word", S.with_corpus(
    "SELECT t.idx, v.word FROM (SELECT DISTINCT context_idx AS idx FROM targets) t JOIN vocab v ON v.idx = t.idx"))
def q_index_to_word(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS)
    ids = vb.targets.select(F.col("context_idx").alias("idx")).distinct()
    return VC.index_to_word(ids, vb.vocab)


@query("in_filtered", S.with_corpus(
    "SELECT q.item_id, q.line_no, q.word, (r.word IS NOT NULL) AS filtered FROM qwords q "
    "LEFT JOIN removed r ON r.word = q.word", QUERY_LINES_SQL))
def q_in_filtered(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False)
    return VC.in_filtered(query_words(spark, d), vb.removed)


@query("oov_report", S.with_corpus(
    "SELECT word, count(*) AS hits FROM qwords WHERE word NOT IN (SELECT word FROM vocab) GROUP BY word",
    QUERY_LINES_SQL))
def q_oov_report(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False)
    return VC.oov_report(query_words(spark, d), vb.vocab)


# ---------------------------------------------------------------- co-occurrence

@query("cooccurrence_pairs", S.with_corpus("SELECT doc_id, sid, pos, dist, center, context FROM pairs"))
def q_cooccurrence_pairs(spark, d):
    p = CO.cooccurrence_pairs(sents(spark, d), CFG)
    return p.select("doc_id", *bigint("sid", "pos", "dist"), "center", "context")


@query("window_self_join", S.with_corpus("SELECT doc_id, sid, pos, dist, center, context FROM pairs"))
def q_window_self_join(spark, d):
    p = CO.window_self_join(TK.kept_tokens(sents(spark, d)), CFG)
    return p.select("doc_id", *bigint("sid", "pos", "dist"), "center", "context")


@query("cooccurrence_counts", S.with_corpus("SELECT center, context, freq FROM counts"))
def q_cooccurrence_counts(spark, d):
    return CO.cooccurrence_counts(sents(spark, d), CFG)


@query("vocab_targets", S.with_corpus("SELECT center_idx, center, context_idx, context, freq FROM targets"))
def q_vocab_targets(spark, d):
    return build_vocabulary(docs(spark, d), CFG, STOPS).targets


@query("training_examples", S.with_corpus("SELECT CAST(coalesce(sum(freq), 0) AS BIGINT) AS examples FROM targets"))
def q_training_examples(spark, d):
    return CO.training_examples(build_vocabulary(docs(spark, d), CFG, STOPS).targets)


# ================================================================ vectors & search

from wordloom.functions import vectors as V  # noqa: E402
from wordloom.operators import model as MD  # noqa: E402
from wordloom.operators import samples as SM  # noqa: E402
from wordloom.operators import sampling as SP  # noqa: E402
from wordloom.operators import search as SR  # noqa: E402

MODEL_SQL = S.model_ctes(CFG.hidden, CFG.seed)
QWORDS_SQL = QUERY_LINES_SQL + ",\n" + MODEL_SQL + ",\n" + S.qstatus_ctes()


def corpus_model(spark, d, with_targets=True, out_layer=True):
    """Vocabulary plus the hash-initialised layers, each written once (not recomputed
    by every consumer); ``out_layer=False`` when a query only reads the input layer."""
    from wordloom.session import materialize
    vb = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=with_targets)
    mi, mo = MD.init_weights(vb.vocab, CFG)
    return vb, materialize(mi, spark, "init-in"), (materialize(mo, spark, "init-out") if out_layer else None)


def query_status(spark, d, vb):
    """Q3: status of every query line: shape | stop | filtered | oov | ok, plus idx."""
    q = query_words(spark, d)
    shape = T.word_shape_ok(F.col("word"))
    stop = ~T.not_stop(F.col("word"), STOPS)
    q = VC.in_filtered(q, vb.removed)
    q = q.join(vb.vocab.select("word", "idx"), "word", "left")
    status = (F.when(~shape, "shape").when(stop, "stop").when(F.col("filtered"), "filtered")
              .when(F.col("idx").isNull(), "oov").otherwise("ok"))
    return q.select("item_id", "line_no", "word", status.alias("status"), "idx")


def valid_qids(spark, d, vb):
    return query_status(spark, d, vb).where(F.col("status") == "ok").select("idx").distinct()


def r6(c):
    return F.round(c, 6)


def embeddings(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), V.as_double(F.col("embedding")).alias("vec"), "label")


@query("init_weights", S.with_corpus(
    "SELECT 'in' AS layer, idx, word, list_transform(vec, lambda x: round(x, 6)) AS vec FROM model_in "
    "UNION ALL SELECT 'out', idx, word, list_transform(vec, lambda x: round(x, 6)) FROM model_out", MODEL_SQL))
def q_init_weights(spark, d):
    vb, mi, mo = corpus_model(spark, d, with_targets=False)
    f = lambda m, name: m.select(F.lit(name).alias("layer"), "idx", "word", V.round_vec(F.col("vec")).alias("vec"))
    return f(mi, "in").unionByName(f(mo, "out"))


@query("l2_normalize", S.with_corpus(
    "SELECT idx, list_transform(vec, lambda x: round(x / sqrt(list_dot_product(vec, vec)), 6)) AS vec FROM model_in",
    MODEL_SQL))
def q_l2_normalize(spark, d):
    vb, mi, mo = corpus_model(spark, d, with_targets=False, out_layer=False)
    return mi.select("idx", V.round_vec(V.l2_normalize(F.col("vec"))).alias("vec"))


_PAIR_VEC_SQL = """
SELECT t.center_idx, t.context_idx, {expr} AS {name}
FROM targets t JOIN model_in a ON a.idx = t.center_idx JOIN {other} b ON b.idx = t.context_idx"""


@query("dot_scores", S.with_corpus(_PAIR_VEC_SQL.format(
    expr="round(list_dot_product(a.vec, b.vec), 6)", name="score", other="model_out"), MODEL_SQL))
def q_dot_scores(spark, d):
    from wordloom.operators.scoring import pair_scores
    vb, mi, mo = corpus_model(spark, d)
    t = vb.targets.select("center_idx", "context_idx")
    return pair_scores(t, mi, mo, "center_idx", "context_idx", "dot").select(
        "center_idx", "context_idx", r6(F.col("score")).alias("score"))


@query("sigmoid", S.with_corpus(_PAIR_VEC_SQL.format(
    expr="round(1.0 / (1.0 + exp(-list_dot_product(a.vec, b.vec))), 6)", name="prob", other="model_out"), MODEL_SQL))
def q_sigmoid(spark, d):
    from wordloom.operators.scoring import pair_scores
    vb, mi, mo = corpus_model(spark, d)
    t = vb.targets.select("center_idx", "context_idx")
    return pair_scores(t, mi, mo, "center_idx", "context_idx", "sigmoid").select(
        "center_idx", "context_idx", r6(F.col("score")).alias("prob"))


@query("cosine_similarity", S.with_corpus(_PAIR_VEC_SQL.format(
    expr="round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 6)",
    name="cosine", other="model_in"), MODEL_SQL))
def q_cosine_similarity(spark, d):
    from wordloom.operators.scoring import pair_scores
    vb, mi, mo = corpus_model(spark, d, out_layer=False)
    t = vb.targets.select("center_idx", "context_idx")
    return pair_scores(t, mi, mi, "center_idx", "context_idx", "cosine").select(
        "center_idx", "context_idx", r6(F.col("score")).alias("cosine"))


@query("query_skip", S.with_corpus("SELECT item_id, line_no, word, status, idx FROM qstatus", QWORDS_SQL))
def q_query_skip(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False)
    return query_status(spark, d, vb)


@query("similar_words", S.with_corpus(r"""
SELECT qid, qw.word AS word, CAST(r - 1 AS BIGINT) AS rank, iid, iw.word AS similar, round(score, 6) AS score
FROM (SELECT q.idx AS qid, m.idx AS iid,
             list_dot_product(a.vec, m.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(m.vec, m.vec))) AS score,
             row_number() OVER (PARTITION BY q.idx ORDER BY
               list_dot_product(a.vec, m.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(m.vec, m.vec))) DESC, m.idx) AS r
      FROM qids q JOIN model_in a ON a.idx = q.idx, model_in m) s
JOIN vocab qw ON qw.idx = s.qid JOIN vocab iw ON iw.idx = s.iid
WHERE r BETWEEN 2 AND 6""", QWORDS_SQL))
def q_similar_words(spark, d):
    vb, mi, mo = corpus_model(spark, d, with_targets=False, out_layer=False)
    top = SR.similar_items(mi.select("idx", "vec"), valid_qids(spark, d, vb), CFG.predictions)
    w = vb.vocab.select("idx", "word")
    return top.join(w.select(F.col("idx").alias("qid"), "word"), "qid") \
        .join(w.select(F.col("idx").alias("iid"), F.col("word").alias("similar")), "iid") \
        .select("qid", "word", F.col("rank").cast("bigint").alias("rank"), "iid", "similar", r6(F.col("score")).alias("score"))


_LOGITS_SQL = r"""
logits AS (SELECT q.idx AS qid, m.idx AS iid, list_dot_product(a.vec, m.vec) AS score
           FROM qids q JOIN model_in a ON a.idx = q.idx, model_out m),
lse AS (SELECT qid, max(score) + ln(sum(exp(score - mx))) AS log_norm
        FROM (SELECT qid, score, max(score) OVER (PARTITION BY qid) AS mx FROM logits) GROUP BY qid)"""


@query("context_scores", S.with_corpus("SELECT qid, iid, round(score, 6) AS score FROM logits",
                                       QWORDS_SQL + "," + _LOGITS_SQL))
def q_context_scores(spark, d):
    vb, mi, mo = corpus_model(spark, d, with_targets=False)
    return SR.context_scores(mi, mo, valid_qids(spark, d, vb)).select("qid", "iid", r6(F.col("score")).alias("score"))


@query("softmax", S.with_corpus(
    "SELECT l.qid, l.iid, round(exp(l.score - z.log_norm), 10) AS prob FROM logits l JOIN lse z ON z.qid = l.qid",
    QWORDS_SQL + "," + _LOGITS_SQL))
def q_softmax(spark, d):
    vb, mi, mo = corpus_model(spark, d, with_targets=False)
    return SR.softmax(mi, mo, valid_qids(spark, d, vb)).select("qid", "iid", F.round("prob", 10).alias("prob"))


_PREDICT_SQL = _LOGITS_SQL + r""",
pred AS (
  SELECT l.qid, l.iid, CAST(row_number() OVER (PARTITION BY l.qid ORDER BY l.score DESC, l.iid) AS BIGINT) AS rank,
         exp(l.score - z.log_norm) AS prob
  FROM logits l JOIN lse z ON z.qid = l.qid WHERE l.iid <> l.qid),
predk AS (
  SELECT p.qid, p.iid, p.rank, p.prob, (t.center_idx IS NOT NULL) AS ok
  FROM pred p LEFT JOIN targets t ON t.center_idx = p.qid AND t.context_idx = p.iid WHERE p.rank <= 5)"""


@query("context_predict", S.with_corpus("SELECT qid, iid, rank, round(prob, 9) AS prob, ok FROM predk",
                                        QWORDS_SQL + "," + _PREDICT_SQL))
def q_context_predict(spark, d):
    vb, mi, mo = corpus_model(spark, d)
    p = SR.context_predict(mi, mo, valid_qids(spark, d, vb), vb.targets, CFG.predictions)
    return p.select("qid", "iid", F.col("rank").cast("bigint").alias("rank"), F.round("prob", 9).alias("prob"), "ok")


@query("precision_at_1", S.with_corpus(r"""
SELECT count(*) AS evaluated, CAST(coalesce(sum(CAST(ok AS BIGINT)), 0) AS BIGINT) AS hits,
       round(100.0 * sum(CAST(ok AS BIGINT)) / nullif(count(*), 0), 6) AS precision,
       coalesce(100.0 * sum(CAST(ok AS BIGINT)) / nullif(count(*), 0) > 50.0, false) AS passed
FROM (SELECT * FROM qstatus WHERE status = 'ok') q JOIN predk p ON p.qid = q.idx WHERE p.rank = 1""", QWORDS_SQL + "," + _PREDICT_SQL))
def q_precision_at_1(spark, d):
    vb, mi, mo = corpus_model(spark, d)
    p = SR.context_predict(mi, mo, valid_qids(spark, d, vb), vb.targets, CFG.predictions)
    lines = query_status(spark, d, vb).where(F.col("status") == "ok")
    return SR.precision_at_1(p, lines).withColumn("precision", r6(F.col("precision")))


@query("orthant_counts", r"""
SELECT CAST(j AS BIGINT) AS dim, CAST(sum(CASE WHEN x < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative,
       CAST(sum(CASE WHEN x < 0 THEN 0 ELSE 1 END) AS BIGINT) AS non_negative
FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS j FROM (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings))
GROUP BY j""")
def q_orthant_counts(spark, d):
    return SR.orthant_counts(embeddings(spark, d))


@query("vector_length_check", r"""
SELECT CAST(min(len(embedding)) AS BIGINT) AS min_len, CAST(max(len(embedding)) AS BIGINT) AS max_len,
       min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings""")
def q_vector_length_check(spark, d):
    return SR.vector_length_check(embeddings(spark, d))


@query("similar_sentences", r"""
WITH e AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
n AS (SELECT count(*) AS n FROM e),
s AS (SELECT a.idx AS qid, b.idx AS iid,
             list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) AS score
      FROM e a, e b WHERE a.idx <> b.idx),
r AS (SELECT qid, iid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, iid) AS rank FROM s)
SELECT qid, iid, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM r, n WHERE rank <= least(n.n - 1, 5)""")
def q_similar_sentences(spark, d):
    e = embeddings(spark, d)
    n = e.count()
    k = min(n - 1, CFG.predictions)
    top = SR.blocked_scores(e.select(F.col("idx").alias("qid"), "vec"), e.select(F.col("idx").alias("iid"), "vec"),
                            k, "cosine", exclude_self=True)
    return top.select("qid", "iid", F.col("rank").cast("bigint").alias("rank"), r6(F.col("score")).alias("score"))


# ================================================================ sampling

@query("unigram_table", S.with_corpus(r"""
SELECT idx, CAST(coalesce(sum(freq) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo,
       CAST(sum(freq) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi
FROM vocab"""))
def q_unigram_table(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False)
    return SP.unigram_table(vb.vocab)


_RANGES_SQL = r"""
ranges AS (SELECT idx, CAST(coalesce(sum(freq) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo,
                  CAST(sum(freq) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi FROM vocab),
tot AS (SELECT sum(freq) AS total, count(*) AS n FROM vocab),
negs AS (
  SELECT center_idx, context_idx, tf, ck FROM (
    SELECT center_idx, context_idx, unnest(range(freq)) AS tf FROM targets)
  CROSS JOIN range(1, 25) c(ck))"""


@query("unigram_literal", S.with_corpus(r"""
SELECT s.slot, s.slot - r.lo AS k FROM (SELECT unnest(range((SELECT n FROM tot))) AS slot) s
JOIN ranges r ON s.slot >= r.lo AND s.slot < r.hi""", _RANGES_SQL))
def q_unigram_literal(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False)
    return SP.unigram_literal_table(vb.vocab, vb.vocab.count())


@query("unigram_draw", S.with_corpus(r"""
SELECT r.idx AS k, count(*) AS draws
FROM (SELECT CAST(floor(""" + S.draw("unigram", "0", "center_idx", "context_idx", "tf", number="ck") + r""" * (SELECT total FROM tot)) AS BIGINT) AS slot FROM negs) d
ASOF JOIN ranges r ON d.slot >= r.lo GROUP BY r.idx""", _RANGES_SQL))
def q_unigram_draw(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS)
    return SM.draw_counts(vb.targets, vb.vocab, CFG.with_(sampler="unigram"))


_REORDER_SQL = r"""
reorder AS (
  SELECT CAST(CASE WHEN p % 2 = 0 THEN c + p // 2 ELSE ((c - (p + 1) // 2) % n + n) % n END AS BIGINT) AS slot,
         CAST(p + 1 AS BIGINT) AS rank, idx, word, freq
  FROM (SELECT idx, word, freq, row_number() OVER (ORDER BY freq DESC, word) - 1 AS p FROM vocab),
       (SELECT count(*) AS n, count(*) // 2 + count(*) % 2 - 1 AS c FROM vocab))"""


@query("center_out_reorder", S.with_corpus("SELECT slot, rank, idx, word, freq FROM reorder", _REORDER_SQL))
def q_center_out_reorder(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False)
    return SP.center_out_reorder(vb.vocab)


def _tdnd_sql(resample: bool) -> str:
    keys = ("0", "center_idx", "context_idx", "tf")
    raw = (f"CAST(round(0.0::DOUBLE + (1.0::DOUBLE + sqrt(-2.0::DOUBLE * ln({S.draw('tdnd1', *keys, number='ck', open0=True)})) * "
           f"cos({2.0 * 3.141592653589793!r}::DOUBLE * {S.draw('tdnd2', *keys, number='ck')}) * 0.25::DOUBLE) * 0.5::DOUBLE * "
           f"CAST((SELECT n FROM tot) - 1 AS DOUBLE)) AS BIGINT)")
    if not resample:
        return f"SELECT {raw} AS value FROM negs"
    res = f"CAST(floor({S.draw('tdnd3', *keys, number='ck')} * CAST((SELECT n FROM tot) - 1 AS DOUBLE) + 0.0::DOUBLE) AS BIGINT)"
    return (f"SELECT CASE WHEN v < 0 OR v > (SELECT n FROM tot) - 1 THEN {res} ELSE v END AS slot "
            f"FROM (SELECT *, {raw} AS v FROM negs)")


@query("tdnd_draw", S.with_corpus(f"SELECT value, count(*) AS draws FROM ({_tdnd_sql(False)}) GROUP BY value",
                                  _RANGES_SQL))
def q_tdnd_draw(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS)
    return SM.tdnd_value_counts(vb.targets, vb.vocab, CFG)


@query("tdnd_resample", S.with_corpus(
    f"SELECT r.idx AS k, count(*) AS draws FROM ({_tdnd_sql(True)}) d JOIN reorder r ON r.slot = d.slot GROUP BY r.idx",
    _RANGES_SQL + "," + _REORDER_SQL))
def q_tdnd_resample(spark, d):
    vb = build_vocabulary(docs(spark, d), CFG, STOPS)
    return SM.draw_counts(vb.targets, vb.vocab, CFG.with_(sampler="tdnd"))


def _loss_sql(score: str, digits: int) -> str:
    return r"""
SELECT CAST(sum(CASE WHEN ck = 0 THEN 1 ELSE 0 END) AS BIGINT) AS examples,
       round(sum(CASE WHEN x >= 0 THEN ln(1 + exp(-x)) ELSE -x + ln(1 + exp(x)) END), """ + str(digits) + r""") AS loss
FROM (SELECT ck, CASE WHEN ck = 0 THEN e ELSE -e END AS x FROM (
  SELECT s.ck, """ + score + r""" AS e
  FROM (SELECT center_idx, context_idx AS k, 0 AS ck FROM (SELECT center_idx, context_idx, unnest(range(freq)) AS tf FROM targets)
        UNION ALL
        SELECT d.center_idx, r.idx AS k, 1 AS ck FROM (
          SELECT center_idx, CAST(floor(""" + S.draw("unigram", "0", "center_idx", "context_idx", "tf", number="ck") + r""" * (SELECT total FROM tot)) AS BIGINT) AS slot FROM negs) d
        ASOF JOIN ranges r ON d.slot >= r.lo) s
  JOIN model_in a ON a.idx = s.center_idx JOIN model_out b ON b.idx = s.k))"""


_INITIAL_LOSS_SQL = _loss_sql("list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec))", 3)


@query("sgns_loss", S.with_corpus(_loss_sql("list_dot_product(a.vec, b.vec)", 4), _RANGES_SQL + ",\n" + MODEL_SQL))
def q_sgns_loss(spark, d):
    vb, mi, mo = corpus_model(spark, d)
    return SP.sgns_loss(vb.targets, vb.vocab, mi, mo, CFG.with_(sampler="unigram")).select("examples", F.round("loss", 4).alias("loss"))


def _n10_sql() -> str:
    raw = ("CAST(round(0.0::DOUBLE + (1.0::DOUBLE + sqrt(-2.0::DOUBLE * ln(" + S.u("n10a", "i", open0=True) + ")) * "
           "cos(" + repr(2.0 * 3.141592653589793) + "::DOUBLE * " + S.u("n10b", "i") + ") * 0.25::DOUBLE) * 0.5::DOUBLE * "
           "CAST((SELECT n FROM tot) AS DOUBLE)) AS BIGINT)")
    res = "CAST(floor(" + S.u("n10c", "i") + " * CAST((SELECT n FROM tot) AS DOUBLE) + 0.0::DOUBLE) AS BIGINT)"
    return ("d AS (SELECT CASE WHEN v < 0 OR v > (SELECT n FROM tot) THEN " + res + " ELSE v END AS slot FROM "
            "(SELECT i, " + raw + " AS v FROM (SELECT unnest(range(CAST((SELECT total FROM tot) AS BIGINT))) AS i))),\n"
            "c AS (SELECT slot, count(*) AS draws FROM d GROUP BY slot)")


@query("sampler_vs_vocab", S.with_corpus(
    "SELECT coalesce(r.slot, c.slot) AS slot, CAST(coalesce(r.freq, 0) AS BIGINT) AS freq, "
    "CAST(coalesce(c.draws, 0) AS BIGINT) AS draws FROM reorder r FULL OUTER JOIN c ON c.slot = r.slot",
    _RANGES_SQL + "," + _REORDER_SQL + ",\n" + _n10_sql()))
def q_sampler_vs_vocab(spark, d):
    """Reordered vocabulary frequencies vs Σfreq TDND draws on [0, n], per slot."""
    vb = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False)
    return SP.sampler_vs_vocab(vb.vocab, CFG)


# ================================================================ sentences & Q/A

from wordloom.functions.dist import normal_cdf_sql  # noqa: E402
from wordloom.operators import analytics as AN  # noqa: E402
from wordloom.operators import qa as QA  # noqa: E402
from wordloom.operators import sentences as SE  # noqa: E402
from wordloom.sources.corpus import conversation_qa_lines  # noqa: E402

_LINES_SQL = r"""
lines AS (SELECT doc_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS line_no, unnest(arr) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents)),
lw AS (SELECT doc_id, line_no, """ + S.clean(S.lower("t")) + r""" AS word
       FROM (SELECT doc_id, line_no, unnest(list_filter(regexp_split_to_array(""" + S.clean(S.lower("line")) + \
    r""", '""" + S.D + r"""+'), lambda x: x <> '')) AS t FROM lines)),
sx AS (SELECT doc_id, line_no, j, sum(x) AS s FROM (
         SELECT w.doc_id, w.line_no, unnest(m.vec) AS x, generate_subscripts(m.vec, 1) AS j
         FROM lw w JOIN model_in m ON m.word = w.word) GROUP BY doc_id, line_no, j),
sl AS (SELECT doc_id, line_no, list(s ORDER BY j) AS s FROM sx GROUP BY doc_id, line_no),
sentvec AS (
  SELECT l.doc_id, l.line_no,
         CASE WHEN sl.s IS NULL OR list_dot_product(sl.s, sl.s) = 0 THEN NULL
              ELSE list_transform(sl.s, lambda x: x / sqrt(list_dot_product(sl.s, sl.s))) END AS vec
  FROM lines l LEFT JOIN sl ON sl.doc_id = l.doc_id AND sl.line_no = l.line_no)"""


def sentence_vectors(spark, d):
    vb, mi, mo = corpus_model(spark, d, with_targets=False, out_layer=False)
    lines = SC.read_corpus(docs(spark, d)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")
    return SE.encode_sentences(lines, mi, ["doc_id", "line_no"], "line", CFG)


@query("encode_sentences", S.with_corpus(
    "SELECT doc_id, line_no, list_transform(vec, lambda x: round(x, 6)) AS vec FROM sentvec",
    MODEL_SQL + "," + _LINES_SQL))
def q_encode_sentences(spark, d):
    return sentence_vectors(spark, d).select("doc_id", "line_no", V.round_vec(F.col("vec")).alias("vec"))


@query("encode_sentence", S.with_corpus(r"""
SELECT b.item_id, CASE WHEN s.s IS NULL OR list_dot_product(s.s, s.s) = 0 THEN NULL
       ELSE list_transform(s.s, lambda x: round(x / sqrt(list_dot_product(s.s, s.s)), 6)) END AS vec
FROM benchmark b LEFT JOIN (
  SELECT item_id, list(s ORDER BY j) AS s FROM (
    SELECT item_id, j, sum(x) AS s FROM (
      SELECT w.item_id, unnest(m.vec) AS x, generate_subscripts(m.vec, 1) AS j
      FROM (SELECT item_id, """ + S.clean(S.lower("t")) + r""" AS word FROM (
              SELECT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '[\r\n]', ' ', 'g'), '""" +
    S.D + r"""+'), lambda x: x <> '')) AS t FROM benchmark)) w
      JOIN model_in m ON m.word = w.word) GROUP BY item_id, j) GROUP BY item_id) s ON s.item_id = b.item_id""",
    MODEL_SQL))
def q_encode_sentence(spark, d):
    """Each benchmark item as one sentence (its line breaks read as spaces)."""
    vb, mi, mo = corpus_model(spark, d, with_targets=False, out_layer=False)
    b = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[\\r\\n]", " ").alias("text"))
    return SE.encode_sentence(b, mi, ["item_id"], "text", CFG).select(
        "item_id", V.round_vec(F.col("vec")).alias("vec"))


@query("write_sentence_vectors", S.with_corpus(
    "SELECT doc_id, line_no, CASE WHEN vec IS NULL THEN array_to_string(list_transform(range(0, 50), lambda j: 'nan'), chr(9)) "
    "ELSE array_to_string(list_transform(vec, lambda x: printf('%.6f', x)), chr(9)) END AS line FROM sentvec",
    MODEL_SQL + "," + _LINES_SQL))
def q_write_sentence_vectors(spark, d):
    return SE.sentence_tsv_lines(sentence_vectors(spark, d), ["doc_id", "line_no"], CFG.hidden)


def qa_lines(spark, d):
    return conversation_qa_lines(table(spark, d, "conversations"))


@query("zip_questions_answers", r"""
SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""")
def q_zip_questions_answers(spark, d):
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


@query("read_qa_corpus", "WITH " + S.QA_CTES + "\nSELECT conv_id, turn, line FROM qal")
def q_read_qa_corpus(spark, d):
    return qa_lines(spark, d)


@query("qa_clean", "WITH " + S.QA_CTES + "\nSELECT conv_id, turn, regexp_replace(" + S.lower("line") +
       r", '[^\w\s|\x08=~>]', '', 'g') AS line FROM qal")
def q_qa_clean(spark, d):
    return qa_lines(spark, d).withColumn("line", T.qa_clean(F.col("line")))


@query("collapse_letter_runs", "WITH " + S.QA_CTES + "\nSELECT conv_id, turn, line FROM qac")
def q_collapse_letter_runs(spark, d):
    return QA.clean_qa_lines(qa_lines(spark, d))


@query("split_qa", "WITH " + S.QA_CTES + "\nSELECT conv_id, turn, question, answer FROM qas")
def q_split_qa(spark, d):
    return QA.split_qa(QA.clean_qa_lines(qa_lines(spark, d)))


@query("whitespace_tokens", "WITH " + S.QA_CTES + r"""
SELECT conv_id, turn, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS pos, unnest(ws) AS token
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(question, '\s+'), lambda x: x <> '') AS ws FROM qas)""")
def q_whitespace_tokens(spark, d):
    qa = QA.split_qa(QA.clean_qa_lines(qa_lines(spark, d)))
    return qa.select("conv_id", "turn", F.posexplode(T.whitespace_tokens(F.col("question"))).alias("pos", "token")) \
        .select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "token")


_ENCODED_SQL = r"""
SELECT q.conv_id, q.turn, q.question, q.answer,
       list_transform(e.s, lambda x: round(x / sqrt(list_dot_product(e.s, e.s)), 6)) AS vec
FROM qas q JOIN (
  SELECT conv_id, turn, list(s ORDER BY j) AS s FROM (
    SELECT conv_id, turn, j, sum(x) AS s FROM (
      SELECT t.conv_id, t.turn, unnest(m.vec) AS x, generate_subscripts(m.vec, 1) AS j
      FROM (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(question, '\s+'), lambda x: x <> '')) AS word
            FROM qas) t
      JOIN (SELECT word, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM model_in) m
        ON m.word = t.word) GROUP BY conv_id, turn, j) GROUP BY conv_id, turn) e
  ON e.conv_id = q.conv_id AND e.turn = q.turn
WHERE list_bool_or(list_transform(e.s, lambda x: x <> 0))"""


@query("encode_questions", S.with_corpus(_ENCODED_SQL, MODEL_SQL, pre=S.QA_CTES.strip(), table="qdocs"))
def q_encode_questions(spark, d):
    enc, vocab, mi = QA.qa_pipeline(table(spark, d, "conversations"), CFG, STOPS, epochs=0)
    return enc.select("conv_id", "turn", "question", "answer", V.round_vec(F.col("vec")).alias("vec"))


@query("write_qa_encoded", S.with_corpus(r"""
SELECT conv_id, turn, trim(question) || ' [' || array_to_string(list_transform(vec, lambda x: printf('%.6f', x + 0.0::DOUBLE)), ', ')
       || '] =~=~> ' || trim(answer) AS line FROM (""" + _ENCODED_SQL + ")", MODEL_SQL, pre=S.QA_CTES.strip(), table="qdocs"))
def q_write_qa_encoded(spark, d):
    enc, vocab, mi = QA.qa_pipeline(table(spark, d, "conversations"), CFG, STOPS, epochs=0)
    return QA.qa_encoded_lines(enc, ["conv_id", "turn"])


@query("export_bundle", None)
def q_export_bundle(spark, d):
    from wordloom.session import scratch_path
    path = scratch_path(spark, "bundle")
    QA.qa_pipeline(table(spark, d, "conversations"), CFG, STOPS, epochs=CFG.epochs, bundle_path=path)
    rows = [(p, spark.read.parquet(f"{path}/{p}").count()) for p in ("corpus_enc", "vocab", "embed")]
    return spark.createDataFrame(rows, "part string, rows long")


@query("qa_pipeline", None)
def q_qa_pipeline(spark, d):
    """Training on the questions, then their encoding."""
    enc, vocab, mi = QA.qa_pipeline(table(spark, d, "conversations"), CFG, STOPS, epochs=CFG.epochs)
    return enc


# ================================================================ I/O renderings

@query("write_vocab", S.with_corpus("SELECT idx, word || chr(9) || CAST(freq AS VARCHAR) AS line FROM vocab"))
def q_write_vocab(spark, d):
    from wordloom.sources.io import vocab_tsv_lines
    return vocab_tsv_lines(build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).vocab)


@query("read_vocab", S.with_corpus("SELECT idx, word, freq FROM vocab"))
def q_read_vocab(spark, d):
    """S4 read back: the vocabulary written as a text file without header, read with its schema and numbered again."""
    from wordloom.session import scratch_path
    from wordloom.sources.io import read_vocab, write_vocab
    path = scratch_path(spark, "vocab")
    write_vocab(build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).vocab, path)
    return read_vocab(spark, f"{path}/vocab.tsv")


@query("write_filtered", S.with_corpus(r"""
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN reason = 'high' THEN 0 ELSE 1 END, freq, word) - 1 AS BIGINT) AS pos,
       word || chr(9) || CAST(freq AS VARCHAR) AS line FROM removed"""))
def q_write_filtered(spark, d):
    from wordloom.sources.io import filtered_tsv_lines
    return filtered_tsv_lines(build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).removed)


@query("save_weights", S.with_corpus(
    "SELECT 'in' AS layer, idx, array_to_string(list_transform(vec, lambda x: printf('%.6f', x / sqrt(list_dot_product(vec, vec)))), chr(9)) AS line FROM model_in "
    "UNION ALL SELECT 'out', idx, array_to_string(list_transform(vec, lambda x: printf('%.6f', x)), chr(9)) FROM model_out",
    MODEL_SQL))
def q_save_weights(spark, d):
    vb, mi, mo = corpus_model(spark, d, with_targets=False)
    return MD.weights_tsv_lines(mi, True).select(F.lit("in").alias("layer"), "idx", "line").unionByName(
        MD.weights_tsv_lines(mo, False).select(F.lit("out").alias("layer"), "idx", "line"))


@query("load_weights", S.with_corpus(
    "SELECT idx, word, list_transform(vec, lambda x: round(round(x / sqrt(list_dot_product(vec, vec)), 6), 6)) AS vec FROM model_in",
    MODEL_SQL))
def q_load_weights(spark, d):
    """S7 + J5: w_ih written as the TSV text file, read back, zipped to the vocabulary by row number."""
    from wordloom.session import scratch_path
    vb, mi, mo = corpus_model(spark, d, with_targets=False)
    path = scratch_path(spark, "weights")
    MD.save_weights(mi, mo, path, tsv=True)
    back = MD.load_weights_tsv(spark, f"{path}/weights-ih.tsv", vb.vocab)
    return back.select("idx", "word", V.round_vec(F.col("vec")).alias("vec"))


@query("zip_vocab_weights", S.with_corpus("SELECT v.idx, v.word, list_transform(m.vec, lambda x: round(x, 6)) AS vec "
                                          "FROM vocab v JOIN model_in m ON m.idx = v.idx", MODEL_SQL))
def q_zip_vocab_weights(spark, d):
    vb, mi, mo = corpus_model(spark, d, with_targets=False, out_layer=False)
    return QA.zip_vocab_weights(vb.vocab, mi).select("idx", "word", V.round_vec(F.col("vec")).alias("vec"))


# ================================================================ distributions

@query("discrete_normal_pmf", S.with_corpus(
    "SELECT cell, round(CASE WHEN cell = 0 THEN yhi WHEN cell = n - 1 THEN 1.0 - ylo ELSE yhi - ylo END, 9) AS prob_folded, "
    "round(yhi - ylo, 9) AS prob FROM (SELECT cell, n, " +
    normal_cdf_sql("-4.0 + cell * (8.0 / (n - 1)) - (8.0 / (n - 1)) / 2") + " AS ylo, " +
    normal_cdf_sql("-4.0 + cell * (8.0 / (n - 1)) + (8.0 / (n - 1)) / 2") + " AS yhi "
    "FROM (SELECT unnest(range(n)) AS cell, n FROM (SELECT count(*) AS n FROM vocab)))"))
def q_discrete_normal_pmf(spark, d):
    """Discrete normal over the V sampler slots, cells on [m − 4s, m + 4s] (the TDND range)."""
    v = build_vocabulary(docs(spark, d), CFG, STOPS, with_targets=False).vocab
    n = v.count()
    cells = v.select(F.col("idx").alias("cell"))
    p = AN.discrete_normal_pmf(cells, n, 0.0, 1.0, span=4.0)
    return p.select("cell", F.round("prob_folded", 9).alias("prob_folded"), F.round("prob", 9).alias("prob"))


@query("empirical_distribution", r"""
SELECT l_quantity AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(l_quantity) FROM lineitem), 6) AS pct,
       (SELECT min(l_quantity) FROM lineitem) AS min_value, (SELECT max(l_quantity) FROM lineitem) AS max_value
FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_quantity""")
def q_empirical_distribution(spark, d):
    e = AN.empirical_distribution(table(spark, d, "lineitem"), "l_quantity")
    return e.withColumn("pct", r6(F.col("pct")))


@query("normal_fit", r"""
SELECT 'events.value' AS source, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events
UNION ALL
SELECT 'lineitem.l_quantity', count(l_quantity), round(avg(l_quantity), 6), round(stddev_pop(l_quantity), 6) FROM lineitem""")
def q_normal_fit(spark, d):
    a = AN.normal_fit(table(spark, d, "events"), "value").select(F.lit("events.value").alias("source"), "*")
    b = AN.normal_fit(table(spark, d, "lineitem"), "l_quantity").select(F.lit("lineitem.l_quantity").alias("source"), "*")
    return a.unionByName(b).select("source", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("histogram", r"""
WITH mm AS (SELECT min(l_quantity) AS mn, max(l_quantity) AS mx, CAST(max(l_quantity) AS BIGINT) AS nb FROM lineitem),
c AS (SELECT CAST(least(floor((l_quantity - mm.mn) / ((mm.mx - mm.mn) / mm.nb)), mm.nb - 1) AS BIGINT) AS bin, count(*) AS n
      FROM lineitem, mm WHERE l_quantity IS NOT NULL GROUP BY 1)
SELECT b.bin, round(mm.mn + b.bin * ((mm.mx - mm.mn) / mm.nb), 6) AS lo, round(mm.mn + (b.bin + 1) * ((mm.mx - mm.mn) / mm.nb), 6) AS hi,
       coalesce(c.n, 0) AS n
FROM (SELECT unnest(range((SELECT nb FROM mm))) AS bin) b CROSS JOIN mm LEFT JOIN c ON c.bin = b.bin""")
def q_histogram(spark, d):
    h = AN.histogram(table(spark, d, "lineitem"), "l_quantity")
    return h.select("bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n")


# ================================================================ training (rows-only checks)

from wordloom.operators import train as TR  # noqa: E402
from wordloom.plans.actions import Pipeline  # noqa: E402


def trainer(spark, d, cfg=CFG):
    vb = build_vocabulary(docs(spark, d), cfg, STOPS)
    return vb, TR.SGNSTrainer(vb.vocab, vb.targets, cfg)


@query("sgns_epoch", None)
def q_sgns_epoch(spark, d):
    """One epoch from the initial weights → the updated input layer."""
    vb, tr = trainer(spark, d)
    st = tr.epoch(tr.init(), 0)
    return st.model_in


@query("train", None)
def q_train(spark, d):
    """The full default run (10 epochs, unigram sampler) → per-epoch losses."""
    vb, tr = trainer(spark, d)
    tr.train()
    return tr.loss_report()


@query("loss_report", None)
def q_loss_report(spark, d):
    """Loss curves of the two samplers side by side."""
    out = None
    for sampler in ("unigram", "tdnd"):
        vb, tr = trainer(spark, d, CFG.with_(sampler=sampler))
        tr.train()
        r = tr.loss_report()
        out = r if out is None else out.unionByName(r)
    return out


@query("checkpoint_epoch", S.with_corpus(r"""
SELECT CAST(e AS INTEGER) AS epoch, layer, (SELECT count(*) FROM vocab) AS rows
FROM (SELECT unnest(range(0, 11)) AS e), (SELECT unnest(['in', 'out']) AS layer)"""))
def q_checkpoint_epoch(spark, d):
    """The per-epoch model tables of a run: (epoch, layer, rows)."""
    vb, tr = trainer(spark, d)
    tr.train()
    rows = [(ep, layer, spark.read.parquet(f"{tr.dir}/epoch={ep}/layer={layer}").count())
            for ep in range(CFG.epochs + 1) for layer in ("in", "out")]
    return spark.createDataFrame(rows, "epoch int, layer string, rows long")


_LOG_SQL = r"""
ev AS (SELECT event_type AS model, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS INTEGER) AS epoch, abs(value) + 1.0 AS loss
       FROM events WHERE value IS NOT NULL),
parsed AS (SELECT model, epoch, round(loss, 6) AS loss,
                  round(loss / first_value(loss) OVER (PARTITION BY model ORDER BY epoch) * 100.0, 1) AS pct FROM ev)"""


def event_log(spark, d):
    """Log lines rendered from ``events``: one run per event type, its losses the events' values in order."""
    from pyspark.sql import Window
    e = table(spark, d, "events").where("value is not null")
    epoch = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    return TR.render_loss_log(e.select(F.col("event_type").alias("model"), epoch.alias("epoch"), "ts", (F.abs("value") + 1.0).alias("loss")))


@query("parse_loss_log", "WITH " + _LOG_SQL + "\nSELECT model, epoch, loss, pct FROM parsed")
def q_parse_loss_log(spark, d):
    """The textual loss logs of several runs parsed back into (model, epoch, loss, pct)."""
    return TR.parse_loss_log(event_log(spark, d), model_col="model")


@query("compare_loss_logs", "WITH " + _LOG_SQL + r"""
SELECT epoch, max(pct) FILTER (model = 'click') AS click, max(pct) FILTER (model = 'error') AS error, max(pct) FILTER (model = 'purchase') AS purchase,
       max(pct) FILTER (model = 'signup') AS signup, max(pct) FILTER (model = 'view') AS view FROM parsed GROUP BY epoch""")
def q_compare_loss_logs(spark, d):
    """The parsed percentages of the runs side by side."""
    return TR.compare_models(TR.parse_loss_log(event_log(spark, d), model_col="model"), ["click", "error", "purchase", "signup", "view"])


@query("learning_rate", r"""
SELECT CAST(l_linenumber AS BIGINT) AS epoch, greatest(0.0001::DOUBLE, 0.05::DOUBLE * (1.0::DOUBLE - l_linenumber / 10.0::DOUBLE)) AS alpha, count(*) AS n
FROM lineitem GROUP BY l_linenumber""")
def q_learning_rate(spark, d):
    """E5 as a column: the rate of every line number of ``lineitem`` read as an epoch."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("epoch")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("epoch", CFG.learning_rate_column(F.col("epoch")).alias("alpha"), "n")


@query("initial_loss", S.with_corpus(_INITIAL_LOSS_SQL, _RANGES_SQL + ",\n" + MODEL_SQL))
def q_initial_loss(spark, d):
    """E8 before its first epoch: the trainer's loss at the initial weights, input rows of unit length."""
    vb, tr = trainer(spark, d)
    loss, examples = tr.loss(tr.init(), -1)
    return spark.createDataFrame([(examples, round(loss, 3))], "examples long, loss double")


def _actions(spark, d, actions, epochs, saved=None):
    qw = query_words(spark, d).select("word")
    p = Pipeline(docs(spark, d), qw, CFG.with_(epochs=epochs), STOPS, save_dir=saved)
    return p.run(actions)


@query("evaluate", None)
def q_evaluate(spark, d):
    """P4 after training: context predictions of every valid query word."""
    return _actions(spark, d, "TRAIN,TEST", CFG.epochs)["context"]


@query("run_actions", None)
def q_run_actions(spark, d):
    """TRAIN,SAVE in one session, LOAD,TEST in a second → precision@1 of the reloaded model."""
    from wordloom.session import scratch_path
    saved = scratch_path(spark, "saved-model")
    _actions(spark, d, "TRAIN,SAVE", CFG.epochs, saved)
    return _actions(spark, d, "LOAD,TEST", CFG.epochs, saved)["precision"]


# ================================================================ stemming

from wordloom.operators import stem as ST  # noqa: E402


@query("stem_vocabulary", None)
def q_stem_vocabulary(spark, d):
    """T4 job over distinct words: (stem, freq, words) of the unstemmed word counts."""
    return ST.stem_vocabulary(VC.word_freq(sents(spark, d)))


@query("stemmed_vocab", None)
def q_stemmed_vocab(spark, d):
    """T4 in the tokeniser (stemming on): the indexed vocabulary of stems."""
    return build_vocabulary(docs(spark, d), CFG.with_(stem=True), STOPS, with_targets=False).vocab
