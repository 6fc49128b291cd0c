"""Work over Arrow batches gives what the column expressions gave, and keeps to its bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import text as T
from wordloom.functions import vectors as V
from wordloom.operators import cooc as CO
from wordloom.operators import samples as SM
from wordloom.operators import sentences as SE
from wordloom.operators import tokens as TK
from wordloom.operators import vocab as VC
from wordloom.operators.model import init_weights
from wordloom.operators.stem import apply_stems
from wordloom.operators.train import merge_groups

TEXTS = ["The quick fox saw the lazy dog. Lazy dog (don't ask) e.g. sleeps\nThe fox, well-known as R2D2, ran.\nÀfox café—dog foo’s bar\r\nend..",
         "", None, "a.b c!? d.\r x\x0by\x0cz wörd... [x] running-runs ponies.", " .\n\n. ", "same same other same\n" * 3]


def by_columns(docs, cfg, stops):
    """The sentences as higher-order functions build them."""
    chunks = T.split_sentences(T.as_lines(T.word_lower(T.byte_view(F.col("text")))))
    rows = docs.select("doc_id", F.posexplode(chunks).alias("sid", "chunk"))
    toks = T.tokenize(F.col("chunk"))
    rows = rows.select("doc_id", "sid", F.size(toks).alias("n_raw"), F.transform(toks, lambda t: T.word_clean(t, cfg.strip_all, lowered=True)).alias("words"))
    rows = apply_stems(rows, "words") if cfg.stem else rows
    words = F.filter("words", T.word_shape_ok)
    return rows.select("doc_id", "sid", "n_raw", (F.filter(words, lambda w: T.not_stop(w, stops)) if stops else words).alias("words"))


@pytest.mark.parametrize("cfg", [Config(), Config(strip_all=True), Config(stem=True)])
def test_sentences_equal_column_expressions(spark, cfg, monkeypatch):
    monkeypatch.setattr(TK, "WORDS_OUT", 3)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for stops in (None, ["the", "don"]):
        want = by_columns(docs, cfg, stops).collect()
        got = TK.sentences(docs, cfg, stops, keep_empty=True).select("doc_id", "sid", "n_raw", "words").collect()
        assert sorted(got) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("clean_line", [True, False])
def test_line_words_equal_column_expressions(spark, clean_line):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, line string")
    t = T.byte_view(F.col("line"))
    t = T.word_clean(t) if clean_line else t
    want = docs.select("doc_id", F.transform(T.tokenize(t), lambda w: T.utf8_view(T.word_clean(w))).alias("words")).collect()
    assert sorted(SE.line_words(docs, ["doc_id"], "line", Config(), clean_line).collect()) == sorted(want)


def test_pairs_equal_column_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    sents = TK.sentences(docs, Config(), None, piece=40)
    p = sents.select("doc_id", "sid", F.explode(T.window_pairs(F.col("words"), 4, F.col("halo"), F.col("start"))).alias("p"))
    want = sorted(p.select("doc_id", "sid", "p.pos", "p.dist", "p.center", "p.ctx").collect())
    assert want and [tuple(r) for r in sorted(CO.cooccurrence_pairs(sents).collect())] == [tuple(r) for r in want]
    und = p.select(F.least("p.center", "p.ctx").alias("a"), F.greatest("p.center", "p.ctx").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq"))
    assert sorted(CO.undirected_counts(sents).collect()) == sorted(und.collect())


def test_initial_weights_equal_column_expressions(spark):
    vocab = spark.createDataFrame([(i, f"w{i}") for i in range(9)], "idx long, word string")
    cfg = Config(hidden=7, seed=3)
    for rows, stream in zip(init_weights(vocab, cfg), ("ih", "ho")):
        want = vocab.select("idx", "word", V.xavier_vector(3, stream, F.col("idx"), 7, 9).alias("vec"))
        assert sorted(rows.collect()) == sorted(want.collect())


def test_norm_is_taken_once_per_vector(spark):
    """The norm stands once in the plan, outside of the lambda over the components."""
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "vec array<double>").select(V.l2_normalize(F.col("vec")).alias("v"))
    assert [r.v for r in rows.collect()] == [[0.6, 0.8], None, None]
    assert rows._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_high_filter_counts_words_once(spark, monkeypatch):
    """Without a given size the word counts are written, and every step reads that table."""
    from wordloom import session
    written, real = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, s, name: written.append(name) or real(df, s, name))
    wf = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9)], "word string, freq long")
    got = VC.filter_high(wf, Config(high_ratio=0.7)).collect()
    assert sorted(r.word for r in got) == ["b", "c"] and written == ["word_freq", "rank"]


def test_vectors_as_text(spark):
    rows = spark.createDataFrame([(1, [0.5, -0.0000001, 1.0 / 3]), (2, None)], "k long, vec array<double>")
    got = {r.k: r.line for r in SE.sentence_tsv_lines(rows, ["k"], 3).collect()}
    assert got == {1: "0.500000\t-0.000000\t0.333333", 2: "nan\tnan\tnan"}


def test_a_cell_is_unpacked_in_stretches():
    """Stretches of whole segments, in order, that hold no more than was asked for; together they are the cell."""
    import pyarrow as pa
    size = np.array([3, 2, 4, 1, 5, 2])
    x = np.arange(size.sum(), dtype="<u4") % 6
    seg = np.array([0, 0, 1, 2, 3, 3])
    samples = pa.table({"center": pa.array([7, 7, 7, 8, 8, 8]), "seg": pa.array(seg), "cm": pa.array(np.ones(6)), "n_pos": pa.array(np.ones(6, dtype=np.int32)),
                        "x": SM._packed(x, np.append(0, np.cumsum(size)))})
    rows = pa.table({"layer": pa.array([SM.INPUT] * 2 + [SM.OUTPUT] * 6, pa.int32()), "idx": pa.array([7, 8, *range(6)]),
                     "lo": pa.array([None, None, *range(6)], pa.int64()), "vec": SM.packed_rows(np.ones((8, 2)))})
    whole, = SM.cell_arrays(samples, rows, "<u4")
    parts = list(SM.cell_arrays(samples, rows, "<u4", at_once=9))
    assert [len(c.k) for c in parts] == [9, 8]
    for name in ("center", "cm", "k", "positive"):
        assert np.array_equal(np.concatenate([getattr(c, name) for c in parts]), getattr(whole, name))
    assert np.array_equal(np.concatenate([c.seg + i * 2 for i, c in enumerate(parts)]), whole.seg)


def test_merges_stay_bounded_with_more_cells():
    """A hash group's share of rows and changes does not grow with the cells."""
    for v, parts, blocks in ((10_000, 7, 4), (300_000, 60, 4), (2_000_000, 500, 24)):
        rows = 2 * v + (parts + blocks) * (v // blocks)
        assert rows * 50 * 8 / merge_groups(v, 50, parts, blocks, 1 << 25) <= 1 << 25
