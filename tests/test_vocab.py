"""Vocabulary anchors on sf0.001 (empty stop list) and the ranking helpers."""

import random

from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.operators import cooc as CO
from wordloom.operators import tokens as TK
from wordloom.operators import vocab as VC
from wordloom.operators.ranking import dense_index, prefix_sum
from wordloom.plans.pipeline import build_vocabulary


def test_anchors_sf0001(spark, docs1):
    assert TK.raw_tokens(docs1).count() == 79131
    vb = build_vocabulary(docs1, Config(), None)
    assert vb.sents.select(F.sum(F.size("words"))).first()[0] == 53090
    assert vb.v_raw == 17166
    assert VC.filter_low(vb.wf).count() == 15657
    assert VC.high_cut(vb.v_raw, Config()) == 171
    assert vb.wf.agg(F.max("freq")).first()[0] == 3113
    assert vb.vocab.count() == 1338
    r = VC.vocab_freq_sum_max(vb.vocab).first()
    assert (r.freq_sum, r.freq_max) == (12836, 31)
    assert CO.pair_count(vb.und).first()[0] == 152097
    assert vb.targets.count() == 15130
    assert CO.training_examples(vb.targets).first()[0] == 20094


def test_vocab_index_is_byte_order(spark, docs1):
    vb = build_vocabulary(docs1, Config(), None, with_targets=False)
    rows = vb.vocab.orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(rows)))
    words = [r.word for r in rows]
    assert words == sorted(words, key=lambda w: w.encode())


def test_dense_index_and_prefix_sum(spark):
    random.seed(1)
    vals = [(i, random.randint(1, 9)) for i in random.sample(range(100000), 3000)]
    df = spark.createDataFrame(vals, "k long, v long")
    r = dense_index(df, [F.col("k")], "idx").orderBy("idx").collect()
    assert [x.k for x in r] == sorted(k for k, _ in vals)
    assert [x.idx for x in r] == list(range(len(vals)))
    dense = dense_index(df, [F.col("k")], "i")
    ps = prefix_sum(dense, "i", "v", "cum", block=128).orderBy("i").collect()
    run = 0
    for x in ps:
        assert x.cum == run
        run += x.v
