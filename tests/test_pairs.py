"""Pairs counted after pruning: equal to the string form, whatever the filter lets through."""

from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.operators import cooc as CO
from wordloom.operators import tokens as TK
from wordloom.operators import vocab as VC
from wordloom.plans.pipeline import build_vocabulary


def by_strings(und, vocab):
    """Targets by joining all pairs' words with the vocabulary."""
    idx = {r.word: r.idx for r in vocab.collect()}
    out = set()
    for r in und.collect():
        if r.a in idx and r.b in idx:
            out |= {(idx[r.a], r.a, idx[r.b], r.b, r.freq), (idx[r.b], r.b, idx[r.a], r.a, r.freq)}
    return out


def test_targets_equal_the_string_form(spark, docs1):
    vb = build_vocabulary(docs1, Config(), None)
    want = by_strings(vb.und, vb.vocab)
    assert {tuple(r) for r in vb.targets.collect()} == want and vb.targets.count() == len(want)
    assert vb.pair_count == CO.pair_count(vb.und).first()[0]


def test_a_filter_that_lets_much_through_changes_nothing(spark, docs1):
    sents = TK.sentences(docs1, Config(), None, piece=500)      # fragments with halos, too
    wf = VC.word_freq(sents)
    kept, _ = VC.vocab_filter(wf, Config())
    vocab = VC.vocab_index(kept)
    seed = CO.key_seed(wf)
    want = by_strings(CO.undirected_counts(sents), vocab)
    for bits in (8, CO.BITS):
        pairs = CO.kept_pairs(sents, vocab, seed, bits=bits)
        assert {tuple(r) for r in CO.vocab_targets(pairs, vocab, seed).collect()} == want
    tight = CO.kept_pairs(sents, vocab, seed).count()
    assert tight - 1 <= 1.05 * len(want) / 2            # pairs that are shuffled: hardly more than those of kept words
    assert tight < CO.undirected_counts(sents).count() / 3


def test_seed_tells_all_words_apart(spark):
    wf = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, freq long")
    assert CO.key_seed(wf) == 0
    assert wf.select(CO.word_key(F.col("word"), 0)).distinct().count() == 3


def test_no_sentences(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    vb = build_vocabulary(docs, Config(), None)
    assert vb.targets.count() == 0 and vb.pair_count == 0
