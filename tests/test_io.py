"""File sinks and readers round-trip."""

from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.operators.model import init_weights, load_weights, save_weights
from wordloom.plans.pipeline import build_vocabulary
from wordloom.session import scratch_path
from wordloom.sources.io import read_vocab, write_vocab


def test_vocab_tsv_roundtrip(spark, docs1):
    vb = build_vocabulary(docs1, Config(), None, with_targets=False)
    path = scratch_path(spark, "io-vocab")
    write_vocab(vb.vocab, path)
    lines = spark.read.text(f"{path}/vocab.tsv").collect()
    assert all(len(r.value.split("\t")) == 2 for r in lines)          # word<TAB>freq, no header
    back = read_vocab(spark, f"{path}/vocab.tsv")
    a = {(r.idx, r.word, r.freq) for r in vb.vocab.collect()}
    b = {(r.idx, r.word, r.freq) for r in back.collect()}
    assert a == b                                                   # first word kept (no header)


def test_weights_parquet_roundtrip(spark, docs1):
    vb = build_vocabulary(docs1, Config(), None, with_targets=False)
    mi, mo = init_weights(vb.vocab, Config())
    path = scratch_path(spark, "io-weights")
    save_weights(mi, mo, path, tsv=True)
    li, lo = load_weights(spark, path)
    norms = li.select(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-12 for r in norms)              # w_ih saved normalised
    assert {r.idx: r.vec for r in lo.collect()} == {r.idx: r.vec for r in mo.collect()}
    tsv = spark.read.text(f"{path}/weights-ho.tsv").first().value.split("\t")
    assert len(tsv) == 50 and all(len(x.split(".")[1]) == 6 for x in tsv)
