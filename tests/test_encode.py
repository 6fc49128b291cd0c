"""Scores and sentence vectors by cells: any size of block and cell gives what a plain join gives."""

import math
import random

from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import vectors as V
from wordloom.operators import scoring
from wordloom.operators import sentences as SE
from wordloom.operators.model import init_weights
from wordloom.plans.pipeline import build_vocabulary
from wordloom.sources.corpus import read_corpus

SIZES = [{}, {"block_bytes": 20_000}, {"block_bytes": 20_000, "most_cell": 500}]


def same(a, b):
    return a is None and b is None or a is not None and b is not None and max(abs(x - y) for x, y in zip(a, b)) < 1e-12


def test_encoding_equals_join(spark, docs1, monkeypatch):
    monkeypatch.setattr(scoring, "LEAST_CELL", 100)
    monkeypatch.setattr(scoring, "SLICE", 7)
    vb = build_vocabulary(docs1, Config(), None, with_targets=False)
    mi, _ = init_weights(vb.vocab, Config())
    lines = read_corpus(docs1).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")
    rows = SE.line_words(lines, ["doc_id", "line_no"])
    sums = rows.select("doc_id", "line_no", F.explode("words").alias("word")).join(mi, "word") \
        .groupBy("doc_id", "line_no").agg(V.sum_vectors(F.col("vec")).alias("s"))
    want = {(r.doc_id, r.line_no): r.vec for r in rows.join(sums, ["doc_id", "line_no"], "left")
            .select("doc_id", "line_no", V.l2_normalize(F.col("s")).alias("vec")).collect()}
    for sizes in SIZES:
        got = {(r.doc_id, r.line_no): r.vec for r in SE.encode_words(rows, mi, ["doc_id", "line_no"], **sizes).collect()}
        assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in got)


def model(spark, n, seed, zero=()):
    r = random.Random(seed)
    return spark.createDataFrame([(i, [0.0] * 6 if i in zero else [r.uniform(-1, 1) for _ in range(6)]) for i in range(n)], "idx long, vec array<double>")


def test_scores_equal_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(scoring, "LEAST_CELL", 50)
    a, b = model(spark, 300, 1, zero=(5,)), model(spark, 200, 2)
    va, vb = ({r.idx: r.vec for r in m.collect()} for m in (a, b))
    r = random.Random(3)
    # a hot word, a zero vector, repeated pairs, ids that no model has
    pairs = [(7, r.randrange(200)) for _ in range(600)] + [(r.randrange(300), r.randrange(200)) for _ in range(900)] + [(5, 1), (5, 1), (9, 9), (9, 9), (999, 1), (1, 999)]
    rows = spark.createDataFrame([(p, k, f"x{i}") for i, (p, k) in enumerate(pairs)], "p long, k long, note string")
    dot = lambda x, y: sum(s * t for s, t in zip(x, y))
    for kind, f in (("dot", dot), ("sigmoid", lambda x, y: 1 / (1 + math.exp(-dot(x, y)))),
                    ("cosine", lambda x, y: dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) if any(x) else None)):
        want = {f"x{i}": f(va[p], vb[k]) for i, (p, k) in enumerate(pairs) if p in va and k in vb}
        for sizes in ({}, {"block_bytes": 2000, "most_cell": 60}):
            got = scoring.pair_scores(rows, a, b, "p", "k", kind, **sizes).collect()
            assert len(got) == len(want)
            assert all(same(None if x.score is None else [x.score], None if want[x.note] is None else [want[x.note]]) for x in got)


def test_empty_tables(spark):
    a = model(spark, 3, 1)
    none = spark.createDataFrame([], "p long, k long")
    assert scoring.pair_scores(none, a, a, "p", "k").collect() == []
    one = spark.createDataFrame([(1, 1)], "p long, k long")
    assert scoring.pair_scores(one, a.where("idx < 0"), a, "p", "k").collect() == []
    words = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "id long, words array<string>")
    empty = spark.createDataFrame([], "word string, vec array<double>")
    assert {(r.id, r.vec) for r in SE.encode_words(words, empty, ["id"]).collect()} == {(1, None), (2, None), (3, None)}
