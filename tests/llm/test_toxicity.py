"""Toxicity: segments against brute force, the extreme-value rate, held-out accuracy, cases."""

import random

import numpy as np
from pyspark.sql import functions as F
from tables import docs, prose

from wordloom.llm import toxicity
from wordloom.llm.frames import read, remainder


def brute_segments(v):
    """The best segment, then the same in what is left on both sides."""
    best = None
    for i in range(len(v)):
        total = 0
        for j in range(i, len(v)):
            total += v[j]
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, s = best
    return brute_segments(v[:i]) + [best] + [(a + j, b + j, t) for a, b, t in brute_segments(v[j:])]


def test_segments_match_brute_force():
    r = random.Random(1)
    for _ in range(300):
        v = [r.choice([-3, -2, -1.25, -0.5, 0.75, 1.5, 2.25, 4]) + r.random() / 100 for _ in range(r.randint(0, 25))]
        got = toxicity.segments(v)
        want = brute_segments(v)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_growth_rate_is_the_root():
    score, p = np.array([2.0, -1.0]), np.array([0.1, 0.9])
    rate = toxicity.growth_rate(score, p)
    assert rate > 0 and abs((p * np.exp(rate * score)).sum() - 1) < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    held = labels.where(remainder("doc_id", 3) == 1).select(F.col("doc_id").alias("id"), "toxic")
    model = toxicity.train(d, labels, remainder("doc_id", 3) != 1)
    got = toxicity.score(d, model).join(held, "id").toPandas()
    said, true = got["score"] >= 0.7, got["toxic"] == 1
    assert (said & true).sum() / said.sum() > 0.95 and (said & true).sum() / true.sum() > 0.75


def labelled(spark):
    rows = [(i, prose(i, 60) + (" vile rotten vile " if i % 4 == 0 else " ") + prose(i + 500, 30)) for i in range(200)]
    rows += [(900, None), (901, ""), (None, "vile rotten vile"), (902, "vile rotten " + prose(7, 20_000, 300)), (903, "VILE rotten vile rotten"), (903, "VILE rotten vile rotten")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(900, 1, 1), (901, 0, 0), (None, 1, 1), (5, 1, None), (6, 1, 7), (8, 1, 0)]
    return docs(spark, rows), spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")


def test_cases(spark):
    d, labels = labelled(spark)
    model = toxicity.train(d, labels, F.lit(True))
    got = toxicity.score(d, model).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["score"])
    assert len(got) == 206 and len(by[903]) == 2 and by[903][0] == by[903][1]
    assert all((s >= 0.7) == (i % 4 == 0) for i, (s, *_) in ((i, x) for i, x in by.items() if i is not None and i < 200))
    assert by[900] == by[901] and by[901][0] < 0.5 and by[None][0] >= 0.7 and by[903][0] >= 0.7
    found = {(r["id"], r["first"], r["last"]) for r in toxicity.passages(d, model).collect() if r["id"] in (4, 903)}
    assert (4, 60, 63) in found and (903, 0, 4) in found


def test_one_class_and_empty_tables(spark):
    d, labels = labelled(spark)
    assert {r["score"] for r in toxicity.score(d, toxicity.train(d, labels.where("toxic = 0"), F.lit(True))).collect()} == {0.0}
    none = toxicity.train(docs(spark, []), labels.limit(0), F.lit(True))
    assert toxicity.score(docs(spark, []), none).collect() == []
