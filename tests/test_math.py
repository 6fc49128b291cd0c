"""Numeric fixtures F2–F8 and sampler properties."""

import math

import numpy as np
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import porter
from wordloom.functions.dist import normal_cdf_py
from wordloom.operators import sampling as SP
from wordloom.operators.train import PartitionRunner, hash_u


def test_f2_one_sgns_step():
    cfg = Config(samples=2, sampler="unigram_literal")
    w_in = np.array([[0.6, 0.8], [0.0, 1.0]])
    w_out = np.array([[0.3, 0.4], [0.1, -0.2]])
    rows = __import__("pandas").DataFrame({"center_idx": [0], "context_idx": [1], "tf0": [0], "nrep": [1],
                                            "context_max": [2]})
    r = PartitionRunner(w_in, w_out, np.zeros(2, dtype=np.int64), cfg, 0, 0.05)
    r.feed(rows)
    in_rows, loss, n = r.finish()
    assert n == 1
    assert abs(loss - 1.718473644254) < 1e-9
    assert np.allclose(w_out[1], [0.115749375624, -0.179000832501], atol=1e-11)
    assert np.allclose(w_out[0], [0.281326220064, 0.375101626752], atol=1e-11)
    assert np.allclose(in_rows[0][1], [0.596644002985, 0.791150510751], atol=1e-11)


def test_f3_learning_rate():
    cfg = Config()
    got = [round(cfg.learning_rate(e), 6) for e in range(10)]
    assert got == [0.05, 0.045, 0.04, 0.035, 0.03, 0.025, 0.02, 0.015, 0.01, 0.005]


def test_f4_center_out_reorder(spark):
    for n, expect in ((4, [1, 0, 2, 3]), (5, [2, 1, 3, 0, 4])):
        vocab = spark.createDataFrame([(i, f"w{i}", 100 - i) for i in range(n)], "idx long, word string, freq long")
        got = {r.rank: r.slot for r in SP.center_out_reorder(vocab).collect()}
        assert [got[p + 1] for p in range(n)] == expect
    for n in (1, 2, 3, 7, 10, 33):
        vocab = spark.createDataFrame([(i, f"w{i:03d}", 1000 - i) for i in range(n)], "idx long, word string, freq long")
        slots = sorted(r.slot for r in SP.center_out_reorder(vocab).collect())
        assert slots == list(range(n))


def test_f5_discrete_normal_pmf():
    rng, step = 7, 2 / 7
    cur, folded, plain = -1.0, [], []
    for i in range(8):
        lo, hi = normal_cdf_py(cur - step / 2), normal_cdf_py(cur + step / 2)
        folded.append(hi if i == 0 else (1 - lo if i == rng else hi - lo))
        plain.append(hi - lo)
        cur += step
    assert [round(x, 9) for x in folded[:4]] == [0.195682969, 0.088171614, 0.103693898, 0.112451519]
    assert abs(sum(folded) - 1) < 1e-12
    assert round(plain[0], 9) == 0.069134015 and round(sum(plain), 9) == 0.746902091


def test_f5_pmf_operator(spark):
    from wordloom.operators.analytics import discrete_normal_pmf
    cells = spark.range(8).select(F.col("id").alias("cell"))
    p = {r.cell: r.prob_folded for r in discrete_normal_pmf(cells, 8).collect()}
    assert round(p[0], 9) == 0.195682969 and round(p[7], 9) == 0.195682969


def test_f6_porter():
    cases = {"caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed",
             "matting": "mat", "mating": "mate", "meeting": "meet", "milling": "mill", "messing": "mess",
             "meetings": "meet", "generalization": "gener", "analogi": "analog", "conformabli": "conform",
             "sensibiliti": "sensibl", "by": "by", "is": "is"}
    for w, s in cases.items():
        assert porter.stem(w) == s, w
    assert porter.stem("agreed") == "agre" and porter.stem("disabled") == "disabl"


def test_f8_loss_identity():
    cfg = Config(samples=25, sampler="unigram")
    v, h = 5, 4
    table = np.cumsum(np.ones(v, dtype=np.int64))
    rows = __import__("pandas").DataFrame({"center_idx": [0, 1], "context_idx": [1, 2], "tf0": [0, 0],
                                            "nrep": [3, 2], "context_max": [1, 1]})
    w_in = np.ones((v, h))
    r = PartitionRunner(w_in, np.zeros((v, h)), table, cfg, 0, 0.0, update=False)
    r.feed(rows)
    _, loss, n = r.finish()
    assert n == 5 and abs(loss - 5 * 25 * math.log(2)) < 1e-9


def test_hash_uniform_range_and_determinism():
    u = hash_u(0, 1, np.arange(10000), 7)
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    assert np.array_equal(u, hash_u(0, 1, np.arange(10000), 7))


def test_sql_hash_uniform_matches_duckdb(spark):
    import duckdb
    from wordloom.functions.hashing import sql_uniform, uniform
    got = [r.u for r in spark.range(5).select(uniform(0, "neg", F.col("id"), F.lit(3)).alias("u")).orderBy("id").collect()]
    ref = [r[0] for r in duckdb.sql(f"SELECT {sql_uniform(0, 'neg', 'i', '3')} FROM range(5) t(i) ORDER BY i").fetchall()]
    assert got == ref
