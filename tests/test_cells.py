"""Training cells: order of a segment's samples, one partition per cell, and what a join may send to the driver."""

import re

import numpy as np
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.operators import samples as SM
from wordloom.operators.train import SGNSTrainer, run_cell, softplus


def targets(spark, v=40, seed=4):
    r = np.random.default_rng(seed)
    vocab = spark.createDataFrame([(i, f"w{i:03d}", int(f)) for i, f in enumerate(r.integers(5, 20, v))], "idx long, word string, freq long")
    rows = [(p, f"w{p:03d}", int(c), f"w{c:03d}", int(f)) for p in range(v) for c, f in zip(r.permutation(v)[:6], r.integers(1, 150, 6)) if c != p]
    return vocab, spark.createDataFrame(rows, "center_idx long, center string, context_idx long, context string, freq long")


def test_samples_of_a_segment_ascend(spark):
    vocab, t = targets(spark)
    for sampler in ("unigram", "tdnd"):
        cfg = Config(samples=9, blocks=3, batch=16, sampler=sampler)
        space = SM.slots(vocab, cfg)
        examples, _, total = SM.example_table(t, space, 3)
        rows = SM.sample_table(examples, space, cfg, 1, cfg.batch).collect()
        n = 0
        for r in rows:
            x = np.frombuffer(r.x, dtype=space.dtype).astype(np.int64)
            n += len(x)
            assert (np.diff(x[:r.n_pos]) >= 0).all() and (np.diff(x[r.n_pos:]) >= 0).all()
        assert n == total * cfg.samples and sum(r.n_pos for r in rows) == total


def test_block_numbers_by_comparison_and_search():
    bounds = np.sort(np.random.default_rng(0).choice(5000, 40, replace=False))
    bounds[0] = 0
    slot = np.random.default_rng(1).integers(0, 6000, (50, 7))
    for n in (1, 3, SM.FEW_BLOCKS, 40):
        assert np.array_equal(SM.block_numbers(bounds[:n], slot), np.searchsorted(bounds[:n], slot, side="right") - 1)


def test_order_of_wide_distances():
    r = np.random.default_rng(2)
    group, far = r.integers(0, 9, 400), r.integers(0, 1 << 31, 400)
    a, b = SM.in_order(group, far, True, np.dtype("<u4")), SM.in_order(group, far, True, np.dtype("<i8"))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_each_cell_has_a_partition_of_its_own(spark):
    vocab, t = targets(spark)
    examples, _, _ = SM.example_table(t, SM.slots(vocab, Config(), blocks=4), 5)
    table, n = SM.places(examples)
    size = {r.cell: r.n for r in examples.groupBy("cell").agg(F.sum("nrep").alias("n")).collect()}
    at = {r.cell: r.at for r in table.repartition(n, "place").select("cell", F.spark_partition_id().alias("at")).collect()}
    assert n == len(size) == len(at) and sorted(at.values()) == list(range(n))
    assert [size[c] for c in sorted(at, key=at.get)] == sorted(size.values(), reverse=True)


def test_no_rows_have_no_places(spark):
    vocab, t = targets(spark)
    examples, _, _ = SM.example_table(t.limit(0), SM.slots(vocab, Config()), 1)
    table, n = SM.places(examples)
    assert n == 0 and table.count() == 0


def test_loss_of_great_scores():
    """Scores far beyond exp's range, and zero weights."""
    x = np.array([-800.0, -30.0, 0.0, 30.0, 800.0])
    assert np.allclose(softplus(x), [0.0, np.exp(-30.0), np.log(2.0), 30.0, 800.0], atol=1e-12)
    w_in, w_out = np.array([[800.0, 0.0]]), np.array([[1.0, 0.0], [-1.0, 0.0]])
    loss = run_cell(w_in, w_out, np.array([0]), np.array([1.0]), np.array([0, 0, 0]), np.array([0, 1, 1]), np.array([True, True, False]), 0.1)
    assert abs(loss - 800.0) < 1e-9


def test_steps_do_not_multiply_what_a_join_may_broadcast(spark):
    """The cells' centers are few bytes as a file: repeated for every superstep below the join, they went to the driver all the same."""
    vocab, t = targets(spark)
    tr = SGNSTrainer(vocab, t, Config(hidden=4, blocks=3))
    rows = SM.deliver(tr.cells, tr.space, *tr._start(tr.init()), None)
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    seen = 0
    for i, line in enumerate(plan):
        if re.search(r"Join Inner, \(idx#", line):
            below = [x for x in plan[i + 1:next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))]]
            assert not any("Generate" in x for x in below)
            seen += 1
    assert seen == 2
    assert rows.where(F.col("layer") == SM.INPUT).count() == 3 * tr.cells[1].count()
