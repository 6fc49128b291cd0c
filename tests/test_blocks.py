"""Block-scheduled training: slots, draws, cells, and equality with the plain sequential order."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordloom.config import SAMPLERS, Config
from wordloom.functions import hashing as H
from wordloom.operators import samples as SM
from wordloom.operators import sampling as SP
from wordloom.operators.train import PartitionRunner, SGNSTrainer, draw_negatives, run_cell
from wordloom.plans.pipeline import build_vocabulary


def small(spark, v=23, seed=1):
    """A vocabulary and targets in which every word is a center."""
    r = np.random.default_rng(seed)
    vocab = spark.createDataFrame([(i, f"w{i:03d}", int(f)) for i, f in enumerate(r.integers(5, 20, v))], "idx long, word string, freq long")
    pairs = {(p, int(c)): int(f) for p in range(v) for c, f in zip(r.permutation(v)[:6], r.integers(1, 150, 6)) if c != p}
    targets = spark.createDataFrame([(p, f"w{p:03d}", c, f"w{c:03d}", f) for (p, c), f in pairs.items()],
                                    "center_idx long, center string, context_idx long, context string, freq long")
    return vocab, targets, pairs


def lookup(vocab, cfg, v):
    """The sampler's array as a plain process would hold it."""
    if cfg.sampler == "unigram":
        return np.cumsum([r.freq for r in vocab.orderBy("idx").collect()])
    if cfg.sampler.endswith("literal"):
        return SM.literal_table(vocab, cfg, v)
    return np.array([r.idx for r in SP.center_out_reorder(vocab).orderBy("slot").collect()])


def sequential(vocab, pairs, cfg, start_in, start_out, epoch, alpha, update=True):
    """The original's order in one process: centers, contexts, repetitions ascending."""
    degree = pd.Series([p for p, _ in pairs]).value_counts()
    rows = pd.DataFrame([(p, c, 0, f, degree[p]) for (p, c), f in sorted(pairs.items())],
                        columns=["center_idx", "context_idx", "tf0", "nrep", "context_max"])
    w_out = start_out.copy()
    r = PartitionRunner(start_in.copy(), w_out, lookup(vocab, cfg, len(w_out)), cfg, epoch, alpha, update)
    r.feed(rows)
    return r.now, w_out, r.loss, r.examples


def weights(st):
    return [np.array([r.vec for r in m.orderBy("idx").collect()]) for m in (st.model_in, st.model_out)]


@pytest.mark.parametrize("sampler", SAMPLERS)
def test_one_block_in_the_original_order_equals_one_process(spark, sampler):
    cfg = Config(hidden=6, samples=5, sampler=sampler, batch=1, blocks=1)
    vocab, targets, pairs = small(spark)
    tr = SGNSTrainer(vocab, targets, cfg)
    st = tr.init()
    w_in, w_out = weights(st)
    loss, n = tr.loss(st, -1)
    _, _, want, examples = sequential(vocab, pairs, cfg, w_in, w_out, -1, 0.0, False)
    assert n == examples == sum(pairs.values()) and abs(loss - want) < 1e-9 * want
    for epoch in range(1 + (sampler == "unigram")):
        new_in, new_out, want, _ = sequential(vocab, pairs, cfg, w_in, w_out, epoch, cfg.learning_rate(epoch))
        st = tr.epoch(st, epoch)
        w_in, w_out = weights(st)
        assert abs(tr.losses[-1]["loss"] - want) < 1e-9 * want
        assert np.allclose(w_out, new_out, atol=1e-12)
        assert np.allclose(w_in, new_in / np.linalg.norm(new_in, axis=1, keepdims=True), atol=1e-12)


def blockwise(vocab, pairs, cfg, w_in, w_out, epoch, alpha, blocks, batch):
    """An epoch by the schedule's definition, in plain loops over all samples."""
    v = len(w_out)
    table, degree = lookup(vocab, cfg, v), pd.Series([p for p, _ in pairs]).value_counts()
    centers = sorted(range(v), key=lambda p: (p % blocks, p))
    examples = [(p, c, t) for p in centers for (q, c), f in sorted(pairs.items()) if q == p for t in range(f)]
    now, out = w_in / np.linalg.norm(w_in, axis=1, keepdims=True), w_out.copy()
    samples = {}
    for number, (p, c, t) in enumerate(examples):
        neg = draw_negatives(cfg.sampler, table, v, cfg.seed, epoch, p, c, np.array([t]), np.arange(1, cfg.samples))
        for k, label in [(c, 1.0), *((int(k), 0.0) for k in neg)]:
            step = (k * blocks // v - p % blocks) % blocks
            samples.setdefault((step, p % blocks, p, number // batch), []).append((k, label))
    loss = 0.0
    for (_, _, p, _), own in sorted(samples.items()):
        w, delta = now[p].copy(), np.zeros(now.shape[1])
        change = np.zeros_like(out)
        for k, label in own:
            e = out[k] @ w
            loss += np.logaddexp(0.0, -e if label else e)
            g = alpha * (1 / (1 + np.exp(-e)) - label)
            delta += g * out[k]
            change[k] -= g * w
        out += change
        now[p] = w - delta / degree[p]
    return now / np.linalg.norm(now, axis=1, keepdims=True), out, loss


@pytest.mark.parametrize("blocks,batch", [(4, 64), (3, 7)])
def test_blocks_follow_the_schedule(spark, blocks, batch):
    cfg = Config(hidden=6, samples=5, blocks=blocks, batch=batch)
    vocab, targets, pairs = small(spark)
    tr = SGNSTrainer(vocab, targets, cfg)
    st = tr.init()
    w_in, w_out = weights(st)
    want_in, want_out, loss = blockwise(vocab, pairs, cfg, w_in, w_out, 0, 0.05, blocks, batch)
    st = tr.epoch(st, 0)
    got_in, got_out = weights(st)
    assert abs(tr.losses[-1]["loss"] - loss) < 1e-9 * loss
    assert np.allclose(got_in, want_in, atol=1e-12) and np.allclose(got_out, want_out, atol=1e-12)


def test_models_do_not_depend_on_shuffle_partitions(spark, docs1):
    vb = build_vocabulary(docs1, Config(), None)
    runs = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "64", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            tr = SGNSTrainer(vb.vocab, vb.targets, Config(), partitions=3)
            runs.append((weights(tr.train(1)), [x["loss"] for x in tr.losses]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for w, losses in runs[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(w, runs[0][0]))
        assert np.allclose(losses, runs[0][1], rtol=1e-12)


def test_training_learns_with_the_defaults(spark, docs1):
    vb = build_vocabulary(docs1, Config(), None)
    tr = SGNSTrainer(vb.vocab, vb.targets, Config())
    st = tr.train(3)
    loss = [x["loss"] for x in tr.losses]
    assert loss[3] < loss[2] < loss[1] < loss[0]
    assert st.model_in.count() == st.model_out.count() == vb.vocab.count()
    assert st.model_in.where("word is null").count() == 0


def test_no_examples(spark):
    vocab, targets, _ = small(spark)
    tr = SGNSTrainer(vocab, targets.limit(0), Config(hidden=4))
    st = tr.train(1)
    assert [x["loss"] for x in tr.losses] == [0.0, 0.0] and st.model_in.count() == 23


def test_no_words(spark):
    vocab, targets, _ = small(spark)
    tr = SGNSTrainer(vocab.limit(0), targets.limit(0), Config(hidden=4))
    st = tr.train(1)
    assert st.model_in.count() == st.model_out.count() == 0


def test_cell_updates_equal_plain_loops():
    r = np.random.default_rng(3)
    w_in, w_out = r.normal(size=(4, 5)), r.normal(size=(7, 5))
    seg = np.repeat([0, 1, 2], [9, 1, 6])
    center, cm = np.array([0, 2, 2]), np.array([3.0, 2.0, 2.0])
    k, positive = r.integers(0, 7, 16), r.random(16) < 0.3
    a_in, a_out = w_in.copy(), w_out.copy()
    loss = run_cell(a_in, a_out, center, cm, seg, k, positive, 0.1)
    want = 0.0
    for s in range(3):
        w, rows = w_in[center[s]].copy(), w_out.copy()
        delta = np.zeros(5)
        for j in np.flatnonzero(seg == s):
            e = rows[k[j]] @ w
            want += np.logaddexp(0, -e if positive[j] else e)
            g = 0.1 * (1 / (1 + np.exp(-e)) - positive[j])
            delta += g * rows[k[j]]
            w_out[k[j]] -= g * w
        w_in[center[s]] = w - delta / cm[s]
    assert abs(loss - want) < 1e-9 and np.allclose(a_in, w_in) and np.allclose(a_out, w_out)


def test_one_formula_in_numpy_columns_and_sql(spark):
    rows = [(0, 5, 1, 1), (3, 1 << 33, 70, 24), (7, 12, (1 << 40) + 9, 2)]
    df = spark.createDataFrame(rows, "a long, b long, c long, n long")
    keys = [F.col(x) for x in "abc"]
    for stream in H.STREAMS:
        for open0 in (False, True):
            got = [r.u for r in df.select("a", H.draw_column(9, stream, *keys, number=F.col("n"), open0=open0).alias("u")).orderBy("a").collect()]
            sql = H.sql_draw(9, stream, "a", "b", "c", number="n", open0=open0)
            want = [r[0] for r in duckdb.sql(f"SELECT {sql} FROM (VALUES {', '.join(map(str, rows))}) t(a, b, c, n) ORDER BY a").fetchall()]
            own = (H.draw_u_open0 if open0 else H.draw_u)(H.draw_keys(9, H.STREAMS[stream], *(np.array([r[i] for r in rows]) for i in range(3))),
                                                        np.array([r[3] for r in rows]))
            assert got == want == own.tolist()


def test_draws_are_uniform():
    u = H.draw_u(H.draw_keys(0, 1, 1, np.arange(4000)[:, None], 7), np.arange(1, 25)[None, :])
    assert abs(u.mean() - 0.5) < 0.004 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.06
    counts = np.bincount((u * 20).astype(int).ravel(), minlength=20)
    assert ((counts - counts.mean()) ** 2 / counts.mean()).sum() < 45


@pytest.mark.parametrize("sampler", SAMPLERS)
def test_draw_counts_equal_plain_draws(spark, sampler):
    cfg = Config(sampler=sampler, samples=9, hidden=4, blocks=3)
    vocab, targets, pairs = small(spark)
    table = lookup(vocab, cfg, 23)
    want = np.zeros(23, dtype=int)
    for (p, c), f in pairs.items():
        want += np.bincount(draw_negatives(sampler, table, 23, 0, -1, p, c, np.arange(f)[:, None], np.arange(1, 9)[None, :]).ravel(), minlength=23)
    got = {r.k: r.draws for r in SM.draw_counts(targets, vocab, cfg).collect()}
    assert got == {k: n for k, n in enumerate(want.tolist()) if n}


def test_cells_get_their_block_only(spark):
    vocab, targets, _ = small(spark)
    space = SM.slots(vocab, Config(), blocks=4)
    examples, _, _ = SM.example_table(targets, space, 5)
    rows = SM.deliver(SM.members(examples), space, None, space.rows.withColumn("vec", F.lit(None).cast("binary")), 2)
    per_cell = [r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()]
    assert max(per_cell) <= 6 and space.dtype == "<u4"
