"""Skip-gram with negative sampling as supersteps over blocks.

Centers and output words are cut into B blocks each (B follows from the size of
the model).  An epoch draws every example's negatives once and writes them as
packed arrays per (segment, output block) (:mod:`wordloom.operators.samples`);
then come B supersteps.  In superstep s the centers of block i meet the output
words of block (i + s) mod B, so the pairs of a superstep touch disjoint rows
of both layers and run at the same time without conflicts.

A pair's work is cut into cells of bounded size.  Each cell gets its samples,
its centers' vectors and its output block by a cogroup, and runs the update
order of the original over them: per center, per segment (``Config.batch``
examples of one center; 1 is the original's order), g = α(σ(e) − label) at the
segment's start, w_out[k] −= g·w_in[p], w_in[p] −= Σ g·w_out[k] / contexts of p.
A cell returns the change of its rows; changes are added to the model by one
aggregation, whose partial sums run before the shuffle.  A pair of one cell
is updated exactly in order; a center so frequent that it fills several cells
has their changes added up.

A task holds two blocks and one cell's samples, whatever the size of the model
and of the vocabulary: there is one algorithm, and nothing in it depends on
memory limits or on the session's number of shuffle partitions.

The input layer is unit length at the start and at the end of every epoch, as
in every file that the original writes.  Each epoch is written to
``<dir>/epoch=<n>`` (the checkpoint that also cuts lineage); its samples and
supersteps are dropped then.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import hashing as H
from wordloom.operators import samples as SM
from wordloom.session import delete_path, materialize, path_exists, scratch_path, ship_package

LOG_TS = "%d-%m-%Y %H:%M:%S"
LOSS_CHUNK = 1 << 13


# ------------------------------------------------------------------ numpy side

def hash_u(seed, stream, *keys):
    """Counter-based uniforms in [0, 1) of integer keys (numpy arrays broadcast)."""
    return H.draw_u(H.draw_keys(seed, stream, *keys[:-1]), keys[-1])


def draw_negatives(sampler: str, table: np.ndarray, v: int, seed: int, epoch: int, p, c, tf, ck) -> np.ndarray:
    """Output words of the negatives ``ck`` of examples; ``table`` has every word's last slot + 1 (unigram) or the word of every slot."""
    keys = (epoch + 1, p, c, tf)
    if sampler == "unigram":
        return np.searchsorted(table, SM.draw(sampler, seed, int(table[-1]), v, keys, ck), side="right").astype(np.int64)
    slot = SM.draw(sampler, seed, v, v, keys, ck, table if sampler.endswith("literal") else None)
    return slot if sampler.endswith("literal") else table[slot]


def softplus(x: np.ndarray) -> np.ndarray:
    """−ln σ(−x), stable."""
    return np.maximum(x, 0.0) + np.log1p(np.exp(-np.abs(x)))


def run_cell(w_in, w_out, center, cm, seg, k, positive, alpha: float, exact: bool = False, update: bool = True) -> float:
    """Updates both matrices by the samples (sorted by segment) and returns their loss.

    ``center`` and ``cm`` belong to segments, ``seg``, ``k`` and ``positive`` to
    samples.  A segment's equal words are one row with counts; with ``exact``,
    a segment that repeats a word is run sample by sample.
    """
    if not len(seg):
        return 0.0
    key = seg * len(w_out) + k
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    n = np.diff(np.append(first, len(key))).astype(np.float64)
    pos = np.add.reduceat(positive[order].astype(np.float64), first)
    word, own = k[order][first], seg[order][first]
    e = np.empty(len(word))
    extra = 0.0
    if not update:
        for at in range(0, len(word), LOSS_CHUNK):
            part = slice(at, at + LOSS_CHUNK)
            e[part] = np.einsum("ij,ij->i", w_in[center[own[part]]], w_out[word[part]])
    else:
        edge = np.searchsorted(own, np.arange(len(center) + 1))
        raw = np.searchsorted(seg, np.arange(len(center) + 1)) if exact else None
        step, pull = alpha * n, alpha * pos
        # rows are fetched and put back as one value each, into buffers that all segments share
        most, h = int(np.diff(edge).max()), w_out.shape[1]
        rows, outer, pulls = np.empty((most, h)), np.empty((most, h)), np.empty(most)
        value = np.dtype((np.void, w_out.itemsize * h))
        stored, fetched = w_out.view(value).ravel(), rows.view(value).ravel()
        with np.errstate(over="ignore"):
            for i, (a, b, c, m) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), center.tolist(), cm.tolist())):
                w = w_in[c]
                if exact and b - a < raw[i + 1] - raw[i]:
                    extra += _one_by_one(w_in, w_out, c, w.copy(), m, k[raw[i]:raw[i + 1]], positive[raw[i]:raw[i + 1]], alpha)
                    n[a:b] = pos[a:b] = e[a:b] = 0.0
                    continue
                ks, r, got, g = word[a:b], rows[:b - a], fetched[:b - a], pulls[:b - a]
                stored.take(ks, out=got, mode="clip")
                np.dot(r, w, out=e[a:b])
                np.negative(e[a:b], out=g)
                np.exp(g, out=g)
                g += 1.0
                np.divide(step[a:b], g, out=g)
                g -= pull[a:b]
                change = g @ r
                change /= m
                r -= np.dot(g[:, None], w[None, :], out=outer[:b - a])
                w -= change
                stored[ks] = got
    return float((n * softplus(e) - pos * e).sum()) + extra      # −ln σ(e) = softplus(e) − e


def _one_by_one(w_in, w_out, c, w, cm, ks, positive, alpha) -> float:
    """A segment in which words repeat, sample by sample; returns its loss."""
    delta, loss = np.zeros(len(w)), 0.0
    for k, label in zip(ks, positive):
        x = float(w_out[k] @ w)
        loss += float(softplus(np.array(-x if label else x)))
        g = alpha * (1.0 / (1.0 + np.exp(-x)) - float(label))
        delta += g * w_out[k]
        w_out[k] -= g * w
    w_in[c] = w - delta / cm
    return loss


class PartitionRunner:
    """The original's order over example rows in one process: the definition that cells are tested against.

    Rows: center_idx, context_idx, tf0, nrep, context_max.  Mutates ``w_out``;
    ``in_rows`` maps center → (normalised start, final).
    """

    def __init__(self, w_in, w_out, table, cfg: Config, epoch: int, alpha: float, update: bool = True):
        self.w_in, self.w_out, self.table, self.cfg = w_in, w_out, table, cfg
        self.epoch, self.alpha, self.update = epoch, alpha, update
        self.start = w_in / np.linalg.norm(w_in, axis=1, keepdims=True)
        self.now = self.start.copy()
        self.loss, self.examples, self.centers = 0.0, 0, []

    def feed(self, rows: pd.DataFrame):
        p, c, tf0, nrep, cm = (rows[x].to_numpy(np.int64) for x in ("center_idx", "context_idx", "tf0", "nrep", "context_max"))
        if not len(p):
            return
        row, pp, cc, _, tf, _ = SM.expand(p, c, p, tf0, nrep, tf0)
        neg = draw_negatives(self.cfg.sampler, self.table, len(self.w_out), self.cfg.seed, self.epoch, pp[:, None], cc[:, None], tf[:, None],
                             np.arange(1, self.cfg.samples)[None, :])
        k = np.concatenate([cc[:, None], neg], axis=1)
        positive = np.zeros(k.shape, dtype=bool)
        positive[:, 0] = True
        seg = np.repeat(np.arange(len(pp)), k.shape[1])
        self.loss += run_cell(self.now, self.w_out, pp, cm[row].astype(np.float64), seg, k.ravel(), positive.ravel(), self.alpha, True, self.update)
        self.examples += len(pp)
        self.centers += list(dict.fromkeys(p.tolist()))

    def finish(self):
        return {p: (self.start[p], self.now[p]) for p in self.centers}, self.loss, self.examples


# ------------------------------------------------------------------ Spark side

@dataclass
class TrainState:
    path: str           # <dir>/epoch=<n>
    model_in: DataFrame
    model_out: DataFrame


def load_state(spark, path: str) -> TrainState:
    """A saved epoch: (idx, word, vec) per layer; a layer without rows has no folder."""
    schema = "idx long, word string, vec array<double>"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no model in {path}")
    found = [f"{path}/layer={layer}" for layer in ("in", "out")]
    rows = [spark.read.parquet(p).select("idx", "word", "vec") if path_exists(spark, p) else spark.createDataFrame([], schema) for p in found]
    return TrainState(path, *rows)


def cell_kernel(dtype: str, alpha: float, exact: bool, update: bool):
    """A cell's loss row, and the changes of its rows, as ``SM.STEP``."""
    def table(layer: int, ids: np.ndarray, cell: int, change: np.ndarray) -> pa.Table:
        n = len(ids)
        return pa.table([pa.array(np.full(n, layer, dtype=np.int32)), pa.array(ids), pa.array(np.full(n, -1)), pa.array(np.full(n, -1, dtype=np.int32)),
                         pa.array(np.full(n, cell)), SM.packed_rows(change)], names=SM.STEP_NAMES)

    def fn(samples: pa.Table, rows: pa.Table) -> pa.Table:
        if not samples.num_rows:
            return SM.empty(SM.STEP)
        w_in, w_out, loss, positive = None, None, 0.0, 0
        for c in SM.cell_arrays(samples, rows, dtype):
            if w_in is None:
                w_in, w_out = (c.w_in.copy(), c.w_out.copy()) if update else (c.w_in, c.w_out)
            loss += run_cell(w_in, w_out, c.center, c.cm, c.seg, c.k, c.positive, alpha, exact, update)
            positive += int(c.positive.sum())
        cell = samples["cell"][0].as_py()
        sums = np.zeros((1, max(2, w_out.shape[1])))
        sums[0, :2] = loss, positive
        parts = [table(SM.LOSS, np.array([-1]), cell, sums)]
        for layer, ids, new, old in ((SM.INPUT, c.in_ids, w_in, c.w_in), (SM.OUTPUT, c.out_ids, w_out, c.w_out)) if update else ():
            at = np.flatnonzero((new != old).any(axis=1))
            parts.append(table(layer, ids[at], cell, new[at] - old[at]))
        return pa.concat_tables(parts)
    return fn


def unpacked(rows: DataFrame) -> DataFrame:
    """``(layer, idx, vec)`` of superstep rows, as an epoch is saved: layers in, out and loss, input rows of unit length."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                layer, m = np.asarray(b.column(0)), SM.matrix(pa.chunked_array([b.column(5)])).copy()
                m[layer == SM.INPUT] = SM.unit_rows(m[layer == SM.INPUT])
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.record_batch([pa.array(np.array(["in", "out", "loss"])[layer], pa.string()), b.column(1), vec], names=["layer", "idx", "vec"])

    return rows.mapInArrow(run, "layer string, idx long, vec array<double>")


def cells_loss(examples: DataFrame, cells: tuple[DataFrame, DataFrame], space: SM.Slots, cfg: Config, rnd: int,
               model_in: DataFrame, model_out: DataFrame) -> DataFrame:
    """(examples, loss) of one round's samples at fixed packed weights; only partial losses are shuffled."""
    kernel, schema = cell_kernel(space.dtype, 0.0, False, False), "loss double, n long"

    def fn(samples: pa.Table, rows: pa.Table) -> pa.Table:
        got = SM.matrix(kernel(samples, rows)["vec"])
        return pa.table({"loss": got[:, 0], "n": got[:, 1].astype(np.int64)}) if len(got) else SM.empty(schema)

    samples = SM.sample_table(examples, space, cfg, rnd, 1 << 40)
    got = SM.meet(samples, SM.deliver(cells, space, model_in, model_out, None), fn, schema)
    return got.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("examples"), F.sum("loss").alias("loss"))


def merge_groups(v: int, hidden: int, parts: int, blocks: int, block_bytes: int) -> int:
    """Hash groups of a merge, each of bounded size: both layers' rows and the changes of every cell of a superstep (an output block each, and its centers)."""
    rows = 2 * v + (parts + blocks) * -(-v // max(blocks, 1)) + v
    return max(8, -(-rows * hidden * 8 // block_bytes))


class SGNSTrainer:
    """train(): epochs of supersteps; ``losses`` holds E9 rows.

    ``partitions`` is the least number of parts that the examples are cut into.
    """

    def __init__(self, vocab: DataFrame, targets: DataFrame, cfg: Config = Config(),
                 model_dir: str | None = None, partitions: int | None = None):
        self.spark = vocab.sparkSession
        ship_package(self.spark)
        self.cfg, self.vocab, self.h = cfg, vocab, cfg.hidden
        self.v = vocab.count()
        self.dir = model_dir or scratch_path(self.spark, "model")
        self.space = SM.slots(vocab, cfg, self.v)
        self.examples, self.parts, self.n_examples = SM.example_table(targets, self.space, partitions or cfg.train_partitions or 1)
        self.cells = tuple(materialize(x, self.spark, "cells") for x in SM.members(self.examples))
        self.places, self.n_cells = SM.places(self.examples)        # one row per cell
        self.groups = merge_groups(self.v, self.h, self.parts, self.space.blocks, cfg.block_bytes)
        self.losses: list[dict] = []
        self.log_lines: list[str] = []
        self.init_loss = None

    def init(self) -> TrainState:
        from wordloom.operators.model import init_weights
        mi, mo = init_weights(self.vocab, self.cfg, self.v)
        return self._write(0, mi.select("idx", "word", "vec"), mo.select("idx", "word", "vec"))

    def _write(self, epoch: int, mi: DataFrame, mo: DataFrame) -> TrainState:
        """Both layers of epoch ``epoch`` in one job, as ``<dir>/epoch=<n>/layer=in|out``."""
        path = f"{self.dir}/epoch={epoch}"
        both = mi.select(F.lit("in").alias("layer"), "idx", "word", "vec").unionByName(
            mo.select(F.lit("out").alias("layer"), "idx", "word", "vec"))
        both.write.mode("overwrite").partitionBy("layer").parquet(path)
        return load_state(self.spark, path)

    def _start(self, st: TrainState) -> tuple[DataFrame, DataFrame]:
        """Rows of both layers as the supersteps keep them: unit input rows, output rows with slot and block."""
        return SM.packed(st.model_in.select("idx", "vec"), unit=True), SM.packed(st.model_out.select("idx", "vec").join(self.space.rows, "idx"))

    def loss(self, st: TrainState, epoch: int = -1) -> tuple[float, int]:
        """E6 with the kernel of the cells (no updates): (loss, examples)."""
        r = cells_loss(self.examples, self.cells, self.space, self.cfg, epoch + 1, *self._start(st)).first()
        return float(r["loss"] or 0.0), int(r["examples"] or 0)

    def epoch(self, st: TrainState, epoch: int) -> TrainState:
        """E7 + E10: one epoch, written to ``epoch=<n+1>``."""
        alpha, batch = self.cfg.learning_rate(epoch), self.cfg.batch
        work = f"{self.dir}/work-epoch={epoch}"
        samples = SM.sample_table(self.examples, self.space, self.cfg, epoch + 1, batch)
        samples.write.mode("overwrite").partitionBy("s").parquet(f"{work}/samples")
        drawn = self.spark.read.schema(SM.SAMPLES).parquet(f"{work}/samples")
        kernel = cell_kernel(self.space.dtype, alpha, batch == 1, True)
        mi, mo = self._start(st)
        none, own = F.lit(-1).cast("long"), F.lit(-1).cast("long").alias("src")
        before = mi.select(F.lit(SM.INPUT).alias("layer"), "idx", none.alias("lo"), none.cast("int").alias("blk"), own, "vec").unionByName(
            mo.select(F.lit(SM.OUTPUT).alias("layer"), "idx", "lo", "blk", own, "vec"))
        for s in range(self.space.blocks):
            rows = SM.deliver(self.cells, self.space, before.where(F.col("layer") == SM.INPUT), before.where(F.col("layer") == SM.OUTPUT), s)
            met = [x.join(F.broadcast(self.places.select("cell", F.col("place").alias("place"))), "cell") for x in (drawn.where(F.col("s") == s), rows)]
            changes = SM.meet(*met, kernel, SM.STEP, ("place",), self.n_cells)
            after = SM.merge(before.unionByName(changes), self.groups)
            if s + 1 < self.space.blocks:
                after.write.mode("overwrite").parquet(f"{work}/step={s}")
                before = self.spark.read.schema(SM.STEP).parquet(f"{work}/step={s}")
        path = f"{self.dir}/epoch={epoch + 1}"
        after = unpacked(after).join(self.vocab.select("idx", "word"), "idx", "left")
        after.select("layer", "idx", "word", "vec").write.mode("overwrite").partitionBy("layer").parquet(path)
        delete_path(self.spark, work)
        loss = self.spark.read.parquet(f"{path}/layer=loss").first()["vec"][0] if self.n_examples else 0.0
        self._record(epoch + 1, float(loss))
        return load_state(self.spark, path)

    def _record(self, epoch: int, loss: float):
        pct = 100.0 if self.init_loss in (None, 0) else loss / self.init_loss * 100
        self.losses.append({"epoch": epoch, "loss": loss, "pct": pct})
        ts = time.strftime(LOG_TS, time.gmtime()) + ".%03d" % int((time.time() % 1) * 1000)
        self.log_lines.append(f"[{ts}] INFO: Loss {loss:.6f} ({pct:.1f}%)")

    def train(self, epochs: int | None = None, st: TrainState | None = None) -> TrainState:
        """Initial loss, then ``epochs`` epochs; returns the final state."""
        st = st or self.init()
        self.init_loss, _ = self.loss(st, -1)
        self._record(0, self.init_loss)
        for ep in range(self.cfg.epochs if epochs is None else epochs):
            st = self.epoch(st, ep)
        return st

    def loss_report(self) -> DataFrame:
        """E9 + E5: (model, epoch, alpha, loss, pct); alpha is the rate the epoch trained with."""
        rows = [(self.cfg.sampler, r["epoch"], self.cfg.learning_rate(r["epoch"] - 1) if r["epoch"] > 0 else None,
                 float(r["loss"]), float(r["pct"])) for r in self.losses]
        return self.spark.createDataFrame(rows, "model string, epoch int, alpha double, loss double, pct double")


def render_loss_log(rows: DataFrame, model_col: str = "model") -> DataFrame:
    """E9 as text: (model, line_no, line) of (model, epoch, ts, loss); the percentage is of the model's first loss."""
    from pyspark.sql import Window
    first = F.first("loss").over(Window.partitionBy(model_col).orderBy("epoch"))
    ts = F.date_format("ts", "dd-MM-yyyy HH:mm:ss.SSS")
    line = F.format_string("[%s] INFO: Loss %.6f (%.1f%%)", ts, F.col("loss"), F.col("loss") / first * 100.0)
    return rows.select(model_col, F.col("epoch").alias("line_no"), line.alias("line"))


def compare_models(parsed: DataFrame, models: list[str], model_col: str = "model") -> DataFrame:
    """The percentages of several models side by side: (epoch, one column per model)."""
    return parsed.groupBy("epoch").pivot(model_col, models).agg(F.first("pct"))


def parse_loss_log(lines: DataFrame, col: str = "line", model_col: str | None = None) -> DataFrame:
    """Per log line, the last ``\\d+.\\d+`` match is the percent; epoch = line number."""
    from pyspark.sql import Window
    m = F.element_at(F.regexp_extract_all(F.col(col), F.lit(r"(\d+.\d+)"), 1), -1).cast("double")
    loss = F.regexp_extract(F.col(col), r"Loss (\d+\.\d+)", 1).cast("double")
    keys = [model_col] if model_col else []
    w = Window.partitionBy(*keys).orderBy("line_no") if keys else Window.orderBy("line_no")
    out = lines.withColumn("pct", m).withColumn("loss", loss).withColumn(
        "epoch", (F.row_number().over(w) - 1).cast("int"))
    return out.select(*keys, "epoch", "loss", "pct")
