"""Negative draws as arrays, dealt to blocks of output words.

A sampler turns a uniform into a slot, and a slot belongs to one output word:
the words own disjoint slot ranges ``[lo, hi)``.  :class:`Slots` cuts the words,
in slot order, into blocks of equal count.  A task that draws needs only the
blocks' bounds (one number per block); the word of a slot is found where the
block's words are, so no task holds the whole table.

:func:`example_table` numbers all training examples (center, context,
repetition) once; :func:`sample_table` draws their negatives and yields one row
per (segment, output block): a segment is a run of ``batch`` examples of one
center, and its samples are a packed array, positives first.  No draw is a row.

The draws are those of :mod:`wordloom.functions.hashing`: they depend on
(seed, round, center, context, repetition, sample) alone, so a retried task
draws the same numbers.

The two literal samplers map slots to words through an array of one number per
word that every drawing task holds; they exist to reproduce published runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import hashing as H
from wordloom.session import materialize, place_keys, ship_package

REP_CHUNK = 64               # repetitions of one target per example row
WORK_PER_PART = 1 << 17      # examples per cell, at least
SLICE = 1 << 15              # examples a task expands at once
DRAWN = 1 << 11              # examples whose negatives are drawn at once
FEW_BLOCKS = 16              # blocks up to which a slot's block is found by comparisons
AT_ONCE = 1 << 19            # samples of a cell that are unpacked at once, more only in one row
LITERAL_LIMIT = 1 << 26      # words up to which the literal samplers' array may be held by every task


# ---------------------------------------------------------------- slots

@dataclass
class Slots:
    """A sampler's slot space: ``rows`` is (idx, lo, blk) per output word, ``bounds[j]`` block j's first slot."""

    rows: DataFrame
    bounds: np.ndarray
    sampler: str
    total: int               # unigram: number of slots
    v: int
    table: object = None     # literal samplers: broadcast of slot → word

    @property
    def blocks(self) -> int:
        return len(self.bounds)

    @property
    def dtype(self) -> str:
        """Type that holds a slot's distance from its block's first slot."""
        ends = np.append(self.bounds[1:], max(self.total, self.v))
        return "<u4" if int((ends - self.bounds).max(initial=0)) < 1 << 32 else "<i8"


def block_count(v: int, cfg: Config) -> int:
    """Blocks per layer: follows from the size of the model alone."""
    wanted = cfg.blocks or max(4, math.ceil(v * cfg.hidden * 8 / cfg.block_bytes))
    return max(1, min(wanted, v))


def slots(vocab: DataFrame, cfg: Config, v: int | None = None, blocks: int | None = None) -> Slots:
    """The slot space of ``cfg.sampler`` over ``vocab``."""
    from wordloom.operators import sampling as SP
    spark = vocab.sparkSession
    v = vocab.count() if v is None else v
    n = blocks or block_count(v, cfg)
    total, table = v, None
    if cfg.sampler == "unigram":
        t = SP.unigram_table(vocab)
        rows = t.select("idx", "lo", F.col("idx").alias("pos"))
        total = int(vocab.agg(F.sum("freq")).first()[0] or 0)
    elif cfg.sampler == "tdnd":
        rows = SP.center_out_reorder(vocab).select("idx", F.col("slot").alias("lo"), F.col("slot").alias("pos"))
    else:
        if v > LITERAL_LIMIT:
            raise ValueError(f"{cfg.sampler} keeps an array of all words in every task; {v} words are more than {LITERAL_LIMIT}")
        rows = vocab.select("idx", F.col("idx").alias("lo"), F.col("idx").alias("pos"))
        table = spark.sparkContext.broadcast(literal_table(vocab, cfg, v))
    rows = rows.select("idx", "lo", F.floor(F.col("pos") * n / F.lit(max(v, 1))).cast("int").alias("blk"))
    rows = materialize(rows, spark, "slots")
    bounds = [r["lo"] for r in rows.groupBy("blk").agg(F.min("lo").alias("lo")).orderBy("blk").collect()]
    return Slots(rows, np.array(bounds or [0], dtype=np.int64), cfg.sampler, total, v, table)


def literal_table(vocab: DataFrame, cfg: Config, v: int) -> np.ndarray:
    """Slot → word of the literal samplers."""
    from wordloom.operators import sampling as SP
    if cfg.sampler == "unigram_literal":
        t = SP.unigram_literal_table(vocab, v).select("slot", "k")
    else:
        mx = vocab.agg(F.max("freq")).first()[0] or 0
        if mx >= v:
            raise ValueError(f"tdnd_literal: max freq {mx} is not a valid index (V={v})")
        t = SP.center_out_reorder(vocab).select("slot", F.col("freq").alias("k"))
    got = t.toArrow()
    out = np.zeros(v, dtype=np.int64)
    out[np.asarray(got["slot"])] = np.asarray(got["k"])
    return out


def tdnd_values(seed: int, v: int, keys: tuple, number) -> np.ndarray:
    """round((1 + y / 4) / 2 · (v − 1)), y standard normal, halves away from zero."""
    u1 = H.draw_u_open0(H.draw_keys(seed, H.STREAMS["tdnd1"], *keys), number)
    u2 = H.draw_u(H.draw_keys(seed, H.STREAMS["tdnd2"], *keys), number)
    y = np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * math.pi * u2)
    x = 0.0 + (1.0 + y * 0.25) * 0.5 * float(v - 1)
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def draw(sampler: str, seed: int, total: int, v: int, keys: tuple, number, table: np.ndarray | None = None) -> np.ndarray:
    """Slots of the draws ``number`` of ``keys`` (round, center, context, repetition); words, for the literal samplers."""
    if sampler in ("unigram", "unigram_literal"):
        span = total if sampler == "unigram" else v - 1
        slot = np.floor(H.draw_u(H.draw_keys(seed, H.STREAMS["unigram"], *keys), number) * span).astype(np.int64)
    else:
        raw = tdnd_values(seed, v, keys, number)
        slot = raw.astype(np.int64)
        out = (raw < 0) | (raw > v - 1)
        if out.any():       # only these are drawn again
            lanes = tuple(np.broadcast_to(lane, out.shape)[out] for lane in H.draw_keys(seed, H.STREAMS["tdnd3"], *keys))
            slot[out] = np.floor(H.draw_u(lanes, np.broadcast_to(number, out.shape)[out]) * float(v - 1) + 0.0)
    return table[slot] if sampler.endswith("literal") else slot


# ---------------------------------------------------------------- examples

def example_table(targets: DataFrame, space: Slots, partitions: int = 1, work_per_part: int | None = None) -> tuple[DataFrame, int, int]:
    """All examples as rows ``center_idx, context_idx, x, tf0, nrep, context_max, w0, cblk, cell``; (table, parts, examples).

    Centers are dealt to as many blocks as there are output blocks.  In the order
    (center block, center, context, repetition) the examples are numbered, row
    by row, from ``w0`` on, and cut into parts of equal work; a cell is what a
    part has of a center block.  A center with many contexts spans several
    cells.  ``x`` is the context's first slot.  The split follows from the
    examples and the vocabulary alone.
    """
    from wordloom.operators.ranking import dense_index, prefix_sum
    work = work_per_part or max(WORK_PER_PART, 8 * space.v)
    n = space.blocks
    # read by the degrees and twice by the sort: written once
    targets = materialize(targets.select("center_idx", "context_idx", "freq"), targets.sparkSession, "targets")
    degree = targets.groupBy("center_idx").agg(F.count(F.lit(1)).alias("context_max"))
    t = targets.join(degree, "center_idx")
    t = t.join(space.rows.select(F.col("idx").alias("context_idx"), F.col("lo").alias("x")), "context_idx")
    chunks = F.sequence(F.lit(0), F.floor((F.col("freq") - 1) / REP_CHUNK).cast("int"))
    t = t.select("center_idx", "context_idx", "x", "freq", "context_max", F.explode(chunks).alias("c"))
    t = t.select("center_idx", "context_idx", "x", (F.col("c") * REP_CHUNK).cast("bigint").alias("tf0"),
                 F.least(F.lit(REP_CHUNK), F.col("freq") - F.col("c") * REP_CHUNK).cast("bigint").alias("nrep"),
                 F.col("context_max").cast("bigint").alias("context_max"), (F.col("center_idx") % n).cast("int").alias("cblk"))
    ranked = dense_index(t, [F.col("cblk"), F.col("center_idx"), F.col("context_idx"), F.col("tf0")], "r")
    counted = prefix_sum(ranked, "r", "nrep", "w0")
    total = int(ranked.agg(F.sum("nrep")).first()[0] or 0)
    parts = max(partitions, math.ceil(total / work), 1)
    part = F.floor(F.col("w0") * F.lit(parts) / F.lit(max(total, 1)))
    out = counted.withColumn("cell", (part * n + F.col("cblk")).cast("bigint")).drop("r")
    return materialize(out, targets.sparkSession, "examples"), parts, total


SAMPLES = "s int, cell long, center long, seg long, cm double, n_pos int, x binary"


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binary values ``values[first[i]:first[i + 1]]`` without copying them one by one."""
    offsets = (first * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def expand(center, context, x, tf0, nrep, w0):
    """Row number, center, context, slot, repetition and example number of every example of some rows."""
    row = np.repeat(np.arange(len(nrep)), nrep)
    rep = np.arange(len(row)) - np.repeat(np.cumsum(nrep) - nrep, nrep)
    return row, center[row], context[row], x[row], tf0[row] + rep, w0[row] + rep


def block_numbers(bounds: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The block of each slot."""
    if len(bounds) > FEW_BLOCKS:
        return np.searchsorted(bounds, slot, side="right") - 1
    blk = np.zeros(slot.shape, dtype=np.int64)
    for first in bounds[1:]:
        blk += slot >= first
    return blk


def in_order(group: np.ndarray, far: np.ndarray, by_slot: bool, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Samples by group, those of a group by ``far`` (their distance from the block's first slot) if ``by_slot``, else as they come."""
    if not by_slot:
        order = np.argsort(group, kind="stable")
    elif kind.itemsize == 4 and group.max(initial=0) < 1 << 31:       # one number holds both
        both = np.sort((group << 32) | far)
        return both >> 32, (both & H.MASK32).astype(kind)
    else:
        order = np.lexsort((far, group))
    return group[order], far[order].astype(kind)


def sample_table(examples: DataFrame, space: Slots, cfg: Config, rnd: int, batch: int) -> DataFrame:
    """One row per (cell, center, segment, output block) with the block's samples of the segment.

    ``x`` packs the samples' distances from the block's first slot, positives
    first, both kinds ascending (in the order drawn if ``batch`` is 1); ``s`` is
    the superstep in which the cell meets the block.
    """
    ship_package(examples.sparkSession)
    bounds, n, ns, kind = space.bounds, space.blocks, cfg.samples, np.dtype(space.dtype)
    sampler, total, v, table, seed = space.sampler, space.total, space.v, space.table, cfg.seed

    def made(rows: dict) -> pa.RecordBatch:
        row, p, c, x, tf, number = expand(*(rows[k] for k in ("center_idx", "context_idx", "x", "tf0", "nrep", "w0")))
        seg, cell = number // batch, rows["cell"][row]
        numbers = np.arange(1, ns)[None, :]
        slot = np.empty((len(row), ns), dtype=np.int64)
        slot[:, 0] = x
        for at in range(0, len(row), DRAWN):
            part = slice(at, at + DRAWN)
            slot[part, 1:] = draw(sampler, seed, total, v, (rnd, p[part, None], c[part, None], tf[part, None]), numbers,
                                  table.value if table is not None else None)
        blk = block_numbers(bounds, slot)
        fresh = np.append(True, (cell[1:] != cell[:-1]) | (p[1:] != p[:-1]) | (seg[1:] != seg[:-1]))[:len(row)]
        run = np.cumsum(fresh) - 1
        group = (run[:, None] * n + blk) * 2 + (np.arange(ns) > 0)
        group, far = in_order(group.ravel(), (slot - bounds[blk]).ravel(), batch > 1, kind)
        negative, group = group & 1, group >> 1
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)])
        n_pos = np.add.reduceat(negative == 0, first, dtype=np.int32)
        head = np.flatnonzero(fresh)[group[first] // n]
        src = row[head]
        columns = [((group[first] % n - rows["cblk"][src]) % n).astype(np.int32), rows["cell"][src], p[head], seg[head],
                   rows["context_max"][src].astype(np.float64), n_pos]
        return pa.record_batch([*(pa.array(a) for a in columns), _packed(far, np.append(first, len(far)))],
                               names=["s", "cell", "center", "seg", "cm", "n_pos", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {name: np.asarray(b.column(i)).astype(np.int64) for i, name in enumerate(b.schema.names)}
            work = np.cumsum(rows["nrep"])
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + SLICE, side="right")))
                yield made({k: a[at:end] for k, a in rows.items()})
                at = end

    cols = ["center_idx", "context_idx", "x", "tf0", "nrep", "context_max", "w0", "cblk", "cell"]
    return examples.select(*cols).mapInArrow(run, SAMPLES)


# ---------------------------------------------------------------- meeting the rows

#: rows that supersteps keep and change: layer (0 input, 1 output, 2 the loss: its vector starts with loss and examples),
#: the output word's first slot and block (-1 elsewhere), and the cell that a change comes from (-1: the row itself)
INPUT, OUTPUT, LOSS = 0, 1, 2
STEP = "layer int, idx long, lo long, blk int, src long, vec binary"
STEP_NAMES = ["layer", "idx", "lo", "blk", "src", "vec"]

def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; a zero row has no direction and stays."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def packed(model: DataFrame, unit: bool = False) -> DataFrame:
    """A model table with ``vec`` as the bytes of its doubles: one value per row for shuffles, files and Arrow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = b.schema.get_field_index("vec")
                m = np.asarray(b.column(at).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                yield b.set_column(at, "vec", packed_rows(unit_rows(m) if unit else m))

    ship_package(model.sparkSession)
    schema = ", ".join(f"{c} {t if c != 'vec' else 'binary'}" for c, t in model.dtypes)
    return model.mapInArrow(run, schema)


def matrix(vecs: pa.ChunkedArray) -> np.ndarray:
    """The vectors of packed rows, one row each."""
    vecs = vecs.combine_chunks()
    if not len(vecs):
        return np.zeros((0, 0))
    _, offs, data = vecs.buffers()
    first = np.frombuffer(offs, dtype=np.int32)[vecs.offset:vecs.offset + len(vecs) + 1]
    return np.frombuffer(data, dtype=np.uint8)[first[0]:first[-1]].view(np.float64).reshape(len(vecs), -1)


def packed_rows(m: np.ndarray) -> pa.Array:
    """Inverse of :func:`matrix`."""
    return _packed(m.ravel(), np.arange(len(m) + 1) * (m.shape[1] if len(m) else 0))


def members(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells with their center blocks (cell, cblk), and the cells' centers (cell, idx)."""
    return examples.select("cell", "cblk").distinct(), examples.select("cell", F.col("center_idx").alias("idx")).distinct()


def deliver(cells: tuple[DataFrame, DataFrame], space: Slots, model_in: DataFrame | None, model_out: DataFrame, s: int | None) -> DataFrame:
    """``(s, cell, layer, idx, lo, vec)``: the rows that the cells (:func:`members`) need in superstep ``s`` (None: in all).

    A cell gets the vectors of its own centers (``model_in``: idx, vec) and the
    whole output block that it meets (``model_out``: idx, lo, blk, vec).
    """
    n = space.blocks
    steps = F.lit(s).cast("int") if s is not None else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks, own = cells
    blocks = blocks.select("cell", "cblk", steps.alias("s")).select("s", "cell", ((F.col("cblk") + F.col("s")) % n).cast("int").alias("blk"))
    rows = model_out.join(blocks, "blk").select("s", "cell", F.lit(OUTPUT).alias("layer"), "idx", "lo", "vec")
    if model_in is None:
        return rows
    # steps multiply the joined rows, not a side that a join may send to the driver by the size of its files
    own = model_in.join(own, "idx").select("cell", "idx", "vec", steps.alias("s"))
    return rows.unionByName(own.select("s", "cell", F.lit(INPUT).alias("layer"), "idx", F.lit(None).cast("long").alias("lo"), "vec"))


@dataclass
class Cell:
    """A cell's samples against its rows, as arrays: sorted by segment, output words as local row numbers."""

    in_ids: np.ndarray
    out_ids: np.ndarray
    w_in: np.ndarray | None
    w_out: np.ndarray | None
    center: np.ndarray       # per segment: row of w_in
    cm: np.ndarray           # per segment: contexts of the center
    seg: np.ndarray          # per sample: segment
    k: np.ndarray            # per sample: row of w_out
    positive: np.ndarray     # per sample


def cell_arrays(samples: pa.Table, rows: pa.Table, dtype: str, with_in: bool = True, at_once: int | None = None) -> Iterator[Cell]:
    """A cell in stretches of whole segments, in order: its samples stay packed but for about ``at_once`` of them.

    All stretches share ``w_in`` and ``w_out``; segments are numbered from 0 in each.
    """
    most = at_once or AT_ONCE
    idx = np.asarray(rows["idx"].combine_chunks()).astype(np.int64)
    vectors = matrix(rows["vec"]) if with_in else None
    layer = np.asarray(rows["layer"].combine_chunks())
    own, out = np.flatnonzero(layer == INPUT), np.flatnonzero(layer == OUTPUT)
    own = own[np.argsort(idx[own], kind="stable")]
    lo = np.asarray(rows["lo"].combine_chunks().take(pa.array(out))).astype(np.int64)
    order = np.argsort(lo, kind="stable")
    out, lo = out[order], lo[order] - lo.min(initial=1 << 62)
    in_ids, out_ids = idx[own], idx[out]
    w_in, w_out = (vectors[own], vectors[out]) if with_in else (None, None)
    center, seg, n_pos = (np.asarray(samples[c].combine_chunks()) for c in ("center", "seg", "n_pos"))
    order = np.lexsort((seg, center))
    samples = samples.take(pa.array(order)).combine_chunks()
    center, seg, n_pos = center[order], seg[order], n_pos[order]
    cm = np.asarray(samples["cm"].combine_chunks())
    x = samples["x"].combine_chunks()
    _, offs, data = x.buffers()
    offsets = np.frombuffer(offs, dtype=np.int32)[x.offset:x.offset + len(x) + 1] // np.dtype(dtype).itemsize
    packed = np.frombuffer(data, dtype=dtype)[:offsets[-1]]
    fresh = np.append(True, (center[1:] != center[:-1]) | (seg[1:] != seg[:-1]))
    starts = np.append(np.flatnonzero(fresh), len(x))       # a segment may come as several rows
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(offsets[starts], offsets[starts[a]] + most, side="right")) - 1)
        part = slice(starts[a], starts[b])
        size = np.diff(offsets[starts[a]:starts[b] + 1])
        values = packed[offsets[starts[a]]:offsets[starts[b]]].astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(values)) - np.repeat(offsets[part] - offsets[starts[a]], size)
        first = fresh[part]
        head = center[part][first]
        yield Cell(in_ids, out_ids, w_in, w_out, np.searchsorted(in_ids, head) if with_in else head, cm[part][first],
                   (np.cumsum(first) - 1)[row], np.searchsorted(lo, values, side="right") - 1, place < n_pos[part][row])
        a = b


def add_up(table: pa.Table) -> pa.Table:
    """Rows ``STEP`` of equal (layer, idx) as one: vectors, losses and counts added in the order of ``src``."""
    if not table.num_rows:
        return table
    layer, idx, src = (np.asarray(table[c].combine_chunks()) for c in ("layer", "idx", "src"))
    order = np.lexsort((src, idx, layer))
    layer, idx = layer[order], idx[order]
    first = np.flatnonzero(np.append(True, (layer[1:] != layer[:-1]) | (idx[1:] != idx[:-1])))
    vec = np.add.reduceat(matrix(table["vec"])[order], first, axis=0)
    known = {c: np.asarray(table[c].combine_chunks().fill_null(-1))[order] for c in ("lo", "blk")}
    place = [pa.array(np.maximum.reduceat(known[c], first), table.schema.field(c).type) for c in ("lo", "blk")]
    return pa.table([pa.array(layer[first], pa.int32()), pa.array(idx[first]), *place, pa.array(src[order][first]), packed_rows(vec)], names=STEP_NAMES)


def merge(rows: DataFrame, groups: int) -> DataFrame:
    """All rows of a layer's word added up: first within each task, then by hash group."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from add_up(pa.Table.from_batches([b])).to_batches()

    by = F.pmod(F.xxhash64("layer", "idx"), F.lit(groups)).alias("g")
    part = rows.mapInArrow(partial, STEP)
    return part.groupBy(by).applyInArrow(lambda t: add_up(t.select(STEP_NAMES)), STEP)


def places(examples: DataFrame) -> tuple[DataFrame, int]:
    """(cell, place) and the number of cells: dealt by ``place`` to so many partitions, each cell has one of its own, the largest first.

    Tasks start in the order of their partitions, so that no large cell is left for the end.
    """
    spark = examples.sparkSession
    cells = [r["cell"] for r in examples.groupBy("cell").agg(F.sum("nrep").alias("n")).orderBy(F.col("n").desc(), "cell").collect()]
    return spark.createDataFrame(list(zip(cells, place_keys(spark, len(cells)))), "cell long, place long"), len(cells)


def meet(samples: DataFrame, rows: DataFrame, fn, schema: str, keys: tuple[str, ...] = ("s", "cell"), cells: int = 0) -> DataFrame:
    """``fn(samples, rows)`` per cell (and superstep), both as Arrow tables; cells without samples give nothing.

    With the number of ``cells``, both sides are dealt to as many partitions:
    cells are large, and a task with two of them would hold up the superstep
    (:func:`places` gives a key that keeps them apart).
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right)

    if cells:
        samples, rows = samples.repartition(cells, *keys), rows.repartition(cells, *keys)
    return samples.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, schema)


def empty(schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.table({n: pa.array([], kinds[t]) for n, t in zip(names, types)})


# ---------------------------------------------------------------- queries over draws

def draw_counts(targets: DataFrame, vocab: DataFrame, cfg: Config = Config(), rnd: int = 0) -> DataFrame:
    """``(k, draws)``, how often one round's negatives hit each word (words that are hit at all)."""
    space = slots(vocab, cfg)
    examples, _, _ = example_table(targets, space)
    samples = sample_table(examples, space, cfg, rnd, 1 << 40)
    rows = deliver(members(examples), space, None, space.rows.withColumn("vec", F.lit(None).cast("binary")), None)
    schema, dtype = "k long, draws long", space.dtype

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty(schema)
        n = 0
        for c in cell_arrays(left, right, dtype, with_in=False):
            n = n + np.bincount(c.k[~c.positive], minlength=len(c.out_ids))
        at = np.flatnonzero(n)
        return pa.table({"k": c.out_ids[at], "draws": n[at].astype(np.int64)})

    return meet(samples, rows, fn, schema).groupBy("k").agg(F.sum("draws").alias("draws"))


def tdnd_value_counts(targets: DataFrame, vocab: DataFrame, cfg: Config = Config(), rnd: int = 0) -> DataFrame:
    """``(value, draws)`` of the raw truncated-normal draws, before those outside the range are redrawn."""
    ship_package(targets.sparkSession)
    v, seed, ns = vocab.count(), cfg.seed, cfg.samples
    chunks = F.sequence(F.lit(0), F.floor((F.col("freq") - 1) / REP_CHUNK).cast("int"))
    rows = targets.select("center_idx", "context_idx", "freq", F.explode(chunks).alias("c")).select(
        "center_idx", "context_idx", (F.col("c") * REP_CHUNK).cast("bigint").alias("tf0"),
        F.least(F.lit(REP_CHUNK), F.col("freq") - F.col("c") * REP_CHUNK).cast("bigint").alias("nrep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, c, tf0, nrep = (np.asarray(x).astype(np.int64) for x in b.columns)
            for at in range(0, b.num_rows, SLICE // REP_CHUNK):
                part = slice(at, at + SLICE // REP_CHUNK)
                _, pp, cc, _, tf, _ = expand(p[part], c[part], p[part], tf0[part], nrep[part], tf0[part])
                value, n = np.unique(tdnd_values(seed, v, (rnd, pp[:, None], cc[:, None], tf[:, None]), np.arange(1, ns)[None, :]), return_counts=True)
                yield pa.record_batch([pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], names=["value", "draws"])

    return rows.mapInArrow(run, "value long, draws long").groupBy("value").agg(F.sum("draws").alias("draws"))
