"""Removal of repeated passages by prefix-partitioned sparse suffix trees.

Every run of ``n`` words (a window) that also starts anywhere else, in the same
document or another, is a repeat; the words it covers are removed.  A window is
a path of depth ``n`` in the suffix tree of the collection, and it repeats if
that path ends in or above an internal node.

* **Sparse suffixes.**  Only anchors are indexed: of the ``n - k + 1`` runs of
  ``k`` words inside a window the one with the least hash.  Equal windows have
  equal anchors at equal offsets, so it is enough to compare windows that share
  an anchor, and an anchor owns a run of neighbouring windows.  About one word
  in thirteen is an anchor.
* **Variable-length prefixes.**  Suffixes are grouped by the anchor's prefix of
  ``k`` words.  Prefixes that occur once hold no internal node and are dropped
  before any text moves.  Groups of up to ``group`` suffixes fit in memory, and
  their suffixes travel with the words of their windows.  For larger groups
  (passages with very many copies) the prefix is lengthened to the window's
  whole ``n`` words: those are the deep nodes themselves, counted by combining
  aggregations, so that no group is ever gathered.
* **Subtrees.**  A task refines its groups level by level (``2 k`` words, then
  ``n``), dropping suffixes that are alone at a level; what is left at depth
  ``n`` lies below deep internal nodes.  Neighbouring deep windows of a document
  chain into its maximal repeats.

Words are compared by 64-bit hashes, inside groups that share a 64-bit prefix hash.

Every row has a key of its own, ``id`` below, by which its text is joined; the
table's ids are only put out.

Defined cases: null, empty and wordless texts have no words; texts with fewer
than ``n`` words have no windows and stay whole; repeated rows are copies of
each other, so their windows repeat; rows that repeat an id, or have none, are
documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.arrays import Words, mix, pieces, signed
from wordloom.llm.frames import arrow_map, materialize, split_join, texts, with_row
from wordloom.session import ship_package

WINDOW = 35
PREFIX = 10
GROUP = 4096
_PLACE_BITS = np.uint64(24)


def _prefix_hashes(w: Words, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each word on; the greatest value where a row has no ``k`` words left."""
    out = np.full(len(w), np.iinfo(np.uint64).max, dtype=np.uint64)
    at, h = w.windows(k)
    out[at] = h
    return out


def anchors(w: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash, anchor word, first owned window, number of owned windows) of every anchor of a piece."""
    starts, _ = w.windows(n)
    prefix = _prefix_hashes(w, k)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return prefix[:0], none, none, none
    # least of n - k + 1 neighbours, by minima over powers of two; the word number breaks ties
    key = (prefix >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(prefix), dtype=np.uint64)
    span, least = 1, key
    while 2 * span <= n - k + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = n - k + 1 - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least[starts] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(starts) != 1)]))
    return prefix[at[new]], at[new], starts[new], np.diff(np.append(new, len(at)))


def _anchor_rows(docs: DataFrame, n: int, k: int) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [[], [], [], [], []]
        ids = np.asarray(batch.column(0))
        for p in pieces(batch.column(1)):
            w = Words(p)
            prefix, at, first, windows = anchors(w, n, k)
            row = w.row[at] if len(at) else at
            context = mix(w.range_hash(first, first + windows + n - 1) + (at - first).astype(np.uint64)) ^ mix(row.astype(np.uint64))
            once = np.sort(np.unique(context, return_index=True)[1])  # what a document repeats itself shows in the last pass
            prefix, at, first, windows, row = (x[once] for x in (prefix, at, first, windows, row))
            base = w.first[:-1][row] if len(at) else at
            for have, more in zip(own, (signed(prefix), ids[p.lo + row], first - base, at - first, windows)):
                have.append(more)
        own = [np.concatenate(x) for x in own]
        return pa.record_batch([pa.array(own[0]), pa.array(own[1]), *(pa.array(x.astype(np.int32)) for x in own[2:])],
                               names=["prefix", "id", "first", "reach", "windows"])

    return arrow_map(docs, fn, "prefix long, id long, first int, reach int, windows int")


def _with_text(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``(id, text, marks)``: the texts of the documents that have rows in ``shared``."""
    marks = shared.groupBy("id").agg(F.collect_set(F.struct("prefix", "first", "reach", "windows")).alias("marks"))
    return docs.join(marks, "id")


def _marks(batch: pa.RecordBatch, w: Words, p, k: int):
    """The marks of a piece's rows that its texts bear out: (row, prefix, first word in the piece, anchor, windows)."""
    marks = batch.column(2)[p.lo:p.hi]
    flat = marks.flatten()
    row = np.repeat(np.arange(p.rows), np.asarray(marks.value_lengths()))
    prefix, first, reach, windows = (np.asarray(flat.field(i)) for i in range(4))
    first = w.first[:-1][row] + first
    at = first + reach
    fits = at + k <= w.first[1:][row]
    own = _prefix_hashes(w, k)
    good = np.flatnonzero(fits)
    good = good[signed(own[at[good]]) == prefix[good]]
    return row[good], prefix[good], first[good], at[good], windows[good].astype(np.int64)


def _suffix_rows(docs: DataFrame, shared: DataFrame, n: int, k: int) -> DataFrame:
    """``(prefix, id, first, words)``: the shared suffixes with the words of their windows."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [[], [], [], []]
        ids = np.asarray(batch.column(0))
        for p in pieces(batch.column(1)):
            w = Words(p)
            row, prefix, first, _, windows = _marks(batch, w, p, k)
            last = np.minimum(first + windows + n - 1, w.first[1:][row])
            cols[0].append(prefix)
            cols[1].append(ids[p.lo + row])
            cols[2].append((first - w.first[:-1][row]).astype(np.int32))
            data = w.data.tobytes()
            cols[3] += [b" ".join(data[a:b].split()) for a, b in zip(w.start[first].tolist(), w.end[last - 1].tolist())]
        return pa.record_batch([*(pa.array(np.concatenate(c)) for c in cols[:3]), pa.array(cols[3], pa.binary()).cast(pa.string())],
                               names=["prefix", "id", "first", "words"])

    return arrow_map(_with_text(docs, shared), fn, "prefix long, id long, first int, words string")


def _long_prefixes(docs: DataFrame, shared: DataFrame, n: int, k: int) -> DataFrame:
    """``(id, first, last)``: word ranges of the repeats in groups too large to gather.

    Suffixes whose windows have the same words are one context, counted by a
    combining aggregation; only contexts are taken apart into windows.
    """
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [[], [], [], [], []]
        ids = np.asarray(batch.column(0))
        for p in pieces(batch.column(1)):
            w = Words(p)
            row, _, first, at, windows = _marks(batch, w, p, k)
            windows = np.minimum(windows, w.first[1:][row] - n + 1 - first)
            start = np.repeat(first - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
            cols[0].append(signed(mix(w.range_hash(first, first + windows + n - 1) + (at - first).astype(np.uint64))))
            cols[1].append(ids[p.lo + row])
            cols[2].append((first - w.first[:-1][row]).astype(np.int32))
            cols[3].append(signed(w.range_hash(start, start + n)))
            cols[4].append(windows)
        context, own, first, node, windows = (np.concatenate(c) for c in cols)
        nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(windows)]).astype(np.int32)), pa.array(node))
        return pa.record_batch([pa.array(context), pa.array(own), pa.array(first), nodes], names=["context", "id", "first", "nodes"])

    rows = arrow_map(_with_text(docs, shared), fn, "context long, id long, first int, nodes array<long>")
    windows = rows.groupBy("context").agg(F.count(F.lit(1)).alias("size"), F.any_value("nodes").alias("nodes")) \
        .select("context", "size", F.posexplode("nodes").alias("j", "node"))
    deep = windows.groupBy("node").agg(F.sum("size").alias("size")).where("size > 1").select("node")
    found = split_join(windows, deep, "node").groupBy("context").agg(F.sort_array(F.collect_set("j")).alias("js"))
    whole = F.size("js") == F.element_at("js", -1) - F.element_at("js", 1) + 1
    spans = F.when(whole, F.array(F.struct(F.element_at("js", 1).alias("j"), F.element_at("js", -1).alias("to")))) \
        .otherwise(F.transform("js", lambda j: F.struct(j.alias("j"), j.alias("to"))))
    spread = split_join(rows.select("context", "id", "first"), found.select("context", spans.alias("spans")), "context")
    return spread.select("id", "first", F.inline("spans")).select("id", (F.col("first") + F.col("j")).alias("first"),
                                                                  (F.col("first") + F.col("to") + n).alias("last"))


def subtree(prefix: np.ndarray, words: pa.Array, n: int, k: int) -> list[tuple[int, int, int]]:
    """Repeats of complete groups: (row, first window, windows) for each run of deep windows of a row."""
    out, nodes = [], []
    for p in pieces(words):
        w = Words(p)
        starts, _ = w.windows(n)
        nodes.append((p.lo + w.row[starts] if len(starts) else starts, starts - w.first[:-1][w.row[starts]] if len(starts) else starts,
                      [w.range_hash(starts, starts + d) for d in (min(2 * k, n), n)]))
    row = np.concatenate([x[0] for x in nodes])
    place = np.concatenate([x[1] for x in nodes])
    live = np.arange(len(row))
    for level in range(2):
        h = np.concatenate([x[2][level] for x in nodes])[live]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        many = np.zeros(len(h), dtype=bool)
        many[order[1:]] |= same
        many[order[:-1]] |= same
        live = live[many]
    row, place = row[live], place[live]
    if len(row):
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]))
        out = list(zip(row[new].tolist(), place[new].tolist(), np.diff(np.append(new, len(row))).tolist()))
    return out


def _repeats_in_groups(suffixes: DataFrame, n: int, k: int) -> DataFrame:
    """``(id, first, last)``: word ranges of the repeats found in groups that share a prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            if table.num_rows < 2:
                return
            ids, first = np.asarray(table["id"]), np.asarray(table["first"])
            found = subtree(np.asarray(table["prefix"]), table["words"].combine_chunks(), n, k)
            if found:
                row, place, windows = (np.array(x, dtype=np.int64) for x in zip(*found))
                lo = first[row] + place
                yield pa.record_batch([pa.array(ids[row]), pa.array(lo.astype(np.int32)), pa.array((lo + windows - 1 + n).astype(np.int32))],
                                      names=["id", "first", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = np.asarray(batch.column(0))
            cut = int(np.searchsorted(prefix, prefix[-1]))      # the last group may go on in the next batch
            if cut or (rest and rest[-1].column(0)[-1].as_py() != prefix[0]):
                yield from solve(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield from solve(pa.Table.from_batches(rest))

    return suffixes.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "id long, first int, last int")


def repeats(docs: DataFrame, n: int = WINDOW, k: int = PREFIX, group: int = GROUP) -> DataFrame:
    """``(id, first, last)``: word ranges, last exclusive, that windows found in several documents cover; they may overlap.

    Of suffixes that a document repeats within itself, one is posted and found.
    """
    if not 1 <= k <= n:
        raise ValueError("the prefix must have 1 to n words")
    ship_package(docs.sparkSession)
    rows = materialize(_anchor_rows(docs, n, k), docs.sparkSession, "anchors")
    sizes = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = split_join(rows, sizes, "prefix")
    in_groups = _repeats_in_groups(_suffix_rows(docs, shared.where(F.col("size") <= group), n, k), n, k)
    return in_groups.unionByName(_long_prefixes(docs, shared.where(F.col("size") > group), n, k))


def remove_repeats(docs: DataFrame, n: int = WINDOW, k: int = PREFIX, group: int = GROUP, id_col: str = "doc_id",
                   text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` and the kept ``text`` of every row, kept words joined by one space."""
    t = with_row(texts(docs, id_col, text_col).withColumnRenamed("id", "doc"), "id")
    spans = repeats(t.select("id", "text"), n, k, group).groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def gone(w: Words, spans: list) -> np.ndarray:
        """Mask of a piece's words that repeats cover: those in the spans, and windows a row has more than once."""
        edge = np.zeros(len(w) + 1, dtype=np.int64)
        at, h = w.windows(n)
        if len(at):
            own = mix(h ^ mix(w.row[at].astype(np.uint64)))
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            twice = np.zeros(len(at), dtype=bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            np.add.at(edge, at[twice], 1)
            np.add.at(edge, at[twice] + n, -1)
        for r, own in enumerate(spans):
            if own.is_valid:
                lo, hi = w.first[r], w.first[r + 1]
                np.add.at(edge, np.minimum(lo + np.asarray(own.values.field(0)), hi), 1)
                np.add.at(edge, np.minimum(lo + np.asarray(own.values.field(1)), hi), -1)
        return np.cumsum(edge[:-1]) > 0

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, sha, kept = [], [], [], []
        for p in pieces(batch.column(1)):
            w, raw = Words(p), p.data.tobytes()
            off = gone(w, [batch.column(2)[p.lo + r] for r in range(p.rows)])
            for r in range(p.rows):
                words = raw[p.offsets[r]:p.offsets[r + 1]].split()
                mask = off[w.first[r]:w.first[r + 1]]
                n_words.append(len(words))
                n_removed.append(int(mask.sum()))
                if n_removed[-1]:
                    words = [words[i] for i in np.flatnonzero(~mask)]
                own = b" ".join(words)
                sha.append(hashlib.sha256(own).hexdigest())
                if with_text:
                    kept.append(own)
        cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
        if with_text:
            cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
        return pa.record_batch(cols, names=["id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text])

    return arrow_map(t.join(spans, "id", "left").select("doc", "text", "spans"), fn, "id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
