"""Benchmark decontamination by a broadcast hash set of test n-grams.

Every benchmark item gives its windows of ``n`` consecutive normalised words
(an item of fewer words, but not none, gives one window of all of them).  The
windows' 64-bit hashes are broadcast; each task hashes the word windows of its
documents, looks them up behind a bitmap, and confirms every hit word by word.
A document word inside a confirmed window is hit.

The benchmark is broadcast in blocks of at most ``block`` windows, so no
broadcast grows with the table: one block is one scan of the documents, and
for more blocks the hits found so far are written to the shared folder between
the scans.

Defined cases: null or wordless texts have no words and no hits; a null id is
kept as null; repeated rows give one row each; an item repeated under one id
counts once; a null item id reads "null"; an empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.arrays import FOLD, LETTERS_DIGITS, Words, in_sorted, pieces
from wordloom.llm.frames import arrow_map, keep_rows, materialize, texts

WINDOW = 10
BLOCK = 400_000


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """``(h, n, item, words)``: the distinct windows of every item."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = batch.column(0).to_pylist()
        hs, ns, own, words = [], [], [], []
        for p in pieces(batch.column(1)):
            w = Words(p, LETTERS_DIGITS, FOLD)
            at, h = w.windows(n)
            short = np.flatnonzero((w.counts > 0) & (w.counts < n))
            lo, hi = w.first[short], w.first[short + 1]
            for a, k, x in [*zip(at, [n] * len(at), h), *zip(lo, hi - lo, w.range_hash(lo, hi))]:
                hs.append(int(x.view(np.int64)))
                ns.append(int(k))
                own.append(items[p.lo + w.row[a]])
                words.append(w.text(a, a + k).decode())
        return pa.record_batch([pa.array(hs, pa.int64()), pa.array(ns, pa.int32()), pa.array(own, pa.string()),
                                pa.array(words, pa.string())], names=["h", "n", "item", "words"])

    t = bench.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))
    return arrow_map(t, fn, "h long, n int, item string, words string").distinct()


class Windows:
    """A block of benchmark windows: per length, sorted hashes with the rows that have them."""

    def __init__(self, table: pa.Table):
        h = np.asarray(table["h"].combine_chunks()).astype(np.int64).view(np.uint64)
        n = np.asarray(table["n"].combine_chunks())
        order = np.lexsort((h, n))
        h, n = h[order], n[order]
        self.items = table["item"].combine_chunks().take(pa.array(order))
        self.words = table["words"].combine_chunks().take(pa.array(order))
        self.by_length = []
        for k in np.unique(n):
            lo, hi = np.searchsorted(n, [k, k + 1])
            values, first = np.unique(h[lo:hi], return_index=True)
            bits = max(10, int(np.ceil(np.log2(len(values) * 16))))
            seen = np.zeros(1 << bits, dtype=bool)
            seen[(values >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_length.append((int(k), bits, seen, values, np.append(first, hi - lo) + lo))

    def find(self, w: Words) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """Mask of the hit words of a piece; (row, item) for every confirmed window."""
        edge = np.zeros(len(w) + 1, dtype=np.int64)
        found = []
        for k, bits, seen, values, first in self.by_length:
            at, h = w.windows(k)
            live = np.flatnonzero(seen[(h >> np.uint64(64 - bits)).astype(np.int64)])
            at, where = at[live], in_sorted(h[live], values)
            for a, j in zip(at[where >= 0], where[where >= 0]):
                text = w.text(a, a + k).decode("utf-8", "replace")
                same = [r for r in range(first[j], first[j + 1]) if self.words[r].as_py() == text]
                if same:
                    edge[a] += 1
                    edge[a + k] -= 1
                    found += [(int(w.row[a]), self.items[r].as_py()) for r in same]
        return np.cumsum(edge[:-1]) > 0, found


def blocks(bench: DataFrame, id_col: str, text_col: str, n: int, block: int):
    """Yields the benchmark's windows as broadcasts of bounded size, with their number (one, unless it has over ``block`` windows)."""
    spark = bench.sparkSession
    rows = benchmark_windows(bench, id_col, text_col, n)
    total = rows.count()
    if total > block:
        rows = materialize(rows, spark, "bench-windows")
    parts = max(1, -(-total // block))
    part = F.pmod(F.xxhash64("h", "item"), F.lit(parts))
    for b in range(parts):
        yield spark.sparkContext.broadcast(Windows((rows.where(part == b) if parts > 1 else rows).toArrow())), parts


def scan(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", n: int = WINDOW, block: int = BLOCK, with_text: bool = True) -> DataFrame:
    """One row per document row: ``id, text, n_words, hits`` (hit word numbers) and ``items`` (sorted item ids)."""
    out = texts(docs, id_col, text_col).select("id", "text", F.lit(0).cast("long").alias("n_words"),
                                               F.array().cast("array<int>").alias("hits"),
                                               F.array().cast("array<string>").alias("items"))
    for b, (shared, parts) in enumerate(blocks(bench, item_col, item_text_col, n, block)):
        carry = with_text or b + 1 < parts

        def fn(batch: pa.RecordBatch, shared=shared, carry=carry) -> pa.RecordBatch:
            hits, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            for p in pieces(batch.column(1)):
                w = Words(p, LETTERS_DIGITS, FOLD)
                n_words[p.lo:p.hi] = w.counts
                hit, found = shared.value.find(w)
                by_row: dict[int, set[str]] = {}
                for r, item in found:
                    by_row.setdefault(r, set()).add(item)
                for r, own in by_row.items():
                    words = np.flatnonzero(hit[w.first[r]:w.first[r + 1]]).tolist()
                    hits[p.lo + r] = sorted({*hits[p.lo + r], *words})
                    items[p.lo + r] = sorted({*items[p.lo + r], *own})
            made = [pa.array(n_words), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            return pa.record_batch([*batch.columns[:1 + carry], *made],
                                   names=["id", *["text"] * carry, "n_words", "hits", "items"])

        out = arrow_map(out, fn, "id long, " + "text string, " * carry + "n_words long, hits array<int>, items array<string>")
        if parts > 1:
            out = materialize(out, docs.sparkSession, "bench-hits")
    return out


def report(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """Per document row: counts of words and hit words, the items found, and whether any word is hit."""
    found = scan(docs, bench, with_text=False, **options)
    return found.select("id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", n: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, columns as they are, of which no word is hit."""
    out = docs
    for shared, parts in blocks(bench, item_col, item_text_col, n, block):
        def decide(column, shared=shared):
            keep = np.ones(len(column), dtype=bool)
            for p in pieces(column):
                w = Words(p, LETTERS_DIGITS, FOLD)
                _, found = shared.value.find(w)
                keep[[p.lo + r for r, _ in found]] = False
            return keep

        out = keep_rows(out, decide, text_col)
        if parts > 1:
            out = materialize(out, docs.sparkSession, "bench-clean")
    return out


def clean_spans(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """``(id, text)`` with the hit words removed; other words as they stand, lower-cased, joined by one space."""
    found = scan(docs, bench, **options)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    kept = F.filter(words, lambda _, i: ~F.array_contains("hits", i))
    return found.select("id", F.when(F.size("hits") == 0, F.col("text")).otherwise(F.array_join(kept, " ")).alias("text"))
