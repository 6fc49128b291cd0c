"""Ranked lexical search, term at a time with limited accumulators.

Every item of a query table ranks all documents.  A first pass over the texts
writes a forward index: per document its id, its number of terms, and the terms
that any item asks for with their occurrences.  A second pass cuts the index
into segments of documents, inverts each in memory and evaluates every item on
it term at a time, rarest term first: as long as the terms still to come could
lift an unseen document to the k-th best score, their documents get
accumulators; from then on only the documents that have one are updated, all of
them exactly.  The k-th best score is that of the segment so far or of the
task's earlier segments, whichever is higher.  Segments give their k best per
item, and a window keeps the k best of these.

The items' terms are broadcast in blocks of at most ``block`` (item, term)
pairs (more only for a single item that has more), so no broadcast grows with
the tables; every block is one index and one evaluation.

Scores are whole numbers: ``w * ((10^9 tf) div (1000 tf + 8 m))`` summed over
an item's distinct terms, ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``,
``m = 10 + (90 n N) div L``; N documents with a term, L all terms, n the
document's terms, df the documents with the term, tf its occurrences.

A query term is found by a 64-bit hash of the word and confirmed by its length
and its first and last eight bytes, which is exact up to sixteen bytes.

Defined cases: null and empty texts have no terms, count nowhere and are never
found; a text is used whole, however long, and costs one index row of its
distinct query terms; equal scores go by ascending document id, null ids last;
rows that repeat an id are documents of their own and rank one by one; every
query row is an item of its own, repeated or null ids included; an empty table
on either side gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.arrays import FOLD, LETTERS_DIGITS, Words, in_sorted, pieces
from wordloom.llm.frames import arrow_map, materialize, ship_package, texts

TOP = 10
BLOCK = 400_000
SEGMENT_ROWS, SEGMENT_POSTINGS = 1 << 14, 1 << 21


def ends(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, first and last eight bytes (fewer for shorter words) of every word."""
    length = w.end - w.start
    eight = np.ndarray(shape=(max(len(w.data) - 7, 1),), dtype="<u8", buffer=np.ascontiguousarray(w.data), strides=(1,))
    short = np.minimum(length, 8).astype(np.uint64)
    mask = np.where(short == 8, ~np.uint64(0), (np.uint64(1) << (short * np.uint64(8)) % np.uint64(64)) - np.uint64(1))
    return length, eight[w.start] & mask, eight[np.maximum(w.end - 8, w.start)] & mask


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, key, terms)``: the distinct terms of every query row, and a hash that deals the rows into blocks."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms: list[list[str]] = [[] for _ in range(batch.num_rows)]
        for p in pieces(batch.column(2)):
            w = Words(p, LETTERS_DIGITS, FOLD)
            for r in range(p.rows):
                a, b = int(w.first[r]), int(w.first[r + 1])
                terms[p.lo + r] = sorted({w.text(i, i + 1).decode("utf-8", "replace") for i in range(a, b)})
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.string()))], names=["item", "key", "terms"])

    kind = items.schema[id_col].dataType
    t = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    t = t.select("item", F.xxhash64("item", "text").alias("key"), "text")
    schema = T.StructType([T.StructField("item", kind), T.StructField("key", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])
    return arrow_map(t, fn, schema).where(F.size("terms") > 0)


class Queries:
    """A block of items: their distinct terms in hash order, and the term numbers of each."""

    def __init__(self, rows: list):
        self.items = [r["item"] for r in rows]
        terms = sorted({t for r in rows for t in r["terms"]})
        hashes, marks = [], []
        for p in pieces(pa.array(terms, pa.string())):
            w = Words(p, LETTERS_DIGITS, FOLD)
            hashes.append(w.hash)
            marks.append(np.stack([x.astype(np.uint64) for x in ends(w)]))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hash, self.marks = h[order], np.concatenate(marks, axis=1)[:, order]
        number = {terms[j]: i for i, j in enumerate(order)}
        self.own = [np.array([number[t] for t in r["terms"]], dtype=np.int64) for r in rows]
        bits = max(10, int(np.ceil(np.log2(len(h) * 16))))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(h >> self.shift).astype(np.int64)] = True

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term number) of the words that are query terms."""
        live = np.flatnonzero(self.seen[(w.hash >> self.shift).astype(np.int64)])
        at = in_sorted(w.hash[live], self.hash)
        live, at = live[at >= 0], at[at >= 0]
        own = np.stack([x.astype(np.uint64)[live] for x in ends(w)])
        same = (own == self.marks[:, at]).all(axis=0)
        return live[same], at[same]


def build_index(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, tfs)`` of every document with a term; ``terms`` are numbers of ``queries``, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, n, size, terms, tfs = shared.value, [], [], [], []
        for p in pieces(batch.column(1)):
            w = Words(p, LETTERS_DIGITS, FOLD)
            word, term = q.find(w)
            pair, tf = np.unique(w.row[word] * len(q.hash) + term, return_counts=True)
            row, term = np.divmod(pair, len(q.hash))
            n.append(w.counts)
            size.append(np.bincount(row, minlength=p.rows))
            terms.append(term.astype(np.int32))
            tfs.append(tf.astype(np.int32))
        offsets = pa.array(np.concatenate([[0], *size]).cumsum().astype(np.int32))
        made = pa.record_batch([batch.column(0), pa.array(np.concatenate(n).astype(np.int64)),
                                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(terms))),
                                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tfs)))], names=["id", "n", "terms", "tfs"])
        return made.filter(pa.array(np.concatenate(n) > 0))

    return arrow_map(texts(docs, id_col, text_col), fn, "id long, n long, terms array<int>, tfs array<int>")


def lengths(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of documents of ``n`` terms."""
    if int(n.max(initial=0)) * docs * 90 < 1 << 63:
        return 10 + (90 * n * docs) // words
    return np.array([10 + (90 * int(x) * docs) // words for x in n], dtype=np.int64)


class Segment:
    """An inverted index of some documents: per term its documents and what it adds to their scores."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.ids, self.known, self.doc, term, tf = ids, known, doc[order], term[order], tf[order]
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        self.adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.bound = np.zeros(len(weights), dtype=np.int64)
        np.maximum.at(self.bound, term, self.adds)
        self.scores = np.zeros(len(ids), dtype=np.int64)

    def best(self, terms: np.ndarray, k: int, floor: int) -> np.ndarray:
        """Documents that may be among the ``k`` best, given that ``k`` others reach ``floor``; their scores are in ``scores``."""
        scores = self.scores
        scores[:] = 0
        rest = np.append(np.cumsum(self.bound[terms][::-1])[::-1], 0)
        kth, create = floor, True
        for j, t in enumerate(terms):
            lo, hi = self.first[t], self.first[t + 1]
            create = create and rest[j] >= kth
            if lo == hi:
                continue
            docs, adds = self.doc[lo:hi], self.adds[lo:hi]
            if create:
                scores[docs] += adds
                if len(scores) >= k and rest[j + 1] < scores.max():
                    kth = max(floor, int(np.partition(scores, len(scores) - k)[-k]))
            else:
                own = scores[docs] > 0
                scores[docs[own]] += adds[own]
        if len(scores) >= k:
            kth = max(floor, int(np.partition(scores, len(scores) - k)[-k]))
        return np.flatnonzero(scores >= max(kth, 1))


def first_k(score: np.ndarray, known: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best: highest score, then known and least id."""
    return np.lexsort((ids, ~known, -score))[:k]


def evaluate(index: DataFrame, queries: Queries, weights: np.ndarray, docs: int, words: int, order: np.ndarray, k: int,
             segment_rows: int) -> DataFrame:
    """``(item, id, score)``: the best ``k`` documents of every task for every item (``item`` is a number of ``queries``)."""
    spark = index.sparkSession
    ship_package(spark)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(([own[np.argsort(place[own])] for own in queries.own], weights))

    def segments(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[Segment]:
        held: list[tuple] = []

        def made() -> Segment:
            ids, known, n, size, term, tf = (np.concatenate(x) for x in zip(*held))
            return Segment(ids, known, lengths(n, docs, words), np.repeat(np.arange(len(n)), size), term, tf, weights)

        for batch in batches:
            for at in range(0, batch.num_rows, segment_rows):
                b = batch.slice(at, segment_rows)
                ids, terms, tfs = b.column(0), b.column(2), b.column(3)
                held.append((np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), np.asarray(b.column(1)), np.diff(np.asarray(terms.offsets)),
                             np.asarray(terms.flatten()).astype(np.int64), np.asarray(tfs.flatten()).astype(np.int64)))
                if sum(len(x[0]) for x in held) >= segment_rows or sum(len(x[4]) for x in held) >= SEGMENT_POSTINGS:
                    yield made()
                    held.clear()
        if held:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        none = np.zeros(0, dtype=np.int64)
        best = [(none, none.astype(bool), none)] * len(own)
        for s in segments(batches, weights):
            for i, terms in enumerate(own):
                score, known, ids = best[i]
                found = s.best(terms, k, int(score[-1]) if len(score) == k else 0)
                if len(found):
                    score, known, ids = (np.concatenate(x) for x in zip(best[i], (s.scores[found], s.known[found], s.ids[found])))
                    top = first_k(score, known, ids, k)
                    best[i] = score[top], known[top], ids[top]
        if any(len(b[0]) for b in best):
            score, known, ids = (np.concatenate(x) for x in zip(*best))
            item = np.repeat(np.arange(len(own)), [len(b[0]) for b in best])
            yield pa.record_batch([pa.array(item), pa.array(ids, mask=~known), pa.array(score)], names=["item", "id", "score"])

    return index.mapInArrow(run, "item long, id long, score long")


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", k: int = TOP, block: int = BLOCK, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``(item, rank, id, score)``: the ``k`` best documents of every query row, of those with a score above 0."""
    spark = docs.sparkSession
    asked = item_terms(items, item_col, item_text_col)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-total // block))
    if parts > 1:
        asked = materialize(asked, spark, "query-terms")
    kind = items.schema[item_col].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item", kind), T.StructField("rank", T.IntegerType()),
                                                  T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))
    for b in range(parts):
        rows = asked.where(F.pmod("key", F.lit(parts)) == b).collect()
        if not rows:
            continue
        q = Queries(rows)
        index = materialize(build_index(docs, q, id_col, text_col), spark, "lexical-index")
        n, words = index.agg(F.count("*"), F.sum("n")).first()
        if not n:
            continue
        counts = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df = np.zeros(len(q.hash), dtype=np.int64)
        df[np.asarray(counts["term"])] = np.asarray(counts["count"])
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        found = evaluate(index, q, weights, n, words, np.argsort(df, kind="stable"), k, segment_rows)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(q.items)), T.StructType([T.StructField("n", T.LongType()), T.StructField("name", kind)]))
        found = found.join(F.broadcast(names), F.col("item") == F.col("n")).select(F.col("name").alias("item"), "rank", "id", "score")
        out = out.unionByName(found)
    return out
