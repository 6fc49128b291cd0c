"""Window co-occurrence over kept tokens.

In-row form (default): pairs are built from each sentence row, over Arrow
batches, and equal ones of a batch are counted there, so the only shuffle is
the pair count; a long sentence's fragments bring the words before them
(``halo``) along.
Window form (cross-check): ``collect_list`` over ROWS 4 PRECEDING..1
PRECEDING per stretch of a sentence, each stretch with the 4 words before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import text as T
from wordloom.session import ship_package


ROWS_AT_ONCE = 1 << 11       # sentences whose pairs a task hands on at once
STRETCH = 1 << 14            # positions per stretch of the window form


def _pairs(cfg: Config):
    return T.window_pairs(F.col("words"), cfg.context, F.col("halo"), F.col("start"))


def _windows(v: np.ndarray, row: np.ndarray, center: np.ndarray, context: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per distance d, the places i whose word pairs with the one at i − d: the same row, i a center, other words."""
    for d in range(1, min(context, len(v) - 1) + 1):
        yield d, np.flatnonzero((row[d:] == row[:-d]) & center[d:] & (v[d:] != v[:-d])) + d


def _coded(words: pa.ListArray, halo: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and per word its number among them, its row, its place in the row and whether it is a center, of rows whose first ``halo`` words are none."""
    flat = words.flatten().dictionary_encode()
    length = np.diff(np.asarray(words.offsets))
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    return flat.dictionary, np.asarray(flat.indices).astype(np.int64), row, place, place >= halo[row]


def cooccurrence_pairs(sents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(doc_id, sid, pos, dist, center, context) — one row per counted pair."""
    ship_package(sents.sparkSession)
    context = cfg.context

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                halo = np.asarray(b.column(3))
                words, v, row, place, center = _coded(b.column(2), halo)
                pos = place + (np.asarray(b.column(4)) - halo)[row]
                for d, i in _windows(v, row, center, context):
                    own = pa.array(row[i])
                    yield pa.record_batch([b.column(0).take(own), b.column(1).take(own), pa.array(pos[i].astype(np.int32)),
                                           pa.array(np.full(len(i), d, dtype=np.int32)), words.take(pa.array(v[i])), words.take(pa.array(v[i - d]))],
                                          names=["doc_id", "sid", "pos", "dist", "center", "context"])

    rows = sents.select("doc_id", "sid", F.concat("halo", "words").alias("words"), F.size("halo").alias("halo"), F.col("start").cast("int").alias("start"))
    types = dict(sents.dtypes)
    return rows.mapInArrow(run, f"doc_id {types['doc_id']}, sid {types['sid']}, pos int, dist int, center string, context string")


def window_self_join(tokens: DataFrame, cfg: Config = Config(), stretch: int = STRETCH) -> DataFrame:
    """J8 / C1 window form over (doc_id, sid, pos, word) kept tokens; a stretch's last words go to the next one, too."""
    own = F.floor(F.col("pos") / stretch)
    late = F.col("pos") % stretch >= stretch - cfg.context
    t = tokens.select("*", own.alias("own"), F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("part"))
    w = Window.partitionBy("doc_id", "sid", "part").orderBy("pos").rowsBetween(-cfg.context, -1)
    prev = t.withColumn("_prev", F.collect_list(F.struct("pos", "word")).over(w)).where(F.col("own") == F.col("part"))
    e = prev.select("doc_id", "sid", "pos", "word", F.explode("_prev").alias("q"))
    return e.where(F.col("q.word") != F.col("word")).select(
        "doc_id", "sid", "pos", (F.col("pos") - F.col("q.pos")).cast("int").alias("dist"),
        F.col("word").alias("center"), F.col("q.word").alias("context"))


def undirected_counts(sents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(a, b, freq) with a < b — each unordered pair once; halves the shuffle."""
    ship_package(sents.sparkSession)
    context = cfg.context

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, v, row, _, center = _coded(b.column(0), np.asarray(b.column(1)))
            rank = np.empty(len(words), dtype=np.int64)
            order = np.asarray(pc.sort_indices(words.cast(pa.binary()))).astype(np.int64)      # byte order
            rank[order] = np.arange(len(words))
            words, v = words.take(pa.array(order)), rank[v]
            found = [(np.minimum(v[i], v[i - d]), np.maximum(v[i], v[i - d])) for d, i in _windows(v, row, center, context)]
            if found:
                x, y = (np.concatenate(side) for side in zip(*found))
                x, y, n = count_pairs(x, y, np.ones(len(x), dtype=np.int64))
                yield pa.record_batch([words.take(pa.array(x)), words.take(pa.array(y)), pa.array(n)], names=["a", "b", "freq"])

    found = sents.select(F.concat("halo", "words").alias("words"), F.size("halo").alias("halo")).mapInArrow(run, "a string, b string, freq long")
    return found.groupBy("a", "b").agg(F.sum("freq").alias("freq"))


def fused_counts(sents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Word counts and undirected pair counts from ONE pass over the sentences.

    Rows (a, b, freq): b NULL → word count of a; b set → count of the pair
    a < b.  One scan, one tokenisation, one map-side-combined shuffle.
    """
    words = F.transform(F.col("words"), lambda w: F.struct(w.alias("a"), F.lit(None).cast("string").alias("b")))
    pairs = F.transform(_pairs(cfg), lambda p: F.struct(
        F.least(p["center"], p["ctx"]).alias("a"), F.greatest(p["center"], p["ctx"]).alias("b")))
    return sents.select(F.explode(F.concat(words, pairs)).alias("r")).select("r.a", "r.b") \
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq"))


def mirror(und: DataFrame) -> DataFrame:
    """(a,b,f) → both (center=a, context=b) and (center=b, context=a)."""
    return und.select(F.col("a").alias("center"), F.col("b").alias("context"), "freq").unionByName(
        und.select(F.col("b").alias("center"), F.col("a").alias("context"), "freq"))


def cooccurrence_counts(sents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Symmetric (center, context, freq) before the vocabulary filter."""
    return mirror(undirected_counts(sents, cfg))


def pair_count(und: DataFrame) -> DataFrame:
    """Number of counted pairs (the original's "corpus size")."""
    return und.agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("bigint").alias("pair_count"))


def context_degree(counts: DataFrame) -> DataFrame:
    """Distinct context words per word, before the frequency filter."""
    return counts.groupBy(F.col("center").alias("word")).agg(F.count(F.lit(1)).alias("context_max"))


BITS = 27                    # the filter of kept words: 2^27 bits, 16 MB at any vocabulary
PAIRS_HELD = 1 << 22         # pairs a task counts before it hands them on


def word_key(word, seed: int):
    """64-bit id of a word; see :func:`key_seed`."""
    return F.xxhash64(F.lit(seed), word)


def key_seed(wf: DataFrame) -> int:
    """The least seed for which all words of ``wf`` (kept or not) have different ids."""
    seed = 0
    while wf.groupBy(word_key(F.col("word"), seed).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        seed += 1
    return seed


def word_filter(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits set at the top ``bits`` bits of the ids ``h``, as 64-bit words; its size does not depend on the words."""
    at = F.shiftrightunsigned("h", 64 - bits)
    got = keys.select(F.shiftright(at, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")) \
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[np.asarray(got["at"])] = np.asarray(got["bits"]).astype(np.int64).view(np.uint64)
    return out


def count_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs as one, their counts added."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, dtype=np.int64)
    return a[first], b[first], np.add.reduceat(n[order], first) if len(a) else n


def kept_pairs(sents: DataFrame, vocab: DataFrame, seed: int, cfg: Config = Config(), bits: int = BITS) -> DataFrame:
    """(a, b, freq): ids of the unordered pairs of kept words, each once, and a row (NULL, NULL, number of all counted pairs).

    Sentences become arrays of word ids; a task forms its windows' pairs, drops
    those with a word that the filter of kept words rules out, counts equal
    pairs, and only then shuffles.  Of the words that the filter lets through by
    chance, the join with the vocabulary gets rid.
    """
    spark = sents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(word_filter(vocab.select(word_key(F.col("word"), seed).alias("h")), bits))
    context = cfg.context

    def windows(v: np.ndarray, row: np.ndarray, center: np.ndarray, kept: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for d in range(1, min(context, len(v) - 1) + 1):
            now, before = v[d:], v[:-d]
            pair = (row[d:] == row[:-d]) & center[d:] & (now != before)
            live = pair & kept[d:] & kept[:-d]
            yield int(pair.sum()), now[live], before[live]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def out() -> pa.RecordBatch:
            a, b, n = count_pairs(*(np.concatenate(x) for x in zip(*held)))
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "freq"])

        for batch in batches:
            words, halo = batch.column(0), np.asarray(batch.column(1))
            v = np.asarray(words.flatten()).astype(np.int64)
            if not len(v):
                continue
            offsets = np.asarray(words.offsets)
            length = np.diff(offsets)
            row = np.repeat(np.arange(len(length)), length)
            center = np.arange(len(v)) - np.repeat(offsets[:-1] - offsets[0], length) >= halo[row]
            at = v.view(np.uint64) >> np.uint64(64 - bits)
            kept = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            for all_pairs, x, y in windows(v, row, center, kept):
                total += all_pairs
                held.append((np.minimum(x, y), np.maximum(x, y), np.ones(len(x), dtype=np.int64)))
                size += len(x)
            if size > PAIRS_HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([total])], names=["a", "b", "freq"])

    ids = F.transform(F.concat("halo", "words"), lambda w: word_key(w, seed))
    found = sents.select(ids.alias("ids"), F.size("halo").alias("n")).mapInArrow(run, "a long, b long, freq long")
    return found.groupBy("a", "b").agg(F.sum("freq").alias("freq"))


def vocab_targets(pairs: DataFrame, vocab: DataFrame, seed: int) -> DataFrame:
    """(center_idx, center, context_idx, context, freq) over kept words only, from :func:`kept_pairs`."""
    words = vocab.select(word_key(F.col("word"), seed).alias("h"), "idx", "word")
    side = lambda x: words.select(F.col("h").alias(x), F.col("idx").alias(f"{x}_idx"), F.col("word").alias(f"{x}_word"))
    kept = pairs.where(F.col("a").isNotNull()).join(side("a"), "a").join(side("b"), "b")
    both = F.explode(F.array(
        F.struct(F.col("a_idx").alias("center_idx"), F.col("a_word").alias("center"),
                 F.col("b_idx").alias("context_idx"), F.col("b_word").alias("context")),
        F.struct(F.col("b_idx").alias("center_idx"), F.col("b_word").alias("center"),
                 F.col("a_idx").alias("context_idx"), F.col("a_word").alias("context"))))
    return kept.select(both.alias("t"), "freq").select("t.*", "freq")


def training_examples(targets: DataFrame) -> DataFrame:
    """C4: Σ target freq = positive examples per epoch."""
    return targets.agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("bigint").alias("examples"))
