"""Word counts, frequency filters, the indexed vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.operators.ranking import dense_index


def word_freq(sents: DataFrame) -> DataFrame:
    """A1: (word, freq) — kept occurrences per word (map-side combined)."""
    return sents.select(F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("freq"))


def high_cut(v_raw: int, cfg: Config) -> int:
    """How many of the most frequent words the high filter removes: trunc(V_raw * ratio)."""
    return int(v_raw * cfg.high_ratio) if cfg.high else 0


def filter_high(wf: DataFrame, cfg: Config = Config(), v_raw: int | None = None) -> DataFrame:
    """A5: (word, freq) of the trunc(V_raw·ratio) most frequent words.

    Order ``freq desc, word desc`` (a stable ascending sort over byte-ordered
    words leaves the byte-greatest of a tie at the tail).  V_raw counts the
    vocabulary *before* the low filter.
    """
    if v_raw is None:       # counted, ranked by the histogram and filtered: written once, not counted from the corpus each time
        from wordloom.session import materialize
        wf = materialize(wf, wf.sparkSession, "word_freq")
        v_raw = wf.count()
    k = high_cut(v_raw, cfg)
    if k <= 0:
        return wf.limit(0)
    # cutoff frequency from the frequency histogram (one row per distinct
    # frequency, far smaller than the vocabulary): only words at or above it
    # can be among the k most frequent, so only they are sorted
    hist = wf.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = hist.withColumn("cum", F.sum("n").over(w)).where(F.col("cum") >= k) \
        .agg(F.max("freq").alias("f")).first()["f"]
    cand = wf.where(F.col("freq") >= cut) if cut is not None else wf
    ranked = dense_index(cand, [F.col("freq").desc(), F.col("word").desc()], "_r")
    return ranked.where(F.col("_r") < k).drop("_r")


def filter_low(wf: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A4: (word, freq) with freq < low bound."""
    if not cfg.low:
        return wf.limit(0)
    return wf.where(F.col("freq") < cfg.low_bound)


def vocab_filter(wf: DataFrame, cfg: Config = Config(), v_raw: int | None = None):
    """(kept, removed). removed = (word, freq, reason) with reason high|low.

    A word that is both high and low is removed once, as 'high' (set
    semantics instead of the double subtraction).
    """
    high = filter_high(wf, cfg, v_raw).withColumn("reason", F.lit("high"))
    low = filter_low(wf, cfg).join(high.select("word"), "word", "left_anti") \
        .withColumn("reason", F.lit("low"))
    removed = high.unionByName(low)
    kept = wf.join(removed.select("word"), "word", "left_anti")
    return kept, removed


def vocab_index(kept: DataFrame) -> DataFrame:
    """(idx, word, freq) — idx is the 0-based byte-order rank of the word."""
    return dense_index(kept, [F.col("word").asc()], "idx").select("idx", "word", "freq")


def vocab_freq_sum_max(vocab: DataFrame) -> DataFrame:
    """A3: Σfreq and max freq over the kept vocabulary."""
    return vocab.agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("bigint").alias("freq_sum"),
                     F.coalesce(F.max("freq"), F.lit(0)).cast("bigint").alias("freq_max"))


def freq_rank(vocab: DataFrame) -> DataFrame:
    """A10: (rank, word, freq) — rank 1 = most frequent; ties by word."""
    return dense_index(vocab.select("word", "freq"), [F.col("freq").desc(), F.col("word").asc()],
                       "rank", start=1)


def freq_distribution(vocab: DataFrame, cfg: Config = Config(), v: int | None = None) -> DataFrame:
    """Frequencies sorted descending, read at 0, s, …, (B-2)s and V-1 (s = V div B).

    Returns (sample, position, freq) with 1-based sample and position.  Read
    off the frequency histogram (one row per distinct frequency): the word at
    rank r has the frequency whose cumulative block [lo, hi) contains r, so
    the vocabulary itself is never sorted.
    """
    if v is None:
        v = vocab.count()
    b = cfg.buckets
    span = v // b
    pos = [(p, (v - 1) if p == b else (p - 1) * span) for p in range(1, b + 1)]
    hist = vocab.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("hi", F.sum("n").over(w)).withColumn("lo", F.col("hi") - F.col("n"))
    wanted = F.array(*[F.struct(F.lit(p).alias("sample"), F.lit(r).cast("bigint").alias("r")) for p, r in pos])
    hits = F.filter(wanted, lambda x: (x["r"] >= F.col("lo")) & (x["r"] < F.col("hi")))
    return h.select("freq", F.explode(hits).alias("x")).select(
        F.col("x.sample").alias("sample"), (F.col("x.r") + 1).alias("position"), "freq").orderBy("sample")


def rank_frequency(vocab: DataFrame) -> DataFrame:
    """A10: Zipf curve (rank, freq) plus the running total."""
    from wordloom.operators.ranking import prefix_sum
    r = freq_rank(vocab)
    return prefix_sum(r, "rank", "freq", "cum_freq", inclusive=True).select(
        "rank", "word", "freq", "cum_freq")


def corpus_stats(spark, pair_count: int, vocab_size: int) -> DataFrame:
    """A2: pair_count (labelled "corpus size" by the original), V, pairs per word."""
    ratio = (pair_count / vocab_size) if vocab_size else None
    return spark.createDataFrame([(int(pair_count), int(vocab_size), ratio)],
                                 "pair_count long, vocab_size long, pairs_per_word double")


# --- lookups ---------------------------------------------------------------

def word_to_index(words: DataFrame, vocab: DataFrame, col: str = "word") -> DataFrame:
    """Attach idx, −1 when the word is not in the vocabulary."""
    v = vocab.select(F.col("word").alias(col), F.col("idx"))
    return words.join(v, col, "left").withColumn("idx", F.coalesce("idx", F.lit(-1)).cast("bigint"))


def index_to_word(idxs: DataFrame, vocab: DataFrame, col: str = "idx") -> DataFrame:
    """Attach the word of each index."""
    return idxs.join(vocab.select(F.col("idx").alias(col), "word"), col, "left")


def in_filtered(words: DataFrame, removed: DataFrame, col: str = "word") -> DataFrame:
    """Flag membership in the removed (high/low) set."""
    r = removed.select(F.col("word").alias(col)).withColumn("_f", F.lit(True))
    return words.join(r, col, "left").withColumn("filtered", F.coalesce("_f", F.lit(False))).drop("_f")


def oov_report(words: DataFrame, vocab: DataFrame, col: str = "word") -> DataFrame:
    """Words met that have no index, with how often they were met."""
    miss = words.join(vocab.select(F.col("word").alias(col)), col, "left_anti")
    return miss.groupBy(col).agg(F.count(F.lit(1)).alias("hits"))
