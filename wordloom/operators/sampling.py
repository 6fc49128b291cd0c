"""Negative-sampling tables, draws and the initial loss.

Draws themselves are arrays in tasks (:mod:`wordloom.operators.samples`).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions.hashing import uniform, uniform_open0
from wordloom.operators.ranking import prefix_sum
from wordloom.operators.vocab import freq_rank


def unigram_table(vocab: DataFrame) -> DataFrame:
    """N1 (intended): (idx, lo, hi) — word idx owns table slots [lo, hi), hi − lo = freq."""
    r = prefix_sum(vocab.select("idx", "freq"), "idx", "freq", "lo")
    return r.select("idx", "lo", (F.col("lo") + F.col("freq")).alias("hi"))


def unigram_literal_table(vocab: DataFrame, v: int) -> DataFrame:
    """N1 (literal, X7): slot s < V of the concatenated ranges 0..freq−1 in index order → value."""
    ranges = unigram_table(vocab).where(F.col("lo") < v)
    return ranges.select(F.explode(F.sequence(F.col("lo"), F.least(F.col("hi"), F.lit(v)) - 1)).alias("slot"),
                         "lo").select("slot", (F.col("slot") - F.col("lo")).alias("k"))


def center_out_reorder(vocab: DataFrame) -> DataFrame:
    """(slot, rank, idx, word, freq) — the p-th most frequent word (p = rank − 1) goes to
    slot c + p/2 (p even) or c − (p+1)/2 mod n (p odd), c = n/2 + n%2 − 1."""
    n = vocab.count()
    c = n // 2 + n % 2 - 1
    r = freq_rank(vocab).join(vocab.select("word", "idx"), "word")
    p = F.col("rank") - 1
    slot = F.when(p % 2 == 0, F.lit(c) + p / 2).otherwise(
        F.pmod(F.lit(c) - (p + 1) / 2, F.lit(n))).cast("bigint")
    return r.select(slot.alias("slot"), "rank", "idx", "word", "freq")


def tdnd_raw(x1, x2, a, b):
    """round(a + (1 + 0.25·y)·0.5·(b − a)), y standard normal by Box–Muller."""
    y = F.sqrt(F.lit(-2.0) * F.log(x1)) * F.cos(F.lit(2.0 * math.pi) * x2)
    return F.round(F.lit(float(a)) + (F.lit(1.0) + y * F.lit(0.25)) * F.lit(0.5) * F.lit(float(b - a))).cast("bigint")


def tdnd_resample(raw, u3, a, b):
    """Outside [a, b] → trunc(u3·(b − a) + a)."""
    res = F.floor(u3 * F.lit(float(b - a)) + F.lit(float(a))).cast("bigint")
    return F.when((raw < a) | (raw > b), res).otherwise(raw)


def sgns_loss(targets: DataFrame, vocab: DataFrame, model_in: DataFrame, model_out: DataFrame, cfg: Config = Config(), rnd: int = 0) -> DataFrame:
    """(examples, loss) = Σ −ln σ(±w_ih[p]·w_ho[k]) over one round's samples (+ the context, − its negatives).

    Every cell of the examples meets the rows of its centers and one output
    block at a time; only partial losses are shuffled.
    """
    from wordloom.operators import samples as SM
    from wordloom.operators.train import cells_loss
    space = SM.slots(vocab, cfg)
    examples, _, _ = SM.example_table(targets, space)
    out = model_out.select("idx", "vec").join(space.rows, "idx")
    return cells_loss(examples, SM.members(examples), space, cfg, rnd, SM.packed(model_in.select("idx", "vec")), SM.packed(out))


def sampler_vs_vocab(vocab: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Reorder vocabulary freqs (N3), draw Σfreq TDND samples on [0, n], count per slot.

    Returns (slot, freq, draws): the reordered frequency at each slot and how
    many of the Σfreq draws landed there (slot n only receives draws).
    """
    n = vocab.count()
    total = vocab.agg(F.sum("freq")).first()[0]
    spark = vocab.sparkSession
    ids = spark.range(0, total)
    s = cfg.seed
    raw = tdnd_raw(uniform_open0(s, "n10a", F.col("id")), uniform(s, "n10b", F.col("id")), 0, n)
    slot = tdnd_resample(raw, uniform(s, "n10c", F.col("id")), 0, n)
    counts = ids.select(slot.alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("draws"))
    re = center_out_reorder(vocab).select("slot", "freq")
    return re.join(counts, "slot", "full").select(
        "slot", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"),
        F.coalesce("draws", F.lit(0)).cast("bigint").alias("draws"))
