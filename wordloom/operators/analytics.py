"""N6–N9, A10 helpers: the distribution analytics behind the published figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.dist import normal_cdf


def discrete_normal_pmf(cells: DataFrame, n: int, mean: float = 0.0, std: float = 1.0,
                        span: float = 1.0, cell_col: str = "cell") -> DataFrame:
    """Probability of each of ``n`` equal cells laid on [m − span·s, m + span·s].

    ``prob_folded``: the tails are folded into the two end cells (Σ = 1);
    ``prob``: plain cdf differences (Σ < 1).  ``cells`` holds cell numbers 0..n−1.
    """
    rng = n - 1
    lo, hi = mean - span * std, mean + span * std
    step = (hi - lo) / rng if rng else 0.0
    c = F.col(cell_col).cast("double")
    center = F.lit(lo) + c * F.lit(step)
    ylo = normal_cdf(center - F.lit(step / 2), mean, std)
    yhi = normal_cdf(center + F.lit(step / 2), mean, std)
    plain = yhi - ylo
    folded = F.when(F.col(cell_col) == 0, yhi).when(F.col(cell_col) == rng, F.lit(1.0) - ylo).otherwise(plain)
    return cells.select(F.col(cell_col).cast("bigint").alias("cell"), folded.alias("prob_folded"),
                        plain.alias("prob"))


def empirical_distribution(df: DataFrame, col: str) -> DataFrame:
    """Value → count and percent of all samples, plus overall min and max."""
    g = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    r = df.agg(F.count(col).alias("t"), F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    return g.select("value", "n", (F.col("n") * F.lit(100.0) / F.lit(float(r["t"]))).alias("pct"),
                    F.lit(r["mn"]).alias("min_value"), F.lit(r["mx"]).alias("max_value"))


def normal_fit(df: DataFrame, col: str) -> DataFrame:
    """Maximum-likelihood normal fit: (n, mean, std) with the population std."""
    return df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins over [min, max]; default bin count = max value.

    Returns (bin, lo, hi, n) for every bin, empty ones included; the last bin
    is closed on the right.
    """
    r = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    mn, mx = float(r["mn"]), float(r["mx"])
    nb = int(bins if bins is not None else mx)
    w = (mx - mn) / nb
    b = F.least(F.floor((F.col(col) - F.lit(mn)) / F.lit(w)), F.lit(nb - 1)).cast("bigint") if w > 0 \
        else F.lit(0).cast("bigint")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    allb = df.sparkSession.range(nb).select(F.col("id").alias("bin"))
    return allb.join(counts, "bin", "left").select(
        "bin", (F.lit(mn) + F.col("bin") * F.lit(w)).alias("lo"),
        (F.lit(mn) + (F.col("bin") + 1) * F.lit(w)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))
