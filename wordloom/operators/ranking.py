"""Global ranks and prefix sums without a single-partition window.

``dense_index``: range-partitioned sort, per-partition row numbers from
``monotonically_increasing_id``, frozen by writing the sorted rows to the
shared checkpoint folder (so every reader and every retried task sees the
same ids), then per-partition offsets from a table with one row per
partition (the only thing broadcast; its size is the partition count).

``prefix_sum``: two-level scan over a dense integer key: block sums
(one row per block) → block offsets → a window inside each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW33 = (1 << 33) - 1


def dense_index(df: DataFrame, order_by: list[Column | str], name: str = "idx",
                start: int = 0) -> DataFrame:
    """Add a 0-based (``start``-based) global position under a total order."""
    from wordloom.session import materialize
    s = df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id())
    s = materialize(s, df.sparkSession, "rank")
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_rn", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = s.join(F.broadcast(offsets), "_pid").withColumn(
        name, (F.col("_off") + F.col("_rn") + F.lit(start)).cast("bigint"))
    return out.drop("_mid", "_pid", "_rn", "_off")


def prefix_sum(df: DataFrame, key: str, value: str, name: str, inclusive: bool = False,
               block: int = 1 << 16) -> DataFrame:
    """Running sum of ``value`` ordered by the dense integer ``key``.

    Exclusive by default (sum over keys strictly before).
    """
    b = df.withColumn("_blk", F.floor(F.col(key) / F.lit(block)).cast("bigint"))
    sums = b.groupBy("_blk").agg(F.sum(value).alias("_bs"))
    wb = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select("_blk", F.coalesce(F.sum("_bs").over(wb), F.lit(0)).alias("_boff"))
    frame_end = 0 if inclusive else -1
    wi = Window.partitionBy("_blk").orderBy(key).rowsBetween(Window.unboundedPreceding, frame_end)
    inner = b.withColumn("_in", F.coalesce(F.sum(value).over(wi), F.lit(0)))
    out = inner.join(F.broadcast(offs), "_blk").withColumn(
        name, (F.col("_boff") + F.col("_in")).cast("bigint"))
    return out.drop("_blk", "_boff", "_in")
