"""Best-fit packing of documents into sequences of several permitted lengths.

Items are documents by their number of words, one more for the end mark;
a document longer than the largest permitted length is cut into pieces of that
length and a rest.  Items go at random to shards of about ``shard_items``
items, and each shard is packed by best-fit decreasing: an item enters the open
bin with the least sufficient room; if none has room, a bin is opened.

The permitted lengths are optimised together: the shard is packed once under
each opening rule (always the same length where it is long enough, the least
one that takes the item, and the length with the least cost per word if filled
with items like this one), every bin is then downsized to the least permitted
length that holds its contents, and the cheapest result stays.

A shard's loss against one packing of everything is below its last, partly
filled bins, and shards are as many as the items ask for, so no task grows with
the table.  The item table (ids and lengths, no texts) is written to the shared
folder before it is dealt, so a retried task sees the same shards.

Defined cases: null, empty and wordless texts have no words and are not packed;
null ids are packed and stay null; repeated rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.arrays import Words, pieces
from wordloom.llm.frames import arrow_map, materialize, texts
from wordloom.session import ship_package

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_ITEMS = 8192


def fit(sizes: Sequence[int], opening: Callable[[int], int]) -> tuple[list[int], list[int]]:
    """Best fit of ``sizes`` in the order given: (bin of each size, capacity each bin was opened with).

    Open bins are kept by room; the bits of an integer tell which rooms occur,
    so the least sufficient room is its lowest bit from the size upwards.
    """
    by_room: dict[int, list[int]] = {}
    rooms, where, opened = 0, [], []
    for size in sizes:
        up = rooms >> size
        if up:
            room = size + (up & -up).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms &= ~(1 << room)
        else:
            b, room = len(opened), opening(size)
            opened.append(room)
        left = room - size
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
        where.append(b)
    return where, opened


def pack(sizes: np.ndarray, lengths: Sequence[int], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each size, length of each bin) of the cheapest packing found; ``sizes`` in decreasing order."""
    lengths = sorted(lengths)
    rules = [lambda s, c=c: next(x for x in lengths if x >= max(s, c)) for c in lengths]
    rules.append(lambda s: min((x for x in lengths if x >= s), key=lambda x: (cost(x) / (s * (x // s)), -x)))
    prices = np.array([cost(x) for x in lengths])
    best = None
    for rule in rules:
        where, opened = fit(sizes.tolist(), rule)
        filled = np.bincount(where, weights=sizes, minlength=len(opened)).astype(np.int64)
        down = np.searchsorted(lengths, filled)
        price = prices[down].sum()
        if best is None or price < best[0]:
            best = (price, np.array(where), np.array(lengths)[down])
    return best[1], best[2]


def items(docs: DataFrame, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, size)``: documents as items of at most ``longest`` words, end mark included."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros(batch.num_rows, dtype=np.int64)
        for p in pieces(batch.column(1)):
            n[p.lo:p.hi] = Words(p).counts
        n = np.where(n > 0, n + 1, 0)
        parts = -(-n // longest)
        row = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(n[row] - piece * longest, longest)
        return pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(piece), pa.array(piece * longest), pa.array(size)],
                               names=["id", "piece", "start", "size"])

    return arrow_map(texts(docs, id_col, text_col), fn, "id long, piece long, start long, size long")


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = float,
                   shard_items: int = SHARD_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per item: ``id, piece, start, size, bin, bin_length, place`` (first word of the item within its bin)."""
    if not lengths or min(lengths) < 1:
        raise ValueError("lengths must be positive")
    spark = docs.sparkSession
    ship_package(spark)
    lengths = tuple(sorted(set(lengths)))
    rows = materialize(items(docs, lengths[-1], id_col, text_col).withColumn("own", F.monotonically_increasing_id()), spark, "items")
    shards = max(1, -(-rows.count() // shard_items))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece", "own"], ascending=[False, True, True, True])
        where, length = pack(pdf["size"].to_numpy(), lengths, cost)
        pdf = pdf.assign(bin=where + (pdf["shard"].to_numpy() << 32), bin_length=length[where])
        pdf["place"] = pdf.groupby("bin")["size"].cumsum() - pdf["size"]
        return pdf[["id", "piece", "start", "size", "bin", "bin_length", "place"]]

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("own"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(
        shard, "id long, piece long, start long, size long, bin long, bin_length long, place long")
