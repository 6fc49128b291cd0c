"""Near-duplicate groups by a Jaccard join over word shingles with adaptive prefixes.

A document's set holds its distinct ``n``-word shingles (fewer words: the whole
sequence as one).  Two documents link when ``100 |A & B| >= threshold |A | B|``.

* **Classes.**  Equal sets are one node (a 64-bit key of the set), so copies
  never form pairs.
* **Order.**  Shingles are ordered by estimated frequency, then by hash.  The
  estimate counts all shingles of all documents into a fixed number of buckets,
  so the table that tasks share has a fixed size; any order gives the same links.
* **Adaptive prefixes.**  Sets of size ``s`` that link share at least
  ``need = ceil(threshold s / 100)`` shingles, hence at least ``l`` of their first
  ``s - need + l``.  A document starts with ``l = 1`` and lengthens its prefix
  while the estimated cost of its candidates falls: the shingles to post, plus
  the candidates that the frequencies promise over ``l``.  A pair needs
  ``min(l, l')`` common prefix shingles before it is verified.
* **Stars first.**  Every posting list first proposes only its nodes against
  one of them, the list's pivot; verified links give components.
* **Nearest next.**  Lists that still hold several components propose, per node,
  the few nodes of other components whose sketches are nearest.  In a group of
  near copies these link, so the group becomes one component by a number of
  pairs in proportion to its nodes.
* **The rest.**  Lists that even then hold several components propose every
  pair across components, in blocks, so that no link is lost.
* **Bounds before sets.**  A node's sketch is the parity, per hashed bit, of its
  shingles.  The bits in which two sketches differ bound the symmetric difference
  from below, so most pairs fall before their sets are fetched; none that links
  falls.

Shingles and sets are compared by 64-bit hashes.

Defined cases: null, empty and wordless texts have an empty set and link with
nothing; repeated rows fall in one class; rows with a null id take part, but give
no component its id (their own is null if they are alone).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.arrays import FOLD, Words, mix, pieces, signed
from wordloom.llm.components import components
from wordloom.llm.frames import arrow_map, fresh, keyed, materialize, split_join, unkey, with_row
from wordloom.session import ship_package

SHINGLE = 5
THRESHOLD = 80
BUCKET_BITS = 18
SKETCH_WORDS = 16
MOST = 12                  # the longest multi-match
VERIFY_COST = 20           # cost of a candidate, in postings
STARS = 3                  # pivots, and then nearest nodes, that a node is verified against before the rest
PAIRS_HELD = 1 << 19       # pairs of a task among which a node's nearest are chosen
LIST_BLOCK = 1024          # nodes of a posting list compared at once
BITMAP_BITS = 21
LOW_LISTS = 8
NO_LIST = (1 << 63) - 1


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, row offsets): the distinct shingles of each row of a piece, in hash order."""
    at, h = w.windows(n)
    row = w.row[at] if len(at) else at
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    h = np.concatenate([h, w.range_hash(w.first[short], w.first[short + 1])])
    row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[first], row[first]
    return h, np.searchsorted(row, np.arange(w.piece.rows + 1))


def set_keys(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit key of each set: order-free, as the sum of mixed shingle hashes."""
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xA0761D6478BD642F)), out=sums[1:])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def sketch(h: np.ndarray) -> bytes:
    """Parity of the shingles in each of ``64 * SKETCH_WORDS`` bits."""
    bit = np.bincount((h >> np.uint64(20)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bit.astype(np.uint8)).tobytes()


def needed(size, threshold: int):
    """Shingles of a set of ``size`` that every linked set shares at least."""
    return -(-threshold * size // 100)


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """Rows ``(kind, a, b, c, sketch)``: 0, id, set size, set key, sketch of every row; 1, bucket, count per task."""
    ship_package(docs.sparkSession)
    names = ["kind", "a", "b", "c", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            size, key, marks = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for p in pieces(batch.column(1)):
                h, offsets = shingles(Words(p, fold=FOLD), n)
                size[p.lo:p.hi], key[p.lo:p.hi] = np.diff(offsets), signed(set_keys(h, offsets))
                counts += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
                marks += [sketch(h[x:y]) for x, y in zip(offsets, offsets[1:])]
            yield pa.record_batch([pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(0), pa.array(size), pa.array(key),
                                   pa.array(marks, pa.binary())], names=names)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.ones(len(used), np.int32)), pa.array(used), pa.array(counts[used]), pa.array(np.zeros(len(used), np.int64)),
                               pa.nulls(len(used), pa.binary())], names=names)

    return docs.mapInArrow(run, "kind int, a long, b long, c long, sketch binary")


def frequencies(profile: DataFrame) -> np.ndarray:
    """Shingles per bucket over all documents; the array has a fixed size."""
    got = profile.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    out[np.asarray(got["a"].combine_chunks())] = np.asarray(got["n"].combine_chunks())
    return out


def prefixes(h: np.ndarray, offsets: np.ndarray, counts: np.ndarray, usual: float, threshold: int):
    """(shingle, row, multi-match of its row) of every prefix shingle of the sets."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    often = counts[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    order = np.lexsort((h, often, row))
    h, often = h[order], often[order]
    others = np.concatenate([[0], np.cumsum(np.maximum(0, often - usual))])   # documents that share a shingle, estimated
    size = np.diff(offsets)
    base = size - needed(size, threshold)
    best, cost = np.ones(len(size), np.int64), np.full(len(size), np.inf)
    for many in range(1, MOST + 1):
        length = np.minimum(base + many, size)
        shared = others[offsets[:-1] + length] - others[offsets[:-1]]
        now = length + shared + VERIFY_COST * shared / many
        better = (now < cost) & (base + many <= size)
        best, cost = np.where(better, many, best), np.where(better, now, cost)
    place = np.arange(len(h)) - offsets[:-1][row]
    take = place < np.minimum(base + best, size)[row]
    return h[take], row[take], best[row[take]]


def _postings(docs: DataFrame, n: int, threshold: int, counts: np.ndarray) -> DataFrame:
    """``(h, k, n, l)``: prefix shingles of the sets; copies of a set within a batch post once."""
    some = counts[counts > 0]
    middle = float(np.median(some)) if len(some) else 0.0
    shared = docs.sparkSession.sparkContext.broadcast((counts, middle + 4 * middle ** 0.5))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, usual = shared.value
        cols, seen = [[], [], [], []], np.zeros(0, np.uint64)
        for p in pieces(batch.column(1)):
            h, offsets = shingles(Words(p, fold=FOLD), n)
            key, size = set_keys(h, offsets), np.diff(offsets)
            _, first = np.unique(key, return_index=True)
            new = np.zeros(len(key), dtype=bool)
            new[first] = True
            new &= (size > 0) & ~np.isin(key, seen)
            seen = np.concatenate([seen, key[new]])
            token, row, many = prefixes(h, offsets, counts, usual, threshold)
            live = new[row]
            for have, more in zip(cols, (signed(token[live]), signed(key)[row[live]], size[row[live]].astype(np.int32), many[live].astype(np.int32))):
                have.append(more)
        return pa.record_batch([pa.array(np.concatenate(c)) for c in cols], names=["h", "k", "n", "l"])

    return arrow_map(docs, fn, "h long, k long, n int, l int")


def _shared_lists(postings: DataFrame) -> DataFrame:
    """The postings of shingles that two or more nodes post, with a pivot per list: ``h, k, n, l, pk, pn, pl``.

    The pivot is the list's node of least mixed key, in one order for all lists:
    the lists of a group agree on a pivot, so a node's lists with it tell how many
    prefix shingles the two have in common.  Lists are read as sorted runs; only a
    run's first rows are held from one batch to the next.
    """
    names = ["h", "k", "n", "l", "pk", "pn", "pl"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pivot = None, None           # the last row so far, and its list's pivot (None: the list has one node so far)

        def emit(h, k, n, l, at):
            return pa.record_batch([*(pa.array(x) for x in (h, k, n, l)), pa.array(k[at]), pa.array(n[at]), pa.array(l[at])], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            h, k, n, l = (np.asarray(batch.column(i)) for i in range(4))
            going_on = held is not None
            if going_on:
                h, k, n, l = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(held, (h, k, n, l)))
            last_pivot = pivot
            head = np.ones(len(h), dtype=bool)
            head[1:] = h[1:] != h[:-1]
            start = np.flatnonzero(head)
            run_no = np.cumsum(head) - 1
            new = np.ones(len(h), dtype=bool)
            new[1:] = head[1:] | (k[1:] != k[:-1])
            nodes = np.bincount(run_no[new], minlength=len(start))
            many = nodes > 1
            if last_pivot is not None:
                many[0] = True
            at = start[run_no]
            out = [pa.array(x) for x in (h, k, n, l)]
            pk, pn, pl = k[at], n[at], l[at]
            if last_pivot is not None:                                # the first run's pivot came with an earlier batch
                of_first = run_no == 0
                pk, pn, pl = (np.where(of_first, np.array(v, x.dtype), x) for v, x in zip(last_pivot, (pk, pn, pl)))
                new[0] = False                                        # its held row is out already
            rows = np.flatnonzero(new & many[run_no])
            if len(rows):
                yield pa.record_batch([*(x.take(pa.array(rows)) for x in out), *(pa.array(x[rows]) for x in (pk, pn, pl))], names=names)
            held = (h[-1], k[-1], n[-1], l[-1])
            tail = start[-1]
            pivot = (pk[tail], pn[tail], pl[tail]) if many[-1] else None
        return

    sortable = postings.withColumn("o", F.xxhash64("k"))
    return sortable.repartition("h").sortWithinPartitions("h", "o", "k").select("h", "k", "n", "l") \
        .mapInArrow(run, "h long, k long, n int, l int, pk long, pn int, pl int")


def _near(n: str, m: str, threshold: int):
    """Sizes that allow a link."""
    return (F.col(n) * 100 >= F.col(m) * threshold) & (F.col(m) * 100 >= F.col(n) * threshold)


def _star_pairs(rows: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The likeliest pairs ``(a, b)`` of a node and a pivot of its lists: ``rows`` has ``k, n, l, pk, pn, pl``."""
    stars = rows.where(_near("n", "pn", threshold)).groupBy(F.col("k").alias("a"), F.col("pk").alias("b")).agg(
        F.count(F.lit(1)).alias("common"), F.min("n").alias("na"), F.min("pn").alias("nb"))
    closest = Window.partitionBy("a").orderBy(F.desc("common"), "b")
    stars = stars.withColumn("place", F.row_number().over(closest)).where(F.col("place") <= STARS).select("a", "b", "na", "nb")
    return _sketched(stars, sketches, threshold).select("a", "b")


def _rooted(lists: DataFrame, links: DataFrame, spark: SparkSession) -> DataFrame:
    """The lists that hold several components of ``links``: ``h, k, n, l, root, size``."""
    held = lists.join(components(links).withColumnRenamed("node", "k"), "k", "left").select("h", "k", "n", "l", F.coalesce("root", "k").alias("root"))
    held = materialize(held, spark, "held")
    mixed = held.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    return materialize(held.join(mixed.select("h", "size"), "h"), spark, "mixed")


def _sketched(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sketches allow a link: ``a, b, gap``."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
        gap = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)
        both = np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))
        good = np.flatnonzero(gap * (100 + threshold) <= both * (100 - threshold))
        return pa.record_batch([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(gap[good])],
                               names=["a", "b", "gap"])

    with_both = pairs.join(sketches.select(F.col("k").alias("a"), F.col("sketch").alias("sa")), "a") \
        .join(sketches.select(F.col("k").alias("b"), F.col("sketch").alias("sb")), "b")
    return arrow_map(with_both.select("a", "b", "na", "nb", "sa", "sb"), fn, "a long, b long, gap long")


def _sets(docs: DataFrame, sizes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``(k, hashes)``: the whole sets of the ``wanted`` nodes ``k``.

    One document per node brings the set.  The documents are scanned where they
    lie; a bitmap of fixed size over the wanted ids spares most others the
    work, and only sets move.
    """
    spark = docs.sparkSession
    owners = materialize(sizes.where("n > 0").join(wanted, "k", "left_semi").groupBy("k").agg(F.min("id").alias("id")), spark, "owners")
    bucket = F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS))
    live = np.zeros(1 << BITMAP_BITS, dtype=bool)
    live[np.asarray(owners.select(bucket.alias("b")).distinct().toArrow()["b"].combine_chunks())] = True
    shared = spark.sparkContext.broadcast(live)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(shared.value[np.asarray(batch.column(2))]))
        key, hashes = [np.zeros(0, np.int64)], []
        for p in pieces(batch.column(1)):
            h, offsets = shingles(Words(p, fold=FOLD), n)
            key.append(signed(set_keys(h, offsets)))
            hashes += [h[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
        return pa.record_batch([batch.column(0), pa.array(np.concatenate(key)), pa.array(hashes, pa.binary())], names=["id", "k", "hashes"])

    found = arrow_map(docs.select("id", "text", bucket.alias("b")), fn, "id long, k long, hashes binary")
    return materialize(found.join(owners, ["id", "k"], "left_semi").dropDuplicates(["k"]).select("k", "hashes"), spark, "sets")


def _verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs ``(a, b)`` that link, by their whole sets."""
    pairs = materialize(pairs.select("a", "b"), docs.sparkSession, "pairs")
    sets = _sets(docs, sizes, pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), n)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= threshold * (len(x) + len(y) - common):
                good.append(i)
        at = pa.array(good, pa.int64())
        return pa.record_batch([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    with_both = pairs.select("a", "b").join(sets.select(F.col("k").alias("a"), F.col("hashes").alias("sa")), "a") \
        .join(sets.select(F.col("k").alias("b"), F.col("hashes").alias("sb")), "b")
    return arrow_map(with_both.select("a", "b", "sa", "sb"), fn, "a long, b long")


def _dealt(held: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of ``held`` in pairs of blocks of their lists, as :func:`_across` reads them."""
    parts = held.withColumn("blocks", F.ceil(F.col("size") / LIST_BLOCK).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return parts.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("half"),
                        "k", "n", "l", "root").join(sketches, "k").select("h", "i", "j", "half", "k", "n", "l", "root", "sketch", "low")


def nearest_of(a: np.ndarray, b: np.ndarray, gap: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the pairs that are among the ``most`` of least gap of one of their nodes."""
    node, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((other, np.tile(gap, 2), node))
    new = np.append(True, node[order][1:] != node[order][:-1])[:len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return np.unique(order[place < most] % max(len(a), 1))


def _nearest(pairs: DataFrame) -> DataFrame:
    """``(a, b)``: every node's nearest of the pairs ``(a, b, gap)``."""
    pairs = pairs.distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap"))
    closest = Window.partitionBy("a").orderBy("gap", "b")
    return both.withColumn("place", F.row_number().over(closest)).where(F.col("place") <= STARS) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(lists: DataFrame, threshold: int, most: int | None = None) -> DataFrame:
    """Pairs across components within posting lists, sizes and sketches allowing: ``a, b``.

    With ``most``, ``a, b, gap`` of the pairs among the so many of least gap of one
    of their nodes, from block to block.

    ``lists`` has ``h, i, j, half, k, n, l, root, sketch, low``: the rows of the
    blocks ``i <= j`` of list ``h``; at most two blocks are held.  ``low`` are the
    node's least lists: a pair comes from the least list that both have among
    them, so hardly any pair comes twice, and fails if both nodes' lists are
    all known and too few are common.
    """
    def arrays(t: pa.Table):
        t = t.combine_chunks()
        k, n, l, root = (np.asarray(t[c].combine_chunks()) for c in ("k", "n", "l", "root"))
        marks = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint64).reshape(len(k), SKETCH_WORDS)
        low = np.asarray(t["low"].combine_chunks().flatten()).reshape(len(k), LOW_LISTS)
        return k, n.astype(np.int64), l, root, marks, low, np.asarray(t["h"].combine_chunks())

    def likely(x: np.ndarray, y: np.ndarray, k, n, l, root, marks, low, h):
        """The pairs of rows ``x, y`` across components that sizes and sketches allow and no lesser list of both has."""
        ok = (root[x] != root[y]) & (n[x] * 100 >= n[y] * threshold) & (n[y] * 100 >= n[x] * threshold)
        x, y = x[ok], y[ok]
        gap = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1).astype(np.int64)
        ok = gap * (100 + threshold) <= (n[x] + n[y]) * (100 - threshold)
        x, y, gap = x[ok], y[ok], gap[ok]
        both = (low[x][:, :, None] == low[y][:, None, :]) & (low[x] < NO_LIST)[:, :, None]
        lesser = (both & (low[x] < h[x][:, None])[:, :, None]).any(axis=(1, 2))
        known = (low[x][:, -1] == NO_LIST) & (low[y][:, -1] == NO_LIST)      # all lists of both nodes
        few = known & (both.sum(axis=(1, 2)) < np.minimum(l[x], l[y]))
        x, y, gap = (v[~lesser & ~few] for v in (x, y, gap))
        return np.minimum(k[x], k[y]), np.maximum(k[x], k[y]), gap

    def inside(t: pa.Table, block: np.ndarray):
        """Pairs within blocks, for all blocks of a batch together: rows 1, 2, ... apart."""
        cols = arrays(t)
        x, apart = np.arange(len(block)), 1
        while len(x):
            x = x[x + apart < len(block)]
            x = x[block[x] == block[x + apart]]
            yield likely(x, x + apart, *cols)
            apart += 1

    def between(t: pa.Table):
        """Pairs between the two halves of one pair of blocks."""
        cols = arrays(t)
        half = np.asarray(t.combine_chunks()["half"].combine_chunks())
        right = np.flatnonzero(half == 1)
        for x in np.flatnonzero(half == 0):
            yield likely(np.full(len(right), x), right, *cols)

    def fewest(part):
        """The nearest of a part's pairs; a bounded number of pairs is held."""
        own, size = [], 0
        for pairs in part:
            own.append(pairs)
            size += len(pairs[0])
            if size > PAIRS_HELD:
                cols = [np.concatenate(x) for x in zip(*own)]
                at = nearest_of(*cols, most)
                own, size = [], 0
                yield [x[at] for x in cols]
        cols = [np.concatenate(x) for x in zip(*own)] if own else [np.zeros(0, np.int64)] * 3
        at = nearest_of(*cols, most)
        yield [x[at] for x in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = [np.asarray(t[c].combine_chunks()) for c in ("h", "i", "j")]
            new = np.ones(t.num_rows, dtype=bool)
            new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
            block = np.cumsum(new)
            one = key[1] == key[2]
            parts = [inside(t.filter(pa.array(one)), block[one])] if one.any() else []
            parts += [between(t.filter(pa.array(block == b))) for b in np.unique(block[~one])]
            for part in parts:
                for pairs in part if most is None else fewest(part):
                    if len(pairs[0]):
                        yield pa.record_batch([pa.array(x) for x in pairs], names=["a", "b", "gap"])

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [np.asarray(batch.column(c)) for c in range(3)]
            last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0               # the last block may go on in the next batch
            if cut or (rest and any(rest[-1].column(c)[-1].as_py() != key[c][0] for c in range(3))):
                yield from solve(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield from solve(pa.Table.from_batches(rest))

    pairs = lists.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "half", "k").mapInArrow(run, "a long, b long, gap long")
    return pairs if most else pairs.select("a", "b")


def groups(docs: DataFrame, n: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row; the component is named by its smallest id."""
    spark = docs.sparkSession
    t = keyed(docs, id_col, text_col)
    profile = materialize(_profile(t, n), spark, "profile")
    sizes = profile.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("c").alias("k"))
    lists = materialize(_shared_lists(_postings(t, n, threshold, frequencies(profile))), spark, "lists")

    own = F.concat(F.array_sort(F.collect_set("h")), F.array_repeat(F.lit(NO_LIST), LOW_LISTS))
    low = lists.groupBy("k").agg(F.slice(own, 1, LOW_LISTS).alias("low"))
    nodes = profile.where("kind = 0 AND b > 0").select(F.col("c").alias("k"), "sketch").join(low, "k")
    sketches = materialize(nodes.dropDuplicates(["k"]), spark, "sketches")

    # stars: every node against the pivots of its lists, and the likeliest of them verified
    first = _star_pairs(lists.where("k <> pk"), sketches, threshold)
    links = materialize(_verified(first, t, sizes, n, threshold), spark, "links")
    held = _rooted(lists, links, spark)

    # nearest: what a group's stars left apart, every node against the likeliest of other components
    near = _nearest(_across(_dealt(held, sketches), threshold, STARS))
    links = links.unionByName(materialize(_verified(near, t, sizes, n, threshold), spark, "links"))
    held = _rooted(held.select("h", "k", "n", "l"), links, spark)

    # the rest: all pairs across components in lists that still hold several of them
    rest = _across(_dealt(held, sketches), threshold).distinct()
    more = materialize(_verified(rest, t, sizes, n, threshold), spark, "links")
    roots = materialize(components(links.unionByName(more)), spark, "roots")

    rows = sizes.join(roots.withColumnRenamed("node", "k"), "k", "left").select("id", "n", F.coalesce("root", "k").alias("root"))
    named = rows.where("n > 0").groupBy("root").agg(F.min(unkey()).alias("least"))
    return split_join(rows, named, "root", "left").select(unkey().alias("id"), F.col("n").alias("n_shingles"),
                                                   F.when(F.col("n") > 0, F.col("least")).otherwise(unkey()).alias("component_id"))


def keep_one(docs: DataFrame, n: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, columns as they are: that of the smallest id, the first of rows that share it.

    Every row is a document of its own; those without id come after all others.
    """
    row = fresh("_row", docs)
    rows = with_row(docs, row)
    own = rows.select(F.col(row).alias("id"), F.col(f"`{id_col}`").cast("long").alias("doc"))
    found = groups(rows, n, threshold, row, text_col).join(own, "id")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id"))
    keep = materialize(found.groupBy("component_id").agg(first.alias("first")).select(F.col("first.id").alias(row)), docs.sparkSession, "kept")
    return rows.join(keep, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
