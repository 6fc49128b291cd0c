"""Removal of repeated and nearly repeated lines by a segment-partition edit join.

A line of at least ``least`` characters (trimmed) goes if an equal line, or one
within ``tau`` edits, comes before it; before means a smaller (id, line number, row)
of the lines' first occurrences.  Shorter lines stay.

* **Exact copies** are grouped by two 64-bit hashes of the line.
* **Candidates.**  A line of length ``l`` is cut into ``tau + 1`` even segments,
  each posted under a hash of (segment, its number, ``l``).  A line within ``tau``
  edits contains one of them unchanged, and by the multi-match argument at few
  places: segment ``i`` at most ``i - 1`` from its own place seen from the left, and
  ``tau + 1 - i`` seen from the right.  So each line probes, per length from its own
  down to ``tau`` less, a fixed list of substrings.
* **Signatures.**  Candidates whose parities of hashed character pairs differ in
  more than ``4 tau`` bits are further apart than ``tau`` edits and go first.
* **Verification.**  A bit vector per number of errors holds the diagonals of the
  edit matrix within ``tau`` of the main one that can be reached; each character
  updates all diagonals at once.

Everything is DataFrame functions.  Texts move only for lines that are
candidates.

Every row has a key of its own; ids only order lines and name them.

Defined cases: null and empty texts have no lines; null ids are smaller than all
others; rows that repeat an id, or have none, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.frames import NULL_ID, fresh, keyed, materialize, unkey, with_row

TAU = 2
LEAST = 20
BUCKET_BITS = 20


def lines(docs: DataFrame, least: int) -> DataFrame:
    """``(row, id, line_no, line, n)``: the trimmed lines of at least ``least`` characters of ``(row, id, text)``."""
    t = docs.select("row", "id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return t.select("row", "id", "line_no", F.trim("line").alias("line")).withColumn("n", F.char_length("line")).where(F.col("n") >= least)


def _key(line: Column, start: Column, size: Column, i: int, length: Column) -> Column:
    return F.xxhash64(F.substring(line, start, size), F.lit(i), length)


def _segment(length: Column, tau: int, i: int) -> tuple[Column, Column]:
    """(1-based start, size) of segment ``i`` (from 1) of a line of ``length``: the last segments take what is left over."""
    size = F.floor(length / (tau + 1)).cast("int")
    short = F.lit(tau + 1) - length % (tau + 1)                     # segments of the lesser size
    start = size * (i - 1) + F.greatest(F.lit(i - 1) - short, F.lit(0)) + 1
    return start.cast("int"), (size + (F.lit(i) > short).cast("int")).cast("int")


def posted(tau: int, line: Column, n: Column) -> Column:
    """Keys of a line's own segments."""
    return F.array(*(_key(line, *_segment(n, tau, i), i, n) for i in range(1, tau + 2)))


def probes(tau: int, line: Column, n: Column) -> Column:
    """``(key, even)``: keys of the substrings that can equal a segment of a line that is ``0 .. tau`` shorter; ``even`` for 0."""
    out = []
    for less in range(tau + 1):
        length = n - less
        for i in range(1, tau + 2):
            start, size = _segment(length, tau, i)
            lo, hi = max(-(i - 1), less - (tau + 1 - i)), min(i - 1, less + tau + 1 - i)
            out += [F.struct(_key(line, start + off, size, i, length).alias("key"), F.lit(less == 0).alias("even")) for off in range(lo, hi + 1)]
    return F.array(*out)


def signature(chars: Column) -> Column:
    """64 parities of hashed character pairs; an edit changes at most four of them."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("bits"))

    def step(state: Column, c: Column) -> Column:
        one = F.lit(1).cast("long")
        at = F.pmod(F.xxhash64(state["last"], c), F.lit(64)).cast("int")
        return F.struct(c.alias("last"), state["bits"].bitwiseXOR(F.call_function("shiftleft", one, at)).alias("bits"))

    return F.aggregate(chars, start, step, lambda state: state["bits"])


def within(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two character arrays if at most ``tau``, else null.

    Bit ``d + tau`` of the vector of ``k`` errors says that ``a`` up to ``j + d`` can
    be turned into ``b`` up to ``j`` with ``k`` errors.
    """
    def equal_bits(c: Column, j: Column) -> Column:
        bits = [F.when(F.get(a, j + d) == c, F.lit(1 << (d + tau))).otherwise(0) for d in range(-tau, tau + 1)]
        out = bits[0]
        for x in bits[1:]:
            out = out.bitwiseOR(x)
        return out

    band = (1 << (2 * tau + 1)) - 1
    names = [f"e{k}" for k in range(tau + 1)]
    start = F.struct(*(F.lit(sum(1 << (tau + d) for d in range(k + 1))).alias(x) for k, x in enumerate(names)))

    def step(state: Column, same: Column) -> Column:
        new: list[Column] = []
        for k, x in enumerate(names):
            now = state[x].bitwiseAND(same)
            if k:
                before = state[names[k - 1]]
                now = now.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(band))
            new.append(now)
        return F.struct(*(c.alias(x) for c, x in zip(new, names)))

    def least(state: Column) -> Column:
        place = F.size(a) - F.size(b) + tau
        bits = [F.array(*(F.shiftright(state[x], p).bitwiseAND(F.lit(1)) for p in range(2 * tau + 1))) for x in names]
        return F.coalesce(*(F.when(F.get(own, place) == 1, F.lit(k)) for k, own in enumerate(bits)))

    return F.when(F.abs(F.size(a) - F.size(b)) <= tau, F.aggregate(F.transform(b, equal_bits), start, step, least))


def _bucket(h: str = "h") -> Column:
    return F.pmod(F.col(h), F.lit(1 << BUCKET_BITS))


def _buckets(rows: DataFrame) -> DataFrame:
    """The buckets that hashes ``h`` fall in: at most ``2 ** BUCKET_BITS`` rows, so they may be broadcast."""
    return F.broadcast(rows.select(_bucket().alias("bucket")).distinct())


def candidates(own: DataFrame, repeated: DataFrame, tau: int) -> DataFrame:
    """``(a, b)``: hashes of different lines that have a segment in common at places ``tau`` edits allow.

    ``own`` has the lines ``(h, line, n)``, ``repeated`` the hashes of lines that
    occur more than once.  Only lines in the buckets of those are made distinct;
    the others post their keys from where they lie.
    """
    in_bucket = _bucket() == F.col("bucket")
    once = own.join(_buckets(repeated), in_bucket, "left_anti").select("h", "line", "n")
    more = own.join(_buckets(repeated), in_bucket, "left_semi").groupBy("h").agg(F.min("line").alias("line"), F.min("n").alias("n"))
    distinct = once.unionByName(more)
    index = distinct.select("h", F.explode(posted(tau, F.col("line"), F.col("n"))).alias("key"))
    probe = distinct.select(F.col("h").alias("other"), F.inline(probes(tau, F.col("line"), F.col("n"))))
    # lines of one length find each other both ways; one is enough
    return index.join(probe, "key").where("h < other OR (h > other AND NOT even)").select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()


def duplicates(docs: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """``(row, id, line_no, of_id, of_line_no, distance)`` of every line of ``(row, id, text)`` that goes, and the line it repeats."""
    if tau < 1 or least < 2 * (tau + 1):
        raise ValueError("tau must be at least 1, and lines long enough for segments of two characters")
    spark = docs.sparkSession
    own = lines(docs, least).withColumn("h", F.xxhash64("line"))
    places = own.select("row", "id", "line_no", "h", F.xxhash64("line", F.lit(1)).alias("g"))
    first = materialize(places.groupBy("h", "g").agg(F.min(F.struct("id", "line_no", "row")).alias("first"), F.count(F.lit(1)).alias("copies")), spark, "firsts")

    pairs = materialize(candidates(own, first.where("copies > 1"), tau), spark, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    texts = own.select("h", "line").join(_buckets(wanted), _bucket() == F.col("bucket"), "left_semi") \
        .groupBy("h").agg(F.min("line").alias("line")).join(wanted, "h", "left_semi")
    chars = F.split("line", "")
    chars = materialize(texts.select("h", chars.alias("chars"), signature(chars).alias("bits")), spark, "candidates")
    likely = pairs.join(chars.select(F.col("h").alias("a"), F.col("bits").alias("ba")), "a") \
        .join(chars.select(F.col("h").alias("b"), F.col("bits").alias("bb")), "b") \
        .where(F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))) <= 4 * tau).select("a", "b")
    near = likely.join(chars.select(F.col("h").alias("a"), F.col("chars").alias("ca")), "a") \
        .join(chars.select(F.col("h").alias("b"), F.col("chars").alias("cb")), "b") \
        .select("a", "b", within(F.col("ca"), F.col("cb"), tau).alias("distance")).where("distance IS NOT NULL")
    near = materialize(near, spark, "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    firsts = first.join(both.select(F.col("a").alias("h")).distinct(), "h", "left_semi").groupBy("h").agg(F.min("first").alias("first"))
    earlier = both.join(firsts.select(F.col("h").alias("a"), "first"), "a").join(firsts.select(F.col("h").alias("b"), F.col("first").alias("of")), "b") \
        .where("of < first").groupBy(F.col("a").alias("h")).agg(F.min(F.struct("of", "distance")).alias("near"))
    known = first.join(earlier, "h", "left").where("copies > 1 OR near IS NOT NULL").select("h", F.col("g").alias("g0"), "first", "near")
    gone = places.join(_buckets(known), _bucket() == F.col("bucket"), "left_semi").join(known, "h").where("g = g0") \
        .where(F.col("near").isNotNull() | (F.struct("id", "line_no", "row") != F.col("first")))
    of = F.coalesce(F.col("near.of"), F.col("first"))
    return gone.select("row", "id", "line_no", of["id"].alias("of_id"), of["line_no"].alias("of_line_no"), F.coalesce("near.distance", F.lit(0)).alias("distance"))


def report(docs: DataFrame, tau: int = TAU, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`duplicates` of a table, with its ids."""
    found = duplicates(with_row(keyed(docs, id_col, text_col)), tau, least).drop("row")
    return found.withColumn("id", unkey()).withColumn("of_id", unkey("of_id"))


def remove_lines(docs: DataFrame, tau: int = TAU, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
                 size_col: str | None = "n_chars") -> DataFrame:
    """The rows without the lines that go, columns as they are; rows that lose every line go.

    ``size_col``, if the table has it, becomes the new number of characters.
    """
    row, lines_gone, left = (fresh(c, docs) for c in ("_row", "_gone", "_kept"))
    rows = with_row(docs, row)
    own = rows.select(F.col(row).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"),
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    gone = duplicates(own, tau, least).groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(lines_gone))
    kept = F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda _, i: ~F.array_contains(F.col(lines_gone), i))
    changed = F.col(lines_gone).isNotNull()
    both = rows.join(gone, row, "left").withColumn(left, F.when(changed, kept))
    text = F.when(changed, F.array_join(left, "\n")).otherwise(F.col(f"`{text_col}`"))
    out = {text_col: text}
    if size_col in docs.columns:
        out[size_col] = F.when(changed, F.char_length(text)).otherwise(F.col(f"`{size_col}`")).cast(docs.schema[size_col].dataType)
    some_left = ~changed | F.exists(left, lambda x: F.trim(x) != "")
    return both.where(some_left).select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns))
