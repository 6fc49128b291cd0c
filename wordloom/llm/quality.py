"""Quality rules: countable text statistics and an n-gram perplexity band per language.

The perplexity comes from character (byte) models of order ``ORDER`` with
interpolated, modified Kneser-Ney smoothing, counted by Spark over every document
that passes the countable rules: raw counts of the longest n-grams, below them the
number of distinct left neighbours, three discounts per order from the counts of
counts.  Every n-gram counts.  A language has two models, one per fold of its
texts' hashes, and a text is scored by the model of the other fold: neither it
nor its copies, which share its fold, vouch for it.

A model is sorted arrays of hashes with one value each, in blocks of about
``MODEL_ROWS`` values that are broadcast one after the other: all values of an
n-gram of two or more bytes are in the block of its model and last byte but one.
A text's bits are the sum over the blocks.

A document is rejected outside its language's band: the median of the bits per
byte over all documents of the language that pass the rules, less or plus
``below`` / ``above`` scaled median deviations, and no nearer than ``least_below`` / ``least_above``
bits.

Whitespace counts as a space and every digit as 0; the first bytes of a text,
which have no full context, are not scored.

Defined cases: null and empty texts have no words and fail the rules; a null
language is a language of its own; texts whose other
fold has no model (a language with one text, say) have no bits and are judged by
the rules alone; null ids are kept as null; repeated rows give one row each;
very long texts are scored whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.arrays import NOT_SPACE, Words, in_sorted, mix, pieces, signed
from wordloom.llm.frames import arrow_map, materialize

ORDER = 4
MODEL_ROWS = 1 << 22
BELOW, ABOVE, LEAST_BELOW, LEAST_ABOVE = 6.0, 4.0, 0.25, 0.1
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_FOLD = np.where(NOT_SPACE, np.arange(256), 32).astype(np.uint8)
_FOLD[48:58] = 48


def rules(p) -> dict[str, np.ndarray]:
    """The countable statistics of a piece's rows."""
    w = Words(p)
    data, offs = p.data[:-8], p.offsets

    def per_row(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(marks)])[offs])

    starts = (data & 0xC0) != 0x80                                  # first bytes of code points
    at, h = w.windows(3)
    own = w.row[at] if len(at) else at
    key = mix(h ^ (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 3, -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    dup_lines = np.zeros(p.rows, dtype=np.int64)
    raw = data.tobytes()
    for r, (a, b) in enumerate(zip(offs.tolist(), offs[1:].tolist())):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
        dup_lines[r] = len(lines) - len(set(lines))
    out = {"n_words": w.counts, "word_chars": per_row(NOT_SPACE[data] & starts), "n_symbols": per_row(SYMBOLS[data]),
           "n_dup_lines": dup_lines, "n_repeat_words": np.diff(repeated[w.first])}
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    return out


def grams(p, order: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of every full n-gram of a piece (of the marked rows); the last byte is the lowest."""
    data = _FOLD[p.data[:-8]].astype(np.uint64)
    if len(data) < order:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = data[order - 1:].copy()
    for back in range(1, order):
        code |= data[order - 1 - back:len(data) - back] << np.uint64(8 * back)
    row = np.repeat(np.arange(p.rows), np.diff(p.offsets))
    full = row[order - 1:] == row[:len(row) - order + 1]
    if rows is not None:
        full &= rows[row[order - 1:]]
    return code[full], row[order - 1:][full]


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """``(lang, k, g, c)``: occurrences of the n-grams of every order ``k`` over the documents ``(id, text, lang)`` that pass the rules."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, lang = np.unique(np.array(batch.column(2).to_pylist(), dtype=object).astype(str), return_inverse=True)
        cols = [[np.zeros(0, np.int64)] for _ in range(4)]
        for p in pieces(batch.column(1)):
            fair = ~rules(p)["base_failed"]
            for k in range(1, order + 1):
                code, row = grams(p, k, fair)
                key, c = np.unique((lang[p.lo + row].astype(np.uint64) << np.uint64(8 * k)) | code, return_counts=True)
                found = (key >> np.uint64(8 * k), np.full(len(key), k), key & np.uint64((1 << 8 * k) - 1), c)
                for have, more in zip(cols, found):
                    have.append(more.astype(np.int64))
        lang, k, g, c = (np.concatenate(x) for x in cols)
        return pa.record_batch([pa.array(names, pa.string()).take(pa.array(lang)), pa.array(k.astype(np.int32)), pa.array(g), pa.array(c)],
                               names=["lang", "k", "g", "c"])

    return arrow_map(docs, fn, "lang string, k int, g long, c long").groupBy("lang", "k", "g").agg(F.sum("c").alias("c"))


def _level(counts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(entries ``lang, k, g, v``, contexts ``lang, k, g, v``) of one order from its counts ``(lang, g, c)``."""
    n = counts.groupBy("lang").agg(*(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(i: int):
        d = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        fit = (F.col("n1") > 0) & (F.col(f"n{i}") > 0)
        return F.when(fit, F.greatest(F.lit(0.0), F.least(d, F.lit(float(i))))).otherwise(0.5)

    n = n.select("lang", *(discount(i).alias(f"d{i}") for i in (1, 2, 3)))
    rows = counts.withColumn("h", F.shiftrightunsigned("g", 8)).join(F.broadcast(n), "lang") \
        .withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    sums = rows.groupBy("lang", "h").agg(F.sum("c").alias("all"))
    own = rows.join(sums, ["lang", "h"])
    own = own.select("lang", "h", "g", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("all")).alias("v"))
    entries = own.select("lang", F.lit(k).alias("k"), "g", "v")
    contexts = own.groupBy("lang", "h").agg((1 - F.sum("v")).alias("v")).select("lang", F.lit(k).alias("k"), F.col("h").alias("g"), "v")
    return entries, contexts


def tag(name: Column) -> Column:
    """The number of a model in keys: 55 bits of its name's hash."""
    return F.shiftrightunsigned(F.xxhash64(name), 9)


class Model:
    """A block of the models: sorted hashes of (model, order, n-gram) with their first terms, and of contexts with their weights."""

    def __init__(self, entries: pa.Table, contexts: pa.Table, order: int, block: int, blocks: int):
        self.order, self.block, self.blocks = order, block, blocks
        self.arrays = []
        for t in (entries, contexts):
            lang, k, g = (np.asarray(t[c].combine_chunks()).astype(np.int64).view(np.uint64) for c in ("lang", "k", "g"))
            key = self.key(lang, k, g)
            at = np.argsort(key)
            self.arrays.append((key[at], np.asarray(t["v"].combine_chunks()).astype(np.float32)[at]))
            if t is entries:
                self.known = np.unique(lang[k == 1])

    @staticmethod
    def key(lang, k, g) -> np.ndarray:
        return mix(mix(g ^ (lang << np.uint64(8) | np.asarray(k, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)))

    def value(self, which: int, lang, k: int, g, absent: float) -> np.ndarray:
        keys, values = self.arrays[which]
        at = in_sorted(self.key(lang, np.uint64(k), g), keys)
        return np.where(at >= 0, values[at] if len(values) else absent, absent)

    def own(self, lang: np.ndarray, code: np.ndarray) -> np.ndarray:
        """True for the codes that this block scores."""
        middle = (code >> np.uint64(8)) & np.uint64(255) if self.order > 1 else np.uint64(0)
        return (lang + middle) % np.uint64(self.blocks) == self.block

    def bits(self, lang: np.ndarray, code: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each code's last byte after the others, in the model of that tag; all of this block."""
        p = np.full(len(code), 1 / 256)
        for k in range(1, self.order + 1):
            g = code & np.uint64((1 << 8 * k) - 1)
            p = self.value(0, lang, k, g, 0.0) + self.value(1, lang, k, g >> np.uint64(8), 1.0) * p
        return -np.log2(np.maximum(p, 1e-12))


def train(docs: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Written (entries, contexts) ``(lang, k, g, v)`` of the models of the documents ``(id, text, lang)``; ``lang`` as tags."""
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    spark = docs.sparkSession
    seen = materialize(gram_counts(docs, order), spark, "grams")
    entries = contexts = counts = None
    for k in range(order, 0, -1):
        if counts is None:
            counts = seen.where(F.col("k") == k).select("lang", "g", "c")
        else:
            counts = counts.groupBy("lang", F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        counts = materialize(counts, spark, "order")
        e, c = _level(counts, k)
        entries, contexts = (e, c) if entries is None else (entries.unionByName(e), contexts.unionByName(c))
    return tuple(materialize(x.withColumn("lang", tag(F.col("lang"))), spark, "model") for x in (entries, contexts))


def models(trained: tuple[DataFrame, DataFrame], order: int, model_rows: int = MODEL_ROWS) -> Iterator[Model]:
    """The blocks of the models, one after the other."""
    blocks = max(1, -(-sum(x.count() for x in trained) // model_rows))
    # the last byte but one of an n-gram is the last of its context; single bytes are in every block
    middles = [F.shiftrightunsigned("g", 8).bitwiseAND(255), F.col("g").bitwiseAND(255)]
    for block in range(blocks):
        own = [x.where((F.col("k") == 1) | ((F.col("lang") + m) % blocks == block)).toArrow() for x, m in zip(trained, middles)]
        yield Model(*own, order, block, blocks)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
          below: float = BELOW, above: float = ABOVE, least_below: float = LEAST_BELOW,
          least_above: float = LEAST_ABOVE, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``id``, the countable statistics, ``base_failed``, ``bits`` per byte, the band ``lo, hi`` and ``kept`` of every row."""
    spark = docs.sparkSession
    fold = F.pmod(F.xxhash64("text"), F.lit(2))
    t = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                    F.coalesce(F.concat(F.lit("="), F.col(f"`{lang_col}`").cast("string")), F.lit("")).alias("lang"))
    trained = train(t.select("id", "text", F.concat(fold.cast("string"), "lang").alias("lang")), order)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, failed = np.zeros((len(names), batch.num_rows), np.int64), np.zeros(batch.num_rows, dtype=bool)
        for p in pieces(batch.column(1)):
            found = rules(p)
            for i, name in enumerate(names):
                out[i, p.lo:p.hi] = found[name]
            failed[p.lo:p.hi] = found["base_failed"]
        return pa.record_batch([*(pa.array(x) for x in out), pa.array(failed)], names=[*names, "base_failed"])

    columns = "".join(f"{x} long, " for x in names) + "base_failed boolean, total double, n long"
    rows = t.withColumn("other", tag(F.concat((1 - fold).cast("string"), "lang")))
    for model in models(trained, order, model_rows):
        shared = spark.sparkContext.broadcast(model)

        def fn(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            model, size = shared.value, batch.num_rows
            other = np.asarray(batch.column(3)).view(np.uint64)
            known = np.isin(other, model.known)
            total, n = np.zeros(size), np.zeros(size, np.int64)
            for p in pieces(batch.column(1)):
                code, row = grams(p, model.order, known[p.lo:p.hi])
                lang = other[p.lo + row]
                own = model.own(lang, code)
                code, row, lang = code[own], row[own], lang[own]
                order = np.lexsort((code, lang))
                code, lang = code[order], lang[order]
                first = np.append(True, (code[1:] != code[:-1]) | (lang[1:] != lang[:-1]))[:len(code)]
                bits = np.empty(len(code))
                bits[order] = model.bits(lang[first], code[first])[np.cumsum(first) - 1]
                total[p.lo:p.hi] = np.bincount(row, weights=bits, minlength=p.rows)
                n[p.lo:p.hi] = np.bincount(row, minlength=p.rows)
            if model.block:
                before = batch.columns[4:-2]
                total, n = total + np.asarray(batch.column(batch.num_columns - 2)), n + np.asarray(batch.column(batch.num_columns - 1))
            else:
                before = count(batch).columns
            return pa.record_batch([*batch.columns[:4], *before, pa.array(total), pa.array(n)],
                                   names=["id", "text", "lang", "other", *names, "base_failed", "total", "n"])

        rows = arrow_map(rows, fn, f"id long, text string, lang string, other long, {columns}")
        if model.block + 1 < model.blocks:
            rows = materialize(rows, spark, "scored")
    rows = materialize(rows.withColumn("bits", F.when(F.col("n") > 0, F.col("total") / F.col("n"))).drop("text", "other", "total", "n"), spark, "bits")
    fair = rows.where(~F.col("base_failed") & F.col("bits").isNotNull())
    # one row per language
    middle = fair.groupBy("lang").agg(F.percentile_approx("bits", 0.5, 10_000).alias("mid"))
    spread = fair.join(F.broadcast(middle), "lang").groupBy("lang", "mid").agg((1.4826 * F.percentile_approx(F.abs(F.col("bits") - F.col("mid")), 0.5, 10_000)).alias("dev"))
    bands = spread.select("lang", (F.col("mid") - F.greatest(below * F.col("dev"), F.lit(least_below))).alias("lo"),
                          (F.col("mid") + F.greatest(above * F.col("dev"), F.lit(least_above))).alias("hi"))
    inside = F.coalesce(F.col("bits").between(F.col("lo"), F.col("hi")), F.lit(True))
    return rows.join(F.broadcast(bands), "lang", "left").select("id", *names, "base_failed", "bits", "lo", "hi", (~F.col("base_failed") & inside).alias("kept"))
