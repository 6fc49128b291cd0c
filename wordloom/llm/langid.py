"""Language identification by cross-parsing against suffix automata.

Per language a sample of labelled text gives a suffix automaton: the minimal
automaton of all its substrings.  A document is parsed from left to right into
phrases, each the longest prefix of the rest that occurs in the language's
sample (or one unknown symbol); a language whose sample explains the text needs
few phrases.  The number of phrases, times log2 of the sample's length and by
the number of symbols, estimates bits per symbol; the least wins.

Symbols are the bytes of the lower-cased text with every run of ASCII
non-letters as one separator (none at the start).  Texts are parsed whole, in blocks of ``BLOCK``
symbols (a phrase ends with its block), and all blocks of an Arrow batch move
through the automata in lock-step: one table look-up gives the next state and
whether a phrase ended.

Samples are bounded: about ``PER_LANGUAGE`` labelled documents of each language by
id hash, and of their whole texts passages of ``PASSAGE`` characters by a hash of
id and place, at most ``SAMPLE_CHARS`` symbols of a language.  Every labelled
language is learned: languages are dealt into blocks of at most ``TOTAL_CHARS``
symbols (at least ``PASSAGE`` of each language); one block's automata (fewer than
two states per symbol) are broadcast at a time, and the parses go through the
blocks one after the other, keeping the two best.

:func:`keep_identified` rejects by the parse: a text goes if even its best language
needs more than ``MOST_BITS`` bits per symbol, two phrases free of charge (random
letters need about 4.8, an unknown script about 15).

Defined cases: null, empty and letterless texts give ``und`` and score 0, as
does everything if no labelled text exists (then nothing is kept); null ids are
kept and never learned from; very long texts are parsed whole; ties go to the
language with more labelled documents, then first by name; repeated rows give
one row each; empty tables give no rows; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.arrays import pieces, text_buffers
from wordloom.llm.frames import arrow_map, fresh, hash_share, materialize

SAMPLE_CHARS = 32_768
TOTAL_CHARS = 262_144
PER_LANGUAGE = 64
PASSAGE = 256
MOST_BITS = 6.0
BLOCK = 1024
UNKNOWN = "und"


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): separators (32) for runs of ASCII non-letters, none at the start; bytes of letters as they are."""
    sep = np.ones(256, dtype=bool)
    sep[65:91] = sep[97:123] = sep[128:] = False
    gap = sep[data]
    drop = np.zeros(len(data), dtype=bool)
    drop[1:] = gap[1:] & gap[:-1]
    inner = offsets[:-1][(offsets[:-1] < len(data))]
    drop[inner] = gap[inner]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    out = np.where(gap, np.uint8(32), data)[~drop]
    return out, kept[offsets]


def automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``sample``; state 0 is the start."""
    nxt, link, size, last = [{}], [-1], [0], 0
    for c in sample:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


class Model:
    """The languages' automata as one table: ``table[state + class]`` is four times the next state, plus the phrases that end."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = list(samples)
        used = sorted(set(b"".join(samples.values())))
        self.classes = np.zeros(256, dtype=np.int32)       # 0: a symbol in no sample
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        tables, self.start, at = [], [], 0
        for name in self.names:
            states = automaton(samples[name])
            first = np.zeros(width, dtype=np.int64)
            for c, to in states[0].items():
                first[self.classes[c]] = to
            # no transition: the phrase ends, and the symbol begins the next one; an unknown symbol is one itself
            t = np.tile((at + first * width) * 4 + np.where(first > 0, 1, 2), (len(states), 1))
            t[0] -= 1
            for s, own in enumerate(states):
                for c, to in own.items():
                    t[s, self.classes[c]] = (at + to * width) * 4
            tables.append(t.astype(np.int32).ravel())
            self.start.append(at)
            at += len(states) * width
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.start = np.array(self.start, dtype=np.int32)
        self.log_size = np.array([np.log2(max(2, len(samples[n]))) for n in self.names])

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases that each text (column) needs in each language (row)."""
        n_texts, n_langs = len(offsets) - 1, len(self.names)
        out = np.zeros((n_langs, n_texts))
        cls = self.classes[data]
        length = np.diff(offsets)
        blocks = -(-length // BLOCK)
        text = np.repeat(np.arange(n_texts), blocks)
        start = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        size = np.minimum(offsets[text + 1] - start, BLOCK)
        order = np.argsort(-size, kind="stable")
        text, start, size = text[order], start[order], size[order]
        for lo in range(0, len(text), 4096):
            t, s, z = text[lo:lo + 4096], start[lo:lo + 4096], size[lo:lo + 4096]
            state = np.repeat(self.start[:, None], len(t), axis=1)
            ended = np.zeros((n_langs, len(t)), dtype=np.int32)
            live = np.searchsorted(-z, -np.arange(int(z[0])), side="left")   # blocks longer than each step
            for step, k in enumerate(live.tolist()):
                got = self.table[state[:, :k] + cls[s[:k] + step]]
                ended[:, :k] += got & 3
                state[:, :k] = got >> 2
            ended += state != self.start[:, None]
            for lang in range(n_langs):
                out[lang] += np.bincount(t, weights=ended[lang], minlength=n_texts)
        return out

    def parse(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: language number, bits per symbol in it and in the second best, and bits with two phrases free.

        Texts without symbols, and all texts without languages, give -1 and infinities.
        """
        best, bits = np.full(len(column), -1), np.full((3, len(column)), np.inf)
        for p in pieces(column) if self.names else ():
            data, offsets = symbols(p.data[:-8], p.offsets)
            size = np.maximum(1, np.diff(offsets))
            phrases = self.phrases(data, offsets)
            own = phrases * self.log_size[:, None] / size
            order = np.argsort(own, axis=0, kind="stable")
            some = np.diff(offsets) > 0
            best[p.lo:p.hi] = np.where(some, order[0], -1)
            free = (np.maximum(phrases - 2, 0) * self.log_size[:, None] / size).min(axis=0)
            second = np.take_along_axis(own, order[1:2], axis=0)[0] if len(self.names) > 1 else np.inf
            for to, value in zip(bits, (np.take_along_axis(own, order[:1], axis=0)[0], second, free)):
                to[p.lo:p.hi] = np.where(some, value, np.inf)
        return best, *bits


def samples(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> dict[str, bytes]:
    """Bounded training text per language, most frequent first, from the rows where ``learn`` holds."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                      F.col(f"`{lang_col}`").cast("string").alias("lang"), learn.alias("learn")) \
        .where("learn AND lang IS NOT NULL AND id IS NOT NULL")
    found = materialize(own.groupBy("lang").agg(F.countDistinct("id").alias("n")), docs.sparkSession, "languages")
    chars = max(PASSAGE, min(sample_chars, total_chars // max(1, found.count())))
    share = F.least(F.lit(1.0), per_language / F.col("n"))
    some = own.join(found, "lang").where(hash_share("id", share)).dropDuplicates(["lang", "id"])
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.char_length("text") - 1) / PASSAGE)))
    passages = some.select("lang", "n", "id", "text", F.explode(places).alias("place")) \
        .select("lang", "n", F.xxhash64("id", "place").alias("h"), "id", "place",
                F.lower(F.substring("text", F.col("place").cast("int") * PASSAGE + 1, F.lit(PASSAGE))).alias("text"))
    passages = materialize(passages, docs.sparkSession, "passages")
    # a share by hash leaves about twice the passages that fill the sample; the least hashes are taken
    size = passages.groupBy("lang").agg(F.sum(F.char_length("text")).alias("size"))
    spread = F.pmod(F.xxhash64("h", F.lit("passage")), F.lit(1 << 30)) / float(1 << 30)
    got = passages.join(size, "lang").where((spread * F.col("size") < 2.0 * chars) | (F.col("size") < 16 * PASSAGE)) \
        .select("lang", "n", "h", "id", "place", "text").toArrow() \
        .sort_by([("n", "descending"), ("lang", "ascending"), ("h", "ascending"), ("id", "ascending"), ("place", "ascending")])
    out: dict[str, bytes] = {}
    for lang, text in zip(got["lang"].to_pylist(), got["text"].to_pylist()):
        if text and len(out.get(lang, b"")) < chars:
            data, offsets = text_buffers(pa.array([text]))
            out[lang] = (out.get(lang, b"") + symbols(data, offsets)[0].tobytes() + b" ")[:chars]
    return out


def blocks(texts: dict[str, bytes], total_chars: int = TOTAL_CHARS) -> list[dict[str, bytes]]:
    """The languages in blocks of at most ``total_chars`` symbols, or one language."""
    out: list[dict[str, bytes]] = []
    size = 0
    for name, text in texts.items():
        if not out or size + len(text) > total_chars:
            out.append({})
            size = 0
        out[-1][name] = text
        size += len(text)
    return out


def parsed(docs: DataFrame, text_col: str, texts: dict[str, bytes], total_chars: int = TOTAL_CHARS) -> tuple[DataFrame, list[str]]:
    """The rows with four more columns, and their names: best language, bits in it, in the second best, bits for the rejection."""
    spark = docs.sparkSession
    names = [fresh(c, docs) for c in ("_best", "_bits", "_next", "_free")]
    nothing = [F.lit(None).cast("string"), *(F.lit(float("inf")) for _ in range(3))]
    out = docs.select("*", *(c.alias(n) for n, c in zip(names, nothing)))
    at, own = docs.columns.index(text_col), blocks(texts, total_chars)
    for number, block in enumerate(own):
        shared = spark.sparkContext.broadcast(Model(block))

        def fn(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            import pyarrow.compute as pc

            *rest, had_name, had_first, had_second, had_free = batch.columns
            best, first, second, free = shared.value.parse(pc.utf8_lower(rest[at]))
            before, after = np.asarray(had_first), np.asarray(had_second)
            better = first < before                     # ties stay with the earlier language
            named = pa.array(shared.value.names, pa.string()).take(pa.array(best, mask=best < 0))
            runner = np.where(better, np.minimum(before, second), np.minimum(after, first))
            found = [pc.if_else(pa.array(better), named, had_name), pa.array(np.minimum(first, before)), pa.array(runner),
                     pa.array(np.minimum(free, np.asarray(had_free)))]
            return pa.record_batch([*rest, *found], names=batch.schema.names)

        out = arrow_map(out, fn, out.schema)
        if number + 1 < len(own):
            out = materialize(out, spark, "parsed")
    return out, names


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             **bounds: int) -> DataFrame:
    """``id, lang_pred, score`` for every row; ``learn`` marks the rows whose labels may be used."""
    texts = samples(docs, learn, id_col, text_col, lang_col, **bounds)
    t = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out, (best, bits, after, _) = parsed(t, "text", texts, bounds.get("total_chars", TOTAL_CHARS))
    told = F.col(best).isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # 1 when no second language exists (its bits are infinite)
    score = F.greatest(F.lit(0.0), 1 - F.col(bits) / F.greatest(F.col(after), F.lit(1e-12)))
    return out.select("id", F.when(told, F.col(best)).otherwise(UNKNOWN).alias("lang_pred"), F.when(told, score).otherwise(0.0).alias("score"))


def keep_identified(docs: DataFrame, learn: Column, languages: set[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", most_bits: float = MOST_BITS, **bounds: int) -> DataFrame:
    """The rows, columns as they are, whose language is found within ``most_bits`` (and among ``languages``, if given)."""
    texts = samples(docs, learn, id_col, text_col, lang_col, **bounds)
    out, (best, _, _, free) = parsed(docs, text_col, texts, bounds.get("total_chars", TOTAL_CHARS))
    told = F.col(best).isNotNull() & F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False))
    allowed = F.lit(True) if languages is None else F.col(best).isin(sorted(languages))
    return out.where(told & (F.col(free) <= most_bits) & allowed).select(*(f"`{c}`" for c in docs.columns))
