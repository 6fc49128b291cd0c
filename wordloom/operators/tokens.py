"""Documents → sentences of kept tokens.

A document row is split into sentence chunks, each chunk into tokens, then
cleaned and filtered, over Arrow batches in the tasks: each distinct token is
looked at once per task.  No shuffle: sentence ids and positions come from the
places in the text, not from a window over the corpus.

A text beyond ``piece`` characters is cut into pieces first (after a delimiter
or a line end, so no token is cut), and the pieces are dealt to all tasks: a
text without sentence ends is then as many rows as it has pieces.  A sentence
over several pieces becomes fragments, each with the position of its first word
and a halo, the kept words right before it; sentence ids and positions go on
from piece to piece by running sums over the pieces' counts, not their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.config import SENTENCE_DELIMITERS, Config
from wordloom.functions import text as T
from wordloom.session import materialize, ship_package

WORDS_OUT = 1 << 18          # words after which a task hands on what it has
MEMO = 1 << 18               # distinct tokens a task remembers
_ENDS = SENTENCE_DELIMITERS.encode()


def _short(docs: DataFrame, text_col: str, piece: int) -> DataFrame:
    return docs.where(F.coalesce(F.length(text_col) <= piece, F.lit(True)))


def _long_pieces(docs: DataFrame, text_col: str, id_col: str, piece: int, lower: bool) -> DataFrame:
    """(row, doc_id, piece, body): the long texts' pieces, dealt to all tasks; ``row`` is a key per document row."""
    t = T.as_lines(T.byte_view(F.col(text_col)))
    body = T.pieces(T.word_lower(t) if lower else t, piece)
    rows = docs.where(F.length(text_col) > piece).withColumn("row", F.monotonically_increasing_id())    # before the rows multiply
    return rows.select("row", F.col(id_col).alias("doc_id"), F.posexplode(body).alias("piece", "body")).repartition("row", "piece")


def _piece_key() -> Column:
    """One value per piece: joins by it are dealt by pieces, even where a side is dealt by ``row`` already."""
    return F.concat_ws(":", "row", "piece").alias("at")


def _before(order: Window, n: int | None = None) -> Window:
    """The rows before the current one: all, or the last ``n``."""
    return order.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


class Cleaned(dict):
    """Token (lowercased bytes) → the word it becomes, or None if it is not kept; ``kept=False`` cleans only."""

    def __init__(self, cfg: Config, stops: list[str] | None = None, kept: bool = True):
        self.strip_all, self.stem, self.kept = cfg.strip_all, cfg.stem, kept
        self.stops = frozenset(stops or ()) if cfg.stop else frozenset()

    def __missing__(self, token: bytes) -> str | None:
        import re
        from wordloom.functions.porter import stem
        if len(self) >= MEMO:
            self.clear()
        word = strip_end(token, self.strip_all).decode("utf-8", "replace")
        if self.stem and re.fullmatch("[a-z-]{3,}", word):
            word = stem(word)
        if self.kept and (word in self.stops or not re.fullmatch("[a-z-]{3,}", word)):
            word = None
        self[token] = word
        return word


def strip_end(token: bytes, strip_all: bool) -> bytes:
    """T3 of lowercased bytes: one trailing sentence byte less, or all of them."""
    if strip_all:
        return token.rstrip(_ENDS)
    return token[:-1] if token and token[-1] in _ENDS else token


def _lists(flat: list, ends: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(flat, pa.string()))


def _kept_words(rows: DataFrame, keys: list[str], place: str, cfg: Config, stops: list[str] | None) -> DataFrame:
    """(keys…, place, n_raw, words) of each sentence chunk of ``body``, the bytes of a text: T1, T3, T5, T6 (stemmed if ``cfg.stem``)."""
    import re
    ship_package(rows.sparkSession)
    split = re.compile(b"(?<=\n)|(?<=[.?!\r])(?= )").split       # T.SENTENCE_SPLIT where every delimiter is a space
    table = T.BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Cleaned(cfg, stops).__getitem__
        for b in batches:
            src, number, n_raw, flat, ends = [], [], [], [], [0]

            def out() -> pa.RecordBatch:
                at = pa.array(np.array(src, dtype=np.int64))
                return pa.record_batch([*(b.column(k).take(at) for k in keys), pa.array(number, pa.int32()), pa.array(n_raw, pa.int32()),
                                        _lists(flat, ends)], names=[*keys, place, "n_raw", "words"])

            for i, body in enumerate(b.column("body")):
                body = body.as_py()
                if body is None:
                    continue
                for k, chunk in enumerate(split(body.translate(table))):
                    tokens = list(filter(None, chunk.split(b" ")))
                    flat.extend(filter(None, map(look, tokens)))
                    src.append(i)
                    number.append(k)
                    n_raw.append(len(tokens))
                    ends.append(len(flat))
                if len(flat) > WORDS_OUT:
                    yield out()
                    src, number, n_raw, flat, ends = [], [], [], [], [0]
            if src:
                yield out()

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{place}` int, n_raw int, words array<string>"
    return rows.select(*keys, "body").mapInArrow(run, schema)


def line_tokens(rows: DataFrame, keys: list[str], cfg: Config, clean_line: bool) -> DataFrame:
    """(keys…, words) of ``body``, the bytes of a line: every token cleaned (stemmed if ``cfg.stem``), none dropped; NULL for no line."""
    ship_package(rows.sparkSession)
    table, strip_all = T.BYTES, cfg.strip_all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Cleaned(cfg, kept=False).__getitem__
        for b in batches:
            words = []
            for body in b.column("body"):
                body = body.as_py()
                if body is not None:
                    body = body.translate(table)
                    body = strip_end(body, strip_all) if clean_line else body
                words.append(None if body is None else [look(t) for t in body.split(b" ") if t])
            yield pa.record_batch([*(b.column(k) for k in keys), pa.array(words, pa.list_(pa.string()))], names=[*keys, "words"])

    types = dict(rows.dtypes)
    return rows.select(*keys, "body").mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", words array<string>")


SENTENCE = ["doc_id", "sid", "n_raw", "words", "start", "halo"]


def sentences(docs: DataFrame, cfg: Config = Config(), stops: list[str] | None = None,
              text_col: str = "text", id_col: str = "doc_id", keep_empty: bool = False,
              piece: int = T.PIECE_CHARS) -> DataFrame:
    """(doc_id, sid, n_raw, words, start, halo) — kept words of each sentence, in order.

    ``sid`` increments after every token whose last byte ends a sentence,
    also when that token itself is dropped (T7).  Sentences never cross
    documents.  With ``cfg.stem`` the Porter stem replaces each cleaned token
    before the shape and stop checks (:mod:`wordloom.operators.stem`).

    A sentence is one row (``start`` 0, no ``halo``), or, in texts beyond
    ``piece`` characters, one row per fragment: ``start`` is the position of
    the fragment's first kept word and ``halo`` the window's kept words before it.
    """
    from wordloom.sources.tables import spread
    short = spread(_short(docs, text_col, piece), id_col).select(F.col(id_col).alias("doc_id"), F.encode(T.as_lines(F.col(text_col)), "UTF-8").alias("body"))
    short = _kept_words(short, ["doc_id"], "sid", cfg, stops).select(
        *SENTENCE[:4], F.lit(0).alias("start"), F.array().cast("array<string>").alias("halo"))
    out = short.unionByName(_fragments(docs, cfg, stops, text_col, id_col, piece))
    return out if keep_empty else out.where(F.size("words") > 0)


def _fragments(docs: DataFrame, cfg: Config, stops: list[str] | None, text_col: str, id_col: str, piece: int) -> DataFrame:
    """The long texts' sentences, a row per (sentence, piece)."""
    parts = _long_pieces(docs, text_col, id_col, piece, lower=True)
    parts = parts.select("row", "doc_id", "piece", F.encode("body", "ISO-8859-1").alias("body"))
    parts = materialize(_kept_words(parts, ["row", "doc_id", "piece"], "k", cfg, stops), docs.sparkSession, "fragments")
    by_piece = Window.partitionBy("row").orderBy("piece")
    ends = parts.groupBy("row", "piece").agg(F.max("k").alias("ends"))
    first = ends.select(_piece_key(), "ends", F.coalesce(F.sum("ends").over(_before(by_piece)), F.lit(0)).alias("first"))
    numbered = parts.select("*", _piece_key()).join(first, "at").withColumn("sid", (F.col("first") + F.col("k")).cast("int"))
    # only a piece's first and last sentence can go on beyond it
    edge = numbered.where(((F.col("k") == 0) | (F.col("k") == F.col("ends"))) & (F.size("words") > 0)).select(
        "row", "sid", "piece", F.size("words").alias("n"), F.slice("words", -F.least(F.lit(cfg.context), F.size("words")), cfg.context).alias("tail"))
    in_sentence = Window.partitionBy("row", "sid").orderBy("piece")
    tails = F.flatten(F.collect_list("tail").over(_before(in_sentence, cfg.context)))
    edge = edge.select(_piece_key(), "sid", F.coalesce(F.sum("n").over(_before(in_sentence)), F.lit(0)).cast("int").alias("start"),
                       F.when(F.size(tails) <= cfg.context, tails).otherwise(F.slice(tails, -cfg.context, cfg.context)).alias("halo"))
    out = numbered.join(edge, ["at", "sid"], "left")
    return out.select("doc_id", "sid", "n_raw", "words", F.coalesce("start", F.lit(0)).alias("start"),
                      F.coalesce("halo", F.array().cast("array<string>")).alias("halo"))


def sentence_counts(sents: DataFrame) -> DataFrame:
    """(doc_id, sid, n_raw, n_kept) per sentence, fragments added up."""
    return sents.groupBy("doc_id", "sid").agg(F.sum("n_raw").cast("bigint").alias("n_raw"), F.sum(F.size("words")).cast("bigint").alias("n_kept"))


def _doc_tokens(docs: DataFrame, text_col: str, id_col: str, piece: int = T.PIECE_CHARS) -> DataFrame:
    """(doc_id, pos, sid, tok) — every raw token (byte view) with its sentence id."""
    from wordloom.sources.tables import spread

    def numbered(body: Column) -> Column:
        return F.flatten(F.transform(T.split_sentences(body), lambda c, i: F.transform(
            T.tokenize(c), lambda t: F.struct(i.alias("sid"), t.alias("tok")))))

    whole = numbered(T.as_lines(T.byte_view(F.col(text_col))))
    short = spread(_short(docs, text_col, piece), id_col).select(F.col(id_col).alias("doc_id"), F.posexplode(whole).alias("pos", "t")) \
        .select("doc_id", "pos", F.col("t.sid").alias("sid"), F.col("t.tok").alias("tok"))
    parts = _long_pieces(docs, text_col, id_col, piece, lower=False)
    parts = parts.select("row", "doc_id", "piece", numbered(F.col("body")).alias("toks"), (F.size(T.split_sentences(F.col("body"))) - 1).alias("ends"))
    parts = materialize(parts, docs.sparkSession, "pieces")
    order = _before(Window.partitionBy("row").orderBy("piece"))
    counts = parts.select("row", "piece", "ends", F.size("toks").alias("n"))
    counts = counts.select(_piece_key(), *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in ("ends", "n")))
    long = parts.select("*", _piece_key()).join(counts, "at").select("doc_id", "ends_before", "n_before", F.posexplode("toks").alias("p", "t"))
    return short.unionByName(long.select("doc_id", (F.col("p") + F.col("n_before")).cast("int").alias("pos"),
                                         (F.col("t.sid") + F.col("ends_before")).cast("int").alias("sid"), F.col("t.tok").alias("tok")))


def raw_tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", piece: int = T.PIECE_CHARS) -> DataFrame:
    """(doc_id, pos, token) — every raw token of a document, pos 0-based.

    A line's last token keeps its newline, as a line-by-line reader sees it.
    """
    return _doc_tokens(docs, text_col, id_col, piece).select(
        "doc_id", "pos", T.utf8_view(F.col("tok")).alias("token"))


def cleaned_tokens(docs: DataFrame, cfg: Config = Config(), text_col: str = "text",
                   id_col: str = "doc_id", piece: int = T.PIECE_CHARS) -> DataFrame:
    """T3/T5 per raw token: (doc_id, pos, sid, word, sent_end, shape_ok)."""
    t = _doc_tokens(docs, text_col, id_col, piece)
    w = T.word_clean(F.col("tok"), cfg.strip_all)
    return t.select("doc_id", "pos", "sid", T.utf8_view(w).alias("word"),
                    T.sentence_end(F.col("tok")).alias("sent_end"),
                    T.word_shape_ok(w).alias("shape_ok"))


def kept_tokens(sents: DataFrame) -> DataFrame:
    """(doc_id, sid, pos, word) — pos counts kept tokens within the sentence."""
    return sents.select("doc_id", "sid", "start", F.posexplode("words").alias("p", "word")).select(
        "doc_id", "sid", (F.col("start") + F.col("p")).alias("pos"), "word")
