"""Tokenising and cleaning as Spark column expressions.

The reference splits text on *bytes*: a multi-byte UTF-8 character whose
encoding contains a delimiter byte (e.g. ’ = E2 80 99) is cut there.  We get
byte semantics by viewing the UTF-8 bytes as ISO-8859-1 characters (one
char per byte) for the whole tokenising stage.  Kept words are ASCII by
construction (shape filter), so they are the same in both views.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.config import SENTENCE_DELIMITERS, WORD_DELIMITERS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _java_class_body(chars: str) -> str:
    out = []
    for ch in chars:
        if ch in "[]\\^-&":
            out.append("\\" + ch)
        elif ch == "\t":
            out.append("\\t")
        elif ch == "\n":
            out.append("\\n")
        elif ch == "\r":
            out.append("\\r")
        elif ord(ch) > 126 or ord(ch) < 32:
            out.append("\\u%04x" % ord(ch))
        else:
            out.append(ch)
    return "".join(out)


def _byte_chars(s: str) -> str:
    """Each UTF-8 byte of ``s`` as one ISO-8859-1 character (deduplicated)."""
    seen = []
    for ch in s.encode("utf-8").decode("latin-1"):
        if ch not in seen:
            seen.append(ch)
    return "".join(seen)


DELIM_BYTES = _byte_chars(WORD_DELIMITERS)
DELIM_CLASS = "[" + _java_class_body(DELIM_BYTES) + "]"
SENT_CLASS = "[" + _java_class_body(SENTENCE_DELIMITERS) + "]"
# a sentence ends after a token whose last byte is a sentence delimiter;
# newline always ends a token (lines are read one at a time)
SENTENCE_SPLIT = "(?<=\\n)|(?<=[.?!\\r])(?=" + DELIM_CLASS + ")"
SHAPE_RE = "^[a-z-]{3,}\\z"
# the bytes of a text as the tokeniser reads them: A-Z lowercased, every delimiter a space
BYTES = bytes(0x20 if chr(b) in DELIM_BYTES else b + 32 if 65 <= b <= 90 else b for b in range(256))


PIECE_CHARS = 1 << 16        # longer texts are cut into pieces of about this size, after a delimiter or a line end


def pieces(text_bytes: Column, size: int = PIECE_CHARS) -> Column:
    """A (byte-view, newline-terminated) text as pieces that cut no token; a token longer than ``size`` stays whole."""
    cut = "(?<=" + DELIM_CLASS[:-1] + "\\n])"
    return F.regexp_extract_all(text_bytes, F.lit("(?s).{1,%d}%s|.+?(?:%s|\\z)" % (size, cut, cut)), F.lit(0))


def byte_view(text: Column) -> Column:
    """UTF-8 bytes of ``text`` as ISO-8859-1 characters (one char per byte)."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def utf8_view(text: Column) -> Column:
    """Inverse of :func:`byte_view`; bytes of a character that a delimiter byte cut become U+FFFD."""
    return F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))


def as_lines(text: Column) -> Column:
    """A document as the reference reads a file: every line ends in newline."""
    return F.concat(text, F.lit("\n"))


def split_sentences(text_bytes: Column) -> Column:
    """Split (byte-view, newline-terminated) text into sentence chunks.

    Chunk boundaries never cut a token, so tokenising each chunk gives the
    same tokens as tokenising the whole text.
    """
    return F.split(text_bytes, SENTENCE_SPLIT, -1)


def tokenize(chunk: Column) -> Column:
    """Split on any delimiter byte, empty tokens never emitted."""
    return F.filter(F.split(chunk, DELIM_CLASS + "+", -1), lambda t: t != F.lit(""))


def word_lower(word: Column) -> Column:
    """ASCII lowercase (non-ASCII bytes untouched, like C ``tolower``)."""
    return F.translate(word, _UPPER, _LOWER)


def sentence_end(token: Column) -> Column:
    """Whether the token's last byte is a sentence delimiter."""
    return F.substring(token, -1, 1).isin(*list(SENTENCE_DELIMITERS))


def word_clean(token: Column, strip_all: bool = False, lowered: bool = False) -> Column:
    """Lowercase, then strip exactly one trailing sentence byte.

    ``strip_all=True`` strips every trailing sentence byte instead;
    ``lowered=True`` when the text was already lowercased as a whole.
    """
    low = token if lowered else word_lower(token)
    if strip_all:
        return F.regexp_replace(low, SENT_CLASS + "+\\z", "")
    return F.when(sentence_end(low), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def word_shape_ok(word: Column) -> Column:
    """T5: at least 3 bytes, every byte a letter or '-'."""
    return word.rlike(SHAPE_RE)


def not_stop(word: Column, stops: list[str] | None) -> Column:
    """T6 as an expression over a literal list (``isin`` becomes a hash-set lookup)."""
    if not stops:
        return F.lit(True)
    return ~word.isin(*sorted(set(stops)))


def window_pairs(words: Column, context: int = 4, halo: Column | None = None, start: Column | None = None) -> Column:
    """C1 in-row: each token with each of its ``context`` previous tokens whose word differs.

    ``halo`` holds the words right before ``words`` in the same sentence (only
    ``words`` are centers), ``start`` the position of the first of ``words``.
    Returns array<struct<pos:int, dist:int, center:string, ctx:string>>.
    """
    before = F.lit(0) if halo is None else F.size(halo)
    shift = F.lit(0) if start is None else start - before
    first = F.greatest(before, F.lit(1))

    def pairs(ext: Column) -> Column:
        return F.flatten(F.transform(
            F.sequence(first, F.size(ext) - 1),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(context), i)),
                lambda d: F.struct((i + shift).cast("int").alias("pos"), d.alias("dist"),
                                   ext[i].alias("center"), ext[i - d].alias("ctx")))))

    # bound once by a one-element transform: a concatenation inside the lambdas would be built again for every word
    found = pairs(words) if halo is None else F.flatten(F.transform(F.array(F.concat(halo, words)), pairs))
    return F.when(F.size(words) + before > first, F.filter(found, lambda p: p["center"] != p["ctx"])).otherwise(
        F.array().cast("array<struct<pos:int,dist:int,center:string,ctx:string>>"))


# --- question / answer text (Perl one-liners of the Q/A pipeline) ----------

QA_CLEAN_RE = "[^\\w\\s|\\x08=~>]"


def qa_clean(text: Column) -> Column:
    """ASCII lowercase, delete every char not in \\w, \\s, |, backspace, =, ~, >.

    ``\\w`` is ASCII-only here as in the byte-mode original, so every
    non-ASCII character is deleted.
    """
    return F.regexp_replace(word_lower(text), QA_CLEAN_RE, "")


def collapse_letter_runs(text: Column) -> Column:
    """Runs of 3+ of the same a–z letter become 2."""
    return F.regexp_replace(text, "([a-z])\\1{2,}", "$1$1")


def split_question(line: Column) -> Column:
    """T11 question: greedy text before the last ' =~=~>', inner ' =~=~>' removed."""
    q = F.regexp_extract(line, "^(.*) =~=~>", 1)
    return F.regexp_replace(q, " =~=~>", "")


def split_answer(line: Column) -> Column:
    """T11 answer: from the first '=~=~>', every '=~=~> ' removed."""
    a = F.regexp_extract(line, "(=~=~>.*)$", 1)
    return F.regexp_replace(a, "=~=~> ", "")


def whitespace_tokens(text: Column) -> Column:
    """Whitespace split of clean text (Python ``str.split()``)."""
    return F.filter(F.split(F.trim(text), "\\s+", -1), lambda t: t != F.lit(""))
