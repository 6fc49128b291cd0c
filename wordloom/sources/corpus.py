"""Corpus lines, stop lists, query words, Q/A text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T

# ---------------------------------------------------------------------------
# The English stop-word list of the NLTK corpus, which the
# reference downloads as its stop file (public list, natural order as
# published by NLTK).
# ---------------------------------------------------------------------------
NLTK_ENGLISH_STOPWORDS = """i me my myself we our ours ourselves you you're you've you'll you'd your
yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them
their theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by
for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will just don don't should
should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't
hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()


def read_corpus(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents → (doc_id, line_no, line); a line excludes its newline."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")) \
        .withColumnRenamed(id_col, "doc_id")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text file(s) → (line_no, line); any Spark codec (gzip/bz2/zstd) is decoded.

    Lines are numbered 0, 1, 2, … through all files in the order of their paths:
    by file, start of the split and place in the split.
    """
    from wordloom.operators.ranking import dense_index
    df = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
                                      F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    return dense_index(df, [F.col("_file"), F.col("_start"), F.col("_at")], "line_no").select("line_no", "line")


def read_stopwords(lines: DataFrame, col: str = "line") -> DataFrame:
    """Stop file lines → distinct words (the line terminator is already gone)."""
    return lines.select(F.col(col).alias("word")).where(F.col("word") != "").distinct()


def prepare_stopwords(words: DataFrame, col: str = "word") -> DataFrame:
    """Strip everything but a–z, sort; duplicates kept (as ``sort`` does)."""
    return words.select(F.regexp_replace(F.col(col), "[^a-z]", "").alias("word")).orderBy("word")


def default_stopwords() -> list[str]:
    """The NLTK English list prepared as S9 prepares it (strip [^a-z]), distinct."""
    import re
    return sorted({re.sub("[^a-z]", "", w) for w in NLTK_ENGLISH_STOPWORDS} - {""})


def read_query_words(lines: DataFrame, col: str = "line", strip_all: bool = False, stem: bool = False) -> DataFrame:
    """S3: one query word per line, cleaned by T2/T3 (and stemmed, as the vocabulary's words are); empty lines skipped."""
    w = T.word_clean(T.byte_view(F.col(col)), strip_all)
    out = lines.where(F.col(col) != "").withColumn("word", T.utf8_view(w))
    return stemmed(out, "word") if stem else out


def stemmed(words: DataFrame, col: str = "word") -> DataFrame:
    """A column of cleaned words, stemmed as the tokeniser stems."""
    from wordloom.operators.stem import apply_stems
    return apply_stems(words.withColumn(col, F.array(col)), col).withColumn(col, F.col(col)[0])


def read_qa_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Compressed or plain Q/A lines (``question =~=~> answer``)."""
    return read_text_lines(spark, path)


def conversation_qa_lines(conv: DataFrame) -> DataFrame:
    """Q/A lines from ``conversations``: a user turn followed by an assistant turn.

    Newlines inside a turn become spaces so one pair is one line, as in the
    line-oriented Q/A file.
    """
    # an equi-join on (conv_id, turn + 1) instead of lead() over conv_id, so one
    # huge conversation does not land in a single window partition
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    flat = lambda c: F.regexp_replace(c, "[\\r\\n]+", " ")
    return u.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.concat(flat(F.col("q")), F.lit(" =~=~> "), flat(F.col("a"))).alias("line"))
