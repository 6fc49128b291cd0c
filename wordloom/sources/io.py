"""Vocabulary and removed-word files (``word\\tfreq``) and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCAB_SCHEMA = T.StructType([T.StructField("word", T.StringType(), False),
                             T.StructField("freq", T.LongType(), False)])


def vocab_tsv_lines(vocab: DataFrame) -> DataFrame:
    """(idx, line) with ``word\\tfreq``; file order = idx (byte order of words)."""
    return vocab.select("idx", F.concat_ws("\t", "word", F.col("freq").cast("string")).alias("line"))


def filtered_tsv_lines(removed: DataFrame) -> DataFrame:
    """(pos, line): the high block (ascending freq) then the low block."""
    from wordloom.operators.ranking import dense_index
    blk = F.when(F.col("reason") == "high", 0).otherwise(1)
    r = dense_index(removed.withColumn("_blk", blk), [F.col("_blk"), F.col("freq"), F.col("word")], "pos")
    return r.select("pos", F.concat_ws("\t", "word", F.col("freq").cast("string")).alias("line"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Parquet (primary) and the tab-separated text file, no header."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab.parquet")
    vocab.orderBy("idx").select("word", "freq").write.mode("overwrite").option("sep", "\t") \
        .option("header", False).csv(f"{path}/vocab.tsv")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """S4 reader: explicit schema, no header (the first word is data, X15)."""
    from wordloom.operators.ranking import dense_index
    df = spark.read.schema(VOCAB_SCHEMA).option("sep", "\t").option("header", False).csv(path)
    return dense_index(df, [F.col("word")], "idx").select("idx", "word", "freq")
