"""Model tables (idx, word, vec) — initialise, normalise, save, load."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import vectors as V
from wordloom.functions.hashing import uniform_rows
from wordloom.session import ship_package


def init_weights(vocab: DataFrame, cfg: Config = Config(), v: int | None = None):
    """(model_in, model_out), every component U(−1,1)·sqrt(2/(V+V)), hash-seeded."""
    if v is None:
        v = vocab.count()
    ship_package(vocab.sparkSession)
    seed, hidden, scale = cfg.seed, cfg.hidden, math.sqrt(2.0 / (v + v)) if v else 0.0
    schema = f"idx {dict(vocab.dtypes)['idx']}, word string, vec array<double>"

    def mk(stream: str) -> DataFrame:
        def run(batches):
            for b in batches:
                m = (uniform_rows(seed, stream, hidden, b.column(0).to_pylist()) * 2.0 - 1.0) * scale
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * hidden), pa.array(m.ravel()))
                yield pa.record_batch([b.column(0), b.column(1), vec], names=["idx", "word", "vec"])

        return vocab.select("idx", "word").mapInArrow(run, schema)

    return mk("ih"), mk("ho")


def normalize_rows(model: DataFrame) -> DataFrame:
    """E2 over a model table (NULL vector for a zero row)."""
    return model.withColumn("vec", V.l2_normalize(F.col("vec")))


def weights_tsv_lines(model: DataFrame, normalize: bool) -> DataFrame:
    """S6 text form: (idx, line) with H tab-separated ``%.6f`` values (w_ih normalised first)."""
    m = normalize_rows(model) if normalize else model
    return m.select("idx", F.concat_ws("\t", F.transform(F.col("vec"),
                                                         lambda x: F.format_string("%.6f", x))).alias("line"))


def save_weights(model_in: DataFrame, model_out: DataFrame, path: str, tsv: bool = False) -> None:
    """Parquet model tables under ``path``/{in,out}; optional TSV as the original writes them."""
    normalize_rows(model_in).write.mode("overwrite").parquet(f"{path}/in")
    model_out.write.mode("overwrite").parquet(f"{path}/out")
    if tsv:
        for name, m, nz in (("weights-ih", model_in, True), ("weights-ho", model_out, False)):
            weights_tsv_lines(m, nz).orderBy("idx").select("line").write.mode("overwrite").text(f"{path}/{name}.tsv")


def load_weights(spark: SparkSession, path: str):
    """Read both model tables back (row order = idx)."""
    return spark.read.parquet(f"{path}/in"), spark.read.parquet(f"{path}/out")


def load_weights_tsv(spark: SparkSession, path: str, vocab: DataFrame) -> DataFrame:
    """S7 text form: TSV rows joined to the vocabulary by row number (J5: shorter side wins)."""
    from wordloom.sources.corpus import read_text_lines
    rows = read_text_lines(spark, path).select(
        F.col("line_no").alias("idx"), F.transform(F.split("line", "\t"), lambda x: x.cast("double")).alias("vec"))
    return vocab.select("idx", "word").join(rows, "idx")
