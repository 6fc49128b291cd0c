"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.session import materialize, ship_package

NULL_ID = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str | Column) -> DataFrame:
    """``(id, text, ...)`` of a table, whatever other columns it has; ids as longs."""
    extra = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in more.items()]
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *extra)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` with null ids replaced by a key of their own, so that joins on ``id`` find them."""
    t = texts(docs, id_col, text_col)
    return t.select(F.coalesce("id", F.lit(NULL_ID)).alias("id"), "text")


def with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """The table with a key of its own for every row, written once so that the keys stay."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), docs.sparkSession, "rows")


def fresh(name: str, docs: DataFrame) -> str:
    """``name``, with underscores added until no column of the table is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unkey(name: str = "id") -> Column:
    """The id that :func:`keyed` replaced."""
    return F.nullif(F.col(name), F.lit(NULL_ID))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % n


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over single batches."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, decide: Callable[[pa.Array], "object"], text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, for which ``decide(text column)`` gives true."""
    at = docs.columns.index(text_col)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(decide(batch.column(at)), type=pa.bool_()))

    return arrow_map(docs, fn, docs.schema)


def hash_share(id_col: str, share: float | Column) -> Column:
    """True for about ``share`` of the ids, chosen by their hash: a sample that needs no sorting."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("share")), F.lit(1 << 30)) < (F.lit(share) if isinstance(share, float) else share) * float(1 << 30)


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on a long key of which either side may be an aggregate by that key.

    Such a side is already dealt by the key, and the adaptive planner does not
    split hot keys of a join that deals nothing.  The join is on a value derived
    from the key, so both sides are dealt for it and hot keys of ``left`` are split.
    """
    derived = F.col(key).bitwiseXOR(F.lit(1))
    joined = left.withColumn("_key", derived).join(right.select(derived.alias("_key"), *[c for c in right.columns if c != key]), "_key", how)
    return joined.drop("_key")


__all__ = ["NULL_ID", "arrow_map", "fresh", "hash_share", "keep_rows", "keyed", "materialize", "read", "remainder", "split_join", "texts", "unkey", "with_row"]
