"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "wordloom", extra: dict | None = None) -> SparkSession:
    """Session used by tests and the bench: AQE on, UI off, Arrow on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and model tables.

    Uses the cluster's ``spark.checkpoint.dir``.  Only a local master without it
    (tests) gets a fresh scratch folder; on a cluster executors do not see the
    driver's folders, so there it must be set.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        opt = sc._jsc.sc().getCheckpointDir()
        d = opt.get() if opt.isDefined() else None
    if not d and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(d)
        opt = sc._jsc.sc().getCheckpointDir()
        d = opt.get() if opt.isDefined() else d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Drops a folder of the shared storage that this library wrote and no longer reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df, spark: SparkSession, name: str, **options: str):
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts lineage (a lost executor recomputes from the table, not from the
    corpus) and pins non-deterministic ids; never uses local checkpoints.
    """
    path = scratch_path(spark, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)


def place_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` distinct numbers: dealt to ``n`` partitions by such a key, the i-th falls in the i-th partition."""
    from pyspark.sql import functions as F
    key = spark.range(0, 64 * n, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(max(n, 1))).alias("at")).agg(F.min("id").alias("id"))
    found = {r["at"]: r["id"] for r in key.collect()}
    return [found.get(i, -1 - i) for i in range(n)]


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wordloom`` importable in Python workers (as ``--py-files`` does).

    Zips the package once per SparkContext and ships it with ``addPyFile``.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = tempfile.mkdtemp(prefix="run-pkg-", dir="/tmp")
    archive = shutil.make_archive(os.path.join(base, "wordloom"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir="wordloom")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
