"""Shared plumbing of the training-data operators: tables, scratch space, hot-group splits.

Operators select the columns they need before anything else, so extra input columns (whatever
their names) can't clash with the ones an operator adds.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1_000, 4_000_000
_SCRATCH: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent, a temporary folder stands in for it if the session runs in one
    process (tests, a laptop); on a cluster, whose machines don't share one, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "quarrylake-scratch")
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation, and later steps see
    exact sizes. The folder goes away when the driver's Python or JVM ends, whichever is first.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quarrylake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH[path] = spark
    at, files = _located(spark, path)
    files.deleteOnExit(at)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def bounded(df: DataFrame) -> DataFrame:
    """``df``, about to go through Python: a worker gets at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes at once.

    Texts can be long, and Spark's own defaults (10,000 rows of any size) would hold too many of them.
    The settings are the session's, read when the plan runs, so they stay; smaller ones are left alone.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def release(df: DataFrame) -> None:
    """Delete the scratch files of a frame that ``materialize`` gave, once nothing is to be read from it."""
    path = vars(df).get("_scratch_path")
    if path in _SCRATCH:
        _delete(_SCRATCH.pop(path), path)


def _located(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    at, files = _located(spark, path)
    files.delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in _SCRATCH.items():
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the JVM may have gone first
                return


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 on division by 4.

    A null id counts as not held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name
