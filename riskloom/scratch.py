"""Scratch tables: results that are written once and read again, which cuts their lineage.

A plan over persisted tables is printed and optimised with all that it was made from; a plan over a written one is a scan. Scratch tables lie in the folder
of spark.checkpoint.dir, which all executors share, so a lost executor loses nothing.
"""

from __future__ import annotations

import atexit
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[tuple[SparkSession, str]] = []
_makers: dict[str, int] = {}  # the thread that wrote a table


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_scratch() -> None:
    """Deletes this session's scratch tables when the driver ends."""
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have gone already
            return


atexit.register(_remove_scratch)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one in the warehouse is set only where there is none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:  # the warehouse is a folder that all executors share as well
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/riskloom/{what}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    _makers[path] = threading.get_ident()
    schema = df.schema
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the shuffle files go with the job: nothing reads them again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = (spark, path)
    return out


def forget(table: tuple[SparkSession, str]) -> None:
    """Deletes one of scratch_tables()."""
    _delete(*table)
    _scratch.remove(table)
    del _makers[table[1]]


def dropped(*tables: DataFrame) -> None:
    """Deletes scratch tables of written() that nothing reads any more."""
    for t in tables:
        forget(t._scratch)


def scratch_tables(spark: SparkSession | None = None) -> list[tuple[SparkSession, str]]:
    """The tables there are; with a session, those that the calling thread has written in it."""
    return [t for t in _scratch if spark is None or t[0] is spark and _makers[t[1]] == threading.get_ident()]
