"""Intermediate tables in the shared folder, so that lost executors cost a re-read and not a re-run."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Return the folder named by ``spark.checkpoint.dir``.

    Only where that setting is missing and all of Spark is one process (tests) a temporary folder is made and used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and return the table read back.

    The shuffle files behind ``df`` are of no more use then; a collection lets Spark's cleaner delete them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table._scratch_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table._scratch_path)


def drop_all(spark: SparkSession) -> None:
    """Delete every intermediate table of the shared folder; results not yet written become unreadable."""
    _delete(spark, f"{shared_dir(spark)}/tidemark")
