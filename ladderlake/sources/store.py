"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; one of our own only where it is unset and driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ladderlake-"))
    return sc.getCheckpointDir()


_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="")


def _stored_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ladderlake-{spark.sparkContext.applicationId}{_scope.get()}"


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder of whatever file system the path names; False if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, whether it is reached or left by an error: what is built on them has to be written inside too."""
    token = _scope.set(f"{_scope.get()}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        at = _stored_dir(spark)
        _scope.reset(token)
        delete(spark, at)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and an executor may be lost.

    The table stays until drop_stored, as what is built on it may be run at any later time.
    """
    spark = df.sparkSession
    path = f"{_stored_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> bool:
    """Deletes the tables that this application has stored; call it once their results are written."""
    return delete(spark, _stored_dir(spark))
