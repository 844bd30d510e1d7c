"""Tables stored by day, whose days are written anew as a whole and repeatably.

A table is a folder of Parquet files, partitioned by a date. A write stages the whole new content
of the days that it touches, under a token of its own, and then overwrites just those partitions
from there. A job that fails while staging leaves the table as it was; one that fails while
overwriting is run again under its token and goes on from what was staged, without looking at the
half-written table. Files of other days keep their names.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import delete, exists

#: The partition column.
DAY = "trade_date"


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, with all columns it ever had; None if nothing was ever written. A filter on trade_date prunes its days.

    The columns are those noted beside the files, so no file is opened to learn them.
    """
    schema = _schema(spark, path)
    return None if schema is None or not _days(spark, path) else spark.read.schema(schema).parquet(path)


def _schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns that were noted, None of a table that does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_columns")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return T.StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _note_columns(spark: SparkSession, path: str, new: T.StructType) -> None:
    """Adds columns of new that were not there before; a column of another type is an error."""
    old = _schema(spark, path)
    types = {f.name: f.dataType for f in old} if old else {}
    if any(types.get(f.name, f.dataType) != f.dataType for f in new):
        raise ValueError("a column of the table has another type")
    schema = T.StructType([*(old or []), *(T.StructField(f.name, f.dataType) for f in new if f.name not in types)])
    if old is None or len(old) < len(schema):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_columns")
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        try:
            stream.write(bytearray(schema.json().encode()))
        finally:
            stream.close()


def _days(spark: SparkSession, path: str) -> list[dt.date]:
    """The table's days, from the names of its folders."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = (f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
    return sorted(dt.date.fromisoformat(n.split("=", 1)[1]) for n in names if n.startswith(f"{DAY}="))


def latest_day(spark: SparkSession, path: str) -> dt.date | None:
    """The last day that has rows, without reading any."""
    return max(_days(spark, path), default=None) if exists(spark, path) else None


def _commit(spark: SparkSession, path: str, rows: DataFrame | None, token: str) -> list[dt.date]:
    """Stages rows under the token, unless that is done, and overwrites their days from there; those days."""
    staged = f"{path}/_staged/{token}"
    if not exists(spark, f"{staged}/_SUCCESS"):
        delete(spark, staged)  # what a failed job left
        _note_columns(spark, staged, rows.schema)
        rows.write.mode("append").partitionBy(DAY).parquet(staged)
    days = _days(spark, staged)
    _note_columns(spark, path, _schema(spark, staged))
    if days:
        read(spark, staged).repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    return days


def _forget(spark: SparkSession, path: str, token: str) -> None:
    """Deletes what other tokens staged: a later token means that they are done."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_staged")
    if exists(spark, f"{path}/_staged"):
        for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
            if f.getPath().getName() != token:
                delete(spark, f.getPath().toString())


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], token: str) -> list[dt.date]:
    """Puts rows, which have trade_date, in place of those of their keys; the days that were written.

    Only days of new are read and written. Columns that one side lacks are null there. Of several
    new rows of one key, any one stays; a null in a key is a value like others. The same token
    means the same rows: a second call gives the same table.
    """
    _forget(spark, path, token)
    _note_columns(spark, path, new.schema)
    if exists(spark, f"{path}/_staged/{token}/_SUCCESS"):
        return _commit(spark, path, None, token)
    rows = new.dropDuplicates([*{*keys, DAY}])
    old = read(spark, path)
    if old is not None:
        touched = [r[0] for r in new.select(DAY).distinct().collect()]  # days, few
        old = old.filter(F.col(DAY).isin(touched))
        fresh = rows.select(*(F.col(k).alias(f"new_{k}") for k in keys))
        kept = old.join(fresh, [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys], "left_anti")
        rows = kept.unionByName(rows, allowMissingColumns=True)
    return _commit(spark, path, rows, token)


def replace_from(spark: SparkSession, path: str, rows: DataFrame, first: dt.date, token: str) -> list[dt.date]:
    """Puts rows in place of all rows from a day on; days from then on without new rows are deleted. Repeatable like upsert."""
    _forget(spark, path, token)
    _note_columns(spark, path, rows.schema)
    staged = exists(spark, f"{path}/_staged/{token}/_SUCCESS")
    days = _commit(spark, path, None if staged else rows.filter(F.col(DAY) >= F.lit(first)), token)
    for day in _days(spark, path):
        if day >= first and day not in days:
            delete(spark, f"{path}/{DAY}={day}")
    return days


def note_last(spark: SparkSession, path: str, days: list[dt.date], key: str, token: str, time: str = "timestamp") -> None:
    """Keeps beside the table, in `path`_last, each key's last time of each day: a few short rows a day, written after those days are."""
    if days:
        rows = read(spark, path).filter(F.col(DAY).isin(days))
        _forget(spark, f"{path}_last", token)
        _commit(spark, f"{path}_last", rows.groupBy(DAY, key).agg(F.max(time).alias(time)), token)


def latest(spark: SparkSession, path: str, key: str, time: str = "timestamp") -> DataFrame | None:
    """The table's rows of each key's last time, for a table whose last times are noted.

    The days to read come from the notes, so only their partitions are scanned, and the rows are
    not shuffled as long as the last times, one for each key, are small enough for Spark to
    broadcast them.
    """
    rows, noted = read(spark, path), read(spark, f"{path}_last")
    if rows is None or noted is None:
        return None
    last = noted.groupBy(key).agg(F.max(F.struct(time, DAY)).alias("last")).select(key, f"last.{time}", f"last.{DAY}")
    days = [r[0] for r in last.select(DAY).distinct().collect()]  # days, few
    return rows.filter(F.col(DAY).isin(days)).join(last, [DAY, key, time], "left_semi")
