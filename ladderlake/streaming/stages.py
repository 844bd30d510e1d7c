"""The end-of-day stages kept up to date from a stream of the chain.

Each batch is put into the stored chain by its keys, and both stages are worked out again from
the first day that it touches, going on from the stored rows before. Batch ids are the tokens of
the writes, so a batch that is run again after a failure, anywhere in it, writes what it would
have written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, Params
from ..plans import eod
from ..sources import daytable
from ..sources.daytable import DAY
from ..sources.store import scope
from .ingest import KEY


def table(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """chain, stage1 or stage2 as stored under base; None before the first batch."""
    x = daytable.read(spark, f"{base}/{name}")
    return x if x is None else x.drop(DAY)


def last_snapshot(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows of each symbol's last time; only the days that hold one are read."""
    x = daytable.latest(spark, f"{base}/chain", "symbol")
    return x if x is None else x.drop(DAY)


def write_batch(rows: DataFrame, batch_id: int, base: str, p: Params = DEFAULTS) -> None:
    """Takes one batch into the three tables under base. An empty batch changes nothing; late rows redo their day and those after it."""
    spark, token = rows.sparkSession, f"batch-{batch_id}"
    with scope(spark):
        days = daytable.upsert(spark, f"{base}/chain", rows.withColumn(DAY, F.to_date("timestamp")).filter(F.col(DAY).isNotNull()), KEY, token)
        if not days:
            return
        daytable.note_last(spark, f"{base}/chain", days, "symbol", token)
        first = min(days)
        chain = daytable.read(spark, f"{base}/chain").filter(F.col(DAY) >= F.lit(first)).drop(DAY)
        stored = daytable.read(spark, f"{base}/stage1")
        before = None if stored is None else stored.filter(F.col(DAY) < F.lit(first)).drop(DAY)
        daytable.replace_from(spark, f"{base}/stage1", eod.stage1(chain, p, before).withColumn(DAY, F.col("date")), first, token)
        _second(spark, base, first, token, p)


def _second(spark: SparkSession, base: str, first, token: str, p: Params) -> None:
    """Stage 2 from a day on. The row before that day changes too, as it looks at the next one; the table is one row a symbol, day and rank."""
    rows = daytable.read(spark, f"{base}/stage1")
    if rows is None:
        return
    series = rows.groupBy("symbol", "expiry_rank").agg(F.max(F.when(F.col(DAY) < F.lit(first), F.col(DAY))).alias("before"), F.max(DAY).alias("last"))
    start = series.filter(F.col("last") >= F.lit(first)).agg(F.min("before")).first()[0] or first
    daytable.replace_from(spark, f"{base}/stage2", eod.stage2(rows.drop(DAY), p).withColumn(DAY, F.col("date")), min(start, first), token)


def start(rows: DataFrame, base: str, checkpoint: str, p: Params = DEFAULTS) -> StreamingQuery:
    """Works off what the stream of chain rows holds; a restart goes on with the batch that was not finished."""
    return rows.writeStream.foreachBatch(lambda batch, n: write_batch(batch, n, base, p)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
