"""The chain as a stream: late and repeated snapshots are dropped, and the day's table is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

KEY = ["symbol", "expiry", "strike_price", "timestamp"]


def read_stream(spark: SparkSession, path: str, schema: StructType, late: str = "10 minutes") -> DataFrame:
    """Rows of a folder that files are dropped into, each key once; state goes when the watermark has passed."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("timestamp", late).dropDuplicatesWithinWatermark(KEY)


def totals(rows: DataFrame, window: str = "1 hour") -> DataFrame:
    """Open interest and rows of each symbol in each window of time; a batch or a stream."""
    w = F.window("timestamp", window)
    return rows.groupBy(w.alias("w"), "symbol").agg(F.sum("ce_oi").alias("ce_oi"), F.sum("pe_oi").alias("pe_oi"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "symbol", "ce_oi", "pe_oi", "n")


def start(rows: DataFrame, into: str, checkpoint: str) -> StreamingQuery:
    """Appends rows as Parquet, partitioned by day, until the input is used up; a restart goes on where it stopped."""
    day = rows.withColumn("trade_date", F.to_date("timestamp"))
    return day.writeStream.format("parquet").partitionBy("trade_date").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
