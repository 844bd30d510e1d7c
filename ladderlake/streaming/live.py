"""The last two snapshots of every live ladder, kept in the state of a stream, and screens over them.

State is keyed by symbol and expiry and holds two snapshots, so it is as large as the live part of
the chain however long the stream runs. A timer drops a ladder when its expiry has passed. The
last two times of a symbol are among the last two of its ladders, so screens that compare those
find every row that they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.store import delete, exists

VALUES = ["ce_ltp", "pe_ltp", "ce_volume", "pe_volume", "ce_iv", "pe_iv"]
_ROW = "at long, strike_price double, " + ", ".join(f"{v} double" for v in VALUES)
_OUT = f"symbol string, expiry string, {_ROW}"
_COLUMNS = ["at", "strike_price", *VALUES]


class LastTwo(StatefulProcessor):
    """Holds the rows of a ladder's last two times; hands all of them on whenever one changes, and one row without a time when the ladder has lapsed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", _ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=_COLUMNS)
        new = pd.concat([r[[*_COLUMNS, "arrived"]] for r in rows]).sort_values(["at", "strike_price", "arrived"])[_COLUMNS]
        both = pd.concat([known, new]) if len(known) else new
        both = both.drop_duplicates(["at", "strike_price"], keep="last")
        both = both[both["at"].isin(sorted(both["at"].unique())[-2:])].astype({c: float for c in _COLUMNS[1:]})
        lapses = int(pd.Timestamp(key[1]).value // 10**6) + 86_400_000
        if not len(known) and lapses > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(lapses)
        self.rows.put([tuple(r) for r in both.itertuples(index=False, name=None)])
        yield both.assign(symbol=key[0], expiry=key[1])[["symbol", "expiry", *_COLUMNS]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield pd.DataFrame({"symbol": [key[0]], "expiry": [key[1]]} | {c: [None] for c in _COLUMNS}).astype({"at": "Int64"} | {c: float for c in _COLUMNS[1:]})

    def close(self) -> None:
        pass


def last_two(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of the ladders that changed: the rows of their last two times, or one without a time if they have lapsed.

    Rows without a price or without a key take no part. Rows may come late by that much; of several
    rows of one key, the greatest by value stays within a batch, and the later batch's otherwise.
    """
    price = F.coalesce("ce_ltp", F.lit(0.0)) + F.coalesce("pe_ltp", F.lit(0.0)) > 0
    x = rows.withWatermark("timestamp", late).filter(price & F.col("symbol").isNotNull() & F.col("expiry").isNotNull() & F.col("strike_price").isNotNull() & F.col("timestamp").isNotNull())
    x = x.select("symbol", F.col("expiry").cast("string").alias("expiry"), "timestamp", F.unix_micros("timestamp").alias("at"), *(F.col(c).cast("double").alias(c) for c in _COLUMNS[1:]), F.xxhash64(*VALUES).alias("arrived"))
    return x.groupBy("symbol", "expiry").transformWithStateInPandas(LastTwo(), _OUT, "update", "eventTime")


def current(spark: SparkSession, base: str) -> DataFrame | None:
    """The last two snapshots of all live ladders as chain rows; None before the first batch."""
    versions = _versions(spark, base)
    if not versions:
        return None
    x = spark.read.parquet(f"{base}/v={versions[-1]}")
    return x.select("symbol", F.col("expiry").cast("date").alias("expiry"), F.timestamp_micros("at").alias("timestamp"), *_COLUMNS[1:])


def _versions(spark: SparkSession, base: str) -> list[int]:
    """The finished versions of the table, oldest first."""
    if not exists(spark, base):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    names = (f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
    return sorted(v for v in (int(n[2:]) for n in names if n.startswith("v=")) if exists(spark, f"{base}/v={v}/_SUCCESS"))


def write_batch(changed: DataFrame, batch_id: int, base: str) -> None:
    """Writes the version of a batch: ladders that changed in place of their old rows. Run again, it writes the same; older versions than the last go."""
    spark = changed.sparkSession
    older = [v for v in _versions(spark, base) if v < batch_id]
    rows = changed.filter("at IS NOT NULL")
    if older:
        held = spark.read.parquet(f"{base}/v={older[-1]}")
        rows = held.join(changed.select("symbol", "expiry").distinct(), ["symbol", "expiry"], "left_anti").unionByName(rows)
    rows.write.mode("overwrite").parquet(f"{base}/v={batch_id}")
    for v in older[:-1]:
        delete(spark, f"{base}/v={v}")


def start(rows: DataFrame, base: str, checkpoint: str, late: str = "1 day", **trigger) -> StreamingQuery:
    """Keeps the table under base up to date; by default it works off what the stream holds. The session needs the RocksDB state store."""
    x = last_two(rows, late)
    return x.writeStream.outputMode("update").foreachBatch(lambda batch, n: write_batch(batch, n, base)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
