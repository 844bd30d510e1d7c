"""The option chain as a table, filters on its time, and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CELL = """
cell AS (
  SELECT CAST(l_suppkey % 5 AS INT) AS sid, CAST(l_orderkey % 8 AS INT) AS di, CAST(l_linenumber % 2 AS INT) AS sn,
    CAST(l_partkey % 2 AS INT) AS ex, CAST((FLOOR(l_partkey / 2) + l_quantity) % 21 AS INT) AS ki, COUNT(*) AS n,
    SUM(CAST(l_quantity AS BIGINT)) AS q, SUM(CAST(51 - l_quantity AS BIGINT)) AS r,
    SUM(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT)) AS qc,
    SUM(CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT)) AS rc,
    SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS dsum, SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS tsum
  FROM lineitem GROUP BY 1, 2, 3, 4, 5
), geo AS (
  SELECT *, (di * 3 + sid + sn) % 5 - 2 AS mv, ki - 10 AS kk,
    CASE sid WHEN 0 THEN 'NIFTY' WHEN 1 THEN 'BANKNIFTY' WHEN 2 THEN 'RELIANCE' WHEN 3 THEN 'TATASTEEL' ELSE 'ITC' END AS symbol,
    CASE sid WHEN 0 THEN 20000.0D WHEN 1 THEN 45000.0D WHEN 2 THEN 2600.0D WHEN 3 THEN 140.0D ELSE 450.0D END AS base,
    CASE sid WHEN 0 THEN 50.0D WHEN 1 THEN 100.0D WHEN 2 THEN 20.0D WHEN 3 THEN 2.5D ELSE 5.0D END AS step,
    DATE '2024-01-08' + (di + CASE WHEN di >= 5 THEN 2 ELSE 0 END) AS d,
    CASE ex WHEN 0 THEN DATE '2024-01-25' ELSE DATE '2024-02-29' END AS expiry
  FROM cell
), plain AS (
  SELECT symbol, expiry, CAST(CONCAT(CAST(d AS STRING), CASE sn WHEN 0 THEN ' 09:30:00' ELSE ' 15:29:00' END) AS TIMESTAMP) AS timestamp,
    base + step * kk AS strike_price, base + step * mv AS underlying_price, base + step * mv + step * 0.25D * (ex + 1) AS fut_price,
    base + step * mv AS atm_strike, step * (kk - mv) AS distance_from_atm, CAST(DATEDIFF(expiry, d) AS INT) AS days_to_expiry,
    CAST(CASE sid WHEN 0 THEN 50 WHEN 1 THEN 15 WHEN 2 THEN 250 WHEN 3 THEN 5500 ELSE 1600 END AS INT) AS lotsize,
    CAST(q * 100 AS DOUBLE) AS ce_oi, CAST(r * 100 AS DOUBLE) AS pe_oi, CAST(qc * 100 AS DOUBLE) AS ce_oi_change, CAST(rc * 100 AS DOUBLE) AS pe_oi_change,
    CAST(q * 7 AS DOUBLE) AS ce_volume, CAST(r * 7 AS DOUBLE) AS pe_volume,
    GREATEST(step * (mv - kk), 0.0D) + CAST(1 + dsum AS DOUBLE) AS ce_ltp, GREATEST(step * (kk - mv), 0.0D) + CAST(1 + tsum AS DOUBLE) AS pe_ltp,
    CAST(1 + dsum AS DOUBLE) AS ce_time_value, CAST(1 + tsum AS DOUBLE) AS pe_time_value,
    10.0D + CAST(dsum AS DOUBLE) / CAST(n AS DOUBLE) AS ce_iv, 11.0D + CAST(tsum AS DOUBLE) / CAST(n AS DOUBLE) AS pe_iv,
    0.5D - 0.04D * (kk - mv) AS ce_delta, -0.5D - 0.04D * (kk - mv) AS pe_delta,
    0.000244140625D * (1 + (di * 2) % 5) / (1 + ABS(kk - mv)) AS ce_gamma, 0.0006103515625D / (1 + ABS(kk - mv + 1)) AS pe_gamma,
    0.05D AS ce_bid_ask_spread, 0.05D AS pe_bid_ask_spread
  FROM geo
), ocdata AS (
  SELECT *, (ce_gamma * ce_oi - pe_gamma * pe_oi) * lotsize AS net_gexv, ce_oi_change * 0.5D AS ce_vanna_ex, pe_oi_change * -0.25D AS pe_vanna_ex,
    ce_oi_change * 0.5D - pe_oi_change * 0.25D AS net_vanna_ex, (ce_oi - pe_oi) * 0.125D AS net_charm_ex, ce_oi_change - pe_oi_change AS net_flow,
    ce_volume * 3 AS ce_tbq, pe_volume * 2 AS pe_tbq, ce_ltp * 0.75D + 1 AS ce_tprice, pe_ltp * 0.75D + 2 AS pe_tprice,
    ce_delta * ce_oi_change AS ce_delta_oi_chg, pe_delta * pe_oi_change AS pe_delta_oi_chg, ce_oi * ce_ltp AS ce_prem_oi, pe_oi * pe_ltp AS pe_prem_oi,
    ABS(ce_delta) * 0.875D AS ce_nd2, ABS(pe_delta) * 0.875D AS pe_nd2,
    12.0D AS m_volatility, ce_ltp + pe_ltp AS expected_move_straddle, underlying_price * 0.05D AS expected_move_theoretical
  FROM plain
)"""


def duckdb_chain() -> str:
    """The chain as WITH clauses of another SQL dialect, for side-by-side checks."""
    import re

    text = re.sub(r"(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", _CELL)
    return "WITH " + text.replace("DATEDIFF(expiry, d)", "DATE_DIFF('day', d, expiry)")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An option chain derived from the order lines of sf_dir: one row for each symbol, expiry, timestamp and strike."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql("WITH " + _CELL.replace("FROM lineitem", "FROM {lines}") + " SELECT * FROM ocdata", lines=lines)


def chain_table(spark: SparkSession, name: str) -> DataFrame | None:
    """The chain of a table or view of that name; None if there is no such table."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def to_csv(df: DataFrame, path: str) -> None:
    """Writes df as CSV files with a header, nulls as empty fields."""
    json_safe(df).write.mode("overwrite").csv(path, header=True, nullValue="")


def at_time(when: str, column: str = "timestamp") -> Column:
    """A range filter on a day (10 characters), a minute (16) or an exact time, so that files are pruned by their statistics."""
    lo = F.to_timestamp(F.lit(when if len(when) > 10 else when + " 00:00:00"))
    if len(when) == 10:
        return (F.col(column) >= lo) & (F.col(column) < lo + F.expr("INTERVAL 1 DAY"))
    if len(when) == 16:
        return (F.col(column) >= lo) & (F.col(column) < lo + F.expr("INTERVAL 1 MINUTE"))
    return F.col(column) == lo


def latest(chain: DataFrame, *keys: str) -> DataFrame:
    """The rows of the last timestamp for each key. The last times are few; their join is left to the planner."""
    last = chain.groupBy(*keys).agg(F.max("timestamp").alias("timestamp"))
    return chain.join(last, [*keys, "timestamp"], "left_semi")


def json_safe(df: DataFrame) -> DataFrame:
    """df with nulls for doubles that are not finite."""
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n) & (F.abs(n) != float("inf")), F.col(n)) for n in doubles})


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those that share their keys; columns that one lacks are null."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """The ticker map of a CSV file with a header."""
    return spark.read.csv(path, header=True)
