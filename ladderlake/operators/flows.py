"""Flows between delta buckets, and clusters of money with what happens in them, over the time of a ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUCKETS
from ..functions.expressions import buy_imbalance, chosen, delta_bucket, dte_regime, flow_type, ratio
from ..sources.ocdata import at_time
from .clusters import clusters, time_value_oi, tracks
from .screens import eod_rows, live

LADDER = ["symbol", "expiry"]
_nz = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def tradeable(chain: DataFrame, min_oi: float = 0.0, min_volume: float = 0.0, max_spread_pct: float = 15.0) -> DataFrame:
    """Rows of which some side has the open interest, some side the volume and some side a narrow spread; a side without a price has none."""
    spread = lambda s: F.when(F.col(f"{s}_ltp") > 0, _nz(f"{s}_bid_ask_spread") / F.col(f"{s}_ltp") * 100).otherwise(999.0)
    either = lambda f: f("ce") | f("pe")
    return chain.filter(either(lambda s: _nz(f"{s}_oi") >= min_oi) & either(lambda s: _nz(f"{s}_volume") >= min_volume) & either(lambda s: spread(s) <= max_spread_pct))


def with_greeks(chain: DataFrame) -> DataFrame:
    """Rows of which a side has both a delta and a volatility."""
    has = lambda s: (F.abs(_nz(f"{s}_delta")) > 0) & (_nz(f"{s}_iv") > 0)
    return chain.filter(has("ce") | has("pe"))


def cohorts(chain: DataFrame) -> DataFrame:
    """Tradeable rows with ce_open and pe_open, the buckets that their strikes had in the ladder's first snapshot, DEEP_OTM if absent then; ce_now and pe_now; migrated.

    The first time of a ladder is an aggregate that is joined back, so no history is sorted.
    """
    x = with_greeks(tradeable(chain))
    first = x.groupBy(*LADDER).agg(F.min("timestamp").alias("timestamp"))
    bucket = lambda s: delta_bucket(F.abs(_nz(f"{s}_delta")))
    opening = x.join(first, [*LADDER, "timestamp"], "left_semi").select(*LADDER, "strike_price", bucket("ce").alias("ce_open"), bucket("pe").alias("pe_open"))
    x = x.join(opening, [*LADDER, "strike_price"], "left").fillna(BUCKETS[-1], ["ce_open", "pe_open"]).withColumns({"ce_now": bucket("ce"), "pe_now": bucket("pe")})
    return x.withColumn("migrated", (F.col("ce_open") != F.col("ce_now")) | (F.col("pe_open") != F.col("pe_now")))


def flow_buckets(chain: DataFrame) -> DataFrame:
    """Flows of each bucket over time: sums, running sums of the changes of open interest, their velocity and acceleration.

    A strike keeps the bucket of its call's delta in the first snapshot.
    """
    total = lambda *names: [F.sum(_nz(n)).alias(n) for n in names]
    x = cohorts(chain).withColumnRenamed("ce_open", "bucket").groupBy(*LADDER, "bucket", "timestamp").agg(
        *total("ce_oi", "pe_oi", "ce_oi_change", "pe_oi_change", "ce_tbq", "pe_tbq", "net_vanna_ex", "net_flow"), F.countDistinct("strike_price").alias("strikes"),
        F.sum(F.col("migrated").cast("int")).alias("migrated"), F.min("strike_price").alias("min_strike"), F.max("strike_price").alias("max_strike"),
    )
    w = Window.partitionBy(*LADDER, "bucket").orderBy("timestamp")
    cumulative = lambda s: F.sum(f"{s}_oi_change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    moved = lambda n: F.coalesce(F.col(n) - F.lag(n).over(w), F.lit(0.0))
    x = x.withColumns({"ce_cum_flow": cumulative("ce"), "pe_cum_flow": cumulative("pe")})
    x = x.withColumns({"net_cum_flow": F.col("ce_cum_flow") - F.col("pe_cum_flow"), "ce_velocity": moved("ce_cum_flow"), "pe_velocity": moved("pe_cum_flow")})
    x = x.withColumns({"ce_acceleration": moved("ce_velocity"), "pe_acceleration": moved("pe_velocity"), "pcr": F.round(ratio(F.col("pe_oi"), F.when(F.col("ce_oi") > 0, F.col("ce_oi"))), 3)})
    return x


def _ends(chain: DataFrame) -> DataFrame:
    """(ladder, first, last, dte, spot_first, spot_last) of each ladder."""
    x = with_greeks(tradeable(chain)).groupBy(*LADDER, "timestamp").agg(F.avg("underlying_price").alias("spot"), F.max("days_to_expiry").alias("dte"))
    return x.groupBy(*LADDER).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.median("dte").alias("dte"), F.min_by("spot", "timestamp").alias("spot_first"), F.max_by("spot", "timestamp").alias("spot_last"))


def flow_signals(chain: DataFrame) -> DataFrame:
    """Of each bucket at the ladder's last time: what its changes of open interest say beside the change of spot since the first time, the dominant flow, and its strikes."""
    x = flow_buckets(chain).join(_ends(chain), LADDER).filter("timestamp = last")
    spot = F.col("spot_last") - F.col("spot_first")
    ce, pe = F.col("ce_oi_change"), F.col("pe_oi_change")
    told = lambda oi, with_it: chosen([((oi > 0) & with_it, "Long Build-Up"), (oi > 0, "Short Build-Up"), ((oi < 0) & with_it, "Short Covering"), (oi < 0, "Long Unwinding")], "Neutral")
    # a put gains as spot falls or stands still; its covering and unwinding follow spot the same way
    put = chosen([((pe > 0) & (spot <= 0), "Long Build-Up"), (pe > 0, "Short Build-Up"), ((pe < 0) & (spot <= 0), "Short Covering"), (pe < 0, "Long Unwinding")], "Neutral")
    tilt = F.round(buy_imbalance(F.col("ce_tbq"), F.col("pe_tbq")), 3)
    return x.select(*LADDER, "bucket", "timestamp", F.round(spot, 2).alias("spot_chg"), dte_regime(F.col("dte")).alias("dte_regime"), told(ce, spot > 0).alias("ce_signal"), put.alias("pe_signal"), flow_type(ce, pe, spot, F.col("ce_tbq"), F.col("pe_tbq")).alias("flow_type"), tilt.alias("buy_imbalance"), "strikes", "migrated", "min_strike", "max_strike", "pcr")


def flow_crossing(chain: DataFrame, stable_pct: float = 1.0, cross_pct: float = 5.0) -> DataFrame:
    """Ladders whose open interest is within stable_pct of what it was at first while a bucket's share moved by cross_pct points: the first such bucket from deep in the money outwards."""
    oi = F.col("ce_oi") + F.col("pe_oi")
    at = lambda when: F.sum(F.when(F.col("timestamp") == F.col(when), oi).otherwise(0.0))
    x = flow_buckets(chain).join(_ends(chain).filter("first < last"), LADDER).groupBy(*LADDER, "bucket").agg(at("first").alias("a"), at("last").alias("b"))
    whole = Window.partitionBy(*LADDER)
    x = x.withColumns({"all_a": F.sum("a").over(whole), "all_b": F.sum("b").over(whole)}).filter("all_a > 0")
    x = x.withColumns({"total_oi_chg": F.abs(F.col("all_b") - F.col("all_a")) / F.col("all_a") * 100, "share_change": F.coalesce(ratio(F.col("b"), F.col("all_b")), F.lit(0.0)) * 100 - F.col("a") / F.col("all_a") * 100})
    x = x.filter((F.col("total_oi_chg") <= stable_pct) & (F.abs("share_change") >= cross_pct))
    place = chosen([(F.col("bucket") == name, i) for i, name in enumerate(BUCKETS)])
    first = F.min(F.struct(place.alias("place"), "bucket", "share_change", "total_oi_chg"))
    x = x.groupBy(*LADDER).agg(first.alias("f")).select(*LADDER, "f.*")
    return x.select(*LADDER, "bucket", F.when(F.col("share_change") > 0, "increasing").otherwise("decreasing").alias("direction"), F.round("share_change", 2).alias("share_change"), F.round("total_oi_chg", 2).alias("total_oi_chg"))


def migrated_strikes(chain: DataFrame) -> DataFrame:
    """Strikes at their ladder's last time whose bucket is not that of the first."""
    side = lambda s: [F.round(F.abs(_nz(f"{s}_delta")), 3).alias(f"{s}_delta"), f"{s}_open", f"{s}_now", (F.col(f"{s}_open") != F.col(f"{s}_now")).alias(f"{s}_migrated"), _nz(f"{s}_oi").alias(f"{s}_oi"), _nz(f"{s}_oi_change").alias(f"{s}_oi_change")]
    x = cohorts(chain)
    last = x.groupBy(*LADDER).agg(F.max("timestamp").alias("timestamp"))
    return x.join(last, [*LADDER, "timestamp"], "left_semi").filter("migrated").select(*LADDER, "timestamp", "strike_price", *side("ce"), *side("pe"))


def _money(rows: DataFrame, s: str) -> DataFrame:
    """What is averaged over a cluster's strikes of one side, with the weight w. A chain without chances to end in the money has 0 there."""
    nd2 = _nz(f"{s}_nd2") if f"{s}_nd2" in rows.columns else F.lit(0.0)
    turned = F.coalesce(ratio(_nz(f"{s}_oi_change"), F.when(_nz(f"{s}_volume") > 0, _nz(f"{s}_volume"))), F.lit(0.0))
    return rows.select(
        *LADDER, "timestamp", F.col("strike_price").alias("k"), time_value_oi(s).alias("w"), F.abs(_nz(f"{s}_delta")).alias("avg_delta"), _nz(f"{s}_iv").alias("avg_iv"),
        _nz(f"{s}_gamma").alias("avg_gamma"), nd2.alias("avg_nd2"), (_nz(f"{s}_ltp") * _nz(f"{s}_oi_change")).alias("prem_flow"), (_nz(f"{s}_ltp") * _nz(f"{s}_oi")).alias("premium_oi"),
        turned.alias("oi_vol_ratio"), (_nz(f"{s}_oi_change") * _nz(f"{s}_gamma") * _nz("lotsize")).alias("gamma_adj_oi"), *(_nz(n).alias(n) for n in ("ce_oi", "pe_oi", "ce_tbq", "pe_tbq")),
    )


def money_clusters(chain: DataFrame, min_volume: float = 100.0, min_oi: float = 0.0, max_spread_pct: float = 15.0, min_oi_change: float = 0.0, **shape) -> DataFrame:
    """Clusters of both sides of each tradeable ladder, with means weighted as the clusters are, put-call ratio and buy imbalance of their strikes.

    With min_oi_change, rows neither side of which changed by so much are left out. A cluster's
    strikes are joined back by its bounds, within its own ladder.
    """
    keys = [*LADDER, "timestamp"]
    if min_oi_change > 0:
        chain = chain.filter((F.abs(_nz("ce_oi_change")) >= min_oi_change) | (F.abs(_nz("pe_oi_change")) >= min_oi_change))
    rows = with_greeks(tradeable(chain, min_oi, min_volume, max_spread_pct))
    means = ["avg_delta", "avg_iv", "avg_gamma", "avg_nd2", "prem_flow", "premium_oi", "oi_vol_ratio", "gamma_adj_oi"]
    found = None
    for s in ("ce", "pe"):
        x = clusters(rows, s, **shape).join(_money(rows, s), keys).filter(F.col("k").between(F.col("min_strike"), F.col("max_strike")))
        x = x.groupBy(*keys, "center_strike", "peak_strike", "min_strike", "max_strike", "weight", "concentration", "members").agg(
            *(F.round(F.sum(F.col(n) * F.col("w")) / F.sum("w"), 4).alias(n) for n in means),
            F.round(ratio(F.sum("pe_oi"), F.when(F.sum("ce_oi") > 0, F.sum("ce_oi"))), 3).alias("pcr"), F.round(buy_imbalance(F.sum("ce_tbq"), F.sum("pe_tbq")), 3).alias("buy_imbalance"),
        ).withColumn("side", F.lit(s.upper()))
        found = x if found is None else found.unionByName(x)
    return found


def end_of_day(chain: DataFrame, as_of: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A chain of one snapshot a day: the last rows of each live strike, all at the day's start; by default the five days up to a symbol's last one."""
    rows = eod_rows(chain, as_of, first=first, last=last)
    if first is None:
        ends = chain.groupBy("symbol").agg(F.to_date(F.max("timestamp")).alias("_last"))
        rows = rows.join(ends, "symbol").filter(F.col("date") >= F.date_sub("_last", 5)).drop("_last")
    return rows.withColumn("timestamp", F.col("date").cast("timestamp")).drop("date")


def one_day(chain: DataFrame, as_of: str, day: str | None = None) -> DataFrame:
    """The live rows with a price of one day, by default each symbol's last one."""
    rows = live(chain, as_of).filter((_nz("ce_ltp") > 0) | (_nz("pe_ltp") > 0))
    if day is not None:
        return rows.filter(at_time(day))
    ends = chain.groupBy("symbol").agg(F.to_date(F.max("timestamp")).alias("_last"))
    return rows.join(ends, "symbol").filter(F.to_date("timestamp") == F.col("_last")).drop("_last")


def smart_money(chain: DataFrame, tolerance_pct: float = 2.0, **shape) -> DataFrame:
    """The clusters of both sides on their tracks, with velocity and acceleration of the flow of premium along a track."""
    found = money_clusters(chain, **shape)
    keys = [*LADDER, "timestamp"]
    spots = chain.groupBy(*keys).agg(F.median("underlying_price").alias("spot"))
    w = Window.partitionBy("symbol", "expiry", "side", "track").orderBy("timestamp", "center_strike")
    moved = lambda n: F.coalesce(F.col(n) - F.lag(n).over(w), F.lit(0.0))
    named = tracks(found, spots, tolerance_pct, (*LADDER, "side")).select(*keys, "side", "center_strike", "track", "status")
    out = found.join(named, [*keys, "side", "center_strike"])
    x = out.withColumn("velocity", moved("prem_flow")).withColumn("acceleration", moved("velocity"))
    return x.withColumns({"velocity": F.round("velocity", 2), "acceleration": F.round("acceleration", 2)})
