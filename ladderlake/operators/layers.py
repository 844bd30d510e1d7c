"""Layers of exposure over the time of a ladder: gamma, direction and vanna, and how they diverge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SNAPSHOT
from ..functions.expressions import chosen, expected_move, ratio
from .flows import tradeable, with_greeks
from .ladder import analysis_range, gamma_flip, net_gamma

KEYS = list(SNAPSHOT)


def usable(chain: DataFrame, min_volume: float = 100.0) -> DataFrame:
    """Rows with enough volume and with Greeks; spreads do not matter here."""
    return with_greeks(tradeable(chain, min_volume=min_volume, max_spread_pct=float("inf")))


def gamma_layer(rows: DataFrame) -> DataFrame:
    """(keys, spot, total_gex, flip, flip_strike, peak_pos_strike, peak_pos_gex, peak_neg_strike, peak_neg_gex), in millions.

    Flip and peaks are those of the strikes within an expected move and a buffer of spot; the flip
    is the change of sign nearest to the strike in the middle of them.
    """
    w = Window.partitionBy(*KEYS)
    iv = F.coalesce(F.median(F.when(F.col("ce_iv") > 0, F.col("ce_iv"))), F.lit(0.0))
    head = rows.groupBy(*KEYS).agg(F.median("underlying_price").alias("spot"), F.median("days_to_expiry").alias("dte"), F.median("lotsize").alias("lot"), iv.alias("iv"))
    lo, hi = analysis_range(F.col("spot"), expected_move(F.col("spot"), F.col("iv"), F.col("dte")))
    x = rows.join(head, KEYS).withColumn("g", net_gamma("lot")).withColumn("near", F.col("strike_price").between(lo, hi))
    near = x.filter("near").withColumns({"place": F.row_number().over(w.orderBy("strike_price")), "n": F.count("*").over(w)})
    near = near.withColumn("middle", F.max(F.when(F.col("place") == F.floor(F.col("n") / 2) + 1, F.col("strike_price"))).over(w))
    flips = gamma_flip(near, KEYS, "middle").select(*KEYS, F.col("gamma_flip").alias("flip"), F.col("flip_nearest").alias("flip_strike"))
    s, of = F.col("strike_price"), F.when(F.col("near"), F.col("g"))
    top, low = F.max(F.struct(of.alias("g"), (-s).alias("s"))), F.min(F.when(F.col("near"), F.struct("g", s.alias("s"))))
    peak = lambda of, sign, name: [F.when(sign * of["g"] > 0, sign * -of["s"] if sign > 0 else of["s"]).alias(f"{name}_strike"), F.when(sign * of["g"] > 0, F.round(of["g"] / 1e6, 6)).alias(f"{name}_gex")]
    sums = x.groupBy(*KEYS).agg(F.first("spot").alias("spot"), F.round(F.sum("g") / 1e6, 6).alias("total_gex"), *peak(top, 1, "peak_pos"), *peak(low, -1, "peak_neg"))
    return sums.join(flips, KEYS, "left")


def directional_layer(rows: DataFrame) -> DataFrame:
    """(keys, net_delta_flow, ce_delta_flow, pe_delta_flow, centroid, rotation_peak, rotation_nearest): where changes of open interest, weighted by delta, sit."""
    net = F.col("ce_delta_oi_chg") + F.col("pe_delta_oi_chg")
    k = F.col("strike_price")
    x = rows.groupBy(*KEYS).agg(F.median("underlying_price").alias("at"), F.sum("ce_delta_oi_chg").alias("ce"), F.sum("pe_delta_oi_chg").alias("pe"), ratio(F.sum(k * F.abs(net)), F.sum(F.abs(net))).alias("center"), F.max(F.struct(F.round(F.abs(net), 6).alias("n"), (-k).alias("less"))).alias("most"), F.collect_list("strike_price").alias("strikes"))
    nearest = F.array_min(F.transform("strikes", lambda s: F.struct(F.round(F.abs(s - F.col("center")), 9).alias("d"), s.alias("k"))))["k"]
    some = F.col("center").isNotNull()
    return x.select(*KEYS, F.round(F.col("ce") + F.col("pe"), 2).alias("net_delta_flow"), F.round("ce", 2).alias("ce_delta_flow"), F.round("pe", 2).alias("pe_delta_flow"), F.round(F.coalesce("center", "at"), 1).alias("centroid"), F.when(some, -F.col("most.less")).otherwise(F.col("at")).alias("rotation_peak"), F.when(some, nearest).otherwise(F.col("at")).alias("rotation_nearest"))


def vanna_layer(rows: DataFrame) -> DataFrame:
    """(keys, net_vanna, vanna_peak, vanna_peak_value)."""
    most = F.max(F.struct(F.round(F.abs("net_vanna_ex"), 6).alias("n"), (-F.col("strike_price")).alias("less"), "net_vanna_ex"))
    return rows.groupBy(*KEYS).agg(F.round(F.sum("net_vanna_ex"), 2).alias("net_vanna"), most.alias("m")).select(*KEYS, "net_vanna", (-F.col("m.less")).alias("vanna_peak"), F.round("m.net_vanna_ex", 2).alias("vanna_peak_value"))


def exposure_layers(chain: DataFrame) -> DataFrame:
    """All layers of each ladder over time, their changes since the time before, and how they diverge."""
    rows = usable(chain)
    x = gamma_layer(rows).join(directional_layer(rows), KEYS).join(vanna_layer(rows), KEYS)
    w = Window.partitionBy("symbol", "expiry").orderBy("timestamp")
    moved = lambda n: F.col(n) - F.lag(n).over(w)
    x = x.withColumns({"flip_change": F.round(moved("flip"), 1), "gex_change": F.round(moved("total_gex"), 6), "vanna_change": F.round(moved("net_vanna"), 2), "spot_change": F.round(moved("spot"), 2)})
    size = lambda n: F.when(F.col(n) != 0, F.abs(n)).otherwise(1.0)
    pin = (F.abs("gex_change") < size("total_gex") * 0.15) & (F.abs("vanna_change") > size("net_vanna") * 0.2)
    flow, known = F.col("net_delta_flow"), F.col("gex_change").isNotNull()
    return x.withColumns({
        "gamma_vanna": chosen([(pin, "fragile_pin"), (F.abs("gex_change") > size("total_gex") * 0.3, "gamma_shift")]),
        "delta_gamma": F.when(known & (F.abs(flow) > 100) & (F.col("total_gex") > 0), "coiled_spring"),
        "delta_price": chosen([((flow > 0) & (F.col("spot_change") < 0), "bullish_accumulation"), ((flow < 0) & (F.col("spot_change") > 0), "bearish_distribution")]),
    })


def exposure_profiles(chain: DataFrame, periods: int = 2) -> DataFrame:
    """Strike by strike exposures of each ladder's last times."""
    rank = F.dense_rank().over(Window.partitionBy("symbol", "expiry").orderBy(F.desc("timestamp")))
    x = usable(chain).withColumn("rk", rank).filter(F.col("rk") <= periods)
    side = lambda s: F.round(F.col(f"{s}_gamma") * F.col(f"{s}_oi") * F.col("lotsize") / 1e6, 6).alias(f"{s}_gex")
    return x.select(*KEYS, "strike_price", F.round(F.col("net_gexv") / 1e6, 6).alias("net_gex"), side("ce"), side("pe"), *(F.round(f"{s}_delta_oi_chg", 2).alias(f"{s}_delta_flow") for s in ("ce", "pe")), F.round("net_vanna_ex", 2).alias("net_vanna"))
