"""What a ladder's gamma says about the day: boundaries, breaks, expected range, trend, structures and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SNAPSHOT
from ..functions.expressions import chosen, expected_move
from .ladder import analysis_range, gamma_flip, gamma_profile, net_gamma

KEYS = list(SNAPSHOT)

#: The names and sentences that the analysis answers with.
POSITIVE_GAMMA, NEGATIVE_GAMMA = "Positive Gamma", "Negative Gamma"
TRENDING, RANGE_UP, RANGE_DOWN, RANGE = "Directional / Trending", "Range Bound with Upward Drift", "Range Bound with Downward Drift", "Range Bound"
EXPANDING, PINNING, CHOPPY = "Directional moves with volatility expansion", "Pinning behavior with volatility compression", "Choppy mean-reverting price action"
NO_STRADDLES, NO_SHORT_ATM = "Avoid long straddles (volatility compression likely)", "Avoid short ATM options near gamma flip"
NO_SHORT_CALLS, NO_SHORT_PUTS = "Avoid naked short calls (upside acceleration risk)", "Avoid naked short puts (downside acceleration risk)"
NO_CONDORS = "Avoid iron condors and range-bound strategies"


def true_range(bars: DataFrame, days: int = 14) -> DataFrame:
    """(symbol, date, atr) of daily bars (symbol, date, high, low, close): the mean of the last days' true ranges, null before there are so many."""
    w = Window.partitionBy("symbol").orderBy("date")
    before = F.lag("close").over(w)
    x = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    last = w.rowsBetween(1 - days, 0)
    return x.select("symbol", "date", F.when(F.count("tr").over(last) == days, F.avg("tr").over(last)).alias("atr"))


def volatility_range(chain: DataFrame) -> DataFrame:
    """(symbol, timestamp, atr): a day's range in points from the annual volatility, null where that or the spot is not positive."""
    x = chain.groupBy("symbol", "timestamp").agg(F.avg(F.coalesce("m_volatility", F.lit(0.0))).alias("vol"), F.avg(F.coalesce("underlying_price", F.lit(0.0))).alias("spot"))
    return x.select("symbol", "timestamp", F.when((F.col("vol") > 0) & (F.col("spot") > 0), F.round(F.col("spot") * F.col("vol") / 100 / F.sqrt(F.lit(252.0)), 2)).alias("atr"))


def _heads(chain: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each ladder: spot, fut, dte, volatility at the money and the range of prices to look at."""
    near = F.struct(F.abs(F.col("strike_price") - F.col("atm_strike")).alias("d"), F.col("strike_price").alias("k"), F.coalesce("ce_iv", F.lit(0.0)).alias("iv"))
    x = chain.groupBy(*keys).agg(F.max("underlying_price").alias("spot"), F.max(F.coalesce("fut_price", "underlying_price")).alias("fut"), F.max("days_to_expiry").alias("dte"), F.slice(F.array_sort(F.collect_list(near)), 1, 2).alias("near"))
    move = expected_move(F.col("fut"), F.col("near")[0]["iv"], F.col("dte"))
    lo, hi = analysis_range(F.col("fut"), move)
    iv = F.aggregate("near", F.lit(0.0), lambda a, n: a + n["iv"]) / F.size("near")
    return x.select(*keys, "spot", "fut", "dte", iv.alias("atm_iv_pct"), lo.alias("lo"), hi.alias("hi"))


def _points(x: Column) -> Column:
    """A price as a whole number."""
    return F.format_string("%.0f", F.bround(x, 0))


def gamma_analysis(chain: DataFrame, keys: list[str] = KEYS, ranges: DataFrame | None = None, damping: float = 0.1, share: float = 0.75, decay: float = 0.4, window: int = 3, levels: int = 200) -> DataFrame:
    """One row for each ladder of chain.

    ranges: (symbol, timestamp, atr), from volatility_range by default. Upper boundary: the first
    level after the peak where the mean of it and the window levels before it has decayed. Lower
    boundary: the level below the flip at the end of the steepest fall over window levels. Where
    no range is known, breaks are null. Sentences come as arrays, empty where none applies.
    """
    heads = _heads(chain, keys)
    rows = chain.join(heads.select(*keys, "fut", "lo", "hi"), keys)
    inside = rows.filter(F.col("strike_price").between(F.col("lo"), F.col("hi"))).withColumn("g", net_gamma())
    flips = gamma_flip(inside, keys, "fut").select(*keys, "gamma_flip")
    heads = heads.join(flips, keys, "left").join(ranges if ranges is not None else volatility_range(chain), ["symbol", "timestamp"], "left")
    by_level = Window.partitionBy(*keys).orderBy("level")
    profile = gamma_profile(rows, keys, levels, ("lo", "hi")).join(heads.select(*keys, "spot", "gamma_flip"), keys)
    k, total, level = F.col("near_strike"), F.col("total"), F.col("level")
    top = F.max(F.struct(total.alias("g"), (-level).alias("l"))).over(Window.partitionBy(*keys))
    x = profile.withColumns({"top": top, "mean": F.avg(total).over(by_level.rowsBetween(-window, 0)), "fall": total - F.lag(total, window).over(by_level)})
    peak = F.col("top.g")
    zone, decayed = (peak > 0) & (total >= share * peak), (level >= window - F.col("top.l")) & (F.col("mean") <= (1 - decay) * peak)
    first = lambda cond, *order: F.min(F.when(cond, F.struct(*order, level.alias("l"), k.alias("k"))))["k"]
    found = x.groupBy(*keys).agg(
        F.min(F.struct(F.abs(k - F.col("spot")).alias("d"), level.alias("l"), total.alias("g")))["g"].alias("at_spot"), F.min(F.when(zone, k)).alias("magnet_lower"), F.max(F.when(zone, k)).alias("magnet_upper"),
        first(zone, (-total).alias("g")).alias("magnet_center"), F.round(F.max(F.when(zone, peak)), 4).alias("magnet_strength"), first(decayed).alias("upper_boundary"),
        first((k < F.col("gamma_flip")) & F.col("fall").isNotNull(), F.col("fall")).alias("lower_boundary"),
    )
    x = heads.join(found, keys)
    spot, flip, atr = F.col("spot"), F.col("gamma_flip"), F.col("gamma_adj_atr")
    scale = 1 / F.sqrt(1 + damping * F.abs("at_spot"))
    x = x.withColumns({"regime": F.when(flip.isNull() | (F.col("fut") >= flip), POSITIVE_GAMMA).otherwise(NEGATIVE_GAMMA), "gamma_adj_atr": F.round(F.col("atr") * scale, 2), "expected_range": F.when(F.col("atm_iv_pct") > 0, F.round(spot * F.col("atm_iv_pct") / 100 * F.sqrt(F.lit(1 / 252)) * scale, 2))})
    step = F.bround(atr, 0)
    x = x.withColumn("step", F.when(step != 0, step)).withColumns({"bullish_break": F.bround(F.col("upper_boundary") + F.col("step"), 0), "bearish_break": F.bround(F.col("lower_boundary") - F.col("step"), 0)})
    low, high, center, step, up, down = (F.col(n) for n in ("magnet_lower", "magnet_upper", "magnet_center", "step", "bullish_break", "bearish_break"))
    calm = F.col("regime") == POSITIVE_GAMMA
    trend = chosen([(~calm, TRENDING), (center.isNull(), RANGE), (spot < center, RANGE_UP)], RANGE_DOWN)
    behavior = chosen([(~calm, EXPANDING), (spot.between(low, high), PINNING)], CHOPPY)
    sold, near = calm & center.isNotNull() & step.isNotNull(), F.abs(spot - center) <= step
    structures = [
        (sold & near, F.concat(F.lit("Short Straddle @ "), _points(center))),
        (sold & near, F.concat(F.lit("Iron Condor: sell "), _points(center - step), F.lit("P/"), _points(center + step), F.lit("C  buy "), _points(center - 2 * step), F.lit("P/"), _points(center + 2 * step), F.lit("C"))),
        (sold & ~near & (spot < low), F.concat(F.lit("Put Credit Spread: sell "), _points(low), F.lit("P / buy "), _points(low - step), F.lit("P"))),
        (sold & ~near & (spot > high), F.concat(F.lit("Call Credit Spread: sell "), _points(high), F.lit("C / buy "), _points(high + step), F.lit("C"))),
        (~calm & (spot > up), F.concat(F.lit("Call Ratio Spread above "), _points(up))),
        (~calm & (spot < down), F.concat(F.lit("Put Backspread below "), _points(down))),
    ]
    warnings = [(calm, NO_STRADDLES), (F.abs(spot - flip) <= atr, NO_SHORT_ATM), (spot >= up - atr, NO_SHORT_CALLS), (spot <= down + atr, NO_SHORT_PUTS), (~calm, NO_CONDORS)]
    said = lambda cases: F.array_compact(F.array(*(F.when(a, F.lit(b)) for a, b in cases)))
    pin = calm & (F.col("dte") <= 10)
    return x.select(
        *keys, "spot", "fut", "dte", F.round("atm_iv_pct", 2).alias("atm_iv_pct"), "regime", "gamma_flip", F.round("at_spot", 4).alias("gamma_at_spot"), "magnet_lower", "magnet_upper", "magnet_center", "magnet_strength",
        "upper_boundary", "lower_boundary", "bullish_break", "bearish_break", F.round("atr", 2).alias("atr"), "gamma_adj_atr", "expected_range", trend.alias("trend"), behavior.alias("behavior"),
        F.when(pin, low).alias("pin_lower"), F.when(pin, high).alias("pin_upper"), said(structures).alias("structures"), said(warnings).alias("warnings"),
    )
