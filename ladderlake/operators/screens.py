"""Screens over the whole chain: one row for each symbol, strike or expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, SNAPSHOT
from ..functions.expressions import buildup, chosen, is_index, ratio
from ..sources.ocdata import latest

KEYS = list(SNAPSHOT)
_nz = lambda name, value=0.0: F.coalesce(name, F.lit(value))


def weighted_iv(ce="ce_iv", pe="pe_iv") -> Column:
    """Implied volatility weighted by open interest of both sides, null without any."""
    oi = F.sum(_nz("ce_oi") + _nz("pe_oi"))
    return ratio(F.sum(_nz(ce) * _nz("ce_oi") + _nz(pe) * _nz("pe_oi")), F.when(oi > 0, oi))


def overview(chain: DataFrame) -> DataFrame:
    """Each symbol at its last timestamp: sums, put-call ratio, weighted volatility and expected moves at the money."""
    at_money = F.col("distance_from_atm") == 0
    out = latest(chain, "symbol").groupBy("symbol", "timestamp").agg(
        F.round(F.avg("underlying_price"), 4).alias("spot"), F.round(F.avg("atm_strike"), 4).alias("atm_strike"), F.sum(_nz("ce_oi")).alias("total_ce_oi"), F.sum(_nz("pe_oi")).alias("total_pe_oi"),
        F.sum(_nz("ce_volume")).alias("total_ce_vol"), F.sum(_nz("pe_volume")).alias("total_pe_vol"), F.round(F.sum(_nz("net_gexv")), 2).alias("net_gex"),
        F.round(F.avg(_nz("ce_iv")), 4).alias("avg_ce_iv"), F.round(F.avg(_nz("pe_iv")), 4).alias("avg_pe_iv"), F.max(F.coalesce("lotsize", F.lit(1))).alias("lot_size"),
        F.round(weighted_iv(), 4).alias("oi_wtd_iv"), F.round(F.avg(_nz("m_volatility")) - F.avg(_nz("ce_iv")), 4).alias("rv_iv_spread"),
        F.round(F.avg(F.when(at_money, _nz("expected_move_straddle"))), 4).alias("exp_move_straddle"), F.round(F.avg(F.when(at_money, _nz("expected_move_theoretical"))), 4).alias("exp_move_theoretical"),
    )
    return out.withColumn("pcr", F.round(ratio(F.col("total_pe_oi"), F.col("total_ce_oi")), 3))


def liquid(chain: DataFrame, max_spread_pct: float = DEFAULTS.spread_max_pct) -> DataFrame:
    """Rows one of whose sides has open interest, volume and a narrow spread; a side without a price has none."""

    def side(s):
        spread = F.when(F.col(f"{s}_ltp") > 0, F.col(f"{s}_bid_ask_spread") / F.col(f"{s}_ltp") * 100).otherwise(999.0)
        return (F.col(f"{s}_oi") > 0) & (F.col(f"{s}_volume") > 0) & (spread <= max_spread_pct)

    return chain.filter(side("ce") | side("pe"))


def price_band(chain: DataFrame, pct: float = 10.0) -> DataFrame:
    """Rows whose strike lies within pct of their symbol's mean spot."""
    mean = chain.groupBy("symbol").agg(F.avg("underlying_price").alias("mean_spot"))
    return chain.join(mean, "symbol").filter(F.abs(F.col("strike_price") - F.col("mean_spot")) <= F.col("mean_spot") * (pct / 100))


def last_two(chain: DataFrame, *keys: str) -> DataFrame:
    """Rows of the last two timestamps of each key, with rk 1 or 2."""
    return chain.withColumn("rk", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("timestamp")))).filter("rk <= 2")


def now_and_before(chain: DataFrame, value: Column, keys: tuple = ("symbol", "strike_price", "expiry"), rank_by: tuple = ("symbol",), extra: dict | None = None) -> DataFrame:
    """(keys, now, before): a value at the last and last but one timestamp, by one aggregation instead of a self-join."""
    at = lambda n, x: F.max(F.when(F.col("rk") == n, x))
    out = last_two(chain, *rank_by).groupBy(*keys).agg(at(1, value).alias("now"), at(2, value).alias("before"), *(at(1, x).alias(k) for k, x in (extra or {}).items()))
    return out.filter(F.col("now").isNotNull() & F.col("before").isNotNull())


def volume_shockers(chain: DataFrame, as_of: str, top_n: int = 30, kind: str = "all") -> DataFrame:
    """Strikes whose volume rose the most: the three times top_n greatest, then those of kind, then top_n."""
    live = chain.filter((F.col("expiry") >= F.lit(as_of).cast("date")) & (_nz("ce_ltp") + _nz("pe_ltp") > 0))
    x = now_and_before(live, _nz("ce_volume") + _nz("pe_volume")).withColumn("delta", F.col("now") - F.col("before")).filter("delta > 0 AND now > 0")
    order = [F.desc("delta"), F.col("symbol"), F.col("expiry"), F.col("strike_price")]
    x = x.orderBy(*order).limit(3 * top_n)
    x = x if kind == "all" else x.filter(is_index(F.col("symbol")) == F.lit(kind == "index"))
    return x.orderBy(*order).limit(top_n).select("symbol", "strike_price", "expiry", F.col("now").alias("vol_now"), F.col("before").alias("vol_prev"), F.col("delta").alias("vol_delta"), F.round(ratio(F.col("delta") * 100, F.col("before")), 1).alias("vol_pct_chg"))


def live(chain: DataFrame, as_of: str, kind: str = "all") -> DataFrame:
    """Rows of expiries that have not lapsed, of indices, of stocks or of all symbols."""
    x = chain.filter(F.col("expiry") >= F.lit(as_of).cast("date"))
    return x if kind == "all" else x.filter(is_index(F.col("symbol")) == F.lit(kind == "index"))


def iv_shockers(chain: DataFrame, as_of: str, top_n: int = 30, kind: str = "all") -> DataFrame:
    """Live strikes whose mean implied volatility moved the most: the three times top_n greatest, then those of kind, then top_n.

    Rows without any volatility do not count, so they make no snapshot either.
    """
    iv = (_nz("ce_iv") + _nz("pe_iv")) / 2
    x = now_and_before(live(chain, as_of).filter(iv > 0), iv).withColumn("iv_delta", F.col("now") - F.col("before"))
    order = [F.desc(F.round(F.abs("iv_delta"), 9)), F.col("symbol"), F.col("expiry"), F.col("strike_price")]
    x = x.orderBy(*order).limit(3 * top_n)
    x = x if kind == "all" else x.filter(is_index(F.col("symbol")) == F.lit(kind == "index"))
    return x.orderBy(*order).limit(top_n).select("symbol", "strike_price", "expiry", F.round("now", 4).alias("iv_now"), F.round("before", 4).alias("iv_prev"), F.round("iv_delta", 4).alias("iv_delta"))


def top_movers(chain: DataFrame, as_of: str, side: str = "ce", top_n: int = 20, kind: str = "all") -> DataFrame:
    """The top_n live options whose price rose the most (gainer) and the least (loser) between their own last two snapshots, of those with a price at both."""
    x = now_and_before(live(chain, as_of, kind), _nz(f"{side}_ltp"), rank_by=("symbol", "strike_price", "expiry")).filter("now > 0 AND before > 0")
    x = x.withColumn("ltp_chg", F.col("now") - F.col("before"))
    ids = ["symbol", "expiry", "strike_price"]
    best = lambda how, name: x.orderBy(how("ltp_chg"), *ids).limit(top_n).withColumn("kind", F.lit(name))
    both = best(F.desc, "gainer").unionByName(best(F.asc, "loser"))
    return both.select("kind", *ids, F.col("now").alias("ltp_now"), F.col("before").alias("ltp_prev"), "ltp_chg", F.round(F.col("ltp_chg") * 100 / F.col("before"), 1).alias("ltp_pct_chg"))


def oi_change(chain: DataFrame, as_of: str, least: float = 1.0) -> DataFrame:
    """Changes of open interest at the last snapshot of live expiries, with what they mean beside the price."""
    x = latest(chain, "symbol").filter(F.col("expiry") >= F.lit(as_of).cast("date"))
    x = x.filter((F.abs("ce_oi_change") >= least) | (F.abs("pe_oi_change") >= least))
    return x.select("symbol", "expiry", "strike_price", "ce_oi_change", "pe_oi_change", buildup(F.col("ce_oi_change"), F.col("ce_ltp")).alias("ce_signal"), buildup(F.col("pe_oi_change"), F.col("pe_ltp")).alias("pe_signal"), F.round(ratio(F.col("ce_volume"), F.col("ce_oi")), 4).alias("ce_vol_oi"), F.round(ratio(F.col("pe_volume"), F.col("pe_oi")), 4).alias("pe_vol_oi"))


def oi_signals(chain: DataFrame) -> DataFrame:
    """Change of each symbol's open interest and mean price between its last two snapshots."""
    at = lambda n, f, x: f(F.when(F.col("rk") == n, F.col(x)))
    x = last_two(chain, "symbol").groupBy("symbol").agg(*((at(1, F.sum, f"{s}_oi") - at(2, F.sum, f"{s}_oi")).alias(f"{s}_oi_chg") for s in ("ce", "pe")), *(F.round(at(1, F.avg, f"{s}_ltp") - at(2, F.avg, f"{s}_ltp"), 4).alias(f"{s}_ltp_chg") for s in ("ce", "pe")), F.countDistinct("timestamp").alias("n")).filter("n >= 2").drop("n")
    return x.withColumns({f"{s}_signal": buildup(F.col(f"{s}_oi_chg"), F.col(f"{s}_ltp_chg")) for s in ("ce", "pe")})


def _windowed(chain: DataFrame, days: int) -> DataFrame:
    """Rows of the days up to each symbol's last one, and that many before it."""
    last = chain.groupBy("symbol").agg(F.to_date(F.max("timestamp")).alias("_last"))
    x = chain.withColumn("dt", F.to_date("timestamp")).join(last, "symbol")
    return x.filter(F.col("dt") >= F.date_sub("_last", days)).drop("_last")


def _near_spot(rows: DataFrame, keys: list[str], pct: float) -> DataFrame:
    """Rows whose strike lies within pct of the mean spot of their group's rows; all of a group without a spot."""
    mean = rows.groupBy(*keys).agg(F.avg("spot").alias("_mean"))
    band = F.col("strike_price").between(F.col("_mean") * (1 - pct / 100), F.col("_mean") * (1 + pct / 100))
    return rows.join(mean, keys).filter((F.col("_mean") <= 0) | band).drop("_mean")


def _daily(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(symbol, expiry, dt, strike_price, spot) with each day's means."""
    spot = F.avg(_nz("underlying_price")).alias("spot")
    return rows.groupBy("symbol", "expiry", "dt", "strike_price").agg(*(F.avg(v).alias(n) for n, v in values.items()), spot)


def _before(name: str) -> Column:
    """A strike's value of the day before."""
    return F.lag(name).over(Window.partitionBy("symbol", "expiry", "strike_price").orderBy("dt"))


def oi_history(chain: DataFrame, days: int = 5, band_pct: float = 10.0) -> DataFrame:
    """Each day's mean open interest of the strikes near spot over the last days, of rows with a price, and its change since the strike's day before."""
    priced = _windowed(chain, days).filter(_nz("ce_ltp") + _nz("pe_ltp") > 0)
    x = _daily(priced, {f"{s}_oi": _nz(f"{s}_oi") for s in ("ce", "pe")})
    x = x.withColumns({f"{s}_oi_chg": F.col(f"{s}_oi") - _before(f"{s}_oi") for s in ("ce", "pe")})
    x = _near_spot(x, ["symbol", "expiry"], band_pct)
    return x.select("symbol", "expiry", "dt", "strike_price", *(F.round(n, 4).alias(n) for n in ("ce_oi", "pe_oi", "spot", "ce_oi_chg", "pe_oi_chg")))


def iv_history(chain: DataFrame, days: int = 5, band_pct: float = 10.0) -> DataFrame:
    """Each day's mean volatilities of the strikes near spot over the last days, of rows with a call's volatility, their average and its change since the strike's day before."""
    known = _windowed(chain, days).filter(_nz("ce_iv") > 0)
    x = _daily(known, {f"{s}_iv": _nz(f"{s}_iv") for s in ("ce", "pe")}).withColumn("avg_iv", (F.col("ce_iv") + F.col("pe_iv")) / 2)
    x = _near_spot(x.withColumn("iv_chg", F.col("avg_iv") - _before("avg_iv")), ["symbol", "expiry"], band_pct)
    return x.select("symbol", "expiry", "dt", "strike_price", *(F.round(n, 4).alias(n) for n in ("ce_iv", "pe_iv", "spot", "avg_iv", "iv_chg")))


def divergence(chain: DataFrame, as_of: str, intraday: bool = False, top_n: int = 30, kind: str = "all", min_spot: float = 0.03, min_premium: float = 0.5) -> DataFrame:
    """Symbols whose premiums at the money moved against spot, in the nearest expiry that is live.

    Between the symbol's last two snapshots of live expiries or, intraday, between the first and
    the last of the table's last day. A symbol needs both, in that expiry.
    """
    live = chain.filter(F.col("expiry") >= F.lit(as_of).cast("date"))
    if kind != "all":
        live = live.filter(is_index(F.col("symbol")) == F.lit(kind == "index"))
    if intraday:
        day = chain.agg(F.max(F.to_date("timestamp")).alias("day"))
        today = chain.join(day, F.to_date("timestamp") == F.col("day"), "left_semi")
        times = today.groupBy("symbol").agg(F.max("timestamp").alias("now"), F.min("timestamp").alias("ref")).filter("now <> ref")
    else:
        times = last_two(live.select("symbol", "timestamp").distinct(), "symbol").groupBy("symbol").agg(F.max("timestamp").alias("now"), F.min("timestamp").alias("ref")).filter("now <> ref")
    front = live.join(live.groupBy("symbol").agg(F.min("expiry").alias("expiry")), ["symbol", "expiry"], "left_semi")
    x = front.join(times, "symbol").filter("timestamp = now OR timestamp = ref")
    at = lambda n, name, of: F.avg(F.when(F.col("timestamp") == F.col(n), name)).alias(f"{of}_{n}")
    money = {"ce": "ce_ltp", "pe": "pe_ltp", "ce_iv": "ce_iv", "pe_iv": "pe_iv", "net_flow": "net_flow"}
    x = x.groupBy("symbol", "now", "ref").agg(*(at(n, F.col("underlying_price"), "spot") for n in ("now", "ref")), *(at(n, F.when(F.col("distance_from_atm") == 0, F.col(c)), k) for k, c in money.items() for n in ("now", "ref")))
    x = x.filter("spot_ref > 0 AND spot_now IS NOT NULL")
    pct = lambda k: F.coalesce((_nz(f"{k}_now") - F.col(f"{k}_ref")) / F.when(F.col(f"{k}_ref") > 0, F.col(f"{k}_ref")) * 100, F.lit(0.0))
    x = x.withColumns({"s": pct("spot"), "c": pct("ce"), "p": pct("pe"), "ci": _nz("ce_iv_now") - _nz("ce_iv_ref"), "pi": _nz("pe_iv_now") - _nz("pe_iv_ref")})
    s, c, p, iv = F.col("s"), F.col("c"), F.col("p"), (F.abs("ci") + F.abs("pi")) / 2
    flat = F.abs(s) < min_spot
    cases = [(~flat & (s > min_spot) & (p > min_premium), "BULL_HEDGE", p), (~flat & (s < -min_spot) & (c > min_premium), "BEAR_SQUEEZE", c), (~flat & (s > min_spot) & (c < -min_premium), "SMART_SELL", c), (~flat & (s < -min_spot) & (p < -min_premium), "SMART_BUY", p)]
    x = x.withColumns({"signal": chosen([*((when, name) for when, name, _ in cases), (flat & (iv >= 1.0), "IV_SPIKE")]), "magnitude": F.round(chosen([(when, F.abs(s) + F.abs(v)) for when, _, v in cases], iv), 3)})
    x = x.filter("signal IS NOT NULL").orderBy(F.desc("magnitude"), "symbol").limit(top_n)
    minute = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm")
    return x.select("symbol", "signal", "magnitude", F.round(s, 3).alias("spot_pct"), F.round(c, 3).alias("ce_pct"), F.round(p, 3).alias("pe_pct"), F.round("ci", 3).alias("ce_iv_chg"), F.round("pi", 3).alias("pe_iv_chg"), F.round("spot_now", 2).alias("spot_now"), F.round(_nz("ce_now"), 2).alias("ce_ltp_now"), F.round(_nz("pe_now"), 2).alias("pe_ltp_now"), F.round(_nz("net_flow_now"), 2).alias("net_flow"), minute("now").alias("ts_now"), minute("ref").alias("ts_ref"))


def delta_screener(chain: DataFrame, as_of: str, most: float = 30.0, least: float = 5.0, kind: str = "all") -> DataFrame:
    """A row for each side of a live, priced strike of its symbol's last snapshot whose absolute delta, in hundredths, lies between least and most."""
    names = ("ltp", "iv", "oi", "volume")
    side = lambda s: F.struct(F.lit(s.upper()).alias("side"), F.abs(_nz(f"{s}_delta")).alias("delta"), *(_nz(f"{s}_{n}").alias(n) for n in names))
    rows = live(latest(chain, "symbol"), as_of, kind).filter(_nz("ce_ltp") + _nz("pe_ltp") > 0)
    x = rows.withColumn("o", F.explode(F.array(side("ce"), side("pe")))).filter(F.col("o.delta").between(least / 100, most / 100))
    lot = F.greatest(F.coalesce(F.col("lotsize"), F.lit(1)), F.lit(1))
    return x.select("symbol", "expiry", "strike_price", "o.side", F.round("o.delta", 4).alias("delta"), *(f"o.{n}" for n in names), F.round(F.col("o.ltp") * lot, 2).alias("premium_lot"), F.round(F.col("strike_price") * lot, 2).alias("notional"), _nz("underlying_price").alias("spot"))


def delta_oi(chain: DataFrame) -> DataFrame:
    """Delta times open interest times lot of each ladder, in millions, and its lean."""
    of = lambda s: F.sum(F.abs(f"{s}_delta") * F.col(f"{s}_oi") * F.col("lotsize")) / 1e6
    x = latest(chain, "symbol").groupBy("symbol", "expiry").agg(of("ce").alias("ce"), of("pe").alias("pe")).withColumn("net", F.round(F.col("ce") - F.col("pe"), 4))
    return x.select("symbol", "expiry", F.round("ce", 4).alias("ce_m"), F.round("pe", 4).alias("pe_m"), F.col("net").alias("net_m"), chosen([(F.col("net") > 0.5, "bullish"), (F.col("net") < -0.5, "bearish")], "neutral").alias("lean"))


def premium_lens(chain: DataFrame, low: float = 0.0, high: float = 999.0, min_oi: float = 0.0) -> DataFrame:
    """Prices against theoretical prices at the last snapshot, of strikes some side of which has a price and some side of which has the open interest.

    With a band, only strikes of which a side that has a ratio lies outside it.
    """
    x = latest(chain, "symbol").filter((_nz("ce_ltp") > 0) | (_nz("pe_ltp") > 0)).filter((_nz("ce_oi") >= min_oi) | (_nz("pe_oi") >= min_oi))
    for s in ("ce", "pe"):
        price, theory = _nz(f"{s}_ltp"), F.when(F.col(f"{s}_tprice") > 0, F.col(f"{s}_tprice"))
        x = x.withColumns({f"{s}_ratio": F.round(price / theory, 4), f"{s}_diff_pct": F.round((price - theory) * 100 / theory, 2)})
    if low > 0 or high < 999:
        outside = lambda s: F.coalesce(~F.col(f"{s}_ratio").between(low, high), F.lit(False))
        x = x.filter(outside("ce") | outside("pe"))
    return x.select("symbol", "expiry", "strike_price", "ce_ratio", "ce_diff_pct", "pe_ratio", "pe_diff_pct")


def metadata(chain: DataFrame) -> DataFrame:
    """Each symbol's counts of timestamps and expiries, its last time and lot size."""
    return chain.groupBy("symbol").agg(F.countDistinct("timestamp").alias("timestamps"), F.countDistinct("expiry").alias("expiries"), F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm").alias("latest"), F.max("lotsize").alias("lot_size"))


def strike_trend(chain: DataFrame, metrics: list[str]) -> DataFrame:
    """Up to three metrics of each strike over time; a name that is no number of the chain is refused."""
    numbers = {n for n, t in chain.dtypes if t in ("double", "int", "bigint")}
    if len(metrics) > 3 or not set(metrics) <= numbers:
        raise ValueError("unknown metrics")
    return chain.select("symbol", "expiry", "strike_price", "timestamp", *(_nz(m).alias(m) for m in metrics))


# --- implied volatility


def term_structure(chain: DataFrame) -> DataFrame:
    """Volatility at the money, or nearest to it, of each expiry at the last snapshot; contango if the last expiry's is above the first's."""
    at = F.min(F.struct(F.abs("distance_from_atm"), "strike_price", "ce_iv", "pe_iv")).alias("x")
    x = latest(chain, "symbol").groupBy("symbol", "expiry").agg(at).select("symbol", "expiry", ((F.col("x.ce_iv") + F.col("x.pe_iv")) / 2).alias("mid"), (F.col("x.pe_iv") - F.col("x.ce_iv")).alias("skew"))
    w = Window.partitionBy("symbol")
    shape = F.when(F.max_by("mid", "expiry").over(w) > F.min_by("mid", "expiry").over(w), "contango").otherwise("backwardation")
    return x.select("symbol", "expiry", F.round("mid", 4).alias("mid"), F.round("skew", 4).alias("skew"), shape.alias("shape"))


def iv_rank(chain: DataFrame, lookback_days: int = 90) -> DataFrame:
    """Rank and percentile of each ladder's volatility at the money at its symbol's last snapshot, among those of lookback_days before it on.

    The volatility is the mean of both sides. n counts the past ones above 0; rank and percentile
    need two, the rank also that not all are equal. The present one of a ladder is joined to its
    past, which is added up, not sorted.
    """
    mid = (_nz("ce_iv") + _nz("pe_iv")) / 2
    money = chain.filter("distance_from_atm = 0")
    first = lambda x: F.min(F.struct("strike_price", x.alias("x")))["x"]
    now = latest(chain, "symbol").filter("distance_from_atm = 0").groupBy("symbol", "expiry").agg(F.max("timestamp").alias("at"), *(first(_nz(n)).alias(n) for n in ("ce_iv", "pe_iv", "m_volatility")))
    now = now.select("symbol", "expiry", "at", mid.alias("now"), F.col("m_volatility").alias("rv"))
    past = money.select("symbol", "expiry", "timestamp", mid.alias("iv")).filter("iv > 0").join(now, ["symbol", "expiry"])
    past = past.filter(F.col("timestamp") >= F.col("at") - F.make_dt_interval(F.lit(lookback_days)))
    lo, hi = F.min("iv"), F.max("iv")
    seen = past.groupBy("symbol", "expiry").agg(F.count("*").alias("n"), lo.alias("lo"), hi.alias("hi"), F.avg((F.col("iv") < F.col("now")).cast("double")).alias("under"))
    x = now.join(seen, ["symbol", "expiry"], "left")
    enough = F.col("n") >= 2
    rank = F.when(enough & (F.col("hi") > F.col("lo")), (F.col("now") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100)
    return x.select("symbol", "expiry", F.coalesce("n", F.lit(0)).alias("n"), F.round("now", 2).alias("iv_now"), F.round(rank, 1).alias("iv_rank"), F.round(F.when(enough, F.col("under") * 100), 1).alias("iv_percentile"), F.round(F.col("rv") - F.col("now"), 2).alias("rv_iv"))


def _at_quarter_delta(side: str) -> Column:
    """The volatility of a ladder's strike whose delta is nearest to a quarter, the lowest of several, among those with a volatility and a delta of the side's sign."""
    sign = 1 if side == "ce" else -1
    usable = (sign * F.col(f"{side}_delta") > 0) & (F.col(f"{side}_iv") > 0)
    return F.min(F.when(usable, F.struct(F.round(F.abs(F.abs(f"{side}_delta") - 0.25), 9), "strike_price", f"{side}_iv")))[f"{side}_iv"]


def skew(chain: DataFrame) -> DataFrame:
    """25-delta risk reversal, put less call, and slopes of volatility over 100 of strike on both wings, at the last snapshot of each ladder.

    A wing lies beyond the strike at the money, or spot if no strike is, and needs three strikes
    with a volatility over 1. asymmetry is how much steeper the put wing is.
    """
    rows = latest(chain, "symbol")
    money = F.min(F.when(F.col("distance_from_atm") == 0, F.col("strike_price")))
    middle = rows.groupBy("symbol", "expiry").agg(F.coalesce(money, F.max("underlying_price")).alias("middle"))
    beyond = {"ce": F.col("strike_price") > F.col("middle"), "pe": F.col("strike_price") < F.col("middle")}

    def slope(s: str) -> Column:
        wing = beyond[s] & (F.col(f"{s}_iv") > 1)
        return F.when(F.count(F.when(wing, 1)) >= 3, F.regr_slope(F.when(wing, F.col(f"{s}_iv")), F.when(wing, F.col("strike_price"))) * 100)

    x = rows.join(middle, ["symbol", "expiry"]).groupBy("symbol", "expiry").agg((_at_quarter_delta("pe") - _at_quarter_delta("ce")).alias("rr"), slope("ce").alias("c"), slope("pe").alias("p"))
    # sums of doubles depend on their order: what lies on the edge of two roundings is settled first
    near = lambda v: F.round(F.round(v, 9), 4)
    return x.select("symbol", "expiry", F.round("rr", 2).alias("risk_reversal"), near(F.col("c")).alias("call_slope"), near(F.col("p")).alias("put_slope"), near(F.abs("p") - F.abs("c")).alias("asymmetry"))


def _weighted_sides() -> list[Column]:
    """Volatility weighted by open interest of each side and of both, and the open interest."""
    side = lambda s: F.round(ratio(F.sum(_nz(f"{s}_iv") * _nz(f"{s}_oi")), F.when(F.sum(_nz(f"{s}_oi")) > 0, F.sum(_nz(f"{s}_oi")))), 4)
    return [side("ce").alias("ce_iv"), side("pe").alias("pe_iv"), F.round(weighted_iv(), 4).alias("iv"), F.sum(_nz("ce_oi") + _nz("pe_oi")).alias("oi")]


def oi_weighted_iv(chain: DataFrame) -> DataFrame:
    """Volatility weighted by open interest for each expiry at the last snapshot, of rows with a call's volatility."""
    return latest(chain, "symbol").filter("ce_iv > 0").groupBy("symbol", "expiry").agg(*_weighted_sides())


def iv_intraday(chain: DataFrame, as_of: str, kind: str = "all") -> DataFrame:
    """Weighted volatility of live expiries at a symbol's first and last time of the table's last day, of rows with a call's volatility.

    A symbol without rows on that day, or without such rows at one of the two times, is left out.
    """
    day = chain.agg(F.to_date(F.max("timestamp")).alias("day"))
    today = chain.withColumn("day", F.to_date("timestamp")).join(day, "day", "left_semi")
    bounds = today.groupBy("symbol").agg(F.min("timestamp").alias("open"), F.max("timestamp").alias("now"))
    rows = live(today, as_of, kind).filter("ce_iv > 0").join(bounds, "symbol").filter("timestamp = open OR timestamp = now")
    x = rows.groupBy("symbol", "timestamp", "open", "now").agg(weighted_iv().alias("iv")).groupBy("symbol").agg(*(F.max(F.when(F.col("timestamp") == F.col(n), F.col("iv"))).alias(n) for n in ("open", "now")), F.max((F.col("timestamp") == F.col("open")).cast("int")).alias("a"), F.max((F.col("timestamp") == F.col("now")).cast("int")).alias("b")).filter("a = 1 AND b = 1")
    change = F.col("now") - F.col("open")
    return x.select("symbol", F.round("open", 2).alias("iv_open"), F.round("now", 2).alias("iv_now"), F.round(change, 2).alias("iv_chg"), F.round(change / F.when(F.col("open") > 0, F.col("open")) * 100, 2).alias("iv_chg_pct"))


# --- flow


def eod_rows(chain: DataFrame, as_of: str, until: str = "15:30", first: str | None = None, last: str | None = None) -> DataFrame:
    """Each day's last rows up to a time of day of every live strike of every expiry, from a first to a last day, with date."""
    early = live(chain, as_of).filter(F.date_format("timestamp", "HH:mm") <= until).withColumn("date", F.to_date("timestamp"))
    if first is not None:
        early = early.filter(F.col("timestamp") >= F.lit(first).cast("timestamp"))
    if last is not None:
        early = early.filter(F.col("timestamp") < F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return latest(early, "symbol", "expiry", "strike_price", "date")


def intraday_oi(chain: DataFrame, band_pct: float = 10.0) -> DataFrame:
    """Open interest and its change at each time of a ladder's last day, of strikes with a price, within band_pct of the day's mean spot."""
    last = chain.groupBy("symbol").agg(F.to_date(F.max("timestamp")).alias("day"))
    x = chain.withColumn("day", F.to_date("timestamp")).join(last, ["symbol", "day"], "left_semi").filter(_nz("ce_ltp") + _nz("pe_ltp") > 0)
    mean = x.groupBy("symbol", "expiry").agg(F.avg(_nz("underlying_price")).alias("mean"))
    x = x.join(mean, ["symbol", "expiry"]).filter((F.col("mean") <= 0) | F.col("strike_price").between(F.col("mean") * (1 - band_pct / 100), F.col("mean") * (1 + band_pct / 100)))
    return x.select("symbol", "expiry", F.date_format("timestamp", "HH:mm").alias("time"), "strike_price", *(_nz(n).alias(n) for n in ("ce_oi", "pe_oi", "ce_oi_change", "pe_oi_change")), _nz("underlying_price").alias("spot"))


def risk_reversals(chain: DataFrame) -> DataFrame:
    """The 25-delta risk reversal, put less call, of each ladder over time."""
    return chain.groupBy(*KEYS).agg(F.round(_at_quarter_delta("pe") - _at_quarter_delta("ce"), 4).alias("risk_reversal"))


def weighted_iv_overall(chain: DataFrame) -> DataFrame:
    """Volatility weighted by open interest over all expiries at a symbol's last snapshot, of rows with a call's volatility."""
    return latest(chain, "symbol").filter("ce_iv > 0").groupBy("symbol").agg(*_weighted_sides())


def strike_gamma(chain: DataFrame) -> DataFrame:
    """Gamma of both sides and net, in millions, at each strike of the last snapshot."""
    side = lambda s: F.col(f"{s}_gamma") * F.col(f"{s}_oi") * F.col("lotsize") / 1e6
    return latest(chain, "symbol").select("symbol", "expiry", "strike_price", F.round(side("ce"), 6).alias("ce_gex"), F.round(-side("pe"), 6).alias("pe_gex"), F.round(F.col("net_gexv") / 1e6, 6).alias("net_gex"))


def nearest_before(chain: DataFrame, tolerance_pct: float = 2.0) -> DataFrame:
    """Each ladder's open-interest centre with the one nearest to it among the centres of the symbol's other expiries at that time, within tolerance_pct of spot."""
    oi = F.col("ce_oi") + F.col("pe_oi")
    x = chain.groupBy("symbol", "timestamp", "expiry").agg(F.round(ratio(F.sum(F.col("strike_price") * oi), F.sum(oi)), 4).alias("center"), F.max("underlying_price").alias("spot"))
    y = x.select("symbol", "timestamp", F.col("expiry").alias("other"), F.col("center").alias("other_center"))
    near = x.join(y, ["symbol", "timestamp"]).filter((F.col("expiry") != F.col("other")) & (F.abs(F.col("center") - F.col("other_center")) < F.col("spot") * (tolerance_pct / 100)))
    best = near.groupBy("symbol", "timestamp", "expiry").agg(F.min(F.struct(F.abs(F.col("center") - F.col("other_center")), "other_center"))["other_center"].alias("match"))
    return x.join(best, ["symbol", "timestamp", "expiry"], "left").select("symbol", "timestamp", "expiry", "center", "match")


def strike_snapshot(chain: DataFrame) -> DataFrame:
    """Each strike at its symbol's last snapshot, with what its prices are of the theoretical ones."""
    price = lambda s: F.round(ratio(F.col(f"{s}_ltp"), F.col(f"{s}_tprice")), 4).alias(f"{s}_ratio")
    return latest(chain, "symbol").select("symbol", "expiry", "strike_price", "ce_ltp", "pe_ltp", "ce_oi", "pe_oi", price("ce"), price("pe"))


def best_by_delta(chain: DataFrame, target: float = 0.3) -> DataFrame:
    """Of each symbol, expiry and side at the last snapshot, the strike whose absolute delta is nearest to target, the lowest of several."""
    side = lambda s: F.struct(F.lit(s.upper()).alias("side"), F.abs(f"{s}_delta").alias("delta"), F.col(f"{s}_ltp").alias("ltp"))
    x = latest(chain, "symbol").select("symbol", "expiry", "strike_price", F.explode(F.array(side("ce"), side("pe"))).alias("o")).select("symbol", "expiry", "strike_price", "o.*")
    near = F.min(F.struct(F.round(F.abs(F.col("delta") - target), 9).alias("d"), "strike_price", "delta", "ltp")).alias("n")
    return x.groupBy("symbol", "expiry", "side").agg(near).select("symbol", "expiry", "side", "n.strike_price", F.round("n.delta", 4).alias("delta"), "n.ltp")
