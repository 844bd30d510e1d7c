"""Scalar measures as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BUCKETS, INDICES, NEGATIVE, POSITIVE, REGIMES, Params


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(a, b)


def chosen(cases: list[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first case that holds."""
    first, *rest = cases
    return reduce(lambda x, y: x.when(*y), rest, F.when(*first)).otherwise(otherwise)


def is_index(symbol: Column) -> Column:
    return symbol.isin(*INDICES)


def expected_move(ref: Column, iv: Column, dte: Column) -> Column:
    """ref * iv% * sqrt(dte / 365); a twentieth of ref where iv or dte is missing or not positive."""
    return F.when((iv > 0) & (dte > 0), ref * iv / 100 * F.sqrt(dte / 365)).otherwise(ref * 0.05)


def basis(fut: Column, spot: Column, dte: Column) -> Column:
    """struct(basis, basis_pct, basis_annualized); nulls if a price is missing, spot is not positive or both are equal."""
    gap, pct = fut - spot, (fut - spot) / spot * 100
    known = (spot > 0) & (F.abs(gap) >= 1e-9)
    year = pct * 365 / dte
    return F.struct(F.when(known, F.round(gap, 4)).alias("basis"), F.when(known, F.round(pct, 4)).alias("basis_pct"), F.when(known & (dte > 0) & (F.abs(year) <= 60), F.round(year, 3)).alias("basis_annualized"))


def in_deadzone(pct: Column, width: float = 0.1) -> Column:
    return F.coalesce(F.abs(pct) < width, F.lit(True))


def regime_order(regime: Column) -> Column:
    return chosen([(regime == name, order) for name, _, order in REGIMES], 99)


def regime_color(regime: Column) -> Column:
    return chosen([(regime == name, color) for name, color, _ in REGIMES], "#3d5270")


def confidence(total_oi: Column, strikes: Column, width: Column) -> Column:
    """A transition width of null or 0 counts as 1."""
    w = F.when(width != 0, width).otherwise(1.0)
    return chosen([((strikes >= 8) & (total_oi > 0) & (w < 0.5), "high"), (strikes >= 4, "medium")], "low")


def buildup(oi: Column, price: Column) -> Column:
    """What a change of open interest with a change of price means."""
    return chosen([((oi > 0) & (price > 0), "Long Build-Up"), ((oi > 0) & (price < 0), "Short Build-Up"), ((oi < 0) & (price > 0), "Short Covering"), ((oi < 0) & (price < 0), "Long Unwinding")], "Neutral")


def delta_bucket(delta: Column, at: tuple = (0.5, 0.3, 0.15, 0.05)) -> Column:
    """Bucket of an absolute delta."""
    return chosen([(delta >= x, name) for x, name in zip(at, BUCKETS)], BUCKETS[-1])


def dte_regime(dte: Column) -> Column:
    return chosen([(dte <= 1, "expiry"), (dte <= 7, "short"), (dte <= 21, "medium")], "long")


def flow_type(ce: Column, pe: Column, spot: Column, ce_bought: Column, pe_bought: Column) -> Column:
    """Dominant flow of a bucket from changes of open interest and spot and from quantities bought."""
    tilt = buy_imbalance(ce_bought, pe_bought)
    return chosen([((ce > 0) & (pe > 0) & (tilt > 0.2), "Speculative"), ((pe > 0) & (spot > 0), "Hedging"), ((ce > 0) & (pe < 0) & (tilt > 0.1), "Squeeze Setup"), ((pe > 0) & (F.abs(pe) > F.abs(ce) * 3), "Panic Flow"), ((F.abs(tilt) < 0.05) & (F.abs(ce + pe) < 100), "Dealer Positioning")], "Mixed")


def buy_imbalance(ce_bought: Column, pe_bought: Column) -> Column:
    return F.coalesce(ratio(ce_bought - pe_bought, F.when(ce_bought + pe_bought > 0, ce_bought + pe_bought)), F.lit(0.0))


def vix_level(vix: Column) -> Column:
    return chosen([(vix > 30, "extreme"), (vix > 20, "elevated"), (vix > 12, "normal")], "low")


def dealer_divergence(gap: Column) -> Column:
    """The name of a gap between centres, in expected moves."""
    return chosen([(gap.isNull(), None), (F.abs(gap) < 0.5, "aligned"), (F.abs(gap) < 1.5, "diverging")], "strongly_diverging")


def hold_probability(width: Column, concentration: Column, regime: Column) -> Column:
    """Chance in percent that a defended level holds, from 5 to 95: a base by transition width, tilted by concentration and regime."""
    base = chosen([(width <= 0.15, 31), (width <= 0.24, 46)], 58)
    tilt = chosen([(concentration > 0.37, 4), (concentration <= 0.27, -4)], 0) + chosen([(regime.isin(*POSITIVE), 3), (regime.isin(*NEGATIVE), -4)], 0)
    return F.when(width.isNotNull(), F.greatest(F.lit(5), F.least(F.lit(95), base + tilt)))


def monthly_expiry(day: Column) -> Column:
    """Last Thursday of day's month, last Tuesday from August 2025 on; of the next month once it has passed."""

    def last(x):
        end = F.last_day(x)
        target = F.when(end >= F.lit("2025-08-01").cast("date"), 3).otherwise(5)  # Sunday is 1
        return F.date_sub(end, F.pmod(F.dayofweek(end) - target, F.lit(7)).cast("int"))

    own = last(day)
    return F.when(own >= day, own).otherwise(last(F.add_months(day, 1)))


def signals(now: dict[str, Column], before: dict[str, Column], p: Params = Params()) -> Column:
    """The signals of a row against the one before, in fixed order, with commas; empty without a row before."""
    pos, neg = lambda x: x["gex_regime"].isin(*POSITIVE), lambda x: x["gex_regime"].isin(*NEGATIVE)
    iv, drift = F.coalesce(now["iv_change"], F.lit(0.0)), now["expected_move"] * p.drift_frac
    near = (F.abs(now["flip_norm_distance"]) < p.drift_max_distance) & (drift > 0)
    tw, tw0 = now["transition_width_norm"], before["transition_width_norm"]
    cases = [
        ("regime_flip_to_neg", pos(before) & neg(now)), ("regime_flip_to_pos", neg(before) & pos(now)),
        ("flip_drift_down", near & (now["flip_velocity"] <= -drift)), ("flip_drift_up", near & (now["flip_velocity"] >= drift)),
        ("pin_strengthening", (tw0 > 0) & (tw < tw0 * p.pin_narrow_frac) & pos(now)),
        ("instability_widening", now["neg_gamma_fraction"] - before["neg_gamma_fraction"] > p.instability_delta),
        ("crash_risk", neg(now) & (iv > 0) & (now["pe_vanna"] < 0)), ("bull_trend_reinforce", pos(now) & (now["ce_vanna"] > 0) & (iv > 0)),
        ("bear_trend_reinforce", neg(now) & (iv < 0) & (now["pe_vanna"] < 0)),
    ]
    fired = F.concat_ws(",", *(F.when(x, F.lit(name)) for name, x in cases))
    return F.when(before["date"].isNotNull(), fired).otherwise("")


def strength(now: dict[str, Column], before: dict[str, Column]) -> dict[str, Column]:
    """Six axes of -1, 0 or 1 against the row before."""
    gap = lambda n: now[n] - before[n]
    sign = lambda x: F.coalesce(F.when(x > 1e-9, 1).when(x < -1e-9, -1), F.lit(0))
    iv = F.coalesce(now["iv_change"], gap("atm_iv_smoothed"))
    distance = F.abs(now["flip_norm_distance"]) - F.abs(before["flip_norm_distance"])
    axes = {"lopsided": sign(gap("net_gex_norm")), "neg_gamma": -sign(gap("neg_gamma_fraction")), "iv": -sign(iv), "flip": sign(distance), "regime": F.coalesce(F.when(now["gex_regime"] == before["gex_regime"], 1).when(now["gex_regime"] != before["gex_regime"], -1), F.lit(0)), "trans_w": -sign(gap("transition_width_norm"))}
    return {k: F.when(before["date"].isNotNull(), x).otherwise(0) for k, x in axes.items()}
