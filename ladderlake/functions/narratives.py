"""Measures put into words: where gamma sits, how it is spread and how it changes; bands, sessions and changes.

The sentences, names and bounds in this module are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import chosen, ratio

#: How a metric's change is told; others are told as a difference.
CHANGE_KIND = {"fut_price": "pct", "spot": "pct", "expected_move": "pct", "atm_iv_smoothed": "pct", "atm_iv": "pct", "basis_annualized": "pct", "gex_regime": "state", "confidence": "state"}
NONE = "—"


def _some(x: Column, text: Column | str) -> Column:
    """text where x holds, else nothing."""
    return F.when(x, text).otherwise("")


def _grouped(x: Column, digits: int) -> Column:
    """A number with commas after three digits, then after every two: 12,34,567.8; null of null."""
    whole, rest = F.abs(F.round(x, digits)), F.format_string(f"%.{digits}f", F.abs(F.round(x, digits)))
    head = F.floor(whole / 1000).cast("string")
    head = F.when(whole >= 1000, F.concat(F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","))).otherwise("")
    tail = F.when(whole >= 1000, F.regexp_extract(rest, r"(\d{3}(\.\d+)?)$", 1)).otherwise(rest)
    return F.when(x.isNotNull(), F.concat(_some(F.round(x, digits) < 0, "-"), head, tail))


def center_distance(center: Column, fut: Column, move: Column) -> Column:
    """From the future to the gamma centre, in expected moves."""
    return ratio(center - fut, move)


def positioning(center: Column, fut: Column, move: Column, label: Column, oi_center: Column) -> Column:
    """Where gamma is defended, and whether open interest agrees; a dash where the distance is not known."""
    d = center_distance(center, fut, move)
    where = F.when(F.abs(d) <= 0.25, "Defending at-the-money (COM ≈ price)").otherwise(F.concat(F.lit("Support stacked "), F.when(d > 0, "above (COM +").otherwise("below (COM −"), F.format_string("%.2f", F.abs(d)), F.lit(" EM)")))
    tag = chosen([(label == "aligned", "OI-confirmed"), (label == "diverging", "OI-diverging")], "OI strongly diverging")
    agrees = F.concat(F.lit(" · γ-COM vs OI-COM "), _grouped(oi_center, 0), F.lit(": "), tag)
    return F.when(d.isNull(), NONE).otherwise(F.concat(where, _some(label.isNotNull() & oi_center.isNotNull(), agrees)))


def distribution(concentration: Column, lopsided: Column, width: Column, peak: Column) -> Column:
    """How gamma is spread over strikes and which side it leans to."""
    spread = chosen([(concentration.isNull(), NONE), (concentration > 0.37, "Concentrated"), (concentration > 0.27, "Moderate")], "Diffuse")
    lean = chosen([(lopsided > 0.29, "call-heavy"), (lopsided < -0.29, "put-heavy")], "balanced")
    pin = F.concat(F.lit(" · single-strike pin at "), _grouped(peak, 0))
    return F.concat(spread, F.lit(", "), lean, _some((width == 1) & (concentration > 0.37) & peak.isNotNull(), pin))


def change(migration: Column, move: Column, days_in_regime: Column, basis_chg: Column) -> Column:
    """How far the centre has moved, for how long the regime has held, and what the basis does."""
    a = ratio(F.abs(migration), move)
    pace = chosen([(a < 0.25, "Stable"), (a <= 0.75, "Drifting"), (a > 0.75, "Repositioning"), (migration == 0, "Stable")], NONE)
    way = _some(a >= 0.25, F.when(migration > 0, " up").otherwise(" down"))
    held = _some(days_in_regime.isNotNull(), F.concat(F.lit(" ("), days_in_regime.cast("string"), F.lit("d in regime)")))
    basis = _some(F.abs(basis_chg) >= 16.3, F.when(basis_chg > 0, " · basis widening").otherwise(" · basis compressing"))
    return F.concat(pace, way, held, basis)


def hold_bucket(probability: Column) -> Column:
    return chosen([(probability.isNull(), None), (probability < 40, "Low"), (probability <= 55, "Moderate")], "High")


def turnover_band(turnover: Column) -> Column:
    return chosen([(turnover.isNull(), None), (turnover < 0.05, "stale"), (turnover > 1.0, "thin"), (turnover > 0.5, "high")], "healthy")


def migration_band(effectiveness: Column) -> Column:
    """Spot's move against that of the centre."""
    return chosen([(effectiveness.isNull(), None), (effectiveness >= 2.5, "outrunning"), (effectiveness >= 1.6, "ahead"), (effectiveness <= 0.4, "anticipatory")], "orderly")


def spread_class(spread: Column, price: Column, warn: float = 5.0, bad: float = 15.0) -> Column:
    """good, warn or bad by the spread in percent of the price; null without a price or a spread."""
    pct = F.when(price > 0, spread / price * 100)
    return chosen([(pct.isNull(), None), (pct >= bad, "bad"), (pct >= warn, "warn")], "good")


def return_on_margin(premium: Column, margin: Column) -> Column:
    """Premium in percent of the margin, null without a margin."""
    return F.when(margin > 0, F.round(premium / margin * 100, 2))


def session(time: Column) -> Column:
    """The market's session at a local time."""
    minute = F.hour(time) * 60 + F.minute(time)
    return chosen([(minute.isNull(), None), (minute.between(540, 554), "PRE-OPEN"), (minute.between(555, 929), "OPEN"), (minute.between(930, 959), "POST-CLOSE")], "CLOSED")


def dte_band(days: Column) -> Column:
    return chosen([(days.isNull(), None), (days <= 7, "near"), (days <= 30, "mid")], "far")


def change_text(metric: str, first: Column, last: Column) -> Column:
    """The change of a metric from first to last: percent, difference or states; a dash where it is not known."""
    kind = CHANGE_KIND.get(metric, "delta")
    if kind == "state":
        a, b = (F.coalesce(F.regexp_replace(x.cast("string"), "^([^_]*)_", "$1 "), F.lit(NONE)) for x in (first, last))
        return F.when(a == b, b).otherwise(F.concat(a, F.lit(" → "), b))
    moved = ratio(last - first, F.abs(first)) * 100 if kind == "pct" else last - first
    digits, unit = (1, "%") if kind == "pct" else (3, "")
    return F.coalesce(F.concat(_some(moved > 0, "+"), _grouped(moved, digits), F.lit(unit)), F.lit(NONE))


def chunks(first: Column, last: Column, days: int = 365) -> Column:
    """Array of struct(first, last): the range of dates in runs of at most so many days; empty if it ends before it begins."""
    starts = F.sequence(first, F.greatest(first, last), F.expr(f"INTERVAL {int(days)} DAYS"))
    runs = F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(F.date_add(s, days - 1), last).alias("last")))
    return F.when(first <= last, runs).otherwise(F.array().cast("array<struct<first:date,last:date>>"))
