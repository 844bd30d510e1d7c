"""Parameters of the engine, and values that are fixed by definition."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Thresholds that operators share; each is an argument of the plans that use them. Fixed values by default."""

    dte_exclude: int = 3
    iv_smooth_span: int = 5
    strike_buffer: float = 1.0
    max_range_pct: float = 15.0
    range_change_cap: float = 0.25
    spread_max_pct: float = 10.0
    drift_frac: float = 0.25
    drift_max_distance: float = 1.0
    pin_narrow_frac: float = 0.90
    instability_delta: float = 0.05
    shelf_frac: float = 0.5
    oi_shelf_frac: float = 0.40
    max_skip: int = 1
    grid_window: int = 6
    index_step: float = 100.0
    index_step_fallback: float = 50.0
    neutral_band: float = 0.05


DEFAULTS = Params()

#: Symbols of indices.
INDICES = ("NIFTY", "BANKNIFTY", "FINNIFTY", "MIDCPNIFTY", "NIFTYNXT50", "SENSEX", "NIFTYIT")
#: Buckets of absolute delta, from deep in the money outwards.
BUCKETS = ("DEEP_ITM", "ATM", "NEAR_OTM", "FAR_OTM", "DEEP_OTM")
#: Regimes with colour and order, from stabilising to destabilising.
REGIMES = (("all_positive", "#0c8f4d", 0), ("positive", "#10b981", 1), ("mixed", "#9ca3af", 2), ("negative", "#f59e0b", 3), ("all_negative", "#dc2626", 4))
POSITIVE, NEGATIVE = ("positive", "all_positive"), ("negative", "all_negative")
#: How urgent a signal is, the most urgent first.
SEVERITY = {"crash_risk": 0, "regime_flip_to_neg": 1, "regime_flip_to_pos": 1, "bull_trend_reinforce": 2, "bear_trend_reinforce": 2, "pin_strengthening": 3, "instability_widening": 3, "flip_drift_up": 4, "flip_drift_down": 4}
#: What each signal says.
SIGNAL_WORDS = {
    "crash_risk": "negative gamma while volatility rises and the puts' vanna is negative",
    "regime_flip_to_neg": "gamma has turned negative since the day before",
    "regime_flip_to_pos": "gamma has turned positive since the day before",
    "bull_trend_reinforce": "positive gamma while volatility rises and the calls' vanna is positive",
    "bear_trend_reinforce": "negative gamma while volatility falls and the puts' vanna is negative",
    "pin_strengthening": "positive gamma whose transition narrows",
    "instability_widening": "the share of strikes with negative gamma grows",
    "flip_drift_up": "a flip near the price moves up by much of an expected move",
    "flip_drift_down": "a flip near the price moves down by much of an expected move",
}
#: The key of one ladder of strikes.
SNAPSHOT = ("symbol", "expiry", "timestamp")
