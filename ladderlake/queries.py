"""Queries over the chain by name, each with SQL that another engine answers alike where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oracles
from .functions import narratives as words
from .functions.expressions import hold_probability, monthly_expiry, regime_order, vix_level
from .operators import clusters, flows, gamma_page, grouped, ladder, layers, screens, walls
from .plans import eod
from .sources import ocdata
from .sources.ocdata import chain, duckdb_chain

AS_OF = "2024-01-17"
#: A day after the first expiry of the chain, so that lapsed rows are there to be left out.
LATER = "2024-01-26"
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
_LATEST = ", last AS (SELECT o.* FROM ocdata o JOIN (SELECT symbol, max(timestamp) AS ts FROM ocdata GROUP BY 1) m ON o.symbol = m.symbol AND o.timestamp = m.ts)"
_TWO = ", r AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rk FROM ocdata)"


def _window(days: int) -> str:
    """Rows of the days up to each symbol's last one, and that many before it, as `recent`."""
    return f""", recent AS (SELECT o.*, CAST(timestamp AS DATE) AS dt FROM ocdata o JOIN (SELECT symbol, CAST(max(timestamp) AS DATE) AS latest FROM ocdata GROUP BY 1) m ON o.symbol = m.symbol WHERE CAST(timestamp AS DATE) >= latest - {days})"""


#: Columns that are dates, given as text; other queries have expiry alone, or none.
_DATES = {"overview": (), "oi_signals_all": (), "divergence": (), "divergence_intraday": (), "oi_weighted_iv_overall": (), "regime_ramp": (), "eod_rows": ("expiry", "date"), "metadata": (), "heatmap_pivot": (), "iv_intraday_trend": (), "oi_history": ("expiry", "dt"), "iv_history": ("expiry", "dt"), "monthly_expiries": ("expiry", "date"), "expiry_rule": ("expiry", "day")}
_DATES |= {n: ("date", "expiry") for n in ("stage1", "stage2", "exposure_screener_all", "exposure_screener_changed", "exposure_screener_dropped")} | {n: ("date",) for n in ("eod_dates", "signals", "strength", "defense_hold", "indicator_counts", "narratives")} | {"change_summary": ()}


_NULLABLE = ("days_since_release", "hold", "hold_probability", "gamma_shelf_width", "ce_hold", "first_seen")


def query(name: str, sql: str | None = None):
    """Registers f(chain) -> DataFrame, and its SQL as what follows the chain's clauses; dates are given as text."""

    def add(f):
        def run(spark, sf_dir):
            df = f(chain(spark, sf_dir))
            # dates are text, and whole numbers that may be null are doubles, so that all engines hand them over alike
            return df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"} | {n: F.col(n).cast("double") for n in df.columns if n in _NULLABLE})

        QUERIES[name] = run
        if sql is not None:
            texts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in _DATES.get(name, ("expiry",)))
            ORACLES[name] = f"SELECT * {f'REPLACE ({texts})' if texts else ''} FROM ({duckdb_chain()}{sql})"
        return f

    return add


query("overview", _LATEST + """
SELECT symbol, timestamp, round(avg(underlying_price), 4) AS spot, round(avg(atm_strike), 4) AS atm_strike, sum(ce_oi) AS total_ce_oi, sum(pe_oi) AS
    total_pe_oi, sum(ce_volume) AS total_ce_vol, sum(pe_volume) AS total_pe_vol,
  round(sum(net_gexv), 2) AS net_gex, round(avg(ce_iv), 4) AS avg_ce_iv, round(avg(pe_iv), 4) AS avg_pe_iv, max(lotsize) AS lot_size, round(sum(ce_iv
      * ce_oi + pe_iv * pe_oi) / nullif(sum(ce_oi + pe_oi), 0), 4) AS oi_wtd_iv,
  round(avg(m_volatility) - avg(ce_iv), 4) AS rv_iv_spread, round(avg(CASE WHEN distance_from_atm = 0 THEN expected_move_straddle END), 4) AS
      exp_move_straddle, round(avg(CASE WHEN distance_from_atm = 0 THEN expected_move_theoretical END), 4) AS exp_move_theoretical,
  round(sum(pe_oi) / nullif(sum(ce_oi), 0), 3) AS pcr
FROM last GROUP BY 1, 2""")(screens.overview)
query("scan_latest_snapshot", _LATEST + " SELECT symbol, expiry, strike_price, ce_oi, pe_oi FROM last")(lambda c: ocdata.latest(c, "symbol").select("symbol", "expiry", "strike_price", "ce_oi", "pe_oi"))
query("filter_liquidity", """ SELECT symbol, expiry, timestamp, count(*) AS n FROM ocdata
WHERE (ce_oi > 0 AND ce_volume > 0 AND CASE WHEN ce_ltp > 0 THEN ce_bid_ask_spread / ce_ltp * 100 ELSE 999 END <= 0.2) OR (pe_oi > 0 AND pe_volume > 0
    AND CASE WHEN pe_ltp > 0 THEN pe_bid_ask_spread / pe_ltp * 100 ELSE 999 END <= 0.2) GROUP BY 1, 2, 3""")(lambda c: screens.liquid(c, 0.2).groupBy(*ladder.KEYS).agg(F.count("*").alias("n")))
query("filter_price_band", """, m AS (SELECT symbol, avg(underlying_price) AS s FROM ocdata GROUP BY 1)
SELECT o.symbol, expiry, timestamp, strike_price FROM ocdata o JOIN m ON o.symbol = m.symbol WHERE abs(strike_price - s) <= s * 0.012""")(lambda c: screens.price_band(c, 1.2).select("symbol", "expiry", "timestamp", "strike_price"))
for _n, _w, _q in (("day", "2024-01-16", "CAST(timestamp AS DATE) = DATE '2024-01-16'"), ("minute", "2024-01-16 15:29", "strftime(timestamp, '%Y-%m-%d %H:%M') = '2024-01-16 15:29'"), ("exact", "2024-01-16 15:29:00", "timestamp = TIMESTAMP '2024-01-16 15:29:00'")):
    query(f"filter_ts_{_n}", f" SELECT symbol, expiry, timestamp, strike_price FROM ocdata WHERE {_q}")(lambda c, w=_w: c.filter(ocdata.at_time(w)).select("symbol", "expiry", "timestamp", "strike_price"))
query("delta_screener", _LATEST + f""", s AS (
  SELECT *, 'CE' AS side, abs(ce_delta) AS delta, ce_ltp AS ltp, ce_iv AS iv, ce_oi AS oi, ce_volume AS volume FROM last UNION ALL
  SELECT *, 'PE', abs(pe_delta), pe_ltp, pe_iv, pe_oi, pe_volume FROM last
)
SELECT symbol, expiry, strike_price, side, round(delta, 4) AS delta, ltp, iv, oi, volume, round(ltp * lotsize, 2) AS premium_lot, round(strike_price * lotsize, 2) AS notional, underlying_price AS spot
FROM s WHERE expiry >= DATE '{LATER}' AND ce_ltp + pe_ltp > 0 AND delta >= 0.05 AND delta <= 0.3""")(lambda c: screens.delta_screener(c, LATER))
query("volume_shockers", f""", a AS (SELECT *, ce_volume + pe_volume AS v, dense_rank() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rk FROM ocdata WHERE expiry >= DATE '{AS_OF}' AND ce_ltp + pe_ltp > 0),
top AS (SELECT l.symbol, l.strike_price, l.expiry, l.v AS vol_now, p.v AS vol_prev, l.v - p.v AS vol_delta, round((l.v - p.v) * 100 / nullif(p.v, 0),
    1) AS vol_pct_chg FROM (SELECT * FROM a WHERE rk = 1) l JOIN (SELECT * FROM a WHERE rk = 2) p USING (symbol, strike_price, expiry)
  WHERE l.v > p.v AND l.v > 0 ORDER BY vol_delta DESC, 1, 3, 2 LIMIT 90)
SELECT * FROM top WHERE symbol NOT IN ('NIFTY', 'BANKNIFTY') ORDER BY vol_delta DESC, symbol, expiry, strike_price LIMIT 30""")(lambda c: screens.volume_shockers(c, AS_OF, 30, "stock"))
query("iv_shockers", f""", a AS (SELECT *, (ce_iv + pe_iv) / 2 AS v, dense_rank() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rk FROM ocdata WHERE expiry >= DATE '{LATER}' AND ce_iv + pe_iv > 0),
top AS (SELECT l.symbol, l.strike_price, l.expiry, l.v AS now, p.v AS before, l.v - p.v AS d FROM (SELECT * FROM a WHERE rk = 1) l JOIN (SELECT * FROM a WHERE rk = 2) p USING (symbol, strike_price, expiry)
  ORDER BY round(abs(d), 9) DESC, 1, 3, 2 LIMIT 90)
SELECT symbol, strike_price, expiry, round(now, 4) AS iv_now, round(before, 4) AS iv_prev, round(d, 4) + 0 AS iv_delta FROM top WHERE symbol NOT IN ('NIFTY', 'BANKNIFTY')
ORDER BY round(abs(d), 9) DESC, symbol, expiry, strike_price LIMIT 30""")(lambda c: screens.iv_shockers(c, LATER, 30, "stock"))
query("top_movers", f""", a AS (SELECT *, dense_rank() OVER (PARTITION BY symbol, strike_price, expiry ORDER BY timestamp DESC) AS rk FROM ocdata WHERE expiry >= DATE '{LATER}'),
d AS (SELECT symbol, expiry, strike_price, l.ce_ltp AS ltp_now, p.ce_ltp AS ltp_prev, l.ce_ltp - p.ce_ltp AS ltp_chg, round((l.ce_ltp - p.ce_ltp) * 100 / p.ce_ltp, 1) AS ltp_pct_chg
  FROM (SELECT * FROM a WHERE rk = 1) l JOIN (SELECT * FROM a WHERE rk = 2) p USING (symbol, strike_price, expiry) WHERE l.ce_ltp > 0 AND p.ce_ltp > 0)
SELECT 'gainer' AS kind, * FROM (SELECT * FROM d ORDER BY ltp_chg DESC, 1, 2, 3 LIMIT 20) UNION ALL SELECT 'loser', * FROM (SELECT * FROM d ORDER BY ltp_chg, 1, 2, 3 LIMIT 20)""")(lambda c: screens.top_movers(c, LATER))
_BUILD = "CASE WHEN {0} > 0 AND {1} > 0 THEN 'Long Build-Up' WHEN {0} > 0 AND {1} < 0 THEN 'Short Build-Up' WHEN {0} < 0 AND {1} > 0 THEN 'Short Covering' WHEN {0} < 0 AND {1} < 0 THEN 'Long Unwinding' ELSE 'Neutral' END"
query("oi_change", _LATEST + f""" SELECT symbol, expiry, strike_price, ce_oi_change, pe_oi_change, {_BUILD.format('ce_oi_change', 'ce_ltp')} AS ce_signal, {_BUILD.format('pe_oi_change', 'pe_ltp')} AS pe_signal, round(ce_volume / nullif(ce_oi, 0), 4) AS ce_vol_oi, round(pe_volume / nullif(pe_oi, 0), 4) AS pe_vol_oi
FROM last WHERE expiry >= DATE '{AS_OF}' AND (abs(ce_oi_change) >= 1 OR abs(pe_oi_change) >= 1)""")(lambda c: screens.oi_change(c, AS_OF))
query("oi_signals_all", _TWO + f""", s AS (SELECT symbol, sum(CASE rk WHEN 1 THEN ce_oi ELSE -ce_oi END) AS ce_oi_chg, sum(CASE rk WHEN 1 THEN pe_oi ELSE -pe_oi END) AS pe_oi_chg, round(avg(ce_ltp) FILTER (rk = 1) - avg(ce_ltp) FILTER (rk = 2), 4) AS ce_ltp_chg, round(avg(pe_ltp) FILTER (rk = 1) - avg(pe_ltp) FILTER (rk = 2), 4) AS pe_ltp_chg FROM r WHERE rk <= 2 GROUP BY 1 HAVING count(DISTINCT timestamp) >= 2)
SELECT *, {_BUILD.format('ce_oi_chg', 'ce_ltp_chg')} AS ce_signal, {_BUILD.format('pe_oi_chg', 'pe_ltp_chg')} AS pe_signal FROM s""")(screens.oi_signals)
query("oi_history", _window(3) + """, d AS (
  SELECT symbol, expiry, dt, strike_price, avg(ce_oi) AS c, avg(pe_oi) AS p, avg(underlying_price) AS spot FROM recent WHERE ce_ltp + pe_ltp > 0 GROUP BY 1, 2, 3, 4
), l AS (
  SELECT *, c - lag(c) OVER w AS cc, p - lag(p) OVER w AS pc, avg(spot) OVER (PARTITION BY symbol, expiry) AS mean FROM d WINDOW w AS (PARTITION BY symbol, expiry, strike_price ORDER BY dt)
)
SELECT symbol, expiry, dt, strike_price, round(c, 4) AS ce_oi, round(p, 4) AS pe_oi, round(spot, 4) AS spot, round(cc, 4) AS ce_oi_chg, round(pc, 4) AS pe_oi_chg FROM l
WHERE strike_price BETWEEN mean * (1 - 1.5 / 100) AND mean * (1 + 1.5 / 100)""")(lambda c: screens.oi_history(c, 3, 1.5))
query("iv_history", _window(3) + """, d AS (
  SELECT symbol, expiry, dt, strike_price, avg(ce_iv) AS c, avg(pe_iv) AS p, avg(underlying_price) AS spot FROM recent WHERE ce_iv > 0 GROUP BY 1, 2, 3, 4
), l AS (
  SELECT *, (c + p) / 2 AS a, (c + p) / 2 - lag((c + p) / 2) OVER (PARTITION BY symbol, expiry, strike_price ORDER BY dt) AS ch, avg(spot) OVER (PARTITION BY symbol, expiry) AS mean FROM d
)
SELECT symbol, expiry, dt, strike_price, round(c, 4) AS ce_iv, round(p, 4) AS pe_iv, round(spot, 4) AS spot, round(a, 4) AS avg_iv, round(ch, 4) + 0 AS iv_chg FROM l
WHERE strike_price BETWEEN mean * (1 - 1.5 / 100) AND mean * (1 + 1.5 / 100)""")(lambda c: screens.iv_history(c, 3, 1.5))
query("divergence", oracles.divergence(AS_OF))(lambda c: screens.divergence(c, AS_OF))
query("divergence_intraday", oracles.divergence(AS_OF, True))(lambda c: screens.divergence(c, AS_OF, True))
query("delta_oi", _LATEST + """, s AS (SELECT symbol, expiry, sum(abs(ce_delta) * ce_oi * lotsize) / 1e6 AS c, sum(abs(pe_delta) * pe_oi * lotsize) / 1e6 AS p FROM last GROUP BY 1, 2)
SELECT symbol, expiry, round(c, 4) AS ce_m, round(p, 4) AS pe_m, round(c - p, 4) AS net_m, CASE WHEN c - p > 0.5 THEN 'bullish' WHEN c - p < -0.5 THEN
    'bearish' ELSE 'neutral' END AS lean FROM s""")(screens.delta_oi)
query("premium_lens", _LATEST + """, s AS (
  SELECT symbol, expiry, strike_price, round(ce_ltp / nullif(ce_tprice, 0), 4) AS ce_ratio, round((ce_ltp - ce_tprice) * 100 / nullif(ce_tprice, 0), 2) AS ce_diff_pct,
    round(pe_ltp / nullif(pe_tprice, 0), 4) AS pe_ratio, round((pe_ltp - pe_tprice) * 100 / nullif(pe_tprice, 0), 2) AS pe_diff_pct FROM last
  WHERE (ce_ltp > 0 OR pe_ltp > 0) AND (ce_oi >= 20000 OR pe_oi >= 20000)
)
SELECT * FROM s WHERE ce_ratio < 0.9 OR ce_ratio > 1.2 OR pe_ratio < 0.9 OR pe_ratio > 1.2""")(lambda c: screens.premium_lens(c, 0.9, 1.2, 20000))
query("metadata", " SELECT symbol, count(DISTINCT timestamp) AS timestamps, count(DISTINCT expiry) AS expiries, strftime(max(timestamp), '%Y-%m-%d %H:%M') AS latest, max(lotsize) AS lot_size FROM ocdata GROUP BY 1")(screens.metadata)
query("strike_trend", " SELECT symbol, expiry, strike_price, timestamp, ce_ltp, pe_oi FROM ocdata")(lambda c: screens.strike_trend(c, ["ce_ltp", "pe_oi"]))
query("atm_strikes", " SELECT DISTINCT symbol, expiry, distance_from_atm, strike_price, atm_strike FROM ocdata")(lambda c: c.select("symbol", "expiry", "distance_from_atm", "strike_price", "atm_strike").distinct())
query("heatmap_pivot", " SELECT symbol, strike_price, sum(ce_oi) FILTER (CAST(timestamp AS DATE) = DATE '2024-01-16') AS d16, sum(ce_oi) FILTER (CAST(timestamp AS DATE) = DATE '2024-01-17') AS d17 FROM ocdata WHERE CAST(timestamp AS DATE) >= DATE '2024-01-16' GROUP BY 1, 2")(lambda c: c.filter("timestamp >= '2024-01-16'").withColumn("day", F.date_format("timestamp", "'d'dd")).groupBy("symbol", "strike_price").pivot("day", ["d16", "d17"]).agg(F.sum("ce_oi")))
query("iv_term_structure", _LATEST + """, n AS (SELECT *, row_number() OVER (PARTITION BY symbol, expiry ORDER BY abs(distance_from_atm), strike_price) AS k FROM last), m AS (SELECT symbol, expiry, (ce_iv + pe_iv) / 2 AS mid, pe_iv - ce_iv AS skew FROM n WHERE k = 1)
SELECT symbol, expiry, round(mid, 4) AS mid, round(skew, 4) AS skew, CASE WHEN arg_max(mid, expiry) OVER (PARTITION BY symbol) > arg_min(mid, expiry)
    OVER (PARTITION BY symbol) THEN 'contango' ELSE 'backwardation' END AS shape FROM m""")(screens.term_structure)
query("iv_rank", _LATEST + """, n AS (
  SELECT symbol, expiry, timestamp AS seen, (ce_iv + pe_iv) / 2 AS now, m_volatility AS rv FROM last WHERE distance_from_atm = 0
), p AS (
  SELECT n.symbol, n.expiry, count(*) AS n, min((ce_iv + pe_iv) / 2) AS lo, max((ce_iv + pe_iv) / 2) AS hi, avg(CASE WHEN (ce_iv + pe_iv) / 2 < now THEN 1.0 ELSE 0.0 END) AS under
  FROM ocdata o JOIN n ON o.symbol = n.symbol AND o.expiry = n.expiry WHERE distance_from_atm = 0 AND ce_iv + pe_iv > 0 AND timestamp >= seen - INTERVAL 4 DAY GROUP BY 1, 2
)
SELECT n.symbol, n.expiry, CAST(coalesce(n, 0) AS BIGINT) AS n, round(now, 2) AS iv_now, CASE WHEN n >= 2 AND hi > lo THEN round((now - lo) / (hi - lo) * 100, 1) END AS iv_rank,
  CASE WHEN n >= 2 THEN round(under * 100, 1) END AS iv_percentile, round(rv - now, 2) AS rv_iv FROM n LEFT JOIN p ON n.symbol = p.symbol AND n.expiry = p.expiry""")(lambda c: screens.iv_rank(c, 4))
query("pc_skew", _LATEST + """, m AS (
  SELECT symbol, expiry, coalesce(min(strike_price) FILTER (distance_from_atm = 0), max(underlying_price)) AS middle FROM last GROUP BY 1, 2
), s AS (
  SELECT l.symbol, l.expiry, CASE WHEN count(*) FILTER (strike_price > middle AND ce_iv > 1) >= 3 THEN regr_slope(ce_iv, strike_price) FILTER (strike_price > middle AND ce_iv > 1) * 100 END AS c,
    CASE WHEN count(*) FILTER (strike_price < middle AND pe_iv > 1) >= 3 THEN regr_slope(pe_iv, strike_price) FILTER (strike_price < middle AND pe_iv > 1) * 100 END AS p
  FROM last l JOIN m ON l.symbol = m.symbol AND l.expiry = m.expiry GROUP BY 1, 2
), r AS (""" + oracles.quarter_delta("symbol, expiry", "last") + """)
SELECT s.symbol, s.expiry, round(rr, 2) AS risk_reversal, round(round(c, 9), 4) AS call_slope, round(round(p, 9), 4) AS put_slope, round(round(abs(p) - abs(c), 9), 4) AS asymmetry
FROM s JOIN r ON s.symbol = r.symbol AND s.expiry = r.expiry""")(screens.skew)
query("oi_weighted_iv", _LATEST + f" SELECT symbol, expiry, {oracles.WEIGHTED_SIDES} FROM last WHERE ce_iv > 0 GROUP BY 1, 2")(screens.oi_weighted_iv)
query("iv_intraday_trend", f""", t AS (SELECT * FROM ocdata WHERE CAST(timestamp AS DATE) = (SELECT max(CAST(timestamp AS DATE)) FROM ocdata)), b AS (SELECT symbol, min(timestamp) AS a, max(timestamp) AS z FROM t GROUP BY 1),
v AS (SELECT t.symbol, timestamp, a, z, sum(ce_iv * ce_oi + pe_iv * pe_oi) / nullif(sum(ce_oi + pe_oi), 0) AS iv FROM t JOIN b ON t.symbol = b.symbol WHERE expiry >= DATE '{LATER}' AND ce_iv > 0 GROUP BY 1, 2, 3, 4),
o AS (SELECT * FROM v WHERE timestamp = a), n AS (SELECT * FROM v WHERE timestamp = z)
SELECT o.symbol, round(o.iv, 2) AS iv_open, round(n.iv, 2) AS iv_now, round(n.iv - o.iv, 2) + 0 AS iv_chg, CASE WHEN o.iv > 0 THEN round((n.iv - o.iv) / o.iv * 100, 2) + 0 END AS iv_chg_pct FROM o JOIN n ON o.symbol = n.symbol""")(lambda c: screens.iv_intraday(c, LATER))
query("flow_buckets", oracles.FLOW_BUCKETS)(flows.flow_buckets)
query("flow_signals", oracles.FLOW_SIGNALS)(flows.flow_signals)
query("flow_crossing", oracles.FLOW_CROSSING)(flows.flow_crossing)
query("migrated_strikes", oracles.MIGRATED)(flows.migrated_strikes)
query("smart_money")(flows.smart_money)
query("smart_money_eod")(lambda c: flows.smart_money(flows.end_of_day(c, AS_OF)))
query("smart_money_intraday")(lambda c: flows.smart_money(flows.one_day(c, LATER), min_oi_change=500.0))
query("exposure_layers", oracles.EXPOSURE_LAYERS)(layers.exposure_layers)
query("exposure_layers_eod", oracles.end_of_day(AS_OF) + oracles.EXPOSURE_LAYERS.replace("ocdata", "eod"))(lambda c: layers.exposure_layers(flows.end_of_day(c, AS_OF)))
query("exposure_profiles", oracles.EXPOSURE_PROFILES)(layers.exposure_profiles)
query("eod_rows", oracles.eod_rows(LATER))(lambda c: screens.eod_rows(c, LATER).select("symbol", "expiry", "timestamp", "date", "strike_price", "ce_oi", "pe_oi", "ce_ltp"))
query("intraday_oi", oracles.INTRADAY_OI)(screens.intraday_oi)
query("risk_reversals", oracles.RISK_REVERSALS)(screens.risk_reversals)
query("oi_weighted_iv_overall", oracles.WEIGHTED_IV_OVERALL)(screens.weighted_iv_overall)
query("strike_gamma", oracles.STRIKE_GAMMA)(screens.strike_gamma)
query("join_nearest_tolerance", """, x AS (SELECT symbol, timestamp, expiry, round(sum(strike_price * (ce_oi + pe_oi)) / sum(ce_oi + pe_oi), 4) AS center, max(underlying_price) AS spot FROM ocdata GROUP BY 1, 2, 3)
SELECT symbol, timestamp, expiry, center, (SELECT arg_min(y.center, abs(y.center - x.center)) FROM x y WHERE y.symbol = x.symbol AND y.timestamp =
    x.timestamp AND y.expiry <> x.expiry AND abs(y.center - x.center) < x.spot * 0.02) AS match FROM x""")(screens.nearest_before)
query("strike_interval", """, d AS (SELECT DISTINCT symbol, expiry, timestamp, strike_price FROM ocdata), g AS (SELECT *, strike_price - lag(strike_price) OVER (PARTITION BY symbol, expiry, timestamp ORDER BY strike_price) AS gap FROM d)
SELECT symbol, expiry, timestamp, coalesce(median(gap), 0) AS strike_interval FROM g GROUP BY 1, 2, 3""")(ladder.strike_interval)
query("gamma_flip", """, s AS (SELECT symbol, expiry, timestamp, strike_price AS k, fut_price AS r, net_gexv AS g, lead(strike_price) OVER w AS k2, lead(net_gexv) OVER w AS g2 FROM ocdata WINDOW w AS (PARTITION BY symbol, expiry, timestamp ORDER BY strike_price)),
c AS (SELECT *, CASE WHEN abs(g2 - g) < 1e-12 THEN k ELSE k - g * (k2 - k) / (g2 - g) END AS flip FROM s WHERE sign(g) <> sign(g2)), b AS (SELECT *,
    row_number() OVER (PARTITION BY symbol, expiry, timestamp ORDER BY abs(flip - r), k) AS n FROM c), bb AS (SELECT symbol, expiry, timestamp,
    round(flip, 2) AS gamma_flip, k2 - k AS transition_width FROM b WHERE n = 1),
t AS (SELECT symbol, expiry, timestamp, sum(abs(g)) AS gross, sum(g) AS net, min(g) AS lo, max(g) AS hi, count(*) AS n, avg(CASE WHEN g < 0 THEN 1.0
    ELSE 0.0 END) AS below, coalesce(max(g + (r - k) * (g2 - g) / (k2 - k)) FILTER (k <= r AND k2 > r), CASE WHEN max(r) < min(k) THEN arg_min(g, k)
    ELSE arg_max(g, k) END) AS here FROM s GROUP BY 1, 2, 3)
SELECT t.symbol, t.expiry, t.timestamp, gamma_flip, (SELECT arg_min(k, abs(k - gamma_flip) * 1e6 + k / 1e6) FROM s WHERE s.symbol = t.symbol AND
    s.expiry = t.expiry AND s.timestamp = t.timestamp) AS flip_nearest, transition_width,
  CASE WHEN n < 2 THEN 'insufficient' WHEN gamma_flip IS NULL AND lo >= 0 THEN 'all_positive' WHEN gamma_flip IS NULL AND hi <= 0 THEN 'all_negative'
      WHEN abs(here) <= 0.05 * gross THEN 'mixed' WHEN here > 0 THEN 'positive' ELSE 'negative' END AS gex_regime, CASE WHEN gross > 1e-9 THEN
      round(net / gross, 4) ELSE 0 END AS net_gex_norm, round(below, 4) AS neg_gamma_fraction
FROM t LEFT JOIN bb ON t.symbol = bb.symbol AND t.expiry = bb.expiry AND t.timestamp = bb.timestamp""")(lambda c: ladder.gamma_flip(c.withColumn("g", ladder.net_gamma())))
query("gamma_shelf", """, s AS (SELECT symbol, expiry, timestamp, strike_price AS k, net_gexv AS g, abs(net_gexv) AS a, row_number() OVER (PARTITION BY symbol, expiry, timestamp ORDER BY abs(net_gexv) DESC, strike_price) AS n FROM ocdata), p AS (SELECT symbol, expiry, timestamp, k AS pk, a AS pa, g AS pg FROM s WHERE n = 1 AND a > 0),
j AS (SELECT s.*, pk, pa, pg, max(CASE WHEN a < pa * 0.5 AND k < pk THEN k END) OVER w AS lb, min(CASE WHEN a < pa * 0.5 AND k > pk THEN k END) OVER w
    AS ub, sum(a) OVER w AS total FROM s JOIN p ON s.symbol = p.symbol AND s.expiry = p.expiry AND s.timestamp = p.timestamp WINDOW w AS (PARTITION BY
    s.symbol, s.expiry, s.timestamp))
SELECT symbol, expiry, timestamp, round(sum(k * a) / sum(a), 2) AS center, count(*) AS width, max(pk) AS peak_strike, round(max(pg), 4) AS peak_value,
    min(k) AS lo, max(k) AS hi, round(max(pa) / max(total), 4) AS concentration FROM j WHERE (lb IS NULL OR k > lb) AND (ub IS NULL OR k < ub) GROUP
    BY 1, 2, 3""")(lambda c: ladder.gamma_shelf(c.withColumn("g", ladder.net_gamma())).drop("center_exact"))
query("oi_com", " SELECT symbol, expiry, timestamp, CASE WHEN sum(ce_oi + pe_oi) > 0 THEN round(sum(strike_price * (ce_oi + pe_oi)) / sum(ce_oi + pe_oi), 2) END AS oi_com FROM ocdata GROUP BY 1, 2, 3")(ladder.oi_center)
query("max_pain", """, p AS (SELECT a.symbol, a.expiry, a.timestamp, a.strike_price AS k, round(sum(greatest(a.strike_price - b.strike_price, 0) * b.ce_oi * b.lotsize + greatest(b.strike_price - a.strike_price, 0) * b.pe_oi * b.lotsize), 2) AS pain FROM ocdata a JOIN ocdata b ON a.symbol = b.symbol AND a.expiry = b.expiry AND a.timestamp = b.timestamp GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, expiry, timestamp ORDER BY pain, k) AS n FROM p) SELECT symbol, expiry, timestamp, k AS
    max_pain FROM r WHERE n = 1""")(ladder.max_pain)
query("gamma_profile", _LATEST + """, m AS (SELECT symbol, expiry, timestamp, min(strike_price) AS lo, max(strike_price) AS hi FROM last GROUP BY 1, 2, 3), l AS (SELECT m.*, i AS level, lo + (hi - lo) * i / 199 AS price FROM m, range(200) t(i)),
n AS (SELECT l.symbol, l.expiry, l.timestamp, level, price, ce_gamma * ce_oi * lotsize / 1e9 AS call, -pe_gamma * pe_oi * lotsize / 1e9 AS put,
    row_number() OVER (PARTITION BY l.symbol, l.expiry, level ORDER BY round(abs(strike_price - price), 9), strike_price) AS k FROM l JOIN last o ON
    l.symbol = o.symbol AND l.expiry = o.expiry)
SELECT symbol, expiry, timestamp, CAST(level AS INTEGER) AS level, round(price, 4) AS price, round(call, 14) AS call, round(put, 14) AS put FROM n WHERE
    k = 1""")(lambda c: ladder.gamma_profile(ocdata.latest(c, "symbol")).select(*ladder.KEYS, "level", F.round("price", 4).alias("price"), F.round("call", 14).alias("call"), F.round("put", 14).alias("put")))
query("gamma_magnet", oracles.MAGNET)(lambda c: ladder.magnet(ladder.gamma_profile(ocdata.latest(c, "symbol"))))
query("dealer_divergence", oracles.DEALER_DIVERGENCE)(lambda c: ladder.divergence_of_centers(c, F.col("expected_move_theoretical")))
query("oi_shelf", oracles.OI_SHELF)(walls.oi_shelves)
query("iv_smile_fit")(grouped.iv_smile)
query("clusters", oracles.CLUSTERS + " SELECT * FROM cluster")(clusters.clusters)
query("tracks", oracles.TRACKS)(lambda c: clusters.tracks(clusters.clusters(c), c.groupBy(*ladder.KEYS).agg(F.max("underlying_price").alias("spot"))))
query("monthly_expiries", """, d AS (SELECT symbol, CAST(timestamp AS DATE) AS date, date_trunc('month', expiry) AS mo, max(expiry) AS expiry FROM ocdata WHERE expiry >= CAST(timestamp AS DATE) GROUP BY 1, 2, 3), r AS (SELECT symbol, date, expiry, CAST(row_number() OVER (PARTITION BY symbol, date ORDER BY expiry) - 1 AS INTEGER) AS expiry_rank FROM d WHERE expiry - date > 3)
SELECT * FROM r WHERE expiry_rank <= 1""")(eod.monthly)
query("stage1", oracles.STAGE1 + " SELECT * FROM stage1")(eod.stage1)
query("stage2", oracles.STAGE2 + " SELECT * FROM stage2")(lambda c: eod.stage2(eod.stage1(c)))
query("signals", oracles.SIGNALS)(lambda c: eod.signal_counts(eod.stage2(eod.stage1(c))))
query("strength", oracles.strength("2024-01-09", "2024-01-17"))(lambda c: eod.history(eod.stage2(eod.stage1(c)), "2024-01-09", "2024-01-17"))
for _v in ("all", "changed", "dropped"):
    query(f"exposure_screener_{_v}", oracles.screener(AS_OF, _v))(lambda c, v=_v: eod.screener(eod.stage2(eod.stage1(c)), AS_OF, v))
query("regime_ramp", oracles.SHORT_HISTORY)(lambda c: eod.regime_ramp(eod.stage2(eod.stage1(c))))
query("eod_dates", oracles.STAGE2 + """
SELECT symbol, expiry_rank, date, CAST(row_number() OVER (PARTITION BY symbol, expiry_rank ORDER BY date DESC) AS INTEGER) AS recency FROM (SELECT DISTINCT symbol, expiry_rank, date FROM stage2)""")(lambda c: eod.dates(eod.stage2(eod.stage1(c))))
query("symbol_history")(lambda c: eod.symbol_history(eod.stage2(eod.stage1(c))))
query("signal_info")(lambda c: eod.signal_info(eod.stage2(eod.stage1(c))))
query("indicator_counts", oracles.INDICATORS)(lambda c: eod.indicator_counts(eod.stage2(eod.stage1(c))))
query("defense_hold", oracles.DEFENSE)(lambda c: eod.stage1(c).select(*eod.KEYS, regime_order(F.col("gex_regime")).alias("regime_order"), hold_probability(F.col("transition_width_norm"), F.col("concentration"), F.col("gex_regime")).alias("hold")))
query("upsert", " SELECT symbol, expiry, timestamp, strike_price, CASE WHEN symbol = 'ITC' THEN 0 ELSE ce_oi END AS ce_oi FROM ocdata")(lambda c: (lambda x: ocdata.upserted(x, x.filter("symbol = 'ITC'").withColumn("ce_oi", F.lit(0.0)), [*ladder.KEYS, "strike_price"]))(c.select(*ladder.KEYS, "strike_price", "ce_oi")))
query("expiry_rule", """, d AS (SELECT DISTINCT CAST(timestamp AS DATE) AS day FROM ocdata), e AS (SELECT day, last_day(day) AS m, last_day(last_day(day) + 1) AS m2 FROM d), f AS (SELECT day, m - CAST((dayofweek(m) - 4 + 7) % 7 AS INTEGER) AS a, m2 - CAST((dayofweek(m2) - 4 + 7) % 7 AS INTEGER) AS b FROM e)
SELECT day, CASE WHEN a >= day THEN a ELSE b END AS expiry FROM f""")(lambda c: c.select(F.to_date("timestamp").alias("day")).distinct().withColumn("expiry", monthly_expiry(F.col("day"))))
query("vix_levels", " SELECT DISTINCT symbol, expiry, strike_price, timestamp, CASE WHEN ce_iv > 30 THEN 'extreme' WHEN ce_iv > 20 THEN 'elevated' WHEN ce_iv > 12 THEN 'normal' ELSE 'low' END AS level FROM ocdata")(lambda c: c.select("symbol", "expiry", "strike_price", "timestamp", vix_level(F.col("ce_iv")).alias("level")))
query("strike_snapshot", _LATEST + " SELECT symbol, expiry, strike_price, ce_ltp, pe_ltp, ce_oi, pe_oi, round(ce_ltp / nullif(ce_tprice, 0), 4) AS ce_ratio, round(pe_ltp / nullif(pe_tprice, 0), 4) AS pe_ratio FROM last")(screens.strike_snapshot)
query("oi_expiries", _LATEST + f" SELECT DISTINCT symbol, expiry FROM last WHERE expiry >= DATE '{AS_OF}' AND ce_oi + pe_oi > 0")(lambda c: ocdata.latest(c, "symbol").filter((F.col("expiry") >= F.lit(AS_OF).cast("date")) & (F.col("ce_oi") + F.col("pe_oi") > 0)).select("symbol", "expiry").distinct())
query("oi_walls", oracles.oi_walls(AS_OF))(lambda c: walls.oi_walls(c, AS_OF))
query("best_by_delta", _LATEST + """, s AS (SELECT symbol, expiry, 'CE' AS side, strike_price, abs(ce_delta) AS delta, ce_ltp AS ltp FROM last UNION ALL SELECT symbol, expiry, 'PE', strike_price, abs(pe_delta), pe_ltp FROM last),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, expiry, side ORDER BY round(abs(delta - 0.3), 9), strike_price) AS n FROM s) SELECT symbol,
    expiry, side, strike_price, round(delta, 4) AS delta, ltp FROM n WHERE n = 1""")(screens.best_by_delta)
query("market_sessions", """, d AS (SELECT DISTINCT symbol, expiry, timestamp, days_to_expiry AS dte, hour(timestamp) * 60 + minute(timestamp) AS m FROM ocdata)
SELECT symbol, expiry, timestamp, CASE WHEN m BETWEEN 540 AND 554 THEN 'PRE-OPEN' WHEN m BETWEEN 555 AND 929 THEN 'OPEN' WHEN m BETWEEN 930 AND 959
    THEN 'POST-CLOSE' ELSE 'CLOSED' END AS session, CASE WHEN dte <= 7 THEN 'near' WHEN dte <= 30 THEN 'mid' ELSE 'far' END AS dte_band FROM d""")(
    lambda c: c.select(*ladder.KEYS, words.session(F.col("timestamp")).alias("session"), words.dte_band(F.col("days_to_expiry")).alias("dte_band")).distinct()
)
query("spread_classes", """ SELECT symbol, expiry, timestamp, strike_price, CASE WHEN ce_ltp > 0 THEN CASE WHEN ce_bid_ask_spread / ce_ltp * 100 >= 0.5 THEN 'bad' WHEN ce_bid_ask_spread / ce_ltp * 100 >= 0.2 THEN 'warn' ELSE 'good' END END AS ce_class,
  CASE WHEN pe_ltp > 0 THEN CASE WHEN pe_bid_ask_spread / pe_ltp * 100 >= 0.5 THEN 'bad' WHEN pe_bid_ask_spread / pe_ltp * 100 >= 0.2 THEN 'warn' ELSE
      'good' END END AS pe_class FROM ocdata""")(
    lambda c: c.select(*ladder.KEYS, "strike_price", *(words.spread_class(F.col(f"{s}_bid_ask_spread"), F.col(f"{s}_ltp"), 0.2, 0.5).alias(f"{s}_class") for s in ("ce", "pe")))
)
query("gamma_analysis")(lambda c: gamma_page.gamma_analysis(ocdata.latest(c, "symbol")))
query("narratives", oracles.NARRATIVES)(lambda c: eod.narratives(eod.stage2(eod.stage1(c))))
query("change_summary", oracles.change_summary("2024-01-09", "2024-01-17", {"fut_price": "pct", "atm_iv": "pct", "net_gex_norm": "delta", "gamma_flip": "delta", "gex_regime": "state", "confidence": "state"}))(lambda c: eod.change_summary(eod.stage2(eod.stage1(c)), "2024-01-09", "2024-01-17", ["fut_price", "atm_iv", "net_gex_norm", "gamma_flip", "gex_regime", "confidence"]))
