"""SQL of queries whose definition takes more than a few lines; each is what follows the chain's clauses."""

from __future__ import annotations

#: Both sides of each row as rows of their own.
SIDES = """
, sides AS (
  SELECT symbol, expiry, timestamp, strike_price, 'CE' AS side, ce_oi AS oi, ce_oi_change AS oi_change, ce_ltp AS ltp FROM ocdata
  UNION ALL
  SELECT symbol, expiry, timestamp, strike_price, 'PE', pe_oi, pe_oi_change, pe_ltp FROM ocdata
)"""

BUILDUP = """CASE WHEN {0} > 0 AND {1} > 0 THEN 'Long Build-Up' WHEN {0} > 0 AND {1} < 0 THEN 'Short Build-Up'
    WHEN {0} < 0 AND {1} > 0 THEN 'Short Covering' WHEN {0} < 0 AND {1} < 0 THEN 'Long Unwinding' ELSE 'Neutral' END"""


def shelf_sql(rows: str, keys: str) -> str:
    """Clauses that end in shelf, from a relation (keys, strike_price, oi, oi_change, moved).

    A strike belongs to the shelf if no strike between the wall and itself, itself included, ends
    it: a self-join where the operator runs windows.
    """
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""
, counted AS (
  SELECT *, symbol IN ('NIFTY', 'BANKNIFTY') AS idx, count(*) FILTER (strike_price % 100 = 0) OVER w AS n100,
    count(*) FILTER (strike_price % 50 = 0) OVER w AS n50, count(*) FILTER (strike_price % 1 = 0) OVER w AS n1
  FROM {rows} WINDOW w AS (PARTITION BY {keys})
), liked AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY strike_price) AS place,
    round(strike_price - lag(strike_price) OVER (PARTITION BY {keys} ORDER BY strike_price), 3) AS gap
  FROM counted
  WHERE CASE WHEN idx AND n100 >= 3 THEN strike_price % 100 = 0 WHEN idx AND n50 >= 3 THEN strike_price % 50 = 0
    WHEN NOT idx AND n1 >= 2 THEN strike_price % 1 = 0 ELSE true END
), wall AS (
  SELECT {keys}, strike_price AS wall_strike, oi AS wall_oi, place AS wall_place
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY oi DESC, strike_price) AS n FROM liked) WHERE n = 1 AND oi > 0
), gaps AS (
  SELECT {keys}, gap, count(*) AS often, min(place) AS early FROM liked JOIN wall USING ({keys})
  WHERE place > wall_place - 6 AND place <= wall_place + 6 AND gap > 0 GROUP BY ALL
), grid AS (
  SELECT {keys}, gap AS grid FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY often DESC, early) AS n FROM gaps) WHERE n = 1
), placed AS (
  SELECT l.*, wall_strike, wall_oi, coalesce(grid, 0) AS grid, round((strike_price - wall_strike) / nullif(coalesce(grid, 0), 0)) AS steps
  FROM liked l JOIN wall USING ({keys}) LEFT JOIN grid USING ({keys})
), gridded AS (
  SELECT * FROM placed WHERE strike_price = wall_strike OR abs(strike_price - wall_strike - steps * grid) < 1e-6
), ends AS (
  SELECT *, abs(steps) - coalesce(lag(abs(steps)) OVER (PARTITION BY {keys}, sign(steps) ORDER BY abs(steps)), 0) > 2 OR oi < 0.4 * wall_oi AS stop
      FROM gridded
), held AS (
  SELECT a.* FROM ends a WHERE a.strike_price = a.wall_strike OR a.grid > 0 AND NOT EXISTS (
    SELECT 1 FROM ends b WHERE {on} AND b.stop AND sign(a.steps) = sign(b.steps) AND abs(b.steps) <= abs(a.steps))
), shelf AS (
  SELECT {keys}, max(wall_strike) AS wall_strike, max(wall_oi) AS wall_oi, min(strike_price) AS lo, max(strike_price) AS hi, round(sum(oi), 2) AS oi,
    round(sum(strike_price * oi) / sum(oi), 2) AS com, count(*) AS n_strikes, count(*) > 1 AS is_shelf, max(grid) AS grid,
    string_agg(CAST(strike_price AS VARCHAR), ',' ORDER BY strike_price) AS members, round(sum(oi_change), 2) AS oi_change,
    sum(moved * oi) / sum(oi) AS moved
  FROM held GROUP BY {keys}
)"""


OI_SHELF = (
    SIDES
    + """
, times AS (
  SELECT symbol, timestamp, lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS earlier FROM (SELECT DISTINCT symbol, timestamp FROM
      ocdata)
), moves AS (
  SELECT s.*, s.ltp - coalesce(b.ltp, s.ltp) AS moved FROM sides s JOIN times t ON s.symbol = t.symbol AND s.timestamp = t.timestamp
  LEFT JOIN sides b ON b.symbol = s.symbol AND b.expiry = s.expiry AND b.timestamp = t.earlier AND b.strike_price = s.strike_price AND b.side = s.side
)"""
    + shelf_sql("moves", "symbol, expiry, timestamp, side")
    + f"""
SELECT * EXCLUDE (moved), {BUILDUP.format('oi_change', 'moved')} AS signal,
  round(com - lag(com) OVER (PARTITION BY symbol, expiry, side ORDER BY timestamp), 2) AS migration
FROM shelf"""
)


def _wall_side(s: str) -> str:
    names = {"wall_strike": "wall", "wall_oi": "wall_oi", "lo": "shelf_lo", "hi": "shelf_hi", "oi": "shelf_oi", "com": "shelf_com", "n_strikes": "shelf_n", "is_shelf": "is_shelf", "members": "members", "oi_change": "oi_chg"}
    return ", ".join(f"{s}.{n} AS {s}_{m}" for n, m in names.items()) + ", " + BUILDUP.format(f"{s}.oi_change", f"{s}.moved") + f" AS {s}_signal"


def oi_walls(as_of: str) -> str:
    return (
        SIDES
        + f"""
, live AS (
  SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rk FROM ocdata WHERE expiry >= DATE '{as_of}' AND (ce_oi > 0 OR pe_oi >
      0)
), front AS (
  SELECT symbol, min(expiry) AS expiry, max(timestamp) AS ts FROM live WHERE rk = 1 GROUP BY 1
), earlier AS (
  SELECT symbol, max(timestamp) AS ts FROM live WHERE rk = 2 GROUP BY 1
), moves AS (
  SELECT s.symbol, s.expiry, s.side, s.strike_price, s.oi, s.oi_change, s.ltp - coalesce(b.ltp, s.ltp) AS moved
  FROM sides s JOIN front f ON s.symbol = f.symbol AND s.expiry = f.expiry AND s.timestamp = f.ts LEFT JOIN earlier e ON e.symbol = s.symbol
  LEFT JOIN sides b ON b.symbol = s.symbol AND b.expiry = s.expiry AND b.timestamp = e.ts AND b.strike_price = s.strike_price AND b.side = s.side
)"""
        + shelf_sql("moves", "symbol, expiry, side")
        + f"""
, now AS (SELECT o.* FROM ocdata o JOIN front f ON o.symbol = f.symbol AND o.expiry = f.expiry AND o.timestamp = f.ts),
totals AS (
  SELECT symbol, expiry, max(underlying_price) AS spot, max(fut_price) AS fut_price, avg(ce_oi) FILTER (ce_oi > 0) AS ce_mean, avg(pe_oi) FILTER
      (pe_oi > 0) AS pe_mean,
    round(sum(pe_oi) / nullif(sum(ce_oi), 0), 3) AS pcr FROM now GROUP BY 1, 2
), gamma AS (
  SELECT symbol, strike_price AS gamma_wall, round(net_gexv, 2) AS gamma_wall_value
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(net_gexv), 6) DESC, strike_price) AS n FROM now) WHERE n = 1 AND
      round(abs(net_gexv), 6) > 0
)
SELECT ce.symbol, ce.expiry, spot, fut_price, {_wall_side('ce')}, {_wall_side('pe')},
  ce.wall_strike - spot AS ce_dist_spot, spot - pe.wall_strike AS pe_dist_spot, ce.wall_strike - fut_price AS ce_dist_fut, fut_price - pe.wall_strike
      AS pe_dist_fut,
  ce.wall_strike - pe.wall_strike AS wall_range, round(ce.wall_oi / ce_mean, 1) AS ce_strength, round(pe.wall_oi / pe_mean, 1) AS pe_strength, pcr,
  gamma_wall, gamma_wall_value, coalesce(abs(gamma_wall - ce.wall_strike) > 1e-6, false) AS gamma_diverges
FROM shelf ce JOIN shelf pe ON ce.symbol = pe.symbol AND ce.side = 'CE' AND pe.side = 'PE' JOIN totals t ON t.symbol = ce.symbol LEFT JOIN gamma g ON
    g.symbol = ce.symbol"""
    )


STAGE1 = """
, monthly AS (
  SELECT symbol, date, expiry, CAST(row_number() OVER (PARTITION BY symbol, date ORDER BY expiry) - 1 AS INTEGER) AS expiry_rank
  FROM (SELECT symbol, CAST(timestamp AS DATE) AS date, date_trunc('month', expiry) AS mo, max(expiry) AS expiry
        FROM ocdata WHERE expiry >= CAST(timestamp AS DATE) GROUP BY 1, 2, 3)
  WHERE expiry - date > 3
), day_rows AS (
  SELECT o.*, m.date, expiry_rank, max(timestamp) OVER (PARTITION BY o.symbol, m.date, o.expiry) AS last_ts
  FROM ocdata o JOIN monthly m ON o.symbol = m.symbol AND CAST(o.timestamp AS DATE) = m.date AND o.expiry = m.expiry WHERE expiry_rank <= 1
), ladders AS (
  SELECT *, count(*) OVER (PARTITION BY symbol, date, expiry_rank) AS n FROM day_rows
  WHERE timestamp = last_ts AND (ce_oi > 0 AND ce_volume > 0 AND CASE WHEN ce_ltp > 0 THEN ce_bid_ask_spread / ce_ltp * 100 ELSE 999 END <= 10
    OR pe_oi > 0 AND pe_volume > 0 AND CASE WHEN pe_ltp > 0 THEN pe_bid_ask_spread / pe_ltp * 100 ELSE 999 END <= 10)
), rowsx AS (
  SELECT *, strike_price - lag(strike_price) OVER (PARTITION BY symbol, date, expiry_rank ORDER BY strike_price) AS gap FROM ladders WHERE n >= 3
), heads AS (
  SELECT symbol, date, expiry_rank, any_value(expiry) AS expiry, median(fut_price) AS fut, round(median(underlying_price), 2) AS spot,
      median(days_to_expiry) AS dte,
    greatest(arg_min(ce_iv, abs(distance_from_atm) * 1e6 + strike_price / 1e6), 0) AS iv_exact, list(strike_price) AS strikes, coalesce(median(gap),
        0) AS strike_interval
  FROM rowsx GROUP BY 1, 2, 3
), seen AS (
  SELECT *, list(CASE WHEN iv_exact > 0 THEN iv_exact END) OVER (PARTITION BY symbol, expiry_rank ORDER BY date ROWS UNBOUNDED PRECEDING) AS raw_ivs,
    row_number() OVER (PARTITION BY symbol, expiry_rank ORDER BY date) AS i FROM heads
), ivs AS (
  SELECT *, list_filter(raw_ivs, lambda x: x IS NOT NULL)[-15:] AS last_ivs FROM seen
), smooth AS (
  SELECT *, coalesce(list_reduce(last_ivs, lambda a, v: a * CAST('0.6666666666666667' AS DOUBLE) + v) / list_reduce(list_transform(last_ivs, lambda v:
      CAST(1 AS DOUBLE)), lambda a, v: a * CAST('0.6666666666666667' AS DOUBLE) + v), iv_exact) AS iv_smooth FROM ivs
), moves AS (
  SELECT *, CASE WHEN iv_smooth > 0 AND dte > 0 THEN fut * iv_smooth / 100 * sqrt(dte / 365) ELSE fut * 0.05 END AS em FROM smooth
), caps AS (
  SELECT *, least(em + strike_interval, fut * 0.15) AS raw FROM moves
), fold AS (
  WITH RECURSIVE f AS (
    SELECT symbol, expiry_rank, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS half, CAST(NULL AS DOUBLE) AS mine FROM caps GROUP BY 1, 2
    UNION ALL
    SELECT symbol, expiry_rank, i, CASE WHEN inside THEN h ELSE half END, CASE WHEN inside THEN h END FROM (
      SELECT *, len(list_filter(strikes, lambda s: s >= fut - h AND s <= fut + h)) >= 2 AS inside FROM (
        SELECT f.symbol, f.expiry_rank, c.i, f.half, c.strikes, c.fut, CASE WHEN f.half > 0 THEN greatest(least(c.raw, f.half * 1.25), f.half * 0.75)
            ELSE c.raw END AS h
        FROM f JOIN caps c ON c.symbol = f.symbol AND c.expiry_rank = f.expiry_rank AND c.i = f.i + 1))
  )
  SELECT * FROM f WHERE mine IS NOT NULL
), head AS (
  SELECT c.* EXCLUDE (raw_ivs, last_ivs, raw, strikes), mine AS range_half FROM caps c JOIN fold f USING (symbol, expiry_rank, i)
), inside AS (
  SELECT r.*, h.fut AS mid, median(lotsize) OVER (PARTITION BY r.symbol, r.date, r.expiry_rank) AS lot
  FROM rowsx r JOIN head h USING (symbol, date, expiry_rank) WHERE strike_price BETWEEN h.fut - range_half AND h.fut + range_half
), gam AS (
  SELECT *, (ce_gamma * ce_oi - pe_gamma * pe_oi) * lot AS g, strike_price AS k, abs((ce_gamma * ce_oi - pe_gamma * pe_oi) * lot) AS a FROM inside
), sums AS (
  SELECT symbol, date, expiry_rank, round(sum(net_gexv) / 1e6, 4) AS net_gex, round(sum(ce_vanna_ex), 2) AS ce_vanna, round(sum(pe_vanna_ex), 2) AS
      pe_vanna,
    round(sum(net_vanna_ex), 2) AS net_vanna, round(sum(net_charm_ex), 2) AS net_charm, sum(ce_oi + pe_oi) AS total_oi_in_range,
    round((sum(abs(ce_oi_change)) + sum(abs(pe_oi_change))) / greatest(sum(ce_oi + pe_oi), 1), 4) AS oi_turnover_ratio, count(*) AS n_strikes,
    CASE WHEN max(g) > 0 THEN min(k) FILTER (g = top) END AS peak_pos_gamma_strike, CASE WHEN min(g) < 0 THEN min(k) FILTER (g = low) END AS
        peak_neg_gamma_strike,
    CASE WHEN sum(ce_oi + pe_oi) > 0 THEN round(sum(k * (ce_oi + pe_oi)) / sum(ce_oi + pe_oi), 2) END AS oi_com_inrange
  FROM (SELECT *, max(g) OVER w AS top, min(g) OVER w AS low FROM gam WINDOW w AS (PARTITION BY symbol, date, expiry_rank)) GROUP BY 1, 2, 3
), steps AS (
  SELECT symbol, date, expiry_rank, mid AS r, k, g, lead(k) OVER w AS k2, lead(g) OVER w AS g2 FROM gam WINDOW w AS (PARTITION BY symbol, date,
      expiry_rank ORDER BY k)
), crossings AS (
  SELECT *, CASE WHEN abs(g2 - g) < 1e-12 THEN k ELSE k - g * (k2 - k) / (g2 - g) END AS flip FROM steps WHERE sign(g) <> sign(g2)
), nearest AS (
  SELECT symbol, date, expiry_rank, round(flip, 2) AS gamma_flip, k2 - k AS transition_width
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date, expiry_rank ORDER BY abs(flip - r), k) AS n FROM crossings) WHERE n = 1
), gtot AS (
  SELECT symbol, date, expiry_rank, sum(abs(g)) AS gross, sum(g) AS net, min(g) AS lo, max(g) AS hi, count(*) AS n, avg(CASE WHEN g < 0 THEN 1.0 ELSE
      0.0 END) AS below,
    coalesce(max(g + (r - k) * (g2 - g) / (k2 - k)) FILTER (k <= r AND k2 > r), CASE WHEN max(r) < min(k) THEN arg_min(g, k) ELSE arg_max(g, k) END)
        AS here
  FROM steps GROUP BY 1, 2, 3
), flips AS (
  SELECT t.symbol, t.date, t.expiry_rank, gamma_flip, transition_width,
    (SELECT arg_min(k, abs(k - gamma_flip) * 1e6 + k / 1e6) FROM steps s WHERE s.symbol = t.symbol AND s.date = t.date AND s.expiry_rank =
        t.expiry_rank) AS flip_nearest,
    CASE WHEN n < 2 THEN 'insufficient' WHEN gamma_flip IS NULL AND lo >= 0 THEN 'all_positive' WHEN gamma_flip IS NULL AND hi <= 0 THEN
        'all_negative'
      WHEN abs(here) <= 0.05 * gross THEN 'mixed' WHEN here > 0 THEN 'positive' ELSE 'negative' END AS gex_regime,
    CASE WHEN gross > 1e-9 THEN round(net / gross, 4) ELSE 0 END AS net_gex_norm, round(below, 4) AS neg_gamma_fraction
  FROM gtot t LEFT JOIN nearest b ON t.symbol = b.symbol AND t.date = b.date AND t.expiry_rank = b.expiry_rank
), peak AS (
  SELECT symbol, date, expiry_rank, k AS pk, a AS pa, g AS pg FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date, expiry_rank ORDER BY a
      DESC, k) AS n2 FROM gam) WHERE n2 = 1 AND a > 0
), band AS (
  SELECT x.symbol, x.date, x.expiry_rank, k, a, pk, pa, pg, max(CASE WHEN a < pa * 0.5 AND k < pk THEN k END) OVER w AS lb, min(CASE WHEN a < pa * 0.5
      AND k > pk THEN k END) OVER w AS ub, sum(a) OVER w AS total
  FROM gam x JOIN peak p ON x.symbol = p.symbol AND x.date = p.date AND x.expiry_rank = p.expiry_rank WINDOW w AS (PARTITION BY x.symbol, x.date,
      x.expiry_rank)
), gshelf AS (
  SELECT symbol, date, expiry_rank, sum(k * a) / sum(a) AS center_exact, round(sum(k * a) / sum(a), 2) AS gamma_shelf_center, CAST(count(*) AS DOUBLE)
      AS gamma_shelf_width, max(pk) AS gamma_shelf_peak_strike,
    round(max(pg), 4) AS gamma_shelf_peak_value, round(max(pa) / max(total), 4) AS concentration
  FROM band WHERE (lb IS NULL OR k > lb) AND (ub IS NULL OR k < ub) GROUP BY 1, 2, 3
), joined AS (
  SELECT h.* EXCLUDE (i, em, fut, iv_smooth), fut AS f, em, iv_smooth, s.* EXCLUDE (symbol, date, expiry_rank), l.* EXCLUDE (symbol, date,
      expiry_rank), g.* EXCLUDE (symbol, date, expiry_rank),
    (gamma_shelf_center - oi_com_inrange) / nullif(em, 0) AS dd, CASE WHEN spot > 0 AND abs(fut - spot) >= 1e-9 THEN (fut - spot) / spot * 100 END AS
        pct
  FROM head h JOIN sums s USING (symbol, date, expiry_rank) JOIN flips l USING (symbol, date, expiry_rank) LEFT JOIN gshelf g USING (symbol, date,
      expiry_rank)
), stage1 AS (
  SELECT * EXCLUDE (f, em, iv_smooth, dd, pct, center_exact) REPLACE (CAST(dte AS INTEGER) AS dte, round(range_half, 9) AS range_half), round(f, 2) AS
      fut_price, round(iv_exact, 2) AS atm_iv, round(iv_smooth, 2) AS atm_iv_smoothed, round(em, 2) AS expected_move,
    round((gamma_flip - f) / em, 4) AS flip_norm_distance, round(transition_width / em, 4) AS transition_width_norm, round(dd, 4) AS
        dealer_divergence,
    CASE WHEN abs(dd) < 0.5 THEN 'aligned' WHEN abs(dd) < 1.5 THEN 'diverging' WHEN dd IS NOT NULL THEN 'strongly_diverging' END AS
        dealer_divergence_label,
    round(coalesce(iv_exact - lag(round(iv_exact, 2)) OVER w, 0), 2) AS iv_change, round(center_exact - lag(gamma_shelf_center) OVER w, 2) AS
        gamma_com_migration,
    CASE WHEN n_strikes >= 8 AND total_oi_in_range > 0 AND coalesce(nullif(round(transition_width / em, 4), 0), 1) < 0.5 THEN 'high' WHEN n_strikes >=
        4 THEN 'medium' ELSE 'low' END AS confidence,
    round(f - joined.range_half, 2) AS range_lo, round(f + joined.range_half, 2) AS range_hi, CASE WHEN pct IS NOT NULL THEN round(f - spot, 4) END AS
        basis, round(pct, 4) AS basis_pct,
    CASE WHEN dte > 0 AND abs(pct * 365 / dte) <= 60 THEN round(pct * 365 / dte, 3) END AS basis_annualized, CASE WHEN net_gex >= 0 THEN 'positive'
        ELSE 'negative' END AS net_gex_sign
  FROM joined WINDOW w AS (PARTITION BY symbol, expiry_rank ORDER BY date)
)"""

_STAGE2 = """
, lagged AS (
  SELECT *, lag(date) OVER w AS date0, lag(gamma_flip) OVER w AS flip0, lag(basis_annualized) OVER w AS basis0, lag(transition_width_norm, 2) OVER w
      AS tw2, lag(abs(flip_norm_distance), 2) OVER w AS fd2,
    lag(atm_iv_smoothed) OVER w AS iv0, lead(spot) OVER w AS spot1, lag(spot) OVER w AS spot0, lag(gamma_shelf_center) OVER w AS com0, lag(gex_regime)
        OVER w AS regime0,
    lag(transition_width_norm) OVER w AS tw0, lag(transition_width) OVER w AS width0, lag(neg_gamma_fraction) OVER w AS neg0,
    count(concentration) OVER five AS n5, stddev_samp(concentration) OVER five AS s5
  FROM stage1 WINDOW w AS (PARTITION BY symbol, expiry_rank ORDER BY date), five AS (PARTITION BY symbol, expiry_rank ORDER BY date ROWS BETWEEN 4
      PRECEDING AND CURRENT ROW)
), first_pass AS (
  SELECT *, round((gamma_flip - flip0) / greatest(date - date0, 1), 2) AS flip_velocity, round(basis_annualized - basis0, 3) AS basis_chg,
    coalesce(gex_regime IN ('positive', 'all_positive') AND transition_width_norm < tw2 AND abs(flip_norm_distance) < fd2 AND (iv0 IS NULL OR
        atm_iv_smoothed <= iv0), false) AS regime_compression,
    round((spot1 - spot) / nullif(spot, 0) * 100, 3) AS next_day_realized_move, round(abs((spot1 - spot) / nullif(spot, 0) * 100), 3) AS
        next_day_abs_move,
    abs((spot - spot0) / nullif(spot0, 0)) AS spot_pct, abs((gamma_shelf_center - com0) / nullif(com0, 0)) AS com_pct,
    CASE WHEN n5 >= 3 THEN round(1 - s5, 4) END AS concentration_stability
  FROM lagged
), released AS (
  SELECT *, coalesce(lag(regime_compression) OVER w AND NOT regime_compression AND iv_change > 0 AND gex_regime IN ('negative', 'all_negative') AND
      transition_width > width0, false) AS compression_release,
    CASE WHEN gex_regime IS NOT DISTINCT FROM regime0 THEN 0 ELSE 1 END AS new_r, CASE WHEN regime_compression IS NOT DISTINCT FROM
        lag(regime_compression) OVER w THEN 0 ELSE 1 END AS new_c
  FROM first_pass WINDOW w AS (PARTITION BY symbol, expiry_rank ORDER BY date)
), runs AS (
  SELECT *, sum(new_r) OVER w AS run_r, sum(new_c) OVER w AS run_c, max(CASE WHEN compression_release THEN date END) OVER w AS release_date
  FROM released WINDOW w AS (PARTITION BY symbol, expiry_rank ORDER BY date ROWS UNBOUNDED PRECEDING)
), numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol, expiry_rank, run_r ORDER BY date) AS INTEGER) AS days_in_regime,
    CASE WHEN regime_compression THEN CAST(row_number() OVER (PARTITION BY symbol, expiry_rank, run_c ORDER BY date) AS INTEGER) ELSE 0 END AS
        compression_days
  FROM runs
), stage2 AS (
  SELECT * EXCLUDE (date0, flip0, basis0, tw2, fd2, iv0, spot1, spot0, com0, regime0, tw0, width0, neg0, n5, s5, spot_pct, com_pct, new_r, new_c,
      run_r, run_c, release_date),
    CASE WHEN com_pct >= 0.0005 THEN round(spot_pct / com_pct, 3) END AS migration_effectiveness, CAST(date - release_date AS DOUBLE) AS
        days_since_release, days_in_regime - 1 AS days_since_flip,
    CASE WHEN date0 IS NULL THEN '' ELSE concat_ws(',',
      CASE WHEN regime0 IN ('positive', 'all_positive') AND gex_regime IN ('negative', 'all_negative') THEN 'regime_flip_to_neg' END,
      CASE WHEN regime0 IN ('negative', 'all_negative') AND gex_regime IN ('positive', 'all_positive') THEN 'regime_flip_to_pos' END,
      CASE WHEN abs(flip_norm_distance) < 1 AND expected_move * 0.25 > 0 AND flip_velocity <= -expected_move * 0.25 THEN 'flip_drift_down' END,
      CASE WHEN abs(flip_norm_distance) < 1 AND expected_move * 0.25 > 0 AND flip_velocity >= expected_move * 0.25 THEN 'flip_drift_up' END,
      CASE WHEN tw0 > 0 AND transition_width_norm < tw0 * 0.9 AND gex_regime IN ('positive', 'all_positive') THEN 'pin_strengthening' END,
      CASE WHEN neg_gamma_fraction - neg0 > 0.05 THEN 'instability_widening' END,
      CASE WHEN gex_regime IN ('negative', 'all_negative') AND coalesce(iv_change, 0) > 0 AND pe_vanna < 0 THEN 'crash_risk' END,
      CASE WHEN gex_regime IN ('positive', 'all_positive') AND ce_vanna > 0 AND coalesce(iv_change, 0) > 0 THEN 'bull_trend_reinforce' END,
      CASE WHEN gex_regime IN ('negative', 'all_negative') AND coalesce(iv_change, 0) < 0 AND pe_vanna < 0 THEN 'bear_trend_reinforce' END) END AS
          signals
  FROM numbered
)"""
STAGE2 = STAGE1 + _STAGE2
SIGNALS = STAGE2 + """
SELECT date, trim(signal) AS signal, count(*) AS n FROM (SELECT date, unnest(string_split(signals, ',')) AS signal FROM stage2 WHERE signals <> '')
    GROUP BY 1, 2"""
INDICATORS = STAGE2 + """
SELECT date, expiry_rank, CAST(sum(CASE WHEN regime_compression THEN 1 ELSE 0 END) AS BIGINT) AS compressing, CAST(sum(CASE WHEN compression_release
    THEN 1 ELSE 0 END) AS BIGINT) AS releasing FROM stage2 GROUP BY 1, 2"""
DEFENSE = STAGE1 + """
SELECT symbol, date, expiry_rank, CASE gex_regime WHEN 'all_positive' THEN 0 WHEN 'positive' THEN 1 WHEN 'mixed' THEN 2 WHEN 'negative' THEN 3 WHEN
    'all_negative' THEN 4 ELSE 99 END AS regime_order,
  CASE WHEN transition_width_norm IS NOT NULL THEN greatest(5, least(95, CASE WHEN transition_width_norm <= 0.15 THEN 31 WHEN transition_width_norm <=
      0.24 THEN 46 ELSE 58 END
    + CASE WHEN concentration > 0.37 THEN 4 WHEN concentration <= 0.27 THEN -4 ELSE 0 END
    + CASE WHEN gex_regime IN ('positive', 'all_positive') THEN 3 WHEN gex_regime IN ('negative', 'all_negative') THEN -4 ELSE 0 END)) END::DOUBLE AS
        hold
FROM stage1"""


def strength(first: str, last: str) -> str:
    return (
        STAGE2
        + f"""
, picked AS (
  SELECT *, lag(date) OVER w AS d0, lag(net_gex_norm) OVER w AS n0, lag(neg_gamma_fraction) OVER w AS g0, lag(atm_iv_smoothed) OVER w AS s0,
      lag(abs(flip_norm_distance)) OVER w AS f0, lag(gex_regime) OVER w AS r0,
    lag(transition_width_norm) OVER w AS t0, coalesce(abs(basis_pct) < 0.1, true) AS in_deadzone
  FROM stage2 WHERE expiry_rank = 0 AND date BETWEEN DATE '{first}' AND DATE '{last}' WINDOW w AS (PARTITION BY symbol, expiry_rank ORDER BY date)
), gaps2 AS (
  SELECT *, net_gex_norm - n0 AS x1, -(neg_gamma_fraction - g0) AS x2, -coalesce(iv_change, atm_iv_smoothed - s0) AS x3, abs(flip_norm_distance) - f0
      AS x4, -(transition_width_norm - t0) AS x6 FROM picked
), axes AS (
  SELECT *,
      {', '.join(f"CASE WHEN d0 IS NULL THEN 0 WHEN {x} > 1e-9 THEN 1 WHEN {x} < -1e-9 THEN -1 ELSE 0 END AS {name}" for x, name in (('x1', 'axis_lopsided'), ('x2', 'axis_neg_gamma'), ('x3', 'axis_iv'), ('x4', 'axis_flip'), ('x6', 'axis_trans_w')))},
    CASE WHEN d0 IS NULL OR gex_regime IS NULL OR r0 IS NULL THEN 0 WHEN gex_regime = r0 THEN 1 ELSE -1 END AS axis_regime
  FROM gaps2
)
SELECT symbol, date, basis_pct, in_deadzone, NOT in_deadzone AND coalesce(lag(in_deadzone) OVER w, true) AS left_deadzone, gex_regime, axis_lopsided,
    axis_neg_gamma, axis_iv, axis_flip, axis_regime, axis_trans_w,
  axis_lopsided + axis_neg_gamma + axis_iv + axis_flip + axis_regime + axis_trans_w AS strength,
  CAST(sum(axis_lopsided + axis_neg_gamma + axis_iv + axis_flip + axis_regime + axis_trans_w) OVER w AS BIGINT) AS strength_cum
FROM axes WINDOW w AS (PARTITION BY symbol ORDER BY date)"""
    )


def screener(day: str, view: str) -> str:
    if view == "dropped":
        return (
            STAGE2
            + f"""
, front AS (SELECT * FROM stage2 WHERE expiry_rank = 0), prev AS (SELECT symbol, signals AS prev_signals FROM front WHERE date = (SELECT max(date)
    FROM front WHERE date < DATE '{day}') AND signals <> '')
SELECT f.*, prev_signals FROM front f JOIN prev USING (symbol) WHERE date = DATE '{day}' AND signals = ''"""
        )
    where = " AND (signals <> '' OR regime_compression OR compression_release)" if view == "changed" else ""
    return STAGE2 + f" SELECT *, CAST(NULL AS VARCHAR) AS prev_signals FROM stage2 WHERE expiry_rank = 0 AND date = DATE '{day}'{where}"


def _flow_rows(min_volume: int = 0) -> str:
    """The tradeable rows with Greeks."""
    spread = "CASE WHEN {0}_ltp > 0 THEN {0}_bid_ask_spread / {0}_ltp * 100 ELSE 999 END <= 15"
    return f"""
, usable AS (
  SELECT * FROM ocdata WHERE (ce_oi >= 0 OR pe_oi >= 0) AND (ce_volume >= {min_volume} OR pe_volume >= {min_volume}) AND ({spread.format('ce')} OR
      {spread.format('pe')})
    AND (abs(ce_delta) > 0 AND ce_iv > 0 OR abs(pe_delta) > 0 AND pe_iv > 0)
)"""


def _bucket(x: str) -> str:
    return f"CASE WHEN abs({x}) >= 0.5 THEN 'DEEP_ITM' WHEN abs({x}) >= 0.3 THEN 'ATM' WHEN abs({x}) >= 0.15 THEN 'NEAR_OTM' WHEN abs({x}) >= 0.05 THEN 'FAR_OTM' ELSE 'DEEP_OTM' END"


_FLOWS = (
    _flow_rows()
    + f"""
, bounds AS (
  SELECT symbol, expiry, min(timestamp) AS t0, max(timestamp) AS t1 FROM usable GROUP BY 1, 2
), opening AS (
  SELECT u.symbol, u.expiry, strike_price, {_bucket('ce_delta')} AS c0, {_bucket('pe_delta')} AS p0 FROM usable u JOIN bounds b ON u.symbol = b.symbol
      AND u.expiry = b.expiry AND u.timestamp = t0
), tagged AS (
  SELECT u.*, coalesce(c0, 'DEEP_OTM') AS ce_open, coalesce(p0, 'DEEP_OTM') AS pe_open, {_bucket('ce_delta')} AS ce_now, {_bucket('pe_delta')} AS
      pe_now
  FROM usable u LEFT JOIN opening o ON u.symbol = o.symbol AND u.expiry = o.expiry AND u.strike_price = o.strike_price
), bucketed AS (
  SELECT symbol, expiry, ce_open AS bucket, timestamp, sum(ce_oi) AS ce_oi, sum(pe_oi) AS pe_oi, sum(ce_oi_change) AS ce_oi_change, sum(pe_oi_change)
      AS pe_oi_change, sum(ce_tbq) AS ce_tbq, sum(pe_tbq) AS pe_tbq,
    sum(net_vanna_ex) AS net_vanna_ex, sum(net_flow) AS net_flow, count(DISTINCT strike_price) AS strikes, CAST(sum(CASE WHEN ce_open <> ce_now OR
        pe_open <> pe_now THEN 1 ELSE 0 END) AS BIGINT) AS migrated,
    min(strike_price) AS min_strike, max(strike_price) AS max_strike
  FROM tagged GROUP BY 1, 2, 3, 4
), summed AS (
  SELECT *, sum(ce_oi_change) OVER w AS ce_cum_flow, sum(pe_oi_change) OVER w AS pe_cum_flow FROM bucketed WINDOW w AS (PARTITION BY symbol, expiry,
      bucket ORDER BY timestamp ROWS UNBOUNDED PRECEDING)
), speeds AS (
  SELECT *, ce_cum_flow - pe_cum_flow AS net_cum_flow, coalesce(ce_cum_flow - lag(ce_cum_flow) OVER w, 0) AS ce_velocity, coalesce(pe_cum_flow -
      lag(pe_cum_flow) OVER w, 0) AS pe_velocity
  FROM summed WINDOW w AS (PARTITION BY symbol, expiry, bucket ORDER BY timestamp)
), flow AS (
  SELECT *, coalesce(ce_velocity - lag(ce_velocity) OVER w, 0) AS ce_acceleration, coalesce(pe_velocity - lag(pe_velocity) OVER w, 0) AS
      pe_acceleration, CASE WHEN ce_oi > 0 THEN round(pe_oi / ce_oi, 3) END AS pcr
  FROM speeds WINDOW w AS (PARTITION BY symbol, expiry, bucket ORDER BY timestamp)
), spots AS (
  SELECT symbol, expiry, timestamp, avg(underlying_price) AS spot, max(days_to_expiry) AS dte FROM usable GROUP BY 1, 2, 3
), spans AS (
  SELECT symbol, expiry, arg_max(spot, timestamp) - arg_min(spot, timestamp) AS spot_chg, median(dte) AS dte FROM spots GROUP BY 1, 2
)"""
)
FLOW_BUCKETS = _FLOWS + " SELECT * FROM flow"
FLOW_SIGNALS = _FLOWS + """
, last_flow AS (
  SELECT f.*, spot_chg, dte, CASE WHEN ce_tbq + pe_tbq > 0 THEN (ce_tbq - pe_tbq) / (ce_tbq + pe_tbq) ELSE 0 END AS imb
  FROM flow f JOIN bounds b ON f.symbol = b.symbol AND f.expiry = b.expiry AND f.timestamp = t1 JOIN spans s ON s.symbol = f.symbol AND s.expiry =
      f.expiry
)
SELECT symbol, expiry, bucket, timestamp, round(spot_chg, 2) AS spot_chg, CASE WHEN dte <= 1 THEN 'expiry' WHEN dte <= 7 THEN 'short' WHEN dte <= 21
    THEN 'medium' ELSE 'long' END AS dte_regime,
  CASE WHEN ce_oi_change > 0 THEN CASE WHEN spot_chg > 0 THEN 'Long Build-Up' ELSE 'Short Build-Up' END WHEN ce_oi_change < 0 THEN CASE WHEN spot_chg
      > 0 THEN 'Short Covering' ELSE 'Long Unwinding' END ELSE 'Neutral' END AS ce_signal,
  CASE WHEN pe_oi_change > 0 THEN CASE WHEN spot_chg > 0 THEN 'Short Build-Up' ELSE 'Long Build-Up' END WHEN pe_oi_change < 0 THEN CASE WHEN spot_chg
      > 0 THEN 'Long Unwinding' ELSE 'Short Covering' END ELSE 'Neutral' END AS pe_signal,
  CASE WHEN ce_oi_change > 0 AND pe_oi_change > 0 AND imb > 0.2 THEN 'Speculative' WHEN pe_oi_change > 0 AND spot_chg > 0 THEN 'Hedging' WHEN
      ce_oi_change > 0 AND pe_oi_change < 0 AND imb > 0.1 THEN 'Squeeze Setup'
    WHEN pe_oi_change > 0 AND abs(pe_oi_change) > abs(ce_oi_change) * 3 THEN 'Panic Flow' WHEN abs(imb) < 0.05 AND abs(ce_oi_change + pe_oi_change) <
        100 THEN 'Dealer Positioning' ELSE 'Mixed' END AS flow_type,
  round(imb, 3) AS buy_imbalance, strikes, migrated, min_strike, max_strike, pcr
FROM last_flow"""
FLOW_CROSSING = _FLOWS + """
, shares AS (
  SELECT f.symbol, f.expiry, bucket, sum(CASE WHEN timestamp = t0 THEN ce_oi + pe_oi ELSE 0 END) AS a, sum(CASE WHEN timestamp = t1 THEN ce_oi + pe_oi
      ELSE 0 END) AS b
  FROM flow f JOIN bounds b ON f.symbol = b.symbol AND f.expiry = b.expiry WHERE t0 < t1 GROUP BY 1, 2, 3
), moved AS (
  SELECT *, abs(sum(b) OVER w - sum(a) OVER w) / nullif(sum(a) OVER w, 0) * 100 AS total, coalesce(b / nullif(sum(b) OVER w, 0), 0) * 100 - a /
      nullif(sum(a) OVER w, 0) * 100 AS share
  FROM shares WINDOW w AS (PARTITION BY symbol, expiry)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, expiry ORDER BY list_position(['DEEP_ITM', 'ATM', 'NEAR_OTM', 'FAR_OTM', 'DEEP_OTM'], bucket)) AS
      n FROM moved WHERE total <= 1 AND abs(share) >= 5
)
SELECT symbol, expiry, bucket, CASE WHEN share > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(share, 2) AS share_change, round(total,
    2) AS total_oi_chg FROM ranked WHERE n = 1"""
MIGRATED = _FLOWS + """
SELECT t.symbol, t.expiry, timestamp, strike_price, """ + ", ".join(f"round(abs({s}_delta), 3) AS {s}_delta, {s}_open, {s}_now, {s}_open <> {s}_now AS {s}_migrated, {s}_oi, {s}_oi_change" for s in ("ce", "pe")) + """
FROM tagged t JOIN bounds b ON t.symbol = b.symbol AND t.expiry = b.expiry AND t.timestamp = t1 WHERE ce_open <> ce_now OR pe_open <> pe_now"""


def divergence(as_of: str, intraday: bool = False) -> str:
    """Either the last two snapshots of live expiries, or the first and last of the last day."""
    times = (
        """, times AS (
  SELECT symbol, max(timestamp) AS now, min(timestamp) AS ref FROM ocdata WHERE CAST(timestamp AS DATE) = (SELECT max(CAST(timestamp AS DATE)) FROM
      ocdata) GROUP BY 1 HAVING min(timestamp) <> max(timestamp)
)"""
        if intraday
        else """, times AS (
  SELECT symbol, max(timestamp) AS now, min(timestamp) AS ref FROM (SELECT symbol, timestamp, dense_rank() OVER (PARTITION BY symbol ORDER BY
      timestamp DESC) AS rk FROM live) WHERE rk <= 2 GROUP BY 1 HAVING count(DISTINCT timestamp) = 2
)"""
    )
    means = "avg(underlying_price) AS spot, " + ", ".join(f"avg(CASE WHEN distance_from_atm = 0 THEN {c} END) AS {c}" for c in ("ce_ltp", "pe_ltp", "ce_iv", "pe_iv", "net_flow"))
    return f"""
, live AS (SELECT * FROM ocdata WHERE expiry >= DATE '{as_of}'), front AS (SELECT symbol, min(expiry) AS expiry FROM live GROUP BY 1){times}, snaps AS
    (
  SELECT o.symbol, o.timestamp, {means} FROM ocdata o JOIN front f ON o.symbol = f.symbol AND o.expiry = f.expiry GROUP BY 1, 2
), pairs AS (
  SELECT t.symbol, now, ref, n.spot AS spot_now, n.ce_ltp AS ce_now, n.pe_ltp AS pe_now, n.net_flow, (n.spot - b.spot) / b.spot * 100 AS s,
    CASE WHEN b.ce_ltp > 0 THEN (coalesce(n.ce_ltp, 0) - b.ce_ltp) / b.ce_ltp * 100 ELSE 0 END AS c, CASE WHEN b.pe_ltp > 0 THEN (coalesce(n.pe_ltp,
        0) - b.pe_ltp) / b.pe_ltp * 100 ELSE 0 END AS p,
    coalesce(n.ce_iv, 0) - coalesce(b.ce_iv, 0) AS ci, coalesce(n.pe_iv, 0) - coalesce(b.pe_iv, 0) AS pi
  FROM times t JOIN snaps n ON n.symbol = t.symbol AND n.timestamp = now JOIN snaps b ON b.symbol = t.symbol AND b.timestamp = ref WHERE b.spot > 0
), told AS (
  SELECT *, CASE WHEN abs(s) < 0.03 THEN CASE WHEN (abs(ci) + abs(pi)) / 2 >= 1 THEN 'IV_SPIKE' END WHEN s > 0.03 AND p > 0.5 THEN 'BULL_HEDGE' WHEN s
      < -0.03 AND c > 0.5 THEN 'BEAR_SQUEEZE'
    WHEN s > 0.03 AND c < -0.5 THEN 'SMART_SELL' WHEN s < -0.03 AND p < -0.5 THEN 'SMART_BUY' END AS signal FROM pairs
)
SELECT symbol, signal, round(CASE WHEN signal IN ('BULL_HEDGE', 'SMART_BUY') THEN abs(s) + abs(p) WHEN signal = 'IV_SPIKE' THEN (abs(ci) + abs(pi)) /
    2 ELSE abs(s) + abs(c) END, 3) AS magnitude,
  round(s, 3) AS spot_pct, round(c, 3) AS ce_pct, round(p, 3) AS pe_pct, round(ci, 3) AS ce_iv_chg, round(pi, 3) AS pe_iv_chg, round(spot_now, 2) AS
      spot_now, round(coalesce(ce_now, 0), 2) AS ce_ltp_now,
  round(coalesce(pe_now, 0), 2) AS pe_ltp_now, round(coalesce(net_flow, 0), 2) AS net_flow, strftime(now, '%Y-%m-%d %H:%M') AS ts_now, strftime(ref,
      '%Y-%m-%d %H:%M') AS ts_ref
FROM told WHERE signal IS NOT NULL ORDER BY magnitude DESC, symbol LIMIT 30"""


_USABLE = """
, usable AS (
  SELECT * FROM ocdata WHERE (ce_volume >= 100 OR pe_volume >= 100) AND (abs(ce_delta) > 0 AND ce_iv > 0 OR abs(pe_delta) > 0 AND pe_iv > 0)
)"""
EXPOSURE_LAYERS = _USABLE + """
, head AS (
  SELECT symbol, expiry, timestamp, median(underlying_price) AS spot, median(days_to_expiry) AS dte, median(lotsize) AS lot, coalesce(median(ce_iv)
      FILTER (ce_iv > 0), 0) AS iv FROM usable GROUP BY 1, 2, 3
), reach AS (
  SELECT *, least(CASE WHEN iv > 0 AND dte > 0 THEN spot * iv / 100 * sqrt(dte / 365) ELSE spot * 0.05 END + spot * 0.005, spot * 0.15) AS half FROM
      head
), gam AS (
  SELECT u.*, spot, strike_price AS k, (ce_gamma * ce_oi - pe_gamma * pe_oi) * lot AS g, strike_price BETWEEN spot - half AND spot + half AS near,
      ce_delta_oi_chg + pe_delta_oi_chg AS net
  FROM usable u JOIN reach r ON u.symbol = r.symbol AND u.expiry = r.expiry AND u.timestamp = r.timestamp
), near_rows AS (
  SELECT symbol, expiry, timestamp, k, g, lead(k) OVER w AS k2, lead(g) OVER w AS g2, row_number() OVER w AS place, count(*) OVER (PARTITION BY
      symbol, expiry, timestamp) AS n
  FROM gam WHERE near WINDOW w AS (PARTITION BY symbol, expiry, timestamp ORDER BY k)
), mid AS (
  SELECT symbol, expiry, timestamp, k AS r FROM near_rows WHERE place = n // 2 + 1
), crossings AS (
  SELECT s.symbol, s.expiry, s.timestamp, k, r, CASE WHEN abs(g2 - g) < 1e-12 THEN k ELSE k - g * (k2 - k) / (g2 - g) END AS f
  FROM near_rows s JOIN mid m ON s.symbol = m.symbol AND s.expiry = m.expiry AND s.timestamp = m.timestamp WHERE sign(g) <> sign(g2)
), flips AS (
  SELECT symbol, expiry, timestamp, round(f, 2) AS flip FROM (SELECT *, row_number() OVER (PARTITION BY symbol, expiry, timestamp ORDER BY abs(f - r),
      k) AS n FROM crossings) WHERE n = 1
), flips2 AS (
  SELECT f.symbol, f.expiry, f.timestamp, flip, arg_min(k, abs(k - flip) * 1e6 + k / 1e6) AS flip_strike
  FROM flips f JOIN near_rows s ON s.symbol = f.symbol AND s.expiry = f.expiry AND s.timestamp = f.timestamp GROUP BY 1, 2, 3, 4
), ranked AS (
  SELECT *, row_number() OVER (w ORDER BY near DESC, g DESC, k) AS top, row_number() OVER (w ORDER BY near DESC, g, k) AS low, row_number() OVER (w
      ORDER BY round(abs(net), 6) DESC, k) AS flow_place,
    row_number() OVER (w ORDER BY round(abs(net_vanna_ex), 6) DESC, k) AS vanna_place, sum(k * abs(net)) OVER w / nullif(sum(abs(net)) OVER w, 0) AS
        center
  FROM gam WINDOW w AS (PARTITION BY symbol, expiry, timestamp)
), sums AS (
  SELECT symbol, expiry, timestamp, max(spot) AS spot, round(sum(g) / 1e6, 6) AS total_gex,
    max(k) FILTER (top = 1 AND near AND g > 0) AS peak_pos_strike, max(round(g / 1e6, 6)) FILTER (top = 1 AND near AND g > 0) AS peak_pos_gex,
    max(k) FILTER (low = 1 AND near AND g < 0) AS peak_neg_strike, max(round(g / 1e6, 6)) FILTER (low = 1 AND near AND g < 0) AS peak_neg_gex,
    round(sum(ce_delta_oi_chg) + sum(pe_delta_oi_chg), 2) AS net_delta_flow, round(sum(ce_delta_oi_chg), 2) AS ce_delta_flow,
        round(sum(pe_delta_oi_chg), 2) AS pe_delta_flow,
    round(coalesce(max(center), max(spot)), 1) AS centroid, CASE WHEN max(center) IS NULL THEN max(spot) ELSE max(k) FILTER (flow_place = 1) END AS
        rotation_peak,
    CASE WHEN max(center) IS NULL THEN max(spot) ELSE arg_min(k, round(abs(k - center), 9) * 1e6 + k / 1e6) END AS rotation_nearest,
    round(sum(net_vanna_ex), 2) AS net_vanna, max(k) FILTER (vanna_place = 1) AS vanna_peak, max(round(net_vanna_ex, 2)) FILTER (vanna_place = 1) AS
        vanna_peak_value
  FROM ranked GROUP BY 1, 2, 3
), moved AS (
  SELECT s.*, flip, flip_strike, round(flip - lag(flip) OVER w, 1) AS flip_change, round(total_gex - lag(total_gex) OVER w, 6) AS gex_change,
      round(net_vanna - lag(net_vanna) OVER w, 2) AS vanna_change, round(spot - lag(spot) OVER w, 2) AS spot_change
  FROM sums s LEFT JOIN flips2 f ON s.symbol = f.symbol AND s.expiry = f.expiry AND s.timestamp = f.timestamp WINDOW w AS (PARTITION BY s.symbol,
      s.expiry ORDER BY s.timestamp)
)
SELECT *, CASE WHEN abs(gex_change) < abs(coalesce(nullif(total_gex, 0), 1)) * 0.15 AND abs(vanna_change) > abs(coalesce(nullif(net_vanna, 0), 1)) *
    0.2 THEN 'fragile_pin'
    WHEN abs(gex_change) > abs(coalesce(nullif(total_gex, 0), 1)) * 0.3 THEN 'gamma_shift' END AS gamma_vanna,
  CASE WHEN gex_change IS NOT NULL AND abs(net_delta_flow) > 100 AND total_gex > 0 THEN 'coiled_spring' END AS delta_gamma,
  CASE WHEN net_delta_flow > 0 AND spot_change < 0 THEN 'bullish_accumulation' WHEN net_delta_flow < 0 AND spot_change > 0 THEN 'bearish_distribution'
      END AS delta_price
FROM moved"""
EXPOSURE_PROFILES = _USABLE + """
SELECT symbol, expiry, timestamp, strike_price, round(net_gexv / 1e6, 6) AS net_gex, round(ce_gamma * ce_oi * lotsize / 1e6, 6) AS ce_gex,
    round(pe_gamma * pe_oi * lotsize / 1e6, 6) AS pe_gex,
  round(ce_delta_oi_chg, 2) AS ce_delta_flow, round(pe_delta_oi_chg, 2) AS pe_delta_flow, round(net_vanna_ex, 2) AS net_vanna
FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol, expiry ORDER BY timestamp DESC) AS rk FROM usable) WHERE rk <= 2"""


def eod_rows(as_of: str) -> str:
    return f"""
, last_ts AS (
  SELECT symbol, expiry, CAST(timestamp AS DATE) AS date, strike_price, max(timestamp) AS ts FROM ocdata WHERE strftime(timestamp, '%H:%M') <= '15:30' AND
      expiry >= DATE '{as_of}' GROUP BY 1, 2, 3, 4
)
SELECT o.symbol, o.expiry, o.timestamp, date, o.strike_price, ce_oi, pe_oi, ce_ltp FROM ocdata o JOIN last_ts l ON o.symbol = l.symbol AND
    o.expiry = l.expiry AND o.strike_price = l.strike_price AND o.timestamp = l.ts"""


def end_of_day(as_of: str) -> str:
    """The chain with one snapshot a day, of the five days up to a symbol's last one, as `eod`."""
    return f"""
, last_ts AS (
  SELECT symbol, expiry, strike_price, CAST(timestamp AS DATE) AS date, max(timestamp) AS ts FROM ocdata WHERE strftime(timestamp, '%H:%M') <= '15:30' AND expiry >= DATE '{as_of}' GROUP BY ALL
), ends AS (SELECT symbol, CAST(max(timestamp) AS DATE) AS final FROM ocdata GROUP BY 1), eod AS (
  SELECT o.* REPLACE (CAST(date AS TIMESTAMP) AS timestamp) FROM ocdata o JOIN last_ts l ON o.symbol = l.symbol AND o.expiry = l.expiry AND o.strike_price = l.strike_price AND o.timestamp = l.ts
    JOIN ends e ON e.symbol = o.symbol WHERE date >= final - 5
)"""


INTRADAY_OI = """
, today AS (
  SELECT o.* FROM ocdata o JOIN (SELECT symbol, CAST(max(timestamp) AS DATE) AS day FROM ocdata GROUP BY 1) m ON o.symbol = m.symbol AND
      CAST(timestamp AS DATE) = day WHERE ce_ltp + pe_ltp > 0
), means AS (SELECT symbol, expiry, avg(underlying_price) AS mean FROM today GROUP BY 1, 2)
SELECT t.symbol, t.expiry, strftime(timestamp, '%H:%M') AS time, strike_price, ce_oi, pe_oi, ce_oi_change, pe_oi_change, underlying_price AS spot
FROM today t JOIN means m ON t.symbol = m.symbol AND t.expiry = m.expiry WHERE mean <= 0 OR strike_price BETWEEN mean * (1 - 10.0 / 100) AND mean * (1
    + 10.0 / 100)"""


def quarter_delta(keys: str, rows: str) -> str:
    """(keys, rr): volatility of the put whose delta is nearest to minus a quarter less that of the call nearest to a quarter."""
    side = lambda s, sign: f"arg_min({s}_iv, struct_pack(d := round(abs(abs({s}_delta) - 0.25), 9), k := strike_price)) FILTER ({sign}{s}_delta > 0 AND {s}_iv > 0)"
    return f"SELECT {keys}, {side('pe', '-')} - {side('ce', '')} AS rr FROM {rows} GROUP BY ALL"


RISK_REVERSALS = f", r AS ({quarter_delta('symbol, expiry, timestamp', 'ocdata')}) SELECT symbol, expiry, timestamp, round(rr, 4) AS risk_reversal FROM r"
WEIGHTED_SIDES = """round(sum(ce_iv * ce_oi) / nullif(sum(ce_oi), 0), 4) AS ce_iv, round(sum(pe_iv * pe_oi) / nullif(sum(pe_oi), 0), 4) AS pe_iv,
  round(sum(ce_iv * ce_oi + pe_iv * pe_oi) / nullif(sum(ce_oi + pe_oi), 0), 4) AS iv, sum(ce_oi + pe_oi) AS oi"""
_LATEST = ", last AS (SELECT o.* FROM ocdata o JOIN (SELECT symbol, max(timestamp) AS ts FROM ocdata GROUP BY 1) m ON o.symbol = m.symbol AND o.timestamp = m.ts)"
WEIGHTED_IV_OVERALL = _LATEST + f" SELECT symbol, {WEIGHTED_SIDES} FROM last WHERE ce_iv > 0 GROUP BY 1"
STRIKE_GAMMA = _LATEST + " SELECT symbol, expiry, strike_price, round(ce_gamma * ce_oi * lotsize / 1e6, 6) AS ce_gex, round(-(pe_gamma * pe_oi * lotsize / 1e6), 6) AS pe_gex, round(net_gexv / 1e6, 6) AS net_gex FROM last"
MAGNET = _LATEST + """
, m AS (SELECT symbol, expiry, timestamp, min(strike_price) AS lo, max(strike_price) AS hi FROM last GROUP BY 1, 2, 3), l AS (SELECT m.*, i AS level,
    lo + (hi - lo) * i / 199 AS price FROM m, range(200) t(i)),
n AS (
  SELECT l.symbol, l.expiry, l.timestamp, price, ce_gamma * ce_oi * lotsize / 1e9 + -pe_gamma * pe_oi * lotsize / 1e9 AS total, row_number() OVER
      (PARTITION BY l.symbol, l.expiry, level ORDER BY round(abs(strike_price - price), 9), strike_price) AS k
  FROM l JOIN last o ON l.symbol = o.symbol AND l.expiry = o.expiry
), t AS (SELECT *, max(total) OVER (PARTITION BY symbol, expiry, timestamp) AS most FROM n WHERE k = 1)
SELECT symbol, expiry, timestamp, min(price) AS lower, max(price) AS upper, min(price) FILTER (total = most) AS center, max(most) AS strength FROM t
    WHERE most > 0 AND total >= 0.75 * most GROUP BY 1, 2, 3"""
DEALER_DIVERGENCE = """
, s AS (SELECT symbol, expiry, timestamp, strike_price AS k, abs(net_gexv) AS a, row_number() OVER (PARTITION BY symbol, expiry, timestamp ORDER BY
    abs(net_gexv) DESC, strike_price) AS n FROM ocdata),
p AS (SELECT symbol, expiry, timestamp, k AS pk, a AS pa FROM s WHERE n = 1 AND a > 0),
j AS (
  SELECT s.*, max(CASE WHEN a < pa * 0.5 AND k < pk THEN k END) OVER w AS lb, min(CASE WHEN a < pa * 0.5 AND k > pk THEN k END) OVER w AS ub
  FROM s JOIN p ON s.symbol = p.symbol AND s.expiry = p.expiry AND s.timestamp = p.timestamp WINDOW w AS (PARTITION BY s.symbol, s.expiry,
      s.timestamp)
), shelf AS (SELECT symbol, expiry, timestamp, round(sum(k * a) / sum(a), 2) AS center FROM j WHERE (lb IS NULL OR k > lb) AND (ub IS NULL OR k < ub)
    GROUP BY 1, 2, 3),
oi AS (SELECT symbol, expiry, timestamp, round(sum(strike_price * (ce_oi + pe_oi)) / sum(ce_oi + pe_oi), 2) AS com,
    nullif(max(expected_move_theoretical), 0) AS move FROM ocdata GROUP BY 1, 2, 3),
g AS (SELECT s.symbol, s.expiry, s.timestamp, (center - com) / move AS gap FROM shelf s JOIN oi o ON s.symbol = o.symbol AND s.expiry = o.expiry AND
    s.timestamp = o.timestamp)
SELECT symbol, expiry, timestamp, round(gap, 4) AS gap, CASE WHEN gap IS NULL THEN NULL WHEN abs(gap) < 0.5 THEN 'aligned' WHEN abs(gap) < 1.5 THEN
    'diverging' ELSE 'strongly_diverging' END AS label FROM g"""
SHORT_HISTORY = STAGE2 + """
, span AS (SELECT max(date) AS d FROM stage2 WHERE expiry_rank = 0)
SELECT gex_regime, CASE gex_regime WHEN 'all_positive' THEN 0 WHEN 'positive' THEN 1 WHEN 'mixed' THEN 2 WHEN 'negative' THEN 3 WHEN 'all_negative'
    THEN 4 ELSE 99 END AS place,
  CASE gex_regime WHEN 'all_positive' THEN '#0c8f4d' WHEN 'positive' THEN '#10b981' WHEN 'mixed' THEN '#9ca3af' WHEN 'negative' THEN '#f59e0b' WHEN
      'all_negative' THEN '#dc2626' ELSE '#3d5270' END AS color, count(*) AS days
FROM stage2, span WHERE expiry_rank = 0 AND date BETWEEN d - 7 AND d GROUP BY 1"""


def _grouped(x: str, digits: int) -> str:
    """A number with commas after three digits and then after two, below a thousand million."""
    whole = f"CAST(floor(round(abs({x}), {digits}) / 1000) AS BIGINT)"
    head = f"CASE WHEN {whole} >= 100 THEN CAST({whole} // 100 AS VARCHAR) || ',' || lpad(CAST({whole} % 100 AS VARCHAR), 2, '0') ELSE CAST({whole} AS VARCHAR) END"
    plain = f"printf('%.{digits}f', round(abs({x}), {digits}))"
    tail = f"right({plain}, {3 + (digits + 1 if digits else 0)})"
    return f"CASE WHEN round({x}, {digits}) < 0 THEN '-' ELSE '' END || CASE WHEN round(abs({x}), {digits}) >= 1000 THEN {head} || ',' || {tail} ELSE {plain} END"


NARRATIVES = STAGE2 + f"""
, told AS (
  SELECT *, (gamma_shelf_center - fut_price) / nullif(expected_move, 0) AS d, abs(gamma_com_migration) / nullif(expected_move, 0) AS a,
    CASE WHEN transition_width_norm IS NOT NULL THEN greatest(5, least(95, CASE WHEN transition_width_norm <= 0.15 THEN 31 WHEN transition_width_norm <= 0.24 THEN 46 ELSE 58 END
      + CASE WHEN concentration > 0.37 THEN 4 WHEN concentration <= 0.27 THEN -4 ELSE 0 END
      + CASE WHEN gex_regime IN ('positive', 'all_positive') THEN 3 WHEN gex_regime IN ('negative', 'all_negative') THEN -4 ELSE 0 END)) END AS hold
  FROM stage2
)
SELECT symbol, date, expiry_rank, round(d, 4) AS center_distance,
  CASE WHEN d IS NULL THEN '—' ELSE
    CASE WHEN abs(d) <= 0.25 THEN 'Defending at-the-money (COM ≈ price)' ELSE 'Support stacked ' || CASE WHEN d > 0 THEN 'above (COM +' ELSE 'below (COM −' END || printf('%.2f', abs(d)) || ' EM)' END
    || CASE WHEN dealer_divergence_label IS NOT NULL AND oi_com_inrange IS NOT NULL THEN ' · γ-COM vs OI-COM ' || {_grouped('oi_com_inrange', 0)} || ': '
      || CASE dealer_divergence_label WHEN 'aligned' THEN 'OI-confirmed' WHEN 'diverging' THEN 'OI-diverging' ELSE 'OI strongly diverging' END ELSE '' END END AS positioning,
  CASE WHEN concentration IS NULL THEN '—' WHEN concentration > 0.37 THEN 'Concentrated' WHEN concentration > 0.27 THEN 'Moderate' ELSE 'Diffuse' END || ', '
    || CASE WHEN net_gex_norm > 0.29 THEN 'call-heavy' WHEN net_gex_norm < -0.29 THEN 'put-heavy' ELSE 'balanced' END
    || CASE WHEN gamma_shelf_width = 1 AND concentration > 0.37 AND gamma_shelf_peak_strike IS NOT NULL THEN ' · single-strike pin at ' || {_grouped('gamma_shelf_peak_strike', 0)} ELSE '' END AS distribution,
  CASE WHEN a < 0.25 THEN 'Stable' WHEN a <= 0.75 THEN 'Drifting' WHEN a > 0.75 THEN 'Repositioning' WHEN gamma_com_migration = 0 THEN 'Stable' ELSE '—' END
    || CASE WHEN a >= 0.25 THEN CASE WHEN gamma_com_migration > 0 THEN ' up' ELSE ' down' END ELSE '' END
    || CASE WHEN days_in_regime IS NOT NULL THEN ' (' || CAST(days_in_regime AS VARCHAR) || 'd in regime)' ELSE '' END
    || CASE WHEN abs(basis_chg) >= 16.3 THEN CASE WHEN basis_chg > 0 THEN ' · basis widening' ELSE ' · basis compressing' END ELSE '' END AS change,
  CAST(hold AS DOUBLE) AS hold_probability, CASE WHEN hold IS NULL THEN NULL WHEN hold < 40 THEN 'Low' WHEN hold <= 55 THEN 'Moderate' ELSE 'High' END AS hold_bucket,
  CASE WHEN oi_turnover_ratio IS NULL THEN NULL WHEN oi_turnover_ratio < 0.05 THEN 'stale' WHEN oi_turnover_ratio > 1 THEN 'thin' WHEN oi_turnover_ratio > 0.5 THEN 'high' ELSE 'healthy' END AS turnover_band,
  CASE WHEN migration_effectiveness IS NULL THEN NULL WHEN migration_effectiveness >= 2.5 THEN 'outrunning' WHEN migration_effectiveness >= 1.6 THEN 'ahead'
    WHEN migration_effectiveness <= 0.4 THEN 'anticipatory' ELSE 'orderly' END AS migration_band
FROM told"""


def change_summary(first: str, last: str, metrics: dict[str, str]) -> str:
    """metrics names each metric's kind: pct, delta or state."""

    def told(m: str, kind: str) -> str:
        if kind == "state":
            a, b = (f"coalesce(regexp_replace(CAST({x}.{m} AS VARCHAR), '^([^_]*)_', '\\1 '), '—')" for x in "ab")
            return f"CASE WHEN {a} = {b} THEN {b} ELSE {a} || ' → ' || {b} END"
        moved = f"((b.{m} - a.{m}) / nullif(abs(a.{m}), 0) * 100)" if kind == "pct" else f"(b.{m} - a.{m})"
        digits, unit = (1, "%") if kind == "pct" else (3, "")
        return f"coalesce(CASE WHEN {moved} > 0 THEN '+' ELSE '' END || {_grouped(moved, digits)} || '{unit}', '—')"

    rows = " UNION ALL ".join(f"SELECT a.symbol, '{m}' AS metric, {told(m, kind)} AS change FROM ends_a a JOIN ends_b b USING (symbol)" for m, kind in metrics.items())
    return (
        STAGE2
        + f"""
, span AS (SELECT *, min(date) OVER (PARTITION BY symbol) AS d0, max(date) OVER (PARTITION BY symbol) AS d1 FROM stage2 WHERE expiry_rank = 0 AND date BETWEEN DATE '{first}' AND DATE '{last}'),
ends_a AS (SELECT * FROM span WHERE date = d0), ends_b AS (SELECT * FROM span WHERE date = d1)
{rows}"""
    )

_SAME = "symbol, expiry, timestamp"
#: Clusters of calls as `clusters`: smoothed rows, peaks by runs of equal values, kept in order of height, their prominence and skirts by joins.
CLUSTERS = f""", cw AS (SELECT {_SAME}, strike_price AS k, coalesce(ce_time_value * ce_oi, 0) AS w FROM ocdata),
cn AS (SELECT *, row_number() OVER l - 1 AS i, count(*) OVER (PARTITION BY {_SAME}) AS n, (coalesce(lag(w) OVER l, w) + w + coalesce(lead(w) OVER l, w)) / 3 AS y3 FROM cw WINDOW l AS (PARTITION BY {_SAME} ORDER BY k, w)),
co AS (SELECT {_SAME}, k, w, i, n, CASE WHEN n >= 3 THEN y3 ELSE w END AS y FROM cn),
ch AS (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY {_SAME} ORDER BY i) THEN 0 ELSE 1 END AS new FROM co),
run AS (SELECT {_SAME}, no, min(i) AS b, max(i) AS e, min(y) AS y FROM (SELECT *, sum(new) OVER (PARTITION BY {_SAME} ORDER BY i) AS no FROM ch) GROUP BY ALL),
mid AS (SELECT {_SAME}, (b + e) // 2 AS i, y FROM (SELECT *, lag(y) OVER r AS py, lead(y) OVER r AS ny FROM run WINDOW r AS (PARTITION BY {_SAME} ORDER BY no)) WHERE py < y AND ny < y),
cand AS (SELECT *, row_number() OVER (PARTITION BY {_SAME} ORDER BY y DESC, i DESC) AS pr FROM mid),
lad AS (SELECT {_SAME}, max(n) AS n, max(y) AS most, sum(w) AS total, arg_max(i, struct_pack(y := y, i := -i)) AS highest FROM co GROUP BY ALL HAVING max(n) >= 3 AND sum(w) <> 0),
greedy AS (WITH RECURSIVE g AS (SELECT {_SAME}, n, CAST(0 AS BIGINT) AS pr, CAST([] AS BIGINT[]) AS kept FROM lad
  UNION ALL SELECT g.symbol, g.expiry, g.timestamp, g.n, c.pr, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - c.i) < greatest(g.n // 20, 1))) > 0 THEN g.kept ELSE list_append(g.kept, c.i) END
  FROM g JOIN cand c ON c.symbol = g.symbol AND c.expiry = g.expiry AND c.timestamp = g.timestamp AND c.pr = g.pr + 1)
  SELECT {_SAME}, unnest(arg_max(kept, pr)) AS i FROM g GROUP BY {_SAME}),
hi AS (SELECT {_SAME}, p.i, p.y, max(CASE WHEN o.i < p.i AND o.y > p.y THEN o.i END) AS lh, min(CASE WHEN o.i > p.i AND o.y > p.y THEN o.i END) AS rh, max(o.y) AS most FROM (SELECT * FROM greedy JOIN mid USING ({_SAME}, i)) p JOIN co o USING ({_SAME}) GROUP BY {_SAME}, p.i, p.y),
prom AS (SELECT {_SAME}, h.i FROM hi h JOIN co o USING ({_SAME}) GROUP BY {_SAME}, h.i, h.y, h.most
  HAVING h.y - greatest(min(CASE WHEN o.i > coalesce(h.lh, -1) AND o.i <= h.i THEN o.y END), min(CASE WHEN o.i >= h.i AND o.i < coalesce(h.rh, 1000000000) THEN o.y END)) >= h.most * 10.0 / 100),
tops AS (SELECT * FROM prom UNION ALL SELECT {_SAME}, highest FROM lad ANTI JOIN prom USING ({_SAME})),
lim AS (SELECT {_SAME}, t.i, o.y, coalesce((lag(t.i) OVER s + t.i) // 2, 0) AS l, coalesce((t.i + lead(t.i) OVER s) // 2, o.n - 1) AS r, o.k AS peak FROM tops t JOIN co o USING ({_SAME}, i) WINDOW s AS (PARTITION BY {_SAME} ORDER BY t.i)),
skirt AS (SELECT m.symbol, m.expiry, m.timestamp, m.i, m.peak, greatest(m.l, max(CASE WHEN o.i >= m.l AND o.i < m.i THEN o.i END) + 1) AS lo, least(m.r, min(CASE WHEN o.i > m.i AND o.i <= m.r THEN o.i END) - 1) AS hi
  FROM lim m LEFT JOIN co o ON o.symbol = m.symbol AND o.expiry = m.expiry AND o.timestamp = m.timestamp AND o.y < m.y / 10 GROUP BY m.symbol, m.expiry, m.timestamp, m.i, m.peak, m.l, m.r),
cluster AS (SELECT {_SAME}, round(sum(o.k * o.w) / sum(o.w), 1) AS center_strike, s.peak AS peak_strike, min(o.k) AS min_strike, max(o.k) AS max_strike, round(sum(o.w), 2) AS weight,
  round(list_sum(list_reverse_sort(list(o.w))[1:3]) / sum(o.w), 4) AS concentration, count(*) AS members FROM skirt s JOIN co o USING ({_SAME}) WHERE o.i BETWEEN s.lo AND s.hi GROUP BY {_SAME}, s.i, s.peak HAVING sum(o.w) > 0)"""
#: Their tracks: links to the nearest cluster of the time before, and tracks handed on from there.
TRACKS = CLUSTERS + f""", spot AS (SELECT {_SAME}, max(underlying_price) AS spot FROM ocdata GROUP BY ALL),
num AS (SELECT {_SAME}, center_strike, weight, spot, row_number() OVER (PARTITION BY symbol, expiry ORDER BY timestamp, center_strike, weight) AS id, dense_rank() OVER (PARTITION BY symbol, expiry ORDER BY timestamp) AS t FROM cluster JOIN spot USING ({_SAME})),
link AS (SELECT a.symbol, a.expiry, a.id, b.id AS up, a.weight - b.weight AS gained FROM num a JOIN num b ON a.symbol = b.symbol AND a.expiry = b.expiry AND a.t = b.t + 1 AND abs(a.center_strike - b.center_strike) < a.spot * 2.0 / 100
  QUALIFY row_number() OVER (PARTITION BY a.symbol, a.expiry, a.id ORDER BY abs(a.center_strike - b.center_strike), b.id) = 1),
led AS (WITH RECURSIVE w AS (SELECT symbol, expiry, id, id AS root FROM num ANTI JOIN link USING (symbol, expiry, id)
  UNION ALL SELECT l.symbol, l.expiry, l.id, w.root FROM w JOIN link l ON l.symbol = w.symbol AND l.expiry = w.expiry AND l.up = w.id) SELECT * FROM w),
named AS (SELECT n.*, gained, dense_rank() OVER (PARTITION BY symbol, expiry ORDER BY root) AS track, max(t) OVER (PARTITION BY symbol, expiry) AS ends FROM num n JOIN led USING (symbol, expiry, id) LEFT JOIN link USING (symbol, expiry, id))
SELECT symbol, expiry, timestamp, center_strike, weight, track, CASE WHEN t < ends AND NOT EXISTS (SELECT 1 FROM named m WHERE m.symbol = n.symbol AND m.expiry = n.expiry AND m.track = n.track AND m.t = n.t + 1) THEN 'DISSOLVED' WHEN gained IS NOT NULL THEN 'TRACKED' ELSE 'EMERGING' END AS status,
  coalesce(gained, 0) AS velocity FROM named n"""
