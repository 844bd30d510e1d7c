import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ladderlake.functions import narratives as N
from ladderlake.operators import gamma_page, ladder
from ladderlake.sources import ocdata

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x, kind="double"):
    return F.lit(x).cast(kind)


@pytest.fixture(scope="module")
def analysed(spark):
    chain = ocdata.latest(ocdata.chain(spark, SF), "symbol").withColumns({"ce_gamma": F.col("ce_gamma") * 1e4, "pe_gamma": F.col("pe_gamma") * 1e4})
    found = {(r.symbol, r.expiry): r for r in gamma_page.gamma_analysis(chain, levels=60).collect()}
    return found, chain.toPandas()


def test_boundaries_against_walk(analysed):
    found, chain = analysed
    assert len(found) == len(chain[["symbol", "expiry"]].drop_duplicates()) > 4
    for key, rows in chain.groupby(["symbol", "expiry"]):
        got, rows = found[key], rows.sort_values("strike_price")
        spot, fut, dte = rows.underlying_price.max(), rows.fut_price.max(), rows.days_to_expiry.max()
        near = sorted((abs(k - a), k, iv) for k, a, iv in zip(rows.strike_price, rows.atm_strike, rows.ce_iv))[:2]
        half = min(fut * near[0][2] / 100 * math.sqrt(dte / 365) + fut * 0.005, fut * 0.15)
        rungs = [(k, (c * co - p * po) * lot / 1e9) for k, c, co, p, po, lot in zip(rows.strike_price, rows.ce_gamma, rows.ce_oi, rows.pe_gamma, rows.pe_oi, rows.lotsize)]
        walk = [min(rungs, key=lambda r: (round(abs(r[0] - (fut - half + 2 * half * i / 59)), 9), r[0])) for i in range(60)]
        g = [x for _, x in walk]
        top = g.index(max(g))
        upper = next((walk[i][0] for i in range(top + 3, 60) if sum(g[i - 3 : i + 1]) / 4 <= 0.6 * g[top]), None)
        falls = [(g[i] - g[i - 3], i) for i in range(3, 60) if got.gamma_flip is not None and walk[i][0] < got.gamma_flip]
        lower = walk[min(falls)[1]][0] if falls else None
        assert (got.upper_boundary, got.lower_boundary) == (upper, lower), key
        zone = [k for k, x in walk if g[top] > 0 and x >= 0.75 * g[top]]
        assert (got.magnet_lower, got.magnet_upper) == ((min(zone), max(zone)) if zone else (None, None))
        at_spot = min((abs(k - spot), i) for i, (k, _) in enumerate(walk))[1]
        scale = 1 / math.sqrt(1 + 0.1 * abs(g[at_spot]))
        assert abs(got.gamma_adj_atr - got.atr * scale) <= 0.0051 and abs(got.atr - spot * 0.12 / math.sqrt(252)) <= 0.0051
        assert abs(got.expected_range - spot * sum(n[2] for n in near) / 2 / 100 / math.sqrt(252) * scale) <= 0.0051
        positive = got.gamma_flip is None or fut >= got.gamma_flip
        assert got.regime == (gamma_page.POSITIVE_GAMMA if positive else gamma_page.NEGATIVE_GAMMA)
        assert (gamma_page.NO_CONDORS in got.warnings) != positive and (gamma_page.NO_STRADDLES in got.warnings) == positive
        assert (got.pin_lower is not None) == (positive and dte <= 10 and bool(zone))


def test_structures_follow_the_regime(analysed):
    for r in analysed[0].values():
        if r.regime == gamma_page.POSITIVE_GAMMA and r.magnet_center is not None and abs(r.spot - r.magnet_center) <= round(r.gamma_adj_atr):
            assert [x.split(" ")[0] for x in r.structures] == ["Short", "Iron"]
        if r.regime == gamma_page.NEGATIVE_GAMMA:
            assert all(x.startswith(("Call Ratio", "Put Back")) for x in r.structures)


def test_empty_and_null_ladders(spark):
    chain = ocdata.chain(spark, SF)
    assert gamma_page.gamma_analysis(chain.limit(0)).count() == 0
    first = ocdata.latest(chain, "symbol").filter("symbol = 'ITC'").withColumns({"m_volatility": lit(None), "ce_iv": lit(None)})
    for r in gamma_page.gamma_analysis(first).collect():
        assert r.atr is None and r.bullish_break is None and r.expected_range is None


def test_true_range(spark):
    bars = [("A", dt.date(2024, 1, d), 10.0 + d, 9.0 + d, 9.5 + d) for d in range(1, 20)]
    x = {r.date.day: r.atr for r in gamma_page.true_range(spark.createDataFrame(bars, "symbol string, date date, high double, low double, close double")).collect()}
    assert x[13] is None and x[14] == pytest.approx((1 + 13 * 1.5) / 14) and x[19] == pytest.approx(1.5)


def test_words(spark):
    assert one(spark, N.positioning(lit(110), lit(100), lit(20), F.lit("diverging"), lit(1234567))) == ("Support stacked above (COM +0.50 EM) · γ-COM vs OI-COM 12,34,567: OI-diverging",)
    assert one(spark, N.positioning(lit(101), lit(100), lit(20), lit(None, "string"), lit(1)), N.positioning(lit(1), lit(None), lit(2), F.lit("x"), lit(1))) == ("Defending at-the-money (COM ≈ price)", "—")
    assert one(spark, N.distribution(lit(0.5), lit(-0.4), F.lit(1), lit(45000)), N.distribution(lit(None), lit(None), F.lit(2), lit(None))) == ("Concentrated, put-heavy · single-strike pin at 45,000", "—, balanced")
    assert one(spark, N.change(lit(-5), lit(10), F.lit(3), lit(20)), N.change(lit(0), lit(None), lit(None, "int"), lit(None)), N.change(lit(8), lit(10), lit(None, "int"), lit(-17))) == ("Drifting down (3d in regime) · basis widening", "Stable", "Repositioning up · basis compressing")
    texts = [("spot", 100.0, 110.0, "+10.0%"), ("spot", 0.0, 5.0, "—"), ("gamma_flip", 5.0, 1.5, "-3.500"), ("gamma_flip", None, 1.0, "—"), ("gamma_flip", 0.0, 123456.7, "+1,23,456.700")]
    for metric, a, b, want in texts:
        assert one(spark, N.change_text(metric, lit(a), lit(b))) == (want,)
    assert one(spark, N.change_text("gex_regime", F.lit("all_positive"), F.lit("negative")), N.change_text("gex_regime", lit(None, "string"), F.lit("mixed"))) == ("all positive → negative", "— → mixed")


def test_bands(spark):
    for f, cases in (
        (N.turnover_band, {0.01: "stale", 0.3: "healthy", 0.7: "high", 1.5: "thin", None: None}), (N.migration_band, {0.2: "anticipatory", 1.0: "orderly", 2.0: "ahead", 2.5: "outrunning", None: None}),
        (N.hold_bucket, {39: "Low", 55: "Moderate", 56: "High", None: None}), (N.dte_band, {7: "near", 30: "mid", 31: "far", None: None}),
    ):
        for x, want in cases.items():
            assert one(spark, f(lit(x))) == (want,)
    assert one(spark, *(N.spread_class(lit(s), lit(p)) for s, p in ((1, 100), (5, 100), (15, 100), (1, 0), (None, 5)))) == ("good", "warn", "bad", None, None)
    assert one(spark, N.return_on_margin(lit(500), lit(30000)), N.return_on_margin(lit(500), lit(0))) == (1.67, None)
    at = lambda h, m: N.session(F.lit(dt.datetime(2024, 1, 8, h, m)))
    assert one(spark, at(8, 59), at(9, 0), at(9, 15), at(15, 29), at(15, 30), at(16, 0)) == ("CLOSED", "PRE-OPEN", "OPEN", "OPEN", "POST-CLOSE", "CLOSED")


def test_chunks_cover_the_range(spark):
    first, last = dt.date(2024, 1, 1), dt.date(2024, 1, 10)
    got = one(spark, N.chunks(F.lit(first), F.lit(last), 4))[0]
    assert [(r.first.day, r.last.day) for r in got] == [(1, 4), (5, 8), (9, 10)]
    assert one(spark, N.chunks(F.lit(last), F.lit(first), 4)) == ([],)


def test_profile_keeps_to_bounds(spark):
    rows = ocdata.latest(ocdata.chain(spark, SF), "symbol").withColumns({"from": F.col("atm_strike") - 10, "to": F.col("atm_strike") + 10})
    x = ladder.gamma_profile(rows, levels=3, bounds=("from", "to")).join(rows.select(*ladder.KEYS, "atm_strike").distinct(), ladder.KEYS)
    assert x.filter("price <> atm_strike + 10 * (level - 1)").count() == 0


def test_profile_against_nearest_strikes(spark):
    """Prices between, on, half way and beyond strikes; rows of one strike; a ladder of one strike."""
    day, at = dt.date(2024, 1, 25), dt.datetime(2024, 1, 8, 9)
    strikes = {"A": [100.0, 110.0, 110.0, 140.0, 141.0, 200.0], "B": [50.0], "C": [10.0, 20.0, 30.0]}
    rows = [(s, day, at, k, 0.1 * i, 10.0, 0.2, 7.0 + i, 100, k0[0] - 7.0, k0[-1] + 9.0) for s, k0 in strikes.items() for i, k in enumerate(k0)]
    x = spark.createDataFrame(rows, "symbol string, expiry date, timestamp timestamp, strike_price double, ce_gamma double, ce_oi double, pe_gamma double, pe_oi double, lotsize int, lo double, hi double")
    for bounds in (None, ("lo", "hi")):
        got = ladder.gamma_profile(x, levels=41, bounds=bounds)
        seen = got.collect()
        assert len(seen) == 3 * 41
        for r in seen:
            own = [(round(abs(k - r.price), 9), k, g * o * lot / 1e9, -(pg * po * lot) / 1e9) for s, _, _, k, g, o, pg, po, lot, *_ in rows if s == r.symbol]
            _, k, call, put = min(own)
            assert (r.near_strike, round(r.call, 12), round(r.put, 12)) == (k, round(call, 12), round(put, 12))
    plan = ladder.gamma_profile(x)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "array_min" not in plan
