"""Screens on rows made by hand: live and priced options only, both sides, days, bands and weights."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ladderlake.operators import clusters, flows, screens

T = lambda d, h=9: dt.datetime(2024, 1, d, h)
OLD, NEW = dt.date(2024, 1, 4), dt.date(2024, 1, 25)
ROW = {"symbol": "ITC", "expiry": NEW, "timestamp": T(8), "strike_price": 100.0, "underlying_price": 100.0, "distance_from_atm": 0.0, "lotsize": 10, "m_volatility": 12.0, "net_gexv": 0.0, "days_to_expiry": 10}
ROW |= {f"{s}_{n}": v for s in ("ce", "pe") for n, v in {"ltp": 5.0, "iv": 10.0, "oi": 100.0, "volume": 500.0, "delta": 0.3 if s == "ce" else -0.3, "gamma": 0.01, "oi_change": 5.0, "tprice": 5.0, "time_value": 1.0, "tbq": 1.0, "bid_ask_spread": 0.01}.items()}
KINDS = {str: "string", float: "double", int: "int", dt.date: "date", dt.datetime: "timestamp"}
SCHEMA = ", ".join(f"{k} {KINDS[type(v)]}" for k, v in ROW.items())


def chain(spark, *changes):
    return spark.createDataFrame([tuple({**ROW, **x}.values()) for x in changes], SCHEMA)


def two(**x):
    """A strike at two times; values are pairs."""
    return [{k: v[i] if isinstance(v, tuple) else v for k, v in x.items()} | {"timestamp": T(8, 9 + i)} for i in (0, 1)]


def test_shockers_of_volatility(spark):
    c = chain(spark, *two(strike_price=90.0, ce_iv=(10.0, 12.0)), *two(strike_price=95.0, ce_iv=(10.0, 60.0), expiry=OLD), *two(strike_price=100.0, ce_iv=(0.0, 99.0), pe_iv=(0.0, 9.0)), *two(symbol="NIFTY", ce_iv=(10.0, 20.0)))
    assert [(r.symbol, r.strike_price, r.iv_delta) for r in screens.iv_shockers(c, "2024-01-08").collect()] == [("NIFTY", 100.0, 5.0), ("ITC", 90.0, 1.0)]
    assert [r.symbol for r in screens.iv_shockers(c, "2024-01-08", kind="stock").collect()] == ["ITC"]
    assert [r.symbol for r in screens.iv_shockers(c, "2024-01-08", 1, "index").collect()] == ["NIFTY"]


def test_movers(spark):
    c = chain(spark, *two(strike_price=90.0, ce_ltp=(4.0, 5.0)), *two(strike_price=95.0, ce_ltp=(1.0, 99.0), expiry=OLD), *two(strike_price=100.0, ce_ltp=(0.0, 50.0)), *two(strike_price=105.0, ce_ltp=(5.0, 0.0)), *two(symbol="NIFTY", ce_ltp=(10.0, 9.0)))
    got = [(r.kind, r.symbol, r.ltp_chg, r.ltp_pct_chg) for r in screens.top_movers(c, "2024-01-08", top_n=1).collect()]
    assert got == [("gainer", "ITC", 1.0, 25.0), ("loser", "NIFTY", -1.0, -10.0)]
    assert {r.symbol for r in screens.top_movers(c, "2024-01-08", kind="stock").collect()} == {"ITC"}


def test_band_of_deltas(spark):
    strikes = {80.0: (0.31, -0.04), 90.0: (0.30, -0.05), 100.0: (0.15, -0.5)}
    rows = [{"strike_price": k, "ce_delta": c, "pe_delta": p} for k, (c, p) in strikes.items()]
    c = chain(spark, *rows, {"strike_price": 95.0, "expiry": OLD}, {"strike_price": 97.0, "ce_ltp": 0.0, "pe_ltp": 0.0})
    got = screens.delta_screener(c, "2024-01-08").orderBy("strike_price", "side").collect()
    assert [(r.strike_price, r.side, r.delta) for r in got] == [(90.0, "CE", 0.3), (90.0, "PE", 0.05), (100.0, "CE", 0.15)]
    assert got[0].premium_lot == 50.0 and screens.delta_screener(c, "2024-01-08", kind="index").count() == 0


def test_lens_takes_either_side(spark):
    c = chain(spark, {"strike_price": 90.0, "ce_oi": 0.0, "ce_ltp": 10.0}, {"strike_price": 95.0, "ce_oi": 0.0, "pe_oi": 0.0}, {"strike_price": 99.0, "ce_ltp": 0.0, "pe_ltp": 0.0}, {"strike_price": 100.0, "ce_tprice": 0.0}, {"strike_price": 105.0, "ce_tprice": 0.0, "pe_ltp": 9.0})
    assert {r.strike_price for r in screens.premium_lens(c, min_oi=50).collect()} == {90.0, 100.0, 105.0}
    assert {r.strike_price for r in screens.premium_lens(c, 0.9, 1.2, 50).collect()} == {90.0, 105.0}


def test_rank_of_both_sides_in_the_window(spark):
    past = [{"timestamp": T(d), "ce_iv": ce, "pe_iv": pe} for d, ce, pe in ((1, 50.0, 50.0), (5, 10.0, 30.0), (6, 10.0, 10.0), (7, 0.0, 0.0), (8, 10.0, 20.0))]
    c = chain(spark, *past, {"symbol": "X", "timestamp": T(8)})
    x = {r.symbol: r for r in screens.iv_rank(c, 5).collect()}
    assert (x["ITC"].n, x["ITC"].iv_now, x["ITC"].iv_rank, x["ITC"].iv_percentile, x["ITC"].rv_iv) == (3, 15.0, 50.0, 33.3, -3.0)
    assert (x["X"].n, x["X"].iv_rank, x["X"].iv_percentile) == (1, None, None)
    assert {r.n for r in screens.iv_rank(c, 30).filter("symbol = 'ITC'").collect()} == {4}


def test_skew_is_put_less_call(spark):
    wing = [{"strike_price": 100.0 + 10 * i, "distance_from_atm": 10.0 * i, "ce_delta": 0.5 - 0.25 * i, "pe_delta": -0.5 - 0.25 * i, "ce_iv": 10.0 + i, "pe_iv": 20.0 - i} for i in range(-3, 4)]
    wing[4] |= {"ce_iv": 0.0}  # the call at a quarter has none, so the next one counts; one strike less on its wing
    x = screens.skew(chain(spark, *wing)).first()
    assert x.risk_reversal == 21.0 - 10.0 and x.put_slope == -10.0 and x.call_slope is None
    assert screens.risk_reversals(chain(spark, *wing)).first().risk_reversal == 11.0


def test_sides_of_weighted_volatility(spark):
    c = chain(spark, {"ce_iv": 10.0, "ce_oi": 100.0, "pe_iv": 20.0, "pe_oi": 0.0}, {"strike_price": 110.0, "ce_iv": 40.0, "ce_oi": 50.0, "pe_iv": 30.0, "pe_oi": 50.0}, {"strike_price": 120.0, "ce_iv": 0.0})
    x = screens.oi_weighted_iv(c).first()
    assert (x.ce_iv, x.pe_iv, x.iv, x.oi) == (20.0, 30.0, 22.5, 200.0) and screens.weighted_iv_overall(c).first().pe_iv == 30.0


def test_intraday_volatility_of_the_last_day(spark):
    c = chain(spark, *two(ce_iv=(10.0, 20.0)), *two(ce_iv=(90.0, 10.0), expiry=OLD), *({**x, "symbol": "X", "timestamp": T(5, 9 + i)} for i, x in enumerate(two(ce_iv=(1.0, 2.0)))))
    x = screens.iv_intraday(c, "2024-01-08").collect()
    assert [(r.symbol, r.iv_open, r.iv_now, r.iv_chg, r.iv_chg_pct) for r in x] == [("ITC", 10.0, 15.0, 5.0, 50.0)]


def test_end_of_day_rows_by_expiry(spark):
    far = dt.date(2024, 2, 29)
    c = chain(spark, {"timestamp": T(8, 10)}, {"timestamp": T(8, 15)}, {"timestamp": T(8, 16)}, {"timestamp": T(8, 11), "expiry": far}, {"timestamp": T(7, 11), "expiry": far}, {"expiry": OLD})
    got = {(r.expiry, r.timestamp) for r in screens.eod_rows(c, "2024-01-08").collect()}
    assert got == {(NEW, T(8, 15)), (far, T(8, 11)), (far, T(7, 11))}  # an expiry without a row at the last time keeps its own
    assert screens.eod_rows(c, "2024-01-08", first="2024-01-08", last="2024-01-08").count() == 2
    assert {r.timestamp for r in flows.end_of_day(c, "2024-01-08").collect()} == {T(8, 0), T(7, 0)}
    assert flows.one_day(c, "2024-01-08").count() == 4 and flows.one_day(c, "2024-01-08", "2024-01-07").count() == 1


def test_histories(spark):
    rows = [{"timestamp": T(d, h), "ce_oi": 10.0 * d + h, "ce_iv": 1.0 * d, "pe_iv": 3.0 * d} for d in (2, 7, 8) for h in (9, 11)]
    c = chain(spark, *rows, {"strike_price": 120.0}, {"strike_price": 101.0, "ce_ltp": 0.0, "pe_ltp": 0.0, "ce_iv": 0.0})
    assert [(str(r.dt), r.ce_oi, r.ce_oi_chg) for r in screens.oi_history(c, 5).orderBy("dt").collect()] == [("2024-01-07", 80.0, None), ("2024-01-08", 90.0, 10.0)]
    assert [(r.avg_iv, r.iv_chg) for r in screens.iv_history(c, 6).orderBy("dt").collect()] == [(4.0, None), (14.0, 10.0), (16.0, 2.0)]


def test_clusters_follow_time_value(spark):
    strikes = [(80.0, 21.0, 1.0), (90.0, 11.0, 1.0), (100.0, 6.0, 6.0), (110.0, 2.0, 2.0), (120.0, 0.5, 0.5)]
    c = chain(spark, *({"strike_price": k, "ce_ltp": p, "ce_time_value": v} for k, p, v in strikes))
    assert [r.peak_strike for r in clusters.clusters(c, "ce").collect()] == [100.0]
    x = flows.money_clusters(c).filter("side = 'CE'").first()
    assert x.peak_strike == 100.0 and x.avg_nd2 == 0.0 and flows.money_clusters(c, min_oi_change=6.0).count() == 0
    nd2 = flows.money_clusters(c.withColumn("ce_nd2", F.lit(0.4)).withColumn("pe_nd2", F.lit(0.6)))
    assert {(r.side, r.avg_nd2) for r in nd2.collect()} == {("CE", 0.4), ("PE", 0.6)}


@pytest.mark.parametrize("f", [lambda c: screens.iv_shockers(c, "2024-01-08"), lambda c: screens.top_movers(c, "2024-01-08"), lambda c: screens.delta_screener(c, "2024-01-08"), screens.iv_rank, screens.skew, screens.premium_lens, screens.oi_history, screens.iv_history, lambda c: screens.iv_intraday(c, "2024-01-08"), lambda c: flows.end_of_day(c, "2024-01-08")])
def test_empty(spark, f):
    assert f(chain(spark).limit(0)).count() == 0
