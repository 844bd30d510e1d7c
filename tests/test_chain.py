import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ladderlake import queries
from ladderlake.functions import expressions as E
from ladderlake.operators import clusters, flows, ladder, screens, walls
from ladderlake.plans import eod
from ladderlake.sources import ocdata
from ladderlake.streaming import ingest

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    clean = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def ladders(spark, *all_g, ref=None):
    rows = [("S", i, 100.0 + 10 * k, float(g), float(ref if ref is not None else 115)) for i, gs in enumerate(all_g) for k, g in enumerate(gs)]
    return spark.createDataFrame(rows, "symbol string, id int, strike_price double, g double, ref double")


def test_flip_by_hand(spark):
    x = ladder.gamma_flip(ladders(spark, [-10, -5, 5, 10], [1, 2, 3, 4], [-1, -2, -3, -4], ref=125), ["symbol", "id"], "ref").orderBy("id").collect()
    assert (x[0].gamma_flip, x[0].gex_regime, x[0].transition_width) == (115.0, "positive", 10.0)
    assert [r.gex_regime for r in x[1:]] == ["all_positive", "all_negative"] and x[1].gamma_flip is None
    assert ladder.gamma_flip(ladders(spark, [-10, -5, 5, 10], ref=105), ["symbol", "id"], "ref").first().gex_regime == "negative"


def test_shelf_against_walk(spark):
    rng = random.Random(3)
    cases = [[rng.choice([-3, -1, 0, 1, 2, 4, 6]) for _ in range(rng.randint(2, 12))] for _ in range(60)]
    got = {r.id: (r.lo, r.hi, r.peak_strike) for r in ladder.gamma_shelf(ladders(spark, *cases), ["symbol", "id"]).collect()}
    for i, g in enumerate(cases):
        a = list(map(abs, g))
        if not max(a):
            assert i not in got
            continue
        top = a.index(max(a))
        lo = hi = top
        while lo and a[lo - 1] >= a[top] / 2:
            lo -= 1
        while hi + 1 < len(a) and a[hi + 1] >= a[top] / 2:
            hi += 1
        assert got[i] == (100 + 10 * lo, 100 + 10 * hi, 100 + 10 * top)


def test_expressions_by_hand(spark):
    r = spark.range(1).select(
        E.expected_move(F.lit(20000.0), F.lit(0.0), F.lit(0)).alias("em"), E.confidence(F.lit(1000.0), F.lit(10), F.lit(0.3)).alias("hi"), E.confidence(F.lit(1000.0), F.lit(5), F.lit(0.8)).alias("mid"), E.confidence(F.lit(0.0), F.lit(2), F.lit(None).cast("double")).alias("lo"),
        E.in_deadzone(F.lit(-0.03)).alias("z1"), E.in_deadzone(F.lit(0.5)).alias("z2"), E.in_deadzone(F.lit(None).cast("double")).alias("z3"),
        E.monthly_expiry(F.lit(dt.date(2024, 1, 26))).alias("x1"), E.monthly_expiry(F.lit(dt.date(2025, 8, 1))).alias("x2"), E.hold_probability(F.lit(0.1), F.lit(0.4), F.lit("positive")).alias("p"),
    ).first()
    assert r.em == 1000 and (r.hi, r.mid, r.lo) == ("high", "medium", "low") and (r.z1, r.z2, r.z3) == (True, False, True)
    assert r.x1 == dt.date(2024, 2, 29) and r.x2 == dt.date(2025, 8, 26) and r.p == 38


def plain_shelf(strikes, oi, index):
    """(wall, grid, shelf) by walking outwards one grid step at a time."""
    for step, least in ((100, 3), (50, 3)) if index else ((1, 2),):
        on = [x % step == 0 for x in strikes]
        if sum(on) >= least:
            break
    else:
        on = [True] * len(strikes)
    held = {x: o for x, o, keep in zip(strikes, oi, on) if keep}
    wall = max(held, key=lambda x: (held[x], -x))
    if held[wall] <= 0:
        return None
    xs = sorted(held)
    at = xs.index(wall)
    gaps = [round(b - a, 3) for a, b in zip(xs[max(0, at - 6) :], xs[max(0, at - 6) + 1 : at + 7])]
    grid = max(dict.fromkeys(gaps), key=gaps.count) if gaps else 0
    shelf = [wall]
    for way in (-grid, grid) if grid else ():
        x, missing = wall + way, 0
        while missing <= 1 and (x not in held or held[x] >= 0.4 * held[wall]):
            missing = 0 if x in held else missing + 1
            shelf += [x] if x in held else []
            x += way
    return wall, grid, sorted(shelf)


def test_shelves_against_walk(spark):
    rng, rows, want = random.Random(5), [], {}
    cases = [([100, 200, 300, 500, 600, 700], [1, 50, 100, 60, 10, 90], True), ([100], [0], False), ([10.0, 10.5, 11.0], [5, 100, 6], False)]
    for _ in range(200):
        step = rng.choice([0.5, 1, 2.5, 50, 100])
        strikes = sorted(rng.sample([step * k for k in range(1, 40)], rng.randint(1, 25)))
        cases.append(([float(x) for x in strikes], [float(rng.choice([0, 10, 40, 41, 90, 100])) for _ in strikes], rng.random() < 0.5))
    for i, (strikes, oi, index) in enumerate(cases):
        symbol = "NIFTY" if index else "ITC"
        rows += [(symbol, i, "CE", float(x), float(o), 1.0, 0.5) for x, o in zip(strikes, oi)]
        want[i] = plain_shelf(strikes, oi, index)
    got = {r.id: (r.wall_strike, r.grid, [float(x) for x in r.members.split(",")]) for r in walls.shelves(spark.createDataFrame(rows, "symbol string, id int, side string, strike_price double, oi double, oi_change double, moved double"), ["symbol", "id", "side"]).collect()}
    assert got == {i: w for i, w in want.items() if w}


def test_oi_shelf_signal_takes_the_change_of_price(spark):
    rows = [(symbol, dt.date(2024, 1, 25), dt.datetime(2024, 1, 1, h), 100.0, 50.0, change, ltp, 0.0, 0.0, 0.0) for symbol, change, ltps in (("A", 5.0, (9.0, 7.0)), ("B", -5.0, (9.0, 7.0)), ("C", 5.0, (7.0, 9.0))) for h, ltp in zip((9, 10), ltps)]
    chain = spark.createDataFrame(rows, "symbol string, expiry date, timestamp timestamp, strike_price double, ce_oi double, ce_oi_change double, ce_ltp double, pe_oi double, pe_oi_change double, pe_ltp double")
    found = {(r.symbol, r.timestamp.hour): r.signal for r in walls.oi_shelves(chain).collect()}
    assert [found[s, 10] for s in "ABC"] == ["Short Build-Up", "Long Unwinding", "Long Build-Up"] and {found[s, 9] for s in "ABC"} == {"Neutral"}


def test_each_signal_rule(spark):
    """Each rule fires alone when its condition holds, and not just before it."""
    base = {"date": 1, "gex_regime": "mixed", "iv_change": 0.0, "expected_move": 100.0, "flip_norm_distance": 0.5, "flip_velocity": 0.0, "transition_width_norm": 0.5, "neg_gamma_fraction": 0.5, "pe_vanna": 0.0, "ce_vanna": 0.0}
    cases = [
        ({"gex_regime": "positive"}, {"gex_regime": "negative"}, "regime_flip_to_neg"), ({"gex_regime": "all_negative"}, {"gex_regime": "all_positive"}, "regime_flip_to_pos"), ({"gex_regime": "mixed"}, {"gex_regime": "negative"}, ""),
        ({}, {"flip_velocity": -25.0}, "flip_drift_down"), ({}, {"flip_velocity": 25.0}, "flip_drift_up"), ({}, {"flip_velocity": 24.9}, ""), ({}, {"flip_velocity": 25.0, "flip_norm_distance": 1.0}, ""),
        ({"gex_regime": "positive"}, {"gex_regime": "positive", "transition_width_norm": 0.44}, "pin_strengthening"), ({"gex_regime": "positive"}, {"gex_regime": "positive", "transition_width_norm": 0.45}, ""), ({}, {"transition_width_norm": 0.1}, ""),
        ({}, {"neg_gamma_fraction": 0.56}, "instability_widening"), ({}, {"neg_gamma_fraction": 0.54}, ""),
        ({"gex_regime": "negative"}, {"gex_regime": "negative", "iv_change": 0.1, "pe_vanna": -1.0}, "crash_risk"), ({"gex_regime": "negative"}, {"gex_regime": "negative", "iv_change": 0.1, "pe_vanna": 0.0}, ""),
        ({"gex_regime": "positive"}, {"gex_regime": "positive", "iv_change": 0.1, "ce_vanna": 1.0}, "bull_trend_reinforce"), ({"gex_regime": "positive"}, {"gex_regime": "positive", "iv_change": 0.0, "ce_vanna": 1.0}, ""),
        ({"gex_regime": "negative"}, {"gex_regime": "negative", "iv_change": -0.1, "pe_vanna": -1.0}, "bear_trend_reinforce"),
        ({"date": None}, {"gex_regime": "negative", "iv_change": 0.1, "pe_vanna": -1.0}, ""),
    ]
    rows = [(i, *({**base, **now}[n] for n in base), *({**base, **before}[n] for n in base)) for i, (before, now, _) in enumerate(cases)]
    types = {n: "string" if n == "gex_regime" else "int" if n == "date" else "double" for n in base}
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{p}{n} {t}" for p in ("n_", "b_") for n, t in types.items()))
    got = {r.id: r.s for r in df.select("id", E.signals({n: F.col(f"n_{n}") for n in base}, {n: F.col(f"b_{n}") for n in base}).alias("s")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_run_over_new_days_goes_on_where_the_last_ended(spark):
    chain = ocdata.chain(spark, "/root/testdata/sf0.01")
    whole = eod.stage1(chain)
    old = eod.stage1(chain.filter("timestamp < '2024-01-12'"))
    new = eod.stage1(chain.filter("timestamp >= '2024-01-12'"), before=old)
    want, got = ({(r.symbol, r.date, r.expiry_rank): r for r in x.select(sorted(whole.columns)).collect()} for x in (whole, old.unionByName(new)))
    assert want == got and len(want) == 80


def test_screener_filters_and_severity(spark):
    rows = [("A", 2, 0, "high", "positive", "flip_drift_up,crash_risk", False, False, -3.0), ("B", 2, 0, "low", "negative", "", True, False, 1.0), ("C", 2, 0, "medium", "negative", "", False, False, 2.0), ("D", 2, 0, "medium", "negative", "pin_strengthening", False, False, None), ("C", 1, 0, "low", "mixed", "crash_risk", False, False, 0.0), ("D", 1, 0, "low", "mixed", "crash_risk", False, False, 0.0)]
    x = spark.createDataFrame([(s, dt.date(2024, 1, d), *rest) for s, d, *rest in rows], "symbol string, date date, expiry_rank int, confidence string, gex_regime string, signals string, regime_compression boolean, compression_release boolean, net_gex_norm double")
    names = lambda *a, **k: [r.symbol for r in eod.screener(x, *a, **k).collect()]
    assert names(sort_by="net_gex_norm") == ["A", "C", "B", "D"] and names("2024-01-02", sort_by="signals") == ["A", "D", "B", "C"]
    assert sorted(names(view="changed")) == ["A", "B", "D"] and sorted(names(least_confidence="medium")) == ["A", "C", "D"] and names(signal="crash") == ["A"]
    assert sorted(names(regime="negative")) == ["B", "C", "D"] and names(members=x.filter("symbol = 'B'").select("symbol").distinct()) == ["B"] and names(sort_by="net_gex_norm", limit=1) == ["A"]
    assert [(r.symbol, r.prev_signals) for r in eod.screener(x, view="dropped").collect()] == [("C", "crash_risk")]
    assert [(r.date.day, r.compressing, r.releasing) for r in eod.indicator_counts(x).orderBy("date").collect()] == [(1, 0, 0), (2, 1, 0)]


def test_flows_cross_and_migrate(spark):
    """The far strike's share grows while all open interest stands still, and the near strike's delta falls below its bucket."""
    t, e = lambda h: dt.datetime(2024, 1, 2, h), dt.date(2024, 1, 25)
    rows = [("A", e, t(h), k, oi, 0.0, oi_chg, delta, spot) for h, k, oi, oi_chg, delta, spot in ((9, 100.0, 60.0, 0.0, 0.45, 100.0), (9, 110.0, 40.0, 0.0, 0.2, 100.0), (10, 100.0, 50.0, -10.0, 0.25, 101.0), (10, 110.0, 50.0, 10.0, 0.2, 101.0), (10, 120.0, 0.0, 0.0, 0.1, 101.0))]
    x = spark.createDataFrame(rows, "symbol string, expiry date, timestamp timestamp, strike_price double, ce_oi double, pe_oi double, ce_oi_change double, ce_delta double, underlying_price double")
    x = x.withColumns({"pe_delta": F.lit(-0.1), "pe_oi_change": F.lit(0.0), "ce_iv": F.lit(10.0), "pe_iv": F.lit(0.0), "days_to_expiry": F.lit(20), "net_vanna_ex": F.lit(0.0), "net_flow": F.lit(0.0)} | {f"{s}_{n}": F.lit(v) for s in ("ce", "pe") for n, v in (("ltp", 5.0), ("volume", 10.0), ("bid_ask_spread", 0.1), ("tbq", 1.0))})
    assert [tuple(r)[2:] for r in flows.flow_crossing(x).collect()] == [("ATM", "decreasing", -10.0, 0.0)]
    # the strike that was not listed at first counts as DEEP_OTM, and its delta says FAR_OTM now
    assert [(r.strike_price, r.ce_open, r.ce_now) for r in flows.migrated_strikes(x).orderBy("strike_price").collect()] == [(100.0, "ATM", "NEAR_OTM"), (120.0, "DEEP_OTM", "FAR_OTM")]
    told = {r.bucket: (r.ce_signal, r.migrated, r.spot_chg) for r in flows.flow_signals(x).collect()}
    assert told == {"ATM": ("Short Covering", 1, 1.0), "NEAR_OTM": ("Long Build-Up", 0, 1.0), "DEEP_OTM": ("Neutral", 1, 1.0)}
    cut = x.withColumn("ce_iv", F.lit(0.0))
    assert flows.with_greeks(cut).isEmpty() and flows.tradeable(x, min_oi=55).count() == 1 and flows.tradeable(x.withColumn("ce_ltp", F.lit(0.0)).withColumn("pe_ltp", F.lit(0.0))).isEmpty()


def test_smart_money_on_both_sides(spark):
    x = flows.smart_money(ocdata.chain(spark, "/root/testdata/sf0.01")).toPandas()
    assert set(x.side) == {"CE", "PE"} and x.avg_delta.between(0, 1).all() and x.buy_imbalance.between(-1, 1).all()
    for _, g in x.sort_values(["timestamp", "center_strike"]).groupby(["symbol", "expiry", "side", "track"]):
        assert g.velocity.iloc[0] == 0 and all(abs(v - (b - a)) < 0.011 for v, a, b in zip(g.velocity[1:], g.prem_flow, g.prem_flow[1:]))
        assert all(abs(v - (b - a)) < 0.021 for v, a, b in zip(g.acceleration[1:], g.velocity, g.velocity[1:]))


def test_divergence_ignores_lapsed_expiries(spark):
    rows = [("A", dt.date(2024, 1, d), dt.datetime(2024, 1, t, 9), 0.0, 100.0 + t, ce, 5.0) for d, ces in ((3, (1.0, 9.0)), (25, (10.0, 8.0))) for t, ce in zip((1, 2), ces)]
    x = spark.createDataFrame(rows, "symbol string, expiry date, timestamp timestamp, distance_from_atm double, underlying_price double, ce_ltp double, pe_ltp double").withColumns({n: F.lit(10.0) for n in ("ce_iv", "pe_iv", "net_flow")})
    assert [(r.signal, r.ce_pct) for r in screens.divergence(x, "2024-01-05").collect()] == [("SMART_SELL", -20.0)]
    assert screens.divergence(x, "2024-01-05", intraday=True).isEmpty()


def test_tables_and_csv(spark, tmp_path):
    assert ocdata.chain_table(spark, "no_such_table") is None
    spark.createDataFrame([(1, float("nan"))], "a int, b double").createOrReplaceTempView("some_chain")
    x = ocdata.chain_table(spark, "some_chain")
    ocdata.to_csv(x, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).collect() == [("1", None)]
    (tmp_path / "map.csv").write_text("ticker,code\nABC,XYZ\n")
    assert [tuple(r) for r in ocdata.tickers(spark, str(tmp_path / "map.csv")).collect()] == [("ABC", "XYZ")]


def test_tracks_follow_and_end(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    e = dt.date(2024, 1, 25)
    found = spark.createDataFrame([("A", e, t(9), 100.0, 5.0), ("A", e, t(10), 101.0, 8.0), ("A", e, t(10), 150.0, 1.0), ("A", e, t(11), 102.0, 9.0)], "symbol string, expiry date, timestamp timestamp, center_strike double, weight double")
    spots = found.select("symbol", "expiry", "timestamp").distinct().withColumn("spot", F.lit(100.0))
    x = {(r.timestamp.hour, r.center_strike): (r.track, r.status, r.velocity) for r in clusters.tracks(found, spots).collect()}
    assert x == {(9, 100.0): (1, "EMERGING", 0.0), (10, 101.0): (1, "TRACKED", 3.0), (10, 150.0): (2, "DISSOLVED", 0.0), (11, 102.0): (1, "TRACKED", 1.0)}


def test_two_stages(spark):
    x = eod.stage2(eod.stage1(ocdata.chain(spark, "/root/testdata/sf0.01"))).toPandas().sort_values(["symbol", "expiry_rank", "date"])
    assert len(x) == 80 and x[["regime_compression", "compression_release", "signals"]].notna().all().all()
    assert (x.days_since_flip == x.days_in_regime - 1).all()
    for _, g in x.groupby(["symbol", "expiry_rank"]):
        half = ((g.range_hi - g.range_lo) / 2).tolist()
        assert all(0.74 <= b / a <= 1.26 for a, b in zip(half, half[1:]))
        first, *_ = g.signals
        assert first == "" and g.days_in_regime.iloc[0] == 1
        run = 0
        for before, now, days in zip([None, *g.gex_regime], g.gex_regime, g.days_in_regime):
            run = run + 1 if before == now else 1
            assert days == run


def test_strength_of_opposite_days(spark):
    day = lambda n, s: (n, 0.1 * s, -0.1 * s, -1.0 * s, 10.0, 0.5 + 0.1 * s, "positive", 0.5 - 0.1 * s)
    names = ["date", "net_gex_norm", "neg_gamma_fraction", "iv_change", "atm_iv_smoothed", "flip_norm_distance", "gex_regime", "transition_width_norm"]
    rows = [("A", dt.date(2024, 1, n), 0, *day(n, s)[1:], 0.2) for n, s in ((1, 0), (2, 1), (3, -1))]
    x = eod.history(spark.createDataFrame(rows, ["symbol", "date", "expiry_rank", *names[1:], "basis_pct"]), "2024-01-01", "2024-01-03").orderBy("date").collect()
    assert [r.strength for r in x] == [0, 6, -4] and [r.strength_cum for r in x] == [0, 6, 2]


def test_upsert_and_json(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(2, float("nan"), "x")], "k int, v double, w string")
    x = {r.k: (r.v, r.w) for r in ocdata.json_safe(ocdata.upserted(old, new, ["k"])).collect()}
    assert x == {1: (1.0, None), 2: (None, "x")}


def test_empty_chain(spark):
    empty = ocdata.chain(spark, SF).limit(0)
    for f in (screens.overview, flows.flow_buckets, screens.skew, ladder.max_pain, eod.stage1, clusters.clusters, walls.oi_shelves):
        assert f(empty).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = ocdata.chain(spark, SF)
    rows.write.parquet(str(tmp_path / "in"))
    ingest.start(ingest.read_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("trade_date").select(rows.columns)
    assert got.count() == rows.count() and got.exceptAll(rows).isEmpty()


def test_plans(spark):
    chain = ocdata.chain(spark, SF)
    plan = ladder.max_pain(chain)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    plan = screens.now_and_before(chain, F.col("ce_ltp"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Join" not in plan
