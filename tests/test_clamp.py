"""The range that follows the day before: blocks of days against one walk over all of them."""

import datetime as dt
import random

from ladderlake.operators import clamp

DAYS = "symbol string, expiry_rank int, date date, raw double, need double"
SEEDS = "symbol string, expiry_rank int, seed double"


def walked(days, seed, cap):
    h, out = seed, {}
    for day, raw, need in days:
        half = raw
        if h > 0:
            half = h * (1 + cap) if raw is None else max(min(raw, h * (1 + cap)), h * (1 - cap))
        if half is not None and need is not None and half >= need:
            h = out[day] = half
    return out


def series(n, seed, need):
    r = random.Random(seed)
    days = [dt.date(1960, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    level = [100.0]
    for _ in days:
        level.append(min(max(level[-1] * r.choice([0.4, 0.9, 1.0, 1.1, 2.5]), 1.0), 1e4))
    return [(d, None if r.random() < 0.02 else v, None if r.random() < 0.05 else r.choice(need)) for d, v in zip(days, level)]


def test_blocks_equal_one_walk(spark):
    cases = {("A", 0): (series(20_000, 1, [0.0, 50.0]), 0.0), ("A", 1): (series(3_000, 2, [0.0]), 7.0), ("B", 0): (series(3_000, 3, [1e9]), 0.0), ("B", 1): (series(3_000, 4, [10.0, 300.0]), 250.0), ("C", 0): (series(5, 5, [0.0]), 0.0)}
    rows = [(*k, *d) for k, (days, _) in cases.items() for d in days]
    seeds = spark.createDataFrame([(*k, s) for k, (_, s) in cases.items() if s], SEEDS)
    for block in (365, 64):
        got = clamp.follow(spark.createDataFrame(rows, DAYS), seeds, 0.25, block).collect()
        want = {(*k, d): h for k, (days, s) in cases.items() for d, h in walked(days, s, 0.25).items()}
        assert {(r.symbol, r.expiry_rank, r.date) for r in got} == set(want) and len(got) == len(want)
        assert all(abs(r.half / want[r.symbol, r.expiry_rank, r.date] - 1) < 1e-12 for r in got)


def test_pieces_of_random_blocks():
    r = random.Random(9)
    for _ in range(300):
        cap, days = r.choice([0.0, 0.25, 1.0]), [(r.uniform(0, 9), r.choice([0.0, 3.0, 8.0, float("inf")])) for _ in range(r.randint(1, 6))]
        pieces = [(-1.0, 0.0, 0.0), (clamp.LEAST, 1.0, 0.0)]
        for raw, need in days:
            pieces = clamp.day_pieces(pieces, raw, need, cap)
        for h in [0.0, *(r.uniform(0, 12) for _ in range(20))]:
            want = h
            for raw, need in days:
                want = clamp.held(want, raw, need, cap)
            start, slope, value = [p for p in pieces if p[0] <= h][-1]
            assert abs(slope * h + value - want) < 1e-9


def test_no_array_of_all_days(spark):
    """A long history is cut in as many arrays as it has blocks; without days there are no rows."""
    empty = spark.createDataFrame([], DAYS)
    assert clamp.follow(empty, spark.createDataFrame([], SEEDS), 0.25).count() == 0
    one = spark.createDataFrame([("A", 0, *d) for d in series(2_000, 6, [0.0])], DAYS)
    maps = clamp._block_maps(one.selectExpr("symbol", "expiry_rank", "date", "floor(unix_date(date) / 365) AS block", "coalesce(raw, double('inf')) AS raw", "coalesce(need, double('inf')) AS need"), 0.25)
    pieces = maps.groupBy("block").count().collect()
    assert len(pieces) == 6 and max(p["count"] for p in pieces) < 60
