"""Clusters and tracks against plain walks over one ladder and one series."""

import datetime as dt
import random

import numpy as np

from ladderlake.operators import clusters as C

E = dt.date(2024, 1, 25)
T = [dt.datetime(2024, 1, 8, 9) + dt.timedelta(minutes=5 * i) for i in range(400)]
ROWS = "symbol string, expiry date, timestamp timestamp, strike_price double, ce_time_value double, ce_oi double"
FOUND = "symbol string, expiry date, timestamp timestamp, center_strike double, weight double"


def peaks(y, prominence, distance):
    """Middles of plateaus higher than both sides, distance apart (the highest first), that stand out."""
    cut = np.flatnonzero(np.diff(y, prepend=np.nan) != 0)
    found = [(a + b - 1) // 2 for a, b in zip(cut, [*cut[1:], len(y)]) if 0 < a and b < len(y) and y[a - 1] < y[a] > y[b]]
    kept = []
    for i in sorted(found, key=lambda i: (-y[i], -i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)

    def base(side, top):
        low = top
        for v in side:
            if v > top:
                break
            low = min(low, v)
        return low

    return sorted(i for i in kept if y[i] - max(base(y[:i][::-1], y[i]), base(y[i + 1 :], y[i])) >= prominence)


def plain(k, w, smoothing, pct):
    n, half = len(k), smoothing // 2
    if n < 3 or not sum(w):
        return []
    y = np.mean([w[np.clip(np.arange(n) + i, 0, n - 1)] for i in range(-half, smoothing - half)], axis=0) if 1 < smoothing <= n else w
    tops = peaks(y, y.max() * pct / 100, max(1, n // 20)) or [int(y.argmax())]
    middles, out = [0, *((a + b) // 2 for a, b in zip(tops, tops[1:])), n - 1], []
    for top, lo, hi in zip(tops, middles, middles[1:]):
        lo = max([lo, *(i + 1 for i in range(lo, top) if y[i] < y[top] / 10)])
        hi = min([hi, *(i - 1 for i in range(top + 1, hi + 1) if y[i] < y[top] / 10)])
        own = w[lo : hi + 1]
        if own.sum() > 0:
            out.append((round(float((k[lo : hi + 1] * own).sum() / own.sum()), 1), k[top], k[lo], k[hi], float(own.sum()), round(float(np.sort(own)[-3:].sum() / own.sum()), 4), hi - lo + 1))
    return out


def test_plain_peaks():
    assert peaks(np.array([0, 3, 1, 5, 5, 0, 1.0]), 1, 1) == [1, 3] and peaks(np.array([0, 3, 1, 5, 0.0]), 2.5, 1) == [3] and peaks(np.array([1.0, 2, 3]), 0, 1) == []


def test_random_ladders(spark):
    """Plateaus, ties, empty and short ladders, and long ones, whose peaks have to be apart."""
    r, ladders = random.Random(4), {}
    for i in range(1000):
        n, top = r.choice([1, 2, 3, 4, 9, 21, 40, 75, 130]), r.choice([0, 1, 3, 50, 10_000])
        ladders[f"S{i}"] = [float(r.randint(0, top)) if r.random() < 0.8 else 0.0 for _ in range(n)]
    data = spark.createDataFrame([(s, E, T[0], 100.0 + 5 * j, v, 1.0) for s, w in ladders.items() for j, v in enumerate(w)], ROWS).cache()
    for smoothing, pct in ((3, 10.0), (1, 0.0), (4, 35.0)):
        got = {}
        for x in C.clusters(data, smoothing=smoothing, prominence_pct=pct).collect():
            got.setdefault(x.symbol, []).append((x.peak_strike, x.min_strike, x.max_strike, x.weight, x.members, x.center_strike, x.concentration))
        for s, w in ladders.items():
            want = sorted((b, c, d, e, g, a, f) for a, b, c, d, e, f, g in plain(100.0 + 5 * np.arange(len(w)), np.array(w), smoothing, pct))
            have = sorted(got.get(s, []))
            assert [h[:5] for h in have] == [x[:5] for x in want], s
            assert all(abs(h[5] - x[5]) < 0.11 and abs(h[6] - x[6]) < 2e-4 for h, x in zip(have, want)), s


def test_no_peaks_no_rows(spark):
    rows = [("A", E, T[0], 100.0 + i, None if i % 2 else 0.0, 5.0) for i in range(6)]
    assert C.clusters(spark.createDataFrame(rows, ROWS)).count() == 0 and C.clusters(spark.createDataFrame([], ROWS)).count() == 0


def test_one_exchange_and_no_python(spark):
    plan = C.clusters(spark.createDataFrame([("A", E, T[0], 1.0, 1.0, 1.0)], ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Pandas" not in plan


def walk(times, tolerance):
    """(time, center, track, status, velocity) of one series, one time after another."""
    out, before, count = [], [], 0
    for t, found in times:
        now = []
        for center, weight in sorted(found):
            near = [(abs(center - out[b][1]), b) for b in before if abs(center - out[b][1]) < tolerance]
            old = min(near)[1] if near else None
            count += old is None
            out.append([t, center, count if old is None else out[old][2], "EMERGING" if old is None else "TRACKED", 0.0 if old is None else weight - out[old][5], weight])
            now.append(len(out) - 1)
        for b in before:
            if out[b][2] not in {out[n][2] for n in now}:
                out[b][3] = "DISSOLVED"
        before = now
    return {(t, c): (n, s, v) for t, c, n, s, v, _ in out}


def test_random_tracks(spark):
    """Tracks that split, meet, end and leave times out, over 400 times."""
    r, rows, want = random.Random(8), [], {}
    for s, n in (("A", 400), ("B", 60), ("C", 1)):
        times = []
        for t in T[:n]:
            found = [(float(c), float(r.randint(1, 99))) for c in r.sample(range(80, 121, 2 if s == "A" else 3), r.choice([0, 1, 3, 6]))]
            if found:
                times.append((t, found))
                rows += [(s, E, t, *f) for f in found]
        want |= {(s, *k): v for k, v in walk(times, 2.0 if s == "B" else 5.0).items()}
    found = spark.createDataFrame(rows, FOUND)
    spots = found.select(*C.KEYS).distinct().selectExpr("*", "CASE symbol WHEN 'B' THEN 100.0D ELSE 250.0D END AS spot")
    got = {(x.symbol, x.timestamp, x.center_strike): (x.track, x.status, x.velocity) for x in C.tracks(found, spots).collect()}
    assert got == want
    assert C.tracks(found.limit(0), spots).count() == 0
