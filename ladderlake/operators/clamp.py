"""A range that follows the day before within a cap, over any number of days, as a scan of blocks of days.

A day takes the half range h of the day before to its own: raw held between h * (1 - cap) and
h * (1 + cap), or raw itself if there is no h yet; if that reaches fewer than two strikes, the day
leaves h as it is. Such a map is made of pieces, each a constant or a multiple of h, and so is the
map of a whole block of days. Blocks are summed up side by side, their pieces applied one block
after another to find what each block starts from, and then all blocks are walked side by side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["symbol", "expiry_rank"]
#: The least number above 0: pieces from here on are for series that have an h, the one at -1 for those that have none.
LEAST = 5e-324
_INFINITE = float("inf")
_BLOCK_PIECES = "symbol string, expiry_rank int, block long, from double, slope double, value double"


def held(h: float, raw: float, need: float, cap: float) -> float:
    """What one day makes of h."""
    half = max(min(raw, h * (1 + cap)), h * (1 - cap)) if h > 0 else raw
    return half if need <= half < _INFINITE else h


def day_pieces(pieces: list[tuple[float, float, float]], raw: float, need: float, cap: float) -> list[tuple[float, float, float]]:
    """The pieces (from, slope, value) of a map followed by one more day; slope 0 is a constant, else value is 0."""
    reach = need / (1 + cap) if need <= raw else need / (1 - cap) if cap < 1 else _INFINITE
    turns = sorted({raw / (1 + cap), raw / (1 - cap) if cap < 1 else _INFINITE, reach})
    out: list[tuple[float, float, float]] = []

    def add(start: float, slope: float, value: float) -> None:
        if not out or out[-1][1:] != (slope, value) or out[-1][0] < 0:
            out.append((start, slope, value))

    for (start, slope, value), end in zip(pieces, [p[0] for p in pieces[1:]] + [_INFINITE]):
        if slope == 0:
            add(start, 0.0, held(value, raw, need, cap))
            continue
        cuts = [start, *(t / slope for t in turns if start < t / slope < end)]
        for a, b in zip(cuts, [*cuts[1:], end]):
            x = (a + min(b, 2 * a + 1)) / 2 * slope  # a point within, to tell which of the cases holds
            half = held(x, raw, need, cap)
            if half == x:
                add(a, slope, 0.0)
            elif half == raw:
                add(a, 0.0, raw)
            else:
                add(a, slope * (1 + cap if half > x else 1 - cap), 0.0)
    return out


def _block_maps(days: DataFrame, cap: float) -> DataFrame:
    """(symbol, expiry_rank, block, from, slope, value): the map of each block, but for the last ones, which nothing follows."""
    earlier = days.withColumn("_last", F.max("block").over(Window.partitionBy(*SERIES))).filter("block < _last").drop("_last")

    def one(x: pd.DataFrame) -> pd.DataFrame:
        pieces = [(-1.0, 0.0, 0.0), (LEAST, 1.0, 0.0)]
        for r in x.sort_values("date").itertuples():
            pieces = day_pieces(pieces, r.raw, r.need, cap)
        key = [x[n].iloc[0] for n in (*SERIES, "block")]
        return pd.DataFrame([[*key, *p] for p in pieces])

    return earlier.groupBy(*SERIES, "block").applyInPandas(one, _BLOCK_PIECES.replace("from", "`from`"))


def _starts(maps: DataFrame, seeds: DataFrame) -> DataFrame:
    """(symbol, expiry_rank, block, start): the h after each block, from the series' seed on; an array of blocks for each series."""
    whole = maps.groupBy(*SERIES, "block").agg(F.array_sort(F.collect_list(F.struct("from", "slope", "value"))).alias("pieces"))
    series = whole.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("block", "pieces"))).alias("blocks")).join(seeds, SERIES)

    def after(a: Column, b: Column) -> Column:
        piece = F.element_at(F.filter(b["pieces"], lambda p: p["from"] <= a["half"]), -1)
        half = piece["slope"] * a["half"] + piece["value"]
        return F.struct(half.alias("half"), F.concat(a["out"], F.array(F.struct(b["block"].alias("block"), half.alias("start")))).alias("out"))

    start = F.struct(F.col("seed").alias("half"), F.array().cast("array<struct<block:bigint,start:double>>").alias("out"))
    return series.select(*SERIES, F.explode(F.aggregate("blocks", start, after, lambda a: a["out"])).alias("b")).select(*SERIES, "b.*")


def _walk(days: DataFrame, cap: float) -> DataFrame:
    """(symbol, expiry_rank, date, half) of the days that reach two strikes, each block from its start."""
    blocks = days.groupBy(*SERIES, "block").agg(F.array_sort(F.collect_list(F.struct("date", "raw", "need"))).alias("days"), F.max("start").alias("start"))

    def step(a: Column, d: Column) -> Column:
        half = F.when(a["half"] > 0, F.greatest(F.least(d["raw"], a["half"] * (1 + cap)), a["half"] * (1 - cap))).otherwise(d["raw"])
        reaches = (half >= d["need"]) & (half < _INFINITE)
        marked = F.concat(a["out"], F.array(F.struct(d["date"].alias("date"), half.alias("half"))))
        return F.struct(F.when(reaches, half).otherwise(a["half"]).alias("half"), F.when(reaches, marked).otherwise(a["out"]).alias("out"))

    start = F.struct(F.col("start").alias("half"), F.array().cast("array<struct<date:date,half:double>>").alias("out"))
    return blocks.select(*SERIES, F.explode(F.aggregate("days", start, step, lambda a: a["out"])).alias("h")).select(*SERIES, "h.*")


def follow(days: DataFrame, seeds: DataFrame, cap: float, block_days: int = 365) -> DataFrame:
    """(symbol, expiry_rank, date, half) of each day of (symbol, expiry_rank, date, raw, need) that reaches two strikes.

    raw is the day's own half range, without a bound where it is null; need is the half range that
    two strikes take, null where the day has fewer. seeds (symbol, expiry_rank, seed) say what a
    series goes on from; 0, null or no row: from nothing. A block is block_days of the calendar, so
    no task and no array ever holds a whole history; a history within one block needs no maps.
    """
    days = days.select(
        F.col("symbol").cast("string").alias("symbol"), F.col("expiry_rank").cast("int").alias("expiry_rank"), "date", F.floor(F.unix_date("date") / block_days).alias("block"),
        *(F.coalesce(F.col(n).cast("double"), F.lit(_INFINITE)).alias(n) for n in ("raw", "need")),
    )
    seeds = days.select(*SERIES).distinct().join(seeds.select(*SERIES, "seed"), SERIES, "left").select(*SERIES, F.coalesce("seed", F.lit(0.0)).alias("seed"))
    after = _starts(_block_maps(days, cap), seeds)
    # a block starts from what the last block before it ended with
    marks = days.select(*SERIES, "block").distinct().join(after, [*SERIES, "block"], "left").join(seeds, SERIES)
    begun = marks.select(*SERIES, "block", F.coalesce(F.lag("start").over(Window.partitionBy(*SERIES).orderBy("block")), "seed").alias("start"))
    return _walk(days.join(begun, [*SERIES, "block"]), cap)
