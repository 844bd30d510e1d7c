"""Clusters of open interest along a ladder, and their tracks from one time to the next, as columns and joins.

A ladder is one symbol, expiry and timestamp: its few hundred strikes are numbered by a window, and
one aggregation over the same partitioning makes an array of them, in which peaks look for what
stands around them. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SNAPSHOT
from ..sources.store import stored

KEYS = list(SNAPSHOT)


def time_value_oi(side: str) -> Column:
    """Open interest times what of the price is no intrinsic value."""
    return F.coalesce(F.col(f"{side}_time_value") * F.col(f"{side}_oi"), F.lit(0.0))


def smoothed(rows: DataFrame, keys=KEYS, smoothing: int = 3) -> DataFrame:
    """rows (keys, k, w) with their number i from 0, the number n of their ladder's rows, and y: the mean of w over so many rows around; the end rows stand for what would lie beyond them.

    Ladders shorter than smoothing keep w. Rows of one strike are in order of their weight.
    """
    w = Window.partitionBy(*keys).orderBy("k", "w")
    whole = Window.partitionBy(*keys).orderBy("k", "w").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "first": F.first("w").over(whole), "last": F.last("w").over(whole)})
    around = [F.coalesce(F.lag("w", -o).over(w), F.col("first" if o < 0 else "last")) for o in range(-(smoothing // 2), smoothing - smoothing // 2)]
    total = around[0]
    for value in around[1:]:
        total = total + value
    y = F.when((F.lit(smoothing) > 1) & (F.col("n") >= smoothing), total / smoothing).otherwise(F.col("w"))
    return rows.withColumn("y", y).drop("first", "last")


def plateaus(rows: DataFrame, keys=KEYS) -> DataFrame:
    """rows with top: true for the middle (the left one of two) of equal y's that are higher than both neighbours."""
    w = Window.partitionBy(*keys).orderBy("i")
    before, after = F.lag("y").over(w), F.lead("y").over(w)
    forward = w.rowsBetween(0, Window.unboundedFollowing)
    # the last start of a run of equal values up to a row, and the first end from it
    rows = rows.withColumns({"b": F.when(before.isNull() | (before != F.col("y")), F.struct("i", (before < F.col("y")).alias("up"))), "e": F.when(after.isNull() | (after != F.col("y")), F.struct("i", (after < F.col("y")).alias("down")))})
    rows = rows.withColumns({"b": F.last("b", ignorenulls=True).over(w), "e": F.first("e", ignorenulls=True).over(forward)})
    return rows.withColumn("top", F.coalesce(F.col("b.up"), F.lit(False)) & F.coalesce(F.col("e.down"), F.lit(False)) & (F.col("i") == F.floor((F.col("b.i") + F.col("e.i")) / 2))).drop("b", "e")


def _apart(tops: Column, distance: Column) -> Column:
    """Of the peaks (-y, -i), in order, those that are so far from all kept before them."""
    keep = lambda kept, t: F.when(F.exists(kept, lambda o: F.abs(o["back"] - t["back"]) < distance), kept).otherwise(F.concat(kept, F.array(t)))
    return F.aggregate(tops, F.array().cast("array<struct<fall:double,back:int>>"), keep)


def _base(side: Column, y: Column) -> Column:
    """The lowest of y and the values of a side, nearest first, up to the first that is higher than y."""
    walk = lambda a, v: F.struct(F.when(a["open"] & (v <= y), F.least(a["low"], v)).otherwise(a["low"]).alias("low"), (a["open"] & (v <= y)).alias("open"))
    return F.aggregate(side, F.struct(y.alias("low"), F.lit(True).alias("open")), walk, lambda a: a["low"])


def _stands_out(rungs: Column, i: Column, prominence: Column) -> Column:
    """Whether the peak at i is so much higher than the higher of the two lowest places before something higher on either side."""
    ys = F.transform(rungs, lambda r: r["y"])
    y = F.get(ys, i)
    left, right = F.reverse(F.slice(ys, 1, i)), F.slice(ys, i + 2, F.size(ys))
    return y - F.greatest(_base(left, y), _base(right, y)) >= prominence


def clusters(chain: DataFrame, side: str = "ce", keys=KEYS, smoothing: int = 3, prominence_pct: float = 10.0) -> DataFrame:
    """(keys, center_strike, peak_strike, min_strike, max_strike, weight, concentration, members): bands of open interest, weighted by time value, around its peaks.

    Not by the whole premium: what options deep in the money are worth at once would draw the bands to them.

    Peaks of the smoothed curve are a twentieth of the ladder's rows apart, the highest first, and
    stand out by a share of the greatest value; without any, the greatest value is one. A band ends
    where the curve falls under a tenth of its peak or half way to the next peak. Ladders of fewer
    than three strikes or without weight have none, nor has a band without weight.
    """
    rows = plateaus(smoothed(chain.select(*keys, F.col("strike_price").cast("double").alias("k"), time_value_oi(side).alias("w")), keys, smoothing), keys)
    rung = F.struct("i", "k", "w", "y")
    ladders = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(rung)).alias("rungs"), F.max("y").alias("most"), F.max_by("i", F.struct("y", -F.col("i"))).alias("highest"), F.sum("w").alias("all"), F.max("n").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("top"), F.struct((-F.col("y")).alias("fall"), (-F.col("i")).alias("back"))))).alias("tops"),
    ).filter("n >= 3 AND all <> 0")
    apart = F.transform(_apart(F.col("tops"), F.greatest(F.floor(F.col("n") / 20), F.lit(1))), lambda t: -t["back"])
    ladders = ladders.withColumn("apart", apart)
    prominent = F.array_sort(F.filter("apart", lambda i: _stands_out(F.col("rungs"), i, F.col("most") * prominence_pct / 100)))
    ladders = ladders.withColumn("peaks", prominent).withColumn("peaks", F.when(F.size("peaks") > 0, F.col("peaks")).otherwise(F.array("highest")))
    x = ladders.select(*keys, "rungs", "n", "peaks", F.posexplode("peaks").alias("at", "peak"))
    middle = lambda a, b: F.floor((a + b) / 2).cast("int")
    x = x.withColumns({
        "left": F.coalesce(middle(F.get("peaks", F.col("at") - 1), F.col("peak")), F.lit(0)), "right": F.coalesce(middle(F.col("peak"), F.get("peaks", F.col("at") + 1)), F.col("n").cast("int") - 1),
        "weak": F.transform(F.filter("rungs", lambda r: r["y"] < F.get("rungs", F.col("peak"))["y"] / 10), lambda r: r["i"]),
    })
    low, high = F.array_max(F.filter("weak", lambda i: (i >= F.col("left")) & (i < F.col("peak")))) + 1, F.array_min(F.filter("weak", lambda i: (i > F.col("peak")) & (i <= F.col("right")))) - 1
    x = x.withColumns({"lo": F.greatest("left", low), "hi": F.least("right", high)})
    x = x.withColumn("own", F.slice("rungs", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    weight = total(F.transform("own", lambda r: r["w"]))
    x = x.withColumns({"weight": weight, "moment": total(F.transform("own", lambda r: r["k"] * r["w"])), "greatest": total(F.slice(F.sort_array(F.transform("own", lambda r: r["w"]), asc=False), 1, 3))}).filter("weight > 0")
    strike = lambda n: F.get("rungs", F.col(n))["k"]
    return x.select(*keys, F.round(F.col("moment") / F.col("weight"), 1).alias("center_strike"), strike("peak").alias("peak_strike"), strike("lo").alias("min_strike"), strike("hi").alias("max_strike"),
        F.round("weight", 2).alias("weight"), F.round(F.col("greatest") / F.col("weight"), 4).alias("concentration"), (F.col("hi") - F.col("lo") + 1).cast("long").alias("members"))


def _linked(rows: DataFrame, series: list[str], tolerance_pct: float) -> DataFrame:
    """(series, id, up, gained): the nearest cluster of the time before, within the tolerance, and the weight since; the row itself and 0 without one."""
    now, then = rows.alias("n"), rows.select(*(F.col(s).alias(f"_{s}") for s in series), (F.col("t") + 1).alias("_t"), F.col("id").alias("_id"), F.col("center_strike").alias("_c"), F.col("weight").alias("_w"))
    same = [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in series]
    away = F.abs(F.col("center_strike") - F.col("_c"))
    met = now.join(then, [*same, F.col("t") == F.col("_t"), away < F.col("spot") * tolerance_pct / 100])
    nearest = met.groupBy(*series, "id").agg(F.min(F.struct(away.alias("away"), F.col("_id").alias("id"), (F.col("weight") - F.col("_w")).alias("gained"))).alias("best"))
    return nearest.select(*series, "id", F.col("best.id").alias("up"), F.col("best.gained").alias("gained"))


def _roots(links: DataFrame, series: list[str]) -> DataFrame:
    """(series, id, up) with up led back to the first of its track: each round doubles how far a row sees, so a series of n times takes log2(n) rounds."""
    x = links
    while True:
        beyond = x.select(*(F.col(s).alias(f"_{s}") for s in series), F.col("id").alias("_id"), F.col("up").alias("_up"))
        found = x.join(beyond, [*(F.col(s).eqNullSafe(F.col(f"_{s}")) for s in series), F.col("up") == F.col("_id")], "left")
        x = stored(found.select(*series, "id", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("moved")))
        if x.filter("moved").isEmpty():
            return x.drop("moved")


def tracks(found: DataFrame, spots: DataFrame, tolerance_pct: float = 2.0, series: tuple[str, ...] = ("symbol", "expiry")) -> DataFrame:
    """(series, timestamp, center_strike, weight, track, status, velocity): clusters followed from one time of their series to the next.

    spots has (symbol, expiry, timestamp, spot). A cluster goes on the track of the nearest cluster
    of the time before within tolerance_pct of spot (the lower one of two), else starts one; the
    first of a track is EMERGING, the later ones TRACKED, and the last, if others come after its
    time, DISSOLVED. Tracks are numbered by their first time, then by strike. Consecutive times are
    joined, and links led back by doubling: no task holds a whole history.
    """
    series = list(series)
    of = lambda *order: Window.partitionBy(*series).orderBy(*order)
    rows = found.select(*series, "timestamp", "center_strike", "weight").join(spots.select(*KEYS, "spot"), KEYS)
    rows = stored(rows.withColumns({"id": F.row_number().over(of("timestamp", "center_strike", "weight")), "t": F.dense_rank().over(of("timestamp"))}))
    links = stored(_linked(rows, series, tolerance_pct))
    led = _roots(links.select(*series, "id", "up"), series).withColumnRenamed("up", "root")
    x = rows.join(links.select(*series, "id", "gained"), [*series, "id"], "left").join(led, [*series, "id"], "left").withColumn("root", F.coalesce("root", "id"))
    x = x.withColumns({"track": F.dense_rank().over(of("root")).cast("long"), "end": F.max("t").over(Window.partitionBy(*series))})
    goes_on = F.count("*").over(Window.partitionBy(*series, "track").orderBy("t").rangeBetween(1, 1)) > 0
    status = F.when((F.col("t") < F.col("end")) & ~goes_on, "DISSOLVED").when(F.col("gained").isNotNull(), "TRACKED").otherwise("EMERGING")
    return x.select(*series, "timestamp", "center_strike", "weight", "track", status.alias("status"), F.coalesce("gained", F.lit(0.0)).alias("velocity"))
