"""Shelves and walls of open interest, as windows over one ladder and side.

A wall is the strike of the most open interest among those a symbol prefers; its shelf is the run of
strikes around it, on the grid of the ladder, that hold a share of it. Each step is a window over the same
partition, the strikes of one ladder and side, so a ladder is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, SNAPSHOT, Params
from ..functions.expressions import buildup, is_index, ratio
from .screens import last_two

KEYS = list(SNAPSHOT)


def sides(chain: DataFrame, *more: str) -> DataFrame:
    """A row for each side of each row: symbol, more, strike_price, side, oi, oi_change, ltp; nulls count as 0."""
    number = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    one = lambda s: F.struct(F.lit(s.upper()).alias("side"), *(number(f"{s}_{n}").alias(n) for n in ("oi", "oi_change", "ltp")))
    return chain.withColumn("of", F.explode(F.array(one("ce"), one("pe")))).select("symbol", *more, "strike_price", "of.*")


def preferred(rows: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """The strikes a symbol prefers: an index those on its step if three are, else on its finer step if three are; a share the whole numbers if two are; else all."""
    w = Window.partitionBy(*keys)
    on = lambda step: F.abs(F.col("strike_price") - step * F.round(F.col("strike_price") / step)) < 1e-6
    enough = lambda step, least: F.count(F.when(on(step), 1)).over(w) >= least
    index = F.when(enough(p.index_step, 3), on(p.index_step)).when(enough(p.index_step_fallback, 3), on(p.index_step_fallback)).otherwise(True)
    share = F.when(enough(1.0, 2), on(1.0)).otherwise(True)
    return rows.withColumn("liked", F.when(is_index(F.col("symbol")), index).otherwise(share)).filter("liked").drop("liked")


def with_grid(rows: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """rows with wall (oi, strike), the lowest of several, and grid: the most frequent gap within grid_window strikes of the wall, the first of several; only ladders with open interest."""
    w = Window.partitionBy(*keys)
    by_strike = w.orderBy("strike_price")
    x = rows.withColumn("wall", F.max(F.struct("oi", (-F.col("strike_price")).alias("less"))).over(w)).filter("wall.oi > 0")
    x = x.withColumns({"wall_strike": -F.col("wall.less"), "wall_oi": F.col("wall.oi"), "place": F.row_number().over(by_strike), "gap": F.round(F.col("strike_price") - F.lag("strike_price").over(by_strike), 3)}).drop("wall")
    apart = F.col("place") - F.max(F.when(F.col("strike_price") == F.col("wall_strike"), F.col("place"))).over(w)
    x = x.withColumn("gap", F.when((apart > -p.grid_window) & (apart <= p.grid_window) & (F.col("gap") > 0), F.col("gap")))
    same = Window.partitionBy(*keys, "gap")
    x = x.withColumn("often", F.when(F.col("gap").isNotNull(), F.struct(F.count("*").over(same).alias("n"), (-F.min("place").over(same)).alias("early"), "gap")))
    return x.withColumn("grid", F.coalesce(F.max("often").over(w)["gap"], F.lit(0.0))).drop("often", "gap", "place")


def members(rows: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Of rows with a grid, the wall and the strikes of its shelf: each way from the wall until one holds too little, or more than max_skip grid places are empty."""
    steps = (F.col("strike_price") - F.col("wall_strike")) / F.when(F.col("grid") > 0, F.col("grid"))
    x = rows.withColumn("steps", F.round(steps)).filter((F.abs(steps - F.col("steps")) * F.col("grid") < 1e-6) | (F.col("strike_price") == F.col("wall_strike")))
    far, outwards = F.abs("steps"), Window.partitionBy(*keys, F.signum("steps")).orderBy(F.abs("steps"))
    ends = (far - F.lag(far, 1, 0.0).over(outwards) > p.max_skip + 1) | (F.col("oi") < p.oi_shelf_frac * F.col("wall_oi"))
    ended = F.max(F.coalesce(ends, F.lit(False))).over(outwards.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("ended", ended).filter(~F.col("ended") | (F.col("strike_price") == F.col("wall_strike"))).drop("ended", "steps")


def shelves(rows: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """(keys, wall_strike, wall_oi, lo, hi, oi, com, n_strikes, is_shelf, grid, members, oi_change, signal) from rows (keys, strike_price, oi, oi_change, moved).

    keys hold symbol and side. moved is the change of price; the signal takes its mean, weighted by
    open interest. A ladder without open interest has none.
    """
    x = members(with_grid(preferred(rows, keys, p), keys, p), keys, p)
    weighted = lambda n: F.sum(F.col(n) * F.col("oi")) / F.sum("oi")
    x = x.groupBy(*keys).agg(F.first("wall_strike").alias("wall_strike"), F.first("wall_oi").alias("wall_oi"), F.min("strike_price").alias("lo"), F.max("strike_price").alias("hi"), F.round(F.sum("oi"), 2).alias("total"), F.round(weighted("strike_price"), 2).alias("com"), F.count("*").alias("n_strikes"), F.first("grid").alias("grid"), F.array_join(F.array_sort(F.collect_list("strike_price")), ",").alias("members"), F.round(F.sum("oi_change"), 2).alias("oi_change"), weighted("moved").alias("moved"))
    return x.select(*keys, "wall_strike", "wall_oi", "lo", "hi", F.col("total").alias("oi"), "com", "n_strikes", (F.col("n_strikes") > 1).alias("is_shelf"), "grid", "members", "oi_change", buildup(F.col("oi_change"), F.col("moved")).alias("signal"))


def oi_shelves(chain: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The shelf of each side of each ladder, and migration, the move of its centre since the ladder's snapshot before.

    moved is against the symbol's snapshot before; a strike that was not listed then has not moved.
    Each strike looks back at its own last row, so the chain is not joined with itself.
    """
    times = chain.select("symbol", "timestamp").distinct().withColumn("earlier", F.lag("timestamp").over(Window.partitionBy("symbol").orderBy("timestamp")))
    strike = Window.partitionBy("symbol", "expiry", "strike_price").orderBy("timestamp")
    seen = F.lag("timestamp").over(strike) == F.col("earlier")
    ltp = lambda s: F.coalesce(F.col(f"{s}_ltp").cast("double"), F.lit(0.0))
    x = chain.join(times, ["symbol", "timestamp"]).withColumns({f"{s}_before": F.when(seen, F.lag(ltp(s)).over(strike)) for s in ("ce", "pe")})
    rows = sides(x, "expiry", "timestamp", "ce_before", "pe_before").withColumn("before", F.when(F.col("side") == "CE", F.col("ce_before")).otherwise(F.col("pe_before")))
    rows = rows.drop("ce_before", "pe_before").withColumn("moved", F.col("ltp") - F.coalesce("before", "ltp"))
    found = shelves(rows, [*KEYS, "side"], p)
    series = Window.partitionBy("symbol", "expiry", "side").orderBy("timestamp")
    return found.withColumn("migration", F.round(F.col("com") - F.lag("com").over(series), 2))


def oi_walls(chain: DataFrame, as_of: str, expiry: str | None = None, kind: str = "all", p: Params = DEFAULTS) -> DataFrame:
    """Each symbol's nearest live expiry, or a given one, at its last snapshot: both walls with their shelves, how far they lie from spot and future, and the strike of the most gamma.

    gamma_diverges is whether that strike is not the call wall's. A symbol with only one side has no row.
    """
    live = (F.col("expiry") >= F.lit(as_of).cast("date")) if expiry is None else F.col("expiry") == F.lit(expiry).cast("date")
    x = chain.filter(live & ((F.col("ce_oi") > 0) | (F.col("pe_oi") > 0)))
    x = x if kind == "all" else x.filter(is_index(F.col("symbol")) == F.lit(kind == "index"))
    x = last_two(x, "symbol")
    x = x.withColumn("front", F.min(F.when(F.col("rk") == 1, F.col("expiry"))).over(Window.partitionBy("symbol"))).filter("expiry = front")
    ladder = ["symbol", "expiry"]
    both = sides(x, "expiry", "rk").groupBy(*ladder, "side", "strike_price").agg(*(F.max(F.when(F.col("rk") == 1, F.col(n))).alias(n) for n in ("oi", "oi_change", "ltp")), F.max(F.when(F.col("rk") == 2, F.col("ltp"))).alias("before")).filter("oi IS NOT NULL")
    found = shelves(both.withColumn("moved", F.col("ltp") - F.coalesce("before", "ltp")), [*ladder, "side"], p)
    named = {"wall_strike": "wall", "wall_oi": "wall_oi", "lo": "shelf_lo", "hi": "shelf_hi", "oi": "shelf_oi", "com": "shelf_com", "n_strikes": "shelf_n", "is_shelf": "is_shelf", "members": "members", "oi_change": "oi_chg", "signal": "signal"}
    of = lambda s: found.filter(F.col("side") == s.upper()).select(*ladder, *(F.col(n).alias(f"{s}_{m}") for n, m in named.items()))
    return of("ce").join(of("pe"), ladder).join(_totals(x.filter("rk = 1"), ladder), ladder).select("symbol", "expiry", "spot", "fut_price", *(f"{s}_{m}" for s in ("ce", "pe") for m in named.values()), *_distances())


def _totals(now: DataFrame, ladder: list[str]) -> DataFrame:
    most = F.max(F.struct(F.round(F.abs("net_gexv"), 6).alias("size"), (-F.col("strike_price")).alias("less"), "net_gexv"))
    mean = lambda s: F.avg(F.when(F.col(f"{s}_oi") > 0, F.col(f"{s}_oi"))).alias(f"{s}_mean")
    x = now.groupBy(*ladder).agg(F.max("underlying_price").alias("spot"), F.max("fut_price").alias("fut_price"), most.alias("most"), mean("ce"), mean("pe"), F.round(ratio(F.sum("pe_oi"), F.sum("ce_oi")), 3).alias("pcr"))
    has = F.col("most.size") > 0
    return x.withColumns({"gamma_wall": F.when(has, -F.col("most.less")), "gamma_wall_value": F.when(has, F.round("most.net_gexv", 2))}).drop("most")


def _distances() -> list[Column]:
    c, p = F.col("ce_wall"), F.col("pe_wall")
    strength = lambda s: F.round(ratio(F.col(f"{s}_wall_oi"), F.col(f"{s}_mean")), 1).alias(f"{s}_strength")
    away = {"ce_dist_spot": c - F.col("spot"), "pe_dist_spot": F.col("spot") - p, "ce_dist_fut": c - F.col("fut_price"), "pe_dist_fut": F.col("fut_price") - p, "wall_range": c - p}
    return [*(x.alias(n) for n, x in away.items()), strength("ce"), strength("pe"), F.col("pcr"), F.col("gamma_wall"), F.col("gamma_wall_value"), F.coalesce(F.abs(F.col("gamma_wall") - c) > 1e-6, F.lit(False)).alias("gamma_diverges")]
