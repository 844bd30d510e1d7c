"""Measures of one ladder of strikes, as windows and aggregates over rows (keys, strike_price, ...).

A ladder is the strikes of one symbol, expiry and timestamp: a few hundred rows at most, so one
group is small at any size of the table and all ladders are worked out at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, SNAPSHOT
from ..functions.expressions import dealer_divergence, ratio

KEYS = list(SNAPSHOT)


def net_gamma(lot="lotsize") -> Column:
    return (F.col("ce_gamma") * F.col("ce_oi") - F.col("pe_gamma") * F.col("pe_oi")) * F.col(lot)


def strike_interval(chain: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, strike_interval): the median gap between different strikes, 0 for fewer than two."""
    w = Window.partitionBy(*keys).orderBy("strike_price")
    gaps = chain.select(*keys, "strike_price").distinct().withColumn("gap", F.col("strike_price") - F.lag("strike_price").over(w))
    return gaps.groupBy(*keys).agg(F.coalesce(F.median("gap"), F.lit(0.0)).alias("strike_interval"))


def gamma_flip(ladder: DataFrame, keys=KEYS, ref: str = "fut_price", band: float = DEFAULTS.neutral_band) -> DataFrame:
    """(keys, gamma_flip, flip_nearest, transition_width, gex_regime, net_gex_norm, neg_gamma_fraction) from columns strike_price and g.

    The flip is the change of sign nearest to ref, between strikes in proportion to g; touching
    zero is a change of sign. The regime is that of g at ref, mixed within band of all absolute g.
    """
    w = Window.partitionBy(*keys).orderBy("strike_price")
    k, g, k2, g2, r = (F.col(x) for x in ("strike_price", "g", "k2", "g2", "ref"))
    x = ladder.select(*keys, "strike_price", "g", F.col(ref).alias("ref")).withColumns({"k2": F.lead("strike_price").over(w), "g2": F.lead("g").over(w)})
    flip = F.when(F.abs(g2 - g) < 1e-12, k).otherwise(k - g * (k2 - k) / F.when(g2 != g, g2 - g))
    x = x.withColumn("flip", F.when(F.signum(g) != F.signum(g2), flip))
    best = F.min(F.when(F.col("flip").isNotNull(), F.struct(F.abs(F.col("flip") - r).alias("d"), k.alias("k"), F.col("flip").alias("flip"), (k2 - k).alias("width")))).alias("best")
    at_ref = F.max(F.when((k <= r) & (k2 > r), g + (r - k) * (g2 - g) / (k2 - k))).alias("inside")
    out = x.groupBy(*keys).agg(best, at_ref, F.min_by("g", "strike_price").alias("first"), F.max_by("g", "strike_price").alias("last"), F.min("strike_price").alias("low"), F.first("ref").alias("ref"), F.sum(F.abs(g)).alias("gross"), F.sum("g").alias("net"), F.min("g").alias("least"), F.max("g").alias("most"), F.avg((g < 0).cast("double")).alias("below"), F.count("*").alias("n"), F.collect_list("strike_price").alias("strikes"))
    here = F.coalesce("inside", F.when(F.col("ref") < F.col("low"), F.col("first")).otherwise(F.col("last")))
    crossed = F.col("best").isNotNull()
    regime = F.when(F.col("n") < 2, "insufficient").when(~crossed & (F.col("least") >= 0), "all_positive").when(~crossed & (F.col("most") <= 0), "all_negative").when(F.abs(here) <= F.col("gross") * band, "mixed").when(here > 0, "positive").otherwise("negative")
    out = out.withColumns({"gamma_flip": F.round("best.flip", 2), "gex_regime": regime})
    nearest = F.array_min(F.transform("strikes", lambda s: F.struct(F.abs(s - F.col("gamma_flip")).alias("d"), s.alias("k"))))["k"]
    return out.select(*keys, "gamma_flip", F.when(crossed, nearest).alias("flip_nearest"), F.col("best.width").alias("transition_width"), "gex_regime", F.when(F.col("gross") > 1e-9, F.round(F.col("net") / F.col("gross"), 4)).otherwise(0.0).alias("net_gex_norm"), F.round("below", 4).alias("neg_gamma_fraction"))


def gamma_shelf(ladder: DataFrame, keys=KEYS, frac: float = DEFAULTS.shelf_frac) -> DataFrame:
    """(keys, center, width, peak_strike, peak_value, lo, hi, concentration): strikes around the greatest absolute g that keep frac of it; none without g."""
    w = Window.partitionBy(*keys)
    x = ladder.select(*keys, "strike_price", "g", F.abs("g").alias("a"))
    x = x.withColumn("peak", F.max(F.struct("a", (-F.col("strike_price")).alias("s"), "g")).over(w)).filter(F.col("peak.a") > 0).withColumn("at", -F.col("peak.s"))
    low = F.col("a") < F.col("peak.a") * frac
    k, at = F.col("strike_price"), F.col("at")
    x = x.withColumns({"lower": F.max(F.when(low & (k < at), k)).over(w), "upper": F.min(F.when(low & (k > at), k)).over(w), "all": F.sum("a").over(w)})
    x = x.filter((F.col("lower").isNull() | (k > F.col("lower"))) & (F.col("upper").isNull() | (k < F.col("upper"))))
    com = F.sum(k * F.col("a")) / F.sum("a")
    return x.groupBy(*keys).agg(com.alias("center_exact"), F.round(com, 2).alias("center"), F.count("*").alias("width"), F.max("at").alias("peak_strike"), F.round(F.max("peak.g"), 4).alias("peak_value"), F.min(k).alias("lo"), F.max(k).alias("hi"), F.round(F.max("peak.a") / F.max("all"), 4).alias("concentration"))


def oi_center(chain: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, oi_com): centre of calls' and puts' open interest, null without any."""
    oi = F.col("ce_oi") + F.col("pe_oi")
    return chain.groupBy(*keys).agg(F.when(F.sum(oi) > 0, F.round(ratio(F.sum(F.col("strike_price") * oi), F.sum(oi)), 2)).alias("oi_com"))


def divergence_of_centers(chain: DataFrame, move: Column, keys=KEYS) -> DataFrame:
    """(keys, gap, label): centre of the gamma shelf less that of open interest, in expected moves."""
    ladder = chain.withColumn("g", net_gamma())
    moves = chain.groupBy(*keys).agg(F.max(move).alias("move"))
    both = gamma_shelf(ladder, keys).join(oi_center(chain, keys), keys).join(moves, keys)
    gap = ratio(F.col("center") - F.col("oi_com"), F.when(F.col("move") > 0, F.col("move")))
    return both.select(*keys, F.round(gap, 4).alias("gap"), dealer_divergence(gap).alias("label"))


def pain(chain: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, strike_price, pain): what writers would pay at each strike, from running sums instead of a self-join."""
    w = Window.partitionBy(*keys).orderBy("strike_price")
    below, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    k, ce, pe = F.col("strike_price"), F.col("ce_oi") * F.col("lotsize"), F.col("pe_oi") * F.col("lotsize")
    calls = k * F.sum(ce).over(below) - F.sum(k * ce).over(below)
    puts = F.sum(k * pe).over(above) - k * F.sum(pe).over(above)
    return chain.select(*keys, "strike_price", (calls + puts).alias("pain"))


def max_pain(chain: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, max_pain): the strike of least pain, the lowest of several."""
    return pain(chain, keys).groupBy(*keys).agg(F.min(F.struct(F.round("pain", 2), "strike_price"))["strike_price"].alias("max_pain"))


def analysis_range(spot: Column, move: Column, buffer_pct: float = 0.5, max_pct: float = 15.0) -> tuple[Column, Column]:
    """Bounds of the strikes to look at: an expected move and a buffer, capped."""
    half = F.least(move + spot * (buffer_pct / 100), spot * (max_pct / 100))
    return spot - half, spot + half


def gamma_profile(chain: DataFrame, keys=KEYS, levels: int = 200, bounds: tuple[str, str] | None = None) -> DataFrame:
    """(keys, level, price, call, put, total, near_strike): gamma in billions of the strike nearest to each of so many prices from the lowest to the highest strike.

    bounds names two columns, equal in all rows of a ladder, to take the prices from instead. Of two
    strikes equally near the lower one counts, of rows of one strike that of the least call, then
    put. Prices are put among the strikes, and each sees the last strike below and the first one
    above it by running windows that share the ladder's partitioning.
    """
    w = Window.partitionBy(*keys)
    lot, k = F.col("lotsize"), F.col("strike_price")
    at = F.struct(k.alias("k"), (F.col("ce_gamma") * F.col("ce_oi") * lot / 1e9).alias("call"), (-F.col("pe_gamma") * F.col("pe_oi") * lot / 1e9).alias("put"))
    lo, hi = (F.col(n) for n in bounds) if bounds else (k, k)
    rows = chain.select(*keys, at.alias("strike"), F.min(lo).over(w).alias("lo"), F.max(hi).over(w).alias("hi"), F.row_number().over(w.orderBy(k)).alias("nth"))
    place = lambda level, price, strike: F.struct(level.cast("int").alias("level"), price.cast("double").alias("price"), strike.alias("strike"))
    none = F.lit(None).cast(rows.schema["strike"].dataType)
    prices = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: place(i, F.col("lo") + (F.col("hi") - F.col("lo")) * i / (levels - 1), none))
    own = F.array(place(F.lit(None), F.col("strike.k"), F.col("strike")))
    x = rows.select(*keys, F.explode(F.when(F.col("nth") == 1, F.concat(own, prices)).otherwise(own)).alias("p")).select(*keys, "p.*")
    down = F.struct(F.col("strike.k").alias("k"), (-F.col("strike.call")).alias("call"), (-F.col("strike.put")).alias("put"))
    x = x.withColumns({"below": F.max(F.when(F.col("strike").isNotNull(), down)).over(w.orderBy("price")), "above": F.min("strike").over(w.orderBy(F.desc("price")))}).filter("level IS NOT NULL")
    away = lambda n: F.round(F.abs(F.col(f"{n}.k") - F.col("price")), 9)
    lower = F.col("below").isNotNull() & (F.col("above").isNull() | (away("below") <= away("above")))
    near = F.when(lower, F.struct(F.col("below.k").alias("k"), (-F.col("below.call")).alias("call"), (-F.col("below.put")).alias("put"))).otherwise(F.col("above"))
    x = x.withColumn("near", near)
    return x.select(*keys, "level", "price", "near.call", "near.put", (F.col("near.call") + F.col("near.put")).alias("total"), F.col("near.k").alias("near_strike"))


def magnet(profile: DataFrame, keys=KEYS, share: float = 0.75) -> DataFrame:
    """(keys, lower, upper, center, strength): prices whose total reaches share of the greatest, where that is positive."""
    x = profile.withColumn("most", F.max("total").over(Window.partitionBy(*keys))).filter((F.col("most") > 0) & (F.col("total") >= share * F.col("most")))
    return x.groupBy(*keys).agg(F.min("price").alias("lower"), F.max("price").alias("upper"), F.max(F.struct("total", (-F.col("price")).alias("p")))["p"].alias("p"), F.max("most").alias("strength")).select(*keys, "lower", "upper", (-F.col("p")).alias("center"), "strength")
