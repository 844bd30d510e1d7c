"""The end-of-day table: a row for each symbol, day and expiry rank, in two stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, NEGATIVE, POSITIVE, SEVERITY, SIGNAL_WORDS, Params
from ..functions import narratives as words
from ..functions.expressions import basis, chosen, confidence, dealer_divergence, expected_move, hold_probability, in_deadzone, ratio, regime_color, regime_order, signals, strength
from ..operators.clamp import follow
from ..operators.ladder import gamma_flip, gamma_shelf, net_gamma, oi_center, strike_interval
from ..operators.screens import liquid
from ..sources.ocdata import latest
from ..sources.store import stored

KEYS = ["symbol", "date", "expiry_rank"]


def _series() -> Window:
    """The rows of one symbol and rank, by day."""
    return Window.partitionBy("symbol", "expiry_rank").orderBy("date")


def monthly(chain: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(symbol, date, expiry, expiry_rank): of each day's last expiries of a month, the first more than dte_exclude days away and the next."""
    x = chain.select("symbol", F.to_date("timestamp").alias("date"), "expiry").distinct().filter("expiry >= date")
    x = x.groupBy("symbol", "date", F.trunc("expiry", "month").alias("month")).agg(F.max("expiry").alias("expiry")).filter(F.datediff("expiry", "date") > p.dte_exclude)
    rank = F.row_number().over(Window.partitionBy("symbol", "date").orderBy("expiry")) - 1
    return x.withColumn("expiry_rank", rank).filter("expiry_rank <= 1").select("symbol", "date", "expiry", "expiry_rank")


def ewma(values: Column, span: int) -> Column:
    """Weighted mean of an array whose last value weighs most."""
    keep = 1 - 2 / (span + 1)
    pair = lambda a, v: F.struct((a["s"] * keep + v).alias("s"), (a["w"] * keep + 1).alias("w"))
    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), pair, lambda a: F.when(a["w"] > 0, a["s"] / a["w"]))


def day_ladders(chain: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The last snapshot of each day's near and next expiry, liquid rows only, three at least."""
    x = chain.withColumn("date", F.to_date("timestamp")).join(monthly(chain, p), ["symbol", "date", "expiry"])
    x = liquid(latest(x, "symbol", "date", "expiry"), p.spread_max_pct)
    return x.withColumn("rows", F.count("*").over(Window.partitionBy(*KEYS))).filter("rows >= 3").drop("rows")


def _heads(rows: DataFrame) -> DataFrame:
    """(keys, expiry, fut_price, spot, dte, iv_exact, second) of each day's ladder; iv_exact is that at the money or nearest to it, second how far the second nearest strike is from the future."""
    near = F.min(F.struct(F.abs("distance_from_atm"), "strike_price", "ce_iv"))["ce_iv"]
    x = rows.groupBy(*KEYS).agg(
        F.first("expiry").alias("expiry"), F.median("fut_price").alias("fut_price"), F.round(F.median("underlying_price"), 2).alias("spot"),
        F.median("days_to_expiry").alias("dte"), F.greatest(near, F.lit(0.0)).alias("iv_exact"), F.collect_list("strike_price").alias("strikes"),
    )
    away = F.array_sort(F.transform("strikes", lambda s: F.abs(s - F.col("fut_price"))))
    return x.withColumn("second", F.get(away, F.lit(1))).drop("strikes")


def _smoothed(heads: DataFrame, before: DataFrame | None, p: Params) -> DataFrame:
    """heads with atm_iv_smoothed, from the last values above 0 up to each day; those of before count too."""
    n = p.iv_smooth_span * 3
    x = heads.withColumn("_new", F.lit(True))
    if before is not None:
        latest_first = Window.partitionBy("symbol", "expiry_rank").orderBy(F.desc("date"))
        known = before.filter("iv_exact > 0").withColumn("_n", F.row_number().over(latest_first)).filter(F.col("_n") <= n)
        x = x.unionByName(known.select(*KEYS, "iv_exact", F.lit(False).alias("_new")), allowMissingColumns=True)
    above = F.col("iv_exact") > 0
    last = F.collect_list("iv_exact").over(Window.partitionBy("symbol", "expiry_rank", above).orderBy("date").rowsBetween(1 - n, 0))
    values = F.last(F.when(above, last), ignorenulls=True).over(_series())
    return x.withColumn("atm_iv_smoothed", F.coalesce(ewma(values, p.iv_smooth_span), "iv_exact")).filter("_new").drop("_new")


def _halves(x: DataFrame, before: DataFrame | None, p: Params) -> DataFrame:
    """(keys, range_half): each day's half range follows the day before within range_change_cap; a day with fewer than two strikes in range leaves no mark."""
    raw = F.least(F.col("expected_move") + p.strike_buffer * F.col("strike_interval"), F.col("fut_price") * (p.max_range_pct / 100))
    if before is None:
        seeds = x.select("symbol", "expiry_rank", F.lit(0.0).alias("seed")).distinct()
    else:
        seeds = before.groupBy("symbol", "expiry_rank").agg(F.max_by("range_half", "date").alias("seed"))
    return follow(x.select(*KEYS, raw.alias("raw"), F.col("second").alias("need")), seeds, p.range_change_cap).withColumnRenamed("half", "range_half")


def ranges(rows: DataFrame, p: Params = DEFAULTS, before: DataFrame | None = None) -> DataFrame:
    """(keys, expiry, fut_price, spot, dte, iv_exact, atm_iv_smoothed, expected_move, strike_interval, range_half): the range of strikes to look at."""
    x = _smoothed(_heads(rows), before, p)
    x = x.withColumn("expected_move", expected_move(F.col("fut_price"), F.col("atm_iv_smoothed"), F.col("dte"))).join(strike_interval(rows, KEYS), KEYS)
    x = stored(x)
    return x.drop("second").join(_halves(x, before, p), KEYS)


def stage1(chain: DataFrame, p: Params = DEFAULTS, before: DataFrame | None = None) -> DataFrame:
    """The row of each symbol, day and expiry rank, from its own ladder and the day before.

    before are rows of an earlier run, all of them older than the chain: a run over new days goes
    on where that one ended, and gives what one run over all days gives. A day without a row
    leaves its volatility out of later smoothing then.
    """
    rows = stored(day_ladders(chain, p))
    head = stored(ranges(rows, p, before))
    inside = _inside(rows, head)
    x = head.join(_sums(inside), KEYS)
    x = x.join(gamma_flip(inside.withColumn("fut", F.col("mid")), KEYS, "fut", p.neutral_band), KEYS)
    x = x.join(oi_center(inside, KEYS).withColumnRenamed("oi_com", "oi_com_inrange"), KEYS).join(_shelf(inside, p), KEYS, "left")
    return _against_day_before(stored(_normalised(x)), before)


def _inside(rows: DataFrame, head: DataFrame) -> DataFrame:
    """The strikes within each day's range, with mid, lot and net gamma g."""
    near = F.col("strike_price").between(F.col("mid") - F.col("range_half"), F.col("mid") + F.col("range_half"))
    x = rows.join(head.select(*KEYS, "range_half", F.col("fut_price").alias("mid")), KEYS).filter(near)
    return stored(x.withColumn("lot", F.median("lotsize").over(Window.partitionBy(*KEYS))).withColumn("g", net_gamma("lot")))


def _sums(inside: DataFrame) -> DataFrame:
    oi, s = F.col("ce_oi") + F.col("pe_oi"), F.col("strike_price")
    top, low = F.max(F.struct("g", (-s).alias("s"))), F.min(F.struct("g", s.alias("s")))
    turned = F.sum(F.abs("ce_oi_change")) + F.sum(F.abs("pe_oi_change"))
    return inside.groupBy(*KEYS).agg(
        F.round(F.sum("net_gexv") / 1e6, 4).alias("net_gex"), *(F.round(F.sum(f"{n}_ex"), 2).alias(n) for n in ("ce_vanna", "pe_vanna", "net_vanna", "net_charm")),
        F.sum(oi).alias("total_oi_in_range"), F.round(turned / F.greatest(F.sum(oi), F.lit(1.0)), 4).alias("oi_turnover_ratio"), F.count("*").alias("n_strikes"),
        F.when(top["g"] > 0, -top["s"]).alias("peak_pos_gamma_strike"), F.when(low["g"] < 0, low["s"]).alias("peak_neg_gamma_strike"),
    )


def _shelf(inside: DataFrame, p: Params) -> DataFrame:
    named = {"center": "gamma_shelf_center", "width": "gamma_shelf_width", "peak_strike": "gamma_shelf_peak_strike", "peak_value": "gamma_shelf_peak_value", "concentration": "concentration"}
    return gamma_shelf(inside, KEYS, p.shelf_frac).select(*KEYS, "center_exact", *(F.col(a).alias(b) for a, b in named.items()))


def _normalised(x: DataFrame) -> DataFrame:
    """x with distances in expected moves, basis, confidence and rounded prices."""
    em = F.when(F.col("expected_move") > 0, F.col("expected_move"))
    gap = (F.col("gamma_shelf_center") - F.col("oi_com_inrange")) / em
    x = x.withColumns({"flip_norm_distance": F.round((F.col("gamma_flip") - F.col("fut_price")) / em, 4), "transition_width_norm": F.round(F.col("transition_width") / em, 4), "b": basis(F.col("fut_price"), F.col("spot"), F.col("dte")), "dealer_divergence": F.round(gap, 4), "dealer_divergence_label": dealer_divergence(gap)})
    x = x.withColumns({"atm_iv": F.round("iv_exact", 2), "confidence": confidence(F.col("total_oi_in_range"), F.col("n_strikes"), F.col("transition_width_norm")), "range_lo": F.round(F.col("fut_price") - F.col("range_half"), 2), "range_hi": F.round(F.col("fut_price") + F.col("range_half"), 2)})
    x = x.withColumns({n: F.round(n, 2) for n in ("atm_iv_smoothed", "fut_price", "expected_move")} | {"range_half": F.round("range_half", 9)})
    return x.select("*", "b.*").drop("b").withColumn("dte", F.col("dte").cast("int")).withColumn("net_gex_sign", F.when(F.col("net_gex") >= 0, "positive").otherwise("negative"))


def _against_day_before(x: DataFrame, before: DataFrame | None) -> DataFrame:
    """x with what it takes from the row before."""
    x = x.withColumn("_new", F.lit(True))
    if before is not None:
        last = before.groupBy("symbol", "expiry_rank").agg(F.max(F.struct("date", "atm_iv", "gamma_shelf_center")).alias("last")).select("symbol", "expiry_rank", "last.*")
        x = x.unionByName(last.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    lag = lambda n: F.lag(n).over(_series())
    iv_change = F.round(F.coalesce(F.col("iv_exact") - lag("atm_iv"), F.lit(0.0)), 2)
    x = x.withColumns({"iv_change": iv_change, "gamma_com_migration": F.round(F.col("center_exact") - lag("gamma_shelf_center"), 2)})
    return x.filter("_new").drop("_new", "center_exact")


def _islands(flag: Column, name: str, df: DataFrame) -> DataFrame:
    """df with name: the number of a run of equal flags."""
    changed = F.when(flag.eqNullSafe(F.lag(flag).over(_series())), 0).otherwise(1)
    return df.withColumn("_new", changed).withColumn(name, F.sum("_new").over(_series())).drop("_new")


def stage2(eod: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The rows of stage 1 with what depends on earlier and later days; all windows share one partitioning."""
    lag = lambda n, k=1: F.lag(n, k).over(_series())
    days = F.greatest(F.datediff("date", lag("date")), F.lit(1))
    calm = F.col("gex_regime").isin(*POSITIVE) & (F.col("transition_width_norm") < lag("transition_width_norm", 2)) & (F.abs("flip_norm_distance") < lag(F.abs("flip_norm_distance"), 2)) & (lag("atm_iv_smoothed").isNull() | (F.col("atm_iv_smoothed") <= lag("atm_iv_smoothed")))
    move = (F.lead("spot").over(_series()) - F.col("spot")) / F.when(F.col("spot") != 0, F.col("spot")) * 100
    spot_pct = F.abs(ratio(F.col("spot") - lag("spot"), lag("spot")))
    com_pct = F.abs(ratio(F.col("gamma_shelf_center") - lag("gamma_shelf_center"), lag("gamma_shelf_center")))
    five = _series().rowsBetween(-4, 0)
    x = eod.withColumns({"flip_velocity": F.round((F.col("gamma_flip") - lag("gamma_flip")) / days, 2), "basis_chg": F.round(F.col("basis_annualized") - lag("basis_annualized"), 3), "regime_compression": F.coalesce(calm, F.lit(False)), "next_day_realized_move": F.round(move, 3), "next_day_abs_move": F.round(F.abs(move), 3), "migration_effectiveness": F.when(com_pct >= 0.0005, F.round(spot_pct / com_pct, 3)), "concentration_stability": F.when(F.count("concentration").over(five) >= 3, F.round(1 - F.stddev_samp("concentration").over(five), 4))})
    broke = lag("regime_compression") & ~F.col("regime_compression") & (F.col("iv_change") > 0) & F.col("gex_regime").isin(*NEGATIVE) & (F.col("transition_width") > lag("transition_width"))
    x = x.withColumn("compression_release", F.coalesce(broke, F.lit(False)))
    x = stored(x)
    x = _islands(F.col("regime_compression"), "_c", _islands(F.col("gex_regime"), "_r", x))
    within = lambda n: F.row_number().over(Window.partitionBy("symbol", "expiry_rank", n).orderBy("date"))
    released = F.max(F.when(F.col("compression_release"), F.col("date"))).over(_series().rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumns({"days_in_regime": within("_r"), "compression_days": F.when(F.col("regime_compression"), within("_c")).otherwise(0), "days_since_release": F.datediff("date", released)}).withColumn("days_since_flip", F.col("days_in_regime") - 1).drop("_r", "_c")
    names = ["date", "gex_regime", "iv_change", "expected_move", "flip_norm_distance", "flip_velocity", "transition_width_norm", "neg_gamma_fraction", "pe_vanna", "ce_vanna"]
    return x.withColumn("signals", signals({n: F.col(n) for n in names}, {n: lag(n) for n in names}, p))


def history(eod: DataFrame, first: str, last: str, rank: int = 0) -> DataFrame:
    """Strength day by day from first to last: six axes against the row before, their sum, and its running sum; the first day scores 0."""
    x = _scored(eod.filter((F.col("expiry_rank") == rank) & F.col("date").between(first, last)))
    return x.select("symbol", "date", "basis_pct", "in_deadzone", "left_deadzone", "gex_regime", *(n for n in x.columns if n.startswith("axis_")), "strength", "strength_cum")


def symbol_history(eod: DataFrame, symbols: list[str] | None = None, first: str | None = None, last: str | None = None, rank: int = 0, days: int = 7) -> DataFrame:
    """All columns of each symbol's rows from first to last with their strength, regime colour and place.

    By default the window ends with the symbol's last row and begins so many days before its end.
    """
    x = eod.filter(F.col("expiry_rank") == rank)
    if symbols is not None:
        x = x.filter(F.col("symbol").isin(symbols))
    ends = x.groupBy("symbol").agg(F.coalesce(F.lit(last).cast("date"), F.max("date")).alias("_last"))
    begin = F.coalesce(F.lit(first).cast("date"), F.date_sub("_last", days))
    x = _scored(x.join(ends, "symbol").filter(F.col("date").between(begin, F.col("_last"))).drop("_last"))
    return x.withColumns({"regime_color": regime_color(F.col("gex_regime")), "regime_place": regime_order(F.col("gex_regime"))})


def dates(eod: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """(symbol, expiry_rank, date, recency): the days that each symbol has rows of, recency 1 for its last one."""
    x = eod if symbols is None else eod.filter(F.col("symbol").isin(symbols))
    days = x.select("symbol", "expiry_rank", "date").distinct()
    return days.withColumn("recency", F.row_number().over(Window.partitionBy("symbol", "expiry_rank").orderBy(F.desc("date"))))


def signal_info(eod: DataFrame) -> DataFrame:
    """(signal, severity, description, rows): every known signal in words, how urgent it is, and how many rows have it."""
    known = eod.sparkSession.createDataFrame([(k, SEVERITY[k], text) for k, text in SIGNAL_WORDS.items()], "signal string, severity int, description string")
    counts = signal_counts(eod).groupBy("signal").agg(F.sum("n").alias("rows"))
    return known.join(counts, "signal", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def _scored(x: DataFrame) -> DataFrame:
    """Rows with the axes of their strength against the row before, its sum and running sum, and how the basis stands to the dead zone."""
    names = ["date", "net_gex_norm", "neg_gamma_fraction", "iv_change", "atm_iv_smoothed", "flip_norm_distance", "gex_regime", "transition_width_norm"]
    axes = strength({n: F.col(n) for n in names}, {n: F.lag(n).over(_series()) for n in names})
    x = x.withColumns({**{f"axis_{k}": v for k, v in axes.items()}, "in_deadzone": in_deadzone(F.col("basis_pct"))})
    x = x.withColumns({"strength": sum((F.col(f"axis_{k}") for k in axes), F.lit(0)), "left_deadzone": ~F.col("in_deadzone") & F.coalesce(F.lag("in_deadzone").over(_series()), F.lit(True))})
    return x.withColumn("strength_cum", F.sum("strength").over(_series()))


def regime_ramp(eod: DataFrame, rank: int = 0, days: int = 7) -> DataFrame:
    """(gex_regime, place, color, days): the regimes of the last days, from stabilising to destabilising. The days end with the table's last."""
    x = eod.filter(F.col("expiry_rank") == rank)
    recent = x.join(x.agg(F.max("date").alias("_last")), F.col("date") >= F.date_sub("_last", days))
    return recent.groupBy("gex_regime").agg(F.count("*").alias("days")).select("gex_regime", regime_order(F.col("gex_regime")).alias("place"), regime_color(F.col("gex_regime")).alias("color"), "days")


def severity(signals: Column) -> Column:
    """The most urgent of a row's signals as a number, 0 first; 9 for one without a rank, 99 without signals."""
    ranks = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    each = F.transform(F.split(signals, ","), lambda s: F.coalesce(ranks[F.trim(s)], F.lit(9)))
    return F.when(F.coalesce(signals, F.lit("")) == "", 99).otherwise(F.array_min(each))


def screener(eod: DataFrame, day: str | None = None, view: str = "all", rank: int = 0, signal: str | None = None, regime: str | None = None, members: DataFrame | None = None, least_confidence: str = "low", sort_by: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a day, by default the last: all; those with signals, compression or its release (changed); or those whose signals of the day before are gone (dropped).

    members keeps their symbols alone, least_confidence is low, medium or high. prev_signals are
    those of the day before in the view dropped, else null. sort_by orders by size, the most
    extreme first, or for `signals` by severity; ties by symbol; limit keeps the first ones.
    """
    x = eod.filter(F.col("expiry_rank") == rank)
    date = F.lit(day).cast("date")
    if day is None:
        now = x.join(x.agg(F.max("date").alias("date")), "date")
    else:
        now = x.filter(F.col("date") == date)
    trust = lambda c: chosen([(c == "high", 2), (c == "medium", 1)], 0)
    out = now.filter(trust(F.col("confidence")) >= trust(F.lit(least_confidence)))
    if members is not None:
        out = out.join(members, "symbol", "left_semi")
    if view == "dropped":
        older = x.join(now.agg(F.max("date").alias("_day")), F.col("date") < F.col("_day")).drop("_day")
        last = older.join(older.agg(F.max("date").alias("date")), "date").filter("signals <> ''").select("symbol", F.col("signals").alias("prev_signals"))
        out = out.join(last, "symbol").join(now.filter("signals <> ''").select("symbol"), "symbol", "left_anti")
    else:
        out = out.withColumn("prev_signals", F.lit(None).cast("string"))
        if view == "changed":
            out = out.filter("signals <> '' OR regime_compression OR compression_release")
        if signal:
            out = out.filter(F.col("signals").contains(signal))
    out = out.filter(F.col("gex_regime") == regime) if regime else out
    if sort_by:
        out = out.orderBy(severity(F.col("signals")) if sort_by == "signals" else F.abs(sort_by).desc_nulls_last(), "symbol")
    return out.limit(limit) if limit else out


def indicator_counts(eod: DataFrame) -> DataFrame:
    """(date, expiry_rank, compressing, releasing): how many rows of each day are in compression, and how many come out of it."""
    n = lambda flag: F.sum(F.col(flag).cast("long"))
    return eod.groupBy("date", "expiry_rank").agg(n("regime_compression").alias("compressing"), n("compression_release").alias("releasing"))


def signal_counts(eod: DataFrame) -> DataFrame:
    """(date, signal, n): how many rows of each day have each signal."""
    return eod.filter("signals <> ''").select("date", F.explode(F.split("signals", ",")).alias("signal")).groupBy("date", F.trim("signal").alias("signal")).agg(F.count("*").alias("n"))


def narratives(eod: DataFrame) -> DataFrame:
    """Each row of stage 2 in words: positioning, distribution, change, the chance that its level holds, and bands."""
    col = F.col
    hold = hold_probability(col("transition_width_norm"), col("concentration"), col("gex_regime"))
    return eod.select(
        *KEYS, F.round(words.center_distance(col("gamma_shelf_center"), col("fut_price"), col("expected_move")), 4).alias("center_distance"),
        words.positioning(col("gamma_shelf_center"), col("fut_price"), col("expected_move"), col("dealer_divergence_label"), col("oi_com_inrange")).alias("positioning"),
        words.distribution(col("concentration"), col("net_gex_norm"), col("gamma_shelf_width"), col("gamma_shelf_peak_strike")).alias("distribution"),
        words.change(col("gamma_com_migration"), col("expected_move"), col("days_in_regime"), col("basis_chg")).alias("change"),
        hold.alias("hold_probability"), words.hold_bucket(hold).alias("hold_bucket"), words.turnover_band(col("oi_turnover_ratio")).alias("turnover_band"), words.migration_band(col("migration_effectiveness")).alias("migration_band"),
    )


def change_summary(eod: DataFrame, first: str, last: str, metrics: list[str], rank: int = 0) -> DataFrame:
    """(symbol, metric, change): each metric's change from the first to the last row of a symbol between two days."""
    x = eod.filter((F.col("expiry_rank") == rank) & F.col("date").between(first, last))
    ends = x.groupBy("symbol").agg(*(f(F.struct(*metrics), "date").alias(n) for n, f in (("a", F.min_by), ("b", F.max_by))))
    told = F.array(*(F.struct(F.lit(m).alias("metric"), words.change_text(m, F.col(f"a.{m}"), F.col(f"b.{m}")).alias("change")) for m in metrics))
    return ends.select("symbol", F.explode(told).alias("t")).select("symbol", "t.*")
