"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are put in a seeded random order. A document's virtual finish time is the
number of words of its source up to its own, divided by the source's target. The mix takes
documents of all sources by finish time until the budget of words is used; a source may be gone
through more than once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, c, stored


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, draw) of each row; size is the number of words of the whole text, 0 of a null; draw orders the rows at random."""
    size = F.coalesce(F.regexp_count(c(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(c(key).alias("key"), c(source).alias("source"), size.alias("size"), F.xxhash64(c(key), c(text), F.lit(17)).alias("draw"))


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n, target): sources by code point, null last, weigh in turn; no target exceeds most times its source.

    What a source cannot take goes to the others by weight. The level at which all is dealt comes
    from sums over the sources in order of the level at which each is full. sizes has a row for
    each source, so one task orders as many rows as there are sources.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("full", most * F.col("source_size") / F.col("weight"))
    by_full = Window.orderBy("full", F.col("source").isNull(), "source")
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("spent", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(by_full.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("budget", share * F.sum("source_size").over(Window.partitionBy()))
    x = x.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
    # the first source that is not full at the level of those from it on sets the level of all of them
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(Window.partitionBy())["level"]
    return x.withColumn("at", level).select("source", "source_size", "n", F.least(most * F.col("source_size"), F.coalesce(F.col("weight") * F.col("at"), most * F.col("source_size"))).alias("target"))


def _running(rows: DataFrame, groups: list[str], leaf: Column, bits: Column, order: list[Column], value: str) -> DataFrame:
    """rows with the column total: the sum of value up to each row within groups, rows by leaf, then order.

    leaf is a number of so many bits that grows with the order and holds few rows. Sums of leaves,
    and of branches of leaves, carry the totals, so no task holds more than a leaf of rows or a
    branch of leaves.
    """
    rows = rows.withColumn("leaf", leaf).withColumn("branch", F.floor(F.col("leaf") / F.pow(F.lit(2.0), F.floor(bits / 2))).cast("long"))
    leaves = rows.groupBy(*groups, "branch", "leaf").agg(F.sum(value).alias("in_leaf"))
    branches = leaves.groupBy(*groups, "branch").agg(F.sum("in_leaf").alias("in_branch"))
    up_to = (Window.unboundedPreceding, -1)
    branches = branches.withColumn("before_branch", F.coalesce(F.sum("in_branch").over(Window.partitionBy(*groups).orderBy("branch").rowsBetween(*up_to)), F.lit(0)))
    leaves = leaves.withColumn("before_leaf", F.coalesce(F.sum("in_leaf").over(Window.partitionBy(*groups, "branch").orderBy("leaf").rowsBetween(*up_to)), F.lit(0)))
    before = leaves.join(branches.drop("in_branch"), [*groups, "branch"]).select(*groups, "leaf", (F.col("before_leaf") + F.col("before_branch")).alias("before"))
    own = F.sum(value).over(Window.partitionBy(*groups, "leaf").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("own", own).join(before, [*groups, "leaf"]).withColumn("total", F.col("own") + F.col("before")).drop("own", "before", "leaf", "branch")


def _copies(same: DataFrame, most: int = 1024) -> DataFrame:
    """A row for each of the copies of a row, numbered from 1; rows of many copies are dealt out in runs before they are copied."""
    few = same.filter(F.col("copies") <= most).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    runs = same.filter(F.col("copies") > most).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / most))))
    first = F.col("run") * most + 1
    many = runs.repartition("key", "draw", "run").withColumn("nth", F.explode(F.sequence(first, F.least(F.col("copies"), first + (most - 1)))))
    return few.unionByName(many.drop("run"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, most: int = 2, rows_per_leaf: int = 64) -> DataFrame:
    """(key, source, size, draw, source_size, target, finish, times) of each row of docs.

    finish is the virtual time at which a row is first taken, times how often the mix takes it, 0
    to most. The mix ends before the first document that would exceed the budget, share times all
    sizes. Rows of size 0 have times 0. Null sources are a source of their own; null texts have
    size 0; an empty table gives no rows. Rows of equal key, text and source follow each other;
    they are added up before they are ordered and dealt out again after, however many there are.
    """
    rows = sized(docs, key, text, source).withColumn("group", F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))))
    rows = stored(rows.groupBy("group", "key", "source", "size", "draw").agg(F.count("*").alias("copies")))
    per = rows.groupBy("group").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"))
    per = stored(targets(per, weights, share, float(most)).withColumn("group", F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit("")))))
    n, budget = per.agg(F.sum("n"), share * F.sum("source_size")).first()
    rows = rows.join(per.drop("source"), "group")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / rows_per_leaf))).cast("int")
    leaf = F.floor(F.shiftrightunsigned("draw", 11).cast("double") / F.lit(float(1 << 53)) * F.pow(F.lit(2.0), bits)).cast("long")
    unsigned = [F.shiftrightunsigned("draw", 11), F.col("draw"), F.col("key"), F.col("size")]
    rows = _copies(_running(rows.withColumn("all", F.col("size") * F.col("copies")), ["group"], leaf, bits, unsigned, "all"))
    rows = rows.withColumn("total", F.col("total") - F.col("size") * (F.col("copies") - F.col("nth"))).drop("all", "copies", "nth")
    finish = [(F.col("total") + i * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target")) for i in range(most)]
    rows = stored(rows.withColumns({f"finish{i}": F.when(F.col("size") > 0, x) for i, x in enumerate(finish)}).drop("total", "group", "n"))
    if not n or not budget:
        return rows.select("key", "source", "size", "draw", "source_size", "target", F.col("finish0").alias("finish"), F.lit(0).alias("times"))
    # one queue of all passes, range-sorted by finish time; the budget ends it in one of its leaves
    passes = rows.select("size", "draw", "key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"finish{i}").alias("finish")) for i in range(most)])).alias("p")).select("size", "draw", "key", "p.*").filter("finish is not null")
    depth = max(0, math.ceil(math.log2(max(1, n * most / rows_per_leaf))))
    queue_leaf = F.floor(F.col("finish") * float(1 << depth)).cast("long")
    leaves = passes.groupBy(queue_leaf.alias("leaf")).agg(F.sum("size").alias("size"))
    leaves = leaves.withColumn("branch", F.floor(F.col("leaf") / float(1 << (depth + 1) // 2)).cast("long"))
    branches = leaves.groupBy("branch").agg(F.sum("size").alias("size"))
    over = lambda x, at: x.withColumn("sum", F.sum("size").over(Window.orderBy(at))).filter(F.col("sum") > F.lit(budget))
    last = over(branches, "branch").orderBy("branch").first()
    if last is None:
        taken = {f"finish{i}": F.col(f"finish{i}").isNotNull() for i in range(most)}
    else:
        before = last["sum"] - last["size"]
        end = leaves.filter(F.col("branch") == last.branch).withColumn("sum", F.sum("size").over(Window.orderBy("leaf")) + F.lit(before)).filter(F.col("sum") > F.lit(budget)).orderBy("leaf").first()
        queue = ["finish", "draw", "key", "i"]
        tail = passes.filter(queue_leaf == end.leaf).withColumn("sum", F.sum("size").over(Window.partitionBy(queue_leaf).orderBy(*queue)) + F.lit(end["sum"] - end["size"]))
        cut = tail.filter(F.col("sum") > F.lit(budget)).orderBy(*queue).select(*queue).first()
        at = lambda i: F.struct(F.col(f"finish{i}"), F.col("draw"), F.col("key"), F.lit(i))
        key_type = rows.schema["key"].dataType
        stop = F.struct(F.lit(cut.finish), F.lit(cut.draw), F.lit(cut.key).cast(key_type), F.lit(cut.i))
        taken = {f"finish{i}": F.col(f"finish{i}").isNotNull() & (at(i) < stop) for i in range(most)}
    times = sum((F.coalesce(x, F.lit(False)).cast("int") for x in taken.values()), F.lit(0))
    return rows.select("key", "source", "size", "draw", "source_size", "target", F.col("finish0").alias("finish"), times.alias("times"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))
