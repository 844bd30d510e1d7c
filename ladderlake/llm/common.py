"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import delete, scope, shared_dir, stored

__all__ = ["WORD", "c", "delete", "fresh", "kth_largest", "remainder", "scope", "shared_dir", "small_batches", "stored", "uniform", "with_arrow_columns", "without"]
#: A word: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds the Arrow batches that Spark sends to Python by bytes; a bound that the session has set itself stays.

    Spark's own bound, 64 MB, is held several times by each task: as vectors, on the way, and by
    Python. It is a setting of the session and stays set, so only queries and stages, which own
    their session, call this; operators leave the session as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "-1b"):
        spark.conf.set(key, most)


def c(name: str) -> Column:
    """A column by its literal name."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that clash with none of df, in any case."""
    taken = {n.lower() for n in df.columns}
    return [next(x for x in ("_" * i + n for i in range(len(taken) + 1)) if x not in taken) for n in names]


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of df whose names clash with none of names, in any case."""
    taken = {n.lower() for n in names}
    return [x for x in df.columns if x.lower() not in taken]


def _runs(batch: pa.RecordBatch, at_once: int | None):
    """Rows of a batch that follow each other, about at_once bytes each time."""
    rows = len(batch) if at_once is None else max(1, int(len(batch) * at_once / max(1, batch.nbytes)))
    for at in range(0, len(batch), max(1, rows)):
        yield batch.slice(at, rows)


def with_arrow_columns(df: DataFrame, fields: list[T.StructField], fn, inputs: list[str], at_once: int | None = None) -> DataFrame:
    """df with columns that fn(arrays of the inputs) -> list of arrays computes; columns of the same names are replaced.

    Spark resolves the inputs, so their case does not matter and an unknown name is an error. With
    at_once, fn gets runs of rows of about so many bytes, one row at least.
    """
    kept = without(df, [f.name for f in fields])
    schema = T.StructType([df.schema[x] for x in kept] + fields)
    names = [f"c{i}" for i in range(len(kept))] + [f"in{i}" for i in range(len(inputs))]
    seen = df.select(*(c(x).alias(n) for x, n in zip([*kept, *inputs], names)))

    def run(batches):
        for batch in (part for whole in batches for part in _runs(whole, at_once)):
            own, given = batch.columns[: len(kept)], batch.columns[len(kept) :]
            yield pa.RecordBatch.from_arrays(own + fn(*given), names=names[: len(kept)] + [f.name for f in fields])

    flat = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, schema.fields[: len(kept)])] + fields)
    return seen.mapInArrow(run, flat).toDF(*schema.names)


def remainder(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 of a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % n, F.lit(0))


def uniform(*columns: Column) -> Column:
    """A number from the open interval (0, 1) that depends on these columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def kth_largest(df: DataFrame, key: str, k: int, few: int = 4096) -> float | None:
    """The k-th largest value of a double column, exactly; None if k is not in 1..rows.

    Each pass counts rows by 1024 equal ranges and goes on in the range that holds the k-th, so
    the driver sees at most 1024 counts, or the few values at the end.
    """
    x = df.select(F.col(key).alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    lo, hi, n = x.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not 1 <= k <= n:
        return None
    while n > few and lo < hi:
        width = (hi - lo) / 1024
        if lo + width == lo or width == 0:
            break
        part = F.least(F.floor((F.col("x") - lo) / width), F.lit(1023)).alias("b")
        counts = sorted(((r.b, r.n, r.lo, r.hi) for r in x.groupBy(part).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()), reverse=True)
        for _, n, lo, hi in counts:
            if k <= n:
                break
            k -= n
        x = x.filter((F.col("x") >= lo) & (F.col("x") <= hi))
    for r in x.groupBy("x").count().orderBy(F.desc("x")).limit(few).collect():
        if k <= r["count"]:
            return r.x
        k -= r["count"]
    return lo
