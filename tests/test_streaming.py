"""Streams into the stages, the stored upsert and the live screens against runs over all rows."""

import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ladderlake.operators import screens
from ladderlake.plans import eod
from ladderlake.sources import daytable, ocdata, store
from ladderlake.streaming import ingest, live, stages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark):
    return store.stored(ocdata.chain(spark, SF))


def same(a, b):
    """Equal rows, whatever the order of rows and columns."""
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    text = lambda x: sorted(map(repr, (tuple(None if v != v else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in x.select(*names).collect())))
    assert text(a) == text(b)


def files(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) if "_staged" not in d for f in names if f.endswith(".parquet")}


def days_of(chain):
    return [r[0] for r in chain.select(F.to_date("timestamp").alias("d")).distinct().orderBy("d").collect()]


def drop(chain, folder, name, when):
    chain.filter(when).coalesce(1).write.mode("append").parquet(str(folder))
    return name


ROWS = "k long, trade_date date, v double"


def test_upsert_of_a_stored_table(spark, tmp_path):
    at, d = str(tmp_path / "t"), lambda n: dt.date(2024, 1, n)
    assert daytable.read(spark, at) is None and daytable.latest_day(spark, at) is None
    daytable.upsert(spark, at, spark.createDataFrame([(1, d(1), 1.0), (2, d(1), 2.0), (3, d(2), 3.0), (None, d(2), 9.0)], ROWS), ["k"], "a")
    before = files(f"{at}/trade_date=2024-01-02")
    new = spark.createDataFrame([(2, d(1), 20.0, "x"), (4, d(3), 4.0, "y")], ROWS + ", w string")
    for _ in range(2):  # the same token twice gives the same table
        assert daytable.upsert(spark, at, new, ["k"], "b") == [d(1), d(3)]
    got = {(r.k, r.v, r.w) for r in daytable.read(spark, at).collect()}
    assert got == {(1, 1.0, None), (2, 20.0, "x"), (3, 3.0, None), (4, 4.0, "y"), (None, 9.0, None)}
    assert files(f"{at}/trade_date=2024-01-02") == before and daytable.latest_day(spark, at) == d(3)
    daytable.upsert(spark, at, spark.createDataFrame([(None, d(2), 10.0)], ROWS), ["k"], "c")
    assert {r.v for r in daytable.read(spark, at).filter("k IS NULL").collect()} == {10.0}


def test_failed_upsert_leaves_the_rows(spark, tmp_path):
    at, d = str(tmp_path / "t"), dt.date(2024, 1, 1)
    daytable.upsert(spark, at, spark.createDataFrame([(1, d, 1.0)], ROWS), ["k"], "a")
    before = files(at)
    bad = spark.createDataFrame([(1, d, 2.0)], ROWS).withColumn("v", F.when(F.col("k") == 1, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        daytable.upsert(spark, at, bad, ["k"], "b")
    assert files(at) == before and [r.v for r in daytable.read(spark, at).collect()] == [1.0]


def test_overwriting_goes_on_from_what_was_staged(spark, tmp_path):
    at, d = str(tmp_path / "t"), dt.date(2024, 1, 1)
    daytable.upsert(spark, at, spark.createDataFrame([(1, d, 1.0), (2, d, 2.0)], ROWS), ["k"], "a")
    new = spark.createDataFrame([(2, d, 3.0)], ROWS)
    daytable.upsert(spark, at, new, ["k"], "b")
    store.delete(spark, f"{at}/trade_date={d}")  # as if the job had died after it deleted the old partition
    daytable.upsert(spark, at, new, ["k"], "b")
    assert {(r.k, r.v) for r in daytable.read(spark, at).collect()} == {(1, 1.0), (2, 3.0)}


def test_replace_from_deletes_days(spark, tmp_path):
    at, d = str(tmp_path / "t"), lambda n: dt.date(2024, 1, n)
    daytable.upsert(spark, at, spark.createDataFrame([(i, d(i), 1.0) for i in (1, 2, 3)], ROWS), ["k"], "a")
    daytable.replace_from(spark, at, spark.createDataFrame([(3, d(3), 5.0)], ROWS), d(2), "b")
    assert {(r.k, r.v) for r in daytable.read(spark, at).collect()} == {(1, 1.0), (3, 5.0)}


def test_scope_deletes_what_it_stored(spark):
    outer = store.stored(spark.range(3))
    with store.scope(spark):
        inner = store.stored(spark.range(5))
        path = inner.inputFiles()[0]
        assert inner.count() == 5
    assert outer.count() == 3 and not store.exists(spark, path)


def test_stages_from_a_stream(spark, chain, tmp_path, monkeypatch):
    days, base, inbox = days_of(chain), str(tmp_path / "base"), tmp_path / "in"
    late = (F.to_date("timestamp") == F.lit(days[2])) & (F.col("symbol") == "ITC")
    run = lambda: stages.start(spark.readStream.schema(chain.schema).parquet(str(inbox)), base, str(tmp_path / "cp")).awaitTermination()
    drop(chain, inbox, "a", (F.to_date("timestamp") <= F.lit(days[3])) & ~late)
    run()
    drop(chain, inbox, "b", F.to_date("timestamp") == F.lit(days[4]))
    with monkeypatch.context() as broken:  # dies after stage 1 is written, before stage 2 and the batch are
        broken.setattr(stages, "_second", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(StreamingQueryException):
            run()
    run()
    drop(chain, inbox, "c", (F.to_date("timestamp") > F.lit(days[4])) | late)
    run()
    same(stages.table(spark, base, "chain"), chain)
    last = stages.last_snapshot(spark, base)
    same(last, ocdata.latest(chain, "symbol"))
    same(screens.overview(last), screens.overview(chain))
    first = store.stored(eod.stage1(chain))
    same(stages.table(spark, base, "stage1"), first)
    same(stages.table(spark, base, "stage2"), eod.stage2(first))


def test_live_shockers(spark, chain, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    times = [r[0] for r in chain.select("timestamp").distinct().orderBy("timestamp").collect()]
    base, inbox, seen = str(tmp_path / "live"), tmp_path / "in", None
    late = (F.col("symbol") == "NIFTY") & (F.col("strike_price") > 20000)
    parts = [F.col("timestamp").isin(times[:3]), F.col("timestamp").isin(times[3:5]) & ~late, F.col("timestamp").isin(times[3:5]) & late, F.col("timestamp").isin(times[5:])]
    for i, part in enumerate(parts):
        drop(chain, inbox, i, part)
        live.start(spark.readStream.schema(chain.schema).parquet(str(inbox)), base, str(tmp_path / "cp"), "30 days").awaitTermination()
        seen = chain.filter(part) if seen is None else seen.unionByName(chain.filter(part))
        now = live.current(spark, base)
        same(screens.volume_shockers(now, "2024-01-08"), screens.volume_shockers(seen, "2024-01-08"))
        assert now.groupBy("symbol", "expiry").agg(F.countDistinct("timestamp").alias("n")).filter("n > 2").count() == 0
    # rows of the other expiry 39 days on move the watermark past the first one, and the next batch drops its ladders
    assert {str(r.expiry) for r in live.current(spark, base).select("expiry").distinct().collect()} == {"2024-01-25", "2024-02-29"}
    for hours in (0, 1):
        later = chain.filter(F.col("expiry") == "2024-02-29").withColumn("timestamp", F.col("timestamp") + F.expr(f"INTERVAL '39 {hours}' DAY TO HOUR"))
        later.coalesce(1).write.mode("append").parquet(str(inbox))
        live.start(spark.readStream.schema(chain.schema).parquet(str(inbox)), base, str(tmp_path / "cp"), "30 days").awaitTermination()
    assert {str(r.expiry) for r in live.current(spark, base).select("expiry").distinct().collect()} == {"2024-02-29"}


def test_last_snapshot_reads_its_days_alone(spark, tmp_path):
    at, d = str(tmp_path / "t"), lambda n: dt.date(2024, 1, n)
    rows = [(s, dt.datetime(2024, 1, n, h), n + h, d(n)) for n in range(1, 9) for h in (9, 15) for s in ("A", "B") if s == "A" or n < 4]
    days = daytable.upsert(spark, at, spark.createDataFrame(rows, "symbol string, timestamp timestamp, v int, trade_date date"), ["symbol", "timestamp"], "a")
    daytable.note_last(spark, at, days, "symbol", "a")
    x = daytable.latest(spark, at, "symbol")
    assert {(r.symbol, r.v) for r in x.collect()} == {("A", 23), ("B", 18)}
    assert "SortMergeJoin" not in x._jdf.queryExecution().executedPlan().toString()
    # with all other days' files spoilt, it reads as before
    for f in files(at):
        if "2024-01-08" not in f and "2024-01-03" not in f:
            with open(f, "wb") as out:
                out.write(b"spoilt")
    assert {(r.symbol, r.v) for r in daytable.latest(spark, at, "symbol").collect()} == {("A", 23), ("B", 18)}
    with pytest.raises(Exception, match="(?i)parquet"):
        daytable.read(spark, at).agg(F.sum("v")).collect()


def test_a_column_keeps_its_type(spark, tmp_path):
    at, d = str(tmp_path / "t"), dt.date(2024, 1, 1)
    daytable.upsert(spark, at, spark.createDataFrame([(1, d, 1.0)], ROWS), ["k"], "a")
    with pytest.raises(ValueError, match="type"):
        daytable.upsert(spark, at, spark.createDataFrame([(1, d, "x")], "k long, trade_date date, v string"), ["k"], "b")
    assert [r.v for r in daytable.read(spark, at).collect()] == [1.0]


def test_history_window_and_dates(spark, chain):
    rows = store.stored(eod.stage2(eod.stage1(chain)))
    x = eod.symbol_history(rows, ["ITC"])
    last = rows.filter("symbol = 'ITC' AND expiry_rank = 0").agg(F.max("date")).first()[0]
    assert {r.date for r in x.collect()} == {r.date for r in rows.filter("symbol = 'ITC' AND expiry_rank = 0").collect() if (last - r.date).days <= 7}
    assert set(rows.columns) < set(x.columns) and x.filter("regime_color IS NULL").isEmpty()
    a, b = str(last - dt.timedelta(days=4)), str(last)
    names = ["symbol", "date", "strength", "strength_cum", "left_deadzone"]
    same(eod.symbol_history(rows, None, a, b).select(names), eod.history(rows, a, b).select(names))
    d = eod.dates(rows, ["ITC"]).filter("expiry_rank = 0").orderBy("recency").collect()
    assert d[0].date == last and [r.recency for r in d] == list(range(1, len(d) + 1)) and all(p.date > q.date for p, q in zip(d, d[1:]))
    info = {r.signal: r.rows for r in eod.signal_info(rows).collect()}
    assert len(info) == 9 and sum(info.values()) == eod.signal_counts(rows).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
