"""A corpus pipeline: language, quality, near duplicates, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. In all of them a row is what it says in all its columns: null ids
are rows like any other, rows of one id with different texts are different, and an empty table
gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderlake.llm import langid, mixing, pieces, quality, simhash
from ladderlake.llm.common import c, delete, scope, shared_dir, small_batches, stored

#: No stage is expressed in SQL; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null texts, no letters, or codewords that tie. Equal texts stay or go together."""
    small_batches(spark)
    found = langid.predict(docs, langid.fit(docs))
    return found.filter((F.col("lang_pred") != langid.UND) & ~(F.col("lang_ambiguous") & (F.col("lang_score") < 0.4))).select(*map(c, docs.columns))


def classify_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that importance resampling does not draw; those without words never are. Rows of equal id and text stay or go together, rows that tie at the last place stay."""
    small_batches(spark)
    found = quality.draw(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.filter("selected").select(*map(c, docs.columns))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: of the least id, null last, then of the least hash of the text, then of the row.

    Null and empty texts are one group.
    """
    small_batches(spark)
    found = simhash.alike(docs.select("doc_id", "text")).filter("doc_id <=> component_id AND mark = component_mark")
    keep = stored(found.groupBy(F.col("doc_id").alias("key"), F.col("mark").alias("of")).count())
    held = docs.withColumn("mark", F.xxhash64("text")).join(keep, F.expr("doc_id <=> key AND mark = of"), "left_semi")
    if not keep.filter("count > 1").isEmpty():
        whole = F.struct(*map(c, docs.columns))
        held = held.groupBy("doc_id", "mark").agg(F.min_by(whole, F.xxhash64(*map(c, docs.columns))).alias("row")).select("row.*")
    return held.select(*map(c, docs.columns))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the mix does, in order of the time it is first taken; rows without words are not taken. Ties go by id, then by the hash of id and text."""
    same = ["key", "origin", "draw"]
    mixed = stored(mixing.mix(docs).select("key", F.col("source").alias("origin"), "draw", "finish", "times"))
    rows = docs.select(F.struct(*map(c, docs.columns)).alias("doc"), F.col("doc_id").alias("key"), F.col("source").alias("origin"), F.xxhash64("doc_id", "text", F.lit(17)).alias("draw"))
    if mixed.groupBy(*same).count().filter("count > 1").isEmpty():
        rows, mixed = rows.withColumn("nth", F.lit(1)), mixed.withColumn("nth", F.lit(1))
    else:  # rows of one id, source and text have one size, so any of them may stand for any other
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("doc"))))
        mixed = mixed.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("finish", F.desc("times"))))
    held = rows.alias("r").join(mixed.filter("times > 0").alias("m"), F.expr("r.key <=> m.key AND r.origin <=> m.origin AND r.draw = m.draw AND r.nth = m.nth"))
    taken = held.select("doc", "m.finish", "m.key", "m.draw", F.explode(F.expr("sequence(1, m.times)")).alias("pass"))
    return taken.orderBy("pass", "finish", "key", "draw").select("doc.*")


def encode_pieces(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of each document the mix took; null texts have null pieces, repeated rows the same ones."""
    small_batches(spark)
    return pieces.encode(docs.select("doc_id", "source", "lang", "text"), pieces.vocabulary()).drop("text")


STAGES = [("language", identify_language), ("quality", classify_quality), ("near_duplicates", drop_near_duplicates), ("mixture", mix_sources), ("pieces", encode_pieces)]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage stored is deleted once it is written, and its result once the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            delete(spark, f"{at}/{before}")
        before = name
    return docs
