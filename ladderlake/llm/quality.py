"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, single words and byte trigrams, are counted: one over
target text, one over all raw text. The log of a document's importance weight is the log of the ratio
of its likelihoods under the two, and k documents are drawn without replacement by Gumbel top-k.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, kth_largest, remainder, small_batches, stored, uniform, with_arrow_columns

#: Buckets of words, and as many after them of trigrams.
FEATURES = 1 << 16
#: Columns that draw adds, and names that it uses meanwhile.
_OUT, _KEY, _MARK = ["log_weight", "gumbel_key", "selected"], "_drawn_key", "_drawn_mark"
#: Bytes whose trigrams are hashed at once.
SLICE = 1 << 20


class _Hashes(dict):
    """The bucket of a word; forgets all when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word) & (FEATURES - 1)
        return h


def _features(text: str, hashes: _Hashes):
    """Buckets of a whole text's words and byte trigrams, slice by slice; none without a word."""
    data = text.encode()
    words = data.split()
    if not words:
        return
    yield np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
    data = b" " + data + b" "
    for at in range(0, len(data) - 2, SLICE):
        a = np.frombuffer(data[at : at + SLICE + 2], np.uint8).astype(np.uint32)
        h = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)
        yield ((h >> np.uint32(8)) & np.uint32(FEATURES - 1)).astype(np.int64) + FEATURES


def good_keys(labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic", max_labels: int = 20_000, seed: int = 5) -> DataFrame:
    """(key): those whose label rows all have quality 1 and none toxic 1; of more than max_labels a hash-drawn sample of about as many.

    A null quality is not good, a null toxic is not toxic; rows of a null key say nothing.
    """
    good = labels.filter(c(key).isNotNull()).groupBy(c(key).alias("key")).agg(F.min(F.coalesce(c(quality), F.lit(0))).alias("q"), F.max(F.coalesce(c(toxic), F.lit(0))).alias("t")).filter((F.col("q") == 1) & (F.col("t") == 0)).select("key")
    n = good.count()
    return good.filter(uniform(F.col("key"), F.lit(seed)) < min(1.0, max_labels / max(n, 1)))


def fit(docs: DataFrame, good: DataFrame, text: str = "text", key: str = "doc_id", smoothing: float = 1.0) -> dict:
    """Counts the raw model over all docs and the target model over the docs with a key of good.

    The driver gets two counts for each bucket. Without target text the ratio is 1 everywhere.
    Repeated rows count as often as they occur; a null text counts nothing.
    """
    rows = docs.select(c(key).alias("key"), c(text).alias("text")).filter(F.col("text").isNotNull())
    # good is a sample of bounded size, see good_keys, so its broadcast does not grow with the input
    rows = rows.join(F.broadcast(good.select("key").distinct().withColumn("target", F.lit(True))), "key", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches):
        raw, target, hashes = np.zeros(2 * FEATURES, np.int64), np.zeros(2 * FEATURES, np.int64), _Hashes()
        held: list[list] = [[], []]

        def add():
            for x, into in ((held[0] + held[1], raw), (held[1], target)):
                if x:
                    into += np.bincount(np.concatenate(x), minlength=2 * FEATURES)
            held[:] = [[], []]

        for batch in batches:
            size = 0
            for t, good_one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in _features(t, hashes):
                    held[good_one].append(x)
                    size += len(x)
                    if size > SLICE:
                        add()
                        size = 0
            add()
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at], pa.int64()), pa.array(target[at], pa.int64())], names=["f", "raw", "target"])

    counted = rows.mapInArrow(count, "f long, raw long, target long").groupBy("f").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(2 * FEATURES), np.zeros(2 * FEATURES)
    raw[counted.f], target[counted.f] = counted.raw, counted.target
    if not target.sum():
        return {"ratio": np.zeros(2 * FEATURES)}
    # raw counts are brought to the scale of the target's, so that both models are smoothed alike
    scaled = raw * (target.sum() / raw.sum())
    return {"ratio": np.log((target + smoothing) / (scaled + smoothing))}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with log_weight, the log of the ratio of a whole text's likelihoods; null for a null text and one without words. A column of that name is replaced."""
    ratio, hashes = model["ratio"], _Hashes()

    def rate(given):
        out = []
        for t in given.to_pylist():
            parts = [float(ratio[x].sum()) for x in _features(t or "", hashes)]
            out.append(math.fsum(parts) if parts else None)
        return [pa.array(out, pa.float64())]

    return with_arrow_columns(docs, [T.StructField("log_weight", T.DoubleType())], rate, [text])


def resample(scored: DataFrame, k: int, by: list[str], seed: int = 3, weights: DataFrame | None = None) -> DataFrame:
    """scored with gumbel_key and selected: k rows drawn without replacement in proportion to exp(log_weight).

    A row's Gumbel noise depends on the columns by and on seed alone, so reruns agree and rows
    that are equal in them are drawn or left together. Rows that tie at the k-th key are all
    drawn; rows with a null log_weight are not. If k is the number of rows or more, all that weigh
    anything are drawn. The k-th key is found in several passes over weights, scored itself by
    default, a stored table of the same rows with by and log_weight. Columns of these names are
    replaced; an empty table gives no rows.
    """
    noise = -F.log(-F.log(uniform(*map(c, by), F.lit(seed))))
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") + noise)
    keys = keyed if weights is None else weights.select((F.col("log_weight") + noise).alias("gumbel_key"))
    n = keys.filter("gumbel_key IS NOT NULL").count()
    cut = kth_largest(keys, "gumbel_key", min(k, n)) if k > 0 else None
    return keyed.withColumn("selected", F.coalesce(F.col("gumbel_key") >= F.lit(cut), F.lit(False)) if cut is not None else F.lit(False))


def like_target(scored: DataFrame, good: DataFrame, key: str = "doc_id", spare: float = 0.01) -> int:
    """How many rows of scored weigh at least as much as all but the share spare of the good ones, one at least; the number of rows if none is good."""
    # bounded as in fit
    known = scored.join(F.broadcast(good.select(F.col("key").alias("good_key")).distinct()), c(key) == F.col("good_key"), "left_semi")
    n = known.filter("log_weight IS NOT NULL").count()
    least = kth_largest(known, "log_weight", max(1, n - math.ceil(spare * n))) if n else None
    return scored.count() if least is None else scored.filter(F.col("log_weight") >= F.lit(least)).count()


def draw(docs: DataFrame, labels: DataFrame, k: int | None = None, text: str = "text", key: str = "doc_id", quality: str = "quality", toxic: str = "toxic", max_labels: int = 20_000, spare: float = 0.01, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs, all by default, with log_weight, gumbel_key and selected.

    k is how many rows are drawn. By default it is settled by labels that the model has not
    learnt from, the fifth whose crc32 of the key is divisible by 5: see like_target. Weights
    and the columns that keep names are written to the shared folder; without keep, texts are not
    written but scored again.
    """
    good = stored(good_keys(labels, key, quality, toxic, max_labels))
    kept_back = remainder(F.col("key"), 5) == 0
    model = fit(docs, good.filter(~kept_back), text, key)
    marked = docs.withColumns({_KEY: c(key), _MARK: F.xxhash64(c(text))})
    names = [x for x in (keep or docs.columns) if x.lower() not in _OUT]
    held = stored(score(marked, model, text).select(*map(c, names if keep else []), _KEY, _MARK, "log_weight"))
    k = like_target(held, good.filter(kept_back), _KEY, spare) if k is None else k
    by = [_KEY, _MARK]
    return resample(held if keep else score(marked, model, text), k, by, weights=held).select(*map(c, names), *_OUT)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's weight, key and whether it is drawn."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return draw(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
