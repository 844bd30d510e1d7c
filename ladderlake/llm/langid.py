"""Language identification by error-correcting output codes.

Each language has a codeword. One binary classifier a bit, a multinomial model of hashed byte
trigrams, tells the languages whose codeword has the bit from the others. A text's language is
that of the codeword with the least weighted logistic loss; a text whose two best codewords are
close is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, remainder, small_batches, stored, uniform, with_arrow_columns

FEATURES = 1 << 13
UND = "und"
#: Letters in lower case, all other ASCII as spaces; bytes of other scripts stay.
_FOLD = bytes(x if 97 <= x <= 122 or x >= 128 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1: all distinct splits for up to five languages, else seeded random columns whose rows stay far apart."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 5:
        columns = [(1, *x) for x in itertools.product((1, -1), repeat=k - 1) if -1 in x]
        return np.array(columns, float).T
    rng, bits, best = np.random.default_rng(seed), max(15, math.ceil(10 * math.log2(k))), None
    for _ in range(20):
        code = np.where(rng.permuted(np.tile(np.arange(k)[:, None] < k // 2, bits), axis=0), 1.0, -1.0)
        apart = min(bits - (code[i + 1 :] @ code[i]).max() for i in range(k - 1))
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def _features(text: str) -> np.ndarray:
    """How often each bucket of byte trigrams occurs; trigrams of spaces alone count in bucket 0, which no classifier uses."""
    a = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(FEATURES, np.int64)
    h = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(19)
    h[(a[:-2] == 32) & (a[1:-1] == 32)] = 0
    h[(a[1:-1] == 32) & (a[2:] == 32)] = 0
    return np.bincount(h, minlength=FEATURES)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", max_docs_per_lang: int = 3000, alpha: float = 0.5, seed: int = 11) -> dict:
    """Learns all values of lang that are not null, each from about max_docs_per_lang of its different whole texts at most.

    The sample is drawn by the hash of the text, so it does not depend on files or partitions. A
    language's share is taken of its different texts, as a sketch counts them to about 2 %, so a
    text that occurs often counts once and takes no other's place. A classifier's two sides are means over
    their languages, summed up by Spark: the driver gets two numbers for each bucket and bit,
    and bits grow as the logarithm of the number of languages. No row to learn from gives a
    model that answers `und`.
    """
    rows = docs.select(c(text).alias("text"), c(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = rows.groupBy("lang").agg((F.lit(float(max_docs_per_lang)) / F.approx_count_distinct(F.xxhash64("text"), 0.02)).alias("share"))
    # one short row for each language, all of which the driver holds as the codebook anyway; texts stay where they are
    drawn = rows.join(F.broadcast(share), "lang").filter(uniform(F.col("text"), F.lit(seed)) < F.col("share"))
    sample = drawn.groupBy("lang", F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text"))

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _features(t)
                held[name] = held[name] + x if name in held else x
                if len(held) > 256:
                    yield from told(held)
                    held = {}
        yield from told(held)

    def told(held):
        for name, x in held.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(x[at], pa.int64())], names=["lang", "f", "n"])

    counted = stored(sample.select("text", "lang").mapInArrow(count, "lang string, f long, n long").filter("f > 0").groupBy("lang", "f").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    code = codewords(len(langs))
    bits = code.shape[1]
    place = {name: i for i, name in enumerate(langs)}

    def sides(batches):
        """Of the buckets of one partition: the sum of n / (total + alpha * FEATURES) over the languages of each side of each bit."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, f, n, total in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if f not in held:
                    held[f] = np.zeros((2, bits))
                held[f] += np.stack([code[place[name]] > 0, code[place[name]] < 0]) * (n / (total + alpha * FEATURES))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *(pa.array([x[k].tolist() for x in held.values()], pa.list_(pa.float64())) for k in (0, 1))], names=["f", "yes", "no"])

    learnt = counted.join(totals, "lang").select("lang", "f", "n", "total").repartition("f").sortWithinPartitions("f", "lang").mapInArrow(sides, "f long, yes array<double>, no array<double>").collect()
    # what smoothing adds to each bucket is the same for all buckets of a language
    base = {r.lang: alpha / (r.total + alpha * FEATURES) for r in totals.collect()}
    added = np.array([base.get(name, 1 / FEATURES) for name in langs])
    yes, no = (np.tile(added @ side, (FEATURES, 1)) if bits else np.zeros((FEATURES, 0)) for side in (code > 0, code < 0))
    for r in learnt:
        yes[r.f] += r.yes
        no[r.f] += r.no
    yes, no = yes / np.maximum((code > 0).sum(0), 1), no / np.maximum((code < 0).sum(0), 1)
    weights, importance = np.zeros((FEATURES, bits)), np.zeros(bits)
    for j in range(bits):
        odds = np.log(yes[:, j] / no[:, j])
        odds[0] = 0
        odds -= (yes[:, j] @ odds + no[:, j] @ odds) / 2
        odds[0] = 0
        scale = max((yes[:, j] @ odds - no[:, j] @ odds) / 2, 1e-9)
        weights[:, j] = odds / scale  # about 1 for an average text of the first side, -1 for the other
        importance[j] = scale
    return {"langs": langs, "code": code, "weights": weights.astype(np.float32), "importance": importance / importance.sum() if bits else importance}


def predict(docs: DataFrame, model: dict, text: str = "text", steep: float = 4.0, near: float = 0.08) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_ambiguous, from whole texts; columns of these names are replaced.

    A null text, one without a letter, or a model without languages gives `und`, 0 and false. Of
    codewords with equal losses the language that sorts first is taken. Ambiguous: the two least
    losses differ by less than near. Equal texts get equal answers; an empty table gives no rows.
    """
    langs, code, weights, importance = model["langs"], model["code"], model["weights"], model["importance"]

    def decide(given):
        texts = given.to_pylist()
        names, scores, unsure = [UND] * len(texts), [0.0] * len(texts), [False] * len(texts)
        fit_for = [i for i, t in enumerate(texts) if langs and t and any(map(str.isalpha, t))]
        for at in range(0, len(fit_for), 64):
            rows = fit_for[at : at + 64]
            x = np.stack([_features(texts[i]) for i in rows]).astype(np.float32)
            x[:, 0] = 0
            margin = (x @ weights) / np.maximum(x.sum(1, keepdims=True), 1)
            # a bit's loss is that of its sign, so the losses of all codewords are two matrix products
            loss = (np.logaddexp(0, -steep * margin) * importance) @ (code > 0).T + (np.logaddexp(0, steep * margin) * importance) @ (code < 0).T
            order = np.sort(loss, axis=1)
            odds = np.exp(-steep * (loss - order[:, :1]))
            for i, best, o, s in zip(rows, loss.argmin(1), odds, order):
                names[i], scores[i] = langs[best], float(1 / o.sum())
                unsure[i] = len(s) > 1 and bool(s[1] - s[0] < near)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())]
    return with_arrow_columns(docs, fields, decide, [text])


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from four fifths of the documents: doc_id, held_out, lang_pred, score, ambiguous."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = fit(docs.filter(~held_out))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
