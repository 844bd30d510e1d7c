"""Katz backoff of any order over n-gram tables, one row for each n-gram.

The counts of each order are a table, summed from those of the order above and stored. From the words
upwards each order joins the probabilities of the order below, gets what each history's n-grams leave,
and divides it among the words that never followed the history, so that every history sums to 1.
Documents meet the highest order's table once, token by token. All sums are partial before they are
shuffled, so no history, however frequent, comes together in one task; frequent join keys are split
by adaptive execution.

katz.score gives the same for pairs with a fraction of the shuffled bytes, up to sizes at which each of its
messages still holds many pairs; this one has no such limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import c, stored
from .katz import END, KEEP, START, K, good_turing

#: Bytes of text whose tokens are emitted at once.
AT_ONCE = 1 << 20
_START, _END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (START, END))


def _mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a history that is one word longer."""
    x = (history ^ (word + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(texts: list[str], order: int, known: dict[bytes, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(tokens of each text, columns) of the words of texts, each with one end: h1 to h(order - 1), hashes of that many words before, and w; the start stands before the first word."""
    flat, lengths = [], []
    for t in texts:
        own = []
        for word in (t or "").encode().lower().split():
            h = known.get(word)
            if h is None:
                if len(known) > 500_000:
                    known.clear()
                h = known[word] = xxhash.xxh64_intdigest(word)
            own.append(h)
        flat.append(np.array([*own, int(_END)], np.uint64))
        lengths.append(len(own) + 1)
    w, lengths = np.concatenate(flat), np.array(lengths)
    place = np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    columns, history = [], None
    for k in range(1, order):
        before = np.where(place >= k, np.roll(w, k), _START)
        history = before if history is None else _mixed(history, before)
        columns.append(history.view(np.int64))
    return lengths, [*columns, w.view(np.int64)]


def _tokens(docs: DataFrame, order: int, kept: list[str]) -> DataFrame:
    """A row for each token of each row of docs (text, ...): h1 to h(order - 1), w, and the columns kept."""
    types = {n: t for n, t in docs.dtypes}
    names = [*(f"h{k}" for k in range(1, order)), "w"]

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            texts, at = batch.column(0).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < AT_ONCE):
                    size += len(texts[end] or "")
                    end += 1
                lengths, columns = _grams(texts[at:end], order, known)
                own = pa.array(np.repeat(np.arange(at, end), lengths))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(batch.column(i + 1).take(own) for i in range(len(kept)))], names=[*names, *kept])
                at = end

    return docs.select("text", *kept).mapInArrow(run, ", ".join([*(f"{n} long" for n in names), *(f"{n} {types[n]}" for n in kept)]))


def _kept(n: Column, discounts: np.ndarray) -> Column:
    """A discounted count."""
    return n * F.element_at(F.array(*map(F.lit, [0.0, *map(float, discounts), KEEP])), F.least(n, F.lit(K + 1)).cast("int") + 1)


def _discounts(counts: DataFrame) -> np.ndarray:
    """Good-Turing's, from how many n-grams of a table were seen 1 to K + 1 times."""
    seen = {r.n: r["count"] for r in counts.filter(F.col("n").between(1, K + 1)).groupBy("n").count().collect()}
    return good_turing([seen.get(r, 0) for r in range(1, K + 2)])


def tables(docs: DataFrame, order: int) -> list[DataFrame]:
    """Counts of the 1-grams to order-grams of docs (text, train): (h(k - 1), ..., h1, w, n), n over rows whose train is 1; n-grams of other rows have n 0."""
    names = [*(f"h{k}" for k in range(order - 1, 0, -1)), "w"]
    out = [stored(_tokens(docs, order, ["train"]).groupBy(*names).agg(F.sum("train").alias("n")))]
    for k in range(1, order):
        out.append(stored(out[-1].groupBy(*names[k:]).agg(F.sum("n").alias("n"))))
    return out[::-1]


def probabilities(counts: list[DataFrame]) -> tuple[DataFrame, int]:
    """(h(order - 1), w, p, base, known) of each n-gram of the highest order, and the number of training tokens.

    p is its probability after its history, evaluated down the orders; base is log10 of the share
    of the word with 0.1 added to each count, known whether training saw it (1 or 0).
    """
    words = counts[0]
    total = words.agg(F.sum("n").alias("tokens"), F.sum((F.col("n") > 0).cast("long")).alias("types")).first()
    tokens, types = total.tokens or 0, total.types or 0
    d = _discounts(words)
    seen = words.filter("n > 0").agg(F.sum(_kept(F.col("n"), d)).alias("s")).first().s or 0.0
    unknown = 1 - seen / tokens if tokens else 1.0
    base = F.log10((F.col("n") + 0.1) / F.lit(tokens + 0.1 * (types + 1)))
    below = words.select("w", F.when(F.col("n") > 0, _kept(F.col("n"), d) / F.lit(float(max(tokens, 1)))).otherwise(F.lit(float(unknown))).alias("p"), base.alias("base"), (F.col("n") > 0).cast("int").alias("known"))
    for k in range(1, len(counts)):
        own, shorter = f"h{k}", [*([f"h{k - 1}"] if k > 1 else []), "w"]
        d = _discounts(counts[k])
        rows = stored(counts[k].select(own, *shorter, "n").join(below.select(*shorter, "p", "base", "known"), shorter).withColumn("kept", _kept(F.col("n"), d)))
        left = rows.filter("n > 0").groupBy(own).agg(F.sum("n").alias("all"), F.sum("kept").alias("mass"), F.sum("p").alias("low"))
        left = left.select(own, "all", ((1 - F.col("mass") / F.col("all")) / F.greatest(1 - F.col("low"), F.lit(1e-12))).alias("weight"))
        p = F.when(F.col("n") > 0, F.col("kept") / F.col("all")).otherwise(F.col("p") * F.coalesce("weight", F.lit(1.0)))
        below = rows.join(left, own, "left").select(own, "w", p.alias("p"), "base", "known")
    return below, tokens


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    held_out is a boolean column; the model learns from the other rows. A null text is empty and
    has one token, its end. Repeated rows count as often as they occur and are scored each; rows of
    equal key and text are told apart by nothing, so they have equal scores. Without training
    rows all is one unknown event of probability 1. Words and histories are known by 64 bits of
    their hash; null keys are keys like any other; an empty table gives no rows.
    """
    if order < 1:
        raise ValueError("the order is 1 at least")
    rows = docs.select(c(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), c(text).alias("text"))
    rows = rows.withColumns({"id": F.xxhash64("key", "text", F.lit(9)), "train": F.when(F.col("held_out"), 0).otherwise(1)})
    found, tokens = probabilities(tables(rows, order))
    names = [f"h{order - 1}", "w"] if order > 1 else ["w"]
    asked = _tokens(rows, order, ["id"]).select(*names, "id")
    summed = asked.join(found, names).groupBy("id").agg(F.count("*").alias("n"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum(F.log10("p")).alias("score"))
    # equal rows were added up together
    per = rows.groupBy("id", "key", "held_out").agg(F.count("*").alias("copies")).join(summed, "id")
    share = lambda n: (F.col(n) / F.col("copies"))
    per = per.select(F.col("key").alias(key), "held_out", share("n").cast("long").alias("n_tokens"), share("known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("score").alias("score"), F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return per.drop("copy")
