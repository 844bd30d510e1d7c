"""Repeats, very large numbers and long threads: what the plain cases of the other tests do not reach."""

import random

from pyspark.sql import functions as F

from ladderlake.llm import chat, langid, mixing, topk


def test_language_beside_many_copies(spark):
    rng = random.Random(3)
    own = {"en": ["the", "of", "and", "thing", "with"], "de": ["der", "und", "nicht", "schen", "ein"]}
    text = lambda lang: " ".join(rng.choice(own[lang]) for _ in range(12))
    rows = spark.createDataFrame([(text(lang), lang) for lang in own for _ in range(40)], "text string, lang string")
    copies = spark.range(300_000).select(F.lit("zzz qqq").alias("text"), F.lit("en").alias("lang"))
    model = langid.fit(rows.unionByName(copies))
    told = langid.predict(spark.createDataFrame([(text(lang), lang) for lang in own for _ in range(50)], "text string, lang string"), model)
    assert told.filter("lang = lang_pred").count() == 100


def test_topk_of_very_large_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(1, 100)] + [(100, [9e6, 1.0]), (0, [-9e6, 2.0]), (101, [1e300, 3.0]), (150, [-1e300, 1.0]), (103, [1e306, 0.0]), (102, [1.7e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    import math

    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows if all(math.isfinite(256 * x) for x in v)}
    clip = lambda x: max(-topk.MOST, min(topk.MOST, x))
    want = []
    for q in (i for i in ints if i % 50 == 0):
        scores = sorted((-clip(sum(a * b for a, b in zip(ints[q], v))), i) for i, v in ints.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    for block in (4096, 16):
        assert sorted(tuple(r) for r in topk.search(df, block=block).collect()) == sorted(want)
    # fewer candidates than k, all of them with scores below any long
    low = spark.createDataFrame([(50, [1e300]), (1, [-1e300]), (2, [-1e301])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(low).orderBy("rank").collect()] == [(1, -topk.MOST), (2, -topk.MOST)]


def test_mixing_of_equal_rows(spark):
    """A source of copies alone, and copies among others: as many words as the queue of all rows, one by one, takes."""
    copies = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one and the same").alias("text"), F.lit("a").alias("source"))
    other = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("x"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "more words")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    docs = copies.unionByName(other)
    x = mixing.mix(docs).toPandas()
    assert len(x) == 52_000 and (x["size"] == 4).sum() >= 50_000 and x.times.between(0, 2).all()
    queue = []
    for _, g in x.groupby("source"):
        g = g.assign(order=[(d & 2**64 - 1) >> 11 for d in g.draw]).sort_values(["order", "draw", "finish"])
        total = g["size"].cumsum()
        assert (abs(g.finish - total / g.target) < 1e-9).all()  # each copy has a time of its own
        for i in (0, 1):
            queue += [((t + i * g.source_size.iloc[0]) / g.target.iloc[0], s) for t, s in zip(total, g["size"])]
    budget, taken = 1.5 * x["size"].sum(), 0
    for _, s in sorted(queue):
        if taken + s > budget:
            break
        taken += s
    assert abs((x["size"] * x.times).sum() - taken) <= 4
    rows = mixing._copies(spark.createDataFrame([(1, 5, 3000), (2, 6, 1)], "key long, draw long, copies long"))
    assert sorted((r.key, r.nth) for r in rows.collect()) == [(1, i) for i in range(1, 3001)] + [(2, 1)]


TALK = "conv_id long, turn long, role string, text string"


def parts_of(spark, rows, most):
    x = chat.conversations(chat.link(spark.createDataFrame(rows, TALK).repartition(5)), most=most).collect()
    return {(r.conv_id, r.thread, r.part): [m.turn for m in r.messages] for r in x}


def test_threads_are_cut_by_their_own_messages(spark):
    rows = [(1, t, "user", f"message {t}") for t in range(250, 262)] + [(2, t, "user", f"m {t}") for t in range(0, 5000, 100)]
    assert parts_of(spark, rows, 256) == {(1, 250, 0): list(range(250, 262)), (2, 0, 0): list(range(0, 5000, 100))}
    assert parts_of(spark, rows, 20) == {(1, 250, 0): list(range(250, 262)), **{(2, 0, p): list(range(0, 5000, 100))[20 * p : 20 * p + 20] for p in range(3)}}


def test_threads_of_many_messages_of_one_turn(spark):
    rows = [(1, 7, "user", f"message {i}") for i in range(900)] + [(1, 8, "bot", "end"), (1, None, "bot", "no turn"), (None, 3, "bot", "no conversation")]
    got = parts_of(spark, rows, 16)
    own = [got[k] for k in sorted((k for k in got if k[0] == 1), key=lambda k: k[2])]
    assert [len(p) for p in own] == [16] * 56 + [6] and sum(own, []) == [None] + [7] * 900 + [8]
    assert [len(p) for k, p in got.items() if k[0] is None] == [1]
