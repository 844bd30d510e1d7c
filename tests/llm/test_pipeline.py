import collections
import math
import zlib

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ladderlake.llm import langid, mixing, pieces, quality
from ladderlake.llm.common import WORD


def test_stages_keep_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    x = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = x
        x = stage(spark, before, "/root/testdata/sf0.001").cache()
        assert x.columns == docs.columns and x.count() > 0 and x.join(before, docs.columns, "left_anti").where("doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL").count() == 0
        if name != "mixture":
            assert x.count() == x.dropDuplicates(["doc_id"]).count()
    assert len(names) == 5


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert "piece_ids" in out.columns
    vocab = pieces.vocabulary()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.decoded == texts[r.doc_id] for r in pieces.decode(out, vocab).collect())


def test_empty(spark):
    none = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0


def test_null_ids_and_repeated_rows(spark):
    some = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.doc_id is not None and r.text]
    a, b = some[:2]
    rows = [r.asDict() | {"doc_id": None if k % 3 == 0 else r.doc_id} for k, r in enumerate(some)] + [a.asDict() | {"doc_id": 10**6}] * 3 + [b.asDict() | {"doc_id": 10**6, "text": f"{' '.join(f'w{k}' for k in range(90))}"}]
    docs = spark.createDataFrame([tuple(r[x] for x in some[0].asDict()) for r in rows], spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    stages, sf = dict(corpus_pipeline.STAGES), "/root/testdata/sf0.001"
    nulls = lambda x: x.filter("doc_id IS NULL").count()
    assert nulls(stages["language"](spark, docs, sf)) > 0 and nulls(stages["quality"](spark, docs, sf)) > 0
    unique = stages["near_duplicates"](spark, docs, sf)
    # each text of the copies is one row: of its own id if the id is not null, else of the copies'; the second text of an id stays
    kept = [r.text for r in unique.filter("doc_id IS NULL OR doc_id = 1000000").collect()]
    assert nulls(unique) > 0 and len(kept) == len(set(kept)) and b.text not in kept
    twice = stages["near_duplicates"](spark, docs.filter("doc_id = 1000000").unionByName(docs.filter("doc_id = 1000000")), sf)
    assert twice.count() == 2
    alone = docs.filter("doc_id IS NULL").unionByName(docs.filter("doc_id IS NULL"))
    assert stages["near_duplicates"](spark, alone, sf).count() == stages["near_duplicates"](spark, docs.filter("doc_id IS NULL"), sf).count() > 0
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.key, r.source, r.size] += r.times
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    got = {(r.doc_id, r.source, r["size"]): r["count"] for r in stages["mixture"](spark, docs, sf).groupBy("doc_id", "source", size.alias("size")).count().collect()}
    assert got == {k: n for k, n in want.items() if n} and any(k[0] is None for k in got)
    assert nulls(stages["pieces"](spark, docs, sf)) == nulls(docs)


SF = "/root/testdata/sf0.001"


def rows_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_language_against_plain_decoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, want = langid.fit(docs), collections.Counter()
    for r in docs.collect():
        x = langid._features(r.text or "").astype(float)
        x[0] = 0
        if not any(map(str.isalpha, r.text or "")) or not x.sum():
            continue
        margins = x @ model["weights"].astype(float) / x.sum()
        losses = sorted(sum(w * math.log1p(math.exp(-4 * m * b)) for m, b, w in zip(margins, row, model["importance"])) for row in model["code"])
        if not (losses[1] - losses[0] < 0.08 and 1 / sum(math.exp(-4 * (x - losses[0])) for x in losses) < 0.4):
            want[r.doc_id, r.text] += 1
    assert rows_of(corpus_pipeline.identify_language(spark, docs, SF)) == want


def test_quality_against_plain_weights(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.collect()
    good = {i for i in {r.doc_id for r in labels.collect()} if all(r.quality == 1 and r.toxic != 1 for r in labels.filter(F.col("doc_id") == i).collect())}
    seen = {i for i in good if zlib.crc32(str(i).encode()) % 5}

    def grams(text):
        data = (text or "").encode()
        if not data.split():
            return collections.Counter()
        out = collections.Counter(xxhash.xxh32_intdigest(w) % quality.FEATURES for w in data.split())
        data = b" " + data + b" "
        out.update(quality.FEATURES + ((a * 0x9E3779B1 + b * 0x85EBCA6B + d * 0xC2B2AE35) % 2**32 >> 8) % quality.FEATURES for a, b, d in zip(data, data[1:], data[2:]))
        return out

    own = [grams(r.text) for r in rows]
    raw, target = collections.Counter(), collections.Counter()
    for r, x in zip(rows, own):
        raw.update(x)
        target.update(x if r.doc_id in seen else {})
    scale = sum(target.values()) / sum(raw.values())
    weights = [sum(n * math.log((target[f] + 1) / (raw[f] * scale + 1)) for f, n in x.items()) if x else None for x in own]
    kept_back = sorted(w for r, w in zip(rows, weights) if r.doc_id in good - seen and w is not None)
    least = kept_back[min(len(kept_back) - 1, math.ceil(0.01 * len(kept_back)))]
    k = sum(w is not None and w >= least - 1e-9 for w in weights)
    drawn = {(r.doc_id, r.text): r for r in quality.draw(docs, labels).collect()}
    keys = sorted((drawn[r.doc_id, r.text].gumbel_key for r, w in zip(rows, weights) if w is not None), reverse=True)
    for r, w in zip(rows, weights):
        got = drawn[r.doc_id, r.text]
        assert (got.log_weight is None) == (w is None) and (w is None or abs(got.log_weight - w) < 1e-6) and got.selected == (w is not None and got.gumbel_key >= keys[k - 1])
    assert rows_of(corpus_pipeline.classify_quality(spark, docs, SF)) == collections.Counter(x for x, r in drawn.items() if r.selected)


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    want = collections.Counter(rows[x] for x in set(root))
    assert rows_of(corpus_pipeline.drop_near_duplicates(spark, docs, SF)) == want and sum(want.values()) < len(rows)
