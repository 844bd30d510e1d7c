"""Fill-in-middle, the trie of conversations and byte-level BPE against plain versions."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderlake.llm import byte_bpe, infill, trie

SF = "/root/testdata/sf0.001"


# 11
def test_elias_fano():
    rng = random.Random(1)
    for n, top in ((1, 0), (1, 5), (3, 3), (50, 10), (1000, 10**6), (7, 2**40)):
        values = np.array(sorted(rng.randint(0, top) for _ in range(n)), np.int64)
        code = infill.EliasFano(values)
        assert (code.select(np.arange(n)) == values).all()
        assert len(code.high) * 8 <= 4 * n + 16


def plain_infill(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


INFILL = [(1, None), (2, ""), (3, "\n"), (4, "a\n\nb"), (5, "ä\n🙂🙂\nx"), (None, "a\nb\nc\n"), (7, "has <P> in it\n"), (8, "<\nS\n>\n<S"), (9, "one line"), (10, "x\r\ny\n" * 30000)] + [(11, "same\ntext\n")] * 40 + [(i, "hot\ntext\nhere") for i in range(20, 220)]


def test_infill_against_plain(spark):
    docs = spark.createDataFrame([(k, t, "q") for k, t in INFILL], "doc_id long, text string, Mark string").repartition(6)
    for rate in (100, 40):
        x = infill.fill_in_middle(docs, rate=rate).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        key = lambda r: (str(r[0]), r[1] or "")
        got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in x), key=key)
        assert got == sorted(((k, t, *plain_infill(k, t, rate=rate)) for k, t in INFILL), key=key)
        assert all(r.back == (r.text or "") and r.Mark == "q" for r in x)
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_infill_splits_hot_texts(spark):
    docs = spark.range(4000, numPartitions=16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same\ntext").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    sizes = infill._grouped(docs, "text").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.sum() == 4000 and sizes.max() < 2200


def test_infill_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = con.execute(infill.OP11_SQL).df(), infill.op11_infill(spark, SF).toPandas()
    order = lambda x: x.sort_values("doc_id").fillna(-1)[sorted(want.columns)].values.tolist()
    assert order(want) == order(got)


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<P<", "<S>", "<M>"), ("<P", "<P>", "<M>")])
def test_infill_refuses_marks(spark, marks):
    with pytest.raises(ValueError):
        infill.fill_in_middle(spark.createDataFrame([(1, "x")], "doc_id long, text string"), marks=marks)


# 12
def plain_trie(sequences):
    nodes, kids, sums, out = {}, {}, {}, []
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), ([], []))[0].append(c)
        nodes[tuple(seq)][1].append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        members, ends = nodes[k]
        below = kids.get(k, [])
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", k[-1][1].encode())) if k else 0
        sums[k] = (sum(sums[x][0] for x in below) if below else 1, (len(members) - 1) * words + sum(sums[x][1] for x in below))
        out.append((min(members), len(k), min(nodes[k[:-1]][0]) if k else None, len(members), len(below), *sums[k], hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rows):
    out = {}
    for c, t, r, x in rows:
        if c is not None:
            out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def plain_rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(int(c - (abs(c) % 20) * (1 if c >= 0 else -1)), [])[: h[c]] + own[h[c] :] for c, own in convs.items()}


TALK = "conv_id long, turn long, role string, text string"


def nodes_of(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=repr)


def test_trie_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = trie.op12_trie(spark, "/root/testdata/sf0.01")
    assert dict(got.dtypes) == {n: "bigint" for n in got.columns if n != "ends_sha256"} | {"ends_sha256": "string"}
    assert nodes_of(got) == plain_trie(plain_rebuilt(conversations(map(tuple, rows))))


def random_talk(rng, n, starts=-40):
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "hi there", "a b  c", "", None])) for c in range(starts, starts + n) for t in range(rng.choice([0, 1, 2, 3, 6]))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(9)]  # a large group of copies
    rows += [(2000, t, "user", "on and on") for t in range(600)]  # a very long one
    return rows + [(5, None, "user", "no turn"), (None, 1, "user", "no conversation"), (6, 1, "bot", "hi"), (6, 1, "bot", "hi")]


def test_trie_against_plain(spark, monkeypatch):
    rows = random_talk(random.Random(4), 300)
    df = spark.createDataFrame(rows, TALK).repartition(5)
    want = plain_trie(plain_rebuilt(conversations(rows)))
    assert nodes_of(trie.trie(trie.rebuilt(trie.turns_of(df)))) == want
    for name, value in (("CHUNK", 7), ("AT_ONCE", 50), ("PARTITION", 100)):  # small chunks and shards, so many heavy levels
        monkeypatch.setattr(trie, name, value)
    assert nodes_of(trie.trie(trie.rebuilt(trie.turns_of(df)))) == want


def test_trie_odd(spark):
    none = spark.createDataFrame([], TALK)
    assert trie.trie(trie.turns_of(none)).count() == 0
    one = spark.createDataFrame([(3, 0, "user", "x")], TALK)  # crc32 takes its only turn, its family has no first one
    assert nodes_of(trie.trie(trie.rebuilt(trie.turns_of(one)))) == plain_trie(plain_rebuilt({3: [("user", "x")]}))


def test_louds():
    tree = trie.Louds(np.array([0, 0, 1, 1, 2, 5]), np.array([9, 4, 1, 2, 3, 7]))
    assert tree.parents().tolist() == [-1, 0, 0, 1, 1, 2, 5] and tree.levels().tolist() == [0, 1, 3, 6, 7]
    assert tree.rolled(np.ones(7, np.int64)).tolist() == [7, 3, 3, 1, 1, 2, 1] and tree.children(0).tolist() == [2, 1]
    assert trie.Louds(np.zeros(0, np.int64), np.zeros(0, np.int64)).levels().tolist() == [0, 1]


# 13
@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.ranks_of(byte_bpe.public_ranks()), byte_bpe.public_pattern())


@pytest.fixture(scope="module")
def known():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.public_pattern(), mergeable_ranks=byte_bpe.ranks_of(byte_bpe.public_ranks()), special_tokens={})


def odd_texts():
    rng = random.Random(1)
    pick = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    long = ["a" * 5000, "ab" * 3000, pick("abcdefgh", 9000), pick("aàé中🙂 \n\t'sreld19", 20000), pick("ing the", 5000), " " * 3000 + "x", "-" * 1001, "\n" * 500 + " a", "<|endoftext|> it's we'LL", "x\x1cy\x85z​ "]
    every = "".join(map(chr, rng.sample([*range(0xD800), *range(0xE000, 0x110000)], 60000)))
    return ["", None, *long, every] + [pick("etaoinshrdlu", rng.randint(1, 300)) for _ in range(500)]


def test_bpe_against_library(spark, bpe, known):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, N_Tokens string").repartition(3)
    x = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs, bpe), bpe).collect()}
    for i, t in enumerate(texts):
        want = known.encode_ordinary(t or "")
        assert x[i].n_tokens == len(want) and bytes(x[i].ids) == struct.pack(f"<{len(want)}I", *want), i
        assert bytes(x[i].decoded) == (t or "").encode()
    assert byte_bpe.encode(docs.limit(0), bpe).count() == 0


def test_bpe_of_random_vocabularies():
    """Merges of any order of ranks, against one pair at a time; wide rows too."""
    rng = random.Random(2)
    for trial in range(30):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 60:
            tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))))
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        own = byte_bpe.ByteBpe(ranks, r"\w+")
        for size in (1, 2, 7, 30, 200):
            word = bytes(rng.choice(b"abc") for _ in range(size))
            parts = [word] if word in ranks else [word[i : i + 1] for i in range(size)]
            while True:
                best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert own.words([word, b"a"])[1].tolist() == [ranks[p] for p in parts] + [ranks[b"a"]]


def test_bpe_query(spark, known):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in byte_bpe.op13_byte_bpe(spark, SF).collect():
        ids = known.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_refuses(bpe):
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe({b"a": 0}, r"\w+")
    with pytest.raises(ValueError):
        bpe.decode(np.array([50_256], np.uint32))
