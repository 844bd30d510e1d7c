import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ladderlake.llm import backoff, chat, graph, katz, langid, licenses, merkle, mixing, pieces, quality, simhash, topk
from ladderlake.llm.common import kth_largest, remainder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, draw string, key string"
ODD = [(1, None, "a", "s", 0, "x", "x"), (2, "", "a", None, 0, "x", "x"), (3, "  \n\t ", None, "s", 0, None, None), (4, "42 17 !!", "b", "t", 0, None, None), (5, "one two three", "a", "s", 0, None, None), (5, "one two three", "a", "s", 0, None, None), (None, "one two three four", "a", "s", 0, None, None), (7, "mot " * 60000, "b", "t", 0, None, None), (8, "é ß 漢字 \U0001f600 x", "b", None, 0, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()


# 1
def test_language_held_out(spark):
    x = langid.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    seen = x[x.held_out & x.lang.notna() & (x.lang_pred != "und")]
    assert len(x) == 1000 and (seen.lang == seen.lang_pred).mean() > 0.95 and x.score.between(0, 1).all()
    assert (x.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in x.doc_id]).all()


def test_language_odd(odd, none):
    model = langid.fit(odd)
    x = langid.predict(odd, model).select("doc_id", "lang_pred").collect()
    assert len(x) == len(ODD) and {r.lang_pred for r in x if r.doc_id in (1, 2, 3, 4)} == {"und"}
    assert langid.predict(none, model).count() == 0 and {r.lang_pred for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}
    code = langid.codewords(30)
    assert min(np.abs(a - b).sum() for a, b in itertools.combinations(code, 2)) > 0


def test_language_of_many_languages(spark):
    rng = random.Random(2)
    rows = [(k, f"l{k}", " ".join("".join(rng.choice("".join(chr(97 + (k * 7 + j * j) % 26) for j in range(5))) for _ in range(6)) + f"{chr(0x4E00 + k)}" for _ in range(40))) for k in range(300) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, TEXT string")
    model = langid.fit(docs)
    assert len(model["langs"]) == 300
    x = langid.predict(docs, model).toPandas()
    assert (x.lang == x.lang_pred).mean() > 0.95
    again = langid.fit(docs.repartition(7))
    assert np.allclose(model["weights"], again["weights"], atol=1e-5)


def test_language_against_brute_force(spark):
    rows = [("a", "the cat sat on the mat"), ("a", "the hat"), ("b", "le chat est sur la table"), ("b", "la vie"), ("c", "der hund und die katze"), ("a", "the cat sat on the mat")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(docs)
    counts = {name: sum((langid._features(t) for n, t in set(rows) if n == name), np.zeros(langid.FEATURES)) for name in "abc"}
    for x in counts.values():
        x[0] = 0
    p = {name: (x + 0.5) / (x.sum() + 0.5 * langid.FEATURES) for name, x in counts.items()}
    bit = model["code"][:, 0]
    yes, no = (np.mean([p[n] for n, s in zip("abc", bit) if s == sign], axis=0) for sign in (1, -1))
    odds = np.log(yes / no)
    odds[0] = 0
    odds -= (yes @ odds + no @ odds) / 2
    odds[0] = 0
    assert np.allclose(model["weights"][:, 0], odds / ((yes @ odds - no @ odds) / 2), atol=1e-4)
    x = langid._features("the vat").astype(float)
    x[0] = 0
    losses = [sum(w * math.log1p(math.exp(-4 * m * s)) for m, s, w in zip(x @ model["weights"] / x.sum(), row, model["importance"])) for row in model["code"]]
    got = langid.predict(spark.createDataFrame([("the vat", 9)], "text string, LANG_PRED int"), model).first()
    odds = np.exp(-4 * (np.array(losses) - min(losses)))
    assert got.lang_pred == "abc"[int(np.argmin(losses))] and abs(got.lang_score - 1 / odds.sum()) < 1e-5 and len(got) == 4


# 2
def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 24) / 256]) for i in range(300)] + [(50, [1.0] * 24), (400, None), (401, [1.0, None] * 12), (402, [math.nan] * 24), (403, [1.0] * 3), (None, [0.5] * 24)]
    got = collections.defaultdict(list)
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tasks=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q in (0, 100, 150, 200, 250):
        v = dict(good[:300])[q]
        want = sorted((-int(v @ w), math.inf if j is None else j) for k, (j, w) in enumerate(good) if j != q and len(w) == 24)[:5]
        assert [(-s, math.inf if j is None else j) for s, j in got[q]] == want
    assert len(got[50]) == 10  # two rows of one id ask each
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    huge = spark.createDataFrame([(0, [1e300]), (1, [1.0]), (50, [2.0]), (2, []), (100, [])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in topk.search(huge).collect()) == [(0, 1, topk.MOST), (0, 50, topk.MOST), (50, 0, topk.MOST), (50, 1, 256 * 512), (100, 2, 0)]


def test_topk_prunes():
    """On vectors in clusters, fewer than half of the candidates come to the last columns."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 64))
    x = np.floor(256 * (centers[rng.integers(0, 40, 4096)] + 0.2 * rng.normal(size=(4096, 64)))).astype(np.int64).T
    reached, ids, uids = [], __import__("pyarrow").array(range(4096)), np.arange(4096)
    top = np.full((64, 5), -(2**62))
    first = list(topk.best(uids[:64], x[:, :64], top, ids, uids, x))
    assert len(first) == 1
    for i, j, s in topk.best(uids[:64], x[:, :64], top.copy(), ids, uids, x, reached=reached):
        best = (x[:, :64].T @ x)
        best[np.arange(64), np.arange(64)] = -(2**62)
        assert all(sorted(s[i == k])[-1] == best[k].max() for k in range(64))
    assert sum(b for _, b in reached) < 0.5 * sum(a for a, _ in reached)


def test_topk_grid(spark):
    """Many blocks in a grid of several rows and columns, repeated ids, against a dense product."""
    rng = np.random.default_rng(6)
    rows = [(int(i % 180), [float(v) for v in rng.normal(size=8)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "Vec_Id long, embedding array<double>").repartition(3)
    got = collections.Counter((r.query_id, r.vec_id, r.score) for r in topk.search(vectors, tasks=24, every=3, block=16, k=2).collect())
    v = np.floor(256 * np.array([x for _, x in rows])).astype(np.int64)
    want = collections.Counter()
    for a, (i, _) in enumerate(rows):
        if i % 3 == 0:
            for s, j in sorted((-int(v[a] @ v[b]), j) for b, (j, _) in enumerate(rows) if b != a)[:2]:
                want[i, j, -s] += 1
    assert got == want


# 3
def test_licenses(spark, odd, none):
    mit = dict(licenses.KNOWN)["MIT"]
    text = next(t for n, t in licenses.KNOWN if n == "MIT")
    rows = [(1, text.upper().replace(".", " ;")), (2, "Copyright (c) 2020 A. Person\n" + text.replace("sublicense", "sub-licence")), (3, text + " and more"), (4, "words\nLicensed under CC BY 4.0.\nwords"), (5, None), (6, "")]
    x = {r.doc_id: (r.license, r.line_licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark)).collect()}
    whole = licenses._MIT + "\n\n" + licenses._ZLIB.replace("\n\n", "\n \n") + "\n\nCopyright Acme Inc.\n\nlast words"
    rows = [(1, "# header\n\n" + whole), (2, licenses._MIT.split("\n\n")[0] + "\n\nother words"), (1, "# header\n\n" + whole), (3, "# Copyright Acme Inc.\n" + "\n".join(f"# {x}" for x in licenses._MIT.split("\n")))]
    assert sorted((r.doc_id, r.license or "", r.block_licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark)).collect()) == [(1, "", "MIT,Zlib"), (1, "", "MIT,Zlib"), (2, "", ""), (3, "MIT", "MIT")]
    assert mit and x[1][0] == x[2][0] == "MIT" and x[3][0] is None and x[4] == (None, "CC-BY-4.0") and x[5] == x[6] == (None, "")
    assert licenses.scan(odd, licenses.known(spark)).count() == len(ODD) and licenses.scan(none, licenses.known(spark)).count() == 0


def test_license_digests(spark):
    """Where the machine has the whole texts, their digests are those of the table."""
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(n, open(f"{folder}/{f}", encoding="utf-8", errors="replace").read()) for f, n in names.items() if os.path.exists(f"{folder}/{f}")]
    x = licenses.scan(spark.createDataFrame([(n, "\n\n" + t.upper()) for n, t in rows], "doc_id string, text string"), licenses.known(spark)).collect()
    assert {r.doc_id: r.license for r in x} == {n: n for n, _ in rows}


def test_license_tags(spark):
    rows = [(1, "// SPDX-License-Identifier: MIT\nint x;"), (2, "SPDX-License-Identifier: MPL-2.0")]
    x = {r.doc_id: (r.license, r.line_licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark)).collect()}
    assert x == {1: (None, "MIT"), 2: ("MPL-2.0", "MPL-2.0")}


# 4
def test_pieces_round_trip(odd, none, docs):
    vocab = pieces.vocabulary()
    x = pieces.encode(odd, vocab, check=True)
    back = {(r.doc_id, r.text, r.decoded) for r in pieces.decode(x, vocab).collect()}
    assert all(a == b for _, a, b in back) and all(r.lossless for r in x.filter("text IS NOT NULL").collect())
    assert [r.piece_ids for r in x.filter("text = ''").collect()] == [[]] and pieces.encode(none, vocab).count() == 0
    a, b = (sorted((r.doc_id, r.piece_ids) for r in pieces.encode(docs.repartition(n), vocab).collect()) for n in (1, 5))
    assert a == b


def test_pieces_draw_as_the_lattice_says():
    vocab = {"ids": {b" a": 0, b"b": 1, b" ab": 2, b" ": 3, b"a": 4}, "logs": {b" a": math.log(0.3), b"b": math.log(0.2), b" ab": math.log(0.1), b" ": math.log(0.2), b"a": math.log(0.2)}, "bytes": list(range(100, 356)), "byte_log": -20.0, "lines": True}
    drawn = collections.Counter(tuple(x) for x in pieces.Lattice(vocab).sample(["ab"] * 20000, [xxhash.xxh64_intdigest(str(i)) for i in range(20000)]))
    ways = {(2,): 0.1, (0, 1): 0.06, (3, 4, 1): 0.008}
    for way, p in ways.items():
        assert abs(drawn[way] / 20000 - p / sum(ways.values())) < 0.02


def test_pieces_of_a_long_word():
    lattice = pieces.Lattice(pieces.vocabulary())
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEF+/漢é") for _ in range(1_000_000))
    began = time.time()
    ids = lattice.sample([text], [5])[0]
    assert time.time() - began < 30 and lattice.decode(ids.tolist()) == text
    short = text[:3000]
    whole = lattice.filtered([short.encode()])
    try:
        pieces.LONG = 10**9
        plain = lattice.filtered([short.encode()])
    finally:
        pieces.LONG = 1024
    assert all((a == b).all() for a, b in zip(whole[:4], plain[:4])) and np.abs(whole[4].astype(float) - plain[4].astype(float)).max() < 2**8


def test_op4(spark):
    x = pieces.op4_sentencepiece(spark, SF)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lattice, rows = pieces.Lattice(pieces.vocabulary()), x.collect()
    assert len(rows) == len(docs) and all(r.lossless and lattice.decode(r.piece_ids) == docs[r.doc_id] and r.n_pieces == len(r.piece_ids) for r in rows if docs[r.doc_id] is not None)


def test_pieces_clashing_names(spark):
    x = pieces.encode(spark.createDataFrame([(1, "one two", "old")], "DOC_ID long, TEXT string, Piece_Ids string"), pieces.vocabulary()).first()
    assert x["piece_ids"] and len(x) == 3


# 5
def test_mixing(docs, odd, none):
    x = mixing.mix(docs).toPandas()
    sizes = x.groupby("source")["size"].sum()
    weight = dict(zip(sorted(sizes.index), itertools.cycle((5, 2, 1))))
    target, budget, open_ = {}, 1.5 * sizes.sum(), set(sizes.index)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] if full else weight[s] * level for s in full or open_}
        open_ = open_ - full if full else set()
    for s, g in x.groupby("source"):
        assert abs(g.target.iloc[0] - target[s]) < 1e-6 * target[s]
        assert abs((g["size"] * g.times).sum() - target[s]) <= 2 * x["size"].max() and g.times.between(0, 2).all()
    assert (x["size"] * x.times).sum() <= budget
    again = mixing.mix(docs.repartition(7)).toPandas().set_index("key").times
    assert (again.sort_index() == x.set_index("key").times.sort_index()).all()
    # the queue: all passes by finish time, until the next document would exceed the budget
    queue = []
    for name, g in x.groupby("source"):
        g = g.assign(order=[(d & 2**64 - 1) >> 11 for d in g.draw]).sort_values(["order", "draw", "key"])
        total = g["size"].cumsum()
        for i in (0, 1):
            queue += [((t + i * sizes[name]) / target[name], d, k, i, s) for t, d, k, s in zip(total, g.draw, g.key, g["size"]) if s]
    left, times = budget, collections.Counter()
    for _, _, k, _, s in sorted(queue):
        if s > left:
            break
        left -= s
        times[k] += 1
    assert all(times[r.key] == r.times for r in x.itertuples())
    y = mixing.mix(odd).toPandas()
    assert len(y) == len(ODD) and y["size"].sum() == sum(len(words(r[1])) for r in ODD) and mixing.mix(none).count() == 0


# 6
def plain_fingerprint(text, width):
    w = words((text or "").encode().lower().decode()) if text else []
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(marks, distance):
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for a, b in itertools.combinations(sorted(marks), 2):
        if (a ^ b).bit_count() <= distance:
            root[find(a)] = find(b)
    return {m: find(m) for m in marks}


def test_simhash_against_brute_force(spark, docs):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(200)) for _ in range(20)]
    near = [" ".join(w if rng.random() > 0.004 else "zz" for w in t.split()) for t in base for _ in range(6)]
    rows = list(enumerate(base + near + ["", None, "One  Two", "one two", base[0]]))
    got = {r.doc_id: r for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), distance=4, width=4, words=1, block=16).collect()}
    marks = {i: plain_fingerprint(t, 4) for i, t in rows}
    root = plain_components(set(marks.values()), 4)
    least = {}
    for i, m in marks.items():
        least[root[m]] = min(i, least.get(root[m], i))
    assert all(got[i].simhash0 & (1 << 64) - 1 == m and got[i].component_id == least[root[m]] for i, m in marks.items())
    assert len(got) == len(rows)


def test_simhash_odd(odd, none):
    x = simhash.groups(odd).collect()
    assert len(x) == len(ODD) and {r.component_id for r in x if r.doc_id in (1, 2, 3)} == {1} and simhash.groups(none).count() == 0


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def changed(rng, text, share):
    """text with its last words replaced, so that it shares about so much of all five-word shingles."""
    w = text.split()
    cut = round(2 * share / (1 + share) * (len(w) - 4)) + 4
    return " ".join(w[:cut] + [f"n{rng.random()}" for _ in w[cut:]])


def test_alike_against_brute_force(spark):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.random()}" for _ in range(rng.randint(150, 400))) for _ in range(150)]
    texts = [t for b in base for t in (b, changed(rng, b, 0.81))] + [t for b in base[:60] for t in (b[::-1], changed(rng, b[::-1], 0.75))] + ["", None, "One  Two", "one two", base[0]]
    sets = [plain_shingles(t) for t in texts]
    linked = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} | {(len(texts) - 5, len(texts) - 4)}
    root = list(range(len(texts)))
    for i, j in sorted(linked):
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (simhash.BLOCK, 4):
        got = {r.doc_id: r.component_id for r in simhash.alike(rows, block=block).collect()}
        assert len(got) == len(texts) and all(got[got[i]] == got[i] and root[got[i]] == root[i] for i in got)  # no link that brute force lacks
        assert sum(got[i] == got[j] for i, j in linked) >= 0.96 * len(linked)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    x = {r.node: r.root for r in graph.components(links).collect()}
    assert all(x[i] == 0 for i in range(301)) and x[1001] == 1000


# 7
def test_chat(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine."), (1, 2, "user", "On Monday X wrote:\n>> how ARE you\n> Fine.\nGood."), (1, 3, None, None), (1, 4, "user", ""), (None, 0, "user", "> Fine."), (2, 1, "user", "> unknown\nnew")]
    x = {(r.conv_id, r.turn): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (x[1, 1].reply_to, x[1, 1].text, x[1, 2].reply_to, x[1, 2].text, x[1, 2].deepest) == (0, "Fine.", 1, "Good.", 2)
    assert x[1, 2].thread == 0 and x[1, 3].text == "" and x[None, 0].reply_to is None and x[2, 1].reply_to is None and len(x) == len(rows)
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_wrapped_and_repeated_quotes(spark):
    rows = [(1, 0, "a", "Yes."), (1, 1, "b", "Alpha beta gamma delta epsilon.\nZeta eta."), (1, 2, "a", "Yes."), (1, 3, "b", "> Alpha beta gamma\n> delta epsilon. Zeta eta.\nok"), (1, 4, "b", "> Yes.\nwhy"), (1, 5, "a", "> delta. Alpha beta\n> gamma delta epsilon.\nhm"), (1, 6, "a", "First line\nsecond line"), (1, 7, "b", "> First line second line\nfine"), (1, 8, "b", "Yes.\n> Yes.")]
    x = {r.turn: r.reply_to for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert x == {0: None, 1: None, 2: None, 3: 1, 4: 2, 5: 1, 6: None, 7: 6, 8: 2}


def plain_units(text):
    """(level, kind, normalised) of passages, sentences and lines."""
    lines = []
    for x in (text or "").replace("\r\n", "\n").split("\n"):
        m = re.match(r"[ \t]*((?:>[ \t]?)+)", x)
        lines.append((m.group(1).count(">"), x[m.end() :]) if m else (0, x))
    plain = lambda x: " ".join(re.sub(r"[!-/:-@\[-`{-~\s]+", " ", x.lower()).split())
    passages, before = [], None
    for level, x in lines:
        if passages and before == level and plain(x) and plain(passages[-1][1].split("\n")[-1]):
            passages[-1] = (level, passages[-1][1] + "\n" + x)
        else:
            passages.append((level, x))
        before = level
    passages = [(level, x.replace("\n", " ")) for level, x in passages]
    out = [(level, 2, plain(x)) for level, x in passages] + [(level, 1, plain(y)) for level, x in passages for y in re.split(r"(?<=[.!?;:…])\s+", x)] + [(level, 0, plain(x)) for level, x in lines]
    return {u for u in out if u[2]}


def plain_links(rows):
    """reply_to and thread of each (conv, turn)."""
    links = {}
    for conv, turn, _, text in rows:
        best = None
        for level, kind, said in plain_units(text):
            origins = [t for k, t, _, x in rows if k == conv and t < turn and (0, kind, said) in plain_units(x)]
            if level and origins:
                best = max(best or (-99,), (-level, kind, len(said), max(origins)))
        links[conv, turn] = best[-1] if best else None
    top = {}
    for conv, turn in links:
        at = turn
        while links[conv, at] is not None:
            at = links[conv, at]
        top[conv, turn] = at if at != turn else min(t for k, t in links if k == conv)
    return links, top


def test_chat_against_brute_force(spark):
    """Planted quotes: whole, re-wrapped, nested, of single sentences, of words said often."""
    rng, rows = random.Random(8), []
    for conv in range(12):
        said = []
        for turn in range(14):
            own = ["Yes.", "No way!"][: rng.randint(0, 1)] + [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(2, 9))) + rng.choice([".", "?", ""]) for _ in range(rng.randint(1, 3))]
            lines = []
            if said and rng.random() < 0.7:
                words = rng.choice(said[-1:] if rng.random() < 0.3 else said).split(" ")
                cut = rng.randint(1, len(words))
                mark = rng.choice(["> ", ">", ">> ", "> > "])
                lines = [mark + " ".join(words[:cut])] + ([mark + " ".join(words[cut:])] if cut < len(words) else [])
                lines = ["On Monday A wrote:"] * (rng.random() < 0.3) + [x.upper() if rng.random() < 0.2 else x for x in lines]
            said += [" ".join(own), *own]
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), "\n".join(lines + own)))
    links, top = plain_links(rows)
    df = spark.createDataFrame(rows, "CONV_ID long, turn long, role string, text string")
    linked = chat.link(df, conversation="conv_id")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread) for r in linked.collect()}
    assert got == {k: (links[k], top[k]) for k in links} and sum(x is not None for x in links.values()) > 60
    for r in chat.conversations(linked, most=5).collect():
        turns = [m.turn for m in r.messages]
        assert turns == sorted(turns) and len(turns) <= 5 and r.chat.count("<|im_start|>") == len(turns) and all(top[r.conv_id, t] == r.thread for t in turns)
        assert all(m.reply_to is None or m.reply_to < m.turn for m in r.messages) and "> alpha" not in r.chat


def test_chat_hot_and_odd(spark):
    rows = [(1, 1, "u", f"text {i}") for i in range(900)] + [(None, i, "u", "x") for i in range(600)] + [(2, None, "u", None), (3, 0, "u", "word " * 200_000)]
    x = chat.conversations(chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sum(len(r.messages) for r in x) == len(rows) and max(len(r.messages) for r in x) < 600


# 8
def test_quality_on_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learnt = remainder(F.col("doc_id"), 2) == 1
    x = quality.draw(docs, labels.filter(learnt)).join(labels.filter(~learnt), "doc_id").toPandas()
    good, bad = x[(x.quality == 1) & (x.toxic == 0)], x[x.quality == 0]
    assert len(good) > 1000 and good.selected.mean() > 0.97
    assert len(bad) > 200 and bad.selected.mean() < 0.1


def plain_quality(rows, good):
    """log_weight of each text by the definition."""
    raw, target = collections.Counter(), collections.Counter()
    grams = []
    for i, t in rows:
        data = (t or "").encode()
        own = collections.Counter(("w", xxhash.xxh32_intdigest(w) % quality.FEATURES) for w in data.split())
        if own:
            data = b" " + data + b" "
            own.update(("c", ((a * 0x9E3779B1 + b * 0x85EBCA6B + d * 0xC2B2AE35) % 2**32 >> 8) % quality.FEATURES) for a, b, d in zip(data, data[1:], data[2:]))
        grams.append(own)
        raw.update(own)
        if i in good:
            target.update(own)
    scale = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + 1) / (n * scale + 1)) for g, n in raw.items()}
    return [sum(ratio[g] * n for g, n in own.items()) if own else None for own in grams]


def test_quality_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "of", "é", "JUNK!!", "漢字", "x"]) for _ in range(rng.randint(1, 30)))) for i in range(200)] + [(200, None), (201, ""), (None, "the of"), (None, "x x"), (7, "the second")]
    good = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "key long")
    docs = spark.createDataFrame(rows, "doc_id long, Text string")
    scored = quality.score(docs, quality.fit(docs, good, "text"), "text")
    x = quality.resample(scored, 50, ["doc_id", "text"]).collect()
    want = dict(zip(rows, plain_quality(rows, set(range(0, 200, 3)))))
    assert len(x) == len(rows) and all(r.log_weight is None if want[r.doc_id, r.Text] is None else abs(r.log_weight - want[r.doc_id, r.Text]) < 1e-6 for r in x)
    keys = sorted((r.gumbel_key for r in x if r.gumbel_key is not None), reverse=True)
    assert all(r.selected == (r.gumbel_key is not None and r.gumbel_key >= keys[49]) for r in x) and sum(r.selected for r in x) == 50
    # what is added to the weights is Gumbel noise: mean 0.577, deviation 1.283
    noise = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(0.0).alias("log_weight"))
    noise = quality.resample(noise, 20000, ["doc_id"]).agg(F.avg("gumbel_key"), F.stddev("gumbel_key")).first()
    assert abs(noise[0] - 0.577) < 0.05 and abs(noise[1] - 1.283) < 0.05


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (7, None, 1), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    x = quality.draw(odd, labels).collect()
    assert len(x) == len(ODD) and not any(r.selected for r in x if r.doc_id in (1, 2, 3))
    assert quality.draw(none, labels).count() == 0 and quality.draw(odd, labels.limit(0), k=0).filter("selected").count() == 0
    assert {r.selected for r in quality.draw(odd, labels, k=100).filter("doc_id = 5").collect()} == {True}
    values = spark.createDataFrame([(float(i % 97),) for i in range(20000)], "x double")
    want = sorted((float(i % 97) for i in range(20000)), reverse=True)
    assert [kth_largest(values, "x", k) for k in (1, 9999, 20000, 20001)] == [want[0], want[9998], want[-1], None]


# 9
def test_fingerprints_against_brute_force(spark, docs):
    x = {r.doc_id: r for r in merkle.op9_fingerprints(spark, SF).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    by_text = collections.defaultdict(set)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert x[i].n_chars == len(t) and x[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text[t].add(x[i].fingerprint)
        by_text[edited].add(x[i].edited_fingerprint)
        assert 0 <= x[i].near_edited <= 1 and 0 <= x[i].near_next <= 1
    assert all(len(f) == 1 for f in by_text.values()) and len({min(f) for f in by_text.values()}) == len(by_text)


def test_fingerprints_odd(spark, odd, none):
    assert merkle.against_next(odd).count() == len(ODD) and merkle.against_next(none).count() == 0
    x = merkle.against_next(spark.createDataFrame([(1, "a b. c")], "doc_id long, text string")).first()
    assert x.near_next == 1.0
    with pytest.raises(ValueError):
        merkle.against_next(odd, key="key")


def cut(p, after):
    ends = [i for i in range(2, len(p) + 1) if p[i - 1] == " " and p[i - 2] in after]
    return [p[a:b] for a, b in zip([0, *ends], [*ends, len(p)])]


def plain_tree(text):
    """(root, sections, starts, paragraphs, leaves) by the definition."""
    d, most = lambda x: hashlib.sha256(x.encode()).hexdigest()[:32], merkle.LEAF
    long = lambda x: len(x) > 2 * most
    leaves = [[d(z) for x in cut(p, ".,;:!?") for y in (cut(x, merkle.ENDS) if long(x) else [x]) for z in ([y[i : i + most] for i in range(0, len(y) + 1, most)] if long(y) else [y])] for p in text.split("\n")]
    paragraphs, sections, starts, run = [d("".join(x)) for x in leaves], [], [], []
    for i, x in enumerate(paragraphs):
        starts += [] if run else [i]
        run.append(x)
        if x[0] in "0123" or i == len(paragraphs) - 1:
            sections.append(d("".join(run)))
            run = []
    return hashlib.sha256("".join(sections).encode()).hexdigest(), sections, starts, paragraphs, leaves


def plain_changed(a, b):
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return head, len(a) - tail, len(b) - tail


def test_edits_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        old = [" ".join(rng.choice(["abc", "de", "f.", "漢字", "\U0001f600", "xyz,", "long" * rng.randint(1, 200)]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 30))]
        old, new = old + old[:2] * 2 * (k % 3 == 0), None
        new = list(old)
        if k % 5 == 0:
            new.pop(rng.randrange(len(new)))
        elif k % 5 == 1:
            new.insert(rng.randint(0, len(new)), "new one.")
        elif k % 5 == 2:
            new.reverse()
        elif k % 5 == 3:
            new[-1] += " tail"
        rows.append(("\n".join(old), "\n".join(new)))
    rows += [("", ""), ("a. b. c.", "a. c. b."), ("a. a. b.", "a. b.")]
    x = spark.createDataFrame(rows, "a string, b string").select("a", "b", merkle.tree(F.col("a")).alias("p"), merkle.tree(F.col("b")).alias("q"))
    x = x.select("*", merkle.edited(F.col("p"), F.col("q")).alias("e"), merkle.likeness(merkle.brief(F.col("p")), merkle.brief(F.col("q"))).alias("near"))
    for r in x.collect():
        p, q = plain_tree(r.a), plain_tree(r.b)
        assert tuple(r.p) == p and tuple(r.q) == q
        m, n = (collections.Counter([*t[1], *t[3], *(y for z in t[4] for y in z)]) for t in (p, q))
        assert abs(r.near - (1 if p[0] == q[0] else 2 * sum((m & n).values()) / (sum(m.values()) + sum(n.values()) + 2))) < 1e-12
        if p[0] == q[0]:
            assert r.e is None
            continue
        at, old, new = plain_changed(p[3], q[3])
        below = plain_changed([y for z in p[4][at : at + old] for y in z], [y for z in q[4][at : at + new] for y in z])
        assert tuple(r.e) == (at, old, new, *below)


# 10
def plain_katz(rows, held):
    """Scores by the definition, one token at a time."""
    toks = {i: [*(w.decode() for w in (t or "").encode().lower().split()), "\n"] for i, t in rows}
    uni, bi = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, ws in toks.items():
        if i not in held:
            for a, b in zip(["\r", *ws], ws):
                uni[b] += 1
                bi[a][b] += 1
    coc = lambda cs: [sum(1 for c in cs if c == r) for r in range(1, katz.K + 2)]
    d2, d1 = (np.append(katz.good_turing(coc(cs)), katz.KEEP) for cs in ([c for x in bi.values() for c in x.values()], list(uni.values())))
    n = sum(uni.values())
    kept = lambda c, d: c * d[min(c, katz.K + 1) - 1]
    p1 = {w: kept(c, d1) / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    out = {}
    for i, ws in toks.items():
        score = 0.0
        for a, b in zip(["\r", *ws], ws):
            h = bi.get(a)
            if not h:
                score += math.log10(p1.get(b, unknown))
            elif b in h:
                score += math.log10(kept(h[b], d2) / sum(h.values()))
            else:
                left = 1 - sum(kept(c, d2) for c in h.values()) / sum(h.values())
                score += math.log10(left / (1 - sum(p1[w] for w in h)) * p1.get(b, unknown))
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (len(uni) + 1))) for w in ws)
        out[i] = (len(ws), sum(w in uni for w in ws), n, base, score)
    return out


@pytest.mark.parametrize("parts", [3, 150])  # with many parts, frequent words are dealt to several
def test_katz_against_brute_force(spark, docs, parts):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    want = plain_katz(rows, held)
    got = katz.score(docs, remainder(F.col("doc_id"), 10) == 0, parts=parts, chunk=20000).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, r.doc_id in held)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - score) < 1e-6 * max(1, abs(score))


def test_katz_odd(odd, none):
    held = remainder(F.col("doc_id"), 10) == 0
    x = katz.score(odd, held).collect()
    assert len(x) == len(ODD) and {r.n_tokens for r in x if r.doc_id in (1, 2, 3)} == {1} and katz.score(none, held).count() == 0
    assert all(r.score == 0 for r in katz.score(odd, F.lit(True)).collect())


def plain_backoff(texts, held, order):
    """(score of each text, sum over all words and the unknown one after each history) by the definition."""
    toks = [[*(t or "").lower().split(), "\n"] for t in texts]
    pads = ["\r"] * (order - 1)
    grams = [[tuple(([*pads, *ws])[i : i + order]) for i in range(len(ws))] for ws in toks]
    counts = [collections.Counter(g[order - 1 - k :] for i, gs in enumerate(grams) if i not in held for g in gs) for k in range(order)]
    keep = []
    for x in counts:
        d = np.append(katz.good_turing([sum(1 for v in x.values() if v == r) for r in range(1, katz.K + 2)]), katz.KEEP)
        keep.append({g: v * d[min(v, katz.K + 1) - 1] for g, v in x.items()})
    n = sum(counts[0].values())
    unknown = 1 - sum(keep[0].values()) / n if n else 1.0
    after = [collections.defaultdict(list) for _ in range(order)]
    for k in range(1, order):
        for g in counts[k]:
            after[k][g[:-1]].append(g)
    weights = {}

    def p(g):
        k = len(g) - 1
        if not k:
            return keep[0][g] / n if g in keep[0] else unknown
        seen = after[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        total = sum(counts[k][x] for x in seen)
        if g in keep[k]:
            return keep[k][g] / total
        if g[:-1] not in weights:
            weights[g[:-1]] = (1 - sum(keep[k][x] for x in seen) / total) / max(1 - sum(p(x[1:]) for x in seen), 1e-12)
        return weights[g[:-1]] * p(g[1:])

    sums = [sum(p((*h, w)) for w in [*(g[0] for g in counts[0]), None]) for h in list(after[order - 1])[:40]]
    return [sum(math.log10(p(g)) for g in gs) for gs in grams], sums


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_against_brute_force(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("the of a cat Dog sat on mat é x y z".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "unseen words here", "the the the"]
    texts += texts[:3]
    held = {i for i in range(len(texts)) if i % 4 == 0}
    rows = [(None if i == 5 else i % 64, t, i in held) for i, t in enumerate(texts)]
    want, sums = plain_backoff(texts, held, order)
    got = backoff.score(spark.createDataFrame(rows, "Doc_Id long, text string, held boolean"), F.col("held"), order=order).collect()
    assert len(got) == len(rows) and (order == 1 or all(abs(x - 1) < 1e-9 for x in sums))
    key = lambda i, h, x: (-1 if i is None else i, h, round(x, 6))
    assert sorted(key(r.doc_id, r.held_out, r.score) for r in got) == sorted(key(i, h, x) for (i, _, h), x in zip(rows, want))


def test_backoff_equals_pairs(odd, none, docs):
    held = remainder(F.col("doc_id"), 10) == 0
    few = docs.filter("doc_id < 60")
    a, b = ({r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in f.collect()} for f in (backoff.score(few, held, order=2), katz.score(few, held, parts=3, chunk=20000)))
    assert a == b
    assert backoff.score(odd, held).count() == len(ODD) and backoff.score(none, held).count() == 0
    assert all(r.score == 0 for r in backoff.score(odd, F.lit(True)).collect())


def test_sketches_rule_out_no_alike_sets():
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 3, 40, 300, 1100, 20_000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[: round(n * share)], rng.integers(0, 2**63, n - round(n * share)).astype(np.uint64)])) for share in (1, 0.97, 0.93, 0.9, 0.89, 0.85, 0.8, 0.6)]
    i, j = (np.array(x) for x in zip(*itertools.combinations(range(len(sets)), 2)))
    size = np.array([len(x) for x in sets])
    may = simhash._may_be_alike(i, j, size, [simhash.sketch(x).tobytes() for x in sets], 0.8, at_once=4096)
    shares = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert may[shares >= 0.8].all() and not may[shares < 0.7].any() and may.sum() < 1.2 * (shares >= 0.8).sum()


def test_near_copies_just_too_different_make_few_rows(spark, monkeypatch):
    """Of a large group whose pairs all lie under the similarity, only those that might reach it become rows; a bridge between two groups is found."""
    rng = random.Random(3)
    base = [f"w{rng.random()}" for _ in range(400)]
    group = [" ".join(base[:360] + [f"n{rng.random()}" for _ in range(60)]) for _ in range(300)]
    other = [" ".join(base[:392] + [f"n{rng.random()}" for _ in range(8)]) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(group + other)), "doc_id long, text string")
    seen, given = [], simhash.left_out
    monkeypatch.setattr(simhash, "left_out", lambda *x: seen.append(given(*x)) or seen[-1])
    got = {r.doc_id: r.component_id for r in simhash.alike(rows).collect()}
    sets = [plain_shingles(t) for t in group + other]
    root = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root)) and len(set(root)) > 250
    assert seen[0].count() < 0.02 * math.comb(len(sets), 2)  # those at 0.78 are ruled out less surely than those at 0.75


def test_names_tell_all_words_apart():
    words = [np.zeros(5, np.uint64) for _ in range(4)]
    for k in range(4):
        words[k][k] = 1
    assert len(set(simhash._name(words).tolist())) == 5


def test_candidates_of_a_large_group_grow_with_it(spark):
    """Each pair is given once, a group of near copies gives a few pairs for each member, and what is given links whatever close pairs link, at each distance."""
    rng, given = np.random.default_rng(11), {}
    base = rng.integers(0, 2, 256).astype(bool)
    bits = np.array([base ^ (rng.random(256) < rng.choice([0.01, 0.04, 0.12])) for _ in range(1200)])
    bits = bits[np.sort(np.unique(bits, axis=0, return_index=True)[1])][:1000]
    assert len(bits) == 1000
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    name = simhash._name([np.ascontiguousarray(words[:, k]).view(np.uint64) for k in range(4)]).view(np.int64)
    entry = simhash._sampled([np.ascontiguousarray(words[:, k]) for k in range(4)])
    for n, block in ((250, simhash.BLOCK), (1000, simhash.BLOCK), (250, 32)):
        marks = spark.createDataFrame(words[:n].tolist(), "simhash0 long, simhash1 long, simhash2 long, simhash3 long").repartition(4)
        rows = simhash.candidates(marks, block).select("a", "b", "d").toPandas()
        given[n, block] = len(rows)
        assert not rows.duplicated(["a", "b"]).any() and (rows.a > rows.b).all()
        i, j = np.triu_indices(n, 1)
        d = np.concatenate([(bits[k] ^ bits[k + 1 : n]).sum(axis=1) for k in range(n - 1)])
        near = d <= simhash.SET_DISTANCE
        near[near] = (entry[i[near]] == entry[j[near]]).any(axis=1)
        close = {(max(a, b), min(a, b)): x for a, b, x in zip(name[i[near]], name[j[near]], d[near])}
        assert all(close[r.a, r.b] == r.d for r in rows.itertuples())
        for t in range(0, simhash.SET_DISTANCE + 1, 4):
            assert len(simhash._forest(name[i[near & (d <= t)]], name[j[near & (d <= t)]])[0]) == len(simhash._forest(rows.a[rows.d <= t].to_numpy(), rows.b[rows.d <= t].to_numpy())[0])
    print(given)
    assert given[1000, simhash.BLOCK] < 5 * given[250, simhash.BLOCK] < 5 * 12 * 250


def test_left_out_of_large_components(spark, monkeypatch):
    """Components of candidates in several blocks, compared whole or by segment, against all pairs."""
    rng = random.Random(8)
    base = [f"w{rng.random()}" for _ in range(300)]
    texts = [" ".join(base[:at] + [f"n{rng.random()}" for _ in range(300 - at)]) for at in [262] * 60 + [285] * 20 + [270] * 30]
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 1 < len(set(root)) < len(root)
    for whole in (simhash.WHOLE, 1):
        monkeypatch.setattr(simhash, "WHOLE", whole)
        assert {r.doc_id: r.component_id for r in simhash.alike(rows, block=16).collect()} == dict(enumerate(root))
