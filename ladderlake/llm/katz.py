"""Scores by a Katz backoff model of word pairs, over tables that are partitioned by word.

Good-Turing counts discount the pairs and the words that training saw up to K times; what a
history's pairs leave goes to the words that never followed it, in proportion to their own
probability, by a weight that makes the whole exactly 1. All words that training never saw are one
event.

The texts are read twice in chunks, the documents that one task reads together. First each chunk
sends its different pairs to the partition of their second word, packed as arrays, and the
partitions add them up. The sums go back to the chunk, those that each history needs go to the
partition of the history, which works out backoff weights and answers what the chunk's unseen pairs
ask. In the second reading each chunk packs which document holds which pair, and meets its answers.

Words are counted first, in a table of their own. There are as many partitions as keep each at about
PART tokens, and the pairs of a frequent second word are dealt to all of them by their history, so what meets in
a task does not grow with the input. backoff.score does the same for histories of any length, a row for each n-gram.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import c, remainder, small_batches, stored

#: Counts up to K are discounted by Good-Turing; greater ones keep KEEP of their share, so that every history leaves some mass.
K, KEEP = 5, 0.999
#: Tokens of a chunk: what one task holds at once.
CHUNK = 1_500_000
#: Tokens whose pairs meet in one partition, about; a word that occurs more than a HOT-th as often is dealt to several, of about so many each.
PART, HOT = 2_500_000, 4
#: No word holds white space, so these stand for the end of a text and, as a history, for its start.
END, START = b"\n", b"\r"
_ROW = "kind int, part int, chunk long, sub int, blob binary, stats array<long>"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers or doubles in as few bytes each as their largest needs, compressed."""
    out = []
    for a in arrays:
        if a.dtype.kind == "f":
            out.append(struct.pack("<cBq", b"f", 8, len(a)) + a.astype("<f8").tobytes())
        else:
            size = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
            out.append(struct.pack("<cBq", b"u", size, len(a)) + np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        kind, size, n = struct.unpack_from("<cBq", data, at)
        at += struct.calcsize("<cBq")
        raw = np.frombuffer(data, np.uint8, n * size, at)
        at += n * size
        if kind == b"f":
            out.append(raw.view("<f8"))
        else:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :size] = raw.reshape(size, n).T
            out.append(wide.reshape(-1).view("<u8"))
    return out


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows (kind, part, chunk, sub, blob, stats) as a table."""
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    columns = list(zip(*rows)) or [()] * 6
    return pa.table([pa.array(x, t) for x, t in zip(columns, types)], names=["kind", "part", "chunk", "sub", "blob", "stats"])


def _salted(word: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The hash of a word's share."""
    x = (word ^ (salt.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Chunk:
    """The tokens of some documents, sorted by the partition and hash of the token, then its history, then document."""

    def __init__(self, ids: list, held_out: list, texts: list, parts: int, hot: tuple[np.ndarray, np.ndarray]):
        index: dict[bytes, int] = {END: 0, START: 1}
        flat, lengths = [], []
        known = index.get
        for t in texts:
            words = (t or "").encode().lower().split()
            own = list(map(known, words))
            if None in own:
                own = [index.setdefault(w, len(index)) for w in words]
            flat.append(np.array(own + [0], np.int32))
            lengths.append(len(own) + 1)
        word, lengths = np.concatenate(flat), np.array(lengths)
        del flat
        starts = np.cumsum(lengths) - lengths
        history = np.roll(word, 1)
        history[starts] = 1
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
        # a frequent word counts as several, told apart by what stands before it
        often = np.flatnonzero(np.isin(hashes, hot[0]))
        split = np.flatnonzero(np.isin(word, often)) if len(often) else often
        end_ids = [0]
        if len(split):
            most = int(hot[1].max())
            shares = np.ones(len(index), np.int64)
            shares[often] = hot[1][np.searchsorted(hot[0], hashes[often])]
            salt = (hashes[history[split]] >> np.uint64(20)).astype(np.int64) % shares[word[split]]
            salted, at = np.unique(word[split].astype(np.int64) * most + salt, return_inverse=True)
            end_ids += (len(index) + np.flatnonzero(salted // most == 0)).tolist()
            word = word.astype(np.int64)
            word[split] = len(index) + at
            hashes = np.concatenate([hashes, _salted(hashes[salted // most], salted % most)])
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((hashes, part))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ids, self.held_out, self.lengths = ids, np.array(held_out, bool), lengths
        key = rank[word].astype(np.int64) * len(order) + rank[history]
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        at = np.argsort(key, kind="stable")
        key, self.doc = key[at], doc[at]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.runs = np.diff(np.append(first, len(key)))
        train = np.add.reduceat((~self.held_out)[self.doc].astype(np.int64), first)
        self.train, pair_word = train, key[first] // len(order)
        self.pair_history = hashes[order][key[first] % len(order)] & np.uint64((1 << 48) - 1)
        used = np.unique(pair_word)
        self.words, self.part = hashes[order][used], part[order][used]
        self.pairs = np.diff(np.append(np.searchsorted(pair_word, used), len(pair_word)))
        self.end = np.flatnonzero(np.isin(used, rank[end_ids]))


def _chunks(docs: DataFrame, parts: int, hot: tuple[np.ndarray, np.ndarray], limit: int, emit, schema: str) -> DataFrame:
    """emit(chunk number, _Chunk) for runs of documents of about limit tokens within each task."""

    def run(batches):
        number, held, size = 0, [], 0

        def out():
            nonlocal number, held, size
            rows, held, size = held, [], 0
            number += 1
            return emit(number, _Chunk(*zip(*rows), parts, hot))

        for batch in batches:
            number = number or batch.column(3)[0].as_py() << 24 if len(batch) else number
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append(row)
                size += len(row[2] or "") // 6 + 1
                if size > limit:
                    yield from out().to_batches()
        if held:
            yield from out().to_batches()

    return docs.mapInArrow(run, schema)


def _send_pairs(parts: int):
    def emit(number: int, x: _Chunk) -> pa.Table:
        ends = np.cumsum(x.pairs)
        rows, cuts = [], np.searchsorted(x.part, np.arange(parts + 1))
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a < b:
                i, j = ends[a] - x.pairs[a], ends[b - 1]
                rows.append((0, p, number, 0, _pack(x.words[a:b], x.pairs[a:b], x.pair_history[i:j], x.train[i:j]), None))
        return _rows(rows)

    return emit


def _send_docs(parts: int):
    def emit(number: int, x: _Chunk) -> pa.Table:
        ids = np.array([i or 0 for i in x.ids], np.int64).view(np.uint64)
        missing = np.array([i is None for i in x.ids], np.int64)
        words = np.bincount(x.part, minlength=parts)
        return _rows([(1, 0, number, 0, _pack(ids, missing, x.held_out.astype(np.int64), x.lengths, words, x.pairs, x.runs, x.doc.astype(np.int64), x.end), None)])

    return emit


def _classes(counts: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """How many of each group have the count 1 to K, and the sum of the counts beyond: n rows."""
    small = counts <= K
    out = np.zeros((n, K + 1), np.int64)
    np.add.at(out, (groups[small], counts[small] - 1), 1)
    out[:, K] = np.bincount(groups[~small], weights=counts[~small], minlength=n).astype(np.int64)
    return out


def _by_part(names: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of histories in the order of their partitions, and where each partition begins."""
    part = (names % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _add_up(parts: int, hot: np.ndarray, totals: np.ndarray):
    """Of one partition's pairs; hot and totals are the shares of frequent words and the words' counts: answers to the chunks, sums by history, questions by history, and counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        blobs = [_unpack(x) for x in table.column("blob").to_pylist()]
        words, pairs, history, train = (np.concatenate([b[i] for b in blobs]) for i in range(4))
        train = train.astype(np.int64)
        distinct, of_word = np.unique(words, return_inverse=True)
        pair_word = np.repeat(of_word, pairs.astype(np.int64))
        mixed = (distinct[pair_word] ^ (history * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        _, one, of_pair = np.unique(mixed ^ (mixed >> np.uint64(31)), return_index=True, return_inverse=True)
        del mixed
        pair_count = np.bincount(of_pair, weights=train, minlength=len(one)).astype(np.int64)
        word_count = np.bincount(pair_word, weights=train, minlength=len(distinct)).astype(np.int64)
        shared = np.isin(distinct, hot)
        word_count[shared] = totals[np.searchsorted(hot, distinct[shared])]
        rows, w, p, mine = [], 0, 0, int(table.column("part")[0].as_py())
        which, names, places = [], [], []
        for i, (number, b) in enumerate(zip(chunks, blobs)):
            own = pair_count[of_pair[p : p + len(b[2])]]
            rows.append((2, 0, number, mine, _pack(word_count[of_word[w : w + len(b[0])]], own), None))
            unseen = np.flatnonzero(own == 0)
            which.append(np.full(len(unseen), i))
            names.append(b[2][unseen])
            places.append(unseen)
            w, p = w + len(b[0]), p + len(b[2])
        asking, asked, place = (np.concatenate(x) for x in (which, names, places))
        seen = pair_count > 0
        names, of_history = np.unique(history[one[seen]], return_inverse=True)
        follow = word_count[pair_word[one[seen]]]
        sums = np.concatenate([_classes(pair_count[seen], of_history, len(names)), _classes(follow, of_history, len(names))], axis=1)
        # one row for each partition of histories: its sums, and what all chunks ask of it
        told, told_cuts = _by_part(names, parts)
        ask, ask_cuts = _by_part(asked, parts)
        numbers = np.array(chunks, np.int64).view(np.uint64)
        for q in range(parts):
            i, j = told[told_cuts[q] : told_cuts[q + 1]], ask[ask_cuts[q] : ask_cuts[q + 1]]
            if len(i) or len(j):
                rows.append((3, q, 0, mine, _pack(names[i], *sums[i].T, numbers, asking[j], asked[j], place[j]), None))
        coc = lambda x: np.bincount(np.minimum(x, K + 2), minlength=K + 3)[1 : K + 2].tolist()
        rows.append((5, 0, 0, 0, None, coc(pair_count)))
        return _rows(rows)

    return run


def good_turing(counts: list[int]) -> np.ndarray:
    """Discounts of the counts 1 to K from how many things were seen 1 to K + 1 times; where these are too few or uneven, (r - 0.5) / r."""
    n = np.array(counts, float)
    r = np.arange(1, K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        top = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:K]) - top) / (1 - top)
    return np.where(np.isfinite(d) & (d > 0) & (d < 1), d, (r - 0.5) / r)


class _Model:
    """What the counts of counts settle."""

    def __init__(self, stats: list[int]):
        self.pair, self.word = good_turing(stats[: K + 1]), good_turing(stats[K + 1 : 2 * K + 2])
        self.tokens, self.types = stats[-2:]
        r = np.arange(1, K + 1)
        low = (r * np.array(stats[K + 1 : 2 * K + 1])).sum()
        seen = (self.word * r * np.array(stats[K + 1 : 2 * K + 1])).sum() + KEEP * (self.tokens - low)
        #: of the one event of all words that training did not see
        self.unknown = 1 - seen / self.tokens if self.tokens else 1.0

    @staticmethod
    def kept(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * np.append(np.append(0.0, discounts), KEEP)[np.minimum(counts, K + 1)]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.kept(counts, self.word) / max(self.tokens, 1), self.unknown)

    def backoff(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, weight) of histories from their sums by class of pair counts and of following words' counts."""
        r = np.arange(1, K + 1)
        count = sums[:, :K] @ r + sums[:, K]
        pairs = (sums[:, :K] @ (r * self.pair) + KEEP * sums[:, K]) / np.maximum(count, 1)
        words = (sums[:, K + 1 : 2 * K + 1] @ (r * self.word) + KEEP * sums[:, 2 * K + 1]) / max(self.tokens, 1)
        return count, (1 - pairs) / np.maximum(1 - words, 1e-12)


def _answer(model: _Model):
    """Of one partition's histories, a row for each chunk: log10 of weight times count for what its unseen pairs ask; 0 of a history that training did not see."""

    def run(table: pa.Table) -> pa.Table:
        rows = [(x["sub"], _unpack(x["blob"])) for x in table.to_pylist()]
        names, at = np.unique(np.concatenate([b[0] for _, b in rows]), return_inverse=True)
        fields = [np.bincount(at, weights=np.concatenate([b[i] for _, b in rows]).astype(float), minlength=len(names)) for i in range(1, 2 * K + 3)]
        count, weight = model.backoff(np.stack(fields, axis=1))
        value = np.log10(np.maximum(weight * count, 1e-300))
        chunk, sub, asked, place = (np.concatenate(x) for x in zip(*((b[-4][b[-3].astype(np.int64)], np.full(len(b[-3]), p, np.uint64), b[-2], b[-1]) for p, b in rows)))
        got = np.zeros(len(asked))
        if len(names):
            i = np.minimum(np.searchsorted(names, asked), len(names) - 1)
            got = np.where(names[i] == asked, value[i], 0.0)
        order = np.argsort(chunk, kind="stable")
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1) if len(order) else []:
            out.append((6, 0, int(chunk[at[0]].astype(np.int64)), 0, _pack(sub[at], place[at], got[at]), None))
        return _rows(out)

    return run


_SCORES = "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _sum_up(model: _Model):
    """Of one chunk: its documents' sums."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids, missing, held_out, lengths, words, pairs, runs, doc, end = _unpack(next(x["blob"] for x in rows if x["kind"] == 1))
        counts = {x["sub"]: _unpack(x["blob"]) for x in rows if x["kind"] == 2}
        order = np.flatnonzero(words)
        of_word = np.concatenate([counts[p][0] for p in order]).astype(np.int64)
        of_pair = np.concatenate([counts[p][1] for p in order]).astype(np.int64)
        if len(of_word) != len(pairs) or len(of_pair) != len(runs):
            raise RuntimeError("the documents were read in other chunks the second time; store them first")
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum([0, *(len(counts[p][1]) for p in order)])[:-1]
        answers = np.zeros(len(of_pair))
        for x in rows:
            if x["kind"] == 6:
                sub, place, got = _unpack(x["blob"])
                answers[begin[sub.astype(np.int64)] + place.astype(np.int64)] = got
        is_end = np.zeros(len(of_word), bool)
        is_end[end.astype(np.int64)] = True
        base = np.log10((of_word + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
        # every word but the end is the history of the next token
        as_history = np.where(is_end, 0.0, np.log10(np.maximum(of_word, 1)))
        back = np.log10(model.unigram(of_word)) - as_history
        spread = lambda x: np.repeat(x, pairs.astype(np.int64))
        seen = np.log10(np.maximum(model.kept(of_pair, model.pair), 1e-300)) - spread(as_history)
        score = np.where(of_pair > 0, seen, answers + spread(back))
        doc, runs, n = doc.astype(np.int64), runs.astype(np.int64), len(ids)
        total = lambda x: np.bincount(doc, weights=np.repeat(x, runs), minlength=n)
        start = np.log10(max(int(of_word[int(end[0])]), 1))
        return pa.table([pa.array(ids.view(np.int64), mask=missing > 0), pa.array(held_out > 0), pa.array(lengths.astype(np.int64)), pa.array(total(spread((of_word > 0).astype(float))).round().astype(np.int64)), pa.array(total(spread(base))), pa.array(total(score) - start)], names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, all_n): by the hash of a word, how often it and the end of a text occur in the rows (held_out, text) to learn from, and in all."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                held, texts = (batch.column(i).slice(at, 1024).to_pylist() for i in (0, 1))
                index: dict[bytes, int] = {END: 0}
                flat = []
                for t in texts:
                    flat.append(np.array([*(index.setdefault(w, len(index)) for w in (t or "").encode().lower().split()), 0], np.int64))
                lengths = [len(x) for x in flat]
                word, learnt = np.concatenate(flat), np.repeat(~np.array(held, bool), lengths)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
                n = [np.bincount(word, weights=x, minlength=len(index)).astype(np.int64) for x in (learnt, np.ones(len(word)))]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *map(pa.array, n)], names=["word", "n", "all_n"])

    found = docs.select("held_out", "text").mapInArrow(run, "word long, n long, all_n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("all_n").alias("all_n"))


def score(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text", parts: int | None = None, chunk: int = CHUNK, part_tokens: int = PART) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    held_out is a boolean column; the model learns from the other rows. base_score is that of the
    words alone with 0.1 added to each count, score the model's log10 probability. A null text is
    empty and has one token, its end; repeated rows count and are scored each; without training
    rows all is one unknown event of probability 1. docs must give the same rows in the same tasks
    when read again, as a table does. parts grows with the input: by default the session's
    shuffle partitions, or more so that none gets more than about part_tokens tokens; the driver
    gets the words that fill a fourth of a partition or more, at most four for each. A history is
    known by 48 bits of its hash, a word by 64.
    """
    spark = docs.sparkSession
    rows = docs.select(c(key).cast("long").alias("key"), held_out.alias("held_out"), c(text).alias("text"), (F.spark_partition_id() + 1).cast("long").alias("task"))
    words = stored(word_counts(rows))
    tokens = words.agg(F.sum("all_n")).first()[0] or 0
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // part_tokens))
    share = max(tokens // (HOT * parts), 100)
    frequent = sorted((r.word & 2**64 - 1, r.n, r.all_n // share + 1) for r in words.filter((F.col("all_n") > share) & (F.col("n") > K + 1)).collect())
    names, n, sizes = (np.array(x, kind) for x, kind in zip(list(zip(*frequent)) or [()] * 3, (np.uint64, np.int64, np.int64)))
    shares = _salted(np.repeat(names, sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    order = np.argsort(shares)
    shares, totals = shares[order], np.repeat(n, sizes)[order]
    few = {r.n: r["count"] for r in words.filter(F.col("n") <= K + 1).groupBy("n").count().collect()}
    learnt = words.filter("n > 0").agg(F.sum("n"), F.count("*")).first()
    of_words = [*(few.get(r, 0) for r in range(1, K + 2)), learnt[0] or 0, learnt[1]]
    pairs = _chunks(rows, parts, (names, sizes), chunk, _send_pairs(parts), _ROW)
    summed = stored(pairs.groupBy("part").applyInArrow(_add_up(parts, shares, totals), _ROW))
    stats = summed.filter("kind = 5").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col")).orderBy("pos").collect()
    model = _Model([int(x[1]) for x in stats] + of_words if stats else [0] * (2 * K + 4))
    answers = summed.filter("kind = 3").groupBy("part").applyInArrow(_answer(model), _ROW)
    mine = _chunks(rows, parts, (names, sizes), chunk, _send_docs(parts), _ROW)
    met = summed.filter("kind = 2").unionByName(answers).unionByName(mine)
    scored = met.groupBy("chunk").applyInArrow(_sum_up(model), _SCORES)
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_katz(spark, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from nine tenths of them."""
    small_batches(spark)
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder(F.col("doc_id"), 10) == 0)
