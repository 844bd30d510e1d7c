"""Byte-level BPE in padded matrices, and lossless decoding.

A text is cut into words by the vocabulary's pattern. The different words of a batch that are no
token themselves become rows of padded matrices, one for each class of lengths. In each round
every row merges its leftmost pair of least rank; ranks are looked up in a hash table of pairs.
The merged places are closed up, and rows without a pair to merge leave the matrix.
"""

from __future__ import annotations

import base64
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, with_arrow_columns

#: Cells of one matrix; a longer word has a matrix of its own.
CELLS = 1 << 20
#: Rows wider than this merge all places of their least pair at once, where that changes nothing.
WIDE = 64
_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def public_ranks() -> str:
    """Path of the public rank file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def public_pattern() -> str:
    """The pattern that cuts a text into words before the merges."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines `base64 rank`, read on the driver: as bounded as the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PairTable:
    """Ranks of pairs of token ids, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.shift = np.uint64(64 - max(4, (4 * len(pairs)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys, self.ranks = np.full(slots, -1, np.int64), np.full(slots, _NONE, np.int32)
        left = np.array([*pairs], np.int64).reshape(-1, 2)
        keys, ranks = left[:, 0] << 32 | left[:, 1], np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one slot, the last stays
            placed = self.keys[at] == keys
            self.ranks[at[placed]] = ranks[placed]
            keys, ranks, at = keys[~placed], ranks[~placed], (at[~placed] + 1) & (slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MULTIPLIER >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero(((met != keys) & (met >= 0)).ravel())
        keys, at, flat = keys.ravel()[open_], at.ravel()[open_], out.reshape(-1)
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            met = self.keys[at]
            found = met == keys
            flat[open_[found]] = self.ranks[at[found]]
            on = ~found & (met >= 0)
            open_, keys, at = open_[on], keys[on], at[on]
        return out


class ByteBpe:
    """Encodes words with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary has no token for some byte")
        self.ranks, self.pattern = ranks, pattern
        self.pad = max(ranks.values()) + 1
        if self.pad >= 1 << 30:
            raise ValueError("ranks of 2^30 and more")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        cuts = (((ranks.get(t[:i]), ranks.get(t[i:])), r) for t, r in ranks.items() for i in range(1, len(t)))
        pairs = {p: r for p, r in cuts if None not in p}
        self.pair_ranks = PairTable(pairs)
        tokens = [b""] * (self.pad + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.known = np.zeros(self.pad + 1, bool)
        self.known[list(ranks.values())] = True
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts, self.bytes = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(tokens), np.uint8)

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, count, ids) of rows in the order in which they are done; the words are of one class of lengths."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        wide = sizes.max() > WIDE
        cells = np.full((len(words), sizes.max()), self.pad, np.int32)
        cells[np.arange(cells.shape[1]) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        pairs, row, done = self.pair_ranks(cells[:, :-1], cells[:, 1:]), np.arange(len(words)), []
        while True:
            best = pairs.min(axis=1, initial=_NONE)
            going = best < _NONE
            if not going.all():
                ids = cells[~going]
                real = ids != self.pad
                done.append((row[~going], real.sum(axis=1), ids[real]))
                cells, pairs, row, best = cells[going], pairs[going], row[going], best[going]
            if not len(row):
                return tuple(np.concatenate(x) for x in zip(*done))
            cells, pairs = (self._all if wide else self._leftmost)(cells, pairs, best)

    def _leftmost(self, cells, pairs, best):
        """One round: each row merges the leftmost place of its best pair; all rows get shorter by one."""
        every, at = np.arange(len(cells)), pairs.argmin(axis=1)
        cells[every, at] = best
        stays = np.ones(cells.shape, bool)
        stays[every, at + 1] = False
        cells = cells[stays].reshape(len(cells), -1)
        stays[every, at + 1], stays[every, at] = True, False
        pairs = pairs[stays[:, :-1]].reshape(len(cells), -1)
        for rows, left in ((at < pairs.shape[1], at), (at > 0, at - 1)):
            r, x = every[rows], left[rows]
            pairs[r, x] = self.pair_ranks(cells[r, x], cells[r, x + 1])
        return cells, pairs

    def _all(self, cells, pairs, best):
        """One round of long rows: the places of the best pair from the left, as one by one they would be merged before any other pair."""
        hit, place = pairs == best[:, None], np.arange(pairs.shape[1])
        free = np.maximum.accumulate(np.where(hit, -1, place), axis=1)  # the last place that is none
        hit &= (place - free) % 2 == 1  # of places that overlap, every other one
        rows, at = np.nonzero(hit)
        merged, edge = best[rows], np.full((len(cells), 1), self.pad, np.int32)
        padded = np.concatenate([edge, cells, edge], axis=1)
        follows = np.concatenate([[False], (rows[1:] == rows[:-1]) & (at[1:] == at[:-1] + 2)])
        before, after = np.where(follows, merged, padded[rows, at]), padded[rows, at + 3]
        # where a merge makes a pair of lesser rank, that one is next, and the places behind it wait
        lower = np.minimum(self.pair_ranks(before, merged), self.pair_ranks(merged, after)) < merged
        last = np.full(len(cells), pairs.shape[1])
        np.minimum.at(last, rows[lower], at[lower])
        now = at <= last[rows]
        hit[rows[~now], at[~now]] = False
        rows, at = rows[now], at[now]
        cells[rows, at] = best[rows]
        stays = np.ones(cells.shape, bool)
        stays[rows, at + 1] = False
        to = np.cumsum(stays, axis=1) - 1
        width = int(((cells != self.pad) & stays).sum(axis=1).max())
        closed = np.full(cells.shape, self.pad, np.int32)
        r, x = np.nonzero(stays)
        closed[r, to[r, x]] = cells[r, x]
        ranks = np.full(pairs.shape, _NONE, np.int32)
        kept = ~hit
        r, x = np.nonzero(kept)
        ranks[r, np.minimum(to[r, x + 1] - 1, pairs.shape[1] - 1)] = pairs[r, x]
        at = to[rows, at]
        cells, ranks = closed[:, :width], ranks[:, : max(width - 1, 0)]
        for some, left in ((at < ranks.shape[1], at), (at > 0, at - 1)):
            r, x = rows[some], left[some]
            ranks[r, x] = self.pair_ranks(cells[r, x], cells[r, x + 1])
        return cells, ranks

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(count of ids of each word, ids of all): a word that is a token is that token."""
        whole = [self.ranks.get(w) for w in words]
        rest = sorted((i for i, r in enumerate(whole) if r is None), key=lambda i: len(words[i]))
        parts = [(np.array([i for i, r in enumerate(whole) if r is not None], np.int64), None, np.array([r for r in whole if r is not None], np.int32))]
        at = 0
        while at < len(rest):
            longest = 1 << (len(words[rest[at]]) - 1).bit_length()
            end = at + 1
            while end < len(rest) and len(words[rest[end]]) <= longest and (end - at + 1) * longest <= CELLS:
                end += 1
            rows, counts, ids = self._merged([words[i] for i in rest[at:end]])
            parts.append((np.array(rest[at:end], np.int64)[rows], counts, ids))
            at = end
        place = np.concatenate([p for p, _, _ in parts])
        counts = np.concatenate([np.ones(len(p), np.int64) if n is None else n for p, n, _ in parts])
        order = np.argsort(place)
        return counts[order], np.concatenate([x for _, _, x in parts])[spread((np.cumsum(counts) - counts)[order], counts[order])]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(count of ids of each text, ids of all)."""
        code: dict = defaultdict()
        code.default_factory = code.__len__
        find, found, many = regex.compile(self.pattern).findall, [], []
        for t in texts:
            words = find(t)
            found.extend(map(code.__getitem__, words))
            many.append(len(words))
        counts, ids = self.words([w.encode() for w in code])
        found = np.array(found, np.int64)
        sizes = counts[found]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(np.array(many, np.int64))])]
        return np.diff(ends), ids[spread((np.cumsum(counts) - counts)[found], sizes)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id that is no token is an error."""
        if len(ids) and (ids.max() >= self.pad or not self.known[ids].all()):
            raise ValueError("an id is no token")
        return self.bytes[spread(self.starts[ids], self.lengths[ids])].tobytes()


def encode(docs: DataFrame, bpe: ByteBpe, text: str = "text") -> DataFrame:
    """docs with n_tokens and ids: the tokens of each whole text as unsigned 32-bit integers, lowest byte first.

    No special tokens are made; their names are ordinary text. A null text is encoded as an empty
    one, which has no ids. Bytes that are no UTF-8 count as U+FFFD. Columns of these names are
    replaced, others stay. Memory grows with a batch and with the longest word of the pattern, by
    about 60 bytes for each of its bytes.
    """

    def run(given):
        counts, ids = bpe.texts([(t or b"").decode("utf-8", "replace") for t in given.cast(pa.binary()).to_pylist()])
        ends = np.concatenate([[0], np.cumsum(counts)]) * 4
        packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
        return [pa.array(counts, pa.int64()), packed]

    return with_arrow_columns(docs, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], run, [text], 1 << 22)


def decode(docs: DataFrame, bpe: ByteBpe, ids: str = "ids") -> DataFrame:
    """docs with decoded: the bytes of the ids, null for null; an id that is no token ends the job."""

    def run(given):
        return [pa.array([None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in given.to_pylist()], pa.binary())]

    return with_arrow_columns(docs, [T.StructField("decoded", T.BinaryType())], run, [ids])


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to."""
    small_batches(spark)
    bpe = ByteBpe(ranks_of(public_ranks()), public_pattern())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decode(encode(docs, bpe).select("doc_id", "n_tokens", "ids"), bpe)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
