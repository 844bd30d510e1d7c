"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text's bytes, with a space put in front, are the nodes of a lattice whose edges are the pieces
of a public vocabulary; a character that is no piece goes byte by byte. Forward sums give each
node the mass of all ways to reach it; backward, an edge is drawn at each node in proportion to
the mass that comes through it. The draws depend on the row's key and text alone. Pieces hold
spaces at their front only, so the lattice falls apart into words, and equal words of a batch
share their sums. A very long word is cut into blocks whose sums are worked out side by side.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, with_arrow_columns

#: Bytes of text that are segmented at once; a batch is worked off in runs of about four times as many.
AT_ONCE = 1 << 20
#: Words of more bytes than LONG go block by block, in stretches of so many bytes.
LONG, STRETCH = 1024, 1 << 16
_SPACE = "▁"


def public_model() -> str:
    """Path of the public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(model_file: str | None = None, power: float = 1.0) -> dict:
    """Pieces as bytes with their log weights, read on the driver: as bounded as the vocabulary.

    The vocabulary's scores are ranks; a piece of rank r weighs (1 + r) ** -power, over the sum of all.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file or public_model())
    pieces, ranks, single = {}, {}, [-1] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            single[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i).replace(_SPACE, " ").encode()
            pieces[piece], ranks[piece] = i, -sp.get_score(i)
    if -1 in single:
        raise ValueError("the vocabulary has no piece for some byte")
    if any(b" " in p.lstrip(b" ") for p in pieces):
        raise ValueError("pieces with spaces inside")
    total = sum((1 + r) ** -power for r in ranks.values())
    low = -power * np.log1p(max(ranks.values())) - np.log(total)
    return {"ids": pieces, "logs": {p: -power * np.log1p(r) - np.log(total) for p, r in ranks.items()}, "bytes": single, "byte_log": float(low), "lines": not any(b"\n" in p for p in pieces)}


def _draws(seed, step) -> np.ndarray:
    """32 random bits of each seed at a step."""
    with np.errstate(over="ignore"):
        z = seed + step * np.uint64(0xD1342543DE82EF95)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


class Lattice:
    """Draws segmentations with one vocabulary."""

    def __init__(self, vocab: dict):
        self.vocab = vocab
        pieces = list(vocab["ids"])
        self.longest = max(map(len, pieces))
        #: For each length: sorted hashes of the pieces and of the beginnings of longer ones.
        self.tables = {}
        ahead = {p[:n] for p in pieces for n in range(1, len(p))}
        for n in range(1, self.longest + 1):
            own = {p: (vocab["ids"][p], vocab["logs"][p]) for p in pieces if len(p) == n}
            rows = sorted((self._hash(p), *own.get(p, (-1, 0.0))) for p in {*own, *(p for p in ahead if len(p) == n)})
            self.tables[n] = np.array([x for x, _, _ in rows], np.uint64), np.array([i for _, i, _ in rows], np.int64), np.array([w for _, _, w in rows])
            if len(set(self.tables[n][0].tolist())) != len(rows):
                raise ValueError("two pieces share a hash")
        #: Words, with the spaces before them; no piece spans two.
        self.words = re.compile(rb" *[^ \n]+|\n| +" if vocab["lines"] else rb" *[^ ]+| +")
        self.text_of = dict(zip(vocab["ids"].values(), vocab["ids"]))
        self.text_of.update({i: bytes([b]) for b, i in enumerate(vocab["bytes"])})

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for x in piece:
            h = (h * 0x100000001B3 + x + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, words: list[bytes]) -> tuple:
        """Of the lattices of words, put one after the other: node of each word's start, and by end node sorted edges (end, start, id, log)."""
        lengths = np.array([len(w) for w in words])
        first = np.concatenate([[0], np.cumsum(lengths + 1)])  # a word of n bytes has n + 1 nodes
        text = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        stop = np.repeat(first[1:] - 1, lengths + 1)  # the last node of each node's word
        starts = np.flatnonzero((text & 0xC0) != 0x80)  # nodes at the start of a character
        starts = starts[starts < stop[starts]]
        found, h, at, n = [], np.zeros(len(starts), np.uint64), starts, 0
        covered = np.zeros(len(text), bool)
        size = np.where(text < 0x80, 1, np.where(text >= 0xF0, 4, np.where(text >= 0xE0, 3, 2)))
        while len(at) and n < self.longest:
            h = h * np.uint64(0x100000001B3) + (text[at + n].astype(np.uint64) + np.uint64(1))
            n += 1
            keys, ids, logs = self.tables[n]
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[i] == h
            at, h, i = at[hit], h[hit], i[hit]
            whole = ids[i] >= 0
            found.append((at[whole] + n, at[whole], ids[i[whole]], logs[i[whole]]))
            covered[at[whole][size[at[whole]] == n]] = True
            on = at + n < stop[at]
            at, h = at[on], h[on]
        # characters that are no piece: an edge for each byte
        bare = starts[~covered[starts]]
        for k in range(4):
            b = bare[size[bare] > k] + k
            found.append((b + 1, b, np.array(self.vocab["bytes"])[text[b]], np.full(len(b), self.vocab["byte_log"])))
        end, start, ids, logs = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(end, kind="stable")
        return first, end[order], start[order], ids[order], logs[order]

    @staticmethod
    def _long_mass(n: int, end: np.ndarray, start: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Log mass of each of the n + 1 nodes of one long word.

        A stretch is cut into blocks. What a block makes of each of the last nodes before it is a
        small matrix; the matrices of all blocks are worked out at once, then applied one after
        another, and then all blocks are filled in at once: as many steps as the root of the
        stretch's length, thrice. Masses are scaled by exp(g) a byte so that they stay in range.
        """
        width = int((end - start).max())
        g = -float(np.median(logs / (end - start))) / 2
        mass = np.full(n + 1, -np.inf)
        mass[0] = 0.0
        cuts = np.searchsorted(end, np.arange(0, n + STRETCH, STRETCH), side="right")
        for a, (low, high) in zip(range(0, n, STRETCH), zip(cuts, cuts[1:])):
            size = min(STRETCH, n - a)
            long = max(width, int(np.sqrt(size)))
            blocks = -(-size // long)
            weight = np.zeros((blocks * long, width))
            length = end[low:high] - start[low:high]
            weight[end[low:high] - a - 1, width - length] = np.exp(logs[low:high] + g * length)
            weight = weight.reshape(blocks, long, width)

            def fill(x):
                """x (block, node, ...) filled on from its first width nodes; the log scale of each node."""
                scale = np.zeros((blocks, long + 1))
                for t in range(long):
                    x[:, width + t] = (weight[:, t, None, :] @ x[:, t : t + width].reshape(blocks, width, -1)).reshape(x[:, 0].shape)
                    scale[:, t + 1] = scale[:, t]
                    if t % 8 == 7 or t == long - 1:
                        top = x[:, t + 1 : t + 1 + width].reshape(blocks, -1).max(1)
                        top = np.where(top > 0, top, 1.0)
                        x[:, t + 1 : t + 1 + width] /= top.reshape(-1, *[1] * (x.ndim - 1))
                        scale[:, t + 1] += np.log(top)
                return scale

            x = np.zeros((blocks, width + long, width))
            x[:, np.arange(width), np.arange(width)] = 1.0
            scale = fill(x)
            before = np.full(width, -np.inf)
            own = mass[max(0, a - width + 1) : a + 1]
            before[width - len(own) :] = own
            tops = np.zeros(blocks)
            first = np.zeros((blocks, width))
            total, v = before.max(), np.exp(before - before.max())
            for b in range(blocks):
                first[b], tops[b] = v, total
                v = x[b, long:] @ v
                top = v.max()
                if top > 0:
                    v, total = v / top, total + np.log(top) + scale[b, long]
            held = np.zeros((blocks, width + long))
            held[:, :width] = first
            # node by node, as the scale of a node is that of the time it is made
            scale = np.zeros(blocks)
            found = np.full((blocks, long), -np.inf)
            for t in range(long):
                made = (weight[:, t] * held[:, t : t + width]).sum(1)
                with np.errstate(divide="ignore"):
                    found[:, t] = np.log(made) + scale + tops
                held[:, width + t] = made
                if t % 8 == 7:
                    top = held[:, t + 1 : t + 1 + width].max(1)
                    top = np.where(top > 0, top, 1.0)
                    held[:, t + 1 : t + 1 + width] /= top[:, None]
                    scale += np.log(top)
            mass[a + 1 : a + 1 + size] = found.reshape(-1)[:size]
        return mass - g * np.arange(n + 1)

    def filtered(self, words: list[bytes]) -> tuple:
        """first, the first edge of each end node, and of the edges: start, id, and the share of the end node's mass up to and with the edge."""
        first, end, start, ids, logs = self.edges(words)
        node = np.repeat(first[:-1], np.diff(first))
        mass = np.full(first[-1], -np.inf)
        mass[first[:-1]] = 0
        share = np.empty(len(end))
        lengths = np.diff(first) - 1
        for w in np.flatnonzero(lengths > LONG):
            a, b = np.searchsorted(end, [first[w], first[w + 1]])
            e = slice(a, b)
            own = self._long_mass(int(lengths[w]), end[e] - first[w], start[e] - first[w], logs[e])
            mass[first[w] : first[w + 1]] = own
            share[e] = np.exp(own[start[e] - first[w]] + logs[e] - own[end[e] - first[w]])
        # of the other words, all edges whose end has one and the same distance from its word's start go together
        depth = (end - node[end]).astype(np.int64)
        depth[np.repeat(lengths, lengths + 1)[end] > LONG] = 0
        order = np.argsort(depth, kind="stable")
        order = order[depth[order] > 0]
        cuts = np.flatnonzero(np.diff(depth[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            e = order[a:b]
            x = mass[start[e]] + logs[e]
            head = np.flatnonzero(np.diff(end[e], prepend=-1))
            runs = np.diff(np.append(head, len(e)))
            top = np.maximum.reduceat(x, head)
            top = np.where(np.isfinite(top), top, 0)
            part = np.exp(x - np.repeat(top, runs))
            total = np.add.reduceat(part, head)
            with np.errstate(divide="ignore"):
                mass[end[e[head]]] = top + np.log(total)
            share[e] = part / np.repeat(np.maximum(total, 1e-300), runs)
        # thresholds of 32 bits within each node, summed edge by edge so that they depend on the word
        # alone; likely edges come first, so that a search from the first is short
        order = np.argsort((end << 20) | ((1 - share) * ((1 << 20) - 1)).astype(np.int64), kind="stable")
        end, start, ids, up_to = end[order], start[order], ids[order], share[order]
        head = np.flatnonzero(np.diff(end, prepend=-1))
        runs = np.diff(np.append(head, len(end)))
        rank = np.arange(len(end)) - np.repeat(head, runs)
        for k in range(1, int(runs.max())):
            e = np.flatnonzero(rank == k)
            up_to[e] += up_to[e - 1]
        bound = np.minimum(up_to * 2.0**32, 2.0**32 - 1).astype(np.uint32)
        bound[np.append(head[1:], len(end)) - 1] = 2**32 - 1
        at = np.zeros(first[-1], np.int32)
        at[end[head]] = head
        return first, at, start.astype(np.int32), ids.astype(np.int32), bound

    def sample(self, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
        """Piece ids of each text, drawn with its seed."""
        index: dict[bytes, int] = {}
        flat, counts = [], []
        known = index.get
        for t in texts:
            found = self.words.findall(b" " + t.encode()) if t else []
            own = list(map(known, found))
            if None in own:
                own = [index.setdefault(w, len(index)) for w in found]
            flat += own
            counts.append(len(found))
        if not flat:
            return [np.zeros(0, np.int32) for _ in texts]
        first, edge_of, start, ids, bound = self.filtered(list(index))
        word = np.array(flat)
        counts = np.array(counts)
        seed = np.repeat(np.array(seeds, np.uint64), counts)
        place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed += place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        base, node = first[word].astype(np.int32), (first[word + 1] - 1).astype(np.int32)
        far = node - base > LONG
        drawn_long = {w: self._walk(int(seed[w]), int(base[w]), int(node[w]), edge_of, start, ids, bound) for w in np.flatnonzero(far)}
        alive, steps = np.flatnonzero(~far), []
        seed, base, node = seed[alive], base[alive], node[alive]
        while len(alive):
            u = _draws(seed, np.uint64(len(steps)))
            e = edge_of[node]
            late = np.flatnonzero(bound[e] < u)
            while len(late):
                e[late] += 1
                late = late[bound[e[late]] < u[late]]
            steps.append((alive, ids[e]))
            node = start[e]
            on = np.flatnonzero(node > base)
            alive, seed, base, node = alive[on], seed[on], base[on], node[on]
        drawn = np.zeros(len(word), np.int64)
        for who, _ in steps:
            drawn[who] += 1
        for w, got in drawn_long.items():
            drawn[w] = len(got)
        ends = np.cumsum(drawn)
        out = np.empty(ends[-1], np.int32)
        for k, (who, got) in enumerate(steps):  # a word's pieces were drawn last first
            out[ends[who] - 1 - k] = got
        for w, got in drawn_long.items():
            out[ends[w] - len(got) : ends[w]] = got[::-1]
        cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    @staticmethod
    def _walk(seed: int, base: int, node: int, edge_of, start, ids, bound) -> np.ndarray:
        """Piece ids of one long word, last first."""
        u, out = _draws(np.uint64(seed), np.arange(node - base, dtype=np.uint64)), []
        while node > base:
            e, draw = edge_of.item(node), u.item(len(out))
            while bound.item(e) < draw:
                e += 1
            out.append(ids.item(e))
            node = start.item(e)
        return np.array(out, np.int32)

    def decode(self, ids) -> str:
        """The text of piece ids, without the space put in front."""
        return b"".join(map(self.text_of.__getitem__, ids))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, vocab: dict, key: str = "doc_id", text: str = "text", seed: int = 1, check: bool = False) -> DataFrame:
    """docs with piece_ids (array of int), drawn for each whole text; with check, also lossless: whether decoding gives the text back.

    The draw depends on the key, the text and seed, not on partitions: equal rows are segmented
    alike, and a rerun agrees. A null text has null ids (and lossless null), an empty one no ids.
    Columns of these names are replaced.
    """
    lattice = Lattice(vocab)

    def run(given, given_keys):
        texts, keys = given.to_pylist(), given_keys.to_pylist()
        out, part, size = [None] * len(texts), [], 0
        for i in range(len(texts) + 1):
            if part and (i == len(texts) or size > AT_ONCE):
                own = [texts[j] for j in part]
                for j, ids in zip(part, lattice.sample(own, [xxhash.xxh64_intdigest(f"{keys[j]}\0{texts[j]}", seed) for j in part])):
                    out[j] = ids
                part, size = [], 0
            if i < len(texts) and texts[i] is not None:
                part.append(i)
                size += len(texts[i])
        lengths = [0 if x is None else len(x) for x in out]
        values = np.concatenate([np.zeros(0, np.int32), *(x for x in out if x is not None)])
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        ids = pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()), mask=pa.array([x is None for x in out]))
        if not check:
            return [ids]
        return [ids, pa.array([None if x is None else lattice.decode(x.tolist()) == t for x, t in zip(out, texts)], pa.bool_())]

    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False))]
    return with_arrow_columns(docs, fields + [T.StructField("lossless", T.BooleanType())] * check, run, [text, key], 4 * AT_ONCE)


def decode(docs: DataFrame, vocab: dict, ids: str = "piece_ids") -> DataFrame:
    """docs with decoded, the text of the piece ids; null for null, and replaced if there is such a column."""
    lattice = Lattice(vocab)

    def run(given):
        return [pa.array([None if x is None else lattice.decode(x) for x in given.to_pylist()], pa.string())]

    return with_arrow_columns(docs, [T.StructField("decoded", T.StringType())], run, [ids])


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """A drawn segmentation of every whole text and whether decoding it gives the text back."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode(docs, vocabulary(), check=True)
    return found.select("doc_id", F.size("piece_ids").alias("n_pieces"), "lossless", "piece_ids")
