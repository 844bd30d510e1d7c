"""Near duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints are cut into segments. If two differ in few bits, one segment differs in fewer still,
so each fingerprint is filed under its own segments and asks for the small Hamming ball around
them; what meets in a table entry is verified over all bits. Texts that share most of their shingles
differ in more bits: their fingerprints are longer, the segments overlap, and the sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, small_batches, stored, with_arrow_columns
from .graph import components

BITS = 64
#: Rows of a table entry that are compared in one task; larger entries are compared block by block.
BLOCK = 2048


def fingerprint(text: str | None, width: int, words: int = 1, seed: int = 42) -> list[int]:
    """SimHash of the word shingles of a whole text, A-Z in lower case, as signed 64-bit words; zeros without words.

    One word takes its bits from XXH64, two from XXH128. These count a shingle as often as it occurs; see set_fingerprint.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return [0] * words
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - width + 1)
    last = ends[min(width, len(found)) - 1 :].tolist()
    ones = np.zeros(BITS * words, np.int64)
    for at in range(0, n, 1 << 14):
        spans = zip(starts[at : min(at + (1 << 14), n)].tolist(), last[at : at + (1 << 14)])
        if words == 1:
            h = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64).view(np.uint8)
        else:
            h = np.frombuffer(b"".join([xxhash.xxh128_digest(joined[a:b], seed) for a, b in spans]), np.uint8)
        ones += np.unpackbits(h.reshape(-1, 8 * words), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view(np.int64).tolist()


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 5, words: int = 1, seed: int = 42) -> DataFrame:
    """docs with the columns simhash0, and simhash1 for two words, which replace any of these names; a null or empty text has zeros."""

    def run(given):
        marks = [fingerprint(t, width, words, seed) for t in given.to_pylist()]
        return [pa.array([m[k] for m in marks], pa.int64()) for k in range(words)]

    return with_arrow_columns(docs, [T.StructField(f"simhash{k}", T.LongType()) for k in range(words)], run, [text])


def segments(distance: int) -> list[tuple[int, int, int, int]]:
    """(word, first bit, bits, radius) of each segment of one word, such that no pair at most distance apart is missed.

    With m segments and radii r, such pairs are met if the sum of r + 1 exceeds distance: else each
    segment would differ in at least r + 1 bits.
    """
    m = max(2, min((3 * (distance + 1) + 4) // 5, distance + 1))
    spare = max(0, distance + 1 - m)
    cuts = np.linspace(0, BITS, m + 1).astype(int)
    return [(0, int(a), int(b - a), spare // m + (i < spare % m)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def _ball(bits: int, radius: int) -> np.ndarray:
    """All numbers of so many bits with 1 to radius bits set."""
    level, out = {0}, []
    for _ in range(radius):
        level = {x | 1 << i for x in level for i in range(bits) if not x >> i & 1}
        out += sorted(level)
    return np.array(out, np.uint64)


def _filed(marks: DataFrame, parts: list[tuple[int, int, int, int]], words: int) -> DataFrame:
    """(entry, asks, simhash0, ...): each mark filed under its segments, and its questions to the entries in their Hamming balls.

    Of two segments that differ, the question of the one that is greater as a number suffices.
    """
    width = max(b for _, _, b, _ in parts)
    if width > 57:
        raise ValueError("too few segments")
    names = ["entry", "asks", *(f"simhash{k}" for k in range(words))]

    def run(batches):
        for batch in batches:
            x = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(words)]
            for k, (word, first, bits, radius) in enumerate(parts):
                own = (x[word].view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                tag = np.uint64(k) << np.uint64(width)
                yield pa.RecordBatch.from_arrays([pa.array((own | tag).view(np.int64)), pa.array(np.zeros(len(own), bool)), *map(pa.array, x)], names=names)
                for flip in _ball(bits, radius):
                    less = (own ^ flip) < own
                    yield pa.RecordBatch.from_arrays([pa.array(((own ^ flip) | tag)[less].view(np.int64)), pa.array(np.ones(less.sum(), bool)), *(pa.array(y[less]) for y in x)], names=names)

    return marks.select(*names[2:]).mapInArrow(run, "entry long, asks boolean, " + ", ".join(f"{n} long" for n in names[2:]))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each node to its root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _name(words: list[np.ndarray]) -> np.ndarray:
    """One number for a fingerprint: itself if it is one word, else a mixture of all, which two fingerprints share with a chance of 2 ** -64."""
    x = words[0]
    for w in words[1:]:
        x = x * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0xD1342543DE82EF95)) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
    return x


def _met(rows: list[np.ndarray], distance: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that share an entry and a cell; rows: entry, cell, asks and the words of the mark, sorted by the first two."""
    entry, cell, asks, words = rows[0], rows[1], rows[2], rows[3:]
    name = _name(words)
    found, held = [(name[:0], name[:0])], 0
    alive, d = np.arange(len(entry)), 0
    while len(alive):
        d += 1
        alive = alive[alive + d < len(entry)]
        alive = alive[(entry[alive] == entry[alive + d]) & (cell[alive] == cell[alive + d])]
        near = alive[~(asks[alive] & asks[alive + d])]
        near = near[sum(np.bitwise_count(w[near] ^ w[near + d]) for w in words) <= distance]
        near = near[name[near] != name[near + d]]
        if len(near):
            found.append((name[near], name[near + d]))
            held += len(near)
        if held > most:
            found, held = [_forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))], 0
    return _forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def links(marks: DataFrame, parts: list[tuple[int, int, int, int]], distance: int, words: int = 1, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between names of marks whose components are those of all pairs that meet in a segment and are at most distance apart.

    Entries of more than block rows are cut into blocks, and each pair of blocks is compared apart.
    """
    names = [f"simhash{k}" for k in range(words)]
    filed = stored(_filed(marks, parts, words))
    large = stored(filed.groupBy("entry").count().filter(F.col("count") > block).select("entry", F.ceil(F.col("count") / block).cast("long").alias("blocks")))
    if large.isEmpty():
        dealt = filed.withColumn("cell", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("asks", *names), F.col("blocks"))
        dealt = filed.join(large, "entry", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    dealt = dealt.select("entry", "cell", "asks", *names).repartition("entry", "cell").sortWithinPartitions("entry", "cell")

    def run(batches):
        rest = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + words)]
            new[3:] = [x.view(np.uint64) for x in new[3:]]
            rows = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            if not len(rows[0]):
                continue
            cut = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = cut[-1] + 1 if len(cut) else 0  # the last run may go on in the next batch
            a, b = _met([x[:cut] for x in rows], distance)
            rest = [x[cut:] for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        if rest is not None:
            a, b = _met(rest, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, width: int = 4, words: int = 1, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(key, simhash0, ..., component_id) of each row of docs: the least key that links reach, its own included.

    All pairs at most distance apart are linked, as the segments of one word find them; several
    words are for alike. Equal fingerprints are one node, so copies are never paired. Null and empty texts
    have zeros and are linked like any other. A null key gets a result but never names a
    component; a component of null keys alone has a null component_id. Repeated rows get a row
    each, other columns are left aside, an empty table gives no rows.
    """
    if words != 1:
        raise ValueError("groups takes one word")
    names = [f"simhash{k}" for k in range(words)]
    marked = stored(with_fingerprint(docs.select(c(key).alias("key"), c(text).alias("text")), "text", width, words, seed).select("key", *names))
    marks = stored(marked.groupBy(*names).agg(F.min("key").alias("first")).withColumn("mark", F.col("simhash0")))
    roots = stored(components(links(marks, segments(distance), distance, words, block)))
    rooted = stored(marks.join(roots, marks.mark == roots.node, "left").select(*names, "first", F.coalesce("root", "mark").alias("root")))
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    labelled = stored(rooted.join(least, "root").select(*names, "component_id"))
    return marked.join(labelled, names).select(F.col("key").alias(key), *names, "component_id")


#: Words of a set fingerprint, and bits in which two may differ: texts that share four fifths of their shingles differ in 39 of 256 on average, with a deviation of 6.
SET_WORDS, SET_DISTANCE = 4, 64
#: Overlapping segments of a set fingerprint: so many draws of so many of its bits, fixed by a seed.
SAMPLES, SAMPLED = 96, 16
#: Components of candidates of at most so many half blocks are compared whole in left_out; greater ones meet by segment.
WHOLE = 32
#: Bits of the widest sketch of a set of shingles; wider sets share bits, which makes the sketch rule out fewer pairs and loses none.
SKETCH = 1 << 16
_DRAWN = np.array([np.random.default_rng(k).permutation(BITS * SET_WORDS)[:SAMPLED] for k in range(SAMPLES)])


def shingle_set(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The different word shingles of a whole text, A-Z in lower case, as sorted XXH64 numbers; none without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends[min(width, len(found)) - 1 :].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, last)), np.uint64, len(last)))


def set_fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles in SET_WORDS words; zeros of an empty one."""
    ones = np.zeros(BITS * SET_WORDS, np.int64)
    for at in range(0, len(found), 1 << 12):
        x = found[at : at + (1 << 12), None] + np.arange(1, SET_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)


def _sampled(x: list[np.ndarray]) -> np.ndarray:
    """The entry of each mark in each overlapping segment, a row for each mark."""
    bits = np.unpackbits(np.stack(x, 1).view(np.uint8), axis=1, bitorder="little")
    out = np.zeros((len(bits), SAMPLES), np.int32)
    for j in range(SAMPLED):
        out |= bits[:, _DRAWN[:, j]].astype(np.int32) << j
    return out | (np.arange(SAMPLES, dtype=np.int32) << SAMPLED)


def _spanning(i: np.ndarray, j: np.ndarray, d: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) make up a least spanning forest by d, of equal ones those that are not first: each tree picks its nearest pair to another until none is left."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y, tree = at[: len(i)], at[len(i) :], np.arange(len(nodes))
    key = d.astype(np.int64) << 33 | first.astype(np.int64) << 32 | np.arange(len(i))
    chosen, alive = np.zeros(len(i), bool), np.arange(len(i))
    while True:
        alive = alive[tree[x[alive]] != tree[y[alive]]]
        if not len(alive):
            return chosen
        best = np.full(len(nodes), np.iinfo(np.int64).max)
        for end in (x, y):
            np.minimum.at(best, tree[end[alive]], key[alive])
        picked = np.unique(best[best < np.iinfo(np.int64).max] & 0xFFFFFFFF)
        chosen[picked] = True
        far, root = _forest(tree[x[picked]], tree[y[picked]])
        new = np.arange(len(nodes))
        new[far] = root
        tree = new[tree]


def _close(rows: list[np.ndarray]):
    """(i, j, d) of rows i and j of one cell, which differ in d bits, SET_DISTANCE at most, offset by offset; rows: entry, cell, own and the words, sorted by the first two."""
    entry, cell, own, words = rows[0], rows[1], rows[2], rows[3:]
    alive, d = np.arange(len(entry)), 0
    while len(alive):
        d += 1
        alive = alive[alive + d < len(entry)]
        alive = alive[(entry[alive] == entry[alive + d]) & (cell[alive] == cell[alive + d])]
        near = alive[(own[alive] != own[alive + d]) | (own[alive] < 0)]
        apart = sum(np.bitwise_count(w[near] ^ w[near + d]).astype(np.int32) for w in words)
        near, apart = near[apart <= SET_DISTANCE], apart[apart <= SET_DISTANCE]
        if len(near):
            yield near, near + d, apart


def _sharing_first(entry: np.ndarray, words: list[np.ndarray]):
    """A test of pairs (i, j) of rows of one entry: whether its segment is the first that they share."""
    known, segment = np.zeros(len(entry), bool), np.zeros((len(entry), SAMPLES), np.int32)

    def test(i, j):
        new = np.unique(np.concatenate([i[~known[i]], j[~known[j]]]))
        known[new] = True
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            segment[part] = _sampled([w[part].view(np.int64) for w in words])
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 14):
            x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            out[at : at + (1 << 14)] = (segment[x] == segment[y]).argmax(axis=1) == entry[x] >> SAMPLED
        return out

    return test


def _trees(rows: list[np.ndarray], most: int = 1 << 20) -> tuple:
    """Of a least spanning forest of the close pairs of each cell those, (i, j, d), whose first segment is the cell's."""
    held, size, first = [], 0, _sharing_first(rows[0], rows[3:])
    for i, j, d in _close(rows):
        held.append((i, j, d, first(i, j)))
        size += len(i)
        if size > most:
            held = [_thinned(held)]
            size = len(held[0][0])
    i, j, d, own = _thinned(held) if held else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    return i[own], j[own], d[own]


def _thinned(held: list) -> tuple:
    found = [np.concatenate(x) for x in zip(*held)]
    chosen = _spanning(*found)
    return tuple(x[chosen] for x in found)


def _by_cell(batches, words: int, emit):
    """emit(rows) for whole cells of batches that are sorted by cell; the last one may go on in the next batch."""
    rest = None
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        new[3 : 3 + words] = [x.view(np.uint64) for x in new[3 : 3 + words]]
        rows = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
        if not len(rows[0]):
            continue
        cut = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = cut[-1] + 1 if len(cut) else 0
        yield from emit([x[:cut] for x in rows])
        rest = [x[cut:] for x in rows]
    if rest is not None:
        yield from emit(rest)


def _by_segment(marks: DataFrame, block: int) -> DataFrame:
    """marks, a row for each of their segments: entry, cell, own, simhash0, ... and the other columns, whole cells in a task and sorted by them.

    Entries of about block rows or more are cut into blocks, and each pair of blocks is a cell. own
    is the row's block, -1 in the cell of that block alone.
    """
    names = [f"simhash{k}" for k in range(SET_WORDS)]
    others = [x for x in marks.columns if x not in names]
    marks = marks.select(*names, *others)
    few = max(1, block // (2 * max(1, marks.rdd.getNumPartitions())))

    def counted(batches):
        n = np.zeros(SAMPLES << SAMPLED, np.int32)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                np.add.at(n, _sampled([part.column(k).to_numpy(zero_copy_only=False) for k in range(SET_WORDS)]).ravel(), 1)
        hot = np.flatnonzero(n >= few)
        yield pa.RecordBatch.from_arrays([pa.array(hot.astype(np.int32)), pa.array(n[hot].astype(np.int64))], names=["entry", "n"])

    def filed(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                entry = _sampled([part.column(k).to_numpy(zero_copy_only=False) for k in range(SET_WORDS)])
                for k in range(SAMPLES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(entry[:, k])), *part.columns], names=["entry", *names, *others])

    # a part's counts below few are left out: together they miss half a block of an entry at most
    large = stored(marks.select(*names).mapInArrow(counted, "entry int, n long").groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") > block // 2).select("entry", F.ceil((F.col("n") + block // 2) / block).cast("int").alias("blocks")))
    dealt = marks.mapInArrow(filed, T.StructType([T.StructField("entry", T.IntegerType()), *marks.schema.fields]))
    if large.isEmpty():
        dealt = dealt.withColumn("own", F.lit(-1)).withColumn("cell", F.lit(0))
    else:
        dealt = _in_blocks(dealt.join(large, "entry", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))))
    return dealt.select("entry", "cell", "own", *names, *others).repartition("entry", "cell").sortWithinPartitions("entry", "cell")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows in each cell of their block, of as many blocks as they say, with any other block: cell, and own, which is -1 in the cell of that block alone, the only one that compares two of its rows."""
    own = F.pmod(F.xxhash64(*(f"simhash{k}" for k in range(SET_WORDS))), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    return dealt.withColumn("own", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")))


def candidates(marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, d), a > b, of names of marks that share a segment and differ in d bits, SET_DISTANCE at most: not all of them, but such that between the two of any such pair lead some that are no farther apart.

    Of each cell a least spanning forest of its pairs, less those that share an earlier segment:
    that segment's cell has them, or pairs that lead from one to the other and are no farther
    apart. So no pair is given twice, and a group of near copies gives some pairs for each of its
    members, not some for each segment of each.
    """

    def meet(rows):
        i, j, d = _trees(rows)
        name = _name(rows[3:]).view(np.int64)
        kept = name[i] != name[j]
        a, b = name[i[kept]], name[j[kept]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(d[kept].astype(np.int32))], names=["a", "b", "d"])

    dealt = _by_segment(marks.select(*(f"simhash{k}" for k in range(SET_WORDS))), block)
    return dealt.mapInArrow(lambda batches: _by_cell(batches, SET_WORDS, meet), "a long, b long, d int")


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of a set of shingles, as bytes: each shingle flips one bit of at least four times as many, a power of two from 2 ** 10 to SKETCH.

    Two sets differ in at least as many shingles as their sketches of one width differ in bits. The
    two halves of a sketch, one laid over the other, are the sketch of half the width.
    """
    bits = min(SKETCH, 1 << max(10, (4 * len(found) - 1).bit_length()))
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def _may_be_alike(i: np.ndarray, j: np.ndarray, size: np.ndarray, shown: list[bytes], least: float, at_once: int = 1 << 22) -> np.ndarray:
    """Which pairs (i, j) of sets of these sizes and sketches are not ruled out for a similarity of least or more: alike sets are of like sizes and differ in few shingles for them."""
    both = size[i] + size[j]
    may = np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9
    width = np.array([len(x) for x in shown])
    shared = np.minimum(width[i], width[j])
    for w in np.unique(shared[may]).tolist():
        at = np.flatnonzero(may & (shared == w))
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(shown[k], np.uint64).reshape(-1, w // 8), axis=0) for k in used.tolist()])
        x, y = place[: len(at)], place[len(at) :]
        for k in range(0, len(at), max(1, at_once // w)):
            part = slice(k, k + max(1, at_once // w))
            apart = np.bitwise_count(folded[x[part]] ^ folded[y[part]]).sum(axis=1, dtype=np.int64)
            may[at[part]] = apart <= (1 - least) / (1 + least) * both[at[part]] + 1e-9
    return may


def left_out(pairs: DataFrame, marks: DataFrame, sets: DataFrame, roots: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b) of marks that pairs, the candidates, connect and that lie in different components of roots (node, root), as far as they may be alike: differ in SET_DISTANCE bits at most and are not ruled out by sketches of their sets.

    The sketches rule out no pair that is alike. Each component of the candidates is compared whole,
    in cells of two half blocks, so a node is one row for each of its half blocks' cells; those of
    more than WHOLE half blocks meet by segment once more. Either way each pair meets once.
    """
    names = [f"simhash{k}" for k in range(SET_WORDS)]
    half = max(1, block // 2)
    trees = components(pairs.select("a", "b")).withColumnRenamed("root", "tree")
    nodes = stored(trees.join(roots, "node", "left").select("node", "tree", F.coalesce("root", "node").alias("root")))
    # the one pair of a component of two is a candidate, and known
    mixed = stored(nodes.groupBy("tree").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("n > 2 AND lo <> hi").select("tree", F.ceil(F.col("n") / half).cast("int").alias("blocks")))

    def sketched(given):
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in given]
        return [pa.array([len(x) for x in found], pa.int64()), pa.array([sketch(x).tobytes() for x in found], pa.binary())]

    held = nodes.join(mixed, "tree").join(marks.select("node", *names), "node").join(sets, "node")
    held = stored(with_arrow_columns(held, [T.StructField("size", T.LongType()), T.StructField("sketch", T.BinaryType())], sketched, ["shingles"]).drop("shingles"))
    others = [*names, "root", "node", "size", "sketch"]

    def meet(rows, by_segment):
        own, words, (root, node, size, shown) = rows[2], rows[3 : 3 + SET_WORDS], rows[3 + SET_WORDS :]
        apart = np.unique(root, return_inverse=True)[1]
        first = _sharing_first(rows[0], words) if by_segment else None
        for i, j, _ in _close([*rows[:2], apart, *words]):
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                met = (own[x] != own[y]) | (own[x] < 0)
                x, y = x[met], y[met]
                may = _may_be_alike(x, y, size, shown, least)
                x, y = x[may], y[may]
                if first:
                    met = first(x, y)
                    x, y = x[met], y[met]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[x], node[y])), pa.array(np.minimum(node[x], node[y]))], names=["a", "b"])

    whole = _in_blocks(held.filter(F.col("blocks") <= WHOLE)).select("tree", "cell", "own", *others).repartition("tree", "cell").sortWithinPartitions("tree", "cell")
    found = whole.mapInArrow(lambda batches: _by_cell(batches, SET_WORDS, lambda rows: meet(rows, False)), "a long, b long")
    if mixed.filter(F.col("blocks") > WHOLE).isEmpty():
        return found
    parts = _by_segment(held.filter(F.col("blocks") > WHOLE).select(*others), block)
    return found.unionByName(parts.mapInArrow(lambda batches: _by_cell(batches, SET_WORDS, lambda rows: meet(rows, True)), "a long, b long"))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets, of sets (node, shingles), have a Jaccard similarity of least or more."""
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def alike(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, width: int = 5, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(key, mark, component_id, component_mark) of each row of docs: the least key, null last, and text of it, that links reach.

    Texts are linked whose sets of word shingles have a Jaccard similarity of least or more. Set
    fingerprints find the candidates, the sets themselves decide. mark is the XXH64 of the text.
    Texts with equal fingerprints are one node: at 256 bits they share all but a thousandth of
    their shingles. First each node's nearest candidate is verified, then those of the spanning
    forests that still lead to another component, then what the forests left out and may still
    link components (see left_out): a large group of near copies is not verified pair by pair, and
    no candidate is lost. Null and empty texts are one
    node. A component of null keys alone has a null component_id. Repeated rows get a row each.
    """
    names = [f"simhash{k}" for k in range(SET_WORDS)]
    rows = docs.select(c(key).alias("key"), c(text).alias("text")).withColumn("mark", F.xxhash64("text"))

    def marks_of(given):
        found = np.array([set_fingerprint(shingle_set(t, width, seed)) for t in given.to_pylist()], np.int64).reshape(-1, SET_WORDS)
        return [*(pa.array(np.ascontiguousarray(found[:, k])) for k in range(SET_WORDS)), pa.array(_name([np.ascontiguousarray(found[:, k]).view(np.uint64) for k in range(SET_WORDS)]).view(np.int64))]

    def sets_of(given):
        return [pa.array([shingle_set(t, width, seed).tobytes() for t in given.to_pylist()], pa.binary())]

    marked = stored(with_arrow_columns(rows, [T.StructField(n, T.LongType()) for n in (*names, "node")], marks_of, ["text"]).select("key", "mark", *names, "node"))
    nodes = stored(marked.groupBy("node", *names).agg(F.min(F.struct(F.col("key").isNull().alias("absent"), "key", "mark")).alias("first"), F.min("mark").alias("shown")))
    pairs = stored(candidates(nodes, block))
    asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "shown"), "node"))
    texts = rows.select("text", "mark").join(asked.select(F.col("shown").alias("mark")), "mark", "left_semi").dropDuplicates(["mark"])
    sets = with_arrow_columns(texts, [T.StructField("shingles", T.BinaryType())], sets_of, ["text"]).select("mark", "shingles")
    sets = stored(sets.join(asked, sets.mark == asked.shown).select("node", "shingles"))
    near = stored(verified(pairs.groupBy("a").agg(F.min(F.struct("d", "b"))["b"].alias("b")), sets, least))
    roots = stored(components(near))
    root = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
    open_ = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    near = stored(near.unionByName(verified(open_, sets, least)))
    roots = stored(components(near))
    more = stored(verified(left_out(pairs, nodes, sets, roots, least, block), sets, least))
    if not more.isEmpty():
        roots = stored(components(near.unionByName(more)))
    rooted = stored(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    named = stored(rooted.join(rooted.groupBy("root").agg(F.min("first").alias("of")), "root").select("node", F.col("of.key").alias("component_id"), F.col("of.mark").alias("component_mark")))
    return marked.join(named, "node").select(F.col("key").alias(key), "mark", "component_id", "component_mark")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over four-word shingles, and its component."""
    small_batches(spark)
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), distance=4, width=4, words=1)
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash0")), 16, "0").alias("fingerprint"), "component_id")
