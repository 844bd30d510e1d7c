"""The trie of all beginnings of conversations, as succinct level-order tries.

A turn is told by a 128-bit digest of role and text, a beginning by a 128-bit chain of such
digests. Equal conversations are added up first. Beginnings that a large share of all turns pass
through are the heavy upper levels; every other conversation belongs to the shard of its first
beginning that is not heavy. A task builds the tries of its shards: for each level of nodes the
degrees in unary and the labels (LOUDS). Sums roll up from the last level to the first along the
parents that the bits tell. What the shards hand up is added to the heavy nodes, of which there
are at most 4 for each partition, and those make one last trie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, c, small_batches, stored

#: Ids of one chunk of a list of members, turns of one partition of shards, and turns that a task builds tries of at once.
CHUNK, PARTITION, AT_ONCE = 1 << 16, 2_000_000, 1 << 18
NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, p1 long, p2 long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class Louds:
    """A trie in level order: node 0 is the root, bits hold each node's degree in unary, labels one entry for each node but the root."""

    def __init__(self, parents: np.ndarray, labels: np.ndarray):
        """parents of the nodes 1, 2, ..., in ascending order; every parent stands before its children."""
        self.n, self.labels = len(parents) + 1, labels
        degrees = np.bincount(parents, minlength=self.n)
        bits = np.ones(2 * self.n - 1, np.uint8)
        bits[np.cumsum(degrees) + np.arange(self.n)] = 0
        self.bits = np.packbits(bits, bitorder="little")

    def parents(self) -> np.ndarray:
        """Each node's parent, read off the bits: as many zeros stand before a node's one. The root's is -1."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=2 * self.n - 1, bitorder="little"))
        return np.concatenate([[-1], ones - np.arange(len(ones))])

    def children(self, node: int) -> np.ndarray:
        """The nodes under a node, in the order of their labels."""
        at = np.flatnonzero(self.parents() == node)
        return at[np.argsort(self.labels[at - 1], kind="stable")]

    def levels(self) -> np.ndarray:
        """Where each level begins, and the number of nodes at the end."""
        parents, starts = self.parents(), [0, 1]
        while starts[-1] < self.n:  # a level ends before the first node whose parent lies in it
            starts.append(int(np.searchsorted(parents, starts[-1])))
        return np.array(starts if self.n > 1 else [0, 1])

    def rolled(self, values: np.ndarray, how=np.add) -> np.ndarray:
        """Each node's value with those of all nodes below it, from the last level to the first."""
        out, parents, starts = values.copy(), self.parents(), self.levels()
        for lo, hi in zip(starts[-2:0:-1], starts[:0:-1]):
            how.at(out, parents[lo:hi], out[lo:hi])
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chained(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit key of each beginning of each sequence of digests."""
    a, b, starts = a.view(np.uint64), b.view(np.uint64), np.cumsum(lengths) - lengths
    k1, k2 = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    h1, h2, rows = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.uint64), np.flatnonzero(lengths)
    depth = 0
    while len(rows):
        at = starts[rows] + depth
        h1[rows] = _mixed((h1[rows] + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95) ^ _mixed(a[at]))
        h2[rows] = _mixed((h2[rows] + np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xDA942042E4DD58B5) ^ _mixed(b[at] ^ h1[rows]))
        k1[at], k2[at] = h1[rows], h2[rows]
        depth += 1
        rows = rows[lengths[rows] > depth]
    return k1.view(np.int64), k2.view(np.int64)


def _list(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns as array of struct(a, b, words), by turn, null first.

    Null roles and texts count as empty. Rows of one turn go by their digests, repeated rows are
    turns of their own. Rows without a conversation belong to none. A conversation is one array,
    24 bytes a turn.
    """
    said, by = F.coalesce(c(text), F.lit("")), F.coalesce(c(role), F.lit(""))
    row = F.struct(c(turn).isNotNull().alias("has"), F.coalesce(c(turn).cast("long"), F.lit(0)).alias("at"), F.xxhash64(by, said).alias("a"), F.xxhash64(F.lit(1), said, by).alias("b"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"))
    whole = conversations.filter(c(conv).isNotNull()).select(c(conv).cast("long").alias("conv_id"), row.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return whole.select("conv_id", F.transform("x", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["words"].alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin with the first h turns of their family's first one, c - c % family, and go on with their own after h; h = crc32(c) % most."""
    own = stored(turns)
    first = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return own.join(first, F.col("conv_id") - F.col("conv_id") % family == F.col("first"), "left").select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _keyed(sequences: DataFrame) -> DataFrame:
    """(conv_id, labels, k1, k2, words, e1, e2): the key of each beginning and, as e1 and e2, of the whole; 0 of an empty one."""

    def run(batches):
        for batch in batches:
            conv, a, b, words = batch.columns
            lengths = a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            labels = _flat(a)
            k1, k2 = _chained(labels, _flat(b), lengths)
            last = np.cumsum(lengths) - 1
            end = [np.where(lengths > 0, k[np.maximum(last, 0)], 0) if len(k) else np.zeros(len(lengths), np.int64) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays([conv, *(_list(x, lengths) for x in (labels, k1, k2, _flat(words))), *map(pa.array, end)], names=["conv_id", "labels", "k1", "k2", "words", "e1", "e2"])

    arrays = sequences.select("conv_id", *(F.col(f"turns.{x}").alias(x) for x in ("a", "b", "words")))
    return arrays.mapInArrow(run, "conv_id long, labels array<long>, k1 array<long>, k2 array<long>, words array<long>, e1 long, e2 long")


def _members(keyed: DataFrame) -> DataFrame:
    """(e1, e2, n, first, sha): the members that end at a node, their least id, and the digest of all their ids.

    Ids are sorted over all partitions and packed into chunks of text; a digest is carried on from
    chunk to chunk, so a task holds one chunk, however many members a node has.
    """

    def packed(batches):
        for batch in batches:
            e1, e2, conv = (x.to_numpy() for x in batch.columns)
            new = np.concatenate([[True], (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])]) if len(conv) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            starts = np.concatenate([np.arange(lo, hi, CHUNK) for lo, hi in zip(starts, [*starts[1:], len(conv)])] or [starts])
            ends = [*starts[1:], len(conv)]
            ids = [",".join(map(str, conv[lo:hi].tolist())) for lo, hi in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(e1[starts]), pa.array(e2[starts]), pa.array(conv[starts]), pa.array(np.diff([*starts, len(conv)]), pa.int64()), pa.array(ids, pa.string())], names=["e1", "e2", "first", "n", "ids"])

    def hashed(batches):
        key, first, n, digest = None, 0, 0, None
        for batch in batches:
            rows = []
            for e1, e2, least, count, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if key != (e1, e2):
                    if key is not None:
                        rows.append((*key, n, first, digest.hexdigest()))
                    key, first, n, digest = (e1, e2), least, 0, hashlib.sha256()
                digest.update(("," if n else "").encode() + ids.encode())
                n += count
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["e1", "e2", "n", "first", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, n, first, digest.hexdigest())], names=["e1", "e2", "n", "first", "sha"])

    chunks = keyed.select("e1", "e2", "conv_id").repartitionByRange("e1", "e2", "conv_id").sortWithinPartitions("e1", "e2", "conv_id").mapInArrow(packed, "e1 long, e2 long, first long, n long, ids string")
    return chunks.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first").mapInArrow(hashed, "e1 long, e2 long, n long, first long, sha string")


def _forest(skip, lengths, k1, k2, labels, words, n, first) -> tuple[Louds, dict]:
    """The trie of sequences from depth skip on, below a root of its own, and its nodes' values in level order."""
    starts = np.cumsum(lengths) - lengths + skip
    over, node = lengths - skip, np.zeros(len(lengths), np.int64)
    parents, names, size, own, depth, p1, p2 = [], [], 1, [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], []
    members, least, ends = [np.zeros(1, np.int64)], [np.full(1, np.iinfo(np.int64).max)], [np.full(1, -1)]
    rows, level = np.arange(len(lengths)), 0
    while len(rows):
        at = starts[rows] + level
        order = np.lexsort((k2[at], k1[at], labels[at], node[rows]))
        rows, at = rows[order], at[order]
        above = node[rows]
        new = np.concatenate([[True], (above[1:] != above[:-1]) | (k1[at][1:] != k1[at][:-1]) | (k2[at][1:] != k2[at][:-1])])
        which, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        parents.append(above[heads]), names.append(labels[at[heads]]), own.append(words[at[heads]]), depth.append(skip[rows[heads]] + level + 1)
        here, low, end = np.zeros(len(heads), np.int64), np.full(len(heads), np.iinfo(np.int64).max), np.full(len(heads), -1)
        last = over[rows] == level + 1
        here[which[last]], low[which[last]], end[which[last]] = n[rows[last]], first[rows[last]], rows[last]
        members.append(here), least.append(low), ends.append(end)
        if level == 0:
            outer = np.maximum(at[heads] - 1, 0)
            top = skip[rows[heads]] > 0
            p1, p2 = np.where(top, k1[outer], 0), np.where(top, k2[outer], 0)
        node[rows] = size + which
        size += len(heads)
        level += 1
        rows = rows[over[rows] > level]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    tree = Louds(cat(parents), cat(names))
    return tree, {"words": cat(own), "depth": cat(depth), "members": cat(members), "least": cat(least), "ends": cat(ends), "p1": p1, "p2": p2}


def _sums(tree: Louds, x: dict, leaves=0, saved=0, children=0) -> dict:
    """What each node's subtree adds up to; leaves, saved and children are what is handed up to a node besides."""
    members, least = tree.rolled(x["members"]), tree.rolled(x["least"], np.minimum)
    degrees = np.bincount(tree.parents()[1:], minlength=tree.n) + children
    return {"n_convs": members, "conv_id": least, "n_children": degrees, "n_leaves": tree.rolled((degrees == 0).astype(np.int64) + leaves), "saved_tokens": tree.rolled((members - 1) * x["words"] + saved)}


def _shards(rows: DataFrame) -> DataFrame:
    """The nodes of all shards; the first of each shard have the key of their parent as p1 and p2, others their parent's least member."""
    names = ["skip", "s1", "s2", "labels", "k1", "k2", "words", "n", "first", "sha"]

    def built(x: pa.Table) -> pa.RecordBatch:
        lists = {k: x[k].combine_chunks() for k in ("labels", "k1", "k2", "words")}
        lengths = lists["k1"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = {k: _flat(v) for k, v in lists.items()}
        one = lambda k: x[k].to_numpy()
        tree, v = _forest(one("skip"), lengths, flat["k1"], flat["k2"], flat["labels"], flat["words"], one("n"), one("first"))
        s, parents = _sums(tree, v), tree.parents()[1:]
        top = parents == 0
        p1, p2 = (np.concatenate([p, np.zeros(tree.n - 1 - len(p), np.int64)]) for p in (v["p1"], v["p2"]))
        sha = x["sha"].take(pa.array(v["ends"][1:], mask=v["ends"][1:] < 0)).combine_chunks()
        columns = [s["conv_id"][1:], v["depth"][1:], pa.array(s["conv_id"][parents], mask=top), pa.array(p1, mask=~top), pa.array(p2, mask=~top), *(s[k][1:] for k in ("n_convs", "n_children", "n_leaves", "saved_tokens")), sha]
        return pa.RecordBatch.from_arrays([y if isinstance(y, pa.Array) else pa.array(y) for y in columns], names=[f.split()[0] for f in _NODE.split(", ")])

    def run(batches):
        held, turns = [], 0
        for batch in batches:
            if held and turns >= AT_ONCE:  # build all shards but the last, which may go on
                x = pa.Table.from_batches(held)
                s1, s2 = x["s1"].to_numpy(), x["s2"].to_numpy()
                done = int(np.flatnonzero((s1 != s1[-1]) | (s2 != s2[-1])).max(initial=-1)) + 1
                if done:
                    yield built(x.slice(0, done))
                    held = x.slice(done).to_batches()
                    turns = sum(len(b.column(4).flatten()) for b in held)
            held.append(batch)
            turns += len(batch.column(4).flatten())
        if turns:
            yield built(pa.Table.from_batches(held))

    return rows.select(*names).mapInArrow(run, _NODE)


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, turns), the root first met included; conv_id must differ.

    conv_id (least member), depth, parent_conv_id (null of the root), n_convs (members), n_children,
    n_leaves and saved_tokens of the subtree (members but one, times words of the last turn), and
    ends_sha256 (of the ids of those that end here, in order, with commas). No sequences, no nodes.
    """
    spark = sequences.sparkSession
    keyed = stored(_keyed(sequences))
    members = stored(_members(keyed))
    rows = stored(keyed.join(members.select("n", "first", "sha"), F.col("conv_id") == F.col("first")).drop("conv_id"))
    turns = rows.agg(F.sum(F.size("k1"))).first()[0]
    if turns is None:
        return spark.createDataFrame([], _NODE).drop("p1", "p2")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // PARTITION))
    limit = max(1, turns // (4 * parts))
    at = F.posexplode(F.arrays_zip("k1", "k2", "words", "labels")).alias("i", "x")
    before = lambda k: F.coalesce(F.get(k, F.col("i") - 1), F.lit(0)).alias(f"p{k[1]}")
    begun = rows.select("k1", "k2", at).select("x.*", "i", before("k1"), before("k2"))
    # each turn passes through one beginning of each depth, so at most turns / limit beginnings are heavy
    heavy = begun.groupBy("k1", "k2").agg(F.count("*").alias("passing"), *(F.max(x).alias(x) for x in ("i", "p1", "p2", "words", "labels"))).filter(F.col("passing") > limit).collect()
    heavy = sorted(((r.i + 1, r.p1, r.p2, r.labels, r.k1, r.k2, r.words) for r in heavy))
    known = np.array(sorted((h[4], h[5]) for h in heavy), np.int64).reshape(-1, 2)
    known = np.ascontiguousarray(known).view([("a", np.int64), ("b", np.int64)]).ravel()

    def skipped(batches):
        for batch in batches:
            x = dict(zip(batch.schema.names, batch.columns))
            lengths = x["k1"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.stack([_flat(x["k1"]), _flat(x["k2"])], axis=1)
            inside = np.isin(np.ascontiguousarray(keys).view(known.dtype).ravel(), known)
            ends = np.cumsum(lengths)
            total = np.concatenate([[0], np.cumsum(inside)])
            skip = total[ends] - total[ends - lengths]  # what lies before a heavy beginning is heavy too
            at = np.minimum(ends - lengths + skip, len(keys) - 1)
            shard = [np.where(skip < lengths, keys[at, i], 0) if len(keys) else np.zeros(len(lengths), np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(skip, pa.int64()), *map(pa.array, shard)], names=[*batch.schema.names, "skip", "s1", "s2"])

    dealt = rows.mapInArrow(skipped, "labels array<long>, k1 array<long>, k2 array<long>, words array<long>, e1 long, e2 long, n long, first long, sha string, skip long, s1 long, s2 long")
    light = dealt.filter(F.col("skip") < F.size("k1"))
    shards = light.repartition(parts, "s1", "s2") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else light.repartition("s1", "s2")
    nodes = stored(_shards(shards.sortWithinPartitions("s1", "s2")))
    handed = nodes.filter("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.count("*").alias("children"), F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ended = dealt.filter(F.col("skip") == F.size("k1")).select("e1", "e2", "n", "first", "sha")
    upper = _upper(heavy, {(r.p1, r.p2): r for r in handed.collect()}, {(r.e1, r.e2): r for r in ended.collect()})
    top = spark.createDataFrame([r[2:] for r in upper], _NODE.replace("p1 long, p2 long, ", ""))
    keys = spark.createDataFrame([r[:3] for r in upper], "u1 long, u2 long, above long")
    below = nodes.join(F.broadcast(keys), (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2")), "left")
    below = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*top.columns)
    return below.unionByName(top).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def _upper(heavy: list, handed: dict, ended: dict) -> list[tuple]:
    """Rows (key, node) of the root and the heavy nodes, whose values the shards handed up or which end there."""
    place, kids = {(0, 0): 0}, {}
    for h in heavy:
        kids.setdefault(h[1:3], []).append(h)
    order, parents = [(0, 0, 0, 0, 0, 0, 0)], []
    for node, h in enumerate(order):
        for kid in kids.get(h[4:6], ()):
            place[kid[4:6]] = len(order)
            parents.append(node), order.append(kid)
    tree, nothing = Louds(np.array(parents, np.int64), np.array([h[3] for h in order[1:]], np.int64)), np.iinfo(np.int64).max
    got = lambda of, name, none: np.array([getattr(of[h[4:6]], name) if h[4:6] in of else none for h in order], np.int64)
    x = {"words": np.array([h[6] for h in order], np.int64), "members": got(handed, "n", 0) + got(ended, "n", 0), "least": np.minimum(got(handed, "least", nothing), got(ended, "first", nothing))}
    s = _sums(tree, x, got(handed, "leaves", 0), got(handed, "saved", 0), got(handed, "children", 0))
    parent, out = tree.parents(), []
    for i, h in enumerate(order):
        conv = int(s["conv_id"][i])
        out.append((h[4], h[5], conv, h[0], int(s["conv_id"][parent[i]]) if i else None, *(int(s[k][i]) for k in ("n_convs", "n_children", "n_leaves", "saved_tokens")), ended[h[4:6]].sha if h[4:6] in ended else None))
    return out


def op12_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations, a row for each node."""
    small_batches(spark)
    turns = turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    nodes = trie(rebuilt(turns))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
