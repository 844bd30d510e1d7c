"""Exact top-k search by inner product: columnar branch and bound.

Vectors are packed into blocks that hold their components column by column. A block of queries goes
through a block of candidates a few columns at a time. What the columns to come can still add to a
score is bounded by the lengths of the rests; a candidate of a query that cannot reach the query's k-th best so far
is dropped, and once few are left the survivors are compacted to pairs. A query's k-th best is known
from its own block before the search starts, and rises from block to block.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import c, small_batches, stored

#: Candidates and queries of a block, queries that go together, columns that are added at a time.
BLOCK, ASKED, TILE, COLUMNS = 4096, 1024, 64, 8
#: Below this share of survivors a tile goes on as pairs.
SPARSE = 0.15
#: Query blocks whose k-th best scores a task remembers.
REMEMBERED = 64
#: Vectors as long as this or longer, scaled and squared, have blocks of their own, as their products may need more than a double or a long.
LONG = 2.0**52
#: The greatest score; greater ones, and those below its negative, count as it. NONE is less than any score, and its negative is a long too.
MOST, NONE = 2**63 - 2, -(2**63 - 1)
_PACKED = "block long, dims int, n int, ids array<long>, uids array<long>, vectors array<double>"


def _row(block: int, ids: pa.Array, uids: np.ndarray, columns: np.ndarray, *more: np.ndarray) -> list[pa.Array]:
    """One packed row; columns has a row for each dimension."""
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
    return [pa.array([block], pa.int64()), pa.array([columns.shape[0]], pa.int32()), pa.array([columns.shape[1]], pa.int32()), one(ids), one(uids), one(np.ascontiguousarray(columns).reshape(-1)), *map(one, more)]


def pack(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """Blocks of up to block vectors of one length, as floor(scale * x), which a double holds exactly.

    Vectors that are null, or hold a null or a component that is not finite, also when scaled, take
    no part. Very long vectors have blocks of their own. uids number the rows of the input, so that a row is told from others
    of the same key; store what this returns before it is used twice.
    """
    wide = vectors.select(c(key).cast("long").alias("key"), F.transform(c(vector), lambda x: x.cast("double")).alias("v"))
    wide = wide.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf"))))
    wide = wide.select("key", F.monotonically_increasing_id().alias("uid"), "v")

    def run(batches):
        held: dict[tuple, list] = {}

        def out(kind):
            keys, uids, v = zip(*held.pop(kind))
            uids = np.concatenate(uids)
            return pa.RecordBatch.from_arrays(_row(int(uids[0]), pa.concat_arrays(keys), uids, np.concatenate(v).T), names=["block", "dims", "n", "ids", "uids", "vectors"])

        for batch in batches:
            keys, uids, lists = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            offsets = lists.offsets.to_numpy()
            flat = np.floor(scale * lists.values.to_numpy(zero_copy_only=False))
            lengths = np.diff(offsets)
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                v = flat[offsets[at][:, None] + np.arange(dims)].reshape(len(at), dims)
                with np.errstate(over="ignore"):
                    long = (v * v).sum(1) >= LONG
                for kind in ((int(dims), False), (int(dims), True)):
                    own = np.flatnonzero(long == kind[1])
                    for a in range(0, len(own), block):
                        rows = own[a : a + block]
                        held.setdefault(kind, []).append((keys.take(pa.array(at[rows])), uids[at[rows]], v[rows]))
                        if sum(len(x[0]) for x in held[kind]) >= block:
                            yield out(kind)
        for kind in list(held):
            yield out(kind)

    return wide.mapInArrow(run, _PACKED)


def _lists(batch: pa.RecordBatch, names: list[str]):
    """(values of each named column) of each row, lists as arrays."""
    columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
    for i in range(len(batch)):
        yield [x[i].values if pa.types.is_list(x.type) else x[i].as_py() for x in columns]


def _kind(q: np.ndarray, x: np.ndarray):
    """double where all sums are below 2 ** 53 and so exact, which matrix products are fast for; long below 2 ** 62; else whole numbers of any size."""
    with np.errstate(over="ignore", invalid="ignore"):
        longest = lambda m: math.sqrt((m.astype(float) ** 2).sum(0).max(initial=0))
        most = longest(q) * longest(x)
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def _whole(m: np.ndarray, kind) -> np.ndarray:
    """m, whose values are whole, as that kind of number."""
    return np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) if kind is object else m.astype(kind)


def _scores(q: np.ndarray, x: np.ndarray, kind) -> np.ndarray:
    """All inner products of the columns of q and x."""
    score = _whole(q, kind).T @ _whole(x, kind)
    return np.clip(score, -MOST, MOST).astype(np.int64) if kind is object else score


def asked(blocks: DataFrame, k: int, every: int, size: int = ASKED) -> DataFrame:
    """Blocks of the rows whose key is divisible by every, with floors: a score that k other rows of a query's first block reach."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dims):
            ids, uids, v, floors = (np.concatenate(x, axis=-1) for x in zip(*held.pop(dims)))
            return pa.RecordBatch.from_arrays(_row(int(uids[0]), pa.array(ids), uids, v, floors), names=["block", "dims", "n", "ids", "uids", "vectors", "floors"])

        for batch in batches:
            for dims, n, ids, uids, v in _lists(batch, ["dims", "n", "ids", "uids", "vectors"]):
                number = ids.fill_null(1).to_numpy()
                at = np.flatnonzero((number % every == 0) & ids.is_valid().to_numpy(zero_copy_only=False))
                uids, x = uids.to_numpy(), v.to_numpy().reshape(dims, n)
                for a in range(0, len(at), TILE):
                    rows = at[a : a + TILE]
                    score = _scores(x[:, rows], x, _kind(x[:, rows], x)).astype(np.int64)
                    score[np.arange(len(rows)), rows] = NONE
                    floors = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(rows), NONE)
                    held.setdefault(dims, []).append((number[rows], uids[rows], x[:, rows], floors.astype(np.int64)))
                    if sum(len(y[0]) for y in held[dims]) >= size:
                        yield out(dims)
        for dims in list(held):
            yield out(dims)

    return blocks.mapInArrow(run, _PACKED + ", floors array<long>")


def best(q_uids: np.ndarray, q: np.ndarray, top: np.ndarray, ids: pa.Array, uids: np.ndarray, x: np.ndarray, step: int = COLUMNS, reached: list | None = None):
    """(query positions, candidate positions, scores) that may belong to the k best of a query; top, k best scores of each query so far in descending order, is brought up to date.

    q and x have a row for each dimension. reached gets (pairs, pairs that came to the last columns).
    Blocks whose products may exceed a long are compared in full: nothing is bounded by lengths then.
    """
    dims, k = len(q), top.shape[1]
    kind = _kind(q, x)
    exact = _scores(q, x, kind) if kind is object else None
    if exact is None:
        q, x = _whole(q, kind), _whole(x, kind)
    else:
        q, x = np.zeros((0, q.shape[1])), np.zeros((0, x.shape[1]))
        dims = 0
    # columns with the most mass first
    order = np.argsort(-((q.astype(float) ** 2).mean(1) * (x.astype(float) ** 2).mean(1)), kind="stable")
    q, x = q[order], x[order]
    rest = lambda m: np.sqrt(np.append(np.cumsum((m.astype(float) ** 2)[::-1], axis=0)[::-1], np.zeros((1, m.shape[1])), axis=0)) * (1 + 1e-9)
    q_rest, x_rest = rest(q), rest(x)
    names = np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), np.iinfo(np.int64).max)
    for a in range(0, q.shape[1], TILE):
        own = np.arange(a, min(a + TILE, q.shape[1]))
        floor = top[own, -1]
        score, done, pairs = np.zeros((len(own), x.shape[1]), kind) if exact is None else exact[own], 0, None
        while done < dims:
            last = done + step >= dims
            if pairs is None:
                score += q[done : done + step, own].T @ x[done : done + step]
            else:
                i, j = pairs
                value += (q[done : done + step, own[i]] * x[done : done + step, j]).sum(0)  # noqa: F821
            done = min(done + step, dims)
            if not last and pairs is None:
                alive = score + q_rest[done, own][:, None] * x_rest[done][None, :] + 1e-6 >= floor[:, None]
                if alive.mean() < SPARSE:
                    pairs = np.nonzero(alive)
                    value = score[pairs]
            elif not last:
                alive = value + q_rest[done, own[i]] * x_rest[done, j] + 1e-6 >= floor[i]
                pairs, value = (i[alive], j[alive]), value[alive]
            if reached is not None and done + step >= dims and not last:
                reached.append((score.size, int(alive.sum())))
        if pairs is None:
            pairs = np.nonzero(score >= floor[:, None])
            value = score[pairs]
        i, j = pairs
        kept = (value >= floor[i]) & (uids[j] != q_uids[own[i]])
        i, j, value = i[kept], j[kept], value[kept].astype(np.int64)
        # the k best of each query, ties to the smaller key and null last
        order = np.lexsort((names[j], -value, i))
        i, j, value = i[order], j[order], value[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, value, rank = (y[rank < k] for y in (i, j, value, rank))
        new = np.full((len(own), k), NONE)
        new[i, rank] = value
        top[own] = -np.sort(-np.concatenate([top[own], new], axis=1), axis=1)[:, :k]
        yield own[i], j, value


def search(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, tasks: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose key is divisible by every.

    Only vectors of a query's length are its candidates. Ties go to the smaller key, null last. A
    row is not its own candidate, another row of the same key is. Queries with fewer than k
    candidates have as many; an empty table gives no rows; other columns are left aside.
    Components are scaled and floored; a score beyond a long counts as the greatest or least one. Blocks of queries and of candidates meet in a grid of
    tasks, each pair once: queries are copied to its columns and candidates to its rows, whose
    numbers make the copies of both about as large.
    """
    spark = vectors.sparkSession
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    across = min(tasks, max(1, round(math.sqrt(tasks * every))))
    down = max(1, tasks // across)
    blocks = stored(pack(vectors, key, vector, scale, block))
    queries = stored(asked(blocks, k, every))
    spread = lambda n, salt: F.pmod(F.xxhash64("block", F.lit(salt)), F.lit(n)).cast("int")
    queries = queries.select("dims", spread(down, 1).alias("row"), F.explode(F.expr(f"sequence(0, {across - 1})")).alias("col"), F.col("block").alias("q_block"), *(F.col(x).alias(f"q_{x}") for x in ("n", "ids", "uids", "vectors", "floors")))
    blocks = blocks.select("dims", spread(across, 2).alias("col"), F.explode(F.expr(f"sequence(0, {down - 1})")).alias("row"), "n", "ids", "uids", "vectors")
    # neither side has a bound, so none is broadcast; a block of queries then meets its candidates one after another
    met = queries.hint("merge").join(blocks, ["dims", "row", "col"])

    def run(batches):
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            for dims, number, q_n, q_ids, q_uids, q, floors, n, ids, uids, x in _lists(batch, ["dims", "q_block", "q_n", "q_ids", "q_uids", "q_vectors", "q_floors", "n", "ids", "uids", "vectors"]):
                # the k-th best scores that this task has found for a block of queries; forgotten ones only prune less
                top = known.pop(number, None)
                if top is None:
                    top = np.full((q_n, k), NONE)
                    top[:, -1] = floors.to_numpy()
                    top = -np.sort(-np.where(top < top[:, -1:], top[:, -1:], top), axis=1)
                known[number] = top
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
                q_uids, uids = q_uids.to_numpy(), uids.to_numpy()
                for i, j, value in best(q_uids, q.to_numpy().reshape(dims, q_n), top, ids, uids, x.to_numpy().reshape(dims, n)):
                    if len(i):
                        yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), pa.array(q_uids[i]), ids.take(pa.array(j)), pa.array(value)], names=["query_id", "uid", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, uid long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    """The five highest inner products of each query vector."""
    small_batches(spark)
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH u AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS d
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, uid, list_transform(d, lambda x: CAST(x AS HUGEINT)) AS e FROM u
), s AS (
  SELECT q.vec_id AS query_id, q.uid, c.vec_id AS vec_id, CAST(greatest(-9223372036854775806, least(9223372036854775806, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, uid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
