"""Approximate nearest neighbours by largest inner product.

Index.  Equal vectors make one node.  Vectors are scaled by the largest norm and
get one more component that makes their norms 1, so that the largest inner
product is the smallest angle.  Nodes are dealt to blocks by a hash, once; a task
holds one block and makes its graph.  Trees of random hyperplanes deal the block's
nodes to small buckets; each node's best partners there are its first neighbours.
NN-descent then improves the lists: what gathers at a node, its neighbours and those
that list it, is compared, and each of two that are closer than the worst on a list
is told.  Pairs of old neighbours have met before and are skipped.

Search.  Every query goes to every block, and is searched there along the graph: it
keeps a pool of its nearest so far, whose best nodes are expanded until none is left.
The pools of all blocks have ``width`` places together.  Each block's best are scored
in double precision, and the best of all blocks are the result.

Every vector is indexed and every query searches all blocks.  So the vectors travel
once, whatever the rounds; the searches' work grows with queries times blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, release, shuffle_partitions, trim

#: Nodes of a bucket of the trees at most, and of a block about, at most and, where
#: there are fewer for each core, at least.
BUCKET, BLOCK, SMALL = 1600, 64_000, 4096
#: Queries of a partition, about.
LARGE = 50_000
#: Nodes of a block that every search there may start from, at most (and at most a
#: sixteenth of them, or 256), queries that are searched at a time, and nodes that
#: each of them expands at a time.
SEEDS, TOGETHER, EXPAND = 4096, 128, 8


def _frame(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` as one binary each."""
    cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of binaries, and how many each row has."""
    dtype = np.dtype(dtype)
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=dtype), np.fromiter((len(p) // dtype.itemsize for p in parts), np.int64, len(parts))


def _rank(group: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal values."""
    if not len(group):
        return np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(head, np.diff(np.concatenate([head, [len(group)]])))


def _partitions(spark: SparkSession, n: int, small: int) -> int:
    return max(1, min(-(-n // small), max(shuffle_partitions(spark), -(-n // LARGE))))


def _deal(df: DataFrame, parts: int, key: str, *order: str) -> DataFrame:
    """Rows dealt to ``parts`` partitions by a key, and sorted there."""
    return df.repartitionById(parts, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).sortWithinPartitions(key, *order)


# Preparing ---------------------------------------------------------------------


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int | None = None) -> tuple[DataFrame, int, str]:
    """``vec_id`` and ``vec`` (packed) of the rows that can take part.

    Null ids or vectors, zero vectors and vectors with null or non-finite
    components take none; nor do those whose length isn't ``dims``, by default
    the commonest (of ties, the smallest).  Returns the length and the components' type too.
    """
    chosen = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    kind = "<f4" if isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    if dims is None:
        sizes = chosen.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        dims = sizes[0].d if sizes else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
            ok = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
            own = flat[ok].astype(kind)
            yield _frame(vec_id=batch.column(0).filter(pa.array(ok)), vec=_lists(own.ravel(), np.full(len(own), dims)))

    return chosen.where(F.size("v") == dims).mapInArrow(run, "vec_id long, vec binary"), dims, kind


@dataclass
class Index:
    nodes: DataFrame  # block, node, vec, near (packed ids): what searches read
    members: DataFrame  # node, vec_id: the smallest ids of equal vectors
    dims: int
    kind: str
    n: int
    blocks: int


# Graphs of blocks ----------------------------------------------------------------


def _leaves(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows dealt to buckets by a tree of hyperplanes between two random points,
    each halving its rows."""
    groups = [np.arange(len(x))]
    while len(groups[-1]) > BUCKET:
        halves = []
        for own in groups:
            a, b = rng.choice(own, 2, replace=False)
            side, half = x[own] @ (x[a] - x[b]), len(own) // 2
            order = np.argpartition(side, half)
            halves += [own[order[:half]], own[order[half:]]]
        groups = halves
    return groups


def _best(sims: np.ndarray, most: int) -> np.ndarray:
    """Places of each row's largest values, not in order."""
    return np.argpartition(-sims, most - 1, axis=1)[:, :most] if sims.shape[1] > most else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)


def _merge(ids: np.ndarray, sims: np.ndarray, k: int):
    """The ``k`` most similar of each row, in order, each id once, and where they
    were; of equal ids the first counts.  Empty places are -1."""
    order = np.argsort(ids, axis=1, kind="stable")
    sorted_ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    sims[:, 1:][sorted_ids[:, 1:] == sorted_ids[:, :-1]] = -np.inf
    sims[sorted_ids < 0] = -np.inf
    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    ids, sims = np.take_along_axis(sorted_ids, top, 1), np.take_along_axis(sims, top, 1)
    ids[np.isneginf(sims)] = -1
    return ids, sims, np.take_along_axis(order, top, 1)


def _descending(sims: np.ndarray) -> np.ndarray:
    """32 bits whose order is that of falling values."""
    bits = np.ascontiguousarray(sims, np.float32).view(np.uint32)
    return np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF)).astype(np.int64)


def _padded(row: np.ndarray, most: int, *columns: np.ndarray) -> list[np.ndarray]:
    """The rows that occur in ``row``, which is sorted, and for each its first
    ``most`` values of the columns; empty places are -1, or minus infinity."""
    place = _rank(row)
    keep = place < most
    row, place = row[keep], place[keep]
    keys, at = np.unique(row, return_inverse=True)
    out = [keys]
    for column in columns:
        full = np.full((len(keys), most), -np.inf if column.dtype.kind == "f" else -1, column.dtype)
        full[at, place] = column[keep]
        out.append(full)
    return out


def _first_lists(x: np.ndarray, k: int, trees: int, rng: np.random.Generator):
    """Each node's best partners in its buckets of some trees."""
    n = len(x)
    near, sims = np.full((n, k), -1, np.int32), np.full((n, k), -np.inf, np.float32)
    for _ in range(trees if n > BUCKET else 1):
        ids, found = np.full((n, k), -1, np.int32), np.full((n, k), -np.inf, np.float32)
        for own in _leaves(x, rng):
            s = x[own] @ x[own].T
            np.fill_diagonal(s, -np.inf)
            top = _best(s, k)
            ids[own, : top.shape[1]], found[own, : top.shape[1]] = own[top], np.take_along_axis(s, top, 1)
        near, sims, _ = _merge(np.concatenate([near, ids], 1), np.concatenate([sims, found], 1), k)
    return near, sims


def _gathered(near: np.ndarray, fresh: np.ndarray, rng: np.random.Generator):
    """What meets at each node in a round, and which of it is new: up to ``2 k`` of
    its neighbours and of those that list it, new ones first, by chance.  Entries
    that take part at their own node are new no more."""
    n, k = near.shape
    u, v = np.repeat(np.arange(n, dtype=np.int32), k), near.ravel()
    edge = np.flatnonzero(v >= 0)
    new = fresh.ravel()[edge]
    at, with_ = np.concatenate([u[edge], v[edge]]), np.concatenate([v[edge], u[edge]])
    key = rng.integers(1 << 31, size=len(at)) | (at.astype(np.int64) << 32) | (~np.concatenate([new, new])).astype(np.int64) << 31
    order = np.argsort(key)
    place = _rank(at[order])
    order, place = order[place < 2 * k], place[place < 2 * k]
    member, is_new = np.full((n, 2 * k), -1, np.int32), np.zeros((n, 2 * k), bool)
    member[at[order], place], is_new[at[order], place] = with_[order], new[order % len(edge)]
    fresh.ravel()[edge[order[order < len(edge)]]] = False
    return member, is_new


def _descend(x: np.ndarray, near: np.ndarray, sims: np.ndarray, rounds: int, settled: float, rng: np.random.Generator, block: int = 128, step: int = 2048):
    """NN-descent: what gathers at a node is compared, and each of two that are
    closer than the worst on a list is told."""
    n, k = near.shape
    fresh = near >= 0
    pad = 2 * k
    for _ in range(rounds):
        member, is_new = _gathered(near, fresh, rng)
        centres = np.flatnonzero(is_new.any(axis=1))
        changed = 0
        for lo in range(0, len(centres), step):
            told, others, values = [], [], []
            worst = np.append(sims[:, -1], np.float32(np.inf))  # nobody tells empty places
            for a in range(lo, min(lo + step, len(centres)), block):
                m, new = member[centres[a : min(a + block, lo + step)]], is_new[centres[a : min(a + block, lo + step)]]
                points = x[m]
                s = points @ points.transpose(0, 2, 1)
                ok = s > worst[m][:, :, None]
                ok &= new[:, :, None] | new[:, None, :]
                f = np.flatnonzero(ok)
                flat = m.ravel()
                t, o = flat[f // pad], flat[f // (pad * pad) * pad + f % pad]
                good = (o >= 0) & (t != o)
                told.append(t[good]), others.append(o[good]), values.append(s.ravel()[f[good]])
            t, o, s = np.concatenate(told), np.concatenate(others), np.concatenate(values)
            key = (t.astype(np.int64) << 32) | _descending(s)
            order = np.argsort(key)
            key, t, o, s = key[order], t[order], o[order], s[order]
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (o[1:] != o[:-1])])[: len(key)]
            rows, ids, found = _padded(t[once], k, o[once], s[once])
            ids, found, was = _merge(np.concatenate([near[rows], ids], 1), np.concatenate([sims[rows], found], 1), k)
            added = (was >= k) & (ids >= 0)
            near[rows], sims[rows], fresh[rows] = ids, found, added | np.take_along_axis(fresh[rows], np.minimum(was, k - 1), 1) & (ids >= 0)
            changed += int(added.sum())
        if changed <= settled * k * n:
            break
    return near, sims


def _both_ways(near: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Searches go both ways along an edge: the ``2 k`` most similar of a node's
    neighbours and of those that list it."""
    n, k = near.shape
    u, v, s = np.repeat(np.arange(n), k).astype(np.int32), near.ravel(), sims.ravel()
    good = v >= 0
    order = np.argsort((v[good].astype(np.int64) << 32) | _descending(s[good]))
    rows, ids, found = _padded(v[good][order], 2 * k, u[good][order], s[good][order])
    wide, value = np.full((n, 3 * k), -1, np.int32), np.full((n, 3 * k), -np.inf, np.float32)
    wide[:, :k], value[:, :k] = near, sims
    wide[rows, k:], value[rows, k:] = ids, found
    return _merge(wide, value, 2 * k)[0]


def _block_count(spark: SparkSession, n: int) -> int:
    """Blocks of ``BLOCK`` nodes at most, and as many as keep all cores at work
    unless they had fewer than ``SMALL``."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    return max(1, -(-n // SMALL)) if n <= SMALL * cores else cores * -(-n // (BLOCK * cores))


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _graphs(dims: int, kind: str, lifted, k: int, trees: int, rounds: int, settled: float, seed: int):
    """The graph of each block; rows are sorted by block and node."""

    def made(block: int, keys: list, vecs: list) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(keys)
        packed = pa.chunked_array(vecs)
        x = lifted(np.concatenate([_flat(v, kind)[0] for v in vecs]))
        rng = np.random.default_rng([seed, block])
        near, sims = _first_lists(x, k, trees, rng)
        wide = _both_ways(*_descend(x, near, sims, rounds if len(ids) > BUCKET else 0, settled, rng))
        for a in range(0, len(ids), 10_000):
            part = wide[a : a + 10_000]
            near = _lists(ids[part[part >= 0]].astype("<i8"), (part >= 0).sum(axis=1))
            yield _frame(block=pa.array(np.full(len(part), block, np.int32)), node=pa.array(ids[a : a + 10_000]), vec=packed.slice(a, 10_000).combine_chunks(), near=near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        block, keys, vecs = None, [], []
        for batch in batches:
            own = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])).tolist() if len(own) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if own[a] != block:
                    if keys:
                        yield from made(block, keys, vecs)
                    block, keys, vecs = int(own[a]), [], []
                keys.append(batch.column(1).slice(a, b - a).to_numpy().copy()), vecs.append(batch.column(2).slice(a, b - a))
        if keys:
            yield from made(block, keys, vecs)
        trim()

    return run



def build(rows: DataFrame, *, neighbours: int = 40, rounds: int = 30, settled: float = 0.01, trees: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 21, seed: int = 7) -> Index:
    """The neighbour graphs of all vectors that take part.

    A block's rounds end when no more than the share ``settled`` of its lists'
    entries is new (or after ``rounds``).  Rows that repeat an id with another vector
    are candidates of their own; repeated rows count once; see :func:`valid_vectors`
    for nulls.  An empty table gives an empty index.
    ``keep``: ids kept of equal vectors, the smallest; a search for ``keep - 1``
    results needs no more.
    """
    spark, k = rows.sparkSession, neighbours
    vectors, dims, kind = valid_vectors(rows, id_col, vector_col)
    vectors, vectors_path = materialize(vectors, "vectors")
    lows = vectors.groupBy("vec").agg(F.min("vec_id").alias("low"))
    # An id that is the smallest of two vectors can't name both.
    shared = lows.groupBy("low").count().where("count > 1").select("low", F.lit(True).alias("shared"))
    named = lows.join(shared, "low", "left").select(F.when(F.col("shared"), F.xxhash64("vec")).otherwise(F.col("low")).alias("node"), "vec")
    nodes, nodes_path = materialize(named, "nodes")
    n = nodes.count()
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    firsts = vectors.select("vec_id", "vec").distinct().withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= keep)
    members, _ = materialize(firsts.join(nodes, "vec").select("node", "vec_id"), "members")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _flat(batch.column(0), kind)[0].reshape(-1, dims).astype(np.float64)
            yield _frame(norm=pa.array(np.sqrt((x**2).sum(axis=1).max(keepdims=True))) if len(x) else pa.array([], pa.float64()))

    largest = nodes.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0] or 1.0

    def lifted(flat: np.ndarray) -> np.ndarray:
        x = flat.reshape(-1, dims).astype(np.float64) / largest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))[:, None]], axis=1).astype(np.float32)

    blocks = _block_count(spark, n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _frame(block=pa.array(block_of(batch.column(0).to_numpy(), blocks).astype(np.int32)), node=batch.column(0), vec=batch.column(1))

    dealt = nodes.mapInArrow(place, "block int, node long, vec binary").repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "node")
    ready, _ = materialize(dealt.mapInArrow(_graphs(dims, kind, lifted, k, trees, rounds, settled, seed), "block int, node long, vec binary, near binary"), "index")
    release(spark, vectors_path, nodes_path)
    return Index(ready, members, dims, kind, n, blocks)


# Search --------------------------------------------------------------------------

#: A row for a block: a node (kind 0), or queries (kind 1), their ids and vectors packed.
_ASK = "block int, kind int, id long, vec binary, ids binary"
_FOUND = "id long, nodes binary, scores binary"


class _Block:
    """Vectors and graph of a block's nodes, which are in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, near: np.ndarray, counts: np.ndarray):
        self.ids, self.x = ids, x
        scale = np.abs(x).max()
        self.points = (x / scale).astype(np.float32)
        self.near = np.full((len(ids), max(1, int(counts.max(initial=0)))), -1, np.int32)
        self.near[np.repeat(np.arange(len(ids)), counts), np.arange(len(near)) - np.repeat(np.cumsum(counts) - counts, counts)] = np.searchsorted(ids, near)
        self.seeds = np.random.default_rng(len(ids)).permutation(len(ids))[: min(SEEDS, max(256, len(ids) // 16))].astype(np.int32)
        self._met = np.zeros((TOGETHER, len(ids)), np.int32)

    def pools(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Each query's nearest found, ``width`` at most; empty places are -1."""
        n, m = len(queries), len(self.ids)
        q = (queries / np.abs(queries).max(axis=1, keepdims=True)).astype(np.float32)
        met, at = self._met[:n], np.arange(n)[:, None]
        met[:] = 0
        met[:, self.seeds] = 1
        sims = q @ self.points[self.seeds].T
        top = _best(sims, width)
        ids, sims = self.seeds[top], np.take_along_axis(sims, top, 1)
        is_open, turn = np.ones(ids.shape, bool), 1
        flat = met.ravel()
        while is_open.any():
            # The best open nodes of each query, which close, and their neighbours.
            pick = _best(np.where(is_open, sims, -np.inf), EXPAND)
            chosen = np.take_along_axis(is_open, pick, 1)
            np.put_along_axis(is_open, pick, False, 1)
            near = np.where(chosen[:, :, None], self.near[np.take_along_axis(ids, pick, 1)], -1).reshape(n, -1)
            row, col = np.nonzero(near >= 0)
            other = near[row, col]
            place = row * m + other
            new = flat[place] == 0
            row, other, place = row[new], other[new], place[new]
            number = np.arange(turn, turn + len(place), dtype=np.int32)
            flat[place] = number  # of those that name one node the last stays
            once = flat[place] == number
            row, other, turn = row[once], other[once], turn + len(place)
            if not len(row):
                continue
            score = np.einsum("ij,ij->i", self.points[other], q[row])
            if ids.shape[1] >= width:
                good = score > sims.min(axis=1)[row]
                row, other, score = row[good], other[good], score[good]
            if not len(row):
                continue
            counts = np.bincount(row, minlength=n)
            more = int(counts.max())
            wide_ids, wide, opened = np.full((n, more), -1, np.int32), np.full((n, more), -np.inf, np.float32), np.zeros((n, more), bool)
            spot = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            wide_ids[row, spot], wide[row, spot], opened[row, spot] = other, score, True
            ids, sims, is_open = np.concatenate([ids, wide_ids], 1), np.concatenate([sims, wide], 1), np.concatenate([is_open, opened], 1)
            top = _best(sims, width)
            ids, sims, is_open = ids[at, top], sims[at, top], is_open[at, top]
        return ids

    def nearest(self, queries: np.ndarray, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query nodes and scores in double precision: the ``most`` best
        of its pool, and those that tie with the last."""
        for a in range(0, len(queries), TOGETHER):
            asked = queries[a : a + TOGETHER]
            for q, own in zip(asked, self.pools(asked, width)):
                own = own[own >= 0]
                scores = self.x[own].astype(np.float64) @ q
                yield _top(self.ids[own], scores, most)


def _top(nodes: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` best, and those that tie with the last."""
    if len(scores) > most:
        keep = scores >= np.partition(scores, len(scores) - most)[len(scores) - most]
        nodes, scores = nodes[keep], scores[keep]
    return nodes, scores


def _answers(dims: int, kind: str, width: int, most: int):
    """Searches in blocks; rows are sorted by block and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        number, parts, block = None, [], None
        for batch in batches:
            out: list[tuple] = []
            kinds, numbers = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1]), [True]])).tolist() if len(kinds) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if numbers[a] != number:
                    number, parts, block = int(numbers[a]), [], None
                if not kinds[a]:
                    part = batch.slice(a, b - a)
                    near, counts = _flat(part.column(4), "<i8")
                    parts.append((part.column(2).to_numpy().copy(), _flat(part.column(3), kind)[0].reshape(-1, dims), near, counts))
                    continue
                if not parts:  # a block without nodes
                    continue
                if block is None:
                    ids, x, near, counts = (np.concatenate(c) for c in zip(*parts))
                    block, parts = _Block(ids, x, near, counts), parts[:1]
                for vecs, ids in zip(batch.column(3).slice(a, b - a).to_pylist(), batch.column(4).slice(a, b - a).to_pylist()):
                    asked = np.frombuffer(vecs, kind).reshape(-1, dims).astype(np.float64)
                    for key, (nodes, scores) in zip(np.frombuffer(ids, "<i8").tolist(), block.nearest(asked, width, most)):
                        out.append((key, nodes.tobytes(), scores.tobytes()))
                    if len(out) >= 10_000:
                        yield _rows(out)
                        out = []
            if out:
                yield _rows(out)
        block = None
        trim()

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    ids, nodes, scores = zip(*out)
    return _frame(id=pa.array(ids, pa.int64()), nodes=pa.array(nodes, pa.binary()), scores=pa.array(scores, pa.binary()))


def _united(most: int):
    """The best of all blocks; rows are sorted by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, scores = None, [], []
        out: list[tuple] = []

        def close() -> None:
            if nodes:
                best = _top(np.frombuffer(b"".join(nodes), "<i8"), np.frombuffer(b"".join(scores), "<f8"), most)
                out.append((np.full(len(best[0]), key), *best))

        def flush() -> pa.RecordBatch:
            ids, found, values = (np.concatenate(c) for c in zip(*out))
            return _frame(id=pa.array(ids), node=pa.array(found), score=pa.array(values))

        for batch in batches:
            for i, n, s in zip(*(c.to_pylist() for c in batch.columns)):
                if i != key:
                    close()
                    key, nodes, scores = i, [], []
                    if len(out) >= 2000:
                        yield flush()
                        out.clear()
                nodes.append(n), scores.append(s)
        close()
        if out:
            yield flush()

    return run


def search(index: Index, queries: DataFrame, *, k: int = 20, width: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: up to ``k`` nearest found.

    The row of the index with a query's own id is no result.  Ties go to smaller
    ids.  Queries that can't take part (see :func:`valid_vectors`; another length
    than the index's counts too) have no result.  Queries that repeat an id and
    vector count once.  ``width`` bounds the places of a query's pools in all blocks
    together, of which each has ``6 k`` at least, not what it may visit.
    """
    spark: SparkSession = queries.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if not index.n:
        return spark.createDataFrame([], schema)
    asked, dims, kind = valid_vectors(queries, id_col, vector_col, index.dims)
    asked, _ = materialize(asked.distinct().withColumnRenamed("vec_id", "query_id"), "queries")
    if kind != index.kind:
        raise ValueError("queries and index have components of different types")
    blocks, each = index.blocks, max(6 * k, -(-width // index.blocks))

    # One search for each distinct vector, known by its smallest query.
    distinct, _ = materialize(asked.groupBy("vec").agg(F.min("query_id").alias("id")), "distinct-queries")
    parts = _partitions(spark, distinct.count(), 256)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2 * TOGETHER):
                part = batch.slice(a, 2 * TOGETHER)
                yield _frame(vec=pa.array([b"".join(part.column(0).to_pylist())], pa.binary()), ids=pa.array([part.column(1).to_numpy().tobytes()], pa.binary()))

    packed = distinct.select("vec", "id").mapInArrow(pack, "vec binary, ids binary")
    asks = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), "vec", "ids")
    held = index.nodes.select("block", F.lit(0).alias("kind"), F.col("node").alias("id"), "vec", F.col("near").alias("ids"))
    rows = held.union(asks).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "id")
    answers, answers_path = materialize(rows.mapInArrow(_answers(dims, kind, each, k + 1), _FOUND), "answers")
    found, _ = materialize(_deal(answers, parts, "id").mapInArrow(_united(k + 1), "id long, node long, score double"), "found")
    release(spark, answers_path)
    best = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    found = found.join(index.members, "node").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("list"))
    mine = asked.join(distinct, "vec").select("query_id", "id").join(lists, "id")
    kept = mine.select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return kept.select("query_id", F.posexplode("list").alias("at", "one")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
