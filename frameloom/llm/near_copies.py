"""Near copies by SimHash: texts whose word shingles have a Jaccard similarity of
0.8 or more.

Texts with equal sets of shingles make one node.  A node's fingerprint has several
pieces of some bits and 128 bits more to check candidates; each bit is the
majority of one bit of the shingles' mixed hashes, as in :mod:`simhash`.  Two sets
of one size with similarity ``s`` differ in a bit with a probability of
``acos(2 s / (1 + s)) / pi``, 0.15 at 0.8.  Each piece has covering masks, so that
all pairs that differ in at most ``radius`` bits of some piece meet in a table; the
pieces are as many as leave a pair at the threshold within the radius of none with
a probability of ``MISS`` at most.  :func:`plan` has the numbers: pieces are wide
enough for buckets of about ``FILL`` unrelated nodes, and the radius is the one
that needs the fewest tables.

Pairs that meet within the radius, and whose check bits are near too, are
candidates.  Those whose sizes and whole fingerprints are near as well are verified
by their shingles.  Nodes with many candidates in a bucket, such as those of a large
group of near copies, are crowded there: of pairs of two crowded nodes only those
with a node's nearest partner in a bucket, and of all these its nearest ones, are
verified so.  Buckets with
crowded nodes that verified links haven't all connected are then gone through with
their nodes' shingles at hand: two nodes of different components are compared until
nothing more can be connected there.  No bucket is cut, and what leaves a bucket
are links that connect, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_partitions, forget, materialize, release, trim
from .components import connected_components
from .simhash import covering_masks, shingle_hashes
from .words import mix

#: Unrelated nodes of a bucket, about, and the share of pairs at the threshold that
#: no table brings together.
FILL, MISS = 256, 0.005
#: Candidates of a node in a bucket beyond which it is crowded; how many of a crowded
#: node's nearest partners leave a bucket, and how many of those are verified at first;
#: buckets whose members are first compared with the smallest ones alone.
FEW, PIVOTS, NEAREST, LARGE = 8, 1, 4, 20_000
#: Nodes of a group of buckets, about.
_GROUP = 1 << 16


@dataclass(frozen=True)
class Plan:
    width: int  # bits of a piece
    radius: int
    pieces: int
    check: int  # of the 128 check bits, how many may differ
    far: int  # of all bits, how many may

    @property
    def masks(self) -> list[int]:
        return covering_masks((1 << self.width) - 1, self.radius)

    @property
    def words(self) -> int:
        return _words(self.width, self.pieces)


def _words(width: int, pieces: int) -> int:
    return -(-width * pieces // 64) + 2


def _at_most(k: int, n: int, p: float) -> float:
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, sum(math.exp(log(i)) for i in range(k + 1)))


def plan(nodes: int, threshold: float) -> Plan:
    """Widths for ``nodes`` nodes: a mask keeps about half of a piece's bits."""
    width = min(64, max(16, 2 * math.ceil(math.log2(max(2, nodes) / FILL))))
    differ = math.acos(2 * threshold / (1 + threshold)) / math.pi
    near = lambda n: next(k for k in range(n + 1) if 1 - _at_most(k, n, differ) < MISS / 10)
    best = None
    for radius in range(1, 8):
        miss = 1 - _at_most(radius, width, differ)
        pieces = max(1, math.ceil(math.log(MISS) / math.log(miss))) if miss else 1
        tables = pieces * ((2 << radius) - 1)
        if best is None or tables < best[0]:
            best = tables, radius, pieces
    return Plan(width, best[1], best[2], near(128), near(64 * _words(width, best[2])))


def wide_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """``words`` words of 64 bits, each set in over half of the shingles' hashes."""
    n = len(shingles)
    counts = np.zeros(64 * words, np.int64)
    salt = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for at in range(0, n, 255):  # sums of 255 bits fit a byte
        some = mix(shingles[at : at + 255, None] ^ salt)
        counts += np.unpackbits(some.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")


def _signed(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget()
        for batch in batches:
            node, size, bits = [], [], []
            for x in batch.column(2).cast(pa.binary()):
                own = shingle_hashes(x.as_py(), shingle)
                node.append(xxhash.xxh3_64_intdigest(own.tobytes())), size.append(len(own)), bits.append(wide_fingerprint(own, words).tobytes())
            arrays = [batch.column(0), batch.column(1), pa.array(np.asarray(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "node", "size", "bits"])

    return docs.mapInArrow(run, "doc_id long, text_key long, node long, size int, bits binary")


#: A node in a bucket.
_ENTRY = np.dtype([("piece", "<u8"), ("check", "<u8", 2), ("node", "<i8")])
_SMALL_ENTRY = np.dtype([("piece", "<u4"), ("check", "<u8", 2), ("node", "<i8")])


def _pieces(bits: np.ndarray, plan: Plan) -> Iterator[np.ndarray]:
    """Each piece of the fingerprints (rows of words) as a number."""
    flat = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
    for p in range(plan.pieces):
        own = np.zeros((len(bits), 64), np.uint8)
        own[:, : plan.width] = flat[:, p * plan.width : (p + 1) * plan.width]
        yield np.packbits(own, axis=1, bitorder="little").view("<u8").ravel()


def _spread(plan: Plan, groups: int):
    """Entries of some nodes by group: a table and a share of its keys."""
    kind = _SMALL_ENTRY if plan.width <= 32 else _ENTRY
    masks = np.asarray(plan.masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            node = batch.column(0).to_numpy()
            bits = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, plan.words)
            entry = np.zeros(len(node), kind)
            entry["node"], entry["check"] = node, bits[:, -2:]
            for p, piece in enumerate(_pieces(bits, plan)):
                entry["piece"] = piece
                for m, mask in enumerate(masks):
                    to = (mix((piece & mask) + np.uint64(1)) % np.uint64(groups)).astype(np.int64) if groups > 1 else np.zeros(len(node), np.int64)
                    order = np.argsort(to, kind="stable")
                    cuts = np.flatnonzero(np.diff(to[order], prepend=-1)).tolist()
                    dealt = entry[order]
                    parts = [dealt[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(node)])]
                    first = (p * len(masks) + m) * groups
                    yield pa.RecordBatch.from_arrays([pa.array(to[order][cuts] + first), pa.array(parts, pa.binary())], names=["group", "entries"])

    return run


_FOUND = "bucket long, a long, b long, piece long, check long, also long, far int"


def _found(bucket, a, b, piece=None, check=None, far=None) -> pa.RecordBatch:
    n = len(a)
    rows = [pa.array(np.broadcast_to(np.asarray(bucket, np.int64), n)), pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b)]
    bits = (None, None, None) if piece is None else (piece, check[:, 0], check[:, 1])
    rows += [pa.nulls(n, pa.int64()) if x is None else pa.array(x.astype(np.uint64).view(np.int64)) for x in bits]
    rows.append(pa.nulls(n, pa.int32()) if far is None else pa.array(far, pa.int32()))
    return pa.RecordBatch.from_arrays(rows, names=["bucket", "a", "b", "piece", "check", "also", "far"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that rows of words differ in."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _bucket_pairs(plan: Plan, edges: np.ndarray, piece: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates: pairs of places in one bucket.  Members of a large bucket are
    compared with its first ones alone."""
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        ok = np.bitwise_count(piece[i] ^ piece[j]) <= plan.radius
        i, j = i[ok], j[ok]
        ok = _apart(check[i], check[j]) <= plan.check
        firsts.append(i[ok]), seconds.append(j[ok])

    sizes = np.diff(edges)
    for s in np.unique(sizes[(sizes > 1) & (sizes <= 1024)]).tolist():  # all buckets of one size at a time
        start = edges[:-1][sizes == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, (1 << 18) // len(i))
        for at in range(0, len(start), step):
            own = start[at : at + step, None]
            keep((own + i).ravel(), (own + j).ravel())
    for g in np.flatnonzero(sizes > 1024).tolist():
        lo, hi = int(edges[g]), int(edges[g + 1])
        for i in range(lo, min(hi, lo + FEW) if hi - lo > LARGE else hi):
            j = np.arange(i + 1, hi)
            keep(np.full(len(j), i), j)
    return np.concatenate(firsts), np.concatenate(seconds)


def _candidates(plan: Plan, groups: int):
    """Candidate pairs, those of two crowded nodes with the check bits that they
    differ in (``far``), and (without ``b``) the crowded members of buckets; rows are
    sorted by group."""
    kind = _SMALL_ENTRY if plan.width <= 32 else _ENTRY
    masks = plan.masks

    def solve(group: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        entry = np.frombuffer(b"".join(parts), kind)
        table = group // groups
        key = entry["piece"].astype(np.uint64) & np.uint64(masks[table % len(masks)])
        order = np.lexsort((entry["node"], key))
        entry, key = entry[order], key[order]
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        node, piece, check = entry["node"], entry["piece"].astype(np.uint64), entry["check"]
        i, j = _bucket_pairs(plan, edges, piece, check)
        degree = np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
        at = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        large = (np.diff(edges) > LARGE)[at]
        crowded = (degree > FEW) | large
        both = crowded[i] & crowded[j]
        if both.any() or large.any():
            # Of two crowded ones' pairs, those with each one's nearest partners.
            keep = np.zeros(len(i), bool)
            pair = np.flatnonzero(both)
            near = _apart(check[i[pair]], check[j[pair]])
            for one, other in ((i[pair], j[pair]), (j[pair], i[pair])):
                rank = np.lexsort((other, near, one))
                o = one[rank]
                head = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])[: len(o)])
                place = np.arange(len(o)) - np.repeat(head, np.diff(np.concatenate([head, [len(o)]])))
                keep[pair[rank[place < PIVOTS]]] = True
            x, y = node[i[keep]], node[j[keep]]
            yield _found(0, np.minimum(x, y), np.maximum(x, y), far=_apart(check[i[keep]], check[j[keep]]))
            i, j = i[~both], j[~both]
            rest = np.flatnonzero(crowded)
            bucket = mix(key[rest] ^ mix(np.full(len(rest), table + 1, np.uint64))).view(np.int64)
            yield _found(bucket, node[rest], None, piece[rest], check[rest])
        pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
        yield _found(0, pairs[0], pairs[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        group, parts = None, []
        for batch in batches:
            for g, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != group:
                    if parts:
                        yield from solve(group, parts)
                    group, parts = g, []
                parts.append(e)
        if parts:
            yield from solve(group, parts)
        trim()

    return run


class _Roots(dict):
    """Components as far as known in a bucket."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            x = up
        return x


def _similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets are similar to which: exact, by one product of their incidence."""
    words, place = np.unique(np.concatenate(left), return_inverse=True)
    sizes = [np.asarray([len(x) for x in side]) for side in (left, right)]
    holds = [np.zeros((len(side), len(words)), np.float32) for side in (left, right)]
    holds[0][np.repeat(np.arange(len(left)), sizes[0]), place] = 1
    flat, row = np.concatenate(right), np.repeat(np.arange(len(right)), sizes[1])
    at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
    known = words[at] == flat
    holds[1][row[known], at[known]] = 1
    both = (holds[0] @ holds[1].T).astype(np.float64)
    return both / (sizes[0][:, None] + sizes[1] - both) >= threshold


def _crossing(plan: Plan, threshold: float, block: int = 256):
    """Links between a bucket's members in different components.  Rows are sorted
    by bucket, and those outside the bucket's commonest component come first: they
    are held with their shingles, the others pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        bucket, roots = None, _Roots()
        held: list[tuple] = []  # node, root, piece, check bits and shingles of each

        def link(rows: list[tuple], links: list[tuple[int, int]]) -> None:
            for lo in range(0, len(held), block):
                some = [h for h in held[lo : lo + block] if any(roots.find(h[1]) != roots.find(r) for r in {x[1] for x in rows})]
                if not some:
                    continue
                piece, check = np.asarray([h[2] for h in some]), np.stack([h[3] for h in some])
                near = np.bitwise_count(piece[:, None] ^ np.asarray([r[2] for r in rows])) <= plan.radius
                near &= _apart(check[:, None, :], np.stack([r[3] for r in rows])) <= plan.check
                left, right = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(left):
                    continue
                for i, j in np.argwhere(_similar([some[i][4] for i in left], [rows[j][4] for j in right], threshold)):
                    one, other = some[left[i]], rows[right[j]]
                    x, y = roots.find(one[1]), roots.find(other[1])
                    if x != y:
                        roots[x] = y
                        links.append((one[0], other[0]))

        for batch in batches:
            keys, main, node, root, piece = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            piece = piece.view(np.uint64)
            check = np.stack([batch.column(i).to_numpy() for i in (5, 6)], axis=1).view(np.uint64)
            offsets, flat = batch.column(7).offsets.to_numpy(), batch.column(7).values.to_numpy()
            links: list[tuple[int, int]] = []
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (main[1:] != main[:-1])])[: len(keys)]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[a] != bucket:
                    bucket, held, roots = int(keys[a]), [], _Roots()
                for lo in range(a, b, block):
                    rows = [(int(node[i]), int(root[i]), piece[i], check[i], flat[offsets[i] : offsets[i + 1]].copy()) for i in range(lo, min(b, lo + block))]
                    if not main[a]:
                        held += rows
                    link(rows, links)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    return run


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node`` and ``shingles`` of the nodes that ``wanted`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_hashes(x.as_py(), shingle).view(np.int64) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "shingles"])

    picked = wanted.distinct().join(nodes, "node").select("node", "pick.doc_id", "pick.text_key")
    rows = docs.join(picked, docs["doc_id"].eqNullSafe(picked["doc_id"]) & docs["text_key"].eqNullSafe(picked["text_key"])).select("node", "text")
    # Rows that repeat id and text have one set.
    return materialize(rows.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")[0]


def _first(made: DataFrame) -> DataFrame:
    """Of the candidate pairs those that are verified one by one."""
    pairs = made.where("b IS NOT NULL")
    crowded = pairs.where("far IS NOT NULL").select("a", "b", "far").distinct()
    ends = crowded.select(F.col("a").alias("node"), "a", "b", "far", F.col("b").alias("other"))
    ends = ends.union(crowded.select(F.col("b").alias("node"), "a", "b", "far", F.col("a").alias("other")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("far", "other"))
    nearest = ends.withColumn("rank", rank).where(F.col("rank") <= NEAREST)
    return pairs.where("far IS NULL").select("a", "b").union(nearest.select("a", "b")).distinct()


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float, shingle: int, plan: Plan) -> DataFrame:
    """Links ``a``, ``b``: the pairs that are similar enough by their shingles.

    Pairs of sizes or whole fingerprints too far apart aren't looked up; the bits
    of sets of less than 64 shingles vary too much to tell.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(batch.num_rows, -1) for i in (2, 4))
            m, n = (batch.column(i).to_numpy() for i in (3, 5))
            low, high = np.minimum(m, n), np.maximum(m, n)
            ok = (low >= threshold * high - 1e-9) & ((low < 64) | (_apart(x, y) <= plan.far))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    own = nodes.select("node", "bits", "size")
    both = pairs.join(own.toDF("a", "x", "m"), "a").join(own.toDF("b", "y", "n"), "b")
    pairs, _ = materialize(both.select("a", "b", "x", "m", "y", "n").mapInArrow(near, "a long, b long"), "candidates")
    held = _sets(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), shingle)
    left = held.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = held.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    similar = pairs.join(left, "a").join(right, "b").where(both / (F.size("x") + F.size("y") - both) >= threshold)
    return materialize(similar.select("a", "b"), "similar")[0]


def near_copies(docs: DataFrame, *, threshold: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``component_id`` (the smallest id that links reach) per row.

    Null, empty and blank texts, which have no words, are copies of one another;
    texts shorter than a shingle have one, of all their words.  Rows that repeat an
    id are rows of their own; a null id is no candidate for the smallest, and a
    component of null ids alone has a null ``component_id``.  An empty table gives
    no row; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    chosen = plan(rows.count(), threshold)
    signed, _ = materialize(_signed(rows, shingle, chosen.words), "signatures")
    pick = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("pick")
    nodes, _ = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("low"), pick, F.first("size").alias("size"), F.first("bits").alias("bits")), "nodes")
    filled = nodes.where("size > 0")  # texts without words have no near copies but themselves
    count = filled.count()
    groups = max(1, -(-count // _GROUP))
    n = byte_partitions(spark, count * 28 * chosen.pieces * len(chosen.masks))
    spread = filled.select("node", "bits").mapInArrow(_spread(chosen, groups), "group long, entries binary")
    dealt = spread.repartitionById(n, F.pmod(F.xxhash64("group"), F.lit(n)).cast("int")).sortWithinPartitions("group")
    made, made_path = materialize(dealt.mapInArrow(_candidates(chosen, groups), _FOUND), "buckets")
    links = _verified(rows, nodes, _first(made), threshold, shingle, chosen)
    roots = connected_components(links)
    crowded = made.where("b IS NULL").select("bucket", F.col("a").alias("node"), "piece", "check", "also")
    if not crowded.isEmpty():
        crowded = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = crowded.groupBy("bucket", "root").count()
        torn = sizes.groupBy("bucket").agg(F.max_by("root", "count").alias("commonest"), F.count("*").alias("roots")).where("roots > 1").select("bucket", "commonest")
        rest = crowded.join(torn, "bucket").select("bucket", (F.col("root") == F.col("commonest")).alias("main"), "node", "root", "piece", "check", "also")
        rest = rest.join(_sets(rows, nodes, rest.select("node"), shingle), "node").select("bucket", "main", "node", "root", "piece", "check", "also", "shingles")
        ordered = rest.repartition(n, "bucket").sortWithinPartitions("bucket", "main")
        more, _ = materialize(ordered.mapInArrow(_crossing(chosen, threshold), "a long, b long"), "crossing-links")
        roots = connected_components(links.union(more))
    release(spark, made_path)
    rooted = nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_node, _ = materialize(rooted.join(lows, "root").select("node", "component_id"), "components")
    return signed.join(of_node, "node").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose id is the smallest of its
    component by :func:`near_copies`.  Rows without an id are no copies of others'
    and stay; rows that repeat an id share its fate."""
    found = near_copies(docs, id_col=id_col, **options)
    copies, _ = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__copy")).distinct(), "copies")
    return docs.join(copies, docs[id_col] == copies["__copy"], "left_anti")
