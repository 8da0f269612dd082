"""SimHash fingerprints, linked through covering locality-sensitive hashing.

For radius ``r`` every bit position gets a non-zero vector of ``r + 1`` bits.
Each of the ``2^(r+1) - 1`` non-zero vectors ``v`` makes a mask: the positions
whose vector has an odd inner product with ``v``.  Two fingerprints that differ
in at most ``r`` positions leave some ``v`` orthogonal to all of these, and
agree under that mask: every pair within the radius meets in some table.

Only distinct fingerprints enter the tables, so copies never fill a bucket.  A
bucket with more than ``BUCKET`` fingerprints isn't compared: its members,
equal under its mask, go through another round of masks over the free bits.
Each mask takes up some free bits, about half of them, and ``b`` free bits hold
at most ``2^b`` distinct fingerprints, so the rounds end and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, shuffle_partitions
from .components import connected_components

#: Fingerprints that one bucket compares with one another.
BUCKET = 1024
_ALL = (1 << 64) - 1


def words_of(raw: bytes) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return raw.lower().split()


def _hashes(raw: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, or of all words if they are fewer."""
    import xxhash

    words = words_of(raw or b"")
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.asarray([hash64(text, seed)], dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(text)]
    return np.fromiter((hash64(text[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1)


def shingle_hashes(raw: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    return np.unique(_hashes(raw, shingle, seed))


def fingerprint(raw: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 values."""
    hashes = _hashes(raw, shingle, seed)
    if not len(hashes):
        return 0
    n = len(hashes)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255  # sums of 255 bits fit a byte
    counts = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) for each row.

    Null, empty and blank texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the positions set in ``free``; together they cover ``radius``."""
    vectors = (1 << (radius + 1)) - 1
    places = [i for i in range(64) if free >> i & 1]
    basis = [1 << i for i in range(radius + 1)]
    order = basis + [v for v in range(1, vectors + 1) if v not in basis]
    given = {p: order[i % vectors] for i, p in enumerate(places)}
    return [sum(1 << p for p in places if (given[p] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what chains of pairs within ``radius`` connect."""
    out, left = [], np.ones(len(fps), dtype=bool)
    while left.any():
        todo = [int(np.flatnonzero(left)[0])]
        left[todo[0]] = False
        while todo:
            i = todo.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= radius]
            left[near] = False
            out.extend((int(fps[i]), int(fps[j])) for j in near)
            todo.extend(near.tolist())
    return out


def _compare_buckets(radius: int):
    """Links of buckets that fit; members of larger ones go on with their mask.

    The input is sorted by mask and key.  Memory: one batch and one bucket.
    """

    def split(mask: np.ndarray, fp: np.ndarray, last: bool):
        key = mask & fp
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        edges = np.concatenate([[0], cuts, [len(fp)]])
        if not last:
            edges = edges[:-1]
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b, mask):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.uint64).view(np.int64)) for x in (a, b, mask)], names=["a", "b", "mask"])

        held_mask, held_fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        over = None  # (mask, key) of a bucket that has already overflowed

        def work(mask, fp, last):
            nonlocal over
            a, b, m = [], [], []
            edges = split(mask, fp, last)
            sizes = np.diff(edges)
            heads = edges[:-1]
            again = np.zeros(len(heads), bool) if over is None else (mask[heads] == np.uint64(over[0])) & ((mask & fp)[heads] == np.uint64(over[1]))
            pairs = np.flatnonzero((sizes == 2) & ~again)
            near = edges[pairs]
            ok = np.bitwise_count(fp[near] ^ fp[near + 1]) <= radius
            a.append(fp[near[ok]]), b.append(fp[near[ok] + 1]), m.append(np.zeros(int(ok.sum()), np.uint64))
            for g in np.flatnonzero((sizes > 2) | again):
                lo, hi = int(edges[g]), int(edges[g + 1])
                group = np.unique(fp[lo:hi])
                if again[g] or len(group) > BUCKET:
                    a.append(group), b.append(group), m.append(np.full(len(group), mask[lo]))
                elif len(group) > 1:
                    found = np.asarray(_spanning_links(group, radius), dtype=np.uint64).reshape(-1, 2)
                    a.append(found[:, 0]), b.append(found[:, 1]), m.append(np.zeros(len(found), np.uint64))
            rest = 0 if last else int(edges[-1])
            tail = (mask[rest:], fp[rest:]) if not last else (mask[:0], fp[:0])
            if len(tail[1]) > BUCKET and len(np.unique(tail[1])) > BUCKET:
                over = (int(tail[0][0]), int(tail[0][0] & tail[1][0]))
                a.append(tail[1]), b.append(tail[1]), m.append(tail[0])
                tail = (mask[:0], fp[:0])
            return rows(np.concatenate(a), np.concatenate(b), np.concatenate(m)), tail

        for batch in batches:
            mask, fp = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            made, (held_mask, held_fp) = work(np.concatenate([held_mask, mask]), np.concatenate([held_fp, fp]), False)
            if made.num_rows:
                yield made
        if len(held_fp):
            made, _ = work(held_mask, held_fp, True)
            if made.num_rows:
                yield made

    return run


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a``, ``b`` that connect all of ``fp`` within ``radius``.

    ``distinct`` has one long column ``fp`` without repeats.
    """
    spark, n = distinct.sparkSession, shuffle_partitions(distinct.sparkSession)
    todo, found = distinct.select(F.lit(0).cast("long").alias("parent"), "fp"), None

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            parent, fp = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            for p in np.unique(parent).tolist():
                if p not in known:
                    known[p] = np.asarray([p | m for m in covering_masks(_ALL & ~p, radius)], dtype=np.uint64)
                own = fp[parent == p]
                mask, rep = np.repeat(known[p], len(own)), np.tile(own, len(known[p]))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (mask, rep)], names=["mask", "fp"])

    while True:
        key = F.col("mask").bitwiseAND(F.col("fp"))
        dealt = todo.mapInArrow(expand, "mask long, fp long").repartition(n, "mask", key).sortWithinPartitions("mask", key)
        made, _ = materialize(dealt.mapInArrow(_compare_buckets(radius), "a long, b long, mask long"), "buckets")
        links = made.where("mask = 0").select("a", "b")
        found = links if found is None else found.union(links)
        more = made.where("mask <> 0").select(F.col("mask").alias("parent"), F.col("a").alias("fp")).distinct()
        if more.isEmpty():
            return found
        todo = more


def near_duplicates(docs: DataFrame, *, radius: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` per row.

    Rows within ``radius`` bits are linked; ``component_id`` is the smallest id
    that links reach.  Rows with null, empty or blank text share fingerprint
    zero and are linked like any other.  Rows that repeat an id are rows of
    their own.  A null id is no candidate for the smallest; a component of null
    ids alone has a null ``component_id``.  An empty table gives no row; other
    columns are ignored.
    """
    fps, _ = materialize(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col), "fingerprints")
    nodes, _ = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = connected_components(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp, _ = materialize(rooted.join(lows, "root").select("fp", "component_id"), "components")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose id is the smallest of its
    component.  Rows without an id are no copies of others' and stay; rows that
    repeat an id share its fate."""
    found = near_duplicates(docs, id_col=id_col, **options)
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__copy")).distinct()
    copies, _ = materialize(copies, "copies")
    return docs.join(copies, docs[id_col] == copies["__copy"], "left_anti")
