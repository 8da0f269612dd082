"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

A document is cut into full windows, which need no company, and a rest.  Rests
are cut to at most ``max_piece`` ids and gathered, as the stream of a partition
brings them, into blocks of about ``block_windows`` windows.  In a block every
piece starts as a partial partition with one filled window.  The two partial
partitions with the largest imbalance are merged again and again, the fullest
windows of one onto the emptiest of the other, until one is left; its windows
are nearly equal.  If the fullest exceeds the capacity, the number of windows
rises by one and the block is packed anew.  No row moves between partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import id_dtype, worker_bpe


def differencing(lengths: np.ndarray, k: int) -> list[list[int]]:
    """Indices of ``lengths`` dealt to ``k`` windows of nearly equal sums."""
    if k == 1:
        return [list(range(len(lengths)))]
    # A node is an item (below n) or a pair of nodes that share a window.
    n, pairs = len(lengths), []
    heap = [(-int(x), i, np.asarray([x]), np.asarray([i])) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        p, q = len(a), len(b)
        both = max(0, p + q - k)
        # a's window i meets b's window k-1-i; both are in descending order.
        sums, nodes = np.concatenate([a[: p - both], b[: q - both]]), np.concatenate([na[: p - both], nb[: q - both]])
        if both:
            made = np.arange(n + len(pairs), n + len(pairs) + both)
            pairs.extend(zip(na[p - both :].tolist(), nb[q - both :][::-1].tolist()))
            sums = np.concatenate([sums, a[p - both :] + b[q - both :][::-1]])
            nodes = np.concatenate([nodes, made])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (low - int(sums[0]), tick, sums, nodes))
        tick += 1
    windows = []
    for root in heap[0][3].tolist() if heap else []:
        items, todo = [], [root]
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo.extend(pairs[x - n])
        windows.append(sorted(items))
    return windows


def pack_block(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """As few windows as differencing fills without exceeding ``capacity``."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        windows = differencing(lengths, k)
        if max((int(lengths[w].sum()) for w in windows), default=0) <= capacity:
            return windows
        k += 1


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = 2048, max_piece: int = 512, block_windows: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in windows of ``capacity`` ids.

    Returns ``doc_id``, ``start`` (ids of the document before the piece),
    ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` (ids before it in
    its window) and ``ids`` (little-endian 32-bit).  Every document ends with
    ``end_id``; null and empty texts are that id alone.  Rows that repeat an id
    are packed as documents of their own; a null id stays null.  An empty table
    gives no row.  ``sequence_id`` is the partition in the upper and a running
    number in the lower 32 bits: windows never span partitions.
    """
    narrow = id_dtype(tokenizer).str
    slack = block_windows * 6
    fields = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = worker_bpe(tokenizer, narrow)
        end = np.asarray([end_id], dtype=narrow).tobytes()
        base, running = TaskContext.get().partitionId() << 32, 0
        out: list[tuple] = []
        block: list[tuple] = []
        room = block_windows * capacity - slack

        def close() -> None:
            nonlocal running, block, room
            lengths = np.asarray([len(x[2]) for x in block], dtype=np.int64)
            for window in pack_block(lengths, capacity) if block else []:
                at = 0
                for i in window:
                    key, start, ids, total = block[i]
                    out.append((key, start, len(ids), total, base + running, at, ids.tobytes()))
                    at += len(ids)
                running += 1
            block, room = [], block_windows * capacity - slack

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), fields.values())], names=list(fields))
            out.clear()
            return made

        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column(0)[row].as_py()
                ids = np.frombuffer(bpe.encode(batch.column(1)[row].as_py()) + end, dtype=narrow).astype("<u4")
                total, start = len(ids), 0
                while total - start >= capacity:
                    out.append((key, start, capacity, total, base + running, 0, ids[start : start + capacity].tobytes()))
                    running, start = running + 1, start + capacity
                while start < total:
                    size = min(max_piece, total - start, room)
                    block.append((key, start, ids[start : start + size], total))
                    start, room = start + size, room - size
                    if not room:
                        close()
                if len(out) >= 2000:
                    yield flush()
        close()
        while out:
            yield flush()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
