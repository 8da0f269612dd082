"""Removal of repeated passages through prefix-partitioned suffix trees.

A passage of ``window`` words that occurs twice makes an internal node at depth
``window`` or more in the suffix tree of the corpus; the leaves below it are its
occurrences.  The tree is never built as a whole:

* Sparse suffixes.  Of the word prefixes of the first length in a window, the one
  with the smallest hash (leftmost on ties) is its anchor.  Equal windows have
  equal anchors, so the subtrees of the anchors hold every repeat; neighbouring
  windows mostly share an anchor and travel together as a run, with their words.
* Prefix partitions.  The words from the anchor on are a window's path, and the
  path's prefix names the group that holds its subtree.  Prefixes have variable
  lengths: they start with a few words, and one with too many distinct runs below
  it for a group's memory is made longer for its windows, up to the whole window
  (near a window's end the prefix takes in words before the anchor).  What each
  prefix has below it is counted over the whole input, one length after another.
* Subtrees.  A group reads its runs' words, numbers them exactly, and names the
  nodes that its suffixes reach at depths 1, 2, 4 and so on up to ``window``, each
  level from pairs of nodes of the level before.  Suffixes that end at one node of
  depth ``window`` have the same words; a node with two or more leaves is a repeat.
  Its first leaf stays, the others are marked, and runs of marked windows are the
  maximal repeats, cut at their ends.

Hashes decide about anchors, groups and which subtrees have one leaf; whether
words are equal is decided by the words alone.

A run meets its group once for each task and distinct text, not once for each
copy: a task marks all but the first of the equal runs that it holds.  Hence a
passage in a third of all documents adds a row per task to its group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_partitions, forget, materialize, trim
from .words import BASE, WORD_BASE, Powers, mix, ranges

#: Bytes of text that are hashed at a time, and whose runs are packed at a time.
_CHUNK, _SETTLE = 1 << 20, 3 << 20
#: Bytes of text in a group's runs, about, and bits of the groups that travel as
#: one bundle and are told apart where they arrive.
GROUP_BYTES, _BUNDLE = 1 << 20, 4
#: Bytes of a bundle's words that a task sends as one row, and bytes that it holds
#: of all bundles for that, about.  So rows grow as the text does, whatever the
#: number of groups.
_PIECE, _PENDING = 32 << 10, 96 << 20
#: Distinct runs below a prefix that make it longer, at least, and the share of
#: all runs that does so in large corpora: five million long prefixes at most.
LONG_RUNS, LONG_SHARE = 30_000, 2e-7
#: Distinct runs that a task remembers to merge equal ones before the shuffle,
#: and the longest of them, in bytes.
_MEMORY, _LONGEST = 60_000, 1024

_NULL_ID = -(1 << 63)
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def prefix_lengths(window: int, first: int | None = None) -> list[int]:
    """Lengths that a prefix may have: doubled from the first on, then the window."""
    lengths = [min(window, first or max(1, window // 5))]
    while lengths[-1] * 2 <= window / 2:
        lengths.append(lengths[-1] * 2)
    return lengths + [window] * (lengths[-1] < window)


def _holds(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among ``known``, which is sorted and not empty."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Planner:
    """Anchors, prefixes and runs of some texts' windows."""

    def __init__(self, window: int, lengths: list[int], crowded: list[np.ndarray]):
        """``crowded``: for each length but the last, as far as known, the sorted
        prefixes that are too full."""
        self.window, self.lengths, self.crowded = window, lengths, crowded
        self._bytes, self._words = Powers(BASE), Powers(WORD_BASE)

    def _hashes(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        self._bytes.reach(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._bytes.up[: len(data)], out=sums[1:])
        return mix(ranges(sums, start, stop, self._bytes) + (stop - start).astype(np.uint64))

    def runs(self, data: np.ndarray, counts: np.ndarray):
        """Runs of windows with one prefix: text, first window's place in it, how
        many windows, prefix and its length; and the place of its bytes in ``data``,
        the words of all texts with one blank between them.  ``counts``: words of
        each text."""
        n, w = int(counts.sum()), self.window
        if n < w or not (counts >= w).any():
            return None
        gaps = np.flatnonzero(data == 32)
        begins, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        words = self._hashes(data, begins, ends)
        self._words.reach(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * self._words.up[:n], out=sums[1:])
        k = self.lengths[0]
        at = np.arange(n - k + 1)
        low, place = mix(ranges(sums, at, at + k, self._words)), at
        size = 1
        while size < w - k + 1:  # leftmost minimum over the window, by doubling
            step = min(size, w - k + 1 - size)
            other, where = low[step:], place[step:]
            low, place = low[: len(other)], place[: len(other)]
            less = other < low
            low, place = np.where(less, other, low), np.where(less, where, place)
            size += step
        at = np.arange(n - w + 1)
        last = np.cumsum(counts)
        text = np.repeat(np.arange(len(counts)), counts)[: n - w + 1]
        whole = at + w <= last[text]
        at, text, path, place = at[whole], text[whole], low[whole], place[whole]
        start, length = place, np.full(len(at), k)
        for shorter, longer, crowded in zip(self.lengths, self.lengths[1:], self.crowded):
            full = np.flatnonzero((length == shorter) & _holds(crowded, path)) if len(crowded) else []
            if not len(full):
                break
            s = np.minimum(place[full], at[full] + (w - longer))
            if start is place:
                start = place.copy()
            start[full], length[full], path[full] = s, longer, mix(ranges(sums, s, s + longer, self._words) ^ np.uint64(longer))
        fresh = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]) | (text[1:] != text[:-1])])
        head = np.flatnonzero(fresh)
        times = np.diff(np.concatenate([head, [len(at)]]))
        first, own = at[head], text[head]
        return own, first - (last - counts)[own], times, path[head], length[head], begins[first], ends[first + times + (w - 2)]


def _blocks(raw: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """A long text's words by blocks that share ``window - 1`` words: number of
    the first word, and the words with one blank between them."""
    at, base, held = 0, 0, []
    while at < len(raw):
        cut = _BLANK.search(raw, at + _CHUNK)
        to = cut.start() if cut else len(raw)
        held += raw[at:to].split()
        yield base, b" ".join(held)
        at, keep = to, min(len(held), window - 1)
        base += len(held) - keep
        held = held[len(held) - keep :]


def _chunks(batch: pa.RecordBatch, window: int) -> Iterator[tuple[list, list, list, bytes, np.ndarray]]:
    """Ids, hashes and first words' numbers of some texts, their words with one
    blank between them, and how many words each has."""
    rows: list[tuple] = []
    size = 0
    texts = batch.column(2)
    for i, (doc, twin) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        raw = texts[i].as_py() or b""
        for base, words in [(0, b" ".join(raw.split()))] if len(raw) <= 2 * _CHUNK else _blocks(raw, window):
            if not words:
                continue
            rows.append((doc, twin, base, words))
            size += len(words)
            if size >= _CHUNK:
                yield _chunk(rows)
                rows, size = [], 0
    if rows:
        yield _chunk(rows)


def _chunk(rows: list[tuple]):
    doc, twin, base, words = zip(*rows)
    return doc, twin, base, b" ".join(words), np.fromiter((w.count(b" ") + 1 for w in words), np.int64, len(words))


def _identified(docs: DataFrame, id_col: str, text_col: str, *also: Column) -> DataFrame:
    """``doc``, ``twin`` (a hash of the text, to tell rows that repeat an id apart)
    and the text's bytes.  Null ids come first, with hashes of their own."""
    key, text = F.col(id_col).cast("long"), F.col(text_col)
    twin = F.when(key.isNull(), F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(text))
    return docs.select(F.coalesce(key, F.lit(_NULL_ID)).alias("doc"), twin.alias("twin"), text.cast("binary").alias("text"), *also)


# Crowded prefixes ------------------------------------------------------------------


def _prefix_counts(planner: Planner, share: float):
    """Distinct runs below each prefix of the last length in some text, if they
    are an eighth of what a crowded prefix has on average there."""
    wanted = planner.lengths[len(planner.crowded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for *_, data, counts in _chunks(batch, planner.window):
                found = planner.runs(np.frombuffer(data, np.uint8), counts)
                if found is None:
                    continue
                path, length, a, b = found[3:]
                mine = np.flatnonzero(length == wanted)
                # Runs of one prefix differ in where they start and end.
                tried = zip(path[mine].tolist(), a[mine].tolist(), b[mine].tolist())
                distinct = {(p, hash(data[x:y])) for p, x, y in tried}
                keys, times = np.unique(np.fromiter((p for p, _ in distinct), np.uint64, len(distinct)), return_counts=True)
                many = times >= share * len(path) / 8
                yield pa.RecordBatch.from_pydict({"path": pa.array(keys[many].view(np.int64)), "runs": pa.array(times[many].astype(np.int64))})

    return run


def _crowded(texts: DataFrame, window: int, lengths: list[int], total: int) -> list[np.ndarray]:
    """For each length the prefixes that need more words, sorted.

    Bounded: a length has ``1 / LONG_SHARE`` of them at most.
    """
    runs = max(1, total / 60)  # a run comes up every 60 bytes or so
    share = max(LONG_RUNS / runs, LONG_SHARE)
    found: list[np.ndarray] = []
    for _ in lengths[:-1]:
        counts = texts.mapInArrow(_prefix_counts(Planner(window, lengths, found), share), "path long, runs long").groupBy("path").agg(F.sum("runs").alias("runs"))
        paths = counts.where(F.col("runs") >= share * runs * 0.875).select("path").toArrow().column(0).to_numpy()
        found = [*found, np.sort(paths.view(np.uint64))]
        if not len(paths):
            break
    return found


# Runs to their groups ---------------------------------------------------------------

#: A run on its way to its group; its words follow apart.
_RUN = np.dtype([("path", "<u8"), ("doc", "<i8"), ("twin", "<i8"), ("start", "<u4"), ("n", "<u4"), ("bytes", "<u4")])
_OUT = "group int, runs binary, words binary, doc long, twin long, spans binary"


def _top(path: np.ndarray, bits: int) -> np.ndarray:
    """A number of ``bits`` bits for each path."""
    # Anchors are small hashes, being minima: mixed again they fill all groups.
    return (mix(path) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(path), np.int64)


def _grouped_runs(planner: Planner, bits: int):
    """Runs by bundle of groups, and spans that a task already knows to be repeats.
    ``bits``: of a bundle's number."""
    window = planner.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        forget()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        seen: dict[bytes, tuple] = {}
        kept: list[tuple] = []
        late: list[tuple] = []

        waiting: dict[int, tuple[bytearray, bytearray]] = {}
        pending = 0

        def settle(last: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal pending
            rows, size = [], 0
            if kept:
                keys, words = zip(*kept)
                runs = np.array(list(keys), dtype=_RUN)
                bundle = _top(runs["path"], bits)
                order = np.argsort(bundle, kind="stable")
                bundle, runs, place = bundle[order], runs[order], order.tolist()
                cuts = np.flatnonzero(np.diff(bundle, prepend=-1)).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(runs)]):
                    leaves, text = waiting.setdefault(int(bundle[a]), (bytearray(), bytearray()))
                    before = len(leaves) + len(text)
                    leaves += runs[a:b].tobytes()
                    text += (b" " if text else b"") + b" ".join([words[i] for i in place[a:b]])
                    pending += len(leaves) + len(text) - before
            if late:
                doc, twin, start, n = (np.array(c, dtype=np.int64) for c in zip(*late))
                rows += _span_rows(doc, twin, start, start + n + (window - 1))
            kept.clear(), late.clear()
            last = last or pending > _PENDING
            for g in [g for g, (_, text) in waiting.items() if last or len(text) >= _PIECE]:
                leaves, text = waiting.pop(g)
                rows.append((g, squeeze(leaves), squeeze(text), None, None, None))
                pending -= len(leaves) + len(text)
                size += len(leaves) + len(text)
                if size >= _SETTLE:
                    yield _as_batch(rows)
                    rows, size = [], 0
            yield _as_batch(rows)

        for batch in batches:
            size = 0
            for doc, twin, base, data, counts in _chunks(batch, window):
                found = planner.runs(np.frombuffer(data, np.uint8), counts)
                if found is not None:
                    for own, start, n, path, _, a, b in zip(*(c.tolist() for c in found)):
                        words, key = data[a:b], (doc[own], twin[own], start + base[own])
                        held = seen.get(words)
                        if held is None or key < held:  # comes before what was sent: both go, the group decides
                            if b - a <= _LONGEST:
                                seen[words] = key
                            kept.append(((path, *key, n, b - a), words))
                        elif key > held:  # a row that repeats id and text is the same document
                            late.append((*key, n))
                    if len(seen) > _MEMORY:
                        seen.clear()
                size += len(data)
                if size >= _SETTLE:
                    yield from settle()
                    size = 0
            yield from settle()
        yield from settle(last=True)
        seen.clear()
        trim()

    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"group": pa.int32(), "runs": pa.binary(), "words": pa.binary(), "doc": pa.int64(), "twin": pa.int64(), "spans": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())] if rows else [pa.array([], t) for t in kinds.values()], names=list(kinds))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching ranges merged, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[head, 0], reach[np.concatenate([head[1:] - 1, [len(spans) - 1]])]], axis=1)


def _span_rows(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
    """One row for each document: its spans of removed words, merged, as u32."""
    if not len(doc):
        return []
    order = np.lexsort((start, twin, doc))
    doc, twin, start, end = doc[order], twin[order], start[order].astype(np.int64), end[order].astype(np.int64)
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])])
    number = np.cumsum(first) - 1
    lift = number * (int(end.max()) + 1)  # so that one running maximum serves all documents
    reach = np.maximum.accumulate(end + lift) - lift
    fresh = first.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    tail = np.concatenate([head[1:] - 1, [len(start) - 1]])
    spans = np.stack([start[head], reach[tail]], axis=1).astype("<u4")
    cuts = np.flatnonzero(first[head])
    stops = np.concatenate([cuts[1:], [len(head)]])
    keys = head[cuts]
    return [(None, None, None, d, t, spans[a:b].tobytes()) for d, t, a, b in zip(doc[keys].tolist(), twin[keys].tolist(), cuts.tolist(), stops.tolist())]


# Subtrees ---------------------------------------------------------------------------


def word_numbers(text: bytes) -> np.ndarray:
    """A number for each word of words with one blank between them; equal words,
    and no others, have equal numbers."""
    data = np.frombuffer(text + b" ", np.uint8)
    ends = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def tree_nodes(words: np.ndarray, depth: int) -> np.ndarray:
    """A number for the suffix tree's locus at ``depth`` of the suffix at each place.

    Two places have one number if and only if their next ``depth`` words are the
    same.  A level's nodes come from pairs of nodes of the level before, whose
    paths follow, or at last overlap, one another.
    """
    level, size = words, 1
    while size < depth:
        step = min(size, depth - size)
        pairs = level[: len(level) - step] * (int(level.max(initial=0)) + 1) + level[step:]
        level, size = pd.factorize(pairs)[0], size + step
    return level


def _repeats_of(window: int, runs: list[bytes], words: list[bytes], bits: int) -> list[tuple]:
    """Spans of all leaves but the first below every deep node of a bundle's groups."""
    leaf = np.frombuffer(b"".join(runs), dtype=_RUN)
    # Where a prefix has one run below it, nothing branches.
    _, inverse, times = np.unique(leaf["path"], return_inverse=True, return_counts=True)
    many = times[inverse] > 1
    if not many.any():
        return []
    text = b" ".join(words)
    ends = np.cumsum(leaf["bytes"].astype(np.int64) + 1)[many] - 1
    leaf = leaf[many]
    group = _top(leaf["path"], bits)
    order = np.argsort(group, kind="stable")
    group, leaf, ends = group[order], leaf[order], ends[order]
    cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    found = []
    for a, b in zip(cuts, [*cuts[1:], len(leaf)]):
        own = [text[e - n : e] for e, n in zip(ends[a:b].tolist(), leaf["bytes"][a:b].tolist())]
        found += _group_spans(window, leaf[a:b], word_numbers(b" ".join(own)))
    return found


def _group_spans(window: int, leaf: np.ndarray, numbers: np.ndarray) -> list[tuple]:
    """Spans of all leaves but the first below every deep node of one group."""
    n = leaf["n"].astype(np.int64)
    own = np.repeat(np.arange(len(leaf)), n)
    within = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    node = tree_nodes(numbers, window)[own * (window - 1) + np.arange(len(own))]  # a run has window - 1 words after its windows
    shared = np.bincount(node)[node] > 1
    own, node, within = own[shared], node[shared], within[shared]
    doc, twin, start = leaf["doc"][own], leaf["twin"][own], leaf["start"][own] + within
    order = np.lexsort((start, twin, doc, node))
    doc, twin, start, node = doc[order], twin[order], start[order], node[order]
    head = np.concatenate([[True], node[1:] != node[:-1]])[: len(node)]
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(node) else np.zeros(0, np.int64)
    # A row that repeats id and text is the same document, not a later leaf.
    late = (doc != doc[first]) | (twin != twin[first]) | (start != start[first])
    return _span_rows(doc[late], twin[late], start[late], start[late] + window)


def _subtrees(window: int, bits: int):
    """Spans from the runs of bundles, on which rows are sorted.  ``bits``: of a
    group's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        forget()
        unpack = zstandard.ZstdDecompressor().decompress
        bundle, runs, words = None, [], []
        made: list[tuple] = []
        for batch in batches:
            passed = batch.filter(batch.column(5).is_valid())
            if passed.num_rows:  # spans that a task knew already
                yield pa.RecordBatch.from_arrays(passed.columns[3:], names=["doc", "twin", "spans"])
            for g, r, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if g is None:
                    continue
                if g != bundle:
                    if runs:
                        made += _repeats_of(window, runs, words, bits)
                    bundle, runs, words = g, [], []
                runs.append(unpack(r.as_py())), words.append(unpack(t.as_py()))
            if len(made) > 10_000:
                yield pa.RecordBatch.from_arrays(_as_batch(made).columns[3:], names=["doc", "twin", "spans"])
                made = []
        if runs:
            made += _repeats_of(window, runs, words, bits)
        if made:
            yield pa.RecordBatch.from_arrays(_as_batch(made).columns[3:], names=["doc", "twin", "spans"])
        trim()

    return run


def repeated_spans(docs: DataFrame, *, window: int = 20, first_prefix: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``twin`` and ``spans``: word ranges covered by repeated windows.

    ``spans`` packs pairs (first word, word after the last) as unsigned 32-bit
    integers; a document may have several rows.  ``twin`` is the text's hash; null
    ids are -2^63, with hashes of their own.  The result is a table in the shared
    folder.  Null and empty texts, and empty tables, give no row.
    """
    texts, lengths = _identified(docs, id_col, text_col), prefix_lengths(window, first_prefix)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A run comes up every (window + 1) / 2 words or so and has window - 1 words more.
    bits = min(30, max(0, int(np.ceil(np.log2(max(1, total) * 3 / GROUP_BYTES)))))
    planner = Planner(window, lengths, _crowded(texts, window, lengths, total))
    sent = texts.mapInArrow(_grouped_runs(planner, max(0, bits - _BUNDLE)), _OUT)
    # Spans that a task knows already travel along, spread by document.
    n = byte_partitions(docs.sparkSession, total * 3, 128 << 20)
    dealt = sent.repartitionById(n, F.pmod(F.coalesce("group", F.hash("doc")), F.lit(n))).sortWithinPartitions("group")
    return materialize(dealt.mapInArrow(_subtrees(window, bits), "doc long, twin long, spans binary"), "spans")[0]


def _own_spans(found: list[bytes] | None) -> np.ndarray | None:
    return _merged(np.frombuffer(b"".join(found), "<u4").reshape(-1, 2)) if found else None


def _with_spans(docs: DataFrame, columns: list[str], spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``docs``, their names replaced by numbers, and ``found``: the
    spans of each row."""
    rows = _identified(docs, id_col, text_col, *(F.col(c).alias(str(i)) for i, c in enumerate(columns)))
    known = spans.groupBy("doc", "twin").agg(F.collect_list("spans").alias("found"))
    return rows.drop("text").join(known, ["doc", "twin"], "left").select(*(str(i) for i in range(len(columns))), "found")


def remove_repeats(docs: DataFrame, *, window: int = 20, first_prefix: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's words without those that a repeated window covers.

    A word goes if it lies in a window of ``window`` words whose word sequence
    also starts earlier: in a row with a smaller id, or earlier in the row.
    Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (words joined by one
    space) and ``spans`` (removed ranges of words).  Null texts have no words.
    Null ids come before all others.  Rows that repeat an id with another text
    are ordered by a hash of their texts; rows that repeat id and text are one
    document and share its result.  Empty tables give no row; other columns are
    ignored.
    """
    names = ["doc_id", "n_words", "n_removed", "kept", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def as_batch(out):
        cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        cols[3] = cols[3].cast(pa.string())
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, size = batch.column(1).cast(pa.binary()), [], 0
            for key, text, found in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                raw = text.as_py() or b""
                words = keep = raw.split()
                spans = _own_spans(found)
                if spans is not None:
                    keep, at = [], 0
                    for a, b in spans.tolist():
                        keep += words[at:a]
                        at = b
                    keep += words[at:]
                out.append((key, len(words), len(words) - len(keep), b" ".join(keep), b"" if spans is None else spans.astype("<u4").tobytes()))
                size += len(raw)
                if size > 8 << 20:
                    yield as_batch(out)
                    out, size = [], 0
            if out:
                yield as_batch(out)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = repeated_spans(chosen, window=window, first_prefix=first_prefix)
    return _with_spans(chosen, ["doc_id", "text"], spans, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans binary")


def cut_repeats(docs: DataFrame, *, window: int = 20, first_prefix: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, their repeated windows cut out of ``text_col``.

    The rules are those of :func:`remove_repeats`.  A word goes with the white
    space after it; rows without a repeat, null and empty ones among them, stay as
    they are; rows of which no word is left go.  All other columns, whatever their
    names, are unchanged.  An empty table gives an empty one.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = batch.column(at).cast(pa.binary()).to_pylist(), np.ones(batch.num_rows, dtype=bool)
            for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                spans = _own_spans(found)
                if spans is None:
                    continue
                raw = texts[i]
                starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
                stay[i] = int((spans[:, 1] - spans[:, 0]).sum()) < len(starts) - 1
                parts, done = [], 0
                for a, b in spans.tolist():
                    parts.append(raw[done : starts[a]])
                    done = starts[b]
                texts[i] = b"".join(parts) + raw[done:]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay))

    spans = repeated_spans(docs, window=window, first_prefix=first_prefix, id_col=id_col, text_col=text_col)
    return _with_spans(docs, names, spans, id_col, text_col).mapInArrow(run, docs.schema)
