"""Benchmark decontamination: a BM25 index of test items, searched by passages.

Items are the indexed documents and passages of training texts the queries.  An
item's BM25 weights are divided by their sum, the score of a passage with all of
its words, so that scores lie in 0 to 1 whatever an item's length.

The index has blocks of ``BLOCK`` items.  A term's posting list has a row of weights
for each block that it occurs in, and the row's largest weight.  The search is
block-max WAND: a passage has a cursor in each of its terms' lists.  In the order of
the cursors' blocks, the sum of the lists' largest weights first reaches the
threshold at the pivot; no block before the pivot's can hold an item at or above the
threshold, so cursors skip to it.  There the sum of the rows' largest weights
decides whether the block is scored or passed over.  A passage ends when no pivot is
left.  Many passages take each step together.

Passages overlap by half and are twice as long as the longest item with room
for insertions, so no occurrence is torn apart.  What the search returns is then
verified: shingles of ``shingle`` words of the item, of its question and of its
answer, against the passage's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, text_slices

BLOCK = 32
#: Items of one index.  A larger benchmark is searched one index after another,
#: each of them small enough to be sent to every task.
SHARD_ITEMS = 20_000
#: Characters of items of one index, at most (an item alone may be longer).
SHARD_CHARS = 16_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!:])\s+")
_CHUNK = 1_000_000
#: Passages that search together.
_TOGETHER = 512
#: Pairs of passage and term that are marked one by one, at most; more are sorted.
_MARKS = 1 << 25


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words up to the last sentence, and those of the last; of a single
    sentence all words are the question's."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    return (sum(parts[:-1], []), parts[-1]) if len(parts) > 1 else (sum(parts, []), [])


def _shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@dataclass
class Item:
    key: int
    question: list[str]
    answer: list[str]

    def overlaps(self, passage: list[str], shingle: int) -> tuple[float, float, float]:
        """Shares of the item's, the question's and the answer's own in the
        passage: shingles, for the answer words.  No answer counts as found."""
        n = min(shingle, len(self.question) + len(self.answer))
        whole = _shingles(self.question + self.answer, n)
        found = _shingles(passage, n)
        share = len(whole & found) / len(whole)
        m = min(shingle, len(self.question))
        asked = _shingles(self.question, m)
        question = len(asked & (found if m == n else _shingles(passage, m))) / len(asked)
        have, want = Counter(passage), Counter(self.answer)
        answer = sum(min(have[w], k) for w, k in want.items()) / len(self.answer) if self.answer else 1.0
        return share, question, answer


@dataclass
class Index:
    items: list[Item]
    terms: dict[str, int]
    first: np.ndarray  # of a term's rows; one more than terms
    block: np.ndarray  # of a row
    most: np.ndarray  # largest weight of a row
    weights: np.ndarray  # rows x BLOCK
    stride: int = field(default=0)

    @classmethod
    def build(cls, items: list[Item], documents: dict[str, int], n_items: int, mean_words: float, k1: float = 1.2, b: float = 0.75) -> Index:
        """``documents``: in how many of ``n_items`` items each term occurs."""
        postings: dict[str, list[tuple[int, float]]] = {}
        for i, item in enumerate(items):
            counts = Counter(item.question + item.answer)
            norm = k1 * (1 - b + b * sum(counts.values()) / mean_words)
            own = {t: np.log(1 + (n_items - documents[t] + 0.5) / (documents[t] + 0.5)) * tf * (k1 + 1) / (tf + norm) for t, tf in counts.items()}
            total = sum(own.values())
            for t, w in own.items():
                postings.setdefault(t, []).append((i, w / total))
        first, block, rows = [0], [], []
        for found in postings.values():
            for i, w in found:
                if len(block) == first[-1] or block[-1] != i // BLOCK:
                    block.append(i // BLOCK)
                    rows.append(np.zeros(BLOCK, np.float32))
                rows[-1][i % BLOCK] = w
            first.append(len(block))
        weights = np.stack(rows) if rows else np.zeros((0, BLOCK), np.float32)
        longest = max((len(i.question) + len(i.answer) for i in items), default=0)
        return cls(items, {t: k for k, t in enumerate(postings)}, np.asarray(first), np.asarray(block, dtype=np.int64), weights.max(axis=1) if rows else np.zeros(0, np.float32), weights, stride=max(32, longest + longest // 4))

    def search(self, passage: np.ndarray, term: np.ndarray, n_passages: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, items and scores of all pairs that reach ``threshold``;
        ``passage`` (sorted) and ``term`` are the distinct terms of each passage."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo in range(0, n_passages, _TOGETHER):
            a, b = np.searchsorted(passage, [lo, lo + _TOGETHER])
            found += [(p + lo, i, s) for p, i, s in self._wand(passage[a:b] - lo, term[a:b], min(_TOGETHER, n_passages - lo), threshold)]
        return tuple(np.concatenate(c) for c in zip(*found))

    def _wand(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not len(passage):
            return
        slack = 1e-4  # sums of single precision
        counts = np.bincount(passage, minlength=n)
        wide, end = int(counts.max(initial=0)), int(self.block.max(initial=-1)) + 1
        place = np.arange(len(passage)) - np.repeat(np.cumsum(counts) - counts, counts)
        list_of, at, most = np.full((n, wide), -1, np.int64), np.zeros((n, wide), np.int64), np.zeros((n, wide), np.float32)
        list_of[passage, place], at[passage, place], most[passage, place] = term, self.first[term], self._list_most[term]
        here = np.full((n, wide), end, np.int64)  # a cursor's block; ``end`` where its list has ended
        here[passage, place] = self.block[self.first[term]]
        rows = np.arange(n)
        while len(rows):
            to, most_left = self._pivots(here, most, end, threshold - slack)
            left = most_left >= threshold - slack
            if not left.all():
                rows, list_of, at, most, here, to = (x[left] for x in (rows, list_of, at, most, here, to))
            if not len(rows):
                return
            to = to[:, None]
            behind = here < to  # these skip to the pivot's block or beyond
            lists, goal = list_of[behind], np.broadcast_to(to, here.shape)[behind]
            self._move(at, here, behind, np.searchsorted(self._places, lists * end + goal), lists, end)
            there = here == to
            bound = np.where(there, self.most[np.minimum(at, len(self.most) - 1)], 0).sum(axis=1)
            r, c = np.nonzero(there & (bound >= threshold - slack)[:, None])
            if len(r):
                head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                scores = np.add.reduceat(self.weights[at[r, c]], head, axis=0)
                k, slot = np.nonzero(scores >= threshold - 1e-6)
                yield rows[r[head[k]]], to[r[head[k]], 0] * BLOCK + slot, scores[k, slot].astype(np.float64)
            self._move(at, here, there, at[there] + 1, list_of[there], end)

    @staticmethod
    def _pivots(here: np.ndarray, most: np.ndarray, end: int, enough: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the largest weights of the lists, by their cursors' blocks, add up to
        enough, and what all that haven't ended add up to."""
        n, wide = here.shape
        if end <= 4 * wide:  # by block, else by cursor
            at = here + np.arange(n)[:, None] * (end + 1)
            total = np.cumsum(np.bincount(at.ravel(), most.ravel(), n * (end + 1)).reshape(n, end + 1)[:, :end], axis=1)
            return np.argmax(total >= enough, axis=1), total[:, -1] if end else np.zeros(n)
        order = np.argsort(here, axis=1)
        total = np.cumsum(np.take_along_axis(np.where(here < end, most, 0), order, axis=1), axis=1, dtype=np.float64)
        pivot = np.argmax(total >= enough, axis=1)
        return here[np.arange(n), order[np.arange(n), pivot]], total[:, -1] if wide else np.zeros(n)

    def _move(self, at: np.ndarray, here: np.ndarray, which: np.ndarray, to: np.ndarray, lists: np.ndarray, end: int) -> None:
        """Cursors go on to the rows ``to``, or end with their lists."""
        at[which] = to
        here[which] = np.where(to < self.first[lists + 1], self.block[np.minimum(to, len(self.block) - 1)], end)

    @cached_property
    def _list_most(self) -> np.ndarray:
        return np.maximum.reduceat(self.most, self.first[:-1])

    @cached_property
    def _places(self) -> np.ndarray:
        """List and block of each row as one rising number."""
        lists = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        return lists * (int(self.block.max(initial=-1)) + 1) + self.block


def build_indexes(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """Indexes of all items; rows with a null id or without a word are ignored.

    The weights' statistics are those of the whole benchmark, whatever the
    number of indexes.
    """
    chosen = benchmark.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    n, chars = chosen.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n:
        return []
    shards = max(-(-n // SHARD_ITEMS), -(-chars // SHARD_CHARS))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = Counter(words_of(text))
                yield pa.RecordBatch.from_pydict({"term": pa.array(counts, pa.string()), "n": pa.array(counts.values(), pa.int64())})

    if shards > 1:
        frequency, _ = materialize(chosen.select("text").mapInArrow(terms, "term string, n long").groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("n")), "item-terms")
        total = frequency.agg(F.sum("n")).first()[0]
        filled = chosen.where(F.col("text").rlike(r"[\p{L}\p{N}_]")).count()
    out = []
    for k in range(shards):
        rows = chosen.where(F.pmod(F.xxhash64("key", "text"), F.lit(shards)) == k) if shards > 1 else chosen
        items = [Item(r.key, *question_and_answer(r.text)) for r in sorted(rows.collect(), key=lambda r: (r.key, r.text))]
        items = [i for i in items if i.question]
        own = Counter(t for i in items for t in {*i.question, *i.answer})
        if shards > 1:
            names = chosen.sparkSession.createDataFrame([(t,) for t in own] or [("",)], "term string")
            own = {r.term: r.documents for r in frequency.join(names, "term").collect()}
            mean, count = total / max(1, filled), filled
        else:
            count = len(items)
            mean = sum(len(i.question) + len(i.answer) for i in items) / max(1, count)
        if items:
            out.append(Index.build(items, own, count, mean))
    return out


def _distinct(values: np.ndarray, below: int) -> np.ndarray:
    """The distinct values, sorted; all are under ``below``."""
    if below > _MARKS:
        return np.unique(values)
    marks = np.zeros(below, bool)
    marks[values] = True
    return np.flatnonzero(marks)


class Detector:
    """Verified leaks of one index in texts."""

    def __init__(self, index: Index, threshold: float, overlap: float, shingle: int):
        self._index, self._threshold, self._overlap, self._shingle = index, threshold, overlap, shingle

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float, float, int]]:
        """For each text and leaked item: number of the text, item id, BM25
        score, the three overlaps, and the first word of the best passage."""
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= _CHUNK):
                size += len(texts[to] or "")
                to += 1
            for found in self._chunk(texts[at:to]):
                yield found[0] + at, *found[1:]
            at = to

    def _chunk(self, texts: list[str | None]):
        index, stride = self._index, self._index.stride
        known = index.terms.get
        words = [words_of(t) for t in texts]
        sizes = np.asarray([len(w) for w in words])
        passages = np.maximum(1, -(-sizes // stride) - (sizes > stride))
        base = np.cumsum(passages) - passages
        term = np.fromiter(map(known, chain.from_iterable(words), repeat(-1)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        place = (np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // stride
        hit = term >= 0
        term, text, place = term[hit], text[hit], place[hit]
        n_terms, total = len(index.terms), int(passages.sum())
        # Passage j has the strides j and j + 1; the last stride has no passage of its own.
        keys = []
        for back in (0, 1):
            j = place - back
            ok = (j >= 0) & (j < passages[text])
            keys.append((base[text[ok]] + j[ok]) * n_terms + term[ok])
        key = _distinct(np.concatenate(keys), total * n_terms)
        best: dict[tuple[int, int], tuple] = {}
        cache: tuple[int, list[str]] = (-1, [])
        for p, i, score in zip(*(x.tolist() for x in index.search(key // n_terms, key % n_terms, total, self._threshold))):
            t = int(np.searchsorted(base, p, side="right")) - 1
            start = (p - int(base[t])) * stride
            if cache[0] != p:
                cache = (p, words[t][start : start + 2 * stride])
            item = index.items[i]
            share, question, answer = item.overlaps(cache[1], self._shingle)
            if share >= self._overlap or question >= self._overlap and answer >= self._overlap:
                row = (share, question, answer, score, -start)
                if row > best.get((t, item.key), ()):
                    best[t, item.key] = row
        for (t, key_), (share, question, answer, score, start) in sorted(best.items()):
            yield t, key_, score, share, question, answer, -start


_LEAKS = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, at_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5, overlap: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs`` and item that leaked into its text.

    An item has leaked if a passage scores ``threshold`` and has ``overlap`` of
    the item's shingles, or of its question's shingles and its answer's words.
    Null and empty texts, and null or wordless items, leak nothing; null document
    ids stay null; rows that repeat give repeated rows; empty tables give none.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], _LEAKS)
    for index in build_indexes(benchmark, id_col=item_col, text_col=item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forget()
            detector = Detector(shared.value, threshold, overlap, shingle)
            names = [c.split()[0] for c in _LEAKS.split(", ")]
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
            for batch in batches:
                keys = batch.column(0).to_pylist()
                rows, at = [], 0
                for texts in text_slices(batch.column(1), _CHUNK):
                    rows += [(keys[at + t], *rest) for t, *rest in detector.of(texts)]
                    at += len(texts)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        out = out.union(chosen.mapInArrow(run, _LEAKS))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5, overlap: float = 0.8, shingle: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that :func:`find_leaks` clears.

    Null and empty texts and rows with null ids stay if nothing leaks into them;
    rows that repeat stay or go together; an empty benchmark clears all, and an
    empty table stays empty.
    """
    at = docs.columns.index(text_col)
    for index in build_indexes(benchmark, id_col=item_col, text_col=item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forget()
            detector = Detector(shared.value, threshold, overlap, shingle)
            for batch in batches:
                clean, done = np.ones(batch.num_rows, dtype=bool), 0
                for texts in text_slices(batch.column(at), _CHUNK):
                    clean[[done + t for t, *_ in detector.of(texts)]] = False
                    done += len(texts)
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
