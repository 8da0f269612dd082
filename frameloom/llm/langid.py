"""Language identification by words, backing off to shorter and shorter n-grams.

The model has, for each language, the logarithms of relative frequencies of
words and of character n-grams of 1 to ``longest`` characters (words are padded
with a blank on either side).  A word that any language knows is scored by its
word frequencies.  Else its longest n-grams are tried: the word's score is the
mean over those that any language knows; if none is known, n-grams one
character shorter are tried, and so on.  A language that lacks what is scored
pays a fixed penalty.  A text's score is the mean over its words.  No word spans
white space, so words are looked for in each distinct run between white space once.

Words are runs of letters (Unicode's categories L*), with the combining marks (M*)
that follow them; numbers that look like letters are none.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, materialize, release, text_slices

#: Documents of each language that a model is fitted on, about: those whose
#: hashed ids are below the share that this makes of them.  Every word and n-gram
#: of theirs is kept, so a model's size is bounded by languages x documents.
FIT_DOCUMENTS = 4000
_LETTERS = re.compile(r"[^\W\d_]+")
#: What stands beside most words; neither letters nor marks.
_SIGNS = string.digits + string.punctuation
#: Runs between white space whose scores a worker remembers, about, and how long they are.
_MEMORY, _LONGEST_RUN = 300_000, 64
#: Things that a task counts before it passes counts on, about.
_COUNTED = 300_000
#: Bytes of text, and words, that are scored at a time.
_CHUNK, _BLOCK = 2_000_000, 50_000


@cache
def _odd() -> re.Pattern:
    """Characters that ``_LETTERS`` takes for letters but aren't, and marks."""
    odd, ranges = (i for i in range(128, sys.maxunicode + 1) if (c := unicodedata.category(chr(i)))[0] == "M" or c in ("Nl", "No")), []
    for i in odd:
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")


@cache
def _any_letters():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and their marks."""
    text = text.lower()
    return (_LETTERS if text.isascii() or not _odd().search(text) else _any_letters()).findall(text)


def words_of_run(run: str) -> list[str]:
    """Words of a lower-cased run between white space."""
    core = run.strip(_SIGNS)
    return [core] if core.isalpha() else words_of(run)


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


@dataclass
class Languages:
    """``grams`` and ``rows``: words, then n-grams of 1 to ``longest``, and their log
    frequencies by language."""

    names: list[str]
    longest: int
    penalty: float
    grams: list[pa.Array]
    rows: list[np.ndarray]

    def __getstate__(self):
        return (self.names, self.longest, self.penalty, self.grams, self.rows)

    def __setstate__(self, state):
        self.names, self.longest, self.penalty, self.grams, self.rows = state

    @property
    def tables(self) -> list[dict[str, int]]:
        if not hasattr(self, "_tables"):
            self._tables = [dict(zip(g.to_pylist(), range(len(g)))) for g in self.grams]
        return self._tables

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        out = np.full((len(words), len(self.names)), self.penalty, np.float32)
        found = list(map(self.tables[0].get, words))
        at = [i for i, x in enumerate(found) if x is not None]
        out[at] = self.rows[0][[found[i] for i in at]]
        rest = [i for i, x in enumerate(found) if x is None]
        for n in range(self.longest, 0, -1):
            table, ids, at, starts, left = self.tables[n], [], [], [], []
            for i in rest:
                known = [x for g in grams_of(words[i], n) if (x := table.get(g)) is not None]
                if known:
                    at.append(i), starts.append(len(ids))
                    ids += known
                else:
                    left.append(i)
            if at:
                out[at] = np.add.reduceat(self.rows[n][ids], starts, axis=0) / np.diff([*starts, len(ids)])[:, None].astype(np.float32)
            rest = left
        return out


def _add(sums: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> None:
    """Adds each of ``rows`` to its owner's row of ``sums``."""
    for j in range(rows.shape[1]):
        sums[:, j] += np.bincount(owner, rows[:, j], len(sums))


class Predictor:
    def __init__(self, model: Languages):
        self._model = model
        if model.names:
            self._clear()

    def _clear(self) -> None:
        #: By run, its row of sums over its words, with their number at the end.  A run
        #: that is a word of the model has the word's.
        self._at: dict[str, int] = dict(self._model.tables[0])
        known = self._model.rows[0]
        self._rows = np.concatenate([known, np.ones((len(known), 1))], axis=1, dtype=np.float64)

    def _learn(self, runs: list[str]) -> None:
        words = [words_of_run(x) for x in runs]
        sizes = np.asarray([len(x) for x in words], np.int64)
        flat, owner = [w for x in words for w in x], np.repeat(np.arange(len(runs)), sizes)
        rows = np.zeros((len(runs), self._rows.shape[1]))
        rows[:, -1] = sizes
        for at in range(0, len(flat), _BLOCK):
            _add(rows, owner[at : at + _BLOCK], self._model.score(flat[at : at + _BLOCK]))
        self._at.update(zip(runs, range(len(self._rows), len(self._rows) + len(runs))))
        self._rows = np.concatenate([self._rows, rows])

    def all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the language and its share of the scores' likelihoods; ``und``
        and 0 without a letter or without a model."""
        model = self._model
        if not model.names:
            return [("und", 0.0)] * len(texts)
        if len(self._rows) > _MEMORY + len(model.rows[0]):
            self._clear()
        split = [(t or "").lower().split() for t in texts]
        runs = [x for own in split for x in own]
        rows = list(map(self._at.get, runs))
        new = list({x for x, row in zip(runs, rows) if row is None})
        if new:
            self._learn(new)
            rows = [self._at[x] if row is None else row for x, row in zip(runs, rows)]
        total, owner = np.zeros((len(texts), self._rows.shape[1])), np.repeat(np.arange(len(texts)), np.asarray([len(own) for own in split], np.int64))
        for at in range(0, len(rows), _BLOCK):
            _add(total, owner[at : at + _BLOCK], self._rows[rows[at : at + _BLOCK]])
        for x in new:
            if len(x) > _LONGEST_RUN:
                del self._at[x]
        total, words = total[:, :-1], total[:, -1]
        best = total.argmax(axis=1)  # ties: the first name
        # Words of one text depend on one another: their evidence grows as a root.
        gap = (total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(words, 1))[:, None]
        score = 1 / np.exp(np.maximum(gap, -50)).sum(axis=1)
        return [(model.names[k], x) if n else ("und", 0.0) for k, x, n in zip(best.tolist(), score.tolist(), words.tolist())]

    def of(self, text: str | None) -> tuple[str, float]:
        return self.all([text])[0]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of ``lang, text`` rows with counts."""
    found: defaultdict[str, Counter] = defaultdict(Counter)

    def rows():
        for lang, runs in found.items():
            words: Counter = Counter()
            for run, times in runs.items():
                for word in words_of_run(run):
                    words[word] += times
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()), "word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})
        found.clear()

    size = chars = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own, text = found[lang], text.as_py()
            size, chars = size - len(own), chars + len(text)
            own.update(text.lower().split())
            size += len(own)
            if size > _COUNTED or chars > 100 * _COUNTED:
                yield from rows()
                size = chars = 0
    yield from rows()


def _gram_counts(longest: int):
    """Words, and n-grams of 1 to ``longest`` characters, of ``lang, word, n`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: defaultdict[tuple[str, int], dict[str, int]] = defaultdict(dict)

        def rows():
            for (lang, kind), own in found.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), "kind": pa.array([kind] * len(own), pa.int32()), "gram": pa.array(own.keys(), pa.string()), "n": pa.array(own.values(), pa.int64())})
            found.clear()

        size = 0
        for batch in batches:
            for lang, word, times in zip(*(c.to_pylist() for c in batch.columns)):
                found[lang, 0][word] = times
                size += 1
                for n in range(1, longest + 1):
                    own = found[lang, n]
                    size -= len(own)
                    for g in grams_of(word, n):
                        own[g] = own.get(g, 0) + times
                    size += len(own)
                if size > _COUNTED:
                    yield from rows()
                    size = 0
        yield from rows()

    return run


def fit_languages(docs: DataFrame, *, where: Column | None = None, longest: int = 5, fit_documents: int = FIT_DOCUMENTS, penalty: float = -14.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """A model of the non-null ``lang_col`` of the rows that pass ``where``.

    Rows with a null text or id, and texts without a letter, teach nothing.  Rows
    that repeat an id are taken or left together.  Without any row the model has no
    language.  The counts of ``fit_documents`` documents a language reach the driver.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(id_col).cast("long").alias("doc"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("doc IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    # A language's rows are chosen by a hash of their ids against its own share.  The
    # shares (a row a language) go to the texts, and words to where they are cut: texts
    # aren't dealt by language, of which there are few.
    shares = rows.groupBy("lang").agg((F.lit(fit_documents * (1 << 20)) / F.count("*")).alias("share"))
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < F.col("share"))
    words = chosen.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = words.mapInArrow(_gram_counts(longest), "lang string, kind int, gram string, n long")
    counts, path = materialize(counted.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    found = counts.toArrow().combine_chunks()
    release(docs.sparkSession, path)
    names = sorted(found["lang"].unique().to_pylist())
    grams, tables = [], []
    for kind in range(longest + 1):
        own = found.filter(pc.equal(found["kind"], kind)).combine_chunks()
        gram = own["gram"].combine_chunks().dictionary_encode() if own.num_rows else pa.array([], pa.string()).dictionary_encode()
        lang = pc.index_in(own["lang"], pa.array(names, pa.string())).to_numpy().astype(np.int64) if own.num_rows else np.zeros(0, np.int64)
        n = own["n"].to_numpy().astype(np.float64)
        total = np.bincount(lang, n, len(names))
        table = np.full((len(gram.dictionary), len(names)), penalty, np.float32)
        table[gram.indices.to_numpy(), lang] = np.log(n / total[lang])
        grams.append(gram.dictionary), tables.append(table)
    return Languages(names, longest, penalty, grams, tables)


def identify(docs: DataFrame, model: Languages, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) for each row.

    ``und`` with score 0 if the text is null or has no letter.  Repeated rows are
    treated alike; an empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by FIT_DOCUMENTS for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = kept((Predictor, key), lambda: Predictor(shared.value))
        for batch in batches:
            found = [x for texts in text_slices(batch.column(1), _CHUNK) for x in predictor.all(texts)]
            lang, score = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
