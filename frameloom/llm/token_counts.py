"""Token counts by a unigram model, with dynamic programming shared on a trie.

A text's pre-tokens are its runs between white space, each with U+2581 in front.
A pre-token's segmentation is the one with the best sum of piece scores (of
equal sums, the one with fewer pieces).  A worker inserts the distinct pre-tokens
of all texts that it sees into one trie.  A node has the forward score of its prefix
and how many pieces that takes, computed when the node is made from the nodes above
it, so that a prefix is scored once for all pre-tokens below it; where a pre-token
ends, the node's count is the pre-token's.  A node knows the pieces that end there by
its state in an automaton over the pieces, so that none is looked for twice.  A
character that no piece covers costs one token for each UTF-8 byte.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, text_slices

#: Nodes of a worker's trie, about, and how deep it is: a longer pre-token goes on
#: from there without nodes.
_NODES, _DEPTH = 1_000_000, 64
_CHUNK = 2_000_000
SPACE = "▁"


def unigram_scores(path: str) -> dict[str, float]:
    """Log probabilities of a SentencePiece model's ordinary pieces.

    A unigram model has them.  A merge model has ranks, which stand for
    frequencies: the probability of rank ``r`` is taken as 1 / (r + 2.7), up to
    a factor (Zipf's law).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = range(model.get_piece_size())
    plain = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in plain]
    if all(s == int(s) and s <= 0 for s in scores):  # ranks
        total = math.log(sum(1 / (r + 2.7) for r in range(len(plain))))
        scores = [-math.log(r + 2.7) - total for r in range(len(plain))]
    return dict(zip(map(model.id_to_piece, plain), scores))


class _Pieces:
    """Which pieces end at a character, by the longest end of what was read that some
    piece starts with (an Aho-Corasick automaton, made as far as texts need it)."""

    def __init__(self, scores: dict[str, float]):
        self._scores = scores
        self._unknown = min(scores.values(), default=0.0) - 10.0
        self._names = ["", *{piece[:i]: None for piece in scores for i in range(1, len(piece) + 1)}]
        self._states = dict(zip(self._names, range(len(self._names))))
        self.steps: dict[int, int] = {}  # by state and character
        self.options: list[list[tuple[int, float, int]] | None] = [None] * len(self._names)

    def step(self, state: int, char: str) -> int:
        """The state after ``char``, whose options are then made; the root's hang on ``char``."""
        read = self._names[state] + char
        while (found := self._states.get(read)) is None:
            read = read[1:]
        if found and self.options[found] is None:
            self.options[found] = self.ending(read)
        self.steps[state << 21 | ord(char)] = found
        return found

    def ending(self, read: str) -> list[tuple[int, float, int]]:
        """Characters, score and tokens of each piece that ends ``read``; first its last
        character in bytes, unless a piece covers that at least as well."""
        size = len(read[-1].encode("utf-8", "surrogatepass"))
        found = [(n, own, 1) for n in range(1, len(read) + 1) if (own := self._scores.get(read[-n:])) is not None]
        raw = (1, self._unknown * size, size)
        return found if found and found[0][0] == 1 and found[0][1] >= raw[1] else [raw, *found]


class Trie:
    """Prefixes of pre-tokens with their forward scores and counts of pieces."""

    def __init__(self, scores: dict[str, float]):
        self._known = _Pieces(scores)
        self._clear()

    def _clear(self) -> None:
        self._child: dict[int, int] = {}  # by node and character
        self._score, self._pieces, self._state = array("d", [0.0]), array("q", [0]), array("q", [0])  # by node; the root is 0
        self._ends: dict[str, int] = {}  # the node where a pre-token ends
        self._known.steps.clear()
        self._last, self._path = "", ([0], [0.0], [0])  # nodes, scores and pieces along what was inserted last

    def __len__(self) -> int:
        return len(self._score)

    def insert(self, word: str) -> int:
        """The node where ``word`` ends, made with all above it where it is new.

        The path that it shares with the last one isn't walked again, so that sorted
        pre-tokens take the least time.
        """
        token, child = SPACE + word, self._child
        path, score, pieces = self._path
        shared = 0
        for x, y in zip(token, self._last):
            if x != y:
                break
            shared += 1
        del path[shared + 1 :], score[shared + 1 :], pieces[shared + 1 :]
        self._last, node = token[:_DEPTH], path[-1]
        for char in self._last[shared:]:
            known = child.get(node << 21 | ord(char))
            if known is None:
                break
            node = known
            path.append(node)
            score.append(self._score[node])
            pieces.append(self._pieces[node])
        state, steps, options = self._state[node], self._known.steps, self._known.options
        for end in range(len(path), len(token) + 1):
            char = token[end - 1]
            code = ord(char)
            after = steps.get(state << 21 | code)
            state = self._known.step(state, char) if after is None else after
            top = None
            for size, own, tokens in options[state] if state else self._known.ending(char):
                own += score[-size]
                if top is None or own > top or own == top and pieces[-size] + tokens < count:
                    top, count = own, pieces[-size] + tokens
            score.append(top)
            pieces.append(count)
            if end <= _DEPTH or end == len(token):
                known = len(self._score)
                self._score.append(top)
                self._pieces.append(count)
                self._state.append(state)
                if end <= _DEPTH:
                    child[node << 21 | code] = known
                    path.append(known)
                node = known
        return node

    def of(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        split = [(t or "").split() for t in texts]
        if max(len(self), len(self._known.steps)) > _NODES:
            self._clear()
        ends = self._ends
        new = sorted(set().union(*split).difference(ends))
        for w in new:
            ends[w] = self.insert(w)
        out = [(len(words), sum(map(self._pieces.__getitem__, map(ends.__getitem__, words)))) for words in split]
        for w in new:
            if len(w) >= _DEPTH:
                del ends[w]
        return out


def _worker_trie(path: str) -> Trie:
    return kept((Trie, path), lambda: Trie(unigram_scores(path)))


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` (long) of each row's text.

    Null, empty and blank texts have none.  Rows that repeat are counted alike;
    an empty table gives no row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _worker_trie(model_path)
        for batch in batches:
            found = []
            for texts in text_slices(batch.column(1), _CHUNK):
                found += trie.of(texts)
            words, tokens = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
