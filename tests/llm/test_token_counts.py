import random

import public_tokenizers

from frameloom.llm import token_counts
from frameloom.llm.token_counts import SPACE, Trie, count_tokens, unigram_scores


def plain(scores, word):
    """Best (score, -pieces) over all segmentations, from scratch."""
    token, floor = SPACE + word, min(scores.values()) - 10.0
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        size = len(token[end - 1].encode())
        options = [(best[end - 1][0] + floor * size, best[end - 1][1] - size)]
        options += [(best[s][0] + scores[token[s:end]], best[s][1] - 1) for s in range(end) if token[s:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_shared_scores_equal_scores_from_scratch():
    rng = random.Random(2)
    scores = {SPACE: -3.0, "a": -2.0, "b": -2.0, "ab": -3.0, SPACE + "ab": -4.0, "abab": -5.0, "ba": -3.5, "é": -6.0, "bb": -4.0}
    words = {"".join(rng.choices("abcé你", k=rng.randint(1, 12))) for _ in range(500)}
    trie = Trie(scores)
    assert {w: trie._pieces[trie.insert(w)] for w in words} == {w: plain(scores, w) for w in words}
    assert len(trie) == 1 + len({(SPACE + w)[:i] for w in words for i in range(1, len(w) + 2)})  # a node for each prefix
    size = len(trie)
    assert trie.of([" ".join(words)] * 2) == [(len(words), sum(plain(scores, w) for w in words))] * 2 and len(trie) == size
    long = "".join(rng.choices("ab", k=500))
    assert trie.of([f"{long} a", f"{long}b"]) == [(2, plain(scores, long) + plain(scores, "a")), (1, plain(scores, long + "b"))]
    assert len(trie) < size + 200 and long not in trie._ends


def test_pieces_are_looked_for_once_and_not_at_every_node():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    rng = random.Random(3)
    plain_scores = {SPACE: -3.0, "a": -2.0, "b": -2.0, "aab": -3.0, SPACE + "ab": -4.0, "ab" * 8: -5.0, "ba": -3.5, "é": -6.0, "bb": -4.0, "你a": -7.0}
    words = ["".join(rng.choices("abcé你", weights=[9, 9, 1, 1, 1], k=rng.choice([*range(1, 20), 62, 63, 64, 65, 150]))) for _ in range(600)]
    words += ["ab" * n for n in range(1, 80)]
    trie = Trie(scores := Counted(plain_scores))
    for order in (words[:300], sorted(words), words[::-1]):
        assert {w: trie._pieces[trie.insert(w)] for w in order} == {w: plain(plain_scores, w) for w in order}
    asked, size = scores.asked, len(trie)
    trie.insert("".join(rng.choices("ab", k=60)))
    assert len(trie) > size + 20 and scores.asked == asked < size


def test_query_on_a_whole_table(spark):
    from frameloom.llm import queries

    scores = unigram_scores(str(public_tokenizers.path("piece_bpe_32k.model")))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    counts = {w: plain(scores, w) for t in docs.values() for w in t.split() if len(w) < 40}
    rows = queries.op6_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs) and all(r.n_pretokens == len(docs[r.doc_id].split()) for r in rows)
    for r in rows:
        if all(w in counts for w in docs[r.doc_id].split()):
            assert r.n_tokens == sum(counts[w] for w in docs[r.doc_id].split())


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "_NODES", 20)
    monkeypatch.setattr(token_counts, "_CHUNK", 50)
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    scores = unigram_scores(path)
    assert len(scores) > 31_000 and all(s < 0 for s in scores.values())
    texts = [None, "", " \n ", "The quick brown fox", "naïve 你好 \U0001f600 x", "same same same", "same same same", "z" * 5000, "word " * 10_000]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_pretokens, r.n_tokens) for r in count_tokens(df, path).collect()), key=str)
    want = [(i == 3, None if i == 3 else i, len((t or "").split()), sum(plain(scores, w) for w in (t or "").split()) if i < 8 else 10_000 * plain(scores, "word")) for i, t in enumerate(texts)]
    assert got == sorted(want, key=str)
    assert count_tokens(df.limit(0), path).count() == 0
