import random

import pytest

import corpus_pipeline as cp
from frameloom.llm import near_copies as nc

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(ids, texts):
    """Components of all pairs with a similarity of 0.8 or more."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= 0.8:
                root[find(i)] = find(j)
    low = {}
    for i, k in enumerate(ids):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [low.get(find(i)) for i in range(len(ids))]


def test_the_stage_drops_near_copies_beyond_three_bits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    low = plain([r.doc_id for r in rows], [r.text for r in rows])
    kept = {r.doc_id for r in cp.near_dedup(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r, c in zip(rows, low) if r.doc_id == c}


def test_the_plan_brings_pairs_at_the_threshold_together():
    for nodes in (1, 10**4, 10**6, 10**9, 4 * 10**10):
        p = nc.plan(nodes, 0.8)
        assert 2**p.width * nc.FILL**2 >= nodes**2 or p.width == 64
        rng = random.Random(nodes)
        seen = sum(any(sum(rng.random() < 0.1515 for _ in range(p.width)) <= p.radius for _ in range(p.pieces)) for _ in range(2000))
        assert seen >= 1980


def test_masks_cover_every_pair_within_the_radius_of_a_piece():
    rng = random.Random(2)
    p = nc.plan(100_000, 0.8)
    for _ in range(500):
        a = rng.getrandbits(p.width)
        b = a
        for i in rng.sample(range(p.width), p.radius):
            b ^= 1 << i
        assert any(a & m == b & m for m in p.masks)


@pytest.mark.parametrize("few, large", [(16, 20_000), (2, 20_000), (1, 3)])
def test_against_brute_force(spark, monkeypatch, few, large):
    monkeypatch.setattr(nc, "FEW", few)
    monkeypatch.setattr(nc, "LARGE", large)
    monkeypatch.setattr(nc, "PIVOTS", 2)
    monkeypatch.setattr(nc, "_GROUP", 50)
    monkeypatch.setattr(nc, "MISS", 1e-5)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n", "One two", "one  TWO", "one two three"]
    for _ in range(20):
        words = rng.choices(vocabulary, k=rng.choice([5, 40, 200, 1500]))
        for _ in range(rng.choice([1, 3, 12])):  # edits of edits: chains of near copies
            words = list(words)
            for _ in range(len(words) // 90):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words + rng.choices(vocabulary, k=rng.choice([0, len(words) // 6]))))
    ids = [None, *range(900, 900 - len(texts) + 1, -1)]
    found = nc.near_copies(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(zip(ids, plain(ids, texts)))
    assert nc.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
