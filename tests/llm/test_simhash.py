import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from frameloom.llm import simhash
from frameloom.llm.components import connected_components
from frameloom.llm.simhash import covering_masks, fingerprint, near_duplicates, near_links


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", words)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def closure(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, k in enumerate(ids):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [low.get(find(i)) for i in range(len(ids))]


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for free in ((1 << 64) - 1, (1 << 34) - 1 << 9, 0b1011011110111 << 20):
        masks, places = covering_masks(free, 3), [i for i in range(64) if free >> i & 1]
        for _ in range(400):
            flip = sum(1 << p for p in rng.sample(places, rng.randint(1, 3)))
            assert any(not m & flip for m in masks)
        assert all(m.bit_count() >= max(1, len(places) // 15 * 8) for m in masks)


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One", "one two", "ÉCOLE École", "a b c", "A B\tc"]
    for _ in range(30):
        words = rng.choices(vocabulary, k=rng.choice([2, 3, 30, 300]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["x y z " * 50_000, texts[-1], texts[-1]]
    ids = [None, *range(500, 500 - len(texts) + 1, -1)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, component_id int")
    got = sorted(near_duplicates(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    fps = [plain(t) for t in texts]
    want = sorted(zip(ids, fps, closure(ids, fps)), key=lambda r: (r[0] is not None, r[0]))
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in got] == [(i, f"{f:016x}", c) for i, f, c in want]
    assert near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_are_split_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = random.Random(3)
    fps = {0}
    for base in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(150):
            fps.add(base ^ sum(1 << p for p in rng.sample(range(14), 3)))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in connected_components(near_links(df)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = closure(signed, fps)
    assert [roots.get(s, s) for s in signed] == want


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (5, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 200)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_counts_repeats():
    for text in ("a a a a a", "a b a b a b c", "x" * 100_000, "q " * 1000):
        assert fingerprint(text.encode()) == plain(text)


@pytest.mark.parametrize("rest", [0, 1, 2, 3])
def test_the_rest_of_an_overflowed_bucket_goes_on(monkeypatch, rest):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    fps = [(i << 8) | 5 for i in range(20 + rest)]  # one bucket: equal under the mask
    pair = [(1 << 40) | 6, (1 << 41) | 6]  # and another one behind it
    batches = [pa.RecordBatch.from_pydict({"mask": [255] * len(x), "fp": x}) for x in (fps[:20], fps[20:] + pair)]
    out = [r for made in simhash._compare_buckets(3)(iter(batches)) for r in made.to_pylist()]
    assert sorted(r["a"] for r in out if r["mask"] == 255) == fps
    assert [(r["a"], r["b"]) for r in out if not r["mask"]] == [tuple(pair)]
