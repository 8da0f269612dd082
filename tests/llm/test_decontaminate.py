import random
import re

import numpy as np

from frameloom.llm import decontaminate
from frameloom.llm.decontaminate import Index, build_indexes, find_leaks, keep_clean

SF = "/root/testdata/sf0.01"


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "é"] * 20
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, f"{say(rng.randint(6, 40))}? {say(rng.randint(1, 9))}.") for i in range(70)] + [(70, "alone five words are here"), (71, None), (None, say(9)), (72, " ?! ")]
    texts = [None, "", say(3)]
    for _ in range(80):
        body = say(rng.choice([0, 5, 200, 900]))
        for _, leak in rng.sample(items[:71], rng.choice([0, 0, 1, 2])):
            words = leak.split()
            style = rng.random()
            if style < 0.3:
                leak = leak.upper().replace(" ", "\n ")
            elif style < 0.5:
                leak = " ".join(words[: max(1, int(len(words) * rng.random()))])
            body = f"{body[: len(body) // 2]} {leak} {body[len(body) // 2 :]}"
        texts.append(body)
    texts.append(say(40_000) + " " + items[3][1] + " " + say(9))
    return items, list(enumerate(texts))


def grams(words, n):
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain(items, docs, overlap=0.8):
    """Leaks by the rules of the module's description, with code of its own."""
    split = lambda text: re.findall(r"\w+", (text or "").lower())
    known = []
    for key, text in items:
        if key is None or not split(text):
            continue
        parts = [split(x) for x in re.split(r"(?<=[.?!:])\s+", text) if split(x)]
        known.append((key, [w for p in parts[:-1] for w in p] if len(parts) > 1 else parts[0], parts[-1] if len(parts) > 1 else []))
    longest = max(len(split(t)) for k, t in items if k is not None)
    stride, out = max(32, longest + longest // 4), set()
    for key, text in docs:
        words = split(text)
        for at in range(0, max(1, len(words) - stride), stride):
            passage = words[at : at + 2 * stride]
            for item, question, answer in known:
                n, m = min(5, len(question) + len(answer)), min(5, len(question))
                whole, asked = grams(question + answer, n), grams(question, m)
                left, hits = list(passage), 0
                for w in answer:
                    if w in left:
                        left.remove(w)
                        hits += 1
                both = len(asked & grams(passage, m)) >= overlap * len(asked) and hits >= overlap * len(answer)
                if len(whole & grams(passage, n)) >= overlap * len(whole) or both:
                    out.add((key, item))
    return out


def test_query_and_stage_against_brute_force(spark):
    from frameloom.llm import queries

    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op10_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain(items, docs)


def test_against_brute_force(spark):
    for seed in (1, 2):
        items, docs = make(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        df = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, item_id string, score int")
        want = plain(items, docs)
        got = [(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
        kept = keep_clean(df, bench)
        assert kept.schema == df.schema
        assert {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - {k for k, _ in want}


def test_many_indexes_agree_with_one(spark, monkeypatch):
    items, docs = make(3)
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    one = {(r.doc_id, r.item_id, round(r.score, 4)) for r in find_leaks(df, bench).collect()}
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 30)
    assert len(build_indexes(bench)) == 3
    many = {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()}
    assert many == {x[:2] for x in one}


def test_search_returns_all_above_the_threshold(spark):
    items, _ = make(4)
    (index,) = build_indexes(spark.createDataFrame(items, "item_id long, text string"))
    assert isinstance(index, Index)
    dense = np.zeros((len(index.terms), len(index.items)))
    for t in range(len(index.terms)):
        for r in range(index.first[t], index.first[t + 1]):
            lo = index.block[r] * decontaminate.BLOCK
            width = min(decontaminate.BLOCK, len(index.items) - lo)
            dense[t, lo : lo + width] += index.weights[r, :width]
    assert np.allclose(dense.sum(axis=0), 1, atol=1e-5)
    rng = np.random.default_rng(0)
    has = rng.random((40, len(index.terms))) < rng.random((40, 1))
    p, t = np.nonzero(has)
    scores = has @ dense
    got = set(zip(*(x.tolist() for x in index.search(p, t, 40, 0.5)[:2])))
    assert got == {(a, b) for a, b in zip(*np.nonzero(scores >= 0.5))}


def test_cursors_skip(spark, monkeypatch):
    """Fewer rows are looked at than the passages' lists have."""
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"t{x}" for x in rng.choice(3000, 30))) for i in range(2000)]
    (index,) = build_indexes(spark.createDataFrame(items, "item_id long, text string"))
    passages = [sorted({index.terms[w] for i in rng.choice(2000, 2) for w in items[i][1].split()[: rng.integers(5, 31)]}) for _ in range(50)]
    p, t = np.repeat(np.arange(50), [len(x) for x in passages]), np.concatenate(passages)
    moved = []
    whole = Index._move
    monkeypatch.setattr(Index, "_move", lambda self, at, here, which, *rest: (moved.append(int(which.sum())), whole(self, at, here, which, *rest)))
    found = set(zip(*(x.tolist() for x in index.search(p, t, 50, 0.8)[:2])))
    assert sum(moved) < 0.85 * sum(index.first[x + 1] - index.first[x] for x in t)
    assert found and all(0 <= i < 2000 for _, i in found)


def test_nulls_repeats_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "what is the very long question here? an answer."), (1, "what is the very long question here? an answer.")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x what is the very long question here? an answer. y"), (4, "What is the VERY long question here an answer"), (4, "What is the VERY long question here an answer"), (5, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()), key=str)
    assert got == sorted([(None, 1), (4, 1), (4, 1)], key=str)
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0
    assert keep_clean(docs, bench.limit(0)).count() == 4 and keep_clean(docs, bench).count() == 1
