import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import repeats
from frameloom.llm.repeats import cut_repeats, remove_repeats


def brute(rows, window=20):
    """rows: (id, text); ids without nulls and repeats."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            gram = tuple(words[i : i + window])
            if gram in seen:
                gone.update(range(i, i + window))
            seen.add(gram)
        out[key] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"wö{i}" for i in range(60)] + ["a", "b"]
    passages = [rng.choices(vocabulary, k=rng.choice([19, 20, 21, 50, 120])) for _ in range(6)]
    texts = [None, "", "  \n", "one", "a " * 500, "a b " * 40, "x y " * 9 + "x", " ".join(["z"] * 20), " ".join(["z"] * 21)]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += rng.choices(vocabulary, k=rng.randint(0, 40)) + rng.choice(passages)[rng.randint(0, 3) :]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    texts += texts[10:20] + ["long " + " ".join(rng.choices(vocabulary, k=30_000)) + " " + " ".join(passages[0] * 2)]
    ids = rng.sample(range(-50, 2000), len(texts))
    return list(zip(ids, texts))


def check(spark, rows, **options):
    df = spark.createDataFrame([(k, t, "clash", 3) for k, t in rows], "doc_id long, text string, kept string, doc int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, **options).collect()}
    assert got == brute(rows, options.get("window", 20))


def test_against_brute_force(spark, monkeypatch):
    check(spark, corpus(1))
    monkeypatch.setattr(repeats, "GROUP_BYTES", 1 << 12)
    monkeypatch.setattr(repeats, "_CHUNK", 1 << 9)
    monkeypatch.setattr(repeats, "_MEMORY", 50)
    monkeypatch.setattr(repeats, "_SETTLE", 1 << 12)
    check(spark, corpus(2), first_prefix=3)
    check(spark, corpus(3), window=7, first_prefix=7)
    check(spark, corpus(3), window=1)
    monkeypatch.setattr(repeats, "LONG_RUNS", 3)  # nearly all prefixes are made longer
    check(spark, corpus(4), first_prefix=2)
    check(spark, corpus(5))
    check(spark, corpus(6), window=300, first_prefix=30)


@pytest.mark.parametrize("power", [10, 11, 12])
def test_words_that_polynomial_hashes_confuse(spark, power):
    word = "a"
    for _ in range(power):
        word += word.translate(str.maketrans("ab", "ba"))
    other, same = word.translate(str.maketrans("ab", "ba")), " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{same} {word}"), (2, f"{same} {other}"), (3, f"x {same} {word}")]
    check(spark, rows)


def test_nodes_are_sequences_of_words():
    rng = random.Random(8)
    words = [rng.choice(["a", "b", "ab", "ba"]) for _ in range(3000)]
    numbers = repeats.word_numbers(" ".join(words).encode())
    assert [numbers[i] == numbers[0] for i in range(3000)] == [w == words[0] for w in words]
    for depth in (1, 2, 5, 20):
        node = repeats.tree_nodes(numbers, depth).tolist()
        grams = [tuple(words[i : i + depth]) for i in range(len(words) - depth + 1)]
        assert len(node) == len(grams) and len(set(zip(node, grams))) == len(set(node)) == len(set(grams))


def test_prefixes_grow_to_the_window():
    assert repeats.prefix_lengths(20) == [4, 8, 20]
    assert repeats.prefix_lengths(1) == [1] and repeats.prefix_lengths(7, 7) == [7]
    planner = repeats.Planner(20, [4, 8, 20], [])
    data = " ".join(f"w{i}" for i in range(500)).encode()
    counts = np.asarray([500])
    _, start, n, path, length, a, b = planner.runs(np.frombuffer(data, np.uint8), counts)
    assert n.sum() == 481 and set(length.tolist()) == {4} and len(n) < 100
    longer = repeats.Planner(20, [4, 8, 20], [np.sort(path)])
    assert set(longer.runs(np.frombuffer(data, np.uint8), counts)[4].tolist()) == {8}
    whole = repeats.Planner(20, [4, 8, 20], [np.sort(path), np.sort(longer.runs(np.frombuffer(data, np.uint8), counts)[3])])
    assert whole.runs(np.frombuffer(data, np.uint8), counts)[2].tolist() == [1] * 481


def test_spans_name_the_removed_words(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, text), (2, "head " + text + " tail")], "doc_id long, text string")
    rows = {r.doc_id: np.frombuffer(r.spans, "<u4").tolist() for r in remove_repeats(df).collect()}
    assert rows == {1: [], 2: [1, 26]}


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text), (7, text + " more"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(df).collect()), key=str)
    # The row without an id comes first; rows that repeat id and text share a result.
    assert got == sorted([(None, 30, 0), (5, 30, 30), (5, 30, 30), (7, 30, 30), (7, 31, 30), (9, 0, 0)], key=str)
    twice = spark.createDataFrame([(5, text), (5, text)], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeats(twice).collect()] == [0, 0]
    assert remove_repeats(df.limit(0)).count() == 0


def test_cut_keeps_layout_and_columns(spark):
    text = "\n".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, text, "a"), (2, "head\n\n" + text + "\nlast  words", "b"), (3, text, "c"), (4, None, "d"), (5, "  odd  space ", "e"), (None, text + " end", "f")], "doc_id long, text string, doc string").withColumns({"twin": F.lit(1), "found": F.lit("x"), "0": F.lit(2)})
    got = cut_repeats(df)
    assert got.schema == df.schema
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == {None: text + " end", 2: "head\n\nlast  words", 4: None, 5: "  odd  space "}
    assert {(r.doc_id, r.doc, r.twin, r.found) for r in rows} == {(None, "f", 1, "x"), (2, "b", 1, "x"), (4, "d", 1, "x"), (5, "e", 1, "x")}


def test_rows_sent_grow_as_the_text_does():
    rng = random.Random(9)
    docs = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=400)) for _ in range(400)]
    batch = repeats._as_batch([])
    for bits in (4, 8, 12):
        planner = repeats.Planner(20, [4, 8, 20], [])
        halves = [repeats.pa.RecordBatch.from_pydict({"doc": list(range(len(d))), "twin": list(range(len(d))), "text": [t.encode() for t in d]}) for d in (docs[:200], docs[200:])]
        made = list(repeats._grouped_runs(planner, bits)(iter(halves)))
        sizes = [len(r.as_py()) for b in made for r in b.column(1)]
        assert {b.schema for b in made} == {batch.schema}
        # Pieces of one bundle wait for one another: never more than a short row each.
        text = sum(map(len, docs)) * 3
        assert len(sizes) <= 2**bits + 2 * text / repeats._PIECE


def test_pieces_of_many_bundles_against_brute_force(spark, monkeypatch):
    for name, value in (("GROUP_BYTES", 1 << 10), ("_BUNDLE", 2), ("_PIECE", 1 << 9), ("_PENDING", 1 << 13), ("_SETTLE", 1 << 11)):
        monkeypatch.setattr(repeats, name, value)
    check(spark, corpus(7))
    monkeypatch.setattr(repeats, "_PENDING", 1)
    check(spark, corpus(8), window=5)
