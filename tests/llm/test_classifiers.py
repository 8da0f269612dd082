import functools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from frameloom.llm import langid, queries
from frameloom.llm.boosting import fit
from frameloom.llm.langid import Predictor, fit_languages, identify, words_of
from frameloom.llm.quality import fit_quality, keep_quality, score_quality
from frameloom.llm.textstats import NAMES, Statistics

SF = "/root/testdata/sf0.01"


def test_forest_descends_as_one_row_at_a_time():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = fit(x, y, trees=20, depth=3)
    for row, got in zip(x[:50], forest.margin(x[:50])):
        want = forest.base
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            want += leaf[node - len(f)]
        assert got == pytest.approx(want)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    assert np.allclose(fit(x[:0], y[:0]).score(x[:3]), 0.5)
    assert (fit(x, np.ones(800)).score(x[:3]) > 0.9).all()


def test_statistics_against_plain_counts():
    import pyarrow as pa

    texts = ["Ab cd. Ab cd.\nAb cd. Ab cd.\n", None, "", "A", "ÉÉ !! x|y $$ 12", " \n ", "w " * 2000, "no end\n\nagain\nno end"]
    got = Statistics().of(pa.array(texts))
    at = {n: i for i, n in enumerate(NAMES)}
    for row, text in zip(got, texts):
        raw = (text or "").encode()
        words = raw.split()
        assert row[at["share_upper"]] == pytest.approx(sum(65 <= b <= 90 for b in raw) / max(1, len(raw)))
        assert row[at["share_tail"]] == pytest.approx(sum(128 <= b < 192 for b in raw) / max(1, len(raw)))
        assert row[at["log_words"]] == pytest.approx(math.log1p(len(words)))
        assert row[at["distinct_words"]] == pytest.approx(len(set(words)) / max(1, len(words)))
        assert row[at["commonest_word"]] == pytest.approx(max(Counter(words).values(), default=0) / max(1, len(words)))
        pairs = list(zip(words, words[1:]))
        assert row[at["distinct_pairs"]] == pytest.approx(len(set(pairs)) / max(1, len(words) - 1))
        lines = [tuple(x.split()) for x in raw.split(b"\n") if x.split()]
        assert row[at["repeated_lines"]] == pytest.approx(1 - len(set(lines)) / max(1, len(lines)) if lines else 1)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = queries.op3_quality(spark, SF).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "Some text here.", 1), (2, None, 1), (None, "", 1), (1, "Some text here.", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    assert score_quality(docs, model).count() == 4 and score_quality(docs.limit(0), model).count() == 0
    assert keep_quality(docs, model, 0.3).schema == docs.schema and keep_quality(docs, model, 0.3).count() == 4
    assert fit_quality(docs, labels.limit(0)).score(np.zeros((1, len(NAMES)))) == pytest.approx(0.5)


def test_language_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def plain_languages(rows, longest=5, penalty=-14.0):
    """Predictions of (text) -> (language, score), from (text, lang) rows; written
    from the rules alone."""
    letters = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    split = lambda text: letters.findall((text or "").lower())
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)
    counts = defaultdict(Counter)
    for text, lang in rows:
        for w in split(text):
            counts[0, lang][w] += 1
            for n in range(1, longest + 1):
                counts[n, lang].update(grams(w, n))
    names = sorted({lang for _, lang in counts})
    totals = {key: sum(c.values()) for key, c in counts.items()}

    def logs(n, gram):
        found = [counts[n, x][gram] for x in names]
        return [math.log(f / totals[n, x]) if f else penalty for f, x in zip(found, names)] if any(found) else None

    @functools.cache
    def word(w):
        if own := logs(0, w):
            return own
        for n in range(longest, 0, -1):
            if known := [x for g in grams(w, n) if (x := logs(n, g))]:
                return [sum(c) / len(known) for c in zip(*known)]
        return [penalty] * len(names)

    def predict(text):
        words = split(text)
        if not words or not names:
            return "und", 0.0
        total = [math.fsum(c) for c in zip(*map(word, words))]
        best = max(total)
        weights = [math.exp(max(-50.0, (t - best) / math.sqrt(len(words)))) for t in total]
        return names[total.index(best)], 1 / sum(weights)

    return predict


def test_language_query_against_a_plain_version(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fold = lambda k: zlib.crc32(str(k).encode()) % 4
    predict = plain_languages([(r.text, r.lang) for k, r in docs.items() if fold(k) != 2 and r.lang])
    got = queries.op4_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        lang, score = predict(docs[r.doc_id].text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3) and r.held_out == (fold(r.doc_id) == 2)


def test_letters(spark):
    assert words_of("Ⅷ ½ x² ③ 12_a") == ["x", "a"] and words_of("e\u0301te\u0301 naïve") == ["e\u0301te\u0301", "naïve"]
    docs = spark.createDataFrame([(1, "one " + "a" * 50, "en"), (2, "½ ² ③ Ⅷ", "en")], "doc_id long, text string, lang string")
    model = fit_languages(docs)
    assert "a" * 50 in model.tables[0]
    assert {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, model).collect()}[2] == ("und", 0.0)


def test_language_backoff_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(langid, "_MEMORY", 3)
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en", 0.5), (2, "le chat et le chien", "fr", 0.5), (3, "la la", None, 0.1), (None, "el gato", "es", 0.1), (5, None, "en", 0.0), (6, "12 !! __", "fr", 0.0), (7, "", "en", 0.0), (8, "Chats! " * 30_000, "fr", 0.0)],
        "doc_id long, text string, lang string, score double",
    )
    model = fit_languages(docs)
    assert model.names == ["en", "fr"]
    assert model.rows[0][model.tables[0]["the"]][0] == pytest.approx(math.log(2 / 5))
    got = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert got[1] == "en" and got[2] == "fr" and got[8] == "fr" and got[5] == got[6] == got[7] == "und"
    predictor, plain = Predictor(model), plain_languages([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("Chats! " * 30_000, "fr")])
    for text in ("the chats qqq", "theology", "zzz", "chatte dogs"):
        assert predictor.of(text) == (plain(text)[0], pytest.approx(plain(text)[1], abs=1e-4))
    assert identify(docs.limit(0), model).count() == 0
    none = fit_languages(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"}
    assert fit_languages(docs, where=F.col("doc_id") == 1).names == ["en"]


ODD_RUNS = ["ΟΔΟΣ, ΟΔΟΣ ΣΑΣ.σ", "İstanbul's IŞIK", "e\u0301te\u0301! \u0301te x²y Ⅷa 12_a", "l'eau,d'eau;L'EAU", "a," * 300 + "chats", "你好，你们\u3000好\xa0吗", "z" * 500 + "-the", "\x1cthe\x85cat ...", "12 !!", "", None]


def test_words_are_looked_for_once_in_each_run(spark, monkeypatch):
    rows = [("the cat and the dog", "en"), ("le chat et l'eau", "fr"), ("οδος σας σασ", "el"), ("你好 吗", "zh"), (" ".join(x or "" for x in ODD_RUNS), "odd")]
    model, plain = fit_languages(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")), plain_languages(rows)
    assert model.names == ["el", "en", "fr", "odd", "zh"]
    predictor, read = Predictor(model), []
    for texts in (ODD_RUNS, ODD_RUNS[::-1], [" ".join(x or "" for x in ODD_RUNS)], []):
        got, want = predictor.all(texts), list(map(plain, texts))
        assert [lang for lang, _ in got] == [lang for lang, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-4)
    monkeypatch.setattr(langid, "words_of", lambda text: read.append(text) or words_of(text))
    text = "The chats, l'eau; théologie 3dogs " * 5000
    assert predictor.of(text) == (plain(text)[0], pytest.approx(plain(text)[1], abs=1e-4))
    assert sum(map(len, read)) < 100


def test_texts_are_not_dealt_by_language(spark, monkeypatch):
    plans, write = [], langid.materialize
    monkeypatch.setattr(langid, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = fit_languages(spark.createDataFrame([(i, f"cat {i % 3 * 'x'} dog", "en" if i % 2 else "fr") for i in range(50)], "doc_id long, text string, lang string"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert model.rows[0][model.tables[0]["cat"]] == pytest.approx([math.log(25 / n) for n in (50 + sum(i % 3 > 0 for i in range(1, 50, 2)), 50 + sum(i % 3 > 0 for i in range(0, 50, 2)))])
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


@pytest.mark.parametrize("most", [50, 300_000])
def test_counts_are_passed_on_before_they_are_many(monkeypatch, most):
    import pyarrow as pa

    monkeypatch.setattr(langid, "_COUNTED", most)
    texts = [("en" if i % 2 else "fr", " ".join(f"{'abcdé'[i % 5]}{'xyz'[j % 3] * j},q-{j}" for j in range(20))) for i in range(30)]
    passed = []

    def run(f, rows, names):
        found = Counter()
        for batch in f(iter([pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), names=names)])):
            passed.append(batch.num_rows)
            for *key, n in zip(*(c.to_pylist() for c in batch.columns)):
                found[tuple(key)] += n
        return found

    words = run(langid._word_counts, texts, ["lang", "text"])
    assert words == Counter((lang, w) for lang, text in texts for w in words_of(text))
    grams = run(langid._gram_counts(5), [(*key, n) for key, n in words.items()], ["lang", "word", "n"])
    want = Counter({(lang, 0, w): n for (lang, w), n in words.items()})
    for (lang, w), times in words.items():
        for n in range(1, 6):
            for g in langid.grams_of(w, n):
                want[lang, n, g] += times
    assert grams == want and (max(passed) < 200 and len(passed) > 20 if most == 50 else len(passed) <= 16)
