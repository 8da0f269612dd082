"""Each stage of the pipeline against a plain version, on its own input."""

import numpy as np
import pytest

import corpus_pipeline as cp
from frameloom.llm import queries
from tests.llm.test_decontaminate import plain as leaks
from tests.llm.test_near_copies import plain as components
from tests.llm.test_repeats import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs, docs.collect())]
    for name, stage in cp.STAGES:
        rows = stage(spark, out[-1][1], SF)
        made = rows.collect()
        out.append((name, spark.createDataFrame(made, rows.schema), made))
    return out


def test_all_but_the_last_return_the_columns_of_documents(steps):
    assert [n for n, *_ in steps[1:]] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    for _, df, _ in steps[1:-1]:
        assert df.dtypes == steps[0][1].dtypes


def test_quality_drops_what_the_query_rejects(spark, steps):
    rejected = {r.doc_id for r in queries.op3_quality(spark, SF).collect() if r.predicted == 0}
    assert rejected and {r.doc_id for r in steps[1][2]} == {r.doc_id for r in steps[0][2]} - rejected


def test_dedup_keeps_the_smallest_of_each_component(steps):
    before = steps[1][2]
    ids = [r.doc_id for r in before]
    low = components(ids, [r.text for r in before])
    assert {r.doc_id for r in steps[2][2]} == {i for i, c in zip(ids, low) if i == c}


def test_substrings(steps):
    want = {k: v[2].split() for k, v in brute([(r.doc_id, r.text) for r in steps[2][2]]).items()}
    got = {r.doc_id: r for r in steps[3][2]}
    empty = {r.doc_id for r in steps[2][2] if not (r.text or "").split()}
    assert set(got) == {k for k, v in want.items() if v or k in empty}
    assert all(got[k].text.split() == want[k] and got[k].n_chars == len(got[k].text) for k in got)


def test_decontamination(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = [(r.doc_id, r.text) for r in steps[3][2]]
    assert {r.doc_id for r in steps[4][2]} == {k for k, _ in before} - {k for k, _ in leaks(items, before)}


def test_packing(steps):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.byte_bpe_path())
    parts = {}
    for r in sorted(steps[5][2], key=lambda r: r.start):
        parts.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert parts == {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [1] for r in steps[4][2]}


def test_run_is_the_stages_in_order(spark, steps):
    got = sorted((r.doc_id, r.start, r.length) for r in cp.run(spark, SF).collect())
    want = {}
    for r in steps[5][2]:
        want[r.doc_id] = r.doc_tokens
    total = {}
    for k, _, n in got:
        total[k] = total.get(k, 0) + n
    assert total == want
