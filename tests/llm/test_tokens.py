import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm.bpe import ByteBpe
from frameloom.llm.common import fresh_path
from frameloom.llm.packing import differencing, pack, pack_block
from frameloom.llm.queries import byte_bpe_path
from frameloom.llm.token_files import read_token_files, write_token_files

TEXTS = [
    "The cat sat.  Two  spaces\n\n and lines \t tabs",
    "", None, " ", " lead", "trail ", "a b   c", "x <|endoftext|> y<|endoftext|>", "naïve über façade 你好 世界 don't we'll",
    "word " * 3000, "z" * 20000, "a\x1c b \x1d c", "\n a", "a \n", "x été École. naïve! ŝtel, Ħ ʼa ªb µm don't. 'tis a.b c... d\U0001f600. \x00. \x00.. it's' ƀɏ ɐ ꟊ.", "a.\nB c!\n\nD e\nf.\n\tg \nh i\n", "x\n<|endoftext|>\ny\nz", "12 34 !! ?? 'tis",
]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe_path())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1!' \n\t \x1cé你<|>")) | st.characters(codec="utf-8"), max_size=40))
def test_cuts_give_the_librarys_ids(text):
    from tokenizers import Tokenizer

    global _TOK, _BPE
    try:
        _TOK
    except NameError:
        _TOK, _BPE = Tokenizer.from_file(byte_bpe_path()), ByteBpe(byte_bpe_path(), "<u2")
    assert np.frombuffer(_BPE.encode(text), "<u2").tolist() == ids_of(_TOK, text)


def rows(spark):
    return spark.createDataFrame([(None if i == 5 else i * 3 % 31, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(40, "same", "x", 1)] * 2, "doc_id long, text string, ids string, shard int")


def test_files_round_trip(spark, tok):
    df = rows(spark)
    out = fresh_path(spark, "t")
    manifest = write_token_files(df, out, byte_bpe_path(), end_id=0, shards=3)
    got = read_token_files(spark, out).orderBy("start").collect()
    want = sorted(((r.doc_id, ids_of(tok, r.text) + [0]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in got] == [k for k, _ in want]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [i for _, i in want]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([len(i) for _, i in want])])[:-1].tolist()
    assert sum(s["n_tokens"] for s in manifest["shards"]) == sum(len(i) for _, i in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = fresh_path(spark, "t")
    write_token_files(df, out, byte_bpe_path(), shards=2)
    assert read_token_files(spark, out).count() == 0
    assert pack(df, byte_bpe_path()).count() == 0


def test_packing_is_a_partition_of_all_ids(spark, tok):
    df = rows(spark)
    got = pack(df, byte_bpe_path(), end_id=1).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id not in (None, 40):
            by_doc.setdefault(r.doc_id, []).append(r)
    for r in df.collect():
        if r.doc_id in by_doc:
            parts = sorted(by_doc[r.doc_id], key=lambda x: x.start)
            ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist()
            assert ids == ids_of(tok, r.text) + [1] and all(p.doc_tokens == len(ids) for p in parts)
            assert [p.start for p in parts] == np.concatenate([[0], np.cumsum([p.length for p in parts])])[:-1].tolist()
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= 2048


def test_differencing_is_nearly_equal():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 513, 700)
    windows = differencing(lengths, 90)
    assert sorted(i for w in windows for i in w) == list(range(700)) and len(windows) == 90
    sums = [int(lengths[w].sum()) for w in windows]
    assert max(sums) - min(sums) <= 16
    for case in ([], [5], [2048], [512] * 5, [1] * 3, [1500, 1500, 1500]):
        ws = pack_block(np.asarray(case, dtype=np.int64), 2048)
        assert sorted(i for w in ws for i in w) == list(range(len(case)))
        assert all(sum(case[i] for i in w) <= 2048 for w in ws)


def test_crc_is_of_32_bit_ids(spark, tok):
    from pyspark.sql import functions as F

    out = fresh_path(spark, "t")
    write_token_files(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), out, byte_bpe_path(), shards=1)
    got = read_token_files(spark, out).select(F.crc32("ids")).first()[0]
    assert got == zlib.crc32(np.asarray([*ids_of(tok, "some words"), 0], "<u4").tobytes())
