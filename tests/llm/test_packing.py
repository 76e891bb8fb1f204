"""Packing against the tokenizer's library on whole texts, and what any packing must keep."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing, queries

PATH = queries.tokenizer_path("word_bpe_49k.json")
ENCODER = packing.Encoder(PATH)
ODD_ROWS = [(1, None), (2, ""), (2, ""), (None, "a b"), (None, "a b"), (4, " \n "), (5, "Don't stop!! 12 <|endoftext|> x"), (6, "word " * 9000), (7, "x" * 30_000), (8, "été ÉTÉ 中文 ß")]


def by_library(text):
    return ENCODER.library.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZ bİé́  'sStl<|>1２.\n\x0b\x1c\x85ͅﬁßÀÿµ×÷ªΣ`_-~中", max_size=20), min_size=1, max_size=5))
def test_ids_are_the_librarys(texts):
    got = [ids.tolist() for _, ids in ENCODER.documents(enumerate(t.encode() for t in texts), 0)]
    assert got == [by_library(t) for t in texts]


def test_ids_of_texts_longer_than_a_stretch(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 50)
    text = "don't <|endoftext|> 12 " * 40 + "y" * 200 + " end\nof it"
    assert [ids.tolist() for _, ids in ENCODER.documents([(0, text.encode()), (1, b"a")], 0)] == [by_library(text), by_library("a")]


def test_the_fullest_bin_that_fits_takes_a_piece_and_the_fullest_closes():
    bins = packing.Bins(10, 2)
    closed = [[r for r, _ in h] for size, name in ((6, "a"), (5, "b"), (4, "c"), (7, "d"), (5, "e"), (10, "f"), (9, "g")) for h in bins.put(size, name)]
    assert closed == [["a", "c"], ["b", "e"], ["f"]]
    assert sorted(r for h in bins.rest() for r, _ in h) == ["d", "g"]
    full = packing.Bins(10, 1)
    assert [*full.put(6, "a")] == [] and [*full.put(7, "b")] == [[("a", 0)]] and [*full.rest()] == [[("b", 0)]]


def check(rows, texts, capacity):
    """rows hold every document's tokens once, in sequences without gaps; gives their number."""
    docs, places = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in texts:
        ids = np.array(by_library(text), dtype="<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[doc_id].append((k, a, len(part), zlib.crc32(part.tobytes())))
    assert {d: sorted(x) for d, x in docs.items()} == {d: sorted(x) for d, x in want.items()}
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(n for x in want.values() for _, _, n, _ in x)


@pytest.mark.parametrize("parts, bins", [(1, 512), (7, 3), (40, 1)])
def test_odd_rows_are_packed_whole(spark, parts, bins):
    rows = [(*r, 5, "s") for r in ODD_ROWS for _ in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id long, offset string").repartition(parts)
    n, tokens = check(packing.pack(df, PATH, 256, bins).collect(), [r[:2] for r in rows], 256)
    assert n <= 2 * tokens / 256 + parts * bins


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert packing.pack(df, PATH).collect() == [] and packing.pack(df, PATH).schema["doc_id"].dataType.simpleString() == "string"


def test_query_needs_few_sequences(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    n, tokens = check(queries.op11_best_fit_packing(spark, sf).collect(), texts, 2048)
    assert n <= 1.02 * tokens / 2048 + 1


def test_rounds_pack_as_tightly_as_one_task(spark):
    rng = np.random.default_rng(4)
    texts = [(i, "a " * int(n)) for i, n in enumerate(rng.integers(1, 200, 6000))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    one, tokens = check(packing.pack(df.coalesce(1), PATH, 256, 64).collect(), texts, 256)
    many, _ = check(packing.pack(df.repartition(60), PATH, 256, 64).collect(), texts, 256)
    assert many <= 1.01 * one and one <= 1.03 * tokens / 256
