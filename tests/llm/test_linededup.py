from collections import Counter

import numpy as np
import pytest

from tidemark.llm.cuckoo import CuckooFilter
from tidemark.llm.linededup import LineIndex, drop_common_lines, line_key

SCHEMA = "doc_id long, text string, n_lines string"
ROWS = [(i, f" Menu\t\nbody {i}\n\nMENU", "x") for i in range(5)] + [(9, None, None), (None, "menu", "y"), (10, "", ""), (11, "été\n" * 3, "")]


def brute(rows, least):
    keys = Counter(k for _, t, *_ in rows for k in {line_key(x) for x in (t or "").encode().split(b"\n")})
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [bool(line_key(x.encode())) and keys[line_key(x.encode())] >= least for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_clean_matches_brute_force(spark, broadcast_bytes):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    index = LineIndex.build(docs, min_docs=3)
    assert rows_of(index.clean(docs, broadcast_bytes)) == brute(ROWS, 3)


def test_columns_named_like_its_own_pass_through(spark):
    own = "row string, gone string, shard string, salt string, bits string, pos string"
    docs = spark.createDataFrame([(*r, *"abcdef") for r in ROWS], f"{SCHEMA}, {own}")
    index = LineIndex.build(docs, min_docs=3)
    for size in (1 << 20, -1):
        out = index.clean(docs, size)
        assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
        assert rows_of(out) == brute(ROWS, 3) and {tuple(r)[2:8] for r in out.collect()} == {tuple("abcdef")}


def test_insert_then_delete_restores(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    more = spark.createDataFrame([(20 + i, "été\nbody 1", "") for i in range(4)], SCHEMA)
    first = LineIndex.build(docs, min_docs=3)
    grown = first.insert(more)
    both = docs.union(more)
    want = brute([tuple(r) for r in both.collect()], 3)
    assert rows_of(grown.clean(both)) == want == rows_of(LineIndex.build(both, min_docs=3).clean(both))
    back = grown.delete(more)
    assert rows_of(back.clean(docs)) == brute(ROWS, 3)
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, first.counts.collect()))


def test_empty_table(spark):
    assert drop_common_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text_and_unfiltered_rows(spark):
    docs = spark.createDataFrame([(1, "a\n" * 100_000, "")], SCHEMA)
    assert rows_of(drop_common_lines(docs, min_docs=2)) == brute([tuple(r) for r in docs.collect()], 2)


def test_filter_has_no_false_negatives_and_deletes():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64) * np.uint64(2)
    held = CuckooFilter.build(hi, lo)
    assert held.contains(hi, lo).all()
    held.delete(hi[:2500], lo[:2500])
    assert held.contains(hi[2500:], lo[2500:]).all()
    assert held.contains(hi[:2500], lo[:2500]).sum() < 10


def test_clashing_names_come_back_by_either_way(spark):
    docs = spark.createDataFrame([(i, "menu\nown " + str(i), f"r{i}", i, "g", 2 * i) for i in range(12)], "doc_id long, text string, __row string, __of long, __gone string, n_lines long")
    index = LineIndex.build(docs, min_docs=10)
    want = sorted((i, f"own {i}", f"r{i}", i, "g", 2, 1) for i in range(12))
    for most in (64 << 20, 0):
        out = index.clean(docs, broadcast_bytes=most)
        assert out.columns == ["doc_id", "text", "__row", "__of", "__gone", "n_lines", "n_dropped"] and sorted(map(tuple, out.collect())) == want
