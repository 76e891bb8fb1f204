import numpy as np
import pytest

from tidemark.llm import substrings

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, window):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, substrings.LAST), substrings.LAST if i is None else i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < (substrings.LAST if i is None else i):
                gone[at : at + window] = [True] * window
        out.append((i, b" ".join(w for w, g in zip(words, gone) if not g).decode(), len(words), sum(gone)))
    return sorted(out, key=repr)


def corpus(n=120, seed=1):
    rng = np.random.default_rng(seed)
    passages = [[f"p{k}x{j}" for j in range(k + 8)] for k in range(30)]
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 30, rng.integers(0, 40))]
        for k in rng.integers(0, 30, 2):
            cut = int(rng.integers(0, 6))
            words += passages[k][cut:] + [f"w{k}"]
        rows.append((int(i * 7 % n), " \n".join(words)))
    rows += [(500, rows[3][1]), (501, rows[3][1] + " Été " + rows[5][1]), (500, rows[3][1]), (None, rows[4][1]), (None, None), (502, ""), (503, "a " * 40), (504, "a " * 30)]
    return rows


@pytest.mark.parametrize("batch", [4 << 20, 2000, 600])
def test_matches_brute_force(spark, batch):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(2)
    got = substrings.remove_repeats(docs, 13, batch).collect()
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got), key=repr) == brute(rows, 13)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_long_document(spark):
    words = [f"w{i * i % 9973}" for i in range(30_000)]
    rows = [(1, " ".join(words[5000:])), (2, " ".join(words))]
    got = substrings.remove_repeats(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), 13).collect()
    assert sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == brute(rows, 13)


@pytest.mark.parametrize("window", [1, 2, 5, 6])
def test_other_windows(spark, window):
    rng = np.random.default_rng(window)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 4, rng.integers(0, 25)))) for i in range(40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(2)
    got = substrings.remove_repeats(docs, window, 300).collect()
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got), key=repr) == brute(rows, window)


def test_windows_of_one_hash_do_not_remove_each_other():
    """The automaton works on words: passages nominated by mistake find nothing."""
    texts = [" ".join(f"a{k}" for k in range(20)).encode(), " ".join(f"b{k}" for k in range(20)).encode()]
    shard = substrings.Shard([5, 9], texts, 13)
    shard.codes = np.zeros_like(shard.codes)
    assert not any(g.any() for g in shard.removals([(1, [b"c"] * 30), (2, [b"a3"] * 13)]))
    found = shard.removals([(1, [b"x", *texts[1].split()[2:16], b"y"])])
    assert not found[0].any() and np.flatnonzero(found[1]).tolist() == list(range(2, 16))


def test_periodic_text_of_many_words(spark):
    rows = [(1, "a b " * 5000), (2, "a b " * 10_000 + "c"), (3, "b " * 20_000), (4, "b " * 30)]
    got = substrings.remove_repeats(spark.createDataFrame([(*r, "") for r in rows], SCHEMA).coalesce(1), 13).collect()
    assert sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == brute(rows, 13)


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
