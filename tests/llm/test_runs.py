"""Runs against a search through all periods, and odd rows."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import runs


def by_search(words, times=4, least=6):
    """(start, length, period) of maximal stretches of each smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items() if n >= max(least, times * q))


def by_library(docs, **limits):
    number, ends = {}, np.cumsum([len(d) for d in docs])
    coded = np.array([number.setdefault(w, len(number)) for d in docs for w in d], dtype=np.int64)
    return [tuple(r) for r in runs.find_runs(coded, ends, **limits).tolist()]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_are_those_of_a_search(letters):
    rng = random.Random(letters)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(0, 5)):
            doc = []
            while len(doc) < rng.randint(0, 60):
                unit = [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
                doc += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
            docs.append(doc)
        for limits in ({}, {"times": 3, "least": 1}, {"times": 2, "least": 2}):
            want, at = [], 0
            for d in docs:
                want += [(s + at, n, q) for s, n, q in by_search(d, **{"times": 4, "least": 6} | limits)]
                at += len(d)
            assert by_library(docs, **limits) == sorted(want)


def test_long_periods_and_many_levels():
    rng = random.Random(9)
    unit = [rng.randrange(50) for _ in range(777)]
    doc = [*range(100, 200), *unit * 4, unit[0], 99, *[7] * 5000]
    assert by_library([doc]) == [(100, 4 * 777 + 1, 777), (100 + 4 * 777 + 2, 5000, 1)]
    assert by_library([[1] * 5]) == [] and by_library([[1] * 6]) == [(0, 6, 1)] and by_library([]) == []


def test_suffix_ranks_and_lcp():
    rng = random.Random(1)
    for _ in range(50):
        text = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        first = np.array([sum(y < x for y in text) for x in text])
        ranks = runs.suffix_ranks(first, np.argsort(first), np.full(len(text), len(text)), smallest=True)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert ranks[-1][:-1].tolist() == [want.index(i) for i in range(len(text))]
        lcp = [0] + [next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), len(text) - max(a, b)) for a, b in zip(want, want[1:])]
        assert runs.adjacent_lcp(ranks).tolist() == lcp


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_row(doc_id, text):
    words = runs.damaged(doc_id, [w.encode() for w in (text or "").split()])
    found = by_search(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = " ".join(w.decode() for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(listed), sha(kept))


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "a", "a a a a a a", "A a A a A a A a", "x y " * 30 + "z z z z z z z", "é " * 50, "w " * 3000 + "v", "m n o p " * 200]
    rows = [(i, t, 1) for i, t in enumerate(texts * 4)] + [(None, "b b b b b b b", 1)] * 2 + [(3, "a a a a a a", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs long").repartition(3)
    got = sorted((tuple(r) for r in runs.periodic_runs(df).collect()), key=repr)
    assert got == sorted((slow_row(d, t) for d, t, _ in rows), key=repr)
    assert runs.periodic_runs(df.where("false")).collect() == []
