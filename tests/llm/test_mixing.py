import numpy as np
import pytest

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string"


def brute_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, capped = share * sum(sizes.values()), set()
    while True:
        left = goal - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in open_) for s in names}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def rows():
    rng = np.random.default_rng(2)
    out = []
    for s, n in [("b", 300), ("a", 40), ("é", 5), (None, 60), ("z", 3)]:
        out += [(len(out) + i, " ".join(["w"] * int(k)), s, "x") for i, k in enumerate(rng.integers(0, 60, n))]
    return out + [(None, None, "a", "x"), (None, None, "a", "x"), (7777, "w " * 3000, "b", "x"), (0, out[0][1], "b", "x")]


@pytest.mark.parametrize("chunk", [1000, 7])
def test_mix(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    for s, total in sizes.items():
        own = [r for r in got if r.source == s]
        assert all(r.source_size == total and abs(r.target - want[s]) < 1e-6 for r in own)
        largest = max(r.size for r in own)
        assert abs(sum(r.copies * r.size for r in own) - want[s]) <= largest
        rate = want[s] / total
        assert all(np.floor(rate) <= r.copies <= min(2, np.ceil(rate)) for r in own if r.size)
    again = mixing.mix(spark.createDataFrame(data[::-1], SCHEMA)).collect() if chunk == 1000 else got
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_take_repeats_rows(spark):
    data = [(*r, 7, 8, 9, 10) for r in rows()]
    names = "copies long, size long, draw long, __copy long"  # as take() has its own
    docs = spark.createDataFrame(data, f"{SCHEMA}, {names}")
    copies = sum(r.copies for r in mixing.mix(docs).collect())
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == copies
    assert {tuple(r) for r in taken.collect()} <= set(data)


def test_targets_are_met_to_a_short_document(spark):
    rng = np.random.default_rng(5)
    data = [(i, "w " * int(k), "ab"[i % 2], "x") for i, k in enumerate(rng.pareto(1.0, 3000) * 8 + 1) if k < 20_000]
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 40


def test_rounding_is_unbiased():
    rng = np.random.default_rng(0)
    size, part = rng.integers(1, 50, 21).astype(float), np.full(21, 0.3)
    mean = np.zeros(21)
    for _ in range(3000):
        out = mixing._round_group(size, part, rng.random(21))
        assert abs((out * size).sum() - (part * size).sum()) < 1e-6
        mean += out / 3000
    assert np.abs(mean - 0.3).max() < 0.05


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, "")], SCHEMA)).first().copies == 0


def test_rounding_keeps_sums_and_expectations():
    rng = np.random.default_rng(4)
    size = np.sort(rng.integers(1, 50, 12).astype(float))[::-1]
    for part in (np.full(12, 0.3), rng.random(12)):
        total, n = np.zeros(12), 4000
        for _ in range(n):
            out = mixing._round_group(size, part, rng.random(12))
            assert abs((size * out).sum() - (size * part).sum()) < 1e-6
            assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
            total += out
        assert np.abs(total / n - part).max() < 0.04
