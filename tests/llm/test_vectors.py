import numpy as np
import pytest

from tidemark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows, threshold):
    """Links over all pairs of usable rows, components by repeated relabelling."""
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    n, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    links = [(i, j) for a, (i, x) in enumerate(ok) for j, y in ok[:a] if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold]
    for i, j in links:
        n[i] += 1
        n[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in links:
            least = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = least
    return {(i, n[i], label[i], label[i] == i) for i, _ in rows}


def data(groups, spread, copies, dims=16):
    rng = np.random.default_rng(5)
    out = []
    for _ in range(groups):
        x = rng.standard_normal(dims)
        for _ in range(6):
            out.append((x + spread * rng.standard_normal(dims)).tolist())
    out += [out[0]] * copies + [[2 * c for c in out[3]]]
    return [(7 * i % 1009, v) for i, v in enumerate(out)]


@pytest.mark.parametrize("spread", [0.1, 0.25])
def test_links_match_brute_force(spark, spread):
    rows = data(40, spread, 30) + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [])]
    got = vectors.near_duplicates(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), 0.9)
    got = {tuple(r) for r in got.collect()}
    want = brute(rows, 0.9)
    have, need = sum(r[1] for r in got), sum(r[1] for r in want)
    assert have <= need and have >= 0.98 * need
    if have == need:
        assert got == want


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = data(10, 0.1, 5)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    whole = {tuple(r) for r in vectors.near_duplicates(df, 0.9).collect()}
    monkeypatch.setattr(vectors, "BLOCK", 3)
    assert {tuple(r) for r in vectors.near_duplicates(df, 0.9).collect()} == whole == brute(rows, 0.9)


def test_empty_and_null_ids(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0], "a"), (4, [1.0, 0.0], "b"), (4, [1.0, 0.0], "b")], SCHEMA)
    got = sorted((tuple(r) for r in vectors.near_duplicates(df).collect()), key=repr)
    assert [r[1] for r in got] == [2, 2, 2] and {r[0] for r in got} == {None, 4}


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(0)
    index = vectors.MultiIndex(rng.standard_normal((200, 8)), 6, 0.9, 0.99)
    index.radius = np.inf
    a, b = rng.random(6), rng.random(6)
    cells = list(index.visits(a, b))
    sums = [a[c // 6] + b[c % 6] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == list(range(36))


def test_mixed_lengths_are_refused(spark):
    vectors_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="2 to 3 components"):
        vectors.near_duplicates(vectors_)


def shapes():
    """Vectors of several kinds with planted pairs just over the threshold."""
    rng = np.random.default_rng(9)
    even = rng.standard_normal((3000, 64))
    skewed = even * (0.93 ** np.arange(64))
    clusters = rng.standard_normal((60, 64))[rng.integers(0, 60, 3000)] + 0.5 * even
    for name, x in (("even", even), ("skewed", skewed), ("clusters", clusters)):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        yield pytest.param(np.concatenate([x, 0.905 * x[:600] + np.sqrt(1 - 0.905**2) * noise[:600]]), id=name)


@pytest.mark.parametrize("x", list(shapes()))
def test_recall_on_several_shapes_of_data(spark, x):
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    need = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    have = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, 0.9).collect()}
    assert all(have[i] <= n for i, n in enumerate(need.tolist()))
    assert sum(have.values()) >= 0.99 * need.sum() > 1000
