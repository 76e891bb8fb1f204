import numpy as np
import pytest

from tidemark.llm.components import connected


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = least
    return label


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(-200, 200, (150, 2))]
    edges += [(1000 + i, 1001 + i) for i in range(0, 300, 1)][: 300 * (seed == 1)] + [(5000, 5001 + i) for i in range(100)] + [(7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in brute([e for e in edges if e[0] != e[1]]).items()}


def test_no_links(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
