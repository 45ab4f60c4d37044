import random

import pytest

from rulesieve.llm.common import connected_components


def plain_components(edges):
    group = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(group[a], group[b])
            for n in (a, b):
                if group[n] != low:
                    group[n], changed = low, True
    return group


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(1000, 1030)]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + chain + [(500, 500 + i) for i in range(1, 40)]
    rng.shuffle(edges)
    found = connected_components(spark.createDataFrame(edges + [(None, 3), (7, None)], "u long, v long")).collect()
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert len(found) == len(want) and {r["node"]: r["component"] for r in found} == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []
