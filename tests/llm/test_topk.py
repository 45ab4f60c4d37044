import random

import pytest

from rulesieve.llm import topk as tk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, ask):
    import math

    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(64 * x) for x in v]
    out = set()
    for q in ok:
        if ask(q):
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best[:k], 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("dim, blocks", [(16, (4096, 8192)), (7, (3, 11)), (1, (5, 5))])
def test_against_brute_force(spark, dim, blocks):
    rng = random.Random(dim)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.125, 0.03125]) for _ in range(dim)], 0) for i in range(150)]
    rows += [(i, list(rows[3][1]), 0) for i in range(200, 230)]  # ties
    rows += [
        (300, None, 1), (301, [None] * dim, 1), (302, [float("nan")] * dim, 1), (303, [float("inf")] * dim, 1),
        (None, [1.0] * dim, 1), (320, [], 1), (340, [1.0] * (dim + 1), 1), (360, [0.5] * (dim + 1), 1), rows[20],
    ]
    df = table(spark, rows)
    found = tk.top_k(df, df.where("vec_id % 20 = 0"), k=20, query_block=blocks[0], candidate_block=blocks[1])
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 20, lambda i: i % 20 == 0)


def test_huge_components_and_few_rows(spark):
    rows = [(0, [1e7, -1e7], 0), (1, [1e7, 1e7], 0), (2, [-1e7, 3e6], 0)]
    df = table(spark, rows)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in tk.top_k(df, df.where("vec_id = 0")).collect()}
    assert got == brute(rows, 20, lambda i: i == 0)


def test_empty_table_and_extra_columns(spark):
    assert tk.top_k(table(spark, []), table(spark, [])).collect() == []
    from pyspark.sql import functions as F

    df = table(spark, [(0, [1.0], 0), (20, [0.5], 1)]).withColumns({"n": F.lit(1), "q": F.lit(2), "id": F.lit(3), "v": F.lit(4)})
    assert tk.top_k(df, df).count() == 2


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 10)), rng.normal(size=(30, 10))
    for segments in (1, 3, 10):
        assert (tk.statistics(x, segments) @ tk.statistics(y, segments).T >= x @ y.T - 1e-9).all()
