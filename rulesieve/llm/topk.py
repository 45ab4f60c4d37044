"""Exact top-k by inner product, pruned by segment statistics.

For vectors cut into segments of length L with means m and deviations s, the
squared distance is at least the sum of L * ((m - m')**2 + (s - s')**2), so the
inner product is at most the sum of L * (m * m' + s * s'). Few long segments give
a cheap, loose bound, many short ones a dearer, tighter bound. A pair goes on to
the next resolution, and at last to the exact product, only while its bound
reaches the k-th best exact score known so far.

Queries and candidates are dealt into blocks by their ids, and every pair of
blocks is one bounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rulesieve.llm.common import batches

#: Numbers of segments, coarse to fine.
RESOLUTIONS = (4, 16)
#: Products up to this size are exact in double precision.
_EXACT = 2.0**53
_QUERIES_AT_ONCE = 64


def quantised(vectors: DataFrame, id_col: str, vector_col: str, factor: float) -> DataFrame:
    """``(id, n, v)``: floor(factor * x) of every component as 64-bit numbers in bytes.

    Rows with a null id, a null vector, or a null or non-finite component are left out.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 5_000):
            ids, sizes, out = [], [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                if i is None or v is None or any(x is None for x in v):
                    continue
                numbers = np.array(v, np.float64)
                if np.isfinite(numbers).all():
                    ids.append(i)
                    sizes.append(len(v))
                    out.append(np.floor(factor * numbers).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["id", "n", "v"]
            )

    given = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"))
    return given.mapInArrow(run, "id long, n int, v binary")


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that their inner product is the bound."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(edges, edges[1:])]
    root = np.sqrt([p.shape[1] for p in parts])
    return np.hstack(
        [np.column_stack([p.mean(1) for p in parts]) * root, np.column_stack([p.std(1) for p in parts]) * root]
    )


def best_of_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, resolutions=RESOLUTIONS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the ``k`` best rows of a block for every query, ties to smaller ids."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if largest < _EXACT:  # exact in doubles
        queries, rows = queries.astype(np.float64), rows.astype(np.float64)
    q_doubles, r_doubles = queries.astype(np.float64), rows.astype(np.float64)
    row_stats = [statistics(r_doubles, s) for s in resolutions]
    query_stats = [statistics(q_doubles, s) for s in resolutions]
    slack = 1e-9 * largest + 1e-6  # rounding of the bounds
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), _QUERIES_AT_ONCE):
        own = slice(at, at + _QUERIES_AT_ONCE)
        q, own_ids = queries[own], query_ids[own]
        bound = query_stats[0][own] @ row_stats[0].T
        bound[own_ids[:, None] == ids[None, :]] = -np.inf
        # The k rows of the highest bounds, scored exactly, give what must be reached.
        n = min(k, len(rows) - 1)
        if n < 1:
            top = np.zeros((len(q), 0), np.int64)
            reach = np.full(len(q), -np.inf)
        else:
            top = np.argpartition(-bound, n - 1, axis=1)[:, :n]
            known = np.einsum("qd,qnd->qn", q, rows[top]).astype(np.float64)
            known[np.take_along_axis(bound, top, 1) == -np.inf] = -np.inf
            reach = known.min(1) if n == k else np.full(len(q), -np.inf)
        a, b = np.nonzero((bound >= reach[:, None] - slack) & (bound > -np.inf))
        for fine_q, fine_r in zip(query_stats[1:], row_stats[1:]):
            if 4 * len(a) > bound.size:  # most pairs are left: the plain product is cheaper than gathering
                keep = (fine_q[own] @ fine_r.T)[a, b] >= reach[a] - slack
            else:
                keep = np.einsum("ij,ij->i", fine_q[own][a], fine_r[b]) >= reach[a] - slack
            a, b = a[keep], b[keep]
        score = (q @ rows.T)[a, b] if 4 * len(a) > bound.size else np.einsum("ij,ij->i", q[a], rows[b])
        score = score.astype(np.int64)
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        first = np.searchsorted(a, np.arange(len(q)))
        rank = np.arange(len(a)) - first[a]
        keep = rank < k
        out.append((own_ids[a[keep]], ids[b[keep]], score[keep]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    factor: float = 64.0,
    query_block: int = 4096,
    candidate_block: int = 8192,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every query its ``k`` best other rows.

    Score is the integer inner product of floor(factor * x); ties go to the
    smaller id, a query with fewer candidates gets all. A query's own id is no
    candidate. Vectors that are null or hold null or non-finite components take
    no part; only vectors of equal length are compared. Of rows that share an
    id one takes part, that of the smallest bytes. Other columns are ignored.
    Empty tables give an empty result.
    """
    rows, asked = quantised(vectors, id_col, vector_col, factor), quantised(queries, id_col, vector_col, factor)
    row_blocks = 1 + rows.count() // candidate_block
    query_blocks = 1 + asked.count() // query_block

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(own)
        return df.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("id").to_numpy()
        joined = b"".join(table.column("v").to_pylist())
        numbers = np.frombuffer(joined, "<i8").reshape(len(ids), -1)
        order = np.lexsort((np.array(table.column("v").to_pylist(), object), ids)) if len(set(ids)) < len(ids) else np.argsort(ids)
        first = np.ones(len(ids), bool)
        first[1:] = ids[order][1:] != ids[order][:-1]
        return ids[order][first], numbers[order][first]

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows and left.column("n")[0].as_py():
            found = best_of_block(*unpacked(left), *unpacked(right), k)
        else:
            found = (np.empty(0, np.int64),) * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    keys = ["q", "c", "n"]
    found = (
        dealt(asked, "q", query_blocks, "c", row_blocks)
        .groupBy(keys)
        .cogroup(dealt(rows, "c", row_blocks, "q", query_blocks).groupBy(keys))
        .applyInArrow(group, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
