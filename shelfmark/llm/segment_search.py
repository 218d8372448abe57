"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are scaled to integers, floor(scale * x). A vector is cut into segments, each known by its mean and deviation;
Cauchy-Schwarz gives, from those alone, a bound on a pair's inner product, which is the lower bound of its distance. Few
segments are compared first, then more; what the bounds leave is scored exactly, in integers. No candidate is lost, for
a bound is never smaller than the score.

Queries and rows are dealt into blocks of bounded size, and each pair of blocks is one task's cell, which returns k rows
for each query. Nothing is broadcast or collected.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
rows that repeat an id count once, with the smallest of their vectors; vectors of different lengths are compared as if
filled up with zeros; equal scores go to the smaller id; a query's own row is no candidate of its own; an empty table
gives an empty one. Only the named columns are read. Scores beyond a long stop at its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.vectors import every_block, pair, ranked, usable

#: Segments of the coarse and of the finer statistics.
LEVELS = (4, 16)
RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: Products below this are exact in doubles.
EXACT = float(1 << 52)
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles that hold integers, or Python's own integers where those would not be exact."""
    scaled = np.floor(scale * x) if x.size == 0 or np.abs(x).max() < EXACT / scale else None
    return scaled if scaled is not None else np.array([[int(np.floor(scale * v)) if abs(v) < EXACT / scale else int(v) * scale for v in row] for row in x], dtype=object)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that the product of two rows bounds the vectors' inner product."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    roots = [np.sqrt(p.shape[1]) for p in parts]
    return np.stack([p.mean(axis=1) * r for p, r in zip(parts, roots)] + [p.std(axis=1) * r for p, r in zip(parts, roots)], axis=1)


def best_of(query_ids, queries, ids, rows, k: int) -> list[tuple[int, int, int]]:
    """The k best rows of each query, and how: coarse bounds of all, fine bounds of what is left, exact scores of the rest."""
    if queries.dtype == object or rows.dtype == object or np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1]) >= EXACT:
        queries, rows = ([[int(v) for v in r] for r in x.tolist()] for x in (queries, rows))
        out = []
        for q, v in zip(query_ids.tolist(), queries):
            scores = sorted((-sum(a * b for a, b in zip(v, r)), i) for i, r in zip(ids.tolist(), rows) if i != q)
            out += [(q, i, min(LONG, max(-LONG - 1, -s))) for s, i in scores[:k]]
        return out
    coarse_q, fine_q = (statistics(queries, n) for n in LEVELS)
    coarse, fine = (statistics(rows, n) for n in LEVELS)
    slack = 1e-9 * np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1).max(initial=0)) + 1e-6
    out = []
    for i, q in enumerate(query_ids.tolist()):
        bound = coarse @ coarse_q[i] + slack[i]
        left = np.flatnonzero(ids != q)
        if not len(left):
            continue
        # the k best by bound give a score that the result must reach
        first = left[np.argpartition(-bound[left], min(k, len(left)) - 1)[:k]]
        reach = (rows[first] @ queries[i]).min() if len(left) >= k else -np.inf
        left = left[bound[left] >= reach]
        left = left[fine[left] @ fine_q[i] + slack[i] >= reach]
        scores = rows[left] @ queries[i]
        chosen = np.lexsort((ids[left], -scores))[:k]
        out += [(q, int(ids[left[j]]), int(scores[j])) for j in chosen]
    return out


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest integer inner product for every row that is a query.

    `is_query` is a condition on __id, the id.
    """
    rows = usable(table, id_col, vec_col)
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    left, right = every_block(rows.where(is_query), rows, n_queries, n)

    def cell(queries: pa.Table, others: pa.Table) -> pa.Table:
        if not queries.num_rows or not others.num_rows:
            return RESULT.empty_table()
        q_ids, q, ids, x = pair(queries, others)
        found = best_of(q_ids, integers(q, scale), ids, integers(x, scale), k)
        return pa.table(list(zip(*found)) if found else [[], [], []], schema=RESULT)

    found = left.groupBy("__c", "__g").cogroup(right.groupBy("__c", "__g")).applyInArrow(cell, "query_id long, vec_id long, score long")
    return ranked(found, k, F.desc("score"), "vec_id")
