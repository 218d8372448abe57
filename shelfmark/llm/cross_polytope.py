"""Approximate nearest neighbours with cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (signs and a Hadamard transform, three times) and named by the signed
axis that is nearest; several such names in a row make its bucket in a table, and there are several tables. Queries
probe the buckets of their next nearest axes too. What the buckets hold is ranked by the exact distance of the original
vectors. How many buckets a query probes is fitted on a bounded sample, against brute force, for a target recall; the
index holds every row.

A bucket with more rows than a cell is split over several, which its queries visit all; a cell returns k rows for each
query. A query that found fewer than k rows (or than there are) is compared with all rows, in blocks.

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part, nor do rows with
a null id; rows that repeat an id count once, with the smallest of their vectors; vectors of different lengths are
compared as if filled up with zeros; equal distances go to the smaller id; a query's own row is no candidate of its
own; an empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.vectors import CELL_ROWS, every_block, matrix, pair, ranked, usable
from shelfmark.session import checkpointed

TABLES = 8
#: Rows that a bucket should hold, about: this sets how many axes name one.
BUCKET_ROWS = 200
#: The fit looks at this many rows and queries at most, and raises the probes until the sample's recall is this.
SAMPLE_ROWS, SAMPLE_QUERIES = 10_000, 200
TARGET_RECALL = 0.96
MOST_PROBES = 512
RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Index:
    """The hash functions: signs[table, function, round, axis]; axes of the padded vectors."""

    signs: np.ndarray
    width: int
    probes: int = 1

    @property
    def buckets(self) -> int:
        return (2 * self.width) ** self.signs.shape[1]


def make_index(width: int, n_rows: int, tables: int = TABLES, seed: int = 0) -> Index:
    width = 1 << max(1, math.ceil(math.log2(max(2, width))))
    functions = max(1, round(math.log(max(1, n_rows / BUCKET_ROWS), 2 * width)))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, functions, 3, width))
    return Index(signs, width)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        halves = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def unit(x: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors, padded; scaled down first so that squares of large components stay finite."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def turned(index: Index, x: np.ndarray, table: int, function: int) -> np.ndarray:
    for signs in index.signs[table, function]:
        x = hadamard(x * signs)
    return x


def probed(index: Index, x: np.ndarray, probes: int) -> np.ndarray:
    """The buckets that unit vectors probe, nearest first: (rows, tables, probes). The first is their own."""
    out = np.empty((len(x), index.signs.shape[0], probes), dtype=np.int64)
    for t in range(index.signs.shape[0]):
        codes, losses = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for f in range(index.signs.shape[1]):
            y = turned(index, x, t, f)
            signed = np.stack([y, -y], axis=2).reshape(len(x), -1)  # axis a as 2a and, negative, 2a + 1
            order = np.argsort(-signed, axis=1, kind="stable")[:, :probes]
            values = np.take_along_axis(signed, order, 1)
            loss = (losses[:, :, None] + (values[:, :1] - values)[:, None, :]).reshape(len(x), -1)
            code = (codes[:, :, None] * (2 * index.width) + order[:, None, :]).reshape(len(x), -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            codes, losses = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
        out[:, t, :codes.shape[1]] = codes
        out[:, t, codes.shape[1]:] = codes[:, :1]
    return out + (np.arange(index.signs.shape[0]) * index.buckets)[None, :, None]


def fit(sample: np.ndarray, n_rows: int, k: int, recall: float = TARGET_RECALL) -> Index:
    """Hash functions for n_rows rows, with as many probes as the sample's queries need."""
    tables = TABLES
    if not len(sample):
        return make_index(1, 1)
    queries = np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int)
    near = []
    for i in queries:
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near.append(np.argsort(d, kind="stable")[:min(k, len(sample) - 1)])
    while True:
        index = make_index(sample.shape[1], n_rows, tables)
        most = min(MOST_PROBES, index.buckets)
        x = unit(sample, index.width)
        own, tried = probed(index, x, 1)[:, :, 0], probed(index, x[queries], most)
        ranks = []
        for q, found in enumerate(near):
            hit = tried[q][None] == own[found][:, :, None]  # neighbour, table, probe
            ranks += np.where(hit.any(axis=2), hit.argmax(axis=2), most).min(axis=1).tolist()
        ranks = np.sort(ranks) if ranks else np.zeros(1, int)
        need = int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1
        if need <= most or tables >= 64:
            index.probes = min(need, most)
            return index
        tables *= 2


def nearest(query_ids, queries, ids, rows, k: int) -> tuple[list, list, list]:
    out: tuple[list, list, list] = ([], [], [])
    for q, v in zip(query_ids.tolist(), queries):
        diff = rows - v
        with np.errstate(over="ignore"):
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        left = np.flatnonzero(ids != q)
        if len(left) > 4 * k:  # all that tie with the k-th stay
            left = left[d[left] <= np.partition(d[left], k - 1)[k - 1]]
        chosen = left[np.lexsort((ids[left], d[left]))[:k]]
        out[0].extend([q] * len(chosen))
        out[1].extend(ids[chosen].tolist())
        out[2].extend(d[chosen].tolist())
    return out


def neighbours(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
               recall: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest rows found for every row that is a query.

    `is_query` is a condition on __id, the id.
    """
    rows = usable(table, id_col, vec_col).where(F.exists("__v", lambda x: x != 0))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    # rows with small digests, a few times the sample, so that tasks do not each send one
    few = rows.where(F.shiftrightunsigned(F.xxhash64("__id"), 44) < math.ceil(min(1.0, 4 * SAMPLE_ROWS / max(n, 1)) * (1 << 20)))
    picked = few.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_ROWS).select("__v").toArrow()
    index = fit(matrix(picked["__v"]), n, k, recall)

    def name(batches, probes):
        for batch in batches:
            codes = probed(index, unit(matrix(batch.column(1)), index.width), probes)
            flat = codes.reshape(len(codes), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["__id", "__v", "__codes"])

    def named(df: DataFrame, probes: int) -> DataFrame:
        return df.mapInArrow(lambda b: name(b, probes), "__id long, __v array<double>, __codes array<long>").select(
            "__id", "__v", F.explode(F.array_distinct("__codes")).alias("__code"))

    def cell(queries: pa.Table, others: pa.Table) -> pa.Table:
        if not queries.num_rows or not others.num_rows:
            return RESULT.empty_table()
        return pa.table(list(nearest(*pair(queries, others), k)), schema=RESULT)

    def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own: both come from the same rows
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double")

    indexed, asked = named(rows, 1), named(rows.where(is_query), index.probes)
    crowded = indexed.groupBy("__code").count().where(F.col("count") > CELL_ROWS).select("__code", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    right = indexed.join(crowded, "__code", "left").withColumn("__part", F.pmod(F.xxhash64("__id"), parts).cast("int"))
    left = asked.join(crowded, "__code", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    keys = ["__code", "__part"]
    found = meet(left.select("__id", "__v", *keys), right.select("__id", "__v", *keys), keys)
    found = checkpointed(ranked(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k, "score", "vec_id"))
    counts = found.groupBy(F.col("query_id").alias("__id")).count()
    short = rows.where(is_query).join(counts, "__id", "left").where(F.coalesce("count", F.lit(0)) < min(k, max(n - 1, 0))).select("__id", "__v")
    again = meet(*every_block(short, rows, n_queries, n), ["__c", "__g"])
    both = found.select("query_id", "vec_id", "score").union(again).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return ranked(both, k, "score", "vec_id")
