"""Mixing sources to target weights by Pfair scheduling: the schedule on the driver, the rows in DataFrame operations.

Each source's rows are put in pseudo-random order (by digest of the id) and cut into blocks. Of exact integer weights w,
whose sum is W, block i (from 1) of a source is released at floor((i-1)*W/w) and due at ceil(i*W/w); in each slot the
released block with the earliest deadline goes first, and a slot without one stays empty. Since the shares sum to one, no
deadline is missed, so that at every slot each source that lasts has had less than one block more or less than its
share, whatever the number of sources and however small a share. When a source ends, its slots stay empty or pull blocks
of others forward within their own times.

Only numbers meet on the driver: the sources with their weights and counts, and a heap with one entry a source, which deals
out the blocks (one in BLOCK_ROWS rows). The blocks' slots are written as a table, and Spark joins the rows to it.

Rows are numbered inside a source without bringing a source together: digests are dealt into equal ranges, small enough
for one task each, whose counts give offsets.

Defined results: a null source is a source of its own; a source without a weight, or with one that is null, not positive
or not finite, gets a millionth of the largest weight, for no row is dropped; repeated rows follow each other in any order, each with
a place of its own; an empty table gives an empty one. Extra columns are kept (own columns are prefixed with `__`).
"""

from __future__ import annotations

import heapq
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.tables import written

BLOCK_ROWS = 16
#: The SQL twin rounds weights to so many parts; it agrees where they are whole in them.
PERIOD = 1000
#: Given weights are counted in so many parts of the largest.
STEPS = 1 << 40
#: The part of the largest weight that a source without a weight gets.
UNWEIGHTED = 1_000_000
ROWS_PER_RANGE = 4096


def _key(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def shares(docs: DataFrame, source_col: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """__source, __rows, __w: the integer weight of each source. Without given weights they follow the square root of its
    rows, which lifts small sources. Given ones are (source, weight) rows; of repeated ones the largest stands."""
    rows = docs.groupBy(_key(F.col(source_col)).alias("__source")).agg(F.count(F.lit(1)).alias("__rows"))
    if weights is None:
        return rows.withColumn("__w", F.floor(F.sqrt("__rows") * 1000).cast("long"))
    weight = F.col("weight").cast("double")
    given = weights.where((weight > 0) & (weight < float("inf"))).groupBy(_key(F.col("source")).alias("__source")).agg(F.max(weight).alias("__given"))
    joined = rows.join(given, "__source", "left")
    # only sources that have rows take part in the mix
    part = F.col("__given") / F.coalesce("__most", F.lit(1.0))
    steps = F.greatest(F.lit(1).cast("long"), F.round(part * STEPS).cast("long"))
    return joined.crossJoin(F.broadcast(joined.agg(F.max("__given").alias("__most")))).select(
        "__source", "__rows", F.coalesce(steps, F.lit(STEPS // UNWEIGHTED)).alias("__w"))


def earliest_deadline_first(weights: list[int], blocks: list[int]) -> tuple[array, array, array]:
    """Source (its place in the list), block (from 0) and slot of every block, by slot."""
    total, had = sum(weights), [0] * len(weights)
    ready = [(-(-total // w), j) for j, (w, n) in enumerate(zip(weights, blocks)) if n > 0]
    heapq.heapify(ready)
    waiting: list[tuple[int, int]] = []
    sources, places, slots, slot = array("q"), array("q"), array("q"), 0
    while ready or waiting:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            j = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(had[j] + 1) * total // weights[j]), j))
        j = heapq.heappop(ready)[1]
        sources.append(j)
        places.append(had[j])
        slots.append(slot)
        had[j] += 1
        if had[j] < blocks[j]:
            heapq.heappush(waiting, (had[j] * total // weights[j], j))
        slot += 1
    return sources, places, slots


def _laid(like: DataFrame, names: list[str], weights: list[int], blocks: list[int]) -> DataFrame:
    """__source, __block, __slot."""
    sources, places, slots = (pa.array(memoryview(x), pa.int64()) for x in earliest_deadline_first(weights, blocks))
    return like.sparkSession.createDataFrame(pa.table({"__source": pa.array(names, pa.string()).take(sources), "__block": places, "__slot": slots}))


def schedule(weights: DataFrame) -> DataFrame:
    """The first sum-of-weights slots, after which it repeats while all sources last: __source, __block (from 0), __slot."""
    found = sorted((r["__source"], r["__p"]) for r in weights.select("__source", "__p").collect())
    return _laid(weights, [s for s, _ in found], [p for _, p in found], [p for _, p in found])


def numbered(docs: DataFrame, id_col: str, source_col: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """docs with __source and __n, the place of the row inside its source, from 0."""
    ranges = docs.groupBy().count().select(F.greatest(F.lit(1), F.ceil(F.col("count") / rows_per_range)).alias("r")).first()["r"]
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    part = F.floor(F.conv(F.substring("__md5", 1, 8), 16, 10).cast("long") * F.lit(int(ranges)) / F.lit(1 << 32)).cast("int")
    keyed = docs.withColumn("__source", _key(F.col(source_col))).withColumn("__md5", digest).withColumn("__range", part)
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as sources times ranges, one for thousands of documents
    offsets = keyed.groupBy("__source", "__range").agg(F.count(F.lit(1)).alias("__c")).select(
        "__source", "__range", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__source", "__range").orderBy("__md5", id_col)
    return (
        keyed.withColumn("__row", F.row_number().over(inside)).join(offsets, ["__source", "__range"])
        .withColumn("__n", F.col("__before") + F.col("__row") - 1).drop("__before", "__row", "__range", "__md5")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: DataFrame | None = None,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with __block (of its source), __slot, and __position: a unique place in the mix, ascending."""
    found = sorted(tuple(r) for r in shares(docs, source_col, weights).select("__source", "__w", "__rows").collect())
    plan = written(_laid(docs, [s for s, _, _ in found], [w for _, w, _ in found], [-(-n // block_rows) for _, _, n in found]))
    placed = numbered(docs, id_col, source_col).withColumn("__block", F.expr(f"__n div {block_rows}L"))
    return (
        placed.join(plan, ["__source", "__block"])
        .withColumn("__position", F.expr(f"__slot * {block_rows}L + __n % {block_rows}L"))
        .drop("__source", "__n")
    )


def in_mixed_order(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """The rows of docs sorted by their place in the mix: files written from it hold the mix in their order."""
    return mix(docs, **options).orderBy("__position").select(*columns)
