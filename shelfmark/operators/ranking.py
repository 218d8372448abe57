"""Numbering and group facts that hold up when one group is a third of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import checkpointed

_LOCAL_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows 1..n in the given total order, in parallel.

    The sort is a range shuffle, so no task sees more than its share. The rows are written to the checkpoint
    folder together with their place inside their partition; a lost executor therefore cannot renumber them.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("_place"), _LOCAL_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_place").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local + 1)
        .drop("_part", "_place", "_offset")
    )


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Number the rows of every group 1..n; a group may span many partitions."""
    whole = numbered(df, [F.col(g).asc_nulls_first() for g in group] + order, "_position")
    first = whole.groupBy(*group).agg(F.min("_position").alias("_first"))
    out = join_facts(whole, first, group)
    return out.withColumn(name, F.col("_position") - F.col("_first") + 1).drop("_position", "_first")


def join_facts(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Attach one row of facts per key. Null keys count as equal.

    Spark broadcasts the facts if their measured size is below its threshold; else adaptive execution splits a key that
    is too large for one task.
    """
    renamed = facts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & df[k].eqNullSafe(renamed[f"_k_{k}"])
    return df.join(renamed, match, how).drop(*[f"_k_{k}" for k in keys])


def with_group_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Attach the group size, counted with map-side combine; only groups of two or more are looked up."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)
    return join_facts(df, repeated, keys).withColumn(name, F.coalesce(F.col(name), F.lit(1)))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group. Spark drops all but k per group and task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
