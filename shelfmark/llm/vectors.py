"""What the vector searches share: usable vectors, and dealing queries and rows into cells of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 8192
CELL_QUERIES = 512


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """__id, __v: vectors that are not null and hold only finite components; of rows that repeat an id the smallest."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))
    return table.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("__id"), v.alias("__v")).groupBy("__id").agg(F.min("__v").alias("__v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """A list column as rows; shorter vectors are filled up with zeros, which changes no product or distance of theirs."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(rows.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
    width = max([width, *sizes.tolist()])
    values = rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def pair(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and equally wide matrices of two tables with __id and __v."""
    a, b = matrix(left["__v"]), matrix(right["__v"])
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    return left["__id"].to_numpy(), a, right["__id"].to_numpy(), b


def every_block(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell (__c, __g) of a block of queries and a block of rows, each pair of blocks meeting once."""
    blocks, parts = max(1, -(-n_rows // CELL_ROWS)), max(1, -(-n_queries // CELL_QUERIES))
    all_blocks, all_parts = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, parts))
    mine = F.pmod(F.xxhash64("__id"), F.lit(parts)).cast("int")
    own = F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int")
    return (queries.select("__id", "__v", mine.alias("__c"), all_blocks.alias("__g")),
            rows.select("__id", "__v", all_parts.alias("__c"), own.alias("__g")))


def ranked(found: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query_id with their rank; tasks keep k each before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
