"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from shelfmark.session import shared_folder


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the shared folder: its lineage is cut, and Spark knows its size when it plans a join."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
