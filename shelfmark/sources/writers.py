"""Writers. Nothing is written before every row has passed the provenance guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import slugify
from shelfmark.operators.resolve import effective
from shelfmark.operators.validation import UnsourcedValue, sourced_or_fail


def write_catalogue(catalogue: DataFrame, path: str, version: str) -> str:
    """Write a new version of the catalogue, partitioned by category and brand, and return where it is.

    Readers keep the version they opened; a version that exists is never overwritten.
    """
    target = f"{path.rstrip('/')}/version={version}"
    partitions = {"category_slug": slugify(F.coalesce("Category", F.lit("powerbank"))), "brand_slug": slugify(F.col("Brand"))}
    try:
        # the guard runs inside the job that writes: a bad row fails it, and nothing is committed. A task sorts what it writes,
        # so it is dealt parts of a bounded size, whatever the number of rows and however large a brand is
        dealt = sourced_or_fail(catalogue).withColumns(partitions).hint("rebalance", *[F.col(p) for p in partitions])
        dealt.write.mode("errorifexists").partitionBy(*partitions).parquet(target)
    except Exception as error:
        if "no verified source for product" in str(error):
            raise UnsourcedValue(str(error).splitlines()[0]) from error
        raise
    return target


def golden_rows(catalogue: DataFrame) -> DataFrame:
    """Baseline rows of a catalogue; the number of specifications is counted from the effective values."""
    specs = [effective(f"Spec_{s}", catalogue) for s in ("Capacity", "Output", "Ports", "Weight", "Warranty")]
    return catalogue.select(
        F.col("Product_ID").alias("product_id"), F.col("Brand").alias("brand"), F.col("Category").alias("category"),
        F.col("Model_Name").alias("model_name"), F.col("Display_Name").alias("display_name"),
        F.col("Source_URL").alias("source_url"), F.col("Tier_Title").alias("tier"),
        F.size(F.array_compact(F.array(*specs))).alias("spec_count"), F.col("Status").alias("status"),
        F.col("Image_Status").alias("image_status"), F.col("Override_Image_Path").alias("image_path"))


def write_golden(catalogue: DataFrame, path: str, confirmed: bool = False) -> None:
    """Write a new baseline as JSON lines; refuses unless asked for explicitly."""
    if not confirmed:
        raise ValueError("pass confirmed=True to replace the baseline")
    golden_rows(catalogue).write.mode("overwrite").json(path)
