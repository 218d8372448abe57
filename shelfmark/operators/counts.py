"""Counts and roll-ups over the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.functions.text import filled, is_blank, strip
from shelfmark.operators.ranking import with_group_count
from shelfmark.operators.resolve import in_scope


def _status_count(status: str) -> Column:
    return F.count_if(F.col("Status") == status).alias(status)


def status_counts(catalogue: DataFrame, category: str | None = None, order: str = "Product_ID") -> DataFrame:
    """Rows per brand and category by status, the first brochure, and the place of first appearance."""
    brochure = strip(F.min_by("Brochure_PDF", F.when(F.col("Brochure_PDF").isNotNull(), F.col(order))))
    return in_scope(catalogue, None, category).where(F.col("Brand").isNotNull() & F.col("Category").isNotNull()).groupBy(
        F.col("Brand").alias("brand"), F.col("Category").alias("category")
    ).agg(
        F.count(F.lit(1)).alias("total_rows"), *[_status_count(s) for s in fixed.STATUSES],
        filled(brochure).alias("brochure_path"), F.min(order).alias("first_seen"),
    )


def run_summary(catalogue: DataFrame, brand: str | None = None, category: str | None = None) -> DataFrame:
    """The head counts of a run, per brand."""
    not_failed = ~F.coalesce(F.col("Status").isin("Blocked", "Skipped", "Deferred"), F.lit(False))
    names = {"Ready_For_Review": "ready", "Approved": "approved", "Blocked": "blocked", "Skipped": "skipped",
             "Deferred": "deferred", "Pending": "pending"}
    return in_scope(catalogue, brand, category).groupBy(F.col("Brand").alias("brand")).agg(
        *[F.count_if(F.col("Status") == s).alias(f"{n}_count") for s, n in names.items()],
        F.count_if(F.col("Status").isin("Ready_For_Review", "Approved")).alias("ready_or_approved_count"),
        F.count_if(~is_blank(F.col("Flags")) & not_failed).alias("warning_count"),
        F.count(F.lit(1)).alias("total_count"))


def categories(catalogue: DataFrame) -> DataFrame:
    """The categories in use, sorted; Powerbank when there is none."""
    named = catalogue.select(filled(strip(F.col("Category"))).alias("category")).where("category is not null").distinct()
    fallback = named.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("Powerbank").alias("category"))
    return named.unionByName(fallback).orderBy("category")


def duplicate_skus(catalogue: DataFrame) -> DataFrame:
    """All rows whose model and dealer price occur more than once in a brand; a group's rows stay separate rows."""
    counted = with_group_count(catalogue, ["Brand", "Model_Name", "MRP_Input"], "group_size")
    return counted.where(F.col("group_size") > 1).select(
        F.col("Brand").alias("brand"), F.col("Model_Name").alias("model_name"), F.col("MRP_Input").alias("dp"),
        F.col("Product_ID").alias("product_id"), "group_size")


def background_outliers(colours: DataFrame, limit: float = 25.0) -> DataFrame:
    """Images whose corner colour is far from their brand's median colour.

    colours: brand, path, r, g, b with channels averaged over corners, so a channel takes a bounded number of values
    and the exact median needs no more memory for a brand with a third of all images.
    """
    median = colours.groupBy("brand").agg(
        F.count(F.lit(1)).alias("_n"), *[F.median(c).alias(f"median_{c}") for c in ("r", "g", "b")])
    distance = F.sqrt(sum(F.pow(F.col(c) - F.col(f"median_{c}"), 2) for c in ("r", "g", "b")))
    return (
        colours.join(median.where(F.col("_n") >= 2), "brand").drop("_n")
        .withColumn("distance", distance).where(F.col("distance") > limit)
    )


def page_plan(products_per_brand: DataFrame) -> DataFrame:
    """Expected number of pages: a cover, and per brand a divider and two products to a page. Needs total_products."""
    return products_per_brand.agg(
        (F.lit(1) + F.coalesce(F.sum(1 + F.ceil(F.col("total_products") / 2)), F.lit(0))).cast("bigint").alias("pages"))


def display_name_collisions(catalogue: DataFrame) -> DataFrame:
    """Display names used more than once in a brand, whatever the case."""
    shown = F.lower(strip(F.coalesce(filled(F.col("Display_Name")), F.col("Model_Name"))))
    return catalogue.groupBy(F.col("Brand").alias("brand"), shown.alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) & (F.col("name") != ""))


def pending_estimate(catalogue: DataFrame, calls_per_row: int = 1) -> DataFrame:
    """Rows still to be collected per brand and the drafting calls that will take."""
    pending = F.count_if(is_blank(F.col("Raw_Title")) & is_blank(F.col("Override_Title")))
    return catalogue.groupBy(F.col("Brand").alias("brand")).agg(
        F.count(F.lit(1)).alias("total_rows"), pending.alias("pending"), (pending * calls_per_row).alias("calls"))


def missing_assets(approved: DataFrame, assets: DataFrame) -> DataFrame:
    """Approved, resolved products without a non-empty image file."""
    present = assets.where(F.col("length") > 0).select(F.col("path").alias("image_path"))
    return approved.join(present, "image_path", "left_anti").select(
        "product_id", "model_name", F.coalesce(F.nullif("image_path", F.lit("")), F.lit("unspecified")).alias("image_path"))


def brand_models(catalogue: DataFrame) -> DataFrame:
    """The model names of each brand, as rows."""
    return catalogue.where(~is_blank(F.col("Model_Name"))).select(
        F.col("Brand").alias("brand"), strip("Model_Name").alias("model_name")).distinct()


def publish_totals(catalogue: DataFrame, brand: str | None = None, category: str | None = None) -> DataFrame:
    """Approved products and their brands in scope."""
    rows = in_scope(catalogue, brand, category).where(F.col("Status") == "Approved")
    return rows.agg(F.count(F.lit(1)).alias("product_count"), F.countDistinct("Brand").alias("brand_count"))


def overview_totals(counts: DataFrame) -> DataFrame:
    """Totals over the status counts; the number shown falls back to all rows while nothing is approved."""
    totals = counts.agg(
        F.countDistinct("brand").alias("brands"), F.coalesce(F.sum("Approved"), F.lit(0)).alias("approved"),
        F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total"))
    return totals.withColumn("shown", F.when(F.col("approved") > 0, F.col("approved")).otherwise(F.col("total")))


def unsequenced_brands(counts: DataFrame, brand_order: DataFrame) -> DataFrame:
    """Brands with approved rows that the configured order (a brand column) does not name."""
    known = brand_order.select(F.lower("brand").alias("_b")).distinct()
    return counts.where(F.col("Approved") > 0).select("brand").distinct().join(
        known, F.lower(F.col("brand")) == F.col("_b"), "left_anti")


def sheet_usable(sheet: DataFrame) -> DataFrame:
    """Per sheet: how many rows have a name and a price, and whether that is at least half of them.

    sheet: sheet, model_name, display_name, dp, mrp.
    """
    named = ~is_blank(F.coalesce(F.nullif(F.col("model_name"), F.lit("")), F.col("display_name")))
    priced = F.coalesce((F.col("dp") > 0) & ~F.isnan("dp"), F.lit(False)) | F.coalesce(
        (F.col("mrp") > 0) & ~F.isnan("mrp"), F.lit(False))
    return sheet.groupBy("sheet").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(named & priced).alias("n_usable")
    ).withColumn("usable", F.col("n_usable") >= F.ceil(F.col("n_rows") / 2))
