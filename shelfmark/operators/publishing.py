"""The publication table: approved products in order, priced, marked up and laid out two to a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import format_price, name_markup, parse_price, subtitle_markup
from shelfmark.operators.ranking import join_facts, ranked
from shelfmark.operators.resolve import approved_only, in_scope, resolve_products


def brand_sequence(products: DataFrame, brand_order: list[str], first_seen: str = "first_seen") -> DataFrame:
    """(brand, brand_pos, brand_seen): configured brands first, the others by first appearance."""
    configured = F.array(*[F.lit(b) for b in brand_order]) if brand_order else F.array().cast("array<string>")
    return products.groupBy("brand").agg(F.min(first_seen).alias("brand_seen")).select(
        "brand", F.nullif(F.array_position(configured, F.col("brand")), F.lit(0)).alias("brand_pos"), "brand_seen")


def publication(catalogue: DataFrame, brand_order: list[str] | None = None, brand: str | None = None,
                category: str | None = None, assets: DataFrame | None = None, order: str = "Product_ID") -> DataFrame:
    """One row per printed product with its brand, place, page, slot and layout.

    Within a brand the cheapest comes first, products without dealer price last, ties by Product_ID. order is the column
    that says in which order rows entered the catalogue.
    """
    rows = approved_only(in_scope(catalogue, brand, category)).withColumn("first_seen", F.col(order))
    products = resolve_products(rows, assets)
    sort_dp = parse_price(F.col("dp"))
    products = products.select(
        "product_id", "brand", "brand_slug", "category", "first_seen", sort_dp.alias("sort_dp"),
        F.col("display_name").alias("name"), name_markup(F.col("display_name")).alias("name_markup"),
        subtitle_markup(F.col("subtitle")).alias("subtitle_markup"), "bullets", "image_path",
        format_price(F.col("dp").cast("string")).alias("price"), format_price(F.col("mrp")).alias("mrp_display"))
    sequence = brand_sequence(products, brand_order or [])
    totals = products.groupBy("brand").agg(F.count(F.lit(1)).alias("total_products"))
    facts = sequence.join(totals, "brand")
    placed = ranked(products, ["brand"], [F.col("sort_dp").asc_nulls_last(), F.col("product_id")], "index_in_brand")
    df = join_facts(placed, facts, ["brand"])
    index = F.col("index_in_brand")
    page = F.ceil(index / 2).cast("int")
    single = (index == F.col("total_products")) & (index % 2 == 1)
    return df.withColumns({
        "page": page, "slot": (F.lit(2) - index % 2).cast("int"),
        "layout": F.when(single, F.lit("1-up")).otherwise(F.lit("2-up")),
        "index_label": F.when(index >= 100, index.cast("string")).otherwise(F.lpad(index.cast("string"), 2, "0")),
        "total_pages": F.ceil(F.col("total_products") / 2).cast("int"),
    }).drop("sort_dp", "first_seen")


def in_print_order(published: DataFrame) -> DataFrame:
    return published.orderBy(F.col("brand_pos").asc_nulls_last(), F.col("brand_seen"), F.col("brand"), F.col("index_in_brand"))
