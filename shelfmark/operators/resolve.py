"""Effective values: what a catalogue row shows once overrides and fallbacks are applied."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schema
from shelfmark.functions import fixed
from shelfmark.functions.text import (
    clean_display_name, filled, filled_number, is_blank, slugify, strip,
)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Null, NaN and white space are all 'empty'; do this once where data enters."""
    def clean(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.StringType):
            return filled(F.col(field.name)).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return filled_number(F.col(field.name)).alias(field.name)
        return F.col(field.name)

    return df.select(*[clean(f) for f in df.schema.fields])


def effective(field: str, df: DataFrame) -> Column:
    """Override_F, then Raw_F, then a plain column F if the table has one."""
    names = [n for n in (f"Override_{field}", f"Raw_{field}", field) if n in df.columns]
    return F.coalesce(*[filled(F.col(n)) for n in names])


def effective_dp() -> Column:
    return F.coalesce(filled_number(F.col("Override_DP")), filled_number(F.col("MRP_Input")))


def effective_mrp() -> Column:
    """Kept as text: the sheet price may carry a currency sign."""
    return F.coalesce(
        filled_number(F.col("Override_MRP")).cast("string"),
        filled(F.col("MRP_Display")),
        filled_number(F.col("Raw_MRP_Scraped")).cast("string"),
    )


def effective_display_name() -> Column:
    return F.coalesce(
        strip(filled(F.col("Override_Title"))), strip(filled(F.col("Display_Name"))), strip(F.col("Model_Name"))
    )


def category_or_default(default: str) -> Column:
    return F.when(F.col("Category") != "", F.col("Category")).otherwise(F.lit(default))


def default_image_paths() -> tuple[Column, Column]:
    """(category path, older brand-only path) under the images folder."""
    brand, model = slugify(F.col("Brand")), slugify(F.col("Model_Name"))
    category = slugify(category_or_default("powerbank"))
    return (
        F.concat(F.lit("images/"), category, F.lit("/"), brand, F.lit("/"), model, F.lit(".png")),
        F.concat(F.lit("images/"), brand, F.lit("/"), model, F.lit(".png")),
    )


def with_image_path(df: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Add image_path: the override, else whichever default path exists, else the category path.

    assets is a table of existing image files with a path column; without it no file is taken to exist.
    """
    by_category, by_brand = default_image_paths()
    override = strip(filled(F.col("Override_Image_Path")))
    if assets is None:
        return df.withColumn("image_path", F.coalesce(override, by_category))
    known = assets.select("path").distinct()
    return (
        df.withColumns({"_by_category": by_category, "_by_brand": by_brand})
        .join(known.select(F.col("path").alias("_in_category")), F.col("_by_category") == F.col("_in_category"), "left")
        .join(known.select(F.col("path").alias("_in_brand")), F.col("_by_brand") == F.col("_in_brand"), "left")
        .withColumn("image_path", F.coalesce(override, F.col("_in_category"), F.col("_in_brand"), F.col("_by_category")))
        .drop("_by_category", "_by_brand", "_in_category", "_in_brand")
    )


def resolve_products(catalogue: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """The complete resolved row, one per product."""
    df = with_image_path(catalogue, assets)
    brand, model = strip(F.col("Brand")), strip(F.col("Model_Name"))
    category = strip(category_or_default("Powerbank"))
    bullets = F.array_compact(F.array(*[strip(effective(b, df)) for b in fixed.BULLETS]))
    specs = F.struct(*[
        F.coalesce(effective(f, df), F.lit("")).alias(f.removeprefix("Spec_").lower()) for f in fixed.SPEC_FIELDS
    ])
    keep = [c for c in df.columns if c not in schema.CATALOGUE.names and c != "image_path"]
    return df.select(
        F.col("Product_ID").alias("product_id"),
        category.alias("category"),
        slugify(category).alias("category_slug"),
        brand.alias("brand"),
        slugify(brand).alias("brand_slug"),
        model.alias("model_name"),
        effective_display_name().alias("display_name"),
        slugify(model).alias("model_slug"),
        F.coalesce(effective("Title", df), F.concat_ws(" ", brand, model)).alias("title"),
        F.coalesce(effective("Subtitle", df), F.lit("")).alias("subtitle"),
        effective_dp().alias("dp"),
        effective_mrp().alias("mrp"),
        specs.alias("specs"),
        bullets.alias("bullets"),
        F.col("image_path"),
        F.coalesce(F.col("Image_Status"), F.lit("missing")).alias("image_status"),
        F.col("Image_Source").alias("image_source"),
        F.col("Flags").alias("flags"),
        F.coalesce(F.col("Status"), F.lit("Pending")).alias("status"),
        *keep,
    )


def in_scope(df: DataFrame, brand: str | None = None, category: str | None = None) -> DataFrame:
    """Rows of a brand and, optionally, a category; case and outer space do not matter.

    A catalogue that was written by brand and category is read in those partitions only.
    """
    for column, wanted in (("Brand", brand), ("Category", category)):
        if wanted and wanted.strip():
            df = df.where(F.lower(strip(F.col(column))) == wanted.strip().lower())
            part = f"{column.lower()}_slug"
            if part in df.columns:
                slug = re.sub(r"[^a-z0-9]+", "-", wanted.strip().lower()).strip("-")
                df = df.where((F.col(part) == slug) if slug else F.col(part).isNull() | (F.col(part) == ""))
    return df


def approved_only(df: DataFrame) -> DataFrame:
    """Approved is the only status that may be published."""
    return df.where(F.col("Status") == "Approved")


def overridden_flags() -> Column:
    """Which shown fields a person has set by hand."""
    fields = {
        "title": "Title", "subtitle": "Subtitle", "bullet_1": "Bullet_1", "bullet_2": "Bullet_2",
        "bullet_3": "Bullet_3", "bullet_4": "Bullet_4", "dp": "DP", "mrp": "MRP", "image": "Image_Path",
    }

    def is_set(name: str, field: str) -> Column:
        column = F.col(f"Override_{field}")
        numeric = field in ("DP", "MRP")
        return (filled_number(column).isNotNull() if numeric else ~is_blank(column)).alias(name)

    return F.struct(*[is_set(n, f) for n, f in fields.items()])


def served_image_url(path: Column) -> Column:
    """Where the image is served from."""
    clean = F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("./"))
    return (
        F.when(clean.startswith("images/"), F.concat(F.lit("/"), clean))
        .when(clean != "", F.concat(F.lit("/images/"), clean))
    )


def review_view(catalogue: DataFrame, brand: str | None = None, category: str | None = None,
                assets: DataFrame | None = None) -> DataFrame:
    """What the approval screen shows per row; without the specs, in Product_ID order."""
    from shelfmark.operators.status import failure_reason

    scoped = in_scope(catalogue, brand, category)
    rows = scoped.withColumns({
        "failure_reason": failure_reason(), "is_overridden": overridden_flags(),
        "source_url": F.col("Source_URL"), "raw_model": F.col("Model_Name"),
    })
    shown = resolve_products(rows, assets)
    return shown.select(
        strip(F.col("product_id")).alias("product_id"), F.col("raw_model").alias("model_name"),
        F.col("display_name").alias("title"), "subtitle",
        *[F.get("bullets", F.lit(n - 1)).alias(f"bullet_{n}") for n in range(1, 5)],
        "dp", "mrp", "status", "source_url", served_image_url(F.col("image_path")).alias("image_url"),
        "image_status", "flags", "failure_reason", "is_overridden",
    ).orderBy("product_id")


def rows_view(catalogue: DataFrame, brand: str | None = None, category: str | None = None) -> DataFrame:
    """The listing of a brand's rows with attempts, brochure and overrides."""
    from shelfmark.operators.status import failure_reason

    scoped = in_scope(catalogue, brand, category)
    return scoped.select(
        F.col("Product_ID").alias("product_id"), F.col("Model_Name").alias("model_name"),
        effective_display_name().alias("display_name"), F.coalesce("Status", F.lit("Pending")).alias("status"),
        effective_dp().alias("dp"), effective_mrp().alias("mrp"), F.col("Source_URL").alias("source_url"),
        F.coalesce("Image_Status", F.lit("missing")).alias("image_status"), F.col("Flags").alias("flags"),
        failure_reason().alias("failure_reason"), F.coalesce("Attempts", F.lit(0)).alias("attempts"),
        F.coalesce("Category", F.lit("Powerbank")).alias("category"), F.col("Brochure_PDF").alias("brochure_pdf"),
        F.col("Override_Title").alias("override_title"), F.col("Override_DP").alias("override_dp"),
        F.col("Override_MRP").alias("override_mrp"), F.col("Override_Image_Path").alias("override_image_path"),
    ).orderBy("product_id")


def tidy_display_names(catalogue: DataFrame) -> DataFrame:
    """Shorten display names and note the change in the log."""
    current = F.col("Display_Name")
    tidy = clean_display_name(F.coalesce(filled(current), F.col("Model_Name")), strip(F.col("Brand")))
    changed = (tidy != "") & ~tidy.eqNullSafe(current)
    note = F.concat(F.lit("Cleaned Display_Name to '"), tidy, F.lit("'"))
    log = strip(F.concat(F.coalesce(F.col("Fix_Log"), F.lit("")), F.lit("\n"), note))
    return catalogue.withColumns({
        "Display_Name": F.when(changed, tidy).otherwise(current),
        "Fix_Log": F.when(changed, log).otherwise(F.col("Fix_Log")),
    })
