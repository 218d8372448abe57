"""Declared schemas of the catalogue and of the tables that flow into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import fixed

_NUMERIC = {
    "MRP_Input": T.DoubleType(), "Raw_MRP_Scraped": T.DoubleType(), "Override_MRP": T.DoubleType(),
    "Override_DP": T.DoubleType(), "Attempts": T.IntegerType(),
}


def _catalogue_names() -> list[str]:
    head = ["Product_ID", "Category", "Brand", "Model_Name", "Display_Name", "Product_URL", "Brochure_PDF",
            "Marketplace_URL", "MRP_Input", "MRP_Display", "Source_URL", "Source_Audit"]
    tracked = [f"{part}_{field}" for field in fixed.PROVENANCE_FIELDS for part in ("Raw", "Source", "Tier")]
    image = ["Image_URL", "Image_Status", "Image_Source", "Image_Tier"]
    overrides = [f"Override_{field}" for field in fixed.OVERRIDE_FIELDS]
    tail = ["Attempts", "Fix_Log", "Flags", "LLM_Provider", "Status", "Rejected_URLs"]
    return head + tracked + image + overrides + tail


CATALOGUE = T.StructType([T.StructField(n, _NUMERIC.get(n, T.StringType())) for n in _catalogue_names()])

# One value seen for one field of one product, with where it came from.
OBSERVATION = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("tier_rank", T.IntegerType()),
    T.StructField("tier_label", T.StringType()),
    T.StructField("seq", T.LongType()),
])

PRICE_SHEET = T.StructType([
    T.StructField("brand_name", T.StringType()),
    T.StructField("brand_code", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("dp", T.DoubleType()),
    T.StructField("mrp", T.DoubleType()),
    T.StructField("notes", T.StringType()),
])

LISTING = T.StructType([
    T.StructField("store_brand", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("arrival", T.LongType()),
])

PAGES = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("html", T.StringType()),
])

BROCHURE_PAGE = T.StructType([
    T.StructField("brochure", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
])


def conform(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the schema: columns the input lacks become typed nulls, other types are cast leniently; keep stays."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def pick(field: T.StructField) -> Column:
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if have[field.name] == field.dataType:
            return F.col(field.name)
        return F.col(field.name).try_cast(field.dataType).alias(field.name)

    return df.select(*[pick(f) for f in schema.fields], *keep)


def catalogue(df: DataFrame) -> DataFrame:
    """Any table with some catalogue columns as a full catalogue table; further columns are kept at the end."""
    extra = [c for c in df.columns if c not in CATALOGUE.names]
    padded = T.StructType(CATALOGUE.fields + [df.schema[c] for c in extra])
    return conform(df, padded)
