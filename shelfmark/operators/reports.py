"""What a person reads after a run, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import filled, is_blank, strip
from shelfmark.operators.resolve import effective, effective_dp, effective_mrp, in_scope
from shelfmark.operators.status import failure_reason

_SHOWN = [
    ("Title", "Title"), ("Subtitle", "Subtitle"), ("Spec: Capacity", "Spec_Capacity"), ("Spec: Output", "Spec_Output"),
    ("Spec: Ports", "Spec_Ports"), ("Spec: Weight", "Spec_Weight"), ("Spec: Warranty", "Spec_Warranty"),
    ("Bullet 1", "Bullet_1"), ("Bullet 2", "Bullet_2"), ("Bullet 3", "Bullet_3"), ("Bullet 4", "Bullet_4"),
]


def field_provenance(catalogue: DataFrame) -> DataFrame:
    """Row x 11 fields: effective value, where it came from, tier."""
    def entry(label: str, field: str) -> Column:
        source = F.coalesce(F.nullif(F.col(f"Source_{field}"), F.lit("")), F.col("Source_URL"))
        tier = F.coalesce(F.col(f"Tier_{field}"), F.lit("1"))
        return F.struct(
            F.lit(label).alias("field"), F.coalesce(effective(field, catalogue), F.lit("*Empty*")).alias("value"),
            F.coalesce(filled(source), F.lit("*None*")).alias("source"), F.coalesce(filled(tier), F.lit("-")).alias("tier"))

    entries = F.array(*[entry(label, field) for label, field in _SHOWN])
    return catalogue.select(F.col("Product_ID").alias("product_id"), F.inline(entries).alias("field", "value", "source", "tier"))


def run_report(catalogue: DataFrame, brand: str | None = None, category: str | None = None) -> DataFrame:
    """Rows of the report by section, with the dealer price. Section 'all' repeats every row."""
    df = in_scope(catalogue, brand, category)
    status = F.coalesce("Status", F.lit("Pending"))
    default_flags = (F.when(status == "Blocked", F.lit("Contradiction detected"))
                     .when(status == "Skipped", F.lit("All source tiers exhausted"))
                     .when(status == "Deferred", F.lit("Deferred due to infrastructure failure")))
    section = F.when(status.isin("Blocked", "Skipped", "Deferred"), F.lower(status))
    sections = F.array_compact(F.array(section, F.lit("all")))
    return df.select(
        F.explode(sections).alias("section"), F.col("Brand").alias("brand"), F.col("Product_ID").alias("product_id"),
        F.col("Model_Name").alias("model_name"), status.alias("status"),
        F.coalesce(filled(F.col("Flags")), default_flags).alias("flags"), F.coalesce("Attempts", F.lit(0)).alias("attempts"),
        effective_dp().alias("dealer_price"), F.coalesce("Image_Source", F.lit("None")).alias("image_source"),
        F.coalesce("Image_Tier", F.lit("N/A")).alias("image_tier"),
        F.coalesce(filled(F.col("LLM_Provider")), F.lit("N/A")).alias("copy_provider"))


def fix_log_lines(catalogue: DataFrame) -> DataFrame:
    """The log of failed rows, one entry per row."""
    default = F.when(F.col("Status") == "Deferred", F.lit("Deferred")).otherwise(F.lit("No attempts logged"))
    log = F.coalesce(F.nullif(F.col("Fix_Log"), F.lit("")), default)
    failed = catalogue.where(F.col("Status").isin("Blocked", "Skipped", "Deferred"))
    lines = failed.select(F.col("Product_ID").alias("product_id"), F.posexplode(F.split(log, "\n")).alias("line_no", "entry"))
    return lines.where(~is_blank(F.col("entry"))).withColumn("entry", strip(F.col("entry")))


def presentation(catalogue: DataFrame, brand: str | None = None, category: str | None = None) -> DataFrame:
    """The final review table."""
    df = in_scope(catalogue, brand, category)

    def shown(field: str) -> Column:
        return F.coalesce(strip(filled(F.col(f"Override_{field}"))), strip(filled(F.col(f"Raw_{field}"))), F.lit("-"))

    mrp = effective_mrp()
    whole = F.format_number(mrp.try_cast("double").try_cast("bigint"), 0)
    flags = F.replace(F.col("Flags"), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(flags) > 40, F.concat(F.substring(flags, 1, 37), F.lit("..."))).otherwise(flags)
    return df.select(
        F.col("Product_ID").alias("product_id"), F.coalesce("Model_Name", F.lit("")).alias("model_name"),
        F.coalesce("Display_Name", F.lit("")).alias("display_name"), F.coalesce("Status", F.lit("")).alias("status"),
        shown("Spec_Capacity").alias("capacity"), shown("Spec_Output").alias("output"),
        F.coalesce(F.concat(F.lit("₹"), F.coalesce(whole, mrp)), F.lit("-")).alias("mrp"),
        F.coalesce(filled(F.col("Image_Status")), F.lit("-")).alias("image_status"),
        F.when(is_blank(F.col("Flags")), F.lit("Clean")).otherwise(short).alias("flags"))


def row_results(catalogue: DataFrame, brand: str | None = None, category: str | None = None) -> DataFrame:
    """The result of a run, one line per row."""
    tier = F.coalesce(F.nullif("Tier_Title", F.lit("")), F.nullif("Tier_Spec_Capacity", F.lit("")), F.lit("1"))
    return in_scope(catalogue, brand, category).select(
        F.col("Product_ID").alias("product_id"), F.col("Model_Name").alias("model_name"),
        F.col("Display_Name").alias("display_name"), F.col("Status").alias("status"), F.col("Source_URL").alias("source_url"),
        tier.alias("tier"), F.coalesce("Image_Status", F.lit("missing")).alias("image_status"),
        F.coalesce("Attempts", F.lit(0)).alias("attempts"), F.col("Fix_Log").alias("fix_log"), F.col("Flags").alias("flags"),
        failure_reason().alias("failure_reason"))
