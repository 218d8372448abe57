"""From a price sheet to catalogue rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import brands, counts, onboarding, validation
from shelfmark.operators.status import enforce_display_names


@dataclass
class Sheet:
    """A sheet after ingest: its rows, what is doubtful about them, and a preview."""

    rows: DataFrame
    duplicates: DataFrame
    incomplete: DataFrame
    usable: DataFrame
    summary: DataFrame

#: Offenders that an error names; it counts all, and carries them as a DataFrame.
SHOWN = 20


def ingest(raw: DataFrame, roles: dict[str, str], brand_name: str, brand_code: str, category: str) -> Sheet:
    """Map the columns of a raw sheet (with sheet and row_idx), guard the display names, look for duplicates."""
    rows = onboarding.map_price_columns(raw, roles).where(F.coalesce("model_name", F.lit("")) != "")
    for column in ("display_name", "raw_text", "notes"):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast("string"))
    rows = rows.withColumns({"brand_name": F.lit(brand_name), "brand_code": F.lit(brand_code), "category": F.lit(category)})
    rows = enforce_display_names(rows)
    return Sheet(
        rows=rows,
        duplicates=onboarding.sheet_duplicates(rows),
        incomplete=validation.missing_fields(rows).where(F.size("missing") > 0),
        usable=counts.sheet_usable(rows),
        summary=onboarding.onboarding_summary(rows),
    )


def confirm(catalogue: DataFrame, sheet: DataFrame, config: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, brand config) after a person accepted the rows. Names used twice in a submission are refused."""
    named = sheet.withColumn("sheet", F.col("brand_name"))
    twice = validation.duplicate_display_names(named).select("display_name").distinct()
    total = twice.count()
    if total:
        names = ", ".join(r.display_name for r in twice.orderBy("display_name").limit(SHOWN).collect())
        more = f" and {total - SHOWN} more" if total > SHOWN else ""
        error = ValueError(f"Duplicate Display_Name detected: {names}{more}. Each product must have a unique Display_Name.")
        error.offenders = twice  # all of them, as a DataFrame
        raise error
    return onboarding.upsert_price_sheet(catalogue, sheet), brands.upsert_brand_config(config, learned)
