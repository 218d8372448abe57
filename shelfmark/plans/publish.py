"""From approved rows to the publication table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import counts, publishing, validation
from shelfmark.operators.resolve import approved_only, in_scope, resolve_products


#: Offenders that an error names; it counts all, and carries them as a DataFrame.
SHOWN = 20


class NotPublishable(Exception):
    """Something stands in the way of publication."""


def publish(catalogue: DataFrame, assets: DataFrame, brand_order: list[str] | None = None, brand: str | None = None,
            category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(publication table in print order, page plan). Refuses when nothing is approved, an image is missing or a row is bad."""
    approved = approved_only(in_scope(catalogue, brand, category))
    if approved.isEmpty():
        raise NotPublishable("no approved products in scope")
    resolved = resolve_products(approved, assets)
    lacking = counts.missing_assets(resolved, assets)
    total = lacking.count()
    if total:
        some = lacking.orderBy("product_id").limit(SHOWN).collect()
        named = "; ".join(f"{r.product_id} ({r.model_name}): image missing at '{r.image_path}'" for r in some)
        error = NotPublishable(f"{total} approved products lack an image: {named}" + (" ..." if total > SHOWN else ""))
        error.offenders = lacking  # all of them, as a DataFrame
        raise error
    bad = validation.build_error(resolved, assets).where("build_error is not null").select("build_error").limit(1).collect()
    if bad:
        raise NotPublishable(bad[0].build_error)
    table = publishing.publication(catalogue, brand_order, brand, category, assets)
    per_brand = table.groupBy("brand").agg(F.count(F.lit(1)).alias("total_products"))
    return publishing.in_print_order(table), counts.page_plan(per_brand)
