"""From catalogue rows and recorded sources to reviewed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import schema
from shelfmark.functions.text import filled, parse_price, strip
from shelfmark.functions.urls import url_key
from shelfmark.operators import brochures, matching, merge, status, validation
from shelfmark.operators.brands import resolve_brand_config
from shelfmark.operators.resolve import effective_dp
from shelfmark.session import checkpointed


def products_of(catalogue: DataFrame, config: DataFrame) -> DataFrame:
    """Catalogue rows as things to look for, with the brand's variant words and the sheet prices."""
    wanted = catalogue.select(
        F.col("Product_ID").alias("product_id"), strip("Brand").alias("brand"), strip("Model_Name").alias("model_name"),
        F.nullif(strip("Category"), F.lit("")).alias("category"),
        F.coalesce(filled(F.col("Override_Spec_Capacity")), filled(F.col("Raw_Spec_Capacity"))).alias("target_capacity"),
        effective_dp().alias("dp"),
        F.coalesce(F.col("Override_MRP"), parse_price(F.col("MRP_Display"))).alias("mrp"), "MRP_Display")
    return resolve_brand_config(wanted, config).withColumnRenamed("qualifier_tokens", "qualifiers")


def tiers_of(sources: list[tuple[str, str, int]], spark) -> DataFrame:
    """(source, tier_label, source_rank) of the listing sources, in search order."""
    rows = [(source, label, i) for i, (source, label, _) in enumerate(sources)]
    return spark.createDataFrame(rows, "source string, tier_label string, source_rank int")


def collect(catalogue: DataFrame, config: DataFrame, listings: DataFrame, pages: DataFrame, tiers: DataFrame,
            copy: DataFrame, brochure_pages: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """Match, read and merge everything collectable; rows without a confirmed page are skipped with a reason.

    listings: see matching.find_pairs. pages: the output of pages.observe_pages. tiers: source, tier_label,
    source_rank (one row per listing source). copy: drafted texts by product_id.
    """
    rows = status.select_collectable(catalogue)
    products = checkpointed(products_of(rows, config))
    memory = matching.parse_rejections(rows)
    found = matching.find_pairs(products, listings)
    short = matching.shortlist(products, listings, memory, found=found)

    read = pages.select(
        url_key(F.col("url")).alias("url_key"), F.col("title").alias("page_title"), F.col("price").alias("page_price"),
        "specs", "description", "images", "page_state", "success")
    facts = products.select("product_id", "dp", "mrp")
    seen = short.join(read, "url_key").join(facts, "product_id").join(tiers, "source")
    # written once: read by the match, the log and the outcome
    verified = checkpointed(matching.verdict(seen.where(F.col("page_state") == "ok"), verdicts))
    matched = matching.pick_match(verified)
    gone = seen.where(F.col("page_state") == "delisted").withColumns({"decision": F.lit("delisted"), "decision_reason": F.lit("product page no longer exists")})
    learnt = checkpointed(_learnt(memory, verified, gone))

    entry = ["product_id", "tier_rank", "tier_label", "seq", "source_url", "tier_name", "description", "images", "specs", "price"]
    used = matched.withColumns({
        "tier_rank": F.col("source_rank") + 1, "seq": F.lit(0).cast("bigint"), "source_url": F.col("url"),
        "tier_name": F.concat(F.lit("tier-"), "tier_label", F.lit(": "), "source", F.lit(" ("), F.col("url"), F.lit(")")),
        "price": F.col("page_price")}).select(*entry)
    if brochure_pages is not None:
        scope = F.lower("brand")
        attached = brochures.match_brochures(products.withColumn("scope", scope), brochure_pages)
        used = used.unionByName(attached.select(
            "product_id", F.lit(0).alias("tier_rank"), F.lit("0").alias("tier_label"), F.lit(0).cast("bigint").alias("seq"),
            "source_url", F.concat(F.lit("tier-0: ("), "source_url", F.lit(")")).alias("tier_name"),
            F.col("section").alias("description"), F.array().cast("array<string>").alias("images"), "specs",
            F.lit(None).cast("double").alias("price")))
    with_specs = checkpointed(used).where(F.size(F.map_keys("specs")) > 0)
    keys = ["product_id", "tier_rank", "tier_label", "source_url", "seq"]
    observed = with_specs.select(*keys, F.explode("specs").alias("field", "value")).unionByName(
        with_specs.where("price is not null").select(*keys, F.lit("mrp").alias("field"), F.col("price").cast("string").alias("value")))
    first = merge.merge_by_tier(observed, products)
    stop = merge.sufficient_rank(merge.first_values(observed), products)
    merged = merge.merge_pages(with_specs, stop)
    wide = merge.wide_provenance(first, merged, products.select("product_id", "category", "MRP_Display"))
    wide = wide.join(merged.select("product_id", F.get("images", F.lit(0)).alias("Image_URL")), "product_id").withColumn(
        "Status", F.lit("Pending"))
    drafted = checkpointed(merge.with_copy(wide, copy))

    missing = products.join(drafted.select("product_id"), "product_id", "left_anti")
    ambiguous = matching.ambiguous_names(matching.near_miss_candidates(missing, found, memory))
    log = verified.select("product_id", "source_rank", "rank", "url", "title", "decision", "decision_reason")
    outcome = matching.collection_outcome(missing, log, ambiguous)

    new = [c for c in drafted.columns if c in schema.CATALOGUE.names and c not in ("Product_ID", "MRP_Display")]
    updates = drafted.select(F.col("product_id").alias("_pid"), F.struct(*new).alias("_new"))
    skipped = outcome.select(F.col("product_id").alias("_skip"), F.struct("Status", "Flags").alias("_why"))
    df = catalogue.join(updates, F.col("Product_ID") == F.col("_pid"), "left").join(
        skipped, F.col("Product_ID") == F.col("_skip"), "left")
    got, lost = F.col("_pid").isNotNull(), F.col("_skip").isNotNull()
    df = df.join(learnt, F.col("Product_ID") == F.col("_known"), "left")
    out = {c: F.when(got, F.col(f"_new.{c}").try_cast(schema.CATALOGUE[c].dataType)).otherwise(F.col(c)) for c in new}
    for c in ("Status", "Flags"):
        out[c] = F.when(lost, F.col(f"_why.{c}")).otherwise(out.get(c, F.col(c)))
    out["Rejected_URLs"] = F.coalesce("_rejected", out.get("Rejected_URLs", F.col("Rejected_URLs")))
    out["Fix_Log"] = F.when(F.col("_note").isNull(), out.get("Fix_Log", F.col("Fix_Log"))).otherwise(
        F.concat_ws("\n", filled(out.get("Fix_Log", F.col("Fix_Log"))), "_note"))
    return checkpointed(df.withColumns(out).select(*catalogue.columns))


def _learnt(memory: DataFrame, verified: DataFrame, gone: DataFrame) -> DataFrame:
    """_known (product), _rejected, _note: what the search found out about pages, for products that it read pages of.

    Pages judged to be another product's and pages that are gone are never tried again; the last verdicts are noted.
    """
    columns = ["product_id", "url", "title", "decision", "decision_reason", "source_rank", "rank"]
    decided = verified.select(*columns).unionByName(gone.select(*columns)).withColumns({
        "reason": F.col("decision_reason"), "provider": F.lit(None).cast("string"),
        # behind everything that the memory holds, in the order of the search
        "seq": F.lit(1 << 40).cast("bigint") + F.col("source_rank") * 1000 + F.col("rank")})
    kept = matching.remember_rejections(memory.join(decided.select("product_id").distinct(), "product_id", "left_semi"), decided)
    cells = matching.format_rejections(kept).withColumnsRenamed({"product_id": "_p", "Rejected_URLs": "_rejected"})
    notes = matching.verifier_notes(decided)
    return notes.join(cells, F.col("product_id") == F.col("_p"), "left").select(F.col("product_id").alias("_known"), "_rejected", F.col("note").alias("_note"))


def review(catalogue: DataFrame, config: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Attach image and brand facts once, then validate, fix and settle every row."""
    faced = validation.with_duplicate_images(validation.with_image_facts(catalogue, assets))
    wanted = faced.withColumnsRenamed({"Brand": "brand", "Category": "category"})
    known = resolve_brand_config(wanted.select("brand", "category").distinct(), config).select(
        F.col("brand").alias("_b"), F.col("category").alias("_c"), F.col("qualifier_tokens").alias("qualifiers"))
    match = F.col("Brand").eqNullSafe(F.col("_b")) & F.col("Category").eqNullSafe(F.col("_c"))
    ready = faced.join(known, match, "left").drop("_b", "_c")
    return checkpointed(status.review(checkpointed(ready), validation.validate))
