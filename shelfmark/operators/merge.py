"""Merging what several sources say about a product.

Sources are ranked by tier: an earlier tier wins, later ones only fill gaps, and every value keeps its source.
All choices are aggregates with a map-side combine, so a product with a third of all observations is no problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.functions.categories import category_key, min_specs, primary_specs, spec_columns
from shelfmark.functions.text import filled, strip


def tier_rank(label: Column, store_rank: Column | None = None) -> Column:
    """Position of a tier in the escalation order; stores of the last tier follow their own order."""
    position = F.array_position(F.array(*[F.lit(t) for t in fixed.TIERS]), label) - 1
    stores = F.coalesce(store_rank, F.lit(0)) if store_rank is not None else F.lit(0)
    is_retail = label.isin("3", "3-vision")
    # a store's page comes before its image reading, and both before the next store
    retail = F.lit(6) + stores * 2 + F.when(label == "3-vision", F.lit(1)).otherwise(F.lit(0))
    return F.when(is_retail, retail).otherwise(position).cast("int")


def retail_ranks(brand_config: DataFrame) -> DataFrame:
    """(brand, store, store_rank) from the configured order of retailers."""
    default = F.array(*[F.lit(s) for s in fixed.DEFAULT_RETAIL_ORDER])
    return brand_config.select(
        "brand", F.posexplode(F.coalesce(F.col("retail_order"), default)).alias("store_rank", "store")
    )


def first_values(observations: DataFrame) -> DataFrame:
    """Per product and field, the first filled value in tier order with its source, tier and rank."""
    # of entries with one place the smallest counts, whatever task it came through
    where = F.struct("tier_rank", "seq", "source_url", "value", "tier_label")
    picked = F.min_by(F.struct("value", "source_url", "tier_label", "tier_rank"), where)
    usable = observations.where(filled(F.col("value")).isNotNull() & F.col("tier_rank").isNotNull())
    return usable.groupBy("product_id", "field").agg(picked.alias("_p")).select("product_id", "field", "_p.*")


def sufficient_rank(first: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, stop_rank): the tier after which enough primary specs are known; null if never.

    A primary spec becomes known at the rank of its first value, so the answer is the k-th smallest of at most
    a handful of ranks.
    """
    key = category_key(F.col("category"))
    wanted = products.select("product_id", primary_specs(key).alias("_primary"), min_specs(key).alias("_min"))
    seen = (
        first.join(wanted, "product_id")
        .where(F.array_contains(F.col("_primary"), F.col("field")))
        .groupBy("product_id", "_min")
        .agg(F.array_sort(F.collect_list("tier_rank")).alias("_ranks"))
    )
    return seen.select("product_id", F.get("_ranks", F.col("_min") - 1).alias("stop_rank"))


def merge_by_tier(observations: DataFrame, products: DataFrame) -> DataFrame:
    """First value per field, with tiers beyond the sufficient one left out.

    products needs product_id and category. The result is long: one row per product and known field.
    """
    first = first_values(observations)
    stop = sufficient_rank(first, products)
    return (
        first.join(stop, "product_id", "left")
        .where(F.col("stop_rank").isNull() | (F.col("tier_rank") <= F.col("stop_rank")))
        .drop("stop_rank")
    )


def merge_price(observations: DataFrame, products: DataFrame) -> DataFrame:
    """The first price in tier order; none is taken when the sheet already gives an MRP."""
    prices = observations.where(F.col("field") == "mrp").withColumn(
        "value", F.when(F.col("value").try_cast("double") > 0, F.col("value")))
    wanted = products.where(filled(F.col("MRP_Display")).isNull()).select("product_id")
    return first_values(prices).join(wanted, "product_id", "left_semi")


def one_page_per_tier(pages: DataFrame) -> DataFrame:
    """The page used for each product and tier: the first to arrive. Bounds pages per product by the tiers."""
    rest = [c for c in pages.columns if c not in ("product_id", "tier_rank")]
    # images may be null or long; of pages that arrived together the first by address counts
    first = F.min_by(F.struct(*rest), F.struct("seq", "source_url", "tier_name", "description"))
    return pages.groupBy("product_id", "tier_rank").agg(first.alias("_p")).select("product_id", "tier_rank", "_p.*")


def merge_pages(pages: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Per product: description (joined in tier order), first non-empty image list, and the provenance line.

    pages: product_id, tier_rank, tier_label, seq, source_url, tier_name, description, images.
    """
    used = one_page_per_tier(pages)
    if stop is not None:
        used = used.join(stop, "product_id", "left").where(
            F.col("stop_rank").isNull() | (F.col("tier_rank") <= F.col("stop_rank")))
    # at most one entry per tier
    ordered = F.array_sort(F.collect_list(F.struct("tier_rank", "tier_label", "source_url", "tier_name", "description", "images")))
    merged = used.groupBy("product_id").agg(ordered.alias("_t"))
    texts = F.filter(F.transform("_t", lambda t: t["description"]), lambda d: F.coalesce(d, F.lit("")) != "")
    images = F.filter(F.transform("_t", lambda t: t["images"]), lambda i: F.coalesce(F.size(i), F.lit(0)) > 0)
    names = F.transform("_t", lambda t: t["tier_name"])
    return merged.select(
        "product_id",
        F.get("_t", F.lit(0))["source_url"].alias("source_url"),
        F.get("_t", F.lit(0))["tier_label"].alias("tier_label"),
        strip(F.array_join(texts, "\n")).alias("description"),
        F.get(images, F.lit(0)).alias("images"),
        F.array_join(names, " + ").alias("provenance"),
    )


def wide_provenance(merged: DataFrame, pages: DataFrame, products: DataFrame) -> DataFrame:
    """Back to catalogue columns: Raw_, Source_ and Tier_ of the four shared spec columns and of the price.

    The field's own source is used; the page's address stands in when a value has none. Warranty is known in the
    long table but never written.
    """
    entry = F.struct("value", "source_url", "tier_label")
    specs = merged.groupBy("product_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("field"), entry))).alias("_f"))
    df = products.join(specs, "product_id", "left").join(
        pages.select("product_id", F.col("source_url").alias("Source_URL"), F.col("provenance").alias("Source_Audit"),
                     "tier_label"),
        "product_id", "left")
    values = F.transform_values("_f", lambda _, e: e["value"])
    chosen = spec_columns(category_key(F.col("category")), values)
    out: dict[str, Column] = {}
    for column, pick in chosen.items():
        source = F.col("_f")[pick["spec"]]
        out[f"Raw_{column}"] = pick["value"]
        out[f"Source_{column}"] = F.when(pick["value"].isNotNull(), F.coalesce(source["source_url"], F.col("Source_URL")))
        out[f"Tier_{column}"] = F.when(pick["value"].isNotNull(), source["tier_label"])
    for part in ("Raw", "Source", "Tier"):
        out[f"{part}_Spec_Warranty"] = F.lit(None).cast("string")
    price = F.when(filled(F.col("MRP_Display")).isNull(), F.col("_f")["mrp"])
    out["Raw_MRP_Scraped"] = price["value"].try_cast("double")
    out["Source_MRP_Scraped"] = F.when(price.isNotNull(), F.coalesce(price["source_url"], F.col("Source_URL")))
    out["Tier_MRP_Scraped"] = price["tier_label"]
    return df.withColumns(out).drop("_f")


def with_copy(collected: DataFrame, copy: DataFrame) -> DataFrame:
    """Attach drafted copy (a table keyed by product_id) with its provenance; no copy means the row is deferred."""
    drafted = copy.select(
        "product_id", F.lit(True).alias("_drafted"),
        *[F.col(c).alias(f"_c_{c}") for c in ("title", "subtitle", "bullet_1", "bullet_2", "bullet_3", "bullet_4")])
    df = collected.join(drafted, "product_id", "left")
    has = F.col("_drafted").isNotNull()
    out: dict[str, Column] = {}
    for field, column in [("Title", "title"), ("Subtitle", "subtitle")] + [(b, b.lower()) for b in fixed.BULLETS]:
        value = filled(F.col(f"_c_{column}"))
        out[f"Raw_{field}"] = F.when(has, value)
        out[f"Source_{field}"] = F.when(has & value.isNotNull(), F.col("Source_URL"))
        out[f"Tier_{field}"] = F.when(has & value.isNotNull(), F.col("tier_label"))
    out["Status"] = F.when(has, F.col("Status")).otherwise(F.lit("Deferred"))
    out["Flags"] = F.when(~has, F.lit("Deferred: LLM copy drafting failed due to infrastructure error"))
    return df.withColumns(out).drop("_drafted", *[c for c in df.columns if c.startswith("_c_")])


def image_gate() -> Column:
    """struct(approved, score, rejection) from a supplied picture audit."""
    score = F.coalesce(F.col("quality_score"), F.lit(5))
    good = F.coalesce(F.col("is_isolated_packshot"), F.lit(True))
    wrong = ~F.coalesce(F.col("is_correct_brand_and_model"), F.lit(True))
    rejection = (
        F.when(wrong, F.concat(F.lit("Wrong brand detected: '"), F.coalesce("detected_brand", F.lit("")),
                               F.lit("' (expected '"), F.col("brand"), F.lit("')")))
        .when(F.col("has_promotional_text_banner"), F.lit("Marketing infographic banner with promotional text overlays"))
        .when(F.col("has_hand_holding"), F.lit("Hand-held lifestyle shot instead of isolated studio packshot"))
        .when((score < 7) | ~good, F.coalesce(F.nullif(F.col("rejection_reason"), F.lit("")),
              F.lit("Low visual packshot quality / complex lifestyle background")))
    )
    return F.struct(
        rejection.isNull().alias("approved"),
        F.when(wrong, F.lit(0)).otherwise(score).cast("int").alias("score"),
        rejection.alias("rejection"),
    )


def pick_images(products: DataFrame, candidates: DataFrame, assets: DataFrame) -> DataFrame:
    """Choose each product's image by tier.

    products: product_id, image_path. candidates: product_id, tier, pos, url, source, approved, score, rejection.
    assets: path, width, height of files that exist. An existing file wins; then the first approved of the first six
    brand images; then a marketplace image; then the best rejected image with a score above zero.
    """
    brand_tries = (F.col("tier") == 1) & (F.col("pos") < fixed.BRAND_IMAGES_TRIED)
    tried = candidates.where(brand_tries | (F.col("tier") == 3))
    look = F.struct("tier", "pos")
    entry = F.struct("url", "source", "tier", "score", "rejection")
    rejected = ~F.col("approved") & (F.col("score") > 0)
    best = tried.groupBy("product_id").agg(
        F.min_by(entry, F.when(F.col("approved"), look)).alias("_ok"),
        F.min_by(entry, F.when(rejected, F.struct((-F.col("score")).alias("s"), "tier", "pos"))).alias("_fallback"),
        F.count_if("approved").alias("_n_ok"), F.count_if(rejected).alias("_n_fallback"))
    files = assets.select(F.col("path").alias("image_path"), "width", "height")
    df = products.join(files, "image_path", "left").join(best, "product_id", "left")
    exists = F.col("width").isNotNull()
    large = (F.col("width") >= 800) & (F.col("height") >= 800)
    ok, spare = F.col("_n_ok") > 0, F.col("_n_fallback") > 0
    described = F.concat(F.col("_fallback.source"), F.lit(" (Score "), F.col("_fallback.score").cast("string"),
                         F.lit("/10: "), F.col("_fallback.rejection"), F.lit(")"))
    return df.select(
        "product_id",
        F.when(exists, F.when(large, F.lit("ok")).otherwise(F.lit("low-res")))
        .when(ok, F.lit("ok")).when(spare, F.lit("needs-better-image")).otherwise(F.lit("missing")).alias("Image_Status"),
        F.when(exists, F.lit("local-verified")).when(ok, F.col("_ok.source")).when(spare, described).alias("Image_Source"),
        F.when(exists, F.lit(1)).when(ok, F.col("_ok.tier")).when(spare, F.col("_fallback.tier")).cast("string")
        .alias("Image_Tier"),
        F.when(exists, F.lit(None)).when(ok, F.col("_ok.url")).when(spare, F.col("_fallback.url")).alias("Image_URL"),
    )
