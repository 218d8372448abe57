"""Brand configuration as a table: lookup with defaults, and merging what was learned.

config: brand, category (null for the brand's own row), domain, platform, collection_url, qualifier_tokens (array),
retail_order (array), waf_blocked, waf_vendor, waf_reason, waf_blocked_at, waf_bypass_via. The brand '_default' holds
what applies to all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schema
from shelfmark.functions.text import contains_any, filled, is_blank, strip

CONFIG = T.StructType([
    T.StructField("brand", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("domain", T.StringType()), T.StructField("platform", T.StringType()),
    T.StructField("collection_url", T.StringType()),
    T.StructField("qualifier_tokens", T.ArrayType(T.StringType())),
    T.StructField("retail_order", T.ArrayType(T.StringType())),
    T.StructField("waf_blocked", T.BooleanType()), T.StructField("waf_vendor", T.StringType()),
    T.StructField("waf_reason", T.StringType()), T.StructField("waf_blocked_at", T.TimestampType()),
    T.StructField("waf_bypass_via", T.StringType()),
])
BRAND_LEVEL = ["domain", "platform", "retail_order", "waf_blocked", "waf_vendor", "waf_reason", "waf_blocked_at", "waf_bypass_via"]
CATEGORY_LEVEL = ["collection_url", "qualifier_tokens"]
DEFAULT = "_default"


class CategoryRequired(ValueError):
    """Category settings may not be written at brand level."""


def resolve_brand_config(wanted: DataFrame, config: DataFrame) -> DataFrame:
    """Settings for each (brand, category) asked for.

    A brand's own values go over the defaults. Category settings come from the brand if it has any categories, else from
    the defaults; an unknown category has no collection page and no variant words.
    """
    config = schema.conform(config, CONFIG).withColumns({
        "_b": F.lower("brand"), "_c": F.lower(strip("category"))})
    own = config.where(F.col("category").isNull())
    by_category = config.where(F.col("category").isNotNull())
    # one row, also where there are several rows of defaults (the first by their values) or none
    base = own.where(F.col("brand") == DEFAULT).agg(F.min(F.struct(*[F.col(c).alias(f"_d_{c}") for c in BRAND_LEVEL])).alias("_d")).select("_d.*")
    default_categories = by_category.where(F.col("brand") == DEFAULT).select(
        F.col("_c").alias("_dc"), *[F.col(c).alias(f"_d_{c}") for c in CATEGORY_LEVEL])
    brands = own.where(F.col("brand") != DEFAULT).select("_b", F.lit(True).alias("_known"), *BRAND_LEVEL)
    has_categories = by_category.select("_b").distinct().withColumn("_has_categories", F.lit(True))
    categories = by_category.where(F.col("brand") != DEFAULT).select("_b", "_c", F.lit(True).alias("_found"), *CATEGORY_LEVEL)
    asked = wanted.withColumns({"_b": F.lower(F.col("brand")), "_c": F.lower(strip("category"))})
    df = (
        asked.join(brands, "_b", "left").join(has_categories, "_b", "left")
        .join(categories, ["_b", "_c"], "left")
        .join(default_categories, F.col("_c") == F.col("_dc"), "left")
        .join(F.broadcast(base), F.lit(True), "left")
    )
    use_default = F.col("_has_categories").isNull()
    empty = F.array().cast("array<string>")
    any_category = F.coalesce("_c", F.lit("")) != ""
    found = F.col("_found").isNotNull() | (use_default & F.col("_dc").isNotNull())
    url = F.when(use_default, F.col("_d_collection_url")).otherwise(F.col("collection_url"))
    words = F.when(use_default, F.col("_d_qualifier_tokens")).otherwise(F.col("qualifier_tokens"))
    return df.select(
        *[asked[c] for c in wanted.columns],
        *[F.coalesce(F.col(c), F.col(f"_d_{c}")).alias(c) for c in BRAND_LEVEL],
        F.when(any_category & found, url).alias("collection_url"),
        F.when(any_category, F.when(found, words).otherwise(empty)).alias("qualifier_tokens"),
    )


def upsert_brand_config(config: DataFrame, learned: DataFrame) -> DataFrame:
    """Merge learned settings: given values replace, variant words are united in order.

    Collection page and variant words belong to a category; giving them without one is an error.
    """
    # rows of one brand follow each other by seq, and by their values where that is the same or missing
    seq = learned["seq"].cast("bigint") if "seq" in learned.columns else F.lit(0).cast("bigint")
    new = schema.conform(learned.withColumn("_seq", seq), CONFIG, keep=("_seq",)).withColumn(
        "_when", F.struct("_seq", F.to_json(F.struct(*CONFIG.names)).alias("v"))).drop("_seq")
    misplaced = new.where(is_blank(F.col("category")) & (
        filled(F.col("collection_url")).isNotNull() | (F.coalesce(F.size("qualifier_tokens"), F.lit(0)) > 0)))
    if not misplaced.isEmpty():
        raise CategoryRequired("collection_url and qualifier_tokens need a category")
    none = F.lit(None).cast("string")
    brand_rows = new.withColumns({"category": none, "collection_url": none, "qualifier_tokens": F.lit(None).cast("array<string>")})
    category_rows = new.where(~is_blank(F.col("category"))).withColumns(
        {"category": strip("category"), **{c: F.lit(None).cast(CONFIG[c].dataType) for c in BRAND_LEVEL}})
    both = brand_rows.unionByName(category_rows).withColumns({"_b": F.lower("brand"), "_c": F.lower("category")})

    def last(c: str):
        # the latest row that has the value
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_when"))).alias(f"_n_{c}")

    values = both.groupBy("_b", "_c").agg(
        F.min("brand").alias("_brand"), F.min("category").alias("_category"), *[last(c) for c in BRAND_LEVEL + ["collection_url"]])
    # variant words by their first row and place in it; a list is as long as the words are different
    word = both.select("_b", "_c", "_when", F.posexplode("qualifier_tokens").alias("_at", "_word")).groupBy("_b", "_c", "_word").agg(
        F.min(F.struct("_when", "_at")).alias("_first"))
    words = word.groupBy("_b", "_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_word"))), lambda x: x["_word"]).alias("_n_qualifier_tokens"))
    same = values["_b"].eqNullSafe(words["_b"]) & values["_c"].eqNullSafe(words["_c"])
    latest = values.join(words.select(*[F.col(c) for c in words.columns]), same, "left").select(
        *[values[c] for c in values.columns], words["_n_qualifier_tokens"])
    old = schema.conform(config, CONFIG).withColumns({"_b": F.lower("brand"), "_c": F.lower("category")})
    match = old["_b"].eqNullSafe(latest["_b"]) & old["_c"].eqNullSafe(latest["_c"])
    df = old.join(latest, match, "full_outer")
    united = F.array_distinct(F.concat(F.coalesce("qualifier_tokens", F.array().cast("array<string>")),
                                      F.coalesce("_n_qualifier_tokens", F.array().cast("array<string>"))))
    category = F.coalesce("category", "_category")
    out = {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in BRAND_LEVEL + ["collection_url"]}
    # a brand's own row never carries category settings
    out["collection_url"] = F.when(category.isNotNull(), out["collection_url"])
    out["qualifier_tokens"] = F.when(category.isNotNull(), united)
    return df.select(F.coalesce("brand", "_brand").alias("brand"), category.alias("category"),
                     *[out[f.name].alias(f.name) for f in CONFIG.fields if f.name in out])


def blocked_record(blocks: DataFrame) -> DataFrame:
    """What to learn from blocked responses. blocks: brand, domain, platform, vendor, reason, seen_at."""
    latest = blocks.groupBy("brand").agg(F.max_by(F.struct("domain", "platform", "vendor", "reason", "seen_at"), "seen_at").alias("_b"))
    return latest.select(
        "brand", F.col("_b.domain").alias("domain"), F.coalesce("_b.platform", F.lit("custom")).alias("platform"),
        F.lit(True).alias("waf_blocked"), F.col("_b.vendor").alias("waf_vendor"),
        F.coalesce("_b.reason", F.lit("HTTP 403 Bot Challenge")).alias("waf_reason"), F.col("_b.seen_at").alias("waf_blocked_at"))


def brand_profile(config: DataFrame) -> DataFrame:
    """What is known and what is missing per brand and category: one row per finding, in a fixed order."""
    known = schema.conform(config, CONFIG)
    own = known.where(F.col("category").isNull()).select("brand", "domain", "platform", "waf_blocked", "waf_vendor", "waf_reason")
    df = known.where(F.col("category").isNotNull()).select("brand", "category", "collection_url", "qualifier_tokens").join(
        own, "brand", "left")
    blocked, has_domain = F.coalesce("waf_blocked", F.lit(False)), filled(F.col("domain")).isNotNull()
    words = F.coalesce("qualifier_tokens", F.array().cast("array<string>"))
    block_text = F.concat(F.lit("WAF block recorded ("), F.coalesce("waf_vendor", F.lit("WAF")), F.lit(": "),
                          F.coalesce("waf_reason", F.lit("Bot Challenge")), F.lit(")"))

    def entry(found: bool, text: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(found).alias("found"), text.alias("finding")))

    has_url = filled(F.col("collection_url")).isNotNull()
    findings = F.array_compact(F.array(
        entry(True, block_text, blocked),
        entry(True, F.concat(F.lit("Domain: "), F.col("domain")), has_domain),
        entry(False, F.lit("Domain: Not found / no official storefront verified"), ~has_domain),
        entry(True, F.concat(F.lit("Platform: "), F.coalesce("platform", F.lit("custom"))), has_domain & ~blocked),
        entry(True, F.concat(F.lit("Collection URL: "), F.col("collection_url")), has_domain & ~blocked & has_url),
        entry(False, F.lit("Collection URL: Not found in standard paths or sitemaps"), has_domain & ~blocked & ~has_url),
        entry(True, F.concat(F.lit("Qualifier tokens ("), F.size(words).cast("string"), F.lit(" tokens): "),
                             F.array_join(words, ", ")), F.lit(True)),
    ))
    return df.select("brand", "category", F.posexplode(findings).alias("pos", "_f")).select("brand", "category", "pos", "_f.*")


def detect_platform(headers: Column, html: Column) -> Column:
    """Shop software behind a recorded page. headers is a map."""
    head = F.lower(F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"])), " "))
    head, body = F.coalesce(head, F.lit("")), F.lower(F.coalesce(html, F.lit("")))
    return (
        F.when(F.contains(head, F.lit("shopify")), F.lit("shopify"))
        .when(contains_any(body, ["cdn.shopify.com", "myshopify.com", "shopify.theme"]), F.lit("shopify"))
        .when(F.contains(body, F.lit("woocommerce")), F.lit("woocommerce"))
        .when(F.contains(head, F.lit("x-magento-")) | contains_any(body, ["mage/", "text/x-magento-init"]), F.lit("magento"))
        .when(F.contains(body, F.lit("bigcommerce")), F.lit("bigcommerce"))
        .otherwise(F.lit("custom"))
    )


def probe_platform(status: Column, html: Column) -> Column:
    """The lighter variant used in the onboarding summary."""
    body = F.lower(F.coalesce(html, F.lit("")))
    return (
        F.when(status.isin(401, 403, 429), F.lit("custom"))
        .when(contains_any(body, ["cdn.shopify.com", "shopify.theme"]), F.lit("shopify"))
        .when(contains_any(body, ["woocommerce", "wp-content"]), F.lit("woocommerce"))
        .when(contains_any(body, ["mage/", "magento"]), F.lit("magento"))
        .when(F.contains(body, F.lit("bigcommerce")), F.lit("bigcommerce"))
        .otherwise(F.lit("custom"))
    )
