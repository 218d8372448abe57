"""Price sheets into the catalogue: column roles, duplicates, numbering, idempotent upsert, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schema
from shelfmark.functions.categories import category_prefix
from shelfmark.functions.text import filled, parse_price, search, strip
from shelfmark.functions.urls import golden_url
from shelfmark.operators.ranking import join_facts, ranked
from shelfmark.operators.resolve import in_scope

MODEL, DEALER, RETAIL = "Model_Name", "DP", "MRP"


def map_price_columns(sheet: DataFrame, roles: dict[str, str]) -> DataFrame:
    """A raw sheet as model_name, dp, mrp. Of two prices the lower is DP and the higher MRP; a single one is DP."""
    model = next(c for c, role in roles.items() if role == MODEL)
    prices = [parse_price(F.col(f"`{c}`")) for c, role in roles.items() if role in (DEALER, RETAIL)]
    dp = F.least(*prices) if len(prices) > 1 else (prices[0] if prices else F.lit(None).cast("double"))
    both = F.lit(len(prices) > 1)
    for price in prices:
        both = both & price.isNotNull()
    mrp = F.when(both, F.greatest(*prices)) if len(prices) > 1 else F.lit(None).cast("double")
    rest = [F.col(f"`{c}`") for c in sheet.columns if c not in roles]
    return sheet.select(strip(F.col(f"`{model}`").cast("string")).alias("model_name"), dp.alias("dp"), mrp.alias("mrp"), *rest)


def sheet_duplicates(sheet: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row of the sheet (same brand, model and DP), with the first such row."""
    keyed = sheet.withColumns({"_b": F.lower(strip("brand_name")), "_m": F.lower(strip("model_name"))})
    first = keyed.groupBy("_b", "_m", "dp").agg(F.min("row_idx").alias("duplicates_row_idx"), F.count(F.lit(1)).alias("_n"))
    hits = join_facts(keyed, first.where(F.col("_n") > 1), ["_b", "_m", "dp"])
    return hits.where(F.col("row_idx") > F.col("duplicates_row_idx")).select(
        "brand_name", "model_name", "dp", "row_idx", "duplicates_row_idx")


def assign_product_ids(new_rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add product_id: prefix-code-NNN, counting on from the brand's highest number and stepping over taken ids.

    new_rows: brand_name, brand_code, category, row_idx. Brands that share prefix and code share one count.
    """
    rows = new_rows.withColumns({"_prefix": category_prefix(F.col("category")), "_code": F.col("brand_code")})
    rows = rows.withColumns({"_group": F.lower(F.concat_ws("-", "_prefix", "_code")),
                             "_brand": F.lower(strip("brand_name"))})
    ids = catalogue.select(F.lower(strip("Brand")).alias("_brand"), F.lower(strip("Product_ID")).alias("_pid")).select(
        "_brand", search(F.col("_pid"), r"^(.*)-(\d+)$", 1).alias("_group"),
        search(F.col("_pid"), r"^(.*)-(\d+)$", 2).alias("_digits"))
    ids = ids.where(F.col("_group").isNotNull()).withColumn("_seq", F.col("_digits").try_cast("bigint"))
    owners = rows.select("_group", "_brand").distinct()
    highest = ids.join(owners, ["_group", "_brand"]).groupBy("_group").agg(F.max("_seq").alias("_top"))
    base = owners.select("_group").distinct().join(highest, "_group", "left").select(
        "_group", (F.coalesce("_top", F.lit(0)) + 1).alias("_base"))
    # ids in the way: written exactly as a new id would be, at or above the starting number
    padded = F.when(F.length(F.col("_seq").cast("string")) >= 3, F.col("_seq").cast("string")).otherwise(
        F.lpad(F.col("_seq").cast("string"), 3, "0"))
    taken = ids.where(F.col("_digits") == padded).select("_group", "_seq").distinct().join(base, "_group").where(
        F.col("_seq") >= F.col("_base"))
    counted = join_facts(ranked(rows, ["_group"], [F.col("_brand"), F.col("row_idx")], "_k"), base, ["_group"])
    if taken.isEmpty():
        counted = counted.withColumn("_n", F.col("_base") + F.col("_k") - 1)
    else:
        # the k-th free number is found by merging new rows and taken numbers into one order
        order = ranked(taken, ["_group"], [F.col("_seq")], "_j")
        free_before = order.select("_group", "_base", (F.col("_seq") - F.col("_base") - F.col("_j") + 2).alias("_at"),
                                   F.lit(0).alias("_kind"))
        merged = ranked(
            counted.withColumns({"_at": F.col("_k"), "_kind": F.lit(1)}).unionByName(free_before, allowMissingColumns=True),
            ["_group"], [F.col("_at"), F.col("_kind")], "_u")
        counted = merged.where(F.col("_kind") == 1).withColumn("_n", F.col("_base") + F.col("_u") - 1)
    number = F.when(F.col("_n") >= 1000, F.col("_n").cast("string")).otherwise(F.lpad(F.col("_n").cast("string"), 3, "0"))
    return counted.withColumn("product_id", F.concat_ws("-", "_prefix", "_code", number)).select(
        *new_rows.columns, "product_id")


def upsert_price_sheet(catalogue: DataFrame, sheet: DataFrame, order: str = "Product_ID") -> DataFrame:
    """The catalogue after a sheet: known products are updated in place, unknown ones appended as Pending.

    A product is known by brand, category and model name, whatever the case. Running the same sheet twice changes
    nothing more. The result has an upsert column: updated, inserted or null.
    """
    key = ["_b", "_c", "_m"]
    rows = sheet.withColumn("category", F.coalesce(filled(F.col("category")), F.lit("Powerbank")))
    rows = rows.withColumns({"_b": F.lower(strip("brand_name")), "_c": F.lower(strip("category")),
                             "_m": F.lower(strip("model_name"))})
    owned = catalogue.withColumns({"_b": F.lower(strip("Brand")), "_c": F.lower(strip("Category")),
                                   "_m": F.lower(strip("Model_Name"))})
    # the last sheet row per key wins; of several catalogue rows with the key the first is updated
    last = rows.groupBy(*key).agg(F.max_by(F.struct("category", "display_name", "dp", "mrp"), "row_idx").alias("_s"))
    target = owned.join(last.select(*key), key, "left_semi").groupBy(*key).agg(F.min(order).alias("_first"))
    changes = target.join(last, key).drop(*key).withColumnRenamed("_first", "_at")
    joined = owned.join(changes, F.col(order) == F.col("_at"), "left")
    hit, s = F.col("_at").isNotNull(), F.col("_s")
    restart = hit & F.col("Status").isin("Pending", "Skipped", "Deferred")
    updated = joined.withColumns({
        "Category": F.when(hit, s["category"]).otherwise(F.col("Category")),
        "Display_Name": F.when(hit, s["display_name"]).otherwise(F.col("Display_Name")),
        "MRP_Input": F.when(hit, s["dp"]).otherwise(F.col("MRP_Input")),
        "MRP_Display": F.when(hit, s["mrp"].cast("string")).otherwise(F.col("MRP_Display")),
        "Attempts": F.when(restart, F.lit(0)).otherwise(F.col("Attempts")),
        "Flags": F.when(~F.coalesce(restart, F.lit(False)), F.col("Flags")),
        "Fix_Log": F.when(~F.coalesce(restart, F.lit(False)), F.col("Fix_Log")),
        "Status": F.when(restart, F.lit("Pending")).otherwise(F.col("Status")),
        "upsert": F.when(hit, F.lit("updated")),
    }).select(*catalogue.columns, "upsert")
    unknown = rows.join(owned.select(*key).distinct(), key, "left_anti").drop(*key)
    fresh = assign_product_ids(unknown, catalogue).select(
        F.col("product_id").alias("Product_ID"), strip("brand_name").alias("Brand"), F.col("category").alias("Category"),
        strip("model_name").alias("Model_Name"), F.col("display_name").alias("Display_Name"), F.col("dp").alias("MRP_Input"),
        F.col("mrp").cast("string").alias("MRP_Display"), F.lit("Pending").alias("Status"), F.lit(0).alias("Attempts"),
        F.lit("inserted").alias("upsert"))
    return updated.unionByName(fresh, allowMissingColumns=True)


# --- edits --------------------------------------------------------------------------------------------

_LIMITS = {"subtitle": 80, "bullet_1": 60, "bullet_2": 60, "bullet_3": 60, "bullet_4": 60}
_OVERRIDES = {"title": "Override_Title", "subtitle": "Override_Subtitle", "bullet_1": "Override_Bullet_1",
              "bullet_2": "Override_Bullet_2", "bullet_3": "Override_Bullet_3", "bullet_4": "Override_Bullet_4",
              "dp": "Override_DP", "mrp": "Override_MRP"}


def apply_edits(catalogue: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, rejected): set or clear overrides.

    edits: product_id, seq, changes (map field -> text; a null value clears). One bad field rejects the whole edit.
    """
    def complaint(field: str) -> Column:
        given = F.map_contains_key("changes", F.lit(field))
        value = F.col("changes")[field]
        if field in _LIMITS:
            text = strip(value)
            bad = F.length(text) > _LIMITS[field]
            said = F.concat(F.lit(f"{field} exceeds {_LIMITS[field]}-character limit ("), F.length(text).cast("string"),
                            F.lit(" characters given)"))
        else:
            number = value.try_cast("double")
            bad = value.isNotNull() & (number.isNull() | (number < 0))
            said = F.concat(F.lit(f"Invalid {field} value '"), value, F.lit("'. Must be a non-negative number."))
        return F.when(given & bad, said)

    checked = edits.withColumns({
        "_id": F.lower(strip("product_id")),
        "reason": F.coalesce(*[complaint(f) for f in _OVERRIDES if f != "title"]),
    })
    known = catalogue.select(F.lower(strip("Product_ID")).alias("_id"), F.lit(True).alias("_known")).distinct()
    checked = checked.join(known, "_id", "left").withColumn(
        "reason", F.coalesce(F.when(F.col("_known").isNull(), F.lit("Product_ID not found in catalogue data")), "reason"))
    rejected = checked.where(F.col("reason").isNotNull()).select("product_id", "seq", "reason")
    single = checked.where(F.col("reason").isNull()).select("_id", "seq", F.explode("changes").alias("field", "value"))
    latest = single.groupBy("_id", "field").agg(F.max(F.struct("seq", "value")).alias("_v"))  # of edits with one seq the largest value counts
    # at most one entry per editable field
    packed = latest.groupBy("_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.col("_v.value").alias("value")))).alias("_e"))
    df = catalogue.withColumn("_id", F.lower(strip("Product_ID"))).join(packed, "_id", "left")
    out = {}
    for field, column in _OVERRIDES.items():
        value = F.col("_e")[field]
        new = value.try_cast("double") if field in ("dp", "mrp") else strip(filled(value))
        out[column] = F.when(F.coalesce(F.map_contains_key("_e", F.lit(field)), F.lit(False)), new).otherwise(F.col(column))
    return df.withColumns(out).select(*catalogue.columns), rejected


def apply_image_overrides(catalogue: DataFrame, edits: DataFrame, smallest: int = 1200) -> tuple[DataFrame, DataFrame]:
    """(catalogue, rejected): set (path with both sides large enough) or clear (null path) the image override.

    edits: product_id, seq, path, width, height.
    """
    small = F.col("path").isNotNull() & (F.coalesce(F.least("width", "height"), F.lit(0)) < smallest)
    why = F.concat(F.lit("Image resolution ("), F.coalesce(F.col("width").cast("string"), F.lit("?")), F.lit("x"),
                   F.coalesce(F.col("height").cast("string"), F.lit("?")),
                   F.lit(f"px) is below the required {smallest}x{smallest}px minimum"))
    rejected = edits.where(small).select("product_id", "seq", why.alias("reason"))
    latest = edits.where(~small).groupBy(F.lower(strip("product_id")).alias("_id")).agg(
        F.max_by(F.struct("path"), "seq").alias("_v"))
    df = catalogue.withColumn("_id", F.lower(strip("Product_ID"))).join(latest, "_id", "left")
    given, path = F.col("_v").isNotNull(), F.col("_v.path")
    return df.withColumns({
        "Override_Image_Path": F.when(given, path).otherwise(F.col("Override_Image_Path")),
        "Image_Status": F.when(given & path.isNotNull(), F.lit("ok")).otherwise(F.col("Image_Status")),
    }).select(*catalogue.columns), rejected


def attach_brochure(catalogue: DataFrame, brand: str, path: str | None, category: str | None = None) -> DataFrame:
    """Set (or with None clear) the brochure of all rows of a brand and, optionally, a category."""
    inside = F.lower("Brand") == brand.strip().lower()
    if category and category.strip():
        inside = inside & (F.lower("Category") == category.strip().lower())
    new = F.lit(path).cast("string")
    return catalogue.withColumn("Brochure_PDF", F.when(F.coalesce(inside, F.lit(False)), new).otherwise(F.col("Brochure_PDF")))


def attached_brochure(catalogue: DataFrame, brand: str | None = None, category: str | None = None,
                      order: str = "Product_ID") -> DataFrame:
    """The brochure of each brand in scope: the first one any of its rows names."""
    named = in_scope(catalogue, brand, category)
    return named.groupBy("Brand").agg(
        strip(F.min_by("Brochure_PDF", F.when(F.col("Brochure_PDF").isNotNull(), F.col(order)))).alias("brochure_path"))


# --- baseline -----------------------------------------------------------------------------------------


def golden_diff(replay: DataFrame, baseline: DataFrame) -> DataFrame:
    """Products whose replayed page differs from the baseline; addresses compare without query, slash and www."""
    a = replay.select("product_id", F.lit(True).alias("_in_replay"), F.col("source_url").alias("actual"))
    b = baseline.select("product_id", F.lit(True).alias("_in_baseline"), F.col("source_url").alias("expected"))
    same = golden_url(F.col("actual")).eqNullSafe(golden_url(F.col("expected")))
    both = F.col("_in_replay").isNotNull() & F.col("_in_baseline").isNotNull()
    kind = (F.when(F.col("_in_replay").isNull(), F.lit("missing in replay"))
            .when(F.col("_in_baseline").isNull(), F.lit("missing in baseline")).otherwise(F.lit("source_url")))
    return a.join(b, "product_id", "full_outer").where(~(both & same)).select("product_id", kind.alias("field"), "actual", "expected")


# --- summaries of a sheet -----------------------------------------------------------------------------


def onboarding_summary(sheet: DataFrame) -> DataFrame:
    """Preview of a sheet: provisional ids, whole-unit prices, and the row each duplicate repeats."""
    numbered = ranked(sheet, ["brand_name"], [F.col("row_idx")], "_n")
    first = sheet.groupBy(F.lower("brand_name").alias("_b"), F.lower("model_name").alias("_m"), F.col("dp").alias("_dp")).agg(
        F.min("row_idx").alias("_first"), F.count(F.lit(1)).alias("_c"))
    keyed = numbered.withColumns({"_b": F.lower("brand_name"), "_m": F.lower("model_name"), "_dp": F.col("dp")})
    df = join_facts(keyed, first.where(F.col("_c") > 1), ["_b", "_m", "_dp"])
    number = F.when(F.col("_n") >= 1000, F.col("_n").cast("string")).otherwise(F.lpad(F.col("_n").cast("string"), 3, "0"))

    def price(column: str) -> Column:
        return F.coalesce(F.format_number(F.col(column).cast("bigint"), 0), F.lit("TBD"))

    return df.select(
        "brand_name", "row_idx", F.concat(F.lit("PB-"), "brand_code", F.lit("-"), number).alias("preview_id"), "model_name",
        "display_name", price("dp").alias("dp"), price("mrp").alias("mrp"),
        F.coalesce(filled(F.col("notes")), F.lit("-")).alias("notes"),
        F.when(F.col("row_idx") > F.col("_first"), F.col("_first")).alias("duplicates_row_idx"))


def merge_catalogue(catalogue: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Append rows that may lack columns."""
    return catalogue.unionByName(schema.conform(new_rows, schema.CATALOGUE), allowMissingColumns=True)
