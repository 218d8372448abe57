"""Deterministic checks: hard flags that stop a row, warnings that travel with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.functions.categories import category_key, primary_specs
from shelfmark.functions.copywriting import boilerplate_phrase, claims_warranty
from shelfmark.functions.names import is_subset, spec_quantities
from shelfmark.functions.text import contains_any, filled, is_blank, search, slugify, strip
from shelfmark.operators.matching import qualifier_conflict, qualifier_message
from shelfmark.operators.ranking import top_k
from shelfmark.operators.resolve import effective, with_image_path

RAW_FIELDS = [(f"Raw_{f}", f"Source_{f}") for f in fixed.PROVENANCE_FIELDS]


class UnsourcedValue(Exception):
    """A collected value would be stored without saying where it came from."""


def _has(column: str) -> Column:
    if column == "Raw_MRP_Scraped":
        return F.col(column).isNotNull() & ~F.isnan(column)
    return ~is_blank(F.col(column))


def unsourced(raw: str, source: str) -> Column:
    """Is the collected field filled while neither its own source nor the row's page is known?"""
    return _has(raw) & is_blank(F.col(source)) & is_blank(F.col("Source_URL"))


def unsourced_fields() -> Column:
    """The collected fields of a row that break the rule; overrides are exempt."""
    return F.array_compact(F.array(*[F.when(unsourced(r, s), F.lit(r)) for r, s in RAW_FIELDS]))


def assert_sourced(catalogue: DataFrame) -> None:
    """Refuse to write a table in which any row breaks the provenance rule."""
    worst = (
        catalogue.withColumn("_bad", unsourced_fields()).where(F.size("_bad") > 0)
        .select("Product_ID", F.get("_bad", F.lit(0)).alias("field")).limit(1).collect()
    )
    if worst:
        raise UnsourcedValue(
            f"Product {worst[0].Product_ID}: field '{worst[0].field}' has a value, but neither its source field nor "
            "'Source_URL' says where it came from")


def sourced_or_fail(catalogue: DataFrame) -> DataFrame:
    """The same guard inside the job: the first bad row fails the task, without a second pass over the data."""
    message = F.concat(F.lit("no verified source for product "), F.coalesce("Product_ID", F.lit("UNKNOWN")))
    guard = F.when(F.size(unsourced_fields()) > 0, F.raise_error(message)).otherwise(F.lit(True))
    return catalogue.where(guard.cast("boolean"))


# --- facts from other rows and files ------------------------------------------------------------------


def with_image_facts(catalogue: DataFrame, assets: DataFrame | None) -> DataFrame:
    """Add image_path and, where the file exists, its length, width, height and md5."""
    df = with_image_path(catalogue, assets)
    if assets is None:
        return df.withColumns({
            "image_length": F.lit(None).cast("bigint"), "image_width": F.lit(None).cast("int"),
            "image_height": F.lit(None).cast("int"), "image_md5": F.lit(None).cast("string")})
    facts = assets.select(
        F.col("path").alias("image_path"), F.col("length").alias("image_length"), F.col("width").alias("image_width"),
        F.col("height").alias("image_height"), F.col("md5").alias("image_md5"))
    return df.join(facts, "image_path", "left")


def with_duplicate_images(df: DataFrame, order: str = "Product_ID") -> DataFrame:
    """Add duplicate_image_of: the first other active product whose image file has the same content.

    Identical files are reduced to one row per path first; two paths per content are enough to answer for every row.
    """
    active = df.where(F.col("image_md5").isNotNull() & (F.coalesce("Status", F.lit("")) != "Skipped"))
    paths = active.groupBy("image_md5", "image_path").agg(
        F.min_by("Product_ID", order).alias("owner"), F.min(order).alias("_at"))
    two = top_k(paths, ["image_md5"], [F.col("_at"), F.col("image_path")], 2, "_n")
    pair = two.groupBy("image_md5").agg(
        F.min_by(F.struct("owner", "image_path"), "_n").alias("_one"),
        F.max_by(F.struct("owner", "image_path"), "_n").alias("_two"), F.max("_n").alias("_paths"))
    shared = pair.where(F.col("_paths") > 1).drop("_paths")
    other = F.when(F.col("_one.image_path") != F.col("image_path"), F.col("_one.owner")).otherwise(F.col("_two.owner"))
    # rows without an image meet nothing; they are dealt by product, not to the one place of a null
    asked = df.withColumn("_content", F.coalesce(F.col("image_md5"), F.concat(F.lit("none "), F.col("Product_ID").cast("string"))))
    shared = shared.withColumnRenamed("image_md5", "_content")
    return asked.join(shared, "_content", "left").withColumn("duplicate_image_of", other).drop("_content", "_one", "_two")


# --- the rules ----------------------------------------------------------------------------------------


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _numbers_of(text: Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(text, r"([a-zA-Z]+)(\d+)", "$1 $2"), r"(\d+)([a-zA-Z]+)", "$1 $2")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(split, F.lit(r"\b\d+\b"), F.lit(0))))


def _as_list(values: Column) -> Column:
    return _say("['", F.array_join(values, "', '"), "']")


def _effective_columns(df: DataFrame) -> dict[str, Column]:
    names = ["Title", "Subtitle", *fixed.SPEC_FIELDS, *fixed.BULLETS]
    return {f"_e_{n}": effective(n, df) for n in names}


def validate(df: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Add hard_flags, warnings and is_passed.

    df is a catalogue with the image facts and duplicate_image_of attached, and optionally a qualifiers array column
    (the brand's variant words).
    """
    if "qualifiers" not in df.columns:
        df = df.withColumn("qualifiers", F.lit(None).cast("array<string>"))
    columns = df.columns
    df = df.withColumns(_effective_columns(df)).withColumns({
        "_raw_title": F.coalesce(strip(F.col("Raw_Title")), F.lit("")),
        "_has_title": ~is_blank(F.col("Raw_Title")) | ~is_blank(F.col("Override_Title")),
        "_key": category_key(F.col("Category")),
        "_model": F.coalesce(strip(F.col("Model_Name")), F.lit("")),
    })
    # what the rules name more than once is a column, worked out once a row
    slug = F.substring_index(F.substring_index(F.rtrim(F.col("Source_URL"), F.lit("/")), "/", -1), "?", 1)
    df = df.withColumns({
        "_clash": qualifier_conflict(F.col("_raw_title"), F.col("_model"), F.col("qualifiers"), None),
        "_in_slug": _numbers_of(slug), "_in_title": _numbers_of(F.coalesce("_e_Title", "Model_Name", F.lit(""))),
    })
    e = {n: F.col(f"_e_{n}") for n in ["Title", "Subtitle", *fixed.SPEC_FIELDS, *fixed.BULLETS]}
    hard: list[Column] = []
    warn: list[Column] = []

    status = F.coalesce("Status", F.lit(""))
    hard.append(
        F.when(status == "Blocked", F.lit("Product marked as Blocked"))
        .when(status == "Deferred", F.lit("Product deferred due to infrastructure error"))
        .when(~F.col("_has_title"), F.lit("All spec tiers exhausted without finding technical specifications")))

    hard.append(F.when((F.col("_raw_title") != "") & F.col("_clash").isNotNull(), _say(
        "Qualifier token mismatch: ", qualifier_message(F.col("_clash"), F.col("_raw_title"), F.col("_model"), None))))

    power = F.col("_key") == "powerbank"
    named = search(F.col("_model"), rf"(?i)\b({fixed.CAPACITIES_IN_NAME})\s*(?:mah)?\b", 1)
    stated = search(F.replace(e["Spec_Capacity"], F.lit(","), F.lit("")), rf"\b({fixed.CAPACITIES_IN_NAME})\b", 1)
    hard.append(F.when(power & (named != stated), _say(
        "Capacity mismatch: Model_Name specifies ", named, "mAh but collected spec is ", stated, "mAh")))

    for name in fixed.BULLETS:
        hard.append(F.when(e[name].isNotNull(), _say(
            f"Boilerplate detected in {name}: '", boilerplate_phrase(e[name]), "'")))

    specs = ["Spec_Capacity", "Spec_Output", "Spec_Ports", "Spec_Weight"]
    missing = F.array_compact(F.array(*[F.when(e[s].isNull(), F.lit(s.removeprefix("Spec_").lower())) for s in specs]))
    bullets = F.size(F.array_compact(F.array(*[e[b] for b in fixed.BULLETS])))
    empty = F.size(missing)
    hard.append(
        F.when(power & (empty > 2), _say("Insufficient specifications: ", empty.cast("string"),
                                         " of 4 required specs are empty (fewer than 2 populated)"))
        .when(~power & (empty == 4) & (bullets < 2), F.lit(
            "Insufficient specifications: No technical specifications or feature bullets found across available sources")))
    warn.append(
        F.when(power & (empty == 2), _say("Partial specifications: 2 of 4 specs empty (", F.array_join(missing, ", "), ")"))
        .when(~power & (empty == 4) & (bullets >= 2),
              F.lit("Specifications derived directly from verified product description")))

    for raw, source in RAW_FIELDS:
        hard.append(F.when(unsourced(raw, source), F.lit(
            f"FATAL BUG: Field '{raw}' populated without verified source URL in '{source}' or 'Source_URL'")))

    path = F.col("image_path")
    present = F.coalesce(F.col("image_length") > 0, F.lit(False))
    width, height = F.col("image_width"), F.col("image_height")
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit("px"))
    warn.append(F.when(~present, _say("Image missing on disk at '", path, "'")))
    expected = F.concat(slugify(F.col("_model")), F.lit(".png"))
    actual = F.substring_index(path, "/", -1)
    hard.append(F.when(present & is_blank(F.col("Override_Image_Path")) & (actual != expected), _say(
        "Image filename mismatch: expected '", expected, "', got '", actual, "'")))
    hard.append(F.when(present, _say(
        "Duplicate image asset: identical file hash to product [", F.col("duplicate_image_of"), "]")))
    hard.append(F.when(present & (width.isNull() | height.isNull()), _say(
        "Corrupted image file at '", path, "': unreadable")))
    warn.append(F.when(present & ((width < 800) | (height < 800)), _say(
        "Image resolution below target: ", size, " (min required 800x800px)")))
    oblong = F.abs(width - height) / F.greatest(width, height) > 0.01
    warn.append(F.when(present & oblong, _say(
        "Image is not square (1:1): ", size, "; tile is 290x290px square and will crop")))

    for name in fixed.BULLETS:
        text = strip(e[name])
        hard.append(F.when(F.length(text) > 60, _say(
            f"{name} exceeds 60-character wrap limit (", F.length(text).cast("string"), " chars): '", text, "'")))
        hard.append(F.when(claims_warranty(text, strict_reference), _say(
            f"Disallowed warranty claim in {name}: '", text, "'")))
    hard.append(F.when((bullets < 2) & F.col("_has_title"), _say(
        "Thin copy: Product has fewer than 2 bullets (", bullets.cast("string"), " present)")))
    hard.append(F.when(claims_warranty(e["Subtitle"], strict_reference), _say(
        "Disallowed warranty claim in Subtitle: '", e["Subtitle"], "'")))

    origin = filled(F.col("Image_Source"))
    warn.append(F.when(~contains_any(F.lower(origin), ["brand", "official", "local-verified"]), _say(
        "Image sourced from secondary channel: ", origin)))
    overridden = ~is_blank(F.col("Override_Title")) | ~is_blank(F.col("Override_Subtitle")) | (
        F.col("Override_MRP").isNotNull() & ~F.isnan("Override_MRP")) | ~is_blank(
        F.col("Override_Spec_Capacity")) | ~is_blank(F.col("Override_Bullet_1"))
    live = F.coalesce(F.col("Source_URL").startswith("http"), F.lit(False))
    warn.append(F.when(overridden & ~live, F.lit(
        "Manual override data present with no live scraped source URL to cross-check")))
    scraped, dealer = F.col("Raw_MRP_Scraped"), F.col("MRP_Input")
    warn.append(F.when(~F.isnan(scraped) & ~F.isnan(dealer) & (scraped < dealer), _say(
        "Scraped MRP (₹", F.format_number(scraped, 0), ") is lower than DP (₹", F.format_number(dealer, 0),
        ") — potential product mismatch or bad parse")))
    in_slug, in_title = F.col("_in_slug"), F.col("_in_title")
    apart = (F.size(in_slug) > 0) & (F.size(in_title) > 0) & ~is_subset(in_slug, in_title) & ~is_subset(in_title, in_slug)
    warn.append(F.when(live & apart, _say(
        "URL slug numeric token mismatch: slug '", slug, "' contains numbers ", _as_list(in_slug),
        " but title/model contains ", _as_list(in_title), " (potential reused URL handle)")))

    df = df.withColumns({"hard_flags": F.array_compact(F.array(*hard)), "warnings": F.array_compact(F.array(*warn))})
    return df.select(*columns, "hard_flags", "warnings", (F.size("hard_flags") == 0).alias("is_passed"))


def spec_completeness(df: DataFrame) -> DataFrame:
    """Add missing_specs (primary specs of the category without a value, from a specs map) and n_missing."""
    wanted = primary_specs(category_key(F.col("category")))
    missing = F.filter(wanted, lambda s: is_blank(F.col("specs")[s]))
    return df.withColumns({"missing_specs": missing, "n_missing": F.size(missing)})


def build_error(products: DataFrame, assets: DataFrame) -> DataFrame:
    """Add build_error: the first reason a resolved product may not be printed, or null."""
    files = assets.select(F.col("path").alias("image_path"), F.col("length").alias("_length"))
    df = products.join(files, "image_path", "left")
    pid = F.coalesce("product_id", F.lit("UNKNOWN"))
    model, brand, subtitle = (F.coalesce(F.col(c), F.lit("")) for c in ("model_name", "brand", "subtitle"))
    spaced = r"\b(?:[A-Za-z]\s+){3,}[A-Za-z]\b"
    start = _say("Build validation failed: Product ", pid)

    def fail(*parts: Column | str) -> Column:
        return F.concat(start, *[F.lit(p) if isinstance(p, str) else p for p in parts])

    error = (
        F.when(strip(model) == "", fail(" is missing 'Model_Name'"))
        .when(strip(brand) == "", fail(" is missing 'Brand'"))
        .when(strip(subtitle) == "", fail(" (", model, ") is missing 'Subtitle'"))
        .when(F.size("bullets") == 0, fail(" (", model, ") has no bullets defined"))
        .when(F.coalesce("image_path", F.lit("")) == "", fail(" (", model, ") is missing 'Local_Image_Path'"))
        .when(is_blank(F.col("mrp")), fail(" (", model, ") is missing pricing/MRP field"))
        .when(F.coalesce("_length", F.lit(0)) == 0,
              fail(" (", model, ") image file not found or empty at '", F.col("image_path"), "'"))
        .when(F.contains(model, F.lit("  ")), fail(" Model_Name contains double spaces: '", model, "'"))
        .when(model != strip(model), fail(" Model_Name has leading/trailing spaces: '", model, "'"))
    )
    for label, value in (("Model_Name", model), ("Brand", brand), ("Subtitle", subtitle)):
        error = error.when(value.rlike(spaced), fail(f" {label} contains broken spaced-out letters: '", value, "'"))
    return df.withColumn("build_error", error).drop("_length")


def duplicate_display_names(rows: DataFrame) -> DataFrame:
    """Names used more than once in a submission. rows: sheet, display_name, model_name."""
    shown = F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.col("model_name"))
    named = rows.select("sheet", F.lower(strip(shown)).alias("name"), shown.alias("_shown"))
    return (
        named.where(F.col("name") != "").groupBy("sheet", "name")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("_shown").alias("display_name"))
        .where(F.col("n_rows") > 1)
    )


def missing_fields(df: DataFrame) -> DataFrame:
    """Add missing: what a submitted row still lacks; prices may be written as text."""
    def no_price(column: str) -> Column:
        value = F.regexp_replace(F.col(column).cast("string"), r"[^0-9.]", "").try_cast("double")
        return F.coalesce(value, F.lit(0.0)) <= 0

    return df.withColumn("missing", F.array_compact(F.array(
        F.when(is_blank(F.col("model_name")), F.lit("Model Name")),
        F.when(no_price("dp"), F.lit("DP")), F.when(no_price("mrp"), F.lit("MRP")))))


def copy_contradictions(df: DataFrame) -> DataFrame:
    """Add contradictions: figures in the copy or the model name that disagree with the specifications."""
    capacity, output = effective("Spec_Capacity", df), effective("Spec_Output", df)
    mah, watts = spec_quantities(capacity)[0], spec_quantities(output)[1]

    def apart(mine: Column, theirs: Column) -> Column:
        return (F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(mine, theirs)

    found = [F.when(apart(spec_quantities(F.col("Model_Name"))[0], mah),
                    F.lit("Model_Name capacity differs from specification"))]
    for field in ("Subtitle", *fixed.BULLETS):
        said_mah, said_watts = spec_quantities(effective(field, df))
        found.append(F.when(apart(said_mah, mah), F.lit(f"{field} capacity differs from specification")))
        found.append(F.when(apart(said_watts, watts), F.lit(f"{field} wattage differs from specification")))
    return df.withColumn("contradictions", F.array_compact(F.array(*found)))
