"""Effective values, publication, counts and reports over the catalogue derived from part."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schema
from shelfmark.functions import text
from shelfmark.functions import fixed
from shelfmark.functions.categories import category_key, category_prefix
from shelfmark.functions.names import candidate_display_name, identity_tokens, model_portion, model_tokens, spec_quantities
from shelfmark.functions.text import (
    clean_display_name, filled, finite, finite_array, format_price, name_markup, parse_price, slugify, strip_brand_prefix,
    subtitle_markup,
)
from shelfmark.operators import counts, publishing, reports, resolve, status
from workload import duck, inputs
from workload.duck import WITH_CATALOGUE, WITH_FILES, effective, filled as sql_filled, is_blank
from workload.registry import Tables, query

DISPLAY = f"coalesce(trim({sql_filled('Override_Title')}), trim({sql_filled('Display_Name')}), trim(Model_Name))"
DP = "coalesce(Override_DP, MRP_Input)"
MRP = f"coalesce(printf('%.1f', Override_MRP), {sql_filled('MRP_Display')}, printf('%.1f', Raw_MRP_Scraped))"
CATEGORY = "trim(CASE WHEN Category <> '' THEN Category ELSE 'Powerbank' END)"
IN_CATEGORY = f"'images/' || {duck.slug(CATEGORY)} || '/' || {duck.slug('Brand')} || '/' || {duck.slug('Model_Name')} || '.png'"
IN_BRAND = f"'images/' || {duck.slug('Brand')} || '/' || {duck.slug('Model_Name')} || '.png'"
IMAGE_PATH = (f"coalesce(trim({sql_filled('Override_Image_Path')}), (SELECT path FROM assets a WHERE a.path = {IN_CATEGORY}), "
              f"(SELECT path FROM assets a WHERE a.path = {IN_BRAND}), {IN_CATEGORY})")
BULLETS = "list_filter([" + ", ".join(f"trim({effective(b)})" for b in fixed.BULLETS) + "], lambda b: b IS NOT NULL)"


@query("effective_values", f"""{WITH_CATALOGUE} SELECT Product_ID AS product_id, {CATEGORY} AS category, {duck.slug(CATEGORY)} AS category_slug,
    trim(Brand) AS brand, {duck.slug('Brand')} AS brand_slug, {duck.slug('Model_Name')} AS model_slug, {DISPLAY} AS display_name,
    coalesce({effective('Title')}, trim(Brand) || ' ' || trim(Model_Name)) AS title, coalesce({effective('Subtitle')}, '') AS subtitle,
    {DP} AS dp, {MRP} AS mrp, coalesce({effective('Spec_Capacity')}, '') AS capacity, coalesce({effective('Spec_Output')}, '') AS output,
    coalesce({effective('Spec_Ports')}, '') AS ports, coalesce({effective('Spec_Weight')}, '') AS weight,
    array_to_string({BULLETS}, '|') AS bullets, coalesce(Image_Status, 'missing') AS image_status, coalesce(Status, 'Pending') AS status FROM catalogue""")
def effective_values(t: Tables):
    df = resolve.resolve_products(resolve.blank_to_null(inputs.catalogue(t)))
    return df.select(
        "product_id", "category", "category_slug", "brand", "brand_slug", "model_slug", "display_name", "title", "subtitle", "dp", "mrp",
        *[F.col(f"specs.{s}").alias(s) for s in ("capacity", "output", "ports", "weight")],
        F.array_join("bullets", "|").alias("bullets"), "image_status", "status")


@query("image_paths", f"{WITH_FILES} SELECT Product_ID AS product_id, {IMAGE_PATH} AS image_path FROM catalogue")
def image_paths(t: Tables):
    return resolve.with_image_path(inputs.catalogue(t), inputs.assets(t)).select(F.col("Product_ID").alias("product_id"), "image_path")


NAME_MARKUP = (f"CASE WHEN len(string_split_regex(lower({DISPLAY}), '\\s+')) < 2 THEN lower({DISPLAY}) ELSE "
               f"array_to_string(string_split_regex(lower({DISPLAY}), '\\s+')[:-2], ' ') || ' <em>' || string_split_regex(lower({DISPLAY}), '\\s+')[-1] || '</em>' END")
SUBTITLE_MARKUP = (r"""coalesce(regexp_replace({0}, '(?is)^(.*?)\b(\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?\s*(?:mAh|W|V|A))\b', '\1<b class="spec">\2</b>'), '')""")
PUBLICATION = f"""{WITH_CATALOGUE}, p AS (SELECT Product_ID AS product_id, trim(Brand) AS brand, row_order, {DP} AS sort_dp, {DISPLAY} AS name,
    {NAME_MARKUP} AS name_markup, {SUBTITLE_MARKUP.format(f"coalesce({effective('Subtitle')}, '')")} AS subtitle_markup,
    {duck.money(DP)} AS price, {duck.money(MRP)} AS mrp_display FROM catalogue WHERE Status = 'Approved'),
  r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY sort_dp ASC NULLS LAST, product_id) AS index_in_brand, count(*) OVER (PARTITION BY brand) AS total_products,
    min(row_order) OVER (PARTITION BY brand) AS brand_seen FROM p)
  SELECT product_id, brand, name, name_markup, subtitle_markup, price, mrp_display, index_in_brand, total_products, brand_seen,
    CAST(nullif(list_position(['Brand#7', 'Brand#3'], brand), 0) AS BIGINT) AS brand_pos, CAST(ceil(index_in_brand / 2) AS INT) AS page,
    CAST(2 - index_in_brand % 2 AS INT) AS slot, CASE WHEN index_in_brand = total_products AND index_in_brand % 2 = 1 THEN '1-up' ELSE '2-up' END AS layout,
    CASE WHEN index_in_brand >= 100 THEN CAST(index_in_brand AS VARCHAR) ELSE lpad(CAST(index_in_brand AS VARCHAR), 2, '0') END AS index_label,
    CAST(ceil(total_products / 2) AS INT) AS total_pages FROM r"""


@query("publication_pages", PUBLICATION)
def publication_pages(t: Tables):
    table = publishing.publication(inputs.catalogue(t), ["Brand#7", "Brand#3"], order="row_order")
    table = table.withColumn("brand_pos", F.col("brand_pos").cast("bigint"))
    return publishing.in_print_order(table).drop("brand_slug", "category", "bullets", "image_path")


@query("page_plan", f"""{WITH_CATALOGUE} SELECT CAST(1 + sum(1 + ceil(n / 2)) AS BIGINT) AS pages FROM (SELECT Brand, count(*) AS n FROM catalogue WHERE Status = 'Approved' GROUP BY Brand)""")
def page_plan(t: Tables):
    per_brand = resolve.approved_only(inputs.catalogue(t)).groupBy("Brand").agg(F.count(F.lit(1)).alias("total_products"))
    return counts.page_plan(per_brand)


STATUS_OF = "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Pending' ELSE 'Ready_For_Review' END"
ORDER_ROWS = {"Product_ID": "lpad(CAST(o_orderkey AS STRING), 12, '0')", "Brand": "c_mktsegment", "Category": "o_orderpriority", "Status": STATUS_OF,
              "Brochure_PDF": "CASE WHEN o_orderkey % 7 = 3 THEN 'b' || CAST(o_orderkey AS STRING) || '.pdf' ELSE NULL END"}
STATUS_SQL = ", ".join(f"count(*) FILTER (WHERE Status = '{s}') AS {s}" for s in fixed.STATUSES)


def order_rows(t: Tables):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return schema.catalogue(inputs.derive(joined, ORDER_ROWS))


@query("status_counts_by_brand", f"""WITH o AS (SELECT {inputs.select(ORDER_ROWS)} FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT Brand AS brand, Category AS category, count(*) AS total_rows, {STATUS_SQL}, min(Product_ID) AS first_seen,
    arg_min(Brochure_PDF, Product_ID) FILTER (WHERE Brochure_PDF IS NOT NULL) AS brochure_path FROM o GROUP BY ALL""")
def status_counts_by_brand(t: Tables):
    return counts.status_counts(order_rows(t))


@query("run_summary", f"""{WITH_CATALOGUE} SELECT Brand AS brand, count(*) FILTER (WHERE Status = 'Ready_For_Review') AS ready_count, count(*) FILTER (WHERE Status = 'Approved') AS approved_count,
    count(*) FILTER (WHERE Status = 'Blocked') AS blocked_count, count(*) FILTER (WHERE Status = 'Skipped') AS skipped_count, count(*) FILTER (WHERE Status = 'Deferred') AS deferred_count,
    count(*) FILTER (WHERE Status = 'Pending') AS pending_count, count(*) FILTER (WHERE Status IN ('Ready_For_Review', 'Approved')) AS ready_or_approved_count,
    count(*) FILTER (WHERE NOT {is_blank('Flags')} AND Status NOT IN ('Blocked', 'Skipped', 'Deferred')) AS warning_count, count(*) AS total_count FROM catalogue GROUP BY Brand""")
def run_summary(t: Tables):
    return counts.run_summary(inputs.catalogue(t))


@query("categories", f"{WITH_CATALOGUE} SELECT DISTINCT trim(Category) AS category FROM catalogue WHERE trim(Category) <> ''")
def categories(t: Tables):
    return counts.categories(inputs.catalogue(t))


@query("duplicate_skus", """SELECT p_brand AS brand, p_name AS model_name, floor(p_retailprice) AS dp, p_partkey AS product_id, n AS group_size FROM
    (SELECT *, count(*) OVER (PARTITION BY p_brand, p_name, floor(p_retailprice)) AS n FROM part) WHERE n > 1""")
def duplicate_skus(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("Product_ID"), F.col("p_brand").alias("Brand"), F.col("p_name").alias("Model_Name"),
                         F.floor("p_retailprice").cast("double").alias("MRP_Input"))
    return counts.duplicate_skus(rows)


@query("display_name_collisions", f"""{WITH_CATALOGUE} SELECT Brand AS brand, lower(trim(coalesce({sql_filled('Display_Name')}, Model_Name))) AS name, count(*) AS n_rows
    FROM catalogue GROUP BY ALL HAVING count(*) > 1""")
def display_name_collisions(t: Tables):
    return counts.display_name_collisions(inputs.catalogue(t))


@query("pending_estimate", f"""{WITH_CATALOGUE} SELECT Brand AS brand, count(*) AS total_rows, count(*) FILTER (WHERE {is_blank('Raw_Title')} AND {is_blank('Override_Title')}) AS pending,
    2 * count(*) FILTER (WHERE {is_blank('Raw_Title')} AND {is_blank('Override_Title')}) AS calls FROM catalogue GROUP BY Brand""")
def pending_estimate(t: Tables):
    return counts.pending_estimate(inputs.catalogue(t), 2)


@query("missing_assets", f"""{WITH_FILES} SELECT Product_ID AS product_id, trim(Model_Name) AS model_name, {IMAGE_PATH} AS image_path FROM catalogue
    WHERE Status = 'Approved' AND {IMAGE_PATH} NOT IN (SELECT path FROM assets WHERE length > 0)""")
def missing_assets(t: Tables):
    files = inputs.assets(t)
    return counts.missing_assets(resolve.resolve_products(resolve.approved_only(inputs.catalogue(t)), files), files)


@query("brand_models", f"{WITH_CATALOGUE} SELECT DISTINCT Brand AS brand, trim(Model_Name) AS model_name FROM catalogue WHERE NOT {is_blank('Model_Name')}")
def brand_models(t: Tables):
    return counts.brand_models(inputs.catalogue(t))


@query("publish_totals", f"{WITH_CATALOGUE} SELECT count(*) AS product_count, count(DISTINCT Brand) AS brand_count FROM catalogue WHERE Status = 'Approved' AND lower(trim(Category)) = 'powerbank'")
def publish_totals(t: Tables):
    return counts.publish_totals(inputs.catalogue(t), None, " POWERBANK ")


@query("overview_totals", """SELECT count(DISTINCT c_mktsegment) AS brands, count(*) FILTER (WHERE o_orderstatus = 'F') AS approved, count(*) AS total,
    CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN count(*) FILTER (WHERE o_orderstatus = 'F') ELSE count(*) END AS shown FROM orders JOIN customer ON o_custkey = c_custkey""")
def overview_totals(t: Tables):
    return counts.overview_totals(counts.status_counts(order_rows(t)))


@query("unsequenced_brands", f"""{WITH_CATALOGUE} SELECT DISTINCT Brand AS brand FROM catalogue WHERE Status = 'Approved' AND lower(Brand) NOT IN (SELECT lower(p_brand) FROM part GROUP BY p_brand HAVING avg(p_size) > 25)""")
def unsequenced_brands(t: Tables):
    order = t.part.groupBy("p_brand").agg(F.avg("p_size").alias("s")).where("s > 25").select(F.upper("p_brand").alias("brand"))
    return counts.unsequenced_brands(counts.status_counts(inputs.catalogue(t)), order)


SHEET = {"sheet": "p_type || p_brand", "model_name": "CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END", "display_name": "CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE NULL END",
         "dp": "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 0.0 ELSE p_retailprice END", "mrp": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice - 950 END"}


@query("sheet_usable", f"""WITH s AS (SELECT {inputs.select(SHEET)} FROM part), u AS (SELECT sheet, count(*) AS n_rows,
    count(*) FILTER (WHERE NOT {is_blank("coalesce(nullif(model_name, ''), display_name)")} AND (coalesce(dp > 0, false) OR coalesce(mrp > 0, false))) AS n_usable FROM s GROUP BY sheet)
    SELECT *, n_usable >= ceil(n_rows / 2) AS usable FROM u""")
def sheet_usable(t: Tables):
    return counts.sheet_usable(inputs.derive(t.part, SHEET))


# Eight-bit colours out of the first three vector elements.


def colours(element: str, base: int) -> dict[str, str]:
    out = {"brand": "CAST(label AS STRING)", "path": "CAST(vec_id AS STRING)"}
    for i, c in enumerate("rgb"):
        out[c] = f"CAST(greatest(0.0, least(255.0, floor((CAST({element}[{i + base}] AS DOUBLE) + 0.5) * 255))) AS DOUBLE)"
    return out


@query("background_outliers", f"""WITH c AS (SELECT {inputs.select(colours('embedding', 1))} FROM embeddings),
    m AS (SELECT brand, count(*) AS n, median(r) AS median_r, median(g) AS median_g, median(b) AS median_b FROM c GROUP BY brand)
    SELECT brand, path, r, g, b, median_r, median_g, median_b, round(sqrt((r - median_r) ** 2 + (g - median_g) ** 2 + (b - median_b) ** 2), 6) AS distance
    FROM c JOIN m USING (brand) WHERE n >= 2 AND sqrt((r - median_r) ** 2 + (g - median_g) ** 2 + (b - median_b) ** 2) > 60""")
def background_outliers(t: Tables):
    out = counts.background_outliers(inputs.derive(t.embeddings, colours("embedding", 0)), 60.0)
    return out.withColumn("distance", F.round("distance", 6))


# --- reports ------------------------------------------------------------------------------------------


def provenance_sql() -> str:
    parts = []
    for label, field in (("Title", "Title"), ("Subtitle", "Subtitle"), ("Spec: Capacity", "Spec_Capacity"), ("Spec: Output", "Spec_Output"), ("Spec: Ports", "Spec_Ports"),
                         ("Spec: Weight", "Spec_Weight"), ("Spec: Warranty", "Spec_Warranty"), ("Bullet 1", "Bullet_1"), ("Bullet 2", "Bullet_2"), ("Bullet 3", "Bullet_3"), ("Bullet 4", "Bullet_4")):
        source = f"nullif(Source_{field}, '')" if f"Source_{field}" in inputs.CATALOGUE else "NULL"
        tier = f"Tier_{field}" if f"Tier_{field}" in inputs.CATALOGUE else "NULL"
        parts.append(f"""SELECT Product_ID AS product_id, '{label}' AS field, coalesce({effective(field)}, '*Empty*') AS value,
            coalesce({sql_filled(f'coalesce({source}, Source_URL)')}, '*None*') AS source, coalesce({sql_filled(f"coalesce({tier}, '1')")}, '-') AS tier FROM catalogue""")
    return f"{WITH_CATALOGUE} " + " UNION ALL ".join(parts)


@query("provenance_long", provenance_sql())
def provenance_long(t: Tables):
    return reports.field_provenance(inputs.catalogue(t))


REASON = """CASE WHEN Status IN ('Approved', 'Ready_For_Review') THEN NULL
    WHEN contains(lower(f), 'needs your pick') OR contains(lower(f), 'verified as a different product') THEN regexp_replace(f, '(?i)^(?:(?:Skipped|Blocked|Hard Block|Deferred)\\s*:\\s*)+', '')
    WHEN contains(c, 'bot challenge') OR contains(c, '403') OR contains(c, 'blocked by bot') THEN 'Site blocked the request'
    WHEN contains(c, 'exceeded maximum retry') OR contains(c, 'attempts exhausted') THEN 'Exceeded maximum retry attempts'
    WHEN contains(c, 'insufficient specs') OR contains(c, 'specs incomplete') OR contains(c, 'partial specs') THEN 'Specs incomplete after all sources'
    WHEN contains(c, 'all spec tiers exhausted') OR contains(c, 'no verified technical specs') THEN 'No technical specifications found across available sources'
    WHEN contains(c, 'no standalone listing') OR contains(c, 'bundled') OR contains(c, 'accessory') THEN 'No standalone listing found'
    WHEN contains(c, 'delisted') OR contains(c, '404') OR contains(c, 'not found') THEN 'Product page delisted or not found'
    WHEN contains(c, 'duplicate') THEN 'Duplicate product model'
    WHEN contains(c, 'image missing') OR contains(c, 'no image found') THEN 'Product image not found after all tiers'
    WHEN contains(lower(Status), 'deferred') OR contains(c, 'manual review') THEN 'Deferred for manual verification'
    WHEN contains(c, 'semantic audit') OR contains(c, 'hallucination') THEN 'Failed automated semantic consistency check'
    WHEN f <> '' AND lower(f) NOT IN ('nan', 'none', 'clean', '-') THEN CASE WHEN length(s) > 80 THEN s[:77] || '...' ELSE s END
    ELSE 'Collection incomplete' END"""
WITH_REASON = f"""{WITH_CATALOGUE}, r1 AS (SELECT *, trim(coalesce(Flags, '')) AS f, lower(trim(coalesce(Flags, ''))) || ' ' || lower(trim(coalesce(Fix_Log, ''), ' ' || chr(10))) AS c FROM catalogue),
    r2 AS (SELECT *, trim(split_part(regexp_replace(f, '(?i)^(Skipped|Blocked|Hard Block|Deferred)\\s*:\\s*', ''), '.', 1)) AS s FROM r1)"""


@query("failure_reasons", f"{WITH_REASON} SELECT Product_ID AS product_id, Status AS status, {REASON} AS failure_reason FROM r2")
def failure_reasons(t: Tables):
    return inputs.catalogue(t).select(F.col("Product_ID").alias("product_id"), F.col("Status").alias("status"), status.failure_reason().alias("failure_reason"))


@query("row_results", f"""{WITH_REASON} SELECT Product_ID AS product_id, Model_Name AS model_name, Display_Name AS display_name, Status AS status, Source_URL AS source_url,
    coalesce(nullif(Tier_Title, ''), '1') AS tier, coalesce(Image_Status, 'missing') AS image_status, coalesce(Attempts, 0) AS attempts, Fix_Log AS fix_log, Flags AS flags, {REASON} AS failure_reason FROM r2""")
def row_results(t: Tables):
    return reports.row_results(inputs.catalogue(t))


@query("review_view", f"""{WITH_REASON.replace(WITH_CATALOGUE, WITH_FILES)} SELECT Product_ID AS product_id, Model_Name AS model_name, {DISPLAY} AS title, coalesce({effective('Subtitle')}, '') AS subtitle,
    {BULLETS}[1] AS bullet_1, {BULLETS}[2] AS bullet_2, {BULLETS}[3] AS bullet_3, {BULLETS}[4] AS bullet_4, {DP} AS dp, {MRP} AS mrp, Status AS status, Source_URL AS source_url,
    '/' || {IMAGE_PATH} AS image_url, coalesce(Image_Status, 'missing') AS image_status, Flags AS flags, {REASON} AS failure_reason,
    NOT {is_blank('Override_Title')} AS title_set, NOT {is_blank('Override_Subtitle')} AS subtitle_set, NOT {is_blank('Override_Bullet_2')} AS bullet_2_set, Override_DP IS NOT NULL AS dp_set,
    Override_MRP IS NOT NULL AS mrp_set, NOT {is_blank('Override_Image_Path')} AS image_set FROM r2""")
def review_view(t: Tables):
    df = resolve.review_view(inputs.catalogue(t), assets=inputs.assets(t))
    flags = [F.col(f"is_overridden.{n}").alias(f"{n}_set") for n in ("title", "subtitle", "bullet_2", "dp", "mrp", "image")]
    return df.select("*", *flags).drop("is_overridden")


@query("rows_view", f"""{WITH_REASON} SELECT Product_ID AS product_id, Model_Name AS model_name, {DISPLAY} AS display_name, Status AS status, {DP} AS dp, {MRP} AS mrp, Source_URL AS source_url,
    coalesce(Image_Status, 'missing') AS image_status, Flags AS flags, {REASON} AS failure_reason, Attempts AS attempts, Category AS category, Brochure_PDF AS brochure_pdf, Override_Title AS override_title,
    Override_DP AS override_dp, Override_MRP AS override_mrp, Override_Image_Path AS override_image_path FROM r2 WHERE lower(trim(Brand)) = 'brand#4'""")
def rows_view(t: Tables):
    return resolve.rows_view(inputs.catalogue(t), " BRAND#4 ")


@query("run_report", f"""{WITH_CATALOGUE}, s AS (SELECT *, unnest(list_filter([CASE WHEN Status IN ('Blocked', 'Skipped', 'Deferred') THEN lower(Status) END, 'all'], lambda x: x IS NOT NULL)) AS section FROM catalogue)
    SELECT section, Brand AS brand, Product_ID AS product_id, Model_Name AS model_name, Status AS status,
    coalesce({sql_filled('Flags')}, CASE Status WHEN 'Blocked' THEN 'Contradiction detected' WHEN 'Skipped' THEN 'All source tiers exhausted' WHEN 'Deferred' THEN 'Deferred due to infrastructure failure' END) AS flags,
    coalesce(Attempts, 0) AS attempts, {DP} AS dealer_price, coalesce(Image_Source, 'None') AS image_source, coalesce(Image_Tier, 'N/A') AS image_tier, coalesce({sql_filled('LLM_Provider')}, 'N/A') AS copy_provider FROM s""")
def run_report(t: Tables):
    return reports.run_report(inputs.catalogue(t))


@query("fix_log_lines", f"""{WITH_CATALOGUE}, l AS (SELECT Product_ID AS product_id, string_split(coalesce(nullif(Fix_Log, ''), CASE WHEN Status = 'Deferred' THEN 'Deferred' ELSE 'No attempts logged' END), chr(10)) AS lines
    FROM catalogue WHERE Status IN ('Blocked', 'Skipped', 'Deferred')), e AS (SELECT product_id, unnest(range(len(lines))) AS i, lines FROM l)
    SELECT product_id, CAST(i AS INT) AS line_no, trim(lines[i + 1]) AS entry FROM e WHERE NOT {is_blank('lines[i + 1]')}""")
def fix_log_lines(t: Tables):
    return reports.fix_log_lines(inputs.catalogue(t))


@query("presentation_table", f"""{WITH_CATALOGUE} SELECT Product_ID AS product_id, Model_Name AS model_name, coalesce(Display_Name, '') AS display_name, Status AS status,
    coalesce(trim({effective('Spec_Capacity')}), '-') AS capacity, coalesce(trim({effective('Spec_Output')}), '-') AS output,
    coalesce('₹' || coalesce({duck.whole(f'try_cast({MRP} AS DOUBLE)')}, {MRP}), '-') AS mrp, coalesce({sql_filled('Image_Status')}, '-') AS image_status,
    CASE WHEN {is_blank('Flags')} THEN 'Clean' WHEN length(Flags) > 40 THEN Flags[:37] || '...' ELSE Flags END AS flags FROM catalogue""")
def presentation_table(t: Tables):
    return reports.presentation(inputs.catalogue(t))


# --- scalar functions ---------------------------------------------------------------------------------

TITLES = {
    "id": "p_partkey", "brand": "p_brand",
    "title": "CASE p_partkey % 8 WHEN 0 THEN p_brand || ' One ' || p_name || ' 10,000mAh 22.5W Power Bank' WHEN 1 THEN '20000 mAh 15 W ' || p_name || ' MagTag - with stand' "
             "WHEN 2 THEN p_brand || ' ' || p_name || '+ TWS Earbuds, Black' WHEN 3 THEN 'New Launch ' || p_name || ' 10K | fast' WHEN 4 THEN p_name || ' PB-' || CAST(p_size AS STRING) || ' charger white' "
             "WHEN 5 THEN '' WHEN 6 THEN p_brand ELSE p_name || ' Qi2 certified 5V/2.4A' END",
    "price_text": "CASE p_partkey % 6 WHEN 0 THEN 'MRP ₹ 12,' || lpad(CAST(p_size AS STRING), 3, '0') WHEN 1 THEN 'call' WHEN 2 THEN NULL WHEN 3 THEN CAST(p_size AS STRING) || '.75' WHEN 4 THEN ' ' ELSE '₹' || CAST(p_size * 10000 AS STRING) END",
}
WITH_TITLES = f"WITH t AS (SELECT {inputs.select(TITLES)} FROM part)"


def titles(t: Tables):
    return inputs.derive(t.part, TITLES)


@query("price_texts", f"{WITH_TITLES} SELECT id, {duck.price('price_text')} AS parsed, {duck.money('price_text')} AS formatted FROM t")
def price_texts(t: Tables):
    return titles(t).select("id", parse_price(F.col("price_text")).alias("parsed"), format_price(F.col("price_text")).alias("formatted"))


@query("slugs_and_markup", f"""{WITH_TITLES} SELECT id, {duck.slug('title')} AS slug, CASE WHEN len(list_filter(string_split_regex(lower(trim(title)), '\\s+'), lambda w: w <> '')) < 2 THEN lower(trim(title)) ELSE
    array_to_string(string_split_regex(lower(trim(title)), '\\s+')[:-2], ' ') || ' <em>' || string_split_regex(lower(trim(title)), '\\s+')[-1] || '</em>' END AS name_html, {SUBTITLE_MARKUP.format('title')} AS subtitle_html FROM t""")
def slugs_and_markup(t: Tables):
    return titles(t).select("id", slugify(F.col("title")).alias("slug"), name_markup(F.col("title")).alias("name_html"), subtitle_markup(F.col("title")).alias("subtitle_html"))


def clean_display_sql(name: str) -> str:
    x = f"trim(regexp_replace(trim({name}), '(?i)^\\Q' || brand || '\\E\\s*', ''))"
    for pattern in (r"(?i)\b(?:UPR|UPC|POR|PB|SC|PEB)[\w-]*\b", r"(?i)\s+(?:power\s*bank|powerbank|charger)\b",
                    r"(?i)\s*\b(?:\d+(?:,\d+)?\s*mah|\d+k\b|\d+(?:\.\d+)?\s*w\b)\b", r"(?i)\s+(?:black|white|blue|grey|gray|green|pink|mocha|camo|silver)\b"):
        x = f"trim({duck.replace(x, pattern)})"
    return f"CASE WHEN {is_blank(name)} THEN '' WHEN {x} = '' THEN {name} ELSE {x} END"


@query("clean_display_names", f"""{WITH_TITLES} SELECT id, {clean_display_sql('title')} AS short_name,
    CASE WHEN trim(regexp_replace(trim(title), '(?i)^\\Q' || brand || '\\E\\s+', '')) = '' THEN trim(title) ELSE trim(regexp_replace(trim(title), '(?i)^\\Q' || brand || '\\E\\s+', '')) END AS unbranded FROM t""")
def clean_display_names(t: Tables):
    return titles(t).select("id", clean_display_name(F.col("title"), F.col("brand")).alias("short_name"), strip_brand_prefix(F.col("title"), F.col("brand")).alias("unbranded"))


@query("tidied_display_names", f"""{WITH_CATALOGUE}, d AS (SELECT *, {clean_display_sql(f"coalesce({sql_filled('Display_Name')}, Model_Name)").replace("brand ||", "Brand ||")} AS tidy FROM catalogue)
    SELECT Product_ID AS product_id, CASE WHEN tidy <> '' THEN tidy ELSE Display_Name END AS display_name,
    CASE WHEN tidy <> '' AND tidy IS DISTINCT FROM Display_Name THEN trim(coalesce(Fix_Log, '') || chr(10) || 'Cleaned Display_Name to ''' || tidy || '''', ' ' || chr(10)) ELSE Fix_Log END AS fix_log FROM d""")
def tidied_display_names(t: Tables):
    return resolve.tidy_display_names(inputs.catalogue(t)).select(
        F.col("Product_ID").alias("product_id"), F.col("Display_Name").alias("display_name"), F.col("Fix_Log").alias("fix_log"))


MAH_SQL, WATT_SQL = duck.quantities("title")


@query("spec_quantities", f"{WITH_TITLES} SELECT id, array_to_string(list_sort({MAH_SQL}), ',') AS mah, array_to_string(list_sort({WATT_SQL}), ',') AS watts FROM t")
def spec_quantities_query(t: Tables):
    mah, watts = spec_quantities(F.col("title"))
    return titles(t).select("id", F.array_join(F.array_sort(mah).cast("array<string>"), ",").alias("mah"), F.array_join(F.array_sort(watts).cast("array<string>"), ",").alias("watts"))


@query("model_names", f"""{WITH_TITLES} SELECT id, array_to_string({duck.tokens('title')}, ' ') AS tokens, {duck.portion('title', 'brand')} AS portion, array_to_string(list_sort(list_filter(
    list_distinct(regexp_extract_all({duck.replace("lower(CASE WHEN trim(regexp_replace(trim(title), '(?i)^" + chr(92) + "Q' || brand || '" + chr(92) + "E" + chr(92) + "s+', '')) = '' THEN trim(title) ELSE trim(regexp_replace(trim(title), '(?i)^" + chr(92) + "Q' || brand || '" + chr(92) + "E" + chr(92) + "s+', '')) END)", r"\b\d+(?:,\d+)?\s*mah\b|\b\d+k\b|\b\d+(?:\.\d+)?\s*w\b", " ")}, '[a-z0-9]+')),
    lambda x: NOT list_contains({duck.listed(fixed.DISPLAY_DROPPABLE)}, x))), ' ') AS identity FROM t""")
def model_names(t: Tables):
    title, brand = F.col("title"), F.col("brand")
    return titles(t).select("id", F.array_join(F.array_sort(model_tokens(title)), " ").alias("tokens"), model_portion(title, brand).alias("portion"),
                            F.array_join(F.array_sort(identity_tokens(title, brand)), " ").alias("identity"))


def display_candidate_sql() -> str:
    x = "trim(regexp_replace(title, '(?i)^\\Q' || brand || '\\E\\s*', ''))"
    x = f"trim(regexp_replace({x}, '(?i)^(?:new\\s+launch\\s+|all\\s+new\\s+)', ''))"
    x = f"coalesce(trim({duck.search(x, '(?is)^(.*?)' + fixed.DISPLAY_STOP, 1)}), {x})"
    x = f"coalesce(trim({duck.search(x, '(?s)^(.*?)' + chr(92) + 's+[-|–—/]' + chr(92) + 's+', 1)}), {x})"
    x = f"trim({duck.replace(x, '[,' + chr(92) + '.' + chr(92) + '-–—' + chr(92) + 's]+$')})"
    return f"CASE WHEN length({x}) >= 2 THEN {x} ELSE title END"


@query("candidate_names", f"{WITH_TITLES} SELECT id, {display_candidate_sql()} AS name FROM t")
def candidate_names(t: Tables):
    return titles(t).select("id", candidate_display_name(F.col("title"), F.col("brand")).alias("name"))


PREFIX_SQL = "CASE upper(trim(c)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CATEGORY_PREFIXES.items()) + \
    " ELSE coalesce(nullif(upper(regexp_replace(trim(c), '[^A-Za-z0-9]', '', 'g')[:3]), ''), 'PRD') END"
CATEGORY_TEXTS = {"id": "p_partkey", "category": "CASE p_partkey % 9 WHEN 0 THEN 'Powerbank' WHEN 1 THEN 'Neckband earphones' WHEN 2 THEN 'Soundbar' WHEN 3 THEN 'Smart Band' WHEN 4 THEN NULL "
                  "WHEN 5 THEN '' WHEN 6 THEN ' battery pack ' WHEN 7 THEN '--' ELSE p_name END"}


@query("category_keys", f"""WITH t AS (SELECT {inputs.select(CATEGORY_TEXTS)} FROM part), d AS (SELECT *, CASE WHEN category <> '' THEN category ELSE 'Powerbank' END AS c FROM t)
    SELECT id, {duck.category_key('category')} AS key, {PREFIX_SQL} AS prefix FROM d""")
def category_keys(t: Tables):
    df = inputs.derive(t.part, CATEGORY_TEXTS)
    return df.select("id", category_key(F.col("category")).alias("key"), category_prefix(F.col("category")).alias("prefix"))


@query("finite_numbers", """WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 2 THEN CAST('Infinity' AS DOUBLE) WHEN l_linenumber = 3 THEN -CAST('Infinity' AS DOUBLE)
    ELSE l_extendedprice END AS v FROM lineitem) SELECT k, n, CASE WHEN isfinite(v) THEN v END AS value, CASE WHEN isfinite(v) THEN 1 ELSE 0 END AS finite_in_list FROM t""")
def finite_numbers(t: Tables):
    value = F.expr("CASE WHEN l_linenumber = 1 THEN double('NaN') WHEN l_linenumber = 2 THEN double('Infinity') WHEN l_linenumber = 3 THEN -double('Infinity') ELSE l_extendedprice END")
    df = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), value.alias("v"))
    return df.select("k", "n", finite(F.col("v")).alias("value"), F.size(F.array_compact(finite_array(F.array("v")))).alias("finite_in_list"))


@query("finite_records", """WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 2 THEN CAST('Infinity' AS DOUBLE) ELSE l_extendedprice END AS v, l_quantity AS q FROM lineitem)
    SELECT k, n, CASE WHEN isfinite(v) THEN v END AS alone, CASE WHEN isfinite(v) THEN v END AS in_map, CASE WHEN isfinite(v) THEN v END AS deep, CAST(q AS DOUBLE) AS kept, CAST(CASE WHEN isfinite(v) THEN 0 ELSE 1 END AS INT) AS nulls FROM t""")
def finite_records(t: Tables):
    value = F.expr("CASE WHEN l_linenumber = 1 THEN double('NaN') WHEN l_linenumber = 2 THEN double('Infinity') ELSE l_extendedprice END")
    numbers = F.array(value, F.col("l_quantity").cast("double"))
    record = F.struct(F.create_map(F.lit("a"), value).alias("by_name"), F.array(F.struct(numbers.alias("list"), F.lit("x").alias("word"))).alias("rows"))
    df = text.without_nonfinite(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), value.alias("alone"), record.alias("r")))
    deep = F.col("r.rows")[0]["list"]
    return df.select("k", "n", "alone", F.col("r.by_name")["a"].alias("in_map"), deep[0].alias("deep"), deep[1].alias("kept"), F.size(F.filter(deep, lambda x: x.isNull())).alias("nulls"))


@query("blank_values", f"SELECT p_partkey AS id, {sql_filled(CATEGORY_TEXTS['category'])} AS category FROM part")
def blank_values(t: Tables):
    return inputs.derive(t.part, CATEGORY_TEXTS).select("id", filled(F.col("category")).alias("category"))
