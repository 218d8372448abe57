"""Sources and sinks: the given tables written in each format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.operators import onboarding
from shelfmark.operators.pages import sitemap_products
from shelfmark.operators.resolve import in_scope
from shelfmark.session import shared_folder
from shelfmark.sources import readers, writers
from workload import duck, inputs
from workload.duck import WITH_CATALOGUE, any_of
from workload.page_queries import BROCHURE_PAGES
from workload.registry import Tables, query

KNOWN = "https://www.store.example/s"


def fresh(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


def sourced(t: Tables):
    """The catalogue, each row with the page that it came from."""
    return inputs.catalogue(t).withColumn("Source_URL", F.coalesce("Source_URL", F.lit(KNOWN)))


@query("written_catalogue", f"""{WITH_CATALOGUE} SELECT Product_ID, Brand, Category, Model_Name, coalesce(Source_URL, '{KNOWN}') AS Source_URL, Raw_MRP_Scraped, Attempts,
    nullif({duck.slug('Category')}, '') AS category_slug, {duck.slug('Brand')} AS brand_slug FROM catalogue""")
def written_catalogue(t: Tables):
    path = writers.write_catalogue(sourced(t), fresh(t), "1")
    return readers.read_catalogue(t.spark, path).select(
        "Product_ID", "Brand", "Category", "Model_Name", "Source_URL", "Raw_MRP_Scraped", "Attempts", "category_slug", "brand_slug")


_SPECS = " + ".join(f"CASE WHEN {duck.effective(f'Spec_{s}')} IS NULL THEN 0 ELSE 1 END" for s in ("Capacity", "Output", "Ports", "Weight", "Warranty"))


@query("baseline_files", f"""{WITH_CATALOGUE} SELECT Product_ID AS product_id, Brand AS brand, Category AS category, Model_Name AS model_name, Display_Name AS display_name, Source_URL AS source_url,
    Tier_Title AS tier, CAST({_SPECS} AS INT) AS spec_count, Status AS status, Image_Status AS image_status, Override_Image_Path AS image_path FROM catalogue""")
def baseline_files(t: Tables):
    path = fresh(t)
    writers.write_golden(inputs.catalogue(t), path, confirmed=True)
    return readers.read_golden(t.spark, path)


SHEET = {"Id": "p_partkey", "Item": "p_name", "Rate": "CAST(p_retailprice AS STRING)", "List": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_retailprice * 2 AS STRING) END"}


@query("price_sheet_files", """SELECT p_partkey AS id, p_name AS model_name, p_retailprice AS dp, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice * 2 END AS mrp FROM part""")
def price_sheet_files(t: Tables):
    path = fresh(t)
    inputs.derive(t.part, SHEET).write.option("header", True).csv(path)
    sheet = readers.read_price_sheets(t.spark, path)
    mapped = onboarding.map_price_columns(sheet, {"Item": "Model_Name", "Rate": "DP", "List": "MRP"})
    return mapped.select(F.col("Id").cast("bigint").alias("id"), "model_name", "dp", "mrp")


@query("price_text_files", """SELECT p_name || ' at ' || p_size || '/-' AS raw_text FROM part""")
def price_text_files(t: Tables):
    path = fresh(t)
    lines = t.part.select(F.explode(F.array(F.concat(F.lit("  "), "p_name", F.lit(" at "), F.col("p_size").cast("string"), F.lit("/- ")), F.lit(" "))))
    lines.write.text(path)
    return readers.read_price_text(t.spark, path).select("raw_text")


@query("sitemap_files", f"""WITH l AS (SELECT 'https://s.example/' || CASE WHEN page_id % 3 = 0 THEN 'product/' ELSE 'about/' END || page_id || '-a-b.html?x=1&y=2' AS loc FROM pages)
    SELECT loc AS url, replace(replace(split_part(split_part(loc, '/', -1), '?', 1), '-', ' '), '.html', '') AS title FROM l WHERE {any_of('lower(loc)', fixed.SITEMAP_MARKS)}""")
def sitemap_files(t: Tables):
    path = fresh(t)
    kind = F.when(F.col("page_id") % 3 == 0, F.lit("product/")).otherwise(F.lit("about/"))
    t.pages.select(F.concat(F.lit("https://s.example/"), kind, F.col("page_id").cast("string"), F.lit("-a-b.html?x=1&y=2")).alias("loc")).write.format("xml").option(
        "rootTag", "urlset").option("rowTag", "url").save(path)
    return sitemap_products(readers.read_sitemap(t.spark, path))


@query("page_files", "SELECT url, html FROM pages")
def page_files(t: Tables):
    path = fresh(t)
    t.pages.write.parquet(path)
    return readers.read_pages(t.spark, path).select("url", "html")


PAGES = {"brochure": BROCHURE_PAGES["brochure"], "brand": "p_brand", "page_no": BROCHURE_PAGES["page_no"], "text": BROCHURE_PAGES["text"]}


@query("brochure_page_files", f"SELECT {inputs.select({k: v.replace('STRING', 'VARCHAR') for k, v in PAGES.items()})} FROM part WHERE p_partkey % 7 <> 0")
def brochure_page_files(t: Tables):
    path = fresh(t)
    inputs.derive(t.part, PAGES).write.parquet(path)
    return readers.read_brochure_pages(t.spark, path).select(*PAGES)


@query("written_scope", f"""{WITH_CATALOGUE} SELECT Product_ID FROM catalogue WHERE lower(Brand) = (SELECT lower(min(p_brand)) FROM part) AND lower(Category) = 'tws earbuds'""")
def written_scope(t: Tables):
    """One brand and category of a written catalogue: its partition alone is read."""
    path = writers.write_catalogue(sourced(t), fresh(t), "1")
    brand = t.part.agg(F.min("p_brand")).first()[0]
    return in_scope(readers.read_catalogue(t.spark, path), brand.upper(), " TWS Earbuds ").select("Product_ID")
