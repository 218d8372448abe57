"""Catalogue-shaped inputs derived from the test tables.

Every column is one expression that Spark SQL and DuckDB read alike, so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import schema
from workload.registry import Tables

_ID = "CAST(p_partkey AS STRING)"
_SIZE = "CAST(p_size AS STRING)"
_KILO = "CAST(p_size * 1000 AS STRING)"

CATALOGUE = {
    "row_order": "p_partkey",
    "Product_ID": f"'PB-' || lpad({_ID}, 7, '0')",
    "Category": "CASE p_type WHEN 'ECONOMY' THEN 'Powerbank' WHEN 'SMALL' THEN 'TWS Earbuds' WHEN 'MEDIUM' THEN 'Smartwatch' "
                "WHEN 'LARGE' THEN 'Speaker' WHEN 'PROMO' THEN '' ELSE 'Cable' END",
    "Brand": "p_brand",
    "Model_Name": f"CASE WHEN p_partkey % 5 = 0 THEN p_name || ' ' || {_KILO} || 'mAh' WHEN p_partkey % 5 = 1 THEN p_brand || ' ' || p_name "
                  f"WHEN p_partkey % 5 = 2 THEN p_name || ' Pro ' || {_SIZE} ELSE p_name END",
    "Display_Name": "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '  ' WHEN p_partkey % 4 = 2 THEN p_brand || ' ' || p_name || ' black' ELSE p_name END",
    "Brochure_PDF": "CASE WHEN p_partkey % 17 = 3 THEN 'brochures/' || lower(p_type) || '.pdf' ELSE NULL END",
    "MRP_Input": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END",
    "MRP_Display": f"CASE WHEN p_partkey % 6 = 0 THEN '₹' || {_KILO} WHEN p_partkey % 6 = 1 THEN 'MRP 1,' || lpad({_SIZE}, 3, '0') "
                   "WHEN p_partkey % 6 = 2 THEN 'on request' WHEN p_partkey % 6 = 3 THEN ' ' ELSE NULL END",
    "Source_URL": f"CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN 'brochure: acme.pdf, page 2' "
                  f"ELSE 'https://www.store.example/products/' || replace(p_name, ' ', '-') || '-' || {_SIZE} || '?v=1' END",
    "Raw_Title": "CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN p_name || ' Max' ELSE p_brand || ' ' || p_name || ' Pro' END",
    "Source_Title": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 'https://www.store.example/products/x' END",
    "Tier_Title": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 3 AS STRING) END",
    "Raw_Subtitle": f"CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN 'With 6 Months Guarantee' ELSE {_KILO} || 'mAh and ' || {_SIZE} || 'W for travel' END",
    "Raw_MRP_Scraped": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size * 60 AS DOUBLE) END",
    "Raw_Spec_Capacity": f"CASE WHEN p_partkey % 5 = 3 THEN NULL WHEN p_partkey % 5 = 0 THEN '10,000 mAh' ELSE {_KILO} || 'mAh' END",
    "Raw_Spec_Output": f"CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE {_SIZE} || 'W' END",
    "Raw_Spec_Ports": "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'Type-C, USB-A' END",
    "Raw_Spec_Weight": f"CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size * 7 AS STRING) || 'g' END",
    "Raw_Bullet_1": f"CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE {_KILO} || 'mAh cell for long days away from a socket and a little more.' END",
    "Raw_Bullet_2": "CASE WHEN p_partkey % 9 = 4 THEN NULL WHEN p_partkey % 9 = 5 THEN 'Free Shipping pan India' ELSE p_name || ' in a small case.' END",
    "Raw_Bullet_3": f"CASE WHEN p_partkey % 14 = 6 THEN '1 year warranty.' WHEN p_partkey % 14 = 7 THEN {_SIZE} || 'W output.' ELSE NULL END",
    "Source_Bullet_1": "CASE WHEN p_partkey % 21 = 0 THEN '' ELSE 'https://www.store.example/b' END",
    "Image_Source": "CASE WHEN p_partkey % 5 = 0 THEN 'amazon.in/dp/X' WHEN p_partkey % 5 = 1 THEN 'brand-product-page' ELSE NULL END",
    "Image_Status": "CASE WHEN p_partkey % 5 < 2 THEN 'ok' ELSE NULL END",
    "Image_Tier": "CASE WHEN p_partkey % 5 = 0 THEN '3' WHEN p_partkey % 5 = 1 THEN '1' ELSE NULL END",
    "Override_Title": "CASE WHEN p_partkey % 19 = 0 THEN 'Hand ' || p_name ELSE NULL END",
    "Override_Subtitle": "CASE WHEN p_partkey % 23 = 0 THEN 'Set by hand' WHEN p_partkey % 23 = 1 THEN '   ' ELSE NULL END",
    "Override_DP": "CASE WHEN p_partkey % 29 = 0 THEN CAST(p_size * 20 AS DOUBLE) ELSE NULL END",
    "Override_MRP": "CASE WHEN p_partkey % 31 = 0 THEN CAST(p_size * 90 AS DOUBLE) ELSE NULL END",
    "Override_Spec_Capacity": "CASE WHEN p_partkey % 37 = 0 THEN '5000 mAh' ELSE NULL END",
    "Override_Bullet_2": "CASE WHEN p_partkey % 41 = 0 THEN 'Second line by hand.' ELSE NULL END",
    "Override_Image_Path": "CASE WHEN p_partkey % 43 = 0 THEN ' images/overrides/' || replace(p_name, ' ', '-') || '.png ' ELSE NULL END",
    "Attempts": "CAST(p_partkey % 3 AS INT)",
    "Fix_Log": "CASE WHEN p_partkey % 6 = 0 THEN 'Attempt 1: HTTP 403 page' || chr(10) || ' ' || chr(10) || 'Attempt 2: gave up ' WHEN p_partkey % 6 = 1 THEN 'Collected via tier-1' "
               "WHEN p_partkey % 6 = 2 THEN '[Review Re-run 1]: x' || chr(10) || '[Review Re-run 2]: y' ELSE NULL END",
    "Flags": "CASE WHEN p_partkey % 15 = 0 THEN 'Skipped: Needs your pick — options. Two' WHEN p_partkey % 15 = 1 THEN 'Hard Block: Capacity mismatch: Model_Name specifies 10000mAh but collected spec is 20000mAh. Next' "
             "WHEN p_partkey % 15 = 2 THEN 'Skipped: All spec tiers exhausted' WHEN p_partkey % 15 = 3 THEN 'Deferred: Duplicate image' WHEN p_partkey % 15 = 4 THEN 'Clean' "
             "WHEN p_partkey % 15 = 5 THEN 'Skipped: nothing' ELSE NULL END",
    "LLM_Provider": "CASE WHEN p_partkey % 2 = 0 THEN 'drafted' ELSE NULL END",
    "Status": "CASE WHEN p_partkey % 3 = 0 THEN 'Approved' WHEN p_partkey % 10 < 3 THEN 'Ready_For_Review' WHEN p_partkey % 10 < 5 THEN 'Pending' WHEN p_partkey % 10 = 5 THEN 'Blocked' "
              "WHEN p_partkey % 10 < 8 THEN 'Skipped' ELSE 'Deferred' END",
    "Rejected_URLs": "CASE WHEN p_partkey % 5 = 1 THEN 'https://www.store.example/a | not_match: other' || chr(10) || 'https://www.store.example/b | collision: page taken' ELSE NULL END",
}

# Image files: those of some products at their category path, of others at the older brand path.
ASSET_PATH = ("CASE WHEN p_partkey % 4 = 0 THEN 'images/' || CASE p_type WHEN 'ECONOMY' THEN 'powerbank' WHEN 'SMALL' THEN 'tws-earbuds' WHEN 'MEDIUM' THEN 'smartwatch' "
              "WHEN 'LARGE' THEN 'speaker' WHEN 'PROMO' THEN 'powerbank' ELSE 'cable' END || '/' ELSE 'images/' END || lower(replace(p_brand, '#', '-')) || '/' || replace(p_name, ' ', '-') || '.png'")
ASSETS = {
    "path": "path", "length": "CASE WHEN n % 7 = 0 THEN 0 ELSE n * 100 END",
    "width": "CASE WHEN n % 11 = 0 THEN NULL ELSE CAST(700 + n % 300 AS INT) END",
    "height": "CASE WHEN n % 11 = 0 THEN NULL ELSE CAST(700 + n % 5 * 60 AS INT) END",
    "md5": "md5(CAST(n % 40 AS STRING))",
}


def select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


CATALOGUE_SQL = f"SELECT {select(CATALOGUE)} FROM part"
ASSETS_SQL = (f"SELECT {select(ASSETS)} FROM (SELECT path, min(p_partkey) AS n FROM (SELECT {ASSET_PATH} AS path, p_partkey FROM part "
              "WHERE p_name <> 'cold rod') GROUP BY path)")


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def catalogue(t: Tables) -> DataFrame:
    return schema.catalogue(derive(t.part, CATALOGUE))


def assets(t: Tables) -> DataFrame:
    files = t.part.where("p_name <> 'cold rod'").select(F.expr(ASSET_PATH).alias("path"), "p_partkey").groupBy("path").agg(
        F.min("p_partkey").alias("n"))
    return derive(files, ASSETS)
