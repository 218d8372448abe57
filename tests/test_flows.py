import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark import schema
from shelfmark.functions import dom
from shelfmark.operators import brands, pages, validation
from shelfmark.plans import collect, onboard, publish
from shelfmark.sources import readers, writers
from shelfmark.streaming.arrivals import stream_price_sheets

PAGE_ROW = "url string, status int, headers map<string,string>, html string, platform string, category string"
MODERN = ('<html><head><title>Air 2</title></head><body><header class="h"><nav>Shop All</nav></header><h1 class="tw-bold">Air 2</h1>'
          '<div class="tw-grid"><span>11 mm PMI driver</span><span>Up to 40 hours total playtime</span><span>Bluetooth 5.3</span></div>'
          '<footer class="f">Copyright Acme</footer></body></html>')
SHOP = ('<html><head><title>X</title></head><body><h1 class="product__title">Big Speaker</h1><div class="product__description rte">40W output speaker</div>'
        '<span class="price-item--regular">MRP: ₹12,999</span><div class="related-products"><h2>Other</h2>20000 mAh</div></body></html>')


def test_page_without_telling_classes(spark):
    df = spark.createDataFrame([("https://n/products/air-2", 200, None, MODERN, "custom", "TWS"), ("https://n/products/a", 200, None, SHOP, "shopify", "Speaker"),
                                ("https://www.amazon.in/dp/1", 200, None, '<img id="landingImage" data-old-hires="https://m/i/1._AC_SX30_.jpg"> 10000mAh', None, "Powerbank"),
                                ("https://n/x", 404, None, "", "custom", "TWS")], PAGE_ROW)
    got = {r.url: r for r in pages.observe_pages(df).collect()}
    air = got["https://n/products/air-2"]
    assert air.specs["playtime"] == "40 Hours Playtime" and air.specs["bluetooth"] == "Bluetooth v5.3" and air.title == "Air 2"
    assert "Copyright" not in str(air.specs)
    assert got["https://n/products/a"].price == 12999.0
    market = got["https://www.amazon.in/dp/1"]
    assert market.specs == {} and market.images == ["https://m/i/1._SL1500_.jpg"] and market.success
    assert got["https://n/x"].page_state == "delisted" and not got["https://n/x"].success


def test_noise_is_cut_out_and_climbing_stops_at_other_products():
    read = dom.read_page(SHOP, "shopify")
    assert "20000" not in read["clean_html"] and read["description"] == "40W output speaker"
    page = "<body><div><h1>A</h1><p>x</p></div><div><h2>B</h2><p>" + "other " * 60 + "</p></div></body>"
    assert dom.read_page(page, "generic")["surroundings"] == "A x"


def test_blocks(spark):
    df = spark.createDataFrame([(403, {"CF-Ray": "1"}, ""), (403, {"Set-Cookie": "_abck=1"}, "x"), (200, {}, "DataDome"), (429, {}, ""), (403, {}, "x" * 200), (200, {}, "ok")],
                               "status int, headers map<string,string>, body string")
    got = [r.v for r in df.select(pages.classify_block(F.col("status"), F.col("headers"), F.col("body"))["vendor"].alias("v")).collect()]
    assert got == ["cloudflare", "akamai", "datadome", "kasada", "generic_waf", None]


def png(width, height, colour):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    row = b"\0" + bytes(colour) * width
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(row * height)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    folder = tmp_path / "images" / "powerbank" / "acme"
    folder.mkdir(parents=True)
    (folder / "volt.png").write_bytes(png(30, 20, (250, 10, 20)))
    (folder / "ray.png").write_bytes(b"not an image")
    got = {r.path: r for r in readers.read_image_assets(spark, str(tmp_path)).collect()}
    volt = got["images/powerbank/acme/volt.png"]
    assert (volt.width, volt.height, volt.r, volt.g, volt.b) == (30, 20, 250.0, 10.0, 20.0)
    assert got["images/powerbank/acme/ray.png"].width is None
    assert readers.list_files(spark, str(tmp_path), "*.png").count() == 2


def test_feed_sitemap_sheet_and_baseline_files(spark, tmp_path):
    (tmp_path / "volto.in.json").write_text(json.dumps({"products": [{"title": "Volto Max", "handle": "volto-max", "variants": [{"price": "1999.00", "compare_at_price": "3499.00"}], "images": [{"src": "i"}], "body_html": "<p>20000 mAh</p>"}]}))
    row = pages.feed_listings(readers.read_listing_feed(spark, str(tmp_path / "volto.in.json"))).first()
    assert (row.url, row.list_price, row.description) == ("https://volto.in/products/volto-max", 3499.0, "20000 mAh")
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><urlset><url><loc>https://z/product/air-2</loc></url><url><loc>https://z/about</loc></url></urlset>')
    assert [r.title for r in pages.sitemap_products(readers.read_sitemap(spark, str(tmp_path / "s.xml"))).collect()] == ["air 2"]
    (tmp_path / "p.csv").write_text("Item,Rate,List\nVolt,1200,2500\nRay,900,\n")
    sheet = onboard.ingest(readers.read_price_sheets(spark, str(tmp_path / "p.csv")), {"Item": "Model_Name", "Rate": "DP", "List": "MRP"}, "Acme", "AC", "Powerbank")
    assert {(r.model_name, r.dp, r.mrp) for r in sheet.rows.collect()} == {("Volt", 1200.0, 2500.0), ("Ray", 900.0, None)}
    assert [r.missing for r in sheet.incomplete.collect()] == [["MRP"]] and sheet.usable.first().usable
    (tmp_path / "g.json").write_text(json.dumps({"P1": {"product_id": "P1", "display_name": "nan", "spec_count": 0}}))
    assert readers.read_golden(spark, str(tmp_path / "g.json")).first().display_name is None
    again = spark.createDataFrame([("P1", "nan"), ("P2", "Air 2")], "Product_ID string, Display_Name string")
    writers.write_golden(schema.catalogue(again), str(tmp_path / "golden"), confirmed=True)
    assert {(r.product_id, r.display_name) for r in readers.read_golden(spark, str(tmp_path / "golden")).collect()} == {("P1", None), ("P2", "Air 2")}
    with pytest.raises(readers.MissingTable):
        readers.require_table(spark, "no_such_table")


def test_versions_are_written_once_and_guarded(spark, rows, tmp_path):
    good = rows(dict(Product_ID="1", Brand="Acme", Category="Powerbank", Model_Name="Volt"))
    path = writers.write_catalogue(good, str(tmp_path / "c"), "1")
    assert readers.read_catalogue(spark, path).where("Product_ID = '1'").count() == 1
    with pytest.raises(Exception):
        writers.write_catalogue(good, str(tmp_path / "c"), "1")
    with pytest.raises(validation.UnsourcedValue):
        writers.write_catalogue(rows(dict(Product_ID="1", Raw_Title="x")), str(tmp_path / "c"), "2")
    with pytest.raises(ValueError):
        writers.write_golden(good, str(tmp_path / "g"))


def test_sheets_that_keep_arriving(spark, rows, tmp_path):
    rows(dict(Product_ID="PB-A-001", Brand="Acme", Category="Powerbank", Model_Name="Volt", Status="Pending")).write.parquet(str(tmp_path / "c/version=0"))
    spark.createDataFrame([("Acme", "A", "Powerbank", 1, "", "Ray", "Ray", 9.0, None, None)], schema.PRICE_SHEET).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema.PRICE_SHEET).parquet(str(tmp_path / "in"))
    stream_price_sheets(spark, arriving, str(tmp_path / "c"), str(tmp_path / "ck")).awaitTermination(120)
    after = readers.read_catalogue(spark, str(tmp_path / "c/version=1"))
    assert {r.Product_ID for r in after.collect()} == {"PB-A-001", "PB-A-002"}


def test_from_sheet_row_to_publication(spark, rows):
    catalogue = rows(
        dict(Product_ID="PB-V-001", Brand="Volto", Category="Powerbank", Model_Name="Max 20K", Display_Name="Max", MRP_Input=1800.0, MRP_Display="3499", Status="Pending"),
        dict(Product_ID="PB-V-002", Brand="Volto", Category="Powerbank", Model_Name="Ghost", Status="Pending"))
    config = schema.conform(spark.createDataFrame([("Volto", None, "volto.in", "shopify")], "brand string, category string, domain string, platform string"), brands.CONFIG)
    url = "https://volto.in/products/volto-max-20k"
    listings = spark.createDataFrame([("Volto", url, "Volto Max 20K 22.5W Power Bank", "brand-store", 1)], schema.LISTING)
    html = ('<html><head><title>Volto Max 20K</title></head><body><h1 class="product__title">Volto Max 20K</h1><div class="product__description rte">20000 mAh capacity, 22.5W '
            'fast charging, 2 USB-A + 1 Type-C ports, weighs 380g.</div></body></html>')
    read = pages.observe_pages(spark.createDataFrame([(url, 200, None, html, "shopify", "Powerbank")], PAGE_ROW))
    tiers = collect.tiers_of([("brand-store", "1", 1)], spark)
    copy = spark.createDataFrame([("PB-V-001", "Max", "20000mAh for two days.", "22.5W fast charging output.", "Charges three devices at once.", None, None)],
                                 "product_id string, title string, subtitle string, bullet_1 string, bullet_2 string, bullet_3 string, bullet_4 string")
    done = collect.collect(catalogue, config, listings, read, tiers, copy)
    got = {r.Product_ID: r for r in done.collect()}
    found = got["PB-V-001"]
    assert (found.Source_URL, found.Raw_Spec_Capacity, found.Source_Spec_Capacity, found.Tier_Spec_Capacity, found.Raw_Title) == (url, "20000mAh", url, "1", "Max")
    assert found.Raw_Spec_Warranty is None and found.Raw_MRP_Scraped is None and found.Source_Audit == f"tier-1: brand-store ({url})"
    assert got["PB-V-002"].Status == "Skipped" and got["PB-V-002"].Flags.startswith("Skipped: All spec tiers exhausted")
    validation.assert_sourced(done)
    reviewed = collect.review(done, config).select(*schema.CATALOGUE.names)
    ready = reviewed.where("Product_ID = 'PB-V-001'").first()
    assert ready.Status == "Ready_For_Review", ready.Flags
    approved = reviewed.withColumn("Status", F.when(F.col("Status") == "Ready_For_Review", "Approved").otherwise(F.col("Status")))
    files = spark.createDataFrame([("images/powerbank/volto/max-20k.png", 10, 900, 900, "m")], "path string, length bigint, width int, height int, md5 string")
    with pytest.raises(publish.NotPublishable):
        publish.publish(approved, files.limit(0))
    table, plan = publish.publish(approved, files)
    assert [(r.name, r.price, r.mrp_display, r.layout) for r in table.collect()] == [("Max", "1,800", "3,499", "1-up")]
    assert plan.first().pages == 3


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_learned_settings_are_not_mixed(spark):
    learned = spark.createDataFrame([("Acme", "Cat", "z.example", "alpha", ["Neo", "Air"], 1), ("acme", "cat", "a.example", "zeta", ["Pro", "Neo"], 2), ("Acme", None, None, None, None, 3)],
                                    "brand string, category string, domain string, platform string, qualifier_tokens array<string>, seq bigint")
    rows = {r.category: r for r in brands.upsert_brand_config(spark.createDataFrame([], brands.CONFIG), learned).collect()}
    assert (rows[None].domain, rows[None].platform) == ("a.example", "zeta")
    assert rows["Cat"].qualifier_tokens == ["Neo", "Air", "Pro"]


def test_text_around_a_heading():
    page = "<body><main><div><h1>Volt</h1><p>{}</p></div><section><h2>Other</h2>{}</section></main></body>"
    assert dom.read_page(page.format("short", "y" * 300), "generic")["surroundings"] == "Volt short"
    assert dom.read_page(page.format("x" * 250, "y"), "generic")["surroundings"] == "Volt " + "x" * 250
    assert dom.read_page("<body><p>a</p><p>b</p></body>", "generic")["surroundings"] == "a b"
    deep = "<div>" * 15 + "<h1>V</h1>" + "</div>" * 15 + "far"
    assert dom.read_page(f"<body>{deep}</body>", "generic")["surroundings"] == "V"


def test_a_search_remembers_pages_that_are_gone_and_notes_its_verdicts(spark, rows):
    catalogue = rows(
        dict(Product_ID="PB-V-001", Brand="Volto", Category="Powerbank", Model_Name="Max 20K", Status="Pending", Rejected_URLs="https://volto.in/products/old | not_match: other", Fix_Log="earlier"),
        dict(Product_ID="PB-V-002", Brand="Volto", Category="Powerbank", Model_Name="Ghost", Status="Pending", Rejected_URLs="https://volto.in/products/x | y"))
    config = schema.conform(spark.createDataFrame([("Volto", None, "volto.in", "shopify")], "brand string, category string, domain string, platform string"), brands.CONFIG)
    gone, there = "https://volto.in/products/volto-max-20k-old", "https://volto.in/products/volto-max-20k"
    listings = spark.createDataFrame([("Volto", gone, "Max 20K", "brand-store", 1), ("Volto", there, "Volto Max 20K 22.5W Power Bank", "brand-store", 2)], schema.LISTING)
    html = '<html><head><title>Volto Max 20K</title></head><body><h1 class="product__title">Volto Max 20K</h1><div class="product__description rte">20000 mAh capacity.</div></body></html>'
    read = pages.observe_pages(spark.createDataFrame([(gone, 404, None, "", "shopify", "Powerbank"), (there, 200, None, html, "shopify", "Powerbank")], PAGE_ROW))
    tiers = collect.tiers_of([("brand-store", "1", 1)], spark)
    copy = spark.createDataFrame([], "product_id string, title string, subtitle string, bullet_1 string, bullet_2 string, bullet_3 string, bullet_4 string")
    got = {r.Product_ID: r for r in collect.collect(catalogue, config, listings, read, tiers, copy).collect()}
    one = got["PB-V-001"]
    assert one.Rejected_URLs.split("\n")[0] == "https://volto.in/products/old | not_match: other" and f"{gone} | delisted: " in one.Rejected_URLs and there not in one.Rejected_URLs.split()
    assert one.Fix_Log.startswith("earlier\nVerifier: ") and "match Volto Max 20K 22.5W Power Bank" in one.Fix_Log and "delisted Max 20K" in one.Fix_Log
    assert got["PB-V-002"].Rejected_URLs == "https://volto.in/products/x | y" and got["PB-V-002"].Fix_Log is None
