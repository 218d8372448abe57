"""Corner cases of page outcomes, image surroundings, notes and nested numbers."""

import math

from pyspark.sql import functions as F

from shelfmark.functions.text import without_nonfinite
from shelfmark.operators import matching, pages


def test_numbers_are_finite_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    schema = "id int, f float, m map<string,array<double>>, s struct<a:double,b:struct<c:array<map<double,float>>,d:string>>, `odd.name` double"
    rows = [(1, inf, {"x": [nan, 1.0, None]}, (nan, ([{2.0: -inf}], "t")), -inf), (2, None, None, None, None), (3, 1.5, {}, (2.0, (None, None)), 3.0)]
    df = spark.createDataFrame(rows, schema)
    out = without_nonfinite(df)
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in df.schema.fields]
    one, two, three = sorted(out.collect())
    assert one.f is None and one.m == {"x": [None, 1.0, None]} and one.s.a is None and one.s.b.c == [{2.0: None}] and one["odd.name"] is None
    assert two[1:] == (None, None, None, None) and three.f == 1.5 and three.s.b.c is None and math.isfinite(three["odd.name"])
    assert without_nonfinite(df.limit(0)).count() == 0


def test_images_take_the_heading_before_them(spark):
    html = '<img src="a.png" alt="A"><h1>One <b>&amp;</b> two</h1><p><IMG data-src=b.png title="B"></p><h2></h2><img alt="no address"><img src=\'c.png\'><h3>open<img src="d.png">'
    got = {r.src: (r.pos, r.image_text) for r in pages.image_context(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).collect()}
    assert got == {"a.png": (0, "A a.png"), "b.png": (1, "B One & two b.png"), "c.png": (3, "c.png"), "d.png": (4, "d.png")}


def test_addresses_by_hand(spark):
    shop = '<a href="/products/volt-max">Acme Volt Max</a><a href="/products/volt-mini">Volt Mini</a><a href="/products/ray">Ray</a>'
    known = spark.createDataFrame([("https://s/collections/all", shop), ("https://s/products/ray", "<html></html>"), ("https://s/blog", None)], "url string, html string")
    asked = [("1", "https://s/collections/all", "Volt Max"), ("2", "https://s/collections/all", "Zed"), ("3", "https://s/products/ray", "Ray"), ("4", "https://s/blog", "Ray"), ("5", "https://elsewhere/x", "Ray")]
    requests = spark.createDataFrame([(*a, "Acme", None) for a in asked], "product_id string, url string, model_name string, brand string, qualifiers array<string>")
    got = {r.product_id: r for r in pages.manual_outcomes(requests, known).collect()}
    assert got["1"].success and got["1"].page_type == "listing_match" and got["1"].direct_url == "https://s/products/volt-max"
    assert not got["2"].success and got["2"].message.startswith("That page lists 3 products ('") and got["2"].message.endswith("none matched model 'Zed'.")
    assert got["3"].success and got["3"].page_type == "single_product"
    assert got["4"].page_type == "generic_page" and "5" not in got  # a page that was not recorded has no outcome


def test_notes_keep_the_last_verdicts(spark):
    rows = [("p", i, "not_match", "" if i % 2 else f"T{i}", f"https://x/{i}", "m" if i == 9 else None) for i in range(10)]
    notes = matching.verifier_notes(spark.createDataFrame(rows, "product_id string, seq bigint, decision string, title string, url string, provider string")).collect()
    assert [r.note for r in notes] == ["Verifier: not_match T4; not_match https://x/5; not_match T6; not_match https://x/7; not_match T8; not_match https://x/9 (m)"]


def test_later_sources_are_asked_only_where_the_first_found_nothing(spark):
    products = spark.createDataFrame([("1", "Acme", "Volt Max", "Powerbank", None), ("2", "Acme", "Ray Neo", "Powerbank", None)], "product_id string, brand string, model_name string, category string, qualifiers array<string>")
    offer = "store_brand string, url string, title string, source string, arrival bigint"
    store = spark.createDataFrame([("Acme", "https://a/products/volt-max", "Volt Max", "store", 1)], offer)
    sitemap = spark.createDataFrame([("Acme", "https://a/products/volt-max-b", "Volt Max", "sitemap", 1), ("Acme", "https://a/products/ray-neo", "ray neo", "sitemap", 2)], offer)
    got = sorted((r.product_id, r.source, r["rank"], r.valid) for r in matching.tier_shortlist(products, [store, sitemap]).collect())
    assert got == [("1", "store", 1, True), ("2", "sitemap", 1, True)]


def test_rematch_uses_up_its_rounds(spark):
    page = lambda i: f"https://a/{i}"
    cands = [("1", page(i), f"t{i}", 100.0 - i, True, i, page(i)) for i in range(4)] + [("2", page(i), f"t{i}", 100.0 - i, True, i, page(i)) for i in range(2)] + [("3", page(0), "t0", 9.0, True, 0, page(0))]
    candidates = spark.createDataFrame(cands, "product_id string, url string, title string, score double, valid boolean, arrival bigint, url_key string")
    flagged = spark.createDataFrame([("1", page(0), "wrong", None), ("2", page(0), "wrong", "[Review Re-run 1]: x"), ("3", page(0), "wrong", "[Review Re-run 1]\n[Review Re-run 2]")], "product_id string, url string, reason string, log string")
    memory = spark.createDataFrame([("1", page(1), "old", 7)], "product_id string, url string, reason string, seq bigint")

    def judge(df):
        return df.withColumn("mismatch", F.when(F.col("title") == "t2", F.lit("again")))

    ended, grown = matching.rematch(flagged, candidates, memory, judge)
    assert sorted(map(tuple, ended.collect())) == [("1", page(3), "rematched", 2), ("2", page(1), "rematched", 2), ("3", page(0), "blocked", 2)]
    assert sorted((r.product_id, r.url, r.reason, r.seq) for r in grown.collect()) == [
        ("1", page(0), "review: wrong", 8), ("1", page(1), "old", 7), ("1", page(2), "review: again", 9), ("2", page(0), "review: wrong", 0)]
