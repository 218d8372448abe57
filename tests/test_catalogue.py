import pytest
from pyspark.sql import functions as F

from shelfmark import schema
from shelfmark.operators import brands, counts, merge, onboarding, publishing, resolve, status, validation
from shelfmark.operators.ranking import ranked



def flags(df, **kw):
    out = validation.validate(validation.with_duplicate_images(validation.with_image_facts(df, None)), **kw).first()
    return out.hard_flags, out.warnings


def test_schema_has_all_columns():
    assert len(schema.CATALOGUE) == 72


def test_override_chains(rows):
    def resolved(**values):
        return resolve.resolve_products(rows(dict(Product_ID="1", Brand="B", Model_Name="M", **values))).first()

    full = dict(MRP_Input=1999.0, Raw_MRP_Scraped=3999.0, MRP_Display="3499")
    assert resolved(Override_DP=1799.0, Override_MRP=2999.0, **full).dp == 1799.0
    assert resolved(Override_MRP=2999.0, **full).mrp == "2999.0"
    assert (resolved(**full).dp, resolved(**full).mrp) == (1999.0, "3499")
    assert resolved(Raw_MRP_Scraped=3999.0).mrp == "3999.0"
    assert resolved(Override_Title="O", Display_Name="D").display_name == "O"
    assert resolved(Override_Title="  ", Display_Name="D").display_name == "D"
    assert resolved().display_name == "M" and resolved().title == "B M"


def test_write_guard(rows):
    bad = rows(dict(Product_ID="1", Raw_Spec_Output="22.5W"))
    with pytest.raises(validation.UnsourcedValue):
        validation.assert_sourced(bad)
    with pytest.raises(Exception, match="no verified source"):
        validation.sourced_or_fail(bad).collect()
    validation.assert_sourced(rows(dict(Product_ID="1", Raw_Spec_Output="22.5W", Source_URL="https://x"), dict(Override_Title="free")))


GOOD = dict(Product_ID="1", Brand="Pebble", Category="Powerbank", Model_Name="TestModel", Raw_Title="TestModel 10000mAh",
            Source_URL="https://brand.com/prod", Source_Title="https://brand.com/prod", Raw_Spec_Capacity="10000mAh", Raw_Spec_Output="20W")


def test_bullets(rows):
    one_bullet = dict(GOOD, Raw_Bullet_1="Fast 22.5W charging output")
    assert "Thin copy: Product has fewer than 2 bullets (1 present)" in flags(rows(one_bullet))[0]
    three = dict(one_bullet, Raw_Bullet_2="Dual USB output ports", Raw_Bullet_3="LED battery indicator")
    assert flags(rows(three))[0] == []
    claim = dict(three, Raw_Bullet_1="1 Year Manufacturer Guarantee Included")
    assert flags(rows(claim))[0] == ["Disallowed warranty claim in Bullet_1: '1 Year Manufacturer Guarantee Included'"]


def test_capacity_and_qualifier_mismatch(rows):
    hard, _ = flags(rows(dict(GOOD, Raw_Spec_Capacity="10,000 mAh", Model_Name="Volt 20000", Raw_Title="Volt Max", Raw_Bullet_1="a", Raw_Bullet_2="b")))
    assert hard[0].startswith("Qualifier token mismatch: Qualifier token mismatch in model segment 'Volt Max': candidate contains 'Max'")
    assert hard[1] == "Capacity mismatch: Model_Name specifies 20000mAh but collected spec is 10000mAh"


def test_id_after_a_gap_and_over_taken_ids(spark, rows):
    have = rows(*[dict(Product_ID=f"PB-PEB-00{n}", Brand="Pebble", Category="Powerbank", Model_Name=f"M{n}") for n in (1, 2, 5)],
                dict(Product_ID="pb-peb-007", Brand="Other", Category="Powerbank", Model_Name="x"))
    sheet = spark.createDataFrame([("pebble", "PEB", "Powerbank", i, "", f"New {i}", f"New {i}", 9.0, 19.0, None) for i in range(3)], schema.PRICE_SHEET)
    got = onboarding.assign_product_ids(sheet, have).orderBy("row_idx").collect()
    assert [r.product_id for r in got] == ["PB-PEB-006", "PB-PEB-008", "PB-PEB-009"]


def test_upsert_twice_is_once(spark, rows):
    have = rows(dict(Product_ID="PB-A-001", Brand="Acme", Category="Powerbank", Model_Name="Volt", Status="Skipped", Attempts=3, Flags="x", Override_Title="kept"))
    sheet = spark.createDataFrame([("ACME", "A", "powerbank", 1, "", " volt ", "Volt!", 10.0, 20.0, None), ("ACME", "A", "powerbank", 2, "", "Ray", "Ray", 11.0, None, None)], schema.PRICE_SHEET)
    once = onboarding.upsert_price_sheet(have, sheet).drop("upsert")
    twice = onboarding.upsert_price_sheet(once, sheet).drop("upsert")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    volt = once.where("Product_ID = 'PB-A-001'").first()
    assert (volt.Status, volt.Attempts, volt.Flags, volt.MRP_Input, volt.Override_Title) == ("Pending", 0, None, 10.0, "kept")
    assert once.where("Model_Name = 'Ray'").first().Product_ID == "PB-A-002"


def test_sort_by_price_missing_last(rows):
    data = [("PB-003", None), ("PB-001", 999.0), ("PB-002", 499.0), ("PB-000", 499.0)]
    df = rows(*[dict(Product_ID=p, Brand="B", Category="Powerbank", Model_Name=p, MRP_Input=v, Status="Approved") for p, v in data],
              dict(Product_ID="PB-009", Brand="B", Status="Ready_For_Review"))
    table = publishing.in_print_order(publishing.publication(df)).collect()
    assert [r.product_id for r in table] == ["PB-000", "PB-002", "PB-001", "PB-003"]
    assert [(r.page, r.slot, r.layout) for r in table] == [(1, 1, "2-up"), (1, 2, "2-up"), (2, 1, "2-up"), (2, 2, "2-up")]


def test_ranked_matches_a_window(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 5003).alias("v"))
    got = ranked(df, ["g"], [F.col("v")], "n")
    want = df.selectExpr("g", "v", "cast(row_number() over (partition by g order by v) as bigint) as n")
    assert got.select("g", "v", "n").exceptAll(want).count() == 0 and got.count() == 5000


def test_tier_merge_stops_when_sufficient(spark):
    data = [("p", "capacity", "10000mAh", "u0", 0, "0", 1), ("p", "output", None, "u0", 0, "0", 1), ("p", "output", "20W", "u1", 2, "1", 1),
            ("p", "capacity", "x", "u1", 2, "1", 1), ("p", "weight", "200g", "u3", 6, "3", 1), ("q", "capacity", "1", "u3", 6, "3", 1)]
    obs = spark.createDataFrame(data, schema.OBSERVATION)
    products = spark.createDataFrame([("p", "Powerbank"), ("q", "Powerbank")], "product_id string, category string")
    got = {(r.product_id, r.field): (r.value, r.source_url) for r in merge.merge_by_tier(obs, products).collect()}
    assert got == {("p", "capacity"): ("10000mAh", "u0"), ("p", "output"): ("20W", "u1"), ("q", "capacity"): ("1", "u3")}


def test_fix_order_and_final_status(rows):
    long = "ten words that go on and on beyond the sixty characters we allow"
    df = rows(dict(GOOD, Raw_Bullet_1=long, Raw_Bullet_2="Free shipping across the land", Raw_Bullet_3="fine line", Raw_Bullet_4="second line"))
    ready = validation.with_duplicate_images(validation.with_image_facts(df, None))
    out = status.review(ready, validation.validate).first()
    assert out.Status == "Ready_For_Review" and out.Attempts == 3
    assert out.Raw_Bullet_1 == "ten words that go on and on beyond the sixty characters we" and out.Raw_Bullet_2 is None
    assert out.Fix_Log.splitlines() == ["Attempt 1: Truncated bullets to satisfy <=60 char limit", "Attempt 2: Dropped invalid/warranty bullets (retaining verified bullets)"]
    wrong = rows(dict(GOOD, Raw_Spec_Capacity="10,000 mAh", Model_Name="Volt 20000", Raw_Bullet_1="a", Raw_Bullet_2="b", Override_Title="kept"))
    out = status.review(validation.with_duplicate_images(validation.with_image_facts(wrong, None)), validation.validate).first()
    assert (out.Status, out.needs_rematch, out.Raw_Title, out.Override_Title) == ("Blocked", True, None, "kept")


def test_display_names(spark):
    def run(brand, pairs):
        df = spark.createDataFrame([(brand, m, d, i) for i, (m, d) in enumerate(pairs)], "brand_name string, model_name string, display_name string, i int")
        return [r.display_name for r in status.enforce_display_names(df).orderBy("i").collect()]

    assert run("Nothing", [("CMF Buds 2", "CMF Buds 2"), ("CMF Buds Neo", "CMF Buds"), ("CMF Buds Pro 2", "CMF Buds"), ("Ear (A)", "Ear")]) == [
        "CMF Buds 2", "CMF Buds Neo", "CMF Buds Pro 2", "Ear (A)"]
    assert run("Pebble", [("STRIKER Buds", "STRIKER"), ("Roam 20000mAh", "Roam"), ("Pebble Open Loop", "Open Loop")]) == ["STRIKER", "Roam", "Open Loop"]


def test_category_settings_need_a_category(spark):
    config = spark.createDataFrame([], brands.CONFIG)
    learned = spark.createDataFrame([("B", "https://b/collections/all")], "brand string, collection_url string")
    with pytest.raises(brands.CategoryRequired):
        brands.upsert_brand_config(config, learned)


def test_manual_source_and_reset(spark, rows):
    df = rows(dict(Product_ID="A", Status="Skipped", Raw_Title="t", Override_Title="o", Rejected_URLs="https://x/1 | not_match: a\nhttps://x/2 | collision: b"),
              dict(Product_ID="B", Status="Skipped"), dict(Product_ID="C", Status="Approved"))
    given = spark.createDataFrame([("a", "https://s/x", True, "https://s/p", "ok"), ("b", "https://s/y", False, None, "lists 3"), ("c", "ftp://s", True, None, "")],
                                  "product_id string, url string, success boolean, direct_url string, message string")
    out, rejected = status.apply_manual_source(df, given)
    got = {r.Product_ID: r for r in out.collect()}
    assert (got["A"].Product_URL, got["A"].Status, got["A"].Raw_Title, got["A"].Override_Title) == ("https://s/p", "Pending", None, "o")
    assert got["A"].Rejected_URLs == "https://x/1 | not_match: a"
    assert got["B"].Flags == "Manual URL Resolution: lists 3" and got["C"].Status == "Approved"
    assert rejected.count() == 1


def test_categories_fall_back(rows):
    assert [r.category for r in counts.categories(rows(dict(Category=" ")) ).collect()] == ["Powerbank"]


def test_brochures_are_searched_once_for_equal_products_and_texts(spark, monkeypatch):
    from shelfmark.operators import brochures

    seen, pairs = {}, brochures.rarest_key_pairs

    def counted(left, right):
        seen.update(left=left.count(), right=right.count())
        return pairs(left, right)

    monkeypatch.setattr(brochures, "rarest_key_pairs", counted)
    text = "Welcome to the catalogue\nblue ring power bank\n10000mAh and 20W"
    products = spark.createDataFrame([(i, "A", "blue ring", None) for i in range(4)], "product_id int, scope string, model_name string, qualifiers array<string>")
    pages = spark.createDataFrame([("A", f"b{r}.pdf", r, n, text) for r in (2, 1) for n in (7, 5)], "scope string, brochure string, brochure_rank int, page_no int, text string")
    got = brochures.match_brochures(products, pages).orderBy("product_id").collect()
    assert [(r.product_id, r.brochure, r.page_no) for r in got] == [(i, "b1.pdf", 5) for i in range(4)]
    assert seen == {"left": 1, "right": 1}


def test_entries_with_one_place_do_not_depend_on_their_order(spark, rows):
    from shelfmark.operators import merge, onboarding

    edits = [("P", 1, {"title": "a"}), ("P", 1, {"title": "b"})]
    seen = [("p", 0, "0", 1, u, "n", "d", None) for u in ("https://b", "https://a")]
    for order in (1, -1):
        given = spark.createDataFrame(edits[::order], "product_id string, seq int, changes map<string,string>").coalesce(1)
        assert onboarding.apply_edits(rows({"Product_ID": "P"}), given)[0].first().Override_Title == "b"
        pages = spark.createDataFrame(seen[::order], "product_id string, tier_rank int, tier_label string, seq int, source_url string, tier_name string, description string, images array<string>").coalesce(1)
        assert merge.one_page_per_tier(pages).first().source_url == "https://a"
        values = pages.withColumns({"field": F.lit("f"), "value": F.lit("v")})
        assert merge.first_values(values).first().source_url == "https://a"
