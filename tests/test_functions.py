from pyspark.sql import functions as F

from shelfmark.functions import categories, copywriting, html, names, specs, text, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def spec(spark, words, category):
    return one(spark, specs.extract_specs(F.col("t"), F.col("c")), t=words, c=category)


def test_powerbank_text(spark):
    got = spec(spark, "Mega 10000mAh Powerbank with 30W Fast Charging Type C PD Output, 2 Ports, weight 210g", "Powerbank")
    assert got == {"capacity": "10000mAh", "output": "30W Fast Charging", "ports": "Type-C", "weight": "210g"}


def test_earbud_text(spark):
    got = spec(spark, "Buds Truly Wireless Earbuds with 40 Hours Playtime, Quad Mic ENC, 13mm Drivers, Bluetooth v5.3 and Type-C", "TWS")
    assert got == {"playtime": "40 Hours Playtime", "drivers": "13mm Drivers", "noise_cancellation": "Quad Mic ENC",
                   "bluetooth": "Bluetooth v5.3", "ports": "Type-C Charging"}


def test_watch_text(spark):
    got = spec(spark, "Ultra 1.91 Inch HD Display Smartwatch, BT Calling, 7 Days Battery Life, IP68 Water Resistant", "Smartwatch")
    assert got == {"display": '1.91" Display', "calling": "Bluetooth Calling", "battery": "7 Days Battery", "water_resistance": "IP68"}


def test_watts_from_volts_round_half_to_even(spark):
    assert spec(spark, "5V/2.5A", "Powerbank")["output"] == "12W Output"
    assert spec(spark, "5V/3.5A", None)["output"] == "18W Output"


def test_first_figure_wins_and_nothing_is_invented(spark):
    assert spec(spark, "12 months manufacturer warranty then 2 year warranty", "Cable")["warranty"] == "12 Months Manufacturer Warranty"
    assert spec(spark, "", "Cable") == {} and spec(spark, "plain words", "Powerbank") == {}
    assert spec(spark, "7500mAh", "Powerbank") == {}


def test_category_ladder(spark):
    want = {"Neckband": "smartwatch", "Headphones": "tws", "Soundbar": "audio", "": "powerbank", None: "powerbank", "Cable": "generic"}
    for category, key in want.items():
        assert one(spark, categories.category_key(F.col("c")), c=category) == key


def test_name_markup(spark):
    want = {"AURA": "aura", "Click 10": "click <em>10</em>", "Striker Buds Pro": "striker buds <em>pro</em>"}
    for name, html_name in want.items():
        assert one(spark, text.name_markup(F.col("n")), n=name) == html_name
    assert one(spark, text.subtitle_markup(F.col("n")), n="A 10,000mAh and 20W") == 'A <b class="spec">10,000mAh</b> and 20W'


def test_prices(spark):
    assert one(spark, text.parse_price(F.col("p")), p="MRP ₹ 1,299.50") == 1299.5
    assert one(spark, text.format_price(F.col("p")), p="₹12999.9") == "12,999"
    assert one(spark, text.format_price(F.col("p")), p=" on request ") == "on request"


def test_model_portion(spark):
    cases = {"Roam+ 20000mAh Mini wired Powerbank": "Roam+", "10000 mAh Nano Power Bank": "Nano",
             "10000 mAh 15 W Arc MagTag Power Bank with stand": "Arc MagTag", "Acme One Giga Max 65W": "Giga Max"}
    for title, portion in cases.items():
        assert one(spark, names.model_portion(F.col("t"), F.col("b")), t=title, b="Acme") == portion


def test_brand_with_pattern_characters(spark):
    assert one(spark, text.strip_brand_prefix(F.col("n"), F.col("b")), n="A+B (x) Volt", b="a+b (x)") == "Volt"
    assert one(spark, text.strip_brand_prefix(F.col("n"), F.col("b")), n="Acme", b="Acme") == "Acme"


def test_copy(spark):
    got = one(spark, copywriting.normalise_copy(F.col("t"), F.col("b")), t="The best Acme premium charger, made for people who travel far and wide with", b="Acme")
    assert got.text == "The charger, made for people who travel far and wide." and got.ok
    assert one(spark, copywriting.normalise_copy(F.col("t"), F.col("b")), t="up to the", b="") == ("", False)
    assert one(spark, copywriting.claims_warranty(F.col("t")), t="1 year warranty")
    assert not one(spark, copywriting.claims_warranty(F.col("t"), strict_reference=True), t="1 year warranty")


def test_urls(spark):
    base = "https://a.com/x/y?q#f"
    for href, want in {"z": "https://a.com/x/z", "/z": "https://a.com/z", "//c.d/e": "https://c.d/e", "http://q/": "http://q/"}.items():
        assert one(spark, urls.absolute(F.col("b"), F.col("h")), b=base, h=href) == want
    assert one(spark, F.array_join(urls.ranked_images(F.split("u", " ")), " "), u="a.png banner.png b-01.png hero.png c.png") == \
        "hero.png b-01.png a.png c.png banner.png"


PAGE = """<html><head><script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":"Product","name":"Air 2","description":"d",
"image":{"url":"https://x/1.png"},"offers":[{"price":"2,999"}],"additionalProperty":[{"name":"Net Weight","value":"40 g"},{"name":"weight","value":"9"}]}]}</script>
<script type="application/ld+json">not json</script></head></html>"""


def test_jsonld(spark):
    facts = one(spark, html.jsonld_facts(html.jsonld_products(F.col("h"))), h=PAGE)
    assert (facts.name, facts.price, facts.images, facts.specs) == ("Air 2", 2999.0, ["https://x/1.png"], {"weight": "40 g"})


def test_sanitised_specs(spark):
    given = F.create_map(*[F.lit(x) for x in ("capacity", "10,000 mAh", "output", "fast", "weight", "380 g", "ports", "two USB-C", "warranty", "2 yrs")])
    assert one(spark, specs.sanitise_specs(given), t="") == {"capacity": "10000 mAh", "weight": "380g", "ports": "two USB-C", "warranty": "2 yrs"}


def test_entities_are_decoded_once(spark):
    given = ["Ray&#8217;s &#x27;20K&#x27; &#8377;999 &eacute;&nbsp;x", "&amp;lt; &unknown; & &#0;", "plain", None, "&#128077;&quot;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", html.unescape(F.col("t")).alias("u")).collect()}
    assert got == {0: "Ray\u2019s '20K' \u20b9999 \u00e9 x", 1: "&lt; &unknown; & \ufffd", 2: "plain", 3: None, 4: "\U0001f44d\""}
