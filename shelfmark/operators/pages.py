"""Recorded store pages into observations: one job over the page table, site rules as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import dom, fixed, html
from shelfmark.functions.categories import category_key
from shelfmark.functions.names import is_subset, model_portion, model_tokens
from shelfmark.functions.specs import extract_brochure_specs, extract_specs, first_filled, markdown_images, markdown_price, markdown_specs, markdown_title
from shelfmark.functions.text import contains_any, filled, is_blank, replace_all, search, string_array, strip
from shelfmark.functions.urls import absolute, last_segment, site_of, slug_title, slug_words
from shelfmark.operators.matching import model_mentions, score_pairs, with_listing_features, with_target_features
from shelfmark.session import checkpointed


def page_status(status: Column, body: Column) -> Column:
    """blocked, delisted, failed, soft_404 or ok."""
    title = F.lower(html.document_title(body))
    return (
        F.when(status.isin(401, 403, 429), F.lit("blocked"))
        .when(status.isin(404, 410), F.lit("delisted"))
        .when(status != 200, F.lit("failed"))
        .when(contains_any(title, ["404", "not found"]), F.lit("soft_404"))
        .otherwise(F.lit("ok"))
    )


def classify_block(status: Column, headers: Column, body: Column) -> Column:
    """struct(vendor, reason) of a recorded response that was blocked; null when it was not."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.lower(e["value"]).alias("value")))
    pairs = F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>"))
    low = F.lower(F.coalesce(body, F.lit("")))

    def header(name: str) -> Column:
        return F.get(F.filter(pairs, lambda p: p["key"] == name), F.lit(0))["value"]

    def named(prefix: str) -> Column:
        return F.exists(pairs, lambda p: p["key"].startswith(prefix))

    cookies = F.coalesce(header("set-cookie"), F.lit(""))
    cloud_header = header("cf-ray").isNotNull() | F.coalesce(header("server") == "cloudflare", F.lit(False))
    cloud_body = contains_any(low, [
        'id="cmsg"', "please enable js and disable any ad blocker", "challenge-platform", "cf-browser-verification",
        "cloudflare ray id", "attention required! | cloudflare", "just a moment..."])
    akamai_header = header("x-akamai-transformed").isNotNull() | header("akamai-grn").isNotNull() | F.contains(cookies, F.lit("_abck"))
    akamai_body = (F.contains(low, F.lit("<title>access denied</title>")) & F.contains(
        low, F.lit("you don't have permission to access"))) | F.contains(low, F.lit("akamai-grn"))
    datadome = named("x-datadome") | F.contains(cookies, F.lit("datadome")) | F.contains(low, F.lit("datadome"))
    aws = header("x-amzn-waf-action").isNotNull() | (header("x-amz-cf-id").isNotNull() & status.isin(403, 429))
    kasada = named("x-kpsdk") | ((status == 429) & (F.length(F.coalesce(body, F.lit(""))) < 100))
    code = F.concat(F.lit("HTTP "), status.cast("string"))

    def found(vendor: str, text: str) -> Column:
        return F.struct(F.lit(vendor).alias("vendor"), F.concat(code, F.lit(" " + text)).alias("reason"))

    return (
        F.when((cloud_header & status.isin(403, 429, 503)) | cloud_body, found("cloudflare", "Cloudflare Bot Challenge"))
        .when((status.isin(403, 429) & akamai_header) | akamai_body, found("akamai", "Akamai Bot Protection / Access Denied"))
        .when(datadome & status.isin(403, 429, 200), found("datadome", "DataDome Anti-Bot Challenge"))
        .when(aws, found("aws_waf", "AWS WAF Block"))
        .when(kasada, found("kasada", "Kasada Bot Mitigation"))
        .when(status.isin(403, 429), found("generic_waf", "Forbidden / Rate Limit"))
        .when((status == 503) & contains_any(low, ["captcha", "bot challenge", "security check", "ddos protection"]),
              found("generic_waf", "Bot Protection Challenge"))
    )


def read_dom(pages: DataFrame) -> DataFrame:
    """Strip noise elements and read the text blocks. pages needs html and site; html becomes clean_html."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html"]
    return pages.mapInPandas(dom.read_batches, ", ".join(kept) + ", " + dom.COLUMNS)


def _amount(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _over_100(value: Column) -> Column:
    return F.when(value > 100, value)


def page_price(site: Column, jsonld_price: Column, price_texts: Column, body: Column) -> Column:
    """Price of a page: structured data, then price elements, then a labelled figure, then the script's list price."""
    first_text = F.get(price_texts, F.lit(0))
    # structured data of zero counts as none
    generic = F.coalesce(F.nullif(jsonld_price, F.lit(0.0)), _amount(search(first_text, r"[\d,]+(?:\.\d{2})?", 0)))
    labelled = r"(?i)MRP[:\s]+(?:Rs\.?|₹)?\s*([0-9,]+(?:\.\d+)?)"
    regular = r"(?i)Regular price\s+(?:MRP[:\s]+)?(?:Rs\.?|₹)?\s*([0-9,]+(?:\.\d+)?)"
    in_elements = F.transform(price_texts, lambda t: _over_100(_amount(F.coalesce(search(t, labelled, 1), search(t, regular, 1)))))
    scripted = _amount(search(body, r"(?i)compare[_\s-]?at[_\s-]?price[\"':\s]+([0-9,]+(?:\.\d+)?)", 1))
    # script amounts above 10000 are in hundredths
    scripted = _over_100(F.when(scripted > 10000, scripted / 100.0).otherwise(scripted))
    in_body = _over_100(_amount(search(body, labelled, 1)))
    shop = F.coalesce(F.get(F.filter(in_elements, lambda p: p.isNotNull()), F.lit(0)), in_body, scripted)
    retail = F.coalesce(_over_100(_amount(search(first_text, r"[0-9,]+(?:\.\d+)?", 0))), in_body)
    return F.when(site == "shopify", shop).when(site.isin("croma", "reliance"), retail).when(site == "generic", generic)


def observation_success(site: Column, specs: Column, description: Column, images: Column) -> Column:
    """Does the page yield enough to count as an observation?"""
    has_power = ~is_blank(specs["capacity"]) | ~is_blank(specs["output"])
    return (
        F.when(site == "amazon", F.size(images) > 0)
        .when(site.isin("reliance", "croma", "tatacliq"), has_power)
        .when(site == "shopify", (F.size(F.map_keys(specs)) > 0) | ~is_blank(description))
        .otherwise((F.size(F.map_keys(specs)) >= 2) | (F.size(images) > 0))
    )


def observe_pages(pages: DataFrame) -> DataFrame:
    """The observation of each recorded page.

    pages: url, status, headers, html, platform, category. The result has success, page_state, title, description, specs,
    price, images and site. Marketplace pages only ever give images.
    """
    blocked = classify_block(F.col("status"), F.col("headers"), F.col("html"))
    df = pages.withColumns({
        "site": site_of(F.col("url"), F.col("platform")), "page_state": page_status(F.col("status"), F.col("html")),
        "_block": blocked, "_ld": html.jsonld_facts(html.jsonld_products(F.col("html"))), "_body": F.col("html"),
    })
    df = read_dom(df)
    site, url = F.col("site"), F.col("url")
    retail = site.isin("croma", "reliance")
    from_slug = F.when(site == "croma", slug_title(url, "croma")).when(site == "reliance", slug_title(url, "reliance")).otherwise(F.lit(""))
    slug_text = (
        F.when((site == "croma") & F.contains(url, F.lit("/p/")),
               F.replace(F.substring_index(F.substring_index(url, "/p/", 1), "/", -1), F.lit("-"), F.lit(" ")))
        .when((site == "reliance") & F.contains(url, F.lit("/product/")),
              F.replace(F.substring_index(F.substring_index(url, "/product/", -1), "?", 1), F.lit("-"), F.lit(" ")))
        .otherwise(F.lit("")))
    heading = F.nullif(F.col("heading"), F.lit(""))
    og = strip(html.meta_content(F.col("_body"), "og:title"))
    title = (
        F.when(site == "generic", F.coalesce(heading, og, F.col("_ld.name")))
        .when(site == "reliance", F.coalesce(F.nullif(F.col("_ld.name"), F.lit("")), heading, from_slug))
        .when(site == "croma", F.coalesce(heading, from_slug)).otherwise(F.coalesce(heading, F.lit(""))))
    df = df.withColumns({"title": title, "_slug_text": slug_text})
    blocks = F.array_join(F.concat("blocks", F.array_compact(F.array(F.nullif("surroundings", F.lit(""))))), "\n")
    text = F.concat_ws(
        "\n", F.coalesce("title", F.lit("")), F.when(retail, F.col("_slug_text")),
        F.when(~retail & (site != "tatacliq"), F.col("description")),
        F.when(site.isin("generic", "reliance"), F.col("_ld.description")), blocks)
    df = df.withColumn("_text", text)
    found = F.when((site == "generic") & (category_key(F.col("category")) == "powerbank"), extract_brochure_specs(F.col("_text"))).otherwise(
        extract_specs(F.col("_text"), F.col("category")))
    specs = (F.when(site == "amazon", F.create_map().cast("map<string,string>"))
             .when(site == "generic", first_filled(F.col("_ld.specs"), found)).otherwise(found))
    images = (
        F.when(site == "amazon", html.marketplace_images(F.col("_body")))
        .when(site == "shopify", html.shop_images(F.col("clean_html")))
        .when(site == "croma", html.retail_images(F.col("_body"), F.lit("croma"), F.lit(None)))
        .when(site == "reliance", html.retail_images(F.col("_body"), F.lit("reliancedigital"), F.col("_ld.images")))
        .when(site == "tatacliq", html.retail_images(F.col("_body"), F.lit("tatacliq"), F.lit(None)))
        .otherwise(html.generic_images(F.col("clean_html"), url, F.col("_ld.images"))))
    all_blocks = F.coalesce(F.nullif(F.array_join("blocks", "\n"), F.lit("")), F.col("_slug_text"))
    df = df.withColumns({
        "specs": specs, "images": images,
        "price": page_price(site, F.col("_ld.price"), F.col("price_texts"), F.col("_body")),
        "page_text": F.when(site.isin("croma", "reliance", "tatacliq"), all_blocks).otherwise(F.col("description")),
    })
    captcha = (site == "amazon") & contains_any(F.lower("_body"), ["captcha", "api-services-support@amazon.com"])
    state = F.when(captcha, F.lit("blocked")).otherwise(F.col("page_state"))
    return df.select(
        "url", "status", "site", "category", state.alias("page_state"), F.col("_block.vendor").alias("blocked_by"),
        F.when((state == "ok"), observation_success(site, F.col("specs"), F.col("page_text"), F.col("images"))).otherwise(
            F.lit(False)).alias("success"),
        "title", F.col("page_text").alias("description"), "specs", "price", "images")


def observe_markdown(pages: DataFrame) -> DataFrame:
    """Observation of pages recorded as markdown: url, title (may be null), text, category."""
    text = F.col("text")
    df = pages.withColumns({
        "title": F.coalesce(F.nullif("title", F.lit("")), markdown_title(text)),
        "specs": markdown_specs(text, F.col("category")), "price": markdown_price(text), "images": markdown_images(text)})
    return df.withColumn("success", (F.size(F.map_keys("specs")) >= 1) | (F.size("images") > 0))


# --- links --------------------------------------------------------------------------------------------

PRODUCT_PATH = r"(?i)/(?:products?|item|p|pd)/[^/?#]+"


def page_links(pages: DataFrame) -> DataFrame:
    """All links of each page with absolute address, text and whether they look like a product. pages: page_id, url, html."""
    found = pages.select("page_id", "url", F.posexplode(html.links(F.col("html"))).alias("pos", "_l")).select(
        "page_id", "url", "pos", "_l.*")
    return found.select(
        "page_id", "pos", "href", absolute(F.col("url"), F.col("href")).alias("link"), "text", "image_alt",
        F.col("href").rlike(PRODUCT_PATH).alias("is_product"))


def collection_listings(pages: DataFrame) -> DataFrame:
    """Product links of collection pages, with everything said about each target joined into one title.

    pages: page_id, url, html. Markdown links count only on pages without product anchors.
    """
    anchors = html.links(F.col("html"))
    products = F.filter(anchors, lambda l: contains_any(F.substring_index(l["href"], "?", 1), ["/products/", "/product/"]))
    chosen = F.when(F.size(products) > 0, products).otherwise(html.markdown_links(F.col("html")))
    rows = pages.select("page_id", "url", F.posexplode(chosen).alias("pos", "_l"))
    href = F.substring_index(F.substring_index("_l.href", "?", 1), "#", 1)
    text = F.col("_l.text")
    said = F.array_compact(F.array(
        F.when((F.length(text) > 3) & ~text.rlike(r"^\d+(\.\d+)?$"), text),
        F.nullif("_l.image_alt", F.lit("")), F.replace(F.substring_index(href, "/", -1), F.lit("-"), F.lit(" "))))
    # bounded by the links of one page
    grouped = rows.select("page_id", "url", href.alias("href"), "pos", said.alias("said")).groupBy("page_id", "url", "href").agg(
        F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("_s"), F.min("pos").alias("pos"))
    title = F.array_join(F.flatten(F.transform("_s", lambda s: s["said"])), " ")
    return grouped.select("page_id", absolute(F.col("url"), F.col("href")).alias("url"), title.alias("title"), "pos")


def page_type(url: Column, body: Column, n_product_links: Column) -> Column:
    """single_product, listing or generic_page; root, search and collection pages are never single products."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    query = F.lower(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")))
    broad = (
        path.isin("", "/", "/index.html", "/home") | F.contains(path, F.lit("search")) | F.contains(query, F.lit("q="))
        | contains_any(path, ["/collections/", "/category/", "/shop/", "/c/", "/catalog/"]))
    og = F.contains(F.lower(F.coalesce(html.meta_content(body, "og:type"), F.lit(""))), F.lit("product"))
    controls = F.concat(*[html.tags(body, t) for t in ("button", "input", "form")])
    buy = F.exists(controls, lambda t: F.coalesce(
        html.attribute(t, "id").rlike(r"(?i)add[-_]?to[-_]?cart|product_addtocart_form"), F.lit(False)) | F.coalesce(
        html.attribute(t, "class").rlike(r"(?i)add[-_]to[-_]cart|buy[-_]now"), F.lit(False)))
    single = ~broad & (og | path.rlike(PRODUCT_PATH) | buy)
    return F.when(single, F.lit("single_product")).when(n_product_links > 0, F.lit("listing")).otherwise(F.lit("generic_page"))


def manual_outcomes(requests: DataFrame, pages: DataFrame, least: float = 100.0, named: int = 5) -> DataFrame:
    """What an address given by hand leads to, for status.apply_manual_source.

    requests: product_id, url, brand, model_name, qualifiers. pages: url, html. A product page is taken as it is; on a
    page that lists products the best valid one with at least `least` points is taken, the first of equal ones; else the
    message tells how many products the page lists and names the first few. Returns product_id, url, success, page_type,
    direct_url, n_listed and message.
    """
    asked = pages.join(requests.select("url").distinct(), "url", "left_semi").withColumn("page_id", F.col("url"))
    links = checkpointed(collection_listings(asked.select("page_id", "url", "html")))
    # facts of a page are told once, whatever the number of products that ask for it
    name = F.when(F.length("title") > 2, F.struct("pos", "title"))
    listed = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_listed"), F.array_sort(F.collect_list(name)).alias("_names")).select(
        "page_id", "n_listed", F.transform(F.slice("_names", 1, named), lambda n: n["title"]).alias("_names"))
    n = F.coalesce(F.col("n_listed"), F.lit(0))
    kinds = asked.join(listed, "page_id", "left").select(
        "url", "_names", n.alias("n_listed"), page_type(F.col("url"), F.col("html"), n).alias("_kind"))
    targets = with_target_features(requests.withColumns(
        {"category": F.lit(None).cast("string"), "target_capacity": F.lit(None).cast("string"), "page_id": F.col("url")}).drop("url"))
    slug = slug_words(F.col("url"))
    offers = with_listing_features(links.withColumns({"url_slug": slug, "near_slug": slug}), F.lit(""))
    scored = score_pairs(targets.join(offers, "page_id").withColumn("brand_site", F.lit(False)))
    best = scored.where(F.col("valid") & (F.col("score") >= least)).groupBy("product_id", "page_id").agg(
        F.min_by(F.struct("url", "title"), F.struct((-F.col("score")).alias("s"), "pos")).alias("_best")).withColumnRenamed("page_id", "url")
    single = F.col("_kind") == "single_product"
    matched = ~single & F.col("_best").isNotNull()
    told = F.array_join(F.transform("_names", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    names = F.when(F.size("_names") > 0, told).otherwise(F.lit("none named"))
    message = (
        F.when(single, F.concat(F.lit("Direct product page resolved: "), F.col("url")))
        .when(matched, F.concat(F.lit("Matched model '"), F.col("model_name"), F.lit("' to listing item '"), F.col("_best.title"), F.lit("': "), F.col("_best.url")))
        .when(F.col("n_listed") > 0, F.concat(
            F.lit("That page lists "), F.col("n_listed"), F.lit(" products ("), names, F.lit("), but none matched model '"), F.col("model_name"), F.lit("'.")))
        .otherwise(F.concat(F.lit("No product listings or specifications found on page: "), F.col("url"))))
    kind = F.when(single, F.lit("single_product")).when(matched, F.lit("listing_match")).when(F.col("n_listed") > 0, F.lit("listing")).otherwise(F.lit("generic_page"))
    return requests.join(kinds, "url").join(best, ["product_id", "url"], "left").select(
        "product_id", "url", (single | matched).alias("success"), kind.alias("page_type"),
        F.when(single, F.col("url")).when(matched, F.col("_best.url")).alias("direct_url"), "n_listed", message.alias("message"))


def image_belongs_to_model(image_text: Column, model: Column, brand: Column) -> Column:
    """Do the words around an image (alt, title, nearest heading, address) cover the model's words?"""
    generic = F.concat(string_array(fixed.NEAR_MISS_GENERIC), F.array(F.lower(F.coalesce(brand, F.lit("")))))
    wanted = F.array_except(model_tokens(model_portion(model, brand)), generic)
    return (F.size(wanted) == 0) | is_subset(wanted, model_tokens(image_text))


def image_context(pages: DataFrame) -> DataFrame:
    """Every image of each page with the words around it. pages: page_id, html.

    A page is cut before its headings; an image belongs to the heading at the start of its piece, the nearest one before it,
    so a page is read once whatever the number of its images. Returns page_id, pos, src and image_text: alt, title, heading
    and address.
    """
    cut = F.split("html", r"(?i)(?=<h[1-6]\b)")

    def of_piece(piece: Column) -> Column:
        heading = strip(html.text_of(F.coalesce(search(piece, r"(?is)^<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", 1), F.lit(""))))
        return F.transform(html.tags(piece, "img"), lambda tag: F.struct(tag.alias("tag"), heading.alias("heading")))

    rows = pages.select("page_id", F.posexplode(F.flatten(F.transform(cut, of_piece))).alias("pos", "_i"))
    tag = F.col("_i.tag")
    rows = rows.select("page_id", "pos", F.coalesce(html.attribute(tag, "src"), html.attribute(tag, "data-src")).alias("src"),
                       html.attribute(tag, "alt").alias("_alt"), html.attribute(tag, "title").alias("_title"), F.col("_i.heading").alias("_heading"))
    return rows.where("src IS NOT NULL").select("page_id", "pos", "src", F.concat_ws(" ", "_alt", "_title", F.nullif("_heading", F.lit("")), "src").alias("image_text"))


def gallery_candidates(products: DataFrame, pages: DataFrame) -> DataFrame:
    """Brand images for merge.pick_images, without those of other products on the page.

    products: product_id, brand, model_name, url. pages: url, html. Only product pictures whose surroundings cover the
    model's words are taken, each once, in the order of the page: product_id, tier (1), pos, url, source.
    """
    asked = pages.join(products.select("url").distinct(), "url", "left_semi").withColumn("page_id", F.col("url"))
    found = checkpointed(image_context(asked))
    low = F.lower("src")
    pictures = found.where(contains_any(F.col("src"), fixed.PRODUCT_IMAGE_MARKS) & ~contains_any(low, fixed.FURNITURE_IMAGE_MARKS))
    pairs = products.join(pictures, products["url"] == pictures["page_id"]).where(image_belongs_to_model(F.col("image_text"), F.col("model_name"), F.col("brand")))
    master = replace_all(F.col("src"), r"/cache/[a-f0-9]+/", "/")
    master = F.when(master.startswith("//"), F.concat(F.lit("https:"), master)).otherwise(master)
    once = pairs.groupBy("product_id", "page_id", master.alias("image")).agg(F.min("pos").alias("_first"))
    # bounded by the images of one page
    order = Window.partitionBy("product_id", "page_id").orderBy("_first")
    return once.select("product_id", F.lit(1).alias("tier"), (F.row_number().over(order) - 1).alias("pos"), F.col("image").alias("url"), F.col("page_id").alias("source"))


# --- feeds and storefronts ----------------------------------------------------------------------------

FEED = ("products array<struct<title:string,handle:string,vendor:string,body_html:string,"
        "images:array<struct<src:string>>,variants:array<struct<price:string,compare_at_price:string>>>>")


def feed_listings(feeds: DataFrame) -> DataFrame:
    """Store product feeds (domain, products) as listings with address, list price and images."""
    rows = feeds.select("domain", F.posexplode("products").alias("arrival", "_p")).select("domain", "arrival", "_p.*")
    variant = F.get("variants", F.lit(0))
    return rows.where(F.coalesce("handle", F.lit("")) != "").select(
        "domain", F.concat(F.lit("https://"), "domain", F.lit("/products/"), "handle").alias("url"), "title", "vendor",
        html.text_of(F.col("body_html")).alias("description"), variant["price"].try_cast("double").alias("price"),
        variant["compare_at_price"].try_cast("double").alias("list_price"),
        F.transform("images", lambda i: i["src"]).alias("images"), F.col("arrival").cast("bigint").alias("arrival"))


def sitemap_products(locations: DataFrame) -> DataFrame:
    """Product addresses of sitemaps. locations: loc, child (true for entries of a nested product sitemap, kept as they are)."""
    loc = strip(F.col("loc"))
    wanted = F.coalesce(F.col("child"), F.lit(False)) | contains_any(F.lower(loc), fixed.SITEMAP_MARKS)
    return locations.where(filled(F.col("loc")).isNotNull() & wanted).select(
        loc.alias("url"), F.replace(F.replace(last_segment(loc), F.lit("-"), F.lit(" ")), F.lit(".html"), F.lit("")).alias("title"))


def without_aggregators(results: DataFrame) -> DataFrame:
    """Distinct hosts of search results that are not marketplaces, directories or media."""
    from shelfmark.functions.urls import host

    hosts = results.select(strip(host(F.col("url"))).alias("host")).where("host is not null and host != ''").distinct()
    known = results.sparkSession.createDataFrame([(d,) for d in fixed.AGGREGATOR_DOMAINS], "host string")
    return hosts.join(F.broadcast(known), "host", "left_anti")


def verify_storefronts(stores: DataFrame, models: DataFrame) -> DataFrame:
    """Is a recorded home page really the brand's shop?

    stores: domain, brand, text. models: brand, model_name. Verified when it is not parked and either names a telling
    model (or two of any kind), or carries the brand in domain and text with a commerce word.
    """
    texts = stores.select(F.lower("brand").alias("scope"), F.col("domain").alias("text_id"), F.lower("text").alias("text"))
    hits = model_mentions(models.select(F.lower("brand").alias("scope"), "model_name"), texts)
    telling = ~F.lower(strip("model_name")).isin(fixed.GENERIC_MODEL_WORDS)
    found = hits.groupBy(F.col("text_id").alias("domain"), F.col("scope").alias("_b")).agg(
        F.count(F.lit(1)).alias("n_matched"), F.count_if(telling).alias("n_telling"))
    df = stores.withColumn("_b", F.lower("brand")).join(found, ["domain", "_b"], "left")
    low = F.lower("text")
    slug = F.regexp_replace(F.lower("brand"), "[^a-z0-9]", "")
    parked = contains_any(low, fixed.PARKED_SIGNATURES)
    matched, told = F.coalesce("n_matched", F.lit(0)), F.coalesce("n_telling", F.lit(0))
    by_models = (matched > 0) & ((told > 0) | (matched >= 2))
    official = F.contains(F.col("domain"), slug) & F.contains(low, F.lower("brand")) & contains_any(low, fixed.STOREFRONT_WORDS)
    return df.select("domain", "brand", parked.alias("parked"), matched.cast("bigint").alias("n_matched"),
                     (~parked & (by_models | official)).alias("verified"))


def plausible_sheet_domain(body: Column) -> Column:
    """The lighter test for an address printed on a price sheet: not parked, two signs of commerce."""
    low = F.lower(body)
    signs = sum(F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in fixed.COMMERCE_INDICATORS)
    return ~contains_any(low, fixed.SHEET_DOMAIN_PARKED) & (signs >= 2)


def plain_text(body: Column) -> Column:
    """Page text without scripts, styles and page furniture, where nesting does not matter."""
    bare = body
    for tag in fixed.NOISE_TAGS:
        bare = replace_all(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return strip(replace_all(html.unescape(replace_all(bare, r"(?s)<!--.*?-->|<[^>]*>", " ")), r"\s+", " "))
