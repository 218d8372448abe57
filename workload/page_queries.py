"""Recorded pages, feeds, storefronts and brochures."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import fixed, html, urls
from shelfmark.operators import brands, brochures, pages
from workload import duck, inputs
from workload.duck import any_of, listed, search
from workload.matching_queries import benchmark_words, pairs_sql
from workload.registry import Tables, query

# --- the pages table ----------------------------------------------------------------------------------


def unescape(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def text_of(x: str) -> str:
    return unescape(f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')")


@query("page_titles", rf"""SELECT page_id, trim({unescape(search('html', r'(?is)<title\b[^>]*>(.*?)</title>', 1))}) AS document_title, nullif(trim({text_of(search('html', r'(?is)<h1\b[^>]*>(.*?)</h1>', 1))}), '') AS title FROM pages""")
def page_titles(t: Tables):
    return t.pages.select("page_id", html.document_title(F.col("html")).alias("document_title"), html.page_title(F.col("html")).alias("title"))


ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)"


@query("page_links", rf"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=.*?</a>') AS l FROM pages), e AS (SELECT page_id, url, unnest(range(len(l))) AS pos, unnest(l) AS a FROM a),
    h AS (SELECT page_id, url, CAST(pos AS INT) AS pos, trim({unescape(search('a', r'(?is)^<a\b[^>]*href\s*=\s*"([^"]*)"', 1))}) AS href, trim({text_of(search('a', r'(?is)^<a\b[^>]*>(.*)</a>$', 1))}) AS text FROM e)
    SELECT page_id, pos, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([a-z]+:)', 1) || href WHEN href LIKE '/%' THEN {ORIGIN} || href END AS link, text, regexp_matches(href, '(?i)/(?:products?|item|p|pd)/[^/?#]+') AS is_product FROM h""")
def page_links(t: Tables):
    return pages.page_links(t.pages).drop("image_alt")


PATH = r"lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1))"


@query("page_types", rf"""WITH p AS (SELECT page_id, html, {PATH} AS path, lower(regexp_extract(url, '\?([^#]*)', 1)) AS query FROM pages), c AS (SELECT *, path IN ('', '/', '/index.html', '/home') OR contains(path, 'search') OR contains(query, 'q=') OR {any_of('path', ['/collections/', '/category/', '/shop/', '/c/', '/catalog/'])} AS broad,
    len(list_filter(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"', 1), lambda h: regexp_matches(h, '(?i)/(?:products?|item|p|pd)/[^/?#]+'))) AS n FROM p)
    SELECT page_id, CASE WHEN NOT broad AND regexp_matches(path, '(?i)/(?:products?|item|p|pd)/[^/?#]+') THEN 'single_product' WHEN n > 0 THEN 'listing' ELSE 'generic_page' END AS page_type FROM c""")
def page_types(t: Tables):
    n = F.size(F.filter(html.links(F.col("html")), lambda l: l["href"].rlike(pages.PRODUCT_PATH)))
    return t.pages.select("page_id", pages.page_type(F.col("url"), F.col("html"), n).alias("page_type"))


@query("page_platforms", rf"""SELECT page_id, CASE WHEN contains(lower(html), 'cdn.shopify.com') OR contains(lower(html), 'myshopify.com') OR contains(lower(html), 'shopify.theme') THEN 'shopify' WHEN contains(lower(html), 'woocommerce') THEN 'woocommerce' WHEN page_id % 3 = 0 OR contains(lower(html), 'mage/') THEN 'magento'
    WHEN contains(lower(html), 'bigcommerce') THEN 'bigcommerce' ELSE 'custom' END AS platform, CASE WHEN page_id % 4 = 0 THEN 'custom' WHEN contains(lower(html), 'wp-content') OR contains(lower(html), 'woocommerce') THEN 'woocommerce' WHEN contains(lower(html), 'mage/') OR contains(lower(html), 'magento') THEN 'magento' ELSE 'custom' END AS probed FROM pages""")
def page_platforms(t: Tables):
    headers = F.when(F.col("page_id") % 3 == 0, F.create_map(F.lit("X-Magento-Cache"), F.lit("hit")))
    status = F.when(F.col("page_id") % 4 == 0, 403).otherwise(200)
    return t.pages.select("page_id", brands.detect_platform(headers, F.col("html")).alias("platform"), brands.probe_platform(status, F.col("html")).alias("probed"))


PLAIN = "html"
for _tag in fixed.NOISE_TAGS:
    PLAIN = f"regexp_replace({PLAIN}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'g')"


def pieces(x: str) -> str:
    """The texts between tags, joined by a space."""
    return f"array_to_string(list_filter(list_transform(string_split_regex({x}, '(?s)<!--.*?-->|<[^>]*>'), lambda y: trim({unescape('y')}, ' ' || chr(9) || chr(10) || chr(13))), lambda y: y <> ''), ' ')"


QUIET = "html"
for _tag in fixed.NOISE_TAGS:
    QUIET = f"regexp_replace({QUIET}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '<gone>', 'g')"


# The given pages hold one heading in an article, and no specification, description or price elements.
@query("page_texts", f"""WITH q AS (SELECT page_id, {QUIET} AS quiet, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages),
    s AS (SELECT page_id, {unescape("regexp_replace(h, '<[^>]*>', '', 'g')")} AS heading, quiet, {pieces("regexp_extract(quiet, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS inner_, {pieces("regexp_extract(quiet, '(?is)<body[^>]*>(.*)', 1)")} AS body, {pieces("regexp_replace(quiet, '(?is)^<!doctype[^>]*>', '')")} AS whole FROM q)
    SELECT page_id, trim(heading) AS heading, '' AS description, '' AS blocks, CASE WHEN length(inner_) >= 200 THEN inner_ WHEN length(body) >= 200 THEN body ELSE whole END AS surroundings, CAST(length(replace(quiet, '<gone>', '')) AS INT) AS clean_chars FROM s""")
def page_texts(t: Tables):
    read = pages.read_dom(t.pages.select("page_id", "html", F.lit("generic").alias("site")))
    return read.select("page_id", "heading", "description", F.array_join("blocks", "\n").alias("blocks"), "surroundings", F.length("clean_html").alias("clean_chars"))


@query("plain_page_texts", f"""SELECT page_id, trim(regexp_replace({unescape(f"regexp_replace({PLAIN}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS text FROM pages""")
def plain_page_texts(t: Tables):
    return t.pages.select("page_id", pages.plain_text(F.col("html")).alias("text"))


@query("url_forms", rf"""SELECT page_id, lower(rtrim(trim(url), '/')) AS url_key, replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), 'www.', '') AS host, replace(split_part(split_part(url, '/', -1), '?', 1), '-', ' ') AS slug_words,
    replace(rtrim(split_part(url, '?', 1), '/'), 'www.', '') AS golden, CASE WHEN contains(lower(url), 'amazon.in') THEN 'amazon' WHEN page_id % 2 = 0 THEN 'shopify' ELSE 'generic' END AS site FROM pages""")
def url_forms(t: Tables):
    url = F.col("url")
    platform = F.when(F.col("page_id") % 4 == 0, F.lit("shopify")).when(F.col("page_id") % 2 == 1, F.lit("custom"))
    return t.pages.select("page_id", urls.url_key(url).alias("url_key"), urls.host(url).alias("host"), urls.slug_words(url).alias("slug_words"), urls.golden_url(url).alias("golden"), urls.site_of(url, platform).alias("site"))


@query("distinct_hosts", f"""SELECT DISTINCT replace(lower(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1)), 'www.', '') AS host FROM (SELECT url AS u FROM pages UNION ALL SELECT CASE WHEN page_id % 2 = 0 THEN 'https://www.amazon.in/x' ELSE 'https://www.store' || (page_id % 7) || '.in/a' END FROM pages)
    WHERE NOT list_contains({listed(fixed.AGGREGATOR_DOMAINS)}, replace(lower(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1)), 'www.', ''))""")
def distinct_hosts(t: Tables):
    results = t.pages.select("url").unionByName(t.pages.select(F.expr("CASE WHEN page_id % 2 = 0 THEN 'https://www.amazon.in/x' ELSE concat('https://www.store', page_id % 7, '.in/a') END").alias("url")))
    return pages.without_aggregators(results)


# --- pages written from part --------------------------------------------------------------------------

_SIZE = "CAST(p_size AS STRING)"
PRODUCT_PAGES = {
    "id": "p_partkey",
    "url": f"CASE p_partkey % 4 WHEN 0 THEN 'https://shop.example/products/' || replace(p_name, ' ', '-') WHEN 1 THEN 'https://www.croma.com/' || replace(p_name, ' ', '-') || '-10000mah-power-bank/p/' || {_SIZE} WHEN 2 THEN 'https://www.reliancedigital.in/product/' || replace(p_name, ' ', '-') || '-online?x=1' ELSE 'https://www.store.example/' || replace(p_name, ' ', '-') END",
    "status": "CASE p_size % 10 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 429 WHEN 4 THEN 503 ELSE 200 END",
    "html": f"'<html><head><title>' || CASE WHEN p_size % 10 = 5 THEN 'Page Not Found' WHEN p_size % 10 = 6 THEN 'Just a moment...' ELSE p_name END || '</title><meta property=\"og:image\" content=\"/og/' || {_SIZE} || '.png\"><script type=\"application/ld+json\">{{\"@type\":\"Product\",\"name\":\"' || p_name || ' Max\",\"image\":[\"https://cdn.x/' || {_SIZE} || '.png\"],\"offers\":{{\"price\":\"' || CAST(p_size * 100 AS STRING) || '\"}},"
            f"\"additionalProperty\":[{{\"name\":\"Battery Capacity\",\"value\":\"' || CAST(p_size * 1000 AS STRING) || ' mAh\"}},{{\"name\":\"Weight\",\"value\":\"' || {_SIZE} || '0 g\"}}]}}</script></head><body><h1 class=\"product-title\">' || p_name || '</h1><img src=\"/media/' || {_SIZE} || '.jpg\" alt=\"' || p_name || '\"><img src=\"/logo.png\">"
            f"<img data-zoom-image=\"https://cdn.x/zoom.png\" src=\"a.png\" srcset=\"s1.png 100w, s2.png 900w, s3.png 300w\"><p>MRP: Rs. ' || CAST(p_size * 90 AS STRING) || '</p></body></html>'",
}
WITH_PAGES = f"WITH p AS (SELECT {inputs.select(PRODUCT_PAGES)} FROM part)"


def product_pages(t: Tables):
    return inputs.derive(t.part, PRODUCT_PAGES)


@query("page_states", f"""{WITH_PAGES} SELECT id, CASE WHEN status IN (401, 403, 429) THEN 'blocked' WHEN status IN (404, 410) THEN 'delisted' WHEN status <> 200 THEN 'failed' WHEN contains(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), 'not found') THEN 'soft_404' ELSE 'ok' END AS state FROM p""")
def page_states(t: Tables):
    return product_pages(t).select("id", pages.page_status(F.col("status"), F.col("html")).alias("state"))


@query("blocked_responses", f"""{WITH_PAGES} SELECT id, CASE WHEN contains(lower(html), 'just a moment...') OR (id % 5 = 0 AND status IN (403, 429, 503)) THEN 'cloudflare' WHEN id % 5 = 1 AND status IN (403, 429) THEN 'akamai' WHEN id % 5 = 2 AND status IN (403, 429, 200) THEN 'datadome' WHEN id % 5 = 3 THEN 'aws_waf'
    WHEN status IN (403, 429) THEN 'generic_waf' END AS vendor FROM p""")
def blocked_responses(t: Tables):
    kind = F.col("id") % 5
    headers = (F.when(kind == 0, F.create_map(F.lit("CF-RAY"), F.lit("1"))).when(kind == 1, F.create_map(F.lit("Set-Cookie"), F.lit("_abck=1"))).when(kind == 2, F.create_map(F.lit("X-DataDome-CID"), F.lit("1")))
               .when(kind == 3, F.create_map(F.lit("x-amzn-waf-action"), F.lit("block"))))
    return product_pages(t).select("id", pages.classify_block(F.col("status"), headers, F.col("html"))["vendor"].alias("vendor"))


@query("jsonld_products", f"""WITH p AS (SELECT p_partkey AS id, p_name, p_size FROM part) SELECT id, p_name || ' Max' AS name, CAST(p_size * 100 AS DOUBLE) AS price, 'https://cdn.x/' || p_size || '.png' AS images, (p_size * 1000) || ' mAh' AS capacity, p_size || '0 g' AS weight FROM p""")
def jsonld_products(t: Tables):
    df = product_pages(t).select("id", html.jsonld_facts(html.jsonld_products(F.col("html"))).alias("f"))
    return df.select("id", "f.name", "f.price", F.array_join("f.images", " ").alias("images"), F.col("f.specs")["capacity"].alias("capacity"), F.col("f.specs")["weight"].alias("weight"))


@query("page_images", """WITH p AS (SELECT p_partkey AS id, p_size, CASE p_partkey % 4 WHEN 0 THEN 'https://shop.example' WHEN 1 THEN 'https://www.croma.com' WHEN 2 THEN 'https://www.reliancedigital.in' ELSE 'https://www.store.example' END AS o,
      CASE p_partkey % 4 WHEN 0 THEN '/products/' WHEN 1 THEN '/' || replace(p_name, ' ', '-') || '-10000mah-power-bank/p/' WHEN 2 THEN '/product/' ELSE '/' END AS d FROM part)
    SELECT id, o || '/media/' || p_size || '.jpg https://cdn.x/zoom.png ' || o || d || 's2.png ' || o || '/og/' || p_size || '.png' AS images FROM p""")
def page_images(t: Tables):
    return product_pages(t).select("id", F.array_join(html.generic_images(F.col("html"), F.col("url"), F.lit(None)), " ").alias("images"))


@query("observed_pages")
def observed_pages(t: Tables):
    rows = product_pages(t).withColumns({"headers": F.lit(None).cast("map<string,string>"), "platform": F.when(F.col("id") % 8 == 0, F.lit("shopify")).otherwise(F.lit("custom")), "category": F.lit("Powerbank")})
    return pages.observe_pages(rows).select("url", "site", "page_state", "success", "title", "price", F.to_json("specs").alias("specs"), F.array_join("images", " ").alias("images"))


@query("observed_prices", """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 IN (1, 2) THEN CASE WHEN p_size * 90 > 100 THEN CAST(p_size * 90 AS DOUBLE) END WHEN p_partkey % 8 = 0 THEN CASE WHEN p_size * 90 > 100 THEN CAST(p_size * 90 AS DOUBLE) END ELSE nullif(CAST(p_size * 100 AS DOUBLE), 0) END AS price FROM part""")
def observed_prices(t: Tables):
    platform = F.when(F.col("id") % 8 == 0, F.lit("shopify")).otherwise(F.lit("custom"))
    price = html.jsonld_facts(html.jsonld_products(F.col("html")))["price"]
    none = F.array().cast("array<string>")
    return product_pages(t).select("id", pages.page_price(urls.site_of(F.col("url"), platform), price, none, F.col("html")).alias("price"))


@query("observation_success", """WITH o AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'amazon' WHEN 1 THEN 'croma' WHEN 2 THEN 'shopify' WHEN 3 THEN 'tatacliq' ELSE 'generic' END AS site, p_size % 3 AS n, p_size % 2 AS i, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE 'text' END AS d FROM part)
    SELECT id, CASE site WHEN 'amazon' THEN i > 0 WHEN 'croma' THEN n > 0 WHEN 'tatacliq' THEN n > 0 WHEN 'shopify' THEN n > 0 OR trim(d) <> '' ELSE n >= 2 OR i > 0 END AS success FROM o""")
def observation_success(t: Tables):
    df = inputs.derive(t.part, {"id": "p_partkey", "site": "CASE p_partkey % 5 WHEN 0 THEN 'amazon' WHEN 1 THEN 'croma' WHEN 2 THEN 'shopify' WHEN 3 THEN 'tatacliq' ELSE 'generic' END", "n": "p_size % 3", "i": "p_size % 2", "d": "CASE WHEN p_size % 4 = 0 THEN ' ' ELSE 'text' END"})
    specs = F.when(F.col("n") == 0, F.create_map().cast("map<string,string>")).when(F.col("n") == 1, F.create_map(F.lit("output"), F.lit("1W"))).otherwise(F.create_map(F.lit("capacity"), F.lit("1"), F.lit("weight"), F.lit("2")))
    images = F.when(F.col("i") > 0, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>"))
    return df.select("id", pages.observation_success(F.col("site"), specs, F.col("d"), images).alias("success"))


@query("slug_titles", r"""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN trim(regexp_replace(regexp_replace(p_name || ' 10000mah power bank', '(?i)\b(online|croma|buy|best price|prices|fast charging|power bank|powerbank)\b', '', 'g'), '\s+', ' ', 'g')) WHEN p_partkey % 4 = 2 THEN trim(regexp_replace(p_name || ' online', '(?i)\b(online|reliance|digital)\b', '', 'g')) ELSE '' END AS s, p_partkey % 4 AS k FROM part)
    SELECT id, CASE WHEN k IN (1, 2) THEN array_to_string(list_transform(string_split(s, ' ')[:4], lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE '' END AS title FROM p""")
def slug_titles(t: Tables):
    url = F.col("url")
    title = F.when(F.contains(url, F.lit("croma")), urls.slug_title(url, "croma")).otherwise(urls.slug_title(url, "reliance"))
    return product_pages(t).select("id", title.alias("title"))


IMAGE_URLS = {"id": "p_partkey", "url": f"CASE p_partkey % 6 WHEN 0 THEN 'https://x/cdn/shop/' || p_name || '.png?width=300' WHEN 1 THEN 'https://cdn.shopify.com/' || {_SIZE} || '.png' WHEN 2 THEN 'https://m.media-amazon.com/i/' || {_SIZE} || '._AC_SX300_.jpg' WHEN 3 THEN 'https://x/media/catalog/product/cache/ab12/' || {_SIZE} || '-01.jpg' WHEN 4 THEN 'https://x/banner.png' ELSE 'https://x/Hero.png' END"}


@query("image_urls", f"""WITH p AS (SELECT {inputs.select(IMAGE_URLS)} FROM part) SELECT id, CASE id % 6 WHEN 0 THEN replace(url, 'width=300', 'width=2048') WHEN 1 THEN url || '?width=2048' WHEN 2 THEN replace(url, '._AC_SX300_.', '._SL1500_.') WHEN 3 THEN replace(url, '/cache/ab12/', '/') ELSE url END AS upgraded,
    CAST(CASE WHEN id % 6 = 5 THEN 0 WHEN id % 6 = 3 OR contains(lower(url), 'white') THEN 1 WHEN id % 6 = 4 THEN 9 ELSE 5 END AS INT) AS rank FROM p""")
def image_urls(t: Tables):
    return inputs.derive(t.part, IMAGE_URLS).select("id", urls.upgrade_image_url(F.col("url")).alias("upgraded"), urls.image_rank(F.col("url")).alias("rank"))


@query("image_ownership", f"""SELECT p_partkey AS id, {duck.subset(duck.minus(duck.tokens(duck.portion("p_name || ' ' || p_size || ' Power Bank'", 'p_brand')), duck.listed(fixed.NEAR_MISS_GENERIC)), duck.tokens("CASE WHEN p_partkey % 2 = 0 THEN p_name || '-' || p_size || '.png' ELSE p_name END"))} AS belongs FROM part""")
def image_ownership(t: Tables):
    df = inputs.derive(t.part, {"id": "p_partkey", "b": "p_brand", "m": f"p_name || ' ' || {_SIZE} || ' Power Bank'", "x": f"CASE WHEN p_partkey % 2 = 0 THEN p_name || '-' || {_SIZE} || '.png' ELSE p_name END"})
    return df.select("id", pages.image_belongs_to_model(F.col("x"), F.col("m"), F.col("b")).alias("belongs"))


@query("collection_listings", rf"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=.*?</a>') AS l FROM pages), e AS (SELECT page_id, url, unnest(range(len(l))) AS pos, unnest(l) AS a FROM a), h AS (SELECT page_id, url, pos, '/products' || trim({unescape(search('a', r'(?is)^<a\b[^>]*href\s*=\s*"([^"]*)"', 1))}) AS href, trim({text_of(search('a', r'(?is)^<a\b[^>]*>(.*)</a>$', 1))}) AS text FROM e),
    s AS (SELECT page_id, url, pos, split_part(split_part(href, '?', 1), '#', 1) AS href, CASE WHEN length(text) > 3 AND NOT regexp_matches(text, '^\d+(\.\d+)?$') THEN text || ' ' ELSE '' END AS said FROM h WHERE contains(split_part(href, '?', 1), '/products/')),
    w AS (SELECT *, said || replace(split_part(href, '/', -1), '-', ' ') AS words FROM s)
    SELECT page_id, {ORIGIN} || href AS url, string_agg(words, ' ' ORDER BY pos) AS title, CAST(min(pos) AS INT) AS pos FROM w GROUP BY page_id, url, href""")
def collection_listings(t: Tables):
    shop = t.pages.withColumn("html", F.regexp_replace("html", 'href="/', 'href="/products/'))
    return pages.collection_listings(shop)


# Pictures before and after headings; some are furniture, some are other products'.
PICTURES = "replace(replace(replace(html, '<nav>', '<nav><img class=\"x\" src=\"/assets/logo.png\">'), '<p><b>', '<img src=\"//cdn/product/cache/0a/' || CAST(page_id AS STRING) || '.png\" alt=\"Volt &amp; Go\"><h3>Volt <i>Go</i></h3><p><img data-src=\"/images/a.png\"><b>'), '</article>', '<H2>Other</H2><img title=\"Zed\" src=''/product/z.png''></article>')"
_HEAD = r"(?is)^<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>"
_EVENTS = rf"""WITH g AS (SELECT page_id, url, {PICTURES} AS html FROM pages), e0 AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>|<img\b[^>]*>') AS l FROM g), e AS (SELECT page_id, url, unnest(range(len(l))) AS i, unnest(l) AS t FROM e0),
    k AS (SELECT *, lower(t[1:4]) = '<img' AS pic, CASE WHEN lower(t[1:4]) <> '<img' THEN trim({text_of(f"regexp_extract(t, '{_HEAD}', 1)")}) END AS head FROM e),
    c AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS heading FROM k),
    a AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, heading, regexp_extract(t, '(?:data-)?src=["'']([^"'']*)', 1) AS src, {unescape("regexp_extract(t, 'alt=\"([^\"]*)', 1)")} AS alt, regexp_extract(t, 'title="([^"]*)', 1) AS title FROM c WHERE pic)"""


@query("image_context", f"{_EVENTS} SELECT page_id, CAST(pos AS INT) AS pos, src, concat_ws(' ', nullif(alt, ''), nullif(title, ''), nullif(heading, ''), src) AS image_text FROM a")
def image_context(t: Tables):
    return pages.image_context(t.pages.select("page_id", F.expr(PICTURES).alias("html")))


@query("gallery_images", f"""{_EVENTS}, w AS (SELECT *, lower(concat_ws(' ', alt, title, heading, src)) AS words FROM a), m AS (SELECT page_id, pos, CASE WHEN page_id % 3 = 0 THEN true WHEN page_id % 3 = 1 THEN contains(words, 'volt') AND contains(words, 'go') ELSE contains(words, 'zed') END AS fits, regexp_replace(src, '/cache/[a-f0-9]+/', '/') AS s FROM w
      WHERE NOT contains(src, 'logo')), o AS (SELECT page_id, CASE WHEN s LIKE '//%' THEN 'https:' || s ELSE s END AS image, min(pos) AS p FROM m WHERE fits GROUP BY ALL)
    SELECT page_id AS product_id, image AS url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS INT) AS pos FROM o""")
def gallery_images(t: Tables):
    shown = t.pages.select(F.col("page_id").alias("product_id"), F.col("page_id").cast("string").alias("url"), F.expr(PICTURES).alias("html"))
    wanted = shown.select("product_id", "url", F.lit("Acme").alias("brand"), F.expr("CASE product_id % 3 WHEN 0 THEN 'Acme earbuds' WHEN 1 THEN 'Acme Volt Go' ELSE 'Zed charger' END").alias("model_name"))
    return pages.gallery_candidates(wanted, shown.select("url", "html")).select("product_id", "url", "pos")


# Addresses given by hand: shop pages of links, product pages and pages without links; some models are on their page.
GIVEN_PAGES = {"page_id": "page_id", "url": "CASE WHEN page_id % 5 = 3 THEN 'https://s.example/products/x-' || CAST(page_id AS STRING) ELSE url || '?by=' || CAST(page_id AS STRING) END",
               "html": "CASE WHEN page_id % 5 = 4 THEN replace(html, '<a ', '<b ') ELSE html END"}
WANTED = "CASE WHEN page_id % 2 = 0 THEN regexp_extract(html, '<li><a href=.([/])([a-z]{4,})', 2) ELSE 'Nosuch Model' END"
_ASKED = f"SELECT page_id AS product_id, url, 'Acme' AS brand, {WANTED} AS model_name, CAST(NULL AS VARCHAR[]) AS qualifiers FROM g"
_LINKS = rf"""a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=.*?</a>') AS l FROM g), e AS (SELECT page_id, url, unnest(range(len(l))) AS pos, unnest(l) AS a FROM a), h AS (SELECT page_id, url, pos, '/products' || trim({unescape(search('a', r'(?is)^<a\b[^>]*href\s*=\s*"([^"]*)"', 1))}) AS href, trim({text_of(search('a', r'(?is)^<a\b[^>]*>(.*)</a>$', 1))}) AS text FROM e),
    s AS (SELECT page_id, url, pos, split_part(split_part(href, '?', 1), '#', 1) AS href, CASE WHEN length(text) > 3 AND NOT regexp_matches(text, '^\d+(\.\d+)?$') THEN text || ' ' ELSE '' END AS said FROM h WHERE contains(split_part(href, '?', 1), '/products/')),
    w AS (SELECT *, said || replace(split_part(href, '/', -1), '-', ' ') AS words FROM s)
    SELECT page_id, {ORIGIN} || href AS url, string_agg(words, ' ' ORDER BY pos) AS title, CAST(min(pos) AS INT) AS pos FROM w GROUP BY page_id, url, href"""
_PART = "replace(split_part(split_part({0}, '/', -1), '?', 1), '-', ' ')"
OUTCOMES_SQL = pairs_sql(
    "SELECT DISTINCT brand, CAST(NULL AS VARCHAR) AS category, model_name, CAST(NULL AS VARCHAR) AS target_capacity, qualifiers FROM req",
    "SELECT DISTINCT CAST(NULL AS VARCHAR) AS store_brand, title, url FROM links",
    f"(SELECT DISTINCT q.brand AS q_brand, q.model_name AS q_model, k.title AS q_title, {_PART.format('k.url')} AS q_slug FROM req q JOIN links k ON k.page_id = q.product_id) q "
    "JOIN targets p ON p.brand = q_brand AND p.model_name = q_model JOIN texts l ON l.title = q_title AND l.slug = q_slug",
    f"WITH g AS (SELECT {inputs.select(GIVEN_PAGES)} FROM pages), req AS ({_ASKED}), links AS (SELECT * FROM (WITH {_LINKS})),") + f""",
    hit AS (SELECT q.product_id, arg_min({{'url': k.url, 'title': k.title}}, (-x.score, k.pos)) AS b FROM req q JOIN links k ON k.page_id = q.product_id
      JOIN (SELECT DISTINCT model_name, title, slug, score, valid FROM scored) x ON x.model_name = q.model_name AND x.title = k.title AND x.slug = {_PART.format('k.url')} WHERE x.valid AND x.score >= 100 GROUP BY q.product_id),
    c AS (SELECT page_id, count(*) AS n, list(title ORDER BY pos) FILTER (length(title) > 2) AS t FROM links GROUP BY page_id),
    o AS (SELECT q.*, h.b, coalesce(c.n, 0) AS n_listed, coalesce(c.t, [])[:5] AS t, q.product_id % 5 = 3 AS single FROM req q LEFT JOIN hit h USING (product_id) LEFT JOIN c ON c.page_id = q.product_id)
    SELECT product_id, single OR b IS NOT NULL AS success, CASE WHEN single THEN 'single_product' WHEN b IS NOT NULL THEN 'listing_match' WHEN n_listed > 0 THEN 'listing' ELSE 'generic_page' END AS page_type, CASE WHEN single THEN url ELSE b.url END AS direct_url,
      CASE WHEN single THEN 'Direct product page resolved: ' || url WHEN b IS NOT NULL THEN 'Matched model ''' || model_name || ''' to listing item ''' || b.title || ''': ' || b.url
        WHEN n_listed > 0 THEN 'That page lists ' || n_listed || ' products (' || CASE WHEN len(t) > 0 THEN array_to_string(list_transform(t, lambda x: '''' || x || ''''), ', ') ELSE 'none named' END || '), but none matched model ''' || model_name || '''.'
        ELSE 'No product listings or specifications found on page: ' || url END AS message FROM o"""


@query("manual_url_outcomes", OUTCOMES_SQL)
def manual_url_outcomes(t: Tables):
    given = inputs.derive(t.pages, GIVEN_PAGES)
    requests = given.select(F.col("page_id").alias("product_id"), "url", F.lit("Acme").alias("brand"), F.expr(WANTED).alias("model_name"), F.lit(None).cast("array<string>").alias("qualifiers"))
    shop = given.withColumn("html", F.regexp_replace("html", 'href="/', 'href="/products/'))
    return pages.manual_outcomes(requests, shop.select("url", "html")).select("product_id", "success", "page_type", "direct_url", "message")


@query("feed_listings", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) SELECT lower(p_brand) || '.example' AS domain, 'https://' || lower(p_brand) || '.example/products/' || replace(p_name, ' ', '-') AS url, p_name AS title, p_brand AS vendor, p_size || ' & more' AS description,
    p_retailprice AS price, p_retailprice * 2 AS list_price, 'https://cdn.x/' || p_partkey || '.png' AS images FROM p""")
def feed_listings(t: Tables):
    """Each product as a one-item feed document, serialised to JSON and read back with the feed's schema."""
    product = F.struct(F.col("p_name").alias("title"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("handle"), F.col("p_brand").alias("vendor"), F.concat(F.lit("<p>"), F.col("p_size").cast("string"), F.lit(" &amp; more</p>")).alias("body_html"),
                       F.array(F.struct(F.concat(F.lit("https://cdn.x/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("src"))).alias("images"),
                       F.array(F.struct(F.col("p_retailprice").cast("string").alias("price"), (F.col("p_retailprice") * 2).cast("string").alias("compare_at_price"))).alias("variants"))
    documents = t.part.select(F.concat(F.lower("p_brand"), F.lit(".example")).alias("domain"), F.to_json(F.struct(F.array(product).alias("products"))).alias("document"))
    feeds = documents.select("domain", F.from_json("document", pages.FEED)["products"].alias("products"))
    return pages.feed_listings(feeds).withColumn("images", F.array_join("images", " ")).drop("arrival")


@query("sitemap_products", f"""WITH l AS (SELECT url AS loc, page_id % 5 = 0 AS child FROM pages UNION ALL SELECT 'https://s.example/product/' || page_id || '-x.html', false FROM pages) SELECT trim(loc) AS url, replace(replace(split_part(split_part(trim(loc), '/', -1), '?', 1), '-', ' '), '.html', '') AS title FROM l WHERE child OR {any_of('lower(trim(loc))', fixed.SITEMAP_MARKS)}""")
def sitemap_products(t: Tables):
    """Locations written as sitemap XML and read back from it."""
    entry = t.pages.select(F.col("url").alias("loc"), (F.col("page_id") % 5 == 0).alias("child")).unionByName(
        t.pages.select(F.concat(F.lit("https://s.example/product/"), F.col("page_id").cast("string"), F.lit("-x.html")).alias("loc"), F.lit(False).alias("child")))
    xml = F.concat(F.lit("<url><loc>"), F.replace("loc", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    return pages.sitemap_products(entry.select(F.from_xml(xml, "loc string")["loc"].alias("loc"), "child"))


@query("verified_storefronts", f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || 'shop.example' ELSE 'other.example' END AS domain0, lang AS brand, lower(text || CASE WHEN doc_id % 5 = 0 THEN ' buy this domain' WHEN doc_id % 5 = 1 THEN ' official store' ELSE '' END || ' ' || lang) AS text FROM documents),
    m AS (SELECT DISTINCT lang AS brand, w AS model_name FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark) CROSS JOIN (SELECT DISTINCT lang FROM documents) WHERE regexp_matches(w, '^[a-z]{{6,}}$')),
    k AS (SELECT s.doc_id, count(DISTINCT m.model_name) AS n FROM (SELECT DISTINCT doc_id, brand, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM s) s JOIN m ON m.brand = s.brand AND m.model_name = s.w GROUP BY s.doc_id)
    SELECT domain0 || '/' || s.doc_id AS domain, brand, {any_of('text', fixed.PARKED_SIGNATURES)} AS parked, coalesce(n, 0) AS n_matched, NOT {any_of('text', fixed.PARKED_SIGNATURES)} AND (coalesce(n, 0) > 0 OR (contains(domain0 || '/' || s.doc_id, brand) AND contains(text, brand) AND {any_of('text', fixed.STOREFRONT_WORDS)})) AS verified FROM s LEFT JOIN k ON k.doc_id = s.doc_id""")
def verified_storefronts(t: Tables):
    stores = t.documents.select(
        F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("shop.example"))).otherwise(F.lit("other.example")), F.lit("/"), F.col("doc_id").cast("string")).alias("domain"), F.col("lang").alias("brand"),
        F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit(" buy this domain")).when(F.col("doc_id") % 5 == 1, F.lit(" official store")).otherwise(F.lit("")), F.lit(" "), "lang").alias("text"))
    words = benchmark_words(t, "brand")
    return pages.verify_storefronts(stores, words.where(F.col("model_name").rlike("^[a-z]{6,}$")))


@query("sheet_domains", f"""SELECT doc_id, NOT {any_of('lower(text)', fixed.SHEET_DOMAIN_PARKED)} AND ({' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in fixed.COMMERCE_INDICATORS)}) >= 2 AS plausible FROM documents""")
def sheet_domains(t: Tables):
    return t.documents.select("doc_id", pages.plausible_sheet_domain(F.col("text")).alias("plausible"))


# --- brochures ----------------------------------------------------------------------------------------

BROCHURE_PRODUCTS = {"product_id": "p_partkey", "scope": "p_brand", "model_name": "CASE WHEN p_partkey % 2 = 0 THEN p_name || ' Power Bank' ELSE p_name END"}
BROCHURE_PAGES = {"scope": "p_brand", "brochure": "'b' || CAST(p_size % 3 AS STRING) || '.pdf'", "brochure_rank": "p_size % 3", "page_no": "CAST(p_partkey AS INT)",
                  "text": f"CASE WHEN p_partkey % 7 = 0 THEN 'short' ELSE 'Welcome to the catalogue' || chr(10) || p_name || ' power bank' || chr(10) || CAST(p_size * 1000 AS STRING) || 'mAh and ' || {_SIZE} || 'W' || chr(10) || ' Other power bank' || chr(10) || '999 g' END"}


@query("brochure_matches", rf"""WITH p AS (SELECT {inputs.select(BROCHURE_PRODUCTS)} FROM part), b AS (SELECT {inputs.select(BROCHURE_PAGES)}, p_name, p_size FROM part WHERE p_partkey % 7 <> 0),
    c AS (SELECT p.product_id, b.*, row_number() OVER (PARTITION BY product_id ORDER BY brochure_rank, page_no) AS n FROM p JOIN b ON b.scope = p.scope AND list_has_all({duck.tokens('b.text')}, {duck.tokens(duck.portion('p.model_name'))}))
    SELECT product_id, brochure, page_no, p_name || ' power bank' || chr(10) || (p_size * 1000) || 'mAh and ' || p_size || 'W' AS section, (p_size * 1000) || ' mAh' AS capacity, p_size || 'W' AS output, 'brochure: ' || brochure || ', page ' || page_no AS source_url FROM c WHERE n = 1""")
def brochure_matches(t: Tables):
    wanted = inputs.derive(t.part, BROCHURE_PRODUCTS).withColumn("qualifiers", F.lit(None).cast("array<string>"))
    out = brochures.match_brochures(wanted, inputs.derive(t.part, BROCHURE_PAGES))
    return out.select("product_id", "brochure", "page_no", "section", F.col("specs")["capacity"].alias("capacity"), F.col("specs")["output"].alias("output"), "source_url")


FILES = "CASE p_partkey % 5 WHEN 0 THEN 'brochures/powerbank/' || lower(p_brand) || '/' || p_name || '.pdf' WHEN 1 THEN 'brochures/' || lower(p_brand) || '/' || p_name || '.PDF' WHEN 2 THEN 'brochures/' || p_brand || '/' || p_name || '.txt' WHEN 3 THEN 'data/brochures/' || lower(p_brand) || '.pdf' ELSE 'brochures/powerbank/' || p_brand || '/' || p_name || '.pdf' END"


@query("brochure_files", f"""WITH files AS (SELECT DISTINCT {FILES.replace("STRING", "VARCHAR")} AS path FROM part), pdfs AS (SELECT path AS file, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM files WHERE ends_with(lower(path), '.pdf')),
    w AS (SELECT DISTINCT p_brand AS brand, CASE WHEN p_size > 25 THEN 'Powerbank' END AS category, replace(lower(p_brand), ' ', '-') AS b, CASE WHEN p_size > 25 THEN 'powerbank' END AS c FROM part),
    places AS (SELECT brand, category, 'brochures/' || c || '/' || b AS folder, 1 AS place FROM w WHERE c IS NOT NULL UNION ALL SELECT brand, category, 'brochures/' || c || '/' || brand, 2 FROM w WHERE c IS NOT NULL
      UNION ALL SELECT brand, category, 'brochures/' || b, 3 FROM w UNION ALL SELECT brand, category, 'brochures/' || brand, 4 FROM w),
    hits AS (SELECT brand, category, place, file FROM places JOIN pdfs USING (folder) UNION ALL SELECT brand, category, 5, file FROM w JOIN pdfs ON file IN ('data/brochures/' || b || '.pdf', 'data/brochures/' || brand || '.pdf')),
    found AS (SELECT brand, category, arg_min(file, struct_pack(a := place, b := file)) AS path, min(place) AS place FROM hits GROUP BY brand, category, lower(file))
    SELECT brand, category, path, CAST(place AS INT) AS place FROM found f WHERE place <= 2 OR NOT EXISTS (SELECT 1 FROM found g WHERE g.brand = f.brand AND g.category IS NOT DISTINCT FROM f.category AND g.place <= 2)""")
def brochure_files(t: Tables):
    files = t.part.select(F.expr(FILES).alias("path")).distinct()
    wanted = t.part.select(F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 25, F.lit("Powerbank")).alias("category"), F.lit(None).cast("string").alias("override")).distinct()
    return brochures.discover_brochures(files, wanted)
