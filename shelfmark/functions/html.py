"""Recorded HTML as columns: native expressions for tags, attributes, JSON-LD, links and images."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.functions.text import contains_any, first_match, not_empty, replace_all, search, strip, with_value
from shelfmark.functions.urls import absolute

_STRINGS = "array<string>"


#: Named entities of HTML; a non-breaking space reads as a space.
_NAMED = json.dumps({name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " ", "apos": "'"})
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"


def _character(entity: Column) -> Column:
    """What an entity stands for, without its ampersand and semicolon; an unknown name stays as it is written."""
    hexadecimal = F.lower(F.substring(entity, 2, 1)) == "x"
    code = F.when(hexadecimal, F.conv(F.substring(entity, 3, 6), 16, 10)).otherwise(F.substring(entity, 2, 7)).cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    known = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    numeric = F.when(code == 160, F.lit(" ")).otherwise(known)
    named = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), entity)
    return F.when(entity.startswith("#"), numeric).otherwise(F.coalesce(named, F.concat(F.lit("&"), entity, F.lit(";"))))


def unescape(c: Column) -> Column:
    """Numeric and named entities as characters, each once: `&amp;lt;` becomes `&lt;`."""
    def read(text: Column) -> Column:
        between = F.split(text, _ENTITY, -1)
        characters = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1)), _character)
        rest = F.zip_with(characters, F.slice(between, 2, F.size(between)), lambda x, y: F.concat(x, y))
        return F.when(F.contains(text, F.lit("&")), F.concat(F.get(between, F.lit(0)), F.array_join(rest, ""))).otherwise(text)

    return with_value(c, read)


def text_of(fragment: Column) -> Column:
    return unescape(replace_all(fragment, r"(?s)<[^>]*>"))


def tags(html: Column, name: str) -> Column:
    """All opening tags of a kind, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, or null when it is absent or empty."""
    given = first_match(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return not_empty(unescape(replace_all(given, r"^[\"']|[\"']$")))


def document_title(html: Column) -> Column:
    return strip(F.coalesce(unescape(search(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit("")))


def meta_content(html: Column, name: str) -> Column:
    found = F.filter(tags(html, "meta"), lambda t: F.coalesce(attribute(t, "property"), attribute(t, "name")) == name)
    return attribute(F.get(found, F.lit(0)), "content")


def heading(html: Column, preferred_class: str) -> Column:
    """First h1 with such a class, else the first h1."""
    classed = search(html, rf"(?is)<h1\b[^>]*class\s*=\s*[\"'][^\"']*(?:{preferred_class})[^\"']*[\"'][^>]*>(.*?)</h1>", 1)
    return strip(text_of(F.coalesce(classed, search(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))))


def page_title(html: Column, jsonld_name: Column | None = None) -> Column:
    """Heading, else og:title, else the JSON-LD name."""
    options = [not_empty(heading(html, "product.*title|title|entry-title")), strip(meta_content(html, "og:title"))]
    return F.coalesce(*options, *([jsonld_name] if jsonld_name is not None else []))


def jsonld_products(html: Column) -> Column:
    """The product items of all JSON-LD blocks, as array<variant>."""
    blocks = F.regexp_extract_all(
        html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))

    def items(block: Column) -> Column:
        listed = F.from_json(block, "array<variant>")
        # most blocks name no graph, and are read once; a name may be written in escapes
        named = F.contains(block, F.lit("@graph")) | F.contains(block, F.lit("\\u"))
        graph = F.when(named, F.from_json(block, "struct<`@graph`: array<variant>>")["@graph"])
        single = F.concat(F.array(F.try_parse_json(block)), F.coalesce(graph, F.array().cast("array<variant>")))
        return F.when(strip(block).startswith("["), F.coalesce(listed, F.array().cast("array<variant>"))).otherwise(single)

    everything = F.flatten(F.transform(blocks, items))
    return F.filter(everything, lambda v: F.try_variant_get(v, "$['@type']", "string").isin("Product", "IndividualProduct"))


def jsonld_facts(items: Column) -> Column:
    """struct(name, description, price, images, specs) over the product items of a page; the page is read for them once."""
    return with_value(items, _facts)


def _facts(items: Column) -> Column:
    def texts(path: str) -> Column:
        return F.filter(F.transform(items, lambda v: F.try_variant_get(v, path, "string")), lambda t: F.coalesce(t, F.lit("")) != "")

    def price(v: Column) -> Column:
        single = F.coalesce(F.try_variant_get(v, "$.offers.price", "string"), F.try_variant_get(v, "$.offers.highPrice", "string"))
        return F.replace(F.coalesce(single, F.try_variant_get(v, "$.offers[0].price", "string")), F.lit(","), F.lit("")).try_cast("double")

    def images(v: Column) -> Column:
        listed = F.transform(
            F.try_variant_get(v, "$.image", "array<variant>"),
            lambda i: F.coalesce(F.try_variant_get(i, "$.url", "string"), F.try_variant_get(i, "$", "string")))
        alone = F.array(F.coalesce(F.try_variant_get(v, "$.image.url", "string"), F.try_variant_get(v, "$.image", "string")))
        return F.filter(F.coalesce(listed, alone), lambda u: F.coalesce(u, F.lit("")).startswith("http"))

    def properties(v: Column) -> Column:
        return F.coalesce(
            F.transform(F.try_variant_get(v, "$.additionalProperty", "array<variant>"), lambda p: F.struct(
                F.lower(F.coalesce(F.try_variant_get(p, "$.name", "string"), F.lit(""))).alias("name"),
                strip(F.coalesce(F.try_variant_get(p, "$.value", "string"), F.lit(""))).alias("value"))),
            F.array().cast("array<struct<name:string,value:string>>"))

    kinds = [("capacity", "capacity"), ("output", "output"), ("port", "ports"), ("weight", "weight"), ("warranty", "warranty")]

    def kind(name: Column) -> Column:
        ladder = F
        for word, spec in kinds:
            ladder = ladder.when(F.contains(name, F.lit(word)), F.lit(spec))
        return ladder

    names = [spec for _, spec in kinds]

    def of_kind(spec: str) -> Callable[[Column], Column]:
        return lambda p: kind(p["name"]) == spec

    def values(stated: Column) -> Column:
        return F.array(*[F.get(F.filter(stated, of_kind(n)), F.lit(0))["value"] for n in names])

    stated = with_value(F.flatten(F.transform(items, properties)), values)
    specs = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), stated), lambda _, v: v.isNotNull())
    prices = F.filter(F.transform(items, price), lambda p: p.isNotNull() & (p != 0))
    return F.struct(
        strip(F.get(texts("$.name"), F.lit(0))).alias("name"),
        F.coalesce(F.try_element_at(texts("$.description"), F.lit(-1)), F.lit("")).alias("description"),
        F.try_element_at(prices, F.lit(-1)).alias("price"),
        F.array_distinct(F.flatten(F.transform(items, images))).alias("images"),
        specs.alias("specs"),
    )


def links(html: Column) -> Column:
    """array<struct(href, text, image_alt)> of all anchors with an address, in order."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref\s*=.*?</a>"), F.lit(0))

    def parts(a: Column) -> Column:
        opening = search(a, r"(?is)^<a\b[^>]*>", 0)
        inner = first_match(a, r"(?is)^<a\b[^>]*>(.*)</a>$", 1)
        return F.struct(
            strip(attribute(opening, "href")).alias("href"), strip(text_of(inner)).alias("text"),
            strip(attribute(F.get(tags(inner, "img"), F.lit(0)), "alt")).alias("image_alt"))

    return F.filter(F.transform(anchors, parts), lambda l: l["href"].isNotNull())


def markdown_links(text: Column) -> Column:
    """array<struct(href, text, image_alt)> of product links in markdown."""
    found = F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\(https?://[^\s\)]+\)"), F.lit(0))
    entries = F.transform(found, lambda m: F.struct(
        F.substring_index(search(m, r"\((https?://[^\s\)]+)\)$", 1), "?", 1).alias("href"),
        search(m, r"^\[([^\]]+)\]", 1).alias("text"), F.lit(None).cast("string").alias("image_alt")))
    return F.filter(entries, lambda l: contains_any(F.lower(l["href"]), ["/products/", "/product/", ".html"]))


def largest_of_srcset(srcset: Column) -> Column:
    """The widest entry of a srcset; equal widths keep the first."""
    entries = F.filter(F.transform(F.split(srcset, ","), strip), lambda e: e != "")
    keyed = F.transform(entries, lambda e, i: F.struct(
        (-F.coalesce(search(e, r"\s(\d+)w$", 1).try_cast("int"), F.lit(0))).alias("w"), i.alias("i"),
        search(e, r"^\S+", 0).alias("url")))
    return F.get(F.array_sort(keyed), F.lit(0))["url"]


def generic_images(html: Column, base: Column, first: Column) -> Column:
    """Image addresses of a page, best first: given ones, then the img tags, then og:image. No repeats."""
    # one small step at a time: what a lambda refers to twice is evaluated twice
    def sources(tag: Column) -> Column:
        best = F.coalesce(*[attribute(tag, a) for a in (
            "data-zoom-image", "data-large-img", "data-high-res", "data-master", "data-src", "src")])
        return F.array(
            F.struct(best.alias("href"), F.lit(False).alias("set")),
            F.struct(attribute(tag, "srcset").alias("href"), F.lit(True).alias("set")))

    def resolved(source: Column) -> Column:
        return F.struct(absolute(base, source["href"]).alias("url"), source["set"].alias("set"))

    found = F.filter(F.flatten(F.transform(tags(html, "img"), sources)), lambda s: s["href"].isNotNull())
    found = F.transform(found, lambda s: F.struct(
        F.when(s["set"], largest_of_srcset(s["href"])).otherwise(s["href"]).alias("href"), s["set"].alias("set")))
    found = F.filter(F.transform(found, resolved), lambda s: ~contains_any(F.lower(s["url"]), fixed.SRCSET_WORDS_DROPPED) & (
        s["set"] | ~contains_any(F.lower(s["url"]), fixed.IMAGE_WORDS_DROPPED)))
    og = F.transform(F.array(meta_content(html, "og:image")), lambda u: absolute(base, u))
    every = F.concat(F.coalesce(first, F.array().cast(_STRINGS)), F.transform(found, lambda s: s["url"]), og)
    return F.array_distinct(F.filter(every, lambda u: F.coalesce(u.startswith("http"), F.lit(False))))


def _shop_cdn(u: Column) -> Column:
    return contains_any(u, ["cdn/shop", "cdn.shopify", "media/catalog/product", "wp-content/uploads"])


def shop_images(html: Column) -> Column:
    """Gallery of a shop page: og or twitter image first, CDN pictures after, all at full width."""
    def full_width(u: Column, always: bool) -> Column:
        https = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(
            u.startswith("http://"), F.concat(F.lit("https://"), F.substring(u, 8, 1000000))).otherwise(u)
        joiner = F.when(F.contains(https, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
        widened = F.concat(https, joiner, F.lit("width=2048"))
        on_cdn = F.lit(True) if always else contains_any(https, ["cdn/shop", "cdn.shopify"])
        return (
            F.when(F.contains(https, F.lit("width=")), replace_all(https, r"width=\d+", "width=2048"))
            .when(F.contains(https, F.lit("media/catalog/product")), replace_all(https, "/cache/[a-f0-9]+/", "/"))
            .when(on_cdn, widened).otherwise(https)
        )

    poster = ["preview_images", "thumbnail", "video", "poster", "icon", "logo", "badge"]
    heads = F.filter(F.array(strip(meta_content(html, "og:image")), strip(meta_content(html, "twitter:image"))),
                     lambda u: _shop_cdn(u) & ~contains_any(F.lower(u), poster))
    gallery = F.transform(tags(html, "img"), lambda t: F.coalesce(
        *[attribute(t, a) for a in ("src", "data-src", "data-master")]))
    gallery = F.filter(gallery, lambda u: _shop_cdn(u) & ~contains_any(
        F.lower(u), poster + ["payment", "flag", "star", "review"]))
    return F.array_distinct(F.concat(
        F.transform(heads, lambda u: full_width(u, True)), F.transform(gallery, lambda u: full_width(u, False))))


def retail_images(html: Column, store: Column, first: Column) -> Column:
    """Pictures hosted by the retailer itself, after the given ones."""
    found = F.transform(tags(html, "img"), lambda t: F.coalesce(
        attribute(t, "src"), attribute(t, "data-src")))
    own = F.filter(found, lambda u: F.contains(u, store) & ~contains_any(F.lower(u), ["icon", "logo", "banner"]))
    https = F.transform(own, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u))
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast(_STRINGS)), https))


def marketplace_images(html: Column) -> Column:
    """Master picture of a marketplace listing, at 1500 px."""
    img = F.get(F.filter(tags(html, "img"), lambda t: (attribute(t, "id") == "landingImage") | attribute(
        t, "data-old-hires").isNotNull()), F.lit(0))
    sizes = F.map_entries(F.from_json(attribute(img, "data-a-dynamic-image"), "map<string,array<int>>"))
    keyed = F.transform(sizes, lambda e, i: F.struct(
        (-F.get(e["value"], F.lit(0)) * F.get(e["value"], F.lit(1))).alias("area"), i.alias("i"), e["key"].alias("url")))
    largest = F.get(F.array_sort(keyed), F.lit(0))["url"]
    every = F.array(attribute(img, "data-old-hires"), largest,
                    search(html, r'"hiRes"\s*:\s*"(https://[^"]+)"', 1))
    upgraded = F.transform(F.array_compact(every), lambda u: replace_all(u, r"\._[A-Z0-9_,]+_\.", "._SL1500_."))
    return F.array_distinct(upgraded)
