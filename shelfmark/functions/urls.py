"""URL columns: normal forms, slugs, hosts, image addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import contains_any, replace_all, strip


def url_key(url: Column) -> Column:
    """Normal form under which two addresses count as the same page."""
    return F.lower(F.rtrim(strip(url), F.lit("/")))


def golden_url(url: Column) -> Column:
    """Normal form for the baseline diff: no query, no trailing slash, no www."""
    plain = F.rtrim(F.substring_index(url, "?", 1), F.lit("/"))
    return F.when(url != "", F.replace(plain, F.lit("www."), F.lit("")))


def last_segment(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "/", -1), "?", 1)


def slug_words(url: Column) -> Column:
    """Last path segment as words."""
    return F.replace(last_segment(url), F.lit("-"), F.lit(" "))


def host(url: Column) -> Column:
    return F.lower(F.replace(F.try_parse_url(url, F.lit("HOST")), F.lit("www."), F.lit("")))


def absolute(base: Column, href: Column) -> Column:
    """Resolve a link against the page it is on."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(page, r"^(.*/)", 1))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )


def upgrade_image_url(url: Column) -> Column:
    """Ask an image host for its largest version."""
    joiner = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return (
        F.when(
            contains_any(url, ["cdn/shop", "cdn.shopify"]),
            F.when(F.contains(url, F.lit("width=")), replace_all(url, r"width=\d+", "width=2048"))
            .otherwise(F.concat(url, joiner, F.lit("width=2048"))),
        )
        .when(contains_any(url, ["media-amazon.com", "images-amazon.com"]),
              replace_all(url, r"\._[A-Z0-9_,]+_\.", "._SL1500_."))
        .when(F.contains(url, F.lit("media/catalog/product")), replace_all(url, "/cache/[a-f0-9]+/", "/"))
        .otherwise(url)
    )


def image_rank(url: Column) -> Column:
    """Isolated packshots first, banners last."""
    low = F.lower(url)
    return (
        F.when(contains_any(low, ["dome", "hero", "packshot"]), F.lit(0))
        .when(contains_any(low, ["-01", "_01", "white"]), F.lit(1))
        .when(contains_any(low, ["banner", "infographic", "lifestyle"]), F.lit(9))
        .otherwise(F.lit(5))
    )


def ranked_images(urls: Column) -> Column:
    """An image list in packshot order; equal ranks keep their order."""
    keyed = F.transform(urls, lambda u, i: F.struct(image_rank(u).alias("rank"), i.alias("pos"), u.alias("url")))
    return F.transform(F.array_sort(keyed), lambda s: s["url"])


def site_of(url: Column, platform: Column) -> Column:
    """Which page layout applies: known retailers by address, else the store's platform."""
    low = F.lower(url)
    return (
        F.when(contains_any(low, ["amazon.in", "amazon.com"]), F.lit("amazon"))
        .when(F.contains(low, F.lit("croma.com")), F.lit("croma"))
        .when(F.contains(low, F.lit("reliancedigital.in")), F.lit("reliance"))
        .when(F.contains(low, F.lit("tatacliq.com")), F.lit("tatacliq"))
        .when(platform.isNull() | (platform == "shopify"), F.lit("shopify"))
        .otherwise(F.lit("generic"))
    )


def slug_title(url: Column, store: str) -> Column:
    """A readable title rebuilt from a retail address."""
    if store == "croma":
        slug = F.substring_index(F.substring_index(url, "/p/", 1), "/", -1)
        noise = "online|croma|buy|best price|prices|fast charging|power bank|powerbank"
        known = F.contains(url, F.lit("/p/"))
    else:
        slug = F.substring_index(F.substring_index(url, "/product/", -1), "?", 1)
        noise = "online|reliance|digital|buy|best price|prices|fast charging|power bank|powerbank"
        known = F.contains(url, F.lit("/product/"))
    words = replace_all(F.replace(slug, F.lit("-"), F.lit(" ")), rf"(?i)\b({noise})\b")
    kept = F.slice(F.filter(F.split(words, r"\s+"), lambda w: w != ""), 1, 4)
    title = F.array_join(F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000000)))), " ")
    return F.when(known, title).otherwise(F.lit(""))
