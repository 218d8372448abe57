"""Specifications out of free text, as map<string,string> columns. The first occurrence in the text wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.functions.categories import category_key
from shelfmark.functions.text import contains_any, not_empty, search, strip, with_value

TYPE_C = r"(?i)type[-\s]?c|usb[-\s]?c"


def _map_of(values: dict[str, Column]) -> Column:
    keys = F.array(*[F.lit(k) for k in values])
    return F.map_filter(F.map_from_arrays(keys, F.array(*values.values())), lambda _, v: v.isNotNull())


def _title_case(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def _joined(parts: list[tuple[Column, str]]) -> Column:
    found = F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in parts]))
    return not_empty(F.array_join(found, ", "))


def warranty(text: Column) -> Column:
    return _title_case(search(text, r"(?i)\b(\d+)\s*(?:month|year)s?\s*(?:manufacturer\s*)?warranty\b"))


def sound_specs(text: Column) -> dict[str, Column]:
    hours = search(
        text,
        r"(?i)\b(up to\s*)?(\d+(?:\.\d+)?)\s*(?:hours?|hrs?)\s*(?:of\s*)?"
        r"(?:playtime|playback|battery\s*life|music|talk\s*time|play\s*time)?\b", 2)
    driver = search(text, r"(?i)\b(\d+(?:\.\d+)?)\s*mm\s*(?:dynamic\s*)?(?:bass\s*)?drivers?\b", 1)
    version = search(text, r"(?i)\b(?:bluetooth|bt)\s*(?:v(?:ersion)?\.?\s*)?([45]\.\d)\b", 1)
    grams = search(text, r"(?i)\b(\d{1,4}(?:\.\d+)?)\s*(?:g|grams|gm)\b", 1)
    return {
        "playtime": with_value(hours, lambda h: F.when(F.floor(h.try_cast("double")) > 1, F.concat(h, F.lit(" Hours Playtime")))),
        "drivers": F.concat(driver, F.lit("mm Drivers")),
        "noise_cancellation": F.when(text.rlike(r"(?i)\b(?:quad|4)\s*mics?\s*(?:with\s*)?enc\b"), F.lit("Quad Mic ENC"))
        .when(text.rlike(r"(?i)\b(?:dual|2)\s*mics?\s*(?:with\s*)?enc\b"), F.lit("Dual Mic ENC"))
        .when(text.rlike(r"(?i)\bactive\s*noise\s*cancellation\b|\banc\b"), F.lit("Active Noise Cancellation"))
        .when(text.rlike(r"(?i)\benvironmental\s*noise\s*cancellation\b|\benc\b"),
              F.lit("Environmental Noise Cancellation")),
        "bluetooth": F.when(version.isNotNull(), F.concat(F.lit("Bluetooth v"), version))
        .when(text.rlike(r"(?i)\bbluetooth\s*(?:5|v5)\b"), F.lit("Bluetooth v5.3")),
        "ports": F.when(text.rlike(TYPE_C), F.lit("Type-C Charging")),
        "weight": with_value(grams, lambda g: F.when(g.try_cast("double") < 250, F.concat(g, F.lit("g")))),
    }


def watch_specs(text: Column) -> dict[str, Column]:
    inches = search(text, r'(?i)\b(\d+(?:\.\d+)?)\s*(?:inch|")\s*(?:hd|amoled|tft|lcd)?\s*display\b', 1)
    days = search(text, r"(?i)\b(\d+)\s*days?\s*battery\b", 1)
    return {
        "display": F.when(inches.isNotNull(), F.concat(inches, F.lit('" Display')))
        .when(text.rlike(r"(?i)\bamoled\s*display\b"), F.lit("AMOLED Display")),
        "battery": F.concat(days, F.lit(" Days Battery")),
        "calling": F.when(text.rlike(r"(?i)\bbluetooth\s*calling\b|\bbt\s*calling\b"), F.lit("Bluetooth Calling")),
        "water_resistance": F.upper(search(text, r"(?i)\b(ip67|ip68|5atm|3atm)\b", 1)),
    }


def power_specs(text: Column) -> dict[str, Column]:
    mah = search(text, rf"(?i)\b({fixed.CAPACITIES_IN_TEXT})\s*mah\b", 1)
    watts = search(text, r"(?i)\b(\d+(?:\.\d+)?\s*W(?:att)?)\b", 1)
    volts_amps = r"(?i)(\d+(?:\.\d+)?)\s*V\s*[/x,\s]\s*(\d+(?:\.\d+)?)\s*A"
    product = search(text, volts_amps, 1).try_cast("double") * search(text, volts_amps, 2).try_cast("double")
    grams = search(text, r"(?i)\b(\d{2,4}(?:\.\d+)?)\s*(?:g|grams|gm)\b", 1)
    return {
        "capacity": F.concat(F.replace(mah, F.lit(","), F.lit("")), F.lit("mAh")),
        "output": F.coalesce(
            F.concat(watts, F.lit(" Fast Charging")),
            # half-even, as in Python
            F.concat(F.bround(product, 0).cast("bigint").cast("string"), F.lit("W Output")),
        ),
        "ports": _joined([
            (text.rlike(TYPE_C), "Type-C"),
            (text.rlike(r"(?i)usb[-\s]?a|qc\s*3\.0|\busb\s*output\b"), "USB-A"),
            (text.rlike(r"(?i)micro\s*usb|\bmicro\b"), "Micro-USB"),
            (text.rlike(r"(?i)wireless|magsafe|qi2?"), "Magnetic Wireless"),
            (text.rlike(r"(?i)lightning"), "Lightning"),
        ]),
        "weight": F.concat(grams, F.lit("g")),
    }


def extract_specs(text: Column, category: Column) -> Column:
    """All specifications the category knows, found in the text."""
    key = category_key(category)
    claim = {"warranty": warranty(text)}
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.create_map().cast("map<string,string>"))
        .when(key.isin("tws", "audio"), _map_of({**claim, **sound_specs(text)}))
        .when(key == "smartwatch", _map_of({**claim, **watch_specs(text)}))
        .otherwise(_map_of({**claim, **power_specs(text)}))
    )


def extract_brochure_specs(text: Column) -> Column:
    """The looser variant used on brochure text and on powerbank pages."""
    mah = search(text, r"(\d{1,3}(?:,\d{3})*|\d+)\s*(?:mAh|mah|MAH)", 1)
    mass = strip(search(text, r"(?i)(\d+(?:\.\d+)?\s*(?:g|gm|grams|kg))\b", 1))
    return _map_of({
        "capacity": F.concat(F.replace(mah, F.lit(","), F.lit("")), F.lit(" mAh")),
        "output": strip(search(text, r"(?i)(\d+(?:\.\d+)?\s*W(?:att)?)", 1)),
        "ports": _joined([
            (text.rlike(r"(?i)type[- ]?c|usb[- ]?c"), "Type-C"),
            (text.rlike(r"(?i)usb[- ]?a"), "USB-A"),
            (text.rlike(r"(?i)micro[- ]?usb"), "Micro-USB"),
            (text.rlike(r"(?i)lightning"), "Lightning"),
            (text.rlike(r"(?i)built[- ]in\s+cable"), "Built-in Cable"),
        ]),
        "weight": with_value(mass, lambda m: F.when(~m.rlike(r"(?i)mah|w|v|a"), m)),
        "warranty": strip(search(text, r"(?i)(\d+\s*(?:Months?|Years?)\s*(?:Warranty|Guarantee)?)", 1)),
    })


def sanitise_specs(specs: Column) -> Column:
    """Keep only spec values that parse; capacity and weight are rewritten in one form."""
    def value(name: str) -> Column:
        return F.nullif(specs[name], F.lit(""))

    mah = F.coalesce(search(value("capacity"), r"(?i)\b(\d{4,6})\s*m?ah\b", 1),
                     search(value("capacity"), r"(?i)\b(\d+,\d+)\s*m?ah\b", 1))
    grams = search(value("weight"), r"(?i)\b(\d{2,4}(?:\.\d+)?)\s*g\b", 1)
    return _map_of({
        "capacity": F.concat(F.replace(mah, F.lit(","), F.lit("")), F.lit(" mAh")),
        "output": F.when(value("output").rlike(r"(?i)\b\d+(?:\.\d+)?\s*w\b"), strip(value("output"))),
        "weight": F.concat(grams, F.lit("g")),
        "ports": F.when(contains_any(F.lower(value("ports")), fixed.PORT_WORDS), strip(value("ports"))),
        "warranty": F.when(contains_any(F.lower(value("warranty")), ["month", "year", "yr"]), strip(value("warranty"))),
    })


def first_filled(left: Column, right: Column) -> Column:
    """Union of two spec maps; a filled value on the left wins."""
    merged = F.map_zip_with(left, right, lambda _, a, b: F.coalesce(F.nullif(a, F.lit("")), b))
    return F.map_filter(merged, lambda _, v: v.isNotNull())


def markdown_specs(text: Column, category: Column) -> Column:
    """Specs of a page recorded as markdown: category rules first, brochure rules fill the gaps."""
    return first_filled(extract_specs(text, category), extract_brochure_specs(text))


def markdown_title(text: Column) -> Column:
    return strip(search(text, r"(?m)^#\s+(.+)$", 1))


def markdown_price(text: Column) -> Column:
    """First plausible price: a labelled one, else one with a currency sign."""
    def amount(pattern: str) -> Column:
        number = F.replace(search(text, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
        return with_value(number, lambda n: F.when(n.between(100, 200000), n))

    return F.coalesce(
        amount(r"(?i)(?:regular\s+price|mrp|price)\s*[:\-]?\s*(?:[₹]|rs\.?|inr)?\s*([0-9,]+(?:\.[0-9]{2})?)"),
        amount(r"(?i)(?:[₹]|rs\.?|inr)\s*([0-9,]+(?:\.[0-9]{2})?)"),
    )


def markdown_images(text: Column) -> Column:
    """Image addresses in markdown image tags, then bare ones; page furniture left out."""
    tagged = F.regexp_extract_all(text, F.lit(r"!\[.*?\]\((https?://[^\s\)]+)\)"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s'\"<>]+?\.(?:jpg|jpeg|png|webp)"), F.lit(0))
    furniture = ["logo", "icon", "badge", "payment", "star", "flag", "banner"]
    return F.array_distinct(F.filter(F.concat(tagged, bare), lambda u: ~contains_any(F.lower(u), furniture)))
