"""Product names: token sets, the leading model segment, figures, identity words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.functions.text import (
    first_match, matches, quoted, replace_all, search, string_array, strip, strip_brand_prefix,
)


def model_tokens(c: Column) -> Column:
    """The set of comparable words of a name, as a duplicate-free array."""
    text = F.coalesce(c, F.lit(""))
    text = replace_all(text, r"(\d+),(\d+)", "$1$2")
    text = replace_all(text, r"\+", " plus ")
    text = replace_all(text, r"(?i)mag\s*tag|magtag|mag\s*safe|magsafe", " magsafe ")
    text = replace_all(text, r"([a-zA-Z]+)(\d+)", "$1 $2")
    text = replace_all(text, r"(\d+)([a-zA-Z]+)", "$1 $2")
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return _with_thousands(words)


def _with_thousands(words: Column) -> Column:
    """10 and 10000 name the same capacity, as do 20 and 20000; the result has no duplicates."""
    expanded = F.transform(
        words,
        lambda w: F.when(w == "10", F.array(w, F.lit("10000"))).when(w == "10000", F.array(w, F.lit("10")))
        .when(w == "20", F.array(w, F.lit("20000"))).when(w == "20000", F.array(w, F.lit("20")))
        .otherwise(F.array(w)),
    )
    return F.array_distinct(F.flatten(expanded))


def compact(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))


def model_portion(title: Column, brand: Column | None = None) -> Column:
    """The part of a title that names the model: brand and leading figures off, cut at the first description."""
    text = F.coalesce(title, F.lit(""))
    if brand is not None:
        owner = F.coalesce(brand, F.lit(""))
        branded = replace_all(text, F.concat(F.lit("(?i)^"), quoted(owner), F.lit(r"(?:one|\s+one|-one)?\s*")))
        text = F.when(owner == "", text).otherwise(branded)
    text = strip(replace_all(text, "(?i)" + fixed.LEADING_FIGURES))
    # a text that starts with white space would have no lead, but it is stripped; one that starts with a description is kept
    text = replace_all(text, r"(?s)^(.*?)\s+[-|–—/]\s+.*$", "$1")
    return strip(replace_all(text, f"(?is)^(?!{fixed.NAME_STOP})(.+?){fixed.NAME_STOP}.*$", "$1"))


def candidate_display_name(title: Column, brand: Column) -> Column:
    """A short human name for a listing, used when several listings could be meant."""
    branded = strip(replace_all(title, F.concat(F.lit("(?i)^"), quoted(brand), F.lit(r"\s*"))))
    text = F.when(F.coalesce(brand, F.lit("")) == "", title).otherwise(branded)
    text = strip(replace_all(text, r"(?i)^(?:new\s+launch\s+|all\s+new\s+)"))
    for stop in (fixed.DISPLAY_STOP, r"\s+[-|–—/]\s+"):
        text = F.when(matches(text, "(?i)" + stop), strip(first_match(text, "(?is)^(.*?)" + stop, 1))).otherwise(text)
    text = strip(replace_all(text, r"[,\.\-–—\s]+$"))
    return F.when(F.length(text) >= 2, text).otherwise(title)


def spec_quantities(c: Column) -> tuple[Column, Column]:
    """(mAh figures, W figures) stated in a text; 10K counts as 10000 mAh."""
    text = F.lower(replace_all(F.coalesce(c, F.lit("")), r"(\d),(\d)", "$1$2"))

    def figures(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).cast("array<double>")

    thousands = F.transform(figures(r"\b(\d+(?:\.\d+)?)\s*k\b"), lambda x: x * 1000)
    mah = F.array_union(figures(r"(\d+(?:\.\d+)?)\s*mah\b"), thousands)
    return mah, F.array_distinct(figures(r"\b(\d+(?:\.\d+)?)\s*w\b"))


def identity_tokens(model: Column, brand: Column) -> Column:
    """The words of a model name that tell it apart from its siblings."""
    text = F.lower(strip_brand_prefix(model, brand))
    text = replace_all(text, r"\b\d+(?:,\d+)?\s*mah\b|\b\d+k\b|\b\d+(?:\.\d+)?\s*w\b", " ")
    words = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(words, string_array(fixed.DISPLAY_DROPPABLE))


def plain_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def any_whole_word(words: list[str]) -> str:
    return r"\b(?:" + "|".join(w.replace("-", r"\-") for w in words) + r")\b"
