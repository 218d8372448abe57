"""Text and price columns: blanks, slugs, prices, names, markup."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

SPACES = " \t\n\r\x0b\x0c"


def words_pattern(words: list[str]) -> str:
    return "|".join(words)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """The text itself, or null when it is null or only white space."""
    return F.when(c.rlike(r"\S"), c)


def filled_number(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"\S"), F.lit(True))


def finite(c: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def finite_array(c: Column) -> Column:
    return F.transform(c, finite)


def finite_nested(c: Column, kind: DataType) -> Column:
    """NaN and the infinities become null at any depth of structs, arrays and map values; keys of maps stay as they are."""
    if isinstance(kind, (DoubleType, FloatType)):
        return finite(c)
    if not _holds_fractions(kind):
        return c
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: finite_nested(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: finite_nested(v, kind.valueType))
    return F.when(c.isNotNull(), F.struct(*[finite_nested(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))


def _holds_fractions(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_fractions(kind.elementType)
    if isinstance(kind, MapType):
        return _holds_fractions(kind.valueType)
    if isinstance(kind, StructType):
        return any(_holds_fractions(f.dataType) for f in kind.fields)
    return isinstance(kind, (DoubleType, FloatType))


def without_nonfinite(df: DataFrame) -> DataFrame:
    """All columns of a table with finite numbers only, however deep they lie."""
    return df.select(*[finite_nested(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row however often it is used.

    A step that names its input several times works it out as often; steps upon steps multiply that.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def not_empty(c: Column) -> Column:
    """The text, or null when it is empty; unlike nullif, it works the text out once."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def search(c: Column, pattern: str | Column, group: int = 0) -> Column:
    """First match of the pattern, or null when there is none or the group is empty."""
    return not_empty(first_match(c, pattern, group))


def first_match(c: Column, pattern: str | Column, group: int = 0) -> Column:
    """First match of the pattern, or the empty text when there is none."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.call_function("regexp_extract", c, pattern, F.lit(group))


def matches(c: Column, pattern: str | Column) -> Column:
    return F.call_function("rlike", c, F.lit(pattern) if isinstance(pattern, str) else pattern)


def quoted(c: Column) -> Column:
    """A column's text as a literal inside a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def replace_all(c: Column, pattern: str | Column, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(by))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def string_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def slugify(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-")
    return F.coalesce(F.btrim(dashed, F.lit("-")), F.lit(""))


def parse_price(c: Column) -> Column:
    """A price written with a currency sign, the word MRP or thousands commas; null when it is no number."""
    return strip(replace_all(c.cast("string"), "₹|MRP|,")).try_cast("double")


def format_price(c: Column) -> Column:
    """Whole currency units with thousands commas; text that is no price passes through."""
    text = c.cast("string")
    whole = F.format_number(parse_price(c).try_cast("bigint"), 0)
    return F.when(text.rlike(r"\S"), F.coalesce(whole, strip(text)))


def strip_brand_prefix(name: Column, brand: Column) -> Column:
    """Drop a leading brand word; a name that is only the brand stays as it is."""
    plain = strip(F.coalesce(name, F.lit("")))
    cut = strip(replace_all(plain, F.concat(F.lit("(?i)^"), quoted(brand), F.lit(r"\s+"))))
    return F.when(is_blank(brand) | (cut == ""), plain).otherwise(cut)


def clean_display_name(name: Column, brand: Column) -> Column:
    """The short card name: no brand, stock codes, category words, capacity, wattage or colour."""
    text = strip(name)
    branded = strip(replace_all(text, F.concat(F.lit("(?i)^"), quoted(brand), F.lit(r"\s*"))))
    text = F.when(F.coalesce(brand, F.lit("")) == "", text).otherwise(branded)
    for pattern in (
        r"(?i)\b(?:UPR|UPC|POR|PB|SC|PEB)[\w-]*\b",
        r"(?i)\s+(?:power\s*bank|powerbank|charger)\b",
        r"(?i)\s*\b(?:\d+(?:,\d+)?\s*mah|\d+k\b|\d+(?:\.\d+)?\s*w\b)\b",
        r"(?i)\s+(?:black|white|blue|grey|gray|green|pink|mocha|camo|silver)\b",
    ):
        text = strip(replace_all(text, pattern))
    return F.when(is_blank(name), F.lit("")).when(text == "", name).otherwise(text)


def name_markup(c: Column) -> Column:
    """Lower case; the last of several words is emphasised."""
    words = F.filter(F.split(F.lower(strip(c)), r"\s+"), lambda w: w != "")
    head = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    accented = F.concat(head, F.lit(" <em>"), F.element_at(words, -1), F.lit("</em>"))
    return F.when(F.size(words) < 2, F.lower(strip(c))).otherwise(accented)


def subtitle_markup(c: Column) -> Column:
    """Emphasise the first figure with a unit."""
    pattern = r"(?is)^(.*?)\b(\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:mAh|W|V|A))\b"
    return F.coalesce(F.regexp_replace(c, pattern, '$1<b class="spec">$2</b>'), F.lit(""))
