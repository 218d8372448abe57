"""Product categories: the key a free-text category stands for, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.functions.text import contains_any, string_array, strip


def category_key(category: Column) -> Column:
    """Keyword ladder; a missing category means powerbank, an unknown one generic."""
    text = F.lower(strip(category))
    ladder = F.when(category.isNull() | (category == ""), F.lit("powerbank"))
    for key, keywords in fixed.CATEGORY_KEYWORDS:
        ladder = ladder.when(contains_any(text, keywords), F.lit(key))
    return ladder.otherwise(F.lit("generic"))


def by_key(key: Column, values: dict[str, Column]) -> Column:
    ladder = F
    for name, value in values.items():
        ladder = ladder.when(key == name, value)
    return ladder


def descriptors(key: Column) -> Column:
    return by_key(key, {k: string_array(v) for k, v in fixed.CATEGORY_DESCRIPTORS.items()})


def primary_specs(key: Column) -> Column:
    return by_key(key, {k: string_array(v) for k, v in fixed.PRIMARY_SPECS.items()})


def min_specs(key: Column) -> Column:
    return by_key(key, {k: F.lit(v) for k, v in fixed.MIN_SPECS.items()})


def category_prefix(category: Column) -> Column:
    """Product-ID prefix: a fixed table, else the first three letters or digits, else PRD."""
    text = strip(F.when(category != "", category).otherwise(F.lit("Powerbank")))
    table = F.create_map(*[F.lit(x) for pair in fixed.CATEGORY_PREFIXES.items() for x in pair])
    letters = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    short = F.upper(F.substring(letters, 1, 3))
    return F.coalesce(table[F.upper(text)], F.nullif(short, F.lit("")), F.lit("PRD"))


def spec_columns(key: Column, specs: Column) -> dict[str, Column]:
    """Which extracted spec is written to which of the four shared columns, as (value, spec name) pairs."""
    def first_of(*names: str) -> Column:
        options = [F.when(F.coalesce(specs[n], F.lit("")) != "", F.struct(specs[n].alias("value"), F.lit(n).alias("spec")))
                   for n in names]
        return F.coalesce(*options)

    sound = {"Spec_Capacity": ("playtime", "capacity"), "Spec_Output": ("drivers", "output"),
             "Spec_Ports": ("noise_cancellation", "ports"), "Spec_Weight": ("bluetooth", "weight")}
    watch = {"Spec_Capacity": ("display",), "Spec_Output": ("battery",),
             "Spec_Ports": ("calling",), "Spec_Weight": ("water_resistance",)}
    plain = {"Spec_Capacity": ("capacity",), "Spec_Output": ("output",),
             "Spec_Ports": ("ports",), "Spec_Weight": ("weight",)}
    return {
        column: F.when(key.isin("tws", "audio"), first_of(*sound[column]))
        .when(key == "smartwatch", first_of(*watch[column]))
        .otherwise(first_of(*plain[column]))
        for column in plain
    }
