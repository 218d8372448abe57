"""SQL fragments for the DuckDB twins."""

from __future__ import annotations

from shelfmark.functions import fixed
from workload.inputs import ASSETS_SQL, CATALOGUE, CATALOGUE_SQL

WITH_CATALOGUE = f"WITH catalogue AS ({CATALOGUE_SQL})"
WITH_FILES = f"{WITH_CATALOGUE}, assets AS ({ASSETS_SQL})"


def filled(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '\\S') THEN {x} END)"


def is_blank(x: str) -> str:
    return f"(NOT coalesce(regexp_matches({x}, '\\S'), false))"


def effective(field: str) -> str:
    have = [n for n in (f"Override_{field}", f"Raw_{field}", field) if n in CATALOGUE]
    return f"coalesce({', '.join([filled(n) for n in have] + ['NULL'])})"


def slug(x: str) -> str:
    return f"coalesce(trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '-'), '')"


def price(x: str) -> str:
    return f"try_cast(trim(regexp_replace(CAST({x} AS VARCHAR), '₹|MRP|,', '', 'g')) AS DOUBLE)"


def whole(x: str) -> str:
    return f"format('{{:,}}', CAST(trunc({x}) AS BIGINT))"


def money(x: str) -> str:
    return f"CASE WHEN regexp_matches(CAST({x} AS VARCHAR), '\\S') THEN coalesce({whole(price(x))}, trim(CAST({x} AS VARCHAR))) END"


def text(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def listed(values: list[str]) -> str:
    return f"CAST([{text(values)}] AS VARCHAR[])"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def search(x: str, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"(CASE WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', {group}) END)"


def replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def tokens(x: str) -> str:
    t = f"coalesce({x}, '')"
    for pattern, by in ((r"(\d+),(\d+)", r"\1\2"), (r"\+", " plus "), (r"(?i)mag\s*tag|magtag|mag\s*safe|magsafe", " magsafe "),
                        (r"([a-zA-Z]+)(\d+)", r"\1 \2"), (r"(\d+)([a-zA-Z]+)", r"\1 \2")):
        t = replace(t, pattern, by)
    twin = "CASE w WHEN '10' THEN '10000' WHEN '10000' THEN '10' WHEN '20' THEN '20000' WHEN '20000' THEN '20' ELSE w END"
    words = f"regexp_extract_all(lower({t}), '[a-z0-9]+')"
    return f"list_sort(list_distinct(list_concat({words}, list_transform({words}, lambda w: {twin}))))"


def minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def subset(a: str, b: str) -> str:
    return f"list_has_all({b}, {a})"


def portion(x: str, brand: str | None = None) -> str:
    t = f"coalesce({x}, '')"
    if brand:
        t = f"regexp_replace({t}, '(?i)^\\Q' || {brand} || '\\E(?:one|\\s+one|-one)?\\s*', '')"
    t = f"trim({replace(t, '(?i)' + fixed.LEADING_FIGURES)})"
    t = f"coalesce(nullif(trim({search(t, '(?s)^(.*?)' + chr(92) + 's+[-|–—/]' + chr(92) + 's+', 1)}), ''), {t})"
    return f"coalesce(nullif(trim({search(t, '(?is)^(.*?)' + fixed.NAME_STOP, 1)}), ''), {t})"


def quantities(x: str) -> tuple[str, str]:
    t = f"lower({replace(f'coalesce({x}, chr(32))', '([0-9]),([0-9])', chr(92) + '1' + chr(92) + '2')})"

    def figures(pattern: str) -> str:
        return f"CAST(regexp_extract_all({t}, '{pattern}', 1) AS DOUBLE[])"

    thousands = "list_transform(" + figures(r"\b(\d+(?:\.\d+)?)\s*k\b") + ", lambda v: v * 1000)"
    mah = f"list_distinct(list_concat({figures(chr(40) + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?)' + chr(92) + 's*mah' + chr(92) + 'b')}, {thousands}))"
    return mah, "list_distinct(" + figures(r"\b(\d+(?:\.\d+)?)\s*w\b") + ")"


def category_key(x: str) -> str:
    low = f"lower(trim({x}))"
    arms = " ".join(f"WHEN {any_of(low, words)} THEN '{key}'" for key, words in fixed.CATEGORY_KEYWORDS)
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'powerbank' {arms} ELSE 'generic' END"


def by_key(key: str, values: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"CASE {key} {arms} END"
