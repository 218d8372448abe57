"""Specifications and copy out of text, validation and the status machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.functions.copywriting import BANNED, DANGLING, boilerplate_phrase, normalise_copy, normalise_copy_row
from shelfmark.functions.specs import (
    extract_brochure_specs, extract_specs, markdown_images, markdown_price, markdown_specs, markdown_title, sanitise_specs,
)
from shelfmark.functions.names import model_tokens
from shelfmark.operators import resolve, status, validation
from shelfmark.operators.brochures import with_section
from workload import duck, inputs
from workload.catalogue_queries import IMAGE_PATH
from workload.duck import WITH_CATALOGUE, WITH_FILES, effective, filled as sql_filled, is_blank, search
from workload.registry import Tables, query

_SIZE, _KILO = "CAST(p_size AS STRING)", "CAST(p_size * 1000 AS STRING)"
POWER_TEXT = (f"CASE p_partkey % 6 WHEN 0 THEN p_name || ' ' || {_KILO} || 'mAh ' || {_SIZE} || 'W type-c ' || CAST(p_size * 7 AS STRING) || 'g' "
              f"WHEN 1 THEN p_name || ' 10,000 mAh, 5V/' || {_SIZE} || '.5A, USB A and micro usb, ' || {_SIZE} || ' months warranty' "
              f"WHEN 2 THEN p_name || ' 20,000MAH Qi2 wireless lightning QC 3.0, 1 year manufacturer warranty, weight 210.5 grams' "
              f"WHEN 3 THEN p_name || ' 27000 mah ' || {_SIZE} || ' Watt output, built-in cable, 0.5 kg, 2 Years Guarantee' "
              f"WHEN 4 THEN p_name || ' 12V x ' || {_SIZE} || 'A' ELSE p_name END")
SOUND_TEXT = (f"CASE p_partkey % 6 WHEN 0 THEN p_name || ' up to ' || {_SIZE} || ' hours of playtime, Quad Mic ENC, 13mm dynamic drivers, Bluetooth v5.3 and Type-C' "
              f"WHEN 1 THEN p_name || ' ' || {_SIZE} || 'hrs playback, 2 mics with ENC, BT version 4.2, ' || CAST(p_size * 10 AS STRING) || ' g' "
              "WHEN 2 THEN p_name || ' active noise cancellation, bluetooth 5, 10.5 mm bass driver' WHEN 3 THEN p_name || ' environmental noise cancellation 1 hour' "
              "WHEN 4 THEN p_name || ' ENC usb-c 6 months warranty' ELSE p_name END")
WATCH_TEXT = (f"CASE p_partkey % 5 WHEN 0 THEN p_name || ' 1.91 Inch HD Display, BT Calling, ' || {_SIZE} || ' Days Battery Life, IP68' WHEN 1 THEN p_name || ' AMOLED display, bluetooth calling, 5atm' "
              f"WHEN 2 THEN p_name || ' 2\" amoled display, 1 day battery, ip67' WHEN 3 THEN p_name || ' 12months warranty' ELSE p_name END")
TEXTS = {"id": "p_partkey", "power": POWER_TEXT, "sound": SOUND_TEXT, "watch": WATCH_TEXT}
WITH_TEXTS = f"WITH t AS (SELECT {inputs.select(TEXTS)} FROM part)"


def title_case(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def warranty(x: str) -> str:
    found = search(x, r"(?i)\b(\d+)\s*(?:month|year)s?\s*(?:manufacturer\s*)?warranty\b")
    return f"CASE WHEN {found} IS NOT NULL THEN {title_case(found)} END"


def ports(x: str, detectors: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{label}' END" for p, label in detectors)
    return f"nullif(array_to_string(list_filter([{parts}], lambda p: p IS NOT NULL), ', '), '')"


VOLT_AMP = r"(?i)(\d+(?:\.\d+)?)\s*V\s*[/x,\s]\s*(\d+(?:\.\d+)?)\s*A"
POWER_SQL = f"""SELECT id, replace({search('power', rf'(?i)\b({fixed.CAPACITIES_IN_TEXT})\s*mah\b', 1)}, ',', '') || 'mAh' AS capacity,
    coalesce({search('power', r'(?i)\b(\d+(?:\.\d+)?\s*W(?:att)?)\b', 1)} || ' Fast Charging',
      CAST(CAST(round_even(try_cast({search('power', VOLT_AMP, 1)} AS DOUBLE) * try_cast({search('power', VOLT_AMP, 2)} AS DOUBLE), 0) AS BIGINT) AS VARCHAR) || 'W Output') AS output,
    {ports('power', [(r'(?i)type[-\s]?c|usb[-\s]?c', 'Type-C'), (r'(?i)usb[-\s]?a|qc\s*3\.0|\busb\s*output\b', 'USB-A'), (r'(?i)micro\s*usb|\bmicro\b', 'Micro-USB'), (r'(?i)wireless|magsafe|qi2?', 'Magnetic Wireless'), (r'(?i)lightning', 'Lightning')])} AS ports,
    {search('power', r'(?i)\b(\d{2,4}(?:\.\d+)?)\s*(?:g|grams|gm)\b', 1)} || 'g' AS weight, {warranty('power')} AS warranty FROM t"""


def spec_columns(specs, names):
    return [specs[n].alias(n) for n in names]


@query("spec_extract_powerbank", f"{WITH_TEXTS} {POWER_SQL}")
def spec_extract_powerbank(t: Tables):
    df = inputs.derive(t.part, TEXTS).withColumn("s", extract_specs(F.col("power"), F.lit("Powerbank")))
    return df.select("id", *spec_columns(F.col("s"), ["capacity", "output", "ports", "weight", "warranty"]))


HOURS = search("sound", r"(?i)\b(up to\s*)?(\d+(?:\.\d+)?)\s*(?:hours?|hrs?)\s*(?:of\s*)?(?:playtime|playback|battery\s*life|music|talk\s*time|play\s*time)?\b", 2)
GRAMS = search("sound", r"(?i)\b(\d{1,4}(?:\.\d+)?)\s*(?:g|grams|gm)\b", 1)
VERSION = search("sound", r"(?i)\b(?:bluetooth|bt)\s*(?:v(?:ersion)?\.?\s*)?([45]\.\d)\b", 1)


@query("spec_extract_audio", rf"""{WITH_TEXTS} SELECT id, CASE WHEN floor(try_cast({HOURS} AS DOUBLE)) > 1 THEN {HOURS} || ' Hours Playtime' END AS playtime,
    {search('sound', r'(?i)\b(\d+(?:\.\d+)?)\s*mm\s*(?:dynamic\s*)?(?:bass\s*)?drivers?\b', 1)} || 'mm Drivers' AS drivers,
    CASE WHEN regexp_matches(sound, '(?i)\b(?:quad|4)\s*mics?\s*(?:with\s*)?enc\b') THEN 'Quad Mic ENC' WHEN regexp_matches(sound, '(?i)\b(?:dual|2)\s*mics?\s*(?:with\s*)?enc\b') THEN 'Dual Mic ENC'
      WHEN regexp_matches(sound, '(?i)\bactive\s*noise\s*cancellation\b|\banc\b') THEN 'Active Noise Cancellation' WHEN regexp_matches(sound, '(?i)\benvironmental\s*noise\s*cancellation\b|\benc\b') THEN 'Environmental Noise Cancellation' END AS noise_cancellation,
    CASE WHEN {VERSION} IS NOT NULL THEN 'Bluetooth v' || {VERSION} WHEN regexp_matches(sound, '(?i)\bbluetooth\s*(?:5|v5)\b') THEN 'Bluetooth v5.3' END AS bluetooth,
    CASE WHEN regexp_matches(sound, '(?i)type[-\s]?c|usb[-\s]?c') THEN 'Type-C Charging' END AS ports, CASE WHEN try_cast({GRAMS} AS DOUBLE) < 250 THEN {GRAMS} || 'g' END AS weight, {warranty('sound')} AS warranty FROM t""")
def spec_extract_audio(t: Tables):
    df = inputs.derive(t.part, TEXTS).withColumn("s", extract_specs(F.col("sound"), F.lit("TWS")))
    return df.select("id", *spec_columns(F.col("s"), ["playtime", "drivers", "noise_cancellation", "bluetooth", "ports", "weight", "warranty"]))


INCHES = search("watch", r'(?i)\b(\d+(?:\.\d+)?)\s*(?:inch|")\s*(?:hd|amoled|tft|lcd)?\s*display\b', 1)


@query("spec_extract_watch", rf"""{WITH_TEXTS} SELECT id, CASE WHEN {INCHES} IS NOT NULL THEN {INCHES} || '" Display' WHEN regexp_matches(watch, '(?i)\bamoled\s*display\b') THEN 'AMOLED Display' END AS display,
    {search('watch', r'(?i)\b(\d+)\s*days?\s*battery\b', 1)} || ' Days Battery' AS battery, CASE WHEN regexp_matches(watch, '(?i)\b(bluetooth|bt)\s*calling\b') THEN 'Bluetooth Calling' END AS calling,
    upper({search('watch', r'(?i)\b(ip67|ip68|5atm|3atm)\b', 1)}) AS water_resistance, {warranty('watch')} AS warranty FROM t""")
def spec_extract_watch(t: Tables):
    df = inputs.derive(t.part, TEXTS).withColumn("s", extract_specs(F.col("watch"), F.lit("Smartwatch")))
    return df.select("id", *spec_columns(F.col("s"), ["display", "battery", "calling", "water_resistance", "warranty"]))


MASS = search("power", r"(?i)(\d+(?:\.\d+)?\s*(?:g|gm|grams|kg))\b", 1)
BROCHURE = {
    "capacity": f"replace({search('power', r'([0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)\s*(?:mAh|mah|MAH)', 1)}, ',', '') || ' mAh'",
    "output": f"trim({search('power', r'(?i)(\d+(?:\.\d+)?\s*W(?:att)?)', 1)})",
    "ports": ports("power", [("(?i)type[- ]?c|usb[- ]?c", "Type-C"), ("(?i)usb[- ]?a", "USB-A"), ("(?i)micro[- ]?usb", "Micro-USB"), ("(?i)lightning", "Lightning"), (r"(?i)built[- ]in\s+cable", "Built-in Cable")]),
    "weight": f"CASE WHEN NOT regexp_matches({MASS}, '(?i)mah|w|v|a') THEN {MASS} END",
    "warranty": f"trim({search('power', r'(?i)(\d+\s*(?:Months?|Years?)\s*(?:Warranty|Guarantee)?)', 1)})",
}


@query("brochure_specs", f"{WITH_TEXTS} SELECT id, {inputs.select(BROCHURE)} FROM t")
def brochure_specs(t: Tables):
    df = inputs.derive(t.part, TEXTS).withColumn("s", extract_brochure_specs(F.col("power")))
    return df.select("id", *spec_columns(F.col("s"), list(BROCHURE)))


SUPPLIED = {"id": "p_partkey", "capacity": f"CASE p_partkey % 4 WHEN 0 THEN {_KILO} || ' mAh' WHEN 1 THEN '10,000 mAh' WHEN 2 THEN 'large' ELSE NULL END", "output": f"CASE p_partkey % 3 WHEN 0 THEN {_SIZE} || 'W max ' WHEN 1 THEN 'fast' ELSE NULL END",
            "weight": f"CASE p_partkey % 3 WHEN 0 THEN {_SIZE} || '0 g' WHEN 1 THEN 'light' ELSE '5g' END", "ports": "CASE p_partkey % 3 WHEN 0 THEN ' USB C x2' WHEN 1 THEN 'two' ELSE NULL END", "warranty": "CASE p_partkey % 3 WHEN 0 THEN '2 yr' WHEN 1 THEN 'long' ELSE NULL END"}


@query("sanitised_specs", rf"""WITH t AS (SELECT {inputs.select(SUPPLIED)} FROM part) SELECT id,
    replace(coalesce({search('capacity', r'(?i)\b(\d{4,6})\s*m?ah\b', 1)}, {search('capacity', r'(?i)\b(\d+,\d+)\s*m?ah\b', 1)}), ',', '') || ' mAh' AS capacity,
    CASE WHEN regexp_matches(output, '(?i)\b\d+(?:\.\d+)?\s*w\b') THEN trim(output) END AS output, {search('weight', r'(?i)\b(\d{2,4}(?:\.\d+)?)\s*g\b', 1)} || 'g' AS weight,
    CASE WHEN {duck.any_of('lower(ports)', fixed.PORT_WORDS)} THEN trim(ports) END AS ports, CASE WHEN {duck.any_of('lower(warranty)', ['month', 'year', 'yr'])} THEN trim(warranty) END AS warranty FROM t""")
def sanitised_specs(t: Tables):
    names = ["capacity", "output", "weight", "ports", "warranty"]
    df = inputs.derive(t.part, SUPPLIED)
    given = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))
    return df.select("id", sanitise_specs(given).alias("s")).select("id", *spec_columns(F.col("s"), names))


@query("spec_completeness", f"""{WITH_TEXTS}, s AS ({POWER_SQL}), m AS (SELECT id, list_filter([CASE WHEN {is_blank('capacity')} THEN 'capacity' END, CASE WHEN {is_blank('output')} THEN 'output' END,
    CASE WHEN {is_blank('ports')} THEN 'ports' END, CASE WHEN {is_blank('weight')} THEN 'weight' END], lambda x: x IS NOT NULL) AS missing FROM s) SELECT id, array_to_string(missing, ',') AS missing_specs, CAST(len(missing) AS INT) AS n_missing FROM m""")
def spec_completeness(t: Tables):
    df = inputs.derive(t.part, TEXTS).select("id", F.lit("Powerbank").alias("category"), extract_specs(F.col("power"), F.lit("Powerbank")).alias("specs"))
    return validation.spec_completeness(df).select("id", F.array_join("missing_specs", ",").alias("missing_specs"), "n_missing")


MARKDOWN = {"id": "p_partkey", "text": f"'intro' || chr(10) || '#  ' || p_name || chr(10) || {POWER_TEXT} || CASE p_partkey % 4 WHEN 0 THEN ' Price: Rs. 1,' || lpad({_SIZE}, 3, '0') || '.50' WHEN 1 THEN ' INR 50' WHEN 2 THEN ' mrp 99' || chr(10) || 'for ₹' || {_SIZE} || '00' ELSE '' END || "
            f"chr(10) || '![a](https://cdn.x/' || {_SIZE} || '.png) ![logo](https://cdn.x/logo.png) https://cdn.x/b.JPG'"}


def amount(pattern: str) -> str:
    number = f"try_cast(replace({search('text', pattern, 1)}, ',', '') AS DOUBLE)"
    return f"CASE WHEN {number} BETWEEN 100 AND 200000 THEN {number} END"


FURNITURE = ["logo", "icon", "badge", "payment", "star", "flag", "banner"]


@query("markdown_pages", rf"""WITH t AS (SELECT {inputs.select(MARKDOWN)} FROM part) SELECT id, trim({search('text', r'(?m)^#\s+(.+)$', 1)}) AS title,
    coalesce({amount(r'(?i)(?:regular\s+price|mrp|price)\s*[:\-]?\s*(?:[₹]|rs\.?|inr)?\s*([0-9,]+(?:\.[0-9]{2})?)')}, {amount(r'(?i)(?:[₹]|rs\.?|inr)\s*([0-9,]+(?:\.[0-9]{2})?)')}) AS price,
    array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(text, '!\[.*?\]\((https?://[^\s\)]+)\)', 1), regexp_extract_all(text, '(?i)https?://[^\s''"<>]+?\.(?:jpg|jpeg|png|webp)')), lambda u: NOT {duck.any_of('lower(u)', FURNITURE)}))), ' ') AS images,
    coalesce(replace({search('text', rf'(?i)\b({fixed.CAPACITIES_IN_TEXT})\s*mah\b', 1)}, ',', '') || 'mAh', {BROCHURE['capacity'].replace('power', 'text')}) AS capacity FROM t""")
def markdown_pages(t: Tables):
    text = F.col("text")
    df = inputs.derive(t.part, MARKDOWN)
    return df.select("id", markdown_title(text).alias("title"), markdown_price(text).alias("price"), F.array_join(F.array_sort(markdown_images(text)), " ").alias("images"),
                     markdown_specs(text, F.lit("Powerbank"))["capacity"].alias("capacity"))


# --- copy ---------------------------------------------------------------------------------------------


@query("boilerplate_flags", f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'Empty text' ELSE list_filter({duck.listed(fixed.BOILERPLATE)}, lambda p: contains(lower(text), p))[1] END AS phrase FROM documents""")
def boilerplate_flags(t: Tables):
    return t.documents.select("doc_id", boilerplate_phrase(F.col("text")).alias("phrase"))


def clean_copy_sql(text: str, brand: str | None, max_chars: int) -> str:
    space = r"'[\s\x0b]+'"
    x = f"trim(coalesce({text}, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    if brand:
        x = f"regexp_replace({x}, '(?i)\\b\\Q' || {brand} || '\\E\\b', '', 'g')"
    x = duck.replace(x, BANNED + r"\s*")
    x = f"trim(regexp_replace({x}, {space}, ' ', 'g'))"
    x = f"trim(regexp_replace({x}, '^[-–—:,.\\s]+', ''))"
    return x


def normalised_sql(source: str, max_chars: int, min_chars: int) -> str:
    return f""", c1 AS (SELECT *, CASE WHEN regexp_matches(c0, '{BANNED}') THEN '' ELSE rtrim(upper(c0[1]) || c0[2:], '. ,;:-') END AS c1 FROM ({source})),
    c2 AS (SELECT *, CASE WHEN length(c1) > {max_chars - 1} THEN rtrim(regexp_replace(c1[:{max_chars - 1}], ' [^ ]*$', ''), '. ,;:-') ELSE c1 END AS c2 FROM c1),
    c3 AS (SELECT *, rtrim(regexp_replace(c2, '{DANGLING}', ''), '. ,;:-') AS c3 FROM c2),
    c4 AS (SELECT *, CASE WHEN c3 = '' THEN '' ELSE rtrim(c3, '. ') || '.' END AS c4 FROM c3)"""


@query("normalised_copy", f"""WITH d AS (SELECT doc_id, {clean_copy_sql('text', None, 60)} AS c0 FROM documents) {normalised_sql('SELECT * FROM d', 60, 20)}
    SELECT doc_id, c4 AS text, length(c4) BETWEEN 20 AND 60 AS ok FROM c4""")
def normalised_copy(t: Tables):
    return t.documents.select("doc_id", normalise_copy(F.col("text"), F.lit(""), 60, 20).alias("c")).select("doc_id", "c.*")


COPY = {"id": "p_partkey", "brand": "p_brand", "title": "p_brand || '  ' || p_name || ' the long and winding title of a product that never ends'",
        "subtitle": f"CASE p_partkey % 4 WHEN 0 THEN 'The best premium ' || p_name || ' with ' || {_SIZE} || 'W' WHEN 1 THEN '' WHEN 2 THEN p_brand || ': ' || p_name || ' made for people who travel far and often with the best of' ELSE 'amazing' END",
        "bullet_1": f"CASE p_partkey % 3 WHEN 0 THEN {_KILO} || 'mAh capacity for up to' WHEN 1 THEN 'seamlessly charges ' || p_name || ' and two more devices at once in the car' ELSE '- short' END",
        "bullet_2": "CASE p_partkey % 3 WHEN 0 THEN 'One year warranty on all ' || p_name WHEN 1 THEN p_name || ' state-of-the-art casing' ELSE NULL END",
        "bullet_3": "CASE p_partkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'weighs next to nothing at all' ELSE 'guaranteed for life in the box' END", "bullet_4": "CASE p_partkey % 2 WHEN 0 THEN NULL ELSE 'tiny' END"}


def copy_rows_sql() -> str:
    """Each text of a row normalised by itself, then put together again."""
    parts = [f"t AS (SELECT {inputs.select(COPY)} FROM part)"]
    for name, longest in (("subtitle", 80), *((f"bullet_{n}", 60) for n in range(1, 5))):
        parts.append(f"n_{name} AS (WITH d AS (SELECT id, {clean_copy_sql(name, 'brand', longest)} AS c0 FROM t) {normalised_sql('SELECT * FROM d', longest, 15)} "
                     f"SELECT id, c4 AS {name}_text, length(c4) BETWEEN 15 AND {longest} AS {name}_ok, regexp_matches(c4, '(?i)\\b(warrant\\w*|guarantee\\w*)') AS {name}_bad FROM c4)")
    title = r"regexp_replace(trim(coalesce(title, '')), '\s+', ' ', 'g')"
    needed = [f"CASE WHEN bullet_{n}_bad THEN '' ELSE bullet_{n}_text END AS bullet_{n}" for n in (1, 2)]
    optional = [f"CASE WHEN trim(coalesce(bullet_{n}, '')) <> '' AND lower(trim(bullet_{n})) NOT IN ('none', 'null') AND bullet_{n}_text <> '' AND bullet_{n}_ok AND NOT bullet_{n}_bad THEN bullet_{n}_text END AS bullet_{n}" for n in (3, 4)]
    joins = " ".join(f"JOIN n_{name} USING (id)" for name in ("subtitle", *(f"bullet_{n}" for n in range(1, 5))))
    return f"""WITH {', '.join(parts)} SELECT id, brand, CASE WHEN length({title}) > 40 THEN rtrim(regexp_replace({title}[:40], ' [^ ]*$', ''), ' ,;:-') ELSE {title} END AS title, subtitle_text AS subtitle,
      {', '.join(needed + optional)}, subtitle_text <> '' AND bullet_1_ok AND NOT bullet_1_bad AND bullet_2_ok AND NOT bullet_2_bad AS copy_ok FROM t {joins}"""


@query("normalised_copy_rows", copy_rows_sql())
def normalised_copy_rows(t: Tables):
    return normalise_copy_row(inputs.derive(t.part, COPY))


@query("normalised_subtitles", f"""WITH t AS (SELECT {inputs.select(COPY)} FROM part), d AS (SELECT id, {clean_copy_sql('subtitle', 'brand', 80)} AS c0 FROM t) {normalised_sql('SELECT * FROM d', 80, 15)}
    SELECT id, c4 AS subtitle FROM c4""")
def normalised_subtitles(t: Tables):
    return normalise_copy_row(inputs.derive(t.part, COPY)).select("id", "subtitle")


@query("brochure_sections", f"""WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda l: l <> '') AS lines FROM documents),
    m AS (SELECT *, list_filter(range(len(lines)), lambda i: list_has_all(regexp_extract_all(lower(lines[i + 1]), '[a-z0-9]+'), ['the', 'on']))[1] AS start FROM d),
    s AS (SELECT *, list_filter(range(len(lines)), lambda i: i > start AND {duck.any_of('lower(lines[i + 1])', ['power bank', 'powerbank', 'charger', 'adapter'])} AND NOT list_has_all(regexp_extract_all(lower(lines[i + 1]), '[a-z0-9]+'), ['the', 'on']))[1] AS stop FROM m)
    SELECT doc_id, CASE WHEN start IS NULL THEN text ELSE array_to_string(lines[start + 1:least(start + 25, coalesce(stop, start + 25))], chr(10)) END AS section FROM s""")
def brochure_sections(t: Tables):
    return with_section(t.documents.select("doc_id", "text"), "text", model_tokens(F.lit("on the"))).drop("text")


# --- validation ---------------------------------------------------------------------------------------

E = {f: effective(f) for f in ("Title", "Subtitle", "Spec_Capacity", "Spec_Output", "Spec_Ports", "Spec_Weight", "Bullet_1", "Bullet_2", "Bullet_3", "Bullet_4")}
FACTS = f"""{WITH_FILES}, q AS (SELECT *, {IMAGE_PATH} AS image_path, {', '.join(f'{x} AS e_{f}' for f, x in E.items())}, {duck.category_key('Category')} AS k,
    coalesce(trim(Raw_Title), '') AS raw_title, NOT {is_blank('Raw_Title')} OR NOT {is_blank('Override_Title')} AS has_title, trim(Model_Name) AS m,
    split_part(split_part(rtrim(Source_URL, '/'), '/', -1), '?', 1) AS slug FROM catalogue),
  f AS (SELECT q.*, a.length AS len, a.width AS w, a.height AS h, a.md5, {duck.tokens(duck.portion('raw_title'))} AS seg, {duck.tokens('m')} AS wanted,
    list_sort(list_distinct(regexp_extract_all({duck.replace(duck.replace('slug', '([a-zA-Z]+)([0-9]+)', chr(92) + '1 ' + chr(92) + '2'), '([0-9]+)([a-zA-Z]+)', chr(92) + '1 ' + chr(92) + '2')}, '\\b\\d+\\b'))) AS in_slug,
    list_sort(list_distinct(regexp_extract_all({duck.replace(duck.replace("coalesce(e_Title, Model_Name, '')", '([a-zA-Z]+)([0-9]+)', chr(92) + '1 ' + chr(92) + '2'), '([0-9]+)([a-zA-Z]+)', chr(92) + '1 ' + chr(92) + '2')}, '\\b\\d+\\b'))) AS in_title
    FROM q LEFT JOIN assets a ON a.path = image_path),
  d AS (SELECT f.*, (SELECT arg_min(o.Product_ID, o.row_order) FROM f o WHERE o.md5 = f.md5 AND o.image_path <> f.image_path AND o.Status <> 'Skipped') AS dup FROM f)"""
_N = "CAST(4 - (CAST(e_Spec_Capacity IS NULL AS INT) + CAST(e_Spec_Output IS NULL AS INT) + CAST(e_Spec_Ports IS NULL AS INT) + CAST(e_Spec_Weight IS NULL AS INT)) AS INT)"
_B = "(CAST(e_Bullet_1 IS NOT NULL AS INT) + CAST(e_Bullet_2 IS NOT NULL AS INT) + CAST(e_Bullet_3 IS NOT NULL AS INT) + CAST(e_Bullet_4 IS NOT NULL AS INT))"
_MISSING = "array_to_string(list_filter([CASE WHEN e_Spec_Capacity IS NULL THEN 'capacity' END, CASE WHEN e_Spec_Output IS NULL THEN 'output' END, CASE WHEN e_Spec_Ports IS NULL THEN 'ports' END, CASE WHEN e_Spec_Weight IS NULL THEN 'weight' END], lambda x: x IS NOT NULL), ', ')"
_CLASH = f"list_filter({duck.listed(fixed.DEFAULT_QUALIFIERS)}, lambda t: list_contains(seg, lower(t)) AND NOT list_contains(wanted, lower(t)))[1]"
_NAMED = search("m", rf"(?i)\b({fixed.CAPACITIES_IN_NAME})\s*(?:mah)?\b", 1)
_STATED = search("replace(e_Spec_Capacity, ',', '')", rf"\b({fixed.CAPACITIES_IN_NAME})\b", 1)


def _unsourced(field: str, test: str | None = None) -> str:
    raw = f"Raw_{field}"
    if raw not in inputs.CATALOGUE:
        return "NULL"
    source = f"Source_{field}" if f"Source_{field}" in inputs.CATALOGUE else "NULL"
    return f"CASE WHEN {test or f'NOT {is_blank(raw)}'} AND {is_blank(source)} AND {is_blank('Source_URL')} THEN 'FATAL BUG: Field ''{raw}'' populated without verified source URL in ''Source_{field}'' or ''Source_URL''' END"


_PRESENT = "coalesce(len > 0, false)"
_BOIL = lambda b: f"CASE WHEN e_{b} IS NOT NULL THEN 'Boilerplate detected in {b}: ''' || list_filter({duck.listed(fixed.BOILERPLATE)}, lambda p: contains(lower(e_{b}), p))[1] || '''' END"
_LONG = lambda b: f"CASE WHEN length(trim(e_{b})) > 60 THEN '{b} exceeds 60-character wrap limit (' || length(trim(e_{b})) || ' chars): ''' || trim(e_{b}) || '''' END"
_CLAIM = lambda b: f"CASE WHEN regexp_matches(trim(e_{b}), '(?i)\\b(warrant\\w*|guarantee\\w*)') THEN 'Disallowed warranty claim in {b}: ''' || trim(e_{b}) || '''' END"
HARD = ", ".join([
    f"CASE WHEN Status = 'Blocked' THEN 'Product marked as Blocked' WHEN Status = 'Deferred' THEN 'Product deferred due to infrastructure error' WHEN NOT has_title THEN 'All spec tiers exhausted without finding technical specifications' END",
    f"CASE WHEN raw_title <> '' THEN 'Qualifier token mismatch: Qualifier token mismatch in model segment ''' || {duck.portion('raw_title')} || ''': candidate contains ''' || {_CLASH} || ''' but target Model_Name ''' || m || ''' does not.' END",
    f"CASE WHEN k = 'powerbank' AND {_NAMED} <> {_STATED} THEN 'Capacity mismatch: Model_Name specifies ' || {_NAMED} || 'mAh but collected spec is ' || {_STATED} || 'mAh' END",
    *[_BOIL(b) for b in fixed.BULLETS],
    f"CASE WHEN k = 'powerbank' AND {_N} < 2 THEN 'Insufficient specifications: ' || (4 - {_N}) || ' of 4 required specs are empty (fewer than 2 populated)' WHEN k <> 'powerbank' AND {_N} = 0 AND {_B} < 2 THEN 'Insufficient specifications: No technical specifications or feature bullets found across available sources' END",
    *[_unsourced(f, "Raw_MRP_Scraped IS NOT NULL" if f == "MRP_Scraped" else None) for f in fixed.PROVENANCE_FIELDS],
    f"CASE WHEN {_PRESENT} AND {is_blank('Override_Image_Path')} AND split_part(image_path, '/', -1) <> {duck.slug('m')} || '.png' THEN 'Image filename mismatch: expected ''' || {duck.slug('m')} || '.png'', got ''' || split_part(image_path, '/', -1) || '''' END",
    f"CASE WHEN {_PRESENT} THEN 'Duplicate image asset: identical file hash to product [' || dup || ']' END",
    f"CASE WHEN {_PRESENT} AND (w IS NULL OR h IS NULL) THEN 'Corrupted image file at ''' || image_path || ''': unreadable' END",
    *[x for b in fixed.BULLETS for x in (_LONG(b), _CLAIM(b))],
    f"CASE WHEN {_B} < 2 AND has_title THEN 'Thin copy: Product has fewer than 2 bullets (' || {_B} || ' present)' END",
    "CASE WHEN regexp_matches(e_Subtitle, '(?i)\\b(warrant\\w*|guarantee\\w*)') THEN 'Disallowed warranty claim in Subtitle: ''' || e_Subtitle || '''' END",
])
_SIZE_PX = "w || 'x' || h || 'px'"
WARN = ", ".join([
    f"CASE WHEN k = 'powerbank' AND {_N} = 2 THEN 'Partial specifications: 2 of 4 specs empty (' || {_MISSING} || ')' WHEN k <> 'powerbank' AND {_N} = 0 AND {_B} >= 2 THEN 'Specifications derived directly from verified product description' END",
    f"CASE WHEN NOT {_PRESENT} THEN 'Image missing on disk at ''' || image_path || '''' END",
    f"CASE WHEN {_PRESENT} AND (w < 800 OR h < 800) THEN 'Image resolution below target: ' || {_SIZE_PX} || ' (min required 800x800px)' END",
    f"CASE WHEN {_PRESENT} AND abs(w - h) / greatest(w, h) > 0.01 THEN 'Image is not square (1:1): ' || {_SIZE_PX} || '; tile is 290x290px square and will crop' END",
    f"CASE WHEN NOT {duck.any_of('lower(' + sql_filled('Image_Source') + ')', ['brand', 'official', 'local-verified'])} THEN 'Image sourced from secondary channel: ' || Image_Source END",
    f"CASE WHEN (NOT {is_blank('Override_Title')} OR NOT {is_blank('Override_Subtitle')} OR Override_MRP IS NOT NULL OR NOT {is_blank('Override_Spec_Capacity')}) AND NOT coalesce(Source_URL LIKE 'http%', false) THEN 'Manual override data present with no live scraped source URL to cross-check' END",
    "CASE WHEN Raw_MRP_Scraped < MRP_Input THEN 'Scraped MRP (₹' || format('{:,}', CAST(round_even(Raw_MRP_Scraped, 0) AS BIGINT)) || ') is lower than DP (₹' || format('{:,}', CAST(round_even(MRP_Input, 0) AS BIGINT)) || ') — potential product mismatch or bad parse' END",
    "CASE WHEN Source_URL LIKE 'http%' AND len(in_slug) > 0 AND len(in_title) > 0 AND NOT list_has_all(in_title, in_slug) AND NOT list_has_all(in_slug, in_title) THEN 'URL slug numeric token mismatch: slug ''' || slug || ''' contains numbers [''' || array_to_string(in_slug, ''', ''') || '''] but title/model contains [''' || array_to_string(in_title, ''', ''') || '''] (potential reused URL handle)' END",
])
VALIDATED = f"{FACTS}, v AS (SELECT *, list_filter([{HARD}], lambda x: x IS NOT NULL) AS hard_flags, list_filter([{WARN}], lambda x: x IS NOT NULL) AS warnings FROM d)"


def faced(t: Tables):
    return validation.with_duplicate_images(validation.with_image_facts(inputs.catalogue(t), inputs.assets(t)), "row_order")


@query("validation_flags", f"{VALIDATED} SELECT Product_ID AS product_id, array_to_string(hard_flags, chr(10)) AS hard_flags, array_to_string(warnings, chr(10)) AS warnings, len(hard_flags) = 0 AS is_passed FROM v")
def validation_flags(t: Tables):
    return validation.validate(faced(t)).select(F.col("Product_ID").alias("product_id"), F.array_join("hard_flags", "\n").alias("hard_flags"), F.array_join("warnings", "\n").alias("warnings"), "is_passed")


@query("duplicate_images", """WITH e AS (SELECT vec_id, label, md5(CAST(label AS VARCHAR) || CAST(vec_id % 7 AS VARCHAR)) AS h FROM embeddings) SELECT a.vec_id AS id,
    (SELECT min(b.vec_id) FROM e b WHERE b.h = a.h AND b.vec_id <> a.vec_id AND b.label <> 3) AS duplicate_of FROM e a""")
def duplicate_images(t: Tables):
    rows = t.embeddings.select(F.col("vec_id").alias("Product_ID"), F.concat(F.lit("images/"), F.col("vec_id").cast("string")).alias("image_path"),
                               F.expr("md5(CAST(label AS STRING) || CAST(vec_id % 7 AS STRING))").alias("image_md5"), F.when(F.col("label") == 3, F.lit("Skipped")).otherwise(F.lit("Pending")).alias("Status"))
    return validation.with_duplicate_images(rows).select(F.col("Product_ID").alias("id"), F.col("duplicate_image_of").alias("duplicate_of"))


@query("unsourced_values", f"{WITH_CATALOGUE} SELECT Product_ID AS product_id, CAST(len(list_filter([{', '.join(_unsourced(f, 'Raw_MRP_Scraped IS NOT NULL' if f == 'MRP_Scraped' else None) for f in fixed.PROVENANCE_FIELDS)}], lambda x: x IS NOT NULL)) AS INT) AS n_unsourced FROM catalogue")
def unsourced_values(t: Tables):
    return inputs.catalogue(t).select(F.col("Product_ID").alias("product_id"), F.size(validation.unsourced_fields()).alias("n_unsourced"))


SUBMITTED = {"sheet": "p_brand", "id": "p_partkey", "model_name": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END", "display_name": "CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name || ' ' || CAST(p_size AS STRING) END",
             "dp": "CASE WHEN p_partkey % 4 = 0 THEN '0' WHEN p_partkey % 4 = 1 THEN '₹ 1,200' WHEN p_partkey % 4 = 2 THEN NULL ELSE 'tbd' END", "mrp": "CASE WHEN p_partkey % 3 = 0 THEN '999.50' ELSE '' END"}
WITH_SUBMITTED = f"WITH s AS (SELECT {inputs.select(SUBMITTED)} FROM part)"


@query("submission_gaps", f"""{WITH_SUBMITTED} SELECT id, array_to_string(list_filter([CASE WHEN {is_blank('model_name')} THEN 'Model Name' END, CASE WHEN coalesce(try_cast(regexp_replace(dp, '[^0-9.]', '', 'g') AS DOUBLE), 0) <= 0 THEN 'DP' END,
    CASE WHEN coalesce(try_cast(regexp_replace(mrp, '[^0-9.]', '', 'g') AS DOUBLE), 0) <= 0 THEN 'MRP' END], lambda x: x IS NOT NULL), ',') AS missing FROM s""")
def submission_gaps(t: Tables):
    return validation.missing_fields(inputs.derive(t.part, SUBMITTED)).select("id", F.array_join("missing", ",").alias("missing"))


@query("submission_duplicates", f"""{WITH_SUBMITTED}, n AS (SELECT sheet, coalesce(nullif(display_name, ''), model_name) AS shown FROM s) SELECT sheet, lower(trim(shown)) AS name, count(*) AS n_rows, min(shown) AS display_name
    FROM n WHERE trim(shown) <> '' GROUP BY ALL HAVING count(*) > 1""")
def submission_duplicates(t: Tables):
    return validation.duplicate_display_names(inputs.derive(t.part, SUBMITTED))


def _contradiction(label: str, mine: str, theirs: str, what: str) -> str:
    return f"CASE WHEN len({mine}) > 0 AND len({theirs}) > 0 AND NOT list_has_any({mine}, {theirs}) THEN '{label} {what} differs from specification' END"


_SPEC_MAH, _SPEC_W = duck.quantities(effective("Spec_Capacity"))[0], duck.quantities(effective("Spec_Output"))[1]
CONTRADICTIONS = ", ".join(
    [_contradiction("Model_Name", duck.quantities("Model_Name")[0], "spec_mah", "capacity")]
    + [x for f in ("Subtitle", *fixed.BULLETS) for x in (_contradiction(f, duck.quantities(effective(f))[0], "spec_mah", "capacity"), _contradiction(f, duck.quantities(effective(f))[1], "spec_w", "wattage"))])


@query("copy_contradictions", f"""{WITH_CATALOGUE}, s AS (SELECT *, {_SPEC_MAH} AS spec_mah, {_SPEC_W} AS spec_w FROM catalogue)
    SELECT Product_ID AS product_id, array_to_string(list_filter([{CONTRADICTIONS}], lambda x: x IS NOT NULL), chr(10)) AS contradictions FROM s""")
def copy_contradictions(t: Tables):
    return validation.copy_contradictions(inputs.catalogue(t)).select(F.col("Product_ID").alias("product_id"), F.array_join("contradictions", "\n").alias("contradictions"))


BUILD = f"""{WITH_FILES}, p AS (SELECT Product_ID AS pid, coalesce(trim(Model_Name), '') AS m, coalesce(trim(Brand), '') AS b, coalesce({effective('Subtitle')}, '') AS s, {_B.replace('e_Bullet', 'x_Bullet')} AS n, {IMAGE_PATH} AS image_path,
    coalesce(CAST(Override_MRP AS VARCHAR), {sql_filled('MRP_Display')}, CAST(Raw_MRP_Scraped AS VARCHAR)) AS mrp FROM (SELECT *, {', '.join(f'{effective(b)} AS x_{b}' for b in fixed.BULLETS)} FROM catalogue))
    SELECT pid AS product_id, CASE WHEN s = '' THEN 'Build validation failed: Product ' || pid || ' (' || m || ') is missing ''Subtitle''' WHEN n = 0 THEN 'Build validation failed: Product ' || pid || ' (' || m || ') has no bullets defined'
    WHEN mrp IS NULL THEN 'Build validation failed: Product ' || pid || ' (' || m || ') is missing pricing/MRP field'
    WHEN coalesce((SELECT length FROM assets WHERE path = image_path), 0) = 0 THEN 'Build validation failed: Product ' || pid || ' (' || m || ') image file not found or empty at ''' || image_path || '''' END AS build_error FROM p"""


@query("build_checks", BUILD)
def build_checks(t: Tables):
    files = inputs.assets(t)
    return validation.build_error(resolve.resolve_products(inputs.catalogue(t), files), files).select("product_id", "build_error")


# --- status machine -----------------------------------------------------------------------------------

CONTRADICTION = f"list_contains(list_transform(hard_flags, lambda f: {duck.any_of('lower(f)', status.CONTRADICTIONS)}), true)"


@query("final_status", f"""{VALIDATED} SELECT Product_ID AS product_id, CASE WHEN Status IN ('Approved', 'Skipped', 'Deferred') THEN Status WHEN len(hard_flags) = 0 THEN 'Ready_For_Review' WHEN {CONTRADICTION} THEN 'Blocked' ELSE 'Skipped' END AS status,
    CASE WHEN Status IN ('Approved', 'Skipped', 'Deferred') THEN Flags WHEN len(hard_flags) = 0 THEN nullif(array_to_string(warnings, chr(10)), '') WHEN {CONTRADICTION} THEN 'Hard Block: ' || array_to_string(hard_flags, ', ') ELSE 'Skipped: ' || array_to_string(hard_flags, ', ') END AS flags,
    CASE WHEN Status IN ('Approved', 'Skipped', 'Deferred') OR len(hard_flags) = 0 THEN Raw_Title END AS raw_title, CASE WHEN Status IN ('Approved', 'Skipped', 'Deferred') OR len(hard_flags) = 0 THEN Source_URL END AS source_url, Override_Title AS override_title FROM v""")
def final_status(t: Tables):
    df = status.final_status(validation.validate(faced(t)))
    return df.select(F.col("Product_ID").alias("product_id"), F.col("Status").alias("status"), F.col("Flags").alias("flags"), F.col("Raw_Title").alias("raw_title"), F.col("Source_URL").alias("source_url"), F.col("Override_Title").alias("override_title"))


FIX = f"""CASE WHEN list_contains(list_transform(hard_flags, lambda f: contains(f, 'exceeds 60-character')), true) THEN 'long_bullets' WHEN list_contains(list_transform(hard_flags, lambda f: contains(f, 'Boilerplate detected') OR contains(f, 'Disallowed warranty claim')), true) THEN 'bad_bullets'
    WHEN list_contains(list_transform(hard_flags, lambda f: contains(lower(f), 'mismatch')), true) THEN 'mismatch' END"""


def fixed_bullet(b: str) -> str:
    bad = f"({duck.any_of(f'lower({b})', fixed.BOILERPLATE)} OR regexp_matches({b}, '(?i)\\b(warrant\\w*|guarantee\\w*)'))"
    return f"CASE WHEN fix = 'long_bullets' AND length(trim({b})) > 60 THEN regexp_replace(trim({b})[:60], ' [^ ]*$', '') WHEN fix = 'bad_bullets' AND {bad} THEN NULL ELSE {b} END"


WRONG = f"list_filter(hard_flags, lambda f: {duck.any_of('lower(f)', status.WRONG_PRODUCT)})"


@query("automatic_fixes", f"""{VALIDATED}, x AS (SELECT *, {FIX} AS fix FROM v) SELECT Product_ID AS product_id, fix, coalesce(fix = 'mismatch', false) AS needs_rematch, {fixed_bullet('Raw_Bullet_1')} AS bullet_1, {fixed_bullet('Raw_Bullet_2')} AS bullet_2, {fixed_bullet('Raw_Bullet_3')} AS bullet_3,
    CASE WHEN fix = 'mismatch' AND len({WRONG}) > 0 AND Source_URL LIKE 'http%' THEN Source_URL END AS rejected_url, CASE WHEN fix = 'mismatch' AND len({WRONG}) > 0 AND Source_URL LIKE 'http%' THEN 'review: ' || array_to_string({WRONG}, ', ')[:120] END AS rejected_reason FROM x""")
def automatic_fixes(t: Tables):
    df = status.apply_fix(validation.validate(faced(t)))
    return df.select(F.col("Product_ID").alias("product_id"), "fix", "needs_rematch", *[F.col(f"Raw_Bullet_{n}").alias(f"bullet_{n}") for n in (1, 2, 3)], "rejected_url", "rejected_reason")


@query("review_loop")
def review_loop(t: Tables):
    df = status.review(faced(t), validation.validate)
    return df.select(F.col("Product_ID").alias("product_id"), F.col("Status").alias("status"), F.col("Flags").alias("flags"), F.col("Attempts").alias("attempts"), F.col("Fix_Log").alias("fix_log"), F.col("Raw_Bullet_1").alias("bullet_1"), "needs_rematch")


@query("reset_for_rerun", f"""{WITH_CATALOGUE} SELECT Product_ID AS product_id, CAST(NULL AS VARCHAR) AS raw_title, CAST(NULL AS VARCHAR) AS source_url, 0 AS attempts, 'Pending' AS status, Override_Title AS override_title,
    CASE WHEN Rejected_URLs IS NOT NULL THEN 'https://www.store.example/a | not_match: other' END AS rejected_urls FROM catalogue""")
def reset_for_rerun(t: Tables):
    return status.reset_for_rerun(inputs.catalogue(t)).select(
        F.col("Product_ID").alias("product_id"), F.col("Raw_Title").alias("raw_title"), F.col("Source_URL").alias("source_url"), F.col("Attempts").alias("attempts"), F.col("Status").alias("status"),
        F.col("Override_Title").alias("override_title"), F.col("Rejected_URLs").alias("rejected_urls"))


@query("retry_selection", f"{WITH_CATALOGUE} SELECT Product_ID AS product_id, Status AS status FROM catalogue WHERE Status IN ('Blocked', 'Skipped', 'Deferred')")
def retry_selection(t: Tables):
    return status.select_retries(inputs.catalogue(t)).select(F.col("Product_ID").alias("product_id"), F.col("Status").alias("status"))


@query("collectable_selection", f"{WITH_CATALOGUE} SELECT Product_ID AS product_id FROM catalogue WHERE Status NOT IN ('Approved', 'Ready_For_Review')")
def collectable_selection(t: Tables):
    return status.select_collectable(inputs.catalogue(t)).select(F.col("Product_ID").alias("product_id"))


def approvals(t: Tables):
    return status.approve(faced(t), validation.validate)


@query("approved_changes", f"""{VALIDATED} SELECT Product_ID AS product_id, Model_Name AS model_name, Status AS from_status, 'Approved' AS to_status, array_to_string(hard_flags, chr(10)) AS hard_flags FROM v WHERE Status = 'Ready_For_Review'""")
def approved_changes(t: Tables):
    return approvals(t)[0].withColumn("hard_flags", F.array_join("hard_flags", "\n"))


@query("approval_leftovers", f"""{WITH_CATALOGUE} SELECT Product_ID AS product_id, Model_Name AS model_name, Status AS status, 'Current status is ''' || Status || ''', not ''Ready_For_Review''' AS reason FROM catalogue WHERE Status <> 'Ready_For_Review'""")
def approval_leftovers(t: Tables):
    return approvals(t)[1]


VERDICTS = {"product_id": f"'PB-' || lpad(CAST(p_partkey AS STRING), 7, '0')", "satisfied": "p_partkey % 2 = 0", "contradictions": "CASE WHEN p_size > 5 THEN 'wattage differs on ' || p_name ELSE '' END", "action": "CASE WHEN p_size % 2 = 0 THEN 'recollect' ELSE 'none' END"}


@query("post_run_review", f"""{WITH_CATALOGUE}, g AS (SELECT {inputs.select(VERDICTS)} FROM part), j AS (SELECT *, coalesce(Status = 'Ready_For_Review' AND NOT satisfied AND contradictions <> '', false) AS unhappy, CAST(len(regexp_extract_all(coalesce(Fix_Log, ''), '\\[Review Re-run(?: \\d+)?\\]')) AS INT) AS n
    FROM catalogue c JOIN g ON g.product_id = c.Product_ID) SELECT Product_ID AS product_id, CASE WHEN unhappy AND n < 2 THEN 'Pending' WHEN unhappy THEN 'Blocked' ELSE Status END AS status,
    CASE WHEN unhappy AND n < 2 THEN NULL WHEN unhappy THEN 'Blocked by Post-Run Review: ' || contradictions ELSE Flags END AS flags, CASE WHEN unhappy AND n < 2 THEN NULL ELSE Raw_Title END AS raw_title, unhappy AND n < 2 AS rematch,
    CASE WHEN unhappy AND n < 2 THEN concat_ws(chr(10), {sql_filled('Fix_Log')}, '[Review Re-run ' || (n + 1) || ']: Re-collected due to review critique: ' || contradictions) ELSE Fix_Log END AS fix_log,
    CASE WHEN unhappy AND n < 2 AND Source_URL LIKE 'http%' AND action = 'recollect' THEN concat_ws(chr(10), {sql_filled('Rejected_URLs')}, Source_URL || ' | review: ' || contradictions[:120]) ELSE Rejected_URLs END AS rejected_urls FROM j""")
def post_run_review(t: Tables):
    df = status.post_run_review(inputs.catalogue(t), inputs.derive(t.part, VERDICTS))
    return df.select(F.col("Product_ID").alias("product_id"), F.col("Status").alias("status"), F.col("Flags").alias("flags"), F.col("Raw_Title").alias("raw_title"), "rematch", F.col("Fix_Log").alias("fix_log"), F.col("Rejected_URLs").alias("rejected_urls"))


MANUAL = {"product_id": f"'pb-' || lpad(CAST(p_partkey AS STRING), 7, '0')", "url": "CASE WHEN p_size % 3 = 0 THEN 'ftp://x' ELSE 'https://store.example/' || CAST(p_size AS STRING) END", "success": "p_size % 2 = 0",
          "direct_url": "CASE WHEN p_size % 4 = 0 THEN 'https://store.example/products/' || CAST(p_size AS STRING) ELSE NULL END", "message": "'lists ' || CAST(p_size AS STRING) || ' products'"}


@query("manual_sources", f"""{WITH_CATALOGUE}, g AS (SELECT {inputs.select(MANUAL)} FROM part) SELECT c.Product_ID AS product_id, CASE WHEN g.success THEN coalesce(g.direct_url, g.url) END AS product_url,
    CASE WHEN g.success THEN NULL WHEN g.product_id IS NOT NULL THEN 'Manual URL Resolution: ' || g.message ELSE Flags END AS flags, CASE WHEN g.success THEN 'Pending' ELSE Status END AS status, CASE WHEN g.success THEN NULL ELSE Raw_Title END AS raw_title
    FROM catalogue c LEFT JOIN g ON g.product_id = lower(c.Product_ID) AND g.url LIKE 'http%'""")
def manual_sources(t: Tables):
    df, _ = status.apply_manual_source(inputs.catalogue(t), inputs.derive(t.part, MANUAL))
    return df.select(F.col("Product_ID").alias("product_id"), F.col("Product_URL").alias("product_url"), F.col("Flags").alias("flags"), F.col("Status").alias("status"), F.col("Raw_Title").alias("raw_title"))


NAMES = {"brand_name": "p_brand", "id": "p_partkey", "model_name": "CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' ' || p_name || ' Buds' WHEN p_partkey % 3 = 1 THEN p_name || ' 20000mAh' ELSE p_name || ' ' || CAST(p_size AS STRING) END",
         "display_name": "CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN '' ELSE p_name || ' ' || CAST(p_size AS STRING) END"}
_PLAIN = "CASE WHEN trim(regexp_replace(trim(model_name), '(?i)^\\Q' || brand_name || '\\E\\s+', '')) = '' THEN trim(model_name) ELSE trim(regexp_replace(trim(model_name), '(?i)^\\Q' || brand_name || '\\E\\s+', '')) END"
_IDENTITY = f"list_filter(regexp_extract_all({duck.replace('lower(plain)', r'\b\d+(?:,\d+)?\s*mah\b|\b\d+k\b|\b\d+(?:\.\d+)?\s*w\b', ' ')}, '[a-z0-9]+'), lambda x: NOT list_contains({duck.listed(fixed.DISPLAY_DROPPABLE)}, x))"


@query("enforced_display_names", f"""WITH s AS (SELECT {inputs.select(NAMES)} FROM part), p AS (SELECT *, {_PLAIN} AS plain FROM s), k AS (SELECT *, CASE WHEN trim(display_name) <> '' AND list_has_all(regexp_extract_all(lower(display_name), '[a-z0-9]+'), {_IDENTITY}) THEN trim(display_name) ELSE plain END AS shown FROM p)
    SELECT id, brand_name, CASE WHEN count(*) OVER (PARTITION BY brand_name, lower(trim(shown))) > 1 THEN plain ELSE shown END AS display_name FROM k""")
def enforced_display_names(t: Tables):
    return status.enforce_display_names(inputs.derive(t.part, NAMES)).select("id", "brand_name", "display_name")
