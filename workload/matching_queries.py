"""Matching, tier merge, onboarding and brand configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schema
from shelfmark.functions import fixed
from shelfmark.functions.text import filled
from shelfmark.functions.urls import url_key
from shelfmark.operators import brands, matching, merge, onboarding
from shelfmark.session import checkpointed
from workload import duck, inputs
from workload.catalogue_queries import display_candidate_sql
from workload.duck import WITH_CATALOGUE, WITH_FILES, any_of, filled as sql_filled, listed, minus, portion, quantities, replace, search, subset, tokens
from workload.registry import Tables, query

# Products of part looked for among store listings, themselves derived from part: a brand's own shop with spellings,
# figures and colours, and two retailers that also carry other brands.
PRODUCTS = {"product_id": "p_partkey", "brand": "p_brand", "category": "CASE WHEN p_size % 3 = 0 THEN 'Powerbank' WHEN p_size % 3 = 1 THEN 'TWS' ELSE 'Cable' END",
            "model_name": "CASE p_partkey % 5 WHEN 0 THEN p_name || ' 10' WHEN 1 THEN p_brand || ' ' || p_name WHEN 2 THEN replace(p_name, ' ', '') WHEN 3 THEN p_name || ' Pro 20000mAh' ELSE p_name || ' Power Bank' END"}
TARGET_CAPACITY = "CASE WHEN p_partkey % 4 = 0 THEN '10000mAh' ELSE NULL END"
QUALIFIERS = {"empty": "p_size % 2 = 0", "words": ["Pro", "Mini", "small"]}
LISTINGS = {
    "store_brand": "CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_brand END",
    "source": "CASE WHEN p_partkey % 3 = 0 THEN 'brand-store' WHEN p_partkey % 3 = 1 THEN 'brand-sitemap' ELSE 'retail' END",
    "title": "CASE p_partkey % 7 WHEN 0 THEN p_brand || ' ' || p_name || ' 10000mAh Power Bank' WHEN 1 THEN p_name || ' Pro 20,000 mAh 22.5W' WHEN 2 THEN p_brand || ' ' || p_name || ' wireless - black' "
             "WHEN 3 THEN p_name || ' mini' WHEN 4 THEN p_name WHEN 5 THEN 'Sony ' || p_name || ' charger' ELSE p_name || ' p0109, Blue' END",
    "url": "'https://shop.example/products/' || replace(p_name, ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-' || CAST(p_size AS STRING) || '?v=2' END",
    "arrival": "p_partkey",
}
REJECTED = {"product_id": "p_partkey", "url": "'https://shop.example/products/' || replace(p_name, ' ', '-') || '/'"}


def products(t: Tables):
    words = F.array(*[F.lit(w) for w in QUALIFIERS["words"]])
    df = inputs.derive(t.part, {**PRODUCTS, "target_capacity": TARGET_CAPACITY, "_even": QUALIFIERS["empty"]})
    return df.withColumn("qualifiers", F.when(~F.col("_even"), words)).drop("_even")


def listings(t: Tables):
    return inputs.derive(t.part, LISTINGS)


def rejected(t: Tables):
    return inputs.derive(t.part.where("p_brand <> 'Brand#1'"), REJECTED)


P_SQL = f"SELECT {inputs.select(PRODUCTS)}, {TARGET_CAPACITY} AS target_capacity, CASE WHEN NOT ({QUALIFIERS['empty']}) THEN {listed(QUALIFIERS['words'])} END AS qualifiers FROM part"
L_SQL = f"SELECT {inputs.select(LISTINGS)} FROM part"
MEET_SQL = "targets p JOIN texts l ON l.store_brand IS NULL OR lower(l.store_brand) = lower(p.brand)"


def _target_sql(products_sql: str = P_SQL) -> str:
    stop = " ".join(f"WHEN '{k}' THEN {listed(sorted(set(fixed.MATCH_STOP_WORDS + v)))}" for k, v in fixed.CATEGORY_DESCRIPTORS.items())
    words = " ".join(f"WHEN '{k}' THEN {listed(v)}" for k, v in fixed.CATEGORY_DESCRIPTORS.items())
    mah, watts = quantities("model_name")
    return f"""p AS ({products_sql}),
      p0 AS (SELECT DISTINCT brand, category, model_name, target_capacity, qualifiers FROM p),
      p1 AS (SELECT *, {duck.category_key('category')} AS k, {portion('model_name', 'brand')} AS por, {tokens('model_name')} AS mt, {mah} AS mah, {watts} AS watts,
        CASE WHEN qualifiers IS NULL THEN CAST([] AS VARCHAR[]) ELSE {listed(sorted(w.lower() for w in QUALIFIERS['words']))} END AS q,
        list_filter({tokens('target_capacity')}, lambda t: regexp_matches(t, '^([0-9]{{2,6}}|mah)$')) AS hint FROM p0),
      p2 AS (SELECT *, {tokens('por')} AS pt, CASE k {stop} END AS stop, CASE k {words} END AS words FROM p1),
      p3 AS (SELECT *, CASE WHEN len({minus('pt', 'stop')}) > 0 THEN {minus('pt', 'stop')} ELSE {minus('mt', 'stop')} END AS t, {minus('pt', listed(fixed.NEAR_MISS_GENERIC))} AS near FROM p2),
      p4 AS (SELECT *, CASE WHEN len({minus('t', 'q')}) > 0 THEN {minus('t', 'q')} ELSE t END AS core FROM p3),
      targets AS (SELECT *, lower(regexp_replace(por, '[^a-zA-Z0-9]', '', 'g')) AS cp, lower(regexp_replace(array_to_string(list_sort(core), ''), '[^a-zA-Z0-9]', '', 'g')) AS cc FROM p4)"""


def _listing_sql(listings_sql: str = L_SQL) -> str:
    mah, watts = quantities("whole")
    return f"""l AS ({listings_sql}), l1 AS (SELECT *, replace(split_part(split_part(url, '/', -1), '?', 1), '-', ' ') AS slug, lower(rtrim(trim(url), '/')) AS url_key FROM l),
      l2 AS (SELECT DISTINCT store_brand, title, slug, title || ' ' || slug AS whole FROM l1),
      texts AS (SELECT *, {tokens('whole')} AS a, {tokens('title')} AS tt, lower(regexp_replace(whole, '[^a-zA-Z0-9]', '', 'g')) AS sq, {mah} AS l_mah, {watts} AS l_watts,
        list_filter({tokens('whole')}, lambda t: regexp_matches(t, '^[0-9]{{2,6}}$')) AS figures FROM l2)"""


# Only one known brand occurs in the listings, always in front, followed by no device word.
def pairs_sql(products_sql: str = P_SQL, listings_sql: str = L_SQL, meet_sql: str = MEET_SQL, before: str = "WITH") -> str:
    noise = listed(fixed.LISTING_NOISE)
    sound = listed(fixed.LISTING_NOISE + fixed.LISTING_NOISE_SOUND)
    agree = lambda mine, theirs, bonus, penalty: f"CASE WHEN len({mine}) > 0 AND len({theirs}) > 0 THEN CASE WHEN list_has_any({mine}, {theirs}) THEN {bonus} ELSE -{penalty} END ELSE 0 END"
    default = listed(fixed.DEFAULT_QUALIFIERS)
    return f"""{before} {_target_sql(products_sql)}, {_listing_sql(listings_sql)},
      x0 AS (SELECT p.*, l.*, l.store_brand IS NOT NULL AS site, {portion('l.title', 'p.brand')} AS lp FROM {meet_sql}),
      x1 AS (SELECT *, {minus(tokens('lp'), 'stop')} AS c, {minus('a', 'stop')} AS aa, {minus('tt', 'stop')} AS ts, {tokens('CASE WHEN site THEN ' + portion('title') + ' ELSE lp END')} AS seg FROM x0),
      x2 AS (SELECT *, {subset('core', 'aa')} OR (cp <> '' AND contains(sq, cp)) OR (cc <> '' AND contains(sq, cc)) AS contained,
        NOT site AND regexp_matches(title, '(?i)\\bsony\\b') AND NOT regexp_matches(model_name, '(?i)\\bsony\\b') AND NOT regexp_matches(lower(title), '\\b\\Q' || lower(brand) || '\\E\\b') AS foreign_brand,
        len(list_filter(CASE WHEN len(coalesce(qualifiers, [])) > 0 THEN qualifiers ELSE {default} END, lambda w: list_contains(seg, lower(w)) AND NOT list_contains(mt, lower(w)))) > 0 AS clash,
        CASE WHEN cp <> '' AND cp = lower(regexp_replace(lp, '[^a-zA-Z0-9]', '', 'g')) THEN [] ELSE list_filter({minus(minus(minus('c', 't'), 'q'), f"list_concat(words, CASE WHEN k IN ('tws', 'audio') THEN {sound} ELSE {noise} END)")}, lambda t: NOT regexp_matches(t, '^(p\\d+|\\d{{3,5}}|p|sku)$')) END AS surplus FROM x1),
      x3 AS (SELECT *, NOT contained OR foreign_brand OR clash OR len(surplus) > 0 AS refused, 100 + CASE WHEN lower(trim(model_name)) = lower(trim(title)) THEN 150 WHEN lower(trim(por)) = lower(trim(lp)) OR ({subset('t', 'c')} AND {subset('c', 't')}) THEN 100 ELSE 0 END
        + CASE WHEN replace(lower(trim(model_name)), ' ', '') = replace(lower(trim(slug)), ' ', '') THEN 50 ELSE 0 END - 5 * len({minus('ts', 't')}) + {agree('hint', 'figures', 20, 20)} + {agree('mah', 'l_mah', 15, 60)} + {agree('watts', 'l_watts', 15, 40)} AS raw FROM x2),
      scored AS (SELECT brand, category, model_name, target_capacity, qualifiers, store_brand, title, slug, CASE WHEN refused THEN -1.0 ELSE CAST(raw AS DOUBLE) END AS score, NOT refused AND raw > 0 AS valid, len(near) > 0 AND {subset('near', 'a')} AS near_miss FROM x3),
      kept AS (SELECT * FROM scored WHERE valid OR near_miss)"""


CANDIDATES = f"""{pairs_sql()}, o AS (SELECT k.*, l1.source, l1.url, l1.url_key, l1.arrival FROM kept k JOIN l1 ON l1.title = k.title AND l1.slug = k.slug AND l1.store_brand IS NOT DISTINCT FROM k.store_brand),
      u AS (SELECT *, row_number() OVER (PARTITION BY brand, category, model_name, target_capacity, qualifiers, source, url_key ORDER BY valid DESC, arrival) AS n, min(arrival) OVER (PARTITION BY brand, category, model_name, target_capacity, qualifiers, source, url_key) AS first_arrival FROM o),
      cand AS (SELECT p.product_id, u.source, u.url_key, u.first_arrival AS arrival, u.title, u.score, u.valid, u.near_miss FROM u JOIN p ON p.brand = u.brand AND p.category = u.category AND p.model_name = u.model_name
        AND p.target_capacity IS NOT DISTINCT FROM u.target_capacity AND p.qualifiers IS NOT DISTINCT FROM u.qualifiers WHERE u.n = 1)"""
REJECTED_SQL = f"SELECT {inputs.select(REJECTED)} FROM part WHERE p_brand <> 'Brand#1'"
NOT_REJECTED = f"NOT EXISTS (SELECT 1 FROM ({REJECTED_SQL}) r WHERE r.product_id = c.product_id AND lower(rtrim(r.url, '/')) = c.url_key)"
SHORTLIST = f"""{CANDIDATES}, f AS (SELECT * FROM cand c WHERE {NOT_REJECTED}),
      s AS (SELECT *, count(*) FILTER (WHERE valid) OVER (PARTITION BY product_id, source, valid, round(score, 6)) > 1 AND valid AS tied, row_number() OVER (PARTITION BY product_id, source ORDER BY valid DESC, score DESC, arrival, url_key) AS rank FROM f)"""


def candidates(t: Tables):
    return matching.generate_candidates(products(t), listings(t))


@query("score_candidates", f"{CANDIDATES} SELECT product_id, source, url_key, arrival, title, score, valid, near_miss FROM cand")
def score_candidates(t: Tables):
    return candidates(t).select("product_id", "source", "url_key", "arrival", "title", "score", "valid", "near_miss")


@query("shortlist_top4", f"{SHORTLIST} SELECT product_id, source, url_key, title, score, valid, tied, CAST(rank AS INT) AS rank FROM s WHERE rank <= 4")
def shortlist_top4(t: Tables):
    return matching.shortlist(products(t), listings(t), rejected(t)).select("product_id", "source", "url_key", "title", "score", "valid", "tied", "rank")


@query("candidates_without_rejected", f"{CANDIDATES} SELECT product_id, source, url_key, score FROM cand c WHERE {NOT_REJECTED}")
def candidates_without_rejected(t: Tables):
    return matching.generate_candidates(products(t), listings(t), rejected(t)).select("product_id", "source", "url_key", "score")


@query("best_candidates", f"""{CANDIDATES}, b AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, arrival, url_key, source) AS n FROM cand WHERE valid) SELECT product_id, url_key, title, score FROM b WHERE n = 1""")
def best_candidates(t: Tables):
    return matching.best_candidates(products(t), listings(t)).select("product_id", "url_key", "title", "score")


@query("near_misses", f"{CANDIDATES} SELECT product_id, source, url_key, title FROM cand WHERE NOT valid AND near_miss")
def near_misses(t: Tables):
    return matching.near_misses(candidates(t)).select("product_id", "source", "url_key", "title")


@query("ambiguous_names", f"""{CANDIDATES}, named AS (SELECT product_id, {display_candidate_sql()} AS name, arrival FROM (SELECT c.*, p.brand FROM cand c JOIN p USING (product_id) WHERE NOT valid AND near_miss)),
    d AS (SELECT product_id, name, min(arrival) AS arrival FROM named GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY arrival, name) AS n FROM d)
    SELECT product_id, name, arrival, CAST(n AS INT) AS name_rank FROM r WHERE n <= 4""")
def ambiguous_names(t: Tables):
    members, found = matching.score_candidates(products(t), listings(t))
    return members.join(matching.ambiguous_names(found, "target_id"), "target_id").drop("target_id")


@query("shortlist_recall", f"""{SHORTLIST}, truth AS (SELECT product_id, min(url_key) AS url_key FROM cand WHERE valid GROUP BY product_id), h AS (SELECT t.product_id, EXISTS (SELECT 1 FROM s WHERE s.product_id = t.product_id AND s.url_key = t.url_key AND rank <= 4) AS hit FROM truth t)
    SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS found, round(count(*) FILTER (WHERE hit) / count(*), 9) AS recall FROM h""")
def shortlist_recall(t: Tables):
    found = matching.find_pairs(products(t), listings(t))
    # both sides read the candidates, which are met and scored once
    found.candidates = checkpointed(found.candidates)
    return matching.shortlist_recall(matching.short_addresses(found, rejected(t)), matching.first_addresses(found)).withColumn("recall", F.round("recall", 9))


# The brand's own store first; its sitemap only for products that the store does not carry.
@query("tier_shortlist", f"""{CANDIDATES}, a AS (SELECT * FROM cand c WHERE {NOT_REJECTED} AND source = 'brand-store'), b AS (SELECT * FROM cand c WHERE {NOT_REJECTED} AND source = 'brand-sitemap' AND product_id NOT IN (SELECT product_id FROM a WHERE valid)),
    both_ AS (SELECT *, 0 AS stage FROM a UNION ALL SELECT *, 1 FROM b), one AS (SELECT *, row_number() OVER (PARTITION BY product_id, url_key ORDER BY valid DESC, stage, arrival) AS n, min((stage, arrival)) OVER (PARTITION BY product_id, url_key) AS place FROM both_),
    s AS (SELECT *, count(*) FILTER (WHERE valid) OVER (PARTITION BY product_id, valid, round(score, 6)) > 1 AND valid AS tied, row_number() OVER (PARTITION BY product_id ORDER BY valid DESC, score DESC, place, url_key) AS rank FROM one WHERE n = 1)
    SELECT product_id, url_key, source, title, score, valid, tied, CAST(rank AS INT) AS rank FROM s WHERE rank <= 4""")
def tier_shortlist(t: Tables):
    offers = listings(t)
    stages = [offers.where(F.col("source") == name) for name in ("brand-store", "brand-sitemap")]
    return matching.tier_shortlist(products(t), stages, rejected(t)).select("product_id", "url_key", "source", "title", "score", "valid", "tied", "rank")


# Products whose best page states another capacity, or was seen to be another's (each third), look for the next one; some
# have used up their rounds.
LOGS = "CASE p_partkey % 4 WHEN 0 THEN '[Review Re-run 1]: x' WHEN 1 THEN 'a' || chr(10) || '[Review Re-run 1]: x' || chr(10) || '[Review Re-run 2]: y' WHEN 2 THEN '' ELSE NULL END"
_OTHER = f"len({quantities('model_name')[0]}) > 0 AND len({quantities('title')[0]}) > 0 AND NOT list_has_any({quantities('model_name')[0]}, {quantities('title')[0]})"


@query("rematched_products", f"""{CANDIDATES}, d AS (SELECT product_id, url_key, arg_min({{'title': title, 'score': score, 'arrival': arrival}}, (-score, arrival, source)) AS b FROM cand WHERE valid GROUP BY product_id, url_key),
    v AS (SELECT d.product_id, url_key, row_number() OVER (PARTITION BY d.product_id ORDER BY b.score DESC, b.arrival, url_key) AS pos, p.model_name, b.title AS title, b.arrival AS arrival FROM d JOIN p USING (product_id)),
    j AS (SELECT product_id, pos, url_key, ({_OTHER}) OR arrival % 3 = 0 AS other FROM v), marks AS (SELECT p_partkey AS product_id, coalesce(len(regexp_extract_all({LOGS}, '\\[Review Re-run')), 0) AS done FROM part),
    f AS (SELECT j.*, done FROM j JOIN marks USING (product_id) WHERE pos = 1 AND other),
    r1 AS (SELECT f.product_id, done + 1 AS reruns, n.url_key, n.other FROM f LEFT JOIN j n ON n.product_id = f.product_id AND n.pos = 2 WHERE done < 2),
    r2 AS (SELECT r1.product_id, reruns + 1 AS reruns, n.url_key, n.other FROM r1 LEFT JOIN j n ON n.product_id = r1.product_id AND n.pos = 3 WHERE r1.other AND reruns < 2),
    e AS (SELECT product_id, url_key, 'blocked' AS outcome, done AS reruns FROM f WHERE done >= 2 UNION ALL SELECT product_id, url_key, CASE WHEN url_key IS NULL THEN 'skipped' WHEN other THEN 'blocked' ELSE 'rematched' END, reruns FROM r1 WHERE NOT coalesce(other AND reruns < 2, false)
      UNION ALL SELECT product_id, url_key, CASE WHEN url_key IS NULL THEN 'skipped' WHEN other THEN 'blocked' ELSE 'rematched' END, reruns FROM r2)
    SELECT product_id, url_key, outcome, CAST(reruns AS INT) AS reruns FROM e""")
def rematched_products(t: Tables):
    members, pages = matching.score_candidates(products(t), listings(t))
    # equal products share their pages; nothing was rejected before, so a product comes to as many of them as it has rounds, and one
    found = checkpointed(members.join(matching.first_pages(pages, fixed.MAX_REVIEW_RERUNS + 1, "target_id"), "target_id").drop("target_id"))

    def judge(rows):
        return rows.withColumn("mismatch", F.when(matching.capacity_conflict(F.col("model_name"), F.col("title")), F.lit("Capacity mismatch")).when(F.col("arrival") % 3 == 0, F.lit("Qualifier token mismatch")))

    logs = inputs.derive(t.part, {"product_id": "p_partkey", "log": LOGS})
    flagged = judge(matching.best_candidate(found)).where("mismatch IS NOT NULL").select("product_id", "url", F.col("mismatch").alias("reason")).join(logs, "product_id")
    memory = t.part.select(F.col("p_partkey").alias("product_id"), F.lit("x").alias("url"), F.lit("y").alias("reason"), F.lit(0).cast("bigint").alias("seq")).limit(0)
    ended, _ = matching.rematch(flagged, found, memory, judge)
    return ended.select("product_id", url_key(F.col("url")).alias("url_key"), "outcome", "reruns")


BRAND_TITLES = {"id": "p_partkey", "brand": "p_brand", "model": "CASE WHEN p_partkey % 4 = 0 THEN 'Nothing ' || p_name ELSE p_name END",
                "title": "CASE p_partkey % 8 WHEN 0 THEN 'Nothing ' || p_name WHEN 1 THEN p_name || ' for Apple Watch' WHEN 2 THEN 'boAt ' || p_name || ' Earbuds' WHEN 3 THEN p_brand || ' ' || p_name || ' vs Sony' WHEN 4 THEN 'Glow Gadget ' || p_name "
                         "WHEN 5 THEN p_name || ' compatible with Samsung phones' WHEN 6 THEN 'Fire-Boltt and JBL ' || p_name ELSE p_name || ' noise' END"}


def foreign_sql() -> str:
    arms = []
    for b in fixed.KNOWN_BRANDS:
        whole = rf"\b{b.replace('-', chr(92) + '-')}\b"
        before = f"rtrim(regexp_extract(lt, '(?s)^(.*?){whole}', 1))"
        after = f"ltrim(regexp_extract(lt, '{whole}(?s)(.*)$', 1))"
        arms.append(f"WHEN regexp_matches(lt, '{whole}') AND NOT regexp_matches(lower(model), '{whole}') AND NOT contains(lb, '{b}') AND NOT contains('{b}', lb) AND NOT regexp_matches({before}, '{fixed.COMPATIBILITY_BEFORE}') AND NOT regexp_matches({after}, '{fixed.DEVICE_AFTER}') THEN '{b}'")
    return f"CASE WHEN regexp_matches(lt, '\\b\\Q' || lb || '\\E\\b') THEN NULL {' '.join(arms)} END"


@query("foreign_brands", f"WITH t AS (SELECT {inputs.select(BRAND_TITLES)} FROM part), l AS (SELECT *, lower(title) AS lt, lower(trim(brand)) AS lb FROM t) SELECT id, {foreign_sql()} AS foreign_brand FROM l")
def foreign_brands(t: Tables):
    df = inputs.derive(t.part, BRAND_TITLES)
    return df.select("id", matching.foreign_brand(F.col("title"), F.col("model"), F.col("brand")).alias("foreign_brand"))


# --- verdicts -----------------------------------------------------------------------------------------

PRICES = {"order_id": "l_orderkey", "line": "l_linenumber", "price": "l_extendedprice / l_quantity", "dp": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE p_retailprice / 2 END", "mrp": "CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE p_retailprice END"}
FAR = "CASE WHEN price IS NULL OR price <= 0 OR price < 200 THEN false WHEN mrp > 0 THEN price > 2.0 * mrp OR price < 0.3 * mrp WHEN dp > 0 THEN price > 6.0 * dp OR price < 0.5 * dp ELSE false END"


@query("price_guard", f"WITH t AS (SELECT {inputs.select(PRICES)} FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT order_id, line, round(price, 6) AS price, {FAR} AS implausible FROM t")
def price_guard(t: Tables):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    df = inputs.derive(joined, PRICES)
    return df.select("order_id", "line", F.round("price", 6).alias("price"), matching.price_implausible(F.col("price"), F.col("dp"), F.col("mrp")).alias("implausible"))


# Every line of an order is one candidate page of a product; given decisions come from labels.
SEEN = {"product_id": "l_partkey", "source": "l_linenumber", "url": "'https://s.example/p/' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)", "title": "CASE WHEN l_linenumber % 3 = 0 THEN p_name || ' 10000mAh' WHEN l_linenumber % 3 = 1 THEN p_name || ' 20K' ELSE p_name END",
        "page_title": "CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE p_name END", "model_name": "CASE WHEN p_partkey % 2 = 0 THEN p_name || ' 20000mAh' ELSE p_name END", "page_price": "l_extendedprice / l_quantity", "dp": "p_retailprice / 2", "mrp": "p_retailprice",
        "valid": "l_discount > 0.02", "tied": "l_tax > 0.05", "rank": "l_orderkey", "order_id": "l_orderkey"}
GIVEN = {"doc_id": "doc_id", "decision": "CASE WHEN quality = 1 AND toxic = 0 THEN 'Match' WHEN toxic = 1 THEN 'not match' ELSE 'unclear' END"}
_CAP_MINE, _CAP_PAGE = quantities("model_name")[0], quantities("coalesce(" + sql_filled("page_title") + ", title) || ' ' || title || ' ' || replace(split_part(url, '/', -1), '-', ' ')")[0]
VERDICT_SQL = f"""WITH s AS (SELECT {inputs.select(SEEN)} FROM lineitem JOIN part ON l_partkey = p_partkey), g AS (SELECT {inputs.select(GIVEN)} FROM labels), j AS (SELECT s.*, replace(lower(g.decision), ' ', '_') AS given FROM s LEFT JOIN g ON g.doc_id = s.order_id),
    v AS (SELECT *, CASE WHEN len({_CAP_MINE}) > 0 AND len({_CAP_PAGE}) > 0 AND NOT list_has_any({_CAP_MINE}, {_CAP_PAGE}) THEN 'not_match' WHEN given IS NULL THEN CASE WHEN valid AND NOT tied THEN 'match' ELSE 'unsure' END
      WHEN given NOT IN ('match', 'not_match', 'unsure') THEN 'unsure' WHEN given = 'match' AND ({FAR.replace('price', 'page_price')}) THEN 'unsure' ELSE given END AS decision FROM j)"""


def seen(t: Tables):
    return inputs.derive(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")), SEEN)


def verified(t: Tables):
    pages = seen(t)
    given = inputs.derive(t.labels, GIVEN).join(pages.select("product_id", "url", "order_id"), F.col("doc_id") == F.col("order_id"))
    return matching.verdict(pages, given.select("product_id", "url", "decision", F.lit("given").alias("reason")))


@query("page_verdicts", f"{VERDICT_SQL} SELECT product_id, url, decision FROM v")
def page_verdicts(t: Tables):
    return verified(t).select("product_id", "url", "decision")


@query("picked_matches", f"{VERDICT_SQL} SELECT product_id, source, arg_min(url, rank) AS url FROM v WHERE decision = 'match' GROUP BY product_id, source")
def picked_matches(t: Tables):
    return matching.pick_match(verified(t)).select("product_id", "source", "url")


@query("collection_outcomes", f"""{VERDICT_SQL}, lost AS (SELECT p_partkey AS product_id FROM part WHERE p_partkey NOT IN (SELECT product_id FROM v WHERE decision = 'match' AND mrp > 980)), w AS (SELECT * FROM v WHERE NOT (decision = 'match' AND mrp <= 980)),
    n AS (SELECT *, row_number() OVER (PARTITION BY product_id, decision ORDER BY source, rank, url) AS i FROM w), a AS (SELECT product_id, string_agg(title || ' (' || url || ')', ' | ' ORDER BY i) FILTER (WHERE decision = 'unsure') AS options,
      string_agg(title || ' — ' || 'why', '; ' ORDER BY i) FILTER (WHERE decision = 'not_match') AS rejections FROM n WHERE i <= 3 GROUP BY product_id)
    SELECT product_id, 'Skipped' AS status, CASE WHEN options IS NOT NULL THEN 'Skipped: Needs your pick — could not confirm automatically. Options: ' || options WHEN rejections IS NOT NULL THEN 'Skipped: Product pages found were verified as a different product: ' || rejections
      WHEN product_id % 3 = 1 THEN 'Skipped: Multiple candidates found: a, b — model name may be ambiguous or outdated' WHEN product_id % 3 = 2 THEN 'Skipped: Candidate found: a — model name may be ambiguous or outdated' ELSE 'Skipped: All spec tiers exhausted (including Vision) without finding technical specifications' END AS flags
    FROM lost LEFT JOIN a USING (product_id)""")
def collection_outcomes(t: Tables):
    seen_pages = verified(t).where("NOT (decision = 'match' AND mrp <= 980)").withColumns({"source_rank": F.col("source"), "decision_reason": F.lit("why")})
    names = t.part.select(F.col("p_partkey").alias("product_id"), F.explode(F.expr("CASE WHEN p_partkey % 3 = 1 THEN array('a', 'b') WHEN p_partkey % 3 = 2 THEN array('a') ELSE array() END")).alias("name"))
    names = names.withColumn("name_rank", F.when(F.col("name") == "a", 1).otherwise(2))
    out = matching.collection_outcome(t.part.select(F.col("p_partkey").alias("product_id")), seen_pages, names)
    return out.withColumnsRenamed({"Status": "status", "Flags": "flags"})


MEMORY = {"product_id": "user_id", "url": "'https://s.example/' || CAST(event_id % 90 AS STRING)", "reason": "event_type || ': ' || CAST(event_id AS STRING)", "seq": "event_id", "decision": "CASE event_type WHEN 'error' THEN 'not_match' WHEN 'signup' THEN 'delisted' ELSE event_type END"}


def memory(t: Tables):
    return matching.remember_rejections(inputs.derive(t.events, MEMORY).where("decision not in ('not_match', 'delisted')"), inputs.derive(t.events, MEMORY))


REMEMBERED = f"""WITH e AS (SELECT {inputs.select(MEMORY)} FROM events), a AS (SELECT product_id, url, CASE WHEN decision IN ('not_match', 'delisted') THEN decision || ': ' || reason ELSE reason END AS reason, seq FROM e),
    m AS (SELECT product_id, url, arg_max(reason, seq) AS reason, min(seq) AS seq FROM a GROUP BY product_id, url), k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq DESC, url DESC) AS n FROM m)"""


@query("rejection_memory", f"{REMEMBERED} SELECT product_id, url, reason, seq FROM k WHERE n <= 40")
def rejection_memory(t: Tables):
    return memory(t)


DECISIONS = {**MEMORY, "title": "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN NULL ELSE 'Page ' || CAST(event_id AS STRING) END", "provider": "CASE WHEN event_id % 2 = 0 THEN 'model-a' ELSE NULL END"}


@query("verifier_notes", f"""WITH v AS (SELECT {inputs.select(DECISIONS)} FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq DESC, url DESC) AS n FROM v)
    SELECT product_id, 'Verifier: ' || string_agg(decision || ' ' || coalesce(nullif(title, ''), url) || coalesce(' (' || provider || ')', ''), '; ' ORDER BY n DESC) AS note FROM n WHERE n <= 6 GROUP BY product_id""")
def verifier_notes(t: Tables):
    return matching.verifier_notes(inputs.derive(t.events, DECISIONS))


@query("rejection_memory_kept", f"{REMEMBERED} SELECT product_id, url, reason, seq FROM k WHERE n <= 40 AND (reason LIKE 'not_match%' OR reason LIKE 'delisted%')")
def rejection_memory_kept(t: Tables):
    return matching.forget_soft_rejections(memory(t))


@query("rejection_cells", f"{REMEMBERED} SELECT product_id, string_agg(url || ' | ' || reason, chr(10) ORDER BY seq) AS rejected_urls FROM k WHERE n <= 40 GROUP BY product_id")
def rejection_cells(t: Tables):
    return matching.format_rejections(memory(t)).withColumnRenamed("Rejected_URLs", "rejected_urls")


@query("parsed_rejections", f"""{WITH_CATALOGUE} SELECT Product_ID AS product_id, 'https://www.store.example/a' AS url, 'not_match: other' AS reason, 0 AS seq FROM catalogue WHERE Rejected_URLs IS NOT NULL
    UNION ALL SELECT Product_ID, 'https://www.store.example/b', 'collision: page taken', 1 FROM catalogue WHERE Rejected_URLs IS NOT NULL""")
def parsed_rejections(t: Tables):
    return matching.parse_rejections(inputs.catalogue(t)).withColumn("seq", F.col("seq").cast("int"))


CLAIMS = {"product_id": "p_partkey", "brand": "p_brand", "model_name": "p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' || CAST(p_size AS STRING) END", "title": "p_name", "row_order": "p_partkey",
          "url": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'https://s.example/products/' || replace(p_name, ' ', '-') END"}
FALLBACK = {"product_id": "p_partkey", "url": "'https://s.example/products/' || replace(p_name, ' ', '-') || '-' || CAST(p_size AS STRING)", "title": "p_name || ' ' || CAST(p_size AS STRING)", "score": "CAST(100 + p_size AS DOUBLE)", "arrival": "p_partkey"}


# Products propose one after another; a page keeps the best claim it has seen.
_NOTHING = "CAST(NULL AS VARCHAR)"
_SLUG = "replace(split_part(split_part({0}, '/', -1), '?', 1), '-', ' ')"
WISHES_SQL = f"""WITH RECURSIVE c AS (SELECT *, lower(trim(brand)) AS area, lower(rtrim(trim(url), '/')) AS url_key FROM (SELECT {inputs.select(CLAIMS)} FROM part)), f AS (SELECT *, lower(rtrim(trim(url), '/')) AS url_key FROM (SELECT {inputs.select(FALLBACK)} FROM part)),
    fought AS (SELECT DISTINCT area FROM (SELECT area, url_key FROM c WHERE url IS NOT NULL GROUP BY ALL HAVING count(*) > 1)), k AS (SELECT * FROM c WHERE url IS NOT NULL AND area IN (FROM fought)),
    w0 AS (SELECT product_id, brand, model_name, row_order, area, url, url_key, title, 0 AS later, CAST(0 AS DOUBLE) AS s, CAST(-1 AS BIGINT) AS arrival FROM k UNION ALL SELECT k.product_id, k.brand, k.model_name, k.row_order, k.area, f.url, f.url_key, f.title, 1, -f.score, f.arrival FROM k JOIN f USING (product_id)),
    w1 AS (SELECT *, row_number() OVER (PARTITION BY product_id, url_key ORDER BY later, s, arrival) AS again FROM w0), wish AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY later, s, arrival, url_key) AS pos FROM w1 WHERE again = 1),"""
COLLISIONS_SQL = f"""{pairs_sql(
    f"SELECT DISTINCT product_id, brand, {_NOTHING} AS category, model_name, {_NOTHING} AS target_capacity, CAST(NULL AS VARCHAR[]) AS qualifiers FROM wish",
    f"SELECT DISTINCT {_NOTHING} AS store_brand, title, url_key AS url FROM wish",
    f"(SELECT DISTINCT brand AS q_brand, model_name AS q_model, title AS q_title, {_SLUG.format('url_key')} AS q_slug FROM wish) q JOIN targets p ON p.brand = q_brand AND p.model_name = q_model JOIN texts l ON l.title = q_title AND l.slug = q_slug",
    WISHES_SQL)},
    wants AS (SELECT w.*, x.score FROM wish w JOIN (SELECT DISTINCT brand, model_name, title, slug, score FROM scored) x ON x.brand = w.brand AND x.model_name = w.model_name AND x.title = w.title AND x.slug = {_SLUG.format('w.url_key')}),
    r AS (SELECT 0 AS i, product_id, CAST(1 AS BIGINT) AS pos FROM wants WHERE pos = 1 UNION ALL SELECT i + 1, product_id, CASE WHEN lost THEN pos + 1 ELSE pos END FROM (SELECT *, max(lost::INT) OVER () AS moving FROM (
      SELECT r.i, r.product_id, r.pos, w.area IS NOT NULL AND row_number() OVER (PARTITION BY w.area, w.url_key ORDER BY w.score DESC, w.row_order, r.product_id) > 1 AS lost FROM r LEFT JOIN wants w USING (product_id, pos))) WHERE moving = 1),
    e AS (SELECT product_id, pos FROM r WHERE i = (SELECT max(i) FROM r))
    SELECT c.product_id, c.brand, CASE WHEN e.product_id IS NULL THEN c.url ELSE wants.url END AS url FROM c LEFT JOIN e USING (product_id) LEFT JOIN wants ON wants.product_id = e.product_id AND wants.pos = e.pos"""


@query("collision_winners", COLLISIONS_SQL)
def collision_winners(t: Tables):
    now, _ = matching.resolve_collisions(inputs.derive(t.part, CLAIMS), inputs.derive(t.part, FALLBACK))
    return now.select("product_id", "brand", "url")


# --- variant words, mentions --------------------------------------------------------------------------

MODELS = {"brand": "p_brand", "model_name": "CASE p_partkey % 4 WHEN 0 THEN p_name || ' 10000mAh' WHEN 1 THEN p_name || ' Mini' WHEN 2 THEN p_type || ' ' || p_name ELSE p_name || ' - for travel' END"}


@query("qualifier_tokens", f"""WITH m AS (SELECT {inputs.select(MODELS)}, p_partkey AS id FROM part), w AS (SELECT DISTINCT id, brand, unnest(regexp_extract_all(lower({replace(r"regexp_split_to_array(model_name, '\s*[-–—|/]\s*')[1]", r'(?i)\b\d+(?:,\d+)*(?:\.\d+)?\s*(?:mah|w|v|a)\b')}), '[a-z0-9]+')) AS word FROM m),
    g AS (SELECT * FROM w WHERE length(word) > 1), s AS (SELECT * FROM g WHERE NOT list_contains({listed(fixed.QUALIFIER_EXCLUDED)}, word) AND NOT regexp_matches(word, '^[0-9]+$')),
    pairs AS (SELECT DISTINCT a.brand, a.id AS i, b.id AS j FROM s a JOIN s b ON a.brand = b.brand AND a.word = b.word AND a.id <> b.id)
    SELECT DISTINCT p.brand, upper(x.word[1]) || x.word[2:] AS token FROM pairs p JOIN s x ON x.id = p.i WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.id = p.j AND y.word = x.word)""")
def qualifier_tokens(t: Tables):
    return matching.derive_qualifiers(inputs.derive(t.part, MODELS))


@query("qualifier_lists", f"""WITH d AS (SELECT DISTINCT p_brand AS brand, upper(p_name[1]) || p_name[2:] AS token FROM part UNION SELECT DISTINCT p_brand, 'Pro' FROM part)
    SELECT brand, token, CAST({len(fixed.DEFAULT_QUALIFIERS)} AS INT) AS pos FROM d WHERE NOT list_contains({listed(fixed.DEFAULT_QUALIFIERS)}, token) UNION ALL
    SELECT brand, q.token, CAST(q.i AS INT) FROM (SELECT DISTINCT brand FROM d) CROSS JOIN (SELECT unnest({listed(fixed.DEFAULT_QUALIFIERS)}) AS token, unnest(range({len(fixed.DEFAULT_QUALIFIERS)})) AS i) q""")
def qualifier_lists(t: Tables):
    derived = t.part.select(F.col("p_brand").alias("brand"), F.expr("upper(substring(p_name, 1, 1)) || substring(p_name, 2)").alias("token")).union(
        t.part.select("p_brand", F.lit("Pro"))).distinct()
    return matching.qualifier_list(derived)


def benchmark_words(t: Tables, scope: str):
    """The words of the benchmark as model names of every language of the documents; those are one short list."""
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("model_name"))
    langs = t.documents.agg(F.collect_set("lang").alias("_langs"))
    return words.join(F.broadcast(langs)).select(F.explode("_langs").alias(scope), "model_name")


@query("model_mentions", """WITH m AS (SELECT DISTINCT lang AS scope, w AS model_name FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM benchmark) CROSS JOIN (SELECT DISTINCT lang FROM documents) WHERE regexp_matches(w, '^[a-z]{6,}$')),
    d AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents)
    SELECT m.scope, m.model_name, d.doc_id AS text_id FROM m JOIN d ON d.lang = m.scope AND d.w = m.model_name""")
def model_mentions(t: Tables):
    words = benchmark_words(t, "scope")
    texts = t.documents.select(F.col("lang").alias("scope"), F.col("doc_id").alias("text_id"), "text")
    return matching.model_mentions(words.where(F.col("model_name").rlike("^[a-z]{6,}$")), texts)


# --- tier merge ---------------------------------------------------------------------------------------

# Four fields per order line, several of them empty; the supplier is the source, its number modulo 4 the tier.
FIELDS = {"capacity": "CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INT) ELSE NULL END", "output": "CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS INT) ELSE NULL END",
          "ports": "CASE WHEN l_linestatus = 'O' AND l_linenumber > 2 THEN l_linenumber ELSE NULL END", "weight": "CASE WHEN l_discount > 0.07 THEN l_linenumber ELSE NULL END"}
OBS_BASE = {"product_id": "l_partkey", "source_url": "'https://s' || CAST(l_suppkey AS STRING) || '.example/p'", "tier_rank": "CAST(l_suppkey % 4 AS INT)", "tier_label": "CAST(l_suppkey % 4 AS STRING)", "seq": "l_orderkey * 10 + l_linenumber"}
OBS_SQL = " UNION ALL ".join(f"SELECT {inputs.select(OBS_BASE)}, '{f}' AS field, CAST({e} AS STRING) AS value FROM lineitem" for f, e in FIELDS.items())
FIRST_SQL = f"WITH o AS ({OBS_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY product_id, field ORDER BY tier_rank, seq) AS n FROM o WHERE value IS NOT NULL)"


def observations(t: Tables):
    line = inputs.derive(t.lineitem, {**OBS_BASE, **{f: f"CAST({e} AS STRING)" for f, e in FIELDS.items()}})
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])
    return line.select(*OBS_BASE, F.inline(entries).alias("field", "value"))


def parts(t: Tables):
    return t.part.select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") % 2 == 0, F.lit("Powerbank")).otherwise(F.lit("Cable")).alias("category"), F.when(F.col("p_size") % 5 == 0, F.lit("999")).alias("MRP_Display"))


@query("tier_merge", f"{FIRST_SQL} SELECT product_id, field, value, source_url, tier_label, tier_rank FROM f WHERE n = 1")
def tier_merge(t: Tables):
    return merge.first_values(observations(t))


STOP_SQL = f"""{FIRST_SQL}, a AS (SELECT * FROM f WHERE n = 1), s AS (SELECT product_id, list_sort(list(tier_rank)) AS ranks FROM a GROUP BY product_id), c AS (SELECT s.product_id, ranks[CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END] AS stop_rank FROM s JOIN part ON p_partkey = s.product_id)"""


@query("tier_sufficiency", f"{STOP_SQL} SELECT a.product_id, a.field, a.value, a.source_url, a.tier_label, a.tier_rank FROM a JOIN c USING (product_id) WHERE c.stop_rank IS NULL OR a.tier_rank <= c.stop_rank")
def tier_sufficiency(t: Tables):
    return merge.merge_by_tier(observations(t), parts(t))


PRICE_OBS = {**OBS_BASE, "field": "'mrp'", "value": "CASE WHEN l_tax < 0.02 THEN '0' WHEN l_tax < 0.04 THEN NULL ELSE CAST(l_orderkey AS STRING) END"}


@query("merged_prices", f"""WITH o AS (SELECT {inputs.select(PRICE_OBS)} FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY tier_rank, seq) AS n FROM o WHERE try_cast(value AS DOUBLE) > 0)
    SELECT product_id, field, value, source_url, tier_label, tier_rank FROM f WHERE n = 1 AND product_id NOT IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0)""")
def merged_prices(t: Tables):
    return merge.merge_price(inputs.derive(t.lineitem, PRICE_OBS), parts(t))


PAGE_ROWS = {**OBS_BASE, "tier_name": "'tier-' || CAST(l_suppkey % 4 AS STRING) || ': s' || CAST(l_suppkey AS STRING)", "description": "CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag || CAST(l_orderkey AS STRING) END"}


def page_rows(t: Tables):
    return inputs.derive(t.lineitem, PAGE_ROWS).withColumn("images", F.expr("CASE WHEN substring(description, 1, 1) = 'A' THEN array(source_url || '/1.png', source_url || '/2.png') ELSE array() END"))


@query("merged_pages", f"""WITH o AS (SELECT {inputs.select(PAGE_ROWS)} FROM lineitem), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, tier_rank ORDER BY seq) AS n FROM o) WHERE n = 1)
    SELECT product_id, arg_min(source_url, tier_rank) AS source_url, arg_min(tier_label, tier_rank) AS tier_label, coalesce(string_agg(description, chr(10) ORDER BY tier_rank) FILTER (WHERE description <> ''), '') AS description,
    arg_min(source_url || '/1.png ' || source_url || '/2.png', tier_rank) FILTER (WHERE description LIKE 'A%') AS images, string_agg(tier_name, ' + ' ORDER BY tier_rank) AS provenance FROM u GROUP BY product_id""")
def merged_pages(t: Tables):
    return merge.merge_pages(page_rows(t)).withColumn("images", F.array_join("images", " "))


@query("merged_provenance", f"""{STOP_SQL}, k AS (SELECT a.* FROM a JOIN c USING (product_id) WHERE c.stop_rank IS NULL OR a.tier_rank <= c.stop_rank), o2 AS (SELECT {inputs.select(PAGE_ROWS)} FROM lineitem), pg AS (SELECT product_id, arg_min(source_url, tier_rank * 10000000 + seq) AS source_url FROM o2 GROUP BY product_id)
    SELECT p_partkey AS product_id, pg.source_url AS page, {', '.join(f"max(value) FILTER (WHERE field = '{f}') AS {f}, max(k.source_url) FILTER (WHERE field = '{f}') AS {f}_source, max(k.tier_label) FILTER (WHERE field = '{f}') AS {f}_tier" for f in FIELDS)}
    FROM part LEFT JOIN k ON k.product_id = p_partkey LEFT JOIN pg ON pg.product_id = p_partkey GROUP BY p_partkey, pg.source_url""")
def merged_provenance(t: Tables):
    wide = merge.wide_provenance(merge.merge_by_tier(observations(t), parts(t)), merge.merge_pages(page_rows(t)), parts(t))
    picked = [F.col(f"{part}_Spec_{f.capitalize()}").alias(name) for f in FIELDS for part, name in (("Raw", f), ("Source", f"{f}_source"), ("Tier", f"{f}_tier"))]
    return wide.select("product_id", F.col("Source_URL").alias("page"), *picked)


CONFIG_BRANDS = {"brand": "CASE WHEN n_regionkey = 0 THEN '_default' ELSE n_name END", "category": "CASE WHEN n_regionkey = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'Powerbank' END"}


@query("retail_order_ranks", """SELECT n_name AS brand, CAST(i AS INT) AS store_rank, CASE WHEN n_regionkey = 1 THEN ['reliance', 'croma'] ELSE ['store' || n_regionkey, 'croma'] END[i + 1] AS store FROM nation CROSS JOIN range(2) r(i)""")
def retail_order_ranks(t: Tables):
    config = t.nation.select(F.col("n_name").alias("brand"), F.when(F.col("n_regionkey") != 1, F.array(F.concat(F.lit("store"), "n_regionkey"), F.lit("croma"))).alias("retail_order"))
    return merge.retail_ranks(config)


AUDIT = {"doc_id": "doc_id", "brand": "'B'", "quality_score": "CAST(doc_id % 11 AS INT)", "is_isolated_packshot": "quality = 1", "is_correct_brand_and_model": "doc_id % 5 <> 0", "has_promotional_text_banner": "toxic = 1", "has_hand_holding": "doc_id % 7 = 0",
         "detected_brand": "CASE WHEN doc_id % 2 = 0 THEN 'Other' ELSE NULL END", "rejection_reason": "CASE WHEN doc_id % 3 = 0 THEN 'busy' ELSE '' END"}


@query("image_gate", f"""WITH a AS (SELECT {inputs.select(AUDIT)} FROM labels), r AS (SELECT *, CASE WHEN NOT is_correct_brand_and_model THEN 'Wrong brand detected: ''' || coalesce(detected_brand, '') || ''' (expected ''B'')' WHEN has_promotional_text_banner THEN 'Marketing infographic banner with promotional text overlays'
    WHEN has_hand_holding THEN 'Hand-held lifestyle shot instead of isolated studio packshot' WHEN quality_score < 7 OR NOT is_isolated_packshot THEN coalesce(nullif(rejection_reason, ''), 'Low visual packshot quality / complex lifestyle background') END AS rejection FROM a)
    SELECT doc_id, rejection IS NULL AS approved, CASE WHEN NOT is_correct_brand_and_model THEN 0 ELSE quality_score END AS score, rejection FROM r""")
def image_gate(t: Tables):
    return inputs.derive(t.labels, AUDIT).select("doc_id", merge.image_gate().alias("g")).select("doc_id", "g.*")


IMAGES = {"product_id": "l_partkey", "tier": "CASE WHEN l_linenumber % 3 = 0 THEN 3 ELSE 1 END", "pos": "CAST(l_orderkey % 9 AS INT)", "url": "'https://c/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING)", "source": "CASE WHEN l_linenumber % 3 = 0 THEN 'amazon' ELSE 'brand-product-page' END",
          "approved": "l_tax > 0.075", "score": "CAST(l_quantity AS INT) % 7", "rejection": "'r' || l_returnflag", "line": "l_extendedprice"}


@query("image_tier_pick", f"""WITH c AS (SELECT product_id, tier, pos, arg_min(url, line) AS url, arg_min(source, line) AS source, arg_min(approved, line) AS approved, arg_min(score, line) AS score, arg_min(rejection, line) AS rejection FROM (SELECT {inputs.select(IMAGES)} FROM lineitem) GROUP BY product_id, tier, pos),
    u AS (SELECT * FROM c WHERE (tier = 1 AND pos < 6) OR tier = 3), ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY tier, pos) AS n FROM u WHERE approved) WHERE n = 1),
    fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, tier, pos) AS n FROM u WHERE NOT approved AND score > 0) WHERE n = 1), fi AS (SELECT p_partkey, 700 + p_size * 3 AS w FROM part WHERE p_size % 4 = 0)
    SELECT p.p_partkey AS product_id, CASE WHEN w >= 800 THEN 'ok' WHEN w IS NOT NULL THEN 'low-res' WHEN ok.url IS NOT NULL THEN 'ok' WHEN fb.url IS NOT NULL THEN 'needs-better-image' ELSE 'missing' END AS image_status,
    CASE WHEN w IS NOT NULL THEN 'local-verified' WHEN ok.url IS NOT NULL THEN ok.source WHEN fb.url IS NOT NULL THEN fb.source || ' (Score ' || fb.score || '/10: ' || fb.rejection || ')' END AS image_source,
    CASE WHEN w IS NOT NULL THEN '1' WHEN ok.url IS NOT NULL THEN CAST(ok.tier AS VARCHAR) ELSE CAST(fb.tier AS VARCHAR) END AS image_tier, CASE WHEN w IS NOT NULL THEN NULL WHEN ok.url IS NOT NULL THEN ok.url ELSE fb.url END AS image_url
    FROM part p LEFT JOIN ok ON ok.product_id = p.p_partkey LEFT JOIN fb ON fb.product_id = p.p_partkey LEFT JOIN fi ON fi.p_partkey = p.p_partkey""")
def image_tier_pick(t: Tables):
    rows = inputs.derive(t.lineitem, IMAGES)
    entry = F.min_by(F.struct("url", "source", "approved", "score", "rejection"), "line")
    pictures = rows.groupBy("product_id", "tier", "pos").agg(entry.alias("_e")).select("product_id", "tier", "pos", "_e.*")
    wanted = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_partkey").cast("string").alias("image_path"))
    files = t.part.where("p_size % 4 = 0").select(F.col("p_partkey").cast("string").alias("path"), (700 + F.col("p_size") * 3).alias("width"), F.lit(900).alias("height"))
    out = merge.pick_images(wanted, pictures, files)
    return out.withColumnsRenamed({"Image_Status": "image_status", "Image_Source": "image_source", "Image_Tier": "image_tier", "Image_URL": "image_url"})


@query("collected_copy", f"""{WITH_CATALOGUE} SELECT Product_ID AS product_id, CASE WHEN Model_Name NOT LIKE '%Pro%' THEN 'T ' || Model_Name END AS raw_title, CASE WHEN Model_Name NOT LIKE '%Pro%' THEN Source_URL END AS source_title, CASE WHEN Model_Name NOT LIKE '%Pro%' THEN '2' END AS tier_title,
    CAST(NULL AS VARCHAR) AS raw_bullet_3, CAST(NULL AS VARCHAR) AS source_bullet_3, CASE WHEN Model_Name NOT LIKE '%Pro%' THEN Status ELSE 'Deferred' END AS status, CASE WHEN Model_Name LIKE '%Pro%' THEN 'Deferred: LLM copy drafting failed due to infrastructure error' END AS flags FROM catalogue""")
def collected_copy(t: Tables):
    rows = inputs.catalogue(t)
    found = rows.select(F.col("Product_ID").alias("product_id"), "Source_URL", F.lit("2").alias("tier_label"), "Status", "Flags")
    drafts = rows.where("Model_Name NOT LIKE '%Pro%'").select(F.col("Product_ID").alias("product_id"), F.concat(F.lit("T "), "Model_Name").alias("title"), *[F.lit("x").alias(c) for c in ("subtitle", "bullet_1", "bullet_2")], F.lit(" ").alias("bullet_3"), F.lit(None).cast("string").alias("bullet_4"))
    out = merge.with_copy(found, drafts)
    return out.select("product_id", F.col("Raw_Title").alias("raw_title"), F.col("Source_Title").alias("source_title"), F.col("Tier_Title").alias("tier_title"), F.col("Raw_Bullet_3").alias("raw_bullet_3"),
                      F.col("Source_Bullet_3").alias("source_bullet_3"), F.col("Status").alias("status"), F.col("Flags").alias("flags"))


# --- onboarding ---------------------------------------------------------------------------------------

RAW_SHEET = {"Item": "' ' || p_name", "Rate A": "CASE WHEN p_size % 3 = 0 THEN 'Rs' ELSE CAST(p_size * 30 AS STRING) END", "List Rate": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE '₹1,' || lpad(CAST(p_size AS STRING), 3, '0') END", "id": "p_partkey"}


@query("price_columns", f"""WITH s AS (SELECT trim(' ' || p_name) AS model_name, {duck.price(RAW_SHEET['Rate A'])} AS a, {duck.price(RAW_SHEET['List Rate'])} AS b, p_partkey AS id FROM part)
    SELECT id, model_name, least(coalesce(a, b), coalesce(b, a)) AS dp, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS mrp FROM s""")
def price_columns(t: Tables):
    raw = inputs.derive(t.part, RAW_SHEET)
    return onboarding.map_price_columns(raw, {"Item": "Model_Name", "Rate A": "DP", "List Rate": "MRP"})


SHEET_ROWS = {"brand_name": "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE lower(p_brand) END", "brand_code": "'B' || substring(p_brand, 7)", "category": "CASE WHEN p_size % 2 = 0 THEN 'Powerbank' ELSE 'Cable' END", "row_idx": "p_partkey", "model_name": "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END",
              "display_name": "p_name", "dp": "floor(p_retailprice / 10) * 10", "mrp": "CAST(p_size * 100 AS DOUBLE)", "notes": "CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'n' END"}
WITH_SHEET = f"WITH s AS (SELECT {inputs.select(SHEET_ROWS)} FROM part)"


def sheet(t: Tables):
    return inputs.derive(t.part, SHEET_ROWS).withColumn("dp", F.col("dp").cast("double"))


@query("sheet_duplicates", f"""{WITH_SHEET}, f AS (SELECT *, min(row_idx) OVER (PARTITION BY lower(trim(brand_name)), lower(trim(model_name)), dp) AS duplicates_row_idx FROM s)
    SELECT brand_name, model_name, CAST(dp AS DOUBLE) AS dp, row_idx, duplicates_row_idx FROM f WHERE row_idx > duplicates_row_idx""")
def sheet_duplicates(t: Tables):
    return onboarding.sheet_duplicates(sheet(t))


@query("onboarding_summary", f"""{WITH_SHEET}, f AS (SELECT *, min(row_idx) OVER (PARTITION BY lower(brand_name), lower(model_name), dp) AS first, row_number() OVER (PARTITION BY brand_name ORDER BY row_idx) AS n FROM s)
    SELECT brand_name, row_idx, 'PB-' || brand_code || '-' || CASE WHEN n >= 1000 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 3, '0') END AS preview_id, model_name, display_name, format('{{:,}}', CAST(trunc(dp) AS BIGINT)) AS dp, format('{{:,}}', CAST(trunc(mrp) AS BIGINT)) AS mrp,
    coalesce(notes, '-') AS notes, CASE WHEN row_idx > first THEN first END AS duplicates_row_idx FROM f""")
def onboarding_summary(t: Tables):
    return onboarding.onboarding_summary(sheet(t))


# Numbers are taken out of the middle of the existing ids, and by another brand above the highest own one.
EXISTING = {"Product_ID": "'PB-B' || substring(p_brand, 7) || '-' || lpad(CAST(p_size AS STRING), 3, '0')", "Brand": "CASE WHEN p_size > 20 THEN 'someone else' ELSE p_brand END", "Category": "'Powerbank'", "Model_Name": "p_name", "Status": "CASE WHEN p_size % 2 = 0 THEN 'Approved' ELSE 'Skipped' END", "Flags": "'old'"}
KEYED = "SELECT lower(p_brand) AS b, lower(p_name) AS m FROM part WHERE p_size > 10 AND p_size <= 20"
IDS_SQL = f"""{WITH_SHEET}, e AS (SELECT DISTINCT {inputs.select(EXISTING)} FROM part WHERE p_size > 10), n AS (SELECT *, CASE category WHEN 'Powerbank' THEN 'PB' ELSE 'CB' END || '-' || brand_code AS g FROM s),
    x AS (SELECT Brand, regexp_extract(Product_ID, '^(.*)-(\\d+)$', 1) AS g, CAST(regexp_extract(Product_ID, '^(.*)-(\\d+)$', 2) AS BIGINT) AS q FROM e), b AS (SELECT g, coalesce((SELECT max(q) FROM x WHERE x.g = n2.g AND lower(x.Brand) IN (SELECT lower(brand_name) FROM n WHERE n.g = n2.g)), 0) + 1 AS base FROM (SELECT DISTINCT g FROM n) n2),
    free AS (SELECT b.g, i AS q, row_number() OVER (PARTITION BY b.g ORDER BY i) AS k FROM b CROSS JOIN range(1, 100000) r(i) WHERE i >= base AND i < base + 30000 AND NOT EXISTS (SELECT 1 FROM x WHERE x.g = b.g AND x.q = i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY lower(trim(brand_name)), row_idx) AS k FROM n)"""


def existing(t: Tables):
    return schema.catalogue(inputs.derive(t.part.where("p_size > 10"), EXISTING).distinct())


@query("next_product_ids", f"""{IDS_SQL} SELECT r.row_idx, r.g || '-' || CASE WHEN q >= 1000 THEN CAST(q AS VARCHAR) ELSE lpad(CAST(q AS VARCHAR), 3, '0') END AS product_id FROM r JOIN free ON free.g = r.g AND free.k = r.k""")
def next_product_ids(t: Tables):
    return onboarding.assign_product_ids(sheet(t), existing(t)).select("row_idx", "product_id")


OWNED = {"Product_ID": "'PB-' || lpad(CAST(p_partkey AS STRING), 7, '0')", "Brand": "p_brand", "Category": "'powerbank'", "Model_Name": "p_name", "Display_Name": "'old'", "Status": "CASE p_partkey % 3 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Skipped' ELSE 'Blocked' END", "Flags": "'old'", "Attempts": "2", "row_order": "p_partkey"}


def owned(t: Tables):
    firsts = t.part.where("p_size > 25").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return schema.catalogue(inputs.derive(firsts, OWNED))


def sheet_keys(t: Tables):
    keyed = t.part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey"), F.max("p_size").alias("p_size"))
    return keyed.select(F.upper("p_brand").alias("brand_name"), F.lit("X").alias("brand_code"), F.lit("Powerbank").alias("category"), F.col("p_partkey").alias("row_idx"), F.upper("p_name").alias("model_name"),
                        F.lit("new").alias("display_name"), F.col("p_partkey").cast("double").alias("dp"), F.lit(None).cast("double").alias("mrp"))


@query("upsert_sheet", f"""WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part WHERE p_size > 25 GROUP BY ALL), c AS (SELECT {inputs.select(OWNED)} FROM f), k AS (SELECT p_brand, p_name, min(p_partkey) AS row_idx FROM part GROUP BY ALL),
    i AS (SELECT k.*, row_number() OVER (ORDER BY lower(p_brand), row_idx) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.Brand = k.p_brand AND c.Model_Name = k.p_name))
    SELECT Product_ID AS product_id, 'Powerbank' AS category, 'new' AS display_name, CAST(row_idx AS DOUBLE) AS dp, CASE WHEN Status = 'Skipped' THEN 'Pending' ELSE Status END AS status, CASE WHEN Status = 'Skipped' THEN 0 ELSE 2 END AS attempts, CASE WHEN Status = 'Skipped' THEN NULL ELSE 'old' END AS flags, 'updated' AS upsert
    FROM c JOIN k ON c.Brand = k.p_brand AND c.Model_Name = k.p_name UNION ALL SELECT 'PB-X-' || CASE WHEN n >= 1000 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 3, '0') END, 'Powerbank', 'new', CAST(row_idx AS DOUBLE), 'Pending', 0, NULL, 'inserted' FROM i""")
def upsert_sheet(t: Tables):
    out = onboarding.upsert_price_sheet(owned(t), sheet_keys(t), "row_order")
    return out.select(F.col("Product_ID").alias("product_id"), F.col("Category").alias("category"), F.col("Display_Name").alias("display_name"), F.col("MRP_Input").alias("dp"), F.col("Status").alias("status"), F.col("Attempts").alias("attempts"), F.col("Flags").alias("flags"), "upsert")


GOLD_A = {"product_id": "p_partkey", "source_url": "CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'https://www.s.example/' || p_name || '/?v=1' ELSE 'https://s.example/' || p_name END"}
GOLD_B = {"product_id": "p_partkey", "source_url": "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'https://s.example/other' ELSE 'https://s.example/' || p_name END"}


def golden_norm(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN replace(rtrim(split_part({x}, '?', 1), '/'), 'www.', '') END"


@query("golden_diff", f"""WITH a AS (SELECT {inputs.select(GOLD_A)} FROM part WHERE p_type <> 'SMALL'), b AS (SELECT {inputs.select(GOLD_B)} FROM part WHERE p_type <> 'LARGE')
    SELECT coalesce(a.product_id, b.product_id) AS product_id, CASE WHEN a.product_id IS NULL THEN 'missing in replay' WHEN b.product_id IS NULL THEN 'missing in baseline' ELSE 'source_url' END AS field, a.source_url AS actual, b.source_url AS expected
    FROM a FULL OUTER JOIN b ON a.product_id = b.product_id WHERE a.product_id IS NULL OR b.product_id IS NULL OR {golden_norm('a.source_url')} IS DISTINCT FROM {golden_norm('b.source_url')}""")
def golden_diff(t: Tables):
    return onboarding.golden_diff(inputs.derive(t.part.where("p_type <> 'SMALL'"), GOLD_A), inputs.derive(t.part.where("p_type <> 'LARGE'"), GOLD_B))


EDITS = {"product_id": "'pb-' || lpad(CAST(l_partkey AS STRING), 7, '0')", "seq": "l_orderkey * 10 + l_linenumber", "field": "CASE l_linenumber WHEN 1 THEN 'title' WHEN 2 THEN 'subtitle' WHEN 3 THEN 'bullet_1' WHEN 4 THEN 'dp' WHEN 5 THEN 'mrp' ELSE 'bullet_4' END",
         "value": "CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linenumber IN (4, 5) THEN CASE WHEN l_tax > 0.06 THEN '-1' WHEN l_tax > 0.05 THEN 'x' ELSE CAST(l_orderkey AS STRING) END WHEN l_discount > 0.08 THEN repeat('long text ', 9) ELSE ' t' || CAST(l_orderkey AS STRING) || ' ' END"}
EDITS_SQL = f"""{WITH_CATALOGUE}, e AS (SELECT {inputs.select(EDITS)} FROM lineitem), c AS (SELECT *, CASE WHEN field = 'subtitle' AND length(trim(value)) > 80 THEN 'subtitle exceeds 80-character limit (' || length(trim(value)) || ' characters given)' WHEN field IN ('bullet_1', 'bullet_4') AND length(trim(value)) > 60 THEN field || ' exceeds 60-character limit (' || length(trim(value)) || ' characters given)'
    WHEN field IN ('dp', 'mrp') AND value IS NOT NULL AND (try_cast(value AS DOUBLE) IS NULL OR try_cast(value AS DOUBLE) < 0) THEN 'Invalid ' || field || ' value ''' || value || '''. Must be a non-negative number.' END AS reason FROM e),
    l AS (SELECT product_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY product_id, field ORDER BY seq DESC) AS n FROM c WHERE reason IS NULL) WHERE n = 1)"""


def edits(t: Tables):
    return inputs.derive(t.lineitem, EDITS).select("product_id", "seq", F.map_from_arrays(F.array("field"), F.array("value")).alias("changes"))


def edited(field: str, column: str, number: bool = False) -> str:
    value = "try_cast(value AS DOUBLE)" if number else f"trim({sql_filled('value')})"
    return f"CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.product_id = lower(c.Product_ID) AND field = '{field}') THEN (SELECT {value} FROM l WHERE l.product_id = lower(c.Product_ID) AND field = '{field}') ELSE {column} END"


@query("applied_edits", f"""{EDITS_SQL} SELECT Product_ID AS product_id, {edited('title', 'Override_Title')} AS title, {edited('subtitle', 'Override_Subtitle')} AS subtitle, {edited('dp', 'Override_DP', True)} AS dp, {edited('mrp', 'Override_MRP', True)} AS mrp, {edited('bullet_1', 'NULL')} AS bullet_1 FROM catalogue c""")
def applied_edits(t: Tables):
    df, _ = onboarding.apply_edits(inputs.catalogue(t), edits(t))
    return df.select(F.col("Product_ID").alias("product_id"), F.col("Override_Title").alias("title"), F.col("Override_Subtitle").alias("subtitle"), F.col("Override_DP").alias("dp"), F.col("Override_MRP").alias("mrp"), F.col("Override_Bullet_1").alias("bullet_1"))


@query("rejected_edits", f"{EDITS_SQL} SELECT product_id, seq, reason FROM c WHERE reason IS NOT NULL")
def rejected_edits(t: Tables):
    return onboarding.apply_edits(inputs.catalogue(t), edits(t))[1]


PICTURES = {"product_id": "'PB-' || lpad(CAST(l_partkey AS STRING), 7, '0')", "seq": "l_orderkey * 10 + l_linenumber", "path": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'images/overrides/' || CAST(l_orderkey AS STRING) || '.png' END", "width": "CAST(l_quantity * 50 AS INT)", "height": "1300"}


@query("image_overrides", f"""{WITH_CATALOGUE}, e AS (SELECT {inputs.select(PICTURES)} FROM lineitem), l AS (SELECT product_id, path FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq DESC) AS n FROM e WHERE path IS NULL OR width >= 1200) WHERE n = 1)
    SELECT c.Product_ID AS product_id, CASE WHEN l.product_id IS NOT NULL THEN l.path ELSE c.Override_Image_Path END AS path, CASE WHEN l.path IS NOT NULL THEN 'ok' ELSE c.Image_Status END AS image_status FROM catalogue c LEFT JOIN l ON l.product_id = c.Product_ID""")
def image_overrides(t: Tables):
    df, _ = onboarding.apply_image_overrides(inputs.catalogue(t), inputs.derive(t.lineitem, PICTURES))
    return df.select(F.col("Product_ID").alias("product_id"), F.col("Override_Image_Path").alias("path"), F.col("Image_Status").alias("image_status"))


@query("attached_brochures", f"""{WITH_CATALOGUE} SELECT Brand, CASE WHEN Brand = 'Brand#5' THEN 'new.pdf' ELSE arg_min(Brochure_PDF, row_order) FILTER (WHERE Brochure_PDF IS NOT NULL) END AS brochure_path FROM catalogue GROUP BY Brand""")
def attached_brochures(t: Tables):
    return onboarding.attached_brochure(onboarding.attach_brochure(inputs.catalogue(t), " brand#5", "new.pdf"), order="row_order")


# --- brand configuration ------------------------------------------------------------------------------


def config(t: Tables):
    """Nations as brands, regions as categories; region 0 is the default entry."""
    own = t.nation.select(F.col("n_name").alias("brand"), F.lit(None).cast("string").alias("category"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lower("n_name"), F.lit(".example"))).alias("domain"),
                          F.when(F.col("n_nationkey") % 4 == 0, F.lit("shopify")).alias("platform"), F.lit(None).cast("string").alias("collection_url"), F.lit(None).cast("array<string>").alias("qualifier_tokens"))
    cats = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("brand"), F.concat(F.lit("Cat"), (F.col("n_regionkey") % 2).cast("string")).alias("category"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("platform"),
                                                        F.concat(F.lit("https://c/"), "n_name").alias("collection_url"), F.array("n_name", F.lit("Pro")).alias("qualifier_tokens"))
    default = t.region.where("r_regionkey = 0").select(F.lit("_default").alias("brand"), F.lit(None).cast("string").alias("category"), F.lit("default.example").alias("domain"), F.lit("custom").alias("platform"), F.lit(None).cast("string").alias("collection_url"), F.lit(None).cast("array<string>").alias("qualifier_tokens"))
    default_cat = t.region.where("r_regionkey = 1").select(F.lit("_default").alias("brand"), F.lit("Cat1").alias("category"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("platform"), F.lit("https://c/default").alias("collection_url"), F.array(F.lit("Max")).alias("qualifier_tokens"))
    return own.union(cats).union(default).union(default_cat)


@query("config_resolve", """WITH w AS (SELECT s_suppkey, upper(CASE WHEN s_suppkey % 9 = 0 THEN 'unknown' ELSE n_name END) AS brand, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' CAT1 ' ELSE 'Cat0' END AS category, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE n_nationkey END AS k, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s_suppkey, brand, category, CASE WHEN k % 3 <> 0 THEN lower(brand) || '.example' ELSE 'default.example' END AS domain, CASE WHEN k % 4 = 0 THEN 'shopify' ELSE 'custom' END AS platform,
    CASE WHEN category IS NULL THEN NULL WHEN k % 2 = 0 THEN CASE WHEN lower(trim(category)) = 'cat' || (r % 2) THEN 'https://c/' || brand END WHEN lower(trim(category)) = 'cat1' THEN 'https://c/default' END AS collection_url,
    CASE WHEN category IS NULL THEN NULL WHEN k % 2 = 0 THEN CASE WHEN lower(trim(category)) = 'cat' || (r % 2) THEN brand || ',Pro' ELSE '' END WHEN lower(trim(category)) = 'cat1' THEN 'Max' ELSE '' END AS qualifiers FROM w""")
def config_resolve(t: Tables):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    wanted = inputs.derive(joined, {"s_suppkey": "s_suppkey", "brand": "upper(CASE WHEN s_suppkey % 9 = 0 THEN 'unknown' ELSE n_name END)", "category": "CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' CAT1 ' ELSE 'Cat0' END"})
    out = brands.resolve_brand_config(wanted, config(t))
    return out.select("s_suppkey", "brand", "category", "domain", "platform", "collection_url", F.array_join("qualifier_tokens", ",").alias("qualifiers"))


@query("config_upsert", """WITH o AS (SELECT n_name AS brand, CAST(NULL AS VARCHAR) AS category, CASE WHEN n_nationkey % 3 <> 0 THEN lower(n_name) || '.example' END AS domain, '' AS words FROM nation UNION ALL SELECT n_name, 'Cat' || (n_regionkey % 2), NULL, n_name || ',Pro' FROM nation WHERE n_nationkey % 2 = 0
      UNION ALL SELECT '_default', NULL, 'default.example', '' UNION ALL SELECT '_default', 'Cat1', NULL, 'Max'),
    l AS (SELECT n_name AS brand, arg_max('learned' || (s_suppkey % 3) || '.example', s_suppkey) FILTER (WHERE s_suppkey % 4 <> 0) AS domain, CASE arg_min(s_suppkey % 2, s_suppkey) WHEN 0 THEN ['Pro', 'Neo'] ELSE ['Neo', 'Air'] END AS first_, bool_or(s_suppkey % 2 = 0) AS pro, bool_or(s_suppkey % 2 = 1) AS air FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
    w AS (SELECT *, array_to_string(list_concat(first_, CASE WHEN pro AND air THEN CASE WHEN first_[1] = 'Pro' THEN ['Air'] ELSE ['Pro'] END ELSE [] END), ',') AS learned FROM l),
    b AS (SELECT brand, NULL AS category, domain, NULL AS learned FROM w UNION ALL SELECT brand, 'Cat1', NULL, learned FROM w)
    SELECT coalesce(o.brand, b.brand) AS brand, coalesce(o.category, b.category) AS category, coalesce(b.domain, o.domain) AS domain, CASE WHEN coalesce(o.category, b.category) IS NULL THEN NULL WHEN b.brand IS NULL THEN o.words WHEN o.brand IS NULL THEN learned ELSE array_to_string(list_concat(string_split(o.words, ','), list_filter(string_split(learned, ','), lambda x: NOT list_contains(string_split(o.words, ','), x))), ',') END AS words
    FROM o FULL OUTER JOIN b ON o.brand = b.brand AND o.category IS NOT DISTINCT FROM b.category""")
def config_upsert(t: Tables):
    learned = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("brand"), F.lit("Cat1").alias("category"), F.expr("CASE WHEN s_suppkey % 4 <> 0 THEN 'learned' || CAST(s_suppkey % 3 AS STRING) || '.example' END").alias("domain"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN array('Pro', 'Neo') ELSE array('Neo', 'Air') END").alias("qualifier_tokens"), F.col("s_suppkey").alias("seq"))
    return brands.upsert_brand_config(config(t), learned).select("brand", "category", "domain", F.array_join("qualifier_tokens", ",").alias("words"))


@query("blocked_brands", """SELECT event_type AS brand, 'd' || arg_max(event_id, ts) AS domain, 'custom' AS platform, true AS waf_blocked, 'cloudflare' AS waf_vendor, 'HTTP 403 Bot Challenge' AS waf_reason, max(ts) AS waf_blocked_at FROM events GROUP BY event_type""")
def blocked_brands(t: Tables):
    blocks = t.events.select(F.col("event_type").alias("brand"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("domain"), F.lit(None).cast("string").alias("platform"), F.lit("cloudflare").alias("vendor"), F.lit(None).cast("string").alias("reason"), F.col("ts").alias("seen_at"))
    return brands.blocked_record(blocks)


@query("brand_profiles", """WITH c AS (SELECT n_name AS brand, 'Cat' || (n_regionkey % 2) AS category, CASE WHEN n_nationkey % 3 <> 0 THEN lower(n_name) || '.example' END AS domain, CASE WHEN n_nationkey % 4 = 0 THEN 'shopify' ELSE 'custom' END AS platform, n_name || ', Pro' AS words FROM nation WHERE n_nationkey % 2 = 0
      UNION ALL SELECT '_default', 'Cat1', 'default.example', 'custom', 'Max'),
    f AS (SELECT brand, category, list_filter([CASE WHEN domain IS NOT NULL THEN {found: true, finding: 'Domain: ' || domain} ELSE {found: false, finding: 'Domain: Not found / no official storefront verified'} END, CASE WHEN domain IS NOT NULL THEN {found: true, finding: 'Platform: ' || platform} END,
      CASE WHEN domain IS NOT NULL THEN {found: true, finding: 'Collection URL: https://c/' || CASE WHEN brand = '_default' THEN 'default' ELSE brand END} END, {found: true, finding: 'Qualifier tokens (' || (1 + length(words) - length(replace(words, ',', ''))) || ' tokens): ' || words}], lambda x: x IS NOT NULL) AS l FROM c)
    SELECT brand, category, CAST(i AS INT) AS pos, l[i + 1].found AS found, l[i + 1].finding AS finding FROM f, range(4) r(i) WHERE i < len(l)""")
def brand_profiles(t: Tables):
    return brands.brand_profile(config(t))
