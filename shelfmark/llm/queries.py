"""One query for each operator, over the whole of its table, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, cross_polytope, forest_join, language_id, line_dedup, mixing, packing, prefix_trie, segment_search, substring_dedup, url_filter, warc, whitening
from shelfmark.llm.registry import query, table

#: The vocabulary file is a parameter of the operator; this is the one that the query uses.
VOCABULARY = "byte_bpe_50k.json"
PACKED_VOCABULARY = "word_bpe_49k.json"

# The rules of the query's contract.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]

LINES_SQL = f"""
WITH pages AS (SELECT doc_id, text, coalesce('=' || source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
seen AS (
  SELECT host, line, count(*) AS n, count(DISTINCT mark) AS marks FROM (
    SELECT host, CAST('0x' || left(md5(text), 2) AS INTEGER) % 64 AS mark, unnest(list_distinct(list_filter(lines, lambda x: trim(x) <> ''))) AS line FROM pages)
  GROUP BY host, line),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY host),
bad AS (
  SELECT host, list(line) AS bad FROM seen JOIN totals USING (host)
  WHERE n >= {line_dedup.MIN_PAGES} AND n > CAST({line_dedup.RATIO} AS DOUBLE) * total
    OR n >= {line_dedup.MANY_PAGES} AND n > CAST({line_dedup.LOW_RATIO} AS DOUBLE) * total AND marks >= {line_dedup.MANY_TEXTS} GROUP BY host),
kept AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad, CAST([] AS VARCHAR[])), x)) AS kept
  FROM pages LEFT JOIN bad USING (host))
SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines,
  CAST(coalesce(len(lines) - len(kept), 0) AS INTEGER) AS n_removed
FROM kept
"""

MIX_SQL = f"""
WITH RECURSIVE raw AS (SELECT coalesce('=' || source, '') AS s, CAST(floor(sqrt(count(*)) * 1000) AS BIGINT) AS w FROM documents GROUP BY 1),
weights AS (SELECT s, greatest(1, (2 * w * {mixing.PERIOD} + total) // (2 * total)) AS p FROM raw, (SELECT CAST(sum(w) AS BIGINT) AS total FROM raw)),
mix AS (SELECT list(struct_pack(s := s, p := p) ORDER BY s) AS k, CAST(sum(p) AS BIGINT) AS n FROM weights),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(k, lambda x: CAST(0 AS BIGINT)) AS had, CAST(0 AS BIGINT) AS c FROM mix
  UNION ALL
  SELECT t + 1, list_transform(had, lambda h, j: CASE WHEN j = d.j THEN h + 1 ELSE h END), d.j FROM (
    SELECT t, had, list_min(list_filter(list_transform(k, lambda x, j: struct_pack(
      d := ((had[j] + 1) * n + x.p - 1) // x.p, j := CAST(j AS BIGINT), r := had[j] * n // x.p, full_ := had[j] >= x.p)),
      lambda x: x.r <= t + 1 AND NOT x.full_)) AS d
    FROM edf, mix WHERE t + 1 < n)),
plan AS (SELECT k[c].s AS s, k[c].p AS p, n, t AS spot, row_number() OVER (PARTITION BY c ORDER BY t) - 1 AS i FROM edf, mix WHERE t >= 0),
rows_ AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s,
    row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS place FROM documents)
SELECT doc_id, source, place // {mixing.BLOCK_ROWS} AS block, (place // {mixing.BLOCK_ROWS} // p) * n + spot AS slot,
  ((place // {mixing.BLOCK_ROWS} // p) * n + spot) * {mixing.BLOCK_ROWS} + place % {mixing.BLOCK_ROWS} AS position
FROM rows_ JOIN plan ON plan.s = rows_.s AND plan.i = (place // {mixing.BLOCK_ROWS}) % plan.p
"""

URL_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM cut),
named AS (
  SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM split),
rules(rule_host, rule_path, verdict) AS (VALUES %s),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM named LEFT JOIN fits USING (page_id)
""" % ", ".join(str(r) for r in RULES)


@query("op2_line_dedup", LINES_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


@query("op6_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query("op7_pfair_mix", MIX_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", *(F.col(f"__{c}").alias(c) for c in ("block", "slot", "position")))


@query("op9_warc_derivatives")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, folder, "pages")), id_col="page_id").drop("record")


@query("op10_url_filter", URL_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, folder, "pages"), RULES)


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


SEARCH_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM placed WHERE rank <= 5
"""


@query("op1_segment_search", SEARCH_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return segment_search.top_k(table(spark, folder, "embeddings"), F.col("__id") % 50 == 0)


@query("op5_cross_polytope")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return cross_polytope.neighbours(table(spark, folder, "embeddings"), F.col("__id") % 100 == 0)


JOIN_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE both_ >= 0.8 * (len(x.s) + len(y.s) - both_) - 1e-9),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM reach GROUP BY doc_id
"""


@query("op3_jaccard_join", JOIN_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return forest_join.similar(table(spark, folder, "documents"))


SUBSTRING_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), CAST([] AS VARCHAR[])) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
smallest AS (SELECT h, min(doc_id) AS low FROM hashed GROUP BY h),
covered AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM hashed JOIN smallest USING (h) WHERE low < doc_id GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, CAST([] AS BIGINT[])), i)) AS k FROM words LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


@query("op8_substring_dedup", SUBSTRING_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    # 64 bits hold the deviation as long as its contract's type can; the decimal goes further
    return found.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query("op12_harmonic_packing")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(PACKED_VOCABULARY))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS d,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, list(struct_pack(d := d, w := w) ORDER BY turn NULLS FIRST, d) AS t FROM turns GROUP BY conv_id),
sums AS (
  SELECT c, t, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
    4294967295) % 4 AS INTEGER) AS h
  FROM own),
rebuilt AS (
  SELECT s.c, list_concat(CASE WHEN s.h > 0 THEN coalesce(b.t, [])[1:s.h] ELSE [] END, s.t[s.h + 1:]) AS t FROM sums s LEFT JOIN own b ON b.c = s.c - s.c % 20),
prefixes AS (
  SELECT c, len(t) AS size, unnest(range(0, len(t) + 1)) AS depth, t FROM rebuilt),
keyed AS (
  SELECT c, size, depth, CASE WHEN depth > 0 THEN sha256(list_reduce(list_transform(t[1:depth], lambda x: x.d), lambda a, b: a || b)) ELSE '' END AS k,
    CASE WHEN depth > 0 THEN t[depth].w ELSE 0 END AS w
  FROM prefixes),
nodes AS (
  SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = depth), '')) AS ends_sha256
  FROM keyed GROUP BY depth, k),
linked AS (
  SELECT n.*, p.k AS parent, u.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN keyed p ON p.c = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.depth = p.depth AND u.k = p.k),
kids AS (SELECT depth - 1 AS depth, parent AS k, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY 1, 2),
figures AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * w AS own_saved FROM linked l LEFT JOIN kids USING (depth, k)),
sub AS (
  SELECT a.depth, a.k, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum(f.own_saved) AS saved_tokens
  FROM figures f JOIN keyed a ON a.c = f.conv_id AND a.depth <= f.depth GROUP BY a.depth, a.k)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(depth AS BIGINT) AS depth, CAST(parent_conv_id AS BIGINT) AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
  CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM figures JOIN sub USING (depth, k)
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, folder, "conversations"))))
