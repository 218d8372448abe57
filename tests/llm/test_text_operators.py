"""Line dedup, mixing, BPE, language ID, URL filter and WARC against small brute-force versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import bpe, language_id, line_dedup, mixing, url_filter, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=False):
    """Documents from (doc_id, text, lang, source); with columns whose names clash with those of operators."""
    df = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("host", "rank", "score", "count", "ids", "n_tokens", "class_id")}) if extra else df


# line dedup

def brute_lines(rows, ratio=0.1, least=3):
    pages, seen = Counter(s for _, _, _, s in rows), Counter()
    for _, text, _, s in rows:
        for line in {x for x in (text or "").split("\n") if x.strip(" ")}:
            seen[s, line] += 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return sorted(((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad)) for i, t, _, s in rows), key=str)


def test_line_dedup_equals_brute_force(spark):
    rows = [(i, f"head\nline {i}\n\n  \nfoot {i % 2}", "en", "a") for i in range(12)]
    rows += [(20 + i, f"head\nown {i}", "en", None) for i in range(4)] + [(30, None, None, "a"), (31, "", None, "b"), (32, "head", "en", "b")]
    rows += [(40, "x\n" * 5000 + "end", "en", "c"), (41, "x", "en", "c"), (41, "x", "en", "c"), (None, "tie", None, None)]
    found = line_dedup.dedup_lines(docs_of(spark, rows, extra=True)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == brute_lines(rows)
    assert {r["host"] for r in found} == {"x"}
    by_id = {r["doc_id"]: r for r in found}
    assert (by_id[0]["__lines"], by_id[0]["__removed"]) == (5, 2) and by_id[31]["__removed"] == 0 and by_id[30]["__lines"] == 0


def test_line_dedup_takes_site_lines_of_a_large_host_below_the_ratio(spark):
    """9 % of a large host's pages carry a site line; chance (4 %), exact copies (8 %) and a small host's lines stay."""
    rows = [(i, f"own {i}" + "\nsite" * (i < 36) + "\nchance" * (i >= 352), "en", "large") for i in range(368)]
    rows += [(1000 + i, "copied\ntwice", "en", "large") for i in range(32)]
    rows += [(3000 + i, f"small {i}" + "\nshared" * (i < 4), "en", "small") for i in range(50)]
    text = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert not any("site" in t for t in text.values())
    assert {i: t for i, t in text.items() if i >= 36} == {i: t for i, t, _, _ in rows if i >= 36}
    assert all(text[i] == f"own {i}" for i in range(36))


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


# mixing

def brute_schedule(weights):
    total, had, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(total):
        ready = [(-(-(had[s] + 1) * total // p), s) for s, p in weights.items() if had[s] * total // p <= t and had[s] < p]
        out.append(min(ready)[1])
        had[out[-1]] += 1
    return out


def test_schedule_is_earliest_deadline_first_within_a_block(spark):
    weights = {"=a": 500, "=b": 300, "=c": 150, "=d": 49, "": 1}
    laid = mixing.schedule(spark.createDataFrame(list(weights.items()), "__source string, __p long")).orderBy("__slot").collect()
    assert [r["__source"] for r in laid] == brute_schedule(weights)
    had = Counter()
    for t, r in enumerate(laid, 1):
        had[r["__source"]] += 1
        assert all(abs(had[s] - t * p / 1000) < 1 for s, p in weights.items())


def test_mix_with_thousands_of_sources_stays_within_a_block_of_the_given_weights(spark):
    """One source of weight 0.5 and 5,000 of 0.0001; 12,000 sources in all are no error."""
    weights = [5000] + [1] * 5000
    sources, _, slots = mixing.earliest_deadline_first(weights, [5000] + [1] * 5000)
    had = 0
    for n, (j, slot) in enumerate(zip(sources, slots), 1):
        had += j == 0
        assert slot == n - 1 and abs(had - n / 2) < 1
    rows = [(i, "t", "en", "hot") for i in range(3000)] + [(10_000 + i, "t", "en", f"s{i}") for i in range(12_000)]
    given = spark.createDataFrame([("hot", 0.5)] + [(f"s{i}", 0.5 / 12_000) for i in range(12_000)], "source string, weight double")
    found = mixing.mix(docs_of(spark, rows), weights=given, block_rows=1).select("source", "__slot").collect()
    order = [s for _, s in sorted((r["__slot"], r["source"]) for r in found)]
    assert len(found) == len(rows)
    hot = np.cumsum([s == "hot" for s in order])[:6000]
    assert np.all(np.abs(hot - np.arange(1, 6001) / 2) <= 1.001)


def test_mix_of_unequal_shares_and_early_ends_meets_releases_and_deadlines():
    rng = np.random.default_rng(3)
    weights, blocks = [int(w) for w in rng.integers(1, 10**9, 300)], [int(n) for n in rng.integers(0, 40, 300)]
    total, seen, used = sum(weights), Counter(), set()
    for j, i, slot in zip(*mixing.earliest_deadline_first(weights, blocks)):
        assert i == seen[j] and i * total // weights[j] <= slot < -(-(i + 1) * total // weights[j]) and slot not in used
        seen[j] += 1
        used.add(slot)
    assert [seen[j] for j in range(300)] == blocks


def test_mix_keeps_every_row_at_a_place_of_its_own(spark):
    rows = [(i, "t", "en", "hot" if i % 3 else None) for i in range(300)] + [(7, "t", "en", "hot")] * 3 + [(None, None, None, "few")] * 2
    found = mixing.mix(docs_of(spark, rows, extra=True), block_rows=4, weights=spark.createDataFrame([("hot", 3.0), (None, 1.0), ("few", None)], "source string, weight double")).collect()
    assert len(found) == len(rows) and len({r["__position"] for r in found}) == len(rows)
    assert Counter((r["doc_id"], r["source"]) for r in found) == Counter((i, s) for i, _, _, s in rows)
    order = sorted(found, key=lambda r: r["__position"])
    hot = [i for i, r in enumerate(order[:120]) if r["source"] == "hot"]
    assert abs(len(hot) - 90) <= 4
    blocks = defaultdict(set)
    for r in found:
        blocks[r["__slot"]].add((r["source"], r["__block"]))
    assert all(len(b) == 1 for b in blocks.values())


def test_mix_numbers_alike_in_small_ranges(spark):
    df = docs_of(spark, [(i, "t", "en", f"s{i % 2}") for i in range(200)])
    one, many = (mixing.numbered(df, "doc_id", "source", n).select("doc_id", "__n").collect() for n in (4096, 10))
    assert sorted(one) == sorted(many)
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_mixed_order_is_the_order_of_files(spark, tmp_path):
    df = docs_of(spark, [(i, "t", "en", f"s{i % 3}") for i in range(200)])
    mixing.in_mixed_order(df, ["doc_id"]).write.parquet(str(tmp_path / "m"))
    place = {r["doc_id"]: r["__position"] for r in mixing.mix(df).collect()}
    import pyarrow.parquet as pq
    read = [i for f in sorted((tmp_path / "m").glob("*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert [place[i] for i in read] == sorted(place.values())


# BPE

ODD = ["", None, " ", "a", "Hello world, it's  twelve o'clock\n\n", "<|endoftext|>x <|endoftext|>", "é́ 日本語 👍🏽\x1c\x85 ²½", "x" * 700, "ab" * 900 + " " * 300,
       "zebra" * 60, "don't WE'LL 12345 $$$***", "mañana " * 3000, "\ufeff\u200b", "a\tb\r\n c"]


def test_bpe_equals_the_library():
    own, library = bpe.Codec(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text, ids in zip(ODD, own.encode_many(ODD)):
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted
        assert own.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_bpe_words_of_latin_texts_are_cut_like_others():
    text = "".join(f"a{chr(c)}{chr(c)} {chr(c)}1 '{chr(c)}s" for c in range(256))
    assert bpe.LATIN_WORDS.findall(text) == bpe.WORDS.findall(text)


def test_bpe_every_letter_of_the_first_planes():
    texts = ["".join(f"b{chr(c)}{chr(c)} {chr(c)}" for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 64)]
    library = Tokenizer.from_file(VOCABULARY)
    mine, theirs = bpe.Codec(VOCABULARY).encode_many(texts), library.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(m, "<u4").tolist() == t.ids for m, t in zip(mine, theirs))


def test_bpe_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    own, fresh = bpe.Codec(VOCABULARY), bpe.Codec(VOCABULARY)
    texts = [" ".join(f"word{i * k % 97}" for i in range(40)) for k in range(1, 20)]
    for t in texts:
        assert own.encode(t) == fresh.learn({t})[t] if " " not in t else own.encode(t) == b"".join(fresh.learn({w})[w] for w in fresh.split(t))


def test_bpe_over_rows(spark):
    rows = [(i, t, None, None) for i, t in enumerate(ODD)] + [(3, "again", None, None), (3, "again", None, None), (None, "no id", None, None)]
    df = docs_of(spark, rows, extra=True)
    library = Tokenizer.from_file(VOCABULARY)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _, _ in rows}
    got = bpe.round_trip(df, VOCABULARY).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] not in (3, None):
            wanted = np.array(ids[r["doc_id"]], "<u4")
            assert r["n_tokens"] == len(wanted) and r["ids_sha256"] == hashlib.sha256(wanted.tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((rows[r["doc_id"]][1] or "").encode()).hexdigest()
    tokens = bpe.encode(df, VOCABULARY, check=True)
    assert all(r["round_trip"] for r in tokens.collect())
    texts = Counter((r["doc_id"], r["text"]) for r in bpe.decode(tokens, VOCABULARY).collect())
    assert texts == Counter((i, t or "") for i, t, _, _ in rows)
    assert bpe.round_trip(docs_of(spark, []), VOCABULARY).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, 99999, -1, 64])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd, VOCABULARY).collect()} == {1: "", 2: "a"}


# language ID

def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out("doc_id")).collect()
    assert all(held(r["doc_id"]) for r in found)
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_id_corner_cases(spark):
    words = {"aa": "tak bok nuk", "bb": "ilo eva umi"}
    rows = [(i, " ".join([words[k]] * (1 + i % 9)), k, None) for i, k in zip(range(80), ["aa", "bb"] * 40)]
    rows += [(100, None, "aa", None), (101, "123 $$$", "bb", None), (102, "tak bok " * 20000, None, None), (None, "ilo eva", "aa", None), (103, "", None, None)]
    df = docs_of(spark, rows, extra=True)
    model = language_id.fit(df)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(df, model).collect()]
    assert len(got) == len(rows)
    by_id = {i: (lang, s) for i, lang, s in got}
    assert by_id[100] == by_id[101] == by_id[103] == ("und", 0.0)
    assert by_id[102][0] == "aa" and by_id[None][0] == "bb"
    again = language_id.predict(df, language_id.fit(df)).collect()
    assert sorted(map(str, again)) == sorted(map(str, language_id.predict(df, model).collect()))


def test_language_id_without_or_with_one_language(spark):
    none = docs_of(spark, [(0, "tak", None, None)])
    assert language_id.fit(none) is None
    assert [tuple(r) for r in language_id.predict(none, None).collect()] == [(0, "und", 0.0)]
    assert language_id.predict(docs_of(spark, []), language_id.fit(docs_of(spark, []))).count() == 0
    one = docs_of(spark, [(i, "tak", "aa", None) for i in range(8)])
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(one, language_id.fit(one)).collect()} == {("aa", 1.0)}


def test_language_id_reads_whole_texts():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list(letters), 600)) for letters in ("abcd ", "wxyz ") for _ in range(30)]
    model = language_id.train(texts, ["aa"] * 30 + ["bb"] * 30)
    best, _ = language_id.classify(model, [b"abcd " * 60 + b"wxyz zyx " * 400])
    assert model.languages[best[0]] == "bb"


# URL filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = ["http://m.x.example.org/es/1?q", "https://EXAMPLE.org/en/12#x", "http://org/", "http://org", "x://a.com/fr/a?b", "http://a.com/de/", "http://acom/de/", None, "", "no scheme/",
        "http://", "http://a.com", "http://a.com/FR/", "http://a.b.com//fr/", "mailto:x@y.org/", "http://a.com/fr/x://b.org/", "http://\u00c9X.org/\u00e9", "http://x.org/" + "p" * 50000]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_filter_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "mine") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None)], "page_id long, url string, host string, rule string")
    found = url_filter.filter_urls(pages, RULES).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        assert tuple(r)[1:] == brute_rule(URLS[r["page_id"] or 0])
    rules = spark.createDataFrame(RULES + RULES[:1] + [(None, "/", "block")], "host string, path string, verdict string")
    assert sorted(map(str, url_filter.filter_urls(pages, rules).collect())) == sorted(map(str, found))
    assert {r["verdict"] for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.where("false"), RULES).count() == 0


def test_url_filter_confirms_equal_digests(tmp_path):
    same = lambda keys: np.array([5 for _ in keys], dtype=np.uint64)
    rules = [(f"h{i}.org", "/a", "block" if i % 2 else "allow") for i in range(9)]
    url_filter.write_array(rules, str(tmp_path / "r"), same)
    array = url_filter.DigestArray(str(tmp_path / "r"), same)
    got = url_filter.judge(array, [f"h{i}.org" for i in range(12)], ["/ab"] * 12)
    assert got == [(f"h{i}.org/a", "block" if i % 2 else "allow") for i in range(9)] + [None] * 3
    with pytest.raises(ValueError):
        url_filter.write_array([("a", "/", "maybe")], str(tmp_path / "s"))


# WARC

HTML = '<html><head><title>A &amp; B</title><style>x</style></head><body><!-- no --><script>var t="</p>";</script><p>One<b>two</b></p><div>&eacute; <a href="/l?a=1&amp;b">link</a></div></body></html>'


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/x", HTML, "k"), (2, None, None, "k"), (3, "http://b.org/\r\nX: y", "", None), (3, "http://b.org/\r\nX: y", "", None),
                                   (None, "http://c.org", "<p>" + "long " * 60000, None)], "page_id long, url string, html string, record string")
    records = warc.responses(pages)
    rows = warc.derive(records, "page_id").collect()
    assert Counter(r["record_type"] for r in rows) == {"metadata": 5, "conversion": 5}
    by = {(r["page_id"], r["record_type"]): r for r in rows}
    source = {r["page_id"]: warc.parse_headers(r["record"]) for r in records.collect()}
    for (i, kind), r in by.items():
        fields = dict(source[i][0])
        assert r["refers_to"] == fields["WARC-Record-ID"] and r["source_payload_digest"] == fields["WARC-Payload-Digest"]
        assert r["block_digest"] == warc.sha1(r["content"].encode()) and r["content_length"] == len(r["content"].encode())
        made, block = warc.parse_headers(r["record"])
        assert dict(made)["WARC-Refers-To"] == r["refers_to"] and block.decode() == r["content"] and not r["truncated"]
    assert by[1, "conversion"]["content"] == "A & B\nOnetwo\né link"
    meta = by[1, "metadata"]["content"]
    assert "title: A & B\r\n" in meta and "outlink: /l?a=1&b\r\n" in meta and f"source-header: WARC-Payload-Digest: {warc.sha1(HTML.encode())}\r\n" in meta
    assert by[2, "conversion"]["content"] == "" and by[2, "conversion"]["target_uri"] is None
    assert len(by[None, "conversion"]["content"]) == 5 * 60000 - 1
    assert warc.derive(warc.responses(pages.where("false")), "page_id").count() == 0
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_warc(records, path, compression=compression)
        again = warc.derive(warc.read_warc(spark, path)).collect()
        assert sorted(r["record"] for r in again) == sorted(r["record"] for r in rows)


def test_warc_foreign_records():
    gz = __import__("gzip").compress("<title>T</title>ü".encode("latin-1"))
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n%x\r\n%b\r\n0\r\n\r\n" % (len(gz), gz)
    raw = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], body)
    assert [r[9] for r in warc.derive_one(raw)][1] == "T\nü"
    assert warc.derive_one(raw[:-3])[0][8] is True
    assert warc.derive_one(warc.record([("WARC-Type", "request")], b"")) == [] and warc.derive_one(b"junk") == [] and warc.derive_one(b"WARC/1.0") == []


def test_sizes_of_windows():
    assert language_id.windows(b"x" * 257).shape == (2, 256) and language_id.windows(b"").shape == (0, 256)
    assert math.isclose(float(np.exp(language_id.log_probabilities(language_id.train(["a", "b"], ["x", "y"], 1), language_id.windows(b"abc"))).sum()), 1, rel_tol=1e-5)


def test_the_limit_for_no_language_counts_all_held_out_rows(spark, monkeypatch):
    from shelfmark.llm import language_id

    docs = spark.range(0, 24000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"))
    monkeypatch.setattr(language_id, "predict", lambda df, model, *_: df.select("doc_id", F.lit("und").alias("lang_pred"), (0.5 + F.col("doc_id") / 1e6).alias("score")))
    held = sorted((r.doc_id for r in docs.where(language_id.held_out("doc_id")).collect()), reverse=True)
    assert len(held) > language_id.SAMPLE_ROWS
    assert abs(language_id.no_language_limit(docs, None) - (0.5 + held[len(held) // 1000] / 1e6)) < 1e-12
