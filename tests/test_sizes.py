"""What a task holds does not grow with the table."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from shelfmark import schema
from shelfmark.operators import matching
from shelfmark.sources import writers
from workload import load

PRODUCT = "product_id string, brand string, model_name string, category string, qualifiers array<string>"
LISTING = "store_brand string, url string, title string, source string, arrival bigint"


def test_a_brand_is_written_in_parts_of_a_bounded_size(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("p"), "id").alias("Product_ID"), F.lit("Acme").alias("Brand"), F.lit("Cable").alias("Category"), F.sha2(F.col("id").cast("string"), 512).alias("Model_Name"))
    catalogue = schema.catalogue(rows)

    def files(name: str) -> int:
        return len(list(Path(writers.write_catalogue(catalogue, str(tmp_path / name), "1")).rglob("*.parquet")))

    assert files("small") == 1
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "40k")
    try:
        assert files("large") > 1
    finally:
        spark.conf.unset(size)


def test_names_of_one_run_need_no_index_of_words(spark, monkeypatch):
    models = spark.createDataFrame([("de", "volt"), ("de", "go")], "scope string, model_name string")
    texts = spark.createDataFrame([("de", 1, "a Volt, go_on"), ("de", 2, "volts")], "scope string, text_id long, text string")
    monkeypatch.setattr(matching, "rarest_key_pairs", lambda *_: (_ for _ in ()).throw(AssertionError("counted")))
    assert [tuple(r) for r in matching.model_mentions(models, texts).collect()] == [("de", "volt", 1)]


def test_a_capacity_conflict_reads_each_text_once(spark):
    rows = spark.createDataFrame([("Volt 10000mAh", "Volt 20K"), ("Volt 10K", "10,000 mAh"), ("Volt", "20K"), ("Volt 10K", "Volt"), (None, None)], "m string, t string")
    clash = matching.capacity_conflict(F.col("m"), F.col("t")).alias("x")
    assert [r.x for r in rows.select(clash).collect()] == [True, False, False, False, False]
    assert rows.select(clash)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 4


def test_a_claim_that_many_products_make_is_scored_once(spark, monkeypatch):
    rows = [(str(i), "Acme" if i % 2 else None, "Volt", None if i % 3 else "Volt", "https://a.com/p/volt", i) for i in range(12)]
    assigned = spark.createDataFrame(rows, "product_id string, brand string, model_name string, title string, url string, row_order bigint")
    options = spark.createDataFrame([(r[0], f"https://a.com/p/volt-{r[5] % 2}", "Volt", 1.0, 0) for r in rows], "product_id string, url string, title string, score double, arrival bigint")
    score, scored = matching.collision_scores, []

    def counted(asked):
        scored.append(asked.count())
        return score(asked)

    monkeypatch.setattr(matching, "collision_scores", counted)
    now, memory = matching.resolve_collisions(assigned, options)
    # a brand's products are alike, with or without a title; each brand is offered one page beside
    assert scored == [4]
    held = {r.product_id: r.url for r in now.collect() if r.url}
    assert held == {"0": "https://a.com/p/volt", "2": "https://a.com/p/volt-0", "1": "https://a.com/p/volt", "3": "https://a.com/p/volt-1"}
    assert memory.count() == 2 + 2 * 4 * 2


def test_alike_pages_and_products_meet_once(spark, monkeypatch):
    products = spark.createDataFrame([(str(i), "Acme", "Volt Max", "Powerbank", None, c) for i, c in enumerate((None, "10000mAh", "20000mAh", "10000mAh"))], PRODUCT + ", target_capacity string")
    # the number of a page is no product's, but 20 goes for 20000; beside that only the two titles that name the capacity say something else
    offers = [(s, f"https://s/p/volt-max-{i + 11}", "Volt Max" if i % 15 else "Volt Max 10000mAh", "s", i) for i in range(30) for s in ("Acme", None)]
    listings = spark.createDataFrame(offers, LISTING)
    meet, met = matching.met_on_rarest_key, []

    def counted(left, right, *rest):
        met.append((left.select("left_id").distinct().count(), right.count()))
        return meet(left, right, *rest)

    monkeypatch.setattr(matching, "met_on_rarest_key", counted)
    best = {r.product_id: (r.url_key, r.title, r.score) for r in matching.best_candidates(products, listings).collect()}
    assert met == [(1, 6)]
    assert {p: (u[-2:], s) for p, (u, _, s) in best.items()} == {"0": ("12", 250.0), "1": ("12", 230.0), "2": ("20", 270.0), "3": ("12", 230.0)}


def test_candidates_in_groups_are_those_of_single_pairs(spark):
    names = ["Volt", "Volt Pro", "Volt Mini", "Volt 20000mAh", "voltpro", "Buds", "", "Acme Go 10", "Go"]
    products = spark.createDataFrame(
        [(f"{b}{i}{c}", b, n, k, ["Pro", "Mini"] if i % 2 else None, c) for b in ("Acme", "Bolt") for i, n in enumerate(names) for k, c in (("Powerbank", None), ("TWS", "10000mAh"))], PRODUCT + ", target_capacity string")
    rng = random.Random(4)
    offers = [(rng.choice(["Acme", "Bolt", None, None]), f"https://s/p/{rng.choice(['volt', 'acme-volt-pro', 'volt-20000mah', 'go-10', 'buds'])}-{rng.choice([3, 10, 20, 33])}", " ".join(
        rng.sample(["Acme", "Bolt", "Volt", "Pro", "Mini", "black", "20000mAh", "5W", "Power", "Bank", "Max", "Go", "10", "Buds", "one", "two", "six", "Sony"], rng.choice([1, 2, 3, 14]))), rng.choice("ab"), i) for i in range(220)]
    offers += [(s, f"https://s/p/volt-{i}", "Volt 20000mAh 5W " + " ".join(f"zz{j}" for j in range(i)), "a", 300 + i) for i in range(20, 30) for s in ("Acme", None)]
    listings = spark.createDataFrame(offers, LISTING)
    found = matching.find_pairs(products, listings)
    columns = ["target_id", "source", "page_id", "arrival", "score", "valid", "near_miss"]
    single = matching._all_pages(found, found.met)
    titled = found.candidates.join(found.texts.select("text_id", "title"), "text_id")
    wanted, got = ({tuple(r) for r in df.select(*columns, "title").collect()} for df in (single, titled))
    assert got == wanted and {w[5] for w in wanted} == {True, False} and len({w[4] for w in wanted}) > 5
    rejected = spark.createDataFrame([(f"Acme{i}None", o[1]) for i in range(5) for o in offers[i::9]], "product_id string, url string")
    told = ["product_id", "source", "url_key", "url", "title", "brand", "model_name", "score", "valid", "near_miss", "reason", "arrival"]
    every = {tuple(r) for r in matching.generate_candidates(products, listings, rejected).select(*told).collect()}
    short = matching.shortlist(products, listings, rejected).select(*told).collect()
    assert short and {tuple(r) for r in short} <= every and any(not r.valid for r in short)


def test_recall_meets_products_and_listings_once(spark, monkeypatch):
    read, asked = matching._texts, []
    monkeypatch.setattr(matching, "_texts", lambda listings: asked.append(1) or read(listings))
    monkeypatch.setattr(matching, "_told", lambda *_: (_ for _ in ()).throw(AssertionError("names are looked up")))
    rows = load().QUERIES["shortlist_recall"](spark, "/root/testdata/sf0.001").collect()
    assert len(asked) == 1 and rows[0].total > 0
