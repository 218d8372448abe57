"""Steps that build on each other work their input out once a row, not once for every time that they name it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import copywriting, html, names, specs, text
from shelfmark.operators import matching, validation

def count(spark, column, *words: str) -> int:
    rows = spark.range(1).select(F.col("id").cast("string").alias("t"), F.col("id").cast("string").alias("b"))
    plan = rows.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
    return sum(plan.count(w) for w in words)


@pytest.mark.parametrize(("column", "word", "most"), [
    (lambda t, b: names.model_portion(t, b), "regexp_", 4),
    (lambda t, b: matching.qualifier_conflict(t, b, F.array(F.lit("Pro")), None), "regexp_", 15),
    (lambda t, b: text.search(t, r"\d+"), "regexp_", 1),
    (lambda t, b: html.attribute(t, "src"), "regexp_", 3),
    (lambda t, b: html.jsonld_facts(html.jsonld_products(t)), "regexp_", 1),
    (lambda t, b: specs.markdown_price(t), "regexp_", 2),
    (lambda t, b: copywriting.normalise_copy(t, b), "regexp_", 6),
], ids=["portion", "qualifiers", "search", "attribute", "jsonld", "price", "copy"])
def test_work_is_named_once(spark, column, word, most):
    assert count(spark, column(F.col("t"), F.col("b")), word) <= most


def test_results_stay(spark):
    rows = spark.createDataFrame([
        ("Acme Volt Go - 20W charger",), ("20000mAh Volt Go Power Bank 10",), ("Power Bank 10",), ("  ",), (None,), ("- x - y",), ("Volt | Go | x",),
    ], "t string")
    got = [r[0] for r in rows.select(names.model_portion(F.col("t"), F.lit("acme"))).collect()]
    assert got == ["Volt Go", "Volt Go", "Power Bank 10", "", "", "- x", "Volt"]
    empty = spark.createDataFrame([("a",), ("",), (None,)], "t string").select(text.not_empty(F.col("t"))).collect()
    assert [r[0] for r in empty] == ["a", None, None]


def test_rows_without_an_image_meet_no_null(spark):
    rows = spark.createDataFrame([
        ("p1", "a.png", "m", "Pending"), ("p2", "b.png", "m", "Pending"), ("p3", "c.png", None, "Pending"), ("p4", "d.png", None, "Skipped"),
    ], "Product_ID string, image_path string, image_md5 string, Status string")
    out = validation.with_duplicate_images(rows)
    assert {r.Product_ID: r.duplicate_image_of for r in out.collect()} == {"p1": "p2", "p2": "p1", "p3": None, "p4": None}
    assert "none " in out._jdf.queryExecution().analyzed().toString()
