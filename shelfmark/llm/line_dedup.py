"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages are grouped by host. For every line the share of its host's pages that contain it is taken; lines on more than
`ratio` of the pages, and on at least `min_pages` of them, are boilerplate and leave every page of that host. So are, on
hosts that are large enough to tell them, lines on more than `low_ratio` of the pages and on at least `many_pages`: a
site line that one section in ten or fifteen carries stays under `ratio` at any size, while chance and copies do not
reach a twentieth of hundreds of pages. Two things guard that step. Where `many_pages` are more than `ratio` of a host,
`ratio` alone decides, for a few pages of chance are a large share there. And the pages must hold at least `MANY_TEXTS`
of 64 marks of their whole texts, so that a group of exact copies, however large, makes no line boilerplate by itself.

First pass: each page yields its distinct lines as digests, counted by (host, digest) with partial sums before the
shuffle, so that neither a hot host nor a hot line meets in one task. A host has at most (lines per page) / ratio
boilerplate lines (the lower ratio where that holds), since each takes up more than a ratio of its pages: their digests are written as one array per host.
Second pass: every page intersects its lines with that array. Spark knows the size of the written arrays and broadcasts
them up to its threshold; beyond it texts are shuffled by host, and adaptive execution splits the hot ones.

Defined results: a null text has no lines and stays null; empty and blank lines are never judged and always stay; a
null host is a host of its own; repeated rows count as pages of their own; an empty table gives an empty one. Lines are
cut at line feeds and compared as they are. Extra columns are kept by `dedup_lines` (its own are prefixed with `__`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import written

RATIO = 0.1
MIN_PAGES = 3
LOW_RATIO = 0.05
MANY_PAGES = 20
#: Marks of different texts among 64; 20 different texts leave about 17.
MANY_TEXTS = 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _judged(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.trim(x) != "")


def _host(col: Column) -> Column:
    """A key that is never null and keeps null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES, low_ratio: float | None = LOW_RATIO, many_pages: int = MANY_PAGES) -> DataFrame:
    """One row for each host that has boilerplate: __host, __bad (digests of its lines). A low_ratio of None leaves `ratio` alone."""
    digests = F.array_distinct(F.transform(_judged(_lines(F.col(text_col))), F.md5))
    pages, common = F.col("__pages"), F.col("__pages") > F.lit(ratio) * F.col("__total")
    marks = []
    if low_ratio is not None:
        place = (F.conv(F.substring(F.md5(text_col), 1, 2), 16, 10).cast("int") % 64)
        marks = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), "__place")).alias("__marks")]
        many = (pages >= many_pages) & (pages > F.lit(low_ratio) * F.col("__total")) & (F.bit_count("__marks") >= MANY_TEXTS)
        common = common | many
    lines = docs.select(_host(F.col(host_col)).alias("__host"), F.explode(digests).alias("__line"), *([place.alias("__place")] if marks else []))
    seen = lines.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__pages"), *marks).where(pages >= min_pages)
    totals = docs.groupBy(_host(F.col(host_col)).alias("__host")).agg(F.count(F.lit(1)).alias("__total"))
    return (
        seen.join(totals, "__host").where(common)
        .groupBy("__host").agg(F.collect_list("__line").alias("__bad"))
    )


def dedup_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES, low_ratio: float | None = LOW_RATIO, many_pages: int = MANY_PAGES) -> DataFrame:
    """The rows of docs with __lines (how many), __removed (how many left), and the text without boilerplate."""
    bad = written(boilerplate(docs, host_col, text_col, ratio, min_pages, low_ratio, many_pages))
    lines = _lines(F.col(text_col))
    joined = docs.withColumn("__host", _host(F.col(host_col))).join(bad, "__host", "left")
    mine = F.array_intersect(F.transform(_judged(lines), F.md5), F.coalesce("__bad", F.array().cast("array<string>")))
    found = joined.withColumn("__mine", mine).drop("__bad", "__host")
    kept = F.when(F.size("__mine") > 0, F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("__mine", F.md5(x))))
    return (
        found.withColumn("__lines", F.coalesce(F.size(lines), F.lit(0)))
        .withColumn("__kept", F.when(F.col(text_col).isNotNull(), F.coalesce(kept, lines)))
        .withColumn("__removed", F.when(F.size("__mine") > 0, F.col("__lines") - F.size("__kept")).otherwise(0))
        .withColumn(text_col, F.array_join("__kept", "\n"))
        .drop("__kept", "__mine")
    )
