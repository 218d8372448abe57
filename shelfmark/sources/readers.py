"""Readers: catalogue exports, price sheets, feeds, sitemaps, pages, brochures, images, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schema
from shelfmark.functions.text import strip
from shelfmark.operators.brochures import text_pages
from shelfmark.operators.pages import FEED


class MissingTable(Exception):
    """A table the job expects is not there."""


def require_table(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise MissingTable(f"table '{name}' was not found; check the catalogue database and the table's name")
    return spark.table(name)


def read_catalogue(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A catalogue export as a full catalogue table; missing columns are null, numbers are read leniently."""
    if fmt == "csv":
        return schema.catalogue(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    return schema.catalogue(spark.read.format(fmt).load(path))


def read_price_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Tabular sheets of one layout, all columns as text, with the file and the line order."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    return df.withColumns({"sheet": F.col("_metadata.file_path"), "row_idx": F.monotonically_increasing_id()})


def read_price_text(spark: SparkSession, path: str) -> DataFrame:
    """Free-text sheets, one row per non-empty line."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("sheet"), F.monotonically_increasing_id().alias("row_idx"), strip("value").alias("raw_text"))
    return lines.where(F.col("raw_text") != "")


def read_listing_feed(spark: SparkSession, path: str) -> DataFrame:
    """Store feeds, one JSON document per file named after the shop's domain."""
    feed = T.StructType.fromDDL(FEED)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return spark.read.schema(feed).option("multiLine", True).json(path).select(name.alias("domain"), "products")


def read_sitemap(spark: SparkSession, path: str, child: bool = False) -> DataFrame:
    """Locations of a sitemap file; child marks entries of a nested product sitemap."""
    df = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    return df.select("loc", F.lit(child).alias("child"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses."""
    return schema.conform(spark.read.parquet(path), schema.PAGES)


def read_brochure_pages(spark: SparkSession, path: str) -> DataFrame:
    """Brochure text by page, without pages that have no text layer."""
    return text_pages(schema.conform(spark.read.parquet(path), schema.BROCHURE_PAGE))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with path (relative to it) and length; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select(_relative(F.col("path"), root).alias("path"), "length")


def _relative(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/" if "://" not in root else "/" + root.split("://", 1)[1].strip("/") + "/"
    return F.replace(plain, F.lit(base), F.lit(""))


def read_image_assets(spark: SparkSession, root: str) -> DataFrame:
    """Image files: path relative to the folder, length, md5, width, height and mean corner colour.

    A file that cannot be decoded has null width and height.
    """
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        _relative(F.col("path"), root).alias("path"), "length", F.md5("content").alias("md5"))
    decoded = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root)
    facts = decoded.select(
        _relative(F.col("image.origin"), root).alias("path"), F.col("image.width").alias("width"),
        F.col("image.height").alias("height"), *corner_colour(F.col("image")))
    return content.join(facts, "path", "left")


def corner_colour(image: Column) -> list[Column]:
    """Mean r, g, b of the four pixels five in from each corner. Pixels are stored as BGR rows."""
    width, height, channels = image["width"], image["height"], image["nChannels"]
    right, low = F.greatest(width - 6, F.lit(0)), F.greatest(height - 6, F.lit(0))
    left, top = F.least(F.lit(5), width - 1), F.least(F.lit(5), height - 1)

    def sample(x: Column, y: Column, offset: int) -> Column:
        at = (y * width + x) * channels + F.least(F.lit(offset), channels - 1) + 1
        return F.conv(F.hex(F.substring(image["data"], at, F.lit(1))), 16, 10).cast("double")

    def mean(offset: int) -> Column:
        return (sample(left, top, offset) + sample(right, top, offset) + sample(left, low, offset) + sample(right, low, offset)) / 4

    return [mean(2).alias("r"), mean(1).alias("g"), mean(0).alias("b")]


_GOLDEN = ("struct<product_id:string,brand:string,category:string,model_name:string,display_name:string,source_url:string,"
           "tier:string,spec_count:int,status:string,image_status:string,image_path:string>")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A baseline as JSON lines, the form that write_golden writes. Blank display names were stored as 'nan'.

    Lines of one object, product id -> fields, are read too: each line is a map of any number of products.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    one, several = F.from_json("value", _GOLDEN), F.from_json("value", f"map<string,{_GOLDEN}>")
    rows = lines.select(F.explode(F.when(F.col("value").rlike(r"^\s*\{\s*\"[^\"]*\"\s*:\s*\{"), F.map_values(several)).otherwise(F.array(one))).alias("g")).select("g.*")
    return rows.withColumn("display_name", F.nullif("display_name", F.lit("nan")))
