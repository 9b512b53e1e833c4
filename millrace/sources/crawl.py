"""Paged product crawls: walking a host's pages, and reading kept or saved pages as checked rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators import catalog
from millrace.operators.catalog import InconsistentCrawl
from millrace.session import written
from millrace.sources.http import Pages

PAGE = 250
LISTS = ("variants", "options", "images")


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT<"))


def _fault(product: Column) -> Column:
    """What keeps a VARIANT from being a raw product, null if nothing does."""
    found = F.when(~F.coalesce(_is_object(product), F.lit(False)), "is no object").when(~F.contains(F.schema_of_variant(product), F.lit("id: ")) | F.try_variant_get(product, "$.id", "string").isNull(), "has no id")
    for name in LISTS:
        value, items = F.try_variant_get(product, f"$.{name}", "variant"), F.try_variant_get(product, f"$.{name}", "array<variant>")
        given = value.isNotNull() & ~F.is_variant_null(value)
        found = found.when(given & ~F.coalesce(F.forall(items, lambda x: F.coalesce(_is_object(x), F.lit(False))), F.lit(False)), f"has {name} that are no list of objects")
    return found


def products(pages: DataFrame) -> DataFrame:
    """(page, position, raw, fault) of ``pages`` (page, body): each product as JSON text, in order.

    A page that can't be read, or that lists no products, is one row with a
    fault and no position; a product of another shape has its fault beside it.
    Nothing is left out.
    """
    parsed = pages.select("page", F.try_parse_json("body").alias("_v")).select("page", "_v", F.try_variant_get("_v", "$.products", "array<variant>").alias("_p"))
    page_fault = F.when(F.col("_v").isNull(), "is no JSON").when(F.col("_p").isNull(), "has no list of products")
    rows = parsed.select("page", page_fault.alias("_f"), F.posexplode_outer("_p").alias("position", "_x")).where(F.col("_f").isNotNull() | F.col("position").isNotNull())
    return rows.select("page", "position", F.to_json("_x").alias("raw"), F.coalesce("_f", F.when(F.col("position").isNotNull(), _fault(F.col("_x")))).alias("fault"))


def sound(rows: DataFrame) -> DataFrame:
    """(raw) of the rows of ``products``, if all are without fault; else InconsistentCrawl says how many aren't, and why the first isn't."""
    bad = rows.where(F.col("fault").isNotNull())
    if first := bad.orderBy("page", "position").first():
        raise InconsistentCrawl(f"{bad.count()} faults in the pages; page {first['page']}, product {first['position']}: {first['fault']}")
    return rows.select("raw")


def walk(pages: Pages, host: str, crawl: str, most: int = 60) -> list[str]:
    """The files of a host's product pages, up to the first that lists none; no page's content is held."""
    files = []
    for n in range(1, most + 1):
        url = f"https://{host}/products.json?limit={PAGE}&page={n}"
        try:
            said = json.loads(pages.page(url, crawl))
        except ValueError:
            said = None  # reported with its page when the files are read
        files.append(pages.kept_at(url, crawl))
        if said is None or not isinstance(said, dict) or not said.get("products"):
            return files
    raise InconsistentCrawl(f"page {most} of {host} is not the last")


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``products`` of saved pages, a page by the name of its file."""
    files = spark.read.format("binaryFile").load(paths)
    return products(files.select(F.element_at(F.split("path", "/"), -1).alias("page"), F.decode("content", "UTF-8").alias("body")))


def crawl_verified(spark: SparkSession, pages: Pages, host: str, attempt: str, most: int = 60, **gates) -> tuple[DataFrame, dict]:
    """Normalised records of the second of two crawls that agree, and their manifest."""
    seen = []
    for half in ("first", "second"):
        rows = written(read_pages(spark, walk(pages, host, f"{attempt}/{half}", most)), "crawled")
        seen.append(catalog.normalize(sound(rows)))
    return catalog.verify_crawls(*seen, **gates)
