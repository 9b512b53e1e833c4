"""A shop's own ranking, captured from its search pages and replayed as a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.sources.http import HTML, Pages, search_url

# Fixed value: how result pages link a product and its position.
POSITION = r"(?i)/products/([^/?#\"']+)\?[^\"']*?_pos=(\d+)"


def ranked_handles(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, rank, handle) of each page: the first handle at each position, in order of position, in lower case."""
    found = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(POSITION), F.lit(1)).alias("h"), F.regexp_extract_all(F.col(html), F.lit(POSITION), F.lit(2)).alias("p"))
    links = pages.select(key, F.posexplode(found).alias("_at", "_l")).select(key, "_at", F.lower("_l.h").alias("handle"), F.col("_l.p").cast("decimal(38,0)").alias("_pos"))
    first = links.groupBy(key, "_pos").agg(F.min_by("handle", "_at").alias("handle"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_pos")).alias("rank"), "handle")


def handle_ids(catalog: DataFrame, order: str = "product_id") -> DataFrame:
    """(handle, product_id) in lower case; of several products with one handle the last by ``order``."""
    return catalog.groupBy(F.lower(F.coalesce("handle", F.lit(""))).alias("handle")).agg(F.max_by(F.col("product_id").cast("string"), F.col(order)).alias("product_id"))


def replay(handles: DataFrame, catalog: DataFrame, key: str, k: int = 20) -> DataFrame:
    """(key, at, handle, product_id, rank): the first ``k`` handles of each query; ``rank`` counts those the catalog knows, others have none."""
    cut = handles.where(F.col("rank") <= k).select(key, F.col("rank").alias("at"), "handle")
    named = cut.join(handle_ids(catalog), "handle", "left")
    known = F.col("product_id").isNotNull()
    rank = F.count_if(known).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return named.select(key, "at", "handle", "product_id", F.when(known, rank).cast("int").alias("rank"))


def overlap(replayed: DataFrame) -> DataFrame:
    """(mapped, unmapped)."""
    return replayed.agg(F.count("product_id").alias("mapped"), F.count_if(F.col("product_id").isNull()).alias("unmapped"))


def capture(pages: Pages, host: str, queries: DataFrame, catalog: DataFrame, crawl: str, k: int = 20, pauses: tuple[float, ...] = (10.0, 20.0, 30.0)) -> DataFrame:
    """``replay`` of live search pages for the report's queries (query_id, query)."""
    spark = queries.sparkSession
    found = [(r["query_id"], pages.insist(search_url(host, r["query"]), crawl, [HTML], pauses).decode("utf-8", "replace")) for r in queries.select("query_id", "query").collect()]
    return replay(ranked_handles(spark.createDataFrame(found, "query_id string, html string"), "query_id", "html"), catalog, "query_id", k)


def artifact(replayed: DataFrame, queries: list[dict], host: str, k: int) -> dict:
    """A captured run as a file holds it: by query its handles, those the catalog knows as ids and the others; counts of both; a report's size."""
    rows = sorted(replayed.collect(), key=lambda r: r["at"])
    of = {q["id"]: [r for r in rows if r["query_id"] == q["id"]] for q in queries}
    return {
        "domain": host, "k": k, "queries": {i: [r["product_id"] for r in found if r["rank"]] for i, found in of.items()}, "handles": {i: [r["handle"] for r in found] for i, found in of.items()},
        "unmapped": {i: [r["handle"] for r in found if not r["rank"]] for i, found in of.items()}, "mapped_count": sum(bool(r["rank"]) for r in rows), "unmapped_count": sum(not r["rank"] for r in rows),
    }
