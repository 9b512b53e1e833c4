"""Queries of the catalog-sync operators: the catalog as one crawl, and a changed copy of it as the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators import catalog as c
from millrace.plans.search import catalog
from millrace.session import table, written


def _joined(*columns: Column) -> Column:
    """SHA-256 of columns with a separator between, computed alike in SQL."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(x, F.lit("")) for x in columns)), 256)


def _crawl(rows: DataFrame) -> DataFrame:
    tags, prices = F.array_join("tags", ","), F.array_join("prices", ",", "")
    return rows.select(
        "product_id", "title", "vendor", _joined(F.col("title"), F.col("vendor"), F.col("product_type"), F.col("body_html"), tags, prices).alias("source_payload_hash"),
        _joined(F.col("title"), F.col("vendor"), F.col("product_type"), F.col("body_html"), tags).alias("enrichment_input_hash"),
    ).withColumn("payload", F.col("source_payload_hash")).withColumn("input_payload", F.col("enrichment_input_hash"))


def _digit() -> Column:
    return F.substring(F.md5("product_id"), 1, 1)


def crawls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The catalog, and one where products by the hash of their id are gone, have another price, another title, or are new."""
    first = catalog(spark, sf_dir)
    d = _digit()
    second = first.where(d != "0")
    second = second.withColumn("title", F.when(d == "1", F.concat(F.coalesce("title", F.lit("")), F.lit(" (ny)"))).otherwise(F.col("title")))
    second = second.withColumn("prices", F.when(d.isin("1", "2"), F.array(F.lit("1.00"))).otherwise(F.col("prices")))
    second = second.withColumn("product_id", F.when(d == "3", F.concat(F.lit("n"), "product_id")).otherwise(F.col("product_id")))
    return _crawl(first), _crawl(second)


def dup_ids(spark, sf_dir):
    return c.duplicate_ids(table(spark, sf_dir, "product_record").where(F.col("product_id").isNotNull())).select("product_id", F.col("n").cast("bigint").alias("n"))


def manifest_digest(spark, sf_dir):
    return c.manifest_digest(crawls(spark, sf_dir)[0]).select(F.col("count").cast("bigint").alias("n"), "digest")


def crawl_diff(spark, sf_dir):
    return c.crawl_difference(*crawls(spark, sf_dir))


def drop_gate(spark, sf_dir):
    """Whether each store's second crawl is too small against its first."""
    first, second = crawls(spark, sf_dir)
    one = first.groupBy("vendor").agg(F.count("*").alias("previous"))
    two = second.groupBy("vendor").agg(F.count("*").alias("n"))
    rows = one.join(two, "vendor", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("vendor", "previous", "n", c.is_refused(F.col("n"), F.col("previous")).alias("rejected"))


def _two_syncs(spark, sf_dir):
    first, second = crawls(spark, sf_dir)
    empty = c.Store(*(spark.createDataFrame([], schema) for schema in c.STORE.values()))
    store, counts_1 = c.sync(empty, first, "2026-01-01T00:00:00Z")
    after, counts_2 = c.sync(store, second, "2026-01-08T00:00:00Z")
    return store, after, counts_1, counts_2


def sync_outcomes(spark, sf_dir):
    _, _, one, two = _two_syncs(spark, sf_dir)
    return one.withColumn("run", F.lit(1)).unionByName(two.withColumn("run", F.lit(2))).where(F.col("n") > 0).select("run", "outcome", F.col("n").cast("bigint").alias("n"))


def sync_state(spark, sf_dir):
    return _two_syncs(spark, sf_dir)[1].product_state


def sync_versions(spark, sf_dir):
    return _two_syncs(spark, sf_dir)[1].product_version.select("product_id", "version", "source_payload_hash", "enrichment_input_hash", "created_at")


def enrichment_queue(spark, sf_dir):
    """Pending inputs after both merges, each once."""
    return c.pending_enrichment(_two_syncs(spark, sf_dir)[1].enrichment_cache)


def enrichment_links(spark, sf_dir):
    """Which product asked for which input, and when first."""
    return _two_syncs(spark, sf_dir)[1].product_enrichment


def completed_job(spark, sf_dir):
    """The cache after the first of the pending inputs is completed."""
    cache = written(_two_syncs(spark, sf_dir)[1].enrichment_cache, "cache")
    first = cache.agg(F.min("enrichment_input_hash")).first()[0]
    done = c.complete_enrichment(cache, first, {"colour": "blå"}, "raw", "2026-01-09T00:00:00Z")
    return done.select("enrichment_input_hash", "status", "result", "raw_response", "created_at", "completed_at")


def verified_crawl(spark, sf_dir):
    """Count and digest of a crawl that agrees with the one before it."""
    first = written(crawls(spark, sf_dir)[0], "crawl")
    _, core = c.verify_crawls(first, first)
    return spark.createDataFrame([(core["schema_version"], core["count"], core["digest"])], "schema_version int, n bigint, digest string")


def soft_delete(spark, sf_dir):
    state = _two_syncs(spark, sf_dir)[1].product_state
    return state.agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"))


def pending_jobs(spark, sf_dir):
    """Pending inputs of the shops' own cache."""
    cache = table(spark, sf_dir, "enrichment_cache")
    return c.pending_enrichment(cache).distinct()


def canonical_json_hash(spark, sf_dir):
    """Every payload: both digests in canonical JSON of those that a crawl accepts as raw products, and what is wrong with the others."""
    rows = table(spark, sf_dir, "product_record").where(F.col("source_payload").isNotNull())
    good, bad = c.quarantined(rows.select("product_id", "source_payload"), "source_payload")
    hashed = c.with_enrichment_hash(c.normalize(good, "source_payload")).select("product_id", "source_payload_hash", "enrichment_input_hash", F.lit(None).cast("string").alias("fault"))
    none = F.lit(None).cast("string")
    return hashed.unionByName(bad.select("product_id", none.alias("source_payload_hash"), none.alias("enrichment_input_hash"), "fault")).distinct()


QUERY_FUNCTIONS = (dup_ids, manifest_digest, crawl_diff, drop_gate, sync_outcomes, sync_state, sync_versions, enrichment_queue, enrichment_links, completed_job, verified_crawl, soft_delete, pending_jobs, canonical_json_hash)
