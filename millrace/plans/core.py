"""The core operators' queries over the shops' tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions.times import clean_hash, parse_time, utc_text
from millrace.operators import history, incremental, nested, snapshot_diff
from millrace.session import table, work_dir, written


def latest_state(state: DataFrame) -> DataFrame:
    """Of several rows of a product the one last seen latest: (product_id, first_seen, last_seen, deleted_at), as timestamps."""
    parsed = state.select("product_id", "current_version", *(parse_time(c).alias(c) for c in ("first_seen", "last_seen", "deleted_at")))
    row = F.struct("first_seen", "last_seen", "deleted_at")
    return parsed.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.max_by(row, F.struct("last_seen", "current_version", "deleted_at")).alias("s")).select("product_id", "s.*")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's true sequence of versions and when each was valid."""
    state = latest_state(table(spark, sf_dir, "product_state"))
    log = table(spark, sf_dir, "product_version").select(
        "product_id", "version", parse_time("created_at").alias("at"), "loaded_at", clean_hash("source_payload_hash").alias("source"), clean_hash("enrichment_input_hash").alias("input")
    )
    undated = log.where(F.col("at").isNull()).join(state.select("product_id", "first_seen"), "product_id", "left").withColumn("at", F.coalesce("first_seen", "loaded_at")).drop("first_seen")
    events = log.where(F.col("at").isNotNull()).unionByName(undated)
    hashes = ["source", "input"]
    changes = history.change_log(events, ["product_id"], "at", hashes, "version")
    found = history.versions(changes, ["product_id"], hashes).join(state.select("product_id", "last_seen", "deleted_at"), "product_id", "left")
    gone = F.when(F.col("last_seen").isNull() | (F.col("deleted_at") > F.col("last_seen")), F.col("deleted_at"))
    return found.select("product_id", "version", utc_text(F.col("valid_from")).alias("valid_from"), F.coalesce(utc_text(F.coalesce("valid_to", gone)), F.lit("")).alias("valid_to"))


def product_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node and bridge tables of the product records' payloads, or, where null, of their columns, and the payloads that can't be read."""
    records = table(spark, sf_dir, "product_record")
    payload = F.coalesce("source_payload", F.to_json(F.struct("variants", "options", "images")))
    return nested.shred(records, F.col("product_id"), payload, nested.PRODUCT, ("product", "products"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants, options, option values, images, image-to-variant links and stock levels with their parents."""
    nodes, bridge, _ = product_tables(spark, sf_dir)
    found = nested.child_keys(nodes, bridge)
    return found.select(F.col("record_key").alias("product_id"), "child_kind", "parent_key", "child_key")


def enrichment_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Inputs asked for, each with what the cache holds of it, and the inputs done: (hash, status, result, run_id) both.

    An input is done by a completed row of a successful run with a result that
    is non-empty JSON; of several such rows the one of the largest run id, then
    result, stands. An input without one has nulls.
    """
    runs = table(spark, sf_dir, "enrichment_run").where(F.lower(F.trim("status")) == "success").select(F.trim("run_id").alias("run_id")).distinct()
    result = F.to_json(F.try_parse_json(F.trim("result")))
    cache = table(spark, sf_dir, "enrichment_cache").select(clean_hash("enrichment_input_hash").alias("hash"), F.lower(F.trim("status")).alias("status"), result.alias("result"), F.trim("run_id").alias("run_id"))
    usable = cache.where((F.col("status") == "completed") & F.col("result").isNotNull() & ~F.col("result").isin("null", "{}", "[]", '""') & F.col("hash").isNotNull())
    row = F.struct("run_id", "result", "status")
    done = written(usable.join(runs, "run_id", "left_semi").groupBy("hash").agg(F.max(row).alias("r")).select("hash", "r.status", "r.result", "r.run_id"), "done")
    asked = table(spark, sf_dir, "product_enrichment").select(clean_hash("enrichment_input_hash").alias("hash")).where(F.col("hash").isNotNull()).distinct()
    return asked.join(done, "hash", "left"), done


CONTENT = ["status", "result", "run_id"]


def finished(inputs: DataFrame) -> DataFrame:
    """What a run records of inputs it is done with: their key and the hash of what the cache holds of them."""
    return inputs.select(F.col("hash").alias("key"), incremental.content_hash(CONTENT).alias("content_hash"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the enrichment inputs the next run has to process, each once: those that what the successful runs recorded doesn't cover."""
    inputs, done = enrichment_inputs(spark, sf_dir)
    state = incremental.ProcessingState(spark, f"{work_dir(spark)}/enrichment-{uuid.uuid4().hex}")
    state.commit(finished(done))
    return state.changes(inputs, F.col("hash"), CONTENT).select(F.col("key").alias("enrichment_input_hash"))


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run INT, enrichment_input_hash, change) of three runs over one state: the first finds it empty, the second has more results, the third the same.

    The first run sees no results of the runs that finished in the later half of
    the time, so an input with such a result alone is changed at the second.
    """
    inputs, done = enrichment_inputs(spark, sf_dir)
    ended = table(spark, sf_dir, "enrichment_run").where(F.col("finished_at").isNotNull())
    middle = ended.agg(F.percentile_approx("finished_at", 0.5)).first()[0]
    late = ended.where(F.col("finished_at") > F.lit(middle)).select(F.trim("run_id").alias("run_id")).distinct()
    early = done.join(late, "run_id", "left_anti")
    path, out = f"{work_dir(spark)}/runs-{uuid.uuid4().hex}", None
    for run, known in enumerate((early, done, done), 1):
        state = incremental.ProcessingState(spark, path)
        now = inputs.select("hash").join(known, "hash", "left")
        found = written(state.changes(now, F.col("hash"), CONTENT), "found")
        state.commit(found)
        one = found.select(F.lit(run).alias("run"), F.col("key").alias("enrichment_input_hash"), "change")
        out = one if out is None else out.unionByName(one)
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that each complete snapshot of a feed added, removed or changed."""
    hashes = {"source": "source_payload_hash", "input": "enrichment_input_hash"}
    entries = table(spark, sf_dir, "snapshot_entry").where(F.col("run_id").isNotNull() & F.col("product_id").isNotNull())
    entries = entries.select("run_id", "product_id", *(snapshot_diff.fingerprint(clean_hash(h)).alias(c) for c, h in hashes.items()))
    entries = written(entries.groupBy("run_id", "product_id").agg(*(F.max(c).alias(c) for c in hashes)), "entries")
    crawls = table(spark, sf_dir, "manifest").where(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.max("feed_id").alias("feed_id"), F.max("product_count").alias("product_count"), F.max(parse_time("crawled_at")).alias("crawled_at")
    )
    held = entries.groupBy("run_id").agg(F.count("*").alias("n"))
    complete = crawls.join(held, "run_id", "left").where(F.coalesce("n", F.lit(0)) == F.col("product_count"))
    complete = complete.withColumn("seq", F.row_number().over(Window.partitionBy("feed_id").orderBy("crawled_at", "run_id")))
    complete = written(complete.select("run_id", "feed_id", "seq", "product_count"), "snapshots")
    depth = snapshot_diff.leaf_depth(complete.agg(F.max("product_count")).first()[0] or 0)
    rows = snapshot_diff.carry_forward(entries.join(complete.drop("product_count"), "run_id"), "feed_id", "seq", "product_id", list(hashes))
    pairs = complete.where(F.col("seq") > 1).select("feed_id", (F.col("seq") - 1).alias("before"), F.col("seq").alias("after"))
    found = snapshot_diff.snapshot_changes(rows, "feed_id", "seq", "product_id", list(hashes), depth, pairs, nulls_differ=False, unique=True)
    kind = F.when(F.col("change") != "changed", F.col("change")).when(F.array_contains("differing", "input"), "enrichment_stale").otherwise("source_changed")
    return found.withColumn("change", kind).join(complete.select("feed_id", "seq", "run_id"), ["feed_id", "seq"]).select("feed_id", "run_id", "product_id", "change")


QUERY_FUNCTIONS = (p1_found, p3_found, p5_found, p5_runs, p7_found)
