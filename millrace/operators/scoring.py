"""Ranking measures of runs against graded relevance.

Runs are (system, query_id, rank, product_id), qrels (query_id, product_id,
grade), queries (query_id, query, stratum).
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window, functions as F

ABSENT = "adversarial/absent"  # fixed value
STRATA = ("exact/brand", "category", "compound", "attribute", "cross-language", "misspelling", "natural language", ABSENT)  # fixed order of the report


def discounted(gain: Column, rank: Column) -> Column:
    """(2**gain - 1) / log2(rank + 1)."""
    return (F.pow(F.lit(2.0), gain.cast("double")) - 1.0) / F.log2(rank.cast("double") + 1.0)


def dcg(rows: DataFrame, by: list[str], rank: str, gain: str, k: int) -> DataFrame:
    """(*by, dcg): discounted gain of the first ``k`` ranks of each group."""
    term = F.when(F.col(rank) <= k, discounted(F.col(gain), F.col(rank))).otherwise(0.0)
    return rows.groupBy(*by).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("dcg"))


def ideal_dcg(qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, ideal, relevant): the best discounted gain that all of a query's grades allow, and its grades of two and more.

    Judgements are counted by grade first: a query has a row for each grade it
    gives, however many products it judges.
    """
    counts = qrels.groupBy("query_id", "grade").agg(F.count("*").alias("_n"))
    above = Window.partitionBy("query_id").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    discounts = F.array(*(F.lit(1.0 / log2(rank + 1)) for rank in range(1, k + 1))).cast("array<double>")
    room = F.least(F.col("_n"), F.greatest(F.lit(k) - F.col("_before"), F.lit(0))).cast("int")
    taken = F.aggregate(F.slice(discounts, F.col("_before").cast("int") + 1, room), F.lit(0.0), lambda total, d: total + d)
    return placed.groupBy("query_id").agg(
        F.sum((F.pow(F.lit(2.0), F.col("grade").cast("double")) - 1.0) * taken).alias("ideal"), F.coalesce(F.sum(F.when(F.col("grade") >= 2, F.col("_n"))), F.lit(0)).alias("relevant")
    )


def score_queries(runs: DataFrame, qrels: DataFrame, queries: DataFrame, systems: list[str], k: int = 10, relevant_at: int = 2) -> DataFrame:
    """(system, query_id, query, stratum, ndcg, precision, returned, relevant), a row for every system and query.

    A query without results scores 0. nDCG's ideal is that of all judged
    documents; precision divides by ``k`` also for short lists, and is 0 for k
    of 0 or less. Documents that come twice count twice.
    """
    judged = runs.join(qrels, ["query_id", "product_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    inside = F.col("rank") <= k
    got = judged.groupBy("system", "query_id").agg(
        F.sum(F.when(inside, discounted(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.count_if(inside & (F.col("grade") >= relevant_at)).alias("_hits"),
        F.count("*").alias("returned"),
    )
    grid = queries.select(F.explode(F.array(*map(F.lit, systems))).alias("system"), "query_id", "query", "stratum")
    rows = grid.join(got, ["system", "query_id"], "left").join(ideal_dcg(qrels, k), "query_id", "left")
    ndcg = F.coalesce(F.try_divide(F.coalesce("dcg", F.lit(0.0)), F.nullif(F.col("ideal"), F.lit(0.0))), F.lit(0.0))
    hits = F.coalesce("_hits", F.lit(0)).cast("double")
    return rows.select(
        "system", "query_id", "query", "stratum", ndcg.alias("ndcg"), (hits / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias("precision"),
        F.coalesce("returned", F.lit(0)).cast("long").alias("returned"), F.coalesce("relevant", F.lit(0)).cast("long").alias("relevant"),
    )


def score_systems(per_query: DataFrame) -> DataFrame:
    """(system, ndcg, precision, answerable_ndcg, absent_returned): means over all queries, over the answerable ones, and what absent ones returned."""
    absent = F.col("stratum") == ABSENT
    return per_query.groupBy("system").agg(
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(F.when(~absent, F.col("ndcg"))), F.lit(0.0)).alias("answerable_ndcg"), F.coalesce(F.sum(F.when(absent, F.col("returned"))), F.lit(0)).alias("absent_returned"),
    )


def score_strata(per_query: DataFrame) -> DataFrame:
    """(system, stratum, ndcg)."""
    return per_query.groupBy("system", "stratum").agg(F.avg("ndcg").alias("ndcg"))


def strata_table(per_query: DataFrame, systems: list[str]) -> DataFrame:
    """(position, stratum, one column a system) of the known strata in the report's order; a cell without queries is 0."""
    order = F.array_position(F.array(*map(F.lit, STRATA)), F.col("stratum"))
    wide = per_query.where(F.col("stratum").isin(*STRATA)).groupBy("stratum").pivot("system", systems).agg(F.avg("ndcg"))
    return wide.select(order.alias("position"), "stratum", *(F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(s) for s in systems))


def query_table(per_query: DataFrame, systems: list[str]) -> DataFrame:
    """(query_id, query, stratum, one nDCG column a system); null where a system has none."""
    return per_query.groupBy("query_id", "query", "stratum").pivot("system", systems).agg(F.first("ndcg"))


def examples(runs: DataFrame, qrels: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """(system, query_id, rank, product_id, title, grade) of the first ``k`` results; a missing title is the id, a missing grade 0."""
    titles = catalog.select(F.col("product_id").cast("string").alias("product_id"), F.coalesce("title", F.lit("")).alias("title"))
    rows = runs.where(F.col("rank") <= k).join(titles, "product_id", "left").join(qrels, ["query_id", "product_id"], "left")
    return rows.select("system", "query_id", "rank", "product_id", F.coalesce("title", "product_id").alias("title"), F.coalesce("grade", F.lit(0)).alias("grade"))
