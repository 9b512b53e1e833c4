"""Fielded BM25 over DataFrames: index, query terms, batched search.

All queries are answered by one job. Postings carry their document length, so
scoring joins only with tables that the query terms have made small; how these
are joined is left to the optimizer, which knows their sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import text
from millrace.session import written

# Parameters the published results were made with.
WEIGHTS = {"title": 5.0, "vendor": 4.0, "product_type": 3.0, "tags": 2.0, "body": 1.0}
K1, B = 1.2, 0.75

PUSHED = 1_000  # distinct terms that a search sends to the scan as a filter


def fielded(records: DataFrame, decode_body: bool = True) -> DataFrame:
    """(doc_id, title, vendor, product_type, tags, body) of catalog records; tags joined by a space, the body without tags, nulls empty."""
    empty = F.lit("")
    return records.select(
        F.col("product_id").cast("string").alias("doc_id"),
        *(F.coalesce(c, empty).alias(c) for c in ("title", "vendor", "product_type")),
        F.coalesce(F.array_join("tags", " "), empty).alias("tags"),
        (text.strip_tags(F.col("body_html")) if decode_body else F.coalesce("body_html", empty)).alias("body"),
    )


@dataclass(frozen=True)
class Index:
    """``postings`` (doc_id, field, term, tf, dl), ``stats`` (field, n, avgdl, weight), both made of ``analysed`` (doc_id, field, tokens)."""

    postings: DataFrame
    stats: DataFrame
    analysed: DataFrame
    compound: bool
    weights: dict[str, float]

    def kept(self) -> "Index":
        """This index written to the shared folder, for several searches.

        Texts are analysed once. Postings carry their term's df and lie in order of their terms, so a
        search reads only the row groups of the terms it asks for; a frequent
        term spans several files.
        """
        once = _index(written(self.analysed, "analysed"), self.compound, self.weights)
        counted = once.postings.join(once.document_frequency(), ["field", "term"])
        ordered = counted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        return Index(written(ordered, "postings"), written(once.stats, "stats"), once.analysed, self.compound, self.weights)

    def document_frequency(self) -> DataFrame:
        """(field, term, df)."""
        if "df" in self.postings.columns:
            return self.postings.select("field", "term", "df").distinct()
        return self.postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def _index(analysed: DataFrame, compound: bool, weights: dict[str, float]) -> Index:
    long = analysed.withColumn("dl", F.size("tokens"))
    postings = long.select("doc_id", "field", "dl", F.explode("tokens").alias("term")).groupBy("doc_id", "field", "term", "dl").agg(F.count("*").alias("tf"))
    weight = F.coalesce(*(F.when(F.col("field") == f, F.lit(float(w))) for f, w in weights.items()))
    stats = long.groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").alias("_sum")).select("field", "n", (F.col("_sum") / F.col("n")).alias("avgdl"), weight.alias("weight"))
    return Index(postings, stats, analysed, compound, weights)


def build_index(docs: DataFrame, compound: bool = False, weights: dict[str, float] | None = None) -> Index:
    """Index of ``docs``: doc_id and a text column for each field of ``weights``.

    A field's length counts its expanded tokens; fields without tokens count
    in the average. Documents are told apart by doc_id, which must be unique.
    """
    weights = weights or WEIGHTS
    # fields become rows first, so that the analysis is one expression and not one a field
    listed = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in weights))
    fields = docs.select("doc_id", F.explode(listed).alias("f")).select("doc_id", "f.field", "f.text")
    return _index(fields.select("doc_id", "field", text.field_tokens(F.col("text"), compound).alias("tokens")), compound, weights)


def query_terms(queries: DataFrame, compound: bool = False) -> DataFrame:
    """(query_id, term, n_terms) of queries (query_id, query): the set of their tokens as documents are analysed."""
    terms = queries.select("query_id", F.array_distinct(text.field_tokens(F.col("query"), compound)).alias("_t"))
    return terms.select("query_id", F.size("_t").alias("n_terms"), F.explode("_t").alias("term"))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def search(index: Index, terms: DataFrame, k: int = 20, k1: float = K1, b: float = B, coord: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score) of each query's ``k`` best documents.

    Ranks go by score, to nine decimals so that the order of summation can't
    matter, then by doc_id as a string. With ``coord`` a score is multiplied by
    the share of the query's terms that the document has in any field. Queries
    without terms and documents without matches give no rows.
    """
    asked = terms.select("term").distinct()
    few = [r["term"] for r in asked.limit(PUSHED + 1).collect()]
    # a bounded list is a filter that the scan can use; more terms are a join
    found = index.postings.where(F.col("term").isin(few)) if len(few) <= PUSHED else index.postings.join(asked, "term", "left_semi")
    if "df" not in found.columns:
        found = found.join(found.groupBy("field", "term").agg(F.count("*").alias("df")), ["field", "term"])
    scored = found.join(index.stats, "field")
    average = F.coalesce(F.nullif(F.col("avgdl"), F.lit(0.0)), F.lit(1.0))
    norm = F.col("tf") + F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * F.col("dl") / average)
    part = F.col("weight") * inverse_frequency(F.col("n"), F.col("df")) * (F.col("tf") * F.lit(k1 + 1.0)) / norm
    # fields of a term meet first: then a document's terms are counted without a distinct
    by_term = scored.select("term", "doc_id", part.alias("_s")).groupBy("term", "doc_id").agg(F.sum("_s").alias("_s"))
    total = by_term.join(terms, "term").groupBy("query_id", "doc_id", "n_terms").agg(F.sum("_s").alias("_s"), F.count("*").alias("_m"))
    score = F.col("_s") * F.col("_m") / F.col("n_terms") if coord else F.col("_s")
    total = total.select("query_id", "doc_id", F.round(score, 9).alias("score")).where(F.col("score") > 0)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def best(index: Index, query: str, k: int = 20, **how) -> DataFrame:
    """(doc_id, score) of one query's best documents, in order."""
    spark = index.postings.sparkSession
    asked = spark.createDataFrame([("q", query)], "query_id string, query string")
    return search(index, query_terms(asked, index.compound), k, **how).orderBy("rank").select("doc_id", "score")
