"""Query-side lexicon: compound parts, kept modifiers, English heads, and vendor names by unique nearest edit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import text
from millrace.operators.search import Index


def vendor_tokens(docs: DataFrame, vendor: str = "vendor") -> DataFrame:
    """(vendor_token) of a catalog, each once, not split into compounds."""
    return docs.select(F.explode(text.tokens(F.col(vendor))).alias("vendor_token")).distinct()


def _shortened(token: Column, most: Column) -> Column:
    """``token`` and what it becomes by deleting up to ``most`` (0 to 2) letters.

    Two words within d edits of each other share such a form with at most d
    letters deleted on either side, so equal forms find every candidate.
    """
    def once(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    one = F.array_distinct(once(token))
    two = F.array_distinct(F.flatten(F.transform(one, once)))
    own = F.array(token)
    return F.when(most <= 0, own).when(most == 1, F.array_union(own, one)).otherwise(F.array_union(F.array_union(own, one), two))


def corrections(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, corrected) for the ``words`` (token) that have exactly one nearest vendor token within their budget.

    Tokens that are vendor tokens, and tokens under five letters, stay as they
    are and have no row; so do tokens whose nearest vendor tokens tie.
    """
    budget = text.edit_budget(F.col("token"))
    open_ = words.select("token").distinct().where(budget > 0).join(vocabulary, F.col("token") == F.col("vendor_token"), "left_anti")
    left = open_.select("token", F.explode(_shortened(F.col("token"), budget)).alias("_form"))
    right = vocabulary.select("vendor_token", F.explode(_shortened(F.col("vendor_token"), F.lit(2))).alias("_form"))
    pairs = left.join(right, "_form").select("token", "vendor_token").distinct()
    near = pairs.withColumn("_d", F.levenshtein("token", "vendor_token")).where(F.col("_d") <= budget)
    first = near.groupBy("token", "_d").agg(F.count("*").alias("_n"), F.min("vendor_token").alias("corrected")).groupBy("token").agg(F.min_by(F.struct("_n", "corrected"), "_d").alias("_b"))
    return first.where(F.col("_b._n") == 1).select("token", "_b.corrected")


def expanded_terms(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, terms ARRAY<STRING>) in order of first mention: each token's own expansion, then its correction."""
    split = queries.select("query_id", F.posexplode(text.tokens(F.col("query"))).alias("pos", "token"))
    fixed = corrections(split.select("token"), vocabulary)
    one = split.join(fixed, "token", "left").select("query_id", "pos", F.array_compact(F.concat(text.query_expansion(F.col("token")), F.array("corrected"))).alias("_t"))
    listed = one.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_t"))).alias("_l"))
    return listed.select("query_id", F.array_distinct(F.flatten(F.transform("_l", lambda x: x["_t"]))).alias("terms"))


def lexicon_terms(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, term, n_terms), as ``search`` takes them."""
    return expanded_terms(queries, vocabulary).select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


@dataclass(frozen=True)
class Lexicon:
    vocabulary: DataFrame

    @classmethod
    def of(cls, docs: DataFrame) -> "Lexicon":
        return cls(vendor_tokens(docs))

    def terms(self, queries: DataFrame, index: Index) -> DataFrame:
        if not index.compound:
            raise ValueError("a lexicon asks for heads, which only an index with compound=True has")
        return lexicon_terms(queries, self.vocabulary)

    def describe(self) -> dict:
        return {
            "modifiers": sorted(text.MODIFIERS),
            "english_heads": dict(text.ENGLISH_HEADS),
            "vendor_fuzzy": {"vocabulary": "vendor tokens of the snapshot", "vendor_tokens": self.vocabulary.count(), "max_edits": "none under 5 letters, one under 8, else two", "applies_when": "the token is no vendor token and one vendor token alone is nearest"},
        }
