"""Free-entered values mapped to a canonical list, by token repair and soft TF-IDF.

Each distinct token of the values is joined to the reference list's vocabulary
by edit distance, over equal strings with up to two letters deleted, so no two
lists are crossed. Entries are then ranked for each value by the soft TF-IDF of
the repaired tokens: the cosine of both sides' weighted tokens, nearness of
spelling counting as a share. What a word around a value weighs isn't listed
but learned: one that stands beside many different entries says nothing.
Values whose best entry is under a threshold are reported with -1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.edits import with_edits
from millrace.session import written

_FROM, _TO = "åäâàáãöøôòóõüûùúéèêëíìîïñçæœ", "aaaaaaoooooouuuueeeeiiiincao"


def folded(value: Column) -> Column:
    """Lower case without accents; letters written as two (aa, ae, oe) are one, on both sides of a comparison."""
    return F.regexp_replace(F.regexp_replace(unaccented(value), "a[ae]", "a"), "oe", "o")


def unaccented(value: Column) -> Column:
    plain = F.regexp_replace(F.lower(value), r"\p{M}|[®™©’'`´\u200b\u00ad]", "")
    return F.regexp_replace(F.translate(plain, _FROM, _TO), "ß", "ss")


def tokens(value: Column, fold: Callable[[Column], Column] = folded) -> Column:
    """The distinct words of a value, in order."""
    return F.array_distinct(F.filter(F.split(fold(value), "[^a-z0-9]+"), lambda t: t != ""))


def deletions(token: Column, most: int) -> Column:
    """``token`` and all it becomes by deleting up to ``most`` letters."""

    def once(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, 1, i - 1), F.substring(t, i + 1, F.length(t))))

    out, last = F.array(token), F.array(token)
    for n in range(most):
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda t: F.length(t) > 1), once)))
        out = F.when(F.length(token) >= (3, 6)[n], F.array_union(out, last)).otherwise(out)
    return out


def repaired(words: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(field, token, meant, edits) for distinct ``words`` and ``vocabulary`` (both field, token) within ``most`` edits.

    A swap of neighbours is one edit. Words of under three letters must be
    equal, and under six within one edit, as their neighbours are too many.
    Words longer than any of the vocabulary by more than ``most`` can have no
    neighbour in it and are left out before anything is spelled.
    """
    longest = vocabulary.groupBy("field").agg((F.max(F.length("token")) + most).alias("_longest"))
    bounded = words.join(F.broadcast(longest), "field").where(F.length("token") <= F.col("_longest"))  # one row a field
    left = bounded.select("field", "token", F.explode(deletions(F.col("token"), most)).alias("_d"))
    right = vocabulary.select("field", F.col("token").alias("meant"), F.explode(deletions(F.col("token"), most)).alias("_d"))
    pairs = left.join(right, ["field", "_d"]).select("field", "token", "meant").distinct()
    shorter = F.least(F.length("token"), F.length("meant"))
    return with_edits(pairs, "token", "meant", most).where(F.col("edits") <= F.when(shorter < 3, 0).when(shorter < 6, 1).otherwise(most))


def likeness(edits: Column, a: Column, b: Column) -> Column:
    """1 for equal words, less by the edits' share of the letters of both."""
    return 1.0 - edits / (F.length(a) + F.length(b))


def canonical(values: DataFrame, reference: DataFrame, least: float = 0.88) -> DataFrame:
    """(field, value, canon_id BIGINT, score DOUBLE) of each distinct value of ``values`` (field, value); canon_id -1 if it means none, its score then that of the best.

    ``reference`` has (field, canon_id, name), several names for an id if need
    be. A value means the entry of the highest soft TF-IDF, if that is
    ``least`` or more; if two ids are equally good, neither. It is compared word
    by word, with letter pairs as typed too, and glued together, as words are
    divided and joined. Null and blank values mean none; repeats count once.

    A word of the list weighs log(1 + n/df) over the list's n names. Any other
    word of a value is weighed by its company, log(1 + n/s**2) if it stands
    beside s different words of the list in all values: legal forms, trade
    words and shop sections lose their weight by that.
    """
    values = written(values.select("field", "value").where(F.col("value").isNotNull()).distinct(), "values")
    names = reference.where(F.col("name").isNotNull()).select("field", "canon_id", "name").distinct().withColumn("entry", F.xxhash64("field", "canon_id", "name"))
    listed = names.select("field", "canon_id", "entry", F.explode(tokens(F.col("name"))).alias("meant"))
    total = names.groupBy("field").agg(F.countDistinct("name").alias("_n"))
    weight = listed.groupBy("field", "meant").agg(F.countDistinct("entry").alias("_df")).join(total, "field").select("field", "meant", F.log(1.0 + F.col("_n") / F.col("_df")).alias("idf"))
    listed = written(listed.join(weight, ["field", "meant"]), "entries")
    norms = listed.groupBy("entry").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("entry_norm"))
    listed = listed.join(norms, "entry")

    forms = F.array(F.struct(F.lit("words").alias("form"), tokens(F.col("value")).alias("t")), F.struct(F.lit("plain").alias("form"), tokens(F.col("value"), unaccented).alias("t")))
    typed = written(values.select("field", "value", F.explode(forms).alias("f")).select("field", "value", "f.form", F.posexplode("f.t").alias("at", "token")), "typed")
    vocabulary = listed.select("field", F.col("meant").alias("token")).distinct()
    repairs = written(repaired(typed.select("field", "token").distinct(), vocabulary), "repairs")

    # company: the list's words that stand beside a word, itself and its own repairs left out
    exact = typed.join(vocabulary, ["field", "token"], "left_semi").where(F.col("form") == "words").select("field", "value", F.col("token").alias("_beside"))
    strange = typed.join(vocabulary, ["field", "token"], "left_anti")
    beside = strange.join(exact, ["field", "value"]).select("field", "token", "_beside").distinct().groupBy("field", "token").agg(F.count("*").alias("_s"))
    company = strange.select("field", "token").distinct().join(beside, ["field", "token"], "left").join(total, "field")
    company = company.select("field", "token", F.log(1.0 + F.col("_n") / F.pow(F.coalesce("_s", F.lit(1)), 2)).alias("w"))
    own = weight.select("field", F.col("meant").alias("token"), F.col("idf").alias("w"))
    weighed = written(typed.join(company.unionByName(own), ["field", "token"]), "weighed")

    # word by word: of an id's names the best counts, and words that mean another of its names don't speak against it
    met = weighed.join(repairs, ["field", "token"]).join(listed, ["field", "meant"])
    best = met.groupBy("field", "value", "form", "entry", "entry_norm", "canon_id", "token", "w").agg(F.max(F.struct(likeness(F.col("edits"), F.col("token"), F.col("meant")).alias("like"), "idf")).alias("m"))
    of_id = best.groupBy("field", "value", "form", "canon_id", "token").agg(F.max("w").alias("w"), F.max("m.like").alias("like"))
    covered = of_id.groupBy("field", "value", "form", "canon_id").agg(F.sum(F.col("w") * F.col("w")).alias("_covered"))
    whole = weighed.groupBy("field", "value", "form").agg(F.sum(F.col("w") * F.col("w")).alias("_whole"))
    dots = best.groupBy("field", "value", "form", "entry", "entry_norm", "canon_id").agg(
        F.sum(F.col("m.idf") * F.col("m.idf") * F.col("m.like")).alias("_dot"), F.sum(F.col("m.idf") * F.col("m.idf")).alias("_met")
    )
    loose = F.greatest(F.col("_whole") - F.col("_covered"), F.lit(0.0))  # what the id's names leave of the value
    scored = dots.join(covered, ["field", "value", "form", "canon_id"]).join(whole, ["field", "value", "form"]).select(
        "field", "value", "canon_id", (F.col("_dot") / (F.col("entry_norm") * F.sqrt(F.col("_met") + loose))).alias("score")
    )

    # glued: the words that have weight, as one, against each name as one, also with its "and" written out
    glued = weighed.where(F.col("form") == "words").join(F.broadcast(total), "field").groupBy("field", "value", "_n").agg(F.collect_list(F.struct("at", "token", "w")).alias("_l"))
    heavy = F.filter(F.array_sort("_l"), lambda x: x["w"] >= 0.5 * F.log(1.0 + F.col("_n")))
    glued = glued.select("field", "value", F.array_join(F.transform(heavy, lambda x: x["token"]), "").alias("token")).where(F.col("token") != "")
    spelled = F.array(F.col("name"), *(F.regexp_replace("name", r"\s+&\s+", f" {word} ") for word in ("och", "and", "og", "und")))
    wholes = written(names.select("field", "canon_id", F.explode(F.transform(spelled, lambda n: F.regexp_replace(folded(n), "[^a-z0-9]+", ""))).alias("meant")).distinct(), "wholes")
    glue = repaired(glued.select("field", "token").distinct(), wholes.select("field", F.col("meant").alias("token")).distinct())
    at_once = glued.join(glue, ["field", "token"]).join(wholes, ["field", "meant"]).select("field", "value", "canon_id", likeness(F.col("edits"), F.col("token"), F.col("meant")).alias("score"))

    ranked = scored.unionByName(at_once).groupBy("field", "value", "canon_id").agg(F.round(F.max("score"), 6).alias("score"))
    first = ranked.groupBy("field", "value", "score").agg(F.count("*").alias("_ids"), F.min("canon_id").alias("canon_id"))
    first = first.groupBy("field", "value").agg(F.max(F.struct("score", "_ids", "canon_id")).alias("b"))
    found = values.join(first, ["field", "value"], "left")
    meant = F.when((F.col("b.score") >= least) & (F.col("b._ids") == 1), F.col("b.canon_id"))
    return found.select("field", "value", F.coalesce(meant, F.lit(-1)).cast("bigint").alias("canon_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def reference_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, canon_id, name) of the reference list, its other names included."""
    return spark.read.parquet(f"{sf_dir}/canon_value.parquet").select(F.col("field_name").alias("field"), "canon_id", F.explode(F.array_union(F.array("name"), F.coalesce("alt_names", F.array().cast("array<string>")))).alias("name")).where(F.col("name").isNotNull())


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, field, value) of each product's vendor and type, exact names left out."""
    both = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("vendor", "product_type")))
    rows = spark.read.parquet(f"{sf_dir}/product_record.parquet").select("product_id", F.explode(both).alias("v")).select("product_id", "v.field", "v.value").where(F.col("value").rlike(r"[^\s\u00a0]"))
    names = spark.read.parquet(f"{sf_dir}/canon_value.parquet").select(F.col("field_name").alias("field"), F.col("name").alias("value"))
    return rows.join(names, ["field", "value"], "left_anti").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the reference list each hand-typed vendor and type means."""
    rows = typed_values(spark, sf_dir)
    meant = canonical(rows, reference_names(spark, sf_dir))
    return rows.join(meant, ["field", "value"]).select("product_id", F.col("field").alias("field_name"), "canon_id").distinct()
