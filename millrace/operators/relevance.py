"""Graded relevance from rules: each rule becomes one Column, resolved before any data is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import fold_case


def _folded(word: str) -> Column:
    return F.lit(word.lower().replace("ß", "ss"))


def _vendor_equals(rule: dict, depth: int) -> Column:
    return F.when(fold_case(F.col("vendor")) == _folded(rule["vendor"]), int(rule["grade"])).otherwise(0)


def _product_type(rule: dict, depth: int) -> Column:
    grades = rule.get("grades") or {}
    return reduce(lambda otherwise, pair: F.when(F.coalesce("product_type", F.lit("")) == pair[0], int(pair[1])).otherwise(otherwise), grades.items(), F.lit(0))


def _tag_equals(rule: dict, depth: int) -> Column:
    has = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: fold_case(t) == _folded(rule["tag"]))
    return F.when(has, int(rule["grade"])).otherwise(0)


def _title_any(rule: dict, depth: int) -> Column:
    title = fold_case(F.col("title"))
    hit = reduce(lambda a, w: a | F.contains(title, _folded(w)), rule["tokens"], F.lit(False))
    return F.when(hit, int(rule["grade"])).otherwise(0)


def _all_of(rule: dict, depth: int) -> Column:
    parts = [(grade(p, depth + 1), bool(p.get("required"))) for p in rule["parts"]]
    total = reduce(lambda a, p: a + p[0], parts, F.lit(0))
    clipped = F.least(total, F.lit(int(rule["max"]))) if "max" in rule else total
    missing = reduce(lambda a, p: a | (p[0] == 0), [p for p in parts if p[1]], F.lit(False))
    return F.when(missing, 0).otherwise(clipped)


_RULES = {"none": lambda rule, depth: F.lit(0), "vendor_equals": _vendor_equals, "product_type": _product_type, "tag_equals": _tag_equals, "title_any": _title_any, "all_of": _all_of}


def grade(rule: dict, depth: int = 0) -> Column:
    """INT grade of a catalog row (title, vendor, product_type, tags) under ``rule``.

    An unknown method raises at once, also deep inside. Nulls count as empty.
    """
    if rule.get("method") not in _RULES:
        raise ValueError(f"relevance method {rule.get('method')!r} is unknown")
    return _RULES[rule["method"]](rule, depth).cast("int")


def qrels(queries: list[dict], catalog: DataFrame) -> DataFrame:
    """(query_id, product_id, grade) above zero, for all queries in one scan of the catalog."""
    if not queries:
        return catalog.sparkSession.createDataFrame([], "query_id string, product_id string, grade int")
    graded = F.array(*(F.struct(F.lit(q["id"]).alias("query_id"), grade(q["relevance"]).alias("grade")) for q in queries))
    rows = catalog.select(F.col("product_id").cast("string").alias("product_id"), F.explode(F.filter(graded, lambda g: g["grade"] > 0)).alias("g"))
    return rows.select("g.query_id", "product_id", "g.grade")
