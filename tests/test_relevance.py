import math

import pytest
from conftest import rows

from millrace.operators import relevance, scoring

SCHEMA = "product_id string, title string, vendor string, product_type string, tags array<string>, grade int"


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([("1", "Fred jacka", "GROẞ & Co".replace("ẞ", "ß"), "Jackor", ["Svart"], 9), ("2", "Röd tröja", None, "jackor", None, 9), ("3", None, "gross & co", None, ["svart", "SVART"], 9)], SCHEMA)


def grades(catalog, rule):
    return {r[1]: r[2] for r in rows(relevance.qrels([{"id": "q", "relevance": rule}], catalog))}


def test_rules(catalog):
    assert grades(catalog, {"method": "none"}) == {}
    assert grades(catalog, {"method": "vendor_equals", "vendor": "Gross & CO", "grade": 3}) == {"1": 3, "3": 3}
    assert grades(catalog, {"method": "product_type", "grades": {"Jackor": 2}}) == {"1": 2}
    assert grades(catalog, {"method": "tag_equals", "tag": "sVart", "grade": 1}) == {"1": 1, "3": 1}
    assert grades(catalog, {"method": "title_any", "tokens": ["RED", "tröja"], "grade": 1}) == {"1": 1, "2": 1}


def test_all_of(catalog):
    type_, tag = {"method": "product_type", "grades": {"Jackor": 2}}, {"method": "tag_equals", "tag": "svart", "grade": 2}
    assert grades(catalog, {"method": "all_of", "parts": [type_, tag]}) == {"1": 4, "3": 2}
    assert grades(catalog, {"method": "all_of", "max": 3, "parts": [type_ | {"required": True}, tag]}) == {"1": 3}
    assert grades(catalog, {"method": "all_of", "parts": [{"method": "all_of", "parts": [tag]}]}) == {"1": 2, "3": 2}
    assert grades(catalog, {"method": "all_of", "parts": []}) == {}


def test_unknown_methods_raise_at_once():
    with pytest.raises(ValueError):
        relevance.grade({"method": "all_of", "parts": [{"method": "magic"}]})


def test_no_queries_no_catalog(spark, catalog):
    assert relevance.qrels([], catalog).count() == 0
    assert relevance.qrels([{"id": "q", "relevance": {"method": "title_any", "tokens": ["x"], "grade": 1}}], catalog.limit(0)).count() == 0


def score(spark, runs, qrels, queries=(("q1", "x", "category"),), systems=("s",), k=10):
    return scoring.score_queries(
        spark.createDataFrame(runs, "system string, query_id string, rank int, product_id string"), spark.createDataFrame(qrels, "query_id string, product_id string, grade int"),
        spark.createDataFrame(list(queries), "query_id string, query string, stratum string"), list(systems), k,
    )


def test_perfect_and_partial_orders(spark):
    qrels = [("q1", "a", 3), ("q1", "b", 2), ("q1", "c", 1)]
    perfect = score(spark, [("s", "q1", i, p) for i, p in enumerate("abcd", 1)], qrels, k=4).first()
    assert perfect["ndcg"] == pytest.approx(1.0) and perfect["precision"] == 0.5 and perfect["relevant"] == 2 and perfect["returned"] == 4
    late = score(spark, [("s", "q1", 1, "x"), ("s", "q1", 2, "a")], qrels, k=2).first()
    assert late["ndcg"] == pytest.approx((7 / math.log2(3)) / (7 + 3 / math.log2(3))) and late["precision"] == 0.5


def test_queries_without_results_or_judgements_score_zero(spark):
    queries = [("q1", "x", "category"), ("q2", "y", scoring.ABSENT)]
    got = score(spark, [("s", "q2", i, str(i)) for i in (1, 2, 3)], [("q1", "a", 3)], queries, ("s", "t"), k=2)
    assert [(r["system"], r["query_id"], r["ndcg"], r["returned"]) for r in got.orderBy("system", "query_id").collect()] == [("s", "q1", 0.0, 0), ("s", "q2", 0.0, 3), ("t", "q1", 0.0, 0), ("t", "q2", 0.0, 0)]
    by = {r["system"]: r for r in scoring.score_systems(got).collect()}
    assert by["s"]["absent_returned"] == 3 and by["s"]["answerable_ndcg"] == 0.0
    wide = scoring.strata_table(got, ["s", "t"]).orderBy("position").collect()
    assert [r["stratum"] for r in wide] == ["category", scoring.ABSENT]
    assert rows(scoring.query_table(got, ["s", "none"])) == [("q1", "x", "category", 0.0, None), ("q2", "y", scoring.ABSENT, 0.0, None)]


def test_zero_depth_and_empty_runs(spark):
    got = score(spark, [], [], k=0).first()
    assert (got["ndcg"], got["precision"], got["returned"], got["relevant"]) == (0.0, 0.0, 0, 0)


def test_examples_fall_back(spark, catalog):
    runs = spark.createDataFrame([("s", "q", 1, "1"), ("s", "q", 2, "gone"), ("s", "q", 11, "2")], "system string, query_id string, rank int, product_id string")
    qrels = spark.createDataFrame([("q", "1", 2)], "query_id string, product_id string, grade int")
    assert [(r["product_id"], r["title"], r["grade"]) for r in scoring.examples(runs, qrels, catalog).orderBy("rank").collect()] == [("1", "Fred jacka", 2), ("gone", "gone", 0)]
