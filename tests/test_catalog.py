import json
from copy import deepcopy

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators import catalog as c

RAW = {
    "id": 7, "handle": "h", "title": "T", "body_html": None, "vendor": "V", "product_type": "P", "tags": ["b", "a"], "updated_at": "t1",
    "options": [{"name": "Size", "values": ["M", "L"]}], "variants": [{"id": 71, "title": "M", "sku": None, "available": True, "price": "1.00", "option1": "M", "option3": "X", "updated_at": "t1"}], "images": [{"src": "s"}],
}


def hashes(spark, *raws):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)], "i int, raw string")
    out = c.with_enrichment_hash(c.normalize(df))
    return [(r["source_payload_hash"], r["enrichment_input_hash"]) for r in out.collect()], out


def changed(**fields):
    new = deepcopy(RAW)
    new.update(fields)
    return new


def test_normalised_fields(spark):
    _, out = hashes(spark, RAW, {"id": "x"})
    one, bare = sorted(out.collect(), key=lambda r: r["product_id"])
    assert one["product_id"] == "7" and one["body_html"] == "" and one["tags"] == ["a", "b"] and one["options"][0]["values"] == ["L", "M"]
    assert one["variant_options"] == [["M", "X"]] and one["skus"] == [""] and one["prices"] == ["1.00"] and one["compare_at_prices"] == [None] and one["image_urls"] == ["s"]
    assert bare["title"] == "" and bare["variant_ids"] == [] and json.loads(bare["source_payload"])["tags"] == []


def test_which_edits_move_which_hash(spark):
    price, stamp = deepcopy(RAW), deepcopy(RAW)
    price["variants"][0]["price"] = "2.00"
    stamp["updated_at"] = stamp["variants"][0]["updated_at"] = "t2"
    (base, tags, stamped, priced, titled, optioned), _ = hashes(spark, RAW, changed(tags=["a", "b"]), stamp, price, changed(title="U"), changed(options=[{"name": "Size", "values": ["S"]}]))
    assert tags == base and stamped == base
    assert priced[0] != base[0] and priced[1] == base[1]
    assert titled[0] != base[0] and titled[1] != base[1] and optioned[1] != base[1]


def crawl(spark, *pairs):
    return spark.createDataFrame(list(pairs), "product_id string, source_payload_hash string")


def test_manifest_and_duplicates(spark):
    import hashlib

    m = c.build_manifest(crawl(spark, ("9", "h"), ("10", "g")))
    assert m == {"schema_version": 1, "count": 2, "digest": hashlib.sha256(b"10\0g\n9\0h").hexdigest()}
    assert c.build_manifest(crawl(spark))["count"] == 0
    with pytest.raises(c.InconsistentCrawl, match="duplicate"):
        c.build_manifest(crawl(spark, ("1", "h"), ("1", "h")))


def test_crawls_must_agree(spark):
    a = crawl(spark, ("1", "h"), ("2", "h"), ("3", "h"))
    assert c.verify_crawls(a, a)[1]["count"] == 3
    b = crawl(spark, ("2", "h"), ("3", "x"), ("4", "h"))
    assert rows(c.crawl_difference(a, b)) == [("1", "only_first"), ("3", "differing"), ("4", "only_second")]
    with pytest.raises(c.InconsistentCrawl, match="changed between"):
        c.verify_crawls(a, b)


def test_count_gates():
    c.check_counts(9, previous=10)
    c.check_counts(1, previous=10, allow_large_drop=True)
    for bad in ({"count": 8, "previous": 10}, {"count": 0}):
        with pytest.raises(c.InconsistentCrawl):
            c.check_counts(**bad)


def batch(spark, *given):
    return spark.createDataFrame([(p, s, e, s, e) for p, s, e in given], "product_id string, source_payload_hash string, enrichment_input_hash string, payload string, input_payload string")


def counts(df):
    return {r["outcome"]: r["n"] for r in df.collect() if r["n"]}


@pytest.fixture
def empty(spark):
    return c.Store(*(spark.createDataFrame([], s) for s in c.STORE.values()))


def test_merge_outcomes(spark, empty):
    one, n = c.sync(empty, batch(spark, ("a", "s1", "e1"), ("b", "s1", "e1"), ("c", "s3", "e3"), ("d", "s4", "e4")), "t1")
    assert counts(n) == {"new": 4, "enrichment_jobs": 3}
    two, n = c.sync(one, batch(spark, ("a", "s1", "e1"), ("b", "s2", "e1"), ("c", "s9", "e9")), "t2")
    assert counts(n) == {"unchanged": 1, "source_changed": 1, "enrichment_stale": 1, "disappeared": 1, "enrichment_jobs": 1}
    assert rows(two.product_state) == [("a", 1, "t1", "t2", None), ("b", 2, "t1", "t2", None), ("c", 2, "t1", "t2", None), ("d", 1, "t1", "t1", "t2")]
    assert c.live_count(two.product_state) == 3
    # a product that returns as it was is unchanged; one that reverts makes a version and no job
    three, n = c.sync(two, batch(spark, ("a", "s1", "e1"), ("b", "s2", "e1"), ("c", "s3", "e3"), ("d", "s4", "e4")), "t3")
    assert counts(n) == {"unchanged": 3, "enrichment_stale": 1}
    assert three.product_version.where("product_id = 'c'").count() == 3
    assert [r["deleted_at"] for r in three.product_state.where("product_id = 'd'").collect()] == [None]
    again, n = c.sync(three, batch(spark), "t4")
    assert counts(n) == {"disappeared": 4} and counts(c.sync(again, batch(spark), "t5")[1]) == {}


def test_queue(spark, empty):
    store, _ = c.sync(empty, batch(spark, ("a", "s", "e2"), ("b", "s", "e1")), "t")
    assert [r[0] for r in c.pending_enrichment(store.enrichment_cache).collect()] == ["e1", "e2"]
    done = c.complete_enrichment(store.enrichment_cache, "e1", {"å": 1}, "raw", "t2")
    assert rows(done.where(F.col("status") == "completed").select("enrichment_input_hash", "result", "completed_at")) == [("e1", '{"å": 1}', "t2")]
    for bad in ("e1", "e0"):
        with pytest.raises(KeyError):
            c.complete_enrichment(done, bad, {}, "", "t3")


def test_every_payload_a_crawl_accepts_has_its_digests(spark, tmp_path):
    import hashlib

    from millrace.plans.sync import canonical_json_hash
    from millrace.sources import crawl as source

    digest = lambda x: hashlib.sha256(c.canonical_json(x).encode()).hexdigest()
    bare = {"body_html": "", "options": [], "product_type": "", "tags": [], "title": "", "variant_titles": [], "vendor": ""}
    good = [
        ({"id": 1, "variants": None, "body_html": "b"}, bare | {"body_html": "b"}), ({"id": 2, "body_html": "b"}, bare | {"body_html": "b"}), ({"id": 3, "variants": [], "body_html": "b"}, bare | {"body_html": "b"}),
        ({"id": 4, "variants": [{"id": 41, "title": "M"}], "body_html": None}, bare | {"variant_titles": ["M"]}), ({"id": "5", "variants": [{"title": "L"}]}, bare | {"variant_titles": ["L"]}), ({"id": 6, "options": None, "images": []}, bare),
    ]
    bad = [{"variants": [{"id": 1}], "body_html": "b"}, *({"id": 7, "body_html": "b", "variants": [{"id": 1}]} | x for x in ({"variants": {"id": 1}}, {"options": '[{"name": "S"}]'}, {"images": "[]"}, {"images": [{"src": "s"}, "t"]}, {"options": [None]}))]
    texts = [*(json.dumps(r) for r, _ in good), *map(json.dumps, bad), '{"id": 8', '[{"id": 9}]', '"x"', "", None]
    spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "product_id string, source_payload string").write.parquet(str(tmp_path / "product_record.parquet"))
    got = rows(canonical_json_hash(spark, str(tmp_path)))
    assert [r[:3] for r in got if r[3] is None] == sorted((str(r["id"]), digest(r | {"tags": []}), digest(e)) for r, e in good)
    rejected = {r[0]: r[1:] for r in got if r[3] is not None}
    assert set(rejected) == {f"p{i}" for i in range(len(good), len(texts) - 1)} and all(r[:2] == (None, None) for r in rejected.values())
    # the check of a crawl's pages, in Spark, says the same of each
    pages = spark.createDataFrame([(str(i), json.dumps({"products": [r]})) for i, r in enumerate([*(r for r, _ in good), *bad])], "page string, body string")
    faults = {int(r["page"]): r["fault"] for r in source.products(pages).collect()}
    assert [bool(faults[i]) for i in range(len(faults))] == [False] * len(good) + [True] * len(bad)
