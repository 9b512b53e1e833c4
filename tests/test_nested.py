import json

from conftest import rows
from pyspark.sql import functions as F

from millrace.operators import nested

P = {"id": 1, "variants": [{"id": 11, "title": "S", "inventory": {"levels": [{"location": "L-1", "available": 0}]}}, {"id": "gid://x/Variant/12", "inventory": {"L-2": 3}}], "options": [{"name": "Size", "values": ["S", {"label": "M"}]}], "images": [{"src": "u", "variant_ids": [11]}]}
WANT = [("image", "p", "u"), ("image_variant", "u", "11"), ("level", "11", "L-1"), ("level", "12", "L-2"), ("option", "p", "Size"), ("option_value", "Size", "M"), ("option_value", "Size", "S"), ("variant", "p", "11"), ("variant", "p", "12")]


def shred(spark, *payloads):
    df = spark.createDataFrame([(f"p{i}" if len(payloads) > 1 else "p", t, "clash") for i, t in enumerate(payloads)], "pid string, body string, child_key string")
    return nested.shred(df, F.col("pid"), F.col("body"), nested.PRODUCT, ("product", "products"))


def keys(spark, *payloads):
    return [r[1:] if len(payloads) == 1 else r for r in rows(nested.child_keys(*shred(spark, *payloads)[:2]))]


def test_children_with_parents(spark):
    assert keys(spark, json.dumps(P)) == WANT


def test_shapes_of_one_record(spark):
    wrapped = [{"product": P}, {"products": [P]}, P | {"variants": json.dumps(P["variants"]), "options": json.dumps(P["options"])}, P | {"variants": {"edges": [{"node": v} for v in P["variants"]]}}, P | {"options": P["options"][0]}]
    for w in wrapped:
        assert keys(spark, json.dumps(w)) == WANT


def test_unreadable_absent_and_empty_give_nothing(spark):
    assert keys(spark, None, "", "null", "[1, 2]", '{"id": 1, "variants": [', '{"variants": null, "options": [], "images": "no json"}', json.dumps({"variants": [None, {"id": None}, 5]})) == []


def test_identical_objects_are_stored_once_and_every_occurrence_kept(spark):
    nodes, bridge, _ = shred(spark, json.dumps(P), json.dumps(P))
    assert nodes.where("kind = 'option'").count() == 1
    assert bridge.where("child_kind = 'option'").count() == 2
    assert nodes.count() == bridge.select("child_id").distinct().count()
    # equal payloads have equal roots; the order of fields doesn't count, that of children does
    a, b = json.dumps(P), json.dumps(dict(reversed(P.items())))
    assert shred(spark, a, b)[0].where("kind = 'product'").count() == 1
    assert shred(spark, a, json.dumps(P | {"variants": P["variants"][::-1]}))[0].where("kind = 'product'").count() == 2


def test_children_without_a_key_are_hashed_and_kept(spark):
    payloads = [{"id": 1, "variants": [{"title": "S"}]}, {"id": 1, "variants": [{"title": "XL", "price": 9, "inventory": {"L-1": 2}}]}, {"id": 1}, {"id": 1, "variants": []}, {"id": 1, "variants": [None, 5]}, {"id": 1, "variants": "no list"}]
    nodes, bridge, _ = shred(spark, *map(json.dumps, payloads))
    assert bridge.where("child_kind = 'product'").select("child_id").distinct().count() == len(payloads)
    got = [tuple(r) for r in bridge.where("parent_id is not null").orderBy("record_key", "child_kind", "ordinal").select("record_key", "parent_key", "parent_keyed", "child_kind", "ordinal").collect()]
    assert got == [("p0", "p0", True, "variant", 0), ("p1", "#0", False, "level", 0), ("p1", "p1", True, "variant", 0), ("p4", "p4", True, "variant", 0), ("p4", "p4", True, "variant", 1)]
    held = {r["content"] for r in nodes.join(bridge.where("child_kind = 'variant'"), nodes["node_id"] == bridge["child_id"]).collect()}
    assert held == {'{"title":"S"}', '{"price":9,"title":"XL"}', "null", "5"}


def test_numbers_and_wrappings_are_canonical_and_nothing_beside_them_is_lost(spark):
    same = ['{"id": 1, "options": [{"name": "A", "n": 1}]}', '{"options": [{"n": 1.0, "name": "A"}], "id": 1e0}', '{"id": 1, "options": {"edges": [{"node": {"name": "A", "n": 1}}]}}']
    other = ['{"id": 1, "options": {"edges": [{"node": {"name": "A", "n": 1}, "cursor": "c"}]}}', '{"id": 1, "options": [{"name": "A", "n": 1.5}]}', '{"id": 1, "options": [{"name": "A", "n": 1e999}]}']
    assert shred(spark, *same, *other)[1].where("child_kind = 'product'").select("child_id").distinct().count() == 4


def test_what_is_no_record_is_rejected_with_a_reason(spark):
    _, bridge, rejected = shred(spark, "{", '[1, {"id": 2}]', None, "null")
    assert [(r[0], r[1], r[2][:9]) for r in rows(rejected)] == [("p0", 0, "no JSON: "), ("p1", 0, "no object"), ("p3", 0, "no object")]
    assert [tuple(r) for r in bridge.select("record_key", "ordinal").collect()] == [("p1", 1)]


def test_ordinals_and_repeated_children(spark):
    _, bridge, _ = shred(spark, json.dumps({"options": [{"name": "A", "values": ["x", "x", "y"]}]}))
    assert sorted(r["ordinal"] for r in bridge.where("child_kind = 'option_value'").collect()) == [0, 1, 2]


def test_long_and_odd_text(spark):
    name = "n" * 300_000
    assert keys(spark, json.dumps({"options": [{"name": name, "values": [True, 1.0, "\ud800"]}]})) == [("option", "p", name), ("option_value", name, "1"), ("option_value", name, "true"), ("option_value", name, "�")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "pid string, body string")
    assert nested.child_keys(*nested.shred(df, F.col("pid"), F.col("body"), nested.PRODUCT)[:2]).count() == 0
