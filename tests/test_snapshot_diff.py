import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators import snapshot_diff as sd

SCHEMA = "feed string, seq int, key string, a string, b string, node string, leaf int"


def entries(spark, *given):
    return spark.createDataFrame([(*e, "clash", 0) for e in given], SCHEMA)


def found(spark, df, depth=3, pairs=None):
    out = sd.snapshot_changes(df, "feed", "seq", "key", ["a", "b"], depth, pairs)
    return sorted((r["feed"], r["seq"], r["key"], r["change"]) for r in out.collect())


def brute(given):
    held, out = {}, []
    for f, s, k, a, b in given:
        held.setdefault((f, s), {})[k] = (a, b)
    for (f, s), now in held.items():
        if (f, s - 1) in held:
            old = held[f, s - 1]
            out += [(f, s, k, "added") for k in now.keys() - old.keys()] + [(f, s, k, "removed") for k in old.keys() - now.keys()]
            out += [(f, s, k, "changed") for k in now.keys() & old.keys() if now[k] != old[k]]
    return sorted(out)


def test_added_removed_changed_with_repeats_and_nulls(spark):
    df = entries(spark, ("f", 1, "x", "1", "1"), ("f", 1, "x", "1", "1"), ("f", 1, "y", None, "1"), ("f", 1, "z", "1", "1"), ("f", 2, "x", "1", "1"), ("f", 2, "y", "2", "1"), ("f", 2, "n", "1", "1"), ("f", 2, None, "1", "1"))
    assert found(spark, df) == [("f", 2, "n", "added"), ("f", 2, "y", "changed"), ("f", 2, "z", "removed")]


@pytest.mark.parametrize("depth", [0, 1, 4, 9])
def test_any_depth_matches_brute_force(spark, depth):
    r = random.Random(3)
    given = [(f, s, f"k{k}", str(r.random() < 0.1), str(r.random() < 0.05)) for f in "fg" for s in (1, 2, 3) for k in range(60) if r.random() < 0.9]
    assert found(spark, entries(spark, *given), depth) == brute(given)


def test_only_differing_leaves_are_opened(spark):
    given = [("f", s, f"k{k}", "1", "same" if k or s == 1 else "other") for s in (1, 2) for k in range(200)]
    rows_ = entries(spark, *given).select("feed", "seq", F.xxhash64("key", "a", "b").alias("_row"), F.shiftrightunsigned(F.xxhash64("key"), 64 - 6).alias("_leaf"))
    pairs = spark.createDataFrame([("f", 1, 2)], "feed string, before int, after int")
    assert sd.differing_leaves(rows_, pairs, "feed", "seq", 6).count() == 1


def test_first_snapshots_and_empty_tables_give_nothing(spark):
    assert found(spark, entries(spark)) == []
    assert found(spark, entries(spark, ("f", 1, "x", "1", "1"), ("g", 1, "x", "2", "2"))) == []


def test_a_snapshot_without_rows_removes_all(spark):
    df = entries(spark, ("f", 1, "x", "1", "1"), ("f", 3, "x", "1", "1"))
    pairs = spark.createDataFrame([("f", 1, 2), ("f", 2, 3)], "feed string, before int, after int")
    assert found(spark, df, pairs=pairs) == [("f", 2, "x", "removed"), ("f", 3, "x", "added")]


def test_nulls_carry_the_last_known_value(spark):
    df = entries(spark, ("f", 1, "x", "1", None), ("f", 2, "x", None, "7"), ("f", 3, "x", None, None), ("f", 1, "y", "1", "1"), ("g", 1, "x", None, "1"))
    out = sd.carry_forward(df, "feed", "seq", "key", ["a", "b"])
    assert rows(out) == sorted([("f", 1, "x", "1", None), ("f", 2, "x", "1", "7"), ("f", 3, "x", "1", "7"), ("f", 1, "y", "1", "1"), ("g", 1, "x", None, "1")], key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_which_values_differ_and_what_nulls_say(spark):
    df = entries(spark, ("f", 1, "x", "1", None), ("f", 2, "x", "2", "1"), ("f", 1, "y", "1", None), ("f", 2, "y", "1", "1"))
    differing = lambda **how: {r["key"]: r["differing"] for r in sd.snapshot_changes(df, "feed", "seq", "key", ["a", "b"], 2, **how).collect()}
    assert differing() == {"x": ["a", "b"], "y": ["b"]}
    assert differing(nulls_differ=False, unique=True) == {"x": ["a"]}


def test_depth_follows_size():
    assert sd.leaf_depth(0) == sd.leaf_depth(8) == 0
    assert sd.leaf_depth(9) == 1 and sd.leaf_depth(800) == 7 and sd.leaf_depth(10**12) == 37
