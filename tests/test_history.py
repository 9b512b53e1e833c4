import datetime as dt
import random

import pytest
from conftest import rows

from millrace.operators import history

T = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id string, at timestamp, v int, a string, b string, _at string, attribute string"


def event(key, hours, v, a, b):
    return (key, None if hours is None else T + dt.timedelta(hours=hours), v, a, b, "clash", "clash")


def versions(spark, events, **how):
    log = history.change_log(spark.createDataFrame(events, SCHEMA), ["id"], "at", ["a", "b"], "v", **how)
    found = history.versions(log, ["id"], ["a", "b"], **how)
    hour = lambda x: None if x is None else int((x.astimezone(dt.timezone.utc) - T).total_seconds() // 3600)
    return sorted((r["id"], r["version"], r["a"], r["b"], hour(r["valid_from"]), hour(r["valid_to"])) for r in found.collect())


def brute(events):
    """Every longest period in which all attributes stay, entity by entity."""
    out, held = [], {}
    for k, at, v, a, b, *_ in sorted((e for e in set(events) if e[0] is not None and e[1] is not None), key=lambda e: (e[0], e[1], e[2])):
        line = held.setdefault(k, [])
        if not line or line[-1][0] != (a, b):
            line.append(((a, b), int((at - T).total_seconds() // 3600)))
    for k, line in held.items():
        for i, ((a, b), start) in enumerate(line):
            out.append((k, i + 1, a, b, start, line[i + 1][1] if i + 1 < len(line) else None))
    return sorted(out, key=lambda r: (r[0], r[1]))


def test_attributes_have_their_own_intervals(spark):
    events = [event("p", 0, 1, "x", "m"), event("p", 30, 2, "y", "m"), event("p", 60, 3, "y", "n")]
    log = history.change_log(spark.createDataFrame(events, SCHEMA), ["id"], "at", ["a", "b"], "v")
    assert sorted((r["attribute"], r["value"]) for r in log.collect()) == [("a", "x"), ("a", "y"), ("b", "m"), ("b", "n")]
    assert versions(spark, events) == [("p", 1, "x", "m", 0, 30), ("p", 2, "y", "m", 30, 60), ("p", 3, "y", "n", 60, None)]


def test_repeats_late_rows_reverts_and_nulls(spark):
    events = [event("p", 48, 9, "x", None), event("p", 0, 1, "x", None), event("p", 0, 1, "x", None), event("p", 24, 5, None, None), event("p", None, 2, "q", "q"), event(None, 1, 1, "q", "q")]
    assert versions(spark, events) == [("p", 1, "x", None, 0, 24), ("p", 2, None, None, 24, 48), ("p", 3, "x", None, 48, None)]


def test_equal_times_go_by_sequence(spark):
    events = [event("p", 5, 2, "b", "b"), event("p", 5, 1, "a", "a")]
    assert versions(spark, events) == [("p", 1, "a", "a", 5, 5), ("p", 2, "b", "b", 5, None)]


def test_empty(spark):
    assert versions(spark, []) == []


@pytest.mark.parametrize("bucket", [3600, 86_400, 10**9])
def test_any_bucket_width_matches_brute_force(spark, bucket):
    r = random.Random(7)
    # one hot entity holds most events
    events = [event("hot" if r.random() < 0.6 else f"p{r.randint(0, 9)}", h, h, r.choice("xyz"), r.choice(["m", "n", None])) for h in r.sample(range(2000), 250)]
    assert versions(spark, events, bucket_seconds=bucket) == brute(events)
