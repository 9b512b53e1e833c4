import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.incremental import ProcessingState, StateConflict
from millrace.plans import core

SCHEMA = "key string, name string, tags array<string>, content_hash string, change string"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def table(spark, *records):
    return spark.createDataFrame([(k, n, t, "clash", "clash") for k, n, t in records], SCHEMA)


def changes(spark, path, df):
    state = ProcessingState(spark, path)
    return state, state.changes(df, F.col("key"), ["name", "tags"])


def test_only_new_and_changed_records_come(spark, path):
    state, found = changes(spark, path, table(spark, ("a", "x", ["t"]), ("b", None, None), ("b", None, None), (None, "z", [])))
    assert [(r["key"], r["change"]) for r in sorted(found.collect())] == [("a", "new"), ("b", "new")]
    state.commit(found)
    state, found = changes(spark, path, table(spark, ("a", "x", ["t"]), ("b", "", None), ("c", "x", [])))
    assert sorted((r["key"], r["change"], r["record"]["name"]) for r in found.collect()) == [("b", "changed", ""), ("c", "new", "x")]
    state.commit(found)
    assert changes(spark, path, table(spark, ("a", "x", ["t"]), ("b", "", None), ("c", "x", [])))[1].count() == 0


def test_a_run_that_dies_before_its_commit_loses_and_repeats_nothing(spark, path):
    state, found = changes(spark, path, table(spark, ("a", "x", [])))
    # the run writes its part and dies before the swap
    found.select("key", "content_hash", F.lit(1).cast("bigint").alias("state_version")).write.parquet(f"{path}/part-00000001-dead")
    again, found = changes(spark, path, table(spark, ("a", "x", [])))
    assert again.version == 0 and found.count() == 1
    again.commit(found)
    assert changes(spark, path, table(spark, ("a", "x", [])))[1].count() == 0


def test_two_runs_can_not_both_commit(spark, path):
    one, two = ProcessingState(spark, path), ProcessingState(spark, path)
    done = spark.createDataFrame([("a", "h")], "key string, content_hash string")
    one.commit(done)
    with pytest.raises(StateConflict):
        two.commit(done)
    assert rows(ProcessingState(spark, path).read()) == [("a", "h", 1)]


def test_of_writers_at_once_one_succeeds(spark, path):
    """All read version 0, pass every check there is, and commit at the same moment."""
    states = [ProcessingState(spark, path) for _ in range(4)]
    done = [spark.createDataFrame([(f"k{i}", "h")], "key string, content_hash string") for i in range(4)]

    def commit(i):
        try:
            return states[i].commit(done[i])
        except StateConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(commit, range(4)))
    assert sorted(g for g in got if g) == [1]
    assert rows(ProcessingState(spark, path).read()) == [(f"k{got.index(1)}", "h", 1)]


def test_enrichment_runs_over_one_state(spark):
    """New inputs come at the first run, changed ones at the second, none at the third; p5_found asks for those without a usable result."""
    folder = "/root/testdata/sf0.001"
    runs = core.p5_runs(spark, folder).groupBy("run", "change").count().collect()
    got = {(r["run"], r["change"]): r["count"] for r in runs}
    inputs, done = core.enrichment_inputs(spark, folder)
    assert got[1, "new"] == inputs.count() and set(got) == {(1, "new"), (2, "changed")} and 0 < got[2, "changed"] <= done.count()
    assert rows(core.p5_found(spark, folder)) == rows(inputs.where("result is null").select("hash"))


def test_many_commits_are_compacted(spark, path, monkeypatch):
    monkeypatch.setattr(ProcessingState, "COMPACT_AFTER", 2)
    for n in range(4):
        ProcessingState(spark, path).commit(spark.createDataFrame([("a", f"h{n}"), (f"k{n}", "h")], "key string, content_hash string"))
    state = ProcessingState(spark, path)
    assert len(state.parts) <= 2 and state.version == 4
    assert dict((r["key"], r["content_hash"]) for r in state.read().collect()) == {"a": "h3", "k0": "h", "k1": "h", "k2": "h", "k3": "h"}


def test_empty_tables(spark, path):
    state, found = changes(spark, path, table(spark))
    assert found.count() == 0
    state.commit(found)
    assert state.version == 1 and state.read().count() == 0
