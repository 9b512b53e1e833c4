"""History of changing entity attributes, event-sourced per attribute.

Every attribute gets its own log of changes with its own intervals; versions
of the entity come from splitting time at the union of those boundaries and
coalescing neighbours that hold equal values.

A hot entity is never one task: each entity's timeline is cut into buckets of
``bucket_seconds``; windows run inside (entity, bucket), and only one summary
row per bucket crosses buckets.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.session import written

DAY = 86_400


def _carried(rows: DataFrame, key: list[str], aggregates: list[Column], lag: list[str], lead: list[str], running: list[str]) -> DataFrame:
    """One row per (key, bucket) with what earlier buckets hand on and the next one begins with.

    ``lag`` are the last non-null values of earlier buckets, ``lead`` the next
    bucket's value, ``running`` the sum over earlier buckets.
    """
    over = Window.partitionBy(*key).orderBy("_bucket")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy(*key, "_bucket").agg(*aggregates)
    return summary.select(
        *key,
        "_bucket",
        *(F.last(c, ignorenulls=True).over(before).alias(f"_in_{c}") for c in lag),
        *(F.lead(c).over(over).alias(f"_next_{c}") for c in lead),
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_sum_{c}") for c in running),
    )


def change_log(events: DataFrame, key: list[str], at: str, attributes: list[str], seq: str | None = None, bucket_seconds: int = DAY) -> DataFrame:
    """Per-attribute change log of ``events``: (*key, attribute, value STRING, at, seq).

    One row for each time an attribute of an entity took a value other than the
    one before. Repeated events and events that bring nothing new give none. A
    null value is a value like any other; events with a null key or null time
    can't be placed and give no row. At equal times ``seq`` decides, then the
    values themselves. An empty table gives an empty log.
    """
    order = F.col(seq) if seq else F.lit(0)
    keys = [f"_k{i}" for i in range(len(key))]
    values = [f"_a{i}" for i in range(len(attributes))]
    plain = events.select(
        *(F.col(c).alias(k) for c, k in zip(key, keys)), F.col(at).alias("_at"), order.cast("bigint").alias("_seq"), *(F.col(c).cast("string").alias(a) for c, a in zip(attributes, values))
    ).where(F.col("_at").isNotNull())
    for k in keys:
        plain = plain.where(F.col(k).isNotNull())
    # repeats of one event collapse before anything is ordered
    plain = plain.groupBy(*keys, "_at", *values).agg(F.min("_seq").alias("_seq"))
    long = plain.select(
        *keys, "_at", "_seq", F.floor(F.unix_seconds("_at") / F.lit(bucket_seconds)).alias("_bucket"),
        F.explode(F.array(*(F.struct(F.lit(name).alias("attribute"), F.col(a).alias("value")) for name, a in zip(attributes, values)))).alias("_c"),
    ).select(*keys, F.col("_c.attribute").alias("attribute"), "_bucket", "_at", "_seq", F.struct(F.col("_c.value").alias("value")).alias("_held"))
    entity = [*keys, "attribute"]
    # the order within a bucket: time, sequence number, then the value so that ties are stable
    inside = Window.partitionBy(*entity, "_bucket").orderBy("_at", "_seq", "_held")
    last = F.max_by("_held", F.struct("_at", "_seq", "_held")).alias("_held")
    carried = _carried(long, entity, [last], ["_held"], [], [])
    seen = long.withColumn("_before", F.lag("_held").over(inside))
    # only the first row of a bucket needs what came before the bucket
    joined = seen.join(carried, [*entity, "_bucket"], "left")
    before = F.coalesce("_before", "_in__held")
    changed = joined.where(before.isNull() | ~before["value"].eqNullSafe(F.col("_held.value")))
    return changed.select(*(F.col(k).alias(c) for c, k in zip(key, keys)), "attribute", F.col("_held.value").alias("value"), F.col("_at").alias("at"), F.col("_seq").alias("seq"))


def versions(log: DataFrame, key: list[str], attributes: list[str], bucket_seconds: int = DAY) -> DataFrame:
    """Versions of each entity from its change log: (*key, version INT, *attributes, valid_from, valid_to).

    Time is split where any attribute changed; neighbours with equal values in
    all attributes are one version. ``valid_to`` is null for the last. Versions
    count from 1.
    """
    held = [f"_a{i}" for i in range(len(attributes))]
    keys = [f"_k{i}" for i in range(len(key))]
    log = written(log.select(*(F.col(c).alias(k) for c, k in zip(key, keys)), "attribute", "value", F.col("at").alias("_at"), F.col("seq").alias("_seq")), "changes")
    cut = log.withColumn("_bucket", F.floor(F.unix_seconds("_at") / F.lit(bucket_seconds))).groupBy(*keys, "_bucket", "_at", "_seq").agg(
        *(F.max(F.when(F.col("attribute") == name, F.struct("value"))).alias(a) for name, a in zip(attributes, held))
    )
    order = ["_at", "_seq"]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    carried = _carried(cut, keys, [F.max_by(a, F.when(F.col(a).isNotNull(), F.struct(*order))).alias(a) for a in held], held, [], [])
    filled = cut.select(*keys, "_bucket", *order, *(F.last(a, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(a) for a in held)).join(carried, [*keys, "_bucket"], "left")
    whole = F.struct(*(F.coalesce(a, f"_in_{a}")["value"].alias(a) for a in held))
    known = [F.col(f"_in_{a}").isNotNull() for a in held]
    earlier = F.when(reduce(or_, known), F.struct(*(F.col(f"_in_{a}")["value"].alias(a) for a in held)))
    filled = filled.select(*keys, "_bucket", *order, whole.alias("_held"), earlier.alias("_earlier"))
    before = F.coalesce("_before", "_earlier")
    kept = written(filled.withColumn("_before", F.lag("_held").over(inside)).where(before.isNull() | ~before.eqNullSafe(F.col("_held"))).drop("_before", "_earlier"), "versions")

    numbered = _carried(kept, keys, [F.min("_at").alias("_first"), F.count("*").alias("_n")], [], ["_first"], ["_n"])
    out = kept.select(*keys, "_bucket", *order, "_held", F.row_number().over(inside).alias("_rn"), F.lead("_at").over(inside).alias("_to")).join(numbered, [*keys, "_bucket"], "left")
    return out.select(
        *(F.col(k).alias(c) for c, k in zip(key, keys)),
        (F.col("_rn") + F.col("_sum__n")).cast("int").alias("version"),
        *(F.col(f"_held.{a}").alias(name) for name, a in zip(attributes, held)),
        F.col("_at").alias("valid_from"),
        F.coalesce("_to", "_next__first").alias("valid_to"),
    )


def as_of(history: DataFrame, moment: Column) -> DataFrame:
    """The rows of ``versions`` that were valid at ``moment``."""
    return history.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))
