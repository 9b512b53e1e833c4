"""What changed between consecutive full snapshots, by Merkle trees over key-hash ranges.

Each snapshot's keys fall into 2**depth ranges of their hash. A range has an
order-free digest; a parent's digest is that of its children. Two snapshots are
compared from the root down, level by level, and rows are joined only in the
leaf ranges whose digests differ. A large group is many ranges, so no task
holds one.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.session import written


def fingerprint(value: Column | str) -> Column:
    """64 bits that stand for a value when snapshots are compared; null stays null. Two values of one key are taken as equal by mistake once in 2**64."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.xxhash64(value))


def carry_forward(entries: DataFrame, group: str, seq: str, key: str, values: list[str]) -> DataFrame:
    """``entries`` with each null value replaced by the key's last known one in the group's earlier snapshots.

    Only keys that ever lack a value are ordered; all others pass untouched.
    """
    gap = reduce(or_, (F.col(v).isNull() for v in values))
    lacking = entries.where(gap).select(group, key).distinct().withColumn("_lacks", F.lit(True))
    marked = entries.select(group, seq, key, *values).join(lacking, [group, key], "left")
    order = Window.partitionBy(group, key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.where(F.col("_lacks")).select(group, seq, key, *(F.last(v, ignorenulls=True).over(order).alias(v) for v in values))
    return marked.where(F.col("_lacks").isNull()).select(group, seq, key, *values).unionByName(filled)


def leaf_depth(rows_in_largest: int, rows_per_leaf: int = 8) -> int:
    """Depth of the tree at which a leaf of the largest snapshot holds about ``rows_per_leaf`` rows, whatever its size."""
    return ceil(log2(rows_in_largest / rows_per_leaf)) if rows_in_largest > rows_per_leaf else 0


def differing_leaves(entries: DataFrame, pairs: DataFrame, group: str, seq: str, depth: int, step: int = 4) -> DataFrame:
    """Leaf ranges whose digests differ: (group, before, after, leaf).

    ``entries`` (group, seq, _leaf, _row) has a hash ``_row`` for each row, each
    key once a snapshot; ``pairs`` (group, before, after) names the snapshots to
    compare. A digest is the number of rows and the exclusive or of their
    hashes, which doesn't depend on their order. The tree branches
    2**``step``-fold; its leaves are aggregated once, upper levels from them.
    """
    level = written(entries.groupBy(group, seq, F.col("_leaf").alias("node")).agg(F.count("*").alias("d0"), F.bit_xor("_row").alias("d1")), "leaves")
    levels = [(depth, level)]
    at = depth
    while at > 0:
        up = max(0, at - step)
        level = level.groupBy(group, seq, F.shiftright("node", at - up).alias("node")).agg(F.sum("d0").alias("d0"), F.bit_xor("d1").alias("d1"))
        at = up
        levels.append((at, level))
    levels.reverse()
    open_pairs, above = pairs.select(group, "before", "after", F.lit(0).cast("bigint").alias("_parent")), 0
    for at, rows in levels:
        named = rows.select(group, F.col(seq).alias("_seq"), "node", "d0", "d1").withColumn("_parent", F.shiftright("node", at - above))
        # a node on one side only differs as well, hence one grouping of both sides and not an inner join
        both = _sides(open_pairs, group, ["_parent"]).join(named, [group, "_seq", "_parent"]).groupBy(group, "before", "after", "node").agg(
            F.sum(F.when(F.col("_side") == 0, F.col("d0")).otherwise(-F.col("d0"))).alias("_rows"), F.bit_xor("d1").alias("_xor")
        )
        open_pairs, above = both.where((F.col("_rows") != 0) | (F.col("_xor") != 0)).select(group, "before", "after", F.col("node").alias("_parent")), at
    return open_pairs.withColumnRenamed("_parent", "leaf")


def _sides(pairs: DataFrame, group: str, kept: list[str]) -> DataFrame:
    """Each pair once for its earlier snapshot (_side 0) and once for its later one (_side 1), the snapshot in _seq."""
    side = F.explode(F.array(F.struct(F.col("before").alias("s"), F.lit(0).alias("side")), F.struct(F.col("after").alias("s"), F.lit(1).alias("side"))))
    return pairs.select(group, "before", "after", *kept, side.alias("_x")).select(group, "before", "after", *kept, F.col("_x.s").alias("_seq"), F.col("_x.side").alias("_side"))


def snapshot_changes(entries: DataFrame, group: str, seq: str, key: str, values: list[str], depth: int, pairs: DataFrame | None = None, nulls_differ: bool = True, unique: bool = False) -> DataFrame:
    """Rows added, removed or changed between consecutive snapshots of each group.

    ``seq`` numbers a group's snapshots 1, 2, ...; ``pairs`` (group, before,
    after) names those to compare, else each with the number before. Result:
    (group, seq of the later snapshot, key, change, differing), change one of
    'added', 'removed', 'changed', differing the names of the ``values`` that
    changed. With ``nulls_differ`` false a null says nothing and never differs.
    Repeated entries of a snapshot count once, with the largest fingerprint of
    each value; ``unique`` promises there are none. Null keys are left out. A
    first snapshot, an empty table or equal snapshots give no rows.
    """
    prints = [f"_v{i}" for i in range(len(values))]
    rows = entries.where(F.col(key).isNotNull()).select(F.col(group).alias("_group"), F.col(seq).alias("_seq"), F.col(key).alias("_key"), *(fingerprint(v).alias(p) for v, p in zip(values, prints)))
    if not unique:
        rows = rows.groupBy("_group", "_seq", "_key").agg(*(F.max(p).alias(p) for p in prints))
    leaf = F.shiftrightunsigned(F.xxhash64("_key"), 64 - depth) if depth else F.lit(0).cast("bigint")
    # read for the digests and again for the rows of differing leaves
    rows = written(rows.withColumns({"_leaf": leaf, "_row": F.xxhash64("_key", *(F.coalesce(F.col(p), F.lit(0)) for p in prints), *(F.col(p).isNull() for p in prints))}), "entries")
    if pairs is None:
        after = rows.select("_group", F.col("_seq").alias("after")).distinct()
        pairs = after.where(F.col("after") > 1).withColumn("before", F.col("after") - 1)
    else:
        pairs = pairs.select(F.col(group).alias("_group"), "before", "after")
    leaves = differing_leaves(rows.select("_group", F.col("_seq").alias("_at"), "_leaf", "_row"), pairs, "_group", "_at", depth)
    sides = _sides(leaves, "_group", ["leaf"]).withColumnRenamed("leaf", "_leaf")
    known = [F.count(p).alias(f"{p}n") for p in prints]
    both = rows.join(sides, ["_group", "_seq", "_leaf"]).groupBy("_group", "after", "_key").agg(F.count_if(F.col("_side") == 0).alias("_l"), F.count_if(F.col("_side") == 1).alias("_r"), *(F.bit_xor(p).alias(p) for p in prints), *known)
    # a value that one side lacks differs only where nulls do; two that are there differ where their fingerprints do
    differs = {v: F.when(F.col(f"{p}n") == 2, F.col(p) != 0).otherwise((F.col(f"{p}n") == 1) & F.lit(nulls_differ)) for v, p in zip(values, prints)}
    kept = (F.col("_l") == 1) & (F.col("_r") == 1)
    differing = F.when(kept, F.array_compact(F.array(*(F.when(d, F.lit(v)) for v, d in differs.items()))))
    change = F.when(F.col("_l") == 0, "added").when(F.col("_r") == 0, "removed").when(F.size("differing") > 0, "changed")
    return both.withColumn("differing", differing).withColumn("change", change).where(F.col("change").isNotNull()).select(
        F.col("_group").alias(group), F.col("after").alias(seq), F.col("_key").alias(key), "change", "differing"
    )
