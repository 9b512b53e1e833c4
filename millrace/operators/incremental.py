"""Processing only new or changed records, from persisted key and content-hash state.

The state is a set of immutable Parquet parts in a shared folder and a small
file for each version that lists the parts in force. A run hashes the current
rows, joins them with the state and gets exactly the new and changed ones;
after its work it writes its keys as a further part and creates the next
version's file, which only one run can. A run that dies before that leaves the
state as it was, so its records come up again; one that dies after it has
nothing left to repeat; one that comes second must read the state again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.session import Conflict, advance, current

StateConflict = Conflict


def content_hash(columns: list[str]) -> Column:
    """SHA-256 over the columns' values; null and the empty text differ, and so do shifted fields.

    Values count in their text form, complex ones as JSON.
    """
    def text(c: str) -> Column:
        value = F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
        return F.concat(F.length(value).cast("string"), F.lit(":"), value)

    return F.sha2(F.concat_ws("|", *(text(c) for c in columns)), 256)


class ProcessingState:
    """Keys already processed, with the content they had: (key STRING, content_hash STRING, state_version BIGINT)."""

    SCHEMA = "key string, content_hash string, state_version bigint"
    COMPACT_AFTER = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, text = current(spark, self.path)
        self.parts: list[str] = json.loads(text) if text else []

    def read(self) -> DataFrame:
        """The state in force, one row per key."""
        if not self.parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.path}/{p}" for p in self.parts))
        if len(self.parts) == 1:
            return rows
        return rows.groupBy("key").agg(F.max_by("content_hash", "state_version").alias("content_hash"), F.max("state_version").alias("state_version"))

    def changes(self, current: DataFrame, key: Column, columns: list[str]) -> DataFrame:
        """Rows of ``current`` whose key is new or whose ``columns`` changed, with key, content_hash and change.

        ``change`` is 'new' or 'changed'. Rows equal in key and content come
        once; a row with a null key has no identity and is left out. If one key
        has several contents, each that differs from the state comes.
        """
        names = [f"_c{i}" for i in range(len(columns))]
        hashed = current.select(key.cast("string").alias("_key"), content_hash(columns).alias("_hash"), *(F.col(c).alias(n) for c, n in zip(columns, names)))
        # repeats collapse here, before the join's shuffle
        hashed = hashed.where(F.col("_key").isNotNull()).groupBy("_key", "_hash").agg(*(F.first(n).alias(n) for n in names))
        state = self.read().select(F.col("key").alias("_key"), F.col("content_hash").alias("_old"), F.lit(True).alias("_known"))
        found = hashed.join(state, "_key", "left").where(F.col("_known").isNull() | (F.col("_old") != F.col("_hash")))
        return found.select(
            F.col("_key").alias("key"), F.col("_hash").alias("content_hash"), F.when(F.col("_known"), "changed").otherwise("new").alias("change"),
            F.struct(*(F.col(n).alias(c) for c, n in zip(columns, names))).alias("record"),
        )

    def commit(self, processed: DataFrame) -> int:
        """Records ``processed`` (key, content_hash) as done in a new version of the state; returns its number.

        Of several contents of a key the largest hash stays. Raises
        StateConflict if another run made that version first.
        """
        done = processed.groupBy(F.col("key").cast("string").alias("key")).agg(F.max("content_hash").alias("content_hash")).where(F.col("key").isNotNull())
        done = done.withColumn("state_version", F.lit(self.version + 1).cast("bigint"))
        parts = list(self.parts)
        if len(parts) >= self.COMPACT_AFTER:
            done, parts = self.read().join(done.select("key"), "key", "left_anti").unionByName(done), []
        name = f"part-{self.version + 1:08d}-{uuid.uuid4().hex}"
        done.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        parts.append(name)
        advance(self.spark, self.path, self.version + 1, json.dumps(parts))
        self.version, self.parts = self.version + 1, parts
        return self.version
