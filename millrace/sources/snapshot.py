"""Snapshots and stores on a shared file system."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.catalog import RECORD_FIELDS, STORE, Store
from millrace.session import advance, current, file_system, read_small, write_small

SNAPSHOT = """product_id string, handle string, title string, body_html string, vendor string, product_type string, tags array<string>,
options array<struct<name string, values array<string>>>, variant_ids array<string>, variant_titles array<string>, variant_options array<array<string>>,
skus array<string>, available array<boolean>, prices array<string>, compare_at_prices array<string>, image_urls array<string>, source_payload string"""


class ArtifactExists(Exception):
    """A run id already names a snapshot or manifest."""


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines snapshot; blank lines are skipped."""
    return spark.read.schema(SNAPSHOT).json(path)


def snapshot_lines(records: DataFrame) -> DataFrame:
    """(value) of each record as a JSON line, keys and lines in order."""
    held = F.struct(*(F.col(c) for c in sorted(RECORD_FIELDS)))
    return records.orderBy("product_id").select(F.to_json(held, {"ignoreNullFields": "false"}).alias("value"))


def write_snapshot(records: DataFrame, path: str) -> None:
    """Writes a snapshot once; ArtifactExists if there is one. Lines are in order across the files, which a reader joins by name."""
    fs, where = file_system(records.sparkSession, path)
    if fs.exists(where):
        raise ArtifactExists(path)
    snapshot_lines(records).write.mode("errorifexists").text(path)


def snapshot_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the files of a snapshot in order of their names, each by its own digest."""
    files = spark.read.format("binaryFile").load(path).where(~F.col("path").rlike("/[_.][^/]*$"))
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return named.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("\0"), "digest"))), "\n"), 256)).first()[0]


def check_snapshot(spark: SparkSession, path: str, manifest: dict) -> None:
    if (found := snapshot_digest(spark, path)) != manifest["snapshot_sha256"]:
        raise ValueError(f"snapshot {path} has digest {found}, its manifest says {manifest['snapshot_sha256']}")


def write_json(spark: SparkSession, path: str, value: object, new: bool = False) -> None:
    """One small JSON file, indented; with ``new`` it must not exist yet."""
    if new and read_small(spark, path) is not None:
        raise ArtifactExists(path)
    write_small(spark, path, json.dumps(value, indent=2, ensure_ascii=False, sort_keys=new) + "\n", overwrite=not new)


def read_json(spark: SparkSession, path: str) -> dict:
    if (text := read_small(spark, path)) is None:
        raise FileNotFoundError(path)
    return json.loads(text)


#: What has been merged into a store: kept with it, so that a merge and its mark are one step.
APPLIED = "name string, at string"
COMPACT_AFTER = 16


def _parts(spark: SparkSession, path: str) -> tuple[int, dict[str, list[str]]]:
    version, text = current(spark, path)
    return version, json.loads(text) if text else {name: [] for name in (*STORE, "applied")}


def _read(spark: SparkSession, path: str, schema: str, parts: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{path}/{p}" for p in parts)) if parts else spark.createDataFrame([], schema)


def open_store(spark: SparkSession, path: str) -> Store:
    """The store in force at ``path``; an empty one where there is none yet."""
    version, parts = _parts(spark, path)
    return Store(*(_read(spark, path, schema, parts[name]) for name, schema in STORE.items()), version=version)


def applied(spark: SparkSession, path: str) -> DataFrame:
    """(name, at) of what ``save_store`` was told to mark."""
    return _read(spark, path, APPLIED, _parts(spark, path)[1]["applied"])


def save_store(spark: SparkSession, path: str, store: Store, mark: tuple[str, str] | None = None) -> int:
    """Puts a merged store in force as the version after the one it was opened at; readers see all of a merge or none.

    Tables that a merge only adds to get its rows as a further part; what it
    changes throughout (the state) is written anew, and so is a table of many
    parts. ``mark`` (name, time) is recorded in the same step. Raises Conflict
    if another merge came first; what this one wrote is then in no version.
    """
    _, parts = _parts(spark, path)
    parts = {name: list(p) for name, p in parts.items()}
    for name in STORE:
        added = store.added.get(name)
        whole = added is None or len(parts[name]) >= COMPACT_AFTER
        part = f"{name}-{store.version + 1:08d}-{uuid.uuid4().hex}"
        (getattr(store, name) if whole else added).write.mode("errorifexists").parquet(f"{path}/{part}")
        parts[name] = [part] if whole else [*parts[name], part]
    if mark:
        part = f"applied-{store.version + 1:08d}-{uuid.uuid4().hex}"
        done = spark.createDataFrame([mark], APPLIED)
        whole = len(parts["applied"]) >= COMPACT_AFTER
        (applied(spark, path).unionByName(done) if whole else done).coalesce(1).write.mode("errorifexists").parquet(f"{path}/{part}")
        parts["applied"] = [part] if whole else [*parts["applied"], part]
    advance(spark, path, store.version + 1, json.dumps(parts))
    return store.version + 1
