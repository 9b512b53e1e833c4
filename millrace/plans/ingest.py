"""From a host to a snapshot, a manifest and a synchronised store.

    python -m millrace.plans.ingest --host H --locale sv-SE --accept-language sv --data DIR --artifacts DIR
"""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import catalog
from millrace.session import file_system, written
from millrace.sources.crawl import crawl_verified
from millrace.sources.http import Pages, Visitor
from millrace.sources.snapshot import ArtifactExists, open_store, save_store, snapshot_digest, write_json, write_snapshot


@dataclass
class IngestResult:
    manifest: dict
    report: catalog.SyncReport
    snapshot: str
    manifest_path: str


def batch_of(records: DataFrame) -> DataFrame:
    """What the merge takes of normalised records."""
    hashed = catalog.with_enrichment_hash(records)
    fields = F.struct(*(F.col(c) for c in sorted(catalog.RECORD_FIELDS)))
    return hashed.select("product_id", "source_payload_hash", "enrichment_input_hash", F.to_json(fields, {"ignoreNullFields": "false"}).alias("payload"), catalog.enrichment_input().alias("input_payload"))


def sync_store(spark: SparkSession, path: str, records: DataFrame, now: str, mark: str | None = None) -> catalog.SyncReport:
    """Merges a full batch into the store at ``path``, and marks it as applied; readers see all of it or none."""
    after, counts = catalog.sync(open_store(spark, path), written(batch_of(records), "batch"), now)
    report = catalog.SyncReport(**{r["outcome"]: r["n"] for r in counts.collect()})
    save_store(spark, path, after, (mark, now) if mark else None)
    return report


def ingest(spark: SparkSession, host: str, data: str, artifacts: str, run_id: str, visitor: Visitor, pages: Pages | None = None, now: str | None = None, attempt: str | None = None, **gates) -> IngestResult:
    """One verified crawl: snapshot, then manifest, then the store, so the store is never ahead of the files.

    A run id names one snapshot for good. If the manifest can't be written its
    snapshot is taken back, so that the run can be tried again.
    """
    now, attempt = now or datetime.now(timezone.utc).isoformat(), attempt or uuid4().hex
    snapshot, manifest_path, store = f"{data}/{host}/snapshot-{run_id}", f"{artifacts}/{host}/manifest-{run_id}.json", f"{data}/{host}/store"
    for path in (snapshot, manifest_path):
        fs, where = file_system(spark, path)
        if fs.exists(where):
            raise ArtifactExists(path)
    pages = pages or Pages(spark, f"{data}/pages", visitor)
    if pages.visitor != visitor:
        raise ValueError("the pages are another visitor's")
    previous = catalog.live_count(open_store(spark, store).product_state) or None
    records, core = crawl_verified(spark, pages, host, attempt, previous=previous, **gates)
    records = written(records, "crawl")
    write_snapshot(records, snapshot)
    manifest = core | {"domain": host, "run_id": run_id, "attempt_id": attempt, "crawled_at": now, "request_profile": asdict(visitor), "snapshot_sha256": snapshot_digest(spark, snapshot)}
    try:
        write_json(spark, manifest_path, manifest, new=True)
    except Exception:
        fs, where = file_system(spark, snapshot)
        fs.delete(where, True)
        raise
    return IngestResult(manifest, sync_store(spark, store, records, now), snapshot, manifest_path)


def main() -> None:
    p = argparse.ArgumentParser(description="Crawl a catalog twice, verify it and merge it into the store.")
    for name in ("host", "locale", "accept-language"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--data", default="data")
    p.add_argument("--artifacts", default="artifacts")
    p.add_argument("--minimum", type=int, default=1)
    p.add_argument("--max-drop", type=float, default=0.10)
    p.add_argument("--allow-large-drop", action="store_true")
    p.add_argument("--run-id", default=datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ"))
    a = p.parse_args()
    spark = SparkSession.builder.appName("millrace-ingest").getOrCreate()
    done = ingest(spark, a.host, a.data, a.artifacts, a.run_id, Visitor(a.locale, a.accept_language), minimum=a.minimum, max_drop=a.max_drop, allow_large_drop=a.allow_large_drop)
    print(done.manifest["count"], "products;", ", ".join(f"{k} {v}" for k, v in done.report.as_dict().items()))


if __name__ == "__main__":
    main()
