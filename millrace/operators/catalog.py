"""Catalog records: normalisation, digests, crawl verification and the versioned soft-deleting merge."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# The fields whose change asks for a new enrichment.
ENRICHMENT_FIELDS = ("title", "body_html", "tags", "vendor", "product_type", "options", "variant_titles")

RAW = """id string, handle string, title string, body_html string, vendor string, product_type string, tags array<string>,
options array<struct<name string, values array<string>>>,
variants array<struct<id string, title string, sku string, available boolean, price string, compare_at_price string, option1 string, option2 string, option3 string>>,
images array<struct<src string>>"""

RECORD_FIELDS = (
    "product_id", "handle", "title", "body_html", "vendor", "product_type", "tags", "options", "variant_ids", "variant_titles", "variant_options",
    "skus", "available", "prices", "compare_at_prices", "image_urls", "source_payload",
)


class InconsistentCrawl(Exception):
    """A crawl that can't show it saw one consistent catalog."""


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def raw_fault(product: object) -> str | None:
    """What keeps a decoded JSON value from being a raw product, null if nothing does."""
    if not (isinstance(product, dict) and "id" in product):
        return "not an object with an id"
    for name in ("variants", "options", "images"):
        inner = product.get(name)
        if inner is not None and not (isinstance(inner, list) and all(isinstance(x, dict) for x in inner)):
            return f"{name} of {product['id']} isn't a list of objects"
    return None


def _fault_of(text: str | None) -> str | None:
    try:
        return "null" if text is None else raw_fault(json.loads(text))
    except (ValueError, RecursionError) as e:
        return f"no JSON: {e}"[:200]


def _faults(texts: pd.Series) -> pd.Series:
    return pd.Series([_fault_of(t) for t in texts], dtype=object)


def quarantined(raw: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """``raw`` in two: rows whose JSON text ``normalize`` takes, and the others with their ``fault``."""
    judged = raw.withColumn("fault", F.pandas_udf(_faults, "string")(F.col(column)))
    return judged.where(F.col("fault").isNull()).drop("fault"), judged.where(F.col("fault").isNotNull())


def _payload(texts: pd.Series) -> pd.DataFrame:
    """By raw product: its payload with tags in order, and the digest without response times."""
    payloads, digests = [], []
    for text in texts:
        raw = json.loads(text)
        raw["tags"] = sorted(raw.get("tags") or [])
        payloads.append(canonical_json(raw))
        lasting = {k: v for k, v in raw.items() if k != "updated_at"}
        if lasting.get("variants"):
            lasting["variants"] = [{k: v for k, v in one.items() if k != "updated_at"} for one in lasting["variants"]]
        digests.append(hashlib.sha256(canonical_json(lasting).encode("utf-8", "surrogatepass")).hexdigest())
    return pd.DataFrame({"payload": payloads, "hash": digests})


def _field(name: str) -> Column:
    """A raw field, '' where it is null or missing."""
    return F.coalesce(F.col(f"r.{name}"), F.lit(""))


def normalize(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The 17 fields of RECORD_FIELDS and ``source_payload_hash`` from raw products as JSON text.

    Ids are text. Null and missing texts are '', but a null variant price stays
    null. Tags and option values are in order, variants keep theirs; an option
    that a variant lacks is left out of its list. A payload without tags gains
    an empty list. Response times stay in the payload and out of its digest.
    """
    payload = F.pandas_udf(_payload, "payload string, hash string")
    none = F.array()
    rows = raw.select(payload(F.col(column)).alias("p"), F.from_json(column, RAW).alias("r"))
    variants = F.coalesce(F.col("r.variants"), none.cast("array<struct<id:string,title:string,sku:string,available:boolean,price:string,compare_at_price:string,option1:string,option2:string,option3:string>>"))
    each = lambda f: F.transform(variants, f)
    options = F.transform(
        F.coalesce(F.col("r.options"), none.cast("array<struct<name:string,values:array<string>>>")),
        lambda o: F.struct(F.coalesce(o["name"], F.lit("")).alias("name"), F.array_sort(F.coalesce(o["values"], none.cast("array<string>"))).alias("values")),
    )
    return rows.select(
        F.col("r.id").alias("product_id"), *(_field(n).alias(n) for n in ("handle", "title", "body_html", "vendor", "product_type")),
        F.array_sort(F.coalesce(F.col("r.tags"), none.cast("array<string>"))).alias("tags"), options.alias("options"),
        each(lambda v: F.coalesce(v["id"], F.lit(""))).alias("variant_ids"), each(lambda v: F.coalesce(v["title"], F.lit(""))).alias("variant_titles"),
        each(lambda v: F.array_compact(F.array(v["option1"], v["option2"], v["option3"]))).alias("variant_options"),
        each(lambda v: F.coalesce(v["sku"], F.lit(""))).alias("skus"), each(lambda v: F.coalesce(v["available"], F.lit(False))).alias("available"),
        each(lambda v: v["price"]).alias("prices"), each(lambda v: v["compare_at_price"]).alias("compare_at_prices"),
        F.transform(F.coalesce(F.col("r.images"), none.cast("array<struct<src:string>>")), lambda i: F.coalesce(i["src"], F.lit(""))).alias("image_urls"),
        F.col("p.payload").alias("source_payload"), F.col("p.hash").alias("source_payload_hash"),
    )


def _digests(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.sha256(canonical_json(json.loads(t)).encode("utf-8", "surrogatepass")).hexdigest())


def enrichment_input(fields: tuple[str, ...] = ENRICHMENT_FIELDS) -> Column:
    """JSON of the fields an enrichment reads."""
    return F.to_json(F.struct(*(F.col(f) for f in sorted(fields))), {"ignoreNullFields": "false"})


def with_enrichment_hash(records: DataFrame) -> DataFrame:
    """``records`` with ``enrichment_input_hash``, the digest of their search fields in canonical JSON."""
    digest = F.pandas_udf(_digests, "string")
    return records.withColumn("enrichment_input_hash", digest(enrichment_input()))


def duplicate_ids(records: DataFrame) -> DataFrame:
    """(product_id, n) of ids that come more than once."""
    return records.groupBy("product_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def manifest_digest(records: DataFrame) -> DataFrame:
    """(count, digest) of a crawl: SHA-256 of its 'id NUL hash' lines in order.

    One digest over lines in order is made one line after the other; they are
    sorted in ranges, and the ranges pass through the driver one at a time.
    """
    line = F.concat("product_id", F.lit("\x00"), "source_payload_hash")
    count, digest, between = 0, hashlib.sha256(), b""
    for row in records.select(line.alias("line")).orderBy("line").toLocalIterator(prefetchPartitions=True):
        digest.update(between + row["line"].encode())
        count, between = count + 1, b"\n"
    return records.sparkSession.createDataFrame([(count, digest.hexdigest())], "count bigint, digest string")


def build_manifest(records: DataFrame) -> dict:
    """The core of a manifest; raises InconsistentCrawl on duplicate ids."""
    twice = duplicate_ids(records)
    shown = [r["product_id"] for r in twice.orderBy("product_id").limit(5).collect()]
    if shown:
        raise InconsistentCrawl(f"{twice.count()} duplicate ids across pages, as {shown}: pages shifted during the crawl")
    row = manifest_digest(records).first()
    return {"schema_version": 1, "count": row["count"], "digest": row["digest"]}


def crawl_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(product_id, difference): 'only_first', 'only_second' or 'differing'; equal products give no row."""
    both = first.select("product_id", F.col("source_payload_hash").alias("_a")).join(second.select("product_id", F.col("source_payload_hash").alias("_b")), "product_id", "full_outer")
    kind = F.when(F.col("_b").isNull(), "only_first").when(F.col("_a").isNull(), "only_second").when(F.col("_a") != F.col("_b"), "differing")
    return both.select("product_id", kind.alias("difference")).where(F.col("difference").isNotNull())


def check_counts(count: int, minimum: int = 1, previous: int | None = None, max_drop: float = 0.10, allow_large_drop: bool = False) -> None:
    """Raises InconsistentCrawl where a crawl is too small, or much smaller than the one before."""
    if count < minimum:
        raise InconsistentCrawl(f"{count} products are under the minimum of {minimum}")
    if previous and not allow_large_drop and count < math.ceil(previous * (1 - max_drop)):
        raise InconsistentCrawl(f"a large drop, from {previous} to {count} products; at most {max_drop:.0%} are accepted unless allowed")


def _refused(counts: pd.Series, previous: pd.Series) -> pd.Series:
    def refuses(count: int, before: int) -> bool:
        try:
            check_counts(int(count), minimum=0, previous=int(before))
        except InconsistentCrawl:
            return True
        return False

    return pd.Series([refuses(c, p) for c, p in zip(counts, previous)], dtype=bool)


def is_refused(count: Column, previous: Column) -> Column:
    """Whether ``check_counts`` refuses a crawl of ``count`` products after one of ``previous``."""
    return F.pandas_udf(_refused, "boolean")(count, previous)


def verify_crawls(first: DataFrame, second: DataFrame, **gates) -> tuple[DataFrame, dict]:
    """The second crawl and its manifest, if both crawls agree and the count gates hold."""
    one, two = build_manifest(first), build_manifest(second)
    if one["digest"] != two["digest"]:
        found = crawl_difference(first, second)
        counts = {r["difference"]: r["count"] for r in found.groupBy("difference").count().collect()}
        kind = next(d for d in ("only_first", "only_second", "differing") if d in counts)
        shown = [r["product_id"] for r in found.where(F.col("difference") == kind).orderBy("product_id").limit(3).collect()]
        raise InconsistentCrawl(f"the catalog changed between the crawls ({one['count']} then {two['count']} products): {counts}, as {shown}")
    check_counts(two["count"], **gates)
    return second, two


@dataclass
class SyncReport:
    """Outcomes of one merge."""

    new: int = 0
    source_changed: int = 0
    enrichment_stale: int = 0
    unchanged: int = 0
    disappeared: int = 0
    enrichment_jobs: int = 0

    def as_dict(self) -> dict[str, int]:
        return asdict(self)


@dataclass(frozen=True)
class Store:
    """The four tables of a catalog; the merge gives new ones and changes none.

    ``added`` has the rows by which a table is longer than in the store it was
    made of, for the tables that a merge only adds to; ``version`` is that store's.
    """

    product_version: DataFrame
    product_state: DataFrame
    enrichment_cache: DataFrame
    product_enrichment: DataFrame
    version: int = 0
    added: dict[str, DataFrame] = field(default_factory=dict)


STORE = {
    "product_version": "product_id string, version int, source_payload_hash string, enrichment_input_hash string, payload string, created_at string",
    "product_state": "product_id string, current_version int, first_seen string, last_seen string, deleted_at string",
    "enrichment_cache": "enrichment_input_hash string, input_payload string, status string, result string, raw_response string, created_at string, completed_at string",
    "product_enrichment": "product_id string, enrichment_input_hash string, first_requested string",
}


def sync_outcomes(batch: DataFrame, version: DataFrame, state: DataFrame) -> DataFrame:
    """(product_id, outcome, current_version) of a full batch against the store; products that neither side has live give no row.

    ``batch`` (product_id, source_payload_hash, enrichment_input_hash) has each
    product once. An unchanged product that comes back counts as unchanged.
    """
    held = state.join(version.select("product_id", F.col("version").alias("current_version"), F.col("source_payload_hash").alias("_s"), F.col("enrichment_input_hash").alias("_e")), ["product_id", "current_version"], "left")
    both = batch.select("product_id", "source_payload_hash", "enrichment_input_hash", F.lit(True).alias("_in")).join(held, "product_id", "full_outer")
    outcome = (
        F.when(F.col("_in").isNull(), F.when(F.col("deleted_at").isNull(), "disappeared"))
        .when(F.col("current_version").isNull(), "new")
        .when(F.col("_e").isNull() | (F.col("_e") != F.col("enrichment_input_hash")), "enrichment_stale")
        .when(F.col("_s") != F.col("source_payload_hash"), "source_changed")
        .otherwise("unchanged")
    )
    return both.select("product_id", outcome.alias("outcome"), "current_version", "first_seen", "last_seen", "deleted_at", "source_payload_hash", "enrichment_input_hash")


def merged_state(outcomes: DataFrame, now: str) -> DataFrame:
    """The state table after a merge at ``now``."""
    o, at = F.col("outcome"), F.lit(now)
    seen = o.isin("new", "unchanged", "enrichment_stale", "source_changed")
    changed = o.isin("enrichment_stale", "source_changed")
    return outcomes.select(
        "product_id", F.when(o == "new", 1).when(changed, F.col("current_version") + 1).otherwise(F.col("current_version")).cast("int").alias("current_version"),
        F.when(o == "new", at).otherwise(F.col("first_seen")).alias("first_seen"), F.when(seen, at).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen, F.lit(None).cast("string")).when(o == "disappeared", at).otherwise(F.col("deleted_at")).alias("deleted_at"),
    )


def sync(store: Store, batch: DataFrame, now: str) -> tuple[Store, DataFrame]:
    """The store after a full batch, and the outcome counts (outcome, n), enrichment jobs among them.

    ``batch`` has product_id, both hashes, ``payload`` and ``input_payload``,
    each product once. One job is made for each input hash the cache lacks.
    """
    outcomes = sync_outcomes(batch, store.product_version, store.product_state)
    writes = outcomes.where(F.col("outcome").isin("new", "enrichment_stale", "source_changed"))
    added = writes.join(batch.select("product_id", "payload"), "product_id").select(
        "product_id", (F.coalesce("current_version", F.lit(0)) + 1).cast("int").alias("version"), "source_payload_hash", "enrichment_input_hash", "payload", F.lit(now).alias("created_at")
    )
    asked = writes.where(F.col("outcome") != "source_changed").select("product_id", "enrichment_input_hash")
    jobs = asked.join(batch.select("product_id", "input_payload"), "product_id").groupBy("enrichment_input_hash").agg(F.min("input_payload").alias("input_payload")).join(store.enrichment_cache, "enrichment_input_hash", "left_anti")
    nothing = F.lit(None).cast("string")
    jobs = jobs.select("enrichment_input_hash", "input_payload", F.lit("pending").alias("status"), nothing.alias("result"), nothing.alias("raw_response"), F.lit(now).alias("created_at"), nothing.alias("completed_at"))
    linked = asked.join(store.product_enrichment, ["product_id", "enrichment_input_hash"], "left_anti").withColumn("first_requested", F.lit(now))
    counts = outcomes.where(F.col("outcome").isNotNull()).groupBy("outcome").agg(F.count("*").alias("n")).unionByName(jobs.agg(F.lit("enrichment_jobs").alias("outcome"), F.count("*").alias("n")))
    new = {"product_version": added, "enrichment_cache": jobs, "product_enrichment": linked}
    longer = {name: getattr(store, name).unionByName(rows) for name, rows in new.items()}
    return Store(product_state=merged_state(outcomes, now), version=store.version, added=new, **longer), counts


def pending_enrichment(cache: DataFrame) -> DataFrame:
    return cache.where(F.col("status") == "pending").select("enrichment_input_hash", "input_payload").orderBy("enrichment_input_hash")


def complete_enrichment(cache: DataFrame, digest: str, result: dict, raw_response: str, now: str) -> DataFrame:
    """The cache with one pending input completed; KeyError unless exactly one row is that."""
    this = (F.col("enrichment_input_hash") == digest) & (F.col("status") == "pending")
    if cache.where(this).count() != 1:
        raise KeyError(f"{digest} is no pending enrichment input")
    new = {"status": "completed", "result": json.dumps(result, ensure_ascii=False), "raw_response": raw_response, "completed_at": now}
    return cache.select(*((F.when(this, F.lit(new[c])).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in cache.columns))


def live_count(state: DataFrame) -> int:
    return state.where(F.col("deleted_at").isNull()).count()
