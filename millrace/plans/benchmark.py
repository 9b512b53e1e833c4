"""A benchmark from a verified snapshot to a scorecard: runs, run specs, judgements, measures and the page.

    python -m millrace.plans.benchmark --snapshot DIR --manifest FILE --queries FILE --out DIR
"""

from __future__ import annotations

import argparse
import hashlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import relevance, scoring, search
from millrace.operators.lexicon import Lexicon
from millrace.plans.report import page
from millrace.session import read_small, written
from millrace.sources import native as shop
from millrace.sources.http import Pages, Visitor
from millrace.sources.snapshot import check_snapshot, read_json, read_snapshot, write_json, write_small

LABELS = {"bm25": "BM25", "bm25-compound": "BM25+Compound", "bm25-lex": "BM25+Lex"}
NATIVE = "native"


def local_runs(records: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, dict]:
    """(system, query_id, rank, product_id) of the three systems, and the lexicon's description."""
    docs = written(search.fielded(records), "documents")
    plain, split, book = search.build_index(docs).kept(), search.build_index(docs, compound=True).kept(), Lexicon.of(docs)
    found = {
        "bm25": search.search(plain, search.query_terms(asked), k),
        "bm25-compound": search.search(split, search.query_terms(asked, compound=True), k),
        "bm25-lex": search.search(split, book.terms(asked, split), k, coord=True),
    }
    out = None
    for system, rows in found.items():
        rows = rows.select(F.lit(system).alias("system"), "query_id", "rank", F.col("doc_id").alias("product_id"))
        out = rows if out is None else out.unionByName(rows)
    return written(out, "runs"), book.describe()


def run_spec(system: str, k_run: int, k_eval: int, lexicon: dict) -> dict:
    """The parameters that name a system."""
    spec = {"system": system, "k1": search.K1, "b": search.B, "field_weights": search.WEIGHTS, "k_run": k_run, "k_eval": k_eval, "code": "millrace.operators.search", "compound": system != "bm25"}
    return spec | ({"coord": True, "lexicon": lexicon} if system == "bm25-lex" else {})


def listed(runs: DataFrame, system: str, queries: list[dict]) -> dict[str, list[str]]:
    """Product ids in order for each query of one system; a report's size, k_run ids a query at most."""
    rows = runs.where(F.col("system") == system).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "product_id"))).alias("l")).collect()
    found = {r["query_id"]: [x["product_id"] for x in r["l"]] for r in rows}
    return {q["id"]: found.get(q["id"], []) for q in queries}


def held_out(other: dict) -> dict:
    """What of a held-out scorecard is shown beside this one."""
    return {"queries": other["queries"], "systems": {n: {k: s[k] for k in ("label", "answerable_ndcg", "absent_returned")} for n, s in other["systems"].items()}}


def run(spark: SparkSession, snapshot: str, manifest: str, queries: str, out: str, capture: Pages | None = None, host: str | None = None, holdout: str | None = None, example_ids: tuple[str, ...] = (), now: str | None = None, site: str | None = None) -> dict:
    """Scores the systems over a query set file and writes runs, run specs, scorecard and page to ``out``.

    The snapshot must have the digest its manifest states. With ``capture`` the
    shop's own search is captured from ``host`` first; else its run is empty.
    """
    said = read_json(spark, manifest)
    check_snapshot(spark, snapshot, said)
    records, text = read_snapshot(spark, snapshot), read_small(spark, queries)
    asked_set = read_json(spark, queries)
    asked_queries = asked_set["queries"]
    k_run, k_eval, label = int(asked_set.get("k_run", 20)), int(asked_set.get("k_eval", 10)), asked_set.get("short_label") or "Store"
    asked = spark.createDataFrame([(q["id"], q["query"], q["stratum"]) for q in asked_queries], "query_id string, query string, stratum string")
    runs, lexicon = local_runs(records, asked, k_run)
    overlap, replayed = {"mapped": 0, "unmapped": 0}, None
    if capture is not None:
        host = host or asked_set.get("host")
        if not host:
            raise ValueError("capturing a shop's search asks for its host")
        replayed = written(shop.capture(capture, host, asked, records, f"native-{said['run_id']}", k_run), "native")
        overlap = shop.overlap(replayed).first().asDict()
        runs = runs.unionByName(replayed.where(F.col("rank").isNotNull()).select(F.lit(NATIVE).alias("system"), "query_id", "rank", "product_id"))
    systems = [NATIVE, *LABELS]
    qrels = written(relevance.qrels(asked_queries, records), "qrels")
    per_query = written(scoring.score_queries(runs, qrels, asked, systems, k_eval), "scores")
    by_stratum: dict[str, dict[str, float]] = {}
    for r in scoring.score_strata(per_query).collect():
        by_stratum.setdefault(r["system"], {})[r["stratum"]] = r["ndcg"]
    totals = {r["system"]: r.asDict() for r in scoring.score_systems(per_query).collect()}
    labels = {NATIVE: f"{label} native", **LABELS}
    shown = scoring.examples(runs.where(F.col("query_id").isin(*example_ids)), qrels, records).orderBy("rank").collect() if example_ids else []
    order = {q["id"]: i for i, q in enumerate(asked_queries)}

    def shown_of(query: str, system: str) -> list[dict]:
        return [{k: r[k] for k in ("product_id", "title", "grade")} for r in shown if r["query_id"] == query and r["system"] == system]

    card = {
        "generated_at": now or datetime.now(timezone.utc).isoformat(), "store": label, "display_name": asked_set.get("display_name") or label, "k": k_eval,
        "snapshot": {"run_id": said["run_id"], "count": said["count"], "sha256": said["snapshot_sha256"], "digest": said["digest"]},
        "queries": {"id": asked_set["id"], "n": len(asked_queries), "sha256": hashlib.sha256(text.encode()).hexdigest(), "committed_at": asked_set.get("committed_at")},
        "overlap": overlap,
        "systems": {s: {k: v for k, v in totals[s].items() if k != "system"} | {"by_stratum": by_stratum.get(s, {}), "label": labels[s]} for s in systems if s in totals},
        "per_query": sorted(({("id" if k == "query_id" else k): v for k, v in r.asDict().items()} for r in per_query.collect()), key=lambda r: (systems.index(r["system"]), order[r["id"]])),
        "examples": [{"id": q["id"], "query": q["query"], "native": shown_of(q["id"], NATIVE), "mine": shown_of(q["id"], "bm25-lex")} for q in asked_queries if q["id"] in example_ids],
    }
    if holdout:
        card["holdout"] = held_out(read_json(spark, holdout))
    for system in LABELS:
        write_json(spark, f"{out}/runspec-{system}.json", run_spec(system, k_run, k_eval, lexicon))
    for system in systems:
        known = shop.artifact(replayed, asked_queries, host, k_run) if system == NATIVE and replayed is not None else {}
        write_json(spark, f"{out}/run-{system}.json", {"system": system, "queries": listed(runs, system, asked_queries)} | known)
    write_json(spark, f"{out}/scorecard.json", card)
    for folder in (out, site) if site else (out,):
        write_small(spark, f"{folder}/index.html", page(card), overwrite=True)
    return card


def main() -> None:
    p = argparse.ArgumentParser(description="Score rankings of a catalog snapshot.")
    for name in ("snapshot", "manifest", "queries", "out"):
        p.add_argument(f"--{name}", required=True)
    for name in ("holdout", "host", "cache", "site"):
        p.add_argument(f"--{name}")
    p.add_argument("--example", action="append", default=[], help="id of a query whose results are shown side by side")
    p.add_argument("--capture-native", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("millrace-benchmark").getOrCreate()
    fetcher = None
    if a.capture_native:
        fetcher = Pages(spark, a.cache or f"{a.out}/pages", Visitor(**read_json(spark, a.manifest)["request_profile"]), pause=5.0)
    card = run(spark, a.snapshot, a.manifest, a.queries, a.out, fetcher, a.host, a.holdout, tuple(a.example), site=a.site)
    for s in card["systems"].values():
        print(f"{s['label']}: nDCG {s['answerable_ndcg']:.3f}, P {s['precision']:.3f}, on absent queries {s['absent_returned']}")


if __name__ == "__main__":
    main()
