"""The search, relevance, scoring and sync queries in DuckDB's SQL, written independently of the operators."""

from __future__ import annotations

from millrace.functions.text import ENGLISH_HEADS, HEADS, MODIFIERS, SINGULARS
from millrace.plans.search import QUERIES, SYSTEMS
from millrace.operators.scoring import STRATA


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def mapped(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in pairs.items()) + "}"


#: References that occur in the tables, &amp; last as one pass decodes each once.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&auml;": "ä", "&aring;": "å", "&ouml;": "ö", "&Auml;": "Ä", "&Aring;": "Å", "&Ouml;": "Ö", "&oslash;": "ø", "&aelig;": "æ", "&Oslash;": "Ø", "&AElig;": "Æ", "&uuml;": "ü", "&Uuml;": "Ü", "&szlig;": "ß", "&eacute;": "é", "&nbsp;": " ", "&sup2;": "²", "&#233;": "é", "&#39;": "'", "&ndash;": "–", "&amp;": "&"}


def decoded(x: str) -> str:
    for name, char in _ENTITIES.items():
        x = f"replace({x}, {text(name)}, {text(char)})"
    return x


def stripped(x: str) -> str:
    return decoded(f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')")


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({stripped(x)}, '(?i)[0-9a-zåäöéèüæø]+'), lambda t: lower(t))"


FITS = f"list_filter({listed(HEADS)}, lambda h: suffix(t, h) AND t <> h AND length(t) - length(h) >= 3)"
HEAD = f"({FITS})[1]"
EXPANDED = f"list_filter([t, {mapped(SINGULARS)}[t], {HEAD}, {mapped(SINGULARS)}[{HEAD}]], lambda x: x IS NOT NULL)"
PREFIX = f"left(t, length(t) - length({HEAD}))"
OWN = f"list_concat({EXPANDED}, list_filter([CASE WHEN {PREFIX} IN ({', '.join(map(text, MODIFIERS))}) THEN {PREFIX} END, {mapped(ENGLISH_HEADS)}[t]], lambda x: x IS NOT NULL))"


def ordered_distinct(x: str) -> str:
    """A list without later repeats, in order of first mention."""
    return f"(WITH l AS (SELECT {x} AS v) SELECT array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i), lambda i: v[i]), ' ') FROM l)"


CATALOG = """
latest AS (SELECT * FROM product_record WHERE product_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY crawled_at DESC, title DESC) = 1),
docs AS (
  SELECT product_id AS doc_id, coalesce(title, '') AS title, coalesce(vendor, '') AS vendor, coalesce(product_type, '') AS product_type,
         coalesce(array_to_string(tags, ' '), '') AS tags, {body} AS body FROM latest)""".format(body=stripped("body_html"))
TITLE_TOKENS = f"WITH {CATALOG}, words AS (SELECT DISTINCT unnest({tokens('title')}) AS t FROM docs)"
WEIGHTS = {"title": 5, "vendor": 4, "product_type": 3, "tags": 2, "body": 1}
LONG = f"long AS (SELECT doc_id, field, {tokens('value')} AS own FROM (UNPIVOT docs ON title, vendor, product_type, tags, body INTO NAME field VALUE value))"
WORD = f"word AS (SELECT t, {EXPANDED} AS parts FROM (SELECT DISTINCT unnest(own) AS t FROM long))"


def index(compound: bool, name: str = "") -> str:
    """CTEs postings, stats and dfs, with ``name`` behind each."""
    # a word's parts repeat where its singular is its head's, so each counts once
    source = f"SELECT doc_id, field, unnest(list_distinct(parts)) AS term FROM (SELECT doc_id, field, unnest(own) AS t FROM long) JOIN word USING (t)" if compound else "SELECT doc_id, field, unnest(own) AS term FROM long"
    return f"""
entries{name} AS ({source}),
postings{name} AS (SELECT doc_id, field, term, count(*)::DOUBLE AS tf FROM entries{name} GROUP BY ALL),
lengths{name} AS (SELECT l.doc_id, l.field, coalesce(n, 0)::DOUBLE AS dl FROM long l LEFT JOIN (SELECT doc_id, field, count(*) AS n FROM entries{name} GROUP BY ALL) USING (doc_id, field)),
stats{name} AS (SELECT field, count(*)::DOUBLE AS n, sum(dl) / count(*) AS avgdl, CASE field {' '.join(f"WHEN '{f}' THEN {w}" for f, w in WEIGHTS.items())} END::DOUBLE AS weight FROM lengths{name} GROUP BY field),
dfs{name} AS (SELECT field, term, count(*)::DOUBLE AS df FROM postings{name} GROUP BY ALL)"""


ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({text(q['id'])}, {text(q['query'])}, {text(q['stratum'])})" for q in QUERIES) + ") v(query_id, query, stratum))"
PLAIN_TERMS = f"terms_plain AS (SELECT DISTINCT query_id, unnest({tokens('query')}) AS term FROM asked)"
COMPOUND_TERMS = f"terms_compound AS (SELECT DISTINCT query_id, unnest({EXPANDED}) AS term FROM (SELECT query_id, unnest({tokens('query')}) AS t FROM asked))"
VOCABULARY = f"vocabulary AS (SELECT DISTINCT unnest({tokens('vendor')}) AS v FROM docs)"
BUDGET = "CASE WHEN length(t) < 5 THEN 0 WHEN length(t) < 8 THEN 1 ELSE 2 END"


def letters(x: str) -> str:
    """A token with each letter beyond ASCII, of the alphabet of tokens, as one capital: distances count bytes."""
    return f"translate({x}, 'åäöéèüæø', 'ABCDEFGH')"


def fixes(source: str) -> str:
    near = f"levenshtein({letters('t')}, {letters('v')})"
    return f"""
open_words AS (SELECT DISTINCT t, {BUDGET} AS budget FROM {source} WHERE t NOT IN (SELECT v FROM vocabulary)),
near AS (SELECT t, v, {near} AS d FROM open_words JOIN vocabulary ON abs(length(t) - length(v)) <= budget WHERE budget > 0 AND {near} <= budget),
fixes AS (SELECT t, min(v) AS v FROM near n WHERE d = (SELECT min(d) FROM near m WHERE m.t = n.t) GROUP BY t HAVING count(*) = 1)"""


LEX_TERMS = f"""{VOCABULARY}, qwords AS (SELECT query_id, unnest(own) AS t, generate_subscripts(own, 1) AS pos FROM (SELECT query_id, {tokens('query')} AS own FROM asked)),
{fixes('qwords')},
expanded AS (SELECT query_id, pos, CASE WHEN f.v IS NULL THEN own ELSE list_append(own, f.v) END AS own FROM (SELECT query_id, pos, t, {OWN} AS own FROM qwords) q LEFT JOIN fixes f USING (t)),
terms_lex AS (SELECT DISTINCT query_id, unnest(own) AS term FROM expanded)"""


def ranked(name: str, terms: str, system: str, k: int = 20, coord: bool = False, indexed: str = "") -> str:
    factor = "* count(DISTINCT term) / any_value(n_terms)" if coord else ""
    return f"""
{name}_scores AS (
  SELECT query_id, doc_id, round(sum(weight * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) {factor}, 9) AS score
  FROM {terms} JOIN (SELECT query_id, count(*)::DOUBLE AS n_terms FROM {terms} GROUP BY query_id) USING (query_id) JOIN postings{indexed} USING (term) JOIN dfs{indexed} USING (field, term) JOIN stats{indexed} USING (field) JOIN lengths{indexed} USING (doc_id, field)
  GROUP BY query_id, doc_id),
{name} AS (SELECT {text(system)} AS system, query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id AS product_id, score FROM {name}_scores WHERE score > 0 QUALIFY rank <= {k})"""


def grade(rule: dict) -> str:
    method = rule["method"]
    fold = lambda x: f"replace(lower(coalesce({x}, '')), 'ß', 'ss')"
    small = lambda w: text(w.lower().replace("ß", "ss"))
    if method == "none":
        return "0"
    if method == "vendor_equals":
        return f"CASE WHEN {fold('vendor')} = {small(rule['vendor'])} THEN {rule['grade']} ELSE 0 END"
    if method == "product_type":
        return "CASE product_type " + " ".join(f"WHEN {text(t)} THEN {g}" for t, g in rule["grades"].items()) + " ELSE 0 END"
    if method == "tag_equals":
        return f"CASE WHEN list_contains(list_transform(coalesce(tags, []), lambda x: {fold('x')}), {small(rule['tag'])}) THEN {rule['grade']} ELSE 0 END"
    if method == "title_any":
        return "CASE WHEN " + " OR ".join(f"contains({fold('title')}, {small(w)})" for w in rule["tokens"]) + f" THEN {rule['grade']} ELSE 0 END"
    parts = [grade(p) for p in rule["parts"]]
    missing = " OR ".join(f"({g}) = 0" for g, p in zip(parts, rule["parts"]) if p.get("required")) or "false"
    total = " + ".join(f"({g})" for g in parts)
    return f"CASE WHEN {missing} THEN 0 ELSE {f'least({total}, {rule['max']})' if 'max' in rule else total} END"


QRELS = "qrels AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {text(q['id'])} AS query_id, product_id, CAST({grade(q['relevance'])} AS INTEGER) AS grade FROM latest" for q in QUERIES) + ") WHERE grade > 0)"
GAIN = "(pow(2, grade) - 1) / log2({0} + 1)"
RUNS = f"{LONG}, {WORD}, {index(False)}, {index(True, '_c')}, {ASKED}, {PLAIN_TERMS}, {COMPOUND_TERMS}, {LEX_TERMS}, {ranked('r1', 'terms_plain', 'bm25')}, {ranked('r2', 'terms_compound', 'bm25-compound', indexed='_c')}, {ranked('r3', 'terms_lex', 'bm25-lex', coord=True, indexed='_c')}"
SCORED = f"""{RUNS}, {QRELS}, runs AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3),
ideal AS (SELECT query_id, sum(CASE WHEN rn <= 10 THEN {GAIN.format('rn')} ELSE 0 END) AS ideal, count(*) FILTER (grade >= 2) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS rn FROM qrels) GROUP BY query_id),
got AS (SELECT system, query_id, sum(CASE WHEN rank <= 10 THEN {GAIN.format('rank')} ELSE 0 END) AS dcg, count(*) FILTER (rank <= 10 AND grade >= 2) AS hits, count(*) AS returned FROM (SELECT runs.*, coalesce(q.grade, 0) AS grade FROM runs LEFT JOIN qrels q USING (query_id, product_id)) GROUP BY ALL),
scored AS (
  SELECT s.system, a.query_id, a.stratum, coalesce(g.dcg / nullif(i.ideal, 0), 0) AS ndcg, coalesce(g.hits, 0) / 10.0::DOUBLE AS precision, coalesce(g.returned, 0) AS returned, coalesce(i.relevant, 0) AS relevant
  FROM (SELECT unnest({listed(SYSTEMS)}) AS system) s CROSS JOIN asked a LEFT JOIN got g ON g.system = s.system AND g.query_id = a.query_id LEFT JOIN ideal i ON i.query_id = a.query_id)"""
BASE = f"WITH {CATALOG}, "
RUN_OUT = "SELECT query_id, rank, product_id, round(score, 6) AS score FROM {0}"

SQL = {
    "tokenize_count": f"{BASE} own AS (SELECT doc_id, {tokens('body')} AS t FROM docs) SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM own",
    "strip_html_text": f"WITH {CATALOG} SELECT doc_id, md5(body) AS body_md5 FROM docs",
    "term_df": f"{BASE}{LONG}, {index(False)} SELECT field, term, CAST(df AS BIGINT) AS df FROM dfs",
    "doc_len_stats": f"{BASE}{LONG}, {WORD}, {index(True)} SELECT field, CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, weight FROM stats",
    "bm25_topk_single": f"""{BASE} own AS (SELECT doc_id, unnest({tokens('title')}) AS term FROM docs), lens AS (SELECT doc_id, len({tokens('title')})::DOUBLE AS dl FROM docs),
        st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM lens), p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM own WHERE term IN ('tegelröd', 'väska') GROUP BY ALL), d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
        s AS (SELECT doc_id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM p JOIN d USING (term) JOIN lens USING (doc_id), st GROUP BY doc_id)
        SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
    "bm25_fielded": f"{BASE}{RUNS} {RUN_OUT.format('r1')}",
    "bm25_compound": f"{BASE}{RUNS} {RUN_OUT.format('r2')}",
    "bm25_lex": f"{BASE}{RUNS} {RUN_OUT.format('r3')}",
    "compound_split": f"{TITLE_TOKENS} SELECT t AS token, {PREFIX} AS prefix, {HEAD} AS head FROM words WHERE {HEAD} IS NOT NULL",
    "compound_expand": f"{TITLE_TOKENS} SELECT t AS token, {ordered_distinct(EXPANDED)} AS expanded FROM words",
    "query_expand": f"{TITLE_TOKENS} SELECT t AS token, {ordered_distinct(OWN)} AS expanded FROM words",
    "vendor_fuzzy_unique": f"{TITLE_TOKENS}, {VOCABULARY}, {fixes('words')} SELECT t AS token, v AS corrected FROM fixes",
    "lexicon_terms": f"{BASE}{ASKED}, {LEX_TERMS}, whole AS (SELECT query_id, flatten(list(own ORDER BY pos)) AS v FROM expanded GROUP BY query_id) SELECT query_id, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i), lambda i: v[i]), ' ') AS terms FROM whole",
    "qrels": f"{BASE}{QRELS} SELECT query_id, product_id, grade FROM qrels",
    "dcg_at_10": f"{BASE}{SCORED} SELECT query_id, round(dcg, 6) AS dcg FROM got WHERE system = 'bm25'",
    "score_per_query": f"{BASE}{SCORED} SELECT system, query_id, stratum, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision, returned, relevant FROM scored",
    "score_by_system": f"{BASE}{SCORED} SELECT system, round(avg(ndcg), 6) AS ndcg, round(avg(precision), 6) AS precision, round(avg(ndcg) FILTER (stratum <> 'adversarial/absent'), 6) AS answerable_ndcg, CAST(coalesce(sum(returned) FILTER (stratum = 'adversarial/absent'), 0) AS BIGINT) AS absent_returned FROM scored GROUP BY system",
    "score_by_stratum": f"{BASE}{SCORED} SELECT system, stratum, round(avg(ndcg), 6) AS ndcg FROM scored GROUP BY ALL",
    "scorecard_pivot": f"{BASE}{SCORED} SELECT list_position({listed(STRATA)}, stratum)::BIGINT AS position, stratum, " + ", ".join(f"round(avg(ndcg) FILTER (system = {text(s)}), 6) AS {s.replace('-', '_')}" for s in SYSTEMS) + " FROM scored GROUP BY stratum",
    "html_rank_parse": """WITH d AS (SELECT DISTINCT concat_ws('/', store, coalesce(feed_id, ''), page::VARCHAR) AS page, product_id, handle FROM product_record WHERE handle IS NOT NULL AND page IS NOT NULL),
        n AS (SELECT page, handle, row_number() OVER (PARTITION BY page ORDER BY product_id, handle) AS at_ FROM d)
        SELECT page, row_number() OVER (PARTITION BY page ORDER BY at_) AS rank, lower(regexp_extract(handle, '^[^/?#"'']+')) AS handle FROM n""",
    "score_query_table": f"{BASE}{SCORED} SELECT s.query_id, a.query, s.stratum, " + ", ".join(f"round(max(ndcg) FILTER (system = {text(s)}), 6) AS {s.replace('-', '_')}" for s in SYSTEMS) + " FROM scored s JOIN asked a USING (query_id) GROUP BY ALL",
    "example_results": f"{BASE}{SCORED} SELECT r.system, r.query_id, r.rank, r.product_id, coalesce(l.title, '') AS title, CAST(coalesce(q.grade, 0) AS INTEGER) AS grade FROM runs r JOIN latest l USING (product_id) LEFT JOIN qrels q USING (query_id, product_id) WHERE r.rank <= 10",
    "lexicon_spec": f"WITH {CATALOG}, {VOCABULARY} SELECT {len(MODIFIERS)}::BIGINT AS modifiers, {len(ENGLISH_HEADS)}::BIGINT AS english_heads, count(*) AS vendor_tokens FROM vocabulary",
    "native_overlap": f"WITH {CATALOG}, d AS (SELECT handle, ('0x' || left(md5(product_id), 2))::INTEGER AS digit FROM latest WHERE handle IS NOT NULL) SELECT count(*) FILTER (digit % 5 <> 0) AS mapped, count(*) FILTER (digit % 5 = 0) AS unmapped FROM d",
}

_SEP = "chr(31)"


def _hash(*columns: str) -> str:
    return "sha256(" + f" || {_SEP} || ".join(f"coalesce({c}, '')" for c in columns) + ")"


def crawl(source: str, name: str) -> str:
    tags, prices = "array_to_string(coalesce(tags, []), ',')", "coalesce(array_to_string(list_transform(prices, lambda p: coalesce(p, '')), ','), '')"
    search = ("title", "vendor", "product_type", "body_html", tags)
    return f"{name} AS (SELECT product_id, vendor, {_hash(*search, prices)} AS s, {_hash(*search)} AS e FROM {source})"


TWO = f"""WITH {CATALOG}, {crawl('latest', 'one')},
changed AS (SELECT CASE WHEN left(md5(product_id), 1) = '3' THEN 'n' || product_id ELSE product_id END AS product_id, CASE WHEN left(md5(product_id), 1) = '1' THEN coalesce(title, '') || ' (ny)' ELSE title END AS title,
  vendor, product_type, body_html, tags, CASE WHEN left(md5(product_id), 1) IN ('1', '2') THEN ['1.00'] ELSE prices END AS prices FROM latest WHERE left(md5(product_id), 1) <> '0'),
{crawl('changed', 'two')},
merged AS (SELECT coalesce(a.product_id, b.product_id) AS product_id, a.s AS sa, a.e AS ea, b.s AS sb, b.e AS eb, CASE WHEN b.s IS NULL THEN 'disappeared' WHEN a.s IS NULL THEN 'new' WHEN a.e <> b.e THEN 'enrichment_stale' WHEN a.s <> b.s THEN 'source_changed' ELSE 'unchanged' END AS outcome FROM one a FULL JOIN two b USING (product_id))"""
_NOW = ("'2026-01-01T00:00:00Z'", "'2026-01-08T00:00:00Z'")
SQL |= {
    "dup_ids": "SELECT product_id, count(*) AS n FROM product_record WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(*) > 1",
    "manifest_digest": f"{TWO} SELECT count(*) AS n, sha256(string_agg(product_id || chr(0) || s, chr(10) ORDER BY product_id || chr(0) || s)) AS digest FROM one",
    "crawl_diff": f"{TWO} SELECT product_id, CASE WHEN sb IS NULL THEN 'only_first' WHEN sa IS NULL THEN 'only_second' ELSE 'differing' END AS difference FROM merged WHERE sa IS DISTINCT FROM sb",
    "drop_gate": f"{TWO} SELECT vendor, previous, coalesce(n, 0) AS n, coalesce(n, 0) < ceil(previous * 0.9::DOUBLE) AS rejected FROM (SELECT vendor, count(*) AS previous FROM one GROUP BY vendor) LEFT JOIN (SELECT vendor, count(*) AS n FROM two GROUP BY vendor) USING (vendor)",
    "sync_outcomes": f"""{TWO} SELECT 1 AS run, 'new' AS outcome, count(*) AS n FROM one UNION ALL SELECT 1, 'enrichment_jobs', count(DISTINCT e) FROM one UNION ALL SELECT 2, outcome, count(*) FROM merged GROUP BY outcome
        UNION ALL SELECT 2, 'enrichment_jobs', count(DISTINCT eb) FROM merged WHERE outcome IN ('new', 'enrichment_stale') AND eb NOT IN (SELECT e FROM one) HAVING count(*) > 0""",
    "sync_state": f"{TWO} SELECT product_id, CAST(CASE WHEN outcome IN ('enrichment_stale', 'source_changed') THEN 2 ELSE 1 END AS INTEGER) AS current_version, CASE WHEN outcome = 'new' THEN {_NOW[1]} ELSE {_NOW[0]} END AS first_seen, CASE WHEN outcome = 'disappeared' THEN {_NOW[0]} ELSE {_NOW[1]} END AS last_seen, CASE WHEN outcome = 'disappeared' THEN {_NOW[1]} END AS deleted_at FROM merged",
    "sync_versions": f"{TWO} SELECT product_id, 1 AS version, s AS source_payload_hash, e AS enrichment_input_hash, {_NOW[0]} AS created_at FROM one UNION ALL SELECT product_id, CASE WHEN outcome = 'new' THEN 1 ELSE 2 END, sb, eb, {_NOW[1]} FROM merged WHERE outcome IN ('new', 'enrichment_stale', 'source_changed')",
    "enrichment_queue": f"{TWO} SELECT DISTINCT h AS enrichment_input_hash, h AS input_payload FROM (SELECT e AS h FROM one UNION ALL SELECT eb FROM merged WHERE outcome IN ('new', 'enrichment_stale'))",
    "enrichment_links": f"{TWO} SELECT product_id, e AS enrichment_input_hash, {_NOW[0]} AS first_requested FROM one UNION ALL SELECT m.product_id, eb, {_NOW[1]} FROM merged m WHERE outcome IN ('new', 'enrichment_stale')",
    "completed_job": f"""{TWO}, q AS (SELECT h, min(at_) AS created_at FROM (SELECT e AS h, {_NOW[0]} AS at_ FROM one UNION ALL SELECT eb, {_NOW[1]} FROM merged WHERE outcome IN ('new', 'enrichment_stale')) GROUP BY h), f AS (SELECT min(h) AS first FROM q)
        SELECT h AS enrichment_input_hash, CASE WHEN h = first THEN 'completed' ELSE 'pending' END AS status, CASE WHEN h = first THEN '{{"colour": "blå"}}' END AS result, CASE WHEN h = first THEN 'raw' END AS raw_response, created_at, CASE WHEN h = first THEN '2026-01-09T00:00:00Z' END AS completed_at FROM q, f""",
    "verified_crawl": f"{TWO} SELECT 1::INTEGER AS schema_version, count(*) AS n, sha256(string_agg(product_id || chr(0) || s, chr(10) ORDER BY product_id || chr(0) || s)) AS digest FROM one",
    "soft_delete": f"{TWO} SELECT count(*) FILTER (outcome <> 'disappeared') AS live, count(*) FILTER (outcome = 'disappeared') AS deleted FROM merged",
    "pending_jobs": "SELECT DISTINCT enrichment_input_hash, input_payload FROM enrichment_cache WHERE status = 'pending'",
}
