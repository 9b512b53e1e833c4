"""The core queries in DuckDB's SQL, written independently of the operators."""

_TIME = r"""CASE
    WHEN regexp_matches(trim({0}), '^\d{{9,11}}$') THEN make_timestamp(CAST(trim({0}) AS BIGINT) * 1000000)
    WHEN regexp_matches(trim({0}), '^\d{{12,14}}$') THEN make_timestamp(CAST(trim({0}) AS BIGINT) * 1000)
    WHEN regexp_matches(trim({0}), '^\d{{8}}T\d{{6}}Z$') THEN strptime(trim({0}), '%Y%m%dT%H%M%SZ')
    WHEN regexp_matches(trim({0}), '(Z|[+-]\d\d:\d\d)$') THEN CAST(CAST(trim({0}) AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)
    ELSE CAST(trim({0}) AS TIMESTAMP) END"""
_HASH = "regexp_extract(lower({0}), '([0-9a-f]{{64}})$', 1)"


def time(column: str) -> str:
    return _TIME.format(column)


def digest(column: str) -> str:
    return f"nullif({_HASH.format(column)}, '')"


P1 = f"""
WITH state AS (
  SELECT product_id, first_seen, last_seen, deleted_at FROM (
    SELECT product_id, {time('first_seen')} AS first_seen, {time('last_seen')} AS last_seen, {time('deleted_at')} AS deleted_at, current_version FROM product_state)
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY last_seen DESC NULLS LAST, current_version DESC, deleted_at DESC NULLS LAST) = 1),
events AS (
  SELECT DISTINCT v.product_id, {digest('source_payload_hash')} AS a, {digest('enrichment_input_hash')} AS b,
         coalesce({time('created_at')}, s.first_seen, CAST(loaded_at AT TIME ZONE 'UTC' AS TIMESTAMP)) AS ts, version
  FROM product_version v LEFT JOIN state s USING (product_id)),
steps AS (
  SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY product_id ORDER BY ts, version)),
kept AS (SELECT * FROM steps WHERE rn = 1 OR a IS DISTINCT FROM pa OR b IS DISTINCT FROM pb),
spans AS (
  SELECT product_id, CAST(row_number() OVER w AS INTEGER) AS version, ts, lead(ts) OVER w AS until FROM kept WINDOW w AS (PARTITION BY product_id ORDER BY ts, version))
SELECT product_id, version, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS valid_from,
       coalesce(strftime(coalesce(until, CASE WHEN last_seen IS NULL OR deleted_at > last_seen THEN deleted_at END), '%Y-%m-%dT%H:%M:%SZ'), '') AS valid_to
FROM spans LEFT JOIN state USING (product_id)
"""

P5 = f"""
WITH done AS (
  SELECT {digest('enrichment_input_hash')} AS h FROM enrichment_cache
  WHERE lower(trim(status)) = 'completed' AND run_id IN (SELECT run_id FROM enrichment_run WHERE status = 'success')
    AND json_valid(trim(result)) AND trim(result) NOT IN ('', 'null', '{{}}', '[]', '""'))
SELECT DISTINCT {digest('enrichment_input_hash')} AS enrichment_input_hash FROM product_enrichment
WHERE {digest('enrichment_input_hash')} IS NOT NULL AND {digest('enrichment_input_hash')} NOT IN (SELECT h FROM done WHERE h IS NOT NULL)
"""

P7 = f"""
WITH held AS (
  SELECT run_id, product_id, max({digest('source_payload_hash')}) AS a, max({digest('enrichment_input_hash')}) AS b FROM snapshot_entry
  WHERE product_id IS NOT NULL GROUP BY ALL),
crawls AS (
  SELECT run_id, max(feed_id) AS feed_id, max(product_count) AS product_count, max({time('crawled_at')}) AS ts FROM manifest GROUP BY run_id),
counting AS (
  SELECT run_id, feed_id, row_number() OVER (PARTITION BY feed_id ORDER BY ts, run_id) AS seq
  FROM crawls LEFT JOIN (SELECT run_id, count(*) AS n FROM held GROUP BY run_id) USING (run_id) WHERE coalesce(n, 0) = product_count),
filled AS (
  SELECT feed_id, seq, product_id, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b
  FROM held JOIN counting USING (run_id) WINDOW w AS (PARTITION BY feed_id, product_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
pairs AS (
  SELECT coalesce(l.feed_id, r.feed_id) AS feed_id, coalesce(l.seq + 1, r.seq) AS seq, coalesce(l.product_id, r.product_id) AS product_id,
         l.seq AS lseq, r.seq AS rseq, l.a AS la, r.a AS ra, l.b AS lb, r.b AS rb
  FROM filled l FULL JOIN filled r ON l.feed_id = r.feed_id AND l.product_id = r.product_id AND l.seq + 1 = r.seq),
named AS (
  SELECT p.feed_id, c.run_id, product_id, CASE WHEN lseq IS NULL THEN 'added' WHEN rseq IS NULL THEN 'removed' WHEN lb <> rb THEN 'enrichment_stale' WHEN la <> ra THEN 'source_changed' END AS change
  FROM pairs p JOIN counting c ON p.feed_id = c.feed_id AND p.seq = c.seq WHERE p.seq > 1)
SELECT feed_id, run_id, product_id, change FROM named WHERE change IS NOT NULL
"""

SQL = {"p1_found": P1, "p5_found": P5, "p7_found": P7}


def _elements(x: str) -> str:
    """The elements of a JSON list however it is wrapped, as a list of JSON."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN {x}->'$[*]' WHEN 'OBJECT' THEN CASE WHEN json_type({x}->'edges') = 'ARRAY' THEN {x}->'$.edges[*].node' ELSE [{x}] END ELSE [] END"


def _opened(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' THEN TRY_CAST({x}->>'$' AS JSON) ELSE {x} END"


_DIGITS = r"list_last(regexp_extract_all({0}, '\d+'))"
P3 = f"""
WITH payloads AS (
  SELECT product_id, CASE WHEN source_payload IS NULL THEN to_json({{'variants': variants, 'options': options, 'images': images}}) WHEN json_valid(source_payload) THEN CAST(source_payload AS JSON) END AS p FROM product_record),
records AS (SELECT product_id, CASE WHEN json_type(p->'product') = 'OBJECT' THEN p->'product' WHEN json_type(p->'products') = 'ARRAY' THEN p->'$.products[0]' ELSE p END AS r FROM payloads),
fields AS (SELECT product_id, {_opened("r->'variants'")} AS v, {_opened("r->'options'")} AS o, {_opened("r->'images'")} AS i FROM records),
variants AS (SELECT product_id, {_DIGITS.format("v->>'id'")} AS id, v->'inventory' AS inv FROM (SELECT product_id, unnest({_elements('v')}) AS v FROM fields)),
options AS (SELECT product_id, o->>'name' AS name, o->'values' AS vals FROM (SELECT product_id, unnest({_elements('o')}) AS o FROM fields)),
images AS (SELECT product_id, i->>'src' AS src, i->'variant_ids' AS ids FROM (SELECT product_id, unnest({_elements('i')}) AS i FROM fields)),
found AS (
  SELECT product_id, 'variant' AS child_kind, product_id AS parent_key, id AS child_key FROM variants
  UNION ALL SELECT product_id, 'option', product_id, name FROM options
  UNION ALL SELECT product_id, 'option_value', name, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'label' ELSE x->>'$' END FROM (SELECT product_id, name, unnest({_elements('vals')}) AS x FROM options)
  UNION ALL SELECT product_id, 'image', product_id, src FROM images
  UNION ALL SELECT product_id, 'image_variant', src, {_DIGITS.format("x->>'$'")} FROM (SELECT product_id, src, unnest({_elements('ids')}) AS x FROM images)
  UNION ALL SELECT product_id, 'level', id, unnest(CASE WHEN json_type(inv->'levels') = 'ARRAY' THEN inv->>'$.levels[*].location' WHEN json_type(inv) = 'OBJECT' THEN json_keys(inv) ELSE [] END) FROM variants)
SELECT DISTINCT product_id, child_kind, parent_key, child_key FROM found WHERE product_id IS NOT NULL AND parent_key IS NOT NULL AND child_key IS NOT NULL
"""
SQL["p3_found"] = P3
