"""Queries on sources, evidence, coverage and the frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions.text import extract_ids, has_birth_number, has_full_birth_date, has_local_path
from attestra.operators import coverage as V
from attestra.operators import evidence as E
from attestra.operators import refs as R
from attestra.operators import sources as S
from attestra.operators.extract import flatten_records
from attestra.plans import evidence_inputs as I
from attestra.plans.inputs import cte, table, with_ctes
from attestra.plans.registry import query

joined = lambda c: F.array_join(c, ",")
big = lambda n, out=None: F.col(n).cast("bigint").alias(out or n)


def citing(spark, sf):
    con = I.contradictions(spark, sf).select("id", F.array_compact(F.array("source_a", "source_b")).alias("sources"))
    return [("claims", I.doc_claims(spark, sf), "id", "sources"), ("edges", I.edges(spark, sf), "id", "sources"), ("contradictions", con, "id", "sources")]


cte("citing", """SELECT 'claims' AS kind, id AS ref_id, unnest(sources) AS source_id FROM doc_claims UNION ALL SELECT 'edges', id, unnest(sources) FROM edges
  UNION SELECT 'contradictions', id, unnest(list_filter([source_a, source_b], lambda x: x IS NOT NULL)) FROM contradictions""", ["doc_claims", "edges", "contradictions"])


@query("J4_lineage", with_ctes("doc_claims doc_sources", """
SELECT c.id, c.status, (c.p - 1)::BIGINT AS pos, c.sid AS source_id, coalesce(s.cls, 'other') AS source_class, s.title, s.tier::BIGINT AS tier, s.retrieved AS "retrievedAt", coalesce(s.filed, false) AS primary_filed
FROM (SELECT id, status, unnest(sources) AS sid, generate_subscripts(sources, 1) AS p FROM doc_claims) c LEFT JOIN doc_sources s ON s.id = c.sid"""))
def _(spark, sf):
    r = S.lineage(I.doc_claims(spark, sf), I.doc_sources(spark, sf))
    return r.withColumn("tier", F.col("tier").cast("bigint")).withColumn("pos", F.col("pos").cast("bigint"))


@query("J5_usage", with_ctes("citing doc_sources", "SELECT DISTINCT kind, ref_id, source_id FROM citing WHERE source_id IN (SELECT id FROM doc_sources)"))
def _(spark, sf):
    return R.usage(I.doc_sources(spark, sf), citing(spark, sf))


@query("J6_orphan_refs", with_ctes("doc_claims doc_sources", """
SELECT id, sid AS ref FROM (SELECT id, unnest(sources) AS sid FROM doc_claims) WHERE sid NOT IN (SELECT id FROM doc_sources)"""))
def _(spark, sf):
    return R.orphan_refs(I.doc_claims(spark, sf), "id", "sources", I.doc_sources(spark, sf))


@query("J7_supersession_links", with_ctes("doc_claims", """
SELECT c.id AS claim_id, c.s AS successor_id, k.id IS NULL AS dangling FROM (SELECT id, unnest(successors) AS s FROM doc_claims) c LEFT JOIN doc_claims k ON k.id = c.s"""))
def _(spark, sf):
    return S.supersession_links(I.doc_claims(spark, sf))


@query("U1_flatten_records", with_ctes("identity edges doc_claims financials media", """
SELECT 'identity' AS kind, id, status, array_to_string(sources, ',') AS sources, NULL AS cat FROM identity UNION ALL SELECT 'edge', id, status, array_to_string(sources, ','), cat FROM edges
UNION ALL SELECT 'claim', id, status, array_to_string(sources, ','), NULL FROM doc_claims UNION ALL SELECT 'financials', id, status, array_to_string(sources, ','), NULL FROM financials
UNION ALL SELECT 'media', id, status, array_to_string(sources, ','), NULL FROM media"""))
def _(spark, sf):
    return flat(spark, sf).select("kind", "id", "status", joined("sources").alias("sources"), "cat")


def flat(spark, sf):
    return flatten_records([("identity", I.identity(spark, sf)), ("edge", I.edges(spark, sf)), ("claim", I.doc_claims(spark, sf)),
                            ("financials", I.financials(spark, sf)), ("media", I.media(spark, sf))])


@query("U4_known_refs", with_ctes("doc_claims doc_sources contradictions hypotheses", """
SELECT 'claim' AS space, id FROM doc_claims UNION SELECT 'source', id FROM doc_sources UNION SELECT 'contradiction', id FROM contradictions UNION SELECT 'hypothesis', id FROM hypotheses"""))
def _(spark, sf):
    return known(spark, sf)


def known(spark, sf):
    return R.known_refs([("claim", I.doc_claims(spark, sf), "id"), ("source", I.doc_sources(spark, sf), "id"),
                         ("contradiction", I.contradictions(spark, sf), "id"), ("hypothesis", I.hypotheses(spark, sf), "id")])


cte("diversity", """
  SELECT c.id, c.status, c.materiality, count(c.sid) AS source_records, count(DISTINCT coalesce(s.upstream, 'unknown')) FILTER (c.sid IS NOT NULL) AS ups,
    count(*) FILTER (s.class = 'primary_registry_document') AS primary_direct_count,
    count(c.sid) > 0 AND bool_and(coalesce(s.upstream = 'up2', false)) AS company_only, string_agg(DISTINCT coalesce(s.upstream, 'unknown'), ',' ORDER BY coalesce(s.upstream, 'unknown')) FILTER (c.sid IS NOT NULL) AS upstreams
  FROM (SELECT id, status, CASE WHEN regexp_matches(lower(text), 'revenue|financ|net result|assets|equity|liabilit|acquir|shareholder|ownership|exekuc|insolven|jednatel|owner') THEN 'high'
        WHEN regexp_matches(lower(text), 'client|contract|tender|role|director|board|invest') THEN 'moderate' ELSE 'low' END AS materiality,
        unnest(CASE WHEN len(sources) = 0 THEN [NULL] ELSE sources END) AS sid FROM doc_claims) c LEFT JOIN doc_sources s ON s.id = c.sid GROUP BY ALL""", ["doc_claims", "doc_sources"])


@query("A3_source_diversity", with_ctes("diversity", """
SELECT id, status, materiality, source_records, ups AS independent_upstreams, coalesce(upstreams, '') AS upstreams, primary_direct_count, company_only AS company_controlled_only, ups <= 1 AS monoculture,
  CASE WHEN ups <= 1 AND status = 'CORROBORATED' THEN 'several records of one authority' WHEN company_only THEN 'first-party source only' END AS note FROM diversity"""))
def _(spark, sf):
    r = diversity(spark, sf)
    return r.withColumn("upstreams", joined("upstreams")).withColumn("independent_upstreams", F.col("independent_upstreams").cast("bigint"))


def diversity(spark, sf):
    return S.source_diversity(I.doc_claims(spark, sf), I.source_model(spark, sf), I.CONTROLLED)


@query("A4_independent_families", with_ctes("doc_claims doc_sources", """
SELECT c.id AS claim_id, count(DISTINCT coalesce(s.family, c.sid)) AS independent_families FROM (SELECT id, unnest(sources) AS sid FROM doc_claims) c LEFT JOIN doc_sources s ON s.id = c.sid GROUP BY c.id"""))
def _(spark, sf):
    cited = I.doc_claims(spark, sf).select(F.col("id").alias("claim_id"), F.explode("sources").alias("source_id"))
    return S.independent_families(cited, I.families(spark, sf))


cte("resolved", """SELECT l.claim_id, l.link_no, l.space, l.id, k.id IS NOT NULL AS resolved FROM (
  SELECT claim_id, link_no, unnest(['claim', 'source', 'span', 'web_span', 'selector', 'artifact']) AS space, unnest([claim_id, sid, span, wspan, sel, atag]) AS id FROM links) l
  LEFT JOIN (SELECT 'claim' AS space, id FROM doc_claims UNION SELECT 'source', id FROM doc_sources UNION SELECT 'span', id FROM spans UNION SELECT 'web_span', id FROM web_spans
    UNION SELECT 'selector', id FROM selhits UNION SELECT 'artifact', tag FROM artifacts) k ON k.space = l.space AND k.id = l.id WHERE l.id IS NOT NULL""",
    ["links", "doc_claims", "doc_sources", "spans", "web_spans", "selhits", "artifacts"])
cte("selhits", "SELECT DISTINCT s.id FROM (SELECT id, entity, unnest(predicates) AS p FROM selectors) s JOIN assertions a ON a.entity = s.entity AND a.predicate = s.p", ["selectors", "assertions"])


def dictionary(spark, sf):
    hits = E.selector_counts(I.selectors(spark, sf), I.assertions(spark, sf)).filter("matches > 0")
    return R.known_refs([("claim", I.doc_claims(spark, sf), "id"), ("source", I.doc_sources(spark, sf), "id"), ("span", I.spans(spark, sf), "id"),
                         ("web_span", I.web_spans(spark, sf), "id"), ("selector", hits, "selector_id"), ("artifact", I.artifacts(spark, sf), "tag")])


@query("J2_resolve_selectors", with_ctes("selectors assertions", """
SELECT s.id AS selector_id, a.id AS assertion_id FROM (SELECT id, entity, unnest(predicates) AS p FROM selectors) s JOIN assertions a ON a.entity = s.entity AND a.predicate = s.p
UNION ALL SELECT id, NULL FROM selectors s WHERE NOT EXISTS (SELECT 1 FROM assertions a WHERE a.entity = s.entity AND list_contains(s.predicates, a.predicate))"""))
def _(spark, sf):
    return E.resolve_selectors(I.selectors(spark, sf), I.assertions(spark, sf))


@query("J2_selector_bridge", with_ctes("selectors", "SELECT DISTINCT id AS selector_id, entity, unnest(predicates) AS predicate FROM selectors"))
def _(spark, sf):
    return E.selector_bridge(I.selectors(spark, sf))


@query("J2_selector_counts", with_ctes("selectors assertions", """
SELECT s.id AS selector_id, (SELECT count(*) FROM assertions a WHERE a.entity = s.entity AND list_contains(s.predicates, a.predicate)) AS matches FROM selectors s"""))
def _(spark, sf):
    return E.selector_counts(I.selectors(spark, sf), I.assertions(spark, sf))


@query("J3_resolve_links", with_ctes("resolved", "SELECT claim_id, link_no::BIGINT AS link_no, space, id, resolved FROM resolved"))
def _(spark, sf):
    return E.resolve_links(I.links(spark, sf), dictionary(spark, sf)).withColumn("link_no", F.col("link_no").cast("bigint"))


def inventory_links(spark, sf):
    """Links with what they resolved to."""
    ok = E.resolve_links(I.links(spark, sf), dictionary(spark, sf)).filter("resolved")
    per = ok.groupBy("claim_id", "link_no").agg(
        *[F.max(F.when(F.col("space") == s, F.col("id"))).alias(n)
          for s, n in (("source", "source_id"), ("span", "span_id"), ("web_span", "web_span_id"), ("selector", "selector_id"), ("artifact", "artifact_id"))])
    return per.withColumn("has_assertions", F.col("selector_id").isNotNull())


def inventory(spark, sf):
    primary = I.doc_sources(spark, sf).filter("n % 6 = 0").select(F.col("id").alias("source_id"))
    return E.evidence_inventory(I.doc_claims(spark, sf), inventory_links(spark, sf), primary, I.families(spark, sf))


cte("inventory", """
  SELECT c.id AS claim_id, c.status, coalesce(x.n, 0) AS sources, coalesce(x.fam, 0) AS independent_families, coalesce(x.prim, 0) AS primary_sources, coalesce(l.exact, false) AS exact_citation, coalesce(l.stored, false) AS artifact_preserved
  FROM doc_claims c LEFT JOIN (SELECT claim_id, bool_or(space IN ('span', 'web_span', 'selector')) AS exact, bool_or(space IN ('artifact', 'selector', 'span')) AS stored FROM resolved WHERE resolved GROUP BY claim_id) l ON l.claim_id = c.id
  LEFT JOIN (SELECT id, count(*) AS n, count(DISTINCT coalesce(family, sid)) AS fam, count(*) FILTER (is_primary) AS prim FROM (SELECT DISTINCT q.id, q.sid, s.family, s.is_primary FROM
     (SELECT id, unnest(sources) AS sid FROM doc_claims UNION SELECT claim_id, id FROM resolved WHERE resolved AND space = 'source') q LEFT JOIN doc_sources s ON s.id = q.sid) GROUP BY id) x ON x.id = c.id
  WHERE NOT c.superseded""", ["doc_claims", "resolved", "doc_sources"])
CATEGORY = """CASE WHEN status = 'BLOCKED' THEN 'BLOCKED' WHEN exact_citation AND artifact_preserved AND (primary_sources > 0 OR status = 'SELF_REPORTED') THEN 'COMPLETE' WHEN artifact_preserved THEN 'PARTIAL' ELSE 'REFERENCE_ONLY' END"""


@query("A5_evidence_inventory", with_ctes("inventory", f"SELECT *, {CATEGORY} AS category, CASE WHEN status = 'ASSESSED' THEN 'assessment' ELSE 'observation' END AS kind FROM inventory"))
def _(spark, sf):
    return inventory(spark, sf)


@query("E21_evidence_items", with_ctes("inventory resolved", f"""
SELECT i.claim_id, {CATEGORY} AS category, coalesce(l.refs, '') AS links FROM inventory i LEFT JOIN (SELECT claim_id, string_agg(id, ',' ORDER BY id) AS refs FROM resolved WHERE resolved AND space <> 'claim' AND space <> 'selector' GROUP BY claim_id) l USING (claim_id)"""))
def _(spark, sf):
    r = E.evidence_items(inventory(spark, sf), inventory_links(spark, sf))
    ids = F.flatten(F.transform("links", lambda x: F.array_compact(F.array(x["source_id"], x["span_id"], x["web_span_id"], x["artifact_id"]))))
    return r.select("claim_id", "category", F.coalesce(joined(F.array_sort(ids)), F.lit("")).alias("links"))


@query("E21_evidence_rows", with_ctes("inventory resolved", f"""
, l AS (SELECT claim_id, id FROM resolved WHERE resolved AND space <> 'claim' AND space <> 'selector')
SELECT i.claim_id, {CATEGORY} AS category, l.id AS ref, count(*) AS n FROM inventory i LEFT JOIN l USING (claim_id) GROUP BY ALL"""))
def _(spark, sf):
    r = E.evidence_item_rows(inventory(spark, sf), inventory_links(spark, sf))
    ids = F.array_compact(F.array("source_id", "span_id", "web_span_id", "artifact_id"))
    refs = r.select("claim_id", "category", F.explode_outer(ids).alias("ref"))
    # a link without resolved parts is no reference; a claim without references keeps one row
    known = refs.filter("ref IS NOT NULL").groupBy("claim_id", "category", "ref").agg(F.count(F.lit(1)).alias("n"))
    bare = r.select("claim_id", "category").distinct().join(known.select("claim_id").distinct(), "claim_id", "left_anti")
    return known.unionByName(bare.select("claim_id", "category", F.lit(None).cast("string").alias("ref"), F.lit(1).cast("bigint").alias("n")))


@query("E20_verify_citations", with_ctes("spans", """
, p AS (SELECT id, file, line, lines, trim(regexp_replace(exact_text, '\\s+', ' ', 'g')) AS want, trim(regexp_replace(coalesce(lines[line], ''), '\\s+', ' ', 'g')) AS here FROM spans),
w AS (SELECT *, contains(here, want) OR (contains(want, here) AND length(here) > 10) AS exact,
  len(list_filter(lines[greatest(line - 3, 1):line + 3], lambda x: contains(trim(regexp_replace(x, '\\s+', ' ', 'g')), want))) > 0 AS near FROM p)
SELECT id, file, line::BIGINT AS line, CASE WHEN exact THEN 'exact' WHEN near THEN 'window' ELSE 'not found' END AS match, exact OR near AS verified FROM w"""))
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("body"))
    return E.verify_citations(I.spans(spark, sf), docs).withColumn("line", F.col("line").cast("bigint"))


@query("E20_verify_quotes", with_ctes("web_spans", """
SELECT id, artifact_tag, len(quotes)::BIGINT AS quotes, len(list_filter(quotes, lambda q: NOT contains(body, q)))::BIGINT AS missing, len(list_filter(quotes, lambda q: NOT contains(body, q))) = 0 AS verified FROM web_spans"""))
def _(spark, sf):
    bodies = table(spark, sf, "documents").select(F.concat(F.lit("tag-"), "doc_id").alias("artifact_tag"), F.col("text").alias("body"))
    r = E.verify_quotes(I.web_spans(spark, sf), bodies)
    return r.withColumn("quotes", F.col("quotes").cast("bigint")).withColumn("missing", F.col("missing").cast("bigint"))


@query("S4_text_lines", """
SELECT doc_id, generate_subscripts(l, 1)::BIGINT AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def _(spark, sf):
    return E.text_lines(table(spark, sf, "documents"), "doc_id", "text").withColumn("line", F.col("line").cast("bigint"))


@query("W8_line_matches", with_ctes("spans", """
SELECT id, l.line::BIGINT AS line FROM spans s, LATERAL (SELECT generate_subscripts(s.lines, 1) AS line, unnest(s.lines) AS text) l
WHERE l.line BETWEEN s.line - 3 AND s.line + 3 AND contains(trim(regexp_replace(l.text, '\\s+', ' ', 'g')), trim(regexp_replace(s.exact_text, '\\s+', ' ', 'g')))"""))
def _(spark, sf):
    from attestra.functions.text import collapse

    lines = E.text_lines(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("line", "at")
    s = I.spans(spark, sf)
    near = s.select("id", "exact_text", F.col("file").alias("doc_id"), F.explode(F.sequence(F.col("line") - 3, F.col("line") + 3)).alias("at"))
    hit = near.join(lines, ["doc_id", "at"]).filter(collapse(F.col("text")).contains(collapse(F.col("exact_text"))))
    return hit.select("id", big("at", "line"))


@query("A7_availability", with_ctes("runs", """
SELECT url, source_id, finished_at AS last_checked, http_status::BIGINT AS http_status, outcome, CASE outcome WHEN 'ok' THEN 'AVAILABLE' WHEN 'provider_error' THEN 'BLOCKED' WHEN 'http_error' THEN 'INVALID' ELSE 'UNKNOWN' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY finished_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1"""))
def _(spark, sf):
    return E.availability(I.runs(spark, sf)).withColumn("http_status", F.col("http_status").cast("bigint"))


STATE_SQL = """SELECT source_id, max(finished_at) AS last_attempt, max(finished_at) FILTER (outcome = 'ok') AS last_success, max(finished_at) FILTER (outcome <> 'ok') AS last_failure,
  count(*) FILTER (outcome <> 'ok') AS failed_attempts, arg_max(CASE WHEN coalesce(http_status, 0) >= 500 THEN 'PROVIDER_ERROR' ELSE 'BLOCKED' END, finished_at || run_id) FILTER (outcome <> 'ok') AS fs FROM runs GROUP BY source_id"""
cte("provider_state", f"""SELECT source_id, last_attempt, last_success, last_failure, failed_attempts,
  CASE WHEN last_failure IS NOT NULL AND (last_success IS NULL OR last_failure > last_success) THEN fs WHEN last_success IS NOT NULL THEN 'AVAILABLE' ELSE 'UNKNOWN' END AS state FROM ({STATE_SQL})""", ["runs"])


@query("A8_provider_state", with_ctes("provider_state", "SELECT * FROM provider_state"))
def _(spark, sf):
    return E.provider_state(I.runs(spark, sf))


@query("A9_latest_per_key", with_ctes("runs", """
SELECT entity, tag, run_id, finished_at, outcome FROM (SELECT *, row_number() OVER (PARTITION BY entity, tag ORDER BY finished_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1"""))
def _(spark, sf):
    r = I.runs(spark, sf).select("entity", "tag", "run_id", "finished_at", "outcome")
    return R.latest_per_key(r, ["entity", "tag"], ["finished_at", "run_id"])


@query("R5_consecutive_failures", with_ctes("runs", """
SELECT r.source_id, count(*) FILTER (g.last_ok IS NULL OR r.finished_at > g.last_ok) AS failure_count FROM runs r LEFT JOIN (SELECT source_id, max(finished_at) AS last_ok FROM runs WHERE outcome = 'ok' GROUP BY source_id) g USING (source_id) GROUP BY r.source_id"""))
def _(spark, sf):
    return E.consecutive_failures(I.runs(spark, sf))


@query("A10_source_rollup", """
WITH s AS (SELECT DISTINCT source AS source_id FROM documents), a AS (SELECT 'src' || (user_id % 20) AS source_id, 'https://p.example/' || user_id || '/' || (props->>'$.k') AS url, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t, event_type FROM events)
SELECT s.source_id, (SELECT count(*) FROM documents d WHERE d.source = s.source_id) AS artifacts, (SELECT count(*) FROM documents d WHERE d.source = s.source_id) AS spans,
  (SELECT count(*) FROM documents d WHERE d.source = s.source_id) AS claims, (SELECT arg_max(event_type, t || url) FROM a WHERE a.source_id = s.source_id) AS availability, (SELECT max(t) FROM a WHERE a.source_id = s.source_id) AS last_checked FROM s""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("source", "source_id")
    av = table(spark, sf, "events").selectExpr("concat('src', user_id % 20) AS source_id", "concat('https://p.example/', user_id, '/', get_json_object(props, '$.k')) AS url",
                                               "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS last_checked", "event_type AS status")
    claims = d.select(F.array("source_id").alias("sources"))
    return S.source_rollup(I.doc_sources(spark, sf), d, d, av, claims)


@query("J15_verify_artifacts", with_ctes("artifacts", """
SELECT artifact_id, storage_path, CASE WHEN lang = 'es' THEN 'ARTIFACT_FILE_MISSING' ELSE 'ARTIFACT_HASH_MISMATCH' END AS rule FROM artifacts
WHERE storage_path IS NOT NULL AND (lang = 'es' OR sha256 <> true_sha)"""))
def _(spark, sf):
    files = table(spark, sf, "documents").filter("lang <> 'es'").select(F.concat(F.lit("store/"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return E.verify_artifacts(I.artifacts(spark, sf), files)


@query("J22_attach_virtual_artifacts", with_ctes("runs", """
, stored AS (SELECT tag, entity, min(sha256) AS sha256 FROM runs WHERE tag IN ('click', 'view') AND outcome = 'ok' GROUP BY ALL), first AS (SELECT tag, entity, arg_min(sha256, finished_at || run_id) AS sha256 FROM runs WHERE outcome = 'ok' GROUP BY ALL)
SELECT tag, entity, sha256, 'ART-' || substr(sha256, 1, 12) AS artifact_id, false AS virtual FROM stored
UNION ALL SELECT tag, entity, sha256, 'ART-' || substr(sha256, 1, 12), true FROM first f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.tag = f.tag AND s.entity = f.entity)"""))
def _(spark, sf):
    r = I.runs(spark, sf)
    stored = r.filter("tag IN ('click', 'view') AND outcome = 'ok'").groupBy("tag", "entity").agg(F.min("sha256").alias("sha256"))
    stored = stored.selectExpr("tag", "entity", "sha256", "concat('store/', sha256) AS storage_path", "cast(null as string) AS source_id", "'PUBLIC' AS pub_class")
    return E.attach_virtual_artifacts(r, stored).select("tag", "entity", "sha256", "artifact_id", "virtual")


@query("P9_publication_split", with_ctes("artifacts", """
SELECT artifact_id, sha256, pub_class, CASE WHEN NOT starts_with(pub_class, 'RESTRICTED') AND storage_path IS NOT NULL THEN '/data/' || sha256 || '.' || CASE mime WHEN 'application/pdf' THEN 'pdf' WHEN 'text/html' THEN 'html' WHEN 'application/json' THEN 'json' WHEN 'text/plain' THEN 'text' ELSE 'bin' END END AS download,
  CASE WHEN starts_with(pub_class, 'RESTRICTED') THEN 'restricted: ' || pub_class WHEN storage_path IS NULL THEN 'hash only, no stored body' END AS reason FROM artifacts"""))
def _(spark, sf):
    return E.publication_split(I.artifacts(spark, sf), "/data/")


@query("P8_redact_public", with_ctes("assertions", """
SELECT id, entity, predicate, 'price ' || trunc(o_totalprice)::BIGINT AS value, 'Person ' || o_custkey AS who_name, strftime(o_orderdate, '%Y') AS born_year, 'seen in page ' || (o_orderkey % 7) AS title FROM assertions"""))
def _(spark, sf):
    return E.redact_public(I.assertions(spark, sf))


@query("F30_has_pii", """
SELECT doc_id, regexp_matches(text, '\\b\\d{6}/\\d{3,4}\\b') AS birth_number, regexp_matches(text, '/Users/|/home/|[A-Z]:\\\\\\\\') AS local_path, regexp_matches(text, '"born"\\s*:\\s*"\\d{4}-\\d{2}-\\d{2}"') AS birth_date
FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' 850101/1234 ' WHEN doc_id % 3 = 1 THEN ' /home/x "born": "1980-01-02"' ELSE '' END AS text FROM documents)""")
def _(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", """concat(text, CASE WHEN doc_id % 3 = 0 THEN ' 850101/1234 ' WHEN doc_id % 3 = 1 THEN ' /home/x "born": "1980-01-02"' ELSE '' END) AS text""")
    t = F.col("text")
    return d.select("doc_id", has_birth_number(t).alias("birth_number"), has_local_path(t).alias("local_path"), has_full_birth_date(t).alias("birth_date"))


@query("F29_extract_ids", """
SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '\\bCLM-\\d+\\b'))) AS ref FROM (SELECT doc_id, text || ' see CLM-' || doc_id || ', CLM-' || (doc_id + 7) || ' and CLM-' || doc_id AS t FROM documents)""")
def _(spark, sf):
    t = F.concat(F.col("text"), F.lit(" see CLM-"), F.col("doc_id"), F.lit(", CLM-"), F.col("doc_id") + 7, F.lit(" and CLM-"), F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.explode(extract_ids(t, "\\bCLM-\\d+\\b")).alias("ref"))


DIM_KIND = """CASE WHEN kind = 'identity' THEN 'identity' WHEN kind = 'financials' THEN 'financials' WHEN kind = 'media' THEN 'media' WHEN kind = 'edge' THEN CASE cat WHEN 'governance' THEN 'management' WHEN 'people' THEN 'management' WHEN 'client' THEN 'commercial' WHEN 'technical' THEN 'technical' ELSE cat END END"""
cte("flat", """SELECT 'identity' AS kind, id, status, sources, NULL AS cat FROM identity UNION ALL SELECT 'edge', id, status, sources, cat FROM edges UNION ALL SELECT 'claim', id, status, sources, NULL FROM doc_claims
  UNION ALL SELECT 'financials', id, status, sources, NULL FROM financials UNION ALL SELECT 'media', id, status, sources, NULL FROM media""", ["identity", "edges", "doc_claims", "financials", "media"])
cte("gaps", """
  SELECT 'GAP-' || substr(q.id, 4) AS id, 'open_question' AS category, coalesce(r.dimension, 'identity') AS dimension, q.text AS expected_datum, coalesce(r.materiality, 'moderate') AS materiality, r.recommended_source, q.id AS origin
  FROM questions_in q LEFT JOIN routing r ON r.question_id = q.id
  UNION ALL SELECT id, 'missing_datum', 'financials', text, CASE WHEN regexp_matches(lower(text), 'employee|headcount|zaměstna') THEN 'moderate' ELSE 'low' END, 'collection of deeds', 'financials.notFound' FROM missing_in""", ["questions_in", "missing_in", "routing"])


def gaps(spark, sf):
    order = [F.col("conv_id"), F.col("turn")]
    q = V.number_records(I.questions_raw(spark, sf), "OQ-", order).select("id", "text")
    m = V.number_records(I.not_found_raw(spark, sf), "GAP-FIN-", order).select("id", "text")
    return V.gap_analysis(q, m, I.routing(spark, sf))


@query("W6_number_records", with_ctes("questions_in missing_in", "SELECT id, text FROM questions_in UNION ALL SELECT id, text FROM missing_in"))
def _(spark, sf):
    order = [F.col("conv_id"), F.col("turn")]
    q = V.number_records(I.questions_raw(spark, sf), "OQ-", order).select("id", "text")
    return q.unionByName(V.number_records(I.not_found_raw(spark, sf), "GAP-FIN-", order).select("id", "text"))


@query("E1_gap_analysis", with_ctes("gaps", "SELECT id, category, dimension, expected_datum, materiality, recommended_source, origin AS derived_from FROM gaps"))
def _(spark, sf):
    return gaps(spark, sf).withColumn("derived_from", joined("derived_from")).drop("status")


@query("A6_coverage_matrix", with_ctes("flat doc_sources gaps", f"""
, r AS (SELECT *, {DIM_KIND} AS dimension FROM flat), d AS (SELECT unnest(['identity','ownership','management','financials','transactions','legal','technical','commercial','media','procurement']) AS dimension),
a AS (SELECT dimension, count(*) AS records, count(*) FILTER (status = 'VERIFIED_PRIMARY') AS verified, count(*) FILTER (status = 'CORROBORATED') AS corroborated, count(*) FILTER (status = 'CONTRADICTED') AS contradicted FROM r GROUP BY 1),
s AS (SELECT dimension, count(*) AS sources, coalesce(bool_or(filed), false) AS has_primary_filed, count(DISTINCT coalesce(cls, 'other')) AS source_classes FROM (SELECT DISTINCT dimension, unnest(sources) AS sid FROM r) x LEFT JOIN doc_sources ds ON ds.id = x.sid GROUP BY 1),
g AS (SELECT dimension, count(*) AS open_gaps FROM gaps GROUP BY 1),
m AS (SELECT d.dimension, coalesce(records, 0) AS records, coalesce(verified, 0) AS verified, coalesce(corroborated, 0) AS corroborated, coalesce(contradicted, 0) AS contradicted, coalesce(sources, 0) AS sources,
  coalesce(has_primary_filed, false) AS has_primary_filed, coalesce(source_classes, 0) AS source_classes, coalesce(open_gaps, 0) AS open_gaps FROM d LEFT JOIN a USING (dimension) LEFT JOIN s USING (dimension) LEFT JOIN g USING (dimension))
SELECT *, CASE WHEN records = 0 THEN 'absent' WHEN verified = 0 AND corroborated = 0 THEN 'weak' WHEN has_primary_filed AND verified > 0 AND contradicted = 0 THEN 'strong' WHEN verified > 0 OR has_primary_filed THEN 'adequate' ELSE 'partial' END AS coverage FROM m"""))
def _(spark, sf):
    return coverage(spark, sf)


def coverage(spark, sf):
    return V.coverage_matrix(flat(spark, sf), I.doc_sources(spark, sf), gaps(spark, sf))


SCORE = "CASE {m} WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END + CASE WHEN {s} THEN 1 ELSE 0 END + CASE WHEN {w} THEN 1 ELSE 0 END"
cte("tasks", f"""
  SELECT *, CASE WHEN score >= 4 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS priority FROM (
  SELECT 'TASK-' || id AS id, field AS target, 'resolve contradiction ' || id AS question, resolution AS reason, recommended_source, materiality, 'disputed' AS confidence, {SCORE.format(m='materiality', s="regexp_matches(resolution, 'lookup')", w='true')} AS score, [id] AS origin FROM contradictions
  UNION ALL SELECT 'TASK-' || id, dimension, expected_datum, 'open gap (' || category || ') in ' || dimension, recommended_source, materiality, 'unknown', {SCORE.format(m='materiality', s='recommended_source IS NOT NULL', w='false')}, [origin] FROM gaps
  UNION ALL SELECT 'TASK-' || id, subject, 'test hypothesis ' || id, 'falsification: ' || falsification, next_best_evidence, materiality, state, {SCORE.format(m='materiality', s='next_best_evidence IS NOT NULL', w='false')}, [id] FROM hypotheses WHERE state IN ('unresolved', 'plausible'))""", ["contradictions", "gaps", "hypotheses"])


def tasks(spark, sf):
    return V.frontier(I.contradictions(spark, sf), gaps(spark, sf), I.hypotheses(spark, sf))


@query("E2_frontier", with_ctes("tasks", "SELECT id, target, question, reason, recommended_source, materiality, confidence, priority, array_to_string(origin, ',') AS derived_from FROM tasks"))
def _(spark, sf):
    return tasks(spark, sf).withColumn("derived_from", joined("derived_from"))


@query("T1_rank_frontier", with_ctes("tasks", "SELECT id, priority FROM tasks ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, id"))
def _(spark, sf):
    return V.rank_frontier(tasks(spark, sf)).select("id", "priority")


EIG = """CASE WHEN regexp_matches(lower(question || ' ' || coalesce(reason, '')), 'rozpor|con-|contradiction') THEN 'high' WHEN priority = 'low' AND regexp_matches(coalesce(recommended_source, ''), 'or\\.justice\\.cz|primary|collection of deeds') THEN 'moderate'
  ELSE CASE priority WHEN 'high' THEN 'high' WHEN 'medium' THEN 'moderate' ELSE 'low' END END"""
OFFICIAL = "CASE WHEN regexp_matches(coalesce(recommended_source, ''), 'or\\.justice\\.cz|justice|collection of deeds') THEN 'official_primary' ELSE 'secondary' END"
UNC = "CASE WHEN confidence IN ('disputed', 'unknown') THEN 'high' ELSE 'moderate' END"


@query("E5_planner_tasks", with_ctes("tasks", f"""
SELECT id, priority, {EIG} AS information_gain, {UNC} AS uncertainty, CASE WHEN recommended_source IS NOT NULL THEN 'known_public_source' ELSE 'none' END AS source_availability, {OFFICIAL} AS source_authority,
  CASE WHEN regexp_matches(lower(coalesce(reason, '')), 'fyzick|rezidenč|natural|osob') THEN 'elevated' ELSE 'low' END AS privacy_risk,
  'priority ' || priority || ': materiality=' || materiality || ', uncertainty=' || {UNC} || ', source=' || {OFFICIAL} || CASE WHEN recommended_source IS NOT NULL THEN ' (known public source)' ELSE ' (no known source)' END AS why_ranked FROM tasks"""))
def _(spark, sf):
    return V.ranked_tasks(tasks(spark, sf)).select("id", "priority", "information_gain", "uncertainty", "source_availability", "source_authority", "privacy_risk", "why_ranked")


@query("E4_questions", with_ctes("gaps contradictions", """
SELECT 'Q-' || regexp_replace(id, '^GAP-?', '') AS id, dimension AS target, category, 'open' AS status, 'TASK-' || id AS linked_task FROM gaps UNION ALL SELECT 'Q-' || id, field, 'contradiction', 'open', 'TASK-' || id FROM contradictions"""))
def _(spark, sf):
    return V.questions(gaps(spark, sf), I.contradictions(spark, sf))


@query("E3_source_registry", with_ctes("citing doc_sources", """
, u AS (SELECT source_id, count(*) FILTER (kind = 'claims') AS claims, count(*) FILTER (kind = 'edges') AS edges, count(*) FILTER (kind = 'contradictions') AS contradictions FROM (SELECT DISTINCT * FROM citing) GROUP BY 1)
SELECT id AS source_id, tier::BIGINT AS tier, kind, class, upstream, official, is_primary AS "primary", CASE WHEN upstream = 'up2' THEN 'company_controlled' WHEN class IN ('aggregator', 'register_mirror') THEN 'derivative' ELSE 'independent_origin' END AS independence,
  CASE WHEN abs(date_diff('day', retrieved::DATE, DATE '2024-02-01')) <= 14 THEN 'fresh' ELSE 'aged' END AS freshness, coalesce(claims, 0) AS claims, coalesce(edges, 0) AS edges, coalesce(contradictions, 0) AS contradictions FROM doc_sources LEFT JOIN u ON u.source_id = id"""))
def _(spark, sf):
    r = S.source_registry(I.doc_sources(spark, sf), I.source_model(spark, sf), I.CUTOFF, I.CONTROLLED, citing(spark, sf))
    return r.drop("retrievedAt").withColumn("tier", F.col("tier").cast("bigint"))


@query("G8_verification_state", with_ctes("edges doc_sources", """
, v AS (SELECT e.id, e.source, e.target, e.status, e.valid_to, count(e.sid) AS source_records, count(DISTINCT coalesce(s.upstream, 'unknown')) FILTER (e.sid IS NOT NULL) AS ups, bool_or(coalesce(s.class = 'primary_registry_document', false)) AS direct,
    bool_or(coalesce(s.upstream = 'up1', false)) AS reg, count(e.sid) > 0 AND bool_and(coalesce(s.upstream = 'up2', false)) AS company
  FROM (SELECT id, source, target, status, valid_to, unnest(CASE WHEN len(sources) = 0 THEN [NULL] ELSE sources END) AS sid FROM edges) e LEFT JOIN doc_sources s ON s.id = e.sid GROUP BY e.id, e.source, e.target, e.status, e.valid_to)
SELECT id, source, target, status, CASE WHEN status = 'CONTRADICTED' THEN 'contradicted' WHEN valid_to IS NOT NULL THEN 'historical' WHEN status = 'VERIFIED_PRIMARY' AND (direct OR reg) THEN 'verified' WHEN status = 'CORROBORATED' AND ups >= 2 THEN 'partially_verified'
  WHEN status = 'CORROBORATED' THEN 'single_upstream' WHEN company OR status = 'SELF_REPORTED' THEN 'source_claimed' ELSE 'unverified' END AS verification_state, ups AS independent_upstreams, source_records, direct AS has_primary_direct FROM v"""))
def _(spark, sf):
    return verification(spark, sf).withColumn("independent_upstreams", F.col("independent_upstreams").cast("bigint"))


def verification(spark, sf):
    return S.verification_state(I.edges(spark, sf), I.source_model(spark, sf), I.CONTROLLED, ["up1"])


@query("E22_risk_basis", with_ctes("doc_claims", """
, l AS (SELECT 'RISK-' || lang AS risk_id, 'CLM-' || doc_id AS claim_id FROM documents), g AS (SELECT risk_id, count(*) AS claims, count(*) FILTER (status = 'SELF_REPORTED') AS self_reported FROM l JOIN doc_claims c ON c.id = l.claim_id WHERE NOT superseded GROUP BY 1)
SELECT risk_id, claims, self_reported, round(self_reported::DECIMAL(20,6) * 100 / claims, 1)::DOUBLE AS share_pct, self_reported || ' of ' || claims || ' claims are self-reported' AS basis FROM g"""))
def _(spark, sf):
    links = table(spark, sf, "documents").selectExpr("concat('RISK-', lang) AS risk_id", "concat('CLM-', doc_id) AS claim_id")
    return S.risk_basis(I.doc_claims(spark, sf), links)


@query("E19_spatial_coverage_gaps", """
, m AS (SELECT c_name AS entity, d.dimension FROM customer CROSS JOIN (SELECT unnest(['geometry', 'parcel']) AS dimension) d WHERE NOT (d.dimension = 'geometry' AND c_acctbal > 0))
SELECT 'GAP-CAD-' || CASE WHEN length(no::VARCHAR) >= 2 THEN no::VARCHAR ELSE lpad(no::VARCHAR, 2, '0') END AS id, entity, dimension, 'blocked' AS status FROM (SELECT *, row_number() OVER (ORDER BY entity, dimension) AS no FROM m)""".strip().replace(", m AS", "WITH m AS", 1))
def _(spark, sf):
    dims = table(spark, sf, "customer").selectExpr("c_name AS entity", "explode(array(struct('geometry' AS dimension, c_acctbal > 0 AS collected), struct('parcel' AS dimension, false AS collected))) AS d").select("entity", "d.*")
    return V.spatial_coverage_gaps(dims)


@query("F14_source_class", with_ctes("doc_sources", 'SELECT id, cls AS source_class, filed AS primary_filed FROM doc_sources'))
def _(spark, sf):
    s = I.doc_sources(spark, sf)
    return s.select("id", S.source_class(F.col("kind"), F.col("tier")).alias("source_class"), S.is_primary_filed(F.col("tier"), F.col("kind")).alias("primary_filed"))


@query("F16_text_materiality", with_ctes("diversity", "SELECT id, materiality FROM diversity"))
def _(spark, sf):
    return I.doc_claims(spark, sf).select("id", S.materiality_of_text(F.col("text")).alias("materiality"))
