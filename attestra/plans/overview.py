"""Queries on tallies, KPIs, search, the timeline and text identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.functions.time import add_days, days_between, elapsed_days, year_of
from attestra.operators import overview as O
from attestra.plans import evidence_inputs as I
from attestra.plans.evidence import diversity, verification
from attestra.plans.graphs import nodes
from attestra.plans.inputs import claim_records, cte, snapshots, table, with_ctes
from attestra.plans.registry import query


@query("A1_tally", with_ctes("claim_records", "SELECT status, count(*) AS n FROM claim_records GROUP BY status"))
def _(spark, sf):
    return O.tally(claim_records(spark, sf), "status")


@query("A17_claim_accounting", with_ctes("doc_claims", """
SELECT 'issued' AS measure, count(*) AS value FROM doc_claims UNION ALL SELECT 'live', count(*) FILTER (NOT superseded) FROM doc_claims UNION ALL SELECT 'superseded', count(*) FILTER (superseded) FROM doc_claims
UNION ALL SELECT 'status:' || status, count(*) FROM doc_claims GROUP BY status"""))
def _(spark, sf):
    return O.claim_accounting(I.doc_claims(spark, sf))


@query("A17_claim_ids", with_ctes("doc_claims", "SELECT CASE WHEN superseded THEN 'superseded' ELSE 'live' END AS list, id FROM doc_claims"))
def _(spark, sf):
    return O.claim_ids(I.doc_claims(spark, sf))


@query("A15_state_fingerprint", with_ctes("nodes edges doc_claims doc_sources contradictions diversity", """
, v AS (SELECT count(*) AS n FROM (SELECT e.id, bool_or(coalesce(s.class = 'primary_registry_document', false)) AS d, bool_or(coalesce(s.upstream = 'up1', false)) AS r FROM (SELECT id, unnest(sources) AS sid FROM edges WHERE status = 'VERIFIED_PRIMARY' AND valid_to IS NULL) e LEFT JOIN doc_sources s ON s.id = e.sid GROUP BY e.id) WHERE d OR r),
t AS (SELECT '{"entities":' || (SELECT count(*) FROM nodes) || ',"edges":' || (SELECT count(*) FROM edges) || ',"claims":' || (SELECT count(*) FROM doc_claims) || ',"sources":' || (SELECT count(*) FROM doc_sources) || ',"contradictions":' || (SELECT count(*) FROM contradictions)
  || ',"monoculture":' || (SELECT count(*) FROM diversity WHERE ups <= 1) || ',"verified":' || (SELECT n FROM v) || '}' AS fingerprint)
SELECT fingerprint, format('{:08x}', list_reduce(list_transform(string_split(fingerprint, ''), lambda c: ascii(c)::UBIGINT), lambda h, c: (xor(h, c) * 16777619::UBIGINT) % 4294967296::UBIGINT, 2166136261::UBIGINT)) AS run_hash FROM t"""))
def _(spark, sf):
    d = diversity(spark, sf)
    v = verification(spark, sf)
    return O.state_fingerprint([("entities", nodes(spark, sf)), ("edges", I.edges(spark, sf)), ("claims", I.doc_claims(spark, sf)), ("sources", I.doc_sources(spark, sf)),
                                ("contradictions", I.contradictions(spark, sf)), ("monoculture", d.filter("monoculture")), ("verified", v.filter("verification_state = 'verified'"))])


cte("kpi_rows", """
  SELECT 'claims' AS kpi, id FROM doc_claims WHERE NOT superseded UNION ALL SELECT 'verified', id FROM doc_claims WHERE NOT superseded AND status IN ('VERIFIED_PRIMARY', 'CORROBORATED') UNION ALL SELECT 'self_reported', id FROM doc_claims WHERE NOT superseded AND status = 'SELF_REPORTED'
  UNION ALL SELECT 'assessed', id FROM doc_claims WHERE NOT superseded AND status = 'ASSESSED' UNION ALL SELECT 'contradictions', id FROM contradictions UNION ALL SELECT 'contradictions_resolved', id FROM contradictions WHERE status = 'RESOLVED'
  UNION ALL SELECT 'sources', id FROM doc_sources UNION ALL SELECT 'official_sources', id FROM doc_sources WHERE tier = 1 OR regexp_matches(kind, 'official|register') UNION ALL SELECT 'primary_documents', id FROM doc_sources WHERE kind = 'primary registry document'
  UNION ALL SELECT 'entities', id FROM nodes UNION ALL SELECT 'relationships', id FROM edges UNION ALL SELECT 'open_questions', conv_id || '-' || turn FROM conversations WHERE role = 'user'""", ["doc_claims", "contradictions", "doc_sources", "nodes", "edges"])


def kpis(spark, sf):
    q = I.questions_raw(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("id"))
    return O.kpi_rows(I.doc_claims(spark, sf), I.contradictions(spark, sf), I.doc_sources(spark, sf), nodes(spark, sf), I.edges(spark, sf), q)


@query("A18_kpi_overview", with_ctes("kpi_rows", "SELECT kpi, count(*) AS value FROM kpi_rows GROUP BY kpi"))
def _(spark, sf):
    return O.kpi_overview(kpis(spark, sf))


@query("A18_kpi_rows", with_ctes("kpi_rows", "SELECT kpi, id FROM kpi_rows"))
def _(spark, sf):
    return kpis(spark, sf)


@query("T5_search", with_ctes("doc_claims doc_sources contradictions nodes", """
, i AS (SELECT 0 AS r, 'claim' AS kind, id, text AS label FROM doc_claims WHERE NOT superseded UNION ALL SELECT 1, 'source', id, title FROM doc_sources UNION ALL SELECT 2, 'contradiction', id, field FROM contradictions UNION ALL SELECT 3, 'entity', id, label FROM nodes)
SELECT kind, id FROM i WHERE contains(lower(id || ' ' || coalesce(label, '')), 'c17') ORDER BY lower(id) = 'c17' DESC, r, id LIMIT 12"""))
def _(spark, sf):
    live = I.doc_claims(spark, sf).filter("NOT superseded")
    index = O.search_index([("claim", live, "id", "text"), ("source", I.doc_sources(spark, sf), "id", "title"), ("contradiction", I.contradictions(spark, sf), "id", "field"), ("entity", nodes(spark, sf), "id", "label")])
    return O.search(index, "C17").select("kind", "id")


cte("finance_cites", "SELECT DISTINCT unnest(sources) AS source_id, id AS claim_id FROM doc_claims WHERE regexp_matches(lower(text), 'thera|eren')", ["doc_claims"])
cte("metric_cites", "SELECT DISTINCT id AS metric_id, unnest(sources) AS source_id FROM financials", ["financials"])


def bridges(spark, sf):
    return O.related_bridges(I.financials(spark, sf), I.doc_claims(spark, sf), "thera|eren")


@query("J20_metric_bridge", with_ctes("metric_cites", "SELECT metric_id, source_id FROM metric_cites"))
def _(spark, sf):
    return bridges(spark, sf)[0]


@query("J20_claim_bridge", with_ctes("finance_cites", "SELECT source_id, claim_id FROM finance_cites"))
def _(spark, sf):
    return bridges(spark, sf)[1]


@query("J20_related_counts", with_ctes("metric_cites finance_cites", "SELECT metric_id, count(DISTINCT claim_id) AS related_claims FROM metric_cites LEFT JOIN finance_cites USING (source_id) GROUP BY metric_id"))
def _(spark, sf):
    return O.related_counts(*bridges(spark, sf))


cte("metric_sets", "SELECT metric_id, list_sort(list(source_id)) AS sources FROM metric_cites GROUP BY metric_id", ["metric_cites"])
cte("claim_sets", "SELECT claim_id, list_sort(list(source_id)) AS sources FROM finance_cites GROUP BY claim_id", ["finance_cites"])
cte("metric_classes", "SELECT metric_id, sources, min(metric_id) OVER (PARTITION BY sources) AS rep FROM metric_sets", ["metric_sets"])
cte("claim_classes", "SELECT claim_id, sources, min(claim_id) OVER (PARTITION BY sources) AS rep FROM claim_sets", ["claim_sets"])


@query("J20_related_claims", with_ctes("metric_classes claim_classes", """
SELECT 'metric' AS part, metric_id AS id, rep AS ref FROM metric_classes UNION ALL SELECT 'claim', claim_id, rep FROM claim_classes
UNION ALL SELECT DISTINCT 'related', m.rep, c.rep FROM (SELECT DISTINCT rep, unnest(sources) AS source_id FROM metric_classes) m JOIN (SELECT DISTINCT rep, unnest(sources) AS source_id FROM claim_classes) c USING (source_id)"""))
def _(spark, sf):
    """All metrics and the claims beside them: class pairs and who belongs to which class."""
    return O.related_classes(*bridges(spark, sf))


def events(spark, sf):
    t = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "date_format(o_orderdate, 'yyyy-MM-dd') AS date", "o_orderpriority AS event")
    e = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_observed"))
    e = e.selectExpr("concat(l_orderkey, '-', l_suppkey) AS id", "concat('o', l_orderkey) AS source", "concat('s', l_suppkey) AS target", "'ships' AS label", "first_observed")
    pub = table(spark, sf, "nation").selectExpr("n_name AS id", "concat('1999-01-', lpad(n_nationkey + 1, 2, '0')) AS at", "CASE WHEN n_regionkey = 1 THEN 'WITHDRAWN' ELSE 'REPUBLISHED' END AS event")
    snaps = snapshots(spark, sf).select("snapshot_id", F.col("evidence_cutoff").alias("generated_at"))
    return O.combine_events(t, e, I.doc_sources(spark, sf), snaps, pub)


cte("events_all", """
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, 'milestone' AS kind, 'reality' AS lane, o_orderpriority AS text, 'm' || o_orderkey AS key FROM orders
  UNION ALL SELECT d, 'rel', 'reality', 'o' || l_orderkey || ' - ships - s' || l_suppkey, 'e' || l_orderkey || '-' || l_suppkey FROM (SELECT l_orderkey, l_suppkey, strftime(min(l_shipdate), '%Y-%m-%d') AS d FROM lineitem GROUP BY 1, 2) WHERE d NOT IN (SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders)
  UNION ALL SELECT retrieved, 'obs', 'evidence', id || ' retrieved', 's' || id FROM doc_sources UNION ALL SELECT cutoff, 'pub', 'publication', 'snapshot ' || snapshot_id, 'p' || snapshot_id FROM snaps
  UNION ALL SELECT '1999-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0'), 'pub', 'publication', CASE WHEN n_regionkey = 1 THEN 'WITHDRAWN' ELSE 'REPUBLISHED' END, 'pe' || n_name FROM nation""", ["doc_sources", "snaps"])


@query("U5_combine_events", with_ctes("events_all", "SELECT date, kind, lane, text, key FROM events_all"))
def _(spark, sf):
    return events(spark, sf)


@query("T6_sort_events", with_ctes("events_all", "SELECT date, lane, key FROM events_all ORDER BY date, lane, key"))
def _(spark, sf):
    return O.sort_events(events(spark, sf)).select("date", "lane", "key")


@query("P14_timeline_filter", with_ctes("events_all", "SELECT date, lane, key FROM events_all WHERE kind = 'milestone' AND lane = 'reality' AND substr(date, 1, 4) = '1998'"))
def _(spark, sf):
    return O.timeline_filter(events(spark, sf), "milestone", "reality", 1998).select("date", "lane", "key")


def mention_inputs(spark, sf):
    n = table(spark, sf, "benchmark").selectExpr("concat('B', item_id) AS id", "concat('V. ', regexp_extract(text, '^(\\\\S+ \\\\S+ \\\\S+)', 1)) AS label")
    t = table(spark, sf, "conversations").selectExpr("concat(conv_id, '-', turn) AS id", "text")
    return t, n


@query("F28_mention_entity", """
WITH k AS (SELECT 'B' || item_id AS id, string_split(lower(regexp_extract(text, '^(\\S+ \\S+ \\S+)', 1)), ' ')[-1] AS key FROM benchmark), h AS (SELECT conv_id || '-' || turn AS text_id, k.id AS node_id, length(key) AS n FROM conversations c JOIN k ON length(k.key) > 3 AND contains(lower(c.text), k.key))
SELECT text_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY n DESC, node_id) AS r FROM h) WHERE r = 1""")
def _(spark, sf):
    return O.mention_entity(*mention_inputs(spark, sf))


@query("F13_short_text", """
SELECT doc_id, CASE WHEN length(t) > 60 THEN regexp_replace(substr(t, 1, 59), '[\\s,;:—-]+\\S*$', '') || '…' ELSE t END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.short_text(F.col("text"), 60).alias("short"))


@query("F4_fnv1a32", """
SELECT item_id, format('{:08x}', list_reduce(list_transform(string_split(text, ''), lambda c: ascii(c)::UBIGINT), lambda h, c: (xor(h, c) * 16777619::UBIGINT) % 4294967296::UBIGINT, 2166136261::UBIGINT)) AS digest FROM benchmark""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.fnv1a32(F.col("text")).alias("digest"))


@query("F5_slugify", """
SELECT doc_id, regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query("F6_fold_key", "SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.fold_key(F.col("text")).alias("folded"))


@query("F10_gap_prefix", "SELECT conv_id, turn, substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 60) AS prefix FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.gap_prefix(F.col("text")).alias("prefix"))


@query("F1_canonical_json", """
SELECT event_id, '{"a":{"x":null,"y":[3,1]},"k":' || (props->>'$.k') || ',"type":"' || event_type || '"}' AS canonical, substr(sha256('{"a":{"x":null,"y":[3,1]},"k":' || (props->>'$.k') || ',"type":"' || event_type || '"}'), 1, 16) AS content_hash FROM events""")
def _(spark, sf):
    raw = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": {"y": [3, 1], "x": null}}'))
    e = table(spark, sf, "events").select("event_id", X.canonical_json(raw).alias("canonical"))
    return e.withColumn("content_hash", X.content_hash(F.col("canonical")))


@query("F1_canonical_numbers", """
SELECT o_orderkey, '{"a":' || o_custkey || ',"b":[' || ((o_orderkey + 1) * 1000) || ',' || ((o_orderkey + 1) * 1000) || ',' || ((o_orderkey + 1) * 1000) || ',-2.5,0.00000125,1e-7],"s":"1e3 1.50"}' AS canonical FROM orders""")
def _(spark, sf):
    """Equal numbers in different spellings, a repeated key, and numbers inside of a string."""
    raw = """concat('{"b": [', o_orderkey + 1, 'e3, ', o_orderkey + 1, '000, ', o_orderkey + 1, '000.00, -2.50, 125E-8, 1E-7], "a": -1, "s": "1e3 1.50", "a": ', o_custkey, '.0}')"""
    return table(spark, sf, "orders").select("o_orderkey", X.canonical_json(F.expr(raw)).alias("canonical"))


@query("F8_calendar", """
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS due, date_diff('day', o_orderdate::DATE, DATE '2001-12-31')::BIGINT AS days_left, year(o_orderdate)::BIGINT AS year,
  floor((epoch(TIMESTAMP '2001-12-31 12:00:00') - epoch(o_orderdate)) / 86400)::BIGINT AS elapsed FROM orders""")
def _(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey", add_days(day, 45).alias("due"), days_between(day, F.lit("2001-12-31")).cast("bigint").alias("days_left"), year_of(day).cast("bigint").alias("year"),
        elapsed_days(F.col("o_orderdate"), F.lit("2001-12-31 12:00:00").cast("timestamp")).cast("bigint").alias("elapsed"))
