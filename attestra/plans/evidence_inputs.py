"""Evidence tables (claims, sources, runs, links) from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.plans.inputs import cte, table

STATUSES = "array('VERIFIED_PRIMARY','CORROBORATED','SELF_REPORTED','ASSESSED','CONTRADICTED','BLOCKED','NOT_FOUND')"
KINDS = "array('primary registry document','official register','company website','media','social profile','aggregator')"
CLASSES = "array('primary_registry_document','register_mirror','company','media','profile','aggregator')"
CUTOFF = "2024-02-01"
CONTROLLED = "up2"
EMPTY = "cast(array() as array<string>)"


def doc_claims(spark, sf):
    n = "cast(substring(source, 4) as int)"
    return table(spark, sf, "documents").selectExpr(
        "concat('CLM-', doc_id) AS id", "doc_id", "text",
        f"{STATUSES}[doc_id % 7] AS status",
        f"""CASE WHEN doc_id % 11 = 0 THEN {EMPTY}
            ELSE array_sort(array_distinct(array_compact(array(source, concat('src', ({n} + doc_id % 3) % 20), CASE WHEN doc_id % 13 = 0 THEN 'src99' END)))) END AS sources""",
        "doc_id % 10 = 0 AS superseded",
        f"CASE WHEN doc_id % 10 = 0 AND doc_id % 50 <> 0 THEN array(concat('CLM-', doc_id + 1)) ELSE {EMPTY} END AS supersededBy",
        "CASE WHEN doc_id % 10 = 0 AND doc_id % 30 <> 0 THEN 'newer document' END AS supersededReason", "source AS own_source", "lang")


cte("doc_claims", """
  SELECT 'CLM-' || doc_id AS id, doc_id, text,
    ['VERIFIED_PRIMARY','CORROBORATED','SELF_REPORTED','ASSESSED','CONTRADICTED','BLOCKED','NOT_FOUND'][doc_id % 7 + 1] AS status,
    CASE WHEN doc_id % 11 = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_filter([source, 'src' || ((substr(source, 4)::INTEGER + doc_id % 3) % 20)::VARCHAR,
      CASE WHEN doc_id % 13 = 0 THEN 'src99' END], lambda x: x IS NOT NULL))) END AS sources,
    doc_id % 10 = 0 AS superseded, CASE WHEN doc_id % 10 = 0 AND doc_id % 50 <> 0 THEN ['CLM-' || (doc_id + 1)] ELSE []::VARCHAR[] END AS successors,
    CASE WHEN doc_id % 10 = 0 AND doc_id % 30 <> 0 THEN 'newer document' END AS reason, source AS own_source, lang
  FROM documents""")


def doc_sources(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    n = "cast(substring(source, 4) as int)"
    return d.selectExpr("source AS id", f"{n} AS n", f"concat('Source ', {n}) AS title", f"concat('https://s.example/', {n}) AS url", f"{n} % 3 + 1 AS tier",
                        f"{KINDS}[{n} % 6] AS kind", f"date_format(date_add(date'2024-01-01', {n} * 2), 'yyyy-MM-dd') AS retrievedAt", "documents")


cte("doc_sources", """
  SELECT source AS id, n, 'Source ' || n AS title, 'https://s.example/' || n AS url, n % 3 + 1 AS tier,
    ['primary registry document','official register','company website','media','social profile','aggregator'][n % 6 + 1] AS kind,
    strftime(DATE '2024-01-01' + n * 2, '%Y-%m-%d') AS retrieved, documents,
    'up' || (n % 5) AS upstream, ['primary_registry_document','register_mirror','company','media','profile','aggregator'][n % 6 + 1] AS class,
    n % 6 = 0 AS is_primary, n % 6 <= 1 AS official, CASE WHEN n < 16 THEN 'fam' || (n % 4) END AS family,
    CASE WHEN n % 6 <= 1 THEN 'official' WHEN n % 6 = 2 THEN 'company' WHEN n % 6 IN (3, 4, 5) THEN 'media' END AS cls,
    n % 3 = 0 AND n % 6 <= 1 AS filed
  FROM (SELECT source, substr(source, 4)::INTEGER AS n, count(*) AS documents FROM documents GROUP BY source)""")


def source_model(spark, sf):
    return doc_sources(spark, sf).selectExpr("id AS source_id", "concat('up', n % 5) AS upstream", f"{CLASSES}[n % 6] AS class",
                                             "n % 6 = 0 AS primary", "n % 6 <= 1 AS official")


def families(spark, sf):
    return doc_sources(spark, sf).filter("n < 16").selectExpr("id AS source_id", "concat('fam', n % 4) AS family_id")


def edges(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "concat('E', o_orderkey) AS id", "concat('c', o_custkey) AS source", "concat('o', o_orderkey) AS target",
        "CASE o_orderstatus WHEN 'F' THEN 'VERIFIED_PRIMARY' WHEN 'O' THEN 'CORROBORATED' WHEN 'P' THEN CASE WHEN o_totalprice < 60000 THEN 'CONTRADICTED' ELSE 'SELF_REPORTED' END END AS status",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'ownership' WHEN '2' THEN 'governance' WHEN '3' THEN 'transactions' WHEN '4' THEN 'legal' ELSE 'client' END AS cat",
        "CASE WHEN o_orderdate < timestamp'1996-01-01' THEN '1999-12-31' END AS valid_to",
        f"CASE WHEN o_totalprice > 480000 THEN {EMPTY} ELSE array_sort(array_distinct(array(concat('src', o_orderkey % 20), concat('src', o_custkey % 21)))) END AS sources",
        "CASE WHEN o_totalprice < 450000 THEN concat('order of ', o_custkey) END AS why")


cte("edges", """
  SELECT 'E' || o_orderkey AS id, 'c' || o_custkey AS source, 'o' || o_orderkey AS target,
    CASE o_orderstatus WHEN 'F' THEN 'VERIFIED_PRIMARY' WHEN 'O' THEN 'CORROBORATED' WHEN 'P' THEN CASE WHEN o_totalprice < 60000 THEN 'CONTRADICTED' ELSE 'SELF_REPORTED' END END AS status,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ownership' WHEN '2' THEN 'governance' WHEN '3' THEN 'transactions' WHEN '4' THEN 'legal' ELSE 'client' END AS cat,
    CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN '1999-12-31' END AS valid_to,
    CASE WHEN o_totalprice > 480000 THEN []::VARCHAR[] ELSE list_sort(list_distinct(['src' || (o_orderkey % 20), 'src' || (o_custkey % 21)])) END AS sources,
    CASE WHEN o_totalprice < 450000 THEN 'order of ' || o_custkey END AS why
  FROM orders""")


def identity(spark, sf):
    return table(spark, sf, "supplier").selectExpr(
        "concat('identity:', s_name) AS id", "s_name AS field", "CASE WHEN s_acctbal > 5000 THEN 'VERIFIED_PRIMARY' ELSE 'CORROBORATED' END AS status",
        f"CASE WHEN s_acctbal < 0 THEN {EMPTY} ELSE array(concat('src', s_suppkey % 22)) END AS sources")


cte("identity", """
  SELECT 'identity:' || s_name AS id, s_name AS field, CASE WHEN s_acctbal > 5000 THEN 'VERIFIED_PRIMARY' ELSE 'CORROBORATED' END AS status,
    CASE WHEN s_acctbal < 0 THEN []::VARCHAR[] ELSE ['src' || (s_suppkey % 22)] END AS sources FROM supplier""")


def financials(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('fin:', p_partkey) AS id", "CASE WHEN p_size > 25 THEN 'SELF_REPORTED' ELSE 'ASSESSED' END AS status",
        "array(concat('src', p_size % 20)) AS sources")


cte("financials", """
  SELECT 'fin:' || p_partkey AS id, CASE WHEN p_size > 25 THEN 'SELF_REPORTED' ELSE 'ASSESSED' END AS status, ['src' || (p_size % 20)] AS sources FROM part""")


def media(spark, sf):
    return doc_sources(spark, sf).filter("n % 6 >= 3").selectExpr("concat('media:', id) AS id", "'SELF_REPORTED' AS status", "array(id) AS sources")


cte("media", "SELECT 'media:' || id AS id, 'SELF_REPORTED' AS status, [id] AS sources FROM doc_sources WHERE n % 6 >= 3", ["doc_sources"])


def contradictions(spark, sf):
    return table(spark, sf, "labels").selectExpr(
        "concat('CON-', doc_id) AS id", "concat('toxic of ', doc_id) AS field",
        "CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN quality = 1 THEN 'RESOLVED' ELSE 'OPEN' END AS status",
        "concat('src', doc_id % 20) AS source_a", "CASE WHEN doc_id % 17 <> 0 THEN concat('src', (doc_id + quality) % 21) END AS source_b",
        f"CASE WHEN quality = 1 AND doc_id % 5 <> 0 THEN array(concat('src', doc_id % 22)) ELSE {EMPTY} END AS resolved_by",
        "CASE WHEN quality = 1 THEN '2024-01-15' END AS resolved_at",
        "CASE WHEN quality = 0 THEN 'needs a direct lookup' ELSE 'settled by review' END AS resolution",
        "CASE WHEN toxic = 1 THEN 'moderate' ELSE 'low' END AS materiality", "'official register' AS recommended_source")


cte("contradictions", """
  SELECT 'CON-' || doc_id AS id, 'toxic of ' || doc_id AS field, CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN quality = 1 THEN 'RESOLVED' ELSE 'OPEN' END AS status,
    'src' || (doc_id % 20) AS source_a, CASE WHEN doc_id % 17 <> 0 THEN 'src' || ((doc_id + quality) % 21) END AS source_b,
    CASE WHEN quality = 1 AND doc_id % 5 <> 0 THEN ['src' || (doc_id % 22)] ELSE []::VARCHAR[] END AS resolved_by, CASE WHEN quality = 1 THEN '2024-01-15' END AS resolved_at,
    CASE WHEN quality = 0 THEN 'needs a direct lookup' ELSE 'settled by review' END AS resolution,
    CASE WHEN toxic = 1 THEN 'moderate' ELSE 'low' END AS materiality, 'official register' AS recommended_source FROM labels""")


def questions_raw(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


def not_found_raw(spark, sf):
    return table(spark, sf, "conversations").filter("role <> 'user'").select("conv_id", "turn", "text")


cte("questions_in", """SELECT 'OQ-' || CASE WHEN length(no::VARCHAR) >= 2 THEN no::VARCHAR ELSE lpad(no::VARCHAR, 2, '0') END AS id, text
  FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS no FROM conversations WHERE role = 'user')""")
cte("missing_in", """SELECT 'GAP-FIN-' || CASE WHEN length(no::VARCHAR) >= 2 THEN no::VARCHAR ELSE lpad(no::VARCHAR, 2, '0') END AS id, text
  FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS no FROM conversations WHERE role <> 'user')""")


def routing(spark, sf):
    return table(spark, sf, "nation").selectExpr(
        "concat('OQ-', lpad(cast(n_nationkey + 1 as string), 2, '0')) AS question_id",
        "array('financials','management','ownership','procurement','commercial')[n_regionkey % 5] AS dimension",
        "array('high','moderate','low')[n_nationkey % 3] AS materiality",
        "CASE WHEN n_nationkey % 4 = 0 THEN 'or.justice.cz' WHEN n_nationkey % 4 = 1 THEN 'contracts register' END AS recommended_source")


cte("routing", """SELECT 'OQ-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS question_id, ['financials','management','ownership','procurement','commercial'][n_regionkey % 5 + 1] AS dimension,
  ['high','moderate','low'][n_nationkey % 3 + 1] AS materiality, CASE WHEN n_nationkey % 4 = 0 THEN 'or.justice.cz' WHEN n_nationkey % 4 = 1 THEN 'contracts register' END AS recommended_source FROM nation""")


def hypotheses(spark, sf):
    states = "array('proposed','plausible','supported','contradicted','rejected','unresolved','VERIFIED_PRIMARY')"
    return table(spark, sf, "benchmark").selectExpr(
        "concat('HYP-', item_id) AS id", "concat('subject ', item_id % 5) AS subject", "text AS proposition", f"{states}[item_id % 7] AS state",
        "CASE WHEN item_id % 9 <> 0 THEN 'a public record' END AS falsification",
        "CASE WHEN item_id % 4 <> 0 THEN 'natural person register' END AS next_best_evidence", "array('moderate','low')[item_id % 2] AS materiality",
        f"CASE WHEN item_id % 6 = 0 THEN {EMPTY} ELSE array(concat('CLM-', item_id * 50)) END AS derived_from")


cte("hypotheses", """SELECT 'HYP-' || item_id AS id, 'subject ' || (item_id % 5) AS subject, text AS proposition,
  ['proposed','plausible','supported','contradicted','rejected','unresolved','VERIFIED_PRIMARY'][item_id % 7 + 1] AS state,
  CASE WHEN item_id % 9 <> 0 THEN 'a public record' END AS falsification, CASE WHEN item_id % 4 <> 0 THEN 'natural person register' END AS next_best_evidence,
  ['moderate','low'][item_id % 2 + 1] AS materiality, CASE WHEN item_id % 6 = 0 THEN []::VARCHAR[] ELSE ['CLM-' || (item_id * 50)] END AS derived_from FROM benchmark""")


def runs(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "concat('RUN-', lpad(cast(event_id as string), greatest(12, length(cast(event_id as string))), '0')) AS run_id", "concat('SRC-', user_id) AS source_id",
        "concat('https://p.example/', user_id, '/', get_json_object(props, '$.k')) AS url", "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS finished_at",
        "CASE WHEN event_type = 'error' THEN CASE WHEN value < 8 THEN 'provider_error' ELSE 'http_error' END WHEN event_type = 'signup' AND value < 2 THEN 'fetch_failed' ELSE 'ok' END AS outcome",
        "CASE WHEN event_type = 'error' THEN CASE WHEN value < 8 THEN 500 ELSE 404 END WHEN event_type = 'signup' AND value < 2 THEN NULL ELSE 200 END AS http_status",
        "event_type AS tag", "concat('u', user_id) AS entity", "sha2(props, 256) AS sha256", "ts")


cte("runs", """SELECT 'RUN-' || lpad(event_id::VARCHAR, greatest(12, length(event_id::VARCHAR))::INT, '0') AS run_id, 'SRC-' || user_id AS source_id, 'https://p.example/' || user_id || '/' || (props->>'$.k') AS url,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS finished_at,
  CASE WHEN event_type = 'error' THEN CASE WHEN value < 8 THEN 'provider_error' ELSE 'http_error' END WHEN event_type = 'signup' AND value < 2 THEN 'fetch_failed' ELSE 'ok' END AS outcome,
  CASE WHEN event_type = 'error' THEN CASE WHEN value < 8 THEN 500 ELSE 404 END WHEN event_type = 'signup' AND value < 2 THEN NULL ELSE 200 END AS http_status,
  event_type AS tag, 'u' || user_id AS entity, sha256(props) AS sha256, ts FROM events""")


def artifacts(spark, sf):
    """Documents as stored artifacts; every fifteenth hash is out of date."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id", "concat('tag-', doc_id) AS tag", "concat('case-', doc_id % 9) AS entity", "source AS source_id",
        "CASE WHEN doc_id % 15 = 0 THEN sha2(concat(text, '!'), 256) ELSE sha2(text, 256) END AS sha256",
        "CASE WHEN doc_id % 8 <> 0 THEN concat('store/', doc_id) END AS storage_path",
        "array('PUBLIC','PUBLIC_EXCERPT','RESTRICTED_COPYRIGHT','RESTRICTED_PII')[doc_id % 4] AS pub_class",
        "array('application/pdf','text/html','text/plain','application/json','image/png')[doc_id % 5] AS mime").selectExpr(
        "*", "concat('ART-', substring(sha256, 1, 12)) AS artifact_id")


cte("artifacts", """SELECT *, 'ART-' || substr(sha256, 1, 12) AS artifact_id FROM (SELECT doc_id, 'tag-' || doc_id AS tag, 'case-' || (doc_id % 9) AS entity, source AS source_id,
  CASE WHEN doc_id % 15 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 8 <> 0 THEN 'store/' || doc_id END AS storage_path,
  ['PUBLIC','PUBLIC_EXCERPT','RESTRICTED_COPYRIGHT','RESTRICTED_PII'][doc_id % 4 + 1] AS pub_class,
  ['application/pdf','text/html','text/plain','application/json','image/png'][doc_id % 5 + 1] AS mime, sha256(text) AS true_sha, lang FROM documents)""")


def links(spark, sf):
    """One evidence link per document, of a kind that depends on the document."""
    return table(spark, sf, "documents").selectExpr(
        "CASE WHEN doc_id % 17 = 0 THEN concat('CLM-X', doc_id) ELSE concat('CLM-', doc_id) END AS claim_id", "1 AS link_no",
        "CASE WHEN doc_id % 5 = 1 THEN CASE WHEN doc_id % 7 = 0 THEN 'src77' ELSE source END END AS sourceId",
        "CASE WHEN doc_id % 5 = 2 THEN concat('SP-', doc_id) END AS spanId", "CASE WHEN doc_id % 5 = 4 THEN concat('WS-', doc_id) END AS webSpanId",
        "CASE WHEN doc_id % 5 = 3 THEN concat('SEL-', doc_id) END AS selector", "CASE WHEN doc_id % 5 IN (0, 4) THEN concat('tag-', doc_id + doc_id % 2 * 1000000) END AS artifactTag")


cte("links", """SELECT CASE WHEN doc_id % 17 = 0 THEN 'CLM-X' || doc_id ELSE 'CLM-' || doc_id END AS claim_id, 1 AS link_no,
  CASE WHEN doc_id % 5 = 1 THEN CASE WHEN doc_id % 7 = 0 THEN 'src77' ELSE source END END AS sid, CASE WHEN doc_id % 5 = 2 THEN 'SP-' || doc_id END AS span,
  CASE WHEN doc_id % 5 = 4 THEN 'WS-' || doc_id END AS wspan, CASE WHEN doc_id % 5 = 3 THEN 'SEL-' || doc_id END AS sel,
  CASE WHEN doc_id % 5 IN (0, 4) THEN 'tag-' || (doc_id + doc_id % 2 * 1000000) END AS atag FROM documents""")


def spans(spark, sf):
    """A line of every document, quoted with a stated line that may drift."""
    d = table(spark, sf, "documents").selectExpr("doc_id", "split(text, '\n') AS lines")
    d = d.selectExpr("doc_id", "cast(ceil(size(lines) / 2) as int) AS mid", "lines")
    return d.selectExpr("concat('SP-', doc_id) AS id", "doc_id AS file", "cast(mid + doc_id % 6 as int) AS line",
                        "CASE WHEN doc_id % 9 = 0 THEN 'no such words anywhere' ELSE lines[mid - 1] END AS exact_text")


cte("spans", """SELECT 'SP-' || doc_id AS id, doc_id AS file, (mid + doc_id % 6)::INTEGER AS line, lines, CASE WHEN doc_id % 9 = 0 THEN 'no such words anywhere' ELSE lines[mid] END AS exact_text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, ceil(len(string_split(text, chr(10))) / 2.0)::INTEGER AS mid FROM documents)""")


def web_spans(spark, sf):
    """Two quotes per document: its own words and a benchmark passage."""
    b = table(spark, sf, "benchmark").selectExpr("item_id", "text AS quote")
    d = table(spark, sf, "documents").selectExpr("doc_id", "doc_id % 40 AS item_id", "substring(text, 3, 20) AS own")
    return d.join(b, "item_id", "left").selectExpr("concat('WS-', doc_id) AS id", "concat('tag-', doc_id) AS artifact_tag", "array_compact(array(own, quote)) AS contains")


cte("web_spans", """SELECT 'WS-' || doc_id AS id, 'tag-' || doc_id AS artifact_tag, list_filter([substr(d.text, 3, 20), b.text], lambda x: x IS NOT NULL) AS quotes, d.text AS body
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40""")


def assertions(spark, sf):
    return table(spark, sf, "orders").selectExpr("concat('ASR-', o_orderkey) AS id", "concat('c', o_custkey) AS entity", "o_orderpriority AS predicate",
                                                 "concat('price ', cast(o_totalprice as bigint)) AS value",
                                                 "concat('Person ', o_custkey) AS who_name", "date_format(o_orderdate, 'yyyy-MM-dd') AS who_born",
                                                 "concat('seen in /home/user', o_custkey, '/x.pdf  page ', o_orderkey % 7) AS title")


cte("assertions", """SELECT 'ASR-' || o_orderkey AS id, 'c' || o_custkey AS entity, o_orderpriority AS predicate, o_totalprice, o_orderdate, o_custkey, o_orderkey FROM orders""")


def selectors(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "concat('SEL-', c_custkey) AS id", "concat('c', c_custkey) AS entity",
        "CASE WHEN c_acctbal < 2000 THEN array('1-URGENT', '2-HIGH') ELSE array('5-LOW') END AS predicates")


cte("selectors", """SELECT 'SEL-' || c_custkey AS id, 'c' || c_custkey AS entity, CASE WHEN c_acctbal < 2000 THEN ['1-URGENT', '2-HIGH'] ELSE ['5-LOW'] END AS predicates FROM customer""")
