"""Queries on the data-quality gates, over inputs that hold defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import changes as C
from attestra.operators import evidence as E
from attestra.operators import freshness as N
from attestra.operators import gates as Q
from attestra.operators import overview as O
from attestra.operators import snapshot as S
from attestra.operators.coverage import dimensions, ranked_tasks
from attestra.operators.coverage import questions as investigation_questions
from attestra.operators.extract import union_all
from attestra.plans import evidence as PE
from attestra.plans import evidence_inputs as I
from attestra.plans import figures as PF
from attestra.plans import freshness as PN
from attestra.plans import graphs as PG
from attestra.plans import monitoring as PM
from attestra.plans import temporal as PT
from attestra.plans.inputs import cte, objects, table, with_ctes
from attestra.plans.registry import query

EMPTY = I.EMPTY
out = lambda df: df.select("rule", "object_id")


@query("Q1_sourcing", with_ctes("doc_claims identity doc_sources", """
SELECT 'CLAIM_NO_SOURCE' AS rule, id AS object_id FROM doc_claims WHERE len(sources) = 0 UNION ALL SELECT 'CLAIM_BAD_SOURCE', id FROM (SELECT id, unnest(sources) AS s FROM doc_claims) WHERE s NOT IN (SELECT id FROM doc_sources)
UNION ALL SELECT 'IDENTITY_NO_SOURCE', id FROM identity WHERE len(sources) = 0 UNION ALL SELECT 'IDENTITY_BAD_SOURCE', id FROM (SELECT id, unnest(sources) AS s FROM identity) WHERE s NOT IN (SELECT id FROM doc_sources)"""))
def _(spark, sf):
    return out(Q.sourcing(I.doc_claims(spark, sf), I.identity(spark, sf), I.doc_sources(spark, sf)))


@query("Q2_edges", with_ctes("edges doc_sources", """
, n AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal < 9000 UNION ALL SELECT 'o' || o_orderkey FROM orders)
SELECT 'EDGE_BAD_NODE' AS rule, id AS object_id FROM edges WHERE source NOT IN (SELECT id FROM n) UNION ALL SELECT 'EDGE_NO_SOURCE', id FROM edges WHERE len(sources) = 0 UNION ALL SELECT 'EDGE_NO_WHY', id FROM edges WHERE why IS NULL
UNION ALL SELECT 'EDGE_BAD_SOURCE', id FROM (SELECT id, unnest(sources) AS s FROM edges) WHERE s NOT IN (SELECT id FROM doc_sources)"""))
def _(spark, sf):
    n = table(spark, sf, "customer").filter("c_acctbal < 9000").selectExpr("concat('c', c_custkey) AS id").union(table(spark, sf, "orders").selectExpr("concat('o', o_orderkey) AS id"))
    return out(Q.edges(I.edges(spark, sf), n, I.doc_sources(spark, sf)))


@query("Q3_contradictions", with_ctes("contradictions doc_sources", """
SELECT 'CON_INCOMPLETE' AS rule, id AS object_id FROM contradictions WHERE source_b IS NULL UNION ALL SELECT 'CON_RESOLVED_UNGROUNDED', id FROM contradictions WHERE status = 'RESOLVED' AND (len(resolved_by) = 0 OR resolved_at IS NULL)
UNION ALL SELECT 'CON_STATUS', id FROM contradictions WHERE status = 'OPEN' UNION ALL SELECT 'CON_BAD_SOURCE', id FROM (SELECT DISTINCT id, unnest(list_filter([source_a, source_b], lambda x: x IS NOT NULL)) AS s FROM contradictions) WHERE s NOT IN (SELECT id FROM doc_sources)
UNION ALL SELECT 'CON_BAD_SOURCE', id FROM (SELECT id, unnest(resolved_by) AS s FROM contradictions WHERE status = 'RESOLVED') WHERE s NOT IN (SELECT id FROM doc_sources)"""))
def _(spark, sf):
    return out(Q.contradictions(I.contradictions(spark, sf), I.doc_sources(spark, sf)))


@query("Q4_privacy", """
SELECT 'PII_BIRTH_NUMBER' AS rule, doc_id::VARCHAR AS object_id FROM documents WHERE lang <> 'de' AND (lang = 'es' OR regexp_matches(text, '\\b\\d{6}/\\d{3,4}\\b')) UNION ALL SELECT 'EXPORT_MISSING', doc_id::VARCHAR FROM documents WHERE lang = 'de'""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    texts = d.filter("lang <> 'de'").selectExpr("doc_id AS id", "CASE WHEN lang = 'es' THEN concat(text, ' 850101/1234') ELSE text END AS text")
    return out(Q.privacy(texts, d.select(F.col("doc_id").alias("id"))))


def derived(spark, sf):
    return union_all([df.select("id", "derived_from") for df in (PE.gaps(spark, sf), I.hypotheses(spark, sf), PE.tasks(spark, sf))])


cte("known_ids", "SELECT id FROM doc_claims UNION SELECT id FROM doc_sources UNION SELECT id FROM contradictions UNION SELECT id FROM hypotheses", ["doc_claims", "doc_sources", "contradictions", "hypotheses"])


@query("Q5_derivation", with_ctes("gaps hypotheses tasks known_ids", """
, d AS (SELECT id, [origin] AS df FROM gaps UNION ALL SELECT id, derived_from FROM hypotheses UNION ALL SELECT id, origin FROM tasks)
SELECT 'DERIVED_ORPHAN' AS rule, id AS object_id FROM (SELECT id, unnest(df) AS r FROM d) WHERE r NOT IN (SELECT id FROM known_ids) UNION ALL SELECT 'DERIVED_NO_PROV', id FROM d WHERE len(df) = 0
UNION ALL SELECT 'HYP_BAD_STATE', id FROM hypotheses WHERE state = 'VERIFIED_PRIMARY' UNION ALL SELECT 'HYP_AS_FACT', id FROM hypotheses WHERE state = 'VERIFIED_PRIMARY' UNION ALL SELECT 'HYP_NO_FALSIFICATION', id FROM hypotheses WHERE falsification IS NULL"""))
def _(spark, sf):
    return out(Q.derivation(derived(spark, sf), I.hypotheses(spark, sf), PE.known(spark, sf)))


@query("Q6_coverage", """
SELECT 'ABSENT_NO_GAP' AS rule, unnest(['technical', 'transactions']) AS object_id WHERE (SELECT count(*) FROM orders) > 0""")
def _(spark, sf):
    from attestra.operators.coverage import coverage_matrix

    plain = PE.flat(spark, sf).filter("cat IS NULL OR cat <> 'transactions'")
    return out(Q.coverage(coverage_matrix(plain, I.doc_sources(spark, sf), PE.gaps(spark, sf))))


@query("Q7_frontier", with_ctes("gaps tasks contradictions", """
SELECT 'GAP_BAD_DIM' AS rule, id AS object_id FROM gaps WHERE dimension = 'management' UNION ALL SELECT 'CON_NO_TASK', id FROM contradictions WHERE materiality = 'moderate'"""))
def _(spark, sf):
    dims = dimensions(spark).filter("dimension <> 'management'")
    tasks = PE.tasks(spark, sf).filter("confidence <> 'disputed' OR materiality = 'low'")
    return out(Q.frontier(PE.gaps(spark, sf), dims, I.contradictions(spark, sf), tasks))


@query("Q8_addresses", with_ctes("doc_sources", """
, a AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS b, c_mktsegment AS s FROM customer)
SELECT 'CAD_PUB_CLASS' AS rule, 'adr' || k AS object_id FROM a WHERE s = 'BUILDING' UNION ALL SELECT 'CAD_NATURAL_PERSON', 'adr' || k FROM a WHERE n = 1 UNION ALL SELECT 'CAD_NO_SOURCE', 'adr' || k FROM a WHERE n = 2 UNION ALL SELECT 'CAD_AMBIGUOUS_PUBLISHED', 'adr' || k FROM a WHERE n = 3
UNION ALL SELECT 'CAD_INVENTED_RUIAN', 'adr' || k FROM a WHERE b > 5000 UNION ALL SELECT 'CAD_INVENTED_GEOMETRY', 'adr' || k FROM a WHERE n = 4 UNION ALL SELECT 'CAD_INVENTED_PARCEL', 'adr' || k FROM a WHERE n = 5 UNION ALL SELECT 'CAD_INVENTED_OWNERSHIP', 'adr' || k FROM a WHERE n = 6
UNION ALL SELECT 'CAD_BAD_SOURCE', 'adr' || k FROM a WHERE n <> 2 AND k % 23 >= 20 UNION ALL SELECT 'CAD_NP_COUNT', 'manifest'"""))
def _(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "concat('adr', c_custkey) AS id", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'restricted' ELSE 'public' END AS publication", "CASE WHEN c_nationkey = 1 THEN 'natural_person' ELSE 'legal_entity' END AS owner_type",
        f"CASE WHEN c_nationkey = 2 THEN {EMPTY} ELSE array(concat('src', c_custkey % 23)) END AS sources", "CASE WHEN c_nationkey = 3 THEN 'ambiguous' ELSE 'exact' END AS resolution",
        "CASE WHEN c_acctbal > 4000 THEN 'R1' END AS ruian_id", "c_acctbal <= 5000 AS collected_ruian", "CASE WHEN c_nationkey = 4 THEN '50,14' END AS coordinates", "false AS collected_geometry",
        f"CASE WHEN c_nationkey = 5 THEN array('p') ELSE {EMPTY} END AS parcels", "false AS collected_parcel", "CASE WHEN c_nationkey = 6 THEN 'o' END AS ownership", "false AS collected_ownership")
    return out(Q.addresses(rows, I.doc_sources(spark, sf), published_natural_persons=1))


@query("Q9_planner", with_ctes("diversity edges doc_sources tasks known_ids questions_in gaps contradictions", """
SELECT 'PLAN_SRC_NO_UPSTREAM' AS rule, id AS object_id FROM doc_sources WHERE n % 5 = 3 UNION ALL SELECT 'PLAN_SRC_UNKNOWN', id FROM doc_sources WHERE n >= 18
UNION ALL SELECT 'PLAN_DIV_IMPOSSIBLE', id FROM diversity WHERE ups + 1 > source_records AND status = 'BLOCKED' UNION ALL SELECT 'PLAN_MONOCULTURE_UNFLAGGED', id FROM diversity WHERE ups <= 1 AND status = 'CORROBORATED'
UNION ALL SELECT 'PLAN_TASK_ORPHAN', id FROM (SELECT id, unnest(origin) AS r FROM tasks) WHERE r NOT IN (SELECT id FROM known_ids) UNION ALL SELECT 'PLAN_TASK_NO_WHY', id FROM tasks WHERE priority = 'low'
UNION ALL SELECT 'PLAN_TASK_NO_EIG', id FROM tasks WHERE priority = 'high' UNION ALL SELECT 'PLAN_Q_NO_TASK', 'Q-' || id FROM contradictions"""))
def _(spark, sf):
    registry = I.source_model(spark, sf).withColumn("upstream", F.when(F.col("upstream") == "up3", "unknown").otherwise(F.col("upstream")))
    sources = I.doc_sources(spark, sf)
    div = PE.diversity(spark, sf).withColumn("independent_upstreams", F.col("independent_upstreams") + F.when(F.col("status") == "BLOCKED", 1).otherwise(0)).withColumn("note", F.lit(""))
    tasks = ranked_tasks(PE.tasks(spark, sf))
    blank = lambda n, bad, cond: F.when(cond, F.lit(bad)).otherwise(F.col(n)).alias(n)
    tasks_m = tasks.select("id", "derived_from", blank("why_ranked", "", F.col("priority") == "low"), blank("information_gain", "huge", F.col("priority") == "high"))
    known_tasks = tasks_m.filter("id NOT LIKE 'TASK-CON-%'")
    questions = investigation_questions(PE.gaps(spark, sf), I.contradictions(spark, sf))
    found = Q.investigation(registry, sources.filter("n < 18"), div, tasks_m, questions.filter("category <> 'contradiction'"), PE.verification(spark, sf), PE.known(spark, sf))
    return out(found.unionByName(Q.check_ref(questions.filter("category = 'contradiction'"), "planner", "PLAN_Q_NO_TASK", "id", "linked_task", known_tasks)))


@query("Q10_evidence", with_ctes("doc_claims artifacts spans", """
, shown AS (SELECT id FROM doc_claims WHERE lang <> 'es'), pub AS (SELECT doc_id, artifact_id, pub_class, lang, sha256 <> true_sha AS bad FROM artifacts WHERE storage_path IS NOT NULL)
SELECT 'CLAIM_NO_EVIDENCE' AS rule, id AS object_id FROM doc_claims WHERE NOT superseded AND lang = 'es' UNION ALL SELECT 'SUPERSEDED_LIVE', id FROM doc_claims WHERE superseded AND lang <> 'es' UNION ALL SELECT 'BLOCKED_AS_NOTFOUND', id FROM doc_claims WHERE status = 'NOT_FOUND' AND lang = 'de'
UNION ALL SELECT 'SUPERSEDED_NO_SUCCESSOR', id FROM doc_claims WHERE superseded AND len(successors) = 0 UNION ALL SELECT 'SUPERSEDED_BAD_SUCCESSOR', id FROM (SELECT id, unnest(successors) AS s FROM doc_claims WHERE superseded) WHERE s NOT IN (SELECT id FROM doc_claims WHERE NOT superseded)
UNION ALL SELECT 'ARTIFACT_FILE_MISSING', artifact_id FROM pub WHERE lang = 'es' UNION ALL SELECT 'ARTIFACT_HASH_MISMATCH', artifact_id FROM pub WHERE lang <> 'es' AND bad UNION ALL SELECT 'RESTRICTED_PUBLISHED', artifact_id FROM pub WHERE starts_with(pub_class, 'RESTRICTED') UNION ALL SELECT 'ARTIFACT_PATH_LEAK', artifact_id FROM pub
UNION ALL SELECT 'SPAN_UNVERIFIED', id FROM spans WHERE file % 9 = 0 UNION ALL SELECT 'SPAN_INCOMPLETE', id FROM spans WHERE trim(coalesce(exact_text, '')) = '' AND coalesce(exact_text, '') = ''
UNION ALL SELECT 'PATH_LEAK', 'x' || doc_id FROM documents WHERE lang = 'fr' UNION ALL SELECT 'PII_FULL_BIRTHDATE', 'x' || doc_id FROM documents WHERE lang = 'de' UNION ALL SELECT 'PII_BIRTH_NUMBER', 'x' || doc_id FROM documents WHERE lang = 'es'"""))
def _(spark, sf):
    claims = I.doc_claims(spark, sf)
    inv = claims.filter("lang <> 'es'").selectExpr("id AS claim_id", "CASE WHEN lang = 'de' THEN 'BLOCKED' ELSE 'PARTIAL' END AS category")
    pub = I.artifacts(spark, sf).filter("storage_path IS NOT NULL").selectExpr("artifact_id AS id", "sha256", "pub_class", "storage_path AS download")
    d = table(spark, sf, "documents")
    files = d.filter("lang <> 'es'").selectExpr("concat('store/', doc_id) AS path", "sha2(text, 256) AS sha256")
    spans = I.spans(spark, sf).selectExpr("id", "file % 9 <> 0 AS verified", "exact_text", "1 AS page", "cast(file as string) AS document")
    exports = d.selectExpr("concat('x', doc_id) AS id", """CASE lang WHEN 'fr' THEN 'see /home/x' WHEN 'de' THEN '{"born": "1980-02-03"}' WHEN 'es' THEN 'no 850101/123' ELSE 'clean' END AS text""")
    return out(Q.evidence(claims, inv, pub, files, spans, exports))


@query("Q11_evidence_build", with_ctes("resolved doc_claims selectors selhits spans web_spans artifacts", """
, c AS (SELECT id, trim(regexp_replace(exact_text, '\\s+', ' ', 'g')) AS want, trim(regexp_replace(coalesce(lines[line], ''), '\\s+', ' ', 'g')) AS here, lines, line FROM spans)
SELECT 'LINK_UNKNOWN_' || upper(space) AS rule, claim_id AS object_id FROM resolved WHERE NOT resolved UNION ALL SELECT 'LIVE_CLAIM_WITHOUT_EVIDENCE', id FROM doc_claims WHERE NOT superseded AND id NOT IN (SELECT claim_id FROM resolved)
UNION ALL SELECT 'SUPERSEDED_WITH_LINKS', id FROM doc_claims WHERE superseded AND id IN (SELECT claim_id FROM resolved) UNION ALL SELECT 'SELECTOR_EMPTY', id FROM selectors WHERE id NOT IN (SELECT id FROM selhits)
UNION ALL SELECT 'SPAN_TEXT_NOT_FOUND', id FROM c WHERE NOT (contains(here, want) OR (contains(want, here) AND length(here) > 10)) AND len(list_filter(lines[greatest(line - 3, 1):line + 3], lambda x: contains(trim(regexp_replace(x, '\\s+', ' ', 'g')), want))) = 0
UNION ALL SELECT 'QUOTE_NOT_FOUND', id FROM web_spans WHERE len(list_filter(quotes, lambda q: NOT contains(body, q))) > 0 UNION ALL SELECT CASE WHEN lang = 'es' THEN 'ARTIFACT_FILE_MISSING' ELSE 'ARTIFACT_HASH_MISMATCH' END, artifact_id FROM artifacts WHERE storage_path IS NOT NULL AND (lang = 'es' OR sha256 <> true_sha)"""))
def _(spark, sf):
    d = table(spark, sf, "documents")
    refs = E.resolve_links(I.links(spark, sf), PE.dictionary(spark, sf))
    files = d.filter("lang <> 'es'").select(F.concat(F.lit("store/"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    cites = E.verify_citations(I.spans(spark, sf), d.select(F.col("doc_id").alias("file"), F.col("text").alias("body")))
    quotes = E.verify_quotes(I.web_spans(spark, sf), d.select(F.concat(F.lit("tag-"), "doc_id").alias("artifact_tag"), F.col("text").alias("body")))
    return out(Q.evidence_build(I.doc_claims(spark, sf), refs, E.selector_counts(I.selectors(spark, sf), I.assertions(spark, sf)), cites, quotes, E.verify_artifacts(I.artifacts(spark, sf), files)))


@query("Q12_claims", with_ctes("doc_claims diversity", """
SELECT 'COUNT_LIVE' AS rule, 'live' AS object_id UNION ALL SELECT 'COUNT_STATUS', 'status:BLOCKED' UNION ALL SELECT 'COUNT_ARITHMETIC', 'accounting' UNION ALL SELECT 'COUNT_STATUS_SUM', 'accounting'
UNION ALL SELECT 'NO_JSON', id FROM doc_claims WHERE lang = 'es' UNION ALL SELECT 'NO_PAGE', id FROM doc_claims WHERE lang = 'de' UNION ALL SELECT 'DANGLING_SUCCESSOR', id FROM (SELECT id, unnest(successors) AS s FROM doc_claims) WHERE s NOT IN (SELECT id FROM doc_claims)
UNION ALL SELECT 'SUPERSEDED_NO_SUCCESSOR', id FROM doc_claims WHERE superseded AND len(successors) = 0 UNION ALL SELECT 'SUPERSEDED_NO_REASON', id FROM doc_claims WHERE superseded AND reason IS NULL
UNION ALL SELECT 'JSON_PROP_DRIFT', id FROM doc_claims WHERE lang = 'fr' AND text <> '' UNION ALL SELECT 'JSON_NO_PROP', id FROM doc_claims WHERE lang <> 'es' AND (lang = 'fr' OR text = '') UNION ALL SELECT 'JSON_NO_STATUS_EXPL', id FROM doc_claims WHERE lang <> 'es' AND status = 'ASSESSED'
UNION ALL SELECT 'JSON_BAD_PATH', id FROM doc_claims WHERE lang = 'de' UNION ALL SELECT 'JSON_INDEP', v.id FROM diversity v JOIN doc_claims c USING (id) WHERE c.lang <> 'es' AND v.ups + 1 > v.source_records AND v.status = 'CORROBORATED'
UNION ALL SELECT 'JSON_INTERNAL_PATH', id FROM doc_claims WHERE lang = 'fr' UNION ALL SELECT 'JSON_PII', id FROM doc_claims WHERE lang = 'de' UNION ALL SELECT 'NARRATIVE_UNKNOWN_CLM', 'conv' || conv_id FROM conversations WHERE 'CLM-' || (conv_id * 10) NOT IN (SELECT id FROM doc_claims)"""))
def _(spark, sf):
    claims = I.doc_claims(spark, sf)
    acc = O.claim_accounting(claims).withColumn("value", F.col("value") + F.when(F.col("measure").isin("live", "status:BLOCKED"), 1).otherwise(0))
    div = PE.diversity(spark, sf).select("id", (F.col("independent_upstreams") + F.when(F.col("status") == "CORROBORATED", 1).otherwise(0)).alias("independent_upstreams"), "source_records")
    shards = claims.filter("lang <> 'es'").join(div, "id").selectExpr(
        "id", "CASE WHEN lang = 'fr' THEN '' ELSE text END AS proposition", "CASE WHEN status <> 'ASSESSED' THEN 'why' END AS status_explanation", "concat(CASE WHEN lang = 'de' THEN '/c/' ELSE '/claims/' END, lower(id), '/') AS path",
        "independent_upstreams", "source_records", "CASE lang WHEN 'fr' THEN '/Users/a/b' WHEN 'de' THEN '850101/1234' ELSE 'ok' END AS body")
    narrative = table(spark, sf, "conversations").selectExpr("concat('conv', conv_id) AS document", "concat('CLM-', conv_id * 10) AS claim_id")
    return out(Q.claim_outputs(claims, acc, shards, narrative, claims.filter("lang <> 'de'").select("id")))


@query("Q13_finance", with_ctes("facts statements", """
, f AS (SELECT *, substr(entity, 2)::BIGINT AS k FROM facts), m AS (SELECT a.id AS num, b.id AS den, a.entity, a.period, a.entity || a.period AS id, a.k FROM f a JOIN f b ON a.entity = b.entity AND a.period = b.period AND a.concept = 'net_result' AND b.concept = 'net_turnover')
SELECT 'FACT_NO_SOURCE' AS rule, id AS object_id FROM f WHERE k % 5 = 0 UNION ALL SELECT 'FACT_NO_UNIT', id FROM f WHERE k % 7 = 0 UNION ALL SELECT 'FACT_BAD_STATUS', id FROM f WHERE concept = 'total_equity' UNION ALL SELECT 'FACT_BAD_VALUE', id FROM f WHERE concept = 'total_assets' AND k % 3 = 0
UNION ALL SELECT 'MET_NO_FORMULA', id FROM m WHERE k % 4 = 0 UNION ALL SELECT 'MET_NO_CAVEAT', id FROM m WHERE k % 3 = 0 UNION ALL SELECT 'MET_NO_DEN', id FROM m WHERE period = 'FY1999' UNION ALL SELECT 'MET_NO_VALUE', id FROM m WHERE k % 2 = 0 UNION ALL SELECT 'MET_ORPHAN_FACT', id FROM m WHERE k % 6 = 0
UNION ALL SELECT 'CVF_NO_PERIMETER_FLAG', s.id FROM statements s JOIN facts x ON x.entity = s.entity AND x.concept = 'net_turnover' AND x.period = 'FY2000' AND regexp_matches(s.metric, 'revenue target') UNION ALL SELECT 'CVF_TARGET_AS_FACT', id FROM statements WHERE regexp_matches(metric, 'target') AND NOT regexp_matches(metric, 'revenue')
UNION ALL SELECT 'GAP_AS_ZERO', 'GAP-FIN-' || p_partkey FROM part WHERE p_size = 1 UNION ALL SELECT 'GAP_BAD_STATE', 'GAP-FIN-' || p_partkey FROM part WHERE p_size = 2
UNION ALL SELECT 'CMP_NOT_LABELLED', 'cmp' || k FROM (SELECT DISTINCT k FROM f WHERE k % 2 = 1) UNION ALL SELECT 'CMP_NO_CAVEATS', 'cmp' || k FROM (SELECT DISTINCT k FROM f WHERE k % 3 = 1) UNION ALL SELECT 'CMP_ORPHAN_B', 'cmp' || k FROM (SELECT DISTINCT k FROM f)
UNION ALL SELECT 'NO_RECON', 'reconciliation' UNION ALL SELECT 'FIN_PII', id FROM f WHERE k % 9 = 0"""))
def _(spark, sf):
    f = PF.facts(spark, sf).withColumn("k", F.substring("entity", 2, 20).cast("bigint"))
    bad = f.selectExpr("id", "entity", "concept", "period", "k", "CASE WHEN concept = 'total_assets' AND k % 3 = 0 THEN double('NaN') ELSE value END AS value", "CASE WHEN k % 7 <> 0 THEN unit END AS unit",
                       "CASE WHEN concept = 'total_equity' THEN 'GUESS' ELSE status END AS status", f"CASE WHEN k % 5 = 0 THEN {EMPTY} ELSE array('s') END AS sources")
    num = f.filter("concept = 'net_result'").selectExpr("entity", "period", "k", "id AS num")
    den = f.filter("concept = 'net_turnover'").selectExpr("entity", "period", "id AS den")
    m = num.join(den, ["entity", "period"]).selectExpr(
        "concat(entity, period) AS id", "CASE WHEN k % 4 <> 0 THEN 'a / b' END AS formula", "array(CASE WHEN k % 6 = 0 THEN 'nowhere' ELSE num END) AS numerator_facts", f"CASE WHEN period = 'FY1999' THEN {EMPTY} ELSE array(den) END AS denominator_facts",
        "CASE WHEN k % 2 <> 0 THEN 1.0D END AS value", "CASE WHEN k % 3 <> 0 THEN 'thin' ELSE '' END AS caveats")
    from attestra.operators.finance import claims_vs_filed

    cvf = claims_vs_filed(PF.statements(spark, sf), PF.facts(spark, sf), "FY2000").withColumn("perimeter_mismatch", F.lit(None).cast("boolean"))
    cvf = cvf.withColumn("classification", F.when(F.col("metric").rlike("revenue"), F.col("classification")).otherwise("COMPANY CLAIM"))
    gaps = PF.missing(spark, sf).join(table(spark, sf, "part").selectExpr("concat('GAP-FIN-', p_partkey) AS id", "p_size"), "id").selectExpr("id", "CASE WHEN p_size = 1 THEN 0.0D END AS value", "CASE WHEN p_size = 2 THEN 'LOST' ELSE 'NOT_FOUND' END AS state")
    scale = f.groupBy("k").agg(F.min("id").alias("fact_a")).selectExpr("concat('cmp', k) AS id", "CASE WHEN k % 2 = 0 THEN 'NON-CONSOLIDATED' ELSE 'group' END AS perimeter", f"CASE WHEN k % 3 = 1 THEN {EMPTY} ELSE array('c') END AS caveats",
                                                                       "'FY2000' AS period_a", "'FY1999' AS period_b", "'https://x' AS source_url", "array('d') AS derived_from", "fact_a", "'FIN-NONE' AS fact_b")
    texts = f.selectExpr("id", "CASE WHEN k % 9 = 0 THEN '850101/1234' ELSE 'ok' END AS text")
    return out(Q.finance(bad, m, cvf, gaps, scale, f.filter("concept = 'none'"), texts))


cte("mutated", "SELECT *, CASE WHEN object_type = 'source' AND seq = 5 AND object_id LIKE '%7' THEN reverse(content_hash) ELSE content_hash END AS shown FROM objects", ["objects"])


@query("Q14_snapshots", with_ctes("mutated snaps", """
SELECT 'CONTENT_HASH_MISMATCH' AS rule, snapshot_id || ':' || object_type || ':' || object_id AS object_id FROM mutated WHERE shown <> content_hash UNION ALL SELECT 'REVISION_ID_MALFORMED', snapshot_id || ':' || object_type || ':' || object_id FROM mutated WHERE shown <> content_hash
UNION ALL SELECT 'DUPLICATE_OBJECT', 'SNAP-07:source:' || object_id FROM mutated WHERE seq = 7 AND object_type = 'source' AND tier = 2 UNION ALL SELECT unnest(['MANIFEST_HASH', 'OBJECT_MANIFEST_HASH']), unnest(['SNAP-05', 'SNAP-05']) UNION ALL SELECT unnest(['MANIFEST_HASH', 'OBJECT_MANIFEST_HASH']), unnest(['SNAP-07', 'SNAP-07'])
UNION ALL SELECT 'MIRROR_MISSING', 'SNAP-02' UNION ALL SELECT 'MISSING_FILES', 'SNAP-03' UNION ALL SELECT 'CUTOFF_DISAGREES', 'SNAP-06' UNION ALL SELECT 'BROKEN_LINK', 'SNAP-04' UNION ALL SELECT 'CURRENT_POINTER', 'SNAP-08' UNION ALL SELECT 'CANONICAL_DRIFT', (SELECT max(snapshot_id) FROM snaps)"""))
def _(spark, sf):
    o = objects(spark, sf)
    good = S.build_snapshot(o)
    wrong = (F.col("object_type") == "source") & (F.col("snapshot_sequence") == 5) & F.col("object_id").endswith("7")
    shown = o.withColumn("content_hash", F.when(wrong, F.reverse("content_hash")).otherwise(F.col("content_hash")))
    again = o.filter((F.col("snapshot_sequence") == 7) & (F.col("object_type") == "source") & (F.get_json_object("payload", "$.tier") == "2"))
    from attestra.session import cut_lineage

    good = cut_lineage(good)
    manifests = good.filter("snapshot_id <> 'SNAP-03'").withColumn("evidence_cutoff", F.when(F.col("snapshot_id") == "SNAP-06", "x").otherwise(F.col("evidence_cutoff")))
    index = good.withColumn("previous_snapshot_id", F.when(F.col("snapshot_id") == "SNAP-04", "SNAP-01").otherwise(F.col("previous_snapshot_id")))
    current = good.filter("snapshot_id = 'SNAP-08'").select("snapshot_id", "content_hash")
    live = good.filter("snapshot_id = 'SNAP-01'").select("content_hash")
    return out(Q.snapshots(shown.unionByName(again), manifests, index, good.filter("snapshot_id <> 'SNAP-02'"), current, live))


@query("Q15_changes", with_ctes("changed pairs", """
, kept AS (SELECT * FROM changed WHERE NOT (change_kind = 'removed' AND object_id LIKE '%9'))
SELECT 'DIFFERENCE_WITHOUT_RECORD' AS rule, to_snapshot_id || ':removed:' || object_type || ':' || object_id AS object_id FROM changed WHERE change_kind = 'removed' AND object_id LIKE '%9'
UNION ALL SELECT 'OLD_REVISION_MISSING', change_id FROM kept WHERE change_kind = 'changed' AND object_id LIKE '%8' UNION ALL SELECT unnest(['RECONCILIATION_DRIFT', 'TO_IDENTITY']), 'SNAP-04' UNION ALL SELECT 'MATERIAL_WITHOUT_ROUTE', change_id FROM kept WHERE cls[2] = 'MEDIUM'
UNION ALL SELECT 'ROUTE_FOR_IMMATERIAL', change_id FROM kept WHERE cls[2] = 'LOW' UNION ALL SELECT 'MANIFEST_NOT_CURRENT', 'SNAP-02'"""))
def _(spark, sf):
    from attestra.session import stored

    o = objects(spark, sf)
    d = PT.stored_diffs(spark, sf)
    rec = PT.changes(spark, sf).filter("NOT (change_kind = 'removed' AND object_id LIKE '%9')")
    rec = stored(rec.withColumn("old_revision_id", F.when((F.col("change_kind") == "changed") & F.col("object_id").endswith("8"), "x").otherwise(F.col("old_revision_id"))))
    told = C.reconciliation(d).drop("to_identity", "from_identity").withColumn("objects_added", F.col("objects_added") + F.when(F.col("to_snapshot_id") == "SNAP-04", 1).otherwise(0))
    current = o.filter("snapshot_sequence = 2").select("snapshot_id").distinct()
    return out(Q.changes(rec, d, told, o, current, rec.filter("materiality IN ('HIGH', 'LOW')").select("change_id")))


@query("Q15_numbering", with_ctes("changed", """
SELECT 'NUMBERING' AS rule, change_id || 'x' AS object_id FROM changed WHERE object_type = 'source'"""))
def _(spark, sf):
    c = PT.changes(spark, sf)
    return out(Q.numbering(c.withColumn("change_id", F.when(F.col("object_type") == "source", F.concat("change_id", F.lit("x"))).otherwise(F.col("change_id")))))


@query("U3_reconcile_sets", """
SELECT 'DIFFERENCE_WITHOUT_RECORD' AS rule, o_orderkey::VARCHAR AS object_id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'RECORD_WITHOUT_DIFFERENCE', 'x' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    a = o.selectExpr("cast(o_orderkey as string) AS key")
    b = o.filter("o_orderstatus <> 'F'")
    b = b.selectExpr("cast(o_orderkey as string) AS key").union(b.filter("o_orderpriority = '1-URGENT'").selectExpr("concat('x', o_orderkey)"))
    return out(Q.reconcile_sets(a, b))


@query("Q16_freshness", with_ctes("fresh", """
, plan AS (SELECT * FROM fresh WHERE current_state IN ('BLOCKED', 'STALE', 'DUE', 'DUE_SOON') AND object_id NOT LIKE '%3')
SELECT 'BLOCKED_NOT_PLANNED' AS rule, object_id FROM fresh WHERE current_state = 'BLOCKED' AND object_id LIKE '%3' UNION ALL SELECT 'HIGH_OVERDUE', object_id FROM fresh WHERE current_state IN ('DUE', 'STALE') AND materiality = 'HIGH'
UNION ALL SELECT 'TASK_NO_PROVIDER', 'REV-' || object_id FROM plan WHERE policy_id = 'web-media' UNION ALL SELECT 'TASK_NO_STOP', 'REV-' || object_id FROM plan WHERE object_type = 'source' UNION ALL SELECT 'AS_OF_DIFFERS', '2005-01-20'"""))
def _(spark, sf):
    fresh = PN.fresh(spark, sf)
    plan = N.revalidation_plan(fresh).filter("object_id NOT LIKE '%3'")
    plan = plan.withColumn("recommended_provider", F.when(F.col("policy_id") != "web-media", F.col("recommended_provider"))).withColumn("stop_condition", F.when(F.col("object_type") != "source", F.col("stop_condition")))
    return out(Q.freshness(fresh, plan, PN.AS_OF, PN.CUTOFF))


def inference_records(spark, sf):
    """Inferences with the fields a complete record has, and holes in them."""
    return PG.inferences(spark, sf).selectExpr(
        "CASE WHEN doc_id < 20 THEN 'INF-early' ELSE id END AS id", "produces", "premises", "lang", f"CASE WHEN lang = 'es' THEN {EMPTY} ELSE array('step') END AS steps", "assumptions", "CASE WHEN lang <> 'fr' THEN 'reading' END AS primary_explanation",
        "array(named_struct('text', id, 'distinguishing_evidence', CASE WHEN lang = 'de' THEN '' ELSE 'a filing' END)) AS alternatives", f"CASE WHEN lang = 'fr' THEN {EMPTY} ELSE array('f') END AS falsify", f"{EMPTY} AS strengthen", "uncertainty")


@query("Q17_reasoning", with_ctes("inferences doc_claims", """
, i AS (SELECT *, CASE WHEN doc_id < 20 THEN 'INF-early' ELSE id END AS rid FROM inferences), p AS (SELECT rid, unnest(refs) AS ref, unnest(roles) AS role FROM i)
SELECT 'NO_INFERENCE' AS rule, id AS object_id FROM doc_claims WHERE status = 'BLOCKED' UNION ALL SELECT 'DUPLICATE_INFERENCE', 'INF-early' WHERE (SELECT count(*) FROM i WHERE rid = 'INF-early') > 1
UNION ALL SELECT 'UNKNOWN_PREMISE', rid FROM p WHERE ref NOT IN (SELECT id FROM doc_claims) UNION ALL SELECT 'SUPERSEDED_PREMISE', rid FROM p WHERE ref IN (SELECT id FROM doc_claims WHERE superseded) UNION ALL SELECT 'INVALID_ROLE', rid FROM p WHERE role = 'guesses'
UNION ALL SELECT 'BROKEN_CHAIN', rid FROM p WHERE role = 'supports' AND ref NOT IN (SELECT id FROM doc_claims) UNION ALL SELECT 'UNKNOWN_ASSUMPTION', rid FROM i WHERE lang = 'de' UNION ALL SELECT 'NO_STEPS', rid FROM i WHERE lang = 'es' UNION ALL SELECT 'NO_EXPLANATION', rid FROM i WHERE lang = 'fr'
UNION ALL SELECT 'ALTERNATIVE_WITHOUT_EVIDENCE', rid FROM i WHERE lang = 'de' UNION ALL SELECT 'NO_COUNTERFACTUALS', rid FROM i WHERE lang = 'fr' UNION ALL SELECT 'NO_UNCERTAINTY', rid FROM i WHERE lang = 'de'"""))
def _(spark, sf):
    claims = I.doc_claims(spark, sf)
    must = claims.filter("status IN ('ASSESSED', 'BLOCKED')")
    backed = claims.selectExpr("id", "true AS evidence_backed")
    asm = table(spark, sf, "documents").filter("lang <> 'de'").selectExpr("concat('ASM-', lang) AS id").distinct()
    return out(Q.reasoning(inference_records(spark, sf), must, claims.select("id"), claims.filter("superseded"), backed, asm))


@query("Q18_findings_graph", with_ctes("findings conflicts doc_claims doc_sources contradictions rnodes redges inferences", """
, s AS (SELECT id, unnest(refs) AS ref FROM findings), k AS (SELECT id FROM doc_claims UNION SELECT id FROM doc_sources WHERE n < 19)
SELECT 'FINDING_UNKNOWN_SUPPORT' AS rule, id AS object_id FROM s WHERE ref NOT IN (SELECT id FROM k) UNION ALL SELECT 'FINDING_ON_SUPERSEDED', id FROM s WHERE ref IN (SELECT id FROM doc_claims WHERE superseded) UNION ALL SELECT 'FINDING_NOT_ANCHORED', id FROM s WHERE ref NOT IN (SELECT 'CLM-' || doc_id FROM documents WHERE lang = 'en')
UNION ALL SELECT 'FINDING_NOT_BACKED', id FROM findings f WHERE NOT EXISTS (SELECT 1 FROM s JOIN doc_claims c ON c.id = s.ref WHERE s.id = f.id AND c.lang = 'en') UNION ALL SELECT 'FINDING_NO_UNCERTAINTY', id FROM findings WHERE reasoning IS NULL
UNION ALL SELECT 'FINDING_UNKNOWN_REASONING', id FROM findings WHERE reasoning IS NOT NULL AND reasoning NOT IN (SELECT id FROM inferences) UNION ALL SELECT 'SILENT_CONFLICT', id FROM contradictions WHERE status = 'OPEN'
UNION ALL SELECT 'CONFLICT_UNKNOWN_SIDE', id FROM (SELECT id, unnest(list_distinct(list_concat(side_a, side_b))) AS r FROM conflicts WHERE id NOT IN (SELECT id FROM contradictions WHERE status = 'OPEN')) WHERE r NOT IN (SELECT id FROM k)
UNION ALL SELECT 'CONFLICT_NO_UNCERTAINTY', id FROM conflicts WHERE remaining_uncertainty IS NULL AND id NOT IN (SELECT id FROM contradictions WHERE status = 'OPEN') UNION ALL SELECT 'METHOD_FIELD_MISSING', r_name FROM region WHERE r_regionkey > 2
UNION ALL SELECT 'DANGLING_EDGE', "from" FROM redges WHERE "from" NOT IN (SELECT id FROM rnodes WHERE kind <> 'assertion') UNION ALL SELECT 'DANGLING_EDGE', "to" FROM redges WHERE "to" NOT IN (SELECT id FROM rnodes WHERE kind <> 'assertion') UNION ALL SELECT 'EDGE_WITHOUT_ORIGIN', "from" FROM redges WHERE via = 'premises'
UNION ALL SELECT 'WHY_INDEX_MISSING', id FROM rnodes WHERE kind = 'assessment'"""))
def _(spark, sf):
    claims = I.doc_claims(spark, sf)
    known = claims.select("id").union(I.doc_sources(spark, sf).filter("n < 19").select("id"))
    cons = I.contradictions(spark, sf)
    conflicts = PG.conflicts(spark, sf).join(cons.filter("status = 'OPEN'").select("id"), "id", "left_anti")
    findings = PG.findings(spark, sf).withColumn("uncertainty", F.when(F.col("reasoning").isNotNull(), F.array(F.lit("u"))))
    backed = claims.filter("lang = 'en'").selectExpr("id", "true AS evidence_backed")
    anchored = claims.filter("lang = 'en'").select(F.col("id").alias("claim_id"))
    method = table(spark, sf, "region").selectExpr("r_name AS field", "CASE WHEN r_regionkey <= 2 THEN 'stated' END AS value")
    n, e = PG.reasoning(spark, sf)
    shown = n.filter("kind <> 'assertion'")
    why = n.filter("kind <> 'assessment'").select(F.col("id").alias("node"))
    e = e.withColumn("via", F.when(F.col("via") != "premises", F.col("via")))
    return out(Q.findings_and_graph(findings, PG.inferences(spark, sf), conflicts, cons, claims, known, claims.filter("superseded"), backed, anchored, method, shown, e, why))


@query("Q19_monitoring", with_ctes("gated executions", """
SELECT 'LEAKED_CANDIDATE' AS rule, id AS object_id FROM gated WHERE gate_status IN ('PENDING_REVIEW', 'REJECTED') UNION ALL SELECT 'COUNT_MISMATCH', 'health' UNION ALL SELECT 'CALL_CAP_EXCEEDED', run_id FROM executions GROUP BY run_id HAVING count(*) > 4 UNION ALL SELECT 'NO_NOTE', NULL WHERE false"""))
def _(spark, sf):
    from attestra.operators.monitor import publish_counts

    gated = PM.gated(spark, sf)
    truth = publish_counts(PM.run_rows(spark, sf), gated, PM.results(spark, sf))
    told = truth.withColumn("value", F.col("value") + F.when(F.col("measure") == "health", 1).otherwise(0))
    return out(Q.monitoring(gated, told, truth, PM.executions(spark, sf), "snapshot of the loop"))


@query("Q20_record_shape", """
SELECT rule, event_id::VARCHAR AS object_id FROM (SELECT event_id, unnest(CASE event_type WHEN 'error' THEN ['NOT_A_RECORD'] WHEN 'click' THEN ['MISSING note', 'TYPE k'] WHEN 'view' THEN ['NULL k'] ELSE [] END) AS rule FROM events)""")
def _(spark, sf):
    body = """CASE event_type WHEN 'error' THEN '{oops' WHEN 'click' THEN concat('{"k": "', value, '", "tags": []}') WHEN 'view' THEN '{"k": null, "note": null, "tags": ["a"]}' ELSE concat('{"k": ', value, ', "note": "n", "tags": []}') END"""
    rec = table(spark, sf, "events").selectExpr("event_id AS id", f"{body} AS json")
    return out(Q.record_shape(rec, {"k": "number", "note": "string?", "tags": "array"}))

