"""Queries on the monitoring loop, batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import monitor as M
from attestra.plans.evidence_inputs import runs as provider_runs
from attestra.plans.inputs import cte, table, with_ctes
from attestra.plans.registry import query

NOW = "2024-02-01 00:00:00"
POLICY = "corporate-identity"


def expected(spark, sf):
    """Two providers for every customer."""
    return table(spark, sf, "customer").selectExpr("concat('t', c_custkey) AS target", "explode(array('p1', 'p2')) AS provider")


def records(spark, sf):
    """Customers as seen by two providers, with every kind of failure."""
    c = table(spark, sf, "customer").withColumn("target", F.concat(F.lit("t"), "c_custkey"))
    p1 = c.filter("c_acctbal <= 9500").selectExpr(
        "'p1' AS provider", "target", "CASE WHEN c_acctbal < -500 THEN 'TIMEOUT' WHEN c_acctbal < 0 THEN 'UNAVAILABLE' ELSE 'OK' END AS status",
        "map('legalName', c_name, 'ico', concat('CZ', c_custkey), 'status', c_mktsegment, 'address', concat('nation ', c_nationkey)) AS fields", "c_acctbal BETWEEN 9000 AND 9100 AS corrupt")
    p2 = c.selectExpr(
        "'p2' AS provider", "target", "'OK' AS status",
        "CASE WHEN c_nationkey <> 3 THEN map('owners', concat('owner ', c_nationkey % 4), 'statutoryBody', concat('body ', c_nationkey % 2), 'address', concat('seat ', c_nationkey % 5)) END AS fields", "false AS corrupt")
    return p1.unionByName(p2)


def precedence(spark, sf):
    return table(spark, sf, "region").filter("r_regionkey IN (1, 2)").selectExpr("concat('p', r_regionkey) AS provider", "r_regionkey AS position")


def baseline(spark, sf):
    """What was known before; nation 5 was never observed."""
    c = table(spark, sf, "customer").filter("c_nationkey <> 5").withColumn("target", F.concat(F.lit("t"), "c_custkey"))
    known = c.selectExpr("target", """explode(map('legalName', CASE WHEN c_acctbal BETWEEN 1000 AND 2000 THEN concat('Old ', c_name) ELSE c_name END, 'status', CASE WHEN c_nationkey < 4 THEN 'DORMANT' ELSE c_mktsegment END,
        'owners', concat('owner ', c_nationkey % 3), 'statutoryBody', CASE WHEN c_nationkey > 20 THEN '' ELSE 'body 0' END, 'website', 'w')) AS (field, value)""")
    return known


def results(spark, sf):
    return M.provider_results(expected(spark, sf), records(spark, sf))


def observed(spark, sf):
    return M.merge_observations(results(spark, sf), precedence(spark, sf))


def candidates(spark, sf):
    return M.classify_candidates(M.candidate_transitions(baseline(spark, sf), observed(spark, sf), NOW, POLICY))


def approvals(spark, sf):
    """Review labels as decisions on the owner changes of some targets."""
    return table(spark, sf, "labels").selectExpr(
        f"concat('cand:run:sub:t', doc_id, ':{POLICY}:{NOW}:', CASE WHEN toxic = 1 THEN 'legalName' ELSE 'owners' END) AS candidate_id", "CASE WHEN quality = 1 THEN 'approve' ELSE 'reject' END AS decision",
        "'reviewer' AS reviewer", "'2024-02-02' AS at")


def gated(spark, sf):
    return M.review_gate(candidates(spark, sf), approvals(spark, sf))


cte("results", """
  SELECT 't' || c_custkey AS target, 'p1' AS provider, c_acctbal > 9500 AS missing, c_acctbal BETWEEN 9000 AND 9100 AS corrupt, CASE WHEN c_acctbal < -500 THEN 'TIMEOUT' WHEN c_acctbal < 0 THEN 'UNAVAILABLE' ELSE 'OK' END AS raw, true AS has,
    [{'f': 'legalName', 'v': c_name}, {'f': 'ico', 'v': 'CZ' || c_custkey}, {'f': 'status', 'v': c_mktsegment}, {'f': 'address', 'v': 'nation ' || c_nationkey}] AS fields FROM customer
  UNION ALL SELECT 't' || c_custkey, 'p2', false, false, 'OK', c_nationkey <> 3, [{'f': 'owners', 'v': 'owner ' || (c_nationkey % 4)}, {'f': 'statutoryBody', 'v': 'body ' || (c_nationkey % 2)}, {'f': 'address', 'v': 'seat ' || (c_nationkey % 5)}] FROM customer""")
cte("graded", """SELECT *, CASE WHEN missing THEN 'UNAVAILABLE' WHEN corrupt THEN 'ERROR' WHEN raw = 'OK' AND has THEN 'OK' WHEN raw IN ('UNAVAILABLE', 'ERROR') THEN raw ELSE 'ERROR' END AS status,
  CASE WHEN missing THEN 'fixture-missing' WHEN corrupt THEN 'fixture-parse-failed' WHEN raw = 'OK' AND NOT has THEN 'fixture-ok-missing-fields' WHEN raw IN ('UNAVAILABLE', 'ERROR') THEN lower(raw) WHEN raw <> 'OK' THEN 'fixture-unknown-status' END AS error FROM results""", ["results"])
cte("observed_fields", "SELECT target, f.f AS field, arg_max(f.v, provider) AS value, max(provider) AS provider FROM (SELECT target, provider, unnest(fields) AS f FROM graded WHERE status = 'OK') GROUP BY 1, 2", ["graded"])
cte("baseline", """SELECT target, b.f AS field, b.v AS value FROM (SELECT 't' || c_custkey AS target, unnest([{'f': 'legalName', 'v': CASE WHEN c_acctbal BETWEEN 1000 AND 2000 THEN 'Old ' || c_name ELSE c_name END}, {'f': 'status', 'v': CASE WHEN c_nationkey < 4 THEN 'DORMANT' ELSE c_mktsegment END},
  {'f': 'owners', 'v': 'owner ' || (c_nationkey % 3)}, {'f': 'statutoryBody', 'v': CASE WHEN c_nationkey > 20 THEN '' ELSE 'body 0' END}, {'f': 'website', 'v': 'w'}]) AS b FROM customer WHERE c_nationkey <> 5)""")
cte("cands", f"""SELECT 'cand:run:sub:' || o.target || ':{POLICY}:{NOW}:' || o.field AS id, 'run:sub:' || o.target || ':{POLICY}:{NOW}' AS run_id, o.target, o.field, b.value AS before, o.value AS after, o.field IN ('statutoryBody', 'owners') AS requires_review
  FROM observed_fields o JOIN baseline b ON b.target = o.target AND b.field = o.field WHERE o.field IN ('legalName', 'ico', 'statutoryBody', 'owners', 'address', 'status') AND b.value <> '' AND o.value <> '' AND b.value <> o.value""", ["observed_fields", "baseline"])
cte("gated", f"""SELECT c.*, a.decision, CASE WHEN a.decision = 'reject' THEN 'REJECTED' WHEN a.decision = 'approve' THEN 'APPROVED' WHEN requires_review THEN 'PENDING_REVIEW' ELSE 'AUTO_APPROVED' END AS gate_status
  FROM cands c LEFT JOIN (SELECT 'cand:run:sub:t' || doc_id || ':{POLICY}:{NOW}:' || CASE WHEN toxic = 1 THEN 'legalName' ELSE 'owners' END AS cid, min(CASE WHEN quality = 1 THEN 'approve' ELSE 'reject' END) AS decision FROM labels GROUP BY 1) a ON a.cid = c.id""", ["cands"])


@query("S6_provider_results", with_ctes("graded", "SELECT target, provider, status = 'OK' AS ok, status, error, CASE WHEN status = 'OK' THEN len(fields) ELSE NULL END::BIGINT AS fields FROM graded"))
def _(spark, sf):
    r = results(spark, sf)
    return r.withColumn("fields", F.when(F.col("fields").isNotNull(), F.size("fields").cast("bigint")))


@query("U6_merge_observations", with_ctes("observed_fields", "SELECT target, field, value, provider FROM observed_fields"))
def _(spark, sf):
    return observed(spark, sf)


@query("U7_merge_baseline", with_ctes("baseline observed_fields", "SELECT target, field, CASE WHEN o.target IS NOT NULL THEN o.value ELSE b.value END AS value FROM baseline b FULL OUTER JOIN observed_fields o USING (target, field)"))
def _(spark, sf):
    return M.merge_baseline(baseline(spark, sf), observed(spark, sf))


@query("E23_candidate_transitions", with_ctes("cands", f"SELECT id, run_id, target, field, before, after, '{NOW}' AS detected_at FROM cands"))
def _(spark, sf):
    return M.candidate_transitions(baseline(spark, sf), observed(spark, sf), NOW, POLICY)


@query("E24_classify_candidates", with_ctes("cands", "SELECT id, CASE WHEN requires_review THEN 'high' ELSE 'normal' END AS materiality, requires_review FROM cands"))
def _(spark, sf):
    return candidates(spark, sf).select("id", "materiality", "requires_review")


@query("J14_review_gate", with_ctes("gated", "SELECT id, decision, gate_status FROM gated"))
def _(spark, sf):
    return gated(spark, sf).select("id", "decision", "gate_status")


@query("P10_is_publishable", with_ctes("gated", "SELECT id, gate_status FROM gated WHERE gate_status IN ('APPROVED', 'AUTO_APPROVED')"))
def _(spark, sf):
    return M.is_publishable(gated(spark, sf)).select("id", "gate_status")


def subscriptions(spark, sf):
    """A customer's last order is the last run of its subscription."""
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("last_run_at"))
    c = table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.selectExpr("concat('sub:t', c_custkey) AS id", "concat('t', c_custkey) AS target", "last_run_at")


@query("R2_due_subscriptions", """
SELECT 'sub:t' || c_custkey AS id, 't' || c_custkey AS target, strftime(m, '%Y-%m-%d %H:%M:%S') AS last_run_at, floor((epoch(TIMESTAMP '2001-08-01 00:00:00') - epoch(m)) / 86400)::BIGINT AS age_days,
  CASE WHEN m IS NULL THEN 'never-run' WHEN floor((epoch(TIMESTAMP '2001-08-01 00:00:00') - epoch(m)) / 86400) >= 30 THEN 'cadence-elapsed' ELSE 'within-cadence' END AS reason,
  m IS NULL OR floor((epoch(TIMESTAMP '2001-08-01 00:00:00') - epoch(m)) / 86400) >= 30 AS due, strftime(m + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS next_due_at
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(spark, sf):
    return M.due_subscriptions(subscriptions(spark, sf), "2001-08-01 00:00:00")


def executions(spark, sf):
    """A user's events of one day as the executions of one run."""
    return provider_runs(spark, sf).selectExpr("concat(source_id, ':', substring(finished_at, 1, 10)) AS run_id", "finished_at AS position", "run_id AS provider", "outcome = 'ok' AS ok", "outcome AS status", "finished_at AS at")


cte("executions", """SELECT source_id || ':' || substr(finished_at, 1, 10) AS run_id, run_id AS provider, outcome = 'ok' AS ok, outcome AS status, finished_at AS "at", row_number() OVER (PARTITION BY source_id, substr(finished_at, 1, 10) ORDER BY finished_at, run_id) AS n FROM runs""", ["runs"])


@query("R6_cap_calls", with_ctes("executions", """
SELECT run_id, provider, ok, status, "at" FROM executions WHERE n <= 4 UNION ALL SELECT run_id, NULL, false, 'provider-call-limit', "at" FROM executions WHERE n = 5"""))
def _(spark, sf):
    return M.cap_calls(executions(spark, sf))


@query("R4_health_events", with_ctes("graded baseline", f"""
SELECT target, provider, status = 'OK' AS ok, status, '{NOW}' AS at FROM graded UNION ALL SELECT DISTINCT target, NULL, true, 'no-prior-snapshot', '{NOW}' FROM graded WHERE target NOT IN (SELECT target FROM baseline)"""))
def _(spark, sf):
    return M.health_events(results(spark, sf), expected(spark, sf), baseline(spark, sf), NOW)


def run_rows(spark, sf):
    return table(spark, sf, "customer").selectExpr(f"concat('run:sub:t', c_custkey, ':{POLICY}:{NOW}') AS run_id", "concat('2024-01-', lpad(c_nationkey + 1, 2, '0')) AS started_at")


@query("R10_run_states", with_ctes("cands", f"""
SELECT r.run_id, CASE WHEN count(c.id) > 0 THEN 'CANDIDATE' ELSE 'NO_CHANGE' END AS state, min(c.id) AS candidate_id, count(c.id) AS candidates FROM (SELECT 'run:sub:t' || c_custkey || ':{POLICY}:{NOW}' AS run_id FROM customer) r LEFT JOIN cands c USING (run_id) GROUP BY r.run_id"""))
def _(spark, sf):
    return M.run_states(run_rows(spark, sf), candidates(spark, sf))


@query("A22_health_summary", with_ctes("graded", """
SELECT g.target, count(*) FILTER (status = 'OK') AS ok_providers, count(*) FILTER (status <> 'OK') AS failed_providers, CASE WHEN count(*) FILTER (status = 'OK') > 0 THEN 0 ELSE coalesce(any_value(p.f), 0) + 1 END::BIGINT AS failure_count
FROM graded g LEFT JOIN (SELECT 't' || c_custkey AS target, c_nationkey % 3 AS f FROM customer) p USING (target) GROUP BY g.target"""))
def _(spark, sf):
    prev = table(spark, sf, "customer").selectExpr("concat('t', c_custkey) AS target", "c_nationkey % 3 AS failure_count")
    return M.health_summary(results(spark, sf), prev)


@query("A23_publish_counts", with_ctes("gated graded", """
SELECT 'runs' AS measure, (SELECT count(*) FROM customer) AS value UNION ALL SELECT 'candidates', count(*) FILTER (gate_status IN ('APPROVED', 'AUTO_APPROVED')) FROM gated UNION ALL SELECT 'pending_review', count(*) FILTER (gate_status = 'PENDING_REVIEW') FROM gated UNION ALL SELECT 'health', count(*) FROM graded"""))
def _(spark, sf):
    return M.publish_counts(run_rows(spark, sf), gated(spark, sf), results(spark, sf))


@query("A23_latest_runs", f"SELECT 'run:sub:t' || c_custkey || ':{POLICY}:{NOW}' AS run_id, '2024-01-' || lpad((c_nationkey + 1)::VARCHAR, 2, '0') AS started_at FROM customer ORDER BY started_at DESC, run_id DESC LIMIT 20")
def _(spark, sf):
    return M.latest_runs(run_rows(spark, sf))
