"""Queries that run a stream over all given rows; results equal the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.plans.inputs import table, with_ctes
from attestra.plans.io import scratch
from attestra.plans.monitoring import approvals
from attestra.plans.monitoring import candidates as batch_candidates
from attestra.plans.registry import query
from attestra.sources.writers import read_appended
from attestra.streaming import streams as S
from attestra.streaming.windows import OutcomeLedger

BATCHES = 3


def stream_table(spark, sf, name):
    """One of the given tables as a stream of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def run_rows(events):
    return events.selectExpr(
        "concat('RUN-', lpad(cast(event_id as string), greatest(12, length(cast(event_id as string))), '0')) AS run_id", "concat('SRC-', user_id) AS source_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS finished_at",
        "CASE WHEN event_type = 'error' THEN CASE WHEN value < 8 THEN 'provider_error' ELSE 'http_error' END WHEN event_type = 'signup' AND value < 2 THEN 'fetch_failed' ELSE 'ok' END AS outcome",
        "CASE WHEN event_type = 'error' THEN CASE WHEN value < 8 THEN 500 ELSE 404 END WHEN event_type = 'signup' AND value < 2 THEN NULL ELSE 200 END AS http_status",
        "sha2(props, 256) AS sha256", "user_id", "cast(ts as timestamp) AS ts")


def mixed_runs(spark, sf):
    """Runs as a stream of several batches; each holds rows of all times, so most of them come late.

    A batch is as many files as the table has splits, so that its tasks grow in
    number and not in size.
    """
    path = scratch(spark, "runs")
    rows = run_rows(table(spark, sf, "events"))
    files = max(1, rows.rdd.getNumPartitions())
    rows.repartition(BATCHES * files, "run_id", "ts").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("R1_stream_provider_state", with_ctes("provider_state", "SELECT * FROM provider_state"))
def _(spark, sf):
    return S.upsert_to_table(S.stream_provider_state(mixed_runs(spark, sf)), scratch(spark, "state"), ["source_id"])


@query("R3_detect_changes", """
SELECT 't' || user_id AS target, event_type AS field, b AS before, a AS after, at_ AS "at" FROM (SELECT user_id, event_type, floor(value / 10)::BIGINT::VARCHAR AS a, lag(floor(value / 10)::BIGINT::VARCHAR) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS b, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at_ FROM events WHERE event_type <> 'error')
WHERE a <> b AND event_type IN ('purchase', 'view')""")
def _(spark, sf):
    seen = stream_table(spark, sf, "events").selectExpr(
        "concat('t', user_id) AS target", "'p1' AS provider", "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS at", "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status",
        "event_type AS field", "cast(cast(floor(value / 10) as bigint) as string) AS value")
    return S.detect_changes(seen, scratch(spark, "changes"), ["purchase", "view"])


@query("R7_dedupe_artifacts", "SELECT DISTINCT sha256(props) AS sha256, user_id FROM events")
def _(spark, sf):
    path = scratch(spark, "dedupe")
    arriving = mixed_runs(spark, sf).select("sha256", "user_id")
    S.append_artifacts(arriving, path, ["sha256", "user_id"], scratch(spark, "dedupe-log")).awaitTermination()
    return read_appended(spark, path)


@query("R8_gate_stream", with_ctes("gated", "SELECT id, decision, gate_status FROM gated"))
def _(spark, sf):
    path = scratch(spark, "candidates")
    batch_candidates(spark, sf).select("id", "requires_review").write.parquet(path)
    arriving = spark.readStream.schema("id string, requires_review boolean").parquet(path)
    return S.run_to_table(S.gate_stream(arriving, approvals(spark, sf)).select("id", "decision", "gate_status"), scratch(spark, "gate"))


@query("R4_stream_health", """
SELECT 't' || user_id AS target, 'p1' AS provider, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "at" FROM events""")
def _(spark, sf):
    e = stream_table(spark, sf, "events").selectExpr("concat('t', user_id) AS target", "'p1' AS provider", "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status", "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS at")
    return S.run_to_table(S.stream_health(e), scratch(spark, "health"))


def outcomes(spark, sf):
    ledger = OutcomeLedger(spark, scratch(spark, "outcomes"), "1 day", "2 hours", "12 hours")
    ledger.run(mixed_runs(spark, sf).select("source_id", "outcome", "ts"))
    return ledger


FAILED = "event_type = 'error' OR (event_type = 'signup' AND value < 2)"


@query("R9_outcome_windows", f"""
SELECT 'SRC-' || user_id AS source_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS attempts, count(*) FILTER ({FAILED}) AS failures, max(ts) AS last_run FROM events GROUP BY user_id, date_trunc('day', ts)""")
def _(spark, sf):
    return outcomes(spark, sf).windows().select("source_id", "window_start", "window_end", "attempts", "failures", "last_run")


@query("R9_outcome_sessions", f"""
WITH e AS (SELECT user_id, ts, ({FAILED}) AS failed, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR, true) AS opens FROM events),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT 'SRC-' || user_id AS source_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS attempts, count(*) FILTER (failed) AS failures, max(ts) AS last_run FROM n GROUP BY user_id, session""")
def _(spark, sf):
    return outcomes(spark, sf).sessions().select("source_id", "session_start", "session_end", "attempts", "failures", "last_run")
