"""Monitoring: observations, change candidates, review gate, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra import rules
from attestra.functions.text import has_value
from attestra.operators.extract import union_all


def provider_results(expected: DataFrame, records: DataFrame) -> DataFrame:
    """One health row per expected (provider, target); data only where OK.

    ``records``: provider, target, status, fields map, corrupt flag. A missing,
    corrupt or unknown record is a health fact, never a change.
    """
    found = records.withColumn("_found", F.lit(True))
    rows = expected.join(found, ["provider", "target"], "left")
    usable = F.col("fields").isNotNull()
    status = (
        F.when(F.col("_found").isNull(), "UNAVAILABLE")
        .when(F.coalesce("corrupt", F.lit(False)), "ERROR")
        .when((F.col("status") == "OK") & usable, "OK")
        .when(F.col("status").isin("UNAVAILABLE", "ERROR"), F.col("status"))
        .otherwise("ERROR")
    )
    error = (
        F.when(F.col("_found").isNull(), "fixture-missing")
        .when(F.coalesce("corrupt", F.lit(False)), "fixture-parse-failed")
        .when((F.col("status") == "OK") & ~usable, "fixture-ok-missing-fields")
        .when(F.col("status").isin("UNAVAILABLE", "ERROR"), F.lower("status"))
        .when(F.coalesce(F.col("status") != "OK", F.lit(True)), "fixture-unknown-status")
    )
    ok = status == "OK"
    return rows.select("provider", "target", ok.alias("ok"), status.alias("status"), error.alias("error"), F.when(ok, F.col("fields")).alias("fields"))


def merge_observations(results: DataFrame, precedence: DataFrame) -> DataFrame:
    """(target, field, value, provider): per field the later provider wins.

    ``precedence``: provider, position.
    """
    long = results.filter("ok").join(precedence, "provider").select("target", "provider", "position", F.explode("fields").alias("field", "value"))
    best = long.groupBy("target", "field").agg(F.max_by(F.struct("value", "provider"), "position").alias("b"))
    return best.select("target", "field", "b.value", "b.provider")


def merge_baseline(prior: DataFrame, observed: DataFrame) -> DataFrame:
    """New field values over known ones; nothing known is ever erased.

    Both in long form (target, field, value).
    """
    new = observed.select("target", "field", F.col("value").alias("_new"), F.lit(True).alias("_seen"))
    rows = prior.select("target", "field", "value").join(new, ["target", "field"], "full_outer")
    return rows.select("target", "field", F.when(F.coalesce("_seen", F.lit(False)), F.col("_new")).otherwise(F.col("value")).alias("value"))


def candidate_transitions(prior: DataFrame, observed: DataFrame, now: str, policy: str, fields: list[str] | None = None) -> DataFrame:
    """One candidate per material field with two different real values."""
    wanted = fields or rules.MATERIAL_FIELDS
    a = prior.filter(F.col("field").isin(wanted)).select("target", "field", F.col("value").alias("before"))
    b = observed.filter(F.col("field").isin(wanted)).select("target", "field", F.col("value").alias("after"))
    rows = a.join(b, ["target", "field"]).filter(has_value(F.col("before")) & has_value(F.col("after")) & (F.col("before") != F.col("after")))
    run = F.concat(F.lit("run:sub:"), "target", F.lit(f":{policy}:{now}"))
    return rows.select(F.concat(F.lit("cand:"), run, F.lit(":"), "field").alias("id"), run.alias("run_id"), "target", "field", "before", "after", F.lit(now).alias("detected_at"))


def classify_candidates(candidates: DataFrame, review_fields: list[str] | None = None) -> DataFrame:
    review = F.col("field").isin(review_fields or rules.REVIEW_FIELDS)
    return candidates.withColumn("materiality", F.when(review, "high").otherwise("normal")).withColumn("requires_review", review)


def gate_status(decision: Column, requires_review: Column) -> Column:
    return (
        F.when(decision == "reject", "REJECTED")
        .when(decision == "approve", "APPROVED")
        .when(requires_review, "PENDING_REVIEW")
        .otherwise("AUTO_APPROVED")
    )


def first_decisions(approvals: DataFrame) -> DataFrame:
    """The first decision recorded for each candidate."""
    return approvals.groupBy("candidate_id").agg(F.min_by("decision", F.struct("at", "reviewer", "decision")).alias("decision"))


def review_gate(candidates: DataFrame, approvals: DataFrame) -> DataFrame:
    """Nothing that needs review leaves it without a human record."""
    rows = candidates.join(first_decisions(approvals), candidates["id"] == F.col("candidate_id"), "left")
    return rows.withColumn("gate_status", gate_status(F.col("decision"), F.col("requires_review"))).drop("candidate_id")


def is_publishable(df: DataFrame, status: str = "gate_status") -> DataFrame:
    return df.filter(F.col(status).isin(rules.PUBLISHABLE))


def due_subscriptions(subscriptions: DataFrame, now: str, cadence_days: int = rules.CADENCE_DAYS) -> DataFrame:
    """Which subscriptions must run, why, and when they are next due."""
    last = F.to_timestamp("last_run_at")
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last)) / 86400)
    reason = F.when(last.isNull(), "never-run").when(age >= cadence_days, "cadence-elapsed").otherwise("within-cadence")
    nxt = F.when(last.isNotNull(), F.date_format(last + F.expr(f"INTERVAL {cadence_days} DAYS"), "yyyy-MM-dd HH:mm:ss"))
    return subscriptions.select("id", "target", "last_run_at", age.alias("age_days"), reason.alias("reason"), (reason != "within-cadence").alias("due"), nxt.alias("next_due_at"))


def cap_calls(executions: DataFrame, n: int = rules.MAX_PROVIDER_CALLS) -> DataFrame:
    """The first n executions of each run, and a marker row where more came.

    The rank limit is applied before the shuffle, so an overlong run stays
    cheap. ``executions``: run_id, position, provider, ok, status, at.
    """
    order = W.partitionBy("run_id").orderBy("position", "provider")
    ranked = executions.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n + 1)
    kept = ranked.filter(F.col("_n") <= n).select("run_id", "provider", "ok", "status", "at")
    extra = ranked.filter(F.col("_n") == n + 1).select("run_id", F.lit(None).cast("string").alias("provider"), F.lit(False).alias("ok"),
                                                       F.lit("provider-call-limit").alias("status"), "at")
    return kept.unionByName(extra)


def health_events(results: DataFrame, targets: DataFrame, baseline: DataFrame, now: str) -> DataFrame:
    """One row per execution, and a marker for each target without a baseline."""
    each = results.select("target", "provider", "ok", "status", F.lit(now).alias("at"))
    known = baseline.select("target").distinct()
    first = targets.select("target").distinct().join(known, "target", "left_anti")
    marker = first.select("target", F.lit(None).cast("string").alias("provider"), F.lit(True).alias("ok"), F.lit("no-prior-snapshot").alias("status"), F.lit(now).alias("at"))
    return each.unionByName(marker)


def run_states(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Terminal state of each run and its first candidate."""
    found = candidates.groupBy("run_id").agg(F.min("id").alias("candidate_id"), F.count(F.lit(1)).alias("candidates"))
    rows = runs.join(found, "run_id", "left")
    return rows.select("run_id", F.when(F.col("candidates") > 0, "CANDIDATE").otherwise("NO_CHANGE").alias("state"), "candidate_id",
                       F.coalesce("candidates", F.lit(0)).alias("candidates"))


def health_summary(results: DataFrame, previous: DataFrame) -> DataFrame:
    """Provider successes per target and the consecutive failure counter.

    ``previous``: target, failure_count.
    """
    counts = results.groupBy("target").agg(F.count_if("ok").alias("ok_providers"), F.count_if(~F.col("ok")).alias("failed_providers"))
    rows = counts.join(previous, "target", "left")
    failures = F.when(F.col("ok_providers") > 0, 0).otherwise(F.coalesce("failure_count", F.lit(0)) + 1)
    return rows.select("target", "ok_providers", "failed_providers", failures.cast("bigint").alias("failure_count"))


def publish_counts(runs: DataFrame, candidates: DataFrame, health: DataFrame) -> DataFrame:
    """(measure, value): pending candidates are counted, never shown."""
    count = lambda df, name: df.agg(F.lit(name).alias("measure"), F.count(F.lit(1)).alias("value"))
    return union_all([count(runs, "runs"), count(is_publishable(candidates), "candidates"),
                      count(candidates.filter("gate_status = 'PENDING_REVIEW'"), "pending_review"), count(health, "health")])


def latest_runs(runs: DataFrame, k: int = 20) -> DataFrame:
    """Headers of the last k runs, newest first."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(k)
