"""Filed figures: parsing, facts, derived metrics and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra import rules
from attestra.functions.text import first_match


def parse_amounts(display: Column) -> Column:
    """Struct of unit and the ordered numbers of a filed display text."""
    unit = F.when(display.rlike("(?i)tis\\.\\s*CZK"), "thousand_czk").otherwise("czk")
    core = F.regexp_replace(F.regexp_replace(display, "\\(.*\\)", ""), "(?i)tis\\.\\s*CZK|CZK", "")
    parts = F.transform(F.split(core, "/"), lambda p: F.regexp_replace(p, "[,\\s]", "").try_cast("double"))
    return F.struct(unit.alias("unit"), F.filter(parts, lambda v: v.isNotNull()).alias("values"))


def concept_of(label: Column) -> Column:
    return first_match(label, [(concept, pattern) for pattern, concept, _ in rules.FINANCE_CONCEPTS])


def half_up(value: Column, digits: int) -> Column:
    """Rounding with halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def pct(num: Column, den: Column) -> Column:
    return F.when(den != 0, half_up(num / den * F.lit(100.0), 1))


def ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, half_up(num / den, 2))


def financial_facts(displays: DataFrame, periods: list[str] | str) -> DataFrame:
    """One fact per filed value: entity, concept and period from display texts.

    ``displays``: entity, metric, display, status. Values stand in the order
    current, comparative. Point-in-time concepts keep their first value.
    ``periods`` in that order: one list for all filings, or the name of an array
    column with each filing's own.
    """
    if not isinstance(periods, str):
        displays = displays.withColumn("_periods", F.array(*[F.lit(p) for p in periods]))
        periods = "_periods"
    point = [concept for _, concept, once in rules.FINANCE_CONCEPTS if once]
    rows = displays.withColumn("concept", concept_of(F.col("metric"))).filter("concept IS NOT NULL")
    rows = rows.withColumn("p", parse_amounts(F.col("display")))
    rows = rows.select("entity", "metric", "status", "concept", F.col(periods).alias("periods"), F.col("p.unit").alias("unit"), F.posexplode("p.values").alias("pos", "value"))
    once = F.col("concept").isin(point)
    rows = rows.filter((once & (F.col("pos") == 0)) | (~once & (F.col("pos") < F.size("periods"))))
    period = F.when(once, "as_filed").otherwise(F.get("periods", F.col("pos")))
    rows = rows.withColumn("period", period)
    fact_id = F.concat(F.lit("FIN-"), F.upper("entity"), F.lit("-"), F.regexp_replace("period", "[^A-Za-z0-9]", ""), F.lit("-"),
                       F.replace(F.upper("concept"), F.lit("_"), F.lit("-")))
    return rows.select(fact_id.alias("id"), "entity", "concept", "period", "value", "unit", F.lit("FILED_FACT").alias("status"), F.col("status").alias("epistemic_state"))


def yoy(facts: DataFrame) -> DataFrame:
    """Change against the previous period that was filed; gaps stay gaps."""
    order = W.partitionBy("entity", "concept").orderBy("period")
    rows = facts.withColumn("previous", F.lag("value").over(order)).withColumn("previous_period", F.lag("period").over(order))
    delta = F.col("value") - F.col("previous")
    change = F.when(F.col("previous") != 0, delta / F.abs("previous") * 100)
    return rows.filter("previous IS NOT NULL").select("entity", "concept", "period", "previous_period", "value", "previous", delta.alias("delta"), change.alias("pct"))


def derived_metrics(facts: DataFrame, current: str, previous: str) -> DataFrame:
    """Metrics with formula and fact ids; only where every input exists.

    Facts are turned once into one row per entity and period; all formulas read
    that row, so no formula costs a join.
    """
    names = sorted({c for m in rules.FINANCE_METRICS for c in m[1:3]})
    pick = lambda what: [F.max(F.when(F.col("concept") == n, F.col(what))).alias(f"{n}_{what}") for n in names]
    wide = facts.groupBy("entity", "period").agg(*pick("value"), *pick("id"))

    def entry(metric, num, den, unit, current_only):
        n, d = F.col(num + "_value"), F.col(den + "_value")
        value = pct(n, d) if unit == "percent" else ratio(n, d)
        formula = F.concat(F.lit(f"{num}["), "period", F.lit(f"] / {den}["), "period", F.lit("]"))
        ready = n.isNotNull() & d.isNotNull()
        if current_only:
            ready = ready & (F.col("period") == current)
        fields = F.struct(F.lit(metric).alias("metric"), formula.alias("formula"), F.array(num + "_id").alias("numerator_facts"),
                          F.array(den + "_id").alias("denominator_facts"), value.alias("value"), F.lit(unit).alias("unit"))
        return F.when(ready, fields)

    shares = wide.select("entity", "period", F.explode(F.array_compact(F.array(*[entry(*m) for m in rules.FINANCE_METRICS]))).alias("m"))
    growth = facts.filter(F.col("concept") == "net_turnover").groupBy("entity").agg(
        *[F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{n}_{c}") for n, p in (("now", current), ("before", previous)) for c in ("value", "id")])
    growth = growth.filter("now_value IS NOT NULL AND before_value IS NOT NULL").select(
        "entity", F.lit(current).alias("period"),
        F.struct(F.lit("turnover_growth").alias("metric"),
                 F.lit(f"(net_turnover[{current}] - net_turnover[{previous}]) / net_turnover[{previous}]").alias("formula"),
                 F.array("now_id", "before_id").alias("numerator_facts"), F.array("before_id").alias("denominator_facts"),
                 pct(F.col("now_value") - F.col("before_value"), F.col("before_value")).alias("value"), F.lit("percent").alias("unit")).alias("m"))
    return shares.unionByName(growth).select("entity", "period", "m.*")


def reconcile_totals(lhs: DataFrame, parts: DataFrame, key: str, tolerance: float = 0.02) -> DataFrame:
    """Expected total against the sum of its parts, within a tolerance.

    ``lhs``: key, expected. ``parts``: key, amount. Amounts are decimals.
    """
    observed = parts.groupBy(key).agg(F.sum("amount").alias("observed"))
    rows = lhs.join(observed, key)
    diff = F.col("expected") - F.col("observed")
    limit = F.col("expected") * F.lit(str(tolerance)).cast("decimal(6,4)")
    state = F.when(F.abs(diff) <= limit, "PASSED_WITH_ROUNDING").otherwise("WARNING")
    return rows.select(key, "expected", "observed", diff.alias("difference"), state.alias("state"))


def claims_vs_filed(items: DataFrame, facts: DataFrame, period: str) -> DataFrame:
    """Public statements beside filed figures; a target is never a result.

    ``items``: id, entity, metric, display.
    """
    metric = F.col("metric")
    target = metric.rlike("(?i)target")
    label = F.when(target, "TARGET (forward-looking)").when(metric.rlike("(?i)headcount|people|tenders|contract"), "PERFORMANCE/MARKETING CLAIM").otherwise("COMPANY CLAIM")
    filed = facts.filter((F.col("concept") == "net_turnover") & (F.col("period") == period)).select(
        "entity", F.col("id").alias("fact_id"), F.col("value").alias("filed_value"), F.lit(True).alias("wants"))
    rows = items.withColumn("wants", metric.rlike("(?i)revenue target")).join(filed, ["entity", "wants"], "left")
    compared = F.col("fact_id").isNotNull()
    return rows.select("id", "entity", "metric", "display", label.alias("classification"), target.alias("forward_looking"), "fact_id", "filed_value",
                       compared.alias("period_mismatch"), compared.alias("perimeter_mismatch"))


def scale_comparison(facts: DataFrame, base_entity: str) -> DataFrame:
    """Latest figure of every entity against one base entity, per concept."""
    latest = facts.groupBy("entity", "concept").agg(F.max("period").alias("period"), F.max_by("value", "period").alias("value"))
    base = latest.filter(F.col("entity") == base_entity).select("concept", F.col("period").alias("base_period"), F.col("value").alias("base_value"))
    rows = latest.filter(F.col("entity") != base_entity).join(base, "concept")
    return rows.select("entity", "concept", "period", "base_period", "value", "base_value",
                       F.when(F.col("value") != 0, half_up(F.col("base_value") / F.col("value"), 1)).alias("base_to_entity"),
                       F.lit("NON-CONSOLIDATED").alias("perimeter"))


def finance_gaps(missing: DataFrame) -> DataFrame:
    """Missing figures are gaps with a state, never zero. ``missing``: id, text."""
    state = F.when(F.col("text").rlike("(?i)consolidated"), "NOT_PUBLIC").otherwise("NOT_FOUND")
    return missing.select("id", F.col("text").alias("concept"), state.alias("state"), F.lit(None).cast("double").alias("value"))
