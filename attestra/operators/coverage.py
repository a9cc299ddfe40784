"""Coverage, gaps, the frontier of open leads and its ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import rules
from attestra.functions.text import lookup
from attestra.operators.extract import union_all
from attestra.operators.numbering import number_rows, ordinal_id
from attestra.operators.sources import is_primary_filed, source_class

RANK3 = {"high": 3, "moderate": 2, "low": 1}


def dimension_of(kind: Column, cat: Column) -> Column:
    """Coverage dimension of a record by its kind or edge category."""
    expr = F.lit(None).cast("string")
    for name, record_kind, cats in reversed(rules.COVERAGE_DIMENSIONS):
        cond = kind == record_kind
        if cats:
            cond = cond & cat.isin(cats)
        expr = F.when(cond, F.lit(name)).otherwise(expr)
    return expr


def dimensions(spark) -> DataFrame:
    return spark.createDataFrame([(d[0],) for d in rules.COVERAGE_DIMENSIONS], "dimension string")


def coverage_matrix(records: DataFrame, sources: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per dimension: records, sources, statuses, gaps and an ordinal state.

    Records and citations are aggregated before they meet, so the ten
    dimensions never collect their records in ten tasks.
    """
    rows = records.withColumn("dimension", dimension_of(F.col("kind"), F.col("cat"))).filter("dimension IS NOT NULL")
    status = F.col("status")
    by_record = rows.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(status == "VERIFIED_PRIMARY").alias("verified"),
        F.count_if(status == "CORROBORATED").alias("corroborated"), F.count_if(status == "CONTRADICTED").alias("contradicted"))
    cited = rows.select("dimension", F.explode("sources").alias("source_id")).distinct()
    known = sources.select(F.col("id").alias("source_id"), is_primary_filed(F.col("tier"), F.col("kind")).alias("_filed"),
                           source_class(F.col("kind"), F.col("tier")).alias("_class"))
    by_source = cited.join(known, "source_id", "left").groupBy("dimension").agg(
        F.count(F.lit(1)).alias("sources"), F.coalesce(F.bool_or("_filed"), F.lit(False)).alias("has_primary_filed"),
        F.countDistinct(F.coalesce("_class", F.lit("other"))).alias("source_classes"))
    open_gaps = gaps.groupBy("dimension").agg(F.count(F.lit(1)).alias("open_gaps"))
    out = dimensions(records.sparkSession)
    for part in (by_record, by_source, open_gaps):
        out = out.join(part, "dimension", "left")
    out = out.na.fill(0, ["records", "verified", "corroborated", "contradicted", "sources", "source_classes", "open_gaps"])
    out = out.na.fill(False, ["has_primary_filed"])
    any_verified, any_second = F.col("verified") > 0, F.col("corroborated") > 0
    filed = F.col("has_primary_filed")
    state = (
        F.when(F.col("records") == 0, "absent")
        .when(~any_verified & ~any_second, "weak")
        .when(filed & any_verified & (F.col("contradicted") == 0), "strong")
        .when(any_verified | (any_second & filed), "adequate")
        .otherwise("partial")
    )
    return out.withColumn("coverage", state)


def number_records(df: DataFrame, prefix: str, order: list[Column], width: int = 2, out: str = "id") -> DataFrame:
    """Ordinal ids such as OQ-01 in a given order."""
    return number_rows(df, order, "_no").withColumn(out, ordinal_id(prefix, F.col("_no"), width)).drop("_no")


def gap_analysis(questions: DataFrame, missing: DataFrame, routing: DataFrame) -> DataFrame:
    """Open questions and missing data as gaps.

    ``questions``: id, text. ``missing``: id, text, state. ``routing``:
    question_id, dimension, materiality, recommended_source.
    """
    routed = questions.join(routing, questions["id"] == routing["question_id"], "left")
    asked = routed.select(
        F.concat(F.lit("GAP-"), F.substring("id", 4, 1 << 20)).alias("id"), F.lit("open_question").alias("category"),
        F.coalesce("dimension", F.lit("identity")).alias("dimension"), F.col("text").alias("expected_datum"),
        F.coalesce("materiality", F.lit("moderate")).alias("materiality"), "recommended_source",
        F.lit("open").alias("status"), F.array("id").alias("derived_from"))
    staff = F.col("text").rlike("(?i)employee|headcount|zaměstna")
    absent = missing.select(
        "id", F.lit("missing_datum").alias("category"), F.lit("financials").alias("dimension"), F.col("text").alias("expected_datum"),
        F.when(staff, "moderate").otherwise("low").alias("materiality"), F.lit("collection of deeds").alias("recommended_source"),
        F.lit("open").alias("status"), F.array(F.lit("financials.notFound")).alias("derived_from"))
    return asked.unionByName(absent)


def spatial_coverage_gaps(dims: DataFrame, prefix: str = "GAP-CAD-") -> DataFrame:
    """Every spatial dimension that was not collected is a blocked gap."""
    missing = dims.filter("NOT collected").select("dimension", "entity")
    rows = number_records(missing, prefix, [F.col("entity"), F.col("dimension")])
    return rows.select("id", "entity", "dimension", F.lit("blocked").alias("status"))


def priority_of(materiality: Column, has_source: Column, weak: Column) -> Column:
    one = lambda c: F.when(c, 1).otherwise(0)
    score = F.coalesce(lookup(materiality, RANK3), F.lit(1)) + one(has_source) + one(weak)
    return F.when(score >= 4, "high").when(score >= 3, "medium").otherwise("low")


def frontier(contradictions: DataFrame, gaps: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """One task per unresolved lead with its priority.

    ``contradictions``: id, field, resolution, materiality, recommended_source.
    ``hypotheses``: id, subject, proposition, state, falsification,
    next_best_evidence, materiality.
    """
    task = lambda: F.concat(F.lit("TASK-"), F.col("id"))
    resolvable = F.coalesce(F.col("resolution").rlike("(?i)or\\.justice\\.cz|lookup|výpis|přímý"), F.lit(False))
    from_con = contradictions.select(
        task().alias("id"), F.col("field").alias("target"), F.concat(F.lit("resolve contradiction "), F.col("id")).alias("question"),
        F.col("resolution").alias("reason"), "recommended_source", "materiality", F.lit("disputed").alias("confidence"),
        priority_of(F.col("materiality"), resolvable, F.lit(True)).alias("priority"), F.array("id").alias("derived_from"))
    from_gap = gaps.select(
        task().alias("id"), F.col("dimension").alias("target"), F.col("expected_datum").alias("question"),
        F.concat(F.lit("open gap ("), F.col("category"), F.lit(") in "), F.col("dimension")).alias("reason"), "recommended_source",
        "materiality", F.lit("unknown").alias("confidence"),
        priority_of(F.col("materiality"), F.col("recommended_source").isNotNull(), F.lit(False)).alias("priority"), "derived_from")
    open_ones = hypotheses.filter(F.col("state").isin(rules.OPEN_HYPOTHESES))
    from_hyp = open_ones.select(
        task().alias("id"), F.col("subject").alias("target"), F.concat(F.lit("test hypothesis "), F.col("id")).alias("question"),
        F.concat(F.lit("falsification: "), F.col("falsification")).alias("reason"), F.col("next_best_evidence").alias("recommended_source"),
        "materiality", F.col("state").alias("confidence"),
        priority_of(F.col("materiality"), F.col("next_best_evidence").isNotNull(), F.lit(False)).alias("priority"),
        F.array("id").alias("derived_from"))
    return union_all([from_con, from_gap, from_hyp])


def rank_frontier(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(lookup(F.col("priority"), {"high": 3, "medium": 2, "low": 1}).desc(), "id")


# Words that mark a contradiction, a primary source, an official
# source and a natural person.
CONTRADICTION_WORDS = "(?i)rozpor|CON-|contradiction"
PRIMARY_WORDS = "(?i)or\\.justice\\.cz|Sbírka listin|primary|collection of deeds"
OFFICIAL_WORDS = "(?i)or\\.justice\\.cz|Sbírka listin|ČÚZK|justice|collection of deeds"
PERSON_WORDS = "(?i)fyzick|rezidenč|natural|osob"


def information_gain(priority: Column, question: Column, reason: Column, source: Column) -> Column:
    base = F.coalesce(lookup(priority, {"high": "high", "medium": "moderate", "low": "low"}), F.lit("low"))
    text = F.concat_ws(" ", question, F.coalesce(reason, F.lit("")))
    raised = F.when(F.coalesce(source.rlike(PRIMARY_WORDS), F.lit(False)) & (base == "low"), "moderate").otherwise(base)
    conflict = F.coalesce(text.rlike(CONTRADICTION_WORDS), F.lit(False))
    return F.when(conflict, "high").otherwise(raised)


def ranked_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with expected gain, ranking dimensions and the reason for both."""
    uncertain = F.when(F.col("confidence").isin("disputed", "unknown"), "high").otherwise("moderate")
    has = F.col("recommended_source").isNotNull()
    official = F.coalesce(F.col("recommended_source").rlike(OFFICIAL_WORDS), F.lit(False))
    authority = F.when(official, "official_primary").otherwise("secondary")
    person = F.coalesce(F.col("reason").rlike(PERSON_WORDS), F.lit(False))
    why = F.concat(F.lit("priority "), F.col("priority"), F.lit(": materiality="), F.col("materiality"), F.lit(", uncertainty="), uncertain,
                   F.lit(", source="), authority, F.when(has, " (known public source)").otherwise(" (no known source)"))
    return tasks.select(
        "*", information_gain(F.col("priority"), F.col("question"), F.col("reason"), F.col("recommended_source")).alias("information_gain"),
        uncertain.alias("uncertainty"), F.when(has, "known_public_source").otherwise("none").alias("source_availability"),
        authority.alias("source_authority"), F.when(person, "elevated").otherwise("low").alias("privacy_risk"), why.alias("why_ranked"))


def questions(gaps: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Investigation questions, each linked to its task."""
    from_gap = gaps.select(
        F.concat(F.lit("Q-"), F.regexp_replace("id", "^GAP-?", "")).alias("id"), F.col("dimension").alias("target"), "category",
        F.when(F.col("status") == "blocked", "blocked").otherwise("open").alias("status"),
        F.concat(F.lit("TASK-"), F.col("id")).alias("linked_task"))
    from_con = contradictions.select(
        F.concat(F.lit("Q-"), F.col("id")).alias("id"), F.col("field").alias("target"), F.lit("contradiction").alias("category"),
        F.lit("open").alias("status"), F.concat(F.lit("TASK-"), F.col("id")).alias("linked_task"))
    return from_gap.unionByName(from_con)
