"""Queries on single functions that otherwise only run inside of others."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.functions.time import year_of
from attestra.operators.changes import technical_summary
from attestra.operators.classify import categorize_change, epistemic_transition
from attestra.operators.coverage import priority_of
from attestra.operators.finance import pct
from attestra.operators.sources import confidence_of
from attestra.plans.inputs import table
from attestra.plans.registry import query

PAYLOAD = """'{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"note":null}'"""


def _payload():
    raw = F.concat(F.lit('{"note": null, "c_nationkey": '), "c_nationkey", F.lit('.0, "c_name": "'), "c_name", F.lit('"}'))
    return X.content_hash(X.canonical_json(raw))


@query("F2_content_hash", f"SELECT c_custkey, substr(sha256({PAYLOAD}), 1, 16) AS content_hash FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", _payload().alias("content_hash"))


@query("F3_revision_id", f"SELECT c_custkey, 'c' || c_custkey || '@' || substr(sha256({PAYLOAD}), 1, 16) AS revision_id FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.revision_id(F.concat(F.lit("c"), "c_custkey"), _payload()).alias("revision_id"))


@query("F9_year_of", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN year(o_orderdate) WHEN 2 THEN year(o_orderdate) END::INTEGER AS year FROM orders""")
def _(spark, sf):
    year = F.date_format("o_orderdate", "yyyy")
    said = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("3 May "), year)).when(F.col("o_orderkey") % 4 == 2, F.concat(year, F.lit(" or so"))).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", year_of(said).alias("year"))


STATUS = "CASE o_orderkey % 6 WHEN 0 THEN 'VERIFIED_PRIMARY' WHEN 1 THEN 'CORROBORATED' WHEN 2 THEN 'ASSESSED' WHEN 3 THEN 'CONTRADICTED' WHEN 4 THEN 'BLOCKED' END"
BEFORE = "CASE o_custkey % 6 WHEN 0 THEN 'VERIFIED_PRIMARY' WHEN 1 THEN 'CORROBORATED' WHEN 2 THEN 'SELF_REPORTED' WHEN 3 THEN 'CONTRADICTED' WHEN 4 THEN 'NOT_FOUND' END"


@query("F17_confidence_of", f"""
SELECT o_orderkey, CASE WHEN s IN ('VERIFIED_PRIMARY', 'CORROBORATED') THEN 'high' WHEN s = 'CONTRADICTED' THEN 'disputed' WHEN s IS NOT NULL THEN 'low' END AS confidence FROM (SELECT o_orderkey, {STATUS} AS s FROM orders)""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", confidence_of(F.expr(STATUS)).alias("confidence"))


@query("F19_epistemic_transition", f"""
WITH s AS (SELECT o_orderkey, {BEFORE} AS a, {STATUS} AS b FROM orders), r AS (SELECT *, CASE a WHEN 'VERIFIED_PRIMARY' THEN 3 WHEN 'CORROBORATED' THEN 2 WHEN 'SELF_REPORTED' THEN 1 END AS x, CASE b WHEN 'VERIFIED_PRIMARY' THEN 3 WHEN 'CORROBORATED' THEN 2 WHEN 'ASSESSED' THEN 1 END AS y FROM s)
SELECT o_orderkey, CASE WHEN b = 'CONTRADICTED' THEN 'CONTRADICTED' WHEN a = 'CONTRADICTED' THEN 'RESOLVED' WHEN x IS NULL AND y IS NULL THEN 'UNKNOWN' WHEN x IS NULL THEN 'STRENGTHENED' WHEN y IS NULL THEN 'WEAKENED' WHEN y > x THEN 'STRENGTHENED' WHEN y < x THEN 'WEAKENED' ELSE 'NO_EPISTEMIC_CHANGE' END AS impact FROM r""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", epistemic_transition(F.expr(BEFORE), F.expr(STATUS)).alias("impact"))


KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'OBJECT_REMOVED_FROM_PUBLICATION' WHEN 1 THEN 'CLAIM_CORRECTED' ELSE 'CLAIM_ADDED' END"


@query("F22_categorize_change", f"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PUBLICATION_CHANGE' WHEN 1 THEN 'CORRECTION' ELSE CASE WHEN strftime(o_orderdate, '%Y-%m-%d') > '1996-12-31' AND strftime(o_orderdate, '%Y-%m-%d') <= '1998-12-31' THEN 'WORLD_CHANGE' ELSE 'KNOWLEDGE_CHANGE' END END AS category FROM orders""")
def _(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", categorize_change(F.expr(KIND), day, F.lit("1996-12-31"), F.lit("1998-12-31")).alias("category"))


@query("F25_pct", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN floor(l_quantity::DOUBLE / (l_linenumber - 3) * 100.0 * 10.0 + 0.5) / 10.0 END AS share FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pct(F.col("l_quantity").cast("double"), F.col("l_linenumber") - 3).alias("share"))


@query("F31_assertion_id", """
SELECT o_orderkey, '/zaznamy/' || (o_orderkey % 3) || '/clenove/' || o_custkey AS pointer, 'ASR-' || substr(sha1(sha256(o_orderkey::VARCHAR) || '|/zaznamy/' || (o_orderkey % 3) || '/clenove/' || o_custkey || '|registry:' || o_orderstatus), 1, 12) AS id FROM orders""")
def _(spark, sf):
    """With F32, the pointer that is part of it."""
    pointer = X.json_pointer("zaznamy", F.col("o_orderkey") % 3, "clenove", F.col("o_custkey"))
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return table(spark, sf, "orders").select("o_orderkey", pointer.alias("pointer"), X.assertion_id(sha, pointer, F.concat(F.lit("registry:"), "o_orderstatus")).alias("id"))


@query("F33_has_value", "SELECT o_orderkey, o_orderkey % 3 = 2 AS has_value FROM orders")
def _(spark, sf):
    value = F.expr("CASE o_orderkey % 3 WHEN 1 THEN '' WHEN 2 THEN o_orderstatus END")
    return table(spark, sf, "orders").select("o_orderkey", X.has_value(value).alias("has_value"))


@query("F38_priority_of", """
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END + (o_custkey % 2 = 0)::INT + (o_custkey % 3 = 0)::INT AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 4 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS priority FROM s""")
def _(spark, sf):
    level = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low' END")
    return table(spark, sf, "orders").select("o_orderkey", priority_of(level, F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3 == 0).alias("priority"))


@query("F41_technical_summary", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'changed claim CLM-' || o_orderkey || ' fields=[status,text]' ELSE 'added claim CLM-' || o_orderkey END AS summary FROM orders""")
def _(spark, sf):
    fields = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN array(named_struct('field', 'status'), named_struct('field', 'text')) ELSE cast(array() as array<struct<field:string>>) END")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "changed").otherwise("added")
    return table(spark, sf, "orders").select("o_orderkey", technical_summary(kind, F.lit("claim"), F.concat(F.lit("CLM-"), "o_orderkey"), fields).alias("summary"))
