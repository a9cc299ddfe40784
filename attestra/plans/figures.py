"""Queries on filed figures and addresses."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.operators import address as A
from attestra.operators import finance as N
from attestra.operators.extract import union_all
from attestra.plans.inputs import cte, table, with_ctes
from attestra.plans.registry import query

PERIODS = ["FY2000", "FY1999"]
LABELS = {
    "1-URGENT": "Net turnover (current / previous)",
    "2-HIGH": "Net result (current / previous)",
    "3-MEDIUM": "Total assets",
    "4-NOT SPECIFIED": "Equity (total)",
    "5-LOW": "Liabilities (total)",
}


def displays(spark, sf):
    """One filing per customer, priority and year with orders: its order sum, and that of the year before if there is one."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("cents"))
    years = W.partitionBy("o_custkey", "o_orderpriority").orderBy("y")
    g = o.groupBy("o_custkey", "o_orderpriority", "y").agg(F.sum("cents").alias("a"))
    g = g.withColumn("b", F.when(F.lag("y").over(years) == F.col("y") - 1, F.lag("a").over(years)))
    num = lambda c: F.format_number(F.floor(c), 0)
    scale = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit(" tis. CZK (filed "), F.col("y") + 1, F.lit(")"))).otherwise(" CZK")
    return g.select(
        F.concat(F.lit("c"), "o_custkey").alias("entity"), X.lookup(F.col("o_orderpriority"), LABELS).alias("metric"),
        F.concat(F.concat_ws(" / ", num(F.col("a")), num(F.col("b"))), scale).alias("display"),
        F.transform(F.array(F.col("y"), F.col("y") - 1), lambda y: F.concat(F.lit("FY"), y)).alias("periods"),
        F.lit("VERIFIED_PRIMARY").alias("status"))


def facts(spark, sf):
    """A year's figure stands in its own filing and, the same, in the next one."""
    return N.financial_facts(displays(spark, sf), "periods").distinct()


cte("sums", """
  SELECT o_custkey AS k, o_orderpriority AS p, year(o_orderdate) AS y, floor(sum(o_totalprice::DECIMAL(18,2)))::BIGINT AS s FROM orders GROUP BY 1, 2, 3""")
cte("displays", """
  SELECT 'c' || k AS entity, k, y, label AS metric, concept, a, b, CASE WHEN k % 2 = 0 THEN 'thousand_czk' ELSE 'czk' END AS unit,
    concat_ws(' / ', format('{:,}', a), format('{:,}', b)) || CASE WHEN k % 2 = 0 THEN ' tis. CZK (filed ' || (y + 1) || ')' ELSE ' CZK' END AS display
  FROM (SELECT n.k, n.p, n.y, n.s AS a, v.s AS b FROM sums n LEFT JOIN sums v ON v.k = n.k AND v.p = n.p AND v.y = n.y - 1)
  JOIN (VALUES ('1-URGENT', 'Net turnover (current / previous)', 'net_turnover'), ('2-HIGH', 'Net result (current / previous)', 'net_result'), ('3-MEDIUM', 'Total assets', 'total_assets'), ('4-NOT SPECIFIED', 'Equity (total)', 'total_equity'),
    ('5-LOW', 'Liabilities (total)', 'total_liabilities')) l(p, label, concept) USING (p)""", ["sums"])
cte("facts", """
  SELECT 'FIN-' || upper(entity) || '-FY' || y || '-' || replace(upper(concept), '_', '-') AS id, entity, concept, 'FY' || y AS period, a::DOUBLE AS value, unit FROM displays""", ["displays"])


@query("F23_parse_amounts", with_ctes("displays", """
SELECT entity, metric, display, unit, concat_ws('|', a, b) AS amounts FROM displays"""))
def _(spark, sf):
    d = displays(spark, sf).withColumn("p", N.parse_amounts(F.col("display")))
    return d.select("entity", "metric", "display", "p.unit", F.array_join(F.transform("p.values", lambda v: v.cast("bigint").cast("string")), "|").alias("amounts"))


@query("F24_concept_of", with_ctes("displays", "SELECT entity, metric, concept FROM displays"))
def _(spark, sf):
    return displays(spark, sf).select("entity", "metric", N.concept_of(F.col("metric")).alias("concept"))


@query("E14_financial_facts", with_ctes("facts", "SELECT id, entity, concept, period, value, unit, 'FILED_FACT' AS status, 'VERIFIED_PRIMARY' AS epistemic_state FROM facts"))
def _(spark, sf):
    return facts(spark, sf)


@query("W7_yoy", with_ctes("facts", """
SELECT entity, concept, period, previous_period, value, previous, value - previous AS delta, CASE WHEN previous <> 0 THEN (value - previous) / abs(previous) * 100 END AS pct
FROM (SELECT *, lag(value) OVER w AS previous, lag(period) OVER w AS previous_period FROM facts WINDOW w AS (PARTITION BY entity, concept ORDER BY period)) WHERE previous IS NOT NULL"""))
def _(spark, sf):
    return N.yoy(facts(spark, sf))


@query("E15_derived_metrics", with_ctes("facts", """
, m AS (SELECT * FROM (VALUES ('net_margin', 'net_result', 'net_turnover', 'percent', false), ('equity_ratio', 'total_equity', 'total_assets', 'percent', true), ('leverage', 'total_liabilities', 'total_equity', 'ratio', true)) v(metric, n, d, unit, cur))
SELECT a.entity, a.period, m.metric, m.n || '[' || a.period || '] / ' || m.d || '[' || a.period || ']' AS formula, a.id AS numerator_facts, b.id AS denominator_facts,
  CASE WHEN b.value <> 0 THEN CASE WHEN m.unit = 'percent' THEN floor(a.value / b.value * 100.0::DOUBLE * 10 + 0.5::DOUBLE) / 10 ELSE floor(a.value / b.value * 100 + 0.5::DOUBLE) / 100 END END AS value, m.unit
FROM m JOIN facts a ON a.concept = m.n JOIN facts b ON b.concept = m.d AND b.entity = a.entity AND b.period = a.period WHERE NOT m.cur OR a.period = 'FY2000'
UNION ALL SELECT a.entity, 'FY2000', 'turnover_growth', '(net_turnover[FY2000] - net_turnover[FY1999]) / net_turnover[FY1999]', a.id || ',' || b.id, b.id,
  CASE WHEN b.value <> 0 THEN floor((a.value - b.value) / b.value * 100.0::DOUBLE * 10 + 0.5::DOUBLE) / 10 END, 'percent' FROM facts a JOIN facts b ON a.entity = b.entity AND a.concept = 'net_turnover' AND b.concept = 'net_turnover' AND a.period = 'FY2000' AND b.period = 'FY1999'"""))
def _(spark, sf):
    m = metrics(spark, sf)
    return m.withColumn("numerator_facts", F.array_join("numerator_facts", ",")).withColumn("denominator_facts", F.array_join("denominator_facts", ","))


def metrics(spark, sf):
    return N.derived_metrics(facts(spark, sf), *PERIODS)


@query("E13_reconcile_totals", """
SELECT o_orderkey AS key, o_totalprice::DECIMAL(18,2)::DOUBLE AS expected, s::DOUBLE AS observed, (o_totalprice::DECIMAL(18,2) - s)::DOUBLE AS difference, CASE WHEN abs(o_totalprice::DECIMAL(18,2) - s) <= o_totalprice::DECIMAL(18,2) * 0.02 THEN 'PASSED_WITH_ROUNDING' ELSE 'WARNING' END AS state
FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(spark, sf):
    lhs = table(spark, sf, "orders").selectExpr("o_orderkey AS key", "cast(o_totalprice as decimal(18,2)) AS expected")
    parts = table(spark, sf, "lineitem").selectExpr("l_orderkey AS key", "cast(l_extendedprice as decimal(18,2)) AS amount")
    r = N.reconcile_totals(lhs, parts, "key")
    return r.select("key", *[F.col(c).cast("double").alias(c) for c in ("expected", "observed", "difference")], "state")


def statements(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('SR-', p_partkey) AS id", "concat('c', p_partkey) AS entity",
        "concat(p_name, CASE p_type WHEN 'PROMO' THEN ' revenue target' WHEN 'SMALL' THEN ' headcount' WHEN 'LARGE' THEN ' target' ELSE '' END) AS metric",
        "concat('~', cast(p_size as string), ' mil.') AS display")


cte("statements", """SELECT 'SR-' || p_partkey AS id, 'c' || p_partkey AS entity, p_name || CASE p_type WHEN 'PROMO' THEN ' revenue target' WHEN 'SMALL' THEN ' headcount' WHEN 'LARGE' THEN ' target' ELSE '' END AS metric, '~' || p_size || ' mil.' AS display FROM part""")


@query("E12_claims_vs_filed", with_ctes("statements facts", """
SELECT s.id, s.entity, s.metric, s.display, CASE WHEN regexp_matches(metric, 'target') THEN 'TARGET (forward-looking)' WHEN regexp_matches(metric, 'headcount|people|tenders|contract') THEN 'PERFORMANCE/MARKETING CLAIM' ELSE 'COMPANY CLAIM' END AS classification,
  regexp_matches(metric, 'target') AS forward_looking, f.id AS fact_id, f.value AS filed_value, f.id IS NOT NULL AS period_mismatch, f.id IS NOT NULL AS perimeter_mismatch
FROM statements s LEFT JOIN facts f ON f.entity = s.entity AND f.concept = 'net_turnover' AND f.period = 'FY2000' AND regexp_matches(s.metric, 'revenue target')"""))
def _(spark, sf):
    return N.claims_vs_filed(statements(spark, sf), facts(spark, sf), "FY2000")


@query("E16_scale_comparison", with_ctes("facts", """
, l AS (SELECT entity, concept, max(period) AS period, arg_max(value, period) AS value FROM facts GROUP BY 1, 2)
SELECT a.entity, a.concept, a.period, b.period AS base_period, a.value, b.value AS base_value, CASE WHEN a.value <> 0 THEN floor(b.value / a.value * 10 + 0.5::DOUBLE) / 10 END AS base_to_entity, 'NON-CONSOLIDATED' AS perimeter
FROM l a JOIN l b ON b.concept = a.concept AND b.entity = 'c1' WHERE a.entity <> 'c1'"""))
def _(spark, sf):
    return N.scale_comparison(facts(spark, sf), "c1")


def missing(spark, sf):
    return table(spark, sf, "part").selectExpr("concat('GAP-FIN-', p_partkey) AS id", "concat(CASE p_type WHEN 'PROMO' THEN 'Consolidated ' ELSE '' END, p_name) AS text")


@query("E1_finance_gaps", "SELECT 'GAP-FIN-' || p_partkey AS id, CASE p_type WHEN 'PROMO' THEN 'Consolidated ' ELSE '' END || p_name AS concept, CASE WHEN p_type = 'PROMO' THEN 'NOT_PUBLIC' ELSE 'NOT_FOUND' END AS state, NULL::DOUBLE AS value FROM part")
def _(spark, sf):
    return N.finance_gaps(missing(spark, sf))


# ------------------------------------------------------------ addresses


def candidates(spark, sf):
    """Two observations of every customer's seat, one of them shorter."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("street", F.concat(F.lit("Náměstí "), F.initcap("c_mktsegment")))
    number = "concat(cast(c_custkey % 97 + 1 as string), CASE WHEN c_acctbal > 0 THEN concat('/', c_nationkey + 1) ELSE '' END)"
    code = "concat(lpad(cast(c_nationkey * 37 % 900 + 100 as string), 3, '0'), ' ', lpad(cast(n_regionkey * 11 as string), 2, '0'))"
    full = c.selectExpr(f"concat(street, ' ', {number}, ', ', n_name, ', ', {code}, ' Město ', n_regionkey) AS raw", "c_custkey", "'1-register' AS discovered_from")
    short = c.selectExpr(f"concat(street, ' ', {number}, ', město  ', n_regionkey) AS raw", "c_custkey", "'2-seat' AS discovered_from")
    plain = c.selectExpr("concat('CZ', c_custkey) AS raw", "c_custkey", "'3-vat' AS discovered_from")
    rows = union_all([full, short, plain])
    return rows.selectExpr("raw", "concat('c', c_custkey) AS subject", "'registered_office' AS role", "'CORROBORATED' AS status", "array(concat('src', c_custkey % 20)) AS sources", "discovered_from")


cte("candidates", """
  SELECT k, n, r, seg, 'Náměstí ' || upper(substr(seg, 1, 1)) || lower(substr(seg, 2)) AS street, (k % 97 + 1)::VARCHAR AS house, CASE WHEN c_acctbal > 0 THEN (n + 1)::VARCHAR END AS orient, n_name,
    lpad((n * 37 % 900 + 100)::VARCHAR, 3, '0') || ' ' || lpad((r * 11)::VARCHAR, 2, '0') AS code
  FROM (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r, c_mktsegment AS seg, c_acctbal, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)""")
cte("parsed", """
  SELECT 'c' || k AS subject, d AS discovered_from, CASE d WHEN '1-register' THEN street || ' ' || num || ', ' || n_name || ', ' || code || ' Město ' || r WHEN '2-seat' THEN street || ' ' || num || ', město  ' || r END AS raw,
    street, house AS house_number, orient AS orientation_number, CASE d WHEN '1-register' THEN n_name END AS municipality_part, CASE d WHEN '1-register' THEN code END AS postcode, CASE d WHEN '1-register' THEN 'Město ' || r ELSE 'město  ' || r END AS city,
    concat_ws('|', 'namesti ' || lower(seg), house, orient, 'mesto ' || r) AS address_key, 'src' || (k % 20) AS source_id
  FROM (SELECT *, house || coalesce('/' || orient, '') AS num FROM candidates) CROSS JOIN (SELECT unnest(['1-register', '2-seat']) AS d)""", ["candidates"])


@query("F26_parse_address", with_ctes("parsed", "SELECT subject, discovered_from, raw, street, house_number, orientation_number, municipality_part, postcode, city, 'exact' AS resolution, address_key FROM parsed"))
def _(spark, sf):
    return A.address_candidates(candidates(spark, sf)).select("subject", "discovered_from", "raw", *A.COMPONENTS, "resolution", "address_key")


@query("F27_has_address_shape", with_ctes("parsed", "SELECT subject, discovered_from, true AS shaped FROM parsed UNION ALL SELECT 'c' || c_custkey, '3-vat', false FROM customer"))
def _(spark, sf):
    return candidates(spark, sf).select("subject", "discovered_from", A.has_address_shape(F.col("raw")).alias("shaped"))


@query("E18_resolve_addresses", with_ctes("parsed", """
SELECT address_key, arg_min(raw, discovered_from || raw) AS raw, arg_min(street, discovered_from || raw) AS street, arg_min(house_number, discovered_from || raw) AS house_number, arg_min(orientation_number, discovered_from || raw) AS orientation_number,
  arg_min(municipality_part, discovered_from || raw) FILTER (municipality_part IS NOT NULL) AS municipality_part, arg_min(postcode, discovered_from || raw) FILTER (postcode IS NOT NULL) AS postcode, arg_min(city, discovered_from || raw) AS city,
  count(*) AS observations, count(DISTINCT subject) AS linked_entities, 'exact' AS resolution, 'public_with_context' AS publication FROM parsed GROUP BY address_key"""))
def _(spark, sf):
    return A.resolve_addresses(A.address_candidates(candidates(spark, sf)))


@query("E18_address_sources", with_ctes("parsed", "SELECT DISTINCT address_key, source_id FROM parsed"))
def _(spark, sf):
    return A.address_sources(A.address_candidates(candidates(spark, sf)))
