"""Queries on the relationship graph and the reasoning graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions.text import extract_ids
from attestra.operators import graph as G
from attestra.operators import reasoning as Z
from attestra.operators.extract import union_all
from attestra.operators.sources import source_class
from attestra.plans import evidence_inputs as I
from attestra.plans.inputs import cte, table, with_ctes
from attestra.plans.registry import query

EMPTY = I.EMPTY
ROOT = "c1"
MODE = ["ownership", "legal"]


def nodes(spark, sf):
    c = table(spark, sf, "customer").selectExpr(
        "concat('c', c_custkey) AS id", "c_name AS label", "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS expand",
        "CASE WHEN c_acctbal < 0 THEN array('*') ELSE array(array('ownership','governance','transactions','legal','client')[c_nationkey % 5]) END AS cats",
        "array(concat('CLM-', c_custkey), concat('CLM-', c_custkey + 1)) AS claims",
        f"CASE WHEN c_acctbal > 9000 THEN {EMPTY} ELSE array(concat('src', c_custkey % 20)) END AS sources", "cast(null as string) AS valid_from", "cast(null as string) AS status")
    o = table(spark, sf, "orders").selectExpr(
        "concat('o', o_orderkey) AS id", "concat('Order ', o_orderkey) AS label", "cast(null as string) AS expand",
        "array(CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'ownership' WHEN '2' THEN 'governance' WHEN '3' THEN 'transactions' WHEN '4' THEN 'legal' ELSE 'client' END) AS cats",
        f"{EMPTY} AS claims", f"array(concat('src', o_custkey % 21)) AS sources", "date_format(o_orderdate, 'yyyy-MM-dd') AS valid_from", "CASE WHEN o_orderstatus = 'F' THEN 'VERIFIED_PRIMARY' WHEN o_orderstatus = 'P' THEN 'CONTRADICTED' ELSE 'SELF_REPORTED' END AS status")
    return c.unionByName(o)


cte("nodes", """SELECT 'c' || c_custkey AS id, c_name AS label, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS expand, CASE WHEN c_acctbal < 0 THEN ['*'] ELSE [['ownership','governance','transactions','legal','client'][c_nationkey % 5 + 1]] END AS cats,
    ['CLM-' || c_custkey, 'CLM-' || (c_custkey + 1)] AS claims, CASE WHEN c_acctbal > 9000 THEN []::VARCHAR[] ELSE ['src' || (c_custkey % 20)] END AS sources, NULL::VARCHAR AS valid_from, NULL::VARCHAR AS status FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'Order ' || o_orderkey, NULL, [CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ownership' WHEN '2' THEN 'governance' WHEN '3' THEN 'transactions' WHEN '4' THEN 'legal' ELSE 'client' END], []::VARCHAR[],
    ['src' || (o_custkey % 21)], strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderstatus = 'F' THEN 'VERIFIED_PRIMARY' WHEN o_orderstatus = 'P' THEN 'CONTRADICTED' ELSE 'SELF_REPORTED' END FROM orders""")


def fk_edges(spark, sf):
    """order -> customer -> nation -> region, supplier -> nation."""
    pick = lambda t, a, b: table(spark, sf, t).selectExpr(f"{a} AS source", f"{b} AS target")
    return union_all([
        pick("orders", "concat('o', o_orderkey)", "concat('c', o_custkey)"), pick("customer", "concat('c', c_custkey)", "concat('n', c_nationkey)"),
        pick("nation", "concat('n', n_nationkey)", "concat('r', n_regionkey)"), pick("supplier", "concat('s', s_suppkey)", "concat('n', s_nationkey)")])


@query("P3_category_mode", with_ctes("nodes edges", """
, v AS (SELECT id FROM nodes WHERE id = 'c1' OR list_has_any(cats, ['ownership', 'legal']))
SELECT 'node' AS what, id FROM v UNION ALL SELECT 'edge', id FROM edges WHERE cat IN ('ownership', 'legal') AND source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)"""))
def _(spark, sf):
    n, e = G.filter_category_mode(nodes(spark, sf), I.edges(spark, sf), MODE, ROOT)
    return n.select(F.lit("node").alias("what"), "id").unionByName(e.select(F.lit("edge").alias("what"), "id"))


@query("P4_expand_group", with_ctes("nodes", "SELECT id FROM nodes WHERE expand IS NULL OR id = 'c1' OR expand IN ('MACHINERY')"))
def _(spark, sf):
    return G.filter_expand_group(nodes(spark, sf), ["MACHINERY"], ROOT).select("id")


@query("P5_filter_confidence", with_ctes("nodes", "SELECT id, status FROM nodes WHERE status IS NULL OR status IN ('VERIFIED_PRIMARY', 'CORROBORATED', 'CONTRADICTED')"))
def _(spark, sf):
    return G.filter_confidence(nodes(spark, sf), ["high", "disputed"]).select("id", "status")


@query("P6_filter_source_class", with_ctes("edges doc_sources", """
SELECT id FROM edges e WHERE len(sources) = 0 OR EXISTS (SELECT 1 FROM doc_sources s WHERE list_contains(e.sources, s.id) AND s.cls IN ('official', 'company'))
  OR NOT EXISTS (SELECT 1 FROM doc_sources s WHERE list_contains(e.sources, s.id) AND s.cls <> 'other')"""))
def _(spark, sf):
    s = I.doc_sources(spark, sf)
    classes = s.select(F.col("id").alias("source_id"), source_class(F.col("kind"), F.col("tier")).alias("class"))
    return G.filter_source_class(I.edges(spark, sf), "id", classes, ["official", "company"]).select("id")


@query("P7_as_of", "SELECT 'E' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND year(o_orderdate) <= 2000")
def _(spark, sf):
    dates = table(spark, sf, "orders").selectExpr("concat('E', o_orderkey) AS id", "date_format(o_orderdate, 'yyyy-MM-dd') AS valid_from",
                                                  "CASE WHEN o_orderdate < timestamp'1996-01-01' THEN '1999-12-31' END AS valid_to")
    return G.as_of_year(dates, 2000).select("id")


@query("J17_record_layers", with_ctes("nodes doc_claims doc_sources", """
SELECT 'ce:' || id AS id, 'clm:' || id AS source, 'c1' AS target, 'claim' AS label FROM doc_claims
UNION ALL SELECT 'ce:' || n.c || ':' || n.id, 'clm:' || n.c, n.id, 'about' FROM (SELECT id, unnest(claims) AS c FROM nodes WHERE id <> 'c1') n JOIN doc_claims k ON k.id = n.c
UNION ALL SELECT 'se:' || n.s || ':' || n.id, 'src:' || n.s, n.id, 'cited by' FROM (SELECT id, unnest(sources) AS s FROM nodes) n JOIN doc_sources k ON k.id = n.s
UNION ALL SELECT 'se:' || n.s || ':clm:' || n.id, 'src:' || n.s, 'clm:' || n.id, 'supports' FROM (SELECT id, unnest(sources) AS s FROM doc_claims) n JOIN doc_sources k ON k.id = n.s"""))
def _(spark, sf):
    return G.record_layers(nodes(spark, sf), I.doc_claims(spark, sf), I.doc_sources(spark, sf), ROOT)


@query("J18_backlinks", with_ctes("nodes doc_claims", """
, m AS (SELECT 'CLM-' || conv_id AS id, count(*) AS mentions FROM conversations GROUP BY 1), e AS (SELECT id, count(*) AS entities FROM (SELECT unnest(claims) AS id FROM nodes) GROUP BY 1)
SELECT c.id, coalesce(e.entities, 0) AS entities, coalesce(m.mentions, 0) AS mentions, coalesce(e.entities, 0) + coalesce(m.mentions, 0) AS backlinks FROM doc_claims c LEFT JOIN e USING (id) LEFT JOIN m USING (id)"""))
def _(spark, sf):
    text = F.concat(F.col("text"), F.lit(" (CLM-"), F.col("conv_id"), F.lit(")"))
    mentions = table(spark, sf, "conversations").select(F.explode(extract_ids(text, "\\bCLM-\\d+\\b")).alias("claim_id"))
    return G.backlinks(I.doc_claims(spark, sf), nodes(spark, sf), mentions)


@query("J19_entity_edges", with_ctes("edges", "SELECT source AS node, id AS edge, 'out' AS direction, target AS other FROM edges UNION ALL SELECT target, id, 'in', source FROM edges"))
def _(spark, sf):
    return G.entity_edges(I.edges(spark, sf))


@query("J19_degrees", with_ctes("edges", "SELECT node, count(DISTINCT id) AS degree FROM (SELECT source AS node, id FROM edges UNION ALL SELECT target, id FROM edges) GROUP BY node"))
def _(spark, sf):
    return G.degrees(I.edges(spark, sf))


@query("T4_top_degree", with_ctes("edges", "SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY node ORDER BY degree DESC, node LIMIT 6"))
def _(spark, sf):
    return G.top_degree(I.edges(spark, sf))


@query("A19_confidence_counts", with_ctes("edges", "SELECT CASE WHEN status IN ('VERIFIED_PRIMARY', 'CORROBORATED') THEN 'high' WHEN status = 'CONTRADICTED' THEN 'disputed' ELSE 'low' END AS confidence, count(*) AS edges FROM edges GROUP BY 1"))
def _(spark, sf):
    return G.confidence_counts(I.edges(spark, sf))


COMPONENTS = """
  SELECT 'r' || r_regionkey AS node, r_regionkey AS reg FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'o' || o_orderkey, n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""
cte("members", COMPONENTS)


@query("G4_connected_components", with_ctes("members", "SELECT node, min(node) OVER (PARTITION BY reg) AS component FROM members"))
def _(spark, sf):
    return G.connected_components(fk_edges(spark, sf))


@query("A20_graph_analytics", with_ctes("edges nodes", """
SELECT 'components' AS metric, (SELECT count(DISTINCT source) FROM edges) AS value UNION ALL SELECT 'self_reported_edges', count(*) FILTER (status = 'SELF_REPORTED') FROM edges
UNION ALL SELECT 'contradicted_edges', count(*) FILTER (status = 'CONTRADICTED') FROM edges UNION ALL SELECT 'nodes_without_sources', count(*) FILTER (len(sources) = 0) FROM nodes"""))
def _(spark, sf):
    e = I.edges(spark, sf)
    return G.graph_analytics(nodes(spark, sf), e, G.connected_components(e))


@query("G3_shortest_path", """
WITH a AS (SELECT o_custkey AS c, c_nationkey AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 1), s AS (SELECT s_nationkey AS n FROM supplier WHERE s_suppkey = 1),
p AS (SELECT CASE WHEN a.n = s.n THEN ['o1', 'c' || a.c, 'n' || a.n, 's1'] WHEN x.n_regionkey = y.n_regionkey THEN ['o1', 'c' || a.c, 'n' || a.n, 'r' || x.n_regionkey, 'n' || s.n, 's1']
    ELSE ['o1', 'c' || a.c, 'n' || a.n, 'r' || x.n_regionkey, 'world', 'r' || y.n_regionkey, 'n' || s.n, 's1'] END AS path
  FROM a, s, nation x, nation y WHERE x.n_nationkey = a.n AND y.n_nationkey = s.n)
SELECT (generate_subscripts(path, 1) - 1)::BIGINT AS step, unnest(path) AS node, (len(path) - 1)::BIGINT AS hops FROM p""")
def _(spark, sf):
    world = table(spark, sf, "region").selectExpr("concat('r', r_regionkey) AS source", "'world' AS target")
    r = G.shortest_path(fk_edges(spark, sf).unionByName(world), "o1", "s1")
    return r.select(F.col("step").cast("bigint").alias("step"), "node", F.col("hops").cast("bigint").alias("hops"))


# ------------------------------------------------------------ reasoning


def inferences(spark, sf):
    """One inference per assessed document claim."""
    return I.doc_claims(spark, sf).filter("status = 'ASSESSED'").selectExpr(
        "concat('INF-', doc_id) AS id", "concat('inference of ', doc_id) AS label", "concat('CLM-', doc_id) AS produces", "doc_id",
        """array(named_struct('ref', concat('CLM-', doc_id - 1), 'role', 'supports'), named_struct('ref', concat('CLM-', doc_id - 2), 'role', CASE WHEN lang = 'fr' THEN 'contradicts' ELSE 'contextualizes' END),
             named_struct('ref', concat('CLM-', doc_id + 7), 'role', CASE WHEN lang = 'es' THEN 'guesses' ELSE 'supports' END)) AS premises""",
        "array(concat('ASM-', lang)) AS assumptions", f"CASE WHEN lang = 'de' THEN {EMPTY} ELSE array(concat('not known: ', own_source)) END AS uncertainty",
        "array(concat('other reading of ', doc_id)) AS alternatives", "lang", "own_source")


def findings(spark, sf):
    return table(spark, sf, "benchmark").selectExpr(
        "concat('EXEC-', item_id) AS id", "text AS label", "array(named_struct('ref', concat('CLM-', item_id * 7 + 3), 'role', 'supports'), named_struct('ref', concat('CLM-', item_id), 'role', 'contextualizes')) AS supports",
        "CASE WHEN item_id % 3 = 0 THEN concat('INF-', item_id * 7 + 3) END AS reasoning", "item_id")


def conflicts(spark, sf):
    return table(spark, sf, "labels").selectExpr("concat('CON-', doc_id) AS id", "concat('toxic of ', doc_id) AS label", "array(concat('CLM-', doc_id)) AS side_a",
                                                 "array(concat('CLM-', doc_id + 1), concat('src', doc_id % 20)) AS side_b",
                                                 "CASE WHEN quality = 1 THEN 'settled' ELSE 'open' END AS resolution_state", "CASE WHEN toxic = 0 THEN 'none' END AS remaining_uncertainty")


def claim_nodes(spark, sf):
    return I.doc_claims(spark, sf).select("id", F.col("text").alias("label"), "status", "sources")


def reasoning(spark, sf):
    sources = I.doc_sources(spark, sf).selectExpr("id", "title AS label")
    d = table(spark, sf, "documents")
    spans = d.selectExpr("concat('SP-', doc_id) AS id", "text AS label", "source AS source_id")
    selectors = d.filter("lang = 'en'").selectExpr("concat('SEL-', doc_id) AS id", "lang AS label", "source AS source_id")
    links = d.selectExpr("concat('CLM-', doc_id) AS claim_id", "CASE WHEN lang = 'en' THEN concat('SEL-', doc_id) ELSE concat('SP-', doc_id) END AS evidence_id", "CASE WHEN lang = 'fr' THEN 'CONTEXTUALIZES' END AS relation")
    assumptions = d.select("lang").distinct().selectExpr("concat('ASM-', lang) AS id", "lang AS label")
    return Z.build_reasoning_graph(sources, spans, selectors, claim_nodes(spark, sf), links, assumptions, inferences(spark, sf), findings(spark, sf), conflicts(spark, sf))


cte("inferences", """SELECT 'INF-' || doc_id AS id, 'inference of ' || doc_id AS label, 'CLM-' || doc_id AS produces, doc_id, lang, own_source AS source, ['CLM-' || (doc_id - 1), 'CLM-' || (doc_id - 2), 'CLM-' || (doc_id + 7)] AS refs,
  ['supports', CASE WHEN lang = 'fr' THEN 'contradicts' ELSE 'contextualizes' END, CASE WHEN lang = 'es' THEN 'guesses' ELSE 'supports' END] AS roles FROM doc_claims WHERE status = 'ASSESSED'""", ["doc_claims"])
cte("findings", "SELECT 'EXEC-' || item_id AS id, text AS label, ['CLM-' || (item_id * 7 + 3), 'CLM-' || item_id] AS refs, ['supports', 'contextualizes'] AS roles, CASE WHEN item_id % 3 = 0 THEN 'INF-' || (item_id * 7 + 3) END AS reasoning FROM benchmark")
cte("conflicts", "SELECT 'CON-' || doc_id AS id, 'toxic of ' || doc_id AS label, ['CLM-' || doc_id] AS side_a, ['CLM-' || (doc_id + 1), 'src' || (doc_id % 20)] AS side_b, CASE WHEN quality = 1 THEN 'settled' ELSE 'open' END AS resolution_state, CASE WHEN toxic = 0 THEN 'none' END AS remaining_uncertainty FROM labels")
cte("rnodes", """SELECT id, 'source' AS kind, title AS label, 0 AS layer FROM doc_sources UNION ALL SELECT 'OBS-' || id, 'observation', 'retrieval of ' || id, 0 FROM doc_sources
  UNION ALL SELECT 'SP-' || doc_id, 'evidence', substr(text, 1, 160), 1 FROM documents UNION ALL SELECT 'SEL-' || doc_id, 'assertion', lang, 2 FROM documents WHERE lang = 'en'
  UNION ALL SELECT id, CASE WHEN status = 'ASSESSED' THEN 'assessment' ELSE 'claim' END, substr(text, 1, 160), CASE WHEN status = 'ASSESSED' THEN 4 ELSE 3 END FROM doc_claims
  UNION ALL SELECT DISTINCT 'ASM-' || lang, 'assumption', lang, 4 FROM documents UNION ALL SELECT id, 'inference', label, 4 FROM inferences UNION ALL SELECT id, 'executive_finding', substr(label, 1, 160), 6 FROM findings
  UNION ALL SELECT id, 'conflict', label, 4 FROM conflicts""", ["doc_sources", "doc_claims", "inferences", "findings", "conflicts"])
cte("redges", """SELECT id AS "from", 'OBS-' || id AS "to", 'observed_via' AS role, 'sources' AS via FROM doc_sources
  UNION ALL SELECT 'OBS-' || source, 'SP-' || doc_id, 'preserved_in', 'spans' FROM documents UNION ALL SELECT 'SP-' || doc_id, source, 'from_source', 'spans' FROM documents
  UNION ALL SELECT 'OBS-' || source, 'SEL-' || doc_id, 'extracted_from', 'selectors' FROM documents WHERE lang = 'en' UNION ALL SELECT 'SEL-' || doc_id, source, 'from_source', 'selectors' FROM documents WHERE lang = 'en'
  UNION ALL SELECT CASE WHEN lang = 'en' THEN 'SEL-' || doc_id ELSE 'SP-' || doc_id END, 'CLM-' || doc_id, CASE WHEN lang = 'fr' THEN 'contextualizes' ELSE 'supports' END, 'claim evidence' FROM documents
  UNION ALL SELECT unnest(sources), id, 'cited_by_claim', 'claim sources' FROM doc_claims UNION ALL SELECT unnest(refs), id, unnest(roles), 'premises' FROM inferences UNION ALL SELECT id, produces, 'produces', 'inferences' FROM inferences
  UNION ALL SELECT 'ASM-' || lang, id, 'assumes', 'assumptions' FROM inferences UNION ALL SELECT unnest(refs), id, unnest(roles), 'findings' FROM findings UNION ALL SELECT reasoning, id, 'reasoned_by', 'findings' FROM findings WHERE reasoning IS NOT NULL
  UNION ALL SELECT unnest(side_a), id, 'conflict_side_a', 'conflicts' FROM conflicts UNION ALL SELECT unnest(side_b), id, 'conflict_side_b', 'conflicts' FROM conflicts""", ["doc_sources", "doc_claims", "inferences", "findings", "conflicts"])
SUPPORT = "('supports', 'produces', 'preserved_in', 'extracted_from', 'cited_by_claim', 'reasoned_by', 'observed_via', 'contextualizes')"
# the closure keeps the least depth by which a node is reached
CLOSURE = f"""
, sup AS MATERIALIZED (SELECT DISTINCT "from" AS f, "to" AS t FROM redges WHERE role IN {SUPPORT}),
walk(root, node, depth) USING KEY (root, node) AS (SELECT id, id, 0 FROM roots UNION SELECT w.root, s.f, w.depth + 1 FROM walk w JOIN sup s ON s.t = w.node LEFT JOIN recurring.walk r ON r.root = w.root AND r.node = s.f WHERE r.node IS NULL AND w.depth < 13),
cl AS (SELECT root, node, depth FROM walk WHERE depth > 0)
"""


def recursive(names, roots, body):
    return with_ctes(names, f", roots AS ({roots})" + CLOSURE + body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("G1_reasoning_nodes", with_ctes("rnodes", "SELECT id, kind, label, layer::BIGINT AS layer FROM rnodes"))
def _(spark, sf):
    return reasoning(spark, sf)[0].withColumn("layer", F.col("layer").cast("bigint"))


@query("G1_reasoning_edges", with_ctes("redges", 'SELECT "from", "to", role, via FROM redges'))
def _(spark, sf):
    return reasoning(spark, sf)[1]


@query("G2_support_closure", recursive("redges findings", "SELECT id FROM findings", "SELECT root, node, depth::BIGINT AS depth FROM cl"))
def _(spark, sf):
    c = G.support_closure(reasoning(spark, sf)[1], findings(spark, sf))
    return c.withColumn("depth", F.col("depth").cast("bigint"))


@query("G5_resolves_to_evidence", with_ctes("inferences", """
, p AS (SELECT DISTINCT unnest(refs) AS id FROM inferences) SELECT id, EXISTS (SELECT 1 FROM documents d WHERE 'CLM-' || d.doc_id = p.id) AS evidence_backed FROM p"""))
def _(spark, sf):
    n, e = reasoning(spark, sf)
    refs = inferences(spark, sf).select(F.explode("premises").alias("p")).select(F.col("p.ref").alias("id"))
    return G.resolves_to_evidence(refs, e, n.filter("kind IN ('evidence', 'assertion')"))


VECTOR = """, jur AS (SELECT id, upstream, 'J' || (n % 3) AS jurisdiction, retrieved FROM doc_sources), ev AS (SELECT 'SP-' || doc_id AS id, lang AS document FROM documents UNION ALL SELECT 'SEL-' || doc_id, NULL FROM documents WHERE lang = 'en'), ru AS (SELECT DISTINCT 'src' || (user_id % 16) AS id FROM events),
vec AS (SELECT root, count(j.id) AS source_count, count(v.id) AS evidence_count, count(DISTINCT document) AS document_count, count(ru.id) AS run_backed_sources, count(DISTINCT upstream) AS upstream_families, count(DISTINCT jurisdiction) AS jurisdictions,
  min(retrieved) AS first_retrieved, max(retrieved) AS last_retrieved, count(DISTINCT upstream) <= 1 AS monoculture FROM cl LEFT JOIN jur j ON j.id = cl.node LEFT JOIN ev v ON v.id = cl.node LEFT JOIN ru ON ru.id = cl.node WHERE j.id IS NOT NULL OR v.id IS NOT NULL GROUP BY root)
"""


def vector(spark, sf, roots=None):
    """Diversity of the given roots, or of every node."""
    n, e = reasoning(spark, sf)
    src = I.doc_sources(spark, sf).selectExpr("id", "concat('up', n % 5) AS upstream", "concat('J', n % 3) AS jurisdiction", "retrievedAt AS retrieved")
    d = table(spark, sf, "documents")
    ev = d.selectExpr("concat('SP-', doc_id) AS id", "lang AS document").unionByName(d.filter("lang = 'en'").selectExpr("concat('SEL-', doc_id) AS id", "cast(null as string) AS document"))
    runs = table(spark, sf, "events").selectExpr("concat('src', user_id % 16) AS source_id")
    if roots is not None:
        return Z.diversity_vector(G.support_closure(e, roots), src, ev, runs)
    leaves = src.select("id").union(ev.select("id")).select(F.col("id").alias("node"), F.col("id").alias("fact"))
    return Z.diversity_vector(G.carry_up(e, leaves).select(F.col("node").alias("root"), F.col("fact").alias("node")), src, ev, runs)


@query("A16_diversity_vector", recursive("redges rnodes doc_sources", "SELECT id FROM rnodes", VECTOR + "SELECT * FROM vec"))
def _(spark, sf):
    return vector(spark, sf)


@query("G6_why_index", with_ctes("rnodes redges inferences", """
, x AS (SELECT "to" AS node, CASE WHEN role IN ('supports', 'cited_by_claim', 'preserved_in', 'extracted_from') THEN 'supporting' WHEN role = 'contextualizes' THEN 'contextualizing' WHEN role = 'contradicts' OR starts_with(role, 'conflict_side') THEN 'contradicting' WHEN role = 'produces' THEN 'produced_by_inference' END AS section, "from" AS ref, role FROM redges
  UNION ALL SELECT "from", CASE WHEN role IN ('supports', 'contradicts', 'contextualizes', 'reasoned_by') THEN 'used_by' END, "to", role FROM redges UNION ALL SELECT produces, 'assumptions', 'ASM-' || lang, 'assumptions' FROM inferences
  UNION ALL SELECT produces, 'uncertainty', 'not known: ' || source, 'uncertainty' FROM inferences WHERE lang <> 'de' UNION ALL SELECT produces, 'alternatives', 'other reading of ' || doc_id, 'alternatives' FROM inferences)
SELECT node, section, ref, role FROM x WHERE section IS NOT NULL AND node IN (SELECT id FROM rnodes)"""))
def _(spark, sf):
    n, e = reasoning(spark, sf)
    return Z.why_index(n, e, inferences(spark, sf))


@query("G7_resolve_ref", with_ctes("inferences conflicts doc_claims doc_sources", """
, r AS (SELECT DISTINCT unnest(refs) AS ref FROM inferences UNION SELECT unnest(side_b) FROM conflicts)
SELECT r.ref, CASE WHEN c.id IS NOT NULL THEN 'claim' WHEN s.id IS NOT NULL THEN 'source' ELSE 'unknown' END AS kind, coalesce(substr(c.text, 1, 160), s.title) AS label, CASE WHEN c.id IS NOT NULL THEN 3 WHEN s.id IS NOT NULL THEN 0 END::BIGINT AS layer
FROM r LEFT JOIN doc_claims c ON c.id = r.ref LEFT JOIN doc_sources s ON s.id = r.ref"""))
def _(spark, sf):
    return resolved(spark, sf).withColumn("layer", F.col("layer").cast("bigint"))


def resolved(spark, sf):
    refs = inferences(spark, sf).select(F.explode("premises").alias("p")).select("p.ref").union(conflicts(spark, sf).select(F.explode("side_b").alias("ref")))
    return Z.resolve_ref(refs, [("claim", claim_nodes(spark, sf)), ("source", I.doc_sources(spark, sf).selectExpr("id", "title AS label"))])


@query("G10_executive_trace", recursive("redges findings doc_claims doc_sources", "SELECT id FROM findings", VECTOR + """
SELECT f.id, f.ref, f.role, CASE WHEN c.id IS NOT NULL THEN 'claim' ELSE 'unknown' END AS kind, v.source_count, v.evidence_count, v.upstream_families, v.monoculture
FROM (SELECT id, unnest(refs) AS ref, unnest(roles) AS role FROM findings) f LEFT JOIN doc_claims c ON c.id = f.ref LEFT JOIN vec v ON v.root = f.id"""))
def _(spark, sf):
    f = findings(spark, sf)
    refs = f.select(F.explode("supports").alias("p")).select("p.ref")
    t = Z.executive_trace(f, Z.resolve_ref(refs, [("claim", claim_nodes(spark, sf))]), vector(spark, sf, f))
    return t.select("id", "ref", "role", "kind", "source_count", "evidence_count", "upstream_families", "monoculture")


@query("G11_inference_detail", recursive("redges inferences doc_sources", "SELECT DISTINCT produces AS id FROM inferences", VECTOR + """
SELECT i.id, i.produces, 3::BIGINT AS premises, 1::BIGINT AS alternatives, len(list_filter(roles, lambda r: r = 'supports'))::BIGINT AS supports, len(list_filter(roles, lambda r: r = 'contradicts'))::BIGINT AS contradicts, len(list_filter(roles, lambda r: r = 'contextualizes'))::BIGINT AS contextualizes,
  v.source_count, v.upstream_families, v.first_retrieved FROM inferences i LEFT JOIN vec v ON v.root = i.produces"""))
def _(spark, sf):
    i = inferences(spark, sf)
    v = vector(spark, sf, i.select(F.col("produces").alias("id")))
    d = Z.inference_detail(i, reasoning(spark, sf)[1], v)
    return d.select("id", "produces", F.col("premises").cast("bigint").alias("premises"), F.col("alternatives").cast("bigint").alias("alternatives"), "supports", "contradicts", "contextualizes",
                    "source_count", "upstream_families", "first_retrieved")


@query("G12_conflict_sides", with_ctes("conflicts", """
SELECT id, 'a' AS side, unnest(side_a) AS ref, resolution_state, remaining_uncertainty FROM conflicts UNION ALL SELECT id, 'b', unnest(side_b), resolution_state, remaining_uncertainty FROM conflicts"""))
def _(spark, sf):
    return Z.conflict_sides(conflicts(spark, sf))
