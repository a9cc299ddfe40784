"""The layered reasoning graph and what can be read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators.extract import union_all
from attestra.session import stored

#: Rows of one side of a join that one task sorts.
ROWS_PER_TASK = 500_000

# Layer of each node kind.
LAYERS = {
    "source": 0,
    "observation": 0,
    "evidence": 1,
    "assertion": 2,
    "claim": 3,
    "assessment": 4,
    "inference": 4,
    "assumption": 4,
    "conflict": 4,
    "conclusion": 5,
    "executive_finding": 6,
}


def _nodes(df: DataFrame, kind: str, node_id="id", label="label") -> DataFrame:
    return df.select(F.col(node_id).alias("id"), F.lit(kind).alias("kind"), F.substring(F.col(label), 1, 160).alias("label"), F.lit(LAYERS[kind]).alias("layer"))


def _edges(df: DataFrame, start, end, role, via: str) -> DataFrame:
    wrap = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select(start.alias("from"), end.alias("to"), wrap(role).alias("role"), F.lit(via).alias("via"))


def build_reasoning_graph(sources: DataFrame, spans: DataFrame, selectors: DataFrame, claims: DataFrame, links: DataFrame, assumptions: DataFrame,
                          inferences: DataFrame, findings: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label, layer) and edges (from, to, role, via).

    Every edge names the record it came from. Expected columns: sources(id,
    label), spans and selectors(id, label, source_id), claims(id, label, status,
    sources), links(claim_id, evidence_id, relation), assumptions(id, label),
    inferences(id, label, produces, premises array of ref/role, assumptions),
    findings(id, label, supports array of ref/role, reasoning), conflicts(id,
    label, side_a, side_b).
    """
    c = F.col
    obs = lambda col: F.concat(F.lit("OBS-"), col)
    observed = sources.select(obs(c("id")).alias("id"), F.concat(F.lit("retrieval of "), "id").alias("label"))
    assessed = c("status") == "ASSESSED"
    nodes = union_all([
        _nodes(sources, "source"), _nodes(observed, "observation"), _nodes(spans, "evidence"), _nodes(selectors, "assertion"),
        _nodes(claims.filter(~F.coalesce(assessed, F.lit(False))), "claim"), _nodes(claims.filter(assessed), "assessment"), _nodes(assumptions, "assumption"),
        _nodes(inferences, "inference"), _nodes(findings, "executive_finding"), _nodes(conflicts, "conflict")])
    premises = inferences.select("id", F.explode("premises").alias("p"))
    supports = findings.select("id", F.explode("supports").alias("p"))
    edges = union_all([
        _edges(sources, c("id"), obs(c("id")), "observed_via", "sources"),
        _edges(spans, obs(c("source_id")), c("id"), "preserved_in", "spans"),
        _edges(spans, c("id"), c("source_id"), "from_source", "spans"),
        _edges(selectors, obs(c("source_id")), c("id"), "extracted_from", "selectors"),
        _edges(selectors, c("id"), c("source_id"), "from_source", "selectors"),
        _edges(links, c("evidence_id"), c("claim_id"), F.lower(F.coalesce("relation", F.lit("SUPPORTS"))), "claim evidence"),
        _edges(claims.select("id", F.explode("sources").alias("s")), c("s"), c("id"), "cited_by_claim", "claim sources"),
        _edges(premises, c("p.ref"), c("id"), c("p.role"), "premises"),
        _edges(inferences, c("id"), c("produces"), "produces", "inferences"),
        _edges(inferences.select("id", F.explode("assumptions").alias("a")), c("a"), c("id"), "assumes", "assumptions"),
        _edges(supports, c("p.ref"), c("id"), c("p.role"), "findings"),
        _edges(findings.filter("reasoning IS NOT NULL"), c("reasoning"), c("id"), "reasoned_by", "findings"),
        _edges(conflicts.select("id", F.explode("side_a").alias("r")), c("r"), c("id"), "conflict_side_a", "conflicts"),
        _edges(conflicts.select("id", F.explode("side_b").alias("r")), c("r"), c("id"), "conflict_side_b", "conflicts")])
    return nodes, edges


def diversity_vector(closure: DataFrame, sources: DataFrame, evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Six separate dimensions of support per root; never one number.

    ``closure``: root, node. ``sources``: id, upstream, jurisdiction,
    retrieved. ``evidence``: id, document. ``runs``: source_id.
    """
    backed = runs.select(F.col("source_id").alias("node")).distinct().withColumn("_run", F.lit(1))
    facts = sources.select(F.col("id").alias("node"), F.lit("source").alias("what"), "upstream", "jurisdiction", "retrieved", F.lit(None).cast("string").alias("document"))
    null = F.lit(None).cast("string")
    quoted = evidence.select(F.col("id").alias("node"), F.lit("evidence").alias("what"), null.alias("upstream"), null.alias("jurisdiction"), null.alias("retrieved"), "document")
    known = closure.select("root", "node").join(facts.unionByName(quoted), "node").join(backed, "node", "left")
    rows = known.groupBy("root").agg(
        F.count_if(F.col("what") == "source").alias("source_count"), F.count_if(F.col("what") == "evidence").alias("evidence_count"),
        F.countDistinct("document").alias("document_count"), F.count("_run").alias("run_backed_sources"),
        F.countDistinct("upstream").alias("upstream_families"), F.countDistinct("jurisdiction").alias("jurisdictions"),
        F.min("retrieved").alias("first_retrieved"), F.max("retrieved").alias("last_retrieved"))
    return rows.withColumn("monoculture", F.col("upstream_families") <= 1)


def why_index(nodes: DataFrame, edges: DataFrame, inferences: DataFrame) -> DataFrame:
    """(node, section, ref, role) rows: what supports, disputes and uses a node.

    Rows instead of nested lists, because one source may support a third of all
    nodes.
    """
    role = F.col("role")
    incoming = (
        F.when(role.isin("supports", "cited_by_claim", "preserved_in", "extracted_from"), "supporting")
        .when(role == "contextualizes", "contextualizing")
        .when((role == "contradicts") | role.startswith("conflict_side"), "contradicting")
        .when(role == "produces", "produced_by_inference")
    )
    used = F.when(role.isin("supports", "contradicts", "contextualizes", "reasoned_by"), "used_by")
    a = edges.select(F.col("to").alias("node"), incoming.alias("section"), F.col("from").alias("ref"), "role")
    b = edges.select(F.col("from").alias("node"), used.alias("section"), F.col("to").alias("ref"), "role")
    own = [inferences.select(F.col("produces").alias("node"), F.lit(s).alias("section"), F.explode(s).alias("ref"), F.lit(s).alias("role"))
           for s in ("assumptions", "uncertainty", "alternatives", "counterfactuals") if s in inferences.columns]
    rows = stored(union_all([a, b, *own]).filter("section IS NOT NULL"))
    known = stored(nodes.select(F.col("id").alias("node")))
    # as many partitions as the rows ask for: joined by bytes, a task would sort all that compresses to its share
    parts = max(1, -(-max(rows.count(), known.count()) // ROWS_PER_TASK))
    return rows.repartition(parts, "node").join(known.repartition(parts, "node"), "node", "left_semi")


def why_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("node", "section").agg(F.count(F.lit(1)).alias("n"))


def resolve_ref(refs: DataFrame, spaces: list[tuple[str, DataFrame]]) -> DataFrame:
    """Kind, label and layer of each reference; earlier spaces win.

    ``spaces``: (kind, table of id and label) in order of priority.
    """
    known = union_all([df.select("id", F.struct(F.lit(i).alias("priority"), F.lit(kind).alias("kind"), F.substring("label", 1, 160).alias("label")).alias("hit"))
                       for i, (kind, df) in enumerate(spaces)])
    best = known.groupBy("id").agg(F.min("hit").alias("hit"))
    layer = F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])
    rows = refs.select(F.col("ref").alias("id")).distinct().join(best, "id", "left")
    return rows.select(F.col("id").alias("ref"), F.coalesce("hit.kind", F.lit("unknown")).alias("kind"), "hit.label",
                       F.when(F.col("hit").isNotNull(), F.try_element_at(layer, F.col("hit.kind"))).alias("layer"))


def executive_trace(findings: DataFrame, resolved: DataFrame, diversity: DataFrame) -> DataFrame:
    """(finding, support) rows with what the support is and how diverse the base."""
    supports = findings.select("id", F.explode("supports").alias("p")).select("id", "p.ref", "p.role")
    rows = supports.join(resolved.select("ref", "kind"), "ref", "left")
    return rows.join(diversity.withColumnRenamed("root", "id"), "id", "left")


def inference_detail(inferences: DataFrame, edges: DataFrame, diversity: DataFrame) -> DataFrame:
    """Trust counts of each inference by role and the diversity of its product."""
    trust = edges.groupBy(F.col("to").alias("id")).agg(
        *[F.count_if(F.col("role") == r).alias(r) for r in ("supports", "contradicts", "contextualizes")])
    rows = inferences.select("id", "produces", F.size("premises").alias("premises"), F.size("alternatives").alias("alternatives")).join(trust, "id", "left")
    rows = rows.na.fill(0, ["supports", "contradicts", "contextualizes"])
    return rows.join(diversity.withColumnRenamed("root", "produces"), "produces", "left")


def conflict_sides(conflicts: DataFrame) -> DataFrame:
    """(conflict, side, ref) rows with the state of the resolution."""
    side = lambda name, col: conflicts.select("id", F.lit(name).alias("side"), F.explode(col).alias("ref"), "resolution_state", "remaining_uncertainty")
    return side("a", "side_a").unionByName(side("b", "side_b"))
