"""Graph operators as rounds of joins with reliable lineage cuts.

A hub's edges are spread by adaptive skew joins and partially aggregated, so
no node's neighbourhood is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra import rules
from attestra.functions.time import year_of
from attestra.operators.extract import union_all
from attestra.operators.sources import confidence_of
from attestra.session import cut_lineage, stored


def both_directions(edges: DataFrame) -> DataFrame:
    """Undirected view: every edge as (node, other)."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"))
    return out.union(edges.select("target", "source")).filter("node <> other").distinct()


def _lowest(pointers: DataFrame) -> DataFrame:
    """(node, up) with ``up`` at the end of the chain: each step doubles the reach, and only nodes that are not there yet take part."""
    points = stored(pointers.withColumn("done", F.col("up") == F.col("node")))
    while True:
        target = points.select(F.col("node").alias("up"), F.col("up").alias("_far"), F.col("done").alias("_end"))
        moved = points.filter("NOT done").join(target, "up").select("node", F.col("_far").alias("up"), F.col("_end").alias("done"))
        points = stored(points.filter("done").unionByName(moved))
        if points.filter("NOT done").isEmpty():
            return points.select("node", "up")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) with the smallest node id as the label.

    In every round each node points to its smallest neighbour, or to itself if it
    is smaller, and the nodes of a chain of pointers become one, named by its
    smallest. The next round sees only the edges between these, so its tables
    shrink; the smallest node of a component keeps its name throughout.
    """
    links = stored(edges.select("source", "target").filter("source <> target"))
    rounds = []
    while True:
        ends = links.select(F.col("source").alias("node"), F.col("target").alias("other")).union(links.select("target", "source"))
        near = ends.groupBy("node").agg(F.min("other").alias("_near"))
        rounds.append(_lowest(near.select("node", F.least("node", "_near").alias("up"))))
        up = lambda end: rounds[-1].select(F.col("node").alias(end), F.col("up").alias(f"_{end}"))
        drawn = links.join(up("source"), "source").join(up("target"), "target").filter("_source <> _target")
        links = stored(drawn.select(F.least("_source", "_target").alias("source"), F.greatest("_source", "_target").alias("target")).distinct())
        if links.isEmpty():
            break
    later = rounds[-1]
    for earlier in rounds[-2::-1]:
        onward = later.select(F.col("node").alias("up"), F.col("up").alias("_far"))
        later = earlier.join(onward, "up", "left").select("node", F.coalesce("_far", "up").alias("up"))
    if nodes is None:
        return later.withColumnRenamed("up", "component")
    alone = nodes.select(F.col("id").alias("node")).distinct()
    return alone.join(later, "node", "full_outer").select("node", F.coalesce("up", "node").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


#: Rounds of the plain search before chains are drawn together.
PLAIN_ROUNDS = 12


class _Side:
    """Labels of the search from one end: node, dist, prev and via, the chain that led to it."""

    def __init__(self, links: DataFrame, root: str):
        self.links = links
        self.frontier = links.sparkSession.createDataFrame([(root, 0, None, None)], "node string, dist long, prev string, via string")
        self.seen = self.frontier
        self.least: int | None = 0

    def labels(self) -> DataFrame:
        return self.seen.groupBy("node").agg(F.min(F.struct("dist", "prev", "via")).alias("l")).select("node", "l.*")

    def step(self, round_no: int, bound: int | None) -> None:
        """Relax the links of the frontier; labels of ``bound`` or more cannot be part of a shorter path."""
        near = self.frontier.join(self.links, "node").select(F.col("other").alias("node"), (F.col("dist") + F.col("steps")).alias("dist"), F.col("node").alias("prev"), F.col("chain").alias("via"))
        near = near if bound is None else near.filter(F.col("dist") < bound)
        best = near.groupBy("node").agg(F.min(F.struct("dist", "prev", "via")).alias("l")).select("node", "l.*")
        known = self.seen.groupBy("node").agg(F.min("dist").alias("_known"))
        self.frontier = cut_lineage(best.join(known, "node", "left").filter("_known IS NULL OR dist < _known").drop("_known"))
        self.least = self.frontier.agg(F.min("dist")).first()[0]
        self.seen = self.seen.union(self.frontier)
        if round_no % 8 == 7:
            self.seen = cut_lineage(self.labels())


def _search(links: DataFrame, start: str, goal: str, rounds: int | None) -> tuple[_Side, _Side, tuple[str, int] | None, bool]:
    """Search from both ends: both sides, the meeting node with the length, and whether that is settled.

    Each side keeps one row of constant size for each node. A label is only worth
    following if it, and the least label of the other side's frontier, stay below
    the best length found.
    """
    sides = (_Side(links, start), _Side(links, goal))
    met: tuple[str, int] | None = None
    round_no = 0
    while True:
        joint = sides[0].frontier.union(sides[1].frontier).select("node").distinct()
        totals = [s.seen.join(joint, "node", "left_semi").groupBy("node").agg(F.min("dist").alias(f"_{i}")) for i, s in enumerate(sides)]
        hit = totals[0].join(totals[1], "node").agg(F.min(F.struct((F.col("_0") + F.col("_1")).alias("length"), "node"))).first()[0]
        if hit is not None and (met is None or (hit.length, hit.node) < (met[1], met[0])):
            met = (hit.node, hit.length)
        at = [s.least for s in sides]
        if None in at or (met is not None and sum(at) >= met[1]):
            return *sides, met, True
        if rounds is not None and round_no >= rounds:
            return *sides, met, False
        # the side that has come less far goes first
        for side, other in (sides, sides[::-1]) if at[0] <= at[1] else (sides[::-1], sides):
            if side.least is not None:
                side.step(round_no, None if met is None else met[1] - (other.least or 0))
        round_no += 1


def _chains(links: DataFrame, start: str, goal: str) -> tuple[DataFrame, DataFrame]:
    """Links between the nodes that are not inside a chain, and the steps along the chains.

    A node with two neighbours is inside a chain. Every step along a chain points
    to the step after it; pointers are doubled, so a chain of any length is
    followed in a few rounds. Links: node, other, steps, chain. Steps: node,
    other, chain, left (steps from ``other`` to the chain's end).
    """
    degree = links.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    inner = cut_lineage(degree.filter((F.col("_n") == 2) & ~F.col("node").isin(start, goal)).select("node"))
    from_inner = links.join(inner, "node", "left_semi")
    into = links.join(inner.select(F.col("node").alias("other"), F.lit(True).alias("_goes_on")), "other", "left").select("node", "other", F.coalesce("_goes_on", F.lit(False)).alias("goes_on"))
    onward = from_inner.select(F.col("node").alias("other"), F.col("other").alias("_next"))
    ahead = into.filter("goes_on").join(onward, "other").filter("_next <> node")
    # the step that is ``left`` steps ahead; a step into an end points to itself
    points = into.filter("NOT goes_on").select("node", "other", F.col("node").alias("to_node"), F.col("other").alias("to_other"), F.lit(0).cast("long").alias("left"), F.lit(True).alias("done"))
    points = points.union(ahead.select("node", "other", F.col("other"), F.col("_next"), F.lit(1).cast("long"), F.lit(False)))
    points = cut_lineage(points)
    reach, last = 1, -1
    while True:
        waiting = points.filter("NOT done").count()
        if not waiting or waiting == last and reach > waiting:
            # what still waits runs in a ring without an end
            break
        last = waiting
        target = points.select(F.col("node").alias("to_node"), F.col("other").alias("to_other"), F.col("to_node").alias("_n"), F.col("to_other").alias("_o"), F.col("left").alias("_l"), F.col("done").alias("_d"))
        moved = points.filter("NOT done").join(target, ["to_node", "to_other"]).select("node", "other", F.col("_n").alias("to_node"), F.col("_o").alias("to_other"), (F.col("left") + F.col("_l")).alias("left"), F.col("_d").alias("done"))
        points = cut_lineage(points.filter("done").union(moved))
        reach *= 2
    chain = F.to_json(F.array("to_node", "to_other"))
    steps = cut_lineage(points.filter("done").select("node", "other", F.col("to_other").alias("_end"), chain.alias("chain"), "left"))
    whole = steps.join(inner, "node", "left_anti").filter("node <> _end").groupBy("node", F.col("_end").alias("other")).agg(F.min(F.struct((F.col("left") + 1).alias("steps"), "chain")).alias("c"))
    return cut_lineage(whole.select("node", "other", "c.*")), steps.drop("_end")


def _trail(side: _Side, node: str) -> DataFrame:
    """Labels on the way from the root of a side to ``node``; pointers to the predecessors are doubled."""
    labels = cut_lineage(side.labels())
    jump = labels.filter("prev IS NOT NULL").select("node", F.col("prev").alias("to"))
    on = labels.filter(F.col("node") == node).select("node")
    while True:
        on = cut_lineage(on.union(on.join(jump, "node").select("to")).distinct())
        jump = cut_lineage(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("_far")), "to").select("node", F.col("_far").alias("to")))
        if jump.join(on, "node", "left_semi").isEmpty():
            break
    return labels.join(on, "node", "left_semi")


def shortest_path(edges: DataFrame, start: str, goal: str, plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """(step, node, hops): one unweighted undirected shortest path; empty if there is none.

    Both ends search towards each other. If they have not met after
    ``plain_rounds`` rounds, chains of nodes with two neighbours are drawn
    together to single links, and the search starts again on what is left. Only
    one predecessor is kept for each node and side; the path is read back at
    the end. The choice among equal paths depends on ids only.
    """
    spark = edges.sparkSession
    links = cut_lineage(both_directions(edges))
    schema = "step long, node string, hops long"
    if start == goal:
        return spark.createDataFrame([(0, start, 0)], schema)
    steps = None
    one = links.withColumns({"steps": F.lit(1).cast("long"), "chain": F.lit(None).cast("string")})
    front, back, met, settled = _search(one, start, goal, plain_rounds)
    if not settled:
        whole, steps = _chains(links, start, goal)
        front, back, met, _ = _search(whole, start, goal, None)
    if met is None:
        return spark.createDataFrame([], schema)
    node, hops = met
    out = []
    for side, place in ((front, lambda d: d), (back, lambda d: F.lit(hops) - d)):
        trail = cut_lineage(_trail(side, node))
        out.append(trail.select(place(F.col("dist")).alias("step"), "node"))
        if steps is not None:
            inside = trail.filter("via IS NOT NULL").select(F.col("via").alias("chain"), "dist").join(steps, "chain").filter("left > 0")
            out.append(inside.select(place(F.col("dist") - F.col("left")).alias("step"), F.col("other").alias("node")))
    return union_all(out).distinct().withColumn("hops", F.lit(hops).cast("long"))


def carry_up(edges: DataFrame, facts: DataFrame, roles: list[str] | None = None, max_depth: int = 12) -> DataFrame:
    """(node, fact): the facts of everything that a node rests on.

    ``edges``: from, to, role. ``facts``: node, fact. Each round hands the facts
    that are new to a node on to what rests on it, so there is never more than
    one row for each node and fact, and none for the nodes in between. Reaches
    as far as ``support_closure``; a node's own facts do not count.
    """
    kept = edges.filter(F.col("role").isin(roles or rules.SUPPORT_ROLES)).select(F.col("from").alias("node"), F.col("to").alias("_next"))
    kept = cut_lineage(kept.distinct())
    frontier = cut_lineage(facts.select("node", "fact").distinct())
    seen = frontier
    found = [frontier.limit(0)]
    for _ in range(max_depth + 1):
        step = frontier.join(kept, "node").select(F.col("_next").alias("node"), "fact").distinct()
        frontier = cut_lineage(step.join(seen, ["node", "fact"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        found.append(frontier)
    return union_all(found)


def support_closure(edges: DataFrame, roots: DataFrame, roles: list[str] | None = None, max_depth: int = 12) -> DataFrame:
    """(root, node, depth): everything a root rests on, with the least depth.

    ``edges``: from, to, role. ``roots``: id. A root at depth zero is examined,
    so nodes up to ``max_depth + 1`` edges away are found.
    """
    kept = edges.filter(F.col("role").isin(roles or rules.SUPPORT_ROLES)).select(F.col("to").alias("node"), F.col("from").alias("_next"))
    kept = cut_lineage(kept.distinct())
    frontier = cut_lineage(roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct())
    seen = frontier
    found = []
    for depth in range(1, max_depth + 2):
        step = frontier.join(kept, "node").select("root", F.col("_next").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        found.append(frontier.withColumn("depth", F.lit(depth)))
    if not found:
        return frontier.withColumn("depth", F.lit(0))
    return union_all(found)


def resolves_to_evidence(refs: DataFrame, edges: DataFrame, evidence: DataFrame, max_depth: int = 6) -> DataFrame:
    """Does each reference reach a preserved evidence id?"""
    itself = refs.select(F.col("id").alias("root"), F.col("id").alias("node"))
    reached = support_closure(edges, refs, max_depth=max_depth).select("root", "node").union(itself)
    backed = reached.join(evidence.select(F.col("id").alias("node")), "node", "left_semi").select("root").distinct()
    flagged = refs.select("id").distinct().join(backed.select(F.col("root").alias("id"), F.lit(True).alias("_ok")), "id", "left")
    return flagged.select("id", F.coalesce("_ok", F.lit(False)).alias("evidence_backed"))


# ------------------------------------------------------------ visibility


def filter_category_mode(nodes: DataFrame, edges: DataFrame, mode: list[str], root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a category mode and the edges whose both ends are visible."""
    if "*" in mode:
        return nodes, visible_edges(nodes, edges)
    wanted = F.array(*[F.lit(m) for m in mode])
    seen = nodes.filter((F.col("id") == root) | F.coalesce(F.arrays_overlap("cats", wanted), F.lit(False)))
    return seen, visible_edges(seen, edges.filter(F.col("cat").isin(mode)))


def visible_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select(F.col("id").alias("source"))
    b = nodes.select(F.col("id").alias("target"))
    return edges.join(a, "source", "left_semi").join(b, "target", "left_semi")


def filter_expand_group(nodes: DataFrame, expanded: list[str], root: str) -> DataFrame:
    return nodes.filter(F.col("expand").isNull() | (F.col("id") == root) | F.col("expand").isin(expanded))


def filter_confidence(df: DataFrame, levels: list[str]) -> DataFrame:
    return df.filter(F.col("status").isNull() | confidence_of(F.col("status")).isin(levels))


def filter_source_class(df: DataFrame, key: str, classes: DataFrame, enabled: list[str]) -> DataFrame:
    """Keep rows with an enabled class, without sources, or without any class.

    ``classes``: source_id, class.
    """
    cited = df.select(key, F.explode("sources").alias("source_id")).join(classes, "source_id", "left")
    cls = F.coalesce("class", F.lit("other"))
    per = cited.groupBy(key).agg(F.bool_or(cls.isin(enabled)).alias("_on"), F.bool_and(cls == "other").alias("_plain"))
    return df.join(per, key, "left").filter("_on IS NULL OR _on OR _plain").drop("_on", "_plain")


def as_of_year(df: DataFrame, year: int, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows whose validity covers a year; an unknown start always passes."""
    since, until = year_of(F.col(start)), year_of(F.col(end))
    return df.filter(since.isNull() | ((since <= year) & (until.isNull() | (until >= year))))


# ------------------------------------------------------------ derived edges


def record_layers(nodes: DataFrame, claims: DataFrame, sources: DataFrame, root: str) -> DataFrame:
    """Claim and evidence edges derived from the records themselves."""
    clm = lambda c: F.concat(F.lit("clm:"), c)
    src = lambda c: F.concat(F.lit("src:"), c)
    to_root = claims.select(F.concat(F.lit("ce:"), "id").alias("id"), clm(F.col("id")).alias("source"), F.lit(root).alias("target"), F.lit("claim").alias("label"))
    listed = nodes.filter(F.col("id") != root).select(F.col("id").alias("node"), F.explode(F.array_distinct("claims")).alias("claim"))
    about = listed.join(claims.select(F.col("id").alias("claim")), "claim").select(
        F.concat_ws(":", F.lit("ce"), "claim", "node").alias("id"), clm(F.col("claim")).alias("source"), F.col("node").alias("target"), F.lit("about").alias("label"))
    known = sources.select(F.col("id").alias("source_id"))
    to_node = nodes.select(F.col("id").alias("node"), F.explode(F.array_distinct("sources")).alias("source_id")).join(known, "source_id").select(
        F.concat_ws(":", F.lit("se"), "source_id", "node").alias("id"), src(F.col("source_id")).alias("source"), F.col("node").alias("target"), F.lit("cited by").alias("label"))
    to_claim = claims.select(F.col("id").alias("claim"), F.explode(F.array_distinct("sources")).alias("source_id")).join(known, "source_id").select(
        F.concat(F.lit("se:"), "source_id", F.lit(":clm:"), "claim").alias("id"), src(F.col("source_id")).alias("source"), clm(F.col("claim")).alias("target"), F.lit("supports").alias("label"))
    return union_all([to_root, about, to_node, to_claim])


def backlinks(claims: DataFrame, nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per claim: entities that list it, mentions in prose, and their sum.

    ``mentions``: one row (claim_id) per mention.
    """
    listed = nodes.select(F.explode(F.array_distinct("claims")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("entities"))
    named = mentions.groupBy(F.col("claim_id").alias("id")).agg(F.count(F.lit(1)).alias("mentions"))
    rows = claims.select("id").join(listed, "id", "left").join(named, "id", "left").na.fill(0)
    return rows.withColumn("backlinks", F.col("entities") + F.col("mentions"))


def entity_edges(edges: DataFrame) -> DataFrame:
    """Incident edges of every node with direction and the other end."""
    out = edges.select(F.col("source").alias("node"), F.col("id").alias("edge"), F.lit("out").alias("direction"), F.col("target").alias("other"))
    return out.unionByName(edges.select(F.col("target").alias("node"), F.col("id").alias("edge"), F.lit("in").alias("direction"), F.col("source").alias("other")))


def degrees(edges: DataFrame) -> DataFrame:
    return entity_edges(edges).groupBy("node").agg(F.countDistinct("edge").alias("degree"))


def top_degree(edges: DataFrame, k: int = 6) -> DataFrame:
    """The k best connected nodes: aggregated first, then a top-k per task."""
    deg = entity_edges(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return deg.orderBy(F.col("degree").desc(), "node").limit(k)


def confidence_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(confidence_of(F.col("status")).alias("confidence")).agg(F.count(F.lit(1)).alias("edges"))


def graph_analytics(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """(metric, value) rows: clusters, weak edges and unsourced nodes."""
    row = lambda df, name, cond: df.agg(F.lit(name).alias("metric"), F.count_if(cond).alias("value"))
    return union_all([
        components.agg(F.lit("components").alias("metric"), F.countDistinct("component").alias("value")),
        row(edges, "self_reported_edges", F.col("status") == "SELF_REPORTED"),
        row(edges, "contradicted_edges", F.col("status") == "CONTRADICTED"),
        row(nodes, "nodes_without_sources", F.size("sources") == 0)])
