"""Merkle manifest of a dataset with retained SHA-256 midstates.

Leaves of a language ascend by id; every FAN consecutive nodes become their parent until
one node, the subroot, is left; the subroots become the root in the same way.

1. Leaf hashes come from built-in functions. A range sort numbers them inside their
   language without bringing a language together.
2. A group of FAN ** HEIGHT consecutive nodes is one subtree of HEIGHT levels. It is
   hashed by itself; what remains of a tree is grouped again, so a tree of any size is
   done in a few rounds, and a path to the root is put together from the rounds.
3. For its proofs a group keeps, for every parent, a copy of the running hash before
   each child slot. A changed child resumes its parent's hash there: it feeds the
   replacement and the siblings to its right; those to its left are never hashed again.
   Parents above the group get their midstates once for the whole group.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm.common import settle

FAN = 8
#: Levels of one group: at most 8^4 = 4,096 nodes.
HEIGHT = 4
#: Key of the tree over the subroots.
_TOP = "root"
_LOW_BITS = (1 << 33) - 1


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the fields, each led by its length in bytes, or ``-`` for null."""
    return F.sha2(F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with pos, 0.. inside each tree by doc_id and leaf, and size, the leaves of the tree."""
    order = ["tree", F.col("doc_id").asc_nulls_first(), "leaf", "mark"]
    spread = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(spread.withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(_LOW_BITS))
    placed = placed.withColumns({"part": part, "row": row})
    # a tree has one row for each partition that it reaches
    runs = placed.groupBy("part", "tree").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("part", "tree", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("tree")).alias("size"))
    joined = placed.join(runs, ["part", "tree"])
    return joined.withColumn("pos", F.col("row") - F.col("first") + F.col("before")).drop("at", "part", "row", "first", "before", "mark")


def _heights(size: int) -> int:
    """Levels that a group of a tree of ``size`` nodes has."""
    levels = 0
    while size > 1 and levels < HEIGHT:
        size, levels = -(-size // FAN), levels + 1
    return levels


def _parents(nodes: list[bytes]) -> list[bytes]:
    return [sha256(b"".join(nodes[i : i + FAN])).hexdigest().encode() for i in range(0, len(nodes), FAN)]


def _levels(nodes: list[bytes], size: int) -> list[list[bytes]]:
    """The nodes of each level of a group, its own first, the one that remains last."""
    levels = [nodes]
    for _ in range(_heights(size)):
        levels.append(_parents(levels[-1]))
    return levels


def _remaining(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pos")
    nodes = [d.encode() for d in group["digest"]]
    top = _levels(nodes, int(group["size"].iloc[0]))[-1][0]
    return pd.DataFrame({"tree": [group["tree"].iloc[0]], "pos": [group["pos"].iloc[0] // FAN**HEIGHT], "digest": [top.decode()]})


def _path(levels: list[list[bytes]], i: int) -> tuple[list[int], list[str]]:
    """Slot of node ``i`` and digests of its run, concatenated, at each level."""
    slots, runs = [], []
    for nodes in levels[:-1]:
        slots.append(i % FAN)
        runs.append(b"".join(nodes[i - i % FAN : i - i % FAN + FAN]).decode())
        i //= FAN
    return slots, runs


def _paths(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pos")
    nodes = [d.encode() for d in group["digest"]]
    levels = _levels(nodes, int(group["size"].iloc[0]))
    found = [_path(levels, i) for i in range(len(nodes))]
    return pd.DataFrame({"tree": group["tree"], "pos": group["pos"], "slots": [s for s, _ in found], "runs": [r for _, r in found]})


def _remains(nodes: DataFrame) -> DataFrame:
    """tree, pos, digest of what one round leaves of ``nodes``: tree, pos, size, digest."""
    group = F.expr(f"pos div {FAN**HEIGHT}")
    return nodes.select("tree", "pos", "size", "digest", group.alias("unit")).groupBy("tree", "unit").applyInPandas(_remaining, "tree string, pos long, digest string")


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (tree, pos, slots, runs) of ``nodes`` to the top of their tree, and the tops (tree, digest).

    ``nodes``: tree, pos, digest; one for each group of the round before, so few.
    """
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    nodes = settle(nodes.join(sizes, "tree"))
    group = F.expr(f"pos div {FAN**HEIGHT}")
    paths = nodes.withColumn("unit", group).groupBy("tree", "unit").applyInPandas(_paths, "tree string, pos long, slots array<int>, runs array<string>")
    left = settle(_remains(nodes))
    if nodes.filter(F.col("size") > FAN**HEIGHT).isEmpty():
        return paths, left.select("tree", "digest")
    above, tops = _climb(left)
    above = above.select("tree", F.col("pos").alias("unit"), F.col("slots").alias("more_slots"), F.col("runs").alias("more_runs"))
    joined = settle(paths).withColumn("unit", group).join(above, ["tree", "unit"])
    return joined.select("tree", "pos", F.concat("slots", "more_slots").alias("slots"), F.concat("runs", "more_runs").alias("runs")), tops


class Midstates:
    """Running hashes of the parents of a group, copied before each child slot."""

    def __init__(self, levels: list[list[bytes]]):
        self.levels = levels
        self.kept = [[self._states(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)] for nodes in levels[:-1]]

    @staticmethod
    def _states(children: list[bytes]) -> list:
        state, kept = sha256(), []
        for child in children:
            kept.append(state.copy())
            state.update(child)
        return kept

    def fold(self, i: int, replacement: bytes) -> bytes:
        """What remains of the group if node ``i`` is replaced."""
        for nodes, parents in zip(self.levels, self.kept, strict=False):
            slot, first = i % FAN, i - i % FAN
            state = parents[i // FAN][slot].copy()
            state.update(replacement)
            for sibling in nodes[i + 1 : first + FAN]:
                state.update(sibling)
            replacement, i = state.hexdigest().encode(), i // FAN
        return replacement

    def siblings(self, i: int) -> bytes:
        """Siblings of node ``i`` and of its parents, level by level."""
        out = []
        for nodes in self.levels[:-1]:
            first = i - i % FAN
            out += [*nodes[first:i], *nodes[i + 1 : first + FAN]]
            i //= FAN
        return b"".join(out)


def _proven(leaves: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
    leaves = leaves.sort_values("pos")
    own = [d.encode() for d in leaves["leaf"]]
    states = Midstates(_levels(own, int(leaves["size"].iloc[0])))
    above, shared = [], []
    for slot, run in zip(path["slots"].iloc[0], path["runs"].iloc[0], strict=True):
        run = run.encode()
        left, right = run[: 64 * slot], run[64 * slot + 64 :]
        above.append((sha256(left), right))
        shared.append(left + right)
    common = b"".join(shared)
    changed = [other.encode() if isinstance(other, str) else leaf for leaf, other in zip(own, leaves["tampered"], strict=True)]
    folded, proofs = [], []
    for i, leaf in enumerate(changed):
        digest = states.fold(i, leaf)
        for state, right in above:
            state = state.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        folded.append(digest.decode())
        proofs.append(sha256(states.siblings(i) + common).hexdigest())
    subroot, root = path["subroot"].iloc[0], path["root"].iloc[0]
    return pd.DataFrame(
        {
            "doc_id": leaves["doc_id"], "leaf": leaves["leaf"], "subroot": subroot, "root": root,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        }
    )


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``.

    ``docs``: doc_id, source, lang, n_chars, text; other columns are ignored. Any of them
    may be null: the field hashes as ``-``, rows without lang form a tree of their own,
    rows without doc_id come first in theirs and are never tampered with. Rows of one id
    are ordered by their leaf; equal rows are leaves each. A lone leaf is its subroot, a
    lone subroot the root, and the proof of a lone leaf in a lone tree is the hash of
    nothing. An empty table gives an empty result.
    """
    doc_id, lang, text = F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = (F.col("source"), lang, F.col("n_chars"))
    tamper = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(
        doc_id.alias("doc_id"),
        # '' stands before all others, so null comes first
        F.coalesce(F.concat(F.lit("+"), lang), F.lit("")).alias("tree"),
        leaf_hash(doc_id, *rest, text).alias("leaf"),
        F.when(tamper, leaf_hash(doc_id, *rest, lowered)).alias("tampered"),
        F.monotonically_increasing_id().alias("mark"),
    )
    leaves = settle(_numbered(settle(leaves)))
    unit = F.expr(f"pos div {FAN**HEIGHT}")
    tops = settle(_remains(leaves.select("tree", "pos", "size", F.col("leaf").alias("digest"))))
    paths = _paths_to_root(tops).groupBy("tree", "unit")
    # as text, because pandas turns long columns with nulls into doubles
    groups = leaves.withColumns({"unit": unit, "doc_id": F.col("doc_id").cast("string")}).groupBy("tree", "unit")
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return groups.cogroup(paths).applyInPandas(_proven, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def _paths_to_root(tops: DataFrame) -> DataFrame:
    """Of every group of leaves: tree, unit, slots and runs up to the root, subroot, root."""
    inner, subroots = _climb(tops)
    # numbered by one sort over the trees, not over the leaves
    trees = subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("doc_id"), F.col("digest").alias("leaf"), F.lit(0).alias("mark"))
    numbered = settle(_numbered(settle(trees)).select("tree", F.col("doc_id").alias("of"), "pos", F.col("leaf").alias("digest")))
    outer, root = _climb(numbered.select("tree", "pos", "digest"))
    outer = numbered.join(outer, ["tree", "pos"]).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("slots").alias("more_slots"), F.col("runs").alias("more_runs"))
    # one row, none for an empty table
    top = root.first()
    joined = settle(inner).join(outer, "tree")
    return joined.select(
        "tree", F.col("pos").alias("unit"), F.concat("slots", "more_slots").alias("slots"), F.concat("runs", "more_runs").alias("runs"),
        "subroot", F.lit(top.digest if top else None).cast("string").alias("root"),
    )


def _oracle(inner: int = 10, outer: int = 4) -> str:
    """The same in SQL, level by level: ``inner`` levels below the subroots, ``outer`` above."""
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')])),"
        " lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    )
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    field = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
    hashed = "sha256(" + " || ".join(field.format(f) for f in fields) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tampered = "sha256(" + " || ".join(field.format(lowered if f == "text" else f) for f in fields) + ")"
    parts = [
        f"""base AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, {hashed} AS leaf,
  CASE WHEN coalesce({crc} % 3 = 0, false) THEN {tampered} ELSE {hashed} END AS changed FROM documents)""",
        "n0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size, leaf AS h, doc_id, leaf, changed FROM base)",
        "d0 AS (SELECT tree, pos, doc_id, leaf, changed AS folded, '' AS proof FROM n0)",
    ]

    def level(k: int) -> None:
        parts.append(f"c{k} AS (SELECT tree, pos // 8 AS up, any_value(size) AS size, list(h ORDER BY pos) AS run FROM n{k} GROUP BY tree, pos // 8)")
        parts.append(f"n{k + 1} AS (SELECT tree, up AS pos, CASE WHEN size > 1 THEN (size + 7) // 8 ELSE 1 END AS size, CASE WHEN size > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM c{k})")
        slot = "(d.pos % 8)::INT"
        parts.append(
            f"""d{k + 1} AS (SELECT d.* REPLACE (d.pos // 8 AS pos,
  CASE WHEN size > 1 THEN proof || array_to_string(run[1:{slot}], '') || array_to_string(run[{slot} + 2:], '') ELSE proof END AS proof,
  CASE WHEN size > 1 THEN sha256(array_to_string(run[1:{slot}], '') || folded || array_to_string(run[{slot} + 2:], '')) ELSE folded END AS folded)
  FROM d{k} d JOIN c{k} c ON d.tree = c.tree AND d.pos // 8 = c.up)"""
        )

    for k in range(inner):
        level(k)
    k = inner + 1
    parts.append(f"n{k} AS (SELECT '{_TOP}' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size, h, tree AS of FROM n{inner})")
    parts.append(f"d{k} AS (SELECT d.* REPLACE (n.pos AS pos, '{_TOP}' AS tree), n.h AS subroot FROM d{inner} d JOIN n{k} n ON d.tree = n.of)")
    for j in range(k, k + outer):
        level(j)
    last = k + outer
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM d{last} JOIN n{last} USING (tree)"
    )


#: Trees of up to 8^10 leaves and 8^4 languages.
ORACLE = _oracle()
