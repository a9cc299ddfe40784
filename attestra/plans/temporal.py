"""Queries on snapshots, differences and change records."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.functions.time import parse_valid_time
from attestra.operators import changes as C
from attestra.operators import diff as D
from attestra.operators import history as H
from attestra.operators import snapshot as S
from attestra.operators.classify import epistemic_transition, materiality_rank, status_rank
from attestra.operators.extract import live, superseded
from attestra.operators.numbering import lag_within
from attestra.plans.inputs import claim_records, cte, objects, snapshots, source_records, table, with_ctes
from attestra.plans.registry import query
from attestra.session import stored

joined = lambda c: F.array_join(c, ",")


def pairs(spark, sf):
    return S.adjacent_pairs(snapshots(spark, sf))


def at(spark, sf, seq):
    return objects(spark, sf).filter(F.col("snapshot_sequence") == seq)


def diffs(spark, sf):
    return D.diff_chain(objects(spark, sf), pairs(spark, sf))


def stored_diffs(spark, sf):
    """Differences without payloads, for queries that read them several times."""
    side = lambda n: F.when(F.col(n).isNotNull(), F.struct(F.lit(True).alias("known"))).alias(n)
    return stored(diffs(spark, sf).select("from_snapshot_id", "to_snapshot_id", "object_type", "object_id", "change_kind", side("old"), side("new")))


def changes(spark, sf):
    return C.build_changes(objects(spark, sf), pairs(spark, sf))


cte("snaps", "SELECT DISTINCT seq, snapshot_id, cutoff FROM objects", ["objects"])
cte(
    "pairs",
    """SELECT a.seq AS from_seq, b.seq AS to_seq, a.snapshot_id AS from_snapshot_id, b.snapshot_id AS to_snapshot_id,
       a.cutoff AS from_cutoff, b.cutoff AS to_cutoff FROM snaps a JOIN snaps b ON b.seq = a.seq + 1""",
    ["snaps"],
)
cte(
    "diffs",
    """
  SELECT p.*, coalesce(n.object_type, o.object_type) AS object_type, coalesce(n.object_id, o.object_id) AS object_id,
         CASE WHEN o.object_id IS NULL THEN 'added' WHEN n.object_id IS NULL THEN 'removed'
              WHEN o.content_hash <> n.content_hash THEN 'changed' ELSE 'unchanged' END AS change_kind,
         o.content_hash AS old_hash, n.content_hash AS new_hash, n.valid_from AS effective_at,
         o.status AS old_status, n.status AS new_status, o.sources AS old_sources, n.sources AS new_sources,
         o.superseded AS old_sup, n.superseded AS new_sup, o.text AS old_text, n.text AS new_text,
         o.availability AS old_avail, n.availability AS new_avail, n.tier AS tier, n.predicate AS predicate,
         coalesce(n.retrieved, o.retrieved) AS own_retrieval
  FROM (SELECT seq + 1 AS k, * FROM objects) o FULL OUTER JOIN (SELECT seq AS k, * FROM objects) n
       ON o.k = n.k AND o.object_type = n.object_type AND o.object_id = n.object_id
       JOIN pairs p ON p.to_seq = coalesce(n.k, o.k)
""",
    ["objects", "pairs"],
)
cte(
    "fields",
    """
  SELECT *, list_filter([
      CASE WHEN change_kind = 'changed' AND old_avail IS DISTINCT FROM new_avail THEN 'availability' END,
      CASE WHEN change_kind = 'changed' AND old_sources IS DISTINCT FROM new_sources THEN 'sources' END,
      CASE WHEN change_kind = 'changed' AND old_status IS DISTINCT FROM new_status THEN 'status' END,
      CASE WHEN change_kind = 'changed' AND old_sup IS DISTINCT FROM new_sup THEN 'superseded' END,
      CASE WHEN change_kind = 'changed' AND old_sup IS DISTINCT FROM new_sup THEN 'supersededBy' END,
      CASE WHEN change_kind = 'changed' AND old_sup IS DISTINCT FROM new_sup THEN 'supersededReason' END,
      CASE WHEN change_kind = 'changed' AND old_text IS DISTINCT FROM new_text THEN 'text' END], lambda x: x IS NOT NULL) AS fields,
    CASE WHEN old_status IN ('SELF_REPORTED', 'ASSESSED') THEN 1 WHEN old_status = 'CORROBORATED' THEN 2 WHEN old_status = 'VERIFIED_PRIMARY' THEN 3 END AS ra,
    CASE WHEN new_status IN ('SELF_REPORTED', 'ASSESSED') THEN 1 WHEN new_status = 'CORROBORATED' THEN 2 WHEN new_status = 'VERIFIED_PRIMARY' THEN 3 END AS rb
  FROM diffs
""",
    ["diffs"],
)
cte(
    "classed",
    """
  SELECT *, CASE
      WHEN change_kind = 'removed' THEN ['OBJECT_REMOVED_FROM_PUBLICATION', 'MEDIUM', 'UNKNOWN']
      WHEN change_kind = 'added' AND object_type = 'claim' THEN ['CLAIM_ADDED', 'LOW', CASE WHEN rb >= 2 THEN 'STRENGTHENED' ELSE 'NO_EPISTEMIC_CHANGE' END]
      WHEN change_kind = 'added' AND object_type = 'source' THEN ['SOURCE_ADDED', CASE WHEN tier = 1 THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN tier = 1 THEN 'STRENGTHENED' ELSE 'NO_EPISTEMIC_CHANGE' END]
      WHEN change_kind = 'added' THEN ['RELATIONSHIP_ADDED', CASE WHEN predicate IN ('OWNS', 'SHAREHOLDER_OF') AND new_status = 'VERIFIED_PRIMARY' THEN 'HIGH' ELSE 'LOW' END,
           CASE WHEN new_status = 'VERIFIED_PRIMARY' THEN 'STRENGTHENED' ELSE 'NO_EPISTEMIC_CHANGE' END]
      WHEN object_type = 'source' THEN ['SOURCE_AVAILABILITY_CHANGED', 'MEDIUM', 'NO_EPISTEMIC_CHANGE']
      WHEN object_type = 'claim' AND list_contains(fields, 'superseded') AND new_sup THEN ['CLAIM_SUPERSEDED', 'MEDIUM', 'CORRECTED']
      WHEN list_contains(fields, 'status') THEN ['STATUS_CHANGED', 'MEDIUM', CASE WHEN new_status = 'CONTRADICTED' THEN 'CONTRADICTED'
           WHEN old_status = 'CONTRADICTED' THEN 'RESOLVED' WHEN rb > ra THEN 'STRENGTHENED' WHEN rb < ra THEN 'WEAKENED' ELSE 'NO_EPISTEMIC_CHANGE' END]
      WHEN object_type = 'claim' AND list_contains(fields, 'text') THEN ['CLAIM_CORRECTED', 'MEDIUM', 'CORRECTED']
      WHEN object_type = 'claim' AND list_contains(fields, 'sources') THEN ['EVIDENCE_ADDED', 'LOW', 'STRENGTHENED']
      END AS cls
  FROM fields WHERE change_kind <> 'unchanged'
""",
    ["fields"],
)
cte(
    "changed",
    """
  SELECT *, 'CHG-' || CASE WHEN length(no::VARCHAR) >= 4 THEN no::VARCHAR ELSE lpad(no::VARCHAR, 4, '0') END AS change_id,
    change_kind || ' ' || object_type || ' ' || object_id || CASE WHEN len(fields) > 0 THEN ' fields=[' || array_to_string(fields, ',') || ']' ELSE '' END AS technical_summary,
    CASE WHEN cls[1] IN ('PUBLICATION_METADATA_CHANGED', 'OBJECT_REMOVED_FROM_PUBLICATION') THEN 'PUBLICATION_CHANGE'
         WHEN cls[1] IN ('OBJECT_CORRECTED', 'CLAIM_CORRECTED', 'CLAIM_SUPERSEDED', 'FINANCIAL_VALUE_CORRECTED') THEN 'CORRECTION'
         WHEN effective_at > from_cutoff AND effective_at <= to_cutoff THEN 'WORLD_CHANGE' ELSE 'KNOWLEDGE_CHANGE' END AS category
  FROM (SELECT *, row_number() OVER (ORDER BY to_seq, CASE change_kind WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END,
               object_type || ':' || object_id) AS no FROM classed)
""",
    ["classed"],
)
cte(
    "observed",
    """
  SELECT c.to_seq, c.object_type, c.object_id, c.change_kind, min(s.retrieved) AS oldest
  FROM (SELECT to_seq, object_type, object_id, change_kind, unnest(new_sources) AS sid FROM classed WHERE object_type <> 'source') c
       JOIN source_records s ON s.seq = c.to_seq AND s.id = c.sid GROUP BY ALL
""",
    ["classed", "source_records"],
)


@query("P1_extract_objects", with_ctes("objects", """
SELECT snapshot_id, object_type, object_id, object_id || '@' || content_hash AS revision_id, content_hash, payload, valid_from,
  CASE WHEN valid_from IS NULL THEN 'UNKNOWN' ELSE 'EXACT_DATE' END AS valid_time_precision FROM objects"""))
def _(spark, sf):
    return objects(spark, sf).select("snapshot_id", "object_type", "object_id", "revision_id", "content_hash", "payload",
                                     "valid_from", "valid_time_precision")


@query("P2_live_superseded", with_ctes("claim_records", """
SELECT snapshot_id, id, 'live' AS part FROM claim_records WHERE NOT superseded
UNION ALL SELECT snapshot_id, id, 'superseded' FROM claim_records WHERE superseded"""))
def _(spark, sf):
    c = claim_records(spark, sf)
    a = live(c).select("snapshot_id", "id", F.lit("live").alias("part"))
    return a.unionByName(superseded(c).select("snapshot_id", "id", F.lit("superseded").alias("part")))


@query("A2_snapshot_counts", with_ctes("objects", """
SELECT snapshot_id, count(*) AS objects, count(*) FILTER (object_type = 'claim') AS claims,
  count(*) FILTER (object_type = 'claim' AND NOT superseded) AS claims_live, count(*) FILTER (superseded) AS claims_superseded,
  count(*) FILTER (object_type = 'source') AS sources, count(*) FILTER (object_type = 'relationship') AS relationships
FROM objects GROUP BY snapshot_id"""))
def _(spark, sf):
    return S.snapshot_counts(objects(spark, sf), ["snapshot_id"]).select(
        "snapshot_id", "objects", "claims", "claims_live", "claims_superseded", "sources", "relationships")


TREE = """
l AS (SELECT snapshot_id, substr(sha256(object_type || ':' || object_id), 1, 6) AS p, LINE AS line FROM objects),
a AS (SELECT snapshot_id, p, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY ALL),
b AS (SELECT snapshot_id, substr(p, 1, 3) AS q, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p || ':' || h)) AS h FROM a GROUP BY ALL),
t AS (SELECT snapshot_id, sha256(string_agg(q || ':' || h, chr(10) ORDER BY q || ':' || h)) AS h FROM b GROUP BY ALL)"""
LINE = "object_type || ':' || object_id || '@' || content_hash"
cte("tree", "SELECT snapshot_id, h FROM (WITH " + TREE.replace("LINE", LINE) + " SELECT * FROM t)", ["objects"])


@query("A13_semantic_hash", with_ctes("tree", "SELECT snapshot_id, h AS content_hash, 'tree' AS hash_mode FROM tree"))
def _(spark, sf):
    return S.semantic_hash(objects(spark, sf), ["snapshot_id"])


FULL = """object_type || ':' || object_id || ' {"content_hash":"' || content_hash || '","object_id":"' || object_id || '","object_type":"'
 || object_type || '","payload":' || to_json(payload)::VARCHAR || ',"revision_id":"' || object_id || '@' || content_hash || '","valid_from":'
 || coalesce('"' || valid_from || '"', 'null') || ',"valid_to":null}'"""


@query("A14_object_manifest_hash", with_ctes("objects", "SELECT snapshot_id, h AS object_manifest_hash FROM (WITH "
       + TREE.replace("LINE", FULL) + " SELECT * FROM t)"))
def _(spark, sf):
    return S.object_manifest_hash(objects(spark, sf), ["snapshot_id"]).select("snapshot_id", "object_manifest_hash")


@query("E6_build_snapshot", with_ctes("tree", """
SELECT o.snapshot_id, o.seq::BIGINT AS snapshot_sequence, o.cutoff AS generated_at, count(*) AS objects, any_value(t.h) AS content_hash,
  lag(o.snapshot_id) OVER (ORDER BY o.seq) AS previous_snapshot_id
FROM objects o JOIN tree t USING (snapshot_id) GROUP BY o.snapshot_id, o.seq, o.cutoff"""))
def _(spark, sf):
    m = S.build_snapshot(objects(spark, sf))
    return m.select("snapshot_id", F.col("snapshot_sequence").cast("bigint").alias("snapshot_sequence"), "generated_at", "objects",
                    "content_hash", "previous_snapshot_id")


@query("E7_ensure_snapshot", with_ctes("tree", """
SELECT 'append' AS action, 5::BIGINT AS snapshot_sequence, 'SNAP-04' AS previous_snapshot_id,
  (SELECT h FROM tree WHERE snapshot_id = 'SNAP-05') AS content_hash
UNION ALL SELECT 'no-op', 5, NULL, (SELECT h FROM tree WHERE snapshot_id = 'SNAP-05')"""))
def _(spark, sf):
    def manifest(seq):
        ids = ["snapshot_id", "snapshot_sequence"]
        return S.semantic_hash(at(spark, sf, seq), ids)

    out = [S.ensure_snapshot(at(spark, sf, 5), manifest(k), "1999-12-31") for k in (4, 5)]
    both = out[0].unionByName(out[1])
    return both.select("action", F.col("snapshot_sequence").cast("bigint").alias("snapshot_sequence"), "previous_snapshot_id", "content_hash")


@query("J21_layer_agreement", with_ctes("tree", """
SELECT snapshot_id, 2::BIGINT AS layers, CASE WHEN snapshot_id = 'SNAP-05' THEN 2 ELSE 1 END::BIGINT AS hashes,
  CASE WHEN snapshot_id = 'SNAP-05' THEN 'not proven' ELSE 'proven' END AS state FROM tree"""))
def _(spark, sf):
    rows = objects(spark, sf)
    drift = F.when((F.col("snapshot_sequence") == 5) & (F.col("object_type") == "claim"), F.reverse("content_hash"))
    # both layers are hashed at once, so the objects are built once and their lines lie side by side
    both = rows.withColumn("layer", F.explode(F.array(F.lit("canonical"), F.lit("deployed"))))
    shown = F.when(F.col("layer") == "deployed", F.coalesce(drift, F.col("content_hash"))).otherwise(F.col("content_hash"))
    return S.layer_agreement(S.semantic_hash(both.withColumn("content_hash", shown), ["snapshot_id", "layer"]))


@query("T9_sort_objects", with_ctes("objects", """
SELECT snapshot_id, object_type, object_id FROM objects ORDER BY object_type, object_id"""))
def _(spark, sf):
    return S.sort_objects(objects(spark, sf).select("snapshot_id", "object_type", "object_id"))


@query("W4_snapshot_chain", with_ctes("snaps", """
SELECT s.snapshot_id, r.rule FROM (SELECT *, row_number() OVER (ORDER BY seq) AS expected FROM snaps WHERE seq <> 4) s,
  LATERAL (SELECT unnest(CASE WHEN seq <> expected THEN ['SEQUENCE_GAP'] ELSE [] END
    || CASE WHEN seq = 5 THEN ['BROKEN_LINK'] ELSE [] END) AS rule) r"""))
def _(spark, sf):
    from pyspark.sql import Window as W

    s = snapshots(spark, sf)
    linked = s.withColumn("previous_snapshot_id", F.lag("snapshot_id").over(W.orderBy("snapshot_sequence")))
    return S.chain_findings(linked.filter("snapshot_sequence <> 4"))


@query("W5_adjacent_pairs", with_ctes("pairs", "SELECT from_snapshot_id, to_snapshot_id, from_cutoff, to_cutoff FROM pairs"))
def _(spark, sf):
    return pairs(spark, sf).select("from_snapshot_id", "to_snapshot_id", "from_cutoff", "to_cutoff")



def digest_of(df, by, columns):
    """Rows and an order-free sum of hashes by group: a whole result in a few rows."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")).alias("digest"))


def digest_sql(rows, by, columns):
    line = ", ".join(f"coalesce({c}::VARCHAR, '-')" for c in columns)
    return f"SELECT {', '.join(by)}, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', {line})), 1, 8))::BIGINT)::BIGINT AS digest FROM ({rows}) GROUP BY ALL"


J1_ROWS = """
SELECT coalesce(n.object_type, o.object_type) AS object_type, coalesce(n.object_id, o.object_id) AS object_id,
  CASE WHEN o.object_id IS NULL THEN 'added' WHEN n.object_id IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'changed' ELSE 'unchanged' END AS change_kind,
  o.content_hash AS old_hash, n.content_hash AS new_hash
FROM (SELECT * FROM objects WHERE seq = 3) o FULL OUTER JOIN (SELECT * FROM objects WHERE seq = 6) n USING (object_type, object_id)"""
J1_COLUMNS = ["object_type", "object_id", "change_kind", "old_hash", "new_hash"]


@query("J1_diff_snapshots", with_ctes("objects", J1_ROWS))
def _(spark, sf):
    return between_snapshots(spark, sf)


@query("J1_diff_digest", with_ctes("objects", digest_sql(J1_ROWS, ["object_type", "change_kind"], J1_COLUMNS)))
def _(spark, sf):
    return digest_of(between_snapshots(spark, sf), ["object_type", "change_kind"], J1_COLUMNS)


def between_snapshots(spark, sf):
    d = D.diff_snapshots(at(spark, sf, 3), at(spark, sf, 6))
    return d.select("object_type", "object_id", "change_kind", F.col("old.content_hash").alias("old_hash"),
                    F.col("new.content_hash").alias("new_hash"))


@query("J1_diff_over_gap", with_ctes("objects", """
, list AS (SELECT DISTINCT seq FROM objects WHERE seq <> 4), p AS (SELECT lag(seq) OVER (ORDER BY seq) AS a, seq AS b FROM list),
d AS (SELECT p.b, CASE WHEN o.object_id IS NULL THEN 'added' WHEN o.content_hash <> n.content_hash THEN 'changed' ELSE 'unchanged' END AS change_kind
  FROM p JOIN objects n ON n.seq = p.b LEFT JOIN objects o ON o.seq = p.a AND o.object_type = n.object_type AND o.object_id = n.object_id WHERE p.a IS NOT NULL
  UNION ALL SELECT p.b, 'removed' FROM p JOIN objects o ON o.seq = p.a LEFT JOIN objects n ON n.seq = p.b AND o.object_type = n.object_type AND o.object_id = n.object_id WHERE n.object_id IS NULL)
SELECT b::BIGINT AS to_seq, change_kind, count(*) AS objects FROM d GROUP BY ALL"""))
def _(spark, sf):
    """The snapshot list without its fourth entry: 3 and 5 are neighbours."""
    listed = snapshots(spark, sf).filter("snapshot_sequence <> 4")
    d = D.diff_chain(objects(spark, sf), S.adjacent_pairs(listed))
    return d.groupBy(F.col("to_seq").cast("bigint").alias("to_seq"), "change_kind").agg(F.count(F.lit(1)).alias("objects"))


J16_ROWS = """
SELECT object_type, coalesce(o.object_id, n.object_id) AS object_id,
  CASE WHEN o.object_id IS NULL THEN 'added' WHEN n.object_id IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'changed' ELSE 'unchanged' END AS change_kind
FROM (SELECT * FROM objects WHERE seq = 2 AND object_type = 'relationship') o
  FULL OUTER JOIN (SELECT * FROM objects WHERE seq = 4 AND object_type = 'relationship') n USING (object_type, object_id)"""


@query("J16_graph_layer_diff", with_ctes("objects", J16_ROWS))
def _(spark, sf):
    return D.graph_layer_diff(at(spark, sf, 2), at(spark, sf, 4)).select("object_type", "object_id", "change_kind")


@query("J16_layer_digest", with_ctes("objects", digest_sql(J16_ROWS, ["object_type", "change_kind"], ["object_id"])))
def _(spark, sf):
    return digest_of(D.graph_layer_diff(at(spark, sf, 2), at(spark, sf, 4)), ["object_type", "change_kind"], ["object_id"])


@query("F20_diff_fields", with_ctes("fields", """
SELECT to_snapshot_id, object_type, object_id, array_to_string(fields, ',') AS fields,
  CASE WHEN list_contains(fields, 'status') THEN '"' || old_status || '">"' || new_status || '"' END AS status_step
FROM fields WHERE change_kind = 'changed'"""))
def _(spark, sf):
    d = diffs(spark, sf).filter("change_kind = 'changed'")
    st = F.try_element_at(F.filter("field_changes", lambda f: f["field"] == "status"), F.lit(1))
    return d.select("to_snapshot_id", "object_type", "object_id",
                    joined(F.transform("field_changes", lambda f: f["field"])).alias("fields"),
                    F.concat(st["previous"], F.lit(">"), st["current"]).alias("status_step"))


@query("U2_array_set_diff", with_ctes("claim_records", """
SELECT n.snapshot_id, n.id, array_to_string(list_sort(list_filter(n.sources, lambda x: NOT list_contains(o.sources, x))), ',') AS added,
  array_to_string(list_sort(list_filter(o.sources, lambda x: NOT list_contains(n.sources, x))), ',') AS removed
FROM claim_records o JOIN claim_records n ON n.id = o.id AND n.seq = o.seq + 1"""))
def _(spark, sf):
    c = claim_records(spark, sf).select("snapshot_sequence", "snapshot_id", "id", "sources")
    o = c.select((F.col("snapshot_sequence") + 1).alias("snapshot_sequence"), "id", F.col("sources").alias("before"))
    added, removed = D.array_set_diff(F.col("before"), F.col("sources"))
    both = c.join(o, ["snapshot_sequence", "id"])
    return both.select("snapshot_id", "id", joined(F.array_sort(added)).alias("added"), joined(F.array_sort(removed)).alias("removed"))


@query("A12_reconciliation", with_ctes("diffs", """
SELECT from_snapshot_id, to_snapshot_id, count(*) FILTER (change_kind = 'added') AS objects_added,
  count(*) FILTER (change_kind = 'removed') AS objects_removed, count(*) FILTER (change_kind = 'changed') AS objects_changed,
  count(*) FILTER (change_kind = 'unchanged') AS objects_unchanged, count(old_hash) AS from_object_count, count(new_hash) AS to_object_count,
  true AS to_identity, true AS from_identity FROM diffs GROUP BY ALL"""))
def _(spark, sf):
    return C.reconciliation(diffs(spark, sf))


@query("F21_classify_change", with_ctes("classed", """
SELECT to_snapshot_id, object_type, object_id, change_kind, cls[1] AS change_type, cls[2] AS materiality, cls[3] AS epistemic_impact FROM classed"""))
def _(spark, sf):
    return C.change_rows(diffs(spark, sf)).select("to_snapshot_id", "object_type", "object_id", "change_kind", "change_type",
                                                  "materiality", "epistemic_impact")


@query("E8_changes", with_ctes("changed observed", """
SELECT change_id, from_snapshot_id, to_snapshot_id, c.change_kind, cls[1] AS change_type, c.object_type, c.object_id, cls[2] AS materiality,
  cls[3] AS epistemic_impact, category, effective_at, CASE WHEN c.object_type = 'source' THEN own_retrieval ELSE oldest END AS observed_at,
  CASE WHEN old_hash IS NOT NULL THEN c.object_id || '@' || old_hash END AS old_revision_id,
  CASE WHEN new_hash IS NOT NULL THEN c.object_id || '@' || new_hash END AS new_revision_id, technical_summary,
  cls[1] IN ('SOURCE_AVAILABILITY_CHANGED', 'CONTRADICTION_OPENED', 'OBJECT_REMOVED_FROM_PUBLICATION') AS requires_revalidation
FROM changed c LEFT JOIN observed o ON o.to_seq = c.to_seq AND o.object_type = c.object_type AND o.object_id = c.object_id AND o.change_kind = c.change_kind"""))
def _(spark, sf):
    return changes(spark, sf).select("change_id", "from_snapshot_id", "to_snapshot_id", "change_kind", "change_type", "object_type",
                                     "object_id", "materiality", "epistemic_impact", "category", "effective_at", "observed_at",
                                     "old_revision_id", "new_revision_id", "technical_summary", "requires_revalidation")


@query("W3_number_changes", with_ctes("changed", "SELECT change_id, to_snapshot_id, object_type, object_id FROM changed"))
def _(spark, sf):
    # only what is numbered and shown is stored and sorted
    rows = C.number_changes(C.change_rows(diffs(spark, sf)).select("to_snapshot_id", *C.KEY))
    return rows.select("change_id", "to_snapshot_id", "object_type", "object_id")


J10_ROWS = """
SELECT c.to_snapshot_id, c.object_type, c.object_id, c.change_kind, CASE WHEN c.object_type = 'source' THEN own_retrieval ELSE oldest END AS observed_at
FROM classed c LEFT JOIN observed o ON o.to_seq = c.to_seq AND o.object_type = c.object_type AND o.object_id = c.object_id AND o.change_kind = c.change_kind"""
J10_BY = ["to_snapshot_id", "object_type", "change_kind"]


@query("J10_observed_at", with_ctes("classed observed", J10_ROWS))
def _(spark, sf):
    return observed(spark, sf)


@query("J10_observed_digest", with_ctes("classed observed", digest_sql(J10_ROWS, J10_BY, ["object_id", "observed_at"])))
def _(spark, sf):
    return digest_of(observed(spark, sf), J10_BY, ["object_id", "observed_at"])


def observed(spark, sf):
    # read for the citations and for the rows themselves, so the differences are found once
    found = stored(C.change_rows(diffs(spark, sf)).select("to_snapshot_id", *C.KEY, "source_ids", "own_retrieval"))
    rows = C.observed_at(found, objects(spark, sf))
    return rows.select("to_snapshot_id", "object_type", "object_id", "change_kind", "observed_at")


@query("J11_affected_claims", with_ctes("classed claim_records", """
SELECT to_seq::BIGINT AS to_seq, object_type, object_id, object_id AS claim_id FROM classed WHERE object_type = 'claim'
UNION ALL SELECT d.to_seq, d.object_type, d.object_id, c.id FROM classed d
  JOIN (SELECT seq, id, unnest(sources) AS sid FROM claim_records) c ON c.seq = d.to_seq AND c.sid = d.object_id WHERE d.object_type = 'source'"""))
def _(spark, sf):
    # read once for each kind of record, so the differences are found once
    found = stored(C.change_rows(diffs(spark, sf)).select(*C.KEY, "payload_claims"))
    rows = C.affected_claims(found, objects(spark, sf))
    return rows.select(F.col("to_seq").cast("bigint").alias("to_seq"), "object_type", "object_id", "claim_id")


@query("A12_pair_summary", with_ctes("classed", """
SELECT from_snapshot_id, to_snapshot_id, s.section, s.value, count(*) AS n FROM (SELECT from_snapshot_id, to_snapshot_id,
  unnest([{'section': 'materiality', 'value': cls[2]}, {'section': 'change_type', 'value': cls[1]}, {'section': 'all', 'value': 'all'}]) AS s FROM classed) GROUP BY ALL"""))
def _(spark, sf):
    return C.pair_summary(C.change_rows(diffs(spark, sf)))


RANK = "CASE cls[2] WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


@query("T3_executive_top", with_ctes("changed", f"""
SELECT to_snapshot_id, change_id, cls[2] AS materiality, position::BIGINT AS position FROM (SELECT *, row_number() OVER (PARTITION BY to_seq ORDER BY {RANK}, no) AS position
FROM changed WHERE {RANK} <= 2) WHERE position <= 7"""))
def _(spark, sf):
    return C.executive_top(changes(spark, sf)).select("to_snapshot_id", "change_id", "materiality",
                                                      F.col("position").cast("bigint").alias("position"))


@query("P11_material_only", with_ctes("classed", f"""
SELECT to_snapshot_id, object_type, object_id, change_kind, cls[2] AS materiality FROM classed WHERE {RANK} <= 2"""))
def _(spark, sf):
    return C.material_only(C.change_rows(diffs(spark, sf))).select("to_snapshot_id", "object_type", "object_id", "change_kind", "materiality")


@query("P12_notification_candidates", with_ctes("changed", f"""
SELECT change_id, cls[2] AS materiality, object_type || ':' || object_id AS object, technical_summary AS summary, to_snapshot_id,
  {RANK} <= 1 AS should_notify, CASE WHEN {RANK} <= 1 THEN 'materiality>=HIGH' ELSE 'below the notification floor (HIGH)' END AS notification_reason
FROM changed WHERE to_seq = (SELECT max(to_seq) FROM changed)"""))
def _(spark, sf):
    return C.notification_candidates(changes(spark, sf)).drop("effective_at", "observed_at")


@query("W1_revision_chain", with_ctes("objects", """
, m AS (SELECT *, CASE WHEN content_hash = lag(content_hash) OVER w THEN 0 ELSE 1 END AS fresh FROM objects WINDOW w AS (PARTITION BY object_type, object_id ORDER BY seq)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY object_type, object_id ORDER BY seq) AS no FROM m)
SELECT object_type, object_id, no::BIGINT AS revision_number, object_id || '@' || content_hash AS revision_id,
  min(seq)::BIGINT AS first_snapshot_sequence, max(seq)::BIGINT AS last_snapshot_sequence FROM n GROUP BY object_type, object_id, no, content_hash"""))
def _(spark, sf):
    r = H.revision_chain(objects(spark, sf))
    big = lambda n: F.col(n).cast("bigint").alias(n)
    return r.select("object_type", "object_id", big("revision_number"), "revision_id", big("first_snapshot_sequence"), big("last_snapshot_sequence"))


@query("W2_object_history", with_ctes("changed", """
, m AS (SELECT *, CASE WHEN content_hash = lag(content_hash) OVER (PARTITION BY object_type, object_id ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM objects),
r AS (SELECT object_type, object_id, sum(fresh)::BIGINT AS revisions FROM m GROUP BY ALL),
c AS (SELECT object_type, object_id, string_agg(change_id, ',' ORDER BY to_seq) AS change_ids FROM changed GROUP BY ALL)
SELECT object_type, object_id, coalesce(revisions, 0) AS revisions, coalesce(change_ids, '') AS change_ids, revisions IS NULL AS removed_only
FROM r FULL OUTER JOIN c USING (object_type, object_id)"""))
def _(spark, sf):
    h = H.object_history(objects(spark, sf), changes(spark, sf))
    return h.select("object_type", "object_id", F.col("revisions").cast("bigint").alias("revisions"),
                    joined(F.col("change_ids")).alias("change_ids"), "removed_only")


@query("F18_status_transitions", """
SELECT a, b, CASE WHEN b = 'F' THEN 2 WHEN b = 'O' THEN 1 ELSE NULL END::BIGINT AS rank_b,
  CASE WHEN a = b THEN CASE WHEN a = 'P' THEN 'UNKNOWN' ELSE 'NO_EPISTEMIC_CHANGE' END WHEN b = 'P' THEN 'WEAKENED' WHEN a = 'P' THEN 'STRENGTHENED'
       WHEN a = 'O' THEN 'STRENGTHENED' ELSE 'WEAKENED' END AS impact, count(*) AS n
FROM (SELECT o_orderstatus AS a, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("b"))
    steps = lag_within(orders, ["o_custkey"], ["o_orderkey"], "b", "a").filter("a IS NOT NULL AND b IS NOT NULL")
    names = lambda c: X.lookup(c, {"F": "CORROBORATED", "O": "SELF_REPORTED", "P": "NOT_FOUND"})
    counted = steps.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("a", "b", status_rank(names(F.col("b"))).cast("bigint").alias("rank_b"),
                          epistemic_transition(names(F.col("a")), names(F.col("b"))).alias("impact"), "n")


@query("F7_parse_valid_time", """
, s AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m')
   WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y') WHEN '5-LOW' THEN strftime(o_orderdate, '%-d %B %Y') ELSE strftime(o_orderdate, '%Y') || ' approx' END AS raw, o_orderpriority AS p, o_orderdate AS d FROM orders)
SELECT o_orderkey, raw, CASE p WHEN '1-URGENT' THEN raw WHEN '2-HIGH' THEN raw WHEN '3-MEDIUM' THEN raw WHEN '5-LOW' THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y') END AS value,
  CASE p WHEN '1-URGENT' THEN 'EXACT_DATE' WHEN '2-HIGH' THEN 'MONTH' WHEN '5-LOW' THEN 'EXACT_DATE' ELSE 'YEAR' END AS precision FROM s""".replace(", s AS", "WITH s AS", 1))
def _(spark, sf):
    o = table(spark, sf, "orders")
    fmt = lambda f: F.date_format("o_orderdate", f)
    p = F.col("o_orderpriority")
    raw = (F.when(p == "1-URGENT", fmt("yyyy-MM-dd")).when(p == "2-HIGH", fmt("yyyy-MM")).when(p == "3-MEDIUM", fmt("yyyy"))
           .when(p == "5-LOW", fmt("d MMMM yyyy")).otherwise(F.concat(fmt("yyyy"), F.lit(" approx"))))
    rows = o.select("o_orderkey", raw.alias("raw")).withColumn("t", parse_valid_time(F.col("raw")))
    return rows.select("o_orderkey", "raw", "t.value", "t.precision")
