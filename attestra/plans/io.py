"""Queries on readers and sinks, over records derived from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attestra.operators.extract import case_projection, extract_objects
from attestra.operators.snapshot import semantic_hash, snapshot_counts
from attestra.plans.evidence_inputs import runs
from attestra.plans.inputs import cte, objects, table, with_ctes
from attestra.plans.registry import query
from attestra.session import checkpoint_dir
from attestra.sources import readers as R
from attestra.sources import writers as W

DOCUMENT_SCHEMA = """STRUCT<claims:ARRAY<STRUCT<id:STRING,text:STRING,status:STRING,sources:ARRAY<STRING>>>, identity:ARRAY<STRUCT<field:STRING,value:STRING,status:STRING>>,
  openQuestions:ARRAY<STRING>, timeline:ARRAY<STRUCT<date:STRING,event:STRING>>, financials:STRUCT<notFound:ARRAY<STRING>>, graph:STRUCT<edges:ARRAY<STRUCT<data:STRUCT<id:STRING,source:STRING,target:STRING,lastObserved:STRING>>>>>"""


def scratch(spark, name):
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def document_text(change: str = "p_brand"):
    """JSON text of a small case document per part."""
    return f"""to_json(named_struct(
      'claims', array(named_struct('id', concat('CLM-', p_partkey), 'text', p_name, 'status', {change}, 'sources', array('s2', 's1'))),
      'identity', array(named_struct('field', concat('Náz-ev ', p_type), 'value', p_name, 'status', 'VERIFIED_PRIMARY')),
      'openQuestions', array(concat('  Why ', p_name, '? ')), 'timeline', array(named_struct('date', concat(1990 + p_size % 10, '-0', p_size % 9 + 1), 'event', p_name)),
      'financials', named_struct('notFound', array(concat('Headcount ', p_size))),
      'graph', named_struct('edges', array(named_struct('data', named_struct('id', p_partkey, 'source', 'a', 'target', p_brand, 'lastObserved', '14 Nov 2016'))))))"""


def documents(spark, sf, change: str = "p_brand"):
    raw = table(spark, sf, "part").selectExpr("concat('case-', p_partkey) AS case_id", f"{document_text(change)} AS body")
    return raw.select("case_id", F.from_json("body", DOCUMENT_SCHEMA).alias("d")).select("case_id", "d.*")


FNV = "format('{{:08x}}', list_reduce(list_transform(string_split({x}, ''), lambda c: ascii(c)::UBIGINT), lambda h, c: (xor(h, c) * 16777619::UBIGINT) % 4294967296::UBIGINT, 2166136261::UBIGINT))"
cte("case_objects", f"""
  SELECT 'case-' || p_partkey AS case_id, x.t AS object_type, x.i AS object_id, x.f AS valid_from, x.e AS valid_to, substr(sha256(x.p), 1, 16) AS content_hash FROM (SELECT p_partkey, unnest([
    {{'t': 'claim', 'i': 'CLM-' || p_partkey, 'f': NULL::VARCHAR, 'e': NULL::VARCHAR, 'p': '{{"note":null,"sources":["s1","s2"],"status":"' || p_brand || '","superseded":false,"supersededBy":[],"supersededReason":null,"text":"' || p_name || '"}}'}},
    {{'t': 'identity_field', 'i': 'ID-naz-ev-' || lower(p_type), 'f': NULL, 'e': NULL, 'p': '{{"field":"Náz-ev ' || p_type || '","note":null,"sources":[],"status":"VERIFIED_PRIMARY","value":"' || p_name || '"}}'}},
    {{'t': 'open_question', 'i': 'OQ-' || {FNV.format(x="lower('why ' || p_name || '?')")}, 'f': NULL, 'e': NULL, 'p': '{{"text":"  Why ' || p_name || '? "}}'}},
    {{'t': 'timeline_event', 'i': 'TLE-' || {FNV.format(x="(1990 + p_size % 10) || '-0' || (p_size % 9 + 1) || '|' || p_name")}, 'f': (1990 + p_size % 10) || '-0' || (p_size % 9 + 1), 'e': NULL, 'p': '{{"date":"' || (1990 + p_size % 10) || '-0' || (p_size % 9 + 1) || '","event":"' || p_name || '","sources":[],"status":null}}'}},
    {{'t': 'financial_fact', 'i': 'FIN-NOTFOUND-headcount-' || p_size, 'f': NULL, 'e': NULL, 'p': '{{"bucket":"notFound","display":null,"evidence":[],"metric":"Headcount ' || p_size || '","note":null,"sources":[],"status":"NOT_FOUND"}}'}},
    {{'t': 'relationship', 'i': 'REL-' || p_partkey, 'f': NULL, 'e': '2016-11-14', 'p': '{{"cat":null,"confidence":null,"firstObserved":null,"id":"' || p_partkey || '","label":null,"lastObserved":"14 Nov 2016","predicate":null,"source":"a","sources":[],"status":null,"target":"' || p_brand || '","why":null}}'}}]) AS x FROM part)""")


@query("S1_document_objects", with_ctes("case_objects", "SELECT case_id, object_type, object_id, valid_from, valid_to, content_hash FROM case_objects"))
def _(spark, sf):
    return extract_objects(documents(spark, sf), ["case_id"]).select("case_id", "object_type", "object_id", "valid_from", "valid_to", "content_hash")


@query("S13_case_projections", """
SELECT 'case-' || p_partkey AS case_id, 'CLM-' || p_partkey AS id, p_name AS text, p_brand AS status FROM part UNION ALL SELECT 'case-' || p_partkey, NULL, '  Why ' || p_name || '? ', NULL FROM part""")
def _(spark, sf):
    d = documents(spark, sf)
    claims = case_projection(d, "claims", ["case_id"]).select("case_id", "id", "text", "status")
    asked = case_projection(d, "openQuestions", ["case_id"]).selectExpr("case_id", "cast(null as string) AS id", "value AS text", "cast(null as string) AS status")
    return claims.unionByName(asked)


@query("S2_ledger", """
SELECT event_id, event_type AS outcome, CASE WHEN event_type = 'click' THEN NULL ELSE user_id END AS user_id FROM events WHERE event_type NOT IN ('error', 'view')""")
def _(spark, sf):
    line = """CASE event_type WHEN 'error' THEN concat('{"event_id": ', event_id, ', "outcome"') WHEN 'view' THEN '  ' WHEN 'click' THEN concat('{"event_id": ', event_id, ', "outcome": "click"}')
        ELSE concat('{"event_id": ', event_id, ', "outcome": "', event_type, '", "user_id": ', user_id, '}') END"""
    lines = table(spark, sf, "events").selectExpr(f"{line} AS value")
    return R.parse_ledger(lines, "event_id BIGINT, outcome STRING, user_id BIGINT")


@query("S7_append_if_new", with_ctes("runs", "SELECT DISTINCT sha256, url FROM runs"))
def _(spark, sf):
    """Three appends: some runs, all of them, and all of them again."""
    path = scratch(spark, "appended")
    r = runs(spark, sf).select("sha256", "url", "tag")
    for batch in (r.filter("tag = 'click'"), r, r):
        W.append_if_new(batch.select("sha256", "url"), path, ["sha256", "url"])
    return W.read_appended(spark, path)


@query("S7_new_rows", with_ctes("runs", """
SELECT DISTINCT sha256, url FROM runs WHERE (sha256, url) NOT IN (SELECT (sha256, url) FROM runs WHERE tag = 'click')"""))
def _(spark, sf):
    r = runs(spark, sf).select("sha256", "url", "tag")
    return W.new_rows(r.select("sha256", "url"), r.filter("tag = 'click'"), ["sha256", "url"])


@query("S8_content_digest", """
WITH l AS (SELECT '1x{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' AS line FROM customer), p AS (SELECT substr(sha256(line), 1, 6) AS p, line FROM l),
a AS (SELECT p, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM p GROUP BY p), b AS (SELECT substr(p, 1, 3) AS q, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p || ':' || h)) AS h FROM a GROUP BY 1)
SELECT sha256(string_agg(q || ':' || h, chr(10) ORDER BY q || ':' || h)) AS content_hash FROM b""")
def _(spark, sf):
    return W.content_digest(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("S9_persist_snapshot", with_ctes("objects", """
SELECT snapshot_id, 'written' AS first_try, 'kept' AS second_try, count(*) AS objects FROM objects GROUP BY snapshot_id"""))
def _(spark, sf):
    path = scratch(spark, "snapshots")
    rows = []
    every = scratch(spark, "objects")
    objects(spark, sf).write.partitionBy("snapshot_sequence").parquet(every)
    stored = spark.read.parquet(every)
    for (seq,) in sorted(stored.select("snapshot_sequence").distinct().collect()):  # one row per snapshot
        o = stored.filter(F.col("snapshot_sequence") == seq)
        m = semantic_hash(o, ["snapshot_id"]).join(snapshot_counts(o, ["snapshot_id"]), "snapshot_id")
        rows.append((f"SNAP-{seq:02d}", W.persist_snapshot(o, m, path), W.persist_snapshot(o, m, path)))
    told = spark.createDataFrame(rows, "snapshot_id string, first_try string, second_try string")
    stored = spark.read.parquet(f"{path}/objects").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("objects"))
    return told.join(stored, "snapshot_id")


@query("S10_export_header", """
SELECT '1.0.0' AS schema_version, 'customers' AS kind, '2024-02-01' AS generated_at, sum(n)::BIGINT AS count, string_agg(k || '=' || n, ',' ORDER BY k) AS tally FROM (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1)""")
def _(spark, sf):
    h = W.export_header(table(spark, sf, "customer"), "customers", "2024-02-01", "c_mktsegment")
    pairs = F.transform(F.array_sort(F.map_entries("tally")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return h.select("schema_version", "kind", "generated_at", "count", F.array_join(pairs, ",").alias("tally"))


@query("S10_export_tally", """
SELECT schema_version, kind, count, value, n FROM (SELECT '1.0.0' AS schema_version, 'orders' AS kind, count(*) AS count FROM orders) CROSS JOIN (SELECT o_custkey::VARCHAR AS value, count(*) AS n FROM orders GROUP BY 1)""")
def _(spark, sf):
    path = scratch(spark, "tally")
    W.export_with_header(table(spark, sf, "orders"), path, "orders", "2024-02-01", "o_custkey", tally_rows=True)
    header = spark.read.schema("schema_version string, kind string, count bigint").json(f"{path}/header")
    told = spark.read.schema("value string, n bigint").json(f"{path}/tally")
    return told.withColumn("kind", F.lit("orders")).join(header, "kind").select("schema_version", "kind", "count", "value", "n")


@query("S11_export_shards", """
SELECT c_custkey::VARCHAR AS key, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS json FROM customer""")
def _(spark, sf):
    return W.shards(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")


@query("S12_upsert_journal", """
WITH j AS (SELECT 'run-' || o_custkey || '-' || year(o_orderdate) AS run_id, strftime(max(o_orderdate), '%Y-%m-%d') AS started_at, 'OLD' AS state FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey, year(o_orderdate)),
n AS (SELECT 'run-' || o_custkey || '-' || year(o_orderdate) AS run_id, strftime(max(o_orderdate), '%Y-%m-%d') AS started_at, 'NEW' AS state FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, year(o_orderdate))
SELECT coalesce(n.run_id, j.run_id) AS run_id, coalesce(n.started_at, j.started_at) AS started_at, coalesce(n.state, j.state) AS state FROM j FULL OUTER JOIN n USING (run_id) ORDER BY started_at, run_id""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    g = lambda df, state: df.groupBy(F.concat(F.lit("run-"), "o_custkey", F.lit("-"), F.year("o_orderdate")).alias("run_id")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("started_at"), F.lit(state).alias("state"))
    return W.upsert_journal(g(o.filter("o_orderstatus = 'F'"), "NEW"), g(o.filter("o_orderstatus <> 'F'"), "OLD"))


@query("S14_replay_versions", """
SELECT 'SNAP-01' AS snapshot_id, 1::BIGINT AS version, 6 * count(*) AS objects, '2001-12-31' AS evidence_cutoff FROM part UNION ALL SELECT 'SNAP-02', 3, 6 * count(*), '2003-12-31' FROM part""")
def _(spark, sf):
    # document 1 again as version 2, then a version with other claim states
    v = lambda n, change: documents(spark, sf, change).withColumn("version", F.lit(n).cast("bigint"))
    versions = v(1, "p_brand").unionByName(v(2, "p_brand")).unionByName(v(3, "p_type"))
    cutoffs = versions.select("version").distinct().withColumn("evidence_cutoff", F.concat((F.col("version") + 2000).cast("string"), F.lit("-12-31")))
    r = W.replay(versions, cutoffs)
    return r.groupBy("snapshot_id", "version", "evidence_cutoff").agg(F.count(F.lit(1)).alias("objects"))
