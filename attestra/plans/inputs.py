"""Ledger tables derived from the test tables, in Spark and in SQL.

Every shape covers its whole table. ``CTES`` holds the same shapes as SQL for
the oracle; ``with_ctes`` puts the needed ones in front of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.operators.extract import RecordSpec, project_objects, union_all
from attestra.operators.numbering import ordinal_id

FIRST_YEAR = 1995
SNAPSHOTS = 10
RETENTION_YEARS = 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --------------------------------------------------------------- objects


def _by_snapshot(df: DataFrame, date_col: str) -> DataFrame:
    """A record is published in the year it appears and the three after."""
    start = F.year(date_col) - FIRST_YEAR + 1
    seqs = F.sequence(start, start + RETENTION_YEARS - 1)
    rows = df.withColumn("snapshot_sequence", F.explode(seqs))
    return _snapshot_columns(rows)


def _snapshot_columns(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("snapshot_id", ordinal_id("SNAP-", F.col("snapshot_sequence"), 2))
    return rows.withColumn(
        "evidence_cutoff", F.concat((F.col("snapshot_sequence") + FIRST_YEAR - 1).cast("string"), F.lit("-12-31"))
    )


SNAP_KEYS = ["snapshot_sequence", "snapshot_id", "evidence_cutoff"]


def _iso(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def claim_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as claims whose status, text and sources develop over time."""
    o = _by_snapshot(table(spark, sf, "orders"), "o_orderdate")
    days = F.datediff(F.to_date("evidence_cutoff"), F.to_date("o_orderdate"))
    own = F.concat(F.lit("SRC-"), F.col("o_custkey"))
    other = F.concat(F.lit("SRC-"), F.col("o_custkey") + 1)
    final = (
        F.when(F.col("o_orderstatus") == "F", "VERIFIED_PRIMARY")
        .when(F.col("o_orderstatus") == "O", "CORROBORATED")
        .when(days > 800, "CONTRADICTED")
        .otherwise("ASSESSED")
    )
    wording = F.when((F.col("o_orderpriority") == "5-LOW") & (days > 500), "low priority").otherwise(F.col("o_orderpriority"))
    gone = (F.col("o_orderstatus") == "F") & (days > 1000)
    return o.select(
        *SNAP_KEYS,
        F.concat(F.lit("CLM-"), F.col("o_orderkey")).alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" "), wording).alias("text"),
        F.when(days < 180, "SELF_REPORTED").otherwise(final).alias("status"),
        F.when(days >= 365, F.array_sort(F.array(own, other))).otherwise(F.array(own)).alias("sources"),
        gone.alias("superseded"),
        F.when(gone, F.array(F.concat(F.lit("CLM-"), F.col("o_orderkey") + 1)))
        .otherwise(F.array().cast("array<string>"))
        .alias("supersededBy"),
        F.when(gone, "replaced by a later order").alias("supersededReason"),
        _iso("o_orderdate").alias("date"),
    )


def source_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as sources, present in every snapshot."""
    c = table(spark, sf, "customer").withColumn("snapshot_sequence", F.explode(F.sequence(F.lit(1), F.lit(SNAPSHOTS))))
    kinds = {
        "BUILDING": "official register",
        "AUTOMOBILE": "company website",
        "MACHINERY": "primary registry document",
        "HOUSEHOLD": "media",
        "FURNITURE": "aggregator profile",
    }
    blocked = (F.col("c_acctbal") < 500) & (F.col("snapshot_sequence") >= 5)
    retrieved = F.date_format(F.date_add(F.lit("1995-06-01").cast("date"), (F.col("c_custkey") * 13 % 2400).cast("int")), "yyyy-MM-dd")
    return _snapshot_columns(c).select(
        *SNAP_KEYS,
        F.concat(F.lit("SRC-"), F.col("c_custkey")).alias("id"),
        F.col("c_name").alias("title"),
        F.concat(F.lit("https://s.example/"), F.col("c_custkey")).alias("url"),
        (F.col("c_nationkey") % 3 + 1).alias("tier"),
        X.lookup(F.col("c_mktsegment"), kinds).alias("kind"),
        retrieved.alias("retrievedAt"),
        F.when(blocked, "BLOCKED").otherwise("AVAILABLE").alias("availability"),
    )


def relationship_records(spark: SparkSession, sf: str) -> DataFrame:
    """Order-supplier pairs as relationships."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("line"), F.min("l_shipdate").alias("since")
    )
    r = _by_snapshot(li, "since")
    days = F.datediff(F.to_date("evidence_cutoff"), F.to_date("since"))
    return r.select(
        *SNAP_KEYS,
        F.concat(F.lit("REL-"), F.col("l_orderkey"), F.lit("-"), F.col("l_suppkey")).alias("id"),
        F.concat(F.lit("ORD-"), F.col("l_orderkey")).alias("source"),
        F.concat(F.lit("SUP-"), F.col("l_suppkey")).alias("target"),
        F.when(F.col("flag") == "R", "historical delivery").otherwise("delivery").alias("label"),
        F.when(F.col("line") == "F", "VERIFIED_PRIMARY").when(days < 365, "SELF_REPORTED").otherwise("CORROBORATED").alias("status"),
        X.lookup(F.col("flag"), {"R": "OWNS", "A": "SHAREHOLDER_OF", "N": "SUPPLIES"}).alias("predicate"),
        F.array(F.concat(F.lit("SRC-"), F.col("l_suppkey"))).alias("sources"),
        _iso("since").alias("date"),
    )


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Object revisions of ten yearly snapshots from three record types."""
    c = F.col
    null = F.lit(None).cast("string")
    claim = RecordSpec(
        "claim",
        c("id"),
        {n: c(n) for n in ["text", "status", "sources", "superseded", "supersededBy", "supersededReason"]} | {"note": null},
        valid_from=c("date"),
        valid_time_source="orders.o_orderdate",
        keep=SNAP_KEYS,
    )
    source = RecordSpec(
        "source",
        c("id"),
        {n: c(n) for n in ["title", "url", "tier", "kind", "retrievedAt", "availability"]} | {"note": null},
        keep=SNAP_KEYS,
    )
    rel = RecordSpec(
        "relationship",
        c("id"),
        {n: c(n) for n in ["source", "target", "label", "status", "predicate", "sources"]},
        valid_from=c("date"),
        valid_time_source="lineitem.l_shipdate",
        keep=SNAP_KEYS,
    )
    return union_all(
        [
            project_objects(claim_records(spark, sf), claim),
            project_objects(source_records(spark, sf), source),
            project_objects(relationship_records(spark, sf), rel),
        ]
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """One row per snapshot that holds any object."""
    return objects(spark, sf).select(*SNAP_KEYS).distinct()


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, sql: str, needs: list[str] | None = None) -> None:
    CTES[name] = (needs or [], sql)


def with_ctes(names: str, body: str) -> str:
    """``WITH`` clause of the named shapes and what they need, then the body."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in done:
            done.append(name)

    for name in names.split():
        add(name)
    shapes = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
    # a body that starts with a comma adds shapes of its own
    return f"WITH {shapes}\n{body.strip()}"


cte(
    "claim_records",
    """
  SELECT y - 1994 + a.a AS seq, 'SNAP-' || lpad((y - 1994 + a.a)::VARCHAR, greatest(2, length((y - 1994 + a.a)::VARCHAR))::INT, '0') AS snapshot_id,
         (y + a.a)::VARCHAR || '-12-31' AS cutoff, 'CLM-' || o_orderkey AS id,
         'Order ' || o_orderkey || ' ' || CASE WHEN o_orderpriority = '5-LOW' AND d > 500 THEN 'low priority' ELSE o_orderpriority END AS text,
         CASE WHEN d < 180 THEN 'SELF_REPORTED' WHEN o_orderstatus = 'F' THEN 'VERIFIED_PRIMARY'
              WHEN o_orderstatus = 'O' THEN 'CORROBORATED' WHEN d > 800 THEN 'CONTRADICTED' ELSE 'ASSESSED' END AS status,
         CASE WHEN d >= 365 THEN list_sort(['SRC-' || o_custkey, 'SRC-' || (o_custkey + 1)]) ELSE ['SRC-' || o_custkey] END AS sources,
         (o_orderstatus = 'F' AND d > 1000) AS superseded, 'CLM-' || (o_orderkey + 1) AS successor,
         strftime(o_orderdate, '%Y-%m-%d') AS date
  FROM (SELECT *, year(o_orderdate) AS y FROM orders) o CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS a) a,
       LATERAL (SELECT date_diff('day', o_orderdate::DATE, make_date(y + a.a, 12, 31)) AS d) dd
""",
)
cte(
    "source_records",
    """
  SELECT s.s AS seq, 'SNAP-' || lpad(s.s::VARCHAR, greatest(2, length(s.s::VARCHAR))::INT, '0') AS snapshot_id, (1994 + s.s)::VARCHAR || '-12-31' AS cutoff,
         'SRC-' || c_custkey AS id, c_name AS title, 'https://s.example/' || c_custkey AS url, c_nationkey % 3 + 1 AS tier,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'official register' WHEN 'AUTOMOBILE' THEN 'company website'
              WHEN 'MACHINERY' THEN 'primary registry document' WHEN 'HOUSEHOLD' THEN 'media' WHEN 'FURNITURE' THEN 'aggregator profile' END AS kind,
         strftime(DATE '1995-06-01' + (c_custkey * 13 % 2400)::INTEGER, '%Y-%m-%d') AS retrieved,
         CASE WHEN c_acctbal < 500 AND s.s >= 5 THEN 'BLOCKED' ELSE 'AVAILABLE' END AS availability
  FROM customer CROSS JOIN (SELECT unnest(range(1, 11)) AS s) s
""",
)
cte(
    "relationship_records",
    """
  SELECT y - 1994 + a.a AS seq, 'SNAP-' || lpad((y - 1994 + a.a)::VARCHAR, greatest(2, length((y - 1994 + a.a)::VARCHAR))::INT, '0') AS snapshot_id,
         (y + a.a)::VARCHAR || '-12-31' AS cutoff, 'REL-' || l_orderkey || '-' || l_suppkey AS id,
         'ORD-' || l_orderkey AS source, 'SUP-' || l_suppkey AS target,
         CASE WHEN flag = 'R' THEN 'historical delivery' ELSE 'delivery' END AS label,
         CASE WHEN line = 'F' THEN 'VERIFIED_PRIMARY' WHEN d < 365 THEN 'SELF_REPORTED' ELSE 'CORROBORATED' END AS status,
         CASE flag WHEN 'R' THEN 'OWNS' WHEN 'A' THEN 'SHAREHOLDER_OF' WHEN 'N' THEN 'SUPPLIES' END AS predicate,
         ['SRC-' || l_suppkey] AS sources, strftime(since, '%Y-%m-%d') AS date
  FROM (SELECT l_orderkey, l_suppkey, max(l_returnflag) AS flag, min(l_linestatus) AS line, min(l_shipdate) AS since,
               year(min(l_shipdate)) AS y FROM lineitem GROUP BY l_orderkey, l_suppkey) r
       CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS a) a,
       LATERAL (SELECT date_diff('day', since::DATE, make_date(y + a.a, 12, 31)) AS d) dd
""",
)
cte(
    "revisions",
    """
  SELECT seq, snapshot_id, cutoff, 'claim' AS object_type, id AS object_id, status, sources, date AS valid_from,
         NULL::VARCHAR AS predicate, NULL::VARCHAR AS label, NULL::VARCHAR AS kind, NULL::INTEGER AS tier, NULL::VARCHAR AS retrieved,
         NULL::VARCHAR AS availability, superseded, text,
         '{"note":null,"sources":["' || array_to_string(sources, '","') || '"],"status":"' || status || '","superseded":' || superseded::VARCHAR
         || ',"supersededBy":' || CASE WHEN superseded THEN '["' || successor || '"]' ELSE '[]' END || ',"supersededReason":'
         || CASE WHEN superseded THEN '"replaced by a later order"' ELSE 'null' END || ',"text":"' || text || '"}' AS payload
  FROM claim_records
  UNION ALL
  SELECT seq, snapshot_id, cutoff, 'source', id, NULL, NULL, NULL, NULL, NULL, kind, tier, retrieved, availability, NULL, NULL,
         '{"availability":"' || availability || '","kind":"' || kind || '","note":null,"retrievedAt":"' || retrieved || '","tier":' || tier
         || ',"title":"' || title || '","url":"' || url || '"}'
  FROM source_records
  UNION ALL
  SELECT seq, snapshot_id, cutoff, 'relationship', id, status, sources, date, predicate, label, NULL, NULL, NULL, NULL, NULL, NULL,
         '{"label":"' || label || '","predicate":"' || predicate || '","source":"' || source || '","sources":["' || array_to_string(sources, '","')
         || '"],"status":"' || status || '","target":"' || target || '"}'
  FROM relationship_records
""",
    ["claim_records", "source_records", "relationship_records"],
)
cte("objects", "SELECT *, substr(sha256(payload), 1, 16) AS content_hash FROM revisions", ["revisions"])
