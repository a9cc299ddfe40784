"""Nested documents and tables to flat, content-hashed object revisions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions import text as X
from attestra.functions.time import parse_valid_time

OBJECT_COLUMNS = [
    "object_type",
    "object_id",
    "revision_id",
    "content_hash",
    "valid_from",
    "valid_to",
    "valid_time_precision",
    "valid_time_source",
    "payload",
]


@dataclass
class RecordSpec:
    """How one record type becomes an object revision."""

    object_type: str
    object_id: Column
    payload: dict[str, Column]
    valid_from: Column | None = None
    valid_to: Column | None = None
    valid_time_source: str | None = None
    nested: bool = False
    keep: list[str] = field(default_factory=list)


def project_objects(df: DataFrame, spec: RecordSpec) -> DataFrame:
    """One row per record: id, canonical payload, hash and valid time."""
    payload = X.canonical_struct(spec.payload)
    if spec.nested:
        payload = X.canonical_json(payload)
    null = F.lit(None).cast("string")
    start = parse_valid_time(spec.valid_from if spec.valid_from is not None else null)
    end = parse_valid_time(spec.valid_to if spec.valid_to is not None else null)
    rows = df.select(
        *spec.keep,
        F.lit(spec.object_type).alias("object_type"),
        spec.object_id.alias("object_id"),
        payload.alias("payload"),
        start.alias("_start"),
        end["value"].alias("valid_to"),
        F.lit(spec.valid_time_source).cast("string").alias("valid_time_source"),
    )
    rows = rows.withColumn("content_hash", X.content_hash(F.col("payload")))
    rows = rows.withColumn("revision_id", X.revision_id(F.col("object_id"), F.col("content_hash")))
    rows = rows.withColumn("valid_from", F.col("_start.value"))
    rows = rows.withColumn("valid_time_precision", F.col("_start.precision"))
    return rows.select(*spec.keep, *OBJECT_COLUMNS)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _dtype(schema: T.DataType, path: str) -> T.DataType | None:
    for name in path.split("."):
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return None
        schema = schema[name].dataType
    return schema


def _value(item: T.DataType, name: str) -> Column:
    """A field of the exploded record, or null where this shape lacks it."""
    if _dtype(item, name) is None:
        return F.lit(None).cast("string")
    return F.col("r." + name)


def _set(item: T.DataType, name: str) -> Column:
    if _dtype(item, name) is None:
        return F.array().cast("array<string>")
    return X.set_of(F.col("r." + name))


def _list(item: T.DataType, name: str) -> Column:
    if _dtype(item, name) is None:
        return F.array().cast("array<string>")
    return F.coalesce(F.col("r." + name), F.from_json(F.lit("[]"), _dtype(item, name)))


# Record types of a case document as (type, array, scalar fields,
# set fields, list fields, valid-from field, valid-to field, valid-time source).
DOCUMENT_TYPES = [
    ("claim", "claims", ["text", "status", "note", "supersededReason"], ["sources", "supersededBy"], [], None, None, None),
    ("source", "sources", ["title", "url", "tier", "kind", "retrievedAt", "availability", "note"], [], [], None, None, None),
    ("identity_field", "identity", ["field", "value", "status", "note"], ["sources"], [], None, None, None),
    ("contradiction", "contradictions", ["field", "valueA", "valueB", "resolution", "status"], [], [], None, None, None),
    ("open_question", "openQuestions", ["text"], [], [], None, None, None),
    ("resolved_question", "resolvedQuestions", ["question", "resolvedAt", "resolution"], ["resolvedBy"], [], None, None, None),
    ("timeline_event", "timeline", ["date", "event", "status"], ["sources"], [], "date", None, "timeline.date"),
    ("transaction", "transactions", None, [], [], "effectiveInRegister", None, "transactions.effectiveInRegister"),
    ("statutory_role", "governance.statutoryBody", ["name", "role", "since", "until", "status", "note"], ["sources"], [],
     "since", "until", "governance.statutoryBody.since/until"),
    ("shareholding", "governance.shareholders", ["name", "vklad", "since", "status", "note"], ["sources"], [],
     "since", None, "governance.shareholders.since"),
    ("marketing_role", "governance.marketingLeadership", None, [], [], None, None, None),
    ("entity", "graph.nodes", ["id", "label", "group", "type", "ident", "summary"], ["cats", "claims", "sources"], [],
     "validFrom", None, "graph.node.validFrom"),
    ("relationship", "graph.edges",
     ["id", "source", "target", "label", "status", "cat", "predicate", "why", "confidence", "firstObserved", "lastObserved"],
     ["sources"], [], "firstObserved", "lastObserved", "graph.edge.firstObserved"),
    ("reasoning_assumption", "reasoning.assumptions", ["text", "basis"], [], [], None, None, None),
    ("reasoning_inference", "reasoning.inferences", ["kind", "produces", "primaryExplanation", "counterfactuals"],
     ["assumptions"], ["premises", "steps", "alternatives", "uncertainty"], None, None, None),
    ("reasoning_inference", "reasoning.conclusions", ["kind", "produces", "primaryExplanation", "counterfactuals"],
     ["assumptions"], ["premises", "steps", "alternatives", "uncertainty"], None, None, None),
    ("executive_finding", "reasoning.executiveFindings", ["text", "narrativeSection", "reasoning"], [],
     ["supports", "uncertainty"], None, None, None),
    ("conflict_resolution", "reasoning.conflicts",
     ["conflict", "sideA", "sideB", "resolution", "resolutionState", "distinguishingEvidence", "remainingUncertainty"],
     [], [], None, None, None),
]
FINANCE_BUCKETS = ["verified", "assessed", "selfReported", "notFound"]


def _object_id(object_type: str, item: T.DataType) -> Column:
    """Stable id per type; text-keyed records get an id from their content."""
    v = lambda n: _value(item, n)
    empty = lambda n: F.coalesce(v(n).cast("string"), F.lit(""))
    whole = X.canonical_json(F.to_json(F.col("r"))) if isinstance(item, T.StructType) else F.col("r")
    own = {
        "identity_field": F.concat(F.lit("ID-"), X.slugify(empty("field"))),
        "contradiction": F.coalesce(v("id"), F.concat(F.lit("CON-"), X.fnv1a32(whole))),
        "open_question": F.concat(F.lit("OQ-"), X.fnv1a32(F.lower(X.collapse(empty("text"))))),
        "resolved_question": F.coalesce(v("id"), F.concat(F.lit("RQ-"), X.fnv1a32(whole))),
        "timeline_event": F.concat(F.lit("TLE-"), X.fnv1a32(F.concat(empty("date"), F.lit("|"), empty("event")))),
        "transaction": F.concat(
            F.lit("TXN-"), X.slugify(F.regexp_replace(F.coalesce(v("id"), v("label"), F.lit("")), "^transaction:", ""))
        ),
        "statutory_role": F.concat(F.lit("ROLE-"), X.slugify(empty("name")), F.lit("-"), X.fnv1a32(empty("role"))),
        "shareholding": F.concat(F.lit("SHARE-"), X.slugify(empty("name"))),
        "marketing_role": F.concat(F.lit("MKT-"), X.slugify(F.coalesce(v("name"), whole))),
        "entity": F.concat(F.lit("ENT-"), v("id")),
        "relationship": F.concat(F.lit("REL-"), v("id")),
    }
    return own.get(object_type, v("id"))


def explode_records(docs: DataFrame, path: str, keep: list[str]) -> tuple[DataFrame, T.DataType] | None:
    """Rows of one record array as column ``r``; None when the shape lacks it."""
    dtype = _dtype(docs.schema, path)
    if not isinstance(dtype, T.ArrayType):
        return None
    item = dtype.elementType
    rows = docs.select(*keep, F.explode(F.col(path)).alias("r"))
    if isinstance(item, T.StructType) and item.names == ["data"]:
        rows, item = rows.select(*keep, F.col("r.data").alias("r")), item["data"].dataType
    return rows, item


def _promote(rows: DataFrame, item: T.DataType, name: str, keep: list[str]) -> tuple[DataFrame, T.DataType]:
    """Older shapes carry bare strings where newer ones carry structs."""
    if isinstance(item, T.StringType):
        return rows.select(*keep, F.struct(F.col("r").alias(name)).alias("r")), T.StructType().add(name, "string")
    return rows, item


def extract_objects(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every record of every case document, of any historical shape."""
    keep = keep or []
    frames = []
    meta = _dtype(docs.schema, "meta")
    if meta is not None:
        rows = docs.select(*keep, F.col("meta").alias("r")).filter("r IS NOT NULL")
        fields = {n: _value(meta, n) for n in ["subject", "ico", "evidenceCutoff", "scope"]}
        frames.append(project_objects(rows, RecordSpec("case_meta", F.lit("META"), fields, keep=keep)))
    for kind, path, scalars, sets, lists, start, end, label in DOCUMENT_TYPES:
        found = explode_records(docs, path, keep)
        if found is None:
            continue
        rows, item = _promote(*found, "text", keep)
        if scalars is None:  # the record itself is the payload
            payload = {n: F.col("r." + n) for n in item.names}
        else:
            payload = {n: _value(item, n) for n in scalars}
        payload.update({n: _set(item, n) for n in sets})
        payload.update({n: _list(item, n) for n in lists})
        if kind == "claim":
            payload["superseded"] = F.coalesce(_value(item, "superseded").cast("boolean"), F.lit(False))
        for name in [n for n in ("premises", "supports") if n in payload]:
            payload[name] = F.array_sort(payload[name])
        begin = _value(item, start) if start else None
        if kind == "transaction" and isinstance(_dtype(item, start), T.StructType):
            first = _dtype(item, start).names[0]
            begin = F.col(f"r.{start}.{first}")
        frames.append(
            project_objects(
                rows,
                RecordSpec(kind, _object_id(kind, item), payload, begin, _value(item, end) if end else None, label, True, keep),
            )
        )
    if _dtype(docs.schema, "governance.signingRule") is not None:
        rows = docs.select(*keep, F.col("governance.signingRule").alias("r")).filter("r IS NOT NULL")
        frames.append(
            project_objects(rows, RecordSpec("governance_rule", F.lit("GOV-SIGNING"), {"rule": F.col("r")}, nested=True, keep=keep))
        )
    for bucket in FINANCE_BUCKETS:
        found = explode_records(docs, "financials." + bucket, keep)
        if found is None:
            continue
        bare = isinstance(found[1], T.StringType)
        rows, item = _promote(*found, "metric", keep)
        payload = {n: _value(item, n) for n in ["metric", "display", "status", "note"]}
        payload.update({n: _set(item, n) for n in ["sources", "evidence"]})
        payload["bucket"] = F.lit(bucket)
        if bare and bucket == "notFound":
            payload["status"] = F.lit("NOT_FOUND")
        oid = F.concat(F.lit(f"FIN-{bucket.upper()}-"), X.slugify(F.coalesce(_value(item, "metric"), F.lit(""))))
        frames.append(project_objects(rows, RecordSpec("financial_fact", oid, payload, nested=True, keep=keep)))
    return union_all(frames)


def live(df: DataFrame, column: str = "superseded") -> DataFrame:
    return df.filter(~F.coalesce(F.col(column), F.lit(False)))


def superseded(df: DataFrame, column: str = "superseded") -> DataFrame:
    return df.filter(F.coalesce(F.col(column), F.lit(False)))


def case_projection(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """One record array of each case as a table of its own."""
    found = explode_records(docs, path, keep)
    if found is None:
        raise ValueError(f"documents have no record array {path}")
    rows, item = found
    if isinstance(item, T.StructType):
        return rows.select(*keep, "r.*")
    return rows.select(*keep, F.col("r").alias("value"))


def flatten_records(kinds: list[tuple[str, DataFrame]]) -> DataFrame:
    """Heterogeneous sourced records in one shape: kind, id, status, sources, cat."""
    frames = []
    for kind, df in kinds:
        cat = F.col("cat") if "cat" in df.columns else F.lit(None).cast("string")
        frames.append(df.select(F.lit(kind).alias("kind"), "id", "status", "sources", cat.alias("cat")))
    return union_all(frames)
