"""Gates over published JSON files, one row per file tree.

A tree (a case, a site, a run's output folder) is a handful of named files. Files come
as rows (tree, name, body) and are brought together per tree, so any number of trees is
checked side by side; what follows are row rules over the parsed files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import rules as K
from attestra.functions.text import parsed_json

# Names of published files, and the spellings of their counts.
MONITORING_FILES = ["manifest", "summary", "runs", "candidates", "health"]
MONITORING_LISTS = ["runs", "candidates", "health"]
COUNT_KEYS = {
    "runs": ["runs", "run_count", "runsCount"],
    "candidates": ["candidates", "candidate_count", "candidatesCount", "published", "published_count"],
    "health": ["health", "health_count", "healthCount", "health_events"],
}
CALL_COUNT_KEYS = ["provider_calls", "providerExecutionCount", "provider_call_count"]
EVIDENCE_FILES = ["manifest", "claims-evidence", "artifacts", "spans"]


def trees(files: DataFrame, names: list[str]) -> DataFrame:
    """tree and one text column per name: null where the file is missing.

    Of a file that is given twice the greatest text counts; a file without text
    is empty, which is not JSON.
    """
    body = F.coalesce("body", F.lit(""))
    return files.groupBy("tree").agg(*[F.max(F.when(F.col("name") == n, body)).alias(n) for n in names])


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _number(value: Column) -> Column:
    """The value of a JSON number; null for anything else, digits in quotes too."""
    numeric = _kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    return F.when(numeric, F.try_variant_get(value, "$", "double"))


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _field(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _found(rule: Column | str, where: Column | str = "") -> Column:
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.concat(F.col("tree").cast("string"), text(where)).alias("object_id"), text(rule).alias("rule"))


def _if(bad: Column, rule: str, where: str = "") -> Column:
    """An array with the finding, or without any."""
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_found(rule, where))).otherwise(_nothing())


def _nothing() -> Column:
    return F.array().cast("array<struct<object_id:string,rule:string>>")


def _findings(rows: DataFrame, gate: str, found: Column) -> DataFrame:
    hits = rows.select(F.explode(found).alias("f"))
    return hits.select(F.lit(gate).alias("gate"), F.lit("error").alias("level"), "f.object_id", "f.rule")


def _each(items: Column, name: str, rule: str, bad) -> Column:
    """A finding for every member of a list that is bad; numbered from 0."""
    marks = F.transform(items, lambda item, at: F.when(F.coalesce(bad(item), F.lit(False)), _found(rule, F.concat(F.lit(f"/{name}/"), at.cast("string")))))
    return F.array_compact(marks)


def provider_calls(run: Column) -> Column:
    """Provider executions of a published run: the list, a count of them, or health rows that name a provider."""
    listed = F.size(_field(run, "providerExecutions", "array<variant>"))
    counts = [_number(_field(run, name)) for name in CALL_COUNT_KEYS]
    named = F.filter(_field(run, "health", "array<variant>"), lambda h: _truthy(_field(h, "providerId")))
    first = lambda size: F.when(size >= 0, size.cast("double"))
    return F.coalesce(first(listed), *counts, first(F.size(named)), F.lit(0.0))


def _truthy(value: Column) -> Column:
    """A value that is given and is not false, zero, empty text or null."""
    text = value.isNotNull() & ~F.is_variant_null(value) & (F.try_variant_get(value, "$", "string") != "")
    return F.coalesce(text & (_kind(value) != "BOOLEAN") & F.coalesce(_number(value) != 0, F.lit(True)) | F.try_variant_get(value, "$", "boolean") & (_kind(value) == "BOOLEAN"), F.lit(False))


def monitoring_files(files: DataFrame, cap: int = K.MAX_PROVIDER_CALLS) -> DataFrame:
    """Published monitoring trees, from their files: (tree, name, body).

    Rules wait for one another: lists are looked for in trees whose files all
    parse, and only trees that hold all lists are asked for leaked candidates,
    counts, provider calls and the note. Findings as in ``gates``: object_id is
    the tree, a file below it, or a member of one.
    """
    gate = "monitoring"
    texts = trees(files, MONITORING_FILES)
    # generators keep what was parsed: the rules below read it many times
    parsed = texts.select("tree", *MONITORING_FILES, F.explode(F.array(F.struct(*[parsed_json(F.col(n)).alias(n) for n in MONITORING_FILES]))).alias("doc"))
    doc = lambda n: F.col("doc")[n]
    missing = [_if(F.col(n).isNull(), "FILE_MISSING", f"/{n}") for n in MONITORING_FILES]
    broken = [_if(F.col(n).isNotNull() & doc(n).isNull(), "FILE_UNPARSABLE", f"/{n}") for n in MONITORING_FILES]
    lists = F.struct(*[F.coalesce(_list(doc(n)), _field(doc(n), n, "array<variant>"), _field(doc(n), "items", "array<variant>")).alias(n) for n in MONITORING_LISTS])
    held = parsed.select("tree", "doc", F.concat(*missing, *broken).alias("files"), F.explode(F.array(lists)).alias("list"))
    shapes = F.concat(*[_if(F.col("list")[n].isNull(), "NOT_AN_ARRAY", f"/{n}") for n in MONITORING_LISTS])
    counts = _field(doc("manifest"), "counts")
    known, wrong = F.lit(False), []
    for name, keys in COUNT_KEYS.items():
        for key in keys:
            told = _field(counts, key)
            known = known | told.isNotNull()
            same = F.coalesce(_number(told) == F.size(F.col("list")[name]), F.lit(False))
            wrong.append(_if(told.isNotNull() & ~same, "COUNT_MISMATCH", f"/manifest/counts/{key}"))
    counted = F.coalesce(_kind(counts).startswith("OBJECT"), F.lit(False))
    note = _field(doc("manifest"), "note")
    noted = (_kind(note) == "STRING") & (F.trim(F.regexp_replace(F.try_variant_get(note, "$", "string"), r"\s+", " ")) != "")
    deep = F.concat(
        _each(F.col("list")["candidates"], "candidates", "LEAKED_CANDIDATE", lambda c: ~F.coalesce(_field(c, "status", "string").isin(K.PUBLISHABLE), F.lit(False))),
        _if(~counted, "COUNTS_MISSING", "/manifest/counts"),
        F.when(counted, F.concat(*wrong, _if(~known, "COUNTS_UNKNOWN", "/manifest/counts"))).otherwise(_nothing()),
        _each(F.col("list")["runs"], "runs", "CALL_CAP_EXCEEDED", lambda r: provider_calls(r) > cap),
        _if(~F.coalesce(noted, F.lit(False)), "NO_NOTE", "/manifest/note"))
    found = F.when(F.size("files") > 0, F.col("files")).when(F.size(shapes) > 0, shapes).otherwise(deep)
    return _findings(held, gate, found)


def evidence_files(files: DataFrame) -> DataFrame:
    """Cases whose evidence exports were not built: (tree, name, body), one finding per tree.

    An export that does not parse, or holds null, counts as not built, like one
    that is missing.
    """
    texts = trees(files, EVIDENCE_FILES)
    lost = F.lit(False)
    for name in EVIDENCE_FILES:
        lost = lost | ~_truthy(parsed_json(F.col(f"`{name}`")))
    return _findings(texts.filter(lost), "evidence", F.array(_found("EVIDENCE_MISSING")))
