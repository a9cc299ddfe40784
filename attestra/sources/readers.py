"""Readers of documents, ledgers, artifacts, pages and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One row per nested JSON document (a file each, or an array of them)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def _ledger_schema(schema: str) -> str:
    return f"{schema}, _corrupt STRING"


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only NDJSON log; blank and corrupt lines are dropped, not fatal."""
    rows = spark.read.schema(_ledger_schema(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return parsed_lines(rows)


def parsed_lines(rows: DataFrame) -> DataFrame:
    """Lines that parsed as a record."""
    return rows.filter("_corrupt IS NULL").drop("_corrupt")


def parse_ledger(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The same for ledger lines that already are a text column."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    filled = lines.filter(F.trim(column) != "")
    return parsed_lines(filled.select(F.from_json(column, _ledger_schema(schema), options).alias("r")).select("r.*"))


def stream_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger as a stream of newly arrived files."""
    rows = spark.readStream.schema(_ledger_schema(schema)).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return parsed_lines(rows)


def read_artifacts(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows with the bytes of their file; null where it is missing.

    Files are matched by their path below ``path``.
    """
    root = path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    relative = F.element_at(F.split("path", root, 2), -1)
    return manifest.join(files.select(relative.alias("storage_path"), "content"), "storage_path", "left")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): documents as numbered lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("_p", "text")).select("file", (F.col("_p") + 1).alias("line"), "text")


def read_pages(spark: SparkSession, path: str, site: str) -> DataFrame:
    """(site, path, html) of a folder of rendered pages."""
    root = path.rstrip("/") + "/"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path, wholetext=True)
    relative = F.element_at(F.split(F.col("_metadata.file_path"), root, 2), -1)
    return files.select(F.lit(site).alias("site"), relative.alias("path"), F.col("value").alias("html"))


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(tree, name, body) of published JSON files ``path/tree/name.json``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    rows = files.select(F.split("_metadata.file_path", "/").alias("p"), F.col("value").alias("body"))
    return rows.select(F.element_at("p", -2).alias("tree"), F.regexp_replace(F.element_at("p", -1), "\\.json$", "").alias("name"), "body")


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """id of every page that a site build left as ``path/id/index.html``; only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "index.html").load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("id"))


OBSERVATION_SCHEMA = "provider STRING, target STRING, status STRING, fields MAP<STRING,STRING>"


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Provider records as files named ``provider.target.json``.

    The name says who reported about whom, so a file that does not parse still
    counts as a failed provider and not as a missing one.
    """
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), "\\.json$", "")
    rows = files.select(F.split(name, "\\.", 2).alias("n"), F.from_json("value", OBSERVATION_SCHEMA + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.select(F.col("n")[0].alias("provider"), F.col("n")[1].alias("target"), "r.status", "r.fields", F.col("r._corrupt").isNotNull().alias("corrupt"))


def load_versions(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Historical document versions under ``path/version=N``, one row each."""
    reader = spark.read.option("multiLine", True).option("basePath", path)
    return (reader.schema(schema) if schema is not None else reader).json(path)
