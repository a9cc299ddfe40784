"""Address parsing and exact-key resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import fold_key

COMPONENTS = ["street", "house_number", "orientation_number", "municipality_part", "postcode", "city"]


def parse_address(raw: Column) -> Column:
    """Struct of components and how completely the text resolved."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    middle = F.when(n >= 3, F.try_element_at(parts, F.lit(-2)))
    blank = lambda c: F.nullif(c, F.lit(""))
    code = "(\\d{3}\\s?\\d{2})\\s+(.+)$"
    has_code = last.rlike(code)
    postcode = F.when(has_code, F.regexp_replace(F.regexp_extract(last, code, 1), "\\s+", " "))
    city = F.when(has_code, F.trim(F.regexp_extract(last, code, 2))).otherwise(last)
    number = "(?i)^(.+?)\\s+(\\d+[a-z]?)(?:/(\\d+[a-z]?))?$"
    has_number = first.rlike(number)
    street = F.when(has_number, F.trim(F.regexp_extract(first, number, 1))).otherwise(first)
    house = F.when(has_number, F.regexp_extract(first, number, 2))
    orientation = F.when(has_number, blank(F.regexp_extract(first, number, 3)))
    part = F.when(fold_key(middle) != fold_key(city), middle)
    resolution = F.when(n == 0, "unresolved").when(street.isNotNull() & house.isNotNull(), "exact").otherwise("partial")
    return F.struct(street.alias("street"), house.alias("house_number"), orientation.alias("orientation_number"), part.alias("municipality_part"),
                    postcode.alias("postcode"), city.alias("city"), resolution.alias("resolution"))


def has_address_shape(raw: Column) -> Column:
    return raw.rlike("\\d") & raw.rlike("[A-Za-zÁ-ž].*\\s+\\d") & raw.contains(",")


def address_key(a: Column, raw: Column) -> Column:
    parts = F.array(fold_key(a["street"]), a["house_number"], a["orientation_number"], fold_key(a["city"]))
    key = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "|")
    return F.when(key == "", fold_key(raw)).otherwise(key)


def address_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with parsed components and canonical key.

    ``candidates``: raw, subject, role, status, sources, discovered_from.
    """
    rows = candidates.filter(has_address_shape(F.col("raw"))).withColumn("a", parse_address(F.col("raw")))
    rows = rows.withColumn("address_key", address_key(F.col("a"), F.col("raw")))
    return rows.select("address_key", "raw", "subject", "role", "status", "sources", "discovered_from", "a.*")


def resolve_addresses(parsed: DataFrame) -> DataFrame:
    """One row per canonical key; nothing is merged on similarity.

    A component comes from the first observation that has it. Observations and
    links stay rows of ``parsed``, so a building with a third of all companies
    is only counted here.
    """
    order = F.struct("discovered_from", "raw")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in COMPONENTS]
    merged = parsed.groupBy("address_key").agg(
        F.min_by("raw", order).alias("raw"), *first, F.count(F.lit(1)).alias("observations"), F.countDistinct("subject", "role").alias("linked_entities"))
    exact = F.col("street").isNotNull() & F.col("house_number").isNotNull() & F.col("city").isNotNull()
    return merged.withColumn("resolution", F.when(exact, "exact").otherwise("partial")).withColumn("publication", F.lit("public_with_context"))


def address_sources(parsed: DataFrame) -> DataFrame:
    return parsed.select("address_key", F.explode("sources").alias("source_id")).distinct()
