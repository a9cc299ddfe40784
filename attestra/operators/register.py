"""Assertions from nested register records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import assertion_id, json_pointer
from attestra.session import stored

# The register's own field names.
PERSON = "STRUCT<jmeno:STRING,prijmeni:STRING,datumNarozeni:STRING>"
COMPANY = "STRUCT<obchodniJmeno:STRING,ico:STRING>"
AMOUNT = "STRUCT<hodnota:STRING,typObnos:STRING>"
MEMBER = (f"STRUCT<fyzickaOsoba:{PERSON},pravnickaOsoba:{COMPANY},nazevAngazma:STRING,datumZapisu:STRING,datumVymazu:STRING,"
          "clenstvi:STRUCT<funkce:STRUCT<nazev:STRING,vznikFunkce:STRING,zanikFunkce:STRING>>>")
REGISTER_SCHEMA = (
    "STRUCT<zaznamy:ARRAY<STRUCT<primarniZaznam:BOOLEAN,stavSubjektu:STRING,"
    "obchodniJmeno:ARRAY<STRUCT<hodnota:STRING,datumZapisu:STRING,datumVymazu:STRING>>,"
    "spisovaZnacka:ARRAY<STRUCT<oddil:STRING,vlozka:STRING,soud:STRING,datumZapisu:STRING,datumVymazu:STRING>>,"
    f"zakladniKapital:ARRAY<STRUCT<vklad:{AMOUNT},datumZapisu:STRING,datumVymazu:STRING>>,"
    f"statutarniOrgany:ARRAY<STRUCT<nazevOrganu:STRING,clenoveOrganu:ARRAY<{MEMBER}>>>,"
    f"ostatniOrgany:ARRAY<STRUCT<nazevOrganu:STRING,clenoveOrganu:ARRAY<{MEMBER}>>>,"
    f"spolecnici:ARRAY<STRUCT<spolecnik:ARRAY<STRUCT<osoba:STRUCT<fyzickaOsoba:{PERSON},pravnickaOsoba:{COMPANY}>,fyzickaOsoba:{PERSON},pravnickaOsoba:{COMPANY},"
    f"podil:ARRAY<STRUCT<velikostPodilu:{AMOUNT},vklad:{AMOUNT},datumZapisu:STRING,datumVymazu:STRING>>>>>>>>>"
)


def _person(p: Column, c: Column) -> Column:
    """Natural person first, else the company."""
    full = F.nullif(F.concat_ws(" ", p["jmeno"], p["prijmeni"]), F.lit(""))
    none = F.lit(None).cast("string")
    natural = F.struct(full.alias("name"), p["datumNarozeni"].alias("born"), none.alias("ico"))
    legal = F.struct(c["obchodniJmeno"].alias("name"), none.alias("born"), c["ico"].alias("ico"))
    return F.when(p.isNotNull(), natural).when(c.isNotNull(), legal)


NOBODY = "STRUCT<name:STRING,born:STRING,ico:STRING>"


def _row(pointer: Column, predicate: str, value=None, who=None, role=None, organ=None, stake=None, paid=None, start=None, end=None) -> Column:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return F.struct(
        pointer.alias("pointer"), F.lit(predicate).alias("predicate"), text(value).alias("value"),
        (who if who is not None else F.lit(None)).cast(NOBODY).alias("who"), text(role).alias("role"), text(organ).alias("organ"),
        text(stake).alias("stake"), text(paid).alias("vklad"), text(start).alias("valid_from"), text(end).alias("valid_to"))


def _each(items: Column, build) -> Column:
    """Rows of an array with positions; nothing when the array is missing."""
    return F.coalesce(F.transform(items, build), F.array())


def _record_rows(z: Column, zi: Column) -> Column:
    at = lambda *parts: json_pointer("zaznamy", zi, *parts)
    amount = lambda a: F.when(a.isNotNull(), F.concat_ws(" ", a["hodnota"], a["typObnos"]))
    names = F.transform(z["obchodniJmeno"], lambda n, i: _row(at("obchodniJmeno", i), "registry:business-name", n["hodnota"], start=n["datumZapisu"], end=n["datumVymazu"]))
    court = lambda s: F.concat(s["oddil"], F.lit(" "), s["vlozka"], F.lit("/"), s["soud"])
    files = F.transform(z["spisovaZnacka"], lambda s, i: _row(at("spisovaZnacka", i), "registry:court-file", court(s), start=s["datumZapisu"], end=s["datumVymazu"]))
    capital = F.transform(z["zakladniKapital"], lambda k, i: _row(at("zakladniKapital", i), "registry:registered-capital", amount(k["vklad"]), start=k["datumZapisu"], end=k["datumVymazu"]))
    state = F.when(z["stavSubjektu"].isNotNull(), F.array(_row(at("stavSubjektu"), "registry:subject-state", z["stavSubjektu"])))

    def members(field: str, predicate: str, officer: bool) -> Column:
        def one(org: Column, oi: Column) -> Column:
            def member(c: Column, ci: Column) -> Column:
                job = c["clenstvi"]["funkce"]
                role = F.coalesce(job["nazev"], c["nazevAngazma"]) if officer else job["nazev"]
                return _row(at(field, oi, "clenoveOrganu", ci), predicate, who=_person(c["fyzickaOsoba"], c["pravnickaOsoba"]), role=role, organ=None if officer else org["nazevOrganu"],
                            start=F.coalesce(job["vznikFunkce"], c["datumZapisu"]), end=F.coalesce(job["zanikFunkce"], c["datumVymazu"]))

            return F.transform(org["clenoveOrganu"], member)

        return F.flatten(F.filter(F.transform(z[field], one), lambda x: x.isNotNull()))

    def holders(s: Column, si: Column) -> Column:
        def holder(sp: Column, pi: Column) -> Column:
            # named in a person record, or directly in the holder
            who = F.coalesce(_person(sp["osoba"]["fyzickaOsoba"], sp["osoba"]["pravnickaOsoba"]), _person(sp["fyzickaOsoba"], sp["pravnickaOsoba"]))

            def share(p: Column, di: Column) -> Column:
                size = p["velikostPodilu"]
                stake = F.when(size.isNotNull(), F.concat(size["hodnota"], F.when(size["typObnos"] == "PROCENTA", " %").otherwise("")))
                return _row(at("spolecnici", si, "spolecnik", pi, "podil", di), "registry:shareholding", who=who, stake=stake, paid=amount(p["vklad"]), start=p["datumZapisu"], end=p["datumVymazu"])

            return F.transform(sp["podil"], share)

        return F.flatten(F.filter(F.transform(s["spolecnik"], holder), lambda x: x.isNotNull()))

    shares = F.flatten(F.filter(F.transform(z["spolecnici"], holders), lambda x: x.isNotNull()))
    groups = [names, files, capital, state, members("statutarniOrgany", "registry:officer", True), members("ostatniOrgany", "registry:other-organ-member", False), shares]
    return F.flatten(F.filter(F.array(*groups), lambda g: g.isNotNull()))


def extract_assertions(records: DataFrame) -> DataFrame:
    """One row per register fact with pointer, holder and validity.

    ``records``: entity, sha256, record (REGISTER_SCHEMA). Each document is
    unfolded where it lies; nothing is shuffled. Only primary records count.
    """
    per = F.transform(F.col("record.zaznamy"), lambda z, zi: F.when(z["primarniZaznam"], _record_rows(z, zi)))
    rows = records.select("entity", "sha256", F.explode(F.flatten(F.filter(per, lambda x: x.isNotNull()))).alias("a")).select("entity", "sha256", "a.*")
    return rows.withColumn("id", assertion_id(F.col("sha256"), F.col("pointer"), F.col("predicate")))


# Fields of a basic extract and the fact each states; the first two are always stated.
BASIC_FACTS = [
    ("ico", "registry:ico"),
    ("obchodniJmeno", "registry:business-name-current"),
    ("sidlo/textovaAdresa", "registry:seat-current"),
    ("datumVzniku", "registry:incorporated"),
    ("datumZaniku", "registry:dissolved"),
    ("dic", "registry:vat-id"),
    ("pravniForma", "registry:legal-form-code"),
]
BASIC_SCHEMA = "STRUCT<ico:STRING,obchodniJmeno:STRING,sidlo:STRUCT<textovaAdresa:STRING>,datumVzniku:STRING,datumZaniku:STRING,dic:STRING,pravniForma:STRING>"


def basic_assertions(records: DataFrame) -> DataFrame:
    """Current name, seat, numbers and dates of a basic extract. ``records``: entity, sha256, record (BASIC_SCHEMA)."""
    facts = []
    for i, (path, predicate) in enumerate(BASIC_FACTS):
        value = F.col("record." + path.replace("/", "."))
        stated = F.col("record").isNotNull() if i < 2 else F.col("record.sidlo").isNotNull() if path.startswith("sidlo/") else F.coalesce(value != "", F.lit(False))
        facts.append(F.when(stated, _row(json_pointer(*path.split("/")), predicate, value)))
    rows = records.select("entity", "sha256", F.explode(F.filter(F.array(*facts), lambda x: x.isNotNull())).alias("a")).select("entity", "sha256", "a.*")
    return rows.withColumn("id", assertion_id(F.col("sha256"), F.col("pointer"), F.col("predicate")))


def newest_artifacts(manifest: DataFrame) -> DataFrame:
    """The last line of the manifest for each (entity, tag). ``manifest``: entity, tag, line and what describes the artifact."""
    rest = [c for c in manifest.columns if c not in ("entity", "tag")]
    last = manifest.groupBy("entity", "tag").agg(F.max_by(F.struct(*rest), F.col("line")).alias("_m"))
    return last.select("entity", "tag", *[F.col(f"_m.`{c}`").alias(c) for c in rest])


def register_assertions(manifest: DataFrame, bodies: DataFrame) -> DataFrame:
    """Facts of the newest full record and the newest basic extract of every entity.

    ``manifest``: entity, tag, line, sha256; ``bodies``: sha256, body (JSON text).
    Older artifacts stay in the manifest and state nothing. Only the bodies that
    are needed are joined and parsed.
    """
    wanted = newest_artifacts(manifest.select("entity", "tag", "line", "sha256").filter(F.col("tag").isin("ares-vr", "ares-basic")))
    read = wanted.join(bodies.dropDuplicates(["sha256"]), "sha256")
    full = read.filter("tag = 'ares-vr'").select("entity", "sha256", F.from_json("body", REGISTER_SCHEMA).alias("record"))
    basic = read.filter("tag = 'ares-basic'").select("entity", "sha256", F.from_json("body", BASIC_SCHEMA).alias("record"))
    return extract_assertions(full).unionByName(basic_assertions(basic))


def sort_assertions(df: DataFrame) -> DataFrame:
    """In order of entity, predicate and id.

    Stored first: a sort samples its input in a pass of its own, which would
    take the assertions out of their documents twice.
    """
    return stored(df).orderBy(F.concat("entity", "predicate", "id"))
