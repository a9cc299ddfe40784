"""Identity, hashing and text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from attestra import rules


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to a base letter plus marks."""
    pairs = []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        marks = all(unicodedata.combining(m) for m in parts[1:])
        if chr(code).islower() and len(parts) > 1 and parts[0].isascii() and marks:
            pairs.append((chr(code), parts[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, FOLDED = _accent_table()


#: Strings, numbers, and what stands between them in JSON text.
_JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-'
#: Numbers that may be spelled in several ways: with a fraction, an exponent or many digits.
_JSON_UNEVEN = r"[0-9][.eE]|[0-9]{16}"


def canonical_number(token: Column) -> Column:
    """One spelling for every double: ``1e3``, ``1000`` and ``1000.0`` are ``1000``.

    Plain digits between 1e-6 and 1e21, an exponent such as ``1e-7`` or ``1e+21``
    beyond, no trailing zeros, no negative zero.
    """
    value = token.cast("double")
    size = F.abs(value)
    whole = value.try_cast("decimal(38,0)").cast("string")
    plain = F.regexp_replace(value.cast("string").try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0(?=E)", ""), "E-", "e-"), "E", "e+")
    return F.when((size < 1e21) & (F.rint(value) == value), whole).when((size >= 1e-6) & (size < 1e21), plain).otherwise(short)


def parsed_json(text: Column) -> Column:
    """The variant of JSON text, null for other text; of a repeated key the last value."""
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json(text)


def canonical_json(text: Column) -> Column:
    """JSON text with keys sorted at every level, array order kept, and numbers in one spelling.

    Null for text that is not JSON. Of a repeated key the last value counts: the
    setting that decides this is set on the session, whatever it was before, so
    that hashes do not depend on who started the session.
    """
    sorted_keys = F.to_json(parsed_json(text))
    tokens = F.regexp_extract_all(sorted_keys, F.lit(_JSON_TOKEN), F.lit(0))
    spelled = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), canonical_number(t)).otherwise(t)), "")
    return F.when(sorted_keys.rlike(_JSON_UNEVEN), spelled).otherwise(sorted_keys)


def canonical_struct(columns: dict[str, Column]) -> Column:
    """Canonical JSON of flat named values: sorted keys, nulls kept."""
    fields = [columns[k].alias(k) for k in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def content_hash(payload: Column) -> Column:
    return F.substring(F.sha2(payload, 256), 1, 16)


def revision_id(object_id: Column, digest: Column) -> Column:
    return F.concat_ws("@", object_id, digest)


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-16 units of ``text`` as eight hex digits."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    # FNV-1a offset basis, prime and word size.
    step = lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("bigint")) * F.lit(16777619)) % F.lit(4294967296)
    return F.lower(F.lpad(F.hex(F.aggregate(units, F.lit(2166136261).cast("bigint"), step)), 8, "0"))


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, FOLDED)


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(fold_accents(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def fold_key(text: Column) -> Column:
    return collapse(fold_accents(F.coalesce(text, F.lit(""))))


def gap_prefix(text: Column, length: int = 60) -> Column:
    return F.substring(F.lower(collapse(F.coalesce(text, F.lit("")))), 1, length)


def word_set(text: Column) -> Column:
    """Distinct lower-case words longer than three characters, sorted."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-zá-ž0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 3)))


def jaccard(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(shared / (F.size(left) + F.size(right) - shared))


def short_text(text: Column, limit: int, cut: int | None = None) -> Column:
    """Collapse spaces; cut long text before its last word and add an ellipsis."""
    flat = collapse(text)
    head = F.regexp_replace(F.substring(flat, 1, cut or limit - 1), "[\\s,;:—-]+\\S*$", "")
    return F.when(F.length(flat) > limit, F.concat(head, F.lit("…"))).otherwise(flat)


def extract_ids(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def has_birth_number(text: Column) -> Column:
    return F.coalesce(text.rlike(rules.BIRTH_NUMBER), F.lit(False))


def has_local_path(text: Column) -> Column:
    return F.coalesce(text.rlike(rules.LOCAL_PATH), F.lit(False))


def has_full_birth_date(text: Column) -> Column:
    return F.coalesce(text.rlike(rules.FULL_BIRTH_DATE), F.lit(False))


def has_value(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def assertion_id(sha: Column, pointer: Column, predicate: Column) -> Column:
    return F.concat(F.lit("ASR-"), F.substring(F.sha1(F.concat_ws("|", sha, pointer, predicate)), 1, 12))


def json_pointer(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(*[c for p in cols for c in (F.lit("/"), p)])


def rank_of(value: Column, ladder: list[str]) -> Column:
    """Zero-based position of ``value`` in a ladder; null when absent."""
    pos = F.array_position(F.array(*[F.lit(x) for x in ladder]), value)
    return F.when(pos > 0, (pos - 1).cast("int"))


def lookup(value: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def first_match(text: Column, ordered: list[tuple[str, str]], default: Column | None = None) -> Column:
    """Label of the first ``(label, pattern)`` whose pattern occurs in ``text``."""
    expr = default if default is not None else F.lit(None).cast("string")
    return reduce(lambda acc, lp: F.when(text.rlike("(?i)" + lp[1]), F.lit(lp[0])).otherwise(acc), reversed(ordered), expr)


def set_of(values: Column) -> Column:
    """Order and repetition never matter for id arrays."""
    return F.array_sort(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))))
