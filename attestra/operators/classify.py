"""Rule tables as Column expressions: what kind of change is it?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra import rules
from attestra.functions.text import lookup, rank_of

NO_CHANGE = "NO_EPISTEMIC_CHANGE"


def status_rank(status: Column) -> Column:
    return lookup(status, rules.STATUS_RANK)


def materiality_rank(materiality: Column) -> Column:
    return rank_of(materiality, rules.MATERIALITY)


def epistemic_transition(old: Column, new: Column) -> Column:
    """What a status change does to the strength of a record."""
    a, b = status_rank(old), status_rank(new)
    return (
        F.when(new == "CONTRADICTED", "CONTRADICTED")
        .when(old == "CONTRADICTED", "RESOLVED")
        .when(a.isNull() & b.isNotNull(), "STRENGTHENED")
        .when(a.isNotNull() & b.isNull(), "WEAKENED")
        .when(a.isNull() & b.isNull(), "UNKNOWN")
        .when(b > a, "STRENGTHENED")
        .when(b < a, "WEAKENED")
        .otherwise(NO_CHANGE)
    )


def _class(change_type, materiality, impact) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        wrap(change_type).alias("change_type"),
        wrap(materiality).alias("materiality"),
        wrap(impact).alias("epistemic_impact"),
    )


#: Fields of a payload that classes depend on.
READ = ["status", "tier", "predicate", "bucket", "superseded"]
# One table for all kinds keeps the generated code small, where one branch per
# rule would outgrow what the JVM compiles well. Added, removed, changed.
_ADDED = [r[1:] for r in rules.ADDED_RULES] + [("OBJECT_ADDED", "INFORMATIONAL", NO_CHANGE)]
_REMOVED = [("OBJECT_REMOVED_FROM_PUBLICATION", "MEDIUM", "UNKNOWN")]
_CHANGED = [r[2:] for r in rules.CHANGED_RULES] + [("OBJECT_ENRICHED", "LOW", NO_CHANGE)]
_TABLE = _ADDED + _REMOVED + _CHANGED


def read_payloads(kind: Column, old: Column, new: Column) -> Column:
    """Struct of what classes depend on: the fields of the new payload, and the former status as ``was``."""
    get = lambda p, n: F.get_json_object(p, "$." + n)
    return F.struct(*[get(new, n).alias(n) for n in READ], F.when(kind == "changed", get(old, "status")).alias("was"))


def rule_of(kind: Column, object_type: Column, read: Column, fields: Column) -> Column:
    """Position of the rule that applies, in the one table of all kinds. ``read``: see ``read_payloads``."""
    position = {r[0]: i for i, r in enumerate(rules.ADDED_RULES, start=1)}
    added = F.coalesce(lookup(object_type, position), F.lit(len(_ADDED)))
    touched = fields["field"]
    sources = F.try_element_at(F.filter(fields, lambda f: f["field"] == "sources"), F.lit(1))
    status = F.array_contains(touched, "status")
    named = {
        "<superseded>": F.array_contains(touched, "superseded") & (read["superseded"] == "true"),
        "<sources only added>": (F.size(sources["added"]) > 0) & (F.size(sources["removed"]) == 0),
        "<settled>": status & (read["was"] == "CONTRADICTED") & F.coalesce(read["status"] != "CONTRADICTED", F.lit(True)),
    }
    first = len(_ADDED) + len(_REMOVED)
    placed = [(t, trigger, first + i) for i, (t, trigger, *_) in enumerate(rules.CHANGED_RULES, start=1)]
    # the first rule that matches is the least position: of a touched field, of a named condition, of the type alone
    by_field, by_type = {}, {}
    for of_type, trigger, place in placed:
        if trigger is None:
            by_type.setdefault(of_type, place)
        elif not isinstance(trigger, str):
            for name in trigger:
                by_field.setdefault(f"{of_type} {name}", place)
    fielded = F.array_min(F.transform(touched, lambda f: lookup(F.concat_ws(" ", object_type, f), by_field)))
    told = [F.when((object_type == t) & named[trigger], F.lit(place)) for t, trigger, place in placed if isinstance(trigger, str)]
    changed = F.least(fielded, lookup(object_type, by_type), *told, F.lit(first + len(_CHANGED)))
    return F.when(kind == "added", added).when(kind == "removed", F.lit(first)).when(kind == "changed", changed)


def class_of(kind: Column, object_type: Column, read: Column, rule: Column) -> Column:
    """Struct of change_type, materiality and epistemic_impact by the rule's position."""
    base = [F.element_at(F.array(*[F.lit(r[i]).cast("string") for r in _TABLE]), rule) for i in range(3)]
    status = read["status"]
    verified = F.coalesce(status == "VERIFIED_PRIMARY", F.lit(False))
    first_tier = F.coalesce(read["tier"] == "1", F.lit(False))
    owner = F.coalesce(read["predicate"].isin(rules.OWNERSHIP_PREDICATES), F.lit(False))
    arrived = kind == "added"
    level = (
        F.when(arrived & (object_type == "source"), F.when(first_tier, "MEDIUM").otherwise("LOW"))
        .when(arrived & (object_type == "relationship"), F.when(owner & verified, "HIGH").otherwise("LOW"))
        .otherwise(base[1])
    )
    stronger = (
        F.when(object_type == "claim", F.coalesce(status_rank(status) >= 2, F.lit(False)))
        .when(object_type == "source", first_tier)
        .when(object_type.isin("relationship", "identity_field"), verified)
        .when(object_type == "financial_fact", F.coalesce(read["bucket"] == "verified", F.lit(False)))
    )
    impact = (
        F.when(base[2].isNull(), F.when(stronger, "STRENGTHENED").otherwise(NO_CHANGE))
        .when(base[2] == "<status>", epistemic_transition(read["was"], status))
        .otherwise(base[2])
    )
    return F.when(rule.isNotNull(), _class(base[0], level, impact))


def classify_change(kind: Column, object_type: Column, old: Column, new: Column, fields: Column) -> Column:
    """Struct of change_type, materiality and epistemic_impact."""
    read = read_payloads(kind, old, new)
    return class_of(kind, object_type, read, rule_of(kind, object_type, read, fields))


def categorize_change(change_type: Column, effective: Column, from_cutoff: Column, to_cutoff: Column) -> Column:
    """Did the world change, or what is known or published about it?

    Dates compare as text, so a bare year sorts before any day of that year.
    """
    return (
        F.when(change_type.isin(rules.PUBLICATION_CHANGES), "PUBLICATION_CHANGE")
        .when(change_type.isin(rules.CORRECTIONS), "CORRECTION")
        .when((effective > from_cutoff) & (effective <= to_cutoff), "WORLD_CHANGE")
        .otherwise("KNOWLEDGE_CHANGE")
    )
