"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are runs of key-like characters of at least 12 with a digit, with mixed case or
with the prefix of a known provider, and values of any printable characters assigned with
a colon or equals sign to a password, secret, token or key. The forest looks at length,
transitions between character classes, how much of the letters is dictionary words, the
name that a value is assigned to, the path (source) and the neighbouring words; it is
trained on labelled findings. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm.common import settle

_KEY = r"A-Za-z0-9+/_.@\-"
_PREFIX = r"(?:A[KS]IA|[sr]k_(?:live|test)_|sk-|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|AIza|SG\.|npm_|hf_)"
# of a run without a digit: capitals behind the first character besides small letters, or a prefix at its start or behind a symbol
_DIGIT, _MIXED, _KNOWN = r"[A-Za-z+/_.@\-]*+[0-9]", rf"(?=[{_KEY}]+[A-Z])[{_KEY}]*[a-z]", rf"(?:[{_KEY}]*[+/_.@\-])?{_PREFIX}"
_RUN = rf"(?<![{_KEY}])(?=[{_KEY}]{{12}})(?:(?={_DIGIT})|(?={_MIXED})|(?={_KNOWN}))[{_KEY}]++={{0,2}}"
#: Characters of an assigned value at least.
SHORTEST = 6
_PASSWORD = "password|passwd|passphrase|pwd"
_QUOTE = "\"'`"
_SIGN = rf"s?\d{{0,2}}[{_QUOTE}\])]?\s{{0,4}}[:=]{{1,2}}>?\s{{0,4}}[{_QUOTE}]?"
_NAME = rf"(?i:{_PASSWORD}|secret|token|key){_SIGN}"
# up to white space or a quote, a mark-up tag or the next parameter of a URL; closing punctuation only inside
_VALUE = rf"(?<=[:=>\s{_QUOTE}])(?![:=>])(?=[^\s{_QUOTE}]{{{SHORTEST}}})(?<={_NAME})(?:[^\s{_QUOTE}&<,;.:)\]}}>]|&(?!\w+=)|<(?!/?[A-Za-z])|[,;.:)\]}}>]++(?=[^\s{_QUOTE}&<]))++"
CANDIDATE = f"(?:{_VALUE}|{_RUN})"
#: Characters of text looked at on either side of a candidate.
CONTEXT = 80
#: Labelled findings that the forest is fitted on, at most; the first in hash order.
SAMPLE = 20_000
#: A dictionary word has four letters or more and stands near candidates this often.
DICTIONARY_COUNT = 5
TREES, DEPTH, SEED = 30, 6, 7
REDACTED = "[SECRET]"
_CLASSES = "lads"  # lower, upper, digit, symbol
_RATES = ("path", "before", "after")
# forms of keys that tell their provider; words and capitalised parts of words, with symbols between
_PROVIDED = r"^(?:A[KS]IA[0-9A-Z]{16}|[sr]k_(?:live|test)_[0-9A-Za-z]{16,}|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|xox[abeprs]-[0-9A-Za-z\-]{10,}|AIza[\w\-]{35})\.?$"
_WORDS = r"^(?:[A-Z]{2,}+|[A-Z]?[a-z]{2,}+)(?:[A-Z][a-z]{2,}+|[+/_.@\-]++(?:[A-Z]{2,}+|[A-Z]?[a-z]{2,}+))*+[+/_.@\-]*+$"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, mark (hash of the text), start, candidate, before, after, assigned, context: one row per candidate.

    ``start`` counts code points from 0; ``before`` and ``after`` are the nearest words
    within 80 characters, lower case, empty if there is none. ``assigned`` is 2 for a
    value assigned to a password, 1 for one of a secret, token or key, 0 for others.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("path"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    found = rows.filter(F.col("text").rlike(CANDIDATE)).select(
        "doc_id", "path", "row", F.xxhash64("text").alias("mark"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split("text", CANDIDATE, -1).alias("gaps"),
    )
    each = found.select(
        "doc_id", "path", "row", "mark",
        F.posexplode(F.transform("hits", lambda h, i: F.struct(
            h.alias("candidate"), F.length(F.get("gaps", i)).alias("gap"), F.right(F.get("gaps", i), F.lit(CONTEXT)).alias("left"), F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("right"),
            F.right(F.concat(F.coalesce(F.get("hits", i - 1), F.lit("")), F.get("gaps", i)), F.lit(CONTEXT)).alias("lead"),
        ))).alias("at", "hit"),
    ).select("doc_id", "path", "row", "mark", "at", "hit.*")
    until = W.partitionBy("row").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.sum(F.col("gap") + F.length("candidate")).over(until) - F.length("candidate")
    word = r"([\p{L}_]+)"
    assigned = F.when(F.col("lead").rlike(f"(?i:{_PASSWORD}){_SIGN}$"), 2.0).when(F.col("lead").rlike(f"{_NAME}$"), 1.0).otherwise(0.0)
    return each.select(
        "doc_id", "path", "mark", start.cast("long").alias("start"), "candidate",
        F.lower(F.regexp_extract("left", word + r"[^\p{L}_]*$", 1)).alias("before"), F.lower(F.regexp_extract("right", r"^[^\p{L}_]*" + word, 1)).alias("after"),
        assigned.alias("assigned"), F.concat_ws(" ", "left", "right").alias("context"),
    ).filter(F.length("candidate") >= SHORTEST)


def dictionary(found: DataFrame) -> DataFrame:
    """word: those that stand near candidates of the whole table at least five times."""
    words = found.select(F.explode(F.regexp_extract_all(F.lower("context"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= DICTIONARY_COUNT).select("word")


def _coverage(found: DataFrame) -> DataFrame:
    """candidate, covered: share of the candidate's characters inside dictionary words, for candidates with any."""
    parts = found.select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("word")).distinct()
    hit = parts.join(dictionary(found), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("letters"))
    return hit.select("candidate", (F.col("letters") / F.length("candidate")).alias("covered"))


def _shape(candidate: Column) -> list[Column]:
    """Length, shares of character classes, and shares of the sixteen class transitions."""
    classes = candidate
    for pattern, mark in ((r"[^A-Za-z0-9]", "\u0001"), (r"[0-9]", "\u0002"), (r"[A-Z]", "\u0003"), (r"[a-z]", "l"), ("\u0001", "s"), ("\u0002", "d"), ("\u0003", "a")):
        classes = F.regexp_replace(classes, pattern, mark)
    n = F.length(candidate)
    kinds = [(F.regexp_count(classes, F.lit(c)) / n).alias(f"share_{c}") for c in _CLASSES]
    steps = [(F.regexp_count(classes, F.lit(f"{a}(?={b})")) / n).alias(f"step_{a}{b}") for a in _CLASSES for b in _CLASSES]
    return [n.cast("double").alias("chars"), *kinds, *steps]


FEATURES = ["chars", *[f"share_{c}" for c in _CLASSES], *[f"step_{a}{b}" for a in _CLASSES for b in _CLASSES], "covered", "assigned", *[f"{c}_rate" for c in _RATES]]


def _with_rates(rows: DataFrame, taught: DataFrame) -> DataFrame:
    """Share of true findings at each path and neighbouring word among ``taught``, pulled towards one half.

    ``taught`` is a bounded sample, so the three tables of rates are bounded too.
    """
    for c in _RATES:
        rate = taught.filter(F.col(c).isNotNull()).groupBy(c).agg(((F.sum("label") + 1) / (F.count(F.lit(1)) + 2)).alias(f"{c}_rate"))
        rows = rows.join(F.broadcast(rate), c, "left").withColumn(f"{c}_rate", F.coalesce(f"{c}_rate", F.lit(0.5)))
    return rows


def _by_format() -> Column:
    """1.0 or 0.0 for candidates whose nature their format gives away, null for others."""
    c = F.col("candidate")
    named = F.col("before").isin("password", "passwd", "secret", "token", "key", "api_key", "apikey")
    password = F.col("assigned") == 2
    varied = c.rlike("[a-z]").cast("int") + c.rlike("[A-Z]").cast("int") + c.rlike("[0-9]").cast("int") + c.rlike("[^A-Za-z0-9]").cast("int")
    true = c.rlike(_PROVIDED) | ((named | (F.col("assigned") > 0)) & c.rlike("^[0-9a-f]{16,}$")) | ((password | ((F.col("assigned") > 0) & c.rlike(r"[$!#%&*^~]"))) & (F.length(c) >= 8) & (varied >= 3) & ~c.rlike(r"[()\[\]{}]"))
    # a password may be a word or a number
    false = c.rlike(r"^[^@]+@[^@]+\.[a-z]+\.?$") | c.rlike(r"^\d{1,3}(\.\d{1,3}){3}\.?$") | (~password & (c.rlike(r"^[0-9./\-]+$") | c.rlike(_WORDS)))
    return F.when(true, 1.0).when(false, 0.0)


def label_by_format(found: DataFrame) -> DataFrame:
    """candidate, mark, start, label for candidates whose nature their format gives away; no row for others."""
    return found.select("mark", "start", "candidate", _by_format().alias("label")).filter("label is not null")


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, path, mark, start, candidate, before, after, score, is_secret: one row per candidate.

    ``docs``: doc_id, text, source; other columns are ignored. ``findings``: mark, start,
    candidate, label (1.0 secret, 0.0 not) for some candidates; by default those that
    their format gives away. The forest is fitted on at most ``sample`` of them and scores
    every candidate, labelled or not; what it learns of paths and neighbours of a finding
    comes from the half that the finding is not in. A null
    or empty text has no candidates; a null source is unknown to the rates. Repeated rows
    give repeated findings. If findings of one kind only are known, there is no forest: a
    candidate's score is its own label, else 1 or 0 by its format, else 1 for a value that
    is assigned to a name and no plain word. An empty table gives an empty result.
    """
    found = settle(candidates(docs))
    label = label_by_format(found) if findings is None else findings
    # copies of one text are one lesson
    label = label.groupBy("mark", "start", "candidate").agg(F.max("label").alias("label"))
    lesson = found.groupBy("mark", "start", "candidate").agg(*[F.min(c).alias(c) for c in _RATES], F.max("assigned").alias("assigned")).join(label, ["mark", "start", "candidate"])
    order = F.xxhash64("mark", "start")
    taught = lesson.withColumn("order", order).orderBy("order", "mark", "start", "candidate").limit(sample)
    # both kinds are halved
    place = F.row_number().over(W.partitionBy("label").orderBy("order", "mark", "start", "candidate"))
    taught = settle(taught.withColumn("half", F.pmod(place, F.lit(2))))
    first_half = F.col("half") == 0
    known = taught.agg(*[F.count(F.when(F.col("label") == v, 1)).alias(f"n{int(v)}") for v in (0.0, 1.0)]).first()
    keep = ["doc_id", "path", "mark", "start", "candidate", "before", "after"]
    if not (known["n0"] and known["n1"]):
        named = ((F.col("assigned") > 0) & ~F.col("candidate").rlike(_WORDS)).cast("double")
        alone = F.coalesce("label", _by_format(), named)
        return found.join(label, ["mark", "start", "candidate"], "left").select(*keep, alone.alias("score"), (alone >= 0.5).alias("is_secret"))
    covered = settle(_coverage(found))

    def described(rows: DataFrame, rates_of: DataFrame) -> DataFrame:
        wide = rows.join(covered, "candidate", "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
        return _with_rates(wide.select("*", *_shape(F.col("candidate"))), rates_of)

    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # a lesson's rates come from the other half, so none of them knows its own answer
    halves = described(taught.filter(first_half), taught.filter(~first_half)).unionByName(described(taught.filter(~first_half), taught.filter(first_half)))
    lessons = settle(halves.orderBy("order", "candidate"))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model = forest.fit(assembler.transform(lessons).select("label", "features").coalesce(1))
    scored = model.transform(assembler.transform(described(found, taught)))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(*keep, score.alias("score"), (score >= 0.5).alias("is_secret"))


def held_out_quality(docs: DataFrame, findings: DataFrame | None = None) -> tuple[float, float, int]:
    """Precision and recall on labelled findings that the forest never saw, and their number.

    The texts are halved by their hash; the forest learns from the findings of one half
    and is asked about those of the other.
    """
    labels = settle(label_by_format(candidates(docs)) if findings is None else findings)
    labels = labels.groupBy("mark", "start", "candidate").agg(F.max("label").alias("label"))
    seen = F.pmod(F.xxhash64("mark"), F.lit(2)) == 0
    scanned = scan_secrets(docs, labels.filter(seen)).groupBy("mark", "start", "candidate").agg(F.max("score").alias("score"))
    asked = scanned.join(labels.filter(~seen), ["mark", "start", "candidate"])
    yes, true = F.col("score") >= 0.5, F.col("label") >= 0.5
    n = asked.agg(F.count_if(yes & true).alias("hit"), F.count_if(yes).alias("said"), F.count_if(true).alias("real"), F.count(F.lit(1)).alias("n")).first()
    return n.hit / max(1, n.said), n.hit / max(1, n.real), n.n


def redact(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """``docs`` with every found secret replaced in the text and n_chars, if there is one, counted anew.

    A found string is replaced wherever it stands in its text, also inside a longer word.
    Null and empty texts and rows without a secret stay as they are, and so do columns of
    other names; repeated rows are treated alike; an empty table gives an empty result.
    """
    secrets = scanned.filter("is_secret").select("mark", F.struct((-F.length("candidate")).alias("order"), "candidate").alias("hit"))
    lists = secrets.groupBy("mark").agg(F.sort_array(F.collect_set("hit")).alias("secrets"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("mark")).join(lists, "mark", "left")
    clean = F.aggregate("secrets", F.col("row.text"), lambda text, s: F.replace(text, s["candidate"], F.lit(REDACTED)))
    untouched = F.col("secrets").isNull()
    rows = rows.select("row", untouched.alias("untouched"), F.when(untouched, F.col("row.text")).otherwise(clean).alias("clean"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("clean").alias(name)
        if name == "n_chars":
            return F.when(F.col("untouched"), F.col("row.n_chars")).otherwise(F.length("clean")).cast(docs.schema[name].dataType).alias(name)
        return F.col(f"row.`{name}`")

    return rows.select(*[column(c) for c in docs.columns])
