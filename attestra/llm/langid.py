"""Language identification by a blended-spectrum string kernel.

The kernel of two texts is the sum over n = 1..4 of the shared distinct character
n-grams, each order divided by the geometric mean of the two counts (a presence kernel).
Nyström: the kernel against a few hundred landmark texts, whitened by the landmarks' own
kernel, is the feature vector; kernel ridge regression gives one line per language
against the rest. The kernel is linear in n-gram presence, so landmarks, whitening and
regression fold into one matrix per order, and a batch of texts is scored by matrix
products. The model is fitted on a bounded sample of labelled texts; whole texts are
scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import remainder

ORDERS = (1, 2, 3, 4)
#: Labelled texts per language to fit on, those of them that serve as landmarks, and the
#: length (in characters) up to which texts are short: these come first, and the sample and
#: the landmarks of a language hold as many characters as that many texts of this length.
SAMPLE_PER_LANG = 400
LANDMARKS_PER_LANG = 60
SAMPLE_CHARS = 5_000
RIDGE = 0.1
UNKNOWN = "und"
#: What a letter is, for training, predicting and rejecting alike.
LETTER = r"\p{L}"
#: Parts in which the texts of one language are looked through, level by level, before the first of all are taken.
SPREAD = (256, 16)
_BITS = 20
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _points(text: str) -> np.ndarray:
    """Code points, plus one, of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)


def _codes(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit codes of the n-grams, in order of place."""
    if len(points) < n:
        return np.empty(0, np.uint64)
    points = points.astype(np.uint64)
    code = np.zeros(len(points) - n + 1, np.uint64)
    for i in range(n):
        code += points[i : len(points) - n + 1 + i] * _PRIMES[i]
    return (code ^ (code >> np.uint64(31))) * _PRIMES[0] ^ np.uint64(n)


def grams(text: str) -> list[np.ndarray]:
    """For each order the 64-bit codes of the n-grams of the lower-cased text, in order of place."""
    points = _points(text)
    return [_codes(points, n) for n in ORDERS]


@dataclass
class Model:
    """Languages, and for each order the sorted known n-grams and their weight for each language."""

    langs: list[str]
    codes: list[np.ndarray]
    weights: list[np.ndarray]
    bias: np.ndarray

    def __post_init__(self):
        self.slots = []
        for codes in self.codes:
            # first filter: which of 2^20 slots hold a known n-gram at all
            slot = np.zeros(1 << _BITS, bool)
            slot[(codes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.slots.append(slot)

    def known(self, order: int, codes: np.ndarray) -> np.ndarray:
        """Distinct places, in the list of known n-grams, of those that occur."""
        table = self.codes[order]
        if not len(table):
            return np.empty(0, np.int64)
        codes = codes[self.slots[order][(codes >> np.uint64(64 - _BITS)).astype(np.int64)]]
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        seen = np.zeros(len(table), bool)
        seen[at[table[at] == codes]] = True
        return np.nonzero(seen)[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts x languages; products of presence and weight matrices, order by order."""
        total = np.tile(self.bias, (len(texts), 1))
        points = [_points(t) for t in texts]
        for k, n in enumerate(ORDERS):
            # the n-grams of one text and order at a time, eight bytes a character
            found, size = [], np.ones(len(texts))
            for i, p in enumerate(points):
                codes = _codes(p, n)
                found.append(self.known(k, codes))
                size[i] = max(1, len(np.unique(codes)))
            owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            used, column = np.unique(np.concatenate(found), return_inverse=True) if len(owner) else (np.empty(0, np.int64), owner)
            for low in range(0, len(used), 8192):
                inside = (column >= low) & (column < low + 8192)
                presence = np.zeros((len(texts), min(8192, len(used) - low)))
                presence[owner[inside], column[inside] - low] = 1
                total += (presence @ self.weights[k][used[low : low + 8192]]) / np.sqrt(size)[:, None]
        return total


def fit(texts: list[str], langs: list[str], landmarks: np.ndarray, ridge: float = RIDGE) -> Model:
    """Ridge regression of +1 / -1 targets on the Nyström features of ``texts``."""
    names = sorted(set(langs))
    spectra = [[np.unique(g) for g in grams(t)] for t in texts]
    codes, against, scaled = [], np.zeros((len(texts), len(landmarks))), []
    for k in range(len(ORDERS)):
        table = np.unique(np.concatenate([spectra[i][k] for i in landmarks]))
        size = np.sqrt([max(1, len(s[k])) for s in spectra])

        def presence(part, table=table, k=k) -> np.ndarray:
            rows = np.zeros((len(part), len(table)), np.float32)
            for r, i in enumerate(part):
                rows[r, np.nonzero(np.isin(table, spectra[i][k], assume_unique=True))[0]] = 1
            return rows

        marks = presence(landmarks) / size[landmarks].astype(np.float32)[:, None]
        for low in range(0, len(texts), 128):
            part = range(low, min(low + 128, len(texts)))
            against[part] += (presence(part) @ marks.T) / size[part][:, None]
        codes.append(table)
        scaled.append(marks)
    value, vector = np.linalg.eigh(against[landmarks])
    good = value > value.max() * 1e-8
    white = vector[:, good] / np.sqrt(value[good])
    features = against @ white
    target = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    bias = target.mean(0)
    solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ (target - bias))
    return Model(names, codes, [m.T @ (white @ solved).astype(np.float32) for m in scaled], bias)


def _first(usable: DataFrame, order: list[str], per_lang: int) -> DataFrame:
    """lang, text, _place: the first ``per_lang`` rows of each language in this order.

    Level by level: each part of a language hands on its first rows, then fewer parts do,
    then the first of these are taken, so a language that most rows have is no task of its
    own. Texts are not sorted; those of the rows that are taken come in at the end, by id
    and hash. Repeated rows take places of their part only.
    """
    names = [*order, "_mark", "doc_id", "_print"]
    rows = usable.withColumns({"_mark": F.xxhash64("doc_id"), "_print": F.xxhash64("text")})
    sent = rows.select("lang", *names)
    for parts in SPREAD:
        part = W.partitionBy("lang", F.pmod(F.hash("doc_id", "_print"), F.lit(parts)))
        sent = sent.withColumn("_rank", F.row_number().over(part.orderBy(*names))).filter(F.col("_rank") <= per_lang).select("lang", *names).distinct()
    taken = sent.withColumn("_place", F.row_number().over(W.partitionBy("lang").orderBy(*names))).filter(F.col("_place") <= per_lang)
    # at most per_lang rows of each language, so their texts are a bounded sample
    taken = taken.select("lang", "doc_id", "_print", "_place")
    texts = rows.select(F.col("doc_id").alias("_id"), F.col("_print").alias("_p"), F.col("lang").alias("_l"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_p")) & (F.col("lang") == F.col("_l"))
    return texts.join(taken, same).dropDuplicates(["lang", "_place"]).select("lang", "text", "_place")


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``per_lang`` labelled texts of each language, in hash order of the id.

    Texts without a letter are not sampled. Texts of more than ``chars`` characters come
    after the others, shortest first, for languages with fewer short ones than
    ``per_lang``. Of all of a language's texts no more than ``per_lang * chars``
    characters are held, but one text at least; of one text, as many characters as the
    landmarks may hold, from its first letter on.
    """
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    lettered = F.col("text").rlike(LETTER)
    length = F.length("text")
    sample = _first(usable.filter((length <= chars) & lettered), [], per_lang).toPandas()
    held = sample.groupby("lang")["text"].agg(["size", lambda texts: texts.str.len().sum()])
    full = held.index[held["size"] >= per_lang].tolist()

    # languages that short texts do not fill; their long ones stay short of the same bound
    long = usable.filter(~F.col("lang").isin(full) & (length > chars) & lettered) if full else usable.filter((length > chars) & lettered)
    cut = F.substring(F.regexp_replace("text", r"^\P{L}++", ""), 1, chars * LANDMARKS_PER_LANG)
    first = _first(long.select("doc_id", "lang", cut.alias("text"), length.alias("_length")), ["_length"], per_lang)
    until = W.partitionBy("lang").orderBy("_place")
    bounded = first.withColumn("_sum", F.sum(F.length("text")).over(until)).filter((F.col("_place") == 1) | (F.col("_sum") <= per_lang * chars))
    more = bounded.select("lang", "text", "_place", "_sum").toPandas()
    have = more["lang"].map(dict(zip(held.index, held.to_numpy().tolist(), strict=True)))
    have = [h if isinstance(h, list) else [0, 0] for h in have]
    more["_place"] += [h[0] for h in have]
    fits = (more["_place"] <= per_lang) & ((more["_place"] == 1) | (more["_sum"] + [h[1] for h in have] <= per_lang * chars))
    sample = pd.concat([sample, more[fits]])[["lang", "text", "_place"]].sort_values(["lang", "_place"]).reset_index(drop=True)
    if sample.empty:
        return Model([], [np.empty(0, np.uint64)] * len(ORDERS), [np.empty((0, 0))] * len(ORDERS), np.empty(0))
    total = sample["text"].str.len().groupby(sample["lang"]).cumsum()
    marks = (sample["_place"] <= LANDMARKS_PER_LANG) & ((sample["_place"] == 1) | (total <= chars * LANDMARKS_PER_LANG))
    return fit(sample["text"].tolist(), sample["lang"].tolist(), np.nonzero(marks.to_numpy())[0])


def _predict(model: Model, text_at: int, untaught: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lettered = batch.column(text_at), batch.column(batch.num_columns - 1).to_pylist()
            lengths = pc.utf8_length(texts).to_pylist()
            low = 0
            while low < len(texts):
                # rows that are scored at once, and handed on before the next texts are unpacked
                high, chars, todo = low, 0, []
                while high < len(texts) and len(todo) < 256 and (not todo or chars < 1_000_000):
                    if lettered[high]:
                        chars += lengths[high]
                        todo.append(high)
                    high += 1
                pred, score = [UNKNOWN] * (high - low), np.zeros(high - low)
                if not model.langs:
                    for i in todo:
                        pred[i - low] = untaught
                elif todo:
                    part = model.scores([texts[i].as_py() for i in todo])
                    for i, best, s in zip(todo, part.argmax(1), part.max(1), strict=True):
                        pred[i - low], score[i - low] = model.langs[best], min(1.0, max(0.0, (s + 1) / 2))
                own = batch.slice(low, high - low).columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])
                low = high

    return run


def _held_out(docs: DataFrame) -> Column:
    return remainder(docs["doc_id"], 4) == 2


def fit_and_predict(docs: DataFrame, *more: Column, untaught: str = UNKNOWN) -> DataFrame:
    """doc_id, text, the columns ``more``, lang_pred and score: one row per row of ``docs``.

    ``untaught`` is said of texts with a letter if there was nothing to learn from.
    """
    model = train(docs.filter(~_held_out(docs)))
    kept = docs.select("doc_id", F.col("text").cast("string"), *more)
    # one test for letters, the same as in training
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    lettered = F.coalesce(F.col("text").cast("string").rlike(LETTER), F.lit(False))
    kept = docs.select("doc_id", F.col("text").cast("string"), *more, lettered.alias("_lettered"))
    return kept.mapInArrow(_predict(model, 1, untaught), schema)


def identified(docs: DataFrame, wanted: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """``docs`` whose language can be told, with the prediction as lang where lang is null.

    Rejected are texts that are `und` (null, or without a letter), that are predicted to be
    in none of the ``wanted`` languages (by default all that were learned), or whose
    prediction scores below ``least``. A table without labelled texts keeps all texts with
    a letter, as there is nothing to tell them by. Repeated rows are judged alike; an empty
    table gives an empty result; columns of any name stay as they are.
    """
    # a text goes to Python and back once, unless the cast to string changed it
    carried = [c for c in docs.columns if c != "text" or docs.schema["text"].dataType != T.StringType()]
    told = fit_and_predict(docs, F.struct(*carried).alias("row"), untaught="")
    stays = (F.col("lang_pred") == "") | (F.col("score") >= least)
    if wanted is not None:
        stays = stays & ((F.col("lang_pred") == "") | F.col("lang_pred").isin(wanted))
    told = told.filter((F.col("lang_pred") != UNKNOWN) & stays)
    lang = F.coalesce(F.col("row.`lang`"), F.nullif("lang_pred", F.lit("")).cast(docs.schema["lang"].dataType))
    return told.select(*[lang.alias(c) if c == "lang" else F.col(f"row.`{c}`" if c in carried else c) for c in docs.columns])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``.

    ``docs``: doc_id, text, lang; other columns are ignored. Only texts and non-null
    langs of rows whose crc32(doc_id as text) mod 4 is not 2 are learned from (a null id
    counts as not held out). The prediction looks at the text alone: `und` and 0 if it is
    null or has no letter, or if there was nothing to learn from. Score is half of one
    plus the regression value, held to 0..1. Repeated rows get equal answers; an empty
    table gives an empty result.
    """
    told = fit_and_predict(docs)
    return told.select("doc_id", _held_out(told).alias("held_out"), "lang_pred", "score")
