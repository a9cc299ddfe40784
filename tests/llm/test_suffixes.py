"""Shared passages against the plain version."""

import random
from collections import Counter

from pyspark.sql import functions as F

from attestra.llm import lm, suffixes
from tests.llm import brute


def spans(df):
    return Counter((r.doc_id, r.start_word, r.n_words, r.documents) for r in suffixes.repeated_passages(df).collect())


def test_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 9000)
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(10**6)
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)] + [["la"] * 120]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 90))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(len(w) + 1)
            w = w[:cut] + p + w[cut:]
        rows.append((i, " ".join(w)))
    rows += [(60, None), (61, ""), (62, " \n"), (63, rows[5][1]), (63, rows[5][1]), (None, rows[7][1]), (64, " ".join(passages[3] * 1 + ["x"] + passages[3]).upper())]
    alone = [word() for _ in range(60)]
    rows.append((65, " ".join(alone + ["y"] + alone)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("docs", F.lit(2)).repartition(3)
    got, want = spans(df), Counter(brute.repeated(rows))
    assert got == want
    assert not any(r[0] == 65 for r in got)
    assert spans(df.limit(0)) == Counter()


def test_shared_passages_of_the_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert spans(df) == Counter(brute.repeated([(r.doc_id, r.text) for r in df.collect()]))
