"""Steps whose cost has to follow the input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paralex.functions import text
from paralex.operators import models, retrieval


def test_windows_hold_all_ngrams(spark):
    texts = ["", "a", "abcab", "añ\n😀b\r x😀", None, "aaaaaaaaaa"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.char_windows(F.col("t"), 4).alias("w")).collect()
    for t, r in zip(texts, rows):
        assert (r["w"] or []) == [t[i : i + 4] for i in range(len(t or ""))]
    got = Counter(w[:n] for r in rows for w in r["w"] or [] for n in range(1, len(w) + 1))
    assert got == Counter(t[i : i + n] for t in texts if t for n in range(1, 5) for i in range(len(t) - n + 1))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_missing_tokens_by_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(models, "SENT_TOKENS", limit)
    wanted = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("zz",)], "token string")
    known = spark.range(2000).select(F.when(F.col("id") % 7 == 0, "b").otherwise(F.concat(F.lit("x"), "id")).alias("token"))
    got = models.missing_tokens(wanted, known)
    assert sorted(str(r["token"]) for r in got.collect()) == ["None", "a", "a", "zz"]
    if limit > 1:  # the vocabulary is neither moved nor sorted
        assert "SortMergeJoin" not in plan(got)


@pytest.mark.parametrize("limit", [0, 5, 40])
def test_weights_with_a_large_vocabulary(spark, monkeypatch, limit):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], [1 / (j + 1) for j in range(60)], k=rng.randint(0, 30)))) for i in range(80)]
    texts.append((80, "once w1 w1"))
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    tokens = text.tokens_words(F.col("text"))

    def weights():
        idf = retrieval.tfidf_idf(rows, tokens, len(texts))
        listed = rows.select("doc_id", F.explode(F.array_distinct(tokens)).alias("term"))
        found = retrieval.tfidf_weights(retrieval.postings(rows, "doc_id", tokens), idf.localCheckpoint(), "doc_id", listed)
        return found, {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in found.collect()}

    def best():
        return sorted(map(tuple, retrieval.top_k_tfidf(rows, rows.limit(9).withColumnRenamed("doc_id", "item_id"), 3).collect()))

    want, ranks = weights()[1], best()
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", limit)
    found, got = weights()
    assert got == want and best() == ranks
    near, rest = retrieval.split_idf(retrieval.tfidf_idf(rows, tokens, len(texts)))
    assert near.count() <= limit and near.count() + rest.count() == len({t for _, t in want})
