"""The search by tiles against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_retrieval_and_metrics import found, plain_bm25, random_texts

from paralex.operators import pruning, retrieval, tiles


@pytest.mark.parametrize("queries,documents,tile,dense,products", [(5, 30, 64, 4, 7), (16_384, 32_768, 1 << 22, 0, 1 << 22), (3, 1000, 1, 256, 1)])
def test_tiles_equal_all_sums(spark, monkeypatch, queries, documents, tile, dense, products):
    for name, value in (("QUERIES", queries), ("DOCUMENTS", documents), ("TILE", tile), ("DENSE", dense), ("PRODUCTS", products)):
        monkeypatch.setattr(tiles, name, value)
    monkeypatch.setattr(pruning, "candidates", None)  # no partial sums of queries and documents are made
    corpus, asked = random_texts(150, 1), [*random_texts(12, 2), (50, "nowhere"), (51, ""), (52, "w1 nowhere")]
    corpus += [(1000 + i, t) for i, t in corpus[:40]]  # copies tie
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got, want = found(retrieval.top_k_bm25(df(corpus, "doc_id"), df(asked, "item_id"), 4)), plain_bm25(corpus, asked, 4)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 2e-6 for q in got for (_, a), (_, b) in zip(got[q], want[q]))


def test_only_k_rows_of_a_part_leave_it(spark, monkeypatch):
    monkeypatch.setattr(tiles, "DOCUMENTS", 100)
    impacts = spark.range(300).select(F.col("id").alias("key"), F.array(F.lit("a")).alias("terms"), F.array(F.rand(1)).alias("parts"))
    asked = spark.range(20).select(F.col("id").alias("q"), F.lit("a").alias("term"), F.lit(1.0).alias("times"))
    assert tiles.best_matches(impacts, asked, asked, "q", "key", 2, 300, 300).count() == 20 * 3 * 2


def test_the_best_of_rows_with_ties():
    rng = random.Random(4)
    scores = np.array([[rng.choice([0.0, 1e-7, 0.25, 0.2500004, -0.5, 1.0]) for _ in range(30)] for _ in range(40)])
    row, column, value = tiles.best_of(scores, 5)
    for i in range(len(scores)):
        want = sorted(range(30), key=lambda j: (-round(scores[i, j], 6), j))[:5]
        assert sorted(want) == sorted(column[row == i].tolist())
        assert sorted(round(scores[i, j], 6) for j in want) == sorted(value[row == i].tolist())
