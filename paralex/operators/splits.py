"""Deterministic splits of exact size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paralex.operators.books import is_training_book, with_book

SEED, TEST_SHARE = 41, 0.1
_PREFIX = 4


def _mark(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def smallest(df: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED) -> Column:
    """A condition that holds for exactly ``ceil(share * n)`` of the rows of ``df``,
    those whose seeded hash is smallest.

    The driver sees counts by the first hexadecimal digits (16^4 at most) and one
    boundary row; the rows themselves are neither sorted nor moved.  Keys should
    be unique: rows of one key fall on one side.
    """
    marked = df.select(_mark(key, seed).alias("m"), F.col(key).cast("string").alias("k"))
    counts = sorted((r[0], r[1]) for r in marked.groupBy(F.substring("m", 1, _PREFIX)).count().collect())
    left = math.ceil(share * sum(n for _, n in counts))
    for prefix, n in counts:
        if left <= n:
            break
        left -= n
    if not counts or not left:
        return F.lit(False)
    order = Window.partitionBy("p").orderBy("m", "k")
    inside = marked.withColumn("p", F.substring("m", 1, _PREFIX)).filter(F.col("p") == prefix)
    edge = inside.withColumn("r", F.row_number().over(order)).filter(F.col("r") == left).first()
    mark = _mark(key, seed)
    return (mark < edge["m"]) | ((mark == edge["m"]) & (F.col(key).cast("string") <= edge["k"]))


def train_validation(pool: DataFrame, key: str = "verse_id", share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """``pool`` with ``split``: ``validation`` for exactly that share, else ``train``."""
    chosen = smallest(pool, key, share, seed)
    return pool.withColumn("split", F.when(chosen, "validation").otherwise("train"))


def assign_splits(df: DataFrame, key: str = "verse_id", share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """``df`` with ``book`` and ``split``: known books are train or validation, all others test."""
    booked = with_book(df)
    inside = is_training_book(F.col("book"))
    chosen = smallest(booked.filter(inside), key, share, seed)
    return booked.withColumn("split", F.when(~inside, "test").when(chosen, "validation").otherwise("train"))


def select_split(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name)


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))
