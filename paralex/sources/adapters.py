"""Synthetic tables in the shapes of parallel corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.functions.text import tokens_ws
from paralex.operators.books import NT_BOOKS, with_book

#: Codes of the other books.
OTHER_BOOKS = (
    "GEN", "EXO", "LEV", "NUM", "DEU", "JOS", "JDG", "RUT", "1SA", "2SA", "1KI", "2KI", "1CH", "2CH", "EZR", "NEH", "EST",
    "JOB", "PSA", "PRO", "ECC", "SNG", "ISA", "JER", "LAM", "EZK", "DAN", "HOS", "JOL", "AMO", "OBA", "JON", "MIC", "NAM",
    "HAB", "ZEP", "HAG", "ZEC", "MAL",
)
CODES = NT_BOOKS + OTHER_BOOKS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``verse_id, text_source, text_target, conv_id, turn``: a user's turn and the answer."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("text_source"))
    answer = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_target"))
    codes = F.array(*map(F.lit, CODES))
    book = F.get(codes, F.pmod(F.col("conv_id") * 5, F.lit(len(CODES))).cast("int"))
    verse = F.concat_ws("_", book, F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return user.join(answer, ["conv_id", "turn"]).select(verse.alias("verse_id"), "text_source", "text_target", "conv_id", "turn")


def multi_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``translation, ref`` (and the keys) of the same pairs."""
    p = with_book(pairs(spark, sf_dir))
    translation = F.struct(
        F.array(F.lit("src"), F.lit("tgt")).alias("language"), F.array("text_source", "text_target").alias("translation")
    )
    ref = F.concat(F.col("book"), F.lit(" "), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return p.select("conv_id", "turn", translation.alias("translation"), F.array(ref).alias("ref"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``verse_id, text_source, text_target, prediction``: targets without every fifth token."""
    kept = F.filter(tokens_ws(F.col("text_target")), lambda _, i: i % 5 != 4)
    return pairs(spark, sf_dir).withColumn("prediction", F.array_join(kept, " "))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Corpus (every row) and queries (those whose id is divisible by 50) of the ``embeddings`` table."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows, rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
