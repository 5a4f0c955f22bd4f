"""Reading the two kinds of parallel corpora, from Parquet or JSON lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex import schemas
from paralex.operators import books, splits


def read(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)


def of_languages(df: DataFrame, src: str, tgt: str) -> DataFrame:
    """Multi-translation rows that hold both languages."""
    langs = F.col("translation.language")
    return df.filter(F.array_contains(langs, src) & F.array_contains(langs, tgt))


def of_pair(df: DataFrame, src: str, tgt: str) -> DataFrame:
    """Tagged verses of one ordered pair; ``pair`` as a partition column prunes files."""
    return df.filter(F.col("pair") == f"{src}-{tgt}").drop("pair")


def union_splits(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; nothing is dropped as a repetition."""
    return reduce(DataFrame.unionByName, parts)


def load_multi_translation(spark: SparkSession, path: str, src: str, tgt: str, by_language: bool = False) -> DataFrame:
    """``split, verse_id, book, text_source, text_target``; splits are folders named
    ``split=...`` below ``path``.

    Texts are taken by position; ``by_language`` looks the codes up instead.
    """
    rows = of_languages(spark.read.parquet(path), src, tgt)
    pair = books.extract_pair(rows, *((src, tgt) if by_language else (None, None)))
    return books.with_reference(pair).select("split", "verse_id", "book", "text_source", "text_target")


def load_tagged(spark: SparkSession, path: str, src: str, tgt: str) -> DataFrame:
    """As above for tagged verses, below ``pair=src-tgt``; splits are derived from books."""
    rows = of_pair(spark.read.parquet(path), src, tgt)
    names = [f.name for f in schemas.TAGGED_VERSE.fields]
    return splits.assign_splits(rows.select(*names)).select("split", "verse_id", "book", "text_source", "text_target")


#: Loader of each corpus kind, by the last part of a data set's name.
LOADERS: dict[str, Callable[..., DataFrame]] = {"multi-translation": load_multi_translation, "tagged-verse": load_tagged}


def load(spark: SparkSession, name: str | None, path: str, src: str, tgt: str) -> DataFrame:
    """Dispatch by name, a leading organisation ignored; an unknown name is an error."""
    short = (name or "").split("/")[-1]
    if short not in LOADERS:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(LOADERS)}")
    return LOADERS[short](spark, path, src, tgt)
