"""Books: keys from references and verses, and membership filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paralex.functions.text import first_part, tokens_ws

#: Codes of the training pool.
NT_BOOKS = (
    "MAT", "MRK", "LUK", "JHN", "ACT", "ROM", "1CO", "2CO", "GAL", "EPH", "PHP", "COL", "1TH", "2TH",
    "1TI", "2TI", "TIT", "PHM", "HEB", "JAB", "1PE", "2PE", "1JN", "2JN", "3JN", "JUD", "REV",
)


def extract_pair(df: DataFrame, src: str | None = None, tgt: str | None = None) -> DataFrame:
    """``text_source`` and ``text_target`` of a multi-translation row: the first two
    texts, or those of two languages if both are named."""
    texts, langs = F.col("translation.translation"), F.col("translation.language")

    def of(position: int, lang: str | None) -> Column:
        if lang is None:
            return F.get(texts, F.lit(position))
        return F.try_element_at(texts, F.nullif(F.array_position(langs, lang), F.lit(0)).cast("int"))

    both = src is not None and tgt is not None
    return df.withColumn("text_source", of(0, src if both else None)).withColumn("text_target", of(1, tgt if both else None))


def with_reference(df: DataFrame) -> DataFrame:
    """``verse_id`` and ``book`` from the first reference."""
    first = F.get(F.col("ref"), F.lit(0))
    return df.withColumn("verse_id", first).withColumn("book", F.get(tokens_ws(first), F.lit(0)))


def with_book(df: DataFrame) -> DataFrame:
    """``book``: the verse id up to its first underscore."""
    return df.withColumn("book", first_part(F.col("verse_id"), "_"))


def is_training_book(book: Column) -> Column:
    """Never null: a book that is null or unknown is not one."""
    return F.coalesce(book.isin(*NT_BOOKS), F.lit(False))


def in_books(df: DataFrame) -> DataFrame:
    return df.filter(is_training_book(F.col("book")))


def not_in_books(df: DataFrame) -> DataFrame:
    return df.filter(~is_training_book(F.col("book")))


def of_book(df: DataFrame, book: str | None) -> DataFrame:
    """Rows of one book; none or an empty name keeps all."""
    return df.filter(F.col("book") == book) if book else df
