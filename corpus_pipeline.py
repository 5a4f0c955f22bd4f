"""A training corpus from ``documents``: good ones, of known language, one of each
group of near duplicates (five-word shingles, similarity 0.8 or more), packed into sequences.

Each stage works on all that the one before kept.  The first three return the
columns of ``documents``, whatever others there are and whatever their names; the
last returns the pieces with their token ids, as the sequences hold them.

Defined results: an empty table stays empty; a null or empty text has the quality of
the average learned text and no language, so it goes at the second stage; rows that
are equal in everything are near duplicates, of which one stays; a null id is kept
like any other and comes last where one of a group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paralex.llm import langid, packing, quality, simhash
from paralex.llm.common import durable, table
from paralex.session import clear_written, scope


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier (operator 6) doesn't reject.

    It learns from ``labels``; without any, or with one class only, every document has
    the same score, 0.5 or that class, and is kept or goes with all others.  Texts that
    are null or without words have the learned share of good ones.  Ties don't occur: the
    score alone decides.  Repeated rows are all kept or all go.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told without ambiguity (operator 7).

    Texts that are null, empty or without letters go, and so do those whose two nearest
    codewords are too close; with no language to learn from all go.  Repeated rows are
    all kept or all go.
    """
    return langid.keep_known(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id (null last) of each group of near duplicates (operator 5).

    Texts without words, null ones among them, are one group.  Of rows that share the id,
    that of the smallest hash stays, and one of rows equal in everything.
    """
    return simhash.one_of_similar(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in whole sequences (operator 2).

    Null and empty texts are the end id alone; repeated rows are packed each.  The encoder
    remembers few matches, since executors hold what earlier stages have grown to.
    """
    return packing.in_sequences(packing.pack_documents(docs, narrow=True, words=1 << 18))


STAGES = [
    ("quality classifier", good),
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("packing", packed),
]

#: The classifiers are learned, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again.

    What a stage has written for itself is deleted once its result stands.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scope() as made:
            docs = durable(stage(spark, docs, sf_dir))
        clear_written(spark, made, keep=docs)
    return docs
