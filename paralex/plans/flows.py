"""Whole flows: few-shot prompting, and evaluation of predictions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.functions import prompts, responses
from paralex.operators import books, dense, metrics, models, retrieval, splits
from paralex.session import written

RETRIEVERS = {"bm25": retrieval.top_k_bm25, "tfidf": retrieval.top_k_tfidf}


@dataclass(frozen=True)
class FewShotOptions:
    src_name: str = "Indonesian"
    tgt_name: str = "Bambam"
    vectorizer: str = "bm25"
    num_few_shot: int = 5
    num_workers: int = 8
    #: Makes the encoder of the dense retriever, once a task; without one, both sides need a column ``embedding``.
    encoder: Callable[[], models.Encoder] | None = None
    retries: int = 2
    #: Seconds before the second try of a call that failed; later ones wait twice as long each, or as the server says.
    wait: float = 1.0
    #: Keeps answers between runs.
    ledger: models.Ledger | None = None


def few_shot_prompts(train: DataFrame, test: DataFrame, options: FewShotOptions = FewShotOptions(), key: str = "verse_id") -> DataFrame:
    """``test`` with ``prompt``: each row's nearest training pairs as examples.

    ``vectorizer`` "dense" encodes the source texts of both sides, once each.
    """
    if options.vectorizer == "dense" and options.encoder:
        train, test = (written(models.encode(rows, options.encoder)) for rows in (train, test))
    corpus = train.withColumnRenamed(key, "_doc")
    if options.vectorizer == "dense":
        ranked = dense.top_k_dense(corpus, test, options.num_few_shot, "_doc", key)
    else:
        find = RETRIEVERS[options.vectorizer]
        ranked = find(corpus, test, options.num_few_shot, "_doc", key, "text_source", "text_source")
    examples = retrieval.examples_of(ranked, corpus, key, "_doc")
    prompt = prompts.few_shot_prompt(F.col("text_source"), F.col("examples"), options.src_name, options.tgt_name)
    return test.join(examples, key, "left").withColumn("prompt", prompt).drop("examples")


def few_shot(
    train: DataFrame, test: DataFrame, make: Callable[[], models.Translator] = models.EchoTranslator,
    options: FewShotOptions = FewShotOptions(), key: str = "verse_id",
) -> tuple[DataFrame, DataFrame]:
    """Predictions (``text_source, text_target, prediction, error`` with the key) and metrics.

    Answers are written before they are scored, so no call is made twice.  A row whose calls
    failed has its error and an empty prediction; ``failed`` in the metrics counts these.
    """
    asked = few_shot_prompts(train, test, options, key)
    answered = written(models.generate(asked, make, "prompt", options.num_workers, options.retries, options.wait, options.ledger))
    rows = answered.select(key, "text_source", "text_target", responses.json_field(F.col("response")).alias("prediction"), "error")
    return rows, with_failures(metrics.evaluate(rows, target="text_target"), rows)


def with_failures(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """``scores`` (one row) with ``failed``, the number of ``rows`` that have an error."""
    return scores.join(rows.agg(F.count("error").alias("failed")), F.lit(True))


def answered(rows: DataFrame, make: Callable[[models.Decoding], models.BatchTranslator], decoding: models.Decoding, src: str, tgt: str, chat: bool) -> DataFrame:
    """``rows`` with ``prediction`` of a local model, asked in batches.

    A chat model is asked with the rendered question and answers after its thoughts; any
    other gets the source text alone.  An answer that failed is the empty string.
    """
    asked = chat_texts(rows, src, tgt, training=False) if chat else rows.withColumn("text", F.col("text_source"))
    done = written(models.generate_batches(asked, make, "text", decoding))
    answer = responses.after_thinking(F.col("response")) if chat else F.col("response")
    return done.withColumn("prediction", F.coalesce(answer, F.lit(""))).select(*rows.columns, "prediction")


def chosen(rows: DataFrame, split: str, book: str | None = None) -> DataFrame:
    """A split, or a book of it."""
    return books.of_book(splits.select_split(rows, split), book)


def evaluate_corpus(rows: DataFrame, split: str = "test", book: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records (``verse_id, prediction, target``) of a split, or a book of it, and their metrics."""
    records = chosen(rows, split, book).select("verse_id", "prediction", F.col("text_target").alias("target"))
    return records, metrics.evaluate(records)


def chat_texts(rows: DataFrame, src: str, tgt: str, training: bool) -> DataFrame:
    """``text``: the rendered conversation.  Training has the answer and drops all
    other columns; evaluation has the question alone and keeps them."""
    question = prompts.sft_prompt(F.col("text_source"), src, tgt)
    messages = prompts.conversation(question, F.col("text_target") if training else None)
    text = prompts.render_chat(messages, generation_prompt=not training).alias("text")
    return rows.select(text) if training else rows.select("*", text)
