"""Command line: ``python -m paralex.cli fewshot|evaluate|sft-evaluate|translation|sft-translation ...``.

Training itself is out of scope: ``translation`` and ``sft-translation`` write the splits
that a trainer reads, and score predictions of the test split where there are any.  Local
models come from ``--model_factory module:callable``, which is called with the decoding
options once a task.
"""

from __future__ import annotations

import importlib
from argparse import ArgumentParser, Namespace
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.functions.responses import after_thinking
from paralex.operators import models, splits
from paralex.plans import flows
from paralex.session import build_session, written
from paralex.sources import readers, sinks

#: Options of each flow with their defaults; the model's name and the target language come first.
FLOWS = {
    "fewshot": ("gemini-2.0-flash", "ptu"),
    "evaluate": ("model", "btx"),
    "sft-evaluate": ("model", "btx"),
    "translation": ("model", "ptu"),
    "sft-translation": ("model", "ptu"),
}


def arguments(given: list[str] | None = None) -> Namespace:
    parser = ArgumentParser(prog="paralex")
    subs = parser.add_subparsers(dest="flow", required=True)
    for name, (model, tgt) in FLOWS.items():
        p = subs.add_parser(name)
        p.add_argument("--dataset", "--dataset_name", dest="dataset", required=True, help=f"name that ends in {' or '.join(sorted(readers.LOADERS))}")
        p.add_argument("--path", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--model", "--model_name", dest="model", default=model)
        p.add_argument("--src_lang", default="ind")
        p.add_argument("--tgt_lang", default=tgt)
        p.add_argument("--src_lang_name", default="Indonesian")
        p.add_argument("--tgt_lang_name", default="Bambam")
        if name == "fewshot":
            p.add_argument("--vectorizer", default="bm25", choices=("bm25", "tfidf", "dense"))
            p.add_argument("--num_few_shot", type=int, default=5)
            p.add_argument("--num_workers", type=int, default=8)
            p.add_argument("--retries", type=int, default=2)
            p.add_argument("--wait", type=float, default=1.0, help="seconds before a failed call is tried again")
            p.add_argument("--ledger", default=None, help="folder that keeps answers between runs")
            p.add_argument("--strict", action="store_true", help="end with an error if a call failed, after all is written")
            p.add_argument("--base_url", default=None, help="another place that speaks the chat completion protocol")
            p.add_argument("--encoder", default=None, help="module:callable that makes the dense retriever's encoder")
            continue
        p.add_argument("--predictions", default=None, help="CSV of verse_id, prediction")
        p.add_argument("--model_factory", default=None, help="module:callable that makes a batch translator of decoding options")
        p.add_argument("--max_length", type=int, default=128)
        p.add_argument("--num_beams", type=int, default=8)
        p.add_argument("--per_device_eval_batch_size", type=int, default=16)
        if name.startswith("sft"):
            p.add_argument("--temperature", type=float, default=0.7)
            p.add_argument("--top_p", type=float, default=0.8)
            p.add_argument("--top_k", type=int, default=20)
        if name.endswith("evaluate"):
            p.add_argument("--split", "--dataset_split_name", dest="split", default="test")
            p.add_argument("--book", "--book_name", dest="book", default=None)
    return parser.parse_args(given)


def named(place: str) -> Callable:
    """The callable of ``module:name``."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def decoding(args: Namespace) -> models.Decoding:
    """Chat models sample, others search beams."""
    size = args.per_device_eval_batch_size
    if args.flow.startswith("sft"):
        return models.Decoding(args.max_length, 1, True, args.temperature, args.top_k, args.top_p, size)
    return models.Decoding(args.max_length, args.num_beams, batch_size=size)


def predicted(spark: SparkSession, args: Namespace, rows: DataFrame, make=None) -> DataFrame | None:
    """``rows`` with ``prediction``, from a file or a model; None where neither is given."""
    chat = args.flow.startswith("sft")
    if args.predictions:
        found = sinks.read_csv(spark, args.predictions, "verse_id string, prediction string")
        return rows.join(found.withColumn("prediction", after_thinking(F.col("prediction"))), "verse_id")
    make = make or (named(args.model_factory) if args.model_factory else None)
    return flows.answered(rows, make, decoding(args), args.src_lang_name, args.tgt_lang_name, chat) if make else None


def few_shot(spark: SparkSession, args: Namespace, make=None) -> DataFrame:
    rows = readers.load(spark, args.dataset, args.path, args.src_lang, args.tgt_lang)
    make = make or models.translator(args.model, args.base_url)
    encoder = named(args.encoder) if args.encoder else models.HashEncoder if args.vectorizer == "dense" and "embedding" not in rows.columns else None
    ledger = models.Ledger(spark, args.ledger, args.model) if args.ledger else None
    options = flows.FewShotOptions(args.src_lang_name, args.tgt_lang_name, args.vectorizer, args.num_few_shot, args.num_workers, encoder, args.retries, args.wait, ledger)
    found, metrics = flows.few_shot(splits.select_split(rows, "train"), splits.select_split(rows, "test"), make, options)
    run = f"{args.output}/{sinks.output_name(args.model)}"
    sinks.write_csv(found.select("text_source", "text_target", "prediction"), f"{run}/{args.src_lang}_{args.tgt_lang}_{args.vectorizer}_predictions.csv")
    metrics = written(metrics)
    sinks.write_json(metrics, None, f"{run}/results.json")
    failed = metrics.first()["failed"]
    if failed:
        sinks.write_csv(found.filter("error is not null").select("verse_id", "error"), f"{run}/{args.src_lang}_{args.tgt_lang}_{args.vectorizer}_errors.csv")
        if args.strict:
            raise SystemExit(f"{failed} calls failed")
    return metrics


def evaluate(spark: SparkSession, args: Namespace, make=None) -> DataFrame:
    rows = readers.load(spark, args.dataset, args.path, args.src_lang, args.tgt_lang)
    chosen = flows.chosen(rows, args.split, args.book)
    answered = predicted(spark, args, chosen, make)
    if answered is None:
        raise SystemExit("give --predictions or --model_factory")
    records, metrics = flows.evaluate_corpus(answered, args.split, args.book)
    sinks.write_json(metrics, records, f"{args.output}/{sinks.output_name(args.model)}/results.json")
    return metrics


def prepare(spark: SparkSession, args: Namespace, make=None) -> DataFrame | None:
    """Training texts by split, and metrics of the test split (named ``test_...``) if it has predictions."""
    rows = readers.load(spark, args.dataset, args.path, args.src_lang, args.tgt_lang)
    run = f"{args.output}/{sinks.output_name(args.model, args.dataset, args.src_lang, args.tgt_lang)}"
    for split in ("train", "validation", "test"):
        part = splits.select_split(rows, split)
        if args.flow == "sft-translation":
            part = flows.chat_texts(part, args.src_lang_name, args.tgt_lang_name, training=True)
        else:
            part = part.select("text_source", "text_target")
        part.write.mode("overwrite").parquet(f"{run}/{split}")
    answered = predicted(spark, args, splits.select_split(rows, "test"), make)
    if answered is None:
        return None
    _, metrics = flows.evaluate_corpus(answered, "test")
    sinks.write_json(metrics, None, f"{run}/results.json", "test_")
    return metrics


def main(given: list[str] | None = None, make=None) -> None:
    """``make`` builds the model instead of what the options name."""
    args = arguments(given)
    spark = build_session()
    run = few_shot if args.flow == "fewshot" else evaluate if args.flow.endswith("evaluate") else prepare
    metrics = run(spark, args, make)
    if metrics is not None:
        metrics.show()


if __name__ == "__main__":
    main()
