"""One query for each operator of the library over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.functions import arrays, prompts, responses, text
from paralex.operators import books, checkpoints, dense, metrics, models, retrieval, splits
from paralex.plans import flows
from paralex.session import fresh_path, written
from paralex.sources import adapters, layout, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Languages named in prompts.
SRC, TGT = "Indonesian", "Bambam"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "documents").select("doc_id", "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "benchmark").select("item_id", "text")


def r6(name: str):
    return F.round(name, 6).alias(name)


# --- sources, projections


@query
def scan_parallel(spark, sf_dir):
    m = readers.of_languages(adapters.multi_translation(spark, sf_dir), "src", "tgt")
    return m.select(
        F.col("ref")[0].alias("ref0"), F.col("translation.language")[0].alias("lang0"), F.col("translation.language")[1].alias("lang1"),
        F.col("translation.translation")[0].alias("text0"), F.col("translation.translation")[1].alias("text1"),
    )


@query
def scan_tagged(spark, sf_dir):
    p = adapters.pairs(spark, sf_dir).withColumn("pair", F.when(F.col("turn") % 4 == 0, "src-tgt").otherwise("tgt-src"))
    return readers.of_pair(p, "src", "tgt").select("verse_id", "text_source", "text_target")


@query
def union_splits(spark, sf_dir):
    p = adapters.pairs(spark, sf_dir).select("verse_id", (F.col("conv_id") % 3).alias("part"))
    return readers.union_splits([p.filter(F.col("part") == i) for i in (0, 1, 2)])


@query
def select_split(spark, sf_dir):
    return splits.select_split(splits.assign_splits(adapters.pairs(spark, sf_dir)), "validation").select("verse_id", "split")


@query
def extract_pair(spark, sf_dir):
    return books.extract_pair(adapters.multi_translation(spark, sf_dir)).select("conv_id", "turn", "text_source", "text_target")


@query
def ref_to_book(spark, sf_dir):
    return books.with_reference(adapters.multi_translation(spark, sf_dir)).select("verse_id", "book")


@query
def verse_to_book(spark, sf_dir):
    return books.with_book(adapters.pairs(spark, sf_dir)).select("verse_id", "book")


@query
def select_columns(spark, sf_dir):
    return adapters.pairs(spark, sf_dir).select("text_source", "text_target")


@query
def map_replace_columns(spark, sf_dir):
    return flows.chat_texts(adapters.pairs(spark, sf_dir), SRC, TGT, training=True)


@query
def rename_target(spark, sf_dir):
    return adapters.predictions(spark, sf_dir).withColumn("target", F.col("text_target")).select("verse_id", "prediction", "target")


# --- filters


@query
def filter_in_books(spark, sf_dir):
    return books.in_books(books.with_book(adapters.pairs(spark, sf_dir))).select("verse_id", "book")


@query
def filter_not_in_books(spark, sf_dir):
    return books.not_in_books(books.with_book(adapters.pairs(spark, sf_dir))).select("verse_id", "book")


@query
def filter_book(spark, sf_dir):
    return books.of_book(books.with_book(adapters.pairs(spark, sf_dir)), "ROM").select("verse_id", "book")


@query
def filter_book_optional(spark, sf_dir):
    booked = books.with_book(adapters.pairs(spark, sf_dir))
    counts = [books.of_book(booked, b).agg(F.lit(str(b)).alias("given"), F.count("*").alias("n")) for b in (None, "", "MRK")]
    return readers.union_splits(counts)


@query
def filter_laid_out(spark, sf_dir):
    path = fresh_path(spark, "layout")
    schema = layout.lay_out(splits.assign_splits(adapters.pairs(spark, sf_dir)).select("verse_id", "text_source", "split", "book"), path)
    return layout.read_laid_out(spark, path, schema, "train", "ROM").select("verse_id", "text_source", "split", "book")


@query
def dispatch_model(spark, sf_dir):
    name = F.element_at(F.array(F.lit("gemini-x"), F.lit("gpt-x"), F.lit("gpt-gemini-x")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", name.alias("model")).withColumn("provider", models.provider(F.col("model")))


@query
def missing_tokens(spark, sf_dir):
    wanted = spark.createDataFrame([(t,) for t in ("the", "of", "ind_Latn", "ptu_Latn", "und")], "token string")
    known = docs(spark, sf_dir).select(F.explode(text.tokens_ws(F.col("text"))).alias("token"))
    return models.missing_tokens(wanted, known)


# --- splits


@query
def train_val_split(spark, sf_dir):
    pool = books.in_books(books.with_book(adapters.pairs(spark, sf_dir)))
    return splits.train_validation(pool).select("verse_id", "split")


@query
def assign_splits(spark, sf_dir):
    return splits.assign_splits(adapters.pairs(spark, sf_dir)).select("verse_id", "book", "split")


@query
def split_counts(spark, sf_dir):
    return splits.split_counts(splits.assign_splits(adapters.pairs(spark, sf_dir)))


# --- statistics


@query
def tfidf_idf(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return retrieval.tfidf_idf(rows, text.tokens_words(F.col("text")), rows.count()).select("term", "df", r6("idf"))


@query
def tfidf_weights(spark, sf_dir):
    rows, tokens = docs(spark, sf_dir), text.tokens_words(F.col("text"))
    idf = written(retrieval.tfidf_idf(rows, tokens, rows.count()))
    listed = rows.select("doc_id", F.explode(F.array_distinct(tokens)).alias("term"))
    return retrieval.tfidf_weights(retrieval.postings(rows, "doc_id", tokens), idf, "doc_id", listed).select("doc_id", "term", r6("weight"))


@query
def bm25_idf(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return retrieval.bm25_idf(rows, text.tokens_ws(F.col("text")), rows.count()).select("term", "df", r6("idf"))


@query
def bm25_corpus_stats(spark, sf_dir):
    return retrieval.bm25_stats(docs(spark, sf_dir)).select("n_docs", "n_tokens", r6("avgdl"), "vocabulary", r6("avg_idf"))


@query
def mean_embedding(spark, sf_dir):
    return arrays.mean_vector(adapters.table(spark, sf_dir, "embeddings"), "embedding").select("pos", r6("mean"))


@query
def init_new_embeddings(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fresh = spark.createDataFrame([(-1,), (-2,)], "vec_id long")
    return arrays.with_new_vectors(rows, fresh, "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", "pos", r6("value")
    )


def _daily(spark, sf_dir):
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return adapters.table(spark, sf_dir, "events").groupBy(day.alias("step")).agg(F.round(F.avg("value"), 6).alias("metric"))


@query
def best_checkpoint(spark, sf_dir):
    return checkpoints.best_checkpoint(_daily(spark, sf_dir))


@query
def early_stop_step(spark, sf_dir):
    return checkpoints.early_stop(_daily(spark, sf_dir), 3)


# --- retrieval


@query
def topk_tfidf(spark, sf_dir):
    return retrieval.top_k_tfidf(docs(spark, sf_dir), items(spark, sf_dir), 5)


@query
def topk_bm25(spark, sf_dir):
    return retrieval.top_k_bm25(docs(spark, sf_dir), items(spark, sf_dir), 5)


@query
def topk_dense(spark, sf_dir):
    corpus, queries = adapters.vectors(spark, sf_dir)
    # A query's own row is a candidate like all others; one more is found and it is left out.
    found = dense.top_k_dense(corpus, queries, 6, "vec_id", "query_id").filter("vec_id <> query_id")
    return retrieval.first_k(found, "query_id", "vec_id", 5)


@query
def dot_product(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "embeddings")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id").select("vec_id", F.round(arrays.dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


# --- prompts


def _train_test(spark, sf_dir):
    rows = written(splits.assign_splits(adapters.pairs(spark, sf_dir)).select("verse_id", "text_source", "text_target", "split"))
    return splits.select_split(rows, "train"), splits.select_split(rows, "test")


@query
def fewshot_prompts(spark, sf_dir):
    return flows.few_shot_prompts(*_train_test(spark, sf_dir)).select("verse_id", "prompt")


@query
def zero_shot_prompts(spark, sf_dir):
    prompt = prompts.few_shot_prompt(F.col("text_source"), None, SRC, TGT)
    return adapters.pairs(spark, sf_dir).select("verse_id", prompt.alias("prompt"))


@query
def sft_prompt(spark, sf_dir):
    return adapters.pairs(spark, sf_dir).select("verse_id", prompts.sft_prompt(F.col("text_source"), SRC, TGT).alias("prompt"))


@query
def sft_conversation(spark, sf_dir):
    messages = prompts.conversation(prompts.sft_prompt(F.col("text_source"), SRC, TGT), F.col("text_target"))
    rows = adapters.pairs(spark, sf_dir).select("verse_id", F.posexplode(messages).alias("pos", "m"))
    return rows.select("verse_id", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@query
def chat_render(spark, sf_dir):
    return flows.chat_texts(adapters.pairs(spark, sf_dir), SRC, TGT, training=False).select("verse_id", "text")


# --- responses


def _answers(spark, sf_dir):
    good = F.to_json(F.struct(F.col("text_target").alias("translation")))
    kinds = [
        good, F.concat(good, F.lit(" indeed")), F.lit("{'translation': 'x'}"), F.lit('{"translation": null}'), F.lit('{"translation": 5}'),
        F.lit('{"other": "x"}'), F.concat(F.lit("```json\n"), good, F.lit("\n```")), F.expr("substring(text_target, 1, 20)"), F.lit(""),
        F.lit('["translation"]'), F.lit('{"translation": "cut'),
    ]
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(kinds)))
    answer = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        answer = F.when(n == i, kind).otherwise(answer)
    return adapters.pairs(spark, sf_dir).select("verse_id", answer.alias("answer"))


@query
def parse_json_translation(spark, sf_dir):
    return _answers(spark, sf_dir).select("verse_id", responses.json_field(F.col("answer")).alias("translation"))


@query
def strip_think(spark, sf_dir):
    n = F.pmod(F.col("conv_id"), F.lit(3))
    raw = F.when(n == 0, F.col("prediction")).when(n == 1, F.concat(F.lit("<think>a</think>\n "), "prediction"))
    raw = raw.otherwise(F.concat(F.lit("x</think>y</think>"), "prediction", F.lit(" \n")))
    return adapters.predictions(spark, sf_dir).select("verse_id", responses.after_thinking(raw).alias("answer"))


@query
def strip_text(spark, sf_dir):
    padded = F.concat(F.lit("\n  "), "prediction", F.lit(" \t　\r\n"))
    return adapters.predictions(spark, sf_dir).select("verse_id", text.strip(padded).alias("text"))


# --- text and arrays


@query
def tokenize_ws(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(text.tokens_ws(F.col("text"))).alias("pos", "token"))


@query
def tokenize_tfidf(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(text.tokens_words(F.col("text"))).alias("pos", "token"))


@query
def word_ngrams(spark, sf_dir):
    tokens = text.tokens_13a(F.col("text_target"))
    p = adapters.pairs(spark, sf_dir).select(tokens.alias("t"))
    each = [p.select(F.lit(n).alias("n"), F.explode(text.word_grams(F.col("t"), n)).alias("gram")) for n in range(1, 5)]
    return readers.union_splits(each).groupBy("n", "gram").agg(F.count("*").alias("count"))


@query
def char_ngrams(spark, sf_dir):
    p = adapters.pairs(spark, sf_dir).select(text.without_space(F.col("text_target")).alias("t"))
    # Different windows are far fewer than places, so shorter grams are counted from those.
    windows = p.select(F.explode(text.char_windows(F.col("t"), 6)).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    each = windows.select("w", "c", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("n"))
    return each.groupBy("n", F.expr("substring(w, 1, n)").alias("gram")).agg(F.sum("c").alias("count"))


def _ids(column: str):
    """Stand-in ids: token lengths, every third one the sentinel."""
    return F.transform(text.tokens_ws(F.col(column)), lambda x, i: F.when(i % 3 == 2, F.lit(arrays.SENTINEL)).otherwise(F.length(x)))


def _listed(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


@query
def mask_sentinel(spark, sf_dir):
    return adapters.pairs(spark, sf_dir).select("verse_id", _listed(arrays.mask_sentinel(_ids("text_target"), 1)).alias("ids"))


@query
def truncate_pad(spark, sf_dir):
    return adapters.pairs(spark, sf_dir).select("verse_id", _listed(arrays.truncate_pad(_ids("text_target"), 24, 1)).alias("ids"))


def _token_id(token):
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 12), 16, 10).cast("long")


@query
def decode_tokens(spark, sf_dir):
    p = adapters.pairs(spark, sf_dir)
    tokens = text.tokens_ws(F.col("text_source"))
    vocabulary = p.select(F.explode(tokens).alias("token")).distinct().select(_token_id(F.col("token")).alias("token_id"), "token")
    encoded = p.select("verse_id", F.concat(F.array(F.lit(0).cast("long")), F.transform(tokens, _token_id), F.array(F.lit(2).cast("long"))).alias("ids"))
    return arrays.decode_tokens(encoded, vocabulary, "verse_id", special_ids=(0, 2))


# --- metrics, sinks, flows


@query
def corpus_bleu(spark, sf_dir):
    return metrics.corpus_bleu(adapters.predictions(spark, sf_dir), target="text_target")


@query
def corpus_chrf(spark, sf_dir):
    return metrics.corpus_chrf(adapters.predictions(spark, sf_dir), target="text_target")


def _records(spark, sf_dir):
    return adapters.predictions(spark, sf_dir).select("verse_id", "prediction", F.col("text_target").alias("target"))


@query
def eval_report(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return sinks.report_rows(metrics.evaluate(rows), rows)


@query
def metrics_json(spark, sf_dir):
    return sinks.metrics_json(metrics.evaluate(_records(spark, sf_dir)))


@query
def sink_csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "csv")
    rows = adapters.predictions(spark, sf_dir)
    n = F.pmod(F.col("conv_id"), F.lit(5))
    hard = F.when(n == 0, F.concat(F.lit(' "a",\n'), "prediction")).when(n == 1, "").when(n == 2, F.concat("prediction", F.lit("  ")))
    hard = hard.when(n == 3, F.col("prediction"))  # else null
    sinks.write_csv(rows.select("text_source", "text_target", hard.alias("prediction")), path)
    return sinks.read_csv(spark, path, "text_source string, text_target string, prediction string")


@query
def fewshot_end_to_end(spark, sf_dir):
    rows, scores = flows.few_shot(*_train_test(spark, sf_dir))
    return sinks.report_rows(scores.drop("failed"), rows.agg(F.count("*").alias("n")))


@query
def evaluate_by_book(spark, sf_dir):
    rows = books.not_in_books(books.with_book(adapters.predictions(spark, sf_dir)))
    return metrics.evaluate(rows, ["book"], target="text_target")
