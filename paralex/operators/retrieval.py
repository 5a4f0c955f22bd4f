"""Top-k retrieval by TF-IDF cosine and BM25 (``dense`` has vectors).

Lexical scores are weights of a query's terms times impacts of a document's.  Texts are counted
for one call, whose sums are made tile by tile (``tiles``), or once and for all in an ``index``,
where bounds decide which sums are made (``pruning``).  A document that shares no term has score
0 and still competes.  Ranks use scores rounded to six digits, then the larger document key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paralex.functions.text import tokens_words, tokens_ws
from paralex.operators import index, pruning, tiles
from paralex.session import written

#: Fixed values of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6
#: Most rows of a table of terms that is broadcast, (query, term) and (term, idf); larger
#: ones are joined through a shuffle.
BLOCK_TERMS, BROADCAST_TERMS = 500_000, 1_000_000
#: Documents of largest key that are offered to a query beside the k it needs.
SPARE = 100


def counted(texts: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, dl`` and an array ``_t`` of tokens, dealt by ``key``: what is grouped by key
    and more after this isn't shuffled again."""
    return texts.select(key, tokens.alias("_t")).withColumn("dl", F.size("_t").cast("long")).repartition(key)


def postings(texts: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, term, tf, dl`` of each document and term (``dl``: its tokens), dealt by ``key``."""
    listed = counted(texts, key, tokens)
    return listed.select(key, "dl", F.explode("_t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def frequencies(texts: DataFrame, tokens: Column) -> DataFrame:
    """``term, df``: documents that hold each term; counts are summed up before they move."""
    return texts.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def frequencies_and_size(texts: DataFrame, tokens: Column) -> tuple[DataFrame, int, int]:
    """``term, df`` (written), and the numbers of documents and of tokens, from one pass.

    The null term stands for the documents themselves, and none of theirs is null.
    """
    listed = texts.select(tokens.alias("_t")).select(F.size("_t").alias("_n"), F.explode(F.concat(F.array_distinct("_t"), F.array(F.lit(None).cast("string")))).alias("term"))
    own = F.sum(F.when(F.col("term").isNull(), F.col("_n").cast("long")))
    every = written(listed.groupBy("term").agg(F.count("*").alias("df"), own.alias("tokens")))
    row = every.filter("term is null").first()
    n, total = (row["df"], row["tokens"] or 0) if row else (0, 0)
    return every.filter("term is not null").select("term", "df"), n, total


# --- TF-IDF


def tfidf_idf(texts: DataFrame, tokens: Column, n_docs: int) -> DataFrame:
    """``term, df, idf`` with smoothed counts."""
    return with_smooth_idf(frequencies(texts, tokens), n_docs)


def with_smooth_idf(found: DataFrame, n_docs: int) -> DataFrame:
    return found.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def split_idf(idf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term, idf`` of the most frequent terms, BROADCAST_TERMS at most, and of the others.

    The driver gets the different values only, of which there are as many as different
    frequencies.  The others have few postings, each of them fewer than any frequent one.
    """
    idf = idf.select("term", "idf")
    left, bar = BROADCAST_TERMS, None
    for value, n in sorted(tuple(r) for r in idf.groupBy("idf").count().collect()):
        left -= n
        if left < 0:
            break
        bar = value
    few = F.lit(False) if bar is None else F.col("idf") <= bar
    return idf.filter(few), idf.filter(~few)


def with_idf(posts: DataFrame, idf: DataFrame, key: str, listed: DataFrame | None = None) -> DataFrame:
    """``posts`` with ``idf`` (of a written table, one row a term).

    A vocabulary of checked size is broadcast.  Of a larger one the frequent terms are, and
    the few postings of the others meet it by term and come back by key, so that all
    postings stay dealt by key.  ``listed`` has ``key, term`` of the same postings before
    they were dealt, so that these aren't dealt a second time.
    """
    if idf.count() <= BROADCAST_TERMS:
        return posts.join(F.broadcast(idf.select("term", "idf")), "term")
    near, rest = split_idf(idf)
    far = (posts if listed is None else listed).select(key, "term").join(F.broadcast(near), "term", "left_anti").join(rest, "term")
    far = far.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("term", "idf"))).alias("_far"))
    both = posts.join(F.broadcast(near), "term", "left").join(far.hint("shuffle_hash"), key, "left")
    return both.withColumn("idf", F.coalesce("idf", F.col("_far")[F.col("term")])).drop("_far")


def tfidf_weights(posts: DataFrame, idf: DataFrame, key: str, listed: DataFrame | None = None) -> DataFrame:
    """``key, term, weight``; the weights of a document have norm one.

    ``posts`` are dealt by ``key``, so the norm is found where they are.
    """
    raw = with_idf(posts, idf, key, listed).withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_w") / norm).alias("weight"))


# --- BM25


def bm25_raw(found: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, raw`` of ``term, df``."""
    df = F.col("df").cast("double")
    return found.withColumn("raw", F.log(n_docs - df + 0.5) - F.log(df + 0.5))


def _floored(raw: DataFrame) -> DataFrame:
    """``term, df, idf`` of a written table; negative ones become a share of the mean over all terms."""
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw"))
    return raw.select("term", "df", idf.alias("idf"))


def bm25_idf(texts: DataFrame, tokens: Column, n_docs: int) -> DataFrame:
    """``term, df, idf``; negative ones become a share of the mean over all terms."""
    return _floored(bm25_raw(written(frequencies(texts, tokens)), n_docs))


def bm25_stats(texts: DataFrame, tokens: Column | None = None) -> DataFrame:
    """One row: ``n_docs, n_tokens, avgdl, vocabulary, avg_idf``."""
    found, n, total = frequencies_and_size(texts, tokens_ws(F.col("text")) if tokens is None else tokens)
    return bm25_raw(found, n).agg(
        F.lit(n).cast("long").alias("n_docs"),
        F.lit(total).cast("long").alias("n_tokens"),
        F.lit(total / max(n, 1)).alias("avgdl"),
        F.count("*").alias("vocabulary"),
        F.avg("raw").alias("avg_idf"),
    )


# --- ranking


def first_k(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The first k of each query; a task sends on no more than k rows a query."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.desc(key))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(query, "rank", key, "score")


def _scores(posts: DataFrame, asked: DataFrame, query: str, key: str) -> DataFrame:
    """``query, key, score`` of ``posts`` (``key, term, impact``) and ``asked`` (``query, term, times``)."""
    few = asked.count() <= BLOCK_TERMS
    parts = posts.join(F.broadcast(asked) if few else asked, "term").select(key, query, (F.col("impact") * F.col("times")).alias("_part"))
    return parts.groupBy(key, query).agg(F.round(F.sum("_part"), DIGITS).alias("score"))


def top_k_lexical(made: Weighted, asked: DataFrame, queries: DataFrame, keys: DataFrame, query: str, key: str, k: int, tally: dict | None = None) -> DataFrame:
    """``query, rank, key, score`` of ``asked`` (``query, term, times``, a written table) among ``keys``.

    Documents that match nothing have score 0 and compete where a query has fewer than k
    positive scores.  Of these only the ones of largest key count.  Nearly always they are
    among the k + SPARE largest keys of the corpus, whose matches alone are looked up.  A
    query that matches more of those (its scores must be negative or vanish for that) is
    scored once more, with a term of no weight that every document holds.
    """
    matches = pruning.best_matches(made.impacts, made.blocks, asked, query, key, k, tally)
    found = written(first_k(matches.withColumn("score", F.round("score", DIGITS)), query, key, k))
    hits = found.groupBy(query).agg(F.count(F.when(F.col("score") > 0, 1)).alias("_p"))
    needy = queries.select(query).distinct().join(hits, query, "left").filter(F.coalesce("_p", F.lit(0)) < k).select(query)
    needy = written(needy)
    if needy.isEmpty():
        return found
    posts = made.impacts.select(F.col("key").alias(key), F.explode(F.arrays_zip("terms", "parts")).alias("_e"))
    posts = posts.select(key, F.col("_e.terms").alias("term"), F.col("_e.parts").alias("impact"))
    last = written(keys.select(key).orderBy(F.desc(key)).limit(k + SPARE))
    near = posts.join(F.broadcast(last), key, "left_semi")
    matched = _best_pairs(near, written(asked.join(needy, query, "left_semi")), query, key)
    offered = needy.join(F.broadcast(last), F.lit(True)).join(matched, [query, key], "left_anti")
    offered = written(first_k(offered.withColumn("score", F.lit(0.0)), query, key, k))
    plain = first_k(found.unionByName(offered).select(query, key, "score"), query, key, k)
    if last.count() < k + SPARE:
        return plain
    enough = offered.groupBy(query).agg(F.count("*").alias("_n")).filter(F.col("_n") >= k)
    short = written(needy.join(enough, query, "left_anti"))
    if short.isEmpty():
        return plain
    mark = F.lit("\0").alias("term")
    every = posts.unionByName(keys.select(key, mark, F.lit(0.0).alias("impact")))
    whole = asked.join(short, query, "left_semi").unionByName(short.select(query, mark, F.lit(0.0).alias("times")))
    again = first_k(_scores(every, written(whole), query, key), query, key, k)
    return plain.join(short, query, "left_anti").unionByName(again)


def _best_pairs(posts: DataFrame, asked: DataFrame, query: str, key: str) -> DataFrame:
    """``query, key`` of all matches of a few documents (k + SPARE of them)."""
    return posts.select(key, "term").join(asked.select(query, "term"), "term").select(query, key).distinct()


def nothing(queries: DataFrame, corpus: DataFrame, query: str, key: str) -> DataFrame:
    return queries.select(query).limit(0).join(corpus.select(key).limit(0), F.lit(True)).select(
        query, F.lit(0).alias("rank"), key, F.lit(0.0).alias("score")
    )


@dataclass
class Weighted:
    """Impacts (``key, terms, parts``), their blocks, and ``term, idf``; all written."""

    impacts: DataFrame
    blocks: DataFrame
    terms: DataFrame


def bm25_impacts(corpus: index.Corpus, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``key, terms, parts`` and ``term, idf``; only terms of ``asked``, if given."""
    rows = index.asked_only(corpus.rows, asked) if asked is not None else corpus.rows
    length = K1 * (1 - B + B * F.col("dl") / F.lit(corpus.tokens / max(corpus.documents, 1)))
    parts = F.transform("tfs", lambda tf: tf * (K1 + 1) / (tf + length))
    return rows.select("key", "terms", parts.alias("parts")), _floored(bm25_raw(corpus.terms, corpus.documents)).select("term", "idf")


def tfidf_impacts(corpus: index.Corpus, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same for TF-IDF: frequencies over the norm of the document's weights."""
    idf = written(with_smooth_idf(corpus.terms, corpus.documents).select("term", "idf"))
    posts = corpus.rows.select("key", F.explode(F.arrays_zip("terms", "tfs")).alias("_e")).select("key", F.col("_e.terms").alias("term"), F.col("_e.tfs").alias("tf"))
    square = (F.col("tf") * F.col("idf") * F.col("tf") * F.col("idf")).alias("_s")
    if idf.count() <= BROADCAST_TERMS:
        squares = posts.join(F.broadcast(idf), "term").select("key", square)
    else:  # postings of frequent terms stay where they are
        near, rest = split_idf(idf)
        far = posts.join(F.broadcast(near), "term", "left_anti").join(rest, "term")
        squares = posts.join(F.broadcast(near), "term").select("key", square).unionByName(far.select("key", square))
    norms = squares.groupBy("key").agg(F.sqrt(F.sum("_s")).alias("_norm"))
    rows = index.asked_only(corpus.rows, asked) if asked is not None else corpus.rows
    parts = F.transform("tfs", lambda tf: tf / F.col("_norm"))
    return rows.join(norms, "key").select("key", "terms", parts.alias("parts")), idf


def _asked(queries: DataFrame, query: str, tokens: Column) -> DataFrame:
    """``query, term, tf`` (written)."""
    return written(queries.select(query, F.explode(tokens).alias("term")).groupBy(query, "term").agg(F.count("*").cast("double").alias("tf")))


def _weighted(
    name: str, make, corpus: DataFrame, held: index.Index | None, asked: DataFrame, queries: DataFrame, query: str, key: str, k: int, tokens: Column, tally: dict | None
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``term, idf`` of what is asked, and a search that is given the weights ``times`` of ``query, term`` (written).

    An index that is kept, or a call that wants a ``tally``, is searched by bounds, and
    texts of this call alone by tiles.
    """
    if held is not None:
        made, keys = Weighted(*held.weighted(name, make)), held.corpus().rows.select(F.col("key").alias(key))
        return made.terms, lambda times: top_k_lexical(made, times, queries, keys, query, key, k, tally)
    counts = index.corpus_of(corpus, key, tokens)
    impacts, terms = make(counts, asked)
    some = written(terms.join(asked.select("term").distinct(), "term", "left_semi"))
    if tally is not None:
        made = Weighted(*index.stored(impacts), some)
        return some, lambda times: top_k_lexical(made, times, queries, corpus.select(key), query, key, k, tally)
    posts = counts.terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return some, lambda times: first_k(tiles.best_matches(impacts, times, queries, query, key, k, counts.documents, posts), query, key, k)


def top_k_bm25(
    corpus: DataFrame | None, queries: DataFrame, k: int = 5, key: str = "doc_id", query: str = "item_id", text: str = "text", query_text: str = "text",
    held: index.Index | None = None, tally: dict | None = None,
) -> DataFrame:
    """``query, rank, key, score``: min(k, n) documents of each query; k of 0 gives none.

    Keys are different in all rows.  With ``held``, an index made with ``tokens_ws``, its
    documents are searched and ``corpus`` isn't read.  A ``tally`` gets the numbers of sums
    of a search by bounds, which is made then.
    """
    if k <= 0:
        return nothing(queries, corpus if held is None else held.corpus().rows.withColumnRenamed("key", key), query, key)
    asked = _asked(queries, query, tokens_ws(F.col(query_text)))
    terms, search = _weighted("bm25", bm25_impacts, corpus, held, asked, queries, query, key, k, tokens_ws(F.col(text)), tally)
    return search(written(asked.join(terms, "term").select(query, "term", (F.col("tf") * F.col("idf")).alias("times"))))


def top_k_tfidf(
    corpus: DataFrame | None, queries: DataFrame, k: int = 5, key: str = "doc_id", query: str = "item_id", text: str = "text", query_text: str = "text",
    held: index.Index | None = None, tally: dict | None = None,
) -> DataFrame:
    """As ``top_k_bm25``, by cosine of TF-IDF weights; unknown query terms vanish first.  ``held`` is made with ``tokens_words``."""
    if k <= 0:
        return nothing(queries, corpus if held is None else held.corpus().rows.withColumnRenamed("key", key), query, key)
    asked = _asked(queries, query, tokens_words(F.col(query_text)))
    terms, search = _weighted("tfidf", tfidf_impacts, corpus, held, asked, queries, query, key, k, tokens_words(F.col(text)), tally)
    raw = asked.join(terms, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(query)))
    return search(written(raw.select(query, "term", (F.col("_w") / norm * F.col("idf")).alias("times"))))


def examples_of(ranked: DataFrame, corpus: DataFrame, query: str, key: str, source: str = "text_source", target: str = "text_target") -> DataFrame:
    """``query, examples``: structs (source, target), best first."""
    texts = ranked.join(corpus.select(key, F.col(source).alias("source"), F.col(target).alias("target")), key)
    listed = F.array_sort(F.collect_list(F.struct("rank", "source", "target")))
    plain = F.transform(listed, lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target")))
    return texts.groupBy(query).agg(plain.alias("examples"))
