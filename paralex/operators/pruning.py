"""The k best documents of each query, without a sum for those that cannot be among them.

1. The blocks of greatest impact give some documents of each query; their whole scores give a
   score that the k-th best reaches at least.
2. Terms are left out, the most frequent first, as long as all of them together stay below a
   share of that score.  A block of another term is skipped if its best posting, together with
   the best of all other terms, cannot reach the score.
3. What is left is summed; a document whose sum, together with the best of the terms left out,
   cannot reach the score is dropped.  Only the others get a whole score.

Results are those of summing everything.  All queries go through one plan, however many there
are: their weights meet postings by a join, and documents in blocks of queries side by side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paralex.session import written

#: Postings that are looked at first, for each of the k; the share of the score that the
#: terms left out may reach; and what rounding may change.
PROBED, SHARE, MARGIN = 80, 0.8, 1e-5
#: Rows of (query, term) and of (query, document) in one group, and keys that are sent along.
QUERY_TERMS, PAIRS, SMALL = 500_000, 8_000, 1_000_000


def _near(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast, if ``rows`` of them are few enough."""
    return F.broadcast(df) if rows <= SMALL else df


def scored(pairs: DataFrame, impacts: DataFrame, asked: DataFrame, query: str, key: str) -> DataFrame:
    """``query, key, score`` of ``pairs`` (written): the whole sums.

    A group is a block of queries, by their weights' number, and a part of the pairs.
    """
    n_pairs, n_terms = pairs.count(), asked.count()
    blocks, parts = max(1, -(-n_terms // QUERY_TERMS)), max(1, -(-n_pairs // PAIRS))
    block, part = F.pmod(F.xxhash64(query), F.lit(blocks)).alias("_b"), F.pmod(F.hash(key), F.lit(parts)).alias("_p")
    wanted = pairs.groupBy(block, key).agg(F.collect_list(query).alias("_q"))
    some = impacts.withColumnRenamed("key", key)
    if n_pairs <= SMALL:
        some = some.join(F.broadcast(pairs.select(key).distinct()), key, "left_semi")
    left = wanted.join(some, key).select("_b", part, key, "_q", "terms", "parts")
    copies = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p")
    right = asked.select(block, copies, query, "term", "times")
    kinds = asked.schema[query].dataType.simpleString(), some.schema[key].dataType.simpleString()

    def work(docs: pa.Table, weights: pa.Table) -> pa.Table:
        of: dict = {}
        for q, term, times in zip(*(weights.column(n).to_pylist() for n in (query, "term", "times"))):
            of.setdefault(q, []).append((term, times))
        out: tuple[list, list, list] = [], [], []
        for doc, queries, terms, values in zip(*(docs.column(n).to_pylist() for n in (key, "_q", "terms", "parts"))):
            value = dict(zip(terms, values)).get
            for q in queries:
                total = 0.0
                for term, times in of.get(q, ()):
                    total += times * value(term, 0.0)
                for column, v in zip(out, (q, doc, total)):
                    column.append(v)
        schema = weights.schema.field(query).type, docs.schema.field(key).type, pa.float64()
        return pa.table({n: pa.array(v, t) for n, v, t in zip((query, key, "score"), out, schema)})

    # A number of partitions that is asked for isn't made smaller because the rows are few: each is much work.
    left, right = (side.repartition(min(blocks * parts, 4_096), "_b", "_p") for side in (left, right))
    return left.groupBy("_b", "_p").cogroup(right.groupBy("_b", "_p")).applyInArrow(work, f"`{query}` {kinds[0]}, `{key}` {kinds[1]}, score double")


def _kth(scores: DataFrame, query: str, k: int) -> DataFrame:
    """``query, _least``: the k-th best score, of queries that have as many."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score")))
    return scores.select(query, "score", place.alias("_r")).filter(F.col("_r") <= k).filter(F.col("_r") == k).select(query, F.col("score").alias("_least"))


def probed(blocks: DataFrame, asked: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """``query, key`` of the postings with the greatest parts in scores, PROBED * k of a query or a block more."""
    most = PROBED * k
    of_term = Window.partitionBy("term").orderBy(F.desc("best"), "id")
    first = blocks.select("term", "id", "n", "best").withColumn("_r", F.row_number().over(of_term)).filter(F.col("_r") <= most).drop("_r")
    met = first.join(asked, "term").withColumn("_v", F.col("times") * F.col("best")).filter("_v > 0")
    before = Window.partitionBy(query).orderBy(F.desc("_v"), "term", "id").rowsBetween(Window.unboundedPreceding, -1)
    taken = written(met.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("_before") < most).select(query, "term", "id"))
    some = blocks.select("term", "id", "docs").join(_near(taken, taken.count()), ["term", "id"])
    return some.select(query, F.explode("docs").alias(key)).distinct()


def candidates(blocks: DataFrame, asked: DataFrame, least: DataFrame, query: str, key: str, tally: dict | None) -> DataFrame:
    """``query, key`` of every document that may reach ``least``; of queries without it, all that match."""
    facts = blocks.groupBy("term").agg(F.sum("n").alias("_df"), F.max("best").alias("_best"))
    met = asked.join(facts, "term").join(least, query, "left")
    met = met.withColumn("_most", F.greatest(F.col("times") * F.col("_best"), F.lit(0.0)))
    every = F.coalesce(F.col("_least") <= MARGIN, F.lit(True))  # no such score, or one that documents without a match reach
    until = Window.partitionBy(query).orderBy(F.desc("_df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    needed = every | (F.col("times") > 0) & (F.sum("_most").over(until) > SHARE * F.col("_least"))
    whole = Window.partitionBy(query)
    met = met.withColumns({"_every": every, "_needed": needed})
    met = met.withColumns({"_rest": F.sum(F.when(~F.col("_needed"), F.col("_most")).otherwise(0.0)).over(whole), "_sum": F.sum("_most").over(whole)})
    bar = F.when(~F.col("_every"), F.col("_least") - MARGIN)
    met = written(met.filter("_needed").select(query, "term", "times", bar.alias("_bar"), (bar - F.col("_sum") + F.col("_most")).alias("_block"), "_rest"))
    some = blocks.join(_near(met, met.count()), "term").filter(F.col("_block").isNull() | (F.col("times") * F.col("best") >= F.col("_block")))
    each = some.select(query, "times", "_bar", "_rest", F.explode(F.arrays_zip("docs", "parts")).alias("_e"))
    sums = each.groupBy(query, F.col("_e.docs").alias(key)).agg(F.sum(F.col("times") * F.col("_e.parts")).alias("_part"), F.max("_bar").alias("_bar"), F.max("_rest").alias("_rest"))
    if tally is not None:
        sums = written(sums)
        tally["partial sums"] = sums.count()
        tally["products of partial sums"] = each.count()
    return sums.filter(F.col("_bar").isNull() | (F.col("_part") + F.col("_rest") >= F.col("_bar"))).select(query, key)


def best_matches(impacts: DataFrame, blocks: DataFrame, asked: DataFrame, query: str, key: str, k: int, tally: dict | None = None) -> DataFrame:
    """``query, key, score`` of documents that match, the k best of each query among them.

    ``asked`` (written) has the weight ``times`` of each ``query, term``; a score is the sum of
    weights times impacts.  ``tally`` gets the numbers of sums that were made.
    """
    first = written(probed(blocks, asked, query, key, k))
    scores = written(scored(first, impacts, asked, query, key))
    more = candidates(blocks, asked, _kth(scores, query, k), query, key, tally)
    more = written(more.join(first, [query, key], "left_anti"))
    if tally is not None:
        tally["sums"] = first.count() + more.count()
    return scores.unionByName(scored(more, impacts, asked, query, key))
