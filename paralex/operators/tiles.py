"""The k best documents of each query, by all products, without moving a score that can't count.

Queries are dealt to blocks and documents to parts; each block meets each part in one task,
which sums tile by tile (``TILE`` scores at a time): the terms that most pairs share by a dense
product, the others posting by posting.  Only k rows of a query leave a task.  So memory follows
from the sizes of a block and a part, and what is moved is a copy of each document a block, of
each query a part, and k rows of each query a part; products of queries and documents never move.

A document that matches nothing has score 0 and competes like any other.  Scores are rounded to
six digits before they are compared; of equal ones the larger key is first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and weights of a block, documents and postings of a part, at most (in the mean).
QUERIES, WEIGHTS, DOCUMENTS, POSTINGS = 16_384, 1_000_000, 32_768, 4_000_000
#: Scores, and products of single postings, that are held at a time.
TILE, PRODUCTS = 1 << 22, 1 << 22
#: Most terms of a dense product, and the share of pairs that must have a term for it.
DENSE, COMMON = 256, 0.01
#: Pairs that are worth a task of their own.
WORTH = 20_000_000
#: Decimal digits of a score, and what rounding may change by.
SCALE, SLACK = 1e6, 1.01e-6


def _rounded(values: np.ndarray) -> np.ndarray:
    return np.sign(values) * np.floor(np.abs(values) * SCALE + 0.5) / SCALE + 0.0


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers from each ``first`` on, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded score of the k best of each row, of equal ones the first."""
    n = scores.shape[1]
    if n <= k:
        row, column = np.divmod(np.arange(scores.size), n)
        return row, column, _rounded(scores.ravel())
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    row, column = np.nonzero(scores >= (least - SLACK)[:, None])
    value = _rounded(scores[row, column])
    counts = np.bincount(row, minlength=len(scores))
    keep = np.ones(len(row), bool)
    ends = np.cumsum(counts)
    for i in np.flatnonzero(counts > k):
        here = slice(ends[i] - counts[i], ends[i])
        bar = np.partition(value[here], counts[i] - k)[counts[i] - k]
        over = value[here] > bar
        equal = np.flatnonzero(value[here] == bar)[: k - over.sum()]
        over[equal] = True
        keep[here] = over
    return row[keep], column[keep], value[keep]


def best_of_part(terms: pa.Array, parts: np.ndarray, of_doc: np.ndarray, n_docs: int, asked: pa.Array, times: np.ndarray, of_query: np.ndarray, n_queries: int, k: int):
    """Query, document and score (arrays) of the k best documents of each query.

    ``terms`` and ``parts`` are postings of the documents ``of_doc``; ``asked`` and ``times``
    are weights of the queries ``of_query``, in ascending order of these.
    """
    asked = asked.dictionary_encode()
    code_q = asked.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.index_in(terms, value_set=asked.dictionary)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    code_d = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)[known].astype(np.int64)
    kinds = len(asked.dictionary)
    order = np.argsort(code_d, kind="stable")
    code_d, parts, of_doc = code_d[order], parts[known][order], of_doc[known][order]
    df = np.bincount(code_d, minlength=kinds)
    first = np.cumsum(df) - df
    share = df / n_docs * (np.bincount(code_q, minlength=kinds) / n_queries)
    common = np.argsort(-share, kind="stable")[:DENSE]
    common = common[share[common] > COMMON]
    place = np.full(kinds, -1)
    place[common] = np.arange(len(common))
    dense = np.zeros((len(common), n_docs))
    at = place[code_d]
    dense[at[at >= 0], of_doc[at >= 0]] = parts[at >= 0]
    size = max(1, TILE // n_docs)
    out = []
    for since in range(0, n_queries, size):
        until = min(n_queries, since + size)
        lo, hi = np.searchsorted(of_query, [since, until])
        code, q, w = code_q[lo:hi], of_query[lo:hi] - since, times[lo:hi]
        at = place[code]
        weights = np.zeros((until - since, len(common)))
        weights[q[at >= 0], at[at >= 0]] = w[at >= 0]
        scores = weights @ dense
        flat = scores.reshape(-1)
        rare = (at < 0) & (df[code] > 0)
        code, q, w = code[rare], q[rare], w[rare]
        cuts = np.cumsum(df[code]) // PRODUCTS
        for cut in np.unique(cuts):
            some = slice(*np.searchsorted(cuts, [cut, cut + 1]))
            n = df[code[some]]
            posts = _ranges(first[code[some]], n)
            np.add.at(flat, np.repeat(q[some] * n_docs, n) + of_doc[posts], np.repeat(w[some], n) * parts[posts])
        row, column, value = best_of(scores, k)
        out.append((row + since, column, value))
    return tuple(np.concatenate(x) for x in zip(*out))


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All values of the lists, and the row of each."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def dealt(n_queries: int, n_weights: int, n_docs: int, n_posts: int, cores: int) -> tuple[int, int]:
    """The numbers of blocks and of parts."""
    blocks = max(1, -(-n_queries // QUERIES), -(-n_weights // WEIGHTS))
    parts = max(1, -(-n_docs // DOCUMENTS), -(-n_posts // POSTINGS))
    tasks = min(3 * cores, n_queries * n_docs // WORTH)  # small jobs are one task
    if blocks * parts < tasks:
        if n_queries > n_docs:
            blocks = -(-tasks // parts)
        else:
            parts = -(-tasks // blocks)
    return blocks, parts


def best_matches(impacts: DataFrame, asked: DataFrame, queries: DataFrame, query: str, key: str, k: int, n_docs: int, n_posts: int) -> DataFrame:
    """``query, key, score``: of each part of the documents the k best of each query.

    ``impacts`` (``key, terms, parts``) has a row for each document, ``asked`` (a written
    table) the weight ``times`` of each ``query, term``; a score is the sum of weights times
    impacts.  ``n_docs`` and ``n_posts`` are the numbers of documents and postings, or more.
    """
    spark = impacts.sparkSession
    each = queries.select(query).distinct()
    blocks, parts = dealt(each.count(), asked.count(), n_docs, n_posts, spark.sparkContext.defaultParallelism)
    listed = F.array_sort(F.collect_list(F.struct("term", "times")))
    weights = each.join(asked.groupBy(query).agg(listed.alias("_l")), query, "left")
    right = weights.select(
        F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"),
        F.col(query), F.col("_l.term").alias("terms"), F.col("_l.times").alias("times"),
    )
    left = impacts.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("_p"),
        F.col("key").alias(key), "terms", "parts",
    )
    kinds = right.schema[query].dataType.simpleString(), left.schema[key].dataType.simpleString()

    def work(docs: pa.Table, some: pa.Table) -> pa.Table:
        types = some.schema.field(query).type, docs.schema.field(key).type, pa.float64()
        if not len(docs) or not len(some):
            return pa.table({n: pa.array([], t) for n, t in zip((query, key, "score"), types)})
        order = pc.sort_indices(docs, [(key, "descending")])  # of equal scores the larger key is first
        place = np.empty(len(docs), np.int64)
        place[order.to_numpy()] = np.arange(len(docs))
        terms, of_doc = _flat(docs.column("terms"))
        values, _ = _flat(docs.column("parts"))
        wanted, of_query = _flat(some.column("terms"))
        times, _ = _flat(some.column("times"))
        q, d, score = best_of_part(terms, values.to_numpy(), place[of_doc], len(docs), wanted, times.to_numpy(), of_query, len(some), k)
        return pa.table({query: some.column(query).take(pa.array(q)), key: docs.column(key).take(order.take(pa.array(d))), "score": pa.array(score)})

    # A number of partitions that is asked for isn't made smaller because the rows are few: each group is much work.
    left, right = (side.repartition(min(2 * blocks * parts, 4_096), "_b", "_p") for side in (left, right))
    return left.groupBy("_b", "_p").cogroup(right.groupBy("_b", "_p")).applyInArrow(work, f"`{query}` {kinds[0]}, `{key}` {kinds[1]}, score double")
