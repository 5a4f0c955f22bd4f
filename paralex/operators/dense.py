"""Top-k retrieval by plain dot product of vectors, in balls that a bound leaves open.

1. A hash sample of the vectors are centres; every vector belongs to the nearest one of its
   length.  A ball is the vectors of a centre, with the largest distance from it and the
   largest norm.  No vector of a ball has a product above ``q c + |q| distance``, or above
   ``|q| norm``.
2. A query meets the balls of greatest bound that hold k vectors together; its k-th score
   there is what the others must reach.
3. It then meets the other balls whose bound does.  Vectors of a ball that no query of a block
   meets aren't sent anywhere.

Results are those of all products.  Ranks are as in ``retrieval``.  How much is left out depends
on the data: much of clustered vectors, nothing of independent ones of many dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.operators.retrieval import DIGITS, first_k, nothing
from paralex.session import written

#: Rows of one block of queries, bytes of one part of a ball, and cells of the matrix of
#: products that a task holds at a time.
QUERY_BLOCK, CORPUS_BYTES, CELLS = 1_024, 16 << 20, 1 << 20
#: Most centres (the square root of the rows, if that is less), and most bytes of them; these go
#: to the driver and to every task.
CENTRES, CENTRE_BYTES = 2_048, 16 << 20
#: What rounding may change, of |q| times the largest norm.
MARGIN = 1e-9


def _k_best(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and rows of ``c`` (in descending order of key) of the k best of each of ``q``."""
    scores, rows = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
    step = max(1, CELLS // max(1, len(q)))
    for at in range(0, len(c), step):
        part = np.round(q @ c[at : at + step].T, DIGITS)
        scores = np.concatenate([scores, part], axis=1)
        rows = np.concatenate([rows, np.broadcast_to(np.arange(at, at + part.shape[1]), part.shape)], axis=1)
        if scores.shape[1] > k:
            # All above the k-th score, then equal ones by larger key, that is by smaller row.
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
            spare = k - (scores > least).sum(axis=1, keepdims=True)
            equal = scores == least
            keep = (scores > least) | equal & (np.cumsum(equal, axis=1) <= spare)
            scores, rows = scores[keep].reshape(len(q), k), rows[keep].reshape(len(q), k)
    return scores, rows


class Balls:
    """Bounds of all balls, and the centres; both go to every task."""

    def __init__(self, centres: dict[int, tuple[np.ndarray, np.ndarray]], rows: list):
        self.of: dict[int, tuple] = {}
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(r["_dim"], []).append(r)
        for dim, balls in by_dim.items():
            numbers, points = centres.get(dim, (np.empty(0, np.int64), np.empty((0, dim))))
            place = {int(n): i for i, n in enumerate(numbers)}
            # A ball without a centre is one around zero.
            at = np.array([points[place[r["_ball"]]] if r["_ball"] in place else np.zeros(dim) for r in balls])
            column = lambda name, kind: np.array([r[name] for r in balls], kind)
            self.of[dim] = column("_ball", np.int64), at, column("far", float), column("norm", float), column("n", np.int64)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest product of each of ``q`` with any vector of each ball, rounding included."""
        _, at, far, norm, _ = self.of[q.shape[1]]
        size = np.linalg.norm(q, axis=1)[:, None]
        return np.minimum(q @ at.T + size * far, size * norm) + MARGIN * size * (norm + far) + 10.0**-DIGITS

    def first(self, bounds: np.ndarray, dim: int, k: int) -> np.ndarray:
        """Which balls are met first: those of greatest bound, until they hold k vectors."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        held = np.cumsum(self.of[dim][4][order], axis=1)
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, np.concatenate([np.ones((len(held), 1), bool), held[:, :-1] < k], axis=1), axis=1)
        return out


def _centres(vectors: DataFrame, n: int, longest: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, numbers and points of the centres."""
    want = max(1, min(CENTRES, round(n**0.5), CENTRE_BYTES // (8 * max(1, longest))))
    # Equal vectors have one hash and are one centre, so repeats can't raise the number.
    some = F.pmod(F.xxhash64("_v"), F.lit(1 << 32)) < int(want / max(1, n) * (1 << 32))
    found: dict[int, list] = {}
    for r in vectors.filter(some).select("_dim", "_v").distinct().orderBy("_v").collect():
        found.setdefault(r[0], []).append(r[1])
    out, start = {}, 0
    for dim, points in sorted(found.items()):
        out[dim] = np.arange(start, start + len(points)), np.array(points)
        start += len(points)
    return out


def _dealt(vectors: DataFrame, centres: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``vectors`` with ``_ball``, ``_far`` (the distance from its centre) and ``_norm``; written.

    Where no vector of a length is a centre, ``-length`` is the ball's number.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # CENTRE_BYTES

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, rows in frame.groupby("_dim"):
                v = np.stack(rows["_v"].to_numpy())
                norm = np.linalg.norm(v, axis=1)
                ball, far = np.full(len(v), -dim, np.int64), norm
                if dim in shared.value:
                    numbers, points = shared.value[dim]
                    half = (points * points).sum(axis=1) / 2
                    near = np.concatenate([np.argmax(part @ points.T - half, axis=1) for part in np.array_split(v, -(-len(v) * len(points) // CELLS))])
                    ball, far = numbers[near], np.linalg.norm(v - points[near], axis=1)
                yield rows.assign(_ball=ball, _far=far, _norm=norm)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return written(vectors.mapInPandas(work, f"{schema}, _ball long, _far double, _norm double"))


def top_k_dense(
    corpus: DataFrame, queries: DataFrame, k: int = 5, key: str = "doc_id", query: str = "item_id", vector: str = "embedding", tally: dict | None = None
) -> DataFrame:
    """``query, rank, key, score``: min(k, n) rows of each query; k of 0 gives none.

    A task multiplies a block of queries and a part of a ball, and returns k rows a query, so
    neither side is broadcast or gathered whole.  ``tally`` gets ``products``, the pairs
    that are multiplied, and ``pairs``, all there are.

    Vectors that are null, empty or hold a null or a component that isn't finite take no
    part, and neither does a query with a vector of another length than a document's.
    """
    if k <= 0:
        return nothing(queries, corpus, query, key)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)

    def plain(df: DataFrame, own: str) -> DataFrame:
        part = df.filter(sound).select(F.col(own).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
        return part.withColumn("_dim", F.size("_v"))

    vectors, asked = plain(corpus, key), plain(queries, query)
    n, longest = vectors.agg(F.count("*"), F.max("_dim")).first()
    if not n:
        return nothing(queries, corpus, query, key)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)))
    centres = _centres(vectors, n, longest)
    held = _dealt(vectors, centres)
    found = held.groupBy("_ball", "_dim").agg(F.max("_far").alias("far"), F.max("_norm").alias("norm"), F.count("*").alias("n")).collect()
    spark = corpus.sparkSession
    balls = spark.sparkContext.broadcast(Balls(centres, found))  # a row for each centre, or each length
    # One row a ball, with the parts that it is dealt in.
    parts = spark.createDataFrame([(r["_ball"], -(-r["n"] * 8 * r["_dim"] // CORPUS_BYTES), r["n"]) for r in found], "_ball long, _parts long, _n long")
    held = held.select("_key", "_v", "_ball").join(F.broadcast(parts), "_ball")
    held = held.select("_key", "_v", "_ball", F.pmod(F.xxhash64("_key"), F.col("_parts")).alias("_part"))
    kinds = queries.schema[query].dataType.simpleString(), corpus.schema[key].dataType.simpleString()

    def met(rows: DataFrame, first: bool) -> DataFrame:
        """``_key, _block, _v, _ball, _part`` of the balls that are met first, or then (``_least`` is to be reached)."""

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for dim, some in frame.groupby("_dim"):
                    if dim not in balls.value.of:
                        continue
                    bounds = balls.value.bounds(np.stack(some["_v"].to_numpy()))
                    chosen = balls.value.first(bounds, dim, k)
                    if not first:
                        chosen = ~chosen & (bounds >= some["_least"].to_numpy()[:, None])
                    numbers = balls.value.of[dim][0]
                    yield some[["_key", "_block", "_v"]].assign(_balls=[numbers[c] for c in chosen])

        each = rows.mapInPandas(work, f"_key {kinds[0]}, _block long, _v array<double>, _balls array<bigint>")
        each = each.select("_key", "_block", "_v", F.explode("_balls").alias("_ball")).join(F.broadcast(parts), "_ball")
        if tally is not None:
            tally["products"] = tally.get("products", 0) + (each.agg(F.sum("_n")).first()[0] or 0)
        return each.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"_query": [], "_doc": [], "score": []})
        c = c.sort_values("_key", ascending=False)
        scores, at = _k_best(np.stack(q["_v"].to_numpy()), np.stack(c["_v"].to_numpy()), k)
        rows = np.repeat(np.arange(len(q)), at.shape[1])
        return pd.DataFrame({"_query": q["_key"].to_numpy()[rows], "_doc": c["_key"].to_numpy()[at.ravel()], "score": scores.ravel()})

    def searched(left: DataFrame) -> DataFrame:
        # Other names, since both sides of the cogroup come from ``left``.
        open_ = left.select(*(F.col(c).alias(f"{c}_") for c in ("_ball", "_part", "_block"))).distinct()
        right = held.join(open_, (F.col("_ball") == F.col("_ball_")) & (F.col("_part") == F.col("_part_")))
        right = right.select("_ball_", "_part_", "_block_", "_key", "_v")
        near = left.select("_ball", "_part", "_block", "_key", "_v").groupBy("_ball", "_part", "_block")
        both = near.cogroup(right.groupBy("_ball_", "_part_", "_block_"))
        return both.applyInPandas(best, f"_query {kinds[0]}, _doc {kinds[1]}, score double")

    early = written(first_k(searched(met(asked, True)), "_query", "_doc", k))
    least = early.filter(F.col("rank") == k).select(F.col("_query").alias("_key"), F.col("score").alias("_least"))
    late = searched(met(asked.join(least, "_key", "left").fillna(float("-inf"), ["_least"]), False))
    if tally is not None:
        tally["pairs"] = asked.groupBy("_dim").count().join(vectors.groupBy("_dim").agg(F.count("*").alias("n")), "_dim").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    every = early.select("_query", "_doc", "score").unionByName(late)
    return first_k(every.withColumnsRenamed({"_query": query, "_doc": key}), query, key, k)
