"""Operator 3: approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled to length one, so that the nearest by distance are those of
largest cosine, and projected to ``DIMS`` dimensions by Gaussian (2-stable)
directions: a projected squared distance is the true one times a chi-square
variable of ``DIMS`` degrees.  A kd-tree over projections, fitted on a bounded
sample, deals all vectors into cells; each cell holds a kd-tree of its own.

A query goes through the tree by growing projected distance: the ``NEAR_LEAVES``
nearest leaves give its first ``SEEDS`` vectors, whose true cosines are verified, then
come the other leaves that are still open, their ``SEEDS`` nearest vectors, and the
rest.  The chi-square test says from which projected distance on a vector nearer than
the k-th best would have been met already with probability ``CONFIDENCE``: leaves
beyond it are left out, and so are, one by one, the vectors beyond it in other leaves.
The columns ``compared`` and ``verified`` count the projections and the cosines.  A
query first searches its own cell, then the cells that the test leaves open.

Equal vectors are one entry with their k + 1 smallest different ids, each at most k
times, which is all that can be among k nearest once a query's own id is left out,
so a very common vector costs no more than any other.  Where an id stands with m
different vectors, searches keep k + m entries, so that k others remain.
Queries and vectors of a cell are dealt in blocks of bounded size, so a task holds one
of each however many a cell has; the number of cells follows the number of vectors up
to a bound that the sample sets.

Defined results: rows without id, and vectors null, empty, zero or with null or
non-finite components, take no part; vectors of different lengths are never
compared; rows that share the query's id count as its own; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paralex.llm.common import durable
from paralex.llm.folds import sampled

DIMS, SEED = 32, 20_14
CONFIDENCE = 0.97
#: Vectors of the sample that cells are fitted on, and vectors a cell should hold.
SAMPLE_ROWS, CELL_ROWS = 16_384, 8_192
#: Queries of one block and bytes of its vectors.
LEAF_ROWS, BLOCK_ROWS, BLOCK_BYTES, STEP_ROWS = 16, 2_048, 16 << 20, 256
#: Leaves that a query opens without a bound, and the nearest projections that it
#: verifies before the rest are tested.
NEAR_LEAVES, SEEDS = 16, 128


def chi_square_quantile(p: float, degrees: int = DIMS) -> float:
    """x with P(chi-square of an even number of degrees <= x) = p."""
    low, high = 0.0, 1_000.0
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def directions(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, DIMS))


def project(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return unit @ directions(vectors.shape[1])


class Cells:
    """Top of the kd-tree: median splits of a sample into about ``count`` cells."""

    def __init__(self, sample: np.ndarray, count: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, child below, child above; leaves are ~cell
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.root = self._grow(sample, max(1, count), np.full(DIMS, -np.inf), np.full(DIMS, np.inf))

    def _grow(self, rows: np.ndarray, count: int, low: np.ndarray, high: np.ndarray) -> int:
        axis = int(np.argmax(np.ptp(rows, axis=0))) if len(rows) else 0
        value = float(np.median(rows[:, axis])) if len(rows) else 0.0
        under = rows[:, axis] < value if len(rows) else None
        if count < 2 or len(rows) < 2 or not under.any():
            self.low.append(low)
            self.high.append(high)
            return ~(len(self.low) - 1)
        at = len(self.splits)
        self.splits.append((axis, value, 0, 0))
        mid_high, mid_low = high.copy(), low.copy()
        mid_high[axis] = mid_low[axis] = value
        below = self._grow(rows[under], count // 2, low, mid_high)
        above = self._grow(rows[~under], count - count // 2, mid_low, high)
        self.splits[at] = (axis, value, below, above)
        return at

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, here = todo.pop()
            if node < 0:
                out[here] = ~node
                continue
            axis, value, below, above = self.splits[node]
            under = rows[here, axis] < value
            todo += [(below, here[under]), (above, here[~under])]
        return out

    def gaps(self, rows: np.ndarray) -> np.ndarray:
        """Squared projected distance of each row from each cell's box."""
        return box_gaps(rows, np.array(self.low), np.array(self.high))


def box_gaps(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(low)))
    for axis in range(DIMS):
        x = rows[:, axis : axis + 1]
        out += np.maximum(0, np.maximum(low[None, :, axis] - x, x - high[None, :, axis])) ** 2
    return out


class Leaves:
    """kd-tree of one cell, as its leaves: rows (-1: none) and tight boxes."""

    def __init__(self, rows: np.ndarray):
        todo, leaves = [np.arange(len(rows))], []
        while todo:
            here = todo.pop()
            if len(here) <= LEAF_ROWS:
                leaves.append(here)
                continue
            axis = int(np.argmax(np.ptp(rows[here], axis=0)))
            half = len(here) // 2
            order = np.argpartition(rows[here, axis], half)
            todo += [here[order[:half]], here[order[half:]]]
        self.rows = np.full((len(leaves), LEAF_ROWS), -1)
        for i, here in enumerate(leaves):
            self.rows[i, : len(here)] = here
        self.low = np.array([rows[x].min(axis=0) for x in leaves])
        self.high = np.array([rows[x].max(axis=0) for x in leaves])


def _best(who: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of each of ``n`` queries, as arrays of scores and rows (-1: none)."""
    order = np.lexsort((ids[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    first = rank < k
    scores, rows = np.full((n, k), -np.inf), np.full((n, k), -1)
    scores[who[first], rank[first]] = score[first]
    rows[who[first], rank[first]] = row[first]
    return scores, rows


def search(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray, limit: float):
    """The k best rows of ``vectors`` for each query, as far as the test goes on.

    ``bound`` is a squared distance that the k-th best is known not to exceed.
    Returns arrays (query x k) of scores and rows (-1 where there is none), and how many
    vectors each query compared by projection and verified.
    """
    spots = project(vectors)
    tree = Leaves(spots)
    size = (spots * spots).sum(axis=1)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    scores, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    compared, verified = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    pairs = max(1, BLOCK_BYTES // (8 * vectors.shape[1]))
    at_once = max(1, min(STEP_ROWS, BLOCK_BYTES // (8 * len(vectors))))
    for at in range(0, len(queries), at_once):
        q = queries[at : at + at_once]
        own, place = np.sqrt((q * q).sum(axis=1)), project(q)
        worst, length = bound[at : at + at_once].copy(), (place * place).sum(axis=1)
        best, rows = scores[at : at + at_once], found[at : at + at_once]
        apart = np.full((len(q), len(vectors)), np.inf)  # projections compared and not verified
        gaps = box_gaps(place, tree.low, tree.high)

        def reach() -> np.ndarray:
            return np.minimum(limit * worst, np.finfo(float).max)[:, None]

        def compare(leaves: np.ndarray) -> None:
            for leaf in np.flatnonzero(leaves.any(axis=0)):
                who, here = np.flatnonzero(leaves[:, leaf]), tree.rows[leaf]
                here = here[here >= 0]
                apart[np.ix_(who, here)] = length[who, None] + size[here] - 2 * place[who] @ spots[here].T
                compared[at + who] += len(here)

        def verify(i: np.ndarray, r: np.ndarray) -> None:
            parts = [np.einsum("ij,ij->i", vectors[r[x : x + pairs]], q[i[x : x + pairs]]) for x in range(0, len(i), pairs)]
            np.add.at(verified, at + i, 1)
            apart[i, r] = np.inf
            score = np.concatenate([np.zeros(0), *parts]) / (norms[r] * own[i])
            good = score >= best[i, k - 1]
            j, x = np.nonzero(rows >= 0)
            best[:], rows[:] = _best(np.r_[j, i[good]], np.r_[rows[j, x], r[good]], np.r_[best[j, x], score[good]], ids, k, len(q))
            last = best[:, k - 1]
            worst[:] = np.minimum(worst, np.where(np.isneginf(last), np.inf, np.maximum(0, 2 - 2 * last)))

        def seeds() -> None:
            n = min(SEEDS, len(vectors))
            near = np.argpartition(apart, n - 1, axis=1)[:, :n]
            i, c = np.nonzero(np.take_along_axis(apart, near, 1) <= reach())
            verify(i, near[i, c])

        near = np.zeros(gaps.shape, bool)
        np.put_along_axis(near, np.argsort(gaps, axis=1, kind="stable")[:, :NEAR_LEAVES], True, 1)
        near &= gaps <= reach()
        compare(near)
        seeds()
        compare(~near & (gaps <= reach()))
        seeds()
        verify(*np.nonzero(apart <= reach()))
    return scores, found, compared, verified


def _valid(rows: DataFrame) -> DataFrame:
    """``vec_id, vec array<double>, dim`` of the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    some = F.exists("vec", lambda x: x != 0)
    return (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
        .filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
        .filter(sound)
        .filter(some)
        .withColumn("dim", F.size("vec"))
    )


def _stack(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["vec"].to_numpy()).astype(np.float64)


def nearest(rows: DataFrame, is_query, k: int = 5, confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score, compared, verified``: the k nearest of each query row,
    and how many different vectors had their projection compared and their cosine verified for it.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = rows.sparkSession
    valid = _valid(rows)
    first = Window.partitionBy("vec").orderBy("vec_id")
    each = valid.groupBy("vec", "dim", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("_times"))
    few = each.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    base = few.groupBy("vec", "dim").agg(F.flatten(F.sort_array(F.collect_list(F.array_repeat("vec_id", F.col("_times"))))).alias("ids"))
    base = durable(base.withColumn("least", F.element_at("ids", 1)).withColumn("uid", F.xxhash64("vec")))
    sizes = {r[0]: r[1] for r in base.groupBy("dim").count().collect()}
    total = sum(sizes.values())
    schema = "query_id long, rank int, vec_id long, score double, compared long, verified long"
    if not total:
        return spark.createDataFrame([], schema)
    share = min(1.0, SAMPLE_ROWS / total)
    part = sampled(F.col("least"), share, SEED)
    taken: dict[int, list] = {}
    for r in base.filter(part).select("dim", "vec").toLocalIterator():
        taken.setdefault(r[0], []).append(r[1])
    cells = {
        d: Cells(project(np.array(taken[d])) if d in taken else np.zeros((0, DIMS)), min(-(-n // CELL_ROWS), max(1, len(taken.get(d, ())) // 32)))
        for d, n in sizes.items()
    }
    del taken
    tree = spark.sparkContext.broadcast(cells)  # at most SAMPLE_ROWS / 32 cells a dimension
    limit = chi_square_quantile(confidence)

    def deal(frames):
        for f in frames:
            out = np.zeros(len(f), np.int64)
            for d in f["dim"].unique():
                here = np.flatnonzero(f["dim"] == d)
                out[here] = tree.value[int(d)].of(project(_stack(f.iloc[here])))
            yield f.assign(cell=out)

    indexed = durable(base.mapInPandas(deal, "vec array<double>, dim int, ids array<long>, least long, uid long, cell long"))
    asked = valid.filter(is_query).select("vec_id", "vec", "dim")
    own = asked.groupBy("vec_id", "dim").agg(F.countDistinct("vec").alias("n")).agg(F.max("n")).first()[0]
    depth = k + (own or 1)
    wanted = asked.select("vec", "dim").distinct()
    queries = durable(wanted.join(indexed, ["vec", "dim"]).select("uid", "vec", "dim", "cell"))

    found_schema = "uid long, score double, least long, ids array<long>, compared long, verified long"

    def answer(key, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"uid": [], "score": [], "least": [], "ids": [], "compared": [], "verified": []})
        q, c, least = _stack(left), _stack(right), right["least"].to_numpy()
        bound = left["bound"].to_numpy() if "bound" in left else np.full(len(q), np.inf)
        score, row, compared, verified = search(q, c, least, depth, bound, limit)
        i, j = np.nonzero(row >= 0)
        r = row[i, j]
        return pd.DataFrame({
            "uid": left["uid"].to_numpy()[i], "score": score[i, j], "least": least[r], "ids": right["ids"].to_numpy()[r],
            "compared": np.where(j == 0, compared[i], 0), "verified": np.where(j == 0, verified[i], 0),
        })

    #: Rows of each cell, and the blocks that they are dealt in.
    rows_of = F.greatest(F.lit(LEAF_ROWS), F.lit(BLOCK_BYTES) / (8 * F.col("dim")))
    held_blocks = durable(indexed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.first(rows_of)).cast("int").alias("held")))  # one row a cell

    def run(asking: DataFrame) -> DataFrame:
        """Search each query in its column ``cell``: every block of queries meets every block of its vectors."""
        load = asking.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("asked"))
        load = F.broadcast(durable(load.join(held_blocks, ["dim", "cell"])))  # one row a cell: at most SAMPLE_ROWS / 32 a dimension

        def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
            block = F.pmod(F.xxhash64("uid", F.lit(SEED)), F.col(own)).cast("int").alias(f"{own}_block")
            each = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_block")
            return rows.join(load, ["dim", "cell"]).select(*rows.columns, block, each)

        keys = ["dim", "cell", "asked_block", "held_block"]
        return dealt(asking, "asked", "held").groupBy(*keys).cogroup(dealt(indexed, "held", "asked").groupBy(*keys)).applyInPandas(answer, found_schema)

    near = durable(run(queries))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "least")
    kth = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == depth)
    reach = queries.join(kth.select("uid", F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("bound")), "uid", "left")
    reach = reach.withColumn("bound", F.coalesce("bound", F.lit(math.inf)))

    def further(frames):
        for f in frames:
            i_all, cell_all = [], []
            for d in f["dim"].unique():
                here = np.flatnonzero(f["dim"] == d)
                open_ = tree.value[int(d)].gaps(project(_stack(f.iloc[here]))) <= limit * f["bound"].to_numpy()[here][:, None]
                open_[np.arange(len(here)), f["cell"].to_numpy()[here]] = False
                i, c = np.nonzero(open_)
                i_all.append(here[i])
                cell_all.append(c)
            yield f.iloc[np.concatenate(i_all)].assign(cell=np.concatenate(cell_all)) if i_all else f.iloc[:0]

    reach = durable(reach.mapInPandas(further, "uid long, vec array<double>, dim int, cell long, bound double"))
    more = durable(run(reach))
    best = near.unionByName(more).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= depth)
    lists = best.groupBy("uid").agg(F.collect_list(F.struct("score", "ids")).alias("best"))
    spent = near.unionByName(more).groupBy("uid").agg(F.sum("compared").alias("compared"), F.sum("verified").alias("verified"))
    lists = lists.join(spent, "uid")
    each = asked.join(queries.select("uid", "vec", "dim"), ["vec", "dim"]).select(F.col("vec_id").alias("query_id"), "uid").join(lists, "uid")
    flat = F.flatten(F.transform("best", lambda b: F.transform(b["ids"], lambda i: F.struct((-b["score"]).alias("s"), i.alias("i")))))
    ranked = F.slice(F.array_sort(F.filter(flat, lambda x: x["i"] != F.col("query_id"))), 1, k)
    return each.select("query_id", "compared", "verified", F.posexplode(ranked).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"), "compared", "verified"
    )
