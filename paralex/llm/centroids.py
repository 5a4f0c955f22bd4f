"""Clusters of vectors around centroids, by kd-tree filtering in exact integers.

Each task packs its vectors into blocks and builds a kd-tree of each; a node holds the
count, the sums and the box of its vectors.  In a round a node starts with the candidates
that its parent left: the one nearest to the middle of the box strictly dominates another
if even the corner of the box that favours the other most is nearer to it.  A node with one
candidate is assigned whole, by its count and sums; a leaf with more is resolved vector by
vector.  All of it is integer arithmetic, so the order of rows changes nothing.

A round moves one row of sums a centroid and task; the driver gets the summed ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.llm.common import durable, quoted, rebatched

#: Vectors of one tree, and of one of its leaves at most.
BLOCK_ROWS, LEAF_ROWS = 4_096, 16
#: Scaled components stay below this, so that squared distances fit in a long.
LARGEST = 1 << 26


@dataclass
class Tree:
    """A kd-tree over ``points`` (in the order of its leaves); node 0 is the root.

    Node i holds points ``start[i]`` to ``end[i]`` within ``low[i]`` to ``high[i]``, with
    componentwise ``sums[i]``; its children are ``child[i]`` and the next, or it is a leaf (0).
    """

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def build(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of ``points`` (integers, a row each) and the order that it puts them in.

    A node is cut at the median of its widest side; equal vectors are one leaf.
    """
    order, spans, child = np.arange(len(points)), [(0, len(points))], [0]
    low, high, sums = [], [], []
    at = 0
    while at < len(spans):
        start, end = spans[at]
        here = points[order[start:end]]
        low.append(here.min(axis=0))
        high.append(here.max(axis=0))
        sums.append(here.sum(axis=0, dtype=np.int64))
        sides = high[-1] - low[-1]
        if end - start > LEAF_ROWS and sides.any():
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(here[:, int(sides.argmax())], half)]
            child[at] = len(spans)
            spans += [(start, start + half), (start + half, end)]
            child += [0, 0]
        at += 1
    start, end = np.array(spans).T
    return Tree(points[order], start, end, np.array(child), np.array(low), np.array(high), np.array(sums)), order


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and the rows (or the row) ``b``."""
    apart = a - b
    return (apart * apart).sum(axis=-1)


def filtered(tree: Tree, centres: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``centre, node, start, end``: points ``start`` to ``end`` belong to a centre, all of
    ``node`` if that isn't -1.  Ties go to the smaller centre."""
    waiting = [(0, np.arange(len(centres)))]
    while waiting:
        node, some = waiting.pop()
        low, high = tree.low[node], tree.high[node]
        if len(some) > 1:
            mine = centres[some]
            best = mine[squares(2 * mine, low + high).argmin()]
            corner = np.where(mine > best, high, low)
            some = some[squares(mine, corner) <= squares(corner, best)]
        start, end = int(tree.start[node]), int(tree.end[node])
        if len(some) == 1:
            yield int(some[0]), node, start, end
        elif tree.child[node]:
            waiting += [(int(tree.child[node]), some), (int(tree.child[node]) + 1, some)]
        else:
            nearest = some[squares(tree.points[start:end, None], centres[some]).argmin(axis=1)]
            cuts = np.flatnonzero(np.diff(nearest)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), end - start]):
                yield int(nearest[a]), -1, start + a, start + b


BLOCK = "n int, nodes int, points binary, spans binary, boxes binary, sums binary"


def _packed(ids: pa.Array, points: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    tree, order = build(points)
    spans = np.stack([tree.start, tree.end, tree.child]).astype("<i4")
    boxes = np.stack([tree.low, tree.high]).astype("<i4")
    row = {
        "n": pa.array([len(points)], pa.int32()),
        "nodes": pa.array([len(tree.start)], pa.int32()),
        "points": pa.array([tree.points.astype("<i4").tobytes()], pa.binary()),
        "spans": pa.array([spans.tobytes()], pa.binary()),
        "boxes": pa.array([boxes.tobytes()], pa.binary()),
        "sums": pa.array([tree.sums.astype("<i8").tobytes()], pa.binary()),
        "ids": pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), ids.take(pa.array(order))).cast(kind),
    }
    return pa.RecordBatch.from_pydict(row)


def _trees(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, Tree]]:
    for row in range(batch.num_rows):
        held = {c: batch.column(c)[row].as_py() for c in ("n", "nodes", "points", "spans", "boxes", "sums")}
        get = lambda c, kind: np.frombuffer(held[c], kind).astype(np.int64)  # noqa: E731, B023
        start, end, child = get("spans", "<i4").reshape(3, -1)
        low, high = get("boxes", "<i4").reshape(2, -1, dims)
        yield row, Tree(get("points", "<i4").reshape(-1, dims), start, end, child, low, high, get("sums", "<i8").reshape(-1, dims))


def blocks(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """The kd-trees of all vectors (BLOCK, and ``ids`` in the order of the points)."""
    kind = vectors.schema[key].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0

        def closed() -> pa.RecordBatch:
            every = pa.concat_arrays(ids)
            return _packed(every, np.concatenate(parts), pa.list_(every.type))

        for batch in rebatched(batches, BLOCK_ROWS, 64 << 20):
            here = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            here = np.floor(scale * here.reshape(-1, dims))
            if (np.abs(here) >= LARGEST).any():
                raise ValueError(f"a component times {scale} is beyond {LARGEST}")
            if n and n + batch.num_rows > BLOCK_ROWS:
                yield closed()
                ids, parts, n = [], [], 0
            ids.append(batch.column(0))
            parts.append(here.astype(np.int64))
            n += batch.num_rows
        if n:
            yield closed()

    return vectors.select(quoted(key).alias("id"), quoted(vector).alias("v")).mapInArrow(work, f"{BLOCK}, ids array<{kind}>")


def sound(vector: str, dims: int):
    """Whether a vector has ``dims`` components, all of them finite."""
    v = quoted(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return v.isNotNull() & (F.size(v) == dims) & finite


def first_centres(kept: DataFrame, key: str, vector: str, k: int, scale: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of smallest digest of ``seed`` and id; of equal ids the smaller vector comes first."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(quoted(key).cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("h"), quoted(vector).cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    return np.array([np.floor(scale * np.array(r["v"])) for r in rows]).astype(np.int64)


def partial_sums(trees: DataFrame, centres: np.ndarray) -> DataFrame:
    """``cluster, n, sums``: one row a centroid and task that has vectors of it."""
    k, dims = centres.shape

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, tree in _trees(batch, dims):
                for centre, node, start, end in filtered(tree, centres):
                    n[centre] += end - start
                    sums[centre] += tree.sums[node] if node >= 0 else tree.points[start:end].sum(axis=0)
        held = np.flatnonzero(n)
        columns = [pa.array(held, pa.int32()), pa.array(n[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    return trees.drop("ids").mapInArrow(work, "cluster int, n long, sums array<long>")


def moved(trees: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round; those without vectors stay.  The driver gets a number a component."""
    parts = partial_sums(trees, centres).select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    total = F.sum(F.col("part").cast("decimal(38,0)"))
    out = centres.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), total.alias("total")).collect():
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def assigned(trees: DataFrame, centres: np.ndarray, key: str) -> DataFrame:
    """``key, cluster, distance`` of every vector."""
    kind = trees.schema["ids"].dataType.elementType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, tree in _trees(batch, centres.shape[1]):
                found = np.zeros(len(tree.points), np.int32)
                for centre, _, start, end in filtered(tree, centres):
                    found[start:end] = centre
                far = squares(tree.points, centres[found])
                ids = batch.column("ids").slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(found), pa.array(far)], names=["id", "cluster", "distance"])

    return trees.mapInArrow(work, f"id {kind}, cluster int, distance long").withColumnRenamed("id", key)


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:"
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every sound vector.

    Vectors that are null, have another length or hold a null or non-finite component take
    no part; a null id is kept, and hashed as the empty string.  Repeated rows count each.
    With fewer than ``k`` vectors there are as many centroids; without any, no rows.  Other
    columns aren't read.  A component of ``LARGEST / scale`` or more is an error.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(sound(vector, dims))
    centres = first_centres(kept, key, vector, k, scale, seed)
    facts = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centres):
        none = kept.select(quoted(key).alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.join(spark.createDataFrame([], facts), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    trees = durable(blocks(kept, key, vector, dims, scale))
    for _ in range(rounds):
        now = moved(trees, centres)
        if (now == centres).all():
            break  # nothing can change any more
        centres = now
    out = durable(assigned(trees, centres, key))
    sums = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    rows = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    return out.join(F.broadcast(spark.createDataFrame(rows, facts)), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
