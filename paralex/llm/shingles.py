"""Links of the SimHash operator at a Jaccard similarity of 0.8 or more over shingles.

A text is lower-cased and cut into words as the operator does, and is the set of its
shingles of five words (one shingle if it has fewer), held as 48-bit hashes.  Equal
sets are one node, whose SimHash fingerprint is that of the set.  Groups come first from
the operator's own links of fingerprints (``simhash.near_groups``): the nodes that chains
of a few bits join, in which every pair within those bits meets.  Other groups, for what
is farther apart, are the nodes that agree on one of ``BANDS`` bands of ``ROWS`` MinHash
values; a pair at 0.8 agrees on none with probability 3e-6, nearer pairs with less.  In
those only nodes whose fingerprints are within ``RADIUS`` bits are compared (a pair at 0.8
is farther with probability 1e-6, unlike ones in four of five cases).  Every link is
verified on the whole sets.

Nodes of a group are first compared with the least of them, one distinct pair at a
time.  Groups whose nodes are not all in one component by then are searched through
the Gray index, with the sets at hand: every pair of unlike components is verified, or
joined by others before its turn.  Those outside a group's largest
component ask all, dealt in pairs of blocks of about ``BLOCK_ROWS`` nodes, so that
memory is bounded and nothing is capped or dropped.
Only a spanning forest leaves a task.

Defined results: null and empty texts are equal, and unlike all others.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.llm.common import durable, join_spread, map_batches
from paralex.llm.components import components
from paralex.llm.folds import sampled
from paralex.llm.gray import GrayIndex, gray_rank, majority

WORDS, SEED = 5, 42
#: Similarity from which texts are linked, as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS = 32, 5
#: Bits of 64 that fingerprints of near sets may differ in.
RADIUS = 28
BLOCK_ROWS = 512
#: Nodes of the sample that shows which keys are frequent, and how often those occur in it.
SAMPLE_ROWS, OFTEN = 65_536, 64
_BYTES = 6
_FACTORS, _OFFSETS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    width = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    each = (digest(joined[i : j - 1], SEED) for i, j in zip([0, *ends[:-1]], ends[width - 1 :]))
    return np.unique(np.fromiter(each, np.uint64, len(found) - width + 1))


def short(values: np.ndarray) -> np.ndarray:
    """The hashes as a set of 48-bit numbers, sorted."""
    return np.unique(values & np.uint64((1 << 8 * _BYTES) - 1))


def pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    return out.view("<u8").ravel()


def band_keys(values: np.ndarray) -> list[int]:
    """A signed key of each band; none for an empty set."""
    if not len(values):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 256):
        np.minimum(least, (values[at : at + 256, None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    data = least.tobytes()
    keys = [xxhash.xxh64_intdigest(data[8 * ROWS * i : 8 * ROWS * (i + 1)], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar(both, a, b):
    """Whether sets of ``a`` and ``b`` members that share ``both`` are near enough."""
    return UNDER * both >= OVER * (a + b - both)


def set_links(sets: list[np.ndarray], label: np.ndarray, sims: np.ndarray, asks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Forest links that join the labels of ``sets`` wherever one that ``asks`` is near
    enough to another; ``sims`` are their fingerprints, compared within ``radius`` bits."""
    order = np.argsort(gray_rank(sims), kind="stable")
    index = GrayIndex(sims[order])
    _, label = np.unique(label[order], return_inverse=True)
    sets = [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    same = index.uniform(label)
    a, b = [], []
    for i in np.flatnonzero(asks[order]):
        _, other = index.search(np.array([i]), radius, label, same, later=False)
        other = other[(UNDER * size[other] >= OVER * size[i]) & (UNDER * size[i] >= OVER * size[other])]
        joined = False
        for j in other:  # one of each component that is met
            if label[j] != label[i] and similar(np.isin(sets[j], sets[i], assume_unique=True).sum(), size[j], size[i]):
                a.append(i)
                b.append(j)
                label[label == label[j]] = label[i]
                joined = True
        if joined:
            same = index.uniform(label)
    return order[np.array(a, np.int64)], order[np.array(b, np.int64)]


def prints_of(rows: DataFrame) -> DataFrame:
    """``doc_id, row, fp, sim, keys, members`` of ``doc_id, row, text``; ``fp`` is a hash of the
    set of shingles, ``sim`` its SimHash fingerprint."""

    def work(batches):
        for batch in batches:
            full = [hashes(t) for t in batch.column("text").to_pylist()]
            sim = np.array([majority(v) for v in full], np.uint64).view(np.int64)
            sets = [short(v) for v in full]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            more = [pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array([pack(s) for s in sets], pa.binary())]
            names = ["doc_id", "row", "fp", "sim", "keys", "members"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fp), pa.array(sim), *more], names=names)

    return map_batches(rows.select("doc_id", "row", "text"), work, "doc_id long, row long, fp long, sim long, keys array<long>, members binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (``a, b``, a written table) that are near enough.

    Fingerprints are compared first, so that sets move only for those within ``RADIUS``.
    """
    total = pairs.count()

    def beside(rows: DataFrame, *values: str) -> DataFrame:
        """``rows`` with ``values`` of both nodes.  A node meets at most BANDS others as ``b``, but any number as ``a``."""
        counts = rows.groupBy("a").agg(F.count("*").alias("n"))
        left = sets.join(counts, sets["fp"] == counts["a"]).select("a", "n", *(F.col(v).alias(f"a_{v}") for v in values))
        return join_spread(rows, durable(left), "a", "n", total).join(sets.select(F.col("fp").alias("b"), *(F.col(v).alias(f"b_{v}") for v in values)), "b")

    near = durable(beside(pairs, "sim").filter(F.bit_count(F.col("a_sim").bitwiseXOR(F.col("b_sim"))) <= RADIUS).select("a", "b"))

    def work(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("a_members").to_pylist(), batch.column("b_members").to_pylist()):
                x, y = unpack(x), unpack(y)
                good.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_batches(beside(near, "members").select("a", "b", "a_members", "b_members"), work, "a long, b long")


def _frequent(keyed: DataFrame, nodes: int) -> DataFrame:
    """Keys that many of the nodes may have, by a sample of ``SAMPLE_ROWS`` nodes; this decides
    only how rows are dealt.  There are at most SAMPLE_ROWS x (BANDS + 1) / OFTEN of them."""
    drawn = keyed.filter(sampled(F.col("fp"), SAMPLE_ROWS / max(1, nodes), SEED))
    return drawn.groupBy("key").count().filter(F.col("count") >= OFTEN).select("key")


def nodes_of(prints: DataFrame) -> DataFrame:
    """``fp, sim, keys`` of each set that has members."""
    return prints.select("fp", "sim", "keys").filter(F.size("keys") > 0).dropDuplicates(["fp"])


def similar_links(prints: DataFrame, nodes: DataFrame, groups: DataFrame, bits: int) -> DataFrame:
    """``a, b``: links between nodes that span all components.

    ``groups`` has ``fp, key`` of every node: groups in which nodes within ``bits`` bits meet.
    Two groups with one key would only be searched as one.  All three are written tables.
    """
    keyed = nodes.select("fp", F.explode("keys").alias("key"), F.lit(RADIUS).alias("bits"))
    keyed = keyed.unionByName(groups.select("fp", "key", F.lit(bits).alias("bits")))
    hot = durable(_frequent(keyed, nodes.count()))
    cold = keyed.join(F.broadcast(hot), "key", "left_anti").repartition("key")
    few = keyed.join(F.broadcast(hot), "key", "left_semi")
    band = (F.count("*").alias("size"), F.min("fp").alias("least"), F.max("bits").alias("radius"))
    # The rows of a frequent key stay where they are.
    met = [cold.join(cold.groupBy("key").agg(*band).filter("size > 1"), "key"), few.join(F.broadcast(durable(few.groupBy("key").agg(*band).filter("size > 1"))), "key")]
    met = durable(met[0].unionByName(met[1]))
    wanted = durable(met.select("fp").distinct())
    sets = durable(prints.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("sim").alias("sim"), F.first("members").alias("members")))
    pairs = met.filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    first = durable(verified(durable(pairs), sets))
    roots = components(first).withColumnRenamed("node", "fp")
    named = met.filter("size > 2").select("key", "fp", "radius").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = durable(named.select("key", "fp", "radius", "root"))
    # Of a group in several components, all but the members of the largest ask all.
    each = named.groupBy("key", "root").agg(F.count("*").alias("c"))
    torn = each.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("major"), F.count("*").alias("kinds")).filter("kinds > 1")
    parts = lambda c: F.ceil(c / F.lit(BLOCK_ROWS)).cast("int")
    torn = torn.select("key", "n", F.col("major.root").alias("major"), parts(F.col("n")).alias("all"), parts(F.col("n") - F.col("major.c")).alias("some"))
    rows = durable(join_spread(named, durable(torn), "key", "n", named.count()))
    own = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    each_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = rows.select("key", own("all").alias("j"), each_of("some").alias("i"), "fp", "radius", "root", F.lit(False).alias("asks"))
    asking = rows.filter("root <> major").select("key", own("some").alias("i"), each_of("all").alias("j"), "fp", "radius", "root", F.lit(True).alias("asks"))
    rows = asked.unionByName(asking).join(sets, "fp")
    keys = ["key", "i", "j"]

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def links(held):
        """Links of whole groups; one group's sets are unpacked at a time."""
        out_a, out_b = [], []
        table = pa.Table.from_batches(held)
        key = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in keys])
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        fp, root, sim, asks, radius = (table.column(c).to_numpy() for c in ("fp", "root", "sim", "asks", "radius"))
        for lo, hi in zip(starts, np.r_[starts[1:], len(key)]):
            if (root[lo:hi] == root[lo]).all():
                continue
            sets = [unpack(x) for x in table.column("members").slice(lo, hi - lo).to_pylist()]
            a, b = set_links(sets, root[lo:hi], sim[lo:hi].view(np.uint64), asks[lo:hi], int(radius[lo]))
            out_a.append(fp[lo:hi][a])
            out_b.append(fp[lo:hi][b])
        both = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (out_a, out_b)]
        return pa.RecordBatch.from_arrays(both, names=["a", "b"])

    def work(batches):
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])
            starts = np.flatnonzero(np.r_[now is None or (key[0] != now).any(), (key[1:] != key[:-1]).any(axis=1)])
            now = key[-1]
            if len(starts) and (held or starts[-1]):
                cut = int(starts[-1])
                done = [*held, *([batch.slice(0, cut)] if cut else [])]
                yield links(done)
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield links(held)

    rest = map_batches(dealt, work, "a long, b long")
    return first.unionByName(rest)
