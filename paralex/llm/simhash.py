"""Operator 5: near-duplicate documents by SimHash, with a Gray-order index.

Fingerprints: texts are lower-cased (A-Z), cut into words and shingles of four
words, and a bit is 1 if it is set in over half of the shingles' XXH64 values.

Links: equal fingerprints are one node.  For up to ``distance`` differing bits,
a fingerprint cut into blocks must agree with its partner on some choice of
blocks, so nodes meet in groups keyed by the bits of each choice.  Inside a
group the fingerprints are sorted by Gray rank and indexed: leaves of
neighbours, whose shared bits are factored into upper nodes.  A search descends
level by level, adding the differences on the bits that a node has beyond its
parent, and drops a whole node once the sum exceeds the distance, or if all it
holds is already linked to the searcher.  Only a spanning forest leaves a group.

A group over ``GROUP_ROWS`` fingerprints is dealt anew by five blocks of the
bits that its key leaves open, and so are groups of those, until every one fits;
pairs within the distance still meet in one of them.  Each time a fifth of the open
bits is settled, so at most seven rounds leave 14 bits, which 16,384 fingerprints
fill.  Nothing is capped or dropped.

``one_of_similar`` takes these links as groups, adds others for what is farther apart,
and verifies the similarity of the texts' sets of shingles; see there.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; null ids take part in links, and a component of null ids alone has a
null id; repeated rows repeat; other columns are not read, or pass through
unchanged whatever their names.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paralex.llm import shingles
from paralex.llm.common import durable, join_spread, map_batches, quoted, unused
from paralex.llm.components import components
from paralex.llm.gray import GrayIndex, forest, gray_rank, majority

WORDS, DISTANCE, SEED = 4, 4, 42
GROUP_ROWS = 16_384
#: Groups up to this size are compared pair by pair, many groups at a time.
SMALL = 24
#: Fingerprints that search the index at once, and what their number times the group's
#: size may be: both bound the frontier.
SEARCH, FRONTIER = 1024, 1 << 23
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(accumulate((len(w) + 1 for w in found)))
    starts = [0, *ends[:-1]]
    width = min(words, len(found))
    spans = zip(starts, ends[width - 1 :])
    values = np.fromiter((_hash(joined[i : j - 1]) for i, j in spans), np.uint64, len(found) - width + 1)
    return majority(values)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp``; ``fp`` holds the fingerprint's bits as a signed long."""

    def work(batches):
        for batch in batches:
            values = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, fp long")


def group_forest(fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Label of each fingerprint of one group: the smallest index linked to it."""
    order = np.argsort(gray_rank(fps), kind="stable")
    index = GrayIndex(fps[order])
    n = len(fps)
    label = np.arange(n)
    # Neighbours in Gray order first: most of a dense group is linked by them.
    at = np.flatnonzero(np.bitwise_count(index.fps[1:] ^ index.fps[:-1]) <= distance)
    label = forest(n, at, at + 1)
    a, b = [], []
    at_once = max(16, min(SEARCH, FRONTIER // n))
    for i in range(0, n, at_once):
        x, y = index.search(np.arange(i, min(n, i + at_once)), distance, label, index.uniform(label))
        if len(x):
            a, b = label[x], label[y]
            root = forest(n, a, b)
            label = root[label]
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, np.int64)


def block_forest(key: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Forest links between the fingerprints of each group; equal keys are adjacent."""
    first = _starts(key)
    sizes = np.diff(np.r_[first, len(fps)])
    size_of = np.repeat(sizes, sizes)
    end_of = np.repeat(first + sizes, sizes)
    a, b = [], []
    small = np.flatnonzero((size_of <= SMALL) & (size_of > 1))
    for step in range(1, SMALL):
        small = small[small + step < end_of[small]]
        if not len(small):
            break
        hit = small[np.bitwise_count(fps[small] ^ fps[small + step]) <= distance]
        a.append(hit)
        b.append(hit + step)
    for k in np.flatnonzero(sizes > SMALL):
        at, n = first[k], sizes[k]
        label = group_forest(fps[at : at + n], distance)
        own = np.flatnonzero(label != np.arange(n))
        a.append(at + own)
        b.append(at + label[own])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = forest(len(fps), np.concatenate(a), np.concatenate(b))
    own = np.flatnonzero(label != np.arange(len(fps)))
    return fps[own], fps[label[own]]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` of ``blocks`` blocks of the given bits."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), blocks)]
    return [sum(c) for c in combinations(parts, agree)]


def _inner(mask: int, distance: int) -> list[int]:
    """Blocks of the bits that a mask leaves open; two fingerprints of its group agree on one at least."""
    bits = [b for b in range(64) if not mask >> b & 1]
    return block_masks(bits, distance + 1, 1)


def choices(nodes: int, distance: int = DISTANCE) -> list[int]:
    """Masks that any two fingerprints within the distance agree on at least one of.

    More nodes take longer keys, so that groups of unlike fingerprints stay small.
    """
    for agree in (1, 2, 3, 4):
        blocks = distance + agree
        if 64 * agree / blocks >= np.log2(max(nodes, 2)) - 1:
            break
    return block_masks(list(range(64)), blocks, agree)


def near_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: forest links between distinct fingerprints (column ``fp``)."""

    def keyed(rows: DataFrame, masks: Column) -> DataFrame:
        spread = rows.select("fp", F.explode(masks).alias("mask"))
        return spread.select("fp", F.struct("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).alias("group"))

    masks = choices(nodes.count(), distance)
    most = max(GROUP_ROWS, 1 << distance)  # a larger group leaves over ``distance`` bits open
    rows = keyed(nodes, F.array(*(F.lit(_signed(m)) for m in masks)))
    fitting = []
    while True:
        sizes = durable(rows.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > 1).withColumn("rows", F.col("n")))
        # Groups of one have nothing to link; large ones are dealt anew, until all fit.
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        sized = join_spread(rows, sizes, "group", "rows", total)
        fitting.append(sized.filter(F.col("n") <= most).select("fp", "group"))
        # Masks, not groups: their number follows from the choices and the depth alone.
        large = [r[0] for r in sizes.filter(F.col("n") > most).select("group.mask").distinct().collect()]
        if not large:
            break
        finer = [(m, [_signed(m % (1 << 64) | block) for block in _inner(m, distance)]) for m in large]
        finer = F.broadcast(nodes.sparkSession.createDataFrame(finer, "of long, finer array<long>"))
        again = sized.filter(F.col("n") > most).select("fp", F.col("group.mask").alias("of")).join(finer, "of")
        rows = durable(keyed(again, F.col("finer")).distinct())
    dealt = reduce(DataFrame.unionByName, fitting).select("group.mask", "group.key", "fp")
    dealt = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key")

    def work(batches):
        def links(k, f):
            a, b = block_forest(k, f, distance)
            a, b = a[a != b], b[a != b]  # a group may come from two rounds
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.column_stack([batch.column(c).to_numpy() for c in ("mask", "key")])
            f = batch.column("fp").to_numpy().view(np.uint64)
            held.append((k, f))
            if (k[0] == k[-1]).all() and (held[0][0][0] == k[0]).all():
                continue  # one group so far
            key, fps = np.vstack([x for x, _ in held]), np.concatenate([x for _, x in held])
            cut = _starts(key)[-1]
            yield links(key[:cut], fps[:cut])
            held = [(key[cut:], fps[cut:])]
        if held:
            yield links(np.vstack([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return map_batches(dealt, work, "a long, b long", rows=65_536)


def linked(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``prints`` (``doc_id, fp``) with ``component_id``.

    ``prints`` is read several times and should be a written table.
    """
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    roots = components(near_links(nodes, distance))
    rooted = durable(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")))
    total, every = rooted.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    known = durable(join_spread(rooted.select("root", "fp", "rows"), ids, "root", "nodes", total).select("fp", "component_id", "rows"))
    return join_spread(prints, known, "fp", "rows", every)


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    out = linked(durable(fingerprints(docs, words)), distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*(quoted(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))


def one_of_each(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with the row of the smallest id (null last) of each component only.

    Rows are told apart by their id and a hash of all their columns; of rows
    equal in everything one stays.
    """

    def work(batches):
        for batch in batches:
            values = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), fp], names=["doc_id", "row", "fp"])

    prints = durable(map_batches(docs.select("doc_id", _row_hash(docs).alias("row"), "text"), work, "doc_id long, row long, fp long"))
    return first_of_each(docs, prints, components(near_links(durable(prints.select("fp").distinct()), distance)))


def near_groups(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp, key`` of ``fp, sim``: the component of links within ``distance`` bits that the
    fingerprint ``sim`` is in, so that all nodes within that distance meet.

    ``nodes`` is a written table.
    """
    sims = durable(nodes.groupBy("sim").agg(F.count("*").alias("rows")))
    roots = components(near_links(sims.select(F.col("sim").alias("fp")), distance))
    known = durable(sims.join(roots.withColumnRenamed("node", "sim"), "sim", "left").select("sim", "rows", F.coalesce("root", "sim").alias("key")))
    return durable(join_spread(nodes.select("fp", "sim"), known, "sim", "rows", nodes.count()).select("fp", "key"))


def one_of_similar(docs: DataFrame) -> DataFrame:
    """As ``one_of_each``, where texts are linked if their sets of five-word shingles have a
    Jaccard similarity of 0.8 or more.

    Groups are dealt by blocks of fingerprints and searched through the Gray index as in
    ``near_duplicates``.  Fingerprints of two sets at 0.8 differ in 9.7 bits of 64 in the mean
    and in up to 28, far beyond what blocks of equal bits can find, so MinHash bands deal
    more groups, in which the Gray index finds those within ``shingles.RADIUS`` bits.  Each
    pair that either finds is verified on the whole sets.
    """
    prints = durable(shingles.prints_of(docs.select("doc_id", _row_hash(docs).alias("row"), "text")))
    nodes = durable(shingles.nodes_of(prints))
    links = shingles.similar_links(prints, nodes, near_groups(nodes), DISTANCE)
    return first_of_each(docs, prints.select("doc_id", "row", "fp"), components(links))


def first_of_each(docs: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """The row of the smallest id (null last) of each component of ``roots``.

    ``prints`` (a written table) has ``doc_id, row, fp`` of every row.  All is decided on
    narrow rows; then the rows that go, usually far fewer than those that stay, are taken
    from ``docs``, whose texts move only where the list of those is too long to broadcast.
    """
    order = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "row")
    nodes = prints.groupBy("fp").agg(F.min(order).alias("least"))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    kept = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.doc_id").alias("id"), F.col("least.row").alias("row"), F.lit(True).alias("stays"))
    each = prints.groupBy(F.col("doc_id").alias("id"), "row").agg(F.count("*").alias("n"))
    each = each.alias("e").join(kept.alias("k"), (F.col("e.row") == F.col("k.row")) & F.col("e.id").eqNullSafe(F.col("k.id")), "left")
    # Rows that go, and rows equal in everything of which one stays.
    out = durable(each.select("e.id", "e.row", "n", F.col("stays").isNotNull().alias("stays")).filter("not stays or n > 1"))
    total, again = out.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("stays"), 1))).first()
    key, number = unused([*docs.columns, "id", "row", "n", "stays"], "key", "number")
    marked = docs.withColumn(key, _row_hash(docs))
    hot = F.col("n") > max(64, total // 1024)  # true of at most 1,024 keys

    def same(keys: DataFrame):
        return (marked[key] == keys["row"]) & marked["doc_id"].eqNullSafe(keys["id"])

    few, rest = F.broadcast(out.filter(hot)), out.filter(~hot)
    left = marked.join(few, same(few), "left_anti")
    stay = left.join(rest, (left[key] == rest["row"]) & left["doc_id"].eqNullSafe(rest["id"]), "left_anti").drop(key)
    if not again:
        return stay
    # The number of equal rows is limited to one in each task before they meet.
    once = Window.partitionBy(key, "doc_id").orderBy(F.lit(0))
    for part in (F.broadcast(out.filter(hot & F.col("stays"))), out.filter(~hot & F.col("stays"))):
        copies = marked.join(part, same(part), "left_semi")
        stay = stay.unionByName(copies.withColumn(number, F.row_number().over(once)).filter(F.col(number) == 1).drop(key, number))
    return stay
