"""The trie of conversations' prefixes, by a Patricia tree of their sorted turns.

1. Turns are numbered by one global sort, so no conversation has to fit a task; then
   conversations are rebuilt from the head of another one and their own turns.
2. A conversation is a sequence of 128-bit digests, cut into segments of SEGMENT turns.  A
   segment belongs to the group of all that have the same turns before it.
3. Segments are sorted and dealt by range, so that a common first turn is spread.  Each task
   builds the Patricia tree of its stretch (``patricia``): branch, end and leaf points and
   compressed edges.  What stretches must know of each other is a few hundred bytes each.
4. Equal points are added up.  Sums over subtrees are sums over sequences: a sequence shares
   the steps that it has in common with the one before it, and adds a leaf if it parts from it.
5. Edges are expanded into their unary nodes, whose savings are suffix sums along the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paralex.llm.common import durable, join_spread, map_batches, quoted
from paralex.llm.patricia import STEP, Builder, Node, Sequence, Stretch, points_between

#: Turns of one segment.
SEGMENT = 64
#: Most turns that a conversation takes from another one, and how far apart these are.
HEADS, EVERY = 8, 5
#: Ids of one piece of a list of ends.
ENDS = 4_096

EMPTY = hashlib.sha256().hexdigest()


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, from 1 on in each ``group`` (never null) by ``order`` (written).

    One sort by range; only groups that reach over its parts, at most one a part, need what
    the parts before hold of them.  So a group of any size is dealt over many tasks.
    """
    names = [f.name for f in rows.schema.fields]
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(group).to_numpy()
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            first = np.repeat(start, np.diff(np.append(start, len(own))))
            index = np.arange(1, len(own) + 1) - first
            if last == own[0]:
                index[first == 0] += count
            last, count = own[-1], int(index[-1])
            yield batch.append_column("pos", pa.array(index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    sorted_rows = durable(ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(work, f"{fields}, _part int, pos long"))
    ends = sorted(sorted_rows.groupBy("_part").agg(F.min(group), F.max(group)).collect())
    spanning = sorted({a[2] for a, b in zip(ends, ends[1:]) if a[2] == b[1]})
    if not spanning:
        return sorted_rows.select(*names, "pos")
    spark = rows.sparkSession
    kind = rows.schema[group].dataType.simpleString()
    some = sorted_rows.join(F.broadcast(spark.createDataFrame([(g,) for g in spanning], f"`{group}` {kind}")), group)
    offsets, held = [], {}
    for part, g, n in sorted(some.groupBy("_part", group).agg(F.max("pos")).collect()):
        offsets.append((part, g, held.get(g, 0)))
        held[g] = held.get(g, 0) + n
    offset = F.broadcast(spark.createDataFrame(offsets, f"_part int, `{group}` {kind}, _o long"))
    out = sorted_rows.join(offset, ["_part", group], "left")
    return out.select(*names, (F.col("pos") + F.coalesce("_o", F.lit(0))).alias("pos"))


def heads(c: Column) -> Column:
    """How many turns conversation ``c`` takes from the one it is rebuilt upon."""
    return (F.crc32(c.cast("string").cast("binary")) % (HEADS + 1)).cast("long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``c, d, d1, d2, b``: the turns of rebuilt conversations (digests and bytes of the text),
    ``d`` from 1 on, and a row with a null ``d`` for each conversation without any."""
    t = durable(numbered(turns, "c", ["turn", "d1", "d2"]).drop("turn"))
    lengths = t.groupBy("c").agg(F.max("pos").alias("own"))
    facts = lengths.withColumns({"h": heads(F.col("c")), "r": F.col("c") - F.col("c") % EVERY})
    roots = lengths.filter(F.col("c") % EVERY == 0).select(F.col("c").alias("r"), F.col("own").alias("_of"))
    taken = F.least("h", F.coalesce("_of", F.lit(0)))
    facts = durable(facts.join(roots, "r", "left").withColumn("taken", taken).drop("_of"))
    first = t.filter((F.col("pos") <= HEADS) & (F.col("c") % EVERY == 0)).withColumnRenamed("c", "r")
    head = facts.select("c", "r", "taken").join(first, "r").filter("pos <= taken").select("c", F.col("pos").alias("d"), "d1", "d2", "b")
    total = facts.agg(F.sum("own")).first()[0] or 0
    own = join_spread(t, facts.select("c", "h", "taken", "own"), "c", "own", total).filter("pos > h")
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "d1", "d2", "b")
    no = F.lit(None).cast("long")
    bare = facts.filter((F.col("taken") == 0) & (F.col("own") <= F.col("h"))).select("c", no.alias("d"), no.alias("d1"), no.alias("d2"), no.alias("b"))
    return head.unionByName(own).unionByName(bare)


def segments(turns: DataFrame, size: int) -> DataFrame:
    """``c, j, g1, g2, q1, q2, key, sizes, ends``: segment ``j`` of each conversation with its
    group (what comes before it) and the group after it, and whether the conversation ends in it."""
    j = F.coalesce(F.floor((F.col("d") - 1) / size), F.lit(0)).cast("int")
    listed = F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "d1", "d2", "b"))))
    rows = turns.withColumn("j", j).groupBy("c", "j").agg(listed.alias("e"))
    both = F.transform("e", lambda x: F.concat(F.lpad(F.hex(x["d1"]), 16, "0"), F.lpad(F.hex(x["d2"]), 16, "0")))
    rows = rows.select("c", "j", F.unhex(F.array_join(both, "")).alias("key"), F.transform("e", lambda x: x["b"]).alias("sizes"))
    by = Window.partitionBy("c").orderBy("j")
    out = rows.withColumn("ends", F.lead("j").over(by).isNull())
    for n, mark in ((1, F.xxhash64("j", "key")), (2, F.xxhash64(F.lit(11), "key", "j"))):
        number = mark.cast("decimal(20,0)")
        until = F.sum(number).over(by.rowsBetween(Window.unboundedPreceding, -1)).cast("decimal(38,0)")
        within = F.sum(number).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(38,0)")
        out = out.withColumn(f"g{n}", F.xxhash64(F.lit(n), F.coalesce(until, F.lit(0).cast("decimal(38,0)")))).withColumn(f"q{n}", F.xxhash64(F.lit(n), within))
    return out


ORDER = ["part", "g1", "g2", "key", "c"]


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Sequence]]:
    """``part`` and sequence of each row; ``more`` has the group after it, ``j`` and ``ends``."""
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        none = [0] * batch.num_rows
        below = zip(columns.get("below_saved", none), columns.get("below_leaves", none))
        values = zip(*(columns[n] for n in ("part", "g1", "g2", "key", "sizes", "c", "q1", "q2", "j", "ends")), below)
        for part, g1, g2, key, sizes, c, q1, q2, j, ends, (saved, leaves) in values:
            yield part, Sequence((g1, g2), key, sizes, c, saved, leaves, ((q1, q2), j, ends))


def _id(s: Sequence, depth: int, size: int) -> tuple[int, int]:
    """The node at ``depth`` of a segment; the last one of a full segment is the group after it."""
    if not depth:
        return s.group
    if depth == size:
        return s.more[0]
    head = np.array(s.group, "<i8").tobytes()
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(head + s.key[: depth * STEP]), "<i8").tolist())


STRETCH = "part int, first_key binary, first_g array<long>, last_key binary, last_g array<long>, on_first array<int>, on_last array<int>"


def _stretches(rows: DataFrame) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = builder = first = None
        marks: set[int] = set()

        def closed() -> pa.RecordBatch:
            on_last = [p.depth for p in builder.open]
            marks.update(n.point.depth for n in builder.end() if n.point.head)
            last = builder.now
            values = now, first.key, list(first.group), last.key, list(last.group), sorted(marks), on_last
            kinds = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            names = ["part", "first_key", "first_g", "last_key", "last_g", "on_first", "on_last"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for part, s in _read(batches):
            if part != now:
                if builder:
                    yield closed()
                now, builder, first, marks = part, Builder(), s, set()
            marks.update(n.point.depth for n in builder.add(s) if n.point.head)
        if builder:
            yield closed()

    return rows.mapInArrow(work, STRETCH)


def _built(batches: Iterable[pa.RecordBatch], known: dict) -> Iterator[tuple[Builder, Sequence | None, list[Node]]]:
    """Each sequence with its builder, after it was added, and the nodes that were complete then."""
    now = builder = None
    for part, s in _read(batches):
        if part != now:
            if builder:
                yield builder, None, list(builder.end())
            now, builder = part, Builder(*known[part])
        done = list(builder.add(s))
        yield builder, s, done
    if builder:
        yield builder, None, list(builder.end())


def _below(rows: DataFrame, known: dict) -> DataFrame:
    """``c, j, below_saved, below_leaves``: what the segments after ``j`` of a conversation share and add."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for builder, s, _ in _built(batches, known):
            if s is not None and s.more[1]:
                out.append((s.owner, s.more[1], builder.total[max(0, builder.shared)], int(builder.parts)))
            if out and (s is None or len(out) >= 4096):
                yield pa.RecordBatch.from_pylist([dict(zip(("c", "j", "saved", "leaves"), r)) for r in out], pa.schema([("c", pa.int64()), ("j", pa.int32()), ("saved", pa.int64()), ("leaves", pa.int64())]))
                out = []

    found = durable(rows.mapInArrow(work, "c long, j int, saved long, leaves long"))
    zero = F.lit(0).cast("long")
    found = found.unionByName(found.filter("j = 1").select("c", F.lit(0).alias("j"), zero.alias("saved"), zero.alias("leaves")))
    after = Window.partitionBy("c").orderBy("j").rowsBetween(1, Window.unboundedFollowing)
    sums = {f"below_{n}": F.coalesce(F.sum(n).over(after), zero) for n in ("saved", "leaves")}
    return found.withColumns(sums).select("c", "j", *sums)


POINT = "q1 long, q2 long, p1 long, p2 long, depth long, edge array<long>, n long, low long, saved long, leaves long, children long, owner long"


def _points(rows: DataFrame, known: dict, size: int) -> DataFrame:
    """POINT: partial nodes, and rows with ``owner``, a conversation that ends at a node."""
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] + [pa.int64()] * 6
    names = [f.split()[0] for f in POINT.split(", ")]

    def row(node: Node) -> tuple:
        s, p = node.of, node.point
        mine, j = _id(s, node.depth, size), s.more[1]
        if not node.depth and j:  # the rest is said by the last node of the segment before
            return (*mine, None, None, None, None, 0, None, 0, 0, p.children, None)
        parent = _id(s, node.parent_depth, size) if node.depth else (None, None)
        return (*mine, *parent, j * size + node.depth, node.edge, p.n, p.low, p.saved, p.leaves, p.children, None)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, s, nodes in _built(batches, known):
            out += map(row, nodes)
            if s is not None and s.more[2]:
                out.append((*_id(s, len(s.key) // STEP, size), *[None] * 9, s.owner))
            if out and (s is None or len(out) >= 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []

    return rows.mapInArrow(work, POINT)


def _digests(ends: DataFrame) -> DataFrame:
    """``q1, q2, ends_sha256`` of the ascending ids ``owner`` of each node.

    The digest of a list is a chain, so one task has to see the ids of a node in order; they
    come to it joined in pieces of ENDS ids, and it holds one piece.
    """
    piece = F.floor(F.col("owner") / ENDS)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("owner")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("q1", "q2", piece.alias("piece")).agg(text.alias("ids"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()

        def closed(keys: list) -> pa.RecordBatch:
            q1, q2, text = zip(*keys)
            return pa.RecordBatch.from_arrays([pa.array(q1, pa.int64()), pa.array(q2, pa.int64()), pa.array(text)], names=["q1", "q2", "ends_sha256"])

        for batch in batches:
            done = []
            for q1, q2, ids in zip(*(batch.column(n).to_pylist() for n in ("q1", "q2", "ids"))):
                if (q1, q2) != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (q1, q2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield closed(done)
        if now:
            yield closed([(*now, digest.hexdigest())])

    return map_batches(pieces.repartition("q1", "q2").sortWithinPartitions("q1", "q2", "piece"), work, "q1 long, q2 long, ends_sha256 string")


def expanded(nodes: DataFrame) -> DataFrame:
    """A row for every step of the edges of ``nodes``; the root has an edge of none but stays."""
    steps = F.size("edge")
    suffix = lambda x: F.aggregate(F.slice("edge", x, F.greatest(steps - x, F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    out = nodes.withColumn("x", F.explode(F.sequence(F.least(steps, F.lit(1)), steps)))
    own = F.col("x") == steps
    shared = F.when(own, F.lit(0)).otherwise(suffix(F.greatest(F.col("x"), F.lit(1))))
    return out.select(
        F.col("low").alias("conv_id"),
        (F.col("depth") - steps + F.col("x")).alias("depth"),
        F.when(F.col("x") <= 1, F.col("above")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(own, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * shared).alias("saved_tokens"),
        F.when(own, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` of every node of the rebuilt conversations' trie.

    Turns of one number follow each other in the order of a digest of role and text, and
    repeated rows are repeated turns; null turns come first; null roles and texts are empty.
    Rows without ``conv_id`` belong to no conversation and take no part.  Ids are longs, and
    ``c % 5`` has the sign of ``c``.  An empty table gives no rows.  Other columns aren't read.
    """
    role, text = (F.coalesce(quoted(n).cast("string"), F.lit("")) for n in ("role", "text"))
    turns = conversations.select(
        quoted("conv_id").cast("long").alias("c"), quoted("turn").alias("turn"),
        F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(11), text, role).alias("d2"), F.octet_length(text).cast("long").alias("b"),
    ).filter("c is not null")
    cut = durable(segments(rebuilt(turns), size))
    rows = durable(cut.repartitionByRange("g1", "g2", "key", "c").withColumn("part", F.spark_partition_id()))
    parts, last = rows.agg(F.count_distinct("part"), F.max("j")).first()
    dealt = rows.repartition(max(1, parts), "part").sortWithinPartitions(*ORDER)
    found = sorted(_stretches(dealt).collect())
    whole = [Stretch((tuple(r["first_g"]), bytes(r["first_key"])), (tuple(r["last_g"]), bytes(r["last_key"])), frozenset(r["on_first"]), frozenset(r["on_last"])) for r in found]
    known = dict(zip((r["part"] for r in found), points_between(whole)))
    if last:
        rows = durable(rows.join(_below(dealt, known), ["c", "j"], "left").fillna(0, ["below_saved", "below_leaves"]))
        dealt = rows.repartition(parts, "part").sortWithinPartitions(*ORDER)
    points = durable(_points(dealt, known, size))
    added = {n: F.sum(n).alias(n) for n in ("n", "saved", "leaves", "children")}
    same = [F.max(n).alias(n) for n in ("p1", "p2", "depth")] + [F.first("edge", ignorenulls=True).alias("edge"), F.min("low").alias("low")]
    nodes = points.filter("owner is null").groupBy("q1", "q2").agg(*same, *added.values())
    nodes = durable(nodes.join(_digests(points.filter("owner is not null").select("q1", "q2", "owner")), ["q1", "q2"], "left"))
    up = F.struct("p1", "p2").alias("up")
    above = nodes.filter("children > 0").select(F.struct("q1", "q2").alias("up"), F.col("low").alias("above"), F.col("children").alias("_n"))
    below = join_spread(nodes.filter("p1 is not null").withColumn("up", up), above, "up", "_n", nodes.count())
    root = nodes.filter("p1 is null").withColumn("above", F.lit(None).cast("long"))
    return expanded(below.select(*nodes.columns, "above").unionByName(root))
