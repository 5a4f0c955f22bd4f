"""Removal of byte strings that occur more than once, by sorted suffixes.

1. Windows of ``length`` bytes are told apart by their anchors (``anchors``).  A window
   repeats only if the core at its anchor does, so segments whose core occurs once go.
2. Segments that are equal as a whole repeat with all their windows; one stays as a witness.
3. The suffix from the anchor of every different segment whose core others share is sorted:
   tasks exchange front-coded sorted runs, and each part of cores merges its own by a tree
   of losers that compares no known prefix again (``merging``).  What neighbours share to the
   right, and the same of the bytes before the anchor, gives the windows that repeat, exactly.
4. A core in more than GROUP segments is cut anew: its segments into blocks of STEPS windows,
   whose core is all that the windows of a block have in common, down to single windows.
   So no group outgrows a task, whatever the data.  Cores that a sample shows to be common
   are dealt over many tasks from the start.

Texts are known by two hashes (128 bits), so equal ones are worked on once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paralex.llm.anchors import CORE, core_hashes, segments
from paralex.llm.common import durable, join_spread, map_batches, quoted
from paralex.llm.merging import common as shared_bytes
from paralex.llm.merging import merge, write_run

#: Different segments of one core that one task compares.
GROUP = 4_096
#: Windows of a block, where a core has more segments than that.
STEPS = (16, 1)
#: Bytes of segments of one part, and of one task's runs at a time.
PART_BYTES, RUN_BYTES = 8 << 20, 16 << 20

#: Share of the rows that tell which cores are common, and how common.
SAMPLE, HOT = 1 / 64, 1 / 1024

PLACE = "k1 long, k2 long, at long, shape int"
KEY = ["k1", "k2"]


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the hashes ``k1, k2`` of the text and its bytes ``_b``; null is empty."""
    t = F.coalesce(quoted(text), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit(11), t), "_b": t.cast("binary")})


def different(docs: DataFrame) -> DataFrame:
    """``k1, k2, _b, copies`` of each different text, put together before it moves."""
    return docs.groupBy(*KEY).agg(F.first("_b").alias("_b"), F.count("*").alias("copies"))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _shape(left: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Bytes before the anchor and the number of windows, in one number."""
    return (left << 16 | span).astype(np.int32)


def found_segments(docs: DataFrame, length: int) -> DataFrame:
    """``h`` (core), ``s`` (whole segment), place, and ``n`` (equal texts at hand) of every segment."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            _, own, n = np.unique(np.stack([k1, k2]), axis=1, return_index=True, return_counts=True)
            texts = batch.column("_b")
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            held = np.zeros(len(texts), np.int32)
            held[own] = n
            starts, ends = offsets[:-1], np.where(held > 0, offsets[1:], offsets[:-1])
            lowest = int(starts[0])
            if int(offsets[-1]) - lowest < length:
                continue
            view = memoryview(data)
            for text, first, last, anchor in segments(data[lowest : int(offsets[-1])], starts - lowest, ends - lowest, length):
                if not len(text):
                    continue
                first, last, anchor = first + lowest, last + lowest, anchor + lowest
                left = anchor - first
                whole = [xxhash.xxh3_64_intdigest(view[a:b], seed=c) for a, b, c in zip(first.tolist(), (last + length).tolist(), left.tolist())]
                yield _batch(
                    h=core_hashes(data, anchor).view(np.int64), s=np.array(whole, np.uint64).view(np.int64), k1=k1[text], k2=k2[text],
                    at=first - starts[text], shape=_shape(left, last - first + 1), n=held[text],
                )

    return map_batches(docs.select("k1", "k2", "_b"), work, f"h long, s long, {PLACE}, n int")


def frequent(sample: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Cores ``h`` with more than HOT of a sample's segments, and segments as common as that.

    These are at most 1 / HOT each.  They only decide how rows are dealt: whatever the sample
    misses costs time and changes no result.
    """
    place = F.struct(*[c for c in sample.columns if c not in ("h", "s", "n")]).alias("place")
    counted = durable(sample.groupBy("h", "s").agg(F.sum("n").alias("m"), F.min(place).alias("place")))
    least = max(16, int((counted.agg(F.sum("m")).first()[0] or 0) * HOT))
    cores = durable(counted.groupBy("h").agg(F.sum("m").alias("m")).filter(F.col("m") > least).select("h"))
    if cores.isEmpty():
        return None
    return cores, durable(counted.filter(F.col("m") > least).select("h", "s", "place.*"))


def judged(rows: DataFrame, common: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The segments whose core occurs again.  ``twice``: the whole segment does; ``witness``:
    the first of its kind, where the core is in ``kinds`` different ones (more than one).

    Of ``frequent`` segments it is known that they do, so their rows are dealt by place, and
    one of each stands for them; the other segments of frequent cores are dealt by segment,
    and count as more than GROUP kinds.
    """
    if common:
        cores, pairs = common
        known = pairs.withColumns({"n": F.lit(2), "_sure": F.lit(False), "_often": F.lit(True)})
        often, sure = (F.broadcast(d.withColumn(n, F.lit(True))) for d, n in ((cores, "_often"), (pairs.select("h", "s"), "_sure")))
        flags = {n: F.coalesce(n, F.lit(False)) for n in ("_sure", "_often")}
        rows = rows.join(often, "h", "left").join(sure, ["h", "s"], "left").withColumns(flags).unionByName(known)
        apart = F.when(F.col("_sure"), -1 - F.pmod(F.xxhash64("k1", "at"), F.lit(4_096))).when(F.col("_often"), 1 + F.pmod(F.col("s"), F.lit(4_096)))
        rows = rows.withColumn("_salt", F.coalesce(apart, F.lit(0)))
    else:
        rows = rows.withColumns({"_sure": F.lit(False), "_often": F.lit(False), "_salt": F.lit(0)})
    core, whole = Window.partitionBy("h", "_salt"), Window.partitionBy("h", "_salt", "s")
    first = (F.row_number().over(whole.orderBy("k1", "k2", "at", "shape")) == 1) & ~F.col("_sure")
    out = rows.repartition("h", "_salt").withColumn("_first", first)
    out = out.withColumn("twice", F.col("_sure") | (F.sum("n").over(whole) > 1))
    kinds = F.when(F.col("_often"), GROUP + 1).otherwise(F.sum(F.col("_first").cast("long")).over(core))
    out = out.withColumns({"kinds": kinds, "_n": F.sum("n").over(core)}).filter("_n > 1 or _often")
    return out.withColumn("witness", F.col("_first") & (F.col("kinds") > 1)).drop("_first", "_n", "n", "_sure", "_often", "_salt")


def witnesses(texts: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """The bytes ``seg`` of every witness, with its core ``h``, place and ``kinds``."""
    places = marked.filter("witness").groupBy(*KEY).agg(F.collect_list(F.struct("h", "at", "shape", "kinds")).alias("_p"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("_p")
            per, flat = np.diff(wanted.offsets.to_numpy()), wanted.flatten()
            text = np.repeat(np.arange(batch.num_rows), per)
            h, at, shape, kinds = (flat.field(i) for i in range(4))
            bodies = batch.column("_b").to_pylist()
            ends = at.to_numpy() + (shape.to_numpy() & 0xFFFF) + length - 1
            seg = [bodies[i][a:b] for i, a, b in zip(text.tolist(), at.to_pylist(), ends.tolist())]
            k1, k2 = (batch.column(k).to_numpy()[text] for k in KEY)
            yield _batch(h=h, k1=k1, k2=k2, at=at, shape=shape, kinds=kinds, seg=pa.array(seg, pa.binary()))

    return map_batches(texts.join(places, KEY).select(*KEY, "_b", "_p"), work, f"h long, {PLACE}, kinds long, seg binary")


def finer(rows: DataFrame, length: int, step: int) -> DataFrame:
    """The segments ``rows`` cut into blocks of ``step`` windows, as ``found_segments`` with ``seg``.

    Blocks are laid from the anchor, so windows that are equal are in blocks of one number,
    and these share the bytes that all windows of that number cover.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("h", "s", "k1", "k2", "at", "shape", "n", "seg")}
            for k1, k2, at, shape, seg in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "at", "shape", "seg"))):
                left, span = shape >> 16, shape & 0xFFFF
                for block in range((left - span + 1) // step, left // step + 1):
                    high, low = min(left, (block + 1) * step - 1), max(left - span + 1, block * step)
                    here = seg[left - high : left - low + length]
                    core = seg[left - block * step : left - (block + 1) * step + 1 + length]
                    h, s = xxhash.xxh3_64_intdigest(core, seed=block), xxhash.xxh3_64_intdigest(here, seed=high)
                    values = h - (h >> 63 << 64), s - (s >> 63 << 64), k1, k2, at + left - high, high << 16 | high - low + 1, 1, here
                    for column, value in zip(out.values(), values):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
            yield _batch(**{k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds)})

    return map_batches(rows.select("k1", "k2", "at", "shape", "seg"), work, f"h long, s long, {PLACE}, n int, seg binary")


def _runs(rows: DataFrame, parts: int) -> DataFrame:
    """``part, run``: the sorted suffixes of a task's segments, for each part of the cores."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def closed() -> pa.RecordBatch:
            held.sort()
            out: dict[int, list] = {}
            for part, suffix, more in held:
                out.setdefault(part, []).append((suffix, more))
            return _batch(part=pa.array(list(out), pa.int32()), run=pa.array([write_run(v) for v in out.values()], pa.binary()))

        for batch in batches:
            part = (batch.column("h").to_numpy().view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
            place = np.stack([batch.column(c).to_numpy().astype("<i8") for c in ("k1", "k2", "at", "shape")], axis=1)
            for p, where, shape, seg in zip(part.tolist(), place, place[:, 3].tolist(), batch.column("seg").to_pylist()):
                left = shape >> 16
                held.append((p, seg[left:], where.tobytes() + seg[:left][::-1]))
                size += len(seg)
            if size > RUN_BYTES:
                yield closed()
                held, size = [], 0
        if held:
            yield closed()

    return map_batches(rows.select("h", "k1", "k2", "at", "shape", "seg"), work, "part int, run binary", rows=4096)


def repeated(shared: np.ndarray, left: np.ndarray, span: np.ndarray, order: np.ndarray, shared_left: np.ndarray, length: int) -> np.ndarray:
    """Which windows repeat: a row a segment, a column for each number of bytes before the anchor.

    Segments are in the order of their suffixes, and ``shared`` is what each shares with the one
    before; ``order`` puts the bytes before the anchors in order, and ``shared_left`` is the same
    of these.  Two windows are equal if they agree on both sides, that is if no neighbour between
    them shares less than that.
    """
    n, most = len(shared), int(left.max()) + 1
    out = np.zeros((n, most), bool)
    before = np.empty(n, np.int64)
    for reach in range(most):
        some = np.flatnonzero((left - span < reach) & (reach <= left))
        if len(some) < 2:
            continue
        after = np.cumsum(shared < length - reach)
        before[order] = np.cumsum(shared_left < reach)
        kind = after[some] * (n + 1) + before[some]
        ranked = np.argsort(kind, kind="stable")
        same = kind[ranked][1:] == kind[ranked][:-1]
        out[some[ranked[1:][same]], reach] = True
        out[some[ranked[:-1][same]], reach] = True
    return out


def _windows_of_part(runs: list[bytes], length: int) -> pa.RecordBatch:
    shared, wheres, lefts = [], [], []
    for m, _, more in merge(runs):
        shared.append(m)
        wheres.append(more[:32])
        lefts.append(more[32:])
    shared = np.array(shared)
    group = np.cumsum(shared < CORE)  # segments of another core share less
    order = sorted(range(len(lefts)), key=lambda i: (group[i], lefts[i]))
    shared_left = np.array([-1] + [shared_bytes(lefts[a], lefts[b]) if group[a] == group[b] else -1 for a, b in zip(order, order[1:])])
    k1, k2, at, shape = np.frombuffer(b"".join(wheres), "<i8").reshape(-1, 4).T
    left, span = shape >> 16, shape & 0xFFFF
    found = repeated(shared, left, span, np.array(order), shared_left, length)
    # Windows in ascending order are bytes before the anchor in descending order.
    flat = np.zeros((len(found), found.shape[1] + 1), np.int8)
    flat[:, :-1] = found[:, ::-1]
    step = np.diff(flat.ravel(), prepend=0)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    row, column = np.divmod(begin, flat.shape[1])
    first = at[row] + left[row] - (found.shape[1] - 1 - column)
    return _batch(k1=k1[row], k2=k2[row], at=first, n=end - begin)


def compared(rows: DataFrame, length: int) -> DataFrame:
    """``k1, k2, at, n``: runs of ``n`` windows from ``at`` on that repeat, of segments with few of a core."""
    size = rows.agg(F.sum(F.length("seg"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, run in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist()):
                if part != now and held:
                    yield _windows_of_part(held, length)
                    held = []
                now = part
                held.append(run)
        if held:
            yield _windows_of_part(held, length)

    dealt = _runs(rows, parts).repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(work, "k1 long, k2 long, at long, n long")


def repeats(texts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """``k1, k2, runs``: all (``at``, ``n``) of every text that has windows which repeat (written)."""
    marked = durable(judged(found_segments(docs, length), frequent(found_segments(docs.sample(SAMPLE, 1), length))))
    whole = lambda m: m.filter("twice").select(*KEY, "at", F.col("shape").bitwiseAND(0xFFFF).cast("long").alias("n"))
    found = [whole(marked)]
    rows = durable(witnesses(texts, marked, length))
    for step in STEPS:  # of single windows, those with one core are equal as a whole
        found.append(compared(rows.filter(F.col("kinds") <= GROUP), length))
        hot = rows.filter(F.col("kinds") > GROUP)
        if hot.isEmpty():
            break
        marked = durable(judged(finer(hot, length, step), frequent(finer(hot.sample(SAMPLE, 1), length, step))))
        found.append(whole(marked))
        rows = marked.filter("witness")
    every = reduce(DataFrame.unionByName, found)
    return durable(every.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n")).alias("runs")))


def covered(n_bytes: int, runs: Iterable[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (start, end) that the windows cover."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(runs):
        end = min(n_bytes, at + n + length - 1)
        if out and at <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((at, end))
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, bodies: bool = True) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256, spans`` and, if ``bodies``, ``kept``.

    Every byte that lies in a string of ``length`` bytes which starts anywhere else too, in the
    same or another row, is removed; all is judged on the input.  ``spans`` are the removed
    runs (start, end) and ``kept`` the bytes that are left, which need not be valid UTF-8.
    Null texts are empty, and texts shorter than ``length`` stay whole; repeated rows are
    copies of each other; null and repeated keys are kept as they are; an empty table gives
    no rows; other columns aren't read.
    """
    if not 2 * CORE <= length < 1 << 15:
        raise ValueError(f"length must be from {2 * CORE} to {(1 << 15) - 1}")
    docs = keyed(docs.select(quoted(key).alias("_id"), quoted(text).alias("_t")), "_t").drop("_t")
    texts = different(docs)
    found = repeats(texts, docs, length)

    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>" + ", kept binary" * bodies
    kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * bodies]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, runs in zip(batch.column("_b").to_pylist(), batch.column("runs").to_pylist()):
                cut = covered(len(body), ((r["at"], r["n"]) for r in runs or ()), length)
                edges = [0, *(x for span in cut for x in span), len(body)]
                left = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                spans = [{"start": a, "end": b} for a, b in cut]
                rows.append((len(body), len(body) - len(left), len(cut), hashlib.sha256(left).hexdigest(), spans, left))
            made = {name: pa.array([r[i] for r in rows], kinds[i]) for i, name in enumerate(names)}
            yield _batch(k1=batch.column("k1"), k2=batch.column("k2"), copies=batch.column("copies"), **made)

    every = texts.join(found, KEY, "left").select(*KEY, "copies", "_b", "runs")
    done = durable(map_batches(every, work, f"k1 long, k2 long, copies long, {fields}"))
    whole = F.struct(*KEY).alias("_k")
    total = done.agg(F.sum("copies")).first()[0] or 0
    out = join_spread(docs.select("_id", whole), done.select(whole, "copies", *names), "_k", "copies", total)
    return out.select(F.col("_id").alias(key), *names)
