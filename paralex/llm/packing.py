"""Operator 2: packing token pieces into sequences, shortest pack first.

Texts are tokenised and cut into pieces of at most ``length`` ids.  Packing
looks only at the histogram of piece lengths: lengths are placed longest first,
each into the packs with most room, as counts of packing patterns.  Patterns
then become intervals of ranks per length, and every piece finds its sequence
by its rank among the pieces of its length.

Pieces are counted by length where they are cut, so a piece's rank is the number of
its length in earlier tasks and its place in its own.  The first is a table of (length,
task), broadcast up to a checked size; no piece is moved to be ranked.  The driver holds
the histogram (``length`` counts) and the patterns (a few thousand), whatever the input.

Defined results: null and empty texts are the end id alone; repeated rows are
packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paralex.llm import hf
from paralex.llm.common import durable, map_batches
from paralex.llm.pretokens import CACHE_WORDS

LENGTH = 2048
END_ID = 1
#: Most rows of the table of (length, task) that is broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences that hold ``times`` pieces of each ``length``, in order."""

    count: int
    parts: tuple[tuple[int, int], ...]  # (length, times)


def plan(histogram: dict[int, int], capacity: int = LENGTH) -> list[Pattern]:
    """Shortest-pack-first over the histogram."""
    room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    done: list[Pattern] = []

    def put(free: int, count: int, parts: tuple[tuple[int, int], ...]) -> None:
        if free:
            room.setdefault(free, []).append((count, parts))
        else:
            done.append(Pattern(count, parts))

    def more(parts, length, times):
        if parts and parts[-1][0] == length:
            return (*parts[:-1], (length, parts[-1][1] + times))
        return (*parts, (length, times))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max(room, default=0)
            if free < length:
                times = capacity // length
                if full := left // times:
                    put(capacity - times * length, full, ((length, times),))
                if rest := left % times:
                    put(capacity - rest * length, 1, ((length, rest),))
                break
            count, parts = room[free].pop()
            if not room[free]:
                del room[free]
            used = min(count, left)
            if used < count:
                put(free, count - used, parts)
            put(free - length, used, more(parts, length, 1))
            left -= used
    return done + [Pattern(n, parts) for groups in room.values() for n, parts in groups]


def intervals(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length rows ``first rank, sequences, first sequence, offset``, by rank."""
    rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for length, times in p.parts:
            at = rank.get(length, 0)
            out.setdefault(length, []).append((at, p.count, sequence, offset))
            rank[length] = at + p.count * times
            offset += length * times
        sequence += p.count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pieces(
    docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, with_ids: bool = True, narrow: bool = False,
    words: int = CACHE_WORDS,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, ids`` of every piece, in place, with
    ``task, rank``: its number among the pieces of its length that the task has cut.

    ``ids`` (little-endian 32-bit; 16-bit if ``narrow`` and the vocabulary and the end id
    allow) is left out if ``with_ids`` is false.  ``words`` bounds what the encoder remembers.
    """
    end = np.uint32(end_id).tobytes()

    def work(batches):
        from pyspark import TaskContext

        coder = hf.encoder(path, words)
        short = narrow and coder.width(end_id) == 2
        task, seen = TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in batches:
            ids_of = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            doc, start, size, crc, total, rank, kept = [], [], [], [], [], [], []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of):
                data = memoryview(ids + end)
                n = len(data) // 4
                for at in range(0, n, length):
                    part = data[4 * at : 4 * (at + length)]
                    own = len(part) // 4
                    doc.append(doc_id)
                    start.append(at)
                    size.append(own)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    rank.append(seen[own])
                    seen[own] += 1
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype("<u2").tobytes() if short else part.tobytes())
            columns = [pa.array(x, pa.int64()) for x in (doc, start, size, crc, total, [task] * len(doc), rank)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long" + ", ids binary" * with_ids
    return map_batches(docs.select("doc_id", "text"), work, schema)


def place(cut: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """``cut`` (as of ``pieces``) with ``sequence_id`` and ``offset`` instead of ``task, rank``.

    ``cut`` is written once to the shared folder: counts and ranks must see the
    same rows, and tokenising isn't repeated.
    """
    kept = durable(cut)
    counts = durable(kept.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    table = intervals(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = durable(counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    if base.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    ranked = kept.join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = [n for n in cut.columns if n not in ("task", "rank")]

    def work(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for n in np.unique(size).tolist():
                here = np.flatnonzero(size == n)
                row = table[n][np.searchsorted(table[n][:, 0], rank[here], side="right") - 1]
                turn, within = np.divmod(rank[here] - row[:, 0], row[:, 1])
                sequence[here] = row[:, 2] + within
                offset[here] = row[:, 3] + turn * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields if f.name in names)
    return map_batches(ranked.select(*names, "rank"), work, f"{fields}, sequence_id long, offset long", rows=4096)


def pack_documents(
    docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, with_ids: bool = True, narrow: bool = False,
    words: int = CACHE_WORDS,
) -> DataFrame:
    """Pieces of every document with the sequence and the offset of each."""
    return place(pieces(docs, length, end_id, path, with_ids, narrow, words), length)


def _wide(data: bytes, n: int) -> np.ndarray:
    """The ``n`` ids that ``data`` holds in 2 or 4 bytes each."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def _joined(parts, sizes, length: int, pad_id: int) -> np.ndarray:
    """Ids of one sequence, from its pieces in order."""
    ids = np.concatenate([_wide(d, n) for d, n in zip(parts, sizes)])
    return np.concatenate([ids, np.full(length - len(ids), pad_id, "<u4")]) if len(ids) & (len(ids) - 1) else ids


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids array<int>``: whole sequences, padded to ``length``
    unless their size is a power of two.  A sequence has at most ``length`` ids.
    """

    def join(key, frame):
        import pandas as pd

        frame = frame.sort_values("offset")
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [_joined(frame["ids"], frame["length"], length, pad_id).astype(np.int32)]})

    kept = packed.select("sequence_id", "offset", "length", "ids")
    return kept.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<int>")


def in_sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``packed`` read back from whole sequences: ``ids`` (little-endian 32-bit) and ``ids_crc32``
    of each piece as the sequence holds them, with the sequence's ``sequence_length`` and
    ``sequence_crc32``.
    """

    def rebuilt(table: pa.Table) -> pa.RecordBatch:
        """Rows of whole sequences, in order of sequence and offset."""
        sequence, at, size = (table.column(c).to_numpy() for c in ("sequence_id", "offset", "length"))
        parts = table.column("ids").to_pylist()
        first = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
        ids, crc, total, whole_crc = [], [], [], []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(sequence)]):
            whole = _joined(parts[lo:hi], size[lo:hi], length, pad_id).tobytes()
            pieces = [whole[4 * x : 4 * (x + n)] for x, n in zip(at[lo:hi].tolist(), size[lo:hi].tolist())]
            ids += pieces
            crc += map(zlib.crc32, pieces)
            total += [len(whole) // 4] * (hi - lo)
            whole_crc += [zlib.crc32(whole)] * (hi - lo)
        made = {"ids": pa.array(ids, pa.binary()), "ids_crc32": pa.array(crc, pa.int64())}
        columns = [made[c] if c in made else table.column(c).combine_chunks() for c in table.column_names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(whole_crc, pa.int64())], names=[*table.column_names, "sequence_length", "sequence_crc32"])

    def work(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sequence = batch.column("sequence_id").to_numpy()
            cut = int(np.searchsorted(sequence, sequence[-1]))  # the last sequence may go on
            if cut or held and held[-1].column("sequence_id")[-1].as_py() != sequence[0]:
                yield rebuilt(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield rebuilt(pa.Table.from_batches(held))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema.fields)
    dealt = packed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return map_batches(dealt, work, f"{fields}, sequence_length long, sequence_crc32 long")
