"""Operator 4: sharding on a consistent-hash ring with bounded loads.

The ring has ``CELLS`` positions; each shard owns several of them (virtual
nodes).  A key starts at the cell of its hash and goes to the next virtual node
clockwise whose shard is not full.  Shard quotas add up to the number of rows,
so counts differ by at most one (law ``rows``); a looser ``slack`` gives quotas
of (1 + slack) times the mean and moves fewer keys when a shard is added.

Only counts by cell reach the driver (at most ``CELLS`` plus salted hot cells),
where the walk is done; it returns intervals of ranks, and each row finds its
interval by its cell and its rank there.

Defined results: null ids hash to one cell, which is salted like any hot cell;
null texts have size 1; repeated rows get slots of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paralex.llm.common import durable

CELL_BITS = 14
CELLS = 1 << CELL_BITS
#: A cell with more than this share of all rows is dealt over HOT_SALTS parts.
HOT_SHARE = 1 / 512
HOT_SALTS = 64


@dataclass(frozen=True)
class Ring:
    shards: int
    virtual_nodes: int = 64

    def owners(self) -> list[int | None]:
        """Shard of each cell that holds a virtual node; the first claim wins."""
        out: list[int | None] = [None] * CELLS
        for shard in range(self.shards):
            for v in range(self.virtual_nodes):
                cell = xxhash.xxh64_intdigest(f"{shard}/{v}".encode()) >> (64 - CELL_BITS)
                while out[cell] is not None:
                    cell = (cell + 1) % CELLS
                out[cell] = shard
        return out

    def preferences(self) -> list[tuple[int, ...]]:
        """Distinct shards clockwise from each cell."""
        owners = self.owners()
        nodes = [c for c in range(CELLS) if owners[c] is not None]
        orders = {}
        for i, c in enumerate(nodes):
            seen = dict.fromkeys(owners[nodes[(i + k) % len(nodes)]] for k in range(len(nodes)))
            orders[c] = tuple(seen)
        out: list[tuple[int, ...]] = [()] * CELLS
        at = nodes[0]
        for c in range(CELLS - 1, -1, -1):
            at = c if owners[c] is not None else at
            out[c] = orders[at]
        return out


def quotas(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Largest load of each shard; with no slack they add up to ``rows``."""
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], ring: Ring, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Intervals ``(cell, first rank, end rank, shard, first slot)``.

    Cells take their turns in bit-reversed order, so that no stretch of the ring
    is always served last.
    """
    room = quotas(sum(counts.values()), ring.shards, slack)
    load = [0] * ring.shards
    prefer = ring.preferences()
    out = []
    for cell in sorted(counts, key=lambda c: int(f"{c:0{CELL_BITS}b}"[::-1], 2)):
        at, left = 0, counts[cell]
        for shard in prefer[cell]:
            take = min(left, room[shard] - load[shard])
            if take > 0:
                out.append((cell, at, at + take, shard, load[shard]))
                load[shard] += take
                at += take
                left -= take
            if not left:
                break
    return out


def cell_of(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - CELL_BITS).cast("int")


def assign(rows: DataFrame, key: str, shards: int, virtual_nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``.

    ``rows`` should be narrow: it is written once to the shared folder, so that
    counts and ranks see the same rows.  All its columns decide the order within
    a cell, so equal rows are interchangeable.
    """
    names = rows.columns
    kept = durable(rows.withColumn("_cell", cell_of(F.col(key))))
    spark = rows.sparkSession
    by_cell = {r[0]: r[1] for r in kept.groupBy("_cell").count().collect()}
    total = sum(by_cell.values())
    hot = sorted(c for c, n in by_cell.items() if n > max(1, total * HOT_SHARE))
    salt = F.pmod(F.xxhash64(*names), F.lit(HOT_SALTS)).cast("int")
    salted = kept.withColumn("_salt", F.when(F.col("_cell").isin(hot), salt).otherwise(F.lit(0)))
    base: list[tuple[int, int, int]] = []
    if hot:
        parts = salted.filter(F.col("_cell").isin(hot)).groupBy("_cell", "_salt").count().collect()
        before: dict[int, int] = {}
        for cell, part, n in sorted((r[0], r[1], r[2]) for r in parts):
            base.append((cell, part, before.get(cell, 0)))
            before[cell] = before.get(cell, 0) + n
    base += [(c, 0, 0) for c in by_cell if c not in set(hot)]
    first = {(c, s): b for c, s, b in base}
    # One row for each (cell, salt, interval), ranks counted within the part:
    # at most CELLS + shards + hot cells x salts x 2 rows, whatever the input.
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    for cell, lo, hi, shard, slot in walk(by_cell, Ring(shards, virtual_nodes), slack):
        spans.setdefault(cell, []).append((lo, hi, shard, slot))
    table = []
    for (cell, part), start in first.items():
        table += [(cell, part, lo - start, hi - start, shard, slot) for lo, hi, shard, slot in spans[cell] if hi > start]
    bounds = spark.createDataFrame(table, "_cell int, _salt int, _lo long, _hi long, shard int, _slot long")
    order = Window.partitionBy("_cell", "_salt").orderBy(*(F.col(n) for n in (key, *(x for x in names if x != key))))
    ranked = salted.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    return (
        ranked.join(F.broadcast(bounds), ["_cell", "_salt"])
        .filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .select(*names, "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 16, virtual_nodes: int = 64) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign(rows, "doc_id", shards, virtual_nodes).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
