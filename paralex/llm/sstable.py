"""Operator 8: token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier.  Its file is

    data blocks   records: varints (shared key bytes, other key bytes, ids),
                  key bytes, ids; then the block's crc32
    index         one entry a block: last key, offset, size, records and ids before it
    Bloom filter  of the keys
    footer        fixed size, with the places of index and filter

all numbers little-endian.  Ids take 2 bytes if the vocabulary and the end id allow, else
4; an id that doesn't fit is an error.
A lookup tests the filter, searches the index by halves and reads one block.

Texts are dealt by range to tasks, whose number follows the bytes of all texts, and a
task begins a new shard when one is full; the order of shards is the order of documents.
Writers name files after the attempt, and the manifest lists those of the
attempts that succeeded: a lost executor or a repeated task leaves no wrong file.

Defined results: null texts are empty (the end id alone); a null identifier
sorts first; repeated identifiers are kept, ordered by a hash of their text; an
empty table writes shards without records; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.llm import hf
from paralex.llm.common import map_batches
from paralex.session import fresh_path

END_ID = 2
BLOCK_BYTES = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: A task that has written so much goes on in a new shard, so what a writer holds until it
#: closes (16 bytes a record, 45 a block) is bounded; tasks get so many bytes of text.
SHARD_BYTES, SHARD_RECORDS, TASK_BYTES = 256 << 20, 1 << 21, 1 << 30
FOOTER = struct.Struct("<QQQQQQIII8s")
MAGIC = b"PXSSTAB1"


def filesystem(uri: str):
    """Arrow's file system for a URI of Hadoop's form, and the path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes records in ascending order of key to an open binary file."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.at = self.records = self.ids = 0
        self.index: list[bytes] = []
        self.hashes = array("Q")  # two of each record
        self.digest = 0
        self._open()

    def _open(self) -> None:
        self.block, self.held, self.last = [], 0, b""
        self.before = (self.records, self.ids)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise OverflowError(f"id {int(ids.max())} needs more than {self.width} bytes")
        value = ids.astype(f"<u{self.width}").tobytes()
        record = b"".join((_varint(shared), _varint(len(key) - shared), _varint(len(ids)), key[shared:], value))
        self.block.append(record)
        self.held += len(record)
        self.last = key
        self.hashes.extend((xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1))
        self.records += 1
        self.ids += len(ids)
        if self.held >= self.block_bytes:
            self._close_block()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _close_block(self) -> None:
        if not self.block:
            return
        data = b"".join(self.block)
        self.index.append(struct.pack("<I", len(self.last)) + self.last + struct.pack("<QQQQ", self.at, len(data) + 4, *self.before))
        self._put(data + struct.pack("<I", zlib.crc32(data)))
        self._open()

    def close(self) -> None:
        self._close_block()
        index_at = self.at
        index = b"".join(self.index)
        self._put(index)
        bits = max(64, BLOOM_BITS * self.records)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        if self.hashes:
            pairs = np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)
            for at in range(0, len(pairs), 65_536):
                a, b = pairs[at : at + 65_536].T
                for i in range(BLOOM_HASHES):
                    # as in _probes, with the sum not cut to 64 bits
                    spot = (a % np.uint64(bits) + np.uint64(i) * (b % np.uint64(bits))) % np.uint64(bits)
                    np.bitwise_or.at(bloom, (spot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))
        bloom_at = self.at
        self._put(bloom.tobytes())
        check = zlib.crc32(bloom.tobytes(), zlib.crc32(index))
        self._put(FOOTER.pack(index_at, len(index), bloom_at, bits, self.records, self.ids, self.width, len(self.index), check, MAGIC))


class ShardReader:
    """Reads one shard; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - FOOTER.size)
        fields = FOOTER.unpack(source.read(FOOTER.size))
        index_at, index_size, bloom_at, self.bits, self.records, self.ids, self.width, n, check, magic = fields
        if magic != MAGIC:
            raise ValueError("not a shard file")
        source.seek(index_at)
        index, self.bloom = source.read(index_size), source.read(-(-self.bits // 8))
        if zlib.crc32(self.bloom, zlib.crc32(index)) != check:
            raise ValueError("index or filter is damaged")
        self.last_keys, self.places, at = [], [], 0
        for _ in range(n):
            (size,) = struct.unpack_from("<I", index, at)
            self.last_keys.append(index[at + 4 : at + 4 + size])
            self.places.append(struct.unpack_from("<QQQQ", index, at + 4 + size))
            at += 36 + size

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, size, _, _ = self.places[k]
        self.source.seek(offset)
        data = self.source.read(size)
        body = data[:-4]
        if zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        at, key = 0, b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            other, at = _read_varint(body, at)
            n, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + other]
            at += other
            yield key, np.frombuffer(body, f"<u{self.width}", n, at)
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each document of this identifier in the shard."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        found = []
        for k in range(bisect_left(self.last_keys, key), len(self.places)):
            for other, ids in self.block(k):
                if other == key:
                    found.append(ids.astype(np.uint32))
                elif other > key:
                    return found
        return found


@dataclass(frozen=True)
class Shard:
    number: int
    uri: str
    records: int
    ids: int
    start: int  # ids in all shards before


def write_shards(
    docs: DataFrame,
    folder: str | None = None,
    tasks: int | None = None,
    end_id: int = END_ID,
    path: str | None = None,
    width: int | None = None,
    shard_bytes: int = SHARD_BYTES,
    shard_records: int = SHARD_RECORDS,
) -> list[Shard]:
    """Tokenise every whole text and write the shards; the manifest, in order.

    The texts, not the ids, are dealt by range: they are smaller on the wire, and
    finding the ranges doesn't tokenise anything.  Small tables take as many tasks as
    the session shuffles to, larger ones one for each TASK_BYTES of text.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "sstable")
    if not tasks:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    dealt = rows.repartitionByRange(tasks, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")

    def work(batches):
        from pyspark import TaskContext

        coder = hf.encoder(path)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = filesystem(folder)

        def records():
            for batch in batches:
                ids_of = coder.encode([t or "" for t in batch.column("text").to_pylist()])
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of):
                    yield key_of(doc_id), np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))

        coming, part = records(), 0
        record = next(coming, None)
        while record or not part:
            name = f"shard-{task:06d}-{part:06d}-{attempt}.sst"
            with fs.open_output_stream(f"{root}/{name}.tmp") as sink:
                writer = ShardWriter(sink, width or coder.width(end_id))
                while record and writer.at + writer.held < shard_bytes and writer.records < shard_records:
                    writer.add(*record)
                    record = next(coming, None)
                writer.close()
            fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"task": task, "part": part, "uri": f"{folder}/{name}", "records": writer.records, "ids": writer.ids}])
            part += 1

    made = map_batches(dealt.select("doc_id", "text"), work, "task long, part long, uri string, records long, ids long")
    out, start = [], 0
    for r in sorted(made.collect(), key=lambda r: (r["task"], r["part"])):  # one row a shard
        out.append(Shard(len(out), r["uri"], r["records"], r["ids"], start))
        start += r["ids"]
    return out


def read_shards(spark: SparkSession, manifest: list[Shard]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record in the files."""
    rows = [(s.number, s.uri, s.start) for s in manifest if s.records]
    listed = spark.createDataFrame(rows, "number long, uri string, start long").repartition(max(1, len(rows)), "number")

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, place = filesystem(row["uri"])
                with fs.open_input_file(place) as source:
                    reader, at = ShardReader(source), row["start"]
                    for k in range(len(reader.places)):
                        doc, start, size, crc = [], [], [], []
                        for key, ids in reader.block(k):
                            doc.append(doc_of(key))
                            start.append(at)
                            size.append(len(ids))
                            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                            at += len(ids)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, pa.int64()) for x in (doc, start, size, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                        )

    return map_batches(listed, work, "doc_id long, start long, n_tokens long, ids_crc32 long")
