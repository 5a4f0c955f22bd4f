"""Operator 1: byte-level BPE encoding and decoding with a rank queue.

``encode`` adds ids to a text column and ``decode`` turns ids back into bytes.
Within one match of the pattern, pairs wait in a queue keyed by merge rank: a
hierarchical bitmap of the ranks present, over buckets of positions in a linked
list of parts.  Find-first-set gives the next rank; an entry whose pair has
changed meanwhile is stale and skipped.  A match of n bytes takes O(n log n),
which matters for very long ones.

Defined results: null and empty texts have no ids; repeated rows repeat; the
other columns of a table are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paralex.llm.common import map_batches, tokenizer_file
from paralex.llm.pretokens import PATTERN, PieceEncoder

FILE = "byte_bpe_50k.tiktoken"
#: Ids that are decoded at once.
DECODED = 65_536


#: Bits of one word of the queue's bitmap.
WORD = 8


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: merge the pair of lowest rank, leftmost first.

    The queue has a bucket of positions for each rank present; ``low`` has a word
    of 2^WORD ranks each and ``top`` says which words aren't empty.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    #: Rank of the pair that begins at a part; -1 for none or a dead part.
    pair = [-1] * n
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top, inside = 0, (1 << WORD) - 1
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            pair[i] = r
            if r in buckets:
                buckets[r].append(i)  # ascending, so a heap
            else:
                buckets[r] = [i]
                a = r >> WORD
                low[a] = low.get(a, 0) | 1 << (r & inside)
                top |= 1 << a
    while top:
        a = (top & -top).bit_length() - 1
        word = low[a]
        bit = word & -word
        rank = a << WORD | bit.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            low[a] = word ^ bit
            if word == bit:
                top ^= 1 << a
        if pair[i] != rank:
            continue  # stale
        j = after[i]
        end = after[j]
        pair[j] = -1
        after[i] = end
        changed = [(i, after[end])] if end < n else []
        if end < n:
            before[end] = i
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            changed.append((h, end))
        for k, stop in changed:
            r = get(piece[k:stop])
            if r is None:
                pair[k] = -1
                continue
            pair[k] = r
            if r in buckets:
                heappush(buckets[r], k)
            else:
                buckets[r] = [k]
                a = r >> WORD
                low[a] = low.get(a, 0) | 1 << (r & inside)
                top |= 1 << a
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class RankEncoder:
    """Vocabulary of one ``.tiktoken`` file and the matches met so far."""

    def __init__(self, path: str | None = None, pattern: str = PATTERN):
        with open(tokenizer_file(FILE, path), "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        #: Bytes of all pieces one after another, where each id's begin, and how many they are (-1: no such id).
        self.arena = np.frombuffer(b"".join(self.ranks), np.uint8)
        sizes = np.fromiter(map(len, self.ranks), np.int64, len(self.ranks))
        known = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        self.begin, self.size = np.zeros(known.max(initial=-1) + 1, np.int64), np.full(known.max(initial=-1) + 1, -1)
        self.begin[known], self.size[known] = np.cumsum(sizes) - sizes, sizes
        self.coder = PieceEncoder(lambda words: [array("I", merge(w.encode(), self.ranks)).tobytes() for w in words], pattern=pattern)

    def encode(self, texts: list[str]):
        """Yield the little-endian 32-bit ids of each text, as bytes."""
        return self.coder.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        every, out = np.frombuffer(ids, "<u4"), []
        for at in range(0, len(every), DECODED):
            part = every[at : at + DECODED]
            if part.max() >= len(self.size) or (size := self.size[part]).min() < 0:
                raise KeyError("an id that the vocabulary doesn't have")
            before = np.cumsum(size) - size
            out.append(self.arena[np.repeat(self.begin[part] - before, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None, pattern: str = PATTERN) -> RankEncoder:
    """The encoder of this worker process."""
    return RankEncoder(path, pattern)


def _ids_column(values: list[bytes]) -> pa.Array:
    flat = pa.array(np.frombuffer(b"".join(values), np.uint32).astype(np.int32))
    ends = np.cumsum([0, *(len(v) // 4 for v in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def encode(docs: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, ids array<int>`` of every document's whole text (null: empty)."""

    def work(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _ids_column(list(coder.encode(texts)))], names=["doc_id", "ids"]
            )

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, decoded binary`` of ``doc_id, ids``; null ids decode to nothing."""

    def work(batches):
        coder = encoder(path)
        for batch in batches:
            out = [coder.decode(array("I", ids or []).tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), work, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """Encode and decode each text in one pass; return counts and digests.

    The ids never leave the worker, so nothing but a short row per document is
    moved: no shuffle at all.
    """

    def work(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, ids_digest, text_digest = [], [], []
            for ids in coder.encode(texts):
                counts.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(
        docs.select("doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
