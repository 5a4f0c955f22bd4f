"""Operator 10: media columns.  Bytes become PNG images in a binary column, are
read back with all checksums tested, and get a low-frequency cosine hash.

A payload is the bytes followed by bytes 255 up to a positive multiple of
``WIDTH``; it is stored as 8-bit grey samples, one row of ``WIDTH`` samples
after another.  The reader handles the five row filters of 8-bit images.

Defined results: null and empty texts are one row of 255; equal texts give equal
values; a null image has null features; an image that breaks the format is a
``DamagedImage``, found before more than its header's number of bytes is unpacked;
repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paralex.llm.common import map_batches

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format
#: Most bytes of one IDAT chunk.
CHUNK = 1 << 16
#: Side of the picture that is transformed, and of the block of low frequencies.
SIDE, LOW = 32, 8


class DamagedImage(ValueError):
    """A chunk or a filter that doesn't hold what the format asks for."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray, level: int = 4) -> bytes:
    """An 8-bit grey image; each row takes the filter None or Up with the smaller residual."""
    height, width = samples.shape
    above = np.zeros_like(samples)
    above[1:] = samples[:-1]
    up = samples - above  # modulo 256
    cost = lambda a: np.abs(a.view(np.int8).astype(np.int16)).sum(axis=1)
    use = cost(up) < cost(samples)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = np.where(use, 2, 0)
    rows[:, 1:] = np.where(use[:, None], up, samples)
    data = zlib.compress(rows.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    parts = [SIGNATURE, _chunk(b"IHDR", head)]
    parts += [_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters; ``step`` is the bytes of one pixel."""
    kinds, raw = rows[:, 0], rows[:, 1:]
    height, width = raw.shape
    if kinds.max(initial=0) > 4:
        raise DamagedImage("unknown row filter")
    out = np.empty((height, width), np.uint8)
    if not kinds.any():
        out[:] = raw
        return out
    zero = np.zeros(width, np.uint8)
    y = 0
    while y < height:
        kind = kinds[y]
        end = y + 1
        while end < height and kinds[end] == kind:
            end += 1
        prior = out[y - 1] if y else zero
        if kind == 0:
            out[y:end] = raw[y:end]
        elif kind == 1:
            pixels = raw[y:end].reshape(end - y, width // step, step)
            out[y:end] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(end - y, width)
        elif kind == 2:
            out[y:end] = np.cumsum(np.vstack([prior[None], raw[y:end]]), axis=0, dtype=np.uint8)[1:]
        else:
            for k in range(y, end):
                top = (out[k - 1] if k else zero).tolist()
                line, got = raw[k].tolist(), [0] * width
                for x in range(width):
                    a, b = (got[x - step] if x >= step else 0), top[x]
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        c = top[x - step] if x >= step else 0
                        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                    got[x] = (line[x] + guess) & 255
                out[k] = got
        y = end
    return out


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit image without interlace: height x (width x channels)."""
    if data[:8] != SIGNATURE:
        raise DamagedImage("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise DamagedImage(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            if n != 13 or head is not None:
                raise DamagedImage("header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise DamagedImage("no header or no end")
    width, height, depth, colour, method, filters, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)  # fixed by the format
    if depth != 8 or channels is None or interlace or method or filters or not width or not height:
        raise DamagedImage("only 8-bit images without palette and interlace")
    size = height * (width * channels + 1)
    packed = zlib.decompressobj()
    try:
        data = packed.decompress(b"".join(parts), size + 1)
    except zlib.error as e:
        raise DamagedImage(str(e)) from e
    if len(data) != size or not packed.eof:
        raise DamagedImage("wrong number of samples")
    raw = np.frombuffer(data, np.uint8)
    return _unfilter(raw.reshape(height, width * channels + 1), channels)


@functools.cache
def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))


@functools.lru_cache(maxsize=4096)
def _cuts(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and widths of SIDE bins over ``size`` samples; small sizes repeat."""
    starts = (np.arange(SIDE) * size) // SIDE
    ends = np.maximum(((np.arange(SIDE) + 1) * size) // SIDE, starts + 1)
    return starts, ends - starts


def cosine_hash(samples: np.ndarray) -> str:
    """16 hexadecimal digits: which of the 8 x 8 lowest frequencies are above their median."""
    rows, row_n = _cuts(samples.shape[0])
    cols, col_n = _cuts(samples.shape[1])
    wide = np.add.reduceat(samples, cols, axis=1, dtype=np.float64) / col_n
    if samples.shape[0] >= SIDE:
        small = np.add.reduceat(wide, rows, axis=0) / row_n[:, None]
    else:
        small = wide[rows]
    c = _cosines()
    low = (c @ small @ c.T).round(6).ravel()
    bits = np.packbits(low > np.median(low[1:]))
    return bits.tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text's UTF-8, and the padded payload."""
    data = (text or "").encode()
    full = max(1, -(-len(data) // WIDTH)) * WIDTH
    return len(data), data.ljust(full, b"\xff")


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, image binary``: every whole text as an image."""

    def work(batches):
        for batch in batches:
            sizes, images = [], []
            for text in batch.column("text").to_pylist():
                n, payload = payload_of(text)
                sizes.append(n)
                images.append(write_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "image"]
            )

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_bytes long, image binary")


def features(stored: DataFrame) -> DataFrame:
    """Digests of what the images hold when read back, and the cosine hash."""

    def work(batches):
        for batch in batches:
            rows = []
            for image in batch.column("image").to_pylist():
                if image is None:
                    rows.append((None,) * 6)
                    continue
                samples = read_png(image)
                payload = samples.tobytes()
                rows.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                    len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples),
                ))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return map_batches(
        stored.select("doc_id", "n_bytes", "image"), work,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
