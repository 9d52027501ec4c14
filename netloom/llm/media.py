"""Media columns: texts stored as PNG images in a binary column, read back and hashed.

`store` lays a text's UTF-8 bytes, padded with 255 to a positive multiple of 576, out as an
8-bit greyscale image 576 samples wide, and writes a PNG (zlib stream cut into IDAT chunks,
each with its CRC). `read` parses the stored bytes alone: signature, chunk lengths and
checksums, inflate, numpy unfiltering of all five filter types; from the samples it takes a
64-bit low-frequency cosine-transform hash.

Nulls count as empty texts (576 bytes of 255). Equal texts give equal values; repeated rows
stay repeated; other columns are not read. A task holds one chunk of texts (3 MB, or the
longest text). Broken media raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from netloom.llm.common import chunks, documents

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT = 1 << 16


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: np.ndarray) -> bytes:
    """A PNG of a (height, width) array of bytes. A row is filtered where that turns most of
    it into zeros (rows that repeat the row above, runs of one value), else left as it is."""
    height, width = samples.shape
    up, sub = samples.copy(), samples.copy()
    up[1:] -= samples[:-1]
    sub[:, 1:] -= samples[:, :-1]
    few = width // 4
    kinds = np.zeros(height, np.uint8)
    n_sub, n_up = np.count_nonzero(sub, 1), np.count_nonzero(up, 1)
    kinds[(n_sub < few) & (n_sub <= n_up)] = 1
    kinds[(n_up < few) & (n_up < n_sub)] = 2
    kinds[0] = kinds[0] == 1
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = kinds
    rows[:, 1:] = np.where((kinds == 1)[:, None], sub, np.where((kinds == 2)[:, None], up, samples))
    data = zlib.compress(rows.tobytes(), 6)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", data[i : i + IDAT]) for i in range(0, len(data), IDAT)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the filters of 8-bit rows of one sample a pixel; runs of rows with the same
    filter at once where the filter lets them."""
    height, width = rows.shape
    out = np.empty_like(rows)
    above = np.zeros(width, np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [height]])):
        kind, part = kinds[a], rows[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part, 1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(part, 0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for i in range(a, b):
                left, corner = 0, 0
                for x, (v, up) in enumerate(zip(rows[i].tolist(), above.tolist())):
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        dl, du, dc = abs(p - left), abs(p - up), abs(p - corner)
                        guess = left if dl <= du and dl <= dc else up if du <= dc else corner
                    left, corner = (v + guess) & 255, up
                    out[i, x] = left
                above = out[i]
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[b - 1]
    return out


def read_png(data: bytes) -> np.ndarray:
    """The (height, width) samples of an 8-bit greyscale PNG that is not interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, end = 8, None, [], False
    while at < len(data) and not end:
        (size,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(content) != size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + content):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        end = kind == b"IEND"
        at += 12 + size
    if not end or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("cut short, or of another kind")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError("size of the image data")
    raw = raw.reshape(height, width + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


SIDE, LOW = 32, 8
_DCT = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(SIDE)[None] + 1) / (2 * SIDE))


def cosine_hash(samples: np.ndarray) -> str:
    """Mean grey of 32 x 32 cells, the 8 x 8 lowest cosine coefficients, and of each whether
    it lies over the median of those but the first: 64 bits in hex."""
    height, width = samples.shape
    across = samples.reshape(height, SIDE, width // SIDE).sum(2, dtype=np.int64)
    cuts = np.arange(SIDE) * height // SIDE
    counts = np.maximum(np.diff(np.append(cuts, height)), 1)
    cells = np.add.reduceat(across, cuts, 0) / (counts[:, None] * (width // SIDE))
    low = (_DCT @ cells @ _DCT.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the PNG) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sizes, media = [], []
            for t in part.column(1).to_pylist():
                raw, n = payload(t)
                sizes.append(n)
                media.append(write_png(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def read(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, of media(doc_id, n_bytes, media)."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "media"):
            rows = []
            for m in part.column(2).to_pylist():
                samples = read_png(m)
                raw = samples.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(store(documents(spark, sf_dir)))
