import hashlib
import struct
import zlib

import numpy as np
import pytest

from netloom.llm import media


def test_filters_round_trip():
    rng = np.random.default_rng(0)
    m = rng.integers(0, 256, (9, 576)).astype(np.uint8)
    m[3] = m[2]
    m[5] = 7
    assert (media.read_png(media.write_png(m)) == m).all()


@pytest.mark.parametrize("kind", range(5))
def test_unfilter_each_kind(kind):
    rng = np.random.default_rng(kind)
    want = rng.integers(0, 256, (4, 12)).astype(np.uint8)
    rows = np.zeros_like(want)
    for y in range(4):
        for x in range(12):
            left = int(want[y, x - 1]) if x else 0
            up = int(want[y - 1, x]) if y else 0
            corner = int(want[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            rows[y, x] = (int(want[y, x]) - (0, left, up, (left + up) // 2, paeth)[kind]) & 255
    assert (media.unfilter(np.full(4, kind), rows) == want).all()


def test_broken_media():
    data = bytearray(media.write_png(np.zeros((1, 576), np.uint8)))
    data[50] ^= 1
    with pytest.raises((ValueError, struct.error)):
        media.read_png(bytes(data))
    with pytest.raises(ValueError):
        media.read_png(b"text")


def test_query_rows(docs, rows, empty):
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.read(media.store(docs)).collect()}
    want = set()
    for d, t, *_ in rows:
        raw = (t or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        want.add((d, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:])))
    assert got == want
    same = {(r.media_sha256, r.feature) for r in media.read(media.store(docs.where("doc_id between 100 and 107"))).collect()}
    assert len(same) == 1
    assert media.read(media.store(empty)).collect() == []
