"""Exact dedup by content-defined chunk recipes.

A text (A-Z lower-cased, UTF-8) is cut where a rolling hash of its last 32 bytes says so.
Its recipe is the ordered list of its chunks' 128-bit identifiers; two texts are equal if
their recipes are. Identifiers are verified, not trusted: distinct (identifier, bytes) pairs
are counted by identifier, and where one identifier stands for several byte strings, the
recipe gets the number of the string as well. Grouping moves recipes (16 bytes for about
2,000 of text), never the long documents; the chunks themselves move once, and copies of a
chunk only once a task.

Of equal texts the row with the largest doc_id stays (a null doc_id is the smallest; of rows
with the same doc_id one, picked when recipes are written, stays). Nulls count as empty, and
empty texts are equal. Other columns are not read. A group may hold a third of all rows: it
is counted with partial sums, and the join that hands the result back to the rows reads
written tables, whose partitions AQE can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import chunks, documents, staged

WINDOW, LEAST, MOST, MASK = 32, 256, 16_384, (1 << 11) - 1
ID_BYTES = 16
_BASE = 0x9E3779B97F4A7C15


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()  # of bytes: A-Z only


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_power: list[np.ndarray] = [_powers(1, _BASE)] * 2


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: positions that the rolling hash picks, with chunks of LEAST to
    MOST bytes (the last may be shorter). They depend on the content alone."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    if len(_power[0]) < n + 1:
        _power[:] = _powers(2 * n, _BASE), _powers(2 * n, pow(_BASE, -1, 1 << 64))
    with np.errstate(over="ignore"):
        x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(0x51ED270B)
        total = np.cumsum(x * _power[0][:n], dtype=np.uint64)
        h = (total[WINDOW:] - total[:-WINDOW]) * _power[1][: n - WINDOW]
    marks = (np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + WINDOW + 1).tolist()
    out, start = [], 0
    for m in [*marks, n]:
        while m - start > MOST:
            out.append(start := start + MOST)
        if m - start >= LEAST and m < n:
            out.append(start := m)
    if start < n:
        out.append(n)
    return out


def identifiers(data: bytes, size: int = ID_BYTES) -> Iterator[tuple[bytes, bytes]]:
    start = 0
    for end in cuts(data):
        piece = data[start:end]
        yield xxhash.xxh3_128_digest(piece)[:size], piece
        start = end


def recipes(docs: DataFrame, size: int = ID_BYTES) -> DataFrame:
    """row, doc_id, text_sha256, recipe of docs(row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = [normalised(t) for t in part.column(2).to_pylist()]
            digests = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            lists = pa.array([b"".join(i for i, _ in identifiers(t, size)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digests, lists], names=["row", "doc_id", "text_sha256", "recipe"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, text_sha256 string, recipe binary")


def pieces(docs: DataFrame, size: int = ID_BYTES) -> DataFrame:
    """The chunks (id, piece), each once a slice of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=16_000_000):
            found = {x for t in part.column(1).to_pylist() for x in identifiers(normalised(t), size)}
            if found:
                ids, data = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(data, pa.binary())], names=["id", "piece"])

    return docs.select("doc_id", "text").mapInArrow(run, "id binary, piece binary")


def _variants(docs: DataFrame, shared: DataFrame, size: int) -> DataFrame:
    """Of the documents that hold an identifier which stands for several byte strings: row
    and the numbers of its strings, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = [(r, k, i, p) for r, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for k, (i, p) in enumerate(identifiers(normalised(t), size))]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["row", "pos", "id", "piece"])

    number = F.row_number().over(Window.partitionBy("id").orderBy("piece"))
    variants = staged(pieces(docs, size).join(shared, "id", "left_semi").distinct().withColumn("variant", number))
    found = docs.select("row", "text").mapInArrow(run, "row bigint, pos bigint, id binary, piece binary").join(variants, ["id", "piece"])
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("pos", "variant"))), lambda x: x["variant"])
    return found.groupBy("row").agg(numbers.alias("variants"))


def exact_dedup(docs: DataFrame, size: int = ID_BYTES) -> DataFrame:
    """A row for each of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.
    `size` is the number of bytes of an identifier; small ones make collisions, for tests."""
    base = docs.select(F.col("doc_id").cast("bigint"), "text").withColumn("row", F.monotonically_increasing_id())
    shared = staged(pieces(base, size).distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    key = ["recipe"]
    if shared.limit(1).count():
        base = staged(base)
        key = ["recipe", "variants"]
        rows = staged(recipes(base, size).join(_variants(base, shared, size), "row", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<int>"))))
    else:
        rows = staged(recipes(base, size))
    groups = staged(rows.groupBy(*key).agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")))
    kept = F.col("row") == F.col("keep.row")
    return rows.join(groups, key).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP4_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""
