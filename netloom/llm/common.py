"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.storage import shared_dir, staged

__all__ = ["chunks", "content_key", "documents", "packed", "shared_dir", "staged", "unpacked"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each (one row at least), so
    that what a task holds is bounded by the longest single text, not by the batch."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def content_key(*cols) -> F.Column:
    """Two independent 64-bit hashes as one struct: 128 bits in the JVM, no Python."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(0x9E3779B9), *cols[::-1]).alias("b"))


def packed(df: DataFrame) -> F.Column:
    """All columns as one struct, so that no working column clashes with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def unpacked(df: DataFrame, columns: list[str], struct: str = "doc") -> list[F.Column]:
    return [F.col(struct).getField(c).alias(c) for c in columns]
