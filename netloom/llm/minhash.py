"""Near-duplicate detection with BagMinHash signatures.

Elements of a text are its runs of five words (lower case, split at white space; a text of
fewer words is one run), weighted by how often they occur. Each (element, dyadic interval of
weights) carries a Poisson process that is the same wherever it occurs: interval i covers
weights (2**(i-1), 2**i] with as many points per unit of time as it is long, and a point
lies at a uniform position, so that a text takes the points at positions below its weight.
Every point goes to one of `REGISTERS` registers at random; the earliest point of each is
the signature, and two texts agree in a register with probability equal to their weighted
Jaccard similarity. Points are drawn in rounds for a whole chunk of texts, only while they
can still be earlier than the latest register of their text.

Signatures are banded. Of each bucket with several texts a leader is taken (the first in an
order that all buckets share) and the others are verified against it: exactly, as multisets.
Connected components of the verified links are merged. What buckets still hold
several components are compared in full, block by block, without emitting pairs: in each
bucket the members outside its largest component against all members, so no link between
different components of a bucket is lost, and nothing is capped. With 32 bands of 6
registers a pair at similarity 0.8 shares a bucket with probability 0.99994.

The result has a row for each document: its class is the least doc_id of its component.
Equal texts (two 64-bit hashes) are one text from the start, so copies cost nothing. Texts
without words (nulls and empty ones too) are never near-duplicates: each row is its own
class. Of a class the row with the least doc_id stays (nulls last; of rows with the same
doc_id one). Other columns are not read. Hot buckets and classes are handled by partial
aggregation and by joins of written tables, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import chunks, content_key, documents, packed, staged, unpacked

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
BLOCK = 256

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def _spaces() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x3001) if chr(i).isspace()]] = True
    return out


BASE = 0x9E3779B97F4A7C15
_power: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.full(n + n // 4, b, _U)
            out[0] = 1
            _power[k] = np.cumprod(out, dtype=_U)
    return _power[0], _power[1]


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, the text of each, and the number of
    words of each text."""
    whole = "\n".join((t or "").lower() for t in texts) + "\n"
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len((t or "").lower()) for t in texts], np.int64) + 1
    ends = np.cumsum(sizes)
    space = _spaces()[cp]
    word = ~space
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(ends, start, side="right")
    counts = np.bincount(of, minlength=len(texts))
    power, inverse = _powers(len(cp) + 1)
    with np.errstate(over="ignore"):
        x = (cp.astype(_U) + _U(0x51ED270B)) * _U(0x2545F4914F6CDD1D)
        x ^= x >> _U(29)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(x * power[: len(cp)], dtype=_U)])
        h = _mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(_U))
        padded = np.concatenate([h, np.zeros(WORDS, _U)])
        owner = np.concatenate([of, np.full(WORDS, -1)])
        s = np.zeros(len(h), _U)
        for j in range(WORDS):
            s = s * _U(BASE) + np.where(owner[j : len(h) + j] == of, padded[j : len(h) + j], _U(0))
        s = _mix(s)
    # a text's first n - 4 positions (one, if it has fewer words)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    keep = np.arange(len(h)) - first[of] < np.maximum(counts[of] - WORDS + 1, 1)
    return s[keep], of[keep], counts


def multisets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements (hash, text, weight), ordered by text; words of each text."""
    s, of, counts = shingles(texts)
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return s[at], of[at], np.diff(np.append(at, len(s))), counts


def signatures(element: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures (n texts x registers) of integer weights; all ones where a text
    has no elements."""
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    root = np.repeat(np.arange(len(element)), levels)
    level = np.arange(len(root)) - np.repeat(np.cumsum(levels) - levels, levels)
    size = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)  # of the interval, and its rate
    low = np.where(level > 0, size, 0)
    inside = weight[root] - low  # positions below it are in
    partial = inside < size
    owner = of[root]
    with np.errstate(over="ignore"):
        seed = _mix(element[root] + level.astype(_U) * _U(0xD1342543DE82EF95) + _U(1))
    time = np.zeros(len(root))
    out = np.full(n * registers, np.iinfo(_U).max, _U)
    live = np.arange(len(root))
    step = 0
    while len(live):
        step += 1
        with np.errstate(over="ignore"):
            x = _mix(seed[live] + _U(step) * _U(BASE))
            y = _mix(x + _U(0xA0761D6478BD642F))
        time[live] += -np.log(((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / size[live]
        t = time[live].astype(np.float32)
        value = (t.view(np.uint32).astype(_U) << _U(32)) | (y & _U(0xFFFFFFFF))
        register = ((y >> _U(32)) * _U(registers)) >> _U(32)
        taken = np.ones(len(live), bool)
        p = np.flatnonzero(partial[live])
        if len(p):
            with np.errstate(over="ignore"):
                z = _mix(y[p] + _U(0xE7037ED1A0B428DB)) >> _U(32)
            taken[p] = ((z * size[live[p]].astype(_U)) >> _U(32)).astype(np.int64) < inside[live[p]]
        slot = owner[live] * registers + register.astype(np.int64)
        np.minimum.at(out, slot[taken], value[taken])
        latest = out.reshape(n, registers).max(1)
        live = live[value < latest[owner[live]]]
    return out.reshape(n, registers)


def bands(signature: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    rows = signature.reshape(len(signature), n_bands, -1)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, n_bands + 1, dtype=_U) * _U(0xD6E8FEB86659FD93), rows.shape[:2]).copy()
        for j in range(rows.shape[2]):
            key = _mix(key + rows[:, :, j])
    return key.view(np.int64)


def fingerprint(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the k-th occurrence of an element is an item of its
    own, so that intersections of the sets are those of the multisets."""
    item = np.repeat(element, weight)
    k = np.arange(len(item)) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return np.sort((_mix(item + k.astype(_U) * _U(BASE)) >> _U(16)).astype(_U))


def pack(items: np.ndarray) -> bytes:
    """48 bits an item."""
    return items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < least * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _sign(docs: DataFrame) -> DataFrame:
    """row, doc_id, a, b, n (words), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=2_000_000):
            element, of, weight, counts = multisets(part.column(4).to_pylist())
            keys = bands(signatures(element, of, weight, part.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(counts, pa.int64()), lists], names=["row", "doc_id", "a", "b", "n", "bands"])

    key = content_key(F.coalesce("text", F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), key["a"].alias("a"), key["b"].alias("b"), "text")
    return rows.mapInArrow(run, "row bigint, doc_id bigint, a bigint, b bigint, n bigint, bands array<bigint>")


def _fingerprints(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """u, size, items of the texts (a, b) -> u that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=2_000_000):
            element, of, weight, _ = multisets(part.column(1).to_pylist())
            at = np.searchsorted(of, np.arange(part.num_rows + 1))
            items = [fingerprint(element[s:e], weight[s:e]) for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, items), pa.int64()), pa.array(map(pack, items), pa.binary())], names=["u", "size", "items"])

    key = content_key(F.coalesce("text", F.lit("")))
    texts = docs.select("doc_id", "text").withColumns({"a": key["a"], "b": key["b"]})
    # of the copies of a text the one with the least doc_id is read, or all that have it
    found = wanted.withColumnRenamed("first_id", "__first")
    rows = texts.join(found, ["a", "b"]).where(F.col("doc_id").eqNullSafe(F.col("__first"))).select("u", "text")
    return rows.mapInArrow(run, "u bigint, size bigint, items binary").dropDuplicates(["u"])


def _verified(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of texts that are similar enough."""

    @F.pandas_udf("boolean")
    def overlap(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(unpack(p), unpack(q), least) for p, q in zip(x, y)], dtype=bool)

    one = prints.select("u", F.col("items").alias("x"))
    two = prints.select(F.col("u").alias("v"), F.col("items").alias("y"))
    return pairs.join(one, "u").join(two, "v").where(overlap("x", "y")).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """u, c: the least member of its component, for all ends of the links (u, v). Labels
    move to neighbours and then jump to the label's label, so that the number of rounds is
    about the logarithm of the longest path."""
    both = staged(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = staged(both.groupBy("u").agg(F.least("u", F.min("v")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("near"))
        hooked = labels.join(near, "u").select("u", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = labels.select(F.col("u").alias("c"), F.col("c").alias("far"))
        after = staged(hooked.join(jump, "c", "left").select("u", "old", F.least("c", F.coalesce("far", "c")).alias("c")))
        changed = after.where("old <> c").limit(1).count()
        labels = after.select("u", "c")
        if not changed:
            return labels


def _compare_blocks(member: DataFrame, labels: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of components u and v, from the buckets of member(k, u) that hold several
    of them; texts without links are components of their own. In each such bucket the members
    outside its largest component (side 0) meet all its members (side 1), in blocks of `BLOCK`
    by `BLOCK`; a block pair is one group, which yields links alone."""
    now = staged(member.join(labels, "u", "left").select("k", "u", F.coalesce("c", "u").alias("c")))
    spread = now.groupBy("k", "c").agg(F.count("*").alias("m"))
    largest = spread.groupBy("k").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("all")).where("top.m < all")
    largest = staged(largest.select("k", F.col("top.c").alias("major"), "all", (F.col("all") - F.col("top.m")).alias("minor")))
    block = lambda n: F.pmod(F.xxhash64("u"), F.ceil(F.col(n) / BLOCK)).cast("int")
    rows = now.join(largest, "k")
    blocks = lambda n: F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int"))
    minor = rows.where("c <> major").select("k", "u", "c", F.lit(0).alias("side"), block("minor").alias("p"), F.explode(blocks("all")).alias("q"))
    every = rows.select("k", "u", "c", F.lit(1).alias("side"), F.explode(blocks("minor")).alias("p"), block("all").alias("q"))
    cells = minor.unionByName(every).join(prints.select("u", "items"), "u")
    cells = cells.repartition("k", "p", "q").sortWithinPartitions("k", "p", "q", "side", "u").select("k", "p", "q", "side", "u", "c", "items")

    def compare(cell: list[tuple]) -> set[tuple[int, int]]:
        links: set[tuple[int, int]] = set()
        sets = {u: unpack(x) for _, u, _, x in cell}
        right = [(v, d) for side, v, d, _ in cell if side]
        sizes = np.array([len(sets[v]) for v, _ in right])
        for side, u, c, _ in cell:
            if side:
                break
            n = len(sets[u])
            for j in np.flatnonzero((np.minimum(sizes, n) >= least * np.maximum(sizes, n) - 1e-9)).tolist():
                v, d = right[j]
                if c != d and (c, d) not in links and (d, c) not in links and similar(sets[u], sets[v], least):
                    links.add((c, d))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells lie one after another in a partition; one is held at a time."""

        def links() -> Iterator[tuple[int, int]]:
            key, cell = None, []
            for batch in batches:
                for k, p, q, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if (k, p, q) != key:
                        yield from compare(cell)
                        key, cell = (k, p, q), []
                    cell.append(row)
            yield from compare(cell)

        found = sorted(set(links()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return cells.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, a, b, class_id, class_size, kept of each of docs(doc_id, text)."""
    rows = staged(_sign(docs))
    sort = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    texts = rows.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("first_id"), F.min(sort).alias("best"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    size = F.greatest(F.col("n") - (WORDS - 1), F.lit(1))
    texts = staged(texts.withColumns({"u": F.monotonically_increasing_id(), "size": size}))
    member = texts.select("u", "size", F.explode("bands").alias("k"))
    leader = F.min(F.struct(F.col("u").alias("v"), F.col("size").alias("n")))  # one order for all buckets, so that pairs recur
    buckets = member.groupBy("k").agg(F.count("*").alias("in"), leader.alias("l")).where("in > 1").select("k", "l.v", F.col("l.n").alias("n"))
    member = staged(member.join(staged(buckets), "k"))
    alike = F.least("size", "n") >= least * F.greatest("size", "n") - 1e-9
    pairs = member.where("u <> v").where(alike).select("u", "v").distinct()
    wanted = texts.join(member.select("u").distinct(), "u", "left_semi").select("a", "b", "first_id", "u")
    prints = staged(_fingerprints(docs, wanted))
    labels = components(staged(_verified(pairs, prints, least)))
    more = staged(_compare_blocks(member.select("k", "u"), labels, prints, least))
    named = texts.select("u", "a", "b", "best", "m").join(labels, "u", "left").withColumn("c", F.coalesce("c", "u"))
    if more.limit(1).count():
        named = named.join(components(more).select(F.col("u").alias("c"), F.col("c").alias("joint")), "c", "left").withColumn("c", F.coalesce("joint", "c"))
    named = staged(named.select("a", "b", "best", "m", "c"))
    classes = staged(named.groupBy("c").agg(F.min("best").alias("first"), F.sum("m").alias("size")))
    out = rows.select("row", "doc_id", "a", "b").join(staged(named.select("a", "b", "c").join(classes, "c").drop("c")), ["a", "b"], "left")
    return out.select(
        "doc_id", "a", "b",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).alias("class_size"),
        (F.col("size").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay: one of each class."""
    kept = staged(near_duplicates(docs, **options).where("kept").groupBy("a", "b", "doc_id").agg(F.count("*").alias("m")))
    key, worded = content_key(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")).rlike(r"\S")
    rows = docs.select(packed(docs).alias("doc"), key["a"].alias("a"), key["b"].alias("b"), F.col("doc_id").cast("bigint").alias("id"), worded.alias("worded"))
    rows = rows.join(kept.withColumnRenamed("doc_id", "kept_id"), ["a", "b"]).where(F.col("id").eqNullSafe(F.col("kept_id")))
    once = rows.where("worded").groupBy("a", "b", "id").agg(F.first("doc").alias("doc"))
    return once.select("doc").unionByName(rows.where("not worded").select("doc")).select(*unpacked(docs, docs.columns))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")
