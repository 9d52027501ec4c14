"""Byte-level BPE encoding and decoding with DuckDB recursive queries per partition.

Encoding. The pre-tokeniser pattern is a tiling by runs of character classes, so it is
computed for a whole chunk of documents at once on an array of code points; the distinct
pieces of the chunk go to DuckDB, where a recursive query unnests each word into
token-position rows, joins adjacent pairs with the merge table, finds each word's leftmost
pair of least rank, contracts it, and repeats until no word has a pair left. Every document
is then the concatenation of its pieces' ids.

Decoding starts from the ids alone. The id stream of a chunk is cut before every token whose
bytes start with a space; DuckDB joins the tokens of the distinct runs with the vocabulary
and an ordered aggregation joins their bytes; the runs are put together again per document.

Pieces longer than `LONG_PIECE` bytes (a run of one letter, say) would need as many rounds
of the recursion as they have bytes; they are merged by a heap in O(n log n) instead, with
the same result. What the vocabulary's pattern is, is asserted.

Nulls and empty texts encode to no tokens. Repeated rows, ties and extra columns are
harmless: a row's result depends on its text alone, and other columns are not read. An empty
table gives an empty result.
Memory per task is bounded by a chunk (0.5 MB of text, or the longest text) and by a memo of
`MEMO` pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from netloom.llm.common import chunks

LONG_PIECE = 256
#: The pattern that `piece_starts` works out (a fixed value: what the vocabulary was made with).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 200_000
MERGED = 10_000
CHUNK = 500_000
SPACE, LETTER, NUMBER, OTHER, QUOTE = range(5)

_RECURSION = """
with recursive s(w, t) as (
  select w, t from words
  union all
  select s.w, s.t[: (b.m & 1023)::int - 1] || [(b.m >> 10)::uinteger] || s.t[(b.m & 1023)::int + 2 :]
  from s join (
    select w, min(r::bigint * 1024 + pos) m from (
      select w, unnest(t[: -2])::bigint * 4294967296 + unnest(t[2 :]) p, generate_subscripts(t[2 :], 1) pos
      from s) u
    join merges on merges.p = u.p group by w) b
  on s.w = b.w
)
select w, arg_min(t, len(t)) t from s group by w order by w"""

_DECODE = """
select pos >> 14 k, list(b order by pos) l from runs join vocab using (id) group by k order by k"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point; white space as in Unicode, which leaves out the
    separators U+001C to U+001F that Python's isspace() holds."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            out[i] = LETTER
        elif c.isnumeric():
            out[i] = NUMBER
        elif c.isspace() and not 0x1C <= i <= 0x1F:
            out[i] = SPACE
    # isnumeric() also holds ideographs, but those are letters; it holds nothing else outside N*
    return out


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start in the code points of texts laid end to end, the
    texts starting at `first`:
    's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+ ."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[cp]
    head = np.zeros(n + 4, bool)
    head[n:] = True
    head[first[first < n]] = True
    run = np.ones(n + 4, bool)
    run[1:n] = cls[1:] != cls[:-1]
    run |= head
    flag = run[:n].copy()
    space = cls == SPACE
    # the last white space before other text stands alone, and a blank joins what follows
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n])
    flag[last] = True
    flag[last[cp[last] == 32] + 1] = False
    # contractions: a lone quote that starts a piece
    q = np.flatnonzero((cp == 39) & flag & run[:n] & run[1 : n + 1] & ~head[1 : n + 1])
    if len(q):
        at = np.concatenate([cp, np.zeros(4, cp.dtype)])
        one, two = at[q + 1], at[q + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        pair = ~head[q + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for where, step in ((q[short], 2), (q[pair & ~short], 3)):
            flag[where + 1] = False
            end = where + step
            flag[end[end < n]] = True
    return np.flatnonzero(flag)


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Pieces:
    """Distinct pieces of an array and, for each piece, which one it is. Pieces are grouped
    by a 64-bit hash, and every element is compared with its representative's, so that a
    collision is found and resolved, not merged."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, powers: np.ndarray, inverse: np.ndarray):
        n = len(data)
        self.starts, self.lengths = starts, np.diff(np.append(starts, n))
        with np.errstate(over="ignore"):
            x = data.astype(np.uint64) + np.uint64(0x51ED270B)
            x = (x ^ (x << np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) * powers[:n]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
            h = (total[starts + self.lengths] - total[starts]) * inverse[starts]
            h ^= h >> np.uint64(29)
        _, self.rep, self.of = np.unique(h, return_index=True, return_inverse=True)
        moved = np.repeat((starts[self.rep[self.of]] - starts).astype(np.int32), self.lengths)
        moved += np.arange(n, dtype=np.int32)
        same = self.lengths[self.rep[self.of]] == self.lengths
        if not (same.all() and (data[np.minimum(moved, n - 1)] == data).all()):
            seen: dict[bytes, int] = {}
            keys = [data[s : s + k].tobytes() for s, k in zip(starts, self.lengths)]
            self.of = np.array([seen.setdefault(k, len(seen)) for k in keys])
            self.rep = np.unique(self.of, return_index=True)[1]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices `of` of `flat` laid end to end, and where each begins (and the end)."""
    k = lengths[of]
    ends = np.concatenate([[0], np.cumsum(k)])
    if not ends[-1]:
        return flat[:0], ends
    return flat[np.repeat(starts[of] - ends[:-1], k) + np.arange(ends[-1])], ends


def _bytes_of(a: pa.Array) -> np.ndarray:
    """The bytes of a binary array's values end to end."""
    kind = np.int64 if pa.types.is_large_binary(a.type) else np.int32
    at = np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


class Codec:
    """Encoder and decoder of one Python worker; DuckDB runs with one thread."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.byte_id = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (self.byte_id < 0).any():
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        left, rank = [], []
        for b, r in ranks.items():
            for i in range(1, len(b)):
                x, y = ranks.get(b[:i]), ranks.get(b[i:])
                if x is not None and y is not None:
                    left.append(x << 32 | y)
                    rank.append(r)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("m_", pa.table({"p": pa.array(left, pa.int64()), "r": pa.array(rank, pa.int32())}))
        self.db.execute("create table merges as select * from m_")
        self.db.register("v_", pa.table({"id": pa.array(ranks.values(), pa.uint32()), "b": pa.array(ranks.keys(), pa.binary())}))
        self.db.execute("create table vocab as select * from v_")
        size = max(ranks.values()) + 1
        self.opens, self.sizes = np.zeros(size, bool), np.zeros(size, np.int64)
        for b, r in ranks.items():
            self.opens[r] = b[:1] == b" "
            self.sizes[r] = len(b)
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        self.memo: dict[bytes, bytes] = {}
        self.powers = _powers(1, BASE)
        self.inverse = _powers(1, INVERSE)

    def _power(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers, self.inverse = _powers(n + n // 4, BASE), _powers(n + n // 4, INVERSE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as 32-bit integers."""
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) > LONG_PIECE:
                out[i] = self.long_merge(w).tobytes()
            else:
                rest.append(i)
        for k in range(0, len(rest), MERGED):
            part = rest[k : k + MERGED]
            flat = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            ends = np.zeros(len(part) + 1, np.int32)
            np.cumsum([len(words[i]) for i in part], out=ends[1:])
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.byte_id[flat].astype(np.uint32)))
            self.db.register("words", pa.table({"w": pa.array(np.arange(len(part), dtype=np.int32)), "t": tokens}))
            t = self.db.sql(_RECURSION).to_arrow_table().column("t").combine_chunks()
            t = t.chunk(0) if isinstance(t, pa.ChunkedArray) else t
            at, ids = (t.offsets.to_numpy() * 4).tolist(), t.values.to_numpy().astype("<u4").tobytes()
            for j, i in enumerate(part):
                out[i] = ids[at[j] : at[j + 1]]
        return out

    def long_merge(self, word: bytes) -> np.ndarray:
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0: merged away
        before = list(range(-1, n - 1))

        def rank(i: int) -> int | None:
            j = end[i]
            return ranks.get(word[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, e = heapq.heappop(heap)
            if not end[i] or (j := end[i]) >= n or end[j] != e:
                continue
            end[i], end[j] = e, 0
            if e < n:
                before[e] = i
            for k in (before[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k, end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return np.array(out, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (and the end)."""
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        self._power(len(cp) + 1)
        p = Pieces(cp, piece_starts(cp, first), self.powers, self.inverse)
        if len(self.memo) > MEMO:
            self.memo.clear()
        words = [whole[s : s + k].encode("utf-8", "replace") for s, k in zip(p.starts[p.rep].tolist(), p.lengths[p.rep].tolist())]
        new = [w for w in words if w not in self.memo]
        self.memo.update(zip(new, self.merge(new)))
        each = [self.memo[w] for w in words]
        lengths = np.array([len(x) for x in each], np.int64) // 4
        ids, ends = ragged(np.frombuffer(b"".join(each), "<u4").astype(np.uint32), np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths, p.of)
        return ids, ends[np.searchsorted(p.starts, first)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text, from its ids alone."""
        if not len(ids):
            return [b""] * (len(ends) - 1)
        if ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id is not in the vocabulary")
        cut = self.opens[ids]
        cut[ends[:-1][ends[:-1] < len(ids)]] = True
        self._power(len(ids) + 1)
        p = Pieces(ids, np.flatnonzero(cut), self.powers, self.inverse)
        k = p.lengths[p.rep]
        tokens, at = ragged(ids, p.starts, p.lengths, p.rep)
        self.db.register("runs", pa.table({"pos": pa.array(np.arange(len(tokens), dtype=np.int64)), "id": pa.array(tokens)}))
        blocks = self.db.sql(_DECODE).to_arrow_table().column("l").chunks
        data = np.concatenate([_bytes_of(x.flatten()) for x in blocks])
        starts = np.concatenate([[0], np.cumsum(self.sizes[tokens])])[at]
        out, bounds = ragged(data, starts[:-1], np.diff(starts), p.of)
        where = bounds[np.searchsorted(p.starts, ends)]
        raw = out.tobytes()
        return [raw[a:b] for a, b in zip(where[:-1].tolist(), where[1:].tolist())]


_codecs: dict[str, Codec] = {}


def codec(ranks: dict[bytes, int]) -> Codec:
    key = hashlib.sha256(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()).hexdigest() if len(ranks) < 2000 else f"{len(ranks)} {hash(frozenset(ranks.items()))}"
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks)
    return _codecs[key]


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs(doc_id, text), and
    the ids themselves `with_ids`. The vocabulary (bounded: one file) is broadcast."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for part in chunks(batches, limit=CHUNK):
            c = c or codec(shared.value)
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids, ends = c.encode(texts)
            raw, bounds = ids.astype("<u4").tobytes(), (ends * 4).tolist()
            decoded = c.decode(ids, ends)
            columns = [
                part.column(0).cast(pa.int64()),
                pa.array(np.diff(ends), pa.int64()),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def check_pattern(pattern: str) -> None:
    """`piece_starts` is one pattern worked out by hand: another one must not pass silently."""
    if pattern != PATTERN:
        raise ValueError(f"the pre-tokeniser is built for {PATTERN!r}, not for {pattern!r}")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from netloom.llm.common import documents

    check_pattern(public_tokenizers.PATTERN)
    return encode_decode(documents(spark, sf_dir), read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
