"""Measures of one large graph, for which a dense matrix is too big: the same values as
`measures.graph_measures`, from packed rows of neighbours.

Edges become rows (vertex, first neighbour, gaps to the next ones) and are written once.
Distances and triangles come from panels: a panel is a component and up to 4,096 of its
vertices as bits, a task reads the component's rows from a temporary file of its own and holds
two bits a vertex of the component and one of the panel. Modularity is Louvain's, whose moves
follow one another: one task with numbers a vertex, and the rows in a file. The driver holds two
numbers a vertex. Distances of all pairs are quadratic work: a component of m vertices has
m / 4,096 panels, and each gets all its rows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.storage import staged

MEASURES = ("Cp", "Lp", "E.global", "mod", "diameter", "assortativity")
#: Words of 64 vertices in a panel, and of all rows of one panel in memory.
PANEL, HELD = 64, 2**25
#: Links of labels and vertices that Louvain keeps.
LINKS = 2**23
#: Rows of neighbours' bits that are read at once.
STEP, NEAR = 512, 256
PIECE = "at int, start int, gaps binary"
SUMS = "kind string, at long, n decimal(38,0), x double"


def graph_measures(vertices: DataFrame, edges: DataFrame, which: list[str]) -> DataFrame:
    """gid, measure, value (NULL: undefined) of the one graph in vertices (gid, v) and edges
    (gid, src, dst, weight). Loops and weights of zero are no edges."""
    spark = vertices.sparkSession
    if unknown := sorted(set(which) - set(MEASURES)):
        raise ValueError(f"not measured on large graphs: {unknown}")
    gids = [r["gid"] for r in vertices.select("gid").distinct().limit(2).collect()]
    if len(gids) > 1:
        raise ValueError("one graph, not several")
    schema = "gid string, measure string, value double"
    if not gids:
        return spark.createDataFrame([], schema)
    names = np.sort(vertices.select("v").distinct().toPandas()["v"].to_numpy())  # a number a vertex
    rows = staged(packed(edges, names))
    parts = _panels(rows, _roots(rows, len(names)), "Cp" in which)
    if "mod" in which:
        n = len(names)
        parts = parts.unionByName(rows.coalesce(1).mapInArrow(lambda batches: _modularity(batches, n), SUMS))
    sums = {(r["kind"], r["at"]): (int(r["n"]), r["x"]) for r in parts.groupBy("kind", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()}  # a row a distance
    values = _values(len(names), sums)
    return spark.createDataFrame([(gids[0], m, values[m]) for m in which], schema)


def _values(n: int, sums: dict) -> dict[str, float | None]:
    pairs = {d: c for (kind, d), (c, _) in sums.items() if kind == "pairs"}
    many, cp = sums.get(("clustering", 0), (0, 0.0))
    k1, k2, k3, kk = (sums.get(("degree", p), (0, 0.0))[0] for p in (1, 2, 3, 0))  # over both ends of each edge
    spread = k1 * k3 - k2 * k2
    return {
        "Cp": cp / many if many else None,
        "Lp": sum(d * c for d, c in pairs.items()) / sum(pairs.values()) if pairs else None,
        "E.global": sum(c / d for d, c in sorted(pairs.items())) / (n * (n - 1)) if n > 1 else 0.0,
        "mod": sums["mod", 0][1] if ("mod", 0) in sums else None,
        "diameter": float(max(pairs, default=0)),
        "assortativity": (k1 * kk - k2 * k2) / spread if spread else None,
    }


# Rows of neighbours


def packed(edges: DataFrame, names: np.ndarray) -> DataFrame:
    """at, start, gaps: pieces of the sorted neighbours of each vertex, by their ranks in `names`:
    the first one, and the steps to each from the one before (16 bits; the first is 0)."""
    shared = edges.sparkSession.sparkContext.broadcast(names)
    one, other = F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))
    ends = edges.where("src <> dst AND coalesce(weight <> 0, true)").select(F.explode(F.array(one, other)).alias("e")).select("e.a", "e.b")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = shared.value, (-1, -1)
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(a):
                continue
            at, to = (np.minimum(np.searchsorted(names, x), len(names) - 1) for x in (a, b))
            if (names[at] != a).any() or (names[to] != b).any():
                raise KeyError("an edge's end is not among the vertices")
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (to[1:] != to[:-1])
            new[0] = (at[0], to[0]) != last
            last = (at[-1], to[-1])
            at, to = at[new], to[new]
            if not len(at):
                continue
            gaps = np.diff(to, prepend=0)
            first = np.ones(len(at), bool)
            first[1:] = (at[1:] != at[:-1]) | (gaps[1:] > 0xFFFF)
            gaps[first] = 0
            small, cuts = gaps.astype(np.uint16), [*np.flatnonzero(first).tolist(), len(at)]
            pieces = [small[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(to[first].astype(np.int32)), pa.array(pieces, pa.binary())], ["at", "start", "gaps"])

    return ends.repartition("a").sortWithinPartitions("a", "b").mapInArrow(pack, PIECE)


def _pieces(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    at, start, gaps = (batch.column(batch.schema.get_field_index(c)) for c in ("at", "start", "gaps"))
    return at.to_numpy(), start.to_numpy(), gaps.to_pylist()


class Rows:
    """Sorted neighbours of each vertex, in a temporary file of the task."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.parts, self.end = [], 0

    def add(self, at: np.ndarray, start: np.ndarray, gaps: list[bytes]) -> None:
        sizes = np.array([len(g) for g in gaps], np.int64)
        self.file.write(b"".join(gaps))
        self.parts.append((at.astype(np.int64), start.astype(np.int64), self.end + np.cumsum(sizes) - sizes, sizes))
        self.end += int(sizes.sum())

    def close(self) -> None:
        self.file.close()

    def ready(self) -> Rows:
        """To be called after the last `add`. `at`: the vertices that have neighbours, sorted."""
        self.file.flush()
        at, start, offset, size = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((start, at))
        self.start, self.offset, self.size = start[order].tolist(), offset[order].tolist(), size[order].tolist()
        self.at, first = np.unique(at[order], return_index=True)
        self.first = [*first.tolist(), len(at)]
        self.degree = np.add.reduceat(size[order], first) // 2 if len(at) else size
        self.parts = []
        return self

    def row(self, k: int) -> np.ndarray:
        """Neighbours of the vertex at[k]."""
        out = [np.cumsum(np.frombuffer(os.pread(self.file.fileno(), self.size[j], self.offset[j]), np.uint16), dtype=np.int64) + self.start[j] for j in range(self.first[k], self.first[k + 1])]
        return out[0] if len(out) == 1 else np.concatenate(out)


# Components


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of all vertices after the edges a - b are added to the roots `parent`."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _roots(rows: DataFrame, n: int) -> np.ndarray:
    """The least vertex of each one's component. Tasks turn their edges into a forest, whose
    edges one task joins."""

    def told(parent: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(parent != np.arange(n)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(parent[own].astype(np.int32))], ["a", "b"])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent = np.arange(n)
        for batch in batches:
            at, start, gaps = _pieces(batch)
            for k in range(0, len(at), 256):
                ids = [np.cumsum(np.frombuffer(g, np.uint16), dtype=np.int64) + s for g, s in zip(gaps[k : k + 256], start[k : k + 256])]
                parent = joined(parent, np.repeat(at[k : k + 256], [len(x) for x in ids]), np.concatenate(ids))
        yield told(parent)

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent = np.arange(n)
        for batch in batches:
            parent = joined(parent, batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield told(parent)

    found = rows.coalesce(32).mapInArrow(forest, "a int, b int").repartition(1).mapInArrow(tree, "a int, b int").toPandas()  # a row a vertex
    roots = np.arange(n)
    roots[found["a"].to_numpy()] = found["b"].to_numpy()
    return roots


# Panels


def _words(m: np.ndarray) -> np.ndarray:
    """Words in a panel of a component of m vertices."""
    return np.maximum(1, np.minimum(np.minimum(PANEL, -(-m // 64)), HELD // np.maximum(m, 1)))


def _panels(rows: DataFrame, roots: np.ndarray, triangles: bool) -> DataFrame:
    """Sums over ordered pairs at each distance, over the degrees of edges' ends, and of the
    clustering of the vertices."""
    sizes = np.bincount(roots, minlength=len(roots))
    number = np.where(sizes > 1, -(-sizes // (64 * _words(sizes))), 0)  # of panels, at the root
    first = np.cumsum(number) - number
    shared = rows.sparkSession.sparkContext.broadcast((roots.astype(np.int32), number.astype(np.int32), first))
    tasks = int(max(1, min(number.sum(), 400)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, number, first = shared.value
        for batch in batches:
            root = roots[batch.column(0).to_numpy()]
            for p in range(int(number[root].max(initial=0))):
                mine = number[root] > p
                part = batch if mine.all() else batch.filter(pa.array(mine))
                panel = first[root[mine]] + p
                yield pa.RecordBatch.from_arrays([pa.array(panel), pa.array(panel % tasks, pa.int32()), pa.array(np.full(len(panel), p, np.int32)), *part.columns], ["panel", "task", "p", *part.schema.names])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, p, held = None, 0, None
        try:
            for batch in batches:
                panel, which = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                at, start, gaps = _pieces(batch)
                cuts = [0, *(np.flatnonzero(np.diff(panel)) + 1).tolist(), len(panel)]
                for i, j in zip(cuts, cuts[1:]):
                    if i == j:
                        continue
                    if panel[i] != now:
                        if held:
                            yield _told(panel_sums(held.ready(), p, triangles))
                            held.close()
                        now, p, held = panel[i], int(which[i]), Rows()
                    held.add(at[i:j], start[i:j], gaps[i:j])
            if held:
                yield _told(panel_sums(held.ready(), p, triangles))
        finally:
            if held:
                held.close()

    copies = rows.mapInArrow(dealt, f"panel long, task int, p int, {PIECE}")
    return copies.repartitionById(tasks, F.col("task")).sortWithinPartitions("panel", "at", "start").mapInArrow(measured, SUMS)


def _told(sums: list[tuple[str, int, int, float]]) -> pa.RecordBatch:
    kind, at, n, x = zip(*sums)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(at, pa.int64()), pa.array([Decimal(k) for k in n], pa.decimal128(38, 0)), pa.array(x, pa.float64())], ["kind", "at", "n", "x"])


def _ones(bits: np.ndarray) -> int:
    return sum(int(np.bitwise_count(bits[k : k + STEP]).sum()) for k in range(0, len(bits), STEP))


def panel_sums(near: Rows, p: int, triangles: bool) -> list[tuple[str, int, int, float]]:
    """Of the component `near`: the distances from all vertices to those of panel p, and what
    triangles with them add to the clustering. With panel 0 also what is counted once."""
    m = len(near.at)
    words = int(_words(np.array(m)))
    low, high = 64 * words * p, min(64 * words * (p + 1), m)
    local = np.zeros(int(near.at[-1]) + 1, np.int32)
    local[near.at] = np.arange(m)
    degree = near.degree
    bits = np.zeros((m, words), np.uint64)  # neighbours in the panel
    ends = 0
    for k in range(m):
        ids = local[near.row(k)]
        if p == 0:
            ends += int(degree[k]) * int(degree[ids].sum())
        inside = ids[np.searchsorted(ids, low) : np.searchsorted(ids, high)] - low
        if len(inside):
            flags = np.zeros(64 * words, bool)
            flags[inside] = True
            bits[k] = np.packbits(flags, bitorder="little").view("<u8")
    out = [("pairs", 1, _ones(bits), 0.0)]
    reached = bits.copy()
    own = np.arange(high - low)
    reached[own + low, own // 64] |= np.uint64(1) << (own % 64).astype(np.uint64)
    full = np.bitwise_or.reduce(reached, 0)  # a vertex of the panel reaches itself
    before, changed = _ones(reached), []
    theirs, ones = np.empty((STEP, words), np.uint64), np.empty((STEP, words), np.uint8)  # new arrays of this size cost more than the sums
    shared = np.zeros(m, np.int64)  # neighbours in the panel that a vertex and its neighbours share
    for k in range(m):
        done = bool((reached[k] == full).all())
        if done and not triangles:
            continue
        ids, got = local[near.row(k)], reached[k]
        for c in range(0, 0 if done else len(ids), NEAR):
            some = ids[c : c + NEAR]
            got = got | np.bitwise_or.reduce(np.take(bits, some, 0, out=theirs[: len(some)], mode="clip"), 0)
            if (got == full).all():
                break
        if not done and (got != reached[k]).any():
            changed.append(k)
            reached[k] = got
        if triangles and bits[k].any():
            ids = ids[np.searchsorted(ids, k) :]  # each edge once
            for c in range(0, len(ids), STEP):
                these = ids[c : c + STEP]
                np.take(bits, these, 0, out=theirs[: len(these)], mode="clip")
                np.bitwise_and(theirs[: len(these)], bits[k], out=theirs[: len(these)])
                common = np.bitwise_count(theirs[: len(these)], out=ones[: len(these)]).sum(1, dtype=np.uint32)
                shared[these] += common
                shared[k] += int(common.sum())
    many = degree > 1
    clustering = float((shared[many] / (degree[many] * (degree[many] - 1.0))).sum()) if triangles else 0.0
    d = 2
    while changed:
        after = _ones(reached)
        out.append(("pairs", d, after - before, 0.0))
        before, d = after, d + 1
        unfinished = (reached != full).any(1)
        if not unfinished.any():
            break
        bits[:] = 0
        for k in changed:
            ids = local[near.row(k)]
            ids = ids[unfinished[ids]]
            bits[ids] |= reached[k]
        changed = []
        for c in range(0, m, STEP):
            changed += (c + np.flatnonzero((bits[c : c + STEP] & ~reached[c : c + STEP]).any(1))).tolist()
        reached |= bits
    if p == 0:
        k = [int(x) for x in degree]
        out += [("degree", 0, ends, 0.0), ("degree", 1, sum(k), 0.0), ("degree", 2, sum(x**2 for x in k), 0.0), ("degree", 3, sum(x**3 for x in k), 0.0)]
    return out + [("clustering", 0, int(many.sum()) if p == 0 else 0, clustering)]


# Communities


class _Plain:
    """A graph of n vertices by its rows: neighbours and weights (None: all one)."""

    def __init__(self, rows: Rows, n: int):
        self.rows, self.place = rows, np.full(n, -1, np.int64)
        self.place[rows.at] = np.arange(len(rows.at))
        self.strength = np.zeros(n)
        self.strength[rows.at] = rows.degree
        self.loops = np.zeros(n)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray | None]:
        k = self.place[i]
        return (self.rows.row(k), None) if k >= 0 else (np.zeros(0, np.int64), None)

    def close(self) -> None:
        self.rows.close()


class _Merged:
    """What a graph becomes if its vertices with one label of `at` are one vertex."""

    def __init__(self, graph, at: np.ndarray, n: int):
        self.file, self.n = tempfile.TemporaryFile(), []
        self.strength, self.loops, self.offset = np.zeros(n), np.zeros(n), []
        members = np.split(np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=n))[:-1])
        end = 0
        for c, these in enumerate(members):
            if graph.strength[these].sum() < n:  # few neighbours: no array of all labels
                found = [graph.row(i) for i in these.tolist()]
                ids, inverse = np.unique(at[np.concatenate([x for x, _ in found])], return_inverse=True)
                weights = np.bincount(inverse, np.concatenate([np.ones(len(x)) if w is None else w for x, w in found]), len(ids))
            else:
                total = np.zeros(n)
                for i in these.tolist():
                    ids, w = graph.row(i)
                    total += np.bincount(at[ids], w, n)
                ids = np.flatnonzero(total)
                weights = total[ids]
            self.strength[c], self.loops[c] = weights.sum(), weights[ids == c].sum()
            self.file.write(ids.astype(np.int64).tobytes() + weights.astype(float).tobytes())
            self.offset.append(end)
            self.n.append(len(ids))
            end += 16 * len(ids)
        self.file.flush()

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        data = os.pread(self.file.fileno(), 16 * self.n[i], self.offset[i])
        return np.frombuffer(data, np.int64, self.n[i]), np.frombuffer(data, np.float64, self.n[i], 8 * self.n[i])

    def close(self) -> None:
        self.file.close()


def _moved(graph, total: float, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """One level of `kernels.louvain`: the same moves by the same sums (of whole numbers, so exact
    in any order)."""
    size, least = len(graph.strength), 1e-12 * total
    state = _Labels(graph, total, least)
    order = rng.permutation(size)
    order = order[graph.strength[order] > 0]  # the others never move
    gained = np.inf
    while gained > least * size:
        state.renumber()
        gained = state.counted(order) if len(state.mass) * size <= LINKS else state.visited(order)
    return np.unique(state.at, return_inverse=True)[1], state.moved


class _Labels:
    """Each vertex's label, and of each label its vertices' strength (infinite if there are none)."""

    def __init__(self, graph, total: float, least: float):
        self.graph, self.total, self.least, self.moved, self.links = graph, total, least, False, None
        self.s, n = graph.strength, len(graph.strength)
        self.at, self.mass, self.count = np.arange(n), self.s.copy(), np.ones(n, np.int64)

    def renumber(self) -> None:
        """Leaves out empty labels; the others keep their order, and so ties fall as before."""
        kept = np.flatnonzero(self.count)
        if len(kept) < len(self.count):
            self.at = (np.cumsum(self.count > 0) - 1)[self.at]
            self.mass, self.count = self.mass[kept], self.count[kept]
            self.links = None if self.links is None else self.links[kept]

    def move(self, i: int, new: int) -> None:
        old, self.moved = self.at[i], True
        self.mass[old] -= self.s[i]
        self.mass[new] += self.s[i]
        self.count[old] -= 1
        self.count[new] += 1
        self.at[i] = new
        if not self.count[old]:
            self.mass[old] = np.inf

    def visited(self, order: np.ndarray) -> float:
        """A pass that reads every vertex's neighbours."""
        graph, total, s, least, gained = self.graph, self.total, self.s, self.least, 0.0
        empty = 0
        for i in order.tolist():
            if 2 * empty > len(self.mass):
                self.renumber()
                empty = 0
            ids, w = graph.row(i)
            at, mass = self.at, self.mass
            old = at[i]
            link = np.bincount(at[ids], w, len(mass)).astype(float)
            link[old] -= graph.loops[i]
            score = link - mass * s[i] / total
            score[old] = link[old] - (mass[old] - s[i]) * s[i] / total
            new = int(score.argmax())
            if score[new] > score[old] + least:
                self.move(i, new)
                empty += not self.count[old]
                gained += score[new] - score[old]
        return gained

    def counted(self, order: np.ndarray) -> float:
        """A pass over kept links of labels and vertices. Vertices are looked at together up to
        the first that moves; only its neighbours are read."""
        graph, total, s, least, gained = self.graph, self.total, self.s, self.least, 0.0
        if self.links is None:
            self.links = np.zeros((len(self.mass), len(s)))
            for i in order.tolist():
                ids, w = graph.row(i)
                self.links[:, i] = np.bincount(self.at[ids], w, len(self.mass))
                self.links[self.at[i], i] -= graph.loops[i]
        k, width = 0, 16
        most = max(16, 2**18 // len(self.mass))
        while k < len(order):
            these = order[k : k + width]
            own, place, strength = self.at[these], np.arange(len(these)), s[these]
            links = self.links[:, these]
            score = links - self.mass[:, None] * strength / total
            here = links[own, place] - (self.mass[own] - strength) * strength / total
            score[own, place] = here
            best = score.argmax(0)
            value = score[best, place]
            moving = np.flatnonzero(value > here + least)
            if not len(moving):
                k, width = k + len(these), min(2 * width, most)
                continue
            j = int(moving[0])
            i, new = int(these[j]), int(best[j])
            ids, w = graph.row(i)
            if graph.loops[i]:
                w = np.where(ids == i, 0, w)
            self.links[own[j], ids] -= 1 if w is None else w
            self.links[new, ids] += 1 if w is None else w
            self.move(i, new)
            gained += value[j] - here[j]
            k, width = k + j + 1, max(8, min(2 * (j + 1), most))
        return gained


def louvain_modularity(rows: Rows, n: int, seed: int = 0) -> float | None:
    """Modularity of the communities that `kernels.louvain` finds in the binary graph."""
    graph, rng = _Plain(rows, n), np.random.default_rng(seed)
    total = float(graph.strength.sum())
    try:
        while total > 0:
            at, moved = _moved(graph, total, rng)
            if not moved:
                break
            merged = _Merged(graph, at, int(at.max()) + 1)
            graph.close()
            graph = merged
        return float((graph.loops / total - (graph.strength / total) ** 2).sum()) if total else None
    finally:
        graph.close()


def _modularity(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    rows = Rows()
    for batch in batches:
        rows.add(*_pieces(batch))
    yield _told([("mod", 0, 0, louvain_modularity(rows.ready(), n))])
