"""The measure planner: which kernels a set of measures needs, and one Arrow-backed pass
over a collection of graphs that computes them.

A graph is one row before the kernel: its edges are packed as an array (partial aggregation
puts a graph's rows together), so many small graphs share a task and a kernel never sees
another graph's rows. Distances, betweenness and the like are computed once per graph and
only when a requested measure needs them. `register_measure` adds a user's measure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import kernels as K


class Graph:
    """One graph with lazily shared intermediate results."""

    def __init__(self, w: np.ndarray, directed: np.ndarray | None = None, groups: np.ndarray | None = None, seed: int = 0):
        self.w, self.directed, self.groups, self.seed = w, directed if directed is not None else w, groups, seed
        self.negative = bool((w < 0).any())

    @cached_property
    def a(self) -> np.ndarray:
        return K.binary(self.w)

    @cached_property
    def d(self) -> np.ndarray:
        return K.distances(self.a)

    @cached_property
    def lengths(self) -> np.ndarray:
        """Weights as lengths: 1 / w."""
        return np.divide(1.0, self.w, out=np.zeros_like(self.w), where=self.w != 0)

    @cached_property
    def dw(self) -> np.ndarray:
        return np.full_like(self.w, np.nan) if self.negative else K.distances(self.lengths, True)

    @cached_property
    def between(self) -> tuple[np.ndarray, np.ndarray]:
        return K.betweenness(self.a)

    @cached_property
    def community(self) -> np.ndarray:
        return self.groups if self.groups is not None else K.communities(self.a, "louvain", seed=self.seed)

    @cached_property
    def community_wt(self) -> np.ndarray:
        return self.groups if self.groups is not None else K.communities(self.w, "louvain", **({} if self.negative else {"seed": self.seed}))


VERTEX: dict[str, Callable[[Graph], np.ndarray]] = {
    "degree": lambda g: g.a.sum(1),
    "strength": lambda g: g.w.sum(1),
    "E.nodal": lambda g: K.nodal_efficiency(g.d),
    "E.nodal.wt": lambda g: K.nodal_efficiency(g.dw),
    "E.local": lambda g: K.local_efficiency(g.a),
    "E.local.wt": lambda g: K.local_efficiency(g.lengths, True),
    "Lp": lambda g: K.vertex_path_length(g.d),
    "Lp.wt": lambda g: K.vertex_path_length(g.dw),
    "eccentricity": lambda g: K.eccentricity(g.d),
    "clo.cent": lambda g: K.closeness(g.d),
    "vulnerability": lambda g: K.vulnerability(g.a),
    "vulnerability.wt": lambda g: K.vulnerability(g.lengths, True),
    "comp": lambda g: K.components(g.w),
    "btwn.cent": lambda g: g.between[0],
    "coreness": lambda g: K.coreness(g.a),
    "s.core": lambda g: K.s_core(g.w),
    "ev.cent": lambda g: K.leading_vector(g.a),
    "ev.cent.wt": lambda g: K.leading_vector(g.w),
    "pagerank": lambda g: K.pagerank(g.a),
    "subg.cent": lambda g: K.subgraph_centrality(g.a),
    "communicability": lambda g: K.communicability_betweenness(g.a),
    "hub.score": lambda g: K.hits(g.directed)[0],
    "authority.score": lambda g: K.hits(g.directed)[1],
    "transitivity": lambda g: K.clustering(g.a),
    "transitivity.wt": lambda g: K.barrat(g.w),
    "triangles": lambda g: K.triangles(g.a),
    "knn": lambda g: K.knn(g.w),
    "knn.wt": lambda g: K.knn(g.w, True),
    "lev.cent": lambda g: K.leverage(g.a),
    "community": lambda g: g.community,
    "community.wt": lambda g: g.community_wt,
    "PC": lambda g: K.participation(g.a, g.community),
    "z.score": lambda g: K.within_module_z(g.a, g.community),
    "GC": lambda g: K.gateway(g.a, g.community, g.between[0]),
    "PC.wt": lambda g: K.participation(g.w, g.community_wt),
    "z.score.wt": lambda g: K.within_module_z(g.w, g.community_wt),
    "GC.wt": lambda g: K.gateway(g.w, g.community_wt, g.between[0]),
    "hubs": lambda g: K.hubness(g.a.sum(1), g.between[0], K.clustering(g.a), K.vertex_path_length(g.d)),
    "hubs.wt": lambda g: K.hubness(g.w.sum(1), g.between[0], np.nan_to_num(K.barrat(g.w)), K.vertex_path_length(g.dw)),
}
GRAPH: dict[str, Callable[[Graph], float]] = {
    "density": lambda g: g.a.sum() / (len(g.a) * (len(g.a) - 1)) if len(g.a) > 1 else np.nan,
    "strength": lambda g: g.w.sum(1).mean(),
    "Cp": lambda g: K.mean_clustering(g.a),
    "Lp": lambda g: K.path_length(g.d),
    "Lp.wt": lambda g: np.nan if g.negative else K.path_length(g.dw),
    "E.global": lambda g: K.global_efficiency(g.d),
    "E.global.wt": lambda g: np.nan if g.negative else K.global_efficiency(g.dw),
    "E.local": lambda g: K.local_efficiency(g.a).mean(),
    "E.local.wt": lambda g: np.nan if g.negative else K.local_efficiency(g.lengths, True).mean(),
    "mod": lambda g: K.modularity(g.a, g.community),
    "mod.wt": lambda g: K.modularity(g.w, g.community_wt),
    "assortativity": lambda g: K.assortativity(g.a),
    "transitivity": lambda g: K.transitivity(g.a),
    "diameter": lambda g: K.diameter(g.d),
    "diameter.wt": lambda g: np.nan if g.negative else K.diameter(g.dw),
    "num.hubs": lambda g: float((VERTEX["hubs"](g) >= 2).sum()),
    "num.hubs.wt": lambda g: np.nan if g.negative else float((VERTEX["hubs.wt"](g) >= 2).sum()),
    "num.tri": lambda g: K.triangles(g.a).sum() / 3,
    "max.comp": lambda g: float(np.bincount(K.components(g.a)).max(initial=0)),
    "vulnerability": lambda g: K.vulnerability(g.a).max(initial=0),
}
DIRECTED = ("hub.score", "authority.score")
NO_NEGATIVE = ("E.nodal.wt", "E.local.wt", "Lp.wt", "vulnerability.wt", "hubs.wt", "s.core")


def register_measure(name: str, level: str, fn: Callable[[Graph], object]) -> None:
    """A user's measure: fn(Graph) -> an array over vertices, or a number."""
    {"vertex": VERTEX, "graph": GRAPH}[level][name] = fn


def packed(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, vs (sorted), es (structs src, dst, weight): one row a graph."""
    v = vertices.groupBy("gid").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    e = edges.groupBy("gid").agg(F.collect_list(F.struct("src", "dst", F.col("weight").cast("double").alias("weight"))).alias("es"))
    return v.join(e, "gid", "left")


def matrix(vs, es, directed: bool = False) -> np.ndarray:
    at = {v: i for i, v in enumerate(vs)}
    w = np.zeros((len(at), len(at)))
    for e in () if es is None else es:
        i, j = at[e["src"]], at[e["dst"]]
        w[i, j] = e["weight"]
        if not directed:
            w[j, i] = e["weight"]
    np.fill_diagonal(w, 0)
    return w


def _clean(x: float) -> float | None:
    return None if x is None or not np.isfinite(x) else float(x)


def _map_graphs(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(gid, vs, es) -> list of tuples, over packed rows; batches are small, graphs big."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [t for g, vs, es in zip(part.gid, part.vs, part.es) for t in fn(g, list(vs), es)]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def vertex_measures(vertices: DataFrame, edges: DataFrame, which: list[str], groups: dict | None = None, directed: bool = False, seed: int = 0) -> DataFrame:
    """gid, v, measure, value (NULL: undefined). groups: module of each vertex (a region
    dimension); without it communities are Louvain's."""
    fns = {m: VERTEX[m] for m in which}

    def one(gid, vs, es):
        w = matrix(vs, es, directed)
        g = Graph(np.maximum(w, w.T) if directed else w, w, np.array([groups[v] for v in vs]) if groups else None, seed)
        out = []
        for m, fn in fns.items():
            values = [None] * len(vs) if g.negative and m in NO_NEGATIVE else fn(g)
            out += [(gid, v, m, _clean(x)) for v, x in zip(vs, values)]
        return out

    return _map_graphs(packed(vertices, edges), one, "gid string, v int, measure string, value double")


def graph_measures(vertices: DataFrame, edges: DataFrame, which: list[str], groups: dict | None = None, seed: int = 0) -> DataFrame:
    """gid, measure, value."""
    fns = {m: GRAPH[m] for m in which}

    def one(gid, vs, es):
        g = Graph(matrix(vs, es), None, np.array([groups[v] for v in vs]) if groups else None, seed)
        return [(gid, m, _clean(fn(g))) for m, fn in fns.items()]

    return _map_graphs(packed(vertices, edges), one, "gid string, measure string, value double")


def wide(long: DataFrame, which: list[str], keys: tuple[str, ...]) -> DataFrame:
    """One column a measure (dots become underscores)."""
    return long.groupBy(*keys).agg(*(F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m.replace(".", "_")) for m in which))


def edge_betweenness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    def one(gid, vs, es):
        e = K.betweenness(matrix(vs, es))[1]
        at = {v: i for i, v in enumerate(vs)}
        return [(gid, x["src"], x["dst"], float(e[at[x["src"]], at[x["dst"]]])) for x in (() if es is None else es)]

    return _map_graphs(packed(vertices, edges), one, "gid string, src int, dst int, btwn double")


def path_table(vertices: DataFrame, edges: DataFrame, weighted: bool = False) -> DataFrame:
    """gid, i, j, d of reachable pairs i < j."""

    def one(gid, vs, es):
        w = matrix(vs, es)
        d = K.distances(w if weighted else K.binary(w), weighted)
        return [(gid, vs[i], vs[j], float(d[i, j])) for i in range(len(vs)) for j in range(i + 1, len(vs)) if np.isfinite(d[i, j])]

    return _map_graphs(packed(vertices, edges), one, "gid string, i int, j int, d double")


def communities(vertices: DataFrame, edges: DataFrame, method: str = "louvain", weighted: bool = False) -> DataFrame:
    def one(gid, vs, es):
        w = matrix(vs, es)
        return [(gid, v, int(c)) for v, c in zip(vs, K.communities(w if weighted else K.binary(w), method))]

    return _map_graphs(packed(vertices, edges), one, "gid string, v int, community int")


def robustness(vertices: DataFrame, edges: DataFrame, kind: str = "vertex", measure: str = "btwn.cent", n: int = 1000, seed: int = 0) -> DataFrame:
    def one(gid, vs, es):
        return [(gid, i, float(x), float(s), float(r)) for i, (x, s, r) in enumerate(zip(*K.robustness(matrix(vs, es), kind, measure, n, seed)))]

    return _map_graphs(packed(vertices, edges), one, "gid string, removed int, removed_pct double, comp_size double, comp_pct double")


def random_graphs(vertices: DataFrame, edges: DataFrame, n: int = 100, clustering: bool = False, seed: int = 0) -> DataFrame:
    """Edges of n random graphs for each graph: gid, rand_id, src, dst, weight. Draws are
    rows: every (graph, rand_id) is a task's item with its own seed."""
    rows = packed(vertices, edges).withColumn("rand_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    schema = "gid string, rand_id int, src int, dst int, weight double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for gid, vs, es, r in zip(part.gid, part.vs, part.es, part.rand_id):
                vs, w = list(vs), K.binary(matrix(list(vs), es))
                key = [seed, r, *gid.encode()]
                b = K.clustered(w, K.transitivity(w), key) if clustering else K.degree_sequence(w, key) if K.components(w).max(initial=1) == 1 else K.rewire(w, key)
                out += [(gid, r, vs[i], vs[j], 1.0) for i, j in zip(*np.nonzero(np.triu(b, 1)))]
            yield pd.DataFrame(out, columns=["gid", "rand_id", "src", "dst", "weight"])

    return rows.repartition("gid", "rand_id").mapInPandas(run, schema)


def random_measures(vertices: DataFrame, edges: DataFrame, n: int = 100, clustering: bool = False, seed: int = 0, which: tuple[str, ...] = ("mod", "Cp", "Lp", "E.global")) -> DataFrame:
    """gid, rand_id and the short list of measures of the random graphs, without writing
    the graphs."""
    rows = packed(vertices, edges).withColumn("rand_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    names = [m.replace(".", "_").lower() for m in which]
    schema = "gid string, rand_id int, " + ", ".join(f"{m} double" for m in names)
    fns = [GRAPH[m] for m in which]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for gid, vs, es, r in zip(part.gid, part.vs, part.es, part.rand_id):
                w = K.binary(matrix(list(vs), es))
                key = [seed, r, *gid.encode()]
                b = K.clustered(w, K.transitivity(w), key) if clustering else K.degree_sequence(w, key) if K.components(w).max(initial=1) == 1 else K.rewire(w, key)
                g = Graph(b)
                out.append((gid, r, *(_clean(f(g)) for f in fns)))
            yield pd.DataFrame(out, columns=["gid", "rand_id", *names])

    return rows.repartition("gid", "rand_id").mapInPandas(run, schema)
