"""Collections of networks as one object: a graph table, a vertex table and an edge table.

All three are lazy DataFrames keyed by gid, so a collection of any number of graphs, subjects,
groups or thresholds is one plan, and methods return new collections or tables. Graphs: (gid,
sid, grp, ...); vertices: (gid, v, ...); edges: (gid, src, dst, weight); regions: (v, name, x,
y, z, lobe, hemi, ...), an atlas, which is small and broadcast.
"""

from __future__ import annotations

import platform
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import text
from netloom.operators import local, matrices, measures

#: What `measured` computes of a random graph; of an observed one it is everything.
SHORT = ("Cp", "Lp", "E.global", "mod")


@dataclass(frozen=True)
class Networks:
    graphs: DataFrame
    vertices: DataFrame
    edges: DataFrame
    regions: DataFrame | None = None
    kind: str = "observed"  # or random
    level: str = "subject"  # or group, contrast
    about: dict = field(default_factory=dict)

    # construction

    @classmethod
    def from_edges(cls, edges: DataFrame, regions: DataFrame, graphs: DataFrame | None = None, subnet: list[str] | None = None, **about) -> Networks:
        """edges: (gid, src, dst, weight), zero weights and loops left out. Every graph has
        all regions as vertices, or those whose names are in `subnet`. graphs: (gid, ...)
        where there are graphs without edges or more is known of them."""
        graphs = edges.select("gid").distinct() if graphs is None else graphs
        if subnet is not None:
            known = {r["name"] for r in regions.where(F.col("name").isin(subnet)).select("name").collect()}  # an atlas
            if unknown := sorted(set(subnet) - known):
                raise ValueError(f"regions that the atlas doesn't have: {unknown}")
            regions = regions.where(F.col("name").isin(subnet))
        inside = F.broadcast(regions.select("v"))
        kept = edges.where("src <> dst and weight <> 0")
        if subnet is not None:
            kept = kept.join(inside.withColumnRenamed("v", "src"), "src", "left_semi").join(inside.withColumnRenamed("v", "dst"), "dst", "left_semi")
        kept = kept.select("gid", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
        vertices = graphs.select("gid").crossJoin(inside)
        return cls(graphs, vertices, kept, regions, **{k: about.pop(k) for k in ("kind", "level") if k in about}, about=about | cls.metadata())

    @classmethod
    def from_matrices(cls, cells: DataFrame, regions: DataFrame, **about) -> Networks:
        """cells: (gid, i, j, w) of square matrices; the larger of w_ij and w_ji counts."""
        sym = matrices.symmetrize(cells.withColumnRenamed("gid", "sid"))
        return cls.from_edges(sym.select(F.col("sid").alias("gid"), F.col("i").alias("src"), F.col("j").alias("dst"), F.col("w").alias("weight")), regions, cells.select("gid").distinct(), **about)

    @classmethod
    def empty(cls, graphs: DataFrame, regions: DataFrame, **about) -> Networks:
        """Graphs (gid, ...) of an atlas without edges."""
        none = graphs.select("gid", F.lit(0).alias("src"), F.lit(0).alias("dst"), F.lit(0.0).alias("weight")).where("false")
        return cls.from_edges(none, regions, graphs, **about)

    @classmethod
    def of_results(cls, results: DataFrame, regions: DataFrame, key: str = "contrast", p: tuple[str, ...] = ("p", "p_fdr", "p_perm")) -> Networks:
        """An edgeless graph for each contrast (or effect) of results(key, region, ...), whose
        vertices carry the statistics; p-values become 1 - p, so that larger is surer."""
        graphs = results.select(F.col(key).alias("gid")).distinct()
        base = cls.empty(graphs, regions, level="contrast")
        flipped = results.select(F.col(key).alias("gid"), "region", *((1 - F.col(c)).alias(c) if c in p else F.col(c) for c in results.columns if c not in (key, "region")))
        named = base.vertices.join(F.broadcast(regions.select("v", F.col("name").alias("region"))), "v")
        return replace(base, vertices=named.join(flipped, ["gid", "region"], "left"))

    @classmethod
    def of_components(cls, found: DataFrame, edges: DataFrame, members: DataFrame, regions: DataFrame) -> Networks:
        """The suprathreshold graphs of a network-based statistic. found: (contrast, comp, p),
        edges: (contrast, src, dst, stat), members: (contrast, v, comp). Vertices carry their
        component and p_nbs = 1 - p."""
        e = edges.select(F.col("contrast").alias("gid"), "src", "dst", F.col("stat").alias("weight"))
        base = cls.from_edges(e, regions, level="contrast")
        marks = members.join(found.select("contrast", "comp", (1 - F.col("p")).alias("p_nbs")), ["contrast", "comp"], "left").withColumnRenamed("contrast", "gid")
        return replace(base, vertices=base.vertices.join(marks, ["gid", "v"], "left"))

    @staticmethod
    def metadata() -> dict:
        return {"made": datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), "spark": pyspark.__version__, "python": platform.python_version(), "system": platform.platform()}

    # the collection

    def select(self, ids: list | None = None, groups: list | None = None, where: str | None = None) -> Networks:
        """Some of the graphs: by gid, by group, by a condition on the graph table."""
        g = self.graphs
        g = g.where(F.col("gid").isin(ids)) if ids is not None else g
        g = g.where(F.col("grp").isin(groups)) if groups is not None else g
        g = g.where(where) if where else g
        only = lambda df: df.join(g.select("gid"), "gid", "left_semi")
        return replace(self, graphs=g, vertices=only(self.vertices), edges=only(self.edges))

    def union(self, other: Networks) -> Networks:
        both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
        return replace(self, graphs=both(self.graphs, other.graphs), vertices=both(self.vertices, other.vertices), edges=both(self.edges, other.edges))

    def n_graphs(self) -> int:
        return self.graphs.count()

    def groups(self) -> DataFrame:
        return self.graphs.select("gid", "grp")

    def region_names(self) -> list[str]:
        return [r["name"] for r in self.regions.orderBy("v").select("name").collect()]  # an atlas

    def n_regions(self) -> int:
        return self.regions.count()

    def bare(self, names: bool = True) -> Networks:
        """Without attributes of vertices and edges; names stay if asked for."""
        v = self.vertices.select("gid", "v")
        v = v.join(F.broadcast(self.regions.select("v", "name")), "v") if names and self.regions is not None else v
        return replace(self, vertices=v, edges=self.edges.select("gid", "src", "dst", "weight"))

    # measures

    def measured(self, vertex: list[str] | None = None, graph: list[str] | None = None, groups: dict | None = None) -> Networks:
        """With measures as columns (dots become underscores) of the vertex and graph tables;
        by default all of them, of random graphs the short list."""
        random = self.kind == "random"
        vertex = ([] if random else [m for m in measures.VERTEX if m not in measures.DIRECTED]) if vertex is None else vertex
        graph = (list(SHORT) if random else list(measures.GRAPH)) if graph is None else graph
        v, g = self.vertices, self.graphs
        if vertex:
            v = v.join(measures.wide(measures.vertex_measures(self.vertices, self.edges, vertex, groups), vertex, ("gid", "v")), ["gid", "v"], "left")
        if graph:
            g = g.join(measures.wide(measures.graph_measures(self.vertices, self.edges, graph, groups), graph, ("gid",)), "gid", "left")
        return replace(self, vertices=v, graphs=g)

    def graph_table(self) -> DataFrame:
        """A row for each graph: ids and numeric attributes."""
        return self.graphs

    def vertex_table(self) -> DataFrame:
        """A row for each vertex of each graph, with the region's and the graph's columns."""
        own = set(self.vertices.columns)
        r = self.regions.select(*[c for c in self.regions.columns if c == "v" or c not in own])
        g = self.graphs.select(*[c for c in ("gid", "sid", "grp", "density", "threshold") if c in self.graphs.columns and (c == "gid" or c not in own)])
        drop = [c for c in ("lx", "ly", "color") if c in own]
        return self.vertices.drop(*drop).join(F.broadcast(r), "v").join(g, "gid")

    def outcome(self, measure: str, level: str = "vertex") -> DataFrame:
        """(region, sid, value) of a measured column, as linear models take it."""
        if level == "graph":
            return self.graphs.select(F.lit("graph").alias("region"), F.col("gid").alias("sid"), F.col(measure).alias("value"))
        v = self.vertices.select("gid", "v", measure).join(F.broadcast(self.regions.select("v", "name")), "v")
        return v.select(F.col("name").alias("region"), F.col("gid").alias("sid"), F.col(measure).alias("value"))

    def outcome_wide(self, measure: str) -> DataFrame:
        """A row for each graph, a column for each region."""
        names = self.region_names()
        return self.outcome(measure).groupBy("sid").pivot("region", names).agg(F.first("value"))

    def register(self, name: str, level: str, fn: Callable) -> None:
        measures.register_measure(name, level, fn)

    # graphs from graphs

    def subgraph(self, condition: str) -> Networks:
        """What vertices that meet a condition on vertex or region columns induce."""
        own = set(self.vertices.columns)
        extra = self.regions.select(*[c for c in self.regions.columns if c == "v" or c not in own]) if self.regions is not None else None
        v, e = local.subset(self.vertices.join(F.broadcast(extra), "v") if extra is not None else self.vertices, self.edges, condition)
        return replace(self, vertices=v, edges=e)

    def ego(self, names: list[str]) -> Networks:
        seeds = self.regions.where(F.col("name").isin(names)).select("v")
        v, e = local.ego(self.edges, F.broadcast(seeds))
        return replace(self, vertices=v, edges=e)

    def contract(self, column: str = "lobe_hemi") -> tuple[DataFrame, DataFrame]:
        r = self.regions.withColumn("lobe_hemi", F.concat_ws(".", "lobe", "hemi")) if "lobe_hemi" not in self.regions.columns else self.regions
        return local.contract(self.edges, r, column)

    def transformed(self, kind: str, invert: bool = False) -> Networks:
        return replace(self, edges=matrices.transform_weights(self.edges, kind, invert))

    def changes(self, before: str, after: str) -> DataFrame:
        """Edges that the graph `after` has and `before` hasn't."""
        one = lambda g: self.edges.where(F.col("gid") == g)
        return local.graph_difference(one(after), one(before))

    def report(self) -> str:
        return text.report(f"{self.kind} networks, {self.level} level", {"graphs": self.n_graphs(), "regions": self.n_regions(), "graph columns": self.graphs.columns, "vertex columns": self.vertices.columns, "edge columns": self.edges.columns} | self.about)
