"""Measures that edge lists express: degrees, triangles, roles, rich clubs, spatial and
group measures, set operations. edges: (gid, src < dst, weight); vertices: (gid, v).
Everything is lazy and runs on a whole collection of graphs at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def halves(edges: DataFrame) -> DataFrame:
    """Both directions: (gid, v, u, weight)."""
    pair = F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))
    return edges.select("gid", "weight", F.explode(pair).alias("p")).select("gid", "p.v", "p.u", "weight")


def degree_strength(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, v, degree, strength; isolates have zeros."""
    sums = halves(edges).groupBy("gid", "v").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return vertices.join(sums, ["gid", "v"], "left").select("gid", "v", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = vertices.groupBy("gid").agg(F.count("*").alias("n"))
    m = edges.groupBy("gid").agg(F.count("*").alias("m"))
    out = n.join(m, "gid", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return out.withColumn("density", F.try_divide(2.0 * F.col("m"), F.col("n") * (F.col("n") - 1)))


def triangle_rows(edges: DataFrame) -> DataFrame:
    """Each triangle once: gid, a < b < c and its three weights. Wedges open at the vertex of
    least degree, so that a hub of degree k opens few of its k (k - 1) / 2 wedges."""
    deg = halves(edges).groupBy("gid", "v").agg(F.count("*").alias("k"))
    e = edges.join(deg.select("gid", F.col("v").alias("src"), F.col("k").alias("ks")), ["gid", "src"]).join(deg.select("gid", F.col("v").alias("dst"), F.col("k").alias("kd")), ["gid", "dst"])
    first = F.struct("ks", "src") < F.struct(F.col("kd").alias("ks"), F.col("dst").alias("src"))
    up = e.select("gid", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("y"), "weight")
    one = up.select("gid", "x", F.col("y").alias("y1"), F.col("weight").alias("w1"))
    two = up.select("gid", "x", F.col("y").alias("y2"), F.col("weight").alias("w2"))
    wedge = one.join(two, ["gid", "x"]).where("y1 < y2")
    return wedge.join(edges.select("gid", F.col("src").alias("y1"), F.col("dst").alias("y2"), F.col("weight").alias("w3")), ["gid", "y1", "y2"])


def triangles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, v, triangles, and `closed`: the sum over the vertex's triangles of its two
    weights (Barrat's numerator)."""
    t = triangle_rows(edges)
    rows = t.select("gid", F.explode(F.array(
        F.struct(F.col("x").alias("v"), (F.col("w1") + F.col("w2")).alias("s")),
        F.struct(F.col("y1").alias("v"), (F.col("w1") + F.col("w3")).alias("s")),
        F.struct(F.col("y2").alias("v"), (F.col("w2") + F.col("w3")).alias("s")),
    )).alias("p"))
    sums = rows.groupBy("gid", "p.v").agg(F.count("*").alias("triangles"), F.sum("p.s").alias("closed"))
    return vertices.join(sums, ["gid", "v"], "left").select("gid", "v", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.coalesce("closed", F.lit(0.0)).alias("closed"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, v, degree, strength, triangles, transitivity (0 under two neighbours), barrat
    (NULL there)."""
    d = degree_strength(vertices, edges).join(triangles(vertices, edges), ["gid", "v"])
    k = F.col("degree")
    return d.select(
        "gid", "v", "degree", "strength", "triangles",
        F.when(k > 1, F.try_divide(2.0 * F.col("triangles"), k * (k - 1))).otherwise(0.0).alias("transitivity"),
        F.when(k > 1, F.try_divide(F.col("closed"), F.col("strength") * (k - 1))).alias("barrat"),
    )


def graph_clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, cp (mean over vertices with two neighbours or more), transitivity (global),
    triangles."""
    c = clustering(vertices, edges)
    k = F.col("degree")
    return c.groupBy("gid").agg(
        F.avg(F.when(k > 1, F.col("transitivity"))).alias("cp"),
        F.try_divide(2.0 * F.sum("triangles"), F.sum(k * (k - 1))).alias("transitivity"),
        (F.sum("triangles") / 3).cast("bigint").alias("triangles"),
    )


def knn(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean degree of the neighbours, plain and weighted."""
    d = degree_strength(vertices, edges)
    h = halves(edges).join(d.select("gid", F.col("v").alias("u"), F.col("degree").alias("ku")), ["gid", "u"])
    sums = h.groupBy("gid", "v").agg(F.avg("ku").alias("knn"), F.try_divide(F.sum(F.col("ku") * F.col("weight")), F.sum("weight")).alias("knn_wt"))
    return vertices.join(sums, ["gid", "v"], "left")


def leverage(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    d = degree_strength(vertices, edges).select("gid", "v", "degree")
    h = halves(edges).join(d, ["gid", "v"]).join(d.select("gid", F.col("v").alias("u"), F.col("degree").alias("ku")), ["gid", "u"])
    sums = h.groupBy("gid", "v").agg(F.avg((F.col("degree") - F.col("ku")) / (F.col("degree") + F.col("ku"))).alias("leverage"))
    return vertices.join(sums, ["gid", "v"], "left")


def _pearson(x: str, y: str) -> F.Column:
    n = F.count(F.lit(1))
    cov = F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n, F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    return F.when((vx > 1e-12) & (vy > 1e-12), F.try_divide(cov, F.sqrt(F.abs(vx * vy))))


def degree_assortativity(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    d = degree_strength(vertices, edges).select("gid", "v", "degree")
    h = halves(edges).join(d.withColumnRenamed("degree", "x"), ["gid", "v"]).join(d.select("gid", F.col("v").alias("u"), F.col("degree").alias("y")), ["gid", "u"])
    h = h.select("gid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return h.groupBy("gid").agg(_pearson("x", "y").alias("assortativity"))


def nominal_assortativity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Newman's coefficient of the mixing of groups(v, g)."""
    h = halves(edges).join(groups.select("v", F.col("g").alias("a")), "v").join(groups.select(F.col("v").alias("u"), F.col("g").alias("b")), "u")
    cells = h.groupBy("gid", "a", "b").agg(F.count("*").alias("n"))
    total = cells.groupBy("gid").agg(F.sum("n").alias("m"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy("gid", "a").agg(F.sum("n").alias("r"))
    chance = rows.groupBy("gid").agg(F.sum(F.col("r") * F.col("r")).alias("rr"))
    m = F.col("m")
    p = F.col("rr") / (m * m)
    return total.join(chance, "gid").select("gid", F.try_divide(F.col("same") / m - p, 1 - p).alias("assortativity"))


def modularity(edges: DataFrame, groups: DataFrame, weighted: bool = False) -> DataFrame:
    """Newman's Q of the partition groups(v, g)."""
    w = F.col("weight") if weighted else F.lit(1.0)
    h = halves(edges).join(groups.select("v", F.col("g").alias("a")), "v").join(groups.select(F.col("v").alias("u"), F.col("g").alias("b")), "u")
    by = h.groupBy("gid", "a").agg(F.sum(w).alias("s"), F.sum(F.when(F.col("a") == F.col("b"), w).otherwise(0.0)).alias("inside"))
    total = F.sum("s")
    return by.groupBy("gid").agg(F.try_divide(F.sum("inside"), total).alias("e"), F.sum(F.col("s") * F.col("s")).alias("ss"), total.alias("m")).select("gid", (F.col("e") - F.col("ss") / (F.col("m") * F.col("m"))).alias("modularity"))


def module_links(edges: DataFrame, groups: DataFrame, weighted: bool = False) -> DataFrame:
    """gid, v, own (the vertex's module), g (the other end's), kappa."""
    w = F.col("weight") if weighted else F.lit(1.0)
    h = halves(edges).join(groups.select(F.col("v").alias("u"), "g"), "u").groupBy("gid", "v", "g").agg(F.sum(w).alias("kappa"))
    return h.join(groups.select("v", F.col("g").alias("own")), "v")


def participation(vertices: DataFrame, edges: DataFrame, groups: DataFrame, weighted: bool = False) -> DataFrame:
    m = module_links(edges, groups, weighted).groupBy("gid", "v").agg((1 - F.sum(F.col("kappa") * F.col("kappa")) / (F.sum("kappa") * F.sum("kappa"))).alias("participation"))
    return vertices.join(m, ["gid", "v"], "left")


def within_module_z(vertices: DataFrame, edges: DataFrame, groups: DataFrame, weighted: bool = False) -> DataFrame:
    inside = module_links(edges, groups, weighted).where("g = own").select("gid", "v", "kappa")
    rows = vertices.join(groups, "v").join(inside, ["gid", "v"], "left").withColumn("kappa", F.coalesce("kappa", F.lit(0.0)))
    w = Window.partitionBy("gid", "g")
    sd = F.stddev_samp("kappa").over(w)
    return rows.select("gid", "v", F.when(sd > 1e-12, F.try_divide(F.col("kappa") - F.avg("kappa").over(w), sd)).alias("z"))


def gateway(vertices: DataFrame, edges: DataFrame, groups: DataFrame, centrality: DataFrame) -> DataFrame:
    """Gateway coefficient with centrality(gid, v, c); NULL for isolates, 0 with one module."""
    links = module_links(edges, groups)
    between = links.groupBy("gid", "g", "own").agg(F.sum("kappa").alias("total"))  # module g to module own
    between = between.select("gid", F.col("g").alias("g"), F.col("own").alias("own"), "total")
    near = halves(edges).join(centrality.select("gid", F.col("v").alias("u"), "c"), ["gid", "u"]).join(groups.select(F.col("v").alias("u"), "g"), "u")
    near = near.groupBy("gid", "v", "g").agg(F.sum("c").alias("c"))
    most = centrality.join(groups, "v").groupBy("gid", "g").agg(F.sum("c").alias("cs")).groupBy("gid").agg(F.max("cs").alias("cn"), F.count("*").alias("modules"))
    x = links.join(between, ["gid", "g", "own"]).join(near, ["gid", "v", "g"]).join(most, "gid")
    bar = F.try_divide(F.col("kappa"), F.col("total"))
    gate = 1 - F.coalesce(bar * F.try_divide(F.col("c"), F.col("cn")), F.lit(0.0))
    x = x.withColumn("part", F.col("kappa") * F.col("kappa") * gate * gate)
    sums = x.groupBy("gid", "v").agg(F.when(F.max("modules") < 2, 0.0).otherwise(1 - F.sum("part") / (F.sum("kappa") * F.sum("kappa"))).alias("gateway"))
    return vertices.join(sums, ["gid", "v"], "left")


def rich_club(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, k, phi, phi_wt, n_k, e_k for all k from 1 to the maximum degree. phi: density of
    the subgraph of degrees over k; phi_wt: its weight over the e_k largest weights."""
    d = degree_strength(vertices, edges).select("gid", "v", "degree")
    e = edges.join(d.select("gid", F.col("v").alias("src"), F.col("degree").alias("a")), ["gid", "src"]).join(d.select("gid", F.col("v").alias("dst"), F.col("degree").alias("b")), ["gid", "dst"])
    # counts by degree, then sums over all higher ones: a row a degree, not one a vertex and k
    by_v = d.groupBy("gid", F.col("degree").alias("k")).agg(F.count("*").alias("n"))
    by_e = e.groupBy("gid", F.least("a", "b").alias("k")).agg(F.count("*").alias("e"), F.sum("weight").alias("w"))
    ks = by_v.groupBy("gid").agg(F.max("k").alias("kmax")).where("kmax >= 1").select("gid", F.explode(F.sequence(F.lit(0), F.col("kmax").cast("int"))).alias("k"))
    higher = Window.partitionBy("gid").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    rows = ks.join(by_v, ["gid", "k"], "left").join(by_e, ["gid", "k"], "left")
    rows = rows.select("gid", "k", *(F.coalesce(F.sum(F.coalesce(c, F.lit(z))).over(higher), F.lit(z)).alias(o) for c, o, z in (("n", "n_k", 0), ("e", "e_k", 0), ("w", "w_k", 0.0)))).where("k >= 1")
    ranked = edges.select("gid", "weight", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("weight"))).alias("r"))
    prefix = ranked.select("gid", "r", F.sum("weight").over(Window.partitionBy("gid").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)).alias("top"))
    prefix = prefix.select("gid", F.col("r").cast("bigint").alias("e_k"), "top")
    out = rows.join(prefix, ["gid", "e_k"], "left")
    return out.select("gid", "k", "n_k", "e_k", F.when(F.col("n_k") > 1, F.try_divide(2.0 * F.col("e_k"), F.col("n_k") * (F.col("n_k") - 1))).alias("phi"), F.try_divide(F.col("w_k"), F.col("top")).alias("phi_wt"))


def rich_core(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, rank, degree and share of the core's boundary: the last rank with the most links
    to vertices of strictly higher degree."""
    d = degree_strength(vertices, edges).select("gid", "v", "degree")
    h = halves(edges).join(d, ["gid", "v"]).join(d.select("gid", F.col("v").alias("u"), F.col("degree").alias("ku")), ["gid", "u"])
    plus = h.groupBy("gid", "v").agg(F.sum((F.col("ku") > F.col("degree")).cast("int")).alias("plus"))
    w = Window.partitionBy("gid")
    rows = d.join(plus, ["gid", "v"], "left").withColumn("plus", F.coalesce("plus", F.lit(0)))
    rows = rows.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("degree"), "v")), "n": F.count(F.lit(1)).over(w)})
    return rows.groupBy("gid").agg(F.max(F.struct("plus", "rank", "degree", "n")).alias("m")).select("gid", F.col("m.rank").alias("rank"), F.col("m.degree").alias("degree"), (F.col("m.rank") / F.col("m.n")).alias("share"))


def rich_club_attrs(vertices: DataFrame, edges: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """Edges by kind: rich-club (both ends rich), feeder (one), local (none)."""
    d = degree_strength(vertices, edges)
    rich = (F.col("degree") >= low) & (F.col("degree") <= high if high is not None else F.lit(True))
    d = d.select("gid", "v", rich.cast("int").alias("rich"))
    e = edges.join(d.select("gid", F.col("v").alias("src"), F.col("rich").alias("a")), ["gid", "src"]).join(d.select("gid", F.col("v").alias("dst"), F.col("rich").alias("b")), ["gid", "dst"])
    kind = F.element_at(F.array(F.lit("local"), F.lit("feeder"), F.lit("rich-club")), F.col("a") + F.col("b") + 1)
    return e.select("gid", "src", "dst", kind.alias("kind"))


def bh_adjust(df: DataFrame, p: str, keys: tuple[str, ...], out: str = "p_fdr") -> DataFrame:
    """Benjamini-Hochberg within keys: the running minimum, from the largest p down, of
    p n / rank, at most 1. NULLs stay NULL and don't count."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__n", F.count(p).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.asc_nulls_last(p))))
    run = F.min(F.col(p) * F.col("__n") / F.col("__r")).over(w.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.when(F.col(p).isNotNull(), F.least(run, F.lit(1.0)))).drop("__n", "__r")


def rich_club_norm(observed: DataFrame, random: DataFrame) -> DataFrame:
    """observed (gid, k, phi), random (gid, rand_id, k, phi): normalised coefficient, p and
    its FDR over k."""
    r = random.select("gid", "k", F.col("phi").alias("phi_rand"), "rand_id")
    n = random.select("gid", "rand_id").distinct().groupBy("gid").agg(F.count("*").alias("n"))
    both = observed.join(r, ["gid", "k"], "left").groupBy("gid", "k", "phi").agg(F.avg("phi_rand").alias("mean"), F.sum((F.col("phi_rand") >= F.col("phi")).cast("int")).alias("b"))
    both = both.join(n, "gid").select("gid", "k", "phi", F.try_divide(F.col("phi"), F.col("mean")).alias("norm"), F.when(F.col("phi").isNotNull(), (F.coalesce("b", F.lit(0)) + 1) / (F.col("n") + 1)).alias("p"))
    return bh_adjust(both, "p", ("gid",))


def edge_distances(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Euclidean distance of the ends; regions: (v, x, y, z)."""
    a = regions.select(F.col("v").alias("src"), *(F.col(c).alias(c + "1") for c in "xyz"))
    b = regions.select(F.col("v").alias("dst"), *(F.col(c).alias(c + "2") for c in "xyz"))
    square = sum((F.pow(F.col(c + "1") - F.col(c + "2"), 2) for c in "xyz"), F.lit(0.0))
    return edges.join(a, "src").join(b, "dst").select("gid", "src", "dst", F.sqrt(square).alias("dist"))


def vertex_distances(vertices: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    d = halves(edge_distances(edges, regions).withColumnRenamed("dist", "weight")).groupBy("gid", "v").agg(F.avg("weight").alias("dist"))
    return vertices.join(d, ["gid", "v"], "left")


def _ends(edges: DataFrame, regions: DataFrame, column: str) -> DataFrame:
    a, b = regions.select(F.col("v").alias("src"), F.col(column).alias("a")), regions.select(F.col("v").alias("dst"), F.col(column).alias("b"))
    return edges.join(a, "src").join(b, "dst")


def hemisphere_asymmetry(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """2 (L - R) / (L + R) of the edges inside each hemisphere."""
    e = _ends(edges, regions, "hemi")
    s = e.groupBy("gid").agg(F.sum(((F.col("a") == "L") & (F.col("b") == "L")).cast("int")).alias("lh"), F.sum(((F.col("a") == "R") & (F.col("b") == "R")).cast("int")).alias("rh"))
    return s.withColumn("asymm", F.try_divide(2.0 * (F.col("lh") - F.col("rh")), F.col("lh") + F.col("rh")))


def vertex_asymmetry(vertices: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    h = halves(edges).join(regions.select(F.col("v").alias("u"), "hemi"), "u")
    s = h.groupBy("gid", "v").agg(F.sum((F.col("hemi") == "L").cast("int")).alias("lh"), F.sum((F.col("hemi") == "R").cast("int")).alias("rh"))
    s = vertices.join(s, ["gid", "v"], "left").na.fill(0, ["lh", "rh"])
    return s.withColumn("asymm", F.try_divide(2.0 * (F.col("lh") - F.col("rh")), F.col("lh") + F.col("rh")))


def count_inter(edges: DataFrame, regions: DataFrame, column: str = "lobe") -> DataFrame:
    """Edges between each pair of groups (a <= b): the upper triangle of the matrix."""
    e = _ends(edges, regions, column)
    return e.groupBy("gid", F.least("a", "b").alias("g1"), F.greatest("a", "b").alias("g2")).agg(F.count("*").alias("n"))


def count_by_group(edges: DataFrame, regions: DataFrame, column: str = "lobe") -> DataFrame:
    """gid, g, intra, inter, total."""
    cells = count_inter(edges, regions, column)
    both = F.when(F.col("g1") == F.col("g2"), F.array("g1")).otherwise(F.array("g1", "g2"))
    rows = cells.select("gid", "n", (F.col("g1") == F.col("g2")).alias("same"), F.explode(both).alias("g"))
    return rows.groupBy("gid", "g").agg(F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("intra"), F.sum(F.when(~F.col("same"), F.col("n")).otherwise(0)).alias("inter"), F.sum("n").alias("total"))


def count_homologous(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Edges of regions whose names agree without the leading hemisphere mark (l/r)."""
    e = _ends(edges, regions.withColumn("bare", F.regexp_replace("name", "^[lrLR]\\.?", "")), "bare")
    return e.groupBy("gid").agg(F.sum((F.col("a") == F.col("b")).cast("int")).alias("n"))


def contract(edges: DataFrame, regions: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Vertices merged by group: (g, n_vertices, x, y, z, size by graph), (gid, g1, g2,
    count). `size`: incident edges between groups."""
    e = count_inter(edges, regions, column).where("g1 <> g2").withColumnRenamed("n", "count")
    ends = e.select("gid", "count", F.explode(F.array("g1", "g2")).alias("g")).groupBy("gid", "g").agg(F.sum("count").alias("size"))
    g = regions.groupBy(F.col(column).alias("g")).agg(F.count("*").alias("n_vertices"), *(F.avg(c).alias(c) for c in "xyz"))
    return ends.join(g, "g"), e


def select_edges(edges: DataFrame, regions: DataFrame, column: str, inside: bool) -> DataFrame:
    """Edges inside groups, or between them."""
    e = _ends(edges, regions, column)
    return e.where("a = b" if inside else "a <> b").select(*edges.columns)


def edges_between(edges: DataFrame, low: float, high: float) -> DataFrame:
    return edges.where(F.col("weight").between(low, high))


def ego(edges: DataFrame, seeds: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Union of the graphs induced by each seed and its neighbours; seeds: (v). With
    `vertices`, a seed without edges is there as well, alone."""
    h = halves(edges)
    near = h.join(seeds, "v", "left_semi").select("gid", F.col("v").alias("seed"), "u")
    member = near.union(near.select("gid", "seed", F.col("seed").alias("u"))).distinct()
    a, b = member.select("gid", "seed", F.col("u").alias("src")), member.select("gid", "seed", F.col("u").alias("dst"))
    kept = edges.join(a, ["gid", "src"]).join(b, ["gid", "seed", "dst"]).select(*edges.columns).distinct()
    found = member.select("gid", F.col("u").alias("v"))
    if vertices is not None:
        found = found.unionByName(vertices.join(seeds, "v", "left_semi").select("gid", "v"))
    return found.distinct(), kept


def common_vertices(vertices: DataFrame, condition: str, any_graph: bool = False) -> DataFrame:
    """Vertices that meet a condition in all graphs (or any)."""
    hits = vertices.where(F.expr(condition)).groupBy("v").agg(F.countDistinct("gid").alias("n"))
    if any_graph:
        return hits.select("v")
    total = vertices.agg(F.countDistinct("gid").alias("graphs"))
    return hits.crossJoin(F.broadcast(total)).where("n = graphs").select("v")  # one row


_TOKENS = r"[A-Za-z_][A-Za-z0-9_.]*"


def subset(vertices: DataFrame, edges: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """The subgraph that vertices meeting a condition induce: comparisons of columns joined
    by & and |, parentheses. NULL is false. Only columns of `vertices` may be named."""
    import re

    bare = re.sub(r"'[^']*'|\"[^\"]*\"", "''", condition)
    unknown = set(re.findall(_TOKENS, bare)) - set(vertices.columns) - {"true", "false", "TRUE", "FALSE"}
    if unknown or re.search(r"[;(){}]\s*[A-Za-z_]+\s*\(|;|--", bare):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    kept = vertices.where(F.expr(re.sub(r"&+", " AND ", re.sub(r"\|+", " OR ", condition))))
    ids = kept.select("gid", "v")
    e = edges.join(ids.select("gid", F.col("v").alias("src")), ["gid", "src"], "left_semi").join(ids.select("gid", F.col("v").alias("dst")), ["gid", "dst"], "left_semi")
    return kept, e


def graph_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "dst").union(b.select("src", "dst")).distinct()


def graph_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "dst").intersect(b.select("src", "dst"))


def graph_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "dst").join(b.select("src", "dst"), ["src", "dst"], "left_anti").distinct()


def group_colors(vertices: DataFrame, edges: DataFrame, palette: tuple[str, ...] = ("red", "green", "blue", "magenta", "cyan", "orange")) -> tuple[DataFrame, DataFrame]:
    """Colors by `g` of vertices(gid, v, g): groups of one are gray; edges take the color of
    their ends' group, or gray50."""
    w = Window.partitionBy("gid", "g")
    colors = F.array(*map(F.lit, palette))
    v = vertices.withColumn("color", F.when(F.count(F.lit(1)).over(w) > 1, F.element_at(colors, F.pmod(F.col("g").cast("int") - 1, F.lit(len(palette))) + 1)).otherwise("gray"))
    a, b = v.select("gid", F.col("v").alias("src"), F.col("g").alias("g1"), F.col("color").alias("c")), v.select("gid", F.col("v").alias("dst"), F.col("g").alias("g2"))
    e = edges.join(a, ["gid", "src"]).join(b, ["gid", "dst"]).select("gid", "src", "dst", F.when(F.col("g1") == F.col("g2"), F.col("c")).otherwise("gray50").alias("color"))
    return v, e


def circular_layout(regions: DataFrame) -> DataFrame:
    """Positions on a circle: the left hemisphere front to back, then the right one back to
    front, lobes together."""
    side = F.when(F.col("hemi") == "L", 0).otherwise(1)
    front = F.avg("y").over(Window.partitionBy("hemi", "lobe"))
    order = Window.partitionBy(F.lit(1)).orderBy(side, F.when(side == 0, -F.col("front")).otherwise(F.col("front")), "lobe", "v")
    rows = regions.withColumn("front", front).withColumn("pos", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    angle = 2 * F.pi() * (F.col("pos") - 1) / F.col("n")
    return rows.select("v", "pos", F.cos(angle).alias("lx"), F.sin(angle).alias("ly"))


def rotate(layout: DataFrame, theta: float) -> DataFrame:
    c, s = F.cos(F.lit(theta)), F.sin(F.lit(theta))
    return layout.withColumns({"lx": F.col("lx") * c - F.col("ly") * s, "ly": F.col("lx") * s + F.col("ly") * c})


def hubness(measures: DataFrame, keep: float = 0.2) -> DataFrame:
    """measures: (gid, v, strength, btwn, cluster, lp). Range 0 to 4."""
    w = Window.partitionBy("gid")
    cut = F.bround(F.lit(keep) * F.count(F.lit(1)).over(w))
    marks = [F.row_number().over(w.orderBy(o, "v")) <= F.col("cut") for o in (F.desc("strength"), F.desc("btwn"), F.asc("cluster"), F.asc("lp"))]
    rows = measures.withColumn("cut", cut)
    return rows.select("gid", "v", sum((m.cast("int") for m in marks[1:]), marks[0].cast("int")).alias("hubs"))


def auc(df: DataFrame, keys: tuple[str, ...], x: str, y: str, out: str = "auc", absolute: bool = True) -> DataFrame:
    """Trapezoid area under y over x by key."""
    w = Window.partitionBy(*keys).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    total = F.sum("__part")
    return df.withColumn("__part", part).groupBy(*keys).agg((F.abs(total) if absolute else total).alias(out))


def runs(df: DataFrame, keys: tuple[str, ...], x: str, flag: F.Column) -> DataFrame:
    """Runs of consecutive rows (by x) where flag holds: keys, run, first, last, length."""
    w = Window.partitionBy(*keys).orderBy(x)
    rows = df.withColumn("__f", flag).withColumn("__n", F.row_number().over(w))
    rows = rows.where("__f").withColumn("__g", F.col("__n") - F.row_number().over(w))
    return rows.groupBy(*keys, F.col("__g").alias("run")).agg(F.min(x).alias("first"), F.max(x).alias("last"), F.count("*").alias("length"))


def small_world(observed: DataFrame, random: DataFrame) -> DataFrame:
    """observed (gid, cp, lp), random (gid, rand_id, cp, lp): normalised and sigma."""
    r = random.groupBy("gid").agg(F.avg("cp").alias("cp_rand"), F.avg("lp").alias("lp_rand"))
    c, p = F.try_divide(F.col("cp"), F.col("cp_rand")), F.try_divide(F.col("lp"), F.col("lp_rand"))
    return observed.join(r, "gid").select("gid", "cp", "lp", "cp_rand", "lp_rand", c.alias("cp_norm"), p.alias("lp_norm"), F.try_divide(c, p).alias("sigma"))
