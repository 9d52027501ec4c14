"""DataFrame operators against the kernels on the same graphs, collections, sources."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netloom.functions import text
from netloom.operators import kernels as K
from netloom.operators import local as R
from netloom.operators import matrices as X
from netloom.operators import measures as M
from netloom.operators.collection import Networks
from netloom.plans import figures
from netloom.sources import io

N = 12
GRAPHS = {"g1": 0.5, "g2": 0.25, "g3": 0.0}  # the last has no edges


@pytest.fixture(scope="module")
def weights():
    out = {}
    for k, (g, p) in enumerate(GRAPHS.items()):
        rng = np.random.default_rng(k)
        w = np.triu(np.where(rng.random((N, N)) < p, rng.integers(1, 9, (N, N)), 0), 1).astype(float)
        out[g] = w + w.T
    return out


@pytest.fixture(scope="module")
def regions(spark):
    rows = [(i + 1, ("l" if i % 2 else "r") + f"R{i // 2}", float(i), float(i * i % 7), 1.0, "abc"[i % 3], "L" if i % 2 else "R", i % 3 + 1) for i in range(N)]
    return spark.createDataFrame(rows, "v int, name string, x double, y double, z double, lobe string, hemi string, module int").cache()


@pytest.fixture(scope="module")
def nets(spark, weights, regions):
    e = [(g, i + 1, j + 1, float(w[i, j])) for g, w in weights.items() for i in range(N) for j in range(i + 1, N) if w[i, j]]
    edges = spark.createDataFrame(e, "gid string, src int, dst int, weight double")
    graphs = spark.createDataFrame([("g1", "A"), ("g2", "B"), ("g3", "B")], "gid string, grp string")
    return Networks.from_edges(edges, regions, graphs)


def column(df, name):
    out = {}
    for r in df.collect():
        out[(r["gid"], r["v"])] = r[name]
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        if v is None or not np.isfinite(v):
            assert got[k] is None, k
        else:
            assert got[k] == pytest.approx(float(v)), k


def test_vertex_operators_agree_with_kernels(nets, weights):
    v, e = nets.vertices, nets.edges
    want = lambda fn: {(g, i + 1): x for g, w in weights.items() for i, x in enumerate(fn(w))}
    d = R.degree_strength(v, e)
    same(column(d, "degree"), want(lambda w: (w > 0).sum(1)))
    same(column(d, "strength"), want(lambda w: w.sum(1)))
    same(column(R.clustering(v, e), "transitivity"), want(K.clustering))
    same(column(R.leverage(v, e), "leverage"), want(lambda w: K.leverage(K.binary(w))))
    g = nets.regions.select("v", F.col("module").alias("g"))
    member = np.array([i % 3 + 1 for i in range(N)])
    same(column(R.participation(v, e, g), "participation"), want(lambda w: K.participation(K.binary(w), member)))
    same(column(R.within_module_z(v, e, g), "z"), want(lambda w: K.within_module_z(K.binary(w), member)))


def test_measures_of_a_collection(nets, weights):
    m = nets.measured(["btwn.cent", "E.local"], ["Cp", "E.global", "density"])
    same(column(m.vertices, "btwn_cent"), {(g, i + 1): x for g, w in weights.items() for i, x in enumerate(K.betweenness(K.binary(w))[0])})
    t = {r["gid"]: r for r in m.graph_table().collect()}
    assert t["g1"]["E_global"] == pytest.approx(K.global_efficiency(K.distances(weights["g1"]))) and t["g3"]["density"] == 0 and t["g1"]["grp"] == "A"
    wide = m.outcome_wide("btwn_cent").collect()
    assert len(wide) == 3 and len(wide[0]) == N + 1
    assert m.outcome("Cp", "graph").count() == 3 and "lobe" in m.vertex_table().columns
    every = nets.measured()
    assert every.vertices.count() == 3 * N and {"E_local_wt", "hubs", "communicability"} <= set(every.vertices.columns)
    short = Networks(nets.graphs, nets.vertices, nets.edges, nets.regions, "random").measured()
    assert set(short.graphs.columns) == {"gid", "grp", "Cp", "Lp", "E_global", "mod"}


def test_selection(nets):
    assert nets.n_graphs() == 3 and nets.n_regions() == N and nets.region_names()[0] == "rR0"
    b = nets.select(groups=["B"])
    assert b.n_graphs() == 2 and b.vertices.count() == 2 * N and nets.select(ids=["g1"]).edges.select("gid").distinct().count() == 1
    assert nets.select(where="grp = 'A'").n_graphs() == 1 and b.union(nets.select(ids=["g1"])).edges.count() == nets.edges.count()
    sub = nets.subgraph("hemi = 'L' & (lobe = 'a' | lobe = 'b')")
    assert sub.edges.count() == nets.edges.where("src % 2 = 0 and dst % 2 = 0 and (src - 1) % 3 < 2 and (dst - 1) % 3 < 2").count()
    with pytest.raises(ValueError):
        nets.subgraph("nothing = 1")
    ego = nets.ego(["rR0"])
    near = nets.edges.where("gid = 'g1' and src = 1").count() + 1
    assert ego.vertices.where("gid = 'g1'").count() == near
    only = Networks.from_edges(nets.edges, nets.regions, nets.graphs, subnet=["rR0", "lR0", "rR1"])
    assert only.vertices.count() == 9 and only.edges.where("src > 3 or dst > 3").count() == 0
    with pytest.raises(ValueError):
        Networks.from_edges(nets.edges, nets.regions, subnet=["other"])
    assert nets.bare().vertices.columns == ["v", "gid", "name"] or set(nets.bare().vertices.columns) == {"gid", "v", "name"}
    assert "observed networks" in nets.report()
    g, e = nets.contract()
    assert e.agg(F.sum("count")).first()[0] < nets.edges.count() and "size" in g.columns
    assert nets.changes("g3", "g1").count() == nets.edges.where("gid = 'g1'").count()
    back = nets.transformed("-log10(w/max(w))").transformed("-log10(w/max(w))", True)
    assert back.edges.agg(F.sum("weight")).first()[0] == pytest.approx(nets.edges.agg(F.sum("weight")).first()[0])


def test_result_graphs(spark, regions):
    stats = spark.createDataFrame([("c1", "rR0", 2.0, 0.01), ("c1", "lR0", 0.1, 0.9), ("c2", "rR0", 1.0, 0.3)], "contrast string, region string, stat double, p double")
    n = Networks.of_results(stats, regions)
    rows = {(r["gid"], r["region"]): r["p"] for r in n.vertices.collect()}
    assert rows[("c1", "rR0")] == pytest.approx(0.99) and rows[("c2", "lR5")] is None and n.edges.count() == 0
    found = spark.createDataFrame([("c1", 1, 0.02)], "contrast string, comp int, p double")
    edges = spark.createDataFrame([("c1", 1, 2, -3.0)], "contrast string, src int, dst int, stat double")
    members = spark.createDataFrame([("c1", 1, 1), ("c1", 2, 1)], "contrast string, v int, comp int")
    c = Networks.of_components(found, edges, members, regions)
    assert c.edges.first()["weight"] == -3 and c.vertices.where("p_nbs > 0.9").count() == 2


def test_matrices(spark, tmp_path, regions):
    m = np.array([[0, 1, 2], [3, 0, 4], [np.nan, 6, 0]])
    for s in ("s1", "s2"):
        np.savetxt(tmp_path / f"{s}.txt", m)
    cells = io.read_matrices(spark, str(tmp_path))
    assert cells.count() == 18 and cells.where("file = 's1.txt' and i = 3 and j = 1").first()["w"] == 0
    sym = {(r["i"], r["j"]): r["w"] for r in X.symmetrize(cells.withColumnRenamed("file", "sid").where("sid = 's1.txt'")).collect()}
    assert sym == {(1, 2): 3, (1, 3): 2, (2, 3): 6}
    n = Networks.from_matrices(cells.withColumnRenamed("file", "gid"), regions.where("v <= 3"))
    assert n.edges.count() == 6 and n.n_graphs() == 2
    rows = [("s1", 1, 2, 5.0), ("s2", 1, 2, 7.0)]
    r = X.rescale(spark.createDataFrame(rows, "sid string, i int, j int, w double"), "w", ("i",))
    assert {x["w"]: x["scaled"] for x in r.collect()} == {5.0: 0.0, 7.0: 1.0}


def test_hemisphere_tables(spark, tmp_path):
    for h in ("lh", "rh"):
        pd.DataFrame({"Study.ID": [1, 2, 10], f"{h}_precuneus_thickness": [1.0, 2, 3], f"{h}_cuneus_thickness": [4.0, 5, 6], f"{h}_MeanThickness_thickness": [0.0] * 3})[: 3 if h == "lh" else 2].to_csv(tmp_path / f"aparc_{h}_thickness.csv", index=False)
    out, excluded, missing = io.read_hemispheres(spark, str(tmp_path), exclude=("02",))
    assert {r["region"] for r in out.collect()} == {"lPCUN", "lCUN", "rPCUN", "rCUN"} and excluded in ([], ["02"])
    assert "10" in missing


def test_atlas(spark):
    a = io.create_atlas(spark, ["b", "a"], [(0, 1, 2), (3, 4, 5)], ["x", "y"], ["L", "R"], {"network": ["p", "q"]})
    assert io.as_atlas(a).count() == 2 and io.guess_atlas(90) == "aal90" and io.guess_atlas(7) is None
    with pytest.raises(ValueError):
        io.as_atlas(a.drop("lobe"))
    with pytest.raises(ValueError):
        io.create_atlas(spark, ["a"], [], ["x"], ["L"])


def test_viewer_files(spark, tmp_path, nets):
    one = nets.select(ids=["g1"])
    io.write_viewer(one.vertices, one.edges, one.regions, str(tmp_path / "net"))
    edge = "".join(p.read_text() for p in sorted((tmp_path / "net.edge").glob("part-*"))).splitlines()
    assert len(edge) == N and all(len(x.split("\t")) == N for x in edge)
    assert len("".join(p.read_text() for p in (tmp_path / "net.node").glob("part-*")).splitlines()) == N


def test_texts(spark):
    assert text.pad_zeros(10)[0] == "01" and text.pad_zeros(["a", "bb"]) == ["0a", "bb"] and text.pad_zeros([]) == []
    assert text.wrapped("a + " * 30 + "b", 40).count("\n") >= 2 and text.wrapped("short") == "short"
    assert text.measure_label("E.global.wt") == "Global efficiency (weighted)" and text.measure_label("zzz") == "zzz"
    assert text.as_fractions([0.5, -1, 1 / 3]) == ["1/2", "-1", "1/3"] and text.in_columns(["a", "b", "c"], 2) == [("a", "c"), ("b", "")]
    df = spark.createDataFrame([("1", "age group"), ("10", "E.global.wt")], "id string, measure string")
    assert [r["id"] for r in text.padded(df, "id").orderBy("id").collect()] == ["01", "10"]
    assert df.select(text.capitalised("measure").alias("m")).first()["m"] == "Age group"
    assert {r["measure"] for r in text.labelled(df).collect()} == {"age group", "Global efficiency (weighted)"}


def test_figures(spark, nets, regions):
    assert figures.positions(regions).count() == N and figures.positions(regions, "sagittal.left").count() == N // 2 and figures.positions(regions, "circular").count() == N
    with pytest.raises(ValueError):
        figures.positions(regions, "below")
    x = np.random.default_rng(0).normal(size=200)
    values = spark.createDataFrame([("r", "A", float(v)) for v in x] + [("r", "B", 1.0)] * 3, "region string, grp string, value double")
    h = figures.histogram(values).toPandas()
    q = np.quantile(x, [0.25, 0.75])
    assert h[h.grp == "A"].n.sum() == 200 and h[h.grp == "B"].n.tolist() == [3]
    a = h[h.grp == "A"]
    assert (a.high - a.low).iloc[0] == pytest.approx(2 * (q[1] - q[0]) / 200 ** (1 / 3))
    for r in a.itertuples():
        assert r.n == ((x >= r.low - 1e-12) & (x < r.high - 1e-12)).sum() or r.bin == a.bin.max()
    box = figures.distribution(values.where("grp = 'A'"), "value").first()
    assert box["median"] == pytest.approx(np.median(x)) and box["low"] >= x.min()
    m = nets.measured(["degree"], ["Cp", "density"]).graphs
    curves = figures.global_curves(m, "density", ["Cp"])
    assert curves.first()["measure"] == "Clustering coefficient"
    changed = figures.edge_changes(nets.edges.withColumn("t", F.col("gid")), "t")
    assert set(r["gid"] for r in changed.collect()) == {"g2"}
    assert figures.group_means(values).count() == 2 and figures.legend(nets.vertices.join(regions, "v"), "lobe").count() == 9
    assert figures.matrix_order(nets.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("r")), regions).count() == nets.edges.count()


def test_user_measures(nets, weights):
    nets.register("twice", "vertex", lambda g: 2 * g.a.sum(1))
    same(column(nets.measured(["twice"], []).vertices, "twice"), {(g, i + 1): x for g, w in weights.items() for i, x in enumerate(2 * (w > 0).sum(1))})
    M.VERTEX.pop("twice")


def test_attacks_on_packed_graphs(nets, weights):
    r = M.robustness(nets.vertices, nets.edges, "vertex", "degree").toPandas()
    assert (r[r.gid == "g3"].comp_size.iloc[0]) == 1 and len(r[r.gid == "g1"]) == N + 1


def test_ego_keeps_an_isolated_seed(spark):
    from netloom.operators import local

    v = spark.createDataFrame([("g", i) for i in range(4)], "gid string, v int")
    e = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0)], "gid string, src int, dst int, weight double")
    seeds = spark.createDataFrame([(0,), (3,)], "v int")
    found, kept = local.ego(e, seeds, v)
    assert sorted(r.v for r in found.collect()) == [0, 1, 3] and kept.count() == 1


def test_whole_names_of_a_fine_parcellation(spark, tmp_path):
    from netloom.sources import io

    for h in ("lh", "rh"):
        (tmp_path / f"aparc.a2009s_{h}_thickness.csv").write_text(f"id,{h}_G_temp_sup-Lateral_thickness,{h}_insula_thickness,{h}_Mean_thickness\n01,1.5,2,9\n02,3,4,9\n")
    long, excluded, missing = io.read_hemispheres(spark, str(tmp_path), "aparc.a2009s", exclude=("02",))
    assert {(r.sid, r.region, r.value) for r in long.collect()} == {("01", "lG_temp_sup.Lateral", 1.5), ("01", "linsula", 2.0), ("01", "rG_temp_sup.Lateral", 1.5), ("01", "rinsula", 2.0)}
    assert excluded == ["02"] and missing == [] and io.short_name("lh_precuneus_thickness") == "lPCUN"
