"""One large graph: the same measures as from its dense matrix, without a row or a matrix of it."""

import numpy as np
import pytest

from netloom.operators import kernels as K
from netloom.operators import large as B
from netloom.operators import measures as M


def adjacency(n, p, seed, parts=1):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)) < p, 1)
    part = np.arange(n) % parts
    a &= part[:, None] == part
    return (a | a.T).astype(float)


def rows_of(a):
    near = B.Rows()
    for i in range(len(a)):
        ids = np.flatnonzero(a[i])
        for piece in (ids[: len(ids) // 2], ids[len(ids) // 2 :])[::-1]:
            if len(piece):
                near.add(np.array([i]), piece[:1], [np.diff(piece, prepend=piece[0]).astype(np.uint16).tobytes()])
    return near.ready()


def path(n):
    return np.eye(n, k=1) + np.eye(n, k=-1)


GRAPHS = {
    "dense": adjacency(90, 0.6, 1), "sparse": adjacency(200, 0.02, 2), "parts": adjacency(150, 0.3, 3, 4), "path": path(70), "ring": np.roll(np.eye(9), 1, 0) + np.roll(np.eye(9), -1, 0),
    "star": np.pad(np.ones((1, 6)), ((0, 6), (1, 0))) + np.pad(np.ones((1, 6)), ((0, 6), (1, 0))).T, "none": np.zeros((5, 5)), "one": np.zeros((1, 1)),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_same_as_dense(spark, name, monkeypatch):
    monkeypatch.setattr(B, "HELD", 70)  # panels of one word
    monkeypatch.setattr(B, "PANEL", 1)
    a = GRAPHS[name]
    ids = [7 * k + 3 for k in range(len(a))]
    v = spark.createDataFrame([("g", x) for x in ids], "gid string, v int")
    e = [("g", ids[i], ids[j], 2.5) for i, j in zip(*np.nonzero(np.triu(a)))]
    e += [(g, j, i, w) for g, i, j, w in e[:5]] + [("g", ids[0], ids[0], 1.0), ("g", ids[-1], ids[0], 0.0)]
    df = spark.createDataFrame(e, "gid string, src int, dst int, weight double")
    monkeypatch.setattr(M, "packed", None)
    got = {r["measure"]: r["value"] for r in B.graph_measures(v, df, list(B.MEASURES)).collect()}
    g = M.Graph(a)
    for m in B.MEASURES:
        want = M._clean(M.GRAPH[m](g))
        assert got[m] == (want if want is None else pytest.approx(want, abs=1e-9)), m


@pytest.mark.parametrize("seed", range(12))
def test_louvain_makes_the_same_moves(seed):
    a = adjacency(120 + 30 * seed, [0.02, 0.1, 0.5][seed % 3], seed, 1 + seed % 4)
    want = K.modularity(a, K.communities(a, "louvain", seed=seed))
    assert B.louvain_modularity(rows_of(a), len(a), seed) == pytest.approx(want, abs=1e-12)


def test_wide_gaps_and_unknown_ends(spark):
    v = spark.range(200_000).selectExpr("'g' gid", "cast(id as int) v")
    e = spark.createDataFrame([("g", 0, 199_999, 1.0), ("g", 0, 1, 1.0), ("g", 1, 150_000, 1.0), ("g", 5, 6, 1.0)], "gid string, src int, dst int, weight double")
    got = {r["measure"]: r["value"] for r in B.graph_measures(v, e, ["Lp", "diameter", "mod"]).collect()}
    assert got["diameter"] == 3 and got["Lp"] == pytest.approx((4 * 1 + 2 * 2 + 3) / 7)
    with pytest.raises(Exception, match="not among the vertices"):
        B.graph_measures(v.where("v < 150000"), e, ["Lp"]).collect()


def test_one_graph_only(spark):
    v = spark.createDataFrame([("a", 1), ("b", 1)], "gid string, v int")
    with pytest.raises(ValueError, match="one graph"):
        B.graph_measures(v, None, ["Cp"])
    assert B.graph_measures(v.where("false"), None, ["Cp"]).collect() == []


def test_supplier_query_packs_no_graph_in_a_row(spark, monkeypatch):
    """The whole graph was one row of edges, and a matrix of suppliers squared."""
    from netloom.plans import catalogue as C
    from netloom.plans import fixtures as T

    v = spark.createDataFrame([("suppliers", k) for k in range(40)], "gid string, v int")
    a = adjacency(40, 0.3, 9)
    e = spark.createDataFrame([("suppliers", int(i), int(j), 1.0) for i, j in zip(*np.nonzero(np.triu(a)))], "gid string, src int, dst int, weight double")
    monkeypatch.setattr(T, "supplier_graph", lambda *_: (v, e))
    for name in ("packed", "matrix"):
        monkeypatch.setattr(M, name, lambda *_, **__: pytest.fail("one row or one matrix"))
    (row,) = C.queries()["supplier_network"](spark, "").collect()
    for m in B.MEASURES:
        assert row[m.replace(".", "_")] == pytest.approx(M.GRAPH[m](M.Graph(a)), abs=1e-6)
