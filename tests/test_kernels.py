"""Graph kernels against hand-made graphs and brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.operators import kernels as K


def graph(n, edges, weights=None):
    w = np.zeros((n, n))
    for k, (i, j) in enumerate(edges):
        w[i, j] = w[j, i] = 1 if weights is None else weights[k]
    return w


PATH = graph(4, [(0, 1), (1, 2), (2, 3)])
PAW = graph(4, [(0, 1), (1, 2), (0, 2), (2, 3)])  # a triangle with a tail
STAR = graph(5, [(0, i) for i in range(1, 5)])
FULL = graph(5, list(itertools.combinations(range(5), 2)))
TWO = graph(5, [(0, 1), (1, 2), (0, 2), (3, 4)])
ALONE = graph(4, [(0, 1), (1, 2), (0, 2)])
BRIDGE = graph(8, [*itertools.combinations(range(4), 2), *itertools.combinations(range(4, 8), 2), (3, 4)])


def test_paths():
    d = K.distances(PATH)
    assert d[0].tolist() == [0, 1, 2, 3] and K.diameter(d) == 3
    assert K.path_length(d) == pytest.approx(10 / 6)
    assert K.global_efficiency(d) == pytest.approx((3 * 1 + 2 * 0.5 + 1 / 3) / 6)
    assert K.eccentricity(d).tolist() == [3, 2, 2, 3]
    assert K.closeness(d) == pytest.approx([1 / 6, 1 / 4, 1 / 4, 1 / 6])
    w = graph(3, [(0, 1), (1, 2), (0, 2)], [1, 2, 4])
    assert K.distances(w, True)[0, 2] == 3
    with pytest.raises(ValueError):
        K.distances(-w, True)
    d = K.distances(ALONE)
    assert np.isinf(d[0, 3]) and K.vertex_path_length(d)[3] == 0 and np.isnan(K.closeness(d)[3])


def test_clustering():
    assert K.clustering(PAW) == pytest.approx([1, 1, 1 / 3, 0])
    assert K.mean_clustering(PAW) == pytest.approx((1 + 1 + 1 / 3) / 3)  # of vertices with two neighbours
    assert K.transitivity(PAW) == pytest.approx(3 / 5)
    assert K.triangles(FULL).tolist() == [6] * 5
    assert K.local_efficiency(PAW)[2] == pytest.approx(1 / 3) and K.local_efficiency(FULL).tolist() == [1] * 5


def test_betweenness():
    b, e = K.betweenness(STAR)
    assert b.tolist() == [6, 0, 0, 0, 0] and e[0, 1] == 4
    assert K.betweenness(PATH)[0].tolist() == [0, 2, 2, 0]


def test_components_and_cores():
    assert K.components(TWO).tolist() == [1, 1, 1, 2, 2]
    assert K.coreness(PAW).tolist() == [2, 2, 2, 1] and K.coreness(ALONE).tolist() == [2, 2, 2, 0]
    assert K.vulnerability(STAR)[0] == 1 and K.vulnerability(ALONE)[3] == 0


def test_spectral():
    assert K.leading_vector(FULL) == pytest.approx([1] * 5)
    assert K.pagerank(FULL) == pytest.approx([0.2] * 5) and K.pagerank(STAR)[0] == max(K.pagerank(STAR))
    a = PAW
    series, term = np.eye(4), np.eye(4)
    for k in range(1, 40):
        term = term @ a / k
        series = series + term
    assert K.subgraph_centrality(a) == pytest.approx(np.diag(series))
    assert K.expm_sym(a) == pytest.approx(series)


def test_roles():
    g = np.array([1, 1, 1, 1, 2, 2, 2, 2])
    pc = K.participation(BRIDGE, g)
    assert pc[0] == 0 and pc[3] == pytest.approx(1 - (9 + 1) / 16)
    assert K.modularity(BRIDGE, g) == pytest.approx(2 * (6 / 13 - (13 / 26) ** 2))
    assert np.isnan(K.participation(ALONE, np.ones(4, int))[3]) and np.isnan(K.leverage(ALONE)[3])
    assert K.nominal_assortativity(BRIDGE, g) == pytest.approx((12 / 13 - 0.5) / 0.5)
    assert K.leverage(STAR)[0] == pytest.approx(3 / 5)
    assert K.assortativity(STAR) == pytest.approx(-1)


@pytest.mark.parametrize("method", ["louvain", "fast_greedy", "walktrap", "leading_eigen", "edge_betweenness", "infomap", "spinglass", "optimal"])
def test_communities_of_a_bridge(method):
    c = K.communities(BRIDGE, method)
    assert len(set(c[:4])) == len(set(c[4:])) == 1 and c[0] != c[4]


def test_label_propagation():
    assert sorted(set(K.communities(TWO, "label_prop"))) == [1, 2]


def test_rich_club():
    assert K.rich_club(STAR, 1) is np.nan or np.isnan(K.rich_club(STAR, 1))  # one vertex
    assert K.rich_club(FULL, 1) == 1 and K.rich_club(PAW, 1) == pytest.approx(1)


def test_random_graphs_keep_degrees():
    rng = np.random.default_rng(0)
    a = np.triu((rng.random((20, 20)) < 0.3).astype(float), 1)
    a = a + a.T
    b = K.rewire(a, 1)
    assert (b.sum(0) == a.sum(0)).all() and (b == b.T).all() and not np.diag(b).any() and (b != a).any()
    assert (K.rewire(a, 1) == b).all()
    c = K.clustered(a, 0.9, 1, swaps=5)
    assert (c.sum(0) == a.sum(0)).all()


def test_robustness():
    pct, size, share = K.robustness(STAR, "vertex", "degree")
    assert size[0] == 5 and size[1] == 1 and size[-1] == 0 and share[0] == 1
    pct, size, share = K.robustness(PATH, "edge", "random", 20)
    assert size[0] == 4 and len(size) == 4 and (np.diff(size) <= 1e-9).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 9), st.integers(0, 2**31), st.floats(0.1, 0.9))
def test_invariants(n, seed, p):
    rng = np.random.default_rng(seed)
    a = np.triu((rng.random((n, n)) < p).astype(float), 1)
    a = a + a.T
    d = K.distances(a)
    assert (d == d.T).all() and all(d[i, j] <= d[i, k] + d[k, j] for i in range(n) for j in range(n) for k in range(n))
    assert (K.distances(a, True)[~np.isinf(d)] == d[~np.isinf(d)]).all()
    c = K.clustering(a)
    assert ((0 <= c) & (c <= 1)).all()
    brute = [sum(a[i, j] * a[j, k] * a[i, k] for j in range(n) for k in range(j)) for i in range(n)]
    assert K.triangles(a).tolist() == brute
    core = K.coreness(a)
    for k in range(1, int(core.max()) + 1):
        keep = core >= k
        assert (a[np.ix_(keep, keep)].sum(1) >= k).all()
    # betweenness by counting shortest paths
    b = np.zeros(n)
    for s, t in itertools.combinations(range(n), 2):
        if np.isinf(d[s, t]) or d[s, t] < 2:
            continue
        count = lambda x, y: sum(1 for _ in _paths(a, d, x, y))
        total = count(s, t)
        for v in range(n):
            if v not in (s, t) and d[s, v] + d[v, t] == d[s, t]:
                b[v] += count(s, v) * count(v, t) / total
    assert K.betweenness(a)[0] == pytest.approx(b)


def _paths(a, d, x, y):
    if x == y:
        yield ()
        return
    for z in np.flatnonzero(a[x]):
        if d[z, y] == d[x, y] - 1:
            yield from _paths(a, d, z, y)


def test_louvain_ends_on_asymmetric_matrices():
    rng = np.random.default_rng(4)
    for n in (6, 15, 30):
        for _ in range(40):
            a = (rng.random((n, n)) < 0.25).astype(float)
            np.fill_diagonal(a, 0)
            for scale in (1.0, 1e12, 1e-9):
                got = K.louvain(a * scale)
                assert len(got) == n and (got == K.louvain((a + a.T) / 2 * scale)).all()


def test_density_graphs_are_symmetric():
    from netloom.operators.covariance import density_graphs

    x = np.random.default_rng(5).standard_normal((60, 40))
    for g in density_graphs(x, [0.1, 0.2, 0.5]):
        assert (g == g.T).all() and not np.diag(g).any()


def test_clustered_reaches_its_target():
    rng = np.random.default_rng(6)
    a = np.triu(rng.random((40, 40)) < 0.15, 1).astype(float)
    a += a.T
    b = K.clustered(a, 0.3, 1)
    assert K.transitivity(b) >= 0.3 > K.transitivity(a) and (b.sum(0) == a.sum(0)).all() and (b == b.T).all()


def test_hqs_moments():
    c = np.cov(np.random.default_rng(7).standard_normal((200, 1)) + np.random.default_rng(8).standard_normal((200, 30)), rowvar=False)
    r = K.hqs(c, 1)
    assert np.allclose(np.diag(r), 1) and np.allclose(r, r.T)
    assert np.isnan(K.hqs(np.eye(3) - 0.1, 1)).all()  # a mean below zero has no draw
