"""Structural covariance of many subjects: what the driver collects doesn't grow with them, and
the results equal those of all subjects' values in one matrix."""

import numpy as np
import pytest

from netloom.operators import covariance as S
from netloom.operators import kernels as K
from netloom.operators import measures as M

N, REGIONS = 300, ["ra", "rb", "rc", "rd", "re"]


@pytest.fixture(scope="module")
def values():
    """groups and values, as subjects by regions: A before B, as their sids"""
    rng = np.random.default_rng(5)
    return np.array(["A"] * 180 + ["B"] * 120), rng.normal(2.5, 0.3, (N, 1)) + rng.normal(0, 0.2, (N, 5)).round(4)


@pytest.fixture(scope="module")
def many(spark, values):
    groups, x = values
    rows = [(g, f"s{k:03d}", r, float(v)) for k, (g, row) in enumerate(zip(groups, x)) for r, v in zip(REGIONS, row)]
    return spark.createDataFrame(rows, "grp string, sid string, region string, value double").localCheckpoint()


@pytest.fixture
def collected(many, monkeypatch):
    """numbers of rows that the driver collected"""
    seen, kind = [], type(many)
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(kind, name, lambda self, fn=getattr(kind, name): (out := fn(self), seen.append(len(out)))[0])
    return seen


def test_hqs_of_many(many, values, collected):
    draws = S.hqs_graphs(many, 6, 0.4)
    assert max(collected) < 100
    groups, x = values
    got = {(r["grp"], r["rand_id"]): r["cp"] for r in draws.collect()}
    for k, g in enumerate("AB"):
        cov = np.cov(x[groups == g], rowvar=False)
        for r in range(6):
            m = S.mirrored(K.hqs(cov, [0, r, k]))
            low = np.sort(m[np.tril_indices(5, -1)])
            a = ((m > low[int(len(low) - 0.4 * len(low)) - 1]) & ~np.eye(5, dtype=bool)).astype(float)
            assert got[(g, r)] == M._clean(M.GRAPH["Cp"](M.Graph(a)))


def differences(x, mark, densities):
    one, two = S.density_graphs(x[mark], densities), S.density_graphs(x[~mark], densities)
    return {d: (M.Graph(a), M.Graph(b)) for d, a, b in zip(densities, one, two)}


def test_permuted_groups_of_many(many, values, collected, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    draws = S.permute_groups(many, [0.4, 0.6], 12)
    assert max(collected) < 100
    groups, x = values
    got = {(r["perm_id"], r["density"], r["measure"]): r["diff"] for r in draws.collect()}
    assert len(got) == 13 * 2 * len(M.GRAPH.keys() & set(S.PERMUTED_GRAPH))
    for p in range(13):
        mark = groups == "A" if p == 12 else (groups == "A")[np.random.default_rng([0, p]).permutation(N)]
        for d, (a, b) in differences(x, mark, [0.4, 0.6]).items():
            assert got[(p, d, "Cp")] == M._clean(M.GRAPH["Cp"](a) - M.GRAPH["Cp"](b))
            assert got[(p, d, "mod")] == M._clean(M.GRAPH["mod"](a) - M.GRAPH["mod"](b))


def test_needs_two_groups(many):
    with pytest.raises(ValueError, match="two groups"):
        S.permute_groups(many.where("grp = 'A'"), [0.5], 3)


def test_permuted_vertices_of_many(many, values, collected, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    draws = S.permute_groups(many, [0.5], 5, "vertex", "degree")
    assert max(collected) < 100
    groups, x = values
    got = {(r["perm_id"], r["region"]): r["diff"] for r in draws.collect()}
    for p in range(5):
        a, b = differences(x, (groups == "A")[np.random.default_rng([0, p]).permutation(N)], [0.5])[0.5]
        assert [got[(p, r)] for r in REGIONS] == (M.VERTEX["degree"](a) - M.VERTEX["degree"](b)).tolist()


def test_bootstrap_of_many(many, values, collected, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    draws = S.bootstrap(many, [0.5], "strength", 8)
    assert max(collected) < 100
    groups, x = values
    got = {(r["grp"], r["rep_id"]): r["value"] for r in draws.collect()}
    assert len(got) == 18
    for k, g in enumerate("AB"):
        rows = np.flatnonzero(groups == g)
        for r in range(-1, 8):
            at = rows if r < 0 else rows[np.random.default_rng([0, r, k]).integers(0, len(rows), len(rows))]
            assert got[(g, r)] == pytest.approx(S.density_graphs(x[at], [0.5], True)[0].sum(1).mean())


def test_contributions_without_a_row_a_pair(spark, many):
    from pyspark.sql import functions as F

    odd = many.where("not (sid = 's003' and region = 'rb') and not (sid = 's190' and region > 'ra')").withColumn("value", F.when(F.expr("not (sid = 's005' and region = 'rc')"), F.col("value")))
    for new, old in ((S.loo_regional(odd), S.contribution_regional(S.loo_pairs(odd))), (S.aop_regional(odd, "A"), S.contribution_regional(S.aop_pairs(odd, "A"))), (S.loo_global(odd), S.contribution_global(S.loo_pairs(odd)))):
        a, b = ({tuple(r)[:-1]: r[-1] for r in df.collect()} for df in (new, old))
        assert a.keys() == b.keys() and len(a) >= 119
        assert all((x is None) == (b[k] is None) and (x is None or x == pytest.approx(b[k], abs=1e-9)) for k, x in a.items())


def test_pairs_are_not_shuffled(many):
    for pairs in (S.loo_pairs(many), S.aop_pairs(many, "A")):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_all_permutations_are_made(monkeypatch):
    """The catalogue's query takes the operator's default number, and its summary the same."""
    import inspect

    from netloom.plans import catalogue as C

    default, seen = inspect.signature(S.permute_groups).parameters["n"].default, []
    monkeypatch.setattr(C.T, "cohort", lambda *_: None)
    monkeypatch.setattr(C, "rounded", lambda x: x)
    monkeypatch.setattr(S, "permute_groups", lambda y, d, n=default, *_: seen.append(n))
    monkeypatch.setattr(S, "permutation_summary", lambda d, n: seen.append(n))
    C.permute_groups(None, "")
    assert default == 5000 and seen == [5000, 5000]


@pytest.fixture
def made(spark, many, collected, monkeypatch):
    """query of the catalogue -> most rows collected, most subjects weighed and bytes broadcast on
    the driver while it is made (no draw runs), for `many` and for twice as many subjects"""
    import pickle

    from pyspark import SparkContext
    from pyspark.sql import functions as F

    from netloom.plans import catalogue as C

    weighed, sent, drawn, broadcast = [], [], S.drawn, SparkContext.broadcast
    monkeypatch.setattr(C, "rounded", lambda x: x)
    monkeypatch.setattr(S, "drawn", lambda y, n, first, weigh, *rest: drawn(y, n, first, lambda d, sizes: (weighed.append(sum(sizes)), weigh(d, sizes))[1], *rest))
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, v: (sent.append(len(pickle.dumps(v))), broadcast(self, v))[1])

    def run(query):
        out = []
        for y in (many, many.union(many.withColumn("sid", F.concat("sid", F.lit("x"))))):
            for seen in (collected, weighed, sent):
                seen.clear()
            monkeypatch.setattr(C.T, "cohort", lambda *_, y=y: y)
            getattr(C, query)(spark, "")
            out.append((max(collected), max(weighed, default=0), sum(sent)))
        return out

    return run


def test_boot_global_on_the_driver(made):
    (rows, weights, sent), (more_rows, more_weights, more_sent) = made("boot_global")
    assert rows == more_rows < 100 and weights == more_weights < 100
    assert more_sent < sent + 100


def test_permute_vertex_on_the_driver(made):
    (rows, weights, sent), (more_rows, more_weights, more_sent) = made("permute_vertex")
    assert rows == more_rows < 100 and weights == more_weights < 100
    assert more_sent < sent + 100


def test_permute_vertex_collects_no_subjects(spark, many, collected, monkeypatch):
    """It names no part of the resampling step, so code without these parts fails by the rows."""
    from netloom.plans import catalogue as C

    monkeypatch.setattr(C, "rounded", lambda x: x)
    monkeypatch.setattr(C.T, "cohort", lambda *_: many)
    C.permute_vertex(spark, "")
    assert collected and max(collected) < 100
