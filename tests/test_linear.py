"""Linear-model numerics: designs, fits, diagnostics by refitting, permutations, distributions."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.functions import dist
from netloom.functions import linear as L


@pytest.fixture
def data():
    rng = np.random.default_rng(4)
    c = pd.DataFrame({"age": rng.normal(50, 9, 30), "grp": rng.choice(["a", "b", "c"], 30), "sex": rng.choice(["F", "M"], 30)})
    return c, rng.normal(size=(30, 3)) + c.age.to_numpy()[:, None] * 0.1


def test_distributions():
    assert dist.norm_cdf(1.96) == pytest.approx(0.9750021)
    assert dist.t_cdf(2.0, 1) == pytest.approx(0.5 + math.atan(2) / math.pi)
    assert dist.t_cdf(1.5, 2) == pytest.approx(0.5 + 1.5 / (2 * math.sqrt(2 + 1.5**2)))
    assert dist.f_sf(4.0, 1, 10) == pytest.approx(2 * dist.t_sf(2.0, 10))
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281389) and dist.norm_ppf(0.975) == pytest.approx(1.9599640)
    assert dist.quantile7([1, 2, 4, 8], 0.25) == 1.75
    assert dist.bh([0.01, 0.04, 0.03, 0.5]) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


@settings(max_examples=50, deadline=None)
@given(st.floats(0.001, 0.999), st.integers(1, 200))
def test_quantiles_invert(p, df):
    assert dist.t_cdf(dist.t_ppf(p, df), df) == pytest.approx(p, abs=1e-8)


def test_designs(data):
    c, _ = data
    d = L.design(c)
    assert d.columns == ["Intercept", "age", "grpb", "grpc", "sexM"] and d.terms["grp"] == [2, 3]
    e = L.design(c, coding="effects")
    assert set(e.x[:, 2]) == {-1, 0, 1}
    m = L.design(c[["age", "grp"]], coding="cell.means")
    assert "Intercept" not in m.columns and m.columns == ["age", "grpa", "grpb", "grpc"]
    i = L.design(c, interactions=("age", "grp", "sex"))
    assert "age:grp:sex" in i.terms and len(i.terms["age:grp"]) == 2
    z = L.design(c, center=True, center_by="grp")
    assert all(abs(z.x[(c.grp == g).to_numpy(), 1].mean()) < 1e-9 for g in "abc")
    assert L.design(c, binarize=("grp",)).x[:, 2].max() == 2
    with pytest.raises(ValueError):
        L.design(c, coding="other")


def test_fit_and_diagnostics_by_refitting(data):
    c, y = data
    d = L.design(c)
    f = L.fit(d.x, y)
    beta = np.linalg.lstsq(d.x, y, rcond=None)[0]
    assert f.beta == pytest.approx(beta)
    n = len(y)
    db, s, st_, ck, df_ = L.dfbeta(f), L.sigma_loo(f), L.rstudent(f), L.cooks(f), L.dffits(f)
    for i in (0, 7, 29):
        keep = np.arange(n) != i
        g = L.fit(d.x[keep], y[keep])
        assert db[i] == pytest.approx(f.beta - g.beta) and s[i] == pytest.approx(g.sigma)
        gap = f.fitted[i] - d.x[i] @ g.beta
        h = L.hat_values(f)[i]
        assert df_[i] == pytest.approx(gap / (g.sigma * np.sqrt(h)))
        assert ck[i] == pytest.approx(((f.fitted - d.x @ g.beta) ** 2).sum(0) / (f.rank * f.sigma**2))
        assert st_[i] == pytest.approx((y[i] - d.x[i] @ g.beta) / (g.sigma * np.sqrt(1 + d.x[i] @ g.cov @ d.x[i])))
    with pytest.raises(ValueError):
        L.fit(np.column_stack([d.x, d.x[:, 1]]), y)


def test_tests_agree(data):
    c, y = data
    d = L.design(c)
    f = L.fit(d.x, y)
    one = np.eye(5)[1]
    t, F = L.t_test(f, one), L.f_test(f, one)
    assert F["stat"] == pytest.approx(t["stat"] ** 2) and F["p"] == pytest.approx(t["p"])
    lo, hi = L.confint(f)
    assert t["ci_low"] == pytest.approx(lo[1]) and t["ci_high"] == pytest.approx(hi[1])
    a = L.anova3(d, y[:, 0]).set_index("term")
    both = L.f_test(f, np.eye(5)[[2, 3]])
    assert a.loc["grp", "f"] == pytest.approx(both["stat"][0]) and a.loc["age", "f"] == pytest.approx(F["stat"][0])
    v = L.vif(d).set_index("term")
    r = L.fit(np.delete(d.x, 1, 1), d.x[:, 1])
    assert v.loc["age", "gvif"] == pytest.approx(1 / (1 - L.r_squared(r)[0]))


def test_three_dimensional_designs(data):
    c, y = data
    x = np.stack([L.design(c).x] * 3, 2)
    x[:, 1, 1] += np.linspace(0, 5, 30)
    x[:, 2, 2] = x[:, 0, 2]  # singular
    f = L.fit(x, y)
    assert f.beta[:, 0] == pytest.approx(L.fit(x[:, :, 0], y[:, 0]).beta[:, 0]) and np.isnan(f.beta[:, 2]).all()
    assert L.t_test(f, np.eye(5)[1])["stat"][1] == pytest.approx(L.t_test(L.fit(x[:, :, 1], y[:, 1]), np.eye(5)[1])["stat"][0])


@pytest.mark.parametrize("part", ["beckmann", "guttman", "ridgway"])
def test_partitions_span_the_design(data, part):
    m = L.design(data[0]).x
    c = np.eye(5)[1] - np.eye(5)[4] if part != "guttman" else np.eye(5)[1]
    x, z, cc = L.partition(m, c, part)
    both = np.hstack([x, z])
    assert np.linalg.matrix_rank(np.hstack([m, both])) == 5 == np.linalg.matrix_rank(both)
    f, g = L.fit(m, data[1]), L.fit(both, data[1])
    assert L.t_test(g, cc)["stat"] == pytest.approx(L.t_test(f, c)["stat"])


@pytest.mark.parametrize("method", ["freedmanLane", "terBraak", "smith", "draperStoneman", "manly"])
def test_identity_permutation_gives_the_statistic(data, method):
    c, y = data
    x = L.design(c).x
    r = L.Randomiser(x, y, np.eye(5)[1], "t", method)
    seen = L.t_test(L.fit(x, y), np.eye(5)[1])["stat"]
    if method != "terBraak":  # which permutes residuals of the full model: its identity is 0
        assert r(np.arange(30)) == pytest.approx(seen)
    else:
        assert r(np.arange(30)) == pytest.approx(np.zeros(3), abs=1e-6)


def test_freedman_lane_by_hand(data):
    c, y = data
    x, order = L.design(c).x, np.random.default_rng(1).permutation(30)
    z = np.delete(x, 1, 1)
    rz = np.eye(30) - z @ np.linalg.pinv(z)
    seen = L.Randomiser(x, y, np.eye(5)[1], "t", "freedmanLane", "guttman")(order)
    assert seen == pytest.approx(L.t_test(L.fit(x, (rz @ y)[order]), np.eye(5)[1])["stat"])


def test_mediation_effects():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 2, 200).astype(float)
    m = 2 * t + rng.normal(size=200)
    y = 3 * m + t + rng.normal(size=200)
    one = np.ones(200)
    e = L.mediate(np.column_stack([one, t]), m, np.column_stack([one, t, m]), y, 1, 2, None, 0.0, 1.0)
    a = L.fit(np.column_stack([one, t]), m).beta[1, 0]
    b = L.fit(np.column_stack([one, t, m]), y).beta[:, 0]
    assert e["d0"] == pytest.approx(a * b[2]) == pytest.approx(e["d1"]) and e["z0"] == pytest.approx(b[1])
    assert e["tau"] == pytest.approx(L.fit(np.column_stack([one, t]), y).beta[1, 0])
