"""Linear models, permutation inference and covariance operators in Spark against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netloom.functions import linear as L
from netloom.operators import covariance as S
from netloom.operators import glm as G
from netloom.operators.model import LinearModel, mediation_export, mediation_summary, mtpc_summary, nbs_summary, stacked
from netloom.operators.results import NetworkStatistic, Residuals, ThresholdModel, bootstrap_report, contribution_report, permutation_report
from netloom.plans import figures

SIDS = [f"s{i:02d}" for i in range(24)]
REGIONS = ["ra", "rb", "rc"]


@pytest.fixture(scope="module")
def covars():
    rng = np.random.default_rng(5)
    return pd.DataFrame({"sid": SIDS, "age": rng.normal(50, 5, 24), "grp": ["a", "b"] * 12})


@pytest.fixture(scope="module")
def table(covars):
    rng = np.random.default_rng(6)
    y = rng.normal(size=(24, 3)) + 0.2 * covars.age.to_numpy()[:, None]
    y[:, 0] += 3 * (covars.grp == "b")
    return y


@pytest.fixture(scope="module")
def y(spark, table):
    rows = [(r, s, float(table[i, k])) for k, r in enumerate(REGIONS) for i, s in enumerate(SIDS)]
    return spark.createDataFrame(rows, "region string, sid string, value double").repartition(2).cache()


@pytest.fixture(scope="module")
def model(y, covars):
    return LinearModel(y, covars, {"b over a": [0, 0, 1]}, outcome="strength")


def by_region(df, column):
    return np.array([r[column] for r in df.orderBy("region").collect()])


def test_accessors(model, covars):
    assert model.variable_names() == ["Intercept", "age", "grpb"] and model.labels() == ["age", "grp"] and model.terms()["grp"] == ["grpb"]
    assert model.n_obs() == 24 and model.df_residual() == 21 and model.region_names() == REGIONS and model.n_regions() == 3
    assert model.formula() == "strength ~ age + grp" and model.contrast_names() == ["b over a"] and model.case_names() == SIDS
    assert model.select(SIDS[:10]).n_obs() == 10 and model.select(columns=["age"]).variable_names() == ["Intercept", "age"]
    gaps = covars.copy()
    gaps.loc[3, "age"] = None
    assert LinearModel(model.y, gaps).left_out() == ["s03"] and "b over a" in model.report()


def test_statistics(model, table):
    f = L.fit(model.design.x, table)
    t = L.t_test(f, [0, 0, 1])
    got = model.statistics().orderBy("region").collect()
    for k, name in enumerate(("gamma", "se", "stat", "p", "p_fdr", "ci_low", "ci_high")):
        assert [r[name] for r in got] == pytest.approx(t[name]), name
    assert by_region(model.sigma(), "sigma") == pytest.approx(f.sigma) and by_region(model.coeff_determ(True), "r2") == pytest.approx(L.r_squared(f, True))
    assert by_region(model.extract_aic(), "aic") == pytest.approx(L.aic(f)[1]) and by_region(model.log_lik(True), "log_lik") == pytest.approx(L.log_lik(f, True))
    assert model.coef().where("region = 'rb' and term = 'age'").first()["estimate"] == pytest.approx(f.beta[1, 1])
    v = model.vcov().where("region = 'ra' and row = 'age' and col = 'grpb'").first()["value"]
    assert v == pytest.approx(L.vcov(f)[0][1, 2])
    assert model.dfbeta(True).where("region = 'rc' and sid = 's05' and term = 'age'").first()["dfbeta"] == pytest.approx(L.dfbetas(f)[5, 1, 2])
    part = model.residuals("partial").where("region = 'ra' and sid = 's00' and term = 'age'").first()["resid"]
    x = model.design.x[:, 1] * f.beta[1, 0]
    assert part == pytest.approx(f.resid[0, 0] + x[0] - x.mean())
    assert model.rstandard("predictive").where("region = 'ra' and sid = 's02'").first()["rstandard"] == pytest.approx(L.rstandard(f, "predictive")[2, 0])
    assert model.vif().term.tolist() == ["age", "grp"] and model.anova().count() == 9
    assert model.summary(alpha=0.01).first()["region"] == "ra"
    assert stacked({"one": model, "two": model}).count() == 6
    assert model.influence_wide().columns[-3:] == ["Intercept", "age", "grpb"]
    d = figures.diagnostics(model.observations())
    assert d.count() == 72 and d.where("cooks_rank = 1").count() == 3


def test_missing_and_constant_outcomes(spark, y, covars):
    odd = y.withColumn("value", F.when(F.col("region") == "rb", F.lit(1.0)).when((F.col("region") == "rc") & (F.col("sid") == "s00"), None).otherwise(F.col("value")))
    got = {r["region"]: r["stat"] for r in G.glm(odd, covars, [[0, 0, 1]]).collect()}
    assert got["ra"] is not None and got["rb"] is None and got["rc"] is None


@pytest.mark.parametrize("method", ["freedmanLane", "smith", "stillWhite"])
def test_permutation_nulls(model, covars, table, y, method):
    perms = np.array([np.random.default_rng(k).permutation(24) for k in range(30)])
    null = G.permutation_null(y, covars, {"c": [0, 0, 1]}, method=method, perms=perms)
    got = [r["extreme"] for r in null.orderBy("perm_id").collect()]
    r = L.Randomiser(model.design.x, table, np.array([0, 0, 1.0]), "t", method)
    assert got == pytest.approx([np.abs(r(p)).max() for p in perms])
    stats = G.glm(y, covars, {"c": [0, 0, 1]})
    out = G.glm_permuted(stats, null).orderBy("region").collect()
    for row in out:
        assert row["p_perm"] == pytest.approx((sum(e >= abs(row["stat"]) for e in got) + 1) / 31)
        assert row["critical"] == pytest.approx(sorted(got)[int(np.floor(0.95 * 30))])


def test_permuted_model(model):
    p = {r["region"]: r["p_perm"] for r in model.permuted(99).collect()}
    assert p["ra"] <= 0.05 and all(0 < v <= 1 for v in p.values())


def test_network_based_statistic(spark, covars):
    rng = np.random.default_rng(8)
    v = 6
    up = {(1, 2), (2, 3), (1, 3)}
    rows = [(s, i, j, float(rng.normal() + (4 if (i, j) in up and g == "b" else 0))) for s, g in zip(SIDS, covars.grp) for i in range(1, v + 1) for j in range(i + 1, v + 1)]
    pairs = spark.createDataFrame(rows, "sid string, i int, j int, w double")
    found, edges = G.nbs(pairs, covars[["sid", "grp"]], {"c": [0, 1]}, p_init=0.001, n=40)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == up
    c = nbs_summary(found).collect()
    assert len(c) == 1 and c[0]["vertices"] == 3 and c[0]["edges"] == 3 and c[0]["p"] == pytest.approx(1 / 41, abs=0.08)


def test_mtpc(spark, covars):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(len(REGIONS), 24))  # neighbouring thresholds are alike, so null runs occur
    rows = [(float(t), r, s, float(base[k, i] + 0.2 * rng.normal() + (3 if r == "ra" and g == "b" and t <= 6 else 0))) for t in range(1, 9) for k, r in enumerate(REGIONS) for i, (s, g) in enumerate(zip(SIDS, covars.grp))]
    y = spark.createDataFrame(rows, "tau double, region string, sid string, value double")
    stats, out = G.mtpc(y, covars[["sid", "grp"]], {"c": [0, 1]}, n=40)
    assert stats.count() == 24
    best = mtpc_summary(out).collect()
    assert [r["region"] for r in best] == ["ra"] and best[0]["tau_mtpc"] <= 6
    seen = {r["tau"]: r["stat"] for r in stats.where("region = 'ra'").collect()}
    crit = stats.first()["crit"]
    area, run = 0.0, []
    for t in [*sorted(seen), None]:
        if t is not None and abs(seen[t]) > crit:
            run.append(t)
            continue
        if len(run) >= 3:
            area += abs(sum((b - a) * (seen[a] + seen[b]) / 2 for a, b in zip(run, run[1:])))
        run = []
    assert best[0]["a_mtpc"] == pytest.approx(area)


def test_mediation(spark):
    rng = np.random.default_rng(1)
    t = rng.integers(0, 2, 60).astype(float)
    m = 2 * t + rng.normal(size=60)
    c = pd.DataFrame({"sid": [f"{i:03d}" for i in range(60)], "out": 3 * m + rng.normal(size=60), "treat": t})
    y = spark.createDataFrame([("r", s, float(x)) for s, x in zip(c.sid, m)], "region string, sid string, value double")
    e = G.mediation(y, c, "out", "treat", n=100)
    d = mediation_export(e, "r")
    assert d["d_avg"]["ci_low"] <= d["d_avg"]["estimate"] <= d["d_avg"]["ci_high"] and d["d_avg"]["p"] < 0.05
    assert d["tau"]["estimate"] == pytest.approx(d["d0"]["estimate"] + d["z0"]["estimate"])
    s = mediation_summary(e).first()
    assert s["acme_estimate"] == d["d_avg"]["estimate"] and s["prop_p"] == d["n_avg"]["p"]
    assert G.mediation(y, c, "out", "treat", boot=False).where("ci_low is not null").count() == 0
    assert G.mediation(y, c, "out", "treat", n=50, ci="bca", interaction=True).count() == 10


@pytest.fixture(scope="module")
def cohort(spark, table):
    rows = [("A" if i < 14 else "B", s, r, float(table[i, k])) for k, r in enumerate(REGIONS) for i, s in enumerate(SIDS)]
    return spark.createDataFrame(rows, "grp string, sid string, region string, value double").cache()


def test_correlations(cohort, table):
    got = {(r["grp"], r["r1"], r["r2"]): r["r"] for r in S.correlations(cohort).collect()}
    for g, rows in (("A", slice(0, 14)), ("B", slice(14, 24))):
        want = np.corrcoef(table[rows].T)
        assert got[(g, "ra", "rc")] == pytest.approx(want[0, 2])
    rank = {(r["grp"], r["r1"], r["r2"]): r["r"] for r in S.correlations(cohort, "spearman").collect()}
    assert rank[("A", "ra", "rb")] == pytest.approx(pd.DataFrame(table[:14]).corr("spearman").iloc[0, 1])


def test_contributions_by_leaving_out(cohort, table):
    pairs = S.loo_pairs(cohort)
    got = {(r["sid"], r["region"]): r["rc"] for r in S.contribution_regional(pairs).collect()}
    full = np.corrcoef(table[:14].T)
    less = np.corrcoef(np.delete(table[:14], 3, 0).T)
    assert got[("s03", "ra")] == pytest.approx(np.abs(full - less)[0].sum())
    low = np.tril_indices(3, -1)
    ic = {r["sid"]: r["ic"] for r in S.contribution_global(pairs).collect()}
    assert ic["s03"] == pytest.approx(1 - np.corrcoef(full[low], less[low])[0, 1])


def test_bootstrap_and_permutation(cohort):
    draws = S.bootstrap(cohort, [0.5], "Cp", 20)
    b = S.bootstrap_summary(draws)
    assert b.count() == 2
    d = S.permute_groups(cohort, [0.5], 20)
    assert d.select("perm_id").distinct().count() in (20, 21)
    z, p = S.cor_diff_test(0.5, 0.1, 50, 60)
    assert z == pytest.approx((np.arctanh(0.5) - np.arctanh(0.1)) / np.sqrt(1 / 47 + 1 / 57)) and 0 < p < 1


def test_residuals(cohort, covars, table):
    r = S.residuals(cohort, covars)
    x = L.design(covars.drop(columns="sid")).x
    want = L.rstudent(L.fit(x, table))
    got = {(q["region"], q["sid"]): q["value"] for q in r.collect()}
    assert got[("rb", "s11")] == pytest.approx(want[11, 1])
    assert S.qq(r).count() == 72
    flat = np.array(list(got.values()))
    assert S.residual_outliers(r).count() == (np.abs(flat) > abs(flat.mean() + 2 * flat.std(ddof=1))).sum()


def test_designs_by_region(y, covars, table):
    c = covars.assign(iq=np.random.default_rng(12).normal(100, 10, 24) + 2 * table[:, 0])
    m = LinearModel(y, c, {"iq by strength": [0, 0, 1, 0]}, outcome="strength", response="iq")
    assert m.variable_names() == ["Intercept", "age", "strength", "grpb"] and m.formula() == "iq ~ age + strength + grp" and m.df_residual() == 20
    x = np.stack([np.column_stack([np.ones(24), c.age, table[:, k], c.grp == "b"]).astype(float) for k in range(3)], 2)
    f = L.fit(x, c.iq.to_numpy())
    assert by_region(m.statistics(), "stat") == pytest.approx(L.t_test(f, [0, 0, 1, 0])["stat"])
    assert by_region(m.sigma(), "sigma") == pytest.approx(f.sigma)
    assert m.coef().where("region = 'rc' and term = 'strength'").first()["estimate"] == pytest.approx(f.beta[2, 2])
    assert m.hatvalues().where("region = 'rb' and sid = 's03'").first()["hat"] == pytest.approx(L.hat_values(f)[3, 1])
    v = m.vif_by_region().where("region = 'ra' and term = 'strength'").first()["gvif"]
    rest = np.delete(x[:, :, 0], 2, 1)
    e = table[:, 0] - rest @ np.linalg.pinv(rest) @ table[:, 0]
    assert v == pytest.approx(((table[:, 0] - table[:, 0].mean()) ** 2).sum() / (e**2).sum())
    with pytest.raises(ValueError):
        m.vif()
    perms = np.array([np.random.default_rng(k).permutation(24) for k in range(20)])
    for method in ("freedmanLane", "smith"):
        null = G.permutation_null(y, c, {"c": [0, 0, 1, 0]}, method=method, perms=perms, outcome="iq", measure="strength")
        want = [max(abs(L.Randomiser(x[:, :, k], c.iq.to_numpy(), np.array([0, 0, 1.0, 0]), "t", method)(p)[0]) for k in range(3)) for p in perms]
        assert [r["extreme"] for r in null.orderBy("perm_id").collect()] == pytest.approx(want)
    flat = y.withColumn("value", F.when(F.col("region") == "rb", F.lit(1.0)).otherwise(F.col("value")))
    got = {r["region"]: r["stat"] for r in G.glm(flat, c, {"c": [0, 0, 1, 0]}, outcome="iq", measure="strength").collect()}
    assert got["rb"] is None and got["ra"] is not None
    assert G.permutation_null(flat, c, {"c": [0, 0, 1, 0]}, n=3, outcome="iq", measure="strength").where("extreme is null").count() == 0


def test_network_statistic_as_object(spark, covars):
    rng = np.random.default_rng(8)
    rows = [(s, i, j, float(rng.normal() + (4 if g == "b" and j < 4 else 0))) for s, g in zip(SIDS, covars.grp) for i in range(1, 6) for j in range(i + 1, 6)]
    m = NetworkStatistic(spark.createDataFrame(rows, "sid string, i int, j int, w double"), covars[["sid", "grp"]], {"c": [0, 1]})
    assert m.n_obs() == 24 and m.df_residual() == 22 and m.labels() == ["grp"] and m.formula() == "weight ~ grp" and m.case_names() == SIDS
    assert m.variable_names() == ["Intercept", "grpb"] and m.terms()["grp"] == ["grpb"] and m.n_regions() == 5 and m.statistics().count() == 10
    found, edges = m.components(n=20)
    assert edges.count() == 3 and m.summary(found, alpha=0.1).first()["vertices"] == 3 and "weight ~ grp" in m.report()


def test_threshold_model_as_object(y, covars):
    taus = F.explode(F.array(*(F.lit(float(t)) for t in (1, 2, 3, 4))))
    m = ThresholdModel(y.withColumn("tau", taus), covars[["sid", "grp"]], {"c": [0, 1]})
    assert m.taus() == [1, 2, 3, 4] and m.n_obs() == 24 and m.df_residual() == 22 and m.region_names() == REGIONS and m.n_regions() == 3
    assert m.formula() == "value ~ grp" and m.labels() == ["grp"] and m.variable_names() == ["Intercept", "grpb"]
    stats, out = m.corrected(n=20)
    assert stats.count() == 12 and m.summary(out).count() <= 3
    one = {r["region"]: r["stat"] for r in m.at(2.0).statistics().collect()}
    assert {r["region"]: r["stat"] for r in stats.where("tau = 2").collect()} == pytest.approx(one)


def test_residuals_and_correlations_as_objects(cohort):
    r = Residuals(cohort)
    assert r.n_obs() == 24 and r.case_names() == SIDS and r.region_names() == REGIONS and r.n_regions() == 3 and r.groups().count() == 24
    few = r.select(SIDS[:5], ["A"], ["ra"])
    assert few.y.count() == 5 and few.region_names() == ["ra"] and "observations" in r.report()
    assert r.summary().agg(F.sum("outliers")).first()[0] == r.outliers().count()
    c = r.correlations()
    c = type(c)(c.pairs, (0.4, 0.7))
    assert c.groups() == ["A", "B"] and c.region_names() == REGIONS and c.n_regions() == 3
    one = c.select(["B"], [1])
    assert one.groups() == ["B"] and one.densities == (0.7,) and {x["density"] for x in one.edges().collect()} == {0.7}
    assert "0.4" in c.report()
    d = S.permutation_summary(S.permute_groups(cohort, [0.5], 20), 20)
    assert "permutations" in permutation_report(d, 20)
    b = S.bootstrap_summary(S.bootstrap(cohort, [0.5], "Cp", 10))
    assert "A at 0.5" in bootstrap_report(b, "Cp", 10)
    assert "outlying" in contribution_report(S.contribution_summary(S.contribution_regional(S.loo_pairs(cohort))))
