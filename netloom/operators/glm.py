"""Mass-univariate linear models over regions, permutation inference, NBS, MTPC, mediation.

`y` is long: (region, sid, value). A study's covariates, design and contrasts are small (one
row a subject) and go to every task; regions are the parallel axis of fits, permutations
that of null distributions. Subjects with missing covariates or values are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import linear as L
from netloom.operators import kernels as K

STATS = "region string, contrast string, gamma double, se double, stat double, p double, ci_low double, ci_high double"
INFINITE = None


def _num(x):
    return None if x is None or not np.isfinite(x) else float(x)


def complete(covars: pd.DataFrame) -> tuple[pd.DataFrame, list[str]]:
    """Covariates without incomplete rows, ordered by sid, and who is left out."""
    ok = covars.dropna().sort_values("sid").reset_index(drop=True)
    return ok, sorted(set(covars.sid) - set(ok.sid))


class Study:
    """The complete covariates, and what makes a region's design and outcome of its values.
    Normally the values are the outcome and all regions share a design. With `outcome`, a
    covariate, that is explained instead and the values are a regressor, named `measure` and
    last of the numeric ones: so every region has a design of its own."""

    def __init__(self, covars: pd.DataFrame, outcome: str | None = None, measure: str = "value", **coding):
        self.ok, self.left_out = complete(covars)
        self.sids, self.outcome, self.measure, self.coding = self.ok.sid.tolist(), outcome, measure, coding
        self.own = self.ok.drop(columns=["sid", *([outcome] if outcome else [])])
        self.shared = self.design(np.arange(len(self.ok), dtype=float))

    def design(self, v: np.ndarray) -> L.Design:
        return L.design(self.own if self.outcome is None else self.own.assign(**{self.measure: v}), **self.coding)

    def of(self, v: np.ndarray) -> tuple[L.Design, np.ndarray] | None:
        """Design and outcome of a region; None if a value is missing or all are the same."""
        if not np.isfinite(v).all() or np.ptp(v) == 0:
            return None
        if self.outcome is None:
            return self.shared, v
        d = self.design(v)
        return (d, self.ok[self.outcome].to_numpy(float)) if np.linalg.matrix_rank(d.x) == d.x.shape[1] else None

    def stacked(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """X and Y over all regions' values (n, r): a design and the values, or designs
        (n, p, r) and the outcome."""
        values = values[:, np.isfinite(values).all(0)]
        if self.outcome is None:
            return self.shared.x, values
        return np.stack([self.design(v).x for v in values.T], 2) if values.size else np.zeros((*self.shared.x.shape, 0)), self.ok[self.outcome].to_numpy(float)


def _vector(cell: pd.DataFrame, sids: list[str]) -> np.ndarray:
    return cell.set_index("sid")["value"].reindex(sids).to_numpy(float)


def glm(y: DataFrame, covars: pd.DataFrame, contrasts, kind: str = "t", alternative: str = "two.sided", alpha: float = 0.05, names: list[str] | None = None, **coding) -> DataFrame:
    """region, contrast, gamma (F: ess), se, stat, p, p_fdr, ci_low, ci_high. Regions with a
    missing value, constant values or a singular design have NULL statistics. `outcome` and
    `measure` (in `coding`, as everywhere here): see Study."""
    study = Study(covars, **coding)
    items, names = L.contrast_list(contrasts, kind, study.shared.x.shape[1], names)

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        region, made, out = cell.region.iloc[0], study.of(_vector(cell, study.sids)), []
        f = made and L.fit(made[0].x, made[1])
        for c, name in zip(items, names):
            if f is None:
                out.append((region, name, *[None] * 6))
                continue
            s = L.t_test(f, c, alternative, alpha) if kind == "t" else L.f_test(f, c)
            out.append((region, name, *(_num(s[k][0]) for k in ("gamma" if kind == "t" else "ess", "se", "stat", "p", "ci_low", "ci_high"))))
        return pd.DataFrame(out, columns=[x.split()[0] for x in STATS.split(", ")])

    from netloom.operators.local import bh_adjust

    return bh_adjust(y.groupBy("region").applyInPandas(one, STATS), "p", ("contrast",))


def coefficients(y: DataFrame, covars: pd.DataFrame, level: float = 0.95, **coding) -> DataFrame:
    """region, term, estimate, se, ci_low, ci_high, t, p."""
    study = Study(covars, **coding)
    columns = ["region", "term", "estimate", "se", "ci_low", "ci_high", "t", "p"]

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        made = study.of(_vector(cell, study.sids))
        if made is None:
            return pd.DataFrame(columns=columns)
        d, f = made[0], L.fit(made[0].x, made[1])
        se = L.coef_se(f)[:, 0]
        lo, hi = L.confint(f, level)
        t = f.beta[:, 0] / se
        return pd.DataFrame({"region": cell.region.iloc[0], "term": d.columns, "estimate": f.beta[:, 0], "se": se, "ci_low": lo[:, 0], "ci_high": hi[:, 0], "t": t, "p": 2 * L.dist.t_sf(np.abs(t), f.df)})

    return y.groupBy("region").applyInPandas(one, "region string, term string, estimate double, se double, ci_low double, ci_high double, t double, p double")


def observations(y: DataFrame, covars: pd.DataFrame, **coding) -> DataFrame:
    """region, sid, fitted, resid, hat, rstandard, rstudent, cooks, dffits, covratio and the
    influence flags."""
    study = Study(covars, **coding)
    values = ("fitted", "resid", "hat", "rstandard", "rstudent", "cooks", "dffits", "covratio")
    flags = ("dfb", "dffit", "cov_r", "cook_d", "hat")

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        made = study.of(_vector(cell, study.sids))
        if made is None:
            return pd.DataFrame(columns=["region", "sid", *values, *("flag_" + k for k in flags)])
        f = L.fit(made[0].x, made[1])
        v = (f.fitted, f.resid, L.hat_values(f), L.rstandard(f), L.rstudent(f), L.cooks(f), L.dffits(f), L.covratio(f))
        w = L.influence_flags(f)
        out = pd.DataFrame({"region": cell.region.iloc[0], "sid": study.sids} | {k: x[:, 0] for k, x in zip(values, v)})
        for k in flags:
            out["flag_" + k] = w[k][:, 0]
        return out

    return y.groupBy("region").applyInPandas(one, "region string, sid string, " + ", ".join(f"{k} double" for k in values) + ", " + ", ".join(f"flag_{k} boolean" for k in flags))


def fit_statistics(y: DataFrame, covars: pd.DataFrame, **coding) -> DataFrame:
    """region, sigma, deviance, r2, adj_r2, log_lik, log_lik_reml, aic, df."""
    study = Study(covars, **coding)
    columns = ["region", "sigma", "deviance", "r2", "adj_r2", "log_lik", "log_lik_reml", "aic", "df"]

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        made = study.of(_vector(cell, study.sids))
        if made is None:
            return pd.DataFrame(columns=columns)
        f = L.fit(made[0].x, made[1])
        row = (f.sigma, L.deviance(f), L.r_squared(f), L.r_squared(f, True), L.log_lik(f), L.log_lik(f, True), L.aic(f)[1])
        return pd.DataFrame([(cell.region.iloc[0], *(float(x[0]) for x in row), f.df)], columns=columns)

    return y.groupBy("region").applyInPandas(one, "region string, sigma double, deviance double, r2 double, adj_r2 double, log_lik double, log_lik_reml double, aic double, df int")


def anova(y: DataFrame, covars: pd.DataFrame, **coding) -> DataFrame:
    study = Study(covars, **coding)
    columns = ("sum_sq", "mean_sq", "df", "f", "eta_sq", "partial_eta_sq", "omega_sq", "partial_omega_sq", "p")

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        made = study.of(_vector(cell, study.sids))
        if made is None:
            return pd.DataFrame(columns=["region", "term", *columns])
        t = L.anova3(*made)
        t.insert(0, "region", cell.region.iloc[0])
        return t.astype({c: float for c in columns}).replace({np.nan: None})

    return y.groupBy("region").applyInPandas(one, "region string, term string, " + ", ".join(f"{c} double" for c in columns))


def _chunks(spark, n: int, size: int) -> DataFrame:
    """Permutation numbers 0 .. n-1, dealt in chunks to tasks."""
    return spark.range(0, n, 1, max(1, -(-n // size)))


def _order(seed: int, perm: int, n: int, identity_last: int | None) -> np.ndarray:
    return np.arange(n) if perm == identity_last else np.random.default_rng([seed, perm]).permutation(n)


def collected(y: DataFrame, sids: list[str]) -> tuple[list[str], np.ndarray]:
    """Regions and the (n, regions) outcome matrix: a study's table, subjects by regions (an
    atlas), is what every permutation needs whole."""
    rows = y.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("sid", "value"))).alias("m")).orderBy("region").collect()
    return [r["region"] for r in rows], np.array([[r["m"].get(s, np.nan) for s in sids] for r in rows], float).T


def permutation_null(y: DataFrame, covars: pd.DataFrame, contrasts, kind: str = "t", method: str = "freedmanLane", part: str = "beckmann", n: int = 5000, seed: int = 0, alternative: str = "two.sided", perms: np.ndarray | None = None, chunk: int = 250, **coding) -> DataFrame:
    """contrast, perm_id, extreme: the maximum statistic over regions of each permutation."""
    spark = y.sparkSession
    study = Study(covars, **coding)
    items, names = L.contrast_list(contrasts, kind, study.shared.x.shape[1])
    shared = spark.sparkContext.broadcast((*study.stacked(collected(y, study.sids)[1]), items, names, perms))
    n = n if perms is None else len(perms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, v, items, names, perms = shared.value
        made = [L.randomiser(x, v, c, kind, method, part) for c in items]
        for b in batches:
            out = []
            for p in b.id.tolist():
                order = perms[p] if perms is not None else _order(seed, p, len(x), None)
                out += [(name, p, _num(L.extreme(r(order), alternative if kind == "t" else "greater"))) for r, name in zip(made, names)]
            yield pd.DataFrame(out, columns=["contrast", "perm_id", "extreme"])

    return _chunks(spark, n, chunk).mapInPandas(run, "contrast string, perm_id long, extreme double")


def glm_permuted(stats: DataFrame, null: DataFrame, alternative: str = "two.sided", alpha: float = 0.05) -> DataFrame:
    """stats with p_perm = (extremes at least as large + 1) / (N + 1), and the critical value
    at index floor((1 - alpha) N) + 1 of the sorted extremes."""
    x = F.abs("stat") if alternative == "two.sided" else F.col("stat")
    worse = F.col("extreme") <= F.col("x") if alternative == "less" else F.col("extreme") >= F.col("x")
    s = stats.withColumn("x", x)
    ext = F.sort_array(F.collect_list("extreme"), asc=alternative != "less")
    crit = null.groupBy("contrast").agg(F.count("extreme").alias("n"), ext.alias("e"))
    crit = crit.select("contrast", "n", F.element_at("e", F.least(F.floor((1 - alpha) * F.col("n")) + 1, F.col("n")).cast("int")).alias("critical"))
    counts = s.join(null, "contrast").groupBy("contrast", "region").agg(F.sum(worse.cast("int")).alias("b"))
    out = s.drop("x").join(counts, ["contrast", "region"], "left").join(crit, "contrast")
    return out.withColumn("p_perm", F.when(F.col("stat").isNotNull(), (F.col("b") + 1) / (F.col("n") + 1))).drop("b", "n")


def nbs_components(edges: DataFrame) -> DataFrame:
    """(contrast, perm_id, src, dst) -> contrast, perm_id, comp, vertices, edges: components
    of suprathreshold edges; a component's size is its number of vertices."""

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        vs = np.unique(np.concatenate([cell.src, cell.dst]))
        a = np.zeros((len(vs), len(vs)))
        i, j = np.searchsorted(vs, cell.src), np.searchsorted(vs, cell.dst)
        a[i, j] = a[j, i] = 1
        label = K.components(a)
        return pd.DataFrame([(cell.contrast.iloc[0], cell.perm_id.iloc[0], int(c), int((label == c).sum()), int((label[i] == c).sum())) for c in np.unique(label)], columns=["contrast", "perm_id", "comp", "vertices", "edges"])

    return edges.groupBy("contrast", "perm_id").applyInPandas(one, "contrast string, perm_id long, comp int, vertices int, edges int")


def nbs(pairs: DataFrame, covars: pd.DataFrame, contrasts, kind: str = "t", p_init: float = 0.001, method: str = "freedmanLane", part: str = "beckmann", n: int = 1000, seed: int = 0, alternative: str = "two.sided", perms: np.ndarray | None = None, f_half: bool = True, **coding) -> tuple[DataFrame, DataFrame]:
    """Network-based statistic of pairs (sid, i < j, w). Returns the observed components
    (contrast, comp, vertices, edges, p) and the suprathreshold edges (contrast, src, dst,
    stat). All-zero pairs are dropped. `f_half`: the null of F contrasts uses p_init / 2."""
    spark = pairs.sparkSession
    live = pairs.groupBy("i", "j").agg(F.sum(F.abs("w")).alias("s")).where("s > 0").select("i", "j")
    y = pairs.join(live, ["i", "j"]).select(F.format_string("%06d-%06d", "i", "j").alias("region"), "sid", F.col("w").alias("value"))
    ok, _ = complete(covars)
    d = L.design(ok.drop(columns="sid"), **coding)
    items, names = L.contrast_list(contrasts, kind, d.x.shape[1])
    ids = F.split("region", "-")
    stats = glm(y, covars, contrasts, kind, alternative, **coding).where(F.col("p") < p_init)
    edges = stats.select("contrast", ids[0].cast("int").alias("src"), ids[1].cast("int").alias("dst"), "stat")
    regions, values = collected(y, ok.sid.tolist())
    shared = spark.sparkContext.broadcast((d.x, values, items, names, perms, [tuple(map(int, r.split("-"))) for r in regions]))
    n = n if perms is None else len(perms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, v, items, names, perms, ends = shared.value
        made = [L.Randomiser(x, v, c, kind, method, part) for c in items]
        src, dst = np.array([a for a, _ in ends]), np.array([b for _, b in ends])
        for b in batches:
            out = []
            for p in b.id.tolist():
                order = perms[p] if perms is not None else _order(seed, p, len(x), None)
                for r, name in zip(made, names):
                    s = r(order)
                    if kind == "t":
                        pv = {"two.sided": lambda: 2 * L.dist.t_sf(np.abs(s), r.df), "less": lambda: L.dist.t_cdf(s, r.df), "greater": lambda: L.dist.t_sf(s, r.df)}[alternative]()
                        hit = pv < p_init
                    else:
                        hit = L.dist.f_sf(s, r.rank, r.df) < (p_init / 2 if f_half else p_init)
                    largest = 0
                    if hit.any():
                        vs = np.unique(np.concatenate([src[hit], dst[hit]]))
                        a = np.zeros((len(vs), len(vs)))
                        a[np.searchsorted(vs, src[hit]), np.searchsorted(vs, dst[hit])] = 1
                        largest = int(np.bincount(K.components(a)).max())
                    out.append((name, p, largest))
            yield pd.DataFrame(out, columns=["contrast", "perm_id", "largest"])

    null = _chunks(spark, n, 100).mapInPandas(run, "contrast string, perm_id long, largest int")
    found = nbs_components(edges.withColumn("perm_id", F.lit(-1).cast("long")))
    counted = found.join(null, "contrast").groupBy("contrast", "comp", "vertices", "edges").agg(((F.sum((F.col("largest") >= F.col("vertices")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))
    return counted, edges


def qualifying_area(stats: DataFrame, keys: tuple[str, ...], clust: int, alternative: str = "two.sided") -> DataFrame:
    """keys, area: summed |trapezoid| areas under the statistic over runs of `clust` or more
    consecutive thresholds at which it is beyond `crit`. stats: keys, tau, stat, crit."""
    beyond = {"two.sided": F.abs("stat") > F.col("crit"), "greater": F.col("stat") > F.col("crit"), "less": F.col("stat") < F.col("crit")}[alternative]
    w = Window.partitionBy(*keys).orderBy("tau")
    rows = stats.withColumn("n", F.row_number().over(w)).withColumn("ok", beyond)
    rows = rows.where("ok").withColumn("run", F.col("n") - F.row_number().over(w))
    inside = Window.partitionBy(*keys, "run").orderBy("tau")
    rows = rows.withColumn("part", (F.col("tau") - F.lag("tau").over(inside)) * (F.col("stat") + F.lag("stat").over(inside)) / 2)
    areas = rows.groupBy(*keys, "run").agg(F.abs(F.sum("part")).alias("a"), F.count("*").alias("length")).where(F.col("length") >= clust)
    return areas.groupBy(*keys).agg(F.sum("a").alias("area"))


def mtpc(y: DataFrame, covars: pd.DataFrame, contrasts, kind: str = "t", clust: int = 3, method: str = "freedmanLane", part: str = "beckmann", n: int = 500, seed: int = 0, alternative: str = "two.sided", alpha: float = 0.05, **coding) -> tuple[DataFrame, DataFrame]:
    """Multi-threshold permutation correction of y (tau, region, sid, value). Returns the
    statistics by threshold (contrast, region, tau, stat, crit) and the results (contrast,
    region, a_mtpc, a_crit, tau_mtpc, s_mtpc, significant). All thresholds share the
    permutations and run in one pass."""
    spark = y.sparkSession
    study = Study(covars, **coding)
    items, names = L.contrast_list(contrasts, kind, study.shared.x.shape[1])

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        made, out = study.of(_vector(cell, study.sids)), []
        if made is not None:
            f = L.fit(made[0].x, made[1])
            out = [(cell.tau.iloc[0], cell.region.iloc[0], name, _num((L.t_test(f, c, alternative) if kind == "t" else L.f_test(f, c))["stat"][0])) for c, name in zip(items, names)]
        return pd.DataFrame(out, columns=["tau", "region", "contrast", "stat"])

    stats = y.groupBy("tau", "region").applyInPandas(one, "tau double, region string, contrast string, stat double")
    cells = y.groupBy("tau", "region").agg(F.map_from_entries(F.collect_list(F.struct("sid", "value"))).alias("m")).orderBy("tau", "region").collect()  # thresholds x regions x subjects
    by_tau: dict[float, list[np.ndarray]] = {}
    for r in cells:
        by_tau.setdefault(r["tau"], []).append(np.array([r["m"].get(s, np.nan) for s in study.sids], float))
    blocks = {t: np.array([v for v in vs if np.isfinite(v).all()]).T for t, vs in by_tau.items()}
    shared = spark.sparkContext.broadcast(({t: study.stacked(b) for t, b in blocks.items() if b.size}, items, names))

    n_obs = len(study.sids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, items, names = shared.value
        made = {(t, name): L.randomiser(x, v, c, kind, method, part) for t, (x, v) in blocks.items() for c, name in zip(items, names)}
        for b in batches:
            out = []
            for p in b.id.tolist():
                order = _order(seed, p, n_obs, None)
                out += [(name, p, t, _num(L.extreme(r(order), alternative if kind == "t" else "greater"))) for (t, name), r in made.items()]
            yield pd.DataFrame(out, columns=["contrast", "perm_id", "tau", "stat"])

    null = _chunks(spark, n, 25).mapInPandas(run, "contrast string, perm_id long, tau double, stat double")
    worst = F.min("stat") if alternative == "less" else F.max("stat")
    ext = null.groupBy("contrast", "perm_id").agg(worst.alias("e")).groupBy("contrast").agg(F.sort_array(F.collect_list("e"), asc=alternative != "less").alias("e"))
    crit = ext.select("contrast", F.element_at("e", F.least(F.floor((1 - alpha) * F.size("e")) + 1, F.size("e")).cast("int")).alias("crit"))
    area = qualifying_area(null.join(crit, "contrast"), ("contrast", "perm_id"), clust, alternative)
    a_crit = area.groupBy("contrast").agg(F.avg("area").alias("a_crit"))
    with_crit = stats.join(crit, "contrast")
    a = qualifying_area(with_crit, ("contrast", "region"), clust, alternative)
    key = F.abs("stat") if alternative == "two.sided" else -F.col("stat") if alternative == "less" else F.col("stat")
    top = stats.groupBy("contrast", "region").agg(F.max(F.struct(key.alias("k"), (-F.col("tau")).alias("t"), "stat")).alias("m")).select("contrast", "region", (-F.col("m.t")).alias("tau_mtpc"), F.col("m.stat").alias("s_mtpc"))
    out = top.join(a.withColumnRenamed("area", "a_mtpc"), ["contrast", "region"], "left").join(a_crit, "contrast", "left")
    return with_crit, out.withColumn("significant", F.coalesce(F.col("a_mtpc") > F.col("a_crit"), F.lit(False)))


def mediation(y: DataFrame, covars: pd.DataFrame, outcome: str, treat: str, covar_names: tuple[str, ...] = (), control=0.0, treated=1.0, interaction: bool = False, n: int = 1000, level: float = 0.95, ci: str = "perc", seed: int = 0, boot: bool = True) -> DataFrame:
    """Mediation of treat -> outcome by each region's measure: region, effect, estimate,
    ci_low, ci_high, p. Bootstrap refits; limits are percentiles or BCa. The observed row has
    no noise; draws add normal noise to the mediator's predictions."""
    ok, _ = complete(covars[["sid", outcome, treat, *covar_names]])
    d = L.design(ok[list(covar_names)]) if covar_names else L.Design(np.ones((len(ok), 1)), ["Intercept"])
    t, target, sids = ok[treat].to_numpy(float), ok[outcome].to_numpy(float), ok.sid.tolist()

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        region, m = cell.region.iloc[0], _vector(cell, sids)
        if not np.isfinite(m).all():
            return pd.DataFrame(columns=["region", "effect", "estimate", "ci_low", "ci_high", "p"])

        def effects(rows, rng=None):
            z, tt, mm = d.x[rows], t[rows], m[rows]
            xm = np.column_stack([z, tt])
            xy = np.column_stack([z, tt, mm, *([tt * mm] if interaction else [])])
            k = z.shape[1]
            noise = None
            if rng is not None:
                e = mm - xm @ np.linalg.lstsq(xm, mm, rcond=None)[0]
                noise = rng.normal(0, np.sqrt((e**2).sum() / max(len(rows) - k - 1, 1)), len(rows))
            return L.mediate(xm, mm, xy, target[rows], k, k + 1, k + 2 if interaction else None, control, treated, noise)

        seen = effects(np.arange(len(t)))
        rng = np.random.default_rng([seed, *region.encode()])
        draws = pd.DataFrame([effects(rng.integers(0, len(t), len(t)), rng) for _ in range(n)]) if boot else None
        out = []
        for k, v in seen.items():
            lo = hi = p = None
            if draws is not None:
                x = draws[k].dropna().to_numpy()
                lo, hi = L.bca(x, level) if ci == "bca" else tuple(L.dist.quantile7(x, [(1 - level) / 2, (1 + level) / 2]))
                p = L.boot_p(v, x)
            out.append((region, k, _num(v), lo, hi, p))
        return pd.DataFrame(out, columns=["region", "effect", "estimate", "ci_low", "ci_high", "p"])

    return y.groupBy("region").applyInPandas(one, "region string, effect string, estimate double, ci_low double, ci_high double, p double")
