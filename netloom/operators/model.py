"""Fitted linear models as objects: accessors, diagnostics and summaries over regions.

A model keeps the long outcome (region, sid, value), the study's covariates and the coding;
what it returns are DataFrames by region, computed where the regions are. What depends on the
design alone (terms, names, degrees of freedom) is on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import linear as L
from netloom.functions import text
from netloom.operators import glm as G


def _long(region: str, names: list[str], ids: list[str], cube: np.ndarray, value: str, by: str) -> pd.DataFrame:
    """(region, sid, by, value) of an (n, k) table."""
    return pd.DataFrame({"region": region, "sid": np.repeat(ids, len(names)), by: list(names) * len(ids), value: cube.ravel()})


@dataclass(frozen=True)
class LinearModel:
    y: DataFrame
    covars: pd.DataFrame
    contrasts: object = None
    kind: str = "t"
    alternative: str = "two.sided"
    alpha: float = 0.05
    names: list[str] | None = None
    coding: dict = field(default_factory=dict)
    outcome: str = "value"
    #: a covariate to explain by the measure, which then is a regressor: a design by region
    response: str | None = None

    # the design

    @property
    def _how(self) -> dict:
        return self.coding | ({"outcome": self.response, "measure": self.outcome} if self.response else {})

    @cached_property
    def _study(self) -> G.Study:
        return G.Study(self.covars, **self._how)

    @cached_property
    def design(self) -> L.Design:
        """Of all regions; with a response it has their columns, but stand-ins as measure."""
        return self._study.shared

    def case_names(self) -> list[str]:
        return self._study.sids

    def left_out(self) -> list[str]:
        return self._study.left_out

    def variable_names(self) -> list[str]:
        return list(self.design.columns)

    def terms(self) -> dict[str, list[str]]:
        """The design's columns by term; an explicit map, so no name is a prefix of another."""
        return {t: [self.design.columns[j] for j in js] for t, js in self.design.terms.items()}

    def labels(self) -> list[str]:
        return [t for t in self.design.terms if t != "Intercept"]

    def formula(self) -> str:
        return text.wrapped(f"{self.response or self.outcome} ~ " + " + ".join(self.labels() or ["1"]))

    def n_obs(self) -> int:
        return len(self.design.x)

    def df_residual(self) -> int:
        return self.n_obs() - self.design.x.shape[1]

    def region_names(self) -> list[str]:
        return [r["region"] for r in self.y.select("region").distinct().orderBy("region").collect()]  # an atlas

    def n_regions(self) -> int:
        return self.y.select("region").distinct().count()

    def contrast_names(self) -> list[str]:
        return L.contrast_list(self.contrasts, self.kind, self.design.x.shape[1], self.names)[1]

    def select(self, sids: list[str] | None = None, columns: list[str] | None = None) -> LinearModel:
        """The model of some subjects, or of some covariates."""
        c = self.covars if sids is None else self.covars[self.covars.sid.isin(sids)]
        c = c if columns is None else c[["sid", *columns]]
        return replace(self, covars=c)

    # by region

    def _each(self, fn, schema: str) -> DataFrame:
        """fn(region, fit) -> pandas table, for regions that have a fit."""
        study = self._study
        columns = [c.split()[0] for c in schema.split(", ")]

        def one(cell: pd.DataFrame) -> pd.DataFrame:
            made = study.of(G._vector(cell, study.sids))
            return pd.DataFrame(columns=columns) if made is None else fn(cell.region.iloc[0], L.fit(made[0].x, made[1]))[columns]

        return self.y.groupBy("region").applyInPandas(one, schema)

    def statistics(self) -> DataFrame:
        return G.glm(self.y, self.covars, self.contrasts, self.kind, self.alternative, self.alpha, self.names, **self._how)

    def coef(self) -> DataFrame:
        return self.coeff_table().select("region", "term", "estimate")

    def coef_se(self) -> DataFrame:
        return self.coeff_table().select("region", "term", "se")

    def confint(self, level: float = 0.95) -> DataFrame:
        return self.coeff_table(level).select("region", "term", "ci_low", "ci_high")

    def coeff_table(self, level: float = 0.95) -> DataFrame:
        return G.coefficients(self.y, self.covars, level, **self._how)

    def observations(self) -> DataFrame:
        return G.observations(self.y, self.covars, **self._how)

    def fitted(self) -> DataFrame:
        return self.observations().select("region", "sid", "fitted")

    def residuals(self, kind: str = "response") -> DataFrame:
        """(region, sid, resid), or (region, sid, term, resid) of partial residuals."""
        if kind == "response":
            return self.observations().select("region", "sid", "resid")
        terms = {t: js for t, js in self.design.terms.items() if t != "Intercept"}
        sids = self.case_names()
        return self._each(lambda r, f: _long(r, list(terms), sids, L.residuals(f, "partial", terms)[:, :, 0], "resid", "term"), "region string, sid string, term string, resid double")

    def rstandard(self, kind: str = "sd.1") -> DataFrame:
        sids = self.case_names()
        return self._each(lambda r, f: pd.DataFrame({"region": r, "sid": sids, "rstandard": L.rstandard(f, kind)[:, 0]}), "region string, sid string, rstandard double")

    def rstudent(self) -> DataFrame:
        return self.observations().select("region", "sid", "rstudent")

    def hatvalues(self) -> DataFrame:
        return self.observations().select("region", "sid", "hat")

    def cooks_distance(self) -> DataFrame:
        return self.observations().select("region", "sid", "cooks")

    def dffits(self) -> DataFrame:
        return self.observations().select("region", "sid", "dffits")

    def covratio(self) -> DataFrame:
        return self.observations().select("region", "sid", "covratio")

    def dfbeta(self, scaled: bool = False) -> DataFrame:
        """(region, sid, term, dfbeta): how coefficients change when a subject goes; scaled by
        their leave-one-out standard errors if asked for."""
        sids, columns, fn = self.case_names(), self.variable_names(), L.dfbetas if scaled else L.dfbeta
        return self._each(lambda r, f: _long(r, columns, sids, fn(f)[:, :, 0], "dfbeta", "term"), "region string, sid string, term string, dfbeta double")

    def influence(self) -> DataFrame:
        """Observations that any criterion flags."""
        flags = ("flag_dfb", "flag_dffit", "flag_cov_r", "flag_cook_d", "flag_hat")
        return self.observations().where(" or ".join(flags))

    def influence_wide(self) -> DataFrame:
        """The flagged observations with a column for each scaled coefficient change."""
        b = self.dfbeta(scaled=True).groupBy("region", "sid").pivot("term", self.variable_names()).agg(F.first("dfbeta"))
        return self.influence().join(b, ["region", "sid"])

    def fit_statistics(self) -> DataFrame:
        return G.fit_statistics(self.y, self.covars, **self._how)

    def deviance(self) -> DataFrame:
        return self.fit_statistics().select("region", "deviance")

    def sigma(self) -> DataFrame:
        return self.fit_statistics().select("region", "sigma")

    def coeff_determ(self, adjusted: bool = False) -> DataFrame:
        return self.fit_statistics().select("region", F.col("adj_r2" if adjusted else "r2").alias("r2"))

    def log_lik(self, reml: bool = False) -> DataFrame:
        return self.fit_statistics().select("region", F.col("log_lik_reml" if reml else "log_lik").alias("log_lik"))

    def extract_aic(self, k: float = 2.0) -> DataFrame:
        return self._each(lambda r, f: pd.DataFrame({"region": [r], "edf": [float(L.aic(f, k)[0])], "aic": [float(L.aic(f, k)[1][0])]}), "region string, edf double, aic double")

    def vcov(self) -> DataFrame:
        """(region, row, col, value) of the coefficients' covariance matrices."""
        columns = self.variable_names()
        p = len(columns)
        return self._each(lambda r, f: pd.DataFrame({"region": r, "row": np.repeat(columns, p), "col": columns * p, "value": L.vcov(f)[0].ravel()}), "region string, row string, col string, value double")

    def anova(self) -> DataFrame:
        return G.anova(self.y, self.covars, **self._how)

    def vif(self) -> pd.DataFrame:
        """term, gvif, df, gvif_scaled; of the design, so the same for all regions."""
        if self.response:
            raise ValueError("each region has its own design: use vif_by_region")
        return L.vif(self.design)

    def vif_by_region(self) -> DataFrame:
        d = self.design
        return self._each(lambda r, f: L.vif(replace(d, x=f.x)).assign(region=r), "region string, term string, gvif double, df long, gvif_scaled double")

    def permuted(self, n: int = 5000, method: str = "freedmanLane", part: str = "beckmann", seed: int = 0) -> DataFrame:
        """`statistics` with p_perm and the critical value of the largest statistic."""
        null = G.permutation_null(self.y, self.covars, self.contrasts, self.kind, method, part, n, seed, self.alternative, **self._how)
        return G.glm_permuted(self.statistics(), null, self.alternative if self.kind == "t" else "greater", self.alpha)

    def summary(self, p: str = "p", contrast: str | None = None, alpha: float | None = None, stats: DataFrame | None = None) -> DataFrame:
        """The significant rows by p, p_fdr or p_perm (for which give `permuted()` as stats)."""
        s = self.statistics() if stats is None else stats
        s = s.where(F.col("contrast") == contrast) if contrast else s
        return s.where(F.col(p) < (self.alpha if alpha is None else alpha)).orderBy("contrast", p, "region")

    def report(self) -> str:
        rows = {"formula": self.formula(), "observations": self.n_obs(), "left out": self.left_out(), "df": self.df_residual(), "regions": self.n_regions()}
        if self.contrasts is not None:
            items, names = L.contrast_list(self.contrasts, self.kind, self.design.x.shape[1], self.names)
            rows |= {f"{self.kind}-contrast {n}": "; ".join(" ".join(text.as_fractions(r)) for r in np.atleast_2d(c)) for n, c in zip(names, items)}
            rows["alternative"] = f"C {text.ALTERNATIVES[self.alternative]} 0"
        return text.report("Linear model", rows)


def stacked(models: dict[str, LinearModel]) -> DataFrame:
    """The statistics of several models, by name."""
    out = None
    for name, m in models.items():
        one = m.statistics().withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def mtpc_summary(results: DataFrame, contrast: str | None = None) -> DataFrame:
    """Significant regions of a multi-threshold correction, the largest statistic first."""
    r = results.where("significant")
    r = r.where(F.col("contrast") == contrast) if contrast else r
    return r.orderBy("contrast", F.desc(F.abs("s_mtpc")), "region")


def nbs_summary(components: DataFrame, alpha: float = 0.05, contrast: str | None = None) -> DataFrame:
    """Components of a network-based statistic up to a p-value, the largest first."""
    c = components.where(F.col("p") <= alpha)
    c = c.where(F.col("contrast") == contrast) if contrast else c
    return c.orderBy("contrast", F.desc("vertices"), "comp")


def mediation_summary(effects: DataFrame, region: str | None = None) -> DataFrame:
    """A row for each region: estimate, limits and p of the averaged effects side by side."""
    e = effects.where(F.col("region") == region) if region else effects
    pick = lambda k, c: F.max(F.when(F.col("effect") == k, F.col(c)))
    parts = {"acme": "d_avg", "ade": "z_avg", "total": "tau", "prop": "n_avg"}
    columns = [pick(k, c).alias(f"{name}_{c}") for name, k in parts.items() for c in ("estimate", "ci_low", "ci_high", "p")]
    return e.groupBy("region").agg(*columns)


def mediation_export(effects: DataFrame, region: str) -> dict[str, dict[str, float]]:
    """One region's effects as a dictionary: effect -> estimate, ci_low, ci_high, p."""
    rows = effects.where(F.col("region") == region).collect()  # one region: ten effects
    return {r["effect"]: {k: r[k] for k in ("estimate", "ci_low", "ci_high", "p")} for r in rows}
