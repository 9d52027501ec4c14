"""Results as objects: network-based statistics, multi-threshold corrections, residuals and
correlations. Each keeps what it was made of, answers what a model answers (observations,
terms, names), selects, summarises and reports.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import text
from netloom.operators import covariance as S
from netloom.operators import glm as G
from netloom.operators.model import LinearModel, mtpc_summary, nbs_summary


def _values(df: DataFrame, column: str) -> list:
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]  # an atlas, or groups


@dataclass(frozen=True)
class NetworkStatistic(LinearModel):
    """A linear model of every pair's weight, and its components. `y` holds the pairs as
    (sid, i, j, w); the accessors are those of the model."""

    outcome: str = "weight"

    def region_names(self) -> list[str]:
        return sorted({*_values(self.y, "i"), *_values(self.y, "j")})

    def n_regions(self) -> int:
        return len(self.region_names())

    def statistics(self) -> DataFrame:
        """The model's statistics of the pairs with any weight."""
        live = self.y.groupBy("i", "j").agg(F.sum(F.abs("w")).alias("s")).where("s > 0").select("i", "j")
        rows = self.y.join(live, ["i", "j"]).select(F.format_string("%06d-%06d", "i", "j").alias("region"), "sid", F.col("w").alias("value"))
        return replace_rows(self, rows).statistics()

    def components(self, p_init: float = 0.001, n: int = 1000, seed: int = 0, method: str = "freedmanLane", part: str = "beckmann") -> tuple[DataFrame, DataFrame]:
        """(contrast, comp, vertices, edges, p) and the suprathreshold edges."""
        return G.nbs(self.y, self.covars, self.contrasts, self.kind, p_init, method, part, n, seed, self.alternative, **self.coding)

    def summary(self, found: DataFrame, alpha: float = 0.05, contrast: str | None = None) -> DataFrame:
        return nbs_summary(found, alpha, contrast)


@dataclass(frozen=True)
class ThresholdModel(LinearModel):
    """A linear model at every threshold, corrected over all. `y`: (tau, region, sid, value)."""

    def at(self, tau: float) -> LinearModel:
        return replace_rows(self, self.y.where(F.col("tau") == tau).drop("tau"))

    def taus(self) -> list[float]:
        return _values(self.y, "tau")

    def corrected(self, clust: int = 3, n: int = 500, seed: int = 0, method: str = "freedmanLane", part: str = "beckmann") -> tuple[DataFrame, DataFrame]:
        """Statistics by threshold, and the areas with their critical value by region."""
        return G.mtpc(self.y, self.covars, self.contrasts, self.kind, clust, method, part, n, seed, self.alternative, self.alpha, **self._how)

    def summary(self, results: DataFrame, contrast: str | None = None) -> DataFrame:
        return mtpc_summary(results, contrast)


def replace_rows(m: LinearModel, y: DataFrame) -> LinearModel:
    """The plain model of other rows."""
    return LinearModel(y, m.covars, m.contrasts, m.kind, m.alternative, m.alpha, m.names, m.coding, m.outcome, m.response)


@dataclass(frozen=True)
class Residuals:
    """grp, sid, region, value: a table of residuals (or of measures) by group."""

    y: DataFrame

    def case_names(self) -> list[str]:
        return _values(self.y, "sid")

    def n_obs(self) -> int:
        return self.y.select("sid").distinct().count()

    def groups(self) -> DataFrame:
        """sid, grp."""
        return self.y.select("sid", "grp").distinct()

    def region_names(self) -> list[str]:
        return _values(self.y, "region")

    def n_regions(self) -> int:
        return self.y.select("region").distinct().count()

    def select(self, sids: list[str] | None = None, groups: list[str] | None = None, regions: list[str] | None = None) -> Residuals:
        y = self.y
        for column, keep in (("sid", sids), ("grp", groups), ("region", regions)):
            y = y if keep is None else y.where(F.col(column).isin(keep))
        return Residuals(y)

    def outliers(self, threshold: float = 2.0, per_region: bool = False) -> DataFrame:
        return S.residual_outliers(self.y, threshold, per_region)

    def summary(self, threshold: float = 2.0) -> DataFrame:
        """region, outliers: how many rows of a region stand out."""
        return self.outliers(threshold).groupBy("region").agg(F.count("*").alias("outliers"))

    def correlations(self, kind: str = "pearson") -> Correlations:
        return Correlations(S.correlation_p(S.correlations(self.y, kind)))

    def report(self) -> str:
        return text.report("Residuals", {"observations": self.n_obs(), "groups": _values(self.y, "grp"), "regions": self.n_regions(), "outliers": self.outliers().count()})


@dataclass(frozen=True)
class Correlations:
    """grp, r1, r2, n, r, p of all pairs, with the densities or cut-offs to take graphs at."""

    pairs: DataFrame
    densities: tuple[float, ...] = ()
    thresholds: tuple[float, ...] = ()

    def groups(self) -> list[str]:
        return _values(self.pairs, "grp")

    def region_names(self) -> list[str]:
        return sorted({*_values(self.pairs, "r1"), *_values(self.pairs, "r2")})

    def n_regions(self) -> int:
        return len(self.region_names())

    def select(self, groups: list[str] | None = None, at: list[int] | None = None) -> Correlations:
        """Some groups, and the densities or cut-offs of some positions (from 0)."""
        p = self.pairs if groups is None else self.pairs.where(F.col("grp").isin(groups))
        pick = lambda xs: xs if at is None else tuple(xs[k] for k in at if k < len(xs))
        return Correlations(p, pick(self.densities), pick(self.thresholds))

    def edges(self) -> DataFrame:
        """The kept pairs of every group and density (or cut-off)."""
        made = lambda name, xs: self.pairs.sparkSession.createDataFrame([(float(x),) for x in xs], f"{name} double") if xs else None
        return S.correlation_edges(self.pairs.drop("p"), made("density", self.densities), made("tau", self.thresholds))

    def report(self) -> str:
        return text.report("Correlations", {"groups": self.groups(), "regions": self.n_regions(), "densities": list(self.densities), "cut-offs": list(self.thresholds)})


def permutation_report(summary: DataFrame, n: int, alternative: str = "two.sided", alpha: float = 0.05) -> str:
    """What a permutation of groups found: how many of the differences are significant."""
    c = summary.agg(F.count("*").alias("all"), F.sum((F.col("p") < alpha).cast("int")).alias("some")).first()
    return text.report("Permutation of groups", {"permutations": n, "alternative": f"A - B {text.ALTERNATIVES[alternative]} 0", "differences": c["all"], f"with p < {alpha}": c["some"] or 0})


def bootstrap_report(summary: DataFrame, measure: str, n: int, level: float = 0.95) -> str:
    """One line for each group and density of a bootstrap's summary."""
    rows = summary.orderBy("grp", "density").collect()  # groups x densities
    numbers = [c for c, t in summary.dtypes if t == "double" and c != "density"]
    lines = {f"{r['grp']} at {r['density']:g}": ", ".join(f"{c} {r[c]:.4g}" for c in numbers if r[c] is not None) for r in rows}
    return text.report("Bootstrap", {"measure": text.measure_label(measure), "draws": n, "level": level} | lines)


def contribution_report(summary: DataFrame, method: str = "leaving one out") -> str:
    """Regions with outlying subjects in a summary of individual contributions."""
    c = summary.agg(F.countDistinct("region").alias("regions"), F.sum("outliers").alias("outliers"), F.max("mean").alias("top")).first()
    return text.report("Individual contributions", {"method": method, "regions": c["regions"], "outlying contributions": c["outliers"] or 0, "largest mean": c["top"]})
