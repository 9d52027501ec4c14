"""Linear-model numerics on small arrays: designs, fits, contrasts, partitions, permutation
statistics, diagnostics. X is (n, p), or (n, p, r) with a design for each region; Y is
(n, r). No Spark in here; the operators run these on blocks of regions or permutations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from netloom.functions import dist

# designs


@dataclass(frozen=True)
class Design:
    """A design matrix with its column names and which columns each term owns."""

    x: np.ndarray
    columns: list[str]
    terms: dict[str, list[int]] = field(default_factory=dict)


def design(
    covars: pd.DataFrame,
    coding: str = "dummy",
    binarize: tuple[str, ...] = (),
    interactions: tuple[str, ...] = (),
    center: bool = False,
    center_by: str | None = None,
    factors: tuple[str, ...] | None = None,
) -> Design:
    """Intercept, numeric columns in their order, coded factors (levels in lexical order),
    and all 2-way products of `interactions` (and the 3-way one, of exactly three).

    coding: dummy (first level 0), effects (first level -1), cell.means (a column for each
    level of the factors, no intercept). `binarize` turns factors into level number - 1.
    Centring is on the grand mean, or on the means within `center_by`.
    """
    if coding not in ("dummy", "effects", "cell.means"):
        raise ValueError(f"unknown coding {coding!r}")
    kind = {c: pd.api.types.is_numeric_dtype(covars[c]) and not pd.api.types.is_bool_dtype(covars[c]) for c in covars}
    numeric = [c for c in covars if kind[c] and not (factors and c in factors)]
    coded = [c for c in covars if c not in numeric]
    parts: dict[str, tuple[list[str], np.ndarray]] = {}
    for c in numeric:
        v = covars[c].astype(float)
        if center:
            v = v - (v.groupby(covars[center_by]).transform("mean") if center_by else v.mean())
        parts[c] = [c], v.to_numpy()[:, None]
    for c in coded:
        values = covars[c].astype(str)
        levels = sorted(values.unique())
        if c in binarize:
            parts[c] = [c], values.map({x: i for i, x in enumerate(levels)}).to_numpy(float)[:, None]
            continue
        one = np.column_stack([(values == x).to_numpy(float) for x in levels])
        if coding == "cell.means":
            parts[c] = [c + x for x in levels], one
        else:
            parts[c] = [c + x for x in levels[1:]], one[:, 1:] - (one[:, :1] if coding == "effects" else 0)
    keys = [k for k in numeric] + [k for k in coded]
    groups = list(interactions)
    if set(groups) - set(keys):
        raise ValueError("interactions are of covariates")
    products = [(a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]] + ([tuple(groups)] if len(groups) == 3 else [])
    dropped: set[str] = set()
    blocks: list[tuple[str, list[str], np.ndarray]] = []
    for combo in products:
        names, m = parts[combo[0]]
        for k in combo[1:]:
            more, z = parts[k]
            names = [f"{a}:{b}" for a in names for b in more]
            m = (m[:, :, None] * z[:, None, :]).reshape(len(m), -1)
        if coding == "cell.means":
            dropped |= {k for k in combo if k in coded and k not in binarize}
        blocks.append((":".join(combo), names, m))
    out, columns, terms = [], [], {}
    if coding != "cell.means" or not [k for k in coded if k not in binarize]:
        out.append(np.ones((len(covars), 1)))
        columns.append("Intercept")
        terms["Intercept"] = [0]
    for name, names, m in [*((k, *parts[k]) for k in keys if k not in dropped), *blocks]:
        terms[name] = list(range(len(columns), len(columns) + len(names)))
        columns += names
        out.append(m)
    return Design(np.hstack(out), columns, terms)


# fits


@dataclass(frozen=True)
class Fit:
    """Fits of r regions. NaN where a region's design is singular."""

    x: np.ndarray
    beta: np.ndarray  # p x r
    sigma: np.ndarray  # r
    fitted: np.ndarray  # n x r
    resid: np.ndarray
    cov: np.ndarray  # p x p, or r x p x p with a design for each region
    df: int
    rank: int

    def cov_of(self, r: int) -> np.ndarray:
        return self.cov if self.cov.ndim == 2 else self.cov[r]


def inv_crossprod(x: np.ndarray) -> np.ndarray:
    """(X'X)^-1 by Cholesky."""
    c = np.linalg.inv(np.linalg.cholesky(x.T @ x))
    return c.T @ c


def pinv(x: np.ndarray) -> np.ndarray:
    return np.linalg.solve(x.T @ x, x.T)


def fit(x: np.ndarray, y: np.ndarray) -> Fit:
    """Least squares by QR: all regions at once for a common design, one by one for 3-D X."""
    y = y[:, None] if y.ndim == 1 else y
    if x.ndim == 2:
        n, p = x.shape
        if np.linalg.matrix_rank(x) < p:
            raise ValueError("the design is singular")
        q, r = np.linalg.qr(x)
        beta = np.linalg.solve(r, q.T @ y)
        fitted = x @ beta
        ri = np.linalg.inv(r)
        e = y - fitted
        return Fit(x, beta, np.sqrt((e**2).sum(0) / (n - p)), fitted, e, ri @ ri.T, n - p, p)
    n, p, regions = x.shape
    y = np.repeat(y, regions, 1) if y.shape[1] == 1 else y
    beta, sigma, fitted, cov = np.full((p, regions), np.nan), np.full(regions, np.nan), np.full((n, regions), np.nan), np.full((regions, p, p), np.nan)
    for k in range(regions):
        if np.isfinite(x[:, :, k]).all() and np.linalg.matrix_rank(x[:, :, k]) == p:
            f = fit(x[:, :, k], y[:, k])
            beta[:, k], sigma[k], fitted[:, k], cov[k] = f.beta[:, 0], f.sigma[0], f.fitted[:, 0], f.cov
    return Fit(x, beta, sigma, fitted, y - fitted, cov, n - p, p)


def contrast_list(contrasts, kind: str, p: int, names: list[str] | None = None) -> tuple[list[np.ndarray], list[str]]:
    """Contrasts as named matrices: t rows become one matrix each, F takes matrices whole."""
    if kind not in ("t", "f"):
        raise ValueError("contrasts are t or f")
    if isinstance(contrasts, dict):
        names, contrasts = names or list(contrasts), list(contrasts.values())
    items = contrasts if isinstance(contrasts, list) and np.ndim(contrasts[0]) == 2 else [np.atleast_2d(np.asarray(contrasts, float))]
    items = [np.atleast_2d(np.asarray(c, float)) for c in items]
    if kind == "t":
        items = [row[None] for c in items for row in c]
    if any(c.shape[1] != p for c in items):
        raise ValueError(f"contrasts have {p} columns")
    return items, names or [f"Contrast {i + 1}" for i in range(len(items))]


def t_test(f: Fit, contrast: np.ndarray, alternative: str = "two.sided", alpha: float = 0.05) -> dict[str, np.ndarray]:
    c = np.asarray(contrast, float).ravel()
    gamma = c @ f.beta
    scale = np.array([c @ f.cov_of(r) @ c for r in range(f.beta.shape[1])]) if f.cov.ndim == 3 else c @ f.cov @ c
    se = f.sigma * np.sqrt(scale)
    with np.errstate(all="ignore"):
        stat = gamma / se
    p = {"two.sided": lambda t: 2 * dist.t_sf(np.abs(t), f.df), "less": lambda t: dist.t_cdf(t, f.df), "greater": lambda t: dist.t_sf(t, f.df)}[alternative](stat)
    half = dist.t_ppf(1 - alpha / 2, f.df) * se
    return {"gamma": gamma, "se": se, "stat": stat, "p": p, "p_fdr": dist.bh(p), "ci_low": gamma - half, "ci_high": gamma + half}


def f_test(f: Fit, contrast: np.ndarray) -> dict[str, np.ndarray]:
    c = np.atleast_2d(contrast)
    rank = np.linalg.matrix_rank(c)
    g = c @ f.beta
    regions = f.beta.shape[1]
    if f.cov.ndim == 2:
        ess = np.einsum("ir,ij,jr->r", g, np.linalg.inv(c @ f.cov @ c.T), g)
    else:
        ess = np.array([g[:, r] @ np.linalg.inv(c @ f.cov[r] @ c.T) @ g[:, r] if np.isfinite(f.sigma[r]) else np.nan for r in range(regions)])
    with np.errstate(all="ignore"):
        stat = ess / rank / f.sigma**2
    p = dist.f_sf(stat, rank, f.df)
    return {"ess": ess, "se": f.sigma**2 * f.df, "stat": stat, "p": p, "p_fdr": dist.bh(p), "ci_low": np.full(regions, np.nan), "ci_high": np.full(regions, np.nan)}


# permutation inference


def partition(m: np.ndarray, contrast: np.ndarray, method: str = "beckmann") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X (of interest), Z (nuisance) and the contrast for [X Z]."""
    c = np.atleast_2d(np.asarray(contrast, float))
    k = np.linalg.matrix_rank(c)
    if method == "guttman":
        used = (c != 0).any(0)
        return m[:, used], m[:, ~used], np.hstack([c[:, used], c[:, ~used]])
    if method == "beckmann":
        d = np.linalg.inv(m.T @ m)
        q = np.linalg.inv(c @ d @ c.T)
        null = np.linalg.svd(c)[2][k:].T
        v = null - c.T @ q @ c @ d @ null
        x = m @ d @ c.T @ q
        z = m @ d @ v @ np.linalg.pinv(v.T @ d @ v) if null.shape[1] else np.zeros((len(m), 0))
    elif method == "ridgway":
        cp = np.linalg.pinv(c)
        x = m @ cp
        rest = m - m @ c.T @ cp.T
        z = np.linalg.svd(rest, full_matrices=False)[0][:, : np.linalg.matrix_rank(m) - k]
        x = x - z @ np.linalg.pinv(z) @ x
    else:
        raise ValueError(f"unknown partition {method!r}")
    return x, z, np.hstack([np.eye(x.shape[1]), np.zeros((x.shape[1], z.shape[1]))])


PERMUTATION_METHODS = ("freedmanLane", "terBraak", "smith", "draperStoneman", "manly", "stillWhite")


class Randomiser:
    """Statistics of one contrast under permutations, for one of six methods. What does not
    change between permutations is computed once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, contrast: np.ndarray, kind: str = "t", method: str = "freedmanLane", part: str = "beckmann"):
        if method not in PERMUTATION_METHODS:
            raise ValueError(f"unknown method {method!r}")
        self.kind, self.method = kind, method
        self.y = y[:, None] if y.ndim == 1 else y
        self.px, self.z, self.c = partition(x, contrast, part)
        n = len(x)
        self.m = np.hstack([self.px, self.z])
        rz = np.eye(n) - (self.z @ np.linalg.pinv(self.z) if self.z.shape[1] else 0)
        if method == "freedmanLane":
            self.y = rz @ self.y
        elif method == "terBraak":
            self.y = self.y - x @ np.linalg.pinv(x) @ self.y
        elif method == "stillWhite":
            self.y, self.m = rz @ self.y, self.px
            self.c = self.c[:, : self.px.shape[1]]
        elif method == "smith":
            self.m = np.hstack([rz @ self.px, self.z])
        self.df = n - (np.linalg.matrix_rank(np.atleast_2d(contrast)) if method == "stillWhite" else np.linalg.matrix_rank(x))
        self.rank = np.linalg.matrix_rank(self.c)
        self.fixed = method in ("freedmanLane", "terBraak", "manly")
        self.hat = np.linalg.pinv(self.m)
        self.cov = self.hat @ self.hat.T

    def _stat(self, m: np.ndarray, hat: np.ndarray, cov: np.ndarray, y: np.ndarray) -> np.ndarray:
        beta = hat @ y
        s2 = ((y - m @ beta) ** 2).sum(0) / self.df
        g = self.c @ beta
        v = self.c @ cov @ self.c.T
        with np.errstate(all="ignore"):
            if self.kind == "t":
                return g[0] / np.sqrt(s2 * v[0, 0])
            return np.einsum("ir,ij,jr->r", g, np.linalg.inv(v), g) / self.rank / s2

    def __call__(self, order: np.ndarray) -> np.ndarray:
        """The statistic of each region, rows taken in `order`."""
        if self.fixed:
            return self._stat(self.m, self.hat, self.cov, self.y[order])
        k = self.px.shape[1]
        m = np.hstack([self.m[order][:, :k], self.m[:, k:]])
        hat = np.linalg.pinv(m)
        return self._stat(m, hat, hat @ hat.T, self.y)


class RegionRandomiser:
    """The same for a design of each region, X (n, p, r), and one outcome y (n,). Regions
    whose design is singular or not finite take no part in the null."""

    def __init__(self, x: np.ndarray, y: np.ndarray, contrast: np.ndarray, kind: str = "t", method: str = "freedmanLane", part: str = "beckmann"):
        whole = [k for k in range(x.shape[2]) if np.isfinite(x[:, :, k]).all() and np.linalg.matrix_rank(x[:, :, k]) == x.shape[1]]
        self.each = [Randomiser(x[:, :, k], y, contrast, kind, method, part) for k in whole]

    def __call__(self, order: np.ndarray) -> np.ndarray:
        return np.array([r(order)[0] for r in self.each])


def randomiser(x: np.ndarray, y: np.ndarray, *args):
    return (Randomiser if x.ndim == 2 else RegionRandomiser)(x, y, *args)


def extreme(stat: np.ndarray, alternative: str = "two.sided") -> float:
    """The maximum statistic of a permutation."""
    s = stat[np.isfinite(stat)]
    if not len(s):
        return np.nan
    return float(s.min() if alternative == "less" else s.max() if alternative == "greater" else np.abs(s).max())


def critical(null: np.ndarray, alpha: float = 0.05, alternative: str = "two.sided") -> float:
    s = np.sort(null)
    s = s[::-1] if alternative == "less" else s
    return float(s[min(int((1 - alpha) * len(s)), len(s) - 1)])


def p_permuted(observed: np.ndarray, null: np.ndarray, alternative: str = "two.sided") -> np.ndarray:
    o = np.abs(observed) if alternative == "two.sided" else observed
    count = (null[None] <= o[:, None]).sum(1) if alternative == "less" else (null[None] >= o[:, None]).sum(1)
    return np.where(np.isnan(o), np.nan, (count + 1) / (len(null) + 1))


# accessors and diagnostics; arrays are (n, r) or (r,)


def hat_values(f: Fit) -> np.ndarray:
    if f.x.ndim == 2:
        return np.repeat(np.einsum("ij,jk,ik->i", f.x, f.cov, f.x)[:, None], f.beta.shape[1], 1)
    return np.stack([np.einsum("ij,jk,ik->i", f.x[:, :, r], f.cov[r], f.x[:, :, r]) for r in range(f.beta.shape[1])], 1)


def sigma_loo(f: Fit) -> np.ndarray:
    h = hat_values(f)
    with np.errstate(all="ignore"):
        return np.sqrt((f.df * f.sigma**2 - f.resid**2 / (1 - h)) / (f.df - 1))


def rstandard(f: Fit, kind: str = "sd.1") -> np.ndarray:
    h = hat_values(f)
    return f.resid / (1 - h) if kind == "predictive" else f.resid / (f.sigma * np.sqrt(1 - h))


def rstudent(f: Fit) -> np.ndarray:
    return f.resid / (sigma_loo(f) * np.sqrt(1 - hat_values(f)))


def cooks(f: Fit) -> np.ndarray:
    h = hat_values(f)
    return (f.resid / (f.sigma * (1 - h))) ** 2 * h / f.rank


def dffits(f: Fit) -> np.ndarray:
    h = hat_values(f)
    return f.resid * np.sqrt(h) / (sigma_loo(f) * (1 - h))


def dfbeta(f: Fit) -> np.ndarray:
    """n x p x r: how coefficients change when an observation goes."""
    h = hat_values(f)
    out = [(f.x if f.x.ndim == 2 else f.x[:, :, r]) @ f.cov_of(r) * (f.resid[:, r] / (1 - h[:, r]))[:, None] for r in range(f.beta.shape[1])]
    return np.stack(out, 2)


def dfbetas(f: Fit) -> np.ndarray:
    s, b = sigma_loo(f), dfbeta(f)
    root = np.stack([np.sqrt(np.diag(f.cov_of(r))) for r in range(f.beta.shape[1])], 1)
    return b / (s[:, None, :] * root[None])


def covratio(f: Fit) -> np.ndarray:
    h = hat_values(f)
    e = f.resid / (sigma_loo(f) * np.sqrt(1 - h))
    n = len(f.resid)
    return 1 / ((1 - h) * ((n - f.rank - 1 + e**2) / (n - f.rank)) ** f.rank)


def influence_flags(f: Fit) -> dict[str, np.ndarray]:
    n, k = len(f.resid), f.rank
    return {
        "dfb": (np.abs(dfbetas(f)) > 1).any(1),
        "dffit": np.abs(dffits(f)) > 3 * np.sqrt(k / (n - k)),
        "cov_r": np.abs(1 - covratio(f)) > 3 * k / (n - k),
        "cook_d": dist.f_cdf(cooks(f), k, n - k) > 0.5,
        "hat": hat_values(f) > 3 * k / n,
    }


def residuals(f: Fit, kind: str = "response", terms: dict[str, list[int]] | None = None) -> np.ndarray:
    """Response residuals, or partial ones: n x terms x r, residual plus the term's part."""
    if kind == "response":
        return f.resid
    parts = []
    for columns in (terms or {str(j): [j] for j in range(f.rank)}).values():
        x = f.x[:, columns] if f.x.ndim == 2 else None
        part = x @ f.beta[columns] if x is not None else np.einsum("npr,pr->nr", f.x[:, columns], f.beta[columns])
        parts.append(f.resid + part - part.mean(0))
    return np.stack(parts, 1)


def coef_se(f: Fit) -> np.ndarray:
    return np.stack([f.sigma[r] * np.sqrt(np.diag(f.cov_of(r))) for r in range(f.beta.shape[1])], 1)


def vcov(f: Fit) -> np.ndarray:
    return np.stack([f.sigma[r] ** 2 * f.cov_of(r) for r in range(f.beta.shape[1])])


def confint(f: Fit, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    half = dist.t_ppf((1 + level) / 2, f.df) * coef_se(f)
    return f.beta - half, f.beta + half


def deviance(f: Fit) -> np.ndarray:
    return (f.resid**2).sum(0)


def r_squared(f: Fit, adjusted: bool = False) -> np.ndarray:
    y = f.fitted + f.resid
    r2 = 1 - deviance(f) / ((y - y.mean(0)) ** 2).sum(0)
    return 1 - (1 - r2) * (len(y) - 1) / f.df if adjusted else r2


def log_lik(f: Fit, reml: bool = False) -> np.ndarray:
    n = len(f.resid)
    m = n - f.rank if reml else n
    out = -0.5 * m * (np.log(2 * np.pi) + 1 - np.log(m) + np.log(deviance(f)))
    if reml:
        out = out - np.array([0.5 * np.linalg.slogdet(np.linalg.inv(f.cov_of(r)))[1] for r in range(f.beta.shape[1])])
    return out


def aic(f: Fit, k: float = 2) -> tuple[int, np.ndarray]:
    n = len(f.resid)
    return f.rank, n * np.log(deviance(f) / n) + k * f.rank


def anova3(d: Design, y: np.ndarray) -> pd.DataFrame:
    """Type-III table for one region: every term against the model without it."""
    full = fit(d.x, y)
    rss, mse, n = float(deviance(full)[0]), float(full.sigma[0] ** 2), len(y)
    rows = []
    for term, columns in d.terms.items():
        if term == "Intercept":
            continue
        keep = [j for j in range(d.x.shape[1]) if j not in columns]
        ss = float(((y - d.x[:, keep] @ np.linalg.pinv(d.x[:, keep]) @ y) ** 2).sum()) - rss
        rows.append((term, ss, len(columns)))
    total = rss + sum(r[1] for r in rows)
    out = []
    for term, ss, df in rows:
        f = ss / df / mse
        out.append((term, ss, ss / df, df, f, ss / total, ss / (ss + rss), (ss - df * mse) / (total + mse), (ss - df * mse) / (ss + (n - df) * mse), float(dist.f_sf(f, df, full.df))))
    out.append(("Residuals", rss, mse, full.df, *[np.nan] * 6))
    return pd.DataFrame(out, columns=["term", "sum_sq", "mean_sq", "df", "f", "eta_sq", "partial_eta_sq", "omega_sq", "partial_omega_sq", "p"])


def vif(d: Design) -> pd.DataFrame:
    """Generalised variance inflation factors of the terms."""
    keep = [j for j, c in enumerate(d.columns) if c != "Intercept"]
    cov = inv_crossprod(d.x)[np.ix_(keep, keep)]
    s = np.sqrt(np.diag(cov))
    r = cov / np.outer(s, s)
    at = {j: i for i, j in enumerate(keep)}
    rows = []
    for term, columns in d.terms.items():
        own = [at[j] for j in columns if j in at]
        if own:
            rest = [i for i in range(len(keep)) if i not in own]
            det = lambda ix: np.linalg.det(r[np.ix_(ix, ix)]) if ix else 1.0
            g = det(own) * det(rest) / np.linalg.det(r)
            rows.append((term, g, len(own), g ** (1 / (2 * len(own)))))
    return pd.DataFrame(rows, columns=["term", "gvif", "df", "gvif_scaled"])


# mediation


def mediate(xm: np.ndarray, m: np.ndarray, xy: np.ndarray, y: np.ndarray, treat: int, mediator: int, product: int | None, t0: float, t1: float, noise: np.ndarray | None = None) -> dict[str, float]:
    """Effects of one sample. xm: mediator's design (its column `treat` is the treatment);
    xy: outcome's design with columns `treat`, `mediator` and, with interaction, `product`."""
    bm = np.linalg.lstsq(xm, m, rcond=None)[0]
    by = np.linalg.lstsq(xy, y, rcond=None)[0]
    base = xm @ bm - xm[:, treat] * bm[treat]
    e = 0 if noise is None else noise
    med = {0: base + t0 * bm[treat] + e, 1: base + t1 * bm[treat] + e}
    rest = np.delete(np.arange(xy.shape[1]), [j for j in (treat, mediator, product) if j is not None])
    fixed = xy[:, rest] @ by[rest]

    def outcome(t: float, k: int) -> float:
        v = fixed + by[treat] * t + by[mediator] * med[k]
        return float((v + (by[product] * t * med[k] if product is not None else 0)).mean())

    d1, d0 = outcome(t1, 1) - outcome(t1, 0), outcome(t0, 1) - outcome(t0, 0)
    z1, z0 = outcome(t1, 1) - outcome(t0, 1), outcome(t1, 0) - outcome(t0, 0)
    tau = (d1 + d0 + z1 + z0) / 2
    part = lambda a: a / tau if tau else np.nan
    return {"d0": d0, "d1": d1, "z0": z0, "z1": z1, "tau": tau, "n0": part(d0), "n1": part(d1), "d_avg": (d0 + d1) / 2, "z_avg": (z0 + z1) / 2, "n_avg": (part(d0) + part(d1)) / 2}


def boot_p(observed: float, draws: np.ndarray) -> float:
    return 1.0 if observed == 0 else float(min(1, 2 * min((draws > 0).mean(), (draws <= 0).mean())))


def bca(draws: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected accelerated limits; the acceleration is that of the draws."""
    mean, n = draws.mean(), len(draws)
    z0 = float(dist.norm_ppf((draws < mean).mean()))
    u = (n - 1) * (mean - draws)
    a = (u**3).sum() / (6 * (u**2).sum() ** 1.5) if (u**2).sum() > 0 else 0.0
    ends = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + float(dist.norm_ppf(q))
        ends.append(float(dist.quantile7(draws, float(dist.norm_cdf(z0 + z / (1 - a * z))))))
    return ends[0], ends[1]
