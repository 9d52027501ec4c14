"""Distribution functions on numpy arrays (no scipy): normal, Student t and F."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
_ERFC = np.vectorize(math.erfc, otypes=[float])


def betainc(a, b, x, rest=None):
    """Regularised incomplete beta function, by its continued fraction (modified Lentz).
    `rest` is 1 - x, where the caller has it without cancellation."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x if rest is None else rest, x)
    z = np.clip(z, 0.0, 1.0)
    with np.errstate(all="ignore"):
        front = np.exp(_LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                h = h * step
            if np.nanmax(np.abs(step - 1), initial=0) < 1e-15:
                break
        out = front * h
    out = np.where(z <= 0, 0.0, out)
    out = np.where(flip, 1 - out, out)
    return np.where(np.isnan(x) | np.isnan(a) | np.isnan(b), np.nan, out)


def norm_cdf(z):
    return 0.5 * _ERFC(-np.asarray(z, float) / math.sqrt(2))


def t_cdf(t, df):
    t = np.asarray(t, float)
    with np.errstate(all="ignore"):
        tail = 0.5 * betainc(np.asarray(df, float) / 2, 0.5, np.where(np.isinf(t), 0.0, df / (df + t * t)), np.where(np.isinf(t), 1.0, t * t / (df + t * t)))
    return np.where(np.isnan(t), np.nan, np.where(t > 0, 1 - tail, tail))


def t_sf(t, df):
    return t_cdf(-np.asarray(t, float), df)


def f_sf(f, d1, d2):
    f = np.asarray(f, float)
    with np.errstate(all="ignore"):
        return np.where(np.isnan(f), np.nan, betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, np.where(f > 0, d2 / (d2 + d1 * f), 1.0)))


def f_cdf(f, d1, d2):
    return 1 - f_sf(f, d1, d2)


def _inverse(cdf, p, lo, hi):
    """Bisection of a rising function, for scalars or arrays."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, float(lo)), np.full(p.shape, float(hi))
    for _ in range(200):
        mid = (lo + hi) / 2
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        if np.all(hi - lo <= 1e-13 * np.maximum(1, np.abs(mid))):
            break
    return (lo + hi) / 2


def norm_ppf(p):
    p = np.asarray(p, float)
    out = _inverse(norm_cdf, p, -40, 40)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out))


@lru_cache(1024)
def _t_ppf(p: float, df: float) -> float:
    return float(_t_ppf_array(np.asarray(p, float), df))


def t_ppf(p, df):
    """Scalars are remembered: a study asks for few."""
    return _t_ppf(float(p), float(df)) if np.ndim(p) == 0 and np.ndim(df) == 0 else _t_ppf_array(np.asarray(p, float), df)


def _t_ppf_array(p, df):
    reach = 10.0
    while np.any(t_cdf(np.array(reach), df) < np.where(p < 1, np.maximum(p, 1 - p), 0)) and reach < 1e12:
        reach *= 10
    out = _inverse(lambda x: t_cdf(x, df), p, -reach, reach)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out))


def f_ppf(p, d1, d2):
    p = np.asarray(p, float)
    reach = 10.0
    while np.any(f_cdf(np.array(reach), d1, d2) < np.where(p < 1, p, 0)) and reach < 1e12:
        reach *= 10
    return np.where(p >= 1, np.inf, _inverse(lambda x: f_cdf(x, d1, d2), p, 0, reach))


def bh(p):
    """Benjamini-Hochberg adjusted p-values; NaN stays NaN and does not count."""
    p = np.asarray(p, float)
    out = np.full(p.shape, np.nan)
    ok = ~np.isnan(p)
    v = p[ok]
    if len(v):
        order = np.argsort(-v, kind="stable")
        adjusted = np.minimum.accumulate(v[order] * len(v) / np.arange(len(v), 0, -1))
        back = np.empty(len(v))
        back[order] = np.minimum(adjusted, 1)
        out[ok] = back
    return out


def quantile7(x, q):
    """R's default (type 7) quantile."""
    return np.quantile(np.asarray(x, float), q)
