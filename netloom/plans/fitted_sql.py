"""Least squares in DuckDB SQL, for the oracles of the linear models: normal equations by a
recursive sweep over one small matrix, then beta, residuals, leverages and what follows from
them. Tails of t and F at whole degrees of freedom are their finite sums."""

from __future__ import annotations


def t_two_sided(t: str, df: str) -> str:
    """P(|T| > t)."""
    th = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({th}) * list_sum([exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) / sqrt(pi()) * pow(cos({th}), 2 * k) for k in range(0, greatest(({df})::INT // 2, 1))])"
    odd = f"2 / pi() * ({th} + sin({th}) * list_sum([sqrt(pi()) / 2 * exp(lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * pow(cos({th}), 2 * k + 1) for k in range(0, (({df})::INT - 1) // 2)]))"
    return f"(1 - CASE WHEN ({df})::INT % 2 = 0 THEN {even} ELSE {odd} END)"


def f3_cdf(x: str, df: str) -> str:
    """P(F(3, df) <= x) by the midpoint rule in sqrt(x): for comparisons, not for output."""
    k = f"exp(lgamma(({df} + 3) / 2.0::DOUBLE) - lgamma(1.5::DOUBLE) - lgamma({df} / 2.0::DOUBLE)) * pow(3.0::DOUBLE / {df}, 1.5)"
    u = f"((k + 0.5::DOUBLE) / 200 * sqrt({x}))"
    return f"({k} * 2 * sqrt({x}) / 200 * list_sum([{u} * {u} * pow(1 + 3 * {u} * {u} / {df}, -({df} + 3) / 2.0::DOUBLE) for k in range(0, 200)]))"


def quantile(df: str, level: float = 0.95) -> str:
    """A recursive CTE's body: (k, lo, hi) bisects for the two-sided quantile."""
    mid = "((lo + hi) / 2)"
    return f"SELECT 0 AS k, 0.0::DOUBLE AS lo, 64.0::DOUBLE AS hi, {df} AS df UNION ALL SELECT k + 1, CASE WHEN {t_two_sided(mid, 'df')} > {1 - level!r}::DOUBLE THEN {mid} ELSE lo END, CASE WHEN {t_two_sided(mid, 'df')} > {1 - level!r}::DOUBLE THEN hi ELSE {mid} END, df FROM tq WHERE k < 56"


def least_squares(x: list[str], rows: str) -> dict[str, str]:
    """CTEs for y = X beta by region. `x`: the design's columns over the covariates of
    `rows` (region, sid, value, ...), the same for every region. Made: inv(s), co(region,
    beta), ob(region, sid, x, value, fitted, e, h), sg(region, rss, n, df, s2)."""
    p = len(x)
    sums = "[" + ", ".join("[" + ", ".join(f"sum(x[{i}] * x[{j}])" for j in range(1, p + 1)) + "]" for i in range(1, p + 1)) + "]"
    cell = "CASE WHEN i = k AND j = k THEN 1 / m[k][k] WHEN i = k THEN m[k][j] / m[k][k] WHEN j = k THEN -m[i][k] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END"
    span = f"range(1, {p + 1})"
    return dict(
        xs=f"SELECT DISTINCT sid, [{', '.join(f'({c})::DOUBLE' for c in x)}] AS x FROM {rows}",
        g0=f"SELECT {sums} AS m FROM xs",
        sw=f"SELECT 1 AS k, m FROM g0 UNION ALL SELECT k + 1, [[{cell} for j in {span}] for i in {span}] FROM sw WHERE k <= {p}",
        inv=f"SELECT m AS s FROM sw WHERE k = {p + 1}",
        xy=f"SELECT region, [{', '.join(f'sum(x[{i}] * value)' for i in range(1, p + 1))}] AS t FROM {rows} JOIN xs USING (sid) GROUP BY region",
        co=f"SELECT region, [list_dot_product(s[i], t) for i in {span}] AS beta FROM xy, inv",
        ob=f"SELECT region, sid, x, value, list_dot_product(x, beta) AS fitted, value - list_dot_product(x, beta) AS e, list_dot_product(x, [list_dot_product(s[i], x) for i in {span}]) AS h FROM {rows} JOIN xs USING (sid) JOIN co USING (region), inv",
        sg=f"SELECT region, sum(e * e) AS rss, count(*) AS n, count(*) - {p} AS df, sum(e * e) / (count(*) - {p}) AS s2 FROM ob GROUP BY region",
    )


def observed(p: int) -> dict[str, str]:
    """od: ob with sigma, the residuals' scalings, distances and changes of coefficients, and
    the flags of influence (of a design of three columns)."""
    return dict(
        o1=f"SELECT ob.*, n, df, sqrt(s2) AS sigma, sqrt((df * s2 - e * e / (1 - h)) / (df - 1)) AS si, [list_dot_product(s[i], x) for i in range(1, {p + 1})] AS sx, s FROM ob JOIN sg USING (region), inv",
        o2=f"SELECT *, e / (sigma * sqrt(1 - h)) AS rstandard, e / (si * sqrt(1 - h)) AS rstudent, pow(e / (sigma * (1 - h)), 2) * h / {p} AS cooks, e * sqrt(h) / (si * (1 - h)) AS dffits, [sx[i] * e / (1 - h) / (si * sqrt(s[i][i])) for i in range(1, {p + 1})] AS dfbetas FROM o1",
        o3=f"SELECT *, 1 / ((1 - h) * pow((n - {p} - 1 + rstudent * rstudent) / (n - {p}), {p})) AS covratio FROM o2",
        od=f"SELECT *, list_max([abs(z) for z in dfbetas]) > 1 AS flag_dfb, abs(dffits) > 3 * sqrt({p}::DOUBLE / (n - {p})) AS flag_dffit, abs(1 - covratio) > 3.0::DOUBLE * {p} / (n - {p}) AS flag_cov_r, {f3_cdf('cooks', '(n - 3)')} > 0.5 AS flag_cook_d, h > 3.0::DOUBLE * {p} / n AS flag_hat FROM o3",
    )


def coefficient_rows(terms: list[str]) -> str:
    """region, term, estimate, se, df of all coefficients, as a SELECT."""
    return " UNION ALL ".join(f"SELECT region, '{t}' AS term, beta[{i}] AS estimate, sqrt(s2 * s[{i}][{i}]) AS se, df FROM co JOIN sg USING (region), inv" for i, t in enumerate(terms, 1))
