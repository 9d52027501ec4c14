"""The query catalogue: every operator over tables that are derived from the driver's, and
for most the equivalent SQL. Doubles are rounded to 6 places in both; undefined is NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import covariance as S
from netloom.operators import glm as G
from netloom.operators import large as B
from netloom.operators import local as R
from netloom.operators import matrices as X
from netloom.operators import measures as M
from netloom.operators import model as O
from netloom.operators.collection import Networks
from netloom.plans import figures as P
from netloom.plans import fitted_sql as Q
from netloom.plans import fixtures as T
from netloom.streaming.edges import windowed_edges

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def cohort_query(sql: str):
    """A query of the cohort (spark, sf, y): every row and every dimension."""

    def add(fn):
        _QUERIES[fn.__name__] = lambda spark, sf: fn(spark, sf, T.cohort(spark, sf))
        _SQL[fn.__name__] = sql
        return fn

    return add


def r6(c: str, name: str | None = None) -> F.Column:
    return (F.round(F.col(c).cast("double"), 6) + 0.0).alias(name or c.split(".")[-1])


def rounded(df: DataFrame, coarse: tuple[str, ...] = ()) -> DataFrame:
    """To 6 places; `coarse` columns, whose values are large, to 3."""
    return df.select(*((F.round(c, 3) + 0.0).alias(c) if c in coarse else r6(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def _ctes(**parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in parts.items())


_CONN = dict(
    conn="SELECT strftime(o_orderdate, '%Y-%m') AS sid, c_nationkey + 1 AS i, s_nationkey + 1 AS j, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    subj="SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS sid FROM orders",
    grps=f"SELECT sid, CASE WHEN sid < '{T.SPLIT}' THEN 'A' ELSE 'B' END AS grp FROM subj",
    reg="SELECT (n_nationkey + 1)::INT AS v, r_name AS lobe, (n_regionkey + 1)::INT AS g, CASE WHEN n_nationkey % 2 = 0 THEN 'L' ELSE 'R' END AS hemi, n_nationkey // 2 AS half, 10.0::DOUBLE * (n_nationkey % 5) * CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE 1 END AS x, 15.0::DOUBLE * (n_nationkey // 5) - 30 AS y, ((7 * n_nationkey) % 20)::DOUBLE AS z FROM nation JOIN region ON n_regionkey = r_regionkey",
)


def _pairs(by: str = "greatest(a, b)") -> dict[str, str]:
    return _CONN | dict(
        dirs="SELECT sid, least(i, j) AS i, greatest(i, j) AS j, coalesce(max(CASE WHEN i < j THEN w END), 0) AS a, coalesce(max(CASE WHEN i > j THEN w END), 0) AS b FROM conn WHERE i <> j GROUP BY ALL",
        sym=f"SELECT sid, i, j, ({by})::DOUBLE AS w FROM dirs",
        pairs="SELECT s.sid, a.v AS i, b.v AS j, coalesce(sym.w, 0) AS w FROM subj s CROSS JOIN reg a JOIN reg b ON a.v < b.v LEFT JOIN sym ON sym.sid = s.sid AND sym.i = a.v AND sym.j = b.v",
    )


_PAIRS = _pairs()
_RANKED = _PAIRS | dict(
    nn="SELECT count(*)::DOUBLE * (count(*) - 1) / 2 AS e FROM reg",
    ranked="SELECT *, row_number() OVER (PARTITION BY sid ORDER BY w) AS rn FROM pairs",
)
_GRAPH = _RANKED | dict(
    cut="SELECT sid, w AS cut FROM ranked, nn WHERE rn = floor(e - e * 0.2::DOUBLE)",
    edges="SELECT p.sid AS gid, i AS src, j AS dst, w AS weight FROM pairs p JOIN cut USING (sid) WHERE w > cut AND w > 0",
    h="SELECT gid, src AS v, dst AS u, weight FROM edges UNION ALL SELECT gid, dst, src, weight FROM edges",
    verts="SELECT sid AS gid, v FROM subj, reg",
    deg="SELECT gid, v, count(u) AS degree, coalesce(sum(weight), 0)::DOUBLE AS strength FROM verts LEFT JOIN h USING (gid, v) GROUP BY ALL",
    tri="SELECT a.gid, a.v, count(*) // 2 AS t, sum(a.weight + b.weight) / 2 AS closed FROM h a JOIN h b ON a.gid = b.gid AND a.v = b.v AND a.u <> b.u JOIN h c ON c.gid = a.gid AND c.v = a.u AND c.u = b.u GROUP BY ALL",
    clus="SELECT d.*, coalesce(t, 0) AS t, coalesce(closed, 0) AS closed, CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END AS cl FROM deg d LEFT JOIN tri USING (gid, v)",
)


def sql(ctes: dict[str, str], select: str) -> str:
    return _ctes(**ctes) + " " + select


# flagship


@query(sql(_GRAPH, "SELECT grp, v, round(avg(degree), 6) AS degree, round(avg(strength), 6) AS strength, round(avg(cl), 6) AS clustering FROM clus JOIN grps ON gid = sid GROUP BY ALL"))
def hub_profile(spark, sf):
    v, e = T.graph(spark, sf)
    c = R.clustering(v, e).join(T.groups(spark, sf).withColumnRenamed("sid", "gid"), "gid")
    return rounded(c.groupBy("grp", "v").agg(F.avg("degree").alias("degree"), F.avg("strength").alias("strength"), F.avg("transitivity").alias("clustering")))


# ingest and thresholds


@query(sql(_CONN, "SELECT * FROM conn"))
def conn_build(spark, sf):
    return T.conn(spark, sf)


@query(sql(_CONN, "SELECT sid, i, j, round(w / sum(w) OVER (PARTITION BY sid, i), 6) AS w FROM conn"))
def normalize_rowsums(spark, sf):
    return rounded(X.normalize(T.conn(spark, sf), "rowSums"))


@query(sql(_CONN, "SELECT sid, i, j, round(w / (sum(w) OVER (PARTITION BY sid, i) + 1), 6) AS w FROM conn"))
def normalize_waytotal(spark, sf):
    c = T.conn(spark, sf)
    return rounded(X.normalize(c, "waytotal", c.groupBy("sid", "i").agg((F.sum("w") + 1).alias("d"))))


@query(sql(_CONN | dict(sz="SELECT c_nationkey + 1 AS v, count(*) AS d FROM customer GROUP BY ALL"), "SELECT sid, i, j, round(coalesce(2 * w / (5000.0::DOUBLE * (a.d + b.d)), 0), 6) AS w FROM conn LEFT JOIN sz a ON a.v = i LEFT JOIN sz b ON b.v = j"))
def normalize_size(spark, sf):
    size = T.read(spark, sf, "customer").groupBy((F.col("c_nationkey") + 1).alias("i")).agg(F.count("*").alias("d"))
    div = T.months(spark, sf).crossJoin(F.broadcast(size))  # a row a nation
    return rounded(X.normalize(T.conn(spark, sf), "size", div))


def _symmetrize(by):
    def fn(spark, sf):
        return X.symmetrize(T.conn(spark, sf), by)

    fn.__name__ = f"symmetrize_{by}"
    return fn


for _by, _e in (("max", "greatest(a, b)"), ("min", "least(a, b)"), ("avg", "(a + b) / 2")):
    query(sql(_pairs(_e), "SELECT * FROM sym"))(_symmetrize(_by))


@query(sql(_PAIRS, "SELECT i, j, round(stddev_samp(w) / nullif(avg(w), 0), 6) AS cv FROM pairs GROUP BY ALL"))
def coeff_var_pairs(spark, sf):
    return rounded(X.coeff_var(T.pairs(spark, sf)))


@query(sql(_PAIRS, "SELECT sid, i, j, w, tau FROM pairs, (VALUES (20.0::DOUBLE), (50.0::DOUBLE)) t(tau) WHERE w > tau"))
def threshold_raw(spark, sf):
    return X.threshold_raw(T.pairs(spark, sf), T.doubles(spark, "tau", 20, 50))


@query(sql(_PAIRS | dict(st="SELECT i, j, avg(w) + 2 * stddev_samp(w) AS high FROM pairs GROUP BY ALL"), "SELECT sid, i, j, w, tau FROM pairs JOIN st USING (i, j), (VALUES (120.0::DOUBLE), (150.5::DOUBLE)) t(tau) WHERE w > 0 AND high > tau"))
def threshold_mean_sd(spark, sf):
    return X.threshold_mean_sd(T.pairs(spark, sf), T.doubles(spark, "tau", 120, 150.5))


@query(sql(_RANKED | dict(dens="SELECT * FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) d(density)", cut="SELECT sid, density, w AS cut FROM ranked, nn, dens WHERE rn = floor(e - e * density)"), "SELECT sid, i, j, w, density FROM pairs JOIN cut USING (sid) WHERE w > cut AND w > 0"))
def threshold_density(spark, sf):
    return X.threshold_density(T.pairs(spark, sf), T.doubles(spark, "density", 0.1, 0.2, 0.3))


@query(sql(_RANKED | dict(cv="SELECT i, j, stddev_samp(w) / nullif(avg(w), 0) AS cv FROM pairs GROUP BY ALL", rk="SELECT cv, row_number() OVER (ORDER BY cv DESC NULLS LAST) AS rn FROM cv", ct="SELECT density, cv AS cut FROM rk, nn, (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) d(density) WHERE rn = floor(e - e * density)"), "SELECT sid, i, j, w, density FROM pairs JOIN cv USING (i, j), ct WHERE cv < cut AND w > 0"))
def threshold_consistency(spark, sf):
    return X.threshold_consistency(T.pairs(spark, sf), T.doubles(spark, "density", 0.1, 0.2))


_CONSENSUS = _PAIRS | dict(sz="SELECT grp, count(*) AS n FROM grps GROUP BY ALL", votes="SELECT grp, i, j FROM pairs JOIN grps USING (sid) JOIN sz USING (grp) GROUP BY grp, i, j, n HAVING sum((w > 50)::INT) >= 0.4::DOUBLE * n", kept="SELECT sid, grp, i, j, w FROM pairs JOIN grps USING (sid) JOIN votes USING (grp, i, j) WHERE w > 0")


@query(sql(_CONSENSUS, "SELECT sid, grp, i, j, w FROM kept"))
def threshold_consensus(spark, sf):
    return X.threshold_consensus(T.pairs(spark, sf), T.groups(spark, sf), 50.0, 0.4).select("sid", "grp", "i", "j", "w")


@query(sql(_CONSENSUS, "SELECT grp, i, j, round(sum(w) / any_value(n), 6) AS w FROM kept JOIN sz USING (grp) GROUP BY grp, i, j"))
def group_mean_mats(spark, sf):
    g = T.groups(spark, sf)
    return rounded(X.group_means(X.threshold_consensus(T.pairs(spark, sf), g, 50.0, 0.4), g))


@query(sql(_GRAPH | dict(second="SELECT strftime(o_orderdate, '%Y-%m') AS sid, c_nationkey + 1 AS i, s_nationkey + 1 AS j, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT) / 100.0::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"), "SELECT sid, i, j, round(w, 2) AS w FROM second WHERE (sid, i, j) IN (SELECT (gid, src, dst) FROM edges)"))
def apply_mask(spark, sf):
    _, e = T.graph(spark, sf)
    kept = e.select(F.col("gid").alias("sid"), F.col("src").alias("i"), F.col("dst").alias("j"))
    return X.apply_mask(T.second_weights(spark, sf), kept).select("sid", "i", "j", F.round("w", 2).alias("w"))


@query(sql(_PAIRS, "SELECT sid, bool_and(w IN (0, 1)) AS is_binary FROM pairs GROUP BY ALL"))
def is_binary(spark, sf):
    return X.is_binary(T.pairs(spark, sf))


@query(sql(_CONN, "SELECT sid, j, max(w) AS col_max, min(w) AS col_min, max(abs(w)) AS col_max_abs FROM conn GROUP BY ALL"))
def column_extremes(spark, sf):
    return X.column_extremes(T.conn(spark, sf))


# local measures


@query(sql(_GRAPH, "SELECT gid, count(DISTINCT v) AS n, sum(degree)::BIGINT // 2 AS m, round(sum(degree) / (count(DISTINCT v)::DOUBLE * (count(DISTINCT v) - 1)), 6) AS density FROM deg GROUP BY gid"))
def density(spark, sf):
    return rounded(R.density(*T.graph(spark, sf)))


@query(sql(_GRAPH, "SELECT * FROM deg"))
def degree_strength(spark, sf):
    return R.degree_strength(*T.graph(spark, sf))


@query(sql(_GRAPH, "SELECT gid, v, degree, strength, t AS triangles, round(cl, 6) AS transitivity, round(CASE WHEN degree > 1 THEN closed / (strength * (degree - 1)) END, 6) AS barrat FROM clus"))
def clustering(spark, sf):
    return rounded(R.clustering(*T.graph(spark, sf)))


@query(sql(_GRAPH, "SELECT gid, round(avg(CASE WHEN degree > 1 THEN cl END), 6) AS cp, round(2 * sum(t) / nullif(sum(degree * (degree - 1)), 0), 6) AS transitivity, (sum(t) / 3)::BIGINT AS triangles FROM clus GROUP BY gid"))
def graph_clustering(spark, sf):
    return rounded(R.graph_clustering(*T.graph(spark, sf)))


@query(sql(_GRAPH, "SELECT d.gid, d.v, round(avg(e.degree), 6) AS knn, round(sum(e.degree * weight) / sum(weight), 6) AS knn_wt FROM deg d LEFT JOIN h ON h.gid = d.gid AND h.v = d.v LEFT JOIN deg e ON e.gid = h.gid AND e.v = h.u GROUP BY ALL"))
def knn(spark, sf):
    return rounded(R.knn(*T.graph(spark, sf)))


@query(sql(_GRAPH, "SELECT d.gid, d.v, round(avg((d.degree - e.degree)::DOUBLE / (d.degree + e.degree)), 6) AS leverage FROM deg d LEFT JOIN h ON h.gid = d.gid AND h.v = d.v LEFT JOIN deg e ON e.gid = h.gid AND e.v = h.u GROUP BY d.gid, d.v"))
def leverage(spark, sf):
    return rounded(R.leverage(*T.graph(spark, sf)))


@query(sql(_GRAPH | dict(x="SELECT h.gid, d.degree::DOUBLE AS a, e.degree::DOUBLE AS b FROM h JOIN deg d ON d.gid = h.gid AND d.v = h.v JOIN deg e ON e.gid = h.gid AND e.v = h.u"), "SELECT gid, round(CASE WHEN var_pop(a) > 0 THEN corr(a, b) END, 6) AS assortativity FROM x GROUP BY gid"))
def assort_degree(spark, sf):
    return rounded(R.degree_assortativity(*T.graph(spark, sf)))


_MIX = _GRAPH | dict(mix="SELECT gid, a.g AS a, b.g AS b, count(*)::DOUBLE AS n, sum(weight) AS w FROM h JOIN reg a ON a.v = h.v JOIN reg b ON b.v = h.u GROUP BY ALL", tot="SELECT gid, sum(n) AS m, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM mix GROUP BY gid", rows_="SELECT gid, sum(r * r) AS rr FROM (SELECT gid, a, sum(n) AS r FROM mix GROUP BY ALL) GROUP BY gid")


@query(sql(_MIX, "SELECT gid, round((same / m - rr / (m * m)) / nullif(1 - rr / (m * m), 0), 6) AS assortativity FROM tot JOIN rows_ USING (gid)"))
def assort_nominal(spark, sf):
    return rounded(R.nominal_assortativity(T.graph(spark, sf)[1], T.modules(spark, sf)))


@query(sql(_MIX, "SELECT gid, round(same / m - rr / (m * m), 6) AS modularity FROM tot JOIN rows_ USING (gid)"))
def modularity_given(spark, sf):
    return rounded(R.modularity(T.graph(spark, sf)[1], T.modules(spark, sf)))


_KAPPA = _GRAPH | dict(kap="SELECT gid, h.v, any_value(o.g) AS own, r.g, count(*)::DOUBLE AS kappa FROM h JOIN reg r ON r.v = h.u JOIN reg o ON o.v = h.v GROUP BY gid, h.v, r.g")


@query(sql(_KAPPA, "SELECT gid, v, round(1 - sum(kappa * kappa) / (sum(kappa) * sum(kappa)), 6) AS participation FROM verts LEFT JOIN kap USING (gid, v) GROUP BY ALL"))
def participation(spark, sf):
    v, e = T.graph(spark, sf)
    return rounded(R.participation(v, e, T.modules(spark, sf)))


@query(sql(_KAPPA | dict(ins="SELECT gid, verts.v, reg.g, coalesce(kappa, 0) AS k FROM verts JOIN reg USING (v) LEFT JOIN kap USING (gid, v, g)", mom="SELECT *, avg(k) OVER (PARTITION BY gid, g) AS mu, stddev_samp(k) OVER (PARTITION BY gid, g) AS sd FROM ins"), "SELECT gid, v, round(CASE WHEN sd > 1e-12 THEN (k - mu) / sd END, 6) AS z FROM mom"))
def within_module_z(spark, sf):
    v, e = T.graph(spark, sf)
    return rounded(R.within_module_z(v, e, T.modules(spark, sf)))


@query(sql(_KAPPA | dict(btw="SELECT gid, g, own, sum(kappa) AS total FROM kap GROUP BY ALL", nc="SELECT h.gid, h.v, reg.g, sum(d.degree) AS c FROM h JOIN deg d ON d.gid = h.gid AND d.v = h.u JOIN reg ON reg.v = h.u GROUP BY ALL", cn="SELECT gid, max(cs) AS cn FROM (SELECT gid, g, sum(degree) AS cs FROM deg JOIN reg USING (v) GROUP BY ALL) GROUP BY gid", pt="SELECT gid, v, kappa, kappa * kappa * pow(1 - kappa / total * c / cn, 2) AS part FROM kap JOIN btw USING (gid, g, own) JOIN nc USING (gid, v, g) JOIN cn USING (gid)"), "SELECT gid, v, round(1 - sum(part) / (sum(kappa) * sum(kappa)), 6) AS gateway FROM verts LEFT JOIN pt USING (gid, v) GROUP BY ALL"))
def gateway_degree(spark, sf):
    v, e = T.graph(spark, sf)
    c = R.degree_strength(v, e).select("gid", "v", F.col("degree").cast("double").alias("c"))
    return rounded(R.gateway(v, e, T.modules(spark, sf), c))


@query(sql(_GRAPH | dict(el="SELECT e.gid, least(a.degree, b.degree) AS k, weight FROM edges e JOIN deg a ON a.gid = e.gid AND a.v = src JOIN deg b ON b.gid = e.gid AND b.v = dst", ks="SELECT gid, unnest(generate_series(1, max(degree)))::INT AS k FROM deg GROUP BY gid", nk="SELECT ks.gid, ks.k, count(*) FILTER (degree > ks.k) AS n_k FROM ks JOIN deg USING (gid) GROUP BY ALL", ek="SELECT ks.gid, ks.k, count(weight) FILTER (el.k > ks.k) AS e_k, coalesce(sum(weight) FILTER (el.k > ks.k), 0) AS w_k FROM ks LEFT JOIN el USING (gid) GROUP BY ks.gid, ks.k", rkw="SELECT gid, weight, row_number() OVER (PARTITION BY gid ORDER BY weight DESC) AS r FROM edges"), "SELECT gid, nk.k, n_k, e_k, round(CASE WHEN n_k > 1 THEN 2.0::DOUBLE * e_k / (n_k * (n_k - 1)) END, 6) AS phi, round(CASE WHEN e_k > 0 THEN w_k / (SELECT sum(weight) FROM rkw WHERE rkw.gid = nk.gid AND r <= e_k) END, 6) AS phi_wt FROM nk JOIN ek USING (gid, k)"))
def rich_club_all(spark, sf):
    return rounded(R.rich_club(*T.graph(spark, sf)))


@query(sql(_GRAPH | dict(pl="SELECT d.gid, d.v, d.degree, count(*) FILTER (e.degree > d.degree) AS plus FROM deg d LEFT JOIN h ON h.gid = d.gid AND h.v = d.v LEFT JOIN deg e ON e.gid = h.gid AND e.v = h.u GROUP BY ALL", rk="SELECT *, row_number() OVER (PARTITION BY gid ORDER BY degree DESC, v) AS rank, count(*) OVER (PARTITION BY gid) AS n FROM pl"), "SELECT gid, rank::INT AS rank, degree, round(rank::DOUBLE / n, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY plus DESC, rank DESC) AS o FROM rk) WHERE o = 1"))
def rich_core(spark, sf):
    return rounded(R.rich_core(*T.graph(spark, sf)))


@query(sql(_GRAPH, "SELECT e.gid, src, dst, CASE (a.degree >= 8)::INT + (b.degree >= 8)::INT WHEN 2 THEN 'rich-club' WHEN 1 THEN 'feeder' ELSE 'local' END AS kind FROM edges e JOIN deg a ON a.gid = e.gid AND a.v = src JOIN deg b ON b.gid = e.gid AND b.v = dst"))
def rich_club_attrs(spark, sf):
    return R.rich_club_attrs(*T.graph(spark, sf), 8)


_DIST = _GRAPH | dict(dist="SELECT gid, src, dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM edges JOIN reg a ON a.v = src JOIN reg b ON b.v = dst")


@query(sql(_DIST, "SELECT gid, src, dst, round(dist, 6) AS dist FROM dist"))
def edge_spatial_dist(spark, sf):
    return rounded(R.edge_distances(T.graph(spark, sf)[1], T.regions(spark, sf)))


@query(sql(_DIST | dict(hd="SELECT gid, src AS v, dist FROM dist UNION ALL SELECT gid, dst, dist FROM dist"), "SELECT gid, v, round(avg(dist), 6) AS dist FROM verts LEFT JOIN hd USING (gid, v) GROUP BY ALL"))
def vertex_spatial_dist(spark, sf):
    v, e = T.graph(spark, sf)
    return rounded(R.vertex_distances(v, e, T.regions(spark, sf)))


@query(sql(_GRAPH | dict(s="SELECT gid, count(*) FILTER (a.hemi = 'L' AND b.hemi = 'L') AS lh, count(*) FILTER (a.hemi = 'R' AND b.hemi = 'R') AS rh FROM edges JOIN reg a ON a.v = src JOIN reg b ON b.v = dst GROUP BY gid"), "SELECT *, round(2.0::DOUBLE * (lh - rh) / nullif(lh + rh, 0), 6) AS asymm FROM s"))
def asymmetry_hemi(spark, sf):
    return rounded(R.hemisphere_asymmetry(T.graph(spark, sf)[1], T.regions(spark, sf)))


@query(sql(_GRAPH | dict(s="SELECT d.gid, d.v, count(*) FILTER (hemi = 'L') AS lh, count(*) FILTER (hemi = 'R') AS rh FROM verts d LEFT JOIN h ON h.gid = d.gid AND h.v = d.v LEFT JOIN reg ON reg.v = u GROUP BY d.gid, d.v"), "SELECT *, round(2.0::DOUBLE * (lh - rh) / nullif(lh + rh, 0), 6) AS asymm FROM s"))
def asymmetry_vertex(spark, sf):
    v, e = T.graph(spark, sf)
    return rounded(R.vertex_asymmetry(v, e, T.regions(spark, sf)))


_INTER = _GRAPH | dict(cells="SELECT gid, least(a.lobe, b.lobe) AS g1, greatest(a.lobe, b.lobe) AS g2, count(*) AS n FROM edges JOIN reg a ON a.v = src JOIN reg b ON b.v = dst GROUP BY ALL")


@query(sql(_INTER, "SELECT * FROM cells"))
def count_inter(spark, sf):
    return R.count_inter(T.graph(spark, sf)[1], T.regions(spark, sf))


@query(sql(_INTER, "SELECT gid, lobe AS g, sum(CASE WHEN g1 = g2 THEN n ELSE 0 END)::BIGINT AS intra, sum(CASE WHEN g1 <> g2 THEN n ELSE 0 END)::BIGINT AS inter, sum(n)::BIGINT AS total FROM cells JOIN (SELECT DISTINCT lobe FROM reg) ON lobe IN (g1, g2) GROUP BY ALL"))
def count_by_group(spark, sf):
    return R.count_by_group(T.graph(spark, sf)[1], T.regions(spark, sf))


@query(sql(_GRAPH, "SELECT gid, count(*) FILTER (a.half = b.half) AS n FROM edges JOIN reg a ON a.v = src JOIN reg b ON b.v = dst GROUP BY gid"))
def count_homologous(spark, sf):
    reg = T.regions(spark, sf).select("v", F.col("pair_name").alias("name"))
    return R.count_homologous(T.graph(spark, sf)[1], reg)


@query(sql(_INTER | dict(gg="SELECT lobe AS g, count(*) AS n_vertices, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM reg GROUP BY ALL"), "SELECT gid, g, sum(n)::BIGINT AS size, any_value(n_vertices) AS n_vertices, round(any_value(x), 6) AS x, round(any_value(y), 6) AS y, round(any_value(z), 6) AS z FROM cells JOIN gg ON g IN (g1, g2) WHERE g1 <> g2 GROUP BY gid, g"))
def contract_groups(spark, sf):
    return rounded(R.contract(T.graph(spark, sf)[1], T.regions(spark, sf), "lobe")[0])


@query(sql(_GRAPH, "SELECT e.* FROM edges e JOIN reg a ON a.v = src JOIN reg b ON b.v = dst WHERE a.hemi <> b.hemi"))
def edges_between_groups(spark, sf):
    return R.select_edges(T.graph(spark, sf)[1], T.regions(spark, sf), "hemi", False)


@query(sql(_GRAPH, "SELECT * FROM edges WHERE weight BETWEEN 100 AND 200"))
def edges_by_weight(spark, sf):
    return R.edges_between(T.graph(spark, sf)[1], 100, 200)


@query(sql(_GRAPH | dict(mem="SELECT gid, v AS seed, u FROM h WHERE v IN (1, 7) UNION SELECT gid, v, v FROM h WHERE v IN (1, 7)"), "SELECT DISTINCT e.* FROM edges e JOIN mem a ON a.gid = e.gid AND a.u = src JOIN mem b ON b.gid = e.gid AND b.u = dst AND a.seed = b.seed"))
def ego_union(spark, sf):
    seeds = T.regions(spark, sf).where("v IN (1, 7)").select("v")
    return R.ego(T.graph(spark, sf)[1], seeds)[1]


@query(sql(_GRAPH, "SELECT v FROM deg WHERE degree >= 1 GROUP BY v HAVING count(*) >= (SELECT count(*) FROM subj)"))
def intersection_graph(spark, sf):
    return R.common_vertices(R.degree_strength(*T.graph(spark, sf)), "degree >= 1")


def _two(spark, sf):
    e = T.graph(spark, sf)[1]
    return e.where("gid = '1997-03'"), e.where("gid = '1999-07'")


for _name, _fn, _op in (("graph_union", R.graph_union, "UNION"), ("graph_intersection", R.graph_intersection, "INTERSECT"), ("graph_difference", R.graph_difference, "EXCEPT")):

    def _set(spark, sf, fn=_fn):
        return fn(*_two(spark, sf))

    _set.__name__ = _name
    query(sql(_GRAPH, f"SELECT src, dst FROM edges WHERE gid = '1997-03' {_op} SELECT src, dst FROM edges WHERE gid = '1999-07'"))(_set)


@query(sql(_GRAPH | dict(k="SELECT gid, v FROM deg JOIN reg USING (v) WHERE degree > 3 AND (hemi = 'L' OR strength > 600)"), "SELECT e.* FROM edges e WHERE (gid, src) IN (SELECT (gid, v) FROM k) AND (gid, dst) IN (SELECT (gid, v) FROM k)"))
def subset_condition(spark, sf):
    v, e = T.graph(spark, sf)
    d = R.degree_strength(v, e).join(T.regions(spark, sf).select("v", "hemi"), "v")
    return R.subset(d, e, "degree > 3 & (hemi = 'L' | strength > 600)")[1]


@query(sql(_GRAPH | dict(m="SELECT *, max(weight) OVER (PARTITION BY gid) AS mx FROM edges"), "SELECT gid, src, dst, round(1 / weight, 6) AS inverse, round(-log10(weight / mx) + 0.0, 6) AS log_share, round(weight, 6) AS back FROM m"))
def xfm_weights(spark, sf):
    e = T.graph(spark, sf)[1]
    key = ["gid", "src", "dst"]
    a = X.transform_weights(e, "1/w").select(*key, F.col("weight").alias("inverse"))
    b = X.transform_weights(e, "-log10(w/max(w))")
    c = X.transform_weights(b, "-log10(w/max(w))", invert=True).select(*key, F.col("weight").alias("back"))
    return rounded(a.join(b.select(*key, F.col("weight").alias("log_share")), key).join(c, key))


@query(sql(_GRAPH | dict(w="SELECT *, min(degree) OVER (PARTITION BY gid) AS a, max(degree) OVER (PARTITION BY gid) AS b FROM deg"), "SELECT gid, v, degree, round(CASE WHEN a = b THEN 3 ELSE (degree - a) * 2.0::DOUBLE / (b - a) + 1 END, 6) AS scaled FROM w"))
def vec_rescale(spark, sf):
    d = R.degree_strength(*T.graph(spark, sf)).select("gid", "v", "degree")
    return rounded(X.rescale(d, "degree", ("gid",), 1.0, 3.0))


@query(sql(_CONN | dict(fr="SELECT v, hemi, lobe, avg(y) OVER (PARTITION BY hemi, lobe) AS front FROM reg", ps="SELECT v, row_number() OVER (ORDER BY hemi <> 'L', CASE WHEN hemi = 'L' THEN -front ELSE front END, lobe, v)::INT AS pos, count(*) OVER () AS n FROM fr"), "SELECT v, pos, round(cos(2 * pi() * (pos - 1) / n + 0.5::DOUBLE), 6) AS lx, round(sin(2 * pi() * (pos - 1) / n + 0.5::DOUBLE), 6) AS ly FROM ps"))
def layout(spark, sf):
    return rounded(R.rotate(R.circular_layout(T.regions(spark, sf)), 0.5))


@query(sql(_GRAPH, "SELECT gid, src, dst, CASE WHEN a.g <> b.g THEN 'gray50' ELSE ['red', 'green', 'blue', 'magenta', 'cyan', 'orange'][a.g] END AS color FROM edges JOIN reg a ON a.v = src JOIN reg b ON b.v = dst"))
def graph_colors(spark, sf):
    v, e = T.graph(spark, sf)
    return R.group_colors(v.join(T.modules(spark, sf), "v"), e)[1]


@query(sql(_GRAPH | dict(vals="SELECT gid, v, 'degree' AS measure, degree::DOUBLE AS value FROM deg UNION ALL SELECT gid, v, 'strength', strength FROM deg"), "SELECT measure, gid, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM vals GROUP BY ALL"))
def quantile_summary(spark, sf):
    d = R.degree_strength(*T.graph(spark, sf)).withColumn("degree", F.col("degree").cast("double"))
    long = d.unpivot(["gid", "v"], ["degree", "strength"], "measure", "value")
    return rounded(long.groupBy("measure", "gid").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.25)).alias("q25"), F.percentile("value", F.lit(0.75)).alias("q75")))


# paths and spectra: kernels

_PATHS = _GRAPH | dict(
    bfs="SELECT gid, v AS s, v AS t, 0 AS d FROM verts UNION SELECT b.gid, b.s, h.u, b.d + 1 FROM bfs b JOIN h ON h.gid = b.gid AND h.v = b.t WHERE b.d < 10",
    sp="SELECT gid, s, t, min(d) AS d FROM bfs GROUP BY ALL",
    nodal="SELECT gid, s AS v, sum(CASE WHEN d > 0 THEN 1.0::DOUBLE / d ELSE 0 END) / (SELECT count(*) - 1 FROM reg) AS e, coalesce(sum(d)::DOUBLE / nullif(count(*) - 1, 0), 0) AS lp, max(d) AS ecc, 1.0::DOUBLE / nullif(sum(d), 0) AS clo FROM sp GROUP BY ALL",
)


@query(sql(_PATHS, "SELECT gid, s AS i, t AS j, d::DOUBLE AS d FROM sp WHERE s < t"))
def shortest_paths(spark, sf):
    return M.path_table(*T.graph(spark, sf))


@query(sql(_PATHS, "SELECT gid, v, round(e, 6) AS E_nodal, round(lp, 6) AS Lp, ecc::DOUBLE AS eccentricity, round(clo, 6) AS clo_cent FROM nodal"))
def path_measures(spark, sf):
    which = ["E.nodal", "Lp", "eccentricity", "clo.cent"]
    return rounded(M.wide(M.vertex_measures(*T.graph(spark, sf), which), which, ("gid", "v")))


@query(sql(_PATHS | dict(lp="SELECT gid, avg(d) AS lp, max(d) AS dia FROM sp WHERE s <> t GROUP BY gid"), "SELECT gid, round(avg(e), 6) AS E_global, round(any_value(lp.lp), 6) AS Lp, any_value(dia)::DOUBLE AS diameter FROM nodal JOIN lp USING (gid) GROUP BY gid"))
def graph_paths(spark, sf):
    which = ["E.global", "Lp", "diameter"]
    return rounded(M.wide(M.graph_measures(*T.graph(spark, sf), which), which, ("gid",)))


@query(sql(_PATHS | dict(c="SELECT gid, s AS v, min(t) AS c FROM sp GROUP BY ALL", z="SELECT gid, c, count(*) AS n FROM c GROUP BY ALL", rk="SELECT gid, c, row_number() OVER (PARTITION BY gid ORDER BY n DESC, c) AS comp FROM z"), "SELECT gid, v, comp::DOUBLE AS comp FROM c JOIN rk USING (gid, c)"))
def components(spark, sf):
    return M.wide(M.vertex_measures(*T.graph(spark, sf), ["comp"]), ["comp"], ("gid", "v"))


_LOCAL_EFF = _GRAPH | dict(
    nb="SELECT h.gid, h.v, a.u AS x, b.u AS y FROM verts h JOIN h a ON a.gid = h.gid AND a.v = h.v JOIN h b ON b.gid = h.gid AND b.v = h.v AND a.u <> b.u JOIN h c ON c.gid = h.gid AND c.v = a.u AND c.u = b.u",
    b2="SELECT h.gid, h.v, h.u AS s, h.u AS t, 0 AS d FROM h UNION SELECT b.gid, b.v, b.s, nb.y, b.d + 1 FROM b2 b JOIN nb ON nb.gid = b.gid AND nb.v = b.v AND nb.x = b.t WHERE b.d < 8",
    s2="SELECT gid, v, s, t, min(d) AS d FROM b2 GROUP BY ALL",
    le="SELECT gid, v, sum(CASE WHEN d > 0 THEN 1.0::DOUBLE / d ELSE 0 END) AS s FROM s2 GROUP BY ALL",
)


@query(sql(_LOCAL_EFF, "SELECT gid, v, round(CASE WHEN degree > 1 THEN coalesce(s, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS E_local FROM deg LEFT JOIN le USING (gid, v)"))
def local_efficiency(spark, sf):
    return rounded(M.wide(M.vertex_measures(*T.graph(spark, sf), ["E.local"]), ["E.local"], ("gid", "v")))


_BTW = _PATHS | dict(
    sig="SELECT gid, v AS s, v AS t, 1::DOUBLE AS n, 0 AS d FROM verts UNION ALL SELECT g.gid, g.s, h.u, sum(g.n), g.d + 1 FROM sig g JOIN h ON h.gid = g.gid AND h.v = g.t JOIN sp ON sp.gid = g.gid AND sp.s = g.s AND sp.t = h.u AND sp.d = g.d + 1 WHERE g.d < 10 GROUP BY g.gid, g.s, h.u, g.d",
    bt="SELECT a.gid, a.t AS v, sum(a.n * b.n / c.n) / 2 AS b FROM sig a JOIN sig b ON b.gid = a.gid AND b.s = a.t JOIN sig c ON c.gid = a.gid AND c.s = a.s AND c.t = b.t AND c.d = a.d + b.d WHERE a.s <> a.t AND b.t <> a.t AND a.s <> b.t GROUP BY ALL",
)


@query(sql(_BTW, "SELECT gid, v, round(coalesce(b, 0), 6) AS btwn_cent FROM verts LEFT JOIN bt USING (gid, v)"))
def betweenness(spark, sf):
    return rounded(M.wide(M.vertex_measures(*T.graph(spark, sf), ["btwn.cent"]), ["btwn.cent"], ("gid", "v")))


@query(sql(_BTW | dict(hub="SELECT v.gid, v.v, d.strength, coalesce(bt.b, 0) AS b, cl, lp FROM verts v JOIN clus d USING (gid, v) JOIN nodal USING (gid, v) LEFT JOIN bt USING (gid, v)", rk="SELECT gid, v, row_number() OVER (PARTITION BY gid ORDER BY strength DESC, v) AS a, row_number() OVER (PARTITION BY gid ORDER BY round(b, 6) DESC, v) AS b, row_number() OVER (PARTITION BY gid ORDER BY round(cl, 6), v) AS c, row_number() OVER (PARTITION BY gid ORDER BY round(lp, 6), v) AS d FROM hub"), "SELECT gid, v, (a <= 5)::INT + (b <= 5)::INT + (c <= 5)::INT + (d <= 5)::INT AS hubs FROM rk"))
def hubness(spark, sf):
    v, e = T.graph(spark, sf)
    which = ["btwn.cent", "Lp"]
    m = rounded(M.wide(M.vertex_measures(v, e, which), which, ("gid", "v")))
    c = rounded(R.clustering(v, e).select("gid", "v", "strength", F.col("transitivity").alias("cluster")))
    return R.hubness(m.join(c, ["gid", "v"]).withColumnsRenamed({"btwn_cent": "btwn", "Lp": "lp"}))


def _kernel(name, which, level="vertex", groups=False):
    def fn(spark, sf):
        v, e = T.graph(spark, sf)
        g = {r["v"]: r["g"] for r in T.modules(spark, sf).collect()} if groups else None  # an atlas
        out = (M.vertex_measures if level == "vertex" else M.graph_measures)(v, e, which, g)
        return rounded(M.wide(out, which, ("gid", "v") if level == "vertex" else ("gid",)))

    fn.__name__ = name
    _QUERIES[name] = fn


_kernel("vulnerability", ["vulnerability"])
_kernel("cores", ["coreness", "s.core"])
_kernel("eigen_pagerank", ["ev.cent", "pagerank", "subg.cent", "communicability", "hub.score", "authority.score"])
_kernel("weighted_paths", ["E.nodal.wt", "E.local.wt", "Lp.wt", "vulnerability.wt", "hubs.wt"])
_kernel("module_roles_kernel", ["PC", "z.score", "GC", "PC.wt", "z.score.wt", "GC.wt"], groups=True)
_kernel("graph_measures_all", list(M.GRAPH), "graph")


@query(sql(_KAPPA, "SELECT gid, v, round(1 - sum(kappa * kappa) / (sum(kappa) * sum(kappa)), 6) AS PC FROM verts LEFT JOIN kap USING (gid, v) GROUP BY ALL"))
def participation_kernel(spark, sf):
    v, e = T.graph(spark, sf)
    g = {r["v"]: r["g"] for r in T.modules(spark, sf).collect()}  # an atlas
    return rounded(M.wide(M.vertex_measures(v, e, ["PC"], g), ["PC"], ("gid", "v")))


@query(sql(_BTW | dict(eb="SELECT e.gid, e.src, e.dst, sum(a.n * b.n / c.n) AS b FROM edges e JOIN sig a ON a.gid = e.gid AND a.t = e.src JOIN sig b ON b.gid = e.gid AND b.s = e.dst JOIN sig c ON c.gid = e.gid AND c.s = a.s AND c.t = b.t AND c.d = a.d + b.d + 1 GROUP BY ALL"), "SELECT gid, src, dst, round(b, 6) AS btwn FROM eb"))
def edge_betweenness(spark, sf):
    return rounded(M.edge_betweenness(*T.graph(spark, sf)))


@query()
def supplier_network(spark, sf):
    which = ["Cp", "Lp", "E.global", "mod", "diameter", "assortativity"]
    return rounded(M.wide(B.graph_measures(*T.supplier_graph(spark, sf), which), which, ("gid",)))


for _m in ("louvain", "fast_greedy", "walktrap", "label_prop", "leading_eigen", "edge_betweenness", "spinglass", "infomap"):

    def _community(spark, sf, method=_m):
        return M.communities(*T.graph(spark, sf), method)

    _community.__name__ = f"community_{_m}"
    query()(_community)


# robustness, random graphs


@query()
def robustness_targeted(spark, sf):
    return rounded(M.robustness(*T.graph(spark, sf)))


@query()
def robustness_random(spark, sf):
    return rounded(M.robustness(*T.graph(spark, sf), "edge", "random"))


def _group_graph(spark, sf):
    """One graph a group: mean weights at density 0.3."""
    p = T.pairs(spark, sf).join(T.groups(spark, sf), "sid").groupBy("grp", "i", "j").agg(F.avg("w").alias("w"))
    kept = X.threshold_density(p, T.doubles(spark, "density", 0.3), ("grp",))
    e = kept.select(F.col("grp").alias("gid"), F.col("i").alias("src"), F.col("j").alias("dst"), F.col("w").alias("weight"))
    v = T.groups(spark, sf).select(F.col("grp").alias("gid")).distinct().crossJoin(F.broadcast(T.regions(spark, sf).select("v")))  # an atlas
    return v, e


@query()
def rewired_graphs(spark, sf):
    return M.random_graphs(*_group_graph(spark, sf), 100)


@query()
def clustered_graphs(spark, sf):
    return M.random_graphs(*_group_graph(spark, sf), 3, True)


@query()
def small_world(spark, sf):
    v, e = _group_graph(spark, sf)
    o = M.wide(M.graph_measures(v, e, ["Cp", "Lp"]), ["Cp", "Lp"], ("gid",))
    return rounded(R.small_world(o.withColumnsRenamed({"Cp": "cp", "Lp": "lp"}), M.random_measures(v, e, 100)))


@query()
def rich_club_norm(spark, sf):
    v, e = _group_graph(spark, sf)
    r = M.random_graphs(v, e, 100).withColumn("gid", F.concat("gid", F.lit("#"), F.col("rand_id").cast("string")))
    rv = v.crossJoin(spark.range(100)).select(F.concat("gid", F.lit("#"), F.col("id").cast("string")).alias("gid"), "v")
    rc = R.rich_club(rv, r).select(F.split("gid", "#")[0].alias("gid"), F.split("gid", "#")[1].cast("int").alias("rand_id"), "k", "phi")
    return rounded(R.rich_club_norm(R.rich_club(v, e).select("gid", "k", "phi"), rc))


@query()
def hqs_covariance(spark, sf):
    return rounded(S.hqs_graphs(T.cohort(spark, sf), 100))


# areas, runs, multiple testing

_SWEEP = _RANKED | dict(
    dens="SELECT * FROM (VALUES (0.1::DOUBLE), (0.15::DOUBLE), (0.2::DOUBLE), (0.25::DOUBLE)) d(density)",
    cut="SELECT sid, density, w AS cut FROM ranked, nn, dens WHERE rn = floor(e - e * density)",
    sw="SELECT p.sid, density, i AS src, j AS dst, w AS weight FROM pairs p JOIN cut USING (sid) WHERE w > cut AND w > 0",
    hs="SELECT sid, density, src AS v FROM sw UNION ALL SELECT sid, density, dst FROM sw",
    ds="SELECT s.sid, dens.density, reg.v, count(hs.v) AS k FROM subj s CROSS JOIN dens CROSS JOIN reg LEFT JOIN hs ON hs.sid = s.sid AND hs.density = dens.density AND hs.v = reg.v GROUP BY ALL",
    part="SELECT sid, v, (density - lag(density) OVER q) * (k + lag(k) OVER q) / 2 AS a FROM ds WINDOW q AS (PARTITION BY sid, v ORDER BY density)",
)


def _degree_sweep(spark, sf):
    v, e = T.sweep(spark, sf, 0.1, 0.15, 0.2, 0.25)
    d = R.degree_strength(v.select("gid", "v"), e)
    return d.join(v, ["gid", "v"]).select("sid", "density", "v", "degree")


@query(sql(_SWEEP, "SELECT sid, v, round(abs(sum(a)), 6) AS auc FROM part GROUP BY ALL"))
def auc_thresholds(spark, sf):
    return rounded(R.auc(_degree_sweep(spark, sf), ("sid", "v"), "density", "degree"))


@query(sql(_SWEEP | dict(aa="SELECT sid, v, abs(sum(a)) AS a FROM part GROUP BY ALL"), "SELECT v, round(avg(a) FILTER (grp = 'A') - avg(a) FILTER (grp = 'B'), 6) AS diff FROM aa JOIN grps USING (sid) GROUP BY v"))
def auc_group_diff(spark, sf):
    a = R.auc(_degree_sweep(spark, sf), ("sid", "v"), "density", "degree").join(T.groups(spark, sf), "sid")
    return rounded(a.groupBy("v").agg((F.avg(F.when(F.col("grp") == "A", F.col("auc"))) - F.avg(F.when(F.col("grp") == "B", F.col("auc")))).alias("diff")))


@query(sql(_GRAPH | dict(f="SELECT *, row_number() OVER (PARTITION BY v ORDER BY gid) AS n FROM deg", g="SELECT v, gid, n - row_number() OVER (PARTITION BY v ORDER BY gid) AS run FROM f WHERE degree >= 6"), "SELECT v, run, min(gid) AS first, max(gid) AS last, count(*) AS length FROM g GROUP BY v, run"))
def run_lengths(spark, sf):
    d = R.degree_strength(*T.graph(spark, sf))
    return R.runs(d, ("v",), "gid", F.col("degree") >= 6).withColumn("run", F.col("run").cast("bigint"))


@query(sql(_GRAPH | dict(p="SELECT gid, v, (degree + 1.0::DOUBLE) / 26 AS p FROM deg", rk="SELECT *, row_number() OVER (PARTITION BY gid ORDER BY p) AS r, count(*) OVER (PARTITION BY gid) AS n FROM p"), "SELECT gid, v, round(p, 6) AS p, round(least(1, min(p * n / r) OVER (PARTITION BY gid ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_fdr FROM rk"))
def bh_fdr(spark, sf):
    d = R.degree_strength(*T.graph(spark, sf)).select("gid", "v", ((F.col("degree") + 1.0) / 26).alias("p"))
    return rounded(R.bh_adjust(d, "p", ("gid",)))


# structural covariance

_COHORT = dict(
    co="SELECT (label % 2)::VARCHAR AS grp, lpad(vec_id::VARCHAR, 6, '0') AS sid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings",
    y="SELECT grp, sid, 'd' || lpad(d::VARCHAR, 2, '0') AS region, round(x::DOUBLE, 4) AS value FROM co",
)


def _corr_sql(value: str = "value") -> dict[str, str]:
    return _COHORT | dict(
        yr=f"SELECT grp, sid, region, {value} AS value FROM y",
        pp="SELECT a.grp, a.sid, a.region AS r1, b.region AS r2, a.value AS a, b.value AS b FROM yr a JOIN yr b ON a.sid = b.sid AND a.region < b.region",
        corr_="SELECT grp, r1, r2, count(*) AS n, corr(a, b) AS r FROM pp GROUP BY ALL",
    )


@cohort_query(sql(_corr_sql(), "SELECT grp, r1, r2, n, round(r, 6) AS r FROM corr_"))
def corr_pearson(spark, sf, y):
    return rounded(S.correlations(y))


@cohort_query(sql(_corr_sql("rank() OVER (PARTITION BY grp, region ORDER BY value) + (count(*) OVER (PARTITION BY grp, region, value) - 1) / 2.0"), "SELECT grp, r1, r2, n, round(r, 6) AS r FROM corr_"))
def corr_spearman(spark, sf, y):
    return rounded(S.correlations(y, "spearman"))


@cohort_query(sql(_corr_sql() | dict(rk="SELECT *, row_number() OVER (PARTITION BY grp ORDER BY r) AS rn, count(*) OVER (PARTITION BY grp)::DOUBLE AS e FROM corr_", ct="SELECT grp, density, r AS cut FROM rk, (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (1.0::DOUBLE)) d(density) WHERE rn = greatest(floor(e - e * density), 1)"), "SELECT grp, r1, r2, n, round(r, 6) AS r, density FROM corr_ JOIN ct USING (grp) WHERE r > cut"))
def corr_density_graph(spark, sf, y):
    return rounded(S.correlation_edges(S.correlations(y), T.doubles(spark, "density", 0.1, 0.3, 1.0)))


@query(sql(_corr_sql(), "SELECT grp, r1, r2, n, round(r, 6) AS r, round(" + Q.t_two_sided("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)") + ", 6) AS p FROM corr_"))
def corr_p_values(spark, sf):
    return rounded(S.correlation_p(S.correlations(T.cohort(spark, sf))))


@cohort_query(sql(_corr_sql(), "SELECT a.r1, a.r2, round((atanh(a.r) - atanh(b.r)) / sqrt(1.0::DOUBLE / (a.n - 3) + 1.0::DOUBLE / (b.n - 3)), 6) AS z FROM corr_ a JOIN corr_ b ON a.r1 = b.r1 AND a.r2 = b.r2 AND a.grp = '0' AND b.grp = '1'"))
def cor_diff_z(spark, sf, y):
    c = S.correlations(y)
    a, b = c.where("grp = '0'"), c.where("grp = '1'").select("r1", "r2", F.col("r").alias("rb"), F.col("n").alias("nb"))
    return rounded(a.join(b, ["r1", "r2"]).select("r1", "r2", S.fisher_z(F.col("r"), F.col("n"), F.col("rb"), F.col("nb")).alias("z")))


_LOO = _corr_sql() | dict(
    mo="SELECT *, count(*) OVER q AS n, sum(a) OVER q AS sx, sum(b) OVER q AS sy, sum(a * a) OVER q AS sxx, sum(b * b) OVER q AS syy, sum(a * b) OVER q AS sxy FROM pp WINDOW q AS (PARTITION BY grp, r1, r2)",
    lo="SELECT grp, sid, r1, r2, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r, (sxy - a * b - (sx - a) * (sy - b) / (n - 1)) / sqrt((sxx - a * a - (sx - a) * (sx - a) / (n - 1)) * (syy - b * b - (sy - b) * (sy - b) / (n - 1))) AS q FROM mo",
)


@cohort_query(sql(_LOO | dict(e="SELECT grp, sid, r1 AS region, abs(r - q) AS d FROM lo UNION ALL SELECT grp, sid, r2, abs(r - q) FROM lo"), "SELECT grp, sid, region, round(sum(d), 6) AS rc FROM e GROUP BY ALL"))
def loo_regional(spark, sf, y):
    return rounded(S.loo_regional(y))


@cohort_query(sql(_LOO, "SELECT grp, sid, round(1 - corr(r, q), 6) AS ic FROM lo GROUP BY ALL"))
def loo_global(spark, sf, y):
    return rounded(S.loo_global(y))


@cohort_query(sql(_corr_sql() | dict(b0="SELECT r1, r2, count(*) AS n, sum(a) AS sx, sum(b) AS sy, sum(a * a) AS sxx, sum(b * b) AS syy, sum(a * b) AS sxy FROM pp WHERE grp = '0' GROUP BY ALL", ao="SELECT pp.grp, sid, pp.r1, pp.r2, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r, (sxy + a * b - (sx + a) * (sy + b) / (n + 1)) / sqrt((sxx + a * a - (sx + a) * (sx + a) / (n + 1)) * (syy + b * b - (sy + b) * (sy + b) / (n + 1))) AS q FROM pp JOIN b0 USING (r1, r2) WHERE grp = '1'", e="SELECT grp, sid, r1 AS region, abs(r - q) AS d FROM ao UNION ALL SELECT grp, sid, r2, abs(r - q) FROM ao"), "SELECT grp, sid, region, round(sum(d), 6) AS rc FROM e GROUP BY ALL"))
def aop_regional(spark, sf, y):
    return rounded(S.aop_regional(y, "0"))


@cohort_query(sql(_LOO | dict(e="SELECT grp, sid, r1 AS region, abs(r - q) AS d FROM lo UNION ALL SELECT grp, sid, r2, abs(r - q) FROM lo", rc="SELECT grp, sid, region, sum(d) AS rc FROM e GROUP BY ALL", ct="SELECT *, avg(rc) OVER (PARTITION BY grp, region) + 2 * stddev_samp(rc) OVER (PARTITION BY grp, region) AS cut FROM rc"), "SELECT grp, region, round(min(rc), 6) AS min, round(median(rc), 6) AS median, round(avg(rc), 6) AS mean, round(max(rc), 6) AS max, round(stddev_samp(rc), 6) AS sd, round(stddev_samp(rc) / sqrt(count(*)), 6) AS se, sum((rc > cut)::INT)::BIGINT AS outliers FROM ct GROUP BY grp, region"))
def ic_summary(spark, sf, y):
    return rounded(S.contribution_summary(S.loo_regional(y)))


@query(sql(_LOO | dict(gl="SELECT grp, sid, 1 - corr(r, q) AS ic FROM lo GROUP BY ALL"), "SELECT grp, " + ", ".join(f"round(quantile_cont(ic, {x}::DOUBLE), 6) AS q{int(100 * x)}" for x in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)) + ", round(avg(ic), 6) AS mean FROM gl GROUP BY grp"))
def ic_global_summary(spark, sf):
    return rounded(S.global_summary(S.loo_global(T.cohort(spark, sf))))


def _cohort_covars(spark, sf):
    return T.cohort(spark, sf, 1).select("sid", "grp").orderBy("sid").toPandas()  # a row a subject


_TWO_RESID = _COHORT | dict(m="SELECT *, avg(value) OVER q AS mu, count(*) OVER q AS n FROM y WINDOW q AS (PARTITION BY grp, region)", e="SELECT *, value - mu AS e, sum((value - mu) * (value - mu)) OVER (PARTITION BY region) AS rss, count(*) OVER (PARTITION BY region) AS nn FROM m")


@cohort_query(sql(_TWO_RESID, "SELECT grp, sid, region, round(e / sqrt((rss - e * e / (1 - 1.0::DOUBLE / n)) / (nn - 3) * (1 - 1.0::DOUBLE / n)), 6) AS value FROM e"))
def residuals_group(spark, sf, y):
    return rounded(S.residuals(y, _cohort_covars(spark, sf)))


@query(sql(_COHORT | dict(hm="SELECT *, avg(value) OVER (PARTITION BY sid, d <= dims // 2) AS m FROM (SELECT co.grp, co.sid, co.d, 'd' || lpad(co.d::VARCHAR, 2, '0') AS region, round(co.x::DOUBLE, 4) AS value, max(co.d) OVER () AS dims FROM co)", rg="SELECT grp, region, count(*) AS n, avg(m) AS mm, avg(value) AS mv, sum(m * m) - count(*) * avg(m) * avg(m) AS sxx, regr_slope(value, m) AS slope FROM hm GROUP BY ALL", rs="SELECT hm.grp, sid, region, n, value - mv - slope * (m - mm) AS e, 1.0::DOUBLE / n + (m - mm) * (m - mm) / sxx AS h FROM hm JOIN rg USING (grp, region)", rt="SELECT *, sum(e * e) OVER (PARTITION BY grp, region) AS rss FROM rs"), "SELECT grp, sid, region, round(e / sqrt((rss - e * e / (1 - h)) / (n - 3) * (1 - h)), 6) AS value FROM rt"))
def residuals_by_hemisphere(spark, sf):
    return rounded(S.residuals(T.cohort(spark, sf), _cohort_covars(spark, sf), by_group=True, hemi_mean=True))


@cohort_query(sql(_COHORT, "SELECT grp, sid, region, value FROM y WHERE abs(value) > (SELECT abs(avg(value) + 2 * stddev_samp(value)) FROM y)"))
def residual_outliers(spark, sf, y):
    return S.residual_outliers(y.drop("hemi"))


@cohort_query(sql(_COHORT | dict(q="SELECT *, row_number() OVER (PARTITION BY region ORDER BY value, sid) AS r, count(*) OVER (PARTITION BY region) AS n FROM y"), "SELECT grp, sid, region, value, round((r - CASE WHEN n <= 10 THEN 0.375::DOUBLE ELSE 0.5::DOUBLE END) / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375::DOUBLE ELSE 0.5::DOUBLE END), 6) AS position FROM q"))
def residual_qq(spark, sf, y):
    return rounded(S.qq(y.drop("hemi")))


@query()
def permute_groups(spark, sf):
    return rounded(S.permutation_summary(S.permute_groups(T.cohort(spark, sf), [0.2, 0.3]), 5000))


@query()
def permute_vertex(spark, sf):
    return rounded(S.permutation_summary(S.permute_groups(T.cohort(spark, sf), [0.2], 5000, "vertex", "degree"), 5000))


@query()
def boot_global(spark, sf):
    return rounded(S.bootstrap_summary(S.bootstrap(T.cohort(spark, sf), [0.2, 0.3], "E.global")))


# linear models


@query(sql(_GRAPH | dict(ss="SELECT sid, v, coalesce(sum(w), 0)::DOUBLE AS value FROM subj CROSS JOIN reg LEFT JOIN (SELECT sid, i AS v, w FROM sym UNION ALL SELECT sid, j, w FROM sym) USING (sid, v) GROUP BY ALL", st="SELECT 'r' || lpad(v::VARCHAR, 2, '0') AS region, avg(value) FILTER (grp = 'B') - avg(value) FILTER (grp = 'A') AS gamma, (var_samp(value) FILTER (grp = 'A') * (count(*) FILTER (grp = 'A') - 1) + var_samp(value) FILTER (grp = 'B') * (count(*) FILTER (grp = 'B') - 1)) / (count(*) - 2) AS s2, 1.0::DOUBLE / count(*) FILTER (grp = 'A') + 1.0::DOUBLE / count(*) FILTER (grp = 'B') AS c FROM ss JOIN grps USING (sid) GROUP BY v"), "SELECT region, 'Contrast 1' AS contrast, round(gamma, 6) AS gamma, round(sqrt(s2 * c), 6) AS se, round(gamma / sqrt(s2 * c), 6) AS stat FROM st"))
def glm_two_group(spark, sf):
    out = G.glm(T.strengths(spark, sf), T.covars_table(spark, sf, "grp"), [[0, 1]])
    return rounded(out.select("region", "contrast", "gamma", "se", "stat"))


_ANCOVA = _GRAPH | dict(
    cv="SELECT strftime(o_orderdate, '%Y-%m') AS sid, sum(round(o_totalprice * 100)::BIGINT) / count(*)::DOUBLE / 1e7 AS age FROM orders GROUP BY ALL",
    ss="SELECT sid, v, grp, age, coalesce(sum(w), 0)::DOUBLE AS value FROM grps JOIN cv USING (sid) CROSS JOIN reg LEFT JOIN (SELECT sid, i AS v, w FROM sym UNION ALL SELECT sid, j, w FROM sym) USING (sid, v) GROUP BY ALL",
    ce="SELECT *, (grp = 'B')::INT::DOUBLE AS b FROM ss",
    fw="SELECT v, regr_slope(value, b) AS s1, regr_intercept(value, b) AS i1, regr_slope(age, b) AS s2, regr_intercept(age, b) AS i2 FROM ce GROUP BY v",
    rs="SELECT v, value - i1 - s1 * b AS ry, age - i2 - s2 * b AS rx FROM ce JOIN fw USING (v)",
    st="SELECT v, sum(rx * ry) / sum(rx * rx) AS beta, (sum(ry * ry) - sum(rx * ry) * sum(rx * ry) / sum(rx * rx)) / (count(*) - 3) AS s2, sum(rx * rx) AS sxx FROM rs GROUP BY v",
)


_MODEL_ROWS = _GRAPH | dict(
    cv="SELECT strftime(o_orderdate, '%Y-%m') AS sid, sum(round(o_totalprice * 100)::BIGINT) / count(*)::DOUBLE / 1e7 AS age, count(*)::DOUBLE AS load, 'S' || (any_value(month(o_orderdate)) % 3) AS scanner FROM orders GROUP BY ALL",
    mr="SELECT 'r' || lpad(v::VARCHAR, 2, '0') AS region, sid, grp, age, load, scanner, (grp = 'B')::INT AS b, coalesce(sum(w), 0)::DOUBLE AS value FROM grps JOIN cv USING (sid) CROSS JOIN reg LEFT JOIN (SELECT sid, i AS v, w FROM sym UNION ALL SELECT sid, j, w FROM sym) USING (sid, v) GROUP BY ALL",
)
_FIT = _MODEL_ROWS | Q.least_squares(["1", "age", "b"], "mr")
_SEEN = _FIT | Q.observed(3)
_OBS = "region, sid, round(fitted, 3) AS fitted, round(e, 3) AS resid, round(h, 6) AS hat, round(rstandard, 6) AS rstandard, "
_FLAGS = "flag_dfb, flag_dffit, flag_cov_r, flag_cook_d, flag_hat"
_TESTED = "round(estimate, 3) AS estimate, round(se, 3) AS se, round(estimate - hi * se, 3) AS ci_low, round(estimate + hi * se, 3) AS ci_high, round(estimate / se, 6) AS t, round(" + Q.t_two_sided("(estimate / se)", "cr.df") + ", 6) AS p"
_LARGE = ("estimate", "se", "ci_low", "ci_high", "gamma", "fitted", "resid", "sum_sq", "mean_sq")


def _coefficient_sql(x: list[str], terms: list[str]) -> str:
    parts = _MODEL_ROWS | Q.least_squares(x, "mr") | dict(cr=Q.coefficient_rows(terms), tq=Q.quantile("(SELECT min(df) FROM sg)"))
    return sql(parts, f"SELECT region, term, {_TESTED} FROM cr, tq WHERE k = 56")


def _contrast_sql(select: str, contrasts: dict[str, int]) -> str:
    """Statistics of single coefficients, by contrast: cs(region, contrast, ..., p_fdr)."""
    rows = " UNION ALL ".join(f"SELECT region, '{c}' AS contrast, beta[{i}] AS gamma, sqrt(s2 * s[{i}][{i}]) AS se, df FROM co JOIN sg USING (region), inv" for c, i in contrasts.items())
    return sql(_FIT | dict(
        cr=rows, tq=Q.quantile("(SELECT min(df) FROM sg)"),
        c1="SELECT region, contrast, gamma, se, gamma / se AS stat, " + Q.t_two_sided("(gamma / se)", "cr.df") + " AS p, gamma - hi * se AS ci_low, gamma + hi * se AS ci_high FROM cr, tq WHERE k = 56",
        c2="SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY p) AS r, count(*) OVER (PARTITION BY contrast) AS n FROM c1",
        cs="SELECT *, least(1, min(p * n / r) OVER (PARTITION BY contrast ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS p_fdr FROM c2",
    ), select)


@query(sql(_ANCOVA, "SELECT 'r' || lpad(v::VARCHAR, 2, '0') AS region, round(beta, 4) AS estimate, round(sqrt(s2 / sxx), 4) AS se, round(beta / sqrt(s2 / sxx), 6) AS t FROM st"))
def glm_ancova(spark, sf):
    out = G.coefficients(T.strengths(spark, sf), T.covars_table(spark, sf, "age", "grp")).where("term = 'age'")
    return out.select("region", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), r6("t"))


@query(sql(_ANCOVA, "SELECT 'r' || lpad(v::VARCHAR, 2, '0') AS region, round(beta * beta / (s2 / sxx), 6) AS stat FROM st"))
def glm_f_contrast(spark, sf):
    out = G.glm(T.strengths(spark, sf), T.covars_table(spark, sf, "age", "grp"), [[[0, 1, 0]]], "f")
    return rounded(out.select("region", "stat"))


@query(sql(_MODEL_ROWS | dict(mc="SELECT * EXCLUDE (b), age - avg(age) OVER (PARTITION BY region) AS ac, CASE WHEN grp = 'B' THEN 1 ELSE -1 END AS b, (scanner = 'S1')::INT - (scanner = 'S0')::INT AS k1, (scanner = 'S2')::INT - (scanner = 'S0')::INT AS k2 FROM mr", mk="SELECT mc.*, a.ac AS am FROM mc JOIN (SELECT sid, any_value(ac) AS ac FROM mc GROUP BY sid) a USING (sid)") | Q.least_squares(["1", "am", "b", "k1", "k2", "am * b"], "mk") | dict(cr=Q.coefficient_rows(["Intercept", "age", "grpB", "scannerS1", "scannerS2", "age:grpB"]), tq=Q.quantile("(SELECT min(df) FROM sg)")), f"SELECT region, term, {_TESTED} FROM cr, tq WHERE k = 56"))
def glm_effects_coding(spark, sf):
    return rounded(G.coefficients(T.strengths(spark, sf), T.covars_table(spark, sf, "age", "grp", "scanner"), coding="effects", interactions=("age", "grp"), center=True), _LARGE)


@query(_coefficient_sql(["age", "grp = 'A'", "b"], ["age", "grpA", "grpB"]))
def glm_cell_means(spark, sf):
    return rounded(G.coefficients(T.strengths(spark, sf), T.covars_table(spark, sf, "age", "grp"), coding="cell.means"), _LARGE)


@query(sql(_SEEN, f"SELECT {_OBS} round(rstudent, 6) AS rstudent, round(cooks, 6) AS cooks, round(dffits, 6) AS dffits, round(covratio, 6) AS covratio, {_FLAGS} FROM od"))
def glm_observations(spark, sf):
    return rounded(G.observations(T.strengths(spark, sf), T.covars_table(spark, sf, "age", "grp")), _LARGE)


@query(sql(_ANCOVA | dict(rr="SELECT v, (count(*) - 3) * any_value(st.s2) AS rss, sum(power(value - m, 2)) AS tss, count(*) AS n, any_value(st.s2) AS s2 FROM (SELECT *, avg(value) OVER (PARTITION BY v) AS m FROM ce) JOIN st USING (v) GROUP BY v"), "SELECT 'r' || lpad(v::VARCHAR, 2, '0') AS region, round(sqrt(s2), 4) AS sigma, round(1 - rss / tss, 6) AS r2, round(1 - rss / tss * (n - 1) / (n - 3), 6) AS adj_r2, round(n * ln(rss / n) + 6, 4) AS aic FROM rr"))
def glm_fit_statistics(spark, sf):
    out = G.fit_statistics(T.strengths(spark, sf), T.covars_table(spark, sf, "age", "grp"))
    return out.select("region", F.round("sigma", 4).alias("sigma"), r6("r2"), r6("adj_r2"), F.round("aic", 4).alias("aic"))


@query(sql(_MODEL_ROWS | Q.least_squares(["1", "age", "b", "scanner = 'S1'", "scanner = 'S2'"], "mr") | dict(
        ta="SELECT region, 'age' AS term, pow(beta[2], 2) / s[2][2] AS ss, 1 AS k FROM co, inv UNION ALL SELECT region, 'grp', pow(beta[3], 2) / s[3][3], 1 FROM co, inv UNION ALL SELECT region, 'scanner', (pow(beta[4], 2) * s[5][5] - 2 * beta[4] * beta[5] * s[4][5] + pow(beta[5], 2) * s[4][4]) / (s[4][4] * s[5][5] - s[4][5] * s[4][5]), 2 FROM co, inv",
        tb="SELECT *, rss + sum(ss) OVER (PARTITION BY region) AS total, ss / k / s2 AS f FROM ta JOIN sg USING (region)",
    ), "SELECT region, term, round(ss, 3) AS sum_sq, round(ss / k, 3) AS mean_sq, k::DOUBLE AS df, round(f, 6) AS f, round(ss / total, 6) AS eta_sq, round(ss / (ss + rss), 6) AS partial_eta_sq, round((ss - k * s2) / (total + s2), 6) AS omega_sq, round((ss - k * s2) / (ss + (n - k) * s2), 6) AS partial_omega_sq, round(CASE WHEN k = 1 THEN " + Q.t_two_sided("sqrt(f)", "tb.df") + " ELSE pow(1 + 2 * f / tb.df, -tb.df / 2.0::DOUBLE) END, 6) AS p FROM tb UNION ALL SELECT region, 'Residuals', round(rss, 3), round(s2, 3), df::DOUBLE, NULL, NULL, NULL, NULL, NULL, NULL FROM sg"))
def glm_anova(spark, sf):
    return rounded(G.anova(T.strengths(spark, sf), T.covars_table(spark, sf, "age", "grp", "scanner")), _LARGE)


@query()
def glm_permutation(spark, sf):
    y, c = T.strengths(spark, sf), T.covars_table(spark, sf, "age", "grp")
    null = G.permutation_null(y, c, [[0, 0, 1]])
    return rounded(G.glm_permuted(G.glm(y, c, [[0, 0, 1]]), null))


@query(sql(_MODEL_ROWS | dict(
    rw="SELECT region, regr_slope(value, b) AS s1, regr_intercept(value, b) AS i1, regr_slope(load, b) AS s2, regr_intercept(load, b) AS i2 FROM mr GROUP BY region",
    rr="SELECT region, value - i1 - s1 * b AS rx, load - i2 - s2 * b AS ry FROM mr JOIN rw USING (region)",
    rt="SELECT region, count(*) - 3 AS df, sum(rx * ry) / sum(rx * rx) / sqrt((sum(ry * ry) - pow(sum(rx * ry), 2) / sum(rx * rx)) / (count(*) - 3) / sum(rx * rx)) AS stat FROM rr GROUP BY region",
), "SELECT region, 'strength' AS contrast, round(stat, 6) AS stat, round(" + Q.t_two_sided("stat", "df") + ", 6) AS p FROM rt"))
def glm_region_designs(spark, sf):
    """A month's load explained by each nation's strength and the group: a design by region."""
    c = T.covars_table(spark, sf, "load", "grp")
    return rounded(G.glm(T.strengths(spark, sf), c, {"strength": [0, 1, 0]}, outcome="load", measure="strength").select("region", "contrast", "stat", "p"))


@query()
def glm_region_permutation(spark, sf):
    y, c = T.strengths(spark, sf), T.covars_table(spark, sf, "load", "grp")
    how = {"outcome": "load", "measure": "strength"}
    return rounded(G.glm_permuted(G.glm(y, c, [[0, 1, 0]], **how), G.permutation_null(y, c, [[0, 1, 0]], **how)))


@query()
def nbs(spark, sf):
    return rounded(G.nbs(T.pairs(spark, sf), T.covars_table(spark, sf, "grp"), [[0, 1]], p_init=0.05)[0])


@query(sql(_PAIRS | dict(s="SELECT i, j, avg(w) FILTER (grp = 'B') - avg(w) FILTER (grp = 'A') AS g, (var_samp(w) FILTER (grp = 'A') * (count(*) FILTER (grp = 'A') - 1) + var_samp(w) FILTER (grp = 'B') * (count(*) FILTER (grp = 'B') - 1)) / (count(*) - 2) * (1.0::DOUBLE / count(*) FILTER (grp = 'A') + 1.0::DOUBLE / count(*) FILTER (grp = 'B')) AS v FROM pairs JOIN grps USING (sid) GROUP BY ALL"), "SELECT printf('%06d-%06d', i, j) AS region, round(g / sqrt(v), 6) AS stat FROM s WHERE v > 0"))
def nbs_edge_statistics(spark, sf):
    p = T.pairs(spark, sf).select(F.format_string("%06d-%06d", "i", "j").alias("region"), "sid", F.col("w").alias("value"))
    return rounded(G.glm(p, T.covars_table(spark, sf, "grp"), [[0, 1]]).where("stat IS NOT NULL").select("region", "stat"))


@query()
def mtpc(spark, sf):
    y = _degree_sweep(spark, sf).select(F.col("density").alias("tau"), F.format_string("r%02d", "v").alias("region"), "sid", F.col("degree").cast("double").alias("value"))
    return rounded(G.mtpc(y, T.covars_table(spark, sf, "grp"), [[0, 1]])[1])


@query()
def mediation(spark, sf):
    c = T.covars_table(spark, sf, "grp", "age", "load")
    c["treat"] = (c.pop("grp") == "B").astype(float)
    return rounded(G.mediation(T.strengths(spark, sf), c, "load", "treat", ("age",)))


@query(sql(_ANCOVA | dict(zz="SELECT *, 1.0::DOUBLE AS one FROM ce", ld="SELECT strftime(o_orderdate, '%Y-%m') AS sid, count(*)::DOUBLE AS load FROM orders GROUP BY ALL", f1="SELECT v, regr_slope(value, b) AS a FROM ce GROUP BY v", f2="SELECT v, regr_slope(value, b) AS s1, regr_intercept(value, b) AS i1, regr_slope(load, b) AS s2, regr_intercept(load, b) AS i2 FROM ce JOIN ld USING (sid) GROUP BY v", r2="SELECT v, value - i1 - s1 * b AS rm, load - i2 - s2 * b AS ry FROM ce JOIN ld USING (sid) JOIN f2 USING (v)", f3="SELECT v, sum(rm * ry) / sum(rm * rm) AS bb FROM r2 GROUP BY v"), "SELECT 'r' || lpad(v::VARCHAR, 2, '0') AS region, round(a * bb, 6) AS d_avg FROM f1 JOIN f3 USING (v)"))
def mediation_point(spark, sf):
    c = T.covars_table(spark, sf, "grp", "load")
    c["treat"] = (c.pop("grp") == "B").astype(float)
    out = G.mediation(T.strengths(spark, sf), c, "load", "treat", boot=False).where("effect = 'd_avg'")
    return rounded(out.select("region", F.col("estimate").alias("d_avg")))


# models as objects, and summaries

_STRENGTH = _PAIRS | dict(ss="SELECT sid, grp, v, 'r' || lpad(v::VARCHAR, 2, '0') AS region, coalesce(sum(w), 0)::DOUBLE AS value FROM grps CROSS JOIN reg LEFT JOIN (SELECT sid, i AS v, w FROM sym UNION ALL SELECT sid, j, w FROM sym) USING (sid, v) GROUP BY ALL")


def _model(spark, sf, *columns, **kw):
    return O.LinearModel(T.strengths(spark, sf), T.covars_table(spark, sf, *columns), **kw)


@query(sql(_STRENGTH | dict(q="SELECT region, count(*) FILTER (grp = 'A') AS na, count(*) FILTER (grp = 'B') AS nb, ((count(*) FILTER (grp = 'A') - 1) * var_samp(value) FILTER (grp = 'A') + (count(*) FILTER (grp = 'B') - 1) * var_samp(value) FILTER (grp = 'B')) / (count(*) - 2) AS s2 FROM ss GROUP BY region"), "SELECT region, 'Intercept' AS row, 'Intercept' AS col, round(s2 / na, 4) AS value FROM q UNION ALL SELECT region, 'Intercept', 'grpB', round(-s2 / na, 4) FROM q UNION ALL SELECT region, 'grpB', 'Intercept', round(-s2 / na, 4) FROM q UNION ALL SELECT region, 'grpB', 'grpB', round(s2 / na + s2 / nb, 4) FROM q"))
def glm_vcov(spark, sf):
    return _model(spark, sf, "grp").vcov().withColumn("value", F.round("value", 4))


@query(sql(_STRENGTH | dict(z="SELECT region, sid, grp, value - avg(value) OVER (PARTITION BY region, grp) AS e, count(*) OVER (PARTITION BY region, grp) AS n FROM ss"), "SELECT region, sid, grp AS term, round(e / (1 - 1.0::DOUBLE / n), 4) AS resid FROM z"))
def glm_predictive_residuals(spark, sf):
    m = _model(spark, sf, "grp")
    return m.rstandard("predictive").join(T.groups(spark, sf), "sid").select("region", "sid", F.col("grp").alias("term"), F.round("rstandard", 4).alias("resid"))


@query(sql(_FIT, "SELECT region, sid, 'age' AS term, round(e + x[2] * beta[2] - avg(x[2] * beta[2]) OVER q, 3) AS resid FROM ob JOIN co USING (region) WINDOW q AS (PARTITION BY region) UNION ALL SELECT region, sid, 'grp', round(e + x[3] * beta[3] - avg(x[3] * beta[3]) OVER q, 3) FROM ob JOIN co USING (region) WINDOW q AS (PARTITION BY region)"))
def glm_partial_residuals(spark, sf):
    return rounded(_model(spark, sf, "age", "grp").residuals("partial"), _LARGE)


@query(sql(_SEEN, " UNION ALL ".join(f"SELECT region, sid, '{t}' AS term, round(dfbetas[{i}], 6) AS dfbeta FROM od" for i, t in enumerate(("Intercept", "age", "grpB"), 1))))
def glm_dfbetas(spark, sf):
    return rounded(_model(spark, sf, "age", "grp").dfbeta(True))


@query(sql(_SEEN, f"SELECT {_OBS} round(rstudent, 6) AS rstudent, round(cooks, 6) AS cooks, round(dffits, 6) AS dffits, round(covratio, 6) AS covratio, {_FLAGS}, round(dfbetas[1], 6) AS \"Intercept\", round(dfbetas[2], 6) AS age, round(dfbetas[3], 6) AS \"grpB\" FROM od WHERE flag_dfb OR flag_dffit OR flag_cov_r OR flag_cook_d OR flag_hat"))
def glm_influence(spark, sf):
    return rounded(_model(spark, sf, "age", "grp").influence_wide(), _LARGE)


@query(sql(_SEEN, f"SELECT {_OBS} round(cooks, 6) AS cooks, round(sqrt(abs(rstandard)), 6) AS scale, round((row_number() OVER (PARTITION BY region ORDER BY rstandard, sid) - 0.5::DOUBLE) / n, 6) AS quantile_at, row_number() OVER (PARTITION BY region ORDER BY cooks DESC, sid)::INT AS cooks_rank, abs(e) > avg(abs(e)) OVER q + 2 * stddev_samp(abs(e)) OVER q AS outlier, round(h / (1 - h), 6) AS leverage FROM od WINDOW q AS (PARTITION BY region)"))
def glm_diagnostics(spark, sf):
    return rounded(P.diagnostics(_model(spark, sf, "age", "grp").observations()), _LARGE)


@query(sql(_MODEL_ROWS | Q.least_squares(["1", "age", "load", "b", "scanner = 'S1'", "scanner = 'S2'"], "mr") | dict(
        cn="SELECT g0.m AS m, s FROM g0, inv",
        cc="SELECT s, [[m[i][j] - m[1][i] * m[1][j] / m[1][1] for j in range(1, 7)] for i in range(1, 7)] AS c FROM cn",
        vf="SELECT 'age' AS term, s[2][2] * c[2][2] AS g, 1 AS df FROM cc UNION ALL SELECT 'load', s[3][3] * c[3][3], 1 FROM cc UNION ALL SELECT 'grp', s[4][4] * c[4][4], 1 FROM cc UNION ALL SELECT 'scanner', (s[5][5] * s[6][6] - pow(s[5][6], 2)) * (c[5][5] * c[6][6] - pow(c[5][6], 2)), 2 FROM cc",
    ), "SELECT term, round(g, 6) AS gvif, df::BIGINT AS df, round(pow(g, 1 / (2.0::DOUBLE * df)), 6) AS gvif_scaled FROM vf"))
def glm_vif(spark, sf):
    return rounded(spark.createDataFrame(_model(spark, sf, "age", "load", "grp", "scanner").vif(), "term string, gvif double, df long, gvif_scaled double"))


@query(_contrast_sql("SELECT region, contrast, round(gamma, 3) AS gamma, round(se, 3) AS se, round(stat, 6) AS stat, round(p, 6) AS p, round(ci_low, 3) AS ci_low, round(ci_high, 3) AS ci_high, round(p_fdr, 6) AS p_fdr FROM cs WHERE p < 0.2", {"B over A": 3}))
def glm_summary(spark, sf):
    return rounded(_model(spark, sf, "age", "grp", contrasts={"B over A": [0, 0, 1]}).summary(alpha=0.2), _LARGE)


@query(_contrast_sql("SELECT contrast AS gid, region, right(region, 2)::INT AS v, round(gamma, 3) AS gamma, round(se, 3) AS se, round(stat, 6) AS stat, round(1 - p, 6) AS p, round(ci_low, 3) AS ci_low, round(ci_high, 3) AS ci_high, round(1 - p_fdr, 6) AS p_fdr FROM cs", {"age": 2, "B over A": 3}))
def glm_result_graphs(spark, sf):
    stats = _model(spark, sf, "age", "grp", contrasts={"age": [0, 1, 0], "B over A": [0, 0, 1]}).statistics()
    atlas = T.regions(spark, sf).withColumn("name", F.format_string("r%02d", "v"))
    return rounded(Networks.of_results(stats, atlas).vertices, _LARGE)


@query()
def mediation_wide(spark, sf):
    return rounded(O.mediation_summary(mediation(spark, sf)))


# tables behind figures


@query(sql(_STRENGTH | dict(q="SELECT region, grp, min(value) AS lo, max(value) AS hi, count(*) AS n, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM ss GROUP BY ALL", w="SELECT *, CASE WHEN iqr > 0 THEN 2 * iqr / cbrt(n) WHEN hi > lo THEN hi - lo ELSE 1 END AS width FROM q", b="SELECT ss.region, ss.grp, least(floor((value - lo) / width), greatest(1, ceil((hi - lo) / width)) - 1)::INT AS bin, lo, width FROM ss JOIN w ON ss.region = w.region AND ss.grp = w.grp"), "SELECT region, grp, bin, round(lo + width * bin, 6) AS low, round(lo + width * (bin + 1), 6) AS high, count(*) AS n FROM b GROUP BY ALL"))
def histogram_bins(spark, sf):
    return rounded(P.histogram(T.strengths(spark, sf).join(T.groups(spark, sf), "sid")))


@query(sql(_STRENGTH | dict(q="SELECT grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, avg(value) AS mean, count(*) AS n FROM ss GROUP BY grp", e="SELECT grp, min(value) AS low, max(value) AS high FROM ss JOIN q USING (grp) WHERE value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) GROUP BY grp"), "SELECT grp, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(mean, 6) AS mean, n, low, high FROM q JOIN e USING (grp)"))
def box_distribution(spark, sf):
    return rounded(P.distribution(T.strengths(spark, sf).join(T.groups(spark, sf), "sid"), "value"))


@query(sql(_STRENGTH, "SELECT region, grp, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(*)), 6) AS se, count(*) AS n FROM ss GROUP BY ALL"))
def group_means(spark, sf):
    return rounded(P.group_means(T.strengths(spark, sf).join(T.groups(spark, sf), "sid")))


@query(sql(_GRAPH | dict(st="SELECT gid, lag(gid) OVER (ORDER BY gid) AS before FROM (SELECT DISTINCT gid FROM edges)"), "SELECT gid, src, dst FROM edges JOIN st USING (gid) WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.gid = st.before AND o.src = edges.src AND o.dst = edges.dst)"))
def edge_changes(spark, sf):
    return P.edge_changes(T.graph(spark, sf)[1].withColumn("month", F.col("gid")), "month")


@query(sql(_CONN, "SELECT v, -y AS lx, z AS ly FROM reg WHERE hemi = 'L'"))
def sagittal_positions(spark, sf):
    return P.positions(T.regions(spark, sf), "sagittal.left")


@query(sql(_CONN, "SELECT v, y AS lx, z AS ly FROM reg WHERE hemi = 'R'"))
def sagittal_positions_right(spark, sf):
    return P.positions(T.regions(spark, sf), "sagittal.right")


@query(sql(_GRAPH, "SELECT gid, lobe, count(*) AS n FROM verts JOIN reg USING (v) GROUP BY ALL"))
def legend_counts(spark, sf):
    v, _ = T.graph(spark, sf)
    return P.legend(v.join(T.regions(spark, sf), "v"), "lobe")


# collections


@query(sql(_GRAPH, "SELECT gid, " + ", ".join(f"max(degree) FILTER (v = {v})::DOUBLE AS r{v:02d}" for v in range(1, 26)) + " FROM deg GROUP BY gid"))
def degree_wide(spark, sf):
    """A row for each graph, a column for each region."""
    v, e = T.graph(spark, sf)
    atlas = T.regions(spark, sf).withColumn("name", F.format_string("r%02d", "v"))
    n = Networks.from_edges(e, atlas, v.select("gid").distinct()).measured(["degree"], [])
    return n.outcome_wide("degree").withColumnRenamed("sid", "gid")


@query(sql(_GRAPH | dict(k="SELECT v FROM reg WHERE hemi = 'L'"), "SELECT gid, src, dst, weight FROM edges SEMI JOIN k ON k.v = src WHERE dst IN (SELECT v FROM k)"))
def left_subnetwork(spark, sf):
    v, e = T.graph(spark, sf)
    return Networks.from_edges(e, T.regions(spark, sf), v.select("gid").distinct()).subgraph("hemi = 'L'").edges.select("gid", "src", "dst", "weight")


# events: users (in 20 blocks) linked to the event types they share a day with


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d 00:00') AS gid, least(user_id % 20, user_id % 7) AS src, greatest(user_id % 20, user_id % 7) AS dst, round(sum(round(value * 100)::BIGINT) / 100.0::DOUBLE, 2) AS weight, count(*) AS n FROM events WHERE user_id % 20 <> user_id % 7 GROUP BY ALL")
def event_edges(spark, sf):
    e = T.read(spark, sf, "events").select("ts", (F.col("user_id") % 20).alias("a"), (F.col("user_id") % 7).alias("b"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    out = windowed_edges(e, "ts", "a", "b", "cents")
    return out.select("gid", "src", "dst", F.round(F.col("weight") / 100.0, 2).alias("weight"), "n")
