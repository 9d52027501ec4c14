"""The tables behind figures: curves, bins, quantiles, positions. Drawing is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import text
from netloom.operators import local

VIEWS = {"axial": ("x", "y"), "sagittal.left": ("-y", "z"), "sagittal.right": ("y", "z")}


def positions(regions: DataFrame, view: str = "axial", hemi: str | None = None) -> DataFrame:
    """v, lx, ly of an atlas seen from above, from a side, or on a circle."""
    r = regions.where(F.col("hemi") == hemi) if hemi else regions
    if view == "circular":
        return local.circular_layout(r).select("v", "lx", "ly")
    side = {"sagittal.left": F.col("hemi") == "L", "sagittal.right": F.col("hemi") == "R"}.get(view, F.lit(True))
    if view not in VIEWS:
        raise ValueError(f"a view is circular or one of {list(VIEWS)}")
    lx, ly = ((-F.col(c[1:]) if c[0] == "-" else F.col(c)) for c in VIEWS[view])
    return r.where(side).select("v", lx.alias("lx"), ly.alias("ly"))


def legend(vertices: DataFrame, column: str) -> DataFrame:
    """How many vertices of each graph have each value of an attribute."""
    return vertices.groupBy("gid", column).agg(F.count("*").alias("n"))


def edge_changes(edges: DataFrame, order: str) -> DataFrame:
    """Edges that a graph has and the one before it (by `order`) hasn't: (gid, src, dst)."""
    steps = edges.select("gid", order).distinct().withColumn("before", F.lag("gid").over(Window.partitionBy(F.lit(1)).orderBy(order)))  # a row for each graph
    now = edges.select("gid", "src", "dst").join(steps.where("before is not null").select("gid", "before"), "gid")
    return now.join(edges.select(F.col("gid").alias("before"), "src", "dst"), ["before", "src", "dst"], "left_anti").select("gid", "src", "dst")


def global_curves(graphs: DataFrame, x: str, which: list[str], p: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """grp, x, measure (by its name), value: a curve for each group and graph measure, with a
    mark where p(measure, x, p) of a group difference is below alpha."""
    long = graphs.unpivot(["grp", x], which, "measure", "value")
    out = long.groupBy("grp", x, "measure").agg(F.avg("value").alias("value"))
    if p is not None:
        out = out.join(p.select("measure", x, "p"), ["measure", x], "left")
        out = out.withColumn("mark", stars(F.col("p"), alpha))
    return text.labelled(out.withColumn("measure", F.replace("measure", F.lit("_"), F.lit("."))))


def stars(p: Column, alpha: float = 0.05, trend: float = 0.1) -> Column:
    return F.when(p < alpha, "*").when(p < trend, "trend")


def histogram(values: DataFrame, keys: tuple[str, ...] = ("region", "grp"), value: str = "value") -> DataFrame:
    """Bins of the Freedman-Diaconis width, 2 IQR / n^(1/3), by key: keys, bin, low, high, n.
    Without spread there is one bin."""
    q = values.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("m"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"))
    width = F.when(F.col("iqr") > 0, 2 * F.col("iqr") / F.cbrt("m")).otherwise(F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0))
    q = q.withColumn("width", width).withColumn("bins", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.col("width"))).cast("int"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")).cast("int"), F.col("bins") - 1)
    rows = values.where(F.col(value).isNotNull()).join(q, list(keys)).withColumn("bin", at)
    return rows.groupBy(*keys, "bin").agg((F.first("lo") + F.first("width") * F.col("bin")).alias("low"), (F.first("lo") + F.first("width") * (F.col("bin") + 1)).alias("high"), F.count("*").alias("n"))


def distribution(vertices: DataFrame, measure: str, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """What a box needs: quartiles, whiskers at 1.5 IQR, mean and number, by group."""
    q = [F.percentile(measure, p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    box = vertices.groupBy(*by).agg(*q, F.avg(measure).alias("mean"), F.count(measure).alias("n"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = vertices.join(box, list(by)).where(F.col(measure).between(F.col("q1") - reach, F.col("q3") + reach))
    ends = inside.groupBy(*by).agg(F.min(measure).alias("low"), F.max(measure).alias("high"))
    return box.join(ends, list(by))


def group_means(values: DataFrame, keys: tuple[str, ...] = ("region", "grp"), value: str = "value") -> DataFrame:
    """Mean, standard deviation and standard error by key."""
    sd = F.stddev_samp(value)
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))


def rich_norm(normalised: DataFrame, core: DataFrame | None = None, alpha: float = 0.05, fdr: bool = True) -> DataFrame:
    """gid, k, norm, mark; with the rich core's degree by graph if `core` is given."""
    out = normalised.withColumn("mark", stars(F.col("p_fdr" if fdr else "p"), alpha)).select("gid", "k", "norm", "mark")
    return out if core is None else out.join(core.select("gid", F.col("degree").alias("core_degree")), "gid", "left")


def permutation_band(differences: DataFrame, summary: DataFrame, keys: tuple[str, ...] = ("measure", "density"), alpha: float = 0.05) -> DataFrame:
    """The null's band around each observed difference, with a mark. differences: keys, diff;
    summary: keys, diff or more columns, p."""
    band = differences.groupBy(*keys).agg(F.percentile("diff", alpha / 2).alias("null_low"), F.percentile("diff", 1 - alpha / 2).alias("null_high"), F.avg("diff").alias("null_mean"))
    return summary.join(band, list(keys)).withColumn("mark", stars(F.col("p"), alpha))


def diagnostics(observations: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Of a model's observations all that its diagnostic figures show: root of the absolute
    standardised residual, normal quantile position, rank by Cook's distance, and who is an
    outlier (residual over the mean plus `threshold` standard deviations)."""
    w = Window.partitionBy("region")
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("rstandard", "sid"))
    a = F.when(n <= 10, 0.375).otherwise(0.5)
    resid = F.abs("resid")
    return observations.select(
        "region", "sid", "fitted", "resid", "hat", "rstandard", "cooks",
        F.sqrt(F.abs("rstandard")).alias("scale"), ((r - a) / (n + 1 - 2 * a)).alias("quantile_at"),
        F.row_number().over(w.orderBy(F.desc("cooks"), "sid")).alias("cooks_rank"), (resid > F.avg(resid).over(w) + threshold * F.stddev_samp(resid).over(w)).alias("outlier"),
        F.try_divide(F.col("hat"), 1 - F.col("hat")).alias("leverage"),
    )


def matrix_order(corr: DataFrame, regions: DataFrame, by: str = "lobe") -> DataFrame:
    """corr (.., i, j, r) with positions pos_i, pos_j of an atlas ordered by a column."""
    order = regions.select("v", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(by, "v")).alias("pos"))
    a, b = order.select(F.col("v").alias("i"), F.col("pos").alias("pos_i")), order.select(F.col("v").alias("j"), F.col("pos").alias("pos_j"))
    return corr.join(F.broadcast(a), "i").join(F.broadcast(b), "j")
