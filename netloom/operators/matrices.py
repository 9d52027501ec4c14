"""Connectivity in long form: normalising, symmetrising, thresholding.

`conn` is (sid, i, j, w): absent pairs are zeros. Statistics over subjects count those zeros
(`dense`), as a dense array would. A whole collection (all subjects, all thresholds) is one
plan; a threshold is a row of a small table, never a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIVISORS = ("none", "rowSums", "waytotal", "size")


def normalize(conn: DataFrame, divisor: str = "none", div: DataFrame | None = None, p: float = 5e3) -> DataFrame:
    """rowSums: w over its row's sum; waytotal: w over way_i of div(sid, i, d); size:
    2 w / (p (size_i + size_j)). Undefined quotients are 0."""
    w = F.col("w")
    if divisor == "none":
        return conn
    if divisor == "rowSums":
        total = F.sum("w").over(Window.partitionBy("sid", "i"))
        return conn.withColumn("w", F.coalesce(F.try_divide(w, total), F.lit(0.0)))
    if divisor not in DIVISORS or div is None:
        raise ValueError(f"divisor is one of {DIVISORS}, with a table for waytotal and size")
    one = div.select("sid", "i", F.col("d").alias("di"))
    out = conn.join(one, ["sid", "i"], "left")
    if divisor == "waytotal":
        return out.withColumn("w", F.coalesce(F.try_divide(w, F.col("di")), F.lit(0.0))).select(*conn.columns)
    two = div.select("sid", F.col("i").alias("j"), F.col("d").alias("dj"))
    out = out.join(two, ["sid", "j"], "left")
    return out.withColumn("w", F.coalesce(F.try_divide(2 * w, F.lit(float(p)) * (F.col("di") + F.col("dj"))), F.lit(0.0))).select(*conn.columns)


def symmetrize(conn: DataFrame, by: str = "max", keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """One row (.., i < j, w) for each pair that occurs; w is the max, min or mean of the two
    directions, a missing one being 0. One aggregation, no self-join."""
    if by not in ("max", "min", "avg"):
        raise ValueError("by is max, min or avg")
    low, high = F.least("i", "j"), F.greatest("i", "j")
    both = conn.where("i <> j").groupBy(*keys, low.alias("a"), high.alias("b"))
    there = F.coalesce(F.max(F.when(F.col("i") < F.col("j"), F.col("w"))), F.lit(0.0))
    back = F.coalesce(F.max(F.when(F.col("i") > F.col("j"), F.col("w"))), F.lit(0.0))
    w = {"max": F.greatest(there, back), "min": F.least(there, back), "avg": (there + back) / 2}[by]
    return both.agg(w.alias("w")).select(*keys, F.col("a").alias("i"), F.col("b").alias("j"), "w")


def grid(subjects: DataFrame, regions: DataFrame, directed: bool = False) -> DataFrame:
    """Every (sid, i, j): i < j, or all ordered pairs. `regions` (the atlas) has at most some
    hundreds of rows; the pairs of regions are the product that dense semantics ask for."""
    a, b = regions.select(F.col("v").alias("i")), regions.select(F.col("v").alias("j"))
    pairs = a.join(b, F.col("i") != F.col("j") if directed else F.col("i") < F.col("j"))
    return subjects.select("sid").distinct().crossJoin(F.broadcast(pairs))  # regions squared: an atlas


def dense(sym: DataFrame, subjects: DataFrame, regions: DataFrame, directed: bool = False) -> DataFrame:
    return grid(subjects, regions, directed).join(sym, ["sid", "i", "j"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def coeff_var(pairs: DataFrame, keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """sd / mean of w by key; NULL where the mean is 0 or there is one value."""
    return pairs.groupBy(*keys).agg(F.try_divide(F.stddev_samp("w"), F.avg("w")).alias("cv"))


def threshold_raw(pairs: DataFrame, taus: DataFrame) -> DataFrame:
    """w > tau for each row of taus(tau)."""
    return pairs.join(F.broadcast(taus), F.col("w") > F.col("tau"))  # a table of thresholds


def threshold_mean_sd(pairs: DataFrame, taus: DataFrame) -> DataFrame:
    """Pairs whose mean plus two standard deviations over subjects exceeds tau, w > 0."""
    stats = pairs.groupBy("i", "j").agg((F.avg("w") + 2 * F.stddev_samp("w")).alias("high"))
    kept = stats.join(F.broadcast(taus), F.col("high") > F.col("tau")).select("i", "j", "tau")
    return pairs.where("w > 0").join(kept, ["i", "j"])


def cutoffs(pairs: DataFrame, densities: DataFrame, keys: tuple[str, ...] = ("sid",), value: str = "w", descending: bool = False) -> DataFrame:
    """keys, density, cut: the value at index floor(E - d E) of the E sorted values."""
    order = F.desc(value) if descending else F.asc(value)
    w = Window.partitionBy(*keys).orderBy(order)
    ranked = pairs.withColumn("rn", F.row_number().over(w)).withColumn("e", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    at = F.col("rn") == F.floor(F.col("e") - F.col("e") * F.col("density"))
    return ranked.join(F.broadcast(densities), at).select(*keys, "density", F.col(value).alias("cut"))


def threshold_density(pairs: DataFrame, densities: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """The strongest share of each subject's pairs: w > its cut-off (ties at it are left
    out; density 1 keeps every positive pair)."""
    cuts = cutoffs(pairs, densities, keys)
    everything = pairs.select(*keys).distinct().crossJoin(F.broadcast(densities)).join(cuts, [*keys, "density"], "left")
    floor = F.coalesce("cut", F.lit(0.0))
    return pairs.join(everything, list(keys)).where((F.col("w") > floor) & (F.col("w") > 0)).select(*pairs.columns, "density")


def threshold_consistency(pairs: DataFrame, densities: DataFrame) -> DataFrame:
    """The pairs of least variation over subjects, up to the density; for all subjects. Index
    and order are of all pairs, those without a variation (all zeros) last and never kept."""
    cv = coeff_var(pairs).withColumn("g", F.lit(1))
    total = F.count(F.lit(1)).over(Window.partitionBy("g"))
    ranked = cv.withColumn("e", total).withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(F.desc_nulls_last("cv"))))
    cuts = ranked.join(F.broadcast(densities), F.col("rn") == F.floor(F.col("e") - F.col("e") * F.col("density"))).select("density", F.col("cv").alias("cut"))
    kept = cv.join(F.broadcast(cuts), F.col("cv") < F.col("cut")).select("i", "j", "density")  # a row for each density
    return pairs.where("w > 0").join(kept, ["i", "j"])


def threshold_consensus(pairs: DataFrame, groups: DataFrame, tau: float = 0.0, share: float = 0.5) -> DataFrame:
    """Pairs that at least `share` of a group's subjects have over tau (any, if 0); every
    subject of the group keeps its weight there. groups: (sid, grp)."""
    size = groups.groupBy("grp").agg(F.count("*").alias("n"))
    g = pairs.join(groups, "sid")
    votes = g.groupBy("grp", "i", "j").agg(F.sum((F.col("w") > tau).cast("int")).alias("k")).join(size, "grp")
    enough = F.col("k") >= F.lit(share) * F.col("n") if share > 0 else F.col("k") > 0
    return g.where("w > 0").join(votes.where(enough).select("grp", "i", "j"), ["grp", "i", "j"])


def apply_mask(second: DataFrame, kept: DataFrame) -> DataFrame:
    """A second set of weights where the first was kept."""
    return second.join(kept.select("sid", "i", "j").distinct(), ["sid", "i", "j"], "left_semi")


def group_means(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean weight over all subjects of the group, dropped ones counting as zeros."""
    size = groups.groupBy("grp").agg(F.count("*").alias("n"))
    sums = kept.drop("grp").join(groups, "sid").groupBy("grp", "i", "j").agg(F.sum("w").alias("s"))
    return sums.join(F.broadcast(size), "grp").select("grp", "i", "j", (F.col("s") / F.col("n")).alias("w"))  # a row for each group


def is_binary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("sid").agg(F.bool_and(F.col("w").isin(0.0, 1.0)).alias("is_binary"))


def column_extremes(pairs: DataFrame) -> DataFrame:
    """Column maxima, minima and absolute maxima of each matrix."""
    return pairs.groupBy("sid", "j").agg(F.max("w").alias("col_max"), F.min("w").alias("col_min"), F.max(F.abs("w")).alias("col_max_abs"))


def rescale(df: DataFrame, value: str, keys: tuple[str, ...], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Min-max rescaling by key; a constant becomes `high`."""
    w = Window.partitionBy(*keys)
    a, b = F.min(value).over(w), F.max(value).over(w)
    x = F.try_divide((F.col(value) - a) * (high - low), b - a) + low
    return df.withColumn("scaled", F.coalesce(x, F.lit(high)))


TRANSFORMS = ("1/w", "-log(w)", "1-w", "-log10(w/max(w))", "-log10(w/max(w)+1)")


def transform_weights(edges: DataFrame, kind: str, invert: bool = False) -> DataFrame:
    """Weights to lengths and back. `max_weight` is kept by graph, for the inverse. The last
    transform is never positive; the path kernels refuse it."""
    if kind not in TRANSFORMS:
        raise ValueError(f"kind is one of {TRANSFORMS}")
    w = F.col("weight")
    if not invert:
        edges = edges.withColumn("max_weight", F.max("weight").over(Window.partitionBy("gid")))
    m = F.col("max_weight")
    forth = {"1/w": 1 / w, "-log(w)": -F.ln(w), "1-w": 1 - w, "-log10(w/max(w))": -F.log10(w / m), "-log10(w/max(w)+1)": -F.log10(w / m + 1)}
    back = {"1/w": 1 / w, "-log(w)": F.exp(-w), "1-w": 1 - w, "-log10(w/max(w))": m * F.pow(F.lit(10.0), -w), "-log10(w/max(w)+1)": m * (F.pow(F.lit(10.0), -w) - 1)}
    return edges.withColumn("weight", (back if invert else forth)[kind])
