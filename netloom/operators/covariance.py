"""Structural covariance networks: residuals, correlations, leave-one-out contributions,
permutation and bootstrap of group networks.

Measures are long: (grp, sid, region, value). Correlations come from sums over subjects in
one aggregation; leave-one-out ones have a closed form in the same sums, so no subject's
network is ever fitted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import dist
from netloom.functions import linear as L
from netloom.operators import kernels as K
from netloom.operators import measures as M
from netloom.storage import staged


def residuals(y: DataFrame, covars: pd.DataFrame, by_group: bool = False, hemi_mean: bool = False, **coding) -> DataFrame:
    """grp, sid, region, value: externally studentised residuals of each region. by_group:
    a model for each group; hemi_mean: y carries `hemi`, and the mean of the subject's
    hemisphere is a covariate."""
    ok = covars.dropna().sort_values("sid").reset_index(drop=True)
    if hemi_mean:
        y = y.withColumn("m", F.avg("value").over(Window.partitionBy("sid", "hemi")))
    else:
        y = y.withColumn("m", F.lit(None).cast("double"))

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        at = cell.set_index("sid")
        out = []
        for g, rows in ok.groupby("grp") if by_group else [(None, ok)]:
            rows = rows[rows.sid.isin(at.index)].reset_index(drop=True)
            x = rows.drop(columns=["sid", *(["grp"] if by_group else [])])
            if hemi_mean:
                x.insert(0, "mean", at["m"].reindex(rows.sid).to_numpy(float))
            d = L.design(x, **coding) if len(x.columns) else L.Design(np.ones((len(rows), 1)), ["Intercept"])
            f = L.fit(d.x, at["value"].reindex(rows.sid).to_numpy(float))
            out.append(pd.DataFrame({"grp": rows.grp, "sid": rows.sid, "region": cell.region.iloc[0], "value": L.rstudent(f)[:, 0]}))
        return pd.concat(out)

    return y.groupBy("region").applyInPandas(one, "grp string, sid string, region string, value double")


def residual_outliers(resid: DataFrame, threshold: float = 2.0, per_region: bool = False) -> DataFrame:
    """Rows whose |residual| exceeds |mean + threshold sd| over all regions (or by region)."""
    w = Window.partitionBy("region") if per_region else Window.partitionBy(F.lit(1))
    if not per_region:
        s = resid.agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
        return resid.crossJoin(F.broadcast(s)).where(F.abs("value") > F.abs(F.col("mu") + threshold * F.col("sd"))).drop("mu", "sd")  # one row
    return resid.withColumn("cut", F.abs(F.avg("value").over(w) + threshold * F.stddev_samp("value").over(w))).where(F.abs("value") > F.col("cut")).drop("cut")


def qq(resid: DataFrame) -> DataFrame:
    """Normal quantile plot data: region, sid, value, position ((r - a) / (n + 1 - 2 a))."""
    w = Window.partitionBy("region")
    rows = resid.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy("value", "sid"))})
    a = F.when(F.col("n") <= 10, 0.375).otherwise(0.5)
    return rows.withColumn("position", (F.col("r") - a) / (F.col("n") + 1 - 2 * a)).drop("n", "r")


def ranks(y: DataFrame) -> DataFrame:
    """Values replaced by their mean ranks within (grp, region)."""
    w = Window.partitionBy("grp", "region")
    ties = Window.partitionBy("grp", "region", "value")
    return y.withColumn("value", F.rank().over(w.orderBy("value")) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def _rows(y: DataFrame) -> DataFrame:
    """One row a subject: grp, sid, its (region, value) structs in region order."""
    return y.groupBy("grp", "sid").agg(F.array_sort(F.collect_list(F.struct("region", "value"))).alias("x"))


def _atlas(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The regions of subjects' rows, in order, their means and numbers of undefined values."""
    value = F.nanvl("p.value", F.lit(None).cast("double"))
    at = rows.select(F.explode("x").alias("p")).groupBy("p.region").agg(F.avg(value).alias("mean"), F.sum(value.isNull().cast("int")).alias("undefined")).toPandas().sort_values("region")
    return at.region.tolist(), at["mean"].fillna(0).to_numpy(float), at["undefined"].to_numpy(float)


def _subjects(batch: pa.RecordBatch, at: dict[str, int], cells: int = 2**17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, region numbers and values (rows x regions, NULL: NaN) of an Arrow batch of
    subjects' rows, by those that list the same regions, at most `cells` pairs at once."""
    lists = batch.column(batch.schema.get_field_index("x"))
    size = np.asarray(lists.value_lengths())
    flat = lists.flatten()
    code = flat.field("region").dictionary_encode()
    region = np.array([at[r] for r in code.dictionary.to_pylist()], int)[np.asarray(code.indices)]
    value = flat.field("value").to_numpy(zero_copy_only=False).astype(float)
    start = np.cumsum(size) - size
    alike: dict[bytes, list[int]] = {}
    for k, (b, n) in enumerate(zip(start, size)):
        alike.setdefault(region[b : b + n].tobytes(), []).append(k)
    for key, rows in alike.items():
        idx = np.frombuffer(key, int)
        step = max(1, cells // len(idx) ** 2)
        for k in range(0, len(rows), step):
            part = np.array(rows[k : k + step])
            yield part, idx, value[start[part][:, None] + np.arange(len(idx))]


def moments(rows: DataFrame, regions: list[str], centre: np.ndarray | None = None) -> dict[str | None, np.ndarray]:
    """By group: n, sums, sums of squares of the row's region and sums of products, regions x
    regions, over the subjects that have both; values less `centre`. A task adds its subjects'
    rows up to one matrix, so the driver gets an atlas squared for each group."""
    at, size = {r: k for k, r in enumerate(regions)}, len(regions)
    centre = np.zeros(size) if centre is None else centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            groups = np.array(b.column(b.schema.get_field_index("grp")).to_pylist(), object)
            for part, idx, x in _subjects(b, at, 2**20):
                x = np.nan_to_num(x - centre[idx])
                spread = np.eye(size)[idx]
                for g in set(groups[part]):
                    mine = x[[h == g for h in groups[part]]]
                    c, s = np.ones_like(mine) @ spread, mine @ spread
                    total[g] = total.get(g, 0) + np.stack([c.T @ c, s.T @ c, (mine**2 @ spread).T @ c, s.T @ s])
        i, j = np.divmod(np.arange(size * size), size)
        for g, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(i), pa.string()), *(pa.array(v) for v in (i, j, *t.reshape(4, -1)))], ["grp", "i", "j", "n", "sx", "sxx", "sxy"])

    parts = rows.select("grp", "x").mapInArrow(run, "grp string, i long, j long, n double, sx double, sxx double, sxy double")
    out = parts.groupBy("grp", "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy"))).toPandas().sort_values(["i", "j"])
    return {None if pd.isna(g) else g: t[["n", "sx", "sxx", "sxy"]].to_numpy().T.reshape(4, size, size) for g, t in out.groupby("grp", dropna=False)}


def pair_sums(y: DataFrame) -> DataFrame:
    """grp, r1 < r2 and the sums of a correlation. A subject's pairs come from its own row
    (an atlas has some hundreds of regions) and are summed before they are shuffled."""
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a["region"].alias("r1"), b["region"].alias("r2"), a["value"].alias("a"), b["value"].alias("b")))))
    rows = _rows(y).select("grp", "sid", F.explode(pairs).alias("p")).select("grp", "sid", "p.*")
    return rows


def _r(n, sx, sy, sxx, syy, sxy):
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return F.when((vx > 1e-12) & (vy > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (sxy - sx * sy / n) / F.sqrt(F.abs(vx * vy)))))


def correlations(y: DataFrame, kind: str = "pearson") -> DataFrame:
    """grp, r1, r2 (r1 < r2), n, r."""
    p = pair_sums(ranks(y) if kind == "spearman" else y)
    a, b = F.col("a"), F.col("b")
    s = p.groupBy("grp", "r1", "r2").agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))
    return s.select("grp", "r1", "r2", "n", _r(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).alias("r"))


def correlation_p(corr: DataFrame) -> DataFrame:
    """Two-sided p of each correlation (t with n - 2 degrees)."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            t = np.abs(r) * np.sqrt((n - 2) / (1 - r**2))
        return pd.Series(2 * dist.t_sf(t.to_numpy(float), n.to_numpy(float) - 2))

    return corr.withColumn("p", p("r", "n"))


def correlation_edges(corr: DataFrame, densities: DataFrame | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """grp, density (or tau), r1, r2, r of the kept pairs: r over the group's cut-off, which
    is signed; density 1 keeps what exceeds the least r."""
    if thresholds is not None:
        return corr.join(F.broadcast(thresholds), F.col("r") > F.col("tau"))
    w = Window.partitionBy("grp")
    e = F.count(F.lit(1)).over(w)
    ranked = corr.withColumns({"e": e, "rn": F.row_number().over(w.orderBy("r"))})
    index = F.greatest(F.floor(F.col("e") - F.col("e") * F.col("density")), F.lit(1))
    cuts = ranked.join(F.broadcast(densities), F.col("rn") == index).select("grp", "density", F.col("r").alias("cut"))
    return corr.join(cuts, "grp").where("r > cut").drop("cut")


def fisher_z(r1: F.Column, n1: F.Column, r2: F.Column, n2: F.Column) -> F.Column:
    """z of the difference of two correlations."""
    return (F.atanh(r1) - F.atanh(r2)) / F.sqrt(1 / (n1 - 3) + 1 / (n2 - 3))


def cor_diff_test(r1, r2, n1, n2, alternative: str = "two.sided") -> tuple[float, float]:
    z = (np.arctanh(r1) - np.arctanh(r2)) / np.sqrt(1 / (n1 - 3) + 1 / (n2 - 3))
    p = {"two.sided": lambda: 2 * dist.norm_cdf(-abs(z)), "less": lambda: dist.norm_cdf(z), "greater": lambda: dist.norm_cdf(-z)}[alternative]()
    return float(z), float(p)


def loo_pairs(y: DataFrame) -> DataFrame:
    """grp, sid, r1, r2, r, r_loo: every correlation without each subject, from the group's
    sums less the subject's own terms."""
    p = pair_sums(y)
    a, b = F.col("a"), F.col("b")
    sums = [F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")]
    rows = p.join(staged(p.groupBy("grp", "r1", "r2").agg(*sums)), ["grp", "r1", "r2"])  # an atlas squared: written, so that it is known to be small before all subjects' pairs are shuffled
    full = _r(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    less = _r(F.col("n") - 1, F.col("sx") - a, F.col("sy") - b, F.col("sxx") - a * a, F.col("syy") - b * b, F.col("sxy") - a * b)
    return rows.select("grp", "sid", "r1", "r2", full.alias("r"), less.alias("r_other"))


def aop_pairs(y: DataFrame, control: str) -> DataFrame:
    """The same for one patient at a time added to the control group's correlations."""
    p = pair_sums(y)
    a, b = F.col("a"), F.col("b")
    sums = [F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")]
    base = staged(p.where(F.col("grp") == control).groupBy("r1", "r2").agg(*sums))  # as above
    rows = p.where(F.col("grp") != control).join(base, ["r1", "r2"])
    full = _r(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    more = _r(F.col("n") + 1, F.col("sx") + a, F.col("sy") + b, F.col("sxx") + a * a, F.col("syy") + b * b, F.col("sxy") + a * b)
    return rows.select("grp", "sid", "r1", "r2", full.alias("r"), more.alias("r_other"))


def _changes(y: DataFrame, control: str | None, per: Callable, schema: str) -> DataFrame:
    """per(r, r_other, regions' numbers, names) -> (subjects, columns), over batches of subjects:
    correlations of all pairs (NaN: undefined) without each subject, or of `control` with each
    subject of another group. One pass adds up the moments, one compares; only whole subjects
    are shuffled, once, and no row is made for a pair."""
    rows = staged(_rows(y))
    regions, *_ = _atlas(rows)
    sums = moments(rows, regions)
    if control is not None:
        rows = rows.where(F.col("grp") != control)
        sums = {None: sums[control]} if control in sums else {}
    at = {r: k for k, r in enumerate(regions)}
    shared = y.sparkSession.sparkContext.broadcast(sums)
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = shared.value
        for b in batches:
            groups, sids = (np.array(b.column(b.schema.get_field_index(c)).to_pylist(), object) for c in ("grp", "sid"))
            for part, idx, x in _subjects(b, at):
                for g in set(groups[part]):
                    m = sums.get(g if control is None else None)
                    if m is None:
                        continue
                    mine = part[[h == g for h in groups[part]]]
                    which, columns = per(*_correlations_with(m, idx, x[np.isin(part, mine)], -1 if control is None else 1), idx, regions)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(which), pa.string()), pa.array(sids[mine][which], pa.string()), *(pa.array(c, t, from_pandas=True) for c, t in zip(columns, types[2:]))], names)

    return rows.select("grp", "sid", "x").mapInArrow(run, schema)


def _correlations_with(m: np.ndarray, idx: np.ndarray, x: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """r of the moments, and of the moments with each row of `x` added (1) or taken away (-1):
    rows x pairs. Pairs of a region with itself are NaN."""
    n, sx, sxx, sxy = (t[np.ix_(idx, idx)] for t in m)

    def r(n, sx, sxx, sxy):
        with np.errstate(all="ignore"):
            vx = sxx - sx * sx / n
            vy, sy = np.swapaxes(vx, -1, -2), np.swapaxes(sx, -1, -2)
            return np.where((vx > 1e-12) & (vy > 1e-12) & (idx[:, None] != idx), np.clip((sxy - sx * sy / n) / np.sqrt(np.abs(vx * vy)), -1, 1), np.nan)

    a = np.broadcast_to(x[:, :, None], (*x.shape, len(idx)))
    return r(n, sx, sxx, sxy), r(n + sign, sx + sign * a, sxx + sign * a * a, sxy + sign * a * np.swapaxes(a, 1, 2))


def _by_region(r, other, idx, names):
    """sid's row, region, summed |change| (NULL where no change is defined)"""
    d = np.abs(r - other)
    spread = (np.arange(len(names)) == idx[:, None]).astype(float)
    at = np.unique(idx)
    at = at if len(at) > 1 else at[:0]
    rc, known = (v @ spread[:, at] for v in (np.nansum(d, 2), (~np.isnan(d)).sum(2)))
    return np.repeat(np.arange(len(other)), len(at)), (np.tile(np.array(names, object)[at], len(other)), np.where(known > 0, rc, np.nan).ravel())


def _overall(r, other, idx, _):
    """sid's row, 1 - the correlation of r and other over the defined pairs"""
    first = idx[:, None] < idx
    x, y = np.broadcast_to(r[first], (len(other), first.sum())), other[:, first]
    ok = ~np.isnan(x) & ~np.isnan(y)
    n, x, y = ok.sum(1), np.where(ok, x, 0), np.where(ok, y, 0)
    with np.errstate(all="ignore"):
        mx, my = x.sum(1) / n, y.sum(1) / n
        x, y = np.where(ok, x - mx[:, None], 0), np.where(ok, y - my[:, None], 0)
        vx, vy = (x * x).sum(1), (y * y).sum(1)
        ic = np.where((vx > 1e-12) & (vy > 1e-12), 1 - np.clip((x * y).sum(1) / np.sqrt(vx * vy), -1, 1), np.nan)
    some = np.flatnonzero(n > 0)
    return some, (ic[some],)


def loo_regional(y: DataFrame) -> DataFrame:
    """As contribution_regional(loo_pairs(y)), without a row a pair."""
    return _changes(y, None, _by_region, "grp string, sid string, region string, rc double")


def loo_global(y: DataFrame) -> DataFrame:
    """As contribution_global(loo_pairs(y)), without a row a pair."""
    return _changes(y, None, _overall, "grp string, sid string, ic double")


def aop_regional(y: DataFrame, control: str) -> DataFrame:
    """As contribution_regional(aop_pairs(y, control)), without a row a pair."""
    return _changes(y, control, _by_region, "grp string, sid string, region string, rc double")


def contribution_regional(pairs: DataFrame) -> DataFrame:
    """grp, sid, region, rc: summed |change| of the region's correlations."""
    d = F.abs(F.col("r") - F.col("r_other"))
    return pairs.select("grp", "sid", F.explode(F.array("r1", "r2")).alias("region"), d.alias("d")).groupBy("grp", "sid", "region").agg(F.sum("d").alias("rc"))


def contribution_global(pairs: DataFrame) -> DataFrame:
    """grp, sid, ic: 1 - the correlation (Mantel) of the two correlation matrices."""
    p = pairs.where("r IS NOT NULL AND r_other IS NOT NULL")
    x, y = F.col("r"), F.col("r_other")
    return p.groupBy("grp", "sid").agg((1 - _r(F.count(F.lit(1)), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))).alias("ic"))


def contribution_summary(regional: DataFrame) -> DataFrame:
    """By group and region: min, median, mean, max, sd, se, and the outliers (rc over mean
    plus two sd)."""
    w = Window.partitionBy("grp", "region")
    rows = regional.withColumn("cut", F.avg("rc").over(w) + 2 * F.stddev_samp("rc").over(w))
    return rows.groupBy("grp", "region").agg(
        F.min("rc").alias("min"), F.percentile("rc", F.lit(0.5)).alias("median"), F.avg("rc").alias("mean"), F.max("rc").alias("max"),
        F.stddev_samp("rc").alias("sd"), (F.stddev_samp("rc") / F.sqrt(F.count("*"))).alias("se"), F.sum((F.col("rc") > F.col("cut")).cast("int")).alias("outliers"),
    )


def global_summary(contrib: DataFrame) -> DataFrame:
    q = F.percentile("ic", F.array(*(F.lit(x) for x in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0))))
    return contrib.groupBy("grp").agg(*(F.element_at(q, i + 1).alias(f"q{int(100 * x)}") for i, x in enumerate((0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0))), F.avg("ic").alias("mean"))


# Resampling. Subjects are numbered in order of group and sid and lie in blocks; a draw is a
# weight for each of them, and its correlations come from weighted sums over the blocks. Draws are
# rows, and no task and no driver holds all subjects' values.

BLOCK = 32768


def drawn(y: DataFrame, n: int, first: int, weigh: Callable, chunk: int, measure: Callable, schema: str) -> DataFrame:
    """measure(draw, moments of the draw's parts, moments of all, regions, groups) -> tuples, for
    the draws `first` to n - 1. weigh(draw, sizes of the groups) -> (number of the first subject,
    weights as bytes) of each part. Moments: see `_correlated`."""
    spark, blocks = y.sparkSession, BLOCK
    rows = staged(_rows(y).sort("grp", "sid").withColumn("at", F.monotonically_increasing_id()))
    regions, centre, undefined = _atlas(rows)
    at, size = {r: k for k, r in enumerate(regions)}, len(regions)
    counts = rows.groupBy(F.shiftright("at", 33).alias("part"), "grp").count().orderBy("part").collect()  # a row a task and group
    groups: dict = {}
    offset: dict[int, int] = {}
    for r in counts:
        offset.setdefault(r["part"], sum(groups.values()))
        groups[r["grp"]] = groups.get(r["grp"], 0) + r["count"]
    total, names = sum(groups.values()), sorted(groups)
    sizes = [groups[g] for g in names]
    if not total:
        raise ValueError("no subjects")
    weigh(first, [1] * len(sizes))  # so that its errors come here, without a weight for each subject
    low, high = np.triu_indices(size)
    width = len(low) + 2 * size + 1
    several = int(min(max(2**20 // width, 8), 500))  # draws that share a pass over a block
    sums = sum(moments(rows, regions, centre).values())
    whole = np.concatenate([sums[3][low, high], np.diag(sums[1]), undefined, [total]])
    shared = spark.sparkContext.broadcast((offset, at, centre, whole))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the blocks of subjects: which of the block's rows, and their values."""
        offset, at, *_ = shared.value
        for b in batches:
            mono = b.column(b.schema.get_field_index("at")).to_numpy()
            number = (mono & (2**33 - 1)) + np.array([offset[k] for k in (mono >> 33).tolist()], np.int64)
            out = []
            for part, idx, x in _subjects(b, at, 2**22):
                if not np.array_equal(idx, np.arange(size)):
                    raise ValueError("every subject has one value of every region")
                of = number[part] // blocks
                out += [(k, number[part][of == k].tobytes(), x[of == k].tobytes()) for k in np.unique(of).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["block", "rows", "x"])

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each draw's weights, cut at the blocks; weights of 0 and 1 as bits."""
        for b in batches:
            for draw in b.column(0).to_pylist():
                out = []
                for part, (start, w) in enumerate(weigh(draw, sizes)):
                    for k in range(start // blocks, (start + len(w) - 1) // blocks + 1):
                        begin, end = max(start, k * blocks), min(start + len(w), (k + 1) * blocks)
                        piece = w[begin - start : end - start]
                        bits = piece.max(initial=0) < 2
                        out.append((k, (draw - first) // several, draw, part, begin, end, bool(bits), (np.packbits(piece) if bits else piece).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 6, pa.bool_(), pa.binary()))], ["block", "chunk", "draw", "part", "begin", "end", "bits", "w"])

    def summed(key: tuple, w: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        """Weighted moments of a block's subjects for some draws."""
        start = int(key[0]) * blocks
        x = np.zeros((min(blocks, total - start), size))
        for r, v in zip(pieces.rows, pieces.x):
            x[np.frombuffer(r, np.int64) - start] = np.frombuffer(v).reshape(-1, size)
        x -= shared.value[2]
        w = w.sort_values(["draw", "part"])
        weights = np.zeros((len(w), len(x)), np.uint8)
        for k, (begin, end, bits, v) in enumerate(zip(w.begin, w.end, w.bits, w.w)):
            v = np.frombuffer(v, np.uint8)
            weights[k, begin - start : end - start] = np.unpackbits(v, count=end - begin) if bits else v
        out = np.zeros((len(w), width))
        step = max(8, 2**20 // width)
        for k in range(0, len(x), step):
            v = x[k : k + step]
            bad = np.isnan(v)
            v = np.where(bad, 0, v)
            out += weights[:, k : k + step].astype(float) @ np.column_stack([v[:, low] * v[:, high], v, bad, np.ones(len(v))])
        return pd.DataFrame({"draw": w.draw, "part": w.part, "block": key[0], "m": [m.tobytes() for m in out]})

    def measured(key: tuple, m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values(["part", "block"])
        parts = [np.sum([np.frombuffer(v) for v in p], 0) for _, p in m.groupby("part").m]
        return pd.DataFrame(measure(int(key[0]), parts, shared.value[3], regions, names), columns=[c.split()[0] for c in schema.split(", ")])

    tasks = max(1, min(400, (total // blocks + 1) * ((n - first) // several + 1)))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((n - first - 1) // several))).alias("chunk")
    x = rows.select("at", "x").mapInArrow(dealt, "block long, rows binary, x binary").select("*", chunks).withColumn("chunk", F.col("chunk").cast("long")).repartition(tasks, "block", "chunk")
    draws = spark.range(first, n, 1, max(1, -(-(n - first) // chunk)))
    w = draws.mapInArrow(cast, "block long, chunk long, draw long, part long, begin long, end long, bits boolean, w binary").repartition(tasks, "block", "chunk")
    some = w.groupBy("block", "chunk").cogroup(x.groupBy("block", "chunk")).applyInPandas(summed, "draw long, part long, block long, m binary")
    return some.repartition(max(1, -(-(n - first) // chunk)), "draw").groupBy("draw").applyInPandas(measured, schema)


def _correlated(m: np.ndarray, size: int) -> np.ndarray:
    """Correlations from a vector of moments: sums of products (upper triangle), sums, numbers of
    undefined values, n."""
    k = size * (size + 1) // 2
    q, s, bad, n = np.zeros((size, size)), m[k : k + size], m[k + size : k + 2 * size], m[-1]
    q[np.triu_indices(size)] = m[:k]
    q += np.triu(q, 1).T
    with np.errstate(all="ignore"):
        c = (q - np.outer(s, s) / n) / (n - 1)
        v = np.where((bad > 0.5) | (np.diag(c) <= 1e-13 * np.diag(q)), np.nan, np.diag(c))
        r = np.clip(c / np.sqrt(v)[:, None] / np.sqrt(v), -1, 1)
    return mirrored(r)


def mirrored(r: np.ndarray) -> np.ndarray:
    """`r` with its lower triangle on both sides: products of matrices may differ in the last
    bit between the two, and a cut-off would keep one direction of a pair only."""
    low = np.tril(r, -1)
    return low + low.T + np.diag(np.diag(r))


def density_graphs(x: np.ndarray, densities, weighted: bool = False) -> list[np.ndarray]:
    """Correlation graphs of subjects x regions at each density."""
    return cut_graphs(mirrored(np.corrcoef(x, rowvar=False)), densities, weighted)


def cut_graphs(r: np.ndarray, densities, weighted: bool = False) -> list[np.ndarray]:
    n = len(r)
    lower = np.sort(r[np.tril_indices(n, -1)])
    out = []
    for d in densities:
        at = int(len(lower) - d * len(lower))
        kept = (r > lower[max(at - 1, 0)]) & ~np.eye(n, dtype=bool)
        out.append(np.where(kept, r, 0) if weighted else kept.astype(float))
    return out


PERMUTED_GRAPH = ("mod", "Cp", "Lp", "assortativity", "E.global")


def permute_groups(y: DataFrame, densities, n: int = 5000, level: str = "graph", measure: str = "btwn.cent", function: Callable | None = None, seed: int = 0, chunk: int = 50) -> DataFrame:
    """perm_id, density, region (vertex level), measure, diff = first group - second group of
    networks whose subjects' group labels are permuted; perm_id = n is the observed split.
    function(list of graphs of group 1, of group 2) -> one number a density, for level other."""
    densities = [float(d) for d in densities]

    def weigh(p: int, sizes: list[int]) -> list[tuple[int, np.ndarray]]:
        if len(sizes) != 2:
            raise ValueError("two groups")
        total = sum(sizes)
        order = np.arange(total) if p == n else np.random.default_rng([seed, p]).permutation(total)
        return [(0, (order < sizes[0]).view(np.uint8))]

    def measured(p: int, parts: list[np.ndarray], whole: np.ndarray, regions: list[str], _) -> list[tuple]:
        one, two = (cut_graphs(_correlated(m, len(regions)), densities) for m in (parts[0], whole - parts[0]))
        if level == "other":
            return [(p, d, None, "other", M._clean(v)) for d, v in zip(densities, function(one, two))]
        out = []
        for d, a, c in zip(densities, one, two):
            ga, gc = M.Graph(a), M.Graph(c)
            if level == "graph":
                out += [(p, d, None, m, M._clean(M.GRAPH[m](ga) - M.GRAPH[m](gc))) for m in PERMUTED_GRAPH]
            else:
                out += [(p, d, r, measure, M._clean(v)) for r, v in zip(regions, M.VERTEX[measure](ga) - M.VERTEX[measure](gc))]
        return out

    return drawn(y, n + 1, 0, weigh, chunk, measured, "perm_id long, density double, region string, measure string, diff double")


def permutation_summary(diffs: DataFrame, n: int, alternative: str = "two.sided", alpha: float = 0.05, keys: tuple[str, ...] = ("measure", "density", "region")) -> DataFrame:
    """keys, observed, mean of the permuted differences, percentile limits at ceil(N q) of
    the sorted ones, p = (extremes + 1) / (N + 1), and its FDR over densities (graph level)
    or over regions within density."""
    from netloom.operators.local import bh_adjust

    seen = diffs.where(F.col("perm_id") == n).select(*keys, F.col("diff").alias("observed"))
    null = diffs.where(F.col("perm_id") != n).select(*(F.col(k).alias("k_" + k) for k in keys), "diff")
    both = seen.join(null, [F.col(k).eqNullSafe(F.col("k_" + k)) for k in keys])
    worse = {"two.sided": F.abs("diff") >= F.abs("observed"), "less": F.col("diff") <= F.col("observed"), "greater": F.col("diff") >= F.col("observed")}[alternative]
    lo, hi = {"two.sided": (alpha / 2, 1 - alpha / 2), "less": (alpha, 1.0), "greater": (1 / max(n, 1), 1 - alpha)}[alternative]
    s = F.sort_array(F.collect_list("diff"))
    pick = lambda q: F.element_at("s", F.greatest(F.ceil(F.lit(q) * F.size("s")), F.lit(1)).cast("int"))
    out = both.groupBy(*keys, "observed").agg(s.alias("s"), F.avg("diff").alias("mean"), F.sum(worse.cast("int")).alias("b"), F.count("diff").alias("m"))
    out = out.select(*keys, "observed", "mean", pick(lo).alias("ci_low"), pick(hi).alias("ci_high"), ((F.col("b") + 1) / (F.col("m") + 1)).alias("p"))
    return bh_adjust(out, "p", ("measure", "density") if "region" in keys else ("measure",))


BOOT = ("mod", "E.global", "Cp", "Lp", "assortativity", "strength", "mod.wt", "E.global.wt")


def bootstrap(y: DataFrame, densities, measure: str = "E.global", n: int = 1000, seed: int = 0, chunk: int = 50) -> DataFrame:
    """grp, density, rep_id (-1: the sample itself), value, resampling subjects in groups."""
    if measure not in BOOT:
        raise ValueError(f"measure is one of {BOOT}")
    densities = [float(d) for d in densities]
    weighted = measure.endswith(".wt") or measure == "strength"

    def weigh(r: int, sizes: list[int]) -> list[tuple[int, np.ndarray]]:
        start, out = 0, []
        for k, size in enumerate(sizes):
            times = np.ones(size, int) if r < 0 else np.bincount(np.random.default_rng([seed, r, k]).integers(0, size, size), minlength=size)
            if times.max() > 255:
                raise ValueError("a subject drawn over 255 times")
            out.append((start, times.astype(np.uint8)))
            start += size
        return out

    def measured(r: int, parts: list[np.ndarray], _, regions: list[str], names: list) -> list[tuple]:
        return [(g, d, r, M._clean(M.GRAPH[measure](M.Graph(w)))) for g, m in zip(names, parts) for d, w in zip(densities, cut_graphs(_correlated(m, len(regions)), densities, weighted))]

    return drawn(y, n, -1, weigh, chunk, measured, "grp string, density double, rep_id long, value double")


def bootstrap_summary(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """grp, density, t0, se, normal limits 2 t0 - mean(t) -+ z sd(t)."""
    z = float(dist.norm_ppf((1 + level) / 2))
    t0 = F.max(F.when(F.col("rep_id") == -1, F.col("value")))
    t = F.when(F.col("rep_id") >= 0, F.col("value"))
    s = draws.groupBy("grp", "density").agg(t0.alias("t0"), F.stddev_samp(t).alias("se"), F.avg(t).alias("m"))
    return s.select("grp", "density", "t0", "se", (2 * F.col("t0") - F.col("m") - z * F.col("se")).alias("ci_low"), (2 * F.col("t0") - F.col("m") + z * F.col("se")).alias("ci_high"))


def hqs_graphs(y: DataFrame, n: int = 100, density: float = 0.2, seed: int = 0) -> DataFrame:
    """grp, rand_id, cp, lp of random covariance networks with the group's moments."""
    spark, rows = y.sparkSession, staged(_rows(y))
    sums = moments(rows, *_atlas(rows)[:2])
    with np.errstate(all="ignore"):
        covs = {g: (sums[g][3] - sums[g][1] * sums[g][1].T / sums[g][0]) / (sums[g][0] - 1) for g in sorted(sums)}
    shared = spark.sparkContext.broadcast(covs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.id.tolist():
                for k, (g, c) in enumerate(shared.value.items()):
                    m = mirrored(K.hqs(c, [seed, r, k]))
                    low = np.sort(m[np.tril_indices(len(m), -1)])
                    a = ((m > low[max(int(len(low) - density * len(low)) - 1, 0)]) & ~np.eye(len(m), dtype=bool)).astype(float)
                    gr = M.Graph(a)
                    out.append((g, r, M._clean(M.GRAPH["Cp"](gr)), M._clean(M.GRAPH["Lp"](gr))))
            yield pd.DataFrame(out, columns=["grp", "rand_id", "cp", "lp"])

    return spark.range(0, n, 1, max(1, -(-n // 25))).mapInPandas(run, "grp string, rand_id long, cp double, lp double")
