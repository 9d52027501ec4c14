"""Networks derived from the driver's tables: monthly trade between nations, embedding
cohorts, a supplier graph, event series. See FIXTURES.md."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import matrices as X
from netloom.storage import staged

SPLIT = "1998-05"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """The atlas: 25 nations, v = key + 1; hemisphere by parity, lobe = region."""
    k = F.col("n_nationkey")
    left = k % 2 == 0
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(
        (k + 1).alias("v"), F.concat(F.when(left, "l").otherwise("r"), "n_name").alias("name"), F.concat(F.when(left, "l").otherwise("r"), F.lit("P"), F.floor(k / 2).cast("string")).alias("pair_name"),
        F.col("r_name").alias("lobe"), F.when(left, "L").otherwise("R").alias("hemi"), (F.col("n_regionkey") + 1).alias("module"),
        (10.0 * (k % 5) * F.when(left, -1).otherwise(1)).alias("x"), (15.0 * F.floor(k / 5) - 30).alias("y"), (((7 * k) % 20) * 1.0).alias("z"),
    )


def modules(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).select("v", F.col("module").alias("g"))


def conn(spark: SparkSession, sf: str) -> DataFrame:
    """sid (order month), i (customer's nation), j (supplier's nation), w (quantity)."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("sid"))
    c = read(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") + 1).alias("i"))
    s = read(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).alias("j"))
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("sid", "i", "j").agg(F.sum("l_quantity").alias("w"))


def second_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue on the same cells, in cents."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("sid"))
    c = read(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") + 1).alias("i"))
    s = read(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).alias("j"))
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint").alias("cents"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("sid", "i", "j").agg((F.sum("cents") / 100.0).alias("w"))


def pairs(spark: SparkSession, sf: str, by: str = "max") -> DataFrame:
    """The dense grid of pairs i < j of every month."""
    c = staged(conn(spark, sf))  # a row a month and pair of nations, read twice
    return X.dense(X.symmetrize(c, by), months(spark, sf), regions(spark, sf))


def months(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("sid")).distinct()


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return months(spark, sf).withColumn("grp", F.when(F.col("sid") < SPLIT, "A").otherwise("B"))


def doubles(spark: SparkSession, name: str, *values: float) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(float(v)) for v in values))).alias(name))


def graph(spark: SparkSession, sf: str, density: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """vertices (gid, v) and edges (gid, src, dst, weight) of every month at a density. Both
    are written once, so that a measure that uses them often scans lineitem once."""
    kept = X.threshold_density(pairs(spark, sf), doubles(spark, "density", density))
    e = kept.select(F.col("sid").alias("gid"), F.col("i").alias("src"), F.col("j").alias("dst"), F.col("w").alias("weight"))
    v = months(spark, sf).select(F.col("sid").alias("gid")).crossJoin(F.broadcast(regions(spark, sf).select("v")))  # an atlas
    return staged(v), staged(e)


def sweep(spark: SparkSession, sf: str, *densities: float) -> tuple[DataFrame, DataFrame]:
    """The same at several densities: gid = month@density; edges carry sid and density."""
    d = doubles(spark, "density", *densities)
    gid = F.concat("sid", F.lit("@"), F.col("density").cast("string"))
    kept = X.threshold_density(pairs(spark, sf), d)
    e = kept.select(gid.alias("gid"), "sid", "density", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("w").alias("weight"))
    v = months(spark, sf).crossJoin(F.broadcast(d)).crossJoin(F.broadcast(regions(spark, sf).select("v"))).select(gid.alias("gid"), "sid", "density", "v")
    return staged(v), staged(e)


def covars(spark: SparkSession, sf: str) -> DataFrame:
    """sid, grp, age, load, sex, scanner: a row a month."""
    o = read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("sid"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    s = o.groupBy("sid", "y", "m").agg((F.sum("cents") / F.count("*") / 1e7).alias("age"), F.count("*").cast("double").alias("load"))
    return s.select("sid", F.when(F.col("sid") < SPLIT, "A").otherwise("B").alias("grp"), "age", "load", F.when(F.col("y") % 2 == 0, "F").otherwise("M").alias("sex"), F.concat(F.lit("S"), F.col("m") % 3).alias("scanner"))


def covars_table(spark: SparkSession, sf: str, *columns: str) -> pd.DataFrame:
    """The study's covariates (a row a month) on the driver, where designs are made."""
    return covars(spark, sf).select("sid", *columns).orderBy("sid").toPandas()


def strengths(spark: SparkSession, sf: str) -> DataFrame:
    """region, sid, value: each nation's strength in each month."""
    p = X.symmetrize(conn(spark, sf))
    both = p.select("sid", F.explode(F.array("i", "j")).alias("v"), "w").groupBy("sid", "v").agg(F.sum("w").alias("value"))
    grid = months(spark, sf).crossJoin(F.broadcast(regions(spark, sf).select("v")))  # an atlas
    return grid.join(both, ["sid", "v"], "left").select(F.format_string("r%02d", "v").alias("region"), "sid", F.coalesce("value", F.lit(0.0)).alias("value"))


def cohort(spark: SparkSession, sf: str, dims: int | None = None, n_groups: int = 2) -> DataFrame:
    """grp, sid, region, value, hemi of the embeddings' dimensions: all, or the first `dims`."""
    e = read(spark, sf, "embeddings")
    x = F.col("embedding") if dims is None else F.slice("embedding", 1, dims)
    e = e.select("vec_id", "label", F.size(x).alias("dims"), F.posexplode(x).alias("d", "x"))
    return e.select((F.col("label") % n_groups).cast("string").alias("grp"), F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("sid"), F.format_string("d%02d", F.col("d") + 1).alias("region"), F.round(F.col("x").cast("double"), 4).alias("value"), F.when(F.col("d") < F.col("dims") / 2, "l").otherwise("r").alias("hemi"))


def supplier_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """One large graph: suppliers that share orders."""
    li = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("int").alias("s")).distinct()
    a, b = li.withColumnRenamed("s", "src"), li.withColumnRenamed("s", "dst")
    e = a.join(b, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    v = read(spark, sf, "supplier").select(F.lit("suppliers").alias("gid"), F.col("s_suppkey").cast("int").alias("v"))
    return v, e.select(F.lit("suppliers").alias("gid"), "src", "dst", "weight")
