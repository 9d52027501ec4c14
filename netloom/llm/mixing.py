"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Size of a document: its words, runs of bytes other than blank, tab, line feed, vertical tab,
form feed and carriage return. Targets: the sources in code-point order (null last) weigh
5, 2, 1, 5, ... and share the total size; a target stops at three times its source's size
and what is over is shared again by weight, until none is above (the water level has a
closed form over the sources).

Rates minimise, for each source, the relative entropy  sum b (r ln r - r + 1)  to taking
every document once, with base weights b = size ** (1 - tilt) * mean ** tilt, subject to the
token constraint  sum size r = target  and r <= 3. The solution is an exponential tilt,
r = min(3, exp(lambda (size / mean) ** tilt)), and lambda solves the convex dual: Newton
steps on ln(sum size r), kept in a bracket that halves where a step would leave it. Rates
depend on source and size alone, so the iterations run, exactly, on a histogram of sizes,
distributed by (source, size). tilt = 0 is one rate for a source; the default tilts mildly.

Rounding: documents are ordered by size class and hash, and get floor(r) copies, plus one
where the running sum of the fractions passes an integer (systematic sampling; the sum is a
prefix over cells of about `CELL` rows, and counts in integers, so reruns agree). Then a few
single documents of each source get a copy more or less, the size nearest to what is amiss
first. Copies are at most three.

Nulls and empty texts have size 0 and are taken once (0 words). Identical rows (doc_id, text
and source) get the same number of copies. A table with no words has targets 0. No source's
rows meet in one task: sums are partial first, and joins read written tables, which AQE
splits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import content_key, documents, packed, staged, unpacked

WEIGHTS, MOST = (5, 2, 1), 3
TILT, CELL = 0.25, 20_000
STEPS, EXACT = 60, 1e-9
TOUCHES, NEAR = 8, 2e-4
UNIT = 1 << 32


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, key (of doc_id, source and text), skey (the source, never null), size."""
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    key = content_key(F.col("doc_id"), F.col("source"), F.col("text"))
    skey = F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("z"))
    return docs.select("doc_id", key["a"].alias("ka"), key["b"].alias("kb"), skey.alias("skey"), count.alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """skey, source_size, target of sources(skey, source_size): a row for each source."""
    order = Window.orderBy("skey")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    rows = sources.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("target", F.least("cap", F.col("w") * F.max("level").over(everything)))
    return rows.select("skey", "source_size", "target")


def balance(histogram: DataFrame, goals: DataFrame, tilt: float = TILT, most: float = MOST) -> DataFrame:
    """skey, source_size, target, mean, lam (null: all at `most`) of histogram(skey, size, n)
    and goals(skey, source_size, target)."""
    means = histogram.where("size > 0").groupBy("skey").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    ratio = F.col("target") / F.col("source_size")
    state = goals.join(means, "skey", "left")
    state = state.withColumn("open", F.col("mean").isNotNull() & (F.col("target") < most * F.col("source_size") * (1 - 1e-12)))
    state = state.withColumns({"lam": F.when(F.col("open"), F.ln(ratio)), "lo": F.lit(-1000.0), "hi": F.lit(1000.0), "off": F.lit(1.0)})
    state = staged(state)
    rows = histogram.where("size > 0")
    z = F.pow(F.col("size") / F.col("mean"), F.lit(float(tilt)))
    for _ in range(STEPS):
        live = rows.join(state.where("open"), "skey").withColumn("z", z).withColumn("x", F.col("lam") * F.col("z"))
        r = F.least(F.lit(float(most)), F.exp(F.least("x", F.lit(50.0))))
        mass = F.col("n") * F.col("size") * r
        sums = live.groupBy("skey").agg(F.sum(mass).alias("f"), F.sum(F.when(F.col("x") < math.log(most), mass * F.col("z")).otherwise(0.0)).alias("d"))
        s = state.join(sums, "skey", "left")
        low = F.col("f") < F.col("target")
        s = s.withColumns({"lo": F.when(low, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(low, F.col("hi")).otherwise(F.col("lam"))})
        step = F.col("lam") - (F.ln("f") - F.ln("target")) * F.try_divide("f", "d")
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        s = s.withColumn("off", F.abs(F.col("f") / F.col("target") - 1))
        moved = F.when(F.col("off") <= EXACT, F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = staged(s.withColumn("lam", F.when(F.col("open"), moved)).select(*state.columns))
        worst = state.where("open").agg(F.max("off")).first()[0]
        if worst is None or worst <= EXACT:
            break
    return state.select("skey", "source_size", "target", "mean", "lam")


def mix(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, tilt: float = TILT) -> tuple[DataFrame, DataFrame]:
    """(ka, kb, copies) and (skey, source_size, target) of slim(ka, kb, skey, size)."""
    units = slim.groupBy("ka", "kb").agg(F.first("skey").alias("skey"), F.first("size").alias("size"), F.count("*").alias("n"))
    units = staged(units.withColumn("mass", F.col("size") * F.col("n")))
    histogram = staged(units.groupBy("skey", "size").agg(F.sum("n").alias("n")))
    goals = staged(targets(histogram.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most))
    state = staged(balance(histogram, goals, tilt, most))

    # floor(r) copies and the fraction, in integers
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.pow(F.col("size") / F.col("mean"), F.lit(float(tilt))), F.lit(50.0))))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(most)).otherwise(rate)
    class_ = F.floor(F.log2(F.col("mass") + 1.0) * 4).cast("int")
    cells = staged(units.withColumn("class", class_).groupBy("skey", "class").agg(F.count("*").alias("m")))
    rows = units.withColumn("class", class_).join(cells, ["skey", "class"]).join(state, "skey")
    rows = rows.withColumn("cell", F.pmod(F.col("ka"), F.ceil(F.col("m") / CELL)).cast("int"))
    rows = rows.withColumn("rate", rate).withColumn("floor", F.floor("rate").cast("int"))
    rows = rows.withColumn("part", F.floor((F.col("rate") - F.col("floor")) * UNIT).cast("bigint"))
    rows = staged(rows.select("ka", "kb", "skey", "mass", "class", "cell", "floor", "part"))
    starts = rows.groupBy("skey", "class", "cell").agg(F.sum("part").alias("sum"))
    earlier = Window.partitionBy("skey").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(starts.select("skey", "class", "cell", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start")))
    inside = Window.partitionBy("skey", "class", "cell").orderBy("mass", "ka", "kb").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, ["skey", "class", "cell"]).withColumn("end", F.col("start") + F.sum("part").over(inside) + UNIT // 2)
    extra = F.expr(f"(end div {UNIT}) - ((end - part) div {UNIT})").cast("int")
    rows = staged(rows.select("ka", "kb", "skey", "mass", (F.col("floor") + extra).alias("copies")))

    # what is amiss by source, and the documents that mend it best
    touched = None
    for _ in range(TOUCHES):
        now = rows if touched is None else rows.join(touched, ["ka", "kb"], "left").withColumn("copies", F.col("copies") + F.coalesce("delta", F.lit(0))).drop("delta")
        amiss = now.groupBy("skey").agg(F.sum(F.col("mass") * F.col("copies")).alias("taken")).join(goals, "skey")
        amiss = staged(amiss.select("skey", (F.col("target") - F.col("taken")).alias("amiss"), "target").where(F.abs("amiss") > NEAR * F.col("target")))
        e = F.col("amiss")
        fits = (F.col("mass") > 0) & (F.col("mass") < 2 * F.abs(e)) & F.when(e > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        best = now.join(amiss, "skey").where(fits).groupBy("skey").agg(F.max(F.struct((-F.abs(F.col("mass") - F.abs(e))).alias("near"), "ka", "kb", F.signum(e).cast("int").alias("delta"))).alias("best"))
        more = staged(best.select("best.ka", "best.kb", "best.delta"))
        if not more.limit(1).count():
            break
        touched = more if touched is None else staged(touched.unionByName(more).groupBy("ka", "kb").agg(F.sum("delta").cast("int").alias("delta")))
    if touched is not None:
        rows = rows.join(touched, ["ka", "kb"], "left").withColumn("copies", F.col("copies") + F.coalesce("delta", F.lit(0)))
    return staged(rows.select("ka", "kb", "copies")), goals


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of each of docs(doc_id, text, source)."""
    slim = staged(sizes(docs))
    copies, goals = mix(slim, **options)
    rows = slim.join(copies, ["ka", "kb"]).join(goals, "skey")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    copies, _ = mix(staged(sizes(docs)), **options)
    key = content_key(F.col("doc_id"), F.col("source"), F.col("text"))
    rows = docs.select(packed(docs).alias("doc"), key["a"].alias("ka"), key["b"].alias("kb")).join(copies.where("copies > 0"), ["ka", "kb"])
    rows = rows.select("doc", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select(*unpacked(docs, docs.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))
