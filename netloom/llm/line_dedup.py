"""Line dedup by distinct-site spread, in DataFrame operations only.

A line is compared by its trimmed text (two 64-bit hashes). Every task sketches the sites
(`source`) of each line it reads with HyperLogLog; the sketches merge by aggregation, so a
line that a third of all rows hold costs one small sketch a task. Lines whose estimate is
surely below `min_sites` stay, lines surely above go, and lines near it get an exact
distinct count. A line on at least `min_sites` sites is boilerplate.

Every line that isn't blank is judged, however short, and lines on many sites go, whatever is
left, be it an empty text. One kind of document is spared: of which less than `least_left` of
the characters (other than line feeds) would remain, and whose very same text another row
holds. It isn't a document with boilerplate but a copy that many sites hold: exact copies on
`min_sites` sites would make each other's lines boilerplate and be emptied together. They
keep their text, for near-duplicate detection to judge. A row of a text of its own is never
spared.

A null source is a site of its own; a null text has no lines and stays null; an empty text
stays empty; a row's result depends on its text and on the lines of the table, so repeated
rows get the same; an empty table gives an empty result. Input columns travel in a struct, so
no name clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import content_key, documents, packed, staged

MIN_SITES, LEAST_LEFT = 5, 0.2
NOT_BLANK = r"[^ \t\r\f\x0B]"
LG_K, MARGIN = 11, 0.25  # a margin of over ten standard errors of 1.04 / sqrt(2 ** 11)


def _lines(docs: DataFrame) -> DataFrame:
    """key, whole (the text's hashes and characters), pos, n (characters), h, site of the
    lines that are judged."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    line = F.trim(F.col("line"))
    size = F.length("text") - F.size(F.split("text", "\n")) + 1  # other than line feeds
    whole = F.struct(content_key(F.col("text")).alias("t"), size.alias("size"))
    rows = docs.select(content_key(F.col("doc_id"), F.col("text")).alias("key"), whole.alias("whole"), site.alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(line.rlike(NOT_BLANK)).select("key", "whole", "pos", F.length("line").alias("n"), "site", content_key(line).alias("h"))


def _but_copies(removed: DataFrame, least_left: float) -> DataFrame:
    """`removed` without the texts that keep under `least_left` and that several rows hold.
    Equal texts lose equal lines, so all rows of such a text are among those of `removed`."""
    few = removed.where(F.col("whole.size") - F.col("gone") < F.lit(least_left) * F.col("whole.size"))
    copies = few.groupBy("ta", "tb").agg(F.sum("times").alias("times")).where("times > 1").select("ta", "tb")
    return removed.join(staged(copies), ["ta", "tb"], "left_anti")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The hashes h of lines on at least `min_sites` distinct sites."""
    lines = _lines(docs)
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = staged(spread.where(F.col("sites") >= (1 - MARGIN) * min_sites))
    near = spread.where(F.col("sites") <= (1 + MARGIN) * min_sites).select("h")
    exact = lines.join(near, "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("sites"))
    sure = spread.where(F.col("sites") > (1 + MARGIN) * min_sites).select("h")
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc, the columns of docs(doc_id, text, source, ...) with the text cleaned, and
    line_dedup, a struct of n_lines and n_removed."""
    found = staged(boilerplate(docs, min_sites))
    lines = _lines(docs).join(found, "h", "left_semi")  # equal rows have one key: `times` is their number
    lines = lines.groupBy("key", "whole", "pos", "n").agg(F.count("*").alias("times")).groupBy("key", "whole")
    removed = lines.agg(F.collect_set("pos").alias("removed"), F.sum("n").alias("gone"), F.max("times").alias("times"))
    removed = staged(removed.select("key.a", "key.b", "whole", F.col("whole.t.a").alias("ta"), F.col("whole.t.b").alias("tb"), "removed", "gone", "times"))
    removed = _but_copies(removed, least_left).select("a", "b", "removed")
    key = content_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(packed(docs).alias("doc"), key["a"].alias("a"), key["b"].alias("b")).join(removed, ["a", "b"], "left")
    old = F.col("doc.text")
    parts = F.split(old, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), old).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    n_lines = F.when(old.isNull(), 0).otherwise(F.size(parts)).cast("bigint")
    n_removed = F.coalesce(F.size("removed"), F.lit(0)).cast("bigint")
    doc = F.struct(*(text.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
    return rows.select(doc.alias("doc"), F.struct(n_lines.alias("n_lines"), F.when(F.col("removed").isNull(), 0).otherwise(n_removed).alias("n_removed")).alias("line_dedup"))


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without boilerplate; where lines went, n_chars (if there is such a
    column) counts the characters left."""
    out = line_dedup(docs, **options)
    n_chars = F.when(F.col("line_dedup.n_removed") > 0, F.length("doc.text")).otherwise(F.col("doc.n_chars")).cast("bigint") if "n_chars" in docs.columns else None
    return out.select(*(n_chars.alias(c) if c == "n_chars" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc.doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "doc.text")


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce('s' || source, 'n') AS site, string_split(text, chr(10)) AS parts, count(*) OVER (PARTITION BY text) AS held FROM documents),
l AS (SELECT r, site, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
j AS (SELECT r, site, pos, length(line) AS n, trim(line, ' ') AS line FROM l WHERE regexp_matches(line, '{NOT_BLANK}')),
b AS (SELECT line FROM j GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
x AS (SELECT r, list(pos) AS removed, sum(n) AS gone FROM j SEMI JOIN b USING (line) GROUP BY r),
s AS (SELECT *, length(text) - len(parts) + 1 AS size FROM d LEFT JOIN x USING (r)),
c AS (SELECT *, removed IS NOT NULL AND NOT (held > 1 AND size - gone < {LEAST_LEFT}::DOUBLE * size) AS clean FROM s)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, CASE WHEN clean THEN len(removed) ELSE 0 END::BIGINT AS n_removed,
       CASE WHEN clean THEN array_to_string(list_filter(parts, lambda p, i: NOT list_contains(removed, i)), chr(10)) ELSE text END AS text FROM c
"""
