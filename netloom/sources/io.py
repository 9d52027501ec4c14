"""Readers and writers: matrix text files, hemisphere tables, atlases, viewer files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrices(spark: SparkSession, path, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, i, j, w) from whitespace-separated square matrices, one file a subject; i and j
    from 1, NaN and NA are 0. `path`: a file, a folder, or a list."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))
    rows = text.select("file", F.posexplode(F.split("value", r"\s*\n\s*")).alias("i", "line"))
    cells = rows.select("file", (F.col("i") + 1).alias("i"), F.posexplode(F.split("line", r"\s+")).alias("j", "x"))
    w = F.coalesce(F.expr("try_cast(x AS double)"), F.lit(0.0))
    return cells.select("file", "i", (F.col("j") + 1).alias("j"), F.when(F.isnan(w), 0.0).otherwise(w).alias("w"))


def read_divisors(spark: SparkSession, path) -> DataFrame:
    """(file, i, d): one number a line."""
    return read_matrices(spark, path).where("j = 1").select("file", "i", F.col("w").alias("d"))


# Abbreviations of region names, in the order in which they apply (longer names
# first, so that no pattern eats part of another's name).
ABBREVIATIONS = (
    ("bankssts", "BSTS"), ("caudalanteriorcingulate", "cACC"), ("caudalmiddlefrontal", "cMFG"), ("precuneus", "PCUN"), ("cuneus", "CUN"), ("entorhinal", "ENT"),
    ("fusiform", "FUS"), ("inferiorparietal", "IPL"), ("inferiortemporal", "ITG"), ("isthmuscingulate", "iCC"), ("lateraloccipital", "LOG"), ("lateralorbitofrontal", "LOF"),
    ("lingual", "LING"), ("medialorbitofrontal", "MOF"), ("middletemporal", "MTG"), ("parahippocampal", "PARH"), ("paracentral", "paraC"), ("parsopercularis", "pOPER"),
    ("parsorbitalis", "pORB"), ("parstriangularis", "pTRI"), ("pericalcarine", "periCAL"), ("postcentral", "postC"), ("posteriorcingulate", "PCC"), ("precentral", "preC"),
    ("rostralanteriorcingulate", "rACC"), ("rostralmiddlefrontal", "rMFG"), ("superiorfrontal", "SFG"), ("superiorparietal", "SPL"), ("superiortemporal", "STG"), ("supramarginal", "SMAR"),
    ("frontalpole", "FP"), ("temporalpole", "TP"), ("transversetemporal", "TT"), ("insula", "INS"), ("thalamus", "THAL"), ("caudate", "CAUD"), ("putamen", "PUT"),
    ("pallidum", "PALL"), ("hippocampus", "HIPP"), ("amygdala", "AMYG"), ("accumbens", "ACCU"), ("brain-stem", "BSTEM"), ("ventraldc", "VDC"),
)


def short_name(column: str, modality: str = "thickness", parcellation: str = "aparc") -> str:
    """lh_precuneus_thickness -> lPCUN. Names of aparc.a2009s stay whole, with dots for
    hyphens: lh_G_temp_sup-Lateral_thickness -> lG_temp_sup.Lateral."""
    x = re.sub(rf"_{modality}$", "", column)
    x = re.sub(r"^(lh|left)[_-]", "l", x, flags=re.I)
    x = re.sub(r"^(rh|right)[_-]", "r", x, flags=re.I)
    if parcellation == "aparc.a2009s":
        return x.replace("-", ".")
    for long, short in ABBREVIATIONS:
        x = re.sub(long, short, x, flags=re.I)
    return x.replace("&", "_").replace("-", "_")


def pad_ids(*tables: DataFrame, column: str = "sid") -> list[DataFrame]:
    """Zero-pads the ids of tables that belong together to the longest, if all are numbers."""
    seen = [df.agg(F.bool_and(F.col(column).rlike(r"^\d+$")).alias("numbers"), F.max(F.length(column)).alias("width")).first() for df in tables]
    if not all(s["numbers"] for s in seen):
        return list(tables)
    width = max(s["width"] for s in seen)
    return [df.withColumn(column, F.lpad(column, width, "0")) for df in tables]


def read_hemispheres(spark: SparkSession, folder: str, parcellation: str = "aparc", modality: str = "thickness", exclude: tuple[str, ...] = (), subcortical: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """Long measures (sid, region, value) of both hemispheres' tables, joined by subject
    (and asegstats.csv), without mean columns; who was excluded; who lacks a table."""
    tables = []
    for name in (f"{parcellation}_lh_{modality}.csv", f"{parcellation}_rh_{modality}.csv", *(["asegstats.csv"] if subcortical else [])):
        t = spark.read.option("header", True).csv(f"{folder}/{name}")
        keep = [c for c in t.columns[1:] if "mean" not in c.lower()][: 14 if name == "asegstats.csv" else None]
        t = t.select(F.col(f"`{t.columns[0]}`").cast("string").alias("sid"), *(F.col(f"`{c}`").cast("double").alias(short_name(c, modality, "aparc" if name == "asegstats.csv" else parcellation)) for c in keep))
        tables.append(t)
    tables = pad_ids(*tables)
    ids = [set(r["sid"] for r in t.select("sid").collect()) for t in tables]  # a study's subjects
    missing = sorted(set.union(*ids) - set.intersection(*ids))
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "sid")
    out = out.where(~F.col("sid").isin(list(exclude))) if exclude else out
    columns = [f"`{c}`" for c in out.columns if c != "sid"]  # names may hold dots
    return out.unpivot("sid", columns, "region", "value"), sorted(set(exclude) & set.union(*ids)), missing


ATLAS = ("name", "x", "y", "z", "lobe", "hemi")


def as_atlas(df: DataFrame) -> DataFrame:
    """Validates a region table (name, x.mni, y.mni, z.mni or x, y, z, lobe, hemi; more
    columns pass) and numbers the regions in name order if they have no index."""
    for c in "xyz":
        if f"{c}.mni" in df.columns:
            df = df.withColumnRenamed(f"{c}.mni", c)
    lacking = [c for c in ATLAS if c not in df.columns]
    if lacking:
        raise ValueError(f"an atlas has the columns {ATLAS}; lacking: {lacking}")
    if "v" in df.columns:
        return df
    if "index" in df.columns:
        return df.withColumnRenamed("index", "v")
    from pyspark.sql import Window

    return df.withColumn("v", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("name")))


def create_atlas(spark: SparkSession, regions: list[str], coords: list[tuple[float, float, float]], lobes: list[str], hemis: list[str], other: dict[str, list] | None = None) -> DataFrame:
    other = other or {}
    if len({len(regions), len(coords), len(lobes), len(hemis), *map(len, other.values())}) != 1:
        raise ValueError("all of the same length")
    rows = [(i + 1, n, *map(float, c), lobe, h, *(v[i] for v in other.values())) for i, (n, c, lobe, h) in enumerate(zip(regions, coords, lobes, hemis))]
    return spark.createDataFrame(rows, ["v", "name", "x", "y", "z", "lobe", "hemi", *other])


# Regions of known atlases.
_atlases: dict[str, int] = {"dk": 68, "dk.scgm": 82, "dkt": 62, "dkt.scgm": 76, "destrieux": 148, "destrieux.scgm": 162, "aal90": 90, "aal116": 116, "lpba40": 56, "hoa112": 112, "brainsuite": 74, "craddock200": 200, "dosenbach160": 160, "power264": 264, "gordon333": 333, "hcp_mmp1.0": 360}


def register_atlas(name: str, n_regions: int) -> None:
    _atlases[name] = n_regions


def guess_atlas(n_regions: int) -> str | None:
    """The first known atlas with that many regions."""
    return next((k for k, n in _atlases.items() if n == n_regions), None)


def write_viewer(vertices: DataFrame, edges: DataFrame, regions: DataFrame, prefix: str, color: str | None = None, size: str | None = None) -> None:
    """prefix.node (x y z color size label) and prefix.edge (dense matrix), tab-separated,
    without header, of one graph."""
    v = vertices.join(regions, "v")
    node = v.orderBy("v").select(*(F.bround(c).cast("int") for c in "xyz"), F.col(color) if color else F.lit(1), F.col(size) if size else F.lit(5), "name")
    node.coalesce(1).write.mode("overwrite").option("sep", "\t").csv(f"{prefix}.node")
    both = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight").union(edges.select("dst", "src", "weight"))
    cell = F.struct("j", F.coalesce("weight", F.lit(0.0)).alias("w"))
    grid = vertices.select(F.col("v").alias("i")).join(vertices.select(F.col("v").alias("j"))).join(both, ["i", "j"], "left")
    rows = grid.groupBy("i").agg(F.array_sort(F.collect_list(cell)).alias("row")).orderBy("i")
    line = F.array_join(F.transform("row", lambda c: c["w"].cast("string")), "\t")
    rows.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(f"{prefix}.edge")
