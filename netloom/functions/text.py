"""Names, ids and short texts: columns where they touch tables, plain Python for reports."""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capitalised(c: Column | str) -> Column:
    """The first letter in upper case; the rest as it is (initcap would lower it)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def padded(df: DataFrame, column: str) -> DataFrame:
    """Values left-padded with zeros to the longest one."""
    width = df.agg(F.max(F.length(F.col(column).cast("string"))).alias("n"))
    return df.crossJoin(F.broadcast(width)).withColumn(column, F.expr(f"lpad(cast(`{column}` as string), n, '0')")).drop("n")  # one row


def pad_zeros(x: int | Iterable) -> list[str]:
    """1 .. x if x is a number, else the values, padded with zeros to the same width."""
    values = [str(i) for i in range(1, x + 1)] if isinstance(x, int) else [str(v) for v in x]
    width = max(map(len, values), default=0)
    return [v.rjust(width, "0") for v in values]


def wrapped(text: str, width: int = 80, at: str = "+") -> str:
    """Lines of at most `width` characters, broken after `at` where possible."""
    lines, line = [], ""
    pieces = text.split(at)
    for k, piece in enumerate(pieces):
        piece += at if k < len(pieces) - 1 else ""
        if line and len(line) + len(piece) > width:
            lines.append(line.rstrip())
            line = piece.lstrip()
        else:
            line += piece
    return "\n".join([*lines, line.rstrip()])


def in_columns(names: list[str], n: int) -> list[tuple[str, ...]]:
    """Names in rows of n columns, read down the columns, the last ones filled up with ''."""
    height = -(-len(names) // n)
    full = names + [""] * (height * n - len(names))
    return [tuple(full[r + c * height] for c in range(n)) for r in range(height)]


def as_fractions(contrast: Iterable[float]) -> list[str]:
    return [str(Fraction(float(x)).limit_denominator(1000)) for x in contrast]


# Labels of measures, methods and tests in reports.
MEASURES = {
    "density": "Graph density", "Cp": "Clustering coefficient", "Lp": "Characteristic path length", "E.global": "Global efficiency", "E.local": "Local efficiency (nodal)", "E.nodal": "Nodal efficiency",
    "mod": "Modularity", "assortativity": "Degree assortativity", "transitivity": "Transitivity", "degree": "Degree", "strength": "Strength", "btwn.cent": "Betweenness centrality", "ev.cent": "Eigenvector centrality",
    "clo.cent": "Closeness centrality", "lev.cent": "Leverage centrality", "subg.cent": "Subgraph centrality", "pagerank": "PageRank", "communicability": "Communicability betweenness", "knn": "Mean neighbour degree",
    "PC": "Participation coefficient", "GC": "Gateway coefficient", "z.score": "Within-module degree z-score", "vulnerability": "Vulnerability", "eccentricity": "Eccentricity", "coreness": "Coreness", "s.core": "s-core",
    "diameter": "Diameter", "num.hubs": "Number of hubs", "num.tri": "Number of triangles", "max.comp": "Largest component", "hubs": "Hubness", "dist": "Edge distance", "asymm": "Asymmetry index",
}
METHODS = {
    "freedmanLane": "Freedman-Lane", "terBraak": "ter Braak", "manly": "Manly", "smith": "Smith", "draperStoneman": "Draper-Stoneman", "stillWhite": "Still-White",
}
ALTERNATIVES = {"two.sided": "!=", "less": "<", "greater": ">"}


def measure_label(code: str) -> str:
    """The full name of a measure; weighted ones say so; unknown codes stay."""
    base = code.removesuffix(".wt")
    label = MEASURES.get(base, base)
    return f"{label} (weighted)" if base != code else label


def labelled(df: DataFrame, column: str = "measure") -> DataFrame:
    """`df` with measure codes replaced by their names."""
    pairs = [F.lit(x) for k in MEASURES for x in (k, MEASURES[k])]
    base = F.regexp_replace(column, r"\.wt$", "")
    name = F.coalesce(F.try_element_at(F.create_map(*pairs), base), base)
    return df.withColumn(column, F.when(F.col(column).endswith(".wt"), F.concat(name, F.lit(" (weighted)"))).otherwise(name))


def numbered(df: DataFrame, order: str, name: str = "index") -> DataFrame:
    """Rows of a dimension table numbered from 1 by `order`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order)))


def report(title: str, rows: dict[str, object]) -> str:
    """A titled list of facts."""
    width = max(map(len, rows), default=0)
    bar = "=" * max(len(title), width)
    return "\n".join([title, bar, *(f"{k.ljust(width)}  {', '.join(map(str, v)) if isinstance(v, (list, tuple)) else v}" for k, v in rows.items())])
