"""Every catalogue query against its SQL in DuckDB, on the smallest tables; the others for
their rows. The streaming operator against the same one on a batch."""

import functools
import math
import os

import pytest
from pyspark.sql import functions as F

from netloom.plans import catalogue, fixtures
from netloom.storage import staged
from netloom.streaming.edges import windowed_edges, write_edges

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
TABLES = "region nation customer supplier part orders lineitem events embeddings"
#: a graph's measures have no region; no run of thresholds need be critical; equal degrees have no correlation
MAY_BE_EMPTY: dict[str, set[str]] = {"permute_groups": {"region"}, "mtpc": {"a_mtpc", "a_crit"}, "supplier_network": {"assortativity"}}
SLOW = {"community_spinglass", "mediation", "mediation_wide", "glm_permutation", "glm_region_permutation"}  # these have tests of their own


@pytest.fixture(scope="module", autouse=True)
def networks_made_once():
    """The queries' derived networks are the same every time: they are made once a session."""
    keep = {name: getattr(fixtures, name) for name in ("graph", "pairs", "sweep", "strengths", "conn")}
    for name, fn in keep.items():
        setattr(fixtures, name, functools.cache(fn) if name in ("graph", "sweep") else functools.cache(lambda *a, fn=fn: staged(fn(*a))))
    yield
    for name, fn in keep.items():
        setattr(fixtures, name, fn)


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, abs_tol=2e-5, rel_tol=1e-6))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()), key=repr)
    result = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert len(got) == len(want) and all(near(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - SLOW))
def test_has_rows(spark, name):
    """All rows are made: there are some, none twice, no number is infinite or NaN (undefined
    is NULL), and no column is empty throughout but those that may be."""
    df = catalogue.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(set(rows)) == len(rows)
    assert all(math.isfinite(x) for r in rows for x in r if isinstance(x, float))
    empty = {c for c, x in zip(df.columns, zip(*rows)) if all(y is None for y in x)}
    assert empty <= MAY_BE_EMPTY.get(name, set())


def test_cohort_has_all_dimensions(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", "embedding").collect()
    n = len(rows[0]["embedding"])
    got = {(r["grp"], r["r1"], r["r2"]): r["r"] for r in catalogue.queries()["corr_pearson"](spark, SF).collect()}
    assert n == 64 and len(got) == 2 * n * (n - 1) // 2
    for g in (0, 1):
        want = np.corrcoef(np.round([r["embedding"] for r in rows if r["label"] % 2 == g], 4), rowvar=False)
        assert all(abs(got[str(g), f"d{i + 1:02d}", f"d{j + 1:02d}"] - want[i, j]) < 1e-5 for i in range(n) for j in range(i + 1, n))
    regions = {r["region"] for r in catalogue.queries()["residuals_by_hemisphere"](spark, SF).select("region").distinct().collect()}
    assert regions >= {f"d{i + 1:02d}" for i in range(n)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", (F.col("user_id") % 20).alias("a"), (F.col("user_id") % 7).alias("b"), "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    write_edges(windowed_edges(stream, "ts", "a", "b", "value", late="2 days"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(180)
    batch = {(r["gid"], r["src"], r["dst"]): r["n"] for r in windowed_edges(events, "ts", "a", "b", "value").collect()}
    closed = spark.read.schema("gid string, src long, dst long, weight double, n long").parquet(str(tmp_path / "out")).collect()
    assert closed and len(closed) == len({(r["gid"], r["src"], r["dst"]) for r in closed}) <= len(batch)
    assert all(batch[(r["gid"], r["src"], r["dst"])] == r["n"] for r in closed)
    days = {g for g, *_ in batch}
    assert {r["gid"] for r in closed} < days  # the last ones are open yet


def test_late_events_and_restart(spark, tmp_path):
    """A second start continues from the checkpoint: closed windows are not written again, and
    what comes for them later than the watermark is dropped."""
    schema = "ts timestamp, a long, b long, w double"

    def feed(*rows):
        spark.createDataFrame([(f"2024-01-{d:02d} 12:00:00", a, b, w) for d, a, b, w in rows], "ts string, a long, b long, w double").selectExpr("cast(ts AS timestamp) AS ts", "a", "b", "w").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        write_edges(windowed_edges(stream, "ts", "a", "b", "w", late="2 days"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(180)
        return sorted((r["gid"][:10], r["src"], r["dst"], r["weight"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = feed((1, 1, 2, 1.0), (1, 2, 1, 2.0), (3, 1, 3, 1.0), (9, 1, 2, 5.0))
    assert first == [("2024-01-01", 1, 2, 3.0, 2), ("2024-01-03", 1, 3, 1.0, 1)]
    second = feed((1, 1, 2, 100.0), (8, 4, 4, 1.0), (8, 4, 5, 1.0), (20, 1, 2, 1.0))  # the first is late, the next a loop
    assert second == [*first, ("2024-01-08", 4, 5, 1.0, 1), ("2024-01-09", 1, 2, 5.0, 1)]


def test_sliding_windows(spark):
    rows = [("2024-01-01 06:00:00", 1, 2, 1.0), ("2024-01-01 18:00:00", 2, 1, 2.0)]
    e = spark.createDataFrame(rows, "ts string, a long, b long, w double").withColumn("ts", F.to_timestamp("ts"))
    got = {r["gid"]: (r["weight"], r["n"]) for r in windowed_edges(e, "ts", "a", "b", "w", "1 day", "12 hours").collect()}
    assert got == {"2023-12-31 12:00": (1.0, 1), "2024-01-01 00:00": (3.0, 2), "2024-01-01 12:00": (2.0, 1)}
