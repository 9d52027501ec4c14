import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from netloom.llm import exact_dedup, line_dedup, minhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [16, 1])
def test_exact(docs, rows, size):
    """With identifiers of one byte most stand for several strings; results don't change."""
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append(d)
    got = exact_dedup.exact_dedup(docs, size).collect()
    assert len(got) == len(rows)
    import hashlib

    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((d for d in ids if d is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by.keys())


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_cuts_follow_content():
    data = np.random.default_rng(0).integers(97, 123, 40_000).astype(np.uint8).tobytes()
    a, b = exact_dedup.cuts(data), exact_dedup.cuts(b"xyz" + data)
    assert a[-1] == len(data) and max(np.diff([0, *a])) <= exact_dedup.MOST
    assert len({x + 3 for x in a} & set(b)) > len(a) - 4


def lines_of(df):
    return {r.doc_id: r for r in line_dedup.line_dedup(df).select("doc.*", "line_dedup.*").collect()}


def test_lines_as_sql(spark, docs, rows):
    """The fixture of odd rows in DuckDB; `bands`, `row` and other names pass through."""
    import pandas as pd

    duckdb = pytest.importorskip("duckdb")
    extra = [(700 + i, f"own {i}\nOk\n{'x ' * i}\n\t\n a line of all sites ", "en", f"s{i}", 1, None, None, None) for i in range(7)]
    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in rows + extra], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.execute(line_dedup.OP5_SQL).fetchall(), key=repr)
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = line_dedup.line_dedup(df)
    got = sorted((tuple(r) for r in out.select("doc.doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "doc.text").collect()), key=repr)
    assert got == want and sum(r[2] for r in got) >= 14
    assert out.select("doc.*").columns == df.columns
    clash = df.withColumnRenamed("row", "line_dedup")
    assert line_dedup.cleaned(clash).columns == clash.columns and line_dedup.cleaned(clash).where("line_dedup = 'y'").count() == df.where("row = 'y'").count()


def test_lines(spark, docs, empty):
    line = "this very line is on every site"
    rows = [(i, f"unique words of document {i} that nobody else has\n{line}\nshort\n" if i < 12 else "of its own and longer than the rest", "x", f"s{i % 6}", 1) for i in range(14)]
    rows += [(50 + i, f"{line}", "x", f"s{i}", 1) for i in range(6)]  # nothing but the line: a copy, kept
    rows += [(60, f"two sites only is fine here\n{line}\nthen more text of it", "x", None, 1), (61, None, "x", "s1", 1), (62, "", "x", "s1", 1), (60, f"two sites only is fine here\n{line}\nthen more text of it", "x", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = lines_of(df)
    assert got[0].text == "unique words of document 0 that nobody else has\n" and got[0].n_removed == 2
    assert got[12].text == rows[12][1] and got[50].text == line and got[60].text == "two sites only is fine here\nthen more text of it"
    assert got[61].text is None and got[61].n_lines == 0 and got[62].text == ""
    assert line_dedup.line_dedup(df).count() == len(rows)
    assert line_dedup.line_dedup(docs).count() == docs.count() and line_dedup.line_dedup(empty).collect() == []


def test_short_lines(spark):
    """Lines of one to three words are judged too; blank lines stay."""
    rows = [(i, f"the own words of document {i} are these\n\n\t\n All rights reserved. \nOk\n", f"s{i}") for i in range(5)]
    rows += [(9, "All rights reserved. Not\nmore of it here", "s9")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = lines_of(df)
    for i in range(5):
        assert got[i].text == f"the own words of document {i} are these\n\n\t\n" and got[i].n_removed == 2
    assert got[9].text == rows[5][1]


def test_short_lines_in_pipeline(spark):
    import corpus_pipeline

    rows = [(i, f"the own words of document {i} are these\nAll rights reserved.", "en", f"s{i}", 60) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.without_boilerplate(spark, df, "").collect()
    assert len(got) == 5 and all(r.text == f"the own words of document {r.doc_id} are these" and r.n_chars == len(r.text) for r in got)


def test_only_copies_are_spared(spark):
    """A text of its own loses its boilerplate whatever is left; one that recurs keeps it."""
    long = "this very long line is on every site and says nothing of the document that holds it, " * 2 + "so there"
    rows = [(i, f"of {i}\n{long}\nso {i}", f"s{i}") for i in range(6)]
    rows += [(10, long, "s1"), (11, long, "s2"), (12, f"{long}\n", "s3")]  # two copies, and a text of its own
    rows += [(13, f"{long}\n\n", "s4")] * 2  # a repeated row
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = lines_of(df)
    for i in range(6):
        assert got[i].text == f"of {i}\nso {i}" and got[i].n_removed == 1
    assert got[10].text == got[11].text == long and got[12].text == "" and got[13].text == f"{long}\n\n"
    assert line_dedup.line_dedup(df).count() == len(rows)


def bag(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows):
    bags = [(d, bag(t)) for d, t, *_ in rows]
    parent = list(range(len(bags)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(bags)):
        for j in range(i):
            a, b = bags[i][1], bags[j][1]
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    out = defaultdict(list)
    for i, (d, _) in enumerate(bags):
        out[find(i)].append(d)
    return out


def test_near(docs, rows):
    want = {}
    for ids in classes(rows).values():
        for d in ids:
            want[d] = (min((x for x in ids if x is not None), default=None), len(ids))
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.class_id, r.class_size) == want[r.doc_id], r
    assert sum(r.kept for r in got) == len(classes(rows))
    assert minhash.keep_one(docs).count() == len(classes(rows))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables")
def test_near_on_the_given_documents(spark):
    """Recall and precision against all pairs of whole texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = {d: min(ids) for ids in classes(rows).values() for d in ids}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == want and len(set(want.values())) < len(rows)


def test_near_blocks_find_chained_links(spark):
    """Texts that are like their neighbours only: no leader reaches all of them."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[4 * i : 4 * i + 200])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.class_id for r in minhash.near_duplicates(df).collect()} == {0}


def test_near_empty(empty):
    assert minhash.near_duplicates(empty).collect() == []


def test_signature_is_unbiased_for_multisets():
    rng = np.random.default_rng(0)
    e = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    element = np.concatenate([e[a > 0], e[b > 0]])
    of = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    s = minhash.signatures(element, of, np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - truth) < 0.03
