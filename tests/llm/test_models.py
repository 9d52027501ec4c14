import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import langid, mixing, sharding, toxicity


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0


def test_sizes_and_targets(spark):
    rows = [("a", 10), ("b", 1000), ("c", 1), ("d", 0), ("e", 500)]
    df = spark.createDataFrame(rows, "skey string, source_size bigint")
    got = {r.skey: r.target for r in mixing.targets(df).collect()}
    sizes, weights = dict(rows), dict(zip("abcde", [5, 2, 1, 5, 2]))
    total, fixed = sum(sizes.values()), {}
    while True:  # share again what is over, until none is above
        rest = [k for k in sizes if k not in fixed]
        left = total - sum(fixed.values())
        share = {k: left * weights[k] / sum(weights[x] for x in rest) for k in rest}
        over = {k: 3.0 * sizes[k] for k in rest if share[k] > 3 * sizes[k]}
        if not over:
            break
        fixed |= over
    for k, v in (fixed | share).items():
        assert math.isclose(got[k], v, abs_tol=1e-9), k


def test_mix(spark, docs, empty):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(n), f"s{i % 4}" if i % 9 else None) for i, n in enumerate(rng.integers(1, 80, 400))] + [(900, None, "s1"), (901, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixture(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in got)
    source, taken, target = {i: s for i, _, s in rows}, {}, {}
    for r in got:  # by source: two sources of the same weight have the same target
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert len(target) == 5 and all(abs(taken[k] / target[k] - 1) < 0.01 for k in target)
    assert sorted(map(tuple, mixing.mixture(df.repartition(5)).collect())) == sorted(map(tuple, got))
    assert mixing.mixed(df).where("text <> ''").select(F.sum(F.regexp_count("text", F.lit("w")))).first()[0] == sum(taken.values())
    assert mixing.mixture(docs).count() == docs.count() and mixing.mixture(empty).collect() == []


def test_newton_meets_its_constraint(spark):
    h = spark.createDataFrame([("a", 1, 50), ("a", 100, 3), ("b", 7, 10)], "skey string, size bigint, n bigint")
    g = spark.createDataFrame([("a", 350, 700.0), ("b", 70, 20.0)], "skey string, source_size bigint, target double")
    for r in mixing.balance(h, g).collect():
        rows = [(s, n) for k, s, n in [("a", 1, 50), ("a", 100, 3), ("b", 7, 10)] if k == r.skey]
        total = sum(n * s * min(3, math.exp(r.lam * (s / r.mean) ** mixing.TILT)) for s, n in rows)
        assert math.isclose(total, r.target, rel_tol=1e-6)


def test_language(spark, docs, empty):
    rng = np.random.default_rng(1)
    make = {"xx": "abcdefg", "yy": "mnopqrs", "zz": "abmnxyé"}
    rows = [(i, " ".join("".join(rng.choice(list(make[k]), rng.integers(2, 8))) for _ in range(20)), k) for i, k in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [(900, None, "xx"), (901, "123 !!", "xx"), (902, "", None), (903, "mnop qrs nop", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    test = [(d, k) for d, _, k in rows if d < 900 and held(d)]
    assert all(got[d].held_out == held(d) for d, *_ in rows)
    assert np.mean([got[d].lang_pred == k for d, k in test]) > 0.9
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902)) and got[903].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs).count() == docs.count() and langid.identify(empty).collect() == []
    unknown = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang_pred == "und" for r in unknown)


def letters(text):
    """Its words as tuples of lower-case letters, and all n-grams over word boundaries."""
    seq = [" "]
    for c in text:
        x = c.lower()[0] if c.isalpha() else " "
        if x != " " or seq[-1] != " ":
            seq.append(x)
    if seq[-1] != " ":
        seq.append(" ")
    return {tuple(seq[i : i + n]) for n in (1, 2, 3) for i in range(len(seq) - n + 1)} if len(seq) > 1 else set()


def test_kernel_by_hand():
    assert len(langid.grams("AB")) == 3 + 3 + 2  # edge a b; edge-a a-b b-edge; two of three
    for t in ("", "12 !", "Ab, ab", "дом 中文 x", "a" * 50, "Straße  İ"):
        assert len(langid.grams(t)) == len(letters(t))


def test_language_by_brute_force():
    """Kernel, Nystroem map and ridge regressions again, with sets and a plain solve; scripts
    that no other text has, ties, and a text without known n-grams."""
    rng = np.random.default_rng(4)
    make = {"a": "abcdef", "b": "defghi", "c": "абвгд", "d": "中文字母"}
    texts, langs = [], []
    for i in range(80):
        k = "abcd"[i % 4]
        texts.append(" ".join("".join(rng.choice(list(make[k]), rng.integers(2, 6))) for _ in range(8)))
        langs.append(k)
    model = langid.fit(texts, langs, 20)
    marks = [i for _, i in sorted((sum(x == y for y in langs[:i]), i) for i, x in enumerate(langs))][:20]
    sets = [letters(t) for t in texts]
    kernel = lambda s, t: len(s & t) / math.sqrt(len(s) * len(t)) if s and t else 0.0
    k = np.array([[kernel(s, sets[m]) for m in marks] for s in sets])
    values, vectors = np.linalg.eigh(k[marks])
    good = values > 1e-8 * values.max()
    f = np.hstack([k @ (vectors[:, good] / np.sqrt(values[good])), np.ones((80, 1))])
    w = np.linalg.solve(f.T @ f / 20 + langid.RIDGE * np.eye(f.shape[1]), f.T @ np.array([[x == y for y in "abcd"] for x in langs], float) / 20)
    out = np.clip(f @ w, 0, None)
    names, scores = langid.predict(model, texts)
    assert names == ["abcd"[i] for i in out.argmax(1)] and np.allclose(scores, out.max(1) / out.sum(1), atol=1e-4)
    assert langid.predict(model, ["вода", "文", None, "7", "Ωμ"])[0][:4] == ["c", "d", "und", "und"]
    tie = langid.fit(["same text"] * 4, ["q", "p", "q", "p"])
    assert langid.predict(tie, ["same text"])[0] == ["p"]
    many = [(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}", f"l{i:03d}") for i in range(300)] * 2  # more languages than landmarks
    model = langid.fit([t for t, _ in many], [x for _, x in many])
    assert langid.predict(model, [t for t, _ in many])[0] == [x for _, x in many]


def test_nearest_is_exact():
    """Blocks, postings and bounds against all cosines; whatever is common or seldom."""
    rng = np.random.default_rng(2)
    v = rng.random((200, 60)) * (rng.random((200, 60)) < np.linspace(0.01, 0.6, 60))
    v[5] = v[6] = v[7]  # ties
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    for common in (0, 20, 1000):
        index = toxicity.Index([(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in v], 60, 8, common)
        for i, q in enumerate(v[:60]):
            c = np.flatnonzero(q)
            near, cos = index.nearest(c, q[c], 7, but=i)
            brute = sorted(((-round(float(x), 6), j) for j, x in enumerate(v @ q) if x > 0 and j != i))[:7]
            assert np.allclose(cos, [-x for x, _ in brute], atol=2e-6)
            assert len(near) == len(brute) and (near.tolist() == [j for _, j in brute] or len(set(near) ^ {j for _, j in brute}) <= 2)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        w = list(rng.choice(plain, 30)) + (["vile", "stemfoo" if i % 2 else "stembar"] if bad else [])
        rows.append((i, " ".join(w), 1))
        labels.append((i, int(bad)))
    rows += [(900, None, 1), (901, "", 1)]
    labels += [(900, 0), (3, 0), (7777, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").drop("toxic")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc.doc_id: r.toxicity for r in toxicity.score(df, lab).collect()}
    test = [(d, int(d % 5 == 0)) for d in range(500) if held(d)]
    assert all((got[d].score >= 0.5) == y for d, y in test) and got[900].score < 0.5
    assert got[0].evidence and not got[900].evidence and all(0 <= t.score <= 1 for t in got.values())
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.toxicity.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, lab).collect() == []
    # a column of the result's name stays what it is; repeated rows score alike
    clash = df.withColumns({"toxicity": F.lit("mine"), "doc": F.lit(7)}).unionByName(df.withColumns({"toxicity": F.lit("mine"), "doc": F.lit(7)}).where("doc_id < 20"))
    out = toxicity.without_toxic(clash, lab)
    assert out.columns == clash.columns and {(r.toxicity, r.doc) for r in out.collect()} == {("mine", 7)}
    assert out.count() == sum(got[r.doc_id].score < 0.5 for r in clash.collect())


def test_toxicity_by_brute_force(spark):
    """Whole texts: vectors, neighbours, votes and the calibrated score, by dictionaries."""
    rng = np.random.default_rng(8)
    plain = [f"w{i}ord" for i in range(80)]
    rows = [(i, " ".join([*rng.choice(plain, rng.integers(5, 40)), *(["vile", "Fool!"] if i % 6 == 0 else [])])) for i in range(240)] + [(900, None), (901, "?"), (902, "unseen alone")]
    labels = [(i, int(i % 6 == 0)) for i in range(240)]
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(df, lab)
    got = {r.doc.doc_id: r.toxicity for r in toxicity.score(df, lab).collect()}
    marks, texts, toxic = model.terms.marks, dict(rows), dict(labels)
    assert any(m.startswith(("vil", "foo")) for m in marks)

    def terms(text):
        f = toxicity.features(text)
        return {("", w): n for w, n in toxicity.words(text).items() if w in model.terms.at} | {("#", t): f[t] for t in marks if f[t]}

    seen = {i: terms(t) for i, t in rows}
    df_of = {}
    for t in seen.values():
        for x in t:
            df_of[x] = df_of.get(x, 0) + 1
    weight = lambda x, n: (1 + math.log(n)) * (math.log((len(rows) + 1) / (df_of[x] + 1)) + 1) * (toxicity.BOOST if x[0] else 1)
    vectors = {}
    for i, t in seen.items():
        v = {x: weight(x, n) for x, n in t.items()}
        norm = math.sqrt(sum(y * y for y in v.values()))
        vectors[i] = {x: y / norm for x, y in v.items()}
    known = [i for i in toxic if not held(i)]
    total = {y: sum(toxic[i] == y for i in known) for y in (0, 1)}
    assert total[0] < toxicity.EACH  # all are examples: each stands for itself
    for i in range(0, 240, 7):
        near = sorted((-round(sum(y * vectors[j].get(x, 0) for x, y in vectors[i].items()), 6), j) for j in known)[: toxicity.NEAREST]
        vote = sum(-c * toxic[j] for c, j in near) / sum(-c for c, _ in near)
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-(model.a * vote + model.b))), abs_tol=1e-4)
        assert len(set(got[i].evidence) ^ {j for _, j in near}) <= 2  # rounding at the last place
    assert {got[i].score for i in (900, 901, 902)} == {model.bare} and not got[902].evidence



def test_lookup_table():
    names = sharding.names(7)
    t = sharding.lookup_table(names, 1009)
    counts = np.bincount(t)
    assert len(t) == 1009 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(t, fewer) if a != 6)
    assert moved < 0.2 * 1009
    # by brute force: in turn, the first free slot of each preference list
    pref = [[(sharding._number(f"start:{x}") + j * (sharding._number(f"step:{x}") % 1008 + 1)) % 1009 for j in range(1009)] for x in names]
    slots = {}
    while len(slots) < 1009:
        for i, p in enumerate(pref):
            if len(slots) < 1009:
                slots[next(s for s in p if s not in slots)] = i
    assert [slots[s] for s in range(1009)] == list(t)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_place(docs, empty):
    got = sharding.place(docs.withColumnRenamed("row", "slot"), "doc_id", sharding.names(5), 1009)
    assert got.count() == docs.count() and got.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sharding.place(empty, "doc_id", sharding.names(5), 1009).collect() == []
