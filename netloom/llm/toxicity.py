"""Toxicity by the nearest labelled examples.

From a bounded sample of labelled documents (`EACH` toxic and as many others, those with the
least hash, of at most `FIT_CHARS` characters) come the examples. Their vocabulary is every
word (lower case) that any of them has, and further terms: beginnings of words (`wor`: 3 to 7
letters: stems), whole words (`word$`), and either of them at least 2, 3 or 5 times in a text
(`wor#2`), where toxic examples have them significantly more often (chi-squared of `CHI`,
`LIFT` times as often, in `LEAST_DF` texts; of those that are in the same texts one). There
is no limit to their number, and they only add to the words: they weigh `BOOST` times as
much. Terms are weighted by (1 + ln tf) times idf, with document frequencies counted over all
documents, and vectors have length 1.

The examples' vectors form an inverted index in blocks of `BLOCK` neighbouring vectors.
Terms that under `COMMON` examples have are added up through their postings; the others have
a maximum in each block. Both bound a block's cosines; blocks are opened in falling order of
the bound until none can hold one of the `NEAREST`: the neighbours are those of exact cosines
(ties at six digits: the smaller doc_id). Their similarities, times what one sampled document
of their label stands for, are votes; a logistic curve fitted to the leave-one-out votes of
the sample makes them a probability. The neighbours' ids are the evidence.

Every text is scored whole, and one with any known word gets neighbours. Texts without (nulls
and empty texts among them) score the weighted share of toxic ones among such examples.
Without labels of both kinds the score is that of the labels there are (0 if none). Label and
document rows with the same id are taken once each; repeated rows get equal scores, an empty
table gives an empty result. Input columns travel in a struct, so no name clashes. A task
holds the model (bounded by the sample) and the words of one text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import chunks, documents, packed, unpacked
from netloom.llm.langid import held_out

EACH, FIT_CHARS = 1500, 50_000
CHI, LEAST_DF, LIFT, BOOST = 24.0, 3, 3.0, 4.0
STEMS, LEVELS = (3, 4, 5, 6, 7), (2, 3, 5)
BLOCK, COMMON, NEAREST = 256, 300, 15
_WORDS = re.compile(r"\w+")


def features(text: str | None) -> Counter:
    """All terms of a text, with their counts."""
    out: Counter = Counter()
    for w, n in Counter(_WORDS.findall(text.lower()) if text else ()).items():
        out[w + "$"] += n
        for k in STEMS:
            if len(w) >= k:
                out[w[:k]] += n
    for t, n in list(out.items()):
        for level in LEVELS:
            if n >= level:
                out[f"{t}#{level}"] = 1
    return out


def words(text: str | None) -> Counter:
    return Counter(_WORDS.findall(text.lower()) if text else ())


class Terms:
    """Counts the terms of a vocabulary: plain words, and `marks` as of `features`. Words
    that start like none of the marks cost two look-ups."""

    def __init__(self, plain: list[str], marks: list[str]):
        self.at = {w: i for i, w in enumerate(plain)}
        self.marks = {t: len(plain) + i for i, t in enumerate(marks)}
        self.base = {t.partition("#")[0] for t in marks}
        self.heads = {t.removesuffix("$")[:3] for t in self.base}

    def count(self, text: str | None) -> dict[int, int]:
        heads, base, at, found, seen = self.heads, self.base, self.at, Counter(), words(text)
        out = {at[w]: n for w, n in seen.items() if w in at}
        for w in [w for w in seen if w[:3] in heads]:
            n = seen[w]
            if w + "$" in base:
                found[w + "$"] += n
            for k in STEMS:
                if len(w) >= k and w[:k] in base:
                    found[w[:k]] += n
        for t, n in found.items():
            if (i := self.marks.get(t)) is not None:
                out[i] = n
            for level in LEVELS:
                if n >= level and (i := self.marks.get(f"{t}#{level}")) is not None:
                    out[i] = 1
        return out


def choose(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Features that toxic texts have significantly more often, `LIFT` times at least."""
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    bad: Counter = Counter()
    for t, y in zip(texts, toxic):
        if y:
            bad.update(features(t).keys())
    bad = Counter({x: a for x, a in bad.items() if a >= LEAST_DF and a * (n0 + 2) >= LIFT * n1})
    good: Counter = Counter()
    those = Terms([], list(bad))
    for t, y in zip(texts, toxic):
        if not y:
            good.update(those.count(t).keys())
    scored = []
    for w, a in bad.items():
        b = good[those.marks[w]]
        if a * (n0 + 2) < LIFT * (b + 1) * n1:
            continue
        c, d = n1 - a, n0 - b
        chi = (n0 + n1) * (a * d - b * c) ** 2 / max(1.0, float(n1) * n0 * (a + b) * (c + d))
        if chi >= CHI:
            scored.append((-chi, len(w), w))
    those = Terms([], [w for _, _, w in sorted(scored)])
    where: list[list[int]] = [[] for _ in scored]
    for i, t in enumerate(texts):
        for k in those.count(t):
            where[k].append(i)
    out: dict = {}
    for w, k in those.marks.items():
        out.setdefault(tuple(where[k]), w)
    return list(out.values())


class Index:
    """A block-max inverted index of sparse unit vectors [(columns, weights), ...]."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int, block: int = BLOCK, common: int = COMMON):
        n = len(vectors)
        df = np.zeros(size, np.int64)
        for c, _ in vectors:
            df[c] += 1
        self.common = np.full(size, -1, np.int64)  # their columns of `dense`
        often = np.flatnonzero(df >= common)
        self.common[often] = np.arange(len(often))
        main = np.full(n, -1, np.int64)
        for i, (c, w) in enumerate(vectors):
            at = self.common[c]
            if (at >= 0).any():
                main[i] = c[np.where(at >= 0, w, -1).argmax()]
        self.order = np.lexsort((np.arange(n), main))  # neighbours share their main term: tight bounds
        self.dense = np.zeros((-(-n // block), len(often), block), np.float32)
        rows, columns, weights = [], [], []
        for r, i in enumerate(self.order):
            c, w = vectors[i]
            at = self.common[c]
            self.dense[r // block, at[at >= 0], r % block] = w[at >= 0]
            columns.append(c[at < 0])
            weights.append(w[at < 0])
            rows.append(np.full(len(columns[-1]), r, np.int32))
        rows, columns, weights = (np.concatenate(x) if x else np.zeros(0) for x in (rows, columns, weights))
        by = np.argsort(columns, kind="stable")
        self.rows, self.weights = rows[by].astype(np.int32), weights[by].astype(np.float32)
        self.first = np.searchsorted(columns[by], np.arange(size + 1))
        self.starts, self.block = np.arange(0, n, block), block
        self.most = self.dense.max(2, initial=0).T.copy()  # terms x blocks

    def nearest(self, columns: np.ndarray, weights: np.ndarray, k: int = NEAREST, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar vectors of those that share a term with the query (ties: the
        smaller number), and their cosines; without vector `but`."""
        n = len(self.order)
        if not n or not len(columns):
            return np.zeros(0, np.int64), np.zeros(0)
        at = self.common[columns]
        seldom = np.flatnonzero(at < 0)
        lengths = self.first[columns[seldom] + 1] - self.first[columns[seldom]]
        seldom, lengths = seldom[lengths > 0], lengths[lengths > 0]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[columns[seldom]] - ends + lengths, lengths)
        scores = np.bincount(self.rows[take], self.weights[take] * np.repeat(weights[seldom], lengths), n)
        often, q = at[at >= 0], weights[at >= 0].astype(np.float32)
        bounds = np.maximum.reduceat(scores, self.starts) + q @ self.most[often]
        found, cosines, top, worst = [], [], np.zeros(0), -1.0
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or bounds[b] < worst - 2e-6:
                break
            at = self.starts[b]
            c = scores[at : at + self.block] + (q @ self.dense[b][often])[: n - at]
            good = np.flatnonzero(c > max(worst - 1e-6, 0))
            if not len(good):
                continue
            c, mine = c[good].round(6), self.order[at + good]
            if but >= 0:
                c, mine = c[mine != but], mine[mine != but]
            found.append(mine)
            cosines.append(c)
            top = np.concatenate([top, c])
            if len(top) >= k:
                top = np.partition(top, -k)[-k:]
                worst = float(top[0])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        found, cosines = np.concatenate(found), np.concatenate(cosines)
        good = np.flatnonzero((cosines > 0) & (cosines >= worst))
        best = good[np.lexsort((found[good], -cosines[good]))][:k]
        return found[best], cosines[best]


class Model:
    def __init__(self, terms: Terms, weight: np.ndarray, texts: list[str], toxic: np.ndarray, stands_for: np.ndarray, ids: list[int]):
        """`weight`: idf times boost of each term; texts in order of doc_id."""
        self.terms, self.idf, self.ids = terms, weight, np.array(ids, np.int64)
        self.weight, self.toxic = stands_for, toxic.astype(np.float64)
        vectors = [self.vector(t) for t in texts]
        self.rows = np.array([i for i, (c, _) in enumerate(vectors) if len(c)], np.int64)
        bare = np.array([not len(c) for c, _ in vectors])
        w, one = self.weight * bare, float(self.weight[~bare].min(initial=1))
        total = float(w.sum())
        self.bare = (float((w * self.toxic).sum()) + one * self.prior()) / (total + one)
        vectors = [vectors[i] for i in self.rows]
        self.index = Index(vectors, len(weight))
        self.a, self.b = self._calibrate(vectors)

    def prior(self) -> float:
        return float((self.weight * self.toxic).sum() / self.weight.sum())

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = self.terms.count(text)
        columns = np.fromiter(found.keys(), np.int64, len(found))
        values = (1 + np.log(np.fromiter(found.values(), np.float64, len(found)))) * self.idf[columns]
        n = math.sqrt(values @ values)
        return columns, (values / n if n else values)

    def _votes(self, columns: np.ndarray, weights: np.ndarray, but: int = -1) -> tuple[float | None, np.ndarray]:
        near, cosines = self.index.nearest(columns, weights, but=but)
        if not len(near):
            return None, near
        rows = self.rows[near]
        v = cosines * self.weight[rows]
        return float((v * self.toxic[rows]).sum() / v.sum()), rows

    def _calibrate(self, vectors: list) -> tuple[float, float]:
        votes, y, w = [], [], []
        for i, (columns, x) in enumerate(vectors):
            s, _ = self._votes(columns, x, but=i)
            if s is not None:
                votes.append(s), y.append(self.toxic[self.rows[i]]), w.append(self.weight[self.rows[i]])
        a, b = 6.0, -3.0
        if not votes or not 0 < sum(y) < len(y):
            return a, b
        x, y, w = np.column_stack([votes, np.ones(len(votes))]), np.array(y), np.array(w)
        w = w / w.mean()
        n1, n0 = (w * y).sum(), (w * (1 - y)).sum()
        goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        beta, prior = np.array([a, b]), np.array([a, b])
        for _ in range(50):  # Newton on the penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = x.T @ (w * (p - goal)) + 0.1 * (beta - prior)
            h = (x.T * (w * p * (1 - p))) @ x + 0.1 * np.eye(2)
            step = np.linalg.solve(h, g)
            beta = beta - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (a, b)

    def score(self, text: str | None, memo: dict) -> tuple[float, tuple[int, ...]]:
        key = hash(text)
        if key not in memo or memo[key][0] != text:
            if len(memo) > 1000:
                memo.clear()
            s, rows = self._votes(*self.vector(text))
            memo[key] = text, (self.bare if s is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * s + self.b)))), tuple(self.ids[rows].tolist()))
        return memo[key][1]


def examples(docs: DataFrame, labels: DataFrame, each: int = EACH, longest: int = FIT_CHARS) -> tuple[list, dict[int, int]]:
    """(doc_id, text, toxic) of a bounded sample of labelled documents that aren't held out;
    how many labelled documents there are of each label."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*(F.when(F.col("toxic") == y, -(2.0**63) + 2.0**64 * min(1.0, (2 * each + 50) / n)) for y, n in counts.items()), F.lit(-(2.0**63)))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id"))
    chosen = known.where(F.col("h") <= share).withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "toxic")
    texts = docs.where(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * each rows
    rows = texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).orderBy("doc_id").collect()
    return [(r["doc_id"], r["text"], r["toxic"]) for r in rows], counts


def frequencies(docs: DataFrame, terms: Terms) -> tuple[int, dict[int, int]]:
    """How many documents there are, and in how many each term is."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, n = shared.value, 0
        found = np.zeros(len(chosen.at) + len(chosen.marks), np.int64)
        for part in chunks(batches):
            for t in part.column(0).to_pylist():
                n += 1
                found[list(chosen.count(t))] += 1
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(found[seen], n), pa.int64())], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the sample
    out = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist()))
    return out.pop(-1, 0), out


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Model | float:
    rows, counts = examples(docs, labels, each)
    toxic = np.array([y for _, _, y in rows], np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        return float(toxic.mean()) if len(rows) else 0.0
    texts = [t for _, t, _ in rows]
    plain = sorted(set().union(*(words(t).keys() for t in texts)))
    terms = Terms(plain, choose(texts, toxic))
    n, df = frequencies(docs, terms)
    size = len(terms.at) + len(terms.marks)
    weight = np.log((n + 1) / (np.array([df.get(i, 0) for i in range(size)]) + 1)) + 1
    weight[len(plain) :] *= BOOST
    taken = Counter(toxic.tolist())
    stands_for = np.array([counts[y] / taken[y] for y in toxic.tolist()])
    return Model(terms, weight, texts, toxic, stands_for, [i for i, _, _ in rows])


def score(docs: DataFrame, labels: DataFrame, each: int = EACH) -> DataFrame:
    """doc (the columns of `docs`) and toxicity (score, evidence) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, each))

    @F.pandas_udf("score double, evidence array<bigint>")
    def toxicity(text: pd.Series) -> pd.DataFrame:
        model, memo = shared.value, {}
        if isinstance(model, float):
            return pd.DataFrame({"score": [model] * len(text), "evidence": [[]] * len(text)})
        found = [model.score(t, memo) for t in text]
        return pd.DataFrame({"score": [s for s, _ in found], "evidence": [list(e) for _, e in found]})

    return docs.select(packed(docs).alias("doc"), toxicity("text").alias("toxicity"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that score under 0.5."""
    return score(docs, labels, **options).where(F.col("toxicity.score") < 0.5).select(*unpacked(docs, docs.columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(documents(spark, sf_dir).select("doc_id", "text"), labels)
    rounded = F.col("toxicity.score")
    return out.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), rounded.alias("score"), (rounded >= 0.5).cast("int").alias("predicted"), F.col("toxicity.evidence").alias("evidence"))
