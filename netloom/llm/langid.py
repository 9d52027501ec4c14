"""Language identification with a blended-spectrum string kernel.

Texts are sequences of letters (lower case, of any script, each its own code point) and word
boundaries: everything else is one, and boundaries in a row are one. An n-gram (n = 1, 2, 3)
is an exact 63-bit number of its code points, so scripts never share any. The kernel of two
texts is the number of n-grams that both have, over the geometric mean of how many each has.
`LANDMARKS` documents (at least two of every language) span the Nystroem feature map, and one
kernel ridge regression for each language against the rest is solved there. Map and
regressions are one matrix, so scoring a batch is two matrix products: presence times
landmarks, kernel times weights.

Fitting takes a bounded, documented sample: up to `SAMPLE` documents in all, the same number
of every language (one at least), those with the least hash, of at most `FIT_CHARS`
characters. Every text
is scored whole. The score of the best language is its share of the clipped outputs.

A text that is null or has no letter is `und` with score 0; so is every text if there is
nothing to learn from. Of languages whose outputs tie the first in order is taken; a text
that shares no n-gram with any landmark is decided by the intercepts. Repeated rows get equal
results, an empty table an empty one; other columns are not read. A task holds the presence
rows of up to 512 texts (2 MB of text, or the longest one).
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import chunks, documents

SAMPLE, FIT_CHARS, LANDMARKS, RIDGE = 2000, 20_000, 128, 1e-3
EDGE = 1  # a word boundary; 0 pads shorter n-grams, and neither is a letter


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point the one of its lower case if it is a letter, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0])
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of the text, sorted; none without letters."""
    c = _letters()[_code_points(text)].astype(np.int64)
    c[c == 0] = EDGE
    c = np.concatenate([[EDGE], c, [EDGE]])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != EDGE) | (c[:-1] != EDGE)
    c = c[keep]
    if len(c) < 3:
        return c[:0]
    two = c[:-1] << 21 | c[1:]
    return np.unique(np.concatenate([c, two, two[:-1] << 21 | c[2:]]))


def presence(found: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Places in `columns` (sorted) of the n-grams found."""
    at = np.minimum(np.searchsorted(columns, found), len(columns) - 1)
    return at[columns[at] == found]


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict | None:
    """The model, of texts in hash order. All of it is small: landmarks x n-grams."""
    names = sorted(set(langs))
    found = [grams(t) for t in texts]
    good = [i for i, g in enumerate(found) if len(g)]
    if not good:
        return None
    langs, found = [langs[i] for i in good], [found[i] for i in good]
    rank: Counter = Counter()
    order = []
    for i, lang in enumerate(langs):  # in turn one of each language
        order.append((rank[lang], i))
        rank[lang] += 1
    marks = [i for _, i in sorted(order)[: max(landmarks, 2 * len(names))]]
    columns = np.unique(np.concatenate([found[i] for i in marks]))
    x = np.zeros((len(found), len(columns)), np.float32)
    for row, g in zip(x, found):
        row[presence(g, columns)] = 1
    sizes = np.array([len(g) for g in found], np.float64)
    base = (x[marks] / np.sqrt(sizes[marks])[:, None].astype(np.float32)).T.copy()  # columns x landmarks
    k = (x @ base).astype(np.float64) / np.sqrt(sizes)[:, None]
    values, vectors = np.linalg.eigh(k[marks])
    good = values > 1e-8 * values.max()
    nystroem = vectors[:, good] / np.sqrt(values[good])
    f = np.hstack([k @ nystroem, np.ones((len(k), 1))])
    y = np.array([[lang == n for n in names] for lang in langs], np.float64)
    weight = np.array([1 / rank[lang] for lang in langs])[:, None]  # languages count alike
    gram = f.T @ (weight * f) + ridge * np.eye(f.shape[1])
    w = np.linalg.solve(gram, f.T @ (weight * y))
    return {"names": names, "columns": columns, "base": base, "weights": nystroem @ w[:-1], "bias": w[-1]}


def predict(model: dict | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if model is None or not texts:
        return names, scores
    x = np.zeros((len(texts), len(model["columns"])), np.float32)
    n = np.zeros(len(texts))
    for i, t in enumerate(texts):
        if t:
            g = grams(t)
            x[i, presence(g, model["columns"])] = 1
            n[i] = len(g)
    k = (x @ model["base"]) / np.sqrt(np.maximum(n, 1))[:, None]
    out = np.clip(k @ model["weights"] + model["bias"], 0, None)
    best = out.argmax(1)
    share = out.max(1) / np.maximum(out.sum(1), 1e-12)
    for i in np.flatnonzero(n):
        names[i], scores[i] = model["names"][best[i]], float(min(1.0, share[i]))
    return names, scores


def sample(docs: DataFrame, total: int = SAMPLE, longest: int = FIT_CHARS) -> tuple[list[str], list[str]]:
    """Texts and languages of up to `total` documents that aren't held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("text", "lang", F.xxhash64("doc_id", "text").alias("h")).where((F.length("text") <= longest) & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not counts:
        return [], []
    each = max(1, total // len(counts))
    # the least hashes of each language: a coarse threshold first, so that the exact order is of few rows
    span = 2.0**64
    limit = F.coalesce(*(F.when(F.col("lang") == r["lang"], -(2.0**63) + span * min(1.0, (3 * each + 50) / r["n"])) for r in counts)) if len(counts) <= 200 else None
    coarse = known if limit is None else known.where(F.col("h") <= limit)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    rows = coarse.withColumn("rank", rank).where(F.col("rank") <= each).orderBy("h", "text").select("text", "lang").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each of docs(doc_id, text, lang)."""
    texts, langs = sample(docs, **options)
    model = fit(texts, langs) if texts else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in chunks(batches, limit=2_000_000):
            for k in range(0, part.num_rows, 512):
                some = part.slice(k, 512)
                names, scores = predict(m, some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), some.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
