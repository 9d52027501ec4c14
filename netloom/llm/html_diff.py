"""Main text of web pages by nearest-URL page differencing.

1. A page is cut into lines, one per block element, by one pass over its tags. Every line is
   numbered and knows where it stands: in an element that says it is furniture (nav, header,
   footer, aside, form, script, style, ..., or a class, id or role such as `sidebar` or
   `cookie-notice`), in a marked article (`article`, `main`, role=main,
   itemprop=articleBody), or in neither.
2. Of the pages of a host those with the same lines are one. They are ordered by URL path;
   each is paired with the two of its four neighbours in that order whose paths share the
   longest prefix with its own (ties: the nearer, then the earlier one).
3. The lines of a page and of each partner are aligned by longest common subsequence, over
   all lines. Lines shared with every partner are template: they are deleted. A near-copy
   next door shares its article with one partner only, so the article stays; on a host of two
   pages the one partner decides. If nothing would be left the lines stay.
4. Two refinements by tags: lines inside a marked article are never deleted, so that an
   article that several URLs carry, or a sentence that two articles share, stays whole; and
   lines in furniture go even where they differ from page to page, as menus do.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by a line feed. Null or empty html gives an empty text, a null url an empty host and
path; repeated rows get equal results, an empty table an empty result. Other columns are not
read. Pairing and alignment see 64-bit hashes of lines, not the text: pages are numbered in
URL order by ranges, and neighbours meet by number, so a host of any size spreads over all
tasks. The html itself is parsed twice and joined with the numbers of the lines to delete.
The alignment of pages of n and m lines that both hold takes n x m / 64 steps and, split at
the middle of the longer ones (Hirschberg), memory for n + m; a page is otherwise held once.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import chunks, content_key, staged

PARTNERS, REACH = 2, 2
PARTITION_PAGES = 20_000
ROW_BITS = 1 << 25  # of the alignment's table; longer ones are split
FURNITURE, ARTICLE = 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+", re.I)
_SPACE = re.compile(r"\s+")
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SHORT = set("p li dt dd option tr td th thead tbody tfoot".split())  # ended by the next block
DROPPED = set("nav header footer aside form head title button select dialog menu object audio video canvas map fieldset".split())
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar rail menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices alert disclaimer header masthead footer foot copyright comment comments respond reply disqus discussion share sharing social follow "
    "newsletter subscribe subscription signup login popup modal overlay related recommended recommendations widget toolbar pagination pager skip hidden".split()
)
#: what may stand beside such a word in one class: `site-header`, `ad-slot`, `comment-list`
QUALIFIERS = set("site page global top bottom left right main primary secondary inner outer box bar list item items area section block slot unit wrap wrapper container content links posts form buttons icons side column col row text title".split())
TEASERS = set("ad ads advert comment comments reply related recommended sponsored promo teaser".split())  # of article elements
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _kind(name: str, attributes: str, in_article: bool) -> int:
    """1: boilerplate, 2: an article's container, 3: the header inside an article, of which
    the headings stay, 0: neither."""
    words: set[str] = set()
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key == "hidden" and m[2] is None or key == "aria-hidden" and value == "true":
                return 1
            if key == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"):
                return 1
            if key == "role" and value in ("main", "article") or key == "itemprop" and value == "articlebody":
                return 2
            if key in ("class", "id"):
                for one in value.split():  # a class counts as a whole: all its parts have to agree
                    parts = [x for x in _WORD.findall(one) if not x.isdigit()]
                    if all(x in DROPPED_WORDS or x in TEASERS or x in QUALIFIERS for x in parts):
                        words.update(parts)
    if name in ("article", "main"):
        return 1 if words & TEASERS else 2
    if name in DROPPED:
        return 3 if name == "header" and in_article else 1
    return 1 if words & DROPPED_WORDS and name not in ("html", "body") else 0


def lines(page: str | None) -> list[tuple[int, str]]:
    """The page's lines, each with 1 for furniture, 2 for a marked article, 0 for neither."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that count, and their kind
    skip = article = 0
    header = heading = 0

    def flush() -> None:
        if text:
            if line := _SPACE.sub(" ", entities.unescape("".join(text))).strip():
                out.append((FURNITURE if skip or header and not heading else ARTICLE if article else 0, line))
            text.clear()

    def leave(k: int) -> None:
        nonlocal skip, article, header
        while len(stack) > k:
            kind = stack.pop()[1]
            skip -= kind == 1
            article -= kind == 2
            header -= kind == 3

    for m in _TOKEN.finditer(page or ""):
        name = m[3]
        if name is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                text.append(token)
            elif m[1]:
                text.append(" ")
            continue
        name = name.lower()
        if m[2]:
            if name in HEADINGS:
                flush()
                heading = 0
            elif name not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in INLINE:
                        flush()
                    leave(k)
                    break
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE:
            flush()
            if stack and stack[-1][0] in SHORT and (name in SHORT or stack[-1][0] == "p"):
                leave(len(stack) - 1)
            if name == "body":
                leave(0)
        if name in VOID:
            continue
        if name in HEADINGS:
            heading = 1
        kind = _kind(name, m[4], article > 0) if m[4] or name in DROPPED or name in ("article", "main") else 0
        if kind or not (name in INLINE or name in SHORT or name in HEADINGS):
            if not m[4].endswith("/") or not kind:
                if kind and name in INLINE:
                    flush()
                stack.append((name, kind))
                skip += kind == 1
                article += kind == 2
                header += kind == 3
    flush()
    return out


def _sweep(a: list[int], b: list[int]) -> Iterator[int]:
    """After each item of `b`, a bit for each of `a` that is 0 where the longest common
    subsequence of a[: i + 1] and the items so far is longer than that of a[:i]."""
    places: dict[int, list[int]] = {}
    for i, line in enumerate(a):
        places.setdefault(line, []).append(i)
    full = v = (1 << len(a)) - 1
    yield v
    for line in b:
        bits = bytearray(len(a) // 8 + 1)  # made anew: one for each distinct line would be a square
        for i in places.get(line, ()):
            bits[i >> 3] |= 1 << (i & 7)
        u = v & int.from_bytes(bits, "little")
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The longest common subsequence's length of a[:i] and b, for all i."""
    for v in _sweep(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(a: list[int], b: list[int]) -> list[int]:
    """Positions in `a` of a longest common subsequence."""
    if not a or not b:
        return []
    if len(a) * len(b) > ROW_BITS and len(b) > 1:
        mid = len(b) // 2
        cut = int((_lengths(a, b[:mid]) + _lengths(a[::-1], b[: mid - 1 : -1])[::-1]).argmax())
        return _align(a[:cut], b[:mid]) + [cut + i for i in _align(a[cut:], b[mid:])]
    rows = list(_sweep(a, b))
    shared, i, j = [], len(a), len(b)
    size = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            shared.append(i)
        elif size(i, j) == size(i - 1, j):
            i -= 1
        else:
            j -= 1
    return shared[::-1]


def common(a: list, b: list) -> list[bool]:
    """Which lines of `a` are in a longest common subsequence of both. What one of them does
    not have, and what both begin and end with, needs no table."""
    shared = [False] * len(a)
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        shared[low] = True
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        shared[-1 - high] = True
        high += 1
    in_a, in_b = set(a[low : len(a) - high]), set(b[low : len(b) - high])
    at = [i for i in range(low, len(a) - high) if a[i] in in_b]
    for i in _align([a[i] for i in at], [x for x in b[low : len(b) - high] if x in in_a]):
        shared[at[i]] = True
    return shared


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def difference(lines: list, kinds: list[int], path: str, near: list[tuple[int, str, list]]) -> tuple[int, list[int], list[int]]:
    """Of a page and its neighbours (steps away, path, lines): how many partners it has, the
    lines it shares with all of them, and those of them to delete beside the furniture."""
    partners = sorted(near, key=lambda x: (-_prefix(x[1], path), abs(x[0]), x[0]))[:PARTNERS]
    if not partners or not lines:
        return len(partners), [], []
    votes = [common(lines, x[2]) for x in partners]
    shared = [i for i, v in enumerate(zip(*votes)) if all(v)]
    cut = {i for i in shared if not kinds[i]}
    if all(k == FURNITURE or i in cut for i, k in enumerate(kinds)):
        cut = set()
    return len(partners), shared, sorted(cut)


def _outline(pages: DataFrame) -> DataFrame:
    """ka, kb (of the row), host, path, page_id, lines (hashes), kinds of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            found = [lines(h) for h in part.column(5).to_pylist()]
            hashes = [[xxhash.xxh3_64_intdigest(x) - (1 << 63) for _, x in page] for page in found]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:5], pa.array(hashes, pa.list_(pa.int64())), pa.array([[k for k, _ in page] for page in found], pa.list_(pa.int8()))],
                names=["ka", "kb", "host", "path", "page_id", "lines", "kinds"],
            )

    where = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(where, r"^([^/?#]*)", 1))
    path = F.regexp_extract(where, r"^[^/?#]*([^?#]*)", 1)
    key = _key()
    rows = pages.select(key["a"].alias("ka"), key["b"].alias("kb"), host.alias("host"), path.alias("path"), F.col("page_id").cast("bigint").alias("page_id"), "html")
    return rows.mapInArrow(run, "ka bigint, kb bigint, host string, path string, page_id bigint, lines array<bigint>, kinds array<tinyint>")


def _key() -> F.Column:
    return content_key(F.col("page_id"), F.col("url"), F.col("html"))


def _numbered(pages: DataFrame) -> DataFrame:
    """`pages` in the order of (host, path, page_id), with `at` counting from 0 without gaps:
    ranges are sorted each on its own, and a range begins where the ones before it end."""
    n = max(1, pages.count() // PARTITION_PAGES + 1)
    rows = pages.repartitionByRange(n, "host", "path", "page_id", "ca").sortWithinPartitions("host", "path", "page_id", "ca", "cb")
    rows = staged(rows.withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("id", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = staged(sizes.select("part", F.coalesce(before, F.lit(0)).alias("start")))
    rows = rows.withColumn("part", part).join(starts, "part")
    return rows.withColumn("at", F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start", "id")


def differenced(outline: DataFrame) -> DataFrame:
    """host, ca, cb (the lines' hashes), n_partners, shared, cut of each distinct page of the
    outline."""
    one = F.min(F.struct("path", "page_id")).alias("one")
    pages = outline.groupBy("host", "ca", "cb").agg(one, F.first("lines").alias("lines"), F.first("kinds").alias("kinds"))
    pages = staged(_numbered(pages.select("host", "one.path", "one.page_id", "ca", "cb", "lines", "kinds")))
    steps = [k for k in range(-REACH, REACH + 1) if k]
    seen = F.explode(F.array(*(F.struct((F.col("at") - k).alias("at"), F.lit(k).alias("step")) for k in steps)))
    near = pages.select(seen.alias("to"), "host", "path", "lines").select("to.at", "host", F.struct("to.step", "path", "lines").alias("x"))
    near = near.groupBy("at", "host").agg(F.collect_list("x").alias("near"))  # four at most
    rows = pages.join(near, ["at", "host"], "left").select("host", "ca", "cb", "path", "lines", "kinds", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                paths, texts, kinds, near = (part.column(i).to_pylist() for i in range(3, 7))
                done = [difference(x, k, p, [(y["step"], y["path"], y["lines"]) for y in n or ()]) for p, x, k, n in zip(paths, texts, kinds, near)]
                arrays = [pa.array([d[0] for d in done], pa.int32()), *(pa.array([d[i] for d in done], pa.list_(pa.int32())) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *arrays], names=["host", "ca", "cb", "n_partners", "shared", "cut"])

    return rows.mapInArrow(run, "host string, ca bigint, cb bigint, n_partners int, shared array<int>, cut array<int>")


def outline(pages: DataFrame) -> DataFrame:
    hashes = content_key(F.col("lines"), F.col("kinds"))
    return _outline(pages).withColumns({"ca": hashes["a"], "cb": hashes["b"]})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each of pages(page_id, url, html)."""
    seen = staged(outline(pages))
    cuts = staged(differenced(seen).where(F.size("cut") > 0).select("host", "ca", "cb", "cut"))
    rows = staged(seen.select("ka", "kb", "host", "ca", "cb").join(cuts, ["host", "ca", "cb"]).groupBy("ka", "kb").agg(F.first("cut").alias("cut")))
    key = _key()
    whole = pages.select("page_id", "url", "html", key["a"].alias("ka"), key["b"].alias("kb")).join(rows, ["ka", "kb"], "left").select("page_id", "url", "html", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            texts = []
            for h, cut in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                gone = set(cut or ())
                texts.append("\n".join(x for i, (k, x) in enumerate(lines(h)) if k != FURNITURE and i not in gone))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return whole.mapInArrow(run, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
