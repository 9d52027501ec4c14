import random

from netloom.llm import html_diff as H

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class="cookie-notice">We use</div>
<article><header><span>by me</span><h1>Head &amp; line</h1></header><p>One <b>two</b>
 three<br>four<p>five<!-- x --><aside>side</aside><form><p>Send</form><div class='comments'><p>first!</div></article><script>var a = "</p>";</script>
<footer>&copy; x</footer>"""


def kept(page):
    return [x for k, x in H.lines(page) if k != H.FURNITURE]


def test_article():
    assert kept(PAGE) == ["Head & line", "One two three four", "five"]
    assert all(k == H.ARTICLE for k, _ in H.lines(PAGE) if k != H.FURNITURE)
    assert H.lines(None) == [] and H.lines("") == []
    assert H.lines("plain &lt; text") == [(0, "plain < text")]


def test_classes_count_as_a_whole():
    page = "<div class='article-with-sidebar'>a</div><div class='side-by-side'>b</div><div class='has-menu'>c</div><div class='sidebar left'>x</div><div class='site-header'>y</div><div class='ad-slot-3'>z</div>"
    assert kept(page) == ["a", "b", "c"]


def brute(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_is_longest(monkeypatch):
    rng = random.Random(1)
    for bits in (H.ROW_BITS, 4):  # 4: every alignment is split
        monkeypatch.setattr(H, "ROW_BITS", bits)
        for _ in range(200):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "ab")
            shared = H.common(a, b)
            kept = [x for x, s in zip(a, shared) if s]
            assert len(kept) == brute(a, b)
            it = iter(b)
            assert all(x in it for x in kept)


def test_very_long_pages():
    import tracemalloc

    a, b = [f"line {i}" for i in range(60_000)], [f"line {i + i % 7}" for i in range(60_000)]
    tracemalloc.start()
    shared = H.common(a, b)
    assert tracemalloc.get_traced_memory()[1] < 100_000_000 and sum(shared) > 8000
    tracemalloc.stop()


def by_hand(rows):
    """The whole operator over a list: pairing, alignment, deletion, by brute force."""
    import re

    def lcs(a, b):
        t = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + (i,) if x == y else max(t[i][j + 1], t[i + 1][j], key=len)
        return set(t[-1][-1])

    pages = []
    for pid, url, page in rows:
        m = re.match(r"(?:[a-z]+://)?([^/?#]*)([^?#]*)", url or "")
        pages.append((m[1].lower(), m[2], pid, tuple(H.lines(page))))
    distinct = {}
    for host, path, pid, text in pages:
        distinct[host, text] = min(distinct.get((host, text), (path, pid)), (path, pid))
    order = sorted((host, path, pid, text) for (host, text), (path, pid) in distinct.items())
    at = {(h, t): i for i, (h, _, _, t) in enumerate(order)}
    out = {}
    for host, _, pid, text in pages:
        i = at[host, text]
        near = [(k, order[i + k][1], [x for _, x in order[i + k][3]]) for k in (-2, -1, 1, 2) if 0 <= i + k < len(order) and order[i + k][0] == host]
        prefix = lambda p: next((n for n, (x, y) in enumerate(zip(p, order[i][1])) if x != y), min(len(p), len(order[i][1])))
        partners = sorted(near, key=lambda x: (-prefix(x[1]), abs(x[0]), x[0]))[:2]
        words = [x for _, x in text]
        cut = set.intersection(*(lcs(words, x[2]) for x in partners)) if partners else set()
        cut = {j for j in cut if text[j][0] == 0}
        left = [x for j, (k, x) in enumerate(text) if k != 1 and j not in cut] or [x for k, x in text if k != 1]
        out[pid] = "\n".join(left)
    return out


def test_differencing_by_hand(spark, monkeypatch):
    """Against brute force, on few and on many ranges: hosts of one to many pages, near and
    exact copies, marked articles, nulls, repeated rows, a column of another's name."""
    rng = random.Random(3)
    rows, word = [], lambda: "".join(rng.choices("abcdefgh", k=6))
    for i in range(70):
        host = rng.choice(["one.example", "two.example", "three.example", f"h{i}.example"])
        story = [f"<p>{word()} {word()} {i}.</p>" for _ in range(rng.randint(0, 4))] if i % 6 else ["<p>the same story</p><p>told twice</p>"]
        body = "".join(story)
        if i % 5 == 0:
            body = f"<article>{body}<p>in all articles</p></article>"
        section = i % 3
        page = f"<div>Menu of {host}</div><nav>{word()}</nav><div>Section {section}</div>{body}<div>Imprint</div><footer>{i}</footer>"
        rows.append((i, f"https://{host}/s{section}/{rng.choice('xyz')}/{i}?q={i}", page))
    rows += [(100, None, None), (101, "", ""), (102, "http://One.example/s1/x/3", rows[3][2]), rows[7]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int").repartition(5).cache()
    want = by_hand(rows)
    for size in (H.PARTITION_PAGES, 7):
        monkeypatch.setattr(H, "PARTITION_PAGES", size)
        got = H.main_text(df).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert any("Menu" not in t for t in want.values()) and all("in all articles" in want[i] for i in range(0, 70, 5))
    table = H.differenced(H.outline(df))
    assert table.where("n_partners > 0 AND size(shared) > 0").count() > 20 and table.where("size(cut) > 0").count() > 20
    assert H.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_near_copies_keep_their_story():
    """A copy next door shares the story, the page after it the template alone."""
    a = ["menu", "a long story", "of two lines", "12:03", "imprint"]
    b = ["menu", "a long story", "of two lines", "12:04", "imprint"]
    c = ["menu", "another story", "imprint"]
    assert H.difference(a, [0] * 5, "/1", [(1, "/2", b), (2, "/3", c)]) == (2, [0, 4], [0, 4])
    assert H.difference(a, [0] * 5, "/1", [(1, "/3", c)]) == (1, [0, 4], [0, 4])
    assert H.difference(["x"], [0], "/1", [(1, "/2", ["x", "y"])]) == (1, [0], [])  # nothing would be left
    assert H.difference(["menu", "x"], [1, 2], "/1", [(1, "/2", ["menu", "x", "y"])]) == (1, [0, 1], [])


def test_driver_pages(spark):
    """On the given pages every page of a host with several is aligned, and the text stays
    what the marked articles hold."""
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    table = H.differenced(H.outline(pages)).groupBy().agg({"n_partners": "sum", "*": "count"}).first()
    assert table["sum(n_partners)"] > 0
    known = {" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()}
    got = H.main_text(pages).collect()
    assert sum(" ".join(r.text.split("\n", 1)[-1].split()) in known for r in got) > 0.95 * len(got)
