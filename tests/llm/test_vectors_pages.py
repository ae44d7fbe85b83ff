"""Hard negatives and vector codes against brute force; main texts against another parser and by hand."""

import hashlib
import math
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import codes, extract, negatives

VECTORS = "vec_id long, embedding array<float>, label int, code string, row int, stored string"


def vectors(n=400, width=16, seed=3):
    """Ties, repeated rows, nulls and numbers that are none; names that the operators use."""
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice((-1.0, -0.5, 0.25, 0.75, rnd.random())) for _ in range(width)], rnd.choice((0, 0, 0, 1, 2))) for i in range(n)]
    rows += [(rnd.randrange(n), list(rows[k][1]), rows[k][2]) for k in range(20)]
    rows += [rows[100], rows[100], rows[7], (None, rows[1][1], 1), (n + 1, rows[2][1], None), (n + 2, None, 1), (n + 3, [], 1)]
    rows += [(n + 4, [0.5] * 3, 1), (n + 5, [float("nan")] * width, 0), (n + 6, [math.inf] + [0.0] * (width - 1), 0), (n + 7, [None] + [0.0] * (width - 1), 2)]
    return [(*r, "x", 1, None) for r in rows]


def usable(rows, width):
    return [r for r in rows if r[1] and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]


def scaled(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def mined(rows, width):
    rows = [(r[0], scaled(r[1], 256), r[2]) for r in usable(rows, width) if r[0] is not None and r[2] is not None]
    found = []
    for a, (anchor, q, label) in enumerate(rows):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other, k) for k, (i, v, other) in enumerate(rows) if k != a)
        for s, positive, _, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            found += [(anchor, positive, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return found


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, small):
    if small:  # several groups, blocks of anchors, other pivots
        monkeypatch.setattr(negatives, "GROUP_VALUES", 800)
        monkeypatch.setattr(negatives, "ANCHORS_PER_BLOCK", 2)
        monkeypatch.setattr(negatives, "PIVOT_SAMPLE", 3)
    rows = vectors()
    got = negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows, 16)) != []


def test_hard_negatives_of_few_rows(spark):
    for rows in ([], [(100, [1.0, 1.0], 1, None, None, None)], [(100, [1.0, 0.0], 1, None, None, None), (200, [0.0, 0.0], 1, None, None, None)]):
        assert negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0).count() == 0


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(10, 1, 24)) + 0.1 * rng.normal(size=(10, 80, 24)))).astype(np.int64).reshape(800, 24)
    longest = int((x * x).sum(1).max())
    pivots = negatives.pivots_of(x, longest)
    stored = negatives.to_pivots(x, np.sqrt(longest - (x * x).sum(1)), pivots)
    low, high = negatives.brackets(x[5], stored, pivots, longest)
    score = x @ x[5]
    assert (low <= score).all() and (score <= high).all()
    assert (high < np.sort(score)[-5]).mean() > 0.5  # most rows of other clusters can't be among the first five


def coded(rows, width):
    rows = sorted((r for r in usable(rows, width)), key=lambda r: (r[0] is None, r[0], r[1]))
    ints, wide = [scaled(r[1], 4096) for r in rows], width // 8
    part = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[part(v, p) for v in ints[:16]] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, p: min(range(len(books[p])), key=lambda k: gap(part(v, p), books[p][k]))
    for _ in range(6):
        chosen = [[pick(v, p) for p in range(8)] for v in ints]
        for p in range(8):
            for k in range(len(books[p])):
                own = [part(v, p) for v, c in zip(ints, chosen, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    errors, labels = [], {}
    for r, v in zip(rows, ints, strict=True):
        c = [pick(v, p) for p in range(8)]
        errors.append((r[0], "".join(f"{k:02x}" for k in c), sum(gap(part(v, p), books[p][c[p]]) for p in range(8)), r[2]))
        labels[r[2]] = labels.get(r[2], 0) + errors[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, labels[label], sha) for i, code, error, label in errors]


@pytest.mark.parametrize(("blocks", "labels"), [(1 << 20, 100_000), (64, 0)])
def test_vector_codes_equal_brute_force(spark, monkeypatch, blocks, labels):
    monkeypatch.setattr(codes, "BLOCK_VALUES", blocks)
    monkeypatch.setattr(codes, "MANY_LABELS", labels)
    rows = vectors(150)
    order = lambda r: (r[0] is None, r)
    got = codes.digest(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(coded(rows, 16), key=order)


def test_vector_codes_of_few_rows(spark):
    assert codes.digest(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(i, [float(i)] * 8, None, None, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, VECTORS)
    books = codes.fit(df)
    assert books.shape == (8, 3, 1)
    back = codes.decode(codes.encode(df, books), books)
    assert sorted(map(tuple, back.select("vec_id", "code", "error", "decoded", "row").collect())) == [
        (i, f"0{i}" * 8, 0, [4096 * i] * 8, None) for i in range(3)
    ]


class Article(HTMLParser):
    """Blocks of the article of pages as the tables hold them."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.on, self.found, self.now = False, [], ""
        self.feed(page or "")
        self.close()
        self.cut()

    def cut(self):
        text = " ".join(self.now.split())
        self.found += [text] if text else []
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.cut()
        self.now += " " * (tag == "br")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        self.on &= tag != "article"

    def handle_data(self, data):
        self.now += data * self.on


def test_main_texts_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    for page in pages.collect():
        text = "\n".join(Article(page.html).found)
        assert tuple(got[page.page_id]) == (page.page_id, page.url, text, len(text))


def test_pages_that_are_null_empty_repeated_or_long(spark):
    long = "<p>" + "the word of a very long page. " * 40_000
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (None, "<p>Hello", "y"), (5, long, "z")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, html string, TEXT string")).collect()
    assert [r.page_id for r in got if r.n_chars == 0] == [1, 2, 2]
    assert {r.text for r in got if r.page_id is None} == {"Hello"} and [r.n_chars for r in got if r.page_id == 5] == [30 * 40_000 - 1]
    assert extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


PROSE = "The harbour was built on a bank of the river, and it has been in use for a hundred years by the people of the town who had no other way to the sea. "
PAGE = f"""<!doctype html><html><head><title>T & t</title><style>p {{ x: "</p>" }}</style></head><body class="has-sidebar">
<div id="cookie-notice">{PROSE}<button>OK</button></div><header><h1>Site</h1></header><div class=mainMenu><ul><li><a href=1>One<li><a href=2>Two</ul></div>
<div class="wrap page"><article class="post"><header class="entry-header"><h1>A title &amp; more</h1></header><!-- <p>no</p> -->
<p>{PROSE}<b>Bold</b>ly&nbsp;said<br>here. <span class="ad">Buy</span><p>Short.<div class="advert-box"><p>{PROSE}</div>
<ul><li>an item of text<li><a href=3>Read this too</a></ul><form><p>Your name<input></form><h2 id="search">Next</h2><blockquote>{PROSE}</blockquote><p>End &lt;1&gt; 2 < 3 &#233;&am
<section class="comments"><article class="comment"><p>{PROSE}</article></section></article><aside>{PROSE}</aside></div><script>"<p>x</p>"</script><footer>&copy; us</footer>"""


def test_parts_of_a_page():
    said = PROSE.strip()
    assert extract.main_text(PAGE).split("\n") == [
        "A title & more", f"{said} Boldly said here.", "Short.", "an item of text", "Next", said, "End <1> 2 < 3 é&am",
    ]


def test_pages_without_a_marked_article():
    menu = "".join(f"<li><a href={k}>Item {k}</a></li>" for k in range(5))
    page = f"<body><ul>{menu}</ul><p>Welcome</p><h1>Title</h1><p>{PROSE * 2}</p><p>Yes.</p><p>{PROSE * 2}</p><ul>{menu}</ul><p>Imprint</p></body>"
    assert extract.main_text(page).split("\n") == ["Title", (PROSE * 2).strip(), "Yes.", (PROSE * 2).strip()]
    assert extract.main_text("<p>Only this.") == "Only this."
    assert extract.main_text("<div class='has-comments'><p>Kept</p></div><div class='comments'><p>Gone</p></div>") == "Kept"
    strange = "слово " * 60
    assert extract.main_text(f"<ul>{menu}</ul><p>{strange}</p>") == strange.strip()
    assert extract.main_text(f"<div class='sidebar-wrap'><main><p>{PROSE}</main></div>") == PROSE.strip()


def test_first_pass_leaves_short_blocks_open():
    blocks = extract.blocks_of(f"<p>{PROSE * 2}<p>short<nav>short</nav>")
    assert extract.first_pass(blocks) == [True, None, False]
    assert extract.second_pass(blocks, [True, None, False]) == [True, False, False]  # as near to either, and short


@pytest.mark.parametrize("piece", ["<p>", "<b><div>", "</b>", "<a '\">", "<a \">", "<div", "<!--", "<script>", "&amp", "<", "<td></p>", "<i></b><p></i>"])
def test_broken_pages_take_linear_time(piece):
    start = time.perf_counter()
    extract.main_text("<b>" + piece * (300_000 // len(piece)) + " x </b>" * 20_000)
    assert time.perf_counter() - start < 12
