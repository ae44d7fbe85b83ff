"""Main text of HTML pages by two passes of block rules.

A tolerant scan cuts a page into blocks and says of each in what zone it stands: in marked page
furniture (by element, role or class), in a marked article, or in neither.  The first pass decides
blocks by zone, length, stop-word density and link density as far as these suffice.  In the second,
blocks left open (short or in between) inherit the label of the nearest decided neighbour.

Inside a marked article a block counts as bad only for its links or its marks, and the article's
ends count as good neighbours, so short paragraphs and headings of an article stay.  Without stop
words of a known language on the page, density decides nothing.  A null or empty page has an empty text;
equal pages have equal texts; the work is linear in the length of a page, however it is broken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, named

SHORT, LONG = 70, 200  # characters of a block
LITTLE, MUCH = 0.10, 0.30  # share of stop words among a block's words
LINKED = 0.5  # share of a block's characters in links from which on it is a menu
KNOWN = 0.05  # share of stop words on a page of a known language

#: Frequent function words of some languages.
STOP_WORDS = frozenset("""
the of and to in a is that it for as was with be by on not he his but at are this have from or had an they which were all we
der die und das ist den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
le la les et de du des un une que est dans qui par pour pas sur au avec ce il se plus son ne sont
el los las y que en por con para del una se no su al lo como más o pero sus
il di che non è per della sono con si da come dei nel alla
o e do da em um para com não uma os no na mais
het een van en dat niet zijn op te voor met
""".split())

#: Elements of HTML.
RAW = ("script", "style", "noscript", "template", "iframe", "title", "textarea", "xmp", "noembed", "noframes")
FURNITURE = frozenset("nav header footer aside form dialog menu head svg button select label legend audio video canvas object datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
head header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul hr
""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element whose start ends an open one of these, if that is the innermost block.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
#: Words in class names and ids that mark page furniture; of the second kind any word beginning so.
MARKS = frozenset("""
ad ads adbox adsense promo promoted promotion banner nav navbar menu pager pagination aside widget related recommended share sharing social
follow newsletter subscribe subscription signup login search consent gdpr notice notices alert popup modal overlay header footer masthead toolbar
topbar submenu skip reply replies respond disclaimer
""".split())
STEMS = ("advert", "sponsor", "cookie", "sidebar", "navig", "breadcrumb", "comment", "disqus")
ARTICLE_MARKS = frozenset(("content", "article", "story", "maincontent", "articlebody", "articlecontent", "postcontent", "postbody", "entrycontent"))

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(?:^|(?<=[\s/\"']))(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    zone: str  # "bad", "article" or "plain"
    region: int  # the article it stands in
    kind: str  # "heading", "item" or "text"
    linked: int  # characters in links
    links: int


def _marks(tag: str, attributes: str) -> str:
    """What an element says of its content: "bad" (by its nature), "weak" (bad by a name), "article", or ""."""
    found = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    role = found.get("role", "").strip().lower()
    style = re.sub(r"\s", "", found.get("style", "").lower())
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or role in ROLES:
        return "bad"
    names = found.get("class", "").split() + ([] if tag in HEADINGS else found.get("id", "").split())
    for name in names if tag not in ("html", "body", "main") else ():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        if {"has", "with", "no", "without"}.isdisjoint(words) and any(w in MARKS or w.startswith(STEMS) for w in words):
            return "weak"
    if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return "article"
    return "article" if any(re.sub(r"[^a-z]", "", n.lower()) in ARTICLE_MARKS for n in names) else ""


class _Page:
    """Open elements and the text since the last block boundary."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.weak: list[bool] = []  # of each block: in an article that stands in a part bad by name only
        self.open: list[tuple[str, str]] = []  # (tag, mark)
        self.inner: list[int] = []  # of open blocks, their places in open
        self.places: dict[str, list[int]] = {}  # of open elements by tag
        self.marked = {"bad": 0, "weak": 0, "article": 0}
        self.text: list[str] = []
        self.linked = self.links = self.regions = 0

    def zone(self) -> str:
        if self.marked["bad"] or self.marked["weak"]:
            return "bad"
        return "article" if self.marked["article"] else "plain"

    def say(self, text: str) -> None:
        inline_bad = self.open and self.open[-1][0] not in BLOCK and self.open[-1][1] in ("bad", "weak")
        if text and not inline_bad:
            text = html.unescape(text)
            self.text.append(text)
            if self.places.get("a"):
                self.linked += len("".join(text.split()))

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            tags = [self.open[k][0] for k in self.inner[-3:]]
            kind = "heading" if HEADINGS.intersection(tags) else "item" if {"li", "td", "dd"}.intersection(tags) else "text"
            self.blocks.append(Block(text, self.zone(), self.regions, kind, self.linked, self.links))
            self.weak.append(bool(self.marked["article"] and self.marked["weak"] and not self.marked["bad"]))
        self.text, self.linked, self.links = [], 0, 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            innermost = self.open[self.inner[-1]][0] if self.inner else ""
            if innermost == "p" or innermost in ENDS.get(tag, ()) or (innermost == "head" and tag != "head"):
                self.close_to(self.inner[-1])
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        mark = _marks(tag, attributes)
        if not mark and tag in FURNITURE and not (tag == "header" and self.marked["article"]):
            mark = "bad"
        if tag == "header" and mark == "weak" and self.marked["article"]:
            mark = ""  # an article's own head
        if tag in BLOCK:
            self.inner.append(len(self.open))
        if mark in ("bad", "weak") and tag not in BLOCK:
            mark = "bad"  # its text isn't said
        if mark == "article" and not self.marked["article"]:
            self.regions += 1
        if mark and tag in BLOCK:
            self.marked[mark] += 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, mark))
        self.links += tag == "a"

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if self.places.get(tag):
            k = self.places[tag][-1]
            # an inline end doesn't reach out of the block it stands in, but for a link's
            if tag in BLOCK or not self.inner or k > self.inner[-1]:
                self.close_to(k)
            elif tag == "a":
                self.open[k] = ("", "")
                self.places["a"].pop()

    def close_to(self, k: int) -> None:
        for tag, mark in self.open[k:]:
            if tag:
                self.places[tag].pop()
            if mark and tag in BLOCK:
                self.marked[mark] -= 1
        del self.open[k:]
        while self.inner and self.inner[-1] >= k:
            self.inner.pop()


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, without script, style, comments and markup."""
    at, n, found, quoted = 0, len(page), _Page(), True
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            cut = n
        found.say(page[at:cut])
        if cut == n:
            break
        at = cut
        head = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = n if end < 0 else end + 3
        elif head in ("!", "?") or (head == "/" and not page[at + 2 : at + 3].isalpha()):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
        elif not (head == "/" or (head.isascii() and head.isalpha())):
            found.say("<")
            at += 1
        else:
            tag = _TAG.match(page, at) if quoted else None
            if tag:
                closing, name, attributes = tag.group(1), tag.group(2).lower(), tag.group(3)
                at = tag.end()
            else:  # a quote is never closed: from here on tags end at the next bracket
                quoted = False
                end = page.find(">", at)
                if end < 0:
                    break
                closing, name, attributes = head == "/", re.split(r"[\s/]", page[at + 1 : end].lstrip("/"), maxsplit=1)[0].lower(), ""
                at = end + 1
            if closing:
                found.end(name)
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = n if close < 0 else close + 1
            else:
                found.start(name, attributes)
    found.flush()
    if not any(b.zone == "article" for b in found.blocks):  # the name of a part around the only article doesn't count
        return [b._replace(zone="article") if weak else b for b, weak in zip(found.blocks, found.weak, strict=True)]
    return found.blocks


def first_pass(blocks: list[Block]) -> list[bool | None]:
    """Good, bad, or open."""
    words = [_WORD.findall(b.text.lower()) for b in blocks]
    stops = [sum(w in STOP_WORDS for w in ws) for ws in words]
    own = [i for i, b in enumerate(blocks) if b.zone != "bad"]
    known = sum(stops[i] for i in own) >= KNOWN * sum(len(words[i]) for i in own)
    marked = any(b.zone == "article" for b in blocks)
    labels: list[bool | None] = []
    for b, ws, stop in zip(blocks, words, stops, strict=True):
        density = stop / max(1, len(ws))
        menu = b.linked > LINKED * len("".join(b.text.split()))
        if b.zone == "bad":
            labels.append(False)
        elif b.zone == "article":
            if menu and b.kind != "heading" and (b.kind == "item" or b.links > 1):
                labels.append(False)
            else:
                labels.append(True if len(b.text) >= SHORT and (density >= LITTLE or not known) else None)
        elif menu or "©" in b.text or (marked and b.kind != "heading"):
            labels.append(False)
        elif len(b.text) < SHORT:
            labels.append(None)
        elif not known or density >= MUCH:
            labels.append(True if len(b.text) >= LONG or not known else None)
        else:
            labels.append(None if density >= LITTLE else False)
    return labels


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks inherit from the nearest decided neighbour, in an article from within it (its ends are good).

    Of two as near ones a heading takes the later; else the good one wins in an article and for blocks
    that aren't short, the bad one otherwise.  Where no block of the page is good, the open ones are.
    """
    n = len(blocks)
    if True not in labels:
        return [label is None for label in labels]
    same = lambda i, j: 0 <= j < n and (blocks[i].zone, blocks[i].region) == (blocks[j].zone, blocks[j].region)

    def side(step: int) -> list[tuple[int, bool] | None]:
        """For each block the distance and label of the next decided one in a direction."""
        seen: list[tuple[int, bool] | None] = [None] * n
        last: tuple[int, bool] | None = None
        for i in range(n)[::step]:
            if blocks[i].zone == "article" and not same(i, i - step):
                last = (i - step, True)
            seen[i] = last and (abs(i - last[0]), last[1])
            if labels[i] is not None:
                last = (i, labels[i])
        return seen

    out = []
    for b, label, before, after in zip(blocks, labels, side(1), side(-1), strict=True):
        if label is None:
            if before is None or after is None:
                label = (before or after)[1]
            elif before[0] != after[0]:
                label = min(before, after)[1]
            elif b.kind == "heading":
                label = after[1]
            elif b.zone == "article" or len(b.text) >= SHORT:
                label = before[1] or after[1]
            else:
                label = before[1] and after[1]
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, good in zip(blocks, second_pass(blocks, first_pass(blocks)), strict=True) if good)


def extract(pages: DataFrame, body: str = "html") -> DataFrame:
    """Columns of ``pages`` but ``body``, with ``text`` and ``n_chars`` (its code points), which replace columns of that name."""
    keep = kept_columns(pages, ["text", "n_chars"])
    keep = [c for c in keep if c.lower() != body.lower()]
    rows = pages.select(*named(keep), F.col(body).cast("string").alias(body))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), sizes], names=schema.names)

    return rows.mapInArrow(run, schema)
