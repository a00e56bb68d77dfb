"""Main text of HTML pages from streaming parser events.

The standard library's parser hands over tags and text one by one. Block tags
cut the page into lines; of each line the text, its number of tags and the
container are kept. The text-to-tag ratio of each line is
smoothed with a Gaussian over its neighbours, and lines above a threshold (the
standard deviation of the smoothed ratios) form the clusters of content. The
clusters choose the region: all outermost article and main elements and the
containers of the clusters beside them, or, on a page without, the smallest
container that holds all clusters. A ratio cannot
tell a short paragraph of the article from an advert beside it, so within the
region lines count by structure: all of them, but those in page furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments). A form
around half of the text or more is none. Time is linear in the page, however
deep its elements nest.

Cases: a null or empty page, or one without content, has an empty text; pages
that end in the middle of a tag or reference, tags that are never closed or
never opened, and pages without an article are read as far as they go;
repeated rows and null ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protea.llm.common import ship

SIGMA, RADIUS = 1.0, 2

# fixed word lists
BLOCKS = set("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre
section select summary table tbody td template textarea tfoot th thead title tr ul""".split())
FURNITURE = set("""aside button dialog fieldset footer form head iframe menu nav noscript object script select style svg
template textarea title""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_NAMES = set("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie
cookies copyright disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager
pagination popup promo promoted related replies respond search share sharing sidebar signup skip social sponsor
sponsored subscribe tags toolbar widget widgets""".split())
ALWAYS_FURNITURE = set("ad ads advert advertisement comment comments disqus replies".split())
NOT_FURNITURE = set("with without has no".split())  # "with-sidebar" is not a sidebar
STATE = re.compile(r"[^a-z0-9](open|closed)$")  # "comments-open" says something of the page
CONTENT_NAMES = set("article body content entry main post story text".split())
# words that beside a furniture name say where or what shape it is, and no more
SHAPES = set("""area bar block bottom box btn button buttons col column container desktop float fixed form group icon icons
inline inner item items large left link links list mobile nav outer overlay page panel posts primary right row secondary
section site slot small sticky strip title top unit wrap wrapper""".split())
FURNITURE_ROLES = set("alert banner complementary contentinfo dialog form navigation search".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = set("article body center div html main section table td tbody tr".split())


def is_furniture(tag: str, attrs: list, inside_article: bool, nested: bool = False) -> bool:
    """``nested``: within an article element, where an article may be a comment."""
    if tag in FURNITURE:
        return True
    a = dict(attrs)
    if tag == "header":
        return not inside_article
    if (a.get("role") or "").lower() in FURNITURE_ROLES or "hidden" in a:
        return True
    if re.search(r"display\s*:\s*none", a.get("style") or "", re.I):
        return True
    if tag in ("html", "body", "main"):
        return False
    always = furniture = False
    for name in _names(a.get("class")):
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if not parts or NOT_FURNITURE.intersection(parts) or STATE.search(name):
            continue
        # "social-history" and "related-work" are no furniture, "social-links"
        # and "post-comments" are; "article-header" belongs to its article
        plain = all(x in FURNITURE_NAMES or x in SHAPES or x in CONTENT_NAMES or x.isdigit() for x in parts)
        named = set(parts) & FURNITURE_NAMES
        always = always or bool(named & ALWAYS_FURNITURE and plain)
        if nested:
            furniture = furniture or name in FURNITURE_NAMES
        elif named and plain:
            furniture = furniture or not (named == {"header"} and CONTENT_NAMES.intersection(parts))
    if tag in CONTAINERS:
        for name in _names(a.get("id")):
            always = always or name in ALWAYS_FURNITURE
            furniture = furniture or (name in FURNITURE_NAMES and not nested)
    if tag == "article":
        return always and nested
    return always or furniture


def _names(value: str | None) -> list[str]:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value or "").lower().split()


class Line:
    """``at``: the number of the innermost open container, -1 for none;
    ``form``: that of the outermost form, where nothing else is furniture."""
    __slots__ = ("text", "tags", "furniture", "at", "form")

    def __init__(self, text, tags, furniture, at, form):
        self.text, self.tags, self.furniture, self.at, self.form = text, tags, furniture, at, form


class Open:
    """An open element."""
    __slots__ = ("tag", "furniture", "at", "article", "nested", "form")

    def __init__(self, tag, furniture, at, article, nested, form):
        self.tag, self.furniture, self.at, self.article, self.nested, self.form = tag, furniture, at, article, nested, form


class PageLines(HTMLParser):
    """Lines of a page. Containers are numbered as they open, so that those
    within container c are c to last[c]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = [Open("", False, -1, -1, False, -1)]
        self.blocks: list[int] = []              # positions of the open block elements
        self.where: dict[str, list[int]] = {}    # positions of the open elements of a tag
        self.parent: list[int] = []
        self.last: list[int] = []
        self.article: list[int] = []             # the outermost article or main around each container, or -1
        self.forms = 0
        self.parts: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            e = self.open[-1]
            self.lines.append(Line(text, self.tags, e.furniture, e.at, e.form))
            self.tags = 0
        self.parts = []

    def pop(self, n: int) -> None:
        """Close the elements from position n."""
        while len(self.open) > n:
            e = self.open.pop()
            self.where[e.tag].pop()
            if e.tag in BLOCKS:
                self.blocks.pop()
            if e.at != self.open[-1].at:
                self.last[e.at] = len(self.last) - 1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if self.blocks and (tag in SELF_CLOSING or tag in BLOCKS):
            nearest = self.open[self.blocks[-1]].tag
            if nearest in SELF_CLOSING.get(tag, ()) or (nearest == "p" and tag in BLOCKS):
                self.pop(self.blocks[-1])
        up = self.open[-1]
        form, furniture = up.form, up.furniture
        if not furniture:
            if tag == "form":
                if form < 0:
                    form, self.forms = self.forms, self.forms + 1
            else:
                furniture = is_furniture(tag, attrs, up.article >= 0, up.nested)
        at, article = up.at, up.article
        if tag in CONTAINERS:
            at = len(self.parent)
            self.parent.append(up.at)
            self.last.append(-1)
            if article < 0 and tag in ("article", "main") and not furniture:
                article = at
            self.article.append(article)
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append(Open(tag, furniture, at, article, up.nested or tag == "article", form))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
        if self.where.get(tag):
            at = self.where[tag][-1]
            # an inline end tag closes nothing outside its block
            if tag in BLOCKS or not self.blocks or at > self.blocks[-1]:
                self.pop(at)

    def handle_data(self, data):
        if self.open[-1].tag in ("script", "style"):
            return
        self.parts.append(data)

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def done(self) -> None:
        """Forms with half of the text or more are none; in others all is furniture."""
        self.cut()
        self.pop(1)
        held = [0] * self.forms
        total = 0
        for x in self.lines:
            if not x.furniture:
                total += len(x.text)
                if x.form >= 0:
                    held[x.form] += len(x.text)
        for x in self.lines:
            x.furniture = x.furniture or (x.form >= 0 and 2 * held[x.form] < total)


def read_lines(html: str) -> PageLines:
    cut = html.rfind("<")
    if cut > html.rfind(">") and (html[cut + 1:cut + 2].isalpha() or html[cut + 1:cut + 2] in ("/", "!")):
        html = html[:cut]  # the page ends within a tag
    page = PageLines()
    page.feed(html)
    page.close()
    page.done()
    return page


def smoothed(ratios: list[float]) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for d, k in zip(range(-RADIUS, RADIUS + 1), kernel):
            if 0 <= i + d < len(ratios):
                total += k * ratios[i + d]
                weight += k
        out.append(total / weight)
    return out


def clusters(lines: list[Line]) -> list[int]:
    """Numbers of the lines above the threshold."""
    if not lines:
        return []
    s = smoothed([0.0 if x.furniture else len(x.text) / max(1, x.tags) for x in lines])
    mean = sum(s) / len(s)
    threshold = math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))
    return [i for i, x in enumerate(s) if x >= threshold and not lines[i].furniture]


def region(page: PageLines, chosen: list[int]) -> list[int] | None:
    """The containers of the content; None: the whole page."""
    places = [page.lines[i].at for i in chosen]
    article = [page.article[x.at] if x.at >= 0 else -1 for x in page.lines]
    articles = {a for a, x in zip(article, page.lines) if a >= 0 and not x.furniture}
    if articles:
        beside = {page.lines[i].at for i in chosen if article[i] < 0}
        return None if -1 in beside else [*articles, *beside]
    # the smallest container that holds all clusters
    c, end = min(places), max(places)
    while c >= 0 and page.last[c] < end:
        c = page.parent[c]
    return [c] if c >= 0 else None


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = read_lines(html)
    chosen = clusters(page.lines)
    if not chosen:
        chosen = [i for i, x in enumerate(page.lines) if not x.furniture]
    if not chosen:
        return ""
    where = region(page, chosen)
    inside = [where is None] * (len(page.last) + 1)  # by container; the last one is no container
    if where is not None:
        edge = [0] * (len(page.last) + 1)
        for c in where:
            edge[c] += 1
            edge[page.last[c] + 1] -= 1
        depth = 0
        for c in range(len(page.last)):
            depth += edge[c]
            inside[c] = depth > 0
    return "\n".join(x.text for x in page.lines if not x.furniture and inside[x.at])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    ship(pages.sparkSession)

    @F.pandas_udf(T.StringType())
    def texts(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in htmls:
            yield pd.Series([main_text(h) for h in batch], dtype=object)
    out = pages.select("page_id", "url", texts(pages["html"].cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
