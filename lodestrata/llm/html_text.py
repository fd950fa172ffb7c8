"""HTML extraction: flat text blocks, described by the word count and link density of themselves and their neighbours, classified by a decision tree that a small labelled table has trained.

A page is read once, by HTML's rules for tags, quotes, comments and optional tags, and cut
into text blocks at every tag that isn't an inline one. The tree is grown (Gini, to DEPTH)
from the table LABELLED below, when it is first used. Its features are the words and link
densities of a block and of the blocks before and after it, and, besides, what the
containers say: whether the block stands in an article, beside one, or in a container
whose tag, role or name is one of menus, notices and the like (its cue).

Names are weaker than tags: those of html, body and the page's first article don't count,
a named container (or form) around that article has no cue, nor has one that holds all
text of the page that no tag excludes, if that is long (WRAPPER_WORDS).

Text: character references are decoded, white space inside a block becomes one space,
blocks are trimmed, empty ones dropped, and the kept ones joined in page order by a space.

Defined cases: null or empty html, and html without a kept block, give an empty text;
an unclosed comment, script, quote or tag runs to the end of the page, as browsers have
it; time and memory grow with the page's length however deep it is nested; repeated rows
give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, read

#: Tags that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content isn't text for readers.
SKIPPED = frozenset("script style noscript template textarea select button iframe svg math object canvas title noembed noframes xmp".split())
#: Of these, those in which only the end tag counts, and those that a slash at the end of the tag closes.
RAW, FOREIGN = frozenset("script style textarea title iframe noembed noframes noscript xmp".split()), frozenset("svg math".split())
#: Elements that are kept track of.
CONTAINERS = frozenset("html article aside blockquote body details dialog dd div dl dt fieldset figure footer form header li main menu nav ol p section table tbody td tfoot th thead tr ul h1 h2 h3 h4 h5 h6 pre center address".split())
#: Elements whose start ends an open paragraph that is the innermost element.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements whose start ends an open one of these, with nothing but the last between.
ENDS_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
LOOSE = frozenset(("p", "div", "address"))
#: Elements whose start ends an open one of these within the same table.
ENDS_CELL = {"tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that an end tag within one of these can't end.
BOUNDS = {"li": ("ul", "ol", "menu"), **dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",))}
#: Cues: 2 of tags and roles, of names 2, or 1 where long text speaks against the name.
CUE_TAGS = frozenset("nav aside footer menu dialog".split())
CUE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert".split())
CUE_NAMES = frozenset("ad ads advert adverts advertisement advertisements adsense banner banners breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies disclaimer disqus footer footers gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup popups promo promos promoted sidebar sidebars signup sponsor sponsored sponsors subscribe toolbar topbar".split())
WEAK_NAMES = frozenset("related replies respond search share sharing skip social widget widgets".split())
#: First parts of names that speak of something else on the page.
OF_OTHERS = frozenset("has hide is no not show with without".split())
WRAPPER_WORDS = 100
SPACE = " \t\n\f\r"
_ATTRIBUTE = rf"""[^{SPACE}/>][^{SPACE}/>=]*+(?:[{SPACE}]*+=[{SPACE}]*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^{SPACE}"'>][^{SPACE}>]*+)?+)?+"""
TAG = re.compile(rf"<(/?)([a-zA-Z][^{SPACE}/>]*+)((?:[{SPACE}/]++|{_ATTRIBUTE})*+)(>|\Z)")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(rf"""([^{SPACE}/>][^{SPACE}/>=]*+)(?:[{SPACE}]*+=[{SPACE}]*+(?:"([^"]*+)"?|'([^']*+)'?|([^{SPACE}"'>][^{SPACE}>]*+))?+)?+""")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    cue: int
    inside: bool


def attributes(s: str) -> dict[str, str]:
    """The first value of each of class, id, role and href."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(s):
        name = m[1].lower()
        if name in ("class", "id", "role", "href"):
            out.setdefault(name, html_lib.unescape(m[2] or m[3] or m[4] or ""))
    return out


def name_cue(names: str) -> int:
    """Of the names in class and id."""
    out = 0
    for name in names.split():
        parts = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-").split("-")
        if parts[0] not in OF_OTHERS:
            out = max(out, 2 if not CUE_NAMES.isdisjoint(parts) else 1 if not WEAK_NAMES.isdisjoint(parts) else 0)
    return out


class _Containers:
    """The open elements, and what they say of the text in them. A named container is kept by number, since what its name is worth shows only at the end of the page."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, bool, int]] = []  # tag, cue of tags, in an article, named container
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # where the open ones of a tag stand
        self.firm: list[int] = []  # where those stand that aren't LOOSE
        self.level: list[int] = []  # by named container
        self.parent: list[int] = []
        self.void: list[bool] = []
        self.article = False

    def state(self) -> tuple[int, bool, int]:
        return self.open[-1][1:] if self.open else (0, False, -1)

    def push(self, tag: str, found: dict[str, str]) -> None:
        cue, inside, named = self.state()
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if tag in ("html", "body"):
            level = 0
        elif tag in ("article", "main"):
            level = name_cue(names) if self.article and (inside or named >= 0) else 0
            if not self.article:  # the first one: what stands around it isn't boilerplate by name
                self.article = True
                at = named
                while at >= 0 and not self.void[at]:
                    self.void[at] = True
                    at = self.parent[at]
            inside = True
        else:
            level = 2 if tag in ("form", "fieldset") else name_cue(names)
            if level and inside and _only_header(names):
                level = 0
            if tag in CUE_TAGS or tag == "header" and not inside or found.get("role", "").strip().lower() in CUE_ROLES:
                cue = 2
        if level:
            self.level.append(level)
            self.parent.append(named)
            self.void.append(False)
            named = len(self.level) - 1
        (self.firm if tag not in LOOSE else []).append(len(self.open))
        self.at[tag].append(len(self.open))
        self.open.append((tag, cue, inside, named))

    def cut(self, to: int) -> None:
        """Close all from place `to` on."""
        while len(self.open) > to:
            tag = self.open.pop()[0]
            self.at[tag].pop()
            if tag not in LOOSE:
                self.firm.pop()

    def nearest(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def close(self, tag: str) -> None:
        own = self.nearest((tag,))
        if own > self.nearest(BOUNDS.get(tag, ())):
            self.cut(own)

    def imply(self, tag: str) -> None:
        if tag in ENDS_P and self.open and self.open[-1][0] == "p":
            self.cut(len(self.open) - 1)
        if tag in ENDS_ITEM and self.firm and self.open[self.firm[-1]][0] in ENDS_ITEM[tag]:
            self.cut(self.firm[-1])
        if tag in ENDS_CELL and (own := self.nearest(ENDS_CELL[tag])) > self.nearest(("table",)):
            self.cut(own)


def _only_header(names: str) -> bool:
    """Within an article, a header is that of the article."""
    return not any(name_cue(n) for n in names.split() if "header" not in n.lower())


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page."""
    if not page:
        return []
    found: list[tuple[str, int, int, int, bool, int]] = []
    at_open = _Containers()
    parts: list[str] = []
    links: list[str] = []
    link_depth = -1  # elements open where a link began; -1: in no link
    skipped, in_skipped, skip_depth = Counter(), 0, 0  # elements open where the skipped part began

    def text_node(s: str) -> None:
        if s and not in_skipped:
            parts.append(s)
            if link_depth >= 0:
                links.append(s)

    def end_block() -> None:
        if parts:
            words = html_lib.unescape("".join(parts)).split()
            if words:
                linked = len(html_lib.unescape(" ".join(links)).split()) if links else 0
                found.append((" ".join(words), len(words), min(linked, len(words)), *at_open.state()))
            parts.clear()
            links.clear()

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        m = TAG.match(page, start)
        if m is None:
            text_node(page[at:start])
            if page.startswith("<!--", start):
                if page.startswith((">", "->"), start + 4):
                    at = page.index(">", start) + 1
                else:
                    end = COMMENT_END.search(page, start + 4)
                    at = end.end() if end else size
            elif page.startswith(("<!", "<?", "</"), start) and start + 2 < size:
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
            else:
                text_node("<")
                at = start + 1
            continue
        text_node(page[at:start])
        at = m.end()
        if not m[4]:
            break  # a tag that the page's end cuts off is none
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "a" and not in_skipped:
                link_depth = len(at_open.open) if not closing and "href" in attributes(m[3]) else -1
            continue
        end_block()
        if tag in SKIPPED:
            if closing:
                if skipped[tag]:
                    skipped[tag] -= 1
                    in_skipped -= 1
            elif tag in RAW:
                stop = _raw_end(tag).search(page, at)
                at = stop.end() if stop else size
            elif not (tag in FOREIGN and m[3].endswith("/")):
                skip_depth = skip_depth if in_skipped else len(at_open.open)
                skipped[tag] += 1
                in_skipped += 1
            continue
        if closing:
            at_open.close(tag)
        else:
            at_open.imply(tag)
            if tag in CONTAINERS:
                at_open.push(tag, attributes(m[3]))
        if len(at_open.open) < link_depth:
            link_depth = -1
        if in_skipped and len(at_open.open) < skip_depth:  # what was left open ends with what it stands in
            skipped.clear()
            in_skipped = 0
    else:
        start = size
    if start < 0:
        text_node(page[at:])
    end_block()
    return _with_cues(found, at_open)


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[{SPACE}/>])[^>]*+(?:>|\Z)", re.I)


def _with_cues(found: list[tuple[str, int, int, int, bool, int]], of: _Containers) -> list[Block]:
    words = [0] * len(of.level)
    for _, n, _, cue, _, named in found:
        if named >= 0 and not cue:
            words[named] += n
    for i in range(len(words) - 1, -1, -1):
        if of.parent[i] >= 0:
            words[of.parent[i]] += words[i]
    total = sum(n for _, n, _, cue, _, _ in found if not cue)
    level: list[int] = []
    for i, own in enumerate(of.level):
        void = of.void[i] or words[i] == total >= WRAPPER_WORDS
        level.append(max(0 if void else own, level[of.parent[i]] if of.parent[i] >= 0 else 0))
    return [Block(text, n, linked, max(cue, level[named] if named >= 0 else 0), inside) for text, n, linked, cue, inside, named in found]


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "cue", "in article", "beside the article")


def features(page: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    x = np.zeros((len(page), len(FEATURES)))
    inside = any(b.inside for b in page)
    for i, b in enumerate(page):
        x[i, 0], x[i, 1] = b.words, b.linked / b.words
        x[i, 6], x[i, 7], x[i, 8] = b.cue, b.inside, inside and not b.inside
    x[1:, 2:4] = x[:-1, 0:2]
    x[:-1, 4:6] = x[1:, 0:2]
    return x


#: The labelled table: pages of blocks, each "path | words | linked words | kept".
LABELLED = """
nav ul li | 1 | 1 | 0
nav ul li | 2 | 2 | 0
div.ad | 8 | 0 | 0
article h1 | 7 | 0 | 1
article p | 60 | 0 | 1
article p | 1 | 0 | 1
article p | 3 | 3 | 1
article p | 2 | 0 | 1
article p | 4 | 0 | 1
article p | 35 | 2 | 1
article p | 2 | 2 | 1
article p | 120 | 0 | 1
footer | 9 | 0 | 0

header div | 3 | 1 | 0
header nav ul li | 1 | 1 | 0
main article h1 | 5 | 0 | 1
main article p | 40 | 1 | 1
main article ul li | 6 | 0 | 1
main article ul li | 4 | 4 | 1
main article aside p | 30 | 0 | 0
main article p | 2 | 0 | 1
main article div.share-buttons | 3 | 3 | 0
main section.comments p | 45 | 0 | 0
main section.comments p | 12 | 0 | 0
aside ul li | 4 | 4 | 0
footer p | 12 | 3 | 0

div.cookie-notice p | 62 | 1 | 0
div.header | 4 | 0 | 0
div.menu ul li | 2 | 2 | 0
div.content h2 | 6 | 0 | 1
div.content p | 80 | 3 | 1
div.content p | 9 | 0 | 1
div.content p | 33 | 1 | 1
div.social-science p | 55 | 2 | 1
div.social-science p | 48 | 0 | 1
div.sidebar p | 20 | 0 | 0
div.sidebar ul li | 3 | 3 | 0
div#comments p | 98 | 0 | 0
div#comments p | 41 | 0 | 0
form label | 2 | 0 | 0
form p | 31 | 0 | 0
div.footer | 7 | 2 | 0

table tr td | 1 | 1 | 0
table tr td | 2 | 2 | 0
table tr td | 2 | 0 | 0
table tr td | 1 | 1 | 0
table tr td h1 | 6 | 0 | 1
table tr td p | 70 | 0 | 1
table tr td p | 44 | 0 | 1
table tr td p | 5 | 0 | 1
table tr td p | 65 | 4 | 1
table tr td p | 8 | 0 | 1
table tr td | 4 | 4 | 0
table tr td | 3 | 0 | 0
table tr td | 3 | 3 | 0

div | 3 | 0 | 0
div | 2 | 2 | 0
div | 1 | 1 | 0
div | 2 | 0 | 0
div | 2 | 2 | 0
div | 13 | 0 | 0
div | 4 | 4 | 0
div | 8 | 0 | 0
div | 4 | 4 | 0
h2 | 5 | 0 | 1
p | 58 | 6 | 1
p | 4 | 0 | 1
p | 47 | 0 | 1
p | 26 | 9 | 1
p | 12 | 0 | 1
div | 6 | 5 | 0
div | 2 | 2 | 0
p | 64 | 0 | 1
div | 2 | 2 | 0
div | 7 | 6 | 0
div | 4 | 0 | 0
div | 5 | 5 | 0

div ul li | 2 | 2 | 0
div ul li | 1 | 1 | 0
p | 4 | 0 | 1
p | 55 | 1 | 1
p | 18 | 0 | 1
p | 3 | 0 | 1
p | 41 | 0 | 1
div.advert p | 14 | 0 | 0
div.related-posts ul li | 8 | 8 | 0
div.related-posts p | 6 | 0 | 0
div.share | 4 | 0 | 0

div | 2 | 2 | 0
p | 16 | 0 | 1
p | 4 | 0 | 1
div | 3 | 3 | 0
p | 21 | 0 | 1
p | 5 | 0 | 1
p | 24 | 0 | 1
div | 2 | 2 | 0

div p | 12 | 0 | 0
div p | 5 | 2 | 0
div p | 30 | 0 | 0
article p | 3 | 0 | 1
article p | 2 | 2 | 1
article p | 3 | 0 | 1
article p | 5 | 4 | 1
article p | 1 | 0 | 1
article div.comment-list p | 33 | 0 | 0
article div.comment-list p | 4 | 0 | 0
article div.related p | 9 | 0 | 0
article div.social-history p | 40 | 0 | 1
article div.social-history p | 37 | 1 | 1
div p | 25 | 0 | 0

article h1 | 6 | 0 | 1
article p | 25 | 0 | 1

article p | 2 | 0 | 1

article h1 | 4 | 0 | 1
article p | 5 | 5 | 1
article p | 2 | 0 | 1
article p | 1 | 1 | 1
article p | 3 | 0 | 1

article p | 30 | 9 | 1

p | 14 | 0 | 1

div p | 3 | 0 | 1
div p | 40 | 2 | 1

div p | 2 | 0 | 1
div p | 9 | 0 | 1

body | 12 | 0 | 1

p | 3 | 0 | 1
"""
DEPTH = 10


def _page(lines: str) -> tuple[str, list[int]]:
    """A page of the table, and which of its blocks are kept."""
    out, kept = [], []
    for line in lines.split("\n"):
        path, words, linked, keep = (x.strip() for x in line.split("|"))
        n, m = int(words), int(linked)
        steps = [re.match(r"(\w+)(?:\.([\w-]+))?(?:#([\w-]+))?$", s).groups("") for s in path.split()]
        text = " ".join(["w"] * (n - m)) + (f" <a href=x>{' '.join(['w'] * m)}</a>" if m else "")
        out += [f'<{t} class="{c}" id="{i}">' for t, c, i in steps] + [text] + [f"</{t}>" for t, _, _ in reversed(steps)]
        kept.append(int(keep))
    return "".join(out), kept


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows, kept = [], []
    for lines in LABELLED.strip().split("\n\n"):
        page, keep = _page(lines)
        rows.append(features(blocks(page)))
        kept += keep
    return np.concatenate(rows), np.array(kept)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A tree: a share of kept rows, or (feature, threshold, tree up to it, tree beyond it)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(len(FEATURES)):  # of equal splits the first
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            gini = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[left], y[~left]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(t), left)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, t, left = best
    return f, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@functools.cache
def tree():
    return grow(*labelled())


def kept(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)

    def walk(node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, float):
            out[rows] = node >= 0.5
            return
        f, t, low, high = node
        left = x[rows, f] <= t
        walk(low, rows[left])
        walk(high, rows[~left])

    walk(tree(), np.arange(len(x)))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, kept(features(found)).tolist(), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one map over the pages without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return arrow_map(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
