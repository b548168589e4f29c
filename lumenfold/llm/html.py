"""Operator 2: main text of raw pages from flat text blocks.

A page is cut into flat blocks at block-level tags. Each block gets its word count, its link
density, those of its neighbours, whether it lies in a region that names itself as furniture
(nav, footer, class "ad", ...) and whether it lies in, or outside of, the page's article. A decision
tree classifies the blocks; it is trained on LABELLED, a small table of labelled blocks in
this module. Where a page marks its article, text in it is never judged by its length, links or neighbours; where it marks none,
they decide: a short or linked block is text between running text and menu between links. Kept blocks are joined in
page order by two line feeds.

Defined results: null, empty and textless pages give the empty string; broken and truncated markup is read as far
as it goes; a page is read whole, in one task, in time and memory in proportion to it, without a shuffle; repeated
rows are read each for itself; an empty table gives an empty one. Only the named column is read, so others cannot clash.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    | <(?P<raw>script|style)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)
    | <(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>
    | <(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)>
    | <[!?][^>]*>
    | <[/!?a-z][^<>]*\Z""",
    re.DOTALL | re.IGNORECASE | re.VERBOSE,
)
#: Elements, besides script and style, that go with what they hold.
RAW = frozenset("noscript template textarea select button svg iframe object canvas title".split())
RAW_TAG = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    | <(?P<raw>script|style)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)
    | <(?P<end>/?)(?P<tag>{"|".join(sorted(RAW))})(?=[\s/>])(?:(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|(?P<attrs2>[^>]*)>)""",
    re.DOTALL | re.IGNORECASE | re.VERBOSE,
)
#: The end of a tag that closes itself; a slash within an unquoted value does not.
CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
ATTR = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Tags that stay within a block; all others end it.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags whose start ends a paragraph.
ENDS_P = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags and words in class, id or role that name a region as furniture.
FURNITURE_TAGS = frozenset("nav header footer aside form dialog menu".split())
FURNITURE = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer contentinfo complementary sidebar widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus reply replies respond login search searchbox pagination pager toc skip hidden".split())
#: Words for a container, which leave the word before them in charge of a hyphenated name.
CONTAINER = frozenset("area bar block box button buttons col column container content form group icons inner items item label link links list nav notice outer panel popup row section strip text thread toggle wrap wrapper".split())
#: The same, run together with other words.
FURNITURE_PART = re.compile(r"sidebar|footer|navbar|(top|main|sub|side)(nav|menu)$|navigat|cookie|newsletter|advert|breadcrumb|masthead|sponsor|^comments?(list|form|area|box|section|thread|wrap)$|^ads?(box|slot|unit|banner|wrap)$")
#: Furniture words that count on an article tag itself, whose class may tell of the page.
FURNITURE_ARTICLE = frozenset("ad ads advert comment comments reply replies related promo sponsored teaser".split())
ARTICLE = frozenset("article main".split())
FEATURES = ("furniture", "in_article", "outside_article", "heading", "words", "link_density", "words_before", "links_before", "words_after", "links_after")


def names(tag: str, attrs: str) -> tuple[set[str], bool]:
    """The words of class, id and role, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    if not attrs:
        return words, hidden
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value != "false":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name in ("class", "id", "role"):
            for said in re.split(r"[^a-z0-9_-]+", value):  # a hyphenated name is what it ends in, but for containers
                parts = [x for x in re.split(r"[_-]+", said) if x]
                while len(parts) > 1 and (parts[-1] in CONTAINER or parts[-1].isdigit()) and parts[-1] not in FURNITURE:
                    parts.pop()
                words |= set(parts[-1:])
    return words, hidden


def named_furniture(words: set[str]) -> bool:
    return bool(words & FURNITURE) or any(FURNITURE_PART.search(w) for w in words)


def raw_ends(html: str) -> dict[int, int]:
    """Where the elements of RAW end, by the place of their start tags; of one that is never closed, the tag alone."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in RAW_TAG.finditer(html):
        if not m["tag"]:
            continue
        mine = opened.setdefault(m["tag"].lower(), [])
        if not m["end"]:
            out[m.start()] = m.end()
            if not CLOSED.search(m["attrs"] or m["attrs2"] or ""):
                mine.append(m.start())
        elif mine:
            out[mine.pop()] = m.end()
    return out


def blocks(html: str) -> list[dict]:
    """Flat text blocks in page order: text and the features of the block by itself."""
    out: list[dict] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture, article
    text: list[str] = []
    linked = links = heading = 0
    furniture = article = False
    ends_of: dict[int, int] | None = None
    paragraph = None  # where in the stack an open paragraph is that counts as furniture
    at = 0

    def flush() -> None:
        nonlocal linked, heading
        if text:
            words = unescape("".join(text)).split()
            if words:
                said = " ".join(words)
                out.append({"text": said, "furniture": int(furniture), "in_article": int(article), "heading": int(heading > 0), "words": len(words), "link_density": min(1.0, linked / len(said))})
            text.clear()
        linked = 0

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)

    while m := TOKEN.search(html, at):
        put(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"]:
                put(" ")
            continue
        tag, ends = tag.lower(), bool(m["end"] or m["end2"])
        if tag in RAW and not ends:
            if ends_of is None:
                ends_of = raw_ends(html)
            at = ends_of.get(m.start(), at)
            put(" " if tag != "title" else "")
            continue
        if tag == "a":
            links = 0 if ends else 1
        if tag == "br":
            put(" ")
        if tag in INLINE:
            if tag in ("span", "label") and not ends:
                words, hidden = names(tag, m["attrs"] or m["attrs2"] or "")
                if not (hidden or named_furniture(words)):
                    continue
                flush()
            elif not (tag in ("span", "label") and ends and any(x[0] == tag for x in stack[-1:])):
                continue
            else:
                flush()
        else:
            flush()
        if re.fullmatch("h[1-6]", tag):
            heading = 0 if ends else 1
        if paragraph is not None and (tag == "p" or tag in ENDS_P and not ends):
            del stack[paragraph:]
            paragraph = None
            furniture, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if tag == "p":
            words, hidden = (set(), False) if ends else names(tag, m["attrs"] or m["attrs2"] or "")
            if hidden or named_furniture(words):
                paragraph = len(stack)
                stack.append((tag, True, article))
        elif ends:
            for i in reversed(range(len(stack))):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            if paragraph is not None and paragraph >= len(stack):
                paragraph = None
        elif tag not in VOID and not (m["attrs"] or m["attrs2"] or "").endswith("/"):
            words, hidden = names(tag, m["attrs"] or m["attrs2"] or "")
            told = words & FURNITURE_ARTICLE if tag == "article" else tag not in ("html", "body", "main") and named_furniture(words)
            own = hidden or tag in FURNITURE_TAGS or bool(told)
            stack.append((tag, furniture or own, article or (tag in ARTICLE and not own)))
        furniture, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    put(html[at:])
    flush()
    return out


def featured(page: list[dict]) -> list[list[float]]:
    """A row of FEATURES for each block, with its neighbours' counts."""
    has = any(b["in_article"] and not b["furniture"] for b in page)
    none = {"words": 0, "link_density": 0.0}
    rows = []
    for i, b in enumerate(page):
        a, z = page[i - 1] if i else none, page[i + 1] if i + 1 < len(page) else none
        rows.append([b["furniture"], b["in_article"], int(has and not b["in_article"]), b["heading"], b["words"], b["link_density"], a["words"], a["link_density"], z["words"], z["link_density"]])
    return rows


#: Blocks of invented pages with their labels (1: main text), in the order of FEATURES.
LABELLED = [
    # furniture, whatever it holds
    ([1, 0, 1, 0, 1, 1.0, 0, 0.0, 1, 1.0], 0), ([1, 0, 0, 0, 2, 1.0, 1, 1.0, 1, 1.0], 0), ([1, 0, 1, 0, 14, 0.0, 1, 1.0, 9, 0.0], 0), ([1, 1, 0, 0, 25, 0.0, 60, 0.0, 42, 0.0], 0),
    ([1, 0, 1, 0, 11, 0.0, 55, 0.0, 0, 0.0], 0), ([1, 1, 0, 0, 80, 0.0, 31, 0.0, 24, 0.0], 0), ([1, 0, 0, 0, 45, 0.0, 0, 0.0, 18, 0.1], 0), ([1, 0, 0, 1, 3, 0.0, 70, 0.0, 20, 0.0], 0),
    ([1, 0, 1, 1, 4, 0.0, 1, 1.0, 12, 0.0], 0), ([1, 1, 0, 1, 2, 0.0, 90, 0.0, 33, 0.0], 0), ([1, 0, 1, 0, 120, 0.05, 12, 0.0, 5, 0.0], 0), ([1, 0, 0, 0, 60, 0.0, 50, 0.0, 70, 0.0], 0),
    ([1, 1, 0, 0, 12, 0.0, 40, 0.0, 30, 0.0], 0), ([1, 1, 0, 0, 3, 1.0, 40, 0.0, 30, 0.0], 0), ([1, 0, 0, 1, 4, 0.0, 40, 0.0, 60, 0.0], 0),
    # text beside the article
    ([0, 0, 1, 0, 20, 0.0, 3, 1.0, 60, 0.0], 0), ([0, 0, 1, 0, 4, 0.0, 44, 0.0, 2, 0.5], 0), ([0, 0, 1, 1, 3, 0.0, 1, 1.0, 5, 1.0], 0), ([0, 0, 1, 0, 2, 1.0, 1, 1.0, 2, 1.0], 0),
    ([0, 0, 1, 0, 65, 0.0, 80, 0.0, 0, 0.0], 0), ([0, 0, 1, 0, 10, 0.3, 0, 0.0, 20, 0.0], 0), ([0, 0, 1, 0, 30, 0.0, 50, 0.0, 40, 0.0], 0), ([0, 0, 1, 1, 5, 0.0, 50, 0.0, 40, 0.0], 0),
    # the article: long and short paragraphs, headings, lists of links, references
    ([0, 1, 0, 1, 8, 0.0, 12, 0.0, 60, 0.0], 1), ([0, 1, 0, 1, 2, 0.0, 1, 1.0, 1, 0.0], 1), ([0, 1, 0, 0, 60, 0.0, 8, 0.0, 45, 0.0], 1), ([0, 1, 0, 0, 1, 0.0, 60, 0.0, 1, 0.0], 1),
    ([0, 1, 0, 0, 1, 0.0, 1, 0.0, 10, 0.0], 1), ([0, 1, 0, 0, 2, 0.0, 9, 0.0, 12, 0.0], 1), ([0, 1, 0, 0, 30, 0.2, 45, 0.0, 11, 0.0], 1), ([0, 1, 0, 0, 12, 0.4, 30, 0.0, 25, 0.1], 1),
    ([0, 1, 0, 0, 150, 0.02, 1, 0.0, 3, 1.0], 1), ([0, 1, 0, 0, 3, 0.0, 5, 1.0, 2, 1.0], 1), ([0, 1, 0, 0, 400, 0.0, 0, 0.0, 0, 0.0], 1), ([0, 1, 0, 1, 5, 0.0, 80, 0.0, 70, 0.0], 1),
    ([0, 1, 0, 0, 7, 0.0, 2, 0.0, 11, 0.0], 1), ([0, 1, 0, 0, 20, 0.3, 2, 1.0, 11, 0.0], 1), ([0, 1, 0, 0, 1, 0.0, 0, 0.0, 0, 0.0], 1), ([0, 1, 0, 0, 11, 0.0, 0, 0.0, 2, 1.0], 1),
    ([0, 1, 0, 0, 2, 1.0, 11, 0.0, 2, 1.0], 1), ([0, 1, 0, 0, 2, 1.0, 2, 1.0, 3, 1.0], 1), ([0, 1, 0, 0, 4, 0.7, 30, 0.0, 6, 1.0], 1), ([0, 1, 0, 0, 3, 1.0, 2, 1.0, 0, 0.0], 1),
    # no article is marked: menus and scraps among links or other scraps
    ([0, 0, 0, 0, 2, 1.0, 2, 1.0, 3, 1.0], 0), ([0, 0, 0, 0, 6, 0.9, 5, 1.0, 4, 1.0], 0), ([0, 0, 0, 0, 1, 1.0, 0, 0.0, 2, 1.0], 0), ([0, 0, 0, 0, 1, 1.0, 2, 1.0, 40, 0.0], 0),
    ([0, 0, 0, 0, 3, 0.0, 2, 1.0, 1, 1.0], 0), ([0, 0, 0, 0, 2, 0.0, 0, 0.0, 3, 1.0], 0), ([0, 0, 0, 0, 4, 0.0, 5, 0.0, 3, 0.6], 0), ([0, 0, 0, 0, 5, 0.5, 1, 1.0, 4, 0.0], 0),
    ([0, 0, 0, 1, 2, 0.0, 1, 1.0, 3, 1.0], 0), ([0, 0, 0, 0, 3, 1.0, 45, 0.0, 2, 1.0], 0), ([0, 0, 0, 0, 2, 0.0, 3, 0.0, 0, 0.0], 0), ([0, 0, 0, 0, 9, 0.95, 8, 1.0, 9, 1.0], 0),
    ([0, 0, 0, 0, 4, 0.0, 2, 1.0, 2, 0.0], 0), ([0, 0, 0, 0, 12, 1.0, 10, 1.0, 11, 1.0], 0), ([0, 0, 0, 0, 14, 0.9, 12, 1.0, 30, 0.0], 0), ([0, 0, 0, 0, 3, 0.0, 1, 1.0, 2, 0.0], 0),
    ([0, 0, 0, 0, 5, 1.0, 4, 1.0, 0, 0.0], 0), ([0, 0, 0, 0, 4, 0.0, 40, 0.0, 2, 1.0], 0), ([0, 0, 0, 0, 5, 0.0, 60, 0.0, 0, 0.0], 0),
    ([0, 0, 0, 0, 20, 1.0, 20, 1.0, 5, 1.0], 0), ([0, 0, 0, 0, 13, 0.95, 3, 1.0, 2, 1.0], 0), ([0, 0, 0, 0, 18, 1.0, 2, 0.0, 0, 0.0], 0),
    ([0, 0, 0, 0, 3, 1.0, 30, 0.0, 3, 1.0], 0), ([0, 0, 0, 0, 4, 0.9, 38, 0.0, 5, 1.0], 0), ([0, 0, 0, 0, 1, 0.0, 2, 0.0, 20, 0.0], 0), ([0, 0, 0, 0, 3, 0.0, 2, 1.0, 45, 0.0], 0),
    # no article is marked: running text, and what stands between running text
    ([0, 0, 0, 0, 60, 0.0, 2, 1.0, 50, 0.0], 1), ([0, 0, 0, 0, 35, 0.1, 60, 0.0, 3, 1.0], 1), ([0, 0, 0, 0, 14, 0.0, 40, 0.0, 30, 0.0], 1), ([0, 0, 0, 0, 11, 0.0, 2, 1.0, 12, 0.0], 1),
    ([0, 0, 0, 0, 200, 0.05, 0, 0.0, 0, 0.0], 1), ([0, 0, 0, 0, 18, 0.2, 25, 0.0, 2, 1.0], 1), ([0, 0, 0, 0, 5, 0.0, 40, 0.0, 35, 0.0], 1), ([0, 0, 0, 0, 4, 0.0, 22, 0.0, 60, 0.0], 1),
    ([0, 0, 0, 1, 4, 0.0, 3, 1.0, 45, 0.0], 1), ([0, 0, 0, 1, 3, 0.0, 50, 0.0, 38, 0.0], 1), ([0, 0, 0, 0, 12, 0.0, 0, 0.0, 2, 1.0], 1), ([0, 0, 0, 0, 16, 0.0, 1, 1.0, 1, 1.0], 1),
    ([0, 0, 0, 0, 3, 1.0, 40, 0.0, 30, 0.0], 1), ([0, 0, 0, 0, 2, 0.6, 25, 0.0, 50, 0.0], 1), ([0, 0, 0, 0, 8, 0.0, 30, 0.0, 22, 0.1], 1), ([0, 0, 0, 1, 6, 0.0, 0, 0.0, 40, 0.0], 1),
    ([0, 0, 0, 0, 22, 0.5, 40, 0.0, 30, 0.0], 1), ([0, 0, 0, 0, 1, 0.0, 30, 0.0, 30, 0.0], 1),
    ([0, 0, 0, 0, 30, 0.05, 50, 0.0, 4, 1.0], 1), ([0, 0, 0, 0, 15, 0.0, 12, 0.0, 2, 1.0], 1), ([0, 0, 0, 0, 40, 0.0, 30, 0.0, 0, 0.0], 1), ([0, 0, 0, 0, 25, 0.0, 3, 0.0, 6, 0.0], 1),
    ([0, 0, 0, 0, 13, 0.0, 40, 0.0, 1, 0.0], 1), ([0, 0, 0, 0, 50, 0.3, 8, 0.0, 1, 1.0], 1),
    ([0, 0, 0, 0, 4, 1.0, 60, 0.0, 55, 0.0], 1), ([0, 0, 0, 0, 3, 1.0, 20, 0.0, 18, 0.0], 1), ([0, 0, 0, 1, 1, 0.0, 2, 0.0, 20, 0.0], 1), ([0, 0, 0, 0, 2, 0.0, 90, 0.0, 80, 0.0], 1),
    ([0, 0, 0, 1, 1, 0.0, 1, 1.0, 20, 0.0], 1), ([0, 0, 0, 1, 3, 0.0, 2, 1.0, 60, 0.0], 1), ([0, 0, 0, 1, 2, 0.0, 2, 1.0, 35, 0.0], 1),
]
DEPTH, LEAF = 8, 1


def grown(rows: list[tuple[list[float], int]], depth: int = DEPTH):
    """A decision tree: the share of label 1, or (feature, threshold, at most, above) of least Gini impurity."""
    n, ones = len(rows), sum(y for _, y in rows)
    impure = lambda part: (k := sum(y for _, y in part)) * (len(part) - k) / len(part)
    if not depth or ones in (0, n):
        return ones / n
    best = None
    for f in range(len(FEATURES)):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:], strict=False):
            left, right = [r for r in rows if r[0][f] <= (a + b) / 2], [r for r in rows if r[0][f] > (a + b) / 2]
            if min(len(left), len(right)) >= LEAF and (best is None or impure(left) + impure(right) < best[0]):
                best = (impure(left) + impure(right), f, (a + b) / 2, left, right)
    if best is None or best[0] >= impure(rows):
        return ones / n
    return best[1], best[2], grown(best[3], depth - 1), grown(best[4], depth - 1)


#: The trained tree.
TREE = grown(LABELLED)


def is_text(row: list[float], node=TREE) -> bool:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node > 0.5


def main_text(html: str | None) -> str:
    page = blocks(html or "")
    return "\n\n".join(b["text"] for b, row in zip(page, featured(page), strict=True) if is_text(row))


@F.arrow_udf(T.StringType())
def extracted(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in pages], pa.string())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = c.table(spark, sf_dir, "pages").select("page_id", "url", extracted("html").alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
