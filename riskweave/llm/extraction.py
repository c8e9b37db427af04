"""Operator 6, HTML extraction by tree scoring.

Markup is read into a tree of blocks.  Every paragraph gives points for its
length and its commas to its parent and, halved, to its grandparent and so on; a
container's points are cut by the share of its text that stands in links.  The
best container is the article, with those of its siblings that score alike or
read like prose.  What is never an article (menus, forms, scripts) is left out by
tag and role first, and so is what all words of a name say to be a notice, an
advert or readers' comments.  Inside the article nothing else is dropped but
lists that are nothing but short links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes noembed".split())
DROPPED = frozenset("script style noscript template iframe head title nav header footer aside form button select option input textarea label svg canvas object embed menu dialog fieldset audio video noframes noembed xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("html body caption tbody td tfoot th thead tr legend".split())
#: Tag, and the open tags that it closes, up to the tags that bound the search.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
# Words of class and id names that say what a part of a page is, and words that only say where it stands.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion related replies respond rss share shares sharing sidebar sidenav skyscraper social sponsor sponsored sponsors subscribe tags toolbar widget widgets".split()
)
NEUTRAL = frozenset(
    "a area bar block bottom box button buttons center col column container cta float full group holder icon icons inner item items large left link links list main mobile outer panel posts primary right row secondary section side site slot small stories sub the top unit wide wrap wrapper zone".split()
)
LIKELY = re.compile(r"(^|[\s_-])(article\w*|body|content|entry\w*|main|post\w*|story|text)([\s_-]|$)", re.IGNORECASE)
ADVERTS = frozenset("ad ads advert adverts advertisement advertising promo promos promotion sponsor sponsored sponsors".split())
#: Elements whose names don't decide, and those that are parts of a text.
WHOLE = frozenset("html body article main".split())
TEXT_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre blockquote code em strong b i a figure figcaption table tr".split())
ROLES_DROPPED = frozenset("navigation banner contentinfo complementary search menu menubar form dialog alert alertdialog".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")
#: A list inside the article is a menu if at least this share of it stands in links, and its items have at most so many characters on average.
MENU_LINKS, MENU_ITEM = 0.9, 30
#: A container that its name marks as the article takes the best one's place if its other parts add at least this share of points.
OTHERS = 0.1


#: Elements deeper than this are read as if they stood beside each other, as browsers do.
MOST_DEPTH = 512


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "likely", "points")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, likely: bool = False):
        self.tag, self.parent, self.dropped, self.likely = tag, parent, dropped, likely
        self.items: list[Node | str] = []
        self.points = 0.0


def unlikely(names: str, out: frozenset[str] = UNLIKELY) -> bool:
    """One of the names is made of nothing but words for what isn't an article, and words for places: ``comment-list``, not ``related-work``."""
    for name in names.lower().split():
        words = set(WORD.findall(name))
        if words & out and words <= out | NEUTRAL:
            return True
    return False


def _judged(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether a tag is left out, and whether its names speak for an article."""
    if tag in DROPPED:
        return True, False
    if not attributes:
        return False, tag in ("article", "main")
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    likely = tag in ("article", "main") or bool(LIKELY.search(names)) or found.get("role") == "main"
    out = "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES_DROPPED or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    # Names count for parts of a page; of a paragraph or heading of its text they only tell adverts.
    return out or unlikely(names, ADVERTS if tag in TEXT_PARTS else UNLIKELY) and tag not in WHOLE, likely


def parse(page: str) -> Node:
    """The tree of a page, whatever its errors; elements that are left out are empty."""
    root = node = Node("html", None)
    at, n, depth = 0, len(page), {id(root): 0}
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            node.items.append(page[at:])
            break
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            above = node
            while above.parent and above.tag != tag:
                above = above.parent
            if above.parent:
                node = above.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            above = node
            while above.parent and above.tag not in ("p", "table", "td", "th", "button"):
                above = above.parent
            if above.tag == "p":
                node = above.parent
        if tag in CLOSES:
            closed, bound = CLOSES[tag]
            above, last = node, None
            while above.parent and above.tag not in bound:
                if above.tag in closed:
                    last = above
                above = above.parent
            if last:
                node = last.parent
        if tag in VOID:
            if tag in ("br", "wbr"):
                node.items.append(" " if tag == "br" else "")
            elif tag == "hr":
                node.items.append(Node(tag, node))
            continue
        dropped, likely = _judged(tag, m[3] or "")
        child = Node(tag, node, dropped, likely)
        node.items.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            child.items.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif depth[id(node)] < MOST_DEPTH:
            depth[id(child)] = depth[id(node)] + 1
            node = child
    return root


def blocks(node: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, characters of it in links) in page order, what is left out not counted."""
    out: list[tuple[Node, str, int]] = []
    run: list[str] = []
    linked = 0
    owner = node

    def close() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            out.append((owner, text, min(linked, len(text))))
        run.clear()
        linked = 0

    stack: list[tuple[Node, Iterator, bool]] = [(node, iter(node.items), False)]
    while stack:
        own, items, in_link = stack[-1]
        x = next(items, None)
        if x is None:
            stack.pop()
            if own.tag in BLOCKS:
                close()
                above = own.parent
                while above and above.tag not in BLOCKS and above is not node:
                    above = above.parent
                owner = above or node
        elif isinstance(x, str):
            run.append(x)
            if in_link:
                linked += len(SPACE.sub(" ", x).strip())
        elif not x.dropped:
            if x.tag in BLOCKS:
                close()
                owner = x
            stack.append((x, iter(x.items), in_link or x.tag == "a"))
    close()
    return out


def extract(page: str | None) -> str:
    """The main text: its blocks in page order, one on a line."""
    if not page:
        return ""
    root = parse(page)
    found = blocks(root)
    if not found:
        return ""
    length: dict[int, int] = {}
    links: dict[int, int] = {}
    scored: dict[int, Node] = {}
    for block, text, linked in found:
        above: Node | None = block
        while above:
            length[id(above)] = length.get(id(above), 0) + len(text)
            links[id(above)] = links.get(id(above), 0) + linked
            above = above.parent
        if len(text) < 25 or block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 10)) * (1 - linked / len(text))
        # A text that stands directly in a container counts for it; a paragraph's for its parent.
        above, share = block.parent if block.tag in ("p", "pre", "blockquote", "td", "li") and block.parent else block, 1.0
        while above:
            above.points += points * share
            scored[id(above)] = above
            above, share = above.parent, share / 2
    density = lambda n: links.get(id(n), 0) / max(1, length.get(id(n), 0))
    final = {k: (n.points + (5 if n.likely else 0)) * (1 - density(n)) for k, n in scored.items()}
    if not final:
        # No paragraph is long enough to tell: everything that isn't mostly links, of a marked article if there is one.
        marked = next((b for b, _, _ in found if _within_likely(b)), None)
        return "\n".join(t for b, t, k in found if k * 2 <= len(t) and (marked is None or _within_likely(b)))
    best_key = max(final, key=final.get)
    best = scored[best_key]
    # An ancestor that is the article, or whose name marks it so and whose other parts count, holds its parts together.
    above, share = best.parent, 0.5
    while above:
        others = final.get(id(above), 0.0) - share * final[best_key]
        if above.tag in ("article", "main") or (above.likely and above.tag in BLOCKS and others >= OTHERS * final[best_key]):
            best = above
        above, share = above.parent, share / 2
    chosen = {id(best)}
    threshold = max(10.0, 0.2 * final.get(id(best), final[best_key]))
    if best.parent and best.tag not in ("article", "main"):
        texts: dict[int, list[tuple[str, int]]] = {}
        for block, text, linked in found:
            above = block
            while above and above.parent is not best.parent:
                above = above.parent
            if above:
                texts.setdefault(id(above), []).append((text, linked))
        for x in best.parent.items:
            if not isinstance(x, Node) or x is best or id(x) not in texts:
                continue
            own = texts[id(x)]
            n, k = sum(len(t) for t, _ in own), sum(k for _, k in own)
            prose = x.tag == "p" and (n > 80 and k < 0.25 * n or k == 0 and own[-1][0].endswith((".", "!", "?")))
            if final.get(id(x), 0.0) >= threshold or prose or x.tag in ("h1", "h2", "h3") and k == 0:
                chosen.add(id(x))
    elif best.tag in ("article", "main") and best.parent:
        chosen |= {id(x) for x in best.parent.items if isinstance(x, Node) and x.tag == best.tag and final.get(id(x), 0.0) >= threshold}
    menus = _menus(found)
    kept = []
    for block, text, linked in found:
        above = block
        while above and id(above) not in chosen:
            above = above.parent
        if above and id(block) not in menus:
            kept.append(text)
    return "\n".join(kept)


def _menus(found: list[tuple[Node, str, int]]) -> set[int]:
    """Blocks of lists that are nothing but short links, and blocks that are rows of links by themselves."""
    lists: dict[int, list[tuple[Node, str, int]]] = {}
    out: set[int] = set()
    for block, text, linked in found:
        above: Node | None = block
        while above and above.tag not in ("ul", "ol", "dl"):
            above = above.parent
        if above:
            lists.setdefault(id(above), []).append((block, text, linked))
        elif block.tag in ("div", "section", "td") and linked >= MENU_LINKS * len(text):
            out.add(id(block))
    for own in lists.values():
        size = sum(len(t) for _, t, _ in own)
        if sum(k for _, _, k in own) >= MENU_LINKS * size and size <= MENU_ITEM * len(own):
            out |= {id(b) for b, _, _ in own}
    return out


def _within_likely(node: Node) -> bool:
    above: Node | None = node
    while above:
        if above.likely:
            return True
        above = above.parent
    return False


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 200):
            part = batch.slice(first, 200)
            texts = [extract(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The article of every page: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without text, have an empty text.  Text
    outside of any element is a block like any other; markup that breaks off ends
    where the page does.  Null ids and urls are kept.  Repeated rows are read each
    for itself.  An empty table gives an empty result.  Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(_run, schema)
