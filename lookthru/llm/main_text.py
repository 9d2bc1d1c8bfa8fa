"""Main text of web pages by scoring the element tree.

Every block of text passes points (one, one per comma, one per hundred characters up to three) to its container, half of
them to the next and a third, a quarter ... further up, each discounted by the share of linked text. The container with the
most points wins; an article around it stands for it. Siblings with a good share of its points, of its own kind, or between
such ones are kept too. Elements that are no content by tag, role or class name (menus, headers, footers, sidebars, notices, adverts,
forms, comments) are left out before. A class name counts as a whole or by its leading part, or by its last part behind a
word for a place ("site-footer"). A form or an element with such a name that holds nearly all points of the page is a wrapper and
stays, unless it is named for comments. Inside the winner nothing else is left out; link density takes points, and text only from
siblings and from lists of links directly in the page's body.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lookthru.llm.text import slices

LEVELS = 5               # ancestors that get points
SIBLING_SHARE = 0.2      # of the winner's points, from which a sibling is kept
SIBLING_POINTS = 10.0
LINKED = 0.6             # siblings and, in a winning body, lists with a larger share of linked text are left out
WRAPPER = 0.8            # share of the page's points from which a form or a named element is a wrapper
#: Tags and names of HTML that mark what is not main text: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead
tr ul""".split())
DROPPED = frozenset("nav footer aside form button select menu dialog fieldset input label search".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promos promotion promoted banner
sidebar sidebars sidenav aside rail menu menus nav navi navbar navigation topnav subnav breadcrumb breadcrumbs crumbs pagination pager toolbar tabs
comment comments commentlist commentary disqus reply replies respond discussion footer footers foot footnav bottombar header headers masthead topbar
cookie cookies consent gdpr notice notices notification alert alerts warning popup popups modal overlay newsletter subscribe subscription signup
signin login register paywall share shares sharing social follow related recommended recommendations recirculation widget widgets form forms
search searchbox skip hidden invisible disclaimer copyright legal tags taglist""".split())
COMMENT_NAMES = frozenset("comment comments commentlist commentary disqus reply replies respond discussion".split())
PLACES = frozenset("site page main global top bottom left right post article entry primary secondary user reader blog".split())
STATES = frozenset("open closed enabled disabled on off none allowed free less".split())
WRAPPERS = frozenset("form fieldset label search dialog header".split())   # tags that may stand around a page
PAGE_TAGS = ("html", "body", "#root")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = frozenset("li ul ol div dd dt td menu body".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
FENCES = frozenset("table ul ol dl body html article section div main blockquote td th".split())
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s>/]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[^a-z0-9]+")
KEPT, WRAPS, OUT = 0, 1, 2


class Node:
    __slots__ = ("tag", "parent", "items", "state", "points", "name")

    def __init__(self, tag: str, parent: "Node | None", state: int = KEPT, name: str = ""):
        self.tag, self.parent, self.items, self.state, self.points, self.name = tag, parent, [], state, 0.0, name

    @property
    def dropped(self) -> bool:
        return self.state != KEPT


def _named(value: str) -> frozenset[str]:
    """Which of the dropped names the class or id names of an element stand for."""
    found = set()
    for name in value.split():
        parts = [p for p in _NAME.split(name) if p]
        if not parts or len(parts) > 1 and parts[-1] in STATES:
            continue
        found.update(x for x in ("".join(parts), parts[0]) if x in DROPPED_NAMES)
        if len(parts) > 1 and parts[0] in PLACES and parts[-1] in DROPPED_NAMES:
            found.add(parts[-1])
    return frozenset(found)


def _state(tag: str, attributes: str, inside_article: bool) -> tuple[int, str]:
    """Whether an element is kept, left out, or left out unless it wraps the page; and its class."""
    state, kind = KEPT, ""
    if tag in DROPPED or tag == "header" and not inside_article:
        if tag not in WRAPPERS:
            return OUT, ""
        state = WRAPS
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return state, kind
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.strip() in DROPPED_ROLES:
            return OUT, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT, ""
        if name in ("class", "id"):
            kind = " ".join(value.split()) if name == "class" else kind
            short = tag in ("p", "a", "b", "i", "em", "strong", "h1", "h2")
            found = DROPPED_NAMES.intersection(value.split()) if short else _named(value)
            if found & COMMENT_NAMES:
                return OUT, ""
            if found:
                state = WRAPS
    return state, kind


def parse(html: str) -> Node:
    """The element tree; unclosed and crossed tags are settled as browsers mostly do."""
    root = at = Node("#root", None)
    end, place, articles = len(html), 0, 0
    while place < end:
        m = _PART.match(html, place)
        place = m.end()
        tag = m[1]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                at.items.append(unescape(m[0]))
            continue
        tag, closing = tag.lower(), m[0][1] == "/"
        if closing:
            node = at
            while node.parent is not None and node.tag != tag and not (node.tag in FENCES and tag not in BLOCKS):
                node = node.parent
            if node.tag == tag and node.parent is not None:
                step = at
                while step is not node.parent:
                    articles -= step.tag in ("article", "main")
                    step = step.parent
                at = node.parent
            elif tag == "br":
                at.items.append(" ")
            continue
        if tag == "br":
            at.items.append(" ")
            continue
        closes = CLOSED_BY.get(tag, ()) + (("p",) if tag in BLOCKS else ())
        if closes:
            node = at
            while node.parent is not None and node.tag not in closes and node.tag not in FENCES:
                node = node.parent
            while node.parent is not None and node.tag in closes:
                at = node.parent
                node = at
        new = Node(tag, at, *_state(tag, m[2] or "", articles > 0))
        at.items.append(new)
        if tag in RAW:
            new.state = OUT
            stop = re.compile(f"</{re.escape(tag)}[^>]*>?", re.I).search(html, place)
            place = stop.end() if stop else end
        elif tag not in VOID and not m[0].endswith("/>"):
            at = new
            articles += tag in ("article", "main")
    return root


def _blocks(top: Node, within: bool = False) -> list[tuple[Node, str, float]]:
    """(container, text, share of linked text) of the blocks below, in page order."""
    out, parts, owner, linked = [], [], top, 0
    work: list = [(top, iter(top.items), False)]

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((owner, text, min(1.0, linked / len(text))))
        parts, linked = [], 0

    while work:
        node, items, link = work[-1]
        for item in items:
            if isinstance(item, str):
                parts.append(item)
                if link:
                    linked += len(" ".join(item.split()))
            elif not item.dropped:
                if item.tag in BLOCKS:
                    flush()
                    owner = item
                work.append((item, iter(item.items), link or item.tag == "a"))
                break
            elif item.tag in BLOCKS:
                flush()
        else:
            work.pop()
            if node.tag in BLOCKS:
                flush()
                owner = next((n for n, *_ in reversed(work) if n.tag in BLOCKS), top)
    flush()
    return out


def _points(text: str, linked: float) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked)


def _unwrap(root: Node) -> None:
    """Keep the elements that are left out by name, or as a form, but hold nearly all points of the page."""
    order, doubtful = [root], []
    for node in order:  # outer elements first
        order += [n for n in node.items if isinstance(n, Node) and n.state != OUT]
        if node.state == WRAPS:
            doubtful.append(node)
    if not doubtful:
        return
    for node in doubtful:
        node.state = KEPT
    held: dict[int, float] = {}
    total = 0.0
    for owner, text, linked in _blocks(root):
        points = _points(text, linked)
        total += points
        while owner is not None:
            held[id(owner)] = held.get(id(owner), 0.0) + points
            owner = owner.parent
    for node in doubtful:
        if not total or held.get(id(node), 0.0) < WRAPPER * total:
            node.state = OUT


def _flat(node: Node, linked_below: float) -> str:
    return " ".join(t for _, t, linked in _blocks(node) if linked < linked_below)


def _share_linked(node: Node) -> float:
    blocks = _blocks(node)
    size = sum(len(t) for _, t, _ in blocks)
    return sum(len(t) * linked for _, t, linked in blocks) / size if size else 0.0


def _beside(best: Node) -> list[Node]:
    """The winner and the siblings that belong to it, in page order."""
    if best.parent is None or best.tag in PAGE_TAGS:
        return [best]
    line = max(SIBLING_POINTS, SIBLING_SHARE * best.points)
    near = [n for n in best.parent.items if isinstance(n, Node) and not n.dropped]
    inside = best.parent.tag not in PAGE_TAGS

    def belongs(n: Node) -> bool:
        if n is best or n.tag == best.tag == "article":
            return True
        if n.tag == "p" and best.tag != "article" and len(_flat(n, 0.25)) > 80:
            return True
        alike = n.tag == best.tag and (n.name == best.name != "" or inside and n.name == best.name)
        return (n.points >= line or alike) and _share_linked(n) < LINKED

    kept = [belongs(n) for n in near]
    first, last = kept.index(True), len(kept) - kept[::-1].index(True)
    while first and near[first - 1].tag in HEADINGS:  # a heading belongs to what follows it
        first -= 1
        kept[first] = True
    return [n for i, n in enumerate(near) if kept[i] or first < i < last and _share_linked(n) < LINKED]


def extract(html: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    _unwrap(root)
    blocks = _blocks(root)
    scored = []
    for node, text, linked in blocks:
        points = _points(text, linked)
        up = node.parent if node.tag not in ("div", "section", "article", "main", "td", "body", "#root") else node
        for level in range(1, LEVELS + 1):
            if up is None:
                break
            if not up.points:
                scored.append(up)
            up.points += points / level if level > 2 else points / (1, 2)[level - 1]
            up = up.parent
    if not scored:
        return ""
    best = max(scored, key=lambda n: n.points)
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            best = node
            if node.tag == "article":
                break
        node = node.parent
    loose = best.tag in PAGE_TAGS
    out = []
    for node in _beside(best):
        out += [text for owner, text, linked in _blocks(node) if not (loose and linked >= LINKED and owner.tag in LISTS)]
    return " ".join(out)


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points).

    Null and empty pages have an empty text, as have pages without text outside of menus and the like. Character references
    are decoded, white space inside a block becomes one space, blocks are joined by one space. Repeated rows
    each give a row; an empty table gives an empty table.
    """
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_column, url_column))

    def run(batches):
        for part in slices(batches, "html"):
            texts = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    given = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return given.mapInArrow(run, f"id {kind}, url {url_kind}, text string, n_chars bigint")


def op8_main_text(pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumnRenamed("id", "page_id")
