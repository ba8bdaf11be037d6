"""Main text of web pages by tree scoring.

The page becomes a tree. Paragraphs hand points for length and commas to their ancestors, less to
farther ones; a container's points are discounted by its link density. The best container is kept, and
those of its siblings that score or read like it, as are the siblings of the wrappers around it: the rows
of a grid, or articles that are wrapped each. Boilerplate (by element, role or class) takes no part.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, prepare, slices, spread

# Elements by kind, and words of classes and ids that mark boilerplate or content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "xmp", "noembed", "noframes"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "fieldset", "canvas", "audio", "video", "annotation", "annotation-xml"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
#: Kept beside the best container unless they are mostly links; a section or container like the best one needs a heading or points.
BESIDE = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure", "math"}
PARAGRAPH = {"p", "pre", "blockquote", "td", "li", "dd", "div", "section", "article", "main", "body"}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "legend", "summary"}
SAME_LEVEL = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}
UNLIKELY = {
    "ad", "ads", "advert", "advertisement", "adverts", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent",
    "cookie", "cookies", "disqus", "disclaimer", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notification", "outbrain", "pagination", "pager", "popup", "promo", "promoted", "recommended", "related", "replies", "respond", "share",
    "sharing", "sidebar", "signup", "skyscraper", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola", "toolbar", "widget", "topbar", "alert",
    "adsbygoogle", "adslot", "adbox", "adunit", "leaderboard", "reactions", "responses",
}
#: Words that stand beside those in the names of boilerplate within an article ("related-posts", but not "related-work").
COMPANIONS = {
    "area", "articles", "bar", "block", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "links", "list", "media", "message",
    "outer", "panel", "post", "posts", "section", "slot", "stories", "unit", "widgets", "wrap", "wrapper", "article", "entry", "page", "site", "main", "policy", "info", "warning",
}
REMARKS = {"comment", "comments", "commentlist", "reply", "replies", "response", "responses", "remark", "remarks"}
#: Words for readers: a name that has one is never that of the content ("user-post"), and of a thread of them if it starts so.
READERS = {"user", "users", "reader", "readers", "visitor", "visitors", "guest", "guests", "member", "members"}
SAYINGS = {"post", "posts", "opinion", "opinions", "feedback", "voices", "thoughts", "letters", "talk", "message", "messages", "discussion"}
#: Names of a list of remarks, unless it is a section with a heading of the text's own.
THREAD = {"discussion", "discussions", "thread"}
#: First or last parts of a name that only tells the state or layout of what holds the content ("has-sidebar", "comments-open").
STATE_FIRST = {"has", "have", "no", "not", "with", "without", "hide", "show"}
STATE_LAST = {"open", "opened", "closed", "enabled", "disabled", "allowed", "on", "off"}
#: Names of the page's frame, which may stand on an element around the content itself.
FRAME = {"banner", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "sidebar", "social", "toolbar", "topbar", "widget"}
#: The same inside run-together names.
RUN_TOGETHER = re.compile(r"cookie(?:banner|bar|notice|consent|law)|side_?bar|advert|newsletter|breadcrumb|paginat|masthead|disqus|sponsor|navbar|navmenu|commentlist|commentsection|usercomments|popup")
LIKELY = {"article", "body", "content", "entry", "hentry", "main", "page", "post", "story", "text", "blog"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "dl"}
#: Out of which an inline end tag doesn't reach.
BARRIER = {"table", "td", "article", "main", "body"}
TAG_POINTS = {"article": 10, "main": 8, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "section": 2}

TOKEN = re.compile(r"""<(?:!--(?:.*?-->|>|->|.*)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WHITE = re.compile(r"\s+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """An element: its children are nodes and (decoded) strings in order."""

    __slots__ = ("tag", "parent", "children", "words", "skip", "points", "chars", "linked", "commas", "named", "links", "within", "headed")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.links, self.headed = 0, tag in HEADING
        #: The nearest article or main element around it, by name.
        self.within = "" if parent is None else parent.tag if parent.tag in ("article", "main") else parent.within
        self.words: frozenset[str] = frozenset()
        self.skip = tag in BOILERPLATE
        self.points = 0.0
        self.chars = self.linked = self.commas = 0
        self.named = ""
        if attributes and "=" in attributes or "hidden" in attributes:
            found = {k.lower(): v.strip("\"'") if v else "" for k, v in ATTRIBUTE.findall(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            words = SPLIT.split(names.lower())
            self.words = frozenset(words)
            style = found.get("style", "").replace(" ", "").lower()
            if self.of_readers(found.get("class", "").split()):
                self.named = "thread"
            if UNLIKELY & self.words or REMARKS & self.words or RUN_TOGETHER.search(" ".join(words)):
                self.named = self.name_of_boilerplate(names.split()) or self.named
            self.skip |= tag == "label" and "for" in found
            if tag not in ("article", "body", "html", "main"):
                self.skip |= found.get("role", "").lower() in ROLES
            self.skip |= "hidden" in found or "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden", "").lower() == "true"

    def of_readers(self, classes: list[str]) -> bool:
        """A thread by its class: "thread", "discussion", "user-post", "reader-voices". An element that holds the text is none."""
        if self.tag not in ("div", "ol", "ul", "li", "section", "aside") or not (THREAD | READERS) & self.words:
            return False
        split = [[w for w in SPLIT.split(n.lower()) if w] for n in classes]
        return any(w and (w[0] in READERS and w[-1] in SAYINGS or self.tag != "section" and w[-1] in THREAD) for w in split)

    def name_of_boilerplate(self, names: list[str]) -> str:
        """How classes and id mark boilerplate: "remarks", "frame", "other", or not at all ("")."""
        split = [[w for w in SPLIT.split(HUMP.sub("-", n).lower()) if w] for n in names]
        split = [SPLIT.split(n.lower()) for n, w in zip(names, split) if not (len(w) > 1 and (w[0] in STATE_FIRST or w[-1] in STATE_LAST))]
        if self.within == "article":  # there, a word of boilerplate counts only in a name that says nothing else
            split = [n for n in split if RUN_TOGETHER.search(" ".join(n)) or n and n[-1] in REMARKS or {w for w in n if w and not w.isdigit()} <= UNLIKELY | REMARKS | COMPANIONS]
        words = {w for n in split for w in n}
        if self.tag == "article":
            return "remarks" if REMARKS & words else ""
        if self.tag in ("body", "html", "main"):
            return ""
        unlikely = (UNLIKELY | REMARKS) & words
        if unlikely == {"header"} and {"article", "post", "entry", "content", "story"} & words:
            return ""  # the head of the text itself
        run_together = {m[0] for n in split for m in RUN_TOGETHER.finditer(" ".join(n))}
        if not unlikely and not run_together:
            return ""
        if REMARKS & words or any("comment" in m for m in run_together):
            return "remarks"
        if unlikely | run_together <= FRAME:
            return "" if any(len(n) == 1 and n[0] in LIKELY for n in split) else "frame"
        return "other"


class Open:
    """The path of open elements: where text goes, and what is open by name, so that no tag walks the whole path."""

    def __init__(self, root: Node):
        self.at = root
        self.count: dict[str, int] = {}
        self.blocks: list[Node] = []
        self.inline: list[dict[str, int]] = [{}]  # open inline elements, since each barrier

    def enter(self, node: Node) -> None:
        self.at, tag = node, node.tag
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in BLOCK:
            self.blocks.append(node)
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
        if tag in BARRIER:
            self.inline.append({})

    def leave(self, node: Node) -> None:
        """Close node, which is open, and all in it."""
        upto = node.parent
        while self.at is not upto:
            tag = self.at.tag
            self.count[tag] -= 1
            if tag in BARRIER:
                self.inline.pop()
            if tag in BLOCK:
                self.blocks.pop()
            else:
                self.inline[-1][tag] -= 1
            self.at = self.at.parent

    def end(self, tag: str) -> bool:
        """An end tag; whether it closed something."""
        if not (self.count if tag in BLOCK else self.inline[-1]).get(tag):
            return False
        node = self.at
        while node.tag != tag:
            node = node.parent
        self.leave(node)
        return True

    def closed_by(self, tag: str) -> Node | None:
        """The open element that a start tag ends, if any. Inline elements on the way end with it."""
        stop, found = SAME_LEVEL.get(tag), None
        alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}.get(tag, (tag,))
        for node in reversed(self.blocks):
            if stop and node.tag in alike:
                found = node
                if tag != "tr" or node.tag == "tr":
                    break
            elif node.tag == "p" and tag in CLOSES_P:
                return node
            elif node.tag in (stop or ()) or node.tag not in ("p", "td", "th", "li", "dt", "dd", "tr"):
                break
        return found


def parsed(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers do for the common cases."""
    root = Node("html", None)
    path = Open(root)
    seen_body = False
    end = 0
    size = len(page)
    find = page.find
    while True:
        start = find("<", end)
        if start < 0:
            start = size
        if start > end:
            text = page[end:start]
            path.at.children.append(html.unescape(text) if "&" in text else text)
        if start >= size:
            return root
        m = TOKEN.match(page, start)
        if m is None:
            path.at.children.append("<")
            end = start + 1
            continue
        end = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if not path.end(tag) and tag in ("p", "br"):
                path.at.children.append(Node("br", path.at))
            continue
        if tag == "html" or tag == "body" and seen_body:
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, end)
            if not m[3].rstrip().endswith("/") or tag != "svg":
                end = size if close is None else (find(">", close.start()) + 1 or size)
            continue
        if path.count.get("head") and tag not in ("meta", "link", "base", "title"):
            while path.count["head"]:  # what doesn't belong there ends it
                path.end("head") or path.leave(path.at)
        if tag in CLOSES_P or tag in SAME_LEVEL:
            node = path.closed_by(tag)
            if node is not None:
                path.leave(node)
        seen_body |= tag == "body"
        node = Node(tag, path.at, m[3])
        path.at.children.append(node)
        path.at.skip |= tag in ("input", "select", "textarea") and path.at.tag == "label"
        if tag not in VOID:
            path.enter(node)


def unnamed(root: Node) -> Node:
    """The tree with skip set by names of boilerplate, except where such a name stands on what holds the content.

    That is an element with a main element inside, or with over half of the page's text outside links, remarks
    and other boilerplate: named after the page's frame, or with an article element inside. Remarks of readers never count.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.skip:
            order.append(node)
            stack += [c for c in node.children if isinstance(c, Node)]
    if not any(node.named for node in order):
        return root
    free: dict[Node, int] = {}
    holds: dict[Node, set[str]] = {}
    for node in reversed(order):
        inside = [c for c in node.children if isinstance(c, Node) and not c.skip]
        free[node] = 0 if node.tag == "a" else sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(free.pop(c) for c in inside)
        holds[node] = {node.tag} & {"article", "main"} if node.named != "remarks" else set()
        if node.named == "thread":  # a page of nothing else keeps it
            node.points = free[node]
            free[node] = 0 if not holds[node] else free[node]
        for c in inside:
            holds[node] |= holds.pop(c) if c.named != "remarks" else set()
        if node.named and node.named != "thread":
            node.points = free[node]  # until the page's total is known
            if "main" in holds[node] and node.named != "remarks":
                node.named = ""
            elif node.named == "other" and "article" in holds[node]:
                node.named = "frame"
            if node.named in ("remarks", "other"):
                free[node] = 0
    for node in order:
        if node.named == "thread":
            node.skip = free[root] >= 25
        elif node.named:
            node.skip = node.named != "frame" or 2 * node.points <= free[root]
        node.points = 0.0
    return root


def in_order(root: Node):
    """(node, whether it ends here) in document order, without what is skipped, and without recursion."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        yield node, done
        if not done:
            stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children) if isinstance(c, Node) and not skipped(c)]


def skipped(node: Node) -> bool:
    """Boilerplate; a header inside an article or main element is that of the text."""
    if node.skip:
        return True
    return node.tag == "header" and not node.within


def menu(node: Node) -> bool:
    """A list outside articles that holds little but three short links at least."""
    return node.tag in LISTS and node.within != "article" and node.links >= 3 and node.linked > 0.8 * node.chars and node.linked < 40 * node.links


def framed(parent: Node) -> set[Node]:
    """The children before which a heading or text of the same container stands, so that they belong to it."""
    out, text = set(), False
    for c in parent.children:
        if isinstance(c, str):
            text |= bool(c.strip())
        elif not skipped(c) and c.chars:
            if text:
                out.add(c)
            text = c.tag in HEADING | {"p", "blockquote", "pre"} and link_density(c) < 0.5
    return out


def scored(root: Node) -> Node:
    """The best container: characters, link characters and commas rise from each node, points from each paragraph."""
    nodes = []
    for node, done in in_order(root):
        if not done:
            continue
        own = [c for c in node.children if isinstance(c, str)]
        direct = sum(len(c.strip()) for c in own)
        node.chars += direct
        node.commas += sum(c.count(",") + c.count("，") + c.count("、") for c in own)
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        inline = node.tag not in BLOCK
        if node.tag in PARAGRAPH and (node.tag in ("p", "pre", "blockquote") or direct > 25) and node.chars - node.linked >= 25:
            points = 1 + node.commas + min(node.chars / 100, 3)
            up, level = node.parent, 1
            if node.tag in ("div", "section", "article", "main", "body", "td"):
                up = node
            while up is not None and level <= 5:
                up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
                up, level = up.parent, level + 1
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.links += node.links
            node.parent.headed |= node.headed
            if inline or node.tag in ("br",):
                node.parent.commas += node.commas
        nodes.append(node)
    best, top = None, 0.0
    for node in nodes:
        if node.points and node.tag != "html":
            bonus = TAG_POINTS.get(node.tag, 0) + 25 * bool(LIKELY & node.words and not READERS & node.words and node.named != "thread")
            node.points = (node.points + bonus) * (1 - link_density(node))
            if node.points > top:
                best, top = node, node.points
    if best is not None:
        up = best
        while up is not None and up.tag != "article":
            up = up.parent
        return up or best  # an article element holds all of its text
    for tag in ("article", "main", "body"):
        for node in nodes:
            if node.tag == tag and node.chars:
                return node
    return root


def link_density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def kept(best: Node) -> list[Node]:
    """The best container and, in page order, what belongs to the text beside it and beside the wrappers around it."""
    before, after = [], []
    node = best
    titled = titles(best)
    while node.parent is not None and node.tag not in ("main", "body"):
        sides = beside(node, best)
        titled = titled or any(map(titles, sides))
        at = node.parent.children.index(node)
        chosen = [(i, n) for i, n in enumerate(node.parent.children) if n in sides or not titled and isinstance(n, Node) and n.tag == "h1" and n.chars and not skipped(n) and link_density(n) < 0.5]
        before += [n for i, n in reversed(chosen) if i < at]  # nearest first
        after += [n for i, n in chosen if i > at]
        titled = titled or len(chosen) > len(sides)
        node = node.parent
    return [*reversed(before), best, *after]


def titles(node: Node) -> bool:
    """Whether the node is or holds an h1 (outside boilerplate)."""
    return any(n.tag == "h1" and n.chars for n, done in in_order(node) if not done)


def holds_article(node: Node) -> bool:
    return any(n.tag == "article" and n.points and link_density(n) < 0.5 for n, done in in_order(node) if not done)


def beside(node: Node, best: Node) -> set[Node]:
    """The siblings of node (the best container, or a wrapper around it) that belong to the text."""
    out = set()
    close = node is best
    least = max(10.0, 0.2 * node.points)
    for other in node.parent.children:
        if other is node or not isinstance(other, Node) or skipped(other) or not other.chars:
            continue
        dense = link_density(other)
        alike = other.tag == node.tag and other.words == node.words
        if best.tag == "article":
            wrapped = not close and dense < 0.5 and other.tag in ("div", "section", "li") and holds_article(other)
            if dense < 0.5 and (close and other.tag in ("h1", "h2", "h3") or other.tag == "article" and other.points) or wrapped:
                out.add(other)
        elif not close:
            if dense < 0.25 and other.tag in ("div", "section", "td", "tr", "table") and (alike and other.points or other.points >= least):
                out.add(other)
        elif other.points >= least or other.points and alike or not menu(other) and (dense < 0.6 and other.tag in BESIDE or dense < 0.25 and other.tag in ("section", best.tag) and other.headed):
            out.add(other)
    return out


def text_of(parts: list[Node]) -> str:
    """Blocks joined by a line break each; white space inside a block is one space."""
    blocks: list[str] = []
    now: list[str] = []
    told: dict[Node, set[Node]] = {}

    def flush() -> None:
        line = WHITE.sub(" ", "".join(now)).strip()
        if line:
            blocks.append(line)
        now.clear()

    def belongs(item: Node) -> bool:
        if item.parent not in told:
            told[item.parent] = framed(item.parent)
        return item in told[item.parent]

    for part in parts:
        stack: list[Node | str | None] = [part]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                now.append(item)
            elif item.tag == "br":
                now.append(" ")
            elif item is part or not (skipped(item) or menu(item) and not belongs(item)):
                if item.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(item.children)
        flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    """The article of a page; empty for a null, empty or text-free page."""
    if not page or page.isspace():
        return ""
    best = scored(unnamed(parsed(page)))
    if best.chars:
        return text_of(kept(best))
    if "<form" in page.lower():  # some sites wrap the whole page in one form
        root = parsed(page)
        stack = [root]
        while stack:
            node = stack.pop()
            node.skip &= node.tag != "form"
            stack += [c for c in node.children if isinstance(c, Node)]
        best = scored(unnamed(root))
    return text_of(kept(best)) if best.chars else ""


def extract_html(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars.

    A null or empty html gives an empty text and 0. Repeated pages are read each; null ids and URLs
    are carried; other columns are ignored; an empty table gives no rows. Pages of any length and
    depth are read whole. Ties between containers go to the one that ends first in the page.
    """
    prepare(pages.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(p) for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return spread(only(pages, page_id="long", url="string", html="string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
