"""Main text of web pages by tree scoring: paragraphs give points to their ancestors, the best container is kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specval.llm.text import slices

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())  # text up to the end tag, or the end of the page
UNSEEN = frozenset("noscript template iframe svg math object canvas select noframes".split())  # left out if they have an end tag
CHOICES = frozenset("option optgroup".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav footer aside form dialog button menu fieldset head option optgroup".split())
WHOLE = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl".split())
CLOSES = {"li": ("li", LISTS), "dt": ("dt dd", LISTS), "dd": ("dt dd", LISTS), "tr": ("tr td th", {"table"}), "td": ("td th", {"table", "tr"}),
          "th": ("td th", {"table", "tr"}), "option": ("option", {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that name something beside the article, and words that speak for the article.
BESIDE = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion sidebar menu nav navbar navigation
    footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share
    sharing social related recommended comment comments disqus reply replies respond breadcrumb breadcrumbs pagination pager toolbar widget hidden""".split())
NOT = frozenset("no has with without overflow".split())  # has-sidebar, no-comments, overflow-hidden: about something else
TOPS = frozenset("header masthead".split())  # an article's own, if the name says so
FOR = frozenset("article content main post entry story".split())
#: Headings of reader comments.
COMMENTS = re.compile(r"(?:\d+ )?(?:(?:reader|user|your) )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?: ?\(\d+\))?:?|"
                      r"(?:leave|post|write) a (?:reply|comment)|join the (?:discussion|conversation)", re.I)

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|[!?][^>]*+(?:>|\Z))""", re.S)
END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW | UNSEEN}
ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
COMMAS = re.compile("[,،、，]")
LEVELS = 5  # ancestors that get points
FAR_SHARE, LINKS = 0.2, 0.8


class Node:
    __slots__ = ("tag", "parent", "score", "out", "chars", "links", "order", "seen", "menu", "inside", "side")

    def __init__(self, tag: str, parent: "Node | None", out: bool, order: int):
        self.tag, self.parent, self.out, self.order = tag, parent, out, order
        self.score = 0.0
        self.chars = self.links = 0
        self.seen = self.menu = self.inside = False
        self.side = None


def beside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element by its own name and attributes doesn't belong to an article."""
    if tag in WHOLE:
        return False
    if tag in ASIDE or (tag == "header" and not in_article):
        return True
    if not attributes.strip(" /"):
        return False
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = set(re.split(r"[-_:.\d]+|(?<=[a-z])(?=[A-Z])", name))
        words = {w.lower() for w in words}
        named = words & BESIDE
        if named and not words & NOT and not (named <= TOPS and words & FOR):
            return True
    return False


def blocks_of(html: str) -> list[tuple[str, int, Node]]:
    """(text, characters in links, enclosing element) of every block of text, in page order."""
    root = Node("#root", None, False, 0)
    stack, blocks = [root], []
    parts: list[str] = []
    link_parts: list[str] = []
    links, articles, order, at, n = 0, 0, 0, 0, len(html)
    holder = root
    ends: dict[str, int] = {}  # where the next end tag of an unseen element ends, beyond the page if there is none

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append((text, len(" ".join(unescape("".join(link_parts)).split())), holder))
            parts.clear()
            link_parts.clear()

    def pop_to(k: int) -> None:
        nonlocal links, articles
        for gone in stack[k:]:
            links -= gone.tag == "a"
            articles -= gone.tag in ("article", "main")
        del stack[k:]

    def add(text: str) -> None:
        if text and not stack[-1].out:
            parts.append(text)
            if links:
                link_parts.append(text)

    while at < n:
        m = TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            k = len(stack) - 1
            while k and stack[k].tag != tag and (tag not in INLINE or stack[k].tag in INLINE):
                k -= 1
            if k and stack[k].tag == tag:
                if tag not in INLINE:
                    flush()
                pop_to(k)
                if tag not in INLINE:
                    holder = stack[-1]
            continue
        if tag in RAW:
            end = END[tag].search(html, at)
            at = end.end() if end else n
            add(" ")
            continue
        if tag in UNSEEN:
            if at > ends.get(tag, -1):
                end = END[tag].search(html, at)
                ends[tag] = n + 1 if end is None else end.end()
            if ends[tag] <= n:  # without an end tag only the tag itself is left out
                at = ends[tag]
            add(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag not in VOID:
                order += 1
                hide = stack[-1].out or (bool(m[3]) and tag != "a" and beside(tag, m[3], articles > 0))
                if tag == "a" and links:  # links don't nest
                    continue
                stack.append(Node(tag, stack[-1], hide, order))
                links += tag == "a"
            continue
        flush()
        k = len(stack) - 1
        while k and stack[k].tag in INLINE:
            k -= 1
        if k and stack[k].tag == "p":
            pop_to(k)  # a block ends an open paragraph
        if tag not in CHOICES:
            k = len(stack) - 1
            while k and stack[k].tag in INLINE:
                k -= 1
            while k and stack[k].tag in CHOICES:  # and an open choice
                pop_to(k)
                k -= 1
        if tag in CLOSES:
            same, within = CLOSES[tag]
            k = len(stack) - 1
            while k and stack[k].tag not in within and stack[k].tag not in same.split():
                k -= 1
            if k and stack[k].tag in same.split():
                pop_to(k)
        if tag not in VOID:
            order += 1
            stack.append(Node(tag, stack[-1], stack[-1].out or beside(tag, m[3], articles > 0), order))
            articles += tag in ("article", "main")
        holder = stack[-1]
        while holder.tag in INLINE:
            holder = holder.parent
    flush()
    return blocks


def _nodes(blocks: list[tuple[str, int, Node]]) -> list[Node]:
    """All elements that hold a block, parents before children."""
    found = []
    for _, _, node in blocks:
        while node is not None and not node.seen:
            node.seen = True
            found.append(node)
            node = node.parent
    return sorted(found, key=lambda node: node.order)


def main_text(html: str | None) -> str:
    """The blocks of the best container and of its good siblings, one per line."""
    blocks = blocks_of(html or "")
    nodes = _nodes(blocks)
    for text, linked, node in blocks:
        node.chars += len(text)
        node.links += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
    scored: dict[int, Node] = {}
    for text, linked, node in blocks:
        if node.tag in HEADINGS:
            continue
        points = (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)) * (1 - linked / len(text))
        top = node if node.tag not in ("p", "pre", "blockquote", "li", "td", "th", "dd", "dt") else node.parent
        for depth, up in enumerate(_ancestors(top, LEVELS)):
            up.score += points / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
            scored[up.order] = up
    if not scored:
        return "\n".join(text for text, _, _ in blocks)
    final = {k: v.score * (1 - v.links / max(v.chars, 1)) for k, v in scored.items()}
    best = scored[max(final, key=lambda k: (final[k], -k))]
    limit = FAR_SHARE * final[best.order]
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    for node in nodes:
        parent = node.parent
        node.menu = (parent is not None and parent.menu) or (node.tag in LISTS and node.links >= LINKS * node.chars)
        node.inside = node is best or (parent is not None and parent.inside)
        node.side = None if parent is None else node if parent is best.parent else parent.side
    kept = []
    remarks: tuple[Node, str] | None = None  # the container and the level of the heading of reader comments that were reached
    for text, linked, node in blocks:
        if node.tag in HEADINGS:
            if COMMENTS.fullmatch(text):
                remarks = (node.parent, node.tag) if remarks is None or not _within(node, remarks[0]) else remarks
            elif remarks is not None and node.parent is remarks[0] and node.tag <= remarks[1]:
                remarks = None
        if remarks is not None:
            if _within(node, remarks[0]):
                continue
            remarks = None
        inside = node.inside
        if not inside and best.parent is not None and (node.side is not None or node is best.parent):
            side = node.side or node
            inside = side.tag in HEADINGS or side is best.parent or (final.get(side.order, 0) >= limit > 0) or (
                side.tag == "p" and linked < 0.25 * len(text) and len(text) >= 80)
        if inside and not (node.menu and best.tag not in ("article", "main")):
            kept.append(text)
    return "\n".join(kept)


def _within(node: Node | None, top: Node) -> bool:
    while node is not None and node.order > top.order:
        node = node.parent
    return node is top


def _ancestors(node: Node | None, levels: int) -> Iterator[Node]:
    while node is not None and levels:
        yield node
        node, levels = node.parent, levels - 1


def extract(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: all but the html) and ``__text``, one row per row of ``pages``.

    A missing or empty page, and one without text, gives an empty text. Unclosed elements end where their container ends; only an unclosed script,
    style, title or textarea takes the rest of the page, as in browsers. Elements may be nested to any depth.
    """
    carry = [c for c in pages.columns if c != html_col] if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*carry, "__text"])

    schema = T.StructType([*[pages.schema[c] for c in carry], T.StructField("__text", T.StringType())])
    return pages.select(*carry, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)
