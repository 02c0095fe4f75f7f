"""Main text of web pages by composite text density.

The page is read into a tree (implied and missing end tags, void and raw-text elements, quoted attributes, comments).
Every node gets a composite text density: its characters per tag, lowered the more of its characters and tags are links
(nodes of menus and footers count too). A node's rank is the sum of its children's densities; the best-ranked node under
the body is the densest subtree, and the lowest density on its path to the body is the threshold. Then every element off
that path is judged:

- what HTML or ARIA itself says is no article goes: navigation, page headers, footers, asides, controls, media (a button
  among the words of a paragraph stays, as do formulas);
- an element whose class or id names what stands around a text, or a form, is under suspicion: it has to show prose. Half its
  density, weighed by the characters that show it, must reach half of what a passage of PROSE characters in plain paragraphs
  would have, and a quarter of the threshold; so short boxes go, and long passages stay whatever they are called. Of an element named as an
  advert, notice, menu, sidebar or reader comments, which the main text is without, a small part of the density counts. If
  the name has other words too, half the density must reach the threshold; inside the densest subtree a paragraph, heading, item
  or the like is not suspected, nor is an element whose name has other words;
- outside the densest subtree, elements that are mostly links and below the threshold go, headings excepted.

A name is not believed if less than a tenth of what it names would be left as the text. All else stays, short blocks, headings and loose text included. Article and main elements get no preference; only a
header inside one, or inside a section, counts as theirs and not the page's, as HTML defines it.

Text is given block by block in page order: character references decoded, white space inside a block one space,
trimmed, blocks joined by one newline. ``br`` counts as white space.

Defined results: null, empty and text-free pages give the empty text; markup without any tags is one block; a page is
never cut; null ids and urls are passed through; repeated rows are extracted one by one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.common import slices

# Element and attribute names with a meaning in HTML or by convention.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes head nav footer aside button select option datalist dialog menu template noscript object applet canvas svg audio video map".split())
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "thead": ("tr", "td", "th")}
#: An implied end does not reach beyond these.
SCOPE = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), **{t: frozenset(("table",)) for t in ("tr", "td", "th", "tbody", "tfoot", "thead")}, "option": frozenset(("select", "datalist")), "p": frozenset(("td", "th", "table", "button", "object", "caption"))}
#: Names of what the main text is without: adverts, notices, menus, sidebars, footers, reader comments.
LISTED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond disqus replies reply".split())
#: Names of what often stands around it.
AROUND_NAMES = frozenset("newsletter subscribe subscription signup share sharing social related widget toolbar pagination pager skip login search".split())
BOILERPLATE_NAMES = LISTED_NAMES | AROUND_NAMES
#: These name boilerplate only outside the densest subtree.
PAGE_NAMES = frozenset("header topbar masthead banner".split())
#: Words of a name that say nothing by themselves.
NEUTRAL_NAMES = frozenset("a and area article bar bottom box button buttons card container content div el entry for global group id in inner item items layout left link links list main of outer page panel post primary right row secondary section site slot the top unit user view with wrap wrapper".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alertdialog dialog menu menubar toolbar".split())
SECTIONS = frozenset(("article", "main", "section"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are text rather than containers of it.
TEXTUAL = HEADINGS | frozenset("p li dt dd pre blockquote td th tr caption figcaption address summary legend".split())
#: What a name leaves of an element's density: one of those listed, one around a text (both put the element under
#: suspicion), and one that has other words too, which is a little more to be told from them.
LISTED, NAMED, PARTLY_NAMED = 0.02, 0.5, 0.501
#: Characters of a passage and of its paragraphs, and those at which half of a density counts as shown.
PROSE, PARAGRAPH, SHOWN = 300, 100, 200

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    """dropped: no part of the text; names: what its class and id leave of the density, inside and outside the densest
    subtree."""

    __slots__ = ("tag", "children", "dropped", "names", "chars", "links", "tags", "link_tags", "density", "rank", "loose")

    def __init__(self, tag: str, dropped: bool = False, names: tuple[float, float] = (1.0, 1.0)):
        self.tag, self.dropped, self.names = tag, dropped, names
        self.children: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.rank = 0.0
        self.loose = False

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]


def _judged(tag: str, attributes: str, in_section: bool) -> tuple[bool, tuple[float, float]]:
    """Is an element dropped for what it is; what its names leave of its density, inside and outside."""
    if tag in DROPPED or (tag == "header" and not in_section):
        return True, (1.0, 1.0)
    inside = outside = NAMED if tag == "form" else 1.0
    if attributes and tag not in ("html", "body"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if name.lower() == "role":
                if value in BOILERPLATE_ROLES:
                    return True, (1.0, 1.0)
                continue
            for each in value.split():
                words = set(_NAME.findall(each)) - NEUTRAL_NAMES
                if words & (BOILERPLATE_NAMES | PAGE_NAMES):
                    left = LISTED if words & (LISTED_NAMES | PAGE_NAMES) else NAMED
                    inside = min(inside, left if words <= BOILERPLATE_NAMES and tag not in TEXTUAL else 1.0)
                    outside = min(outside, left if words <= BOILERPLATE_NAMES | PAGE_NAMES and tag not in HEADINGS else PARTLY_NAMED)
    return False, (inside, outside)


def parse(html: str) -> Node:
    """The tree of a page, without the text of scripts and the like."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    open_tags: Counter[str] = Counter()  # so that the stack is searched only for what is on it

    def close(i: int) -> None:
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]

    last = html.rfind(">")
    while at < n:
        m = _TAG.search(html, at) if at <= last else None  # what follows the last tag is text
        text = html[at : m.start()] if m else html[at:]
        if text:
            stack[-1].children.append(text)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if open_tags[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        ends = ("p",) if tag in CLOSES_P else ()
        for names, scope in ((ends, SCOPE["p"]), (IMPLIED_END.get(tag, ()), SCOPE.get(tag, frozenset()))):
            cut = None
            if not any(open_tags[t] for t in names):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    cut = i
                    if names == ("p",) or tag in ("li", "option"):
                        break
                elif stack[i].tag in scope:
                    break
            if cut is not None:
                close(cut)
        up = stack[-1]
        dropped, names = _judged(tag, attributes, any(open_tags[t] for t in SECTIONS))
        if tag == "button" and up.tag in TEXTUAL and any(isinstance(c, str) and not c.isspace() for c in up.children):
            dropped = False  # one of the words
        node = Node(tag, dropped or up.dropped, names)
        up.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            at = end.end()
        elif tag not in VOID:
            stack.append(node)
            open_tags[tag] += 1
    return root


def _postorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(node.elements())
    return out[::-1]


def measure(root: Node) -> list[Node]:
    """Fill in densities and ranks; the nodes, children before parents."""
    nodes = _postorder(root)
    for x in nodes:
        for c in x.children:
            if isinstance(c, str):
                n = len("".join(c.split())) if "&" not in c else len("".join(unescape(c).split()))
                x.chars += n
                x.loose = x.loose or n > 0
            else:
                x.chars += c.chars
                x.links += c.links
                x.tags += c.tags + 1
                x.link_tags += c.link_tags + (c.tag == "a")
        if x.tag == "a":
            x.links = x.chars
    of_body = root.links / max(1, root.chars)
    for x in nodes:
        if x.chars:
            ratio = x.chars / max(1, x.links) * max(1, x.tags) / max(1, x.link_tags)
            base = math.log(x.chars / max(1, x.chars - x.links) * x.links + of_body * x.chars + math.e)
            # a page without links has base 1 everywhere; the natural logarithm keeps the order of its densities
            x.density = x.chars / max(1, x.tags) * math.log(max(ratio, 1.0)) / (math.log(base) if base > 1 else 1.0)
        x.rank = sum(c.density * c.names[1] for c in x.elements() if not c.dropped)
    return nodes


def densest(body: Node) -> tuple[Node, set[int], float]:
    """The best-ranked node, the ids of the nodes from it up to the body, and the lowest density among them."""
    best, most, up = body, 0.0, {}
    todo = [(body, 1.0)]
    while todo:
        x, left = todo.pop()
        if x.rank * left > most:
            best, most = x, x.rank * left
        for c in reversed(x.elements()):
            up[id(c)] = x
            if not c.dropped:
                todo.append((c, left * c.names[1]))
    path, threshold, x = {id(best)}, best.density, best
    while x is not body:
        x = up[id(x)]
        path.add(id(x))
        threshold = min(threshold, x.density)
    return best, path, threshold


def content(root: Node) -> Node:
    """The body, with all elements dropped that are no part of the main text."""
    nodes = measure(root)
    body = next((x for x in nodes if x.tag == "body" and not x.dropped), root)
    while True:
        gone = _drop(body)
        named = [x for x in gone if min(x.names) < 1]
        largest = max(named, key=lambda x: x.chars, default=None)
        if largest is None or 10 * _visible(body) >= largest.chars:
            return body
        largest.names = (1.0, 1.0)
        for x in gone:
            x.dropped = False
        for x in nodes:
            x.rank = sum(c.density * c.names[1] for c in x.elements() if not c.dropped)


def _visible(body: Node) -> int:
    """Characters of what is not dropped."""
    total, todo = body.chars, [body]
    while todo:
        for c in todo.pop().elements():
            if c.dropped:
                total -= c.chars
            else:
                todo.append(c)
    return total


def shown(density: float, chars: int) -> float:
    """A density weighed by the characters that show it."""
    return density * chars / (chars + SHOWN)


def passage_density(chars: int, of_body: float) -> float:
    """The density of plain paragraphs without links, where so large a part of the body's characters are links."""
    tags, base = chars / PARAGRAPH, math.log(of_body * chars + math.e)
    return chars / tags * math.log(chars * tags) / (math.log(base) if base > 1 else 1.0)


def _drop(body: Node) -> list[Node]:
    """Drops the elements under the body that are no part of the main text, and returns them."""
    best, path, threshold = densest(body)
    prose = max(threshold / 4, shown(passage_density(PROSE, body.links / max(1, body.chars)), PROSE) / 2)
    gone, todo = [], [(body, best is not body)]
    while todo:
        x, outside = todo.pop()
        menus = outside or x is body
        inherited = x.names[1] if outside and id(x) in path else 1.0  # the name of a wrapper is about what is beside the path
        for c in x.elements():
            if c.dropped:
                continue
            if id(c) in path:
                todo.append((c, outside and c is not best))
                continue
            part_of_text, heading = x.loose and c.tag not in BLOCK, c.tag in HEADINGS
            left = c.names[1 if menus else 0] * (1.0 if heading else inherited)
            suspect = left <= NAMED
            weak = left < 1 and (shown(c.density, c.chars) * left < prose if suspect else c.density * left < threshold)
            menu = menus and not heading and 2 * c.links > c.chars and c.density < threshold and (c.loose or not c.elements())
            if not part_of_text and (weak or menu):
                c.dropped = True
                gone.append(c)
            elif not (menus and (part_of_text or heading)):
                todo.append((c, menus))
    return gone


def blocks(top: Node) -> list[str]:
    """The texts of the blocks of a subtree in page order."""
    out, run = [], []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.dropped:
            if x.tag == "br":
                run.append(" ")
            elif x.tag in BLOCK:
                flush()
                todo.append(None)
                todo.extend(reversed(x.children))
            else:
                todo.extend(reversed(x.children))
        elif x.tag in BLOCK:
            flush()
    flush()
    return out


def main_text(html: str | None) -> str:
    return "\n".join(blocks(content(parse(html)))) if html else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
