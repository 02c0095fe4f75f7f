"""HTML pages to Markdown on the standard library's parser, for use inside vectorised functions."""

from __future__ import annotations

import re
from collections.abc import Generator
from html.parser import HTMLParser
from urllib.parse import urljoin

# What HTML says about its elements, and the default places of the body.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"))
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
DEFAULT_SELECTORS = ('[role="main"]', "main", "article", "#content")


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def walk(self):
        """Elements in document order, this one first."""
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(c for c in reversed(x.children) if not isinstance(c, str))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in SILENT:
                todo.extend(reversed(x.children))
        return "".join(out)


class _Tree(HTMLParser):
    """Builds the tree; open paragraphs, list items and cells end where HTML lets them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.stack = [self.root]

    def _end(self, tags: tuple[str, ...], fences: tuple[str, ...] = ()) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in fences:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end(("p",), ("td", "th", "button"))
        if tag in SIBLINGS:
            self._end(SIBLINGS[tag], FENCES[tag])
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(element)
        if tag not in VOID:
            self.stack.append(element)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._end((tag,))

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Element:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


_SELECTOR = re.compile(r"(?P<tag>[a-zA-Z][\w-]*)?(?:#(?P<id>[\w-]+))?(?P<classes>(?:\.[\w-]+)*)(?:\[(?P<name>[\w-]+)(?:=[\"']?(?P<value>[^\"'\]]*)[\"']?)?\])?$")


def matches(element: Element, selector: str) -> bool:
    """Simple selectors: tag, #id, .class, [attribute="value"] and what these make up together."""
    m = _SELECTOR.match(selector.strip())
    if not m or element.tag == "#root":
        return False
    a = element.attributes
    return (
        (not m["tag"] or element.tag == m["tag"].lower())
        and (not m["id"] or a.get("id") == m["id"])
        and set(filter(None, m["classes"].split("."))) <= set(a.get("class", "").split())
        and (not m["name"] or (m["name"] in a and (m["value"] is None or a[m["name"]] == m["value"])))
    )


def body_of(root: Element, selectors: tuple[str, ...] = ()) -> Element:
    """The first element of the first selector that matches; else the body, else everything."""
    for s in selectors or DEFAULT_SELECTORS:
        for x in root.walk():
            if matches(x, s):
                return x
    return next((x for x in root.walk() if x.tag == "body"), root)


def links_of(html: str, base_url: str) -> list[str]:
    """Targets of all links of the page as absolute URLs, in page order."""
    return [_join(base_url, x.attributes["href"]) for x in parse(html).walk() if x.tag == "a" and "href" in x.attributes]


def _join(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def title_of(root: Element) -> str:
    h1 = next((x for x in root.walk() if x.tag == "h1"), None)
    return "".join(part.strip() for part in _strings(h1)) if h1 else "Untitled"


def _strings(element: Element) -> list[str]:
    out, todo = [], [element]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x.children))
    return out


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text)


#: Blocks that Markdown has a form for.
OWN_FORM = frozenset("h1 h2 h3 h4 h5 h6 pre hr ul ol blockquote table".split())


def _finished(task: Generator):
    """What a task returns, whose parts are tasks that it yields: a stack of its own, so that depth is no matter."""
    stack, value = [task], None
    while stack:
        try:
            part = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(part)
            value = None
    return value


class _Writer:
    """Markdown of a tree. Blocks are separated by blank lines; white space in running text is squeezed. inline, blocks
    and block are tasks for _finished."""

    def __init__(self, base_url: str, root: Element):
        self.base = base_url
        #: Elements with a block below them.
        self.holding: set[int] = set()
        every = list(root.walk())
        for x in reversed(every):  # parents come before their children
            if any(not isinstance(c, str) and (c.tag in BLOCKS or id(c) in self.holding) for c in x.children):
                self.holding.add(id(x))

    def inline(self, node: Element) -> Generator:
        if node.tag in SILENT:
            return ""
        if node.tag == "br":
            return "  \n"
        if node.tag == "img":
            return f"![{node.attributes.get('alt', '')}]({_join(self.base, node.attributes['src'])})" if "src" in node.attributes else ""
        if node.tag in ("code", "kbd", "samp", "tt"):
            code = node.text()
            return f"`` {code} ``" if "`" in code else f"`{code}`" if code.strip() else ""
        inner = yield self.line(node)
        core = inner.strip()
        if not core:
            return " " if inner else ""
        lead, trail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        if node.tag == "a" and "href" in node.attributes:
            return f"{lead}[{core}]({_join(self.base, node.attributes['href'])}){trail}"
        if node.tag in ("b", "strong"):
            return f"{lead}**{core}**{trail}"
        if node.tag in ("i", "em"):
            return f"{lead}*{core}*{trail}"
        return inner

    def line(self, node: Element) -> Generator:
        """The children of a node as running text."""
        parts = []
        for c in node.children:
            parts.append(_squeezed(c) if isinstance(c, str) else (yield self.inline(c)))
        return "".join(parts)

    def blocks(self, node: Element) -> Generator:
        out, run = [], []

        def flush():
            text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(run).replace("  \n", "\v")).replace("\v", "  \n")
            run.clear()
            text = re.sub(r"(?<! ) {2,}(?!\n)", " ", text).strip()
            if text:
                out.append(text)

        todo: list[Element | str | None] = list(reversed(node.children))
        while todo:  # plain containers are walked here, however deep they are nested; None ends one
            c = todo.pop()
            if c is None:
                flush()
            elif isinstance(c, str):
                run.append(_squeezed(c))
            elif c.tag not in BLOCKS and id(c) not in self.holding:
                run.append((yield self.inline(c)))
            else:
                flush()
                if c.tag in OWN_FORM:
                    out.extend((yield self.block(c)))
                elif c.tag not in SILENT:
                    todo.append(None)
                    todo.extend(reversed(c.children))
        flush()
        return out

    def block(self, x: Element) -> Generator:
        tag = x.tag
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            text = " ".join((yield self.line(x)).split())
            return [f"{'#' * int(tag[1])} {text}"] if text else []
        if tag == "pre":
            code = x.text().strip("\n")
            language = next((c.removeprefix("language-") for y in x.walk() for c in y.attributes.get("class", "").split() if c.startswith("language-")), "")
            fence = "```" if "```" not in code else "~~~"
            return [f"{fence}{language}\n{code}\n{fence}"]
        if tag == "hr":
            return ["---"]
        if tag in ("ul", "ol"):
            lines, number = [], 0
            for c in x.children:
                if isinstance(c, str):
                    continue
                number += c.tag == "li"
                mark = f"{number}. " if tag == "ol" else "* "
                inner = yield self.blocks(c) if c.tag == "li" else self.block(c)
                if inner:
                    tight = "\n".join(inner) if not any("\n\n" in i or i.startswith("```") for i in inner) else "\n\n".join(inner)
                    lines.append(mark + tight.replace("\n", "\n" + " " * len(mark)))
            return ["\n".join(lines)] if lines else []
        if tag == "blockquote":
            inner = "\n\n".join((yield self.blocks(x)))
            return ["> " + inner.replace("\n", "\n> ")] if inner else []
        if tag == "table":
            rows = []
            for r in x.walk():
                cells = [c for c in r.children if not isinstance(c, str) and c.tag in ("td", "th")] if r.tag == "tr" else []
                row = []
                for c in cells:
                    row.append(" ".join((yield self.line(c)).split()).replace("|", "\\|"))
                if row:
                    rows.append(row)
            if not rows:
                return (yield self.blocks(x))
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            return ["\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])]
        return (yield self.blocks(x))


def to_markdown(root: Element, base_url: str) -> str:
    """Markdown with absolute links, without front matter."""
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(_finished(_Writer(base_url, root).block(root)))).strip() + "\n"
