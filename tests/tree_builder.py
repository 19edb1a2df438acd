"""A plain tree builder on the standard parser, which the page operators are compared with.

The builder implies what browsers do for the elements used here: ``p`` ends at block starts, ``li``, ``dt``/``dd``, table
parts and options end their like, void elements hold nothing, ``script`` and ``style`` hold raw text, and the end of input closes all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from folio.functions.text import WHITE_SPACE

# Element names by behaviour.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
FENCE = {"ul", "ol", "dl", "table", "select", "body", "html", "td", "th", "button", "caption", "object", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"p", "ul", "ol", "blockquote", *HEADINGS}
NO_DESCRIPTION = "No description available"


class Node:
    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.kids = name, attrs, []

    def walk(self) -> Iterator[Node]:
        """Elements below this one in document order."""
        stack = list(reversed(self.kids))
        while stack:
            kid = stack.pop()
            if isinstance(kid, Node):
                yield kid
                stack.extend(reversed(kid.kids))

    def text(self) -> str:
        out, stack = [], list(reversed(self.kids))
        while stack:
            kid = stack.pop()
            if isinstance(kid, str):
                out.append(kid)
            else:
                stack.extend(reversed(kid.kids))
        return "".join(out)

    def find(self, test) -> Node | None:
        return next((x for x in self.walk() if test(x)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {})
        self.open = [self.root]

    def _close(self, names: set[str], fence: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                del self.open[i:]
                return
            if self.open[i].name in fence:
                return

    def _body(self, tag: str) -> None:
        """Content outside head or body opens a body."""
        names = [n.name for n in self.open]
        if tag not in {"html", "head", "body", "title", "meta", "link", "script", "style", "base", "noscript", "template"} and "body" not in names:
            while self.open[-1].name not in {"html", "#document"}:
                self.open.pop()
            self._push("body", {})

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.open[-1].kids.append(node)
        self.open.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in reversed(attrs)}
        if tag in {"html", "head", "body"}:
            if any(n.name == tag for n in self.open):
                return
            if tag == "body":
                self._close({"head"}, set())
        self._body(tag)
        if tag in CLOSES_P:
            self._close({"p"}, FENCE - {"body", "html"} | {"body"})
        if tag in LIKE:
            for _ in range(3):
                before = len(self.open)
                self._close(LIKE[tag], {"ul", "ol"} if tag == "li" else FENCE - {"td", "th"})
                if len(self.open) == before:
                    break
        if tag in HEADINGS and self.open[-1].name in HEADINGS:
            self.open.pop()
        self._push(tag, own)
        if tag in VOID:
            self.open.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID or tag in {"html", "body"}:
            return
        if tag == "p" and not any(n.name == "p" for n in self.open):
            self._body("p")
            self._push("p", {})
        names = HEADINGS if tag in HEADINGS else {tag}
        self._close(names, {"table", "td", "th"} if tag not in {"table", "td", "th", "tr", "tbody"} else set())

    def handle_data(self, data):
        if data.strip(WHITE_SPACE) and self.open[-1].name in {"html", "#document", "head"}:
            self._body("#text")
        if self.open[-1] is not self.root or data.strip(WHITE_SPACE):
            self.open[-1].kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def title_of(doc: Node) -> str:
    for name in ("title", "h1"):
        node = doc.find(lambda x, name=name: x.name == name)
        if node is not None and (text := node.text().strip(WHITE_SPACE)):
            return text
    return ""


def description_of(doc: Node) -> str:
    for key, name in (("name", "description"), ("property", "og:description"), ("name", "twitter:description")):
        node = doc.find(lambda x, key=key, name=name: x.name == "meta" and x.attrs.get(key) == name)
        if node is not None and (text := node.attrs.get("content", "")):
            return text.strip(WHITE_SPACE)
    node = doc.find(lambda x: x.name == "p")
    text = node.text() if node is not None else ""
    if not text:
        return NO_DESCRIPTION
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) > 200:
        text = raw[:197].decode("utf-8", "replace") + "..."
    return text.strip(WHITE_SPACE)


def _is_main(x: Node) -> bool:
    classes = re.split(r"[ \t\n\f\r]+", x.attrs.get("class", ""))
    return x.name in {"article", "main"} or x.attrs.get("id") == "content" or "content" in classes or "post-content" in classes


def content_of(doc: Node, limit: int = 10_000) -> str:
    main = doc.find(_is_main) or doc.find(lambda x: x.name == "body")
    out = []
    for x in main.walk() if main is not None else ():
        text = x.text().strip(WHITE_SPACE) if x.name in BLOCKS else ""
        if not text:
            continue
        if x.name in HEADINGS:
            out.append("#" * int(x.name[1]) + f" {text}\n\n")
        elif x.name == "p":
            out.append(f"{text}\n\n")
        elif x.name == "blockquote":
            out.append(f"> {text}\n\n")
        else:
            for n, li in enumerate((y for y in x.walk() if y.name == "li"), 1):
                if item := li.text().strip(WHITE_SPACE):
                    out.append(f"- {item}\n" if x.name == "ul" else f"{n}. {item}\n")
            out.append("\n")
    raw = "".join(out).encode("utf-8", "surrogatepass")
    if len(raw) > limit:
        end = raw[:limit].rfind(b"\n\n")
        raw = raw[: end if end >= 0 else limit] + b"\n\n... (content truncated)"
    return raw.decode("utf-8", "replace")
