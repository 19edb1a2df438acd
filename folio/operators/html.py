"""Titles, descriptions and main content of web pages, from an index over the bytes of a whole Arrow batch.

Where tags, comments and quotes begin and end is found for all pages of a batch at once, by comparisons over its bytes; the names of all tags become numbers in
one go.  A pass over a page's tags then keeps the open elements as a stack of numbers and writes down, for each element, which stretch of the page's text it
holds and where its descendants end.  Everything that is read off (a title, a description, a list and its items) is a range of these arrays; there is no
tree, and text is decoded only where it is asked for.

Tags end as HTML5 says, with ``>`` in quoted values kept apart; ``title`` and ``textarea`` hold text, ``script``, ``style`` and their like raw text, to their end tags.  Of the rules by which
browsers build trees these are kept: ``p`` ends at block starts, ``li``, ``dt``/``dd``, table parts and options end their like, void elements hold nothing, content outside
head and body opens a body, and the end of input closes all.

Defined cases: a null page gives nulls; an empty page has an empty title, the standing text for no description and empty content; of several equal elements the first in the page
counts; an unfinished tag or comment takes the rest of the page with it; repeated pages are read one by one; pages of any length are read whole.  Character references are
read as browsers do, some of them without their semicolon (``&amp`` at the end of a title that was cut); with ``closed`` only those with one count, as in XML, and others stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import WHITE_SPACE

# Element names by behaviour.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
FENCE = {"ul", "ol", "dl", "table", "select", "body", "html", "td", "th", "button", "caption", "object", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"p", "ul", "ol", "blockquote", *HEADINGS}
OUTSIDE_BODY = {"html", "head", "body", "title", "meta", "link", "script", "style", "base", "noscript", "template"}
#: Elements that hold text up to their end tag, whatever looks like a tag in it; in the first two, character references count.
TEXT_ONLY = ("title", "textarea", "script", "style", "xmp", "iframe", "noembed", "noframes")
NO_DESCRIPTION = "No description available"
#: Tags up to this length (such as ``<a id=content``) have no attribute that marks main content.
_SHORTEST = 12
#: Bytes of pages looked at at once.
PIECE = 4 << 20

_KNOWN = sorted(VOID | CLOSES_P | set(LIKE) | {x for v in LIKE.values() for x in v} | FENCE | HEADINGS | BLOCKS | OUTSIDE_BODY | set(TEXT_ONLY))
_CODE = {name: i for i, name in enumerate(_KNOWN)}
_of = lambda names: frozenset(_CODE[n] for n in names)
_HTML, _HEAD, _BODY, _P, _LI, _META, _TITLE, _H1, _UL, _OL, _QUOTE = (_CODE[n] for n in "html head body p li meta title h1 ul ol blockquote".split())
_VOID, _CLOSES_P, _HEADINGS, _BLOCKS, _OUTSIDE = _of(VOID), _of(CLOSES_P), _of(HEADINGS), _of(BLOCKS), _of(OUTSIDE_BODY)
_MAIN, _OF_P, _OF_HEAD = _of({"article", "main"}), _of({"p"}), _of({"head"})
_P_FENCE, _NONE, _CELLS = _of(FENCE - {"html"}), frozenset(), _of({"table", "td", "th"})
#: What an element ends when it starts, and what that doesn't reach through.
_ENDS_LIKE = {_CODE[n]: (_of(names), _of({"ul", "ol"} if n == "li" else FENCE - {"td", "th"})) for n, names in LIKE.items()}
_THROUGH_CELLS = _of({"table", "td", "th", "tr", "tbody"})
_TEXT_END = {_CODE[n]: re.compile(rb"</%s(?=[\t\n\f\r />])" % n.encode(), re.I) for n in TEXT_ONLY}
_DECODED = _of(TEXT_ONLY[:2])

_ATTRIBUTE = rb"""(=?[^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"([^"]*+)"|'([^']*+)'|([^"'\t\n\f\r >][^\t\n\f\r >]*+)|(?=>)))?+"""
_NAME = rb"[a-zA-Z][^\t\n\f\r />]*+"
_TAG = re.compile(rb"</?(" + _NAME + rb")(?:[\t\n\f\r /]++|(?=[^>\t\n\f\r /])" + _ATTRIBUTE + rb")*+>")
_ATTRIBUTES = re.compile(rb"[\t\n\f\r /]*+(?=[^>\t\n\f\r /])" + _ATTRIBUTE)
_HEAD_OF_TAG = re.compile(rb"</?" + _NAME)

_LETTER, _FOLD, _STOP = np.zeros(256, bool), np.arange(256, dtype=np.uint8), np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_STOP[list(b"\t\n\f\r />")] = True
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
#: Bytes of a name that are compared as one value; longer names are looked at by themselves.
WIDTH = 12
MARKUP, START, END = 0, 1, 2


def unescape_closed(text: str) -> str:
    """Character references that end with a semicolon as what they stand for; names that are none stay."""
    return _CLOSED.sub(lambda m: unescape(m.group()) if m.group()[1] == "#" else html5.get(m.group()[1:], m.group()), text)


def _next(at: np.ndarray, places: np.ndarray, none: int) -> np.ndarray:
    """The first of ``places`` at or after each position, ``none`` where there is none."""
    return np.append(places, none)[np.searchsorted(places, at)]


class Index:
    """Tags of all pages of a batch: where they are, what they are called, where they end (-1: nowhere)."""

    def __init__(self, pages: pa.Array, closed: bool = False):
        self.unescape = unescape_closed if closed else unescape
        pages = pages.cast(pa.large_string())
        offsets = np.frombuffer(pages.buffers()[1], np.int64)[pages.offset : pages.offset + len(pages) + 1]
        held = pages.buffers()[2]
        self.bytes = held.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if held else b""  # a slice shares the bytes of its whole batch
        self.offsets = offsets - offsets[0]
        raw = np.frombuffer(self.bytes + b"\0\0\0", np.uint8)
        n = len(self.bytes)
        lt, gt = np.flatnonzero(raw == ord("<")), np.flatnonzero(raw == ord(">"))
        after, second = raw[lt + 1], raw[lt + 2]
        kind = np.select([_LETTER[after], (after == ord("/")) & _LETTER[second], (after == ord("/")) | (after == ord("!")) | (after == ord("?"))], [START, END, MARKUP], -1)
        stops = self.offsets[np.searchsorted(self.offsets, lt, side="right")]
        found = (kind >= 0) & (lt + 1 < stops) & ((after != ord("/")) | (lt + 2 < stops))
        lt, kind, stops = lt[found], kind[found], stops[found]
        close = _next(lt, gt, n)
        ends = close + 1
        self._quoted(raw, lt, close, np.flatnonzero(kind != MARKUP), stops, ends)
        self._comments(raw, gt, lt, np.flatnonzero((kind == MARKUP) & (raw[lt + 1] == ord("!")) & (raw[lt + 2] == ord("-")) & (raw[np.minimum(lt + 3, n)] == ord("-"))), ends)
        ends[ends > stops] = -1
        self.lt, self.ends, self.kind = lt.tolist(), ends.tolist(), kind.tolist()
        self._named(raw, lt, kind)
        self.pages = np.searchsorted(lt, self.offsets).tolist()

    def _quoted(self, raw, lt, close, tags, stops, ends) -> None:
        """Ends of tags with quotes: as they are where one plain value is quoted, else by the grammar of attributes."""
        quotes = np.flatnonzero((raw == ord('"')) | (raw == ord("'")))
        first = np.searchsorted(quotes, lt[tags])
        some = np.searchsorted(quotes, close[tags]) > first
        tags, first = tags[some], first[some]
        a, b = quotes[first], np.append(quotes, 0)[first + 1]
        equals = np.flatnonzero(raw == ord("="))
        plain = (np.searchsorted(quotes, close[tags]) - first == 2) & (raw[a - 1] == ord("=")) & (raw[a] == raw[b]) & (np.searchsorted(equals, a) - np.searchsorted(equals, lt[tags]) == 1)
        for i in tags[~plain].tolist():
            found = _TAG.match(self.bytes, int(lt[i]), int(stops[i]))
            ends[i] = found.end() if found else len(self.bytes) + 1

    def _comments(self, raw, gt, lt, comments, ends) -> None:
        """Comments end at ``-->``, which may share its dashes with the beginning, or at ``--!>``."""
        n = len(raw) - 3
        dashed = gt[(gt >= 4) & (raw[gt - 1] == ord("-")) & (raw[gt - 2] == ord("-"))]
        bang = gt[(gt >= 7) & (raw[gt - 1] == ord("!")) & (raw[gt - 2] == ord("-")) & (raw[gt - 3] == ord("-"))]
        ends[comments] = np.minimum(_next(lt[comments] + 4, dashed, n), _next(lt[comments] + 7, bang, n)) + 1

    def _named(self, raw, lt, kind) -> None:
        """Numbers of the names: fixed ones for known elements, others as they come."""
        at = lt + kind  # one or two bytes on; markup has no name
        block = raw[np.minimum(at[:, None] + np.arange(WIDTH + 1), len(raw) - 1)]
        ended = np.logical_or.accumulate(_STOP[block], axis=1)
        keys = np.where(ended[:, :WIDTH], 0, _FOLD[block[:, :WIDTH]]).astype(np.uint8)
        names, where = np.unique(np.ascontiguousarray(keys).view(f"S{WIDTH}").ravel(), return_inverse=True)
        codes = dict(_CODE)
        number = lambda name: codes.setdefault(name, len(codes))
        code = np.array([number(x.decode("latin-1")) for x in names] or [0])[where]
        for i in np.flatnonzero(~ended[:, -1] & (kind != MARKUP)).tolist():
            code[i] = number(_HEAD_OF_TAG.match(self.bytes, int(lt[i])).group().lstrip(b"</").lower().decode("latin-1"))
        self.code, self.n_codes = code.tolist(), len(codes)

    def __iter__(self) -> Iterator[Page]:
        return (Page(self, i) for i in range(len(self.offsets) - 1))


def _pieces(pages: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``PIECE`` bytes; a longer page is one of its own."""
    sizes = np.cumsum(pc.binary_length(pages).fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(sizes // PIECE, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(pages)], strict=True):
        yield pages.slice(a, b - a)


class Page:
    """Elements of a page in document order: ``code``, the stretches of text ``first`` to ``last`` that they hold, ``below`` (where their descendants end), ``tag``."""

    def __init__(self, index: Index, page: int):
        self.raw, self.ends, self.lt, self.unescape = index.bytes, index.ends, index.lt, index.unescape
        self.code, self.first, self.last, self.below, self.tag = [], [], [], [], []
        self.texts: list = []  # (start, end, whether character references count), or the decoded text
        self._read(index, page)

    def _read(self, index: Index, page: int) -> None:
        """One pass over the page's tags."""
        raw, lt, ends, kinds, names = index.bytes, index.lt, index.ends, index.kind, index.code
        code, first, last, below, tag, texts = self.code, self.first, self.last, self.below, self.tag, self.texts
        stack: list[int] = []  # numbers of the open elements
        top: list[int] = []  # their codes
        held = [0] * index.n_codes  # how many are open of each code
        body = False

        def push(c: int, t: int) -> None:
            held[c] += 1
            stack.append(len(code))
            top.append(c)
            code.append(c)
            first.append(len(texts))
            last.append(0)
            below.append(0)
            tag.append(t)

        def pop() -> None:
            held[top.pop()] -= 1
            i = stack.pop()
            last[i], below[i] = len(texts), len(code)

        def close(these, fence) -> bool:
            """End the innermost of ``these`` that no ``fence`` covers."""
            for i in range(len(top) - 1, -1, -1):
                if top[i] in these:
                    while len(top) > i:
                        pop()
                    return True
                if top[i] in fence:
                    return False
            return False

        def into_body() -> None:
            nonlocal body
            while top and top[-1] != _HTML:
                pop()
            push(_BODY, -1)
            body = True

        def data(a: int, b: int, references: bool) -> None:
            if not top or (not body and top[-1] in (_HTML, _HEAD)):
                text = self._decoded(a, b, references)
                if text.strip(WHITE_SPACE):
                    if not body:
                        into_body()
                elif not top:
                    return
                texts.append(text)
            else:
                texts.append((a, b, references))

        at, stop = int(index.offsets[page]), int(index.offsets[page + 1])
        for t in range(index.pages[page], index.pages[page + 1]):
            if lt[t] < at:
                continue
            if lt[t] > at:
                data(at, lt[t], True)
            at = ends[t]
            if at < 0:
                at = stop
                break
            c = names[t]
            if kinds[t] == START:
                if c in (_HTML, _HEAD, _BODY):
                    if held[c]:
                        continue
                    if c == _BODY:
                        if held[_HEAD]:
                            close(_OF_HEAD, _NONE)
                        body = True
                elif not body and c not in _OUTSIDE:
                    into_body()
                if c in _CLOSES_P and held[_P]:
                    close(_OF_P, _P_FENCE)
                if c in _ENDS_LIKE:
                    these, fence = _ENDS_LIKE[c]
                    for _ in range(3):
                        if not any(held[x] for x in these) or not close(these, fence):
                            break
                if c in _HEADINGS and top and top[-1] in _HEADINGS:
                    pop()
                push(c, t)
                if c in _VOID:
                    pop()
                elif c in _TEXT_END:
                    found = _TEXT_END[c].search(raw, at, stop)
                    end = found.start() if found else stop
                    if end > at:
                        data(at, end, c in _DECODED)
                    at = end
            elif kinds[t] == END and c not in _VOID and c != _HTML and c != _BODY:
                if c == _P and not held[_P]:
                    if not body:
                        into_body()
                    push(_P, t)
                fence = _NONE if c in _THROUGH_CELLS else _CELLS
                if top and top[-1] == c:
                    pop()
                elif c in _HEADINGS:
                    if any(held[x] for x in _HEADINGS):
                        close(_HEADINGS, fence)
                elif held[c]:
                    close((c,), fence)
        if at < stop:
            data(at, stop, True)
        while top:
            pop()

    def _decoded(self, a: int, b: int, references: bool) -> str:
        text = self.raw[a:b].decode("utf-8", "replace")
        return self.unescape(text) if references and "&" in text else text

    def text(self, i: int) -> str:
        """All text in element ``i``."""
        own = self.texts[self.first[i] : self.last[i]]
        return "".join(x if isinstance(x, str) else self._decoded(*x) for x in own)

    def attributes(self, i: int) -> dict[str, str]:
        """The first value of each attribute."""
        if self.tag[i] < 0:
            return {}
        a, b = self.lt[self.tag[i]], self.ends[self.tag[i]]
        at, out = _HEAD_OF_TAG.match(self.raw, a).end(), {}
        while found := _ATTRIBUTES.match(self.raw, at, b):
            name, *values = found.groups()
            value = next((v for v in values if v is not None), b"")
            out.setdefault(name.lower().decode("utf-8", "replace"), self.unescape(value.decode("utf-8", "replace")))
            at = found.end()
        return out

    def first_of(self, *codes: int) -> int | None:
        return next((i for i, c in enumerate(self.code) if c in codes), None)

    def title(self) -> str:
        """Of the first title, or else the first main heading, with any text; empty without."""
        for c in (_TITLE, _H1):
            i = self.first_of(c)
            if i is not None and (text := self.text(i).strip(WHITE_SPACE)):
                return text
        return ""

    def description(self) -> str:
        """Of the first element of metadata that says so, or else the beginning of the first paragraph."""
        metas = [self.attributes(i) for i, c in enumerate(self.code) if c == _META]
        for key, name in (("name", "description"), ("property", "og:description"), ("name", "twitter:description")):
            found = next((m for m in metas if m.get(key) == name), {})
            if text := found.get("content", ""):
                return text.strip(WHITE_SPACE)
        i = self.first_of(_P)
        text = self.text(i) if i is not None else ""
        if not text:
            return NO_DESCRIPTION
        cut = text.encode()
        return (cut[:197].decode("utf-8", "replace") + "..." if len(cut) > 200 else text).strip(WHITE_SPACE)

    def main(self) -> int | None:
        """The element that holds the main content."""
        for i, c in enumerate(self.code):
            if c in _MAIN:
                return i
            if self.tag[i] < 0:
                continue
            a, b = self.lt[self.tag[i]], self.ends[self.tag[i]]
            if b - a > _SHORTEST and (self.raw.find(b"content", a, b) >= 0 or self.raw.find(b"&", a, b) >= 0):
                own = self.attributes(i)
                if own.get("id") == "content" or not {"content", "post-content"}.isdisjoint(re.split(r"[ \t\n\f\r]+", own.get("class", ""))):
                    return i
        return self.first_of(_BODY)

    def content(self, limit: int = 10_000) -> str:
        """The blocks of the main content as Markdown, cut at a paragraph's end within ``limit`` bytes."""
        main, out, size = self.main(), [], 0
        for i in range(main + 1, self.below[main]) if main is not None else ():
            c = self.code[i]
            if c not in _BLOCKS or not (text := self.text(i).strip(WHITE_SPACE)):
                continue
            if c in _HEADINGS:
                own = ["#" * int(_KNOWN[c][1]) + f" {text}\n\n"]
            elif c == _P:
                own = [f"{text}\n\n"]
            elif c == _QUOTE:
                own = [f"> {text}\n\n"]
            else:
                items = (self.text(j).strip(WHITE_SPACE) for j in range(i + 1, self.below[i]) if self.code[j] == _LI)
                own = [(f"- {x}\n" if c == _UL else f"{n}. {x}\n") for n, x in enumerate(items, 1) if x] + ["\n"]
            out += own
            size += sum(len(x.encode()) for x in own)
            if size > limit:
                break  # what follows is cut anyway
        raw = "".join(out).encode()
        if len(raw) > limit:
            end = raw[:limit].rfind(b"\n\n")
            raw = raw[: end if end >= 0 else limit] + b"\n\n... (content truncated)"
        return raw.decode("utf-8", "replace")


def read(pages: pa.Array, *parts: str, closed: bool = False) -> list[list[str | None]]:
    """These parts (methods of ``Page``) of each page, a list for each part."""
    out: list[list] = [[] for _ in parts]
    for own in _read_pieces(pages, parts, closed):
        for column, values in zip(out, own, strict=True):
            column += values
    return out


def _read_pieces(pages: pa.Array, parts: tuple[str, ...], closed: bool) -> Iterator[list[list[str | None]]]:
    for piece in _pieces(pages):
        null = piece.is_null().to_pylist()
        own: list[list] = [[] for _ in parts]
        for page, missing in zip(Index(piece.fill_null(""), closed), null, strict=True):
            for column, part in zip(own, parts, strict=True):
                column.append(None if missing else getattr(page, part)())
        yield own


def _reader(*parts: str, closed: bool = False):
    """A function of pages with these parts; texts become Arrow's a piece at a time, so that those of a whole batch are not held twice."""

    def run(html: pa.Array) -> pa.Array:
        pieces = [pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in own], names=list(parts)) for own in _read_pieces(html, parts, closed)]
        return pa.concat_arrays(pieces) if pieces else pa.array([], pa.struct([(p, pa.string()) for p in parts]))

    return F.arrow_udf(T.StructType([T.StructField(n, T.StringType()) for n in parts]))(run)


#: Title (empty if the page has none) and description.
page_head = _reader("title", "description")
#: With the main content as Markdown; a function of its own, so that the short form does not pay for it.
page_full = _reader("title", "description", "content")
#: The same where only character references with a semicolon count.
page_head_closed = _reader("title", "description", closed=True)
page_full_closed = _reader("title", "description", "content", closed=True)
