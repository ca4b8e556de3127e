"""Web pages by their nested elements: what a reader sees or hears (STR-F27), and the blocks that may be a page's body (SRC-13).

One pass over the tags with a stack of open elements; an end tag closes the nearest element of its name and all opened since, and what is never closed ends with the page.
"""

from __future__ import annotations

import bisect
import html as references
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without content, whose content is no markup, that begin a line of their own; elements that aren't read, and attributes that are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title")
LINES = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
UNREAD = ("script", "style", "template", "head")
READ_ATTRIBUTES = ("aria-label", "title", "alt", "placeholder", "aria-description", "aria-placeholder")
BODIES = ("article", "main")
BODY_CLASSES = ("transcript", "post-content", "entry-content", "available-content", "body markup")

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: int  # the page itself is element 0
    start: int
    end: int


@dataclass
class Piece:
    text: str
    owner: int
    start: int
    line: int  # pieces of one line aren't parted by an element that begins or ends one


def parsed(html: str) -> tuple[list[Element], list[Piece]]:
    """The elements in the order of their start tags, each with the stretch of the page it covers, and the pieces of text between tags."""
    elements, pieces, stack, line, at = [Element("", {}, -1, 0, len(html))], [], [0], 0, 0

    def text(start: int, stop: int) -> None:
        if start < stop:
            pieces.append(Piece(references.unescape(html[start:stop]), stack[-1], start, line))

    while (m := TAG.search(html, at)) is not None:
        text(at, m.start())
        at = m.end()
        if name := m["end"]:
            name = name.lower()
            depth = next((d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].tag == name), None)
            if depth is not None:
                for i in stack[depth:]:
                    elements[i].end = m.start()
                del stack[depth:]
            line += name in LINES
        elif name := m["start"]:
            name = name.lower()
            pairs = {}
            for key, *values in ATTRIBUTE.findall(m["rest"]):
                pairs.setdefault(key.lower(), references.unescape("".join(values)))
            elements.append(Element(name, pairs, stack[-1], m.start(), m.end() if name in VOID else len(html)))
            line += name in LINES
            if name in VOID:
                continue
            stack.append(len(elements) - 1)
            if name in RAW:
                close = re.compile(rf"</{name}\b", re.I).search(html, at)
                stop = close.start() if close else len(html)
                text(at, stop)
                at = stop
    text(at, len(html))
    return elements, pieces


def _below(elements: list[Element], chosen) -> list[bool]:
    """Whether each element is chosen or lies in one that is."""
    out = []
    for e in elements:
        out.append(chosen(e) or (e.parent >= 0 and out[e.parent]))
    return out


def read_runs(html: str, skip: Sequence[str] = UNREAD, spoken: str | None = "zh", attributes: Sequence[str] = READ_ATTRIBUTES) -> list[tuple[str, str]]:
    """(where, text) of what is read of a page, in its order; where is empty for text and @name for an attribute."""
    elements, pieces = parsed(html)
    hidden = _below(elements, lambda e: e.tag in skip or (spoken is not None and e.attributes.get("lang", "").lower().startswith(spoken)))
    runs = [(p.start, 0, "", p.text.strip()) for p in pieces if not hidden[p.owner]]
    for e, gone in zip(elements, hidden, strict=True):
        if not gone:
            runs += [(e.start, k, f"@{name}", e.attributes[name].strip()) for k, name in enumerate(attributes) if name in e.attributes]
    return [(where, text) for _, _, where, text in sorted(runs) if text]


def body_blocks(html: str, tags: Sequence[str] = BODIES, classes: Sequence[str] = BODY_CLASSES, least: int = 3000) -> Iterator[tuple[str, str]]:
    """(tag, text) of the blocks that may be a page's body: elements whose class says so, then those of each tag, of least characters of markup, and the whole page last."""
    elements, pieces = parsed(html)
    unread = _below(elements, lambda e: e.tag in ("script", "style"))
    pieces = [p for p in pieces if not unread[p.owner]]
    starts = [p.start for p in pieces]
    named = [e for e in elements[1:] if any(c in e.attributes.get("class", "").lower() for c in classes)]
    inside = [e for group in (named, *([e for e in elements if e.tag == t] for t in tags)) for e in group if e.end - e.start >= least]
    seen = set()
    for e in [*inside, elements[0]]:
        low, high = bisect.bisect_left(starts, e.start), bisect.bisect_left(starts, e.end)
        if (low, high) in seen:
            continue
        seen.add((low, high))
        out, line = [], None
        for p in pieces[low:high]:
            out.append(("" if line in (None, p.line) else "\n") + re.sub(r"\s+", " ", p.text))
            line = p.line
        lines = (re.sub(" +", " ", x).strip() for x in "".join(out).split("\n"))
        yield e.tag, "\n".join(x for x in lines if x)


def visible_runs(html: Column, *, skip: Sequence[str] = UNREAD, spoken: str | None = "zh", attributes: Sequence[str] = READ_ATTRIBUTES, having: str | None = None) -> Column:
    """STR-F27: array of (where, text): the texts and attributes of a page that are read, outside skipped elements and those in the language spoken, however nested.

    having keeps those with a match, such as of a script that should have been translated. Null and empty pages have none. Python, over batches of 100 pages.
    """
    pattern = having and re.compile(having)

    @F.udf(T.ArrayType(T.StructType([T.StructField("where", T.StringType()), T.StructField("text", T.StringType())])), useArrow=False)
    def run(page: str | None) -> list[tuple[str, str]]:
        found = [] if page is None else read_runs(page, skip, spoken, attributes)
        return [(w, t) for w, t in found if pattern is None or pattern.search(t)]

    return run(html)


def blocks(html: Column, *, tags: Sequence[str] = BODIES, classes: Sequence[str] = BODY_CLASSES, least: int = 3000) -> Column:
    """SRC-13: array of (tag, text) of a page's blocks that may be its body, in the order they are tried; the page itself, with an empty tag, is the last. Python, over batches of 100 pages."""

    @F.udf(T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])), useArrow=False)
    def run(page: str | None) -> list[tuple[str, str]]:
        return [] if page is None else list(body_blocks(page, tags, classes, least))

    return run(html)
