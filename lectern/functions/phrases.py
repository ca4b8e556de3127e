"""STR-F14, STR-F15 with phrases: script conversion by the longest phrase at each place, as Python functions over batches of 100 texts, not of the 10,000 of Arrow. Tables are parameters."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Trie:
    """Phrases and what they become; a text is read once, each place by the longest phrase that begins there, and characters without one stay."""

    def __init__(self, table: Mapping[str, str]):
        self.root: dict = {}
        for phrase, out in table.items():
            if phrase:
                node = self.root
                for c in phrase:
                    node = node.setdefault(c, {})
                node[""] = out
        self.starts = re.compile("[" + "".join(map(re.escape, self.root)) + "]") if self.root else None

    def longest(self, text: str, at: int, end: int) -> tuple[int, str] | None:
        """(end, output) of the longest phrase at a place."""
        node, best = self.root, None
        while at < end and (node := node.get(text[at])) is not None:
            at += 1
            if "" in node:
                best = at, node[""]
        return best

    def convert(self, text: str, at: int = 0, end: int | None = None) -> str:
        end = len(text) if end is None else end
        out, since = [], at
        while self.starts is not None and (m := self.starts.search(text, at, end)) is not None:
            at = m.start()
            if (hit := self.longest(text, at, end)) is None:
                at += 1
                continue
            out += [text[since:at], hit[1]]
            at = since = hit[0]
        return "".join([*out, text[since:end]])


def converter(table: Mapping[str, str], *, fixes: Mapping[str, str] | None = None, protect: str | None = None) -> Callable[[str], str]:
    """text -> text: phrases and characters of table, then the fixes over what came out; what the pattern protect matches stays as it is, and parts phrases."""
    steps = [Trie(t) for t in (table, fixes or {}) if t]
    safe = re.compile(protect) if protect else None

    def part(text: str) -> str:
        for step in steps:
            text = step.convert(text)
        return text

    def convert(text: str) -> str:
        if safe is None:
            return part(text)
        out, at = [], 0
        for m in safe.finditer(text):
            out += [part(text[at : m.start()]), m.group()]
            at = m.end()
        return "".join([*out, part(text[at:])])

    return convert


def _column(make: Callable[[str], str], s: Column) -> Column:
    @F.udf(T.StringType(), useArrow=False)
    def apply(text: str | None) -> str | None:
        return None if text is None else make(text)

    return apply(s)


def converted(s: Column, table: Mapping[str, str], *, fixes: Mapping[str, str] | None = None, protect: str | None = None) -> Column:
    """STR-F14 of a column; null stays null."""
    return _column(converter(table, fixes=fixes, protect=protect), s)


def both_scripts(s: Column, table: Mapping[str, str], *, fixes: Mapping[str, str] | None = None, han: str = "[一-鿿]+", between: str = " ") -> Column:
    """STR-F15 of a column: the text, and after `between` the other form of its Han runs; the text alone where they have none or it is the same."""
    convert, runs = converter(table, fixes=fixes), re.compile(han)

    def both(text: str) -> str:
        own = " ".join(runs.findall(text))
        other = convert(own)
        return text if other == own else f"{text}{between}{other}"

    return _column(both, s)


def search_row(fields: list[Column], rest: list[Column], table: Mapping[str, str], *, longest: int = 5000, head: int = 8, between: str = " ") -> Column:
    """SNK-04, AUX-12: what a search looks in: all fields lower-cased and cut to `longest` characters, and after it the other form of the Han runs of the first
    `head` fields, which the cut doesn't shorten. Null fields count as empty."""
    squeezed = lambda cs: F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cs]), r"\s+", " ")))
    first = squeezed(fields[:head])
    tail = F.substr(both_scripts(first, table, between=between), F.length(first) + 1)
    return F.concat(F.substring(squeezed([*fields, *rest]), 1, longest), tail)
