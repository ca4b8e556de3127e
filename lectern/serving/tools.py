"""The served interface: an index that is kept for a while, four questions to it as DataFrames, and the JSON-RPC messages that carry them.

An index has slug, title, dek, show, show_id, cat, minutes, tags (an array) and published (a date, or text that sorts as one).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the protocol and the interface.
PROTOCOL, NO_METHOD, KEEP, MOST = "2024-11-05", -32601, 900, 50
NEWEST = ("published", "slug")


class Kept:
    """SRC-23: what load gives, cached, until it is ttl seconds old; then it is loaded again and the older one freed."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float = KEEP, clock: Callable[[], float] = time.monotonic):
        self.load, self.ttl, self.clock = load, ttl, clock
        self.df: DataFrame | None = None
        self.at = 0.0

    def get(self) -> DataFrame:
        if self.df is None or self.clock() - self.at >= self.ttl:
            fresh = self.load().cache()  # before the old one goes, which stays if this fails
            if self.df is not None:
                self.df.unpersist()
            self.df, self.at = fresh, self.clock()
        return self.df


def clamp(limit: int) -> int:
    """SRT-08."""
    return max(1, min(int(limit), MOST))


def newest_first(items: DataFrame) -> DataFrame:
    return items.orderBy(F.col(NEWEST[0]).desc_nulls_last(), NEWEST[1])


def _text(*cs: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cs], *([F.array_join("tags", " ")] if "title" in cs else [])))


def haystack() -> Column:
    """What a search of an item looks in: title, dek, show and tags, lower-cased."""
    return _text("title", "dek", "show")


def found(items: DataFrame, query: str = "", show: str = "", cat: str = "", hay: Column | None = None) -> DataFrame:
    """FLT-27: items in whose haystack every word of the query occurs, of one show (a part of its name or id) and category, if these are given."""
    hay = haystack() if hay is None else hay
    keep: Column = F.lit(True)
    for word in query.lower().split():
        keep = keep & F.contains(hay, F.lit(word))
    if show:
        keep = keep & F.contains(_text("show", "show_id"), F.lit(show.lower()))
    return items.where(keep & (F.col("cat") == cat) if cat else keep)


def shows(items: DataFrame, cat: str = "") -> DataFrame:
    """Each show with its number of items and the latest; those with most first."""
    x = items.where("show_id is not null" if not cat else (F.col("show_id").isNotNull() & (F.col("cat") == cat)))
    by = x.groupBy(F.col("show_id").alias("id")).agg(F.min("show").alias("show"), F.count("*").alias("episodes"), F.max("published").alias("latest"))
    return by.orderBy(F.col("episodes").desc(), "id")


class Server:
    """SNK-17: answers JSON-RPC messages about an index and, by slug, about whole items."""

    def __init__(self, index: Kept, item: Callable[[str], DataFrame], name: str = "lectern", search: Callable[[str, str, str], DataFrame] | None = None):
        """search, if given, finds items by (query, show, cat) in place of a scan of the index: that of a SearchIndex."""
        self.index, self.item, self.name = index, item, name
        self.search = search or (lambda query, show, cat: found(self.index.get(), query, show, cat))
        text, whole = {"type": "string"}, {"type": "integer", "default": 10}
        self.tools: dict[str, tuple[str, dict, list[str], Callable]] = {
            "search_episodes": ("Items in which all words occur, by show and category.", {"query": text, "show": text, "cat": text, "limit": whole}, [], self._search),
            "get_episode": ("One item in full, by its slug.", {"slug": text}, ["slug"], self._item),
            "list_shows": ("All shows, with their number of items and the latest.", {"cat": text}, [], self._shows),
            "latest_episodes": ("The newest items, of one category if given.", {"cat": text, "limit": whole}, [], self._latest),
        }

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        return [json.loads(x) for (x,) in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]

    def _search(self, query: str = "", show: str = "", cat: str = "", limit: int = 10) -> dict:
        hits = self.search(query or "", show or "", cat or "")
        return {"matched": hits.count(), "episodes": self._rows(newest_first(hits).limit(clamp(limit)))}

    def _item(self, slug: str) -> dict:
        rows = self._rows(self.item(slug).limit(1))
        if not rows:
            raise KeyError(slug)
        return rows[0]

    def _shows(self, cat: str = "") -> dict:
        rows = self._rows(shows(self.index.get(), cat or ""))  # one for each show of the registry
        return {"count": len(rows), "shows": rows}

    def _latest(self, cat: str = "", limit: int = 10) -> dict:
        hits = found(self.index.get(), cat=cat or "")
        return {"count": hits.count(), "episodes": self._rows(newest_first(hits).limit(clamp(limit)))}

    def handle(self, message: dict) -> dict | None:
        """The answer to a message; None to notifications. A tool that fails gives a result marked as an error; unknown methods and tools are protocol errors."""
        asked, params = message.get("method") or "", message.get("params") or {}
        if asked.startswith("notifications/"):
            return None
        methods = {"initialize": self._greeting, "tools/list": self._listing, "tools/call": self._call}
        made = methods[asked](params) if asked in methods else None
        body = {"error": {"code": NO_METHOD, "message": f"nothing here answers to {params.get('name', asked)!r}"}} if made is None else {"result": made}
        return {"jsonrpc": "2.0", "id": message.get("id"), **body}

    def _greeting(self, _: dict) -> dict:
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": "1"}}

    def _listing(self, _: dict) -> dict:
        schema = lambda p, r: {"type": "object", "properties": p, "required": r}
        return {"tools": [{"name": n, "description": d, "inputSchema": schema(p, r)} for n, (d, p, r, _) in self.tools.items()]}

    def _call(self, params: dict) -> dict | None:
        tool = self.tools.get(params.get("name"))
        if tool is None:
            return None
        try:
            said, failed = json.dumps(tool[-1](**(params.get("arguments") or {})), ensure_ascii=False), {}
        except Exception as e:
            said, failed = f"the tool gave no answer ({type(e).__name__}, {e})", {"isError": True}
        return {"content": [{"type": "text", "text": said}], **failed}
