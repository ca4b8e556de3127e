"""Main text of web pages by equivalence-class template deduction.

Tokens are elements by their path and runs of text by path and content, over the whole page. A token's occurrence vector holds its count on every page of its
host; tokens with equal vectors in the same enclosing class form an equivalence class. Classes that are large and frequent enough are the host's
template: its texts go, and its elements are the slots' borders. What all pages of a host put into a slot decides whether the slot
belongs to the article. Vectors are never built: the exclusive-or of a hash of (page, count) over the pages stands for one,
which Spark sums up in parts however hot a host is.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of, materialize, splittable

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
USED = re.compile(r"class|id|role|hidden|style", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title select button noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Start tags that end an open element of the named kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
ENDS_P = BLOCK - {"html", "body", "head"}
#: Elements and roles that stand, by the HTML standard, for menus, headers, footers, sidebars, notices and forms.
OUTSIDE = frozenset("head nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id values that suggest the same; they count only where all words of the value are of these or neutral ones.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead "
    "comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup share sharing "
    "social related recommended toolbar pagination pager copyright disclaimer".split()
)
NEUTRAL = frozenset("area bar block blog body bottom box col column container content entry global group heading inner item items left link links list main module page panel post posts reader right row section site slot text title top user widget widgets wrap wrapper".split())
#: What an element may be (bits): outside by the standard, marked by its names, in the article, a form, a list.
SEMANTIC, MARKED, INSIDE, FORM, LIST = 1, 2, 4, 8, 16
#: A slot whose text is links to this part is a menu, unless it is in the article.
MENU = 0.9
#: A template is no greater part of the text outside, and in, article or main than this.
COPY = (2 / 3, 1 / 3)
#: What is known of a token of a host: a text of the template, an element that is no part of the article, one that may be though its names suggest otherwise.
TEXT, OUT, KEPT = 0, 1, 2

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


def _h(*parts: object) -> int:
    x = xxhash.xxh64_intdigest("\x00".join(map(str, parts)))
    return x - (1 << 64) if x >> 63 else x


class Node:
    __slots__ = ("tag", "path", "up", "bits", "article", "link", "out")

    def __init__(self, tag: str, path: int, up: Node | None, bits: int, article: bool, link: bool):
        self.tag, self.path, self.up, self.bits, self.article, self.link = tag, path, up, bits, article, link
        self.out: bool | None = None


def attributes(raw: str) -> dict[str, str]:
    """The attributes by their exact names; of a repeated one, the first."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _element(tag: str, attrs: str, up: Node) -> Node:
    found = attributes(attrs) if attrs and USED.search(attrs) else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    role = found.get("role", "").lower()
    inside = up.article or tag in ("article", "main") or role in ("main", "article")
    words = {w.lower() for w in WORD.findall(names)} if names else set()
    marks = (words & MARKS) - ({"header"} if inside else set())  # an article's own header belongs to it
    semantic = tag in OUTSIDE or tag == "header" and not inside or role in ROLES or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    bits = SEMANTIC * semantic | MARKED * bool(marks and words <= MARKS | NEUTRAL and tag not in ("html", "body", "main", "article"))
    bits |= INSIDE * inside | FORM * (tag == "form" or role == "form") | LIST * (tag in ("ul", "ol", "menu", "dir"))
    return Node(tag, _h(up.path, tag, re.sub(r"\d+", "0", names)), up, bits, inside, up.link or tag == "a")


def walk(page: str | None) -> Iterator[tuple[str, Node, str]]:
    """Events of a page: ("tag", its node, tag), ("text", node around it, raw text), ("block", node, "") where a block begins or ends."""
    root = Node("", 0, None, 0, False, False)
    stack = [root]
    page = page or ""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            yield "text", stack[-1], m["text"]
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            if tag in BLOCK:
                yield "block", stack[-1], ""
            continue
        if tag in ENDS_P or tag in CLOSES:
            ends = (*CLOSES.get(tag, ()), *(("p",) if tag in ENDS_P else ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        node = _element(tag, m["attrs"] or m["attrs2"] or "", stack[-1])
        if tag in BLOCK:
            yield "block", node, ""
        yield "tag", node, tag
        if tag == "br":
            yield "text", stack[-1], " "
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not (m["attrs"] or m["attrs2"] or "").endswith("/"):
            stack.append(node)


def clean(raw: str) -> str:
    return " ".join((entities.unescape(raw) if "&" in raw else raw).split())


def text_token(node: Node, text: str) -> int:
    return _h(node.path, "text", text)


class Profile:
    """A page's tokens: elements {path: [count, path around it, bits, characters, those in links, those in the article]}, texts {token: [count, path, in the article]}
    and ident, the hash of all its texts, so that copies count as one page.
    """

    def __init__(self, events: list[tuple[str, Node, str]]):
        self.elements: dict[int, list] = {0: [1, 0, 0, 0, 0, 0]}
        self.texts: dict[int, list] = {}
        every = xxhash.xxh64()
        for kind, node, x in events:
            if kind == "tag":
                self.elements.setdefault(node.path, [0, node.up.path, node.bits, 0, 0, 0])[0] += 1
            elif kind == "text" and (t := clean(x)):
                e = self.elements[node.path]
                e[3] += len(t)
                e[4] += len(t) if node.link else 0
                e[5] += len(t) if node.article else 0
                self.texts.setdefault(text_token(node, t), [0, node.path, node.article])[0] += 1
                every.update(t + "\0")
        self.ident = every.intdigest() - (1 << 63)
        for path in reversed(self.elements):  # what is inside comes after what is around it
            if path:
                e = self.elements[path]
                up = self.elements[e[1]]
                for i in (3, 4, 5):
                    up[i] += e[i]

    def outside(self, path: int) -> bool:
        """Whether an element of which the host's pages tell nothing is no part of the article, by this page alone."""
        _, _, bits, chars, links, art = self.elements[path]
        _, _, _, all_chars, _, all_art = self.elements[0]
        if art and art * 2 > all_art:  # it holds the article
            return False
        most = not all_art and chars * 2 > all_chars
        menu = bool(bits & LIST) and not bits & INSIDE and links and links == chars
        return bool(bits & SEMANTIC) and not (bits & FORM and most) or bool(bits & MARKED) and not most or bool(menu) and not most


def templates(pages: DataFrame, url: str, html: str, *, share: float = 0.5, least: int = 3) -> DataFrame:
    """(host, token, kind) of the hosts' templates: TEXT for texts to drop, OUT and KEPT for elements that border slots.

    An element's start and end tag are two tokens of one vector, so elements on at least least pages are valid; a text is, if it is on least pages and share of
    the host's, and its class, the tokens with its vector in the same enclosing class, has at least two tokens. Outside the
    article, the class of the page itself counts too. Classes nest, since a token's path holds the elements around it. A slot
    is OUT if, over all pages of the host, it doesn't hold the greater part of the article and is outside by the HTML standard, by its names (and, without
    an article, doesn't hold the greater part of the text) or by being made of links.
    """
    schema = "host string, token long, up long, ident long, n int, bits int, chars long, links long, art long, is_text boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        names = ["host", "token", "up", "ident", "n", "bits", "chars", "links", "art", "is_text"]
        for b in batches:
            rows: list[tuple] = []
            for u, x in zip(b[url], b[html], strict=True):
                if not (host := host_of(u.as_py())):
                    continue
                p = Profile(list(walk(x.as_py())))
                rows += [(host, path, up, p.ident, n, bits, chars, links, art, False) for path, (n, up, bits, chars, links, art) in p.elements.items()]
                rows += [(host, k, path, p.ident, n, INSIDE * article, 0, 0, 0, True) for k, (n, path, article) in p.texts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    same = ("up", "bits", "is_text")
    found = pages.select(url, html).mapInArrow(run, schema)
    once = found.groupBy("host", "token", "ident").agg(*[F.max(c).alias(c) for c in ("n", "chars", "links", "art", *same)])
    vectors = once.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("ident", "n")).alias("vector"), F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("chars", "links", "art")], *[F.max(c).alias(c) for c in same])
    vectors = materialize(vectors.where((F.col("pages") >= least) | (F.col("token") == 0)))
    whole = vectors.where("token = 0").select(F.col("host").alias("h"), F.col("pages").alias("all_pages"), F.col("vector").alias("all_vector"), F.col("chars").alias("all_chars"), F.col("art").alias("all_art"))
    around = vectors.where("not is_text").select(F.col("host").alias("h"), F.col("token").alias("t"), F.col("vector").alias("up_vector"))
    text = vectors.where("is_text")
    text = text.join(whole, text.host == whole.h).drop("h").where(F.col("pages") >= share * F.col("all_pages"))
    text = text.join(around, (text.host == around.h) & (text.up == around.t)).drop("h", "t")
    keys = ["host", "vector", "pages", "up_vector"]
    size = text.groupBy(*keys, splittable("host")).agg(F.count("*").alias("size")).select(*keys, "size")
    text = text.join(size, keys)
    tags = F.when((F.col("up_vector") == F.col("vector")) | (F.col("bits") == 0) & (F.col("all_vector") == F.col("vector")), 2).otherwise(0)
    text = text.where(F.col("size") + tags >= 2).select("host", "token", F.lit(TEXT).alias("kind"))
    has = lambda bit: F.col("bits").bitwiseAND(bit) > 0
    slots = vectors.where("not is_text and token != 0").join(whole, F.col("host") == F.col("h"))
    holds = F.col("art") * 2 > F.col("all_art")
    most = (F.col("all_art") == 0) & (F.col("chars") * 2 > F.col("all_chars"))
    menu = ~has(INSIDE) & (F.col("links") > 0) & (F.col("links") >= MENU * F.col("chars"))
    out = ~holds & (has(SEMANTIC) & ~(has(FORM) & most) | has(MARKED) & ~most | menu & ~most)
    slots = slots.where(out | has(MARKED) | has(SEMANTIC) | has(LIST)).select("host", "token", F.when(out, OUT).otherwise(KEPT).alias("kind"))
    return text.union(slots)


def main_text(page: str | None, known: dict[int, int]) -> str:
    """The blocks of a page that fill slots of its host's template and belong to the article: those inside article or main, if there are any.

    Elements that the host's pages tell nothing of are judged by the page alone. Where the template's texts would be more than COPY of what is there, the
    page is a version of other pages, and they stay.
    """
    events = list(walk(page))
    profile: Profile | None = None
    blocks: list[tuple[str, bool]] = []
    parts: list[str] = []
    state = False

    def out(node: Node | None) -> bool:
        nonlocal profile
        if node is None or node.up is None:
            return False
        if node.out is None:
            kind = known.get(node.path)
            if kind is None and node.bits & (SEMANTIC | MARKED | LIST):
                profile = profile or Profile(events)
                kind = OUT if profile.outside(node.path) else KEPT
            node.out = kind == OUT or out(node.up)
        return node.out

    def flush() -> None:
        if parts and (t := clean("".join(parts))):
            blocks.append((t, state))
        parts.clear()

    drop = {True: set(), False: set()}  # the template's texts in and outside the article
    if TEXT in known.values():
        chars = {True: [0, 0], False: [0, 0]}
        for kind, node, x in events:
            if kind == "text" and (t := clean(x)) and not out(node):
                token = text_token(node, t)
                chars[node.article][known.get(token) == TEXT] += len(t)
                if known.get(token) == TEXT:
                    drop[node.article].add(token)
        for where, (own, template) in chars.items():
            if template > COPY[where] * (own + template):
                drop[where] = set()
    for kind, node, x in events:
        if kind == "block":
            flush()
        elif kind == "text" and not out(node):
            if drop[node.article] and text_token(node, clean(x)) in drop[node.article]:
                continue
            if parts and node.article != state:
                flush()
            state = node.article
            parts.append(x)
    flush()
    return "\n".join([t for t, article in blocks if article] or [t for t, _ in blocks])


MADE = ("text", "n_chars")


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", keep: list[str] | None = None, broadcast_tokens: int = 500_000) -> DataFrame:
    """pages (the columns of keep) with text and n_chars.

    Null html is an empty page; pages without a host have no template and are judged alone; an empty page has an empty
    text; pages with the same texts count once in a template; columns named like a result are replaced. The templates go to the tasks if
    they hold at most broadcast_tokens tokens; beyond, each page gets its host's template by a join.
    """
    kept = [c for c in (keep or pages.columns) if c.lower() not in MADE]
    template = materialize(templates(pages, url, html))
    out = T.StructType([*(f for f in pages.schema.fields if f.name in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    kept = [f.name for f in out.fields[:-2]]
    names = list(dict.fromkeys([*kept, url, html]))
    small = template.count() <= broadcast_tokens
    rows = clear_of(pages, [m for m in MADE if m not in (url, html)]).select(*[F.col(f"`{c}`") for c in names])
    sent = None
    if small:
        by_host: dict[str, dict[int, int]] = {}
        for r in template.toLocalIterator():
            by_host.setdefault(r.host, {})[r.token] = r.kind
        sent = pages.sparkSession.sparkContext.broadcast(by_host)
    else:
        host = F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
        lists = template.groupBy("host", splittable("host")).agg(F.collect_list(F.struct("token", "kind")).alias("_tokens")).select(F.col("host").alias("_host"), "_tokens")
        rows = rows.join(lists, host == F.col("_host"), "left").drop("_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for i, (u, x) in enumerate(zip(b[url], b[html], strict=True)):
                known = sent.value.get(host_of(u.as_py()), {}) if sent is not None else {t["token"]: t["kind"] for t in b["_tokens"][i].as_py() or ()}
                texts.append(main_text(x.as_py(), known))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, *MADE])

    return rows.mapInArrow(run, out)
