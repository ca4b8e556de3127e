"""Pages by their nested elements: what is read of them, their blocks, and transcripts on pages against a plain loop."""

from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions import markup
from lectern.plans.queries import QUERIES
from lectern.sources import transcripts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("html", "runs"),
    [
        ("", []),
        ("<p>one <b>two</b>", [("", "one"), ("", "two")]),
        ('<div lang="zh-TW">x<div>y</div>z</div>w', [("", "w")]),
        ("<script>if (a < b) '</p>'; </script>after", [("", "after")]),
        ('<template><p title="in">no</p></template><img alt="a &amp; b">t', [("@alt", "a & b"), ("", "t")]),
        ('<p title="own" lang="zh">no</p><p title="yes" LANG=en>so</p>', [("@title", "yes"), ("", "so")]),
        ("<div><span>open</div>out<!-- <p>gone</p> -->", [("", "open"), ("", "out")]),
        ("2 < 3 and </p>stray <a href='x>y'>link</a>", [("", "2 < 3 and"), ("", "stray"), ("", "link")]),
        ("<head><title>t</title></head><style>p{}", []),
        ("<!-- never closed <p>x", []),
    ],
)
def test_read_runs(html, runs):
    assert markup.read_runs(html) == runs


def test_nested_blocks_and_lines():
    inner = "<div class='box'><p>first\n line<b>!</b></p><div>second</div></div>"
    page = f"<nav>menu</nav><div class='Post-Content x'>{inner}third</div><article><article>in</article>out</article>"
    found = list(markup.body_blocks(page, least=0))
    assert found == [("div", "first line!\nsecond\nthird"), ("article", "in\nout"), ("article", "in"), ("", "menu\nfirst line!\nsecond\nthird\nin\nout")]
    assert [t for t, _ in markup.body_blocks(page, least=10_000)] == [""]
    deep = "<div>" * 20_000 + "x"
    assert list(markup.body_blocks(deep, least=0)) == [("", "x")]


class Plain(HTMLParser):
    """The pages of the tables are well formed: a plain reader by a set of open elements."""

    def __init__(self):
        super().__init__()
        self.open, self.runs, self.text = [], [], ""

    def flush(self):
        if self.text.strip() and not self.hidden():
            self.runs.append(("", self.text.strip()))
        self.text = ""

    def hidden(self):
        return any(tag in ("script", "style", "template", "head", "nav") or lang.startswith("de") for tag, lang in self.open)

    def handle_starttag(self, tag, attrs):
        self.flush()
        own = {k: v or "" for k, v in reversed(attrs)}
        self.open.append((tag, own.get("lang", "").lower()))
        if not self.hidden():
            self.runs += [(f"@{k}", own[k].strip()) for k in markup.READ_ATTRIBUTES if own.get(k, "").strip()]
        if tag in markup.VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()

    def handle_data(self, data):
        self.text += data


def test_runs_of_the_tables_equal_a_plain_reader(spark):
    want = []
    for page, html in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet' WHERE html IS NOT NULL").fetchall():
        reader = Plain()
        reader.feed(html)
        reader.close()
        reader.flush()
        want += [(page, i, *r) for i, r in enumerate(reader.runs)]
    got = [tuple(r) for r in QUERIES["str_f27_runs"](spark, SF).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)


def spoken(words, n):
    return " ".join(words[i % len(words)] for i in range(n))


def test_page_transcripts(spark):
    words = "alpha bravo charlie delta echo foxtrot".split()
    title = "Alpha bravo charlie conversation"
    others = [f"Another episode number {'abcdefghij'[i]} of this show" for i in range(6)]
    body, heard = spoken(words, 400), f"<p>{title}</p>"
    listing = heard + "".join(f"<p>{t} {spoken(words, 60)}</p>" for t in others)
    pages = [
        (1, f"<article>teaser</article><div class='transcript'><div>x</div>{heard}{body}</div><footer>foot</footer>", title, 240, "s"),
        (2, f"<main>{heard}{body}</main>", title, 40, "s"),  # too fast
        (3, f"<main>{heard}{body}</main>", title, None, "s"),  # by number of words
        (4, f"<main>{heard}short</main>", title, None, "s"),
        (5, f"<main>{listing}</main>", title, None, "s"),
        (6, f"<main>{listing}</main>", title, None, "elsewhere"),  # titles of another show
        (7, f"<main>{body}</main>", "Nobody speaks about these matters here", None, "s"),
        (8, f"<main>{body}</main>", None, None, "s"),
        (9, None, title, None, "s"),
        (None, f"<main>{heard}{body}</main>", title, None, "s"),
        *[(20 + i, "", t, None, "s") for i, t in enumerate(others)],
    ]
    rows = spark.createDataFrame(pages, "page long, html string, title string, seconds long, show string").withColumn("tag", F.lit("clash"))
    got = {r["page"]: r for r in transcripts.page_transcripts(rows, "page", "html", "title", "seconds", "show", per_minute=(70, 300), least=300, markup_least=0).collect()}
    assert got.keys() == {1, 3, 6, 8}
    # The footer's word makes the whole page of 1 the longest block.
    assert (got[1]["tag"], got[1]["words"]) == ("", 407) and got[1]["text"].startswith("teaser\nx\nAlpha")
    assert (got[3]["tag"], got[3]["words"], got[3]["text"]) == ("main", 404, f"{title}\n{body}")
    assert transcripts.page_transcripts(rows.where("false"), "page", "html", "title", "seconds", "show").count() == 0


def test_page_transcripts_of_the_tables_equal_a_loop(spark):
    pages = duckdb.sql(rf"SELECT page_id, html, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), regexp_extract(html, '(?is)<title>(.*?)</title>', 1), page_id % 3 * 60 FROM '{SF}/pages.parquet'").fetchall()
    import re

    want = {}
    for page, html, host, title, seconds in pages:
        best = None
        for tag, text in [] if html is None else markup.body_blocks(html, least=300):
            n = len(re.findall(r"[A-Za-z0-9']+", text))
            fits = 20 <= n / (seconds / 60) <= 400 if seconds else n >= 60
            known = list(dict.fromkeys(re.findall("[a-z]{4,}", (title or "").lower())))[:12]
            hits = sum(w in text.lower() for w in known)
            others = {t.lower() for p, _, h, t, _ in pages if h == host and p != page and t and len(t) >= 18}
            named = sum(t in text.lower() for t in others)
            if fits and (len(known) < 3 or hits >= max(3, -(-len(known) // 2))) and not (named >= 3 and len(text) < 5000 * named) and (best is None or n > best[1]):
                best = (tag, n, text)
        if best:
            want[page] = best
    got = {r["page_id"]: (r["tag"], r["words"], r["text"]) for r in QUERIES["src_13_page_transcripts"](spark, SF).collect()}
    assert len(want) > 5 and got == want
