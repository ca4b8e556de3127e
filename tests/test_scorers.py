"""Scorers as a table function: backends that fail, answer late, answer junk and answer too little; what counts of what they say."""

import json
import time

import pytest
from pyspark.sql import Row

from lectern.operators import scorers as S
from lectern.plans.queries import QUERIES


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


@pytest.fixture
def named():
    # Within a function, so that it is shipped by value.
    def named(prompts, attempt):
        """A backend whose prompts say what it does."""
        out = []
        for p in prompts:
            if p.startswith("raise"):
                out.append(RuntimeError(p))
            elif p.startswith("junk"):
                out.append("I think so")
            elif p.startswith("list"):
                out.append("[1]")
            elif p.startswith("never"):
                out.append(None)
            elif p.startswith("second") and attempt == 0:
                out.append("not yet")
            else:
                out.append(f'Well:\n```json\n{{"score": "7", "said": "{p}"}}\n```')
        return out

    return named


def test_replies_are_asked_again_and_errors_kept(spark, named):
    prompts = ["fine", "raise x", "junk", "list", "never", "second", None]
    got = {r["k"]: r for r in S.asked(rows(spark, list(enumerate(prompts)), "k long, p string"), "k", "p", named, size=3, retries=2).collect()}
    assert {k: (r["asked"], r["error"]) for k, r in got.items()} == {0: (1, None), 1: (3, "RuntimeError: raise x"), 2: (3, "no JSON object"), 3: (3, "no JSON object"), 4: (3, "no answer"), 5: (2, None), 6: (0, "no prompt")}
    assert json.loads(got[5]["reply"]) == {"score": "7", "said": "second"} and got[1]["reply"] is None
    assert S.asked(rows(spark, [], "k long, p string"), "k", "p", named).count() == 0


def test_batches_are_of_the_size_asked_for():
    sizes = []

    def backend(prompts, attempt):
        sizes.append(len(prompts))
        return ['{"a": 1}' if p != "b" or attempt else "no" for p in prompts]

    assert [n for _, n, _ in S.replies(backend, ["a", "b", "c"])] == [1, 2, 1] and sizes == [3, 1]


@pytest.mark.parametrize(
    ("backend", "error"),
    [(lambda p, n: time.sleep(5), "TimeoutError: no answer in 0.2 s"), (lambda p, n: p[0]["x"], "TypeError"), (lambda p, n: [], "ValueError: 0 answers to 2 prompts"), (lambda p, n: None, "TypeError")],
)
def test_backends_that_fail_as_a_whole(backend, error):
    got = S.replies(backend, ["a", "b"], retries=1, seconds=0.2)
    assert [(x, n) for x, n, _ in got] == [(None, 2)] * 2 and all(e.startswith(error) for _, _, e in got)


def test_triage_and_categories(spark):
    said = {"a": '{"score": 12, "why": " long\\n why ", "kind": "lecture of many words"}', "b": '{"score": "NaN"}', "c": '{"score": "x"}', "d": "no", "e": '{"score": -1, "cat": "z"}', "f": '{"cat": " ai "}'}
    backend = lambda prompts, n: [said[p] for p in prompts]
    t = rows(spark, [(x, "notes") for x in said], "k string, basis string").selectExpr("*", "k as p")
    got = {r["k"]: tuple(r)[1:] for r in S.triaged(t, "k", "p", "basis", backend, "r1").collect()}
    assert got == {"a": (10.0, "long why", "lecture of m", "notes", "r1", None), "b": (None,) * 6, "c": (None,) * 6, "d": (None,) * 5 + ("no JSON object",), "e": (0.0, "", "", "notes", "r1", None), "f": (None,) * 6}
    got = {r["k"]: r["cat"] for r in S.categorised(t, "k", "p", "basis", ("ai", "z"), backend).collect()}
    assert got == {"a": "notes", "b": "notes", "c": "notes", "d": "notes", "e": "z", "f": "ai"}


def test_long_texts_are_mapped_then_reduced(spark):
    def backend(prompts, n):
        out = []
        for p in prompts:
            if p.startswith("{"):
                out.append(json.dumps({"final": json.loads(p)}))
            elif "fail" in p:
                out.append(RuntimeError("full"))
            else:
                out.append(json.dumps({"notes": [p.strip()], "quotes": ["q"] if "q" in p else None, "short": True}))
        return out

    texts = [("short", "abc"), ("long", "one q...." + "fail....." + "three...."), ("lost", "fail....." * 3), ("none", None)]
    got = {r["k"]: r for r in S.digested(rows(spark, texts, "k string, t string"), "k", "t", backend, chars=10, piece=9).collect()}
    assert json.loads(got["short"]["reply"])["short"] is True
    assert json.loads(got["long"]["reply"]) == {"final": {"notes": ["one q....", "three...."], "quotes": ["q"], "facts": []}}
    assert (got["lost"]["reply"], got["lost"]["error"]) == (None, "no notes") and "none" not in got


def test_garbled_quotes(spark):
    def backend(prompts, n):
        return ['{"bad": [{"i": 1, "s": "blx"}, {"i": 0, "s": "not there"}, {"i": "x", "s": "a"}, {"i": 9, "s": "a"}, {"i": 2, "s": ""}]}' if "blx" in p else "no" for p in prompts]

    q = [("a", 0, "one"), ("a", 1, "two blx"), ("a", 2, "three"), ("b", 0, "blx alone"), ("c", 0, "x"), ("c", 1, None)]
    got = {(r["d"], r["i"]): r["garbled"] for r in S.ungarbled(rows(spark, q, "d string, i int, t string"), "d", "i", "t", backend).collect()}
    assert got == {("a", 0): None, ("a", 1): "blx", ("a", 2): None, ("b", 0): None, ("c", 0): None, ("c", 1): None}


def test_quotes_stay_beside_their_prompt(spark):
    """They are dealt once and never joined with what is said of them."""
    out = QUERIES["udf_05_asked"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1

    def backend(prompts, n):
        return ['{"bad": [{"i": 1, "s": "b"}, {"i": 1, "s": " a "}, {"i": "2", "s": null}, {"i": 3}, {"i": null, "s": "x"}]}' if p.startswith("1. ") else '{"bad": "x"}' for p in prompts]

    q = [("a", 1, "x  b"), ("a", 1, "a"), ("a", 2, None), ("a", None, "x"), (None, 1, "a"), (None, 2, "b"), ("c", 2, "b"), ("c", 3, "a")]
    got = sorted(S.ungarbled(rows(spark, q, "d string, i int, t string"), "d", "i", "t", backend).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(*x, "a" if x[:2] == ("a", 1) else None) for x in q], key=lambda x: str(Row(d=x[0], i=x[1], t=x[2], garbled=x[3])))
    empty = S.answered(rows(spark, [(1, None)], "k int, p string"), "p", backend).collect()
    assert [tuple(r) for r in empty] == [(1, None, None, 0, "no prompt")]


def test_reviews_glyphs_and_rewriting(spark):
    review = lambda prompts, n: ['{"score": 6.5, "dims": {"density": 7, "chinese": "8"}, "verdict": "publishable", "worst": "w"}' for _ in prompts]
    r = S.reviewed(rows(spark, [(1, "draft")], "k int, p string"), "k", "p", review, "r").first()
    assert (r["score"], r["density"], r["chinese"], r["faithful"], r["verdict"], r["why"], r["worst"]) == (6.5, 7.0, 8.0, None, "publisha", "", "w")

    said = {"xay": '{"ok": true}', "xey": '{"ok": false, "fix": "xay"}', "xiy": '{"ok": false, "fix": "zay"}', "xoy": '{"ok": true, "unsure": true}', "xuy": "junk"}
    second = lambda prompts, n: ['{"garbled": true}' if p == "xoy" else "junk" for p in prompts]
    c = rows(spark, [(x,) for x in said], "k string").selectExpr("k", "k as c")
    got = {r["k"]: (r["state"], r["fix"]) for r in S.glyphs(c, "k", "c", lambda p, n: [said[x] for x in p], second, "aeiou").collect()}
    assert got == {"xay": ("ok", None), "xey": ("fix", "xay"), "xiy": ("pending", None), "xoy": ("ok", None), "xuy": ("pending", None)}

    table = rows(spark, [(1, "old", "x"), (2, "old", "y"), (3, None, "z")], "k int, t string, other string")
    new = S.translated(table.where("k < 3"), "k", "t", lambda p, n: ['{"text": " new  name "}' if n else "junk" for _ in p])
    assert sorted(map(tuple, S.rewritten(table.where("k <> 2"), "k", "t", new).collect())) == [(1, "new name", "x"), (3, None, "z")]
    han = S.translated(table, "k", "other", lambda p, n: ['{"text": "还没有翻译出来的一段话"}' for _ in p])
    assert {r["text"] for r in han.collect()} == {None}
