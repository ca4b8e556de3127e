"""Conversation repair against an exhaustive search, against string-keeping dynamic programming, and over segments of any size."""

import hashlib
import random
import re
from itertools import product
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import conversations as cv

SF = "/root/testdata/sf0.001"
ROW = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    return out


def exhaustive(turns, most=3):
    """Every sequence of edits with runs of up to most insertions, each rerole and insertion with either role, filtered by the grammar."""
    marks, best = faults(turns), None
    spare = ["user", "assistant"]
    runs = [r for n in range(most + 1) for r in product(spare, repeat=n)]
    options = []
    for (role, text), m in zip(turns, marks):
        stay = 3 * (m == "truncated")
        own = [("D", 4, None)]
        if m not in ("blank", "duplicate"):
            own += [("K", stay, (role, text)), *[("R", 3 + stay, (r, text)) for r in spare]]
        options.append([(r, o) for r in runs for o in own])
    for choice in product(*options, runs):
        audit, cost, out = "", 0, []
        for run, (e, c, kept) in choice[:-1]:
            audit, cost = audit + "I" * len(run) + e, cost + 3 * len(run) + c
            out += [(r, "") for r in run] + ([kept] if kept else [])
        audit, cost = audit + "I" * len(choice[-1]), cost + 3 * len(choice[-1])
        out += [(r, "") for r in choice[-1]]
        if GRAMMAR.fullmatch("".join(r[:1] or " " for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, out
    return best


def by_strings(turns):
    """The same with whole strings at each state: (cost, audit, repaired)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def insert(states):
        out = dict(states)
        for _ in range(4):
            for s, (c, e, r) in list(out.items()):
                for i in step[s]:
                    if i != "s":
                        new = (c + 3, e + "I", [*r, (name[i], "")])
                        out[i] = min(out.get(i, new), new)
        return out

    states = {"": (0, "", [])}
    for (role, text), m in zip(turns, faults(turns)):
        new = {}
        for s, (c, e, r) in insert(states).items():
            moves = [(s, (c + 4, e + "D", r))]
            if m not in ("blank", "duplicate"):
                t = 3 * (m == "truncated")
                moves += [(i, (c + t, e + "K", [*r, (role, text)])) for i in step[s] if i == role[:1]]
                moves += [(i, (c + 3 + t, e + "R", [*r, (name[i], text)])) for i in step[s] if i != "s"]
            for to, v in moves:
                new[to] = min(new.get(to, v), v)
        states = new
    return min(v for s, v in insert(states).items() if s in ("", "a"))


def expected(conv, rows):
    """The contract's columns from rows (turn, role, text) before damage."""
    after = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        after += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[1:] for r in after]
    known = [r[0] for r in after if r[0] is not None]
    marks = faults(turns)
    cost, audit, out = by_strings(turns)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *[marks.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)


def check(spark, rows, **how):
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(tuple(rest))
    df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, ROW)
    got = sorted((tuple(r) for r in cv.repair(df, **how).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)
    assert got == sorted((expected(c, g) for c, g in groups.items()), key=str)


TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["Yes.", "No", " ", "Well?", "x!"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(TURN, max_size=3))
def test_strings_equal_an_exhaustive_search(turns):
    best = exhaustive(turns, 2)
    assert by_strings(turns) == best


@settings(max_examples=300, deadline=None)
@given(st.lists(TURN, max_size=14), st.integers(1, 5))
def test_ranks_equal_strings_in_any_segments(turns, size):
    cost, audit, out = by_strings(turns)
    marks = faults(turns)
    parts, whole = [], cv.Segment()
    for at in range(0, len(turns), size):
        part = cv.Segment()
        for i in range(at, min(at + size, len(turns))):
            row = (i, *turns[i], marks[i] == "blank", marks[i] == "duplicate", marks[i] == "truncated")
            part.add(*row)
            whole.add(*row)
        parts.append(part)
    got = whole.result()
    assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, cv.digest(out))
    if parts:
        chain = cv.chained([{"part": 0, "seg": n} | p.summary() for n, p in enumerate(parts)])
        assert chain[-1]["whole"] == {k: got[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        made = [p.layers(c["entry"]).macros(c["exit"]) for p, c in zip(parts, chain)]
        assert "".join("".join(m) for m in made) + cv.ENDINGS[chain[-1]["exit"]] == audit


def test_codes_are_prefix_free_and_ordered():
    assert cv.CODES == sorted(cv.CODES) and not any(a != b and b.startswith(a) for a in cv.CODES for b in cv.CODES)


@pytest.mark.parametrize("turns", [cv.TURNS, 1, 3])
def test_the_table_equals_a_plain_version(spark, turns):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], turns=turns)


def odd_rows():
    rng = random.Random(3)
    text = lambda: rng.choice(["Yes.", "No", "", " \t", "Well?", "a b!  ", "ü.\n", None, "x" * 3000 + "."])
    role = lambda: rng.choice(["user", "assistant", "system", "tool", "", None, "User"])
    rows = [(c, rng.choice([None, 0, 1, 2, 5, 9, 2**60]), role(), text()) for c in [None, 1, 2, 3, 4, 5, 6, 2**62 + 1, 2**62 + 2] for _ in range(rng.randrange(1, 14))]
    rows += [(7, t, "user" if t % 2 else "assistant", f"said {t % 40}.") for t in range(300)]  # one conversation in many tasks
    rows += [(8, 4, "user", "Again.")] * 50 + [(9, t, "user", "Same.") for t in range(60)]
    return rows + [(c, 0, "user", "x") for c in range(1000, 1040)]


@pytest.mark.parametrize("how", [{}, {"turns": 2}, {"chars": 10}])
def test_odd_conversations(spark, how):
    check(spark, odd_rows(), **how)


def test_pieces_make_one_digest(spark, monkeypatch):
    monkeypatch.setattr(cv, "PIECE", 3)
    df = spark.createDataFrame(odd_rows(), ROW).withColumns({c: F.lit("-") for c in ("conv", "n", "blank", "part", "cost")})
    check(spark, odd_rows(), turns=5)
    assert cv.repair(df, turns=5).count() == len({r[0] for r in odd_rows()}) and cv.repair(df.limit(0)).count() == 0


def test_without_damage(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Oh."), (3, 0, None, None)], ROW)
    got = {r.conv_id: (r.cost, r.audit) for r in cv.repair(df, damage=False).collect()}
    assert got == {1: (0, "KK"), 2: (3, "IK"), 3: (4, "D")}
