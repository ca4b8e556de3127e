"""Conversation structure: what is wrong with the order of turns, and the cheapest edits that repair it, by dynamic programming over compressed ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, materialize
from .neardup import BROADCAST_ROWS

#: What counts as white space, and what may end a turn.
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: A conversation's turns are worked on in segments of at most so many turns, or characters and one turn; the repaired text travels in pieces.
TURNS, CHARS, PIECE = 1 << 14, 1 << 20, 1 << 15
COSTS = {"D": 4, "K": 0, "R": 3, "I": 3}
#: Cost added for a truncated turn that stays.
TRUNCATED = 3

#: States of the repaired order: nothing yet, a system turn, a user's turn, an assistant's turn. The first and the last may end it.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The insertions that end the order, by state.
ENDINGS = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

#: Codes of the macro edits, a run of insertions and what becomes of the turn after it, in the order of their letters. None begins another, so
#: sequences of equally many macros compare by their first unequal code. Three insertions and more end where one or two fewer do, and cost more.
CODES = sorted("I" * run + edit for run, edit in product(range(3), "DKR"))
FAR = 1 << 60


def _after(state: int) -> int:
    """The state after a user's or an assistant's turn, whichever may follow."""
    return ASSISTANT if state == USER else USER


def _moves(initial: str, forced: bool, truncated: bool) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, code): the cheapest macro between each two states, of equally cheap ones that with the first code, for a turn of this kind."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state, (code, macro) in product(NEXT, enumerate(CODES)):
        to, edit = state, macro[-1]
        for _ in macro[:-1]:
            to = _after(to)
        if edit == "K":
            to = NEXT[to].get(initial, -1)
        elif edit == "R":
            to = _after(to)
        if to < 0 or forced and edit != "D":
            continue
        cost = sum(COSTS[e] for e in macro) + (TRUNCATED if truncated and edit != "D" else 0)
        best[state, to] = min(best.get((state, to), (FAR, 0)), (cost, code))
    return [(a, b, *v) for (a, b), v in best.items()]


MOVES = {(i, f, t): _moves(i, f, t) for i, f, t in product(("s", "u", "a", ""), (False, True), (False, True))}


def kind(role: str, forced: bool, truncated: bool) -> tuple[str, bool, bool]:
    """The key of MOVES for a turn."""
    return (role[:1] if role[:1] in ("s", "u", "a") else "", forced, truncated)


class Layers:
    """Cheapest macro sequences from one state over turns, a layer for each turn.

    A layer keeps, for each state, a cost and the rank of its edits among the layer's, in place of the edits themselves: edits of equally many macros
    compare as (rank one layer before, code). Parents and codes, a byte each, give the edits back.
    """

    def __init__(self, entry: int):
        self.cost, self.rank = [FAR] * 4, [0] * 4
        self.cost[entry] = 0
        self.back = bytearray()

    def add(self, kind: tuple[str, bool, bool]) -> None:
        new: list[tuple[int, int, int, int]] = [(FAR, 0, 0, 0)] * 4
        cost, rank = self.cost, self.rank
        for a, b, c, code in MOVES[kind]:
            if cost[a] < FAR:
                new[b] = min(new[b], (cost[a] + c, rank[a], code, a))
        order = sorted((n[1], n[2]) for n in new if n[0] < FAR)
        self.cost = [n[0] for n in new]
        self.rank = [order.index((n[1], n[2])) if n[0] < FAR else 0 for n in new]
        self.back += bytes(n[3] * len(CODES) + n[2] for n in new)

    def macros(self, exit: int) -> list[str]:
        """The edits that lead to a state, turn by turn."""
        out = []
        for layer in range(len(self.back) // 4 - 1, -1, -1):
            exit, code = divmod(self.back[4 * layer + exit], len(CODES))
            out.append(CODES[code])
        return out[::-1]


def ending(cost: list[int], rank: list[int]) -> int:
    """The state in which the cheapest edits end, ties by their letters."""
    return min((cost[s] + sum(COSTS[e] for e in ENDINGS[s]), rank[s], s) for s in NEXT)[2]


def rewritten(state: int, turns: Iterable[tuple[str, str]], macros: list[str]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of turns whose edits begin in state."""
    for (role, text), macro in zip(turns, macros):
        for edit in macro:
            if edit == "K":
                state = NEXT[state][role[0]]
                yield role, text
            elif edit != "D":
                state = _after(state)
                yield ROLE[state], text if edit == "R" else ""


def closing(state: int) -> Iterator[tuple[str, str]]:
    for _ in ENDINGS[state]:
        state = _after(state)
        yield ROLE[state], ""


def digest(turns: Iterable[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode("utf-8", "replace")).hexdigest()


def damaged(rows: DataFrame, *, drop: bool = True) -> DataFrame:
    """(conv, turn, role, text, n) of (conv, turn, role, text), n copies, damaged by crc32(`conv:turn`) % 20.

    0 drops a turn, 1 empties its text, 2 takes its stops away, 3 repeats it, 4 makes it the user's; nulls count as a space. Without drop, dropped
    turns stay with n = 0 and nothing but conv.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(shown("conv"), F.lit(":"), shown("turn"))) % 20
    rows = rows.select("conv", "turn", shown("role").alias("role"), shown("text").alias("text"), k.alias("k"))
    kept = lambda c: F.when(F.col("k") != 0, c)
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv", kept(F.col("turn")).alias("turn"), kept(F.when(F.col("k") == 4, "user").otherwise(F.col("role"))).alias("role"), kept(text).alias("text"),
        F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("n"),
    )
    return rows.where("n > 0") if drop else rows


def _ended(text: Column) -> Column:
    """The text's last character that is no white space."""
    return F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)


def flagged(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """rows (conv, turn, role, text, n), equal ones as one, with blank, later (the same role and text come at an earlier turn) and truncated; and what was written."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    slim = rows.where("n > 0").groupBy("conv", "role", F.sha2("text", 256).alias("sha")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    again = materialize(slim.where("first != last").select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), "sha", "first"))
    side = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    equal = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    joined = equal.join(side, equal["conv"].eqNullSafe(side["_conv"]) & (equal["role"] == side["_role"]) & (F.sha2(equal["text"], 256) == side["sha"]), "left")
    end = _ended(F.col("text"))
    out = joined.select(
        *rows.columns, (end == "").alias("blank"), F.coalesce(F.col("first") != place, F.lit(False)).alias("later"), (~end.isin(*STOPS)).alias("truncated"),
    )
    return out, [again]


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SEGMENT = "turns long, first_turn long, last_turn long, first_role string, last_role string, costs array<long>, ranks array<int>, entry int, exit int"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Segment:
    """Turns of one conversation that follow each other, and the sums over them."""

    def __init__(self):
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.kinds: list[tuple[str, bool, bool]] = []
        self.n = dict.fromkeys(COUNTS, 0)
        self.turns, self.first, self.last = 0, None, None
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            self.n[fault] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.n["illegal"] += 1
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.kinds.append(kind(role, fault in ("blank", "duplicate"), fault == "truncated"))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def layers(self, entry: int) -> Layers:
        out = Layers(entry)
        for k in self.kinds:
            out.add(k)
        return out

    def result(self) -> dict:
        """What a conversation of just these turns gives."""
        layers = self.layers(NOTHING)
        end = ending(layers.cost, layers.rank)
        macros = layers.macros(end)
        repaired = [*rewritten(NOTHING, zip(self.roles, self.texts), macros), *closing(end)]
        cost = layers.cost[end] + sum(COSTS[e] for e in ENDINGS[end])
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.n | {"gaps": gaps if gaps < 1 << 63 else None, "cost": cost, "audit": "".join(macros) + ENDINGS[end], "repaired_sha256": digest(repaired)}

    def summary(self) -> dict:
        """What the segments around need to know, and the turns themselves."""
        all_ = [self.layers(s) for s in NEXT]
        return self.n | {
            "turns": self.turns, "first_turn": self.first, "last_turn": self.last, "first_role": self.roles[0] if self.roles else None, "last_role": self.roles[-1] if self.roles else None,
            "costs": [c for x in all_ for c in x.cost], "ranks": [r for x in all_ for r in x.rank], "roles": self.roles, "texts": self.texts, "kinds": ["".join(map(str, (k[0] or "-", int(k[1]), int(k[2])))) for k in self.kinds],
        }


def chained(parts: list[dict]) -> list[dict]:
    """Segments' summaries of one conversation, in order, with the states in which the cheapest edits enter and leave each; the last has the whole's sums."""
    cost, rank, back = [0, FAR, FAR, FAR], [0] * 4, []
    for p in parts:
        new = [(FAR, 0, 0, 0)] * 4
        for a, b in product(NEXT, NEXT):
            if cost[a] < FAR and p["costs"][4 * a + b] < FAR:
                new[b] = min(new[b], (cost[a] + p["costs"][4 * a + b], rank[a], p["ranks"][4 * a + b], a))
        order = sorted((n[1], n[2]) for n in new if n[0] < FAR)
        cost, rank = [n[0] for n in new], [order.index((n[1], n[2])) if n[0] < FAR else 0 for n in new]
        back.append([n[3] for n in new])
    at = ending(cost, rank)
    total = {c: sum(p[c] for p in parts) for c in COUNTS} | {"cost": cost[at] + sum(COSTS[e] for e in ENDINGS[at])}
    out, last_role, last_turn, turns, first = [], None, None, 0, None
    for p in parts:
        if p["first_role"] is not None:
            total["illegal"] += last_role is not None and last_role[:1] + p["first_role"][:1] not in ("su", "ua", "au")
            last_role = p["last_role"]
        if p["turns"]:
            turns += p["turns"] - (p["first_turn"] == last_turn)
            first, last_turn = p["first_turn"] if first is None else first, p["last_turn"]
    gaps = last_turn - first + 1 - turns if turns else 0
    for p, b in zip(parts[::-1], back[::-1]):
        out.append({"part": p["part"], "seg": p["seg"], "entry": b[at], "exit": at, "whole": None})
        at = b[at]
    out[0]["whole"] = total | {"gaps": gaps if gaps < 1 << 63 else None}
    return out[::-1]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: [r.get(f.name) for r in rows] for f in schema}, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _fields(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def segments(rows: DataFrame, *, turns: int = TURNS, chars: int = CHARS) -> DataFrame:
    """Segments of flagged() rows in the order of conv, turn (nulls first), role and text.

    Rows are ranged by that order, so a conversation of any size lies in tasks that follow each other. One that lies within a task and a segment is
    done there (whole); of the others, in two tasks or more or perhaps so, segments come with what chained() needs and their turns.
    """
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64)]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    conv = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, part int, seg int, whole boolean, {RESULT}, {SEGMENT.replace(', entry int, exit int', '')}, roles array<string>, texts array<string>, kinds array<string>"
    arrow = _arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        none = object()
        held, segment, conv, seg, inner = [], Segment(), none, 0, False

        def finish(open_: bool) -> None:
            nonlocal seg
            if inner and seg == 0 and not open_:
                held.append({"conv": conv, "part": part, "seg": 0, "whole": True} | segment.result())
            elif segment.roles or seg == 0:
                held.append({"conv": conv, "part": part, "seg": seg, "whole": False} | segment.summary())
            seg += 1

        for batch in batches:
            for c, turn, role, text, n, blank, later, truncated in zip(*[batch.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "n", "blank", "later", "truncated")]):
                if conv is none or c != conv:
                    if conv is not none:
                        finish(False)
                        inner = True
                    segment, conv, seg = Segment(), c, 0
                for copy in range(n):
                    if len(segment.roles) >= turns or segment.chars >= chars:
                        finish(True)
                        segment = Segment()
                    segment.add(turn, role, text, blank, bool(later or copy), truncated)
                if len(held) >= 2000:
                    yield _batch(held, arrow)
                    held.clear()
        if conv is not none:
            finish(True)
        yield _batch(held, arrow)

    return ordered.mapInArrow(cut, schema)


def repair(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = True, turns: int = TURNS, chars: int = CHARS) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every key, after damage() if asked for.

    Turns are taken in order, those without a number first; at one turn by role and text. A turn's first fault counts: blank, duplicate (role and text
    seen earlier) or truncated. audit holds the cheapest edits' initials, of equally cheap ones the first by ASCII, and the digest is that of the
    repaired turns. Null keys are a conversation; null roles and texts are a space. A conversation all of whose turns are dropped has zeros, no
    edits and the empty text's digest; an empty table gives no rows. Repeated rows are duplicates. Input columns other than the four aren't read.

    Conversations of any number of turns: their segments are searched in parallel, then chained through 16 costs and ranks a segment;
    only the digest, which can't be taken in parallel, reads a conversation's repaired text in one task, as a stream.
    """
    named = [F.col(f"`{c}`").alias(a) for c, a in ((key, "conv"), (turn, "turn"), (role, "role"), (text, "text"))]
    rows = conversations.select(*named).withColumns({"turn": F.col("turn").cast("long"), "role": F.col("role").cast("string"), "text": F.col("text").cast("string")})
    if damage:
        rows = damaged(rows, drop=False)
    else:
        rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}).withColumn("n", F.lit(1).cast("long"))
    marked, written = flagged(rows)
    found = materialize(segments(marked, turns=turns, chars=chars))
    discard(*written)
    names = _fields(RESULT)
    whole = found.where("whole").select("conv", *names)
    left = found.where("not whole")
    return whole.unionByName(_joined(left, names)).withColumnRenamed("conv", key)


def _joined(left: DataFrame, names: list[str]) -> DataFrame:
    """(conv, *names) of conversations in several segments, or in one at a task's edge."""
    conv = left.schema["conv"].dataType.simpleString()
    slim = [*COUNTS, *_fields(SEGMENT)[:-2]]
    totals = ", ".join(f"{c} long" for c in ("gaps", *COUNTS, "cost"))

    chain_schema = f"conv {conv}, part int, seg int, entry int, exit int, place int, last boolean, {totals}"
    chain_arrow = _arrow(chain_schema)

    def chain(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda p: (p["part"], p["seg"]))
        out = [{k: r[k] for k in ("part", "seg", "entry", "exit")} | {"conv": parts[0]["conv"], "place": i, "last": i == len(parts) - 1} | (r["whole"] or {}) for i, r in enumerate(chained(parts))]
        return pa.Table.from_batches([_batch(out, chain_arrow)])

    chains = materialize(left.select("conv", "part", "seg", *slim).groupBy("conv").applyInArrow(chain, chain_schema))
    turns = left.select("part", "seg", F.col("conv").alias("_conv"), "roles", "texts", "kinds")
    same = (chains["part"] == turns["part"]) & (chains["seg"] == turns["seg"]) & chains["conv"].eqNullSafe(turns["_conv"])
    dealt = chains.join(turns, same).select(chains["conv"], "place", "last", "entry", "exit", "roles", "texts", "kinds")

    piece_schema = f"conv {conv}, place int, piece int, audit string, text string"
    piece_arrow = _arrow(piece_schema)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            layers = Layers(r["entry"])
            for k in r["kinds"]:
                layers.add(("" if k[0] == "-" else k[0], k[1] == "1", k[2] == "1"))
            macros = layers.macros(r["exit"])
            repaired = [*rewritten(r["entry"], zip(r["roles"], r["texts"]), macros), *(closing(r["exit"]) if r["last"] else ())]
            text = "".join(f"{a}:{b}\n" for a, b in repaired)
            audit = "".join(macros) + (ENDINGS[r["exit"]] if r["last"] else "")
            at = range(0, max(len(text), 1), PIECE)
            yield _batch([{"conv": r["conv"], "place": r["place"], "piece": i // PIECE, "audit": "" if i else audit, "text": text[i : i + PIECE]} for i in at], piece_arrow)

    pieces = dealt.mapInArrow(rewrite, piece_schema)
    pieces = pieces.repartition("conv").sortWithinPartitions("conv", "place", "piece")

    digest_schema = f"conv {conv}, audit string, repaired_sha256 string"
    digest_arrow = _arrow(digest_schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One conversation's pieces after another's; each piece is forgotten once it is in the digest. The newline after the last turn stays out."""
        conv, audits, sha, rest, any_ = None, [], hashlib.sha256(), b"", False
        done = lambda: _batch([{"conv": conv, "audit": "".join(audits), "repaired_sha256": sha.hexdigest()}], digest_arrow)
        for r in (r for b in batches for r in b.to_pylist()):
            if any_ and r["conv"] != conv:
                yield done()
                audits, sha, rest = [], hashlib.sha256(), b""
            conv, any_ = r["conv"], True
            audits.append(r["audit"])
            if r["text"]:
                data = rest + r["text"].encode("utf-8", "replace")
                data, rest = (data[:-1], b"\n") if data.endswith(b"\n") else (data, b"")
                sha.update(data)
        if any_:
            yield done()

    digests = pieces.mapInArrow(stream, digest_schema).withColumnRenamed("conv", "_conv")
    ends = chains.where("last")
    return ends.join(digests, ends["conv"].eqNullSafe(digests["_conv"])).select(ends["conv"], *names)
