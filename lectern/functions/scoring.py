"""Scorers outside the engine as Arrow functions: a scorer is a Python callable over texts, asked in batches, and what it says is checked before it counts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def scored(rows: DataFrame, key: str, text: str, scorer: Callable[[str | None], tuple[float, str]], rubric: str) -> DataFrame:
    """UDF-02: (key, score, kind, rubric) as scorer says for each text; where it fails, score and kind are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [_safely(scorer, x) for x in b[text]]
            yield pd.DataFrame({key: b[key], "score": pd.Series([s and s[0] for s in said], dtype="float64"), "kind": [s and s[1] for s in said], "rubric": rubric})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, score double, kind string, rubric string")


def _safely(scorer: Callable, x: str | None):
    try:
        return scorer(x)
    except Exception:  # noqa: BLE001 - a scorer may fail in any way
        return None


def by_length(text: str | None) -> tuple[float, str]:
    """A scorer for tests."""
    n = len(text) % 11
    return float(n), "core" if n >= 7 else "other"


def completed(rows: DataFrame, key: str, prompt: str, answer: Callable[[int, str, int], str], retries: int) -> DataFrame:
    """UDF-01: (key, k, asked): the field k of the first answer that is a JSON object, asked again at most retries times; null if none is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, x in zip(b[key], b[prompt], strict=True):
                for n in range(retries + 1):
                    found = _safely(json.loads, answer(i, x, n))
                    if isinstance(found, dict):
                        break
                out.append((i, found.get("k") if isinstance(found, dict) else None, n + 1))
            yield pd.DataFrame(out, columns=[key, "k", "asked"]).astype({"k": "Int64"})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, k long, asked int")


def answers_late(i: int, prompt: str, n: int) -> str:
    """An answerer for tests: the prompt itself at its (i % 4)-th try."""
    return prompt if n == i % 4 else "I think so"


def counting(prompts: list[str], attempt: int) -> list[str | Exception | None]:
    """A backend for tests that counts: of prompts whose length leaves 3 by 7 it fails, by 5 it answers junk, by 2 it answers at the second try only."""
    out: list[str | Exception | None] = []
    for p in prompts:
        n = len(p)
        if n % 7 == 3:
            out.append(ConnectionError("gone"))
        elif n % 7 == 5 or (n % 7 == 2 and attempt == 0):
            out.append("I think so")
        else:
            spaces = p.count(" ")
            reply = {"score": spaces % 13 - 1, "why": f" {n}  long ", "kind": "core" if spaces % 2 else "other", "cat": ("core", " other", "??")[spaces % 3], "verdict": "fine", "dims": {"density": n % 10, "faithful": spaces % 10}, "notes": [str(n)]}
            out.append(f"Here it is: {json.dumps(reply)}")
    return out


def adding(prompts: list[str], attempt: int) -> list[str]:
    """A backend for tests: of notes that are numbers, how many there are and their sum; of other prompts, their length as a note."""
    out = []
    for p in prompts:
        notes = [int(x) for x in json.loads(p)["notes"]] if p.startswith('{"notes":') else None
        out.append(json.dumps({"notes": [str(len(p))]} if notes is None else {"n": len(notes), "sum": sum(notes)}))
    return out


def suspecting(prompts: list[str], attempt: int) -> list[str]:
    """A backend for tests: of numbered lines, reports a 77 in those that have one, and in the others something they don't hold."""
    lines = [[line.partition(". ") for line in p.split("\n")] for p in prompts]
    return [json.dumps({"bad": [{"i": int(i), "s": "77" if "77" in text else "none such"} for i, _, text in x]}) for x in lines]
