"""NUM-01, NUM-02: whether the numbers of a value are spoken in a text. An Arrow-batched UDF; renderings of a number are spelt out by rule."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English number words, Chinese digits, scale words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
HAN = "零一二三四五六七八九"
SCALES = {"千": 1e3, "万": 1e4, "亿": 1e8, "万亿": 1e12, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
SPOKEN = [("trillion", 1e12), ("billion", 1e9), ("million", 1e6), ("thousand", 1e3), ("hundred", 1e2)]
FRACTIONS = {0.5: "half", 0.25: "quarter", 0.75: "three quarters"}

NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?")
SCALE = re.compile("万亿|" + "|".join(sorted(SCALES, key=len, reverse=True)), re.I)


def below_hundred(n: int) -> str:
    return UNITS[n] if n < 20 else TENS[n // 10] + (f" {UNITS[n % 10]}" if n % 10 else "")


def words(n: int, joint: str = " ") -> str:
    """A whole number in English; joint stands between hundreds and the rest (` and ` or a space)."""
    if n < 100:
        return below_hundred(n)
    if n < 1000:
        return f"{UNITS[n // 100]} hundred" + (joint + below_hundred(n % 100) if n % 100 else "")
    for name, size in SPOKEN:
        if n >= (size := int(size)):
            rest = n % size
            return f"{words(n // size, joint)} {name}" + ((joint if rest < 100 else " ") + words(rest, joint) if rest else "")
    return UNITS[0]


def year_words(n: int) -> str:
    """`twenty fourteen`, `nineteen oh five`, `nineteen hundred`."""
    high, low = divmod(n, 100)
    return f"{below_hundred(high)} " + ("hundred" if low == 0 else f"oh {UNITS[low]}" if low < 10 else below_hundred(low))


def han(n: int) -> str:
    """A number under 100 in Chinese."""
    tens, ones = divmod(n, 10)
    return HAN[n] if n < 10 else ("" if tens == 1 else HAN[tens]) + "十" + (HAN[ones] if ones else "")


def plain(x: float) -> list[str]:
    """Forms of a number without any scale."""
    if x == int(x):
        n = int(x)
        out = [str(n), f"{n:,}", words(n), words(n, " and ")]
        if 1100 <= n <= 2099:
            out.append(year_words(n))
        return out + ([han(n)] if n < 100 else [])
    text = f"{x:.6f}".rstrip("0")
    whole, part = text.split(".")
    out = [text, f"{words(int(whole))} point {' '.join(UNITS[int(d)] for d in part)}"]
    if (idiom := FRACTIONS.get(round(x - int(x), 6))) is not None:
        one = idiom if idiom.startswith("three") else f"a {idiom}"
        out.append(f"{words(int(x))} and {one}" if int(x) else idiom)
    return out


def renderings(x: float) -> list[str]:
    """NUM-02: the number as such and restated in each scale in which it has at most three decimals; sums within 1e-6 of a whole snap to it."""
    snap = lambda v: float(round(v)) if abs(v - round(v)) < 1e-6 * max(1.0, abs(v)) else v
    out = plain(snap(x))
    for name, size in SPOKEN:
        v = snap(x / size)
        if v >= 0.1 and abs(v * 1000 - round(v * 1000)) < 1e-6:
            out += [f"{form} {name}" for form in plain(v)]
    return out


def normal(text: str) -> str:
    """Lower case, hyphens and line breaks as single spaces."""
    return re.sub(r"[\s\-‐-―]+", " ", text.lower())


#: Words that numbers are said in, beside digits and Han digits.
SAID = sorted({*UNITS, *TENS, *(name for name, _ in SPOKEN), *" ".join(FRACTIONS.values()).split(), "and", "point", "oh", "a"}, key=len, reverse=True)
TOKEN = re.compile(rf"(?<![\w.,])(?:[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?|{'|'.join(SAID)}|[{HAN}十]+)(?!\w|[.,]\d)")


class Spoken:
    """The number words of a text, read once, with the places of each; a number is in the text if the words of one of its forms follow each other there."""

    def __init__(self, text: str):
        hay = f" {normal(text)} "
        self.words: list[str] = []
        self.places: dict[str, list[int]] = {}
        end = -1
        for m in TOKEN.finditer(hay):
            if m.start() != end + 1 or hay[end] != " ":
                self.words.append("")  # other words stand between
            self.places.setdefault(m[0], []).append(len(self.words))
            self.words.append(m[0])
            end = m.end()

    def holds(self, form: list[str]) -> bool:
        rarest = min(range(len(form)), key=lambda i: len(self.places.get(form[i], ())))
        return any(p >= rarest and self.words[p - rarest : p - rarest + len(form)] == form for p in self.places.get(form[rarest], ()))


@functools.lru_cache(maxsize=1024)
def forms(x: float) -> list[list[str]]:
    """The words of each rendering of a number."""
    return [form.split(" ") for form in renderings(x)]


@functools.lru_cache(maxsize=1)
def spoken(text: str) -> Spoken:
    """The last text's words are kept, as its values follow each other."""
    return Spoken(text)


def grounded(value: str | None, text: str | None) -> bool:
    """NUM-01: every number of value occurs in text in some rendering, as whole words; a scale word up to 12 characters after it multiplies it. True if value has no digits; null counts as empty."""
    value = value or ""
    for m in NUMBER.finditer(value):
        x = float(m.group().replace(",", ""))
        ahead = NUMBER.split(value[m.end() : m.end() + 12])[0]
        scale = SCALE.search(ahead)
        if not any(map(spoken(text or "").holds, forms(x * SCALES[scale.group().lower()] if scale else x))):
            return False
    return True


_grounded = F.udf(grounded, T.BooleanType(), useArrow=False)


def number_in(value: Column, text: Column) -> Column:
    """NUM-01 as a column."""
    return _grounded(value, text)


@F.udf(T.ArrayType(T.BooleanType()), useArrow=False)
def _grounded_each(values: list[str | None] | None, text: str | None) -> list[bool] | None:
    return None if values is None else [grounded(v, text) for v in values]


def numbers_in(values: Column, text: Column) -> Column:
    """NUM-01 of each of an array of values against one text."""
    return _grounded_each(values, text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _rendered(x: pd.Series) -> pd.Series:
    return x.map(renderings, na_action="ignore")


def rendered(x: Column) -> Column:
    """NUM-02: all forms in which a number may be spoken or written (Arrow)."""
    return _rendered(x)
