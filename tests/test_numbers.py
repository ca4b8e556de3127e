"""Numbers spoken in a text, read once, against a search for each rendering by itself."""

import random
import re

import pytest

from lectern.functions import numbers as N


def searched(value, text):
    hay = f" {N.normal(text)} "
    for m in N.NUMBER.finditer(value):
        scale = N.SCALE.search(N.NUMBER.split(value[m.end() : m.end() + 12])[0])
        x = float(m.group().replace(",", "")) * (N.SCALES[scale.group().lower()] if scale else 1)
        if not any(re.search(rf"(?<![\w.,]){re.escape(f)}(?!\w|[.,]\d)", hay) for f in N.renderings(x)):
            return False
    return True


def test_reading_equals_searching():
    rng = random.Random(5)
    values = ["5", "12", "0.5", "2014", "1905", "1,200", "1.5 million", "3千", "12万", "1.2亿", "250 thousand", "0.75", "99", "100", "7 and 8", "2.25", "1,000,000", "x"]
    said = [*N.SAID, "word", "12", "1,200", "1200", "0.5", "1.5", "2014", "99", "250", "十二", "五", "一百", "九十九"]
    both = set()
    for _ in range(6000):
        value = rng.choice(values)
        if rng.random() < 0.6:
            number = float(N.NUMBER.search(value).group().replace(",", "")) if N.NUMBER.search(value) else 3.0
            parts = [rng.choice(N.renderings(number * rng.choice([1, 1, 1e3, 1e4, 1e6, 1e8])))]
        else:
            parts = []
        parts += [rng.choice(said) for _ in range(rng.randrange(5))]
        rng.shuffle(parts)
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "-", ", ", ".", ",", ". ", "%", " ($", "\n", "x", ""]) for x in parts)
        got = N.grounded(value, text)
        assert got == searched(value, text), (value, text)
        both.add(got)
    assert both == {True, False}


@pytest.mark.parametrize(
    ("value", "text", "found"),
    [("2014", "back in twenty-fourteen", True), ("2.5", "two and a half times", True), ("1.2亿", "some 120 million people", True), ("12", "$12.", True), ("12", "112", False), ("12", "12.5", False), ("5", "3 .. 5", True), ("7", None, False), (None, "x", True), ("105", "one hundred and five", True)],
)
def test_cases(value, text, found):
    assert N.grounded(value, text) == found
