"""Column functions on text, times and numbers. All stay in the JVM but where the docstring says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(s: Column) -> Column:
    """STR-F02: white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def norm_title(s: Column) -> Column:
    """STR-F03 without compatibility folding: lower case, no leading number, ASCII letters, digits and Han only."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"^\s*#?\d+\s*[-.:|]\s*", ""), "[^0-9a-z一-鿿]", "")


def fingerprint(title: Column, seconds: Column) -> Column:
    """STR-F04: 16 hex digits of SHA-1 over the normal title and the two-minute bucket of the length, if known."""
    bucket = F.coalesce(F.floor(seconds / 120).cast("string"), F.lit(""))
    return F.substring(F.sha1(F.concat(norm_title(title), F.lit("|"), bucket).cast("binary")), 1, 16)


def stable_id(source: Column, guid: Column) -> Column:
    """STR-F05."""
    return F.concat(source, F.lit("-"), F.substring(F.sha1(guid.cast("binary")), 1, 10))


def slug(s: Column, longest: int = 60) -> Column:
    """STR-F06: letters and digits joined by hyphens, `episode` if nothing is left."""
    x = F.regexp_replace(F.lower(s), r"[^a-z0-9ß-ɏ一-鿿]+", "-")
    x = F.regexp_replace(F.substring(F.regexp_replace(x, "^-+|-+$", ""), 1, longest), "-+$", "")
    return F.when(F.length(x) > 0, x).otherwise(F.lit("episode"))


def redact(s: Column) -> Column:
    """STR-F07: values of key-like assignments and bearer tokens are masked."""
    return F.regexp_replace(s, r"(?i)\b(token|secret|password|api_key)(\s*[=:]\s*)\"?[A-Za-z0-9_\-]{8,}\"?", "$1$2***")


def escape_html(s: Column) -> Column:
    """STR-F33."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def url_normal(u: Column) -> Column:
    """STR-F17: without scheme and query."""
    return F.regexp_replace(F.split_part(u, F.lit("?"), F.lit(1)), "^[a-z]+://", "")


def url_host(u: Column) -> Column:
    """STR-F20."""
    return F.lower(F.regexp_extract(u, "^[a-z]+://([^/:?#]+)", 1))


def word_count(s: Column) -> Column:
    """STR-F23 for Latin text."""
    return F.regexp_count(s, F.lit("[A-Za-z0-9']+"))


def distinct_tokens(s: Column) -> Column:
    """STR-F21: distinct lower-case words of two or more letters, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]{2,})"), 1))


def parse_clock(s: Column) -> Column:
    """DT-01: seconds of `s`, `m:s` or `h:m:s`; null if a part is no number, or the sum is 0."""
    parts = F.split(s, ":")
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))
    return F.when(F.size(parts) <= 3, F.nullif(total.cast("int"), F.lit(0)))


def clock(seconds: Column) -> Column:
    """DT-03: `h:mm:ss` or `m:ss`; negatives are 0, null is empty."""
    s = F.greatest(seconds.cast("int"), F.lit(0))
    h, m, r = (s / 3600).cast("int"), (s / 60).cast("int") % 60, s % 60
    return F.coalesce(F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r)), F.lit(""))


def iso(ts: Column) -> Column:
    """DT-05."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_date(lead: Column, upload: Column) -> Column:
    """DT-06: a lead's partial date filled up; a month or year that fits the upload's takes the upload's date."""
    filled = F.when(F.length(lead) == 10, lead).when(F.length(lead) == 7, F.concat(lead, F.lit("-01"))).when(F.length(lead) == 4, F.concat(lead, F.lit("-01-01")))
    return F.to_date(F.when((F.length(lead) < 10) & F.startswith(upload, lead), upload).otherwise(F.coalesce(filled, upload)))


def seek_tolerance(seconds: Column) -> Column:
    """Seconds by which two recordings of one talk may differ: 1 % within 40 to 90."""
    return F.least(F.lit(90), F.greatest(F.lit(40), (seconds * 0.01).cast("int")))


def quote_in(quote: Column, text: Column) -> Column:
    """JOIN-12 on normal forms: every run of at least 12 characters between elisions occurs, and there is one."""
    runs = F.filter(F.transform(F.split(quote, "…|\\.\\.\\."), F.trim), lambda r: F.length(r) >= 12)
    return (F.size(runs) > 0) & F.forall(runs, lambda r: F.contains(text, r))


def gate_passes(score: Column, least: float, when_unknown: bool) -> Column:
    """FLT-16: a missing triage score passes, a missing review score doesn't."""
    return F.coalesce(score >= least, F.lit(when_unknown))


def blob_hash(s: Column) -> Column:
    """AUX-26: the hash under which a content store keeps a file."""
    body = s.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(body).cast("string"), F.lit("\x00")), "utf-8"), body))
