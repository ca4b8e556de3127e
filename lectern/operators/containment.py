"""JOIN-12, 13, 25: which texts hold which passages: texts are read once for all strings looked for, and what they hold is joined by equality."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.tables import kept_aside

#: Rows of a string that one task joins; a more frequent one is dealt to several.
HOT = 20_000
#: A side of at most so many rows, which are counted first, is broadcast.
FEW = 100_000
#: Characters of the longest window that is hashed, and of a text that are hashed at once.
WINDOW, STRETCH = 64, 1 << 16
#: Bits of the filter for each string looked for, at least and in all.
SPARSE, LEAST, BITS = 64, 1 << 20, 1 << 29


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _windows(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the windows of n characters) for n = 1, 2, 4 ... longest, as far as there are such windows."""
    h, n, power = codes.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while len(h):
        yield n, h
        if n == longest:
            return
        h = h[:-n] * np.uint64(power) + h[n:]
        n, power = 2 * n, power * power % 2**64


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _window(length: int) -> int:
    """The longest window that begins a string of so many characters; another ends it."""
    return 1 << (min(length, WINDOW).bit_length() - 1)


def _begins(h: np.ndarray, n: int | np.ndarray, group: int) -> np.ndarray:
    """Hashes of windows of n characters as those that begin a string."""
    return ((h ^ np.uint64(group)) + np.asarray(n).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)


def _spans(first: np.ndarray, last: np.ndarray, length: int | np.ndarray, group: int) -> np.ndarray:
    """Hashes of strings of a length, by their first and last windows."""
    return _begins(first * np.uint64(0xC4CEB9FE1A85EC53) + last * np.uint64(0xD6E8FEB86659FD93), WINDOW + length, group)


def _place(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bits that hashes have in a filter of 2 ** bits, by the first or second probe."""
    return hashes * np.uint64((1, 0xD6E8FEB86659FD93)[probe]) >> np.uint64(64 - bits)


def _filter(wanted: DataFrame, group: Column) -> tuple[np.ndarray, int, list[int]]:
    """(words, bits, lengths): a filter of 2 ** bits bits, with two for the beginning of each string _g of a group and two for the whole, and the strings' lengths.

    It has a size of its own: SPARSE bits a string, to BITS in all. With more strings than that it lets more pass, which the joins drop.
    """
    bits = min(max(SPARSE * wanted.count(), LEAST), BITS).bit_length() - 1

    @F.udf(T.ArrayType(T.LongType()), useArrow=False)
    def places(run: str, group: int) -> list[int]:
        n, g = _window(len(run)), group % 2**64
        *_, (_, h) = _windows(_codes(run), n)
        return [int(x[0]) for hashes in (_begins(h[:1], n, g), _spans(h[:1], h[-1:], len(run), g)) for x in (_place(hashes, 0, bits), _place(hashes, 1, bits))]

    at = wanted.select(F.explode(places("_g", group)).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    got = at.groupBy(F.expr("shiftright(at, 6)").alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    words = np.zeros(2**bits // 64, np.uint64)
    words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return words, bits, [r.n for r in wanted.select(F.length("_g").alias("n")).distinct().collect()]


def _held(texts: DataFrame, wanted: DataFrame, group: Column) -> Column:
    """The strings _g of wanted that _text holds, each once, and a few others that the filter lets pass."""
    words, bits, sizes = _filter(wanted, group)
    lengths = {n: np.array([x for x in sizes if _window(x) == n]) for n in map(_window, sizes)}
    longest, overlap = max(lengths, default=0), max(sizes, default=1) - 1
    shared = texts.sparkSession.sparkContext.broadcast(words)

    @F.udf(T.ArrayType(T.StringType()), useArrow=False)
    def held(text: str, group: int) -> list[str]:
        words, out, g, codes = shared.value, set(), group % 2**64, _codes(text)

        def passed(hashes: np.ndarray) -> np.ndarray:
            def holds(place: np.ndarray) -> np.ndarray:
                return np.flatnonzero(words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))

            at = holds(_place(hashes, 0, bits))
            return at[holds(_place(hashes[at], 1, bits))]

        for start in range(0, len(codes) if lengths else 0, STRETCH):
            part = codes[start : start + STRETCH + overlap]
            for n, h in _windows(part, longest):
                if n not in lengths:
                    continue
                found = passed(_begins(h[:STRETCH], n, g))
                step = max(1, STRETCH // len(lengths[n]))  # so many places are tried with all lengths at once
                for some in (found[i : i + step] for i in range(0, len(found), step)):
                    at, length = np.repeat(some, len(lengths[n])), np.tile(lengths[n], len(some))
                    inside = at + length <= len(part)
                    at, length = at[inside], length[inside]
                    hits = passed(_spans(h[at], h[at + length - n], length, g))
                    out.update(text[start + i : start + i + size] for i, size in zip(at[hits].tolist(), length[hits].tolist(), strict=True))
        return list(out)

    # Texts come in batches of 100, not the 10,000 of Arrow, which a task would hold at once.
    return held("_text", group)


def contained(texts: DataFrame, passages: DataFrame, text_key: str, text: str, passage_key: str, passage: str, *, by: str | None = None, hot: int = HOT) -> DataFrame:
    """(text_key, passage_key) of the texts that hold every run of a passage, an array of strings; of the same by, if given. Exact, whatever the strings.

    Texts are read once. At each place a text's windows of 1, 2, 4 ... characters are hashed; where those that begin and end a run of some length are in a
    filter of all runs, the string that lies there is kept. Those strings are few, and joined with the runs by equality. A passage is looked up by the run
    that fewest texts hold; only if it has more than one are its texts searched for the others. A frequent run's rows are dealt to several tasks, a passage
    to each of them. Passages without a run, null keys and null texts match nothing.
    """
    own, keys = (["_by"], ["_g", "_by"]) if by else ([], ["_g"])
    named = [F.col(by).alias("_by")] if by else []
    group = F.xxhash64("_by") if by else F.lit(0).cast("long")
    p = passages.select(F.col(passage_key).alias("_p"), F.filter(F.array_distinct(passage), lambda r: F.length(r) > 0).alias("_runs"), *named)
    p = kept_aside(p.where((F.size("_runs") > 0) & F.col("_p").isNotNull()))
    t = texts.select(F.col(text_key).alias("_t"), F.col(text).alias("_text"), *named).where(F.col("_text").isNotNull() & F.col("_t").isNotNull())

    asked = p.select("_p", *own, F.explode("_runs").alias("_g"))
    wanted = kept_aside(asked.select(*keys).distinct())
    held = kept_aside(t.select("_t", *own, F.explode(_held(t, wanted, group)).alias("_g")))

    counts = held.groupBy(*keys).agg(F.count("*").alias("_n"))
    rated = asked.join(counts, keys, "left").groupBy("_p", *own).agg(F.min_by(F.struct("_g", "_n"), F.struct("_n", "_g")).alias("c"), F.count("*").alias("_a"), F.count("_n").alias("b"))
    chosen = kept_aside(rated.where("_a = b").select("_p", *own, "_a", "c.*").withColumn("_parts", F.ceil(F.col("_n") / hot).cast("int")))
    dealt = chosen.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("_p", "_a", *keys, "_part")
    parts = chosen.groupBy(*keys).agg(F.max("_parts").alias("_parts"))
    rows = held.join(_few(parts), keys).select("_t", *keys, F.pmod(F.xxhash64("_t"), F.col("_parts")).cast("int").alias("_part"))
    tried = rows.join(dealt, [*keys, "_part"])

    found = tried.where("_a = 1").select("_t", "_p")
    if not chosen.where("_a > 1").isEmpty():
        runs = p.where(F.size("_runs") > 1).select("_p", "_runs", *own)
        searched = tried.where("_a > 1").select("_t", "_p").join(_few(runs), "_p").join(t.withColumnRenamed("_by", "_own") if by else t, "_t")
        hit = F.forall("_runs", lambda r: F.contains(F.col("_text"), r))
        if by:
            hit = hit & (F.col("_own") == F.col("_by"))
        found = found.union(searched.where(hit).select("_t", "_p"))
    return found.select(F.col("_t").alias(text_key), F.col("_p").alias(passage_key)).distinct()


def runs_of(quote: Column, normal, *, least: int = 12, elision: str = r"…+|\.{3,}|\[\.{3}\]") -> Column:
    """The runs of a quote between elisions, normalised, that are long enough to be looked for."""
    return F.filter(F.transform(F.split(quote, elision), normal), lambda r: F.length(r) >= least)


def quoted(texts: DataFrame, quotes: DataFrame, text_key: str, text: str, quote_key: str, quote: str, normal, *, least: int = 12, hot: int = HOT) -> DataFrame:
    """JOIN-12: (text_key, quote_key) of the texts in whose normal form every long run of a quote occurs; a quote without one occurs nowhere."""
    asked = quotes.select(F.col(quote_key), runs_of(F.col(quote), normal, least=least).alias("_r"))
    return contained(texts.select(text_key, normal(F.col(text)).alias("_hay")), asked, text_key, "_hay", quote_key, "_r", hot=hot)


def mentions(bodies: DataFrame, titles: DataFrame, by: str, key: str, body: str, title: str, *, title_key: str | None = None, item: Callable[[Column], Column] = lambda k: k, long: int = 18, hot: int = HOT) -> DataFrame:
    """JOIN-13: (key, mentions, chars) of each body: how many titles of other items of its group it holds; short titles don't count, equal ones count once.

    Where an item has several bodies, titles have its key in title_key, and item gives it from a body's key.
    """
    titles = titles.select(by, F.col(title_key or key).alias(key), title)
    own = titles.where((F.length(title) >= long) & F.col(key).isNotNull()).select(by, F.lower(title).alias("_title"), key)
    # A title is the body's own only if no other item of the group has it.
    heads = own.groupBy(by, "_title").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    named = kept_aside(heads.select(F.struct(by, "_title").alias("_id"), F.array("_title").alias("_runs"), by, "_lo", "_hi"))
    found = contained(bodies.select(key, by, F.lower(body).alias("_body")), named, key, "_body", "_id", "_runs", by=by, hot=hot)
    others = found.join(named.select("_id", "_lo", "_hi"), "_id").where((F.col("_lo") != item(F.col(key))) | (F.col("_hi") != item(F.col(key))))
    counted = others.groupBy(key).agg(F.count("*").alias("mentions"))
    return bodies.select(key, F.length(body).alias("chars")).join(counted, key, "left").select(key, F.coalesce("mentions", F.lit(0)).alias("mentions"), "chars")


def same_names(left: DataFrame, right: DataFrame, left_key: str, left_name: str, right_key: str, right_name: str) -> DataFrame:
    """AUX-13: (left_key, right_key) where either's name holds the other's; empty names match nothing. A name is looked up once, however many rows bear it."""
    l, r = (kept_aside(df.where(F.length(n) > 0).select(F.col(n).alias(c)).distinct()) for df, n, c in ((left, left_name, "_l"), (right, right_name, "_r")))
    down = contained(l.withColumn("_t", F.col("_l")), r.withColumn("_runs", F.array("_r")), "_l", "_t", "_r", "_runs")
    up = contained(r.withColumn("_t", F.col("_r")), l.withColumn("_runs", F.array("_l")), "_r", "_t", "_l", "_runs")
    pairs = kept_aside(down.select("_l", "_r").union(up.select("_l", "_r")).distinct())
    named = left.select(left_key, F.col(left_name).alias("_l")).join(_few(pairs), "_l").join(right.select(right_key, F.col(right_name).alias("_r")), "_r")
    return named.select(left_key, right_key).distinct()


def citations(cites: DataFrame, titles: DataFrame, live: DataFrame, code: str, title: str, slug: str, *, by: Sequence[str]) -> DataFrame:
    """JOIN-25: cites (by, code) with title and slug: a code leads to a title, a title to the item that is live under it now; either is null where it leads nowhere.

    titles has (code, title), live (title, slug), several of which may bear a title: the least slug is taken. Codes that most citations name are joined in
    shuffles that adaptive execution can split, or by a broadcast.
    """
    known = titles.groupBy(code).agg(F.min(title).alias(title))
    current = live.groupBy(title).agg(F.min(slug).alias(slug))
    led = known.join(current, title, "left").select(code, title, slug)
    return cites.select(*by, code).distinct().join(led, code, "left").select(*by, code, title, slug)


def unresolved(cited: DataFrame, slug: str) -> DataFrame:
    """JOIN-25: the citations that lead to no live item, for the report."""
    return cited.where(F.col(slug).isNull())
