"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import features, gathered, held_out
from .tokens import counts

BITS = 15
LOW, HIGH = 1, 3
#: Mean shares of n-grams are small; this brings the classifiers' inputs to the order of one.
SCALE = 20.0
MADE = ("lang_pred", "score", "ambiguous")
#: ASCII letters and bytes from 0x80 on stay; the rest parts words.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def letters(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_LETTERS)


def ids_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return counts(letters(text), LOW, HIGH, BITS)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1. Up to five languages get the exhaustive code, all 2^(n-1) - 1 ways to part them; more get, of many random codes, the one whose nearest rows lie farthest apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if c >> r & 1 else -1 for c in range(1, 1 << n - 1)] for r in range(n)])
    rng = np.random.default_rng(seed)
    width, best, most = max(15, int(np.ceil(10 * np.log2(n)))), None, -1
    for _ in range(200):
        m = rng.choice([-1, 1], (n, width))
        m[0, np.abs(m.sum(0)) == n] *= -1  # no bit that all share
        near = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if near > most:
            best, most = m, near
    return best


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], code: np.ndarray, *, epochs: int = 8, rate: float = 1.0, seed: int = 5):
    """(weights, bias, trust) of one logistic classifier for each bit, over hashed n-grams; trust is a bit's log odds of being right on the training rows."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    n = np.bincount([y for *_, y in rows], minlength=len(code))
    balance = len(rows) / np.maximum(1, n) / max(1, (n > 0).sum())
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, weight, y = rows[i]
            lr = np.float32(rate * (1 - done / steps) * min(5.0, balance[y]))
            done += 1
            z = SCALE * (weight @ w[ids]) + b if len(ids) else b.copy()
            g = (-code[y] / (1 + np.exp(np.clip(code[y] * z, -50, 50)))).astype(np.float32)
            w[ids] -= (lr * SCALE * weight)[:, None] * g[None, :]
            b -= lr * np.float32(0.05) * g
    right = np.mean([(np.sign(SCALE * (x @ w[ids]) + b) == code[y]) if len(ids) else np.zeros(len(b), bool) for ids, x, y in rows], axis=0)
    odds = np.clip(right, 0.01, 0.99)
    trust = np.maximum(0.1, np.log(odds / (1 - odds)))
    return w, b, trust / trust.sum()


def decode(z: np.ndarray, code: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best row, score, ambiguous) by the trust-weighted logistic loss against each codeword.

    The score is the share of the best in the softmax of the losses; ambiguous: the second is nearer than half a sure bit's loss.
    """
    m = z[:, None, :] * code[None, :, :]
    loss = (np.logaddexp(0, -m) * trust).sum(2)
    best = loss.argmin(1)
    p = np.exp(-code.shape[1] * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    score = p[np.arange(len(p)), best]
    if code.shape[0] < 2:
        return best, score, np.zeros(len(best), bool)
    two = np.partition(loss, 1, axis=1)[:, :2]
    return best, score, two[:, 1] - two[:, 0] < 0.1


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500, at_most: int = 3000):
    """A model from texts with a non-null lang that aren't held out: a bounded sample by hash of the id, of about per_language rows for each language and at_most in all."""
    own = docs.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("y")).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    found = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    langs = sorted(found)
    if not langs:
        return [], codewords(0), None
    each = min(per_language, max(1, at_most // len(langs)))
    share = F.element_at(F.create_map(*[x for y in langs for x in (F.lit(y), F.lit(min(1.0, each / found[y])))]), F.col("y"))
    picked = own.where(F.pmod(F.xxhash64("k", F.lit(3)), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = gathered(features(picked, ids_counts))
    place = {y: i for i, y in enumerate(langs)}
    code = codewords(len(langs))
    return langs, code, train(rows.labelled(place.__getitem__), code)


def identify(docs: DataFrame, model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score and ambiguous.

    Whole texts are used; texts that are null or hold no letter are `und` with score 0, as is everything where no language was learned;
    columns named like a result are replaced. No shuffle.
    """
    langs, code, learned = model
    kept = [c for c in (keep or docs.columns) if c.lower() not in MADE]
    sent = docs.sparkSession.sparkContext.broadcast(learned)  # 2^BITS numbers for each bit

    def outputs(w: np.ndarray, bias: np.ndarray, text: str | None) -> np.ndarray:
        own, n = ids_counts(text)
        share = n.astype(np.float32)
        return SCALE * (share @ w[own]) / max(1.0, float(share.sum())) + bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[text].to_pylist()
            pred, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if sent.value is not None and texts:
                w, bias, trust = sent.value
                z = np.array([outputs(w, bias, t) for t in texts])
                best, sure, doubt = decode(z, code, trust)
                some = [any(map(str.isalpha, t or "")) for t in texts]
                pred = [langs[i] if ok else "und" for i, ok in zip(best, some, strict=True)]
                score, doubt = np.where(some, sure, 0.0), np.where(some, doubt, True)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(pred, pa.string()), pa.array(score), pa.array(doubt)], [*kept, *MADE])

    names = list(dict.fromkeys([*kept, text]))
    fields = {f.name: f for f in docs.schema.fields}
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, T.StructType([*(fields[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]))
