"""Hashed words and character n-grams of whole texts, computed on byte arrays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_RNG = np.random.default_rng(20240229)
#: A random number for each byte at each place in a word (places repeat after 32); blanks count nothing.
_PLACES = _RNG.integers(1, 1 << 32, (32, 256), dtype=np.uint32)
_PLACES[:, 32] = 0
_ODD = (_RNG.integers(1, 1 << 31, 8, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def pieces(data: bytes, over: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """(bytes, own): data, its words parted by single blanks and with a blank at either end, in pieces of PIECE bytes or a little more, cut behind blanks.

    The first own bytes are the piece; up to over bytes of the next follow, so that no n-gram is lost between them.
    """
    data = b" " + b" ".join(data.split()) + b" "
    at = 0
    while at < len(data):
        end = data.find(b" ", min(len(data), at + PIECE) - 1) + 1
        yield np.frombuffer(data, np.uint8, min(len(data), end + over) - at, at), end - at
        at = end


def _mixed(h: np.ndarray, n: int, bits: int) -> np.ndarray:
    h = (h + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits)


def word_hashes(a: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each word of a piece."""
    blank = a == 32
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return np.empty(0, np.uint32)
    n = np.diff(np.append(starts, len(a)))
    place = np.arange(starts[0], len(a)) - np.repeat(starts, n)
    return np.add.reduceat(_PLACES[place & 31, a[starts[0] :]], starts - starts[0], dtype=np.uint32)


def gram_ids(a: np.ndarray, own: int, low: int, high: int, bits: int) -> Iterator[np.ndarray]:
    """Hashed ids of the byte n-grams from low to high that begin in the first own bytes."""
    x = a.astype(np.uint32)
    h = np.zeros(len(x), np.uint32)
    for n in range(high):
        if len(x) <= n:
            return
        h = h[: len(x) - n] + x[n:] * _ODD[n]
        if n + 1 >= low:
            yield _mixed(h[:own], n + 1, bits)


def ids_of(data: bytes, low: int, high: int, bits: int, pairs: bool = False) -> Iterator[np.ndarray]:
    """Ids of words, of n-grams of bytes and, with pairs, of words that follow themselves: all those pairs back off to one n-gram of words, id 0,
    which nothing else has.
    """
    last = np.empty(0, np.uint32)
    for a, own in pieces(data, high - 1):
        for ids in gram_ids(a, own, low, high, bits):
            yield np.maximum(ids, 1)
        w = word_hashes(a[:own])
        if len(w):
            yield np.maximum(_mixed(w, 0, bits), 1)
        w = np.concatenate([last, w])
        last = w[-1:]
        if pairs and (same := int((w[1:] == w[:-1]).sum())):
            yield np.zeros(same, np.uint32)


def counts(data: bytes, low: int, high: int, bits: int, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): the hashed ids of a text, ascending, and how often each occurs."""
    n = np.zeros(1 << bits)
    for ids in ids_of(data, low, high, bits, pairs):
        n += np.bincount(ids, minlength=1 << bits)
    own = np.flatnonzero(n)
    return own.astype(np.int32), n[own].astype(np.int64)


def pack(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending ids and their counts, deflated: some 1.5 bytes for each, as steps and counts are mostly small."""
    return zlib.compress(np.diff(ids, prepend=np.int32(0)).astype("<i4").tobytes() + n.astype("<i8").tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, weights) of what pack() made: the share of each id among all ids of the text."""
    raw = zlib.decompress(data)
    size = len(raw) // 12
    n = np.frombuffer(raw, "<i8", size, 4 * size)
    return np.cumsum(np.frombuffer(raw, "<i4", size), dtype=np.int32), (n / max(1.0, float(n.sum()))).astype(np.float32)
