"""Vectorised text hashing: words and word shingles of a whole Arrow batch, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of them."""
    if len(_pow["up"]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _pow[key] = np.cumprod(steps, dtype=np.uint64)
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (a run without white space) of every text.

    Returns the hashes of all words in order and the number of words of each text. A word's hash is a
    polynomial over its code points modulo 2**64, taken from running sums, so equal words have equal
    hashes wherever they stand."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined = [" ".join(t.split()) for t in texts]
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in joined), np.int64, len(joined))
    flat = " ".join(t for t in joined if t)
    if not flat:
        return np.zeros(0, np.uint64), words
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    cut = np.flatnonzero(code == 32)
    start = np.concatenate(([0], cut + 1))
    end = np.concatenate((cut, [len(code)]))
    up, down = _powers(len(code))
    with np.errstate(over="ignore"):
        run = np.concatenate(([np.uint64(0)], np.cumsum(mix(code + np.uint64(1)) * up[: len(code)], dtype=np.uint64)))
        return mix((run[end] - run[start]) * down[start]), words


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words that stay inside one text, and the text each is of."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    m = n - k + 1
    acc = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[i : i + m]
    inside = owner[:m] == owner[k - 1 :]
    return mix(acc[inside]), owner[:m][inside]


def distinct_by_owner(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) rows, ordered by owner, then value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], owner[keep]


def slices(texts, characters: int = 2_000_000, rows: int = 2000) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of a batch with about so many characters, so that arrays over a part stay small whatever
    the length of its texts; a longer text is a part of its own. Null texts have no length."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > start and (size + n > characters or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += n
    if len(texts):
        yield start, len(texts)
