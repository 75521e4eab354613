"""Evaluation texts inside training texts: size-partitioned MinHash containment search, verified exactly.

A leak is a run of ``run`` words of an item inside a document. A window of ``run`` words is a small set of word
shingles, and a document that holds it holds all of them; Jaccard, which MinHash sees, falls with the document's size.
So documents and items are cut into overlapping blocks of one size, the window's: in this finest of size partitions
containment is equality, one MinHash function finds every leak, and neighbouring blocks share their minimum, so a text
has about a third as many signatures as words. Signatures of documents and items are joined, in one pass over the
documents however many the items are; each carries the words around its shingle, which are compared exactly.

Defined cases: null and empty texts and items under ``run`` words have no leak; words are read as a reader sees them
(see ``_visual.seen_as``), without case; items with equal texts are each reported; repeated rows count once; an empty
table gives no rows; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import _visual
from foliant.llm._hashing import mix, slices, word_hashes
from foliant.plans.staging import spread, stage

RUN, SHINGLE = 16, 12
#: Bits of the map that tells which signatures the items may have: of this size whatever the number of items.
MAP_BITS = 1 << 26
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(_visual.seen_as(text).casefold())


def _rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    acc = np.zeros(len(hashes) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + len(acc)]
    return mix(acc)


def block_minima(hashes: np.ndarray, run: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, place of its shingle) of the MinHash of every block of ``run`` words, once where neighbours share it."""
    if len(hashes) < run:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = _rolling(hashes, shingle)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(rolled, run - shingle + 1).argmin(axis=1) + np.arange(len(hashes) - run + 1))
    return rolled[at], at


def _signatures(df: DataFrame, key: str, text: str, run: int, shingle: int, wanted: np.ndarray | None) -> DataFrame:
    """(key, sig, at, words): the minima of a text's blocks with the words in which a leak around the shingle lies and the place
    of the shingle in them; only those ``wanted``, a map of bits, may have."""
    sent = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)
    around = run - shingle

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in slices(b["t"]):
                texts = [words_of(t) for t in b["t"].iloc[lo:hi]]
                hashes, counts = word_hashes([" ".join(w) for w in texts])
                out, start = [], 0
                for k, words, n in zip(b["k"].iloc[lo:hi], texts, counts):
                    sig, at = block_minima(hashes[start : start + n], run, shingle)
                    start += n
                    if sent is not None:
                        bit = sig % np.uint64(len(sent.value) * 8)
                        hit = (sent.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                        sig, at = sig[hit == 1], at[hit == 1]
                    for s, a in zip(sig.view(np.int64), at):
                        first = max(0, a - around)
                        out.append((k, s, a - first, words[first : a + run]))
                if out:
                    yield pd.DataFrame(out, columns=["k", "sig", "at", "words"])

    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") >= 2 * run - 1))
    kind = df.schema[key].dataType.simpleString()
    return src.mapInPandas(sign, f"k {kind}, sig long, at int, words array<string>")


def _bit_map(signatures: DataFrame, bits: int) -> np.ndarray:
    """A map of ``bits`` bits (bytes) with those of all signatures set; merged in tasks, so only words of the map are sent."""
    unsigned = F.expr(f"pmod(sig, {bits}L)")  # bits is a power of two, so this is the unsigned remainder too
    words = signatures.select(unsigned.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out.view(np.uint8)


def find_leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, *, run: int = RUN,
               shingle: int = SHINGLE, map_bits: int = MAP_BITS) -> DataFrame:
    """(key, item_key): documents that hold ``run`` consecutive words of an item.

    Documents are read once and never shuffled: only signatures the items may have leave a task, and only those are joined."""
    if map_bits & (map_bits - 1) or map_bits < 64:
        raise ValueError("map_bits must be a power of two, 64 or more")
    wanted = stage(_signatures(items, item_key, item_text, run, shingle, None).distinct(), "leak-items")
    found = _signatures(df, key, text, run, shingle, _bit_map(wanted, map_bits)).distinct()
    both = found.alias("d").join(wanted.alias("i"), F.expr("d.sig = i.sig"))
    # the shingle is at least at place `before` of the run; the run must lie whole in both texts' words
    same = F.expr(f"""exists(sequence(0, {run - shingle}), before -> d.at >= before and i.at >= before and size(slice(d.words, d.at - before + 1, {run})) = {run}
        and slice(d.words, d.at - before + 1, {run}) = slice(i.words, i.at - before + 1, {run}))""")
    return both.where(same).select(F.col("d.k").alias(key), F.col("i.k").alias(item_key)).distinct()
