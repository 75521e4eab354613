"""Encoding texts with a public byte-level BPE vocabulary.

Pre-tokens are found without regular expressions: each code point has a class, each class is a transition function
over a few states, and since composing functions is associative the state before every character comes from a
blocked scan over a whole batch of texts. A pre-token's ids come from merging byte pairs by rank, kept in a cache.

Defined cases: null and empty texts have an empty list of ids; strings that look like special tokens are ordinary
text; repeated rows are encoded each; lone surrogates are encoded as the replacement character.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._hashing import slices
from foliant.plans.staging import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_SIZE = 500_000
#: Characters that are encoded at once; a longer text alone.
SLICE = 1_000_000

# States: what the token that is being read is made of.
_I, _LETTERS, _NUMBERS, _OTHER, _BLANKS, _SPACE, _ONE, _TWO = range(8)
# Symbols: L, N, O, an apostrophe before a one- or two-letter ending, a blank before a blank or the end, the last blank
# of a run (a plain space or another).
_L, _N, _O, _Q1, _Q2, _MID, _SP, _WS = range(8)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, by (symbol, state). Symbols from 8 on are those of a text's first
    character, which forget the state."""
    to, start = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for s in range(8):
        for symbol in range(8):
            begins = True
            if symbol in (_L, _N):
                kind = _LETTERS if symbol == _L else _NUMBERS
                if symbol == _L and s == _TWO:
                    kind, begins = _ONE, False
                elif symbol == _L and s == _ONE:
                    kind, begins = _I, False
                elif s in (kind, _SPACE):
                    begins = False
            elif symbol in (_O, _Q1, _Q2):
                kind = _OTHER
                if s in (_OTHER, _SPACE):
                    begins = False
                elif symbol != _O:
                    kind = _ONE if symbol == _Q1 else _TWO
            elif symbol == _MID:
                kind, begins = _BLANKS, s != _BLANKS
            else:
                kind = _SPACE if symbol == _SP else _I
            to[symbol, s], start[symbol, s] = kind, begins
    for symbol in range(8):
        to[8 + symbol] = to[symbol, _I]
    return to, start


_TO, _START = _machine()
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        letter = {"Lu": 0, "Ll": 0, "Lt": 0, "Lm": 0, "Lo": 0, "Nd": 1, "Nl": 1, "No": 1}
        table = np.fromiter((letter.get(unicodedata.category(chr(i)), 2) for i in range(0x110000)), np.uint8, 0x110000)
        table[_WHITE] = 5
        _classes.append(table)
    return _classes[0]


def _states(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each character: functions are composed within blocks, over blocks, then applied."""
    n = len(symbols)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _L, np.uint8)
    padded[:n] = symbols
    grid = padded.reshape(blocks, width)
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    rows = np.arange(blocks)[:, None]
    for i in range(width):
        whole = _TO[grid[:, i][:, None], whole]
    if blocks > width:
        entry = _block_entries(whole, width)
    else:
        entry, s = np.zeros(blocks, np.uint8), 0
        for b in range(blocks):
            entry[b] = s
            s = whole[b, s]
    del rows
    out = np.empty((blocks, width), np.uint8)
    s = entry
    for i in range(width):
        out[:, i] = s
        s = _TO[grid[:, i], s]
    return out.reshape(-1)[:n]


def _block_entries(functions: np.ndarray, width: int) -> np.ndarray:
    """The state before each block, from the blocks' functions, by the same scan one level up."""
    n = len(functions)
    groups = -(-n // width)
    padded = np.tile(np.arange(8, dtype=np.uint8), (groups * width, 1))
    padded[:n] = functions
    grid = padded.reshape(groups, width, 8)
    whole = np.tile(np.arange(8, dtype=np.uint8), (groups, 1))
    for i in range(width):
        whole = np.take_along_axis(grid[:, i], whole.astype(np.int64), 1)
    if groups > width:
        entry = _block_entries(whole, width)
    else:
        entry, s = np.zeros(groups, np.uint8), 0
        for b in range(groups):
            entry[b] = s
            s = whole[b, s]
    out = np.empty((groups, width), np.uint8)
    at, s = np.arange(groups), entry
    for i in range(width):
        out[:, i] = s
        s = grid[at, i, s]
    return out.reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts joined, the start of every pre-token in it, and the start of every text."""
    flat = "".join(texts)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    if not flat:
        return flat, np.zeros(0, np.int64), first
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _class_table()[code]
    n = len(code)
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    blank = kind == 5
    follows = np.zeros(n, bool)  # a blank or nothing comes next
    follows[:-1] = blank[1:]
    follows |= opens[1:]
    symbols = kind.copy()
    symbols[blank & ~follows] = _WS
    symbols[blank & ~follows & (code == 32)] = _SP
    quotes = np.flatnonzero(code == 39)
    if len(quotes):
        a = np.where(quotes + 1 < n, code[np.minimum(quotes + 1, n - 1)], 0) * ~opens[quotes + 1]
        b = np.where(quotes + 2 < n, code[np.minimum(quotes + 2, n - 1)], 0) * ~opens[np.minimum(quotes + 2, n)]
        symbols[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = _Q1
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbols[quotes[two]] = _Q2
    symbols[opens[:-1]] += 8
    starts = np.flatnonzero(_START[symbols, _states(symbols)])
    return flat, starts, first


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks of byte strings; in this vocabulary a rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is joined, leftmost first, until none is known."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            k = after[i]
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        k = before[i]
        if k >= 0 and (r := ranks.get(piece[k : end[i]])) is not None:
            heapq.heappush(heap, (r, k, end[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = after[i]
    return ids


class Encoder:
    """Encodes batches of texts; keeps the ids of pre-tokens it has met."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = CACHE_SIZE):
        self.ranks, self.cache, self.cache_size = ranks, {}, cache_size

    def __call__(self, texts: list[str]) -> tuple[list[list[int]], list[np.ndarray]]:
        """Ids of each text, and where each of its pre-tokens starts (in code points)."""
        flat, starts, first = boundaries(texts)
        cut = np.searchsorted(starts, first)
        ends = np.append(starts[1:], len(flat)).tolist()
        begins, cache, ranks = starts.tolist(), self.cache, self.ranks
        ids: list[list[int]] = []
        for t in range(len(texts)):
            out: list[int] = []
            for i in range(cut[t], cut[t + 1]):
                piece = flat[begins[i] : ends[i]]
                got = cache.get(piece)
                if got is None:
                    got = merge(piece.encode("utf-8", "replace"), ranks)
                    if len(piece) < 100:
                        if len(cache) >= self.cache_size:
                            cache.clear()
                        cache[piece] = got
                out += got
            ids.append(out)
        return ids, [starts[a:b] - first[i] for i, (a, b) in enumerate(zip(cut, cut[1:]))]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, with_offsets: bool = False) -> DataFrame:
    """(key, ids) and, on request, the offsets of the pre-tokens for decoding back to places in the text.

    The vocabulary file (under 1 MB) is read on the driver and broadcast, so executors need no path."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("vocabulary over 64 MB")
    sent = df.sparkSession.sparkContext.broadcast(raw)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in sent.value.splitlines() if line.strip())}
        encoder = Encoder(ranks)
        for b in batches:
            for lo, hi in slices(b["t"], SLICE):
                p = b.iloc[lo:hi]
                ids, offsets = encoder([t if t is not None else "" for t in p["t"]])
                out = pd.DataFrame({"k": p["k"].to_numpy(), "ids": ids})
                if with_offsets:
                    out["offsets"] = [o.astype(np.int32) for o in offsets]
                yield out

    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    out = src.mapInPandas(run, f"k {kind}, ids array<int>" + (", offsets array<int>" if with_offsets else ""))
    return out.withColumnRenamed("k", key)


def inverse(ranks: dict[bytes, int]) -> dict[int, bytes]:
    """The bytes of each id."""
    return {v: k for k, v in ranks.items()}


def decode(ids: list[int], ranks: dict[bytes, int] | dict[int, bytes]) -> str:
    """The text of a list of ids, by the vocabulary or, for many lists, its inverse."""
    of = ranks if ids and ids[0] in ranks else inverse(ranks)
    return b"".join(map(of.__getitem__, ids)).decode("utf-8", "replace")
