"""Cutting long texts into pieces at natural boundaries.

A dynamic program over boundary positions picks the cuts: each cut costs by the kind of its boundary (paragraph,
sentence, line, word, none) and each piece by its distance from an even share. No piece is over ``max_chars`` and
each piece after the first begins with the last ``overlap`` characters of the one before it, so the pieces without
their overlaps joined give the text back, character for character.

Defined cases: null gives no piece; texts up to the limit, the empty one too, are one piece; a text without any
boundary is cut at characters; characters are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAX_CHARS, OVERLAP = 4000, 200
#: What a cut costs, by the kind of boundary it is at.
PENALTY = {"paragraph": 0.0, "sentence": 0.05, "line": 0.3, "word": 0.8, "none": 3.0}
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"»”’)\]]*\s+")
_LINE = re.compile(r"\n\s*")
_WORD = re.compile(r"\s+")
_KINDS = ["paragraph", "sentence", "line", "word", "none", "end"]


def _boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and kinds. Weaker kinds are added only where stronger ones are more than half of ``reach``
    apart, single characters only where nothing else comes within ``reach``."""
    n = len(text)
    found: dict[int, int] = {}
    for kind, pattern in enumerate((_PARAGRAPH, _SENTENCE)):
        for m in pattern.finditer(text):
            found.setdefault(m.end(), kind)
    for kind, pattern in ((2, _LINE), (3, _WORD), (4, None)):
        limit = reach // 2 if pattern is not None else reach
        cuts = [0, *sorted(p for p in found if 0 < p < n), n]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > limit:
                spots = (m.end() for m in pattern.finditer(text, a, b)) if pattern is not None else range(a + reach, b, reach)
                for p in spots:
                    if a < p < b:
                        found.setdefault(p, kind)
    found.pop(0, None)
    found.pop(n, None)
    pos = np.array([0, *sorted(found), n])
    return pos, np.array([5, *(found[p] for p in pos[1:-1]), 5])


def cut_positions(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(position, index of kind) of the end of every piece; the last is the end of the text."""
    n = len(text)
    if n <= max_chars:
        return [(n, 5)]
    reach = max_chars - overlap
    pos, kind = _boundaries(text, reach)
    pieces = 1 + -(-(n - max_chars) // reach)
    even = n / pieces
    cost = np.array([PENALTY[_KINDS[k]] if k < 5 else 0.0 for k in kind])
    best, back = np.full(len(pos), np.inf), np.zeros(len(pos), np.int64)
    best[0] = 0.0
    low = np.searchsorted(pos, pos - reach)
    for j in range(1, len(pos)):
        a = 0 if pos[j] <= max_chars else low[j]
        length = pos[j] - pos[a:j]
        c = best[a:j] + (length / even - 1.0) ** 2 + 0.25
        i = int(np.argmin(c))
        best[j], back[j] = c[i] + cost[j], a + i
    cuts, j = [], len(pos) - 1
    while j > 0:
        cuts.append((int(pos[j]), int(kind[j])))
        j = back[j]
    return cuts[::-1]


def split_texts(df: DataFrame, ids: list[str], text: str, *, max_chars: int = MAX_CHARS, overlap: int = OVERLAP,
                only_long: bool = False) -> DataFrame:
    """Rows ``ids``, piece_no (from 1), pieces, start_pos (of what is new), boundary, piece.

    Repeated rows (equal ids and text) are cut once. ``only_long`` leaves out texts that need no cut; they are
    filtered before any text leaves the JVM."""
    if not 0 <= overlap < max_chars:
        raise ValueError("0 <= overlap < max_chars")
    src = df.select(*ids, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    if only_long:
        src = src.where(F.length("__text") > max_chars)
    src = src.dropDuplicates()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "__text") \
        + ", piece_no int, pieces int, start_pos int, boundary string, piece string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                t = row[-1]
                cuts, start = cut_positions(t, max_chars, overlap), 0
                for i, (end, kind) in enumerate(cuts):
                    rows.append((*row[:-1], i + 1, len(cuts), start, _KINDS[kind], t[max(0, start - overlap) if i else 0 : end]))
                    start = end
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=[*ids, "piece_no", "pieces", "start_pos", "boundary", "piece"])
                    rows = []
            yield pd.DataFrame(rows, columns=[*ids, "piece_no", "pieces", "start_pos", "boundary", "piece"])

    return src.mapInPandas(cut, schema)
