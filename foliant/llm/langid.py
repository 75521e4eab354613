"""Language of texts and of their stretches, with a calibrated confidence.

Sparse multinomial logistic regression on TF-IDF weighted character n-grams of words, trained by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, then calibrated by one temperature on
held-out sentences. Training reads a bounded sample of labelled rows (``TRAIN_ROWS`` a language, the first in the
order of a hash of the text, of texts of 60 to ``TRAIN_CHARS`` characters); labels may be wrong in part: sentences the model contradicts after a first pass take no
further part. Everything else covers every row.

A sentence's score is the sum over its words, so words are scored once and kept, and a sentence that joins two
languages (a lost full stop) is cut where the two sides are explained best.

Defined cases: null, empty and blank texts have no stretch and no language; sentences under ``MIN_WORDS`` words have
the language of their own words but take no part in what a text's languages are; a table without any labelled text
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.llm._hashing import mix
from foliant.plans.staging import spread

LANGUAGES = ["es", "ca", "fr", "en", "it", "de"]
MIN_WORDS, TRAIN_ROWS, TRAIN_CHARS, BUCKETS, MAX_N = 6, 800, 5000, 1 << 17, 4
# Other notations of the languages.
NOTATIONS = {
    "es": ["spa", "castellano", "español", "espanol", "spanish"], "ca": ["cat", "català", "catala", "catalán", "catalan", "valencià"],
    "fr": ["fra", "fre", "français", "francais", "francés", "french"], "en": ["eng", "inglés", "ingles", "english", "anglès"],
    "it": ["ita", "italiano", "italian", "italià"], "de": ["deu", "ger", "deutsch", "alemán", "aleman", "german", "alemany"],
}


def language_code(label: Column) -> Column:
    """The two-letter code a label stands for; null for null, empty and unknown labels."""
    s = F.lower(F.trim(label))
    stem = F.regexp_extract(s, r"^([a-z]{2,3})([-_][a-z0-9]+)*$", 1)
    out = F.when(stem.isin(LANGUAGES), stem)
    for code, names in NOTATIONS.items():
        out = out.when(stem.isin(names) | s.isin(names), F.lit(code))
    return out


_BREAK = re.compile(r"(?<=[.!?…;])[\"»”’)\]—–-]*\s+(?=[\"«“¿¡(\[—–-]*\s*[^\W_a-zà-öø-ÿ])")
_ABBREVIATED = re.compile(r"(?:^|\s)(?:[^\W\d_]|[A-ZÀ-Þ][a-zà-ÿ]{0,4}|\w{1,5}\.?[ºª])\.?[ºª]?$")
_HYPHEN = re.compile(r"[-‐¬]\s*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of the sentences; a full stop after a short capitalised word is an abbreviation's."""
    out, start = [], 0
    for m in _BREAK.finditer(text):
        if text[m.start() - 1] == "." and _ABBREVIATED.search(text, max(start, m.start() - 8), m.start() - 1):
            continue
        out.append((start, m.start()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the character n-grams of words (with marks at both ends), and the word each is of."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = "".join(f" {w} " for w in words)
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    h, features, owners = np.zeros(len(code), np.uint64), [], []
    with np.errstate(over="ignore"):
        for n in range(1, MAX_N + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
            inside = owner[:m] == owner[n - 1 :]
            features.append((mix(h[inside]) >> np.uint64(47)).astype(np.int64))
            owners.append(owner[:m][inside])
    f, o = np.concatenate(features), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return f[order], o[order]


_NUMBERED = re.compile(r"\S*\d\S*")
_clean = re.compile(r"[^\w'’·-]+|_+")


def tokens(sentence: str) -> list[str]:
    """The words of a sentence; what holds a digit is none."""
    return [w for w in _clean.sub(" ", _NUMBERED.sub(" ", sentence)).split() if w[0].isalpha() or w[-1].isalpha()]


def _word_start(sentence: str, n: int) -> int:
    """Where word number n (from 0) of ``tokens`` starts."""
    seen = 0
    for m in re.finditer(r"\S+", sentence):
        k = len(tokens(m[0]))
        if seen + k > n:
            return m.start()
        seen += k
    return len(sentence)


class Model:
    """Weights, temperature and what is needed to score words."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights.astype(np.float32), bias, temperature
        self.reset()

    def __getstate__(self):
        return self.weights, self.bias, self.temperature

    def __setstate__(self, state):
        self.__init__(*state)

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.score, self.size = np.zeros((1 << 14, len(LANGUAGES)), np.float32), np.zeros(1 << 14, np.float32)
        self.kind = np.zeros(1 << 14, np.int8)  # 1: capitalised, 2: in capitals

    def _add(self, words: list[str]) -> None:
        at = len(self.index)
        if at + len(words) > 400_000:
            self.reset()
            at = 0
        while at + len(words) > len(self.score):
            self.score, self.size = np.concatenate((self.score, np.zeros_like(self.score))), np.concatenate((self.size, np.zeros_like(self.size)))
            self.kind = np.concatenate((self.kind, np.zeros_like(self.kind)))
        f, o = ngrams([w.lower() for w in words])
        cut = np.searchsorted(o, np.arange(len(words)))
        got = np.add.reduceat(self.weights[f], cut, axis=0)
        n = np.diff(np.append(cut, len(f))).astype(np.float32)
        kind = np.fromiter((0 if not w[0].isupper() else 2 if len(w) > 2 and w.isupper() else 1 for w in words), np.int8, len(words))
        scale = np.where((kind == 1) & (n > 8), 0.3, 1.0).astype(np.float32)
        self.kind[at : at + len(words)] = kind
        self.score[at : at + len(words)] = got * scale[:, None]
        self.size[at : at + len(words)] = n * scale
        self.index.update(zip(words, range(at, at + len(words))))

    def classify(self, texts: list[str]) -> dict[str, np.ndarray]:
        """The sentences of all texts: text, start, end, words, language (number), confidence, in order."""
        text, start, end, bags = [], [], [], []
        for i, t in enumerate(texts):
            for a, b in sentences(t):
                w = tokens(_HYPHEN.sub("", t[a:b]))
                if w:
                    text.append(i), start.append(a), end.append(b), bags.append(w)
        if not bags:
            return {k: np.zeros(0, np.int64) for k in ("text", "start", "end", "words", "language")} | {"confidence": np.zeros(0)}
        flat = [w for b in bags for w in b]
        new = list(dict.fromkeys(w for w in flat if w not in self.index))
        if new:
            before = len(self.index)
            self._add(new)
            if len(self.index) < before + len(new):
                self._add(list(dict.fromkeys(w for w in flat if w not in self.index)))
        ids = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        count = np.array([len(b) for b in bags])
        text, start, end = np.array(text), np.array(start), np.array(end)
        run = np.concatenate((np.zeros((1, len(LANGUAGES))), np.cumsum(self.score[ids], axis=0, dtype=np.float64)))
        mass = np.concatenate(([0.0], np.cumsum(self.size[ids], dtype=np.float64)))
        first = np.concatenate(([0], np.cumsum(count)))
        lo, hi = first[:-1], first[1:]
        kind = self.kind[ids]
        text, start, end, lo, hi = self._cut_mixed(texts, run, kind == 1, text, start, end, lo, hi)
        shouted = np.concatenate(([0], np.cumsum(kind == 2)))
        loud = shouted[hi] - shouted[lo]
        words = np.where(loud < hi - lo, hi - lo - loud, hi - lo)  # names and marks in capitals don't make a sentence long
        z = (run[hi] - run[lo]) / np.sqrt(np.maximum(mass[hi] - mass[lo], 1.0))[:, None] + self.bias
        z = z / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return {"text": text, "start": start, "end": end, "words": words, "language": p.argmax(axis=1), "confidence": p.max(axis=1)}

    def _cut_mixed(self, texts, run, opens, text, start, end, lo, hi):
        """Cut sentences of two languages in two before a capitalised word: where explaining both sides apart gains most."""
        for _ in range(2):
            wide = np.flatnonzero(hi - lo >= 2 * MIN_WORDS)
            if not len(wide):
                break
            n = hi[wide] - lo[wide] - 2 * MIN_WORDS + 1
            of = np.repeat(np.arange(len(wide)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[wide][of] + MIN_WORDS
            gain = (run[at] - run[lo[wide][of]]).max(axis=1) + (run[hi[wide][of]] - run[at]).max(axis=1)
            gain[~opens[at]] = 0.0
            top = np.maximum.reduceat(gain, np.cumsum(n) - n)
            whole = (run[hi[wide]] - run[lo[wide]]).max(axis=1)
            split = np.flatnonzero(top - whole > CUT_GAIN)
            if not len(split):
                break
            chosen = np.flatnonzero((gain == top[of]) & np.isin(of, split))
            _, keep = np.unique(of[chosen], return_index=True)
            where, cut = wide[of[chosen[keep]]], at[chosen[keep]]
            share = np.array([start[i] + _word_start(texts[text[i]][start[i] : end[i]], c - lo[i]) for i, c in zip(where, cut)])
            text = np.insert(text, where + 1, text[where])
            start, end = np.insert(start, where + 1, share), np.insert(end, where, share)
            lo, hi = np.insert(lo, where + 1, cut), np.insert(hi, where, cut)
        return text, start, end, lo, hi


#: How much better (in units of the raw score) two languages must explain a sentence than one.
CUT_GAIN = 40.0


def train(texts: list[str], labels: list[str], *, epochs: int = 2, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02,
          l2: float = 0.02, batch: int = 128, seed: int = 7) -> Model:
    """Fit on texts with (unreliable) labels."""
    bags, y = [], []
    for t, label in zip(texts, labels):
        for a, b in sentences(t):
            w = [x.lower() for x in tokens(_HYPHEN.sub("", t[a:b])) if not (x[0].isupper() and x[1:2].islower())]
            if len(w) >= MIN_WORDS:
                bags.append(w)
                y.append(LANGUAGES.index(label))
    y, k = np.array(y), len(LANGUAGES)
    order = np.random.default_rng(seed).permutation(len(bags))
    flat, owner = ngrams([w for i in order for w in bags[i]])
    words = np.array([len(bags[i]) for i in order])
    owner = np.repeat(np.arange(len(bags)), words)[owner]
    y = y[order]
    n = len(bags)
    size = np.bincount(owner, minlength=n)
    pair = np.unique(owner * BUCKETS + flat)
    df = np.bincount(pair % BUCKETS, minlength=BUCKETS)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    cut = np.concatenate(([0], np.cumsum(size)))
    held = n - n // 8
    zs, ns = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def solve(z, g2, lam):
        return np.where(np.abs(z) <= lam, 0.0, -(z - np.sign(z) * lam) / ((beta + np.sqrt(g2)) / alpha + l2))

    def forward(a, b, w, bias):
        f = flat[cut[a] : cut[b]]
        x = idf[f] / np.sqrt(size[a:b])[owner[cut[a] : cut[b]] - a]
        z = np.add.reduceat(w[f] * x[:, None], cut[a:b] - cut[a], axis=0) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return f, x, z, p / p.sum(axis=1, keepdims=True)

    trusted = np.ones(n, bool)
    weight = 1.0 / np.sqrt(np.maximum(np.bincount(y, minlength=k), 1))
    weight = weight / weight[y].mean()
    for epoch in range(epochs):
        for a in range(0, held, batch):
            b = min(a + batch, held)
            f = flat[cut[a] : cut[b]]
            u, inverse = np.unique(f, return_inverse=True)
            wu, bias = solve(zs[u], ns[u], l1), solve(zb, nb, 0.0)
            x = idf[f] / np.sqrt(size[a:b])[owner[cut[a] : cut[b]] - a]
            z = np.add.reduceat(wu[inverse] * x[:, None], cut[a:b] - cut[a], axis=0) + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            if epoch:
                trusted[a:b] = p[np.arange(b - a), y[a:b]] > 0.2
            e = p.copy()
            e[np.arange(b - a), y[a:b]] -= 1.0
            e *= (weight[y[a:b]] * trusted[a:b])[:, None]
            each = e[owner[cut[a] : cut[b]] - a] * x[:, None]
            g = np.stack([np.bincount(inverse, each[:, c], len(u)) for c in range(k)], axis=1)
            zs[u] += g - (np.sqrt(ns[u] + g * g) - np.sqrt(ns[u])) / alpha * wu
            ns[u] += g * g
            gb = e.sum(axis=0)
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * bias
            nb += gb * gb
    w, bias = solve(zs, ns, l1), solve(zb, nb, 0.0)
    temperature = 1.0
    if n - held > 20:
        *_, z, p = forward(held, n, w, bias)
        keep = p[np.arange(n - held), y[held:]] > 0.2
        z, t = z[keep], y[held:][keep]
        best = np.inf
        for c in np.geomspace(0.05, 5, 60):
            s = z / c
            nll = (np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(t)), t]).mean()
            if nll < best:
                best, temperature = nll, float(c)
    return Model(w * idf[:, None], bias, temperature)


def fit(df: DataFrame, text: str, label: str, rows: int = TRAIN_ROWS) -> Model | None:
    """A model from at most ``rows`` labelled texts a language; ``label`` is a column of labels in any notation."""
    w = W.partitionBy("code").orderBy("h", "t")
    sample = df.select(F.col(text).alias("t"), language_code(F.col(label)).alias("code")) \
        .where(F.col("code").isNotNull() & F.length("t").between(60, TRAIN_CHARS)).withColumn("h", F.xxhash64("t")) \
        .withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows).select("t", "code").collect()
    if not sample:
        return None
    return train([r.t for r in sample], [r.code for r in sample])


def stretches(df: DataFrame, ids: list[str], text: str, model: Model) -> DataFrame:
    """Rows ``ids``, stretch_no (from 1), start_pos, end_pos, lang, confidence, n_words: sentences of one language in a row are
    one stretch; its confidence is that of its sentences by number of words. Sentences under ``MIN_WORDS`` words go with
    the stretch they follow (or the first one)."""
    src = spread(df.select(*ids, F.col(text).alias("__text")).where(F.col("__text").isNotNull()))
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) \
        + ", stretch_no int, start_pos int, end_pos int, lang string, confidence double, n_words int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = sent.value.classify(b["__text"].tolist())
            if not len(c["text"]):
                continue
            # the language a sentence goes by: its own, or for a short one that of the last long one of its text
            n, text_of = len(c["text"]), c["text"]
            long = c["words"] >= MIN_WORDS
            last = np.maximum.accumulate(np.where(long, np.arange(n), -1))
            ok = (last >= 0) & (text_of[np.maximum(last, 0)] == text_of)
            ahead = np.minimum.accumulate(np.where(long, np.arange(n), n)[::-1])[::-1]
            ok2 = (ahead < n) & (text_of[np.minimum(ahead, n - 1)] == text_of)
            by = np.where(ok, last, np.where(ok2, ahead, np.arange(n)))
            lang = c["language"][by]
            new = np.ones(n, bool)
            new[1:] = (text_of[1:] != text_of[:-1]) | (lang[1:] != lang[:-1])
            first = np.flatnonzero(new)
            final = np.append(first[1:], n) - 1
            words = np.add.reduceat(c["words"], first)
            conf = np.add.reduceat(c["confidence"] * c["words"], first) / words
            of = text_of[first]
            number = np.arange(len(first)) - np.searchsorted(of, of) + 1
            out = b.iloc[of][ids].reset_index(drop=True)
            yield out.assign(stretch_no=number, start_pos=c["start"][first], end_pos=c["end"][final], lang=np.array(LANGUAGES)[lang[first]],
                             confidence=conf, n_words=words)

    return src.mapInPandas(run, schema)


def languages(df: DataFrame, ids: list[str], text: str, model: Model, min_confidence: float = 0.9) -> DataFrame:
    """Rows ``ids``, lang, confidence, n_sentences: each language a text has a sentence of ``MIN_WORDS`` words or more in."""
    src = spread(df.select(*ids, F.col(text).alias("__text")).where(F.col("__text").isNotNull()))
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", lang string, confidence double, n_sentences int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = sent.value.classify(b["__text"].tolist())
            keep = (c["words"] >= MIN_WORDS) & (c["confidence"] >= min_confidence)
            if not keep.any():
                continue
            k, inverse, n = np.unique(c["text"][keep] * len(LANGUAGES) + c["language"][keep], return_inverse=True, return_counts=True)
            top = np.zeros(len(k))
            np.maximum.at(top, inverse, c["confidence"][keep])
            out = b.iloc[k // len(LANGUAGES)][ids].reset_index(drop=True)
            yield out.assign(lang=np.array(LANGUAGES)[k % len(LANGUAGES)], confidence=top, n_sentences=n)

    return src.mapInPandas(run, schema)
