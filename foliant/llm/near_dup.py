"""Near-duplicate texts: ProbMinHash signatures, banding, exact verification.

Every distinct text is a weighted set of word shingles. Each shingle is the source of a Poisson process of
arrivals at the rate of its weight; an arrival falls into one of ``m`` registers and a register keeps its earliest.
Two texts agree in a register with the probability Jaccard of their sets, which for unit weights is the plain Jaccard.
A shingle stops as soon as its next arrival is later than the latest register of its text (early termination).
Registers are cut into bands; texts that share a band are compared exactly.

Defined cases: null texts and texts under ``min_words`` words are no members of any pair; byte-equal texts are
one text until the end (they are compared once and their keys are paired when rows are made); repeated rows count
once; an empty table gives no rows; rows of a null group are in no pair; other columns of the input, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.llm._hashing import distinct_by_owner, mix, shingles, slices, word_hashes
from foliant.plans.staging import spread, stage

#: A class of byte-equal texts with more keys than this is paired through its smallest key alone.
EXPAND_LIMIT = 1000
#: Registers of which a byte is compared before whole sets are.
SKETCH = 64


# What is no white space, as Python's split() knows it.
_NO_SPACE = r"[^\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def probminhash(values: np.ndarray, owner: np.ndarray, n_sets: int, m: int, weights: np.ndarray | None = None) -> np.ndarray:
    """ProbMinHash signatures, (n_sets, m) uint64, of weighted sets given as distinct (owner, value) rows; weights above 0, all 1
    if not given.

    An element's arrivals are a Poisson process at the rate of its weight, each in a register of m; a register names the
    element that arrived first, which is the same in two sets with the probability Jaccard of their weights. An element
    stops when its next arrival is later than the latest register of its set. With unit weights the time itself names
    the element; else its hash is kept beside. Registers of an empty set are all ones."""
    best = np.full(n_sets * m, np.inf)
    winner = None if weights is None else np.full(n_sets * m, ~np.uint64(0))
    alive, at, time, rate = values, owner, np.zeros(len(values)), weights
    seed = np.uint64(0x9E3779B97F4A7C15)
    r = np.uint64(0)
    while len(alive):
        r += np.uint64(1)
        with np.errstate(over="ignore"):
            h = mix(alive + r * seed)
        step = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time = time + (step if rate is None else step / rate)
        with np.errstate(over="ignore"):
            slot = ((mix(h) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        place = at * m + slot
        np.minimum.at(best, place, time)
        if winner is not None:
            first = best[place] == time
            winner[place[first]] = mix(alive[first])
        if int(r) % 4 == 0 or int(r) < 3:
            latest = best.reshape(n_sets, m).max(axis=1)
            keep = time < latest[at]
            alive, at, time = alive[keep], at[keep], time[keep]
            rate = None if rate is None else rate[keep]
    return (best.view(np.uint64) if winner is None else winner).reshape(n_sets, m)


def probability_jaccard(x: dict[int, float], y: dict[int, float]) -> float:
    """The similarity ProbMinHash estimates: the sum over common elements i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    keys = list(x.keys() | y.keys())
    a, b = (np.array([s.get(k, 0.0) for k in keys]) for s in (x, y))
    with np.errstate(divide="ignore"):
        ratio = b / a
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    both = (a > 0) & (b > 0)
    upto, beyond = np.cumsum(a), b.sum() - np.cumsum(b)
    last = np.searchsorted(ratio, ratio, side="right") - 1  # equal ratios count as one
    return float((1 / (upto[last][both] / a[both] + beyond[last][both] / b[both])).sum()) if both.any() else 0.0


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, distinct between bands."""
    s = signatures[:, : bands * rows].reshape(-1, bands, rows)
    acc = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407) * np.ones((len(s), 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + s[:, :, i])
    return acc.view(np.int64)


def _sets(texts: list[str], k: int, min_words: int, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(value, owner, which texts are long enough, weight) of the shingles; the weight is how often one stands in its text."""
    words, counts = word_hashes([t.lower() for t in texts])
    every, of = shingles(words, counts, k)
    values, owner = distinct_by_owner(every, of)
    weights = None
    if weighted:
        order = np.lexsort((every, of))
        every, of = every[order], of[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (of[1:] != of[:-1])
        weights = np.diff(np.append(np.flatnonzero(new), len(every))).astype(np.float64)
    long = counts >= min_words
    keep = long[owner]
    return values[keep], owner[keep], long, None if weights is None else weights[keep]


def near_duplicate_pairs(df: DataFrame, key: str, text: str, *, shingle: int = 5, threshold: float = 0.8,
                         min_words: int = 5, bands: int = 57, rows: int = 5, group: str | None = None,
                         expand_limit: int = EXPAND_LIMIT, weighted: bool = False, with_kind: bool = False) -> DataFrame:
    """Pairs (``group``, key_a, key_b) of keys whose shingle sets overlap by ``threshold`` or more.

    Texts are compared only inside one ``group`` (a column of ``df``, or all rows). The default bands find a
    pair at 0.6 with probability 0.99 and at 0.65 with 0.999; what they find is verified exactly. Keys of
    byte-equal texts are paired too; a class with more than ``expand_limit`` keys stands for its members through
    its smallest key (key_a) so that its rows stay linear in its size. ``weighted``: a shingle weighs as often as it
    stands in its text and the similarity is the probability Jaccard of the weights; else all weigh the same and it is
    the plain Jaccard. ``with_kind``: a column more, ``copy`` for two keys of one text, ``member`` for a key of a big class and
    the smallest of it, ``near`` for two texts, and the number of keys that each end of the pair stands for (n_a, n_b)."""
    spark = df.sparkSession
    base = df.select(F.col(group).alias("g") if group else F.lit("").alias("g"), F.col(key).alias("k"), F.col(text).alias("t")) \
        .where(F.col("t").isNotNull() & F.col("k").isNotNull() & (F.length("t") >= 2 * min_words - 1)) \
        .withColumn("h", F.xxhash64("g", "t"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()  # texts this task has signed already: copies go on once a task
        for b in batches:
            for lo, hi in slices(b["t"]):
                p = b.iloc[lo:hi].drop_duplicates("h")
                p = p[[x not in done for x in p["h"]]]
                if len(done) > 500_000:
                    done.clear()
                done.update(p["h"])
                values, owner, long, weights = _sets(p["t"].tolist(), shingle, min_words, weighted)
                if not long.any():
                    continue
                new = np.cumsum(long) - 1
                keys = band_keys(probminhash(values, new[owner], int(long.sum()), bands * rows, weights), bands, rows)
                yield pd.DataFrame({"h": p["h"].to_numpy()[long], "b": list(keys)})

    signed = spread(base.select("h", "t")).mapInPandas(sign, "h long, b array<long>")
    bucket = W.partitionBy("b")
    shared = signed.select("h", F.explode("b").alias("b")) \
        .select("b", "h", F.min("h").over(bucket).alias("lo"), F.max("h").over(bucket).alias("hi")).where("lo < hi").select("b", "h")
    shared = stage(shared, "near-dup-buckets").distinct()
    # every text against the later ones of its bucket; AQE splits a bucket that is too large for a task
    candidates = shared.alias("x").join(shared.alias("y"), F.expr("x.b = y.b and x.h < y.h")) \
        .select(F.col("x.h").alias("lo"), F.col("y.h").alias("hi")).distinct()
    candidates = stage(candidates, "near-dup-candidates")
    wanted = candidates.select(F.explode(F.array("lo", "hi")).alias("h")).distinct()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in slices(b["t"]):
                p = b.iloc[lo:hi]
                values, owner, _, weights = _sets(p["t"].tolist(), shingle, 0, weighted)
                cut = np.searchsorted(owner, np.arange(1, len(p)))
                sketch = (probminhash(values, owner, len(p), SKETCH, weights) >> np.uint64(20)).astype(np.uint8)
                w = np.split(weights, cut) if weighted else None
                yield pd.DataFrame({"h": p["h"].to_numpy(), "s": np.split(values.view(np.int64), cut), "w": w, "k": [r.tobytes() for r in sketch]})

    texts = base.select("h", "t").join(wanted, "h", "left_semi").dropDuplicates(["h"])
    sized = stage(texts.mapInPandas(sets, "h long, s array<long>, w array<double>, k binary"), "near-dup-sets")

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(-1, SKETCH) for c in ("ka", "kb"))
            keep = (x == y).mean(axis=1) >= threshold - slack
            yield b.loc[keep, ["lo", "hi"]]

    # a byte of some registers is enough to drop pairs that are far apart before whole sets move
    slack = 4 * (threshold * (1 - threshold) / SKETCH) ** 0.5 + 1e-9
    near = candidates.join(sized.select(F.col("h").alias("lo"), F.col("k").alias("ka")), "lo") \
        .join(sized.select(F.col("h").alias("hi"), F.col("k").alias("kb")), "hi").mapInPandas(alike, "lo long, hi long")
    near = stage(near, "near-dup-near")
    ends = near.select(F.explode(F.array("lo", "hi")).alias("h")).distinct()
    carried = ["s", "w"] if weighted else ["s"]
    whole = sized.select("h", *carried).join(ends, "h", "left_semi")
    both = near.join(whole.select(F.col("h").alias("lo"), *[F.col(c).alias(f"{c}a") for c in carried]), "lo") \
        .join(whole.select(F.col("h").alias("hi"), *[F.col(c).alias(f"{c}b") for c in carried]), "hi")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            j = [probability_jaccard(dict(zip(sa, wa)), dict(zip(sb, wb))) for sa, wa, sb, wb in zip(b["sa"], b["wa"], b["sb"], b["wb"])]
            yield b.loc[np.array(j) >= threshold - 1e-9, ["lo", "hi"]]

    if weighted:
        links = both.mapInPandas(verify, "lo long, hi long")
    else:
        both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
        links = both.where(F.col("common") >= threshold * (F.size("sa") + F.size("sb") - F.col("common")) - 1e-9).select("lo", "hi")
    links = stage(links, "near-dup-links")

    long_enough = F.size(F.regexp_extract_all("t", F.lit(_NO_SPACE), 0)) >= min_words
    members = base.where(long_enough).select("g", "h", "k").distinct()
    linked = links.select(F.explode(F.array("lo", "hi")).alias("h")).distinct()
    classes = members.groupBy("g", "h").agg(F.count("*").alias("n"), F.min("k").alias("least"))
    copies = members.join(classes.where("n > 1"), ["g", "h"])
    small, big = copies.where(F.col("n") <= expand_limit), copies.where(F.col("n") > expand_limit)
    one = F.lit(1).cast("long")
    same = small.alias("x").join(small.alias("y"), F.expr("x.g = y.g and x.h = y.h and x.k < y.k")) \
        .select(F.col("x.g").alias("g"), F.col("x.k").alias("ka"), F.col("y.k").alias("kb"), F.lit("copy").alias("kind"), one.alias("n_a"), one.alias("n_b"))
    star = big.where("k > least").select("g", F.col("least").alias("ka"), F.col("k").alias("kb"), F.lit("member").alias("kind"), F.col("n").alias("n_a"), one.alias("n_b"))
    # a side of a link that is a big class takes part with its smallest key
    ends = members.join(linked, "h", "left_semi").join(classes.select("g", "h", "n", "least"), ["g", "h"]) \
        .where((F.col("n") <= expand_limit) | (F.col("k") == F.col("least"))).select("g", "h", "k", F.when(F.col("n") <= expand_limit, one).otherwise(F.col("n")).alias("n"))
    cross = links.join(ends.select("g", F.col("h").alias("lo"), F.col("k").alias("ka"), F.col("n").alias("na")), "lo") \
        .join(ends.select(F.col("g").alias("g2"), F.col("h").alias("hi"), F.col("k").alias("kb"), F.col("n").alias("nb")), "hi") \
        .where("g = g2 and ka <> kb")
    first = F.col("ka") < F.col("kb")
    cross = cross.select("g", F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"), F.lit("near").alias("kind"),
                         F.when(first, F.col("na")).otherwise(F.col("nb")).alias("n_a"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("n_b"))
    out = same.unionByName(star).unionByName(cross)
    if not with_kind:
        out = out.select("g", "ka", "kb").distinct()
        return out.select(F.col("g").alias(group or "group"), F.col("ka").alias("key_a"), F.col("kb").alias("key_b"))
    # a key with two texts may be in a pair for more than one reason: the closest is told
    out = out.groupBy("g", "ka", "kb").agg(F.min("kind").alias("kind"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return out.select(F.col("g").alias(group or "group"), F.col("ka").alias("key_a"), F.col("kb").alias("key_b"), "kind", "n_a", "n_b")
