import itertools
import random

import numpy as np

from foliant.llm import near_dup
from foliant.llm._hashing import distinct_by_owner, shingles, word_hashes


def brute(rows, k, threshold, min_words):
    sets = {}
    for key, t in set(rows):
        if key is None or t is None or len(t.split()) < min_words:
            continue
        w = t.lower().split()
        sets[key] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if a != b and x | y and len(x & y) / len(x | y) >= threshold}


def corpus(seed=3, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [r.choice(words) for _ in range(80)]
        rows.append((f"a{i:03d}", " ".join(base)))
        for j in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((f"a{i:03d}_{j}", " ".join(copy).upper() if j == 1 else " ".join(copy)))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    rows += rows[:3] + [("null", None), (None, rows[0][1]), ("empty", ""), ("blank", "   "), ("short", "one two three"), ("long", " ".join(rows[0][1].split() * 300))]
    df = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "key string, text string, h int, b int, g string")
    got = {(r.key_a, r.key_b) for r in near_dup.near_duplicate_pairs(df, "key", "text", shingle=3, threshold=0.6, min_words=40).collect()}
    assert got == brute(rows, 3, 0.6, 40)
    assert len(got) > 20


def test_default_takes_five_words_and_four_fifths(spark):
    rows = corpus(5, 30)
    df = spark.createDataFrame(rows, "key string, text string")
    got = {(r.key_a, r.key_b) for r in near_dup.near_duplicate_pairs(df, "key", "text").collect()}
    assert got == brute(rows, 5, 0.8, 5)


def test_groups_are_apart_and_empty_table(spark):
    t = " ".join(f"x{i}" for i in range(50))
    df = spark.createDataFrame([("a", t, "p"), ("b", t, "p"), ("a", t, "q")], "key string, text string, part string")
    got = near_dup.near_duplicate_pairs(df, "key", "text", group="part").collect()
    assert [tuple(r) for r in got] == [("p", "a", "b")]
    assert near_dup.near_duplicate_pairs(df.limit(0), "key", "text", group="part").collect() == []


def test_large_class_of_copies_is_a_star(spark):
    t = " ".join(f"x{i}" for i in range(50))
    other = t.replace("x49", "y")
    df = spark.createDataFrame([(f"k{i:02d}", t) for i in range(30)] + [("z", other)], "key string, text string")
    got = {(r.key_a, r.key_b) for r in near_dup.near_duplicate_pairs(df, "key", "text", expand_limit=10).collect()}
    assert got == {("k00", f"k{i:02d}") for i in range(1, 30)} | {("k00", "z")}
    told = {(r.key_b, r.kind, r.n_a, r.n_b) for r in near_dup.near_duplicate_pairs(df, "key", "text", expand_limit=10, with_kind=True).collect()}
    assert told == {(f"k{i:02d}", "member", 30, 1) for i in range(1, 30)} | {("z", "near", 30, 1)}


def test_signature_estimates_jaccard():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate((a[:200], r.integers(0, 1 << 62, 100).astype(np.uint64)))
    v, o = np.concatenate((a, b)), np.repeat([0, 1], 300)
    s = near_dup.probminhash(*distinct_by_owner(v, o), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05


def test_hashes_do_not_depend_on_place():
    w1, c1 = word_hashes(["uno dos tres", "", " dos  uno\ttres"])
    assert list(c1) == [3, 0, 3] and w1[0] == w1[4] and w1[1] == w1[3] and w1[2] == w1[5]
    s, o = shingles(w1, c1, 3)
    assert list(o) == [0, 2] and s[0] != s[1]


def brute_probability_jaccard(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def test_weighted_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(2)
    ids = r.integers(0, 1 << 62, 200).astype(np.uint64)
    x = {int(i): float(w) for i, w in zip(ids[:150], r.integers(1, 9, 150))}
    y = {int(i): float(w) for i, w in zip(ids[50:], r.integers(1, 9, 150))} | {int(i): x[int(i)] for i in ids[50:110]}
    want = brute_probability_jaccard(x, y)
    assert abs(near_dup.probability_jaccard(x, y) - want) < 1e-9 and near_dup.probability_jaccard(x, x) > 1 - 1e-9
    values, weights = np.array([*x, *y], np.uint64), np.array([*x.values(), *y.values()])
    s = near_dup.probminhash(values, np.repeat([0, 1], [len(x), len(y)]), 2, 4000, weights)
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    # weights only scaled change nothing; without weights it is the plain Jaccard
    t = near_dup.probminhash(values, np.repeat([0, 1], [len(x), len(y)]), 2, 400, weights * 3)
    assert (t == near_dup.probminhash(values, np.repeat([0, 1], [len(x), len(y)]), 2, 400, weights)).all()
    assert abs(brute_probability_jaccard(dict.fromkeys(x, 1), dict.fromkeys(y, 1)) - len(x.keys() & y.keys()) / len(x.keys() | y.keys())) < 1e-9


def test_weighted_pairs_and_unusual_spaces(spark):
    refrain = " ".join(f"r{i}" for i in range(8))
    a = " ".join([refrain] * 30 + [f"a{i}" for i in range(30)])
    b = " ".join([refrain] * 30 + [f"b{i}" for i in range(30)])
    df = spark.createDataFrame([("a", a), ("b", b), ("c", " ".join(f"c{i}" for i in range(90)))], "key string, text string")
    pairs = lambda **k: {(r.key_a, r.key_b) for r in near_dup.near_duplicate_pairs(df, "key", "text", shingle=3, threshold=0.6, **k).collect()}
    assert pairs() == set() and pairs(weighted=True) == {("a", "b")}
    # words parted by other than plain blanks are words; a leading line break is none
    t = [f"x{i}" for i in range(40)]
    df = spark.createDataFrame([("a", "\u00a0".join(t)), ("b", "\u2003".join(t)), ("c", "\n" + " ".join(t[:39])), ("d", "\n" + " ".join(t[:39]))], "key string, text string")
    assert pairs(min_words=40) == {("a", "b")}
