import random

import numpy as np

from foliant.llm import leaks
from foliant.llm._hashing import slices


def brute(docs, items, run=16):
    out = set()
    for k, t in docs:
        if t is None:
            continue
        w = leaks.words_of(t)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, s in items:
            x = leaks.words_of(s or "")
            if any(tuple(x[j : j + run]) in grams for j in range(len(x) - run + 1)):
                out.add((k, i))
    return out


def test_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"palabra{i}" for i in range(60)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, text(r.randint(10, 60))) for i in range(30)]
    docs = []
    for k in range(200):
        body = text(r.randint(0, 300))
        if r.random() < 0.6:
            x = r.choice(items)[1]
            n = r.randint(12, 22)
            a = r.randrange(max(1, len(x) - n))
            at = r.randrange(len(body) + 1)
            body[at:at] = x[a : a + n]
        docs.append((k, " ".join(body)))
    docs += [(904, "eco " * 40), (905, "eco " * 15)] + [(k, " ".join(items[7][1])) for k in range(910, 940)]
    docs += [(900, None), (901, ""), (902, " ".join(items[3][1]).upper().replace(" ", ",\n")), (903, " ".join(text(40000) + items[5][1]))]
    items = [(i, " ".join(t)) for i, t in items] + [(53, "eco " * 16), (54, "eco " * 15), (50, None), (51, ""), (52, " ".join(items[2][1]))]
    df = spark.createDataFrame([(k, t, 5) for k, t in docs], "doc_id long, text string, item int")
    it = spark.createDataFrame(items, "sample_id long, ground_truth string")
    got = {tuple(x) for x in leaks.find_leaks(df, "doc_id", "text", it, "sample_id", "ground_truth").collect()}
    assert got == brute(docs, items) and len(got) > 40
    # a map in which all signatures collide finds the same
    assert {tuple(x) for x in leaks.find_leaks(df, "doc_id", "text", it, "sample_id", "ground_truth", map_bits=64).collect()} == got
    assert leaks.find_leaks(df, "doc_id", "text", it.limit(0), "sample_id", "ground_truth").count() == 0
    assert leaks.find_leaks(df.limit(0), "doc_id", "text", it, "sample_id", "ground_truth").count() == 0


def test_words_as_seen():
    assert leaks.words_of("La ＲＡＤＩＯ, ｄe​ lа сosta — fín") == leaks.words_of("la radio de la costa fín")


def test_one_pass_and_a_third_of_the_words():
    hashes = np.random.default_rng(1).integers(0, 1 << 62, 30000).astype(np.uint64)
    sig, at = leaks.block_minima(hashes, 16, 12)
    assert len(sig) < 0.36 * len(hashes) and len(at) == len(set(at))
    assert len(leaks.block_minima(hashes[:15], 16, 12)[0]) == 0 and len(leaks.block_minima(hashes[:16], 16, 12)[0]) == 1


def test_slices_are_bounded():
    assert list(slices(["a" * 5, None, "b" * 5, "c" * 50, ""], 10)) == [(0, 3), (3, 4), (4, 5)]
    assert list(slices([])) == [] and list(slices(["x"] * 5, rows=2)) == [(0, 2), (2, 4), (4, 5)]
