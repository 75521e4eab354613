import itertools
import random

from foliant.llm import _visual, lookalike

PLAIN = "La función benéfica de la casa, según consta en el libro. Peсes no"


def disguise(text, r):
    back = {v: k for k, v in _visual.CYRILLIC_AS_LATIN.items()}
    out = []
    for c in text:
        x = r.random()
        out.append(back[c] if c in back and x < 0.3 else chr(ord(c) + 0xFEE0) if "!" <= c <= "~" and x > 0.95 else " " if c == " " and x < 0.2 else c)
        if r.random() < 0.05:
            out.append("​")
    return "".join(out)


def test_pairs_equal_brute_force(spark):
    r = random.Random(1)
    base = [f"La función benéfica número {'abcdefgh'[i]} de la casa repite el disco en el puerto" for i in range(8)] + ["Радио Мирный говорит", "oca", "оса", "se va", "ѕе va"]
    docs, n = [], 0
    for t in base:
        for _ in range(3):
            docs.append((n, disguise(t, r) if r.random() < 0.7 else t))
            n += 1
    docs += [(900, None), (901, ""), (902, " ​\n"), (903, "⁠ "), (904, docs[0][1]), (905, "café"), (906, "café"), (907, "café!"), (908, "CAFÉ"), (909, "ﬁn de l·l"), (910, "fin de ŀl")]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in docs], "doc_id long, text string, form string, raw string")
    got = {tuple(x) for x in lookalike.same_look_pairs(df, "doc_id", "text").collect()}
    seen = [(k, t, _visual.seen_as(t)) for k, t in docs if t is not None and _visual.seen_as(t).strip()]
    want = {(a, b) for (a, x, f), (b, y, g) in itertools.combinations(seen, 2) if f == g and x != y}
    assert got == want and (905, 906) in got and (909, 910) in got
    assert lookalike.same_look_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_big_classes_come_out_whole(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "PART_PAIRS", 500, raising=False)
    texts = ["la casa"] * 1200 + ["la  casa".replace("  ", "\u00a0")] + ["la cas\u0430", "la c\u0430sa"] * 2 + ["otro"]
    df = spark.createDataFrame([(k * 7919 % 2003, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = [tuple(x) for x in lookalike.same_look_pairs(df, "doc_id", "text").collect()]
    docs = [(k, t) for k, t in ((r.doc_id, r.text) for r in df.collect()) if t != "otro"]
    want = {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(docs, 2) if x != y}
    assert len(got) == len(set(got)) and set(got) == want


def test_forms(spark):
    df = spark.createDataFrame([(1, "la casa"), (2, "lа саsа"), (3, None), (4, ""), (5, "Радио"), (6, "zzаzz"), (7, "x" * 200000 + "а")], "doc_id long, text string")
    got = {r.doc_id: r.form for r in lookalike.consistent_form(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == "la casa" and got[3] is None and got[4] == "" and got[5] == "Радио"
    assert got[6] == "zzаzz"  # no word of the corpus


def test_script_decides():
    assert lookalike.repair_of("vіgilante", "LATIN") == "vigilante"
    assert lookalike.repair_of("Радиo", "LATIN") == "Радио"
    assert lookalike.repair_of("Мирный", "LATIN") is None
    assert lookalike.repair_of("се", "LATIN") == "ce" and lookalike.repair_of("се", "CYRILLIC") is None
