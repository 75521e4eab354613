import random

from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import split


def pieces(text, m, o):
    cuts, start, out = split.cut_positions(text, m, o), 0, []
    for i, (end, kind) in enumerate(cuts):
        out.append((text[max(0, start - o) if i else 0 : end], start, kind))
        start = end
    return out


def check(text, m, o):
    got = pieces(text, m, o)
    assert all(len(p) <= m for p, _, _ in got)
    assert "".join(p[(0 if i == 0 else min(o, got[i][1])) :] for i, (p, _, _) in enumerate(got)) == text
    for (a, *_), (b, s, _) in zip(got, got[1:]):
        assert b.startswith(a[-o:]) if len(a) >= o and o else True


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!é", max_size=400), st.integers(20, 60))
def test_round_trip(text, m):
    check(text, m, m // 5)


def test_long_and_without_boundary():
    check("x" * 20000, 4000, 200)
    r = random.Random(1)
    text = " ".join("palabra" * r.randint(1, 3) + ("." if r.random() < 0.1 else "") for _ in range(60000))
    check(text, 4000, 200)
    assert all(k in (0, 1) for _, _, k in pieces(text, 4000, 200)[:-1])


def test_limit_is_no_cut():
    assert split.cut_positions("a" * 4000) == [(4000, 5)]
    assert len(split.cut_positions("a" * 4001)) == 2


def test_frame(spark):
    text = "Una frase corta. " * 600
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "y"), (3, "", "z"), (4, "corto", "w")], "id int, text string, piece string")
    got = split.split_texts(df.drop("piece"), ["id"], "text").orderBy("id", "piece_no").collect()
    assert [r.id for r in got if r.piece_no == 1] == [1, 3, 4]
    first = [r for r in got if r.id == 1]
    assert len(first) == first[0].pieces == 3 and all(len(r.piece) <= 4000 and r.boundary in ("sentence", "end") for r in first)
    assert first[1].piece.startswith(first[0].piece[-200:])
    assert split.split_texts(df, ["id"], "text", only_long=True).where("pieces > 1").select("id").distinct().count() == 1
    assert split.split_texts(df.limit(0), ["id"], "text").count() == 0
