import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN

from foliant.llm import tokens

RANKS = tokens.load_ranks()
OURS = tokens.Encoder(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8))
def test_any_text(texts):
    assert OURS(texts)[0] == [THEIRS.encode_ordinary(t) for t in texts]


def test_contractions_and_blanks():
    r = random.Random(2)
    alpha = ["'", "s", "'re", "'ll", "'LL", " ", "  ", "\n", "\t", "\xa0", "é", "1", "!", "...", "<|endoftext|>", "a" * 70]
    texts = ["".join(r.choice(alpha) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    assert OURS(texts)[0] == [THEIRS.encode_ordinary(t) for t in texts]


def test_long_piece_and_decoding():
    text = "a" * 50000 + " ñandú\n" + "1" * 3000
    ids, offsets = OURS([text])
    assert tokens.decode(ids[0], RANKS) == text
    assert offsets[0][0] == 0 and all(b > a for a, b in zip(offsets[0], offsets[0][1:]))


def test_frame(spark):
    df = spark.createDataFrame([(1, "Hola, món"), (2, None), (3, ""), (1, "Hola, món")], "doc_id long, text string").withColumn("ids", df_lit())
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode(df, "doc_id", "text").collect())
    hola = THEIRS.encode_ordinary("Hola, món")
    assert got == [(1, hola), (1, hola), (2, []), (3, [])]
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert list(tokens.encode(df, "doc_id", "text", with_offsets=True).where("doc_id = 1").first().offsets) == [0, 4, 5]


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
