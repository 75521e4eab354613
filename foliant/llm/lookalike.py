"""One consistent form for texts that look the same.

Invisible characters, special blanks and hyphens, wide forms, ligatures and loose accents are made plain by table.
Look-alike letters are repaired per token, by script. Letters that look like no other decide which script is dominant,
in a token or, where it has none, in its document (a token of ambiguous letters alone looks like a word of either
script); a token is rewritten in that script only if the result is a word that some document of the corpus spells in
one script.

Defined cases: null texts have a null form and no pair; texts without a visible character have an empty form and no
pair; byte-equal texts are no pair; control characters, carriage returns too, count as invisible.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import _visual
from foliant.plans.staging import spread, stage

_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
#: The pairs of two stored forms that one part of the join makes, about, and the most parts for two forms.
PART_PAIRS, MAX_PARTS = 1_000_000, 1000


_AMBIGUOUS = set(_visual.LOOKALIKE) | set(_visual.LOOKALIKE.values())


def dominant(text: str) -> str:
    """The script of most letters that look like no letter of another; LATIN if there is none."""
    scripts = Counter(_visual.script(c) for c in unicodedata.normalize("NFD", text) if c not in _AMBIGUOUS)
    scripts.pop("", None)
    return max(scripts, key=lambda s: (scripts[s], s == "LATIN")) if scripts else "LATIN"


def repair_of(token: str, document_script: str) -> str | None:
    """What a token with foreign letters stands for: its letters in its dominant script, or in the document's if all of
    them are ambiguous. None if that changes nothing or leaves letters of another script."""
    bare = unicodedata.normalize("NFD", token)
    scripts = {_visual.script(c) for c in bare if c not in _AMBIGUOUS} - {""}
    if len(scripts) > 1:
        return None
    target = scripts.pop() if scripts else document_script
    if target == "LATIN":
        new = _visual.as_latin(token)
    elif target in ("CYRILLIC", "GREEK"):
        new = _visual.as_script(token, target)
    else:
        return None
    return new if new != token and {_visual.script(c) for c in new} <= {target, ""} else None


_COLUMNS = "raw string, f string, form string, odd array<string>, words array<string>"


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """k, raw and f (hashes of the stored text and of its plain form), the form itself and what its foreign tokens may stand for
    only where there are such, and in the first row of a batch the words of one script that the task has not met before."""
    md5 = lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()
    met: set[str] = set()
    for b in batches:
        rows, new = [], set()
        for k, t in zip(b["k"], b["t"]):
            if t is None:
                rows.append((k, None, None, None, [], []))
                continue
            form = _visual.plain(t)
            tokens = set(_TOKEN.findall(form))
            odd: set[str] = set()
            if _visual.has_foreign(form):
                main = dominant(form)
                foreign = {w for w in tokens if _visual.has_foreign(w)}
                odd.update(filter(None, (repair_of(w, main) for w in foreign)))
                tokens -= {w for w in foreign if len({_visual.script(c) for c in w} - {""}) != 1}
            new |= tokens - met
            seen = form if form.strip() else None
            rows.append((k, md5(t), md5(form) if seen is not None else None, form if odd else None, sorted(odd), []))
        if len(met) > 1_000_000:  # only so that a task's memory stays bounded; words may be told twice
            met.clear()
        met |= new
        out = pd.DataFrame(rows, columns=["k", "raw", "f", "form", "odd", "words"])
        if len(out):
            out.at[0, "words"] = sorted(new)
        yield out


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for t, good in zip(b["form"], b["good"]):
            allowed = set(good) if good is not None else set()
            main = dominant(t) if allowed else ""
            out.append(_TOKEN.sub(lambda m, a=allowed, s=main: _rewrite(m[0], s, a), t) if allowed else t)
        yield b[["k", "raw"]].assign(form=out)


def _prepared(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, str]:
    """The staged table of ``_prepare``, the repaired forms (k, raw, form) of texts with foreign tokens, and the key's type."""
    kind = df.schema[key].dataType.simpleString()
    src = stage(spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInPandas(_prepare, f"k {kind}, {_COLUMNS}"), "forms")
    odd = src.where(F.size("odd") > 0)
    options = odd.select("k", F.explode("odd").alias("w")).distinct()
    vocabulary = src.where(F.size("words") > 0).select(F.explode("words").alias("w"))
    known = options.join(vocabulary, "w", "left_semi").groupBy("k").agg(F.collect_set("w").alias("good"))
    return src, odd.select("k", "raw", "form").join(known, "k", "left").mapInPandas(_repair, f"k {kind}, raw string, form string"), kind


def consistent_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, raw, form): a hash of the stored text and the text in the one consistent form."""
    src, mended, kind = _prepared(df, key, text)

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "raw": raw, "form": [None if t is None else _visual.plain(t) for t in b["t"]]})

    every = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(plain, f"k {kind}, raw string, form string")
    again = mended.select("k", "raw", F.col("form").alias("mended")).distinct()
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("k", "raw")]
    return every.alias("x").join(again.alias("y"), same, "left").select(F.col("x.k").alias(key), F.col("x.raw").alias("raw"), F.coalesce("y.mended", "x.form").alias("form"))


def _rewrite(token: str, document_script: str, allowed: set[str]) -> str:
    if not _visual.has_foreign(token):
        return token
    new = repair_of(token, document_script)
    return new if new in allowed else token


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``_a, ``key``_b), smaller first: all texts that look the same and are stored differently.

    Stored forms are paired first and then their members, so byte-equal texts are never compared: the work is in proportion
    to the pairs. Where two forms make many pairs, the members of the more frequent one are spread over parts."""
    src, mended, _ = _prepared(df, key, text)
    forms = src.where("f is not null and size(odd) <= 0").select("k", "raw", "f").unionByName(mended.select("k", "raw", F.md5("form").alias("f"))).distinct()
    variants = forms.groupBy("f", "raw").agg(F.count("*").alias("n"))
    mixed = variants.groupBy("f").agg(F.count("*").alias("v")).where("v > 1").select("f")
    rows = stage(forms.join(mixed, "f", "left_semi").select("f", "raw", "k"), "same-look")
    stored = rows.groupBy("f", "raw").agg(F.count("*").alias("n"))
    two = stored.alias("x").join(stored.alias("y"), F.expr("x.f = y.f and (x.n > y.n or x.n = y.n and x.raw < y.raw)")) \
        .select("x.f", F.col("x.raw").alias("raw_x"), F.col("y.raw").alias("raw_y"), F.expr(f"cast(least({MAX_PARTS}, 1 + x.n * y.n div {PART_PAIRS}) as int)").alias("parts"))
    x = two.join(rows.select("f", F.col("raw").alias("raw_x"), F.col("k").alias("x")), ["f", "raw_x"]).withColumn("part", F.expr("cast(pmod(xxhash64(x), parts) as int)"))
    y = two.join(rows.select("f", F.col("raw").alias("raw_y"), F.col("k").alias("y")), ["f", "raw_y"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    pairs = x.select("f", "raw_x", "raw_y", "part", "x").join(y.select("f", "raw_x", "raw_y", "part", "y"), ["f", "raw_x", "raw_y", "part"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()
