"""Linking the spellings of people and bodies to the entries of a register by merge-and-rematch resolution.

Every register entry starts as a profile of its own name: given name, surnames and initials of a person, kind, name and
place of a body. A distributed table of blocks (a name part less one letter, profile) is joined with the parts of the
spellings; what meets in a block is compared part by part. A merge unions what the spelling has into the profile: the
written form of its surnames or its name, and the form of its given name or kind. A form that two entries of one given
name (or kind) have been merged under goes to all profiles of that name, with its initial. The richer profiles give new
blocks and everything unmatched is compared again, until a round merges nothing. No form of any name is in the code.

Defined cases: null, empty and blank spellings link to nothing; a spelling between two entries links to neither; equal
spellings are one; entries with equal names are each other's tie, so neither is linked; the entity type of a mention is
not trusted and not read; an empty register gives no rows; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.plans.staging import spread, stage

# Words of address and joining words, which are parts of no name.
TITLES = {"don", "dona", "d", "sr", "sra", "srta", "senor", "senora", "senyor", "senyora", "dr", "dra", "en", "na", "mtro", "mtra", "da"}
PARTICLES = {"y", "i", "e", "de", "del", "la", "el", "los", "las", "les", "els", "l", "d", "dels"}
#: Bodies a word must lead in to be a kind of bodies or a place; entries a form must be seen with before others take it;
#: how much better the best entry must be than the next.
KIND_BODIES, FORM_ENTRIES, MARGIN = 3, 2, 0.25


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def osa(a: str, b: str, limit: int) -> int:
    """Edits (swaps of neighbours count one), or limit + 1."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if a == b:
        return 0
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], prev2[j - 2] + 1)
        if min(row) > limit:
            return limit + 1
        prev2, prev = prev, row
    return prev[-1]


def near(a: str, b: str) -> int | None:
    """Edits between two name parts if few enough for their length, else None."""
    limit = 0 if len(b) < 4 else 1 if len(b) < 8 else 2
    d = osa(a, b, limit)
    return d if d <= limit else None


def near_part(word: str, part: str, variants: list[str]) -> int | None:
    """Edits between a word and a part of a profile; a written form that was merged before lends one edit more."""
    d = near(word, part)
    if d is None and variants and len(part) >= 6:
        if any(near(word, v) is not None for v in variants):
            limit = (1 if len(part) < 8 else 2) + 1
            d = osa(word, part, limit)
            d = d if d <= limit else None
    return d


def contracted(word: str, dotted: bool, full: str) -> bool:
    """Whether a word is a name with letters left out: from its first letter on, to its last unless a dot follows."""
    if not 2 <= len(word) < len(full) or word[0] != full[0] or not (dotted or word[-1] == full[-1] and 2 * len(word) <= len(full) + 1):
        return False
    rest = iter(full)
    return all(c in rest for c in word)


_SPLIT = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])")

Words = list[tuple[str, bool]]


def parts(text: str) -> tuple[Words, Words]:
    """The words of a spelling in natural order, and those in parentheses; each with whether a dot follows."""
    text = _SPLIT.sub(" ", text.replace("º", "").replace("ª", ""))
    inner = " ".join(re.findall(r"\(([^)]*)\)", text))
    text = re.sub(r"\([^)]*\)", " ", text)
    if text.count(",") == 1:
        a, b = text.split(",")
        if b.strip() and a.strip():
            text = f"{b} {a}"

    def words(s: str) -> Words:
        return [(m[1], bool(m[2])) for m in re.finditer(r"([a-z]+)(\.?)", fold(s))]

    return words(text), words(inner)


def given_score(word: str, dotted: bool, full: str, forms: list[str], known: set[str]) -> tuple[float, bool] | None:
    """How well a word stands for a given name with these forms (2 in full, less for forms, abbreviations and initials), and
    whether it is a form of its own.

    known: the words of the spelling that are given names of the register or forms of them."""
    if word == full:
        return 2.0, False
    if word in forms:
        return 1.8, False
    if len(word) == 1:
        score = 0.8 if full[0] == word else 0.5 if any(f[0] == word for f in forms) else None
        return None if score is None else (score, False)
    if contracted(word, dotted, full) and word not in known:
        return 1.3, True
    if (dotted or len(word) >= 3) and (full.startswith(word) or any(f.startswith(word) for f in forms)):
        return 1.2, True
    if word in known:
        return None
    if near(word, full) is not None:
        return 1.5, True
    if any(len(f) > 3 and near(word, f) is not None for f in forms):
        return 1.3, True
    # a pet form: a longer or shorter ending, or the middle of the name
    stem = max(4, len(full) - 2)
    if len(full) >= 4 and (word.startswith(full) or word[:stem] == full[:stem] or len(word) >= 4 and word in full):
        return 1.2, True
    return None


#: What a comparison gives: score, whether it is a merge (else only evidence for the form), the form, parts as written.
Match = tuple[float, bool, str | None, str, str]


def match_person(words: Words, titled: bool, p: dict, known: set[str]) -> Match | None:
    """A spelling as this person, or None."""
    given, s1, s2 = p["given"], p["s1"], p["s2"]
    best = None
    for at, (w, _) in enumerate(words):
        if len(w) < 3:
            continue
        score, used, edits, second = 0.0, {at}, near_part(w, s1, p["v1"]), ""
        joined = near(w, s1 + s2) if s2 and len(w) > len(s1) + 2 else None
        if joined is not None and (edits is None or joined < edits):
            score, edits, first = 5.0 - 0.6 * joined, joined, ""
        elif edits is not None:
            score, first = 3.0 - 0.5 * edits, w
            nxt = at + 1
            if s2 and nxt < len(words):
                x, _ = words[nxt]
                d = near_part(x, s2, p["v2"])
                if d is not None:
                    score, edits, second = score + 2.0 - 0.5 * d, edits + d, x
                    used.add(nxt)
                elif len(x) == 1 and x == s2[0]:
                    score += 0.7
                    used.add(nxt)
        else:
            continue
        rest = [words[k] for k in range(len(words)) if k not in used]
        form, sure = None, True
        if not rest:
            if not titled:
                continue
            score += 0.1
        elif len(rest) <= 2:
            got = [given_score(x, d, given, p["forms"], known) for x, d in rest]
            if len(rest) == 2 and (got[0] is None) != (got[1] is None):
                # one of two given names may be left unnamed in the register: the other decides
                other = rest[1 if got[1] is None else 0][0]
                got = [max(g for g in got if g is not None)] if other in known or len(other) == 1 else [None]
            if None in got:
                if not (len(rest) == 1 and rest[0][0] not in known and rest[0][0] not in TITLES and len(rest[0][0]) > 2):
                    continue
                form, sure = rest[0][0], False
            else:
                top = max(range(len(got)), key=lambda k: got[k][0])
                score += got[top][0]
                if len(got) == len(rest) and got[top][1]:
                    form = rest[top][0]
        else:
            continue
        if edits > 3:
            continue
        if best is None or score > best[0]:
            best = (score, sure, form, first, second)
    return best


def _kind_match(word: str, dotted: bool, kind: list[str], forms: list[str]) -> bool:
    if len(kind) > 1 and word == "".join(k[0] for k in kind):
        return True
    for k in kind:
        if word == k or k.startswith(word) or near(word, k) is not None or contracted(word, dotted, k):
            return True
        if len(word) >= 5 and len(k) >= 5 and osa(word, k, 4) <= max(2, len(k) // 3):
            return True
        if dotted and len(word) >= 3 and any(osa(word, k[:n], 1) <= 1 for n in range(len(word) - 1, len(word) + 2)):
            return True
    return any(word == f or len(f) > 3 and osa(word, f, 1) <= 1 for f in forms)


def match_body(words: Words, inner: Words, p: dict, kind_words: set[str]) -> Match | None:
    """A spelling as this body, or None. kind_words: the words of the spelling that are kinds of bodies."""
    kind, core, place = p["kind"], p["core"], p["place"]
    best = None
    for at, (w, _) in enumerate(words):
        d = near_part(w, core, p["v1"])
        if d is None or len(w) < 3:
            continue
        rest = [words[k] for k in range(len(words)) if k != at and words[k][0] not in PARTICLES] + inner
        places = [x for x, _ in rest if x in place or any(near(x, q) is not None for q in place)]
        kinds = [(x, dot) for x, dot in rest if x not in places and x not in PARTICLES]
        hit = [_kind_match(x, dot, kind, p["forms"]) for x, dot in kinds]
        score, form, sure = 3.0 - 0.5 * d + 0.3 * bool(places), None, True
        if kinds and all(hit):
            score += 1.5
            short = [x for x, _ in kinds if len(x) > 3 and x not in p["forms"] and any(contracted(x, True, k) for k in kind)]
            form = short[0] if short else None
        elif len(kinds) - sum(hit) == 1 and (sum(hit) or d == 0) and len(kinds) <= 2:
            form = next(x for (x, _), h in zip(kinds, hit) if not h)
            if len(form) < 3 or form in kind_words or form in TITLES:
                continue
            score += 0.3
            sure = False
        elif kinds:
            continue
        else:
            score += 0.2
        if best is None or score > best[0]:
            best = (score, sure, form, w, "")
    return best


def match(words: Words, inner: Words, p: dict, known: set[str]) -> Match | None:
    """A spelling against a profile, or None."""
    bare = lambda ws: [(w, dot) for w, dot in ws if not (w in PARTICLES and not dot)]
    if p["core"]:
        return match_body(words, inner, p, known)
    readings = [(bare(words), False)]
    if words and words[0][0] in TITLES:
        readings.append((bare(words[1:]), True))
    got = [g for r, titled in readings if (g := match_person(r, titled, p, known)) is not None]
    return max(got, key=lambda g: g[0]) if got else None


_WORDS = "array<struct<w: string, dot: boolean>>"
_PROFILE = ["given", "s1", "s2", "kind", "core", "place"]


def _split(df: DataFrame, text: str, keep: str) -> DataFrame:
    """``keep``, text, words, inner: the parts of each text."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns) + f", words {_WORDS}, inner {_WORDS}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [parts(t) for t in b[text]]
            as_rows = lambda ws: [{"w": w, "dot": d} for w, d in ws]
            yield b.assign(words=[as_rows(w) for w, _ in both], inner=[as_rows(i) for _, i in both])

    return df.mapInPandas(run, schema).select(*keep.split(), "words", "inner")


def _less_one(word: str) -> Column:
    """A word and what is left of it without one of its letters."""
    return F.expr(f"array_distinct(concat(array({word}), transform(sequence(1, greatest(1, length({word}))), i -> concat(substr({word}, 1, i - 1), substr({word}, i + 1)))))")


def _profiles(register: DataFrame, key: str, kind: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(id and the parts of each entry's own name), (word, of): given names and kinds of the register."""
    rows = register.select(F.col(key).alias("id"), F.col(kind).alias("type"), F.col(name).alias("name")).where("id is not null and name is not null").distinct()
    cut = _split(rows, "name", "id type").withColumn("words", F.transform("words", lambda x: x["w"]))
    names = F.filter("words", lambda w: ~w.isin(*sorted(PARTICLES)))
    people = cut.where("type = 'person'").withColumn("n", names).where("size(n) >= 2").select(
        "id", F.expr("n[0]").alias("given"), F.expr("if(size(n) > 3, n[size(n) - 2], n[1])").alias("s1"), F.expr("if(size(n) > 2, n[size(n) - 1], '')").alias("s2"))
    bodies = cut.where("coalesce(type, '') <> 'person'").select("id", F.posexplode(names).alias("pos", "w"))
    kinds = bodies.groupBy("w").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= KIND_BODIES).select("w", F.lit(True).alias("is_kind"))
    listed = bodies.join(kinds, "w", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "w", F.coalesce("is_kind", F.lit(False)).alias("k")))).alias("l")) \
        .withColumn("at", F.expr("array_position(transform(l, x -> x.k), false)")).where("at > 0")
    bodies = listed.select("id", F.expr("transform(slice(l, 1, cast(at - 1 as int)), x -> x.w)").alias("kind"), F.expr("l[cast(at - 1 as int)].w").alias("core"),
                           F.expr("transform(slice(l, cast(at + 1 as int), size(l)), x -> x.w)").alias("place"))
    words = F.array().cast("array<string>")
    profiles = people.select("id", "given", "s1", "s2", words.alias("kind"), F.lit("").alias("core"), words.alias("place")).unionByName(
        bodies.select("id", F.lit("").alias("given"), F.lit("").alias("s1"), F.lit("").alias("s2"), "kind", "core", "place"))
    known = people.select(F.col("given").alias("word")).withColumn("of", F.lit("given")).unionByName(kinds.select(F.col("w").alias("word"), F.lit("kind").alias("of"))).distinct()
    return stage(profiles, "name-profiles"), known


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = []
        cols = {c: b[c].tolist() for c in b.columns}
        for i, spelling in enumerate(cols["spelling"]):
            p = {c: cols[c][i] for c in _PROFILE}
            for c in ("forms", "v1", "v2", "kind", "place"):
                p[c] = list(cols[c][i]) if cols[c][i] is not None else []
            known = set(cols["known"][i]) if cols["known"][i] is not None else set()
            words, inner = ([(x["w"], x["dot"]) for x in cols[c][i]] for c in ("words", "inner"))
            got = match(words, inner, p, known)
            if got is not None:
                found.append((spelling, cols["id"][i], *got))
        if found:
            yield pd.DataFrame(found, columns=["spelling", "id", "score", "sure", "form", "w1", "w2"])


def link_rounds(spellings: DataFrame, text: str, register: DataFrame, key: str, kind: str, name: str) -> DataFrame:
    """(spelling, ``key``, round): as ``link_spellings``, with the round in which each was merged."""
    id_type = register.schema[key].dataType.simpleString()
    profiles, own = _profiles(register, key, kind, name)
    taken = register.select(F.col(name).alias("spelling"))
    open_ = spellings.select(F.col(text).alias("spelling")).where(F.col("spelling").rlike(r"\S")).distinct().join(taken, "spelling", "left_anti")
    cut = stage(_split(spread(open_), "spelling", "spelling"), "spellings")
    each = cut.select("spelling", F.explode(F.expr("array_distinct(transform(concat(words, inner), x -> x.w))")).alias("word"))
    keys = each.where("length(word) > 2").select("spelling", F.explode(_less_one("word")).alias("block"))

    merges: list[DataFrame] = []  # what each round merged for good
    forms: DataFrame | None = None  # (form, stands, of): forms learned so far
    learned = 0
    n_round = 0
    while True:
        n_round += 1
        grown, known = profiles, own
        if merges:
            done = reduce(DataFrame.unionByName, merges)
            written = done.groupBy("id").agg(F.collect_set(F.nullif(F.col("w1"), F.lit(""))).alias("v1"), F.collect_set(F.nullif(F.col("w2"), F.lit(""))).alias("v2"))
            grown = grown.join(written, "id", "left")
            cut_open = cut.join(done.select("spelling"), "spelling", "left_anti")
        else:
            none = F.array().cast("array<string>")
            grown = grown.withColumn("v1", none).withColumn("v2", none)
            cut_open = cut
        if forms is not None:
            stands = grown.select("id", F.explode(F.expr("if(core = '', array(given), kind)")).alias("stands"), F.expr("if(core = '', 'given', 'kind')").alias("of"))
            taught = stands.join(forms, ["stands", "of"]).groupBy("id").agg(F.collect_set("form").alias("forms"))
            grown = grown.join(taught, "id", "left")
            known = known.unionByName(forms.where("of = 'given'").select(F.col("form").alias("word"), "of"))
        else:
            grown = grown.withColumn("forms", F.array().cast("array<string>"))
        main = F.expr("if(core = '', s1, core)")
        sources = F.array_distinct(F.concat(F.array(main, F.concat("s1", "s2")), F.coalesce("v1", F.array().cast("array<string>"))))
        blocks = grown.select("id", F.explode(sources).alias("part")).where("part <> ''").select("id", F.explode(_less_one("part")).alias("block"))
        pairs = keys.join(blocks, "block").select("spelling", "id").distinct()
        heard = each.join(known, "word").groupBy("spelling").agg(F.collect_set(F.when(F.col("of") == "given", F.col("word"))).alias("given_words"), F.collect_set(F.when(F.col("of") == "kind", F.col("word"))).alias("kind_words"))
        rows = pairs.join(cut_open, "spelling").join(grown, "id").join(heard, "spelling", "left").withColumn("known", F.expr("if(core = '', given_words, kind_words)")) \
            .select("spelling", "id", "words", "inner", "known", "forms", "v1", "v2", *_PROFILE)
        scored = spread(rows).mapInPandas(_compare, f"spelling string, id {id_type}, score double, sure boolean, form string, w1 string, w2 string")
        # what is within MARGIN of the best: one entry is a merge, and all of them are evidence for a form
        near_best = scored.withColumn("top", F.max("score").over(W.partitionBy("spelling"))).where(F.col("score") > F.col("top") - MARGIN)
        result = stage(near_best.withColumn("n", F.count("*").over(W.partitionBy("spelling"))), "name-merges")
        new = result.where("n = 1 and sure").select("spelling", "id", "w1", "w2", F.lit(n_round).alias("round"))
        merges.append(new)
        stands = profiles.select("id", F.expr("if(core = '', 'given', 'kind')").alias("of"), F.explode(F.expr("if(core = '', array(given), kind)")).alias("stands"))
        asked = result.where("form is not null").groupBy("id", "form").agg(F.max(1 / F.col("n")).alias("n")).join(stands, "id").groupBy("form", "of", "stands").agg(F.sum("n").alias("n"))
        # a form is learned where it is seen with entries enough, and twice as many as it is with any other name; a spelling
        # between k entries counts as 1/k for each
        ranked = W.partitionBy("form").orderBy(F.desc("n"), "stands")
        asked = asked.withColumn("rank", F.row_number().over(ranked)).withColumn("next", F.when(F.col("of") == "given", F.lead("n").over(ranked))) \
            .where(F.col("n") >= FORM_ENTRIES).where("of = 'kind' or rank = 1 and n >= 2 * coalesce(next, 0)")
        fresh = asked.select("form", "stands", "of")
        if forms is not None:
            fresh = fresh.join(forms, ["form", "stands", "of"], "left_anti").unionByName(forms)
        forms = stage(fresh, "name-forms")
        now, merged = forms.count(), new.count()
        if now == learned and (merged == 0 or n_round > 1 and not _grows(merges)):
            break
        learned = now
    return reduce(DataFrame.unionByName, merges).select("spelling", F.col("id").alias(key), "round")


def _grows(merges: list[DataFrame]) -> bool:
    """Whether the last round wrote a name in a way that no earlier one had."""
    written = lambda df: df.select("id", F.explode(F.array("w1", "w2")).alias("w")).where("w <> ''").distinct()
    return written(merges[-1]).join(written(reduce(DataFrame.unionByName, merges[:-1])), ["id", "w"], "left_anti").limit(1).count() > 0


def link_spellings(spellings: DataFrame, text: str, register: DataFrame, key: str, kind: str, name: str) -> DataFrame:
    """(spelling, ``key``): distinct spellings and the register entry each stands for; those equal to a name of the
    register are left out."""
    return link_rounds(spellings, text, register, key, kind, name).drop("round")
