"""Repair of text from scanned pages.

Words of the whole corpus are counted once, in SQL. Each word has an anagram hash (a sum over its letters), so a rare word
and a frequent one differ by the hash of what is printed less the hash of what is read in its place: the join is on hashes
less one letter or two, at the same place. The confusions of glyphs are learned from what joins: a confusion that runs
through a good part of the words with its letters is one of the scanner, others are chance. What joins by a learned
confusion, or by two of them, is a misreading and the most frequent reading wins. Words divided at line ends are joined
where the corpus has the joined word rather than the hyphenated one. Running headers are learned from lines with a
separator that stand at the edge of a text and come back, in several documents or on several pages of one; page numbers
are known by their marks.

Defined cases: null and empty texts have no defect and stay as they are; names (words of the mentions and the register
that aren't mostly in lower case) are never corrected; two readings that are equally frequent are decided by the order
of code points; repeated rows count once; a corpus too small to show a confusion in three words has none.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.names import fold, osa
from foliant.plans.staging import bounded, spread, stage

#: A confusion is learned from so many words at least, and where it is found in at least this part of the words that have what
#: is printed, compared with the confusion of most words. A form of more than a fiftieth of its right word's count (and more
#: than once) is no evidence.
EVIDENCE, STRENGTH = 3, 0.1
#: How many times more frequent the right word must be, how often it must occur, and the share of its occurrences (a third
#: of it for words of up to three letters) beyond which a form of letters alone must stand where the right word stands.
RATIO, LEAST, SHARE = 10, 5, 0.0025
#: The part of a form's occurrences that must stand beside words the right word stands beside more often than the form.
AGREED = 0.75
#: Corrections are broadcast up to this many words; beyond it tokens are joined with them instead.
MAX_BROADCAST = 500_000
#: Beginnings of headers that are searched for in one pass over the texts; more take more passes.
HEADERS_AT_ONCE = 50_000

_TOKEN = re.compile(r"[^\W_]+(?:[·-][^\W_]+)*")
_BREAK = re.compile(r"(?<=[^\W_])[-‐¬][ \t]*(?:\n\s*|[ \t]+)([^\W_]+)")
_LETTER_SQL = r"[\p{L}\p{N}]"
_TOKEN_SQL = rf"{_LETTER_SQL}+(?:[·-]{_LETTER_SQL}+)*"
_DIVIDED_SQL = rf"{_TOKEN_SQL}[-‐¬][ \t]*(?:\n\s*|[ \t]+){_LETTER_SQL}+"
_LAST_WORD = re.compile(r"[^\W_]+(?:[·-][^\W_]+)*$")
_N = r"[0-9lIO]{1,4}"
_WORD_FOR_PAGE = r"(?:p[áàa]g(?:ina)?|hoja|full|fol(?:io)?|page|seite|blatt|foglio|pagina|feuille|sheet|p)\.?\s*(?:n[úu]m\.?|n\.?[ºo°]?\.?)?"
_NUMBER_LINE = re.compile(rf"^\s*(?:{_WORD_FOR_PAGE}\s*{_N}\.?|[-–—]\s*{_N}\s*[-–—]|[(\[]\s*{_N}\s*[)\]]|\.\s*{_N}\s*\.|\d{{1,4}})\s*$", re.I)
_BEFORE_NUMBER = re.compile(rf"(?:^|(?<=\s))(?:(?P<word>{_WORD_FOR_PAGE[:-1]}\s+|p[áàa]g\.\s*)|(?P<dash>[-–—] )|(?P<open>[(\[])|(?P<dot>\. ))$", re.I)
_AFTER_NUMBER = {"word": re.compile(r"(?!\S)"), "dash": re.compile(r" [-–—](?!\S)"), "open": re.compile(r"[)\]](?!\S)"), "dot": re.compile(r" \.(?!\S)")}
# the character class comes first, so that the search skips to it; then that no letter or digit stands before
_DIGITS = re.compile(r"[\dlIO](?<![^\W_].)[\dlIO]{0,3}(?![^\W_]|['’])")
_READ = str.maketrans("lIO", "110")
_NUMBER_BARE = re.compile(r"^(\d{1,4}) (?=[«“¿¡(]*[A-ZÀ-Þ])|(?<=[.!?…]) (\d{1,4})$|(?<=[.!?…]) (\d{1,4})(?= [«“¿¡(]*[A-ZÀ-Þ])")
_HEADER_LINE = re.compile(r"^\s*(\S+(?: +\S+){0,4}?)(?: [—–|-] |[ \t]{2,})(\S.{2,60}?)\s*$")
_SEPARATOR = re.compile(r"(?<=\S)(?: [—–|-] |[ \t]{2,})(?=\S)")
_SEPARATES = (" — ", " – ", " | ", " - ", "  ", "\t")
_DIGIT_OR_OPEN = re.compile(r"[\d(\[]")
_PAGE_INDEX = re.compile(r"_p0*(\d+)$")


def divided_words(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, left part, right part) of the words divided by a hyphen before white space."""
    out = []
    if "-" in text or "‐" in text or "¬" in text:
        for m in _BREAK.finditer(text):
            left = _LAST_WORD.search(text, max(0, m.start() - 60), m.start())
            if left is not None and (not out or left.start() >= out[-1][1]):
                out.append((left.start(), m.end(), left[0], m[1]))
    return out


def without_divided(text: str, divided: list[tuple[int, int, str, str]]) -> str:
    """The text with a blank in place of each divided word."""
    if not divided:
        return text
    cut, at = [], 0
    for a, b, _, _ in divided:
        cut.append(text[at:a])
        at = b
    return " ".join([*cut, text[at:]])


def _separates(text: str) -> bool:
    return any(x in text for x in _SEPARATES)


def _may_mark(text: str) -> bool:
    """Whether a header or a page number may stand in a text; False is sure."""
    return _separates(text) or _DIGIT_OR_OPEN.search(text) is not None or _DIGITS.search(text) is not None


class Headers:
    """Beginnings of running headers (folded, up to five words) and how each goes on; found with a few letters misread."""

    def __init__(self, tails: dict[str, set[str]]):
        self.tails = tails
        self.sizes = sorted({s.count(" ") + 1 for s in tails}, reverse=True)
        self.last_words = {n: re.compile(rf"(?:\S+[ \n]+){{{n - 1}}}\S+$") for n in self.sizes}
        self.grams: dict[str, list[str]] = defaultdict(list)
        for s in sorted(tails):
            for g in {s[i : i + 2] for i in range(len(s) - 1)}:
                self.grams[g].append(s)
        self.known: dict[str, str | None] = {}

    def find(self, text: str) -> str | None:
        """The beginning a text is, or None."""
        s = " ".join(fold(text).split())
        if s in self.tails:
            return s
        if s not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            shared = Counter(x for g in {s[i : i + 2] for i in range(len(s) - 1)} for x in self.grams.get(g, ()))
            limit = 0 if len(s) < 4 else 1 if len(s) < 8 else 2 if len(s) < 12 else 3
            near = [(osa(s, x, limit), x) for x, n in shared.items() if n >= max(1, len(x) - 1 - 3 * limit) and abs(len(x) - len(s)) <= limit]
            self.known[s] = next((x for d, x in sorted(near) if d <= limit), None)
        return self.known[s]

    def line(self, line: str) -> bool:
        m = _HEADER_LINE.match(line)
        return m is not None and len(line.split()) <= 12 and self.find(m[1]) is not None

    def before(self, text: str, end: int) -> tuple[int, str] | None:
        """Where the beginning that ends at ``end`` begins, and which it is."""
        for n in self.sizes:
            m = self.last_words[n].search(text, max(0, end - 20 - 20 * n), end)
            if m is not None and (stem := self.find(m[0])) is not None and stem.count(" ") == n - 1:
                return m.start(), stem
        return None

    def after(self, text: str, start: int, stem: str) -> int:
        """Where a header whose separator ends at ``start`` ends."""
        rest = re.match(r"(?:\S+[ \t]*){1,5}", text[start : start + 200])
        words = rest[0].split(" ") if rest else []
        end = next((k for k in range(len(words), 0, -1) if any(osa(fold(" ".join(words[:k])).strip(), t, 2) <= 2 for t in self.tails[stem])), 0)
        stop = start + len(" ".join(words[:end])) if end else start
        more = re.match(r" [—–-] \S+", text[stop : stop + 200])
        return stop + (more.end() if more else 0)

    def strip(self, text: str) -> tuple[str, bool]:
        """The text without headers, and whether it had any."""
        found = False
        if not self.tails or not _separates(text):
            return text, found
        lines = text.split("\n")
        kept = [line for line in lines if not (8 < len(line) < 90 and _separates(line) and self.line(line))]
        if len(kept) < len(lines) and (len(lines) > 1 or len(text) < 80):
            found, text = True, "\n".join(kept)
        for m in reversed(list(_SEPARATOR.finditer(text))):
            begin = self.before(text, m.start())
            if begin is not None:
                found = True
                text = text[: begin[0]].rstrip(" ") + " " + text[self.after(text, m.end(), begin[1]) :].lstrip(" ")
        return text, found


NO_HEADERS = Headers({})


def _inline_number(text: str, m: re.Match) -> tuple[int, int] | None:
    """Where a page mark in running text begins and ends, given its number."""
    before = _BEFORE_NUMBER.search(text, max(0, m.start() - 24), m.start())
    if before is None:
        return None
    after = _AFTER_NUMBER[before.lastgroup].match(text, m.end())
    return None if after is None else (before.start(), after.end())


def strip_furniture(text: str, page_index: int | None, headers: Headers) -> tuple[str, bool, bool]:
    """The text without running headers and page numbers, and whether it had any of either."""
    number = False
    if not _may_mark(text):
        return text, False, number
    lines = text.split("\n")
    if len(lines) > 1 or len(text) < 80:
        kept = [line for line in lines if not (len(line) < 30 and _may_mark(line) and _NUMBER_LINE.match(line))]
        number, text = len(kept) < len(lines), "\n".join(kept)
    text, header = headers.strip(text)
    for m in reversed(list(_DIGITS.finditer(text))):
        if not m[0].strip("I") and int(m[0].translate(_READ)) != page_index:  # a pronoun or a Roman number
            continue
        place = _inline_number(text, m)
        if place is not None:
            number = True
            text = text[: place[0]] + " " + text[place[1] :]
    if page_index is not None and str(page_index) in text and "\n" not in text.strip():
        m = next((m for m in _NUMBER_BARE.finditer(text) if int(m[1] or m[2] or m[3]) == page_index), None)
        if m is not None:
            number = True
            text = (text[: m.start()] + text[m.end() :]).strip()
    return text, header, number


def count_words(df: DataFrame, text: str) -> DataFrame:
    """(word, n, n_low): how often each word occurs, in lower case, and how often it is written so. Words divided at
    line ends are listed joined and count for nothing."""
    src = spread(df.select(F.col(text).alias("t")).where(F.length("t") > 0))
    whole = src.select(F.explode(F.regexp_extract_all(F.regexp_replace("t", _DIVIDED_SQL, " "), F.lit(_TOKEN_SQL), 0)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counted = whole.select(F.lower("w").alias("word"), "n", F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(0).alias("n_low"))
    parts = src.where(F.col("t").rlike("[-‐¬]")).select(F.explode(F.regexp_extract_all("t", F.lit(_DIVIDED_SQL), 0)).alias("w")) \
        .select(F.lower(F.regexp_replace("w", r"[-‐¬][ \t]*(?:\n\s*|[ \t]+)", "")).alias("word"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_low")).distinct()
    return counted.unionByName(parts).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_low").alias("n_low"))


def _anagram(word):
    """The anagram hash of a word: the sum of a power of each letter's number."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a + F.pow(F.ascii(c) % 1024, F.lit(5)).cast("long"))


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """(text): every text that isn't empty, once, so that copies of a text count for no more than the text."""
    return stage(df.select(F.col(text).alias("text")).where(F.length("text") > 0).distinct(), "texts")


def _beside(texts: DataFrame, text: str, doubtful: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, before, after, n) of the forms and (right, side, beside, n) of the right words of doubtful (word, right): how often
    they stand between or beside which words. At an end of a text that word is ''."""
    forms, rights = doubtful.select("word").distinct(), doubtful.select(F.col("right").alias("word")).distinct()
    small = doubtful.count() <= MAX_BROADCAST
    sent = texts.sparkSession.sparkContext.broadcast(({r.word for r in forms.collect()}, {r.word for r in rights.collect()}) if small else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for b in batches:
            seen: Counter[tuple[str, str | None, str | None]] = Counter()
            for t in b["t"]:
                row = ["", *_TOKEN.findall(without_divided(t, divided_words(t)).lower()), ""]
                for i, w in enumerate(row[1:-1], 1):
                    if known is None or w in known[0]:
                        seen[w, row[i - 1], row[i + 1]] += 1
                    if known is None or w in known[1]:
                        seen[w, row[i - 1], None] += 1
                        seen[w, None, row[i + 1]] += 1
            if seen:
                yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["word", "before", "after", "n"])

    src = spread(texts.select(F.col(text).alias("t")).where(F.length("t") > 0))
    found = src.mapInPandas(run, "word string, before string, after string, n long").groupBy("word", "before", "after").agg(F.sum("n").alias("n"))
    found = stage(found if small else found.join(forms.union(rights).distinct(), "word", "left_semi"), "beside")
    between = found.where("before is not null and after is not null").join(forms, "word", "left_semi")
    one_side = found.where("before is null or after is null").join(rights, "word", "left_semi")
    return between, one_side.select(F.col("word").alias("right"), F.expr("if(after is null, 'before', 'after')").alias("side"), F.coalesce("before", "after").alias("beside"), "n")


def _agreeing(doubtful: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """The rows of doubtful (word, right, n_right) whose form stands where its right word does: AGREED of its occurrences are
    beside a word (for words of up to three letters: between two words) the right word is beside more often than the form,
    or no two places differ from that."""
    between, of_right = _beside(texts, text, doubtful)
    at = doubtful.join(between, "word")
    for side in ("before", "after"):
        form = between.groupBy("word", side).agg(F.sum("n").alias("n_form"))
        right = of_right.where(F.col("side") == side).select("right", F.col("beside").alias(side), F.col("n").alias("n_there"))
        more = doubtful.select("word", "right").join(form, "word").join(right, ["right", side]).where("n_there > n_form").select("word", "right", side, F.lit(True).alias(f"in_{side}"))
        at = at.join(more, ["word", "right", side], "left")
    is_in = [F.coalesce(f"in_{side}", F.lit(False)) for side in ("before", "after")]
    agrees = F.when(F.length("right") > 3, is_in[0] | is_in[1]).otherwise(is_in[0] & is_in[1])
    judged = at.withColumn("agrees", agrees).groupBy("word", "right", "n_right") \
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("agrees"), F.col("n")).otherwise(0)).alias("n_agrees"), F.sum((~F.col("agrees")).cast("int")).alias("elsewhere"))
    return judged.where((F.col("n_agrees") >= AGREED * F.col("n")) | (F.col("elsewhere") < 2)).select("word", "right", "n_right")


def _less(words: DataFrame, word: str, keep: list[str]) -> DataFrame:
    """``keep``, pos, gone, at: each word without a letter or two neighbours, by place; at is the anagram hash of what is left."""
    places = F.expr(f"flatten(transform(sequence(1, length({word})), i -> transform(filter(array(1, 2), k -> i + k - 1 <= length({word})), k -> struct(i as pos, substr({word}, i, k) as gone))))")
    out = words.withColumn("h", _anagram(F.col(word))).select(*keep, "h", F.inline(places))
    return out.select(*keep, "pos", "gone", (F.col("h") - _anagram(F.col("gone"))).alias("at"))


def _lettered(words: DataFrame, names: DataFrame) -> DataFrame:
    named = words.join(names.select("word").distinct(), "word", "left_semi").where("n_low < 0.5 * n").select("word")
    return words.where(F.length("word").between(2, 40)).join(named, "word", "left_anti")


def _right_words(lettered: DataFrame, least: int) -> DataFrame:
    return lettered.where(F.col("word").rlike(r"^[\p{L}·-]+$") & (F.col("n") >= least)).select(F.col("word").alias("right"), F.col("n").alias("n_right"))


def glyph_pairs(lettered: DataFrame, ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """(word, n, right, n_right, seen, misread): rare words and frequent ones that are equal but for one place, where one letter
    or two are printed (seen) and one or two, not both two, are read."""
    rare = _less(lettered.where(F.col("word").rlike(r"\p{L}")), "word", ["word", "n"]).withColumnRenamed("gone", "misread")
    right = _less(_right_words(lettered, least), "right", ["right", "n_right"]).withColumnRenamed("gone", "seen")
    rest = lambda w, g: F.expr(f"substr({w}, pos + length({g}))")
    same = (F.expr("substr(word, 1, pos - 1) = substr(right, 1, pos - 1)")) & (rest("word", "misread") == rest("right", "seen"))
    pairs = rare.join(right, ["at", "pos"]).where((F.col("n_right") >= ratio * F.col("n")) & (F.col("word") != F.col("right")) & same)
    # a letter more or less isn't a letter read as two
    return pairs.where("length(seen) + length(misread) < 4 and not contains(seen, misread) and not contains(misread, seen)").select("word", "n", "right", "n_right", "seen", "misread")


def learn_confusions(pairs: DataFrame, lettered: DataFrame, least: int = LEAST, evidence: int = EVIDENCE, strength: float = STRENGTH) -> DataFrame:
    """(seen, misread): the confusions of the scanner, ranked by the part of the words with what is printed that they run through."""
    sure = pairs.where("n <= 1 or n * 50 <= n_right")
    # what one letter for one explains is no evidence for two letters, and a misread word none for another
    one = sure.where("length(seen) + length(misread) = 2")
    sure = sure.join(one.select(F.col("word").alias("right")).distinct(), "right", "left_anti")
    one = sure.where("length(seen) + length(misread) = 2")
    sure = one.unionByName(sure.where("length(seen) + length(misread) > 2").join(one.select("word"), "word", "left_anti")).groupBy("seen", "misread").agg(F.countDistinct("right").alias("rights")).where(F.col("rights") >= evidence)
    holders = _less(_right_words(lettered, least), "right", ["right"]).select(F.col("gone").alias("seen"), "right").distinct().groupBy("seen").agg(F.count("*").alias("holders"))
    ranked = sure.join(holders, "seen").withColumn("s", F.col("rights") / F.col("holders"))
    top = ranked.agg(F.max_by("s", "rights").alias("top"))
    return ranked.join(F.broadcast(top), F.col("s") >= strength * F.col("top")).select("seen", "misread")


def corrections(words: DataFrame, names: DataFrame, ratio: int = RATIO, least: int = LEAST, share: float = SHARE, texts: DataFrame | None = None,
                text: str = "text", confusions: DataFrame | None = None) -> DataFrame:
    """(word, right, n_right): misread words and what they stand for.

    words: (word, n, n_low); names: (word) of names; confusions: (seen, misread), or they are learned from the words. A form of
    letters alone may be a word itself: beyond ``share`` of its right word's occurrences it is a misreading only if it stands in
    ``texts`` where the right word does; without ``texts`` it is none. All bounds are in proportion, so the same corpus many
    times over has the same misreadings."""
    lettered = stage(_lettered(words, names), "lettered")
    pairs = stage(glyph_pairs(lettered, ratio, least), "glyph-pairs")
    confusions = stage(learn_confusions(pairs, lettered, least) if confusions is None else confusions.select("seen", "misread").distinct(), "confusions")
    known = bounded(confusions)
    once = pairs.join(known, ["seen", "misread"]).select("word", "n", "right", "n_right")
    # words that no single confusion explains, by two
    undone = lambda df, keep: _less(df, "mid", [*keep, "mid"]).withColumnRenamed("gone", "misread").join(known, "misread") \
        .withColumn("mid", F.expr("concat(substr(mid, 1, pos - 1), seen, substr(mid, pos + length(misread)))")).select(*keep, "mid").distinct()
    left = lettered.where(F.col("word").rlike(r"\p{L}")).join(once.select("word").distinct(), "word", "left_anti").select("word", "n", F.col("word").alias("mid"))
    left = left.repartition(left.sparkSession.sparkContext.defaultParallelism, "word")  # few rows, but many grow out of each
    twice = undone(undone(left, ["word", "n"]), ["word", "n"]).withColumnRenamed("mid", "right").join(_right_words(lettered, least), "right") \
        .where((F.col("n_right") >= ratio * F.col("n")) & (F.col("right") != F.col("word"))).select("word", "n", "right", "n_right")
    most = F.col("n_right") * F.when(F.length("right") > 3, share).otherwise(share / 3)
    sure = (F.col("n") <= most) | F.col("word").rlike(r"[^\p{L}·-]")
    # two misread letters are rare: no form that may be a word itself is explained by them, and by no right word that is misread
    found = once.unionByName(twice.where(sure).join(once.select(F.col("word").alias("right")), "right", "left_anti"))
    if texts is None:
        found = found.where(sure)
    else:
        found = stage(found.select("word", "right", "n_right", sure.alias("sure")).distinct(), "candidates")
        doubtful = found.where("not sure").select("word", "right", "n_right")
        found = found.where("sure").select("word", "right", "n_right").unionByName(_agreeing(doubtful, texts, text))
    best = found.groupBy("word").agg(F.min(F.struct((-F.col("n_right")).alias("m"), "right")).alias("b")) \
        .select("word", F.col("b.right").alias("right"), (-F.col("b.m")).alias("n_right"))
    # a frequent misreading stands for what it is a misreading of
    beyond = best.select(F.col("word").alias("right"), F.col("right").alias("right_2"), F.col("n_right").alias("n_2"))
    return best.join(beyond, "right", "left").select("word", F.coalesce("right_2", "right").alias("right"), F.coalesce("n_2", "n_right").alias("n_right"))


def header_stems(df: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(stem, tails): what running headers begin with and how they go on. A header is a line with a separator, without other
    punctuation, most of whose kind stand at the edge of a text, and which comes back: its beginning in three documents or
    more and one of its endings in two, or the whole line on three pages of one document. No share of all lines is asked."""
    split = df.select(F.col(document).alias("d"), F.col(page).alias("p"), F.split(text, "\n").alias("l")).where("d is not null and l is not null")
    lines = split.select("d", "p", F.size("l").alias("of"), "l", F.posexplode("l").alias("i", "line")).where(F.length("line").between(9, 79)) \
        .where(F.col("line").rlike(r"\S(?: [—–|-] |[ \t]{2,})\S") & ~F.col("line").rlike(r"[.,;:!?]"))
    # at the edge, and no part of a sentence: the next line begins one, or the line before ends one
    begins, ends = F.expr(r"not coalesce(get(l, i + 1), '') rlike '^\\s*\\p{Ll}'"), F.expr(r"i > 0 and coalesce(get(l, i - 1), '') rlike '[.!?…:»\"”)]\\s*$'")
    lines = lines.select("d", "p", "line", (F.expr("i < 2") & begins | F.expr("i >= of - 2") & ends).alias("edge"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for d, p, line, edge in zip(b["d"], b["p"], b["line"], b["edge"]):
                m = _HEADER_LINE.match(line)
                if m is not None and m[1][0].isupper():
                    rows.add((d, p, " ".join(fold(m[1]).split()), fold(_SEPARATOR.split(m[2])[0]).strip(), bool(edge)))
            if rows:
                yield pd.DataFrame(sorted(rows, key=str), columns=["d", "p", "stem", "tail", "edge"])

    kind = df.schema[document].dataType.simpleString()
    lines = stage(lines.mapInPandas(run, f"d {kind}, p {df.schema[page].dataType.simpleString()}, stem string, tail string, edge boolean").distinct(), "header-lines")
    tails = lines.groupBy("stem", "tail").agg(F.countDistinct("d").alias("docs"))
    pages = lines.groupBy("stem", "tail", "d").agg(F.countDistinct("p").alias("pages"))
    again = tails.where("docs >= 2").select("stem", "tail", F.lit(False).alias("alone")).unionByName(pages.where("pages >= 3").select("stem", "tail", F.lit(True).alias("alone")))
    stems = lines.groupBy("stem").agg(F.countDistinct("d").alias("docs"), F.avg(F.col("edge").cast("int")).alias("edges"))
    return again.groupBy("stem").agg(F.collect_set("tail").alias("tails"), F.max("alone").alias("alone")).join(stems, "stem") \
        .where("edges >= 0.5 and (docs >= 3 or alone)").select("stem", "tails")


def header_blocks(stems: DataFrame, at_once: int | None = None) -> list[Headers]:
    """The headers of (stem, tails) in blocks of about ``at_once``, each small enough to be sent to all tasks."""
    blocks = max(1, -(-stems.count() // (at_once or HEADERS_AT_ONCE)))
    part = lambda i: stems if blocks == 1 else stems.where(F.pmod(F.xxhash64("stem"), F.lit(blocks)) == i)
    return [Headers({r.stem: set(r.tails) for r in part(i).collect()}) for i in range(blocks)]


def _strip_blocks(src: DataFrame, blocks: list[Headers]) -> DataFrame:
    """``src`` with the headers of all blocks but the first taken out of __text and __header set where there were any."""
    src = src.withColumn("__header", F.lit(False))
    for block in blocks[1:]:
        sent = src.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [sent.value.strip(t) if t else (t, False) for t in b["__text"]]
                yield b.assign(__text=[t for t, _ in got], __header=[h or o for (_, h), o in zip(got, b["__header"])])

        src = src.mapInPandas(run, src.schema)
    return src


def find_defects(df: DataFrame, ids: list[str], text: str, words: DataFrame, fixes: DataFrame, headers: list[Headers], page: str) -> DataFrame:
    """Rows ``ids``, defect, word, alternative: header and page_number (word ''), char (word is the right word, alternative
    the misread one), hyphen (word is the joined word, alternative the hyphenated one)."""
    spark = df.sparkSession
    src = _strip_blocks(spread(df.select(*ids, F.col(page).alias("__page"), F.col(text).alias("__text")).where(F.length("__text") > 0)), headers)
    small = fixes.count() <= MAX_BROADCAST
    sent = spark.sparkContext.broadcast(({r.word: r.right for r in fixes.collect()} if small else None, headers[0]))
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in ids) + ", defect string, word string, alternative string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, headers = sent.value
        for b in batches:
            row, defect, word, other = [], [], [], []

            def add(i, d, w, o=""):
                row.append(i), defect.append(d), word.append(w), other.append(o)

            for i, (p, t, header_before) in enumerate(zip(b["__page"], b["__text"], b["__header"])):
                m = _PAGE_INDEX.search(p or "")
                t, header, number = strip_furniture(t, int(m[1]) if m else None, headers)
                if header or header_before:
                    add(i, "header", "")
                if number:
                    add(i, "page_number", "")
                parted = divided_words(t)
                for _, _, a, c in parted:
                    if a[-1].isdigit() or not c[0].isalpha() or c[0].isupper() and not a.isupper():
                        continue
                    add(i, "hyphen", (a + c).lower(), f"{a}-{c}".lower())
                seen = set(_TOKEN.findall(without_divided(t, parted).lower()))
                if known is not None:
                    for w in seen & known.keys():
                        add(i, "char", known[w], w)
                else:
                    for w in seen:
                        add(i, "char", "", w)
            if row:
                yield b.iloc[row][ids].reset_index(drop=True).assign(defect=defect, word=word, alternative=other)

    raw = stage(src.mapInPandas(run, schema), "defects")
    plain = raw.where("defect in ('header', 'page_number')")
    chars = raw.where("defect = 'char'")
    if not small:
        chars = chars.drop("word").join(fixes.select(F.col("word").alias("alternative"), F.col("right").alias("word")), "alternative") \
            .select(*ids, "defect", "word", "alternative")
    divided = raw.where("defect = 'hyphen'")
    divided = divided.withColumn("left", F.substring_index("alternative", "-", 1)).withColumn("right_part", F.substring_index("alternative", "-", -1))
    forms = divided.select(F.explode(F.array("word", "alternative", "left", "right_part")).alias("w")).distinct()
    counts = stage(words.join(forms, words["word"] == forms["w"], "left_semi").select("word", "n").where("n > 0"), "hyphen-evidence")
    for c in ("word", "alternative", "left", "right_part"):
        divided = divided.join(counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left").fillna(0, [f"n_{c}"])
    # two words that both stand alone, and hardly ever joined, keep their hyphen: it belongs to a name
    apart = F.least("n_left", "n_right_part")
    divided = divided.where((F.col("n_word") >= F.col("n_alternative")) & ((apart < 2) | (F.col("n_word") * 100 > apart)))
    mended = fixes.select("word", "right")
    divided = divided.join(mended, "word", "left").withColumn("kinds", F.when(F.col("right").isNull(), F.array(F.lit("hyphen"))).otherwise(F.array(F.lit("hyphen"), F.lit("char"))))
    # a divided word that is also misread has both defects
    divided = divided.select(*ids, F.explode("kinds").alias("defect"), F.coalesce("right", "word").alias("word"), F.col("word").alias("joined"), "alternative")
    divided = divided.select(*ids, "defect", "word", F.when(F.col("defect") == "char", F.col("joined")).otherwise(F.col("alternative")).alias("alternative"))
    return plain.unionByName(chars).unionByName(divided)


def repair(df: DataFrame, ids: list[str], text: str, defects: DataFrame, headers: list[Headers], page: str) -> DataFrame:
    """Rows ``ids``, text_repaired: continuous paragraphs. Lines are joined, paragraphs stay apart where a line is empty."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(headers[0])
    what = F.struct("defect", "word", "alternative")
    mine = defects.where("defect in ('char', 'hyphen')").groupBy(*ids).agg(F.collect_set(what).alias("__fixes"))
    src = df.select(*ids, F.col(page).alias("__page"), F.col(text).alias("__text")).dropDuplicates()
    src = _strip_blocks(src, headers).join(mine, ids, "left")
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in ids) + ", text_repaired string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, t, fixes in zip(b["__page"], b["__text"], b["__fixes"]):
                if not t:
                    out.append(t)
                    continue
                m = _PAGE_INDEX.search(p or "")
                t, _, _ = strip_furniture(t, int(m[1]) if m else None, sent.value)
                fixes = list(fixes) if fixes is not None else []
                chars = {f["alternative"]: f["word"] for f in fixes if f["defect"] == "char"}
                whole = {f["alternative"] for f in fixes if f["defect"] == "hyphen"}
                for a, c, left, right in reversed(divided_words(t)):
                    t = t[:a] + left + ("" if f"{left}-{right}".lower() in whole else "-") + right + t[c:]
                if chars:
                    t = _TOKEN.sub(lambda m, c=chars: _cased(m[0], c[m[0].lower()]) if m[0].lower() in c else m[0], t)
                out.append("\n\n".join(" ".join(x.split()) for x in re.split(r"\n[ \t]*\n", t) if x.strip()))
            yield b[ids].assign(text_repaired=out)

    return src.mapInPandas(run, schema)


def _cased(like: str, word: str) -> str:
    if len(like) > 1 and like.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word
