"""Column functions on text: tokens, identifiers, dates, file names, labels. SURVEY ids are given in brackets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The archive's epochs (first year, first year after).
EPOCHS = [("monarchy", 1924, 1931), ("republic", 1931, 1936), ("war", 1936, 1939), ("francoist", 1939, 1954)]
# Month names of titles.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
_DOC = r"a(\d{4})m(\d{1,2})(?:d(\d{1,2}))?"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, Unicode-aware [F14]; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _group(c: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, _DOC, i), F.lit("")).try_cast("int")


def document_year(c: Column) -> Column:
    return _group(c, 1)


def document_month(c: Column) -> Column:
    return _group(c, 2)


def document_day(c: Column) -> Column:
    return _group(c, 3)


def epoch(year: Column) -> Column:
    """Epoch of a year, ``unknown`` outside all of them [D8]."""
    out = F.when(F.lit(False), F.lit(""))
    for name, first, after in EPOCHS:
        out = out.when((year >= first) & (year < after), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def document_title(c: Column, station: str = "Radio Costaclara") -> Column:
    """``{station} - {month in Spanish} {year}``; a month that is none stays a number [F6]; null without a date."""
    month = document_month(c)
    name = F.when(month.between(1, 12), F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(F.least(month, F.lit(12)), F.lit(1)))).otherwise(month.cast("string"))
    return F.concat(F.lit(f"{station} - "), name, F.lit(" "), document_year(c).cast("string"))


def document_date(c: Column) -> Column:
    """``YYYY-MM-DD`` with day 01 where it is missing; no check of the calendar [F7]."""
    return F.concat_ws("-", F.lpad(document_year(c).cast("string"), 4, "0"), F.lpad(document_month(c).cast("string"), 2, "0"),
                       F.lpad(F.coalesce(document_day(c), F.lit(1)).cast("string"), 2, "0"))


def sanitize_filename(c: Column) -> Column:
    """Characters that file systems refuse become underscores [F4]."""
    return F.regexp_replace(c, r'[<>:"/\\|?*]', "_")


def url_file(c: Column) -> Column:
    """The last segment of a URL, percent-decoded (a plus stays one) and made safe [F4]."""
    return sanitize_filename(F.url_decode(F.replace(F.element_at(F.split(c, "/"), -1), F.lit("+"), F.lit("%2B"))))


def resolve_url(base: str, c: Column) -> Column:
    """Absolute URLs stay; others are put under ``base`` [F3]."""
    return F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(c, F.lit("/"))))


def page_stem(c: Column) -> Column:
    """File name without extension, tile suffix and role suffix [F10]."""
    stem = F.regexp_replace(c, r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"(?i)_t\d+.*$", ""), r"(?i)_(input|label|mask)$", "")


def page_index(c: Column) -> Column:
    """Number after ``_p`` at the end of a page id [F12]."""
    return F.nullif(F.regexp_extract(c, r"_p(\d+)$", 1), F.lit("")).try_cast("int")


def language_codes(c: Column) -> Column:
    """All three-letter runs of a lower-cased label, else the label; sorted, distinct [F2]."""
    low = F.lower(F.trim(c))
    found = F.regexp_extract_all(low, F.lit("[a-z]{3}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.when(F.size(found) > 0, found).when(low != "", F.array(low)).otherwise(F.array().cast("array<string>"))))


def hash_share(seed: int, c: Column) -> Column:
    """A stable share in [0, 1) of ``seed:text``: the MD5 number modulo 10000 over 10000 [F24], in four limbs."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))
    acc = F.lit(0).cast("long")
    for i in range(4):
        acc = (acc * 7296 + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) % 10000
    return acc / F.lit(10000.0)


def split_of(share: Column, train: float = 0.7, val: float = 0.15) -> Column:
    """test below its ratio, then val, then train [I22]."""
    test = 1 - train - val
    return F.when(share < round(test, 10), "test").when(share < round(test + val, 10), "val").otherwise("train")


def strip_prompt_leak(text: Column, instruction: str, window: int = 4) -> Column:
    """Lines without any ``window`` consecutive words of the instruction, trimmed [F18]."""
    words = instruction.lower().split()
    phrases = [" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]
    leaks = lambda line: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(line), p))
    lines = F.split(text, "\n")
    return F.trim(F.array_join(F.filter(lines, lambda x: ~leaks(x)) if phrases else lines, "\n"))


def json_object(text: Column) -> Column:
    """The outermost brace pair of a lenient answer, without trailing commas [F20]."""
    body = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def normalized(t: str | None) -> str | None:
    if t is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isalnum() else " " for c in bare).split())


def normalize_text(c) -> Column:
    """NFKD without combining marks, lower case, other than letters and digits to single blanks [F15]."""
    return F.pandas_udf(lambda s: s.map(normalized), "string")(c)


def _edits(a: list, b: list) -> int:
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def word_errors(truth: str | None, guess: str | None) -> float:
    a, b = (truth or "").split(), (guess or "").split()
    return _edits(a, b) / len(a) if a else float(bool(b))


def word_error_rate(truth, guess) -> Column:
    """Edits between the words of two texts over the number of true words; 0 for two empty texts [F17]."""
    rate = F.pandas_udf(lambda t, g: pd.Series([word_errors(x, y) for x, y in zip(t, g)], dtype="float64"), "double")
    return rate(truth, guess)


def char_error_rate(truth: Column, guess: Column) -> Column:
    """Levenshtein distance in characters over the length of the truth [F16]."""
    d = F.levenshtein(F.coalesce(truth, F.lit("")), F.coalesce(guess, F.lit("")))
    return F.when(F.length(truth) > 0, d / F.length(truth)).otherwise(F.when(F.length(guess) > 0, 1.0).otherwise(0.0))


def annotation_name(file_name: Column) -> Column:
    """The name of an annotated image without its extension and the suffix that the annotation tool added [F11]."""
    return F.regexp_replace(F.regexp_replace(file_name, r"(?<=.)\.[^./]*$", ""), r"_png\.rf\..+$", "")


def archive_entry(source: Column, prefix: str = "data/raw/") -> Column:
    """The name of a source in an archive: what follows the prefix, else its last two parts; always with forward slashes [F25]."""
    path = F.regexp_replace(F.replace(source, F.lit("\\"), F.lit("/")), r"/\.?(?=/)", "")
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(F.substring_index(path, "/", -2))
