"""How a text looks: invisible characters, special blanks and hyphens, wide forms, ligatures, look-alike letters."""

from __future__ import annotations

import re
import unicodedata

# Letters of other alphabets and the Latin letters they look like.
CYRILLIC_AS_LATIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ү": "y",
}
GREEK_AS_LATIN = {
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "γ": "y",
}
OTHER_AS_LATIN = {"ı": "i", "ɑ": "a", "ɡ": "g", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g"}
# Ligatures that look like their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŀ": "l·", "Ŀ": "L·", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǌ": "nj"}
# Hyphens that look like the plain one.
HYPHENS = "‐‑﹣－⁃"

LOOKALIKE = {**CYRILLIC_AS_LATIN, **GREEK_AS_LATIN, **OTHER_AS_LATIN}

_KEPT_CONTROLS = {"\t", "\n"}


def _plain_table() -> dict[int, str | None]:
    """Everything but look-alike letters: what is invisible goes, what only differs in width or kind of blank is made plain."""
    table: dict[int, str | None] = {}
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs":
            table[cp] = " "
        elif kind == "Cf" or kind == "Cc" and c not in _KEPT_CONTROLS or 0xFE00 <= cp < 0xFE10 or cp == 0x34F or 0xE0100 <= cp < 0xE01F0:
            table[cp] = None
        elif cp > 0x2000 and unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            table[cp] = unicodedata.normalize("NFKC", c)
    table |= {ord(k): v for k, v in LIGATURES.items()} | {ord(h): "-" for h in HYPHENS}
    table[0x0D], table[0x2028], table[0x2029] = None, "\n", "\n"
    table.pop(0x20)
    return table


_tables: dict[str, dict[int, str | None]] = {}
_SPECIAL = re.compile("[^\t\n -~¡-¬®-ÿŒœ–—‘’“”…]")
_FOREIGN = re.compile("[" + "".join(LOOKALIKE) + "Ͱ-ϿЀ-ԯ԰-֏]")


def plain(text: str) -> str:
    """``text`` with invisible characters removed, special blanks, hyphens, wide forms and ligatures made plain and
    accents composed. Look-alike letters stay."""
    if not _SPECIAL.search(text):
        return text
    if "plain" not in _tables:
        _tables["plain"] = _plain_table()
    return unicodedata.normalize("NFC", text.translate(_tables["plain"]))


def has_foreign(text: str) -> bool:
    """Whether a letter of another alphabet than Latin, or one that looks Latin and isn't, occurs."""
    return _FOREIGN.search(text) is not None


def as_latin(text: str) -> str:
    """``text`` with every look-alike letter replaced, under whatever accents it carries."""
    if "latin" not in _tables:
        _tables["latin"] = {ord(k): v for k, v in LOOKALIKE.items()}
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_tables["latin"]))


def as_script(text: str, script: str) -> str:
    """``text`` with Latin letters replaced by the look-alikes of ``script``, where there are some."""
    if script not in _tables:
        source = CYRILLIC_AS_LATIN if script == "CYRILLIC" else GREEK_AS_LATIN
        _tables[script] = {ord(v): k for k, v in reversed(source.items())}
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_tables[script]))


def script(letter: str) -> str:
    """LATIN, CYRILLIC, GREEK, another script's name, or '' for what is no letter."""
    if not letter.isalpha():
        return ""
    if letter < "Ͱ" and letter not in OTHER_AS_LATIN:
        return "LATIN"
    return unicodedata.name(letter, "?").split(" ")[0]


def seen_as(text: str) -> str:
    """The text as a reader sees it, look-alikes included: two texts that look the same give the same."""
    text = plain(text)
    return as_latin(text) if has_foreign(text) else text
