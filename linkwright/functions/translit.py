"""Transliteration to ASCII as Catalyst expressions: one ``translate`` and a few ``replace``."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a canonical decomposition: fixed values of the Latin-ASCII rules.
_LATIN = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D",
    "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "n", "Ŋ": "N", "ŧ": "t", "Ŧ": "T", "ĸ": "q", "ſ": "s",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...",
}
# Any-Latin for Greek and Cyrillic lower-case letters: fixed values.
_GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψως", ["a", "v", "g", "d", "e", "z", "e", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "t", "y", "ph", "ch", "ps", "o", "s"], strict=True))
_CYRILLIC = dict(
    zip(
        "абвгдежзийклмнопрстуфхцчшщъыьэюя",
        ["a", "b", "v", "g", "d", "e", "z", "z", "i", "j", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "c", "s", "s", "", "y", "", "e", "u", "a"],
        strict=True,
    )
)
# What De-ASCII has in place of the plain letter.
_GERMAN = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "AE", "Ö": "OE", "Ü": "UE"}

RULES = ("De-ASCII", "Latin-ASCII", "Any-Latin; Latin-ASCII")


@functools.cache
def table(rule: str) -> tuple[dict[str, str], dict[str, str]]:
    """``(one letter to at most one, one to several)`` of the Latin, Greek and Cyrillic blocks."""
    if rule not in RULES:
        raise ValueError(f"unknown transliteration {rule!r}; one of {', '.join(RULES)}")
    out = dict(_LATIN)
    for lower in (_GREEK, _CYRILLIC):
        out |= lower | {k.upper(): v.upper() for k, v in lower.items() if len(k.upper()) == 1}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x400, 0x460), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        if c in out:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base and base != c:
            base = "".join(out.get(x, x) for x in base)
            if base.isascii():
                out[c] = base
    if rule == "De-ASCII":
        out |= _GERMAN
    return {k: v for k, v in out.items() if len(v) <= 1}, {k: v for k, v in out.items() if len(v) > 1}


def transliterate(column: Column, rule: str = "Latin-ASCII") -> Column:
    single, several = table(rule)
    # letters that only go away come last in translate's list
    ordered = sorted(single, key=lambda k: (single[k] == "", k))
    out = F.translate(column, "".join(ordered), "".join(single[k] for k in ordered))
    if rule == "De-ASCII":
        out = F.normalize(out, F.lit("NFC")) if hasattr(F, "normalize") else out
    for k, v in several.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, "[̀-ͯ]", "")
