"""Text-to-text preparers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwright.functions.step import Step
from linkwright.functions.translit import transliterate

__all__ = ["normalize_text", "strip_vowels", "use_dictionary", "squeeze"]


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(transliteration: str = "De-ASCII") -> Step:
    """Upper case, ASCII letters and digits only, single blanks. Null stays null."""

    def fn(c: Column) -> Column:
        t = F.regexp_replace(transliterate(F.upper(c), transliteration), "[^A-Za-z0-9 ]", "")
        return squeeze(t)

    return Step("normalize_text", fn, args=(("transliteration", transliteration),))


def strip_vowels() -> Step:
    """Upper-case ASCII without A, E, I, O, U."""
    return Step("strip_vowels", lambda c: squeeze(F.regexp_replace(F.upper(transliterate(c)), "[AEIOU]", "")))


def use_dictionary(dictionary: dict[str, str | list[str]]) -> Step:
    """The groups of a token by a (small) dictionary; what it does not have vanishes. Texts count as one token."""
    pairs = {k: [v] if isinstance(v, str) else list(v) for k, v in dictionary.items()}
    entries = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*[F.lit(g) for g in v]))]) if pairs else None

    def look(t: Column) -> Column:
        none = F.array().cast("array<string>")
        return none if entries is None else F.coalesce(F.try_element_at(entries, t), none)

    return Step("use_dictionary", lambda c: F.flatten(F.transform(c, look)), "tokens", "tokens", (("size", len(pairs)),))
