"""Tokenisers, and functions over token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwright.functions.step import Step
from linkwright.functions.text import squeeze
from linkwright.functions.translit import transliterate

__all__ = [
    "word_tokens", "generate_ngrams", "numeric_tokens", "filter_stopwords", "drop_numeric_tokens", "drop_short_tokens", "token_shapes", "extract_initials",
]


def word_tokens(min_nchar: int = 0) -> Step:
    """Words between blanks, of ``min_nchar`` characters at least. Null gives null: no tokens."""
    least = max(min_nchar, 1)
    return Step("word_tokens", lambda c: F.filter(F.split(c, r"\s+"), lambda t: F.length(t) >= least), "text", "tokens", (("min_nchar", min_nchar),))


def generate_ngrams(n: int) -> Step:
    """Every run of ``n`` characters of the whole text, blanks included; none if it is shorter."""
    if n < 1:
        raise ValueError("n must be at least 1")

    def fn(c: Column) -> Column:
        last = F.length(c) - n + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
        return F.when(last >= 1, grams).when(c.isNotNull(), F.array().cast("array<string>"))

    return Step("generate_ngrams", fn, "text", "tokens", (("n", n),))


def numeric_tokens(keep_letters: bool = True, destructive: bool = False) -> Step:
    """Numbers, and numbers with one letter behind; a text that is only a range (ends up to 999,999,999) gives all of it."""

    def fn(c: Column) -> Column:
        t = squeeze(F.regexp_replace(F.upper(transliterate(c, "Any-Latin; Latin-ASCII")), "[^0-9]" if destructive else "[^0-9A-Z]", " "))
        low, high = (F.try_to_number(F.regexp_extract(t, r"^(\d{1,9}) (\d{1,9})$", i), F.lit("999999999")).cast("int") for i in (1, 2))
        number = r"^[0-9]+$" if destructive or not keep_letters else r"^[0-9]+[A-Z]?$"
        single = F.array_distinct(F.filter(F.split(t, " "), lambda x: x.rlike(number)))
        is_range = t.rlike(r"^\d{1,9} \d{1,9}$") & (low <= high)
        whole = F.transform(F.sequence(F.coalesce(F.when(is_range, low), F.lit(0)), F.coalesce(F.when(is_range, high), F.lit(0))), lambda i: i.cast("string"))
        return F.when(F.coalesce(is_range, F.lit(False)), whole).otherwise(single)

    return Step("numeric_tokens", fn, "text", "tokens", (("keep_letters", keep_letters), ("destructive", destructive)))


def filter_stopwords(stopwords: list[str] | tuple[str, ...]) -> Step:
    """Tokens that are no stopword, whatever the case."""
    upper = sorted({s.upper() for s in stopwords})
    keep = (lambda t: ~F.upper(t).isin(upper)) if upper else (lambda t: F.lit(True))
    return Step("filter_stopwords", lambda c: F.filter(c, keep), "tokens", "tokens", (("n", len(upper)),))


def drop_numeric_tokens(keep_letters: bool = True) -> Step:
    """Without pure numbers; without ``keep_letters`` also without any token that has a digit."""
    regex = r"^[0-9]+$" if keep_letters else r"[0-9]"
    return Step("drop_numeric_tokens", lambda c: F.filter(c, lambda t: ~t.rlike(regex)), "tokens", "tokens", (("keep_letters", keep_letters),))


def drop_short_tokens(min_nchar: int = 2) -> Step:
    return Step("drop_short_tokens", lambda c: F.filter(c, lambda t: F.length(t) >= min_nchar), "tokens", "tokens", (("min_nchar", min_nchar),))


def token_shapes() -> Step:
    """A for capitals, N for digits, X for anything else."""

    def shape(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[^A-Z0-9]", "x"), "[A-Z]", "A"), "[0-9]", "N").alias("s")

    return Step("token_shapes", lambda c: F.transform(c, lambda t: F.translate(shape(t), "x", "X")), "tokens", "tokens")


def extract_initials() -> Step:
    return Step("extract_initials", lambda c: F.transform(c, lambda t: F.substring(t, 1, 1)), "tokens", "tokens")
