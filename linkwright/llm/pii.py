"""Personal data replaced by format-preserving keyed pseudonyms, in DataFrame functions only."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["KEY_CONF", "PATTERNS", "pseudonymise", "pseudonymise_documents", "feistel_text", "feistel_octets", "feistel_date"]

#: Session setting that holds the key of the permutations.
KEY_CONF = "spark.linkwright.pii.key"

ROUNDS = 8
#: 400 Gregorian years have 146,097 = 189 * 773 days: a date is permuted within its own cycle.
CYCLE, HIGH, LOW = 146_097, 189, 773

#: Country calling codes by their first digits: 1 and 7, those of two digits, all others of three (ITU E.164).
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
#: A social security number that can be issued: area, group and serial are not zero, the area is not 666 or from 900 on.
_SSN_VALID = r"^(?!000|666|9)\d{3}(?!00)\d\d(?!0000)\d{4}$"
#: Steps of a cycle walk; of the values walked, a share of 0.12 is left after each.
WALK = 24

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is looked for, most telling form first. Numbers and dates are validated after the match.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d.-])\d{4}-\d\d-\d\d(?![\d-])|(?<![\d./])\d\d([./])\d\d\1\d{4}(?![\d/])",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])",
    "secret": r"(?<![A-Za-z0-9])(?:(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,64}|(?=[0-9A-F]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d)",
}


def _round_hash(key: str, kind: str, r: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), half.cast("string")).cast("binary"), 256)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(digest: Column, i: Column) -> Column:
    """The i-th number below 65,536 of a digest; 16 of them, then again."""
    return F.conv(F.substr(digest, F.lit(1) + (i % 16) * 4, F.lit(4)), 16, 10).cast("int")


def _rounds(a: Column, b: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
    """An even number of Feistel rounds: (a, b) becomes (b, a + F(b)); each is undone by subtracting."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(a.alias("a"), b.alias("b")),
        lambda acc, r: F.struct(acc["b"].alias("a"), step(acc["a"], acc["b"], r).alias("b")),
    )


def _shift(c: Column, k: Column, hexadecimal: bool) -> Column:
    """``c`` moved by ``k`` within its own kind of character; anything else stays."""
    code = F.ascii(c)
    move = lambda first, size: F.chr(F.pmod(code - first + k, F.lit(size)) + first)
    out = F.when(c.between("0", "9"), move(48, 10))
    if hexadecimal:
        digit = F.instr(F.lit("0123456789abcdef"), F.lower(c)) - 1
        moved = F.substr(F.lit("0123456789abcdef"), F.pmod(digit + k, F.lit(16)) + 1, F.lit(1))
        return moved
    out = out.when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26))
    return out.when((code >= 224) & (code <= 255), move(224, 32)).otherwise(c)


def feistel_text(value: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """Digits become digits and letters letters, each in its place; a permutation of all texts of that form."""

    def step(a: Column, b: Column, r: Column) -> Column:
        chars = F.filter(F.split(a, ""), lambda c: c != "")
        return _bind(
            _round_hash(key, kind, r, b),
            lambda h: F.array_join(F.transform(chars, lambda c, i: _shift(c, _draw(h, i), hexadecimal)), ""),
        )

    half = F.ceil(F.length(value) / 2).cast("int")
    done = _rounds(F.substr(value, F.lit(1), half), F.substr(value, half + 1), step)
    return _bind(done, lambda s: F.concat(s["a"], s["b"]))


def feistel_octets(value: Column, key: str) -> Column:
    """A dotted quad becomes another."""

    def step(a: Column, b: Column, r: Column) -> Column:
        return _bind(
            _round_hash(key, "ip", r, b),
            lambda h: F.array_join(F.transform(F.split(a, r"\."), lambda o, i: F.pmod(o.cast("int") + _draw(h, i), F.lit(256)).cast("string")), "."),
        )

    done = _rounds(F.substring_index(value, ".", 2), F.substring_index(value, ".", -2), step)
    return _bind(done, lambda s: F.concat(s["a"], F.lit("."), s["b"]))


def feistel_date(day: Column, key: str) -> Column:
    """A date becomes another of the same 400-year cycle."""
    days = F.date_diff(day, F.lit("2000-01-01").cast("date"))
    inside = F.pmod(days, F.lit(CYCLE))

    def step(a: Column, b: Column, r: Column) -> Column:
        draw = F.conv(F.substring(_round_hash(key, "date", r, b), 1, 12), 16, 10).cast("long")
        return F.pmod(a + draw, F.when(r % 2 == 0, F.lit(HIGH)).otherwise(F.lit(LOW)).cast("long"))

    done = _rounds(F.floor(inside / LOW).cast("long"), F.pmod(inside, F.lit(LOW)).cast("long"), step)
    moved = _bind(done, lambda s: s["a"] * LOW + s["b"])
    return F.date_add(F.lit("2000-01-01").cast("date"), (days - inside + moved).cast("int"))


def _luhn_sum(number: Column, from_check: bool) -> Column:
    """Sum of the digits from the right, every other doubled; ``from_check``: the last is the check digit."""
    digits = F.reverse(F.filter(F.split(number, ""), lambda c: c.between("0", "9")))
    doubled = 1 if from_check else 0
    worth = F.transform(digits, lambda c, i: F.when(i % 2 == doubled, F.pmod(c.cast("int") * 2, F.lit(9)) + F.when(c == "9", 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda acc, d: acc + d)


def _kind_of(m: Column) -> Column:
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    out = F.when(F.instr(m, "@") > 0, "email")
    for kind in ("phone", "ip", "date", "ssn", "secret"):
        out = out.when(m.rlike(whole[kind]), kind)
    return out.otherwise("card")


def _dates(m: Column, key: str) -> Column:
    """A valid date from 1600 on becomes another of the same form; slashes are read month first, then day first."""

    def moved(form: str) -> Column:
        day = F.try_to_date(m, form)
        return F.when(day >= F.lit("1600-01-01").cast("date"), F.date_format(feistel_date(day, key), form))

    return (
        F.when(m.rlike(r"^\d{4}-\d\d-\d\d$"), F.coalesce(moved("yyyy-MM-dd"), m))
        .when(m.rlike(r"^\d\d\."), F.coalesce(moved("dd.MM.yyyy"), m))
        .when(m.rlike(r"^\d\d/"), F.coalesce(moved("MM/dd/yyyy"), moved("dd/MM/yyyy"), m))
        .otherwise(m)
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _woven(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits``, one after the other."""
    between = F.split(form, "[0-9]", -1)
    each = F.concat(F.filter(F.split(digits, ""), lambda c: c != ""), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, each, lambda s, d: F.concat(s, d)), "")


def _phone(m: Column, key: str) -> Column:
    """The digits behind the country code permuted in one written form, whatever the form found, so the forms stay linked."""

    def permuted(d: Column) -> Column:
        ten = F.concat(F.lit(" ("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))
        return _digits(feistel_text(F.when(F.length(d) == 10, ten).otherwise(d), key, "phone"))

    country = F.regexp_extract(m, _COUNTRY, 0)
    rest = F.substr(m, F.length(country) + 1)
    return F.concat(country, _woven(rest, _bind(_digits(rest), permuted)))


def _ssn(m: Column, key: str) -> Column:
    """Permuted, again and again until it is one that can be issued (cycle walking)."""
    once = lambda d: feistel_text(d, key, "ssn")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(_digits(m)), lambda d, _: F.when(d.rlike(_SSN_VALID), d).otherwise(once(d)))
    return _woven(m, walked)


def _card(m: Column, key: str) -> Column:
    def permuted(d: Column) -> Column:
        body = feistel_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        return _bind(body, lambda p: F.concat(p, F.pmod(-_luhn_sum(p, False), F.lit(10)).cast("string")))

    return _woven(m, _bind(_digits(m), permuted))


def pseudonymise(m: Column, kind: Column, key: str) -> Column:
    """What takes the place of one match; what fails its validation is returned as it is."""
    at = F.instr(m, "@")
    return (
        F.when(kind == "email", F.concat(feistel_text(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at)))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "ip", feistel_octets(m, key))
        .when(kind == "date", _dates(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "secret", F.when(m == F.lower(m), feistel_text(m, key, "secret", True)).otherwise(F.upper(feistel_text(F.lower(m), key, "secret", True))))
        .when(_luhn_sum(m, True) % 10 == 0, _card(m, key))
        .otherwise(m)
    )


def _key_of(docs: DataFrame) -> str:
    """The session's key; without one a public stand-in, which hides nothing from who has this file, and a warning."""
    key = docs.sparkSession.conf.get(KEY_CONF, "")
    if not key:
        warnings.warn(f"{KEY_CONF} is not set: personal data is replaced under a public key and can be restored", stacklevel=3)
    return key or "linkwright"


def pseudonymise_documents(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; a last column ``pii`` lists what was, as ``kind:count``.

    Emails keep their domain, phones their country code, cards their length, grouping and a
    valid check digit, social security numbers stay such as can be issued, dates keep their
    form; every digit and letter stays one. The replacement is a keyed permutation: of the
    digits of numbers, whatever separates them, so a number stays linked across its written
    forms; of the day of dates; of the characters of names of mailboxes, in which case tells.
    ``key`` is the session's ``spark.linkwright.pii.key`` unless given. No shuffle, no Python. A card must pass the Luhn test, a
    date exist (from 1600), octets be below 256; what fails stays. A null text stays null
    with ``pii`` null; other columns, whatever their names, stay (one named ``pii`` is replaced).
    """
    key = _key_of(docs) if key is None else key
    regex = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([./])", r"(?<sep>[./])").replace(r"\1", r"\k<sep>")
    t = F.col(text)
    matches = F.regexp_extract_all(t, F.lit(regex), F.lit(0))
    told = F.transform(matches, lambda m: F.struct(m.alias("m"), _kind_of(m).alias("k")))
    new = F.transform(told, lambda x: F.struct(x["k"].alias("k"), x["m"].alias("old"), pseudonymise(x["m"], x["k"], key).alias("new")))
    hit = t.rlike("[0-9@]")
    out = docs.withColumn("pii", F.when(hit, new))
    pieces = F.split(t, regex, -1)
    woven = F.array_join(F.zip_with(pieces, F.concat(F.transform("pii", lambda x: x["new"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = out.withColumn(text, F.when(F.size("pii") > 0, woven).otherwise(t))
    changed = F.filter("pii", lambda x: x["old"] != x["new"])
    of_kind = lambda k: F.size(F.filter(changed, lambda x: x["k"] == k))
    kinds = [F.struct(F.lit(k).alias("k"), of_kind(k).alias("n")) for k in PATTERNS]
    listed = F.array_join(F.transform(F.filter(F.array(*kinds), lambda s: s["n"] > 0), lambda s: F.concat_ws(":", s["k"], s["n"].cast("string"))), ",")
    return out.withColumn("pii", F.when(t.isNotNull(), F.when(F.size("pii") > 0, listed).otherwise("")))
