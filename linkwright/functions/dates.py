"""Dates from text, at whatever grain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwright.functions.step import Step

__all__ = ["parse_date", "normalize_date", "approximate_date", "date_tokens"]

ORDERS = ("ymd", "dmy", "mdy")
_PARTS = {"y": r"(\d{4})", "m": r"(\d{1,2})", "d": r"(\d{1,2})"}
_COMPACT = {"ymd": r"^(\d{4})(\d\d)(\d\d)$", "dmy": r"^(\d\d)(\d\d)(\d{4})$", "mdy": r"^(\d\d)(\d\d)(\d{4})$"}


def parse_date(c: Column, format: str | None = None, orders: tuple[str, ...] = ORDERS) -> Column:
    """A date from a date, a timestamp's or a text's year, month and day in the first order that gives one; else null.

    ``format`` is a Java pattern and then the only one tried.
    """
    text = F.trim(c.cast("string"))
    if format:
        return F.try_to_date(text, format)
    found = []
    for order in orders:
        if sorted(order) != ["d", "m", "y"]:
            raise ValueError(f"order {order!r} is not one of y, m and d")
        for regex in (r"^" + r"[^0-9]+".join(_PARTS[p] for p in order) + r"(?:[ T][0-9:.]+)?$", _COMPACT.get(order)):
            if regex:
                y, m, d = (F.lpad(F.regexp_extract(text, regex, order.index(p) + 1), 4 if p == "y" else 2, "0") for p in "ymd")
                found.append(F.when(text.rlike(regex), F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")))
    return F.coalesce(*found)


def normalize_date(format: str | None = None, orders: tuple[str, ...] = ORDERS) -> Step:
    """ISO text; null where no date is found."""
    return Step("normalize_date", lambda c: F.date_format(parse_date(c, format, orders), "yyyy-MM-dd"), args=(("format", format), ("orders", orders)))


def approximate_date(unit: str = "month", format: str | None = None, orders: tuple[str, ...] = ORDERS) -> Step:
    """The first day of the date's month, quarter, half, year or decade, as ISO text."""
    if unit not in ("month", "quarter", "half", "year", "decade"):
        raise ValueError(f"unknown unit {unit!r}")

    def fn(c: Column) -> Column:
        d = parse_date(c, format, orders)
        if unit == "half":
            out = F.make_date(F.year(d), F.when(F.month(d) <= 6, 1).otherwise(7), F.lit(1))
        elif unit == "decade":
            out = F.make_date((F.floor(F.year(d) / 10) * 10).cast("int"), F.lit(1), F.lit(1))
        else:
            out = F.trunc(d, unit)
        return F.date_format(out, "yyyy-MM-dd")

    return Step("approximate_date", fn, args=(("unit", unit),))


def date_tokens(components: tuple[str, ...] = ("year", "month", "day"), format: str | None = None, orders: tuple[str, ...] = ORDERS) -> Step:
    """Year, month and day as tokens, in the order asked for; none without a date."""
    forms = {"year": "yyyy", "month": "MM", "day": "dd"}
    if bad := [x for x in components if x not in forms]:
        raise ValueError(f"unknown components {bad}")

    def fn(c: Column) -> Column:
        d = parse_date(c, format, orders)
        return F.when(d.isNull(), F.array().cast("array<string>")).otherwise(F.array(*[F.date_format(d, forms[x]) for x in components]))

    return Step("date_tokens", fn, "text", "tokens", (("components", components),))
