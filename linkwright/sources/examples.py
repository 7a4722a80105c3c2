"""Seeded example tables: persons with planted duplicates and distorted copies."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

__all__ = ["person_tables", "workshop_tables"]

_FIRST = ["Anna", "Bernd", "Clara", "Deniz", "Emil", "Frieda", "Georg", "Hanna", "Ivo", "Jana", "Karl", "Lena", "Murat", "Nora", "Otto", "Petra", "Rolf", "Sofia", "Timo", "Ute", "Jürgen", "Käthe"]
_LAST = ["Müller", "Schmidt", "Meier", "Fischer", "Weber", "Wagner", "Becker", "Hoffmann", "Koch", "Yilmaz", "Kowalski", "Richter", "Klein", "Wolf", "Neumann", "Schwarz", "Krüger", "Braun"]
_STREET = ["Haupt", "Schul", "Garten", "Berg", "Dorf", "Kirch", "Wald", "Linden", "Bahnhof", "Mühlen"]
_TOWN = ["Altdorf", "Bergheim", "Neustadt", "Rheinfeld", "Seehausen", "Waldau"]


def _typo(r: random.Random, s: str) -> str:
    if len(s) < 4:
        return s
    i = r.randrange(1, len(s) - 1)
    return {0: s[:i] + s[i + 1 :], 1: s[:i] + s[i] + s[i:], 2: s[:i] + s[i + 1] + s[i] + s[i + 2 :]}[r.randrange(3)]


def person_tables(spark: SparkSession, n: int = 3000, duplicates: int = 300, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A base table whose last ``duplicates`` rows are noisy copies, and a target of distorted copies and newcomers."""
    r = random.Random(seed)
    columns = "Vorname string, Nachname string, Strasse string, Hausnummer string, Ort string, Kreis string"

    def person():
        town = r.choice(_TOWN)
        return [r.choice(_FIRST), r.choice(_LAST) + r.choice(["", "", "-" + r.choice(_LAST)]), r.choice(_STREET) + r.choice(["straße", "str.", "weg"]), str(r.randrange(1, 200)), town, f"Kreis {town[0]}"]

    def noisy(p):
        q = list(p)
        i = r.choice([0, 1, 2, 3])
        q[i] = _typo(r, q[i])
        return q

    people = [person() for _ in range(n)]
    base = people + [noisy(r.choice(people)) for _ in range(duplicates)]
    target = []
    for i in range(n):
        target.append((f"b{i}", f"t{i}", *noisy(people[i])) if r.random() < 0.8 else (None, f"t{i}", *person()))
    return spark.createDataFrame([(f"b{i}", *p) for i, p in enumerate(base)], f"id_base string, {columns}"), spark.createDataFrame(target, f"actual_link string, id_target string, {columns}")


def workshop_tables(spark: SparkSession, n: int = 1000, seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A register, listings that point into it, and a panel of yearly records."""
    r = random.Random(seed)
    trades = ["Tischlerei", "Schlosserei", "Bäckerei", "Malerei", "Optik"]
    shops = [(f"w{i}", f"{r.choice(trades)} {r.choice(_LAST)} {r.choice(['GmbH', 'KG', ''])}".strip(), f"{r.choice(_FIRST)} {r.choice(_LAST)}", r.choice(trades), f"{r.randrange(10, 99)}", r.choice(_TOWN)) for i in range(n)]
    columns = "workshop string, proprietor string, trade string, postcode_area string, town string"
    listings = [(f"l{i}", s[0] if r.random() < 0.87 else None, _typo(r, s[1]) if r.random() < 0.5 else s[1], s[2] if r.random() < 0.8 else None, *s[3:]) for i, s in enumerate(r.sample(shops, int(n * 0.85)))]
    panel = [(f"p{i}_{y}", y, _typo(r, s[1]) if r.random() < 0.2 else s[1], *s[2:], s[0]) for i, s in enumerate(shops[: n // 3]) for y in range(2019, 2024) if r.random() < 0.5]
    return (
        spark.createDataFrame(shops, f"reg_no string, {columns}"),
        spark.createDataFrame(listings, f"listing_id string, actual_link string, {columns}"),
        spark.createDataFrame(panel, f"record_id string, year int, {columns}, true_entity string"),
    )
