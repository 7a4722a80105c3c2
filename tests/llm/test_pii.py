import hashlib
import re

import pytest
from pyspark.sql import functions as F

from linkwright.llm.pii import feistel_date, feistel_octets, feistel_text, pseudonymise_documents
from tests.llm.conftest import ODD


def feistel(value: str, key: str, kind: str) -> str:
    """The same permutation in plain Python."""
    half = -(-len(value) // 2)
    a, b = value[:half], value[half:]
    for r in range(8):
        h = hashlib.sha256("|".join([key, kind, str(r), b]).encode()).hexdigest()
        out = ""
        for i, c in enumerate(a):
            k = int(h[i % 16 * 4 : i % 16 * 4 + 4], 16)
            for first, last in (("0", "9"), ("a", "z"), ("A", "Z"), ("à", "ÿ")):
                if first <= c <= last:
                    c = chr((ord(c) - ord(first) + k) % (ord(last) - ord(first) + 1) + ord(first))
                    break
            out += c
        a, b = b, out
    return a + b


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def one(make, text, key="k"):
    r = pseudonymise_documents(make([text]), key).first()
    return r["text"], r["pii"]


def test_feistel_is_a_permutation_and_as_by_hand(spark):
    values = [f"{i:03d}" for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["p"] for r in df.select("v", feistel_text(F.col("v"), "k", "x").alias("p")).collect()}
    assert sorted(got.values()) == values and got["123"] == feistel("123", "k", "x")
    quads = spark.range(2000).select(F.concat_ws(".", F.pmod("id", F.lit(256)).cast("string"), F.floor(F.col("id") / 256).cast("string"), F.lit("7"), F.lit("9")).alias("v"))
    assert quads.select(feistel_octets(F.col("v"), "k")).distinct().count() == 2000
    days = spark.range(3000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    moved = days.select(feistel_date(F.col("d"), "k").alias("m"))
    assert moved.distinct().count() == 3000
    assert moved.where("m < '1600-01-01' or m >= '2400-01-01'").count() == 0


def test_kinds(make):
    text, kinds = one(make, "mail Anna.91@mail7.example.com, again Anna.91@mail7.example.com; tel +1 (731) 555-0170 from 10.20.30.255.\nborn 1984-02-29!")
    assert kinds == "email:2,phone:1,ip:1,date:1"
    m = re.fullmatch(r"mail (\S+)@mail7\.example\.com, again (\S+)@mail7\.example\.com; tel (\+1 \(\d{3}\) \d{3}-\d{4}) from (\d+\.\d+\.\d+\.\d+)\.\nborn (\d{4}-\d\d-\d\d)!", text)
    assert m and m[1] == m[2] == feistel("Anna.91", "k", "email")
    assert m[3] != "+1 (731) 555-0170" and all(int(o) < 256 for o in m[4].split(".")) and m[5] != "1984-02-29"
    assert m[3] == "+1" + feistel(" (731) 555-0170", "k", "phone")
    assert one(make, "x 1984-02-30 y 999.1.1.1 z 4785380592391138 v 4.0")[0] == "x 1984-02-30 y 999.1.1.1 z 4785380592391138 v 4.0"


def test_cards_and_secrets(make):
    for card in ("4785380592391139", "4785 3805 9239 1139"):
        assert luhn(card)
        text, kinds = one(make, f"a {card}, b")
        new = text[2:-3]
        assert kinds == "card:1" and new != card and luhn(new) and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", card)
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    text, kinds = one(make, f'token = "{token}"')
    assert kinds == "secret:1" and re.fullmatch(r'token = "[0-9a-f]{40}"', text) and token not in text
    assert one(make, token.upper())[0].isupper()
    assert one(make, "a 4785380592391139", "k")[0] != one(make, "a 4785380592391139", "other")[0]


def test_odd_rows(make):
    df = make([*ODD, "clean text, nothing here 12 and 3.5%"])
    rows = {r["doc_id"]: r for r in pseudonymise_documents(df).collect()}
    for i, t in enumerate(ODD):
        assert rows[i]["text"] == t and rows[i]["pii"] == (None if t is None else "")
    assert pseudonymise_documents(df).columns == df.columns
    assert pseudonymise_documents(df.limit(0)).count() == 0
    long = "word " * 20000 + "12.34.56.78 " + "word " * 20000
    assert one(make, long)[1] == "ip:1"


@pytest.mark.parametrize("bad", ["python", "arrow", "pandas"])
def test_native(make, bad):
    plan = pseudonymise_documents(make(["a@b.c"]))._jdf.queryExecution().executedPlan().toString().lower()
    assert bad not in plan


def test_written_forms_share_a_pseudonym(make):
    digits = lambda t: re.sub(r"\D", "", t)
    cards = [one(make, f"a {c}, b") for c in ("4785380592391139", "4785 3805 9239 1139", "4785-3805-9239-1139")]
    assert all(k == "card:1" for _, k in cards) and len({digits(t) for t, _ in cards}) == 1 and luhn(cards[0][0])
    forms = ("+1 (731) 555-0170", "+1 731 555 0170", "+1-731-555-0170", "+1.731.555.0170")
    phones = [one(make, f"call {p}.") for p in forms]
    assert all(k == "phone:1" for _, k in phones) and len({digits(t) for t, _ in phones}) == 1
    assert [re.sub(r"\d", "9", t[5:-1]) for t, _ in phones] == [re.sub(r"\d", "9", p) for p in forms] and all(t.startswith("call +1") for t, _ in phones)
    assert digits(one(make, "call (731) 555-0170.")[0]) == digits(phones[0][0])[1:]
    assert digits(one(make, "call +44 20 7946 0958.")[0])[:2] == "44"


def test_numbers_stay_valid(spark):
    ssn = r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}"
    ids = spark.range(1, 3000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 600 + 1, F.col("id") % 99 + 1, F.col("id")).alias("text"), F.col("id").alias("doc_id"))
    rows = pseudonymise_documents(ids, "k").collect()
    assert all(r["pii"] == "ssn:1" and re.fullmatch(ssn, r["text"]) for r in rows) and len({r["text"] for r in rows}) == len(rows)


def test_dates_with_slashes(make):
    iso = one(make, "on 1980-12-25.")[0][3:-1]
    y, m, d = iso.split("-")
    assert one(make, "on 12/25/1980.")[0] == f"on {m}/{d}/{y}." and one(make, "on 25/12/1980.")[0] == f"on {d}/{m}/{y}."
    assert one(make, "on 25/13/1980.")[0] == "on 25/13/1980."


def test_key_comes_from_the_session(make, spark):
    spark.conf.set("spark.linkwright.pii.key", "k")
    try:
        assert pseudonymise_documents(make(["a 4785380592391139"])).first()["text"] == one(make, "a 4785380592391139")[0]
    finally:
        spark.conf.unset("spark.linkwright.pii.key")
    with pytest.warns(UserWarning, match="pii.key"):
        pseudonymise_documents(make(["a"]))
