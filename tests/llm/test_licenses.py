import re
import textwrap

from linkwright.llm.licenses import PHRASES, TEMPLATES, scan_licenses
from tests.llm.conftest import ODD

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(text, threshold=0.9):
    words = split(text)
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    base = sorted({x for _, x in places})
    best, more = 0.0, set()
    for line in re.sub("[A-Z]", lambda m: m.group().lower(), text or "").split("\n"):
        own = set(split(line))
        for label, template in TEMPLATES:
            t = set(split(template))
            share = len(own & t) / len(t)
            if share >= threshold - 1e-9:
                more.add(label)
                best = max(best, share)
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted({*base, *more})), 1.0 if places else round(best, 9))


def test_against_brute_force(make, spark):
    texts = [
        *ODD, *[t for _, t in TEMPLATES], "x Apache--License, MIT license and MIT\nlicense; cc by cc-by CC BY", "a gnu general public license gnu General public license b",
        "Redistribution and use in source and binary forms with or without modification are permitted provided the following conditions are met", "apachelicense mit licensed ccby", "Émit license", "mit licenseé",
        "the license of the work is free " * 50, "\n".join(t for _, t in TEMPLATES),
    ]
    got = {r["doc_id"]: r for r in scan_licenses(make(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) == brute(t), t
    low = {r["doc_id"]: r["labels"] for r in scan_licenses(make(texts), threshold=0.5).collect()}
    assert all(low[i] == brute(t, 0.5)[5] for i, t in enumerate(texts))
    assert scan_licenses(make(texts).limit(0)).count() == 0
    twice = make(texts).union(make(texts))
    assert scan_licenses(twice).count() == 2 * len(texts)
    assert scan_licenses(make(["MIT License"], ids=[None])).first()["n_base"] == 1
    assert "python" not in scan_licenses(make(texts))._jdf.queryExecution().executedPlan().toString().lower()


def test_wrapped_templates(make):
    """Notices broken over lines at 72 columns and less, in comments and between other text."""
    before, after = "Some words that come before it, in a line of their own and then", "followed by more text\nthat has nothing to do with it"
    texts, labels = [], []
    for label, t in TEMPLATES:
        for width, mark in ((72, " * "), (40, "# "), (25, "")):
            lines = textwrap.wrap(f"{before} {t} {after}", width, break_long_words=False, break_on_hyphens=False)
            texts.append("\n".join(mark + x for x in lines))
            labels.append(label)
    n = len(texts)
    far = ("\n" + "other words stand here " * 9).join(TEMPLATES[8][1].split())
    rows = {r["doc_id"]: r for r in scan_licenses(make([*texts, far])).collect()}
    assert len(rows) == n + 1
    for i in range(n):
        assert labels[i] in rows[i]["labels"].split(",") and rows[i]["score"] == 1.0, texts[i]
    assert (rows[n]["labels"], rows[n]["score"]) == ("", 0.0)


def test_runs_across_lines_against_brute_force(make):
    import math
    import random

    r = random.Random(7)
    texts = []
    for i in range(60):
        w = split(TEMPLATES[i % len(TEMPLATES)][1])
        for _ in range(r.randrange(0, 5)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [r.choice(["zz", "the", "license"])]
        w = ["aa"] * r.randrange(9) + w + ["bb"] * r.randrange(9)
        texts.append("".join(x + r.choice("   \n") for x in w))
    for threshold in (0.9, 0.7):
        got = {x["doc_id"]: x["labels"] for x in scan_licenses(make(texts), threshold=threshold).collect()}
        for i, t in enumerate(texts):
            words, want = split(t), set(filter(None, brute(t, threshold)[5].split(",")))
            for label, template in TEMPLATES:
                own = set(split(template))
                span = math.ceil(len(split(template)) / threshold - 1e-9)
                if any(len(own & set(words[j : j + span])) / len(own) >= threshold - 1e-9 for j in range(len(words))):
                    want.add(label)
            assert got[i] == ",".join(sorted(want)), t
