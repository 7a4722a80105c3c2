import hashlib
import re
from fractions import Fraction

from linkwright.llm.mixing import mix_sources, source_targets
from tests.llm.conftest import ODD


def targets_by_rounds(sizes: dict, weights=(1, 2, 3), most=3):
    """The contract by rounds: share by weight, stop at the cap, share out the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, open_, out = Fraction(sum(sizes.values())), list(names), {}
    while open_:
        level = total / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            total -= out[s]
            open_.remove(s)
    return {s: float(v) for s, v in out.items()}


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets(spark):
    sizes = {"a": 100, "b": 5, "c": 60, "é": 1, "Z": 40, None: 7}
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = targets_by_rounds(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_mix(make):
    texts = [f"w{i} " * (1 + i * 7 % 23) for i in range(300)] + [None, "", "same text", "same text"]
    sources = [["a", "b", "c", "d"][min(3, i % 7)] for i in range(300)] + [None, "z", "a", "a"]
    df = make(texts, sources)
    rows = mix_sources(df, rows_per_bucket=10).collect()
    assert len(rows) == len(texts)
    sizes = {}
    for s, t in zip(sources, texts, strict=True):
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets_by_rounds(sizes)
    taken = {}
    for r in rows:
        assert r["size"] == words(texts[r["doc_id"]]) and r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * (r["repeats"] if r["size"] else 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 3 * max(words(t) for t in texts) for s in want)
    assert sum(taken.values()) <= sum(sizes.values())
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(df, rows_per_bucket=10).collect()))


def test_mix_against_one_queue(make):
    """All copies in one list, sorted by virtual finish time."""
    texts = [f"w{i} " * (1 + i * 5 % 11) for i in range(60)]
    sources = ["abc"[i % 5 % 3] for i in range(60)]
    got = {r["doc_id"]: r["taken"] for r in mix_sources(make(texts, sources), rows_per_bucket=3).collect()}
    sizes = {s: sum(words(t) for t, x in zip(texts, sources, strict=True) if x == s) for s in "abc"}
    target, queue = targets_by_rounds(sizes), []
    for s in "abc":
        order = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i) for i, x in enumerate(sources) if x == s)
        run = 0
        for _ in range(3):
            for h, i in order:
                run += words(texts[i])
                queue.append((run / target[s], s, h, i))
    budget, want = sum(sizes.values()), dict.fromkeys(range(60), 0)
    for _, _, _, i in sorted(queue):
        if budget < words(texts[i]):
            break
        budget -= words(texts[i])
        want[i] += words(texts[i])
    assert got == want


def test_odd_rows(make):
    df = make(ODD)
    assert mix_sources(df).count() == len(ODD)
    assert mix_sources(df.limit(0)).count() == 0
    assert mix_sources(make([None, ""])).where("taken = 0 and repeats = 1").count() == 2
    carried = mix_sources(df, carry=tuple(df.columns)).where("repeats > 0").select("row.*")
    assert carried.columns == df.columns
