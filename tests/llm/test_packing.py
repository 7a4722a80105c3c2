import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from linkwright.llm.packing import default_cost, pack_documents, plan_packing
from tests.llm.conftest import ODD


def unroll(histogram, lengths):
    """Bins from a plan, piece by piece: {bin: [(offset, size)]}."""
    plan, bins = plan_packing(histogram, lengths), {}
    rows = list(zip(plan.size, plan.first, plan.bin, plan.per_bin, plan.offset, strict=True))
    for k, (s, first, start, per, offset) in enumerate(rows):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == s else histogram[s]
        for i in range(end - first):
            bins.setdefault(start + i // per, []).append((offset + i % per * s, s))
    return plan, bins


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_every_piece_once_and_bins_shrink(histogram):
    lengths = (8, 16, 32)
    plan, bins = unroll(histogram, lengths)
    assert sorted(s for b in bins.values() for _, s in b) == sorted(s for s, n in histogram.items() for _ in range(n))
    assert len(bins) == plan.n_bins
    for b, items in bins.items():
        at = 0
        for offset, s in sorted(items):
            assert offset == at
            at += s
        run = max(i for i, x in enumerate(plan.run_bin) if x <= b)
        assert plan.run_fill[run] == at and plan.run_length[run] == min(x for x in lengths if x >= at)


def test_best_fit_goes_to_the_tightest_bin():
    _, bins = unroll({30: 1, 20: 1, 12: 1, 2: 1}, (32,))
    assert sorted(sorted(s for _, s in b) for b in bins.values()) == [[2, 30], [12, 20]]


def test_not_worse_than_one_length():
    r = random.Random(3)
    histogram = {}
    for _ in range(4000):
        s = min(512, int(r.lognormvariate(4, 1)) + 1)
        histogram[s] = histogram.get(s, 0) + 1
    cost = lambda lengths: sum(default_cost(length) * n for length, n in used(lengths).items())

    def used(lengths):
        plan = plan_packing(histogram, lengths)
        out = {}
        for i, length in enumerate(plan.run_length):
            n = (plan.run_bin[i + 1] if i + 1 < len(plan.run_bin) else plan.n_bins) - plan.run_bin[i]
            out[length] = out.get(length, 0) + n
        return out

    assert cost((128, 256, 512)) <= cost((512,))


def test_documents(make):
    texts = ["a " * n for n in (3, 30, 31, 32, 33, 64, 100, 1, 1, 1, 7, 7, 7)] + [None, "", "same", "same"]
    df = make(texts)
    rows = pack_documents(df, lengths=(8, 16, 32)).collect()
    assert sum(r["n_words"] for r in rows) == sum(len((t or "").split()) for t in texts)
    assert sorted({r["doc_id"] for r in rows}) == list(range(len(texts)))
    assert all(r["bin_id"] is None for r in rows if r["n_words"] == 0) and sum(r["n_words"] == 0 for r in rows) == 2
    bins = {}
    for r in rows:
        assert r["first_word"] == r["piece"] * 32
        if r["n_words"]:
            bins.setdefault(r["bin_id"], []).append(r)
    for items in bins.values():
        at = 0
        for r in sorted(items, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at and r["bin_words"] <= r["seq_len"]
            at += r["n_words"]
        assert all(r["bin_words"] == at for r in items)
    assert pack_documents(make(ODD)).select("doc_id").distinct().count() == len(ODD)
    assert pack_documents(df.limit(0)).count() == 0
    assert pack_documents(make([None])).first()["bin_id"] is None
    twice = df.union(df)
    assert pack_documents(twice, lengths=(8, 16, 32)).count() == 2 * len(rows)


def placed_one_by_one(histogram, lengths, cost=default_cost):
    """Best fit with every bin and every piece by itself: ``{(sorted contents): bins}``."""
    bins, waiting, clock = [], dict(histogram), itertools.count()
    for s in sorted(histogram, reverse=True):
        while waiting[s]:
            fits = [b for b in bins if b[0] >= s]
            if fits:
                b = min(fits, key=lambda b: (b[0], b[2]))
                b[0] -= s
                b[1].append(s)
                b[2] = next(clock)
                waiting[s] -= 1
                continue
            choices = []
            for length in lengths:
                if length >= s:
                    own, opened = min(waiting[s], length // s), -(-waiting[s] // (length // s))
                    spare = length - own * s
                    smaller = sum(x * n for x, n in waiting.items() if x < s and x <= spare)
                    choices.append((cost(length) / (own * s + min(spare, smaller / opened)), length, opened))
            _, length, opened = min(choices)
            bins += [[length, [], next(clock)] for _ in range(opened)]
    out = {}
    for _, items, _ in bins:
        fill = sum(items)
        key = (tuple(sorted(items)), min(x for x in lengths if x >= fill))
        out[key] = out.get(key, 0) + 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 25), max_size=10))
def test_plan_against_one_piece_at_a_time(histogram):
    plan, bins = unroll(histogram, (8, 16, 32))
    got = {}
    for b, items in bins.items():
        run = max(i for i, x in enumerate(plan.run_bin) if x <= b)
        key = (tuple(sorted(s for _, s in items)), plan.run_length[run])
        got[key] = got.get(key, 0) + 1
    assert got == placed_one_by_one(histogram, (8, 16, 32))


def test_documents_against_one_piece_at_a_time(make):
    r = random.Random(12)
    texts = ["w " * min(90, int(r.lognormvariate(2.2, 1))) for _ in range(300)] + ODD[:9]
    histogram = {}
    for t in texts:
        n = len((t or "").split())
        for size in [32] * (n // 32) + [n % 32] * (n % 32 > 0):
            histogram[size] = histogram.get(size, 0) + 1
    bins = {}
    for x in pack_documents(make(texts), lengths=(8, 16, 32)).where("bin_id is not null").collect():
        bins.setdefault((x["bin_id"], x["seq_len"]), []).append(x["n_words"])
    got = {}
    for (_, length), items in bins.items():
        key = (tuple(sorted(items)), length)
        got[key] = got.get(key, 0) + 1
    assert got == placed_one_by_one(histogram, (8, 16, 32))
