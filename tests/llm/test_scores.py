"""Toxicity, quality and the language model: exactness of their parts, and held-out quality."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from linkwright.llm import language_model as lm
from linkwright.llm import quality as q
from linkwright.llm import toxicity as tox
from tests.llm.conftest import ODD


def test_block_max_index_is_exact():
    r = random.Random(2)
    vectors = []
    for _ in range(400):
        v = {r.randrange(30): r.random() + 0.1 for _ in range(r.randrange(1, 6))}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    vectors += vectors[:50]
    index = tox.BlockMaxIndex(vectors, 30, block=16)
    for i in range(0, 450, 7):
        got = [round(s, 9) for s, _ in index.top(vectors[i], 10, skip=i)]
        want = sorted((sum(vectors[i].get(t, 0) * w for t, w in v.items()) for j, v in enumerate(vectors) if j != i), reverse=True)
        assert got == [round(s, 9) for s in want[:10] if s > 0]
    assert index.top({}, 5) == [] and tox.BlockMaxIndex([], 1).top({0: 1.0}, 5) == []


def corpus(n, seed=4):
    r = random.Random(seed)
    bad = ["scumble", "moronic", "trashy", "loserly"]
    texts, labels = [], []
    for i in range(n):
        w = [r.choice("abcdefghij") + r.choice("klmnop") * r.randrange(1, 4) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                w[r.randrange(60)] = r.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_on_held_out_rows(make, spark):
    texts, labels = corpus(300)
    df = make([*texts, *ODD])
    told = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if i % 3], "doc_id long, label int")
    rows = {r["doc_id"]: r for r in tox.toxicity_documents(df, told).collect()}
    held = [i for i in range(300) if i % 3 == 0]
    assert sum(rows[i]["predicted"] == labels[i] for i in held) / len(held) > 0.97
    assert all(rows[300 + j]["predicted"] == 0 for j in range(len(ODD)))
    assert rows[5]["evidence"] and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(abs(r["score"] - 0.01) < 1e-9 for r in tox.toxicity_documents(df, told.limit(0)).collect())
    assert tox.toxicity_documents(df.limit(0), told).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 0), (1, 0), (5, 1)], "doc_id long, label int")
    assert tox.toxicity_documents(df, odd).count() == df.count()


def test_attention_gradients():
    r = np.random.default_rng(0)
    counts, label = np.array([1, 3, 2, 5]), np.array([0.0, 1.0, 1.0, 0.0])
    x = r.normal(size=(counts.sum(), 7))
    m = q.GatedAttention.start(x, 4, 3, 1)
    m.p["c"] = r.normal(size=4)
    _, grads = m.gradients(x, counts, label)
    for k, p in m.p.items():
        for at in [tuple(0 for _ in p.shape), tuple(s - 1 for s in p.shape)]:
            old = p[at]
            p[at] = old + 1e-6
            up, _ = m.gradients(x, counts, label)
            p[at] = old - 1e-6
            down, _ = m.gradients(x, counts, label)
            p[at] = old
            assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-6, k


def test_encoding_covers_every_byte():
    x, counts = q.encode_passages(ODD)
    assert counts.tolist() == [max(1, -(-len((t or "").encode()) // q.PASSAGE)) for t in ODD] and len(x) == counts.sum()
    a, _ = q.encode_passages(["abc" * 1000])
    b, _ = q.encode_passages(["abc" * 1000, None])
    assert np.allclose(a, b[: len(a)])


def test_quality_on_held_out_rows(make, spark):
    r = random.Random(8)
    texts, labels = [], []
    for i in range(240):
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(150)]
        if i % 4 == 0:
            w = [x.upper() + "!!" if k > 60 else x for k, x in enumerate(w)]
        texts.append(" ".join(w))
        labels.append(int(i % 4 != 0))
    df = make([*texts, *ODD])
    told = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if i % 3], "doc_id long, label int")
    rows = {x["doc_id"]: x for x in q.quality_documents(df, told).collect()}
    held = [i for i in range(240) if i % 3 == 0]
    assert sum(rows[i]["predicted"] == labels[i] for i in held) / len(held) > 0.95
    assert all(0 <= x["score"] <= 1 for x in rows.values())
    assert {x["score"] for x in q.quality_documents(df, told.limit(0)).collect()} == {0.5}
    assert q.quality_documents(df.limit(0), told).count() == 0


def lexicon():
    head = {" ": 0, "the": 1, "of": 2, "und": 3, "a": 4}
    return lm.Lexicon(head, 2, np.array([9.0, 8, 7, 6, 5]), {"xa|": 0}, np.array([6.0, 10.0]), np.array([3.0, 4.0]), 51, 12)


def test_language_model_is_a_distribution_and_windows_do_not_matter():
    lex = lexicon()
    net = lm.GRU(lex, hidden=8, embed=6)
    tokens = [*lex.head, "xa", "zz"]
    ids, classes = lex.codes(tokens)
    h = np.random.default_rng(0).normal(size=(1, 8)).astype(np.float32)
    total = 0.0
    for i, c in zip(ids, classes, strict=True):
        word = np.array([i if i < len(lex.head) else -1])
        total += math.exp(net.log_probs(h, np.array([c]), word)[0])
    assert abs(total - 1) < 1e-5
    share = 10 ** lex.tail_log10(np.array([lex.head_classes]), np.array([2.0]))[0]
    assert abs(share - 3 / 10) < 1e-12
    docs = [np.stack(lex.codes([random.Random(k).choice(tokens) for _ in range(n)] + [" "]), axis=1) for k, n in enumerate((0, 1, 5, 70, 200))]
    a, b = net.score(docs, lex, lanes=1, window=512), net.score(docs, lex, lanes=3, window=7)
    assert np.allclose(a, b, atol=1e-3)
    assert np.allclose(a[3], net.score([docs[3]], lex)[0], atol=1e-3)


def test_language_model_gradients():
    lex = lexicon()
    net = lm.GRU(lex, hidden=5, embed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    ids, classes = lex.codes([r.choice([*lex.head, "xa", "zz"]) for _ in range(24)])
    ids, classes = ids.reshape(2, 12), classes.reshape(2, 12)
    before = np.concatenate([np.zeros((2, 1), int), ids[:, :-1]], axis=1)

    def loss():
        h, total = np.zeros((2, 5)), 0.0
        g = net.p["E"][before] @ net.p["Wx"] + net.p["b"]
        for t in range(12):
            h = net.step(g[:, t], h * (before[:, t] != 0)[:, None])[0]
            total -= net.log_probs(h, classes[:, t], np.where(ids[:, t] < 5, ids[:, t], -1)).sum()
        return total / 24

    _, grads = net._window(before, ids, classes, np.zeros((2, 5), np.float32), 0)
    numeric = {}
    for k in net.p:
        at = tuple(min(1, s - 1) for s in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-4
        up = loss()
        net.p[k][at] = old - 1e-4
        down = loss()
        net.p[k][at] = old
        numeric[k] = ((up - down) / 2e-4, grads[k][at])
    scale = [n / g for n, g in numeric.values() if abs(g) > 1e-4]
    assert scale and np.allclose(scale, scale[0], rtol=2e-2)  # the gradient, up to the clipping factor


@pytest.fixture(scope="module")
def small_lm(make):
    r = random.Random(3)
    tongues = ["alpha beta gamma delta the of".split(), "uno dos tres cuatro el de".split()]
    texts = [" ".join(r.choice(tongues[i % 2]) for _ in range(r.randrange(1, 120))) for i in range(150)] + ODD
    return texts, make(texts)


def test_language_model_documents(small_lm):
    from pyspark.sql import functions as F

    texts, df = small_lm
    train = F.col("doc_id") % 7 != 2
    rows = {x["doc_id"]: x for x in lm.score_documents(df, train, head=12, width=4, shapes=5, hidden=8).collect()}
    assert len(rows) == len(texts)
    counts = Counter()
    for i, t in enumerate(texts):
        if i % 7 != 2:
            counts.update([w.decode() for w in lm.words_of(t)] + [" "])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens = [w.decode() for w in lm.words_of(t)] + [" "]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)) < 1e-6 * len(tokens)
    held = [i for i in range(150) if i % 7 == 2]
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)
    assert rows[len(texts) - 1]["score"] == pytest.approx(rows[150]["score"], abs=1e-4)
    assert lm.score_documents(df.limit(0), train, head=4, width=2, shapes=2, hidden=4).count() == 0
    none = lm.score_documents(df, F.lit(False), head=4, width=2, shapes=2, hidden=4).collect()
    assert len(none) == len(texts) and all(math.isfinite(x["score"]) for x in none)


def test_language_model_learns_from_every_training_word(make):
    from pyspark.sql import functions as F

    net, lex = lm.GRU(lexicon(), hidden=4, embed=3), lexicon()
    for n in (1, 31, 33, 1000, 2077):
        docs = [np.stack(lex.codes(["the"] * (n - 1) + [" "]), axis=1)]
        assert net.train(docs, lex) == n
    r = random.Random(6)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(1000)) for _ in range(300)]

    def weights(texts):
        blocks = make(texts).coalesce(1).withColumn("train", F.lit(True)).select("doc_id", "text", "train").mapInPandas(lm._blocks, "block long, docs binary")
        counts = Counter(w for t in texts for w in [*t.split(), " "])
        names = {w: i for i, w in enumerate(sorted(counts))}
        lex = lm.Lexicon(names, 2, np.array([float(counts[w]) for w in names]), {}, np.array([0.0]), np.array([0.0]), sum(counts.values()), len(counts))
        return lm.train_model(blocks, lex, hidden=4, rounds=1).p

    before = weights(texts)
    # of the 300,000 words a third used to be read in a round; whichever document changes, the weights must
    for i in range(0, 300, 60):
        other = [*texts]
        other[i] = " ".join(sorted(texts[i].split()))
        after = weights(other)
        assert any(not np.array_equal(before[k], after[k]) for k in before), i


def test_quality_against_one_passage_at_a_time(make, spark):
    """The scores of the query, recomputed by scalar loops from the fitted weights."""
    texts, labels = corpus(60)
    texts = [t * (1 + i % 5) for i, t in enumerate(texts)] + ODD
    df = make(texts)
    told = spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int")
    model = q.fit_quality(df, told, steps=20)
    rows = {x["doc_id"]: x["score"] for x in q.quality_documents(df, told, steps=20).collect()}
    p, sigmoid = model.p, lambda z: 1 / (1 + math.exp(-z))
    for i, text in enumerate(texts):
        data = (text or "").encode()
        passages, counts = q.encode_passages([text])
        assert counts[0] == len(passages) == max(1, -(-len(data) // q.PASSAGE))
        hs, weights = [], []
        for x in passages:
            x = [min(8, max(-8, (a - m) / s)) for a, m, s in zip(x, model.mean, model.scale, strict=True)]
            h = [max(0.0, sum(a * w for a, w in zip(x, p["W"][:, j], strict=True)) + p["b"][j]) for j in range(len(p["b"]))]
            gate = 0.0
            for k in range(len(p["w"])):
                v, u = (sum(a * w for a, w in zip(h, p[name][:, k], strict=True)) for name in "VU")
                gate += p["w"][k] * math.tanh(v) * sigmoid(u)
            hs.append(h)
            weights.append(math.exp(gate))
        z = [sum(w * h[j] for w, h in zip(weights, hs, strict=True)) / sum(weights) for j in range(len(p["c"]))]
        want = sigmoid(sum(a * c for a, c in zip(z, p["c"], strict=True)) + p["d"][0])
        assert rows[i] == pytest.approx(want, abs=1e-4), i


def test_columns_of_any_name_survive(spark):
    df = spark.createDataFrame([(1, "good text", "a", "b", "c"), (2, None, "d", "e", "f")], "doc_id long, text string, _s string, row string, score string")
    told = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    for fn in (q.quality_documents, tox.toxicity_documents):
        out = fn(df, told)
        assert out.columns[:5] == df.columns
        assert {(r["doc_id"], r["_s"], r["row"]) for r in out.collect()} == {(1, "a", "b"), (2, "d", "e")}
        assert dict(out.dtypes)["score"] == "double"


def test_block_max_index_with_rare_and_common_terms():
    r = random.Random(5)
    vectors = []
    for _ in range(900):
        v = {r.randrange(4): r.random() for _ in range(3)} | {4 + int(r.paretovariate(0.7)) % 3000: r.random() + 0.2 for _ in range(12)}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    vectors += vectors[:30]
    index = tox.BlockMaxIndex(vectors, 3100, block=8, common=6)
    assert 0 < len(index.columns) <= 6 < index.n_blocks
    for i in range(0, len(vectors), 11):
        got = index.top(vectors[i], 7, skip=i)
        cosine = [round(sum(w * vectors[j].get(t, 0) for t, w in vectors[i].items()), 9) for j in range(len(vectors))]
        want = sorted(((-s, j) for j, s in enumerate(cosine) if s > 0 and j != i))[:7]
        assert [(round(s, 9), j) for s, j in got] == [(-s, j) for s, j in want]


def test_toxicity_against_all_examples(make, spark):
    """The query's scores and evidence from plain dictionaries: weights, every cosine, the vote, the calibration."""
    import re

    texts, labels = corpus(90, seed=9)
    texts += ["scumble " * 3 + "ak", "ak. AK, ak!", texts[1], "zz-unknown words", *ODD]
    df = make(texts)
    told = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if i % 3], "doc_id long, label int")
    rows = {r["doc_id"]: r for r in tox.toxicity_documents(df, told).collect()}
    model = tox.fit_toxicity(df, told)
    bags = [Counter(re.sub(r"[\x00-\x20!-/:-@\[-`{-~]", " ", (t or "").lower()).split(" ")) for t in texts]
    for b in bags:
        del b[""]
    seen = Counter(w for b in bags for w in b)
    first = {}
    for i, y in enumerate(labels):
        if i % 3:
            first.setdefault(texts[i], (i, y))
    examples = sorted(first.values())
    c, p = Counter(w for i, _ in examples for w in bags[i]), Counter(w for i, y in examples if y for w in bags[i])
    rate = sum(y for _, y in examples) / len(examples)

    def weight(w):
        parts = [(p[w], c[w] * rate), (c[w] - p[w], c[w] * (1 - rate))]
        g2 = max(0.0, 2 * sum(x * math.log(x / e) for x, e in parts if x > 0))
        return (math.log((1 + len(texts)) / (1 + seen[w])) + 1) * (1 + 0.2 * g2)

    def vector(i):
        v = {w: (1 + math.log(n)) * weight(w) for w, n in bags[i].items() if c[w] and seen[w] >= 2}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    known = {i: vector(i) for i, _ in examples}
    toxic = dict(examples)
    for i in range(len(texts)):
        v = vector(i)
        near = sorted((-round(sum(x * known[j].get(w, 0) for w, x in v.items()), 12), j) for j in known)
        near = [(j, -s) for s, j in near if s < 0][:15]
        total, bad = sum(s for _, s in near), [s for j, s in near if toxic[j]]
        share, best = (sum(bad) / total if near else 0.0), max(bad, default=0.0)
        a = model.calibration
        want = 1 / (1 + math.exp(-(a[0] + a[1] * share + a[2] * best + a[3] * share * best)))
        assert rows[i]["score"] == pytest.approx(want, abs=1e-8), i
        assert rows[i]["evidence"] == [str(j) for j, _ in near[:3]], i


def test_language_model_does_not_depend_on_partitions(small_lm, monkeypatch):
    from pyspark.sql import functions as F

    _, df = small_lm
    train = F.col("doc_id") % 7 != 2
    for size, name in ((1 << 12, "BLOCK_BYTES"), (1 << 15, "PART_BYTES"), (2, "FAN_IN")):
        monkeypatch.setattr(lm, name, size)
    found = []
    for parts in (1, 6):
        rows = lm.score_documents(df.repartition(parts), train, head=12, width=4, shapes=5, hidden=8).collect()
        found.append(sorted((x["doc_id"], x["n_tokens"], x["n_known"], round(x["base_score"], 9), round(x["score"], 6)) for x in rows))
    assert found[0] == found[1] and len(found[0]) == df.count()


def test_language_model_odd_ids_and_repeated_rows(make):
    from pyspark.sql import functions as F

    df = make(["alpha beta", "alpha beta", None, "alpha beta gamma"], ids=[None, 4, 4, 5])
    rows = lm.score_documents(df.union(df), F.col("doc_id") != 5, head=4, width=2, shapes=2, hidden=4).collect()
    assert len(rows) == 8 and sum(x["doc_id"] is None for x in rows) == 2
    same = {}
    for x in rows:
        same.setdefault((x["doc_id"], x["n_tokens"]), set()).add(round(x["score"], 6))
    assert all(len(v) == 1 for v in same.values())


def test_classes_follow_from_input_ids():
    lex = lexicon()
    ids, classes = lex.codes([*lex.head, "xa", "xab", "zz", "Q9"])
    assert np.array_equal(lex.with_classes(ids.astype("<u2")), np.stack([ids, classes], axis=1))


def test_blocks_hold_tokens_so_that_texts_are_read_once():
    import pandas as pd

    texts = [*ODD, "A b c a", "a\tb \u001f ẞ", ""]
    pdf = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "train": [i % 3 > 0 for i in range(len(texts))]})
    (block,) = list(lm._blocks([pdf.iloc[:2], pdf.iloc[2:]]))
    docs, names, at = lm._open_block(block["docs"][0])
    want = [[w.decode() for w in lm.words_of(t)] + [lm.END] for t in texts]
    assert [list(np.array(names, object)[x]) for x in np.split(at, np.cumsum(docs["size"])[:-1])] == want
    (counts,) = list(lm._block_counts([block]))
    learnt = Counter(w for i, own in enumerate(want) if i % 3 for w in own)
    assert dict(zip(counts["token"], counts["n"], strict=True)) == {w: learnt[w] for own in want for w in own}
    assert counts["place"].tolist() == list(range(len(names)))


def test_postings_are_fetched_in_runs():
    first, last = np.array([4, 9, 9, 0]), np.array([6, 9, 12, 1])
    at, sizes = tox.runs(first, last)
    assert at.tolist() == [4, 5, 9, 10, 11, 0] and sizes.tolist() == [2, 0, 3, 1]
    assert tox.runs(first[:0], last[:0])[0].tolist() == [] and tox.runs(first[1:2], last[1:2])[0].tolist() == []
    index = tox.BlockMaxIndex([{0: 0.6, 2: 0.8}, {1: 1.0}, {2: 1.0}], 4, block=2)
    place, short = index.postings[:, 0], index.postings[:, 1].view(np.float32)
    assert sorted(zip(index.order[place].tolist(), short.round(6).tolist(), strict=True)) == sorted([(0, np.float32(0.6).round(6)), (0, np.float32(0.8).round(6)), (1, 1.0), (2, 1.0)])
    assert index.top({2: 1.0}, 3) == [(1.0, 2), (0.8, 0)] and index.top({3: 1.0}, 3) == []


def test_terms_of_many_texts_at_once():
    import pyarrow as pa

    words = sorted({w for t in ODD for w in tox.text_terms(t)} | {b"the", b"a"})[::-1]
    texts = [*ODD, "the A the, zz", " the the ", " the\x1cthe\x85", "\ud800 the", " the ", None, "."]
    got = tox.ToxicityModel(b" ".join(words), np.zeros(0), 3).counts(texts)
    for text, (terms, counts) in zip(texts, got, strict=True):
        own = Counter(w for w in tox.text_terms(text) if w in words)
        assert {words[i]: c for i, c in zip(terms.tolist(), counts.tolist(), strict=True)} == own and terms.tolist() == sorted(terms.tolist())
    assert [len(t) for t, _ in tox.ToxicityModel(b"", np.zeros(0), 3).counts(["a b", None])] == [0, 0]
    long = ["x" * n for n in (3, 9, 1, 1, 1, 30, 2)] + [None, ""]
    assert [len(p) for p in tox.text_pieces(long, most=3, size=12)] == [2, 3, 1, 3] and sum(tox.text_pieces(long, 3, 12), []) == long


def test_language_model_looks_up_and_splits_many_words_at_once(monkeypatch):
    import pandas as pd

    from linkwright.llm.common import words_of

    class Whole(dict):
        def get(self, *_):
            raise AssertionError("one word at a time")

    monkeypatch.setattr(lm, "words_of", Whole().get)
    tokens = [" ", "the", "xa", "xab", "x", "xé", "éa", "éx{", "日本語", "Q9", "a`", "a\x7f", "a\x80", "the|", "\ud800", "\x00"]
    head, shapes = ["the", " "], ["xa|", "éa|", "日本|", "Q9|9", "a`|`", "a\x7f|\x7f", "a\x80|", "th||", "\ud800|"]
    for heads, kinds in ((head, shapes), (head, []), ([], shapes), ([], [])):
        lex = lm.Lexicon(Whole(zip(heads, range(9))), 1, np.ones(len(heads)), Whole(zip(kinds, range(9))), np.ones(len(kinds) + 1), np.ones(len(kinds) + 1), 1, 1)
        keys = [t[:2] + "|" + (t[-1] if t[-1] <= "\x7f" and not "a" <= t[-1] <= "z" else "") for t in tokens]
        want = [heads.index(t) if t in heads else len(heads) + (kinds.index(s) if s in kinds else len(kinds)) for t, s in zip(tokens, keys, strict=True)]
        ids, classes = lex.codes(tokens)
        assert ids.tolist() == want and [c - lex.head_classes + len(heads) for c, i in zip(classes.tolist(), want, strict=True) if i >= len(heads)] == [i for i in want if i >= len(heads)]
        assert [len(x) for x in lex.codes([])] == [0, 0]
    texts = [*ODD, "\ud800 A\x1ca", "a\x0b\x0cB\r\x85 \xa0ẞ", "\u2003 İ K"]
    docs, names, at = lm._open_block(lm._pack_block(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "train": True})))
    want = [[w.decode("utf-8", "surrogatepass") for w in words_of(t)] + [lm.END] for t in texts]
    assert docs["size"].tolist() == [len(w) for w in want] and [names[i] for i in at] == sum(want, [])


def test_language_model_with_large_weights():
    """Powers of e beyond what floats hold: probabilities by plain sums in logs, gradients by differences, one long window by score."""
    lex, r = lexicon(), np.random.default_rng(3)
    net = lm.GRU(lex, hidden=5, embed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["Wc"], net.p["Wo"] = r.normal(0, 400, net.p["Wc"].shape), r.normal(0, 400, net.p["Wo"].shape)
    ids, classes = (x.reshape(2, 20) for x in lex.codes([r.choice([*lex.head, "xa", "zz"]) for _ in range(40)]))
    before = np.concatenate([np.zeros((2, 1), int), ids[:, :-1]], axis=1)
    h0 = r.uniform(-1, 1, (2, 5))

    def loss():
        h, total = h0, 0.0
        for t in range(20):
            h = net.step(net.p["E"][before[:, t]] @ net.p["Wx"] + net.p["b"], h * (before[:, t] != 0)[:, None])[0]
            for x, y, i in zip(h, classes[:, t], ids[:, t], strict=True):
                z = x @ net.p["Wc"] + net.p["bc"]
                own = z[y] - np.logaddexp.reduce(z)
                if i < 5:
                    z = x @ net.p["Wo"][y] + net.p["bo"][y]
                    own += z[i % 2] - np.logaddexp.reduce(z)
                assert abs(net.log_probs(x[None], np.array([y]), np.array([i if i < 5 else -1]))[0] - own) < 1e-6 * abs(own) + 1e-6
                total -= own
        return total / 40

    _, grads = net._window(before, ids, classes, h0, 0)
    for k in net.p:
        for at in {tuple(0 for _ in net.p[k].shape), tuple(min(1, s - 1) for s in net.p[k].shape)}:
            old, wide = net.p[k][at], 1e-6
            net.p[k][at] = old + wide
            up = loss()
            net.p[k][at] = old - wide
            down = loss()
            net.p[k][at] = old
            assert (up - down) / 2 / wide == pytest.approx(grads[k][at], rel=1e-3, abs=1e-5), (k, at)
    docs = [np.stack([i, c], axis=1) for i, c in zip(ids, classes, strict=True)]
    h0 = np.zeros((2, 5))
    assert net.score(docs, lex, window=3).sum() == pytest.approx(-loss() * 40, rel=1e-4)
