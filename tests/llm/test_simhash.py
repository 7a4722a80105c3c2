import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from linkwright.llm import simhash as sh
from tests.llm.conftest import ODD


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids_fps, bits=3):
    parent = list(range(len(ids_fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids_fps)):
        for j in range(i):
            if (ids_fps[i][1] ^ ids_fps[j][1]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(ids_fps):
        r = find(i)
        least[r] = doc if least.get(r) is None else least[r] if doc is None else min(least[r], doc)
    return sorted((str(doc), least[find(i)]) for i, (doc, _) in enumerate(ids_fps))


def test_fingerprint():
    for t in ODD:
        assert sh.fingerprint(t) == plain_fingerprint(t)
    assert sh.fingerprint("Ä B c d") == plain_fingerprint("Ä b C d")


def test_components_against_all_pairs(make):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefgh") * r.randrange(1, 5) for _ in range(80)) for _ in range(12)]
    texts = list(ODD)
    for b in base:
        texts.append(b)
        for _ in range(4):
            w = b.split()
            w[r.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
        texts.append(b)
    df = make(texts).unionByName(make(["one two three four"], ids=[None]))
    want = components([(i, plain_fingerprint(t)) for i, t in enumerate(texts)] + [(None, plain_fingerprint("one two three four"))])
    got = sorted((str(x["doc_id"]), x["component_id"]) for x in sh.simhash_components(df).collect())
    assert got == want
    kept = sh.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({c for _, c in want})
    assert sh.simhash_components(df.limit(0)).count() == 0 and sh.drop_near_duplicates(df.limit(0)).count() == 0
    same = make(["a b c d", "a b c d"], ids=[5, 5])
    assert sh.drop_near_duplicates(same).count() == 1
    two = make(["a b c d", "quite another text of its own"], ids=[5, 5])
    assert sh.drop_near_duplicates(two).count() == 2


def test_hot_buckets_are_refiled_without_losing_links(spark):
    """A small bucket limit forces every round of refiling."""
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(4)]
    fps = {s ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 4))) for s in seeds for _ in range(40)} | {0, (1 << 64) - 1}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {}
    for doc, root in components([(f, int(np.int64(f).astype(np.uint64))) for f in signed]):
        want[int(doc)] = root
    from linkwright.operators.graph import connected_components

    for limit in (8, 4096):
        links = sh.simhash_links(df, bucket=limit)
        got = {x["node"]: x["component"] for x in connected_components(links).collect()}
        assert {f: got.get(f, f) for f in signed} == want, limit
    assert links.select(F.count("*")).first()[0] < 20 * len(fps)


def test_columns_of_any_name_keep_their_values(spark):
    names = ["_h", "_t", "_n", "_d", "_r", "row", "fp", "rep", "component", "n"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b c d e", "a b c d e", "quite another text", None])]
    rows.append((1, "a b c d e", *[f"{n}9" for n in names]))  # equal in id and text
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = sh.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]
    twice = df.where("doc_id = 1")
    assert list(map(tuple, sh.drop_near_duplicates(twice).collect())) == [rows[1]]
