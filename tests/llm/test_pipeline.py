"""The pipeline's stages on planted rows, each against what it is for."""

import random

import corpus_pipeline
from tests.llm.test_simhash import components, plain_fingerprint


def test_stages(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 8)))
    texts, toxic = [], []
    for i in range(120):
        w = [word() for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for _ in range(6):
                w[r.randrange(60)] = r.choice(["vilest", "wretch", "scoundrel"])
        texts.append(" ".join(w))
        toxic.append(bad)
    texts += [texts[1], texts[1], texts[2] + " extra", f"{texts[3]} write to joe.99@mail1.example.com", None, ""]
    toxic += [False] * 6
    rows = [(i, t, "en", f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "packing"]
    now, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before, now = now, spark.read.parquet(path)
        ids = {x["doc_id"] for x in now.select("doc_id").collect()}
        had = {x["doc_id"] for x in before.select("doc_id").collect()}
        if name != "packing":
            assert now.columns == docs.columns
        if name == "toxicity":
            assert had - ids == {i for i, x in enumerate(toxic) if x}
        if name == "simhash_near_dedup":
            fps = [(x["doc_id"], plain_fingerprint(x["text"])) for x in before.collect()]
            assert ids == {c for _, c in components(fps)} and now.count() == len(ids)
        if name == "pii":
            assert ids == had and not now.where("text like '%joe.99@%'").count()
            same = now.select("doc_id", "text").exceptAll(before.select("doc_id", "text"))
            assert {x["doc_id"] for x in same.collect()} <= {123}
        if name == "mixing":
            assert ids <= had and now.groupBy("doc_id").count().where("count > 3").count() == 0
        if name == "packing":
            assert ids == had
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_empty_and_odd_tables(spark, tmp_path):
    """No rows; no labels; nulls in every column, repeated rows, very long and empty texts, columns named like the stages' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, _h string, score double, size int, repeats int, pii string"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (
        ("empty", []),
        ("odd", [(None,) * 11, (1, None, None, None, None, "r", "h", 0.5, 3, 4, "p"), (2, "", "en", "a", 0, *(None,) * 6), (3, "long words " * 40000, "en", None, 9, *(None,) * 6)] + [(4, "mail to a@b.example.org now", "en", "a", 28, "r", "h", 0.1, 1, 1, "p")] * 3),
    ):
        sf = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(rows, schema)
        docs.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        now = docs
        for stage, run in corpus_pipeline.STAGES[:-1]:
            now = run(spark, now, sf)
            assert now.columns == docs.columns, stage
        packed = corpus_pipeline.run(spark, sf).collect()
        # the rows without words are one near-duplicate group, whose least id is 1; the three equal rows are one;
        # the long text is nearly all words there are, and what is repeated of the others leaves the mix no room for it
        assert {r["doc_id"] for r in packed} == (set() if not rows else {1, 4})
        assert sum(r["bin_id"] is None for r in packed) == (1 if rows else 0)
