"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.common import with_new
from linkwright.plans.runtime import free, stash

__all__ = ["text_terms", "BlockMaxIndex", "ToxicityModel", "fit_toxicity", "score_toxicity", "toxicity_documents"]

_SPACED = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or i < 32 else i for i in range(256))


def _spaced(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_SPACED) if text else b""


def text_terms(text: str | None) -> list[bytes]:
    """The text's words, repeats included: lower case, UTF-8, ASCII punctuation and controls taken as blanks."""
    return _spaced(text).split()


def text_pieces(texts: list, most: int = 2048, size: int = 1 << 23):
    """Runs of at most ``most`` texts and some MB, as lists; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        n = len(t or "")
        if run and (len(run) == most or held + n > size):
            yield run
            run, held = [], 0
        run.append(t)
        held += n
    if run:
        yield run


def count_terms(texts: list, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary's terms of each text, ascending, one text behind the other, how often each occurs, and where each text starts.

    The texts' words are told apart together, so that each is looked up once.
    """
    lists = pc.ascii_split_whitespace(pa.array([_spaced(t) for t in texts], pa.large_string()))
    words = lists.flatten().cast(pa.large_binary()).dictionary_encode()
    # blanks that begin or end a text give an empty word, which no vocabulary holds
    ids = pc.index_in(words.dictionary, value_set=vocabulary).fill_null(-1).to_numpy().astype(np.int64)[words.indices.to_numpy()]
    known = ids >= 0
    ids = (ids + np.repeat(np.arange(len(texts)) << 32, np.diff(lists.offsets.to_numpy())))[known]
    del lists, words
    pa.default_memory_pool().release_unused()
    ids.sort()
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    own = ids[first]
    return own & 0xFFFFFFFF, np.diff(first, append=len(ids)), np.searchsorted(own, np.arange(len(texts)) << 32)


def pieces(sizes: np.ndarray, step: int = 1024):
    """Runs of vectors that lie one behind the other: first, last, where they lie, where each starts in there, their sizes.

    What is computed for all examples goes through in such runs, so that it takes little room. No vector may be empty.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(sizes), step):
        b = min(len(sizes), a + step)
        yield a, b, slice(int(ends[a]), int(ends[b])), ends[a:b] - ends[a], sizes[a:b]


def runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each ``first`` to before its ``last``, one run behind the other, and the runs' sizes."""
    sizes = last - first
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes), sizes


class BlockMaxIndex:
    """Examples in blocks; postings of most terms, the commonest terms as columns.

    A query's postings and its product with the columns are first summed in short floats,
    whose error is bounded. The best sum in each block then tells which blocks can hold one of
    the k best at all; only these are looked into, and what is left within the error of the
    k-th is summed again in full, so the k scores are exact. Ties (to 12 digits) go to the
    smaller example.
    """

    #: A column's product has at most ``COMMON`` terms of unit vectors: the error of short floats stays below this.
    COMMON, ERROR, BATCH = 512, 1e-4, 256

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, block: int = 64, common: int = COMMON):
        sizes = np.array([len(v) for v in vectors], np.int64)
        terms = np.fromiter((t for v in vectors for t in v), np.int64, int(sizes.sum()))
        weights = np.fromiter((w for v in vectors for w in v.values()), np.float64, len(terms))
        self._build(sizes, terms, weights, n_terms, block, common)

    @classmethod
    def of_arrays(cls, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = 64, common: int = COMMON) -> BlockMaxIndex:
        """From the vectors' lengths and their terms and weights, one vector behind the other."""
        index = cls.__new__(cls)
        index._build(sizes, terms, weights, n_terms, block, common)
        return index

    def _build(self, sizes, terms, weights, n_terms, block, common) -> None:
        n = len(sizes)
        self.n, self.block, self.n_blocks, self.n_terms = n, block, -(-n // block), n_terms
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.weights = terms.astype(np.int32), weights
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        # Examples whose heaviest term is the same share blocks, so that few blocks hold a query's best.
        heavy = np.full(n, -1, np.int32)
        for first, last, at, starts, own in pieces(sizes):
            w = weights[at]
            top = np.nonzero(w == np.repeat(np.maximum.reduceat(w, starts), own))[0][::-1]
            heavy[first + np.searchsorted(starts, top, side="right") - 1] = terms[at][top]
        self.order = np.lexsort((np.arange(n), heavy))
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        counts = np.bincount(terms, minlength=n_terms)
        often = np.argsort(-counts, kind="stable")[:common]
        often = often[counts[often] > max(block, n // 64)]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        dense = self.column[terms] >= 0
        self.columns = np.zeros((len(often), self.n_blocks * block), np.float32)
        self.columns[self.column[terms[dense]], place[owner[dense]]] = weights[dense]
        rest = np.nonzero(~dense)[0]
        rest = rest[np.argsort(terms[rest], kind="stable")]
        # place and weight (a short float's bits) side by side, so that a posting is fetched at once
        self.postings = np.empty((len(rest), 2), np.int32)
        self.postings[:, 0], self.postings[:, 1] = place[owner[rest]], weights[rest].astype(np.float32).view(np.int32)
        self.starts = np.searchsorted(terms[rest], np.arange(n_terms + 1))

    def top(self, query: dict[int, float], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """Up to k ``(cosine, example)`` with a positive cosine, best first; never example ``skip``."""
        one = np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query))
        ((scores, ids),) = self.best([one], k, [skip])
        return list(zip(scores.tolist(), ids.tolist(), strict=True))

    def best(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms and weights) the cosines and examples of its k best."""
        out = []
        for a in range(0, len(queries), self.BATCH):
            some = queries[a : a + self.BATCH]
            usual = np.zeros((len(some), len(self.columns)), np.float32)
            for row, (terms, q) in zip(usual, some, strict=True):
                column = self.column[terms]
                row[column[column >= 0]] = q[column >= 0]
            sums = usual @ self.columns
            for i, (terms, q) in enumerate(some):
                out.append(self._one(terms, q, sums[i], k, -1 if skip is None else skip[a + i]))
        return out

    def _one(self, terms: np.ndarray, q: np.ndarray, sums: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(terms) or not self.n:
            return np.zeros(0), np.zeros(0, np.int64)
        rare = self.column[terms] < 0
        first, last = self.starts[terms[rare]], self.starts[terms[rare] + 1]
        some = last > first
        first, last, weight = first[some], last[some], q[rare][some]
        if len(first):
            at, sizes = runs(first, last)
            found = self.postings.view(np.int64)[at].view(np.int32)
            short = found[:, 1].view(np.float32) * np.repeat(weight.astype(np.float32), sizes)
            sums = sums + np.bincount(found[:, 0], short, len(sums)).astype(np.float32)
        blocks = sums.reshape(self.n_blocks, self.block)
        most = blocks.max(axis=1)
        # one more than k, as one may be skipped
        least = np.partition(most, -k - 1)[-k - 1] if self.n_blocks > k else 0.0
        opened = np.nonzero((most >= least - self.ERROR) & (most > 0))[0]
        inside = blocks[opened].ravel()
        near = np.partition(inside, -k - 1)[-k - 1] if len(inside) > k else 0.0
        found = np.nonzero((inside >= near - self.ERROR) & (inside > 0))[0]
        ids = self.order[opened[found // self.block] * self.block + found % self.block]
        ids = ids[ids != skip]
        scores = self._exact(terms, q, ids)
        best = np.lexsort((ids, -scores))[:k]
        best = best[scores[best] > 0]
        return scores[best], ids[best]

    def _exact(self, terms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The examples' whole cosines, to 12 digits."""
        if not len(ids):
            return np.zeros(0)
        if not hasattr(self, "query"):
            self.query = np.zeros(self.n_terms)
        self.query[terms] = q
        at, sizes = runs(self.ends[ids], self.ends[ids + 1])
        products = self.query[self.terms[at]] * self.weights[at]
        self.query[terms] = 0.0
        return np.round(np.add.reduceat(products, np.cumsum(sizes) - sizes), 12)


@dataclass
class ToxicityModel:
    """Words with their weights, the examples' terms, and calibration.

    What is sent to executors is compact (a few bytes a term of an example); each Python
    worker builds the vocabulary and the index from it once, when it first needs them.
    """

    words: bytes  # in order, a blank between two
    weight: np.ndarray
    k: int
    ids: list = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    coded: list = field(default_factory=list)  # each example's terms and counts, compressed
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))

    @functools.cached_property
    def vocabulary(self) -> pa.Array:
        words = pc.ascii_split_whitespace(pa.array([self.words] if self.words else [], pa.large_string()))
        return words.flatten().cast(pa.large_binary())

    @functools.cached_property
    def index(self) -> BlockMaxIndex:
        terms, counts = self.unpack()
        weights = np.empty(len(terms))
        for _, _, at, starts, sizes in pieces(self.sizes):
            v = (1.0 + np.log(counts[at])) * self.weight[terms[at]]
            weights[at] = v / np.repeat(np.sqrt(np.add.reduceat(v * v, starts)), sizes)
        del counts
        return BlockMaxIndex.of_arrays(self.sizes, terms, weights, max(1, len(self.weight)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("vocabulary", "index", "sent")}

    def unpack(self) -> tuple[np.ndarray, np.ndarray]:
        both = [decode_counts(x) for x in self.coded]
        none = np.zeros(0, np.int32)
        return np.concatenate([*(t for t, _ in both), none]), np.concatenate([*(c for _, c in both), none])

    def counts(self, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's terms that are in the vocabulary, ascending, and how often each occurs."""
        terms, counts, starts = count_terms(texts, self.vocabulary)
        return list(zip(np.split(terms, starts[1:]), np.split(counts, starts[1:]), strict=True))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1.0 + np.log(counts)) * self.weight[terms]
        return v / np.sqrt(v @ v) if len(v) else v

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Features of each vote: toxic share weighted by cosine, best toxic cosine, their product; and the neighbours."""
        out = []
        for scores, near in self.index.best(queries, self.k, skip):
            bad = self.toxic[near]
            share = float(scores[bad].sum() / scores.sum()) if len(near) else 0.0
            best = float(scores[bad].max()) if bad.any() else 0.0
            out.append((np.array([share, best, share * best]), near))
        return out

    def score(self, features: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-(self.calibration[0] + features @ self.calibration[1:]))))


def encode_counts(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending terms as differences, then their counts, compressed."""
    return zlib.compress(np.diff(terms, prepend=0).astype("<i4").tobytes() + counts.astype("<i4").tobytes(), 1)


def decode_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = np.split(np.frombuffer(zlib.decompress(data), "<i4"), 2)
    return np.cumsum(steps, dtype=np.int32), counts


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is free."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _examples(docs: DataFrame, labelled: DataFrame, max_examples: int, max_bytes: int) -> DataFrame:
    """``doc_id, text, label`` of the examples, equal texts once (least id, largest label); written."""
    per_id = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = per_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    # at most max_examples ids: bounded, whatever the table
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    texts = stash(texts.where(F.col("size") <= max_bytes // 8))
    sizes = texts.groupBy("doc_id").agg(F.sum("size").alias("size"))  # at most a row an example
    fits = sizes.withColumn("sum", F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("sum") <= max_bytes)
    fitting = texts.join(fits.select("doc_id"), "doc_id", "left_semi")
    out = stash(fitting.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("doc_id").alias("doc_id"), F.max("label").cast("int").alias("label")).drop("h"))
    free(texts)
    return out


def _deviance(c: np.ndarray, p: np.ndarray, rate: float) -> np.ndarray:
    """Log-likelihood ratio of ``p`` toxic among ``c`` examples against the base rate."""
    part = lambda x, e: x * np.log(np.where(x > 0, x, 1.0) / np.where(x > 0, e, 1.0))
    return np.maximum(0.0, 2 * (part(p, c * rate) + part(c - p, c * (1 - rate))))


def fit_toxicity(docs: DataFrame, labelled: DataFrame, max_examples: int = 20_000, max_bytes: int = 1 << 26, boost: float = 0.2, k: int = 15) -> ToxicityModel:
    """Learn from ``labelled`` (``doc_id, label`` 0/1) over ``docs`` (``doc_id, text``).

    Bounds: the ``max_examples`` labelled documents with the least hash of the id, in that
    order as far as ``max_bytes`` of text in all, none of more than an eighth of these.
    Equal texts are one example. The vocabulary is every word of the examples that at least
    two documents have (a word of one document links nothing). A term weighs
    ``(1 + log tf) * idf * (1 + boost * G2)``: idf from its document frequency over all of
    ``docs``, G2 the log-likelihood ratio of its examples' labels, so words that tell the
    labels apart draw neighbours and no word is left out. Calibration is logistic on
    leave-one-out votes of the examples.
    """
    texts = _examples(docs, labelled, max_examples, max_bytes)
    spark = docs.sparkSession
    totals = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    n, rate = totals["n"], (totals["pos"] / totals["n"] if totals["n"] else 0.0)

    def words(batches):
        for pdf in batches:
            seen, toxic = Counter(), Counter()
            for t, y in zip(pdf["text"], pdf["label"], strict=True):
                own = set(text_terms(t))
                seen.update(own)
                if y:
                    toxic.update(own)
            yield pd.DataFrame({"term": list(seen), "c": list(seen.values()), "p": [toxic[w] for w in seen]})

    per_term = texts.select("text", "label").mapInPandas(words, "term binary, c long, p long").groupBy("term").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    def listed(batches):  # a batch as one row: words hold no blank
        for pdf in batches:
            yield pd.DataFrame({"term": [b" ".join(map(bytes, pdf["term"]))], "c": [pdf["c"].to_numpy("<i8").tobytes()], "p": [pdf["p"].to_numpy("<i8").tobytes()]})

    # as many words as max_bytes of text can hold
    told = per_term.orderBy("term").mapInPandas(listed, "term binary, c binary, p binary").collect()
    c, p = (np.frombuffer(b"".join(bytes(r[x]) for r in told), "<i8").astype(float) for x in "cp")
    names = b" ".join(bytes(r["term"]) for r in told)
    del told
    n_names = len(c)
    sent = spark.sparkContext.broadcast(ToxicityModel(names, np.zeros(0), k))

    def frequencies(batches):
        words, count, rows = sent.value.vocabulary, np.zeros(n_names, np.int64), 0
        for pdf in batches:
            rows += len(pdf)
            for texts in text_pieces(pdf["text"]):
                np.add.at(count, count_terms(texts, words)[0], 1)
        some = np.nonzero(count)[0]
        yield pd.DataFrame({"term": np.append(some, -1), "n": np.append(count[some], rows)})

    def numbers(batches):
        for pdf in batches:
            yield pd.DataFrame({"term": [pdf["term"].to_numpy("<i8").tobytes()], "n": [pdf["n"].to_numpy("<i8").tobytes()]})

    df = docs.select("text").mapInPandas(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    in_docs = np.zeros(n_names + 1, np.int64)
    for r in df.mapInPandas(numbers, "term binary, n binary").collect():
        in_docs[np.frombuffer(bytes(r["term"]), "<i8")] = np.frombuffer(bytes(r["n"]), "<i8")
    all_docs, in_docs = int(in_docs[-1]), in_docs[:-1]
    linking = np.nonzero(in_docs >= 2)[0]
    g2 = _deviance(c, p, rate)
    weight = (np.log((1.0 + all_docs) / (1.0 + in_docs)) + 1.0) * (1.0 + boost * g2)
    model = ToxicityModel(b" ".join(w for w, x in zip(names.split(), in_docs >= 2, strict=True) if x), weight[linking], k)
    sent.destroy()
    del names
    known = spark.sparkContext.broadcast(model)

    def coded_rows(batches):
        m = known.value
        for pdf in batches:
            found = [x for texts in text_pieces(pdf["text"]) for x in m.counts(texts)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "n": [len(t) for t, _ in found], "x": [encode_counts(t, c) for t, c in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = stash(texts.mapInPandas(coded_rows, f"doc_id {kind}, label int, n int, x binary"))
    known.destroy()
    rows = coded.collect()  # the examples, a few bytes a word
    if not rows:
        model.calibration = np.array([np.log(0.01 / 0.99), 0.0, 0.0, 0.0])
        return model
    some = sorted((r for r in rows if r["n"]), key=lambda r: (r["doc_id"], bytes(r["x"])))
    model.ids, model.toxic = [r["doc_id"] for r in some], np.array([r["label"] for r in some], bool)
    model.sizes, model.coded = np.array([r["n"] for r in some], np.int64), [bytes(r["x"]) for r in some]
    del rows, some
    model.sent = known = spark.sparkContext.broadcast(model)

    def own_votes(batches):
        m = known.value
        place = {x: i for i, x in enumerate(m.ids)}
        for pdf in batches:
            queries = [(t, m.vector(t, c)) for t, c in map(decode_counts, pdf["x"])]
            f = [v for v, _ in m.votes(queries, [place.get(i, -1) for i in pdf["doc_id"]])]
            yield pd.DataFrame(np.array(f).reshape(-1, 3), columns=["a", "b", "c"]).assign(y=pdf["label"].to_numpy(float))

    votes = coded.mapInPandas(own_votes, "a double, b double, c double, y double").collect()
    votes = np.array(sorted(map(tuple, votes)), float)
    for scratch in (texts, coded):
        free(scratch)
    model.calibration = _logistic(votes[:, :3], votes[:, 3])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, evidence: int = 3) -> Column:
    """A struct ``score double, evidence array<string>``: the probability, and the ids of the nearest examples."""
    # the examples were sent for the calibration already
    sent, calibration = getattr(model, "sent", None) or docs.sparkSession.sparkContext.broadcast(model), model.calibration

    @F.pandas_udf("score double, evidence array<string>")
    def udf(texts: pd.Series) -> pd.DataFrame:
        m = sent.value
        m.calibration = calibration
        m.index  # noqa: B018  (built before there are counts, which take room beside it)
        scores, ids = [], []
        seen: dict = {}  # equal texts of a batch are scored once
        which = [seen.setdefault(t, len(seen)) for t in texts]
        for each in text_pieces(list(seen)):
            for features, near in m.votes([(t, m.vector(t, c)) for t, c in m.counts(each)]):
                scores.append(m.score(features))
                ids.append([str(m.ids[i]) for i in near[:evidence]])
        return pd.DataFrame({"score": [scores[i] for i in which], "evidence": [ids[i] for i in which]})

    return udf(F.col("text"))


def toxicity_documents(docs: DataFrame, labelled: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """``docs`` with ``score``, ``evidence`` and ``predicted`` added (replacing columns so named).

    A text that shares no word with an example, a null or empty one too, has no neighbours
    and gets the calibrated score of such examples; neighbours at the same cosine come by the
    smaller id; rows that repeat are scored each; without labels everything scores 0.01.
    """
    model = fit_toxicity(docs, labelled, **fit)
    scored = docs.select(F.struct("*").alias("row"), score_toxicity(docs, model).alias("s"))
    return with_new(scored, docs.columns, {"score": F.col("s.score"), "evidence": F.col("s.evidence"), "predicted": (F.col("s.score") >= threshold).cast("int")})
