"""Quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.common import with_new
from linkwright.plans.runtime import stash

__all__ = ["encode_passages", "GatedAttention", "fit_quality", "quality_documents"]

PASSAGE = 512  # bytes
_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"'\"", b"()[]{}", b"<>", b"|", b"#", b"$", b"%", b"&", b"*", b"@", b"=+-_/\\:;~^`")
N_CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, N_CLASSES - 2, np.int64)
_CLASS[128:] = N_CLASSES - 1
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
#: Shares of each class, of each class pair, then distinct words, repeated lines, mean word length, length.
N_FEATURES = N_CLASSES + N_CLASSES**2 + 4


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(features, passages per text)``: every passage of every text; an empty text is one empty passage."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    counts = np.array([max(1, -(-len(d) // PASSAGE)) for d in data], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((starts[-1], N_FEATURES), np.float32)
    at = 0
    while at < len(data):  # a few MB at once
        end, size = at, 0
        while end < len(data) and (end == at or size + len(data[end]) < 1 << 21):
            size += len(data[end])
            end += 1
        joined = np.frombuffer(b"".join(data[at:end]), np.uint8)
        lengths = np.array([len(d) for d in data[at:end]], np.int64)
        offset = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        first, n = starts[at], int(starts[end] - starts[at])
        passage = np.repeat(starts[at:end] - first, lengths) + offset // PASSAGE
        kind = _CLASS[joined]
        single = np.bincount(passage * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, -1)
        same = passage[1:] == passage[:-1]
        pairs = np.bincount(passage[1:][same] * N_CLASSES**2 + kind[:-1][same] * N_CLASSES + kind[1:][same], minlength=n * N_CLASSES**2).reshape(n, -1)
        total = np.maximum(1, single.sum(axis=1, keepdims=True))
        part = out[first : first + n]
        part[:, :N_CLASSES] = np.sqrt(single / total)
        part[:, N_CLASSES:-4] = np.sqrt(pairs / total)
        part[:, -1] = np.log1p(single.sum(axis=1)) / np.log(PASSAGE)
        at = end
    for i, d in enumerate(data):
        lines = [x for x in d.split(b"\n") if x]
        repeated = 1.0 - len(set(lines)) / len(lines) if lines else 0.0
        for j in range(counts[i]):
            words = d[j * PASSAGE : (j + 1) * PASSAGE].split()
            row = out[starts[i] + j]
            if words:
                row[-4] = len(set(words)) / len(words)
                row[-2] = min(2.0, (len(d[j * PASSAGE : (j + 1) * PASSAGE]) / len(words)) / 8.0)
            row[-3] = repeated
    return out, counts


@dataclass
class GatedAttention:
    """``h = relu(x W + b)``; weights ``softmax(w (tanh(h V) * sigmoid(h U)))`` over a text's passages; logistic on the weighted sum."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def start(cls, x: np.ndarray, hidden: int, attention: int, seed: int) -> GatedAttention:
        r = np.random.default_rng(seed)
        d = x.shape[1]
        g = lambda a, b: r.normal(0, np.sqrt(1.0 / a), (a, b))
        p = {"W": g(d, hidden), "b": np.zeros(hidden), "V": g(hidden, attention), "U": g(hidden, attention), "w": g(attention, 1)[:, 0], "c": np.zeros(hidden), "d": np.zeros(1)}
        return cls(p, x.mean(axis=0), np.maximum(x.std(axis=0), 0.02))

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        starts = np.cumsum(counts) - counts
        h = np.maximum(0, x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        a = (t * s) @ p["w"]
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), counts))
        alpha = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "alpha": alpha, "z": z, "y": y, "starts": starts}

    def gradients(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, f = self.p, self.forward(x, counts)
        n = len(label)
        loss = -np.mean(label * np.log(f["y"] + 1e-12) + (1 - label) * np.log(1 - f["y"] + 1e-12))
        dy = (f["y"] - label) / n
        dz = np.repeat(dy[:, None] * p["c"], counts, axis=0)
        dalpha = (dz * f["h"]).sum(axis=1)
        inner = np.repeat(np.add.reduceat(f["alpha"] * dalpha, f["starts"]), counts)
        da = f["alpha"] * (dalpha - inner)
        dt = da[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = da[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (dz * f["alpha"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (f["h"] > 0)
        return loss, {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def train(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, epochs: int, batch: int, rate: float, decay: float, seed: int) -> None:
        r = np.random.default_rng(seed)
        starts = np.cumsum(counts) - counts
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for some in np.array_split(r.permutation(len(label)), max(1, len(label) // batch)):
                rows = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in some])
                _, grads = self.gradients(x[rows], counts[some], label[some])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k] * (k in "WVUc")
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def fit_quality(docs: DataFrame, labelled: DataFrame, max_docs: int = 4_000, max_passages: int = 120_000, hidden: int = 16, attention: int = 8, steps: int = 400, seed: int = 5) -> GatedAttention | None:
    """Learn from ``labelled`` (``doc_id, label`` 0/1) over ``docs``; None without any labelled text.

    Bounds: the ``max_docs`` labelled documents with the least hash of the id, in that order as
    far as ``max_passages`` passages in all, none of more than an eighth of these; their
    passage encodings are gathered on the driver (about 1 kB a passage).
    """
    per_id = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = per_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    # at most max_docs ids: bounded, whatever the table
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    texts = texts.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE)))
    texts = stash(texts.where(F.col("_n") <= max_passages // 8).withColumn("_k", F.xxhash64("doc_id")))
    # at most as many rows as documents are chosen, or few more where ids repeat
    sums = texts.groupBy("_k", "doc_id").agg(F.sum("_n").alias("_n")).withColumn("_c", F.sum("_n").over(Window.orderBy("_k", "doc_id")))
    texts = texts.join(sums.where(F.col("_c") <= max_passages).select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "label")

    def encoded(batches):
        for pdf in batches:
            x, counts = encode_passages(list(pdf["text"]))
            cuts = np.cumsum(counts)[:-1]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype(str), "label": pdf["label"].astype("int32"), "n": counts, "x": [p.astype(np.float16).tobytes() for p in np.split(x, cuts)]})

    rows = texts.mapInPandas(encoded, "doc_id string, label int, n long, x binary").toPandas().sort_values(["doc_id", "x"])
    if not len(rows):
        return None
    counts, label = rows["n"].to_numpy(np.int64), rows["label"].to_numpy(float)
    x = np.frombuffer(b"".join(rows["x"]), np.float16).reshape(-1, N_FEATURES).astype(np.float32)
    model = GatedAttention.start(x, hidden, attention, seed)
    batch = 64
    model.train(x, counts, label, max(2, -(-steps // max(1, len(label) // batch))), batch, 0.01, 1e-4, seed)
    return model


def score_quality(docs: DataFrame, model: GatedAttention | None) -> Column:
    """The probability of label 1 of every text, from all its passages."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        if sent.value is None:
            return pd.Series([0.5] * len(texts))
        out = []
        items, at = list(texts), 0
        while at < len(items):  # some MB of text at once
            end, size = at, 0
            while end < len(items) and (end == at or size + len(items[end] or "") < 1 << 21):
                size += len(items[end] or "")
                end += 1
            out.append(sent.value.forward(*encode_passages(items[at:end]))["y"])
            at = end
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return udf(F.col("text"))


def quality_documents(docs: DataFrame, labelled: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` added (replacing columns so named).

    A null or empty text is one empty passage; rows that repeat are scored each; without
    labels everything scores 0.5, and with one label only all texts lean to that one.
    """
    model = fit_quality(docs, labelled, **fit)
    scored = docs.select(F.struct("*").alias("row"), score_quality(docs, model).alias("s"))
    return with_new(scored, docs.columns, {"score": F.col("s"), "predicted": (F.col("s") >= threshold).cast("int")})
