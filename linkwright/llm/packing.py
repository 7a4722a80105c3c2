"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

import bisect
from collections import deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.common import n_words
from linkwright.plans.runtime import stash

#: About as many rows of one size are ranked in one task, were all of that size.
ROWS_PER_SALT = 50_000

__all__ = ["PackingPlan", "plan_packing", "pack_documents", "default_cost"]


def default_cost(length: int) -> float:
    """Cost of one sequence: its tokens, a fixed part, and attention that grows with the square."""
    return 64.0 + length + length * length / 16384.0


@dataclass
class PackingPlan:
    """Which bin takes the i-th piece of each size: rows sorted by (size, first rank)."""

    size: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    per_bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    #: Runs of bins alike: first bin, permitted length after downsizing, tokens in it.
    run_bin: list[int] = field(default_factory=list)
    run_length: list[int] = field(default_factory=list)
    run_fill: list[int] = field(default_factory=list)
    n_bins: int = 0


def plan_packing(histogram: dict[int, int], lengths: tuple[int, ...] = (512, 1024, 2048, 4096), cost=default_cost) -> PackingPlan:
    """Best-fit decreasing on the histogram of sizes: pieces of one size are interchangeable,
    and so are bins with the same room, so whole runs move at once. The work and the plan
    depend on the largest length only, never on the number of documents.

    A piece goes to the open bin with the least room that holds it, of several with the same
    room to the one that has had it longest. If none does, the bin
    size is opened whose cost per token it can expect to hold is least: the pieces of this
    size that fit, topped up from the smaller pieces still waiting. At the end each bin
    shrinks to the smallest permitted length that holds its contents.
    """
    lengths = tuple(sorted(set(lengths)))
    top = lengths[-1]
    if histogram and not (0 < min(histogram) and max(histogram) <= top):
        raise ValueError("sizes must be between 1 and the largest permitted length")
    waiting = np.zeros(top + 1)
    for s, n in histogram.items():
        waiting[s] = s * n
    below = np.concatenate([[0.0], np.cumsum(waiting)])  # below[s]: tokens in pieces smaller than s
    plan = PackingPlan()
    rooms: list[int] = []  # distinct rooms with open bins, ascending
    runs: dict[int, deque] = {}  # room -> (first bin, bins, tokens in each)
    closed: list[tuple[int, int]] = []

    def put(room: int, run: tuple[int, int, int], front: bool = False) -> None:
        if room == 0:
            closed.append((run[0], run[2]))
            return
        if room not in runs:
            runs[room] = deque()
            bisect.insort(rooms, room)
        if front:
            runs[room].appendleft(run)
        else:
            runs[room].append(run)

    def take(s: int, rank: int, run: tuple[int, int, int], room: int, left: int) -> int:
        """Fill the run's bins one behind the other; how many pieces went in."""
        start, bins, fill = run
        q = room // s
        full, rest = divmod(min(left, q * bins), q)
        n = full * q + rest
        plan.size.append(s)
        plan.first.append(rank)
        plan.bin.append(start)
        plan.per_bin.append(q)
        plan.offset.append(fill)
        if full:
            put(room - q * s, (start, full, fill + q * s))
        if rest:
            put(room - rest * s, (start + full, 1, fill + rest * s))
        if untouched := bins - full - bool(rest):
            put(room, (start + full + bool(rest), untouched, fill), front=True)
        return n

    for s in sorted(histogram, reverse=True):
        left, rank = int(histogram[s]), 0
        while left:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                run = runs[room].popleft()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(i)
            else:
                best = None
                for length in lengths:
                    if length < s:
                        continue
                    own = min(left, length // s)
                    spare = length - own * s
                    bins = -(-left // (length // s))
                    held = own * s + min(spare, below[min(spare + 1, s)] / bins)
                    if best is None or cost(length) / held < best[0]:
                        best = (cost(length) / held, length, bins)
                _, room, bins = best
                run = (plan.n_bins, bins, 0)
                plan.n_bins += bins
            n = take(s, rank, run, room, left)
            left, rank = left - n, rank + n
    # bins of a run still share a fill; a bin's run is found by its first bin
    ends = [(start, fill) for start, fill in closed]
    for waiting_runs in runs.values():
        ends += [(start, fill) for start, _, fill in waiting_runs]
    for start, fill in sorted(ends):
        plan.run_bin.append(start)
        plan.run_fill.append(fill)
        plan.run_length.append(lengths[bisect.bisect_left(lengths, fill)])
    order = sorted(range(len(plan.size)), key=lambda k: (plan.size[k], plan.first[k]))
    for name in ("size", "first", "bin", "per_bin", "offset"):
        values = getattr(plan, name)
        setattr(plan, name, [values[k] for k in order])
    return plan


def pack_documents(
    docs: DataFrame,
    lengths: tuple[int, ...] = (512, 1024, 2048, 4096),
    cost=default_cost,
    salts: int = 64,
) -> DataFrame:
    """Pack the words of ``docs`` (``doc_id``, ``text``) into sequences of the permitted lengths.

    A text longer than the largest length is cut into pieces of that length and a rest.
    One row per piece: ``doc_id, piece, first_word, n_words, bin_id, bin_offset, seq_len,
    bin_words``. Two passes over sizes only: the histogram (at most as many rows as the
    largest length) goes to the driver and is planned there; then each piece finds its rank
    among the pieces of its size (counted in ``salts`` parts, more on large tables, so a common size is not one
    task) and looks up its bin in the plan, whose size the largest length bounds.

    An empty or null text gives one row without a bin. Rows that repeat are packed each;
    an empty table gives no rows.
    """
    top = max(lengths)
    sizes = stash(docs.select("doc_id", n_words("text").alias("words")))  # the texts are read once
    salts = max(salts, -(-sizes.count() // ROWS_PER_SALT))
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("words") / top) - 1, F.lit(0).cast("long")))))
    pieces = pieces.select(
        "doc_id",
        "piece",
        (F.col("piece") * top).alias("first_word"),
        F.least(F.lit(top), F.col("words") - F.col("piece") * top).cast("int").alias("n_words"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int").alias("_salt"),
    )
    counts = pieces.groupBy("n_words", "_salt").agg(F.count("*").alias("n"))
    histogram = {r["n_words"]: r["n"] for r in counts.where("n_words > 0").groupBy("n_words").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, lengths, cost)
    offsets = counts.withColumn("_off", F.sum("n").over(Window.partitionBy("n_words").orderBy("_salt")) - F.col("n")).select(
        F.col("n_words").alias("_n"), F.col("_salt").alias("_s"), "_off"
    )
    local = F.row_number().over(Window.partitionBy("n_words", "_salt").orderBy("doc_id", "piece"))
    ranked = (
        pieces.withColumn("_in", local)
        .join(offsets, (F.col("n_words") == F.col("_n")) & (F.col("_salt") == F.col("_s")))
        .withColumn("rank", F.col("_off") + F.col("_in") - 1)
    ).select("doc_id", "piece", "first_word", "n_words", "rank")
    arrays = {k: np.asarray(getattr(plan, k), dtype=np.int64) for k in ("size", "first", "bin", "per_bin", "offset", "run_bin", "run_length", "run_fill")}
    sent = docs.sparkSession.sparkContext.broadcast(arrays)

    def place(batches):
        p = sent.value
        step = int(p["first"].max()) + 2 if len(p["first"]) else 1
        keys = p["size"] * step + p["first"]
        for pdf in batches:
            n, rank = pdf["n_words"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            some = n > 0
            at = np.clip(np.searchsorted(keys, n * step + np.minimum(rank, step - 1), side="right") - 1, 0, None)
            out = pdf[["doc_id", "piece", "first_word", "n_words"]].copy()
            if len(keys):
                i = rank - p["first"][at]
                bins = p["bin"][at] + i // p["per_bin"][at]
                run = np.clip(np.searchsorted(p["run_bin"], bins, side="right") - 1, 0, None)
                columns = {"bin_id": bins, "bin_offset": p["offset"][at] + i % p["per_bin"][at] * n, "seq_len": p["run_length"][run], "bin_words": p["run_fill"][run]}
            else:
                columns = dict.fromkeys(("bin_id", "bin_offset", "seq_len", "bin_words"), np.zeros(len(n), np.int64))
            for name, values in columns.items():
                out[name] = values
                out[name] = out[name].astype("Int64").where(some)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece long, first_word long, n_words int, bin_id long, bin_offset long, seq_len long, bin_words long")
