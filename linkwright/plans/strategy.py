"""Strategies: what to match on, declared once and applied by the verbs."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from linkwright.functions import Step, normalize_text, word_tokens

__all__ = [
    "BlockOnTokens", "EmbeddingStrategy", "ExactStrategy", "ExecutionControl", "SearchStrategy", "Smoothing",
    "block_on_tokens", "smooth_rip_identity", "smooth_rip_log", "smooth_rip_offset", "smooth_rip_softmax",
]

RARITIES = ("inverse_freq", "smoothed_inverse_freq", "tfidf", "bm25")


@dataclass(frozen=True)
class Smoothing:
    method: str = "identity"
    alpha: float = 0.5
    temperature: float = 1.0

    def __post_init__(self):
        if self.method not in ("identity", "log", "offset", "softmax"):
            raise ValueError(f"unknown smoothing {self.method!r}")
        if self.alpha < 0 or self.temperature <= 0:
            raise ValueError("alpha must not be negative and temperature must be positive")


def smooth_rip_identity() -> Smoothing:
    return Smoothing()


def smooth_rip_log() -> Smoothing:
    return Smoothing("log")


def smooth_rip_offset(alpha: float = 0.5) -> Smoothing:
    return Smoothing("offset", alpha=alpha)


def smooth_rip_softmax(temperature: float = 1.0) -> Smoothing:
    return Smoothing("softmax", temperature=temperature)


@dataclass(frozen=True)
class BlockOnTokens:
    """Records share a block if they share a token of ``column`` that at most ``max_df`` records have."""

    column: str
    max_df: float = math.inf
    min_rarity: float = 0.0
    preparer: tuple[Step, ...] | None = None
    min_nchar: int = 3

    def __post_init__(self):
        if self.max_df < 1 or self.min_rarity < 0 or self.min_nchar < 1:
            raise ValueError("max_df and min_nchar must be at least 1, min_rarity at least 0")


def block_on_tokens(column: str, max_df: float = math.inf, min_rarity: float = 0.0, preparer=None, min_nchar: int = 3) -> BlockOnTokens:
    if math.isinf(max_df) and min_rarity == 0:
        import warnings

        warnings.warn("token blocks without max_df or min_rarity include the most common tokens", stacklevel=2)
    return BlockOnTokens(column, max_df, min_rarity, tuple(preparer) if preparer else None, min_nchar)


def _blocks(block_by) -> tuple:
    if block_by is None:
        return ()
    out = (block_by,) if isinstance(block_by, str | BlockOnTokens) else tuple(block_by)
    if bad := [b for b in out if not isinstance(b, str | BlockOnTokens)]:
        raise TypeError(f"blocks are column names or block_on_tokens(), not {bad}")
    return out


def _preparers(columns) -> dict[str, tuple[Step, ...]]:
    out = {}
    for column, steps in dict(columns).items():
        steps = (steps,) if isinstance(steps, Step) else tuple(steps)
        if bad := [s for s in steps if not isinstance(s, Step)]:
            raise TypeError(f"column {column!r}: not steps: {bad}")
        out[column] = steps
    if not out:
        raise ValueError("a strategy needs at least one column")
    return out


@dataclass(frozen=True)
class SearchStrategy:
    """Rarity-weighted token overlap. ``columns`` maps each column to its chain of steps."""

    columns: dict[str, tuple[Step, ...]]
    block_by: tuple = ()
    weights: dict[str, float] = field(default_factory=dict)
    rarity: str = "inverse_freq"
    rarity_scope: str = "block"
    min_rarity: float = 0.0
    max_token_df: float = math.inf
    threshold: float = 0.9
    smoothing: Smoothing = Smoothing()
    max_candidates: float = math.inf
    max_fanout: float = 5e7
    on_fanout: str = "cap"
    feedback_strength: float = 0.0
    on_missing: str = "penalise"

    def __post_init__(self):
        object.__setattr__(self, "columns", _preparers(self.columns))
        object.__setattr__(self, "block_by", _blocks(self.block_by))
        checks = [
            (self.rarity in RARITIES, f"rarity must be one of {RARITIES}"),
            (self.rarity_scope in ("block", "global"), "rarity_scope must be block or global"),
            (self.on_fanout in ("cap", "abort", "off"), "on_fanout must be cap, abort or off"),
            (self.on_missing in ("penalise", "renormalise"), "on_missing must be penalise or renormalise"),
            (self.min_rarity >= 0, "min_rarity must not be negative"),
            (self.max_token_df >= 1 and self.max_candidates >= 1 and self.max_fanout > 0, "max_token_df and max_candidates must be at least 1, max_fanout positive"),
            (0 <= self.feedback_strength <= 1, "feedback_strength must be between 0 and 1"),
            (self.threshold >= 0, "threshold must not be negative"),
            (all(w >= 0 for w in self.weights.values()), "weights must not be negative"),
        ]
        for ok, message in checks:
            if not ok:
                raise ValueError(message)
        if unknown := set(self.weights) - set(self.columns):
            raise ValueError(f"weights for unknown columns {sorted(unknown)}")
        if self.weights and (missing := set(self.columns) - set(self.weights)):
            raise ValueError(f"no weight for {sorted(missing)}")

    def weight_of(self) -> dict[str, float]:
        return dict(self.weights) if self.weights else {c: 1.0 / len(self.columns) for c in self.columns}

    @property
    def plain_blocks(self) -> tuple[str, ...]:
        return tuple(b for b in self.block_by if isinstance(b, str))

    @property
    def token_blocks(self) -> tuple[BlockOnTokens, ...]:
        return tuple(b for b in self.block_by if not isinstance(b, str))

    def with_(self, **changes) -> SearchStrategy:
        return replace(self, **changes)

    def describe(self) -> str:
        w = self.weight_of()
        lines = [f"{c} (weight {w[c]:.3g}): {' + '.join(s.describe() for s in steps) or 'as it is'}" for c, steps in self.columns.items()]
        blocks = ", ".join(b if isinstance(b, str) else f"tokens of {b.column} (df <= {b.max_df:g})" for b in self.block_by)
        lines += [f"blocks: {blocks or 'none'}", f"rarity: {self.rarity} ({self.rarity_scope}), smoothing {self.smoothing.method}", f"threshold: {self.threshold:g}"]
        return "\n".join(lines)


@dataclass(frozen=True)
class ExactStrategy:
    """Equal token sets; with ``containment`` also sets that lie in one another."""

    columns: dict[str, tuple[Step, ...]]
    block_by: tuple[str, ...] = ()
    rarity: str = "inverse_freq"
    containment: str = "off"
    min_base_rarity: float = 0.0
    min_containment_tokens: int | dict[str, int] = 1

    def __post_init__(self):
        object.__setattr__(self, "columns", _preparers(self.columns))
        object.__setattr__(self, "block_by", _blocks(self.block_by))
        if any(not isinstance(b, str) for b in self.block_by):
            raise ValueError("exact strategies take plain block columns only")
        if self.containment not in ("off", "forward", "bidirectional"):
            raise ValueError("containment must be off, forward or bidirectional")
        if self.rarity not in RARITIES or self.min_base_rarity < 0:
            raise ValueError("unknown rarity, or negative min_base_rarity")

    def proxy(self) -> SearchStrategy:
        """The token engine's view: same columns and blocks, no thresholds."""
        return SearchStrategy(self.columns, self.block_by, rarity=self.rarity, threshold=0.0, on_fanout="off")

    def least_tokens(self) -> dict[str, int]:
        m = self.min_containment_tokens
        return {c: m.get(c, 1) if isinstance(m, dict) else int(m) for c in self.columns}


@dataclass(frozen=True)
class EmbeddingStrategy:
    """Cosine of text embeddings. ``embedding_model`` is a callable from texts to vectors, or the name of a vector column."""

    embedding_model: Callable | str
    columns: tuple[str, ...] | None = None
    threshold: float = 0.8
    collapse_sep: str = " "
    normalize: bool = True
    batch_size: int = 1000
    block_by: tuple[str, ...] = ()
    block_rows: int = 4096

    def __post_init__(self):
        object.__setattr__(self, "block_by", _blocks(self.block_by))
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be between 0 and 1")
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")


@dataclass(frozen=True)
class ExecutionControl:
    """How to run, apart from what: ``chunk_by`` runs one block value group at a time, isolating failures."""

    chunk_by: str | None = None
    chunks: int = 8
    on_error: str = "stop"
    retries: int = 1

    def __post_init__(self):
        if self.on_error not in ("skip", "retry", "stop"):
            raise ValueError("on_error must be skip, retry or stop")


#: The steps most columns start with.
DEFAULT_STEPS = (normalize_text(), word_tokens(min_nchar=3))
