"""Hints from diagnostic signals."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

__all__ = ["Rule", "CATALOG", "recommendations"]


@dataclass(frozen=True)
class Rule:
    """Fires if ``signal`` compares with ``threshold``; may silence another rule."""

    id: str
    signal: str
    op: str
    threshold: float
    lever: str
    message: Callable[[float, dict], str]
    suppresses: str | None = None


# What callers select rules by and when each fires (id, signal, comparison, threshold, silenced rule).
FIXED_RULES = [
    ("candidates_high_ambiguity", "pct_records_with_ge3_matches", ">", 0.10, None),
    ("candidates_weak_decisiveness", "score_top_gap_median", "<", 0.05, None),
    ("duplicates_mega_cluster", "max_cluster_size", ">=", 50, None),
    ("cluster_identical_name_street", "n_identical_entity_groups", ">=", 5, "duplicates_mega_cluster"),
    ("low_coverage_candidates", "base_coverage_candidates", "<", 0.05, None),
    ("block_imbalanced", "block_top_share", ">", 0.70, None),
    ("high_low_rarity_pressure", "max_pct_low_rarity_tokens", ">", 0.50, None),
    ("low_embedding_coverage", "coverage_rate", "<", 0.90, None),
    ("unnormalised_embeddings", "norm_iqr", ">", 0.10, None),
    ("consider_calibration_borderline", "pct_pairs_borderline", ">", 0.10, None),
    ("consider_calibration_ambiguity", "pct_records_with_ge3_matches", ">", 0.20, None),
    ("calibration_low_n_warning", "training_n", "<", 500, None),
    ("calibration_drift_warning", "stage_dist_tv_distance", ">", 0.15, None),
    ("blocking_knee", "blocking_knee_savings", ">", 0.25, None),
    ("empty_column_ceiling", "max_empty_column_rate", ">", 0.10, None),
    ("consider_containment", "containment_share", ">", 0.05, None),
    ("est_comparisons_too_high", "est_comparisons", ">", 1e9, None),
    ("low_yield_stage", "min_stage_base_pct", "<", 0.01, None),
]

#: What to try first, and the sentence; ``{v}`` is the signal's value, other names are signals too.
_ADVICE: dict[str, tuple[str, str]] = {
    "candidates_high_ambiguity": ("cut the list", "{v:.1%} of the searched records got at least three answers. Keep fewer per record, or ask for a higher score."),
    "candidates_weak_decisiveness": ("sharpen scores", "Half of the records prefer their first answer to the next by no more than {v:.3f}. Punish partial overlap, or look at a third column."),
    "duplicates_mega_cluster": ("thin tokens", "One group alone holds {v:.0f} records, most likely chained together by words that everyone uses."),
    "cluster_identical_name_street": ("clean the input", "{v:.0f} groups repeat one record word for word in {entity_cols_label}. Drop repeated lines before linking; the strategy is not at fault."),
    "low_coverage_candidates": ("widen the net", "Only {v:.1%} of the searched records found anything: steps, blocks or threshold keep the rest apart."),
    "block_imbalanced": ("split the block", "A single block holds {v:.1%} of all records, so blocking saves next to nothing."),
    "high_low_rarity_pressure": ("thin tokens", "{v:.1%} of the words in {worst_rarity_column} identify nobody (rarity under 0.01); they cost joins and add no evidence."),
    "low_embedding_coverage": ("fill in text", "No more than {v:.1%} of the records have a vector. The others have nothing to embed."),
    "unnormalised_embeddings": ("scale vectors", "Vector lengths differ by {v:.3f} between their quartiles, which bends inner products; normalise them."),
    "consider_calibration_borderline": ("learn a filter", "{v:.1%} of the rows lie within reach of the threshold, where a cut-off is a coin toss; labelled pairs would settle them."),
    "consider_calibration_ambiguity": ("learn a filter", "With {v:.1%} of the records undecided between three answers or more, a model on labelled pairs beats a cut-off."),
    "calibration_low_n_warning": ("label more", "{v:.0f} labelled pairs are few for a probability; read the estimates as ranks until there are 500."),
    "calibration_drift_warning": ("fit again", "The mix of stages has moved by {v:.3f} since the filter was fitted, so its probabilities are out of date."),
    "blocking_knee": ("choose a block", "Blocking on {blocking_knee_block} spares {v:.1%} of the comparisons while {blocking_knee_survival:.1%} of equal records stay together."),
    "empty_column_ceiling": ("score what is there", "{max_empty_column_name} is empty in {v:.1%} of the records, and these can reach {max_empty_column_ceiling:.3f} at best."),
    "consider_containment": ("link subsets", "{v:.1%} of the records say no more than some longer record does; containment links them."),
    "est_comparisons_too_high": ("block finer", "Even the best key on offer leaves {v:,.0f} comparisons."),
    "low_yield_stage": ("drop a stage", "Stage {low_yield_stage_name} brought in {v:.2%} of the base, hardly worth a pass over the data."),
}


def _message(template: str):
    return lambda v, signals: template.format_map(_Known(signals, v=v))


class _Known(dict):
    """Signals by name; one that is missing or null reads as zero in numbers and as a blank in text."""

    def __init__(self, signals: dict, v: float):
        super().__init__(signals, v=v)

    def __getitem__(self, key: str):
        value = super().get(key)
        return _Blank() if value is None else value


class _Blank:
    def __format__(self, spec: str) -> str:
        return format(0.0, spec) if spec else ""


CATALOG = [Rule(i, signal, op, threshold, _ADVICE[i][0], _message(_ADVICE[i][1]), silenced) for i, signal, op, threshold, silenced in FIXED_RULES]

_OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def recommendations(signals: dict, catalog: list[Rule] | None = None) -> list[tuple[str, str]]:
    """``(id, message)`` of the rules that fire and are not silenced; missing signals fire nothing."""
    fired = [r for r in (catalog or CATALOG) if signals.get(r.signal) is not None and signals[r.signal] == signals[r.signal] and _OPS[r.op](signals[r.signal], r.threshold)]
    silent = {r.suppresses for r in fired if r.suppresses}
    return [(r.id, r.message(float(signals[r.signal]), signals)) for r in fired if r.id not in silent]
