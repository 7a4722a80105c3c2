"""The data behind each diagnostic plot, as DataFrames to hand to any plotting tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.operators.diagnose import Report, _gaps, histogram, match_type

__all__ = [
    "ambiguity_plot", "block_size_plot", "cluster_size_plot", "contribution_plot", "coverage_plot", "frontier_plot", "norm_plot", "rarity_histogram", "score_density",
    "score_histogram", "similarity_histogram", "stage_coverage_plot", "stage_score_plot", "token_contribution_plot", "token_frequency_plot", "top_gap_density", "vocab_overlap_plot",
]


def _stats(report: Report, table: str, *columns: str) -> DataFrame:
    return report.tables[table].select(*columns) if columns else report.tables[table]


def rarity_histogram(audit: Report) -> DataFrame:
    """Rarity quantiles by column."""
    return _stats(audit, "rarity_stats")


def token_frequency_plot(distribution: Report) -> DataFrame:
    """The commonest tokens and their df."""
    return _stats(distribution, "offenders", "src_column", "token", "df")


def block_size_plot(audit: Report) -> DataFrame:
    return _stats(audit, "block_distribution").orderBy(F.desc("n_records"))


def vocab_overlap_plot(audit: Report) -> DataFrame:
    return _stats(audit, "vocab_overlap")


def similarity_histogram(audit: Report, bins: int = 50) -> DataFrame:
    return histogram(audit.tables["similarities"], "similarity", bins)


def norm_plot(audit: Report, bins: int = 50) -> DataFrame:
    return histogram(audit.tables["norms"], "norm", bins)


def score_histogram(matches: DataFrame | Report, bins: int = 50) -> DataFrame:
    return matches.tables["score_dist"] if isinstance(matches, Report) else histogram(matches, "score", bins)


def score_density(matches: DataFrame, bins: int = 100) -> DataFrame:
    """Histogram scaled to an area of one."""
    h = histogram(matches, "score", bins)
    total = h.agg(F.sum("count").alias("_n"))
    width = F.col("bin_upper") - F.col("bin_lower")
    return h.crossJoin(total).select("bin_lower", "bin_upper", F.try_divide(F.col("count"), F.col("_n") * width).alias("density"))  # one row


def coverage_plot(overview: Report) -> DataFrame:
    from linkwright.plans.runtime import build_session

    rows = [(s, overview.values.get(f"{s}_coverage")) for s in ("base", "target")]
    return build_session().createDataFrame(rows, "side string, coverage double")


def cluster_size_plot(overview: Report) -> DataFrame:
    return _stats(overview, "cluster_dist").orderBy("cluster_size")


def ambiguity_plot(overview: Report) -> DataFrame:
    return _stats(overview, "ambiguity_dist").orderBy("candidates_per_record")


def top_gap_density(matches: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(_gaps(matches, match_type(matches)), "gap", bins)


def contribution_plot(explanation: DataFrame) -> DataFrame:
    """Contribution by column."""
    return explanation.groupBy("src_column").agg(F.sum("contribution").alias("contribution"))


def token_contribution_plot(explanation: DataFrame) -> DataFrame:
    return explanation.select("src_column", "token", "contribution").orderBy(F.desc("contribution"))


def stage_coverage_plot(comparison: Report) -> DataFrame:
    return _stats(comparison, "coverage")


def stage_score_plot(comparison: Report) -> DataFrame:
    return _stats(comparison, "score_by_stage")


def frontier_plot(plan: Report) -> DataFrame:
    return _stats(plan, "frontier", "block_key", "brute_pairs", "exact_twin_survival")
