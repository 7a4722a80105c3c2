"""Pair features, labels, false-positive filters and their calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.distance import jaro_winkler_column, osa_column
from linkwright.operators.diagnose import match_type
from linkwright.operators.embed import compute_embeddings
from linkwright.operators.index import id_text, prepare_search_data
from linkwright.operators.recommend import recommendations
from linkwright.plans.runtime import stash
from linkwright.plans.strategy import EmbeddingStrategy, SearchStrategy

__all__ = [
    "CalibratedMatches", "FilterModel", "apply_filter", "auxiliary_potential", "calibrate", "calibrate_matches", "filter_recipe", "fit_filter", "match_features",
    "match_pairs", "token_registry",
]


def token_registry(df: DataFrame, id: str, strategy: SearchStrategy) -> DataFrame:
    """``src_column, token, occ, maxocc``: records with the token, and the most any token of the column has. Blocks are ignored."""
    tokens = prepare_search_data(df, id, strategy.with_(block_by=()))
    occ = tokens.select("id", "src_column", "token").distinct().groupBy("src_column", "token").agg(F.count("*").alias("occ"))
    most = occ.groupBy("src_column").agg(F.max("occ").alias("maxocc"))
    return occ.join(most, "src_column")


def _log_ratio(occ: Column, most: Column) -> Column:
    return F.when(most <= 1, F.lit(0.0)).when(most > 1, F.log(occ.cast("double")) / F.log(most.cast("double")))


def auxiliary_potential(base: DataFrame, aux: DataFrame) -> DataFrame:
    """``src_column, token, aip`` from two registries: 1 minus the smaller log share; a side without the token does not count."""
    r = base.select("src_column", "token", _log_ratio(F.col("occ"), F.col("maxocc")).alias("r"))
    a = aux.select("src_column", "token", _log_ratio(F.col("occ"), F.col("maxocc")).alias("a"))
    return r.join(a, ["src_column", "token"], "full").select("src_column", "token", (1.0 - F.least("r", "a")).alias("aip"))


def match_pairs(matches: DataFrame) -> DataFrame:
    """``searched, found, match_id, score, stage``: base and target of a candidate; the first and each other of a group."""
    stage = F.col("stage") if "stage" in matches.columns else F.lit(None).cast("string")
    rows = matches.withColumn("_stage", stage)
    if match_type(matches) == "candidates":
        b = rows.where("source = 'base'").select("match_id", F.col("id").cast("string").alias("searched"), "score", F.col("_stage").alias("stage"))
        t = rows.where("source = 'target'").select("match_id", F.col("id").cast("string").alias("found"))
        return b.join(t, "match_id").select("searched", "found", "match_id", "score", "stage")
    first = rows.where("rank = 1").select(F.col("duplicate_group").alias("match_id"), F.col("id").cast("string").alias("searched"))
    rest = rows.where("rank > 1").select(F.col("duplicate_group").alias("match_id"), F.col("id").cast("string").alias("found"), "score", F.col("_stage").alias("stage"))
    return rest.join(first, "match_id").select("searched", "found", "match_id", "score", "stage")


def _similarity(a: Column, b: Column, method: str) -> Column:
    if method == "jw":
        return jaro_winkler_column(a, b)
    if method == "osa":
        return 1.0 - F.try_divide(osa_column(a, b).cast("double"), F.greatest(F.length(a), F.length(b)))
    if method == "lv":
        return 1.0 - F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)))
    raise ValueError(f"unknown string similarity {method!r}")


def _block_stats(pairs: DataFrame) -> DataFrame:
    """``cnt`` pairs and ``icnt`` different records found for the searched one; ``ipos`` the score's rank share among them."""
    w = Window.partitionBy("searched")
    out = pairs.withColumn("cnt", F.count("*").over(w)).withColumn("ipos", F.rank().over(w.orderBy("score")) / F.count("*").over(w))
    return out.join(pairs.groupBy("searched").agg(F.count_distinct("found").alias("icnt")), "searched")


def match_features(
    matches: DataFrame, strategy, base: DataFrame, id: str, target: DataFrame | None = None, target_id: str | None = None, top_n: int | dict[str, int] = 5,
    string_sim: bool = True, method: str = "jw",
) -> DataFrame:
    """One row a pair: counts, ranks, rarest shared and unshared tokens by column, string similarities.

    ``m_``, ``f_`` and ``s_<column>_<k>``: the k-th highest potential among the tokens shared,
    only found, only searched; ``r<i>``: the highest among tokens the searched record repeats
    in several columns; ``stage_<name>`` where there are several stages.
    """
    pairs = stash(_block_stats(match_pairs(matches)))
    other, other_id = (base, id) if target is None else (target, target_id or id)
    if isinstance(strategy, EmbeddingStrategy):
        a = compute_embeddings(base, id, strategy).select(F.col("id").alias("searched"), F.transform("embedding", lambda x: x.cast("double")).alias("_x"))
        b = compute_embeddings(other, other_id, strategy).select(F.col("id").alias("found"), F.transform("embedding", lambda x: x.cast("double")).alias("_y"))
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        dot = F.aggregate(F.zip_with("_x", "_y", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
        out = pairs.join(a, "searched", "left").join(b, "found", "left").withColumn("norm_s", norm(F.col("_x"))).withColumn("norm_f", norm(F.col("_y")))
        return out.withColumn("cosine_sim", F.try_divide(dot, F.col("norm_s") * F.col("norm_f"))).drop("_x", "_y")
    names = list(strategy.columns)
    limits = {c: top_n.get(c, 5) if isinstance(top_n, dict) else int(top_n) for c in names}
    plain = strategy.with_(block_by=())
    r = token_registry(base, id, plain)
    aip = stash(auxiliary_potential(r, r if target is None else token_registry(target, other_id, plain)))
    sets = lambda df, i: prepare_search_data(df, i, plain).select("id", "src_column", "token").distinct().join(aip, ["src_column", "token"], "left")
    keys = ["searched", "found", "match_id"]
    matched = lambda df, i, side: df.join(pairs.select(F.col(side).alias("_in")).distinct(), id_text(df[i]) == F.col("_in"), "left_semi")
    base, other = matched(base, id, "searched"), matched(other, other_id, "found")  # the records of the pairs: no other is tokenised or compared
    ps = pairs.select(*keys).join(sets(base, id).withColumnRenamed("id", "searched"), "searched")
    pf = pairs.select(*keys).join(sets(other, other_id).withColumnRenamed("id", "found"), "found")
    both = ps.select(*keys, "src_column", "token", F.col("aip").alias("_s")).join(pf.select(*keys, "src_column", "token", F.col("aip").alias("_f")), [*keys, "src_column", "token"], "full")
    kind = F.when(F.col("_s").isNull(), "f").when(F.col("_f").isNull(), "s").otherwise("m")
    long = both.withColumn("kind", kind).withColumn("aip", F.greatest("_s", "_f"))
    place = F.row_number().over(Window.partitionBy(*keys, "kind", "src_column").orderBy(F.desc("aip"), "token"))
    ranked = long.withColumn("_r", place)
    wide = [
        F.max(F.when((F.col("kind") == k) & (F.col("src_column") == c) & (F.col("_r") == i), F.col("aip"))).alias(f"{k}_{c}_{i}") for k in "mfs" for c in names for i in range(1, limits[c] + 1)
    ]
    top = ranked.groupBy(*keys).agg(*wide)
    seen = ps.groupBy(*keys, "token").agg(F.count_distinct("src_column").alias("_n"), *[F.max(F.when(F.col("src_column") == c, F.col("aip"))).alias(f"_a{i}") for i, c in enumerate(names, 1)])
    repeats = seen.groupBy(*keys).agg(
        F.count("*").alias("scnt"), F.count_if(F.col("_n") > 1).alias("rcnt"), *[F.max(F.when(F.col("_n") > 1, F.col(f"_a{i}"))).alias(f"r{i}") for i in range(1, len(names) + 1)]
    )
    out = pairs.join(repeats, keys, "left").join(top, keys, "left").na.fill(0, ["scnt", "rcnt"])
    if "stage" in matches.columns:
        stages = sorted(x[0] for x in pairs.select("stage").where("stage is not null").distinct().collect())  # the strategy author names the stages
        if len(stages) > 1:
            for s in stages:
                out = out.withColumn("stage_" + "".join(ch if ch.isalnum() else "." for ch in s), (F.col("stage") == s).cast("int"))
    if string_sim:
        a = base.select(id_text(id).alias("searched"), *[F.upper(F.col(c).cast("string")).alias(f"_b{i}") for i, c in enumerate(names)]).dropDuplicates(["searched"])
        b = other.select(id_text(other_id).alias("found"), *[F.upper(F.col(c).cast("string")).alias(f"_t{i}") for i, c in enumerate(names)]).dropDuplicates(["found"])
        out = out.join(a, "searched", "left").join(b, "found", "left")
        for i, c in enumerate(names):
            sim = _similarity(F.col(f"_b{i}"), F.col(f"_t{i}"), method)
            out = out.withColumn(f"sim_{c}", sim)
            out = out.withColumn(f"sim_sf_{c}", F.col(f"sim_{c}")).withColumn(f"sim_fs_{c}", F.col(f"sim_{c}")).drop(f"sim_{c}")
        out = out.drop(*[f"_b{i}" for i in range(len(names))], *[f"_t{i}" for i in range(len(names))])
    return out


@dataclass
class FilterModel:
    """A fitted classifier and what it was fitted on."""

    model: object
    predictors: list[str]
    na_fill: float
    training_n: int
    stage_share: dict[str, float] = field(default_factory=dict)
    labelled: DataFrame | None = None


@dataclass
class CalibratedMatches:
    matches: DataFrame
    pairs: DataFrame
    threshold: float
    model: FilterModel
    hints: list[tuple[str, str]]


_NOT_PREDICTORS = {"searched", "found", "match_id", "stage", "equal", "weight_", "features_"}


def _numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if c not in _NOT_PREDICTORS and t in ("int", "bigint", "double", "float", "tinyint", "smallint")]


def _labels(labels: DataFrame) -> DataFrame:
    """``match_id, found, equal`` from labelled match rows; of candidates the target rows count."""
    rows = labels.where("equal is not null")
    if "found" in rows.columns:
        return rows.select("match_id", F.col("found").cast("string").alias("found"), F.col("equal").cast("double").alias("equal"))
    if match_type(labels) == "candidates":
        rows = rows.where("source = 'target'")
        return rows.select("match_id", F.col("id").cast("string").alias("found"), F.col("equal").cast("double").alias("equal"))
    return rows.where("rank > 1").select(F.col("duplicate_group").alias("match_id"), F.col("id").cast("string").alias("found"), F.col("equal").cast("double").alias("equal"))


def _vector(df: DataFrame, model: FilterModel) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    for p in model.predictors:
        df = df.withColumn(p, F.coalesce(F.col(f"`{p}`").cast("double"), F.lit(model.na_fill)) if p in df.columns else F.lit(model.na_fill))
    safe = {p: f"p{i}_" for i, p in enumerate(model.predictors)}
    df = df.withColumns({s: F.col(f"`{p}`") for p, s in safe.items()})
    return VectorAssembler(inputCols=list(safe.values()), outputCol="features_").transform(df).drop(*safe.values())


def _independent(df: DataFrame, predictors: list[str], na_fill: float) -> list[str]:
    """Predictors that vary and are no combination of those before, from the (small) moment matrix."""
    import numpy as np

    x = [F.coalesce(F.col(f"`{p}`").cast("double"), F.lit(na_fill)) for p in predictors]
    k = len(predictors)
    moments = df.agg(*[F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(x[i]).alias(f"s{i}") for i in range(k)], F.count("*").alias("n")).first()
    n = moments["n"]
    m = np.zeros((k + 1, k + 1))
    m[0, 0] = n
    for i in range(k):
        m[0, i + 1] = m[i + 1, 0] = moments[f"s{i}"] or 0.0
        for j in range(i, k):
            m[i + 1, j + 1] = m[j + 1, i + 1] = moments[f"m{i}_{j}"] or 0.0
    scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
    m = m / scale[:, None] / scale[None, :]
    chosen = [0]
    for i in range(1, k + 1):
        a = m[np.ix_(chosen, chosen)]
        v = m[chosen, i]
        if m[i, i] - v @ np.linalg.lstsq(a, v, rcond=None)[0] > 1e-9:
            chosen.append(i)
    return [predictors[i - 1] for i in chosen[1:]]


def filter_recipe(predictors: list[str] | None = None, na_fill: float = 0.0, class_weighted: bool = False) -> dict:
    """Settings to hand to ``fit_filter``."""
    return {"predictors": predictors, "na_fill": na_fill, "class_weighted": class_weighted}


def fit_filter(features: DataFrame, labels: DataFrame, model="logistic", class_weighted: bool = False, na_fill: float = 0.0, predictors: list[str] | None = None) -> FilterModel:
    """Fit true against false pairs. ``model`` is "logistic" (no penalty) or any ``pyspark.ml`` classifier.

    Constant and linearly dependent predictors are left out; ``class_weighted`` balances by 1 / (2 p).
    """
    data = stash(features.join(_labels(labels).dropDuplicates(["match_id", "found"]), ["match_id", "found"]))
    got = data.agg(F.count("*").alias("n"), F.avg("equal").alias("p")).first()
    if not got["n"] or got["p"] in (0.0, 1.0):
        raise ValueError("labels must match pairs of both kinds")
    fitted = FilterModel(None, _independent(data, predictors or _numeric(features), na_fill), na_fill, got["n"])
    vec = _vector(data, fitted)
    weight = F.when(F.col("equal") == 1, F.lit(1 / (2 * got["p"]))).otherwise(F.lit(1 / (2 * (1 - got["p"]))))
    vec = vec.withColumn("weight_", weight if class_weighted else F.lit(1.0))
    if model == "logistic":
        from pyspark.ml.classification import LogisticRegression

        model = LogisticRegression(regParam=0.0, maxIter=200, tol=1e-8)
    for setter, value in (("setFeaturesCol", "features_"), ("setLabelCol", "equal"), ("setWeightCol", "weight_")):
        if hasattr(model, setter):
            model = getattr(model, setter)(value)
    fitted.model = model.fit(vec)
    fitted.stage_share = {r["stage"]: r["n"] / got["n"] for r in data.where("stage is not null").groupBy("stage").agg(F.count("*").alias("n")).collect()}
    fitted.labelled = data
    return fitted


def _probabilities(df: DataFrame, model: FilterModel) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    keep = df.columns
    out = model.model.transform(_vector(df, model))
    return out.withColumn("tp_prob", F.element_at(vector_to_array("probability"), 2)).select(*[F.col(f"`{c}`") for c in keep], "tp_prob")


def choose_threshold(scored: DataFrame, rule: str = "youden", target_recall: float = 0.95, cost_ratio: float = 1.0) -> float:
    """From ``tp_prob`` and ``equal``: sums by distinct probability, then one pass in order.

    The cumulative sums run over the labelled rows' distinct probabilities, which people made.
    """
    per = scored.groupBy("tp_prob").agg(F.sum("equal").alias("p"), F.sum(1 - F.col("equal")).alias("n"))
    w = Window.orderBy(F.desc("tp_prob")).rowsBetween(Window.unboundedPreceding, 0)
    cum = per.withColumn("tp", F.sum("p").over(w)).withColumn("fp", F.sum("n").over(w))
    total = scored.agg(F.sum("equal").alias("p"), F.sum(1 - F.col("equal")).alias("n")).first()
    big_p, big_n = total["p"] or 0.0, total["n"] or 0.0
    if not big_p or not big_n and rule != "target_recall":
        return 0.5
    if rule == "youden":
        best = cum.orderBy(F.desc(F.round(F.col("tp") / big_p - F.col("fp") / big_n, 12)), F.desc("tp_prob")).first()
    elif rule == "cost_weighted":
        best = cum.orderBy(F.round(cost_ratio * (big_p - F.col("tp")) + F.col("fp"), 12), F.desc("tp_prob")).first()
    elif rule == "target_recall":
        lose = int((1 - min(1.0, max(0.0, target_recall))) * big_p + 1e-9)
        best = cum.where(F.col("tp") >= big_p - min(lose, big_p - 1)).orderBy(F.desc("tp_prob")).first()
    else:
        raise ValueError(f"unknown threshold rule {rule!r}")
    return float(best["tp_prob"])


def apply_filter(
    features: DataFrame, model: FilterModel, matches: DataFrame, threshold: float | None = None, threshold_rule: str = "youden", target_recall: float = 0.95, cost_ratio: float = 1.0
) -> CalibratedMatches:
    """``tp_prob`` and ``predicted_tp`` for every pair, and for every row of the match table."""
    pairs = _probabilities(features, model)
    t = threshold if threshold is not None else choose_threshold(_probabilities(model.labelled, model), threshold_rule, target_recall, cost_ratio)
    pairs = stash(pairs.withColumn("predicted_tp", (F.col("tp_prob") >= t).cast("int")))
    if match_type(matches) == "candidates":
        out = matches.join(pairs.groupBy("match_id").agg(F.max("tp_prob").alias("tp_prob"), F.max("predicted_tp").alias("predicted_tp")), "match_id", "left")
    else:
        told = pairs.groupBy(F.col("match_id").alias("duplicate_group"), F.col("found").alias("id")).agg(F.max("tp_prob").alias("tp_prob"), F.max("predicted_tp").alias("predicted_tp"))
        out = matches.withColumn("id", F.col("id").cast("string")).join(told, ["duplicate_group", "id"], "left")
    signals: dict = {"training_n": model.training_n}
    if model.stage_share:
        n = pairs.count()
        now = {r["stage"]: r["c"] / n for r in pairs.where("stage is not null").groupBy("stage").agg(F.count("*").alias("c")).collect()}
        signals["stage_dist_tv_distance"] = 0.5 * sum(abs(now.get(s, 0.0) - model.stage_share.get(s, 0.0)) for s in {*now, *model.stage_share})
    return CalibratedMatches(out, pairs, t, model, recommendations(signals))


def calibrate_matches(matches: DataFrame, labels: DataFrame, strategy, base: DataFrame, id: str, target: DataFrame | None = None, target_id: str | None = None, model="logistic", **settings) -> CalibratedMatches:
    """Features, fit and apply in one call."""
    fit = {k: settings.pop(k) for k in ("class_weighted", "na_fill", "predictors") if k in settings}
    rule = {k: settings.pop(k) for k in ("threshold", "threshold_rule", "target_recall", "cost_ratio") if k in settings}
    features = stash(match_features(matches, strategy, base, id, target, target_id, **settings))
    return apply_filter(features, fit_filter(features, labels, model, **fit), matches, **rule)


def calibrate(scored: DataFrame, threshold: float = 0.5, bins: int = 10, prob: str = "tp_prob", label: str = "equal"):
    """Reliability by bin, Brier score, log loss, confusion and the threshold curve (0 to 1 by 0.01) of labelled probabilities."""
    from linkwright.operators.diagnose import Report

    rows = scored.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).select(F.col(prob).cast("double").alias("p"), F.col(label).cast("int").alias("y"))
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    reliability = rows.groupBy((b + 1).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_pred"), F.avg(F.col("y").cast("double")).alias("obs_pos"))
    reliability = reliability.withColumn("bin_lower", (F.col("bin") - 1) / bins).withColumn("bin_upper", F.col("bin") / bins)
    c = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    got = rows.agg(
        F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("balance"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg(-F.when(F.col("y") == 1, F.log(c)).otherwise(F.log(1 - c))).alias("log_loss")
    ).first()
    confusion = rows.groupBy(F.col("y").alias("equal")).agg(F.count_if(F.col("p") < threshold).alias("n_pred0"), F.count_if(F.col("p") >= threshold).alias("n_pred1"))
    # rows fall in one of 101 grid steps; the curve adds the steps up from above
    step = F.floor(F.col("p") * 100 + 1e-9).cast("int")
    per = rows.groupBy(step.alias("k")).agg(F.count_if(F.col("y") == 1).alias("p1"), F.count_if(F.col("y") == 0).alias("p0"))
    grid = scored.sparkSession.range(101).select(F.col("id").cast("int").alias("k"))
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # 101 rows
    cum = grid.join(per, "k", "left").na.fill(0, ["p1", "p0"]).withColumn("tp", F.sum("p1").over(w)).withColumn("fp", F.sum("p0").over(w))
    whole = Window.partitionBy()
    cum = cum.withColumn("P", F.sum("p1").over(whole)).withColumn("N", F.sum("p0").over(whole))
    tpr, fpr, precision = F.try_divide("tp", "P"), F.try_divide("fp", "N"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    curve = cum.select((F.col("k") / 100).alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), precision.alias("precision"), tpr.alias("recall"), F.try_divide(2 * precision * tpr, precision + tpr).alias("f1"), (tpr - fpr).alias("youden_j"))
    values = {"n_eval": got["n"], "class_balance": got["balance"], "brier": got["brier"], "log_loss": got["log_loss"], "threshold": threshold}
    return Report("calibration", {"reliability": reliability, "confusion_per_class": confusion, "threshold_curve": curve}, values, recommendations({"training_n": got["n"]}))
