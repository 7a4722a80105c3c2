"""Staged linkage: strategies applied one after the other, resolved once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.operators.index import id_text
from linkwright.operators.resolve import resolve_entities
from linkwright.operators.verbs import candidate_pairs, detect_duplicates, duplicate_links
from linkwright.plans.runtime import stash

__all__ = ["StagedResult", "multi_stage_dedup", "multi_stage_search"]

LEDGER = "from string, to string, score double, stage string, source_from string, source_to string, within_source boolean, direction string"


@dataclass
class StagedResult:
    """``entities`` and the ``ledger`` of links they come from."""

    entities: DataFrame
    ledger: DataFrame


def _named(strategies) -> dict:
    out = dict(strategies) if isinstance(strategies, dict) else {f"strategy_{i}": s for i, s in enumerate(strategies, 1)}
    if not out:
        raise ValueError("no strategies")
    return out


def _first_stage(ledger: DataFrame, names: list[str]) -> DataFrame:
    order = F.lit(len(names))
    for i, n in enumerate(names):
        order = F.when(F.col("stage") == n, F.lit(i)).otherwise(order)
    ends = ledger.select(F.col("from").alias("id"), "stage").union(ledger.select("to", "stage"))
    return ends.groupBy("id").agg(F.min_by("stage", order).alias("stage"))


def multi_stage_dedup(df: DataFrame, id: str, strategies, rep_by: str | None = None, edge_filter: Callable | None = None) -> StagedResult:
    """``duplicate_group, id, score, rank, stage`` and the other columns.

    After a stage only the representatives and the records not yet grouped go on, so a
    looser stage sees less and can still join a straggler to its group's representative.
    One resolution at the end closes all links; ``stage`` is the first that touched the id.
    """
    names = _named(strategies)
    working, ledger = df, None
    for stage, strategy in names.items():
        groups = stash(detect_duplicates(working, id, strategy).select("duplicate_group", "id", "score", "rank"))
        reps = groups.where("rank = 1").select("duplicate_group", F.col("id").alias("from"))
        edges = groups.where("rank > 1").join(reps, "duplicate_group").select("from", F.col("id").alias("to"), "score", F.lit(stage).alias("stage"))
        kept = edge_filter(edges, stage) if edge_filter else edges
        ledger = kept if ledger is None else ledger.unionByName(kept)
        gone = groups.where("rank > 1").select(F.col("id").alias("_gone"))
        working = stash(working.join(gone, id_text(working[id]) == F.col("_gone"), "left_anti"))
    ledger = stash(ledger)
    vertices = df.select(id_text(id).alias("id"), *([F.col(rep_by)] if rep_by and rep_by != "id" else []))
    ent = resolve_entities(ledger, "from", "to", "score", vertices, rep_by)
    n = F.count("*").over(Window.partitionBy("entity"))
    grouped = stash(ent.withColumn("_n", n).where("_n > 1").drop("_n"))
    dense = grouped.select("entity").distinct()
    from linkwright.operators.numbering import number_rows

    dense = number_rows(dense, ["entity"], "duplicate_group")
    out = grouped.join(dense, "entity").join(_first_stage(ledger, list(names)), "id", "left").select("duplicate_group", "id", "score", "rank", "stage")
    taken = set(out.columns)
    rest = df.select(id_text(id).alias("id"), *[F.col(c).alias(c if c not in taken else f"{c}_original") for c in df.columns if c != id])
    return StagedResult(out.join(rest, "id", "left"), ledger)


def _source(columns: tuple[str, ...]):
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def multi_stage_search(
    base: DataFrame,
    target: DataFrame | None,
    base_id: str,
    target_id: str | None,
    strategies,
    self_search: bool = False,
    source_by: str | tuple[str, ...] | None = None,
    collapse: str = "none",
    rep_rule: str = "canonical",
    rebind: str = "explicit",
    direction: str = "forward",
    edge_filter: Callable | None = None,
    rep_by: str | None = None,
) -> StagedResult:
    """Entities over both tables: ``entity, id, rep, rank, score, source, covered_sources, n_in_entity, stage``.

    ``collapse`` none drops what a stage matched; rep carries one representative of every
    component on. ``rebind``: explicit keeps the sides apart, self pools them, accumulate
    lets the base grow. ``direction``: forward, backward or bidirectional. Ids of both
    tables share one space: an id in both is one record.
    """
    if collapse not in ("none", "rep"):
        raise ValueError("collapse must be none or rep (union is reserved)")
    if rep_rule != "canonical":
        raise ValueError("only the canonical rep_rule is available")
    if rebind not in ("explicit", "self", "accumulate") or direction not in ("forward", "backward", "bidirectional"):
        raise ValueError("unknown rebind or direction")
    if not self_search and target is None:
        raise ValueError("a target is needed unless self_search")
    names = _named(strategies)
    sources = (source_by,) if isinstance(source_by, str) else tuple(source_by or ())
    tid = base_id if self_search else target_id
    target = base if self_search else target
    base_now, target_now = base, target
    pooled = self_search or rebind == "self"
    ledger = base.sparkSession.createDataFrame([], LEDGER)

    def tagged(b, bi, t, ti, strategy, stage, way):
        if self_search and b is t:
            pairs = duplicate_links(b, bi, strategy)
        else:
            pairs = candidate_pairs(b, t, bi, ti, strategy).where("lhs_id <> rhs_id")
        e = pairs.select(F.col("lhs_id").alias("from"), F.col("rhs_id").alias("to"), "score", F.lit(stage).alias("stage"))
        if sources:
            sf = b.select(id_text(bi).alias("from"), _source(sources).alias("source_from")).dropDuplicates(["from"])
            st = t.select(id_text(ti).alias("to"), _source(sources).alias("source_to")).dropDuplicates(["to"])
            e = e.join(sf, "from", "left").join(st, "to", "left").withColumn("within_source", F.col("source_from") == F.col("source_to"))
        else:
            e = e.withColumns({"source_from": F.lit(None).cast("string"), "source_to": F.lit(None).cast("string"), "within_source": F.lit(None).cast("boolean")})
        return e.withColumn("direction", F.lit(way)).select("from", "to", "score", "stage", "source_from", "source_to", "within_source", "direction")

    def without(df, name, gone):
        g = gone.select(F.col("id").alias("_gone")).distinct()
        return df.join(g, id_text(df[name]) == F.col("_gone"), "left_anti")

    def only(df, name, ids):
        g = ids.select(F.col("id").alias("_keep")).distinct()
        return df.join(g, id_text(df[name]) == F.col("_keep"), "left_semi")

    for stage, strategy in names.items():
        edges = []
        if direction in ("forward", "bidirectional"):
            edges.append(tagged(base_now, base_id, target_now, tid, strategy, stage, "forward"))
        if direction in ("backward", "bidirectional"):
            edges.append(tagged(target_now, tid, base_now, base_id, strategy, stage, "backward"))
        e = edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])
        if edge_filter:
            e = edge_filter(e, stage)
        e = stash(e)
        ledger = ledger.unionByName(e)
        if e.isEmpty():
            continue
        hit_from, hit_to = e.select(F.col("from").alias("id")), e.select(F.col("to").alias("id"))
        both = hit_from.union(hit_to)
        if collapse == "none":
            if pooled:
                base_now = target_now = stash(without(base_now, base_id, both))
            else:
                base_now, target_now = stash(without(base_now, base_id, hit_from)), stash(without(target_now, tid, hit_to))
        else:
            reps = stash(resolve_entities(ledger, "from", "to", "score").where("rank = 1").select("id"))
            b_ids = base_now.select(id_text(base_id).alias("id"))
            if pooled:
                rest = without(base_now, base_id, both).select(id_text(base_id).alias("id"))
                base_now = target_now = stash(only(base, base_id, reps.union(rest)))
            elif rebind == "accumulate":
                base_now = stash(only(base, base_id, reps.union(b_ids)))
                target_now = stash(without(target_now, tid, hit_to))
            else:
                mine = reps.join(b_ids, "id", "left_semi")
                rest = without(base_now, base_id, hit_from).select(id_text(base_id).alias("id"))
                base_now = stash(only(base, base_id, mine.union(rest)))
                target_now = stash(without(target_now, tid, hit_to))
        if base_now.isEmpty() and target_now.isEmpty():
            break
    ledger = stash(ledger)
    keep = [*sources, *([rep_by] if rep_by and rep_by not in sources else [])]
    vertices = base.select(id_text(base_id).alias("id"), *keep)
    if not self_search:
        vertices = vertices.unionByName(target.select(id_text(tid).alias("id"), *[c for c in keep if c in target.columns]), allowMissingColumns=True)
    vertices = stash(vertices.dropDuplicates(["id"]))
    ent = resolve_entities(ledger, "from", "to", "score", vertices, rep_by)
    tag = _source(sources) if sources else F.lit(None).cast("string")
    ent = ent.join(vertices.select("id", tag.alias("source")), "id", "left")
    per = ent.groupBy("entity").agg(F.count("*").alias("n_in_entity"), F.count_distinct("source").alias("covered_sources"))
    if not sources:
        per = per.withColumn("covered_sources", F.lit(None).cast("long"))
    ent = ent.join(per, "entity").join(_first_stage(ledger, list(names)), "id", "left")
    return StagedResult(ent.select("entity", "id", "rep", "rank", "score", "source", "covered_sources", "n_in_entity", "stage"), ledger)
