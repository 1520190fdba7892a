"""Clusters of candidate pairs: labels, priorities, shared evidence and what a reviewer gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ROUTINE_TERMS, contains_any, reduction
from .sections import context_order
from .similarity import possible_pairs, ranked


def priority(lifecycle: Column, size: Column) -> Column:
    return F.when(lifecycle | (size >= 6), "high").when(size >= 3, "medium").otherwise("low")


def shared_by_all(items: DataFrame, by: list[str], item: str, size: DataFrame, parts: int | None = None) -> DataFrame:
    """Items that all of a group's members have: counted over distinct (member, item); size: by, members. parts: partitions that large
    inputs are dealt to, so that a task's memory doesn't grow with them."""
    dealt = lambda d, *c: d.repartition(parts, *c) if parts else d
    n = dealt(items, *by, item).distinct().groupBy(*by, item).agg(F.count(F.lit(1)).alias("_n"))
    return dealt(n, *by).join(dealt(size, *by), by).where(F.col("_n") == F.col("members")).select(*by, item)


def clusters(feats: DataFrame, inventory: DataFrame, pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per cluster of two or more. feats and inventory: decisions; pairs: marked candidate pairs; chosen: capped.clustered."""
    roots = chosen.where("root is not null").select("session_id", "ord", "root")
    routine = contains_any(F.concat_ws(" ", "title", "decision"), ROUTINE_TERMS).alias("_routine")
    info = inventory.select("session_id", "source_decision_key", "evidence_refs", routine)
    members = ranked(feats).select("session_id", "ord", "source_decision_key", "section_id", "n", "status", "terms").join(roots, ["session_id", "ord"]).join(info, ["session_id", "source_decision_key"])
    by = ["session_id", "root"]
    m = members.groupBy(*by).agg(F.array_sort(F.collect_list("source_decision_key")).alias("member_decision_keys"), F.countDistinct("status").alias("_statuses"), F.bool_and("_routine").alias("_routine"),
                                 F.transform(F.array_sort(F.collect_set(F.struct("n", "section_id"))), lambda x: x["section_id"]).alias("section_ids")).where(F.size("member_decision_keys") > 1)
    size = m.select(*by, F.size("member_decision_keys").alias("members"))
    ends = pairs.join(roots.select("session_id", F.col("ord").alias("left_ord"), "root"), ["session_id", "left_ord"]).join(roots.select("session_id", F.col("ord").alias("right_ord"), F.col("root").alias("_r")), ["session_id", "right_ord"])
    inner = ends.where("root = _r").groupBy(*by).agg(
        F.bool_or("possible_lifecycle_relation").alias("_life"), F.bool_or("strong_cluster_candidate").alias("_strong"), F.count(F.lit(1)).alias("candidate_pair_count"),
        F.count_if("selected_cluster_edge").alias("selected_edge_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidate_reasons")))).alias("candidate_reasons"))
    refs = shared_by_all(members.select(*by, "ord", F.explode("evidence_refs").alias("ref")), by, "ref", size).groupBy(*by).agg(F.array_sort(F.collect_list("ref")).alias("shared_evidence_refs"))
    terms = shared_by_all(members.select(*by, "ord", F.explode("terms").alias("term")), by, "term", size).groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("term")), 1, 20).alias("shared_terms"))
    d = m.join(inner, by, "left").join(refs, by, "left").join(terms, by, "left")
    life = (F.col("_statuses") > 1) | F.coalesce("_life", F.lit(False))
    label = F.when(F.col("_routine") | ~F.coalesce("_strong", F.lit(False)), "uncertain").when(life, "possible_lifecycle_relation").otherwise("possible_same_decision")
    n = F.size("member_decision_keys")
    cluster_id = F.concat(F.lit("CLUSTER-"), F.substring(F.sha2(F.array_join("member_decision_keys", "\n"), 256), 1, 12))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return d.select("session_id", cluster_id.alias("cluster_id"), "member_decision_keys", "section_ids", label.alias("candidate_relation"), none("candidate_reasons", "array<string>").alias("candidate_reasons"),
                    none("shared_evidence_refs", "array<struct<evidence_type:string,evidence_id:string>>").alias("shared_evidence_refs"), none("shared_terms", "array<string>").alias("shared_terms"),
                    priority(life, n).alias("review_priority"), F.lit(False).alias("automatic_merge_allowed"), F.coalesce("selected_edge_count", F.lit(0)).alias("selected_edge_count"), F.coalesce("candidate_pair_count", F.lit(0)).alias("candidate_pair_count"))


def member_mismatches(made: DataFrame, inputs: DataFrame) -> DataFrame:
    """cluster_id of clusters whose listed members aren't those of their input, repeats counted. inputs: cluster_id,
    source_decision_key, a row per decision."""
    got = inputs.groupBy("cluster_id").agg(F.array_sort(F.collect_list("source_decision_key")).alias("_got"))
    return made.select("cluster_id", F.array_sort("member_decision_keys").alias("_want")).join(got, "cluster_id", "full").where(~F.col("_want").eqNullSafe(F.col("_got"))).select("cluster_id")


def singletons(inventory: DataFrame, made: DataFrame) -> DataFrame:
    inside = made.select("session_id", F.explode("member_decision_keys").alias("source_decision_key"))
    return inventory.select("session_id", "source_decision_key").join(inside, ["session_id", "source_decision_key"], "left_anti")


def review_inputs(made: DataFrame, inventory: DataFrame, evidence: DataFrame, around: DataFrame, blind: bool = False) -> DataFrame:
    """A document per cluster: decisions, evidence, neighbour messages in context order.

    evidence: session_id, evidence_type, evidence_id, content, section_id, source_line; around: session_id, evidence_id and
    the struct columns previous and next. blind leaves out the machine's label, sections and source files. Missing evidence
    raises. A neighbour that is evidence itself stays among the neighbours.
    """
    members = made.select("session_id", "cluster_id", F.explode("member_decision_keys").alias("source_decision_key")).join(inventory, ["session_id", "source_decision_key"])
    hidden = {"session_id", "cluster_id"} | ({"section_id", "source_decision_id", "source_file", "source_sha256"} if blind else set())
    shown = ["source_decision_key", *(c for c in inventory.columns if c not in hidden and c != "source_decision_key")]
    decisions = members.groupBy("session_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("decisions"))
    refs = members.select("session_id", "cluster_id", F.explode("evidence_refs").alias("r")).select("session_id", "cluster_id", "r.evidence_type", "r.evidence_id").distinct()
    found = refs.join(evidence.withColumn("_in", F.lit(True)), ["session_id", "evidence_type", "evidence_id"], "left")
    record = F.struct("evidence_type", F.when(F.col("_in"), F.col("evidence_id")).otherwise(F.raise_error(F.concat(F.lit("Evidence missing while creating cluster input: "), F.col("evidence_id"))).cast("string")).alias("evidence_id"), "content", "source_line")
    cited = found.groupBy("session_id", "cluster_id").agg(F.array_sort(F.collect_list(record)).alias("evidence"))
    near = refs.where("evidence_type = 'message'").join(around, ["session_id", "evidence_id"]).select("session_id", "cluster_id", F.explode(F.array_compact(F.array("previous", "next"))).alias("m")).distinct()
    near = near.groupBy("session_id", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(context_order(F.col("m.source_line"), F.col("m.evidence_id")).alias("k"), "m"))), lambda x: x["m"]).alias("neighbor_messages"))
    head = made.select("session_id", "cluster_id", *([] if blind else ["candidate_relation"]))
    return head.join(decisions, ["session_id", "cluster_id"]).join(cited, ["session_id", "cluster_id"], "left").join(near, ["session_id", "cluster_id"], "left")


def evaluation(inventory: DataFrame, pairs: DataFrame, made: DataFrame) -> DataFrame:
    """Per session: volumes, reduction rates and distributions of a candidate run."""
    dist = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "_n"))))
    total = inventory.groupBy("session_id").agg(F.count(F.lit(1)).alias("inventory_decision_count"))
    p = pairs.groupBy("session_id").agg(F.count(F.lit(1)).alias("candidate_pair_count"), F.count_if("selected_cluster_edge").alias("selected_cluster_edge_count"), F.count_if("strong_cluster_candidate").alias("strong_pair_count"))
    ends = pairs.select("session_id", F.explode(F.array("left_decision_key", "right_decision_key")).alias("k")).distinct()
    inside = made.select("session_id", F.explode("member_decision_keys").alias("k"))
    review = ends.groupBy("session_id").agg(F.count(F.lit(1)).alias("ai_review_decision_count"))
    only = ends.join(inside, ["session_id", "k"], "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("pair_only_review_decision_count"))
    sized = made.withColumn("size", F.size("member_decision_keys"))
    c = sized.groupBy("session_id").agg(F.count(F.lit(1)).alias("candidate_cluster_count"), F.sum("size").alias("clustered_decision_count"), F.max("size").alias("largest_cluster_size"))
    d = total.join(possible_pairs(inventory), "session_id")
    for x in (p, review, only, c):
        d = d.join(x, "session_id", "left")
    d = d.na.fill(0)
    for name, col in (("cluster_size_distribution", F.col("size").cast("string")), ("candidate_relation_distribution", F.col("candidate_relation")), ("review_priority_distribution", F.col("review_priority"))):
        per = sized.groupBy("session_id", col.alias("_k")).agg(F.count(F.lit(1)).alias("_n")).groupBy("session_id").agg(dist("_k").alias(name))
        d = d.join(per, "session_id", "left")
    return (d.withColumn("singleton_count", F.col("inventory_decision_count") - F.col("clustered_decision_count"))
            .withColumn("pair_comparison_reduction_rate", reduction(F.col("candidate_pair_count"), F.col("possible_cross_section_pair_count")))
            .withColumn("ai_review_decision_reduction_rate", reduction(F.col("ai_review_decision_count"), F.col("inventory_decision_count"))))
