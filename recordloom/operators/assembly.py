"""Integrated decisions: relations folded into merges, drops and status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import section_number
from ..schemas import STATUS_AFTER

LISTS = ("alternatives", "rationale", "risks", "revisit_conditions", "missing_information")


def key_order(key: Column) -> Column:
    """Numeric order of SEC-ddd:D-ddd."""
    part = F.split(key, ":")
    return F.struct(section_number(part[0]).alias("s"), F.regexp_extract(part[1], r"(\d+)$", 1).cast("int").alias("d"))


def relations(judgments: DataFrame, unclassified: DataFrame, inventory: DataFrame) -> DataFrame:
    """Judgments of all clusters in one order (seq), keys that were left over among them as uncertain."""
    left = unclassified.join(inventory.select("session_id", "source_decision_key", "evidence_refs"), ["session_id", "source_decision_key"])
    extra = left.select(
        "session_id", "cluster_id", (F.lit(1 << 20) + F.row_number().over(W.partitionBy("session_id", "cluster_id").orderBy(key_order(F.col("source_decision_key"))))).alias("pos"),
        F.format_string("%s:unclassified:%s", "cluster_id", "source_decision_key").alias("judgment_id"), F.lit("uncertain").alias("relation"), F.array("source_decision_key").alias("member_decision_keys"),
        F.lit(None).cast("struct<from_decision_key:string,relation:string,to_decision_key:string>").alias("direction"), F.array(F.lit("left unclassified")).alias("rationale"), "evidence_refs",
        F.lit("low").alias("confidence"), F.array(F.lit("relation was not classified")).alias("missing_information"))
    return judgments.unionByName(extra.select(*judgments.columns)).withColumn("seq", F.struct("cluster_id", "pos"))


def status_updates(rels: DataFrame) -> DataFrame:
    """session_id, source_decision_key and status of the last lifecycle judgment on it: the target by its direction, the source accepted."""
    to = F.create_map(*(F.lit(x) for kv in STATUS_AFTER.items() for x in kv))
    d = rels.where("relation = 'lifecycle_relation'")
    sets = d.select("session_id", "seq", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("direction.to_decision_key").alias("key"), to[F.col("direction.relation")].alias("status")),
                                             F.struct(F.lit(1).alias("k"), F.col("direction.from_decision_key").alias("key"), F.lit("accepted").alias("status")))).alias("u"))
    return last_write(sets.select("session_id", F.col("u.key").alias("source_decision_key"), F.col("u.status").alias("status"), F.struct("seq", "u.k").alias("seq")), ["session_id", "source_decision_key"], "status", "seq")


def last_write(updates: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The value with the largest order per key; combined on the map side."""
    return updates.groupBy(*by).agg(F.max_by(value, order).alias(value))


def overlapping_groups(rels: DataFrame) -> DataFrame:
    """Keys that stand in two different same_decision groups."""
    g = rels.where("relation = 'same_decision'").select("session_id", F.array_sort(F.array_distinct("member_decision_keys")).alias("g"))
    each = g.select("session_id", "g", F.explode("g").alias("source_decision_key"))
    return each.groupBy("session_id", "source_decision_key").agg(F.countDistinct("g").alias("n")).where("n > 1").select("session_id", "source_decision_key")


def merge(members: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Merges each group's rows: scalars of the last member, lists joined in order without repeats, the least confidence."""
    rank = F.create_map(F.lit("high"), F.lit(2), F.lit("medium"), F.lit(1), F.lit("low"), F.lit(0))
    d = members.withColumn("_o", order).withColumn("_rank", rank[F.col("confidence")])
    joined = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(c).alias("x")))), lambda v: v["x"]))).alias(c)
    return d.groupBy(*by).agg(
        F.max_by("source_decision_key", "_o").alias("canonical_key"), *(F.max_by(c, "_o").alias(c) for c in ("title", "decision", "context", "status")), *map(joined, LISTS), joined("rejected_alternatives"),
        joined("evidence_refs"), F.min_by("confidence", "_rank").alias("confidence"), F.transform(F.array_sort(F.collect_list("source_decision_key")), lambda x: x).alias("source_decision_keys"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_decision_key", "status")))).alias("original_statuses"))


def assemble(inventory: DataFrame, rels: DataFrame) -> DataFrame:
    """Integrated decisions of each session, ID-ddd in key order. Of a group's updates the one on its last key, by its text,
    counts. A group stands where the first of its keys does, dropped ones included."""
    key, group = ["session_id", "source_decision_key"], ["session_id", "group"]
    members = rels.select("session_id", "relation", F.explode("member_decision_keys").alias("source_decision_key"))
    dropped = members.where("relation = 'not_decision'").select(*key).distinct()
    groups = rels.where("relation = 'same_decision'").select("session_id", F.array_sort(F.array_distinct("member_decision_keys")).alias("g")).distinct()
    group_of = groups.select("session_id", F.explode("g").alias("source_decision_key"), F.array_join("g", "\n").alias("group"))
    grouped = inventory.join(group_of, key, "left").withColumn("group", F.coalesce("group", "source_decision_key"))
    d = grouped.join(dropped, key, "left_anti")
    made = merge(d, group, key_order(F.col("source_decision_key")))
    updates = status_updates(rels).withColumnRenamed("status", "new_status")
    per_group = d.select(*group, "source_decision_key").join(updates, key).groupBy(*group).agg(F.max_by("new_status", "source_decision_key").alias("new_status"))
    labels = d.select(*group, "source_decision_key").join(members, key).groupBy(*group).agg(F.array_sort(F.collect_set("relation")).alias("integration_relations"))
    made = made.join(per_group, group, "left").join(labels, group, "left")
    made = made.withColumn("status", F.coalesce("new_status", "status")).withColumn("integration_relations", F.coalesce("integration_relations", F.array().cast("array<string>")))
    first = grouped.groupBy(*group).agg(F.min(key_order(F.col("source_decision_key"))).alias("_first"))
    number = F.row_number().over(W.partitionBy("session_id").orderBy("_first"))
    return made.join(first, group).withColumn("decision_id", F.format_string("ID-%03d", number)).drop("group", "new_status", "_first")


def summary(inventory: DataFrame, rels: DataFrame, made: DataFrame) -> DataFrame:
    """Per session: counts before and after, by status and relation, and merge volumes (group sizes as judged, with repeats)."""
    n = F.count(F.lit(1))
    dist = lambda d, c, name: d.groupBy("session_id", c).agg(n.alias("n")).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name))
    same = rels.where("relation = 'same_decision'").groupBy("session_id").agg(n.alias("same_decision_groups"), F.sum(F.size("member_decision_keys")).alias("merged_source_decision_count"))
    one = inventory.groupBy("session_id").agg(n.alias("decisions_before"))
    for d in (made.groupBy("session_id").agg(n.alias("decisions_after")), same, dist(inventory, "status", "status_before"), dist(made, "status", "status_after"), dist(rels, "relation", "relation_distribution")):
        one = one.join(d, "session_id", "left")
    return one.na.fill(0)
