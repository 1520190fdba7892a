"""Lifecycle review of proposed decisions, and what its results change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import section_number
from .projection import part_of
from .sections import context_order, window_sections


def groups(integrated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(review groups, violations): proposed decisions by their one source section; several sections are a violation."""
    sections = F.array_distinct(F.transform("source_decision_keys", lambda k: F.split(k, ":")[0]))
    d = integrated.where("status = 'proposed'").withColumn("_s", sections)
    bad = d.where(F.size("_s") != 1).select(F.lit(0).alias("ord"), F.concat(F.lit("proposed decision spans several sections: "), "decision_id").alias("message"))
    good = d.where(F.size("_s") == 1).withColumn("section_id", F.col("_s")[0])
    made = good.groupBy("session_id", "section_id").agg(F.array_sort(F.collect_list("decision_id")).alias("decision_ids"))
    return made.withColumn("group_id", F.concat(F.lit("LIFECYCLE-"), "section_id")), bad


def context(review: DataFrame, messages: DataFrame, attachments: DataFrame, reach: int = 2, parts: bool = False) -> DataFrame:
    """Per group the messages and attachments of sections n to n + reach, each once, in context order. With parts, a row for each part of a group's
    messages; its first has the attachments."""
    sections = messages.select("session_id", "section_id").distinct()
    wide = window_sections(review.select("session_id", "group_id", "section_id"), sections, reach).select("session_id", "group_id", F.col("context_section_id").alias("section_id"))
    m = wide.join(messages, ["session_id", "section_id"]).dropDuplicates(["session_id", "group_id", "evidence_id"])
    item = F.struct(context_order(F.col("source_line"), F.col("evidence_id")).alias("k"), F.struct("evidence_id", "actor", "source_line", "content").alias("m"))
    key = ["session_id", "group_id"]
    ms = m.groupBy(*key, *([part_of(F.col("source_line")).alias("part")] if parts else [])).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("messages"))
    a = wide.join(attachments.withColumn("section_id", F.explode("section_ids")), ["session_id", "section_id"]).select("session_id", "group_id", "attachment_id", "content").dropDuplicates(["session_id", "group_id", "attachment_id"])
    at = a.groupBy("session_id", "group_id").agg(F.array_sort(F.collect_list(F.struct("attachment_id", "content"))).alias("attachments"))
    named = wide.groupBy("session_id", "group_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(section_number(F.col("section_id")).alias("n"), "section_id"))), lambda x: x["section_id"]).alias("context_sections"))
    d = review.join(named, key, "left").join(ms, key, "left")
    if not parts:
        return d.join(at, key, "left")
    first = ms.groupBy(*key).agg(F.min("part").alias("part"))
    return d.withColumn("part", F.coalesce("part", F.lit(0))).join(at.join(first, key, "left").withColumn("part", F.coalesce("part", F.lit(0))), [*key, "part"], "left")


def apply(integrated: DataFrame, results: DataFrame) -> DataFrame:
    """Integrated decisions with final statuses and, where reviewed, what the review said."""
    r = results.select("session_id", "decision_id", "final_status", F.struct("group_id", "final_status", "rationale", "evidence_refs", "confidence", "missing_information").alias("lifecycle_review"))
    d = integrated.join(r, ["session_id", "decision_id"], "left").withColumn("status_before", F.col("status"))
    return d.withColumn("status", F.coalesce("final_status", "status")).drop("final_status")


def changes(applied: DataFrame) -> DataFrame:
    return applied.where("status <> status_before").select("session_id", "decision_id", "status_before", F.col("status").alias("status_after"))


def summary(applied: DataFrame) -> DataFrame:
    """status, decisions before and after."""
    b = applied.groupBy(F.col("status_before").alias("status")).agg(F.count(F.lit(1)).alias("before"))
    a = applied.groupBy("status").agg(F.count(F.lit(1)).alias("after"))
    return b.join(a, "status", "full").na.fill(0, ["before", "after"])
