"""Sections of a session: membership checks, fan-out and the as-of assignment of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import section_number


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """left with value of the latest right row of the same key at or before its time; null if there is none.

    Both sides are laid on one line per key and the last value is carried on, so one shuffle on the key does it. Of right
    rows at one time the largest value counts.
    """
    r = right.groupBy(*by, time).agg(F.max(value).alias(value)).withColumn("_left", F.lit(0))
    l = left.withColumn("_left", F.lit(1))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    run = W.partitionBy(*by).orderBy(time, "_left").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(run)).where("_left = 1").drop("_left")


def assign_events(events: DataFrame, messages: DataFrame) -> DataFrame:
    """Implementation events with the section of the latest message at or before their line."""
    return asof(events.drop("section_id"), messages.select("session_id", "source_line", "section_id"), ["session_id"], "source_line", "section_id")


def membership_violations(messages: DataFrame, index: DataFrame) -> DataFrame:
    """Both directions between messages (section_id, evidence_id) and index (section_id, message_ids)."""
    listed = index.select("section_id", F.explode("message_ids").alias("evidence_id")).distinct()
    have = messages.select("section_id", "evidence_id").distinct()
    a = have.join(listed, ["section_id", "evidence_id"], "left_anti").select(F.lit(0).alias("ord"), F.concat_ws(" ", F.lit("message is not listed in its section:"), "evidence_id").alias("message"))
    b = listed.join(have, ["section_id", "evidence_id"], "left_anti").select(F.lit(1).alias("ord"), F.concat_ws(" ", F.lit("listed message is missing:"), "evidence_id").alias("message"))
    return a.unionByName(b)


def attachment_sections(attachments: DataFrame) -> DataFrame:
    """A row per attachment and section that it belongs to."""
    return attachments.withColumn("section_id", F.explode("section_ids")).drop("section_ids")


def attachment_violations(attachments: DataFrame, messages: DataFrame, index: DataFrame) -> DataFrame:
    """Unknown parents, and attachments that their section doesn't list."""
    parents = attachments.select("attachment_id", F.explode("parent_message_ids").alias("evidence_id"))
    a = parents.join(messages.select("evidence_id"), "evidence_id", "left_anti").select(F.lit(0).alias("ord"), F.format_string("unknown parent %s of %s", "evidence_id", "attachment_id").alias("message"))
    listed = index.select("section_id", F.explode("attachment_ids").alias("attachment_id"))
    b = attachment_sections(attachments).join(listed, ["section_id", "attachment_id"], "left_anti").select(F.lit(1).alias("ord"), F.format_string("attachment %s is not listed in %s", "attachment_id", "section_id").alias("message"))
    return a.unionByName(b)


def input_violations(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Of normalised inputs: repeated lines and ids, other actors, unknown parents."""
    twice = lambda d, c, text: d.groupBy(c).count().where("count > 1").select(F.lit(0).alias("ord"), F.format_string(text, F.col(c).cast("string")).alias("message"))
    actor = messages.where(~F.coalesce(F.col("actor").isin("human", "assistant", "context"), F.lit(False))).select(F.lit(1).alias("ord"), F.format_string("invalid actor of %s", "message_id").alias("message"))
    parents = attachments.select("attachment_id", F.explode("parent_message_ids").alias("message_id")).join(messages.select("message_id"), "message_id", "left_anti")
    parents = parents.select(F.lit(2).alias("ord"), F.format_string("unknown parent %s of %s", "message_id", "attachment_id").alias("message"))
    return (twice(messages, "raw_line", "duplicate line %s").unionByName(twice(messages, "message_id", "duplicate message id %s"))
            .unionByName(twice(attachments, "attachment_id", "duplicate attachment id %s")).unionByName(actor).unionByName(parents))


def neighbors(messages: DataFrame) -> DataFrame:
    """Each message with the previous and next message of its section, as context only."""
    w = W.partitionBy("session_id", "section_id").orderBy("source_line", "evidence_id")
    item = F.struct("evidence_id", "actor", "source_line", "content")
    return messages.withColumn("previous", F.lag(item).over(w)).withColumn("next", F.lead(item).over(w))


def context_order(line: Column, evidence_id: Column) -> Column:
    """Sort key of context rows: a missing line and line 0 both count as -1."""
    return F.struct(F.when(F.coalesce(line, F.lit(0)) == 0, -1).otherwise(line).alias("line"), evidence_id.alias("id"))


def window_sections(groups: DataFrame, sections: DataFrame, reach: int = 2) -> DataFrame:
    """Range join by enumeration: each group's section n with the existing sections n to n + reach."""
    wanted = groups.withColumn("_n", section_number(F.col("section_id"))).withColumn("_m", F.explode(F.sequence(F.col("_n"), F.col("_n") + reach)))
    have = sections.select("session_id", F.col("section_id").alias("context_section_id"), section_number(F.col("section_id")).alias("_m")).distinct()
    return wanted.join(have, ["session_id", "_m"]).drop("_n", "_m")
