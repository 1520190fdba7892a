"""Markdown of conversations and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import role_title


def conversation(events: DataFrame, by: str = "session_id") -> DataFrame:
    """One document per session: a heading, role, text and source line per message."""
    part = F.concat(F.lit("### "), "id", F.lit("\n\n**"), role_title(F.col("role")), F.lit("**\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\nSource JSONL line: "), F.col("source_line").cast("string"), F.lit("\n\n---\n"))
    each = events.select(by, F.struct("source_line", "id", part.alias("part")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda v: v["part"]), "\n")
    return each.groupBy(by).agg(F.concat(F.lit("# Conversation\n\n"), body).alias("markdown"))


def _section(title: str, values: Column) -> Column:
    return F.concat(F.lit(f"### {title}\n\n"), F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(F.transform(values, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- なし"), F.lit("\n"))


def decisions(found: DataFrame, by: str = "session_id") -> DataFrame:
    """One document per session, a chapter per decision in order of ids, with links to the cited messages."""
    rejected = F.when(F.size("rejected_alternatives") > 0, F.array_join(F.transform("rejected_alternatives", lambda r: F.concat(F.lit("- "), r["alternative"], F.lit("\n  - "), r["reason"])), "\n")).otherwise("- なし")
    links = F.array_join(F.transform("evidence_message_ids", lambda m: F.concat(F.lit("- ["), m, F.lit("](conversation.md#"), m, F.lit(")"))), "\n")
    context = F.when(F.coalesce("context", F.lit("")) == "", "記録なし").otherwise(F.col("context"))
    part = F.concat(F.lit("## "), "decision_id", F.lit(" "), "title", F.lit("\n\n### 決定\n\n"), "decision", F.lit("\n\n### 状態\n\n"), "status", F.lit("\n\n### 背景\n\n"), context, F.lit("\n\n"),
                    _section("比較案", F.col("alternatives")), F.lit("\n"), _section("採用理由", F.col("rationale")), F.lit("\n### 却下理由\n\n"), rejected, F.lit("\n\n"), _section("リスク", F.col("risks")), F.lit("\n"),
                    _section("見直し条件", F.col("revisit_conditions")), F.lit("\n"), _section("不足情報", F.col("missing_information")), F.lit("\n### Confidence\n\n"), "confidence", F.lit("\n\n### 根拠\n\n"), links, F.lit("\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("decision_id", part.alias("part")))), lambda v: v["part"]), "\n")
    return found.groupBy(by).agg(F.concat(F.lit("# 意思決定一覧\n\n"), body).alias("markdown"))
