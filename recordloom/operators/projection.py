"""Projection of normalised events into what an analyst reads: messages, constraints and implementation events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import strip, strip_blocks

# The file that names project instructions, the tags they stand in, and the heading before a block in a dialogue.
MARKER, BLOCK = "AGENTS.md", r"(?isU)<INSTRUCTIONS>\s*(.*?)\s*</INSTRUCTIONS>"
HEADED_BLOCK = r"(?isU)(?:^|\n)\s*# AGENTS\.md instructions[^\n]*\n+\s*<INSTRUCTIONS>.*?</INSTRUCTIONS>"


#: Lines of a log whose messages may stand in one line of a bundle's document.
PART = 10_000


def part_of(line: Column, lines: int | None = None) -> Column:
    """The part of a document, from 0, that a source line's rows stand in. A document of more lines is several rows, so that none grows with its session."""
    return F.greatest(F.floor((line - 1) / (lines or PART)), F.lit(0)).cast("int")


def strip_constraints(c):
    """Without blocks that stand behind their heading, and without that heading; other blocks are dialogue."""
    return F.regexp_replace(c, HEADED_BLOCK, "")


def messages(events: DataFrame) -> DataFrame:
    """Dialogue: actor human or assistant, text without constraint and client blocks, stripped, not blank."""
    spoken = events.where((F.col("kind") == "message") & F.col("role").isin("user", "assistant"))
    text = strip(strip_blocks(strip_constraints(F.coalesce("content", F.lit("")))))
    actor = F.when(F.col("role") == "user", "human").otherwise("assistant")
    return spoken.select("session_id", "id", actor.alias("actor"), text.alias("content"), "source_line").where("content <> ''")


def constraints(events: DataFrame) -> DataFrame:
    """Blocks of any role's messages, numbered within the message before blank ones go; a session keeps the first of each text."""
    found = events.where((F.col("kind") == "message") & F.contains(F.coalesce("content", F.lit("")), F.lit(MARKER)))
    each = found.select("session_id", "id", "source_line", F.posexplode(F.regexp_extract_all("content", F.lit(BLOCK), 1)).alias("n", "text")).withColumn("content", strip(F.col("text"))).where("content <> ''")
    first = W.partitionBy("session_id", "content").orderBy("source_line", "n")
    kept = each.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return kept.select("session_id", F.format_string("%s-constraint-%03d", F.col("id"), F.col("n") + 1).alias("id"), F.col("id").alias("source_message_id"), F.lit(MARKER).alias("source"), "content", "source_line")


def first_occurrence(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. One aggregate combined on the map side, as a key may hold a third of all rows."""
    least = df.groupBy(*keys).agg(F.min(F.struct(*order, *(F.col(c) for c in df.columns if c not in keys))).alias("_r"))
    return least.select(*keys, *(F.col(f"_r.{c}") for c in df.columns if c not in keys))


def implementation_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin("file_change", "command")).select("session_id", "id", "kind", "source_event_type", "source_line", "content")


def with_evidence(projected: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with evidence_id and section_id by source line, and violations (missing evidence, other actor)."""
    e = evidence.select("session_id", F.col("raw_line").alias("source_line"), F.col("message_id").alias("evidence_id"), F.col("actor").alias("_actor"), "section_id")
    d = projected.join(e, ["session_id", "source_line"], "left")
    message = F.when(F.col("evidence_id").isNull(), F.format_string("no normalized message for line %d", F.col("source_line"))).when(
        F.col("_actor") != F.col("actor"), F.format_string("actor differs for line %d", F.col("source_line")))
    bad = d.select("session_id", F.col("source_line").alias("ord"), message.alias("message")).where("message is not null")
    return d.drop("_actor"), bad


def report(events: DataFrame) -> DataFrame:
    """Per session: messages, constraints, implementation events and what was left out."""
    count = lambda d, name: d.groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
    made = count(events, "normalized_events")
    for d, name in ((messages(events), "messages"), (constraints(events), "constraints"), (implementation_events(events), "implementation_events")):
        made = made.join(count(d, name), "session_id", "left")
    return made.na.fill(0)


def project(events: DataFrame, said: DataFrame | None = None, parts: bool = False) -> DataFrame:
    """One nested document per session, in source order: for a JSON sink only. With parts, a row for each part of it. said: its messages, if they
    aren't messages(events), with session_id and source_line."""
    by = ["session_id", *(["part"] if parts else [])]
    dealt = lambda d: d.withColumn("part", part_of(F.col("source_line"))) if parts else d
    ordered = lambda d, *cols: dealt(d).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("source_line", *cols))).alias("x"))
    said = messages(events).select("session_id", "source_line", "id", "actor", "content") if said is None else said
    made_of = [("messages", ordered(said, *(c for c in said.columns if c not in ("session_id", "source_line")))), ("constraints", ordered(constraints(events), "id", "source_message_id", "source", "content")),
               ("implementation_events", ordered(implementation_events(events), "id", "kind", "source_event_type", "content"))]
    made = dealt(events).select(*by).distinct()
    for name, d in made_of:
        made = made.join(d.withColumnRenamed("x", name), by, "left")
    return made
