"""Lossless normalisation of log lines: every line becomes one raw and one normalised event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shape import INFINITE, NAN, at, first_text, is_kind, items, text_at, with_json
from ..functions.text import event_id

#: Types that the adapter knows.
TOP_TYPES = ("session_meta", "event_msg", "response_item", "world_state", "turn_context", "compacted")
METADATA_TYPES = ("session_meta", "world_state", "turn_context", "compacted")
MESSAGE_METADATA = ("task_started", "task_complete", "thread_settings_applied", "token_count", "agent_reasoning", "context_compacted", "turn_aborted", "user_message", "agent_message")
MESSAGE_TOOL = ("web_search_end", "mcp_tool_call_end")
MESSAGE_FILE_CHANGE = ("patch_apply_end",)
CALLS = ("custom_tool_call", "custom_tool_call_output", "function_call", "function_call_output")


def parse(lines: DataFrame) -> DataFrame:
    """Adds raw (VARIANT; null unless the line is a JSON object), parsed_ok, event_type and timestamp (JSON strings only). What counts
    as JSON, and what is kept of lines with NaN or of great depth, is with_json's matter; raw_text has all of every line."""
    d = with_json(lines, "raw_text", "_any", "parsed_ok")
    d = d.withColumn("raw", F.when(is_kind(F.col("_any"), "OBJECT"), F.col("_any"))).drop("_any")
    return d.withColumn("event_type", text_at(F.col("raw"), "type")).withColumn("timestamp", text_at(F.col("raw"), "timestamp"))


def event_message_kind(subtype: Column) -> Column:
    return F.when(subtype.isin(*MESSAGE_METADATA), "metadata").when(subtype.isin(*MESSAGE_TOOL), "tool").when(subtype.isin(*MESSAGE_FILE_CHANGE), "file_change").otherwise("unknown")


def response_kind(subtype: Column, name: Column) -> Column:
    call = F.when(name == "shell_command", "command").when(name == "apply_patch", "file_change").otherwise("tool")
    return F.when(subtype == "message", "message").when(subtype == "reasoning", "metadata").when(subtype.isin(*CALLS), call).otherwise("unknown")


def content_text(v: Column) -> Column:
    """A string as it is; of an array, each object's first string among text, input_text, output_text, by blank lines."""
    texts = F.filter(F.transform(items(v), lambda x: first_text(x, "text", "input_text", "output_text")), lambda x: x.isNotNull())
    return F.when(is_kind(v, "STRING"), v.cast("string")).when(F.size(texts) > 0, F.array_join(texts, "\n\n"))


def summary(top: Column, payload: Column) -> Column:
    """type:subtype, or the type where the subtype is missing, empty, null, false or zero. True, NaN and the infinities are written as
    the log's own tools write them."""
    v, said = at(payload, "type"), at(payload, "type").cast("string")
    number = F.when(is_kind(v, "DOUBLE"), said.cast("double"))
    sub = (F.when(is_kind(v, "BOOLEAN") & (said == "true"), "True").when(number == NAN, "nan").when(number >= INFINITE, "inf").when(number <= -INFINITE, "-inf").otherwise(said))
    blank = sub.isNull() | is_kind(at(payload, "type"), "VOID") | sub.isin("", "false", "0")
    return F.when(blank, top).otherwise(F.concat_ws(":", top, sub))


def can_handle(raw: Column) -> Column:
    return F.coalesce(text_at(raw, "type").isin(*TOP_TYPES), F.lit(False)) & is_kind(at(raw, "payload"), "OBJECT")


def classify(parsed: DataFrame) -> DataFrame:
    """Adds kind, role and content. Order matters: a line without JSON, then one without a payload object, then by type."""
    d = parsed.withColumn("_p", at(F.col("raw"), "payload"))
    p, top = F.col("_p"), F.col("event_type")
    subtype, name = text_at(p, "type"), text_at(p, "name")
    has = is_kind(p, "OBJECT")
    kind = (F.when(~F.col("parsed_ok"), "parse_error").when(~has, "unknown").when(top.isin(*METADATA_TYPES), "metadata")
            .when(top == "event_msg", event_message_kind(subtype)).when(top == "response_item", response_kind(subtype, name)).otherwise("unknown"))
    response = F.when(subtype == "message", content_text(at(p, "content"))).when(subtype == "reasoning", content_text(at(p, "summary"))).when(
        subtype.isin(*CALLS), first_text(p, "name", "arguments", "input", "output"))
    content = F.when(~F.col("parsed_ok") | ~has, F.lit(None).cast("string")).when(top.isin(*METADATA_TYPES), summary(top, p)).when(
        top == "event_msg", first_text(p, "message", "text", "reason", "info")).when(top == "response_item", response)
    d = d.withColumn("kind", kind).withColumn("content", content)
    return d.withColumn("role", F.when((top == "response_item") & (F.col("kind") == "message"), text_at(p, "role"))).drop("_p")


#: Adapters by name: each takes parsed lines and adds kind, role and content.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"default": classify}


def adapted(lines: DataFrame, adapter: str = "default") -> DataFrame:
    """Lines with all that their raw and normalised events hold, to be stored where several readers would parse them anew."""
    d = ADAPTERS[adapter](parse(lines)).drop("raw")
    raw_id = F.format_string("%s-raw-%06d", F.col("session_id"), F.col("source_line"))
    return d.withColumn("raw_event_id", raw_id).withColumn("id", event_id(F.col("session_id"), F.col("kind"), F.col("source_line")))


def normalize(lines: DataFrame, adapter: str = "default") -> tuple[DataFrame, DataFrame]:
    """(raw events, normalised events) of log lines; a row each per line."""
    return events_of(adapted(lines, adapter))


def events_of(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw events, normalised events) of adapted lines."""
    raw = d.select(F.col("raw_event_id").alias("id"), "session_id", "source_line", "raw_text", "parsed_ok", "event_type", "timestamp")
    return raw, d.select("id", "session_id", "raw_event_id", "source_line", F.col("event_type").alias("source_event_type"), "kind", "role", "timestamp", "content")


def kind_counts(events: DataFrame, by: str = "session_id") -> DataFrame:
    return events.groupBy(by, "kind").agg(F.count(F.lit(1)).alias("n"))


def loss_report(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Per session: total_lines, recognized, unknown, parse_errors and silently_dropped, the last by a real comparison."""
    e = events.select("session_id", F.col("raw_event_id").alias("id"), "kind").withColumn("_in", F.lit(True))
    d = raw.select("session_id", "id").join(e, ["session_id", "id"], "left")
    return d.groupBy("session_id").agg(
        F.countDistinct("id").alias("total_lines"), F.count_if(~F.coalesce(F.col("kind").isin("unknown", "parse_error"), F.lit(True))).alias("recognized"),
        F.count_if(F.col("kind") == "unknown").alias("unknown"), F.count_if(F.col("kind") == "parse_error").alias("parse_errors"),
        F.count_if(F.col("_in").isNull()).alias("silently_dropped"))
