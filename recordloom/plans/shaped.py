"""Queries whose inputs are shaped, by the rows of whole tables, so that each rule of an operator bites; with their DuckDB SQL.

A shape is a fixed input with what must come of it. A row takes the shape that its numbers point to; the SQL states the outcome
by itself and never repeats the operator's logic.
"""

from __future__ import annotations

import contextlib
import io
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import errors
from ..functions.shape import add_counts, first_text
from ..functions.text import matches, normalized, role_title, section_number
from ..operators import assembly, clusters, lifecycle, normalize, projection, render, sections, signals, validation
from ..session import shared_dir, stored
from ..sources import logs, sinks
from . import verbs

SQL: dict[str, str] = {}
QUERIES: list = []


def query(sql: str):
    """Registers a query with its SQL."""
    def add(f):
        QUERIES.append(f)
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chats(spark, sf) -> DataFrame:
    """conversations as strings and ints: c (conv_id), s (its text), t (turn), role, text."""
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("c"), F.col("conv_id").cast("string").alias("s"), F.col("turn").cast("int").alias("t"), "role", "text")


CHATS = "ch AS (SELECT conv_id AS c, CAST(conv_id AS VARCHAR) AS s, CAST(turn AS INTEGER) AS t, role, text FROM conversations)"


def literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    """A table of fixed rows, numbered from 0 in column i."""
    return f"{name}(i, {columns}) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(literal, r))})" for i, r in enumerate(rows)) + ")"


def chosen(options: list, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (index + 1).cast("int"))


def own_dir(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Log lines. Line, timestamp, type, kind, role, content, whether an adapter takes it, whether it is JSON. @ is the event's id.
LINES = (
    ('{"timestamp":"t@","type":"session_meta","payload":{"id":"@"}}', "t@", "session_meta", "metadata", None, "session_meta", True, True),
    ('{"timestamp":5,"type":"event_msg","payload":{"type":"token_count","info":"i@"}}', None, "event_msg", "metadata", None, "i@", True, True),
    ('{"type":"event_msg","payload":{"type":"web_search_end","text":"w@"}}', None, "event_msg", "tool", None, "w@", True, True),
    ('{"type":"event_msg","payload":{"type":"mcp_tool_call_end","message":5,"reason":"r@"}}', None, "event_msg", "tool", None, "r@", True, True),
    ('{"type":"event_msg","payload":{"type":"patch_apply_end","message":"m@"}}', None, "event_msg", "file_change", None, "m@", True, True),
    ('{"type":"event_msg","payload":{"type":"later","message":"q@"}}', None, "event_msg", "unknown", None, "q@", True, True),
    ('{"type":"response_item","payload":{"type":"message","role":"user","content":"u@"}}', None, "response_item", "message", "user", "u@", True, True),
    ('{"type":"response_item","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":"a@"},{"input_text":"b@"},{"output_text":7},{"text":3,"output_text":"c@"},9]}}', None, "response_item", "message", "assistant", "a@\n\nb@\n\nc@", True, True),
    ('{"type":"response_item","payload":{"type":"message","role":5,"content":[]}}', None, "response_item", "message", None, None, True, True),
    ('{"type":"response_item","payload":{"type":"reasoning","role":"assistant","summary":[{"text":"s@"}]}}', None, "response_item", "metadata", None, "s@", True, True),
    ('{"type":"response_item","payload":{"type":"function_call","name":"shell_command","arguments":"ls @"}}', None, "response_item", "command", None, "shell_command", True, True),
    ('{"type":"response_item","payload":{"type":"custom_tool_call","name":"apply_patch","input":"p"}}', None, "response_item", "file_change", None, "apply_patch", True, True),
    ('{"type":"response_item","payload":{"type":"function_call_output","output":"o@"}}', None, "response_item", "tool", None, "o@", True, True),
    ('{"type":"response_item","payload":{"type":"custom_tool_call_output","name":5,"input":"i@"}}', None, "response_item", "tool", None, "i@", True, True),
    ('{"type":"response_item","payload":{"type":"later","text":"x"}}', None, "response_item", "unknown", None, None, True, True),
    ('{"type":"world_state","payload":{"type":"x@"}}', None, "world_state", "metadata", None, "world_state:x@", True, True),
    ('{"type":"turn_context","payload":{"type":0}}', None, "turn_context", "metadata", None, "turn_context", True, True),
    ('{"type":"compacted","payload":{"type":""}}', None, "compacted", "metadata", None, "compacted", True, True),
    ('{"type":"new_future_event","payload":{"x":@}}', None, "new_future_event", "unknown", None, None, False, True),
    ('{"type":"response_item","payload":[@]}', None, "response_item", "unknown", None, None, False, True),
    ("no json @", None, None, "parse_error", None, None, False, False),
    ("", None, None, "parse_error", None, None, False, False),
    ("[@]", None, None, "unknown", None, None, False, True),
    ('{"type":7,"payload":{}}', None, None, "unknown", None, None, False, True),
    ('{"type":"event_msg","type":"session_meta","payload":{}}', None, "session_meta", "metadata", None, "session_meta", True, True),
    ('{"type":"response_item","payload":{"type":"message","role":"user","content":"n@","score":NaN}}', None, "response_item", "message", "user", "n@", True, True),
    ('{"type":"turn_context","payload":{"type":-Infinity,"x":@}}', None, "turn_context", "metadata", None, "turn_context:-inf", True, True),
    ('{"type":"turn_context","payload":{"type":NaN,"x":1,"x":@}}', None, "turn_context", "metadata", None, "turn_context:nan", True, True),
    ('{"type":"response_item","payload":{"type":"message","role":"user","content":"d@","deep":' + "[" * 1500 + "]" * 1500 + "}}", None, "response_item", "message", "user", "d@", True, True),
    ('{"type":"event_msg","payload":{"type":"user_message","message":"@"}} {"a":1}', None, None, "parse_error", None, None, False, False),
    ('{"type":"event_msg","payload":{"type":"user_message","message":"@"}}}', None, None, "parse_error", None, None, False, False),
)


def lines_of(spark, sf) -> DataFrame:
    """Users' events as log lines of all shapes; a user's every seventh to the next event share a session."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"))
    return e.select("session_id", (F.col("event_id") + 1).cast("int").alias("source_line"), F.replace(chosen([x[0] for x in LINES], F.col("event_id") % len(LINES)), F.lit("@"), F.col("event_id").cast("string")).alias("raw_text"))


_LINES = values("sh", "line, stamp, type, kind, role, content, takes, ok", LINES)
_EACH = f"{_LINES}, ln AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, CAST(event_id + 1 AS INTEGER) AS source_line, replace(line, '@', event_id::VARCHAR) AS line, replace(stamp, '@', event_id::VARCHAR) AS stamp, type, kind, role, replace(content, '@', event_id::VARCHAR) AS content, takes, ok FROM events JOIN sh ON event_id % {len(LINES)} = i)"


@query(f"WITH {_EACH} SELECT session_id || CASE kind WHEN 'message' THEN '-msg-' ELSE '-evt-' END || lpad(source_line::VARCHAR, 6, '0') AS id, source_line, stamp AS timestamp, type AS source_event_type, kind, role, content FROM ln")
def prj03_kinds(spark, sf):
    """PRJ-01 to PRJ-08, FN-10."""
    return normalize.normalize(lines_of(spark, sf))[1].select("id", "source_line", "timestamp", "source_event_type", "kind", "role", "content")


@query(f"WITH {_EACH} SELECT session_id || '-raw-' || lpad(source_line::VARCHAR, 6, '0') AS id, takes, ok FROM ln")
def prj09_can_handle(spark, sf):
    """PRJ-01, PRJ-09."""
    return normalize.parse(lines_of(spark, sf)).select(F.format_string("%s-raw-%06d", "session_id", "source_line").alias("id"), normalize.can_handle(F.col("raw")).alias("takes"), F.col("parsed_ok").alias("ok"))


@query(f"""WITH {_EACH} SELECT session_id, count(*) AS total_lines, count(*) FILTER (source_line % 11 <> 0 AND kind NOT IN ('unknown', 'parse_error')) AS recognized, count(*) FILTER (source_line % 11 <> 0 AND kind = 'unknown') AS unknown,
    count(*) FILTER (source_line % 11 <> 0 AND kind = 'parse_error') AS parse_errors, count(*) FILTER (source_line % 11 = 0) AS silently_dropped FROM ln GROUP BY 1""")
def agg02_lost_lines(spark, sf):
    """AGG-02: every eleventh normalised event is lost."""
    raw, e = normalize.normalize(lines_of(spark, sf))
    return normalize.loss_report(raw, e.where("source_line % 11 <> 0"))


@query(f"WITH {_EACH} SELECT session_id, session_id || '-msg-' || lpad(source_line::VARCHAR, 6, '0') AS evidence_id FROM ln WHERE kind = 'message'")
def src11_message_ids(spark, sf):
    """SRC-11."""
    return logs.message_ids(normalize.normalize(lines_of(spark, sf))[1])


@query(f"WITH {_EACH}, one AS (SELECT min(session_id) AS session_id FROM ln) SELECT 'all' AS which, source_line, kind, row_number() OVER (ORDER BY source_line) AS n FROM ln JOIN one USING (session_id) UNION ALL SELECT 'messages', source_line, kind, row_number() OVER (ORDER BY source_line) FROM ln JOIN one USING (session_id) WHERE kind = 'message'")
def src09_session_events(spark, sf):
    """SRC-09, SRT-01: one session's events and messages, numbered in order of line."""
    e = normalize.normalize(lines_of(spark, sf))[1]
    first = e.agg(F.min("session_id")).first()[0]
    n = F.row_number().over(Window.partitionBy("which").orderBy("source_line"))
    both = [logs.events_of(e, first, only).select(F.lit(name).alias("which"), "source_line", "kind") for name, only in (("all", False), ("messages", True))]
    return both[0].unionByName(both[1]).withColumn("n", n)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE 'y' || json_extract_string(props, '$.k') END AS first FROM events")
def prj06_first_string(spark, sf):
    """PRJ-06: k is a string in even events only."""
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    v = F.parse_json(F.when(F.col("event_id") % 2 == 0, F.format_string('{"k": "%s", "j": "y%s"}', "k", "k")).otherwise(F.format_string('{"k": %s, "j": "y%s"}', "k", "k")))
    return e.select("event_id", first_text(v, "k", "j").alias("first"))


# Files written from tables.


def log_files(spark, sf) -> str:
    """Log lines of all shapes in seven files, a session each."""
    path = own_dir(spark, "log-files")
    d = lines_of(spark, sf).withColumn("file", F.col("source_line") % 7)
    d.repartition(7, "file").sortWithinPartitions("file", "source_line").select("file", "raw_text").write.partitionBy("file").text(path)
    return path


_FILES = f"{_EACH}, fl AS (SELECT *, source_line % 7 AS f, row_number() OVER (PARTITION BY source_line % 7 ORDER BY source_line) AS n FROM ln), sha AS (SELECT f, sha256(string_agg(line || chr(10), '' ORDER BY n)) AS sha, count(*) AS rows FROM fl GROUP BY 1)"


@query(f"WITH {_FILES} SELECT sha AS source_sha256, substr(sha, 1, 16) AS session_id, CAST(n AS INTEGER) AS source_line, line AS raw_text FROM fl JOIN sha USING (f)")
def src01_lines(spark, sf):
    """SRC-01, SRC-02."""
    return logs.read_log(spark, f"{log_files(spark, sf)}/*/*").select("source_sha256", "session_id", "source_line", "raw_text")


@query(f"""WITH {_FILES} SELECT substr(sha, 1, 16) AS session_id, count(*) AS total_lines, count(*) FILTER (kind NOT IN ('unknown', 'parse_error')) AS recognized, 7 AS sessions, (SELECT count(*) FROM ln) AS stored, 'already_ingested' AS again
    FROM fl JOIN sha USING (f) GROUP BY 1""")
def snk01_ingest(spark, sf):
    """SRC-03, SNK-01, HLP-01, VAL-11: files are loaded after a run that died, and again."""
    files, store = log_files(spark, sf), own_dir(spark, "store")
    lines = logs.read_log(spark, f"{files}/*/*")
    raw, events = normalize.events_of(stored(normalize.adapted(lines), "adapted"))
    raw.write.parquet(f"{store}/raw_events/commit=died")  # a writer that died before its entry: never seen
    events.write.parquet(f"{store}/events/commit=died")
    first = verbs.ingest(spark, f"{files}/*/*", store)
    again = verbs.ingest(spark, f"{files}/*/*", store)[0]["status"]
    sessions = verbs.stored(spark, store, "sessions", verbs.SESSIONS).count()
    seen = sum(verbs.events_in(spark, store, r["session_id"]).count() for r in first)
    rows = [(r["session_id"], r["total_lines"], r["recognized"], sessions, seen, again) for r in first]
    return spark.createDataFrame(rows, "session_id string, total_lines long, recognized long, sessions int, stored long, again string")


@query("SELECT CAST(conv_id AS VARCHAR) AS id, conv_id % 2 = 0 AS found FROM (SELECT DISTINCT conv_id FROM conversations ORDER BY 1 LIMIT 4)")
def src10_sessions(spark, sf):
    """SRC-10: four probes of sessions, every second of which is stored."""
    have = chats(spark, sf).where("c % 2 = 0").select(F.col("s").alias("id"))
    ids = [r["s"] for r in chats(spark, sf).select("c", "s").distinct().orderBy("c").limit(4).collect()]
    return spark.createDataFrame([(i, logs.session_exists(have, i)) for i in ids], "id string, found boolean")


_INPUTS = f"""{CHATS}, im AS (SELECT c * 8 + t - CASE WHEN t = 3 THEN 1 ELSE 0 END AS raw_line, s || ':' || CASE WHEN t = 5 THEN 4 ELSE t END AS id, CASE role WHEN 'user' THEN 'human' ELSE role END AS actor FROM ch),
    ia AS (SELECT DISTINCT c, s FROM ch)"""
_KNOWN = "('human', 'assistant', 'context')"


@query(f"""WITH {_INPUTS} SELECT 0 AS ord, 'duplicate line ' || raw_line AS message FROM im GROUP BY raw_line HAVING count(*) > 1 UNION ALL SELECT 0, 'duplicate message id ' || id FROM im GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 0, 'duplicate attachment id A' || (c // 2) FROM ia GROUP BY c // 2 HAVING count(*) > 1 UNION ALL SELECT 1, 'invalid actor of ' || id FROM im WHERE actor NOT IN {_KNOWN}
    UNION ALL SELECT 2, 'unknown parent gone:' || s || ' of A' || (c // 2) FROM ia WHERE c % 4 = 0""")
def src04_inputs(spark, sf):
    """SRC-04, VAL-04, JON-02: messages and attachments as JSON lines, with blank ones among them."""
    d, path = chats(spark, sf), own_dir(spark, "inputs")
    m = d.select((F.col("c") * 8 + F.col("t") - F.when(F.col("t") == 3, 1).otherwise(0)).cast("int").alias("raw_line"), F.concat_ws(":", "s", F.when(F.col("t") == 5, 4).otherwise(F.col("t")).cast("string")).alias("message_id"),
                 F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("actor"), F.lit("SEC-001").alias("section_id"))
    parents = F.when(F.col("c") % 4 == 0, F.array(F.concat(F.col("s"), F.lit(":0")), F.concat(F.lit("gone:"), F.col("s")))).otherwise(F.array(F.concat(F.col("s"), F.lit(":0"))))
    a = d.select("c", "s").distinct().select(F.concat(F.lit("A"), F.floor(F.col("c") / 2).cast("string")).alias("attachment_id"), parents.alias("parent_message_ids"), F.array(F.lit("SEC-001")).alias("section_ids"), F.col("s").alias("content"))
    for name, x in (("m", m), ("a", a)):
        x.select(F.explode(F.array(F.to_json(F.struct(*x.columns)), F.lit(""))).alias("value")).write.text(f"{path}/{name}")
    return sections.input_violations(logs.read_jsonl(spark, f"{path}/m", m._jdf.schema().toDDL()), logs.read_jsonl(spark, f"{path}/a", a._jdf.schema().toDDL()))


@query("""WITH d AS (SELECT turn, CASE WHEN turn % 2 = 0 THEN chr(65279) ELSE '' END || '{"n": ' || count(*) || '}' AS doc FROM conversations GROUP BY turn)
    SELECT 'SEC-' || lpad((turn + 1)::VARCHAR, 3, '0') AS section_id, CAST(turn + 1 AS INTEGER) AS section_number, CASE WHEN turn % 4 = 1 THEN 'decisions.validated.json' ELSE 'decisions.raw.json' END AS name, sha256(doc) AS sha256,
    CAST(json_extract(ltrim(doc, chr(65279)), '$.n') AS BIGINT) AS n, turn % 3 <> 0 AS hash_matches FROM d""")
def src05_documents(spark, sf):
    """SRC-05 to SRC-08, SRC-13, SRT-02: section folders with raw and validated documents, some with a byte-order mark; every third
    hash is recorded wrongly."""
    root, rec = own_dir(spark, "sections"), []
    for r in chats(spark, sf).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        name, text = f"SEC-{r['t'] + 1:03d}", ("﻿" if r["t"] % 2 == 0 else "") + f'{{"n": {r["n"]}}}'
        better = r["t"] % 4 == 1
        sinks.write_text(spark, f"{root}/sections/{name}/decisions.raw.json", '{"n": -1}' if better else text)
        if better:
            sinks.write_text(spark, f"{root}/sections/{name}/decisions.validated.json", text)
        rec.append((name, r["t"] % 3 != 0, "decisions.validated.json" if r["t"] % 4 < 2 else None))
    sinks.write_text(spark, f"{root}/sections/SEC-00x/decisions.raw.json", "{}")
    files = logs.section_files(spark, root, "*.json").withColumn("name", F.element_at(F.split("path", "/"), -1))
    right = files.select("section_id", "name", "sha256")
    said = spark.createDataFrame(rec, "section_id string, good boolean, validated_output_path string")
    hash_of = lambda name: F.first(F.when(F.col("name") == name, F.col("sha256")), True)
    told = right.groupBy("section_id").agg(hash_of("decisions.raw.json").alias("output_sha256"), hash_of("decisions.validated.json").alias("validated_output_sha256")).join(said, "section_id")
    told = told.withColumn("output_sha256", F.when(F.col("good"), F.col("output_sha256"))).withColumn("validated_output_sha256", F.when(F.col("good"), F.col("validated_output_sha256")))
    wanted = logs.preferred(told, right.select("section_id", "name")).select("section_id", F.col("decisions_name").alias("name"), "recorded_sha256")
    checked = logs.verify_hashes(files.join(wanted.select("section_id", "name"), ["section_id", "name"]), wanted, ["section_id"])
    return checked.select("section_id", "section_number", "name", "sha256", F.try_variant_get("doc", "$.n", "bigint").alias("n"), "hash_matches")


# Projection.

HEAD = "# AGENTS.md instructions for /w"
_SPOKEN = f"""{CHATS}, cv AS (SELECT *, (c + t) % 5 AS w, CASE WHEN role = 'system' THEN CASE WHEN c % 2 = 0 THEN 'file_change' ELSE 'command' END ELSE 'message' END AS kind, CASE WHEN role = 'assistant' AND c % 7 = 0 THEN 'developer' ELSE role END AS who FROM ch),
    ce AS (SELECT *, t + 1 AS source_line, s || CASE kind WHEN 'message' THEN '-msg-' ELSE '-evt-' END || lpad((t + 1)::VARCHAR, 6, '0') AS id,
    CASE w WHEN 0 THEN text || chr(10) || 'then ' || role WHEN 1 THEN 'see AGENTS.md: <INSTRUCTIONS>x</INSTRUCTIONS> ' || text WHEN 2 THEN '<INSTRUCTIONS>y</INSTRUCTIONS>' || text WHEN 3 THEN text END AS said FROM cv),
    ms AS (SELECT s, id, CASE who WHEN 'user' THEN 'human' ELSE 'assistant' END AS actor, regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS content, source_line FROM ce WHERE kind = 'message' AND who IN ('user', 'assistant') AND w <> 4),
    cn AS (SELECT s, arg_min(id, source_line) AS mid, txt, min(source_line) AS source_line FROM (SELECT *, CASE w WHEN 0 THEN 'rule' WHEN 1 THEN 'x' END AS txt FROM ce WHERE kind = 'message' AND w < 2) GROUP BY s, txt)"""


def spoken(spark, sf) -> DataFrame:
    """Conversations as events: blocks behind their heading, blocks without one, a client's blocks, messages of nothing else."""
    d = chats(spark, sf).withColumn("w", ((F.col("c") + F.col("t")) % 5).cast("int"))
    kind = F.when(F.col("role") == "system", F.when(F.col("c") % 2 == 0, "file_change").otherwise("command")).otherwise("message")
    text = (F.when(F.col("w") == 0, F.concat("text", F.lit(f"\n{HEAD}\n\n<INSTRUCTIONS>\n rule \n</INSTRUCTIONS>\nthen "), "role")).when(F.col("w") == 1, F.concat(F.lit("see AGENTS.md: <INSTRUCTIONS>x</INSTRUCTIONS> "), "text"))
            .when(F.col("w") == 2, F.concat(F.lit("<INSTRUCTIONS>y</INSTRUCTIONS>"), "text")).when(F.col("w") == 3, F.concat(F.lit('<environment_context cwd="/w">\n a \n</ENVIRONMENT_CONTEXT>'), "text")).otherwise(f"{HEAD} \n <instructions>  </instructions>"))
    d = d.select(F.col("s").alias("session_id"), (F.col("t") + 1).alias("source_line"), kind.alias("kind"), F.when((F.col("role") == "assistant") & (F.col("c") % 7 == 0), "developer").otherwise(F.col("role")).alias("role"), text.alias("content"))
    mark = F.when(F.col("kind") == "message", "msg").otherwise("evt")
    return d.withColumn("id", F.format_string("%s-%s-%06d", F.col("session_id"), mark, F.col("source_line"))).withColumn("source_event_type", F.lit("x"))


@query(f"WITH {_SPOKEN} SELECT s AS session_id, id, actor, content, source_line FROM ms")
def prj14_strip_constraints(spark, sf):
    """PRJ-10, PRJ-12, PRJ-14, FN-08."""
    return projection.messages(spoken(spark, sf))


@query(f"WITH {_SPOKEN} SELECT s AS session_id, mid || '-constraint-001' AS id, mid AS source_message_id, 'AGENTS.md' AS source, txt AS content, source_line FROM cn")
def prj13_constraints(spark, sf):
    """PRJ-13, WIN-03."""
    return projection.constraints(spoken(spark, sf))


@query(f"WITH {_SPOKEN} SELECT s AS session_id, id, kind, source_line FROM ce WHERE kind <> 'message'")
def prj11_implementation_events(spark, sf):
    """PRJ-11."""
    return projection.implementation_events(spoken(spark, sf)).select("session_id", "id", "kind", "source_line")


@query(f"""WITH {_SPOKEN} SELECT ce.s AS session_id, count(*) AS normalized_events, (SELECT count(*) FROM ms WHERE ms.s = ce.s) AS messages, (SELECT count(*) FROM cn WHERE cn.s = ce.s) AS constraints, count(*) FILTER (kind <> 'message') AS implementation_events FROM ce GROUP BY ce.s""")
def agg03_report(spark, sf):
    """AGG-03."""
    return projection.report(spoken(spark, sf))


@query(f"""WITH {_SPOKEN}, ev AS (SELECT s, t + 1 AS source_line, 'M-' || t AS evidence_id, CASE WHEN (role = 'user') = (t % 5 <> 2) THEN 'human' ELSE 'assistant' END AS actor FROM ch WHERE t % 4 <> 3)
    SELECT ms.s AS session_id, ms.source_line, ev.evidence_id, CASE WHEN ev.s IS NULL THEN 'no normalized message for line ' || ms.source_line WHEN ev.actor <> ms.actor THEN 'actor differs for line ' || ms.source_line END AS message
    FROM ms LEFT JOIN ev ON ms.s = ev.s AND ms.source_line = ev.source_line""")
def jon01_evidence(spark, sf):
    """JON-01: every fourth line has no evidence, others the wrong actor."""
    human = (F.col("role") == "user") == (F.col("t") % 5 != 2)
    ev = chats(spark, sf).where("t % 4 <> 3").select(F.col("s").alias("session_id"), (F.col("t") + 1).alias("raw_line"), F.concat(F.lit("M-"), "t").alias("message_id"), F.when(human, "human").otherwise("assistant").alias("actor"), F.lit("SEC-001").alias("section_id"))
    d, bad = projection.with_evidence(projection.messages(spoken(spark, sf)), ev)
    return d.select("session_id", "source_line", "evidence_id").join(bad.withColumnRenamed("ord", "source_line"), ["session_id", "source_line"], "left")


# Text functions.

# Roles and their titles.
TITLES = (("tool-call", "Tool-Call"), ("a_b", "A_B"), ("they're", "They'Re"), ("ÉCOLE x1y", "École X1Y"), ("中a", "中A"), (None, "Unknown"), ("", "Unknown"), ("user", "User"))


@query(f"WITH {values('sh', 'role, title', TITLES)} SELECT event_id, title FROM events JOIN sh ON event_id % {len(TITLES)} = i")
def fn09_role_title(spark, sf):
    """FN-09."""
    return table(spark, sf, "events").select("event_id", role_title(chosen([x[0] for x in TITLES], F.col("event_id") % len(TITLES))).alias("title"))


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS digest FROM documents")
def fn01_composed(spark, sf):
    """FN-01: letters in full width and ligatures, which composition turns back; every fourth text as it is."""
    wide = F.replace(F.translate("text", "abcxyz", "ａｂｃｘｙｚ"), F.lit("fi"), F.lit("ﬁ"))
    return table(spark, sf, "documents").select("doc_id", F.md5(normalized(F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(wide))).alias("digest"))


@query(f"WITH {CHATS} SELECT s, t, regexp_full_match('SEC-' || lpad((t + 1)::VARCHAR, 3, '0') || ':D-' || (90 + c), 'SEC-[0-9]{{3}}:D-[0-9]{{3}}') AS good FROM ch")
def fn11_ids(spark, sf):
    """FN-11."""
    return chats(spark, sf).select("s", "t", matches("SEC-[0-9]{3}:D-[0-9]{3}", F.concat(F.format_string("SEC-%03d:D-", F.col("t") + 1), (F.col("c") + 90).cast("string"))).alias("good"))


@query("SELECT p_partkey, CAST(p_partkey % 1000 AS INTEGER) AS n FROM part")
def hlp06_section_number(spark, sf):
    """HLP-06."""
    return table(spark, sf, "part").select("p_partkey", section_number(F.format_string("SEC-%03d", F.col("p_partkey") % 1000)).alias("n"))


@query("SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def fn17_counters(spark, sf):
    """FN-17: counts of even and odd events, added."""
    e = table(spark, sf, "events")
    part = lambda odd, name: e.where(f"event_id % 2 = {odd}").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(name))
    none = F.create_map().cast("map<string,bigint>")
    both = part(0, "a").join(part(1, "b"), "user_id", "full")
    return both.select("user_id", F.explode(add_counts(F.coalesce("a", none), F.coalesce("b", none))).alias("kind", "n"))


# Signals.

# Texts and the hits of the phrase rules in them.
PHRASES = (
    ("実装してください。採用します", "request_candidate@0実装して,acceptance_candidate@9採用します"), ("やめよう、保留ではなく", "rejection_candidate@0やめよう,uncertainty_candidate@5保留,alternative_candidate@7ではなく"),
    ("速いので、理由は", "reason_candidate@2ので,reason_candidate@5理由は"), ("no hint", ""), ("AをBではなくCで進めたい", "alternative_candidate@3ではなく,acceptance_candidate@8で進め"),
)


@query(f"WITH {CHATS}, {values('sh', 'text, hits', PHRASES)}, x AS (SELECT s || ':' || t AS evidence_id, unnest(string_split(hits, ',')) AS h FROM ch JOIN sh ON (c + t) % {len(PHRASES)} = i WHERE role <> 'system' AND hits <> '') SELECT evidence_id, regexp_extract(h, '^[a-z_]+') AS type, regexp_extract(h, '[0-9]+(.*)$', 1) AS trigger, CAST(regexp_extract(h, '@([0-9]+)', 1) AS INTEGER) AS char_start FROM x")
def sig01_phrases(spark, sf):
    """SIG-01, SIG-02, SIG-03, SIG-07, FN-07."""
    d = chats(spark, sf).select(F.col("s").alias("session_id"), F.concat_ws(":", "s", "t").alias("evidence_id"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("actor"), F.col("t").alias("source_line"), chosen([x[0] for x in PHRASES], (F.col("c") + F.col("t")) % len(PHRASES)).alias("content"))
    return signals.annotate(d).select("evidence_id", F.explode("signals").alias("s")).select("evidence_id", "s.type", "s.trigger", "s.char_start")


# Rules that overlap.
OVERLAPS = (("request_candidate", "r1", "abcde"), ("request_candidate", "r2", "efgh"), ("request_candidate", "r3", "hij"), ("reason_candidate", "r4", "cd"), ("request_candidate", "r5", "bc"))


@query(f"""WITH {CHATS}, sh(type, rules, a, b) AS (VALUES ('request_candidate', 'r1,r2,r5', 0, 5), ('request_candidate', 'r3', 7, 10), ('reason_candidate', 'r4', 2, 4))
    SELECT s || ':' || t AS evidence_id, type, rules, CAST(a + t + 1 AS INTEGER) AS char_start, CAST(b + t + 1 AS INTEGER) AS char_end FROM ch, sh""")
def sig06_overlaps(spark, sf):
    """SIG-06."""
    d = chats(spark, sf).select(F.concat_ws(":", "s", "t").alias("evidence_id"), F.concat(F.repeat(F.lit("-"), F.col("t") + 1), F.lit("abcdefghij")).alias("x"))
    kept = d.select("evidence_id", F.explode(signals.deduplicate(F.shuffle(signals.phrase_signals(F.col("x"), OVERLAPS)))).alias("k"))
    return kept.select("evidence_id", "k.type", F.array_join("k.rule_ids", ",").alias("rules"), "k.char_start", "k.char_end")


def toy_analyser():
    """Tokens by white space; of each five, every one hangs on the one before, the fourth as a clause."""
    import re

    def run(texts: list[str]):
        return [[(m[0], m[0].lower().strip(".,"), "advcl" if i % 5 == 3 else "dep", i - 1 if i % 5 else i, m.start()) for i, m in enumerate(re.finditer(r"[^ \n]+", x))] for x in texts]

    return run


_TOKENS = f"{CHATS}, tk AS (SELECT s, s || ':' || t AS id, regexp_extract_all(text, '[^ \\n]+') AS w, string_split_regex(text, '[^ \\n]+') AS g, text FROM ch), tx AS (SELECT s, id, text, w, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS k, CAST(list_sum(list_transform(g[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: len(x))), 0) AS INTEGER) AS a FROM tk)"
TOY = {"request_candidate": ("de", "the"), "reason_candidate": ("de", "der", "la")}


def toy_texts(spark, sf) -> DataFrame:
    return chats(spark, sf).select(F.col("s").alias("session_id"), F.concat_ws(":", "s", "t").alias("evidence_id"), F.col("text").alias("content"))


@query(f"""WITH {_TOKENS}, l AS (SELECT id, w[k] AS token, lower(trim(w[k], '.,')) AS lemma, a FROM tx), v(type, lemma) AS (VALUES ('request_candidate', 'de'), ('request_candidate', 'the'), ('reason_candidate', 'de'), ('reason_candidate', 'der'), ('reason_candidate', 'la'))
    SELECT id AS evidence_id, type, type || '__lemma-v1' AS rule, token AS trigger, a AS char_start, CAST(a + len(token) AS INTEGER) AS char_end FROM l JOIN v USING (lemma)""")
def sig04_lemmas(spark, sf):
    """SIG-04, SIG-08."""
    hits = signals.lemma_signals(signals.analysed(toy_texts(spark, sf), toy_analyser), TOY)
    return hits.select("evidence_id", "type", F.col("rule_ids")[0].alias("rule"), "trigger", "char_start", "char_end")


@query(f"""WITH {_TOKENS}, c AS (SELECT *, lower(trim(w[k - 1], '.,')) AS lemma, least(k + 1, len(w)) AS z FROM tx WHERE k % 5 = 4),
    r AS (SELECT c.id, c.w[c.k - 1] AS trigger, c.a AS a, substr(c.text, c.a + 1, e.a + len(e.w[e.k]) - c.a) AS reason FROM c JOIN tx e ON c.id = e.id AND e.k = c.z WHERE c.lemma IN ('de', 'der', 'la', 'le', 'the', 'of'))
    SELECT id AS evidence_id, trigger, a AS char_start, CAST(a + len(reason) AS INTEGER) AS char_end, reason FROM r WHERE regexp_matches(reason, '(?:en|er)')""")
def sig05_dependencies(spark, sf):
    """SIG-05."""
    texts = toy_texts(spark, sf)
    hits = signals.dependency_signals(signals.analysed(texts, toy_analyser), texts, ("de", "der", "la", "le", "the", "of"), ("advcl",), "(?:en|er)")
    return hits.select("evidence_id", "trigger", "char_start", "char_end", "reason")


# Texts, and the signals that phrase rules, lemmas and dependencies find in them together, with their sources.
ANNOTATED = (
    ("依頼 です", "request_candidate@0依頼:spacy_matcher"), ("x y 変更 速いから ね", "reason_candidate@7変更:phrase+spacy_dependency_matcher"), ("no hint", ""),
    ("保留 を 採用", "uncertainty_candidate@0保留:phrase+spacy_matcher,acceptance_candidate@5採用:phrase+spacy_matcher"), ("a b 採用 早く c", "acceptance_candidate@4採用:phrase+spacy_matcher"),
)


@query(f"""WITH {CHATS}, {values('sh', 'text, hits', ANNOTATED)}, x AS (SELECT s || ':' || t AS evidence_id, unnest(string_split(hits, ',')) AS h FROM ch JOIN sh ON (c + t) % {len(ANNOTATED)} = i WHERE role <> 'system' AND hits <> '')
    SELECT evidence_id, regexp_extract(h, '^([a-z_]+)', 1) AS type, CAST(regexp_extract(h, '@([0-9]+)', 1) AS INTEGER) AS char_start, regexp_extract(h, '@[0-9]+([^:]*):', 1) AS trigger, regexp_extract(h, ':(.*)$', 1) AS sources,
    'SIGNAL_ANNOTATION_ERROR: analyser is not available: no.such:thing' AS refused FROM x""")
def sig08_verb(spark, sf):
    """SIG-02, SIG-04 to SIG-08, SNK-06: all annotators switched on by the verb; an analyser that isn't there is refused."""
    root = own_dir(spark, "annotated")
    d = chats(spark, sf).select(F.col("s").alias("session_id"), F.struct(F.concat_ws(":", "s", "t").alias("evidence_id"), F.lit("SEC-001").alias("section_id"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("actor"),
                                                                          F.col("t").alias("source_line"), chosen([x[0] for x in ANNOTATED], (F.col("c") + F.col("t")) % len(ANNOTATED)).alias("content")).alias("m"))
    d.groupBy("session_id").agg(F.collect_list("m").alias("messages")).write.json(f"{root}/in/analysis_session")
    spark.createDataFrame([], "attachment_id string").write.json(f"{root}/in/attachments")
    try:
        verbs.export_signals(spark, f"{root}/in", f"{root}/none", "lemma", "no.such:thing")
        refused = None
    except errors.SignalFailure as e:
        refused = str(e).split(" (")[0]
    verbs.export_signals(spark, f"{root}/in", f"{root}/out", "lemma,dependency", f"{__name__}:toy_analyser")
    found = spark.read.json(f"{root}/out/messages").select("evidence_id", F.explode("signals").alias("x"))
    return found.select("evidence_id", "x.type", F.col("x.char_start").cast("int").alias("char_start"), "x.trigger", F.array_join("x.sources", "+").alias("sources"), F.lit(refused).alias("refused"))


@query(f"WITH {CHATS} SELECT s, CAST(sum(len(text) + t) AS DOUBLE) / sum(len(text)) - 1 AS growth FROM ch GROUP BY s")
def agg15_growth(spark, sf):
    """AGG-15."""
    d = chats(spark, sf).groupBy("s").agg(F.sum(F.char_length("text")).alias("a"), F.sum(F.char_length("text") + F.col("t")).alias("b"))
    return d.select("s", signals.growth(F.col("a"), F.col("b")).alias("growth"))


# Validators.


def _decision(**change) -> str:
    d = {"decision_id": "D-@", "title": "t", "decision": "d", "context": None, "alternatives": [], "rationale": ["r"], "rejected_alternatives": [{"alternative": "a", "reason": "b"}], "risks": [], "revisit_conditions": [],
         "evidence_refs": [{"evidence_type": "message", "evidence_id": "M1"}], "confidence": "high", "missing_information": [], "status": "accepted"} | change
    return json.dumps({k: v for k, v in d.items() if v != "gone"}, ensure_ascii=False)


# Documents and their first broken rule; the second group is of version 3 only, the third of version 1.
SHAPES = (
    (dict(), None), (dict(extra=1), "missing or additional fields"), (dict(status="gone"), "missing or additional fields"), (dict(risks="late"), "risks must contain strings"), (dict(rationale=[1]), "rationale must contain strings"),
    (dict(title=" 　"), "requires non-empty id, title, and decision"), (dict(decision_id="D-dup"), "duplicate decision id"), (dict(context=4), "context must be string or null"), (dict(confidence="sure"), "confidence is invalid"),
    (dict(status="done"), "status is invalid"), (dict(rejected_alternatives=[{"alternative": "x"}]), "rejected_alternatives is invalid"), (dict(alternatives=None, title=""), "alternatives must contain strings"),
)
SHAPES_3 = ((dict(evidence_refs=[]), "has no evidence"), (dict(evidence_refs=[{"evidence_type": "file", "evidence_id": "x"}]), "evidence_refs is invalid"), (dict(evidence_refs=[{"evidence_type": "message", "evidence_id": ""}]), "evidence_refs is invalid"))
SHAPES_1 = ((dict(evidence_message_ids=[]), "has no evidence"), (dict(evidence_message_ids=[5]), "evidence_message_ids must contain strings"), (dict(evidence_refs=[]), "missing or additional fields"))


def _shapes(version: int) -> list[tuple[str, str | None]]:
    one = {} if version == 3 else {"evidence_refs": "gone", "evidence_message_ids": ["M1"]}
    return [(_decision(**(one | change)), error) for change, error in (*SHAPES, *(SHAPES_3 if version == 3 else SHAPES_1))]


def _judged(spark, sf, version: int) -> DataFrame:
    shapes = _shapes(version)
    pos = (F.col("c") % 3 * 8 + F.col("t")).cast("int")
    d = chats(spark, sf).select(F.floor(F.col("c") / 3).cast("string").alias("doc"), pos.alias("pos"), F.replace(chosen([x[0] for x in shapes], (F.col("c") * 3 + F.col("t")) % len(shapes)), F.lit("@"), pos.cast("string")).alias("j"))
    return validation.decision_errors(d.select("doc", "pos", F.parse_json("j").alias("item")), version).select("doc", "pos", "error")


def _judged_sql(version: int) -> str:
    shapes = _shapes(version)
    return f"""WITH {CHATS}, {values('sh', 'error', [(e,) for _, e in shapes])}, x AS (SELECT CAST(c // 3 AS VARCHAR) AS doc, CAST(c % 3 * 8 + t AS INTEGER) AS pos, i, error FROM ch JOIN sh ON (c * 3 + t) % {len(shapes)} = i)
        SELECT doc, pos, CASE WHEN error = 'duplicate decision id' AND row_number() OVER (PARTITION BY doc, i ORDER BY pos) = 1 THEN NULL ELSE error END AS error FROM x"""


@query(_judged_sql(1))
def val01_version_1(spark, sf):
    """VAL-01, FN-18, HLP-04."""
    return _judged(spark, sf, 1)


@query(_judged_sql(3))
def val02_version_3(spark, sf):
    """VAL-02, FN-18, HLP-04."""
    return _judged(spark, sf, 3)


@query(f"""WITH {CHATS} SELECT DISTINCT 0 AS ord, 'Projection v3 is required: ' || s AS message FROM ch WHERE c % 4 < 2 UNION ALL SELECT 1, 'Evidence without an id: message'""")
def val03_analysis(spark, sf):
    """VAL-03."""
    d = chats(spark, sf)
    docs = d.select(F.col("s").alias("session_id"), F.when(F.col("c") % 4 == 0, "1").when(F.col("c") % 4 > 1, "3").alias("projection_version")).distinct()
    return validation.analysis_violations(docs, d.select(F.when(F.col("t") != 2, F.col("s")).alias("evidence_id")), d.select(F.col("s").alias("attachment_id")))


_SCOPES = f"{CHATS}, sc AS (SELECT *, 'SEC-' || lpad((t + 1)::VARCHAR, 3, '0') AS sec FROM ch)"


@query(f"""WITH {_SCOPES} SELECT 0 AS ord, 'Section scope mismatch: ' || sec AS message FROM sc WHERE c % 5 = 0 UNION ALL SELECT 1, 'candidate Section must not be marked Gold: ' || sec FROM sc WHERE c % 5 IN (1, 2)
    UNION ALL SELECT 2, 'expected one session id, found ' || count(DISTINCT s) || ', missing in 0' FROM sc""")
def val12_scopes(spark, sf):
    """VAL-12, AGG-14."""
    sec = F.format_string("SEC-%03d", F.col("t") + 1)
    gold = F.when(F.col("c") % 5 == 1, True).when(F.col("c") % 5 != 2, False)
    docs = chats(spark, sf).select(F.col("s").alias("session_id"), sec.alias("section_id"), F.struct(F.when(F.col("c") % 5 == 0, "SEC-999").otherwise(sec).alias("section_id"), gold.alias("section_gold")).alias("section_scope"))
    return validation.scope_violations(docs).unionByName(validation.session_violations(docs))


@query(f"""WITH {_SCOPES}, ix AS (SELECT sec, s || ':' || t AS id FROM sc WHERE c % 3 <> 1 UNION SELECT sec, 'X' || s FROM sc WHERE c % 9 = 0)
    SELECT 0 AS ord, 'message is not listed in its section: ' || s || ':' || t AS message FROM sc WHERE c % 3 = 1 UNION ALL SELECT 1, 'listed message is missing: ' || id FROM ix WHERE id LIKE 'X%'""")
def val05_membership(spark, sf):
    """VAL-05, JON-08."""
    d = chats(spark, sf).withColumn("section_id", F.format_string("SEC-%03d", F.col("t") + 1)).withColumn("evidence_id", F.concat_ws(":", "s", "t"))
    listed = d.where("c % 3 <> 1").select("section_id", "evidence_id").union(d.where("c % 9 = 0").select("section_id", F.concat(F.lit("X"), "s")))
    return sections.membership_violations(d, listed.groupBy("section_id").agg(F.collect_list("evidence_id").alias("message_ids")))


@query(f"""WITH {CHATS}, a AS (SELECT DISTINCT c, s FROM ch) SELECT 0 AS ord, 'unknown parent gone:' || s || ' of A' || s AS message FROM a WHERE c % 4 = 0
    UNION ALL SELECT 1, 'attachment A' || s || ' is not listed in SEC-002' FROM a UNION ALL SELECT 1, 'attachment A' || s || ' is not listed in SEC-001' FROM a WHERE c % 3 = 0""")
def jon09_attachments(spark, sf):
    """JON-02, JON-09, VAL-05."""
    d = chats(spark, sf)
    a = d.select("c", "s").distinct().select("c", F.concat(F.lit("A"), "s").alias("attachment_id"), F.when(F.col("c") % 4 == 0, F.array(F.concat(F.col("s"), F.lit(":0")), F.concat(F.lit("gone:"), F.col("s")))).otherwise(F.array(F.concat(F.col("s"), F.lit(":0")))).alias("parent_message_ids"),
                                            F.array(F.lit("SEC-001"), F.lit("SEC-002")).alias("section_ids"))
    index = a.where("c % 3 <> 0").agg(F.collect_list("attachment_id").alias("attachment_ids")).select(F.lit("SEC-001").alias("section_id"), "attachment_ids")
    return sections.attachment_violations(a.drop("c"), d.select(F.concat_ws(":", "s", "t").alias("evidence_id")), index)


@query(f"""WITH {CHATS}, r AS (SELECT CAST(c // 4 AS VARCHAR) AS doc, CASE WHEN t % 2 = 1 THEN 'attachment' ELSE 'message' END AS evidence_type, s || ':' || t AS evidence_id, t FROM ch)
    SELECT doc, evidence_type, evidence_id FROM r WHERE CASE evidence_type WHEN 'message' THEN t % 3 = 0 ELSE t % 5 = 0 END""")
def jon04_typed_evidence(spark, sf):
    """JON-03, JON-04, SET-01."""
    d = chats(spark, sf).select(F.floor(F.col("c") / 4).cast("string").alias("doc"), "t", F.concat_ws(":", "s", "t").alias("evidence_id"))
    known = validation.known_evidence(d.where("t % 3 <> 0").select("doc", "evidence_id"), d.where("t % 5 <> 0").select("doc", F.col("evidence_id").alias("attachment_id")))
    return validation.missing_evidence(d.select("doc", F.when(F.col("t") % 2 == 1, "attachment").otherwise("message").alias("evidence_type"), "evidence_id"), known)


# Judgments: a cluster per conversation, of its turns' decisions; the first judgment is of the first two, broken by conv_id % 16.
_CL = "'CLUSTER-' || substr(sha256(s), 1, 12)"
_KEY = "'SEC-' || lpad(({} + 1)::VARCHAR, 3, '0') || ':D-001'"
# What is changed in the judgment, and the rule that it breaks.
FAULTS = ((None, None), ("relation", "invalid relation"), ("id", "judgment IDs must be sequential"), ("rationale", "rationale must be non-empty"), ("confidence", "invalid confidence"), ("no refs", "evidence_refs must be non-empty"), ("type", "invalid Evidence type"),
          ("twice", "duplicate Evidence reference"), ("members", "member keys must be unique and non-empty"), ("no direction", "requires a direction object"), ("ends", "direction endpoints must be distinct members"), ("parent", "has an invalid direction relation"),
          ("direction", "direction must be null"), ("one", "requires more Decision keys"), ("evidence", None), ("key", None))


def _adjudicated(spark, sf) -> tuple[DataFrame, ...]:
    key = lambda n: F.format_string("SEC-%03d:D-001", F.lit(n) + 1 if isinstance(n, int) else n + 1)
    d = chats(spark, sf).withColumn("cluster_id", F.concat(F.lit("CLUSTER-"), F.substring(F.sha2("s", 256), 1, 12)))
    decisions = d.select("cluster_id", key(F.col("t")).alias("source_decision_key"))
    evidence = d.select("cluster_id", F.lit("message").alias("evidence_type"), F.concat(F.lit("M"), "t").alias("evidence_id"))
    two = d.groupBy("c", "cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("fault", chosen([f or "" for f, _ in FAULTS], F.col("c") % len(FAULTS)))
    is_ = lambda *f: F.col("fault").isin(*f)
    ref = lambda kind, name: F.struct(F.lit(kind).alias("evidence_type"), F.lit(name).alias("evidence_id"))
    direction = lambda a, r, b: F.struct(key(a).alias("from_decision_key"), F.lit(r).alias("relation"), key(b).alias("to_decision_key"))
    none = F.lit(None).cast("struct<from_decision_key:string,relation:string,to_decision_key:string>")
    j = two.select(
        "cluster_id", F.lit(0).alias("pos"), F.when(is_("id"), "J-002").otherwise("J-001").alias("judgment_id"),
        F.when(is_("relation"), "alike").when(is_("no direction", "ends"), "lifecycle_relation").when(is_("parent"), "parent_child").otherwise("same_decision").alias("relation"),
        F.when(is_("members"), F.array(key(0), key(0))).when(is_("one"), F.array(key(0))).when(is_("key"), F.array(key(0), key(1), key(98))).otherwise(F.array(key(0), key(1))).alias("member_decision_keys"),
        F.when(is_("ends"), direction(0, "changes", 0)).when(is_("parent"), direction(0, "changes", 1)).when(is_("direction"), direction(0, "changes", 1)).otherwise(none).alias("direction"),
        F.when(is_("rationale"), F.array(F.lit(""))).otherwise(F.array(F.lit("w"))).alias("rationale"),
        F.when(is_("no refs"), F.array().cast("array<struct<evidence_type:string,evidence_id:string>>")).when(is_("type"), F.array(ref("file", "M0"))).when(is_("twice"), F.array(ref("message", "M0"), ref("message", "M0"))).when(is_("evidence"), F.array(ref("message", "M99"))).otherwise(F.array(ref("message", "M0"))).alias("evidence_refs"),
        F.when(is_("confidence"), "sure").otherwise("high").alias("confidence"), F.array().cast("array<string>").alias("missing_information"))
    left = d.where("c % 3 > 0 or t % 2 = 0").where("t > 0").select("cluster_id", key(F.col("t")).alias("source_decision_key"))
    return j, decisions, evidence, left


_JUDGED = f"""{CHATS}, {values('sh', 'fault, error', FAULTS)}, n AS (SELECT c, s, {_CL} AS cl, count(*) AS n FROM ch GROUP BY c, s), j AS (SELECT n.*, coalesce(fault, '') AS fault, error FROM n JOIN sh ON c % {len(FAULTS)} = i WHERE n > 1),
    cls AS (SELECT cl, unnest(CASE fault WHEN 'members' THEN [0] WHEN 'one' THEN [0] WHEN 'key' THEN [0, 1, 98] ELSE [0, 1] END) AS k FROM j), un AS (SELECT {_CL} AS cl, t AS k FROM ch WHERE (c % 3 > 0 OR t % 2 = 0) AND t > 0), al AS (SELECT {_CL} AS cl, t AS k FROM ch)"""


@query(f"""WITH {_JUDGED} SELECT cl AS cluster_id, 0 AS ord, CASE fault WHEN 'id' THEN 'J-002 ' ELSE 'J-001 ' END || error AS message FROM j WHERE error IS NOT NULL
    UNION ALL SELECT cl, 0, 'unknown Decision key SEC-099:D-001' FROM j WHERE fault = 'key' UNION ALL SELECT cl, 0, 'unknown Evidence reference message:M99' FROM j WHERE fault = 'evidence' UNION ALL SELECT cl, 0, 'unknown Evidence reference file:M0' FROM j WHERE fault = 'type'
    UNION ALL SELECT DISTINCT cls.cl, 1 << 30, 'both classified and unclassified: ' || {_KEY.format('cls.k')} FROM cls JOIN un USING (cl, k)
    UNION ALL SELECT cl, 1 << 30, 'coverage is incomplete: ' || {_KEY.format('k')} FROM (SELECT * FROM al EXCEPT SELECT cl, k FROM cls EXCEPT SELECT * FROM un)""")
def val06_judgments(spark, sf):
    """VAL-06, VAL-07, JON-06, WIN-05, SET-03, HLP-04, HLP-11."""
    return validation.judgment_violations(*_adjudicated(spark, sf))


@query(f"""WITH {_JUDGED} SELECT al.cl AS cluster_id, count(DISTINCT al.k) AS decision_count, CASE WHEN any_value(fault) IS NULL THEN 0 ELSE 1 END AS judgment_count, coalesce(any_value(CASE fault WHEN 'no refs' THEN 0 WHEN 'twice' THEN 2 ELSE 1 END) FILTER (fault IS NOT NULL), 0) AS evidence_reference_count,
    (SELECT count(DISTINCT k) FROM cls WHERE cls.cl = al.cl) AS classified_decision_count, (SELECT count(*) FROM un WHERE un.cl = al.cl) AS unclassified_decision_count FROM al LEFT JOIN j USING (cl) GROUP BY al.cl""")
def agg08_statistics(spark, sf):
    """AGG-08."""
    j, d, _, u = _adjudicated(spark, sf)
    s = validation.judgment_statistics(j, d, u)
    return s.select("cluster_id", *(F.col(c).cast("long").alias(c) for c in ("decision_count", "judgment_count", "evidence_reference_count", "classified_decision_count", "unclassified_decision_count")))


# What is changed in a group's result of its first decision, and the rule that it breaks.
LIFE_FAULTS = ((None, None), ("status", "invalid lifecycle status"), ("rationale", "rationale must be non-empty"), ("confidence", "invalid lifecycle confidence"), ("no refs", "Evidence is required"), ("twice", "duplicate lifecycle Evidence"), ("id", "unknown lifecycle Decision ID"), ("evidence", "unknown lifecycle Evidence: message:M99"), ("order", None))


@query(f"""WITH {CHATS}, {values('sh', 'fault, error', LIFE_FAULTS)}, g AS (SELECT c, s, count(*) AS n FROM ch GROUP BY c, s), f AS (SELECT g.*, fault, error FROM g JOIN sh ON c % {len(LIFE_FAULTS)} = i)
    SELECT s AS group_id, 0 AS ord, error AS message FROM f WHERE error IS NOT NULL UNION ALL SELECT s, 1 << 30, 'lifecycle result order/coverage mismatch' FROM f WHERE fault = 'id' OR (fault = 'order' AND n > 1) OR c % 11 = 5""")
def val08_lifecycle(spark, sf):
    """VAL-08, JON-07, SET-04, HLP-04: results of every eleventh group lack one more."""
    d = chats(spark, sf).withColumn("fault", chosen([f or "" for f, _ in LIFE_FAULTS], F.col("c") % len(LIFE_FAULTS)))
    last = F.max("t").over(Window.partitionBy("s"))
    ids = d.groupBy("c", "s").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.format_string("ID-%03d", t)).alias("ids"))
    groups = ids.select(F.col("s").alias("group_id"), F.when(F.col("c") % 11 == 5, F.concat("ids", F.array(F.lit("ID-999")))).otherwise(F.col("ids")).alias("decision_ids"))
    first = F.col("t") == 0
    is_ = lambda f: first & (F.col("fault") == f)
    ref = lambda name: F.struct(F.lit("message").alias("evidence_type"), F.lit(name).alias("evidence_id"))
    r = d.withColumn("z", last).select(
        F.col("s").alias("group_id"), F.when(F.col("fault") == "order", F.col("z") - F.col("t")).otherwise(F.col("t")).alias("pos"), F.when(is_("id"), "ID-998").otherwise(F.format_string("ID-%03d", F.col("t"))).alias("decision_id"), F.when(is_("status"), "done").otherwise("accepted").alias("final_status"),
        F.when(is_("rationale"), F.array().cast("array<string>")).otherwise(F.array(F.lit("w"))).alias("rationale"),
        F.when(is_("no refs"), F.array().cast("array<struct<evidence_type:string,evidence_id:string>>")).when(is_("twice"), F.array(ref("M0"), ref("M0"))).when(is_("evidence"), F.array(ref("M99"))).otherwise(F.array(ref("M0"))).alias("evidence_refs"),
        F.when(is_("confidence"), "sure").otherwise("low").alias("confidence"), F.array().cast("array<string>").alias("missing_information"))
    ev = d.select(F.col("s").alias("group_id"), F.lit("message").alias("evidence_type"), F.lit("M0").alias("evidence_id")).distinct()
    return validation.lifecycle_violations(r, groups, ev)


@query(f"WITH {CHATS} SELECT 0 AS ord, 'integrated ids must be unique: ' || (c // 2) || ' ID-' || t AS message FROM ch WHERE t <> 6 GROUP BY c // 2, t HAVING count(*) > 1 UNION ALL SELECT DISTINCT 0, 'integrated ids must be unique: ' || (c // 2) FROM ch WHERE t = 6")
def val13_unique_ids(spark, sf):
    """VAL-13."""
    return validation.id_violations(chats(spark, sf).select(F.floor(F.col("c") / 2).cast("string").alias("session_id"), F.when(F.col("t") != 6, F.concat(F.lit("ID-"), "t")).alias("decision_id")))


@query(f"WITH {CHATS} SELECT s AS session_id, {_KEY.format('t')} AS source_decision_key FROM ch WHERE t = 1 AND c % 2 = 0 AND EXISTS (SELECT 1 FROM ch x WHERE x.c = ch.c AND x.t = 2)")
def val10_overlaps(spark, sf):
    """VAL-10: of even conversations the second decision stands in two groups."""
    key = lambda n: F.format_string("SEC-%03d:D-001", F.lit(n))
    d = chats(spark, sf).groupBy("c", F.col("s").alias("session_id")).agg(F.max("t").alias("z")).where("z >= 2")
    groups = F.when(F.col("c") % 2 == 0, F.array(F.array(key(1), key(2)), F.array(key(2), key(3)), F.array(key(2), key(1)))).otherwise(F.array(F.array(key(1), key(2)), F.array(key(2), key(1))))
    return assembly.overlapping_groups(d.select("session_id", F.lit("same_decision").alias("relation"), F.explode(groups).alias("member_decision_keys")))


@query(f"WITH {CHATS} SELECT DISTINCT s AS cluster_id FROM ch WHERE c % 3 > 0")
def jon13_member_sets(spark, sf):
    """JON-13: of three inputs, one lacks a member, one repeats one."""
    d = chats(spark, sf).withColumn("source_decision_key", F.format_string("SEC-%03d:D-001", F.col("t") + 1)).withColumn("cluster_id", F.col("s"))
    made = d.groupBy("cluster_id").agg(F.collect_list("source_decision_key").alias("member_decision_keys"))
    some = d.where("c % 3 <> 1 or t > 0").select("cluster_id", "source_decision_key").unionByName(d.where("c % 3 = 2 and t = 0").select("cluster_id", "source_decision_key"))
    return clusters.member_mismatches(made, some)


# Review.


@query(f"""WITH {CHATS}, e AS (SELECT DISTINCT s, t // 2 AS k FROM ch), a AS (SELECT s, string_agg('M' || k, ',' ORDER BY k) AS ev, count(*) AS n FROM e GROUP BY s)
    SELECT s AS session_id, 'C' || s AS cluster_id, string_agg({_KEY.format('t')}, ',' ORDER BY t) AS keys, any_value(ev) AS evidence, CASE WHEN any_value(n) > 1 THEN any_value(ev) END AS neighbors, 'title' AS shown, 'candidate_relation' AS label FROM ch JOIN a USING (s) GROUP BY s""")
def jon12_review_inputs(spark, sf):
    """JON-12, PRJ-15, PRJ-16, SRT-07, WIN-01: what either form leaves out, by its schema."""
    d = chats(spark, sf)
    ref = F.array(F.struct(F.lit("message").alias("evidence_type"), F.concat(F.lit("M"), F.floor(F.col("t") / 2).cast("string")).alias("evidence_id")))
    inv = d.select(F.col("s").alias("session_id"), F.format_string("SEC-%03d:D-001", F.col("t") + 1).alias("source_decision_key"), F.format_string("SEC-%03d", F.col("t") + 1).alias("section_id"), F.lit("D-001").alias("source_decision_id"), F.lit("f").alias("source_file"), F.lit("h").alias("source_sha256"), F.lit("t").alias("title"), ref.alias("evidence_refs"))
    made = inv.groupBy("session_id").agg(F.collect_list("source_decision_key").alias("member_decision_keys")).select("session_id", F.concat(F.lit("C"), "session_id").alias("cluster_id"), "member_decision_keys", F.lit("uncertain").alias("candidate_relation"))
    m = d.select(F.col("s").alias("session_id"), F.lit("SEC-001").alias("section_id"), F.floor(F.col("t") / 2).cast("int").alias("source_line")).distinct().withColumn("evidence_id", F.concat(F.lit("M"), "source_line")).withColumn("actor", F.lit("human")).withColumn("content", F.lit("x"))
    ev = m.select("session_id", F.lit("message").alias("evidence_type"), "evidence_id", "content", "section_id", "source_line")
    around = sections.neighbors(m).select("session_id", "evidence_id", "previous", "next")
    seen, blind = (clusters.review_inputs(made, inv, ev, around, blind=b) for b in (False, True))
    names = lambda x: x.schema["decisions"].dataType.elementType.names
    shown = ",".join(n for n in names(blind) if n not in ("source_decision_key", "evidence_refs"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["evidence_id"]), ",")
    gone = ",".join(sorted(set(seen.columns) - set(blind.columns)))
    return blind.select("session_id", "cluster_id", F.array_join(F.transform("decisions", lambda x: x["source_decision_key"]), ",").alias("keys"), ids("evidence").alias("evidence"), ids("neighbor_messages").alias("neighbors"), F.lit(shown).alias("shown"), F.lit(gone).alias("label"))


_REVIEW = f"{CHATS}, rv AS (SELECT *, t % 5 = 4 AS wide, 'ID-' || t AS id FROM ch WHERE role = 'user')"


@query(f"""WITH {_REVIEW} SELECT s AS session_id, 'LIFECYCLE-SEC-' || lpad((t // 2 + 1)::VARCHAR, 3, '0') AS group_id, string_agg(id, ',' ORDER BY id) AS ids FROM rv WHERE NOT wide GROUP BY s, t // 2
    UNION ALL SELECT NULL, 'proposed decision spans several sections: ' || id, NULL FROM rv WHERE wide""")
def agg16_review_groups(spark, sf):
    """AGG-16, PRJ-21."""
    key = lambda n: F.format_string("SEC-%03d:D-001", (n + 1).cast("int"))
    sec = F.floor(F.col("t") / 2)
    d = chats(spark, sf).select(F.col("s").alias("session_id"), F.concat(F.lit("ID-"), "t").alias("decision_id"), F.when(F.col("role") == "user", "proposed").otherwise("accepted").alias("status"), F.when(F.col("t") % 5 == 4, F.array(key(sec), key(sec + 1))).otherwise(F.array(key(sec), key(sec))).alias("source_decision_keys"))
    good, bad = lifecycle.groups(d)
    none = F.lit(None).cast("string")
    return good.select("session_id", "group_id", F.array_join("decision_ids", ",").alias("ids")).unionByName(bad.select(none.alias("session_id"), F.col("message").alias("group_id"), none.alias("ids")))


@query(f"""WITH {_SCOPES}, h AS (SELECT * FROM sc WHERE t <> 3), m AS (SELECT h.s, h.t, x.t AS u, x.sec AS xsec FROM h JOIN h x ON h.s = x.s AND x.t BETWEEN h.t AND h.t + 2)
    SELECT s AS session_id, 'G' || t AS group_id, string_agg('M' || (10 - u), ',' ORDER BY CASE WHEN u = 0 THEN -1 ELSE u END) AS messages, string_agg(xsec, ',' ORDER BY xsec) AS sections FROM m GROUP BY s, t""")
def srt07_context(spark, sf):
    """SRT-07, JON-14: sections n to n + 2, without a fourth one, in order of line, whose ids run the other way."""
    d = chats(spark, sf).where("t <> 3").select(F.col("s").alias("session_id"), F.format_string("SEC-%03d", F.col("t") + 1).alias("section_id"), F.concat(F.lit("M"), (10 - F.col("t")).cast("string")).alias("evidence_id"), F.lit("human").alias("actor"), F.col("t").alias("source_line"), F.lit("x").alias("content"))
    review = d.select("session_id", F.concat(F.lit("G"), "source_line").alias("group_id"), "section_id")
    none = spark.createDataFrame([], "session_id string, attachment_id string, section_ids array<string>, content string")
    made = lifecycle.context(review, d, none)
    return made.select("session_id", "group_id", F.array_join(F.transform("messages", lambda m: m["evidence_id"]), ",").alias("messages"), F.array_join("context_sections", ",").alias("sections"))


# Sinks.


def _texts(title: str, x: str) -> str:
    return f"'### {title}' || chr(10) || chr(10) || {x} || chr(10) || chr(10) || "


@query(f"""WITH {CHATS} SELECT s AS session_id, '# 意思決定一覧' || chr(10) || chr(10) || string_agg('## ID-' || t || ' ' || role || chr(10) || chr(10) || {_texts('決定', 'text')} {_texts('状態', "'accepted'")} {_texts('背景', "CASE WHEN t % 3 = 0 THEN '記録なし' ELSE 'c' || t END")}
    {_texts('比較案', "CASE WHEN t % 2 = 0 THEN '- なし' ELSE '- ' || role || chr(10) || '- b' END")} {_texts('採用理由', "'- r'")} {_texts('却下理由', "CASE WHEN t % 2 = 0 THEN '- x' || chr(10) || '  - y' ELSE '- なし' END")} {_texts('リスク', "'- なし'")} {_texts('見直し条件', "'- なし'")} {_texts('不足情報', "'- なし'")}
    {_texts('Confidence', "'high'")} '### 根拠' || chr(10) || chr(10) || '- [m' || t || '](conversation.md#m' || t || ')' || chr(10), chr(10) ORDER BY t) AS markdown FROM ch GROUP BY s""")
def snk15_decisions(spark, sf):
    """SNK-15."""
    none = F.array().cast("array<string>")
    odd = F.col("t") % 2 == 1
    d = chats(spark, sf).select(F.col("s").alias("session_id"), F.concat(F.lit("ID-"), "t").alias("decision_id"), F.col("role").alias("title"), F.col("text").alias("decision"), F.lit("accepted").alias("status"), F.when(F.col("t") % 3 == 1, F.concat(F.lit("c"), "t")).when(F.col("t") % 3 == 2, F.concat(F.lit("c"), "t")).alias("context"),
                                F.when(odd, F.array("role", F.lit("b"))).otherwise(none).alias("alternatives"), F.array(F.lit("r")).alias("rationale"), F.when(~odd, F.array(F.struct(F.lit("x").alias("alternative"), F.lit("y").alias("reason")))).otherwise(F.array().cast("array<struct<alternative:string,reason:string>>")).alias("rejected_alternatives"),
                                none.alias("risks"), none.alias("revisit_conditions"), none.alias("missing_information"), F.lit("high").alias("confidence"), F.array(F.concat(F.lit("m"), "t")).alias("evidence_message_ids"))
    return render.decisions(d)


@query(f"WITH {CHATS}, a(arm, k) AS (VALUES ('control', NULL), ('knowledge', 'note')) SELECT DISTINCT s AS session_id, arm, k AS interpretation_knowledge, sha256('{{\"session_id\":\"' || s || '\"}}') AS sha256 FROM ch, a")
def snk07_arms(spark, sf):
    """SNK-07, SNK-18, PRJ-17, PRJ-18."""
    d = chats(spark, sf).select("s").distinct().select(F.col("s").alias("session_id"), F.format_string('{"session_id":"%s"}', "s").alias("document"), F.lit(False).alias("has_signals"))
    return sinks.arms(d, "note").select("session_id", "arm", "interpretation_knowledge", "sha256")


@query(r"""WITH d AS (SELECT min(conv_id) AS a, max(conv_id) AS b FROM conversations) SELECT 'sorted' AS form, '{' || chr(10) || '  "a": ' || a || ',' || chr(10) || '  "b": "あ"' || chr(10) || '}' || chr(10) AS text FROM d
    UNION ALL SELECT 'plain', '{' || chr(10) || '  "b": "あ",' || chr(10) || '  "a": ' || a || chr(10) || '}' || chr(10) FROM d UNION ALL SELECT 'prompt', 'guide ' || b || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'ask' || chr(10) FROM d""")
def snk17_texts(spark, sf):
    """SNK-17, SNK-19: written to the store and read back."""
    a, b = chats(spark, sf).agg(F.min("c"), F.max("c")).first()
    root, value = own_dir(spark, "texts"), {"b": "あ", "a": a}
    sinks.write_json(spark, f"{root}/sorted", value, sort=True)
    sinks.write_json(spark, f"{root}/plain", value)
    sinks.write_text(spark, f"{root}/prompt", sinks.with_guidance(f"guide {b} \n\n", "\n ask\n"))
    return spark.read.text(f"{root}/*", wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("form"), F.col("value").alias("text"))


_REPORT = " || chr(10) || ".join(f"'- {name}: ' || " + (f"printf('%.2f%%', r * 100.0)" if unit == "%" else f"n || '{unit}'" if k < 11 else f"0 || '{unit}'") for k, (name, _, unit) in enumerate(sinks.REPORT))


@query(f"WITH d AS (SELECT count(*) AS n, 0.25::DOUBLE AS r FROM conversations) SELECT {_REPORT} AS lines FROM d")
def snk20_report(spark, sf):
    """SNK-20, FN-15."""
    n = chats(spark, sf).count()
    text = sinks.candidate_report({key: 0.25 if unit == "%" else n for k, (_, key, unit) in enumerate(sinks.REPORT) if k < 11})
    return spark.createDataFrame([("\n".join(x for x in text.split("\n") if x.startswith("- ")),)], "lines string")


@query(f"""WITH {CHATS} SELECT 2 AS run_id, s || ':' || t AS decision_id, 'unknown' AS status, role AS title, 2 AS runs, (SELECT count(*) * 2 FROM ch) AS evidence FROM ch""")
def snk02_runs(spark, sf):
    """SNK-02, SRC-12, SRT-09, AGG-13, FN-19, HLP-02: two runs with the same decisions, the latest of which counts."""
    store, none = own_dir(spark, "runs"), F.array().cast("array<string>")
    d = chats(spark, sf).select(F.concat_ws(":", "s", "t").alias("decision_id"), F.col("role").alias("title"), F.lit(None).cast("string").alias("status"), F.array("s").alias("evidence_message_ids"), none.alias("risks"))
    read = lambda name, schema: verbs.stored(spark, store, name, schema)
    for _ in range(2):
        sinks.save_run(spark, store, read("analysis_runs", verbs.RUNS), "x", d, "v1", "manual")
    runs = read("analysis_runs", verbs.RUNS)
    extra = spark.range(1).select(F.lit(runs.where("created_at is not null").count()).alias("runs"), F.lit(read("decision_evidence", "run_id int").count()).cast("long").alias("evidence"))
    found = logs.latest_decisions(runs, read("decisions", "run_id int, session_id string, decision_id string, status string, title string"))
    return found.join(F.broadcast(extra)).select("run_id", "decision_id", "status", "title", "runs", "evidence")


# The whole way by the verbs: one session of all conversations, five sections.

_WAY = r"""ln AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS n, 'SEC-00' || (conv_id % 5 + 1) AS sec FROM conversations), ms AS (SELECT * FROM ln WHERE role <> 'system')"""
# What each step reports, beside counts of the tables.
_STEPS = (("finalize", "valid", "2"), ("finalize", "partially_valid", "1"), ("finalize", "invalid", "1"), ("finalize", "missing", "1"), ("finalize", "decisions", "4"), ("finalize", "rejected", "2"), ("finalize", "repairs", "1"), ("finalize", "all_hashes_match", "false"), ("candidates", "inventory_decision_count", "4"),
          ("candidates", "candidate_pair_count", "1"), ("candidates", "candidate_cluster_count", "1"), ("candidates", "state", "candidate_bundle_ready_for_review"), ("adjudication", "fields", "cluster_id,decisions,evidence,mode,neighbor_messages,session_id"),
          ("adjudication v2", "fields", "allowed_decision_keys,cluster_id,decisions,evidence,mode,neighbor_messages,output_skeleton,session_id"), ("adjudication v2", "hidden", "section_id,source_decision_id,source_file,source_sha256"), ("assembled", "decisions_after", "3"), ("assembled", "merged_source_decision_count", "2"),
          ("lifecycle", "groups", "1"), ("lifecycle", "fields", "context_sections,decision_ids,group_id,messages,output_skeleton,section_id,session_id"), ("end", "cancelled", "1"), ("end", "accepted", "2"), ("experiment", "arms", "2"), ("sections", "sections", "5"), ("sections", "told", "1"), ("rejected", "SEC-003", "unknown evidence: message:none"),
          ("rejected", "SEC-004", "confidence is invalid"))


@query(f"""WITH {_WAY}, {values('st', 'step, name, value', _STEPS)} SELECT step, name, value FROM st UNION ALL SELECT 'ingest', 'total_lines', count(*)::VARCHAR FROM ln UNION ALL SELECT 'analysis', 'messages', count(*)::VARCHAR FROM ms
    UNION ALL SELECT 'hybrid', 'reason_candidate', count(*)::VARCHAR FROM ms WHERE role = 'user' UNION ALL SELECT 'signals', 'messages_examined', count(*)::VARCHAR FROM ms UNION ALL SELECT 'section', sec, string_agg('M' || n, ',' ORDER BY n) FROM ms GROUP BY sec
    UNION ALL SELECT 'checked', 'message_evidence_references', '1' UNION ALL SELECT 'lifecycle', 'messages', string_agg('M' || n, ',' ORDER BY n) FROM ms WHERE sec >= 'SEC-003'""")
def snk13_whole_way(spark, sf):
    """SNK-03 to SNK-13, SNK-16, SNK-18, VAL-03, VAL-09, VAL-11, JON-13, HLP-03, HLP-07, HLP-08, HLP-09."""
    p = own_dir(spark, "way")
    d = table(spark, sf, "conversations").withColumn("n", F.row_number().over(Window.orderBy("conv_id", "turn"))).withColumn("sec", F.format_string("SEC-%03d", F.col("conv_id") % 5 + 1))
    content = F.when(F.col("role") == "user", F.concat("text", F.lit("ので"))).otherwise(F.col("text"))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", content.alias("content")).alias("payload")))
    d.select("n", line.alias("value")).repartition(1).sortWithinPartitions("n").select("value").write.text(f"{p}/log")
    m = d.where("role <> 'system'").select(F.col("n").alias("raw_line"), F.concat(F.lit("M"), "n").alias("message_id"), F.when(F.col("role") == "user", "human").otherwise("assistant").alias("actor"), F.col("sec").alias("section_id"))
    m.write.json(f"{p}/messages")
    first = {r["section_id"]: r["m"] for r in m.groupBy("section_id").agg(F.min_by("message_id", "raw_line").alias("m")).collect()}
    sinks.write_text(spark, f"{p}/attachments", json.dumps({"attachment_id": "A1", "parent_message_ids": [first["SEC-001"]], "section_ids": ["SEC-001"], "content": "file"}))
    out: list[tuple] = []
    say = lambda step, report, *names: out.extend((step, n, str(report[n]).lower() if isinstance(report[n], bool) else str(report[n])) for n in names)
    got = verbs.ingest(spark, f"{p}/log/part-*", f"{p}/store")[0]
    say("ingest", got, "total_lines")
    session = got["session_id"]
    say("analysis", verbs.export_analysis(spark, f"{p}/store", session, f"{p}/v3", "ask", "{}", f"{p}/messages", f"{p}/attachments"), "messages")
    plain = verbs.export_sections(spark, f"{p}/v3", f"{p}/plain", guidance="guide", prompt="ask")
    told = spark.read.text(f"{p}/plain/RUN_INSTRUCTIONS.md", wholetext=True).where("contains(value, 'holds 5 independent sections')").count()
    say("sections", plain | {"told": told}, "sections", "told")
    ids = lambda d: F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("messages")[0]["source_line"].alias("first"), d.alias("ids")))), lambda x: x["ids"])), ",").alias("value")
    told_ids = spark.read.json(f"{p}/plain/sections").groupBy(F.lit("section").alias("step"), F.col("section_id").alias("name")).agg(ids(F.col("messages.evidence_id")))
    say("hybrid", verbs.export_sections(spark, f"{p}/v3", f"{p}/hybrid", knowledge="k", hybrid=True), "reason_candidate")
    say("signals", verbs.export_signals(spark, f"{p}/v3", f"{p}/signals"), "messages_examined")
    say("experiment", verbs.export_experiment(spark, f"{p}/v3", f"{p}/arms", "k"), "arms")
    ref = lambda x: [{"evidence_type": "message", "evidence_id": x}]
    made = lambda i, sec, **change: json.loads(_decision(decision_id=f"D-{i:03d}", **({"evidence_refs": ref(first[sec])} | change)))
    runs = {"SEC-001": [made(1, "SEC-001", title="Use the column store", decision="Tables are column files")], "SEC-002": [made(1, "SEC-002", title="Use the column store.", decision="Tables are column files!")],
            "SEC-003": [made(1, "SEC-003", title="Quit zebra jam", decision="Vowel pyjama", status="proposed", risks="late"), made(2, "SEC-003", evidence_refs=ref("none"))], "SEC-004": [made(1, "SEC-004", title="Kiwi fox", decision="Ghost whim"), made(2, "SEC-004", confidence="sure")]}
    for name, decisions in runs.items():
        text, at = json.dumps({"decisions": decisions}), f"{p}/results/sections/{name}"
        sinks.write_text(spark, f"{at}/decisions.raw.json", text)
        digest = spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]
        sinks.write_json(spark, f"{at}/RUN_RESULT.json", {"output_sha256": digest if name != "SEC-004" else "0", "validated_output_path": None})
    sinks.write_text(spark, f"{p}/one.json", json.dumps({"decisions": runs["SEC-001"]}))
    say("checked", verbs.validate_decisions_v3(spark, f"{p}/v3", f"{p}/one.json"), "message_evidence_references")
    say("finalize", verbs.finalize_runs(spark, f"{p}/hybrid", f"{p}/results", f"{p}/final"), "valid", "partially_valid", "invalid", "missing", "decisions", "rejected", "repairs", "all_hashes_match")
    out += [("rejected", r["doc"], r["error"]) for r in spark.read.parquet(f"{p}/final/rejected").collect()]
    kept = spark.read.parquet(f"{p}/final/decisions")
    kept.unionByName(spark.createDataFrame([("SEC-004", 0, json.dumps(runs["SEC-004"][0]), [])], kept.schema)).write.parquet(f"{p}/more/decisions")
    say("candidates", verbs.export_candidates(spark, f"{p}/more", session, f"{p}/cand"), "inventory_decision_count", "candidate_pair_count", "candidate_cluster_count", "state")
    for version, step in ((1, "adjudication"), (2, "adjudication v2")):
        verbs.export_adjudication(spark, f"{p}/cand", f"{p}/hybrid", f"{p}/adj{version}", version)
        made_ = spark.read.json(f"{p}/adj{version}/clusters")
        out.append((step, "fields", ",".join(sorted(made_.columns))))
        if version == 2:
            out.append((step, "hidden", ",".join(sorted(set(spark.read.parquet(f"{p}/cand/inventory").columns) - {"session_id"} - set(made_.schema["decisions"].dataType.elementType.names) - {"context"}))))
    cluster = spark.read.parquet(f"{p}/cand/clusters").first()
    judgment = {"judgment_id": "J-001", "relation": "same_decision", "member_decision_keys": cluster["member_decision_keys"], "direction": None, "rationale": ["w"], "evidence_refs": ref(first["SEC-001"]), "confidence": "high", "missing_information": []}
    sinks.write_text(spark, f"{p}/adj.jsonl", json.dumps({"cluster_id": cluster["cluster_id"], "judgments": [judgment], "unclassified_decision_keys": []}))
    say("assembled", verbs.assemble(spark, f"{p}/cand", f"{p}/adj2", f"{p}/adj.jsonl", f"{p}/made")[0], "decisions_after", "merged_source_decision_count")
    say("lifecycle", verbs.export_lifecycle(spark, f"{p}/made", f"{p}/hybrid", f"{p}/life"), "groups")
    group = spark.read.json(f"{p}/life/groups")
    one = group.select("group_id", "decision_ids").first()
    out.append(("lifecycle", "fields", ",".join(sorted(group.columns))))
    told_ids = told_ids.unionByName(group.where(F.col("group_id") == one["group_id"]).groupBy(F.lit("lifecycle").alias("step"), F.lit("messages").alias("name")).agg(ids(F.col("messages.evidence_id"))))
    result = {"decision_id": one["decision_ids"][0], "final_status": "cancelled", "rationale": ["w"], "evidence_refs": ref(first["SEC-003"]), "confidence": "high", "missing_information": []}
    sinks.write_text(spark, f"{p}/life.jsonl", json.dumps({"group_id": one["group_id"], "results": [result]}))
    report = {r["status"]: r["after"] for r in verbs.apply_lifecycle(spark, f"{p}/made", f"{p}/hybrid", f"{p}/life.jsonl", f"{p}/end") if "status" in r}
    say("end", report, "cancelled", "accepted")
    return spark.createDataFrame(out, "step string, name string, value string").unionByName(told_ids)


# The weights of the score, thresholds and limits that a candidate evaluation states.
_PARAMETERS = (("title", "0.36"), ("decision", "0.34"), ("combined", "0.12"), ("evidence", "0.12"), ("attachment", "0.03"), ("adjacency", "0.03"), ("candidate_score", "0.34"), ("strong_score", "0.38"), ("max_candidates", "8"),
               ("max_cluster", "12"))


@query(f"WITH {values('p', 'name, value', _PARAMETERS)} SELECT name, value, (SELECT count(*) FROM conversations WHERE turn = 0)::VARCHAR AS decisions FROM p")
def hlp05_parameters(spark, sf):
    """HLP-05: as read back from the candidate bundle of a decision per conversation."""
    p, none = own_dir(spark, "parameters"), F.array().cast("array<string>")
    c = chats(spark, sf).where("t = 0")
    item = F.to_json(F.struct(F.format_string("D-%s", "s").alias("decision_id"), F.col("role").alias("title"), F.col("text").alias("decision"), F.lit("high").alias("confidence"), F.lit("accepted").alias("status")))
    c.select(F.format_string("SEC-%03d", F.col("c") % 900 + 1).alias("doc"), F.col("t").alias("pos"), item.alias("item"), none.alias("repaired_fields")).write.parquet(f"{p}/final/decisions")
    verbs.export_candidates(spark, f"{p}/final", "x", f"{p}/cand")
    said = spark.read.text(f"{p}/cand/evaluation.json", wholetext=True)
    return said.select(F.get_json_object("value", "$.inventory_decision_count").alias("decisions"), F.explode(F.from_json("value", "parameters map<string,string>")["parameters"]).alias("name", "value"))


# Arguments (@ is the folder), the exit code, and what is printed first.
_CALLS = (("", 1, "verbs:"), ("no-such-verb", 1, "verbs:"), ("ingest", 2, "usage:"), ("ingest source=@/log", 2, "usage:"), ("ingest source=@/log store=@/store other=1", 2, "usage:"), ("ingest source=@/log store=@/store", 0, "{n}"),
          ("ingest source=@/log store=@/store adapter=default", 0, "already_ingested"), ("render store=@/store", 2, "usage:"), ("export-analysis store=@/store session_id=s out=@/store", 2, "refused"))


@query(f"WITH {values('c', 'args, code, said', _CALLS)} SELECT args, code, replace(said, '{{n}}', (SELECT count(*) FROM conversations)::VARCHAR) AS said FROM c")
def hlp10_arguments(spark, sf):
    """HLP-10: the command line, with defaults left out and named, and with arguments that lack or are too many."""
    p, out = own_dir(spark, "arguments"), []
    chats(spark, sf).select(F.to_json(F.struct(F.lit("event_msg").alias("type"), "s", "t")).alias("value")).coalesce(1).write.text(f"{p}/log")
    for args, *_ in _CALLS:
        told = io.StringIO()
        with contextlib.redirect_stdout(told):
            code = verbs.main(args.replace("@", p).split(), spark)
        text = told.getvalue()
        if code == 0:
            first = json.loads(text)[0]
            text = str(first.get("total_lines", first.get("status")))
        out.append((args, code, text if code == 0 else text.split(" ")[0] if code == 1 or text.startswith("usage:") else "refused"))
    return spark.createDataFrame(out, "args string, code int, said string")
