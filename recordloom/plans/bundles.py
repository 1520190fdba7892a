"""Queries on bundles that all conversations went into: what review documents hold, what the verbs refuse, digests and renderings; with SQL.

Each conversation is a cluster of two decisions, its first two turns; every message stands in a section's document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors, schemas
from ..operators import projection
from ..sources import sinks
from . import verbs
from .shaped import _FILES, CHATS, chats, log_files, own_dir, values

SQL: dict[str, str] = {}
QUERIES: list = []


def query(sql: str):
    """Registers a query with its SQL."""
    def add(f):
        QUERIES.append(f)
        SQL[f.__name__] = sql
        return f

    return add


def _messages(spark, sf) -> DataFrame:
    c = chats(spark, sf)
    return c.select(F.lit("x").alias("session_id"), F.format_string("SEC-%03d", F.col("c") % 5 + 1).alias("section_id"), F.concat_ws(":", "s", "t").alias("evidence_id"), F.when(F.col("role") == "user", "human").otherwise("assistant").alias("actor"),
                    (F.col("c") * 100 + F.col("t")).cast("int").alias("source_line"), F.col("text").alias("content"))


def _sections(m: DataFrame, path: str, gold: bool = False) -> None:
    d = m.groupBy("session_id", "section_id", projection.part_of(F.col("source_line"), 100_000).alias("part")).agg(F.collect_list(F.struct("evidence_id", "actor", "source_line", "content")).alias("messages"))
    d.drop("part").withColumn("section_scope", F.struct("section_id", F.lit(gold).alias("section_gold"))).write.json(f"{path}/sections")


def _candidates(spark, sf, path: str, members: int = 2, **said) -> None:
    """Clusters of conversations with two turns, their inventory, and an evaluation that may say something else."""
    c = chats(spark, sf).where("t < 2")
    key = F.format_string("SEC-%03d:D-%03d", F.col("c") % 900 + 1, F.col("t") + F.floor(F.col("c") / 900) * 2)
    ref = F.array(F.struct(F.lit("message").alias("evidence_type"), F.concat_ws(":", "s", "t").alias("evidence_id")))
    none = F.array().cast("array<string>")
    made = {"session_id": F.lit("x"), "source_decision_key": key, "section_id": F.lit("SEC-001"), "source_decision_id": F.lit("D-001"), "title": F.col("role"), "decision": F.col("text"), "context": F.lit(None).cast("string"), "rejected_alternatives": F.array().cast(schemas.ALTERNATIVES),
            "status": F.lit("accepted"), "confidence": F.lit("high"), "evidence_refs": ref, "source_file": F.lit("f"), "source_sha256": F.lit("h")}
    names = [f.split(" ")[0] for f in schemas.INVENTORY.split(", ")]
    c.select(*(made.get(n, none).alias(n) for n in names)).write.parquet(f"{path}/inventory")
    pairs = c.groupBy("s").agg(F.sort_array(F.collect_list(key)).alias("k")).where("size(k) = 2")
    clusters = pairs.select(F.lit("x").alias("session_id"), F.concat(F.lit("CLUSTER-"), F.substring(F.sha2("s", 256), 1, 12)).alias("cluster_id"), F.slice("k", 1, members).alias("member_decision_keys"), F.lit("uncertain").alias("candidate_relation"), F.lit(False).alias("automatic_merge_allowed"))
    clusters.where(F.lit(members > 0)).write.parquet(f"{path}/clusters")
    n = spark.read.parquet(f"{path}/clusters").count()
    sinks.write_json(spark, f"{path}/evaluation.json", {"state": verbs.READY, "automatic_merge_performed": False, "candidate_cluster_count": n} | said)


_KEYS = "printf('SEC-%03d:D-%03d', s::INT % 900 + 1, s::INT // 900 * 2) || ',' || printf('SEC-%03d:D-%03d', s::INT % 900 + 1, s::INT // 900 * 2 + 1)"
_LINES = f"{CHATS}, m AS (SELECT s || ':' || t AS id, c % 5 AS sec, c * 100 + t AS line, s, t FROM ch), nb AS (SELECT *, lag(id) OVER w AS p, lag(line) OVER w AS pl, lead(id) OVER w AS n, lead(line) OVER w AS nl FROM m WINDOW w AS (PARTITION BY sec ORDER BY line, id)), two AS (SELECT s FROM ch WHERE t < 2 GROUP BY 1 HAVING count(*) = 2)"


@query(f"""WITH {_LINES}, ev AS (SELECT s, string_agg(id || '@' || line, ',' ORDER BY id) AS evidence FROM m WHERE t < 2 GROUP BY 1), ne AS (SELECT s, p AS id, pl AS line FROM nb WHERE t < 2 AND p IS NOT NULL UNION SELECT s, n, nl FROM nb WHERE t < 2 AND n IS NOT NULL),
    nx AS (SELECT s, string_agg(id, ',' ORDER BY CASE WHEN line = 0 THEN -1 ELSE line END, id) AS around FROM ne GROUP BY 1), v(version) AS (VALUES (1), (2))
    SELECT version, 'CLUSTER-' || substr(sha256(s), 1, 12) AS cluster_id, evidence, around, {_KEYS} AS decisions, CASE WHEN version = 2 THEN {_KEYS} END AS allowed, CASE WHEN version = 2 THEN 'CLUSTER-' || substr(sha256(s), 1, 12) END AS skeleton,
    version = 1 AS files, false AS label, 'isolated_cluster_adjudication' AS mode FROM two JOIN ev USING (s) JOIN nx USING (s), v""")
def snk09_review_documents(spark, sf):
    """SNK-09, SNK-10, PRJ-15, PRJ-16: what both versions of a review bundle give for each cluster."""
    p, made = own_dir(spark, "review"), []
    _sections(_messages(spark, sf), f"{p}/bundle")
    _candidates(spark, sf, f"{p}/cand")
    for version in (1, 2):
        verbs.export_adjudication(spark, f"{p}/cand", f"{p}/bundle", f"{p}/adj{version}", version)
        d = spark.read.json(f"{p}/adj{version}/clusters")
        joined = lambda c, of: F.array_join(F.transform(c, of), ",")
        fields = d.schema["decisions"].dataType.elementType.names
        none = F.lit(None).cast("string")
        made.append(d.select(F.lit(version).alias("version"), "cluster_id", F.array_join(F.array_sort(F.transform("evidence", lambda e: F.concat_ws("@", e["evidence_id"], e["source_line"].cast("string")))), ",").alias("evidence"),
                             joined("neighbor_messages", lambda e: e["evidence_id"]).alias("around"), joined("decisions", lambda e: e["source_decision_key"]).alias("decisions"),
                             (F.array_join("allowed_decision_keys", ",") if version == 2 else none).alias("allowed"), (F.col("output_skeleton.cluster_id") if version == 2 else none).alias("skeleton"),
                             F.lit("source_file" in fields and "section_id" in fields).alias("files"), F.lit("candidate_relation" in d.columns).alias("label"), "mode"))
    return made[0].unionByName(made[1])


@query(f"""WITH {_LINES} SELECT 'CLUSTER-' || substr(sha256(s), 1, 12) AS cluster_id, 2 AS decision_count, 2 AS classified_decision_count, 0 AS unclassified_decision_count, 1 AS judgment_count, 1 AS evidence_reference_count,
    'INTEGRATION_ADJUDICATION_ERROR: J-001 duplicate Evidence reference' AS twice, 'INTEGRATION_ADJUDICATION_ERROR: unknown Evidence reference message:none' AS stray FROM two""")
def hlp11_judged_files(spark, sf):
    """HLP-11: answers to every cluster's document, checked as files; and such with a reference twice, and to nothing."""
    p = own_dir(spark, "judged")
    _sections(_messages(spark, sf), f"{p}/bundle")
    _candidates(spark, sf, f"{p}/cand")
    verbs.export_adjudication(spark, f"{p}/cand", f"{p}/bundle", f"{p}/adj", 2)
    d = spark.read.json(f"{p}/adj/clusters")
    first = F.col("evidence")[0]

    def answer(name: str, refs) -> str:
        none = F.array().cast("array<string>")
        judgment = F.struct(F.lit("J-001").alias("judgment_id"), F.lit("same_decision").alias("relation"), F.col("allowed_decision_keys").alias("member_decision_keys"), F.array(F.lit("why")).alias("rationale"), refs.alias("evidence_refs"), F.lit("high").alias("confidence"), none.alias("missing_information"))
        d.select("cluster_id", F.array(judgment).alias("judgments"), none.alias("unclassified_decision_keys")).write.json(f"{p}/{name}")
        return f"{p}/{name}"

    ref = lambda kind, name: F.struct(kind.alias("evidence_type"), name.alias("evidence_id"))
    own = ref(first["evidence_type"], first["evidence_id"])
    said = {}
    for name, refs in (("twice", F.array(own, own)), ("stray", F.array(ref(F.lit("message"), F.lit("none"))))):
        try:
            verbs.validate_adjudication(spark, f"{p}/adj", answer(name, refs))
        except errors.AdjudicationFailure as e:
            said[name] = str(e)
    rows = verbs.validate_adjudication(spark, f"{p}/adj", answer("good", F.array(own)))
    names = ("cluster_id", "decision_count", "classified_decision_count", "unclassified_decision_count", "judgment_count", "evidence_reference_count")
    return spark.createDataFrame([(*(r[n] for n in names), said.get("twice"), said.get("stray")) for r in rows], "cluster_id string, decision_count int, classified_decision_count int, unclassified_decision_count int, judgment_count int, evidence_reference_count int, twice string, stray string")


# What is wrong with a bundle, and what the verb says to it; @ is a conversation's first message.
_FAULTS = (
    ("state", "INTEGRATION_ADJUDICATION_ERROR: candidate bundle is not ready for review"), ("merged", "INTEGRATION_ADJUDICATION_ERROR: candidate bundle must not contain an automatic merge"), ("count", "INTEGRATION_ADJUDICATION_ERROR: candidate cluster count mismatch"),
    ("none", "INTEGRATION_ADJUDICATION_ERROR: candidate bundle contains no clusters"), ("small", "INTEGRATION_ADJUDICATION_ERROR: candidate bundle contains an invalid cluster"), ("full", "INTEGRATION_ADJUDICATION_ERROR: output directory is not empty"),
    ("conflict", "INTEGRATION_CANDIDATE_ERROR: conflicting Evidence record: message:@"), ("gold", "INTEGRATION_CANDIDATE_ERROR: candidate Section must not be marked Gold: SEC-001"), ("signals", "input already carries signals"), ("full arms", "KNOWLEDGE_EXPERIMENT_ERROR: output directory is not empty"),
    ("good", "CLUSTERS"),
)


@query(f"WITH {_LINES}, {values('f', 'fault, said', _FAULTS)} SELECT fault, replace(replace(said, 'CLUSTERS', (SELECT count(*) FROM two)::VARCHAR), '@', (SELECT min(id) FROM m)) AS said FROM f")
def val09_refusals(spark, sf):
    """VAL-09, SNK-16, HLP-03, PRJ-18: bundles of all conversations, each with one fault."""
    p, m = own_dir(spark, "faults"), _messages(spark, sf)
    _sections(m, f"{p}/good")
    _sections(m, f"{p}/gold", gold=True)
    first = m.agg(F.min("evidence_id")).first()[0]
    twin = m.where(F.col("evidence_id") == first).withColumn("content", F.lit("another text")).withColumn("section_id", F.lit("SEC-005"))
    _sections(m.unionByName(twin), f"{p}/conflict")
    _candidates(spark, sf, f"{p}/cand")
    _candidates(spark, sf, f"{p}/cand-none", members=0)
    _candidates(spark, sf, f"{p}/cand-small", members=1)
    for name, said in (("state", {"state": "draft"}), ("merged", {"automatic_merge_performed": True}), ("count", {"candidate_cluster_count": -1})):
        _candidates(spark, sf, f"{p}/cand-{name}", **said)
    for with_signals in (False, True):
        text = F.to_json(F.struct(F.lit("x").alias("session_id"), F.collect_list(F.struct("evidence_id", *([F.lit(1).alias("signals")] if with_signals else []))).alias("messages")))
        m.groupBy("session_id", projection.part_of(F.col("source_line"), 100_000)).agg(text.alias("value")).select("value").write.text(f"{p}/projected{int(with_signals)}/analysis_session")
    sinks.write_text(spark, f"{p}/there/file", "x")
    review = lambda cand, bundle, out: str(verbs.export_adjudication(spark, f"{p}/{cand}", f"{p}/{bundle}", out)["clusters"])
    tries = {name: (lambda n=name: review(f"cand-{n}", "good", f"{p}/out-{n}")) for name in ("state", "merged", "count", "none", "small")}
    tries |= {"full": lambda: review("cand", "good", f"{p}/there"), "conflict": lambda: review("cand", "conflict", f"{p}/out-conflict"), "gold": lambda: review("cand", "gold", f"{p}/out-gold"), "good": lambda: review("cand", "good", f"{p}/out-good"),
              "signals": lambda: verbs.export_experiment(spark, f"{p}/projected1", f"{p}/out-signals", "k"), "full arms": lambda: verbs.export_experiment(spark, f"{p}/projected0", f"{p}/there", "k")}
    out = []
    for name, _ in _FAULTS:
        try:
            said = tries[name]()
        except errors.EngineError as e:
            said = str(e).split(": /")[0].split(": file:")[0]
        except Exception as e:  # raised inside a job
            said = "input already carries signals" if "input already carries signals" in str(e) else f"{type(e).__name__}: {str(e)[:200]}"
        out.append((name, said))
    return spark.createDataFrame(out, "fault string, said string")


@query(f"""WITH {_FILES}, z AS (SELECT f, sum(strlen(line) + 1) AS size FROM fl GROUP BY 1), part AS (SELECT substr(sha, 1, 3) AS part, sha256(string_agg(sha, chr(10) ORDER BY sha)) AS d FROM sha GROUP BY 1),
    whole AS (SELECT sha256(string_agg(part || ':' || d, chr(10) ORDER BY part || ':' || d)) AS tree FROM part) SELECT CAST(size AS BIGINT) AS size, sha AS sha256, tree, sha256('prompt') AS text FROM sha JOIN z USING (f), whole""")
def snk18_digests(spark, sf):
    """SNK-18, HLP-08: a manifest of seven files with all events, and their provenance."""
    path = log_files(spark, sf)
    p = sinks.provenance(spark, {"logs": path}, {"prompt": "prompt"})
    return sinks.manifest(spark, path).select("size", "sha256", F.lit(p["inputs"]["logs"]).alias("tree"), F.lit(p["texts"]["prompt"]).alias("text"))


_SOME = "(SELECT DISTINCT c FROM ch ORDER BY 1 LIMIT 3)"


@query(f"""WITH {CHATS}, few AS {_SOME} SELECT s AS session_id, '# Conversation' || chr(10) || chr(10) || string_agg('### ' || s || '-msg-' || lpad((t + 1)::VARCHAR, 6, '0') || chr(10) || chr(10) || '**' || upper(role[1]) || role[2:] || '**' || chr(10) || chr(10) || text || chr(10) || chr(10)
    || 'Source JSONL line: ' || (t + 1) || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY t) AS conversation, '## ' || string_agg('D-' || lpad(t::VARCHAR, 3, '0') || ' ' || role, chr(10) || '## ' ORDER BY t) AS chapters FROM ch JOIN few USING (c) GROUP BY s""")
def hlp09_rendered(spark, sf):
    """HLP-09, SRT-09: Markdown files of three sessions of a store that holds all, whose second run has its decisions in reverse order."""
    store, c = own_dir(spark, "rendered"), chats(spark, sf)
    events = c.select(F.format_string("%s-msg-%06d", "s", F.col("t") + 1).alias("id"), F.col("s").alias("session_id"), (F.col("t") + 1).alias("source_line"), F.lit("message").alias("kind"), "role", F.col("text").alias("content"))
    have = [f.split(" ") for f in schemas.EVENTS.split(", ")]
    events = events.select(*(F.col(n) if n in events.columns else F.lit(None).cast(k).alias(n) for n, k in have))
    sinks.publish({"events": events, "sessions": c.select(F.col("s").alias("id")).distinct()}, store, "all")
    out, none = [], F.array().cast("array<string>")
    for s in [r["s"] for r in c.select("c", "s").distinct().orderBy("c").limit(3).collect()]:
        for order in ("asc", "desc"):
            made = c.where(F.col("s") == s).select(F.format_string("D-%03d", "t").alias("decision_id"), F.col("role").alias("title") if order == "desc" else F.lit("old").alias("title"), F.lit("d").alias("decision"), F.lit(None).cast("string").alias("context"), none.alias("alternatives"), none.alias("rationale"),
                                                   F.array().cast(schemas.ALTERNATIVES).alias("rejected_alternatives"), none.alias("risks"), none.alias("revisit_conditions"), F.array("s").alias("evidence_message_ids"), F.lit("high").alias("confidence"), none.alias("missing_information"), F.lit("accepted").alias("status"))
            sinks.save_run(spark, store, verbs.stored(spark, store, "analysis_runs", verbs.RUNS), s, made.orderBy(F.desc("decision_id") if order == "desc" else "decision_id"), "v1", "manual")
        verbs.render_session(spark, store, s, f"{store}/md/{s}")
        read = lambda name: spark.read.text(f"{store}/md/{s}/{name}", wholetext=True).first()[0]
        out.append((s, read("conversation.md"), "\n".join(x for x in read("decisions.md").split("\n") if x.startswith("## "))))
    return spark.createDataFrame(out, "session_id string, conversation string, chapters string")


@query(f"""WITH {CHATS}, z AS (SELECT sum(strlen('{{"session_id":"x","actor":"' || a || '","content":"no hint","evidence_id":"' || s || ':' || t || '","section_id":"SEC-001","source_line":' || t || '}}')) AS a, sum(CASE WHEN a = 'system' THEN 17 ELSE 16 END) AS b, count(*) FILTER (a <> 'system') AS n
    FROM (SELECT *, CASE role WHEN 'user' THEN 'human' ELSE role END AS a FROM ch)) SELECT CAST(n AS BIGINT) AS examined, CAST(a + b AS DOUBLE) / CAST(a AS DOUBLE) - 1 AS growth FROM z""")
def snk06_growth(spark, sf):
    """SNK-06: how much larger the annotated projection is; here only by what says whether a message was examined."""
    p = own_dir(spark, "growth")
    m = chats(spark, sf).select(F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("actor"), F.lit("no hint").alias("content"), F.concat_ws(":", "s", "t").alias("evidence_id"), F.lit("SEC-001").alias("section_id"), F.col("t").alias("source_line"))
    m.select(F.struct("*").alias("m")).groupBy(F.lit("x").alias("session_id"), F.pmod(F.xxhash64("m.evidence_id"), F.lit(200)).alias("part")).agg(F.collect_list("m").alias("messages")).drop("part").write.json(f"{p}/in/analysis_session")
    spark.createDataFrame([], "attachment_id string").write.json(f"{p}/in/attachments")
    r = verbs.export_signals(spark, f"{p}/in", f"{p}/out")
    return spark.createDataFrame([(r["messages_examined"], r["growth"])], "examined long, growth double")
