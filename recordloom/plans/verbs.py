"""The engine's verbs: each reads tables or files, writes tables or bundles, and returns a small report.

A store is a folder of Parquet tables: sessions, raw_events, events, analysis_runs, decisions, decision_evidence. A bundle is a
folder of JSON documents, one line each, that goes to an external reader; results come back as JSON files. No verb calls a model.
A document of more than projection.PART lines of a log is several lines, its parts by source line, each of which says what it belongs to.
"""

from __future__ import annotations

import inspect
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors, schemas, session
from ..functions.shape import at, items, text_at
from ..operators import assembly, capped, clusters, lifecycle, normalize, projection, render, sections, signals, similarity, validation
from ..sources import logs, sinks

SESSIONS = "id string, source_type string, source_file string, source_sha256 string, created_at timestamp, normalized_at timestamp"
RUNS = "run_id int, session_id string, prompt_version string, runner_type string, status string, created_at timestamp"


def stored(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    """A table of the store as of now; empty where it hasn't been written."""
    return sinks.read(spark, store, name, schema)


def events_in(spark: SparkSession, store: str, session_id: str) -> DataFrame:
    if not logs.session_exists(stored(spark, store, "sessions", SESSIONS), session_id):
        raise errors.SessionNotFound(session_id)
    return logs.events_of(stored(spark, store, "events", schemas.EVENTS), session_id)


def rows(df: DataFrame) -> list[dict]:
    """Rows of a small report."""
    return [r.asDict(recursive=True) for r in df.collect()]


def ingest(spark: SparkSession, source: str, store: str, adapter: str = "default") -> list[dict]:
    """Loads log files; bytes that were loaded before are left out. A loss report per new session. The batch is named by the digests of
    its files, so that a run that died is repeated over itself. Lines are parsed once; the report compares what was stored of them with the
    files' lines, which are read again."""
    lines = logs.read_log(spark, source, seen=stored(spark, store, "sessions", SESSIONS))
    adapted = session.stored(normalize.adapted(lines, adapter), "adapted")
    raw, events = normalize.events_of(adapted)
    found = adapted.groupBy("session_id", "source_sha256").agg(F.min("path").alias("source_file"))
    now = F.current_timestamp()
    new = found.select(F.col("session_id").alias("id"), F.lit("jsonl").alias("source_type"), "source_file", "source_sha256", now.alias("created_at"), now.alias("normalized_at"))
    report = rows(normalize.loss_report(normalize.normalize(lines, adapter)[0], events)) if adapted.head(1) else []
    if report:
        marks = found.agg(F.sum(F.xxhash64("source_sha256").cast("decimal(38,0)")).alias("x")).first()["x"]
        sinks.publish({"raw_events": raw, "events": events, "sessions": new}, store, f"files-{len(report)}-{marks}")
    return report or [{"status": "already_ingested"}]


def export_analysis(spark: SparkSession, store: str, session_id: str, out: str, prompt: str = "", schema: str = "", messages: str | None = None, attachments: str | None = None) -> dict:
    """The projection of a session as a bundle, with prompt and schema; with messages (JSONL), its evidence ids too."""
    events = events_in(spark, store, session_id)
    joined = None
    if messages:
        m = logs.read_jsonl(spark, messages, "raw_line int, message_id string, actor string, section_id string")
        a = logs.read_jsonl(spark, attachments, "attachment_id string, parent_message_ids array<string>, section_ids array<string>, content string, sha256 string, authority_note string") if attachments else spark.createDataFrame([], "attachment_id string, parent_message_ids array<string>, section_ids array<string>, content string")
        errors.raise_first(sections.input_violations(m, a), errors.ProjectionInput)
        joined, bad = projection.with_evidence(projection.messages(events), m.withColumn("session_id", F.lit(session_id)))
        errors.raise_first(bad, errors.ProjectionInput)
        joined = joined.select("session_id", "source_line", "id", "evidence_id", "section_id", "actor", "content")
        a.write.mode("overwrite").json(f"{out}/attachments")
    projection.project(events, joined, parts=True).drop("part").withColumn("projection_version", F.lit("3" if messages else "1")).write.mode("overwrite").json(f"{out}/analysis_session")
    sinks.write_text(spark, f"{out}/prompt.md", prompt)
    sinks.write_text(spark, f"{out}/schema.json", schema)
    report = rows(projection.report(events))[0]
    sinks.write_json(spark, f"{out}/report.json", report)
    return report


def decision_items(spark: SparkSession, path: str, doc: str) -> DataFrame:
    """The decisions of a result file, as doc, pos, item; another root than {decisions: [...]} is an error."""
    d = logs.read_documents(spark, path)
    if d.where(F.size(items(at(F.col("doc"), "decisions"))).isNull() | (F.size(F.json_object_keys("text")) != 1)).head(1):
        raise errors.DecisionInvalid("root must contain only a decisions array")
    return d.select(F.lit(doc).alias("doc"), F.posexplode(items(at(F.col("doc"), "decisions"))).alias("pos", "item"))


def check_decisions(d: DataFrame, known: DataFrame, version: int) -> None:
    bad = validation.decision_errors(d, version).where("error is not null").select(F.col("pos").alias("ord"), F.format_string("decision[%d]: %s", "pos", "error").alias("message"))
    errors.raise_first(bad, errors.DecisionInvalid)
    gone = validation.missing_evidence(validation.references(d, version), known).select(F.lit(0).alias("ord"), F.concat_ws(":", "evidence_type", "evidence_id").alias("message"))
    errors.raise_first(gone, errors.EvidenceNotFound)


def import_analysis(spark: SparkSession, store: str, session_id: str, decisions: str, prompt_version: str = "v1", runner: str = "manual") -> dict:
    """Checks version 1 decisions against the session's messages and appends them as a completed run."""
    known = logs.message_ids(events_in(spark, store, session_id)).select(F.col("session_id").alias("doc"), F.lit("message").alias("evidence_type"), "evidence_id")
    d = decision_items(spark, decisions, session_id)
    check_decisions(d, known, 1)
    typed = d.select(F.from_json(F.to_json("item"), schemas.DECISIONS_V1).alias("x")).select("x.*")
    run = sinks.save_run(spark, store, stored(spark, store, "analysis_runs", RUNS), session_id, typed, prompt_version, runner)
    return {"run_id": run, "decisions": typed.count()}


def render_session(spark: SparkSession, store: str, session_id: str, out: str) -> dict:
    """conversation.md, and decisions.md of the latest completed run."""
    events = events_in(spark, store, session_id).where("kind = 'message'")
    found = logs.latest_decisions(stored(spark, store, "analysis_runs", RUNS), stored(spark, store, "decisions", schemas.DECISIONS_V1 + ", run_id int, session_id string")).where(F.col("session_id") == session_id)
    made = {}
    for name, df in (("conversation.md", render.conversation(events)), ("decisions.md", render.decisions(found))):
        one = df.head(1)
        text = one[0]["markdown"] if one else ""
        sinks.write_text(spark, f"{out}/{name}", text)
        made[name] = len(text)
    return made


def analysis(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, attachments) of an exported version 3 projection. A line of a session's document is one task's to read; its messages are dealt to all."""
    d = spark.read.json(f"{path}/analysis_session")
    m = d.select("session_id", F.explode("messages").alias("m")).select("session_id", "m.*").repartition("source_line")
    a = spark.read.schema("attachment_id string, parent_message_ids array<string>, section_ids array<string>, content string").json(f"{path}/attachments")
    return m, a


def validate_decisions_v3(spark: SparkSession, projected: str, decisions: str) -> dict:
    m, a = analysis(spark, projected)
    errors.raise_first(validation.analysis_violations(spark.read.json(f"{projected}/analysis_session"), m, a), errors.DecisionInvalid)
    doc = m.select("session_id").head(1)[0]["session_id"]
    known = validation.known_evidence(m.select(F.lit(doc).alias("doc"), "evidence_id"), a.select(F.lit(doc).alias("doc"), "attachment_id"))
    d = decision_items(spark, decisions, doc)
    check_decisions(d, known, 3)
    refs = validation.references(d)
    return rows(d.agg(F.count(F.lit(1)).alias("decisions")).crossJoin(refs.agg(F.count_if(F.col("evidence_type") == "message").alias("message_evidence_references"), F.count_if(F.col("evidence_type") == "attachment").alias("attachment_evidence_references"))))[0]


def section_documents(m: DataFrame, a: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """session_id, section_id, part, section_scope, messages (in order of source_line), attachments of each section, and literal columns. A section's
    parts follow each other by source line; its first has the attachments."""
    cols = [c for c in ("source_line", "evidence_id", "actor", "content", "signals", "previous") if c in m.columns]
    part, by = projection.part_of(F.col("source_line")).alias("part"), ["session_id", "section_id"]
    d = m.groupBy(*by, part).agg(F.array_sort(F.collect_list(F.struct("source_line", "evidence_id", F.struct(*cols).alias("m")))).alias("_m"))
    d = d.withColumn("messages", F.transform("_m", lambda x: x["m"])).drop("_m")
    first = m.groupBy(*by).agg(F.min(part).alias("part"))
    at_ = sections.attachment_sections(a).groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("attachment_id", "content"))).alias("attachments"))
    d = d.join(first.join(at_, "section_id"), [*by, "part"], "left").withColumn("section_scope", F.struct("section_id", F.lit(False).alias("section_gold")))
    for name, value in (extra or {}).items():
        d = d.withColumn(name, F.lit(value))
    return d


def export_sections(spark: SparkSession, projected: str, out: str, index: str | None = None, guidance: str = "", prompt: str = "", knowledge: str | None = None, hybrid: bool = False, annotators: str = "", analyser: str = "") -> dict:
    """A document per section (SNK-04); hybrid adds signals, of the annotators named too, and knowledge (SNK-05)."""
    sinks.refuse_non_empty(spark, out, errors.SectionBundle)
    m, a = analysis(spark, projected)
    if index:
        ix = spark.read.json(index).select("section_id", F.col("source.message_ids").alias("message_ids"), F.col("source.attachment_ids").alias("attachment_ids"))
        errors.raise_first(sections.membership_violations(m, ix).unionByName(sections.attachment_violations(a, m, ix)), errors.SectionBundle)
    m = session.stored(signals.annotate(m, annotators=named(annotators), analyser=analyser) if hybrid else m, "sections-of")
    made = section_documents(m, a, {"interpretation_knowledge": knowledge} if hybrid and knowledge else None)
    sinks.fan_out(made, f"{out}/sections", "section_id", part="part")
    sinks.write_text(spark, f"{out}/prompt.md", sinks.with_guidance(guidance, prompt))
    report = {"sections": made.select("session_id", "section_id").distinct().count()} | (rows(signals.roll_up(signals.counts(m, ["session_id", "section_id"]), ["session_id"]))[0] if hybrid else {})
    sinks.manifest(spark, f"{out}/sections").write.json(f"{out}/manifest")
    sinks.write_text(spark, f"{out}/RUN_INSTRUCTIONS.md", sinks.instructions("Decision extraction by section", "sections", report["sections"], ["prompt.md", "the section's document"], "sections/SEC-ddd/decisions.raw.json", "validate-decisions-v3"))
    sinks.write_json(spark, f"{out}/provenance.json", sinks.provenance(spark, {"projection": projected}, {"prompt": sinks.with_guidance(guidance, prompt), "knowledge": knowledge or ""}))
    sinks.write_json(spark, f"{out}/report.json", report)
    return report


def named(names: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in names.split(",") if n.strip())


def export_signals(spark: SparkSession, projected: str, out: str, annotators: str = "", analyser: str = "") -> dict:
    """The projection with signals, and how much it grew. annotators (lemma,dependency) need an analyser (package.module:function or
    spacy:MODEL) and are refused without it."""
    sinks.refuse_non_empty(spark, out, errors.SignalFailure)
    m, _ = analysis(spark, projected)
    if "signals" in m.columns:
        raise errors.SignalFailure("input already carries signals")
    d = session.stored(signals.annotate(m, annotators=named(annotators), analyser=analyser), "annotated")
    d.write.json(f"{out}/messages")
    size = d.agg(F.sum(F.octet_length(F.to_json(F.struct(*m.columns)))).alias("a"), F.sum(F.octet_length(F.to_json(F.struct(*d.columns)))).alias("b")).first()
    report = rows(signals.annotation_report(d, named(annotators)))[0] | {"growth": (size["b"] / size["a"] - 1) if size["a"] else 0.0}
    sinks.write_json(spark, f"{out}/report.json", report)
    return report


def export_experiment(spark: SparkSession, projected: str, out: str, knowledge: str) -> dict:
    """Two arms of a projection: as it is, and with knowledge."""
    sinks.refuse_non_empty(spark, out, errors.KnowledgeFailure)
    text = spark.read.text(f"{projected}/analysis_session").select(F.col("value").alias("document"))
    d = text.select(F.get_json_object("document", "$.session_id").alias("session_id"), "document", F.contains("document", F.lit('"signals":')).alias("has_signals"))
    sinks.arms(d, knowledge).write.partitionBy("arm").json(f"{out}/arms")
    return {"arms": 2, "sessions": d.select("session_id").distinct().count()}


def bundle_sections(spark: SparkSession, bundle: str) -> DataFrame:
    """The documents of a section bundle: of one session, each of the section that it says, none marked as gold."""
    docs = spark.read.json(f"{bundle}/sections")
    errors.raise_first(validation.scope_violations(docs).unionByName(validation.session_violations(docs)), errors.CandidateFailure)
    return docs


def load_runs(spark: SparkSession, bundle: str, results: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, decisions, known evidence) of an exported section bundle and result files results/sections/SEC-ddd/decisions.raw.json
    with RUN_RESULT.json beside them, which records output_sha256 (or sha256), and the validated output's name and hash if there
    is one; that file is read instead."""
    docs = bundle_sections(spark, bundle)
    files = logs.section_files(spark, results, "*.json").withColumn("name", F.element_at(F.split("path", "/"), -1))
    said = lambda k: text_at(F.col("doc"), k)
    ran = files.where("name = 'RUN_RESULT.json'").select("section_id", said("validated_output_path").alias("validated_output_path"), said("validated_output_sha256").alias("validated_output_sha256"), F.coalesce(said("output_sha256"), said("sha256")).alias("output_sha256"))
    every = files.where("name <> 'RUN_RESULT.json'").select("section_id").distinct().join(ran, "section_id", "left")
    wanted = logs.preferred(every, files.select("section_id", "name")).select("section_id", F.col("decisions_name").alias("name"), "recorded_sha256")
    checked = logs.verify_hashes(files.join(wanted.select("section_id", "name"), ["section_id", "name"]).select("section_id", "sha256", "doc"), wanted, ["section_id"])
    have = docs.select(F.col("section_id").alias("doc")).distinct().join(checked.select(F.col("section_id").alias("doc"), "hash_matches", (F.size(items(at(F.col("doc"), "decisions"))) >= 0).alias("root_ok")), "doc", "left")
    states = have.select("doc", F.col("hash_matches").isNotNull().alias("has_output"), F.coalesce("root_ok", F.lit(False)).alias("root_ok"), F.coalesce("hash_matches", F.lit(False)).alias("hash_matches"))
    d = checked.select(F.col("section_id").alias("doc"), F.posexplode(items(at(F.col("doc"), "decisions"))).alias("pos", "item"))
    m = docs.select(F.col("section_id").alias("doc"), F.explode("messages").alias("m")).select("doc", "m.evidence_id")
    none = spark.createDataFrame([], "doc string, attachment_id string")
    a = docs.select(F.col("section_id").alias("doc"), F.explode("attachments").alias("a")).select("doc", "a.attachment_id") if "attachments" in docs.columns else none
    return states, d, validation.known_evidence(m, a)


def finalize_runs(spark: SparkSession, bundle: str, results: str, out: str) -> dict:
    """Checks, repairs and partly accepts section results; writes accepted and rejected decisions and a summary."""
    sections_, d, known = load_runs(spark, bundle, results)
    states = validation.section_states(sections_, d, known)
    good, bad = validation.split_valid(d, known)
    usable = states.where("state in ('valid', 'partially_valid')").select("doc")
    good.join(usable, "doc", "left_semi").select("doc", "pos", F.to_json("item").alias("item"), "repaired_fields").write.mode("overwrite").parquet(f"{out}/decisions")
    bad.select("doc", "pos", F.to_json("item").alias("item"), "error").write.mode("overwrite").parquet(f"{out}/rejected")
    states.write.mode("overwrite").parquet(f"{out}/sections")
    report = rows(validation.run_summary(states))[0]
    sinks.write_json(spark, f"{out}/summary.json", report)
    return report


def inventory_of(spark: SparkSession, finalized: str, session_id: str) -> DataFrame:
    d = spark.read.parquet(f"{finalized}/decisions")
    x = d.select("doc", F.from_json("item", schemas.DECISIONS_V3).alias("x"), F.sha2("item", 256).alias("source_sha256"))
    return x.select(F.lit(session_id).alias("session_id"), F.concat_ws(":", "doc", "x.decision_id").alias("source_decision_key"), F.col("doc").alias("section_id"), F.col("x.decision_id").alias("source_decision_id"),
                    *(F.col(f"x.{c}") for c in schemas.V3_FIELDS if c != "decision_id"), F.concat(F.lit("sections/"), "doc").alias("source_file"), "source_sha256")


#: What a finished candidate bundle says of itself.
READY = "candidate_bundle_ready_for_review"


def check_candidates(spark: SparkSession, candidates: str, made: DataFrame) -> None:
    """A candidate bundle may be reviewed: finished, nothing merged, with as many clusters as its evaluation says, one at least."""
    e = logs.read_documents(spark, f"{candidates}/evaluation.json").select(text_at(F.col("doc"), "state").alias("state"), F.try_variant_get("doc", "$.automatic_merge_performed", "boolean").alias("merged"),
                                                                          F.coalesce(F.try_variant_get("doc", "$.candidate_cluster_count", "bigint"), F.lit(0)).alias("n")).first()
    found = made.agg(F.count(F.lit(1)).alias("n"), F.count_if("automatic_merge_allowed").alias("merges"), F.count_if(F.size("member_decision_keys") < 2).alias("small"), F.countDistinct("cluster_id").alias("ids")).first()
    for bad, message in ((e["merged"] is not False or found["merges"], "candidate bundle must not contain an automatic merge"), (not found["n"], "candidate bundle contains no clusters"),
                         (e["n"] != found["n"], "candidate cluster count mismatch"), (e["state"] != READY, "candidate bundle is not ready for review"), (found["small"] or found["ids"] != found["n"], "candidate bundle contains an invalid cluster")):
        if bad:
            raise errors.AdjudicationFailure(message)


def section_messages(docs: DataFrame) -> DataFrame:
    return docs.select("session_id", "section_id", F.explode("messages").alias("m")).select("session_id", "section_id", "m.evidence_id", "m.actor", F.col("m.source_line").cast("int").alias("source_line"), "m.content")


def export_candidates(spark: SparkSession, finalized: str, session_id: str, out: str) -> dict:
    """Inventory, candidate pairs, clusters and evaluation."""
    sinks.refuse_non_empty(spark, out, errors.CandidateFailure)
    inv = inventory_of(spark, finalized, session_id)
    twice = inv.groupBy("source_decision_key").count().where("count > 1").select(F.lit(0).alias("ord"), F.concat(F.lit("duplicate source_decision_key: "), "source_decision_key").alias("message"))
    errors.raise_first(twice, errors.CandidateFailure)
    inv.write.parquet(f"{out}/inventory")
    inv = spark.read.parquet(f"{out}/inventory")
    feats = similarity.features(inv)
    capped.best_pairs(feats, similarity.PARAMETERS["max_candidates"]).write.parquet(f"{out}/capped")
    pairs = spark.read.parquet(f"{out}/capped")
    capped.clustered(pairs, similarity.PARAMETERS["max_cluster"]).write.parquet(f"{out}/members")
    chosen = spark.read.parquet(f"{out}/members")
    similarity.detailed(capped.mark_edges(pairs, chosen), feats).write.parquet(f"{out}/pairs")
    marked = spark.read.parquet(f"{out}/pairs")
    clusters.clusters(feats, inv, marked, chosen).write.parquet(f"{out}/clusters")
    e = rows(clusters.evaluation(inv, marked, spark.read.parquet(f"{out}/clusters")))
    report = (e[0] if e else {}) | {"parameters": similarity.PARAMETERS, "automatic_merge_performed": False, "state": READY}
    sinks.write_json(spark, f"{out}/evaluation.json", report, sort=True)
    if e:
        sinks.write_text(spark, f"{out}/report.md", sinks.candidate_report(e[0]))
    return report


def export_adjudication(spark: SparkSession, candidates: str, bundle: str, out: str, version: int = 1) -> dict:
    """A document per cluster without the machine's label; version 2 also leaves out sections and files and lists the keys."""
    sinks.refuse_non_empty(spark, out, errors.AdjudicationFailure)
    made, inv = spark.read.parquet(f"{candidates}/clusters"), spark.read.parquet(f"{candidates}/inventory")
    check_candidates(spark, candidates, made)
    docs = bundle_sections(spark, bundle)
    m = section_messages(docs)
    ev = m.select("session_id", F.lit("message").alias("evidence_type"), "evidence_id", "content", "section_id", "source_line")
    if "attachments" in docs.columns:
        a = docs.select("session_id", "section_id", F.explode("attachments").alias("a"))
        ev = ev.unionByName(a.select("session_id", F.lit("attachment").alias("evidence_type"), F.col("a.attachment_id").alias("evidence_id"), F.col("a.content").alias("content"), F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("int").alias("source_line")))
    key = ["session_id", "evidence_type", "evidence_id"]
    errors.raise_first(validation.registry_conflicts(ev, key).select(F.lit(0).alias("ord"), F.concat(F.lit("conflicting Evidence record: "), "evidence_type", F.lit(":"), "evidence_id").alias("message")), errors.CandidateFailure)
    ev = ev.dropDuplicates(key)
    inputs = clusters.review_inputs(made, inv, ev, sections.neighbors(m).select("session_id", "evidence_id", "previous", "next"), blind=version == 2).drop(*(["candidate_relation"] if version == 1 else []))
    if version == 2:
        none = F.array().cast("array<string>")
        inputs = inputs.withColumn("allowed_decision_keys", F.transform("decisions", lambda d: d["source_decision_key"])).withColumn("output_skeleton", F.struct("cluster_id", none.alias("judgments"), none.alias("unclassified_decision_keys")))
    inputs = inputs.withColumn("mode", F.lit("isolated_cluster_adjudication"))
    sinks.documents(inputs, f"{out}/clusters", "cluster_id")
    report = {"clusters": made.count(), "version": version}
    sinks.write_text(spark, f"{out}/RUN_INSTRUCTIONS.md", sinks.instructions("Adjudication of clusters", "clusters", report["clusters"], ["the prompt", "the cluster's document (a line of clusters/)"], "adjudication.raw.json", "validate-integration-adjudication"))
    sinks.write_json(spark, f"{out}/provenance.json", sinks.provenance(spark, {"candidates": f"{candidates}/clusters", "sections": f"{bundle}/sections"}, {}))
    return report


def read_adjudication(spark: SparkSession, inputs: str, results: str) -> tuple[DataFrame, ...]:
    """(judgments, decisions, evidence, unclassified) of exported inputs and result documents (JSON lines)."""
    want = "cluster_id string, judgments array<struct<" + schemas.JUDGMENTS.split("pos int, ")[1].replace(" string", ":string").replace(" array", ":array").replace(" struct", ":struct").replace(", ", ",") + ">>, unclassified_decision_keys array<string>"
    r = spark.read.schema(want).json(results)
    j = r.select("cluster_id", F.posexplode("judgments").alias("pos", "j")).select("cluster_id", "pos", "j.*")
    u = r.select("cluster_id", F.explode("unclassified_decision_keys").alias("source_decision_key"))
    i = spark.read.json(f"{inputs}/clusters")
    d = i.select("session_id", "cluster_id", F.explode("decisions").alias("d")).select("session_id", "cluster_id", "d.source_decision_key")
    e = i.select("cluster_id", F.explode("evidence").alias("e")).select("cluster_id", "e.evidence_type", "e.evidence_id")
    return j, d, e, u


def validate_adjudication(spark: SparkSession, inputs: str, results: str) -> list[dict]:
    j, d, e, u = read_adjudication(spark, inputs, results)
    errors.raise_first(validation.judgment_violations(j, d.drop("session_id"), e, u), errors.AdjudicationFailure)
    return rows(validation.judgment_statistics(j, d, u))


def assemble(spark: SparkSession, candidates: str, inputs: str, results: str, out: str) -> list[dict]:
    sinks.refuse_non_empty(spark, out, errors.AdjudicationFailure)
    validate_adjudication(spark, inputs, results)
    j, d, _, u = read_adjudication(spark, inputs, results)
    other = clusters.member_mismatches(spark.read.parquet(f"{candidates}/clusters"), d)
    errors.raise_first(other.select(F.lit(0).alias("ord"), F.concat(F.lit("cluster input mismatch: "), "cluster_id").alias("message")), errors.AdjudicationFailure)
    of = d.select("session_id", "cluster_id").distinct()
    inv = spark.read.parquet(f"{candidates}/inventory")
    rels = assembly.relations(j.join(of, "cluster_id"), u.join(of, "cluster_id"), inv)
    errors.raise_first(assembly.overlapping_groups(rels).select(F.lit(0).alias("ord"), F.concat(F.lit("overlapping same_decision groups: "), "source_decision_key").alias("message")), errors.AdjudicationFailure)
    assembly.assemble(inv, rels).write.parquet(f"{out}/decisions")
    report = rows(assembly.summary(inv, rels, spark.read.parquet(f"{out}/decisions")))
    sinks.write_json(spark, f"{out}/summary.json", report)
    return report


def lifecycle_inputs(spark: SparkSession, integrated: str, bundle: str) -> tuple[DataFrame, DataFrame]:
    review, bad = lifecycle.groups(spark.read.parquet(f"{integrated}/decisions"))
    docs = bundle_sections(spark, bundle)
    m = section_messages(docs)
    a = spark.createDataFrame([], "session_id string, attachment_id string, section_ids array<string>, content string")
    if "attachments" in docs.columns:
        a = docs.select("session_id", F.array("section_id").alias("section_ids"), F.explode("attachments").alias("a")).select("session_id", "a.attachment_id", "section_ids", "a.content")
    return lifecycle.context(review, m, a, parts=True), bad


def export_lifecycle(spark: SparkSession, integrated: str, bundle: str, out: str) -> dict:
    sinks.refuse_non_empty(spark, out, errors.LifecycleFailure)
    made, bad = lifecycle_inputs(spark, integrated, bundle)
    errors.raise_first(bad, errors.LifecycleFailure)
    none = F.array().cast("array<string>")
    blank = F.transform("decision_ids", lambda x: F.struct(x.alias("decision_id"), F.lit("proposed").alias("final_status"), none.alias("rationale"), none.alias("evidence_refs"), F.lit("low").alias("confidence"), none.alias("missing_information")))
    sinks.fan_out(made.withColumn("output_skeleton", F.struct("group_id", blank.alias("results"))), f"{out}/groups", "group_id", part="part")
    report = {"groups": made.select("session_id", "group_id").distinct().count(), "state": "ready_for_lifecycle_adjudication"}
    sinks.write_text(spark, f"{out}/RUN_INSTRUCTIONS.md", sinks.instructions("Lifecycle review", "groups", report["groups"], ["the prompt", "the group's document"], "lifecycle.raw.json", "apply-lifecycle-adjudication"))
    sinks.write_json(spark, f"{out}/manifest.json", report | sinks.provenance(spark, {"integrated": f"{integrated}/decisions", "groups": f"{out}/groups"}, {}))
    return report


def apply_lifecycle(spark: SparkSession, integrated: str, bundle: str, results: str, out: str) -> list[dict]:
    """Checks the review's results (JSON lines: group_id, results) and applies them; every proposed decision must be covered."""
    sinks.refuse_non_empty(spark, out, errors.LifecycleFailure)
    d = spark.read.parquet(f"{integrated}/decisions")
    errors.raise_first(validation.id_violations(d), errors.LifecycleFailure)
    made, bad = lifecycle_inputs(spark, integrated, bundle)
    errors.raise_first(bad, errors.LifecycleFailure)
    want = "group_id string, results array<struct<" + schemas.LIFECYCLE_RESULTS.split("pos int, ")[1].replace(" string", ":string").replace(" array", ":array").replace(", ", ",") + ">>"
    r = spark.read.schema(want).json(results).select("group_id", F.posexplode("results").alias("pos", "r")).select("group_id", "pos", "r.*")
    ev = made.select("group_id", F.explode("messages").alias("m")).select("group_id", F.lit("message").alias("evidence_type"), "m.evidence_id")
    ev = ev.unionByName(made.select("group_id", F.explode("attachments").alias("a")).select("group_id", F.lit("attachment").alias("evidence_type"), F.col("a.attachment_id").alias("evidence_id")))
    errors.raise_first(validation.lifecycle_violations(r, made.select("group_id", "decision_ids").distinct(), ev), errors.LifecycleFailure)
    done = lifecycle.apply(d, r.join(made.select("group_id", "session_id").distinct(), "group_id"))
    done.write.parquet(f"{out}/decisions")
    done = spark.read.parquet(f"{out}/decisions")
    report = rows(lifecycle.summary(done)) + rows(lifecycle.changes(done))
    sinks.write_json(spark, f"{out}/summary.json", report)
    return report


VERBS = {
    "ingest": ingest, "export-analysis": export_analysis, "import-analysis": import_analysis, "render": render_session, "validate-decisions-v3": validate_decisions_v3,
    "export-section-analysis": export_sections, "export-integration-candidates": export_candidates, "export-integration-adjudication": export_adjudication, "validate-integration-adjudication": validate_adjudication,
    "export-integration-adjudication-v2": lambda spark, candidates, bundle, out: export_adjudication(spark, candidates, bundle, out, 2), "assemble-integrated-decisions": assemble, "export-signal-analysis": export_signals,
    "export-knowledge-experiment": export_experiment, "export-hybrid-section-analysis": lambda spark, projected, out, **more: export_sections(spark, projected, out, hybrid=True, **more),
    "finalize-hybrid-section-runs": finalize_runs, "export-lifecycle-review": export_lifecycle, "apply-lifecycle-adjudication": apply_lifecycle,
}


def usage(verb: str) -> str:
    """The verb with its arguments, and what those that may be left out default to."""
    own = [p for p in inspect.signature(VERBS[verb]).parameters.values() if p.name != "spark" and p.kind is p.POSITIONAL_OR_KEYWORD]
    return " ".join([verb, *(f"{p.name}=..." if p.default is p.empty else f"[{p.name}={p.default or ''}]" for p in own)])


def main(args: list[str], spark: SparkSession | None = None) -> int:
    """verb key=value ...: prints the report; 1 for an unknown verb, 2 for arguments that it doesn't take and for an error of the
    engine's or of files."""
    from ..session import local_session

    if not args or args[0] not in VERBS:
        print("verbs: " + ", ".join(VERBS))
        return 1
    verb, given = args[0], dict(a.partition("=")[::2] for a in args[1:])
    try:
        inspect.signature(VERBS[verb]).bind(spark, **given)
    except TypeError:
        print("usage: " + usage(verb))
        return 2
    try:
        print(json.dumps(VERBS[verb](spark or local_session(), **given), ensure_ascii=False, default=str))
    except (errors.EngineError, OSError, ValueError) as e:
        print(e)
        return 2
    return 0
