"""Registry of the engine's queries on the driver's tables; each runs over whole tables and texts.

Tables stand in for the engine's inputs: a conversation is a session and its turns are lines, messages or decisions; users'
events are a log; pages hold tagged blocks; orders are runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shape import at
from ..functions.text import event_id, normalized, percent, short_hash, strip_blocks, tech_terms, trigrams
from ..operators import assembly, capped, clusters, lifecycle, normalize, projection, render, sections, signals, similarity, validation
from ..session import stored
from ..sources import logs
from . import bundles, shaped
from .sql import SQL

#: Rules for Latin-script text, in the form of the phrase rules.
LATIN_RULES = (
    ("request_candidate", "latin-request", r"(?:and the|und der|et la|y la)"), ("acceptance_candidate", "latin-acceptance", r"(?:of the|of a|de la)"),
    ("rejection_candidate", "latin-rejection", r"(?:not|nicht|pas)"), ("uncertainty_candidate", "latin-uncertainty", r"(?:th[ae]t?|ist)"),
    ("alternative_candidate", "latin-alternative", r"(?:or|oder)\s"), ("reason_candidate", "latin-reason", r"(?:for|from|by)\s"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    d = c.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).cast("int").alias("source_line"), F.lit("message").alias("kind"), "role", F.col("text").alias("content"))
    return d.withColumn("id", event_id(F.col("session_id"), F.col("kind"), F.col("source_line"))).withColumn("source_event_type", F.lit("response_item"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return projection.messages(_events(spark, sf)).withColumnRenamed("id", "evidence_id")


def _inventory(spark: SparkSession, sf: str, together: int = 1) -> DataFrame:
    """Turns as decisions, a section each; so many conversations together are a session."""
    c = table(spark, sf, "conversations")
    section = F.format_string("SEC-%03d", F.col("conv_id") % together * 8 + F.col("turn") + 1)
    ref = F.struct(F.lit("message").alias("evidence_type"), F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 2).cast("long")).alias("evidence_id"))
    none = F.array().cast("array<string>")
    return c.select(
        F.expr(f"conv_id div {together}").cast("string").alias("session_id"), F.concat(section, F.lit(":D-001")).alias("source_decision_key"), section.alias("section_id"), F.lit("D-001").alias("source_decision_id"),
        F.regexp_extract("text", r"^[^.]*", 0).alias("title"), F.col("text").alias("decision"), F.lit(None).cast("string").alias("context"), F.array("role").alias("alternatives"),
        F.array(F.concat(F.lit("turn "), (F.col("turn") % 2).cast("string"))).alias("rationale"), F.array().cast("array<struct<alternative:string,reason:string>>").alias("rejected_alternatives"), none.alias("risks"),
        none.alias("revisit_conditions"), F.when(F.col("role") == "user", "proposed").when(F.col("role") == "assistant", "accepted").otherwise("unknown").alias("status"),
        F.when(F.col("role") == "user", "high").when(F.col("role") == "assistant", "medium").otherwise("low").alias("confidence"), none.alias("missing_information"), F.array(ref).alias("evidence_refs"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as log lines: views are messages, clicks patches, purchases contexts, errors no JSON, others unseen types."""
    e = table(spark, sf, "events")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    obj = lambda kind, payload: F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))
    text = (F.when(F.col("event_type") == "view", obj("response_item", F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.col("props").alias("content"))))
            .when(F.col("event_type") == "click", obj("event_msg", F.struct(F.lit("patch_apply_end").alias("type"), F.col("props").alias("message"))))
            .when(F.col("event_type") == "purchase", obj("turn_context", F.struct(F.col("event_type").alias("type")))).when(F.col("event_type") == "error", F.col("event_type")).otherwise(obj("new_future_event", F.struct(F.lit(1).alias("x")))))
    return e.select("event_id", F.col("user_id").cast("string").alias("session_id"), line.alias("source_line"), text.alias("raw_text"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as decision documents, some of them broken: system turns' confidence, first turns' evidence, users' scalar risks."""
    c = table(spark, sf, "conversations")
    none = F.array().cast("array<string>")
    refs = F.when(F.col("turn") == 0, F.array().cast("array<struct<evidence_type:string,evidence_id:string>>")).otherwise(F.array(F.struct(F.lit("message").alias("evidence_type"), F.concat_ws(":", "conv_id", "turn").alias("evidence_id"))))
    conf = F.when(F.col("role") == "user", "high").when(F.col("role") == "assistant", "medium").otherwise("none")
    body = F.struct(F.format_string("D-%03d", F.col("turn") + 1).alias("decision_id"), F.col("role").alias("title"), F.col("text").alias("decision"), F.lit(None).cast("string").alias("context"), none.alias("alternatives"),
                    none.alias("rationale"), F.array().cast("array<struct<alternative:string,reason:string>>").alias("rejected_alternatives"), none.alias("risks"), none.alias("revisit_conditions"), refs.alias("evidence_refs"),
                    conf.alias("confidence"), none.alias("missing_information"), F.lit("accepted").alias("status"))
    json = F.to_json(body, {"ignoreNullFields": "false"})
    json = F.when((F.col("role") == "user") & (F.col("turn") > 0), F.replace(json, F.lit('"risks":[]'), F.lit('"risks":"late"'))).otherwise(json)
    return c.select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("pos"), F.parse_json(json).alias("item"))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.where("role <> 'assistant' or turn < 5").select(F.col("conv_id").cast("string").alias("doc"), F.lit("message").alias("evidence_type"), F.concat_ws(":", "conv_id", "turn").alias("evidence_id"))


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    """Judgments on turns: answers accept or supersede the turn before, system turns are no decisions, a conversation's first and
    last user turns are the same decision."""
    inv = _inventory(spark, sf)
    n = F.substring("section_id", 5, 10).cast("int")
    d = inv.select("session_id", "source_decision_key", n.alias("n"), F.col("alternatives")[0].alias("role"))
    key = lambda c: F.format_string("SEC-%03d:D-001", c)
    none = F.lit(None).cast("struct<from_decision_key:string,relation:string,to_decision_key:string>")
    life = d.where("role = 'assistant' and n > 1").select("session_id", F.col("n").alias("pos"), F.lit("lifecycle_relation").alias("relation"), F.array("source_decision_key", key(F.col("n") - 1)).alias("member_decision_keys"),
                                                         F.struct(F.col("source_decision_key").alias("from_decision_key"), F.when(F.col("n") % 4 == 2, "accepts").otherwise("supersedes").alias("relation"), key(F.col("n") - 1).alias("to_decision_key")).alias("direction"))
    drop = d.where("role = 'system'").select("session_id", (F.col("n") + 1000000).alias("pos"), F.lit("not_decision").alias("relation"), F.array("source_decision_key").alias("member_decision_keys"), none.alias("direction"))
    ends = d.where("role = 'user'").groupBy("session_id").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a < b")
    same = ends.select("session_id", F.lit(2000000).alias("pos"), F.lit("same_decision").alias("relation"), F.array(key(F.col("a")), key(F.col("b"))).alias("member_decision_keys"), none.alias("direction"))
    return life.unionByName(drop).unionByName(same).withColumn("seq", F.struct("pos"))


def _pairs(spark: SparkSession, sf: str, together: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    inv = _inventory(spark, sf, together)
    feats = similarity.features(inv)
    return inv, feats, similarity.pairs(feats)


def prj02_classify(spark, sf):
    lines = _log(spark, sf)
    _, e = normalize.normalize(lines.select("session_id", "source_line", "raw_text"))
    return e.select("id", "session_id", "source_line", "source_event_type", "kind", "role", "content")


def prj10_projection(spark, sf):
    return projection.messages(_events(spark, sf))


def prj12_strip_blocks(spark, sf):
    p = table(spark, sf, "pages").select("page_id", strip_blocks(F.col("html"), ("script", "style", "nav")).alias("t"))
    return p.select("page_id", F.md5("t").alias("digest"), F.char_length("t").cast("long").alias("n_chars"))


def prj19_repair(spark, sf):
    d = validation.repaired(_items(spark, sf))
    return d.select("doc", "pos", F.array_join("repaired_fields", ",").alias("repaired"), F.to_json(at(F.col("item"), "risks")).alias("risks"))


def prj20_partial_acceptance(spark, sf):
    good, bad = validation.split_valid(_items(spark, sf), _known(spark, sf))
    cols = ["doc", "pos", "decision_id"]
    return good.select(*cols, F.lit(None).cast("string").alias("error")).unionByName(bad.select(*cols, "error"))


def prj22_section_states(spark, sf):
    items = _items(spark, sf)
    docs = items.select("doc").distinct().select("doc", F.lit(True).alias("has_output"), F.lit(True).alias("root_ok"), F.lit(True).alias("hash_matches"))
    return validation.section_states(docs, items, _known(spark, sf))


def agg06_run_summary(spark, sf):
    return validation.run_summary(prj22_section_states(spark, sf))


def val01_violations(spark, sf):
    return validation.decision_errors(_items(spark, sf)).select("doc", "pos", "decision_id", "error")


def jon03_missing_evidence(spark, sf):
    refs = table(spark, sf, "documents").select(F.lit("d").alias("doc"), F.lit("message").alias("evidence_type"), F.col("doc_id").cast("string").alias("evidence_id"))
    known = table(spark, sf, "labels").select(F.lit("d").alias("doc"), F.lit("message").alias("evidence_type"), F.col("doc_id").cast("string").alias("evidence_id"))
    return validation.missing_evidence(refs, known)


def jon10_asof_section(spark, sf):
    e = table(spark, sf, "events")
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return sections.asof(errors, views, ["user_id"], "ts", "view_id").select("user_id", "error_id", "view_id")


def jon11_similar_pairs(spark, sf):
    p = _pairs(spark, sf)[2]
    return p.select("session_id", "left_decision_key", "right_decision_key", "title_similarity", "decision_similarity", "combined_similarity", "evidence_similarity", "candidate_score", "strong_cluster_candidate", F.array_join("candidate_reasons", ",").alias("reasons"))


#: Conversations of a session that is compared by index.
LARGE = 40


def jon11_large_sessions(spark, sf):
    """JON-11 by the index of rare trigrams: sessions of hundreds of decisions."""
    return _pairs(spark, sf, LARGE)[2].select("session_id", "left_decision_key", "right_decision_key", "title_similarity", "decision_similarity", "combined_similarity", "candidate_score", "strong_cluster_candidate")


#: Conversations of a session where caps on pairs and clusters are to bite.
TOGETHER = 4


def _capped(spark, sf):
    inv, feats, pairs = _pairs(spark, sf, TOGETHER)
    return inv, feats, stored(capped.capped_pairs(stored(pairs, "pairs")), "capped")


def srt04_capped_pairs(spark, sf):
    """SRT-03, SRT-04."""
    return _capped(spark, sf)[2].select("session_id", "left_decision_key", "right_decision_key", "candidate_score")


def _clusters(spark, sf):
    inv, feats, pairs = _capped(spark, sf)
    chosen = stored(capped.clustered(pairs), "members")
    marked = capped.mark_edges(pairs, chosen)
    return inv, feats, marked, clusters.clusters(feats, inv, marked, chosen)


def grf01_clusters(spark, sf):
    """GRF-01 to GRF-05, SRT-05, SRT-06, AGG-12, AGG-17."""
    made = _clusters(spark, sf)[3]
    joined = lambda c: F.array_join(c, ",").alias(c)
    return made.select("session_id", "cluster_id", F.array_join("member_decision_keys", ",").alias("members"), "candidate_relation", "review_priority", "candidate_pair_count", "selected_edge_count", joined("candidate_reasons"), joined("shared_terms"),
                       F.array_join(F.transform("shared_evidence_refs", lambda r: r["evidence_id"]), ",").alias("shared_evidence"), joined("section_ids"))


def agg07_evaluation(spark, sf):
    """AGG-07, SET-06."""
    inv, _, pairs, made = _clusters(spark, sf)
    e = clusters.evaluation(inv, pairs, made)
    sizes = F.array_join(F.transform(F.map_entries("cluster_size_distribution"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias("sizes")
    return e.select("session_id", "inventory_decision_count", "possible_cross_section_pair_count", "candidate_pair_count", "ai_review_decision_count", "candidate_cluster_count", "clustered_decision_count", "pair_only_review_decision_count", "singleton_count",
                    "selected_cluster_edge_count", "pair_comparison_reduction_rate", "ai_review_decision_reduction_rate", F.col("largest_cluster_size").cast("long").alias("largest_cluster_size"), sizes)


def grf04_priority(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m"))
    return n.select("o_custkey", clusters.priority(F.col("m") > 400000, F.col("n")).alias("priority"))


def jon14_context_window(spark, sf):
    m = _inventory(spark, sf).select("session_id", "section_id")
    return sections.window_sections(m, m).select("session_id", "section_id", "context_section_id")


def jon15_status_updates(spark, sf):
    e = table(spark, sf, "events").withColumn("seq", F.struct("ts", "event_id"))
    return assembly.last_write(e, ["user_id"], "event_type", "seq")


def jon15_lifecycle_status(spark, sf):
    return assembly.status_updates(_relations(spark, sf))


def agg11_assembled(spark, sf):
    made = assembly.assemble(_inventory(spark, sf), _relations(spark, sf))
    return made.select("session_id", "decision_id", "canonical_key", "title", "status", "confidence", F.array_join("alternatives", ",").alias("alternatives"), F.array_join("rationale", ",").alias("rationale"),
                       F.array_join("source_decision_keys", ",").alias("source_keys"), F.array_join("integration_relations", ",").alias("relations"), F.size("evidence_refs").cast("long").alias("n_refs"),
                       F.array_join(F.transform(F.map_entries("original_statuses"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("statuses"))


def agg09_assembly_summary(spark, sf):
    rels, inv = _relations(spark, sf), _inventory(spark, sf)
    return assembly.summary(inv, rels, assembly.assemble(inv, rels)).select("session_id", "decisions_before", "decisions_after", "same_decision_groups", "merged_source_decision_count")


def jon16_lifecycle_applied(spark, sf):
    made = assembly.assemble(_inventory(spark, sf), _relations(spark, sf))
    review = made.where("status = 'proposed'").select(
        "session_id", "decision_id", F.lit("cancelled").alias("final_status"), F.lit("LIFECYCLE-SEC-001").alias("group_id"), F.array(F.lit("r")).alias("rationale"), "evidence_refs", F.lit("low").alias("confidence"), F.array().cast("array<string>").alias("missing_information"))
    return lifecycle.summary(lifecycle.apply(made, review))


#: Rows of lineitem that a task of agg12 gets, about.
ROWS = 500_000


def agg12_shared_set(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), l.count() // ROWS + 1)
    lines = l.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").repartition(parts, "o_orderkey")
    bought = o.select("o_custkey", "o_orderkey").repartition(parts, "o_orderkey").join(lines, "o_orderkey").select("o_custkey", "o_orderkey", "l_partkey")
    size = bought.select("o_custkey", "o_orderkey").distinct().repartition(parts, "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("members"))
    return clusters.shared_by_all(bought, ["o_custkey"], "l_partkey", size, parts)


def agg13_latest_run(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("decision_id"), "l_partkey")
    decisions = lines.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("session_id")), "run_id")
    return logs.latest_decisions(runs, decisions).select("session_id", "run_id", "decision_id", "l_partkey")


def agg01_kind_counts(spark, sf):
    return normalize.kind_counts(table(spark, sf, "events").select("user_id", F.col("event_type").alias("kind")), "user_id")


def win01_neighbors(spark, sf):
    d = sections.neighbors(_messages(spark, sf).withColumn("section_id", F.lit("SEC-001")))
    return d.select("session_id", "evidence_id", F.col("previous.evidence_id").alias("previous_id"), F.col("next.evidence_id").alias("next_id"))


def win03_first_occurrence(spark, sf):
    return projection.first_occurrence(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), ["digest"], [F.col("doc_id").alias("_o")])


def _annotated(spark, sf):
    return signals.annotate(_messages(spark, sf), LATIN_RULES)


def sig03_phrase_hits(spark, sf):
    d = _messages(spark, sf).select("evidence_id", F.explode(signals.phrase_signals(F.col("content"), LATIN_RULES)).alias("s"))
    return d.select("evidence_id", "s.type", "s.trigger", "s.char_start", "s.char_end")


def win02_prev_context(spark, sf):
    d = _annotated(spark, sf)
    return d.select("evidence_id", F.col("previous.evidence_id").alias("previous_id"), F.col("previous.actor").alias("previous_actor"), F.array_join("previous.signal_types", ",").alias("previous_types"))


def agg04_signal_counts(spark, sf):
    return signals.counts(_annotated(spark, sf), ["session_id"])


def agg05_signal_rollup(spark, sf):
    per = signals.counts(_annotated(spark, sf), ["session_id", "actor"])
    return signals.roll_up(per, ["actor"])


def fn02_trigrams(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", normalized(F.col("text")).alias("t"))
    return d.select("doc_id", F.size(trigrams(F.col("t"))).cast("long").alias("n_trigrams"))


def fn05_tech_terms(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tech_terms(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_terms"))


def fn12_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", short_hash(F.col("text"), 12).alias("short"), F.sha2("text", 256).alias("full"))


def fn15_percent(spark, sf):
    d = table(spark, sf, "labels").agg(F.sum("quality").cast("double").alias("a"), F.count(F.lit(1)).alias("b"))
    return d.select(percent(F.col("a"), F.col("b")).alias("share"))


def set03_coverage(spark, sf):
    return validation.coverage(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


def jon17_registry_conflicts(spark, sf):
    return validation.registry_conflicts(table(spark, sf, "events").select("user_id", "event_type"), ["user_id"])


def snk14_markdown(spark, sf):
    return render.conversation(_events(spark, sf))


ALL: tuple[Callable, ...] = (
    prj02_classify, prj10_projection, prj12_strip_blocks, prj19_repair, prj20_partial_acceptance, prj22_section_states, val01_violations, jon03_missing_evidence,
    jon10_asof_section, jon11_similar_pairs, jon11_large_sessions, jon14_context_window, jon15_status_updates, jon15_lifecycle_status, jon16_lifecycle_applied, jon17_registry_conflicts, srt04_capped_pairs, grf01_clusters, grf04_priority,
    agg01_kind_counts, agg04_signal_counts, agg05_signal_rollup, agg06_run_summary, agg07_evaluation, agg09_assembly_summary, agg11_assembled, agg12_shared_set, agg13_latest_run,
    win01_neighbors, win02_prev_context, win03_first_occurrence, sig03_phrase_hits, fn02_trigrams, fn05_tech_terms, fn12_hashes, fn15_percent, set03_coverage, snk14_markdown,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*ALL, *shaped.QUERIES, *bundles.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: SQL[f.__name__] for f in ALL if f.__name__ in SQL} | shaped.SQL | bundles.SQL
