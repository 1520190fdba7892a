"""Validators: every broken rule of every row at once; the first, in the rules' order, on demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.shape import at, first_code, is_kind, items, keys_are, non_blank, text_at
from ..functions.text import matches
from ..schemas import CONFIDENCES, DECISION_STATUSES, EVIDENCE_TYPES, LIFECYCLE_DIRECTIONS, LIFECYCLE_STATUSES, RELATIONS, REPAIRABLE, V1_FIELDS, V3_FIELDS


def _strings(v: Column, name: str) -> Column:
    x = items(at(v, name))
    return F.coalesce(F.forall(x, lambda e: is_kind(e, "STRING")), F.lit(False))


def _text_or_null(v: Column, name: str) -> Column:
    return is_kind(at(v, name), "STRING", "VOID")


def _alternatives(v: Column) -> Column:
    x = items(at(v, "rejected_alternatives"))
    one = lambda e: is_kind(e, "OBJECT") & keys_are(F.to_json(e), ("alternative", "reason")) & text_at(e, "alternative").isNotNull() & text_at(e, "reason").isNotNull()
    return F.coalesce(F.forall(x, one), F.lit(False))


def _refs(v: Column) -> Column:
    x = items(at(v, "evidence_refs"))
    one = lambda e: is_kind(e, "OBJECT") & keys_are(F.to_json(e), ("evidence_type", "evidence_id")) & F.coalesce(text_at(e, "evidence_type").isin(*EVIDENCE_TYPES), F.lit(False)) & F.coalesce(text_at(e, "evidence_id") != "", F.lit(False))
    return F.coalesce(F.forall(x, one), F.lit(False))


def decision_rules(v: Column, version: int) -> list[tuple[str, Column]]:
    """(message, good) in order, for a decision as VARIANT; version 1 cites message ids, version 3 typed references."""
    lists = ("alternatives", "rationale", "risks", "revisit_conditions", "missing_information") + (("evidence_message_ids",) if version == 1 else ())
    fields, evidence = (V1_FIELDS, "evidence_message_ids") if version == 1 else (V3_FIELDS, "evidence_refs")
    enum = lambda name, values: F.coalesce(text_at(v, name).isin(*values), F.lit(False))
    rules = [("missing or additional fields", is_kind(v, "OBJECT") & keys_are(F.to_json(v), fields))]
    rules += [(f"{name} must contain strings", _strings(v, name)) for name in lists]
    rules += [("requires non-empty id, title, and decision", non_blank(text_at(v, "decision_id")) & non_blank(text_at(v, "title")) & non_blank(text_at(v, "decision"))),
              ("context must be string or null", _text_or_null(v, "context")),
              ("confidence is invalid", enum("confidence", CONFIDENCES)), ("status is invalid", enum("status", DECISION_STATUSES)),
              ("rejected_alternatives is invalid", _alternatives(v)), ("has no evidence", F.coalesce(F.size(items(at(v, evidence))) > 0, F.lit(False)))]
    return rules + ([("evidence_refs is invalid", _refs(v))] if version == 3 else [])


def decision_errors(decisions: DataFrame, version: int = 3) -> DataFrame:
    """decisions: doc, pos, item (VARIANT). Adds error: the first broken rule, or a repeat of an id within doc; null if good."""
    v = F.col("item")
    d = decisions.withColumn("decision_id", text_at(v, "decision_id"))
    nth = F.row_number().over(W.partitionBy("doc", "decision_id").orderBy("pos"))
    d = d.withColumn("_nth", F.when(F.col("decision_id").isNotNull(), nth).otherwise(1))
    rules = decision_rules(v, version)
    return d.withColumn("error", first_code(*rules[:1 + 5 + (version == 1) + 1], ("duplicate decision id", F.col("_nth") == 1), *rules[1 + 5 + (version == 1) + 1:])).drop("_nth")


def repair(v: Column) -> tuple[Column, Column]:
    """(JSON of a decision whose list fields that were single strings are one-element lists, names of those fields)."""
    wraps = [(n, is_kind(at(v, n), "STRING")) for n in REPAIRABLE]
    names = F.array_compact(F.array(*(F.when(cond, F.lit(n)) for n, cond in wraps)))
    object_ = F.try_variant_get(v, "$", "map<string,variant>")
    fixed = F.transform_values(object_, lambda k, x: F.when(F.array_contains(names, k), F.to_json(F.array(x.cast("string")))).otherwise(F.to_json(x)))
    parts = F.transform(F.map_entries(fixed), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit("\x01"), e["value"]))
    pairs = F.transform(parts, lambda p: F.concat(F.substring(p, F.lit(2), F.instr(p, "\x01") - 3), F.lit(":"), F.substring(p, F.instr(p, "\x01") + 1, F.length(p))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), names


def repaired(decisions: DataFrame) -> DataFrame:
    """Adds repaired_fields and replaces item by its repaired form; what is no object stays as it is."""
    fixed, names = repair(F.col("item"))
    d = decisions.withColumn("repaired_fields", F.when(is_kind(F.col("item"), "OBJECT"), names).otherwise(F.array().cast("array<string>")))
    return d.withColumn("item", F.when(F.size("repaired_fields") > 0, F.parse_json(fixed)).otherwise(F.col("item")))


def references(decisions: DataFrame, version: int = 3) -> DataFrame:
    """doc, pos, decision_id, evidence_type, evidence_id of each cited piece."""
    if version == 1:
        each = decisions.select("doc", "pos", text_at(F.col("item"), "decision_id").alias("decision_id"), F.explode(items(at(F.col("item"), "evidence_message_ids"))).alias("e"))
        return each.select("doc", "pos", "decision_id", F.lit("message").alias("evidence_type"), F.col("e").cast("string").alias("evidence_id"))
    each = decisions.select("doc", "pos", text_at(F.col("item"), "decision_id").alias("decision_id"), F.explode(items(at(F.col("item"), "evidence_refs"))).alias("e"))
    return each.select("doc", "pos", "decision_id", text_at(F.col("e"), "evidence_type").alias("evidence_type"), text_at(F.col("e"), "evidence_id").alias("evidence_id"))


def known_evidence(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """doc, evidence_type, evidence_id of all that may be cited."""
    m = messages.select("doc", F.lit("message").alias("evidence_type"), "evidence_id")
    return m.union(attachments.select("doc", F.lit("attachment").alias("evidence_type"), F.col("attachment_id").alias("evidence_id"))).distinct()


def missing_evidence(refs: DataFrame, known: DataFrame) -> DataFrame:
    return refs.join(known, ["doc", "evidence_type", "evidence_id"], "left_anti").select("doc", "evidence_type", "evidence_id").distinct()


def split_valid(decisions: DataFrame, known: DataFrame, version: int = 3) -> tuple[DataFrame, DataFrame]:
    """Partial acceptance: (good decisions, rejected ones with their error), each decision judged by itself."""
    repaired_ = repaired(decisions)
    gone = missing_evidence(references(repaired_, version), known)
    bad = references(repaired_, version).join(gone, ["doc", "evidence_type", "evidence_id"]).groupBy("doc", "pos").agg(F.array_sort(F.collect_set(F.concat_ws(":", "evidence_type", "evidence_id"))).alias("_gone"))
    d = decision_errors(repaired_, version).join(bad, ["doc", "pos"], "left")
    d = d.withColumn("error", F.coalesce("error", F.concat(F.lit("unknown evidence: "), F.array_join("_gone", ", ")))).drop("_gone")
    return d.where("error is null").drop("error"), d.where("error is not null")


def section_states(sections: DataFrame, decisions: DataFrame, known: DataFrame) -> DataFrame:
    """Per doc of sections: state (missing, invalid, partially_valid, valid), decisions kept and rejected, repairs.

    sections: doc, has_output, root_ok, hash_matches. Repeated ids make the whole section invalid.
    """
    good, bad = split_valid(decisions, known)
    n = lambda d, name: d.groupBy("doc").agg(F.count(F.lit(1)).alias(name))
    twice = bad.where("error = 'duplicate decision id'").select("doc").distinct().withColumn("_twice", F.lit(True))
    fixed = good.groupBy("doc").agg(F.sum(F.size("repaired_fields")).alias("repairs"))
    d = sections.join(n(good, "kept"), "doc", "left").join(n(bad, "rejected"), "doc", "left").join(fixed, "doc", "left").join(twice, "doc", "left").na.fill(0, ["kept", "rejected", "repairs"])
    state = (F.when(~F.col("has_output"), "missing").when(~F.col("root_ok") | ~F.col("hash_matches") | F.coalesce("_twice", F.lit(False)), "invalid")
             .when((F.col("rejected") > 0) & (F.col("kept") == 0), "invalid").when(F.col("rejected") > 0, "partially_valid").otherwise("valid"))
    return d.withColumn("state", state).drop("_twice")


def run_summary(states: DataFrame) -> DataFrame:
    """One row: sections per state, decisions, repairs, whether all hashes match and the run is complete."""
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.agg(F.count(F.lit(1)).alias("sections"), *map(of, ("valid", "partially_valid", "invalid", "missing")), F.coalesce(F.sum("kept"), F.lit(0)).alias("decisions"),
                      F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"), F.coalesce(F.sum("repairs"), F.lit(0)).alias("repairs"), F.bool_and("hash_matches").alias("all_hashes_match"),
                      F.bool_and(F.col("state").isin("valid", "partially_valid")).alias("complete"))


def relation_shape(relation: Column, members: Column, direction: Column) -> Column:
    """The shape error of a judgment, or null."""
    paired, n = relation.isin("lifecycle_relation", "parent_child"), F.size(members)
    ends = F.array_contains(members, direction["from_decision_key"]) & F.array_contains(members, direction["to_decision_key"]) & (direction["from_decision_key"] != direction["to_decision_key"])
    allowed = F.when(relation == "parent_child", direction["relation"] == "parent_of").otherwise(direction["relation"].isin(*LIFECYCLE_DIRECTIONS))
    least = F.when(relation.isin("same_decision", "distinct"), 2).otherwise(1)
    return F.when(paired & (n != 2), "requires exactly two Decision keys").when(paired & direction.isNull(), "requires a direction object").when(
        paired & ~F.coalesce(ends, F.lit(False)), "direction endpoints must be distinct members").when(paired & ~F.coalesce(allowed, F.lit(False)), "has an invalid direction relation").when(
        ~paired & direction.isNotNull(), "direction must be null").when(~paired & (n < least), "requires more Decision keys")


def judgment_violations(judgments: DataFrame, decisions: DataFrame, evidence: DataFrame, unclassified: DataFrame) -> DataFrame:
    """cluster_id, ord, message of all broken rules. decisions: cluster_id, source_decision_key; evidence: cluster_id,
    evidence_type, evidence_id; unclassified: cluster_id, source_decision_key; judgments as in schemas.JUDGMENTS."""
    j = judgments
    text = first_code(
        ("judgment IDs must be sequential", F.col("judgment_id") == F.format_string("J-%03d", F.col("pos") + 1)), ("invalid relation", F.col("relation").isin(*RELATIONS)),
        ("member keys must be unique and non-empty", (F.size("member_decision_keys") > 0) & (F.size(F.array_distinct("member_decision_keys")) == F.size("member_decision_keys"))),
        ("rationale must be non-empty", (F.size("rationale") > 0) & F.forall("rationale", lambda x: F.coalesce(x != "", F.lit(False)))),
        ("missing_information must be an array of strings", F.forall("missing_information", lambda x: x.isNotNull())), ("invalid confidence", F.col("confidence").isin(*CONFIDENCES)),
        ("evidence_refs must be non-empty", F.size("evidence_refs") > 0), ("invalid Evidence type", F.forall("evidence_refs", lambda r: r["evidence_type"].isin(*EVIDENCE_TYPES))),
        ("duplicate Evidence reference", F.size(F.array_distinct("evidence_refs")) == F.size("evidence_refs")))
    shape = relation_shape(F.col("relation"), F.col("member_decision_keys"), F.col("direction"))
    own = j.select("cluster_id", F.col("pos").alias("ord"), F.concat_ws(" ", "judgment_id", F.coalesce(text, shape)).alias("message"), F.coalesce(text, shape).alias("_t")).where("_t is not null").drop("_t")
    members = j.select("cluster_id", "pos", "judgment_id", F.explode("member_decision_keys").alias("source_decision_key"))
    unknown = members.join(decisions, ["cluster_id", "source_decision_key"], "left_anti").select("cluster_id", F.col("pos").alias("ord"), F.concat(F.lit("unknown Decision key "), "source_decision_key").alias("message"))
    refs = j.select("cluster_id", "pos", F.explode("evidence_refs").alias("r")).select("cluster_id", "pos", "r.evidence_type", "r.evidence_id")
    stray = refs.join(evidence, ["cluster_id", "evidence_type", "evidence_id"], "left_anti").select("cluster_id", F.col("pos").alias("ord"), F.concat(F.lit("unknown Evidence reference "), "evidence_type", F.lit(":"), "evidence_id").alias("message"))
    late = lambda d, text: d.select("cluster_id", F.lit(1 << 30).alias("ord"), F.concat(F.lit(text), "source_decision_key").alias("message"))
    classified = members.select("cluster_id", "source_decision_key").distinct()
    extra = unclassified.join(decisions, ["cluster_id", "source_decision_key"], "left_anti")
    both = classified.join(unclassified, ["cluster_id", "source_decision_key"], "left_semi")
    gaps = decisions.select("cluster_id", "source_decision_key").distinct().join(classified.union(unclassified.select("cluster_id", "source_decision_key")), ["cluster_id", "source_decision_key"], "left_anti")
    form = decisions.where(~matches(r"SEC-[0-9]{3}:D-[0-9]{3}", F.col("source_decision_key"))).select("cluster_id", F.lit(-1).alias("ord"), F.concat(F.lit("input Decision key has an invalid format: "), F.col("source_decision_key")).alias("message"))
    named = decisions.select("cluster_id").distinct().where(~matches(r"CLUSTER-[0-9a-f]{12}", F.col("cluster_id"))).select("cluster_id", F.lit(-2).alias("ord"), F.lit("input cluster_id has an invalid format").alias("message"))
    return (own.unionByName(unknown).unionByName(stray).unionByName(late(extra, "unknown unclassified Decision key ")).unionByName(late(both, "both classified and unclassified: "))
            .unionByName(late(gaps, "coverage is incomplete: ")).unionByName(form).unionByName(named))


def judgment_statistics(judgments: DataFrame, decisions: DataFrame, unclassified: DataFrame) -> DataFrame:
    """Per cluster: decisions, classified, unclassified, judgments, cited evidence."""
    j = judgments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("judgment_count"), F.sum(F.size("evidence_refs")).alias("evidence_reference_count"),
                                            F.size(F.array_distinct(F.flatten(F.collect_list("member_decision_keys")))).alias("classified_decision_count"))
    d = decisions.groupBy("cluster_id").agg(F.countDistinct("source_decision_key").alias("decision_count"))
    u = unclassified.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("unclassified_decision_count"))
    return d.join(j, "cluster_id", "left").join(u, "cluster_id", "left").na.fill(0)


def lifecycle_violations(results: DataFrame, groups: DataFrame, evidence: DataFrame) -> DataFrame:
    """group_id, ord, message. groups: group_id, decision_ids (in order); evidence: group_id, evidence_type, evidence_id."""
    text = first_code(
        ("invalid lifecycle status", F.col("final_status").isin(*LIFECYCLE_STATUSES)), ("rationale must be non-empty", (F.size("rationale") > 0) & F.forall("rationale", lambda x: F.coalesce(x != "", F.lit(False)))),
        ("missing_information must be an array of strings", F.forall("missing_information", lambda x: x.isNotNull())), ("invalid lifecycle confidence", F.col("confidence").isin(*CONFIDENCES)),
        ("Evidence is required", F.size("evidence_refs") > 0), ("duplicate lifecycle Evidence", F.size(F.array_distinct("evidence_refs")) == F.size("evidence_refs")))
    d = results.join(groups, "group_id", "left")
    own = d.select("group_id", F.col("pos").alias("ord"), F.when(~F.coalesce(F.array_contains("decision_ids", F.col("decision_id")), F.lit(False)), "unknown lifecycle Decision ID").otherwise(text).alias("message")).where("message is not null")
    refs = results.select("group_id", "pos", F.explode("evidence_refs").alias("r")).select("group_id", "pos", "r.evidence_type", "r.evidence_id")
    stray = refs.join(evidence, ["group_id", "evidence_type", "evidence_id"], "left_anti").select("group_id", F.col("pos").alias("ord"), F.concat(F.lit("unknown lifecycle Evidence: "), "evidence_type", F.lit(":"), "evidence_id").alias("message"))
    got = results.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "decision_id"))), lambda x: x["decision_id"]).alias("_ids"))
    order = groups.join(got, "group_id", "left").where(~F.col("decision_ids").eqNullSafe(F.col("_ids"))).select("group_id", F.lit(1 << 30).alias("ord"), F.lit("lifecycle result order/coverage mismatch").alias("message"))
    return own.unionByName(stray).unionByName(order)


def coverage(wanted: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions at once: keys with side 'missing' or 'extra'."""
    a, b = wanted.select(*keys).distinct(), got.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))


def registry_conflicts(records: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose records aren't all identical."""
    rest = [c for c in records.columns if c not in key]
    marked = records.withColumn("_h", F.sha2(F.to_json(F.struct(*rest)), 256))
    return marked.groupBy(*key).agg(F.min("_h").alias("a"), F.max("_h").alias("b")).where("a <> b").select(*key)


def analysis_violations(docs: DataFrame, messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Of a projection that decisions are checked against: another version than 3, and evidence without an id.

    docs: session_id, projection_version; messages: evidence_id; attachments: attachment_id.
    """
    v = docs.where(~F.col("projection_version").eqNullSafe("3")).select(F.lit(0).alias("ord"), F.concat(F.lit("Projection v3 is required: "), "session_id").alias("message"))
    none = messages.where("evidence_id is null").select(F.lit("message").alias("k")).union(attachments.where("attachment_id is null").select(F.lit("attachment").alias("k"))).distinct()
    return v.unionByName(none.select(F.lit(1).alias("ord"), F.concat(F.lit("Evidence without an id: "), "k").alias("message")))


def scope_violations(docs: DataFrame) -> DataFrame:
    """Of section documents (section_id, section_scope): another section than they say, or one that isn't marked as no gold."""
    other = docs.where(~F.col("section_scope.section_id").eqNullSafe(F.col("section_id"))).select(F.lit(0).alias("ord"), F.concat(F.lit("Section scope mismatch: "), "section_id").alias("message"))
    gold = docs.where(~F.col("section_scope.section_gold").eqNullSafe(False)).select(F.lit(1).alias("ord"), F.concat(F.lit("candidate Section must not be marked Gold: "), "section_id").alias("message"))
    return other.unionByName(gold)


def session_violations(docs: DataFrame) -> DataFrame:
    """Documents must be of one session, and name it."""
    n = docs.agg(F.countDistinct("session_id").alias("n"), F.count_if(F.coalesce("session_id", F.lit("")) == "").alias("none"))
    return n.where("n <> 1 or none > 0").select(F.lit(2).alias("ord"), F.format_string("expected one session id, found %d, missing in %d", "n", "none").alias("message"))


def id_violations(integrated: DataFrame) -> DataFrame:
    """Of integrated decisions: ids that are missing or stand twice in a session."""
    n = integrated.groupBy("session_id", "decision_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or decision_id is null")
    return n.select(F.lit(0).alias("ord"), F.concat_ws(" ", F.lit("integrated ids must be unique:"), "session_id", "decision_id").alias("message"))


def first_violation(violations: DataFrame, by: str) -> DataFrame:
    """Per group, the message that a checker going in order would stop at."""
    return violations.groupBy(by).agg(F.min_by("message", F.struct("ord", "message")).alias("message"))
