import itertools
import json
import random
import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom import errors, schemas
from recordloom.operators import assembly, capped, clusters, lifecycle, render, signals, similarity, validation


def decision(**change):
    d = {"decision_id": "D-001", "title": "t", "decision": "d", "context": None, "alternatives": [], "rationale": ["r"], "rejected_alternatives": [{"alternative": "a", "reason": "b"}], "risks": [], "revisit_conditions": [],
         "evidence_refs": [{"evidence_type": "message", "evidence_id": "M1"}], "confidence": "high", "missing_information": [], "status": "accepted"}
    d |= change
    return {k: v for k, v in d.items() if v != "gone"}


def items(spark, decisions):
    rows = [("doc", i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(decisions)]
    return spark.createDataFrame(rows, "doc string, pos int, j string").select("doc", "pos", F.parse_json("j").alias("item"))


BROKEN = [
    (decision(), None), (decision(extra=1), "missing or additional fields"), (decision(status="gone"), "missing or additional fields"), ("3", "missing or additional fields"), (decision(decision_id="2", risks="late"), "risks must contain strings"),
    (decision(decision_id="3", rationale=[1]), "rationale must contain strings"), (decision(decision_id="4", title=" 　"), "requires non-empty id, title, and decision"), (decision(), "duplicate decision id"),
    (decision(decision_id="5", context=4), "context must be string or null"), (decision(decision_id="6", confidence="sure"), "confidence is invalid"), (decision(decision_id="7", status="done"), "status is invalid"),
    (decision(decision_id="8", rejected_alternatives=[{"alternative": "x"}]), "rejected_alternatives is invalid"), (decision(decision_id="9", evidence_refs=[]), "has no evidence"),
    (decision(decision_id="10", evidence_refs=[{"evidence_type": "file", "evidence_id": "x"}]), "evidence_refs is invalid"), (decision(decision_id="11", evidence_refs=[{"evidence_type": "message", "evidence_id": ""}]), "evidence_refs is invalid"),
]


def test_first_broken_rule(spark):
    got = {r.pos: r.error for r in validation.decision_errors(items(spark, [d for d, _ in BROKEN])).collect()}
    assert [got[i] for i in range(len(BROKEN))] == [e for _, e in BROKEN]


def test_version_1(spark):
    one = {k: v for k, v in decision().items() if k != "evidence_refs"} | {"evidence_message_ids": ["M1"]}
    got = [r.error for r in validation.decision_errors(items(spark, [one, one | {"evidence_message_ids": [], "decision_id": "x"}, decision(decision_id="y")]), 1).orderBy("pos").collect()]
    assert got == [None, "has no evidence", "missing or additional fields"]


def test_repair_and_partial_acceptance(spark):
    known = spark.createDataFrame([("doc", "message", "M1")], "doc string, evidence_type string, evidence_id string")
    bad = decision(decision_id="D-2", evidence_refs=[{"evidence_type": "attachment", "evidence_id": "M1"}])
    d = items(spark, [decision(rationale='say "so"', risks="x"), bad, decision(decision_id="D-3", risks=7)])
    good, rejected = validation.split_valid(d, known)
    row = good.select("pos", "repaired_fields", F.to_json("item").alias("j")).first()
    assert row.pos == 0 and row.repaired_fields == ["rationale", "risks"] and json.loads(row.j) == decision(rationale=['say "so"'], risks=["x"])
    assert {r.pos: r.error for r in rejected.collect()} == {1: "unknown evidence: attachment:M1", 2: "risks must contain strings"}
    docs = spark.createDataFrame([("doc", True, True, True), ("none", False, False, False), ("bad", True, True, False)], "doc string, has_output boolean, root_ok boolean, hash_matches boolean")
    states = validation.section_states(docs, d, known)
    assert {r.doc: r.state for r in states.collect()} == {"doc": "partially_valid", "none": "missing", "bad": "invalid"}
    s = validation.run_summary(states).first()
    assert (s.sections, s.decisions, s.rejected, s.repairs, s.complete, s.all_hashes_match) == (3, 1, 2, 2, False, False)
    twice = validation.section_states(docs.limit(1), items(spark, [decision(), decision()]), known)
    assert twice.first().state == "invalid"


C = "CLUSTER-0123456789ab"
K1, K2 = "SEC-001:D-001", "SEC-002:D-001"


def judged(spark, rows, unclassified=()):
    ref = [("message", "M1")]
    full = [(C, i, r.get("id", f"J-{i + 1:03d}"), r["relation"], r["members"], r.get("direction"), r.get("rationale", ["why"]), r.get("refs", ref), r.get("confidence", "high"), []) for i, r in enumerate(rows)]
    j = spark.createDataFrame(full, schemas.JUDGMENTS)
    d = spark.createDataFrame([(C, K1), (C, K2)], "cluster_id string, source_decision_key string")
    e = spark.createDataFrame([(C, "message", "M1")], "cluster_id string, evidence_type string, evidence_id string")
    u = spark.createDataFrame([(C, k) for k in unclassified], "cluster_id string, source_decision_key string")
    return j, d, e, u


@pytest.mark.parametrize("row, words", [
    ({"relation": "same_decision", "members": [K1, K2]}, None), ({"relation": "lifecycle_relation", "members": [K1, K2], "direction": (K1, "changes", K2)}, None), ({"relation": "parent_child", "members": [K1, K2], "direction": (K1, "parent_of", K2)}, None),
    ({"relation": "lifecycle_relation", "members": [K1, K2], "direction": (K1, "parent_of", K2)}, "invalid direction relation"), ({"relation": "lifecycle_relation", "members": [K1, K2]}, "requires a direction"),
    ({"relation": "same_decision", "members": [K1, K2], "direction": (K1, "changes", K2)}, "direction must be null"), ({"relation": "same_decision", "members": [K1]}, "requires more Decision keys"),
    ({"relation": "same_decision", "members": [K1, K2], "id": "J-002"}, "sequential"), ({"relation": "same_decision", "members": [K1, K2, "SEC-009:D-001"]}, "unknown Decision key"),
    ({"relation": "same_decision", "members": [K1, K2], "refs": [("message", "M9")]}, "unknown Evidence"), ({"relation": "same_decision", "members": [K1, K2], "refs": [("message", "M1")] * 2}, "duplicate Evidence"),
    ({"relation": "alike", "members": [K1, K2]}, "invalid relation"), ({"relation": "uncertain", "members": [K1]}, "coverage is incomplete"), ({"relation": "same_decision", "members": [K1, K2], "rationale": []}, "rationale"),
])
def test_judgments(spark, row, words):
    v = validation.judgment_violations(*judged(spark, [row]))
    first = [r.message for r in validation.first_violation(v, "cluster_id").collect()]
    assert (first == []) if words is None else (words in first[0])
    if words:
        with pytest.raises(errors.AdjudicationFailure, match="INTEGRATION_ADJUDICATION_ERROR"):
            errors.raise_first(v, errors.AdjudicationFailure)


def test_judgment_overlap_and_statistics(spark):
    j, d, e, u = judged(spark, [{"relation": "uncertain", "members": [K1]}], [K2, K1])
    assert [r.message for r in validation.judgment_violations(j, d, e, u).collect()] == [f"both classified and unclassified: {K1}"]
    s = validation.judgment_statistics(j, d, u).first()
    assert (s.decision_count, s.classified_decision_count, s.unclassified_decision_count, s.judgment_count) == (2, 1, 2, 1)


def inventory(spark, rows):
    full = [("s", f"{sec}:{d}", sec, d, title, text, None, alts, [], [], [], [], status, conf, [], [tuple(r) for r in refs], "f", "h") for sec, d, title, text, alts, status, conf, refs in rows]
    return spark.createDataFrame(full, schemas.INVENTORY)


ROWS = [
    ("SEC-001", "D-001", "Use the Parquet store", "All tables are written as Parquet v1.2.0 files", ["csv"], "proposed", "high", [("message", "M1")]),
    ("SEC-002", "D-001", "Use the parquet store", "All tables are written as Parquet v1.2.0 files.", ["csv", "orc"], "accepted", "low", [("message", "M1"), ("attachment", "A1")]),
    ("SEC-003", "D-001", "Something quite different", "We eat soup on Mondays", [], "accepted", "medium", [("message", "M3")]),
    ("SEC-010", "D-002", "Replace the Parquet store", "All tables are written as ORC files instead of Parquet v1.2.0", [], "accepted", "medium", [("message", "M4")]),
]


def brute_pairs(rows):
    def plain(x):
        return "".join(c for c in x.lower() if c.isalnum())

    def grams(x):
        return {x[i : i + 3] for i in range(len(x) - 2)} or ({x} if x else set())

    def dice(a, b):
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    out = {}
    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0]:
            continue
        t, d, c = (dice(grams(plain(f(a))), grams(plain(f(b)))) for f in (lambda r: r[2], lambda r: r[3], lambda r: r[2] + r[3]))
        ea, eb = ({tuple(x) for x in r[7]} for r in (a, b))
        e = len(ea & eb) / len(ea | eb) if ea | eb else 0.0
        files = any(kind == "attachment" for kind, _ in ea & eb)
        n = abs(int(a[0][4:]) - int(b[0][4:]))
        s = round(0.36 * t + 0.34 * d + 0.12 * c + 0.12 * e + 0.03 * files + 0.03 * (1.0 if n == 1 else 0.5 if n == 2 else 0.0), 6)
        life = a[5] != b[5] or any(w in (a[2] + a[3] + b[2] + b[3]).lower() for w in similarity.LIFECYCLE_TERMS)
        if s >= 0.34 or t >= 0.62 or d >= 0.6 or c >= 0.48 or (e > 0 and c >= 0.18) or (files and c >= 0.12) or (life and c >= 0.28):
            out[f"{a[0]}:{a[1]}", f"{b[0]}:{b[1]}"] = s
    return out


def random_decisions(n=160, seed=3):
    """Texts over a few words, some of them variants of each other, empty ones, shared evidence and files; two or three a section."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        title, text = (" ".join(r.choice(words) for _ in range(k)) for k in (r.randint(1, 5), r.randint(1, 14)))
        if rows and r.random() < 0.3:
            other = r.choice(rows)
            title = r.choice([title, other[2], other[2] + " " + r.choice(words)])
            text = r.choice([text, " ".join(w for w in other[3].split() if r.random() < 0.6)])
        if r.random() < 0.06:
            title = ""
        if r.random() < 0.06:
            text = ""
        refs = [("message", f"M{r.randrange(60)}")] if r.random() < 0.5 else []
        refs += [("attachment", f"A{r.randrange(30)}")] if r.random() < 0.2 else []
        rows.append((f"SEC-{i // 3 + 1:03d}", f"D-{i % 3 + 1:03d}", title, text, [], r.choice(["accepted"] * 5 + ["proposed"]), "high", refs))
    return rows


def test_filter_join_loses_no_pair(spark):
    rows = random_decisions()
    feats = similarity.features(inventory(spark, rows))
    want = brute_pairs(rows)
    for block in (10, 1000):
        got = {(r.left_decision_key, r.right_decision_key): r.candidate_score for r in similarity.pairs(feats, block=block).collect()}
        assert set(got) == set(want) and got == pytest.approx(want)
    codes = similarity.coded(similarity.ranked(feats), frequent=20)
    compared, possible = similarity.candidates(codes).count(), sum(a[0] != b[0] for a, b in itertools.combinations(rows, 2))
    assert len(want) < compared < possible / 2, (len(want), compared, possible)


def walked(edges, most):
    """The walk, edge by edge."""
    of, used = {}, []
    for s, _, a, b in sorted(((not strong, -score, a, b), score, a, b) for a, b, score, strong in edges):
        x, y = of.setdefault(a, frozenset([a])), of.setdefault(b, frozenset([b]))
        if x != y and len(x) + len(y) <= most:
            used.append((a, b))
            for k in x | y:
                of[k] = x | y
    return set(of.values()), set(used)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """Of a chain of ever later edges only the first is first at both ends; the first edges are walked instead."""
    rounds, store = [], capped.stored
    monkeypatch.setattr(capped, "stored", lambda df, name: rounds.append(name) or store(df, name))
    g = [(i, i + 1, 1 - i / 1000, True) for i in range(200)]
    pairs = spark.createDataFrame([("s", *e) for e in g], "session_id string, left_ord int, right_ord int, candidate_score double, strong_cluster_candidate boolean")
    got = capped.clustered(pairs, 7, 60).collect()
    parts, used = walked(g, 7)
    mine = {}
    for x in got:
        if x.root is not None:
            mine.setdefault(x.root, set()).add(x.ord)
    assert {frozenset(m) for m in mine.values()} == parts and {(x.left_ord, x.right_ord) for x in got if x.root is None} == used
    assert rounds.count("agreed") <= 4


@pytest.mark.parametrize("few", [10**6, 20, 0])
def test_clusters_by_rounds_are_the_walk(spark, few):
    r = random.Random(9)
    graphs = {"random": [(*sorted(r.sample(range(40), 2)), r.randint(1, 9) / 10, r.random() < 0.3) for _ in range(150)], "chain": [(i, i + 1, 1 - i / 100, True) for i in range(14)],
              "ties": [(i, j, 0.5, False) for i in range(8) for j in range(i + 1, 8)], "one": [(1, 2, 0.5, True)]}
    graphs["random"] = list({(a, b): (a, b, s, t) for a, b, s, t in graphs["random"]}.values())
    rows = [(name, a, b, s, t) for name, g in graphs.items() for a, b, s, t in g]
    pairs = spark.createDataFrame(rows, "session_id string, left_ord int, right_ord int, candidate_score double, strong_cluster_candidate boolean")
    got = capped.clustered(pairs, 5, few).collect()
    for name, g in graphs.items():
        parts, used = walked(g, 5)
        mine = {}
        for x in got:
            if x.session_id == name and x.root is not None:
                mine.setdefault(x.root, set()).add(x.ord)
        assert {frozenset(m) for m in mine.values()} == parts and all(root in m for root, m in mine.items())
        assert {(x.left_ord, x.right_ord) for x in got if x.session_id == name and x.root is None} == used


def test_candidates_and_clusters(spark):
    inv = inventory(spark, ROWS)
    feats = similarity.features(inv)
    p = similarity.pairs(feats)
    assert {(r.left_decision_key, r.right_decision_key): r.candidate_score for r in p.collect()} == pytest.approx(brute_pairs(ROWS))
    small = {(r.left_decision_key, r.right_decision_key) for r in similarity.pairs(feats, block=1).collect()}
    assert small == set(brute_pairs(ROWS))
    chosen = capped.clustered(p)
    marked = capped.mark_edges(p, chosen)
    made = clusters.clusters(feats, inv, marked, chosen)
    c = made.first()
    assert c.member_decision_keys == ["SEC-001:D-001", "SEC-002:D-001", "SEC-010:D-002"] and re.fullmatch(r"CLUSTER-[0-9a-f]{12}", c.cluster_id)
    assert c.candidate_relation == "possible_lifecycle_relation" and c.review_priority == "high" and c.selected_edge_count == 2 and "parquet" in c.shared_terms
    assert [r.source_decision_key for r in clusters.singletons(inv, made).collect()] == ["SEC-003:D-001"]
    e = clusters.evaluation(inv, marked, made).first()
    assert (e.possible_cross_section_pair_count, e.candidate_cluster_count, e.largest_cluster_size, e.selected_cluster_edge_count) == (6, 1, 3, 2) and e.cluster_size_distribution == {"3": 1}
    ev = spark.createDataFrame([("s", "message", m, "text", "SEC-001", i) for i, m in enumerate(("M1", "M3", "M4"))] + [("s", "attachment", "A1", "file", None, None)], "session_id string, evidence_type string, evidence_id string, content string, section_id string, source_line int")
    near = "struct<evidence_id:string,actor:string,source_line:int,content:string>"
    around = spark.createDataFrame([("s", "M1", None, ("M2", "human", 2, "n"))], f"session_id string, evidence_id string, previous {near}, next {near}")
    r = clusters.review_inputs(made, inv, ev, around).first()
    assert len(r.decisions) == 3 and [x.evidence_id for x in r.evidence] == ["A1", "M1", "M4"] and [x.evidence_id for x in r.neighbor_messages] == ["M2"] and r.candidate_relation
    blind = clusters.review_inputs(made, inv, ev, around, blind=True)
    assert "candidate_relation" not in blind.columns and "section_id" not in blind.first().decisions[0].asDict()
    with pytest.raises(Exception, match="Evidence missing"):
        clusters.review_inputs(made, inv, ev.where("evidence_id <> 'M4'"), around).collect()


def edges(spark, rows):
    return spark.createDataFrame(rows, "session_id string, left_ord int, right_ord int, candidate_score double, strong_cluster_candidate boolean")


def graph(seed, nodes=14):
    r = random.Random(seed)
    return [("s", a, b, round(r.random(), 1), r.random() < 0.5) for a, b in itertools.combinations(range(nodes), 2) if r.random() < 0.6]


@pytest.mark.parametrize("seed", [1, 2])
def test_degree_cap(spark, seed):
    rows = graph(seed)
    degree, want = defaultdict(int), set()
    for _, a, b, s, _ in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if degree[a] < 3 and degree[b] < 3:
            degree[a] += 1
            degree[b] += 1
            want.add((a, b))
    for kernel in (10**6, 1):
        got = capped.capped_pairs(edges(spark, rows), 3, kernel_pairs=kernel)
        assert {(r.left_ord, r.right_ord) for r in got.collect()} == want


def test_cluster_cap(spark):
    rows = graph(3, 16)
    member, chosen = {i: {i} for i in range(16)}, set()
    for _, a, b, s, strong in sorted(rows, key=lambda x: (not x[4], -x[3], x[1], x[2])):
        if member[a] is not member[b] and len(member[a]) + len(member[b]) <= 5:
            joined = member[a] | member[b]
            for x in joined:
                member[x] = joined
            chosen.add((a, b))
    got = capped.clustered(edges(spark, rows), 5).collect()
    assert {(r.left_ord, r.right_ord) for r in got if r.left_ord is not None} == chosen
    groups = defaultdict(set)
    for r in got:
        if r.ord is not None:
            groups[r.root].add(r.ord)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, {frozenset(m) for m in member.values()}))


def test_assembly(spark):
    inv = inventory(spark, ROWS)
    j = spark.createDataFrame([(C, 0, "J-001", "same_decision", [K1, K2], None, ["w"], [("message", "M1")], "high", []), (C, 1, "J-002", "lifecycle_relation", ["SEC-010:D-002", K2], ("SEC-010:D-002", "changes", K2), ["w"], [("message", "M1")], "high", [])], schemas.JUDGMENTS).withColumn("session_id", F.lit("s"))
    left = spark.createDataFrame([("s", C, "SEC-003:D-001")], "session_id string, cluster_id string, source_decision_key string")
    rels = assembly.relations(j, left, inv)
    got = {r.decision_id: r for r in assembly.assemble(inv, rels).collect()}
    a = got["ID-001"]
    assert a.title == "Use the parquet store" and a.source_decision_keys == [K1, K2] and a.alternatives == ["csv", "orc"] and a.confidence == "low" and a.status == "superseded"
    assert a.original_statuses == {K1: "proposed", K2: "accepted"} and len(a.evidence_refs) == 2 and a.integration_relations == ["lifecycle_relation", "same_decision"]
    assert got["ID-002"].integration_relations == ["uncertain"] and got["ID-003"].status == "accepted" and len(got) == 3
    s = assembly.summary(inv, rels, assembly.assemble(inv, rels)).first()
    assert (s.decisions_before, s.decisions_after, s.merged_source_decision_count) == (4, 3, 2) and s.relation_distribution == {"lifecycle_relation": 1, "same_decision": 1, "uncertain": 1}
    assert assembly.overlapping_groups(rels).count() == 0
    other = j.where("pos = 0").withColumn("member_decision_keys", F.array(F.lit(K1), F.lit("SEC-003:D-001")))
    assert [r.source_decision_key for r in assembly.overlapping_groups(j.unionByName(other)).collect()] == [K1]


def test_lifecycle(spark):
    integrated = spark.createDataFrame([("s", "ID-001", "proposed", [K1]), ("s", "ID-002", "accepted", [K2]), ("s", "ID-003", "proposed", [K1, K2])], "session_id string, decision_id string, status string, source_decision_keys array<string>")
    review, bad = lifecycle.groups(integrated)
    assert [r.decision_ids for r in review.collect()] == [["ID-001"]] and bad.count() == 1
    m = spark.createDataFrame([("s", "SEC-001", "M1", "human", 0, "a"), ("s", "SEC-002", "M2", "human", 5, "b"), ("s", "SEC-004", "M4", "human", 9, "c")], "session_id string, section_id string, evidence_id string, actor string, source_line int, content string")
    at = spark.createDataFrame([("s", "A1", ["SEC-002", "SEC-001"], "file")], "session_id string, attachment_id string, section_ids array<string>, content string")
    c = lifecycle.context(review, m, at).first()
    assert c.context_sections == ["SEC-001", "SEC-002"] and [x.evidence_id for x in c.messages] == ["M1", "M2"] and [x.attachment_id for x in c.attachments] == ["A1"]
    res = spark.createDataFrame([("LIFECYCLE-SEC-001", 0, "ID-001", "accepted", ["w"], [("message", "M1")], "high", [])], schemas.LIFECYCLE_RESULTS)
    ev = spark.createDataFrame([("LIFECYCLE-SEC-001", "message", "M1")], "group_id string, evidence_type string, evidence_id string")
    groups = review.select("group_id", "decision_ids")
    assert validation.lifecycle_violations(res, groups, ev).count() == 0
    assert "unknown lifecycle Evidence" in validation.lifecycle_violations(res, groups, ev.limit(0)).first().message
    assert "order/coverage" in validation.lifecycle_violations(res.limit(0), groups, ev).first().message
    done = lifecycle.apply(integrated, res.withColumn("session_id", F.lit("s")))
    assert [(r.decision_id, r.status_before, r.status_after) for r in lifecycle.changes(done).collect()] == [("ID-001", "proposed", "accepted")]
    assert {r.status: (r.before, r.after) for r in lifecycle.summary(done).collect()} == {"proposed": (2, 1), "accepted": (1, 2)}


TEXT = "この機能を実装してください。その方針で。旧APIは廃止する。これは未定。AではなくBにする。速いので採用する。"


def test_phrase_signals(spark):
    d = spark.createDataFrame([("s", "M0", "assistant", 0, "なし"), ("s", "M1", "human", 1, TEXT), ("s", "M2", "context", 2, TEXT), ("s", "M3", "human", 3, " ")], "session_id string, evidence_id string, actor string, source_line int, content string")
    got = {r.evidence_id: r for r in signals.annotate(d).collect()}
    assert {s.type for s in got["M1"].signals} == set(schemas.SIGNAL_TYPES) and got["M2"].signals is None and got["M3"].signals is None
    want = sorted((m.start(), m.end(), kind, m[0]) for kind, _, p in signals.PHRASE_RULES for m in re.finditer(p, TEXT))
    raw = d.where("evidence_id = 'M1'").select(F.explode(signals.phrase_signals(F.col("content"))).alias("s")).select("s.*").collect()
    assert sorted((r.char_start, r.char_end, r.type, r.trigger) for r in raw) == want
    assert got["M1"].previous.evidence_id == "M0" and got["M1"].previous.signal_types == [] and got["M0"].previous is None
    c = signals.counts(signals.annotate(d), ["session_id"]).first()
    assert (c.messages_examined, c.messages_with_signals) == (2, 1) and c.request_candidate >= 1


def test_overlaps_join_the_first(spark):
    rows = [("a", 0, 5, "r1"), ("a", 4, 8, "r2"), ("a", 7, 9, "r3"), ("b", 4, 8, "r4")]
    s = [(t, ["phrase"], [r], "x", lo, hi, "why" if r == "r2" else None) for t, lo, hi, r in rows]
    got = spark.createDataFrame([(s,)], f"s array<{signals.SIGNAL}>").select(signals.deduplicate(F.col("s")).alias("k")).first().k
    assert [(k.type, k.char_start, k.char_end, k.rule_ids, k.reason) for k in got] == [("a", 0, 5, ["r1", "r2"], "why"), ("b", 4, 8, ["r4"], None), ("a", 7, 9, ["r3"], None)]


def test_rendering(spark):
    m = spark.createDataFrame([("s", "e2", None, "b", 2), ("s", "e1", "user", "a", 1)], "session_id string, id string, role string, content string, source_line int")
    assert render.conversation(m).first().markdown == "# Conversation\n\n### e1\n\n**User**\n\na\n\nSource JSONL line: 1\n\n---\n\n### e2\n\n**Unknown**\n\nb\n\nSource JSONL line: 2\n\n---\n"
    d = spark.createDataFrame([("s", "D-001", "T", "text", None, [], ["r"], [("a", "b")], [], [], ["M1"], "high", [], "accepted")], "session_id string, " + schemas.DECISIONS_V1)
    out = render.decisions(d).first().markdown
    assert "## D-001 T" in out and "記録なし" in out and "- [M1](conversation.md#M1)" in out and "- a\n  - b" in out and "### 比較案\n\n- なし\n" in out


def test_coverage_and_conflicts(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.side) for r in validation.coverage(a, b, ["k"]).collect()} == {(1, "missing"), (3, "extra")}
    r = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("y", 2)], "k string, v int")
    assert [x.k for x in validation.registry_conflicts(r, ["k"]).collect()] == ["y"]


def test_pairs_are_counted_in_blocks(spark, capsys):
    """No join of rows, whose texts would be compared pair by pair; a unit of work holds two blocks at most, and counts as sets do."""
    feats = similarity.features(inventory(spark, random_decisions(60)))
    similarity.pairs(feats).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Join" not in plan and "array_intersect" not in plan
    left, right = ([similarity.grams(x) for x in texts] for texts in (["", "a", "ab", "abc", "abcabcd", "bcabca"], ["abcd", "a", "", "aab"]))
    assert similarity.common(left, right).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]
    own = similarity.common(left, left)  # a decision isn't paired with itself
    assert all(own[i, j] == len(set(left[i].tolist()) & set(left[j].tolist())) for i, j in itertools.permutations(range(len(left)), 2))
    batches = spark.range(10).selectExpr("id div 4 AS k", "id").toArrow().to_batches(max_chunksize=3)
    assert [u["id"].to_pylist() for u in similarity.units(iter(batches), ["k"])] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


@pytest.mark.parametrize("few", [1, 10])
def test_degree_cap_by_prefixes(spark, monkeypatch, few):
    """Of ever lower edges at one node only the first is first at both ends; a prefix of the walk settles what its full ends had left, too."""
    names, store = [], capped.stored
    monkeypatch.setattr(capped, "stored", lambda df, name: names.append(name) or store(df, name))
    rows = [("s", 0, i, 1 - i / 100, True) for i in range(1, 40)] + [("s", i, i + 1, i / 100, True) for i in range(1, 7)] + [("t", 3, 4, 0.5, True)]
    got = capped._rounds(edges(spark, rows).drop("strong_cluster_candidate"), 2, few)
    assert {(r.session_id, r.left_ord, r.right_ord) for r in got.collect()} == {("s", 0, 1), ("s", 0, 2), ("s", 6, 7), ("s", 5, 6), ("s", 4, 5), ("s", 3, 4), ("s", 2, 3), ("t", 3, 4)}
    assert names.count("walked") == (7 if few == 1 else 2)


def test_small_sessions_are_compared_together(spark):
    """Sessions of a few decisions are numbered, counted and judged as many at once as a block holds, each by itself."""
    odd = [("", ""), ("a", "a"), ("ab", "ab"), ("日本", "日本"), ("日本語の変更", "日本語の 変更"), ("😀ab c", "abc"), ("appro", "ve"), ("x", "ve and appro")]
    sessions = {f"s{k}": random_decisions(3 + k, seed=k) for k in range(12)} | {"odd": [(f"SEC-{i + 1:03d}", "D-001", t, d, [], "accepted", "high", []) for i, (t, d) in enumerate(odd)]}
    inv = reduce(DataFrame.unionByName, [inventory(spark, rows).withColumn("session_id", F.lit(s)) for s, rows in sessions.items()])
    want = {(s, *k): v for s, rows in sessions.items() for k, v in brute_pairs(rows).items()}
    codes = similarity.coded(similarity.ranked(similarity.features(inv)))
    for block in (4, 50, 1024):
        got = similarity._scored(similarity.candidates(codes, block)).collect()
        assert {(r.session_id, r.left_decision_key, r.right_decision_key): r.candidate_score for r in got} == pytest.approx(want)
    rows = codes.orderBy("session_id", "ord").toArrow()
    together = list(similarity.gathered(similarity.units(iter(rows.to_batches()), ["session_id"]), 50))
    assert [len(starts) for _, starts in together] == [6, 5, 2] and sum(t.num_rows for t, _ in together) == rows.num_rows
    assert [list(x) for x in similarity.gathered(iter([rows]), 5)] == [[rows, [0]]]


def test_codes_too_wide_for_a_key():
    """Numbers that don't fit into one word beside unit and set are numbered anew."""
    row, code = np.array([0, 0, 1, 1, 2, 3, 3]), np.array([1 << 61, 5, 5, 1 << 61, 7, 7, 7])
    sizes, products = similarity.shared(row, code, np.array([[0, 0, 2], [2, 3, 4]]))
    a, b = products
    assert sizes.tolist() == [2, 2, 1, 1] and a[0, 1] == 2 and b.tolist() == [[1]]


def many(sessions=40):
    """Sessions with a graph each."""
    return {f"s{k}": [e[1:] for e in graph(k, 4 + k % 9)] for k in range(sessions)}


def test_cap_walk_streams(spark, capsys):
    """The degree cap takes sorted edges as they come; no session is a frame of its own, and rows pass by without a join."""
    graphs = many()
    got = capped.capped_pairs(edges(spark, [(s, *e) for s, g in graphs.items() for e in g]), 2)
    got.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan and "Join" not in plan
    want = set()
    for s, g in graphs.items():
        degree = defaultdict(int)
        for a, b, _, _ in sorted(g, key=lambda x: (-x[2], x[0], x[1])):
            if degree[a] < 2 and degree[b] < 2:
                degree[a] += 1
                degree[b] += 1
                want.add((s, a, b))
    assert {(r.session_id, r.left_ord, r.right_ord) for r in got.collect()} == want


def test_join_walk_streams(spark, capsys):
    """So do the clusters' walks."""
    graphs = many()
    got = capped.clustered(edges(spark, [(s, *e) for s, g in graphs.items() for e in g]), 4)
    got.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    rows = got.collect()
    for s, g in graphs.items():
        parts, mine = defaultdict(set), [r for r in rows if r.session_id == s]
        for r in mine:
            if r.root is not None:
                parts[r.root].add(r.ord)
        assert ({frozenset(x) for x in parts.values()}, {(r.left_ord, r.right_ord) for r in mine if r.root is None}) == walked(g, 4)


@pytest.mark.parametrize(("block", "least", "listed"), [(1024, 64, 10**6), (7, 9, 1), (16, 10, 1)])
def test_capped_without_all_pairs(spark, monkeypatch, block, least, listed):
    """Lists of each decision's first pairs give what the walk over all candidate pairs gives, copies and ties too, and at most so many are written."""
    rows = random_decisions(90)
    rows += [(f"SEC-{i + 200:03d}", "D-001", rows[0][2], rows[0][3], [], "accepted", "high", []) for i in range(30)]
    rows += [(f"SEC-{i + 300:03d}", "D-001", "user", " ".join(rows[i][3].split()[:5]), [], "accepted", "high", []) for i in range(40)]
    both = inventory(spark, rows)
    both = both.unionByName(inventory(spark, random_decisions(20, seed=5)).withColumn("session_id", F.lit("small")))
    feats = similarity.features(both)
    pairs = similarity.pairs(feats)
    want = {tuple(r.asDict(recursive=True).items()) for r in capped.capped_pairs(pairs, 3).withColumn("candidate_reasons", F.array_join("candidate_reasons", ",")).collect()}
    sizes, store = [], capped.stored
    monkeypatch.setattr(similarity, "LISTED", listed)
    monkeypatch.setattr(capped, "stored", lambda df, name: sizes.append((name, store(df, name))) or sizes[-1][1])
    monkeypatch.setattr(similarity.nearest, "__defaults__", (block, least))
    monkeypatch.setattr(capped._by_lists, "__defaults__", (block, least))
    got = capped.best_pairs(feats, 3, large=50).withColumn("candidate_reasons", F.array_join("candidate_reasons", ","))
    assert {tuple(r.asDict(recursive=True).items()) for r in got.collect()} == want
    lists = [d for name, d in sizes if name == "nearest"]
    assert len(lists) == 1 if listed > 1 else len(lists) > 1
    assert all(r.n <= max(least, listed // r.all) for d in lists for r in d.select(F.size("keys").alias("n"), F.lit(len(rows)).alias("all")).collect())
    assert all(d.where("session_id <> 'small'").count() == 0 for name, d in sizes if name == "similar")


def test_scores_round_as_spark(spark):
    values = [0.1234565, 0.1234575, 0.5, 0.34 - 5e-7, 1 / 3, 0.0000005, 0.8499995, 0.9999995, 1.0] + [k / 10**7 for k in range(5, 10**7, 99_991)]
    want = [round(r.x * 10**6) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6).alias("x")).collect()]
    assert similarity.millionths(np.array(values)).tolist() == want
