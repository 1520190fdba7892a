"""From a log to lifecycle-resolved decisions, by files."""

import hashlib
import json

import pytest

from recordloom import errors
from recordloom.plans import verbs
from test_decisions import decision

LINES = [
    {"type": "session_meta", "payload": {}},
    {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "Parquetで保存してください"}},
    {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": "採用します。速いので。"}},
    {"type": "event_msg", "payload": {"type": "patch_apply_end", "message": "p"}},
    {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "ORCに変更する"}},
]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("run")
    (p / "log.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in LINES) + "\n", encoding="utf-8")
    return p, hashlib.sha256((p / "log.jsonl").read_bytes()).hexdigest()[:16]


def test_ingest_import_render(spark, run):
    p, session = run
    store = f"{p}/store"
    assert verbs.ingest(spark, f"{p}/log.jsonl", store)[0]["recognized"] == 5
    assert verbs.ingest(spark, f"{p}/log.jsonl", store) == [{"status": "already_ingested"}]
    assert verbs.export_analysis(spark, store, session, f"{p}/v1", "prompt", "{}")["messages"] == 3
    one = {k: v for k, v in decision().items() if k != "evidence_refs"} | {"evidence_message_ids": [f"{session}-msg-000002"]}
    (p / "d1.json").write_text(json.dumps({"decisions": [one]}))
    assert verbs.import_analysis(spark, store, session, f"{p}/d1.json") == {"run_id": 1, "decisions": 1}
    assert verbs.import_analysis(spark, store, session, f"{p}/d1.json")["run_id"] == 2
    verbs.render_session(spark, store, session, f"{p}/md")
    assert (p / "md/decisions.md").read_text(encoding="utf-8").count("## D-001") == 1 and "採用します" in (p / "md/conversation.md").read_text(encoding="utf-8")
    (p / "d2.json").write_text(json.dumps({"decisions": [one | {"evidence_message_ids": ["none"]}]}))
    with pytest.raises(errors.EvidenceNotFound, match="DECISION_EVIDENCE_NOT_FOUND"):
        verbs.import_analysis(spark, store, session, f"{p}/d2.json")
    with pytest.raises(errors.SessionNotFound):
        verbs.render_session(spark, store, "none", f"{p}/md")


def test_sections_to_lifecycle(spark, run):
    p, session = run
    store = f"{p}/store"
    messages = [{"raw_line": 2, "message_id": "M1", "actor": "human", "section_id": "SEC-001"}, {"raw_line": 3, "message_id": "M2", "actor": "assistant", "section_id": "SEC-001"}, {"raw_line": 5, "message_id": "M3", "actor": "human", "section_id": "SEC-002"}]
    (p / "m.jsonl").write_text("\n".join(map(json.dumps, messages)))
    (p / "a.jsonl").write_text(json.dumps({"attachment_id": "A1", "parent_message_ids": ["M1"], "section_ids": ["SEC-001"], "content": "file", "sha256": "x", "authority_note": ""}))
    verbs.export_analysis(spark, store, session, f"{p}/v3", messages=f"{p}/m.jsonl", attachments=f"{p}/a.jsonl")
    a = decision(title="Use Parquet store", decision="Tables are Parquet files", status="proposed", evidence_refs=[{"evidence_type": "message", "evidence_id": "M1"}], rationale="fast")
    b = decision(title="Use the Parquet store", decision="Tables are Parquet files.", evidence_refs=[{"evidence_type": "message", "evidence_id": "M3"}])
    (p / "v3.json").write_text(json.dumps({"decisions": [b]}))
    assert verbs.validate_decisions_v3(spark, f"{p}/v3", f"{p}/v3.json")["message_evidence_references"] == 1
    assert verbs.export_sections(spark, f"{p}/v3", f"{p}/plain", guidance="g", prompt="p")["sections"] == 2
    assert verbs.VERBS["export-hybrid-section-analysis"](spark, f"{p}/v3", f"{p}/hybrid", knowledge="k")["messages_with_signals"] == 2
    with pytest.raises(errors.SectionBundle):
        verbs.export_sections(spark, f"{p}/v3", f"{p}/plain")
    assert verbs.export_signals(spark, f"{p}/v3", f"{p}/signals")["growth"] > 0
    assert verbs.export_experiment(spark, f"{p}/v3", f"{p}/arms", "k") == {"arms": 2, "sessions": 1}
    for n, d in (("001", a), ("002", b)):
        s = p / "results/sections" / f"SEC-{n}"
        s.mkdir(parents=True)
        (s / "decisions.raw.json").write_text(json.dumps({"decisions": [d]}))
        (s / "RUN_RESULT.json").write_text(json.dumps({"output_sha256": hashlib.sha256((s / "decisions.raw.json").read_bytes()).hexdigest()}))
    done = verbs.finalize_runs(spark, f"{p}/hybrid", f"{p}/results", f"{p}/final")
    assert (done["valid"], done["decisions"], done["repairs"], done["complete"]) == (2, 2, 1, True)
    report = verbs.export_candidates(spark, f"{p}/final", session, f"{p}/cand")
    assert (report["candidate_pair_count"], report["candidate_cluster_count"]) == (1, 1)
    for version, verb in ((1, "export-integration-adjudication"), (2, "export-integration-adjudication-v2")):
        assert verbs.VERBS[verb](spark, f"{p}/cand", f"{p}/hybrid", f"{p}/adj{version}") == {"clusters": 1, "version": version}
    cluster = spark.read.parquet(f"{p}/cand/clusters").first()
    assert "candidate_relation" not in spark.read.json(f"{p}/adj1/clusters").columns
    keys = cluster.member_decision_keys
    judgment = {"judgment_id": "J-001", "relation": "uncertain", "member_decision_keys": keys, "direction": None, "rationale": ["w"], "evidence_refs": [{"evidence_type": "message", "evidence_id": "M1"}], "confidence": "high", "missing_information": []}
    (p / "adj.jsonl").write_text(json.dumps({"cluster_id": cluster.cluster_id, "judgments": [judgment], "unclassified_decision_keys": []}))
    assert verbs.validate_adjudication(spark, f"{p}/adj2", f"{p}/adj.jsonl")[0]["classified_decision_count"] == 2
    assert verbs.assemble(spark, f"{p}/cand", f"{p}/adj2", f"{p}/adj.jsonl", f"{p}/made")[0]["decisions_after"] == 2
    assert verbs.export_lifecycle(spark, f"{p}/made", f"{p}/hybrid", f"{p}/life")["groups"] == 1
    result = {"decision_id": "ID-001", "final_status": "superseded", "rationale": ["w"], "evidence_refs": [{"evidence_type": "message", "evidence_id": "M3"}], "confidence": "high", "missing_information": []}
    (p / "life.jsonl").write_text(json.dumps({"group_id": "LIFECYCLE-SEC-001", "results": [result]}))
    report = verbs.apply_lifecycle(spark, f"{p}/made", f"{p}/hybrid", f"{p}/life.jsonl", f"{p}/end")
    assert {"status": "superseded", "before": 0, "after": 1} in report
    (p / "bad.jsonl").write_text(json.dumps({"group_id": "LIFECYCLE-SEC-001", "results": []}))
    with pytest.raises(errors.LifecycleFailure, match="coverage"):
        verbs.apply_lifecycle(spark, f"{p}/made", f"{p}/hybrid", f"{p}/bad.jsonl", f"{p}/end2")


def test_documents_share_files(spark, tmp_path):
    """The files of a bundle don't grow with its units, each of which is a line that names it."""
    from recordloom.sources import sinks

    sinks.documents(spark.range(2000).selectExpr("format_string('CLUSTER-%04d', id) AS cluster_id", "id AS x"), f"{tmp_path}/clusters", "cluster_id")
    files = [p for p in tmp_path.rglob("*.json")]
    assert len(files) <= 8 and sum(len(p.read_text().splitlines()) for p in files) == 2000
    got = spark.read.json(f"{tmp_path}/clusters")
    assert sorted(map(tuple, got.select("cluster_id", "x").collect())) == [(f"CLUSTER-{i:04d}", i) for i in range(2000)]


def test_messages_of_one_document_are_dealt(spark, tmp_path):
    """A session's document is one line of one file; what is done to its messages isn't one task's."""
    (tmp_path / "analysis_session").mkdir()
    (tmp_path / "attachments").mkdir()
    messages = [{"source_line": i, "id": f"e{i}", "evidence_id": f"m{i}", "section_id": "SEC-001", "actor": "human", "content": "x"} for i in range(100)]
    (tmp_path / "analysis_session" / "a.json").write_text(json.dumps({"session_id": "s", "messages": messages}))
    m, _ = verbs.analysis(spark, str(tmp_path))
    assert m.count() == 100 and "hashpartitioning(source_line" in m._jdf.queryExecution().toString()


def test_documents_have_parts(spark, run, tmp_path, monkeypatch):
    """No line of a bundle grows with its session: documents of more lines are parts by source line, which say the same together."""
    from recordloom.operators import projection

    p, session = run
    texts = [f"message {i}" + ("ので" if i % 2 else "") for i in range(40)]
    log = [{"type": "response_item", "payload": {"type": "message", "role": "user", "content": x}} for x in texts]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in log) + "\n", encoding="utf-8")
    session = verbs.ingest(spark, f"{tmp_path}/log.jsonl", f"{tmp_path}/store")[0]["session_id"]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"raw_line": i + 1, "message_id": f"M{i}", "actor": "human", "section_id": f"SEC-00{i % 2 + 1}"}) for i in range(40)))
    (tmp_path / "a.jsonl").write_text(json.dumps({"attachment_id": "A1", "parent_message_ids": ["M0"], "section_ids": ["SEC-001"], "content": "file", "sha256": "x", "authority_note": ""}))
    one = decision(title="t", decision="d", status="proposed", evidence_refs=[{"evidence_type": "message", "evidence_id": "M39"}], rationale=["w"])
    said = {}
    for lines in (10_000, 7):
        monkeypatch.setattr(projection, "PART", lines)
        at = tmp_path / str(lines)
        verbs.export_analysis(spark, f"{tmp_path}/store", session, f"{at}/v3", messages=f"{tmp_path}/m.jsonl", attachments=f"{tmp_path}/a.jsonl")
        (at / "d.json").write_text(json.dumps({"decisions": [one]}))
        report = [verbs.validate_decisions_v3(spark, f"{at}/v3", f"{at}/d.json"), verbs.export_sections(spark, f"{at}/v3", f"{at}/hybrid", hybrid=True), verbs.export_experiment(spark, f"{at}/v3", f"{at}/arms", "k")]
        s = at / "results/sections/SEC-001"
        s.mkdir(parents=True)
        (s / "decisions.raw.json").write_text(json.dumps({"decisions": [one | {"evidence_refs": [{"evidence_type": "message", "evidence_id": "M38"}, {"evidence_type": "attachment", "evidence_id": "A1"}]}]}))
        (s / "RUN_RESULT.json").write_text(json.dumps({"output_sha256": hashlib.sha256((s / "decisions.raw.json").read_bytes()).hexdigest()}))
        report.append(verbs.finalize_runs(spark, f"{at}/hybrid", f"{at}/results", f"{at}/final"))
        fields = "session_id string, decision_id string, source_decision_keys array<string>, status string"
        spark.createDataFrame([(session, "ID-001", ["SEC-001:D-001"], "proposed")], fields).write.parquet(f"{at}/made/decisions")
        report.append(verbs.export_lifecycle(spark, f"{at}/made", f"{at}/hybrid", f"{at}/life"))
        result = {"decision_id": "ID-001", "final_status": "accepted", "rationale": ["w"], "evidence_refs": [{"evidence_type": "message", "evidence_id": "M39"}], "confidence": "high", "missing_information": []}
        (at / "life.jsonl").write_text(json.dumps({"group_id": "LIFECYCLE-SEC-001", "results": [result]}))
        report.append(verbs.apply_lifecycle(spark, f"{at}/made", f"{at}/hybrid", f"{at}/life.jsonl", f"{at}/end"))
        docs = {}
        for name in ("v3/analysis_session", "hybrid/sections", "life/groups"):
            found = [(f.parent.name, json.loads(x)) for f in (at / name).rglob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
            assert all(len(d["messages"]) <= lines for _, d in found) and (len(found) > 2 or lines > 40)
            docs[name] = {}
            for key, d in sorted(found, key=lambda x: (x[0], x[1]["messages"][0]["source_line"])):
                whole = docs[name].setdefault(key, {k: [] if k in ("messages", "attachments") else v for k, v in d.items()})
                whole["messages"] += d["messages"]
                whole["attachments"] = whole.get("attachments", []) + d.get("attachments", [])
        said[lines] = report, docs
    assert said[7] == said[10_000]
    assert [m["evidence_id"] for m in said[7][1]["v3/analysis_session"]["analysis_session"]["messages"]] == [f"M{i}" for i in range(40)]
