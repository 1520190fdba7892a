import hashlib
import json

from recordloom.operators import normalize, projection, sections
from recordloom.plans import verbs
from recordloom.sources import logs, sinks

LOG = [
    {"timestamp": "t1", "type": "session_meta", "payload": {"id": "x"}},
    {"timestamp": "t2", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "お願い"}, {"input_text": "二"}, 5]}},
    {"timestamp": 3, "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": "はい"}},
    {"type": "response_item", "payload": {"type": "function_call", "name": "shell_command", "arguments": "ls"}},
    {"type": "event_msg", "payload": {"type": "patch_apply_end", "message": "ok"}},
    {"type": "new_future_event", "payload": {}},
    "this is not json",
    "",
]


def write(tmp_path, rows, end="\n"):
    p = tmp_path / "log.jsonl"
    p.write_bytes((end.join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in rows) + end).encode())
    return p


def test_every_line_is_kept_and_classified(spark, tmp_path):
    p = write(tmp_path, LOG)
    lines = logs.read_log(spark, str(p))
    raw, events = normalize.normalize(lines)
    got = {r.source_line: r for r in events.collect()}
    assert [got[i].kind for i in range(1, 9)] == ["metadata", "message", "message", "command", "file_change", "unknown", "parse_error", "parse_error"]
    session = hashlib.sha256(p.read_bytes()).hexdigest()[:16]
    assert got[2].id == f"{session}-msg-000002" and got[4].id == f"{session}-evt-000004" and got[1].content == "session_meta"
    assert got[2].content == "お願い\n\n二" and got[3].content == "はい" and got[3].timestamp is None and got[2].role == "user"
    report = normalize.loss_report(raw, events).first()
    assert (report.total_lines, report.recognized, report.unknown, report.parse_errors, report.silently_dropped) == (8, 5, 1, 2, 0)
    assert normalize.loss_report(raw, events.where("source_line > 2")).first().silently_dropped == 2
    seen = lines.select("source_sha256").distinct()
    assert logs.only_new(lines, seen).count() == 0


def test_line_ends(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_bytes(b"a\r\nb\rc\n\nd")
    assert [r.raw_text for r in logs.read_log(spark, str(p)).orderBy("source_line").collect()] == ["a", "b", "c", "", "d"]


def test_split_files_and_large_files(spark, tmp_path):
    for name, n in (("a", 900), ("b", 5), ("c", 900), ("d", 0)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"line {i} of {'a' if name == 'c' else name}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        for whole in (logs.WHOLE, 100):
            got = logs.read_log(spark, f"{tmp_path}/*.jsonl", whole=whole)
            assert spark.read.text(f"{tmp_path}/*.jsonl").rdd.getNumPartitions() > 20
            rows = got.collect()
            assert {(r.source_line, r.raw_text) for r in rows} == {(i + 1, f"line {i} of {x}") for x, n in (("a", 900), ("b", 5)) for i in range(n)} and len(rows) == 905
            assert {r.source_sha256 for r in rows} == {hashlib.sha256((tmp_path / f"{x}.jsonl").read_bytes()).hexdigest() for x in "ab"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_odd_shapes(spark):
    rows = ['{"type":"response_item","payload":[1]}', '{"type":"event_msg","payload":{"type":"token_count","info":"i"}}', '{"type":"turn_context","payload":{"type":""}}', "[1]", '{"type":7,"payload":{}}',
            '{"type":"response_item","payload":{"type":"message","role":5,"content":[{"x":1}]}}', '{"type":"response_item","payload":{"type":"custom_tool_call","name":"apply_patch"}}', '{"a":1,"a":2}']
    lines = spark.createDataFrame([("s", i + 1, r) for i, r in enumerate(rows)], "session_id string, source_line int, raw_text string")
    _, e = normalize.normalize(lines)
    got = {r.source_line: (r.kind, r.role, r.content) for r in e.collect()}
    assert got == {1: ("unknown", None, None), 2: ("metadata", None, "i"), 3: ("metadata", None, "turn_context"), 4: ("unknown", None, None), 5: ("unknown", None, None), 6: ("message", None, None), 7: ("file_change", None, "apply_patch"), 8: ("unknown", None, None)}
    flags = normalize.parse(lines).select("source_line", normalize.can_handle(normalize.F.col("raw")).alias("x")).collect()
    assert {r.source_line for r in flags if r.x} == {2, 3, 6, 7}


def test_hashes_of_streamed_files(spark, tmp_path):
    """Files over the bar are one task's each, line by line; all kinds of ends, bytes that are no UTF-8, a byte-order mark."""
    made = {"a": b"x\ny\r\nz", "b": b"x\n", "c": b"\n\n\n", "d": b"\xff\xfe\n\x80", "e": b"\xef\xbb\xbfx\n", "f": b"\xef\xbb\xbfx", "g": b"q" * 5_000_000, "h": b"one\rtwo\r", "i": b"", "j": b"l\n" * 200_000}
    (tmp_path / "sub").mkdir()
    for name, data in made.items():
        (tmp_path / "sub" / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.source_sha256) for r in logs.file_hashes(spark, f"{tmp_path}/sub", whole=0).collect()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in made.items() if v} and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert {r.sha256 for r in sinks.manifest(spark, str(tmp_path)).collect()} == {x for _, x in got.values()}


def test_numbering_moves_no_line(spark, tmp_path):
    """Neither exchange nor broadcast lies above the scan of the text; the offset table is what is broadcast."""
    for k in range(5):
        (tmp_path / f"{k}.jsonl").write_text("".join(f"{k} {i}\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        d = logs.read_log(spark, f"{tmp_path}/*.jsonl")
        d.collect()
        plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        text = [line for line in plan.splitlines() if "FileScan text" in line]
        broadcast = plan[plan.index("BroadcastExchange"):]
        assert len(text) == 1 and "FileScan text" not in broadcast and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        in_groups = logs.read_log(spark, f"{tmp_path}/*.jsonl", most=3)
        assert sorted(map(tuple, in_groups.select("source_line", "raw_text").collect())) == sorted(map(tuple, d.select("source_line", "raw_text").collect())) == sorted((i + 1, f"{k} {i}") for k in range(5) for i in range(300))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        changed = spark.read.text(f"{tmp_path}/*.jsonl")  # a read that is dealt out in another way than its offsets raises
        offsets = logs._offsets(spark, [f"{tmp_path}/*.jsonl"], logs.file_hashes(spark, f"{tmp_path}/*.jsonl").select("source_sha256", "path"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        try:
            logs._numbered(spark, [f"{tmp_path}/*.jsonl"], offsets).collect()
            raise AssertionError("must raise")
        except Exception as e:
            assert "changed while they were read" in str(e) and changed.count() == 1500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_is_what_python_reads(spark):
    """Repeated keys, NaN, depth, long numbers and what stands behind a value, whatever the session's settings."""
    deep = lambda n: '{"type":"x","payload":' + "[" * n + "]" * n + "}"
    rows = ['{"type":"a","type":"b"}', '{"type":"a","n":NaN}', '{"n":-Infinity,"type":"a"}', '{"type":"a"} x', '{"type":"a"}{"type":"b"}', '{"type":"a"}}', '{"type":"a"}]}', "1 2", "[1]]", '{"type":"a","v":[]', '1,"v":2', '1}],"v":[{"v":1',
            '{"type":"a","n":' + "9" * 1200 + "}", '{"type":"a","n":1e400}', deep(900), deep(1500), deep(5000), deep(50000), "NaN", "null", '"x" ', "", " ", '\ufeff{"type":"a"}', '{"type":"a"}\x00', '{"type":"\\ud800"}', "{'type':1}", None]
    d = normalize.parse(spark.createDataFrame([("s", i, x) for i, x in enumerate(rows)], "session_id string, source_line int, raw_text string"))
    got = {r.source_line: (r.parsed_ok, r.event_type) for r in d.select("source_line", "parsed_ok", "event_type").collect()}
    for i, x in enumerate(rows):
        try:
            v = json.loads(x)
            want = (True, v.get("type") if isinstance(v, dict) else None)
        except (ValueError, RecursionError, TypeError):
            want = (False, None)
        assert got[i] == want or "ud800" in (x or "") and got[i][0], (i, (x or "")[:60], got[i], want)


def test_projection(spark):
    block = "# AGENTS.md instructions for /w\n\n<INSTRUCTIONS> Keep it </INSTRUCTIONS>"
    rows = [("1", 1, "message", "developer", block), ("2", 2, "message", "user", "<environment_context>cwd</environment_context>"), ("3", 3, "message", "user", f"{block}\nPlease <INSTRUCTIONS> </INSTRUCTIONS>　"),
            ("4", 4, "message", "assistant", " Done "), ("5", 5, "file_change", None, "p"), ("6", 6, "command", None, "ls"), ("7", 7, "message", "user", "　")]
    e = spark.createDataFrame([("s", i, n, k, r, c, "t") for i, n, k, r, c in rows], "session_id string, id string, source_line int, kind string, role string, content string, source_event_type string")
    assert [(r.actor, r.content) for r in projection.messages(e).orderBy("source_line").collect()] == [("human", "Please <INSTRUCTIONS> </INSTRUCTIONS>"), ("assistant", "Done")]
    assert [(r.id, r.content) for r in projection.constraints(e).collect()] == [("1-constraint-001", "Keep it")]
    r = projection.report(e).first()
    assert (r.messages, r.constraints, r.implementation_events, r.normalized_events) == (2, 1, 2, 7)
    doc = projection.project(e).first()
    assert len(doc.messages) == 2 and doc.implementation_events[0].kind == "file_change"
    evidence = spark.createDataFrame([("s", 3, "M-3", "human", "SEC-001"), ("s", 4, "M-4", "human", None)], "session_id string, raw_line int, message_id string, actor string, section_id string")
    d, bad = projection.with_evidence(projection.messages(e), evidence)
    assert {x.evidence_id for x in d.collect()} == {"M-3", "M-4"} and [x.message for x in bad.collect()] == ["actor differs for line 4"]


def test_asof_sections(spark):
    m = spark.createDataFrame([("s", 10, "SEC-001"), ("s", 30, "SEC-002")], "session_id string, source_line int, section_id string")
    e = spark.createDataFrame([("s", "a", 5), ("s", "b", 10), ("s", "c", 20), ("s", "d", 40), ("z", "e", 50)], "session_id string, id string, source_line int")
    assert {r.id: r.section_id for r in sections.assign_events(e, m).collect()} == {"a": None, "b": "SEC-001", "c": "SEC-001", "d": "SEC-002", "e": None}


def test_membership(spark):
    m = spark.createDataFrame([("SEC-001", "M1"), ("SEC-001", "M2")], "section_id string, evidence_id string")
    index = spark.createDataFrame([("SEC-001", ["M1", "M9"], ["A1"])], "section_id string, message_ids array<string>, attachment_ids array<string>")
    assert sorted(r.message for r in sections.membership_violations(m, index).collect()) == ["listed message is missing: M9", "message is not listed in its section: M2"]
    a = spark.createDataFrame([("A1", ["M1"], ["SEC-001"]), ("A2", ["M7"], ["SEC-001"])], "attachment_id string, parent_message_ids array<string>, section_ids array<string>")
    assert sorted(r.message for r in sections.attachment_violations(a, m, index).collect()) == ["attachment A2 is not listed in SEC-001", "unknown parent M7 of A2"]
    n = spark.createDataFrame([(1, "M1", "human"), (1, "M1", "robot")], "raw_line int, message_id string, actor string")
    assert sections.input_violations(n, a).count() == 4


def test_neighbors_and_window(spark):
    m = spark.createDataFrame([("s", "SEC-001", f"M{i}", "human", i, "c") for i in (1, 2, 3)] + [("s", "SEC-003", "M9", "human", 9, "c")], "session_id string, section_id string, evidence_id string, actor string, source_line int, content string")
    got = {r.evidence_id: (r.previous and r.previous.evidence_id, r.next and r.next.evidence_id) for r in sections.neighbors(m).collect()}
    assert got == {"M1": (None, "M2"), "M2": ("M1", "M3"), "M3": ("M2", None), "M9": (None, None)}
    g = spark.createDataFrame([("s", "SEC-001"), ("s", "SEC-002")], "session_id string, section_id string")
    assert {(r.section_id, r.context_section_id) for r in sections.window_sections(g, m).collect()} == {("SEC-001", "SEC-001"), ("SEC-001", "SEC-003"), ("SEC-002", "SEC-003")}


def test_documents_and_hashes(spark, tmp_path):
    for n, text in (("001", "\ufeff{\"a\": 1}"), ("002", "{\"a\": 2}")):
        d = tmp_path / "sections" / f"SEC-{n}"
        d.mkdir(parents=True)
        (d / "x.json").write_text(text, encoding="utf-8")
    docs = logs.section_files(spark, str(tmp_path), "x.json").orderBy("section_number")
    assert [(r.section_id, r.section_number) for r in docs.collect()] == [("SEC-001", 1), ("SEC-002", 2)]
    sha = hashlib.sha256((tmp_path / "sections/SEC-001/x.json").read_bytes()).hexdigest()
    rec = spark.createDataFrame([("SEC-001", sha), ("SEC-002", "0")], "section_id string, recorded_sha256 string")
    assert {r.section_id: r.hash_matches for r in logs.verify_hashes(docs.select("section_id", "sha256"), rec, ["section_id"]).collect()} == {"SEC-001": True, "SEC-002": False}
    (tmp_path / "sections/SEC-002/x.json").write_text("[1]")
    try:
        logs.section_files(spark, str(tmp_path), "x.json").select("doc").collect()
        raise AssertionError("an array root must fail")
    except Exception as e:
        assert "must be an object" in str(e)


def test_preferred_output(spark):
    res = spark.createDataFrame([("SEC-001", "decisions.validated.json", "v", "r"), ("SEC-002", None, None, "r"), ("SEC-003", "gone.json", "v", "r")], "section_id string, validated_output_path string, validated_output_sha256 string, output_sha256 string")
    files = spark.createDataFrame([("SEC-001", "decisions.validated.json")], "section_id string, name string")
    assert {r.section_id: (r.decisions_name, r.recorded_sha256) for r in logs.preferred(res, files).collect()} == {"SEC-001": ("decisions.validated.json", "v"), "SEC-002": ("decisions.raw.json", "r"), "SEC-003": ("decisions.raw.json", "r")}


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_json(spark, f"{out}/a.json", {"b": "あ", "a": 1}, sort=True)
    assert (tmp_path / "out/a.json").read_text(encoding="utf-8") == '{\n  "a": 1,\n  "b": "あ"\n}\n'
    try:
        sinks.refuse_non_empty(spark, out)
        raise AssertionError("must refuse")
    except FileExistsError:
        pass
    d = spark.createDataFrame([("s", "{}", False)], "session_id string, document string, has_signals boolean")
    arms = {r.arm: r for r in sinks.arms(d, "k").collect()}
    assert arms["control"].interpretation_knowledge is None and arms["knowledge"].interpretation_knowledge == "k" and arms["control"].sha256 == arms["knowledge"].sha256
    sinks.fan_out(spark.createDataFrame([("SEC-001", 1), ("SEC-002", 2)], "section_id string, x int"), f"{out}/sections", "section_id")
    assert sinks.manifest(spark, f"{out}/sections").where("path like '%.json'").count() == 2
    assert sinks.with_guidance("g \n", "\n p") == "g\n\n---\n\np"


def test_loaded_files_are_left_out_where_they_lie(spark, tmp_path, capsys):
    """Files are compared by digest before their lines are read; no line moves for it, to a task a file."""
    for name, text in (("a", "1\n2\n"), ("b", "3\n"), ("c", "1\n2\n")):
        (tmp_path / name).write_text(text)
    seen = spark.createDataFrame([(hashlib.sha256(b"1\n2\n").hexdigest(),)], "source_sha256 string")
    got = logs.read_log(spark, f"{tmp_path}/*", seen=seen)
    assert [(r.raw_text, r.source_line) for r in got.collect()] == [("3", 1)]
    got.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_ingest_parses_once(spark, tmp_path, monkeypatch, capsys):
    """What is published was parsed before; the report sets it against the files' lines."""
    p, made, publish, compared, report = write(tmp_path, LOG), {}, sinks.publish, [], normalize.loss_report
    monkeypatch.setattr(sinks, "publish", lambda tables, *more: made.update(tables) or publish(tables, *more))
    monkeypatch.setattr(normalize, "loss_report", lambda raw, events: compared.append(raw) or report(raw, events))
    got = verbs.ingest(spark, str(p), f"{tmp_path}/store")
    assert [(r["total_lines"], r["recognized"], r["unknown"], r["parse_errors"], r["silently_dropped"]) for r in got] == [(8, 5, 1, 2, 0)]
    for d in made.values():
        d.explain()
    plan = capsys.readouterr().out
    assert sorted(made) == ["events", "raw_events", "sessions"] and "parse_json" not in plan and "ArrowEvalPython" not in plan and "Scan text" not in plan
    compared[0].explain()
    assert "Scan text" in capsys.readouterr().out
    raw, events = normalize.normalize(logs.read_log(spark, str(p)))
    for d, name in ((raw, "raw_events"), (events, "events")):
        assert sorted(map(str, d.collect())) == sorted(map(str, made[name].collect()))
