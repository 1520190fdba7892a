"""The store's commit log: crashes, two writers, snapshots; and ingest of a stream on top of it."""

import shutil

import pytest

from recordloom.sources import logs, sinks
from recordloom.streaming import ingest


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, x int")


def test_all_tables_of_a_batch_or_none(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    read = lambda name, **more: sorted(map(tuple, sinks.read(spark, root, name, "k string, x int", **more).collect()))
    assert read("a") == []
    assert sinks.publish({"a": frame(spark, ("p", 1)), "b": frame(spark, ("p", 2))}, root, "one") == 1
    broken = frame(spark, ("q", 1)).selectExpr("k", "cast(raise_error('died') as int) as x")
    with pytest.raises(Exception, match="died"):  # between the tables
        sinks.publish({"a": frame(spark, ("q", 1)), "b": broken}, root, "two")
    assert read("a") == [("p", 1)] and read("b") == [("p", 2)]
    with monkeypatch.context() as m:  # with a claimed number, before the entry
        m.setattr(sinks, "write_text", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            sinks.publish({"a": frame(spark, ("q", 1))}, root, "two")
    assert read("a") == [("p", 1)]
    assert sinks.publish({"a": frame(spark, ("q", 3)), "b": frame(spark, ("q", 4))}, root, "two") == 3, "the claimed number is a gap"
    assert sinks.publish({"a": frame(spark, ("q", 3))}, root, "two") is None
    assert read("a") == [("p", 1), ("q", 3)] and read("a", version=2) == [("p", 1)] and read("b") == [("p", 2), ("q", 4)]
    assert sinks.vacuum(spark, root, ("a", "b")) == []
    assert len(sinks.vacuum(spark, root, ("a", "b"), hours=0)) == 3 and read("a") == [("p", 1), ("q", 3)] and read("b") == [("p", 2), ("q", 4)]


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    claim, other = sinks.claim, []

    def slow(*args):
        """Another writer commits the same batch and one more before this one claims its number."""
        monkeypatch.setattr(sinks, "claim", claim)
        other.append(sinks.publish({"a": frame(spark, ("p", 1))}, root, "one"))
        other.append(sinks.publish({"a": frame(spark, ("q", 2))}, root, "two"))
        return claim(*args)

    monkeypatch.setattr(sinks, "claim", slow)
    mine = sinks.publish({"a": frame(spark, ("p", 1))}, root, "one")
    assert (other, mine) == ([1, 2], 3)
    assert sorted(map(tuple, sinks.read(spark, root, "a", "k string, x int").collect())) == [("p", 1), ("q", 2)]
    before = sinks.read(spark, root, "a", "k string, x int")  # a reader keeps the version that it began with
    sinks.publish({"a": frame(spark, ("r", 3))}, root, "three")
    assert before.count() == 2


def test_latest_run_reads_only_its_folder(spark, tmp_path):
    root = str(tmp_path / "store")
    none = "decision_id string, status string, evidence_message_ids array<string>"
    runs = lambda: sinks.read(spark, root, "analysis_runs", "run_id int, session_id string, status string")
    for k in range(4):
        assert sinks.save_run(spark, root, runs(), f"s{k % 2}", spark.createDataFrame([(f"D-{k}", None, ["m"])], none), "v1", "manual") == k + 1
    found = logs.latest_decisions(runs(), sinks.read(spark, root, "decisions", "session_id string, decision_id string, status string, run_id int", by="run_id"))
    assert sorted((r.session_id, r.run_id, r.decision_id, r.status) for r in found.collect()) == [("s0", 3, "D-2", "unknown"), ("s1", 4, "D-3", "unknown")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    metrics = [m for m in _scans(found._jdf.queryExecution().executedPlan()) if m[0] > 0]
    assert (2, 2) in metrics, f"two files in two folders are read: {metrics}"


def _scans(plan):
    """(files, partitions) read by each file scan of an executed plan."""
    out = []
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return _scans(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return _scans(plan.plan())
    if plan.nodeName().startswith("Scan parquet") and plan.metrics().contains("numPartitions"):
        out.append((plan.metrics().apply("numFiles").value(), plan.metrics().apply("numPartitions").value()))
    for k in range(plan.children().size()):
        out += _scans(plan.children().apply(k))
    return out


LINES = "session_id string, seq int, raw_text string"


def test_stream_ingest_survives_a_crash(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    user = '{"type":"response_item","payload":{"type":"message","role":"user","content":"%s"}}'

    def arrive(*rows):
        spark.createDataFrame(list(rows), LINES).coalesce(1).write.mode("append").parquet(source)

    def run():
        q = ingest.ingest(spark.readStream.schema(LINES).parquet(source), store, checkpoint)
        q.awaitTermination(120)
        assert q.exception() is None
        q.stop()

    arrive(("s", 1, user % "a"), ("s", 2, "no json"), ("t", 1, user % "b"))
    run()
    arrive(("s", 3, '{"type":"later","payload":{}}'), ("s", 4, user % "c"), ("u", 1, ""))
    run()
    # a crash after the store's commit, before Spark's own: the batch comes again, with the same number
    for mark in ("1", ".1.crc"):
        (tmp_path / "checkpoint" / "commits" / mark).unlink(missing_ok=True)
    arrive(("t", 2, user % "d"))
    run()
    events = sorted((r.session_id, r.source_line, r.kind) for r in sinks.read(spark, store, "events", "session_id string, source_line int, kind string").collect())
    assert events == [("s", 1, "message"), ("s", 2, "parse_error"), ("s", 3, "unknown"), ("s", 4, "message"), ("t", 1, "message"), ("t", 2, "message"), ("u", 1, "parse_error")]
    loss = {r.session_id: (r.total_lines, r.recognized, r.unknown, r.parse_errors, r.silently_dropped) for r in ingest.losses(spark, store).collect()}
    assert loss == {"s": (4, 2, 1, 1, 0), "t": (2, 2, 0, 0, 0), "u": (1, 0, 0, 1, 0)}
    assert sorted(r.id for r in sinks.read(spark, store, "sessions", ingest.SESSIONS).collect()) == ["s", "t", "u"]
    # a crash before the store's commit leaves nothing: the same lines as one batch give the same numbers
    again = str(tmp_path / "again")
    assert ingest.load_batch(spark.read.parquet(source), again, "lines-0") == 1 and ingest.load_batch(spark.read.parquet(source), again, "lines-0") is None
    assert sorted((r.session_id, r.source_line, r.kind) for r in sinks.read(spark, again, "events", "session_id string, source_line int, kind string").collect()) == events
    shutil.rmtree(source)
