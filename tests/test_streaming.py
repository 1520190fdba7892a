from recordloom.operators import normalize
from recordloom.streaming import classify


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", 1, '{"type":"turn_context","payload":{"type":"x"}}', None), ("s", 2, "no json", None), ("s", 3, '{"type":"response_item","payload":{"type":"message","role":"user","content":"hi"}}', None)]
    spark.createDataFrame(rows, classify.LINES).write.parquet(f"{tmp_path}/in")
    q = classify.classified(classify.read_lines(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
    q.processAllAvailable()
    q.stop()
    got = {(r.source_line, r.kind, r.role, r.content) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    _, e = normalize.normalize(spark.createDataFrame(rows, classify.LINES).drop("at"))
    assert got == {(r.source_line, r.kind, r.role, r.content) for r in e.collect()} == {(1, "metadata", None, "turn_context:x"), (2, "parse_error", None, None), (3, "message", "user", "hi")}


def test_counts_stream(spark, tmp_path):
    spark.sql("SELECT 's' AS session_id, CAST(id AS INT) AS source_line, 'x' AS raw_text, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,CAST(id AS INT)*3) AS at FROM range(20)").write.parquet(f"{tmp_path}/in")
    q = classify.kind_counts(classify.read_lines(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("kinds").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM kinds").first().n == 20


def test_asof_with_late_rows_is_the_batch(spark, tmp_path):
    """Rows arrive out of order, by up to five minutes; what the last watermark has passed is what the batch gives."""
    import datetime as dt
    import random

    from recordloom.operators import sections
    from recordloom.streaming import asof

    r, start = random.Random(6), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(240):
        at = start + dt.timedelta(seconds=30 * i // 2, microseconds=r.randrange(3))
        rows.append((f"k{r.randrange(3)}", at, f"e{i}", None) if r.random() < 0.6 else (f"k{r.randrange(3)}", at, None, f"v{r.randrange(100):02d}"))
    rows += [("k0", start + dt.timedelta(minutes=20), None, "v98"), ("k0", start + dt.timedelta(minutes=20), None, "v99"), ("k0", start + dt.timedelta(minutes=20), "tie", None), ("new", start + dt.timedelta(minutes=1), "none", None)]
    order = sorted(rows, key=lambda x: (x[1] + dt.timedelta(seconds=r.randrange(300)), x[2] or ""))
    order += [("end", start + dt.timedelta(days=1), "end", None)]
    source = f"{tmp_path}/in"
    for k in range(0, len(order), 50):
        spark.createDataFrame(order[k : k + 50], asof.ROWS).coalesce(1).write.mode("append").parquet(source)
    q = asof.filled(spark.readStream.schema(asof.ROWS).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(300)
    assert q.exception() is None
    got = sorted((x.key, x.at, x.id, x.value or "") for x in spark.read.parquet(f"{tmp_path}/out").collect())
    d = spark.createDataFrame(rows, asof.ROWS)
    batch = sections.asof(d.where("id is not null").drop("value"), d.where("id is null").select("key", "at", "value"), ["key"], "at", "value")
    assert got == sorted((x.key, x.at, x.id, x.value or "") for x in batch.select("key", "at", "id", "value").collect()) and len(got) > 100
