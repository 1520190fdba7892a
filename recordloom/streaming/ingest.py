"""Ingest of a stream of lines: numbered by session, counted, committed to a store once, whatever is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from ..operators import normalize
from ..session import stored
from ..sources import sinks

COUNTS = "session_id string, n long"
LOSS = "session_id string, total_lines long, recognized long, unknown long, parse_errors long, silently_dropped long"
SESSIONS = "id string, source_type string, source_file string, source_sha256 string, created_at timestamp, normalized_at timestamp"


def load_batch(lines: DataFrame, store: str, batch: str, adapter: str = "default") -> int | None:
    """Commits one batch of lines (session_id, seq, raw_text) under its name; None if that name was committed before.

    A line's number goes on from its session's lines in earlier commits, in order of seq (then text). Committed together: raw and
    normalised events, lines per session, the loss report of the batch, and new sessions.
    """
    spark = lines.sparkSession
    if sinks.committed(spark, store).where(F.col("batch") == batch).head(1):
        return None
    own = stored(lines.select("session_id", "seq", "raw_text"), "lines")
    here = own.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    before = sinks.read(spark, store, "line_counts", COUNTS).join(here.select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(F.sum("n").alias("before"))
    begun = stored(here.join(before, "session_id", "left"), "begun")
    place = F.row_number().over(W.partitionBy("session_id").orderBy("seq", "raw_text"))
    numbered = own.withColumn("_n", place).join(begun.select("session_id", "before"), "session_id")
    numbered = numbered.select("session_id", (F.coalesce("before", F.lit(0)) + F.col("_n")).cast("int").alias("source_line"), "raw_text")
    raw, events = normalize.normalize(stored(numbered, "numbered"), adapter)
    raw, events = stored(raw, "raw"), stored(events, "events")
    now, none = F.current_timestamp(), F.lit(None).cast("string")
    new = begun.where("before is null").select(F.col("session_id").alias("id"), F.lit("stream").alias("source_type"), none.alias("source_file"), none.alias("source_sha256"), now.alias("created_at"), now.alias("normalized_at"))
    return sinks.publish({"raw_events": raw, "events": events, "line_counts": begun.select("session_id", "n"), "loss": normalize.loss_report(raw, events), "sessions": new}, store, batch)


def ingest(lines: DataFrame, store: str, checkpoint: str, name: str = "lines", adapter: str = "default", **trigger) -> StreamingQuery:
    """Starts the ingest of a stream of lines (session_id, seq, raw_text). Spark gives a batch the same number when it replays it after a
    crash, and the store's log knows the batches by number: what was committed before the crash isn't loaded again, what wasn't leaves
    nothing. Within a batch, a session's lines are numbered by one task: bound batches by the source's own limit."""
    writer = lines.writeStream.foreachBatch(lambda batch, number: load_batch(batch, store, f"{name}-{number}", adapter) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def losses(spark: SparkSession, store: str) -> DataFrame:
    """The loss report of each session so far."""
    names = [c.split()[0] for c in LOSS.split(", ")][1:]
    return sinks.read(spark, store, "loss", LOSS).groupBy("session_id").agg(*(F.sum(n).alias(n) for n in names))
