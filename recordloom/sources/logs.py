"""Reading session logs, JSON documents and earlier results."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.shape import with_json
from ..functions.text import matches, section_number
from ..session import shared_dir, stored


#: Files up to so many bytes are hashed as one value; larger ones as a stream.
WHOLE = 256 << 20
#: The offset table of a read's splits is broadcast up to so many rows (some 40 MB); files with more are read in several groups.
SPLITS = 200_000


def _streamed_hashes(spark: SparkSession, paths: list[str], mark: bytes = b"") -> DataFrame:
    """path, source_sha256 of files of any size: each is one task's, which takes it line by line (a line has 2 GB at most). mark: bytes
    at the files' beginning that the line reader leaves out, a byte-order mark; files that prove to have another are null.

    The reading has a session of its own, whose settings keep a file in one piece and one file in a task, and ends in a stored
    table, so that neither files nor settings reach the caller's.
    """
    own = spark.newSession()
    for key, value in (("spark.sql.files.maxPartitionBytes", 1 << 60), ("spark.sql.files.openCostInBytes", 1 << 60), ("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)):
        own.conf.set(key, str(value))
    text = own.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))

    def run(batches):
        import hashlib

        path, size, done, sha = None, 0, len(mark), hashlib.sha256(mark)
        for b in batches:
            if path is None and b.num_rows:
                path, size = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            for line in b.column(2):
                sha.update(line.as_buffer())
                done += len(line.as_buffer())
                if done < size:  # all lines but the last have an end; the last if bytes are left
                    sha.update(b"\n")
                    done += 1
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sha.hexdigest() if done == size else None], pa.string())], names=["path", "source_sha256"])

    target, schema = f"{shared_dir(spark)}/hashes-{uuid.uuid4().hex}", "path string, source_sha256 string"
    text.mapInArrow(run, schema).write.parquet(target)
    return spark.read.schema(schema).parquet(target)


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE, recursive: bool = False) -> DataFrame:
    """path, size, source_sha256 of files, all made by executors: files up to whole bytes as one value each, larger ones (whose names
    come to the driver) as streams. A file without bytes has no row: Spark's readers pass over it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"))
    small = files.where(F.col("length") <= whole).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("source_sha256"))
    large = [r["path"] for r in named.where(F.col("size") > whole).collect()]
    if not large:
        return small
    made = _streamed_hashes(spark, large)
    marked = [r["path"] for r in made.where("source_sha256 is null").collect()]
    if marked:
        made = made.where("source_sha256 is not null").unionByName(_streamed_hashes(spark, marked, b"\xef\xbb\xbf"))
    known = F.coalesce("source_sha256", F.raise_error(F.concat(F.lit("changed while it was read: "), F.col("path"))).cast("string"))
    return small.unionByName(named.join(made, "path").withColumn("source_sha256", known))


def _numbered(spark: SparkSession, paths: list[str], splits: DataFrame) -> DataFrame:
    """Lines of files with their numbers. splits: path, split, first, before, n, source_sha256 of the same files' splits."""
    text = _text(spark, paths).join(F.broadcast(splits), ["path", "split"], "left")
    at = F.col("at") - F.col("first")
    where = F.concat(F.col("path"), F.lit(":"), F.col("split").cast("string"))
    known = F.when((at >= 0) & (at < F.col("n")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("files or splits changed while they were read: "), where)).cast("string"))
    good = F.when(F.is_valid_utf8("raw_text"), F.col("raw_text")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string"))
    return text.where("source_sha256 is not null or first is null").select(known.alias("path"), "source_sha256", F.substring("source_sha256", 1, 16).alias("session_id"), (at + F.col("before") + 1).cast("int").alias("source_line"), good.alias("raw_text"))


def _text(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw_text"))


def _offsets(spark: SparkSession, paths: list[str], own: DataFrame) -> DataFrame:
    """A row per split of files: path, split, first, n, before (lines of the file's splits before) and the file's digest, null for a
    file that isn't in own."""
    counted = _text(spark, paths).groupBy("path", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return stored(counted.withColumn("before", before).join(own, "path", "left"), "offsets")


def read_log(spark: SparkSession, path: str, whole: int = WHOLE, most: int = SPLITS, seen: DataFrame | None = None) -> DataFrame:
    """Lines of log files: path, source_sha256, session_id, source_line (from 1), raw_text.

    Any line end counts, blank lines are lines, and the end of the last line begins none; bytes that are no UTF-8 fail the file.
    Files are split: a line's number is its place in its split and the number of lines in the file's splits before. A file's
    digest names its session; of files with equal bytes the one with the least path is read, and those whose digests are in seen
    (source_sha256) are left out.

    Lines are counted and files hashed when this is called. The reading itself moves no line: each split's task looks its offset up in a
    table with a row a split, which is broadcast; files whose splits are more than most are read in groups of fewer (a single
    file with more is a group by itself).
    """
    own = file_hashes(spark, path, whole).groupBy("source_sha256").agg(F.min("path").alias("path"))
    own = stored(own if seen is None else only_new(own, seen), "files")
    splits = _offsets(spark, [path], own)
    if splits.count() <= most:
        return _numbered(spark, [path], splits)
    made, group, size = [], [], 0
    for r in [*splits.groupBy("path").agg(F.count(F.lit(1)).alias("k")).orderBy("path").collect(), None]:
        if group and (r is None or size + r["k"] > most):
            made.append(_numbered(spark, group, _offsets(spark, group, own)))
            group, size = [], 0
        if r is not None:
            group, size = [*group, r["path"]], size + r["k"]
    return reduce(DataFrame.unionByName, made)


def only_new(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """Lines of files, or files, whose bytes haven't been loaded before. Lines would move to a task a file: read_log leaves files out."""
    return lines.join(sessions.select("source_sha256"), "source_sha256", "left_anti")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per non-blank line that holds a JSON object; another value fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents: path, sha256 of the bytes, text without a byte-order mark, doc (VARIANT object).

    A document whose root is no object fails the read.
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    d = with_json(files.select("path", F.sha2("content", 256).alias("sha256"), text.alias("text")), "text", "doc", "_ok").drop("_ok")
    good = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    return d.withColumn("doc", F.when(good, F.col("doc")).otherwise(F.parse_json(F.raise_error(F.concat(F.lit("JSON root must be an object: "), F.col("path"))).cast("string"))))


def section_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Documents root/sections/SEC-ddd/name, with section_id and its number."""
    d = read_documents(spark, f"{root}/sections/SEC-*/{name}")
    d = d.withColumn("section_id", F.regexp_extract("path", r"/sections/([^/]+)/[^/]+$", 1)).where(matches("SEC-[0-9]{3}", F.col("section_id")))
    return d.withColumn("section_number", section_number(F.col("section_id")))


def verify_hashes(actual: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """actual (keys, sha256) beside recorded (keys, recorded_sha256): adds hash_matches; a missing record doesn't match."""
    return actual.join(recorded.select(*keys, "recorded_sha256"), keys, "left").withColumn("hash_matches", F.coalesce(F.col("sha256") == F.col("recorded_sha256"), F.lit(False)))


def events_of(events: DataFrame, session_id: str, messages_only: bool = False) -> DataFrame:
    """A session's events; source_line is their order, which the sinks put them in."""
    found = events.where(F.col("session_id") == session_id)
    return found.where("kind = 'message'") if messages_only else found


def session_exists(sessions: DataFrame, session_id: str) -> bool:
    return bool(sessions.where(F.col("id") == session_id).head(1))


def message_ids(events: DataFrame) -> DataFrame:
    return events.where("kind = 'message'").select("session_id", F.col("id").alias("evidence_id"))


def latest_decisions(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions of each session's latest completed run; decision_id is their order."""
    latest = runs.where("status = 'completed'").groupBy("session_id").agg(F.max("run_id").alias("run_id"))
    return decisions.join(latest, ["session_id", "run_id"])


def preferred(results: DataFrame, files: DataFrame) -> DataFrame:
    """Each section's validated output where that file exists, else the raw one: adds decisions_name and recorded_sha256.

    results: section_id, validated_output_path, validated_output_sha256, output_sha256; files: section_id, name.
    """
    have = files.select("section_id", F.col("name").alias("validated_output_path"), F.lit(True).alias("_have"))
    d = results.join(have, ["section_id", "validated_output_path"], "left")
    use = F.col("_have").isNotNull() & (F.col("validated_output_path") != "decisions.raw.json")
    return d.withColumn("decisions_name", F.when(use, F.col("validated_output_path")).otherwise("decisions.raw.json")).withColumn(
        "recorded_sha256", F.when(use, F.col("validated_output_sha256")).otherwise(F.col("output_sha256"))).drop("_have")
