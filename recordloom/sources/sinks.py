"""Writing tables, bundles and manifests."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .logs import file_hashes

GUIDANCE_RULE = "\n\n---\n\n"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def refuse_non_empty(spark: SparkSession, path: str, kind: type[Exception] = FileExistsError) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p) and len(fs.listStatus(p)):
        raise kind(f"output directory is not empty: {path}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-made file, on whatever store the path names."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def canonical(value, sort: bool = False) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=sort) + "\n"


def write_json(spark: SparkSession, path: str, value, sort: bool = False) -> None:
    write_text(spark, path, canonical(value, sort))


#: An entry of a store's log: what a commit added.
ENTRY = "version long, batch string, tables map<string,string>"


def publish(tables: Mapping[str, DataFrame], root: str, batch: str, by: Mapping[str, str] | None = None) -> int | None:
    """Commits tables to a store under a batch's name, all or nothing; returns the version, or None if the batch was there already.

    Files are written once, to folders of their own, and never changed. Then an entry that names them is put in the store's log: its number is
    claimed by exclusive creation of a file, and its text appears under its name by a rename. A writer that dies before that leaves files
    that no entry names; one that dies with a claimed number leaves a gap, which readers pass over. Two writers of one batch
    both succeed, and the entry with the lower number counts. by names, for some tables, a column whose values get folders of
    their own, for readers to prune by.
    """
    spark = next(iter(tables.values())).sparkSession
    if committed(spark, root).where(F.col("batch") == batch).head(1):
        return None
    mark, made = uuid.uuid4().hex, {}
    for name, df in tables.items():
        made[name] = f"{name}/commit={mark}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(by[name]) if by and name in by else writer).parquet(f"{root}/{made[name]}")
    versions = committed(spark, root).agg(F.max("version")).first()[0] or 0
    version = claim(spark, f"{root}/_log", versions + 1)
    fs, entry = _fs(spark, f"{root}/_log/{version:012d}.json")
    _, draft = _fs(spark, f"{root}/_log/.{mark}")
    write_text(spark, f"{root}/_log/.{mark}", json.dumps({"version": version, "batch": batch, "tables": made}) + "\n")
    if not fs.rename(draft, entry):
        raise OSError(f"the log of {root} didn't take version {version}")
    return version


def committed(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A store's log up to a version, its end if none is given: one entry for each batch, the first."""
    fs, p = _fs(spark, f"{root}/_log")
    if not (fs.exists(p) and any(f.getPath().getName().endswith(".json") for f in fs.listStatus(p))):
        return spark.createDataFrame([], ENTRY)
    entries = spark.read.schema(ENTRY).option("mode", "FAILFAST").json(f"{root}/_log/*.json")
    entries = entries if version is None else entries.where(F.col("version") <= version)
    return entries.groupBy("batch").agg(F.min_by(F.struct("version", "tables"), "version").alias("e")).select("e.version", "batch", "e.tables")


def read(spark: SparkSession, root: str, name: str, schema: str, version: int | None = None, by: str | None = None) -> DataFrame:
    """A table's rows as of a version (now, if none is given): the files of its commits, which no writer changes any more. by is the
    column that the writers gave folders to; a filter or a join on it leaves other folders unread."""
    found = committed(spark, root, version).select(F.col("tables")[name].alias("path")).where("path is not null")
    paths = sorted(f"{root}/{r['path']}" for r in found.collect())  # a name a commit
    if not paths:
        return spark.createDataFrame([], schema)
    columns = [c.name for c in StructType.fromDDL(schema).fields]
    return spark.read.schema(f"{schema}, commit string").option("basePath", f"{root}/{name}").parquet(*paths).select(*columns)


def vacuum(spark: SparkSession, root: str, names: tuple[str, ...], hours: float = 24.0) -> list[str]:
    """Deletes folders of tables that no entry names and that are older than so many hours, which no living writer still fills;
    returns them. Readers of a batch's later, losing entry are as old."""
    kept = {p for r in committed(spark, root).select(F.map_values("tables").alias("p")).collect() for p in r["p"]}
    gone = []
    for name in names:
        fs, p = _fs(spark, f"{root}/{name}")
        for f in fs.listStatus(p) if fs.exists(p) else []:
            own = f"{name}/{f.getPath().getName()}"
            if own not in kept and f.getModificationTime() <= (time.time() - hours * 3600) * 1000:
                fs.delete(f.getPath(), True)
                gone.append(own)
    return gone


def next_run_id(runs: DataFrame) -> int:
    return (runs.agg(F.max("run_id")).first()[0] or 0) + 1


def claim(spark: SparkSession, root: str, first: int) -> int:
    """The first free number from first on; the store's own exclusive creation of a file settles who gets it."""
    n = first
    while True:
        fs, p = _fs(spark, f"{root}/claims/{n}")
        fs.mkdirs(p.getParent())
        if fs.createNewFile(p):
            return n
        n += 1


def save_run(spark: SparkSession, root: str, runs: DataFrame, session_id: str, decisions: DataFrame, prompt_version: str, runner: str) -> int:
    """Appends a completed run, its decisions (with their JSON and true status) and their evidence; returns its id."""
    run = claim(spark, root, next_run_id(runs))
    tagged = decisions.withColumn("run_id", F.lit(run)).withColumn("session_id", F.lit(session_id)).withColumn("status", F.coalesce("status", F.lit("unknown")))
    tagged = tagged.withColumn("raw_analysis_json", F.to_json(F.struct(*decisions.columns)))
    evidence = tagged.select("run_id", "decision_id", F.explode("evidence_message_ids").alias("evidence_id"))
    new = spark.createDataFrame([(run, session_id, prompt_version, runner, "completed")], "run_id int, session_id string, prompt_version string, runner_type string, status string")
    publish({"decisions": tagged, "decision_evidence": evidence, "analysis_runs": new.withColumn("created_at", F.current_timestamp())}, root, f"run-{run}", {"decisions": "run_id", "decision_evidence": "run_id"})
    return run


def fan_out(df: DataFrame, path: str, by: str, text: bool = False, part: str | None = None) -> None:
    """A directory per value of by, all in one job; refuses an existing path. part names a column that deals a value's rows to several
    tasks and isn't written."""
    writer = (df.repartition(by, part).drop(part) if part else df.repartition(by)).write.mode("errorifexists").partitionBy(by)
    writer.text(path) if text else writer.json(path)


def documents(df: DataFrame, path: str, by: str) -> None:
    """A JSON document, one line, for each value of by, named in it; refuses an existing path. Files hold many: of units that grow in number
    with the input, a folder each would take more time to write and list than all else."""
    df.repartition(by).write.mode("errorifexists").json(path)


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """path, size and SHA-256 of files of any size, below the pattern too."""
    return file_hashes(spark, pattern, recursive=True).withColumnRenamed("source_sha256", "sha256")


def with_guidance(guidance: str, prompt: str) -> str:
    return guidance.rstrip() + GUIDANCE_RULE + prompt.lstrip()


def arms(sessions: DataFrame, knowledge: str) -> DataFrame:
    """Two rows per session: one as it is, one with the knowledge text. Sessions that carry signals are refused.

    sessions: session_id, document, has_signals.
    """
    clean = F.when(~F.col("has_signals"), F.col("document")).otherwise(F.raise_error(F.lit("input already carries signals")).cast("string"))
    both = sessions.withColumn("document", clean).withColumn("arm", F.explode(F.array(F.lit("control"), F.lit("knowledge"))))
    return both.withColumn("interpretation_knowledge", F.when(F.col("arm") == "knowledge", F.lit(knowledge))).withColumn("sha256", F.sha2("document", 256))


def provenance(spark: SparkSession, inputs: Mapping[str, str], texts: Mapping[str, str]) -> dict:
    """Names to SHA-256: of each input path's files together, and of each text. The former is a tree's: digests that begin with the same
    three digits are joined in order and hashed, then those (4,096 at most), so that no task has all files' digests."""
    import hashlib

    def of(path: str) -> str:
        joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
        part = F.substring("sha256", 1, 3)
        return manifest(spark, path).groupBy(part.alias("part")).agg(joined("sha256").alias("d")).agg(joined(F.concat_ws(":", "part", "d"))).first()[0]

    return {"inputs": {k: of(p) for k, p in inputs.items()}, "texts": {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}}


def instructions(title: str, units: str, count: int, given: list[str], result: str, check: str) -> str:
    """What a person who runs a bundle is told."""
    lines = [f"# {title}", "", f"This bundle holds {count} independent {units}.", "", f"Give a fresh reader, for each of the {units}, only:", "", *(f"{i}. {x}" for i, x in enumerate(given, 1)), "",
             f"Save the first answer unchanged as `{result}`; do not repeat or repair it. Check it with `{check}`.", "", "Nothing of another unit, of labels or of reports may be shown. An empty answer is a valid one.", ""]
    return "\n".join(lines)


# The report's lines, each with the count or rate that it shows.
REPORT = (("Inventory", "inventory_decision_count", " Decisions"), ("全Cross-section組合せ", "possible_cross_section_pair_count", ""), ("機械抽出した候補ペア", "candidate_pair_count", ""), ("ペア比較削減率", "pair_comparison_reduction_rate", "%"),
          ("AI確認候補クラスタ", "candidate_cluster_count", ""), ("クラスタ内Decision", "clustered_decision_count", ""), ("AI確認対象Decision", "ai_review_decision_count", ""), ("ペアのみの確認対象Decision", "pair_only_review_decision_count", ""),
          ("singleton", "singleton_count", ""), ("AI確認対象Decision削減率", "ai_review_decision_reduction_rate", "%"), ("最大クラスタ", "largest_cluster_size", " Decisions"), ("Evidence欠落", "evidence_missing_count", ""), ("入力ハッシュ不一致", "input_hash_mismatch_count", ""))


def candidate_report(e: Mapping) -> str:
    """Markdown of a candidate evaluation (one row of clusters.evaluation as a mapping; counts that it lacks are 0)."""
    shown = (f"- {name}: {e.get(key) or 0:.2%}" if unit == "%" else f"- {name}: {e.get(key) or 0}{unit}" for name, key, unit in REPORT)
    return "\n".join(["# Cross-section Integration Candidate v1", "", "## 結果", "", *shown, "", "## 解釈", "", "Machine-made candidates only: nothing is merged, judged or scored here.", ""])
