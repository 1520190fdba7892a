"""The line classifier on a stream: it keeps no state, so a stream of log lines gives what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import ADAPTERS, parse

LINES = "session_id string, source_line int, raw_text string, at timestamp"


def classified(lines: DataFrame, adapter: str = "default") -> DataFrame:
    """Adds kind, role and content to a stream (or table) of lines."""
    return ADAPTERS[adapter](parse(lines)).drop("raw")


def kind_counts(lines: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Lines per window and kind, closed when the watermark has passed."""
    return classified(lines).withWatermark("at", late).groupBy(F.window("at", window), "kind").agg(F.count(F.lit(1)).alias("n")).select("window.start", "kind", "n")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of lines as a stream."""
    return spark.readStream.schema(LINES).parquet(path)
