"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, pick

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST = 3
#: A class of sizes that is shared by many rows is numbered in 256 buckets, by two hex digits of the id's digest.
BUCKETS = 256
SIZE_RE = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SIZE_RE)).cast("long")


def size_class(size: Column) -> Column:
    """Classes of 1/16 octave, by the binary digits' number and the first five of them; sizes under 32 are their own."""
    digits = F.length(F.bin(size))
    return F.when(digits <= 5, size).otherwise(16 * digits + F.call_function("shiftright", size, (digits - 5).cast("int"))).cast("int")


def before(df: DataFrame, order: list, sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """Adds, for each of sums, its sum over all rows that come before in an order without ties. Rows are dealt out by ranges of the order
    and summed within each; what the ranges before hold, a row for each range, is broadcast."""
    d = df.select("*", *(c.alias(f"_{k}") for k, c in sums.items())).repartitionByRange(*order)
    d = scratch.store(d.withColumn("_range", F.spark_partition_id()), name)
    whole = d.groupBy("_range").agg(*(F.sum(f"_{k}").alias(f"_all_{k}") for k in sums))
    past = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select("_range", *(F.coalesce(F.sum(f"_all_{k}").over(past), F.lit(0)).alias(f"_past_{k}") for k in sums))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.join(F.broadcast(whole), "_range")
    return d.select(*df.columns, *((F.col(f"_past_{k}") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0))).alias(k) for k in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: (source, source_size), a row per source. Adds weight, target, and the rate of expected copies.

    Water filling: in order of cap / weight, a source is capped while its cap is no more than its share by weight of what
    the sources before left; from the first that isn't, all share by weight. Sources are numbered, and caps summed, by ranges
    of the order, so that no task holds all sources; only totals come to the driver. An empty table gives an empty one.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    one = F.lit(1).cast("long")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = before(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {"_rank": one}, scratch, "ranked")
    ranked = ranked.withColumn("weight", w.cast("long")).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("_ratio", F.col("cap") / F.col("weight"))
    d = before(ranked, [F.col("_ratio"), F.col("_rank")], {"caps": F.col("cap"), "weights": F.col("weight")}, scratch, "ordered")
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    size, weight = total[0] or 0, total[1] or 0
    d = scratch.store(d.withColumn("left", F.lit(size) - F.col("caps")).withColumn("weight_left", F.lit(weight) - F.col("weights")), "filled")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    d = d.withColumn("capped", wide("cap") * F.col("weight_left").cast("decimal(12,0)") <= wide("left") * F.col("weight").cast("decimal(12,0)"))
    first = d.where(~F.col("capped")).agg(F.min(F.struct("_ratio", "_rank", "left", "weight_left"))).first()[0]
    share = F.lit(float(first["left"])) * F.col("weight").cast("double") / F.lit(float(first["weight_left"])) if first else F.lit(None).cast("double")
    d = d.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return d.select("source", "source_size", "weight", "target", rate.alias("rate"))


def offset_of(source: Column, seed: int) -> Column:
    """A source's random offset in [0, 1): 16 bits of a digest, so that adding it to a position is exact."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("double") / F.lit(65536.0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST, seed: int = 42) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies, taken (= copies * size).

    A document's expected copies are its source's target / size. Documents of a source are laid end to end in an order
    that runs through the sizes (class of size, bucket of the id's hash, size, id); the position of each is its number in that
    order times the rate, shifted by the source's offset, and it is emitted once per integer boundary crossed. As the order
    runs through the sizes, each source's taken words stay within about its largest document of its target.

    The numbering needs no task that holds a source: counts per (source, class), at most 16 * 40 for a source, and per bucket
    within a class are summed up to starting numbers, and rows are numbered within a bucket. A null text has size 0; a null
    source is a source of its own, the last; null ids come first in their bucket. Documents that repeat an id each count.
    An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = pick(docs, id=id_col, text=text_col, source=source_col)
    rows = scratch.store(base.select("id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rows = rows.withColumn("cls", size_class(F.col("size")))
    rows = rows.withColumn("bucket", F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 2))
    cells = scratch.store(rows.groupBy("source", "cls", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "cells")
    plan = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    running = lambda by, *order: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = cells.groupBy("source", "cls").agg(F.sum("n").alias("n")).select("source", "cls", running(["source"], "cls").alias("first"))
    inside = cells.select("source", "cls", "bucket", running(["source", "cls"], "bucket").alias("inside"))
    i, c = inside.alias("i"), classes.alias("c")
    starts = i.join(c, F.col("i.source").eqNullSafe(F.col("c.source")) & (F.col("i.cls") == F.col("c.cls"))).select("i.source", "i.cls", "bucket", (F.col("first") + F.col("inside")).alias("before"))
    s, p = starts.alias("s"), plan.alias("p")
    starts = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        "s.source", "cls", "bucket", "before", "source_size", "target", "rate", offset_of(F.col("s.source"), seed).alias("u"))
    place = F.row_number().over(W.partitionBy("source", "cls", "bucket").orderBy("size", "id"))
    r, s = rows.withColumn("place", place).alias("r"), starts.alias("s")
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.cls") == F.col("s.cls")) & (F.col("r.bucket") == F.col("s.bucket"))
    d = r.join(s, same).select("id", "size", "r.source", "source_size", "target", "rate", "u", (F.col("before") + F.col("place")).cast("double").alias("k"))
    crossed = F.floor(F.col("k") * F.col("rate") + F.col("u")) - F.floor((F.col("k") - 1) * F.col("rate") + F.col("u"))
    d = d.withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
    return d.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
