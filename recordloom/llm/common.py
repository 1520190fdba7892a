"""What the training-data operators share: the shared folder, stored tables and joins that stand a hot key."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\f\r"
#: A word is a run of digits, lower-case letters and bytes above 0x7F, once A-Z is lower-cased.
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A key with over 1/HOT_SHARE of the rows counts as hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Rows of a key that no task minds, however few rows the table has.
FEW = 100
#: The map of hashes: bits for each, and the most cells of 32,768 bits (4 KB each, so 16 MB at most are broadcast).
BITS_EACH, CELL, CELLS = 16, 32_768, 4096


def byte_table() -> bytes:
    """For bytes.translate: lower-cases A-Z and turns ASCII bytes outside words into spaces."""
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    low = bytes(range(256)).lower()
    return bytes(low[b] if low[b] in keep else 32 for b in range(256))


class Recent(dict):
    """A table of the values used last, made for keys that it lacks. On reaching size it starts anew, and what is still asked
    for comes back from the generation before."""

    def __init__(self, size: int, make):
        super().__init__()
        self.size, self.make, self.before = size, make, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 48:  # longer ones hardly come again
            if len(self) >= self.size:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def counted(self, df: DataFrame, name: str, **more: Column) -> tuple[DataFrame, dict]:
        """store(), and what the same job saw of the rows: their number as rows, and further aggregates."""
        seen = Observation()
        return self.store(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in more.items())), name), seen.get

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under private names, so that further columns can't clash."""
    return df.select(*(df[f"`{src}`"].alias(new) for new, src in cols.items()))


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, most: int | None = None) -> DataFrame:
    """left LEFT JOIN right on keys (null-free, unique in right), whatever share of left one key holds.

    right[weight] is the key's number of rows in left, total the sum. Keys with over total/HOT_SHARE rows, of which there
    are fewer than HOT_SHARE, are broadcast; for all others the shuffle's largest group is under that share. most: the largest
    weight, if known; where no key is hot or has over FEW rows, a plain join does.
    """
    bar = max(1, total // HOT_SHARE)
    if most is not None and most <= max(FEW, bar):
        names = [c for c in right.columns if c not in keys]
        return left.join(right, keys, "left").select(*left.columns, *names)
    hot = right.where(F.col(weight) > bar).withColumn("_hot", F.lit(True))
    first = left.join(F.broadcast(hot), keys, "left")
    names = [c for c in right.columns if c not in keys]
    done = first.where(F.col("_hot").isNotNull()).drop("_hot")
    rest = first.where(F.col("_hot").isNull()).drop("_hot", *names).join(right.where(F.col(weight) <= bar), keys, "left")
    return done.select(*left.columns, *names).unionByName(rest.select(*left.columns, *names))


def among(rows: DataFrame, again: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of rows (with h) whose hash may be one of again (h), by a map of bits that is broadcast: all whose hash is, and of the
    others one in BITS_EACH at most while the map may grow, so that hardly any text that isn't asked for moves."""
    cells = max(1, min(CELLS, -(-BITS_EACH * again.count() // CELL)))
    place = F.pmod(F.col("h").bitwiseXOR(F.shiftrightunsigned("h", 29)), F.lit(cells * CELL))
    spot = lambda d: d.withColumn("cell", F.expr(f"place div {CELL}").cast("int")).withColumn("at", F.col("place") % CELL).drop("place")
    bits = spot(again.select(place.alias("place"))).groupBy("cell").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits = scratch.store(bits, "repeated")
    found = spot(rows.withColumn("place", place)).join(F.broadcast(bits), "cell")
    byte = F.conv(F.hex(F.substring("bits", F.expr("at div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.where(F.call_function("shiftright", byte, (F.col("at") % 8).cast("int")).bitwiseAND(1) == 1).drop("cell", "at", "bits")


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists: fn takes one dict of lists at a time and gives one, or an iterator of them."""
    fields = StructType.fromDDL(schema).fields
    out_names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        for b in batches:
            made = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            for cols in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], type=t) for n, t in zip(out_names, types)], names=out_names)

    return df.mapInArrow(run, schema)
