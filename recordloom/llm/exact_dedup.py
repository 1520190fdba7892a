"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACES, Scratch, among, free, lookup, pick

#: Distinct hashes that a bucket holds before it is split, and that a page of a bucket at MAX_DEPTH holds.
CAPACITY = 8192
#: Bits of the hash that the directory may use; bounds it to 65,536 entries of 16 bytes, about 1 MB.
MAX_DEPTH = 16
FIRST_DEPTH = 3


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    made = F.coalesce(text, F.lit(""))
    for c in SPACES:
        made = F.replace(made, F.lit(c), F.lit(""))
    return made


def leaf_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - MAX_DEPTH).cast("int")


def build_directory(scratch: Scratch, keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """keys: one row per distinct hash h. Returns (leaf, bucket, local_depth, pages).

    All buckets start at FIRST_DEPTH bits. Each round splits every overfull bucket by one more bit, which doubles the
    directory where no bucket was that deep before. A bucket that is overfull at MAX_DEPTH has as many pages as it needs, see
    page_of(); all others have one.
    """
    table = keys.groupBy(leaf_of(F.col("h")).alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    table = scratch.store(table.withColumn("depth", F.lit(FIRST_DEPTH)), "directory-0")
    held = F.sum("n").over(W.partitionBy("depth", F.expr(f"shiftright(leaf, {MAX_DEPTH} - depth)")))
    for level in range(FIRST_DEPTH, MAX_DEPTH):
        grown = table.withColumn("over", (held > capacity) & (F.col("depth") == level))
        grown = grown.select("leaf", "n", (F.col("depth") + F.col("over").cast("int")).alias("depth"))
        grown = scratch.store(grown, f"directory-{level}-split")
        if not grown.where(F.col("depth") > level).head(1):
            break
        table = grown
    bucket = F.expr(f"shiftleft(shiftright(leaf, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)")
    return table.select("leaf", bucket.alias("bucket"), F.col("depth").alias("local_depth"), F.greatest(F.lit(1), F.ceil(held / capacity)).cast("int").alias("pages"))


def page_of(h: Column, pages: Column) -> Column:
    """The page of a bucket that a hash belongs to, by the bits that the directory doesn't use."""
    return F.pmod(h.bitwiseAND(F.lit((1 << (64 - MAX_DEPTH)) - 1)), pages).cast("int")


def _owned(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """rows (with h), and the bucket and page that the directory gives for it."""
    d = rows.withColumn("leaf", leaf_of(F.col("h"))).join(F.broadcast(directory.select("leaf", "bucket", "pages")), "leaf")
    return d.withColumn("page", page_of(F.col("h"), F.col("pages"))).drop("leaf", "pages")


RANK = "struct(-n_cp AS a, id IS NULL AS b, id AS c)"


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> None:
    """Writes the index of docs' texts under scratch.

    pages      id, h (hash), tag (SHA-256), n_cp of each row
    directory  see build_directory; broadcast, at most 2**MAX_DEPTH rows
    index      bucket, page, h, link, tag, group_size, keep_id: each bucket's chains, a link per different text of a hash

    Texts of hashes that stand in several rows are combined on the map side, so that one that a third of the rows hold arrives once
    per map task. They are then dealt by bucket and page to the task that owns these, with the counts of all hashes. It chains the
    texts of a hash in the order of their bytes; equal bytes share a link. A link's first row by length and id stays.
    """
    base = pick(docs, id=id_col, text=text_col)
    norm = base.select("id", normalised(F.col("text")).alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_cp")).withColumn("h", F.xxhash64("norm"))
    pages = scratch.store(norm.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("tag"), "n_cp"), "pages")
    heads = scratch.store(pages.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.expr(RANK)).alias("best"), F.min("tag").alias("tag")), "heads")
    directory = scratch.store(build_directory(scratch, heads.select("h"), capacity), "directory")

    texts = among(norm, heads.where("n > 1").select("h"), scratch).groupBy("h", "norm").agg(F.count(F.lit(1)).alias("size"), F.min(F.expr(RANK)).alias("best"))
    texts = texts.select("h", "norm", "size", "best", F.lit(None).cast("long").alias("n"), F.unhex(F.sha2("norm", 256)).alias("tag"))
    counts = heads.select("h", F.lit(None).cast("string").alias("norm"), F.lit(None).cast("long").alias("size"), "best", "n", "tag")
    owned = _owned(texts.unionByName(counts), directory).repartition("bucket", "page")
    key = W.partitionBy("bucket", "page", "h")
    chain = key.orderBy(F.col("norm").asc_nulls_first())
    d = owned.withColumn("rows", F.max("n").over(key)).withColumn("linked", F.sum("size").over(key)).withColumn("link", F.dense_rank().over(chain))
    d = d.withColumn("twin", F.coalesce(F.lag("tag").over(chain) == F.col("tag"), F.lit(False)) & F.lag("norm").over(chain).isNotNull())
    d = d.where("(rows = 1 AND norm IS NULL) OR (rows > 1 AND norm IS NOT NULL)")
    broken = F.raise_error(F.lit("two texts share hash and digest, or rows are missing in a chain")).cast("long")
    size = F.when(F.col("rows") == 1, F.lit(1)).when((F.col("linked") == F.col("rows")) & ~F.col("twin"), F.col("size")).otherwise(broken)
    scratch.store(d.select("bucket", "page", "h", "link", "tag", size.alias("group_size"), F.col("best.c").alias("keep_id")), "index")


def probe(scratch: Scratch) -> DataFrame:
    """id, keep_id, group_size, tag, bucket, page of each row of the pages: its hash leads through the directory to bucket and page,
    there to the hash's chain, and its tag to the link. Links with many rows are broadcast, see lookup(). A row without a link raises."""
    read = lambda name: scratch.spark.read.parquet(scratch.path(name))
    pages = read("pages")
    found = lookup(_owned(pages, read("directory")), read("index"), ["bucket", "page", "h", "tag"], "group_size", max(1, pages.count()))
    size = F.coalesce(F.col("group_size"), F.raise_error(F.lit("a row's text is not in the index")).cast("long"))
    return found.select("id", "keep_id", size.alias("group_size"), "tag", "bucket", "page")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket.

    Rows are equal when their texts are, without ASCII white space. The row with the most code points stays, of these the
    one with the smallest id (null ids last). A null text counts as empty. Rows that repeat an id within a group are all
    marked alike; drop_copies() leaves one of them. An empty table gives no rows; further columns are ignored. Results come
    from probing the index that build_index() writes.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    build_index(docs, scratch, id_col, text_col, capacity)
    found = probe(scratch)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.lower(F.hex("tag")).alias("text_sha256"), "bucket")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, once each."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    name = free(docs, "text_digest")
    marked = docs.withColumn(name, F.sha2(normalised(docs[f"`{text_col}`"]), 256))
    best = marked.join(kept, marked[f"`{id_col}`"].eqNullSafe(kept["_id"]) & (marked[name] == kept["_sha"]), "left_semi")
    return best.dropDuplicates([id_col, name]).drop(name)
