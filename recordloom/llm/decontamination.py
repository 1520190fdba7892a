"""Benchmark decontamination by a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_table, pick

#: Words of a window; an item of fewer words is one window.
N = 10
#: Most windows in one broadcast set (at about 250 bytes, 60 MB); more are taken in blocks, a pass each.
BLOCK = 250_000
#: Bytes of text that are scanned at once.
SLICE = 4_000_000
RUNS = "array<struct<first:bigint,number:bigint>>"
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("number", pa.int64())]))
_FOUND = f"n_words bigint, hits {RUNS}, items array<string>"
_P = np.uint64(0x9E3779B97F4A7C15)
_TABLE = byte_table()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class GramSet:
    """Windows of benchmark items, by length: a bit filter and sorted hashes to find candidates, exact windows to verify them."""

    def __init__(self):
        self.vocab: dict[bytes, int] = {}
        self.items: list = []
        self.windows: dict[int, dict[bytes, list[int]]] = {}
        self.size = 0

    def add(self, item_id, words: list[bytes], n: int) -> None:
        ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32)
        length = min(n, len(words))
        self.items.append(item_id)
        grams = self.windows.setdefault(length, {})
        for i in range(len(words) - length + 1):
            held = grams.setdefault(ids[i : i + length].tobytes(), [])
            if not held or held[-1] != len(self.items) - 1:
                held.append(len(self.items) - 1)
                self.size += 1

    def freeze(self) -> GramSet:
        self.hashes, self.filters = {}, {}
        for length, grams in self.windows.items():
            rows = np.frombuffer(b"".join(grams), np.int32).reshape(-1, length)
            h = np.unique(rolling(rows.ravel(), length)[::length])
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.hashes[length], self.filters[length] = h, bits
        return self


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of that length."""
    a, m = ids.astype(np.uint64), len(ids) - length + 1
    h = np.zeros(max(m, 0), np.uint64)
    for j in range(length if m > 0 else 0):
        h = h * _P + a[j : j + m] * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def scan(texts: list[bytes | None], grams: GramSet) -> list[tuple[int, np.ndarray, list]]:
    """For each text: words, hit words' positions (ascending), ids of items with occurring windows."""
    get, found = grams.vocab.get, []
    docs = [words_of(t) for t in texts]
    counts = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    ids = np.zeros(int(starts[-1]), np.int32)
    for d, s, n in zip(docs, starts, counts):
        ids[s : s + n] = np.fromiter(map(get, d, repeat(0)), np.int32, n)
    del docs
    cover = np.zeros(len(ids) + 1, np.int32)
    items: dict[int, set[int]] = {}
    for length, held in grams.windows.items():
        h = rolling(ids, length)
        at = np.flatnonzero(grams.filters[length][(h >> np.uint64(44)).astype(np.int64)])
        at = at[np.isin(h[at], grams.hashes[length], assume_unique=False)] if len(at) else at
        for i in at.tolist():
            if owners := held.get(ids[i : i + length].tobytes()):
                cover[i] += 1
                cover[i + length] -= 1
                items.setdefault(int(np.searchsorted(starts, i, "right")) - 1, set()).update(owners)
    hit = np.cumsum(cover[:-1]) > 0
    for k, (s, n) in enumerate(zip(starts, counts)):
        found.append((int(n), np.flatnonzero(hit[s : s + n]) if k in items else np.zeros(0, np.int64), [grams.items[i] for i in items.get(k, ())]))
    return found


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, n: int, block: int, nameless: bool = False) -> Iterator[GramSet]:
    """Streams the benchmark to the driver, a partition at a time, in sets of a bounded number of windows; items with a null id
    only if nameless."""
    now = GramSet()
    items = pick(benchmark, id=id_col, text=text_col)
    for row in (items if nameless else items.where("id is not null")).select("id", F.col("text").cast("binary").alias("text")).distinct().toLocalIterator():
        words = words_of(row["text"] and bytes(row["text"]))
        for i in range(0, max(1, len(words) - n + 1) if words else 0, block):
            now.add(row["id"], words[i : i + block + n - 1], n)
            if now.size >= block:
                yield now.freeze()
                now = GramSet()
    yield now.freeze()


def _first_two(blocks: Iterator[GramSet]) -> tuple[GramSet, Iterator[GramSet] | None]:
    """The first block, and all if there are more."""
    first = next(blocks)
    second = next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes."""
    i, held = 0, 0
    for j, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        held += n
        if held >= SLICE:
            yield i, j + 1
            i, held = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def _leaks(grams):
    """mapInArrow over (key, text): key, n_words, hits, items of one block."""
    def run(batches):
        for b in batches:
            for i, j in _slices(b.column(1)):
                found = scan(b.column(1).slice(i, j - i).to_pylist(), grams.value)
                runs = [np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else [] for _, at, _ in found]
                cols = [[n for n, _, _ in found], [[{"first": int(r[0]), "number": len(r)} for r in some] for some in runs], [sorted({str(x) for x in ids}) for _, _, ids in found]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), _RUNS, pa.list_(pa.string()))))], names=["key", "n_words", "hits", "items"])

    return run


def _joined(runs: Column) -> Column:
    """Runs (first, number), overlapping or touching ones made one."""
    def step(done, r):
        last, end = F.element_at(done, -1), r["first"] + r["number"]
        fits = (F.size(done) > 0) & (r["first"] <= F.element_at(done, -1)["first"] + F.element_at(done, -1)["number"])
        wider = F.struct(last["first"].alias("first"), (F.greatest(end, last["first"] + last["number"]) - last["first"]).alias("number"))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUNS), step)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", n: int = N, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, n_words, n_hit, hits (runs of hit words: first, number), items (ids as strings, sorted),
    and the columns in keep.

    Words are runs of digits, letters and non-ASCII characters after A-Z is lower-cased. A word is hit inside any occurrence
    of a window of n consecutive item words; an item of fewer words, but not none, is one window. Candidates from the hash
    filter are compared word for word. Null or empty texts have no words; items with a null id are left out; items that repeat
    an id count once; rows that repeat an id each give a row; empty tables give no rows or no hits; texts of any length are
    scanned whole.

    One block of windows is broadcast and scanned in one pass. A larger benchmark takes a pass over the stored documents for each
    block, so that no worker holds more than one, and what the passes hit is united by row.
    """
    spark = docs.sparkSession
    first, more = _first_two(blocks_of(benchmark, item_col, item_text_col, n, block))
    base = docs.select(F.struct(docs[f"`{id_col}`"].alias("id"), *(docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep))).alias("key"), docs[f"`{text_col}`"].cast("binary").alias("text"))
    kind = base.schema["key"].dataType.simpleString()
    if more is None:
        made = base.mapInArrow(_leaks(spark.sparkContext.broadcast(first)), f"key {kind}, {_FOUND}")
    else:
        scratch = Scratch(spark, "leaks")
        rows = scratch.store(base.withColumn("row", F.monotonically_increasing_id()), "documents")
        for k, grams in enumerate(more):
            held = spark.sparkContext.broadcast(grams)
            found = rows.select(F.col("row").alias("key"), "text").mapInArrow(_leaks(held), f"key long, {_FOUND}")
            scratch.store(found if k == 0 else found.where(F.size("hits") > 0), f"block/k={k}")
            held.unpersist()
        parts = spark.read.schema(f"key long, {_FOUND}").parquet(scratch.path("block")).drop("k")
        united = parts.groupBy("key").agg(F.max("n_words").alias("n_words"), _joined(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        made = rows.select("key", "row").join(united.withColumnRenamed("key", "row"), "row").select("key", "n_words", "hits", "items")
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r["number"])
    return made.select(F.col("key.id").alias(id_col), "n_words", hit.alias("n_hit"), "hits", "items", *(F.col(f"key.k{i}").alias(c) for i, c in enumerate(keep)))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, block: int = BLOCK, nameless: bool = False) -> DataFrame:
    """The documents without any hit word, with all their columns, unchanged; repeated rows stay repeated, null and empty texts
    stay, and an empty table gives an empty one. Items with a null id count if nameless. Each further block of windows takes a
    pass over what the one before left."""
    spark = docs.sparkSession
    place = docs.columns.index(text_col)

    def without(grams):
        def run(batches):
            for b in batches:
                rows = b.column(place).cast(pa.binary())
                keep = [not f[2] for i, j in _slices(rows) for f in scan(rows.slice(i, j - i).to_pylist(), grams.value)]
                yield b.filter(pa.array(keep, pa.bool_()))

        return run

    first, more = _first_two(blocks_of(benchmark, "item_id", "text", n, block, nameless))
    if more is None:
        return docs.mapInArrow(without(spark.sparkContext.broadcast(first)), docs.schema)
    scratch, left = Scratch(spark, "unleaked"), docs
    for k, grams in enumerate(more):
        held = spark.sparkContext.broadcast(grams)
        left = scratch.store(left.mapInArrow(without(held), docs.schema), f"block-{k}")
        held.unpersist()
        if k:
            scratch.drop(f"block-{k - 1}")
    return left


def cut_spans(text: bytes | None, runs: list[tuple[int, int]]) -> bytes | None:
    """The text without the bytes from the first to the last word of each run (first word's number, words)."""
    if not runs or text is None:
        return text
    low = text.translate(_TABLE)
    solid = np.concatenate([[0], (np.frombuffer(low, np.uint8) != 32).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(solid))
    out, at = [], 0
    for first, number in runs:
        out.append(text[at : edges[2 * first]])
        at = int(edges[2 * (first + number - 1) + 1])
    return b"".join([*out, text[at:]])


def digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
