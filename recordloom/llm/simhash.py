"""SimHash near-dedup by a self-join of a binary trie of fingerprints."""

from __future__ import annotations

from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, free, lookup, map_batches, pick

#: Words of a shingle, seed of its hash, and differing bits at which fingerprints still link.
WORDS, SEED, BUDGET = 3, 42, 2
BITS = 64
#: Fingerprints under one trie root that a task joins; larger roots take the exact way of flipped bits.
ROOT = 16_384
#: Node pairs that a task holds at once.
FRONTIER = 100_000


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Unsigned fingerprint of a text; zero for none."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = map(slice, starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.dtype(">u8"), len(found) - words + 1)
    ones, at = np.zeros(BITS, np.int64), 0
    while at < len(h):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
        at += 65_536
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def trie_links(keys: np.ndarray, roots: np.ndarray, budget: int, frontier: int = FRONTIER):
    """Yields index pairs (i, j) of keys that differ in 1 to budget bits, within each root.

    keys: unsigned, ascending within a root; roots: starts of the roots and the end. A node is a range of keys that share a
    prefix. Pairs of nodes go down a bit at a time; one bit apart adds to a pair's differing bits, and a pair over budget is
    pruned with all below it. Pairs of single keys are decided at once. Pairs wait on a stack, so few are held.
    """
    sums = np.zeros((BITS, len(keys) + 1), np.int32)
    for b in range(BITS):
        sums[b, 1:] = np.cumsum((keys >> np.uint64(BITS - 1 - b)) & np.uint64(1))
    a, z = roots[:-1], roots[1:]
    stack = [(0, a, z, a, z, np.zeros(len(a), np.int8))]
    while stack:
        b, lo, hi, lo2, hi2, diff = stack.pop()
        same = lo == lo2
        keep = (hi > lo) & (hi2 > lo2) & ~(same & (hi - lo == 1)) & (diff <= budget)
        lo, hi, lo2, hi2, diff, same = (x[keep] for x in (lo, hi, lo2, hi2, diff, same))
        leaf = (hi - lo == 1) & (hi2 - lo2 == 1)
        if leaf.any():
            i, j = lo[leaf], lo2[leaf]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            if near.any():
                yield i[near], j[near]
            lo, hi, lo2, hi2, diff, same = (x[~leaf] for x in (lo, hi, lo2, hi2, diff, same))
        if not len(lo) or b == BITS:
            continue
        if len(lo) > frontier:
            half = len(lo) // 2
            stack += [(b, *(x[s] for x in (lo, hi, lo2, hi2, diff))) for s in (slice(half), slice(half, None))]
            continue
        mid, mid2 = (h - (sums[b, h] - sums[b, low]) for low, h in ((lo, hi), (lo2, hi2)))
        o = ~same
        stack.append((b + 1, *(np.concatenate(x) for x in (
            (lo, mid, lo, mid[o]), (mid, hi, mid, hi[o]), (lo2, mid2, mid2, lo2[o]), (mid2, hi2, hi2, mid2[o]), (diff, diff, diff + 1, diff[o] + 1)))))


def merged(n: int, pairs) -> np.ndarray:
    """Smallest index that each of n indices reaches over the pairs."""
    up = np.arange(n)

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    return np.array([top(i) for i in range(n)], np.int64)


def _masks(budget: int) -> list[int]:
    """budget + 1 blocks of bits: two fingerprints within budget agree on one of them."""
    cuts = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(budget + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _root_links(budget: int):
    """mapInArrow over (mask, val, fp), sorted: per root, an edge from each fingerprint to the smallest one it reaches."""
    def run(batches):
        held, rows = [], 0

        def solve(m: np.ndarray, v: np.ndarray, f: np.ndarray):
            roots = np.concatenate([[0], np.flatnonzero((np.diff(m) != 0) | (np.diff(v) != 0)) + 1, [len(f)]])
            least = merged(len(f), trie_links(f.view(np.uint64), roots, budget))
            odd = np.flatnonzero(least != np.arange(len(f)))
            return pa.RecordBatch.from_arrays([pa.array(f[odd]), pa.array(f[least[odd]])], names=["a", "b"])

        for b in batches:
            held.append([b.column(i).to_numpy() for i in range(3)])
            rows += b.num_rows
            if rows >= 2 * ROOT:
                m, v, f = (np.concatenate(x) for x in zip(*held))
                end = np.flatnonzero((np.diff(m) != 0) | (np.diff(v) != 0))
                cut = int(end[-1]) + 1 if len(end) else 0
                if cut:
                    yield solve(m[:cut], v[:cut], f[:cut])
                held, rows = [[m[cut:], v[cut:], f[cut:]]], len(f) - cut
        if rows:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return run


def link(prints: DataFrame, scratch: Scratch, budget: int = BUDGET, root: int = ROOT) -> DataFrame:
    """prints: distinct fingerprints (fp long). Edges (a, b), enough to connect all that links connect.

    The trie is cut into roots: fingerprints that agree on one of budget + 1 blocks of bits. Roots of up to root members are
    joined by trie_links. Larger ones, exactly too: fingerprints within two bits share a string that is one of them or one
    flipped bit away from each, so each member emits its strings with one free bit flipped, and at most 64 + 1 meet in one
    (for a budget other than 2, such roots are joined by the trie whatever their size).
    """
    masks = [signed(m) for m in _masks(budget)]
    spread = prints.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
    sizes = spread.groupBy("mask", "val").agg(F.count(F.lit(1)).alias("n"))
    seen = Observation()
    sizes = scratch.store(sizes.observe(seen, F.sum("n").alias("total"), F.max("n").alias("most")).where("n > 1"), "roots")
    total, most = (seen.get[k] or 0 for k in ("total", "most"))
    rows = lookup(spread, sizes, ["mask", "val"], "n", total, most).where("n > 1")
    small = rows if budget != 2 else rows.where(F.col("n") <= root)
    dealt = small.select("mask", "val", "fp").repartition("mask", "val").sortWithinPartitions("mask", "val", F.expr("fp < 0"), "fp")
    edges = dealt.mapInArrow(_root_links(budget), "a long, b long")
    if budget == 2 and most > root:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)) for b in range(BITS)])
        free = F.filter(flips, lambda x: x.bitwiseAND(F.col("mask")) == 0)
        big = rows.where(F.col("n") > root).select("fp", "mask", F.explode(free).alias("flip")).select("fp", "mask", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
        met = big.groupBy("mask", "key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        edges = edges.unionByName(met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b"))
    return edges.distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): each node of edges (a, b) with the smallest node it is connected to, by large-star and small-star rounds.

    A round begins with each node's smaller and larger neighbours: once no node has two smaller ones, or one and larger ones too,
    all edges lead to roots. The same counts bound what either star joins on one key.
    """
    below, above = F.count(F.when(F.col("b") < F.col("a"), 1)), F.count(F.when(F.col("b") > F.col("a"), 1))
    bad = F.count(F.when((F.col("below") > 1) | (F.col("below") == 1) & (F.col("above") > 0), 1))
    now, seen = scratch.counted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges-0")
    for k in count(1):  # ends: a round that finds such a node lowers an end
        if not (total := seen["rows"]):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), below.alias("below"), above.alias("above"))
        ends, of = scratch.counted(ends, f"ends-{k}", bad=bad, below=F.max("below"), above=F.max("above"))
        if not of["bad"]:
            scratch.drop(f"ends-{k}")
            break
        large = lookup(both.where("b > a"), ends.where("above > 0").select("a", "m", "above"), ["a"], "above", total, of["above"])
        down = scratch.store(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"large-{k}")
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lookup(down, least, ["a"], "n", total, of["below"])
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now, seen = scratch.counted(small.where("a <> b").distinct(), f"edges-{k}")
        scratch.drop(f"large-{k}", f"ends-{k}", f"edges-{k - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _assign(docs: DataFrame, id_col: str, text_col: str, words: int, budget: int) -> DataFrame:
    """A row per document: id, key (hash of the text, for rows that repeat an id), fp, head (of its component: its smallest
    (id, key), null ids last)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    kind = docs.schema[id_col].dataType.simpleString()
    base = pick(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    marked = map_batches(base, lambda c: {"id": c["id"], "key": c["key"], "fp": [signed(fingerprint(t, words)) for t in c["text"]]}, f"id {kind}, key long, fp long")
    marked = scratch.store(marked, "fingerprints")
    head = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key"))
    classes = scratch.store(marked.groupBy("fp").agg(head.alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    roots = components(scratch.store(link(classes.select("fp"), scratch, budget), "links"), scratch)
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = scratch.store(joined, "joined")
    own = joined.groupBy("root").agg(F.min("least").alias("head"), F.count(F.lit(1)).alias("k"))
    named = lookup(joined, own, ["root"], "k", max(1, joined.count())).select("fp", "n", "head")
    return lookup(marked, scratch.store(named, "components"), ["fp"], "n", max(1, marked.count()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Texts are lower-cased in A-Z and cut at ASCII white space; a text of fewer words than a shingle is one shingle, an empty
    or null one has fingerprint zero and is linked like any other. Equal fingerprints form a class, whatever its size, which
    is joined once; rows that repeat an id each give a row. Null ids are never a component's id unless all its ids are null.
    An empty table gives no rows; further columns are ignored.
    """
    found = _assign(docs, id_col, text_col, words, budget)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("head.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id (of rows that repeat the id, one)."""
    found = _assign(docs, id_col, text_col, words, budget)
    kept = found.where(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))).select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    name = free(docs, "text_hash")
    d = docs.withColumn(name, F.xxhash64(docs[f"`{text_col}`"]))
    return d.join(kept, d[f"`{id_col}`"].eqNullSafe(kept["_id"]) & (d[name] == kept["_key"]), "left_semi").dropDuplicates([id_col, name]).drop(name)
