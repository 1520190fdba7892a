"""Near-copy removal by the exact Jaccard similarity of word shingles; candidates are what operator 9 links, and
what meets in bands of minimal hashes."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, HOT_SHARE, Scratch, among, free, lookup, map_batches, pick
from .simhash import SEED, components, fingerprint, link, signed

#: Words of a shingle, and the similarity from which documents are near copies, as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Bands of minimal hashes, and hashes of a band: a pair at 0.8 misses all bands with a chance of 3 in 100,000.
BANDS, ROWS = 20, 4
_R = np.random.Generator(np.random.PCG64(SEED))
_XOR = _R.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_MUL = _R.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
#: Shingles that are hashed at once.
SLICE = 4096
#: Members of a band that a unit of work holds on either side.
BLOCK = 512


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending. A text of fewer words is one shingle, an empty or null one has none."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    cuts = map(slice, starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, n))


def band_keys(h: np.ndarray) -> list[int]:
    """A signed key per band of a set of hashes; none for the empty set."""
    if not len(h):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(h), SLICE):
        x = (h[i : i + SLICE] ^ _XOR) * _MUL
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [signed(xxhash.xxh64_intdigest(rows[k].tobytes(), k)) for k in range(BANDS)]


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets, as bytes of ascending hashes, reach the similarity."""
    x, y = len(a) // 8, len(b) // 8
    up, down = LEAST
    if down * min(x, y) < up * max(x, y):
        return False
    both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
    return down * both >= up * (x + y - both)


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of classes that are near copies. sets: cls, hashes."""
    pairs, seen = scratch.counted(pairs, "pairs")
    for side in ("a", "b"):
        own = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("w")).join(sets.select(F.col("cls").alias(side), F.col("hashes").alias(f"{side}_set")), side)
        own, of = scratch.counted(own, f"sets-{side}", most=F.max("w"))
        pairs = lookup(pairs, own, [side], "w", seen["rows"], of["most"] or 0).drop("w")

    def run(batches):
        for b in batches:
            ok = [similar(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return scratch.store(pairs.select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long"), "edges")


def _linked(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of classes that operator 9 connects: those of each component of fingerprints within two bits, with its first. marked:
    cls, fp, bands; the empty set has no bands and is left out."""
    prints = scratch.store(marked.where(F.size("bands") > 0).select("cls", "fp").distinct(), "prints")
    own = Scratch(scratch.spark, "near-links")
    roots = components(own.store(link(prints.select("fp").distinct(), own), "links"), own).withColumnRenamed("node", "fp")
    named, seen = scratch.counted(prints.join(roots, "fp", "left").select("cls", F.coalesce("root", "fp").alias("root")).distinct(), "prints-named")
    firsts = named.groupBy("root").agg(F.min("cls").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    firsts, of = scratch.counted(firsts, "firsts", most=F.max("k"))
    return lookup(named, firsts, ["root"], "k", seen["rows"], of["most"] or 0).where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b"))


def _members(spread: DataFrame, groups: DataFrame, total: int, most: int) -> DataFrame:
    """spread JOIN groups on band, as lookup() does it, but most rows have no group: those of hot bands, fewer than HOT_SHARE, are
    told by their names, so that no row goes through a join that doesn't keep it."""
    bar = max(1, total // HOT_SHARE)
    if most <= max(FEW, bar):
        return spread.join(groups, "band").select("cls", "band", "n")
    hot = [r["band"] for r in groups.where(F.col("n") > bar).select("band").collect()]
    done = spread.where(F.col("band").isin(hot)).join(F.broadcast(groups.where(F.col("n") > bar)), "band")
    rest = spread.where(~F.col("band").isin(hot)).join(groups.where(F.col("n") <= bar), "band")
    return done.unionByName(rest).select("cls", "band", "n")


def between(odd: list[tuple], all_: list[tuple]) -> list[tuple[int, int]]:
    """Rows are (class, root, hashes). Edges between roots: from each odd row's to that of each near copy with another."""
    sizes = np.array([len(x[2]) // 8 for x in all_], np.int64)
    roots = np.array([x[1] for x in all_], np.int64)
    known, code = np.unique(np.frombuffer(b"".join(x[2] for x in all_), np.uint64), return_inverse=True)
    begins, out = np.concatenate([[0], np.cumsum(sizes)[:-1]]), set()
    up, down = LEAST
    for _, root, hashes in odd:
        h = np.frombuffer(hashes, np.uint64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        mark = np.zeros(len(known), np.int64)
        mark[at[known[at] == h]] = 1
        both = np.add.reduceat(mark[code], begins)
        near = np.flatnonzero((down * both >= up * (sizes + len(h) - both)) & (roots != root))
        out.update((root, r) for r in np.unique(roots[near]).tolist())
    return sorted(out)


def _rest(apart: DataFrame, sets: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Edges between the components that a band still has, as pairs of their roots. apart: band, cls, root, and of its band n, main (the root of most
    members) and odd (members with another root). Odd members meet all members in blocks of either, so that no task's work
    grows with a band."""
    place = F.xxhash64("cls")
    sb, mb = F.ceil(F.col("odd") / block).cast("int"), F.ceil(F.col("n") / block).cast("int")
    all_ = apart.select("band", "cls", "root", F.lit(False).alias("is_odd"), F.pmod(place, mb).cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), sb - 1)).alias("sb"))
    odd = apart.where("root <> main").select("band", "cls", "root", F.lit(True).alias("is_odd"), F.explode(F.sequence(F.lit(0), mb - 1)).alias("mb"), F.pmod(place, sb).cast("int").alias("sb"))
    dealt = all_.unionByName(odd).join(sets, "cls").select("band", "mb", "sb", "is_odd", "cls", "root", "hashes")
    dealt = dealt.repartition("band", "mb", "sb").sortWithinPartitions("band", "mb", "sb")

    def run(batches):
        held, unit = ([], []), None

        def solve():
            edges = between(held[1], held[0]) if held[0] and held[1] else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for band, m, s, is_odd, *row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if unit != (band, m, s):
                    if unit is not None:
                        yield solve()
                    held, unit = ([], []), (band, m, s)
                held[is_odd].append(row)
        if unit is not None:
            yield solve()

    return scratch.store(dealt.mapInArrow(run, "a long, b long").distinct(), "rest")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One document of each group of near copies, with all its columns: that of the smallest id, null ids last (of rows that
    repeat the id, one). Null and empty texts have no shingle: they are equal, one class of which one stays. An empty table gives an
    empty one.

    Texts are lower-cased in A-Z and cut at ASCII white space. Near copies share four fifths of the shingles that either has; a
    group is all that is connected. Equal sets of shingles form a class, whatever its size, which is joined once. Classes that
    operator 9 connects by fingerprints of these shingles, or that meet in a band, are candidates, and each candidate pair that isn't connected yet is compared set by set: first all with the
    class of the band that meets most others, so that a band of copies of one text costs a comparison a class, then what that
    left apart.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    kind = docs.schema[id_col].dataType.simpleString()
    base = pick(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))

    def scan(c: dict) -> dict:
        out = {"id": c["id"], "key": c["key"], "cls": [], "fp": [signed(fingerprint(t, words)) for t in c["text"]], "bands": []}
        for t in c["text"]:
            h = shingles(t, words)
            out["cls"].append(signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)))
            out["bands"].append(band_keys(h))
        return out

    marked = scratch.store(map_batches(base, scan, f"id {kind}, key long, cls long, fp long, bands array<long>"), "shingles")
    each = marked.groupBy("cls", "id", "key").agg(F.count(F.lit(1)).alias("n"))
    classes = scratch.store(each.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key", "n")).alias("least")), "classes")
    spread, seen = scratch.counted(marked.select("cls", F.explode("bands").alias("band")).distinct(), "bands")
    groups = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups, of = scratch.counted(groups, "groups", most=F.max("n"))
    most = of["most"] or 0
    met, seen = scratch.counted(_members(spread, groups, seen["rows"], most), "met")
    rows = seen["rows"]
    weighed = met.join(met.groupBy("cls").agg(F.sum("n").alias("w")), "cls")
    pivots = weighed.groupBy("band").agg(F.max(F.struct("w", "cls")).alias("top"), F.count(F.lit(1)).alias("k")).select("band", F.col("top.cls").alias("pivot"), "k")
    stars = lookup(met, scratch.store(pivots, "pivots"), ["band"], "k", rows, most).where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
    linked = scratch.store(_linked(marked, scratch), "linked")
    stars = linked.unionByName(stars).distinct()
    scratch.drop("bands", "prints", "prints-named")

    named = met.select("cls").unionByName(linked.select(F.explode(F.array("a", "b")).alias("cls"))).distinct()
    wanted = scratch.store(classes.join(named, "cls").select("cls", F.col("least.id").alias("_id"), F.col("least.key").alias("_key")), "wanted")
    some = among(base.withColumnRenamed("key", "h"), wanted.select(F.col("_key").alias("h")), scratch)
    texts = some.join(wanted, (some["h"] == wanted["_key"]) & some["id"].eqNullSafe(wanted["_id"])).select("cls", "text")
    sets = map_batches(texts, lambda c: {"cls": c["cls"], "hashes": [shingles(t, words).tobytes() for t in c["text"]]}, "cls long, hashes binary")
    sets = scratch.store(sets.dropDuplicates(["cls"]), "sets")

    edges = _verified(stars, sets, scratch)
    roots = components(edges, scratch).withColumnRenamed("node", "cls")
    named = scratch.store(met.select("band", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "named")
    parts = named.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("most"))
    parts = parts.where("n > most.c").select("band", "n", F.col("most.root").alias("main"), (F.col("n") - F.col("most.c")).alias("odd"))
    parts, seen = scratch.counted(parts, "parts")
    own = classes.join(roots, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("least").alias("least"))
    if seen["rows"]:
        apart = lookup(named, parts, ["band"], "n", rows, most).where("n is not null")
        tops = components(_rest(apart, sets, scratch, block), Scratch(scratch.spark, "near-roots"))
        own = own.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").groupBy(F.coalesce("top", "root").alias("root")).agg(F.min("least").alias("least"))
    kept = own.select(F.col("least.id").alias("_id"), F.col("least.key").alias("_key"), (F.col("least.n") > 1).alias("_many"))
    kept, seen = scratch.counted(kept, "kept", many=F.count_if("_many"))
    name = free(docs, "text_hash")
    d = docs.withColumn(name, F.xxhash64(docs[f"`{text_col}`"]))
    rows = lambda k: d.join(k, d[f"`{id_col}`"].eqNullSafe(k["_id"]) & (d[name] == k["_key"]), "left_semi")
    found = rows(kept.where("NOT _many"))
    if seen["many"]:
        found = found.union(rows(kept.where("_many")).dropDuplicates([id_col, name]))
    return found.drop(name)
