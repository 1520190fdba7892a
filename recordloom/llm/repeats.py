"""Removal of repeated passages by suffix order and longest-previous-factor arrays.

Scan: every window of LENGTH bytes belongs to the smallest hash of GRAM bytes inside it (its mark), so equal windows have
equal marks wherever they are. Neighbouring windows of one mark form a segment. Deal: segments meet by mark. Segments that are
equal as a whole are settled; a mark with one segment only has no equal windows. Sort: what is left, the ends of shared
passages, is laid out by mark and put in suffix order, where equal windows stand side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import HOT_SHARE, Scratch, lookup, pick

LENGTH, GRAM = 200, 40
#: Most windows of a segment; longer ones (texts with a short period) are cut.
RUN = 4096
#: Bytes that are scanned, and that are put in suffix order, at once.
BLOCK, CHUNK = 1 << 20, 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Scale:
    """Powers of the hash's base and of its inverse, kept for the longest block so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_P, n), _powers(_INV, n)
        return cls.up, cls.down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _slide(a: np.ndarray, width: int, least) -> np.ndarray:
    """least over each run of width values: of blocks' running values from the left and from the right."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    pad = -len(a) % width
    rows = np.concatenate([a, np.full(pad, a[-1], a.dtype)]).reshape(-1, width)
    left = least.accumulate(rows, 1).ravel()
    right = least.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return least(right[:n], left[width - 1 : width - 1 + n])


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all texts: number of the text, first and last window's start, mark, hash of the segment's bytes, and whether the mark
    may occur twice in it. Covers each window of each text once. The sliding hash is a polynomial modulo 2**64, which some
    regular strings share whatever its base; it only chooses marks, where that does no harm. Segments are told apart by 128-bit XXH3."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    joined = b"".join(texts)
    a = np.frombuffer(joined, np.uint8)
    n = len(a)
    none = np.zeros(0, np.int64)
    long_ = sizes >= length
    if not long_.any():
        return none, none, none, none.astype(np.uint64), none.astype(object), none.astype(bool)
    up, down = _Scale.of(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    h = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    width = length - gram + 1
    marks = _slide(h, width, np.minimum)
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, begins[:-1][long_], 1)
    np.add.at(edge, (begins[1:] - length + 1)[long_], -1)
    at = np.flatnonzero(np.cumsum(edge[:n], dtype=np.int8))
    m = marks[at]
    cut = np.flatnonzero((m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
    if (last - first).max() > RUN:
        pieces = [np.arange(f, z, RUN) for f, z in zip(first, last)]
        first = np.concatenate(pieces)
        last = np.concatenate([first[1:], [len(at)]])
    lo, hi, mark = at[first], at[last - 1], m[first]
    cuts = map(slice, lo.tolist(), (hi + length).tolist())
    whole = np.fromiter(map(xxhash.xxh3_128_digest, map(joined.__getitem__, cuts)), object, len(lo))
    peak = _slide(np.concatenate([np.zeros(width - 1, np.uint64), marks, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    spots = np.flatnonzero(h == peak)
    twice = np.concatenate([[0], np.cumsum(h[spots[1:]] == h[spots[:-1]])]) if len(spots) else np.zeros(1, np.int64)
    i, j = np.searchsorted(spots, lo), np.searchsorted(spots, hi + width - 1, "right") - 1
    multi = (j > i) & (twice[np.maximum(j, 0)] > twice[np.minimum(i, len(spots) - 1)])
    doc = np.searchsorted(begins, lo, "right") - 1
    return doc, lo - begins[doc], hi - begins[doc], mark, whole, multi


def suffix_order(a: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """starts in the order of the length bytes at them (ties by start), and the common prefix, up to length, of each with the
    one before. Ranks of 8 bytes are doubled up to the largest power of two within length; length must be at least 8."""
    n = len(a)
    padded = np.concatenate([a, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n].astype(np.uint64)
    ranks, size = [np.unique(key, return_inverse=True)[1].astype(np.int64)], 8
    while 2 * size <= length:
        r = ranks[-1]
        nxt = np.concatenate([r[size:] + 1, np.zeros(min(size, n), np.int64)])[:n]
        ranks.append(np.unique(r * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64))
        size *= 2
    top = ranks[-1]
    order = starts[np.lexsort((starts, top[starts + length - size], top[starts]))]
    lcp = np.zeros(len(order), np.int64)
    x, y = order[:-1].copy(), order[1:].copy()
    got = np.zeros(len(x), np.int64)
    for r in reversed(ranks):
        for _ in range(2 if r is top else 1):
            ok = (got + size <= length) & (x + size <= n) & (y + size <= n)
            ok[ok] = r[x[ok]] == r[y[ok]]
            got[ok] += size
            x, y = order[:-1] + got, order[1:] + got
        size //= 2
    for _ in range(8):
        ok = (got < length) & (x < n) & (y < n)
        ok[ok] = a[x[ok]] == a[y[ok]]
        got[ok] += 1
        x, y = order[:-1] + got, order[1:] + got
    lcp[1:] = np.minimum(got, length)
    return order, lcp


def nearest_smaller(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the common prefix with the nearest smaller position before it (0 without any).

    Each place holds a guess with nothing smaller between; a guess that is larger is replaced by its own guess.
    """
    n = len(order)
    guess, common = np.arange(-1, n - 1), lcp.copy()
    open_ = np.flatnonzero(guess >= 0)
    while len(open_):
        open_ = open_[order[guess[open_]] > order[open_]]
        g = guess[open_]
        common[open_], guess[open_] = np.minimum(common[open_], common[g]), guess[g]
        open_ = open_[guess[open_] >= 0]
    common[guess < 0] = 0
    return common


def previous_factors(a: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts in suffix order, longest previous factor, longest following factor), factors up to length.

    An earlier match of a start is best at the previous or next smaller position in suffix order; a later one at the larger.
    """
    order, lcp = suffix_order(a, starts, length)
    back = np.concatenate([lcp[1:], [0]])[::-1] if len(lcp) else lcp
    factors = []
    for sign in (1, -1):
        before, after = nearest_smaller(sign * order, lcp), nearest_smaller((sign * order)[::-1], back)[::-1]
        factors.append(np.maximum(before, after))
    return order, factors[0], factors[1]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def remove(text: bytes, windows: list[tuple[int, int]], length: int) -> tuple[bytes, int]:
    """The text without bytes under windows (first and last start), and the number of maximal removed runs."""
    out, at, spans = [], 0, 0
    for lo, hi in sorted(windows):
        if lo > at or not spans:
            out.append(text[at:lo])
            spans += 1
        at = max(at, hi + length)
    return b"".join([*out, text[at:]]), spans


def _batches(ids: list, texts: list, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= block):
            held += len(texts[j])
            j += 1
        yield i, j
        i = j


def _scan(length: int, gram: int):
    names = ["k1", "k2", "lo", "hi", "mark", "whole", "multi"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]

    def run(batches):
        for b in batches:
            k1, k2, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for i, j in _batches(k1, texts):
                doc, lo, hi, mark, whole, multi = segments(texts[i:j], length, gram)
                cols = [k1[i:j][doc], k2[i:j][doc], lo.astype(np.int32), hi.astype(np.int32), mark.view(np.int64), whole, multi]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run, "k1 long, k2 long, lo int, hi int, mark long, whole binary, multi boolean"


def _finish(cols: dict[str, list], k1, k2, id_, text: bytes, windows: list[tuple[int, int]], length: int, with_text: bool) -> None:
    kept, spans = remove(text, windows, length)
    for name, value in (("id", id_), ("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("n_spans", spans), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept if with_text else None)):
        cols[name].append(value)


_DONE = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def _split(length: int, with_text: bool, kind: pa.DataType):
    """mapInArrow over documents with their segments: finished rows, documents that wait, and bytes of unsettled segments."""
    names = [*_DONE, "k1", "k2", "text", "windows", "mark", "hot", "lo", "part", "open"]
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), span, pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.bool_()]

    def batch(rows: list[dict]):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for i in range(b.num_rows):
                k1, k2, id_, text, found = (b.column(c)[i].as_py() for c in range(5))
                settled = [(s["lo"], s["hi"]) for s in found or () if s["settled"]]
                waits = [s for s in found or () if s["sort"]]
                if any(s["open"] for s in waits):
                    rows.append({"k1": k1, "k2": k2, "id": id_, "text": text, "windows": [{"lo": x, "hi": y} for x, y in settled]})
                else:
                    done = {n: [] for n in _DONE}
                    _finish(done, k1, k2, id_, text, settled, length, with_text)
                    rows.append({n: v[0] for n, v in done.items()})
                rows += [{"k1": k1, "k2": k2, "mark": s["mark"], "hot": s["hot"], "lo": s["lo"], "part": text[s["lo"] : s["hi"] + length], "open": s["open"]} for s in waits]
                held += len(text)
                if held > BLOCK:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return run


def _sort_kernel(length: int, keep_first: bool):
    """mapInArrow over unsettled segments (mark, k1, k2, lo, part, open), sorted: windows that repeat, as runs of starts."""
    names = ["k1", "k2", "lo", "hi"]

    def solve(rows: list[tuple]):
        rows = sorted(rows, key=lambda r: r[1:4])
        begins = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])])
        a = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        valid = np.ones(len(a), bool)
        for e in begins[1:]:
            valid[max(0, e - length + 1) : e] = False
        order, previous, following = previous_factors(a, np.flatnonzero(valid), length)
        hit = np.zeros(len(a), bool)
        hit[order[(previous >= length) | ((following >= length) & (not keep_first))]] = True
        out = []
        for (_, k1, k2, lo, _, open_), s, e in zip(rows, begins, begins[1:]):
            if open_ and hit[s:e].any():
                out += [(k1, k2, lo + x, lo + y) for x, y in zip(*(r.tolist() for r in _runs(hit[s:e])))]
        cols = list(zip(*out)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches):
        held, size, mark = [], 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if row[0] != mark and size >= CHUNK:
                    yield solve(held)
                    held, size = [], 0
                mark, size = row[0], size + len(row[4])
                held.append(row)
        if held:
            yield solve(held)

    return run


def _window_digests(length: int):
    """mapInArrow over segments of hot marks: a row per window."""
    names = ["digest", "k1", "k2", "lo", "open"]
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())

    def run(batches):
        for b in batches:
            rows = []
            for _, k1, k2, lo, part, open_ in zip(*(b.column(i).to_pylist() for i in range(6))):
                rows += [(hashlib.blake2b(part[i : i + length], digest_size=16).digest(), k1, k2, lo + i, open_) for i in range(len(part) - length + 1)]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _apply(length: int, with_text: bool, kind: pa.DataType):
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for b in batches:
            done, held = {n: [] for n in _DONE}, 0
            for i in range(b.num_rows):
                id_, text, windows, more = (b.column(c)[i].as_py() for c in range(4))
                _finish(done, None, None, id_, text, [(w["lo"], w["hi"]) for w in [*windows, *(more or ())]], length, with_text)
                held += len(text)
                if held > BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(done[n], k) for n, k in zip(_DONE, kinds)], names=_DONE)
                    done, held = {n: [] for n in _DONE}, 0
            yield pa.RecordBatch.from_arrays([pa.array(done[n], k) for n, k in zip(_DONE, kinds)], names=_DONE)

    return run


def _judge(found: DataFrame, scratch: Scratch, length: int, keep_first: bool, chunk: int, share: int) -> DataFrame:
    """The segments that matter: settled (a copy of a whole segment), open (its windows must be sorted), sort (laid out by
    mark for that), hot (its mark has over chunk bytes to sort).

    Segments of one mark are compared in windows over the mark. Marks with over 1/share of all segments, of which there are
    fewer than share, get the same verdicts from counts by (mark, whole) and by mark, combined on the map side, which come
    back to the segments by lookup.
    """
    total = found.count()
    crowded = scratch.store(found.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, total // share)).select("mark"), "crowded")
    out = ["k1", "k2", "lo", "hi", "mark", "settled", "open", "sort", "hot"]
    by_mark, by_whole = W.partitionBy("mark"), W.partitionBy("mark", "whole")
    cold = found.join(F.broadcast(crowded), "mark", "left_anti").repartition("mark")
    cold = cold.withColumn("nth", F.rank().over(by_whole.orderBy("k1", "k2", "lo"))).withColumn("n", F.count(F.lit(1)).over(by_whole))
    cold = cold.withColumn("all", F.count(F.lit(1)).over(by_mark)).where((F.col("all") > 1) | F.col("multi"))
    cold = cold.withColumn("others", F.col("all") > F.col("n"))
    settled = F.col("nth") > 1 if keep_first else F.col("n") > 1
    cold = cold.withColumn("settled", settled).withColumn("open", ~F.col("settled") & (F.col("others") | F.col("multi")))
    cold = cold.withColumn("any", F.max("open").over(by_mark)).withColumn("sort", F.col("any") & (F.col("nth") == 1) & (F.col("open") | F.col("others")))
    size = F.col("hi") - F.col("lo") + length
    cold = cold.withColumn("hot", F.sum(F.when(F.col("sort"), size).otherwise(0)).over(by_mark) > chunk)
    kept = cold.where(F.col("settled") | F.col("sort")).select(*out)
    if not crowded.head(1):
        return kept
    dense = found.join(F.broadcast(crowded), "mark", "left_semi")
    alike = scratch.store(dense.groupBy("mark", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "lo")).alias("least"), F.max("multi").alias("twice"), F.max(size).alias("size")), "alike")
    alone = F.lit(True) if keep_first else F.col("n") == 1
    marks = alike.groupBy("mark").agg((F.count(F.lit(1)) > 1).alias("others"), F.max(alone).alias("alone"), F.max(alone & F.col("twice")).alias("again"), F.sum("size").alias("bytes"))
    marks = marks.withColumn("any", (F.col("others") & F.col("alone")) | F.col("again")).withColumn("hot", F.col("any") & (F.col("bytes") > chunk))
    verdicts = scratch.store(alike.join(F.broadcast(marks.select("mark", "others", "any", "hot")), "mark"), "verdicts")
    rows = lookup(dense, verdicts, ["mark", "whole"], "n", max(1, total)).withColumn("first", F.struct("k1", "k2", "lo") == F.col("least"))
    rows = rows.withColumn("settled", ~F.col("first") if keep_first else F.col("n") > 1)
    rows = rows.withColumn("open", ~F.col("settled") & (F.col("others") | F.col("twice")))
    rows = rows.withColumn("sort", F.col("any") & F.col("first") & (F.col("open") | F.col("others")))
    return kept.unionByName(rows.where(F.col("settled") | F.col("sort")).select(*out))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = False,
                   with_text: bool = False, chunk: int = CHUNK, share: int = HOT_SHARE) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left; null unless with_text).

    Texts are UTF-8 bytes (null: empty); matches stay within a document on each side. Every byte under a string of length
    bytes that also starts elsewhere, in any document, is removed; with keep_first, only copies of an earlier start, in the
    order of id and position. Strings are judged on the input. A mark whose unsettled segments hold over chunk bytes is hot:
    its windows meet by digest instead, counted on the map side. Ids are whole numbers; rows that repeat an id, with equal or
    other texts, each give a row (with keep_first, rows of one id and text count as one place in the order); a null id counts
    as 0 in the order. Marks with over 1/share of all segments are judged by aggregates, so that none is one task's. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow, ddl = to_arrow_type(kind), kind.simpleString()
    base = pick(docs, id=id_col, text=text_col).select("id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    keyed = base.select(F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long")).alias("k1"), F.xxhash64("id", "text").alias("k2"), "id", "text")
    run, schema = _scan(length, gram)
    found = scratch.store(keyed.select("k1", "k2", "text").where(F.octet_length("text") >= length).mapInArrow(run, schema), "found")
    marked = _judge(found, scratch, length, keep_first, chunk, share)
    lists = marked.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi", "mark", "settled", "open", "sort", "hot")).alias("found"))
    with_found = keyed.join(lists, ["k1", "k2"], "left").select("k1", "k2", "id", "text", "found")
    done = f"id {ddl}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    split = scratch.store(with_found.mapInArrow(_split(length, with_text, arrow), f"{done}, k1 long, k2 long, text binary, windows array<struct<lo:int,hi:int>>, mark long, hot boolean, lo int, part binary, open boolean"), "split")
    scratch.drop("found", "alike", "verdicts")
    parts = split.where("part is not null").select("mark", "k1", "k2", "lo", "part", "open", "hot")
    cold = parts.where("not hot").drop("hot").repartition("mark").sortWithinPartitions("mark")
    windows = cold.mapInArrow(_sort_kernel(length, keep_first), "k1 long, k2 long, lo int, hi int")
    if parts.where("hot").head(1):
        each = scratch.store(parts.where("hot").drop("hot").mapInArrow(_window_digests(length), "digest binary, k1 long, k2 long, lo int, open boolean"), "windows")
        met = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "lo")).alias("least"))
        met = scratch.store(met.where("n > 1"), "met")
        hit = lookup(each, met, ["digest"], "n", max(1, each.count())).where("n is not null and open")
        hit = hit.where(F.struct("k1", "k2", "lo") != F.col("least")) if keep_first else hit
        windows = windows.unionByName(hit.select("k1", "k2", "lo", F.col("lo").alias("hi")))
    more = windows.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("more"))
    waiting = split.where("part is null and text is not null").select("k1", "k2", "id", "text", "windows")
    rest = waiting.join(more, ["k1", "k2"], "left").select("id", "text", "windows", "more").mapInArrow(_apply(length, with_text, arrow), done)
    out = split.where("n_bytes is not null").select(*_DONE).unionByName(rest)
    return out.select(F.col("id").alias(id_col), *_DONE[1:])
