"""Likely duplicates and status changes among a session's decisions of different sections."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import LIFECYCLE_TERMS, contains_any, normalized, section_number, tech_terms
from ..schemas import LIFECYCLE_STATUSES

#: Decisions of a session that a unit of work holds on either side.
BLOCK = 1024
#: Parts that a large session is dealt to, and decisions of a part, at most; of more decisions there are more parts.
PARTS, PART = 16, 16_384
#: Candidate pairs that are listed for a decision of a large session; more of fewer decisions, up to so many in all.
NEAREST, LISTED = 64, 1_000_000
#: The bits of a listed pair's key that hold the other decision's ord, and what stands for no pair.
BITS, NONE = 40, np.iinfo(np.int64).max
#: Trigrams that a unit of work compares at once.
COLUMNS = 4096
#: Characters of a term that may stand on one side of where two texts meet.
EDGE = max(map(len, LIFECYCLE_TERMS)) - 1
#: Weights of the score, and thresholds; published with each result.
PARAMETERS = {"title": 0.36, "decision": 0.34, "combined": 0.12, "evidence": 0.12, "attachment": 0.03, "adjacency": 0.03, "candidate_score": 0.34, "strong_score": 0.38, "max_candidates": 8, "max_cluster": 12}


def features(inventory: DataFrame, compose: bool = True) -> DataFrame:
    """Per decision: key, section, status, normalised title and text, evidence, attachments and technical terms."""
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("decision", F.lit("")))
    refs = F.coalesce("evidence_refs", F.array().cast("array<struct<evidence_type:string,evidence_id:string>>"))
    files = F.transform(F.filter(refs, lambda r: r["evidence_type"] == "attachment"), lambda r: r["evidence_id"])
    lower = F.lower(F.concat(F.coalesce("title", F.lit("")), F.coalesce("decision", F.lit(""))))
    return inventory.select(
        "session_id", "source_decision_key", "section_id", section_number(F.col("section_id")).alias("n"), "status", contains_any(lower, LIFECYCLE_TERMS).alias("changes"), lower.alias("_l"),
        normalized(F.coalesce("title", F.lit("")), compose).alias("title_text"), normalized(F.coalesce("decision", F.lit("")), compose).alias("decision_text"),
        F.array_distinct(F.transform(refs, lambda r: F.concat_ws(":", r["evidence_type"], r["evidence_id"]))).alias("evidence"), F.array_distinct(files).alias("attachments"), tech_terms(both).alias("terms"))


def ranked(d: DataFrame) -> DataFrame:
    """Adds ord, the place of a decision in its session by section and key."""
    return d.withColumn("ord", F.row_number().over(W.partitionBy("session_id").orderBy("n", "source_decision_key")))


def _sum(t, d, c, e, files, near):
    """The score before it is rounded, of columns or arrays; files: 1 if any is shared."""
    return 0.36 * t + 0.34 * d + 0.12 * c + 0.12 * e + 0.03 * files + 0.03 * near


def _chosen(s, t, d, c, e, files, life, room: float = 0.0):
    """Which pairs are candidates, of columns or arrays. room: what a score may lack."""
    return (s >= 0.34 - room) | (t >= 0.62) | (d >= 0.60) | (c >= 0.48) | ((e > 0) & (c >= 0.18)) | ((files > 0) & (c >= 0.12)) | (life & (c >= 0.28))


def _scored(j: DataFrame) -> DataFrame:
    """Candidate pairs, of pairs with similarities and counts, with score, strong and reasons."""
    t, dd, c, e, n, life = (F.col(x) for x in ("title_similarity", "decision_similarity", "combined_similarity", "evidence_similarity", "section_distance", "possible_lifecycle_relation"))
    files, terms = F.col("files"), F.col("terms")
    near = F.when(n == 1, 1.0).when(n == 2, 0.5).otherwise(0.0)
    j = j.withColumn("candidate_score", F.round(_sum(t, dd, c, e, F.least(F.lit(1), files), near), 6))
    s = F.col("candidate_score")
    j = j.where(_chosen(s, t, dd, c, e, files, life))
    strong = ((s >= 0.38) | (t >= 0.68) | (dd >= 0.65) | ((e >= 0.34) & (c >= 0.28)) | ((files > 0) & (c >= 0.35)) | (life & (n <= 2) & ((c >= 0.16) | (terms >= 3))) | ((terms >= 2) & (t >= 0.62) & (c >= 0.18)))
    reasons = F.array_compact(F.array(*(F.when(cond, name) for name, cond in (
        ("similar_title", t >= 0.62), ("similar_decision_text", dd >= 0.60), ("similar_combined_text", c >= 0.48), ("shared_evidence", e > 0), ("shared_attachment", files > 0), ("nearby_sections", n <= 2), ("possible_lifecycle_signal", life)))))
    return j.withColumn("strong_cluster_candidate", strong).withColumn("candidate_reasons", reasons).drop("files", "terms")


def coded(d: DataFrame, frequent: int | None = None) -> DataFrame:
    """What the comparison reads of ranked decisions: evidence, attachments and terms as hashes, a status as its number (0: none that a
    lifecycle knows), and the ends of the text, where a word of change may come about. frequent is no longer of use."""
    hashes = lambda c: F.transform(c, lambda x: F.xxhash64(x)).alias(c)
    status = F.coalesce(*(F.when(F.col("status") == x, k) for k, x in enumerate(LIFECYCLE_STATUSES, 1)), F.lit(0))
    return d.where("section_id is not null").select(
        "session_id", "ord", "source_decision_key", F.xxhash64("section_id").alias("section"), "n", status.alias("status"), "changes", F.substring("_l", 1, EDGE).alias("head"), F.right(F.col("_l"), F.lit(EDGE)).alias("tail"),
        "title_text", "decision_text", hashes("evidence"), hashes("attachments"), hashes("terms"))


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, its runs of three) of all texts, repeats included: a text's number, and its characters' code points from 1. A text of one or
    two characters is its own run, ended by zeros; an empty one has none."""
    size = np.array([len(x) for x in texts], np.int64)
    points = np.append(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1, (0, 0))
    n = np.maximum(size - 2, np.minimum(size, 1))
    row = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(row)) + np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n)
    return row, np.stack([points[at], np.where(size[row] > 1, points[at + 1], 0), np.where(size[row] > 2, points[at + 2], 0)])


def grams(text: str) -> np.ndarray:
    """Distinct trigrams of a text, each as its three code points in one number; a text of one or two characters is its own, an empty one
    has none."""
    a, b, c = _runs([text])[1]
    return np.unique(a << 42 | b << 21 | c)


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram) of texts, repeats included; trigrams have numbers that hold among these texts."""
    row, runs = _runs(texts)
    number = np.cumsum(np.bincount(runs.ravel(), minlength=1) > 0)
    a, b, c = number[runs]
    return row, (a * (number[-1] + 1) + b) * (number[-1] + 1) + c


def _products(row: np.ndarray, column: np.ndarray, n: int, left: int) -> np.ndarray:
    """How many columns each of the first rows has in common with each of the others, or each with each if left is 0. row and column: where
    the ones are, by column."""
    out, last = np.zeros((left or n, n - left), np.int32), int(column[-1]) + 1 if len(column) else 0
    for first in range(0, last, COLUMNS):
        part = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        table = np.zeros((n, min(COLUMNS, last - first)), np.float32)
        table[row[part], column[part] - first] = 1
        out += (table[: left or n] @ table[left:].T).astype(np.int32)
    return out


def shared(row: np.ndarray, code: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Sizes of sets and, for each unit, how many numbers the sets on its left share with those on its right. row, code: a set and a number
    in it, repeats allowed; cuts: a unit's first set, the first of its right side (its first set again, if it has one side) and its end.

    All units' numbers are sorted at once, by unit and number, and those that only one set has are left out. Then a unit's sets are rows
    of zeros and ones, COLUMNS numbers at once.
    """
    first, _, end = cuts.T
    unit = np.repeat(np.arange(len(cuts)), end - first)[row]
    wide, high = int((end - first).max()).bit_length(), len(cuts).bit_length()
    if int(code.max(initial=0)).bit_length() + wide + high > 62:
        code = np.unique(code, return_inverse=True)[1]
    deep = int(code.max(initial=0)).bit_length()
    key = np.sort((unit << deep | code) << wide | row - first[unit])
    key = key[np.diff(key, prepend=-1) != 0]
    place = key & (1 << wide) - 1
    sizes = np.bincount(first[key >> wide + deep] + place, minlength=end[-1])
    column = np.cumsum(np.diff(key >> wide, prepend=-1) != 0) - 1
    often = np.bincount(column, minlength=1) > 1
    keep = often[column]
    key, place, column = key[keep], place[keep], (np.cumsum(often) - 1)[column[keep]]
    bounds = np.searchsorted(key, np.arange(len(cuts) + 1) << deep + wide).tolist()
    return sizes, (_products(place[i:j], column[i:j] - column[i:j][:1], b - a, m - a) for (a, m, b), i, j in zip(cuts.tolist(), bounds, bounds[1:]))


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set on the left shares with each on the right; the same list twice is one side."""
    sets, middle = (left, 0) if left is right else (left + right, len(left))
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    return next(shared(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), code, np.array([[0, middle, len(sets)]]))[1])


#: Beginnings and ends of words of change, and the cuts (bits) that they stand for.
BEGINNINGS, ENDS = {}, {}
for _cut, (_term, _k) in enumerate((t, k) for t in LIFECYCLE_TERMS for k in range(1, len(t))):
    BEGINNINGS[_term[:_k]] = BEGINNINGS.get(_term[:_k], 0) | 1 << _cut
    ENDS[_term[_k:]] = ENDS.get(_term[_k:], 0) | 1 << _cut


def _meets(texts: list[str], parts: dict[str, int], tail: bool) -> np.ndarray:
    """Which cuts of words of change stand at the texts' ends or, without tail, beginnings. A word stands where a tail and a head meet if both
    have one of its cuts."""
    sides = (x[-k:] if tail else x[:k] for x in texts for k in range(1, EDGE + 1))
    return np.bitwise_or.reduce(np.array([parts.get(x, 0) for x in sides], np.int64).reshape(-1, EDGE), axis=1)


def compared(b: pa.Table, cuts: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of the pairs (left before right, of different sections) that may be candidates, of decisions in units, whose cuts are those of
    shared(); a unit of one side is in order. The rules are those of _scored, which decides, with the most that nearness can add and room for
    its rounding."""
    own = {c: b[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("ord", "section", "n", "status", "changes")}
    head, tail = _meets(b["head"].to_pylist(), ENDS, False), _meets(b["tail"].to_pylist(), BEGINNINGS, True)
    texts = {c: b[f"{c}_text"].to_pylist() for c in ("title", "decision")}
    sets = {c: _numbered(x) for c, x in (texts | {"combined": [x + y for x, y in zip(texts["title"], texts["decision"])]}).items()}
    for c in ("evidence", "attachments", "terms"):
        listed = b[c].combine_chunks()
        sets[c] = np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy()), np.unique(listed.flatten().to_numpy(), return_inverse=True)[1]
    ends = [np.indices((m - a, e - m)).reshape(2, -1) if m > a else np.triu_indices(e - a, 1) for a, m, e in cuts.tolist()]
    l, r = (np.concatenate([e[k] + first for e, first in zip(ends, cuts[:, k].tolist())]) for k in (0, 1))  # noqa: E741
    both, total = {}, {}
    for c, x in sets.items():
        size, products = shared(*x, cuts)
        both[c], total[c] = np.concatenate([p[e[0], e[1]] for p, e in zip(products, ends)]), size[l] + size[r]
    t, d, c = (np.where(total[k] == 0, 1.0, 2.0 * both[k] / np.maximum(total[k], 1)) for k in ("title", "decision", "combined"))
    e = both["evidence"] / np.maximum(total["evidence"] - both["evidence"], 1)
    n, status, changes, section = own["n"], own["status"], own["changes"], own["section"]
    known = (status[l] > 0) & (status[r] > 0) & (status[l] != status[r])
    life = known | changes[l] | changes[r] | ((tail[l] & head[r]) != 0)
    files = both["attachments"]
    may = _chosen(_sum(t, d, c, e, files > 0, 1), t, d, c, e, files, life, 1e-5) & (section[l] != section[r])
    l, r = l[may], r[may]  # noqa: E741
    return {"left_at": l, "right_at": r, "left_ord": own["ord"][l], "right_ord": own["ord"][r], "section_distance": np.abs(n[l] - n[r]), "title_similarity": t[may], "decision_similarity": d[may], "combined_similarity": c[may],
            "evidence_similarity": e[may], "files": files[may], "terms": both["terms"][may], "possible_lifecycle_relation": life[may]}


def units(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of by, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in chain(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        if b is not None:
            keys = [b.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in by]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1).tolist(), b.num_rows]
            parts = [b.slice(i, j - i) for i, j in zip(cuts, cuts[1:])]
            if held and all(held[0].column(c)[0].as_py() == parts[0].column(c)[0].as_py() for c in by):
                held.append(parts.pop(0))
                if not parts:
                    continue
        if held:
            yield pa.Table.from_batches(held)
        if b is not None:
            yield from (pa.Table.from_batches([p]) for p in parts[:-1])
            held = parts[-1:]


def gathered(units: Iterator[pa.Table], most: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Units together, up to so many rows or a single one, with their first rows."""
    held, size = [], 0
    for unit in chain(units, [None]):
        if held and (unit is None or size + unit.num_rows > most):
            yield pa.concat_tables(held), np.cumsum([0, *(x.num_rows for x in held[:-1])]).tolist()
            held, size = [], 0
        if unit is not None:
            held, size = [*held, unit], size + unit.num_rows


#: What is told of a pair.
KINDS = {"left_ord": pa.int32(), "right_ord": pa.int32(), "section_distance": pa.int32(), "title_similarity": pa.float64(), "decision_similarity": pa.float64(), "combined_similarity": pa.float64(), "evidence_similarity": pa.float64(),
         "files": pa.int32(), "terms": pa.int32(), "possible_lifecycle_relation": pa.bool_()}
PAIR = ("session_id {kind}, left_decision_key string, right_decision_key string, left_ord int, right_ord int, section_distance int, title_similarity double, decision_similarity double, combined_similarity double, "
        "evidence_similarity double, files int, terms int, possible_lifecycle_relation boolean")


def _told(rows: pa.Table, found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs that compared() found among rows, as PAIR has them."""
    a, b = (pa.array(found[x]) for x in ("left_at", "right_at"))
    made = [rows["session_id"].take(a), rows["source_decision_key"].take(a), rows["source_decision_key"].take(b), *(pa.chunked_array([pa.array(found[c], KINDS[c])]) for c in KINDS)]
    yield from pa.Table.from_arrays(made, names=["session_id", "left_decision_key", "right_decision_key", *KINDS]).to_batches(max_chunksize=100_000)


def candidates(codes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (left before right) of coded decisions that may be candidates, with similarities and counts of what they share.

    Every two blocks of a session meet in one unit of work, which counts what each pair shares by products of tables of zeros and ones. Most
    sessions are one block, and small: as many as a block holds are numbered, counted and judged together. A row is copied once for each
    block of its session.
    """
    by = ["session_id", "one", "other"]
    own = F.floor((F.col("ord") - 1) / block).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.floor((F.col("_most") - 1) / block).cast("int")), lambda x: F.struct(F.least(x, own).alias("one"), F.greatest(x, own).alias("other")))
    dealt = codes.withColumn("_most", F.max("ord").over(W.partitionBy("session_id"))).withColumn("_u", F.explode(meets)).select("*", "_u.*").drop("_u", "_most")
    dealt = dealt.repartition(*by).sortWithinPartitions(*by, "ord")

    def run(batches):
        for rows, starts in gathered(units(batches, by), block):
            at = (rows["ord"].combine_chunks().to_numpy() - 1) // block
            one, other = (rows[c].combine_chunks().to_numpy() for c in ("one", "other"))
            first, end = np.array(starts), np.array([*starts[1:], rows.num_rows])
            left = np.add.reduceat(at == one, first, dtype=np.int64)
            yield from _told(rows, compared(rows, np.stack([first, np.where(one[first] == other[first], first, first + left), end], 1)))

    return dealt.mapInArrow(run, PAIR.format(kind=codes.schema["session_id"].dataType.simpleString()))


def millionths(score: np.ndarray) -> np.ndarray:
    """Scores as round(score, 6) gives them, times a million: half up by their decimal digits, which only scores beside a half need."""
    x = score * 1e6
    out = np.floor(x + 0.5).astype(np.int64)
    half = np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-6)
    values, of = np.unique(score[half], return_inverse=True)
    out[half] = np.array([int((Decimal(repr(v)) * 1_000_000).to_integral_value(ROUND_HALF_UP)) for v in values.tolist()], np.int64)[of]
    return out


def _grids(rows: pa.Table, middle: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs that are candidates, of rows of two blocks, the second from middle on, or of one if that is 0: a row for each on the left
    and, again, for each on the right. Pairs that were taken before are left out. Keys ascend in the order of the degree cap's walk at one end: by
    falling score, then by the other end's ord."""
    n, ords = rows.num_rows, rows["ord"].combine_chunks().to_numpy().astype(np.int64)
    found = compared(rows, np.array([[0, middle, n]]))
    t, d, c, e, files, life, far = (found[x] for x in ("title_similarity", "decision_similarity", "combined_similarity", "evidence_similarity", "files", "possible_lifecycle_relation", "section_distance"))
    low = 1_000_000 - millionths(_sum(t, d, c, e, np.minimum(files, 1), np.where(far == 1, 1.0, np.where(far == 2, 0.5, 0.0))))
    good = _chosen((1_000_000 - low) / 1e6, t, d, c, e, files, life)
    l, r, low = found["left_at"][good], found["right_at"][good], low[good] << BITS  # noqa: E741
    taken = rows["taken"].combine_chunks()
    a, b = np.repeat(np.arange(n), taken.value_lengths().to_numpy()), taken.flatten().to_numpy()
    at = np.minimum(np.searchsorted(ords, b), n - 1)
    gone = ords[at] == b
    a, b = a[gone], at[gone]
    if not middle:
        grid = np.full((n, n), NONE)
        grid[l, r], grid[r, l], grid[a, b] = low | ords[r], low | ords[l], NONE
        return grid, grid
    left, right = np.full((middle, n - middle), NONE), np.full((n - middle, middle), NONE)
    left[l, r - middle], right[r - middle, l] = low | ords[r], low | ords[l]
    across = (a < middle) & (b >= middle)
    left[a[across], b[across] - middle], right[b[across] - middle, a[across]] = NONE, NONE
    return left, right


def nearest(codes: DataFrame, block: int = BLOCK, least: int = NEAREST) -> DataFrame:
    """(session_id, ord, keys, whole) for each of coded decisions: the first of its candidate pairs in the order of the degree cap's walk, and whether
    they are all. A key's high bits are a million less the score's millionths, its low BITS the other decision's ord. codes also has
    taken, the ords that a decision is paired with already.

    All pairs are compared, but only least a decision leave a unit of work (more where a session has few decisions). A session is dealt to PARTS
    parts, or more of PART decisions, and every two parts meet in a unit, which compares them block by block: a row is copied once
    for each part, not for each block.
    """
    by, n = ["session_id", "one", "other"], F.col("_n")
    parts = F.when(n <= block, 1).otherwise(F.greatest(F.least(F.ceil(n / block), F.lit(PARTS)), F.ceil(n / PART)))
    d = codes.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("session_id"))).withColumn("_k", F.row_number().over(W.partitionBy("session_id").orderBy("ord")))
    d = d.withColumn("most", F.greatest(F.lit(least), F.least(n, F.floor(F.lit(LISTED) / n))).cast("int")).withColumn("_parts", parts.cast("int")).withColumn("part", F.floor((F.col("_k") - 1) * F.col("_parts") / n).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda x: F.struct(F.least(x, F.col("part")).alias("one"), F.greatest(x, F.col("part")).alias("other")))
    dealt = d.drop("_n", "_k").withColumn("_u", F.explode(meets)).select("*", "_u.*").drop("_u", "_parts").repartition(*by).sortWithinPartitions(*by, "ord")

    def run(batches):
        for unit in units(batches, by):
            n, most = unit.num_rows, unit["most"][0].as_py()
            split = int((unit["part"].to_numpy() == unit["one"][0].as_py()).sum()) % n
            ranges = lambda i, j: [(k, min(k + block, j)) for k in range(i, j, block)]
            ends, first = ranges(0, split or n) + (ranges(split, n) if split else []), len(ranges(0, split))
            best = [np.full((j - i, most), NONE) for i, j in ends]
            for x, (i, j) in enumerate(ends[: first or None]):
                for y in range(first or x, len(ends)):
                    a, b = ends[y]
                    grids = _grids(unit.slice(i, j - i) if x == y else pa.concat_tables([unit.slice(i, j - i), unit.slice(a, b - a)]), 0 if x == y else j - i)
                    for at, grid in {x: grids[0], y: grids[1]}.items():
                        best[at] = np.partition(np.concatenate([best[at], grid], axis=1), most - 1, axis=1)[:, :most]
            for (i, j), keys in zip(ends, best):
                there = keys != NONE
                listed = pa.ListArray.from_arrays(np.append(0, np.cumsum(there.sum(1))).astype(np.int32), keys[there])
                own = unit.slice(i, j - i)
                yield from pa.Table.from_arrays([own["session_id"], own["ord"], own["most"], pa.chunked_array([listed])], names=["session_id", "ord", "most", "keys"]).to_batches(max_chunksize=1024)

    made = dealt.mapInArrow(run, f"session_id {codes.schema['session_id'].dataType.simpleString()}, ord int, most int, keys array<long>")
    made = made.groupBy("session_id", "ord").agg(F.max("most").alias("most"), F.flatten(F.collect_list("keys")).alias("keys"))
    return made.select("session_id", "ord", F.slice(F.sort_array("keys"), F.lit(1), F.col("most")).alias("keys"), (F.size("keys") < F.col("most")).alias("whole"))


def rated(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """Candidate pairs, as pairs() gives them, of given ones (session_id, left_ord, right_ord) of coded decisions."""
    own = codes.select("session_id", "ord", F.struct(*codes.columns).alias("d"))
    for side in ("left", "right"):
        edges = edges.join(own.select("session_id", F.col("ord").alias(f"{side}_ord"), F.col("d").alias(side)), ["session_id", f"{side}_ord"])

    def run(batches):
        for b in batches:
            if n := b.num_rows:
                both = pa.concat_tables(pa.Table.from_batches([pa.RecordBatch.from_struct_array(b.column(k))]) for k in (0, 1)).combine_chunks()
                first = np.arange(0, 2 * n, 2)
                rows = both.take(pa.array(np.stack([np.arange(n), np.arange(n) + n], 1).ravel()))
                yield from _told(rows, compared(rows, np.stack([first, first + 1, first + 2], 1)))

    return _scored(edges.select("left", "right").mapInArrow(run, PAIR.format(kind=codes.schema["session_id"].dataType.simpleString())))


def pairs(feats: DataFrame, block: int = BLOCK) -> DataFrame:
    """Candidate pairs (left before right) with similarities, score, strong and reasons; exact, all pairs compared in blocks."""
    return _scored(candidates(coded(ranked(feats)), block))


def detailed(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """Adds shared_evidence, shared_attachments and shared_terms (20 at most) to pairs."""
    names = ("evidence", "attachments", "terms")
    own = ranked(feats).select("session_id", "ord", *names)
    for side in ("left", "right"):
        pairs = pairs.join(own.select("session_id", F.col("ord").alias(f"{side}_ord"), *(F.col(c).alias(f"_{side}_{c}") for c in names)), ["session_id", f"{side}_ord"])
    shared = {c: F.array_sort(F.array_intersect(f"_left_{c}", f"_right_{c}")) for c in names}
    pairs = pairs.withColumns({f"shared_{c}": F.slice(x, 1, 20) if c == "terms" else x for c, x in shared.items()})
    return pairs.drop(*(f"_{side}_{c}" for side in ("left", "right") for c in names))


def possible_pairs(inventory: DataFrame) -> DataFrame:
    """Per session, pairs across sections, in closed form."""
    per = inventory.groupBy("session_id", "section_id").agg(F.count(F.lit(1)).alias("n"))
    choose = lambda x: x * (x - 1) / 2
    return per.groupBy("session_id").agg((choose(F.sum("n")) - F.sum(choose(F.col("n")))).cast("long").alias("possible_cross_section_pair_count"))
