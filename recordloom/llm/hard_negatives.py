"""Hard-negative mining: an exact kNN join by inner product over Voronoi cells of norm-augmented vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from .common import Scratch, pick

#: Rows, chosen by hash, that pivots are made from and that give each anchor its first bounds; they go to the driver and to every task.
SAMPLE = 4096
#: A cell for every so many rows, from FEWEST to MOST cells.
CELL, FEWEST, MOST = 2048, 16, 256
#: A cell's rows are cut into chunks, and anchors into groups, of about so many.
CHUNK = GROUP = 16_384
#: Vectors whose squared length in steps is over this take no part: only below it do all scores, times 95, fit a long.
LONGEST = 1 << 56


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros behind them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(float)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(size.cumsum() - size, size)] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Integer inner products. No sum exceeds the longest squared length, so doubles are exact up to 2**53."""
    return a @ b.T if longest <= 1 << 53 else a.astype(np.int64) @ b.T.astype(np.int64)


class Cells:
    """Pivots in the augmented space, where every row x becomes (x, sqrt(longest - |x|^2)) and an anchor q (q, 0): then
    |q - x|^2 = |q|^2 + longest - 2 q.x, so that near means a high inner product."""

    def __init__(self, sample: np.ndarray, longest: float, number: int):
        self.longest = float(longest)
        x = np.column_stack([sample, np.sqrt(np.maximum(longest - (sample**2).sum(1), 0))]) if len(sample) else np.zeros((1, sample.shape[1] + 1))
        far, chosen = np.full(len(x), np.inf), [0]
        for _ in range(number - 1):
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.at = x[chosen]
        for _ in range(4):  # towards the middle of what each pivot has
            own = self.squares(x[:, :-1], x[:, -1]).argmin(1)
            n = np.bincount(own, minlength=len(self.at))
            sums = np.zeros_like(self.at)
            np.add.at(sums, own, x)
            self.at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.at)

    def squares(self, q: np.ndarray, last: np.ndarray) -> np.ndarray:
        d = (q**2).sum(1)[:, None] + (last**2)[:, None] + (self.at**2).sum(1) - 2 * (q @ self.at[:, :-1].T + last[:, None] * self.at[:, -1])
        return np.maximum(d, 0)

    def of_rows(self, q: np.ndarray) -> np.ndarray:
        return self.squares(q, np.sqrt(np.maximum(self.longest - (q**2).sum(1), 0)))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self.squares(q, np.zeros(len(q)))

    def bounds(self, q: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) score that an anchor can have with a row of each cell, whose rows are so near and far from its pivot. They
        are loose by more than rounding can amount to; an empty cell has none."""
        d, slack = np.sqrt(self.of_anchors(q)), 1 + 1e-5 * self.longest
        least, most = np.maximum(0, np.maximum(d - farthest, nearest - d)), d + farthest
        half = ((q**2).sum(1)[:, None] + self.longest) / 2
        return np.where(np.isinf(nearest), np.inf, half - most**2 / 2 - slack), np.where(np.isinf(nearest), -np.inf, half - least**2 / 2 + slack)

    def groups(self, anchors: np.ndarray, size: int) -> tuple[list[int], list[int]]:
        """(first group, number of groups) of each pivot's anchors: pivots near each other share one, a pivot with many has several."""
        left, at, first, number, group, room = set(range(len(self.at))), 0, [0] * len(self.at), [1] * len(self.at), 0, size
        while left:
            left.discard(at)
            n = int(anchors[at])
            if n > room:
                group, room = group + 1, size
            first[at], number[at] = group, max(1, -(-n // size))
            group, room = (group, room - n) if n <= size else (group + number[at], size)
            if left:
                rest = np.array(sorted(left))
                at = int(rest[((self.at[rest] - self.at[at]) ** 2).sum(1).argmin()])
        return first, number


def best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's first k fitting columns, higher scores first and earlier columns first among equal ones."""
    if np.count_nonzero(fits) > 16 * k * len(score):  # many: drop what can't be among the first k before sorting
        low = np.where(fits, score, -(1 << 62))
        bar = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k, None] if low.shape[1] > k else np.full((len(low), 1), -(1 << 62))
        above, same = fits & (score > bar), fits & (score == bar)
        fits = above | same & (same.cumsum(1) <= k - above.sum(1)[:, None])
    row, column = np.nonzero(fits)
    value = score[row, column]
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    first = np.searchsorted(row, np.arange(len(score)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep], value[keep]


def window(score: int) -> tuple[int, int]:
    """Scores n with 50 * score <= 100 * n <= 95 * score; none below zero."""
    return -(-50 * score // 100), 95 * score // 100


def mine_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, positives: int = 5,
                   negatives: int = 3, sample: int = SAMPLE, chunk: int = CHUNK, group: int = GROUP, cell: int = CELL) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (id divisible by every) and each of its
    first positives other rows of its label, the first negatives rows of other labels whose score is from 0.5 to 0.95 of the positive's.

    Components are floor(256 * x), scores integer inner products with the anchor; higher first, then smaller id. Exact, in two joins of one form.
    Every row goes to the cell of its nearest pivot in the augmented space; a cell's rows to chunks, anchors to groups of near pivots. For each
    anchor, the sample's rows give a score that its last positive (or negative) reaches at least; cells whose bounds lie below
    it, or outside the window of negatives, aren't looked at. A chunk is sent to the groups that have an anchor for its cell, an
    anchor to the chunks that it needs, and each pair (group, chunk) is joined by itself: no task holds more than a chunk and a group of
    either, one common vector or label included. At most positives (negatives) rows of each anchor leave a pair.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part, nor do vectors longer than 2**28 steps
    (a million), whose scores need not fit a long. Shorter vectors end in zeros. Rows that repeat an id are rows of their own: an
    anchor's twin may be its positive. An empty table gives none; further columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    v = pick(vectors, id=id_col, x=vector_col, label=label_col)
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    length = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + F.pow(F.floor(c.cast("double") * 256).cast("double"), F.lit(2.0)))
    v = v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(fine).where(length <= float(LONGEST))
    v = v.select(F.monotonically_increasing_id().alias("uid"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("x", lambda c: F.floor(c.cast("double") * 256).cast("int")).alias("q"))
    rows = scratch.store(v, "rows")
    facts = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0).cast("long"), lambda acc, c: acc + c.cast("long") * c.cast("long")))).first()
    total, width, longest = facts[0], facts[1] or 0, facts[2] or 0
    share = F.pmod(F.xxhash64("uid"), F.lit(1 << 20))
    taken = rows.where(share < int((1 << 20) * min(1.0, 1.2 * sample / max(total, 1))) + 1).orderBy(share, "uid").limit(sample).toArrow()
    known = matrix(taken.column("q"), width)
    cells = Cells(known, longest, min(MOST, max(FEWEST, total // cell)))
    common = spark.sparkContext.broadcast((cells, known, taken.column("uid").to_numpy(), taken.column("label").to_numpy()))

    def place(batches):
        cells = common.value[0]
        for b in batches:
            q = matrix(b.column(3), width)
            d = cells.of_rows(q)
            near = d.argmin(1)
            # the anchors' own nearest pivots, by which they are grouped
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), near])), pa.array(cells.of_anchors(q).argmin(1).astype(np.int32))], names=[*b.schema.names, "cell", "away", "near"])

    rows = scratch.store(rows.mapInArrow(place, "uid long, id long, label long, q array<int>, cell int, away double, near int"), "placed")
    is_anchor = F.col("id") % every == 0
    nearest, farthest = np.full(len(cells.at), np.inf), np.zeros(len(cells.at))
    count, anchors_near = np.zeros(len(cells.at), np.int64), np.zeros(len(cells.at), np.int64)
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)), F.min("away"), F.max("away")).collect():  # a row a pivot
        count[r[0]], nearest[r[0]], farthest[r[0]] = r[1], r[2], r[3]
    for r in rows.where(is_anchor).groupBy("near").count().collect():
        anchors_near[r[0]] = r[1]
    first, number = cells.groups(anchors_near, group)
    chunks = [max(1, -(-int(n) // chunk)) for n in count]
    of = lambda values, c: F.element_at(F.array(*map(F.lit, values)), F.col(c) + 1)
    candidates = rows.select("uid", "id", "label", "q", "cell", F.pmod(F.xxhash64("uid"), of(chunks, "cell")).cast("int").alias("chunk"))
    anchors = rows.where(is_anchor).select("uid", "id", "label", "q", (of(first, "near") + F.pmod(F.xxhash64("uid"), of(number, "near"))).cast("int").alias("group"))
    routed = "uid long, id long, label long, q array<int>, group int, aims array<long>, least array<long>, most array<long>, cells array<int>"

    def route(batches):
        """Adds what each anchor looks for (scores from least to most, for each aim) and the cells that may hold it."""
        cells, known, uids, labels = common.value
        for b in batches:
            q, uid, label = matrix(b.column(3), width), b.column(0).to_numpy(), b.column(2).to_numpy()
            low, high = cells.bounds(q, nearest, farthest)
            s = scores(q, known, longest)
            wanted = []
            for i in range(len(q)):
                if b.num_columns == 5:  # positives: the sample's last of the first few is a bound
                    same = np.sort(s[i, (labels == label[i]) & (uids != uid[i])])
                    bar = int(same[-positives]) if len(same) >= positives else -(1 << 62)
                    wanted.append(([0], [bar], [1 << 62], np.flatnonzero(high[i] >= bar)))
                    continue
                aims = [x for x in b.column(5)[i].as_py() if x >= 0]
                other, need = s[i, labels != label[i]], np.zeros(len(low[i]), bool)
                least, most = [], []
                for aim in aims:
                    lo, hi = window(aim)
                    inside = np.sort(other[(other >= lo) & (other <= hi)])
                    least.append(int(inside[-negatives]) if len(inside) >= negatives else lo)
                    most.append(hi)
                    need |= (high[i] >= least[-1]) & (low[i] <= hi)
                wanted.append((aims, least, most, np.flatnonzero(need)))
            types = [pa.list_(pa.int64())] * 3 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array([list(w[k]) for w in wanted], t) for k, t in enumerate(types))], names=[c.split()[0] for c in routed.split(", ")])

    found = "uid long, aim long, score long, other_id long, other long"
    found_schema = to_arrow_schema(StructType.fromDDL(found))

    def local(k: int, same_label: bool):
        """The exact join of one group's anchors with one chunk."""
        def join(key, left, right):
            if not left.num_rows or not right.num_rows:
                return found_schema.empty_table()
            right = right.take(pa.array(np.lexsort((right.column("uid").to_numpy(), right.column("id").to_numpy()))))
            c, c_id, c_uid, c_label = matrix(right.column("q"), width), *(right.column(x).to_numpy() for x in ("id", "uid", "label"))
            a, a_uid, a_label = matrix(left.column("q"), width), left.column("uid").to_numpy(), left.column("label").to_numpy()
            aims, least, most = (left.column(x).to_pylist() for x in ("aims", "least", "most"))
            out = []
            for at in range(0, len(a), 128):
                part = slice(at, at + 128)
                s = scores(a[part], c, longest)
                equal = a_label[part, None] == c_label
                other = equal & (a_uid[part, None] != c_uid) if same_label else ~equal
                for n in range(max(map(len, aims[part]), default=0)):
                    pad = lambda lists, empty: np.array([x[n] if n < len(x) else empty for x in lists[part]])
                    r, j, value = best(s, other & (s >= pad(least, 1 << 62)[:, None]) & (s <= pad(most, -(1 << 62))[:, None]), k)
                    if len(r):
                        out.append(pa.table([a_uid[part][r], pad(aims, 0)[r], value.astype(np.int64), c_id[j], c_uid[j]], schema=found_schema))
            return pa.concat_tables(out) if out else found_schema.empty_table()

        return join

    def nearby(seekers: DataFrame, k: int, same_label: bool, name: str) -> DataFrame:
        """The first k rows of each anchor and aim, of those pairs of group and chunk that may hold one."""
        seekers = scratch.store(seekers.mapInArrow(route, routed), f"{name}-routed").withColumn("cell", F.explode("cells")).drop("cells")
        seekers = seekers.withColumn("chunk", F.explode(F.sequence(F.lit(0), of(chunks, "cell") - 1)))
        served = seekers.select("group", "cell", "chunk").distinct()
        sent = candidates.join(served, ["cell", "chunk"])
        by = ["group", "cell", "chunk"]
        made = seekers.groupBy(*by).cogroup(sent.select(*(F.col(c).alias(c) for c in sent.columns)).groupBy(*by)).applyInArrow(local(k, same_label), found)
        place_ = F.row_number().over(W.partitionBy("uid", "aim").orderBy(F.desc("score"), "other_id", "other"))
        return scratch.store(made.withColumn("rank", place_).where(F.col("rank") <= k), name)

    pos = nearby(anchors, positives, True, "positives").select("uid", F.col("other_id").alias("positive_id"), F.col("score").alias("aim"))
    aims = pos.groupBy("uid").agg(F.sort_array(F.collect_set("aim")).alias("aims"))  # positives of them at most
    neg = nearby(anchors.join(aims, "uid").select("uid", "id", "label", "q", "group", "aims"), negatives, False, "negatives")
    names = anchors.select("uid", F.col("id").alias("anchor_id"))
    return pos.join(neg, ["uid", "aim"]).join(names, "uid").select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), F.col("aim").alias("positive_score"), F.col("score").alias("negative_score"))
