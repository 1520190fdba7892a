"""Order-dependent choices on edges: at most so many per end, and clusters of at most so many members."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import stored
from . import similarity

#: Sessions with more pairs are capped and clustered by rounds over DataFrames instead of in one task.
KERNEL_PAIRS = 200_000
#: First open edges of a session that a round of the degree cap walks.
WALK = 1_000_000

#: The order in which edges are capped, and that in which they are joined; whether each column ascends.
CAP_ORDER = {"candidate_score": False, "left_ord": True, "right_ord": True}
JOIN_ORDER = {"strong_cluster_candidate": False} | CAP_ORDER


def _sorted(d: DataFrame, order: dict[str, bool]) -> DataFrame:
    """Sessions whole in a partition, one behind the other, their edges in order."""
    return d.repartition("session_id").sortWithinPartitions("session_id", *order, ascending=[True, *order.values()])


def _walk(cap: int):
    """The walk over sessions' sorted edges as they stream by; only a session's degrees are held."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, degree = None, {}
        for p in batches:
            kept = []
            for s, a, b in zip(*(p.column(c).to_pylist() for c in ("session_id", "left_ord", "right_ord"))):
                if s != session:
                    session, degree = s, {}
                x, y = degree.get(a, 0), degree.get(b, 0)
                good = x < cap and y < cap
                kept.append(good)
                if good:
                    degree[a], degree[b] = x + 1, y + 1
            yield p.filter(pa.array(kept, pa.bool_()))

    return kernel


def _prefix(cap: int):
    """The walk over the first open edges, whose ends have left_used and right_used kept edges from before; adds now: whether one is kept."""
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["candidate_score", "left_ord", "right_ord"], ascending=[False, True, True])
        degree = dict(zip(p["left_ord"].tolist(), p["left_used"].tolist())) | dict(zip(p["right_ord"].tolist(), p["right_used"].tolist()))
        kept = []
        for a, b in zip(p["left_ord"].tolist(), p["right_ord"].tolist()):
            good = degree[a] < cap and degree[b] < cap
            kept.append(good)
            if good:
                degree[a] += 1
                degree[b] += 1
        return p.drop(columns=["left_used", "right_used"]).assign(now=kept)

    return kernel


def _rounds(edges: DataFrame, cap: int, few: int = WALK) -> DataFrame:
    """The same choice by rounds: each walks a session's first few open edges, which none comes before, then drops the edges whose ends are
    full. An edge of a prefix is kept or has a full end, so there are about as many rounds as kept edges / few, and a few."""
    key, zero = ["session_id", "left_ord", "right_ord"], F.lit(0).cast("long")
    place = F.struct((-F.col("candidate_score")).alias("low"), "left_ord", "right_ord")
    open_, taken = stored(edges.withColumn("left_used", zero).withColumn("right_used", zero), "open"), []
    while open_.head(1):
        w = W.partitionBy("session_id").orderBy(F.desc("candidate_score"), "left_ord", "right_ord")
        first = open_.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= few).drop("_r")
        walked = stored(first.groupBy("session_id").applyInPandas(_prefix(cap), edges.withColumn("now", F.lit(True)).schema), "walked")
        taken.append(walked.where("now").select(*key))
        used = reduce(DataFrame.unionByName, taken).select("session_id", F.explode(F.array("left_ord", "right_ord")).alias("end")).groupBy("session_id", "end").agg(F.count(F.lit(1)).alias("n"))
        used = stored(used, "used")
        last = walked.groupBy("session_id").agg(F.max(place).alias("_last"))
        rest = open_.drop("left_used", "right_used").join(F.broadcast(last), "session_id").where(place > F.col("_last")).drop("_last")
        for side in ("left", "right"):
            end = used.select("session_id", F.col("end").alias(f"{side}_ord"), F.col("n").alias(f"{side}_used"))
            rest = rest.join(end, ["session_id", f"{side}_ord"], "left").na.fill(0, [f"{side}_used"]).where(F.col(f"{side}_used") < cap)
        open_ = stored(rest, "open")
    return reduce(DataFrame.unionByName, taken) if taken else edges.select(*key).limit(0)


def capped_pairs(pairs: DataFrame, cap: int = 8, kernel_pairs: int = KERNEL_PAIRS) -> DataFrame:
    """Walks a session's pairs by descending score, then left, then right, and keeps one if both ends have under cap kept.

    pairs is read several times: give it as a stored table.
    """
    key = ["session_id", "left_ord", "right_ord"]
    edges = pairs.select(*key, "candidate_score")
    sizes = edges.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.where(F.col("_n") > kernel_pairs).select("session_id")
    walk = lambda d: _sorted(d, CAP_ORDER).mapInArrow(_walk(cap), pairs.schema)
    if not big.head(1):
        return walk(pairs)
    kept = _rounds(edges.join(big, "session_id", "left_semi"), cap)
    return walk(pairs.join(big, "session_id", "left_anti")).unionByName(pairs.join(kept, key, "left_semi"))


#: Sessions with more decisions are compared and capped by lists of each decision's first pairs; all pairs of others are written.
LARGE = 500


def _listed_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The degree cap's walk over the listed edges of sessions, sorted, each once or twice: from the list of either end (end), with the room it has.

    An edge that only one end lists comes behind all that the other lists, between which and it there may be more. So an edge is kept if
    both list it and both have room whatever becomes of the edges left open before it; it is dropped if either is full; else it
    is left open. Gives kept edges and, without a right_ord, ends of open ones.
    """
    names = ["session_id", "left_ord", "right_ord"]
    session, last, room, sure, hanging = None, None, {}, {}, set()
    for p in chain(batches, [None]):
        made: list[tuple] = []
        if p is not None:
            kind = p.schema.field("session_id").type
        rows = ((None,) * 5,) if p is None else zip(*(p.column(c).to_pylist() for c in (*names, "end", "room")))
        for s, a, b, end, free in rows:
            twice = last == (a, b) and s == session
            if last and not twice:
                x, y = last
                if room[x] > 0 and room[y] > 0:
                    sure[x], sure[y] = sure[x] - 1, sure[y] - 1
                    hanging |= {x, y}
            if s != session:
                made += [(session, x, None) for x in hanging]
                session, room, sure, hanging = s, {}, {}, set()
            if end is not None and end not in room:
                room[end] = sure[end] = free
            if twice and room[a] > 0 and room[b] > 0:
                if sure[a] > 0 and sure[b] > 0:
                    room[a], room[b] = room[a] - 1, room[b] - 1
                    made.append((s, a, b))
                else:
                    hanging |= {a, b}
                sure[a], sure[b] = sure[a] - 1, sure[b] - 1
            last = None if twice or p is None else (a, b)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else pa.int32()) for k, c in enumerate(zip(*made))], names=names)


def _by_lists(codes: DataFrame, cap: int, block: int = similarity.BLOCK, least: int = similarity.NEAREST) -> DataFrame:
    """(session_id, left_ord, right_ord) of the pairs that the degree cap keeps of coded decisions, of which not all candidate pairs are ever held:
    rounds list the first candidate pairs of each decision that has room, walk the lists, and go on with the decisions that a list
    left open. The first open pair of all is first at both its ends, so each round keeps one at least; mostly few decisions go on."""
    by, kind = ["session_id", "ord"], codes.schema["session_id"].dataType.simpleString()
    open_, kept = stored(codes.withColumn("taken", F.array().cast("array<int>")), "decisions"), []
    while open_.head(1):
        lists = stored(similarity.nearest(open_, block, least), "nearest")
        key, other = F.col("key"), F.col("key").bitwiseAND(F.lit((1 << similarity.BITS) - 1)).cast("int")
        entries = lists.join(open_.select(*by, (F.lit(cap) - F.size("taken")).alias("room")), by).select(*by, "room", F.explode("keys").alias("key"))
        entries = entries.select("session_id", F.shiftright(key, similarity.BITS).cast("int").alias("low"), F.least("ord", other).alias("left_ord"), F.greatest("ord", other).alias("right_ord"), F.col("ord").alias("end"), "room")
        walked = stored(_sorted(entries, {"low": True, "left_ord": True, "right_ord": True}).mapInArrow(_listed_walk, f"session_id {kind}, left_ord int, right_ord int"), "walked")
        edges = walked.where("right_ord is not null")
        kept.append(edges)
        ends = F.explode(F.array(F.struct(F.col("left_ord").alias("ord"), F.col("right_ord").alias("other")), F.struct(F.col("right_ord").alias("ord"), F.col("left_ord").alias("other"))))
        now = edges.select("session_id", ends.alias("e")).groupBy("session_id", "e.ord").agg(F.collect_list("e.other").alias("_now"))
        hanging = walked.where("right_ord is null").select("session_id", F.col("left_ord").alias("ord"), F.lit(True).alias("_open"))
        left = lists.select(*by, "whole").join(hanging, by, "left").where("_open or not whole").select(*by).join(now, by, "left")
        taken = F.concat("taken", F.coalesce("_now", F.array().cast("array<int>")))
        open_ = stored(open_.join(left, by).withColumn("taken", taken).drop("_now").where(F.size("taken") < cap), "decisions")
    return reduce(DataFrame.unionByName, kept) if kept else codes.sparkSession.createDataFrame([], f"session_id {kind}, left_ord int, right_ord int")


def best_pairs(feats: DataFrame, cap: int = 8, large: int = LARGE) -> DataFrame:
    """The pairs that the degree cap keeps of all candidate pairs of decisions' features. Candidate pairs grow with a session's square; of
    sessions with more than large decisions they are compared but not written. feats is read several times."""
    sizes = feats.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select("session_id")
    if not sizes.head(1):
        return capped_pairs(stored(similarity.pairs(feats), "similar"), cap)
    codes = stored(similarity.coded(similarity.ranked(feats.join(F.broadcast(sizes), "session_id", "left_semi"))), "codes")
    made = similarity.rated(_by_lists(codes, cap), codes)
    small = feats.join(F.broadcast(sizes), "session_id", "left_anti")
    return made.unionByName(capped_pairs(stored(similarity.pairs(small), "similar"), cap)) if small.head(1) else made


#: If fewer than one open edge in so many is first at both its parts, a round walks the first edges instead.
SLOW = 20
NODE = "session_id {kind}, ord long, root long, left_ord long, right_ord long"


def _joining(most: int):
    """Joins the ends of sessions' sorted edges in order while the union has at most that many members. Ends are parts: a and b, with sizes
    a_size and b_size, which edges may already have joined. Gives each part's root, and the edges that joined something."""
    names = ["session_id", "ord", "root", "left_ord", "right_ord"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, up, size = None, {}, {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for p in chain(batches, [None]):
            made: list[tuple] = []
            ends = () if p is None else zip(*(p.column(c).to_pylist() for c in ("session_id", "a", "b", "a_size", "b_size", "left_ord", "right_ord")))
            for s, a, b, a_size, b_size, left, right in ends:
                if s != session:
                    made += [(session, x, top(x), None, None) for x in up]
                    session, up, size = s, {}, {}
                x, y = top(a), top(b)
                n = size.setdefault(x, a_size) + size.setdefault(y, b_size)
                if x != y and n <= most:
                    up[y], size[x] = x, n
                    made.append((s, None, None, left, right))
            if p is None:
                made += [(session, x, top(x), None, None) for x in up]
            else:
                kind = p.schema.field("session_id").type
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(zip(*made))], names=names)

    return kernel


def _joined(edges: DataFrame, most: int) -> DataFrame:
    kind = edges.schema["session_id"].dataType.simpleString()
    return _sorted(edges.select("session_id", "left_ord", "right_ord", "candidate_score", "strong_cluster_candidate", "a", "b", "a_size", "b_size"), JOIN_ORDER).mapInArrow(_joining(most), NODE.format(kind=kind))


def _first_walked(live: DataFrame, key: Column, most: int, few: int) -> tuple[DataFrame, DataFrame]:
    """(edges that joined something, parts with what they went into and its size) of the first few open edges of each session."""
    by = ["session_id"]
    place = F.row_number().over(W.partitionBy(*by).orderBy(key))
    first = live.withColumn("_k", place).where(F.col("_k") <= few).drop("_k")
    walked = stored(_joined(first, most), "walked")
    nodes = walked.where("root is not null").select(*by, F.col("ord").alias("old"), F.col("root").alias("new"))
    parts = first.select(*by, F.explode(F.array(F.struct(F.col("a").alias("old"), F.col("a_size").alias("size")), F.struct(F.col("b").alias("old"), F.col("b_size").alias("size")))).alias("p")).select(*by, "p.*").distinct()
    nodes = nodes.join(parts, [*by, "old"])
    grown = nodes.groupBy(*by, "new").agg(F.sum("size").alias("grown"))
    return walked.where("root is null"), nodes.join(grown, [*by, "new"]).select(*by, "old", "new", "grown")


def _contracted(edges: DataFrame, most: int, few: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, chosen, rest) of large sessions' edges: members are (session_id, ord, part, size), chosen edges joined something, and rest,
    at most few edges a session, join parts and are still open.

    Rounds on the graph of parts. As parts only grow, an edge inside a part or between parts that are too large together is out,
    whatever its turn. Of the others, one that comes first at both its parts has no earlier open edge that could change either: it is
    taken in the walk too. So each round takes the first edge of every pair of parts that agree on it, all at once, until few are left.
    Where hardly any agree (a chain of ever later edges), the round walks the first few edges of each session in a task instead, which
    no other edge comes before: so there are no more rounds than a logarithm of the edges, or edges / few.
    """
    by, key = ["session_id"], F.struct((~F.col("strong_cluster_candidate")).alias("late"), (-F.col("candidate_score")).alias("low"), "left_ord", "right_ord")
    kind = edges.schema["session_id"].dataType.simpleString()
    members = edges.select(*by, F.explode(F.array("left_ord", "right_ord")).alias("ord")).distinct().withColumn("part", F.col("ord")).withColumn("size", F.lit(1).cast("long"))
    members = stored(members, "members")
    open_ = stored(edges.withColumn("a", F.col("left_ord")).withColumn("b", F.col("right_ord")).withColumn("a_size", F.lit(1).cast("long")).withColumn("b_size", F.lit(1).cast("long")), "open")
    taken, rest = [], []
    while True:
        n = stored(open_.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "counts")
        rest.append(open_.join(n.where(F.col("_n") <= few), by, "left_semi"))
        large = n.where(F.col("_n") > few)
        if not large.head(1):
            break
        live = open_.join(large, by, "left_semi")
        ends = live.select(*by, key.alias("k"), "a", "b", "a_size", "b_size", F.explode(F.array("a", "b")).alias("end"))
        first = ends.groupBy(*by, "end").agg(F.min(F.struct("k", "a", "b", "a_size", "b_size")).alias("e"))
        agreed = stored(first.groupBy(*by, "e").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 2).select(*by, "e.a", "e.b", (F.col("e.a_size") + F.col("e.b_size")).alias("size"), F.col("e.k.left_ord").alias("left_ord"), F.col("e.k.right_ord").alias("right_ord")), "agreed")
        if agreed.count() * SLOW < (large.agg(F.sum("_n")).first()[0] or 0):
            chosen, moved = _first_walked(live, key, most, max(few, 1))
        else:
            chosen, moved = agreed, agreed.select(*by, F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), F.col("size").alias("grown"))
        taken.append(chosen.select(*by, "left_ord", "right_ord"))
        moved = stored(moved, "moved")
        members = stored(members.join(moved.withColumnRenamed("old", "part"), [*by, "part"], "left").select(*by, "ord", F.coalesce("new", "part").alias("part"), F.coalesce("grown", "size").alias("size")), "members")
        for end in ("a", "b"):
            live = live.join(moved.withColumnRenamed("old", end), [*by, end], "left").withColumn(end, F.coalesce("new", end)).withColumn(f"{end}_size", F.coalesce("grown", f"{end}_size")).drop("new", "grown")
        open_ = stored(live.where((F.col("a") != F.col("b")) & (F.col("a_size") + F.col("b_size") <= most)), "open")
    none = edges.sparkSession.createDataFrame([], f"session_id {kind}, left_ord long, right_ord long")
    return members, reduce(DataFrame.unionByName, taken, none), reduce(DataFrame.unionByName, rest)


def clustered(pairs: DataFrame, most: int = 12, kernel_pairs: int = KERNEL_PAIRS) -> DataFrame:
    """(session_id, ord, root, left_ord, right_ord): joins the ends of edges, strong ones first, then by score and keys, while the union has
    at most that many members. Rows with a root say where each end went, the others which edges joined something.

    A session of up to kernel_pairs edges is walked by one task, which takes many of them, edge by edge. In larger ones, rounds over DataFrames take all edges that the walk would take
    whatever else it does, until so few are left that a task can walk the parts. pairs is read several times: give it as a stored table.
    """
    e = pairs.select("session_id", F.col("left_ord").cast("long"), F.col("right_ord").cast("long"), "candidate_score", "strong_cluster_candidate")
    large = e.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > kernel_pairs).select("session_id")
    one = F.lit(1).cast("long")
    alone = lambda d: d.withColumn("a", F.col("left_ord")).withColumn("b", F.col("right_ord")).withColumn("a_size", one).withColumn("b_size", one)
    if not large.head(1):
        return _joined(alone(e), most)
    members, chosen, rest = _contracted(e.join(large, "session_id", "left_semi"), most, kernel_pairs)
    walked = stored(_joined(rest, most), "walked")
    ends = walked.where("root is not null").select("session_id", F.col("ord").alias("part"), "root")
    none = F.lit(None).cast("long")
    nodes = members.join(ends, ["session_id", "part"], "left").select("session_id", "ord", F.coalesce("root", "part").alias("root"), none.alias("left_ord"), none.alias("right_ord"))
    edges = walked.where("root is null").select("session_id", "left_ord", "right_ord").unionByName(chosen).select("session_id", none.alias("ord"), none.alias("root"), "left_ord", "right_ord")
    return _joined(alone(e.join(large, "session_id", "left_anti")), most).unionByName(nodes).unionByName(edges)


def mark_edges(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds selected_cluster_edge to pairs."""
    used = chosen.where("left_ord is not null").select("session_id", "left_ord", "right_ord", F.lit(True).alias("selected_cluster_edge"))
    return pairs.join(used, ["session_id", "left_ord", "right_ord"], "left").na.fill(False, ["selected_cluster_edge"])
