"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, pick

#: Most labelled rows that a model is fitted on: those with the smallest digests of their ids.
SAMPLE = 20_000
FEATURES = ("log_bytes", "log_words", "word_length", "word_length_sd", "upper", "lower", "digit", "high", "space", "newline", "stop_marks",
            "comma", "exclaim", "bar", "symbols", "brackets", "distinct_words", "top_word", "repeat_next", "top_pair", "distinct_lines",
            "line_words", "capital_words", "upper_words", "long_words", "entropy", "top_line", "top_third")
_GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "high": bytes(range(128, 256)), "space": b" \t",
           "newline": b"\n", "stop_marks": b".?;:", "comma": b",", "exclaim": b"!", "bar": b"|", "symbols": b"#$%&*+=@\\^_~", "brackets": b"()<>[]{}/\"'"}
_MAP = np.full(256, len(_GROUPS), np.uint8)
for _i, _g in enumerate(_GROUPS.values()):
    _MAP[list(_g)] = _i


def statistics(text: bytes | None) -> list[float]:
    """The features of a text, in the order of FEATURES; a null text counts as empty."""
    text = text or b""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    shares = np.bincount(_MAP, counts, len(_GROUPS) + 1)[: len(_GROUPS)] / max(n, 1)
    p = counts[counts > 0] / max(n, 1)
    words = text.split()
    m = len(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    tally = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    line_tally = Counter(lines)
    top = sorted(tally.values(), reverse=True)[:3]
    return [np.log1p(n), np.log1p(m), lengths.mean() if m else 0.0, lengths.std() if m else 0.0, *shares.tolist(), len(tally) / max(m, 1), (top[0] if top else 0) / max(m, 1),
            sum(map(bytes.__eq__, words, words[1:])) / max(m - 1, 1), max(pairs.values(), default=0) / max(m - 1, 1), len(line_tally) / max(len(lines), 1), m / max(len(lines), 1),
            sum(map(bytes.istitle, tally)) / max(len(tally), 1), sum(map(bytes.isupper, tally)) / max(len(tally), 1), float((lengths > 14).mean()) if m else 0.0,
            float(-(p * np.log2(p)).sum()), max(line_tally.values(), default=0) / max(len(lines), 1), sum(top) / max(m, 1)]


class Trees:
    """Trees flattened into arrays of 2**depth - 1 inner nodes and 2**depth leaves each, in heap order."""

    def __init__(self, depth: int, bias: float):
        self.depth, self.bias = depth, bias
        self.feature, self.cut, self.leaf = [], [], []

    def add(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.feature.append(feature)
        self.cut.append(cut)
        self.leaf.append(leaf)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaves, a level of one tree at a time for all rows."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (1 << self.depth) + 1]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting on histograms of at most bins quantiles per feature. Without rows, or rows of one label, the score is a constant."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    model = Trees(depth, float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    f = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    flat = binned + np.arange(f) * bins
    raw = np.full(n, model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node, inner = np.zeros(n, np.int64), (1 << depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            at = ((node - first)[:, None] * (f * bins) + flat).ravel()
            gs, hs = (np.bincount(at, np.repeat(v, f), width * f * bins).reshape(width, f, bins) for v in (g, h))
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            won = gain.reshape(width, -1).max(1) > 1e-9
            for k in np.flatnonzero(won):
                j, b = divmod(int(best[k]), bins)
                feature[first + k], cut[first + k] = j, cuts[j][b] if b < len(cuts[j]) else np.inf
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf_of = node - inner
        gs, hs = (np.bincount(leaf_of, v, 1 << depth) for v in (g, h))
        leaf = -rate * gs / (hs + ridge)
        model.add(feature, cut, leaf)
        raw = raw + leaf[leaf_of]
    return model


def held_out(doc_id):
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def least(rows: DataFrame, n: int) -> DataFrame:
    """The n of rows (with id) with the smallest digests of their ids. Only rows under a digest that leaves somewhat more than n
    are sorted, so that what partitions hand over doesn't grow with their number."""
    k = F.md5(F.col("id").cast("string"))
    share = F.conv(F.substring(k, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    total = rows.count()
    bound = 1.2 * n / total if total else 1.0
    while bound < 1 and rows.where(share < bound).count() < n:
        bound *= 2
    return (rows.where(share < bound) if bound < 1 else rows).orderBy(k, "id", "y").limit(n)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Statistics of whole texts are computed once and stored; the model is fitted on at most sample labelled rows that aren't
    held out, brought to the driver (sample * len(FEATURES) doubles, 4.5 MB), and scores all stored rows. Labels, language,
    source and id are no inputs. Rows with a null label are left out of the fit; a document labelled twice counts twice.
    Null and empty texts have a score like others; repeated rows each a row; without labels all scores are one half; an empty table gives no rows;
    further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    base = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    stats = map_batches(base, lambda c: {"id": c["id"], "x": [statistics(t) for t in c["text"]]}, f"id {kind}, x array<double>")
    stats = scratch.store(stats, "statistics")
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")).where("y is not null and id is not null").where(~held_out(F.col("id")))
    joined = scratch.store(stats.join(known, "id").select("x", "y", "id"), "labelled")  # read to count, to bound and to sort
    taken = least(joined, sample).toPandas()
    x = np.array(taken["x"].tolist(), float).reshape(-1, len(FEATURES))
    model = spark.sparkContext.broadcast(fit(x, (taken["y"].to_numpy(float) > 0).astype(float)))

    def run(cols: dict) -> dict:
        s = model.value.score(np.array(cols["x"], float).reshape(-1, len(FEATURES)))
        return {"id": cols["id"], "score": s.tolist(), "predicted": (s >= 0.5).astype(int).tolist()}

    made = map_batches(stats, run, f"id {kind}, score double, predicted int")
    return made.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", "predicted")
