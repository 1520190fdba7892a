"""Toxicity: a weighted lexicon, found by an Aho-Corasick automaton in folded texts, normalised by length."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, pick
from .quality import least

#: Most labelled rows that the lexicon and its scale are learned from: those with the smallest digests of their ids.
SAMPLE = 20_000
#: Most entries of the lexicon, and most candidates for it that come to the driver.
ENTRIES, CANDIDATES = 4000, 40_000
#: An entry is a whole word or the beginning of words, of so many letters.
BEGINNINGS = (4, 5, 6, 7, 8)
#: An entry must stand in so many toxic rows, and be so many times as frequent in them as in others.
ROWS, RATIO = 4, 8.0
#: A phrase of an entry and a neighbouring word is an exception if so many clean rows have it and no toxic one.
CLEAN_ROWS = 3
#: Rows with a score of so much are predicted toxic.
BAR = 0.3

# Letters of other scripts and the Latin ones that they look like; digits and signs and the letters that they stand for;
# letters that the digit 1 stands for as well; marks and invisible characters that are left out.
HOMOGLYPHS = {"а": "a", "в": "b", "г": "r", "е": "e", "з": "e", "и": "n", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ч": "4", "ь": "b",
              "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ɑ": "a", "ɡ": "g", "ɩ": "i", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
              "χ": "x", "ω": "w", "ϲ": "c", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l", "l": "i"}
LEFT_OUT = [*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x20D0, 0x2100), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFE0E, 0xFE0F, 0xFEFF]

_FOLD = {ord(k): SUBSTITUTES.get(v, v) for k, v in HOMOGLYPHS.items()} | {ord(k): SUBSTITUTES.get(v, v) for k, v in SUBSTITUTES.items()} | dict.fromkeys(LEFT_OUT)
_NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """Words in lower case with a space between, before and behind them, without accents, look-alikes and substitutions; numbers
    that stand by themselves are left out. A null text is a single space."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
    words = _WORD.findall(_NUMBER.sub(" ", t).translate(_FOLD))
    return f" {' '.join(words)} " if words else " "


def entries_of(folded: str) -> set[str]:
    """Candidates that a text holds: its words, and their beginnings."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for n in BEGINNINGS:
        out.update([f" {w[:n]}" for w in words if len(w) >= n])
    return out


def weigh(found: list[tuple[str, int, int]], toxic: int, clean: int, most: int = ENTRIES) -> dict[str, float]:
    """Entries with their weights (log of the ratio of shares) of candidates (entry, toxic rows, clean rows), the most telling first.
    Of a word and its beginnings the one is taken that tells most, and another only if it tells more by itself than those with it."""
    rated = []
    for entry, t, c in found:
        w = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
        if t >= ROWS and w >= np.log(RATIO):
            rated.append((-(t - c * toxic / max(clean, 1)) * w, entry, w))
    kept: dict[str, float] = {}
    covered: set[str] = set()
    for _, entry, w in sorted(rated):
        bare = entry.strip()
        if any(f" {bare[:n]}" in kept for n in range(1, len(bare) + (entry[-1] == " "))) or bare in covered:
            continue
        kept[entry] = w
        covered.update(bare[:n] for n in range(1, len(bare) + 1))
        if len(kept) == most:
            break
    return kept


class Lexicon:
    """Weighted entries in an automaton, exception phrases, and the scale that makes a score of what is found."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.exceptions, self.scale = weights, frozenset(), None
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def hits(self, folded: str) -> list[tuple[int, str]]:
        """(start, entry) of all entries found, overlapping ones too."""
        if self._automaton is None and self.weights:
            self._automaton = ahocorasick.Automaton()
            for entry in self.weights:
                self._automaton.add_word(entry, entry)
            self._automaton.make_automaton()
        return [(end - len(entry) + 1, entry) for end, entry in self._automaton.iter(folded)] if self.weights else []

    def phrases(self, folded: str, start: int) -> list[str]:
        """The word that begins behind start, with the word before and with the word after."""
        end = folded.find(" ", start + 1)
        before, after = folded.rfind(" ", 0, start), folded.find(" ", end + 1)
        return ([folded[before:end + 1]] if before >= 0 else []) + ([folded[start:after + 1]] if after >= 0 else [])

    def found(self, folded: str) -> list[tuple[int, str]]:
        hits = self.hits(folded)
        return [h for h in hits if not self.exceptions.intersection(self.phrases(folded, h[0]))] if self.exceptions else hits

    def features(self, folded: str) -> list[float]:
        """Sum of weights, its share of the words, number of different entries' weights summed, number of words."""
        hits = self.found(folded)
        n = max(folded.count(" ") - 1, 1)
        total = sum(self.weights[e] for _, e in hits)
        once = sum(self.weights[e] for e in {e for _, e in hits})
        return [total, total / n, once, once / np.log2(n + 1), float(n)]


class Scale:
    """A score of a text's features: logistic in their roots and logarithms."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.mean, self.spread, self.weights = mean, spread, weights

    @staticmethod
    def columns(x: np.ndarray) -> np.ndarray:
        total, share, once, dense, n = x.T
        return np.column_stack([np.log1p(total), np.minimum(share, 2) ** 0.5, np.log1p(once), np.log1p(dense), np.log(n)])

    def score(self, x: np.ndarray) -> np.ndarray:
        d = (self.columns(x) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + d @ self.weights[1:], -30, 30)))


def fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Scale:
    """Ridge logistic regression by Newton's method, halving steps that don't lower the loss. Without rows of both labels the score is
    a constant."""
    d = Scale.columns(x) if len(x) else np.zeros((0, 5))
    share = (y.sum() + 1) / (len(y) + 2)
    weights = np.append(np.log(share / (1 - share)), np.zeros(5))
    if len(y) == 0 or y.min() == y.max():
        return Scale(np.zeros(5), np.ones(5), weights)
    mean, spread = d.mean(0), np.maximum(d.std(0), 1e-9)
    d = np.column_stack([np.ones(len(d)), (d - mean) / spread])
    penalty = ridge * np.append(0, np.ones(5))

    def loss(w: np.ndarray) -> float:
        z = d @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (penalty * w * w).sum() / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
        step = np.linalg.solve((d * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ d + np.diag(penalty + 1e-9), d.T @ (p - y) + penalty * weights)
        size, before = 1.0, loss(weights)
        while size > 1e-6 and loss(weights - size * step) > before:
            size /= 2
        weights = weights - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return Scale(mean, spread, weights)


def held_out(doc_id):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(rows: DataFrame, of) -> DataFrame:
    """(entry, toxic rows, clean rows) that have what of gives for a row's folded text; counted batch by batch, then added up."""
    def run(cols: dict) -> dict:
        both = Counter(), Counter()
        for y, folded in zip(cols["y"], cols["folded"]):
            both[0 if y else 1].update(of(folded))
        found = list(both[0].keys() | both[1].keys())
        return {"entry": found, "toxic": [both[0][e] for e in found], "clean": [both[1][e] for e in found]}

    return map_batches(rows.select("y", "folded"), run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(rows: DataFrame) -> tuple[Lexicon, Scale]:
    """Lexicon and scale of labelled rows (y, folded), read several times. To the driver come CANDIDATES entries and as many exceptions
    at most, and five numbers a row."""
    spark = rows.sparkSession
    toxic, clean = (n or 0 for n in rows.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first())
    told = _counted(rows, entries_of).where((F.col("toxic") >= ROWS) & ((F.col("toxic") + 0.5) / (toxic + 1) >= RATIO * (F.col("clean") + 0.5) / (clean + 1)))
    found = [tuple(r) for r in told.orderBy(F.desc("toxic"), "clean", "entry").limit(CANDIDATES).collect()]
    lexicon = Lexicon(weigh(found, toxic, clean))
    known = spark.sparkContext.broadcast(lexicon)
    phrases = _counted(rows, lambda folded: {p for at, _ in known.value.hits(folded) for p in known.value.phrases(folded, at)}).where(f"toxic = 0 and clean >= {CLEAN_ROWS}")
    lexicon.exceptions = frozenset(r[0] for r in phrases.orderBy(F.desc("clean"), "entry").limit(CANDIDATES).select("entry").collect())
    known = spark.sparkContext.broadcast(lexicon)
    made = map_batches(rows.select("y", "folded"), lambda c: {"y": c["y"], "x": [known.value.features(t) for t in c["folded"]]}, "y double, x array<double>").toPandas()
    return lexicon, fit_scale(np.array(made["x"].tolist(), float).reshape(-1, 5), (made["y"].to_numpy(float) > 0).astype(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Texts are folded to Latin letters; a lexicon of words and beginnings of words, each weighted by how much more frequent it is in
    toxic rows, is looked up by an Aho-Corasick automaton in whole texts, and a logistic scale sets the sums of weights against the
    number of words. Hits inside a phrase that only clean rows have don't count. All three are learned from sample labelled rows
    at most that aren't held out; of equal folded texts with one label one counts. Labels, language, source and id are no inputs.

    Rows with a null label or id are left out of the learning; a document labelled twice counts twice. Null and empty texts get the
    score of a text without hits, repeated rows each a row; without labels all scores are one half. An empty table gives none;
    further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    base, kind = pick(docs, id=id_col, text=text_col), docs.schema[id_col].dataType.simpleString()
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("y")).where("y is not null and id is not null").where(~held_out(F.col("id")))
    taken = least(known, sample)  # sample rows at most: small enough to broadcast
    rows = base.join(F.broadcast(taken), "id").select("text", (F.col("y") > 0).cast("double").alias("y"))
    rows = map_batches(rows, lambda c: {"y": c["y"], "folded": list(map(fold, c["text"]))}, "y double, folded string")
    model = spark.sparkContext.broadcast(learn(scratch.store(rows.dropDuplicates(["y", "folded"]), "learned")))

    def run(cols: dict) -> dict:
        lexicon, scale = model.value
        s = scale.score(np.array([lexicon.features(fold(t)) for t in cols["text"]], float).reshape(-1, 5))
        return {"id": cols["id"], "score": s.tolist(), "predicted": (s >= BAR).astype(int).tolist()}

    made = map_batches(base, run, f"id {kind}, score double, predicted int")
    return made.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", "predicted")
