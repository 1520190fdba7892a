"""Toxicity: folding, the automaton against plain search, the lexicon's choice, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("text", ["trash", "TRASH", "tr4sh", "7r@$h", "tr\u0430sh", "\u0442r\u0430\u0455h", "tra\u0301sh", "t\u200br\u00adash", "\uff54\uff52\uff41\uff53\uff48", "trash!!!", "*trash*"])
def test_fold_finds_the_word(text):
    assert tx.fold(f"you {text}, 12 3456") == f" you {tx.fold('trash').strip()} "


def test_fold_of_odd_texts():
    assert [tx.fold(x) for x in (None, "", " \n", "123 4", "...")] == [" "] * 5
    assert tx.fold("l1Ii") == " iiii " and tx.fold("a_b") == " a b " and tx.fold("x" * 100_000) == f" {'x' * 100_000} "
    assert all(len(k) == len(v) == 1 for k, v in {**tx.HOMOGLYPHS, **tx.SUBSTITUTES}.items())


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_hits_are_those_of_plain_search(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(40)]
    folded = f" {' '.join(words)} "
    weights = {f" {w} " if r.random() < 0.5 else f" {w[:2]}": 1.0 for w in r.sample(words, 6)}
    lexicon = tx.Lexicon(weights)
    want = sorted((i, e) for e in weights for i in range(len(folded)) if folded.startswith(e, i))
    assert sorted(lexicon.hits(folded)) == want
    for at, _ in want:  # the phrases are the word with each neighbour
        k = folded[: at + 1].count(" ") - 1
        assert lexicon.phrases(folded, at) == [f" {a} {b} " for a, b in ([(words[k - 1], words[k])] if k else []) + ([(words[k], words[k + 1])] if k + 1 < len(words) else [])]
    lexicon.exceptions = frozenset(p for at, _ in want[:2] for p in lexicon.phrases(folded, at))
    assert sorted(lexicon.found(folded)) == [h for h in want if not lexicon.exceptions & set(lexicon.phrases(folded, h[0]))]
    n, kept = len(words), lexicon.found(folded)
    assert lexicon.features(folded) == pytest.approx([len(kept), len(kept) / n, len({e for _, e in kept}), len({e for _, e in kept}) / math.log2(n + 1), n])


def test_lexicon_takes_the_most_telling_of_a_word_and_its_beginnings():
    found = [(" badw", 90, 0), (" badwo", 90, 0), (" badword ", 90, 0), (" badg", 40, 60), (" badger ", 5, 60), (" badgood ", 30, 0), (" rare ", 3, 0), (" even ", 10, 90)]
    kept = tx.weigh(found, 100, 900)
    assert set(kept) in ({" badw", " badgood "}, {" badwo", " badgood "}, {" badword ", " badgood "})
    assert kept[" badgood "] == pytest.approx(math.log(30.5 / 101) - math.log(0.5 / 901))


def test_scale_is_the_minimum_of_its_loss():
    r = np.random.default_rng(2)
    x = np.abs(r.normal(size=(300, 5))) * [10, 0.3, 5, 1, 100] + [0, 0, 0, 0, 1]
    y = (x[:, 0] + r.normal(size=300) * 4 > 8).astype(float)
    scale = tx.fit_scale(x, y)
    d = (tx.Scale.columns(x) - scale.mean) / scale.spread
    p = scale.score(x)
    assert np.abs(np.append((p - y).sum(), d.T @ (p - y) + scale.weights[1:])).max() < 1e-4
    clear = tx.fit_scale(x, (x[:, 0] > 8).astype(float))  # rows that a line parts don't run away
    assert np.isfinite(clear.weights).all() and np.abs(clear.weights).max() < 1e3
    assert tx.fit_scale(x, np.ones(300)).score(x) == pytest.approx(301 / 302) and set(tx.fit_scale(x[:0], y[:0]).score(x)) == {0.5}


def some_docs():
    """Invented words; toxic rows hold one of three, clean ones one of them in a phrase."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("rstlnaeiou") for _ in range(r.randint(3, 8)))
    vocabulary = [word() for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        words = [r.choice(vocabulary) for _ in range(r.randint(5, 60))]
        y = int(i % 5 == 0)
        if y:
            words[r.randrange(len(words))] = r.choice(["wretch", "Swineface", "dunghead!"])
        elif i % 41 == 0:
            words += ["poor", "wretch", "indeed"]
        docs.append((i, " ".join(words)))
        labels.append((i, y))
    return docs, labels


def test_score_toxicity(spark):
    docs, labels = some_docs()
    docs += [(5, "again"), (1000, "you 5w1nef\u0430ce and dunghe4d"), (1001, None), (1002, ""), (1003, "word " * 200_000), (None, "swineface")]
    frame = spark.createDataFrame([(*d, 1.0, "z", 2) for d in docs], "doc_id long, text string, y double, folded string, toxic int").repartition(4)
    marks = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    rows = tx.score_toxicity(frame, marks).collect()
    assert len(rows) == len(docs) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    got, want = {r.doc_id: r for r in rows if r.doc_id != 5}, dict(labels)
    assert got[1000].predicted == 1 and got[None].predicted == 1 and got[1001].score == got[1002].score and not any(got[i].predicted for i in (1001, 1002, 1003))
    wrong = [i for i, r in got.items() if r.held_out and i in want and r.predicted != want[i]]
    assert len(wrong) <= 2
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels], "doc_id long, toxic int")
    assert {(r.doc_id, r.score) for r in tx.score_toxicity(frame, other).collect()} == {(r.doc_id, r.score) for r in rows}, "held-out labels are no input"


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([("a", "text"), ("b", None)], "doc_id string, text string"), spark.createDataFrame([], "doc_id string, toxic int")
    assert {(r.doc_id, r.score) for r in tx.score_toxicity(docs, none).collect()} == {("a", 0.5), ("b", 0.5)}
    assert tx.score_toxicity(docs.limit(0), none).collect() == []


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").select("predicted", "toxic").collect()
    hit, bad, lost = (sum((r.predicted, r.toxic) == x for r in rows) for x in ((1, 1), (1, 0), (0, 1)))
    assert hit / (hit + lost) > 0.9 and hit / (hit + bad) > 0.9
