"""Dependency spans against going up from every token; annotators from the verbs."""

import random

import pytest

from recordloom import errors
from recordloom.operators import signals
from recordloom.plans import shaped, verbs


def below(tokens, top):
    """All tokens from which the chain of heads reaches top."""
    head = {i: h for i, h, _, _ in tokens}
    found = set()
    for i in head:
        seen, x = set(), i
        while x not in seen and x in head:
            if x == top:
                found.add(i)
                break
            seen.add(x)
            x = head[x]
    return found


@pytest.mark.parametrize("seed", range(60))
def test_spans_below(seed):
    r = random.Random(seed)
    n = r.randint(1, 25)
    tokens = [(i, r.choice([i, r.randrange(n), r.randrange(n), n + 5]), k, k + r.randint(1, 3)) for i, k in enumerate(r.sample(range(100), n))]
    got = signals.spans_below(tokens)
    for top in range(n):
        some = [tokens[i] for i in below(tokens, top)]
        assert got[top] == (min(t[2] for t in some), max(t[3] for t in some))


def test_deep_chain():
    n = 200_000
    got = signals.spans_below([(i, max(i - 1, 0), i, i + 1) for i in range(n)])
    assert got[0] == (0, n) and got[n - 1] == (n - 1, n) and got[5] == (5, n)


def test_dependency_signals(spark):
    text = "x y decide early because z"
    words = [(m, text.index(m)) for m in text.split()]
    heads, deps = [0, 0, 0, 4, 2, 4], ["root", "dep", "dep", "dep", "advcl", "dep"]
    rows = [(s, "M1", i, w, w, deps[i], heads[i], a, a + len(w)) for s in ("s", "t") for i, (w, a) in enumerate(words)]
    tokens = spark.createDataFrame(rows[::-1], signals.TOKENS)
    texts = spark.createDataFrame([("s", "M1", text), ("t", "M1", text), ("u", "M1", "no token"), ("v", "M1", None)], "session_id string, evidence_id string, content string")
    d = signals.dependency_signals(tokens, texts, ("decide",), ("advcl",), "because")
    assert sorted((r.session_id, r.trigger, r.char_start, r.char_end, r.reason) for r in d.collect()) == [(s, "decide", 11, 26, "early because z") for s in "st"]
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert signals.dependency_signals(tokens.limit(0), texts).collect() == []


def test_annotators_are_refused_if_missing(spark):
    m = spark.createDataFrame([("s", "M1", "human", 1, "x")], "session_id string, evidence_id string, actor string, source_line int, content string")
    for more in ({"annotators": ("none",)}, {"annotators": ("lemma",)}, {"annotators": ("dependency",), "analyser": "no.such:thing"}, {"annotators": ("lemma",), "analyser": "recordloom.plans.shaped:absent"}, {"annotators": ("lemma",), "analyser": "spacy:no_such_model"}):
        with pytest.raises(errors.SignalFailure):
            signals.annotate(m, **more)
    assert verbs.named(" lemma, dependency,") == ("lemma", "dependency") and shaped.toy_analyser()(["a b"])[0][1][3] == 0


def test_dependencies_of_more_tokens_than_are_held_at_once(spark):
    """Messages are folded some at a time, each by its own tokens: here 3 by 9,000 and some short ones, one without a hit."""
    many = 9_000
    tokens = [("s", f"m{m}", i, f"t{i}", "する" if i == 0 else "x", "advcl" if i == 2 else "dep", 0, 2 * i, 2 * i + 1) for m in range(3) for i in range(many)]
    tokens += [("s", f"k{m}", i, f"t{i}", "する" if i == 0 and m else "x", "advcl" if i == 2 else "dep", 0, 2 * i, 2 * i + 1) for m in range(4) for i in range(3)]
    text = "a b " + "ので " * many
    texts = [("s", f"m{m}", text) for m in range(3)] + [("s", f"k{m}", "a b ので") for m in range(4)] + [("s", "none", "x")]
    d = signals.dependency_signals(spark.createDataFrame(tokens, signals.TOKENS).coalesce(1), spark.createDataFrame(texts, "session_id string, evidence_id string, content string"), words="の")
    assert sorted((r.evidence_id, r.trigger, r.char_start, r.reason) for r in d.collect()) == [(f"k{m}", "t0", 4, "の") for m in (1, 2, 3)] + [(f"m{m}", "t0", 4, "の") for m in range(3)]
    plan = d._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "MapInArrow" in plan
