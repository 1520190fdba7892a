import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import shape, text

SOME = ["", " a ", "　全角　", "ＡＢＣ d-e", "ab", "abc", "abcd", "Straße №1", "𠀀𠀁𠀂𠀃", "a\nb\tc d", "ﬁne ﬀ", "é e\u0301"]


def column(spark, values, *exprs):
    return [tuple(r) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").orderBy("i").select(*exprs).collect()]


def plain(x):
    return "".join(c for c in unicodedata.normalize("NFKC", x).lower() if c.isalnum())


def grams(x):
    return {x} if 0 < len(x) <= 3 else {x[i : i + 3] for i in range(len(x) - 2)}


def test_strip_normalize_trigrams(spark):
    c = F.col("c")
    got = column(spark, SOME, text.strip(c), text.normalized(c), text.trigrams(text.normalized(c)))
    for v, (s, n, g) in zip(SOME, got):
        assert s == v.strip() and n == plain(v) and set(g) == grams(plain(v)) and len(set(g)) == len(g)


def test_similarities(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"]), (["x"], ["x"])]
    d = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [tuple(r) for r in d.select(text.dice(F.col("a"), F.col("b")), text.jaccard(F.col("a"), F.col("b")), text.dice(F.col("b"), F.col("a"))).collect()]
    assert got == [(1.0, 0.0, 1.0), (0.0, 0.0, 0.0), (0.5, 1 / 3, 0.5), (1.0, 1.0, 1.0)]


def test_terms_and_keywords(spark):
    got = column(spark, ["Use Foo_Bar v1.2.3 on C:/x", "revert it", "PR #12 ready", "廃止する"], text.tech_terms(F.col("c")), text.contains_any(F.col("c"), text.LIFECYCLE_TERMS), text.contains_any(F.col("c"), text.ROUTINE_TERMS))
    assert sorted(got[0][0]) == ["1.2.3", "foo_bar", "use"] or "foo_bar" in got[0][0]
    assert [g[1] for g in got] == [False, True, False, True] and [g[2] for g in got] == [False, False, True, False]


def test_small_functions(spark):
    d = spark.createDataFrame([("SEC-012", "tool-call x1y", 1.0, 8.0), (None, None, 1.0, 0.0)], "s string, r string, a double, b double")
    got = [tuple(r) for r in d.select(text.section_number(F.col("s")), text.role_title(F.col("r")), text.percent(F.col("a"), F.col("b")), text.reduction(F.col("a"), F.col("b"))).collect()]
    assert got == [(12, "Tool-Call X1Y", "12.50%", 0.875), (None, "Unknown", "0.00%", 0.0)]


@pytest.mark.parametrize("name", ["bad", "SEC-1", "SEC-1234", "SEC-01a", "SEC-001\n"])
def test_other_section_ids_raise(spark, name):
    with pytest.raises(Exception, match="invalid Section id"):
        column(spark, [name], text.section_number(F.col("c")))


def test_blocks(spark):
    got = column(spark, ["a<APP-context x=1>\nz</app-context>b", "<environment_context>q</environment_context>", "<other>k</other>"], text.strip_blocks(F.col("c")))
    assert [g[0] for g in got] == ["ab", "", "<other>k</other>"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab3é ＡＢ\n-", max_size=12), min_size=1, max_size=20))
def test_normalized_agrees(spark, values):
    got = column(spark, values, text.normalized(F.col("c")))
    assert [g[0] for g in got] == [plain(v) for v in values]


def test_guards(spark):
    docs = ['{"a": "x", "b": 3, "c": [1], "d": {}, "e": null}']
    v = F.parse_json("c")
    got = column(spark, docs, shape.text_at(v, "a"), shape.text_at(v, "b"), shape.is_kind(shape.at(v, "c"), "ARRAY"), shape.is_kind(shape.at(v, "d"), "OBJECT"), shape.is_kind(shape.at(v, "e"), "VOID"), shape.is_kind(shape.at(v, "z"), "VOID"),
                 shape.keys_are(F.col("c"), ("e", "a", "b", "c", "d")), shape.keys_are(F.col("c"), ("a",)))
    assert got == [("x", None, True, True, True, False, True, False)]


def test_first_code_keeps_order(spark):
    d = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 0)], "a int, b int")
    got = [r[0] for r in d.select(shape.first_code(("first", F.col("a") == 1), ("second", F.col("b") == 1))).collect()]
    assert got == [None, "first", "first", "second"]
    assert re.match("x", "x") and pytest
