"""The pipeline's stages on small tables."""

from collections import Counter

import corpus_pipeline
from recordloom.llm.mixing import mix
from recordloom.llm.quality import score_quality
from test_near_copies import brute_kept, planted
from test_operators import brute_leaks, empty, make


def test_leaks_of_items_without_an_id(spark, tmp_path):
    words = [f"w{i}" for i in range(30)]
    spark.createDataFrame([(None, " ".join(words[:15])), (7, "nothing like it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, " ".join(["so", *words])), (2, " ".join(words[::-1]))], "doc_id long, text string")
    assert [x.doc_id for x in corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)).collect()] == [2]


def test_stages_and_run(spark, tmp_path):
    values = planted(30, 8)
    passage = " ".join(f"bench{i}" for i in range(14))
    values += [f"so {passage} said", f"{values[20]} {passage}", passage.upper()]
    rows, docs = make(spark, values, True)
    items = [(1, passage), (None, "w1 w2 w3"), (2, None), (3, "")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(len(values))], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf_dir = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)

    def stage(k, d):
        d = spark.createDataFrame(corpus_pipeline.STAGES[k][1](spark, d, sf_dir).collect(), d.schema)
        return d, [tuple(r) for r in d.collect()]

    bad = {r.doc_id for r in score_quality(docs, labels).collect() if r.predicted == 0}
    now, got = stage(0, docs)
    want = [r for r in rows if r[0] not in bad]
    assert Counter(got) == Counter(want) and want
    now, got = stage(1, now)
    assert Counter(r[0] for r in got) == brute_kept(want) and not Counter(got) - Counter(want) and len(got) < len(want)
    want = [r for r in got if not any(k[2] for k in brute_leaks([r], [(-1 if i is None else i, t) for i, t in items]))]
    assert len(want) < len(got)
    now, got = stage(2, now)
    assert Counter(got) == Counter(want)
    copies = {}
    for r in mix(now).collect():
        copies[r.doc_id] = max(copies.get(r.doc_id, 0), int(r.copies))
    want = Counter()
    for r in got:
        want[r] += copies[r[0]]
    now, got = stage(3, now)
    assert Counter(got) == +want and max(want.values()) > 1
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(r[0] for r in got)


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0


def test_clashing_columns_and_long_texts(spark, tmp_path):
    """Columns with the operators' own names stay as they are, and texts of a million characters are judged whole."""
    passage = " ".join(f"bench{i}" for i in range(14))
    long_ = " ".join(f"word{i % 5003}" for i in range(150_000))
    texts = [f"{long_} {passage}", long_, f"{long_} and an end", None, "", *(f"plain text number {i} of its own kind, {i * 7} and {i * 11}" for i in range(30))]
    clash = ["id", "_id", "copies", "_copies", "copy", "predicted", "score", "size", "source_size", "target", "rate", "u", "k1", "n_hit", "cls", "bucket", "x", "y", "keep"]
    rows = [(i, t, f"s{i % 3}", *[f"c{i}"] * len(clash)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in clash))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = [r.doc_id for r in docs.collect()]
    for k, want in enumerate([set(now), set(now) - {1, 2, 4}, set(now) - {0, 1, 2, 4}]):  # near copies of row 0, the empty twin of row 3, then its passage
        docs = spark.createDataFrame(corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).collect(), docs.schema)
        got = docs.collect()
        assert {r.doc_id for r in got} == want and all(r[c] == f"c{r.doc_id}" for r in got for c in clash), k
    copies = {r.doc_id: r.copies for r in mix(docs).collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +Counter(copies)
