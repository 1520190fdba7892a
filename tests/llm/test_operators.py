"""The training-data operators against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from recordloom.llm import chat_format, common, decontamination, exact_dedup, license_scan, mixing, quality, repeats, simhash, sql, token_counts, token_store
from recordloom.llm.common import Scratch

CLASH = ["id", "h", "sha", "norm", "n", "k1", "_id", "size", "bucket", "row", "copies", "fp", "key", "_text"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def texts(seed=7, n=60):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "é", "zeta", "eta", "x1", "über", "tau,"]
    some = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(n)]
    return [None, "", " \n\t", "a b c", "a b c", "a  b c", "A b\xa0c é", "Ω" * 300, *some, some[0], some[0] + " ", some[1].upper(), " ".join(some[:12]) * 40]


def make(spark, values, sources=False):
    rows = [(i if i != 5 else 4, t, None if i % 7 == 0 else f"s{i % 3}", *[f"c{i}"] * len(CLASH)) for i, t in enumerate(values)]
    rows.append((None, "null id", "s1", *["x"] * len(CLASH)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, id string")


def by_rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# 1


def words_of(t):
    return WORD.findall((t or "").translate(LOWER))


def brute_leaks(rows, items, n=10):
    out = Counter()
    for doc, text, *_ in rows:
        w, hit, found = words_of(text), set(), set()
        for item, it in items:
            iw = words_of(it)
            k = min(n, len(iw))
            grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw and item is not None else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
        out[doc, len(w), len(hit), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("block", [decontamination.BLOCK, 3])
def test_decontamination(spark, block):
    values = texts()
    rows, docs = make(spark, values)
    items = [(1, values[10]), (2, "a B. c"), (11, "nothing like it at all"), (3, None), (4, "..."), (None, values[11]), (5, values[12]), (5, values[12]), (6, values[10])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_leaks(docs, bench, block=block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute_leaks(rows, items)
    assert all(sum(h.number for h in r.hits) == r.n_hit for r in got)
    kept = decontamination.drop_leaked(docs, bench, block=block)
    assert kept.columns == docs.columns
    assert by_rows(kept, "doc_id", "text") == Counter((r[0], r[1]) for r in rows if not any(k[2] for k in brute_leaks([r], items)))
    assert decontamination.find_leaks(empty(spark), bench).count() == 0
    none = decontamination.find_leaks(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_hit for r in none)


def test_cut_spans():
    assert decontamination.cut_spans("One, two THREE four".encode(), [(1, 2)]) == b"One,  four"
    assert decontamination.cut_spans(None, [(0, 1)]) is None


# 2


def test_exact_dedup(spark):
    rows, docs = make(spark, texts())
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups["".join(c for c in text or "" if c not in SPACES)].append((-len(text or ""), doc is None, doc))
    want = Counter()
    for doc, text, *_ in rows:
        norm = "".join(c for c in text or "" if c not in SPACES)
        keep = min(groups[norm])[2]
        want[doc, keep, len(groups[norm]), doc == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    for capacity in (exact_dedup.CAPACITY, 1):
        assert by_rows(exact_dedup.exact_dedup(docs, capacity=capacity), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_directory_splits(spark):
    keys = spark.range(4000).selectExpr("xxhash64(id) AS h")
    d = exact_dedup.build_directory(Scratch(spark, "t"), keys, 200)
    held = keys.withColumn("leaf", exact_dedup.leaf_of(keys.h)).join(d, "leaf")
    assert held.count() == 4000
    assert held.groupBy("bucket", "local_depth").count().agg({"count": "max"}).first()[0] <= 200
    assert d.agg({"pages": "max"}).first()[0] == 1


def test_buckets_at_full_depth_have_pages(spark):
    keys = spark.range(3000).selectExpr("shiftrightunsigned(xxhash64(id), 16) AS h")
    d = exact_dedup.build_directory(Scratch(spark, "t"), keys, 100)
    assert [(r.local_depth, r.pages) for r in d.collect()] == [(exact_dedup.MAX_DEPTH, 30)]
    held = exact_dedup._owned(keys, d).groupBy("bucket", "page").count()
    assert held.count() == 30 and held.agg({"count": "max"}).first()[0] < 200


def test_results_come_through_the_index(spark):
    _, docs = make(spark, texts())
    scratch = Scratch(spark, "t")
    exact_dedup.build_index(docs, scratch, capacity=4)
    index = spark.read.parquet(scratch.path("index"))
    before = by_rows(exact_dedup.probe(scratch), "id", "keep_id", "group_size")
    hot = index.orderBy("group_size", ascending=False).first()
    assert hot.group_size > 1
    scratch.store(index.selectExpr("bucket", "page", "h", "link", "tag", "group_size", f"IF(h = {hot.h}, -7, keep_id) AS keep_id"), "index-2")
    scratch.drop("index")
    scratch.store(spark.read.parquet(scratch.path("index-2")), "index")
    after = by_rows(exact_dedup.probe(scratch), "id", "keep_id", "group_size")
    assert sum((before - after).values()) == hot.group_size == sum(n for k, n in after.items() if k[1] == -7)
    scratch.drop("directory")
    scratch.store(spark.createDataFrame([], "leaf int, bucket int, local_depth int, pages int"), "directory")
    assert exact_dedup.probe(scratch).count() == 0


def test_colliding_texts_are_chained_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: exact_dedup.F.length(c).cast("long"))
    rows, docs = make(spark, texts())
    got = by_rows(exact_dedup.exact_dedup(docs, capacity=3), "doc_id", "keep_id", "group_size")
    monkeypatch.undo()
    assert got == by_rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size")


# 3


def test_mixing_matches_sql_and_targets(spark):
    rows, docs = make(spark, texts(3, 400))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    cur = con.execute(sql.OP3)
    names = [c[0] for c in cur.description]
    want = Counter(tuple(float(x) if isinstance(x, float) else x for x in r) for r in cur.fetchall())
    made = mixing.mix(docs)
    got = Counter(tuple(r[n] for n in names) for r in made.collect())
    assert got == want
    assert by_rows(mixing.mix(docs.repartition(7)), *names) == got
    largest = max(len((t or "").split()) for _, t, *_ in rows)
    for r in made.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= largest
    assert all(r.taken <= 3 * r["size"] for r in made.collect())
    assert mixing.mix(empty(spark)).count() == 0


def test_targets_are_capped_and_reshared(spark):
    d = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(d).collect()}
    assert got["a"] == 30 and got["c"] == 15 and got[None] == 0 and abs(sum(got.values()) - 1015) < 1e-6


def test_many_sources_by_ranges(spark):
    """Sums over what comes before, and water filling, in ranges of the order."""
    r = random.Random(4)
    sizes = [(f"s{i:04d}", r.choice([0, 1, 5, 5, 40, 1000, 10**6])) for i in r.sample(range(5000), 300)] + [(None, 7)]
    d = spark.createDataFrame(sizes, "source string, source_size long")
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0]))
    got = mixing.before(d, [mixing.F.col("source").asc_nulls_last()], {"n": mixing.F.lit(1), "x": mixing.F.col("source_size")}, Scratch(spark, "before"), "b").collect()
    assert {(x.source, x.n, x.x) for x in got} == {(s, k, sum(z for _, z in order[:k])) for k, (s, _) in enumerate(order)}
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(order)}
    want, open_, left = {}, dict(sizes), sum(z for _, z in sizes)
    while True:  # cap all that reach their cap, share the rest again
        unit = left / sum(weight[s] for s in open_)
        full = [s for s, z in open_.items() if 3 * z <= unit * weight[s]]
        if not full:
            break
        for s in full:
            want[s] = 3.0 * open_[s]
            left -= 3 * open_.pop(s)
    want |= {s: unit * weight[s] for s in open_}
    made = {x.source: x.target for x in mixing.targets(d).collect()}
    assert made == pytest.approx(want) and sum(made.values()) == pytest.approx(sum(z for _, z in sizes))
    assert mixing.targets(d.limit(0)).collect() == []


# 4


def brute_repeats(rows, length, first):
    docs = sorted(((r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42), r[0], (r[1] or "").encode()) for r in rows), key=lambda x: x[:2])
    seen, least = Counter(), {}
    order = sorted(range(len(docs)), key=lambda k: docs[k][0])
    for k in order:
        t = docs[k][3]
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] += 1
            least.setdefault(t[s : s + length], (k, s))
    out = Counter()
    for k, (_, _, doc, t) in enumerate(docs):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1 and not (first and least[t[s : s + length]] == (k, s)):
                gone[s : s + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[doc, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


REPEAT_COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("share", [1, repeats.HOT_SHARE])
@pytest.mark.parametrize("chunk", [repeats.CHUNK, 400])
def test_repeats(spark, chunk, share):
    values = texts(5, 80)
    values += [values[20] + values[30], "x" + values[30][:90] + "y", "ab" * 9000, "for " * 200, "zz" + values[30][5:] + "q"]
    rows, docs = make(spark, values)
    got = repeats.remove_repeats(docs, length=64, gram=20, chunk=chunk, share=share)
    assert by_rows(got, *REPEAT_COLS) == brute_repeats(rows, 64, False)
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_segments_of_regular_strings():
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64, whatever the base."""
    word = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = (bytes(97 + (x ^ flip) for x in word) for flip in (0, 1))
    up = repeats._powers(repeats._P, 2048)
    sums = [((np.frombuffer(t, np.uint8).astype(np.uint64) + np.uint64(1)) * up).sum(dtype=np.uint64) for t in (one, other)]
    assert sums[0] == sums[1]
    whole = [set(repeats.segments([t], length=2048, gram=40)[4].tolist()) for t in (one, other)]
    assert not whole[0] & whole[1]


def test_repeats_keep_first(spark):
    values = [t for t in texts(6, 40) if t] + ["ab" * 300]
    rows = [(i, t) for i, t in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, share in ((repeats.CHUNK, 1), (repeats.CHUNK, repeats.HOT_SHARE), (400, 1), (400, 4)):
        got = repeats.remove_repeats(docs, length=64, gram=20, keep_first=True, chunk=chunk, with_text=True, share=share)
        assert by_rows(got, *REPEAT_COLS) == brute_repeats(rows, 64, True)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


@pytest.mark.parametrize("share", [1, repeats.HOT_SHARE])
def test_repeats_of_equal_rows(spark, share):
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, shared), (1, shared), (1, shared), (None, shared + " end"), (2, "other " * 3), (None, None), (2, "head " + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_rows(repeats.remove_repeats(docs, length=64, gram=20, share=share), *REPEAT_COLS) == brute_repeats(rows, 64, False)
    first = repeats.remove_repeats(spark.createDataFrame([(3, shared)] * 4 + [(4, shared)], docs.schema), length=64, gram=20, keep_first=True, share=share)
    assert Counter(first.select("doc_id", "n_removed").collect()) == {(3, 0): 4, (4, len(shared)): 1}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"aab"]), min_size=2, max_size=60))
def test_previous_factors(parts):
    t = b"".join(parts)
    length = 9
    starts = np.arange(max(0, len(t) - length + 1))
    if not len(starts):
        return
    order, before, after = repeats.previous_factors(np.frombuffer(t, np.uint8), starts, length)
    assert order.tolist() == sorted(starts.tolist(), key=lambda s: (t[s : s + length], s))
    common = lambda i, j: next((k for k in range(length) if t[i + k] != t[j + k]), length)
    for i, b, a in zip(order.tolist(), before, after):
        assert b == max((common(i, j) for j in range(i)), default=0)
        assert a == max((common(i, j) for j in range(i + 1, len(starts))), default=0)


# 5

WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")


def test_token_store(spark):
    from tokenizers import Tokenizer

    rows, docs = make(spark, texts(8, 50))
    store = Scratch(spark, "store")
    token_store.write_store(docs, store, WORDS_FILE, 2, ranges=3)
    tk = Tokenizer.from_file(WORDS_FILE)
    ids = [(r[0], tk.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows]
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids)
    got = token_store.read_index(store).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert known[0] is None and known[1:] == sorted(known[1:])
    assert Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_ids(store).collect()) == Counter((d, tuple(i)) for d, i in ids)
    assert token_store.verify_manifest(store)
    chunks = spark.read.parquet(store.path("chunks"))
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_token_store_detects_damage_and_empty(spark):
    store = Scratch(spark, "store")
    token_store.write_store(empty(spark), store, WORDS_FILE, 2)
    assert token_store.read_index(store).count() == 0
    bad = Scratch(spark, "store")
    token_store.write_store(make(spark, texts())[1], bad, WORDS_FILE, 2)
    chunks = spark.read.parquet(bad.path("chunks"))
    Scratch.store(bad, chunks.selectExpr("hash", "n", "concat(data, data) AS data"), "other")
    bad.drop("chunks")
    bad.store(spark.read.parquet(bad.path("other")), "chunks")
    with pytest.raises(Exception, match="address"):
        token_store.read_index(bad).collect()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_joined_sums(a, b):
    assert token_store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 6000), st.integers(0, 10))
def test_chunks_cover_the_stream(n, seed):
    ids = np.random.default_rng(seed).integers(0, 50, n).astype(np.uint16)
    ends = token_store.cut(ids)
    assert ends[-1] == n and all(0 < b - a <= token_store.LONGEST for a, b in zip(ends, ends[1:]))


PIECES = st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "\t", "'s", "'LL", "é", "É", "ß", "中", "1", "23", "\x1c", "\x85", " ", "　", "!", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "A.", "b,", "é,", "<|", "́", "😀", "\r\n", "İ", "Σς", "ﬁ", "각", "​", "\xa0", "thing", "²"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_encoder_is_the_library(text):
    from tokenizers import Tokenizer

    global _tk
    if "_tk" not in globals():
        _tk = Tokenizer.from_file(WORDS_FILE), token_store.Encoder(WORDS_FILE, 2)
    assert np.frombuffer(_tk[1].encode([text.encode()])[0], "<u2").tolist() == _tk[0].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["İ!", "aİ. b", "क़!?", "שּׁ. x", "é! ñ.", "!", "a!b!"])
def test_marks_behind_letters_that_end_in_marks(text):
    """İ in small letters ends in a dot above, which is one piece with what stands behind it."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS_FILE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_store.Encoder(WORDS_FILE, 2).encode([text.encode()])[0], "<u2").tolist() == whole


# 6

BYTES_FILE = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_counter_is_the_library(text):
    from tokenizers import Tokenizer

    global _bk
    if "_bk" not in globals():
        _bk = Tokenizer.from_file(BYTES_FILE), token_counts.Counter(BYTES_FILE)
    assert _bk[1].count(text) == len(_bk[0].encode(text, add_special_tokens=False).ids)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    rows, docs = make(spark, texts())
    tk = Tokenizer.from_file(BYTES_FILE)
    want = Counter((r[0], len((r[1] or "").encode()), len(tk.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert by_rows(token_counts.count_tokens(docs, BYTES_FILE), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.count_tokens(empty(spark), BYTES_FILE).count() == 0


# 7


def test_license_scan(spark):
    values = texts() + ["x CC-BY, y. cc by", "All Rights\nreserved", "Licensed under the Apache License, Version 2.0", "Licensed under the Apache Licence", "the general public license of cc by-nc 4.0", "Licensed under CC BY-NC 4.0.", "Released under the MIT License."]
    rows, docs = make(spark, values)
    want = Counter()
    for doc, text, *_ in rows:
        w = words_of(text)
        starts = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in starts]
        want[doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in starts}))] += 1
    got = license_scan.scan_licenses(docs)
    assert by_rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    found = {r.doc_id: r for r in got.collect()}
    first = len(texts())
    assert found[first + 2].labels == "apache-2.0" and found[first + 2].score == 1.0
    assert found[first + 3].labels == "" and found[first + 3].score == 0.0
    assert found[first + 5].labels == "cc-by,cc-by-nc-4.0" and found[first + 6].labels == "mit"
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def brute_licenses(index, words):
    """Every template laid at every place."""
    found = {}
    for t, (label, want, keys) in enumerate(index.templates):
        for start in range(-len(want), len(words)):
            here = [(j, start + j) for j in range(len(want)) if 0 <= start + j < len(words)]
            share = sum(index.idf[want[j]] for j, i in here if words[i] == want[j]) / sum(index.idf[w] for w in want)
            window = b" " + b" ".join(words[i] for _, i in here) + b" "
            if share >= license_scan.ENOUGH - 1e-9 and all(b" " + b" ".join(k) + b" " in window for k in keys):
                found[label] = max(found.get(label, 0), share)
    return found


def test_license_lookup_is_brute_force():
    index, r = license_scan.Index(), random.Random(5)
    vocab = sorted(index.idf)
    hits = 0
    for _ in range(150):
        words = []
        for _ in range(r.randint(1, 3)):
            words += [r.choice([b"x", b"the", *vocab[:20]]) for _ in range(r.randint(0, 8))]
            part = list(r.choice(index.templates)[1])
            for _ in range(r.randint(0, 4)):
                part[r.randrange(len(part))] = r.choice(vocab)
            words += part[r.randint(0, 2) :] if r.random() < 0.5 else part
        at = np.array([i for i, w in enumerate(words) if w in index.vocab], np.int64)
        got, want = dict(index.match(words, at)[0]), brute_licenses(index, words)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        hits += len(want)
        rare = {w for w in words if w in index.postings}
        assert len(index.candidates(words, at)) <= sum(len(index.postings[w]) * words.count(w) for w in rare)
    assert hits > 100 and len(index.postings) < len(index.idf) * 0.8


def test_each_license_is_found():
    index = license_scan.Index()
    for label, text, _ in (*license_scan.TEMPLATES, *license_scan.BODIES):
        words = license_scan.words_of(f"Code: {text}. More.".encode())
        at = np.array([i for i, w in enumerate(words) if w in index.vocab], np.int64)
        assert dict(index.match(words, at)[0])[label] == pytest.approx(1.0)


def test_bodies_without_titles():
    """Parts of licence texts, laid out over lines and comment marks, without any name of the licence; and what resembles them."""
    index = license_scan.Index()

    def labels(text):
        words = license_scan.words_of(text.encode())
        return [x for x, _ in index.match(words, np.array([i for i, w in enumerate(words) if w in index.vocab], np.int64))[0]]

    mit = """/* to deal in the Software without restriction, including
     * without limitation the rights to use, copy, modify, merge, publish, distribute,
     * sublicense, and/or sell copies of the Software, and to permit persons to whom the
     * Software is furnished to do so, subject to the following conditions: */"""
    assert labels(mit) == ["mit"]
    assert labels("# Redistributions of source code must retain the above copyright\n# notice, this list of conditions and the following disclaimer.") == ["bsd"]
    assert labels("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.") == ["agpl-3.0"]
    assert labels("The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.") == ["gpl-3.0"]
    assert labels("The software is provided to all members, without restriction of any kind, and the authors are listed below.") == []


# 8


def naive_score(model, row):
    """Each tree walked node by node."""
    total = model.bias
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_trees_against_naive_splits_and_walks():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0) & (rng.random(300) > 0.1)).astype(float)
    model = quality.fit(x, y, rounds=3, depth=3, bins=16)
    assert np.allclose(model.score(x), [naive_score(model, r) for r in x])
    p = 1 / (1 + np.exp(-model.bias))
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = 0.0
    for j in range(4):
        for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 16)[1:-1], method="lower")):
            left = x[:, j] <= c
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, gain)
    left = x[:, model.feature[0][0]] <= model.cut[0][0]
    assert np.isclose(best, sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1))


@pytest.mark.parametrize("seed", range(4))
def test_all_levels_and_leaves_against_naive_splits(seed):
    """Each node of each tree has a split of the best gain that any cut has there (several may share it), each leaf the value of its rows;
    scores add the leaves up, on rows seen and unseen."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(240, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] * x[:, 0] > 0) & (rng.random(240) > 0.1)).astype(float)
    rate, bins, ridge, least, depth = 0.3, 12, 1.0, 2.0, 3
    model = quality.fit(x, y, rounds=4, depth=depth, rate=rate, bins=bins, ridge=ridge, least=least)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")) for j in range(5)]
    raw, split = np.full(240, model.bias), 0
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        term = lambda s: g[s].sum() ** 2 / (h[s].sum() + ridge)

        def gain(rows, j, c):
            low, high = rows & (x[:, j] <= c), rows & (x[:, j] > c)
            return term(low) + term(high) - term(rows) if min(h[low].sum(), h[high].sum()) >= least else 0.0

        parts = {0: np.ones(240, bool)}
        for k in range(2**depth - 1):
            best = max(gain(parts[k], j, c) for j, some in enumerate(cuts) for c in some)
            assert np.isclose(gain(parts[k], feature[k], cut[k]), max(best, 0.0), atol=1e-8)
            split += np.isfinite(cut[k])
            low = x[:, feature[k]] <= cut[k]
            parts[2 * k + 1], parts[2 * k + 2] = parts[k] & low, parts[k] & ~low
        for k, value in enumerate(leaf):
            rows = parts[2**depth - 1 + k]
            assert np.isclose(value, -rate * g[rows].sum() / (h[rows].sum() + ridge))
            raw[rows] += value
    assert split > 12 and np.allclose(model.raw(x), raw)
    unseen = rng.normal(size=(100, 5))
    assert np.allclose(model.score(unseen), [naive_score(model, r) for r in unseen])


def test_statistics_of_odd_texts():
    for text in (None, b"", b" \n", b"a", "é".encode() * 100_000, b"word " * 60_000, bytes(range(256))):
        got = quality.statistics(text)
        assert len(got) == len(quality.FEATURES) and np.isfinite(got).all()


def test_sample_is_the_least_digests(spark):
    rows = spark.createDataFrame([(i % 700, i % 2, [float(i)]) for i in range(900)], "id long, y int, x array<double>").repartition(13)
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    want = sorted((digest(i % 700), i % 700, i % 2) for i in range(900))[:50]
    assert sorted((digest(r.id), r.id, r.y) for r in quality.least(rows, 50).collect()) == want
    assert quality.least(rows, 5000).count() == 900 and quality.least(rows.limit(0), 5).count() == 0


def test_quality(spark):
    r = random.Random(1)
    good = [" ".join(r.choice(["tion", "the", "and", "ing", "over", "Then"]) + r.choice(["er", "ly", ""]) for _ in range(r.randint(5, 80))) for _ in range(300)]
    junk = [" | ".join(t.split()) if i % 2 else t.upper().replace(" ", "!! ") for i, t in enumerate(good[:150])]
    values = texts() + good + junk
    rows, docs = make(spark, values)
    n = len(texts())
    labels = spark.createDataFrame([(i, int(i < n + 300), 0, "x", [0.0]) for i in range(n, len(values))] + [(1, None, None, "x", None), (None, 1, 0, "x", None), (n, 1, 0, "x", None), (n, 0, 0, "x", None), (n, 1, 0, "x", None)], "doc_id long, quality int, toxic int, id string, x array<double>")
    got = quality.score_quality(docs, labels).collect()
    assert Counter(x.doc_id for x in got) == Counter(x[0] for x in rows)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
    held = [x for x in got if x.held_out and x.doc_id >= n]
    assert sum(x.predicted == int(x.doc_id < n + 300) for x in held) / len(held) > 0.95
    assert {x.doc_id: x.score for x in got} == {x.doc_id: x.score for x in quality.score_quality(docs.repartition(5), labels).collect()}
    assert {x.score for x in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty(spark), labels).count() == 0


# 9


def brute_print(text, words=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    parts = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, budget):
    up = {p: p for p in prints}

    def top(p):
        while up[p] != p:
            p = up[p]
        return p

    ps = sorted(set(prints))
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if (a ^ b).bit_count() <= budget and top(a) != top(b):
                up[top(b)] = top(a)
    return {p: top(p) for p in ps}


def test_near_duplicates(spark):
    rows, docs = make(spark, texts(9, 120))
    prints = [brute_print(r[1]) for r in rows]
    root = brute_components(prints, 2)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    want = Counter((r[0], format(p, "016x"), least.get(root[p])) for r, p in zip(rows, prints))
    assert by_rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("root", [simhash.ROOT, 3])
def test_links_of_dense_prints(spark, root):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    ps = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(25)} | set(base)
    df = spark.createDataFrame([(simhash.signed(p),) for p in ps], "fp long")
    scratch = Scratch(spark, "t")
    got = {x.node % (1 << 64): x.root % (1 << 64) for x in simhash.components(simhash.link(df, scratch, root=root), scratch).collect()}
    want = brute_components(list(ps), 2)
    mine, theirs = defaultdict(set), defaultdict(set)
    for p in ps:
        mine[got.get(p, p)].add(p)
        theirs[want[p]].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def jobs(spark, run):
    """Spark jobs that run() starts."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return len(sc.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("kind", ["chain", "hub", "random", "loops", "none"])
def test_components(spark, kind):
    r = random.Random(8)
    if kind == "chain":
        nodes = r.sample(range(10**6), 90)
        pairs = list(zip(nodes, nodes[1:]))
    elif kind == "hub":  # more neighbours than FEW, smaller and larger ones, and two hubs that share one
        pairs = [(h, n) for h in (500, 20_000) for n in r.sample(range(30_000), 3 * common.FEW)] + [(500, 7), (20_000, 7)]
    else:
        pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] if kind == "random" else [(3, 3), (-4, -4), (5, -4)] if kind == "loops" else []
    up = {n: n for p in pairs for n in p}
    for a, b in pairs:
        x, y = sorted((up[a], up[b]))
        up = {n: x if t == y else t for n, t in up.items()}
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {x.node: x.root for x in simhash.components(df, Scratch(spark, "t")).collect()}
    assert got == {n: t for n, t in up.items() if n != t}


def test_components_of_stars_take_no_round(spark):
    df = spark.createDataFrame([(n, n % 5) for n in range(5, 60)], "a long, b long")
    assert jobs(spark, lambda: simhash.components(df, Scratch(spark, "t"))) <= 6


def test_trie_with_other_budgets():
    r = np.random.default_rng(1)
    keys = np.unique(np.concatenate([r.integers(0, 1 << 63, 200, np.uint64), np.uint64(7) ^ (np.uint64(1) << r.integers(0, 60, 40, np.uint64))]))
    for budget in (0, 1, 4):
        got = {tuple(sorted(p)) for i, j in simhash.trie_links(keys, np.array([0, len(keys)]), budget, frontier=50) for p in zip(i.tolist(), j.tolist())}
        assert got == {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= budget}


# 10


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_digests(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", None, "", "a\nb", "\\", "<s", "s>"]
    rows = [(c, t, ["user", "assistant", "system", None, "tool\n\\x"][(c + t) % 5], nasty[(c * 3 + t) % len(nasty)]) for c in range(6) for t in range(c + 3)]
    rows += [(1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (None, None, "assistant", "x"), (9, 0, "user", "long " * 50_000)]
    table = chats(spark, rows).selectExpr("*", "'x' AS seq", "'what' AS kind", "1 AS place", "'y' AS formatted")
    out = chat_format.digests(chat_format.format_chats(chat_format.from_messages(table))).collect()
    log = chat_format.streamed(table, piece=7)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat_format.KINDS)
    assert sorted(map(str, chat_format.digests(chat_format.format_chats(log.repartition(5))).collect())) == sorted(map(str, out))
    got = {r.conv_id: r for r in out}
    assert len(out) == len({r[0] for r in rows})
    for conv in got:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: x)
        turns, learned = "".join(f"{r}\n{x}\n" for _, r, x in mine), "".join(x for _, r, x in mine if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.loss_chars) == (len(mine), len(learned))
        assert g.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and g.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat_format.digests(chat_format.format_chats(chat_format.from_messages(chats(spark, [])))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<s>", "</s>", "[INST] ", " [/INST]", "\n", "a"]), max_size=12).map("".join), st.sampled_from(["user", "assistant", "a\nb", "\\n<s>"]))
def test_rendered_turns_read_back(text, role):
    formatted, start, length = chat_format.render(role, text)
    assert chat_format.parse(formatted) == (role, text)
    assert chat_format.unescape(formatted[start : start + length]) == text
    assert formatted.count("</s>") == 1 and formatted.count("<s>") == 1


def test_events_fold(spark):
    log = [(1, 0, 0, "message", "user", "Hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"), (1, 1, 9, "edit", None, "Bye"), (1, 1, 4, "regenerate", None, None),
           (1, 1, 5, "delta", None, "Good"), (1, 1, 10, "delta", None, "!"), (2, 0, 0, "delta", "assistant", "x"), (2, 0, 1, "delta", None, "y")]
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): chat_format.parse(r.formatted) for r in chat_format.format_chats(df).collect()}
    assert got == {(1, 0): ("user", "Hi"), (1, 1): ("assistant", "Bye!"), (2, 0): ("assistant", "xy")}
    with pytest.raises(Exception, match="unknown kind"):
        chat_format.format_chats(df.selectExpr("conv_id", "turn", "seq", "'what' AS kind", "role", "text")).collect()
