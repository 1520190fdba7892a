"""Alignment of two tokenizers against the libraries themselves, text by text."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from recordloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names = alignment.byte_names()
    spell_a = {i: bytes(names[c] for c in w) for w, i in a.get_vocab().items() if all(c in names for c in w)}
    spell_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in range(b.get_piece_size())}
    return a, b, spell_a, spell_b


def naive(libraries, text):
    """(groups as text, links) of one text."""
    a, b, spell_a, spell_b = libraries
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not b"".join(spell_a[i] for i in x) == (" " + text).encode() == b"".join(spell_b[i] for i in y):
        return None
    groups, links, p, q, i, j = [([], [])], [], 0, 0, 0, 0
    while i < len(x) or j < len(y):
        if p <= q and i < len(x):
            p += len(spell_a[x[i]])
            groups[-1][0].append(x[i])
            i += 1
        else:
            q += len(spell_b[y[j]])
            groups[-1][1].append(y[j])
            j += 1
        if p == q:
            links.append((groups[-1][0][-1], groups[-1][1][-1]))
            groups.append(([], []))
    assert groups.pop() == ([], [])
    said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return len(x), len(y), len(groups), said, links


def brute(libraries, texts):
    made = [naive(libraries, t) for t in texts]
    count = Counter(link for m in made if m for link in m[4])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if m is None else (*m[:3], len(m[4]), sum(count[x] == best[x[1]] for x in m[4]), sum(count[x] for x in m[4]), hashlib.sha256(m[3].encode()).hexdigest()) for m in made]


ODD = [None, "", " ", "  a", "a  b", "a\nb", "a\n\nb \n c\n", "x<s>y</s>", "<|endoftext|> it's <0x41>", "\u2581 a", "a\u2581b", "caf\u00e9 na\u00efve \u65e5\u672c\u8a9e \U0001f600", "a\x00b", "a\u00a0b\u3000c", "x\x1cy", "\r\n tab\there", "don't can't WE'LL", "1,234.56", "e\u0301", "end. \n"]


def some_texts(n=40):
    r = random.Random(3)
    words = ["the", "The", "alignment", "of", "tokens,", "caf\u00e9", "12345", "isn't", "supercalifragilistic", "\n", "x" * 30, "\u65e5\u672c", "(a)", "\ufb01ne"]
    return [r.choice([" ", "", "\n"]).join(r.choice(words) + r.choice(["", " ", " ", "."]) for _ in range(r.randint(1, 60))) for _ in range(n)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [alignment.BLOCK, 200])
def test_align_tokens(spark, libraries, block):
    texts = ODD + some_texts() + ["the tokens of the alignment " * 3000, "", "the", "the"]
    rows = [(i if i != 9 else 8, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "the null id", "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, code string, block string").repartition(3)
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in alignment.align_tokens(docs, A, B, block=block).collect())
    assert got == Counter((r[0], *m) for r, m in zip(rows, brute(libraries, [r[1] for r in rows])))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    made = alignment.align_tokens(docs, A, B)
    assert made.collect() == [] and made.columns[0] == "doc_id"
    nothing = spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string")
    assert {tuple(r) for r in alignment.align_tokens(nothing, A, B).collect()} == {(x, 0, 0, 0, 0, 0, 0, "") for x in "ab"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r'.,aZ1\u00e9\u2581\u00a0\u3000\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=25), max_size=4))
def test_blocks_are_the_libraries(libraries, texts):
    block = alignment.align_block(alignment.both_of(A, B), texts)
    for i, t in enumerate(texts):
        want = naive(libraries, t)
        got = (*(int(x[i]) for x in block["sums"]), block["shas"][i])
        assert got == ((0, 0, 0, 0, "") if want is None else (*want[:3], len(want[4]), hashlib.sha256(want[3].encode()).hexdigest()))


def test_white_space_doesnt_run_on_from_text_to_text(libraries):
    """Ends and beginnings of texts that would make one token together, as a space and a no-break space twice do."""
    ends, starts = ["a \u00a0", "a\n", "a \n", "a  ", "a \u00a0 \u00a0", " ", "\n"], ["\u00a0\u00a0b", "\n\nb", " \u00a0 \u00a0b", "  b", "b", "\u00a0", "\n"]
    for x in ends:
        for y in starts:
            block = alignment.align_block(alignment.both_of(A, B), [x, y, x + y])
            for i, t in enumerate((x, y, x + y)):
                want = naive(libraries, t)
                assert (*(int(s[i]) for s in block["sums"]), block["shas"][i]) == (*want[:3], len(want[4]), hashlib.sha256(want[3].encode()).hexdigest()), (x, y, t)


def test_tokens_without_bytes_link_with_all_that_end_there():
    """The expansion takes every pair, though no token of these files is empty."""
    both = object.__new__(alignment.Both)
    both.size_a, both.size_b, both.bytes_b = alignment.np.array([1, 0, 2]), alignment.np.array([1, 2]), [b"x", b"xx"]
    text = lambda n, end: alignment.np.array([f"{i}{end}" for i in range(n)], object)
    both.text_a, both.text_b = {e: text(3, e) for e in ",|"}, {e: text(2, e) for e in ",;"}
    both.encode_a = lambda segments, size: (alignment.np.array([0, 1, 0, 2]), alignment.np.array([3, 1]))
    both.encode_b = lambda segments: [[0, 0], [0, 0]]
    made = alignment.Aligned(both, ["xx", "xx"])
    assert [divmod(int(c), 2) for c in made.link] == [(0, 0), (1, 0), (0, 0), (2, 0)] and made.n_links.tolist() == [3, 1]
