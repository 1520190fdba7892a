"""Cross-tokenizer alignment: the smallest groups of tokens of two tokenizers that cover the same bytes, and how often ids are linked."""

from __future__ import annotations

import hashlib
import json
import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Scratch, pick

#: Texts are aligned in blocks of so many characters, or of one text that is longer.
BLOCK = 1_500_000
#: A pair's partial counts are summed under so many salts before they meet.
SALTS = 16
#: A place where both tokenizers always cut: before a single space or line end between two characters that are no white space.
SEGMENT = re.compile(r"(?:[ \n]\S+|\s+\S*)(?:(?![ \n]\S)\s+\S*)*")
# Fixed value: where byte-level vocabularies cut a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands for a space in the pieces of the second tokenizer.
MARK = "▁"
FIELDS = "block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, segments array<int>, codes array<long>, counts array<long>, places array<int>, sizes array<int>"


def byte_names() -> dict[str, int]:
    """Characters that byte-level vocabularies write bytes as: printable ones stand for themselves, the others follow from U+0100 on."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(odd)}


class Both:
    """The two tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        spec = json.load(open(path_a, encoding="utf-8"))
        model, added, names = spec["model"], {t["content"] for t in spec["added_tokens"]}, byte_names()
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"] or model["ignore_merges"]:
            raise ValueError(f"{path_a} is no plain byte-level BPE")
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(model["vocab"][m] != 256 + i for i, m in enumerate(merges)):
            raise ValueError(f"{path_a} doesn't number its tokens by their merges")
        ranks = {bytes(names[c] for c in word): i for word, i in model["vocab"].items() if word not in added}
        self.a, self.b = Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}), SentencePieceProcessor(model_file=path_b)
        self.size_a = np.zeros(max(model["vocab"].values()) + 1, np.int64)
        for word, i in ranks.items():
            self.size_a[i] = len(word)
        pieces = list(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError(f"{path_b} has pieces that cross white space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64, len(pieces))
        text = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.text_a = {end: text(len(self.size_a), end) for end in ",|"}
        self.text_b = {end: text(len(pieces), end) for end in ",;"}

    def encode_a(self, segments: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, number of each one's). Many are encoded together, as no token crosses from one to the next; those that end
        in white space, or begin with more than one, as only ends of texts do, by themselves, as white space would run on."""
        parts, held = [], []
        for s in segments:
            odd = s[-1:].isspace() or s[:2].isspace()
            if held and (odd or len(held) >= 20_000):
                parts.append(self.a.encode_ordinary("".join(held)))
                held = []
            if odd:
                parts.append(self.a.encode_ordinary(s))
            else:
                held.append(s)
        parts.append(self.a.encode_ordinary("".join(held)))
        ids = np.concatenate([np.array(x, np.int64) for x in parts])
        upto = np.searchsorted(self.size_a[ids].cumsum(), size.cumsum(), "right")
        return ids, np.diff(upto, prepend=0)

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment. The library puts a space before each: it is the segment's own, or goes again."""
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [ids if s[0] == " " else ids[1:] for s, ids in zip(segments, b)]


_both: dict[tuple[str, str], Both] = {}


def both_of(path_a: str, path_b: str) -> Both:
    """This worker's tokenizers."""
    if (path_a, path_b) not in _both:
        _both.clear()
        _both[path_a, path_b] = Both(path_a, path_b)
    return _both[path_a, path_b]


class Aligned:
    """Segments after each other as one stream: where each one's tokens, groups and links are."""

    def __init__(self, both: Both, segments: list[str]):
        raw = [s.encode() for s in segments]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        b = both.encode_b(segments)
        bytes_b = both.bytes_b
        self.good = np.fromiter((x == b"".join([bytes_b[i] for i in y]) for x, y in zip(raw, b)), bool, len(raw))
        if not self.good.all():  # a segment that doesn't come back has no tokens; the texts that hold it will have none
            b = [y if ok else [] for y, ok in zip(b, self.good)]
            id_a, n_a = both.encode_a([s if ok else "" for s, ok in zip(segments, self.good)], np.where(self.good, size, 0))
        else:
            id_a, n_a = both.encode_a(segments, size)
        self.n_a, self.n_b = n_a, np.fromiter(map(len, b), np.int64, len(b))
        id_b = np.fromiter((i for y in b for i in y), np.int64, self.n_b.sum())
        end_a, end_b = both.size_a[id_a].cumsum(), both.size_b[id_b].cumsum()
        once = lambda ends: ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
        cuts = np.intersect1d(once(end_a), once(end_b), assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        # tokens that end at a cut: one each, but a token without bytes would end where another does
        at = lambda ends: (np.searchsorted(ends, cuts, "left"), np.searchsorted(ends, cuts, "right"))
        (first_a, past_a), (first_b, past_b) = at(end_a), at(end_b)
        across, down = past_a - first_a, past_b - first_b
        per_cut = across * down
        cut_of = np.repeat(np.arange(len(cuts)), per_cut)
        inside = np.arange(len(cut_of)) - np.repeat(per_cut.cumsum() - per_cut, per_cut)
        link_a, link_b = id_a[first_a[cut_of] + inside // down[cut_of]], id_b[first_b[cut_of] + inside % down[cut_of]]
        self.link = link_a * len(both.bytes_b) + link_b
        segment_a = np.repeat(np.arange(len(segments)), self.n_a)
        of_cut = segment_a[first_a] if len(cuts) else np.zeros(0, np.int64)
        self.n_groups = np.bincount(of_cut, minlength=len(segments))
        self.n_links = np.bincount(of_cut, per_cut, len(segments)).astype(np.int64)
        self.texts = self._texts(both, id_a, id_b, group_a, group_b)

    def _texts(self, both: Both, id_a, id_b, group_a, group_b) -> list[str]:
        """Each segment's groups: a1,a2|b1;a3|b2; with an end mark behind each."""
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        la, lb = last(group_a), last(group_b)
        said = np.concatenate([np.where(la, both.text_a["|"][id_a], both.text_a[","][id_a]), np.where(lb, both.text_b[";"][id_b], both.text_b[","][id_b])])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        tokens = said[order].tolist()
        ends = (self.n_a + self.n_b).cumsum().tolist()
        return ["".join(tokens[lo:hi]) for lo, hi in zip([0, *ends], ends)]


class Index(dict):
    """Numbers of segments, given as they are met."""

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        return n


def cut(text: str | None, index: Index) -> list[int]:
    """Numbers of the segments of a space and the text. None for a null or empty text, nor for one with MARK, which its pieces don't
    give back."""
    return list(map(index.__getitem__, map(itemgetter(0), SEGMENT.finditer(" " + text)))) if text and MARK not in text else []


def align_block(both: Both, texts: list[str | None]) -> dict:
    """Rows of a block's texts, and what the block's links are: codes (a pair of ids each) with counts, and for each segment
    places in codes, sizes of them."""
    index = Index()
    rows = [cut(t, index) for t in texts]
    made = Aligned(both, list(index))
    if not made.good.all():
        rows = [r if made.good[r].all() else [] for r in rows]
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], n.cumsum()])
    used = np.bincount(flat, minlength=len(index))
    sums = [np.diff(np.concatenate([[0], x[flat].cumsum()])[offsets]) for x in (made.n_a, made.n_b, made.n_groups, made.n_links)]
    shas = []
    for r in rows:
        sha = hashlib.sha256()
        for k in range(0, len(r), 50_000):
            part = "".join([made.texts[i] for i in r[k : k + 50_000]])
            sha.update((part if k + 50_000 < len(r) else part[:-1]).encode())
        shas.append(sha.hexdigest() if r else "")
    codes, places = np.unique(made.link, return_inverse=True)
    counts = np.bincount(places, np.repeat(used, made.n_links), len(codes)).astype(np.int64)
    return {"segments": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), "sums": sums, "shas": shas, "codes": codes, "counts": counts, "places": places, "sizes": made.n_links}


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a is a byte-level BPE file of the tokenizers library and gets a space and the text, path_b a sentencepiece model, which
    adds the space itself; special strings inside texts are plain text. Byte offsets where tokens of both end cut them into groups;
    a link is a pair of token occurrences that end at the same byte, its count the number of links of all documents that have the same two ids. n_best:
    links whose count is the highest of any with their second id, ties included. groups_sha256 is of a1,a2|b1;a3|b2,b3.

    Texts are cut into segments where both tokenizers always cut, so that a segment that stands often in a block is encoded once;
    rows and links are kept by block. Pairs are summed in a block, then under salts, then whole; their counts come back to the blocks, each
    of which sums them for its documents. No task holds more than a block (BLOCK characters, or one longer text) of either.

    Null and empty texts, and texts that don't come back from their tokens (those with U+2581), have no tokens: zeros and ''.
    Repeated rows each give a row, null ids stay null, an empty table gives none; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    kind = docs.schema[id_col].dataType.simpleString()
    base = pick(docs, id=id_col, text=text_col)
    fields = FIELDS.format(kind=kind)
    schema = to_arrow_schema(StructType.fromDDL(fields))
    final = StructType.fromDDL(f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    final_schema = to_arrow_schema(final)

    def blocks(batches):
        both, number = both_of(path_a, path_b), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def done():
            """A row of each text, and one of the block's own."""
            nonlocal ids, texts, size, number
            b = align_block(both, texts)
            n = len(ids)
            of_texts = [pa.array(ids, schema.types[1]), *(pa.array(x, pa.int64()) for x in b["sums"]), pa.array(b["shas"]), b["segments"]]
            of_block = [pa.array([b[name]], t) for name, t in zip(("codes", "counts", "places", "sizes"), schema.types[8:])]
            cols = [pa.array([number] * (n + 1), pa.int64()), *(pa.concat_arrays([x.cast(t), pa.nulls(1, t)]) for x, t in zip(of_texts, schema.types[1:8])), *(pa.concat_arrays([pa.nulls(n, x.type), x]) for x in of_block)]
            ids, texts, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                text = t.as_py()
                if size and size + len(text or "") > block:
                    yield done()
                ids.append(i.as_py())
                texts.append(text)
                size += len(text or "") + 1
        if ids:
            yield done()

    rows = scratch.store(base.mapInArrow(blocks, fields), "blocks")
    pairs = rows.where("codes is not null").select("block", F.explode(F.arrays_zip("codes", "counts")).alias("p")).select("block", F.col("p.codes").alias("code"), F.col("p.counts").alias("n"))
    salted = pairs.groupBy("code", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    totals = scratch.store(salted.groupBy("code").agg(F.sum("n").alias("total")), "totals")
    size_b = len(both_of(path_a, path_b).bytes_b)
    second = F.pmod(F.col("code"), F.lit(size_b)).alias("b")
    best = totals.groupBy(second).agg(F.max("total").alias("most"))  # as many rows as the second vocabulary has ids at most
    totals = totals.withColumn("b", second).join(F.broadcast(best), "b").select("code", "total", (F.col("total") == F.col("most")).alias("is_best"))
    known = pairs.select(F.col("block").alias("of"), "code").join(totals, "code").select("of", "code", "total", "is_best")

    def judge(key, left, right):
        """A block's rows with the sums of their links' counts."""
        code = np.argsort(right.column("code").to_numpy())
        total, top = right.column("total").to_numpy()[code], right.column("is_best").to_numpy()[code].astype(np.int64)
        own = left.column("codes").is_valid().to_numpy()
        at = int(np.flatnonzero(own)[0])
        flat = lambda name: left.column(name).combine_chunks().slice(at, 1).flatten().to_numpy()
        places, sizes = flat("places"), flat("sizes").astype(np.int64)
        upto = sizes.cumsum()
        running = lambda x: np.concatenate([[0], x[places].cumsum()])
        per = [running(x)[upto] - running(x)[upto - sizes] for x in (top, total)]
        docs_ = left.filter(pa.array(~own))
        segments = docs_.column("segments").combine_chunks()
        flat_s, offsets = segments.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(segments.offsets.to_numpy()))])
        n_best, count_sum = (np.diff(np.concatenate([[0], p[flat_s].cumsum()])[offsets]) for p in per)
        return pa.Table.from_arrays([docs_.column("id"), *(docs_.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs_.column("groups_sha256")], schema=final_schema)

    made = rows.drop("counts").withColumn("codes", F.when(F.col("codes").isNotNull(), F.array().cast("array<long>"))).groupBy("block").cogroup(known.groupBy("of")).applyInArrow(judge, final)
    return made.withColumnRenamed("id", id_col)
