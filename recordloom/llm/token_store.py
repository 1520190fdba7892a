"""Token-ID output to a content-addressed store of chunks, recipes and Merkle manifests.

Files, all Parquet, under one root:
  chunks     hash (first 16 bytes of the SHA-256 of data), n, data (ids, little-endian, of width bytes each); each chunk once
  recipes    range, row, doc_id, n_tokens, hashes, lengths, root; a document each, files ascending in doc_id
  manifest   range, n_docs, n_tokens, first_doc, last_doc, root; a range of recipes each
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from array import array as pack
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, lookup, map_batches, pick

#: A chunk ends where the rolling hash of the last WINDOW ids has MASK's bits zero: every 256 ids on average.
WINDOW, MASK = 8, np.uint64(0xFF << 40)
SHORTEST, LONGEST = 64, 1024
#: Encodings of pieces of text that a worker keeps from one task to the next (two generations of about 75 MB each).
CACHE = 400_000
#: New words that the library merges in one call.
WORDS = 8192
#: Bytes of text whose pieces are told apart at once.
AT_ONCE = 12_000_000
#: ASCII marks: behind a letter and before white space they are one piece.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: All of a piece but such marks at its end.
BEFORE_MARKS = rf"(?s)^.*[^{re.escape(MARKS)}]"
#: Letters that the tokenizer's normaliser ends in what is no letter, as the dot above that İ leaves: marks behind them belong to that piece.
OPEN = "".join(c for c in map(chr, range(128, 0x110000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower()[-1].isalpha())


class Encoder:
    """The library's ids of a text, by way of its pieces between ASCII white space.

    The tokenizer drops white space and neither its normaliser nor its merges reach across it, so that a text's ids are those
    of its pieces one after the other; the library encodes each new piece, and ids of short ones are kept.
    """

    def __init__(self, path: str, width: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(f"<u{width}")
        self.code = "H" if width == 2 else "I"
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        #: The library's merges alone, for words that need no normaliser, in the byte-level alphabet, with spaces between.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        #: Bytes that aren't shown as they are get the code points from 256 on; spaces between words stay.
        self.names = {b: 256 + i for i, b in enumerate(hidden) if b != 32}

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of new pieces. A word of small letters passes the normaliser as it is and is one piece of the tokenizer's, so that
        only its merges are left to do, for many words at once; all else takes the library's whole way."""
        texts = [b.decode() for b in pieces]
        made: list[bytes] = [b""] * len(pieces)
        ascii_ = [i for i, t in enumerate(texts) if t.isascii() and t.isalpha() and t.islower()]
        other = [i for i, t in enumerate(texts) if not t.isascii() and t.isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t)]
        for some in (plain[k : k + WORDS] for plain in (ascii_, other) for k in range(0, len(plain), WORDS)):
            named = b" ".join([pieces[i] for i in some]).decode("latin-1")
            found = self.words.encode(named if texts[some[0]].isascii() else named.translate(self.names), add_special_tokens=False)
            data, ends = np.array(found.ids, self.dtype).tobytes(), np.cumsum(np.bincount(found.word_ids, minlength=len(some))) * self.dtype.itemsize
            at = 0
            for i, e in zip(some, ends.tolist()):
                made[i], at = data[at:e], e
        for i in set(range(len(pieces))).difference(ascii_, other):
            made[i] = pack(self.code, self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return made

    def known(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces: those of short ones are kept, in two generations."""
        found = [*map(self.now.get, pieces)]
        old = [i for i, ids in enumerate(found) if ids is None]
        for i in old:
            found[i] = self.before.get(pieces[i])
        new = [i for i in old if found[i] is None]
        for i, ids in zip(new, self.learn([pieces[i] for i in new])):
            found[i] = ids
        if len(self.now) >= CACHE:
            self.now, self.before, old = {}, self.now, range(len(pieces))
        self.now.update((pieces[i], found[i]) for i in old if len(pieces[i]) <= 48)
        return found

    def _looked_up(self, pieces: pa.DictionaryArray) -> pa.Array:
        """Ids of each piece, as bytes."""
        return pa.array(self.known(pieces.dictionary.cast(pa.binary()).to_pylist()), pa.large_binary()).take(pieces.indices)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (and the end). Null texts have none.

        Each different piece of the texts is looked up once. Pieces are in lower case, as the tokenizer's normaliser has them,
        but for texts that might hold its special strings. ASCII marks at the end of a piece, behind a letter that stays one, are a piece too.
        """
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        whole = coded.dictionary
        words = pc.utf8_rtrim(whole, MARKS)
        words = pc.if_else(pc.and_(pc.match_substring_regex(words, rf"[^\PL{OPEN}]$"), pc.invert(pc.match_substring(whole, "<|"))), words, whole)
        parted = words.dictionary_encode()
        found = self._looked_up(parted)
        odd = pc.greater(pc.binary_length(whole), pc.binary_length(words))
        marks = pc.replace_substring_regex(whole.filter(odd), BEFORE_MARKS, "").dictionary_encode()
        behind = pc.replace_with_mask(pa.repeat(pa.scalar(b"", pa.large_binary()), len(whole)), odd, self._looked_up(marks))
        taken = pc.binary_join_element_wise(found, behind, pa.scalar(b"", pa.large_binary())).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset) if len(taken) else np.zeros(1, np.int64)
        ids = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(self.dtype) if len(taken) else np.zeros(0, self.dtype)
        ends = (ends - ends[0]) // self.dtype.itemsize
        return ids, ends[bounds - bounds[0]]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text, as bytes."""
        ids, at = self.encode_array(pa.array([None if t is None else t.decode() for t in texts], pa.string()))
        return [ids[a:z].tobytes() for a, z in zip(at, at[1:])]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, width: int) -> Encoder:
    """This worker's encoder for a file."""
    if (path, width) not in _encoders:
        _encoders.clear()
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 65_536 else 4


def cuts(ids: np.ndarray, bounds: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of each id stream; stream k lies between bounds[k] and bounds[k + 1], and its ends count from its start.
    Where it is cut depends on the last WINDOW ids only, but for the length bounds."""
    marks = np.zeros(0, np.int64)
    if len(ids) >= WINDOW:
        g = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = np.zeros(len(ids) - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            h = h * np.uint64(0x100000001B3) + g[j : len(g) - WINDOW + 1 + j]
        marks = np.flatnonzero((h & MASK) == 0) + WINDOW
    first = np.searchsorted(marks, bounds[:-1] + SHORTEST)
    last = np.searchsorted(marks, bounds[1:], "right")
    marks = marks.tolist()
    for a, z, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first.tolist(), last.tolist()):
        n, at, ends = z - a, 0, []
        for e in marks[i:j] if n > SHORTEST else ():
            e -= a
            while e - at > LONGEST:
                at += LONGEST
                ends.append(at)
            if e - at >= SHORTEST:
                ends.append(e)
                at = e
        while n - at > LONGEST:
            at += LONGEST
            ends.append(at)
        yield [*ends, n] if n > at or not ends else ends


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return next(cuts(ids, np.array([0, len(ids)])))


def merkle(leaves: list[bytes]) -> bytes:
    """SHA-256 Merkle root; an odd node goes up as it is, and no leaves give the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256().digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def crc_product(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial (reflected)."""
    p = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            p ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return p


#: x to the power 2**k, for k from 0: a string of n bytes shifts a sum before it by x to the power 8n.
_POWERS = [1 << 30]
for _ in range(63):
    _POWERS.append(crc_product(_POWERS[-1], _POWERS[-1]))
_SHIFTS: dict[int, int] = {}


def crc_joined(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from that of each and the second's length."""
    if length not in _SHIFTS:
        p, n, k = 1 << 31, length, 3
        while n:
            if n & 1:
                p = crc_product(_POWERS[k], p)
            n, k = n >> 1, k + 1
        if len(_SHIFTS) < 100_000:
            _SHIFTS[length] = p
        return crc_product(p, a) ^ b
    return crc_product(_SHIFTS[length], a) ^ b


def _encode(path: str, end_id: int, width: int):
    """mapInArrow over (id, text): rows of chunks (hash, n, data), each once in a task's reach, and rows of recipes."""
    def run(batches):
        encoder, size = encoder_of(path, width), 1 << 16
        row, seen = TaskContext.get().partitionId() << 33, set()
        names = ["row", "doc_id", "n_tokens", "hashes", "lengths", "root", "hash", "n", "data"]
        kinds = [pa.int64(), None, pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

        def batch(rows, kind):
            cols = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            kind, docs, texts = b.schema.field(0).type, b.column(0).to_pylist(), b.column(1)
            filled = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            i = 0
            while i < len(docs):
                j = max(i + 1, int(np.searchsorted(filled, (filled[i - 1] if i else 0) + AT_ONCE, "right")))
                ids, bounds = encoder.encode_array(texts.slice(i, j - i))
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                data, rows = ids.tobytes(), []
                for doc, start, ends in zip(docs[i:j], bounds.tolist(), cuts(ids, bounds)):
                    hashes, lengths, at = [], [], 0
                    for e in ends:
                        chunk = data[(start + at) * width : (start + e) * width]
                        h = hashlib.sha256(chunk).digest()[:16]
                        if h not in seen:
                            if len(seen) >= size:
                                seen.clear()
                            seen.add(h)
                            rows.append((None, None, None, None, None, None, h, e - at, chunk))
                        hashes.append(h)
                        lengths.append(e - at)
                        at = e
                    rows.append((row, doc, at, hashes, lengths, merkle(hashes), None, None, None))
                    row += 1
                yield batch(rows, kind)
                i = j
            if not docs:
                yield batch([], kind)

    return run


def write_store(docs: DataFrame, root: Scratch, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", ranges: int = 0) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes chunks, recipes and manifest under root.

    Staged rows are read twice: for the chunks, which are combined by hash, and for the recipes, which are dealt by ranges of
    the id and sorted, so that their files ascend in it. Repeated ids keep a recipe each; null ids come first.
    """
    width = id_width(path)
    kind = docs.schema[id_col].dataType.simpleString()
    base = pick(docs, id=id_col, text=text_col)
    staged = base.mapInArrow(_encode(path, end_id, width), f"row long, doc_id {kind}, n_tokens long, hashes array<binary>, lengths array<int>, root binary, hash binary, n int, data binary")
    staged = root.store(staged, "staged")
    root.store(staged.where("hash is not null").select("hash", "n", "data").dropDuplicates(["hash"]), "chunks")
    recipes = staged.where("row is not null").select("row", "doc_id", "n_tokens", "hashes", "lengths", "root")
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    recipes = recipes.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    root.store(recipes.withColumn("range", F.spark_partition_id()), "recipes")
    root.drop("staged")

    _sealed(root, kind).write.mode("overwrite").parquet(root.path("manifest"))


def _recipes(root: Scratch) -> DataFrame:
    return root.spark.read.parquet(root.path("recipes"))


def _sealed(root: Scratch, kind: str) -> DataFrame:
    """A manifest made from the recipes: each range's rows stream through a task in order."""
    def seal(batches):
        leaves, docs_n, tokens, first, last, number = [], 0, 0, None, None, None
        kind_of = pa.int64()
        for b in batches:
            kind_of = b.schema.field(1).type
            for rng, doc, n_tokens, digest in zip(*(b.column(i).to_pylist() for i in range(4))):
                if number is not None and rng != number:
                    yield made(number, docs_n, tokens, first, last, leaves, kind_of)
                    leaves, docs_n, tokens, first = [], 0, 0, None
                number, last, first = rng, doc, doc if docs_n == 0 else first
                leaves.append(digest)
                docs_n, tokens = docs_n + 1, tokens + n_tokens
        if number is not None:
            yield made(number, docs_n, tokens, first, last, leaves, kind_of)

    def made(number, docs_n, tokens, first, last, leaves, kind_of):
        cols = zip((number, docs_n, tokens, first, last, merkle(leaves)), (pa.int32(), pa.int64(), pa.int64(), kind_of, kind_of, pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in cols], names=["range", "n_docs", "n_tokens", "first_doc", "last_doc", "root"])

    d = _recipes(root).select("range", "doc_id", "n_tokens", "root", "row").repartition("range")
    d = d.sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "row").drop("row")
    return d.mapInArrow(seal, f"range int, n_docs long, n_tokens long, first_doc {kind}, last_doc {kind}, root binary")


def read_index(root: Scratch) -> DataFrame:
    """Reads the files back, a row per document: doc_id, start (ids before it), n_tokens, ids_crc32 (of ids as 32-bit integers).

    Each chunk's bytes are checked against its address and summed up once; recipes then gather the sums of their chunks, and
    crc32 of a document comes from those of its parts. Roots of recipes are made anew and compared. What differs raises.
    """
    chunks = root.spark.read.parquet(root.path("chunks"))
    recipes = _recipes(root)

    def sums(c: dict) -> dict:
        out = {"hash": [], "crc": []}
        for h, n, data in zip(c["hash"], c["n"], c["data"]):
            if hashlib.sha256(data).digest()[:16] != h:
                raise ValueError("a chunk's bytes do not match its address")
            width = len(data) // n
            out["hash"].append(h)
            out["crc"].append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
        return out

    summed = map_batches(chunks, sums, "hash binary, crc long")
    parts = recipes.select("row", F.posexplode(F.arrays_zip("hashes", "lengths")).alias("at", "part")).select("row", "at", F.col("part.hashes").alias("hash"), F.col("part.lengths").alias("n"))
    uses = parts.groupBy("hash").agg(F.count(F.lit(1)).alias("uses"))
    index = root.store(summed.join(uses, "hash"), "sums")
    total = index.agg(F.sum("uses")).first()[0] or 1
    found = lookup(parts, index, ["hash"], "uses", total)
    per_doc = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc", "hash"))).alias("parts"))

    def join(batches):
        for b in batches:
            parts = b.column(1)
            flat = parts.flatten()
            ns, crcs, hashes = (flat.field(k).to_pylist() for k in ("n", "crc", "hash"))
            if None in crcs:
                raise ValueError("a recipe names a chunk that is not in the store")
            bounds = (parts.offsets.to_numpy() - parts.offsets[0].as_py()).tolist()
            out: tuple[list, list, list] = ([], [], [])
            for a, z in zip(bounds, bounds[1:]):
                crc = 0
                for n, c in zip(ns[a:z], crcs[a:z]):
                    crc = crc_joined(crc, c, 4 * n)
                for held, value in zip(out, (crc, sum(ns[a:z]), merkle(hashes[a:z]))):
                    held.append(value)
            made = [b.column(0), *(pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(made, names=["row", "crc", "n_read", "root_read"])

    read = per_doc.select("row", "parts").mapInArrow(join, "row long, crc long, n_read long, root_read binary")
    docs = recipes.select("row", "range", "doc_id", "n_tokens", "root").join(read, "row", "left")
    good = F.col("n_tokens").eqNullSafe(F.col("n_read")) & F.col("root").eqNullSafe(F.col("root_read"))
    manifest = root.spark.read.parquet(root.path("manifest"))
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = manifest.select("range", before.alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = docs.withColumn("inside", inside).join(F.broadcast(bases), "range", "left")
    crc = F.when(good, F.col("crc")).otherwise(F.raise_error(F.lit("a recipe does not give what was written")).cast("long"))
    return d.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", crc.alias("ids_crc32"))


def verify_manifest(root: Scratch) -> bool:
    """Whether each manifest row is what its recipes give."""
    kind = _recipes(root).schema["doc_id"].dataType.simpleString()
    held, made = root.spark.read.parquet(root.path("manifest")), _sealed(root, kind)
    return not held.exceptAll(made).unionByName(made.exceptAll(held)).head(1)


def read_ids(root: Scratch) -> DataFrame:
    """Each document's ids: doc_id, row, ids (array of int). The texts' whole ids move, for export rather than checks."""
    chunks = root.spark.read.parquet(root.path("chunks")).select("hash", "n", "data")
    parts = _recipes(root).select("row", "doc_id", F.posexplode("hashes").alias("at", "hash")).join(chunks, "hash")
    docs = parts.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "n", "data"))).alias("parts"))

    def run(c: dict) -> dict:
        ids = [[int(i) for p in parts for i in np.frombuffer(p["data"], f"<u{len(p['data']) // p['n']}")] for parts in c["parts"]]
        return {"row": c["row"], "doc_id": c["doc_id"], "ids": ids}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"row long, doc_id {kind}, ids array<int>")


