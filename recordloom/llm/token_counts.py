"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, map_batches, pick

#: Counts of chunks, and of pieces, that a worker keeps from one task to the next (two generations of about 40 MB each).
CACHE = 350_000
#: Unicode white space, as the tokenizers' pattern has it.
SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Cuts that the tokenizer's pattern never crosses: a run of non-space with at most one space before it, or white space.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: A word of ASCII letters with marks behind it, none of them an apostrophe, which can begin a piece of its own.
PLAIN = re.compile(r"( ?[A-Za-z]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
SPACE_NAME = chr(0x120)


class Merges:
    """A file's merges as numbers: symbols by their strings, the rank of each pair, and the symbol that it makes."""

    def __init__(self, pairs: list[tuple[str, str]]):
        number: dict[str, int] = {}
        of = lambda x: number.setdefault(x, len(number))
        made = [(of(a), of(b), of(a + b)) for a, b in pairs]
        self.bits = len(number).bit_length()
        self.rank: dict[int, int] = {}
        for i, (a, b, _) in enumerate(made):
            self.rank.setdefault(a << self.bits | b, i)
        self.made = [c for _, _, c in made]
        self.number = number

    def done_in(self, symbols: str) -> int:
        """How often two neighbours merge: the lowest rank first, of equal ranks the leftmost, until no pair has a rank."""
        n, rank, made, bits = len(symbols), self.rank.get, self.made, self.bits
        sym = [self.number.get(c, -1) for c in symbols]
        heap = [r * n + i for i in range(n - 1) if sym[i] >= 0 and sym[i + 1] >= 0 and (r := rank(sym[i] << bits | sym[i + 1])) is not None]
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j >= n or sym[i] < 0 or sym[j] < 0 or rank(sym[i] << bits | sym[j]) != r:
                continue  # one of the two has merged since
            new = sym[i] = made[r]
            sym[j], k = -1, after[j]
            after[i] = k
            done += 1
            if k < n:
                before[k] = i
                if sym[k] >= 0 and (r := rank(new << bits | sym[k])) is not None:
                    heapq.heappush(heap, r * n + i)
            k = before[i]
            if k >= 0 and sym[k] >= 0 and (r := rank(sym[k] << bits | new)) is not None:
                heapq.heappush(heap, r * n + k)
        return done


class Counter:
    """Counts as the tokenizers library gives them for a byte-level BPE file without normaliser."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model["ignore_merges"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.merges = Merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in neighbours")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.cache, self.known = Recent(CACHE, self.new_chunk), Recent(CACHE, self.new_piece)

    def new_piece(self, p: str) -> int:
        return len(p) - self.merges.done_in(p)

    def new_chunk(self, s: str) -> int:
        if plain := PLAIN(s):  # letters and marks of ASCII: two pieces at most, and the library's byte names but for the space
            word, marks = plain.groups()
            return self.known[word.replace(" ", SPACE_NAME)] + (self.known[marks] if marks else 0)
        return sum(self.known[p] for p, _ in self.pieces(s))

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return sum(sum(map(self.cache.__getitem__, CHUNK.findall(part))) for part in parts) + len(parts) - 1


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """This worker's counter for a file."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens.

    No begin or end token; the file's special strings inside a text count one each. A null or empty text has 0 tokens;
    repeated rows each give a row; a text of any length is counted whole. An empty table gives no rows; further columns are
    ignored.
    """
    def run(cols: dict) -> dict:
        count = counter_of(path).count
        return {"id": cols["id"], "n_bytes": [len((t or "").encode()) for t in cols["text"]], "n_tokens": [count(t or "") for t in cols["text"]]}

    base = pick(docs, id=id_col, text=text_col)
    return map_batches(base, run, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
