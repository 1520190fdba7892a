"""Licence scans by a positional index of rare template words."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, map_batches, pick

#: Base phrases and their labels; these come from the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label, wording of a public licence, phrases of which each must stand in the matched part.
TEMPLATES = (
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "and or distribute")),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ("affero general public license", "version 3")),
    ("agpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the License", ("except in compliance",)),
    ("apache-2.0", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ("warranties or conditions of any kind",)),
    ("artistic-2.0", "This package is free software; you may distribute it under the terms of the Artistic License 2.0", ("artistic license", "2 0")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use", "source and binary forms")),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("endorse or promote",)),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nd-4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("attribution noderivatives 4 0",)),
    ("cc-by-sa-3.0", "licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", ("attribution sharealike 3 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("cc0-1.0", "released under CC0 1.0 Universal", ("cc0 1 0",)),
    ("epl-1.0", "made available under the terms of the Eclipse Public License v1.0", ("eclipse public license", "v1 0")),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license", "2 0")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "modify and distribute")),
    ("isc", "Released under the ISC License", ("isc license",)),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ("lesser general public license", "version 2 1")),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3", ("lesser general public license", "version 3")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy", ("hereby granted", "free of charge")),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ("substantial portions",)),
    ("mpl-1.1", "subject to the Mozilla Public License Version 1.1", ("mozilla public license", "1 1")),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", ("compiled binary",)),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ("you want to public license",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable", ("without any express or implied warranty", "held liable")),
)
# Sentences of the licences' own texts, so that a file that holds only a part of one is seen.
BODIES = (
    ("agpl-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software", ("network server software",)),
    ("apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form", ("irrevocable copyright license", "source or object form")),
    ("apache-2.0", "Work shall mean the work of authorship, whether in Source or Object form, made available under the License, as indicated by a copyright notice that is included in or attached to the work", ("work of authorship",)),
    ("apache-2.0", "You must cause any modified files to carry prominent notices stating that You changed the files", ("prominent notices stating that you changed the files",)),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistributions of source code",)),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ("redistributions in binary form",)),
    ("bsd", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("copyright holders and contributors", "are disclaimed")),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement", ("all advertising materials",)),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    ("cc0-1.0", "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights", ("waives abandons and surrenders",)),
    ("gpl-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software", ("take away your freedom",)),
    ("gpl-2.0", "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium", ("copy and distribute verbatim copies of the program",)),
    ("gpl-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works", ("gnu general public license is a free",)),
    ("gpl-3.0", "You may convey verbatim copies of the Program's source code as you receive it, in any medium", ("convey verbatim copies of the program",)),
    ("isc", "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("author disclaims all warranties",)),
    ("lgpl-2.1", "We call this license the \"Lesser\" General Public License because it does Less to protect the user's freedom than the ordinary General Public License", ("does less to protect",)),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", ("without restriction", "sublicense and or sell copies")),
    ("mit", "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", ("purpose and noninfringement",)),
    ("mit", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software", ("use or other dealings in the software",)),
    ("mpl-2.0", "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license", ("world wide royalty free",)),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain", ("dedicate any and all copyright interest",)),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", ("altered source versions",)),
)
#: Share of a template's words, weighted by rarity, that must stand in place.
ENOUGH = 0.8
#: Share of a template's weight that its rare words make up at least, above what a match may lack.
RARE = 0.2
_TABLE = byte_table()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Index:
    """Postings of the templates' rare words: word -> (template, position). A word's IDF is over the templates.

    A template's rare words are those of its positions of highest IDF that together weigh RARE more than a match may lack. Any
    match so has rare words in place that weigh RARE at least: only their postings are kept, and common words are never looked up.
    """

    def __init__(self, base: dict[str, str] = BASE, templates=(*TEMPLATES, *BODIES)):
        self.base = [(p.encode().split(), label) for p, label in base.items()]
        self.templates = [(label, words_of(t.encode()), [k.encode().split() for k in keys]) for label, t, keys in templates]
        holders: dict[bytes, set[int]] = defaultdict(set)
        for t, (_, words, _) in enumerate(self.templates):
            for w in words:
                holders[w].add(t)
        n = len(self.templates)
        self.idf = {w: math.log((n + 1) / len(ts)) for w, ts in holders.items()}
        self.weight = [sum(self.idf[w] for w in words) for _, words, _ in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        #: Weight of rare words in place that a candidate needs.
        self.need: list[float] = []
        for t, (_, words, _) in enumerate(self.templates):
            held, lack = 0.0, (1 - ENOUGH) * self.weight[t]
            for i in sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], i)):
                if held >= lack + RARE * self.weight[t]:
                    break
                self.postings[words[i]].append((t, i))
                held += self.idf[words[i]]
            self.need.append(held - lack)
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys([*self.postings, *(p[0] for p, _ in self.base)]), 1)}

    def candidates(self, words: list[bytes], at: np.ndarray) -> list[tuple[int, int]]:
        """(template, start) where the rare words in place weigh enough: postings met at one relative position."""
        weight: dict[tuple[int, int], float] = defaultdict(float)
        for i in at.tolist():
            w = words[i]
            for t, p in self.postings.get(w, ()):
                weight[t, i - p] += self.idf[w]
        return [c for c, x in weight.items() if x >= self.need[c[0]] - 1e-9]

    def score(self, words: list[bytes], t: int, start: int) -> float:
        """Share of the template's weight in place; 0 unless it is enough and all key phrases stand in that window."""
        _, want, keys = self.templates[t]
        share = sum(self.idf[x] for j, x in enumerate(want) if 0 <= start + j < len(words) and words[start + j] == x) / self.weight[t]
        if share < ENOUGH - 1e-9:
            return 0.0
        window = words[max(0, start) : max(0, start + len(want))]
        return share if all(any(window[k : k + len(key)] == key for k in range(len(window) - len(key) + 1)) for key in keys) else 0.0

    def match(self, words: list[bytes], at: np.ndarray) -> tuple[list[tuple[str, float]], float]:
        """Labels with their scores, and the best score. at: positions of words that the index has."""
        found: dict[str, float] = {}
        for t, start in self.candidates(words, at):
            if share := self.score(words, t, start):
                label = self.templates[t][0]
                found[label] = max(found.get(label, 0.0), share)
        return sorted(found.items()), max(found.values(), default=0.0)

    def base_places(self, words: list[bytes], at: np.ndarray) -> tuple[list[int], set[str]]:
        starts, labels = [], set()
        for phrase, label in self.base:
            here = [i for i in at.tolist() if words[i] == phrase[0] and words[i : i + len(phrase)] == phrase]
            starts += here
            labels |= {label} if here else set()
        return starts, labels


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates=(*TEMPLATES, *BODIES)) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, score).

    Words as in decontamination. n_base counts all places of base phrases, first_word and last_word are their smallest and
    largest start (null without any). labels unites base labels and those of matched templates. score is the best template's
    share of weighted words in place; a base phrase alone scores 0.5; 0 without any label. Null or empty texts have no words, score 0
    and have empty labels; rows that repeat an id each give a row; texts of any length are read whole; an empty table gives no rows;
    further columns are ignored.
    """
    index = Index(base, templates)

    def run(cols: dict) -> dict:
        out: dict[str, list] = defaultdict(list)
        get = index.vocab.get
        for text in cols["text"]:
            words = words_of(text)
            at = np.flatnonzero(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            starts, base_labels = index.base_places(words, at) if len(at) else ([], set())
            matches, score = index.match(words, at) if len(at) else ([], 0.0)
            out["n_words"].append(len(words))
            out["n_base"].append(len(starts))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(base_labels)))
            out["labels"].append(",".join(sorted(base_labels | {m for m, _ in matches})))
            out["score"].append(min(1.0, max(score, 0.5 if starts else 0.0)))
            out["matches"].append([{"label": m, "score": s} for m, s in matches])
        return {"id": cols["id"]} | {k: out[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}

    rows = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<label:string,score:double>>"
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)
