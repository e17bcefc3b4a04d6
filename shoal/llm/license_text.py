"""License scan: a trained paragraph classifier with template comparison.

Paragraphs are blocks between blank lines; line ends inside count as spaces. A
multinomial logistic regression over word uni- and bigrams names the licence
family of a passage or 'unknown'; its probabilities are calibrated by a
temperature on held-out rows. Passages are the paragraph, its lines, its
sentences and runs of up to RUN of either. A prediction counts only if the
passage and a template of the family share their word bigrams to a large part,
among them bigrams that no other family has, and no other version is named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shoal.llm.common import with_workers

# Customary notices and passages of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL, version 2.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
UNKNOWN = "unknown"
# Sentences about licences that grant none.
OTHER = (
    "A driver must carry a license and show it to the police when asked.",
    "The license of the restaurant was renewed by the city last year.",
    "We compared several software licenses and their terms in this article.",
    "The copyright of the novel is held by the family of the author.",
    "All rights reserved.", "Copyright 2020 by the authors.",
    "The museum is open to the public free of charge on Sundays.",
    "He was released from prison under the terms of a general amnesty.",
    "The version of the program that we use is distributed with the book.",
    "Students may obtain a copy of the form at the office, version 2.0 of which is new.",
    "The warranty covers parts and labour for any purpose for two years.",
    "The software was published and sold by a company in the general trade.",
    "The use of this file is described in the following section.",
    "MIT is a university; the Apache are a people; the foundation gives creative prizes.",
    "You should have received this letter along with the other documents.",
    # Notices of licences outside the families.
    "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2",
    "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "This program is free software; you can redistribute it under the terms of the Artistic License 2.0.",
    "Released under the zlib License.", "Licensed under the Microsoft Public License.",
    "Licensed under a commercial license; use without the written permission of the company is not allowed.",
)
# Word runs of a corpus sample that join the unknown class, at most.
FIT_LINES = 2000
CERTAIN = 0.5
SHARED = 0.6
# Adjacent lines or sentences that are tested together, at most.
RUN = 3
WORDS = re.compile(r"[a-z0-9]+")
SENTENCE = re.compile(r"[.!?]\s+")
VERSION = re.compile(r"(?:version|licen[sc]e|v\.?|-)[\s,v]*([0-9]+\.[0-9]+)", re.IGNORECASE)


def words_of(line: str) -> list[str]:
    return WORDS.findall(line.lower())


def grams_of(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@dataclass
class Classifier:
    families: list[str]
    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    templates: dict[str, list[tuple[set, set]]] = field(default_factory=dict)
    marks: set = field(default_factory=set)

    def __post_init__(self) -> None:
        self.templates = own_bigrams()
        self.marks = set().union(*(own for pairs in self.templates.values() for _, own in pairs))

    def logits(self, lines: list[list[str]]) -> np.ndarray:
        out = np.tile(self.bias, (len(lines), 1))
        for i, words in enumerate(lines):
            at = [self.index[g] for g in set(grams_of(words)) if g in self.index]
            if at:
                out[i] += self.weights[at].sum(axis=0) / np.sqrt(len(at))
        return out

    def predict(self, passage: str) -> tuple[str, float] | None:
        """Family and probability of a passage, confirmed by a template."""
        words = words_of(passage)
        mine = bigrams(words)
        if not mine & self.marks:  # no template could confirm it
            return None
        logits = self.logits([words])[0] / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(np.argmax(p))
        family = self.families[best]
        if family == UNKNOWN or p[best] < CERTAIN or not self.confirmed(family, passage, mine):
            return None
        return family, float(p[best])

    def confirmed(self, family: str, passage: str, mine: set) -> bool:
        """Whether a template of the family, or a part of one, stands in the passage."""
        named, version = VERSION.findall(passage), VERSION.findall(family)
        if version and named and version[0] not in named:
            return False
        for theirs, own in self.templates[family]:
            both = mine & theirs
            if len(both) >= SHARED * len(theirs) and 2 * len(both & own) >= len(own) > 0:
                return True
            if len(mine) >= 4 and len(both) >= SHARED * len(mine) and both & own:
                return True
        return False

    def spans(self, body: str) -> list[tuple[str, int, int]]:
        """(family, start, end) of the passages of a text, by place.

        Of the passages of a paragraph that are predicted and confirmed, longer
        ones come first; one that holds a passage of another family gives way
        to it, one that meets a chosen passage of its own family adds nothing.
        """
        found = []
        for at, end in paragraphs(body):
            if not HINT.search(body, at, end):
                continue
            hits = []
            for start, stop in passages(body, at, end):
                if HINT.search(body, start, stop) and (hit := self.predict(body[start:stop])):
                    hits.append((hit[0], start, stop))
            found.extend(_choose(hits))
        return sorted(found, key=lambda s: s[1:])


def _choose(hits: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The longest passages that hold no passage of another family.

    Passages are runs of at most RUN pieces, except for the paragraph itself,
    so each is compared with its neighbours by place only.
    """
    hits = sorted(set(hits), key=lambda s: (s[1], -s[2]))
    kept = []
    for i, (family, start, stop) in enumerate(hits):
        mixed = False
        for j in range(i + 1, len(hits)):
            other, a, b = hits[j]
            if a >= stop:
                break
            if other != family and b <= stop:
                mixed = True
                break
        # one that begins at the same place and is longer stands before it
        if not mixed:
            kept.append((family, start, stop))
    chosen: list[tuple[str, int, int]] = []
    last: dict[str, int] = {}
    for family, start, stop in kept:
        if start >= last.get(family, 0):
            chosen.append((family, start, stop))
            last[family] = stop
    return chosen


def paragraphs(body: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the blocks of lines that are not blank."""
    start, at = None, 0
    for line in body.split("\n"):
        if line.strip():
            start = at if start is None else start
        elif start is not None:
            yield start, at - 1
            start = None
        at += len(line) + 1
    if start is not None:
        yield start, len(body)


def passages(body: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The paragraph, its lines and sentences, and runs of up to RUN of either."""
    yield start, end
    for pattern in (LINE_END, SENTENCE):
        cuts = [start, *(m.end() for m in pattern.finditer(body, start, end)), end]
        cuts = [a for a, b in zip(cuts, cuts[1:]) if a < b] + [end]
        for n in range(1, RUN + 1):
            yield from zip(cuts, cuts[n:])


LINE_END = re.compile(r"\n")


def bigrams(words: list[str]) -> set:
    """Word pairs in which numbers count alike; versions are compared apart."""
    plain = ["0" if w.isdigit() else w for w in words]
    return set(zip(plain, plain[1:]))


def own_bigrams() -> dict[str, list[tuple[set, set]]]:
    """For every template its bigrams, and those of them that no other family or other notice has."""
    seen = {f: set().union(*(bigrams(words_of(t)) for t in texts)) for f, texts in TEMPLATES.items()}
    seen[UNKNOWN] = set().union(*(bigrams(words_of(t)) for t in OTHER))
    rest = {f: set().union(*(seen[g] for g in seen if g != f)) for f in TEMPLATES}
    return {f: [(b, b - rest[f]) for b in (bigrams(words_of(t)) for t in texts)] for f, texts in TEMPLATES.items()}


def _examples(lines: list[str], seed: int) -> tuple[list[list[str]], list[str]]:
    """Labelled word lists: templates whole, cut, and inside other words; other lines as unknown."""
    rng = np.random.default_rng(seed)
    fill = [w for line in [*lines, *OTHER] for w in words_of(line)] or ["text"]
    rows, labels = [], []

    def around(n: int) -> list[str]:
        return [fill[i] for i in rng.integers(0, len(fill), int(n))]

    for family, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            for _ in range(40):
                some = [str(rng.integers(1, 5)) if w.isdigit() and rng.random() < 0.5 else w for w in words]
                if len(some) > 12 and rng.random() < 0.5:
                    begin = int(rng.integers(0, len(some) - 10))
                    some = some[begin : begin + int(rng.integers(10, len(some) - begin + 1))]
                elif rng.random() < 0.2:
                    some = [w for w in some if rng.random() > 0.1]
                rows.append([*around(rng.integers(0, 6)), *some, *around(rng.integers(0, 6))])
                labels.append(family)
    for text in OTHER:
        for _ in range(30):
            rows.append([*around(rng.integers(0, 6)), *words_of(text), *around(rng.integers(0, 6))])
            labels.append(UNKNOWN)
    for line in lines:
        rows.append(words_of(line)[:200])
        labels.append(UNKNOWN)
    return rows, labels


def fit(lines: list[str], seed: int = 3) -> Classifier:
    """Train on templates, other sentences and `lines` of a corpus, which stand for unknown text."""
    rows, labels = _examples(lines, seed)
    families = [*TEMPLATES, UNKNOWN]
    known = sorted({g for t in [*sum(TEMPLATES.values(), ()), *OTHER] for g in grams_of(words_of(t))})
    index = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(rows), len(index)), np.float32)
    for i, words in enumerate(rows):
        at = [index[g] for g in set(grams_of(words)) if g in index]
        x[i, at] = 1 / np.sqrt(max(1, len(at)))
    y = np.array([families.index(z) for z in labels])
    order = np.random.default_rng(seed).permutation(len(rows))
    held, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    weights, bias = np.zeros((len(index), len(families))), np.zeros(len(families))
    speed_w, speed_b = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    for epoch in range(12):
        for at in np.array_split(np.random.default_rng([seed, epoch]).permutation(train), max(1, len(train) // 256)):
            z = x[at] @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            gw, gb = x[at].T @ p / len(at) + 1e-5 * weights, p.mean(axis=0)
            speed_w += gw * gw
            speed_b += gb * gb
            weights -= 0.5 * gw / np.sqrt(speed_w)
            bias -= 0.5 * gb / np.sqrt(speed_b)
    z = x[held] @ weights + bias

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(held)), y[held]] - np.log(np.exp(s).sum(axis=1))).mean())

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return Classifier(families, index, weights, bias, temperature)


# Passages without any of these words are passed over: each template has one in every part
# that is long enough to be confirmed by its bigrams.
HINT = re.compile(
    r"licen[sc]e|permission|redistribut|copyright|free software|public license|public domain|warrant|spdx|creative commons"
    r"|free to copy|compliance with|mozilla",
    re.IGNORECASE,
)


def scan_licenses(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ident, n_paragraphs, families, spans.

    `families` are the different licence families found, sorted and joined by
    commas; `spans` are family:start:end of each passage in code points, end
    exclusive, by place, and n_paragraphs is their number. A null or empty text
    has none, repeated rows are scanned alike, an empty table gives no rows,
    other columns are not read. Of equally probable families the one that
    stands first in TEMPLATES is taken. The work grows with a text's length,
    save that each passage is compared with the confirmed ones it overlaps. The unknown class
    is fit on at most FIT_LINES lines, of documents chosen by a hash of the text.
    """
    spark = with_workers(docs)
    unit = F.pmod(F.xxhash64(text), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.where(unit < float(min(1.0, FIT_LINES / max(1, docs.count()))))
    lines = chosen.select(F.explode(F.split(F.col(text), "\n")).alias("line")).where("length(line) between 20 and 2000")
    lines = lines.where(~F.lower("line").rlike("licen[sc]e|copyright|permission")).distinct()
    sample = [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(FIT_LINES).collect()]
    model = spark.sparkContext.broadcast(fit(sample))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            found = []
            for body in batch.column("text").to_pylist():
                spans = m.spans(body) if body else []
                found.append((len(spans), ",".join(sorted({s[0] for s in spans})), ",".join(f"{f}:{a}:{b}" for f, a, b in spans)))
            columns = [[f[i] for f in found] for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("ident"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                ["ident", "n_paragraphs", "families", "spans"],
            )

    kind = dict(docs.dtypes)[ident]
    rows = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, f"ident {kind}, n_paragraphs long, families string, spans string").withColumnRenamed("ident", ident)
