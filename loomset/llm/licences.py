"""Licence notices in texts: a sparse n-gram classifier of paragraphs, confirmed by templates."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.llm.workers import share

UNKNOWN = "unknown"
# Customary short notices of licence families.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "Apache-1.1": [
        "Licensed under the Apache Software License, Version 1.1.",
        "Licensed under the Apache License, Version 1.1.",
        "SPDX-License-Identifier: Apache-1.1",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Released under the GPL v3 license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "Released under the GPL v2 license.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the 3-clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSD-2-Clause": [
        "Licensed under the 2-clause BSD License.",
        "Released under the Simplified BSD License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
}
# Notices of other licences and versions, and denials; all of them are unknown.
OTHER_NOTICES = [
    "Licensed under the Eclipse Public License 2.0.", "Released under the zlib License.", "Released under the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.", "Released under the GPL v1 license.",
    "This work is licensed under a proprietary license.", "Licensed under the Apache Software License, Version 1.0.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "Licensed under CC BY 2.5.",
    "Licensed under CC BY-NC-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-ND 4.0.",
    "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: Unlicense",
    "This work is not released under the MIT License.", "This file is not licensed under the Apache License, Version 2.0.",
]
#: What a paragraph says, by patterns over its lower-case words with single spaces.
FACTS = {
    "apache": r"\bapache\b",
    "mit": r"\bmit licen[cs]e\b|\bidentifier mit\b|\bhereby granted free of charge\b",
    "isc": r"\bisc licen[cs]e\b|\bidentifier isc\b|\bwithout fee is hereby granted\b",
    "gpl": r"\bgeneral public licen[cs]e\b|\b[al]?gpl",
    "lesser": r"\b(?:lesser|library) general public\b|\blgpl",
    "affero": r"\baffero\b|\bagpl",
    "bsd": r"\bbsd\b|\bredistribution and use in source and binary\b",
    "two clauses": r"\b(?:2|two) clause\b|\bsimplified bsd\b|\bbsd 2\b",
    "three clauses": r"\b(?:3|three) clause\b|\bbsd 3\b|\bredistribution and use in source and binary\b",
    "mozilla": r"\bmozilla public licen[cs]e\b|\bmpl",
    "attribution": r"\bcc by\b|\bcreative commons attribution\b",
    "noncommercial": r"\bby nc\b|\bnon ?commercial\b",
    "share alike": r"\b(?:by|nc) sa\b|\bshare ?alike\b",
    "no derivatives": r"\b(?:by|nc) nd\b|\bno ?deriv",
    "denied": r"\b(?:not|never|no longer|isn t|wasn t|aren t) (?:\w+ ){0,2}?(?:licensed|released|distributed|available|covered|published|subject)\b",
}
PATTERNS = {name: re.compile(pattern) for name, pattern in FACTS.items()}
#: A number behind a word that announces the version of a licence.
VERSION = re.compile(
    r"\b(?:version|v|licen[cs]e|apache|[al]?gpl|mpl|by|nc|sa|nd|attribution|noncommercial|commercial|sharealike|alike|noderivatives)"
    r" v?([0-9]+(?:\.[0-9]+)*)\b|\b(?:[al]?gpl|mpl|apache)v?([0-9]+(?:\.[0-9]+)*)\b"
)
#: Per family: facts that it has, facts that it must not have, its version and the versions that contradict it.
RULES = {
    "Apache-2.0": ({"apache"}, set(), "2", {"1", "1.1"}),
    "Apache-1.1": ({"apache"}, set(), "1.1", {"1", "2"}),
    "MIT": ({"mit"}, {"isc"}, None, set()),
    "ISC": ({"isc"}, {"mit"}, None, set()),
    "GPL-3.0": ({"gpl"}, {"lesser", "affero"}, "3", {"1", "2", "2.1"}),
    "GPL-2.0": ({"gpl"}, {"lesser", "affero"}, "2", {"1", "2.1", "3"}),
    "LGPL-3.0": ({"gpl", "lesser"}, {"affero"}, "3", {"2", "2.1"}),
    "LGPL-2.1": ({"gpl", "lesser"}, {"affero"}, "2.1", {"2", "3"}),
    "AGPL-3.0": ({"gpl", "affero"}, {"lesser"}, "3", {"1", "2"}),
    "BSD-3-Clause": ({"bsd", "three clauses"}, {"two clauses"}, None, set()),
    "BSD-2-Clause": ({"bsd", "two clauses"}, set(), None, set()),
    "MPL-2.0": ({"mozilla"}, set(), "2", {"1", "1.1"}),
    "CC-BY-NC-4.0": ({"attribution", "noncommercial"}, {"share alike", "no derivatives"}, "4", {"1", "2", "2.5", "3"}),
    "CC-BY-SA-4.0": ({"attribution", "share alike"}, {"noncommercial", "no derivatives"}, "4", {"1", "2", "2.5", "3"}),
    "CC-BY-4.0": ({"attribution"}, {"noncommercial", "share alike", "no derivatives"}, "4", {"1", "2", "2.5", "3"}),
}
#: Every pattern of a fact that a family has needs one of these; a text without them has no notice.
STEMS = re.compile(r"licen[cs]e|granted|redistribution|spdx|gpl|bsd|apache|mozilla|mpl|creative|cc", re.IGNORECASE)
#: Sentences with words of notices that grant nothing.
DECOYS = [
    "The driver showed a licence and was free to go.", "A version of this work was published by the general public.",
    "The apache tribe and the mit campus are far apart.", "Please use the file in the terms of the contract.",
    "Copies of the source are not permitted here.", "The foundation published version 3 of the report.",
]
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: Rows that the fit uses: variants of each template, and paragraphs of the corpus at most.
VARIANTS = 60
MAX_PARAGRAPHS = 3_000
#: Documents whose lines are drawn from, on average, and the characters of a line that count there.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 2_000
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6


def ngrams(words: list[str], most: int = 3) -> set[str]:
    """The runs of one to ``most`` words of a paragraph."""
    return {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def confirmed(family: str, words: list[str]) -> bool:
    """Whether a paragraph says what tells the family from its neighbours, in the right version, and does not deny it."""
    said = " ".join(words)
    has, lacks, version, others = RULES[family]
    found = lambda fact: PATTERNS[fact].search(said) is not None
    if not all(map(found, has)) or any(map(found, lacks)) or found("denied"):
        return False
    if version is None:
        return True
    numbers = {(a or b).removesuffix(".0") for a, b in VERSION.findall(said)}
    return version in numbers and not numbers & others


#: Words of the longest template.
LONGEST = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)


@dataclass(frozen=True)
class LicenceModel:
    """Weights of n-grams per family, intercepts, the temperature of the probabilities, and templates."""

    families: tuple[str, ...]
    weights: dict[str, np.ndarray]
    intercepts: np.ndarray
    temperature: float
    templates: dict[str, list[set[str]]]

    def signals(self) -> frozenset[str]:
        """The words without which no family can gain on the unknown class."""
        last = self.families.index(UNKNOWN)
        good = [g for g, w in self.weights.items() if (np.delete(w, last) - w[last]).max() > 0]
        return frozenset(g.split(" ")[0] for g in good)

    def margins(self, words: list[str]) -> np.ndarray:
        found = [self.weights[g] for g in ngrams(words) if g in self.weights]
        return self.intercepts + (np.sum(found, axis=0) if found else 0.0)

    def predict(self, words: list[str]) -> tuple[str, float]:
        """The likeliest family and its calibrated probability."""
        p = softmax(self.margins(words)[None] / self.temperature)[0]
        return self.families[int(p.argmax())], float(p.max())

    def similarity(self, family: str, words: list[str]) -> float:
        """The largest share of a template's pairs of words that the paragraph has."""
        have = ngrams(words, 2) - ngrams(words, 1)
        return max((len(t & have) / len(t) for t in self.templates.get(family, []) if t), default=0.0)

    def likest(self, words: list[str]) -> float:
        """The largest similarity with any family."""
        return max(self.similarity(f, words) for f in self.templates)

    def pairs(self) -> frozenset[tuple[str, str]]:
        """The pairs of words of all templates."""
        return frozenset(tuple(g.split(" ")) for ts in self.templates.values() for t in ts for g in t)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_rows(paragraphs: list[str], seed: int = 7) -> list[tuple[str, list[str]]]:
    """(family, words): templates with words lost and corpus words around, and what is no notice."""
    rng = random.Random(seed)
    plain = [w for p in (words_of(p) for p in paragraphs) if (w := p)]
    pool = [w for p in plain for w in p] or ["text"]
    around = lambda: [rng.choice(pool) for _ in range(rng.choice((0, 0, 0, 3, 12)))]
    rows: list[tuple[str, list[str]]] = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            own = words_of(text)
            for k in range(VARIANTS):
                loss = 0.0 if k % 3 == 0 else rng.random() * 0.2
                rows.append((family, around() + [w for w in own if rng.random() >= loss] + around()))
    every = [w for texts in TEMPLATES.values() for text in texts for w in words_of(text)]
    rows += [(UNKNOWN, p) for p in plain]
    rows += [(UNKNOWN, around() + words_of(d) + around()) for d in [*DECOYS, *OTHER_NOTICES] for _ in range(VARIANTS // 2)]
    rows += [(UNKNOWN, around() + [rng.choice(every) for _ in range(rng.randint(1, 6))] + around()) for _ in range(VARIANTS * 8)]
    return rows


def learn(spark: SparkSession, docs: DataFrame, text: str = "text", penalty: float = 0.0005) -> LicenceModel:
    """Fit on template variants and on at most MAX_PARAGRAPHS lines of about SAMPLE_DOCS documents.

    The documents are those with the smallest hash of their text, by a bound that their number gives, so
    that what reaches the driver does not grow with the tasks; copies of a line count once. Paragraphs that name
    a licence by a template's words are no examples of the unknown class, but notices of
    other licences and denials are. The n-grams are those of the templates, notices and decoys: the corpus
    adds no others, so the model's size is fixed. Every fifth row is held back to set the temperature.
    """
    bound = int(min(1.0, SAMPLE_DOCS / max(docs.count(), 1)) * (1 << 52))
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(1 << 52)) < bound)
    lines = some.select(F.explode(F.split(F.col(text), "\n")).alias("line")).filter(F.trim("line") != "")
    lines = lines.filter(~F.lower("line").rlike("licen[cs]e|licensed|spdx|hereby granted|redistribution and use"))
    lines = lines.select(F.left("line", F.lit(SAMPLE_CHARS)).alias("line")).distinct()
    drawn = lines.orderBy(F.xxhash64("line"), "line").limit(MAX_PARAGRAPHS).collect()
    rows = training_rows([r.line for r in drawn])
    known = [*(t for ts in TEMPLATES.values() for t in ts), *DECOYS, *OTHER_NOTICES]
    vocabulary = sorted(set().union(*(ngrams(words_of(t)) for t in known)))
    place = {g: i for i, g in enumerate(vocabulary)}
    families = (*TEMPLATES, UNKNOWN)
    vector = lambda words: SparseVector(len(place), {place[g]: 1.0 for g in ngrams(words) if g in place})
    fit = [(float(families.index(f)), vector(w)) for i, (f, w) in enumerate(rows) if i % 5]
    table = spark.createDataFrame(fit, ["label", "features"]).repartition(4)
    model = LogisticRegression(regParam=penalty, elasticNetParam=1.0, standardization=False, family="multinomial", maxIter=80)
    model = model.fit(table)
    matrix = model.coefficientMatrix.toArray()
    weights = {g: matrix[:, i] for g, i in place.items() if matrix[:, i].any()}
    bags = {f: [ngrams(words_of(t), 2) - ngrams(words_of(t), 1) for t in ts] for f, ts in TEMPLATES.items()}
    made = LicenceModel(families, weights, model.interceptVector.toArray(), 1.0, bags)
    held = [(families.index(f), made.margins(w)) for i, (f, w) in enumerate(rows) if i % 5 == 0]
    truth, margins = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    loss = lambda t: -np.log(softmax(margins / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    return LicenceModel(families, weights, made.intercepts, float(min(np.geomspace(0.05, 5, 60), key=loss)), bags)


def scan(docs: DataFrame, model: LicenceModel, text: str = "text", found: str = "licences") -> DataFrame:
    """``docs`` with its text replaced by its notices: an array of (paragraph, start, length, family, probability, similarity).

    A paragraph is a line, or several lines with no wordless one between them, none of which
    is a notice by itself; it is named by its first line, counted from 0, and its place is in
    characters. A notice is a paragraph of a known family at a probability of
    MIN_PROBABILITY or more that has MIN_SIMILARITY of a template of that family and the words that tell it
    from its neighbours: version, number of clauses, kind of attribution, and no denial. Any other
    is unknown and not returned. Comment marks are no words.
    Narrow; a null or empty text has none, and rows keep their order and repeats.
    """
    kept = [c for c in docs.columns if c not in (text, found)]
    get = share(docs.sparkSession, model)
    entry = T.StructType.fromDDL("paragraph int, start int, length int, family string, probability double, similarity double")
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(found, T.ArrayType(entry))])
    kind = pa.list_(pa.struct([
        ("paragraph", pa.int32()), ("start", pa.int32()), ("length", pa.int32()),
        ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()),
    ]))

    def judge(words: list[str]) -> tuple[str, float, float] | None:
        family, probability = get().predict(words)
        if family != UNKNOWN and probability >= MIN_PROBABILITY:
            like = get().similarity(family, words)
            if like >= MIN_SIMILARITY and confirmed(family, words):
                return family, probability, like
        return None

    def notices(whole: str, signals: frozenset[str], pairs: frozenset[tuple[str, str]]) -> list[tuple]:
        if not STEMS.search(whole):
            return []
        lines = whole.split("\n")
        words = [words_of(line) for line in lines]
        found = {(i, i): hit for i, own in enumerate(words) if not signals.isdisjoint(own) and (hit := judge(own))}
        taken, done = {i for i, _ in found}, -1
        for i, own in enumerate(words):
            after = own[1:] + (words[i + 1][:1] if i + 1 < len(words) else [])
            if i > done and i not in taken and not pairs.isdisjoint(zip(own, after)) and (hit := wrapped(words, i, taken)):
                found[hit[0]], done = hit[1], hit[0][1]
        starts = np.concatenate(([0], np.cumsum([len(line) + 1 for line in lines])))
        return [(i, int(starts[i]), int(starts[j + 1] - 1 - starts[i]), *hit) for (i, j), hit in sorted(found.items())]

    def wrapped(words: list[list[str]], first: int, taken: set[int]) -> tuple[tuple[int, int], tuple] | None:
        """The likest notice over several lines of a paragraph from line ``first`` on, and its lines.

        After its first line a notice has at most the words of the longest template.
        """
        best, last, more, joined = None, first + 1, 0, list(words[first])
        while last < len(words) and words[last] and last not in taken and more < LONGEST:
            joined += words[last]
            more += len(words[last])
            if get().likest(joined) >= MIN_SIMILARITY and (hit := judge(joined)) and (not best or hit[2] > best[1][2]):
                best = (first, last), hit
            last += 1
        while best and best[0][0] + 1 < best[0][1]:
            (i, j), hit = best
            less = judge([w for line in words[i + 1 : j + 1] for w in line])
            if not less or less[2] < hit[2]:
                break
            best = (i + 1, j), less
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signals, pairs = get().signals(), get().pairs()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hits = [notices(t or "", signals, pairs) for t in part.column(text).to_pylist()]
                names = [f.name for f in entry]
                values = pa.array([[dict(zip(names, h, strict=True)) for h in hs] for hs in hits], kind)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], values], names=[*kept, found])

    return docs.mapInArrow(run, schema)
