"""Licence scan: a trained n-gram classifier of paragraphs, confirmed against templates.

A text without any ANCHOR cannot hold a confirmed notice, as every template has one, and
is passed over. In the others a line counts as licence-like if it holds an anchor or
two word triples of the templates, the words before it included, so that wrapped notices
are met; licence-like lines that follow one another are a paragraph, and a line without
words ends it. Word pairs and triples of the templates and of near misses are the features of a
softmax regression over licence families and an unknown class. It is trained on the
driver from the templates with words dropped and changed, and, as unknown, from notices of
other licences and other versions, single pieces of notices, and a bounded sample of
the corpus's own lines; a temperature on held-back rows calibrates its probabilities.

A prediction stands if its probability reaches PROBABLE and one of the family's
templates confirms it: the paragraph holds CONFIRM of its pairs and all phrases that it
cannot do without, which are the name and the version. What is predicted unknown or not
confirmed, but has UNKNOWN_HITS features or more, is reported as unknown. Paragraphs
are found and scored in their rows by DataFrame expressions: no shuffle, no Python.

Defined results: null and empty texts and texts without a licence-like line give no row;
repeated rows each give theirs; a null doc_id keeps its rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

ANCHORS = ("licen", "copyright", "rights reserved", "permission", "redistribut", "unencumbered")
#: Notices by which licence families are known, and the phrases that each must hold.
NOTICES = {
    "Apache-2.0": (
        ("Licensed under the Apache License, Version 2.0.", ("apache license", "version 2 0")),
        ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license", "version 2 0")),
    ),
    "MIT": (
        ("Released under the MIT License.", ("mit license",)),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("granted free of charge to any person obtaining a copy of this software and associated documentation files",)),
        ("to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("deal in the software without restriction",)),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("shall be included in all copies or substantial portions of the software",)),
    ),
    "ISC": (
        ("Released under the ISC License.", ("isc license",)),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee is hereby granted",)),
    ),
    "BSD": (("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("in source and binary forms with or without modification are permitted",)),),
    "BSD-2-Clause": (("Licensed under the BSD 2-Clause License.", ("bsd 2 clause",)),),
    "BSD-3-Clause": (
        ("Licensed under the BSD 3-Clause License.", ("bsd 3 clause",)),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("may be used to endorse or promote products derived from this software without specific prior written permission",)),
    ),
    "MPL-2.0": (
        ("Licensed under the Mozilla Public License, Version 2.0.", ("mozilla public license", "version 2 0")),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license", "v 2 0")),
    ),
    "Unlicense": (("This is free and unencumbered software released into the public domain.", ("unencumbered software released into the public domain",)),),
    "CC0-1.0": (("Licensed under CC0 1.0.", ("cc0 1 0",)), ("This work is licensed under the CC0 1.0 Universal Public Domain Dedication license.", ("cc0 1 0 universal",))),
    "proprietary": (("All rights reserved.", ("all rights reserved",)), ("Copyright. All rights reserved. No part of this publication may be reproduced without permission.", ("all rights reserved",))),
}
GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Licences and versions that are not among the families, to learn the unknown class from.
OTHERS = ("Eclipse Public License", "Boost Software License", "Artistic License", "zlib License", "European Union Public Licence", "Open Software License", "Microsoft Public License", "Apache License", "Mozilla Public License", "GNU General Public License", "GNU Lesser General Public License", "Academic Free License", "Common Public License")
OTHER_VERSIONS = ("0.9", "1.0", "1.1", "1.2", "2.3", "4", "5.0")
PROBABLE, CONFIRM, UNKNOWN_HITS = 0.5, 0.5, 3
SAMPLE_DOCS, VARIANTS, STEPS = 200, 40, 250
TOKEN = r"[a-z0-9]+"


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in (2, 3) for k in range(len(words) - n + 1)}


def templates() -> dict[str, tuple[tuple[str, tuple[str, ...]], ...]]:
    """Family to (notice, required phrases)."""
    out = dict(NOTICES)
    for family, (kind, version) in GNU.items():
        name, of = f"GNU {kind} Public License", " ".join(tokens(f"version {version}"))
        must = (" ".join(tokens(name)), of)
        out[family] = (
            (f"This work is licensed under the {name}, version {version}.", must),
            (f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.", must),
        )
    for code, name in CREATIVE_COMMONS.items():
        out[f"CC-{code}-4.0"] = (
            (f"Licensed under CC {code} 4.0.", (" ".join(tokens(f"CC {code} 4.0")),)),
            (f"This work is licensed under a Creative Commons {name} 4.0 International License.", (" ".join(tokens(f"Creative Commons {name} 4.0 International")),)),
        )
    return out


def near_misses() -> list[str]:
    """Notices of other licences and versions."""
    out = [f"Licensed under the {name}, Version {v}." for name in OTHERS for v in OTHER_VERSIONS]
    out += [f"Released under the {name}." for name in OTHERS]
    out += [f"Licensed under CC {code} {v}." for code in CREATIVE_COMMONS for v in ("1.0", "2.0", "2.5", "3.0")]
    out += [f"This work is licensed under a Creative Commons {name} {v} License." for name in CREATIVE_COMMONS.values() for v in ("2.0 Generic", "3.0 Unported")]
    return out


class LicenceModel:
    """softmax(bias + sum of weights of the vocabulary's grams) over families, the last being unknown."""

    def __init__(self, families: list[str], vocabulary: list[str], weights: np.ndarray, bias: np.ndarray):
        self.families, self.vocabulary, self.weights, self.bias = families, vocabulary, weights, bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        place = {g: k for k, g in enumerate(self.vocabulary)}
        x = np.zeros((len(texts), len(place)))
        for k, text in enumerate(texts):
            x[k, [place[g] for g in grams(tokens(text)) if g in place]] = 1
        return softmax(x @ self.weights + self.bias)


def train(unknown: list[str]) -> LicenceModel:
    """Softmax regression on variants of templates, and near misses, pieces and unknown paragraphs."""
    held, rng = templates(), np.random.default_rng(8)
    families, others = [*held, "unknown"], near_misses()
    texts = [(t, k) for k, ts in enumerate(held.values()) for t, _ in ts] + [(t, len(held)) for t in others]
    vocabulary = sorted(set().union(*(grams(tokens(t)) for t, _ in texts)))
    place = {g: k for k, g in enumerate(vocabulary)}
    filler = [w for t in unknown for w in tokens(t)][:5000] or ["text"]
    rows, classes = [], []
    for text, k in texts:
        words = tokens(text)
        required = set(tokens(" ".join(m for t, must in held.get(families[k], ()) if t == text for m in must)))
        for v in range(VARIANTS if k < len(held) else 4):
            kept = [w if w in required or rng.random() > 0.02 * (v % 4) else filler[rng.integers(len(filler))] for w in words]
            around = [filler[rng.integers(len(filler))] for _ in range(int(rng.integers(0, 8)))]
            rows.append(grams(around + kept))
            classes.append(k)
    known = [grams(tokens(t)) for ts in held.values() for t, _ in ts]
    for text in unknown:
        found = grams(tokens(text))
        if not any(len(found & x) >= CONFIRM * len(x) for x in known):
            rows.append(found)
            classes.append(len(held))
    for gram in vocabulary:  # single pieces of a notice tell nothing
        rows.append({gram})
        classes.append(len(held))
    x, y = np.zeros((len(rows), len(vocabulary)), np.float32), np.array(classes)
    for k, row in enumerate(rows):
        x[k, [place[g] for g in row if g in place]] = 1
    back = rng.random(len(rows)) < 0.2
    w, b, target = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32), np.eye(len(families), dtype=np.float32)[y]
    counts = np.bincount(y, minlength=len(families)).clip(1)
    counts[-1] //= 4  # the unknown class is many kinds of text
    share = ((1 / counts)[y] * ~back).astype(np.float32)
    share /= share.sum()
    for _ in range(STEPS):
        slope = (softmax(x @ w + b) - target) * share[:, None]
        w -= 12 * (x.T @ slope + 1e-4 * w)
        b -= 12 * slope.sum(axis=0)
    scores = (x[back] @ w + b).astype(np.float64)
    heat = min(np.linspace(0.3, 3, 28), key=lambda t: -np.log(softmax(scores / t)[np.arange(back.sum()), y[back]] + 1e-12).mean())
    return LicenceModel(families, vocabulary, w / heat, b / heat)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learn(docs: DataFrame) -> LicenceModel:
    """Trains with the lines of the SAMPLE_DOCS documents least by a hash of id and text; each gives at most 40.

    A bound on the hash that lets four times as many through, by the count of rows,
    comes first, so what reaches the driver does not grow with the corpus.
    """
    bound = min(1.0, 4 * SAMPLE_DOCS / max(1, docs.count())) * 2.0**64 - 2.0**63
    hashed = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h")).where(F.col("h").cast("double") <= bound)
    held = hashed.select("h", F.slice(F.split(F.substring("text", 1, 20_000), "\n"), 1, 40).alias("lines")).orderBy("h", "lines").limit(SAMPLE_DOCS).collect()
    return train([line for row in held for line in row["lines"] if line.strip()])


def words_sql(words: list[str]) -> str:
    """SQL: an array of words and phrases, which the optimizer reads once."""
    return f"split('{'|'.join(words)}', '[|]')"


#: SQL: word triples of an array v, and pairs and triples of an array w.
TRIPLES = "if(size(v) < 3, cast(array() as array<string>), transform(slice(v, 1, size(v) - 2), (a, j) -> concat_ws(' ', a, v[j + 1], v[j + 2])))"
PAIRS = "if(size(v) < 2, cast(array() as array<string>), transform(slice(v, 1, size(v) - 1), (a, j) -> concat_ws(' ', a, v[j + 1])))"


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, line, last_line, words): runs of licence-like lines, counted from 0."""
    triples = sorted({g for ts in templates().values() for t, _ in ts for g in grams(tokens(t)) if g.count(" ") == 2})
    anchored = lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in ANCHORS])
    found = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).where(anchored(F.col("text")))
    lines = found.select("doc_id", F.split("text", "\n").alias("ls")).withColumn("ws", F.transform("ls", lambda x: F.regexp_extract_all(x, F.lit(f"({TOKEN})"))))
    tail = "if(i = 0, cast(array() as array<string>), slice(ws[i - 1], greatest(size(ws[i - 1]) - 1, 1), 2))"
    alike = f"size(array_intersect({let(f'concat({tail}, w)', 'v', TRIPLES)}, {words_sql(triples)})) >= 2"
    anchor = " or ".join(f"contains(ls[i], '{x}')" for x in ANCHORS)
    marked = lines.withColumn("hs", F.expr(f"transform(ws, (w, i) -> size(w) > 0 and ({anchor} or {alike}))"))
    ends = "i + if(array_position(slice(hs, i + 1, size(hs)), false) = 0, size(hs) - i, cast(array_position(slice(hs, i + 1, size(hs)), false) as int) - 1) - 1"
    runs = f"transform(filter(sequence(0, size(hs) - 1), i -> hs[i] and (i = 0 or not hs[i - 1])), i -> struct(i as low, {ends} as high))"
    return marked.select("doc_id", "ws", F.explode(F.expr(runs)).alias("r")).select("doc_id", F.col("r.low").cast("long").alias("line"), F.col("r.high").cast("long").alias("last_line"), F.expr("flatten(slice(ws, r.low + 1, r.high - r.low + 1))").alias("v"))


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """(doc_id, line, last_line, family, probability, template, containment) for each paragraph of a confirmed family or of an unknown licence."""
    model = model or learn(docs)
    held = [(name, f"{name}/{k}", sorted(g for g in grams(tokens(text)) if g.count(" ") == 1), must) for name, ts in templates().items() for k, (text, must) in enumerate(ts)]
    listed = ", ".join(f"struct('{name}' as family, '{key}' as template, {words_sql(pairs)} as pairs, {words_sql([f' {m} ' for m in must])} as must)" for name, key, pairs, must in held)
    sums = ", ".join(f"aggregate(at, {float(model.bias[k])!r}D, (a, k) -> a + cast({words_sql([f'{x:.6g}' for x in model.weights[:, k]])} as array<double>)[k])" for k in range(len(model.families)))
    families = words_sql(model.families)
    confirming = f"filter(array({listed}), t -> t.family = f and forall(t.must, m -> contains(s, m)))"
    best = f"array_max(transform({confirming}, t -> struct(size(array_intersect(hits, t.pairs)) / size(t.pairs) as containment, t.template as template)))"
    known = "named_struct('family', f, 'probability', p, 'template', b.template, 'containment', b.containment)"
    other = "named_struct('family', 'unknown', 'probability', p, 'template', cast(null as string), 'containment', cast(null as double))"
    found = f"if(p >= {PROBABLE} and coalesce(b.containment, 0) >= {CONFIRM}, array({known}), if(size(hits) >= {UNKNOWN_HITS}, array({other}), slice(array({other}), 1, 0)))"
    # One expression in which every step is worked out once: as columns, a filter on them would be copied into every use.
    steps = [
        ("hits", f"array_intersect(concat({PAIRS}, {TRIPLES}), {words_sql(model.vocabulary)})"),
        ("at", f"transform(hits, h -> cast(array_position({words_sql(model.vocabulary)}, h) as int) - 1)"),
        ("z", f"array({sums})"),
        ("top", "array_max(z)"),
        ("f", f"element_at({families}, cast(array_position(z, top) as int))"),
        ("p", "1 / aggregate(z, 0.0D, (a, x) -> a + exp(x - top))"),
        ("s", "concat(' ', concat_ws(' ', v), ' ')"),
        ("b", best),
    ]
    for name, value in reversed(steps):
        found = let(value, name, found)
    return paragraphs(docs).select("doc_id", "line", "last_line", F.explode(F.expr(found)).alias("o")).select("doc_id", "line", "last_line", "o.*")
