"""License scans: a trained paragraph classifier, confirmed by templates. DataFrame functions only.

The classifier is trained on the driver from the templates and counter-examples below, a fixed
amount of text. Documents are read, cut, scored and confirmed by DataFrame functions alone.
"""

from __future__ import annotations

import json
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GNU GPL version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", "Licensed under the ISC License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "public-domain": ["This work has been dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Released under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "eupl": ["Licensed under the EUPL, Version 1.2 or later.", "Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright by the author, all rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
#: Paragraphs with license words that grant nothing.
UNKNOWN = [
    "A driver must carry a license at all times.", "The city council renewed the license of the restaurant.", "Human rights are universal and must be protected by law.",
    "She asked for permission to leave the room.", "The warranty of the machine ended last year.", "Copyright law differs between countries.",
    "The software was used to compute the results.", "The public domain is a topic of legal debate.", "All rights and duties of members are listed below.",
    "Their fishing license was not under review.", "He was licensed to practise medicine in version two of the rules.", "The apache helicopter landed under cover of night.",
    "Creative commons rooms were opened for students.", "General public transport is free on Sundays.", "The source and binary stars were observed with the telescope.",
    "Permission slips are due on Friday.", "The license plate was reported stolen.", "They redistribute food to people in need.",
    "The rights of the defendant were read aloud.", "A new version of the license agreement is being discussed by the parties.", "The gnu is a large antelope of the plains.",
    "Conditions of use are described in the manual.", "Free of charge parking is available.", "Reserved seats are marked in red.",
    "This license expires at the end of the month.", "Which license should we choose for this work?", "The author reserved a table under a false name.",
]
UNKNOWN_CLASS = "unknown"
#: Least probability of a family, and least share of a template's word pairs that the paragraph has.
LEAST_PROBABILITY, LEAST_TEMPLATE = 0.5, 0.7
#: Most words of a paragraph of several pieces: twice those of the longest template.
MOST_WORDS = 2 * max(len(re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", t)) for ts in TEMPLATES.values() for t in ts)
#: Made-up variants per example, training steps, step size, ridge, seed.
VARIANTS, STEPS, RATE, RIDGE, SEED = 12, 400, 4.0, 1e-4, 11
_SENTENCE = r"(?<=[.!?])\x20+"
_TOKEN = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


def _grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def _examples() -> tuple[list[set[str]], list[int], list[str]]:
    """Variants of templates and counter-examples: words dropped, strange words before and behind."""
    rng = random.Random(SEED)
    families = [*sorted(TEMPLATES), UNKNOWN_CLASS]
    rows, classes = [], []

    def strange() -> str:
        return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5)))

    for number, family in enumerate(families):
        for text in TEMPLATES.get(family, UNKNOWN):
            words = _tokens(text)
            for v in range(VARIANTS):
                kept = [w for w in words if v == 0 or rng.random() > 0.08] or words
                more = [strange() for _ in range(rng.randrange(0, 6) if v else 0)]
                rows.append(_grams(kept + more if v % 2 else more + kept))
                classes.append(number)
    every = [w for texts in (*TEMPLATES.values(), UNKNOWN) for t in texts for w in _tokens(t)]
    for _ in range(20 * VARIANTS):  # license words in no order
        rows.append(_grams([rng.choice(every) for _ in range(rng.randrange(3, 15))]))
        classes.append(len(families) - 1)
    return rows, classes, families


@cache
def train() -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(families, grams, weights, biases) of the calibrated softmax regression.

    Every fourth row is kept back to fit the temperature that the logits are divided by.
    """
    rows, classes, families = _examples()
    back = np.arange(len(rows)) % 4 == 3
    grams = sorted(set().union(*(r for r, b in zip(rows, back, strict=True) if not b)))
    number = {g: i for i, g in enumerate(grams)}
    y = np.eye(len(families))[classes]
    w, b = np.zeros((len(grams), len(families))), np.zeros(len(families))

    def sparse(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, gram) of the ones of the rows' matrix."""
        pairs = [(n, number[g]) for n, i in enumerate(which) for g in sorted(rows[i]) if g in number]
        return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def summed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Rows of values added up by their places; places ascend."""
        out = np.zeros((n, values.shape[1]))
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[begin]] = np.add.reduceat(values, begin, axis=0)
        return out

    def probabilities(logits):
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    fit, held = np.flatnonzero(~back), np.flatnonzero(back)
    row, gram = sparse(fit)
    by_gram = np.argsort(gram, kind="stable")
    scale = RATE / (len(row) / len(fit) + 1)
    for _ in range(STEPS):
        error = (probabilities(summed(w[gram], row, len(fit)) + b) - y[fit]) / len(fit)
        w -= scale * (summed(error[row[by_gram]], gram[by_gram], len(grams)) * 10 + RIDGE * w)
        b -= scale * error.sum(axis=0)
    row, gram = sparse(held)
    logits = summed(w[gram], row, len(held)) + b
    heat = min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(probabilities(logits / t)[y[held] > 0] + 1e-12).mean())
    return families, grams, w / heat, b / heat


def _small_table(spark, rows: list, schema: str) -> DataFrame:
    """A bounded table made in the JVM from a literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _pairs_of(text: str) -> list[str]:
    words = _tokens(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


@cache
def _telling_words() -> list[str]:
    """Words of which every text has one that holds LEAST_TEMPLATE of the word pairs of any template.

    Of each template so many words are taken that their pairs are more than a text may lack: words
    taken before first, then the longest, which ordinary text has least.
    """
    taken: set[str] = set()
    for text in sorted((t for ts in TEMPLATES.values() for t in ts), key=lambda t: (len(_pairs_of(t)), t)):
        pairs, own = [p.split(" ") for p in _pairs_of(text)], set()
        while sum(1 for p in pairs if own & set(p)) <= (1 - LEAST_TEMPLATE) * len(pairs):
            rest = sorted({w for p in pairs if not own & set(p) for w in p}, key=lambda w: (w not in taken, -len(w), w))
            own.add(rest[0])
        taken |= own
    return sorted(taken)


def _may_have_template(low: Column) -> Column:
    """Whether a lower-case text has a telling word, be it in another; true wherever a template can be."""
    found = F.lit(False)
    for word in _telling_words():
        if not any(other != word and other in word for other in _telling_words()):
            found = found | low.contains(word)
    return found


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _word_pairs(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))


def _runs(rows: DataFrame, templates: list[tuple[str, list[str]]]) -> DataFrame:
    """(rid, bid, family, share, at, n, start, w): runs of pieces, as words w, that have LEAST_TEMPLATE of a template's word pairs.

    A block of text lies between blank lines, its pieces between line ends and sentence ends. The word
    pairs of a block that any template has are kept with the pieces they are in; what is looked at
    further is what has enough pairs of one template. Runs begin and end with such a pair: a longer
    run has no greater share. All of it is within the row of a block; no text is sent.
    """
    blocks = rows.filter(F.col("text").isNotNull()).select("rid", F.explode(F.split("text", r"\n\s*\n")).alias("block"))
    blocks = blocks.select("rid", "block", F.lower("block").alias("low"))
    pieces = F.filter(F.transform(F.split("block", r"\n|" + _SENTENCE), _words), lambda w: F.size(w) > 0)
    told = blocks.select("rid", F.when(_may_have_template(F.col("low")), pieces).alias("pieces")).filter("size(pieces) > 0")
    placed = F.flatten(F.transform("pieces", lambda w, p: F.transform(w, lambda x, i: F.struct(x.alias("word"), p.alias("piece"), i.alias("i"), F.size(w).alias("n")))))
    # start and end are the places in the block at which a word's piece begins and ends
    placed = F.transform(placed, lambda x, g: F.struct(x["word"].alias("word"), x["piece"].alias("piece"), (g - x["i"]).alias("start"), (g - x["i"] + x["n"]).alias("end")))
    two = F.zip_with(
        F.slice("placed", 1, F.greatest(F.size("placed") - 1, F.lit(0))), F.slice("placed", 2, F.size("placed")),
        lambda a, b: F.struct(F.concat(a["word"], F.lit(" "), b["word"]).alias("pair"), a["piece"].alias("at"), a["start"].alias("start"), b["piece"].alias("last"), b["end"].alias("end")),
    )
    every = sorted({p for _, pairs in templates for p in pairs})
    met = told.withColumn("placed", placed).select("rid", F.col("placed.word").alias("words"), F.filter(two, lambda x: x["pair"].isin(*every)).alias("met")).filter("size(met) > 0")
    rules = F.from_json(F.lit(json.dumps([{"family": f, "pairs": p} for f, p in templates])), "array<struct<family:string,pairs:array<string>>>")
    met = met.withColumn("bid", F.monotonically_increasing_id()).withColumn("t", F.explode(rules))
    met = met.withColumn("m", F.filter("met", lambda x: F.array_contains(F.col("t.pairs"), x["pair"]))).withColumn("of", F.size("t.pairs"))
    met = met.filter(F.size(F.array_distinct("m.pair")) >= F.col("of") * LEAST_TEMPLATE)
    starts = met.withColumn("s", F.explode(F.array_distinct(F.transform("m", lambda x: F.struct(x["at"].alias("at"), x["start"].alias("start"))))))
    ends = F.array_distinct(F.transform("m", lambda x: F.struct(x["last"].alias("last"), x["end"].alias("end"))))
    near = F.filter(ends, lambda x: (x["last"] == F.col("s.at")) | ((x["last"] > F.col("s.at")) & (x["end"] - F.col("s.start") <= MOST_WORDS)))
    both = starts.withColumn("e", F.explode(near))
    inside = F.filter("m", lambda x: (x["at"] >= F.col("s.at")) & (x["last"] <= F.col("e.last")))
    both = both.withColumn("share", F.size(F.array_distinct(F.transform(inside, lambda x: x["pair"]))) / F.col("of")).filter(F.col("share") >= LEAST_TEMPLATE)
    run = F.slice("words", F.col("s.start") + 1, F.col("e.end") - F.col("s.start"))
    found = both.select("rid", "bid", F.col("t.family").alias("family"), "share", F.col("s.at").alias("at"), (F.col("e.last") - F.col("s.at") + 1).alias("n"), F.col("s.start").alias("start"), run.alias("w"))
    return common.stash(found, "license-runs")


def _apart(found: Column) -> Column:
    """The best of found, and every next best that overlaps none taken before."""
    def overlap(a, b):
        return (a["at"] < b["at"] + b["n"]) & (b["at"] < a["at"] + a["n"])

    none = F.filter(found, lambda x: F.lit(False))
    return F.aggregate(F.array_sort(found), none, lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def notices(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id) of all rows, and (rid, family, probability) of each confirmed paragraph."""
    spark = docs.sparkSession
    families, grams, weights, biases = train()
    low = docs.select("doc_id", "text", F.lower("text").alias("low"))
    rows = low.select("doc_id", F.when(_may_have_template(F.col("low")), F.col("text")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    rows = common.stash(rows, "license-texts")
    runs = _runs(rows, [(f, _pairs_of(t)) for f, ts in TEMPLATES.items() for t in ts if _pairs_of(t)])
    spots = ["bid", "start", "n"]
    paragraphs = runs.groupBy(*spots).agg(F.first("w").alias("w"))
    # The model has one row per n-gram of the templates and counter-examples, a fixed number.
    model = _small_table(spark, [{"gram": g, "v": [round(float(v), 6) for v in weights[i]]} for i, g in enumerate(grams)], "gram string, v array<double>")
    found = paragraphs.select(*spots, F.explode(F.array_distinct(F.concat("w", _word_pairs(F.col("w"))))).alias("gram")).join(F.broadcast(model), "gram")
    n = len(families)
    logits = found.groupBy(*spots).agg(*[F.sum(F.col("v")[i]).alias(f"l{i}") for i in range(n)])
    total = F.array(*[F.col(f"l{i}") + float(biases[i]) for i in range(n)])
    best = F.array_max("logits")
    softmax = 1 / F.aggregate("logits", F.lit(0.0), lambda acc, v: acc + F.exp(v - best))
    scored = logits.select(*spots, total.alias("logits")).select(
        *spots, F.element_at(F.array(*map(F.lit, families)), F.array_position("logits", best).cast("int")).alias("family"), softmax.alias("probability")
    ).filter((F.col("family") != UNKNOWN_CLASS) & (F.col("probability") >= LEAST_PROBABILITY))
    confirmed = runs.join(scored, [*spots, "family"])
    order = F.struct((-F.col("share")).alias("lacks"), "n", (-F.round("probability", 6)).alias("doubt"), "at", "family", "probability")
    taken = confirmed.groupBy("rid", "bid").agg(F.collect_set(order).alias("found")).select("rid", F.explode(_apart(F.col("found"))).alias("x"))
    return rows.select("rid", "doc_id"), taken.select("rid", "x.family", "x.probability")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_notices, families, best_probability of every row of docs.

    A paragraph is a run of neighbouring lines and sentences between blank lines, so that wrapped
    notices are whole: of any length if one piece, else of MOST_WORDS at most. All that can hold
    LEAST_TEMPLATE of the word pairs of a template are scored by the classifier; a family counts
    where it is likelier than LEAST_PROBABILITY, is not the unknown class, and one of its own
    templates has that share in the paragraph. Of paragraphs that overlap the one with most of its
    template counts, then the shortest, then the likeliest. families are sorted and
    joined by commas. Null and empty texts have no notices. Null and repeated doc_ids are rows of
    their own. Only doc_id and text are read. An empty table gives an empty result.
    """
    rows, found = notices(docs.select("doc_id", "text"))
    by_row = found.groupBy("rid").agg(
        F.count(F.lit(1)).alias("n_notices"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("best")
    )
    return rows.join(by_row, "rid", "left").select(
        "doc_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"),
        F.round(F.coalesce("best", F.lit(0.0)), 4).alias("best_probability"),
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
