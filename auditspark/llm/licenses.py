"""Licence scan: a trained paragraph classifier in DataFrame functions only.

A paragraph is a run of lines with words; lines without any end it.  Its anchored lines, and its windows of neighbouring
lines with an anchor in them, are classified by a softmax regression over their words and word pairs into licence families
and ``unknown``.  The probability of any family must reach the calibrated least; then the families likelier than
``unknown``, CANDIDATES at most, are the prediction, and each is confirmed only if one of its templates is contained:
CONFIRM of its words, and all of what names it, that is its versions with the word before them and the names below, which
are word pairs where the order matters; beside a denial nothing is.  So one line can grant several licences.  A notice is found however it is
wrapped: a window starts at any line and ends with the first that reaches one of the LENGTHS in words.  Where confirmed
windows overlap, the first one with the greatest share stays; a line that holds a whole template is not looked at further.  An
anchored line in no confirmed window counts as unknown.  Per row work stays in array functions, so texts are read once
and nothing is exchanged.

The BSD redistribution sentence is the same with two and three clauses: it names two, unless the text also has the third.

Training rows are the templates below with words left out, and sentences about licences that grant none: a fixed, small
set, fitted on the driver; negated notices count as sentences that grant none.  The probability threshold is calibrated
on rows that the fit did not see, other sentences among them: the least value at which none of the ``unknown`` ones passes.

Rows: NULL, empty and anchorless texts get no licence; very long texts are split like others; ties go to the first
family in order; repeated rows are answered each; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib

from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "unknown"
CONFIRM = 0.7
CANDIDATES = 3
ROUNDS = 30
RATE, L2 = 0.4, 1e-4
SEED = 11
LOTS = 1024

#: Common notice lines of public licences.
REDISTRIBUTION = ("Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met")
_GNU = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} License "
_LATER = _GNU + "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_ONLY = _GNU + "version {} as published by the Free Software Foundation."
TEMPLATES = {
    "agpl-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.",
                 "You can redistribute it under the terms of the GNU Affero General Public License",
                 _LATER.format("program", "Affero General Public", "3"), _ONLY.format("program", "Affero General Public", "3")],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0"],
    "bsd-2-clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the Simplified BSD License",
                     REDISTRIBUTION],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the New BSD License",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse products"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "cc0-1.0": ["Released into the public domain under CC0 1.0.", "CC0 1.0 Universal public domain dedication"],
    "gpl-2.0": ["This program is licensed under the GNU General Public License, version 2.", "Released under the GPL v2 license",
                "SPDX-License-Identifier: GPL-2.0-only", _LATER.format("program", "General Public", "2"), _ONLY.format("program", "General Public", "2")],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GPL v3 license",
                "SPDX-License-Identifier: GPL-3.0-or-later", _LATER.format("program", "General Public", "3"), _ONLY.format("program", "General Public", "3")],
    "isc": ["Released under the ISC License.", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
                 _LATER.format("library", "Lesser General Public", "2.1"), _ONLY.format("library", "Lesser General Public", "2.1")],
    "lgpl-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only",
                 _LATER.format("library", "Lesser General Public", "3"), _ONLY.format("library", "Lesser General Public", "3")],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
                "If a copy of the MPL was not distributed with this file, You can obtain one at https mozilla.org MPL 2.0"],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part may be reproduced without permission."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
#: Sentences with words of licensing that name no family.
OTHERS = [
    "He lost his driving licence in March and had to take the bus.", "The shop has a license to sell alcohol until midnight.",
    "A fishing license costs ten dollars for a whole season.", "Please read the license before you install the software.",
    "The license fee is due at the end of the month.", "Copyright law differs from one country to another.",
    "The museum is open to the public and free of charge.", "Ask for permission before you enter the library.",
    "The university grants every student a software licence.", "The warranty covers parts and labour for two years.",
    "The committee reserved a table for seven.", "Which license should I choose for my project?",
    "The version 2.0 release fixes two bugs in the library.", "The source code form was sent to the public office.",
    "Creative people are rarely common in such an office.", "The license plate was hidden under mud.",
    "The authors hold all rights reserved for the table.", "The poet license number 3 is a work of general interest.", "Licensed engineers work under the supervision of the state.",
    "The film was released under another title.", "The apache helicopter crew kept its general warranty license.",
]
#: Sentences that the fit does not see; the threshold is calibrated on them.
UNSEEN = [
    "The driver showed an expired licence to the officer.", "A license for the song was never asked for.", "Public domain is a term that few people use.",
    "This chapter explains how a license differs from a contract.", "All seats are reserved for members of the club.",
    "The archive gave permission to copy two letters.", "Copyright was the subject of the second lecture.", "The redistribution of land took ten years.",
    "The code was never released under any license.", "It is not distributed under the terms of that license.", "Nothing here is licensed to anybody.",
    "Version 3 of the form asks for the license number.",
]
#: What is said about a notice to deny it.
DENIALS = ["this file is not {}", "the code is no longer {}", "it was never {}", "nothing in this folder is {}", "we are not sure that it is {}"]
#: Words and word pairs that name a licence; a template that holds one is confirmed only where it is found.
NAMES = ["affero general", "lesser general", "gnu general", "apache", "mit", "isc", "mozilla public", "simplified bsd", "new bsd", "bsd", "unlicense", "unencumbered software",
         "copyright", "rights reserved", "be reproduced", "and binary", "or promote", "to endorse", "of charge", "without fee", "cc0", "by nc", "by sa", "sharealike", "noncommercial"]
#: Word pairs that deny a notice; nothing is confirmed beside them.
DENIED = [f"{a} {b}" for a in ("not", "never", "longer") for b in ("licensed", "released")]
#: Anchors: every template holds one of them.
ANCHORS = ["licen", "copyright", "public domain", "cc0", "permission", "reserved", "redistribut"]
#: The anchors in text with line breaks: the words of one may stand on two lines.
_ANCHORED = "|".join(a.replace(" ", "[^a-z0-9]+") for a in ANCHORS)
_WORD = r"[a-z0-9][a-z0-9.]*[a-z0-9]|[a-z0-9]"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def grams_of(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def needed(template: str) -> list[str]:
    """What a text must hold for a template to be confirmed: names, and versions with the word before them."""
    words = words_of(template)
    versions = [f"{a} {b}" for a, b in zip(words, words[1:]) if any(c.isdigit() for c in b)]
    return sorted({g for g in grams_of(words) if g in NAMES} | set(versions))


#: Words at which a window ends.
LENGTHS = [10, 18, 28, max(len(words_of(t)) for own in TEMPLATES.values() for t in own)]


def _variants(rng: random.Random) -> list[tuple[list[str], str]]:
    """Template lines and other sentences, whole and with words left out or words around them."""
    rows = []
    around = [w for line in OTHERS for w in words_of(line) if not any(a in w for a in ANCHORS)]
    for family, lines in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]:
        for line in lines:
            words = words_of(line)
            for _ in range(12):
                kept = [w for w in words if rng.random() > 0.08] or words
                extra = [rng.choice(around) for _ in range(rng.randrange(4))]
                rows.append((kept + extra if rng.random() < 0.5 else extra + kept, family))
            rows.append((words, family))
    for family, lines in TEMPLATES.items():
        for line in lines:
            notice = line[0].lower() + line[1:]
            if notice.startswith(("licensed", "released")):
                rows += [(words_of(d.format(notice)), UNKNOWN) for d in DENIALS]
    for _ in range(200):
        rows.append(([rng.choice(around) for _ in range(rng.randrange(3, 15))] + [rng.choice(["license", "licensed", "copyright", "permission"])], UNKNOWN))
    rng.shuffle(rows)
    return rows


def _logits(weights: dict[str, list[float]], bias: list[float], grams: list[str]) -> list[float]:
    out = list(bias)
    for gram in grams:
        for k, w in enumerate(weights.get(gram, ())):
            out[k] += w
    return out


def probabilities(logits: list[float]) -> list[float]:
    top = max(logits)
    parts = [math.exp(x - top) for x in logits]
    return [p / sum(parts) for p in parts]


_fitted: list = []


def train() -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """(families with unknown last, weights by n-gram, bias, least probability of any family); the same each time."""
    if _fitted:
        return _fitted[0]
    rng = random.Random(SEED)
    rows = _variants(rng)
    families = [*sorted(TEMPLATES), UNKNOWN]
    cut = len(rows) * 4 // 5
    weights: dict[str, list[float]] = {}
    bias = [0.0] * len(families)
    for turn in range(ROUNDS):
        rate = RATE / (1 + turn / 5)
        for words, family in rows[:cut]:
            grams = sorted(set(grams_of(words)))
            p = probabilities(_logits(weights, bias, grams))
            p[families.index(family)] -= 1
            step = rate / math.sqrt(len(grams))
            for gram in grams:
                own = weights.setdefault(gram, [0.0] * len(families))
                for k, g in enumerate(p):
                    own[k] -= step * (g + L2 * own[k])
            bias = [b - 0.1 * rate * g for b, g in zip(bias, p)]
    kept = {g: [round(x, 4) for x in w] for g, w in weights.items() if max(map(abs, w)) > 0.02}
    bias, least = [round(b, 4) for b in bias], 0.5
    for words in [w for w, family in rows[cut:] if family == UNKNOWN] + [words_of(line) for line in UNSEEN]:
        p = probabilities(_logits(kept, bias, sorted(set(grams_of(words)))))
        least = max(least, 1 - p[-1] + 1e-6)
    _fitted.append((families, kept, bias, least))
    return _fitted[0]


def paragraphs_of(text: Column) -> Column:
    """The lines with words of an anchored text, lower-cased, with their number; an empty list for most texts."""
    low = F.lower(text)
    lines = F.transform(F.split(low, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"), F.regexp_count(x, F.lit(_WORD)).alias("n")))
    none = F.array().cast("array<struct<at:int,line:string,n:int>>")
    return F.coalesce(F.when(low.rlike(_ANCHORED), F.filter(lines, lambda x: x["n"] > 0)), none)


def anchored(line: Column) -> Column:
    found = line.contains(ANCHORS[0])
    for anchor in ANCHORS[1:]:
        found = found | line.contains(anchor)
    return found


def windows(lines: Column) -> Column:
    """(first, last, line) of the anchored windows of two and more neighbouring lines: those that start at one line end
    where one of the LENGTHS is reached, or the lines end."""
    longest = LENGTHS[-1]

    def grown(x: Column, i: Column) -> Column:
        near = F.slice(lines, i + 1, longest)
        size = F.size(F.filter(F.transform(near, lambda y, k: F.struct(y["at"].alias("at"), k.alias("k"))), lambda y: y["at"] == x["at"] + y["k"]))
        return F.struct(x["at"].alias("first"), F.slice(near, 1, size).alias("near"))

    def cut(start: Column) -> Column:
        near = start["near"]
        reached = F.aggregate(near, F.array().cast("array<int>"), lambda acc, y: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + y["n"])))
        before = lambda n: F.size(F.filter(reached, lambda r: r < n))
        ends = F.array_distinct(F.array(*[F.least(F.size(near), 1 + before(n)) for n in LENGTHS]))
        ends = F.filter(ends, lambda k: k > 1)
        return F.transform(ends, lambda k: F.struct(start["first"].alias("first"), (start["first"] + k - 1).alias("last"), F.array_join(
            F.transform(F.slice(near, 1, k), lambda y: y["line"]), " ").alias("line")))

    starts = F.filter(F.transform(lines, grown), lambda x: F.array_join(F.transform(x["near"], lambda y: y["line"]), " ").rlike(_ANCHORED))
    return F.filter(F.flatten(F.transform(starts, cut)), lambda x: x["line"].rlike(_ANCHORED))


def judged(line: Column) -> Column:
    """Struct (family, probability, likeness, confirmed, families) of one lower-cased line; the probability is that of any
    family, ``families`` are the confirmed ones, ``family`` is the first of them, or else the likeliest."""
    families, weights, bias, least = train()
    lots: list[dict] = [{} for _ in range(LOTS)]  # a map is read from its first key on, so each is kept short
    for gram, own in weights.items():
        lots[zlib.crc32(gram.encode()) % LOTS][gram] = own
    table = F.from_json(F.lit(json.dumps(lots)), "array<map<string, array<double>>>")
    start = F.array(*[F.lit(b) for b in bias])
    words = F.regexp_extract_all(line, F.lit(f"({_WORD})"), F.lit(1))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.array_distinct(F.concat(words, pairs))
    summed = lambda grams: F.aggregate(grams, start, lambda acc, g: F.coalesce(F.zip_with(
        acc, F.try_element_at(F.get(table, (F.crc32(g) % LOTS).cast("int")), g), lambda a, b: a + b), acc))
    names = F.array(*map(F.lit, families))
    templates = F.from_json(F.lit(json.dumps({f: [{"words": sorted(set(words_of(t))), "needed": needed(t)} for t in lines] for f, lines in TEMPLATES.items()})),
                            "map<string, array<struct<words:array<string>,needed:array<string>>>>")

    def weighed(grams: Column, logits: Column) -> Column:
        top = F.array_max(logits)
        none = F.element_at(logits, len(families))
        any_family = 1 - F.exp(none - top) / F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        ranked = F.reverse(F.array_sort(F.zip_with(logits, names, lambda x, f: F.struct(x.alias("logit"), f.alias("family")))))
        likely = F.slice(F.filter(ranked, lambda r: r["logit"] > none), 1, CANDIDATES)

        def alike(r: Column) -> Column:
            own = F.coalesce(F.try_element_at(templates, r["family"]), F.array().cast("array<struct<words:array<string>,needed:array<string>>>"))
            held = F.filter(own, lambda t: F.size(F.array_except(t["needed"], grams)) == 0)
            return F.struct(r["family"].alias("family"), F.coalesce(F.array_max(F.transform(held, lambda t: F.size(F.array_intersect(t["words"], grams)) / F.size(t["words"]))), F.lit(0.0)).alias("likeness"))

        return F.struct(any_family.alias("probability"), F.transform(likely, alike).alias("likely"), F.arrays_overlap(grams, F.array(*map(F.lit, DENIED))).alias("denied"), F.element_at(ranked, 1)["family"].alias("top"))

    # each step is evaluated once: its result is bound by a lambda
    found = F.get(F.transform(F.array(F.struct(grams.alias("grams"))), lambda x: weighed(x["grams"], summed(x["grams"]))), F.lit(0))

    def told(x: Column) -> Column:
        sure = F.when((x["probability"] >= least) & ~x["denied"], F.filter(x["likely"], lambda c: c["likeness"] >= CONFIRM)).otherwise(F.slice(x["likely"], 1, 0))
        first = F.try_element_at(sure, F.lit(1))
        return F.struct(F.coalesce(first["family"], x["top"]).alias("family"), x["probability"].alias("probability"),
                        F.coalesce(F.array_max(F.transform(F.when(F.size(sure) > 0, sure).otherwise(x["likely"]), lambda c: c["likeness"])), F.lit(0.0)).alias("likeness"),
                        (F.size(sure) > 0).alias("confirmed"), F.array_sort(F.transform(sure, lambda c: c["family"])).alias("families"))

    return F.get(F.transform(F.array(found), told), F.lit(0))


def _taken(found: Column) -> Column:
    """Confirmed windows that do not overlap: the first of the greatest likeness among those that do."""
    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return (F.when(last.isNull() | (x["first"] > last["last"]), F.concat(acc, F.array(x)))
                .when(x["found"]["likeness"] > last["found"]["likeness"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc))

    return F.aggregate(F.array_sort(F.filter(found, lambda x: x["found"]["confirmed"])), F.slice(found, 1, 0), step)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with paragraphs (line, family, families, probability, likeness, confirmed), licences (confirmed families in
    order) and unknown_paragraphs (anchored lines in no confirmed one); the line of a wrapped notice is its lines joined."""
    def judge(x: Column) -> Column:
        return F.struct(x["first"].alias("first"), x["last"].alias("last"), x["line"].alias("line"), judged(x["line"]).alias("found"))

    def whole(x: Column) -> Column:
        return x["found"]["confirmed"] & (x["found"]["likeness"] == 1)

    singles = F.transform(F.filter("_licence_lines", lambda x: anchored(x["line"])),
                          lambda x: F.struct(x["at"].alias("first"), x["at"].alias("last"), x["line"].alias("line")))
    found = docs.withColumn("_licence_lines", paragraphs_of(F.col(text))).withColumn("_licence_singles", F.transform(singles, judge))
    ended = F.transform(F.filter("_licence_singles", whole), lambda x: x["first"])
    found = found.withColumn("_licence_lines", F.filter("_licence_lines", lambda x: ~F.array_contains(ended, x["at"])))
    found = found.withColumn("_licence_windows", F.transform(windows(F.col("_licence_lines")), judge))
    found = found.withColumn("_licence_taken", _taken(F.concat("_licence_singles", "_licence_windows")))
    rest = F.filter("_licence_singles", lambda x: ~F.exists("_licence_taken", lambda y: (y["first"] <= x["first"]) & (x["first"] <= y["last"])))
    found = found.withColumn("_licence_taken", F.array_sort(F.concat("_licence_taken", rest)))
    third = F.exists("_licence_taken", lambda x: F.array_contains(x["found"]["families"], "bsd-3-clause"))
    shared = sorted(set(words_of(REDISTRIBUTION)))

    def named(x: Column) -> Column:
        both = F.size(F.array_intersect(F.lit(shared), F.regexp_extract_all(x["line"], F.lit(f"({_WORD})"), F.lit(1)))) >= CONFIRM * len(shared)
        three = lambda f: F.when((f == "bsd-2-clause") & third & both, "bsd-3-clause").otherwise(f)
        return F.struct(three(x["found"]["family"]).alias("family"), F.array_distinct(F.transform(x["found"]["families"], three)).alias("families"))

    found = found.withColumn("paragraphs", F.transform("_licence_taken", lambda x: F.struct(
        x["line"].alias("line"), named(x)["family"].alias("family"), named(x)["families"].alias("families"), x["found"]["probability"].alias("probability"),
        x["found"]["likeness"].alias("likeness"), x["found"]["confirmed"].alias("confirmed"))))
    found = found.drop("_licence_lines", "_licence_singles", "_licence_windows", "_licence_taken")
    sure = F.filter("paragraphs", lambda x: x["confirmed"])
    return (found.withColumn("licences", F.array_sort(F.array_distinct(F.flatten(F.transform(sure, lambda x: x["families"])))))
            .withColumn("unknown_paragraphs", F.size("paragraphs") - F.size(sure)))
