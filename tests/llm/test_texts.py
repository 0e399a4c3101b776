"""Operators over documents: brute force on small tables, and defined results for odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditspark.llm import decontaminate, language, licenses, mixing, quality, queries, simhash, tokens, toxicity
from auditspark.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    import xxhash
    words = WORD.findall(small(text))
    shingles = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, budget=4):
    group = list(range(len(prints)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(prints))]


def plain_components(ids, prints):
    groups = plain_groups(prints)
    least = {}
    for g, i in zip(groups, ids):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in groups]


def test_simhash_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = {i: (f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_components([i for i, _ in rows], prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == want


def test_simhash_odd_rows(odd_rows, odd_docs, no_docs):
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    want = Counter((r[0], p, c) for r, p, c in zip(odd_rows, prints, plain_components([r[0] for r in odd_rows], prints)))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == want
    kept = simhash.keep_one(odd_docs).collect()
    assert sorted(Counter((plain_fingerprint(r.text)) for r in kept).values()) == [1] * len(kept)
    assert len(kept) == len(set(plain_groups(prints)))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_tries_keep_dense_groups_whole(spark, blocks):
    """A large group of near fingerprints, a chain at the budget, and far ones; large tries are cut in parts."""
    import random
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(300)}
    step = rng.getrandbits(64)
    for k in range(12):
        prints.add(step)
        for b in range(4):
            step ^= 1 << (4 * k + b)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    linked = simhash.components(simhash.links(spark.createDataFrame(signed, "fp bigint"), 4, blocks)).collect()
    got = {r.node % (1 << 64): r.root for r in linked}
    want = plain_groups(prints)
    size = Counter(want)
    pairs = {(want[k], got.get(p)) for k, p in enumerate(prints) if size[want[k]] > 1}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and None not in {b for _, b in pairs}
    assert all(p not in got for k, p in enumerate(prints) if size[want[k]] == 1)


@pytest.mark.parametrize("name, column, threshold", [("op2_quality", "quality", 0.3), ("op3_toxicity", "toxic", 0.5)])
def test_classifiers_on_held_out_rows(spark, name, column, threshold):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= threshold) for r in got)
    assert sum(r.predicted == r[column] for r in held) / len(held) > 0.95


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_odd_rows(spark, odd_docs, no_docs, labels, module, column):
    for docs, marks in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        model = module.train(docs, marks, column)
        got = docs.select("doc_id", "text", module.score(model, F.col("text"), spark).alias("s")).collect()
        assert all(0 <= r.s <= 1 for r in got) and len({r.s for r in got if not (r.text or "").strip() and not r.text}) <= 1
        if marks.isEmpty() or not got:
            assert all(r.s == 0.5 for r in got)


def test_licences_match_plain_python(odd_docs, no_docs, spark):
    families, weights, bias, least = licenses.train()

    def plain(text):
        out, unknown = set(), 0
        for line in (text or "").lower().split("\n"):
            if not any(a in line for a in licenses.ANCHORS):
                continue
            words = licenses.words_of(line)
            p = licenses.probabilities(licenses._logits(weights, bias, sorted(set(licenses.grams_of(words)))))
            grams = set(licenses.grams_of(words))
            likely = [f for q, f in sorted(zip(p, families), reverse=True) if q > p[-1]][: licenses.CANDIDATES]
            sure = {f for f in likely for t in licenses.TEMPLATES[f] if set(licenses.needed(t)) <= grams
                    and len(set(licenses.words_of(t)) & set(words)) / len(set(licenses.words_of(t))) >= licenses.CONFIRM}
            if sure and 1 - p[-1] >= least and not grams & set(licenses.DENIED):
                out |= sure
            else:
                unknown += 1
        return sorted(out), unknown

    docs = table(spark, SF, "documents").select("doc_id", "text").unionAll(odd_docs.select("doc_id", "text"))
    extra = [(1000, line) for lines in licenses.TEMPLATES.values() for line in lines] + [(1001, line) for line in licenses.OTHERS]
    docs = docs.unionAll(spark.createDataFrame(extra, "doc_id bigint, text string"))
    for row in licenses.scan(docs).collect():
        assert (row.licences, row.unknown_paragraphs) == plain(row.text), row.text[:200]
    for family, lines in licenses.TEMPLATES.items():
        assert all(plain(line)[0] == [family] for line in lines), family
    assert all(plain(line)[0] == [] for line in licenses.OTHERS)
    assert licenses.scan(no_docs).count() == 0
    plan = queries.op4_licenses(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_licences_of_versions_choices_and_denials(spark):
    probes = {
        "SPDX-License-Identifier: GPL-2.0-or-later": ["gpl-2.0"], "SPDX-License-Identifier: LGPL-2.1-or-later": ["lgpl-2.1"], "Released under the Apache License, version 1.1": [],
        "Dual licensed under the MIT license or the Apache License, Version 2.0.": ["apache-2.0", "mit"], "SPDX-License-Identifier: MIT OR Apache-2.0": ["apache-2.0", "mit"],
        "This file is not licensed under the MIT license": [], "This program was never released under the GPL v2 license": [], "the authors hold all rights reserved for the table": [],
        "Licensed under the New BSD License": ["bsd-3-clause"], "Licensed under the Simplified BSD License": ["bsd-2-clause"]}
    got = {r.text: r.licences for r in licenses.scan(spark.createDataFrame([(t,) for t in probes], "text string")).collect()}
    assert got == probes
    families, weights, bias, least = licenses.train()
    assert 0.5 <= least < 1
    for line in [*licenses.UNSEEN, *licenses.OTHERS]:
        p = licenses.probabilities(licenses._logits(weights, bias, sorted(set(licenses.grams_of(licenses.words_of(line))))))
        assert 1 - p[-1] < least, line


def test_licences_of_many_anchored_lines(spark):
    texts = ["\n".join(["the license"] * 4000), "\n".join(['"license": "MIT",'] * 4000), "\n".join(["Licensed under the MIT license"] * 4000)]
    start = time.time()
    got = {r.text: (r.licences, r.unknown_paragraphs) for r in licenses.scan(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()}
    assert got[texts[0]] == ([], 4000) and got[texts[2]] == (["mit"], 0) and time.time() - start < 120


GNU_HEADER = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} License as published by the
Free Software Foundation, either version {2} of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} License for more details."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
THIRD_CLAUSE = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
HEADERS = {
    "gpl-2.0": GNU_HEADER.format("program", "General Public", "2"), "gpl-3.0": GNU_HEADER.format("program", "General Public", "3"),
    "agpl-3.0": GNU_HEADER.format("program", "Affero General Public", "3"), "lgpl-2.1": GNU_HEADER.format("library", "Lesser General Public", "2.1"),
    "lgpl-3.0": GNU_HEADER.format("library", "Lesser General Public", "3"), "bsd-2-clause": BSD_TEXT, "bsd-3-clause": BSD_TEXT + THIRD_CLAUSE,
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
}


def test_licences_of_wrapped_headers(spark):
    """The standard headers, wrapped, as comments, and between lines of prose without a blank line."""
    import textwrap
    rows = []
    for family, header in HEADERS.items():
        for width in (30, 50, 70, 72, 78, 100):
            for mark, before, after in (("", "", ""), ("# ", "", ""), (" * ", "A tool of two parts.\nIt reads and writes.\n", "\nimport os\nThe rest is code.")):
                lines = "\n\n".join("\n".join(textwrap.wrap(part, width)) for part in header.split("\n\n"))
                rows.append((family, before + "\n".join(mark + line for line in lines.split("\n")) + after))
    got = licenses.scan(spark.createDataFrame(rows, "family string, text string").repartition(8)).collect()
    assert [(r.family, r.text, r.licences) for r in got if r.licences != [r.family]] == []
    both = "\n".join(textwrap.wrap(HEADERS["mpl-2.0"], 70) + textwrap.wrap(GNU_HEADER.format("program", "General Public", "2").split("\n\n")[0], 70))
    prose = "\n".join(textwrap.wrap(" ".join(licenses.OTHERS), 40))
    got = licenses.scan(spark.createDataFrame([(both,), (prose,)], "text string")).collect()
    assert {r.text: r.licences for r in got} == {both: ["gpl-2.0", "mpl-2.0"], prose: []}


def test_token_counts_match_the_library(spark, odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    extra = ["don't STOP<|endoftext|>now <|startoftext|>", "a\x1cb\x85c d\x0be", "é ́x ﬁ İ Σας", "x" * 5000, "<|endoftext|> <|endoftext |>"]
    docs = odd_docs.select("doc_id", "text").unionAll(spark.createDataFrame([(k, t) for k, t in enumerate(extra)], "doc_id bigint, text string"))
    docs = docs.unionAll(table(spark, SF, "documents").select("doc_id", "text"))
    got = docs.select("text", tokens.token_counts(docs, path, cache=50).alias("n")).collect()
    assert len(got) == docs.count()
    assert all(r.n == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in got)
    assert all(r.n == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.select("text", tokens.token_counts(docs, path, frequent=3).alias("n")).collect())
    assert no_docs.select(tokens.token_counts(no_docs, path)).count() == 0


def test_token_lengths_of_cut_pre_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    rng, lengths = random.Random(6), tokens.Lengths(path, {}, 100)
    letters = ["a", "B", "the", "'s", "'S", "'re", "'ll", "'", "1", "23", ".", ",", "...", "-", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "é", "İ", "\x1c", "\x7f", "\x00", "_", "\u0301", "J\u030c"]
    for _ in range(60):
        texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(20)) for _ in range(10)]
        assert lengths.counts([t.encode() for t in texts]) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert lengths.special and tokens.Lengths(str(public_tokenizers.path("byte_bpe_50k.json")), {}, 1).special is None


def test_frequent_pre_tokens_are_counted_over_all_texts(spark, monkeypatch):
    import public_tokenizers
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(" ".join(["the"] * 50 + ["cat"] * 20 + [f"w{k}x{j}" for j in range(30)] + ["y" * 80] * 60),) for k in range(40)]
    docs = spark.createDataFrame(rows, "text string").repartition(4)
    monkeypatch.setattr(tokens, "SKETCH", 300)
    assert set(tokens.frequent_lengths(docs, path, frequent=2)) == {b"the", b"cat"}
    assert set(tokens.frequent_lengths(docs.limit(0), path)) == set()


def test_language_held_out(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    model = language.train(odd_docs)
    rows = language.with_language(odd_docs, model).collect()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in rows)
    assert all(r.lang_pred == "und" for r in language.with_language(odd_docs, language.train(no_docs)).collect())
    assert language.with_language(no_docs, model).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def check_mix(rows, got):
    sizes = Counter()
    for r in rows:
        sizes[r[1]] += len(WORD.findall(r[2] or ""))
    want, taken = plain_targets(sizes), Counter()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[2] or ""))) for r in rows)
    for r in got:
        source = None if r.key == "t" else r.key[1:]
        assert r.source_size == sizes[source] and math.isclose(r.target, want[source], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mixing(spark, odd_rows, odd_docs, no_docs):
    docs = table(spark, SF, "documents").select("doc_id", "source", "text")
    got = mixing.mix(docs).collect()
    check_mix(docs.collect(), got)
    assert Counter(got) == Counter(mixing.mix(docs.repartition(5)).collect())
    check_mix([(r[0], r[3], r[1]) for r in odd_rows], mixing.mix(odd_docs).collect())
    assert mixing.mix(no_docs).count() == 0
    rows = mixing.repeated(docs).collect()
    sums = Counter()
    for r in rows:
        sums[r.doc_id] += r.words_taken
        assert len(WORD.findall(r.text)) == r.words_taken
    assert sums == {r.doc_id: r.taken for r in got if r.taken}
    assert mixing.repeated(odd_docs).columns == [*odd_docs.columns, "repetition", "words_taken"]


def test_pipeline_mixes_whole_texts(spark):
    rows = [(k, f"Line {k}\n" + "one  two\tthree\n" * (k % 7 + 3), "en", f"s{k % 3}", 0) for k in range(60)]
    rows += [(1000, "", "en", "s0", 0), (1001, None, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    texts, taken = {r[0]: r[1] for r in rows}, Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        assert r.text == texts[r.doc_id] and r.words_taken == len(WORD.findall(r.text))
        taken[r.source] += r.words_taken
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert all(abs(taken[s] - want) <= (2 + 3 * 9) / 2 + 1 for s, want in plain_targets(sizes).items())


def plain_contamination(rows, items, length=13):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    seen = {}
    for name, text in items:
        own = word.findall(small(text))
        size = min(length, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            seen.setdefault(tuple(own[k:k + size]), set()).add(str(name))
    sizes = {len(w) for w in seen}
    out = []
    for doc_id, text in rows:
        own, hit, found = word.findall(small(text)), set(), set()
        for size in sizes:
            for k in range(len(own) - size + 1):
                if names := seen.get(tuple(own[k:k + size])):
                    found |= names
                    hit |= set(range(k, k + size))
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return out


def test_decontamination(spark, odd_rows, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(map(tuple, queries.op9_decontamination(spark, SF).collect())) == sorted(plain_contamination(rows, items))
    odd_items = [(1, odd_rows[0][1]), (1, odd_rows[0][1]), (2, "one TWO three"), (3, None), (4, ""), (None, "one"), (10, odd_rows[7][1][-900:]), (5, "Ünïcödé!文字")]
    benchmark = spark.createDataFrame(odd_items, "item_id bigint, text string")
    got = decontaminate.contamination(odd_docs, benchmark, block=7).collect()
    want = plain_contamination([(r[0], r[1]) for r in odd_rows], [x for x in odd_items if x[0] is not None])
    assert Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), r.contaminated) for r in got) == Counter((*w[:4], w[5]) for w in want)
    bad = Counter((r[0], r[1]) for r, w in zip(odd_rows, want) if not w[5])
    assert Counter((r.doc_id, r.text) for r in decontaminate.clean(odd_docs, benchmark).collect()) == bad
    assert decontaminate.contamination(no_docs, benchmark).count() == 0
    assert decontaminate.contamination(odd_docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, "a b c x y z d")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "A b, c d")], "item_id bigint, text string")
    index = decontaminate.build_index(docs)
    assert [(r.doc_id, r.item_id, r.start) for r in decontaminate.occurrences(index, items).collect()] == [(1, "7", 0)]
    assert {r.doc_id for r in decontaminate.occurrences(index, items, slop=1).collect()} == {1, 2}


def test_proximity_of_displaced_words(spark):
    """Any word may be displaced, the rarest too, and none is taken from a neighbouring document."""
    import random
    rng = random.Random(4)
    texts = ["b a c d", "a b c d", "a b", "c d", "d c b a"] + [" ".join(rng.choice("aabbcdx") for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    item = "a b c d".split()
    index = decontaminate.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1))
    items = spark.createDataFrame([(7, "a b c d")], "item_id bigint, text string")
    for slop in (0, 1, 2):
        want = set()
        for k, own in enumerate(t.split() for t in texts):
            for start in range(-slop, len(own) + slop if len(own) >= 4 else -slop):
                if all(any(0 <= p < len(own) and own[p] == w for p in range(start + j - slop, start + j + slop + 1)) for j, w in enumerate(item)):
                    want.add((k, min(max(start, 0), len(own) - 4)))
        got = [(r.doc_id, r.start) for r in decontaminate.occurrences(index, items, slop=slop).collect()]
        assert sorted(got) == sorted(want) and (slop == 0 or 0 in {k for k, _ in got})


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if number < 4:
            assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0 < len(rows)
        if name == "near_copies":
            groups = plain_groups([plain_fingerprint(r.text) for r in docs.collect()])
            assert len(rows) == len(set(groups))
        if name == "decontamination":
            bad = {w[0] for w in plain_contamination([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in table(spark, SF, "benchmark").collect()]) if w[5]}
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - bad
        if number < 4:
            docs = spark.createDataFrame(rows, docs.schema)


def test_pipeline_odd_rows(spark, odd_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert set(odd_docs.columns) <= set(stage(spark, odd_docs, SF).columns)
        stage(spark, odd_docs, SF).count()
