"""The trained operators against plain Python that follows their definitions feature by feature."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditspark.llm import language, quality, simhash, toxicity

MASK = (1 << 64) - 1
ODD, STEP = 0x9E3779B97F4A7C15, 0x9FB21C651E98DF25
BLANK = " \t\n\x0b\x0c\r"


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-60, min(60, x))))


def learnable(rows):
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text, label): two vocabularies, letters of several scripts, rare words, empty and repeated texts."""
    rng = random.Random(11)
    common = ["river", "Stone", "läuft", "мост", "日本語", "naïve", "x1", "Haus", "der", "🙂🙃", "end."]
    bad, good = ["ядовитый", "venom!", "毒毒毒毒", "Größe"], ["garden", "саженец", "花花花花", "Süden"]
    rows = []
    for k in range(120):
        label = k % 2
        own = bad if label else good
        words = [rng.choice(common + own) for _ in range(rng.randrange(12, 30))] + [rng.choice(own)]
        rng.shuffle(words)
        rows.append((k, rng.choice([" ", "  ", "\n"]).join(words), label))
    return rows + [(200, "", 1), (201, None, 0), (202, "venom! venom! venom!", 1), (203, "日", 0)]


def grams(text):
    """Features of op3: index of every character n-gram, from Python strings."""
    chars = [" " if c in BLANK else c for c in small(text)]
    found = set()
    for block, size in enumerate(toxicity.SIZES):
        for at in range(len(chars) - size + 1):
            code = 0
            for c in chars[at:at + size]:
                code = (code * STEP + int.from_bytes(c.encode(), "big")) & MASK
            code ^= code >> 23
            found.add((code * ODD & MASK) >> (64 - toxicity.BITS) | block << toxicity.BITS)
    return found


def plain_toxicity(rows):
    features = [(grams(text), label) for _, text, label in learnable(rows)]
    counts = [Counter(), Counter()]
    for found, label in features:
        counts[label].update(found)
    toxic, other = (sum(label == want for _, label in features) for want in (1, 0))
    ratios = {}
    for f in counts[0].keys() | counts[1].keys():
        t, o = counts[1][f] + 1, counts[0][f] + 1
        ratio = math.log(t / (toxic + 2)) - math.log(o / (other + 2))
        if abs(ratio) >= toxicity.SURE * math.sqrt(1 / t + 1 / o):
            ratios[f] = ratio
    used = [([f for f in found if f in ratios], label) for found, label in features]
    scale = math.sqrt(sum(ratios[f] ** 2 for found, _ in used for f in found) / len(used) + 1e-9)
    share = {1: 0.5 / toxic, 0: 0.5 / other}
    w, b = dict.fromkeys(ratios, 0.0), 0.0
    ahead, ahead_b = dict(w), b
    for step in range(1, toxicity.STEPS + 1):
        slope, slope_b = {f: toxicity.L2 * ahead[f] for f in w}, 0.0
        for found, label in used:
            off = (sigmoid(sum(ahead[f] * ratios[f] / scale for f in found) + ahead_b) - label) * share[label]
            slope_b += off
            for f in found:
                slope[f] += off * ratios[f] / scale
        new, new_b = {f: ahead[f] - toxicity.RATE * slope[f] for f in w}, ahead_b - toxicity.RATE * slope_b
        pace = (step - 1) / (step + 2)
        ahead, ahead_b = {f: new[f] + pace * (new[f] - w[f]) for f in w}, new_b + pace * (new_b - b)
        w, b = new, new_b
    return lambda text: sigmoid(sum(w[f] * ratios[f] / scale for f in grams(text) if f in w) + b), len(ratios)


def spark_scores(spark, module, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, mark int")
    model = module.train(docs, labels, "mark", shards=1)
    return {r.doc_id: r.s for r in docs.select("doc_id", module.score(model, F.col("text"), spark).alias("s")).collect()}


def test_toxicity_matches_plain_python(spark, texts):
    plain, used = plain_toxicity(texts)
    got = spark_scores(spark, toxicity, texts)
    assert used > 10
    assert {i: got[i] for i, _, _ in texts} == pytest.approx({i: plain(t) for i, t, _ in texts}, abs=1e-4)


def test_character_grams_of_every_script():
    """Each character counts as one, whatever its bytes; texts do not run into each other; broken bytes do no harm."""
    texts = ["abcd", "日本語文字列", "", "日本語", "ab\tCD é", "🙂🙃🙂🙃", "x" * 5000 + "я"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found = {k: set() for k in range(len(texts))}
    for k, part in toxicity.present(data, bounds, np.zeros(toxicity.DIMS, np.int32)):
        assert len(set(part.tolist())) == len(part)
        found[k] |= set(part.tolist())
    assert found == {k: grams(t) for k, t in enumerate(texts)}
    assert not found[3] and len(found[1]) == 4  # three of 4, one of 6
    broken = np.array([0x80, 0x80, 0xFF, 0xE3, 0x41, 0x42, 0x43, 0x80], np.uint8)
    assert len(dict(toxicity.present(broken, np.array([0, 4, 8]), np.zeros(toxicity.DIMS, np.int32)))) <= 2


def finalised(h):
    for _ in range(2):
        h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & MASK
    return h ^ (h >> 32)


def word_hash(word):
    inverse, total, power = pow(ODD, -1, 1 << 64), 0, 1
    for byte in word:
        total, power = (total + (byte + 1) * power) & MASK, power * inverse & MASK
    return finalised((total + len(word) * 0xA24BAED4963EE407) & MASK)


def shape(word):
    kinds = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else 120 if b > 127 else b for b in word)
    return bytes(b for k, b in enumerate(kinds) if k == 0 or b != kinds[k - 1])


def shares(text):
    """Features of op2: index to weight."""
    words = (text or "").encode().split()
    hashes = [0x5851F42D4C957F2D if k and w == words[k - 1] else word_hash(w) for k, w in enumerate(words)]
    shapes = [word_hash(shape(w)) for w in words]
    out = Counter()
    for salt, unit in enumerate((hashes, shapes)):
        blocks = [[u + 2 * salt + 1 for u in unit], [finalised((a * 31 + b) & MASK) + 2 * salt + 2 for a, b in zip(unit, unit[1:])]]
        for block in blocks:
            for code in block:
                out[finalised(code & MASK) >> (64 - quality.BITS)] += 4.0 / len(block)
    return out


def plain_quality(rows):
    own = learnable(rows)
    order = np.argsort(pd.util.hash_array(np.array([i for i, _, _ in own])), kind="stable")
    z, n = Counter(), Counter()

    def now(f):
        if abs(z[f]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[f]) - z[f]) / ((quality.BETA + math.sqrt(n[f])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for k in order:
            x, label = {**shares(own[k][1]), "bias": 1.0}, own[k][2]
            w = {f: now(f) for f in x}
            off = sigmoid(sum(w[f] * v for f, v in x.items())) - label
            for f, v in x.items():
                g = off * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / quality.ALPHA * w[f]
                n[f] += g * g
    return lambda text: sigmoid(sum(now(f) * v for f, v in {**shares(text), "bias": 1.0}.items()))


def test_quality_matches_plain_python(spark, texts):
    plain = plain_quality(texts)
    got = spark_scores(spark, quality, texts)
    assert {i: got[i] for i, _, _ in texts} == pytest.approx({i: plain(t) for i, t, _ in texts}, abs=1e-4)


def letter_grams(text):
    """Features of op6: index to count."""
    low = text.lower() if any(ord(c) > 127 for c in text) else small(text)
    plain = " ".join("".join(chr(b) if b > 127 or 97 <= b <= 122 else " " for b in low.encode()).split(" ")).encode("latin-1")
    plain = b" " + b" ".join(plain.split(b" ")) + b" "
    while b"  " in plain:
        plain = plain.replace(b"  ", b" ")
    out = Counter()
    for size in language.SIZES:
        for at in range(len(plain) - size + 1):
            code = size
            for b in plain[at:at + size]:
                code = (code << 8 | b) & MASK
            out[(code * ODD & MASK) >> (64 - language.BITS)] += 1
    return out


def test_language_matches_plain_python(spark):
    rng = random.Random(3)
    vocabulary = {"de": ["Haus", "läuft", "über", "der", "Straße"], "en": ["house", "runs", "over", "the", "street"], "ru": ["дом", "бежит", "через", "улица", "мост"]}
    rows = [(k, " ".join(rng.choice(vocabulary[lang] + ["ok", "12"]) for _ in range(rng.randrange(3, 25))), lang)
            for k, lang in enumerate(["de", "en", "ru"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, centroids=2)
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    seen = Counter(f for _, text, _ in known for f in letter_grams(text))
    idf = {f: math.log((1 + len(known)) / (1 + seen[f])) + 1 for f in range(language.DIMS)}
    assert model.idf.tolist() == pytest.approx([idf[f] for f in range(language.DIMS)], rel=1e-5)

    def vector(text):
        out = np.zeros(language.DIMS)
        for f, n in letter_grams(text).items():
            out[f] = math.log1p(n) * idf[f]
        return out / np.linalg.norm(out)

    centres = []
    for lang in ("de", "en", "ru"):
        own = [(t, i) for i, t, x in known if x == lang]
        at = pd.util.hash_array(np.array([t for t, _ in own], object))
        x = [vector(own[k][0]) for k in sorted(range(len(own)), key=lambda k: (at[k], own[k][1]))]
        far = min(range(len(x)), key=lambda k: x[k] @ x[0])
        pair = [x[0], x[far]]
        for _ in range(language.ROUNDS):
            near = [int(v @ pair[1] > v @ pair[0]) for v in x]
            sums = [sum(v for v, c in zip(x, near) if c == k) for k in (0, 1)]
            pair = [s / np.linalg.norm(s) for s in sums]
        centres += [(lang, c) for c in pair]
    assert sorted(model.languages) == sorted(lang for lang, _ in centres)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.with_language(docs, model).collect()}
    for i, text, _ in rows:
        cosine, lang = max((float(vector(text) @ c), lang) for lang, c in centres)
        assert got[i][0] == lang and got[i][1] == pytest.approx(cosine, abs=1e-4)


def test_groups_of_a_partition_are_streamed():
    """Whole groups come out once each, in pieces of about the asked size, however batches cut them."""
    import pyarrow as pa
    rng = random.Random(7)
    rows = sorted((rng.randrange(3), rng.randrange(20), 0, rng.randrange(2), rng.randrange(2), k) for k in range(3000)) + [(9, 9, 0, 0, 0, k) for k in range(700)]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows[k:k + 37])] or [], names=list("abcdef")) for k in range(0, len(rows), 37)]
    parts = list(simhash._groups(iter(batches), 200))
    assert [tuple(int(v) for v in row) for part in parts for row in zip(*part)] == rows
    keys = [{tuple(int(v) for v in row[:4]) for row in zip(*part)} for part in parts]
    assert sum(len(k) for k in keys) == len(set().union(*keys)) and len(parts) > 8
    assert list(simhash._groups(iter([]), 200)) == []
