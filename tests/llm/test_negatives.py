"""Hard negatives against a plain double loop."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, id int, part string, scores int"


def plain(rows, step, positives=5, count=3, low=50, high=95):
    sound = {}
    for name, v, label in rows:
        if name is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * x) for x in v]
        if sum(x * x for x in ints) <= 2 ** 56:
            sound[name] = min(sound.get(name, (str(label), ints)), (str(label), ints))
    out = []
    for a, (label, v) in sound.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b) for b, (_, w) in sound.items() if b != a)
        for s, p in [x for x in scored if sound[x[1]][0] == label][:positives]:
            fit = [x for x in scored if sound[x[1]][0] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, k, n, -s, -t) for k, (t, n) in enumerate(fit[:count], 1)]
    return sorted(out)


def found(spark, rows, step, **how):
    data = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA)
    got = negatives.mine(data, F.col("id") % step == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(12)], k % 3) for k in range(300)]
    rows += [(k, [0.3] * 12, k % 4) for k in range(1000, 1200)]  # one common vector: ties
    rows += [(2000, None, 1), (2010, [0.0] * 12, 1), (2020, [0.1, None] * 6, 1), (2030, [float("nan")] * 12, 1), (2040, [float("inf")] * 12, 0), (2050, [], 2), (None, [0.5] * 12, 1),
             (2060, [0.4] * 5, 0), (2070, [0.2] * 5_000, 1), (2080, [0.3] * 12, None), (2090, [1e7] * 12, 1), (2100, [1e300] * 12, 1), (2110, [3e4, -2e4, 1e4], 0), (2120, [2.9e4, -2.1e4, 9e3], 1),
             (2130, [2.8e4, -2.2e4, 9.5e3], 0), (20, [0.1] * 12, 2), (30, [5.0] * 12, 0)]
    return rows + rows[:5]


def test_like_a_double_loop(spark, odd):
    want = plain(odd, 10)
    assert len(want) > 300
    assert found(spark, odd, 10) == want
    assert found(spark, odd, 10, group_values=2_000, part_anchors=7) == want


def test_other_numbers(spark, odd):
    assert found(spark, odd, 7, positives=2, negatives=8, low=20, high=100) == plain(odd, 7, 2, 8, 20, 100)


def test_few_rows(spark, odd):
    assert found(spark, [], 1) == [] and found(spark, odd[:1], 1) == [] and found(spark, odd[1:9], 10) == []
    same = [(k, v, 1) for k, v, _ in odd[:20]]
    assert found(spark, same, 1) == []  # no other label


def test_segments_bound_each_other_and_read_less():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 5, (300, 32)) for c in rng.normal(0, 60, (40, 32))]).astype(np.int64)
    segments = [negatives.Segment(r, (r % 2).astype(np.int64), x[r].T.astype(float)) for r in negatives._near_order(x)]
    assert sum(len(s.ids) for s in segments) == len(x) and len(segments) > 2
    read = 0
    for a in range(0, len(x), 3_000):
        looked = []
        best = negatives.nearest_of_label(segments, a, a % 2, x[a].astype(float), 5)
        scores = x @ x[a]
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i % 2 == a % 2 and i != a][:5]
        assert best.ids.tolist() == order and best.scores.tolist() == scores[order].tolist()
        for s in segments:
            alive, _ = s.scan(x[a].astype(float), np.arange(len(s.ids)), lambda p, lo, hi: looked.append(len(p)) or p + hi >= best.bound())
        read += sum(looked)
    assert read < 0.5 * 4 * len(x) * 5  # dimensions are read in five looks; most candidates are gone after the first ones
