"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (sizes SIZES, A-Z lower-cased, white space as one kind) that occur in it,
each once; a character of any script counts as one.  A feature's value is its log-count ratio: how much likelier it is in toxic than in other texts, from smoothed
counts over the labelled sample; a ratio within SURE standard errors of 0 counts as 0.  A logistic regression is
trained on these values.

Training: a bounded sample of labelled rows (``most`` ids, by hash) is dealt to ``shards`` groups.  Counts are summed
over groups, then each group trains on its rows with the common ratios, and the weights are averaged.  Model size is
fixed by BITS and SIZES.

Rows: NULL and empty texts have no features and get the bias; repeated rows and ties score alike; rows of ``labels``
with NULL, contradicting or other values are ignored; without any usable label every score is 0.5; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, SPACE, bounded_batches, labelled_shards, pieces, release_memory, sigmoid, slices, summed

SIZES = (4, 6)
BITS = 18
DIMS = len(SIZES) << BITS
SURE = 3.0
MOST_LABELS = 12_000
SHARDS = 6
STEPS = 200
THRESHOLD = 0.5
RATE, L2 = 2.0, 1e-4
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x9FB21C651E98DF25)
_PLAIN = np.where(SPACE, 32, LOWER).astype(np.uint8)


def characters(plain: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, bounds) of a run of UTF-8 texts: a character is the number its bytes make, bounds count characters."""
    if not (plain > 127).any():
        return plain.astype(np.uint64), bounds
    leads = (plain & 0xC0) != 0x80
    leads[bounds[bounds < len(plain)]] = True
    start = np.flatnonzero(leads)
    size = np.diff(np.append(start, len(plain)))
    out = plain[start].astype(np.uint64)
    for k in range(1, 4):
        more = size > k
        out[more] = out[more] << np.uint64(8) | plain[start[more] + k]
    return out, np.concatenate([[0], np.cumsum(leads)])[bounds]


def present(data: np.ndarray, bounds: np.ndarray, stamp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, features that occur in it) for each size and text of a run; ``stamp`` is scratch space of DIMS numbers."""
    own, bounds = characters(_PLAIN[data], bounds)
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    code = own
    for size in range(1, min(max(SIZES), len(own)) + 1):
        if size > 1:
            code = code[:-1] * _STEP + own[size - 1:]
        if size not in SIZES:
            continue
        index = (((code ^ (code >> np.uint64(23))) * _ODD) >> np.uint64(64 - BITS)).astype(np.int32) + np.int32(SIZES.index(size) << BITS)
        inside = owner[:len(code)] == owner[size - 1:]
        index, text = index[inside], owner[:len(code)][inside]
        cut = np.searchsorted(text, np.arange(len(bounds)))
        for k in np.flatnonzero(np.diff(cut)):
            part = index[cut[k]: cut[k + 1]]
            order = np.arange(len(part), dtype=np.int32)
            stamp[part] = order
            yield int(k), part[stamp[part] == order]


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _found(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, features that occur in it), once for each size."""
    stamp = np.zeros(DIMS, np.int32)
    for first, _, data, bounds in slices(pa.array(texts, pa.large_string())):
        for k, found in present(data, bounds, stamp):
            yield first + k, found


def _matrix(texts: list[str], used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every occurrence of a used feature."""
    rows, columns = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for row, found in _found(texts):
        columns.append(found[used[found]])
        rows.append(np.full(len(columns[-1]), row, np.int32))
    return np.concatenate(rows), np.concatenate(columns)


def _counts(pdf):
    import pandas as pd
    labels, both = pdf["label"].tolist(), np.zeros(2 * DIMS + 2)
    for row, found in _found(pdf["text"].tolist()):
        both[found + (0 if labels[row] else DIMS)] += 1
    both[-2:] = sum(labels), len(labels) - sum(labels)
    parts = pieces(both)
    release_memory()
    return pd.DataFrame({"piece": [p for p, _ in parts], "values": [v for _, v in parts]})


def log_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """log of the feature's smoothed share among toxic texts over its share among others; 0 where that is unsure."""
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((other + 1) / (n_other + 2))
    return np.where(np.abs(ratio) >= SURE * np.sqrt(1 / (toxic + 1) + 1 / (other + 1)), ratio, 0.0)


def fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Weights on the present features (ratio times coefficient) and the bias, by accelerated full-batch steps."""
    names, column = np.unique(columns, return_inverse=True)  # only what the ratios left
    value = ratios[names]
    n = len(labels)
    scale = np.sqrt(np.mean(np.bincount(rows, weights=value[column] ** 2, minlength=n)) + 1e-9)
    x = value / scale
    share = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1))  # both classes weigh the same
    w, b, ahead_w, ahead_b = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0
    for step in range(1, STEPS + 1):
        margin = np.bincount(rows, weights=(ahead_w * x)[column], minlength=n) + ahead_b
        off = (sigmoid(margin) - labels) * share
        new_w = ahead_w - RATE * (np.bincount(column, weights=off[rows], minlength=len(names)) * x + L2 * ahead_w)
        new_b = ahead_b - RATE * off.sum()
        pace = (step - 1) / (step + 2)
        ahead_w, ahead_b = new_w + pace * (new_w - w), new_b + pace * (new_b - b)
        w, b = new_w, new_b
    out = np.zeros(DIMS + 1)
    out[names], out[-1] = w * x, b
    return out


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = MOST_LABELS, shards: int = SHARDS) -> Model:
    shard = labelled_shards(docs, labels, column, most, shards).groupBy("shard")
    both = summed(shard.applyInPandas(_counts, "piece int, values binary"), 2 * DIMS + 2)
    held = docs.sparkSession.sparkContext.broadcast(
        log_ratios(both[:DIMS], both[DIMS: 2 * DIMS], both[-2], both[-1]).astype(np.float32))

    def run(pdf):
        import pandas as pd
        rows, columns = _matrix(pdf["text"].tolist(), held.value != 0)
        parts = pieces(np.append(fit(rows, columns, pdf["label"].to_numpy(), held.value), 1.0))
        del rows, columns
        release_memory()
        return pd.DataFrame({"piece": [p for p, _ in parts], "values": [v for _, v in parts]})

    total = summed(shard.applyInPandas(run, "piece int, values binary"), DIMS + 2)
    mean = total[:-1] / max(total[-1], 1.0)
    return Model(mean[:-1].astype(np.float32), float(mean[-1]))


def score(model: Model, text: Column, spark) -> Column:
    """Score 0 to 1 of a text column; higher: toxic is likelier."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, stamp = held.value, np.zeros(DIMS, np.int32)
        for column in columns:
            out = np.full(len(column), own.bias)
            for first, _, data, bounds in slices(column.cast(pa.large_string()).fill_null("")):
                for k, found in present(data, bounds, stamp):
                    out[first + k] += own.weights[found].sum(dtype=np.float64)
            yield pa.array(sigmoid(out))
        release_memory()

    return run(text)
