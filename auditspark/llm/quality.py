"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Features of a text, each block weighted by its share of the text: words, word pairs, word shapes and pairs of shapes.
A word equal to the one before it is written as one fixed token, and a shape keeps a word's kinds of characters
(capital, small, digit, other letter, each mark as it is), so that words never seen in training still count.  A score
is the sparse dot product of these shares with the weights, plus a bias.

Training: a bounded sample of labelled rows (``most`` ids, by hash) is dealt to ``shards`` groups; every group runs
FTRL over its rows, and the weights are averaged.  The model has 2**BITS weights, whatever the input.

Rows: NULL and empty texts have no features and get the bias; repeated rows and ties score alike; rows of ``labels``
with NULL, contradicting or other values are ignored; without any usable label every score is 0.5; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, SPACE, bounded_batches, labelled_shards, mixed, pieces, release_memory, sigmoid, slices, span_hashes, spans, summed

BITS = 18
MOST_LABELS = 16_000
SHARDS = 8
EPOCHS = 4
THRESHOLD = 0.3
#: FTRL-proximal: learning rate, its offset, and the penalties.
ALPHA, BETA, L1, L2 = 0.5, 0.05, 1e-3, 1e-3
_SCALE = 4.0
_REPEAT = np.uint64(0x5851F42D4C957F2D)

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 120


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight) of every n-gram occurrence in a run of texts."""
    starts, ends, text = spans(~SPACE[data], bounds)
    words = span_hashes(data, starts, ends)
    repeat = np.zeros(len(words), bool)
    repeat[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    words = np.where(repeat, _REPEAT, words)
    kinds = _SHAPE[data]
    kept = np.ones(len(data), bool)
    kept[1:] = kinds[1:] != kinds[:-1]
    kept[starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shapes = span_hashes(kinds[kept], place[starts], place[ends])
    pair = np.flatnonzero(text[1:] == text[:-1]) + 1
    blocks = []
    for salt, (unit, own) in enumerate(((words, text), (shapes, text))):
        blocks.append((unit + np.uint64(2 * salt + 1), own))
        blocks.append((mixed(unit[pair - 1] * np.uint64(31) + unit[pair]) + np.uint64(2 * salt + 2), own[pair]))
    count = len(bounds) - 1
    out = []
    for code, own in blocks:
        share = _SCALE / np.maximum(np.bincount(own, minlength=count), 1)
        out.append((own, (mixed(code) >> np.uint64(64 - BITS)).astype(np.int64), share[own]))
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after passing over (features, values, label) rows ``epochs`` times; the last weight is the bias."""
    z, n = np.zeros(dims), np.zeros(dims)

    def now(k):
        zk = z[k]
        return np.where(np.abs(zk) <= L1, 0.0, (np.sign(zk) * L1 - zk) / ((BETA + np.sqrt(n[k])) / ALPHA + L2))

    for _ in range(epochs):
        for k, x, label in rows:
            w = now(k)
            g = (float(sigmoid(w @ x)) - label) * x
            step = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA
            z[k] += g - step * w
            n[k] += g * g
    return now(np.arange(dims))


def _rows(texts: list[str], labels: list[int], dims: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    out = []
    for first, last, data, bounds in slices(pa.array(texts, pa.large_string())):
        text, feature, weight = features(data, bounds)
        code, inverse = np.unique(text * (1 << BITS) + feature, return_inverse=True)
        total = np.bincount(inverse, weights=weight, minlength=len(code))
        cut = np.searchsorted(code >> BITS, np.arange(last - first + 1))
        for k in range(last - first):
            part = slice(cut[k], cut[k + 1])
            out.append((np.append(code[part] & ((1 << BITS) - 1), dims - 1), np.append(total[part], 1.0), labels[first + k]))
    return out


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MOST_LABELS, shards: int = SHARDS) -> Model:
    dims = (1 << BITS) + 1

    def fit(pdf):
        import pandas as pd
        pdf = pdf.sort_values(["doc_id", "text"], key=lambda s: pd.util.hash_array(s.to_numpy()) if s.name == "doc_id" else s)
        weights = ftrl(_rows(pdf["text"].tolist(), pdf["label"].tolist(), dims), dims)
        parts = pieces(np.append(weights, 1.0))
        release_memory()
        return pd.DataFrame({"piece": [p for p, _ in parts], "values": [v for _, v in parts]})

    shard = labelled_shards(docs, labels, column, most, shards).groupBy("shard")
    total = summed(shard.applyInPandas(fit, "piece int, values binary"), dims + 1)
    mean = total[:-1] / max(total[-1], 1.0)
    return Model(mean[:-1].astype(np.float32), float(mean[-1]))


def score(model: Model, text: Column, spark) -> Column:
    """Score 0 to 1 of a text column; higher: label 1 is likelier."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for column in columns:
            out = np.empty(len(column))
            for first, last, data, bounds in slices(column.cast(pa.large_string()).fill_null("")):
                where, feature, weight = features(data, bounds)
                out[first:last] = np.bincount(where, weights=own.weights[feature] * weight, minlength=last - first)
            yield pa.array(sigmoid(out + own.bias))
        release_memory()

    return run(text)
