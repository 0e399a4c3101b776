"""Language identification by nearest centroid: normalised TF-IDF vectors of hashed letter n-grams, compared by cosine
with several clustered centroids for each language; texts too far from the centroid that won are rejected.

Document frequencies are counted over all training rows.  Centroids come from spherical k-means over a bounded sample
of each language (``most`` rows, the first by hash of the id).  A centroid's reach is the distance below which REACH of
its own sample lies, times SLACK; a text beyond its winner's reach is marked rejected.

Rows: NULL texts and texts without a letter are ``und`` with score 0; empty and very long texts, ties (first language
and centroid in order) and repeated rows get a result each; rows without a language teach nothing; without any
training row every text is ``und``; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER, bounded_batches, fold, pieces, slices, stored, summed, texts_of

BITS = 13
DIMS = 1 << BITS
SIZES = (1, 2, 3)
CENTROIDS = 3
MOST = 600
ROUNDS = 8
REACH, SLACK = 0.99, 1.25
UNKNOWN = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, n-gram counts) of each text: lower-cased, all but letters as a blank."""
    for first, last, data, bounds in slices(texts):
        for k in range(last - first):
            own = data[bounds[k]: bounds[k + 1]]
            if (own > 127).any():
                own = np.frombuffer(own.tobytes().decode("utf-8", "replace").lower().encode(), np.uint8)
            else:
                own = LOWER[own]
            plain = np.empty(len(own) + 2, np.uint8)
            plain[0] = plain[-1] = 32
            plain[1:-1] = _LETTER[own]
            plain = plain[np.concatenate([[True], (plain[1:] != 32) | (plain[:-1] != 32)])].astype(np.uint32)
            total = np.zeros(DIMS, np.int64)
            for size in SIZES:
                n = len(plain) - size + 1
                if n <= 0:
                    continue
                code = np.full(n, size, np.uint64)
                for j in range(size):
                    code = (code << np.uint64(8)) | plain[j: j + n]
                total += np.bincount(((code * _ODD) >> np.uint64(64 - BITS)).astype(np.int64), minlength=DIMS)
            yield first + k, total


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, total in counts(texts):
        out[row] = np.log1p(total) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS + 1)
    for batch in batches:
        for _, own in counts(texts_of(batch)):
            total[:-1] += own > 0
            total[-1] += 1
    rows = pieces(total)
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["piece", "values"])


def clustered(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's centroid: farthest-first seeds, then spherical k-means."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    centre = x[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        for c in range(len(centre)):
            if (own == c).any():
                mean = x[own == c].mean(axis=0)
                centre[c] = mean / max(np.linalg.norm(mean), 1e-9)
    return centre, np.argmax(x @ centre.T, axis=1)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    reach: np.ndarray


def train(docs: DataFrame, modulus: int = 3, held: int = 1, most: int = MOST, centroids: int = CENTROIDS) -> Model:
    """Learns from the rows with a language and a text whose id's fold is not ``held``."""
    bounded_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", modulus) != held))
    total = summed(known.select("text").mapInArrow(_frequencies, "piece int, values binary"), DIMS + 1)
    idf = (np.log((1 + total[-1]) / (1 + total[:-1])) + 1).astype(np.float32)
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("rows")))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = known.select("doc_id", "lang").join(sizes, "lang").filter(lot <= F.least(F.lit(1.0), 2 * most / F.col("rows")) * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(lot, "doc_id"))  # over about 2 * most rows a language
    sample = stored(few.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "lang").distinct())
    texts = known.select("doc_id", "lang", "text").join(sample, ["doc_id", "lang"])
    held_idf = docs.sparkSession.sparkContext.broadcast(idf)

    def fit(pdf):
        import pandas as pd
        pdf = pdf.assign(at=pd.util.hash_array(pdf["text"].to_numpy())).sort_values(["at", "doc_id"])[:2 * most]
        x = vectors(pa.array(pdf["text"].tolist(), pa.large_string()), held_idf.value)
        centre, own = clustered(x, centroids)
        away = 1 - (x * centre[own]).sum(axis=1)
        reach = [float(np.quantile(away[own == c], REACH)) * SLACK if (own == c).any() else 0.0 for c in range(len(centre))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in centre], "reach": reach})

    rows = sorted(texts.groupBy("lang").applyInPandas(fit, "lang string, centroid binary, reach double").collect(), key=lambda r: (r["lang"], r["centroid"]))
    matrix = np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]).reshape(-1, DIMS)
    return Model(idf, [r["lang"] for r in rows], matrix, np.array([r["reach"] for r in rows]))


def identify(model: Model, text: Column, spark) -> Column:
    """Struct column (lang, score, rejected) for a text column; score is the winner's cosine, 0 to 1."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        weighted = own.centroids * own.idf
        for column in columns:
            texts = column.cast(pa.large_string()).fill_null("")
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if own.languages:
                for row, total in counts(texts):
                    found = np.flatnonzero(total)
                    tf = np.log1p(total[found]).astype(np.float32)
                    cosine = weighted[:, found] @ tf / max(float(np.linalg.norm(tf * own.idf[found])), 1e-9)
                    best = int(np.argmax(cosine))
                    lang[row], score[row] = own.languages[best], min(max(float(cosine[best]), 0.0), 1.0)
                    rejected[row] = 1 - cosine[best] > own.reach[best]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["lang", "score", "rejected"])

    return run(text)


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; no letter means ``und``, score 0 and rejected."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.withColumn("_found", identify(model, F.col("text"), docs.sparkSession))
    return (found.withColumn("lang_pred", F.when(letters, F.col("_found.lang")).otherwise(UNKNOWN))
            .withColumn("score", F.when(letters, F.col("_found.score")).otherwise(0.0))
            .withColumn("rejected", F.when(letters, F.col("_found.rejected")).otherwise(True)).drop("_found"))
