"""Corpus pipeline: toxic and poor documents go, near copies and contaminated documents go, sources are mixed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written and read again as the next
stage's input.  All stages but the last return the columns of ``documents``; the last adds ``repetition`` and
``words_taken``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditspark.llm import decontaminate, mixing, quality, simhash, toxicity
from auditspark.llm.common import stored, table


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go.  The classifier learns from the labelled source rows."""
    model = toxicity.train(*_labelled(spark, sf_dir))
    return docs.filter(toxicity.score(model, F.col("text"), spark) < toxicity.THRESHOLD)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 for quality go.  The classifier learns from the labelled source rows."""
    model = quality.train(*_labelled(spark, sf_dir))
    return docs.filter(quality.score(model, F.col("text"), spark) >= quality.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover 5 % of the words or more go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each whole: a source comes as near to its target as whole documents allow."""
    return mixing.repeated(docs, whole=True)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_copies", drop_near_copies),
          ("decontamination", drop_contaminated), ("mixing", mix_sources)]
#: Trained classifiers, fingerprints and seeded samples are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
