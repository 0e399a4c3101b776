"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets: sources share ``share`` times all words in proportion to their weights; a source whose target would exceed
``most`` times its own words is clamped there and its excess goes to the others in proportion, until none is above.
Sampling: every document of a source is taken floor(target / words) times; what is missing to the target is taken
once more from documents in the order of a seeded hash, the last of them in part.

A source's documents are never gathered: their words are summed by hash bucket, the running sums of the at most
BUCKETS buckets of a source name the bucket in which its target falls, and only that bucket is ordered.

Rows: a NULL text has no words and is never taken; NULL is a source of its own, the last; repeated rows and ties count
as rows; an empty table gives an empty result; other columns are ignored by the decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BUCKETS = 4096
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(source: Column) -> Column:
    """A join key that keeps NULL apart from every text and after them."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, weight, target) from (key, source_size), weights repeating over the keys in order.

    Sources are put in order and numbered range by range.  Each round clamps the sources that the present level puts
    at or above their cap and raises the level for the rest; rounds end when none is newly clamped.
    """
    spark = sources.sparkSession
    ranged = stored(sources.repartitionByRange("key").sortWithinPartitions("key")
                    .withColumn("part", F.spark_partition_id()).withColumn("step", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn(  # one row for each range
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.pmod(F.col("before") + F.col("step"), F.lit(len(weights))).cast("int")
    named = stored(ranged.join(sizes, "part").select(
        "key", "source_size", F.element_at(F.array(*map(F.lit, weights)), number + 1).alias("weight"))
        .withColumn("cap", F.lit(most) * F.col("source_size")))
    total = share * (named.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = -1.0, -1
    while True:
        above = F.col("cap") <= level * F.col("weight")
        row = named.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
                        F.count_if(above)).first()
        if row[2] == clamped or not row[1]:
            break
        level, clamped = max(level, (total - row[0]) / row[1]), row[2]
    return named.select("key", "source_size", "weight", F.least("cap", F.col("weight") * F.lit(float(level))).alias("target"))


def _marked(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with key, size, lot and hash bucket of each row, under names of our own."""
    return (docs.withColumn("_key", _key(F.col("source"))).withColumn("_size", words(F.col("text")))
            .withColumn("_lot", F.xxhash64("doc_id", F.lit(seed)))
            .withColumn("_bucket", F.shiftrightunsigned("_lot", 52).cast("int")))


def _plan(rows: DataFrame, weights: tuple, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of each source, and the extra words of each row in the bucket where a source's target falls.

    Rows below that bucket are taken once more, rows above it are not.
    """
    summed = stored(rows.groupBy("_key", "_bucket").agg(F.sum("_size").alias("size")))  # at most BUCKETS rows a source
    plan = targets(summed.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = plan.withColumnRenamed("key", "_key")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)
    plan = plan.withColumn("whole", F.floor(ratio).cast("bigint"))
    plan = plan.withColumn("need", F.round("target").cast("bigint") - F.col("whole") * F.col("source_size"))
    running = F.sum("size").over(Window.partitionBy("_key").orderBy("_bucket")) - F.col("size")
    turning = (summed.withColumn("before", running).join(plan, "_key").filter("before < need and need <= before + size")
               .select("_key", F.col("_bucket").alias("edge"), (F.col("need") - F.col("before")).alias("rest")))
    plan = stored(plan.join(turning, "_key", "left").select(
        "_key", "source_size", "target", "whole", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("rest", F.lit(0)).alias("rest")))
    order = Window.partitionBy("_key").orderBy("_lot", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.join(plan, "_key").filter("_bucket = edge").withColumn("before", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    edge = edge.withColumn("more", F.greatest(F.lit(0), F.least("_size", F.col("rest") - F.col("before"))))
    return plan, stored(edge.select("_key", "doc_id", "_size", "source_size", "target", (F.col("whole") * F.col("_size") + F.col("more")).alias("taken")))


def _clear(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows outside their source's edge bucket, with what is taken of them; the plan has one row for each source."""
    more = F.when(F.col("_bucket") < F.col("edge"), F.col("_size")).otherwise(0)
    return rows.join(plan, "_key").filter("_bucket <> edge").withColumn("taken", F.col("whole") * F.col("_size") + more)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, key, size, source_size, target, taken): one row per row of ``docs``."""
    rows = stored(_marked(docs.select("doc_id", "source", "text"), seed).select("doc_id", "_key", "_size", "_lot", "_bucket"))
    plan, edge = _plan(rows, weights, share, most)
    both = _clear(rows, plan).select("_key", "doc_id", "_size", "source_size", "target", "taken").unionAll(edge)
    return both.select("doc_id", F.col("_key").alias("key"), F.col("_size").alias("size"), "source_size", "target", "taken")


def repeated(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
             whole: bool = False) -> DataFrame:
    """``docs`` as the mix takes them: a row for each repetition, with ``repetition`` (from 1) and ``words_taken``.

    A repetition in part carries the words taken, space-joined.  Texts are not exchanged: only the few rows in an edge
    bucket are looked up by id; rows there that share id, source and size are taken alike.

    With ``whole`` no text is cut: such rows are taken as many whole times as comes nearest to what the mix takes of them.
    """
    marked = _marked(docs, seed)
    plan, edge = _plan(stored(marked.select("doc_id", "_key", "_size", "_lot", "_bucket")), weights, share, most)
    nearest = F.when(F.col("_size") > 0, F.round(F.try_divide(F.sum("taken"), F.count("*") * F.col("_size"))).cast("bigint") * F.col("_size")).otherwise(0)
    taken = nearest if whole else F.max("taken")
    edge = edge.groupBy("_key", "doc_id", "_size").agg(taken.alias("_taken")).select("_key", "_size", F.col("doc_id").alias("_id"), "_taken")
    plan = plan.select("_key", F.col("whole").alias("_whole"), F.col("edge").alias("_edge"))
    rows = marked.join(plan, "_key")
    above = F.when(F.col("_bucket") < F.col("_edge"), F.col("_size")).otherwise(0)
    clear = rows.filter("_bucket <> _edge").withColumn("_taken", F.col("_whole") * F.col("_size") + above).select(*docs.columns, "_size", "_taken")
    turn = rows.filter("_bucket = _edge").alias("r").join(
        edge.alias("e"), (F.col("r._key") == F.col("e._key")) & (F.col("r._size") == F.col("e._size")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    turn = turn.select(*[F.col(f"r.`{c}`") for c in docs.columns], "r._size", "_taken")
    rows = clear.unionAll(turn).filter("_taken > 0")
    rows = rows.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    rows = rows.withColumn("words_taken", F.least("_size", F.col("_taken") - (F.col("repetition") - 1) * F.col("_size")))
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words_taken").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("words_taken") < F.col("_size"), some).otherwise(F.col("text")))
    return rows.select(*[c for c in docs.columns if c not in ("repetition", "words_taken")], "repetition", "words_taken")
