"""Hard-negative mining by a vertical scan with bounds (branch and bound on decomposed data).

Vectors become integers (``floor(scale * x)``), a score is the inner product with the anchor.  An anchor's positives are
its ``positives`` best other rows of the same label; for each of them the negatives are the ``negatives`` best rows of
another label whose score lies between ``low`` and ``high`` per cent of the positive's.  Higher scores come first, ties
by smaller id.

Rows are held in segments by dimension.  For one anchor the dimensions of a segment are read in descending magnitude of
the anchor's components, a few at a time; what the dimensions not yet read can add lies between the sums of their least
and greatest contributions (segment minimum and maximum times the anchor's component).  A candidate leaves the bitmap as
soon as these bounds keep it out of the best rows, or out of every window, until the rest is exact.  What an earlier
segment found bounds the next one.

Work is dealt by groups of rows (about GROUP_VALUES components each at most) and parts of anchors; a task holds one group, anchors
stream past it, and the best of all groups are merged by windows.  Nothing is collected, and a common label or vector
is spread like any other.

Rows: a NULL id, label or vector, and NULL or non-finite components keep a row out; so does an integer vector longer
than 2**28, as scores times 100 would not fit a long.  Components that one of two vectors lacks count as zero, so an
empty vector scores zero.  Of several rows with one id the smallest (label, vector) is used; an anchor is never its own
positive.  A negative positive score has no window; a score of zero takes negatives that score zero.  Empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, stored

#: Most components held by a task, about; the least rows that are worth a task.
GROUP_VALUES = 1 << 22
SMALLEST_GROUP = 1 << 10
PART_ANCHORS = 1 << 16
SEGMENT_ROWS = 1 << 12
#: Dimensions read between two looks at the bounds.
STEP = 8
LONGEST = 2.0 ** 28
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(vectors: DataFrame, scale: float = 256, label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row (id, label, v) per id that takes part; v as integers, label as text."""
    v = F.col(vector).cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col(label).isNotNull() & v.isNotNull() \
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    steps = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    short = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) <= LONGEST ** 2
    rows = vectors.filter(sound).select(F.col("vec_id").cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), steps.alias("v"), short.alias("short"))
    one = rows.filter("short").groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"))
    return one.select("id", "row.label", "row.v")


class Segment:
    """Some rows by dimension, with the least and greatest component of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray) -> None:
        self.ids, self.labels, self.columns = ids, labels, columns
        self.least, self.most = columns.min(axis=1), columns.max(axis=1)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, prune: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of the candidates that survive; ``prune(partial, least rest, greatest rest)`` marks who stays."""
        dims = min(len(anchor), len(self.columns))
        order = np.argsort(-np.abs(anchor[:dims]), kind="stable")
        a = anchor[order]
        one, two = a * self.least[order].astype(float), a * self.most[order].astype(float)
        low, high = (np.append(np.cumsum(side[::-1])[::-1], 0.0) for side in (np.minimum(one, two), np.maximum(one, two)))
        # doubles round integers over 2**53: widened by more than that, the bounds stay bounds
        slack = np.zeros(dims + 1) if self.columns.dtype == np.float64 else 1e-9 * (np.abs(low) + np.abs(high)) + 64
        partial = np.zeros(len(alive), self.columns.dtype)
        for k in range(0, dims + STEP, STEP):
            at = min(k, dims)
            stay = prune(partial, low[at] - slack[at], high[at] + slack[at])
            if stay is not None and not stay.all():
                alive, partial = alive[stay], partial[stay]
            if at == dims or not len(alive):
                break
            read = order[at: at + STEP]
            part = self.columns[read] if len(alive) == len(self.ids) else self.columns[np.ix_(read, alive)]
            partial += a[at: at + STEP].astype(self.columns.dtype) @ part
        return alive, partial


def _best(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` first: higher scores, then smaller ids."""
    if len(scores) > 4 * count:
        least = np.partition(scores, len(scores) - count)[len(scores) - count]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:count]


class Found:
    """The best (id, score) so far, ``count`` at most."""

    def __init__(self, count: int) -> None:
        self.count, self.ids, self.scores = count, np.zeros(0, np.int64), np.zeros(0)

    def bound(self) -> float:
        return self.scores[-1] if len(self.ids) == self.count else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores.astype(scores.dtype), scores])
        best = _best(ids, scores, self.count)
        self.ids, self.scores = ids[best], scores[best]


def nearest_of_label(segments: list[Segment], name: int, label: int, anchor: np.ndarray, count: int) -> Found:
    """The best rows of the anchor's label."""
    found = Found(count)
    for s in segments:
        def prune(partial, low, high, found=found):
            least = found.bound()
            if len(partial) > count:
                least = max(least, np.partition(partial, len(partial) - count)[len(partial) - count] + low)
            return partial + high >= least

        alive, scores = s.scan(anchor, np.flatnonzero((s.labels == label) & (s.ids != name)), prune)
        found.add(s.ids[alive], scores)
    return found


def in_windows(segments: list[Segment], name: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], count: int) -> list[Found]:
    """The best rows of other labels in each window of scores."""
    found = [Found(count) for _ in windows]
    for s in segments:
        def prune(partial, low, high, found=found):
            stay = np.zeros(len(partial), bool)
            for (first, last), best in zip(windows, found):
                least = max(first, best.bound())
                if high - low < last - first:  # some rows are in the window for sure
                    sure = partial[(partial + low >= first) & (partial + high <= last)] + low
                    if len(sure) >= count:
                        least = max(least, np.partition(sure, len(sure) - count)[len(sure) - count])
                stay |= (partial + high >= least) & (partial + low <= last)
            return stay

        alive, scores = s.scan(anchor, np.flatnonzero((s.labels != label) & (s.ids != name)), prune)
        for (first, last), best in zip(windows, found):
            inside = (scores >= first) & (scores <= last)
            best.add(s.ids[alive[inside]], scores[inside])
    return found


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of the lists of a column."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _matrices(values: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, rows padded with zeros), by lengths up to the same power of two, so that a long vector pads few."""
    sizes = np.diff(bounds)
    kinds = np.ceil(np.log2(np.maximum(sizes, 1)))
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        inside = np.arange(int(sizes[rows].max()))[None] < sizes[rows][:, None]
        out = np.zeros(inside.shape, np.int64)
        out[inside] = values[np.repeat(kinds == kind, sizes)]
        yield rows, out


def _near_order(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers in segments, halved along the widest dimension, so that least and greatest lie close."""
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= SEGMENT_ROWS:
            done.append(rows)
            continue
        wide = int(np.argmax(x[rows].astype(float).std(axis=0))) if x.shape[1] else 0
        half = np.argpartition(x[rows, wide], len(rows) // 2) if x.shape[1] else np.arange(len(rows))
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2:]]]
    return done


def _segments(held: list[pa.Table]) -> tuple[list[Segment], pa.Array]:
    table = pa.concat_tables(held)
    ids = table.column("id").to_numpy()
    names = table.column("label").combine_chunks().dictionary_encode()
    codes, out = names.indices.to_numpy(), []
    for rows, x in _matrices(*_lists(table.column("v"))):
        # any other vector is LONGEST at most, so a score is exact in doubles if this side is shorter than 2**20
        exact = float((np.abs(x).max(axis=0, initial=0).astype(float) ** 2).sum()) < 2.0 ** 40
        for near in _near_order(x):
            out.append(Segment(ids[rows[near]], codes[rows[near]], np.ascontiguousarray(x[near].T.astype(np.float64 if exact else np.int64))))
    return out, names.dictionary


def _anchors(rows: pa.Table, names: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[int]]]:
    known = {name: k for k, name in enumerate(names.to_pylist())}
    values, bounds = _lists(rows.column("v"))
    for k, (name, label, scores) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("id", "label", "scores")))):
        yield name, known.get(label, -1), values[bounds[k]: bounds[k + 1]], scores


def _scan(answer: Callable) -> Callable:
    """Task: per (group, part) the rows are gathered into segments, then the anchors stream past them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, segments, names = None, [], None, None
        for batch in batches:
            group, part, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            change = np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for first, last in zip([0, *change], [*change, batch.num_rows]):
                if first == last:
                    continue
                rows = pa.Table.from_batches([batch.slice(first, last - first)])
                if cell != (group[first], part[first]):
                    cell, held, segments = (group[first], part[first]), [], None
                if not asks[first]:
                    held.append(rows)
                    continue
                if segments is None:
                    segments, names = _segments(held) if held else ([], pa.array([], pa.string()))
                    held = []
                out = [(name, key, best) for anchor in _anchors(rows, names) for name, key, best in answer(segments, *anchor)]
                out = [o for o in out if len(o[2].ids)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([o[k] for o in out], [len(o[2].ids) for o in out]), pa.int64()) for k in (0, 1)]
                        + [pa.array(np.concatenate([o[2].ids for o in out]), pa.int64()), pa.array(np.concatenate([o[2].scores for o in out]).astype(np.int64))],
                        names=["anchor_id", "key", "id", "score"])

    return run


def _dealt(rows: DataFrame, anchors: DataFrame, groups: int, parts: int, answer: Callable) -> DataFrame:
    """Every anchor meets every group of rows once."""
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int")
    there = rows.select(group.alias("group"), copies(parts).alias("part"), F.lit(False).alias("asks"), "id", "label", "v", F.lit(None).cast("array<bigint>").alias("scores"))
    asking = anchors.select(copies(groups).alias("group"), part.alias("part"), F.lit(True).alias("asks"), "id", "label", "v", "scores")
    cells = there.unionAll(asking).repartition(groups * parts, "group", "part").sortWithinPartitions("group", "part", "asks")
    return cells.mapInArrow(_scan(answer), "anchor_id bigint, key bigint, id bigint, score bigint")


def mine(vectors: DataFrame, asked: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256,
         label: str = "label", vector: str = "embedding", group_values: int = GROUP_VALUES, part_anchors: int = PART_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the ids where ``asked`` (over id) holds."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = stored(usable(vectors, scale, label, vector))
    total = rows.agg(F.count("*").alias("rows"), F.sum(F.size("v")).alias("values"), F.count_if(asked).alias("asking")).first()
    count, asking = total["rows"], total["asking"]
    if not asking:
        return spark.createDataFrame([], RESULT)
    groups = max(-(-total["values"] // group_values), min(2 * spark.sparkContext.defaultParallelism, -(-count // SMALLEST_GROUP)))
    parts = -(-asking // part_anchors)

    def same(segments, name, own, v, _):
        yield name, 0, nearest_of_label(segments, name, own, v, positives)

    def other(segments, name, own, v, scores):
        windows = [(-(-low * s // 100), high * s // 100) for s in scores]
        yield from zip([name] * len(scores), scores, in_windows(segments, name, own, v, windows, negatives))

    anchors = rows.filter(asked).withColumn("scores", F.array().cast("array<bigint>"))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    good = _dealt(rows, anchors, groups, parts, same).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= positives)
    good = stored(good.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # an anchor has few positives, so their scores are a short list
    windows = good.filter("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))
    bound = rows.filter(asked).join(windows.withColumnRenamed("anchor_id", "id"), "id")
    first = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "id")
    hard = _dealt(rows, bound, groups, parts, other).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    hard = hard.select("anchor_id", F.col("key").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return good.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
