"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own (k-means over a bounded sample), and the pair of
centroid numbers names the cell that lists the vector.  A query walks the pairs of its two sorted centroid lists in
order of summed distance with a heap until the cells it has visited hold enough vectors, and reranks their entries by
exact distance.  "Enough" is a share of all vectors, calibrated on the sample: the least share at which sampled queries
find RECALL of their true neighbours.  The codebooks grow with the table, so that a cell keeps about CELL_ENTRIES
vectors and the share falls.

Equal vectors are one entry with a list of their smallest ids, as many as a result can show.  Cells are dealt to
buckets, large cells over several; a query goes once to each bucket, with the cells it visits there, streams past the
bucket's entries, and takes the best along; these are merged, so no cell, vector or query meets in one task as a whole.

Rows: vectors that are NULL, zero, of another length than the commonest, or with NULL or non-finite components take no
part; ties go to the smaller id; NULL ids take no part; of several vectors of one id the smallest is used; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

#: Codes per half: at least, at most, and so that a cell holds so many entries on average.
CODES = (16, 512)
CELL_ENTRIES = 20
#: Rows of the sample, and rows for each code.
SAMPLE = 6_000
CODE_ROWS = 16
SAMPLE_QUERIES = 150
ROUNDS = 8
RECALL = 0.95
CELL_ROWS = 2_000
BUCKET_ROWS = 8_000
SMALLEST_BUCKET = 500
#: A part of a cell lies in the bucket ``cell * SPREAD + part``, modulo their number.
SPREAD = 7919


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One (vec_id, v) row per id that takes part, v as doubles."""
    v = F.col(vector).cast("array<double>")
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) \
        & F.exists(v, lambda x: x != 0)
    found = vectors.filter(sound).select("vec_id", v.alias("v"))
    lengths = found.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return found.filter(F.size("v") == (lengths["n"] if lengths else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.argmin(_squares(x, centre), axis=1)
        for c in range(len(centre)):
            if (own == c).any():
                centre[c] = x[own == c].mean(axis=0)
    return centre


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


@dataclass
class Index:
    """Codebooks, entries per cell, and the share of entries that a query visits."""
    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray
    share: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        a, b = np.argmin(_squares(x[:, :half], self.left), 1), np.argmin(_squares(x[:, half:], self.right), 1)
        return a * len(self.right) + b

    def visited(self, q: np.ndarray, enough: float) -> list[int]:
        """Cells in order of summed distance until they hold ``enough`` entries: the multi-sequence walk."""
        half = len(q) // 2
        da, db = _squares(q[None, :half], self.left)[0], _squares(q[None, half:], self.right)[0]
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        heap, seen, out, held = [(da[oa[0]] + db[ob[0]], 0, 0)], {(0, 0)}, [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(oa[i]) * len(self.right) + int(ob[j])
            if self.sizes[cell]:
                out.append(cell)
                held += int(self.sizes[cell])
            for i, j in ((i + 1, j), (i, j + 1)):
                if i < len(oa) and j < len(ob) and (i, j) not in seen:
                    seen.add((i, j))
                    heapq.heappush(heap, (da[oa[i]] + db[ob[j]], i, j))
        return out


def calibrated(x: np.ndarray, top: int, codes: int, recall: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Codebooks from the sample and the share of entries at which its queries reach ``recall``."""
    half = x.shape[1] // 2
    index = Index(_kmeans(x[:, :half], codes), _kmeans(x[:, half:], codes), np.zeros(0), 1.0)
    own = index.cells(x)
    index.sizes = np.bincount(own, minlength=len(index.left) * len(index.right))
    needed = []
    for k in range(0, len(x), max(len(x) // SAMPLE_QUERIES, 1)):
        away = _squares(x[k: k + 1], x)[0]
        away[k] = np.inf
        order = index.visited(x[k], float("inf"))
        place = np.zeros(len(index.sizes))
        place[order] = np.cumsum(index.sizes[order])
        needed += place[own[np.argsort(away, kind="stable")[:top]]].tolist()
    return index.left, index.right, min(1.0, float(np.quantile(needed, recall)) / len(x)) if needed else 1.0


def build(entries: DataFrame, top: int, codes: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> tuple[Index | None, DataFrame | None]:
    """The index and the stored entries (vec_id, v, cell).  Cells number codes squared, CODES at most, whatever the input."""
    codes = codes or int(np.clip((entries.count() / CELL_ENTRIES) ** 0.5, *CODES))
    rows = entries.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, CODE_ROWS * codes)).collect()
    if not rows:
        return None, None
    left, right, share = calibrated(np.array([r["v"] for r in rows]), top, codes, recall)
    index = Index(left, right, np.zeros(0), share)
    held = entries.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("int")
    def cell(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(held.value.cells(_matrix(column)).astype(np.int32)) if len(column) else pa.array([], pa.int32())

    listed = stored(entries.withColumn("cell", cell(F.col("v"))))
    index.sizes = np.zeros(len(left) * len(right), np.int64)
    for row in listed.groupBy("cell").agg(F.count("*").alias("n")).collect():
        index.sizes[row["cell"]] = row["n"]
    return index, listed


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, asked: Column, top: int = 10, vector: str = "embedding", **how) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``asked`` (over vec_id) holds, its ``top`` nearest others."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, vector))
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    entries = stored(rows.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    index, listed = build(entries, top, **how)
    if index is None:
        return none
    enough = index.share * float(index.sizes.sum())
    held = spark.sparkContext.broadcast(index)
    total = int(index.sizes.sum())
    buckets = max(-(-total // BUCKET_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-total // SMALLEST_BUCKET)))
    split = [(cell, n) for cell, n in enumerate((-(-index.sizes // CELL_ROWS)).tolist()) if n > 1]  # few: each has over CELL_ROWS entries
    parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in split for x in pair]), F.col("cell")), F.lit(1)) if split else F.lit(1)
    ids = F.col("vec_id").cast("bigint")

    # an entry is asked if any of its equal vectors is
    queries = stored(rows.filter(asked).select(ids.alias("query_id"), "v"))
    probes = queries.groupBy("v").agg(F.min("query_id").alias("probe"))

    several = dict(split)

    @F.arrow_udf("array<struct<bucket:int,places:array<bigint>>>")
    def walk(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([_by_bucket(held.value.visited(q, enough), several, buckets) for q in _matrix(column)],
                           pa.list_(pa.struct([("bucket", pa.int32()), ("places", pa.list_(pa.int64()))])))

    dealt = probes.select("probe", "v", F.inline(walk(F.col("v")))).select("bucket", F.lit(True).alias("asks"), "probe", "v", "places")
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), parts)
    there = listed.select("cell", part.alias("part"), "vec_id", "v").select(
        F.pmod(F.col("cell") * F.lit(SPREAD) + F.col("part"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(False).alias("asks"), ids.alias("probe"), "v",
        F.array(F.col("cell") * F.lit(1 << 32) + F.col("part")).alias("places"))
    near = dealt.unionAll(there).repartition(buckets, "bucket").sortWithinPartitions("bucket", "asks").mapInArrow(_rerank(top + 1), "probe bigint, entry bigint, score double")
    best = Window.partitionBy("probe").orderBy("score", "entry")
    near = near.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= top + 1).drop("at")

    # back from entries to ids: an entry's smallest ids are enough for any result
    order = Window.partitionBy("v").orderBy("vec_id")
    members = rows.select("v", ids.alias("vec_id")).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= top + 1)
    members = stored(members.join(entries.select("v", ids.alias("entry")), "v").select("entry", "vec_id"))
    asked_by = queries.join(probes, "v").select("probe", "query_id")
    found = near.join(members, "entry").withColumn("at", F.row_number().over(Window.partitionBy("probe").orderBy("score", "vec_id"))) \
        .filter(F.col("at") <= top + 1).drop("at")
    found = asked_by.join(found, "probe").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= top)


def _by_bucket(cells: list[int], several: dict[int, int], buckets: int) -> list[dict]:
    """The parts of cells by the bucket they lie in."""
    found: dict[int, list[int]] = {}
    for cell in cells:
        for part in range(several.get(cell, 1)):
            found.setdefault((cell * SPREAD + part) % buckets, []).append((cell << 32) + part)
    return [{"bucket": bucket, "places": places} for bucket, places in found.items()]


def _rerank(keep: int):
    """Task: the entries of a bucket, then its probes one after another; for each the ``keep`` nearest of its places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, entries = None, [], None
        for batch in batches:
            buckets, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            change = np.flatnonzero((buckets[1:] != buckets[:-1]) | (asks[1:] != asks[:-1])) + 1
            for first, last in zip([0, *change], [*change, batch.num_rows]):
                if first == last:
                    continue
                rows = pa.Table.from_batches([batch.slice(first, last - first)])
                if bucket != buckets[first]:
                    bucket, held, entries = buckets[first], [], None
                if not asks[first]:
                    held.append(rows)
                    continue
                if entries is None:
                    entries, held = _entries(held), []
                if entries is not None:
                    yield from _nearest(entries, rows, keep)

    return run


def _entries(held: list[pa.Table]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(places, bounds, names, vectors) of a bucket, ordered by place."""
    if not held:
        return None
    table = pa.concat_tables(held).combine_chunks()
    place = table.column("places").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    name, v = table.column("probe").to_numpy(), _matrix(table.column("v").combine_chunks())
    order = np.lexsort((name, place))
    places, first = np.unique(place[order], return_index=True)
    return places, np.append(first, len(order)), name[order], v[order]


def _nearest(entries: tuple, probes: pa.Table, keep: int) -> Iterator[pa.RecordBatch]:
    places, bounds, name, v = entries
    asked = _matrix(probes.column("v").combine_chunks())
    wanted = probes.column("places").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    at = np.searchsorted(places, wanted.flatten().to_numpy(zero_copy_only=False))
    flat = wanted.flatten().to_numpy(zero_copy_only=False)
    there = (at < len(places)) & (places[np.minimum(at, len(places) - 1)] == flat)
    out: list[tuple] = []
    for k, probe in enumerate(probes.column("probe").to_pylist()):
        own = at[ends[k]: ends[k + 1]][there[ends[k]: ends[k + 1]]]
        if not len(own):
            continue
        some = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in own])
        score = np.sqrt(((v[some] - asked[k]) ** 2).sum(axis=1))
        if len(score) > 4 * keep:
            close = np.flatnonzero(score <= np.partition(score, keep - 1)[keep - 1])
            some, score = some[close], score[close]
        best = np.lexsort((name[some], score))[:keep]
        out.append((np.full(len(best), probe), name[some][best], score[best]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["probe", "entry", "score"])
