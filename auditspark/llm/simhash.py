"""SimHash near-duplicates: 64-bit fingerprints, linked by binary tries that are traversed against themselves.

Two fingerprints within ``budget`` differing bits agree on at least ``blocks - budget`` of ``blocks`` bit blocks.  For
every choice of that many blocks, fingerprints that agree on them form one trie, and the tries are what Spark deals
out.  Inside a trie node pairs are walked together, level by level; a pair is dropped when its differing bits exceed
the budget or when both nodes are already in one component.  Each task returns a spanning forest of what it found, so
a dense group never becomes all of its pairs.  A large trie is cut in parts and every pair of parts is walked.

Rows: a NULL or wordless text has fingerprint zero; repeated rows and ties link like others; NULL ids never become a
component's id unless all ids of it are NULL; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, release_memory, stored, texts_of
from .graph import components

SHINGLE = 4
BUDGET = 4
BLOCKS = 6


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number."""
    import xxhash
    words = text.lower().split()  # on bytes: A-Z only, split at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    lasts = (ends[shingle - 1:] - 1).tolist()
    firsts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(firsts, lasts)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k: k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``, fp as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            values = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])
        release_memory()

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _bounds(blocks: int) -> list[int]:
    return [round(64 * k / blocks) for k in range(blocks + 1)]


def _keys(fp: Column, budget: int, blocks: int) -> Column:
    """One key per choice of blocks: its number and the blocks' bits."""
    cut = _bounds(blocks)
    bits = [F.shiftrightunsigned(F.shiftleft(fp, cut[k]), 64 - cut[k + 1] + cut[k]) for k in range(blocks)]
    return F.array(*[F.struct(F.lit(n).alias("choice"), F.xxhash64(*[bits[k] for k in chosen]).alias("bits"))
                     for n, chosen in enumerate(combinations(range(blocks), blocks - budget))])


def _moved(fps: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The bits of ``fps`` rearranged: the given (first, end) ranges from the top."""
    out, room = np.zeros_like(fps), 64
    for first, end in order:
        room -= end - first
        piece = (fps << np.uint64(first)) >> np.uint64(64 - end + first)
        out |= piece << np.uint64(room)
    return out


class _Forest:
    """Components of the fingerprints of one slice, kept compressed."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.changes = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        if not apart.any():
            return
        a, b = self.label[a[apart]], self.label[b[apart]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        names = np.array(list(up), np.int64)
        self.label[names] = [root(int(x)) for x in names]
        self.label = self.label[self.label]
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def joined(self, la, ha, lb, hb) -> np.ndarray:
        """Node pairs whose leaves are all in one component already."""
        return ((self.changes[la] == self.changes[ha - 1]) & (self.changes[lb] == self.changes[hb - 1])
                & (self.label[la] == self.label[lb]))


def trie_links(keys: np.ndarray, roots: np.ndarray, budget: int, chunk: int = 1 << 16) -> np.ndarray:
    """Component label of each key after walking the root pairs.

    ``keys`` are sorted within each root; a node is a range of them, its children are the keys with a 0 and with a 1
    at the node's depth.  ``roots``: (first a, end a, first b, end b) rows; a pair of a node with itself is a self-join.
    """
    forest, zeros = _Forest(len(keys)), {}
    stack = [(0, np.column_stack([roots, np.zeros(len(roots), np.int64)]))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > chunk:
            stack += [(depth, half) for half in np.array_split(pairs, 2)]
            continue
        la, ha, lb, hb, spent = pairs.T
        same = la == lb
        leaf = (ha - la == 1) & (hb - lb == 1)
        check = leaf & ~same
        a, b = la[check], lb[check]
        near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
        forest.link(a[near], b[near])
        open_ = ~leaf & ~forest.joined(la, ha, lb, hb)
        if not open_.any():
            continue
        la, ha, lb, hb, spent, same = (x[open_] for x in (la, ha, lb, hb, spent, same))
        if depth not in zeros:
            zero = (keys >> np.uint64(63 - depth)) & np.uint64(1) == 0
            zeros[depth] = np.concatenate([[0], np.cumsum(zero, dtype=np.int32)]).astype(np.int32)
        z = zeros[depth]
        ma, mb = la + z[ha] - z[la], lb + z[hb] - z[lb]
        once = ~same
        below = np.concatenate([
            np.column_stack([la, ma, lb, mb, spent]), np.column_stack([ma, ha, mb, hb, spent]),
            np.column_stack([la, ma, mb, hb, spent + 1]), np.column_stack([ma, ha, lb, mb, spent + 1])[once]])
        keep = (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)
        keep &= ~((below[:, 0] == below[:, 2]) & (below[:, 1] - below[:, 0] == 1))
        if keep.any():
            stack.append((depth + 1, below[keep]))
    return forest.label


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """The columns of some whole groups at a time, about ``most`` rows or one group; rows of a group follow each other."""
    held, rows, enough = [], 0, most
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        columns = [whole.column(k).to_numpy() for k in range(6)]
        last = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns[:4]], axis=0))
        if len(last):
            cut = int(last[-1]) + 1
            yield tuple(x[:cut] for x in columns)
            held = whole.slice(cut).to_batches()
        else:
            held = whole.to_batches()
        rows = sum(x.num_rows for x in held)
        enough = max(most, 2 * rows)
    if rows:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield tuple(whole.column(k).to_numpy() for k in range(6))


def _walk(budget: int, blocks: int, most: int = 50_000):
    """Task: rows (choice, bits, i, j, side, fp), groups in order; emits links (a, b) that span what is near.

    A task holds about ``most`` rows or one group at a time, whatever the size of its partition.
    """
    cut = _bounds(blocks)
    chosen = list(combinations(range(blocks), blocks - budget))
    orders = [[(cut[k], cut[k + 1]) for k in (*c, *(k for k in range(blocks) if k not in c))] for c in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for choice, bits, i, j, side, fp in _groups(batches, most):
            fp = fp.view(np.uint64)
            moved = np.empty_like(fp)
            for n, order in enumerate(orders):
                moved[choice == n] = _moved(fp[choice == n], order)
            order = np.lexsort((moved, side, j, i, bits, choice))
            choice, bits, i, j, side, fp, moved = (x[order] for x in (choice, bits, i, j, side, fp, moved))
            lows = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (choice, bits, i, j)], axis=0)]))
            highs = np.append(lows[1:], len(fp))
            sums = np.concatenate([[0], np.cumsum(side == 0)])
            middle = lows + sums[highs] - sums[lows]
            alone = i[lows] == j[lows]
            roots = np.column_stack([lows, np.where(alone, highs, middle), np.where(alone, lows, middle), highs])
            roots = roots[(roots[:, 0] < roots[:, 1]) & (roots[:, 2] < roots[:, 3]) & (highs - lows > 1)]
            label = trie_links(moved, roots, budget)
            linked = np.flatnonzero(label != np.arange(len(label)))
            values = fp.view(np.int64)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[label[linked]])], names=["a", "b"])
        release_memory()

    return run


def links(values: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that keep every component of the near pairs."""
    keyed = values.select(F.explode(_keys(F.col("fp"), budget, blocks)).alias("key"), "fp").select("key.*", "fp")
    large = stored(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n"))
                   .withColumn("parts", F.ceil(F.col("n") / (512 + 16 * F.sqrt("n"))).cast("int")).filter("parts > 1").drop("n"))
    dealt = (keyed.join(large, ["choice", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "fp"))
    group = ["choice", "bits", "i", "j"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_walk(budget, blocks), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id, class_size, root): component_id is the smallest doc_id reachable over near links.

    root is the component's least fingerprint; class_size counts the rows with the same fingerprint.
    """
    marked = stored(fingerprints(docs, shingle))
    values = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size")))
    roots = components(links(values.select("fp"), budget, blocks))
    placed = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(placed.join(named, "root").select("fp", "component_id", "class_size", "root"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "class_size", "root")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of each near-duplicate group, all columns kept: the row of its smallest id.

    Where several rows share that id, the one with the least text stays.  A group without any id keeps its least text.
    Ids of one row, the usual ones, only need the ids that go; rows without an own id are placed by their text.
    """
    found = stored(near_duplicates(docs, **how))
    ids = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    gone = stored(ids.filter("n = 1 and doc_id <> component_id").select("doc_id"))
    shared = stored(ids.filter("n > 1").select("doc_id"))
    plain = docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti").join(shared, "doc_id", "left_anti").select(*docs.columns)
    odd = docs.filter("doc_id is null").unionAll(docs.join(shared, "doc_id", "left_semi").select(*docs.columns))
    odd = odd.withColumn("_text", F.coalesce("text", F.lit("")))
    marks = fingerprints(odd.select(F.col("_text").alias("doc_id"), "text"), how.get("shingle", SHINGLE)).distinct()
    marks = marks.select(F.col("doc_id").alias("_text"), F.col("fp").alias("_fp"))
    roots = found.select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), F.col("component_id").alias("_least")).distinct()
    rank = F.row_number().over(Window.partitionBy("_root").orderBy("_text"))
    odd = odd.join(marks, "_text").join(roots, "_fp").filter(F.col("doc_id").eqNullSafe(F.col("_least")))
    odd = odd.withColumn("_rank", rank).filter("_rank = 1")
    return plain.unionAll(odd.select(*docs.columns))
