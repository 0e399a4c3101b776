"""Benchmark decontamination with a distributed positional inverted index.

The index holds every word of every document: its rows are segments of whole documents, and a segment lists, for each
word, the positions at which it stands.  It is written once to the shared folder and needs no exchange.  A search takes
the item windows; a segment that lacks a window's lead, the word fewest windows hold, passes it over; else the search
starts from the window's rarest word in the segment, shifts its positions by the word's offset, and keeps the starts
that the offset-adjusted lists of the next rarest words have too, until all words agree (phrase matches).  With ``slop`` every word, the rarest too, may stand up to that far from its place, inside one document
(proximity matches); all starts that allow this are given, moved into the document where they lie outside.

Windows are given to the tasks as broadcasts of at most ``block`` windows (about 60 bytes each).  A task opens one block
after another and lets go of each before the next, so what it holds does not grow with the item table.

Rows: NULL, empty and wordless texts have no words and never match; repeated rows are answered each; items without
words are skipped, repeated items count once for each item_id; item ids are compared as text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, bounded_batches, release_memory, slices, span_hashes, spans, stored, texts_of

WINDOW = 13
BLOCK = 200_000
SEGMENT_BYTES = 1 << 19
_WORD = np.zeros(256, bool)
_WORD[48:58], _WORD[97:123], _WORD[128:] = True, True, True


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, text) of every word of a run of texts: A-Z lower-cased, digits, letters and all above \x7F."""
    low = LOWER[data]
    starts, ends, text = spans(_WORD[low], bounds)
    return span_hashes(low, starts, ends), text


INDEX = "doc_ids binary, counts binary, terms binary, firsts binary, positions binary"


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index: one row per segment; doc_ids as a list column, numbers as packed arrays.

    counts: words of each document; terms: sorted word hashes; firsts: where a term's positions start; positions:
    ordinal of the word in the segment, sorted for each term.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, bounds in slices(texts_of(batch), SEGMENT_BYTES):
                hashes, text = words_of(data, bounds)
                order = np.argsort(hashes, kind="stable")
                terms, firsts = np.unique(hashes[order], return_index=True)
                counts = np.bincount(text, minlength=last - first)
                packed = [counts.astype(np.int32), terms, np.append(firsts, len(order)).astype(np.int32), order.astype(np.int32)]
                lists = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), ids.slice(first, last - first))
                yield pa.RecordBatch.from_arrays([lists, *[pa.array([x.tobytes()], pa.binary()) for x in packed]],
                                                 names=["doc_ids", "counts", "terms", "firsts", "positions"])
        release_memory()

    return stored(docs.select("doc_id", "text").mapInArrow(run, INDEX.replace("doc_ids binary", f"doc_ids array<{id_type}>")))


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(item, words): the distinct windows of each item as word hashes; an item of fewer words is one window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last, data, bounds in slices(texts_of(batch)):
                hashes, text = words_of(data, bounds)
                cut = np.searchsorted(text, np.arange(last - first + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    own = hashes[cut[k]: cut[k + 1]]
                    size = min(length, len(own))
                    seen = {own[s: s + size].tobytes() for s in range(len(own) - size + 1)}
                    yield pa.RecordBatch.from_arrays([pa.array([names[first + k]] * len(seen), pa.string()), pa.array(sorted(seen), pa.binary())],
                                                     names=["item", "words"])

    named = items.filter("item_id is not null and text is not null")
    return named.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, words binary").distinct()


class _Segment:
    """Positions by word of one index row."""

    def __init__(self, row: dict):
        self.counts = np.frombuffer(row["counts"], np.int32)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.firsts = np.frombuffer(row["firsts"], np.int32)
        self.positions = np.frombuffer(row["positions"], np.int32)
        self.ends = np.cumsum(self.counts, dtype=np.int64)

    def lists(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, length) of each word's list; length 0 if the segment lacks the word."""
        if not len(self.terms):
            return np.zeros(words.shape, np.int64), np.zeros(words.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return self.firsts[at], np.where(self.terms[at] == words, self.firsts[at + 1] - self.firsts[at], 0)

    def starts(self, first: np.ndarray, length: np.ndarray, slop: int) -> np.ndarray:
        """Where a window starts, given its words' lists: intersection from the rarest list on."""
        order = np.argsort(length, kind="stable")
        if slop:
            return self._near(first, length, slop, order)
        lead = order[0]
        found = self.positions[first[lead]: first[lead] + length[lead]].astype(np.int64) - lead
        for k in order[1:]:
            own = self.positions[first[k]: first[k] + length[k]]
            at = np.searchsorted(own, found + k)
            found = found[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == found + k)]
            if not len(found):
                return found
        size = len(length)
        found = found[found >= 0]
        text = np.searchsorted(self.ends, found, "right")
        return found[found + size <= np.append(self.ends, 0)[text]]  # inside one document

    def _near(self, first: np.ndarray, length: np.ndarray, slop: int, order: np.ndarray) -> np.ndarray:
        """The starts around which every word stands up to ``slop`` from its place, in the document of the rarest one."""
        places = self.positions[first[order[0]]: first[order[0]] + length[order[0]]].astype(np.int64)
        text = np.searchsorted(self.ends, places, "right")
        shifts = np.arange(-slop, slop + 1)
        found = (places[:, None] - order[0] + shifts).ravel()
        low, high = np.repeat(self.ends[text] - self.counts[text], len(shifts)), np.repeat(self.ends[text], len(shifts))
        for k in order[1:]:
            own = self.positions[first[k]: first[k] + length[k]]
            at = np.searchsorted(own, np.maximum(found + k - slop, low))
            fits = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= np.minimum(found + k + slop, high - 1))
            found, low, high = found[fits], low[fits], high[fits]
        fits = high - low >= len(length)
        return np.unique(np.clip(found[fits], low[fits], high[fits] - len(length)))


class _Windows:
    """Windows of one size: their items, distinct words, each window's words as numbers, and its lead.

    The lead is the word that fewest windows of the block hold; a segment without it is done with the window.
    """

    def __init__(self, items: np.ndarray, words: np.ndarray):
        self.items = items
        self.terms, places = np.unique(words, return_inverse=True)
        self.places = places.reshape(words.shape).astype(np.int32)
        held = np.bincount(self.places.ravel(), minlength=len(self.terms))
        self.lead = np.take_along_axis(self.places, np.argmin(held[self.places], axis=1)[:, None], axis=1)[:, 0]

    def candidates(self, length: np.ndarray) -> np.ndarray:
        """Windows of which a segment has every word, given the length of each word's list."""
        led = np.flatnonzero(length[self.lead] > 0)
        return led[length[self.places[led]].min(axis=1) > 0]


def _found(segment: _Segment, blocks: list[_Windows], slop: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(item number, starts, window size) of every window that occurs in the segment; a word is looked up once a block."""
    for own in blocks:
        first, length = segment.lists(own.terms)
        for k in own.candidates(length):
            starts = segment.starts(first[own.places[k]], length[own.places[k]], slop)
            if len(starts):
                yield int(own.items[k]), starts, own.places.shape[1]


def _blocks(spark, wanted: DataFrame, block: int) -> Iterator:
    """The windows as broadcasts of at most ``block`` windows: (item names, windows by size)."""
    held: list = []

    def packed():
        names = sorted({r["item"] for r in held})
        number = {name: k for k, name in enumerate(names)}
        by_size = []
        for size in sorted({len(r["words"]) for r in held}):
            own = [r for r in held if len(r["words"]) == size]
            by_size.append(_Windows(np.array([number[r["item"]] for r in own]), np.frombuffer(b"".join(r["words"] for r in own), np.uint64).reshape(-1, size // 8)))
        return spark.sparkContext.broadcast((names, by_size))

    for row in wanted.orderBy("item", "words").toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield packed()
            held = []
    if held:
        yield packed()


def occurrences(index: DataFrame, items: DataFrame, length: int = WINDOW, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """(doc_id, doc_row, item_id, start, size): exact (slop 0) or proximity occurrences; start counts words from 0."""
    spark, out = index.sparkSession, None
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, item_id string, start bigint, size int"
    for held in _blocks(spark, stored(windows(items, length)), block):
        part = index.mapInArrow(_locate(held, slop), schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def _locate(held, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, blocks = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("counts", "terms", "firsts", "positions")}
                segment, ids = _Segment(row), batch.column("doc_ids")[k].values
                for item, starts, size in _found(segment, blocks, slop):
                    text = np.searchsorted(segment.ends, starts, "right")
                    place = starts - (segment.ends[text] - segment.counts[text])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(text)), pa.array([names[item]] * len(text), pa.string()), pa.array(place), pa.array(np.full(len(text), size, np.int32))],
                        names=["doc_id", "item_id", "start", "size"])

    return run


def _report(helds: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("counts", "terms", "firsts", "positions")}
                segment, ids = _Segment(row), batch.column("doc_ids")[k].values
                edge = np.zeros(int(segment.counts.sum()) + 1, np.int32)
                seen: dict[int, set[str]] = {}
                for held in helds:
                    names, blocks = held.value
                    for item, starts, size in _found(segment, blocks, 0):
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + size, -1)
                        for text in np.unique(np.searchsorted(segment.ends, starts, "right")).tolist():
                            seen.setdefault(text, set()).add(names[item])
                    if len(helds) > 1:
                        held.__dict__.pop("_value", None)  # the worker's copy; it is read again when needed
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                hits = hit[segment.ends] - hit[segment.ends - segment.counts]
                lists = [sorted(seen.get(t, ())) for t in range(len(ids))]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(segment.counts.astype(np.int64)), pa.array(hits.astype(np.int64)), pa.array(lists, pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "n_hit", "items"])
        release_memory()

    return run


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated): one row per row of ``docs``, items sorted as text.

    A word inside any occurrence of a window is hit; a document is contaminated when 5 % of its words are.
    """
    index = build_index(docs)
    helds = list(_blocks(docs.sparkSession, stored(windows(items, length)), block))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = index.mapInArrow(_report(helds), f"doc_id {id_type}, n_words bigint, n_hit bigint, items array<string>")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept.  Rows are told apart by id and text, NULL ids included."""
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")), F.length("text"))
    found = contamination(docs.select(own.alias("doc_id"), "text"), items, **how)
    bad = stored(found.filter("contaminated").select(F.col("doc_id").alias("_row")).distinct())
    return docs.withColumn("_row", own).join(bad, "_row", "left_anti").select(*docs.columns)
