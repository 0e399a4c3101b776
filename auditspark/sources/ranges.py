"""Large files cut into records by many tasks.

Spark's text reader splits a file at a byte that every record has (``}`` for JSON, a line feed for CSV) and gives each
task the pieces of its range in order.  What a range does to the reader's state does not depend on what comes before it,
up to one bit: whether it begins inside a string.  So every range is summed up twice, as if it began outside and as if it
began inside; a JSON sum is (ends inside, brackets it closes, brackets it leaves open with the member they belong to), and
sums of neighbours compose.  Composing them along a file gives each range the state it begins in.  A second scan then cuts
the elements of ``[...]``, ``{"Records": [...]}`` and ``{"Events": [...]}`` where they lie.  What is left of a top-level
value without its elements, and elements that span ranges, are put together from the few pieces at the range ends and read
by the plain reader.  No task holds more than a block, a record and what surrounds the lists.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint

BLOCK_BYTES = 1 << 20
#: How far a member's name may stand before its list.
NEAR = 1 << 12
LISTS = (b"Records", b"Events")
_OPEN, _CLOSE, _QUOTE, _BACK, _COMMA = b"{[", b"}]", 34, 92, 44
_STEP = np.zeros(256, np.int8)
_STEP[list(_OPEN)], _STEP[list(_CLOSE)] = 1, -1
_BLANK = b" \r\n\t"
_BOM = b"\xef\xbb\xbf"

#: What a scan gives: a whole piece, or the part of one that a range holds.
CUT = "source string, start bigint, place bigint, kind string, begins boolean, ends boolean, text binary"
_CUT_NAMES = [f.split()[0] for f in CUT.split(", ")]
_CUT_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.binary())


# --- what a piece of JSON does to the state -------------------------------------------

def _quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that begin or end a string, which an even run of backslashes stands before."""
    quotes = np.flatnonzero(data == _QUOTE)
    behind = np.flatnonzero((data[quotes - 1] == _BACK) & (quotes > 0))
    if len(behind):
        back = np.flatnonzero(data == _BACK)
        first = back[np.concatenate([[True], np.diff(back) > 1])]  # of each run
        run = quotes[behind] - first[np.searchsorted(first, quotes[behind]) - 1]
        quotes = np.delete(quotes, behind[run % 2 == 1])
    return quotes


def _outside(places: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    """Those of the places that lie outside strings, in data that begins inside one or not."""
    return places[np.searchsorted(quotes, places) % 2 == int(inside)]


def _marked(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, the places of the quotes, and those of the brackets inside and outside strings."""
    data = np.frombuffer(text, np.uint8)
    return data, _quotes(data), np.flatnonzero(_STEP[data])


def _member(text: bytes, at: int) -> bytes | None:
    """Name of the member whose value begins at ``at``."""
    before = text[max(0, at - NEAR): at].rstrip(_BLANK)
    name = before[:-1].rstrip(_BLANK)
    first = name.rfind(b'"', 0, -1)
    if not before.endswith(b":") or not name.endswith(b'"') or first < 0 or name[first - 1: first] == b"\\":
        return None
    try:
        return json.loads(name[first:]).encode()
    except ValueError:
        return None


def summed_json(text: bytes, inside: bool, marked: tuple | None = None) -> tuple[bool, int, list]:
    """(ends inside, brackets closed, brackets left open as (bracket, member))."""
    data, quotes, brackets = marked or _marked(text)
    places, ends = _outside(brackets, quotes, inside), bool(len(quotes) % 2) != inside
    if not len(places):
        return ends, 0, []
    depth = np.cumsum(_STEP[data[places]], dtype=np.int64)
    lowest = min(0, int(depth.min()))
    left = []
    for level in range(lowest + 1, int(depth[-1]) + 1):
        below = np.flatnonzero(depth == level - 1)
        opener = int(places[below[-1] + 1 if len(below) else 0])
        left.append((chr(text[opener]), (_member(text, opener) or b"").decode("utf-8", "replace")))
    return ends, -lowest, left


def composed(first: tuple, second: tuple) -> tuple:
    """The sum of two neighbours; ``second`` is the one for the state that ``first`` ends in."""
    kept = len(first[2]) - second[1]
    return second[0], first[1] + max(0, -kept), [*first[2][:max(0, kept)], *second[2]]


def both_json(text: bytes) -> list[tuple]:
    """The sums for both states, of marks found once."""
    marked = _marked(text)
    return [summed_json(text, inside, marked) for inside in (False, True)]


def both_csv(text: bytes) -> list[tuple]:
    return [summed_csv(text, inside) for inside in (False, True)]


def summed_csv(text: bytes, inside: bool) -> tuple[bool, int, list]:
    for line in text.split(b"\n"):
        inside = _after_line(line, inside)
    return inside, 0, []


def _after_line(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open after a line; a quote opens one only where a field begins."""
    if b'"' not in line:
        return inside
    at, begins = 0, not inside
    while True:
        if inside:
            quote = line.find(b'"', at)
            if quote < 0:
                return True
            at, inside = quote + 1, line[quote + 1: quote + 2] == b'"'
            if inside:
                at += 1
            begins = False
        elif begins and line[at: at + 1] == b'"':
            at, inside = at + 1, True
        else:
            field = line.find(b',"', at)
            if field < 0:
                return False
            at, inside = field + 2, True


# --- pieces of a range -----------------------------------------------------------------

def _blocks(separator: bytes, source_type: pa.DataType = pa.string()) -> Callable:
    """Task: the pieces of each range joined again into blocks that end with a separator."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, count = None, [], 0, 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, count, b"".join(held)), (source_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                              names=["source", "start", "size", "block", "text"])

        for batch in batches:
            if not batch.num_rows:
                continue
            pieces, sources, starts, sizes = batch.columns
            other = pc.or_(pc.not_equal(starts[1:], starts[:-1]), pc.not_equal(sources[1:], sources[:-1]))
            edges = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            upto = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 1)  # bytes with separators
            texts = pieces.to_pylist()
            for at, end in zip(edges, edges[1:]):  # the pieces of one range
                own = (sources[at].as_py(), starts[at].as_py(), sizes[at].as_py())
                while at < end:
                    if own != key or size >= BLOCK_BYTES:
                        if held:
                            yield block()
                        key, held, size, count = own, [], 0, count + 1 if own == key else 0
                    before = int(upto[at - 1]) if at else 0
                    # as many pieces as fill the block
                    to = min(end, int(np.searchsorted(upto, before + BLOCK_BYTES - size)) + 1)
                    held.append(separator.join(texts[at:to]) + separator)
                    size, at = size + int(upto[to - 1]) - before, to
        if held:
            yield block()

    return run


def _read(spark: SparkSession, paths: list[str], separator: str, hashed: bool = False) -> DataFrame:
    pieces, source = spark.read.option("lineSep", separator).text(paths), F.col("_metadata.file_path")
    return pieces.select(F.col("value").cast("binary").alias("value"), (F.xxhash64(source) if hashed else source).alias("source"),
                         F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))


def blocks_of(spark: SparkSession, paths: list[str], separator: str, hashed: bool = False) -> DataFrame:
    """(source, start, size, block, text): the bytes of each range in order; the last block of a file may have a separator too many.

    A path is often longer than a piece; ``hashed`` gives its hash instead.
    """
    cut = _blocks(separator.encode(), pa.int64() if hashed else pa.string())
    return _read(spark, paths, separator, hashed).mapInArrow(cut, f"source {'bigint' if hashed else 'string'}, start bigint, size bigint, block bigint, text binary")


def _told_apart(states: DataFrame) -> bool:
    """Whether the hashes of the paths tell the files apart."""
    return states.agg(F.count_distinct("source") == F.count_distinct(F.xxhash64("source"))).first()[0]


def _head(text: bytes) -> bytes:
    """First row of a CSV file."""
    at, inside = 0, False
    for line in text.split(b"\n"):
        inside, at = _after_line(line, inside), at + len(line) + 1
        if not inside:
            break
    return text[:at]


def _sums(summed: Callable, separator: bytes) -> Callable:
    """Task: both sums of each range and its length; of the first range of a file, how it begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, both, length, head = None, None, 0, b""

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, length, json.dumps(both), head), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                                              names=["source", "start", "size", "length", "sums", "head"])

        for block in _blocks(separator)(batches):
            for source, start, size, _, text in zip(*(column.to_pylist() for column in block.columns)):
                new = summed(text)
                if (source, start, size) == key:
                    both, length = [composed(s, new[s[0]]) for s in both], length + len(text)
                else:
                    if key is not None:
                        yield row()
                    key, both, length = (source, start, size), new, len(text)
                    head = b"" if start or summed is not both_csv else _head(text.removeprefix(_BOM))
        if key is not None:
            yield row()

    return run


_STATE = "source string, start bigint, inside boolean, open string, surplus int, head binary, error string"


def _states(frame: pd.DataFrame) -> pd.DataFrame:
    """The state in which each range of one file begins; a row per range."""
    frame = frame.sort_values("start")
    # the reader drops a byte order mark, and ends the last piece with a separator that may not be in the file
    surplus = int(int(frame["length"].sum() - frame["size"].iloc[0]) in (1, 1 - len(_BOM)))
    state, out, error = (False, 0, []), [], None
    for source, start, sums in zip(frame["source"], frame["start"], frame["sums"]):
        out.append((source, start, bool(state[0]), json.dumps(state[2]), 0, frame["head"].iloc[0]))
        if state[1]:
            error = "a bracket is closed that was not opened"
        ends, closed, left = json.loads(sums)[int(state[0])]
        state = composed(state, (ends, closed, [tuple(p) for p in left]))
    out[-1] = (*out[-1][:4], surplus, out[-1][5])
    # a separator that the reader added closes nothing
    spare = 1 if surplus and frame["separator"].iloc[0] == "}" else 0
    if error is None and (state[0] or state[2] or state[1] < spare):
        error = "the file ends inside a value"
    elif error is None and state[1] > spare:
        error = "a bracket is closed that was not opened"
    return pd.DataFrame([(*row, error) for row in out], columns=["source", "start", "inside", "open", "surplus", "head", "error"])


# --- cutting ----------------------------------------------------------------------------

class JsonCutter:
    """Cuts the blocks of one range, which begins in a known state."""

    def __init__(self, inside: bool, left: list, head: bytes, first: bool) -> None:
        self.inside, self.stack, self.first = inside, [tuple(p) for p in left[:2]], first
        self.depth = len(left)
        self.rest: list[bytes] = []  # of the top-level value, without elements
        self.element: list[bytes] = []
        self.rest_begins = self.depth == 0
        self.element_begins = False
        #: Whether the list that is being cut has shown an element; before the range it has.
        self.listed = True
        self.in_list = self._list_level()

    def _list_level(self) -> int:
        """Depth inside the list that is being cut, or 0."""
        if self.depth >= 1 and self.stack[0][0] == "[":
            return 1
        return 2 if self.depth >= 2 and self.stack[1][0] == "[" and self.stack[1][1].encode() in LISTS else 0

    def _kind(self) -> str:
        return "Events" if self.in_list == 2 and self.stack[1][1] == "Events" else "element"

    def cut(self, text: bytes) -> Iterator[tuple[str, bool, bool, bytes]]:
        """(kind, begins here, ends here, text) of what is complete."""
        if self.first:
            text, self.first = text.removeprefix(_BOM), False
        data, quotes, places = _marked(text)
        places = _outside(places, quotes, self.inside)
        depth = self.depth + np.cumsum(_STEP[data[places]], dtype=np.int64)
        low = np.flatnonzero(depth <= 2)
        commas = np.flatnonzero(data == _COMMA)
        at_depth = np.concatenate([[self.depth], depth])
        commas = commas[at_depth[np.searchsorted(places, commas)] <= 2]  # those between elements are that low
        commas = _outside(commas, quotes, self.inside)
        before = at_depth[np.searchsorted(places, commas)]  # depth at each comma
        self.inside = bool(len(quotes) % 2) != self.inside
        last_depth = int(depth[-1]) if len(depth) else self.depth
        at = 0
        while at < len(text):
            if self.in_list:
                ends = low[(depth[low] == self.in_list - 1) & (places[low] >= at)][:1]
                end = int(places[ends[0]]) if len(ends) else len(text)
                for mark in commas[(before == self.in_list) & (commas >= at) & (commas < end)].tolist():
                    yield self._element(text[at:mark])
                    at, self.element_begins = mark + 1, True
                if not len(ends):
                    self.element.append(text[at:])
                    break
                if self.listed or self.element or text[at:end].strip(_BLANK):
                    yield self._element(text[at:end])
                self.depth, self.in_list, at = self.in_list, 0, end
                self.stack = self.stack[: self.depth]
                continue
            k = int(np.searchsorted(places, at))
            some = low[low >= k]
            stops = some[(depth[some] == 0) | (data[places[some]] == ord("["))]
            last = int(stops[0]) if len(stops) else len(places) - 1
            self._track(text, data, places[k: last + 1], depth[k: last + 1])
            if not len(stops):
                self.rest.append(text[at:])
                break
            place = int(places[last])
            self.rest.append(text[at: place + 1])
            at = place + 1
            if self.depth == 0:
                yield "value", self.rest_begins, True, b"".join(self.rest)
                self.rest, self.rest_begins = [], True
            elif data[place] == ord("[") and (level := self._list_level()):
                self.in_list, self.element, self.element_begins, self.listed = level, [], True, False
        self.depth = last_depth

    def _element(self, last: bytes) -> tuple[str, bool, bool, bytes]:
        out = (self._kind(), self.element_begins, True, b"".join([*self.element, last]))
        self.element, self.listed = [], True
        return out

    def _track(self, text: bytes, data: np.ndarray, places: np.ndarray, depth: np.ndarray) -> None:
        """The depth and the two lowest open brackets after the given ones."""
        for place, level in zip(places[depth <= 2].tolist(), depth[depth <= 2].tolist()):
            opens = data[place] in _OPEN
            self.stack = self.stack[: level - 1 if opens else level]
            if opens:
                self.stack.append((chr(data[place]), (_member(text, place) or b"").decode("utf-8", "replace") if level == 2 else ""))
        if len(depth):
            self.depth = int(depth[-1])

    def left(self) -> Iterator[tuple[str, bool, bool, bytes]]:
        """What the range holds of pieces that go on behind it."""
        if self.in_list:
            yield self._kind(), self.element_begins, False, b"".join(self.element)
        if self.rest or not self.rest_begins:
            yield "value", self.rest_begins, False, b"".join(self.rest)


class CsvCutter:
    """Cuts the rows of one range; the header stands before each."""

    def __init__(self, inside: bool, left: list, head: bytes, first: bool) -> None:
        self.inside, self.head, self.first, self.begins = inside, head, first, not inside
        self.row: list[bytes] = []

    def cut(self, text: bytes) -> Iterator[tuple[str, bool, bool, bytes]]:
        if self.first:
            text, self.first = text.removeprefix(_BOM)[len(self.head):], False
        lines = text.split(b"\n")
        for line in [x + b"\n" for x in lines[:-1]] + [x for x in lines[-1:] if x]:
            if not self.row and self.begins:
                self.row.append(self.head)
            self.row.append(line)
            self.inside = _after_line(line.removesuffix(b"\n"), self.inside)
            if not self.inside:
                yield "row", self.begins, True, b"".join(self.row)
                self.row, self.begins = [], True

    def left(self) -> Iterator[tuple[str, bool, bool, bytes]]:
        if self.row or not self.begins:
            yield "row", self.begins, False, b"".join(self.row)


def _as_cuts(rows: Iterable[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(column), type=t) for column, t in zip(zip(*rows), _CUT_TYPES)], names=_CUT_NAMES)


def _cuts(cutter: Callable, whole: bool, made: Callable) -> Callable:
    """Task: whole pieces of the ranges, or the parts of pieces that span ranges, numbered in their order; ``made`` makes batches of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cut, place, rows, size, held, surplus = None, None, 0, [], 0, b"", 0

        def put(found) -> None:
            nonlocal place, size
            for kind, begins, ends, text in found:
                if (begins and ends) == whole:
                    rows.append((*key, place, kind, begins, ends, text))
                    size += len(text)
                place += 1

        def given() -> pa.RecordBatch:
            nonlocal rows, size
            out, rows, size = made(rows), [], 0
            return out

        def finish() -> None:
            if key is not None:
                put(cut.cut(held[:-1] if surplus else held))
                put(cut.left())

        for batch in batches:
            for source, start, text, inside, left, more, head in zip(*(batch.column(c).to_pylist() for c in ("source", "start", "text", "inside", "open", "surplus", "head"))):
                if (source, start) != key:
                    finish()
                    key, cut, place, surplus = (source, start), cutter(inside, json.loads(left), head, start == 0), 0, more
                else:
                    put(cut.cut(held))
                held = text  # the last block of a range may end with a separator too many
                if size >= BLOCK_BYTES:
                    yield given()
        finish()
        if rows:
            yield given()

    return run


def _joined(parts: DataFrame) -> DataFrame:
    """Parts of pieces put together: a few rows per range."""
    group = (F.col("kind") == "value").alias("rest")
    order = Window.partitionBy("source", "rest").orderBy("start", "place")
    numbered = parts.withColumn("rest", group).withColumn("piece", F.sum(F.col("begins").cast("int")).over(order))
    texts = F.sort_array(F.collect_list(F.struct("start", "place", "text")))
    whole = numbered.groupBy("source", "rest", "piece").agg(F.min(F.struct("start", "place", "kind")).alias("first"), texts.alias("texts"))
    text = F.unhex(F.array_join(F.transform("texts", lambda t: F.hex(t["text"])), ""))
    return whole.select("source", "first.start", "first.place", "first.kind", text.alias("text"))


def pieces_of(spark: SparkSession, paths: list[str], csv: bool, made: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): what ``made`` makes of whole pieces of the files, and (source, start, error) of broken ones.

    ``made`` gets rows of CUT and gives a batch of ``schema``; it runs where the pieces are cut.  Kinds: ``element`` of a
    list of records, ``Events`` of a list of wrapped ones, ``value`` for what else a top-level value holds, ``row`` for a
    row of a CSV file behind its header.  The files are scanned once for the states and once each for the pieces that lie
    in a range and those at its ends.  The states, a row per range, are told to all tasks, so the text stays where it is read.
    """
    separator, cutter = "\n" if csv else "}", CsvCutter if csv else JsonCutter
    sums = _read(spark, paths, separator).mapInArrow(_sums(both_csv if csv else both_json, separator.encode()),
                                                     "source string, start bigint, size bigint, length bigint, sums string, head binary")
    states = checkpoint(sums.withColumn("separator", F.lit(separator)).groupBy("source").applyInPandas(_states, _STATE))  # a row per range
    hashed, told = _told_apart(states), F.broadcast(states.filter("error IS NULL").drop("error"))
    blocks = blocks_of(spark, paths, separator, hashed).withColumnRenamed("source", "file").withColumnRenamed("start", "place")
    known = blocks.join(told, (F.col("file") == (F.xxhash64("source") if hashed else F.col("source"))) & (F.col("place") == F.col("start"))) \
        .select("source", "start", "text", "inside", "open", "surplus", "head")
    whole = known.mapInArrow(_cuts(cutter, True, made), schema)
    joined = _joined(known.mapInArrow(_cuts(cutter, False, _as_cuts), CUT)).select("source", "start", "place", "kind", F.lit(True).alias("begins"), F.lit(True).alias("ends"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield made(list(zip(*(column.to_pylist() for column in batch.columns))))

    return whole.unionByName(joined.mapInArrow(rows, schema)), states.filter("error IS NOT NULL").groupBy("source").agg(F.max("start").alias("start"), F.first("error").alias("error"))
