"""Audit exports to records: raw, original, source, ordinal, format, lossy, error.

Line-oriented files are read as splittable text.  Other small files are streamed by
a task each, large ones read by ranges (``ranges``); both are cut into exact text
slices, so spellings like 1.10 or 1e400 survive.  A broken file yields a row with ``error``; the
import then publishes nothing.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .ranges import pieces_of

RECORD_SCHEMA = T.StructType([
    T.StructField("raw", T.StringType()), T.StructField("original", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("ordinal", T.LongType()), T.StructField("format", T.StringType()), T.StructField("lossy", T.BooleanType()),
    T.StructField("error", T.StringType()),
])
_NAMES = RECORD_SCHEMA.fieldNames()
_ARROW_TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string())
#: Files up to this size are read by one task.
WHOLE_BYTES = 32 << 20
#: Text that is unpacked and decoded at a time.
BLOCK_CHARS = 1 << 20
EXTENSIONS = "*.{json,jsonl,ndjson,csv,gz}"

# Accepted console CSV headers per record field.
CSV_FIELDS = {
    "eventID": ("event id", "eventid"), "eventTime": ("event time", "eventtime"), "eventName": ("event name", "eventname"),
    "eventSource": ("event source", "eventsource"), "awsRegion": ("aws region", "awsregion", "region"),
    "sourceIPAddress": ("source ip address", "sourceipaddress", "source ip"), "errorCode": ("error code", "errorcode"),
    "recipientAccountId": ("recipient account id", "recipientaccountid"),
}
CSV_IDENTITY = {"userName": ("user name", "username"), "arn": ("arn", "user arn")}
_BLANK = " \r\n\t"


def _scan(text: str, at: int) -> tuple[object, int]:
    """Value at ``at`` and the offset behind it; made per call, since a decoder cannot travel to the workers."""
    return json.JSONDecoder().raw_decode(text, at)


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in _BLANK:
        at += 1
    return at


def _expect(text: str, at: int, char: str) -> int:
    at = _skip(text, at)
    if text[at:at + 1] != char:
        raise ValueError(f"expected {char!r} at offset {at}")
    return at + 1


def _next_member(text: str, at: int) -> int:
    """Offset of the next member's name, or of the closing brace; a comma must be followed by a name."""
    if text[at:at + 1] == ",":
        at = _skip(text, at + 1)
        if text[at:at + 1] == '"':
            return at
    elif text[at:at + 1] == "}":
        return at
    raise ValueError(f"neither a member nor a brace at offset {at}")


class _Window:
    """A text that comes in blocks, of which no more is held than the value that is being read and a block.

    ``at`` is the place reached in the held text, ``kept`` the place from which it is still wanted.
    """

    def __init__(self, blocks: Iterator[str]) -> None:
        self.blocks, self.decoder = blocks, json.JSONDecoder()
        self.text, self.at, self.kept = "", 0, None
        #: What was given up before the held text: characters, line feeds, characters behind the last line feed.
        self.gone, self.lines, self.column = 0, 0, 0

    def more(self) -> bool:
        """Hold at least twice as much of what is wanted; False at the end of the text."""
        new = next(self.blocks, "")
        if not new:
            return False
        first = self.at if self.kept is None else self.kept
        left, feed = self.text[:first], self.text.rfind("\n", 0, first)
        self.column = self.column + first if feed < 0 else first - feed - 1
        self.gone, self.lines = self.gone + first, self.lines + left.count("\n")
        added, size = [new], len(new)
        while size < len(self.text) - first and (new := next(self.blocks, "")):
            added.append(new)
            size += len(new)
        self.text, self.at = "".join([self.text[first:], *added]), self.at - first
        self.kept = None if self.kept is None else 0
        return True

    def offset(self) -> int:
        return self.gone + self.at

    def skip(self) -> str:
        """The next character that is no blank, '' at the end."""
        while True:
            self.at = _skip(self.text, self.at)
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def expect(self, char: str) -> None:
        if self.skip() != char:
            raise ValueError(f"expected {char!r} at offset {self.offset()}")
        self.at += 1

    def scan(self) -> object:
        """The value at ``at``, which goes behind it."""
        while True:
            try:
                value, end = self.decoder.raw_decode(self.text, self.at)
                # at the end of the held text a number may go on, by up to three characters that alone mean nothing
                if len(self.text) - end > 3 or not self.more():
                    self.at = end
                    return value
            except json.JSONDecodeError as error:
                cut = error.msg.startswith("Unterminated string") or len(self.text) - error.pos < 16  # a word, an escape
                if not cut or not self.more():
                    raise ValueError(self._told(error)) from None

    def _told(self, error: json.JSONDecodeError) -> str:
        """The decoder's message with the places in the whole text."""
        column = error.colno if error.lineno > 1 else error.colno + self.column
        return f"{error.msg}: line {error.lineno + self.lines} column {column} (char {error.pos + self.gone})"

    def next_member(self) -> None:
        """To the next member's name, or to the closing brace; a comma must be followed by a name."""
        char = self.skip()
        if char == ",":
            self.at += 1
            if self.skip() == '"':
                return
        elif char == "}":
            return
        raise ValueError(f"neither a member nor a brace at offset {self.offset()}")

    def elements(self) -> Iterator[str]:
        """Exact text of the elements of the array at ``at``; it goes behind it."""
        self.expect("[")
        if self.skip() != "]":
            while True:
                self.skip()
                self.kept = self.at
                self.scan()
                piece, self.kept = self.text[self.kept:self.at], None
                yield piece
                if self.skip() != ",":
                    break
                self.at += 1
        self.expect("]")


def _unwrap(element: str) -> str:
    event = json.loads(element)
    inner = event.get("CloudTrailEvent") if isinstance(event, dict) else None
    if not isinstance(inner, str) or not inner:
        raise ValueError("an event of a history export carries no record")
    return inner


def json_records(blocks: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(raw, format) of every record in a sequence of JSON values, the text of which comes in blocks."""
    window = _Window(blocks)
    while first := window.skip():
        if first == "[":
            for piece in window.elements():
                yield piece, "cloudtrail-json"
        elif first == "{":
            wrapped, window.kept = False, window.at
            window.at += 1
            while window.skip() != "}":
                name = window.scan()
                window.expect(":")
                window.skip()
                if name in ("Records", "Events"):
                    if wrapped:
                        raise ValueError("an object lists records twice")
                    wrapped, window.kept = True, None
                    for piece in window.elements():
                        yield (piece, "cloudtrail-json") if name == "Records" else (_unwrap(piece), "event-history-json")
                else:
                    window.scan()
                window.next_member()
            window.at += 1
            if not wrapped:
                raw, window.kept = window.text[window.kept:window.at], None
                yield raw, "cloudtrail-json"
        else:
            raise ValueError(f"no JSON value at offset {window.offset()}")


def csv_records(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(raw, original) of every console CSV row; the original is header plus row text."""
    taken: list[str] = []

    def noted():
        for line in lines:
            taken.append(line)
            yield line

    rows = csv.reader(noted(), strict=True)
    header = next(rows, None) or []
    head = "".join(taken)
    taken.clear()
    index = {name.strip().lower(): i for i, name in enumerate(header)}
    if not {"event name", "eventname"} & set(index):
        raise ValueError("no column of the header names the event")
    for row in rows:
        if not row:
            continue
        if len(row) != len(header):
            raise ValueError(f"a row of {len(row)} fields under a header of {len(header)}")
        pick = lambda names: next((row[index[n]].strip() for n in names if n in index), "")
        record = {k: v for k, v in ((k, pick(names)) for k, names in CSV_FIELDS.items()) if v}
        identity = {k: v for k, v in ((k, pick(names)) for k, names in CSV_IDENTITY.items()) if v}
        if identity:
            record["userIdentity"] = identity
        yield json.dumps(record, ensure_ascii=False, separators=(",", ":")), head + "".join(taken)
        taken.clear()


def _opened(content: bytes | pa.Buffer) -> io.TextIOWrapper:
    """Text of a file, unpacked and decoded as it is read."""
    stream = pa.BufferReader(content)
    packed = stream.read(2) == b"\x1f\x8b"
    stream.seek(0)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=stream) if packed else stream, encoding="utf-8-sig", newline="")


def _blocks(content: bytes | pa.Buffer) -> Iterator[str]:
    text = _opened(content)
    return iter(lambda: text.read(BLOCK_CHARS), "")


def split_content(content: bytes | pa.Buffer, source: str) -> Iterator[tuple]:
    """Records of one file; a problem becomes one error row.

    The file is read once before, so that one which cannot be unpacked or decoded gives no record, and then as a stream:
    besides the content as stored, a block of its text and the record being read are held.
    """
    ordinal = 0
    try:
        for _ in _blocks(content):
            pass
        first = _Window(_blocks(content)).skip()
        if first in ("{", "["):
            records = ((raw, raw, form, False) for raw, form in json_records(_blocks(content)))
        elif first:
            records = ((raw, original, "event-history-csv", True) for raw, original in csv_records(_opened(content)))
        else:
            raise ValueError("empty input")
        for raw, original, form, lossy in records:
            ordinal += 1
            yield raw, original, source, ordinal, form, lossy, None
        if not ordinal:
            raise ValueError("no audit events found")
    except (ValueError, RecursionError, OSError, EOFError, csv.Error) as error:
        yield None, None, source, ordinal + 1, None, None, f"after {ordinal} record(s): {error}"


def _split_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for files in batches:
        rows, size = [], 0
        for path, content in zip(files.column("path"), files.column("content")):
            for row in split_content(content.as_buffer(), path.as_py()):
                rows.append(row)
                size += 2 * len(row[0] or "")
                if len(rows) == 5000 or size >= 8 * BLOCK_CHARS:
                    yield _record_batch(rows)
                    rows, size = [], 0
        if rows:
            yield _record_batch(rows)


def _record_batch(rows: list[tuple], left_out: tuple[str, ...] = ()) -> pa.RecordBatch:
    columns = {n: pa.array(list(column), type=t) for n, t, column in zip(_NAMES, _ARROW_TYPES, zip(*rows) if rows else [()] * len(_NAMES)) if n not in left_out}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _piece_records(pieces: Iterable[tuple]) -> list[tuple]:
    """Records of pieces of large files; a value without its lists is read as if it were a file."""
    rows, decoder = [], json.JSONDecoder()
    for source, start, place, kind, _, _, text in pieces:
        at = start + place
        try:
            text = text.decode("utf-8")
            if kind == "value":
                rows += [(raw, raw, source, at, form, False, None) for raw, form in json_records(iter((text,)))]
            elif kind == "row":
                rows += [(raw, original, source, at, "event-history-csv", True, None) for raw, original in csv_records(io.StringIO(text, newline=""))]
            else:
                raw = text.strip(_BLANK)
                if decoder.raw_decode(raw, 0)[1] != len(raw):
                    raise ValueError("text behind an element")
                form = "cloudtrail-json" if kind == "element" else "event-history-json"
                raw = raw if kind == "element" else _unwrap(raw)
                rows.append((raw, raw, source, at, form, False, None))
        except (ValueError, RecursionError, csv.Error) as error:
            rows.append((None, None, source, at, None, None, f"near byte {start}: {error}"))
    return rows


def _split_large(spark: SparkSession, paths: list[str], as_csv: bool) -> DataFrame:
    # a record cut out of JSON is its own original, so its text is given once
    left_out = () if as_csv else ("original",)
    schema = T.StructType([f for f in RECORD_SCHEMA if f.name not in left_out])
    found, errors = pieces_of(spark, paths, as_csv, lambda pieces: _record_batch(_piece_records(pieces), left_out), schema)
    found = found.select(*[F.col("raw" if f.name in left_out else f.name).alias(f.name) for f in RECORD_SCHEMA])
    broken = {"source": F.col("source"), "ordinal": F.col("start"), "error": F.col("error")}
    errors = errors.select(*[broken.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA])
    return found.unionByName(errors).withColumn("source", F.regexp_replace("source", "^file:///", "file:/"))


def read_records(spark: SparkSession, paths: str | list[str], whole_bytes: int = WHOLE_BYTES, names: str = EXTENSIONS) -> DataFrame:
    """Records of files, globs or folders (searched recursively for ``names``) in any supported shape.

    Files up to ``whole_bytes`` and compressed ones are streamed by a task each; larger ones are cut by ranges, where
    ordinals keep the order of the records but have gaps.
    """
    listing = lambda found: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(found)
    files = listing(paths)
    out = files.filter(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(_split_files, RECORD_SCHEMA)
    large = [r["path"] for r in files.filter(F.col("length") > whole_bytes).select("path").collect()]  # names only, as Spark's own listing has them
    zipped = [p for p in large if p.endswith(".gz")]
    if zipped:
        out = out.unionByName(listing(zipped).select("path", "content").mapInArrow(_split_files, RECORD_SCHEMA))
    for as_csv in (True, False):
        some = [p for p in large if p not in zipped and p.endswith(".csv") == as_csv]
        if some:
            out = out.unionByName(_split_large(spark, some, as_csv))
    return out


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One record per line: splittable, any file size, JVM only.  Ordinals are byte-ordered within a split.

    A line with more than one value is an invalid record, so an import refuses it.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(paths).filter(F.trim("value") != "")
    raw = F.regexp_replace("value", r"\A\x{FEFF}", "")
    return lines.select(
        raw.alias("raw"), raw.alias("original"), F.col("_metadata.file_path").alias("source"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("ordinal"),
        F.lit("cloudtrail-json").alias("format"), F.lit(False).alias("lossy"), F.lit(None).cast("string").alias("error"))


def _members(text: str) -> dict[str, str]:
    """Exact value text of the members of a JSON object (last of equal names)."""
    found: dict[str, str] = {}
    at = _skip(text, _expect(text, 0, "{"))
    while text[at:at + 1] != "}":
        name, at = _scan(text, _skip(text, at))
        start = _skip(text, _expect(text, at, ":"))
        _, at = _scan(text, start)
        found[name] = text[start:at]
        at = _next_member(text, _skip(text, at))
    if _skip(text, at + 1) != len(text):
        raise ValueError("text after the object")
    return found


def _object(text: str, decoder: json.JSONDecoder) -> dict:
    """A text that is one JSON object, read in one pass; any other is left to ``_members``, which tells its offsets and faults."""
    try:
        found, end = decoder.raw_decode(text, _skip(text, 0))
        if isinstance(found, dict) and _skip(text, end) == len(text):
            return found
    except (ValueError, RecursionError):
        pass
    return {name: json.loads(value) for name, value in _members(text).items()}


def record_of(message: str | None, levels: int = 4, decoder: json.JSONDecoder | None = None) -> str | None:
    """Record inside a queue message, cut out exactly; None when there is none.  ``decoder`` serves many messages."""
    body, decoder = message or "", decoder or json.JSONDecoder()
    try:
        for _ in range(levels):
            members = _object(body, decoder)
            if "detail" in members:
                body = _members(body)["detail"]
            elif members.get("Type") == "Notification" and isinstance(members.get("Message"), str) and members["Message"]:
                body = members["Message"]
            else:
                named = all(isinstance(members.get(n), str) and members[n] for n in ("eventName", "eventID"))
                return body if named else None
    except (ValueError, RecursionError):
        pass
    return None


def open_envelopes(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages with ``raw``: the record of a bus ``detail``, a notification ``Message`` or a plain record, else NULL.

    The record text is cut by offsets: Spark's JSON functions would respell its
    numbers.  A record needs an event name and an event id.
    """
    @F.pandas_udf(T.StringType())
    def records(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()
        return texts.map(lambda text: record_of(text, decoder=decoder))

    return messages.withColumn("raw", records.asNondeterministic()(F.col(column)))  # not repeated in filters


def unwrap_envelopes(messages: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of queue messages; ``open_envelopes`` gives both in one frame."""
    opened = open_envelopes(messages, column)
    return opened.filter(F.col("raw").isNotNull()), opened.filter(F.col("raw").isNull()).drop("raw")
