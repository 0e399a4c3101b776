"""URL filters: allow and block entries in one trie over reversed host labels and path segments.

The trie is walked twice at once for a url: down the labels of its host, last label first, and at every host node on the
way down the segments of its path.  An entry lies at the node of its host and its whole path segments and keeps its last,
open segment there (``/en/`` ends in an empty one, ``/en`` in ``en``), which a url's segment must start with.  The
deepest host wins, in it the longest path; of two entries for the same place the block wins.  A url that no entry fits
gets the default verdict.

Entries are read in blocks of at most ``most`` (ordered by reversed host), one trie each: a trie is broadcast, the
columns found so far travel on, and the longer match of two blocks stays.  One block is the usual case; nothing
larger than a block is ever in the driver or broadcast.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
``?``, ``#`` or the end.  An entry fits its host and all subdomains; an empty host fits every host.

Rows: a NULL url, or one without ``://``, has an empty host and path; an empty path starts with no entry's path but an
empty one.  Very long urls are walked whole.  Every row is judged by itself, so repeated rows and NULL ids stay; an
empty table gives an empty result; input columns named host, path, rule or verdict are replaced, others stay.  Entries
with a NULL host or path, or an action other than allow and block, are refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

ALLOW, BLOCK = "allow", "block"
MOST = 500_000
#: Most bytes of entry text in a block; a broadcast trie takes a small multiple of it.
MOST_BYTES = 32 << 20
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_FOUND = "struct<depth:int,length:int,action:string,host:string,path:string>"


class Trie:
    """Entries by reversed host labels, then by path segments."""

    def __init__(self, entries: Iterable[tuple[str, str, str]]) -> None:
        #: A host node is [children by label, path node]; a path node is [children by whole segment, entries by open
        #: segment, length of the longest open segment].
        self.root: list = [{}, None]
        for host, path, action in entries:
            self.add(host, path, action)

    def add(self, host: str, path: str, action: str) -> None:
        node, depth = self.root, 0
        for label in reversed(host.split(".")) if host else ():
            node, depth = node[0].setdefault(label, [{}, None]), depth + 1
        if node[1] is None:
            node[1] = [{}, {}, 0]
        node = node[1]
        *whole, last = path.split("/")
        for segment in whole:
            node = node[0].setdefault(segment, [{}, {}, 0])
        node[2] = max(node[2], len(last))
        held = node[1].get(last)
        if held is None or held[2] != BLOCK:
            node[1][last] = (depth, len(path), action, host, path)

    def longest(self, host: str, path: str) -> tuple | None:
        """(host depth, path length, action, host, path) of the entry that wins."""
        node, hosts = self.root, [self.root[1]]
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            hosts.append(node[1])
        segments = None
        for node in reversed(hosts):
            if node is None:
                continue
            if segments is None:
                segments = path.split("/")
            found = self._in_paths(node, segments)
            if found is not None:
                return found
        return None

    @staticmethod
    def _in_paths(node: list, segments: list[str]) -> tuple | None:
        best = None
        for segment in segments:
            children, ends, longest = node
            if ends:
                for k in range(min(len(segment), longest), -1, -1):
                    if segment[:k] in ends:
                        best = ends[segment[:k]]  # a deeper node means a longer path
                        break
            node = children.get(segment)
            if node is None:
                break
        return best


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def address(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    text = F.coalesce(url, F.lit(""))
    return _lowered(F.regexp_extract(text, _ADDRESS, 1)), F.regexp_extract(text, _ADDRESS, 2)


def _matched(trie, host: Column, path: Column) -> Column:
    """The longest match in a broadcast trie."""
    kind = pa.struct([("depth", pa.int32()), ("length", pa.int32()), ("action", pa.string()), ("host", pa.string()), ("path", pa.string())])
    names = [f.name for f in kind]

    @F.arrow_udf(_FOUND)
    def walk(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        longest = trie.value.longest
        for hosts, paths in columns:
            out = [longest(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            yield pa.array([None if o is None else dict(zip(names, o)) for o in out], kind)

    return walk(host, path)


def entry_blocks(entries: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES) -> Iterator[list[tuple[str, str, str]]]:
    """The entries (host, path, action), cut into blocks by count and bytes; one block is held at a time."""
    bad = entries.filter(F.col("host").isNull() | F.col("path").isNull() | ~F.coalesce(F.col("action").isin(ALLOW, BLOCK), F.lit(False)))
    wrong = bad.limit(1).collect()
    if wrong:
        raise ValueError(f"entry {wrong[0].asDict()} needs a host, a path and an action of {ALLOW} or {BLOCK}")
    held, size = [], 0
    near = F.array_join(F.reverse(F.split("host", r"\.")), ".")
    for row in entries.select(_lowered(F.col("host")).alias("host"), "path", "action").distinct().orderBy(near, "path", "action").toLocalIterator():
        held.append((row["host"], row["path"], row["action"]))
        size += len(row["host"]) + len(row["path"])
        if len(held) >= most or size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def judge(pages: DataFrame, entries: DataFrame, url: str = "url", default: str = ALLOW, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule (host and path of the winning entry, or NULL) and verdict."""
    if default not in (ALLOW, BLOCK):
        raise ValueError(f"default must be {ALLOW} or {BLOCK}, not {default!r}")
    host, path = address(F.col(url))
    kept = [F.col(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    out = pages.select(*kept, host.alias("host"), path.alias("path"), F.lit(None).cast(_FOUND).alias("rule"))
    trie = None
    for block in entry_blocks(entries, most, most_bytes):
        if trie is not None:  # one more block: what is found so far is written, and the trie before it can go
            out = stored(out)
            trie.unpersist()
        trie = pages.sparkSession.sparkContext.broadcast(Trie(block))
        # structs are compared by depth, then length, then action: of two entries for one place the block is greater
        out = out.withColumn("rule", F.greatest(F.col("rule"), _matched(trie, F.col("host"), F.col("path"))))
    verdict = F.coalesce(F.col("rule.action"), F.lit(default))
    return out.withColumn("verdict", verdict).withColumn("rule", F.concat("rule.host", "rule.path"))


def allowed(pages: DataFrame, entries: DataFrame, **how) -> DataFrame:
    """The rows that the filter allows, with the columns of ``judge``."""
    return judge(pages, entries, **how).filter(F.col("verdict") == ALLOW)
