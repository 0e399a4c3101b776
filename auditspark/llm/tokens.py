"""Token counts by a two-tier lookup on the map side: no pre-token is ever exchanged.

A pre-token is a run between ASCII white space.  The tokenizer drops white space and never merges across it, so a
text's count is the sum over its pre-tokens.  Tier one is a broadcast table with the lengths of at most ``frequent``
common pre-tokens.  They are counted over all texts: every task keeps a bounded sketch (``SKETCH`` entries, thinned by
halving what it holds least of) and gives away only what is common in it; sketches are added up.  The table affects speed
only.  Tier two is a cache in each Python worker, filled by the library for what the table lacks; it starts again from
the table when it holds ``cache`` entries more.  Where the tokenizer lower-cases and cuts at letters, digits and other
characters, a missed pre-token of printable ASCII is first cut the same way, so that the cache sees fewer forms.  All
misses of an Arrow batch are encoded at once.  Pre-tokens over LONG bytes are encoded each time.

Rows: a NULL text counts as empty (0 bytes, 0 tokens); empty and very long texts, ties, repeated rows and special
strings inside texts are counted as the library does; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, least_common, release_memory, stored

FREQUENT = 1 << 16
#: Entries of a task's sketch, and the least share of its pre-tokens that a task reports.
SKETCH = 1 << 17
REPORTED = 1 / (1 << 17)
CACHE = 250_000
#: Pre-tokens that the library encodes at once; what it returns is large.
ENCODED = 1 << 12
LONG = 64
LIMIT = 2048
#: Fixed value: how a lower-casing tokenizer cuts, and the same for printable ASCII.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_CUT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PRINTABLE = re.compile(rb"[!-~]+")
#: Stands for an unknown length in a sum; counts of known ones stay below.
_MISS = 1 << 40
_loaded: dict = {}
_worker: dict = {}


def _encoder(path: str):
    """The worker's tokenizer, loaded once."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        encoder = Tokenizer.from_file(path)
        encoder.no_truncation()
        encoder.no_padding()
        _loaded[path] = encoder
    return _loaded[path]


def _cuts(path: str) -> tuple[bytes, ...] | None:
    """None if a pre-token may not be cut further, else the special strings that no cut may touch."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    first = ((described["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    normal = [n["type"] for n in (described["normalizer"] or {}).get("normalizers", [])]
    if first.get("type") != "Split" or first["pattern"].get("Regex") != CUT or normal != ["NFC", "Replace", "Lowercase"]:
        return None
    return tuple(t["content"].encode() for t in described["added_tokens"])


def encoded_lengths(path: str, words: list[bytes]) -> list[int]:
    out: list[int] = []
    for k in range(0, len(words), ENCODED):
        texts = [w.decode("utf-8", "surrogatepass") for w in words[k: k + ENCODED]]
        out += map(len, _encoder(path).encode_batch_fast(texts, add_special_tokens=False))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: a sketch of its pre-tokens.  What is dropped in a thinning had at most the median count."""
    seen, total = Counter(), 0
    for batch in batches:
        for value in batch.column(0).cast(pa.large_binary()).drop_null():
            words = value.as_buffer().to_pybytes().split()
            total += len(words)
            if max(map(len, words), default=0) > LONG:
                words = [w for w in words if len(w) <= LONG]
            seen.update(words)
            if len(seen) > SKETCH:
                least = sorted(seen.values())[len(seen) // 2]
                seen = Counter({w: n - least for w, n in seen.items() if n > least})
    common = {w: n for w, n in seen.items() if n >= max(2, total * REPORTED)}
    if common:
        yield pa.RecordBatch.from_arrays([pa.array(list(common), pa.binary()), pa.array(list(common.values()), pa.int64())], names=["word", "n"])
    del seen, common
    release_memory()


def frequent_lengths(docs: DataFrame, path: str, frequent: int = FREQUENT, text: Column | None = None) -> dict[bytes, int]:
    """Lengths of the commonest pre-tokens of ``docs``; ``frequent`` words of at most LONG bytes pass the driver."""
    found = docs.select((F.col("text") if text is None else text).alias("text")).mapInArrow(_counted, "word binary, n bigint")
    counts = stored(found.groupBy("word").agg(F.sum("n").alias("n")))
    words = [bytes(r["word"]) for r in counts.filter(F.col("n") >= least_common(counts, "n", frequent)).select("word").collect()]
    return dict(zip(words, encoded_lengths(path, words))) if words else {}


class Lengths:
    """A worker's known lengths: the broadcast table and what it met besides."""

    def __init__(self, path: str, table: dict[bytes, int], cache: int) -> None:
        self.path, self.table, self.cache = path, table, cache
        self.known, self.special = dict(table), _cuts(path)

    def _parts(self, word: bytes) -> list[bytes]:
        if self.special is None or not _PRINTABLE.fullmatch(word) or any(s in word for s in self.special):
            return [word]
        return _ASCII_CUT.findall(word.lower())

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        known, out, missed = self.known, [], []
        for text in texts:
            words = text.split()
            n = sum(map(known.get, words, repeat(_MISS)))
            left = list(filterfalse(known.__contains__, words)) if n >= _MISS else ()
            out.append(n - len(left) * _MISS)
            missed.append(left)
        parts = {w: self._parts(w) for w in set(chain.from_iterable(missed))}
        new = list(filterfalse(known.__contains__, set(chain.from_iterable(parts.values()))))
        lengths = dict(zip(new, encoded_lengths(self.path, new))) if new else {}
        for word in filterfalse(lengths.__contains__, list(parts)):
            lengths[word] = sum(lengths[p] if p in lengths else known[p] for p in parts[word])
        out = [n + sum(map(lengths.__getitem__, left)) for n, left in zip(out, missed)]
        known.update((w, n) for w, n in lengths.items() if len(w) <= LONG)
        if len(known) > len(self.table) + self.cache:
            self.known = dict(self.table)
        return out


def _worker_lengths(name: str, path: str, table: dict[bytes, int], cache: int) -> Lengths:
    """The worker's lengths, kept from task to task; those of another table go."""
    if name not in _worker:
        _worker.clear()
        _worker[name] = Lengths(path, table, cache)
    return _worker[name]


def token_counts(docs: DataFrame, path: str, text: Column | None = None, cache: int = CACHE, frequent: int = FREQUENT) -> Column:
    """Column with the number of tokens of each text, by the tokenizer file at ``path`` (present on every machine)."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, frequent, text))

    name = uuid.uuid4().hex

    @F.arrow_udf("bigint")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths = _worker_lengths(name, path, held.value, cache)
        for column in columns:
            yield pa.array(lengths.counts([v.as_buffer().to_pybytes() for v in column.cast(pa.large_binary()).fill_null(b"")]), pa.int64())

    return run(F.col("text") if text is None else text)
