"""Alignment of two tokenizers over the same texts, with an identity map for the regular part.

A text with a space before it is encoded by a byte-level BPE (A); the text itself by a piece BPE that adds that space
(B).  Byte offsets at which a token of either ends cut both into groups, and every A token is linked with every B token
of its group.  How many documents hold a pair of ids linked is counted over the whole corpus.

Most groups are one A token and one B token of the same bytes.  An array, made from the vocabularies, names for each A
id the B id of the same bytes; linked pairs that follow it are counted in one vector as long as the vocabulary, summed
over the tasks.  Only the other pairs are exchanged, once per document and pair, pre-aggregated.  Then the counts go
back: the vector and the commonest of the other pairs (``frequent`` at most, found by a histogram of the counts) are
looked up where the documents lie; the rest of the pairs, none of which is common, is joined.

Special strings inside texts are ordinary text.  Token bytes: A's entry decoded from its byte alphabet; B's piece in
UTF-8 with U+2581 as a space, ``<0xHH>`` as that byte.

Rows: a text that is NULL, empty, not valid UTF-8, or not restored by the joined bytes of both tokenizers has no tokens
and zeros everywhere, its ``groups`` are empty.  Every row is a document of its own, so repeated rows and NULL ids count
each.  A text is held whole by one task.  An empty table gives an empty result; of the input columns only ``alignment``
(``align``) and ``n_best``, ``count_sum`` (``counted``) are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_BYTES, bounded_batches, least_common, pieces, stored, summed

#: A pair of ids is one number: the A id above, the B id in the lower BITS.
BITS = 20
FREQUENT = 1 << 19
#: Links of a group that are written out one by one; a larger group is counted by its distinct ids.
WRITTEN = 1 << 12
#: Links held at once.
HELD = 1 << 21
#: How the byte-level tokenizer cuts a text before it merges: fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FIELDS = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups": "string", "same_ids": "array<int>", "same_links": "array<int>",
           "pairs": "array<bigint>", "pair_links": "array<bigint>"}
ALIGNMENT = "struct<" + ",".join(f"{k}:{v}" for k, v in _FIELDS.items()) + ">"
_loaded: dict = {}


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: the printable ones for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(others)}}


@dataclass
class Vocabularies:
    """Both tokenizers as bytes by id, and the B id of the same bytes for each A id (-1: none)."""
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    same: np.ndarray
    encode_a: object
    encode_b: object


def _encoder_a(path: str, words: dict[str, int], described: dict):
    """Ids of a text.  Where merges come in the order of the ids, the ranks are the ids and a plain rank encoder does."""
    merges = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
    order = [words["".join(m)] for m in merges]
    before = described["pre_tokenizer"]
    if described["normalizer"] is None and before["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] \
            and order == sorted(order) and len(words) - len(order) == 256 + sum(t["content"] in words for t in described["added_tokens"]):
        import tiktoken
        alphabet = byte_alphabet()
        extra = {t["content"] for t in described["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in word): k for word, k in words.items() if word not in extra}
        plain = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [plain.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    return lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def vocabularies(a: str, b: str) -> Vocabularies:
    """The two tokenizer files at ``a`` (tokenizers, byte level) and ``b`` (sentencepiece), loaded once per worker."""
    if (a, b) not in _loaded:
        import sentencepiece
        with open(a, encoding="utf-8") as file:
            described = json.load(file)
        words, alphabet = described["model"]["vocab"], byte_alphabet()
        a_bytes = [b""] * (1 + max(words.values()))
        for word, k in words.items():
            a_bytes[k] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else word.encode()
        pieces_b = sentencepiece.SentencePieceProcessor(model_file=b)
        b_bytes, named = [], {}
        for k in range(pieces_b.get_piece_size()):
            piece = pieces_b.id_to_piece(k)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if pieces_b.is_byte(k) else piece.replace("▁", " ").encode())
            if not (pieces_b.is_control(k) or pieces_b.is_unknown(k) or pieces_b.is_unused(k)) and (b_bytes[k] not in named or not pieces_b.is_byte(k)):
                named[b_bytes[k]] = k
        if max(len(a_bytes), len(b_bytes)) > 1 << BITS:
            raise ValueError(f"vocabularies have at most {1 << BITS} ids")
        same = np.array([named.get(x, -1) for x in a_bytes], np.int64)
        _loaded[a, b] = Vocabularies(a_bytes, b_bytes, same, _encoder_a(a, words, described), partial(pieces_b.encode, num_threads=1))
    return _loaded[a, b]


def _restored(table: list[bytes], ids: list[int], want: bytes) -> bool:
    return b"".join(map(table.__getitem__, ids)) == want


def _tokens(voc: Vocabularies, raw: list[bytes | None]) -> tuple[list[list[int]], list[list[int]]]:
    texts = [(t or b"").decode("utf-8", "replace") for t in raw]
    a, b = voc.encode_a([" " + t for t in texts]), voc.encode_b(texts)
    for k, t in enumerate(raw):
        if not t or not (_restored(voc.a_bytes, a[k], b" " + t) and _restored(voc.b_bytes, b[k], b" " + t)):
            a[k] = b[k] = []
    return a, b


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.concatenate([np.array(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64), sizes


def _summed_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of ``n``."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _group_links(a: np.ndarray, b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, document: np.ndarray):
    """(document, A id, B id, links) of whole groups; as many groups at once as HELD links allow."""
    links = size_a * size_b
    small = np.flatnonzero(links <= WRITTEN)
    ends = np.cumsum(links[small])
    first = 0
    while first < len(small):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HELD, "right")))
        groups = small[first:last]
        each = np.repeat(groups, links[groups])
        inside = np.arange(len(each)) - np.repeat(np.cumsum(links[groups]) - links[groups], links[groups])
        yield document[each], a[start_a[each] + inside // size_b[each]], b[start_b[each] + inside % size_b[each]], np.ones(len(each), np.int64)
        first = last
    for g in np.flatnonzero(links > WRITTEN):
        ids_a, n_a = np.unique(a[start_a[g]: start_a[g] + size_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[start_b[g]: start_b[g] + size_b[g]], return_counts=True)
        step = max(1, HELD // len(ids_b))
        for k in range(0, len(ids_a), step):
            some, n = ids_a[k: k + step], n_a[k: k + step]
            yield (np.full(len(some) * len(ids_b), document[g]), np.repeat(some, len(ids_b)), np.tile(ids_b, len(some)), (n[:, None] * n_b[None]).ravel())


def aligned_texts(voc: Vocabularies, raw: list[bytes | None]) -> pa.Array:
    """The ALIGNMENT of some texts."""
    rows = len(raw)
    a, n_a = _flat((lists := _tokens(voc, raw))[0])
    b, n_b = _flat(lists[1])
    del lists
    length_a, length_b = (np.array([len(x) for x in t], np.int64) for t in (voc.a_bytes, voc.b_bytes))
    end_a, end_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])  # both sides of a text have the same bytes
    last_a = np.isin(end_a, end_b, assume_unique=True)
    last_b = np.isin(end_b, end_a, assume_unique=True)
    stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    start_a, start_b = stop_a - size_a, stop_b - size_b
    document = np.repeat(np.arange(rows), n_a)[stop_a - 1] if len(stop_a) else np.zeros(0, np.int64)
    n_groups = np.bincount(document, minlength=rows)
    all_links = np.concatenate([[0], np.cumsum(size_a * size_b)])
    group_ends = np.cumsum(n_groups)
    n_links = all_links[group_ends] - all_links[group_ends - n_groups]

    one = (size_a == 1) & (size_b == 1)
    one_a, one_b, one_doc = a[start_a[one]], b[start_b[one]], document[one]
    regular = voc.same[one_a] == one_b
    same = [((one_doc[regular] << BITS) | one_a[regular], np.ones(int(regular.sum()), np.int64))]
    other = [_keyed(one_doc[~regular], one_a[~regular], one_b[~regular], np.ones(int((~regular).sum()), np.int64))]
    many = ~one
    for doc, x, y, n in _group_links(a, b, start_a[many], start_b[many], size_a[many], size_b[many], document[many]):
        follows = voc.same[x] == y
        same.append(_summed_by((doc[follows] << BITS) | x[follows], n[follows]))
        other.append(_keyed(doc[~follows], x[~follows], y[~follows], n[~follows]))
    same_key, same_n = _summed_by(*(np.concatenate(c) for c in zip(*same)))
    doc, pair, pair_n = (np.concatenate(c) for c in zip(*other))
    order = np.lexsort((pair, doc))
    doc, pair, pair_n = doc[order], pair[order], pair_n[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else np.zeros(0, np.int64)
    pair_n = np.add.reduceat(pair_n, first) if len(doc) else pair_n
    doc, pair = doc[first], pair[first]

    def lists(of: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))

    columns = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
    columns.append(_group_texts(a, b, last_a, last_b, n_a, n_b))
    columns += [lists(same_key >> BITS, same_key & ((1 << BITS) - 1), pa.int32()), lists(same_key >> BITS, same_n, pa.int32()), lists(doc, pair, pa.int64()), lists(doc, pair_n, pa.int64())]
    return pa.StructArray.from_arrays(columns, names=list(_FIELDS))


def _keyed(doc: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return doc, (x << BITS) | y, n


def _group_texts(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> pa.Array:
    """``a1,a2|b1;a3|b2`` per text: every token is put after the tokens of earlier groups, and its mark follows it."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    to_a = np.concatenate([[0], np.flatnonzero(last_a) + 1])  # A tokens before a group
    to_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
    code = np.empty(len(a) + len(b), np.int64)  # id and the mark that follows: , | ;
    code[np.arange(len(a)) + to_b[group_a]] = a * 3 + last_a
    code[np.arange(len(b)) + to_a[group_b + 1]] = b * 3 + 2 * last_b
    kinds, places = np.unique(code, return_inverse=True)
    words = [f"{k // 3}{',|;'[k % 3]}" for k in kinds.tolist()]
    written = list(map(words.__getitem__, places.tolist()))
    out, first = [], 0
    for n in (n_a + n_b).tolist():
        out.append("".join(written[first: first + n])[:-1])
        first += n
    return pa.array(out, pa.string())


def align(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """``docs`` with ``alignment``: token and group numbers, the groups as text, and the linked ids with their links."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(ALIGNMENT)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voc = vocabularies(a, b)
        for column in columns:
            raw, done, first, size = column.cast(pa.large_binary()).to_pylist(), [], 0, 0
            for k, t in enumerate(raw, 1):
                size += len(t or b"")
                if size >= SLICE_BYTES or k == len(raw):
                    done.append(aligned_texts(voc, raw[first:k]))
                    first, size = k, 0
            yield pa.concat_arrays(done) if done else aligned_texts(voc, [])

    return docs.withColumn("alignment", run(F.col(text)))


def same_counts(aligned: DataFrame, ids: int) -> np.ndarray:
    """For each A id, how many documents hold it linked with the B id of the same bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ids)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=ids)
        cut = pieces(total)
        if cut:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([v for _, v in cut], pa.binary())], names=["piece", "values"])

    return summed(aligned.select("alignment.same_ids").mapInArrow(run, "piece int, values binary"), ids).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, documents) of all other linked pairs; ``pair`` holds the A id above the B id's BITS."""
    return aligned.select(F.explode("alignment.pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))


def counted(aligned: DataFrame, a: str, b: str, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` (a stored table, as it is read more than once) with ``n_best`` and ``count_sum``.

    ``count_sum`` adds up, over a document's links, in how many documents the pair of ids is linked; ``n_best`` counts the
    links whose pair no other pair of the same A id surpasses.
    """
    spark = aligned.sparkSession
    ids = len(vocabularies(a, b).a_bytes)
    same = same_counts(aligned, ids)
    counts = stored(pair_counts(aligned))
    best = same.copy()
    for r in counts.groupBy(F.shiftright("pair", BITS).alias("id")).agg(F.max("documents").alias("most")).collect():  # a row per A id at most
        best[r["id"]] = max(best[r["id"]], r["most"])
    least = least_common(counts, "documents", frequent)
    table = counts.filter(F.col("documents") >= least).toArrow()
    pairs, documents = table.column("pair").to_numpy(), table.column("documents").to_numpy()
    order = np.argsort(pairs)
    held = spark.sparkContext.broadcast((same, best, pairs[order], documents[order]))

    @F.arrow_udf("struct<n_best:bigint,count_sum:bigint,pairs:array<bigint>,links:array<bigint>>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield _looked_up(column, *held.value)

    kept = [c for c in aligned.columns if c.lower() not in ("n_best", "count_sum")]
    if least <= 1:
        found = aligned.select(*kept, run(F.col("alignment")).alias("_found"))
        return found.select(*kept, "_found.n_best", "_found.count_sum")
    # pairs under ``least`` documents: none is common, so the join has no heavy key
    numbered = stored(aligned.select(F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("place"), run(F.col("alignment")).alias("found")))
    rare = numbered.select("place", F.explode(F.arrays_zip("found.pairs", "found.links")).alias("link")).select("place", F.col("link.pairs").alias("pair"), "link.links")
    most = spark.createDataFrame(pa.table({"id": np.arange(ids), "most": best}))
    rare = rare.join(counts.filter(F.col("documents") < least), "pair").join(most, F.shiftright("pair", BITS) == F.col("id"))
    rare = rare.groupBy("place").agg(F.sum(F.when(F.col("documents") == F.col("most"), F.col("links")).otherwise(0)).alias("n"), F.sum(F.col("links") * F.col("documents")).alias("sum"))
    whole = numbered.join(rare, "place", "left")
    return whole.select("row.*", (F.col("found.n_best") + F.coalesce("n", F.lit(0))).alias("n_best"), (F.col("found.count_sum") + F.coalesce("sum", F.lit(0))).alias("count_sum"))


def _looked_up(column: pa.Array, same: np.ndarray, best: np.ndarray, pairs: np.ndarray, documents: np.ndarray) -> pa.Array:
    """Sums over the links whose counts are at hand, and the links whose are not."""
    rows = len(column)

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        part = column.field(name)
        return part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)

    def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[bounds[1:]] - total[bounds[:-1]]

    ids, ends = lists("same_ids")
    links = lists("same_links")[0]
    n_best, count_sum = sums(links * (same[ids] == best[ids]), ends), sums(links * same[ids], ends)
    pair, ends = lists("pairs")
    links = lists("pair_links")[0]
    place = np.searchsorted(pairs, pair)
    known = np.zeros(len(pair), bool)
    known[place < len(pairs)] = pairs[place[place < len(pairs)]] == pair[place < len(pairs)]
    n = np.zeros(len(pair), np.int64)
    n[known] = documents[place[known]]
    n_best = n_best + sums(links * (known & (n == best[pair >> BITS])), ends)
    count_sum = count_sum + sums(links * n, ends)
    left = np.concatenate([[0], np.cumsum(~known)])[ends].astype(np.int32)
    rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(values[~known], pa.int64())) for values in (pair, links)]
    return pa.StructArray.from_arrays([pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), *rest], names=["n_best", "count_sum", "pairs", "links"])
