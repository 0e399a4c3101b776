"""Alignment of two tokenizers against a plain walk over bytes, with the libraries' own encoders."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from auditspark.llm import alignment, queries
from auditspark.llm.common import stored, table

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    a = lambda t: [(i, bytes(alphabet[c] for c in library.id_to_token(i))) for i in library.encode(" " + t, add_special_tokens=False).ids]
    b = lambda t: [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode())
                   for i in pieces.encode(t)]
    return a, b


def plain(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    a, b = encoders()
    found, documents = [], Counter()
    for t in texts:
        x, y = (a(t), b(t)) if t else ([], [])
        want = b" " + (t or "").encode("utf-8", "surrogatepass")
        if b"".join(w for _, w in x) != want or b"".join(w for _, w in y) != want:
            x, y = [], []
        groups, left, right, done_a, done_b = [], [], [], 0, 0
        y_left = list(y)
        for i, w in x:
            left.append(i)
            done_a += len(w)
            while y_left and done_b + len(y_left[0][1]) <= done_a:
                right.append(y_left[0][0])
                done_b += len(y_left.pop(0)[1])
            if done_a == done_b:
                groups.append((left, right))
                left, right = [], []
        links = Counter((i, j) for g, h in groups for i in g for j in h)
        documents.update(set(links))
        found.append((len(x), len(y), groups, links))
    most = {}
    for (i, _), n in documents.items():
        most[i] = max(most.get(i, 0), n)
    return [(n, m, len(g), sum(links.values()), sum(k for p, k in links.items() if documents[p] == most[p[0]]), sum(k * documents[p] for p, k in links.items()),
             ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)) for n, m, g, links in found]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    parts = ["the ", "  ", "\n\n", "Grüße", "文字", "🙂", "<|endoftext|>", "</s>", "<0x0A>", "\t", "x=1;", "don't ", "    " * 9, "á", "▁", "ﬁ", "0123456789", "=" * 40, "\u0000", "naïve "]
    out = [None, "", " ", "a", "the the the", "▁", "<s>", "one\r\ntwo", "é" * 2_000, " " * 5_000, "ab" * 3_000, "文" * 3_000, "🙂" * 2_000, "x y " * 20_000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["the same", "the same"]


def rows(df):
    cols = ["n_a", "n_b", "n_groups", "n_links"]
    return [tuple(r) for r in df.orderBy("k").select(*[f"alignment.{c}" for c in cols], "n_best", "count_sum", "alignment.groups").collect()]


def test_like_a_plain_walk(spark, texts, monkeypatch):
    data = spark.createDataFrame([(k, t, "x", 7, [1]) for k, t in enumerate(texts)], "k int, text string, alignment string, n_best int, pairs array<int>").repartition(5, "k")
    want = plain(texts)
    found = stored(alignment.align(data, A, B))
    got = alignment.counted(found, A, B)
    assert set(got.columns) == {"k", "text", "pairs", "alignment", "n_best", "count_sum"} and got.schema["pairs"].dataType == data.schema["pairs"].dataType
    assert rows(got) == want
    assert any(w[2] == 0 for w in want[2:]) and any(w[2] > 10 for w in want)
    for frequent in (0, 40):  # the other pairs are joined
        assert rows(alignment.counted(found, A, B, frequent=frequent)) == want


def test_large_groups_are_counted_by_distinct_ids(texts, monkeypatch):
    voc = alignment.vocabularies(A, B)
    raw = [None if t is None else t.encode() for t in texts]
    want = alignment.aligned_texts(voc, raw).to_pylist()
    monkeypatch.setattr(alignment, "WRITTEN", 3)
    monkeypatch.setattr(alignment, "HELD", 50)
    assert alignment.aligned_texts(voc, raw).to_pylist() == want


def test_library_and_ranks_agree(texts):
    import json
    described = json.load(open(A, encoding="utf-8"))
    by_rank = alignment._encoder_a(A, described["model"]["vocab"], described)
    by_library = alignment._encoder_a(A, described["model"]["vocab"], {**described, "normalizer": {}})
    some = [t for t in texts if t]
    assert by_rank(some) == by_library(some)


def test_pair_counts(spark):
    texts = ["don't", "don't", "naïve", "the"]
    found = stored(alignment.align(spark.createDataFrame([(t,) for t in texts], "text string"), A, B))
    a, b = encoders()
    the = a("the")[0][0]
    assert alignment.vocabularies(A, B).same[the] == b("the")[0][0] and alignment.same_counts(found, len(alignment.vocabularies(A, B).a_bytes))[the] == 1
    for r in alignment.pair_counts(found).collect():
        assert r.documents in (1, 2)


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = plain([d.text for d in docs])
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_alignment(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, want):
        assert got[d.doc_id] == (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    found = stored(alignment.align(none, A, B))
    assert alignment.counted(found, A, B).count() == 0 and alignment.counted(found, A, B, frequent=0).count() == 0
