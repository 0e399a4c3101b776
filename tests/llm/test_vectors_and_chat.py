"""Nearest neighbours against brute force; chat formatting round trips."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from auditspark.llm import chat, neighbours, queries
from auditspark.llm.common import table


def nearest(ids, x, query, top=10):
    away = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
    order = [k for k in np.lexsort((ids, away)) if ids[k] != ids[query]][:top]
    return [(int(ids[k]), float(away[k])) for k in order]


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in queries.op8_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        want, got = nearest(ids, x, k), found[int(ids[k])]
        assert [r for r, _, _ in got] == list(range(1, 11))
        hits += len({i for i, _ in want} & {i for _, i, _ in got})
        total += len(want)
        exact = dict(zip(ids.tolist(), np.sqrt(((x - x[k]) ** 2).sum(axis=1)).tolist()))
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in got)
    assert len(found) == (ids % 100 == 0).sum() and hits / total >= 0.9


def test_neighbours_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(300)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(1000, 1400)]  # one very common vector
    odd = [(2000, None), (2100, [0.0] * 4), (2200, [1.0, None, 1.0, 1.0]), (2300, [float("nan")] * 4), (2400, [float("inf"), 0.0, 0.0, 1.0]), (2500, [1.0]), (None, [1.0] * 4)]
    data = spark.createDataFrame([(*r, 1, 2) for r in rows + odd + rows[:3]], "vec_id bigint, embedding array<double>, cell int, part int")
    got = {}
    for r in neighbours.search(data, F.pmod("vec_id", F.lit(100)) == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = sum(len(set(got[i]) & {n for n, _ in nearest(ids, x, int(np.flatnonzero(ids == i)[0]))}) for i in got)
    assert hits >= 0.95 * 10 * len(got)
    for i in (1000, 1100):
        assert got[i] == [n for n, _ in nearest(ids, x, int(np.flatnonzero(ids == i)[0]))]
    for few in (data.limit(0), data.filter("vec_id = 0"), data.filter("vec_id in (0, 1)")):
        assert neighbours.search(few, F.col("vec_id") == 0).count() == max(few.select("vec_id").distinct().count() - 1, 0)


def test_neighbours_of_repeated_ids(spark):
    """An id with two vectors is one candidate, with the smaller one."""
    data = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (2, [0.9, 0.0]), (2, [0.9, 0.0]), (3, [5.0, 5.0]), (1, [1.0, 0.0])], "vec_id int, embedding array<float>")
    got = neighbours.search(data, F.col("vec_id") == 1, recall=1.0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(1, 1, 2), (1, 2, 3)] and abs(got[0].score - 0.1) < 1e-6


PIECES = st.sampled_from([*chat.CONTROLS, "\\", "[", "<", "/", "INST]", "s>", "<<", "\n", "é", "文", "a b"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</s>", "<|text|>"]), st.lists(PIECES, max_size=8).map("".join)), max_size=6))
def test_round_trip(turns):
    rendered = [chat.render(role, text) for role, text in turns]
    whole = "".join(r[0] for r in rendered)
    assert [(role, text) for role, text, _, _ in chat.parse(whole)] == turns
    for (turn, start, end), (_, text) in zip(rendered, turns):
        assert chat.unescape(turn[start:end]) == text
        assert not any(mark in turn[start:end] for mark in chat.CONTROLS)


@pytest.mark.parametrize("text", ["hello", "[INST]", "[INST]a[/INST]b", "[INST]a</s>[/INST]", "<|role|>x<|end|>"])
def test_parser_rejects_what_is_no_conversation(text):
    if text == "[INST]a[/INST]b" or not text.startswith("[INST]a[/INST]"):
        with pytest.raises(chat.GrammarError):
            chat.parse(text)


def plain_digests(rows):
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, own in turns.items():
        own.sort()
        learned = "".join(t for _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_chat_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op10_chat(spark, sf).collect()}
    assert got == plain_digests(rows)


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a\\b</s>"), (1, 1, "assistant", "a\\b</s>"), (1, None, None, "x"), (None, 3, "tool", ""), (2, 0, "assistant", "y" * 500_000),
            (3, 5, "system", "<<SYS>>"), *[(4, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(30_000)]]
    data = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, position int, formatted string")
    found = chat.read_back(chat.format_turns(data)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == plain_digests(rows)
    assert Counter(r.conv_id for r in found).most_common(1)[0][1] == 1
    assert chat.read_back(chat.format_turns(data.limit(0))).count() == 0
