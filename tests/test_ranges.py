"""Large files cut by ranges give the records that the whole-file reader gives, byte by byte."""

import json
import random

import numpy as np
import pytest

from auditspark.sources import ranges, readers


def record(rng, k):
    odd = ["}", "{", "]", "[", '"', "\\", "\\\\", "Records", ",", "é", "\n", "x" * 20, '":[', "\\u007d"]
    inner = {"eventName": f"n{k}", "note": "".join(rng.choice(odd) for _ in range(rng.randrange(7))), "deep": {"a": [1, {"b": [{}, []]}], "Records": [[1], {"x": "}"}]}}
    text = json.dumps(inner, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    return text.replace('"deep"', '"n" : 1.10,"deep"')


def documents(rng):
    some = [record(rng, k) for k in range(60)]
    wrapped = [json.dumps({"EventId": "x", "CloudTrailEvent": s}) for s in some]
    big = '{"eventName":"big","t":"' + "}]{[" * 800 + '"}'
    join = ",\n ".join
    yield "records", '{"note":{"Records":[1,{"a":2}],"x":[3]},"Records" : [%s],"tail":[{"q":1}]}\n' % join(some)
    yield "events", '{"Events":[%s]}' % join(wrapped)
    yield "bare", "﻿ [%s ]" % join([*some, big, *some[:5]])
    yield "values", " ".join(some) + "[%s]" % join(some[:9]) + '{"Records":[%s]}' % some[3] + big + "\n\n"
    yield "empty lists", '[]{"Records":[ ]}[%s]{"Events":[]}' % join(some)
    yield "mark", "\ufeff" + some[0] + some[1]*60
    yield "a list in a list", '{"a":[[%s]],"Records":[%s]}' % (join(some[:5]), join(some))


def read(spark, path, **how):
    return [(r.raw, r.original, r.format, r.lossy, r.error is not None) for r in readers.read_records(spark, str(path), **how).orderBy("ordinal").collect()]


@pytest.fixture
def small_ranges(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("place", range(7))
def test_ranges_give_what_the_whole_file_gives(spark, tmp_path, small_ranges, monkeypatch, place):
    monkeypatch.setattr(ranges, "BLOCK_BYTES", 300)
    name, text = list(documents(random.Random(place)))[place]
    (tmp_path / "a.json").write_text(text)
    want = read(spark, tmp_path)
    assert len(want) > 50 and not any(w[4] for w in want), name
    got = readers.read_records(spark, str(tmp_path), whole_bytes=10)
    assert [(r.raw, r.original, r.format, r.lossy, r.error is not None) for r in got.orderBy("ordinal").collect()] == want
    assert got.select("ordinal").distinct().count() == len(want) and got.select("source").distinct().count() == 1
    assert ranges.blocks_of(spark, [str(tmp_path / "a.json")], "}").select("start").distinct().count() >= 5


@pytest.mark.parametrize("text", ['{"Records":[{"eventName":"a"}', '{"Records":[{"eventName":"a"}]', '{"Records":[{"eventName":"a"}]}}', '[{"eventName":"a"},]', '[{"eventName":"a"} {"b":1}]',
                                  '{"Records":[{"a":1}],"Records":[{"a":2}]}', '[{"a":1}] x', '{"Records":[{"a":"unfinished}]}', "[{'a':1}]", '{"Events":[{"x":1}]}', "[1,,2]"])
def test_broken_files_are_errors_in_both(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert any(r[4] for r in read(spark, tmp_path))
    assert any(r[4] for r in read(spark, tmp_path, whole_bytes=1))


def test_rows_with_quoted_line_feeds(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    cells = ["a", 'say ""x""', "line\nfeed", "x,y", "", "é", "\r\n"]
    rows = ['Event name,"User\nname",Error code'] + [f'Put{k},"{rng.choice(cells)}{rng.choice(cells)}",{"a" * rng.randrange(30)}' for k in range(200)]
    for end in ("\r\n", ""):
        (tmp_path / "a.csv").write_bytes(("﻿" + "\r\n".join(rows) + end).encode())
        want = read(spark, tmp_path)
        assert len(want) == 200 and read(spark, tmp_path, whole_bytes=10) == want


def test_sums_compose():
    rng = random.Random(2)
    for _ in range(300):
        text = json.dumps([record(rng, k) for k in range(3)]) + record(rng, 4)
        cuts = sorted(rng.choice([k + 1 for k, c in enumerate(text) if c == "}"]) for _ in range(3))
        parts = [text[a:b].encode() for a, b in zip([0, *cuts], [*cuts, None])]
        for inside in (False, True):
            state = (inside, 0, [])
            for p in parts:
                state = ranges.composed(state, ranges.summed_json(p, state[0]))
            whole = ranges.summed_json(text.encode(), inside)
            assert (state[0], state[1], [b for b, _ in state[2]]) == (whole[0], whole[1], [b for b, _ in whole[2]])


@pytest.mark.parametrize("told_apart", [True, False])
def test_text_stays_where_it_is_read(spark, tmp_path, small_ranges, monkeypatch, told_apart):
    rng = random.Random(5)
    for name in "abc":
        (tmp_path / f"{name}.json").write_text('{"Records":[%s],"end":"}"}' % ",".join(record(rng, k) for k in range(40)))
    want = sorted(read(spark, tmp_path))
    monkeypatch.setattr(ranges, "_told_apart", lambda states: told_apart)
    got = readers.read_records(spark, str(tmp_path), whole_bytes=10)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    assert sorted((r.raw, r.original, r.format, r.lossy, r.error is not None) for r in got.collect()) == want
    assert {r.source for r in got.select("source").collect()} == {r.source for r in readers.read_records(spark, str(tmp_path)).select("source").collect()}


def test_marks_are_found_once_for_both_states(monkeypatch):
    rng, found = random.Random(6), []
    text = "".join(record(rng, k) for k in range(50)).encode()
    marked = ranges._marked
    monkeypatch.setattr(ranges, "_marked", lambda t: found.append(1) or marked(t))
    both = ranges.both_json(text)
    assert len(found) == 1 and both == [ranges.summed_json(text, False), ranges.summed_json(text, True)]


@pytest.mark.parametrize("text", [b'"', b'\\"', b'\\\\"', b'a\\\\\\"b"', b'"\\"\\\\"x\\', b"", b'\\\\\\\\""\\"'])
def test_quotes_behind_backslashes(text):
    want, run = [], 0
    for k, c in enumerate(text):
        if c == ord('"') and run % 2 == 0:
            want.append(k)
        run = run + 1 if c == ord("\\") else 0
    assert ranges._quotes(np.frombuffer(text, np.uint8)).tolist() == want
