"""A file is read as a stream: what is held does not grow with its text."""

import gzip
import json
import tracemalloc

import pytest

from auditspark.sources import readers

RECORD = json.dumps({"eventName": "n", "note": "}]" * 400, "n": 1.5e10})
SHAPES = {
    "single": ("", RECORD, "\n", ""), "records": ('{"note":{"Records":[1]},"Records":[', RECORD, ",\n ", '],"end":1}'), "bare": ("[", RECORD, ",", "]"),
    "history": ('{"Events":[', json.dumps({"CloudTrailEvent": RECORD}), ",", "]}"), "console": ("Event name,User name\n", '"n","%s"' % ("x" * 800), "\n", "\n"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_memory_does_not_grow_with_the_text_of_a_file(shape, monkeypatch):
    monkeypatch.setattr(readers, "BLOCK_CHARS", 1 << 14)
    before, record, between, after = SHAPES[shape]
    held = []
    for count in (300, 1_500):
        content = gzip.compress((before + between.join([record] * count) + after).encode())
        tracemalloc.start()
        found = sum(row[-1] is None for row in readers.split_content(content, "s"))
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == count
    assert held[1] < 1.3 * held[0] and held[1] < 800_000


@pytest.mark.parametrize("block", (1, 2, 3, 7, 50))
@pytest.mark.parametrize("text", [
    '[1,2.5e10,-3,"a\\u00e9",true,null,{"a":1e+5},NaN,-Infinity,[]]', '{"a":"x"} {"Records":[{"b":[]},{}],"c":12}\n{"Events":[{"CloudTrailEvent":"{}"}]}[]12',
    '{"Records":[{"a":1},]}', '{"Records":[{"a":"b', 'Event name,User name\r\n"a\nb","é"\r\n\r\nc,d\n', "﻿ [ ]", '{"a":tru}'])
def test_blocks_of_any_size_give_the_same_records(monkeypatch, text, block):
    want = list(readers.split_content(text.encode(), "s"))
    monkeypatch.setattr(readers, "BLOCK_CHARS", block)
    assert list(readers.split_content(gzip.compress(text.encode()), "s")) == want
