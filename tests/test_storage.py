import gzip
import json
import threading

import pytest
from pyspark.sql import functions as F

from auditspark.model import Filter, Snapshot
from auditspark.operators import diff, investigate, maintain
from auditspark.plans.numbering import number_rows
from auditspark.session import small_table
from auditspark.sources import readers, sinks
from auditspark.sources.pointer import names_in
from auditspark.streaming import intake
from made_events import make_events

EXACT = '{"eventName":"A","eventID":"1","recipientAccountId":"9","eventTime":"2024-01-01T00:00:00Z","x":1.10,"y":1e400,"z":[ 1 , 2 ]}'
OTHER = '{"eventName":"B","eventID":"2","recipientAccountId":"9","eventTime":"2024-01-02T00:00:00Z"}'


def records(spark, folder):
    return readers.read_records(spark, str(folder)).orderBy("source", "ordinal").collect()


@pytest.mark.parametrize("name,content,raws", [
    ("a.json", '{"note":{"Records":[1]},"Records":[%s, %s]}' % (EXACT, OTHER), [EXACT, OTHER]),
    ("b.json", json.dumps({"Events": [{"CloudTrailEvent": EXACT}]}), [EXACT]), ("c.json", f"[{EXACT},\n{OTHER}]", [EXACT, OTHER]),
    ("d.json", EXACT, [EXACT]), ("e.ndjson", f"{EXACT}\n\n{OTHER}\n", [EXACT, OTHER]), ("f.json", f"{EXACT} {OTHER}[{EXACT}]", [EXACT, OTHER, EXACT]),
    ("g.gz", gzip.compress(f"[{EXACT}]".encode()), [EXACT]), ("h.json", gzip.compress(b"\xef\xbb\xbf" + OTHER.encode()), [OTHER])])
def test_json_shapes_keep_bytes(spark, tmp_path, name, content, raws):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    (tmp_path / "ignored.txt").write_text("x")
    rows = records(spark, tmp_path)
    assert [r.raw for r in rows] == raws and [r.original for r in rows] == raws
    assert [r.ordinal for r in rows] == list(range(1, len(raws) + 1)) and not any(r.lossy or r.error for r in rows)


def test_csv(spark, tmp_path):
    text = 'Event ID, EVENT TIME ,Event name,User name,AWS region,Error code\r\ne1,2024-01-01T00:00:00Z,"Put ""x""", ann ,eu-west-1,\r\ne2,,Get,,,"a\nb"\r\n'
    (tmp_path / "x.csv").write_bytes(text.encode())
    rows = records(spark, tmp_path)
    assert [json.loads(r.raw) for r in rows] == [
        {"eventID": "e1", "eventTime": "2024-01-01T00:00:00Z", "eventName": 'Put "x"', "awsRegion": "eu-west-1", "userIdentity": {"userName": "ann"}},
        {"eventID": "e2", "eventName": "Get", "errorCode": "a\nb"}]
    head, body = text.split("\r\n", 1)
    assert rows[0].original == head + "\r\n" + body.split("\r\n")[0] + "\r\n" and rows[0].lossy and rows[1].original.endswith('"a\nb"\r\n')


@pytest.mark.parametrize("content", [b"", b'{"Records":[{"eventName":"A"},', b'{"Records":[],"Records":[]}', b'{"Events":[{"x":1}]}', b"a,b\n1,2\n", b'{"a":1} x', b"\xff\xfe{", b"\x1f\x8bxx",
                                     b'{"Records":[]}', b'{"foo":1}', b"Event name\n", b'[{"eventName":"A"},{"noName":1}]', b'{"Records":[{"eventName":"A"}],}'])
def test_bad_input_publishes_nothing(spark, tmp_path, content):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_bytes(content)
    with pytest.raises(ValueError):
        maintain.import_dataset(readers.read_records(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        maintain.open_dataset(spark, str(tmp_path / "out"))


def test_import_append_snapshot_export(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(f"[{OTHER},{EXACT},{OTHER}]")
    home = str(tmp_path / "data")
    first = maintain.import_dataset(readers.read_records(spark, str(tmp_path / "in")), home)
    events, observations = maintain.open_dataset(spark, home)
    assert [(r.seq, r.eventName, r.raw) for r in events.orderBy("seq").collect()] == [(1, "A", EXACT), (2, "B", OTHER)]
    assert observations.count() == 3 and first.max_seq == 2
    variant = OTHER.replace('"B"', '"B2"')
    early = OTHER.replace('"2"', '"0"').replace("2024-01-02", "2023-01-01")
    lines = [(t, t, "live", i, "live", False, None) for i, t in enumerate([variant, early])]
    batch = small_table(spark, lines, "raw string, original string, source string, ordinal bigint, format string, lossy boolean, error string")
    for _ in range(2):  # a repeated batch changes nothing
        second = maintain.append_events(batch, home, "b1")
    events, observations = maintain.open_dataset(spark, home)
    assert {r.seq: r.eventName for r in events.collect()} == {1: "A", 2: "B", 3: "B"} and second.max_seq == 3
    stats = maintain.evidence_stats(events, observations).first().asDict()
    assert stats == {"events": 3, "observations": 5, "variantEvents": 1, "lossy": 0}
    assert maintain.open_dataset(spark, home, first)[0].count() == 2
    with pytest.raises(ValueError):
        maintain.append_events(batch.withColumn("raw", F.lit("{")), home, "b2")
    assert maintain.open_dataset(spark, home)[1].count() == 5
    assert sinks.export_matches(events, Filter(), second, str(tmp_path / "export")) == 3
    assert spark.read.text(str(tmp_path / "export" / "records")).count() == 3
    assert json.loads((tmp_path / "export" / "manifest.json").read_text())["count"] == 3
    with pytest.raises(ValueError):
        sinks.export_matches(events.withColumn("raw", F.lit("{")), None, second, str(tmp_path / "bad"))
    context = events.filter("seq = 2").select("seq")
    totals = sinks.export_bundle(context, events, observations, str(tmp_path / "bundle"))
    assert totals["copies"] == 3 and spark.read.parquet(str(tmp_path / "bundle" / "manifest")).first().variants == 2
    with pytest.raises(ValueError):
        sinks.export_bundle(context, events, observations.withColumn("original", F.lit("forged")), str(tmp_path / "forged"))
    fresh = maintain.import_dataset(readers.read_records(spark, str(tmp_path / "in")), home)
    with pytest.raises(ValueError):
        maintain.open_dataset(spark, home, Snapshot(first.generation, 2))
    assert maintain.open_dataset(spark, home, fresh)[0].count() == 2


def test_line_reader(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text("﻿" + EXACT + "\n" + OTHER + "\n")
    rows = readers.read_lines(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.raw for r in rows] == [EXACT, OTHER]


def test_numbering_is_dense_and_independent_of_partitions(spark):
    frame = spark.range(1000).select((F.col("id") % 7).cast("string").alias("a"), F.col("id").alias("b"))
    order = [F.col("a").asc(), F.col("b").desc()]
    runs = [[(r.seq, r.a, r.b) for r in number_rows(frame, order, "seq", 10, n).orderBy("seq").collect()] for n in (1, 6)]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == list(range(11, 1011))


def test_intake_stream(spark, tmp_path):
    bodies = [EXACT, '{"detail-type":"AWS API Call via CloudTrail","detail":%s}' % OTHER, json.dumps({"Type": "Notification", "Message": '{"detail":%s}' % EXACT}),
              '{"Records":[{"s3":{}}]}', "garbage", '{"detail":{"detail":{"detail":{"detail":%s}}}}' % EXACT]
    assert [readers.record_of(b) for b in bodies] == [EXACT, OTHER, EXACT, None, None, None]
    source, home, rejects = (str(tmp_path / n) for n in ("queue", "data", "rejects"))
    small_table(spark, [(b,) for b in bodies], "value string").coalesce(1).write.text(source)
    for _ in range(2):  # the second run has nothing new; both stop by themselves
        stream = intake.start_intake(spark.readStream.text(source), home, rejects, str(tmp_path / "progress"), availableNow=True)
        stream.awaitTermination(120)
        assert stream.exception() is None
    events, observations = maintain.open_dataset(spark, home)
    assert events.count() == 2 and observations.count() == 3
    assert spark.read.parquet(rejects + "/*").count() == 3
    again = json.loads((tmp_path / "progress" / "metadata").read_text())["id"]
    intake.intake_batch(small_table(spark, [(b,) for b in bodies], "value string"), 0, home, rejects, stream=again)
    assert maintain.open_dataset(spark, home)[1].count() == 3
    third = EXACT.replace('"1"', '"3"')
    small_table(spark, [(third,)], "value string").coalesce(1).write.mode("append").text(source + "2")
    stream = intake.start_intake(spark.readStream.text(source + "2"), home, rejects, str(tmp_path / "other"), availableNow=True)
    stream.awaitTermination(120)  # a second stream begins at batch 0 as well
    events, observations = maintain.open_dataset(spark, home)
    assert events.count() == 3 and observations.count() == 4 == observations.select("observationId").distinct().count()
    assert {r.rejects for r in intake.reject_counts(spark, rejects).collect()} == {3}


def test_a_second_writer_is_refused(spark, tmp_path):
    (tmp_path / "a.json").write_text(f"[{EXACT}]")
    home = str(tmp_path / "data")
    maintain.import_dataset(readers.read_records(spark, str(tmp_path / "a.json")), home)
    begun = maintain._state(spark, home)
    maintain.import_dataset(readers.read_records(spark, str(tmp_path / "a.json")), home)
    with pytest.raises(RuntimeError):
        maintain._commit(spark, home, {**begun, "max_seq": 9}, begun)
    assert maintain._state(spark, home)["version"] == 2 and maintain.open_dataset(spark, home)[0].count() == 1


def test_of_writers_at_the_same_time_one_succeeds(spark, tmp_path):
    """All start from the same version and none looks again before it publishes."""
    home = str(tmp_path / "data")
    outcomes = []

    def write(n):
        try:
            outcomes.append(maintain._commit(spark, home, {**maintain._empty_state(), "max_seq": n}, None).max_seq)
        except RuntimeError:
            outcomes.append(None)

    writers = [threading.Thread(target=write, args=(n,)) for n in range(1, 9)]
    [w.start() for w in writers], [w.join() for w in writers]
    assert len(outcomes) == 8 and sum(o is not None for o in outcomes) == 1
    assert maintain._state(spark, home)["max_seq"] == next(o for o in outcomes if o)
    assert names_in(spark, maintain.state_folder(home)) == ["000000000001"]


def lines_of(first, last):
    return [('{"eventName":"N","eventID":"n%d","recipientAccountId":"9","eventTime":"2024-01-%02dT00:00:00Z"}' % (k, 1 + k % 28),) for k in range(first, last)]


def as_records(spark, lines, source):
    return intake.batch_records(small_table(spark, lines, "raw string"), source)


def test_compaction_keeps_rows_and_numbers(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "data")
    maintain.import_dataset(as_records(spark, lines_of(0, 40), "a"), home)
    monkeypatch.setattr(maintain, "NAMES", 3)
    for k in range(5):
        maintain.append_events(as_records(spark, lines_of(30 + 5 * k, 45 + 5 * k), f"b{k}"), home, f"b{k}")
    state = maintain._state(spark, home)
    assert state["folded"] and len(state["names"]) < 4  # names moved into the key index, and are still known
    again = maintain.append_events(as_records(spark, lines_of(30, 45), "b0"), home, "b0")
    assert again.max_seq == 65 and maintain._state(spark, home)["version"] == state["version"]
    before = [sorted(map(tuple, t.drop("observedAt").select(*sorted(set(t.columns) - {"observedAt"})).collect()), key=repr) for t in maintain.open_dataset(spark, home)]
    assert len(before[0]) == 65 and len(before[1]) == 115
    assert maintain.compact_dataset(spark, home) == 6 and maintain.compact_dataset(spark, home) == 0
    events, observations = maintain.open_dataset(spark, home)
    after = [sorted(map(tuple, t.select(*sorted(set(t.columns) - {"observedAt"})).collect()), key=repr) for t in (events, observations)]
    assert after == before and sorted(r.seq for r in events.collect()) == list(range(1, 66))
    assert len({f.rsplit("/part=", 1)[1].split("/")[0] for f in events.inputFiles()}) == 1
    assert maintain.append_events(as_records(spark, lines_of(60, 70), "c"), home).max_seq == 70


def test_copies_of_a_known_key_are_not_parsed_and_ties_give_one_event(spark):
    text = '{"eventName":"N","eventID":"1","recipientAccountId":"9"}'
    rows = maintain.observations_of(small_table(spark, [(text, text, "s", 1)] * 3 + [(text + " ", text + " ", "s", 2)], "raw string, original string, source string, ordinal bigint"))
    assert [(r.seq, r.raw) for r in maintain.new_events(rows, None, 5).collect()] == [(6, text)]
    assert maintain.new_events(rows, None, 5, rows.select("eventKey")).count() == 0


@pytest.mark.parametrize("line", [f"{EXACT} {OTHER}", f"{EXACT} trailing", f"{EXACT},{OTHER}"])
def test_lines_with_more_than_one_value_are_refused(spark, tmp_path, line):
    (tmp_path / "x.ndjson").write_text(OTHER + "\n" + line + "\n")
    with pytest.raises(ValueError):
        maintain.import_dataset(readers.read_lines(spark, str(tmp_path / "x.ndjson")), str(tmp_path / "out"))


def test_export_gives_records_back(spark, tmp_path):
    texts = [EXACT, OTHER.replace(",", ",\r\n", 1)]
    events = small_table(spark, [(k, t) for k, t in enumerate(texts)], "seq bigint, raw string")
    sinks.export_matches(events, None, Snapshot("g", 5), str(tmp_path / "out"))
    assert sorted(r.raw for r in sinks.exported(spark, str(tmp_path / "out")).collect()) == sorted(texts)


def test_long_values_that_differ_late(spark):
    left, right = (json.dumps({"a": "x" * 600 + end}) for end in "pq")
    changes = diff.diff_versions(small_table(spark, [(1, left, right)], "pair bigint, left string, right string"))
    assert changes.filter("left <> right").count() == 1 and diff.previewed(changes).filter("leftTruncated").count() == 1


def test_differences(spark):
    left = '{"a":1.10,"b":[1,{"c":true}],"d":{"e":"x"},"g":null,"s":"q","same":{"y":1,"z":2}}'
    right = '{"s":"r","a":1.1,"b":[1,{"c":false},3],"d":[1],"f/~":{"deep":{"x":1}},"same":{"z":2,"y":1}}'
    rows = diff.diff_versions(small_table(spark, [(1, left, right), (2, "[1]", '"x"'), (3, left, left)], "pair bigint, left string, right string")).collect()
    got = {(r.pair, r.path): (r.change, r.left, r.right) for r in rows}
    assert got == {
        (1, "/a"): ("changed", "1.10", "1.1"), (1, "/b/1/c"): ("changed", "true", "false"), (1, "/b/2"): ("added", "Not present", "3"),
        (1, "/d"): ("changed", "Object · 1 fields", "Array · 1 items"), (1, "/f~1~0"): ("added", "Not present", "Object · 1 fields"),
        (1, "/g"): ("removed", "null", "Not present"), (1, "/s"): ("changed", '"q"', '"r"'), (2, "(root)"): ("changed", "Array · 1 items", '"x"')}


def test_dense_context_keeps_the_closest(spark):
    """A window holding most of the table: the closest are exact although pairs are never expanded."""
    events = make_events(spark, [{"eventID": f"e{i}", "eventName": "A", "eventTime": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}.000Z",
                                  "userIdentity": {"arn": "arn:hot" if i % 3 else "arn:cold"}} for i in range(900)])
    anchors = events.filter(F.col("seq").isin(1, 450)).select("seq")
    for relation, fits in (("all", lambda i: True), ("principal", lambda i: i % 3 == 2 or i % 3 == 1)):
        rows = investigate.surrounding(events, anchors, 10, relation, 20).filter("anchor = 450").collect()
        mine = [i for i in range(900) if bool(i % 3) == bool(449 % 3) or relation == "all"]
        want = sorted(mine, key=lambda i: (i != 449, abs(i - 449), i))[:20]
        assert sorted(r.seq - 1 for r in rows) == sorted(want)
    with pytest.raises(ValueError):
        investigate.surrounding(events, anchors, 61)


def test_every_view_can_be_read(spark, tmp_path):
    from auditspark.plans.views import register_views
    (tmp_path / "a.json").write_text(f"[{OTHER},{EXACT},{OTHER}]")
    maintain.import_dataset(readers.read_records(spark, str(tmp_path / "a.json")), str(tmp_path / "data"))
    names = register_views(spark, *maintain.open_dataset(spark, str(tmp_path / "data")), prefix="t_")
    counts = {name: spark.sql(f"SELECT * FROM {name}").count() for name in names}
    assert counts["t_events"] == 2 and counts["t_observations"] == 3 and counts["t_search_stats"] == 1


def test_tables_of_a_bundle_come_from_the_stored_copies(spark, tmp_path):
    small_table(spark, [(1, "k1", "h", "{}"), (2, "k2", "h", "{}")], "seq bigint, eventKey string, evidenceHash string, raw string").write.parquet(str(tmp_path / "events"))
    small_table(spark, [("k1", "h", "{}", "{}"), ("k1", "i", "{ }", "{ }"), ("k2", "h", "{}", "{}")], "eventKey string, sha256 string, raw string, original string") \
        .write.parquet(str(tmp_path / "copies"))
    events, copies = (spark.read.parquet(str(tmp_path / name)) for name in ("events", "copies"))
    tables = sinks.bundle_tables(events.filter("seq = 1").select("seq"), events, copies, store=True)
    assert {name: table.inputFiles() for name, table in tables.items()} == {"events": [], "sources": [], "manifest": []}
    assert tables["manifest"].select("seq", "copies", "variants", "displayed").collect() == [(1, 2, 2, 1)]
