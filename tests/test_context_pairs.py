"""Events around anchors: reasons are made where an anchor meets an event, and a pair moves once."""

from pyspark.sql import functions as F

from auditspark.operators import investigate
from made_events import make_events


def _records():
    """Dense moments, shared keys of every kind, some recorded twice in one window."""
    out = []
    for i in range(120):
        minute, second = divmod(i // 6 * 40, 60)
        out.append({"eventID": f"e{i}", "eventName": f"N{i % 3}", "eventSource": f"s{i % 2}", "awsRegion": "r", "recipientAccountId": "1",
                    "eventTime": f"2024-01-01T00:{minute:02d}:{second:02d}Z", "sourceIPAddress": f"10.0.0.{i % 5}" if i % 4 else "host",
                    "sharedEventID": f"sh{i % 7}" if i % 2 else "", "requestID": f"rq{i // 12}",
                    "userIdentity": {"arn": f"a{i % 9}" if i % 9 else None, "accessKeyId": f"k{i % 4}"},
                    "resources": [{"ARN": f"arn:aws:x:::{i % 11}"}, {"ARN": f"arn:aws:x:::{i % 8}"}]})
    return out


def _reasons(a, e):
    same = lambda *names: all(a.get(n) and a.get(n) == e.get(n) for n in names)
    who = lambda r: (r["userIdentity"]["accessKeyId"], r["userIdentity"]["arn"])
    found = [("shared", a["sharedEventID"])] if same("sharedEventID", "eventSource", "eventName") else []
    found += [("request", a["requestID"])] if same("requestID", "eventSource", "eventName", "recipientAccountId", "awsRegion") else []
    if who(a)[1] and who(a)[1] == who(e)[1]:
        found += [("credential", who(a)[0])] if who(a) == who(e) else [("principal", who(a)[1])]
    names = lambda r: {x["ARN"] for x in r["resources"]}
    found += [("resource", n) for n in sorted(names(a) & names(e))]
    found += [("ip", a["sourceIPAddress"])] if a["sourceIPAddress"] != "host" and same("sourceIPAddress") else []
    return found


def _expected(records, anchors, minutes, related, cap):
    ms = lambda r: int(r["eventTime"][14:16]) * 60_000 + int(r["eventTime"][17:19]) * 1000
    out = set()
    for a in anchors:
        own = records[a - 1]
        rows = [(s, r) for s, r in enumerate(records, 1) if abs(ms(r) - ms(own)) <= minutes * 60_000 and (s == a or not related or _reasons(own, r))]
        rows.sort(key=lambda x: (x[0] != a, abs(ms(x[1]) - ms(own)), ms(x[1]), x[0]))
        for rank, (s, r) in enumerate(rows[:cap], 1):
            out.add((a, s, rank, ((("anchor", ""),) if s == a else tuple(_reasons(own, r)) or (("time", ""),)), len(rows) > cap))
    return out


def _rows(frame):
    return [(r.anchor, r.seq, r["rank"], tuple((x["kind"], x["value"]) for x in r.reasons), r.truncated) for r in frame.collect()]


def test_closest_events_and_reasons(spark):
    records, wanted = _records(), [1, 14, 60, 61, 77, 120]
    events = make_events(spark, records).cache()
    anchors = events.filter(F.col("seq").isin(wanted)).select("seq")
    for minutes, relation, cap in ((1, "all", 5), (3, "all", 500), (3, "related", 4), (60, "related", 500)):
        got = _rows(investigate.surrounding(events, anchors, minutes, relation, cap))
        assert len(got) == len(set(got)) and set(got) == _expected(records, wanted, minutes, relation == "related", cap), (minutes, relation, cap)


def test_rows_of_a_repeated_seq_are_all_compared(spark):
    events = make_events(spark, _records()[:30]).cache()
    anchors = events.filter("seq = 7").select("seq")
    once = _rows(investigate.surrounding(events, anchors, 1, "all", 500))
    twice = _rows(investigate.surrounding(events.unionByName(events.filter("seq = 8")), anchors, 1, "all", 500))
    assert sorted(twice) == sorted(once + [r for r in once if r[1] == 8])


def test_pairs_are_not_joined_again(spark):
    """Compared columns move once per event: above the choice of the closest nothing is joined."""
    events = make_events(spark, _records())
    for relation in ("all", "related"):
        plan = investigate.surrounding(events, events.filter("seq < 9").select("seq"), 3, relation, 5)._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" in plan and "Join" not in plan[:plan.index("row_number")], plan
