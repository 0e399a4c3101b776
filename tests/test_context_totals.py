"""Totals of linked events: exact for events linked by several keys, and no row per anchor and event."""

import datetime
import random

import pytest
from made_events import make_events
from pyspark.sql import functions as F

from auditspark.operators import investigate

START = datetime.datetime(2024, 1, 1)


def _record(n, minute, who, ip, arns=(), key="K"):
    return {"eventID": f"e{n}", "eventTime": (START + datetime.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ"), "eventName": "N", "eventSource": "s",
            "sourceIPAddress": ip, "userIdentity": {"arn": who, "accessKeyId": key}, "resources": [{"ARN": a} for a in arns]}


def _arn(n):
    return f"arn:aws:s3:::b{n}"


@pytest.mark.parametrize("most_keys", [1, 3, 8])
def test_events_linked_by_several_keys_count_once(spark, most_keys):
    rng = random.Random(5)
    records = [_record(n, rng.randrange(40), f"p{rng.randrange(3)}" if rng.random() < .8 else None, f"10.0.0.{rng.randrange(3)}" if rng.random() < .8 else "x.com",
                       rng.sample([_arn(i) for i in range(6)], rng.randrange(5)), f"K{rng.randrange(2)}") for n in range(40)]
    events = make_events(spark, records).cache()
    anchors = events.filter("seq % 3 = 0").select("seq")
    totals = {r["anchor"]: r["total"] for r in investigate.context_totals(events, anchors, 10, "related", most_keys).collect()}

    def linked(a, b):
        one, two = a["userIdentity"]["arn"], a["sourceIPAddress"]
        return (one and one == b["userIdentity"]["arn"]) or (two != "x.com" and two == b["sourceIPAddress"]) \
            or {r["ARN"] for r in a["resources"]} & {r["ARN"] for r in b["resources"]}

    minute = lambda r: datetime.datetime.strptime(r["eventTime"], "%Y-%m-%dT%H:%M:%SZ")
    near = lambda a, b: abs(minute(a) - minute(b)) <= datetime.timedelta(minutes=10)
    wanted = {i + 1: max(1, sum(1 for b in records if near(a, b) and (a is b or linked(a, b)))) for i, a in enumerate(records) if (i + 1) % 3 == 0}
    assert totals == wanted


def test_rows_grow_with_anchors_and_not_with_the_events_of_a_key(spark, monkeypatch):
    # one principal, and every event with an address and a resource of its own
    events = make_events(spark, [_record(n, 1, "p", f"10.0.1.{n}", [_arn(n)]) for n in range(60)])
    asked = []
    keep = investigate._events_between
    monkeypatch.setattr(investigate, "_events_between", lambda listed, wanted, *rest: asked.append(wanted.count()) or keep(listed, wanted, *rest))
    totals = investigate.context_totals(events, events.filter("seq <= 20").select("seq"), 5, "related").agg(F.min("total"), F.max("total"), F.count(F.lit(1))).first()
    assert tuple(totals) == (60, 60, 20)
    assert asked == [20 * 7]  # the parts of three keys


def test_events_of_a_moment_are_one_row(spark, monkeypatch):
    events = make_events(spark, [_record(n, 1, "p", f"10.0.1.{n}") for n in range(60)] + [_record(60, 4, "p", "10.0.2.1"), _record(61, 9, "p", "10.0.2.1")])
    lines, keep = [], investigate.checkpoint
    monkeypatch.setattr(investigate, "checkpoint", lambda rows: (lines.append(rows.count()) if "slice" in rows.columns else None) or keep(rows))
    totals = investigate.context_totals(events, events.filter("seq <= 20 OR seq >= 61").select("seq"), 5, "all").collect()
    assert {r["anchor"]: r["total"] for r in totals} == {**{n: 61 for n in range(1, 21)}, 61: 62, 62: 2}
    assert lines == [3 + 2 * 3]  # three moments, and the ends of three windows
