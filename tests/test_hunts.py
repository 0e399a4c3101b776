import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import hunts
from auditspark.session import small_table
from made_events import make_events

SCHEMA = "seq bigint, identityArn string, accessKeyId string, eventMs bigint, eventName string"


def brute_force(rows, steps, key, window):
    """Closest strictly earlier completed chain per step, computed on plain lists."""
    rows = [r for r in rows if r[3] is not None and all(key(r))]
    stage = {}
    for i, step in enumerate(steps):
        hits = [r for r in rows if r[4] in step]
        last, found = i == len(steps) - 1, {}
        groups = {}
        for r in hits:
            groups.setdefault((key(r), r[3]) if not last else (key(r), r[3], r[0]), []).append(r)
        for g, tied in groups.items():
            seq, ms, n = max(r[0] for r in tied), g[1], len(tied) if not last else 1
            if i == 0:
                found[g] = (ms, [seq], [n])
                continue
            earlier = [(e[1], chain) for e, chain in stage.items() if e[0] == g[0] and e[1] < ms]
            if earlier:
                first, seqs, ties = max(earlier, key=lambda x: x[0])[1]
                if ms - first <= window:
                    found[g] = (first, seqs + [seq], ties + [n])
        stage = found
    return sorted((g[2], c[0], g[1], tuple(c[1]), tuple(c[2])) for g, c in stage.items())


@pytest.mark.parametrize("steps,group,minutes", [
    (["a", "b"], "principal", 1), (["a", "ab", "b"], "principal", 2), (["ab", "ab", "c", "a"], "credential", 3), (["a", "b", "c", "a", "bc"], "principal", 5)])
def test_sequences_match_brute_force(spark, steps, group, minutes):
    rng = random.Random(minutes)
    rows = [(i, rng.choice(["x", "x", "x", "y", "", None]), rng.choice(["k", "l", None]),
             rng.choice([None] + [t * 1000 for t in range(0, 1200, 7)]), rng.choice("abc")) for i in range(700)]
    key = (lambda r: (r[1],)) if group == "principal" else (lambda r: (r[1], r[2]))
    frame = small_table(spark, rows, SCHEMA)
    found = hunts.match_sequence(frame, [F.col("eventName").isin(*s) for s in steps], group, minutes)
    got = sorted((r.seq, r.firstMs, r.endMs, tuple(r.seqs), tuple(r.ties)) for r in found.collect())
    assert got == brute_force(rows, [set(s) for s in steps], key, minutes * 60_000)


def test_window_edge_and_equal_times(spark):
    rows = [(1, "p", "k", 0, "a"), (2, "p", "k", 60_000, "b"), (3, "p", "k", 60_001, "b"), (4, "p", "k", 0, "b"), (5, "q", "k", 10, "b")]
    found = hunts.match_sequence(small_table(spark, rows, SCHEMA), [F.col("eventName") == "a", F.col("eventName") == "b"], "principal", 1)
    assert [r.seq for r in found.collect()] == [2]


def test_five_steps_on_twenty_thousand_events(spark):
    """100 identities, every event matches every step: all but the first four of each end a sequence."""
    rows = spark.range(20_000).select(
        F.col("id").alias("seq"), F.concat(F.lit("arn:"), (F.col("id") % 100).cast("string")).alias("identityArn"), F.lit("k").alias("accessKeyId"),
        (F.col("id") * 1000).alias("eventMs"), F.lit("a").alias("eventName"))
    found = hunts.match_sequence(rows, [F.lit(True)] * 5, "principal", 1440)
    page = hunts.newest_sequences(found)
    assert page.count() == 500 and page.first().total == 19_600


def test_hot_identity_is_split_over_slices(spark):
    rows = spark.range(5000).select(F.col("id").alias("seq"), F.lit("hot").alias("identityArn"), F.lit("k").alias("accessKeyId"),
                                    (F.col("id") * 30_000).alias("eventMs"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("eventName"))
    found = hunts.match_sequence(rows, [F.col("eventName") == "a", F.col("eventName") == "b"], "principal", 5)
    assert found.count() == 2500
    assert found.filter(F.col("deltaMs") != 30_000).isEmpty()


def test_bad_sequences_raise(spark):
    rows = small_table(spark, [], SCHEMA)
    for steps, group, minutes in (([F.lit(True)], "principal", 5), ([F.lit(True)] * 6, "principal", 5), ([F.lit(True)] * 2, "who", 5), ([F.lit(True)] * 2, "principal", 0)):
        with pytest.raises(ValueError):
            hunts.match_sequence(rows, steps, group, minutes)


def test_indicator_validation_and_match(spark):
    wanted = [(1, "ip", "2001:DB8::1"), (2, "cidr", "10.1.2.3/8"), (3, "key", "AKIA1"), (4, "event", "e2"), (5, "arn", "arn:aws:s3:::b"),
              (6, "ip", "10.1.2.3/8"), (7, "key", "bad key"), (8, "arn", "bucket"), (9, "ip", "fe80::1%1"), (10, "cidr", "10.9.9.9/8"), (11, "what", "x")]
    indicators = small_table(spark, wanted, "indicator_id bigint, kind string, value string")
    valid = {r.indicator_id: r.canonical for r in hunts.validate_indicators(indicators).filter("valid").collect()}
    assert valid == {1: "2001:db8::1", 2: "10.0.0.0/8", 3: "AKIA1", 4: "e2", 5: "arn:aws:s3:::b", 10: "10.0.0.0/8"}
    events = make_events(spark, [
        {"eventID": "e1", "sourceIPAddress": "2001:db8:0::1", "userIdentity": {"accessKeyId": "AKIA1"}, "requestParameters": {"b": "arn:aws:s3:::b"}},
        {"eventID": "e2", "sourceIPAddress": "10.255.0.1", "resources": [{"ARN": "arn:aws:s3:::b"}, {"ARN": "arn:aws:s3:::b"}]},
        {"eventID": "e3", "sourceIPAddress": "::ffff:10.0.0.1", "userIdentity": {"accessKeyId": "akia1"}}])
    got = {r.eventID: r.indicators for r in hunts.match_indicators(events, indicators).collect()}
    assert got == {"e1": [1, 3, 5], "e2": [2, 4, 5]}


def test_nested_networks_of_both_families(spark):
    """Every address against every network, one by one."""
    rng = random.Random(9)
    v4 = [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(300)] + ["0.0.0.0", "255.255.255.255", "10.0.255.255", "10.1.0.0", "11.0.0.0"]
    v6 = [str(ipaddress.ip_address((0x20010DB8 << 96) + (rng.randrange(3) << 64) + rng.randrange(1 << rng.choice([4, 20, 64])))) for _ in range(200)] + ["::", "2001:db9::", "::ffff:10.0.0.1"]
    nets = {str(ipaddress.ip_network((rng.choice(v4), rng.randrange(8, 33)), strict=False)) for _ in range(80)} | {str(ipaddress.ip_network((rng.choice(v6), rng.randrange(16, 129)), strict=False)) for _ in range(80)}
    nets = sorted(nets | {"0.0.0.0/0", "::/0", "10.0.0.0/8", "10.0.0.0/16", "10.0.0.0/17", "10.0.128.0/17", "255.255.255.255/32", "2001:db8::/33"})
    indicators = small_table(spark, [(k, "cidr", n) for k, n in enumerate(nets)], "indicator_id bigint, kind string, value string")
    keys = hunts.indicator_keys(indicators).select("indicator_id", "netHex", "netBits")
    addresses = small_table(spark, [(a,) for a in [*v4, *v6, "host.example.com", None, "10.1.2.3"]], "sourceIPAddress string")
    want = sorted((a, k) for a in {*v4, *v6, "10.1.2.3"} for k, n in enumerate(nets) if ipaddress.ip_address(a) in ipaddress.ip_network(n))
    assert sorted((r.sourceIPAddress, r.indicator_id) for r in hunts.networks_of(addresses, keys).collect()) == want
    assert hunts.networks_of(addresses, keys.limit(0)).count() == 0 and hunts.networks_of(addresses.limit(0), keys).count() == 0
