import ipaddress
import json
import random
import sys
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from auditspark.functions.network import in_network, ip_hex
from auditspark.functions.numbers import number_doubt, number_matches
from auditspark.functions.times import event_ms, evidence_ms
from auditspark.session import small_table


def _address(text):
    try:
        found = ipaddress.ip_address(text)
    except ValueError:
        return None
    return None if "%" in text else found


def _samples(rng):
    fixed = ["", "::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":::", "::ffff:1.2.3.4", "::1.2.3.256",
             "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "01.2.3.4", "1.2.3", "12345::", ":1:2:3:4:5:6:7", "1.2.3.4:", "::1.2.3.4:5",
             "0:0::0:0:0:0:0", ":0:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:0:", "1:2:3:4:5:6:7:8:", "1:2:3:4::5:6:7:8", "1.1.1.1\n", "ec2.amazonaws.com"]
    for _ in range(800):
        n = rng.getrandbits(128) & rng.getrandbits(128) if rng.random() < .5 else rng.getrandbits(128)
        text = rng.choice([str(ipaddress.ip_address(n)), ipaddress.IPv6Address(n).exploded, str(ipaddress.IPv4Address(n >> 96))])
        if rng.random() < .4:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(":0af.1") + text[at + 1:]
        fixed.append(text)
    return fixed


def test_addresses_match_ipaddress(spark):
    texts = _samples(random.Random(3))
    rows = small_table(spark, [(t,) for t in texts], "t string").select("t", ip_hex(F.col("t")).alias("h")).collect()
    for row in rows:
        want = _address(row.t)
        assert row.h == (None if want is None else f"{int(want):0{8 if want.version == 4 else 32}x}"), row.t


def test_networks_match_ipaddress(spark):
    rng = random.Random(4)
    texts = [t for t in _samples(rng) if _address(t)]
    nets = ["10.0.0.0/8", "0.0.0.0/0", "::/0", "128.0.0.0/1", "1.2.3.4"] + [f"{rng.choice(texts)}/{rng.randrange(0, 33)}" for _ in range(6)]
    frame = small_table(spark, [(t,) for t in texts], "t string").select("t", *[in_network(F.col("t"), n).alias(f"n{i}") for i, n in enumerate(nets)])
    for row in frame.collect():
        for i, n in enumerate(nets):
            assert row[f"n{i}"] == (_address(row.t) in ipaddress.ip_network(n, strict=False)), (row.t, n)


def test_numbers_match_fractions(spark):
    rng = random.Random(5)
    texts = ["9007199254740993", "9007199254740992", "1.10", "1.1", "1e400", "-0", "0.1", "1e-20", "12345678901234567890123456789012345678901.5",
             "0.12345678901234567890123456789012345678901", "100", "1E2", "1.5"] + [str(rng.randrange(-10**18, 10**18)) for _ in range(20)]
    bodies = [f'{{"a":{{"n":{t}}}}}' for t in texts] + [f'{{"a":{{"n":"{t}"}}}}' for t in texts] + ['{"a":{"n":"x"}}', '{"a":{}}', '{"a":{"n":true}}', '{"a":null}']
    frame = small_table(spark, [(b,) for b in bodies], "raw string")
    for literal in ("9007199254740992", "1.1", "1e2", "0.1234567890123456789012345678901234567890100001"):
        for op, test in (("eq", Fraction.__eq__), ("gt", Fraction.__gt__), ("lte", Fraction.__le__)):
            got = {r.raw for r in frame.filter(number_matches("a.n", op, literal)).collect()}
            want = {b for b, t in zip(bodies, texts + texts) if test(Fraction(t), Fraction(literal))}
            assert got == want, (literal, op)


def test_numbers_of_any_length(spark):
    """Long digits, far exponents, records whose other members are such numbers, and strings that look like marks."""
    long, far = "7" * 5000, "1e5000"
    values = [long, "-" + long, "0." + long, far, "-1e5000", "1e-5000", "1E+5000", "10e4999", "1e5001", "0e99999", "1e99999999999999999999999", "1e-99999999999999999999999", "5", "-5", "5.0"]
    bodies = [f'{{"a":{{"n":{v},"q":"\\"1,2\\\\"}},"b":[1e5000,{{"n":2}}]}}' for v in values]
    bodies += ['{"a":{"n":"%s"},"z":1e5000}' % v for v in values] + ['{"a":{"n":"#5"},"z":1e5000}', '{"a":{"n":"x:5,"},"z":1e5000}', '{"a":{"n":[5]},"z":%s}' % long, '{"a":null,"z":1e5000}']
    frame = small_table(spark, [(b,) for b in bodies], "raw string")

    sys.set_int_max_str_digits(20_000)

    def value(text):
        number, _, power = text.lower().partition("e")
        return Fraction(number) * Fraction(10) ** max(-10_000, min(10_000, int(power[:9] or 0)))

    for literal in ("5", "0", "-1", far, "1e4999", long, "1e-5000", "-" + long):
        for op, test in (("eq", Fraction.__eq__), ("gt", Fraction.__gt__), ("lt", Fraction.__lt__), ("gte", Fraction.__ge__)):
            got = {r.raw for r in frame.filter(number_matches("a.n", op, literal)).collect()}
            want = {b for b, v in zip(bodies, values + values) if test(value(v), value(literal))}
            assert got == want, (literal[:9], op)
    assert frame.filter(number_doubt().isNotNull()).count() == 0
    plan = frame.filter(number_matches("a.n", "gt", far))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_numbers_of_resources(spark):
    bodies = ['{"resources":[{"n":"7"},{"n":9}]}', '{"resources":{"n":9.0}}', '{"resources":[{"n":[9]},9]}', '{"resources":[{"n":9e0},{"n":1e5000}]}', '{"resources":[{"n":1e5000}]}', '{"resources":[]}', '{}']
    frame = small_table(spark, [(b,) for b in bodies], "raw string")
    assert [bodies.index(r.raw) for r in frame.filter(number_matches("resources.n", "eq", "9")).collect()] == [0, 1, 3]
    assert [bodies.index(r.raw) for r in frame.filter(number_matches("resources.n", "gt", "10")).collect()] == [3, 4]


def test_doubled_members_and_broken_texts_are_listed(spark):
    rows = small_table(spark, [('{"a":1,"a":2}',), ('{"a":1}',), ('{"a":1,',), ('{"a":1,"b":{"c":1e5000,"c":2}}',), (None,)], "raw string").select(
        number_matches("a", "eq", "1").alias("hit"), number_doubt().alias("doubt")).collect()
    assert [(r.hit, (r.doubt or "")[:8]) for r in rows] == [(False, "a member"), (True, ""), (False, "the text"), (False, "a member"), (False, "")]
    for field, literal in (("a", "many"), ("a", "1e9999999999999999999999"), ('a"b', "1")):
        with pytest.raises(ValueError):
            number_matches(field, "gt", literal)


def test_times(spark):
    texts = {"2024-01-01T00:00:00Z": 1704067200000, "2024-01-01T00:00:00.123456Z": 1704067200123, "2024-01-01T05:00:00+05:00": 1704067200000,
             "2025": None, "": None, "soon": None, "2024-13-01T00:00:00Z": None}
    console = {"Jan 1, 2024, 1:02:03 PM": 1704114123000, "Jan 1, 2024 1:02:03 PM": 1704114123000, "Jan 1, 2024, 13:02:03": 1704114123000}
    rows = small_table(spark, [(t,) for t in [*texts, *console]], "t string").select("t", event_ms(F.col("t")).alias("e"), evidence_ms(F.col("t")).alias("v")).collect()
    assert {r.t: r.e for r in rows if r.t in texts} == texts
    assert {r.t: r.v for r in rows if r.t in console} == console


def test_path_counts_merge_over_tasks_and_trees(spark):
    from collections import Counter
    from auditspark.functions.flatten import field_rows, path_counts
    texts = ['{"a":{"b/c":[1,{"x":null}]},"~":"q"}', '{"a":null,"b":[]}', "[1,2]", '"s"', '{"a":{"b/c":{"0":1.5}}}'] * 20 + [json.dumps({f"k{k}": {"v": k}}) for k in range(50)]
    frame = small_table(spark, [(t,) for t in texts] + [(None,)], "raw string").repartition(3)
    want, nulls, children, kinds = Counter(), Counter(), Counter(), {}
    for t in texts:
        for path, _, kind, _, n in field_rows(t):
            want[path] += 1
            nulls[path] += kind == "null"
            children[path] += n
            kinds.setdefault(path, set()).add(kind)
    for most in (200_000, 5):
        got = path_counts(frame, most=most).groupBy("path").agg(F.sum("rows").alias("r"), F.sum("nulls").alias("n"), F.sum("children").alias("c"), F.flatten(F.collect_list("kinds")).alias("k")).collect()
        assert {r.path: (r.r, r.n, r.c, set(r.k)) for r in got} == {p: (want[p], nulls[p], children[p], kinds[p]) for p in want}
    assert path_counts(frame).count() <= 3 * len(want)


def test_a_long_number_is_taken_apart_once_and_predicates_share_the_parsed_record(spark):
    from auditspark.functions.numbers import number_doubt, number_matches, spelled_copy
    from auditspark.functions.records import variant
    texts = ['{"n":' + "7" * 400 + "}", '{"n":1e5000}', '{"n":5,"n":9}', '{"n":"-0.050"}', '{"n":"x.5e1"}', '{"n":0e9}', "{", None, '{"n":-12.5E+3}']
    rows = small_table(spark, list(enumerate(texts)), "i int, raw string")
    made = rows.withColumns({"parsed": variant("raw"), "copied": spelled_copy("raw")})
    both = {"parsed": F.col("parsed"), "copied": F.col("copied")}
    tests = [("gt", "5"), ("eq", "7" * 400), ("lt", "0"), ("lte", "-0.05"), ("gte", "0"), ("eq", "-12500")]
    wanted = [(True, True, False, False, True, False), (True, False, False, False, True, False), (False,) * 6, (False, False, True, True, False, False),
              (False,) * 6, (False, False, False, False, True, False), (False,) * 6, (False,) * 6, (False, False, True, True, False, True)]
    for frame, given in ((rows, {}), (made, both)):
        found = frame.select("i", *[number_matches("n", op, n, **given).alias(f"t{k}") for k, (op, n) in enumerate(tests)],
                             number_doubt(**given).isNotNull().alias("doubt")).orderBy("i").collect()
        assert [tuple(r)[1:-1] for r in found] == wanted
        assert [r["doubt"] for r in found] == [False, False, True, False, False, False, True, False, False]
    # what is taken apart is named once: the plan does not repeat the patterns for every use of the digits
    plan = rows.select(number_matches("n", "gt", "5"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract") <= 12
