import pytest

from auditspark.functions.text import java_regex
from auditspark.model import Filter
from auditspark.operators.search import apply_filter, expr_column
from made_events import make_events

RECORDS = [
    {"eventID": "a", "eventName": "GetObject", "awsRegion": "eu-west-1", "eventTime": "2024-01-01T00:00:00Z", "readOnly": True,
     "userIdentity": {"type": "IAMUser", "userName": "Ann_1", "arn": "arn:aws:iam::1:user/Ann_1"}},
    {"eventID": "b", "eventName": "PutObject", "awsRegion": "", "eventTime": "2024-01-01T00:00:01.500Z", "errorCode": "AccessDenied",
     "errorMessage": "line one\nline two", "userIdentity": {"type": "Root", "arn": "arn:aws:iam::1:root"}},
    {"eventID": "c", "eventName": "It's 100% *odd*", "eventTime": "2025", "userIdentity": {"type": "AssumedRole", "arn": "arn:aws:sts::1:assumed-role/r/s",
     "principalId": "X:s", "sessionContext": {"sessionIssuer": {"userName": "r", "arn": "arn:aws:iam::1:role/r"}}}},
    {"eventID": "d", "eventName": "ÉCLAIR", "awsRegion": "us-east-1", "eventTime": "2024-01-01T05:30:00+05:30", "readOnly": "true"},
]


def cmp(field, op, value=""):
    return {"t": "cmp", "field": field, "op": op, "value": value}


CASES = [
    (Filter(expr=cmp("awsRegion", "exists")), "ad"), (Filter(expr=cmp("awsRegion", "nexists")), "bc"),
    (Filter(expr={"t": "not", "node": cmp("awsRegion", "eq", "eu-west-1")}), "bcd"),
    (Filter(expr=cmp("user", "eq", "ROOT")), "b"), (Filter(expr=cmp("user", "eq", "r")), "c"), (Filter(expr=cmp("user", "eq", "-")), "d"),
    (Filter(expr=cmp("user", "eq", "ann_?")), "a"), (Filter(expr=cmp("username", "eq", "ann?1")), "a"),
    (Filter(expr=cmp("eventName", "contains", "100%")), "c"), (Filter(expr=cmp("eventName", "contains", "it's")), "c"),
    (Filter(includes={"eventName": ["it's 100% *odd*"]}), "c"), (Filter(includes={"eventName": ["*Object"]}), ""),
    (Filter(includes={"eventName": []}), "abcd"), (Filter(excludes={"awsRegion": ["EU-west-1"]}), "bcd"),
    (Filter(expr=cmp("eventName", "regex", "^éclair$")), "d"), (Filter(expr=cmp("errorMessage", "regex", "one.line")), ""),
    (Filter(expr=cmp("errorMessage", "regex", "one\\nline")), "b"), (Filter(expr=cmp("result", "eq", "success")), "acd"),
    (Filter(expr=cmp("readOnly", "eq", "true")), "ad"), (Filter(expr=cmp("managementEvent", "eq", "true")), "abcd"),
    (Filter(text="getobject eu-west"), ""), (Filter(text="RoLe/r"), "c"), (Filter(match_none=True), ""),
    (Filter(errors_only=True), "b"), (Filter(hide_read_only=True), "bc"), (Filter(exists=["roleArn"]), "c"),
    (Filter(from_ms=1704067200000, to_ms=1704067200000), "ad"), (Filter(from_ms=1704067200001), "b"),
    (Filter(expr=cmp("errorCode", "ne", "*")), "acd"), (Filter(expr={"t": "text", "value": "denied$", "regex": True}), "b"),
]


@pytest.fixture(scope="module")
def events(spark):
    return make_events(spark, RECORDS).cache()


def test_filter_corpus(events):
    for f, want in CASES:
        got = "".join(sorted(r.eventID for r in apply_filter(events, f).select("eventID").collect()))
        assert got == want, f


@pytest.mark.parametrize("make", [
    lambda: Filter(includes={"nope": ["x"]}).column(), lambda: Filter(exists=["nope"]).column(),
    lambda: Filter(from_ms=2, to_ms=1).column(), lambda: expr_column({"t": "and", "nodes": []}),
    lambda: expr_column(cmp("eventName", "like", "x")), lambda: expr_column(cmp("eventName", "regex", "(")),
    lambda: expr_column(cmp("eventName", "regex", "(a)\\1")), lambda: expr_column({"t": "text", "value": "x" * 16385}),
])
def test_invalid_filters_raise(spark, make):
    with pytest.raises(ValueError):
        make()


def test_regex_gate(spark):
    for bad in ("(?=a)", "(?!a)", "(?<=a)", "a++", "a*+", "x" * 4097):
        with pytest.raises(ValueError):
            java_regex(bad)
    assert java_regex("a$").endswith("a\\z")
    for good in ("[[:alpha:]]+", "[a&&b]", "(?P<n>a)", "[$]", "\\$"):
        java_regex(good)


def test_long_lists_join(events):
    values = [f"v{i}" for i in range(20_000)] + ["GETOBJECT"]
    assert [r.eventID for r in apply_filter(events, Filter(includes={"eventName": values})).collect()] == ["a"]
    assert sorted(r.eventID for r in apply_filter(events, Filter(excludes={"eventName": values})).collect()) == ["b", "c", "d"]
