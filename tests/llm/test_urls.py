"""URL filters against a plain search through all entries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from auditspark.llm import urls

HOSTS = ["com", "example.com", "www.example.com", "a.www.example.com", "net", "b.net", "example", "", "x.com", "le.com"]
PATHS = ["", "/", "/en", "/en/", "/en/x", "/e", "//", "/en//", "/en/x/y"]


def plain(url, entries, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        raw = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(raw):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), raw)
    fits = [(h.count(".") + 1 if h else 0, len(p), a, h + p) for h, p, a in entries
            if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


@pytest.fixture(scope="module")
def addresses():
    rng = random.Random(3)
    out = [None, "", "no address", "://", "http://", "HTTP://WWW.Example.COM/EN/", "http://example.com", "http://example.com?en/", "http://a.com#/", "x://y://z.com/en/",
           "http://example.com/en/" + "z" * 300_000, "http://" + "a." * 50_000 + "com/en/x", "http://.com/", "http://com./", "http://com/\n/en/?", "http://ÉX.com/é", "http://u@com:80/"]
    return out + [f"http://{rng.choice(['', 'm.', 'www.', 'a.'])}{rng.choice(HOSTS)}{rng.choice(PATHS)}{rng.choice(['', 'x', '/y', '?q', '#t', 'en/'])}" for _ in range(400)]


@pytest.mark.parametrize("most", [500_000, 3])
def test_like_plain_search(spark, addresses, most):
    rng = random.Random(most)
    entries = [(h, p, rng.choice(["allow", "block"])) for h in HOSTS for p in PATHS if rng.random() < 0.15]
    entries += [("net", "/en", "allow"), ("net", "/en", "block"), ("Example.COM", "/en", "block")]
    rows = [(k, u, 1, "h", "v") for k, u in enumerate(addresses)] + [(None, "http://b.net/en/", 1, "h", "v"), (3, "http://x.com/", None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, depth int, host string, verdict string")
    found = urls.judge(pages, spark.createDataFrame(entries, "host string, path string, action string"), most=most)
    assert found.columns == ["page_id", "url", "depth", "host", "path", "rule", "verdict"]
    lowered = [(h.lower(), p, a) for h, p, a in entries]
    want = sorted((str(r[0]), *plain(r[1], lowered)) for r in rows)
    want, got = ([tuple(map(str, r)) for r in x] for x in (want, sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in found.collect())))
    assert sorted(got) == sorted(want)


def test_empty_tables_and_refusals(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, action string")
    assert [tuple(r) for r in urls.judge(pages, none).collect()] == [(1, "http://a.com/", "a.com", "/", None, "allow")]
    assert urls.judge(pages, none, default="block").first().verdict == "block"
    one = spark.createDataFrame([("com", "/", "block")], none.schema)
    assert urls.judge(pages.limit(0), one).count() == 0 and urls.allowed(pages, one).count() == 0
    for bad in [("com", None, "allow"), (None, "/", "allow"), ("com", "/", "drop"), ("com", "/", None)]:
        with pytest.raises(ValueError):
            urls.judge(pages, spark.createDataFrame([bad], none.schema))
    with pytest.raises(ValueError):
        urls.judge(pages, none, default="maybe")


def test_longer_entries_win_between_allow_and_block(spark):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(["http://q.com/en/1", "http://www.q.com/en/1", "http://q.com/fr", "http://q.org/"])], "page_id int, url string")
    entries = spark.createDataFrame([("com", "/", "allow"), ("q.com", "/en/", "block"), ("www.q.com", "/en/", "allow"), ("org", "/", "block")], "host string, path string, action string")
    assert [r.verdict for r in urls.judge(pages, entries).orderBy("page_id").collect()] == ["block", "allow", "allow", "block"]
    assert [r.page_id for r in urls.allowed(pages, entries).orderBy("page_id").collect()] == [1, 2]
