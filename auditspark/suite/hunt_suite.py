"""Registered queries: indicators, networks, resource names, ordered sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import number_doubt, number_matches, spelled_copy
from ..functions.records import variant
from ..functions.network import in_network, ip_hex
from ..functions.resources import resource_refs
from ..model import Filter
from ..operators import hunts
from ..session import small_table
from .common import ACCOUNT_SQL, ASKED_ROLE_SQL, HOUR_MS, ev, with_ev

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


# The names each kind of fixture record carries: listed buckets, and request members that are whole resource names.
_REFS = f"""refs AS (
  SELECT seq, 'arn:aws:s3:::bucket-' || amount AS arn, 'AWS::S3::Bucket' AS kind, 'resources[0].ARN' AS source
    FROM ev WHERE eventSource LIKE 's3.%' AND eventNo % 8 NOT IN (1, 2)
  UNION ALL SELECT seq, 'arn:aws:s3:::bucket-' || amount % 9, '', 'resources[1].ARN' FROM ev WHERE eventSource LIKE 's3.%' AND eventNo % 8 = 0
  UNION ALL SELECT seq, CASE eventName WHEN 'GetSecretValue' THEN 'arn:aws:secretsmanager:us-east-1:' || {ACCOUNT_SQL} || ':secret:s' || amount
      WHEN 'Decrypt' THEN 'arn:aws:kms:us-east-1:' || {ACCOUNT_SQL} || ':key/' || amount % 10 ELSE {ASKED_ROLE_SQL} END, 'Request reference',
      'requestParameters["' || CASE eventName WHEN 'GetSecretValue' THEN 'secretId' WHEN 'Decrypt' THEN 'keyId' ELSE 'roleArn' END || '"]'
    FROM ev WHERE eventName IN ('GetSecretValue', 'Decrypt') OR eventSource LIKE 'sts.%' AND eventName <> 'AssumeRoot')"""


@_register("resource_references", with_ev("SELECT seq, arn, kind, source FROM refs", ctes=_REFS))
def resource_references(spark, sf):
    return resource_refs(ev(spark, sf))


_V4 = "sourceIPAddress NOT LIKE '%:%' AND sourceIPAddress NOT LIKE '%com'"
_V4_INT = ("(CAST(split_part(sourceIPAddress, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(sourceIPAddress, '.', 2) AS BIGINT) * 65536 "
           "+ CAST(split_part(sourceIPAddress, '.', 3) AS BIGINT) * 256 + CAST(split_part(sourceIPAddress, '.', 4) AS BIGINT))")


@_register("address_keys", with_ev(f"""SELECT seq, CASE WHEN {_V4} THEN lpad(lower(to_hex({_V4_INT})), 8, '0')
  WHEN sourceIPAddress LIKE '2001:db8:%' THEN '20010db8' || lpad(split_part(sourceIPAddress, ':', 3), 4, '0') || repeat('0', 16) || lpad(split_part(sourceIPAddress, ':', 5), 4, '0')
  WHEN sourceIPAddress LIKE '::ffff:%' THEN repeat('0', 20) || 'ffff0a0000' || lpad(lower(to_hex(CAST(split_part(sourceIPAddress, '.', 4) AS BIGINT))), 2, '0') END AS hex
FROM (SELECT seq, sourceIPAddress FROM ev)"""))
def address_keys(spark, sf):
    return ev(spark, sf).select("seq", ip_hex(F.col("sourceIPAddress")).alias("hex"))


@_register("network_containment", with_ev(f"""SELECT count(*) FILTER (WHERE v BETWEEN 167772160 AND 167772160 + 8388607) AS in_10_0_9,
  count(*) FILTER (WHERE v BETWEEN 167837696 AND 167837696 + 16383) AS in_10_1_0_18,
  count(*) FILTER (WHERE v IS NULL AND sourceIPAddress LIKE '2001:db8:%' AND try_cast(split_part(sourceIPAddress, ':', 3) AS INT) < 8) AS in_v6_45,
  count(*) FILTER (WHERE v IS NOT NULL) AS all_v4
FROM (SELECT sourceIPAddress, CASE WHEN {_V4} THEN {_V4_INT} END AS v FROM ev)"""))
def network_containment(spark, sf):
    ip = F.col("sourceIPAddress")
    return ev(spark, sf).agg(
        F.count_if(in_network(ip, "10.127.3.4/9")).alias("in_10_0_9"), F.count_if(in_network(ip, "10.1.0.0/18")).alias("in_10_1_0_18"),
        F.count_if(in_network(ip, "2001:db8::/45")).alias("in_v6_45"), F.count_if(in_network(ip, "0.0.0.0/0")).alias("all_v4"))


def _indicators(spark, sf):
    """Indicator table derived from the tables: suppliers name networks, customers name keys and principals."""
    supplier = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    customer = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    k = F.col("k").cast("string")
    account = F.lpad((F.col("k") % 25).cast("string"), 12, "0")
    nets = supplier.select(
        (F.col("k") * 10).alias("indicator_id"), F.when(F.col("k") % 3 == 0, "ip").otherwise("cidr").alias("kind"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("10."), (F.col("k") % 4).cast("string"), F.lit("."), (F.col("k") % 250).cast("string"), F.lit("."), (F.col("k") * 7 % 250).cast("string")))
        .otherwise(F.concat(F.lit("10."), (F.col("k") % 4).cast("string"), F.lit("."), (F.col("k") % 250).cast("string"), F.lit(".9/"), (F.col("k") % 12 + 16).cast("string"))).alias("value"))
    keys = customer.filter(F.col("c_mktsegment") == "BUILDING").select(
        (F.col("k") * 10 + 1).alias("indicator_id"), F.lit("key").alias("kind"),
        F.concat(F.when(F.col("k") % 5 == 2, "AKIA").otherwise("ASIA"), F.lpad(k, 8, "0")).alias("value"))
    names = customer.filter(F.col("c_mktsegment") == "MACHINERY").select(
        (F.col("k") * 10 + 2).alias("indicator_id"), F.lit("arn").alias("kind"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("arn:aws:iam::"), account, F.lit(":user/u"), k))
        .when(F.col("k") % 3 == 1, F.concat(F.lit("arn:aws:s3:::bucket-"), (F.col("k") % 90).cast("string")))
        .otherwise(F.concat(F.lit("arn:aws:iam::"), account, F.lit(":role/role-"), (F.col("k") % 7).cast("string"))).alias("value"))
    ids = supplier.select((F.col("k") * 10 + 3).alias("indicator_id"), F.lit("event").alias("kind"), F.concat(F.lit("ev-"), (F.col("k") * 3).cast("string")).alias("value"))
    return nets.unionByName(keys).unionByName(names).unionByName(ids)


_IND = f"""ind AS (
  SELECT min(indicator_id) AS indicator_id, kind, value, any_value(lo) AS lo, any_value(hi) AS hi FROM (
  SELECT s_suppkey * 10 AS indicator_id, CASE WHEN s_suppkey % 3 = 0 THEN 'ip' ELSE 'cidr' END AS kind,
    CASE WHEN s_suppkey % 3 = 0 THEN CAST(base + s_suppkey * 7 % 250 AS VARCHAR)
      ELSE CAST((base + 9) // w * w AS VARCHAR) || '/' || CAST(s_suppkey % 12 + 16 AS VARCHAR) END AS value,
    CASE WHEN s_suppkey % 3 = 0 THEN base + s_suppkey * 7 % 250 ELSE (base + 9) // w * w END AS lo,
    CASE WHEN s_suppkey % 3 = 0 THEN base + s_suppkey * 7 % 250 ELSE (base + 9) // w * w + w - 1 END AS hi
  FROM (SELECT s_suppkey, 167772160 + s_suppkey % 4 * 65536 + s_suppkey % 250 * 256 AS base, CAST(pow(2, 16 - s_suppkey % 12) AS BIGINT) AS w FROM supplier)
  UNION ALL SELECT c_custkey * 10 + 1, 'key', CASE WHEN c_custkey % 5 = 2 THEN 'AKIA' ELSE 'ASIA' END || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), NULL, NULL
    FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT c_custkey * 10 + 2, 'arn', CASE c_custkey % 3 WHEN 0 THEN 'arn:aws:iam::' || lpad(CAST(c_custkey % 25 AS VARCHAR), 12, '0') || ':user/u' || c_custkey
      WHEN 1 THEN 'arn:aws:s3:::bucket-' || (c_custkey % 90) ELSE 'arn:aws:iam::' || lpad(CAST(c_custkey % 25 AS VARCHAR), 12, '0') || ':role/role-' || (c_custkey % 7) END, NULL, NULL
    FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION ALL SELECT s_suppkey * 10 + 3, 'event', 'ev-' || (s_suppkey * 3), NULL, NULL FROM supplier) GROUP BY kind, value),
v4 AS (SELECT seq, {_V4_INT} AS v FROM ev WHERE {_V4}),
hits AS (
  SELECT v4.seq, ind.indicator_id FROM v4 JOIN ind ON v4.v BETWEEN ind.lo AND ind.hi
  UNION SELECT seq, indicator_id FROM ev JOIN ind ON kind = 'key' AND value = accessKeyId
  UNION SELECT seq, indicator_id FROM ev JOIN ind ON kind = 'event' AND value = eventID
  UNION SELECT seq, indicator_id FROM ev JOIN ind ON kind = 'arn' AND value = identityArn
  UNION SELECT seq, indicator_id FROM ev JOIN ind ON kind = 'arn' AND value = roleArn
  UNION SELECT refs.seq, ind.indicator_id FROM refs JOIN ind ON ind.kind = 'arn' AND ind.value = refs.arn)"""


@_register("indicator_totals", with_ev("SELECT indicator_id, count(*) AS matches FROM hits GROUP BY 1", ctes=_REFS + ", " + _IND))
def indicator_totals(spark, sf):
    return hunts.indicator_totals(hunts.indicator_hits(ev(spark, sf), _indicators(spark, sf)))


@_register("indicator_matches", with_ev("""SELECT ev.seq, ev.eventMs, string_agg(CAST(indicator_id AS VARCHAR), ',' ORDER BY indicator_id) AS indicators
FROM ev JOIN hits ON hits.seq = ev.seq WHERE NOT readOnly GROUP BY 1, 2""", ctes=_REFS + ", " + _IND))
def indicator_matches(spark, sf):
    found = hunts.match_indicators(ev(spark, sf), _indicators(spark, sf), Filter(hide_read_only=True))
    return found.select("seq", "eventMs", F.array_join("indicators", ",").alias("indicators"))


@_register("indicator_newest", with_ev("SELECT DISTINCT ev.seq, ev.eventMs FROM ev JOIN hits ON hits.seq = ev.seq ORDER BY ev.eventMs DESC NULLS LAST, ev.seq DESC LIMIT 500", ctes=_REFS + ", " + _IND))
def indicator_newest(spark, sf):
    return hunts.newest(hunts.match_indicators(ev(spark, sf), _indicators(spark, sf))).select("seq", "eventMs")


@_register("indicator_newest_of_all", with_ev("""SELECT seq, (SELECT count(DISTINCT seq) FROM hits) AS total FROM (SELECT DISTINCT ev.seq, ev.eventMs FROM ev JOIN hits ON hits.seq = ev.seq)
ORDER BY eventMs DESC NULLS LAST, seq DESC LIMIT 20""", ctes=_REFS + ", " + _IND))
def indicator_newest_of_all(spark, sf):
    return hunts.newest(hunts.match_indicators(ev(spark, sf), _indicators(spark, sf)), 20, total=True).select("seq", "total")


def _sequence_sql(predicates: list[str], group: str, minutes: int) -> tuple[str, str]:
    """Chains over ``ev`` by a running maximum; returns (ctes, name of the last one).

    Step after step, the rows of a step and the chains found so far are put on one time line; a window that ends one
    millisecond earlier hands every row the chain with the greatest end.
    """
    who = "identityArn" if group == "principal" else "identityArn || ' ' || accessKeyId"
    ctes = [f"able AS (SELECT *, {who} AS who FROM ev WHERE eventMs IS NOT NULL AND identityArn <> '' {'' if group == 'principal' else chr(10) + chr(32) * 2 + 'AND accessKeyId <> ' + chr(39) * 2})"]
    for number, predicate in enumerate(predicates):
        alone = number + 1 == len(predicates)  # rows of the last step stay apart, earlier ones are joined by time
        ctes.append(f"""hit{number} AS (SELECT who, any_value(identityArn) AS identityArn, eventMs AS moment, max(seq) AS last, count(*) AS n
  FROM able WHERE {predicate} GROUP BY who, eventMs{', seq' if alone else ''})""")
        if number == 0:
            ctes.append("chain0 AS (SELECT who, identityArn, moment AS firstMs, moment AS endMs, [last] AS seqs, [n] AS ties FROM hit0)")
            continue
        ctes.append(f"""line{number} AS (SELECT who, moment, last, n, identityArn, NULL AS chain FROM hit{number}
  UNION ALL BY NAME SELECT who, endMs AS moment, c AS chain FROM chain{number - 1} c)""")
        ctes.append(f"""chain{number} AS (SELECT who, identityArn, had.firstMs AS firstMs, moment AS endMs, list_append(had.seqs, last) AS seqs, list_append(had.ties, n) AS ties
  FROM (SELECT *, arg_max(chain, CASE WHEN chain IS NOT NULL THEN moment END) OVER (PARTITION BY who ORDER BY moment RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had
    FROM line{number}) WHERE last IS NOT NULL AND had IS NOT NULL AND moment - had.firstMs <= {minutes * 60000})""")
    return ", ".join(ctes), f"chain{len(predicates) - 1}"


def _sequence_query(name, steps, predicates, group, minutes, tick):
    ctes, last = _sequence_sql(predicates, group, minutes)
    sql = with_ev(f"""SELECT seqs[-1] AS seq, identityArn, firstMs, endMs, endMs - firstMs AS deltaMs, array_to_string(seqs, ',') AS seqs,
  array_to_string(ties, ',') AS ties FROM {last}""", tick, ctes)

    @_register(name, sql)
    def run(spark, sf):
        found = hunts.match_sequence(ev(spark, sf, tick), steps, group, minutes)
        return found.select("seq", "identityArn", "firstMs", "endMs", "deltaMs", F.array_join("seqs", ",").alias("seqs"),
                            F.array_join("ties", ",").alias("ties"))
    return run


def _cmp(field, value, op="eq"):
    return {"t": "cmp", "field": field, "op": op, "value": value}


_sequence_query("sequence_two_steps", [_cmp("errorCode", "*"), _cmp("eventName", "GetSecretValue")],
                ["coalesce(errorCode, '') <> ''", "eventName = 'GetSecretValue'"], "principal", 720, 1)
_sequence_query("sequence_three_steps_ties", [_cmp("eventSource", "s3.*"), _cmp("readOnly", "false"), _cmp("eventName", "*Trail*", "ne")],
                ["eventSource LIKE 's3.%'", "NOT readOnly", "NOT eventName ILIKE '%Trail%'"], "principal", 1440, HOUR_MS)
_sequence_query("sequence_five_steps_credential",
                [_cmp("readOnly", "true"), _cmp("readOnly", "false"), _cmp("readOnly", "true"), _cmp("eventName", "*"), _cmp("errorCode", "*")],
                ["readOnly", "NOT readOnly", "readOnly", "eventName <> ''", "coalesce(errorCode, '') <> ''"], "credential", 1440, HOUR_MS)

_PAIR_CTES, _PAIR_LAST = _sequence_sql(["eventName = 'AssumeRole'", "eventSource = 's3.amazonaws.com'"], "credential", 1440)


@_register("sequence_pairs", with_ev(f"""SELECT seqs[1] AS first, seqs[-1] AS second, endMs - firstMs AS deltaMs, ties[1] AS tiedFirst FROM {_PAIR_LAST}""", HOUR_MS, _PAIR_CTES))
def sequence_pairs(spark, sf):
    steps = [_cmp("eventName", "AssumeRole"), _cmp("eventSource", "s3.amazonaws.com")]
    return hunts.sequence_pairs(hunts.match_sequence(ev(spark, sf, HOUR_MS), steps, "credential", 1440))


@_register("sequence_page", with_ev(f"""SELECT m.seqs[-1] AS seq, (SELECT count(*) FROM {_PAIR_LAST}) AS total, a.eventName || '>' || b.eventName AS names
FROM (SELECT * FROM {_PAIR_LAST} ORDER BY endMs DESC, seqs[-1] DESC LIMIT 500) m
JOIN ev a ON a.seq = m.seqs[1] JOIN ev b ON b.seq = m.seqs[-1]""", HOUR_MS, _PAIR_CTES))
def sequence_page(spark, sf):
    events = ev(spark, sf, HOUR_MS)
    steps = [_cmp("eventName", "AssumeRole"), _cmp("eventSource", "s3.amazonaws.com")]
    newest = hunts.newest_sequences(hunts.match_sequence(events, steps, "credential", 1440))
    return hunts.sequence_rows(newest, events, ("eventName",)).select(
        "seq", "total", F.array_join(F.transform("events", lambda e: e["eventName"]), ">").alias("names"))


@_register("exact_numbers", with_ev("""SELECT count(*) FILTER (WHERE CAST(json_extract_string(raw, '$.requestParameters.size') AS DECIMAL(38, 2)) = 9007199254740993) AS eq_big,
  count(*) FILTER (WHERE CAST(json_extract_string(raw, '$.requestParameters.size') AS DECIMAL(38, 2)) > 9007199254740992) AS gt_big,
  count(*) FILTER (WHERE CAST(json_extract_string(raw, '$.requestParameters.size') AS DECIMAL(38, 2)) <= 50.5) AS lte_text,
  count(*) FILTER (WHERE CAST(json_extract_string(raw, '$.extra.k') AS BIGINT) < 10) AS lt_small,
  count(*) FILTER (WHERE json_type(raw, '$.resources') = 'ARRAY' AND len(list_filter(CAST(json_extract(raw, '$.resources[*].weight') AS VARCHAR[]), lambda x: CAST(x AS BIGINT) >= 40)) > 0) AS gte_item
FROM ev"""))
def exact_numbers(spark, sf):
    return ev(spark, sf).select(
        number_matches("requestParameters.size", "eq", "9007199254740993").alias("a"),
        number_matches("requestParameters.size", "gt", "9007199254740992").alias("b"),
        number_matches("requestParameters.size", "lte", "50.5").alias("c"),
        number_matches("extra.k", "lt", "10").alias("d"),
        number_matches("resources.weight", "gte", "40").alias("e")).agg(
        F.count_if("a").alias("eq_big"), F.count_if("b").alias("gt_big"), F.count_if("c").alias("lte_text"),
        F.count_if("d").alias("lt_small"), F.count_if("e").alias("gte_item"))


@_register("exact_numbers_far", with_ev("""SELECT CAST(sum(CASE WHEN eventNo % 3 < 2 THEN 1 ELSE 0 END) AS BIGINT) AS over_five, CAST(sum(CASE WHEN eventNo % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS over_long,
  CAST(sum(CASE WHEN eventNo % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS same, CAST(sum(CASE WHEN eventNo % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS undecided FROM ev"""))
def exact_numbers_far(spark, sf):
    """A power of ten beyond doubles, five thousand digits, and a member given twice, before each record's other members."""
    long = F.repeat(F.lit("7"), 5000)
    far = F.when(F.col("eventNo") % 3 == 0, "1e5000").when(F.col("eventNo") % 3 == 1, long).otherwise('5,"far":9')
    rows = ev(spark, sf).select(F.concat(F.lit('{"far":'), far, F.lit(","), F.substring("raw", F.lit(2), F.length("raw"))).alias("raw"))
    both = {"parsed": F.col("parsed"), "copied": F.col("copied")}  # made once a record for all predicates
    return rows.withColumns({"parsed": variant("raw"), "copied": spelled_copy("raw")}).select(
        number_matches("far", "gt", "5", **both).alias("a"), number_matches("far", "gt", "8e4999", **both).alias("b"),
        number_matches("far", "eq", "7" * 5000, **both).alias("c"), number_doubt(**both).isNotNull().alias("d")).agg(*[F.count_if(c).alias(n) for c, n in (("a", "over_five"), ("b", "over_long"), ("c", "same"), ("d", "undecided"))])
