"""Registered queries: observations, numbering, record fields, enrichment, envelopes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import diff, enrich, lineage, maintain
from ..session import shared_folder
from ..sources.files import spread
from ..sources.readers import unwrap_envelopes
from ..sources.sinks import bundle_tables, export_bundle
from ..streaming.intake import affected_sequences, capture_scope
from .common import ACCOUNT_SQL, ev, with_ev
from .lineage_suite import EDGES

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def observations(spark, sf):
    """Source copies of every event: one to three per key, some with changed text, some lossy."""
    copies = F.when(F.col("eventNo") % 5 == 0, 2).when(F.col("eventNo") % 3 == 0, 1).otherwise(0)
    rows = ev(spark, sf).withColumn("n", F.explode(F.sequence(F.lit(0), copies)))
    changed = F.when(F.col("n") == 2, F.replace("raw", F.lit('"eventVersion":"1.08"'), F.lit('"eventVersion":"1.09","note":["a"]'))).otherwise(F.col("raw"))
    return rows.select((F.col("seq") * 10 + F.col("n")).alias("position"), "eventKey", "seq", F.sha2(changed, 256).alias("sha256"), changed.alias("raw"),
                       changed.alias("original"), F.concat(F.lit("file-"), (F.col("eventNo") % 7).cast("string")).alias("source"),
                       F.col("seq").alias("ordinal"), F.lit("cloudtrail-json").alias("format"), (F.col("n") == 1).alias("lossy"), "eventTime")


_OBS = """obs AS (SELECT seq * 10 + n AS position, eventKey, seq, sha256(txt) AS sha256, txt AS raw, 'file-' || (eventNo % 7) AS source, n = 1 AS lossy, eventTime
  FROM (SELECT *, CASE WHEN n = 2 THEN replace(raw, '"eventVersion":"1.08"', '"eventVersion":"1.09","note":["a"]') ELSE raw END AS txt
    FROM (SELECT *, unnest(generate_series(0, CASE WHEN eventNo % 5 = 0 THEN 2 WHEN eventNo % 3 = 0 THEN 1 ELSE 0 END)) AS n FROM ev)))"""


@_register("first_copies", with_ev("SELECT eventKey, position, sha256 AS evidenceHash FROM obs QUALIFY row_number() OVER (PARTITION BY eventKey ORDER BY position) = 1", ctes=_OBS))
def first_copies(spark, sf):
    return maintain.first_copies(observations(spark, sf)).select("eventKey", "position", "evidenceHash")


@_register("numbered_events", with_ev("""SELECT 1000 + row_number() OVER (ORDER BY eventTime NULLS LAST, eventKey) AS seq, eventKey, evidenceHash
FROM (SELECT eventKey, eventTime, sha256 AS evidenceHash FROM obs QUALIFY row_number() OVER (PARTITION BY eventKey ORDER BY position) = 1)""", ctes=_OBS))
def numbered_events(spark, sf):
    return maintain.new_events(observations(spark, sf), None, 1000).select("seq", "eventKey", "evidenceHash")


@_register("appended_events", with_ev("""SELECT 500000 + row_number() OVER (ORDER BY eventTime NULLS LAST, eventKey) AS seq, eventKey
FROM (SELECT DISTINCT eventKey, eventTime FROM obs WHERE eventKey NOT IN (SELECT eventKey FROM ev WHERE eventMs < 1705000000000))""", ctes=_OBS))
def appended_events(spark, sf):
    stored = ev(spark, sf).filter(F.col("eventMs") < 1705000000000)
    return maintain.new_events(observations(spark, sf), stored, 500000).select("seq", "eventKey")


@_register("evidence_stats", with_ev("""SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM obs) AS observations, (SELECT count(*) FROM obs WHERE lossy) AS lossy,
  (SELECT count(*) FROM (SELECT eventKey FROM obs GROUP BY 1 HAVING count(DISTINCT sha256) > 1)) AS variantEvents""", ctes=_OBS))
def evidence_stats(spark, sf):
    return maintain.evidence_stats(ev(spark, sf), observations(spark, sf))


@_register("evidence_pages", with_ev("""SELECT * FROM (SELECT seq, position, sha256, lossy, count(*) OVER (PARTITION BY eventKey) AS total,
  row_number() OVER (PARTITION BY eventKey ORDER BY position) AS rank, sha256 = first_value(sha256) OVER (PARTITION BY eventKey ORDER BY position) AS displayed FROM obs) WHERE rank <= 25""", ctes=_OBS))
def evidence_pages(spark, sf):
    events = ev(spark, sf).withColumn("evidenceHash", F.sha2("raw", 256))
    return maintain.evidence_pages(events, observations(spark, sf)).select("seq", "position", "sha256", "lossy", "total", "rank", "displayed")


@_register("lookup_in_order", with_ev("""SELECT o_orderkey AS request, o_custkey * 20 + 1 AS seq, ev.eventID, ev.seq IS NOT NULL AS found FROM orders LEFT JOIN ev ON ev.seq = o_custkey * 20 + 1"""))
def lookup_in_order(spark, sf):
    wanted = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") * 20 + 1).alias("seq"))
    return maintain.lookup(ev(spark, sf).select("seq", "eventID"), wanted, "seq").select("request", "seq", "eventID", "found")


@_register("bundle_manifest", with_ev("""SELECT seq, count(*) AS copies, CAST(sum(octet_length(encode(raw))) AS BIGINT) AS bytes, count(DISTINCT sha256) AS variants,
  count(*) FILTER (WHERE position % 10 < 2) AS displayed, CAST(0 AS BIGINT) AS hashMismatches, CAST(0 AS BIGINT) AS displayMismatches
FROM obs WHERE eventKey IN (SELECT eventKey FROM ev WHERE eventName = 'StopLogging') GROUP BY 1""", ctes=_OBS))
def bundle_manifest(spark, sf):
    events = ev(spark, sf).withColumn("evidenceHash", F.sha2("raw", 256))
    context = events.filter(F.col("eventName") == "StopLogging").select("seq")
    return bundle_tables(context, events, observations(spark, sf).drop("seq"))["manifest"]


@_register("written_bundle", with_ev("""SELECT seq, list_sort(list(DISTINCT sha256))[1] AS least, count(*) AS copies, CAST(sum(octet_length(encode(raw))) AS BIGINT) AS bytes, count(DISTINCT sha256) AS variants
FROM obs WHERE eventKey IN (SELECT eventKey FROM ev WHERE eventName = 'DeleteTrail') GROUP BY 1""", ctes=_OBS))
def written_bundle(spark, sf):
    """A bundle written and read again: originals hashed anew, beside what the manifest says."""
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    events = ev(spark, sf).withColumn("evidenceHash", F.sha2("raw", 256))
    export_bundle(events.filter(F.col("eventName") == "DeleteTrail").select("seq"), events, observations(spark, sf).drop("seq"), path)
    sources, manifest, held = (spark.read.parquet(f"{path}/{name}") for name in ("sources", "manifest", "events"))
    found = sources.groupBy("seq").agg(F.min(F.sha2("original", 256)).alias("least"), F.count(F.lit(1)).alias("copies"), F.sum(F.octet_length("original")).alias("bytes"))
    return held.select("seq").join(found, "seq").join(manifest.select("seq", "variants"), "seq")


_POINTER = r"regexp_replace(replace(replace(regexp_replace(fullkey, '^\$', ''), '[', '/'), ']', ''), '\.', '/', 'g')"


@_register("field_profile", with_ev(f"""SELECT path, count(*) AS rows, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) FILTER (WHERE kind = 'null') AS nulls,
  CAST(sum(children) AS BIGINT) AS children FROM (SELECT {_POINTER} AS path,
    CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,
    CASE type WHEN 'ARRAY' THEN json_array_length(value) WHEN 'OBJECT' THEN len(json_keys(value)) ELSE 0 END AS children
  FROM ev, json_tree(ev.raw)) GROUP BY 1"""))
def field_profile(spark, sf):
    return diff.field_profile(ev(spark, sf)).select("path", "rows", "kinds", "nulls", "children")


@_register("version_changes", with_ev("""SELECT eventKey || '#' || sha256 AS pair, path, change FROM obs, (VALUES ('/eventVersion', 'changed'), ('/note', 'added')) c(path, change)
WHERE position % 10 = 2""", ctes=_OBS))
def version_changes(spark, sf):
    return diff.diff_versions(diff.version_pairs(observations(spark, sf))).select("pair", "path", "change")


@_register("consecutive_changes", with_ev("""SELECT pair, count(*) AS changes, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed FROM (
  SELECT coalesce(l.pair, r.pair) AS pair, coalesce(l.path, r.path) AS path, CASE WHEN l.pair IS NULL THEN 'added' WHEN r.pair IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM lf l FULL JOIN rf r ON l.pair = r.pair AND l.path = r.path
  WHERE l.type IS DISTINCT FROM r.type OR l.atom IS DISTINCT FROM r.atom) GROUP BY 1""", ctes=f"""

two AS (SELECT seq AS pair, json_extract(raw, '$.userIdentity.sessionContext.attributes') AS l, lead(json_extract(raw, '$.userIdentity.sessionContext.attributes')) OVER (PARTITION BY accessKeyId ORDER BY seq) AS r
  FROM ev WHERE roleArn <> '' AND accessKeyId <> ''),
lf AS (SELECT pair, {_POINTER} AS path, type, atom FROM two, json_tree(two.l) WHERE r IS NOT NULL AND type <> 'OBJECT'),
rf AS (SELECT pair, {_POINTER} AS path, type, atom FROM two, json_tree(two.r) WHERE r IS NOT NULL AND type <> 'OBJECT')"""))
def consecutive_changes(spark, sf):
    """Session attributes of consecutive uses of a key."""
    from pyspark.sql import Window
    attributes = F.get_json_object("raw", "$.userIdentity.sessionContext.attributes")
    rows = ev(spark, sf).filter((F.col("roleArn") != "") & (F.col("accessKeyId") != "")).select("seq", "accessKeyId", attributes.alias("left"))
    pairs = rows.select(F.col("seq").alias("pair"), "left", F.lead("left").over(Window.partitionBy("accessKeyId").orderBy("seq")).alias("right")).filter("right IS NOT NULL")
    return diff.diff_versions(pairs).groupBy("pair").agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))


# --- enrichment ---------------------------------------------------------------

def _directory(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey").cast("string")
    return c.select(F.concat(F.lit("d-"), (F.col("c_custkey") % 3).cast("string")).alias("store_id"), F.concat(F.lit("usr-"), k).alias("user_id"),
                    F.concat(F.lit("SESS-"), k).alias("user_name"), F.col("c_name").alias("display_name"),
                    F.explode(F.array(F.concat(F.lower("c_mktsegment"), F.lit("@a.example")), F.concat(k, F.lit("@b.example")))).alias("email")) \
        .withColumn("is_primary", F.col("email").endswith("@b.example") & (F.col("display_name").substr(-1, 1) != "1"))


_DIR = """dir AS (SELECT 'd-' || (c_custkey % 3) AS store_id, 'usr-' || c_custkey AS user_id, 'SESS-' || c_custkey AS user_name, c_name AS display_name,
  CASE WHEN c_name NOT LIKE '%1' THEN c_custkey || '@b.example' ELSE least(lower(c_mktsegment) || '@a.example', c_custkey || '@b.example') END AS email FROM customer)"""
_NODE = "coalesce(nullif(accessKeyId, ''), 'arn:' || coalesce(identityArn, ''))"


@_register("source_identities", with_ev(f"SELECT {_NODE} AS nodeKey, sourceIdentity AS subjectId, min(eventTime) AS observedAt FROM ev WHERE sourceIdentity <> '' GROUP BY 1, 2"))
def source_identities(spark, sf):
    return enrich.source_identities(ev(spark, sf)).select("nodeKey", "subjectId", "observedAt")


@_register("directory_identities", with_ev(f"""SELECT DISTINCT {_NODE} AS nodeKey, json_extract_string(raw, '$.userIdentity.onBehalfOf.identityStoreArn') || '/user/' || user_id AS subjectId, display_name AS displayName, email
FROM ev JOIN dir ON user_id = json_extract_string(raw, '$.userIdentity.onBehalfOf.userId') AND json_extract_string(raw, '$.userIdentity.onBehalfOf.identityStoreArn') LIKE '%:identitystore/' || store_id""", ctes=_DIR))
def directory_identities(spark, sf):
    return enrich.directory_identities(ev(spark, sf), _directory(spark, sf)).select("nodeKey", "subjectId", "displayName", "email")


def _mappings(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    day = F.lpad((F.col("n_nationkey") % 9 + 1).cast("string"), 2, "0")
    return n.select((F.col("n_nationkey") * 10 + F.col("k")).alias("mapping_id"),
                    F.concat(F.lit("arn:aws:iam::"), F.lpad(F.col("n_nationkey").cast("string"), 12, "0"), F.lit(":role/role-"), F.col("k").cast("string")).alias("roleArn"),
                    F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00Z")).alias("validFrom"),
                    F.when(F.col("n_nationkey") % 4 == 0, "2024-01-02T00:00:00Z").otherwise("2024-01-20T00:00:00Z").alias("validTo"),
                    F.when(F.col("n_nationkey") % 6 == 5, "2999-01-01T00:00:00Z").otherwise("2024-02-01T00:00:00Z").alias("verifiedAt"))


@_register("federated_identities", with_ev(f"""SELECT DISTINCT {_NODE} AS nodeKey, user_id AS subjectId, display_name AS displayName, email, 'mapping ' || m AS detail
FROM ev JOIN (SELECT n_nationkey * 10 + k AS m, 'arn:aws:iam::' || lpad(CAST(n_nationkey AS VARCHAR), 12, '0') || ':role/role-' || k AS role,
    epoch_ms(CAST('2024-01-' || lpad(CAST(n_nationkey % 9 + 1 AS VARCHAR), 2, '0') AS TIMESTAMP)) AS lo, CASE WHEN n_nationkey % 4 = 0 THEN 1704153600000 ELSE 1705708800000 END AS hi
    FROM nation, (SELECT unnest(generate_series(0, 6)) AS k) WHERE n_nationkey % 6 <> 5) ON role = roleArn
JOIN dir ON lower(user_name) = lower(split_part(identityArn, '/', 3))
WHERE lo < hi AND eventMs >= lo AND eventMs < hi AND eventMs - 3600000 >= lo AND eventMs - 3600000 < hi""", ctes=_DIR))
def federated_identities(spark, sf):
    return enrich.federated_identities(ev(spark, sf), _mappings(spark, sf), _directory(spark, sf), 1790000000000).select(
        "nodeKey", "subjectId", "displayName", "email", "detail")


def _audit_log(spark, sf):
    o = spread(spark.read.parquet(f"{sf}/orders.parquet"))
    key = F.concat(F.lit("ASIA"), F.lpad((F.col("o_custkey") % 200).cast("string"), 8, "0"))
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    n = F.col("o_orderkey")
    return o.select(part(
        '{"type":"', F.when(n % 11 == 0, F.lit("request")).otherwise(F.lit("response")), '","time":"2024-01-', F.lpad((n % 30 + 1).cast("string"), 2, "0"), 'T10:00:00Z"',
        F.when(n % 13 == 0, F.lit(',"error":"denied"')).otherwise(F.lit(',"error":""')), ',"auth":{"entity_id":"ent-', F.col("o_custkey") % 10,
        '"},"request":{"id":"rq-', n, '","mount_type":"', F.when(n % 7 == 0, F.lit("kv")).otherwise(F.lit("aws")), '","operation":"read","path":"',
        F.when(n % 5 == 0, F.lit("aws/config/r")).otherwise(F.lit("aws/creds/r")), '"},"response":{"data":{"access_key":"',
        F.when(n % 4 == 0, F.concat(F.lit("hmac-sha256:"), F.sha2(key, 256))).otherwise(key), '"}}}').alias("value"))


def _digests(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    key = F.concat(F.lit("ASIA"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return c.select(key.alias("access_key"), F.concat(F.lit("hmac-sha256:"), F.sha2(key, 256)).alias("digest"))


@_register("broker_identities", with_ev("""SELECT key AS nodeKey, 'ent-' || (o_custkey % 10) AS subjectId, CASE WHEN o_orderkey % 4 = 0 THEN 'audit-hmac-issued-access-key' ELSE 'exact-issued-access-key' END AS method,
  'request rq-' || o_orderkey || '; path aws/creds/r' AS detail
FROM (SELECT *, 'ASIA' || lpad(CAST(o_custkey % 200 AS VARCHAR), 8, '0') AS key, 1704067200000 + (o_orderkey % 30) * 86400000 + 36000000 AS issuedMs FROM orders)
JOIN (SELECT accessKeyId, max(eventMs) AS lastMs FROM ev GROUP BY 1) s ON s.accessKeyId = key
WHERE issuedMs <= lastMs AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0
  AND (o_orderkey % 4 <> 0 OR o_custkey % 200 IN (SELECT c_custkey FROM customer))"""))
def broker_identities(spark, sf):
    return enrich.broker_identities(ev(spark, sf), _audit_log(spark, sf), _digests(spark, sf)).select("nodeKey", "subjectId", "method", "detail")


@_register("enrichment_status", with_ev(f"""SELECT 'source-identity' AS source, count(*) AS rows, count(DISTINCT v) AS subjects, count(DISTINCT k) AS keys, (SELECT min(eventMs) FROM ev) AS fromMs, (SELECT max(eventMs) FROM ev) AS toMs
FROM (SELECT DISTINCT {_NODE} AS k, sourceIdentity AS v FROM ev WHERE sourceIdentity <> '')"""))
def enrichment_status(spark, sf):
    events = ev(spark, sf)
    return enrich.source_status(events, enrich.enrich(events))


_LINKS = f"""SELECT parentKey AS parent, childKey AS child, 'issuance' AS relationship, eventName AS label FROM edges
UNION ALL SELECT accessKeyId, 'ev:' || seq, 'activity', 'accessKeyId' FROM ev WHERE accessKeyId <> ''
UNION ALL SELECT CASE WHEN low = high THEN 'identity:' || low ELSE 'gap:' || key END, key, CASE WHEN low = high THEN 'identity' ELSE 'gap' END,
  CASE WHEN low = high THEN 'onBehalfOf' ELSE 'no issuance found' END
FROM (SELECT DISTINCT accessKeyId AS key FROM ev WHERE accessKeyId LIKE 'ASIA%' AND accessKeyId NOT IN (SELECT childKey FROM edges))
LEFT JOIN (SELECT {_NODE} AS key, min(subject) AS low, max(subject) AS high FROM (SELECT ev.*, 'arn:aws:identitystore::' || {ACCOUNT_SQL} || ':identitystore/d-' || userNo % 3 || '/user/usr-' || userNo AS subject
  FROM ev JOIN customer ON c_custkey = userNo WHERE userNo % 20 = 1 AND copy = 0 AND c_custkey % 3 = userNo % 3) GROUP BY 1) USING (key)"""


@_register("relationship_edges", with_ev(_LINKS, ctes=EDGES))
def relationship_edges(spark, sf):
    events = ev(spark, sf)
    return lineage.relationship_view(events, enrich.enrich(events, _directory(spark, sf)))


# --- envelopes ------------------------------------------------------------------

def messages(spark, sf):
    """Events wrapped the ways a queue delivers them; conversations supply the unrelated messages."""
    e = ev(spark, sf)
    bus = F.concat(F.lit('{"version":"0","detail-type":"'), F.when(F.col("eventNo") % 3 == 0, "AWS Service Event via CloudTrail").otherwise("AWS API Call via CloudTrail"),
                   F.lit('","detail":'), F.replace("raw", F.lit('{"eventVersion":"1.08"'), F.lit('{"eventCategory":"Management","eventVersion":"1.08"')), F.lit("}"))
    notice = F.to_json(F.struct(F.lit("Notification").alias("Type"), bus.alias("Message")))
    wrapped = F.when(F.col("eventNo") % 4 == 0, F.col("raw")).when(F.col("eventNo") % 4 == 1, notice).otherwise(bus)
    chat = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.to_json(F.struct(F.lit("ObjectCreated").alias("Event"), F.col("text").alias("Message"))).alias("value"), F.lit(None).cast("bigint").alias("seq"))
    return e.select(wrapped.alias("value"), "seq").unionByName(chat)


@_register("unwrapped_messages", with_ev("SELECT seq, eventID, eventName FROM ev"))
def unwrapped_messages(spark, sf):
    records, _ = unwrap_envelopes(messages(spark, sf))
    return records.select("seq", F.get_json_object("raw", "$.eventID").alias("eventID"), F.get_json_object("raw", "$.eventName").alias("eventName"))


@_register("rejected_messages", "SELECT count(*) AS rejects, count(DISTINCT conv_id) > 0 AS some FROM conversations")
def rejected_messages(spark, sf):
    _, rejects = unwrap_envelopes(messages(spark, sf))
    return rejects.agg(F.count(F.lit(1)).alias("rejects"), (F.count(F.lit(1)) > 0).alias("some"))


@_register("captured_writes", with_ev("""SELECT seq FROM ev WHERE eventNo % 4 IN (2, 3) AND eventNo % 3 <> 0 AND json_type(raw, '$.readOnly') = 'BOOLEAN' AND NOT readOnly"""))
def captured_writes(spark, sf):
    return capture_scope(messages(spark, sf), write_only=True).select("seq")


@_register("late_batch_sequences", with_ev("""SELECT c.seq, max(a.eventMs) AS firstMs FROM ev c JOIN ev a ON a.identityArn = c.identityArn AND a.eventMs < c.eventMs AND c.eventMs - a.eventMs <= 3600000
WHERE c.eventSource = 's3.amazonaws.com' AND coalesce(a.errorCode, '') <> '' AND c.identityArn IN (SELECT identityArn FROM ev WHERE eventMs >= 1706400000000 AND identityArn <> '') GROUP BY 1"""))
def late_batch_sequences(spark, sf):
    events = ev(spark, sf)
    late = events.filter(F.col("eventMs") >= 1706400000000)
    steps = [{"t": "cmp", "field": "errorCode", "op": "exists"}, {"t": "cmp", "field": "eventSource", "op": "eq", "value": "s3.amazonaws.com"}]
    return affected_sequences(events, late, steps, "principal", 60).select("seq", "firstMs")
