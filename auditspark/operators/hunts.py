"""Hunts: typed indicators and ordered sequences, over all rows at once."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.facts import with_facts
from ..functions.network import canonical_network, last_hex, mask_hex, network_key, with_ip_hex
from ..functions.resources import COMPLETE_ARN
from ..model import Filter
from ..plans.slices import with_slices
from ..session import checkpoint
from .search import apply_filter, expr_column

RESULT_LIMIT = 500


def _filled(name: str) -> Column:
    return F.coalesce(name, F.lit("")) != ""


def validate_indicators(indicators: DataFrame) -> DataFrame:
    """Canonical value and validity of every (indicator_id, kind, value) row."""
    value = F.col("value")
    size = F.octet_length(value)
    network = F.when(F.col("kind").isin("ip", "cidr"), value)
    checked = indicators.withColumn("_net", canonical_network(network))
    cidr = value.contains("/")
    ok = F.when(F.col("kind") == "ip", F.col("_net.hex").isNotNull() & ~cidr) \
        .when(F.col("kind") == "cidr", F.col("_net.hex").isNotNull() & cidr) \
        .when(F.col("kind") == "key", value.rlike(r"\A[A-Za-z0-9_]{1,128}\z")) \
        .when(F.col("kind") == "event", (size <= 256) & ~value.rlike(r"[\r\n\t]")) \
        .when(F.col("kind") == "arn", value.rlike(COMPLETE_ARN)).otherwise(False)
    valid = F.coalesce((size > 0) & (size <= 2048) & ok, F.lit(False))
    return checked.withColumns({
        "valid": valid, "canonical": F.when(valid, F.coalesce("_net.value", value)),
        "netHex": F.when(valid, F.col("_net.hex")), "netBits": F.when(valid, F.col("_net.bits")),
    }).drop("_net")


def indicator_keys(indicators: DataFrame) -> DataFrame:
    """Valid indicators as (indicator_id, keyKind, key); the first id wins among equal ones."""
    valid = validate_indicators(indicators).filter("valid").groupBy("kind", "canonical").agg(
        F.min("indicator_id").alias("indicator_id"), F.first("netHex").alias("netHex"), F.first("netBits").alias("netBits"))
    network = F.col("kind").isin("ip", "cidr")
    return valid.select(
        "indicator_id", F.when(network, "net").otherwise(F.col("kind")).alias("keyKind"),
        F.when(network, network_key(F.col("netHex"), F.col("netBits"))).otherwise(F.col("canonical")).alias("key"),
        "netHex", "netBits")


#: Addresses are looked up by blocks of these leading hex digits (IPv4, IPv6).
_BLOCK = (4, 8)


def networks_of(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """(sourceIPAddress, indicator_id): the networks (indicator_id, netHex, netBits) that hold each address.

    Networks are nested or apart, so their first and last addresses cut the address line into ranges, and in a range the
    networks are the same for all addresses.  They are worked out for the cuts, by equality of masked keys for the prefix
    lengths that occur; an address then takes those of the last cut before it, by one sorted pass over its block.  An
    address is one row, however many prefix lengths there are.
    """
    hexed = with_ip_hex(addresses.select("sourceIPAddress").distinct(), "sourceIPAddress", "hex").filter(F.col("hex").isNotNull())
    block = F.left("hex", F.when(F.length("hex") == 8, _BLOCK[0]).otherwise(_BLOCK[1]))
    hexed = checkpoint(hexed.withColumn("block", F.concat_ws("/", F.length("hex").cast("string"), block)))
    nets = networks.select("indicator_id", F.col("netBits").alias("bits"), mask_hex(F.col("netHex"), F.col("netBits")).alias("_lead"), F.length("netHex").alias("width")) \
        .select("indicator_id", "bits", F.expr("rpad(_lead, width, '0')").alias("first"))
    nets = checkpoint(nets.withColumn("last", last_hex(F.col("first"), F.col("bits"))))
    # sides: a block begins, a network begins, addresses, a network ends
    cut = lambda rows, column, side: rows.select(F.col(column).alias("hex"), F.lit(side).alias("side"))
    begun = hexed.select("block", F.length("hex").alias("width")).distinct().select(F.expr("rpad(split_part(block, '/', 2), width, '0')").alias("first"))
    cuts = cut(begun, "first", -1).unionAll(cut(nets, "first", 0)).unionAll(cut(nets, "last", 2)).distinct()
    lengths = nets.select("bits").distinct().agg(F.array_sort(F.collect_set("bits"))).scalar()
    keyed = cuts.withColumn("bits", F.explode(lengths)).filter(F.col("bits") <= F.length("hex") * 4).withColumn("key", network_key(F.col("hex"), F.col("bits")))
    held = keyed.join(nets.select("indicator_id", "last", network_key(F.col("first"), F.col("bits")).alias("key")), "key") \
        .filter((F.col("side") < 2) | (F.col("last") > F.col("hex")))  # behind its last address a network holds no more
    over = cuts.join(held.groupBy("hex", "side").agg(F.collect_list("indicator_id").alias("over")), ["hex", "side"], "left") \
        .withColumn("over", F.coalesce("over", F.array().cast("array<bigint>")))
    over = over.withColumn("block", F.concat_ws("/", F.length("hex").cast("string"), block)).select("block", "hex", "side", "over", F.lit(None).cast("string").alias("sourceIPAddress"))
    line = over.unionByName(hexed.select("block", "hex", F.lit(1).alias("side"), F.lit(None).cast("array<bigint>").alias("over"), "sourceIPAddress"))
    before = Window.partitionBy("block").orderBy("hex", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("over", F.last("over", ignorenulls=True).over(before)).filter("side = 1")
    return found.select("sourceIPAddress", F.explode("over").alias("indicator_id"))


def _identifier_keys(events: DataFrame) -> DataFrame:
    """Credential, event id and resource names of every event, each once."""
    typed = lambda kind, key: F.struct(F.lit(kind).alias("keyKind"), key.alias("key"))
    keyed = with_facts(events)
    own = F.array(typed("key", F.col("accessKeyId")), typed("event", F.col("eventID")), typed("arn", F.col("identityArn")),
                  typed("arn", F.col("roleArn")))
    keys = F.concat(own, F.transform("facts.refs", lambda r: typed("arn", r["arn"])))
    return keyed.select("seq", F.inline_outer(F.array_distinct(keys))).filter(_filled("key"))


def indicator_hits(events: DataFrame, indicators: DataFrame, f: Filter | None = None) -> DataFrame:
    """(seq, indicator_id) pairs from equi joins.

    Events are expanded map-side to their typed lookup keys.  Networks are found
    for each distinct address, and events join the addresses that are in some.
    """
    keys = checkpoint(indicator_keys(indicators))  # read three times; one row per indicator
    scoped = apply_filter(events, f)
    wanted = keys.filter("keyKind <> 'net'").select("indicator_id", "keyKind", "key")
    inside = networks_of(scoped, keys.filter("keyKind = 'net'").select("indicator_id", "netHex", "netBits"))
    named = _identifier_keys(scoped).join(wanted, ["keyKind", "key"]).select("seq", "indicator_id")
    return scoped.select("seq", "sourceIPAddress").join(inside, "sourceIPAddress").select("seq", "indicator_id").unionByName(named)


def indicator_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("indicator_id").agg(F.count(F.lit(1)).alias("matches"))


def match_indicators(events: DataFrame, indicators: DataFrame, f: Filter | None = None) -> DataFrame:
    """Matched events, each once, with the sorted ids of its indicators."""
    hits = indicator_hits(events, indicators, f)
    per_event = hits.groupBy("seq").agg(F.array_sort(F.collect_set("indicator_id")).alias("indicators"))
    return events.join(per_event, "seq")


def newest(matches: DataFrame, limit: int = RESULT_LIMIT, ms: str = "eventMs", total: bool = False) -> DataFrame:
    """The newest matches; with ``total`` each row tells how many there are."""
    shown = matches.orderBy(F.col(ms).desc_nulls_last(), F.col("seq").desc()).limit(limit)
    return shown.withColumn("total", matches.agg(F.count(F.lit(1)).alias("total")).scalar()) if total else shown


# --- ordered sequences --------------------------------------------------------

def _step_columns(steps: list[Column | dict[str, Any]]) -> list[Column]:
    if not 2 <= len(steps) <= 5:
        raise ValueError("an ordered sequence needs 2 to 5 steps")
    columns = []
    for step in steps:
        column = expr_column(step) if isinstance(step, dict) else step
        if column is None:
            raise ValueError("every step needs a search expression")
        columns.append(F.coalesce(column, F.lit(False)))
    return columns


def match_sequence(events: DataFrame, steps: list[Column | dict[str, Any]], group: str = "principal", minutes: int = 60,
                   f: Filter | None = None) -> DataFrame:
    """One row per final-step event: the closest completed chain of earlier steps.

    Columns: the group columns, ``seq`` of the final event, ``firstMs``,
    ``endMs``, ``deltaMs``, ``seqs`` and ``ties`` per step.

    Plan: step rows are first reduced map-side to one row per (group, ms), then
    cut into time slices and chained by window functions that share one exchange
    and one sort.  The whole span is bounded, so a slice with its look-back sees
    every chain that can end in it; a group with most of the table spreads over
    its slices.
    """
    if not 1 <= minutes <= 1440:
        raise ValueError(f"a sequence spans from one minute to a day, not {minutes} minutes")
    if group not in ("principal", "credential"):
        raise ValueError(f"steps are joined by principal or by credential, not by {group!r}")
    columns, window_ms = _step_columns(steps), minutes * 60_000
    keys = ["identityArn"] + (["accessKeyId"] if group == "credential" else [])
    last = len(columns) - 1
    flags = [f"s{i}" for i in range(len(columns))]
    rows = apply_filter(events, f).filter(F.col("eventMs").isNotNull())
    for key in keys:
        rows = rows.filter(_filled(key))
    rows = rows.select(*keys, "seq", "eventMs", *[c.alias(n) for c, n in zip(columns, flags)]) \
        .filter(reduce(or_, [F.col(n) for n in flags]))

    # one row per group and millisecond: representative, tie count, final-step marker
    ticks = rows.groupBy(*keys, "eventMs").agg(
        *[F.max(F.when(F.col(flags[i]), F.col("seq"))).alias(f"q{i}") for i in range(last)],
        *[F.count_if(flags[i]).alias(f"t{i}") for i in range(last)],
        F.max(flags[last]).alias("final"))
    carried = reduce(or_, [F.col(f"q{i}").isNotNull() for i in range(last)])
    sliced = with_slices(ticks, "eventMs", window_ms, carry=carried)

    before = Window.partitionBy(*keys, "slice").orderBy("eventMs").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda i, first, seqs, ties: F.when(F.col(f"q{i}").isNotNull(), F.struct(
        first.alias("firstMs"), seqs.alias("seqs"), ties.alias("ties")))
    chain = sliced.withColumn("p", start(0, F.col("eventMs"), F.array("q0"), F.array("t0")))
    for i in range(1, last + 1):
        chain = chain.withColumn("prev", F.last("p", ignorenulls=True).over(before))
        fits = F.col("eventMs") - F.col("prev.firstMs") <= window_ms
        if i < last:
            chain = chain.withColumn("p", F.when(fits, start(
                i, F.col("prev.firstMs"), F.concat("prev.seqs", F.array(f"q{i}")), F.concat("prev.ties", F.array(f"t{i}")))))
        else:
            chain = chain.filter("own").filter("final").filter(fits)
    ends = rows.filter(flags[last]).select(*keys, "eventMs", "seq")
    found = ends.join(chain.select(*keys, "eventMs", "prev"), keys + ["eventMs"])
    return found.select(
        *keys, "seq", F.col("prev.firstMs").alias("firstMs"), F.col("eventMs").alias("endMs"),
        (F.col("eventMs") - F.col("prev.firstMs")).alias("deltaMs"),
        F.concat("prev.seqs", F.array("seq")).alias("seqs"),
        F.concat("prev.ties", F.array(F.lit(1).cast("long"))).alias("ties"))


def newest_sequences(matches: DataFrame, limit: int = RESULT_LIMIT) -> DataFrame:
    """Newest chains plus the total number of chains."""
    total = matches.agg(F.count(F.lit(1)).alias("total")).scalar()
    return matches.orderBy(F.col("endMs").desc(), F.col("seq").desc()).limit(limit).withColumn("total", total)


def sequence_rows(matches: DataFrame, events: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add ``events``: the display rows of every step, in step order.

    The result page is small; full rows are only fetched for it, by seq.
    """
    steps = matches.select(F.col("seq").alias("_end"), F.posexplode("seqs").alias("_step", "_seq"))
    wide = steps.join(events.select(F.col("seq").alias("_seq"), *columns), "_seq")
    packed = wide.groupBy("_end").agg(F.array_sort(F.collect_list(
        F.struct("_step", F.col("_seq").alias("seq"), *columns))).alias("events"))  # at most five per chain
    return matches.join(packed, matches.seq == packed._end).drop("_end")


def sequence_pairs(matches: DataFrame) -> DataFrame:
    """Two-step result as (first, second, deltaMs, tiedFirst)."""
    return matches.filter(F.size("seqs") == 2).select(
        F.col("seqs")[0].alias("first"), F.col("seqs")[1].alias("second"), "deltaMs", F.col("ties")[0].alias("tiedFirst"))
